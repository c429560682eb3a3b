"""Column-shaping queries: names, casts, recodes, bins, text, dates and numbers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import bins, dates, text
from tidewater.operators import shaping
from tidewater.operators.aggregates import sum0
from tidewater.operators.reshape import split_col
from tidewater.queries import query
from tidewater.queries.bindings import DEPTH_CAT_SQL, HAUL_SQL, HSET_CAT_SQL, RECT_SQL, hauls, rects, table
from tidewater.sources.tables import lookup


@query("clean_headers", """SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, sum(l_quantity) AS catchkg
FROM lineitem GROUP BY ALL""")
def clean_headers(spark, sf):
    untidy = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("Return_Flag"), F.col("l_linestatus").alias("Line.Status?"),
        F.col("l_quantity").alias("CATCH (kg)"))
    df = shaping.normalize_names(untidy)
    return df.groupBy("returnflag", "linestatus").agg(F.sum("catchkg").alias("catchkg"))


@query("rename_and_drop", "SELECT n_name AS rect, count(*) AS vessels FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def rename_and_drop(spark, sf):
    df = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    df = shaping.rename_regex(df, {"^s_suppkey$": "vessel", "^n_name$": "rect"}).drop("lat", "lon", "s_acctbal")
    return df.groupBy("rect").agg(F.count("vessel").alias("vessels"))


@query("typed_from_text", """SELECT r.l_returnflag AS flag, sum(l_quantity) AS catch,
  sum(CAST(trunc(l_extendedprice) AS BIGINT)) AS whole, count(*) FILTER (WHERE l_linenumber = 7) AS failed
FROM lineitem r GROUP BY ALL""")
def typed_from_text(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("string").alias("catch"),
        F.col("l_extendedprice").cast("string").alias("whole"),
        F.when(F.col("l_linenumber") == 7, "seven").otherwise(F.col("l_linenumber").cast("string")).alias("nr"))
    failed = shaping.failed_casts(raw, {"nr": "int"}, ["flag"]).withColumnRenamed("nr", "failed")
    typed = shaping.cast_all(shaping.cast_all(raw, ["catch"], "double"), ["whole"], "bigint")
    sums = typed.groupBy("flag").agg(F.sum("catch").alias("catch"), F.sum("whole").alias("whole"))
    return sums.join(failed, "flag")


@query("derived_measures", f"""WITH {HAUL_SQL}
SELECT fleet, sum(catch / 1000) AS tonnes, avg(catch / duration) AS per_hour, avg(catch / nullif(duration - 1, 0)) AS per_extra_hour,
  avg(ln(catch)) AS logcatch FROM haul GROUP BY fleet""",
       digits={"tonnes": 6, "per_hour": 6, "per_extra_hour": 6, "logcatch": 6})
def derived_measures(spark, sf):
    h = hauls(spark, sf)
    return h.groupBy("fleet").agg(
        F.sum(F.col("catch") / 1000).alias("tonnes"),
        F.avg(shaping.safe_ratio(F.col("catch"), F.col("duration"))).alias("per_hour"),
        F.avg(shaping.safe_ratio(F.col("catch"), F.col("duration") - 1)).alias("per_extra_hour"),
        F.avg(F.log("catch")).alias("logcatch"))


@query("recode_species", f"""WITH {HAUL_SQL}
SELECT CASE WHEN species IN ('PROMO', 'SMALL') THEN 'arg' WHEN species LIKE 'L%' THEN 'large' ELSE species END AS species,
  count(*) AS n FROM haul GROUP BY 1""")
def recode_species(spark, sf):
    h = hauls(spark, sf, species=True)
    sp = F.col("species")
    new = shaping.recode(sp, [(sp.isin("PROMO", "SMALL"), F.lit("arg")), (sp.rlike("^L"), F.lit("large"))])
    return h.groupBy(new.alias("species")).agg(F.count(F.lit(1)).alias("n"))


@query("corrected_records", f"""WITH {HAUL_SQL}
SELECT fleet, CASE WHEN year = 2001 AND fleet = 'ASIA' THEN 2000 ELSE year END AS year,
  sum(CASE WHEN rect = 'NATION_3' AND year = 1997 THEN catch * 1000 WHEN year = 1995 THEN catch / 2 ELSE catch END) AS catch
FROM haul GROUP BY ALL""")
def corrected_records(spark, sf):
    year, catch = F.col("year"), F.col("catch")
    fixed = shaping.apply_corrections(hauls(spark, sf), [
        ((F.col("rect") == "NATION_3") & (year == 1997), {"catch": catch * 1000}),
        (year == 1995, {"catch": catch / 2}),
        ((year == 2001) & (F.col("fleet") == "ASIA"), {"year": F.lit(2000)})])
    return fixed.groupBy("fleet", "year").agg(sum0("catch").alias("catch"))


@query("repaired_years", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS indexed, count(*) AS n FROM orders GROUP BY 1""")
def repaired_years(spark, sf):
    y = F.year("o_orderdate")
    raw = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", y - 1994).otherwise(y).alias("year"),
                                            F.when(F.col("o_orderstatus") == "F", "catch").alias("var"))
    return raw.groupBy(shaping.repair_year(F.col("year")).alias("year")).agg(
        F.count(F.when(F.col("var") == "catch", 1)).alias("indexed"), F.count(F.lit(1)).alias("n"))


@query("depth_and_hour_bins", f"""WITH {HAUL_SQL}
SELECT {DEPTH_CAT_SQL.format(x='depth')} AS depth_cat, {HSET_CAT_SQL.format(x='hset')} AS hset_cat, count(*) AS n
FROM haul GROUP BY ALL""")
def depth_and_hour_bins(spark, sf):
    h = hauls(spark, sf)
    return h.groupBy(
        bins.bin_left(F.col("depth"), bins.DEPTH_BREAKS).alias("depth_cat"),
        bins.bin_right(F.hour("shoot_time"), bins.SET_HOUR_BREAKS, include_lowest=True).alias("hset_cat"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("decade_bins", """SELECT CASE WHEN floor(x) > 1 THEN '(' ||
  CAST((10 ** (length(CAST(floor(x)::BIGINT - 1 AS VARCHAR)) - 1))::BIGINT AS VARCHAR) || ',' ||
  CAST((10 ** length(CAST(floor(x)::BIGINT - 1 AS VARCHAR)))::BIGINT AS VARCHAR) || ']' END AS decade, count(*) AS n
FROM (SELECT l_extendedprice / (l_quantity * l_quantity) AS x FROM lineitem) GROUP BY 1""")
def decade_bins(spark, sf):
    x = F.col("l_extendedprice") / (F.col("l_quantity") * F.col("l_quantity"))
    return table(spark, sf, "lineitem").groupBy(bins.bin_log10(x).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query("pentad_classes", """SELECT '(' || lo || ',' || (lo + 5) || ']' AS pentad, count(*) AS n
FROM (SELECT ((CAST(year(o_orderdate) AS INTEGER) - 1981) // 5) * 5 + 1980 AS lo FROM orders) GROUP BY 1""")
def pentad_classes(spark, sf):
    return table(spark, sf, "orders").groupBy(bins.pentad(F.year("o_orderdate")).alias("pentad")).agg(
        F.count(F.lit(1)).alias("n"))


@query("grid_cells", f"""WITH {HAUL_SQL}, {RECT_SQL},
p AS (SELECT long + (trip % 100) / 100.0 AS lon, lat + (vesselid % 50) / 100.0 AS lat FROM haul JOIN rect USING (rect))
SELECT (floor(lon) + 0.5)::DOUBLE AS lon_mid, ((floor(lat / 0.5) + 0.5) * 0.5)::DOUBLE AS lat_mid, count(*) AS n
FROM p GROUP BY ALL""")
def grid_cells(spark, sf):
    p = hauls(spark, sf).join(rects(spark, sf), "rect").select(
        (F.col("long") + F.pmod("trip", F.lit(100)) / 100).alias("lon"),
        (F.col("lat") + F.pmod("vesselid", F.lit(50)) / 100).alias("lat"))
    lon, lat = bins.geo_bin(F.col("lon"), F.col("lat"))
    return p.groupBy(lon.alias("lon_mid"), lat.alias("lat_mid")).agg(F.count(F.lit(1)).alias("n"))


@query("ranked_categories", """SELECT o_orderstatus AS status, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 END AS rank,
  count(*) AS n FROM orders GROUP BY ALL""")
def ranked_categories(spark, sf):
    df = shaping.with_rank(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"), "status", ["P", "O"])
    return df.groupBy("status", "rank").agg(F.count(F.lit(1)).alias("n"))


@query("unit_labels", """WITH x AS (SELECT o_totalprice AS v FROM orders UNION ALL SELECT o_totalprice * 1000 FROM orders
  UNION ALL SELECT o_totalprice * 1000000 FROM orders UNION ALL SELECT o_totalprice * 1e10 FROM orders
  UNION ALL SELECT c_acctbal FROM customer)
SELECT CASE WHEN v < 1e3 THEN CASE WHEN v = floor(v) THEN CAST(v::BIGINT AS VARCHAR) ELSE CAST(v AS VARCHAR) END
  WHEN v < 1e6 THEN CAST(round_even(v / 1e3, 0)::BIGINT AS VARCHAR) || 'k'
  WHEN v < 1e9 THEN CAST(round_even(v / 1e6, 0)::BIGINT AS VARCHAR) || 'M'
  WHEN v < 1e12 THEN CAST(round_even(v / 1e9, 0)::BIGINT AS VARCHAR) || 'B'
  WHEN v < 1e15 THEN CAST(round_even(v / 1e12, 0)::BIGINT AS VARCHAR) || 'T' ELSE 'too big!' END AS label, count(*) AS n
FROM x GROUP BY 1""")
def unit_labels(spark, sf):
    price = table(spark, sf, "orders").select(F.explode(F.array(*[
        F.col("o_totalprice") * f for f in (1.0, 1e3, 1e6, 1e10)])).alias("v"))
    both = price.unionByName(table(spark, sf, "customer").select(F.col("c_acctbal").alias("v")))
    return both.groupBy(text.add_units(F.col("v")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("interval_texts", """WITH g AS (SELECT p_type, round_even(avg(p_retailprice), 0) AS median, min(p_retailprice) AS low,
  max(p_retailprice) AS high, count(*) FILTER (WHERE p_size > 25) / count(*) AS share FROM part GROUP BY p_type),
t AS (SELECT *, CASE WHEN low = floor(low) THEN CAST(low::BIGINT AS VARCHAR) ELSE CAST(low AS VARCHAR) END AS lo,
  CASE WHEN high = floor(high) THEN CAST(high::BIGINT AS VARCHAR) ELSE CAST(high AS VARCHAR) END AS hi FROM g)
SELECT p_type, CAST(median::BIGINT AS VARCHAR) || ' (' || lo || '-' || hi || ')' AS value,
  printf('%.1f', round_even(share * 100, 1)) || '%' AS percent FROM t""")
def interval_texts(spark, sf):
    g = table(spark, sf, "part").groupBy("p_type").agg(
        F.bround(F.avg("p_retailprice"), 0).alias("median"), F.min("p_retailprice").alias("low"),
        F.max("p_retailprice").alias("high"), F.avg((F.col("p_size") > 25).cast("double")).alias("share"))
    return g.select("p_type", text.fmt_interval(F.col("median"), F.col("low"), F.col("high")).alias("value"),
                    text.fmt_percent(F.col("share"), 1).alias("percent"))


@query("three_digit_texts", """SELECT CASE WHEN x >= 1000 THEN format('{:.0f}', x) ELSE format('{:.3g}', x) END AS label, count(*) AS n
FROM (SELECT l_discount * l_quantity / 7 + 0.001 AS x FROM lineitem) GROUP BY 1""")
def three_digit_texts(spark, sf):
    x = F.col("l_discount") * F.col("l_quantity") / 7 + 0.001
    return table(spark, sf, "lineitem").groupBy(text.signif_text(x).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("split_and_paste", """SELECT split_part(p_name, ' ', 1) AS colour, split_part(p_name, ' ', 2) AS thing,
  NULL::VARCHAR AS extra, split_part(p_name, ' ', 1) || '_' || coalesce(CASE WHEN p_size > 25 THEN p_type END, 'NA') AS key,
  substr(p_type, 1, 3) AS head, substr(p_brand, -3, 3) AS tail, count(*) AS n FROM part GROUP BY ALL""")
def split_and_paste(spark, sf):
    p = split_col(table(spark, sf, "part"), "p_name", ["colour", "thing", "extra"], " ")
    return p.groupBy(
        "colour", "thing", "extra",
        text.paste(F.col("colour"), F.when(F.col("p_size") > 25, F.col("p_type")), sep="_").alias("key"),
        F.substring("p_type", 1, 3).alias("head"), text.last_chars(F.col("p_brand"), 3).alias("tail"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("cleaned_texts", """SELECT lower(regexp_replace(c_mktsegment, 'U|I', '', 'g')) AS segment,
  lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS code, count(*) AS n FROM customer GROUP BY ALL""")
def cleaned_texts(spark, sf):
    return table(spark, sf, "customer").groupBy(
        F.lower(F.regexp_replace("c_mktsegment", "U|I", "")).alias("segment"),
        text.pad_age(F.col("c_nationkey")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("date_parts", """SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
  CAST(dayofyear(ts) AS INTEGER) AS yday, CAST(hour(ts) AS INTEGER) AS hour, 'q' || quarter(ts) AS quarter,
  CAST((dayofyear(ts) - 1) // 7 + 1 AS INTEGER) AS week, count(*) AS n FROM events GROUP BY ALL""")
def date_parts(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").groupBy(
        F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.dayofyear(ts).alias("yday"),
        F.hour(ts).alias("hour"), dates.quarter_label(ts).alias("quarter"), dates.week_of_year(ts).alias("week"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("serial_dates_and_times", """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date,
  strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS at, count(*) AS n FROM events GROUP BY ALL""")
def serial_dates_and_times(spark, sf):
    ts = F.col("ts")
    raw = table(spark, sf, "events").select(
        F.date_diff(ts.cast("date"), F.lit(dates.SERIAL_EPOCH).cast("date")).alias("day"),
        (F.hour(ts) * 100 + F.minute(ts)).alias("hhmm"))
    date = dates.excel_date(F.col("day"))
    return raw.groupBy(date.cast("string").alias("date"),
                       dates.hhmm_timestamp(date, F.col("hhmm")).cast("string").alias("at")).agg(F.count(F.lit(1)).alias("n"))


@query("number_functions", """SELECT l_linenumber AS nr, sum(round_even(l_quantity / 2, 0)) AS half_even, sum(floor(l_extendedprice)) AS down,
  sum(ceil(l_quantity / 50 * 10) / 10) AS tenths, sum(abs(l_quantity - 25)) AS gap, avg(exp(-l_discount)) AS decay,
  avg(ln(l_extendedprice)) AS log FROM lineitem GROUP BY 1""", digits={"tenths": 4, "decay": 9, "log": 9})
def number_functions(spark, sf):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("nr")).agg(
        F.sum(F.bround(q / 2, 0)).alias("half_even"), F.sum(F.floor(p).cast("double")).alias("down"),
        F.sum(F.ceil(q / 50 * 10) / 10).alias("tenths"), F.sum(F.abs(q - 25)).alias("gap"),
        F.avg(F.exp(-F.col("l_discount"))).alias("decay"), F.avg(F.log(p)).alias("log"))


@query("converted_lengths", f"""WITH {HAUL_SQL}, f(species, sltottl, sltofl) AS (VALUES ('PROMO', 1.17, NULL), ('SMALL', 1.21, 1.05), ('LARGE', NULL, 1.1)),
x AS (SELECT h.species, CASE WHEN catch <= 25 THEN 'SL' ELSE 'TTL' END AS lengthtype, CASE WHEN fleet = 'ASIA' THEN '87' ELSE '27' END AS area,
  catch AS length, sltottl, sltofl FROM haul h LEFT JOIN f ON h.species = f.species)
SELECT species, area, CASE WHEN lengthtype = 'SL' AND area = '27' THEN 'TTL' WHEN lengthtype = 'SL' THEN 'FL' ELSE lengthtype END AS lengthtype,
  CAST(floor(CASE WHEN lengthtype = 'SL' AND area = '27' THEN length * coalesce(sltottl, 1.2)::DOUBLE
    WHEN lengthtype = 'SL' THEN length * sltofl::DOUBLE ELSE length END) AS BIGINT) AS length, count(*) AS n FROM x GROUP BY ALL""")
def converted_lengths(spark, sf):
    factors = lookup(spark, [("PROMO", 1.17, None), ("SMALL", 1.21, 1.05), ("LARGE", None, 1.1)],
                     "species string, sltottl double, sltofl double")
    raw = hauls(spark, sf, species=True).select(
        "species", F.when(F.col("catch") <= 25, "SL").otherwise("TTL").alias("lengthtype"),
        F.when(F.col("fleet") == "ASIA", "87").otherwise("27").alias("area"), F.col("catch").alias("length"))
    return shaping.convert_length(raw, factors).groupBy("species", "area", "lengthtype", "length").agg(
        F.count(F.lit(1)).alias("n"))


@query("filled_missing", f"""WITH {HAUL_SQL} SELECT fleet, sum(coalesce(depth, 0)) AS zero, sum(coalesce(depth, 500)) AS usual,
  sum(coalesce(depth, catch)) AS other FROM haul GROUP BY fleet""")
def filled_missing(spark, sf):
    h = hauls(spark, sf)
    three = h.withColumns({"zero": F.col("depth"), "usual": F.col("depth"), "other": F.col("depth")})
    three = shaping.zero_fill(shaping.zero_fill(shaping.zero_fill(three, ["zero"]), ["usual"], 500.0), ["other"], F.col("catch"))
    return three.groupBy("fleet").agg(*[F.sum(c).alias(c) for c in ("zero", "usual", "other")])


@query("log_of_several_columns", """SELECT l_returnflag AS flag, avg(ln(l_quantity)) AS l_quantity, avg(ln(l_extendedprice)) AS l_extendedprice
FROM lineitem GROUP BY 1""", digits={"l_quantity": 9, "l_extendedprice": 9})
def log_of_several_columns(spark, sf):
    df = shaping.map_columns(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], F.log)
    return df.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.avg("l_quantity").alias("l_quantity"), F.avg("l_extendedprice").alias("l_extendedprice"))
