"""Filter, join and union queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import filters, joins, sets
from tidewater.operators.aggregates import sum0
from tidewater.queries import query
from tidewater.queries.bindings import HAUL_SQL, RECT_SQL, hauls, rects, table
from tidewater.sources.tables import lookup


@query("area_and_depth_box", f"""WITH {HAUL_SQL}, {RECT_SQL}
SELECT fleet, count(*) AS n FROM haul JOIN rect USING (rect) WHERE long > -15 AND long < 0 AND depth >= 200 AND depth < 1500 GROUP BY 1""")
def area_and_depth_box(spark, sf):
    h = joins.left_join(hauls(spark, sf), rects(spark, sf), ["rect"])
    return h.where(filters.between_open(F.col("long"), -15, 0) & (F.col("depth") >= 200) & (F.col("depth") < 1500)).groupBy(
        "fleet").agg(F.count(F.lit(1)).alias("n"))


@query("members_of_list_and_table", f"""WITH {HAUL_SQL} SELECT rect, count(*) AS n FROM haul
WHERE week IN (15, 20, 25) AND vesselid IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""")
def members_of_list_and_table(spark, sf):
    rich = table(spark, sf, "supplier").where(F.col("s_acctbal") > 0).select("s_suppkey")
    h = filters.filter_in(filters.filter_in(hauls(spark, sf), "week", [15, 20, 25]), "vesselid", rich)
    return h.groupBy("rect").agg(F.count(F.lit(1)).alias("n"))


@query("either_variable", f"""WITH {HAUL_SQL} SELECT fleet, year, sum(catch) AS catch FROM haul
WHERE (fleet = 'ASIA' AND year IN (1997)) OR (fleet = 'EUROPE' AND year IN (1998, 1999)) GROUP BY ALL""")
def either_variable(spark, sf):
    keep = filters.any_of({"ASIA": [1997], "EUROPE": [1998, 1999]}, "fleet", "year")
    return hauls(spark, sf).where(keep).groupBy("fleet", "year").agg(sum0("catch").alias("catch"))


@query("pattern_filter", """SELECT p_type, count(*) AS n FROM part WHERE regexp_matches(p_name, '^(red|blue)') AND p_brand LIKE '%1%' GROUP BY 1""")
def pattern_filter(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").rlike("^(red|blue)") & F.col("p_brand").contains("1")).groupBy(
        "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("known_values_only", f"""WITH {HAUL_SQL} SELECT fleet, count(*) AS n FROM haul
WHERE depth IS NOT NULL AND nullif(week, 20) IS NOT NULL GROUP BY 1""")
def known_values_only(spark, sf):
    h = hauls(spark, sf).withColumn("week", F.nullif(F.col("week"), F.lit(20)))
    return h.dropna(subset=["depth", "week"]).groupBy("fleet").agg(F.count(F.lit(1)).alias("n"))


@query("sentinel_filter", f"""WITH {HAUL_SQL} SELECT fleet, count(*) FILTER (WHERE coalesce(depth, -1) <> -1) AS coded,
  count(*) FILTER (WHERE catch - 10 > 0) AS positive FROM haul GROUP BY 1""")
def sentinel_filter(spark, sf):
    h = hauls(spark, sf).withColumns({"depth": F.coalesce("depth", F.lit(-1.0)), "over": F.col("catch") - 10})
    coded = filters.drop_sentinel(h, "depth").groupBy("fleet").agg(F.count(F.lit(1)).alias("coded"))
    return coded.join(filters.drop_sentinel(h, "over", positive=True).groupBy("fleet").agg(
        F.count(F.lit(1)).alias("positive")), "fleet")


@query("optional_filter", f"""WITH {HAUL_SQL} SELECT 'all' AS which, count(*) AS n FROM haul
UNION ALL SELECT 'some', count(*) FROM haul WHERE year IN (1996, 1998)""")
def optional_filter(spark, sf):
    h = hauls(spark, sf)
    return sets.union_tagged({
        "all": filters.maybe_filter(h, "year").agg(F.count(F.lit(1)).alias("n")),
        "some": filters.maybe_filter(h, "year", [1996, 1998]).agg(F.count(F.lit(1)).alias("n"))}, "which")


@query("negated_condition", f"""WITH {HAUL_SQL} SELECT fleet, year, count(*) AS n FROM haul
WHERE NOT (fleet = 'ASIA' AND year >= 1999 AND depth > 500) GROUP BY ALL""")
def negated_condition(spark, sf):
    return hauls(spark, sf).where(~((F.col("fleet") == "ASIA") & (F.col("year") >= 1999) & (F.col("depth") > 500))).groupBy(
        "fleet", "year").agg(F.count(F.lit(1)).alias("n"))


@query("positions_joined", f"""WITH {HAUL_SQL}, {RECT_SQL} SELECT rect, long, lat, count(*) AS n, sum(catch) AS catch
FROM haul LEFT JOIN (SELECT * FROM rect WHERE long < 0) USING (rect) GROUP BY ALL""")
def positions_joined(spark, sf):
    west = rects(spark, sf).where(F.col("long") < 0)
    return joins.left_join(hauls(spark, sf), west, ["rect"]).groupBy("rect", "long", "lat").agg(
        F.count(F.lit(1)).alias("n"), F.sum("catch").alias("catch"))


@query("joined_on_several_keys", """WITH c AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
w AS (SELECT l_partkey, l_suppkey, max(l_extendedprice) AS w FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT l_suppkey, count(*) AS n, count(w) AS known, sum(q * w) AS sop FROM c LEFT JOIN w USING (l_partkey, l_suppkey) GROUP BY 1""",
       digits={"sop": 2})
def joined_on_several_keys(spark, sf):
    li, keys = table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"]
    c = li.groupBy(*keys).agg(F.sum("l_quantity").alias("q"))
    w = li.where(F.col("l_returnflag") == "A").groupBy(*keys).agg(F.max("l_extendedprice").alias("w"))
    return joins.left_join(c, w, keys).groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.count("w").alias("known"), F.sum(F.col("q") * F.col("w")).alias("sop"))


@query("natural_join_missing_keys", """WITH o AS (SELECT nullif(o_orderpriority, '3-MEDIUM') AS pr, o_totalprice FROM orders),
d AS (SELECT nullif(o_orderpriority, '3-MEDIUM') AS pr, count(*) AS label FROM orders GROUP BY 1)
SELECT o.pr, label, count(*) AS n FROM o LEFT JOIN d ON o.pr IS NOT DISTINCT FROM d.pr GROUP BY ALL""")
def natural_join_missing_keys(spark, sf):
    o = table(spark, sf, "orders").select(F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")).alias("pr"), "o_totalprice")
    d = o.groupBy("pr").agg(F.count(F.lit(1)).alias("label"))
    return joins.natural_left(o, d, null_safe=True).groupBy("pr", "label").agg(F.count(F.lit(1)).alias("n"))


@query("lookup_with_default", f"""WITH {HAUL_SQL}, f(species, factor) AS (VALUES ('PROMO', 1.17::DOUBLE), ('SMALL', 1.21::DOUBLE))
SELECT h.species, coalesce(factor, 1.2::DOUBLE) AS factor, sum(catch) AS catch FROM haul h LEFT JOIN f ON h.species = f.species GROUP BY ALL""")
def lookup_with_default(spark, sf):
    f = lookup(spark, [("PROMO", 1.17), ("SMALL", 1.21)], "species string, factor double")
    return joins.lookup_left(hauls(spark, sf, species=True), f, ["species"], {"factor": 1.2}).groupBy("species", "factor").agg(
        F.sum("catch").alias("catch"))


@query("category_grid", """SELECT y.year, w.fleet, t.species FROM (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem) y
CROSS JOIN (SELECT DISTINCT r_name AS fleet FROM region) w CROSS JOIN (SELECT DISTINCT p_type AS species FROM part) t""")
def category_grid(spark, sf):
    return joins.grid([table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")),
                       table(spark, sf, "region").select(F.col("r_name").alias("fleet")),
                       table(spark, sf, "part").select(F.col("p_type").alias("species"))])


@query("bucketed_product", """SELECT n_name, p_type, count(*) AS n FROM nation CROSS JOIN (SELECT p_type, p_size FROM part GROUP BY ALL)
GROUP BY ALL""")
def bucketed_product(spark, sf):
    kinds = table(spark, sf, "part").select("p_type", "p_size").distinct()
    return joins.product(table(spark, sf, "nation").select("n_name"), kinds).groupBy("n_name", "p_type").agg(
        F.count(F.lit(1)).alias("n"))


@query("columns_bound_by_key", """SELECT n.year, n.age, n.canum, w.weca FROM
(SELECT CAST(year(l_shipdate) AS INTEGER) AS year, p_size AS age, sum(l_quantity) AS canum FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) n
LEFT JOIN (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, p_size AS age, max(l_extendedprice) AS weca FROM lineitem
  JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL) w USING (year, age)""")
def columns_bound_by_key(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    keys = [F.year("l_shipdate").alias("year"), F.col("p_size").alias("age")]
    n = li.groupBy(*keys).agg(F.sum("l_quantity").alias("canum"))
    w = li.where(F.col("l_returnflag") == "R").groupBy(*keys).agg(F.max("l_extendedprice").alias("weca"))
    return joins.left_join(n, w, ["year", "age"])


@query("depth_from_raster", f"""WITH {HAUL_SQL}, {RECT_SQL},
p AS (SELECT fleet, long + (trip % 300) / 100.0 AS lon, lat FROM haul JOIN rect USING (rect)),
g AS (SELECT CAST(floor(long) AS BIGINT) AS ix, CAST(floor(lat) AS BIGINT) AS iy, (100 + long * 3) AS depth FROM rect)
SELECT fleet, depth AS calc_depth, count(*) AS n FROM p LEFT JOIN g ON floor(lon) = ix AND floor(p.lat) = iy GROUP BY ALL""")
def depth_from_raster(spark, sf):
    r = rects(spark, sf)
    points = hauls(spark, sf).join(r, "rect").select(
        "fleet", (F.col("long") + F.pmod("trip", F.lit(300)) / 100).alias("lon"), "lat")
    raster = r.select(F.floor("long").alias("ix"), F.floor("lat").alias("iy"), (-(100 + F.col("long") * 3)).alias("height"))
    return joins.raster_lookup(points, raster, "lon", "lat", 1.0).groupBy("fleet", "calc_depth").agg(F.count(F.lit(1)).alias("n"))


@query("report_row_per_key", f"""WITH {HAUL_SQL}, k AS (SELECT DISTINCT fleet, year FROM haul),
a AS (SELECT fleet, year, count(DISTINCT vesselid) AS nvessels FROM haul WHERE year > 1996 GROUP BY ALL),
b AS (SELECT fleet, year, sum(catch) AS catch FROM haul WHERE fleet <> 'ASIA' GROUP BY ALL)
SELECT fleet, year, coalesce(nvessels, 0) AS nvessels, coalesce(catch, 0) AS catch FROM k LEFT JOIN a USING (fleet, year)
LEFT JOIN b USING (fleet, year)""")
def report_row_per_key(spark, sf):
    h = hauls(spark, sf)
    keys = sets.distinct_on(h, ["fleet", "year"])
    a = h.where(F.col("year") > 1996).groupBy("fleet", "year").agg(F.countDistinct("vesselid").alias("nvessels"))
    b = h.where(F.col("fleet") != "ASIA").groupBy("fleet", "year").agg(F.sum("catch").alias("catch"))
    return joins.report_join(keys, a, b, zero=["nvessels", "catch"])


@query("observed_beside_predicted", """SELECT coalesce(a.year, b.year) AS year, observed, predicted FROM
(SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS observed FROM orders WHERE year(o_orderdate) > 1995 GROUP BY 1) a
FULL JOIN (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_extendedprice) AS predicted FROM lineitem GROUP BY 1) b ON a.year = b.year""",
       digits={"observed": 2, "predicted": 2})
def observed_beside_predicted(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("observed"))
    b = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("predicted"))
    return joins.full_compare(a.where(F.col("year") > 1995), b, ["year"])


@query("union_by_name", """SELECT kind, year, sum(amount) AS amount, count(tax) AS taxed FROM (
  SELECT 'order' AS kind, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS amount, NULL AS tax FROM orders
  UNION ALL SELECT 'line', CAST(year(l_shipdate) AS INTEGER), l_extendedprice, l_tax FROM lineitem) GROUP BY ALL""",
       digits={"amount": 2})
def union_by_name(spark, sf):
    orders = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("amount"))
    lines = table(spark, sf, "lineitem").select(F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("amount"),
                                                F.year("l_shipdate").alias("year"))
    return sets.union_tagged({"order": orders, "line": lines}, "kind").groupBy("kind", "year").agg(
        F.sum("amount").alias("amount"), F.count("tax").alias("taxed"))


@query("every_year_listed", f"""WITH {HAUL_SQL} SELECT CAST(y.year AS INTEGER) AS year, catch FROM generate_series(1990, 2005) y(year)
LEFT JOIN (SELECT year, sum(catch) AS catch FROM haul GROUP BY 1) USING (year)""")
def every_year_listed(spark, sf):
    per = hauls(spark, sf).groupBy("year").agg(F.sum("catch").alias("catch"))
    return sets.add_year_spine(per, 1990, 2005)


@query("distinct_events", f"WITH {HAUL_SQL} SELECT DISTINCT fleet, vesselid, year FROM haul")
def distinct_events(spark, sf):
    return sets.distinct_on(hauls(spark, sf), ["fleet", "vesselid", "year"])
