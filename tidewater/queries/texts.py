"""Text-layout queries: the tables are written out as report text by Spark and parsed back.

A file here is one fleet's table by year and age, so its text is bounded by years
times ages whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.queries import query
from tidewater.queries.bindings import HAUL_SQL, hauls, table
from tidewater.queries.catches import SAMPLING_SQL, sampling
from tidewater.session import scratch_path
from tidewater.sources import text
from tidewater.sources.arrivals import absorb_new_files
from tidewater.sources.tables import load_table, save_table, write_csv, write_result


def joined(df: DataFrame, keys: list[str], order: list[str], value: Column, sep: str, out: str) -> DataFrame:
    """Values of a short group in order, as one text."""
    items = F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(items, lambda s: s["v"]), sep).alias(out))


@query("delimited_lines_parsed", """SELECT l_returnflag AS flag, l_linenumber AS nr, sum(l_quantity) AS catch, count(*) AS n,
  count(*) FILTER (WHERE l_linenumber = 7) AS missing FROM lineitem GROUP BY ALL""")
def delimited_lines_parsed(spark, sf):
    li = table(spark, sf, "lineitem")
    lines = li.select(F.when(F.col("l_linenumber") == 7, F.concat_ws("\t", "l_returnflag", "l_linenumber", "l_quantity"))
                      .otherwise(F.concat_ws("\t", "l_returnflag", "l_linenumber", "l_quantity", "l_tax")).alias("value"))
    rows = text.parse_delimited(lines, "flag string, nr int, catch double, tax double")
    return rows.groupBy("flag", "nr").agg(F.sum("catch").alias("catch"), F.count(F.lit(1)).alias("n"),
                                          F.count(F.when(F.col("tax").isNull(), 1)).alias("missing"))


def cells(spark, sf):
    """Numbers by fleet, year and age over the years and ages there are, with their first and last; unknown where there are none."""
    per = sampling(spark, sf).groupBy("fleet", "year", F.col("ageorlength").alias("age")).agg(F.sum("canum").alias("v"))
    ends = per.agg(F.struct(F.min("year").alias("y0"), F.max("year").alias("y1"), F.min("age").alias("a0"), F.max("age").alias("a1"))).scalar()
    full = per.select("fleet").distinct().select("fleet", ends.alias("e")).select("fleet", "e.*").select(
        "*", F.explode(F.sequence("y0", "y1")).alias("year")).select("*", F.explode(F.sequence("a0", "a1")).alias("age"))
    return full.join(per, ["fleet", "year", "age"], "left")


CELLS_SQL = f"""{SAMPLING_SQL}, per AS (SELECT fleet, year, ageorlength AS age, sum(canum) AS v FROM samples GROUP BY ALL),
cells AS (SELECT f.fleet, CAST(y AS INTEGER) AS year, CAST(a AS INTEGER) AS age, v
  FROM (SELECT DISTINCT fleet FROM per) f CROSS JOIN generate_series((SELECT min(year) FROM per), (SELECT max(year) FROM per)) t(y)
  CROSS JOIN generate_series((SELECT min(age) FROM per), (SELECT max(age) FROM per)) u(a)
  LEFT JOIN per ON per.fleet = f.fleet AND per.year = y AND per.age = a)"""


def coded(v: str) -> Column:
    return F.coalesce(F.col(v).cast("string"), F.lit("-1"))


def matrix_files(spark, sf) -> DataFrame:
    ends = ["y0", "y1", "a0", "a1"]
    lines = joined(cells(spark, sf), ["fleet", *ends, "year"], ["age"], coded("v"), " \t ", "line").withColumn(
        "line", F.concat(F.lit("   "), "line", F.lit("  #"), F.col("year").cast("string")))
    body = joined(lines, ["fleet", *ends], ["year"], F.col("line"), "\r\n", "body")
    head = F.format_string("Catch in numbers\r\n  1  2\r\n %d  %d\r\n %d  %d\r\n 1\r\n%s\r\n", *ends, "body")
    return body.select(F.col("fleet").alias("file"), head.alias("text"))


@query("matrix_files_parsed", f"WITH {CELLS_SQL} SELECT fleet AS file, year, age, v AS value FROM cells")
def matrix_files_parsed(spark, sf):
    return text.parse_matrix(matrix_files(spark, sf))


@query("series_files_parsed", f"WITH {HAUL_SQL} SELECT fleet AS file, year, sum(catch) AS value FROM haul GROUP BY ALL")
def series_files_parsed(spark, sf):
    per = hauls(spark, sf).groupBy("fleet", "year").agg(F.sum("catch").alias("v"))
    ends = per.groupBy("fleet").agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    body = joined(per.withColumn("v", F.concat_ws("  #", F.col("v").cast("string"), F.col("year").cast("string"))),
                  ["fleet"], ["year"], F.col("v"), "\r\n   ", "body").join(ends, "fleet")
    files = body.select(F.col("fleet").alias("file"), F.format_string(
        "Landings(tonnes)\r\n 1 1\r\n %d %d\r\n 5 21\r\n 5\r\n   %s", "y0", "y1", "body").alias("text"))
    return text.parse_series(files)


@query("survey_files_parsed", f"""WITH {CELLS_SQL} SELECT 'index' AS file, fleet, year, CASE WHEN fleet <> 'ASIA' THEN age END AS age,
  CASE WHEN fleet = 'ASIA' THEN 0.0 ELSE 0.6 END::DOUBLE AS t0, CASE WHEN fleet = 'ASIA' THEN 1.0 ELSE 0.7 END::DOUBLE AS t1,
  0.5::DOUBLE AS effort, v AS value FROM cells WHERE CASE WHEN fleet = 'ASIA' THEN age = 5 ELSE age BETWEEN 5 AND 12 END""")
def survey_files_parsed(spark, sf):
    c = cells(spark, sf)
    biomass = F.col("fleet") == "ASIA"
    c = c.where((biomass & (F.col("age") == 5)) | (~biomass & F.col("age").between(5, 12)))
    lines = joined(c, ["fleet", "y0", "y1", "year"], ["age"], coded("v"), "\t\t", "line")
    blocks = joined(lines.withColumn("line", F.concat(F.lit("  0.5   "), F.col("line"))), ["fleet", "y0", "y1"], ["year"], F.col("line"), "\n", "body")
    layout = F.when(biomass, "1 1 0 1\n -1 -1\n").otherwise("1 1 0.6 0.7\n 5 12\n")
    blocks = blocks.withColumn("block", F.concat("fleet", F.format_string("\n %d %d\n ", "y0", "y1"), layout, "body"))
    files = joined(blocks.withColumn("file", F.lit("index")), ["file"], ["fleet"], F.col("block"), "\n", "body")
    return text.parse_survey(files.select("file", F.concat(F.lit("Index files\n   105\n"), F.col("body")).alias("text")))


def report_files(spark, sf) -> DataFrame:
    """One two-table report per fleet: catch by country and year, and numbers at age by year."""
    s = sampling(spark, sf)
    t1 = s.groupBy("fleet", "country", "year").agg(F.sum("caton").alias("v"))
    t2 = s.groupBy("fleet", "year", F.col("ageorlength").alias("age")).agg(F.sum("canum").alias("v"))
    one = joined(t1, ["fleet"], ["country", "year"], F.concat_ws("\t", F.lit("aru"), "country", "year", "v"), "\n", "one")
    two = joined(t2, ["fleet"], ["year", "age"], F.concat_ws("\t", F.lit("aru"), "year", "age", "v"), "\n", "two")
    head = "\n\n\nStock\tCountry\n\n\n\n"
    return one.join(two, "fleet").select(F.col("fleet").alias("file"), F.concat(
        F.lit("REPORT\n\nTABLE 1." + head), F.col("one"), F.lit("\n\n\nTABLE 2." + head), F.col("two"), F.lit("\n")).alias("text"))


def report_tables(spark, sf):
    return text.parse_sections(report_files(spark, sf), {"catch": r"^TABLE 1\.", "sample": r"^TABLE 2\."},
                               {"catch": ["stock", "country", "year", "caton"], "sample": ["stock", "year", "age", "canum"]})


@query("report_catch_section", f"""WITH {SAMPLING_SQL} SELECT fleet AS file, 'aru' AS stock, country, CAST(year AS VARCHAR) AS year, sum(caton) AS caton
FROM samples GROUP BY ALL""")
def report_catch_section(spark, sf):
    return report_tables(spark, sf)["catch"].withColumn("caton", F.col("caton").try_cast("double"))


@query("report_sample_section", f"""WITH {SAMPLING_SQL} SELECT fleet AS file, 'aru' AS stock, CAST(year AS VARCHAR) AS year,
  CAST(ageorlength AS VARCHAR) AS age, sum(canum) AS canum FROM samples GROUP BY ALL""")
def report_sample_section(spark, sf):
    return report_tables(spark, sf)["sample"].withColumn("canum", F.col("canum").try_cast("double"))


@query("long_report_by_lines", f"""WITH {HAUL_SQL} SELECT n_name AS section, count(*) AS n, sum(l_quantity) AS catch, min(l_orderkey) AS lowest, max(l_orderkey) AS highest
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey < 5 GROUP BY 1""")
def long_report_by_lines(spark, sf):
    """Reports with a title, notes and a line per haul, written by Spark and cut by their titles line by line."""
    nations = table(spark, sf, "nation").where("n_nationkey < 5")
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        nations, F.col("s_nationkey") == F.col("n_nationkey"))
    report = nations.select(F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("part"), "n_name")
    head = report.select("k", "part", F.posexplode(F.array(
        F.concat(F.lit("TABLE "), "n_name"), F.lit("a note"), F.lit("key\tcatch"))).alias("j", "value")).withColumn("j", F.col("j") - 4)
    body = rows.select(F.col("n_nationkey").alias("k"), F.pmod("l_orderkey", F.lit(8)).cast("int").alias("part"), F.lit(0).alias("j"),
                       F.concat_ws("\t", "l_orderkey", "l_quantity").alias("value"))
    tail = report.select("k", "part", F.lit(1).alias("j"), F.lit("end of table").alias("value"))
    folder = scratch_path(spark, "report")
    lines = head.unionByName(body).unionByName(tail).repartition("k", "part").sortWithinPartitions("k", "part", "j")
    lines.select("k", "part", "value").write.partitionBy("k", "part").text(folder)
    names = [r[0] for r in nations.select("n_name").collect()]  # five titles
    found = text.section_lines(text.read_lines(spark, folder), {n: f"^TABLE {n}$" for n in names}, offset=3, range_lines=500)
    cut = F.split("line", "\t")
    return found.groupBy("section").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cut[1].cast("double")).alias("catch"), F.min(cut[0].cast("long")).alias("lowest"),
        F.max(cut[0].cast("long")).alias("highest"))


@query("files_by_pattern", """SELECT 'supplier' AS source, count(*) AS n, min(s_suppkey) AS lowest, max(s_suppkey) AS highest FROM supplier""")
def files_by_pattern(spark, sf):
    """Parquet files found by a pattern, with the file that each row came from."""
    rows = text.read_many(spark, sf, "supplier.parquet", "s_suppkey long, s_nationkey long", kind="parquet")
    source = F.regexp_extract("file", r"([^/]+)\.parquet$", 1).alias("source")
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("lowest"), F.max("s_suppkey").alias("highest"))


@query("table_loaded", "SELECT r_regionkey, r_name FROM region")
def table_loaded(spark, sf):
    return load_table(spark, f"{sf}/region.parquet").select("r_regionkey", "r_name")


SUPPLIER_CSV = "s_suppkey long, s_acctbal double"


def supplier_files(spark, sf, folder: str, regions: Column | None = None) -> None:
    """Suppliers as delimited files with headers, in one folder per nation."""
    rows = table(spark, sf, "supplier").where(F.lit(True) if regions is None else regions)
    rows.select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation")).repartition("nation").write.partitionBy(
        "nation").options(header=True, sep=";").mode("append").csv(folder)


def nation_of_file() -> Column:
    return F.regexp_extract("file", r"nation=([0-9]+)/", 1).cast("int").alias("nation")


@query("delimited_files_in_folders", "SELECT s_nationkey AS nation, count(*) AS n, sum(s_acctbal) AS balance FROM supplier GROUP BY ALL", digits={"balance": 4})
def delimited_files_in_folders(spark, sf):
    """Many delimited files in folders, among others that the pattern leaves out."""
    folder = scratch_path(spark, "suppliers")
    supplier_files(spark, sf, folder)
    write_result(table(spark, sf, "nation"), f"{folder}/nations", "parquet")
    rows = text.read_many(spark, folder, "part-*.csv", SUPPLIER_CSV, sep=";")
    return rows.groupBy(nation_of_file()).agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("balance"))


@query("files_without_match", "SELECT NULL::BIGINT AS s_suppkey, NULL::DOUBLE AS s_acctbal WHERE false")
def files_without_match(spark, sf):
    folder = scratch_path(spark, "suppliers")
    supplier_files(spark, sf, folder)
    return text.read_many(spark, folder, "catch*.csv", SUPPLIER_CSV, sep=";").drop("file")


@query("files_that_arrive_later", "SELECT s_nationkey AS nation, count(*) AS n, sum(s_acctbal) AS balance FROM supplier GROUP BY ALL", digits={"balance": 4})
def files_that_arrive_later(spark, sf):
    """Files come in twice; each run reads the new ones, and a run without new files adds nothing."""
    folder, store, log = (scratch_path(spark, n) for n in ("arrivals", "store", "log"))
    for some in (F.col("s_nationkey") < 10, F.col("s_nationkey") >= 10, F.lit(False)):
        supplier_files(spark, sf, folder, some)
        rows = absorb_new_files(spark, folder, "part-*.csv", SUPPLIER_CSV, store, log, sep=";", files_per_batch=20)
    return rows.groupBy(nation_of_file()).agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("balance"))


@query("saved_runs_reloaded", f"""WITH {HAUL_SQL} SELECT CAST(year AS VARCHAR) AS run_id, fleet, sum(catch) * CASE WHEN year = 1998 THEN 2 ELSE 1 END AS catch
FROM haul WHERE year BETWEEN 1996 AND 1999 GROUP BY year, fleet""")
def saved_runs_reloaded(spark, sf):
    """Runs saved one after the other into one store; one of them is saved again with other figures."""
    store = scratch_path(spark, "runs")
    per = hauls(spark, sf).groupBy(F.col("year").cast("string").alias("run_id"), "fleet").agg(F.sum("catch").alias("catch"))
    for run, k in (("1998", 1), ("1996", 1), ("1999", 1), ("1998", 2), ("1997", 1)):
        save_table(per.where(F.col("run_id") == run).withColumn("catch", F.col("catch") * k), store)
    return load_table(spark, store, per.schema).select("run_id", "fleet", "catch")


@query("results_written_and_reread", f"""WITH {HAUL_SQL}, r AS (SELECT fleet, year, sum(catch) AS catch, CASE WHEN year > 1996 THEN 'x;' || fleet END AS note FROM haul GROUP BY fleet, year)
SELECT *, 'csv' AS kind FROM r UNION ALL SELECT *, 'parquet' FROM r""")
def results_written_and_reread(spark, sf):
    """A result table as CSV and as Parquet, each read back as it was."""
    per = hauls(spark, sf).groupBy("fleet", "year").agg(F.sum("catch").alias("catch")).withColumn(
        "note", F.when(F.col("year") > 1996, F.concat(F.lit("x;"), "fleet")))
    csv, parquet = scratch_path(spark, "result"), scratch_path(spark, "result")
    write_csv(per, csv)
    write_result(per, parquet, "parquet")
    return text.read_delimited(spark, csv, per.schema, ",").withColumn("kind", F.lit("csv")).unionByName(
        load_table(spark, parquet).withColumn("kind", F.lit("parquet")))
