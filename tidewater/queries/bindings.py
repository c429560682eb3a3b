"""The logical fishery tables, bound to the generated tables, with the same bindings in SQL.

nation and region hold 25 and 5 rows at every scale and are broadcast. supplier and part
grow with the data and are left to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewater.functions.dates import week_of_year


# Given schemas: no job has to open the files to find the columns.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def since(date: Column, first_year: int, last_year: int | None = None) -> Column:
    """Date range of whole years, written so that the scan can skip row groups."""
    cond = date >= F.lit(f"{first_year}-01-01").cast("timestamp_ntz")
    return cond if last_year is None else cond & (date < F.lit(f"{last_year + 1}-01-01").cast("timestamp_ntz"))


def vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessel, its rectangle and its fleet."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("vesselid"), F.col("n_name").alias("rect"), F.col("r_name").alias("fleet"))


def hauls(spark: SparkSession, sf_dir: str, species: bool = False, status: str | None = None,
          first_year: int | None = None) -> DataFrame:
    """One haul per line item; ``status`` picks the lines of one source."""
    li = table(spark, sf_dir, "lineitem")
    if status is not None:
        li = li.where(F.col("l_linestatus") == status)
    if first_year is not None:
        li = li.where(since(F.col("l_shipdate"), first_year))
    date = F.col("l_shipdate").cast("date")
    df = li.select(
        F.col("l_suppkey").alias("vesselid"), F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("haul"),
        date.alias("date"), F.year(date).alias("year"), F.month(date).alias("month"), week_of_year(date).alias("week"),
        F.dayofmonth(date).alias("day"), F.dayofyear(date).alias("yday"),
        F.when(F.col("l_tax") != 0, F.floor(F.col("l_extendedprice") / 40).cast("double")).alias("depth"), F.col("l_quantity").alias("catch"),
        F.col("l_linenumber").cast("double").alias("duration"),
        F.try_make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date),
                                 F.pmod("l_orderkey", F.lit(24)).cast("int"), F.pmod("l_partkey", F.lit(60)).cast("int"),
                                 F.lit(0)).alias("shoot_time"),
        *([F.col("l_partkey")] if species else []))
    df = df.join(vessels(spark, sf_dir), "vesselid")
    if species:
        part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("species"))
        df = df.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
    return df


HAUL_SQL = """haul AS (
  SELECT l_suppkey AS vesselid, l_orderkey AS trip, l_linenumber AS haul, CAST(l_shipdate AS DATE) AS date,
         CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
         CAST((dayofyear(l_shipdate) - 1) // 7 + 1 AS INTEGER) AS week, CAST(day(l_shipdate) AS INTEGER) AS day,
         CAST(dayofyear(l_shipdate) AS INTEGER) AS yday,
         CASE WHEN l_tax <> 0 THEN floor(l_extendedprice / 40) END AS depth, l_quantity AS catch,
         CAST(l_linenumber AS DOUBLE) AS duration, CAST(l_orderkey % 24 AS INTEGER) AS hset,
         n_name AS rect, r_name AS fleet, p_type AS species
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangle mid-points, one row each (25 rows)."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("rect"), (F.col("n_nationkey") - 18).cast("double").alias("long"),
        (F.lit(54.0) + 0.5 * F.col("n_nationkey")).alias("lat"))


RECT_SQL = """rect AS (SELECT n_name AS rect, CAST(n_nationkey - 18 AS DOUBLE) AS long,
  54.0::DOUBLE + 0.5::DOUBLE * n_nationkey AS lat FROM nation)"""

# Class labels in SQL, for the shared depth and set-hour edges.
DEPTH_CAT_SQL = """CASE WHEN {x} >= 0 AND {x} < 200 THEN '[0,200)' WHEN {x} >= 200 AND {x} < 300 THEN '[200,300)'
  WHEN {x} >= 300 AND {x} < 400 THEN '[300,400)' WHEN {x} >= 400 AND {x} < 500 THEN '[400,500)'
  WHEN {x} >= 500 AND {x} < 600 THEN '[500,600)' WHEN {x} >= 600 AND {x} < 700 THEN '[600,700)'
  WHEN {x} >= 700 AND {x} < 2500 THEN '[700,2.5e+03)' END"""
HSET_CAT_SQL = """CASE WHEN {x} BETWEEN 0 AND 2 THEN '[0,2]'
  WHEN {x} > 2 AND {x} <= 24 THEN '(' || CAST(((CAST({x} AS INTEGER) + 1) // 2) * 2 - 2 AS VARCHAR) || ',' ||
       CAST(((CAST({x} AS INTEGER) + 1) // 2) * 2 AS VARCHAR) || ']' END"""

def round_steps_sql(lo: str, hi: str, n: int) -> str:
    """One row (unit, k0, k1): a step of 1, 2 or 5 times a power of ten near the nth part of a range, and the first and last edge in steps."""
    return f"""SELECT unit, floor({lo} / unit + 1e-7)::BIGINT AS k0, ceil({hi} / unit - 1e-7)::BIGINT AS k1 FROM (
  SELECT CASE WHEN raw > 7 * base THEN 10 * base WHEN raw > 2.8 * base THEN 5 * base WHEN raw > 1.4 * base THEN 2 * base ELSE base END AS unit
  FROM (SELECT ({hi} - {lo}) / {n} AS raw, 10.0::DOUBLE ** floor(log10(({hi} - {lo}) / {n})) AS base))"""


def edge_sql(x: str) -> str:
    """An edge as text: whole numbers without a decimal point."""
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


# The years of the generated data; the reports' own default starts later.
FIRST, LAST = 1996, 2000
SCOPE = {"first_year": FIRST}
SCOPE_SQL = f"long > -18 AND long < 5 AND week BETWEEN 15 AND 34 AND year >= {FIRST} AND depth IS NOT NULL"

SCOPED_SQL = f"""{HAUL_SQL}, {RECT_SQL},
scoped AS (SELECT h.*, long, lat, {DEPTH_CAT_SQL.format(x='depth')} AS depth_cat, {HSET_CAT_SQL.format(x='hset')} AS hset_cat
  FROM haul h LEFT JOIN rect USING (rect) WHERE {SCOPE_SQL})"""

BYDAY_SQL = f"""{SCOPED_SQL},
vessel AS (SELECT fleet, vesselid, year, week, rect, sum(catch) AS catch, sum(duration) AS duration, count(*) AS nhauls,
  count(DISTINCT date) AS ndays, avg(depth) AS depth FROM scoped GROUP BY ALL),
byday0 AS (SELECT fleet, year, week, rect, sum(catch) AS catch, sum(duration) AS duration,
  CAST(sum(nhauls) AS BIGINT) AS nhauls, CAST(sum(ndays) AS BIGINT) AS ndays, avg(depth) AS depth FROM vessel GROUP BY ALL),
byday AS (SELECT *, catch / ndays AS cpue_day, {DEPTH_CAT_SQL.format(x='depth')} AS depth_cat FROM byday0)"""

STRATA_SQL = f"""{SCOPED_SQL},
strata0 AS (SELECT year, month, week, depth_cat, lat, long, hset_cat, fleet, sum(catch) AS catch, count(*) AS nhauls,
  count(DISTINCT vesselid) AS nvessels, sum(duration) AS duration, count(DISTINCT day) AS ndays
  FROM scoped WHERE duration < 12 GROUP BY ALL),
strata AS (SELECT *, ndays AS effort, catch / ndays AS cpue FROM strata0)"""


def scoped_hauls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.plans.hauls import prepare_hauls

    return prepare_hauls([hauls(spark, sf_dir, first_year=FIRST)], rects(spark, sf_dir), **SCOPE)


def byday(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.plans.cpue import cpue_by_day

    return cpue_by_day(scoped_hauls(spark, sf_dir))


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.operators.filters import quality_filter
    from tidewater.plans.cpue import cpue_by_stratum

    return cpue_by_stratum(quality_filter(scoped_hauls(spark, sf_dir)))
