"""Text layouts of the input files.

Readers come in two steps: Spark reads the files, then a ``parse_*`` function works on
a table with ``file`` and ``text`` (or ``line``) columns, so the same parsing runs on
text that comes from anywhere. Whole-file reading is used only for the matrix and
series layouts, whose size is bounded by years and ages. Reports and index files may
be of any length: they are read line by line, numbered in ranges, and the last title
or block header is carried forward from range to range. Delimited tables are read line
by line and split as usual.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from tidewater.session import scratch_path

#: Lines that one task numbers and tags together.
RANGE_LINES = 50_000
# Fixed value: code for a missing number in the matrix and index files.
MISSING = -1.0


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, sep: str = "\t",
                   skip: int = 0) -> DataFrame:
    """Delimited text with a header line, after ``skip`` leading lines; short rows are padded with NULL."""
    if skip == 0:
        return spark.read.csv(path, schema=schema, sep=sep, header=True, mode="PERMISSIVE", enforceSchema=True)
    return parse_delimited(_drop_leading(spark.read.text(path), skip + 1), schema, sep)


def _drop_leading(lines: DataFrame, n: int) -> DataFrame:
    """Drop the first ``n`` lines of every file, without reading any file in one piece.

    Only the block at offset 0 holds leading lines, and its rows are numbered in file
    order, so a line's place is its number less the smallest one of that block.
    """
    placed = lines.select(
        "value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"),
        F.monotonically_increasing_id().alias("__m"))
    first = placed.groupBy("__f").agg(F.min(F.when(F.col("__b") == 0, F.col("__m"))).alias("__first"))
    leading = (F.col("__b") == 0) & (F.col("__m") - F.col("__first") < n)
    return placed.join(first, "__f").where(~leading).select("value")


def parse_delimited(lines: DataFrame, schema: StructType | str, sep: str = "\t", col: str = "value") -> DataFrame:
    """Delimited lines -> typed columns; other columns of ``lines`` are kept."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    parsed = F.from_csv(F.col(col), ddl, {"sep": sep, "mode": "PERMISSIVE"})
    return lines.withColumn("__r", parsed).select(*[c for c in lines.columns if c != col], "__r.*")


def read_many(spark: SparkSession, folder: str, pattern: str, schema: StructType | str, sep: str = ",",
              recursive: bool = True, kind: str = "csv") -> DataFrame:
    """All files of a folder that match a pattern, stacked, with the file each row came from; delimited text or Parquet."""
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": recursive}
    if kind == "csv":
        options |= {"sep": sep, "header": True}
    out = spark.read.format(kind).schema(schema).options(**options).load(folder)
    return out.select("*", F.col("_metadata.file_path").alias("file"))


def read_text_typed(spark: SparkSession, path: str | Sequence[str], casts: Mapping[str, str], sep: str = ",") -> DataFrame:
    """Every column as text, then chosen casts; a value that does not parse becomes NULL."""
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    return raw.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()})


def read_whole(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per small file: ``file, text``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"),
                                                         F.col("value").alias("text"))


def numbered_lines(files: DataFrame) -> DataFrame:
    """``file, line_no, line`` with line numbers from 1."""
    lines = F.split(F.col("text"), r"\r?\n")
    return files.select("file", F.posexplode(lines).alias("__p", "line")).select(
        "file", (F.col("__p") + 1).alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of files of any length, ``file, line_no, line`` with line numbers from 1.

    A block of a file is numbered by the task that reads it; the lines of the blocks before it are added.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__b"),
        F.monotonically_increasing_id().alias("__at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    return _dense(read, ["file"], "__b", "__at", "line_no").select("file", "line_no", "line")


def _dense(rows: DataFrame, keys: Sequence[str], part: str, order: str, out: str) -> DataFrame:
    """Number the rows of ``keys`` from 1 in the order of ``part`` and, within a part, of ``order``.

    Parts are bounded and follow one another, so only their sizes are summed up across them.
    """
    held = _written(rows.withColumn("__nr", F.row_number().over(W.partitionBy(*keys, part).orderBy(order))), "lines")
    sizes = held.groupBy(*keys, part).agg(F.max("__nr").alias("__size"))
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, part, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    return held.join(starts, [*keys, part]).withColumn(out, (F.col("__start") + F.col("__nr")).cast("long")).drop("__start", "__nr")


def _written(df: DataFrame, name: str) -> DataFrame:
    """Parquet in the checkpoint folder: what follows reads only the columns it needs, and the input once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carry_forward(lines: DataFrame, mark: Column, out: str = "mark", order: str = "line_no", range_lines: int = RANGE_LINES) -> DataFrame:
    """Beside every line of ``file`` the last line at or before it that has a mark.

    ``mark`` is a text or NULL. Adds ``out`` and ``{out}_no``, the number of the line it stands on. Lines are tagged in
    ranges of ``range_lines`` numbers, then what is open at the end of a range is carried into the next ones.
    """
    tagged = lines.withColumns({"__range": F.floor(F.col(order) / range_lines), "__own": F.when(mark.isNotNull(), F.struct(F.col(order).alias("no"), mark.alias("mark")))})
    upto = W.partitionBy("file", "__range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    held = _written(tagged.withColumn("__own", F.last("__own", ignorenulls=True).over(upto)), "tagged")
    ends = held.groupBy("file", "__range").agg(F.max("__own").alias("__end"))
    earlier = W.partitionBy("file").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    carried = ends.select("file", "__range", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    found = held.join(carried, ["file", "__range"]).withColumn("__own", F.coalesce("__own", "__before"))
    return found.withColumns({out: F.col("__own.mark"), f"{out}_no": F.col("__own.no")}).drop("__own", "__before", "__range")


def _tokens(line: Column) -> Column:
    """Numbers of a line, the ``#`` tail and repeated blanks or tabs removed."""
    return F.filter(F.split(F.trim(F.regexp_replace(line, r"#.*$", "")), r"[\s,]+"), lambda t: t != "")


def _number(tokens: Column, place: int) -> Column:
    return F.get(tokens, F.lit(place)).try_cast("double")


def _value(token: Column) -> Column:
    v = token.try_cast("double")
    return F.when(v != MISSING, v)


def parse_matrix(files: DataFrame) -> DataFrame:
    """Year-by-age matrix files -> ``file, year, age, value``.

    Layout: title, codes, first and last year, first and last age, flag, then one line
    of numbers per year. The missing code stays out as NULL.
    """
    lines = F.split(F.col("text"), r"\r?\n")
    years, ages = _tokens(F.get(lines, F.lit(2))), _tokens(F.get(lines, F.lit(3)))
    head = files.select(
        "file", _number(years, 0).cast("int").alias("y0"), _number(years, 1).cast("int").alias("y1"),
        _number(ages, 0).cast("int").alias("a0"), F.posexplode(F.slice(lines, F.lit(6), F.size(lines))).alias("i", "line"))
    cells = head.where(F.col("y0") + F.col("i") <= F.col("y1")).select(
        "file", (F.col("y0") + F.col("i")).alias("year"), "a0", F.posexplode(_tokens(F.col("line"))).alias("j", "t"))
    return cells.select("file", "year", (F.col("a0") + F.col("j")).alias("age"), _value(F.col("t")).alias("value"))


def parse_series(files: DataFrame) -> DataFrame:
    """One value per year, same header as the matrix files -> ``file, year, value``."""
    cells = parse_matrix(files)
    first = F.min("age").over(W.partitionBy("file"))  # a file holds one value per year
    return cells.withColumn("__a", first).where(F.col("age") == F.col("__a")).select("file", "year", "value")


def parse_survey(files: DataFrame) -> DataFrame:
    """Index files with several survey blocks, one row per file -> as :func:`parse_survey_lines`."""
    return parse_survey_lines(numbered_lines(files))


def parse_survey_lines(lines: DataFrame, range_lines: int = RANGE_LINES) -> DataFrame:
    """Numbered lines of index files with survey blocks -> ``file, fleet, year, age, t0, t1, effort, value``.

    The first two lines that are not blank are a title. A block is: name; first and last year; four timing numbers; first
    and last age (or ``-1 -1`` for a biomass index, age NULL); one line per year with effort and values. Files and blocks
    may be of any length.
    """
    filled = lines.where(F.trim("line") != "").withColumn("__part", F.floor(F.col("line_no") / range_lines))
    body = _dense(filled, ["file"], "__part", "line_no", "no").where(F.col("no") > 2).select("file", "no", "line")
    # A block starts at a line that does not open with a number.
    named = ~F.regexp_like(F.trim("line"), F.lit(r"^-?[0-9.]+([\s,]|$)"))
    tagged = carry_forward(body, F.when(named, F.trim("line")), "fleet", "no", range_lines).where(F.col("fleet").isNotNull())
    tagged = tagged.withColumns({"k": F.col("no") - F.col("fleet_no") + 1, "tok": _tokens(F.col("line"))})
    heads = tagged.where(F.col("k").between(2, 4)).groupBy("file", "fleet_no").agg(
        F.max(F.when(F.col("k") == 2, _number(F.col("tok"), 0))).cast("int").alias("y0"),
        F.max(F.when(F.col("k") == 2, _number(F.col("tok"), 1))).cast("int").alias("y1"),
        F.max(F.when(F.col("k") == 3, _number(F.col("tok"), 2))).alias("t0"),
        F.max(F.when(F.col("k") == 3, _number(F.col("tok"), 3))).alias("t1"),
        F.max(F.when(F.col("k") == 4, _number(F.col("tok"), 0))).cast("int").alias("a0"))
    rows = tagged.where(F.col("k") > 4).join(heads, ["file", "fleet_no"])
    rows = rows.withColumns({"year": (F.col("y0") + F.col("k") - 5).cast("int"), "effort": _number(F.col("tok"), 0)})
    cells = rows.where(F.col("year") <= F.col("y1")).select(
        "file", "fleet", "year", "a0", "t0", "t1", "effort", F.posexplode(F.slice("tok", F.lit(2), F.size("tok"))).alias("j", "t"))
    return cells.select("file", "fleet", "year", F.when(F.col("a0") >= 0, F.col("a0") + F.col("j")).alias("age"),
                        "t0", "t1", "effort", _value(F.col("t")).alias("value"))


def section_lines(lines: DataFrame, markers: Mapping[str, str], offset: int = 7, range_lines: int = RANGE_LINES) -> DataFrame:
    """The data lines of all tables of text reports of any length: ``file, section, line_no, line``.

    ``markers`` gives the regular expression of each table's title line; of several that match the first counts, and
    of several titles of a table the first in the file. Data start ``offset`` lines below the title and run to the first
    line without a tab, or to the next title. The lines are read once for all tables.
    """
    title = F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in markers.items()])
    tagged = carry_forward(lines, title, "section", range_lines=range_lines)
    below = tagged.where(F.col("line_no") >= F.col("section_no") + offset)
    own = ["file", "section_no"]
    firsts = tagged.where(F.col("line_no") == F.col("section_no")).groupBy("file", "section").agg(F.min("section_no").alias("section_no"))
    stops = below.where(~F.col("line").contains("\t")).groupBy(*own).agg(F.min("line_no").alias("stop"))
    scope = firsts.join(stops, own, "left").select(*own, "stop")  # a row per table
    return below.join(scope, own).where(F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))).select("file", "section", "line_no", "line")


def parse_sections(files: DataFrame, markers: Mapping[str, str], columns: Mapping[str, Sequence[str]],
                   offset: int = 7) -> dict[str, DataFrame]:
    """Cut text reports, one row per file or numbered lines, into their tables (:func:`section_lines`), split at tabs."""
    lines = files if "line" in files.columns else numbered_lines(files)
    found, parts = section_lines(lines, markers, offset), F.split("line", "\t")
    return {name: found.where(F.col("section") == name).select("file", *[
        F.trim(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(columns[name])]) for name in markers}
