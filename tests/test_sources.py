import os

import pytest
from pyspark.sql import functions as F

from conftest import values
from tidewater.sources import tables, text
from tidewater.sources.arrivals import absorb_new_files

MATRIX = """Catch in numbers   1/1/2021
    1       2
  2000     2002
    5       7
    1
       12      76     222  #2000
       -1     267\t\t593   #2001
      306    1205    1358  #2002
"""

SURVEY = """Some stock
     102
Summer    survey
    1999      2000
       1         1       0.6     0.7
       5        7
     0.2     4.317   \t 2.435   1.336
     0.2     -1     2.281   1.446
Deep cpue
    2005      2006
       1         1         0       1
      -1        -1
       1      15.5
       1        -1"""


def write(path, name, body):
    p = os.path.join(str(path), name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", newline="") as f:
        f.write(body)
    return p


def test_delimited_with_leading_lines_and_short_rows(spark, tmp_path):
    for i in range(3):
        write(tmp_path, f"f{i}.txt", "title\nsecond\na\tb\tc\n" + "".join(f"{i}\t{j}\n" for j in range(5)) + f"{i}\t9\t7.5\n")
    df = text.read_delimited(spark, f"{tmp_path}/*.txt", "a int, b int, c double", "\t", skip=2)
    assert df.count() == 18
    assert values(df.where("b = 9")) == [(0, 9, 7.5), (1, 9, 7.5), (2, 9, 7.5)]
    assert df.where("b < 9 and c is not null").count() == 0


def test_leading_lines_are_dropped_from_split_files(spark, tmp_path):
    write(tmp_path, "big.txt", "title\na;b\n" + "".join(f"{j};{j * 2}\n" for j in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = text.read_delimited(spark, str(tmp_path), "a int, b int", ";", skip=1)
        assert df.agg(F.count("a"), F.min("a"), F.sum("b")).first()[:] == (5000, 0, sum(2 * j for j in range(5000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_delimited_without_leading_lines(spark, tmp_path):
    p = write(tmp_path, "x.csv", "year;GER_NLD\n2005;12.5\n2006;x\n")
    assert values(text.read_delimited(spark, p, "year int, total double", ";")) == [(2005, 12.5), (2006, None)]


def test_many_files_by_pattern_and_folder(spark, tmp_path):
    write(tmp_path, "a/CatchArea 1.csv", "stock,year\nx,1\n")
    write(tmp_path, "b/c/CatchArea 2.csv", "stock,year\ny,2\n")
    write(tmp_path, "b/other.csv", "stock,year\nz,3\n")
    df = text.read_many(spark, str(tmp_path), "CatchArea*.csv", "stock string, year int")
    assert values(df, "stock", "year") == [("x", 1), ("y", 2)]
    assert df.select("file").distinct().count() == 2


def test_text_first_then_casts(spark, tmp_path):
    p = write(tmp_path, "x.csv", "Year,catch\n2005,1.5\nn.a.,2\n")
    df = text.read_text_typed(spark, p, {"Year": "int", "catch": "double"})
    assert values(df) == [(None, 2.0), (2005, 1.5)]


def test_matrix_and_series_files(spark, tmp_path):
    write(tmp_path, "m/cn.dat", MATRIX.replace("\n", "\r\n"))
    df = text.parse_matrix(text.read_whole(spark, f"{tmp_path}/m"))
    assert df.count() == 9
    assert values(df.where("year = 2001"), "age", "value") == [(5, None), (6, 267.0), (7, 593.0)]
    body = "Landings\n 1 1\n 2000 2001\n 5 21\n 5\n   17224  #2000\n   15130  #2001\n"
    write(tmp_path, "s/ct.dat", body)
    assert values(text.parse_series(text.read_whole(spark, f"{tmp_path}/s")), "year", "value") == [(2000, 17224.0), (2001, 15130.0)]


def test_survey_file_blocks(spark, tmp_path):
    p = write(tmp_path, "survey.dat", SURVEY)
    df = text.parse_survey(text.read_whole(spark, p))
    got = values(df, "fleet", "year", "age", "value")
    assert (("Summer    survey", 1999, 5, 4.317) in got) and (("Summer    survey", 2000, 5, None) in got)
    assert (("Deep cpue", 2005, None, 15.5) in got) and (("Deep cpue", 2006, None, None) in got)
    assert len(got) == 8
    assert values(df.where("fleet = 'Deep cpue'"), "t0", "t1", "effort")[0] == (0.0, 1.0, 1.0)


def test_report_sections(spark, tmp_path):
    head = "\n" * 3 + "names\n" + "\n" * 3
    body = "head\nTABLE 1. catch" + head + "aru\tFO\t10\naru\tNL\t20\n\n\nTABLE 2. samples" + head + "aru\t5\t1.5\n"
    p = write(tmp_path, "r.txt", body)
    out = text.parse_sections(text.read_whole(spark, p), {"t1": r"^TABLE 1\.", "t2": r"^TABLE 2\."},
                              {"t1": ["stock", "country", "caton"], "t2": ["stock", "age", "canum"]})
    assert values(out["t1"], "country", "caton") == [("FO", "10"), ("NL", "20")]
    assert values(out["t2"], "age", "canum") == [("5", "1.5")]


def test_tables_are_saved_by_run_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1, 2.0), ("r2", 2, None)], "run_id string, year int, v double")
    tables.save_table(df, f"{tmp_path}/t")
    assert sorted(d for d in os.listdir(f"{tmp_path}/t") if d.startswith("run_id")) == ["run_id=r1", "run_id=r2"]
    assert values(tables.load_table(spark, f"{tmp_path}/t"), "run_id", "year", "v") == [("r1", 1, 2.0), ("r2", 2, None)]
    tables.write_result(df, f"{tmp_path}/c")
    assert values(spark.read.csv(f"{tmp_path}/c", header=True), "run_id", "year", "v") == [("r1", "1", "2.0"), ("r2", "2", None)]
    tables.write_result(df, f"{tmp_path}/p", "parquet")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2


def test_a_run_replaces_only_itself(spark, tmp_path):
    def save(*rows):
        tables.save_table(spark.createDataFrame(list(rows), "run_id string, year int, v double"), f"{tmp_path}/t")

    def stored():
        return values(tables.load_table(spark, f"{tmp_path}/t", "run_id string, year int, v double"), "run_id", "year", "v")

    save(("2020", 1, 1.0), ("2020", 2, 2.0))
    save(("2021", 1, 3.0), (None, 1, 9.0))
    assert stored() == [(None, 1, 9.0), ("2020", 1, 1.0), ("2020", 2, 2.0), ("2021", 1, 3.0)]
    save(("2020", 7, 7.0))
    save()  # a save without rows changes nothing
    assert stored() == [(None, 1, 9.0), ("2020", 7, 7.0), ("2021", 1, 3.0)]
    with pytest.raises(Exception):  # a save that fails leaves the runs as they were
        bad = spark.createDataFrame([("2021", 1, 0.0)], "run_id string, year int, v double")
        tables.save_table(bad.withColumn("v", F.raise_error(F.lit("stop")).cast("double")), f"{tmp_path}/t")
    assert stored() == [(None, 1, 9.0), ("2020", 7, 7.0), ("2021", 1, 3.0)]


def test_unknown_kind_of_result(spark, tmp_path):
    with pytest.raises(ValueError, match="xlsx"):
        tables.write_result(spark.range(1), f"{tmp_path}/x", "xlsx")


def test_csv_results_of_awkward_texts(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(1, ""), (2, None), (3, 'a "b", c')], "i int, t string").coalesce(1), f"{tmp_path}/c")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/c").collect())[:2] == ['1,""', "2,"]
    assert values(text.read_delimited(spark, f"{tmp_path}/c", "i int, t string", ",")) == [(1, None), (2, None), (3, 'a "b", c')]


def test_files_are_absorbed_once(spark, tmp_path):
    def absorb():
        return values(absorb_new_files(spark, f"{tmp_path}/in", "catch*.csv", "year int, catch double", f"{tmp_path}/store", f"{tmp_path}/log", files_per_batch=1), "year", "catch")

    os.makedirs(f"{tmp_path}/in")
    assert absorb() == []
    write(tmp_path, "in/catch1.csv", "year,catch\n2001,1.5\n2002,2.5\n")
    write(tmp_path, "in/other.csv", "year,catch\n1900,0\n")
    assert absorb() == [(2001, 1.5), (2002, 2.5)] == absorb()
    write(tmp_path, "in/b/catch2.csv", "year,catch\n2003,3.5\n2001,1.5\n")
    write(tmp_path, "in/c/catch3.csv", "year,catch\n")
    want = [(2001, 1.5), (2001, 1.5), (2002, 2.5), (2003, 3.5)]
    assert absorb() == want
    # The commit of the last batch is lost, as when a job dies behind its write: the batch is done again and adds nothing.
    last = max(int(f) for f in os.listdir(f"{tmp_path}/log/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{tmp_path}/log/commits/{name}")
    assert absorb() == want


def test_long_lines_lose_nothing(spark):
    ages = 10_050
    line = " ".join(["1"] + ["2.5"] * ages)
    survey = f"title\n2\nfleet\n2000 2000\n1 1 0 0.5\n1 {ages}\n{line}\n"
    assert text.parse_survey(spark.createDataFrame([("f", survey)], "file string, text string")).count() == ages
    matrix = f"t\n1 2\n1 {ages}\n1 1\n5\n" + "\n".join(["3"] * ages)
    assert text.parse_matrix(spark.createDataFrame([("f", matrix)], "file string, text string")).count() == ages


@pytest.mark.parametrize("size", [3, 50_000])
def test_lines_are_numbered_across_blocks(spark, tmp_path, size):
    want = [f"line {i}" + "x" * (i % 50) for i in range(1, 2001)]
    write(tmp_path, "f/a.txt", "\r\n".join(want) + "\r\n")
    write(tmp_path, "f/b.txt", "one\n\nthree")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = text.read_lines(spark, f"{tmp_path}/f")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {f: [r.line for r in sorted(lines.where(F.col("file").endswith(f)).collect(), key=lambda r: r.line_no)] for f in ("a.txt", "b.txt")}
    assert got == {"a.txt": want, "b.txt": ["one", "", "three"]}
    mark = F.when(F.col("line").rlike("^line [0-9]*00x*$"), F.substring("line", 1, 9))
    for r in text.carry_forward(lines.where(F.col("file").endswith("a.txt")), mark, range_lines=size).collect():
        assert r.mark_no == (r.line_no // 100 * 100 or None)


@pytest.mark.parametrize("size", [2, 5, 50_000])
def test_blocks_and_sections_do_not_depend_on_the_ranges(spark, size):
    head = "\n".join(["names"] * 7)
    report = f"x\nTABLE 1.{head}\na\t1\nb\t2\nno tab\nc\t3\nTABLE 1.{head}\nz\t9\nTABLE 2.{head}\nd\t4\ne\t5\nTABLE 3.\nf\t6"
    files = spark.createDataFrame([("r", report), ("empty", ""), ("none", "a\tb")], "file string, text string")
    found = text.section_lines(text.numbered_lines(files), {"one": r"^TABLE 1\.", "two": r"^TABLE 2\.", "three": r"^TABLE 3\."}, range_lines=size)
    assert values(found, "file", "section", "line") == [("r", "one", "a\t1"), ("r", "one", "b\t2"), ("r", "two", "d\t4"), ("r", "two", "e\t5")]
    survey = text.numbered_lines(spark.createDataFrame([("s", SURVEY)], "file string, text string"))
    whole = text.parse_survey(spark.createDataFrame([("s", SURVEY)], "file string, text string"))
    assert sorted(text.parse_survey_lines(survey, size).collect(), key=str) == sorted(whole.collect(), key=str) and whole.count() == 8
