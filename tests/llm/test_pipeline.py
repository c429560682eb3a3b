"""The registered queries and the pipeline on the smallest tables, stage by stage against brute force."""

import re

import duckdb
import numpy as np
import pytest
from test_dedup import digest_of, groups_by_brute_force
from test_text_models import plain_edit_distance
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from tidewater.llm import packing, toxicity, tokens
from tidewater.llm.common import written

SF = "/root/testdata/sf0.001"
NAMES = ["op1_chat_formatting", "op2_language", "op3_exact_dedup", "op4_toxicity", "op5_simhash", "op6_url_filter", "op7_token_counts",
         "op8_decontamination", "op9_packing", "op10_repeats", "pipeline"]


def test_all_are_registered():
    assert set(NAMES) <= set(entry_points.queries()) and [s[0] for s in corpus_pipeline.STAGES][-1] == "packing"


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op3_exact_dedup", "op10_repeats"])
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_points.queries()[name](spark, SF)
    cur = con.execute(entry_points.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(cur.fetchall())


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], SF), "stage"))
    return docs


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(d.columns == stages[0].columns and d.schema == stages[0].schema for d in stages[1:-1])


def test_toxic_documents_go(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    model = toxicity.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out()))
    bad = {r.doc_id for r in toxicity.score(stages[0], model).collect() if r.score >= 0.3}
    assert bad and set(after) == set(before) - bad


def test_one_of_equal_texts_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    best = {}
    for i, t in before.items():
        best.setdefault(digest_of(t), []).append((-len(t or ""), i))
    assert set(after) == {min(g)[1] for g in best.values()}


def test_one_of_near_copies_stays(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(after) == {c for _, _, c in groups_by_brute_force(sorted(before.items()), 4, 4)}


def test_contaminated_documents_go(stages):
    clean = lambda t: re.sub(r"[^0-9a-z\x80-￿]+", " ", t.lower()).strip()
    items = [clean(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' WHERE text IS NOT NULL").fetchall()]
    before, after = texts(stages[3]), texts(stages[4])
    gone = set(before) - set(after)
    held = {i for i, t in before.items() if any(x in clean(t or "") for x in items)}
    assert held <= gone
    for i in gone - held:  # the others hold an item with edits
        assert min(plain_edit_distance(x, clean(before[i])) / len(x) for x in items) <= 0.2


def test_every_id_is_packed(stages):
    whole = Tokenizer.from_file(tokens.public_path("word_bpe_49k.json"))
    rows = {}
    for r in stages[5].collect():
        rows.setdefault(r.doc_id, []).append((r.start, r.length))
    want = texts(stages[4])
    assert set(rows) == set(want)
    for i, t in want.items():
        lengths = packing.binary_lengths(len(whole.encode(t or "", add_special_tokens=False).ids) + 1, 4096)
        assert sorted(rows[i]) == list(zip(np.cumsum([0, *lengths[:-1]]).tolist(), lengths, strict=True))


def test_run_gives_the_last_stage(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(key).collect())) == sorted(map(tuple, stages[5].select(key).collect()))
