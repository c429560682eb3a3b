"""Language, toxicity, decontamination and URL operators on small fixtures."""

import pickle
import random
import re
from itertools import accumulate

import numpy as np
import pytest
from helpers import documents, prose

from tidewater.llm import decontaminate, language, toxicity, urls

SYLLABLES = {"aa": ["ka", "lo", "mi", "ter", "un"], "bb": ["zé", "quo", "rv", "ist", "no"], "cc": ["ß", "auf", "gen", "ich", "lo"]}


def invented(lang, seed, n=40):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def filters(spark):
    rows = [(k, invented(lang, k), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 30)] + [(900, None, "aa"), (901, "text", None)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_of_new_texts(spark, filters):
    rows = [(k, invented(lang, 5000 + k)) for k, lang in enumerate(["aa", "bb", "cc"] * 10)]
    got = language.predict(documents(spark, rows), filters).collect()
    assert all(r.lang_pred == ["aa", "bb", "cc"][r.doc_id % 3] and 0.4 < r.score <= 1 for r in got)


def test_language_of_awkward_texts(spark, filters, monkeypatch):
    monkeypatch.setattr(language, "_PIECE_CHARS", 50)
    rows = [(1, None), (2, ""), (3, "12 ?!"), (4, "漢字"), (None, invented("bb", 1, 3000)), (6, "x"), (6, "x")]
    got = sorted(((r.doc_id or 0), r.lang_pred, r.score) for r in language.predict(documents(spark, rows), filters).collect())
    assert [g[1] for g in got] == ["bb", "und", "und", "und", "cc", "cc", "cc"] and [g[2] for g in got[1:]] == [0.0] * 6
    assert language.predict(documents(spark, []), filters).count() == 0


def test_filters_hold_what_they_were_given(filters):
    h, sizes = language.grams([invented("aa", 3)])
    held = (filters.members(h)[:, 0] & np.uint64(1)).mean()
    assert sizes.tolist() == [len(h)] and held > 0.8 and (filters.rates() < 0.02).all()


def test_grams_stay_within_texts():
    texts = ["abcdef", "", "x", "gh", "ijklm"]
    joined, sizes = language.grams(texts)
    assert joined.tolist() == [x for t in texts for x in language.grams([t])[0].tolist()] and sizes.tolist() == [len(language.grams([t])[0]) for t in texts]


def test_languages_against_counting(spark, filters):
    """Every n-gram of a text is looked up bit by bit; the counts are corrected and compared in plain Python."""
    table = [int(x) for x in filters.table[:, 0]]
    full = 1 << language.ADDRESS
    rate = [(sum(row >> k & 1 for row in table) / full) ** language.PROBES for k in range(3)]
    rows = [(k, invented(lang, 700 + k, 3) + " " + invented(other, 800 + k, 2)) for k, (lang, other) in enumerate([("aa", "bb"), ("bb", "cc"), ("cc", "aa")] * 8)]
    got = {r.doc_id: r for r in language.predict(documents(spark, rows), filters).collect()}
    for i, text in rows:
        counts, padded = [0.0] * 3, f" {text.lower()} "
        for j in range(len(padded) - language.N + 1):
            h = int(language.grams([padded[j : j + language.N]])[0][1])  # between the blanks put around it
            for k in range(3):
                counts[k] += all(table[h >> p * language.ADDRESS & full - 1] >> k & 1 for p in range(language.PROBES))
        n = len(padded) - language.N + 1
        counts = [max(0.0, (c - n * r) / (1 - r)) for c, r in zip(counts, rate, strict=True)]
        assert got[i].lang_pred == ["aa", "bb", "cc"][counts.index(max(counts))]
        assert got[i].score == pytest.approx(max(counts) / sum(counts), rel=1e-9)


def test_samples_stay_bounded_when_rows_repeat(spark):
    rows = [(k, "one text in a third of all rows" if k % 3 else f"text {k}", "aa") for k in range(6000)] + [(7, "again", "aa")] * 3000 + [(None, "none", "aa")] * 3000
    sample = language._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100)
    assert 10 < sample.count() < 200 and sample.columns == ["text", "lang"]


def test_without_known_languages(spark):
    docs = documents(spark, [(1, "text"), (2, None)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, language.fit(docs.where("lang is null"))).collect()}
    assert got == {1: ("und", 0.0), 2: ("und", 0.0)}


def insulted(seed, toxic):
    r = random.Random(seed)
    sentences = [prose(seed * 31 + k, r.randrange(4, 12)) + "." for k in range(r.randrange(3, 12))]
    if toxic:
        for _ in range(r.randrange(1, 3)):
            sentences.insert(r.randrange(len(sentences)), f"you are {r.choice(['vermin', 'vermins', 'verminous', 'dolt', 'dolts'])} and more.")
    return " ".join(sentences)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, insulted(k, k % 5 == 0)) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0), 1) for k in range(400)] + [(None, 1, 1), (5, None, 1), (10, 1, 0)], "doc_id long, toxic int, quality int")
    return toxicity.fit(documents(spark, rows), labels)


def test_toxic_documents_are_told(spark, model):
    rows = [(k, insulted(10_000 + k, k % 2 == 0)) for k in range(100)]
    got = toxicity.score(documents(spark, rows), model).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 2 == 0) for r in got)


def test_offending_sentences_are_found(spark, model):
    text = "The river runs. You are verminous and dull! Geese watch."
    got = toxicity.locate(documents(spark, [(1, text), (2, None), (3, "clean")]), model).collect()
    assert [(r.doc_id, text[r.start : r.stop], r.sentence) for r in got] == [(1, " You are verminous and dull", " You are verminous and dull")]


def test_a_repeated_word_counts_once_in_a_sentence(spark):
    """Fit and score give the same value for a bag: its set of features, however often a word occurs."""
    model = toxicity.Model({"dolt": 1.5, "dol*": 0.7, "gees*": 0.4, "river": -2.0}, -3.0)
    index = {f: i for i, f in enumerate(model.weights)}
    texts = ["geese watch " * 400, "dolt dolts dolt " + "river " * 300, "a dolt. Geese geese! the river river", "geesely\nmuddy", "nothing"]
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    found = {r.doc_id: r.score for r in toxicity.locate(docs, model, 0.0).collect() if r.doc_id < 2}
    for k, text in enumerate(texts):
        empty, bags = toxicity._bags(text, index)
        z = [model.bias] * empty + [model.bias + sum(list(model.weights.values())[i] for i in bag) for bag in bags]
        assert got[k] == pytest.approx(1 - np.prod([1 / (1 + np.exp(x)) for x in z]), abs=1e-12)
        if k in found:
            assert found[k] == pytest.approx(got[k], abs=1e-12)
    assert {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()} == {k for k in got if got[k] < 0.3} and 0 in found


def test_toxicity_of_awkward_texts(spark, model, monkeypatch):
    rows = [(1, None), (2, ""), (3, "\n\n..!"), (None, insulted(1, True)), (5, insulted(7, True)), (5, insulted(7, True)), (6, "x" * 100_000)]
    docs = documents(spark, rows)
    got = toxicity.score(docs, model).collect()
    empty = {round(r.score, 9) for r in got if r.doc_id in (1, 2, 3)}
    assert len(got) == 7 and len(empty) == 1 and 0 <= min(empty) < 0.1 and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6]
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_labels_of_one_kind(spark):
    docs = documents(spark, [(1, "a b"), (2, "c d")])
    same = toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.01 for m in (same, none) for r in toxicity.score(docs, m).collect())


def test_pieces_hold_the_whole_text(monkeypatch):
    monkeypatch.setattr(toxicity, "_PIECE_CHARS", 20)
    for text in ("a b. " * 50, "x" * 333, "", "ab." + "y" * 100 + "\nz"):
        assert "".join(toxicity.pieces(text)) == text


def plain_edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row, last = [i], row
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != t), last[j] + 1, row[-1] + 1))
    return min(row)


def test_edit_distance_by_bits():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(0, n))) for n in (90, 120))
        assert decontaminate.edit_distance(a, b) == plain_edit_distance(a, b)


ITEMS = [(k, prose(700 + k, 12 + k)) for k in range(12)] + [(50, "two words"), (51, None), (52, ""), (53, "?!")]


def held(text, similarity=0.8):
    clean = lambda t: re.sub(r"[^0-9a-z\x80-\uffff]+", " ", t.lower()).strip()
    return {i for i, t in ITEMS if t and clean(t) and plain_edit_distance(clean(t), clean(text)) <= len(clean(t)) * (1 - similarity) + 1e-9}


def test_contaminated_documents(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(k, prose(k, 50) + (" " + ITEMS[k][1].upper().replace(" ", ", ") if k < 12 else "") + " " + prose(900 + k, 50)) for k in range(20)]
    rows += [(30, None), (31, ""), (32, ITEMS[0][1]), (32, ITEMS[0][1]), (None, "two: words"), (34, "two other words"), (35, prose(8, 30_000) + " " + ITEMS[3][1])]
    docs = documents(spark, rows)
    got = decontaminate.contaminated(docs, benchmark).collect()
    want = [(-1 if i is None else i, k) for i, t in rows if len(t or "") < 9000 for k in held(t or "")] + [(35, 3)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got) == sorted(want) and len(want) == 16
    assert all(r.distance == 0 and r.similarity == 1 for r in got)
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [*range(12, 20), 30, 31, 34]
    assert decontaminate.contaminated(documents(spark, []), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("item_id < 0")).count() == 0


def test_benchmark_in_blocks_and_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    docs = documents(spark, [(k, prose(k, 20) + " " + ITEMS[k][1]) for k in range(12)])
    got = decontaminate.contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(12)]


def test_recall_of_edited_items():
    """Against the exact distance to every item: edited passages are found at 0.9 and more, and nothing else is."""
    r = random.Random(5)
    items = [(k, prose(40 + k, r.randrange(15, 50))) for k in range(60)]
    tables = decontaminate.ItemTables(items, 0.8)
    near = found = 0
    for k, (_, text) in enumerate(items):
        for rate in (0.05, 0.1, 0.15):
            words = []
            for w in text.split():
                u = r.random()
                words += [w] if u > rate else [] if u > 0.6 * rate else [f"new{r.randrange(99)}"] if u > 0.3 * rate else [w, "more"]
            doc = f"{prose(k, 30)} {' '.join(words)} {prose(k + 99, 30)}".encode()
            clean = tables.items[k]
            got = {i: d for _, i, d in decontaminate.matches(tables, np.frombuffer(doc, np.uint8), np.array([0, len(doc)]))}
            if decontaminate.edit_distance(clean[1], doc.decode()) <= clean[3]:
                near += 1
                found += k in got
            assert set(got) <= {i for i, t, _, most in tables.items and [(j, *x[1:]) for j, x in enumerate(tables.items)] if decontaminate.edit_distance(t, doc.decode()) <= most}
    assert near > 100 and found >= 0.9 * near


def found_items(tables, *texts):
    raw = [t.lower().encode() for t in texts]
    got = decontaminate.matches(tables, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return {(row, item): d for row, item, d in got}


def test_tables_are_sent_without_what_can_be_drawn_again():
    """Every executor keeps a copy on its disk: the walks' own tables alone would be 52 MB."""
    items = [(k, prose(700 + k, 40)) for k in range(50)] + [(50, "a short item")]
    tables = decontaminate.ItemTables(items, 0.8)
    sent = pickle.dumps(tables)
    assert len(sent) < 24_000_000
    got, texts = pickle.loads(sent), [f"{prose(k, 20)} {t} {prose(k + 99, 20)}" for k, t in items]
    for (walk, *own), (other, *rest) in zip(tables.walks, got.walks, strict=True):
        assert all((a == b).all() for a, b in zip(walk.rounds, other.rounds, strict=True))
        assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(own, rest, strict=True))
    assert len(found_items(tables, *texts)) >= 51 and found_items(got, *texts) == found_items(tables, *texts)


def edited(text, edits, r, kinds="sid"):
    """``text`` with an edit of the given kinds at each of the places ``edits``."""
    out = list(text)
    for place in sorted(edits, reverse=True):
        kind = r.choice(kinds)
        out[place : place + 1] = ["q"] if kind == "s" else [out[place], "q"] if kind == "i" else []
    return "".join(out)


def test_recall_of_character_edits():
    """Edits of single characters up to the threshold: what the exact distance to every item tells is found, no less."""
    r = random.Random(6)
    items = [(k, prose(300 + k, r.randrange(3, 50))) for k in range(80)]
    tables = decontaminate.ItemTables(items, 0.8)
    near = 0
    for rate in (0.03, 0.1, 0.15, 0.18, 0.2):
        docs = [f"{prose(k, 20)} {edited(t, r.sample(range(len(t)), int(rate * len(t))), r)} {prose(k + 50, 20)}" for k, t in items]
        want = {(d, i): x for d, doc in enumerate(docs) for i, (_, t, _, most) in enumerate(tables.items)
                if abs(d - i) < 3 and (x := decontaminate.edit_distance(t, doc)) <= most}
        got = found_items(tables, *docs)
        assert {k: v for k, v in got.items() if abs(k[0] - k[1]) < 3} == want
        near += sum(d == i for d, i in want)
    assert near > 380


@pytest.mark.parametrize("least,most", [(5, 5), (6, 6), (4, 6), (5, 6), (3, 7)])
@pytest.mark.parametrize("kinds", ["s", "sid"])
def test_recall_of_evenly_spread_edits(least, most, kinds):
    """Edits at even gaps leave few clean stretches: of the items within the threshold, 0.9 and more are found."""
    r = random.Random(10 * least + most)
    items = [(k, prose(500 + k, r.randrange(25, 70))) for k in range(80)]
    tables = decontaminate.ItemTables(items, 0.8)
    near = found = 0
    for k, text, n, allowed in tables.items:
        places = list(accumulate(r.randint(least, most) for _ in range(n)))
        wrong = edited(text, [p for p in places if p < n][:allowed], r, kinds)
        doc = f"{prose(k, 30)} {wrong} {prose(k + 99, 30)}"
        if decontaminate.edit_distance(text, doc) <= allowed:
            near += 1
            found += (0, k) in found_items(tables, doc)
    assert near >= 40 and found >= 0.9 * near, (found, near)


def test_recall_of_a_replaced_block():
    r = random.Random(17)
    items = [(k, prose(500 + k, r.randrange(25, 70))) for k in range(80)]
    tables = decontaminate.ItemTables(items, 0.8)
    for k, text, n, allowed in tables.items:
        first = r.randrange(n - allowed)
        assert (0, k) in found_items(tables, f"{prose(k, 30)} {text[:first]}{'q' * allowed}{text[first + allowed :]} {prose(k + 99, 30)}")


def test_a_walk_emits_its_sampled_steps():
    """The table of triples takes the steps that the rule takes one by one."""
    rng = np.random.default_rng([8, 3])
    steps = 3 * decontaminate.ROUNDS
    sampled = set(rng.choice(steps, decontaminate.SAMPLED, replace=False).tolist())
    go, value = rng.integers(0, 2, (steps, 32), dtype=np.uint32), rng.integers(0, 1 << 30, (steps, 32), dtype=np.uint32)
    text = prose(3, 12)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.arange(len(text))
    for start, key in zip(starts, decontaminate.Walk(3).keys(decontaminate.triples(points), starts), strict=True):
        at, parts = start, [0] * decontaminate.ROUNDS
        for step in range(steps):
            c = ord(text[at]) & 31 if at < len(text) else 0
            parts[step // 3] += int(value[step, c]) * (step in sampled)
            at += int(go[step, c])
        want = sum(part % (1 << 30) for part in parts) * 0x9E3779B1 % (1 << 32)
        assert key == want ^ want >> 15


def test_walks_that_go_on_are_all_that_may_end_at_a_key_of_an_item():
    """Most walks over a text stop early; those with the key of an item never do, and their keys are the whole walk's."""
    rng = np.random.default_rng(5)
    item, text = rng.integers(97, 123, 400).astype(np.uint32), rng.integers(97, 123, 90_000).astype(np.uint32)
    text[30_001:30_401], text[60_000:60_200] = item, item[100:300]
    walk, early = decontaminate.Walk(3), np.zeros(1 << 16, bool)
    inside = np.arange(len(item) - decontaminate.ROUNDS)
    walk.mark(decontaminate.triples(item), inside, early)
    starts = np.arange(0, len(text), 1)
    every = walk.keys(decontaminate.triples(text), starts)
    likely, keys = walk.likely_keys(decontaminate.triples(text), starts, early)
    assert (every[likely] == keys).all() and len(likely) < len(starts) / 10
    equal = np.flatnonzero(np.isin(every, walk.keys(decontaminate.triples(item), inside)))
    assert len(equal) > 400 and np.isin(equal, likely).all()



def test_one_wrong_letter_in_every_word():
    item = "another wonderful morning brought several travellers towards distant northern harbours"
    wrong = " ".join(w[:3] + "q" + w[4:] for w in item.split())
    assert found_items(decontaminate.ItemTables([(1, item)], 0.8), f"before it {wrong} and after") == {(0, 0): len(item.split())}


@pytest.mark.parametrize("n", range(3, 16))
def test_an_edit_of_any_word_of_a_short_item(n):
    item = " ".join(["harbour", "lantern", "meadow", "quarry", "thistle", "granite", "orchard", "saddle", "timber", "village", "whistle", "copper", "feather", "island", "journal"][:n])
    tables = decontaminate.ItemTables([(1, item)], 0.8)
    for place in range(len(item)):
        if item[place] != " ":
            assert found_items(tables, f"some text {item[:place]}x{item[place + 1 :]} more text").get((0, 0)) == 1


def test_exact_copies_in_texts_without_blanks(spark):
    items = [(1, "春天的河水从旧石桥下缓缓流过七只灰雁在泥岸上看着"), (2, "「川は古い橋の下を流れる」と彼は言った。"), (3, "สายน้ำไหลผ่านใต้สะพานหินเก่า"), (4, "the river runs under an old bridge")]
    texts = [(1, "昨日我们去了城外，春天的河水从旧石桥下缓缓流过七只灰雁在泥岸上看着，没有人数它们。"), (2, "昔々、「川は古い橋の下を流れる」と彼は言った。そして夜になった"),
             (3, "วันนี้สายน้ำไหลผ่านใต้สะพานหินเก่าและเงียบสงบ"), (4, "he said—\u201cthe river runs\u00a0under\u2014an old bridge\u201d\u2026and left"), (5, "春天，没有人。")]
    got = decontaminate.contaminated(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(k, k, 0) for k in (1, 2, 3, 4)]


def test_many_hits_and_long_texts_lose_nothing(monkeypatch, spark):
    items = [(k, prose(60 + k, 20)) for k in range(10)]
    text = " ".join(prose(k, 40) + " \n\t " * 40 + t.replace(" ", " " * 30) for k, t in items) + " é " + prose(99, 200)
    monkeypatch.setattr(decontaminate, "HITS", 50)
    monkeypatch.setattr(decontaminate, "PIECE", 1500)
    batch = documents(spark, [(1, text), (2, None), (3, "é" + items[4][1])]).toArrow().to_batches()[0]
    tables = decontaminate.ItemTables(items, 0.8)
    row = batch.column("doc_id").to_pylist().index(1)
    assert {i: d for (r, i), d in decontaminate._found(tables, batch.slice(row, 1)).items()} == dict.fromkeys(range(10), 0)
    monkeypatch.setattr(decontaminate, "PIECE", 4 << 20)
    assert {i for r, i in found_items(tables, text, "", "é" + items[4][1]) if r == 0} == set(range(10))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block"), ("a.com", "/d", "allow")]
URLS = ["http://X.Example.ORG/es/1?q=1", "https://example.org/es", "https://org/", "http://borg/", "ftp://u.a.com/de/2#x", "//a.com/de/", None, "", "http://",
        "http://a.com?x/de/", "x://y.com/de/%20é?a&b&c", "a://b://c.com/de/", "http://a.com/de/" + "z1" * 3000, "HTTP://B.com/de/\nx"]


def expected(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, min(fits, key=lambda f: (-f[0], f[1]))[1:] if fits else None


def test_url_rules_and_trees(spark):
    r = random.Random(1)
    more = [f"http://{r.choice('abcd')}{r.randrange(9)}.{r.choice(['org', 'com', 'net'])}/{r.choice(['es', 'de', 'fr'])}/{r.randrange(999)}" for _ in range(300)]
    rows = [(k, u, "<p>", "x", "x") for k, u in enumerate(URLS + more)] + [(None, URLS[0], None, "x", "x"), (0, URLS[0], "", "x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, score string")
    got = urls.judge(pages, RULES).collect()
    assert len(got) == len(rows)
    for x in got:
        host, path, rule = expected(rows[x.page_id][1] if x.page_id is not None else URLS[0])
        assert (x.host, x.path, x.rule) == (host, path, rule and rule[0]) and x.verdict in ("allow", "block") and (not rule or x.verdict == rule[1])
    learned = [x for x in got if x.rule]
    assert sum((x.score >= 0.5) == (x.verdict == "block") for x in learned) > 0.95 * len(learned)


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://q.net/"), (2, None)], "page_id long, url string")
    assert {x.verdict for x in urls.judge(pages, RULES).collect()} == {"allow"}
    assert urls.judge(pages.where("page_id > 9"), RULES).count() == 0


def test_longest_rule_wins_over_order(spark):
    pages = spark.createDataFrame([(1, "http://s.a.com/de/")], "page_id long, url string")
    for rules, rule in ((RULES, "a.com/d"), ([("a.com", "/", "allow"), ("com", "/de/", "block")], "com/de/")):  # equal lengths go by name
        assert urls.judge(pages, rules).first().rule == rule


def test_one_url_in_a_third_of_the_pages(spark, monkeypatch):
    sizes = []
    keep = urls.written
    monkeypatch.setattr(urls, "written", lambda df, name: (sizes.append(df.count()) if name == "url-train" else None) or keep(df, name))
    rows = [(k, "http://a.org/hot" if k % 3 == 0 else f"http://{'ab'[k % 2]}{k % 50}.{'org' if k % 2 else 'com/de'}/{k}") for k in range(6000)] + [(1, "http://b.com/de/x")] * 3000
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), RULES, max_urls=300)
    assert got.count() == 9000 and 30 < sizes[0] < 600


def test_shares_leave_out_the_rows_own_fold(spark):
    rows = [(k, f"http://{'x' if k < 40 else 'y'}.com/{k}", float(k < 40)) for k in range(80)] + [(100, "http://lone.net/", 1.0), (101, "http://new.dev/", None)]
    host, path = urls.host_and_path(urls.F.col("url"))
    pages = urls.lexical(spark.createDataFrame(rows, "page_id long, url string, label double").withColumns({"host": host, "path": path}))
    got = {r.page_id: r for r in urls.with_shares(pages, pages.where("label is not null")).collect()}
    mean = 41 / 81
    assert got[100].domain_share == pytest.approx(mean) and got[101].domain_share == pytest.approx(mean)  # nothing but its own label, or none
    assert all(got[k].domain_share > mean for k in range(40)) and all(got[k].domain_share < mean for k in range(40, 80))
