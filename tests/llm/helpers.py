"""Small tables that hold the awkward cases."""

import random

WORDS = "the river runs under old stone bridge while seven grey geese watch from a muddy bank and nobody counts them twice".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, d string, ver string, digest string, text_key string, _id string, _key string, spans string, y string, label string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def documents(spark, rows):
    """``documents`` from (doc_id, text), with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["x"] * 9, None) for i, t in rows], SCHEMA)


def awkward():
    """Missing and empty texts, blanks, repeated rows, a shared and a missing doc_id, ties, copies and a very long text."""
    a, b, long = prose(1, 60), prose(2, 60), prose(3, 30_000)
    return [(1, a), (2, None), (3, ""), (4, "  \n"), (5, a), (5, a), (6, a.upper()), (7, b), (7, a + " tail"), (None, b), (None, None),
            (8, long), (9, long + " end"), (10, "short"), (11, "é ü 漢字"), (12, b + " " + a), (-3, b)]
