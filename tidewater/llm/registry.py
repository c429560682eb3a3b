"""The queries of this subpackage, each applying one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm import byte_bpe, centroids, chat, decontaminate, digests, fim, language, packing, repeats, simhash, token_files, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(probe)))


#: Places in a text that get a backslash: where a mark begins, and backslashes.
_MARKS = "len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = '###' OR substr(text, i, 7) = '</turn>' OR substr(text, i, 1) = chr(92)))"
OP1_SQL = rf"""
WITH said AS (SELECT '\### Assistant: </turn> ok' AS text),
rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', text FROM said UNION ALL SELECT -7, 1, 'assistant', text FROM said),
turns AS (SELECT *, coalesce(lag(role) OVER conv, 'start') AS before, row_number() OVER conv AS nr, count(*) OVER (PARTITION BY conv_id) AS n,
  length(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: '
    ELSE '### Role ' || role || ': ' END) + length(text) + {_MARKS} + length(' </turn>' || chr(10)) AS size
  FROM rows WINDOW conv AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nr) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars,
  bool_and((before || ' ' || role) IN ('start system', 'start user', 'system user', 'user assistant', 'assistant user'))
    AND bool_or(nr = n AND role = 'assistant') AS valid
FROM turns GROUP BY conv_id
"""


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.predict(docs, language.fit(docs.where(~language.held_out())))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = digests.open_index(spark)
    found = index.absorb(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")
    index.drop()
    return found


OP3_SQL = r"""
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER same = 1 AS kept, h AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
      FROM documents)
WINDOW same AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~toxicity.held_out())))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, radius=4).drop("text_key")


#: Host, path and verdict of the rules that op6 is asked for.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_counts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate.contaminated(docs, benchmark, similarity=0.8).drop("text_key")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_bytes=50)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Two hexadecimal digits a byte, so windows are counted in bytes.
OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT doc_id, p FROM w JOIN m USING (s) WHERE first < doc_id),
runs AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r
  FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
spans AS (SELECT doc_id, r, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY ALL),
pieces AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS k FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM spans GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, seed=2)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Components in long form; one assignment and one mean a round."""
    nearest = """near{r} AS MATERIALIZED (SELECT id, min_by(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT x.id, m.c, sum((x.x - m.x) * (x.x - m.x))::BIGINT AS d FROM cells x JOIN mid{r} m USING (i) GROUP BY ALL) GROUP BY id)"""
    mean = """sums{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM near{p} JOIN cells USING (id) GROUP BY ALL),
mid{r} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM mid{p} LEFT JOIN sums{r} USING (c, i))"""
    steps = [nearest.format(r=0)]
    for r in range(1, rounds + 1):
        steps += [mean.format(r=r, p=r - 1), nearest.format(r=r)]
    return f"""
WITH whole AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
cells AS MATERIALIZED (SELECT id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM whole),
start AS (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c FROM whole QUALIFY c < {k}),
mid0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM start),
{", ".join(steps)},
names AS (SELECT c, sha256(string_agg(x, ',' ORDER BY i)) AS h FROM mid{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM near{rounds} JOIN whole USING (id) JOIN names USING (c)
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fim.transform(spark.read.parquet(f"{sf_dir}/documents.parquet"), rate=50, spm_rate=80, seed=42)
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS g FROM d),
c AS (SELECT *, len(w) AS n, least(g[1] % (len(w) + 1), g[2] % (len(w) + 1)) AS a, greatest(g[1] % (len(w) + 1), g[2] % (len(w) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, array_to_string(w[:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 50 THEN 'plain' WHEN g[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.decode(byte_bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_language": op2_language,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_repeats": op10_repeats,
    "op11_centroids": op11_centroids,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op10_repeats": OP10_SQL,
                           "op11_centroids": _op11_sql(), "op12_fill_in_middle": OP12_SQL}
