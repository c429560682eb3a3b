"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for all other pages.

Everything runs on columns: no Python sees a URL.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.llm.common import written

#: Labelled URLs that the trees are grown on, about.
MAX_URLS = 20_000
TREES, DEPTH, STEP = 12, 4, 0.3
#: Weight of the overall share in the share of a suffix.
PRIOR = 20.0
#: Parts of the labelled URLs; a row is judged by the suffix shares of the others.
FOLDS = 5
SUFFIXES = ("top", "domain", "folder", "ending")
LEXICAL = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "parameters", "query_length", "secure")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def apply_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add ``rule`` and ``ruling`` to pages with host and path; both are missing where no rule fits.

    A rule (host, path, verdict) fits its host and all hosts below it where the path starts with the rule's. The rule
    with the most characters wins, then the first by name. Rules are a literal list, tested one by one.
    """
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruling = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return pages.withColumns({"rule": rule, "ruling": ruling})


def _share(text: Column, characters: str) -> Column:
    return F.when(F.length(text) > 0, 1 - F.length(F.translate(text, characters, "")) / F.length(text)).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """Add the lexical features and suffixes of ``url``, ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    # Entropy over the distinct characters, each counted by what its removal leaves.
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(F.array_distinct(F.split(url, "")), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    names = F.split("host", r"\.")
    return pages.withColumns({
        "length": n, "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": F.size(segments).cast("double"), "labels": F.size(names).cast("double"), "digits": _share(url, "0123456789"),
        "host_digits": _share(F.col("host"), "0123456789"), "hyphens": (F.length(url) - F.length(F.translate(url, "-_", ""))).cast("double"),
        "entropy": F.coalesce(entropy, F.lit(0.0)), "parameters": F.when(query != "", F.size(F.split(query, "&"))).otherwise(0).cast("double"),
        "query_length": F.length(query).cast("double"), "secure": F.coalesce(url.startswith("https:"), F.lit(False)).cast("double"),
        "top": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
        "folder": F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit("")), "ending": F.regexp_extract("path", r"\.([^./]*)$", 1),
    })


def with_shares(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Add for each kind of suffix the share of ``labelled`` rows (``label`` 1) with that suffix, drawn to the overall share.

    Shares are counted over all labelled rows, with partial sums before the shuffle; a suffix unknown there has the
    overall share. A row with a label has the share among the rows of the other folds, so its own label, and those of
    rows that repeat its URL, are no part of it.
    """
    overall = written(labelled.agg(F.coalesce(F.avg("label"), F.lit(0.5)).alias("overall")), "url-overall")
    mean = overall.first()[0]
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.coalesce("url", F.lit(""))), F.lit(FOLDS)).cast("int")
    pages = pages.withColumn("_fold", F.when(F.col("label").isNotNull(), fold))
    for kind in SUFFIXES:
        per = [f(F.when(fold == k, F.col("label"))) for k in range(FOLDS) for f in (F.sum, F.count)]
        seen = labelled.groupBy(F.col(kind).alias(f"_{kind}")).agg(
            F.sum("label").alias("_sum"), F.count("label").cast("double").alias("_n"),
            F.array(*[F.struct(F.coalesce(s, F.lit(0.0)).alias("sum"), n.cast("double").alias("n")) for s, n in zip(per[::2], per[1::2], strict=True)]).alias("_folds"))
        seen = written(seen, "url-shares")
        out = F.get("_folds", F.col("_fold"))
        share = (F.col("_sum") - F.coalesce(out["sum"], F.lit(0.0)) + PRIOR * mean) / (F.col("_n") - F.coalesce(out["n"], F.lit(0.0)) + PRIOR)
        pages = pages.join(seen, F.col(kind) == F.col(f"_{kind}"), "left").withColumn(f"{kind}_share", F.coalesce(share, F.lit(mean)))
        pages = pages.drop(f"_{kind}", "_sum", "_n", "_folds")
    return pages.drop("_fold")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], max_urls: int = MAX_URLS) -> DataFrame:
    """Judge every page by its URL: page_id, host, path, rule, verdict, score (the trees' chance of block).

    The verdict is that of the longest rule that fits. Pages that a rule decides are the labelled URLs; the trees are
    grown on at most about ``max_urls`` of them, chosen by a hash of page_id and URL, rows that are repeated whole
    counting once, and judge all pages without a rule: block at 0.5
    or more. Without labelled URLs of both kinds the one kind there is holds for all, or allow. A missing URL, or one
    without ``://``, has an empty host and path. Other columns are ignored; repeated rows give repeated rows.
    """
    host, path = host_and_path(F.col("url"))
    ruled = apply_rules(pages.select("page_id", "url").withColumns({"host": host, "path": path}), rules)
    rows = lexical(ruled)
    labelled = rows.where("ruling is not null").withColumn("label", (F.col("ruling") == "block").cast("double"))
    kinds = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(kinds) < 2:
        only = 1.0 if kinds.get(1.0) else 0.0
        judged = rows.withColumn("score", F.lit(only))
    else:
        share = int(min(1.0, max_urls / sum(kinds.values())) * (1 << 30))
        shared = with_shares(rows.withColumn("label", (F.col("ruling") == "block").cast("double")), labelled)
        columns = [*LEXICAL, *(f"{k}_share" for k in SUFFIXES)]
        assembler = VectorAssembler(inputCols=columns, outputCol="features")
        train = shared.where(F.col("label").isNotNull() & (F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < share)).dropDuplicates(["page_id", "url"])
        train = written(train.select("label", *columns), "url-train")
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=6).fit(assembler.transform(train))
        judged = trees.transform(assembler.transform(shared)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("ruling", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
