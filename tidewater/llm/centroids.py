"""Centroid clustering of vectors in exact integers, by column expressions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.llm.common import written


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """The vectors that can be clustered: ``id_col``, ``v``, their components times ``scale`` rounded down, and ``square``, the sum of their squares.

    A vector that is missing, has another length, or holds a missing or non-finite component is left out; repeated rows
    stay, and so does a row without an id. Other columns are ignored. A component whose scaled value reaches
    2^27 ends the job with an error, as squared distances must fit in 64 bits.
    """
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(F.col(id_col).alias("id"), wide.alias("v")).where((F.size("v") == dims) & finite)
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**27, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long")))
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    return kept.select(F.col("id").alias(id_col), whole.alias("v")).withColumn("square", square)


def first_centroids(vectors: DataFrame, k: int, seed: int = 2, id_col: str = "vec_id") -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, in the order of the hash (equal ids: of the components).

    Each task keeps its own ``k`` first. Rows without an id are taken last. Fewer than ``k`` rows give fewer centroids.
    """
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    return [list(r["v"]) for r in vectors.orderBy(name.asc_nulls_last(), "v").limit(k).select("v").collect()]


def nearest(centroids: Sequence[Sequence[int]], v: str = "v", square: str = "square") -> Column:
    """The nearest centroid to the integer array column ``v``, whose components' squares add up to ``square``.

    Gives a struct (distance, cluster): squared distance, and of equally near ones the smaller number. The distance is
    |v|^2 + |c|^2 - 2 v c; the centroids are array literals of the expression, which is parsed at once.
    """
    distance = "{square} + aggregate(zip_with({v}, array({point}), (a, b) -> a * b), {own}L, (s, x) -> s + x)"
    terms = (distance.format(square=square, v=v, point=",".join(f"{-2 * int(x)}L" for x in c), own=sum(int(x) * int(x) for x in c)) for c in centroids)
    return F.expr("array_min(array({}))".format(", ".join(f"struct({t} AS distance, {i} AS cluster)" for i, t in enumerate(terms))))


def means(vectors: DataFrame, centroids: Sequence[Sequence[int]]) -> list[list[int]]:
    """Each centroid replaced by the exact mean of its vectors, rounded down; one without vectors stays.

    One aggregation: every task sends one row of sums per cluster, whatever the number of vectors in it.
    """
    dims = len(centroids[0])
    placed = vectors.select("v", nearest(centroids)["cluster"].alias("cluster"))
    flat = placed.select("cluster", *[F.col("v")[i].alias(f"v{i}") for i in range(dims)])
    sums = flat.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(dims)])
    out = [list(c) for c in centroids]
    for r in sums.collect():  # at most one row per centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def fit(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, id_col: str = "vec_id") -> list[list[int]]:
    """The centroids after ``rounds`` rounds of assignment and mean, started at :func:`first_centroids`.

    ``vectors`` is read once for the start and once a round, so it should be a written table. The centroids, ``k`` times
    the number of components, are all that the driver holds. No vectors give no centroids.
    """
    centroids = first_centroids(vectors, k, seed, id_col)
    for _ in range(rounds if centroids else 0):
        centroids = means(vectors, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: Sequence[Sequence[int]], id_col: str = "vec_id") -> DataFrame:
    """The cluster of every vector: ``id_col``, cluster, distance (squared)."""
    if not centroids:
        return vectors.select(id_col, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    found = vectors.select(id_col, nearest(centroids).alias("near"))
    return found.select(id_col, "near.cluster", "near.distance")


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, dims: int = 64,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cluster the vectors of ``rows``: ``id_col``, cluster, distance, cluster_inertia, inertia, centroid (its components).

    Integers throughout, so results do not depend on the order of rows or tasks. ``cluster_inertia`` is the squared
    distance summed over the vector's cluster and ``inertia`` over all. Which rows count is said at
    :func:`whole_vectors`; none of them give no rows. The vectors and then their clusters are written to the shared folder.
    """
    vectors = written(whole_vectors(rows, id_col, vector_col, dims, scale), "vectors")
    centroids = fit(vectors, k, rounds, seed, id_col)
    placed = written(assign(vectors, centroids, id_col), "clusters")
    sums = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row per centroid at most

    def of_cluster(values: Sequence, kind: str) -> Column:
        """The entry of the row's cluster in a short list."""
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))

    names = [",".join(map(str, c)) for c in centroids]
    return placed.select(
        id_col, "cluster", "distance", of_cluster([sums.get(i) for i in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values()) if sums else None).cast("long").alias("inertia"),
        F.split(of_cluster(names, "string"), ",").cast("array<long>").alias("centroid"))
