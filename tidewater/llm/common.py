"""Helpers shared by the operators of this subpackage: shared folders, written tables, and slices of Arrow text."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Bytes of text that the vectorised operators handle at once, unless one text is longer.
SLICE_BYTES = 1 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folder: str | None = None
_shipped: set[str] = set()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder named by ``spark.checkpoint.dir``, which all executors reach.

    Only a local session without that setting gets a temporary folder.
    """
    global _own_folder
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        _own_folder = root = _own_folder or "file:" + tempfile.mkdtemp(prefix="run-")
    return f"{qualified(spark, root).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: one without a scheme lies in the default file system, for tasks as for Spark itself."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that survives lost executors.

    The shuffle files of the write are given up when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def map_arrow(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose workers can import this package: its sources are sent once for each application."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(package)))
        path = shared_folder(df.sparkSession, "sources")
        system, root = open_folder(path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/tidewater.zip") as out:
            out.write(packed.getvalue())
        sc.addPyFile(f"{path}/tidewater.zip")
        _shipped.add(sc.applicationId)
    return df.mapInArrow(fn, schema)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``limit`` bytes.

    Gives (first row, row after the last, bytes of all texts joined, where each text begins and the end). A missing text is empty.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def row_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """As :func:`text_slices`, giving the texts as strings."""
    column = pc.fill_null(column, "")
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    first = 0
    while first < len(column):
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield first, last, column.slice(first, last - first).to_pylist()
        first = last


def text_key() -> F.Column:
    """Hash that tells apart rows of one ``doc_id``; a missing text counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` and text hash are in ``keys`` (doc_id, text_key), one for each key.

    Of rows that repeat a key, the one whose other columns have the greatest hash stays. All columns of ``docs`` are kept,
    whatever their types.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")  # plain equality, so texts are shuffled once
    others = F.to_json(F.struct(*[f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")))
    own = docs.select(name, text_key().alias("_key"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.xxhash64(others).alias("_turn"))
    held = own.join(keys.select(name, F.col("text_key").alias("_key")), ["_key", "_id"], "left_semi")
    return held.groupBy("_key", "_id").agg(F.max_by("_row", "_turn").alias("_row")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def filter_rows(docs: DataFrame, keep: Callable) -> DataFrame:
    """The rows of ``docs`` for which ``keep`` is true, with all their columns, in one pass.

    ``keep`` is called once for each task and gives a function from Arrow batches to lists of booleans.
    """

    def run(batches):
        decide = keep()
        for batch in batches:
            yield batch.filter(pa.array(decide(batch), pa.bool_()))

    return map_arrow(docs, run, docs.schema)
