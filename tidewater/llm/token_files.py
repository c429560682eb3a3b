"""Documents and their token counts in flat, unindexed token files."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidewater.llm.common import map_arrow, open_folder, row_slices, shared_folder, written
from tidewater.llm.tokens import encoder

#: Bytes read at once by the scan; a multiple of every width.
BLOCK_BYTES = 4 << 20


def _narrow(ids: bytes, width: int) -> bytes:
    """The ids in ``width`` bytes each; one that does not fit is an error."""
    wide = np.frombuffer(ids, "<u4")
    if wide.max(initial=0) >> (8 * width):
        raise ValueError(f"an id does not fit in {width} bytes")
    return wide.astype(f"<u{width}").tobytes()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2) -> DataFrame:
    """Write the token ids of ``docs``, each document followed by ``end_id``, to flat little-endian files in ``folder``.

    Every task writes one file under a name of its own attempt, so a repeated or speculative task leaves a file that
    nobody reads. Text that spells a special token is ordinary text, so ``end_id`` occurs at ends alone. The files hold
    no index. Gives the manifest, written once: file, doc_id, ordinal (place in the file), n_bytes (of the file).
    """

    def run(batches):
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        enc, end, name, ordinal, size, out = encoder(tokenizer, special_as_text=True), np.array([end_id], f"<u{width}").tobytes(), f"{uuid.uuid4().hex}.bin", 0, 0, None
        try:
            for batch in batches:
                for _, _, texts in row_slices(batch.column("text")):
                    data = b"".join(_narrow(ids, width) + end for ids in enc.encode(texts))
                    out = out or system.open_output_stream(f"{root}/{name}")
                    out.write(data)
                    size += len(data)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), batch.column("doc_id"), pa.array(np.arange(ordinal, ordinal + n)), pa.array([None] * n, pa.int64())],
                    names=["file", "doc_id", "ordinal", "n_bytes"])
                ordinal += n
        finally:
            if out:
                out.close()
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([None], pa.int64()), pa.array([-1]), pa.array([size])], names=["file", "doc_id", "ordinal", "n_bytes"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(map_arrow(rows, run, "file string, doc_id long, ordinal long, n_bytes long"), "token-manifest")


def scan_blocks(files: DataFrame, folder: str, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Search every block of ``files`` (file, n_bytes) for ``end_id``.

    Gives per block: file, block, n_tokens, ends (places of the separators in the block).
    """
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")

    def run(batches):
        system, root = open_folder(folder)
        for batch in batches:
            for name, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{name}") as f:
                    f.seek(block * block_bytes)
                    data = f.read(block_bytes)
                ids = np.frombuffer(data[: len(data) // width * width], f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "block", "n_tokens", "ends"])

    blocks = files.where("n_bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / block_bytes))).alias("block"))
    tasks = files.sparkSession.sparkContext.defaultParallelism * 4
    return map_arrow(blocks.repartition(tasks, "file", "block"), run, "file string, block long, n_tokens long, ends array<long>")


def count_documents(blocks: DataFrame) -> DataFrame:
    """Stitch the blocks of each file: file, ordinal, n_tokens (without the separator), terminated.

    A prefix scan over the blocks gives each block the separators and the ids before it and the place of the last
    separator so far, so a document may run over any number of blocks. Ids after the last separator of a file are one
    document that is not terminated; two separators in a row enclose a document of no tokens.
    """
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # The scan runs over a few numbers a block; the places of the separators stay with their block.
    sizes = blocks.select("file", "block", "n_tokens", F.size("ends").cast("long").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("own_end"))
    sized = sizes.withColumn("at", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("last_end", F.col("at") + F.col("own_end"))
    scanned = (sized.withColumn("ordinal", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
               .withColumn("carry", F.col("at") - F.coalesce(F.max("last_end").over(before) + 1, F.lit(0))))
    placed = blocks.select("file", "block", "ends").join(scanned.select("file", "block", "ordinal", "carry"), ["file", "block"])
    # Each block gives the documents that end in it; lengths are gaps between separators, the first one with the carry.
    gaps = F.expr("transform(ends, (e, i) -> if(i = 0, e + carry, e - ends[i - 1] - 1))")
    ended = placed.select("file", "ordinal", F.posexplode(gaps).alias("k", "n_tokens")).select(
        "file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("terminated"))
    rest = sized.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.sum("n_ends").alias("ordinal"), F.max("last_end").alias("last_end"))
    open_ended = rest.select("file", "ordinal", (F.col("n") - F.coalesce(F.col("last_end") + 1, F.lit(0))).alias("n_tokens"), F.lit(False).alias("terminated"))
    return ended.unionByName(open_ended.where("n_tokens > 0"))


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 49407, width: int = 2) -> DataFrame:
    """Write ``docs`` to flat token files, count the documents' tokens by scanning them, and remove the files.

    Gives one row per row of ``docs``: doc_id, n_tokens (0 for an empty or missing text), file, ordinal. Other columns
    are ignored. An empty table gives no rows.
    """
    folder = shared_folder(spark, "token-files")
    manifest = write_token_files(docs, folder, tokenizer, end_id, width)
    blocks = written(scan_blocks(manifest.where("ordinal = -1").select("file", "n_bytes"), folder, end_id, width), "token-blocks")
    system, root = open_folder(folder)
    if system.get_file_info(root).type == fs.FileType.Directory:
        system.delete_dir(root)
    counts = count_documents(blocks).select("file", "ordinal", "n_tokens")
    return manifest.where("ordinal >= 0").join(counts, ["file", "ordinal"], "left").select("doc_id", "n_tokens", "file", "ordinal")
