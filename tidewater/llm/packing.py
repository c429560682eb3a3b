"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import map_arrow, row_slices
from tidewater.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
#: Bytes of ids that leave a task in one Arrow batch.
_BATCH_BYTES = 8 << 20


def binary_lengths(n: int, longest: int) -> list[int]:
    """Lengths that add up to ``n``: as many of ``longest`` as fit, then the powers of two of the rest, long ones first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, longest: int = 4096) -> DataFrame:
    """Cut the token ids of every document into pieces whose lengths are powers of two.

    Each piece is a sequence of its own; ``bucket``, the logarithm of its length, groups the sequences that can share
    a batch without padding (:func:`write_buckets` lays them out that way). A document's ids are those of its text
    followed by ``end_id``, so an empty or missing text gives one piece of length 1. Repeated rows give repeated
    pieces. Gives per piece doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), bucket,
    sequence_id (unique), offset (0). An empty table gives no rows.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches):
        enc, end = encoder(tokenizer), np.array([end_id], np.uint32).tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            out, held = [], 0
            for first, _, texts in row_slices(batch.column("text")):
                for doc_id, ids in zip(doc_ids[first:], enc.encode(texts), strict=False):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length in binary_lengths(n, longest):
                        out.append((doc_id, start, length, n, ids[start * 4 : (start + length) * 4]))
                        start += length
                        held += length * 4
                        if held >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
                            out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, PIECES).select(
        "*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed sequences in one folder per length."""
    packed.write.partitionBy("bucket").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """Per piece its place, length and the CRC-32 of its ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
