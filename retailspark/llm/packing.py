"""Packing by power-of-two decomposition: every sequence is one piece of one document."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import bounded_batches, texts
from .tokens import Encoder

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("offset", pa.int64()),
    ]
)
PIECES_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, offset long"


def binary_lengths(n, longest):
    """Lengths of the pieces of n tokens: the longest power of two as often as it fits, then the bits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs, tokenizer, end_id=1, longest=2048):
    """The documents' tokens, each followed by ``end_id``, cut into sequences of power-of-two length.

    One row per piece: doc_id, start (tokens of its document before it), length, ids (binary, little-endian unsigned
    32-bit), doc_tokens (of the whole document with the end token), sequence_id, offset (always 0) and bucket, the
    binary logarithm of the length. A piece is a sequence of its own, so none crosses documents and none needs
    padding; batches are formed from one bucket. ``longest`` must be a power of two.

    A null or empty text is one piece of the end token. Texts of any length are cut whole; they are read one at a
    time. Repeated rows are packed each; a null doc_id stays null. Other columns of ``docs`` are not read. An empty
    table gives no pieces.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    bounded_batches(docs.sparkSession)

    def cut(batches):
        encoder = Encoder(tokenizer)
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            rows, held = {name: [] for name in PIECES.names}, 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = encoder.ids(text) + end
                n, start = len(ids) // 4, 0
                for length in binary_lengths(n, longest):
                    piece = ids[4 * start : 4 * (start + length)]
                    for name, value in zip(PIECES.names, (doc_id, start, length, piece, n, 0)):
                        rows[name].append(value)
                    start += length
                held += len(ids)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pydict(rows, PIECES)
                    rows, held = {name: [] for name in PIECES.names}, 0
            yield pa.RecordBatch.from_pydict(rows, PIECES)

    cut_up = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES_DDL)
    return cut_up.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.round(F.log2("length")).cast("int").alias("bucket"),
    )


def write_buckets(packed, path, shards=8):
    """Writes the sequences by bucket, each bucket in ``shards`` files, so that a batch reads one length only."""
    salt = F.pmod(F.xxhash64("sequence_id"), F.lit(shards)).alias("shard")
    packed.repartition(packed.bucket, salt).write.partitionBy("bucket").parquet(path)


def ids_of(binary):
    """The ids of a piece as a numpy array."""
    return np.frombuffer(binary, "<u4")


