"""What the operators of this package share: row keys, Arrow batches of bounded size, span and hash helpers."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Rows and bytes of text that one Arrow batch hands to a task's Python step.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
STEP_BACK = pow(STEP, -1, 1 << 64)


def bounded_batches(spark):
    """Long texts make batches of a fixed row count too large, so batches are bounded in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def free_name(df, name):
    """``name``, longer by underscores if a column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df, *names):
    """``df`` with its columns of these ``names`` under free ones, and what gives a result's columns their names back."""
    aside = {free_name(df, c + "_"): c for c in df.columns if c.lower() in names}
    if not aside:
        return df, lambda result: result
    free = {c: name for name, c in aside.items()}
    renamed = df.toDF(*[free.get(c, c) for c in df.columns])
    return renamed, lambda result: result.toDF(*[aside.get(c, c) for c in result.columns])


def text_key(column="text"):
    """Tells rows with one doc_id and different texts apart; the same row repeated has the same key."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def utf8(batch, column="text"):
    """Texts of an Arrow batch as bytes, null as empty."""
    values = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return [b"" if t is None else t for t in values.cast(kind).to_pylist()]


def texts(batch, column="text"):
    """Texts of an Arrow batch as strings, null as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


class Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def scramble(values):
    """A one-to-one mixing of 64-bit integers."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def powers(n, base=STEP):
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


class Rolling:
    """Hashes of all windows of a sequence of 64-bit codes, by a polynomial modulo 2**64.

    Equal windows have equal hashes wherever they stand. The power tables are kept and grow with the longest input.
    """

    def __init__(self):
        self.up, self.down = powers(1 << 16), powers(1 << 16, STEP_BACK)

    def windows(self, codes, width):
        n = len(codes)
        if n < width:
            return np.empty(0, np.uint64)
        if n >= len(self.up):
            self.up, self.down = powers(2 * n), powers(2 * n, STEP_BACK)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(codes * self.up[:n], out=total[1:])
        return scramble((total[width:] - total[:-width]) * self.down[: n - width + 1])


#: Low bits of a hash that give way to the position while minima are sought, and windows searched at a time.
PLACE_BITS, SECTION = np.uint64(24), 1 << 23


def window_minima(values, width):
    """Position of the least value in each window of ``width`` values, the first of equal ones.

    Values are compared by their upper 40 bits, alike for every length, so equal windows have theirs at equal places.
    """
    n = len(values) - width + 1
    if n > SECTION:
        parts = range(0, n, SECTION)
        return np.concatenate([at + window_minima(values[at : at + SECTION + width - 1], width) for at in parts])
    if n <= 0:
        return np.empty(0, np.int64)
    keys = (values >> PLACE_BITS << PLACE_BITS) | np.arange(len(values), dtype=np.uint64)
    padded = np.full(-(-len(keys) // width) * width, ~np.uint64(0), np.uint64)
    padded[: len(keys)] = keys
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    return (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)


def runs(values):
    """Start and end of each run of equal neighbours."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.append(starts[1:], len(values))


def covered(n, starts, lengths):
    """Mask of n places covered by spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts) + np.asarray(lengths), -1)
    return np.cumsum(edge[:-1]) > 0


def mask_spans(mask):
    """Start and end of each maximal run of true places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_words(raw, mask):
    """The text without the words where ``mask`` is true; what stands between kept words stays.

    Words are those of ``bytes.split()``. A removed run takes the blank in front of it along.
    """
    out, at, spans = [], 0, [m.span() for m in _WORD.finditer(raw)]
    for first, last in zip(*mask_spans(mask)):
        begin, end = spans[first][0], spans[last - 1][1]
        out.append(raw[at:begin].rstrip(b" ") if first else raw[at:begin])
        at = end
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")
