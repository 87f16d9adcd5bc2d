"""Vector code compression in whole numbers: each part of a vector becomes the number of its nearest codebook entry.

Distances are taken between integer Walsh-Hadamard transforms of the zero-padded parts and entries. The transform
multiplies every squared distance by its width, so differences of coefficients, squared and summed in the order of their
sign changes, grow towards that multiple; an entry whose sum passes a distance already reached is out. Nothing is rounded.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import materialise
from .common import bounded_batches

#: A component x is kept as floor(SCALE * x).
SCALE = 4096
CODED_DDL = "vec_id long, label string, code string, error long"
_SUMS_DDL = "part int, entry int, n long, total array<long>"


def _butterflies(table):
    """Walsh-Hadamard transform of the rows, in natural order; the width is a power of two."""
    rows, width = table.shape
    h = 1
    while h < width:
        pairs = table.reshape(rows, width // (2 * h), 2, h)
        table = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(rows, width)
        h *= 2
    return table


def transform(table):
    """Walsh-Hadamard transform of integer rows, padded with zeros to a power of two, by number of sign changes."""
    rows, width = table.shape
    padded = 1 << max(width - 1, 0).bit_length()
    table = np.concatenate([table, np.zeros((rows, padded - width), table.dtype)], axis=1)
    signs = _butterflies(np.eye(padded, dtype=np.int64))
    return _butterflies(table)[:, np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1))]


def nearest_entries(parts, entries):
    """Number of the nearest entry of each part, the lower of equally near ones, and the squared distance."""
    x, e = transform(parts), transform(entries)
    rows, width = x.shape
    first = 1
    partial = (x[:, None, 0] - e[None, :, 0]) ** 2
    guess = partial.argmin(axis=1)
    reached = ((x - e[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(partial <= reached[:, None])
    total = partial[row, entry]
    while first < width:
        for c in range(first, min(2 * first, width)):
            total = total + (x[row, c] - e[entry, c]) ** 2
        left = total <= reached[row]  # equal ones stay, so that the lowest number is found among them
        row, entry, total = row[left], entry[left], total[left]
        first *= 2
    # pairs are sorted by row and entry: the first pair with the least sum of each row is the answer
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    least = np.minimum.reduceat(total, starts)
    hits = np.flatnonzero(total == least[row])
    best = hits[np.concatenate(([True], row[hits][1:] != row[hits][:-1]))]
    return entry[best], total[best] // width


def _table(batch, kind):
    """The integer vectors of a batch as a table; Python integers where 64 bits could overflow."""
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1).astype(kind)


def _kind(largest, width):
    padded = 1 << max(width - 1, 0).bit_length()
    return np.int64 if padded * padded * (2 * largest + 1) ** 2 < 1 << 62 else object


class Codebooks:
    """``entries[part]`` is a table of whole numbers, one row per entry; ``largest`` bounds all vectors' components."""

    def __init__(self, entries, largest):
        self.entries, self.largest = entries, largest

    @property
    def parts(self):
        return len(self.entries)

    @property
    def width(self):
        return self.entries[0].shape[1]

    @property
    def kind(self):
        return _kind(self.largest, self.width)

    def numbers(self):
        """All components by part, entry and position."""
        return [int(x) for table in self.entries for x in table.ravel()]

    def digest(self):
        return hashlib.sha256(",".join(map(str, self.numbers())).encode()).hexdigest()

    def assign(self, table):
        """Codes and squared distances of integer vectors, one column per part."""
        w = self.width
        found = [nearest_entries(table[:, p * w : (p + 1) * w], e.astype(table.dtype)) for p, e in enumerate(self.entries)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def decode(self, code):
        """The vector of whole numbers that a code stands for."""
        numbers = bytes.fromhex(code)
        return np.concatenate([table[n] for table, n in zip(self.entries, numbers)])


def integers(vectors, parts=8, vector="embedding"):
    """(vec_id, label, v) of the usable rows, written once, with the largest magnitude and number of components.

    Shorter vectors are filled with zeros to the longest one, and all of them to a multiple of ``parts``.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * float(SCALE)).cast("long"))
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    kept = vectors.where(x.isNotNull() & finite).select(F.col("vec_id").cast("long"), label.alias("label"), whole.alias("v"))
    size = kept.agg(F.max(F.size("v")).alias("n"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low"))
    n, high, low = size.first()
    largest = max(abs(high or 0), abs(low or 0))
    if largest >= 1 << 62:
        raise ValueError("a component is too large for whole numbers of 64 bits")
    length = max(-(-(n or 0) // parts), 1) * parts
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("v")))
    return materialise(kept.withColumn("v", filled), "vectors"), largest, length


def _sums(books):
    """Task step: per part and entry, the number of its vectors' parts and their sum."""

    def step(batches):
        counts = np.zeros((books.parts, max(map(len, books.entries))), np.int64)
        totals = np.zeros((*counts.shape, books.width), books.kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            table = _table(batch, books.kind)
            codes, _ = books.assign(table)
            for p in range(books.parts):
                np.add.at(totals[p], codes[:, p], table[:, p * books.width : (p + 1) * books.width])
                counts[p] += np.bincount(codes[:, p], minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(part, pa.int32()),
                "entry": pa.array(entry, pa.int32()),
                "n": pa.array(counts[part, entry], pa.int64()),
                "total": pa.array([list(map(int, t)) for t in totals[part, entry]], pa.list_(pa.int64())),
            }
        )

    return step


def train(whole, largest, length, parts=8, entries=16, rounds=6):
    """Codebooks from the rows of ``integers``, or None where there are none.

    They begin as the parts of the ``entries`` smallest vec_ids (null last, ties by vector). Each round reads the table
    once: tasks add up their own parts by entry, so parts * entries rows a task are shuffled, and one number per
    component of the codebooks reaches the driver, however many rows there are.
    """
    width = length // parts
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return None
    start = np.array([r[0] for r in first], _kind(largest, width))
    books = Codebooks([start[:, p * width : (p + 1) * width] for p in range(parts)], largest)
    for _ in range(rounds):
        sums = whole.select("v").mapInArrow(_sums(books), _SUMS_DDL)
        total = sums.select("part", "entry", "n", F.posexplode("total").alias("place", "x"))
        means = total.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        tables = [table.copy() for table in books.entries]
        for part, entry, place, n, x in means:
            tables[part][entry, place] = x // n
        books = Codebooks(tables, largest)
    return books


def encode(whole, books):
    """(vec_id, label, code, error): two hex digits per part, and the summed squared distance, of every row."""

    def step(batches):
        for batch in batches:
            if batch.num_rows:
                codes, errors = books.assign(_table(batch, books.kind))
                code = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                error = pa.array([int(e) for e in errors.sum(axis=1)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), error],
                    ["vec_id", "label", "code", "error"],
                )

    return whole.select("vec_id", "label", "v").mapInArrow(step, CODED_DDL)


def compress(vectors, parts=8, entries=16, rounds=6, vector="embedding"):
    """Codes of all usable ``vectors`` (vec_id, ``vector``, label): vec_id, code, error, label_error, codebooks_sha256.

    label_error is the error summed over the rows of one label, nulls together. A row whose vector is null or holds null,
    NaN or infinite components is left out; an empty vector counts as zeros, a shorter one is filled with zeros. Repeated
    rows are coded each; a null vec_id stays null and comes last among the first entries. Fewer rows than ``entries``
    give fewer entries, none give an empty result. Other columns are not read. Components whose whole number needs more
    than 62 bits raise an error, as do errors beyond 64 bits. ``entries`` is at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    spark = vectors.sparkSession
    bounded_batches(spark)
    whole, largest, length = integers(vectors, parts, vector)
    books = train(whole, largest, length, parts, entries, rounds)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialise(encode(whole, books), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    # one row per label on the other side: a label that holds a third of all rows is split by adaptive execution
    return (
        coded.alias("c")
        .join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
        .select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
    )


def compress_sql(parts=8, entries=16, rounds=6):
    """The same in SQL, by plain squared distances, for vectors of one length divisible by ``parts``."""
    distance = "list_sum([(x[i] - e[i]) * (x[i] - e[i]) for i in range(1, len(x) + 1)])"
    steps = [
        f"""k AS (SELECT vec_id, label, [floor({SCALE} * c::DOUBLE)::BIGINT for c in embedding] AS v,
      row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
    FROM embeddings WHERE embedding IS NOT NULL
      AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0)""",
        f"""p AS (SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x
    FROM k, range({parts}) t(part))""",
        f"b0 AS (SELECT part, r - 1 AS entry, x AS e FROM p WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS (SELECT r, p.part, min((d, entry)) AS best FROM
      (SELECT r, p.part, entry, {distance} AS d FROM p JOIN b{i} b ON p.part = b.part) p GROUP BY r, p.part)"""
        )
        if i < rounds:
            steps.append(
                f"""s{i} AS (SELECT part, entry, place, sum(c) AS s, count(*) AS n FROM
      (SELECT p.part, a.best[2] AS entry, unnest(x) AS c, unnest(range(len(x))) AS place
       FROM p JOIN a{i} a ON p.r = a.r AND p.part = a.part) GROUP BY ALL)"""
            )
            mean = "((s - ((s % n) + n) % n) // n)::BIGINT"
            steps.append(
                f"""b{i + 1} AS (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{i} b LEFT JOIN
      (SELECT part, entry, list({mean} ORDER BY place) AS e FROM s{i} GROUP BY part, entry) m
      ON b.part = m.part AND b.entry = m.entry)"""
            )
    final = f"a{rounds}"
    return f"""WITH {", ".join(steps)},
  f AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code,
      sum(best[1])::BIGINT AS error FROM {final} JOIN k USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM f"""
