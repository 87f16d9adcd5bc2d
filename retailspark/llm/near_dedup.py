"""Near-duplicate documents by an inverted join over signature coordinates.

A document's signature has ``COORDINATES`` values, the least hash of its shingles under as many hash functions. Each
coordinate with its value is a token under which the document is posted. Two documents whose sets are similar enough
agree in ``MATCHES`` tokens at least; so each posts only its rarest tokens, one more than may be missing (the prefix),
and the common ones are skipped. Documents that meet are compared on their full sets.

No large group is written out as pairs. A document's home is one of the most common tokens of its prefix, and the
documents of a home are dealt into blocks of bounded size. Near copies mostly have one home, so few pairs of blocks hold
all their pairs. A task gets a pair of blocks, each document once, counts agreeing coordinates as a matrix, compares the
sets of those pairs that agree often enough and are not linked yet, and puts out only links that merge. Each block first
meets itself and the first block of its home, which joins a group of true copies at linear cost. Then all blocks meet
that have documents of different components under one token of their prefixes; where two blocks have fewer such meetings
than documents, the meetings are compared one by one instead.

A pair whose similarity is exactly 0.75 agrees in fewer than ``MATCHES`` coordinates, and is missed, with a probability
below one in a million; more similar pairs far more rarely. All else is exact, up to equal 64-bit hashes of shingles.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .common import Rolling, bounded_batches, free_name, utf8
from .components import components
from .repeats import WordCodes, written

#: Hash functions, and agreeing coordinates a pair must have. For two sets of similarity 0.75, fewer than 30 of 64
#: agree with a probability below one in a million, and for closer ones far less often.
COORDINATES, MATCHES = 64, 30
#: Words of a shingle.
SHINGLE = 5
#: Documents and shingles of a block.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 20
#: Documents of one block whose coordinates are compared with another block at a time.
STRIPE = 256

_draw = np.random.default_rng(20_24)
_TIMES = _draw.integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


class Shingler:
    """Sets of hashed shingles: 5 consecutive words, A-Z in lower case; fewer words are one shingle."""

    def __init__(self):
        self.codes, self.rolling = WordCodes(), Rolling()

    def set_of(self, raw):
        words = raw.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        codes = np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))
        return np.unique(self.rolling.windows(codes, min(SHINGLE, len(words))))


def signature(hashes):
    """Upper halves of the least values of all hash functions."""
    least = np.full(COORDINATES, ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048, None] * _TIMES + _PLUS).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4")


def described(docs):
    """Per row of ``docs``: doc_id, n_shingles, and of a set that is not empty its digest and signature."""

    def describe(batches):
        shingler = Shingler()
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for raw in utf8(batch):
                found = shingler.set_of(raw)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found).tobytes() if len(found) else None)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64())]
            columns += [pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "signature"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(describe, "doc_id long, n_shingles long, digest binary, signature binary")


def _postings(sets):
    """Tokens (coordinate and value) of each set."""

    def post(batches):
        for batch in batches:
            n = batch.num_rows
            raw = b"".join(batch.column("signature").to_pylist())
            values = np.frombuffer(raw, "<u4").reshape(n, COORDINATES).astype(np.int64)
            tokens = (values + (np.arange(COORDINATES, dtype=np.int64) << 32)).ravel()
            columns = [np.repeat(np.asarray(batch.column(c)), COORDINATES) for c in ("id", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens, *columns)], ["token", "id", "n"])

    return sets.select("id", "n", "signature").mapInArrow(post, "token long, id long, n long")


def _prefixes(sets):
    """Prefix and home of each set: all pairs that agree in MATCHES tokens meet under a token of both prefixes.

    Tokens of one document only come first in the order of rarity and lead nowhere, so the prefix is taken from the
    shared ones, and a document that shares fewer than MATCHES has none. The home is drawn by hash among the prefix's
    tokens that are at least half as frequent as its most frequent one, so near copies mostly draw the same.
    """
    postings = _postings(sets)
    shared = postings.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    tokens = F.array_sort(F.collect_list(F.struct("often", "token")))
    found = (
        postings.join(shared, "token")
        .groupBy("id", "n")
        .agg(tokens.alias("tokens"))
        .where(F.size("tokens") >= MATCHES)
        .withColumn("rarest", F.slice("tokens", F.lit(1), F.size("tokens") - (MATCHES - 1)))
    )
    most = F.element_at("rarest", -1)["often"]
    common = F.filter("rarest", lambda t: 2 * t["often"] >= most)
    home = F.array_min(F.transform(common, lambda t: F.struct(F.xxhash64(t["token"]).alias("h"), t["token"])))
    return found.select("id", "n", F.col("rarest.token").alias("prefix"), home["token"].alias("home"))


def _dealt(prefixes):
    """``prefixes`` with block and first, the first block of the home; a home has as many blocks as its size asks for."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    homes = prefixes.groupBy("home").agg(blocks.alias("blocks"))
    salt = F.pmod(F.xxhash64("id"), F.col("blocks"))
    return prefixes.join(homes, "home").select(
        "id", "n", "prefix", F.xxhash64("home", salt).alias("block"), F.xxhash64("home", F.lit(0).cast("long")).alias("first")
    )


def _close(a, b, similarity):
    """Sizes that allow the similarity."""
    return 100 * F.least(a, b) >= similarity * F.greatest(a, b)


def _confirmed(pairs, sets, similarity):
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""

    def confirm(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= similarity * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b"
    )
    return joined.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def _agreeing(pairs, sets):
    """Those of ``pairs`` whose signatures agree in MATCHES coordinates."""

    def agree(batches):
        for batch in batches:
            n = batch.num_rows
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(n, COORDINATES) for c in ("x", "y")
            )
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= MATCHES))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b"
    )
    return joined.select("a", "b", "x", "y").mapInArrow(agree, "a long, b long").distinct()


class _Block:
    """Documents of one block in a task."""

    def __init__(self, rows):
        self.ids, self.labels, sets, signatures = map(list, zip(*rows))
        self.sets = [np.frombuffer(x, np.uint64) for x in sets]
        self.sizes = np.array([len(x) for x in self.sets])
        self.signatures = np.frombuffer(b"".join(signatures), "<u4").reshape(-1, COORDINATES)


def _merging(one, other, similarity):
    """Links (a, b) between documents of two blocks, or of one, that join different components."""
    same = one is other
    label = np.unique(one.labels if same else one.labels + other.labels, return_inverse=True)[1]
    labels_there = label if same else label[len(one.ids) :]  # a view, so it follows
    numbers = None
    for at in range(0, len(one.ids), STRIPE):
        stripe = slice(at, min(at + STRIPE, len(one.ids)))
        agreeing = np.zeros((stripe.stop - at, len(other.ids)), np.uint8)
        for mine, theirs in zip(one.signatures[stripe].T, np.ascontiguousarray(other.signatures.T)):
            agreeing += mine[:, None] == theirs
        small = np.minimum(one.sizes[stripe, None], other.sizes)
        large = np.maximum(one.sizes[stripe, None], other.sizes)
        agreeing = (agreeing >= MATCHES) & (100 * small >= similarity * large)
        for i in range(at, stripe.stop):
            there = np.flatnonzero(agreeing[i - at] & (labels_there != label[i]))
            there = there[there > i] if same else there
            if not len(there):
                continue
            if numbers is None:  # shingles as numbers from 0
                sets = one.sets if same else one.sets + other.sets
                numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
                ends = np.cumsum([len(x) for x in sets])
                held = np.zeros(numbers.max() + 1, bool)
                skip = 0 if same else len(one.ids)
            mine = numbers[ends[i] - one.sizes[i] : ends[i]]
            held[mine] = True
            theirs = [numbers[ends[skip + j] - other.sizes[j] : ends[skip + j]] for j in there]
            starts = np.cumsum([0] + [len(x) for x in theirs[:-1]])
            both = np.add.reduceat(held[np.concatenate(theirs)].astype(np.int64), starts)
            held[mine] = False
            linked = there[100 * both >= similarity * (one.sizes[i] + other.sizes[there] - both)]
            for j in linked:
                if labels_there[j] != label[i]:
                    yield one.ids[i], other.ids[j]
                    label[label == labels_there[j]] = label[i]


def _linked(pairs, members, found, similarity):
    """Links that merge components of ``found``, of documents in the ``pairs`` (p, q) of blocks."""

    def met(batches):
        key, held = None, {}

        def links():
            blocks = [_Block(list(rows.values())) for rows in held.values()]
            ends = list(_merging(blocks[0], blocks[-1], similarity)) if blocks else []
            a, b = zip(*ends) if ends else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for p, q, block, id_, label, full, sig in zip(*(c.to_pylist() for c in batch.columns)):
                if (p, q) != key:
                    yield links()
                    key, held = (p, q), {}
                held.setdefault(block, {})[id_, sig] = (id_, label, full, sig)  # repeated rows once
        yield links()

    sides = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    rows = (
        members.join(found, "id", "left")
        .join(sides, "block")
        .select("p", "q", "block", "id", F.coalesce("root", "id").alias("label"), "set", "signature")
    )
    return rows.repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(met, "a long, b long")


def _meetings(dealt, found):
    """Meetings (token, p, q) of blocks under a token that holds documents of different components in them."""
    label = F.coalesce("root", "id").alias("label")
    posted = dealt.join(found, "id", "left").select("block", label, F.explode("prefix").alias("token"))
    under = posted.groupBy("token", "block").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = under.groupBy("token").agg(F.min("lo").alias("least"), F.max("hi").alias("greatest"), F.count("*").alias("k"))
    under = under.join(mixed.where("k > 1 and least < greatest").select("token"), "token")
    there = under.toDF("token", "q", "d", "lo_", "hi_")
    one = (F.col("lo") == F.col("hi")) & (F.col("lo_") == F.col("hi_")) & (F.col("lo") == F.col("lo_"))
    met = under.join(there, "token").where((F.col("block") < F.col("q")) & ~one)
    return met.select("token", F.col("block").alias("p"), "q", (F.col("c") * F.col("d")).alias("times"))


def _single(meetings, dealt, found, similarity):
    """Pairs (a, b) of documents of different components behind ``meetings``."""
    label = F.coalesce("root", "id").alias("label")
    posted = dealt.join(found, "id", "left").select("id", "n", "block", label, F.explode("prefix").alias("token"))
    a = posted.select("token", F.col("block").alias("p"), F.col("id").alias("a"), "n", "label")
    b = posted.select(
        "token", F.col("block").alias("q"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("label").alias("other")
    )
    met = meetings.select("token", "p", "q").join(a, ["token", "p"]).join(b, ["token", "q"])
    return met.where((F.col("label") != F.col("other")) & _close(F.col("n"), F.col("m"), similarity)).select("a", "b").distinct()


def near_duplicates(docs, similarity=75):
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Documents are linked if 100 * intersection >= ``similarity`` * union of their sets of distinct 5-word shingles; a
    component is all that links reach, and its id is its smallest doc_id. kept says that a row's doc_id is that id.

    Null texts and texts without words have an empty set and stand alone. Rows of one doc_id are one node, whatever
    their texts; a null doc_id is linked with nothing, has no component and is kept. Documents with equal sets are
    one to all steps, so exact copies cost one row each. ``similarity`` below 75 would need a larger signature and
    is refused.
    """
    if not 75 <= similarity <= 100:
        raise ValueError("similarity must be from 75 to 100 percent")
    bounded_batches(docs.sparkSession)
    rows = written(described(docs), "signatures")
    valid = rows.where("doc_id is not null and digest is not null")
    classes = valid.groupBy("digest").agg(F.min("doc_id").alias("id"))
    sets = written(
        valid.join(classes.withColumnRenamed("id", "doc_id"), ["digest", "doc_id"], "left_semi")
        .select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "signature", "digest")
        .dropDuplicates(["id", "digest"]),
        "classes",
    )
    members = valid.select("doc_id", "digest").join(sets.select("digest", "id"), "digest")
    # a doc_id with several texts links their classes
    several = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.collect_set("id").alias("b"))
    links = several.where(F.size("b") > 1).select("a", F.explode("b").alias("b"))
    labels = _labels(docs, sets, links, similarity)
    component = (
        rows.select("doc_id", "n_shingles", "digest")
        .join(sets.select("digest", "id"), "digest", "left")
        .join(labels, "id", "left")
    )
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "id", "doc_id"))
    return component.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _labels(docs, sets, links, similarity):
    """Rows (id, root) of the classes that are not the least of their component."""
    dealt = written(_dealt(_prefixes(sets)), "prefixes")
    # short rows of their own: while they are few, Spark knows it and broadcasts them rather than shuffle texts
    blocks = written(dealt.drop("prefix"), "blocks")
    found = written(components(links), "labels")
    if blocks.isEmpty():
        return found

    def shingle(batches):
        shingler = Shingler()
        for batch in batches:
            found = [shingler.set_of(raw) for raw in utf8(batch)]
            columns = [batch.column("id"), pa.array([len(x) for x in found], pa.int64())]
            columns += [pa.array([f(x) for x in found], pa.binary()) for f in (np.ndarray.tobytes, _packed)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "set", "signature"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = texts.join(blocks.select("id"), "id", "left_semi")
    full = texts.mapInArrow(shingle, "id long, n long, set binary, signature binary")
    members = written(full.join(blocks.select("id", "n", "block"), ["id", "n"]), "members")

    sizes = blocks.groupBy("block").agg(F.count("*").alias("rows"), F.min("first").alias("first"))
    own = sizes.where("rows > 1").select(F.col("block").alias("p"), F.col("block").alias("q"))
    star = sizes.where("block <> first").select(F.least("block", "first").alias("p"), F.greatest("block", "first").alias("q"))
    found = _merged(found, written(_linked(own.unionByName(star), members, found, similarity), "links"))

    meetings = written(_meetings(dealt, found).join(star, ["p", "q"], "left_anti"), "meetings")
    if meetings.isEmpty():
        return found
    sizes = sizes.select("block", "rows")
    pairs = (
        meetings.groupBy("p", "q")
        .agg(F.sum("times").alias("times"))
        .join(sizes.toDF("p", "rows"), "p")
        .join(sizes.toDF("q", "rows_"), "q")
        .select("p", "q", (F.col("times") >= F.col("rows") + F.col("rows_")).alias("whole"))
    )
    pairs = written(pairs, "block-pairs")
    found = _merged(found, written(_linked(pairs.where("whole").drop("whole"), members, found, similarity), "links"))
    rest = meetings.join(pairs.where("not whole"), ["p", "q"], "left_semi")
    near = written(_agreeing(_single(rest, dealt, found, similarity), members), "pairs")
    return _merged(found, written(_confirmed(near, members, similarity), "links"))


def _packed(hashes):
    return signature(hashes).tobytes()


def _merged(found, links):
    """Labels after more links."""
    edges = found.toDF("a", "b").unionByName(links)
    return written(components(edges), "labels")


def deduplicate(docs, similarity=75):
    """``docs`` with one document of each component, the one with the smallest doc_id; see ``near_duplicates``.

    All columns stay, whatever their names. Repeated rows of a doc_id stay or go together; a null doc_id stays.
    """
    name = free_name(docs, "gone")
    gone = near_duplicates(docs, similarity).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
