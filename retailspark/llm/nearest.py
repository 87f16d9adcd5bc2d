"""Approximate nearest neighbours by a forest of sorted hash strings (largest inner product).

Each tree hashes a vector to a long bit string, one bit per random hyperplane, and keeps all strings in one sorted
array, dealt over tasks by range. A query descends to its own place in each array, where the strings with the longest
common prefixes lie; it then ascends in all trees at once, taking the neighbours on either side up to the same distance.
How far all ascend is set once per index: so far that a sample of queries, compared with all rows, would reach
``recall`` of its true neighbours.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import bounded_batches
from .repeats import written

#: Trees, and bits of a hash string.
TREES, BITS = 16, 62
#: Rows of a sorted array that one task scores at a time.
BLOCK = 8192
#: Queries compared with all rows to set the ascent: a sample of fixed size.
SAMPLE = 128


def classes(vectors, k):
    """Distinct usable vectors: id (their least vec_id), vector (array<float>) and ids (their k + 1 least vec_ids).

    Vectors null, empty, zero, of another length than most, or with a component that is null or not finite take no
    part, nor does a row without vec_id.
    """
    component = F.col("embedding")
    usable = vectors.select(F.col("vec_id").cast("long"), component.cast("array<float>").alias("v")).where(
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    usual = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return None, 0
    usable = usable.where(F.size("v") == usual["n"]).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float")))
    first = Window.partitionBy("v").orderBy("vec_id")
    ranked = usable.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    grouped = ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return written(grouped.select(F.col("ids")[0].alias("id"), "v", "ids"), "vectors"), usual["n"]


def _matrix(column, width):
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, width)


def _hashed(rows, width, longest, trees, seed):
    """One row per tree and vector: tree, key, id, query, v (binary float32).

    The vectors are lifted to one length, queries stay flat, so that the angle orders like the inner product.
    """
    planes = np.random.default_rng(seed).normal(size=(width + 1, trees * BITS))
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def hash_batch(batches):
        for batch in batches:
            found, n = _matrix(batch.column("v"), width), batch.num_rows
            query = np.asarray(batch.column("query"))
            squares = (found.astype(np.float64) ** 2).sum(axis=1)
            lift = np.where(query, 0.0, np.sqrt(np.maximum(0.0, longest**2 - squares)))
            signs = np.column_stack([found, lift]) @ planes > 0
            keys = signs.reshape(n, trees, BITS) @ weights
            raw = [row.tobytes() for row in found]
            columns = [
                pa.array(np.tile(np.arange(trees, dtype=np.int32), n)),
                pa.array(keys.ravel()),
                pa.array(np.repeat(np.asarray(batch.column("id")), trees)),
                pa.array(np.repeat(query, trees)),
                pa.array(raw, pa.binary()).take(pa.array(np.repeat(np.arange(n), trees))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "key", "id", "query", "v"])

    return rows.select("id", "query", "v").mapInArrow(
        hash_batch, "tree int, key long, id long, query boolean, v binary"
    )


def _arrays(hashed):
    """The sorted arrays: ``hashed`` with the place of each row in the order of (tree, key)."""

    def number(batches):
        at = 0
        for batch in batches:
            yield batch.append_column("at", pa.array(np.arange(at, at + batch.num_rows, dtype=np.int64)))
            at += batch.num_rows

    columns = "tree int, key long, id long, query boolean, v binary, part int, at long"
    ranged = hashed.repartitionByRange("tree", "key", "id", "query").sortWithinPartitions("tree", "key", "id", "query")
    ordered = written(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(number, columns), "forest")
    # one row per task that sorted
    sizes = sorted(map(tuple, ordered.groupBy("part").count().collect()))
    starts = np.cumsum([0] + [n for _, n in sizes]).tolist()
    before = ordered.sparkSession.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, starts)], "part int, before long"
    )
    return ordered.join(F.broadcast(before), "part").select(
        "tree", "id", "query", "v", (F.col("before") + F.col("at")).alias("place")
    )


def _best(scores, ids, k):
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _products(found, query):
    """Inner products in double precision, each summed in the same order wherever it is computed."""
    return (found.astype(np.float64) * query.astype(np.float64)).sum(axis=1)


def _truth(table, sample, width, k):
    """Ids of the true neighbours of a few queries: each batch of rows keeps its best."""
    ids = np.array([r["id"] for r in sample])
    wanted = np.array([r["v"] for r in sample], np.float64)

    def score(batches):
        for batch in batches:
            found, own = _matrix(batch.column("v"), width).astype(np.float64), np.asarray(batch.column("id"))
            out = [[], [], []]
            for query, scores in zip(ids, wanted @ found.T):
                for at in _best(np.where(own == query, -np.inf, scores), own, k):
                    if own[at] != query:
                        for column, value in zip(out, (query, own[at], scores[at])):
                            column.append(value)
            kinds = pa.int64(), pa.int64(), pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["query", "id", "score"])

    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    scored = table.select("id", "v").mapInArrow(score, "query long, id long, score double")
    return scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("query", "id").collect()


def _ascent(table, arrays, width, k, recall, sample):
    """Distance up to which all queries ascend."""
    chosen = (
        table.where("asked").select("id", "v", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(sample).collect()
    )
    pairs = [(r["query"], r["id"]) for r in _truth(table, chosen, width, k)] if chosen else []
    if not pairs:
        return 1
    spark = table.sparkSession
    few = spark.createDataFrame([(i, True) for i in {q for q, _ in pairs}] + [(i, False) for i in {i for _, i in pairs}], "id long, query boolean")
    places = arrays.join(F.broadcast(few), ["id", "query"]).select("id", "query", "tree", "place").collect()
    where = {(r["id"], r["query"], r["tree"]): r["place"] for r in places}
    trees = {r["tree"] for r in places}
    needed = np.sort([min(abs(where[q, True, t] - where[i, False, t]) for t in trees) for q, i in pairs])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def _blocks(arrays, reach, block):
    """Rows of the arrays by block of places, queries in every block that they reach into."""
    spread = F.explode(
        F.when(
            F.col("query"),
            F.sequence(
                F.floor((F.greatest(F.col("place") - reach, F.lit(0))) / block), F.floor((F.col("place") + reach) / block)
            ),
        ).otherwise(F.array(F.floor(F.col("place") / block)))
    )
    dealt = arrays.select("*", spread.alias("block"))
    return dealt.repartition("block").sortWithinPartitions("block", "place")


def _scored(blocks, width, k, reach):
    """Per query, tree and block the best k rows within reach: query, id, score."""

    def score(batches):
        held, current = [], None
        for batch in batches:
            edges = np.asarray(batch.column("block"))
            cuts = np.flatnonzero(np.append(True, edges[1:] != edges[:-1])) if len(edges) else []
            for begin, end in zip(cuts, [*cuts[1:], len(edges)]):
                if held and edges[begin] != current:
                    yield search(pa.Table.from_batches(held))
                    held = []
                current = edges[begin]
                held.append(batch.slice(begin, end - begin))
        if held:
            yield search(pa.Table.from_batches(held))

    def search(table):
        query = np.asarray(table.column("query"))
        place, tree, ids = (np.asarray(table.column(c)) for c in ("place", "tree", "id"))
        raw = b"".join(table.column("v").to_pylist())
        found = np.frombuffer(raw, np.float32).reshape(-1, width)
        rows, asked = np.flatnonzero(~query), np.flatnonzero(query)
        rows = rows[np.argsort(place[rows], kind="stable")]
        vectors, own, at = found[rows].astype(np.float64), ids[rows], place[rows]
        out = [[], [], []]
        for i in range(0, len(asked), 64):
            some = asked[i : i + 64]
            low = np.searchsorted(at, place[some] - reach, "left")
            high = np.searchsorted(at, place[some] + reach, "right")
            begin, end = int(low.min()), int(high.max())
            if end <= begin:
                continue
            scores = found[some].astype(np.float64) @ vectors[begin:end].T
            for j, (q, a, b) in enumerate(zip(some, low, high)):
                in_tree = tree[rows[a:b]] == tree[q]
                near = np.where(in_tree, scores[j, a - begin : b - begin], -np.inf)
                near[own[a:b] == ids[q]] = -np.inf  # added for all queries in the end: it may hold copies
                best = _best(near, own[a:b], k + 8)
                best = best[near[best] > -np.inf]
                exact = _products(found[rows[a:b][best]], found[q])
                out[0].append(np.full(len(best), ids[q]))
                out[1].append(own[a:b][best])
                out[2].append(exact)
        columns = [np.concatenate(c) if c else np.empty(0) for c in out]
        kinds = pa.int64(), pa.int64(), pa.float64()
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds)], ["query", "id", "score"])

    return blocks.mapInArrow(score, "query long, id long, score double")


def _own(table, width):
    """Each query's own vector, which other rows may hold too."""

    def score(batches):
        for batch in batches:
            found, ids = _matrix(batch.column("v"), width), batch.column("id")
            yield pa.RecordBatch.from_arrays([ids, ids, pa.array(_products(found, found))], ["query", "id", "score"])

    return table.where("asked").select("id", "v").mapInArrow(score, "query long, id long, score double")


def nearest(vectors, is_query, k=20, recall=0.97, trees=TREES, seed=3):
    """The k nearest found of each query row: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. Candidates are all rows but the
    query's own. Nearness is the inner product of the original vectors in double precision; ties go to the smaller
    vec_id. Equal vectors are one row of the index, with their k + 1 least ids, so a vector that a third of all rows
    hold costs one row. Rows that are equal in vec_id and vector count once. See ``classes`` for rows that take no
    part; with fewer than k candidates a query gets all of them that the search reaches. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table, width = classes(vectors, k)
    if table is None:
        return empty
    queries = (
        vectors.where(is_query & F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("v"))
        .withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float")))
        .distinct()
    )
    asked = written(queries.join(table.select("v", "id"), "v").select("query_id", "id"), "queries")
    table = table.join(asked.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left")
    table = written(table.withColumn("asked", F.coalesce("asked", F.lit(False))), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = table.agg(F.sqrt(F.max(squares))).first()[0]
    if longest is None:
        return empty
    rows = table.select("id", "v", F.lit(False).alias("query")).unionByName(
        table.where("asked").select("id", "v", F.lit(True).alias("query"))
    )
    arrays = _arrays(_hashed(rows, width, longest, trees, seed))
    reach = _ascent(table, arrays, width, k, recall, SAMPLE)
    found = _scored(_blocks(arrays, reach, BLOCK), width, k, reach).dropDuplicates(["query", "id"])
    found = found.unionByName(_own(table, width))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = written(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "found")
    expanded = (
        found.join(table.select("id", "ids"), "id")
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .join(asked.select(F.col("id").alias("query"), "query_id"), "query")
        .where(F.col("vec_id") != F.col("query_id"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = expanded.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
