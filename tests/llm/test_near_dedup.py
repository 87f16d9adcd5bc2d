"""Near duplicates against all pairs."""

import random

import numpy as np
from corpus import DDL, frame, make, near_components, rows

from pyspark.sql import functions as F

from retailspark.llm import near_dedup
from retailspark.llm.components import components


def test_components_of_pairs(spark):
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(frame(spark)).collect()}
    assert got == near_components(make())
    assert sum(not kept for _, _, kept in got.values()) > 8


def test_chains_and_one_large_group(spark):
    draw = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(150):  # each copy differs elsewhere: some pairs link, others only by way of third ones
        copy = list(base)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(100)] = f"new{i}"
        texts.append(" ".join(copy))
    chain = list(base[::-1])
    for i in range(30):
        texts.append(" ".join(chain))
        chain = chain[2:] + [f"end{i}", f"more{i}"]
    line = " ".join(f"common{i}" for i in range(30))
    texts += [line + " " + " ".join(f"own{i}x{j}" for j in range(25)) for i in range(60)]
    values = [(i, t, "en", "s", 1, "k", "x", "y") for i, t in enumerate(texts)]
    draw.shuffle(values)
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(frame(spark, values)).collect()}
    assert got == near_components([v[:2] for v in values])


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(frame(spark)).collect()}
    assert got == near_components(make())


def test_meetings_between_blocks(spark, monkeypatch):
    """One document in each block: every pair of different texts is a meeting between blocks, none lies in a block."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1)
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(frame(spark)).collect()}
    assert got == near_components(make())


def test_columns_with_internal_names(spark):
    df = frame(spark)
    for name in ("gone", "id", "token", "block", "GONE_"):
        df = df.withColumn(name, F.lit(1))
    kept = near_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert kept.count() == near_dedup.deduplicate(frame(spark)).count()


def test_block_against_itself_equals_all_pairs():
    draw = np.random.default_rng(4)
    base = np.unique(draw.integers(0, 1 << 62, 80, dtype=np.uint64))
    sets = []
    for i in range(120):
        kept = draw.choice(base, len(base) - draw.integers(0, 25), replace=False)
        sets.append(np.unique(np.concatenate([kept, draw.integers(0, 1 << 62, draw.integers(0, 12), dtype=np.uint64)])))
    block = near_dedup._Block([(i, i, x.tobytes(), near_dedup._packed(x)) for i, x in enumerate(sets)])
    links = list(near_dedup._merging(block, block, 75))
    root = list(range(len(sets)))
    for a, b in links:
        assert root[a] != root[b]
        root = [root[a] if r == root[b] else r for r in root]
    want = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and want[a] != want[b]:
                want = [want[a] if r == want[b] else r for r in want]
    assert [[x == y for y in root] for x in root] == [[x == y for y in want] for x in want]
    assert 1 < len(set(want)) < len(sets)


def test_deduplicate_keeps_one_of_each(spark):
    kept = near_dedup.deduplicate(frame(spark))
    assert kept.schema == frame(spark).schema
    want = {d for d, (_, _, k) in near_components(make()).items() if k}
    assert {r.doc_id for r in kept.collect()} == want


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    values = [(None, text), (5, text), (4, text), (4, other), (9, other), (8, None), (7, ""), (5, text)]
    df = spark.createDataFrame([(*v, *[None] * 6) for v in values], DDL)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [
        (-1, 26, None, True),
        (4, 26, 4, True),
        (4, 26, 4, True),
        (5, 26, 4, False),
        (5, 26, 4, False),
        (7, 0, 7, True),
        (8, 0, 8, True),
        (9, 26, 4, False),
    ]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    assert near_dedup.deduplicate(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r.id: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 200)}, 1001: 1000}
