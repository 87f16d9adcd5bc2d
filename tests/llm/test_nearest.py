"""Nearest neighbours against brute force."""

import numpy as np

from retailspark.llm import nearest


def brute(values, k, step=20):
    usable = [(i, np.array(v, np.float32)) for i, v in values if i is not None and v and None not in v]
    usable = [(i, v) for i, v in usable if len(v) == 8 and np.isfinite(v).all() and v.any()]
    rows = {(i, v.tobytes()): (i, v) for i, v in usable}.values()
    out = {}
    for q, x in rows:
        if q % step == 0:
            scores = [(-(v.astype(float) * x.astype(float)).sum(), i) for i, v in rows if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def table(spark, values):
    return spark.createDataFrame(values, "vec_id long, embedding array<float>, label int").repartition(5)


def test_recall_ties_and_odd_vectors(spark):
    draw = np.random.default_rng(1)
    centers = draw.normal(size=(12, 8))
    values = [(i, (centers[i % 12] * (1 + i % 3) + 0.3 * draw.normal(size=8)).astype(np.float32).tolist()) for i in range(1200)]
    values += [(2000 + i, values[40][1]) for i in range(90)]  # one vector many times, five of them queries
    values += [(3000, None), (3020, [0.0] * 8), (3040, [float("nan")] + [1.0] * 7), (3060, [None] + [1.0] * 7), (3080, []), (3100, [1.0] * 5)]
    values += [(None, [1.0] * 8), (3120, [float("inf")] + [1.0] * 7), values[20]]
    df = table(spark, [(*v, 1) for v in values])
    got = {}
    for r in nearest.nearest(df, df.vec_id % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(values, 20)
    assert got.keys() == want.keys()
    hits = 0
    for query, rows in want.items():
        mine = sorted(got[query])
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1)) and query not in {i for _, i, _ in mine}
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len({i for i, _ in rows} & {i for _, i, _ in mine})
    assert hits >= 0.9 * sum(map(len, want.values()))
    same = [i for _, i, _ in sorted(got[2000])]
    assert same == [i for i, _ in want[2000]]  # copies: the least ids, exactly
    assert all(abs(a[1] - b[2]) < 1e-12 for a, b in zip(want[2000], sorted(got[2000])))


def test_few_and_no_vectors(spark):
    few = table(spark, [(i, [float(i), 1.0], 0) for i in range(4)])
    rows = sorted(map(tuple, nearest.nearest(few, few.vec_id % 20 == 0, 20).collect()))
    assert [r[:3] for r in rows] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert nearest.nearest(few.limit(0), few.vec_id == 0).count() == 0
    assert nearest.nearest(few, few.vec_id == 77).count() == 0
    assert nearest.nearest(few.where("vec_id = 0"), few.vec_id == 0).count() == 0
