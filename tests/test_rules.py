import random

import pytest

from retailspark.operators import rules as rl


def frame(spark, data):
    schema = "antecedent array<string>, consequent array<string>, support double, confidence double, lift double"
    return spark.createDataFrame(data, schema)


def brute_redundant(data):
    def order(r):
        return (-r[2], len(set(r[0]) | set(r[1])), -r[3], r[0], r[1])

    ranked = sorted(data, key=order)
    out, sets = {}, []
    for r in ranked:
        s = frozenset(r[0]) | frozenset(r[1])
        out[tuple(r[0]), tuple(r[1])] = any(earlier <= s for earlier in sets)
        sets.append(s)
    return out


def random_rules(seed, n, largest):
    rng = random.Random(seed)
    support = {}
    data = {}
    for _ in range(n):
        s = tuple(sorted(rng.sample("abcdefghij", rng.randint(2, largest))))
        support.setdefault(s, 1.0 / (2 ** len(s)))  # larger sets have less support
        c = rng.choice(s)
        left = tuple(x for x in s if x != c)
        data[left, c] = (list(left), [c], support[s], rng.choice([0.5, 0.6, 0.7]), rng.random() * 5)
    return list(data.values())


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_redundancy_equals_brute_force(spark, seed):
    data = random_rules(seed, 60, 7)
    got = {(tuple(r.antecedent), tuple(r.consequent)): r.redundant for r in rl.redundant(frame(spark, data)).collect()}
    want = brute_redundant(data)
    assert got == want and any(want.values()) and not all(want.values())


def test_pruned_rules_contain_no_other(spark):
    kept = rl.prune(frame(spark, random_rules(3, 80, 6))).collect()
    sets = [frozenset(r.antecedent) | frozenset(r.consequent) for r in kept]
    assert len(set(sets)) == len(sets)
    assert not any(a < b for a in sets for b in sets)


DATA = [
    (["a"], ["b"], 0.3, 0.9, 2.0),
    (["b"], ["a"], 0.3, 0.8, 2.0),
    (["a", "b"], ["c"], 0.1, 0.95, 3.0),
    (["x"], ["y"], 0.2, 0.85, 1.5),
]


def test_order_and_top(spark):
    r = frame(spark, DATA)
    assert [x.antecedent for x in rl.sort_rules(r).collect()] == [["a"], ["b"], ["x"], ["a", "b"]]
    assert [x.antecedent for x in rl.top_rules(r, "lift", 2).collect()] == [["a", "b"], ["a"]]
    assert rl.top_rules(r, k=99).count() == 4


def test_prune_and_report_tables(spark):
    kept = rl.prune(frame(spark, DATA))
    assert sorted(x.antecedent for x in kept.collect()) == [["a"], ["x"]]
    assert [x.lift for x in rl.rule_points(kept, 1).collect()] == [2.0]
    grid = rl.rule_grid(kept, wide=True)
    assert sorted(grid.columns) == ["lhs", "{b}", "{y}"] and grid.count() == 2
    nodes, edges = rl.rule_edges(kept)
    assert sorted((n.node, n.kind) for n in nodes.collect()) == [
        ("a", "item"), ("b", "item"), ("x", "item"), ("y", "item"), ("{a} => {b}", "rule"), ("{x} => {y}", "rule"),
    ]
    assert ("a", "{a} => {b}") in [(e.source, e.target) for e in edges.collect()] and edges.count() == 4


def test_summary(spark):
    got = {(r.section, r.name): r.value for r in rl.rule_summary(frame(spark, DATA)).collect()}
    assert got["total", "rules"] == 4 and got["size", "2"] == 3 and got["size", "3"] == 1
    assert got["lift", "max"] == 3.0 and got["lift", "mean"] == pytest.approx(2.125) and got["support", "median"] == pytest.approx(0.25)
