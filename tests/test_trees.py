"""Split gains, pruning sequence and out-of-bag estimates."""

import random

from catalogue import params as P, queries as q
from retailspark import columns as C
from retailspark.plans import churn as ch, trees as tr


def prunings(shape):
    """All subtrees, each as a list of the leaf sets that it keeps apart."""

    def leaves(node):
        return [node] if isinstance(node, int) else leaves(node[0]) + leaves(node[1])

    if isinstance(shape, int):
        return [[[shape]]]
    return [[leaves(shape)]] + [a + b for a in prunings(shape[0]) for b in prunings(shape[1])]


def wrong(groups, train, of):
    total = 0
    for group in groups:
        zero, one = (sum(train[leaf][c] for leaf in group) for c in (0, 1))
        total += sum(of[leaf][0 if one > zero else 1] for leaf in group)
    return total


def test_sequence_against_all_subtrees():
    draw = random.Random(5)
    shape = (((0, 1), (2, 3)), ((4, (5, 6)), 7))
    for _ in range(30):
        train, test = ({i: (draw.randint(0, 30), draw.randint(0, 30)) for i in range(8)} for _ in range(2))
        rows = tr.weakest_links(shape, train, test)
        assert [r[0] for r in rows] == sorted({r[0] for r in rows}) and rows[0][0] == 0 and rows[-1][1] == 1
        every = [(wrong(g, train, train), len(g), g) for g in prunings(shape)]
        for alpha, leaves, errors, missed in rows:
            cost, size, best = min(every, key=lambda e: (round(e[0] + alpha * e[1], 9), e[1]))
            assert (errors, leaves) == (cost, size)
            assert missed == wrong(best, train, test)


def test_one_leaf_and_empty_sides():
    assert tr.weakest_links(0, {0: (3, 1)}, {}) == [(0.0, 1, 1, 0)]
    assert tr.weakest_links((0, 1), {}, {}) == [(0.0, 1, 0, 0)]


def steps(spark):
    """Few steps per predictor, so that the fitted tree can try every cut."""
    draw, rows = random.Random(3), []
    for i in range(3000):
        a, b, c, card = draw.randrange(8), draw.randrange(12), draw.randrange(5), draw.choice("UVWXY")
        rows.append((i, a, float(b), c, "R" + str(draw.randrange(3)), "J", card, int(draw.random() < 0.1 + 0.06 * b + 0.2 * (card in "VY"))))
    names = [C.CUSTOMER, *ch.NUMERIC, C.REGION, C.JOB_CLEAN, C.CARD, C.CHURN]
    return spark.createDataFrame(rows, names)


def test_root_split_is_that_of_the_fitted_tree(spark):
    encoder, train, test = ch.training_tables(steps(spark))
    gains = {r.predictor: r for r in tr.split_gains(train).collect()}
    model = ch.decision_tree(train, encoder, max_depth=1)
    root = model._java_obj.rootNode()
    best = max(gains.values(), key=lambda r: r.gain)
    assert best.predictor == [*ch.NUMERIC, *ch.CATEGORICAL][root.split().featureIndex()]
    assert abs(best.gain - root.gain()) < 1e-8
    sizes = {r.n for r in ch.leaf_shares(model, train).collect()}
    assert best.left_rows in sizes and len(sizes) == 2


def test_pruning_of_a_fitted_tree(spark):
    encoder, train, test = ch.training_tables(steps(spark))
    model = ch.decision_tree(train, encoder)
    rows = tr.tree_pruning(model, train, test).orderBy("subtree").collect()
    judged = {n: model.transform(t).where("prediction <> label").count() for n, t in (("train", train), ("test", test))}
    assert rows[0].train_errors == judged["train"]  # alpha 0 keeps all that saves an error
    assert rows[0].leaves <= (model.numNodes + 1) // 2 and rows[-1].leaves == 1
    assert rows[0].train_rows == train.count() and rows[0].test_rows == test.count()
    assert tr.tree_pruning(model, train.limit(0), test.limit(0)).count() == 1


def test_out_of_bag_agrees_with_held_out_rows(spark):
    encoder, train, test = ch.training_tables(steps(spark))
    judged = tr.out_of_bag(train, encoder, trees=15).collect()
    assert len(judged) == train.count()
    weights = {r[0]: r[1] for r in tr.bagged_rows(train, 15, seed=123456).select(C.CUSTOMER, "weights").collect()}
    assert all(r.judges == sum(w == 0 for w in weights[r[0]]) for r in judged)
    assert all((r.prediction is None) == (r.judges == 0) for r in judged)
    seen = [r for r in judged if r.judges]
    share = sum(r.label == r.prediction for r in seen) / len(seen)
    forest = ch.random_forest(train, encoder, trees=15).transform(test)
    held = forest.where("label = prediction").count() / test.count()
    assert abs(share - held) < 0.04


def test_bags_do_not_depend_on_partitions(spark):
    rows = spark.range(500).selectExpr("id", "double(id % 2) AS label")
    one, other = (tr.bagged_rows(r, P.BAGS, "id") for r in (rows, rows.repartition(9)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    assert [tuple(r) for r in tr.bag_sizes(one, P.BAGS).collect()] == [tuple(r) for r in tr.bag_sizes(other, P.BAGS).collect()]


def test_queries_are_registered():
    assert {"split_gains", "tree_pruning", "tree_pruning_ends", "forest_bags", "forest_out_of_bag"} <= set(q.QUERIES)
