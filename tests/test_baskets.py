import random
from itertools import combinations

import pytest
from tables import rows, tickets

from retailspark import columns as C
from retailspark.operators import baskets as bk
from retailspark.operators import rules as rl
from retailspark.sources import read_baskets, write_baskets

BASKETS = [
    ["a", "b", "c"], ["a", "b"], ["a", "b", "d"], ["a", "c"], ["b"], ["a", "b", "c", "d"], ["d"], ["a", "b", "c"],
]


def frame(spark, baskets):
    return spark.createDataFrame([(i, sorted(b)) for i, b in enumerate(baskets)], "basket int, items array<string>")


def lines(spark, baskets):
    return spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b], "basket int, item string")


def brute_sets(baskets, support):
    sets = [frozenset(b) for b in baskets]
    items = sorted(set().union(*sets))
    counts = {}
    for size in range(1, len(items) + 1):
        for s in combinations(items, size):
            n = sum(set(s) <= b for b in sets)
            if n >= support * len(sets) and n > 0:
                counts[s] = n
    return counts


def brute_rules(baskets, support, confidence, max_len=None):
    counts, total, out = brute_sets(baskets, support), len(baskets), {}
    for s, n in counts.items():
        if len(s) < 2 or (max_len and len(s) > max_len):
            continue
        for c in s:
            left = tuple(x for x in s if x != c)
            conf = n / counts[left]
            if conf >= confidence:
                out[left, (c,)] = (n / total, conf, conf / (counts[(c,)] / total))
    return out


def as_dict(df):
    return {(tuple(r.antecedent), tuple(r.consequent)): (r.support, r.confidence, r.lift) for r in df.collect()}


def close(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])


def random_baskets(seed, n=200, kinds="abcdefgh"):
    rng = random.Random(seed)
    return [rng.sample(kinds, rng.randint(1, 5)) for _ in range(n)]


def test_baskets_are_sets_per_customer_and_moment(spark):
    t = tickets(
        spark,
        [
            ("c1", "t1", "x", "2019-01-01", 1, 1, 0),
            ("c1", "t2", "y", "2019-01-01", -1, 1, 0),
            ("c1", "t2", "x", "2019-01-01", 1, 1, 0),
            ("c1", "t3", "z", "2019-01-02", 1, 1, 0),
            ("c2", "t4", None, "2019-01-02", 1, 1, 0),
        ],
    )
    b = bk.baskets(t)
    assert sorted((r[C.CUSTOMER], r["items"]) for r in b.collect()) == [("c1", ["x", "y"]), ("c1", ["z"]), ("c2", [])]
    assert bk.basket_lines(t).count() == 4  # the basket without articles keeps a row
    assert bk.frequent_items(bk.basket_lines(t))[1] == 3


def test_frequencies_and_summary(spark):
    b = lines(spark, BASKETS)
    assert [tuple(r) for r in bk.item_frequency(b, 2).collect()] == [("a", 6), ("b", 6)]
    got = {(r["section"], r["name"]): r["value"] for r in bk.basket_summary(b, ["basket"]).collect()}
    assert got["total", "baskets"] == 8 and got["total", "items"] == 4
    assert got["total", "density"] == pytest.approx(19 / 32)
    assert got["size", "1"] == 2 and got["size", "4"] == 1 and got["size quantile", "median"] == 2.5
    assert got["item", "c"] == 4


@pytest.mark.parametrize("support, confidence", [(0.25, 0.5), (0.5, 0.8), (0.125, 0.1)])
def test_rules_equal_brute_force(spark, support, confidence):
    want = brute_rules(BASKETS, support, confidence)
    close(as_dict(rl.rules(frame(spark, BASKETS), support, confidence)), want)
    close(as_dict(rl.rules_of_lines(lines(spark, BASKETS), ["basket"], support, confidence)), want)


def test_rules_on_random_baskets(spark):
    baskets = random_baskets(3)
    want = brute_rules(baskets, 0.03, 0.2)
    assert any(len(a) == 3 for a, _ in want)
    got = as_dict(rl.rules_of_lines(lines(spark, baskets), ["basket"], 0.03, 0.2))
    close(got, want)
    for (_, c), (s, conf, lift) in got.items():
        assert s <= conf and lift == pytest.approx(conf / (sum(c[0] in b for b in baskets) / len(baskets)))
    short = as_dict(rl.rules(frame(spark, baskets), 0.03, 0.2, max_len=2))
    close(short, brute_rules(baskets, 0.03, 0.2, max_len=2))


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_pair_rules_for_any_block_size(spark, block):
    baskets = [*random_baskets(4), list("abcdefgh"), list("abcdefgh")]
    want = brute_rules(baskets, 0.03, 0.2, max_len=2)
    close(as_dict(rl.pair_rules(lines(spark, baskets), ["basket"], 0.03, 0.2, block=block)), want)


def test_pairs_of_one_huge_basket(spark):
    many = [f"i{n:04d}" for n in range(300)]
    baskets = [many, many, many[:150], ["x"]]
    pairs, _, _ = rl.pair_counts(lines(spark, baskets), ["basket"], 0.5, block=64)
    counted = pairs.groupBy("n").count()
    assert rows(counted) == [(2, 300 * 299 // 2 - 150 * 149 // 2), (3, 150 * 149 // 2)]


def test_no_rules(spark):
    assert rl.rules(frame(spark, [["a"], ["b"]]), 0.5, 0.8).count() == 0
    assert rl.rules_of_lines(lines(spark, [["a"], ["b"], ["c"]]), ["basket"], 0.9, 0.8).count() == 0
    assert rl.rules(frame(spark, []), 0.5, 0.8).count() == 0


def test_files_hold_items_only(spark, tmp_path):
    path = str(tmp_path / "b")
    write_baskets(frame(spark, BASKETS), path)
    assert sorted(r[0] for r in spark.read.text(path).collect()) == sorted(",".join(sorted(b)) for b in BASKETS)
    back = read_baskets(spark, path)
    assert sorted(r["items"] for r in back.collect()) == sorted(sorted(b) for b in BASKETS)
    assert back.select("basket").distinct().count() == len(BASKETS)
    with pytest.raises(Exception, match="separator"):
        write_baskets(frame(spark, [["a,b"]]), str(tmp_path / "c"))


def test_repeated_items_in_a_file(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.createDataFrame([("b,a,b",), ("",)], "value string").write.text(path)
    assert sorted(r["items"] for r in read_baskets(spark, path).collect()) == [[], ["a", "b"]]


def test_baskets_without_items_count_alike(spark, tmp_path):
    day = "2019-01-01"
    t = tickets(
        spark,
        [("c1", "t1", "x", day, 1, 1, 0), ("c1", "t1", "y", day, 1, 1, 0), ("c2", "t2", "x", day, 1, 1, 0)]
        + [("c2", "t2", "y", day, 1, 1, 0), ("c3", "t3", None, day, 1, 1, 0)],
    )
    by_lines = as_dict(rl.rules_of_lines(bk.basket_lines(t)))
    assert by_lines[("x",), ("y",)] == pytest.approx((2 / 3, 1.0, 1.5))
    close(as_dict(rl.rules(bk.baskets(t))), by_lines)
    close(as_dict(rl.pair_rules(bk.basket_lines(t))), by_lines)
    write_baskets(bk.baskets(t), str(tmp_path / "f"))
    close(as_dict(rl.rules(read_baskets(spark, str(tmp_path / "f")))), by_lines)


def test_article_lists_keep_repeats(spark):
    day = "2019-01-01"
    t = tickets(spark, [("c1", "t1", a, day, 1, 1, 0) for a in ("y", "x", "y", None)] + [("c2", "t2", None, day, 1, 1, 0)])
    assert sorted((r[C.CUSTOMER], r["items"]) for r in bk.article_lists(t).collect()) == [("c1", "x,y,y"), ("c2", "")]


@pytest.mark.parametrize("max_len", [1, 2, 3, 4])
def test_mining_by_levels(spark, max_len):
    baskets = [*random_baskets(6), *[list("abcd")] * 20]
    sets, total = bk.itemsets(frame(spark, baskets), 0.03, max_len)
    assert total == len(baskets)
    got = {tuple(r["items"]): r["freq"] for r in sets.collect()}
    assert got == {s: n for s, n in brute_sets(baskets, 0.03).items() if len(s) <= max_len}
