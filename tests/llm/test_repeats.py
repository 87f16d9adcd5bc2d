"""Word and byte windows that repeat, against brute force."""

import numpy as np
import pytest
from corpus import frame, make, rows, substring_counts, suffix_counts

from retailspark.llm import repeats, substring_dedup, suffix_dedup
from retailspark.llm.automaton import SuffixAutomaton


def test_substring_counts(spark):
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.counts(frame(spark)).collect()}
    assert got == substring_counts(make())
    assert any(removed for _, removed, _ in got.values())


@pytest.mark.parametrize("hot", [0, 2])
def test_hot_anchors_give_the_same_words(spark, hot):
    marked = substring_dedup.marked(frame(spark), hot=hot)
    usual = substring_dedup.marked(frame(spark))

    def masks(df):
        return {
            r.doc_id: repeats.unit_mask(len((r.text or "").encode().split()), r._spans, 20).tolist() for r in df.collect()
        }

    assert masks(marked) == masks(usual)


@pytest.mark.parametrize("hot", [0, 3, 20_000])
def test_suffix_counts(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "marked", lambda d, w, f=suffix_dedup.marked: f(d, w, hot=hot))
    values = [r for r in rows() if r[1] is None or len(r[1]) < 50_000]
    got = sorted(map(tuple, suffix_dedup.counts(frame(spark, values)).collect()))
    assert got == suffix_counts([r[:2] for r in values])
    assert any(removed for _, _, removed, _, _ in got)


def test_many_near_copies_in_one_group(spark):
    base = ("x%d " * 200) % tuple(range(200))
    values = [(i, base[: 3 * i % 500] + "#%d#" % i + base[3 * i % 500 :], *["a"] * 2, None, *["b"] * 3) for i in range(120)]
    docs = [v[:2] for v in values]
    assert sorted(map(tuple, suffix_dedup.counts(frame(spark, values)).collect())) == suffix_counts(docs)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.counts(frame(spark, values)).collect()}
    assert got == substring_counts(docs)


@pytest.mark.parametrize("units, window, keep_first", [(repeats.Bytes, 400, 2), (repeats.Words, 20, 1)])
def test_known_spans_of_copies_do_not_share_a_route(spark, units, window, keep_first):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").coalesce(2)
    rows = repeats.routed(docs, units, window, min(8, window), 10_000, keep_first, False).collect()
    known = [r for r in rows if r.kind == repeats.SPAN]
    assert len(known) > 250
    assert len({r.route for r in known}) == len({r.doc_id for r in known}) == len(known)


def test_copies_of_one_text(spark):
    text = " ".join(f"w{i}" for i in range(200))
    values = [(i, text if i % 3 else text[: 900 - i], *["a"] * 2, None, *["b"] * 3) for i in range(120)]
    docs = [v[:2] for v in values]
    assert sorted(map(tuple, suffix_dedup.counts(frame(spark, values)).collect())) == suffix_counts(docs)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.counts(frame(spark, values)).collect()}
    assert got == substring_counts(docs)


def test_remove_repeats_keeps_the_rest(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = ["start\n" + long + "  end", "other " + long + " tail", long, None, "", "short text"]
    values = [(i, t, "en", "s", 1, "k", "x", "y") for i, t in enumerate(texts)]
    kept = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(spark, values)).collect()}
    assert {d: r.text for d, r in kept.items()} == {0: texts[0], 1: "other tail", 3: None, 4: "", 5: "short text"}
    assert kept[1].score == "x" and kept[1].label == "y"
    cut = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(frame(spark, values), 50).collect()}
    assert cut[3] is None and cut[4] == "" and cut[5] == "short text" and 2 not in cut


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    values = [(None, long), (None, None), (7, long), (7, long + " more"), (7, long), (3, long)]
    values = [(*v, "en", "s", 1, "k", "x", "y") for v in values]
    got = sorted(((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.counts(frame(spark, values)).collect()))
    # the row without id comes first; a repeated row counts as one document
    assert got == [(-1, 0, 0), (-1, 40, 0), (3, 40, 40), (7, 40, 40), (7, 40, 40), (7, 41, 40)]
    assert substring_dedup.counts(frame(spark, [])).count() == 0
    assert suffix_dedup.counts(frame(spark, [])).count() == 0
    assert suffix_dedup.counts(frame(spark, values), 100).count() == 6


def test_radix_order_ends_at_the_depth():
    parts = [b"abcdefgh" * 3, b"abcdefgh" * 3 + b"x", b"abcdefgz", b"b", b""]
    order, shared = suffix_dedup.radix_order(suffix_dedup.digits(parts, 24), np.zeros(5, np.int64))
    assert [parts[i][:24].ljust(24, b"\0") for i in order] == sorted(p[:24].ljust(24, b"\0") for p in parts)
    assert shared.tolist() == [-1, 0, 24, 7, 0]


def test_automaton_matches():
    automaton = SuffixAutomaton()
    automaton.add([1, 2, 3, 1, 2, 4])
    automaton.add([2, 4, 5])
    assert [m for _, m, _ in automaton.stream([1, 2, 4, 5, 9, 3, 1, 2])] == [1, 2, 3, 3, 0, 1, 2, 3]
