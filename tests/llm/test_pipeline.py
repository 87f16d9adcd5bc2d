"""The pipeline's stages, each against a plain version on its own input, and awkward rows through all of them."""

import os

import pytest
from corpus import DDL, benchmark_hits, near_components, substring_counts, words
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from retailspark.llm import packing
from retailspark.llm.queries import ORACLE, QUERIES, TOKENIZER

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    home, docs, found = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(home / name))
        after = spark.read.parquet(str(home / name))
        found[name] = docs, after
        docs = after
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_registered_under_their_numbers():
    names = [n for n in entry.queries() if n.startswith("op") and n in QUERIES]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert entry.queries()["pipeline"] is cp.run and set(ORACLE) <= set(QUERIES)
    assert 4 <= len(cp.STAGES) <= 5


def test_columns_stay_until_the_last_stage(steps):
    for name, (before, after) in list(steps.items())[:-1]:
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in before.schema]


def test_language_id_drops_what_has_no_letters(steps):
    before, after = map(texts, steps["language_id"])
    letters = {d for d, t in before.items() if t and any(map(str.isalpha, t))}
    assert set(after) <= letters and len(after) >= 0.99 * len(letters)
    assert all(before[d] == t for d, t in after.items())


def test_near_duplicates(steps):
    before, after = map(texts, steps["near_duplicates"])
    assert after == {d: before[d] for d, (_, _, kept) in near_components(list(before.items())).items() if kept}
    assert len(after) < len(before)


def test_substrings(steps):
    before, after = map(texts, steps["substrings"])
    want = substring_counts(list(before.items()))
    for doc_id, (n, removed, _) in want.items():
        assert (doc_id in after) == (removed < n or n == 0)
        if doc_id in after:
            assert len(words(after[doc_id])) == n - removed
            assert removed or after[doc_id] == before[doc_id]


def test_decontamination(spark, steps):
    before, after = map(texts, steps["decontamination"])
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = benchmark_hits(list(before.items()), items)
    for doc_id, (n, hit, *_) in want.items():
        assert (doc_id in after) == (hit <= cp.MOST_COVERED * n)
        if doc_id in after:
            assert hit or after[doc_id] == before[doc_id]
    left = benchmark_hits([d for d in after.items() if want[d[0]][1]], items)
    assert sum(v[1] for v in left.values()) < sum(v[1] for v in want.values()) or not any(v[1] for v in want.values())


def test_packing(steps):
    before, after = texts(steps["packing"][0]), steps["packing"][1].orderBy("doc_id", "start").collect()
    tokenizer, ids = Tokenizer.from_file(TOKENIZER), {}
    for r in after:
        ids.setdefault(r.doc_id, []).extend(packing.ids_of(r.ids).tolist())
    assert ids == {d: tokenizer.encode(t, add_special_tokens=False).ids + [1] for d, t in before.items()}


def test_run_is_all_stages(spark, steps):
    got = sorted(map(tuple, cp.run(spark, SMALL).drop("sequence_id").collect()))
    assert got == sorted(map(tuple, steps["packing"][1].drop("sequence_id").collect()))


def test_awkward_documents(spark, tmp_path):
    folder = str(tmp_path)
    odd = [(None, "ein Wort und noch eins", "de"), (1, None, "en"), (2, "", None), (3, "1 2 3", "en"), (4, "some words here", "en")]
    odd += [(4, "some words here", "en"), (5, "long " * 40_000, "en"), (6, "Worte ohne Sprache", None)]
    spark.createDataFrame([(*r[:2], r[2], None, None, "k", "x", "y") for r in odd], DDL).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = {r.doc_id for r in cp.run(spark, folder).collect()}
    assert kept >= {None, 4} and not kept & {1, 2, 3}
    empty = str(tmp_path / "none")
    spark.createDataFrame([], DDL).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert cp.run(spark, empty).count() == 0
