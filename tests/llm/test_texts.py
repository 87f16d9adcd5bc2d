"""Licences, packing, languages, token counts, quality and decontamination."""

import os
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from corpus import DDL, benchmark_hits, frame, make, rows
from tokenizers import Tokenizer

from retailspark.llm import decontamination, language, licenses, packing, quality, token_counts
from retailspark.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_fast_ids_are_the_librarys(reference):
    encoder = Encoder(PATH)
    assert encoder.fast
    odd = ["a  b", "a\n b", " ", "\na \n", "a\tb", "\x1c a\x1c", "a\xa0b c\xa0 d", "a\x85 b", "é à  ", "it's I'LL 12 34", "日本 語 　"]
    odd += ["½²³ªº¹ ʼn ǅ", "I’ve “x” …€–—", "a" * 3000, " " * 500 + "x", "a\0 b", "x<|endoftext|> y", "<|endoftext|>"]
    for text in odd + [t or "" for _, t in make()]:
        assert encoder.ids(text) == array("I", reference(text)).tobytes(), text[:50]


def test_other_tokenizers_count(spark):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = frame(spark, rows()[:30])
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, model).collect()} == {
        r[0]: len(processor.encode(r[1])) for r in rows()[:30]
    }
    words = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(words)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, words).collect()} == {
        r[0]: len(whole.encode(r[1], add_special_tokens=False).ids) for r in rows()[:30]
    }


def test_pieces_are_an_exact_cut(spark, reference):
    found = packing.pieces(frame(spark, rows()[:-1]), PATH).collect()
    by_doc = {}
    for r in found:
        assert r.length == 1 << r.bucket <= 2048 and r.offset == 0 and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in found}) == len(found)
    for doc_id, text in make():
        mine = sorted(by_doc[doc_id], key=lambda r: r.start)
        ids = [i for r in mine for i in packing.ids_of(r.ids).tolist()]
        assert ids == reference(text) + [1]
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        assert {r.doc_tokens for r in mine} == {len(ids)}


def test_buckets_hold_one_length(spark, tmp_path):
    packing.write_buckets(packing.pieces(frame(spark), PATH), str(tmp_path / "b"), shards=2)
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("length <> shiftleft(1L, bucket)").count() == 0
    assert back.count() == packing.pieces(frame(spark), PATH).count()


def test_piece_limits(spark):
    assert packing.binary_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    with pytest.raises(ValueError):
        packing.pieces(frame(spark), PATH, longest=1000)
    assert packing.pieces(frame(spark, []), PATH).count() == 0


def test_token_counts_and_cache(spark, reference, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    values = rows()
    half = token_counts.token_counts(frame(spark, values[:40]), PATH, cache)
    want = {d: (len((t or "").encode()), len(reference(t))) for d, t in make()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in half.collect()} == {v[0]: want[v[0]] for v in values[:40]}
    stored = spark.read.parquet(cache).count()
    assert stored == len({v[1] or "" for v in values[:40]})
    whole = token_counts.token_counts(frame(spark, values), PATH, cache)
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in whole.collect()} == want
    assert whole.count() == len(values) and whole.columns == [*frame(spark).columns, "n_bytes", "n_tokens"]
    assert spark.read.parquet(cache).count() == len({v[1] or "" for v in values})  # misses only were added
    odd = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in token_counts.token_counts(odd, PATH).collect()) == [0, 2, 2]
    assert token_counts.token_counts(odd.limit(0), PATH).count() == 0


def words_of(seed, letters, n):
    draw = random.Random(seed)
    stems = ["".join(draw.choice(letters) for _ in range(draw.randint(2, 6))) for _ in range(60)]
    return [" ".join(draw.choice(stems) for _ in range(30)) for _ in range(n)]


def test_gradients_match_differences():
    network = language.Network(["a", "b", "c"], hidden=3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    rows_, labels = np.array([[97, 32, 98, 97], [1, 97, 98, 200]]), np.array([0, 2])
    _, grads = network.gradients(rows_, labels)
    draw = np.random.default_rng(0)
    for name, value in network.p.items():
        for _ in range(6):
            at = tuple(draw.integers(0, s) for s in value.shape)
            if name.startswith("in"):
                at = (97, at[1])
            old = value[at]
            value[at] = old + 1e-3
            up = network.gradients(rows_, labels)[0]
            value[at] = old - 1e-3
            down = network.gradients(rows_, labels)[0]
            value[at] = old
            assert abs((up - down) / 2e-3 - grads[name][at]) < 1e-3


def test_language_learns_and_reads_whole_texts(spark):
    texts = [(t, "aa") for t in words_of(1, "abcde", 60)] + [(t, "bb") for t in words_of(2, "vwxyzé", 60)]
    tail = [("?? 12", "aa"), (None, "aa"), ("", None), ("ABC BCDE " * 3000, None), ("x" * 5000, None)]
    values = [(i, t, lang, "s", 1, "k", "old", "y") for i, (t, lang) in enumerate(texts + tail)]
    docs = frame(spark, values)
    held_out = language.remainder() == 2
    network = language.train(docs, held_out)
    got = {r.doc_id: r for r in language.predict(docs.withColumn("held", held_out), network).collect()}
    for i, (_, lang) in enumerate(texts):
        assert got[i].held == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang
    assert [(got[120 + i].lang_pred, got[120 + i].score) for i in range(3)] == [("und", 0.0)] * 3
    assert got[123].lang_pred == "aa" and got[124].lang_pred == "bb" and 0.5 < got[123].score <= 1
    assert isinstance(got[0].score, float) and got[0].label == "y"


def test_language_without_labels(spark):
    docs = frame(spark, [(1, "text here", None, "s", 1, "k", "x", "y"), (None, None, None, None, None, None, None, None)])
    assert language.train(docs) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(docs.limit(0), language.Network(["a", "b"])).count() == 0


def test_reader_forgets_and_still_agrees(monkeypatch):
    network = language.Network(["a", "b"])
    texts = [" ".join(f"word{i}x{j}" for j in range(40)) for i in range(10)] + ["word1x1 word2x2", ""]
    want = language.Reader(network).read(texts)
    monkeypatch.setattr(language, "KEPT", 48)
    assert np.allclose(language.Reader(network).read(texts), want)


def test_reader_ends_with_more_words_than_it_keeps(monkeypatch):
    network = language.Network(["a", "b"])
    large = [" ".join(f"word{i}y{j}" for j in range(n)) for i, n in enumerate((60, 200))]
    texts = ["few words", large[0], "word0y3 few", "", large[1], large[0], "words"]
    want = language.Reader(network).read(texts)
    monkeypatch.setattr(language, "KEPT", 48)
    learn, calls = language.Reader._learn, []

    def counted(self, words):
        calls.append(len(words))
        assert len(calls) < 500, "no end"
        return learn(self, words)

    monkeypatch.setattr(language.Reader, "_learn", counted)
    assert np.allclose(language.Reader(network).read(texts), want)


def test_decontamination_counts(spark):
    docs = make()
    long = [t for _, t in docs if t and len(t.split()) > 60][:3]
    items = [(1, " ".join(long[0].split()[5:40])), (22, long[1].upper()[:200]), (3, "Two, words!"), (4, None), (5, "  ")]
    items += [(1, " ".join(long[0].split()[5:40])), (6, "no such words here at all")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = benchmark_hits(docs, items)
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.hit_counts(frame(spark), benchmark).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_decontamination_in_shards(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(14))) for i in range(12)] + [(50, "w3x2")]
    docs = [(i, f"before w{i}x0 " + " ".join(f"W{i % 12}x{j}," for j in range(14)) + " after", *["a"] * 2, 1, *["b"] * 3) for i in range(30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 40)
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.hit_counts(frame(spark, docs), benchmark).collect()}
    assert got == benchmark_hits([d[:2] for d in docs], items)


def test_decontaminate_cuts_and_drops(spark):
    item = " ".join(f"q{i}" for i in range(12))
    texts = [f"Keep this, {item.upper()}. and " + "much more text " * 10, item, "clean text", None, ""]
    docs = frame(spark, [(i, t, "en", "s", 1, "k", "x", "y") for i, t in enumerate(texts)])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontamination.decontaminate(docs, benchmark)
    assert out.schema == docs.schema
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: "Keep this, . and " + "much more text " * 10, 2: "clean text", 3: None, 4: ""}
    assert decontamination.decontaminate(docs, benchmark.limit(0)).count() == 5
    assert decontamination.hit_counts(docs.limit(0), benchmark).count() == 0


def test_license_spellings(spark):
    texts = [
        "Released under the MIT Licence",
        "(c) 2020 Somebody\n\n*** RELEASED, under the MIT license! ***\nAll rights reserved.",
        "Some code\nLicensed under the Apache Licence, v2.0.\nreleased under the MIT license.\r\nNo licence known",
        None,
        "",
        "--- ---",
        "plain text",
    ]
    values = [(i, t, "en", "s", 1, "k", "x", "y") for i, t in enumerate(texts)] * 2
    docs = frame(spark, values).withColumnRenamed("label", "license")
    out = licenses.scan(docs)
    got = {r.doc_id: (r.license, r.n_notices, r.notices) for r in out.collect()}
    assert got == {
        0: ("MIT", 1, "MIT"),
        1: ("MIT", 1, "MIT"),
        2: (None, 3, "Apache-2.0,MIT"),
        3: (None, 0, ""),
        4: (None, 0, ""),
        5: (None, 0, ""),
        6: (None, 0, ""),
    }
    assert out.count() == 14 and out.where("text is null and digest is not null").count() == 0
    own = spark.createDataFrame([("Own", "plain, TEXT")], "license string, text string")
    assert {r.doc_id for r in licenses.scan(docs, own).where("license = 'Own'").collect()} == {6}
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, own.limit(0)).count() == 14


def licences_of(spark, texts):
    docs = frame(spark, [(i, t, "en", "s", 1, "k", "x", "y") for i, t in enumerate(texts)])
    return {r.doc_id: (r.license, r.n_notices, r.notices) for r in licenses.scan(docs).collect()}


def test_only_holders_are_deleted(spark):
    isc, mit = (dict(licenses.NOTICES[-2:])[name] for name in ("ISC", "MIT"))
    head, tail = isc.split("copyright notice", 1)
    texts = [
        "\nCopyright (c) 2004, Somebody\n\n" + head + "\ncopyright notice" + tail,
        "Copyright (c) 2020 Foo. Licensed under the MIT License.",
        "Copyright (c) 2020 Foo, Inc. All rights reserved. " + mit,
        "Copyright 2020 John Smith " + isc,
    ]
    got = licences_of(spark, texts)
    assert [got[i][0] for i in range(4)] == ["ISC", "MIT", "MIT", "ISC"] and got[1] == ("MIT", 1, "MIT")
    gone = ["Copyright 2020 Foo", "# (c) Foo Bar", "© Foo", "Copyright: Foo Inc., 2019", "Copyright The Foo Authors", "(C) Copyright [year] X", "Copyright (c) <year> <name>"]
    stay = ["copyright notice and this permission", "Copyright holders be liable", "(c) You must retain, in the Source form", "copyright license to reproduce", "Copyright treaty adopted on 20 December 1996", "copyright, patent"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(gone + stay)], "i int, text string")
    left = {r.i for r in table.where(licenses.canonical(table.text) != "").collect()}
    assert left == set(range(len(gone), len(gone + stay)))


def test_whole_licences_and_notices_are_known(spark):
    note, want = "Copyright (c) 2020, Somebody\n\n", {}
    for name, (titles, bodies) in licenses.WHOLE.items():
        want[f"{titles[0]}\n\n{note}{bodies[0]}\n"] = want[note + bodies[0]] = name
    want["Licensed under the GNU General Public License, version 3."] = "GPL-3.0-only"
    want["This program is licensed under the terms of the GNU GPL v3 or later"] = "GPL-3.0-or-later"
    want["Released under the BSD 2-Clause License"] = "BSD-2-Clause"
    want["Distributed under the Creative Commons Attribution-ShareAlike 4.0 International License"] = "CC-BY-SA-4.0"
    want["This project is not licensed under the MIT License."] = None
    folder = "/usr/share/common-licenses"
    for file, name in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0-only"), ("GPL-3", "GPL-3.0-only"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(f"{folder}/{file}"):
            with open(f"{folder}/{file}", encoding="utf-8") as f:
                want[f.read()] = name
    got = licences_of(spark, list(want))
    assert [got[i][0] for i in range(len(want))] == list(want.values())


def test_quality_shrinks_sparse_sites(spark):
    draw = random.Random(3)
    good = " ".join(f"word{i} and" for i in range(40)) + ". End of it."
    bad = "A " * 60
    values, labels = [], []
    for i in range(400):
        host = "big" if i % 2 else f"host{i % 6}"
        is_good = draw.random() < (0.9 if host == "big" else 0.6)
        values.append((i, good if is_good else bad, "en", host, 1, "k", "x", "y"))
        if i % 3:
            labels.append((i, int(is_good)))
    values += [(400, good, None, "new", 1, "k", "x", "y"), (401, None, None, None, None, None, None, None), (402, bad, "en", "one", 1, "k", "x", "y")]
    labels += [(402, 0), (402, 0), (999, 1), (None, 1), (5, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(frame(spark, values), table).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got.values())
    assert all(got[i].kept == (values[i][1] == good) for i in range(400))
    share = sum(q for _, q in labels[:-5]) / len(labels[:-5])
    assert got[1].host_share > share > got[0].host_share  # sites keep their side of the whole
    assert abs(got[400].host_share - share) < 0.02  # an unknown site is like all
    assert 0.3 < got[402].host_share < share  # one label moves a site a little only
    assert {r.score for r in quality.score(frame(spark, values), table.limit(0)).collect()} == {0.5}
    assert quality.score(frame(spark, []), table).count() == 0
