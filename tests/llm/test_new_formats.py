"""Chat trees, vector codes and token alignment against plain versions."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from retailspark.llm import alignment, chat, vector_codes

BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "a", "the cat sat on the mat", "the cat sat on the mat", "  héllo  wörld \n x ☃é<s> 😀 你好", "a▁b c",
    "ﬁ ½ <|endoftext|> </s> <0x0A>", "=" * 3000, "tab\tand\r\nlines \n\n end ", "it's 12 345 don't", "x" * 70000 + " the cat",
    "  nbsp ́accent é", "👩‍👩‍👧 family 🇩🇪",
]


def plain_alignment(texts):
    """Whole texts, token by token."""
    aligner = alignment.Aligner(BYTES, PIECES)
    held, docs = Counter(), []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        a = aligner.a.encode(" " + text, add_special_tokens=False).ids
        b = aligner.b.encode(text)
        raw = (" " + text).encode()
        if any(b"".join(t[i] for i in ids) != raw for t, ids in ((aligner.bytes_a, a), (aligner.bytes_b, b))):
            docs.append(None)
            continue
        ends = [set(np.cumsum([len(t[i]) for i in ids]).tolist()) for t, ids in ((aligner.bytes_a, a), (aligner.bytes_b, b))]
        groups, at = [], [0, 0]
        for end in sorted(ends[0] & ends[1]):
            group = []
            for side, (table, ids) in enumerate(((aligner.bytes_a, a), (aligner.bytes_b, b))):
                taken, size = [], (groups[-1][2] if groups else 0)
                while size < end:
                    taken.append(ids[at[side]])
                    size += len(table[ids[at[side]]])
                    at[side] += 1
                group.append(taken)
            groups.append((*group, end))
        links = Counter()
        for left, right, _ in groups:
            for (x, m) in Counter(left).items():
                for (y, n) in Counter(right).items():
                    links[x, y] += m * n
        held.update(links.keys())
        docs.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for i, doc in enumerate(docs):
        if doc is None:
            yield (i, 0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, groups, links = doc
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in groups)
        yield (
            i, n_a, n_b, len(groups), sum(links.values()),
            sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest(),
        )


def test_alignment_equals_whole_texts(spark, folder):
    given = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").limit(60).collect()]
    texts = TEXTS + given
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, chunk int")
    got = sorted(map(tuple, alignment.align(docs, BYTES, PIECES).collect()))
    assert got == sorted(plain_alignment(texts))
    assert alignment.align(docs.limit(0), BYTES, PIECES).collect() == []


def test_chunks_do_not_change_counts(monkeypatch):
    """Small chunks hold the same documents, and give each pair the same number of documents in all."""
    aligner = alignment.Aligner(BYTES, PIECES)
    whole, halves = alignment._Chunk(aligner), [alignment._Chunk(aligner), alignment._Chunk(aligner)]
    docs = [(i, aligner.words(t)) for i, t in enumerate(TEXTS) if t]
    whole.add(docs)
    halves[0].add(docs[:5])
    halves[1].add(docs[5:])

    def counts(chunks):
        found = Counter()
        for chunk in chunks:
            for batch in chunk.rows():
                for row in batch.to_pylist():
                    if row["kind"] == 0:
                        found.update(dict(zip(np.frombuffer(row["pairs"], "<i8").tolist(), np.frombuffer(row["held"], "<i4").tolist())))
        return found

    assert counts([whole]) == counts(halves)


def test_rows_do_not_grow_with_the_words_of_a_chunk():
    """Many distinct words of few pairs: a row holds pairs of the chunk, or one document's."""
    syllables = ["the", "and", "ing", "on", "er", "es"]
    words = ["".join(w) for w in itertools.product(syllables, repeat=5)]
    aligner = alignment.Aligner(BYTES, PIECES)
    chunk = alignment._Chunk(aligner)
    chunk.add([(i, aligner.words(" ".join(words[i::10]))) for i in range(10)])
    rows = [row for batch in chunk.rows() for row in batch.to_pylist()]
    held = {len(row["pairs"]) // 8: sum(len(v) for v in row.values() if isinstance(v, bytes)) for row in rows if row["kind"] == 0}
    pairs = sum(held)
    assert 10 < pairs < len(words) // 4 and sum(held.values()) <= 12 * pairs
    assert all(len(v) < 12 * pairs for row in rows if row["kind"] == 1 for v in row.values() if isinstance(v, bytes))


SIGNED = [
    "don't, it's x_y a.\nB é.", "é, ½, ² x² ª, º. µ; ß! ÿ?", "a.b,c d.  e,\n f;\n\ng (h) 'tis, we're. I'd'x 12,5 a1,b", "a,\u0301b a.\ue000 c,😀, d.\x00e",
    "x<|endoftext|>y</s>, z<0x0A>. <s>a", "a." * 50 + " , . b ,", "ＡＢ，Ｃ. ǆ, ɏ. ɐ, ſ.", "!", "a!", "a! ", " a,", "a\n,b", "你好, a,你",
]


def test_forgotten_words_and_small_rows_change_nothing(monkeypatch):
    """Words cut at signs after letters, forgotten at once, encoded a few together, with few pairs in a chunk and a row."""
    for name, value in (("KNOWN_LINKS", 1), ("CHUNK_PAIRS", 30), ("ROW_PAIRS", 7), ("JOINED", 20), ("SLICE", 5)):
        monkeypatch.setattr(alignment, name, value)
    texts = TEXTS + SIGNED
    batches = [pa.record_batch({"doc_id": [i], "text": pa.array([t], pa.string())}) for i, t in enumerate(texts)]
    rows = [row for batch in alignment._parts(BYTES, PIECES)(batches) for row in batch.to_pylist()]
    names, total, best = defaultdict(dict), Counter(), Counter()
    for row in rows:
        if row["kind"] == 0:
            pairs, held = np.frombuffer(row["pairs"], "<i8").tolist(), np.frombuffer(row["held"], "<i4").tolist()
            assert len(pairs) <= 7
            names[row["chunk"]].update(enumerate(pairs, row["first"]))
            for pair, n in zip(pairs, held):
                total[pair] += n
    assert len(names) > 5
    for pair, n in total.items():
        best[pair >> 32] = max(best[pair >> 32], n)
    got = []
    for row in rows:
        if row["kind"] == 1:
            slots, times = alignment._unpacked(row["links"]) if row["links"] else ([], [])
            links = {names[row["chunk"]][int(s)]: int(n) for s, n in zip(slots, times)}
            n_best = sum(n for pair, n in links.items() if total[pair] == best[pair >> 32])
            sums = tuple(row[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links"))
            got.append((*sums, n_best, sum(n * total[pair] for pair, n in links.items()), row["groups_sha256"]))
    assert sorted(got) == sorted(plain_alignment(texts))


def test_chat_reads_back(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "", None, "a\nb", "😀 <|endoftext|>"]
    turns = [(1, k, r, t) for k, (r, t) in enumerate([("system", "be kind"), ("user", "hi"), ("assistant", "hello")])]
    turns += [(c, k, r, t) for c in range(2, 40) for k, (r, t) in enumerate([("system", "be kind"), ("user", odd[c % 7]), ("assistant", odd[c % 5])])]
    turns += [(90, 0, "system", "be kind"), (91, 0, "a\n<|x\\", "q"), (92, 1, "user", "tie"), (92, 1, "user", "tie"), (None, None, None, None)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, leaf string")
    want = {}
    for conv in {t[0] for t in turns}:
        own = sorted([t for t in turns if t[0] == conv], key=lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or ""))
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        want[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for size in (1, 200, 1 << 18):
        members, nodes = chat.format_conversations(df, BYTES, size)
        assert {r[0]: tuple(r)[1:5] for r in chat.summaries(members, nodes, BYTES).collect()} == want
    # within a block a common beginning is emitted once
    first = nodes.where("turn = 0").groupBy("block", "ids").count()
    assert first.where("count > 1").count() == 0
    members, nodes = chat.format_conversations(df.limit(0), BYTES)
    assert chat.summaries(members, nodes, BYTES).collect() == []


def test_nearest_entries_are_exact():
    rng = np.random.default_rng(1)
    for width, kind in ((1, np.int64), (3, np.int64), (8, np.int64), (8, object)):
        parts = rng.integers(-3, 4, (500, width)).astype(kind)
        entries = np.concatenate([parts[:9], parts[:3]])
        distance = ((parts[:, None] - entries[None]) ** 2).sum(axis=2).astype(np.int64)
        code, error = vector_codes.nearest_entries(parts, entries)
        assert (code == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()


def test_codes_of_odd_vectors(spark):
    rows = [(i, [float(i % 5), -0.5, 0.25 * i] + [1.0] * 5, i % 2) for i in range(30)]
    rows += [(30, None, 1), (31, [None] * 8, 1), (32, [float("nan")] * 8, 0), (33, [float("inf")] * 8, 0), (None, [1.0] * 8, None)]
    rows += [rows[0], (40, [], 1), (41, [2.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_codes.compress(df).collect()
    assert len(got) == 34
    sums = defaultdict(int)
    labels = {r[0]: r[2] for r in rows}
    for r in got:
        sums[labels[r.vec_id]] += r.error
    assert all(r.label_error == sums[labels[r.vec_id]] for r in got)
    assert vector_codes.compress(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|a<|", "a\\n\n"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
