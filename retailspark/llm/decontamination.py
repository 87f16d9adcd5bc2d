"""Benchmark decontamination with a generalised suffix automaton of the test items."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import bounded_batches, covered, mask_spans, set_aside, utf8
from .automaton import SuffixAutomaton

#: Words of items in one automaton. More items make more automata, through which documents pass one after another.
SHARD_WORDS = 400_000

#: Lower-cases A-Z and turns all that is not 0-9, a-z or a byte above 0x7F into blanks.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20
    for b in range(256)
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal_words(raw):
    """Words of a text given as UTF-8 bytes: letters, digits and all beyond ASCII, A-Z in lower case."""
    return raw.translate(_NORMAL).split()


class Matcher:
    """Finds all occurrences of the items' windows in the words of a document."""

    def __init__(self, items, window):
        self.window, self.number = window, {}
        self.automaton = SuffixAutomaton()
        coded = []
        for item, raw in items:
            words = normal_words(raw)
            codes = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            if codes:
                coded.append((item, codes))
                self.automaton.add(codes)
        self.lengths = sorted({min(window, len(codes)) for _, codes in coded})
        self.least = self.lengths[0] if self.lengths else 0
        self.owners = {}
        for item, codes in coded:
            width = min(window, len(codes))
            for _, state in self.automaton.windows(codes, width):
                self.owners.setdefault((width, state), set()).add(item)
        # pairs of neighbouring words of items, as bits: most stretches of a document end here
        self.pairs = np.zeros(1 << 22, bool)
        for _, codes in coded:
            row = np.array(codes, np.uint64)
            self.pairs[self._pair(row)] = True

    @staticmethod
    def _pair(codes):
        mixed = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def match(self, words):
        """Number of words, mask of the words inside occurrences, and the items that occur."""
        n = len(words)
        if not n or not self.least:
            return np.zeros(n, bool), set()
        get = self.number.get
        codes = np.fromiter([get(w, 0) for w in words], np.uint64, n)
        inside = codes > 0
        if self.least > 1:  # a window needs that many known words in a row, each pair known too
            linked = np.zeros(n + 1, bool)
            linked[1:n] = inside[1:] & inside[:-1] & self.pairs[self._pair(codes)]
            inside = linked[:-1] | linked[1:]
            # neighbours that are no known pair end a stretch
        begins, ends = mask_spans(inside)
        starts, lengths, found = [], [], set()
        for begin, end in zip(begins.tolist(), ends.tolist()):
            if end - begin < self.least:
                continue
            for place, length, state in self.automaton.stream(codes[begin:end].tolist()):
                for width in self.lengths:
                    if length < width:
                        break
                    owners = self.owners.get((width, self.automaton.shrink(state, width)))
                    if owners:
                        starts.append(begin + place + 1 - width)
                        lengths.append(width)
                        found |= owners
        return covered(n, starts, lengths) if starts else np.zeros(n, bool), found


def _shards(benchmark):
    """Items as (id as string, text as bytes) in lists of at most SHARD_WORDS words, one list at a time."""
    shard, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    for row in rows.where("t is not null").toLocalIterator():
        raw = row.t.encode()
        words = len(normal_words(raw))
        if shard and size + words > SHARD_WORDS:
            yield shard
            shard, size = [], 0
        shard.append((row.i, raw))
        size += words
    if shard:
        yield shard


def matched(docs, benchmark, window=10):
    """``docs`` with _hits (binary, a bit per word of the text, set inside occurrences of item windows), _words (their
    number) and _items (ids, as strings, of the items that have an occurring window).

    A window is ``window`` consecutive words of one item; an item with fewer words, but at least one, is a window as a
    whole. Documents stream past a generalised suffix automaton of the items, which goes to every task. One automaton
    holds at most SHARD_WORDS words (an item with more stands alone); further items form further automata, through
    which the documents pass one after another, so memory stays bounded for a benchmark of any size.

    Null or empty texts have no words. Items without id count under the id ''; repeated items are one. Repeated rows
    and null doc_ids are kept as they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = [c for c in docs.columns if c.lower() not in ("_hits", "_words", "_items")]
    out = docs.select(
        *kept,
        F.lit(None).cast("binary").alias("_hits"),
        F.lit(0).cast("long").alias("_words"),
        F.array().cast("array<string>").alias("_items"),
    )
    for shard in [*_each(benchmark)] or [[]]:
        out = out.mapInArrow(_step(spark.sparkContext.broadcast(shard), window, kept), out.schema)
    return out


def _each(benchmark):
    for shard in _shards(benchmark):
        yield [(item or "", raw) for item, raw in shard]


def _step(shard, window, kept):
    def step(batches):
        matcher = Matcher(shard.value, window)
        for batch in batches:
            hits, counts, items = [], [], []
            before = batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()
            for raw, old, old_items in zip(utf8(batch), *before):
                words = normal_words(raw)
                mask, found = matcher.match(words)
                if old:
                    mask = mask | np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool)
                hits.append(np.packbits(mask).tobytes() if mask.any() else None)
                counts.append(len(words))
                items.append(sorted(found.union(old_items or ())))
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(hits, pa.binary()), pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "_hits", "_words", "_items"])

    return step


def hit_counts(docs, benchmark, window=10):
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated; see ``matched``."""
    found = matched(docs.select("doc_id", "text"), benchmark, window)

    def count(batches):
        for batch in batches:
            bits = [0 if b is None else int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in batch.column("_hits").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "_words")] + [pa.array(bits, pa.int64()), batch.column("_items")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = found.mapInArrow(count, f"doc_id {kind}, n_words long, n_hit long, items array<string>")
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs, benchmark, window=10, max_coverage=0.5):
    """``docs`` without the words inside item windows; documents covered beyond ``max_coverage`` go as a whole.

    A removed span reaches from its first word to its last one, with what stands between them. Documents without hits
    keep their text as it is. All columns and their types stay. Null texts stay null.
    """
    docs, named = set_aside(docs, "_hits", "_words", "_items")
    found, kept = matched(docs, benchmark, window), docs.columns
    at = kept.index("text")

    def cut(batches):
        for batch in batches:
            texts, keep = batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
            rows = zip(batch.column("_hits").to_pylist(), batch.column("_words").to_pylist())
            for i, (hits, n) in enumerate(rows):
                if hits is None:
                    continue
                mask = np.unpackbits(np.frombuffer(hits, np.uint8), count=n).astype(bool)
                if mask.mean() > max_coverage:
                    keep[i] = False
                else:
                    texts[i] = _without(texts[i].encode(), mask)
            columns = [batch.column(c) for c in kept]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, kept).filter(pa.array(keep))

    return named(found.mapInArrow(cut, docs.schema))


def _without(raw, mask):
    spans, out, at = [m.span() for m in _WORD.finditer(raw.lower())], [], 0
    for first, last in zip(*mask_spans(mask)):
        out.append(raw[at : spans[first][0]])
        at = spans[last - 1][1]
    return b"".join([*out, raw[at:]]).decode()
