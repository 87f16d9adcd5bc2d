"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Spans that the libraries report (tokenizers: characters; sentencepiece: bytes) are the coarse cuts. Tokens that
share a character, as parts of a multibyte sign or as fallback bytes, are told apart by their decoded bytes. A byte offset
where tokens of both end closes a group.

Both tokenizers begin anew at a single blank between two visible characters, and at a sign after a letter, which is
checked in the vocabularies. So a task encodes a word once and remembers it for a while, and a text's groups are those of
its words one after another.
"""

import functools
import hashlib
import itertools
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialise
from .chat import _token_bytes
from .common import bounded_batches

#: Bounds of a chunk, the texts that share one list of pairs: distinct pairs, and words of the texts.
CHUNK_PAIRS, CHUNK_WORDS = 1 << 18, 1 << 22
#: Links of the words that a task remembers, and pairs in a row.
KNOWN_LINKS, ROW_PAIRS = 1 << 21, 1 << 15
#: Links looked at together, and bytes of words encoded together.
SLICE, JOINED = 1 << 21, 1 << 16

#: Letters in every version of Unicode, and ASCII signs.
_LETTER, _SIGN = "[A-Za-zÀ-ÖØ-öø-ɏ]", r"[!-/:-@\[-`{-~]"
_BLANK = r"(?<=[!-~\w])(?= [!-~\w])"
_BLANKS, _CUT = re.compile(_BLANK), re.compile(f"{_BLANK}|(?<={_LETTER})(?={_SIGN})")
#: Words that may stand one behind another, those that may stand behind a letter, and a letter for them.
_PLAIN = re.compile(r" [!-~\w](.*[!-~\w])?", re.DOTALL)
_TAIL = re.compile(_SIGN + r"(.*[!-~\w])?", re.DOTALL)
_SEAT, _SEATED = " a", re.compile(_LETTER)

_PARTS_DDL = (
    "chunk long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "links binary, first int, pairs binary, held binary"
)
_PARTS = pa.schema(
    [("chunk", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("links", pa.binary()), ("first", pa.int32())]
    + [("pairs", pa.binary()), ("held", pa.binary())]
)
_LINKS_DDL = "chunk long, slot int, pair long, n int"
RESULT_DDL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def settled_ends(coarse, inner, lengths):
    """Byte offsets where tokens end: the coarse cuts, and decoded lengths for ``inner`` tokens, which end inside a
    character. Where both disagree altogether the decoded bytes decide."""
    fine = np.cumsum(lengths)
    last = np.maximum.accumulate(np.where(inner, -1, np.arange(len(fine))))
    base = np.where(last >= 0, coarse[last] - fine[last], 0)
    ends = np.where(inner, fine + base, coarse)
    return ends if np.array_equal(ends, fine) else fine


class Spans:
    """Groups of ``words`` in order: token ids of both sides, their groups, and the groups' words."""

    def __init__(self, ids_a, ids_b, ends_a, ends_b, borders):
        both = np.zeros(int(max(ends_a[-1], ends_b[-1])) + 1, bool)
        both[ends_b] = True
        common = ends_a[both[ends_a] & _last(ends_a)]
        both[:] = False
        both[common] = True
        self.whole = bool(both[borders].all())
        self.common = common
        self.ids_a, self.ids_b = ids_a, ids_b
        self.group_a, self.group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        self.word = np.searchsorted(borders, common)
        self.a = np.bincount(self.group_a, minlength=len(common))
        self.b = np.bincount(self.group_b, minlength=len(common))

    def links(self):
        """Distinct (word, pair) with their number, ordered; pair is A's id * 2**32 + B's id."""
        each = self.b[self.group_a]
        first = np.concatenate(([0], np.cumsum(self.b)))[self.group_a]
        word = self.word[self.group_a]
        edges = np.concatenate(([0], np.cumsum(each)))
        found, at = None, 0
        while at < len(each):
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + SLICE, "right")) - 1)
            n = each[at:end]
            place = np.arange(n.sum()) + np.repeat(first[at:end] - (edges[at:end] - edges[at]), n)
            part = np.repeat(word[at:end], n), np.repeat(self.ids_a[at:end] << 32, n) | self.ids_b[place]
            part = _counted(*part, np.ones(len(place), np.int64))
            found = part if found is None else _counted(*map(np.concatenate, zip(found, part)))
            at = end
        return found

    def texts(self, signs):
        """Per word, its groups as text; see ``Aligner.signs``."""
        base = np.concatenate(([0], np.cumsum(self.a + self.b)))[:-1]
        first_a, first_b = np.cumsum(self.a) - self.a, np.cumsum(self.b) - self.b
        last_a, last_b = _last(self.group_a), _last(self.group_b)
        at_a = np.arange(len(self.ids_a)) + (base - first_a)[self.group_a]
        at_b = np.arange(len(self.ids_b)) + (base + self.a - first_b)[self.group_b]
        out = np.empty(len(at_a) + len(at_b), np.int64)
        out[at_a] = 5 * self.ids_a + last_a
        out[at_b] = 5 * self.ids_b + 2 + last_b * (1 + _last(self.word)[self.group_b])
        return "".join(map(signs.__getitem__, out.tolist()))[:-1].split("\n")


def _last(values):
    """Mask of the last one of each run of equal neighbours."""
    return np.append(values[1:] != values[:-1], True)


def _counted(word, pair, times):
    order = np.lexsort((pair, word))
    return _added(word[order], pair[order], times[order])


def _added(word, pair, times):
    """Sums of ``times`` over equal neighbours."""
    new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (pair[1:] != pair[:-1]))))
    return word[new], pair[new], np.add.reduceat(times, new)


class Aligner:
    """``first`` is a byte-level vocabulary for tokenizers (A), ``second`` a sentencepiece model (B)."""

    def __init__(self, first, second):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = _token_bytes(token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_a, self.size_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        #: every id with what may follow it in the text of groups: after an id of A another one or B's, after one of B
        #: another one, a group or a word
        self.signs = [f"{i}{c}" for i in range(max(len(self.bytes_a), len(pieces))) for c in (",", "|", ",", ";", "\n")]
        #: no piece goes on over a blank after another character, so texts may be cut there
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces) and not any(
            re.search(r"[!-~\w] ", t.decode(errors="ignore")) for t in self.bytes_a
        )
        #: no token goes on over a sign after a letter; added tokens and control pieces never come out of a text
        added = self.a.get_added_tokens_decoder()
        own = [t.decode(errors="replace") for i, t in enumerate(self.bytes_a) if i not in added]
        own += [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        crossing = re.compile(_LETTER + _SIGN)
        self.signed = self.cuts and not any(map(crossing.search, own)) and self.spans([_SEAT]) is not None

    def words(self, text):
        """Blank and text cut where both tokenizers begin anew."""
        return (_CUT if self.signed else _BLANKS).split(" " + text) if self.cuts else [" " + text]

    def spans(self, words):
        """``Spans`` of words written one after another, or None if tokens do not give back their bytes."""
        joined = "".join(words)
        raw = joined.encode()
        found = self.a.encode(joined, add_special_tokens=False)
        ids_a = np.array(found.ids, np.int64)
        if b"".join(map(self.bytes_a.__getitem__, found.ids)) != raw:
            return None
        listed = self.b.encode(joined[1:], return_type="offset_mapping", return_bytes=True)
        ids_b = np.array(listed["ids"], np.int64)
        if b"".join(map(self.bytes_b.__getitem__, listed["ids"])) != raw:
            return None
        at = np.arange(len(joined) + 1)
        if len(raw) != len(joined):  # places of characters in bytes
            signs = np.frombuffer(raw, np.uint8)
            at = np.append(np.flatnonzero((signs & 0xC0) != 0x80), len(raw))
        offsets = _spans(found.offsets)
        inner = np.append(offsets[:-1, 1] > offsets[1:, 0], False)
        ends_a = settled_ends(at[offsets[:, 1]], inner, self.size_a[ids_a])
        begin, end = _spans(listed["offsets"]).T
        inner = (begin == end) & (np.arange(len(end)) > 0)  # a fallback byte before the last one of its sign
        ends_b = settled_ends(end + 1, inner, self.size_b[ids_b])
        borders = np.cumsum([len(w.encode()) for w in words]) if len(raw) != len(joined) else np.cumsum(list(map(len, words)))
        spans = Spans(ids_a, ids_b, ends_a, ends_b, borders)
        return spans if spans.whole else None

    def each(self, words):
        """(words, Spans or None) for parts of ``words``, encoded together where that gives their bytes back."""
        plain = [w for w in words if _PLAIN.fullmatch(w)] if self.cuts else []
        tails = [w for w in words if _TAIL.fullmatch(w)] if self.signed else []
        seats = [w for w in plain if _SEATED.match(w[-1])][: len(tails)]
        taken = set(seats)
        seats += [_SEAT] * (len(tails) - len(seats))
        held, size = [], 0
        for unit in itertools.chain(zip(seats, tails), ((w,) for w in plain if w not in taken)):
            held.append(unit)
            size += sum(map(len, unit))
            if size > JOINED:
                yield from self._halved(held)
                held, size = [], 0
        if held:
            yield from self._halved(held)
        joined = {*plain, *tails}
        for word in words:
            if word not in joined:
                yield self._alone(word)

    def _halved(self, units):
        words = [w for unit in units for w in unit]
        spans = self.spans(words)
        if spans:
            yield words, spans
        elif len(units) > 1:
            yield from self._halved(units[: len(units) // 2])
            yield from self._halved(units[len(units) // 2 :])
        else:
            yield from map(self._alone, words)

    def _alone(self, word):
        words = [word] if word.startswith(" ") else [_SEAT, word]
        spans = self.spans(words)
        return (words, spans) if spans else ([word], None)


def _spans(offsets):
    return np.fromiter(itertools.chain.from_iterable(offsets), np.int64, 2 * len(offsets)).reshape(-1, 2)


@functools.lru_cache(maxsize=1)
def _aligner(first, second):
    """Kept by a Python worker from task to task, since reading the vocabularies takes long."""
    return Aligner(first, second)


class _Chunk:
    """Texts that share a list of pairs, up to the bounds above."""

    def __init__(self, aligner):
        self.aligner, self.chunk = aligner, uuid.uuid4().int >> 65
        self.slots, self.held, self.n_words, self.ready = {}, np.zeros(0, np.int64), 0, []
        self.forget()

    def forget(self):
        """Words known so far: their numbers, -1 for those that tokens do not give back, and by number their groups as
        text, their sums, and the places, slots and times of their links."""
        self.number, self.texts, self.sums = {}, [], np.zeros((4, 0), np.int64)
        self.offsets, self.slot, self.times = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def learn(self, words):
        if len(self.slot) >= KNOWN_LINKS:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        sums, offsets, pairs, times, size = [self.sums], [self.offsets], [], [self.times], len(self.slot)
        for part, spans in self.aligner.each(new) if new else ():
            if spans is None:
                self.number.update(dict.fromkeys(part, -1))
                continue
            n, base = len(part), len(self.texts)
            self.number.update(zip(part, range(base, base + n)))
            self.texts += spans.texts(self.aligner.signs)
            # products are summed as whole numbers: they may pass what a double holds
            links = np.zeros(n, np.int64)
            np.add.at(links, spans.word, spans.a * spans.b)
            a, b = (np.bincount(spans.word, w, n).astype(np.int64) for w in (spans.a, spans.b))
            sums.append(np.array([a, b, np.bincount(spans.word, minlength=n), links]))
            word, pair, often = spans.links()
            offsets.append(size + np.searchsorted(word, np.arange(1, n + 1)))
            size += len(pair)
            pairs.append(pair)
            times.append(often)
        if pairs:
            self.sums, self.offsets = np.concatenate(sums, axis=1), np.concatenate(offsets)
            self.slot, self.times = np.concatenate([self.slot, self.numbered(np.concatenate(pairs))]), np.concatenate(times)

    def numbered(self, pairs):
        """Slots of pairs; new ones get the next slots."""
        distinct, back = np.unique(pairs, return_inverse=True)
        slots = self.slots
        found = np.array([slots.setdefault(pair, len(slots)) for pair in distinct.tolist()], np.int32)
        self.held = np.append(self.held, np.zeros(len(slots) - len(self.held), np.int64))
        return found[back]

    def add(self, docs):
        """(doc_id, words) each; words None without tokens."""
        flat = [w for _, words in docs for w in words or ()]
        self.learn(flat)
        self.n_words += len(flat)
        numbers = list(map(self.number.__getitem__, flat))
        sizes = np.array([len(words or ()) for _, words in docs], np.int64)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        words, doc = np.array(numbers, np.int64), np.repeat(np.arange(len(docs)), sizes)
        good = sizes > 0
        good[doc[words < 0]] = False
        digests = [
            hashlib.sha256(";".join(map(self.texts.__getitem__, numbers[start:end])).encode()).hexdigest() if g else ""
            for g, start, end in zip(good.tolist(), edges.tolist(), edges[1:].tolist())
        ]
        words, doc = words[good[doc]], doc[good[doc]]
        running = np.concatenate((np.zeros((4, 1), np.int64), np.cumsum(self.sums[:, words], axis=1)), axis=1)
        sums = np.diff(running[:, np.searchsorted(doc, np.arange(len(docs) + 1))], axis=1)
        of, slot, times = self.links(doc, words)
        self.held += np.bincount(slot, minlength=len(self.held))
        places = np.searchsorted(of, np.arange(len(docs) + 1)).tolist()
        links = [_packed(slot[start:end], times[start:end]) for start, end in zip(places, places[1:])]
        n = len(docs)
        columns = [[self.chunk] * n, [1] * n, [d for d, _ in docs], *sums, digests, links, *[[None] * n] * 3]
        for at in range(0, n, 512):
            self.ready.append(_batch([c[at : at + 512] for c in columns]))

    def links(self, doc, words):
        """Distinct (document, slot) with their number of links, ordered."""
        both, often = np.unique(doc << 32 | words, return_counts=True)
        doc, words = both >> 32, both & 0xFFFFFFFF
        starts, ends = self.offsets[words], self.offsets[words + 1]
        edges = np.concatenate(([0], np.cumsum(ends - starts)))
        found, at = [np.zeros(0, np.int64)] * 3, 0
        while at < len(words):
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + SLICE, "right")) - 1)
            place, n = _ranges(starts[at:end], ends[at:end]), np.diff(edges[at : end + 1])
            key = np.repeat(doc[at:end] << 32, n) | self.slot[place]
            times = self.times[place] * np.repeat(often[at:end], n)
            order = np.argsort(key)
            key = key[order]
            part = _added(key >> 32, key & 0xFFFFFFFF, times[order])
            found = _counted(*map(np.concatenate, zip(found, part))) if len(found[0]) else part
            at = end
        return found

    def full(self):
        return len(self.slots) >= CHUNK_PAIRS or self.n_words >= CHUNK_WORDS

    def done(self):
        """Rows of the documents added since the last call."""
        ready, self.ready = self.ready, []
        return ready

    def rows(self):
        """What is left: documents not yet handed out, and the pairs with the number of documents that hold them."""
        yield from self.done()
        pairs = np.fromiter(self.slots, "<i8", len(self.slots))  # in the order of their slots
        for at in range(0, len(pairs), ROW_PAIRS):
            part = [x[at : at + ROW_PAIRS].astype(t).tobytes() for x, t in ((pairs, "<i8"), (self.held, "<i4"))]
            yield _batch([[x] for x in (self.chunk, 0, *[None] * 7, at, *part)])


def _ranges(starts, ends):
    """All places of the ranges, one range after another."""
    n = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def _packed(slots, times):
    """Ascending slots, as steps, and times in few bytes: the lowest bytes of all numbers first, then the next ones."""
    if not len(slots):
        return None
    planes = []
    for values in (np.diff(slots, prepend=0), times):
        width = (int(values.max()).bit_length() + 7) // 8
        planes.append(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    n = len(slots)
    return zlib.compress(bytes(len(p) // n for p in planes) + b"".join(planes), 1)


def _unpacked(blob):
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    widths, raw = raw[:2].tolist(), raw[2:]
    n = len(raw) // sum(widths)
    slots, times = np.zeros((2, n, 8), np.uint8)
    slots[:, : widths[0]] = raw[: widths[0] * n].reshape(-1, n).T
    times[:, : widths[1]] = raw[widths[0] * n :].reshape(-1, n).T
    return np.cumsum(slots.view("<i8").ravel()), times.view("<i8").ravel()


def _batch(columns):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS)


def _parts(first, second):
    """Task step: texts to documents and pairs of chunks."""

    def step(batches):
        aligner = _aligner(first, second)
        chunk = _Chunk(aligner)
        for batch in batches:
            docs, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                docs.append((doc_id, aligner.words(text) if text else None))
                size += len(text or "")
                if size > 1 << 20:
                    chunk.add(docs)
                    yield from chunk.done()
                    docs, size = [], 0
                if chunk.full():
                    yield from chunk.rows()
                    chunk = _Chunk(aligner)
            chunk.add(docs)
            yield from chunk.done()
        yield from chunk.rows()

    return step


def _links(batches):
    """Task step: the pairs of a chunk, with the number of its documents that hold each."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs, held = np.frombuffer(row["pairs"], "<i8"), np.frombuffer(row["held"], "<i4")
            slots = np.arange(row["first"], row["first"] + len(pairs), dtype=np.int32)
            columns = [np.full(len(pairs), row["chunk"], np.int64), slots, pairs, held]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["chunk", "slot", "pair", "n"])


def _chunk_links(parts):
    blobs = parts.where("kind = 0").select("chunk", "first", "pairs", "held")
    return blobs.mapInArrow(_links, _LINKS_DDL)


def _scored(batches):
    """Task step: rows of a chunk in order: the pairs' counts, then documents."""
    names = [c.split()[0] for c in RESULT_DDL.split(", ")]
    current, counts, tables = None, [], None
    for batch in batches:
        chunks, kinds = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
        at = 0
        for end in (np.flatnonzero(_last(chunks << 1 | (kinds == 1))) + 1).tolist():
            rows = batch.slice(at, end - at)
            if chunks[at] != current:
                current, counts, tables = chunks[at], [], None
            if kinds[at] == 0:
                counts.append([rows.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "total", "is_best")])
            else:
                if tables is None:
                    tables, counts = _tables(counts), []
                found = [(_sums(tables, blob.as_py()) if blob.is_valid else (0, 0)) for blob in rows.column("links")]
                known = dict(zip(("count_sum", "n_best"), zip(*found)))
                columns = [pa.array(known[c], pa.int64()) if c in known else rows.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)
            at = end


def _tables(counts):
    """The pairs' counts, and whether they are the best, by slot."""
    if not counts:
        return ()
    slot, total, best = map(np.concatenate, zip(*counts))
    tables = np.zeros((2, len(slot)), np.int64)
    tables[:, slot] = total, best
    return tables


def _sums(tables, blob):
    slots, times = _unpacked(blob)
    return [int(table[slots] @ times) for table in tables]


def _written_parts(docs, first, second):
    bounded_batches(docs.sparkSession)
    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_parts(first, second), _PARTS_DDL), "align")


def _totals(links):
    """Documents per pair over the whole corpus, and whether no pair of the same A id has more."""
    totals = links.groupBy("pair").agg(F.sum("n").alias("total"))
    by_id = Window.partitionBy(F.shiftright("pair", 32))  # at most one row per id of B
    return totals.withColumn("is_best", F.col("total") == F.max("total").over(by_id))


def pair_counts(docs, first, second):
    """(a, b, count): in how many documents the ids a and b are linked, and is_best: no b of this a has more."""
    totals = _totals(_chunk_links(_written_parts(docs, first, second)))
    low = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return totals.select(
        F.shiftright("pair", 32).cast("int").alias("a"), low.cast("int").alias("b"), F.col("total").alias("count"), "is_best"
    )


def groups(docs, first, second):
    """(doc_id, group, a, b, text): every group of every text in order, with its ids and what it covers.

    Groups of a text without tokens have no rows; see ``align``.
    """
    bounded_batches(docs.sparkSession)

    def step(batches):
        aligner = _aligner(first, second)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                spans = aligner.spans([" " + text]) if text else None
                if spans is None:
                    continue
                raw = (" " + text).encode()
                a, b = (np.split(i, np.cumsum(n)[:-1]) for i, n in ((spans.ids_a, spans.a), (spans.ids_b, spans.b)))
                starts = [0, *spans.common[:-1].tolist()]
                covers = [raw[s:e] for s, e in zip(starts, spans.common.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id] * len(covers), pa.int64()),
                        pa.array(range(len(covers)), pa.int64()),
                        pa.array(a, pa.list_(pa.int64())),
                        pa.array(b, pa.list_(pa.int64())),
                        pa.array(covers, pa.binary()),
                    ],
                    ["doc_id", "group", "a", "b", "bytes"],
                )

    out = "doc_id long, group long, a array<long>, b array<long>, bytes binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(step, out)


def align(docs, first, second):
    """Per document: tokens of both sides (n_a, n_b), n_groups, n_links, n_best, count_sum and groups_sha256.

    Space and text are encoded by ``first`` and text by ``second``, special strings as plain text. Links are all pairs of
    an A and a B token of one group; a pair of ids counts the documents that hold it linked, over the whole corpus. n_best
    is the number of links whose count is the highest of their A id, count_sum the sum of the links' counts.

    A task gathers texts into chunks and writes, for each, its distinct pairs with the number of its documents that hold
    them, and the documents as numbers of pairs. Pairs are counted by a grouping of the chunks' pairs, already added up, and
    the totals return to their chunk by a join; no token occurrence is shuffled, and no row grows with its chunk.

    A text that is null or empty, or that tokens of either side do not give back, has zeros and an empty digest. Very long
    texts are worked through whole; the task holds one text's words. Repeated rows are documents each, a null doc_id
    stays null. Other columns are not read. An empty table gives an empty result.
    """
    parts = _written_parts(docs, first, second)
    links = _chunk_links(parts)
    totals = materialise(_totals(links), "pair-totals")
    back = links.select("chunk", "slot", "pair").join(totals, "pair").select("chunk", "slot", "total", "is_best")
    nothing = {"slot": "int", "total": "long", "is_best": "boolean"}
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
    described = parts.where("kind = 1").select(
        "chunk", "kind", *kept, *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()]
    )
    counted = back.select(
        "chunk", F.lit(0).alias("kind"), *[F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in kept], *nothing
    )
    ordered = described.unionByName(counted).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return ordered.mapInArrow(_scored, RESULT_DDL)
