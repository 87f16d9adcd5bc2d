"""Where passages repeat: routes stretches of text that may repeat so that equal windows meet in one task.

Each window of a text has an anchor: the gram with the least hash among those inside the window. Equal windows have
equal anchors at equal places, so a window can only repeat if its anchor does. Anchors are counted over the whole
corpus; neighbouring windows with one repeated anchor form a stretch, and stretches meet by anchor. An anchor that
occurs more often than ``hot`` times is not kept together: its windows are dealt out one by one, by their own hashes.
All of this finds candidates only. What repeats is decided where the stretches meet.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ..session import materialise
from .common import Rolling, bounded_batches, mask_spans, runs, scramble, text_key, utf8, window_minima

#: Digests of stretches that a task remembers, to pass on only the first ones of equal stretches.
REMEMBERED = 200_000

ROUTED = "route long, doc_id long, _key long, start long, n long, place long, part binary, kind int"
#: Kinds of routed rows: a span known to repeat, a stretch, the digest of a single window.
SPAN, STRETCH, WINDOW = 0, 1, 2


def written(df, name):
    """``materialise``, after which the shuffle files of the job are removed instead of waiting for garbage collection."""
    setting = "spark.sql.shuffleDependency.fileCleanup.enabled"
    conf = df.sparkSession.conf
    before = conf.get(setting, "false")
    conf.set(setting, "true")
    try:
        return materialise(df, name)
    finally:
        conf.set(setting, before)


class WordCodes(dict):
    """64-bit codes of words."""

    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


class Words:
    """Units of texts: words between ASCII white space, as they are."""

    def __init__(self):
        self.codes = WordCodes()

    def split(self, raw):
        words = raw.split()
        return words, np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def part(words, begin, end):
        return b" ".join(words[begin:end])


class Bytes:
    """Units of texts: bytes."""

    def __init__(self):
        self.table = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def split(self, raw):
        return raw, self.table[np.frombuffer(raw, np.uint8)]

    @staticmethod
    def part(raw, begin, end):
        return raw[begin:end]


class Finder:
    """Anchors and stretches of texts."""

    def __init__(self, units, window, gram):
        self.units, self.window, self.gram, self.rolling = units(), window, gram, Rolling()

    def stretches(self, raw):
        """Units of the text, and of each stretch the first and last window (exclusive), its anchor's place and hash."""
        units, codes = self.units.split(raw)
        grams = self.rolling.windows(codes, self.gram) if len(codes) >= self.window else codes[:0]
        places = window_minima(grams, self.window - self.gram + 1)
        starts, ends = runs(places)
        at = places[starts]
        return units, codes, starts, ends, at, grams[at].view(np.int64)


def candidates(docs, units, window, gram):
    """By text key, the anchors of that text which occur more than once, with how often they do."""

    def count(batches):
        finder = Finder(units, window, gram)
        for batch in batches:
            found = [finder.stretches(raw)[5] for raw in utf8(batch)]
            anchors, n = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(n, pa.int64())], ["anchor", "n"])

    def post(batches):
        finder = Finder(units, window, gram)
        for batch in batches:
            keys, anchors = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for key, raw in zip(batch.column("_key").to_pylist(), utf8(batch)):
                anchors.append(np.unique(finder.stretches(raw)[5]))
                keys.append(np.full(len(anchors[-1]), key, np.int64))
            columns = [pa.array(np.concatenate(anchors)), pa.array(np.concatenate(keys))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "_key"])

    repeated = (
        docs.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    ).where("n > 1")
    posted = docs.select("text", text_key().alias("_key")).mapInArrow(post, "anchor long, _key long")
    return posted.join(repeated, "anchor").groupBy("_key").agg(F.collect_set(F.struct("anchor", "n")).alias("anchors"))


def routed(docs, units, window, gram, hot, keep_first, whole_windows):
    """Candidate stretches of all documents, with what each task already knows to repeat.

    Rows: route, doc_id, _key, start (first window), n (windows), place (of the anchor in the stretch), part (units of
    the stretch, or the digest of a window of a hot anchor if not ``whole_windows``) and kind. A task passes on the
    first ``keep_first`` of equal stretches; the others repeat for certain, and only their place goes on. With
    ``keep_first`` 1, a stretch counts as a repeat only if the one passed on is earlier (by doc_id, text key, start).
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("_key"))
    rows = rows.join(written(candidates(docs, units, window, gram), "repeated-anchors"), "_key")

    def route(batches):
        finder = Finder(units, window, gram)
        seen = {}
        for batch in batches:
            out = [[] for _ in range(8)]
            sets = batch.column("anchors")
            for i, (doc_id, key, raw) in enumerate(
                zip(batch.column("doc_id").to_pylist(), batch.column("_key").to_pylist(), utf8(batch))
            ):
                mine = sets[i].values
                names = np.asarray(mine.field("anchor"))
                order = np.argsort(names)
                names, often = names[order], np.asarray(mine.field("n"))[order]
                units_, codes, starts, ends, places, anchors = finder.stretches(raw)
                if not len(anchors) or not len(names):
                    continue
                at = np.minimum(np.searchsorted(names, anchors), len(names) - 1)
                known, many = np.zeros(len(codes), bool), often[at] > hot
                mark = names[at] == anchors
                hashes = finder.rolling.windows(codes, window).view(np.int64) if (many & mark).any() else None
                for j in np.flatnonzero(mark).tolist():
                    begin, end, place, anchor = int(starts[j]), int(ends[j]), int(places[j]), int(anchors[j])
                    pieces = [(w, w + 1) for w in range(begin, end)] if many[j] else [(begin, end)]
                    for first, last in pieces:
                        part = finder.units.part(units_, first, last - 1 + window)
                        digest = xxhash.xxh3_128_digest(part)
                        here = (doc_id is not None, doc_id or 0, key, first)
                        if keep_first == 1:
                            before = seen.get(digest)
                            if before is not None and before < here:
                                known[first:last] = True
                                continue
                            if before == here:
                                continue
                            seen[digest] = here
                        else:
                            times = seen.get(digest, 0)
                            if times >= keep_first:
                                known[first:last] = True
                                continue
                            seen[digest] = times + 1
                        if len(seen) > REMEMBERED:
                            seen.clear()
                        kind = STRETCH
                        if many[j]:
                            anchor = int(hashes[first])
                            if not whole_windows:
                                part, kind = digest, WINDOW
                        for column, value in zip(
                            out, (anchor, doc_id, key, first, last - first, place - first, part, kind)
                        ):
                            column.append(value)
                own = key ^ (doc_id or 0)  # known spans need not meet: copies of one text go different ways
                for first, last in zip(*(x.tolist() for x in mask_spans(known))):
                    for column, value in zip(out, (own, doc_id, key, first, last - first, 0, None, SPAN)):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield _batch(out)
                    out = [[] for _ in range(8)]
            yield _batch(out)

    return rows.select("doc_id", "_key", "text", "anchors").mapInArrow(route, ROUTED)


def _batch(columns):
    kinds = [pa.int64()] * 6 + [pa.binary(), pa.int32()]
    names = [c.split()[0] for c in ROUTED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def groups(batches):
    """Rows of each route in turn, from batches sorted by route."""
    current, rows = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[0] != current:
                if rows:
                    yield rows
                current, rows = row[0], []
            rows.append(row)
    if rows:
        yield rows


class Spans:
    """Collects repeated windows as (doc_id, _key, start, n) and hands them out in batches."""

    schema = "doc_id long, _key long, start long, n long"

    def __init__(self):
        self.rows = []

    def add(self, doc_id, key, start, mask):
        for first, last in zip(*mask_spans(mask)):
            self.rows.append((doc_id, key, start + int(first), int(last - first)))

    def batch(self):
        columns = list(zip(*self.rows)) or [[]] * 4
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "_key", "start", "n"])


def marked(docs, decide, units, window, gram, hot, keep_first, whole_windows):
    """``docs`` with _key and _spans: array of (start, n), the windows of that document that ``decide`` found to repeat.

    ``decide`` is a function from Arrow batches of routed rows, sorted by route, doc_id, _key and start, to batches of
    spans. Documents without repeats have null there. Rows of one doc_id and text get the same spans.
    """
    bounded_batches(docs.sparkSession)
    rows = routed(docs, units, window, gram, hot, keep_first, whole_windows)
    met = rows.repartition("route").sortWithinPartitions("route", "doc_id", "_key", "start")
    spans = written(
        met.mapInArrow(decide, Spans.schema)
        .groupBy("doc_id", "_key")
        .agg(F.collect_list(F.struct("start", "n")).alias("_spans")),
        "repeated-spans",
    )
    kept = [c for c in docs.columns if c.lower() not in ("_key", "_spans")]
    left, right = docs.select(*kept, text_key().alias("_key")).alias("l"), spans.alias("r")
    same = (F.col("l._key") == F.col("r._key")) & F.col("l.doc_id").cast("long").eqNullSafe(F.col("r.doc_id"))
    return left.join(right, same, "left").select("l.*", "r._spans")


def unit_mask(n, spans, window):
    """Mask of the n units covered by the repeated windows."""
    edge = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        starts = np.fromiter((s["start"] for s in spans), np.int64, len(spans))
        sizes = np.fromiter((s["n"] for s in spans), np.int64, len(spans))
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + sizes + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0
