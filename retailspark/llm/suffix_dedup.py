"""Suffix-array dedup over bytes: a depth-limited radix sort finds the windows that occur more than once.

Windows are first dealt by anchor (see ``repeats``), the radix sort's first digit. Among the stretches of one anchor,
the suffixes that begin at the anchor, and the prefixes that end there, are ordered by most-significant-digit passes
of eight bytes, no deeper than the window; stretches that differ from all others drop out of later passes. Two windows
are equal if they lie alike around the anchor and agree that far to its right and to its left.
"""

import hashlib

import numpy as np
import pyarrow as pa

from . import repeats
from .common import mask_spans, set_aside, utf8

#: Bytes of a gram whose hash anchors a window, and occurrences of an anchor from which its windows are dealt singly.
GRAM, HOT = 96, 20_000
#: Stretches sorted together.
POOL = 3000


def digits(parts, depth):
    """The first ``depth`` bytes of each part as big-endian 8-byte digits, padded with zeros."""
    width = -(-depth // 8) * 8
    raw = b"".join(part[:width].ljust(width, b"\0") for part in parts)
    return np.frombuffer(raw, ">u8").reshape(len(parts), -1).astype(np.uint64)


def equal_bytes(a, b):
    """Number of equal leading bytes of different 8-byte digits."""
    x = a ^ b
    return sum(((x >> np.uint64(8 * k)) == 0).astype(np.int64) for k in range(1, 8))


def radix_order(table, groups):
    """Order of rows within groups by their digits, and how many leading bytes each shares with the row before it.

    ``groups`` must be ascending. The first row of a group shares -1 bytes. Each pass sorts, by one digit, the rows
    that no earlier digit has told from their neighbours.
    """
    m, passes = table.shape
    order, shared = np.arange(m), np.full(m, 8 * passes, np.int64)
    shared[np.concatenate(([True], groups[1:] != groups[:-1]))] = -1
    for depth in range(passes):
        new = shared < 8 * depth
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        classes = np.cumsum(new)[at]
        digit = table[order[at], depth]
        by = np.lexsort((digit, classes))
        order[at], digit = order[at][by], digit[by]
        differs = np.flatnonzero((classes[1:] == classes[:-1]) & (digit[1:] != digit[:-1])) + 1
        shared[at[differs]] = 8 * depth + equal_bytes(digit[differs], digit[differs - 1])
    return order, shared


def repeated_windows(parts, places, sizes, groups, window):
    """For each stretch, a mask of its windows that another stretch of its group holds too.

    Stretch i has ``sizes[i]`` windows and its anchor at ``places[i]``.
    """
    places, sizes = np.asarray(places), np.asarray(sizes)
    groups = np.asarray(groups)
    right = radix_order(digits([p[at:] for p, at in zip(parts, places.tolist())], window), groups)
    left = radix_order(digits([p[:at][::-1] for p, at in zip(parts, places.tolist())], window), groups)
    base = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.zeros(base[-1], bool)
    least, most = places - sizes + 1, places
    rank = np.empty(len(parts), np.int64)
    for offset in range(int(least.min()), int(most.max()) + 1):
        has = np.flatnonzero((least <= offset) & (offset <= most))
        if len(has) < 2:
            continue
        classes = []
        for (order, shared), depth in ((right, window - offset), (left, offset)):
            rank[order] = np.cumsum(shared < depth)
            classes.append(rank[has])
        both = classes[0] * (len(parts) + 1) + classes[1]
        _, back, often = np.unique(both, return_inverse=True, return_counts=True)
        equal = has[often[back] > 1]
        flat[base[equal] + places[equal] - offset] = True
    return [flat[a:b] for a, b in zip(base[:-1], base[1:])]


def _decide(window):
    def decide(batches):
        spans, pool = repeats.Spans(), [[] for _ in range(5)]

        def sort():
            parts, places, sizes, groups, rows = pool
            for row, mask in zip(rows, repeated_windows(parts, places, sizes, groups, window)):
                if row:
                    spans.add(*row, mask)
            for column in pool:
                column.clear()

        for number, rows in enumerate(repeats.groups(batches)):
            texts = {}
            for _, doc_id, key, start, n, place, part, kind in rows:
                if kind == repeats.SPAN:
                    spans.rows.append((doc_id, key, start, n))
                else:
                    texts.setdefault((kind, part, place, n), []).append((doc_id, key, start))
            for (_, _, _, n), where in texts.items():
                if len(where) > 1:  # equal stretches: all windows repeat
                    spans.rows += [(*row, n) for row in where]
            stretches = [(k, w) for k, w in texts.items() if k[0] == repeats.STRETCH]
            if len(stretches) > 1 and any(len(w) == 1 for _, w in stretches):
                for (_, part, place, n), where in stretches:
                    row = where[0] if len(where) == 1 else None
                    for column, value in zip(pool, (part, place, n, number, row)):
                        column.append(value)
                if len(pool[0]) >= POOL:
                    sort()
            if len(spans.rows) > 20_000:
                yield spans.batch()
        if pool[0]:
            sort()
        yield spans.batch()

    return decide


def marked(docs, window=400, hot=HOT):
    """``docs`` with the byte windows that also start anywhere else, as _spans; see ``repeats.marked``.

    Texts are UTF-8 bytes, null is empty, and matches never cross documents. The same row repeated counts as copies.
    """
    return repeats.marked(docs, _decide(window), repeats.Bytes, window, min(GRAM, (window + 1) // 2), hot, 2, False)


def counts(docs, window=400):
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the remaining bytes."""
    found = marked(docs.select("doc_id", "text"), window)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            rows = [[], [], [], []]
            for raw, spans in zip(utf8(batch), batch.column("_spans").to_pylist()):
                kept, removed = _cut(raw, spans, window)
                digest = hashlib.sha256()
                for piece in kept:
                    digest.update(piece)
                values = len(raw), len(raw) - sum(map(len, kept)), removed, digest.hexdigest()
                for column, value in zip(rows, values):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(rows, kinds))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(raw, spans, window):
    """Remaining pieces of a text, and the number of maximal removed runs."""
    if not spans:
        return [raw], 0
    begins, ends = mask_spans(repeats.unit_mask(len(raw), spans, window))
    pieces, at = [], 0
    for begin, end in zip(begins.tolist(), ends.tolist()):
        pieces.append(raw[at:begin])
        at = end
    return [*pieces, raw[at:]], len(begins)


def remove_repeats(docs, window=400):
    """``docs`` with the repeated bytes cut out of ``text``; a character cut in two goes with its bytes.

    A document of which nothing is left goes; null and empty texts and all other columns stay.
    """
    docs, named = set_aside(docs, "_key", "_spans")
    found, kept = marked(docs, window), docs.columns
    at = kept.index("text")

    def cut(batches):
        for batch in batches:
            texts, keep = batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
            for i, spans in enumerate(batch.column("_spans").to_pylist()):
                if spans:
                    pieces, _ = _cut(texts[i].encode(), spans, window)
                    texts[i] = b"".join(pieces).decode("utf-8", "ignore")
                    keep[i] = any(map(len, pieces))
            columns = [batch.column(c) for c in kept]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, kept).filter(pa.array(keep))

    return named(found.mapInArrow(cut, docs.schema))
