"""Substring dedup over words: suffix automata of reference shards, past which the later passages stream.

The reference of a passage is all that stands earlier in the corpus, so automata of the whole reference in every task
would cost (documents x shards). Instead a shard holds the passages of one anchor (see ``repeats``), and only passages
with that anchor stream past its automaton, in order of (doc_id, place); what does not repeat joins the reference.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import repeats
from .automaton import SuffixAutomaton
from .common import Numbers, set_aside, utf8, without_words

#: Words of a gram whose hash anchors a window, and occurrences of an anchor from which its windows are dealt singly.
GRAM, HOT = 8, 4000


def _decide(window):
    """Windows of each passage that the automaton of the earlier ones holds."""

    def decide(batches):
        spans = repeats.Spans()
        for rows in repeats.groups(batches):
            first, automaton, number, pending = {}, None, Numbers(), None
            for _, doc_id, key, start, n, _, part, kind in rows:
                if kind == repeats.SPAN:
                    spans.rows.append((doc_id, key, start, n))
                    continue
                here = (doc_id, key, start)
                if part in first:
                    if first[part] != here:
                        spans.rows.append((doc_id, key, start, n))
                    continue
                first[part] = here
                if len(first) == 1:
                    pending = part  # needs no automaton until another text comes
                    continue
                if automaton is None:
                    automaton = SuffixAutomaton()
                    automaton.add([number[w] for w in pending.split()])
                codes = [number[w] for w in part.split()]
                mask = np.zeros(n, bool)
                for place, matched, _ in automaton.stream(codes):
                    if matched >= window:
                        mask[place + 1 - window] = True
                spans.add(doc_id, key, start, mask)
                automaton.add(codes)
            if len(spans.rows) > 20_000:
                yield spans.batch()
        yield spans.batch()

    return decide


def marked(docs, window=20, hot=HOT):
    """``docs`` with the word windows of each document that also start earlier, as _spans; see ``repeats.marked``.

    Words are runs of characters other than ASCII white space. A window is ``window`` consecutive words of one
    document; earlier means a smaller doc_id, or the same document and an earlier start. A null doc_id comes first;
    different texts under one doc_id count in order of a hash of the text; the same row repeated counts as one.
    """
    return repeats.marked(docs, _decide(window), repeats.Words, window, min(GRAM, (window + 1) // 2), hot, 1, True)


def counts(docs, window=20):
    """Per document: doc_id, n_words, n_removed and kept_sha256 of the kept words joined by single blanks."""
    found = marked(docs.select("doc_id", "text"), window)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for raw, spans in zip(utf8(batch), batch.column("_spans").to_pylist()):
                words = raw.split()
                if spans:
                    mask = repeats.unit_mask(len(words), spans, window)
                    kept = [w for w, gone in zip(words, mask.tolist()) if not gone]
                else:
                    kept = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.mapInArrow(count, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs, window=20):
    """``docs`` with the repeated words cut out of ``text``; a document of which nothing is left goes.

    What stands between kept words stays as it is, and a document without repeats keeps its text. Null and empty
    texts, and all other columns, stay.
    """
    docs, named = set_aside(docs, "_key", "_spans")
    found, kept = marked(docs, window), docs.columns
    at = kept.index("text")

    def cut(batches):
        for batch in batches:
            texts, keep = batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
            for i, spans in enumerate(batch.column("_spans").to_pylist()):
                if spans:
                    raw = texts[i].encode()
                    mask = repeats.unit_mask(len(raw.split()), spans, window)
                    keep[i] = not mask.all()
                    texts[i] = without_words(raw, mask)
            columns = [batch.column(c) for c in kept]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, kept).filter(pa.array(keep))

    return named(found.mapInArrow(cut, docs.schema))
