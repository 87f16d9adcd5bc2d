"""Small documents with every awkward case, and plain versions of what the operators compute."""

import hashlib
import random
import re
from collections import Counter

DDL = "doc_id long, text string, lang string, source string, n_chars long, _key string, score string, label string"


def make(seed=5, n=60):
    """Texts that share passages, copies, near copies, repeated lines, nulls, empty and very long ones."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6))) for _ in range(150)]
    passage = [" ".join(draw.choice(vocabulary) for _ in range(40)) for _ in range(4)]
    texts = []
    for i in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 120))]
        if i % 3 == 0:
            words[draw.randint(0, len(words)) : 0] = draw.choice(passage).split()[draw.randint(0, 8) :]
        texts.append(draw.choice([" ", "  ", "\n", "\t"]).join(words) if i % 7 == 0 else " ".join(words))
    for i in range(0, n, 9):
        texts.append(texts[i])
        near = texts[i].split()
        for _ in range(2):
            if near:
                near[draw.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [None, "", "   ", "one", "Two words", "\x1c odd blank ", "Of " * 300, "of " * 299, "日本語 テキスト です", "<|endoftext|> x"]
    texts.append(" ".join(draw.choice(vocabulary) for _ in range(20_000)))
    return list(enumerate(texts))


def rows(seed=5, n=60):
    found = [(i, t, "en", "src0", None if t is None else len(t), "k", "s", "l") for i, t in make(seed, n)]
    return found + [found[3]]  # a repeated row


def frame(spark, values=None, parts=5):
    return spark.createDataFrame(rows() if values is None else values, DDL).repartition(parts)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def words(text):
    return [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", text or "")]


def substring_counts(docs, window=20):
    """Contract of the word windows: removed where the window starts earlier, by (doc_id, start)."""
    first = {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (doc_id, i))
    out = {}
    for doc_id, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (doc_id, i):
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[doc_id] = (len(w), sum(gone), sha(b" ".join(kept)))
    return out


def suffix_counts(docs, window=400):
    """Contract of the byte windows: removed where the string starts anywhere else."""
    raws = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(r[i : i + window] for _, r in raws for i in range(len(r) - window + 1))
    out = []
    for doc_id, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if seen[raw[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(raw), sum(gone), spans, sha(kept)))
    return sorted(out)


def shingles(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_components(docs, similarity=75):
    """Contract of the near duplicates, by all pairs."""
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= similarity * (len(x) + len(y) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(s), root(d), root(d) == d) for d, s in sets}


def benchmark_hits(docs, items, window=10):
    """Contract of the decontamination."""

    def split(text):
        lower = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        w, found = split(text), set()
        hit = [False] * len(w)
        for size in sizes:
            for i in range(len(w) - size + 1):
                owners = windows.get(tuple(w[i : i + size]))
                if owners:
                    found |= owners
                    hit[i : i + size] = [True] * size
        out[doc_id] = (len(w), sum(hit), len(found), sha(",".join(sorted(found)).encode()), any(hit))
    return out
