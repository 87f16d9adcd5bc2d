"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a text word by word, each with a blank on either side, and labels every byte position. Equal words
get equal labels, so a task runs each distinct word once and adds it up as often as it stands in a text.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import bounded_batches, texts

#: Bytes of a word read at a time; longer words are read in pieces of this length.
LONGEST = 32
#: Distinct words whose labels a task keeps at a time.
KEPT = 200_000
#: Documents from which the network learns, and characters of each: a sample of fixed size.
SAMPLE_DOCS, SAMPLE_CHARS = 2400, 600


def pieces_of(word):
    """The byte sequences in which a word is read."""
    raw = b" " + word.encode("utf-8", "replace") + b" "
    return [raw[i : i + LONGEST] for i in range(0, len(raw), LONGEST)]


def by_length(sequences):
    """Indexes of equally long sequences, with their bytes as a matrix."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    for n in np.unique(lengths):
        index = np.flatnonzero(lengths == n)
        raw = np.frombuffer(b"".join([sequences[i] for i in index]), np.uint8)
        yield index, raw.reshape(len(index), n)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """One gated layer in each direction; gates in the order update, reset, candidate."""

    def __init__(self, classes, hidden=20, seed=7):
        draw = np.random.default_rng(seed)
        self.classes, self.hidden = list(classes), hidden
        k, h = len(self.classes), hidden
        f32 = np.float32
        self.p = {"out": draw.normal(0, 0.1, (2 * h, k)).astype(f32), "bias": np.zeros(k, f32)}
        for side in "fb":
            self.p["in" + side] = draw.normal(0, 0.2, (256, 3 * h)).astype(f32)
            self.p["rec" + side] = draw.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(f32)

    def _run(self, rows, side, keep=False):
        h, n, steps = self.hidden, len(rows), rows.shape[1]
        fed, rec = self.p["in" + side], self.p["rec" + side]
        state, states, trace = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            x, u = fed[rows[:, t]], state @ rec
            gates = sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
            z, r, inner = gates[:, :h], gates[:, h:], u[:, 2 * h :]
            new = np.tanh(x[:, 2 * h :] + r * inner)
            if keep:
                trace.append((t, state, z, r, inner, new))
            state = states[t] = new + z * (state - new)
        return states, trace

    def labels(self, rows):
        """Probabilities by position, row and class."""
        both = np.concatenate([self._run(rows, "f")[0], self._run(rows, "b")[0]], axis=2)
        return self._softmax(both @ self.p["out"] + self.p["bias"])

    @staticmethod
    def _softmax(x):
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def gradients(self, rows, labels):
        """Mean loss over all positions, and its gradients by backpropagation through time."""
        h, (n, steps) = self.hidden, rows.shape
        runs = {side: self._run(rows, side, keep=True) for side in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        prob = self._softmax(both @ self.p["out"] + self.p["bias"])
        rows_at = np.arange(n)
        loss = -np.log(prob[:, rows_at, labels] + 1e-9).mean()
        prob[:, rows_at, labels] -= 1
        prob /= n * steps
        grads = {
            "out": both.reshape(-1, 2 * h).T @ prob.reshape(-1, prob.shape[2]),
            "bias": prob.sum(axis=(0, 1)),
        }
        down = prob @ self.p["out"].T
        for side, part in (("f", down[:, :, :h]), ("b", down[:, :, h:])):
            rec = self.p["rec" + side]
            d_in, d_rec = np.zeros_like(self.p["in" + side]), np.zeros_like(rec)
            later = np.zeros((n, h), np.float32)
            for t, before, z, r, inner, new in reversed(runs[side][1]):
                d = part[t] + later
                d_new = d * (1 - z) * (1 - new**2)
                d_z = d * (before - new) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_new], axis=1)
                d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
                np.add.at(d_in, rows[:, t], d_x)
                d_rec += before.T @ d_u
                later = d * z + d_u @ rec.T
            grads["in" + side], grads["rec" + side] = d_in, d_rec
        return loss, grads

    def fit(self, sequences, labels, epochs=3, batch=192, rate=0.01, seed=11):
        """Learns from byte sequences by Adam over shuffled batches of equally long ones."""
        labels, draw = np.asarray(labels), np.random.default_rng(seed)
        groups = list(by_length(sequences))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, batches = 0, sum(-(-len(index) // batch) for index, _ in groups) * epochs
        for _ in range(epochs):
            todo = []
            for g, (index, _) in enumerate(groups):
                order = draw.permutation(len(index))
                todo += [(g, order[i : i + batch]) for i in range(0, len(order), batch)]
            for at in draw.permutation(len(todo)):
                g, order = todo[at]
                index, rows = groups[g]
                _, grads = self.gradients(rows[order], labels[index[order]])
                step += 1
                now = rate * (1 - step / (batches + 1)) * len(order) / batch
                for name, grad in grads.items():
                    first[name] += 0.1 * (grad - first[name])
                    second[name] += 0.01 * (grad**2 - second[name])
                    scale = np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6
                    self.p[name] -= (now * first[name] / (1 - 0.9**step) / scale).astype(np.float32)
        return self


class Reader:
    """Pools the labels of all positions of a text's words that have a letter."""

    def __init__(self, network):
        self.network, self.known = network, {}
        self.sums = np.zeros((0, len(network.classes)))
        self.sizes = np.zeros(0)

    def _learn(self, words):
        """Labels words not met before: sum of probabilities over their positions, and the positions' number."""
        if len(self.known) + len(words) > KEPT:
            self.known, words = {}, None
            return False
        sequences, owner = [], []
        for i, word in enumerate(words):
            if any(map(str.isalpha, word)):
                parts = pieces_of(word)
                sequences += parts
                owner += [i] * len(parts)
        owner = np.array(owner, np.int64)
        sums, sizes = np.zeros((len(words), len(self.network.classes))), np.zeros(len(words))
        for index, rows in by_length(sequences) if sequences else ():
            for i in range(0, len(index), 4096):
                part, at = rows[i : i + 4096], owner[index[i : i + 4096]]
                np.add.at(sums, at, self.network.labels(part).sum(axis=0))
                np.add.at(sizes, at, part.shape[1])
        base = len(self.known)
        self.known.update({w: base + i for i, w in enumerate(words)})
        self.sums = np.concatenate([self.sums[:base], sums])
        self.sizes = np.concatenate([self.sizes[:base], sizes])
        return True

    def read(self, batch):
        """Class probabilities of each text; a row of zeros where there is no letter."""
        out = np.zeros((len(batch), len(self.network.classes)))
        split = [text.lower().split() for text in batch]
        at, alone = 0, False
        while at < len(split):  # as many texts at a time as have room for their new words
            new, end = {}, at
            while end < len(split) and len(new) < KEPT // 4 and not (alone and end > at):
                new.update(dict.fromkeys(w for w in split[end] if w not in self.known))
                end += 1
            fresh, whole = list(new), True
            for i in range(0, len(fresh), KEPT // 4):
                whole &= self._learn(fresh[i : i + KEPT // 4])
            if not whole and (end - at > 1 or len(fresh) <= KEPT // 4):
                alone = True  # forgot everything: gather the words of one text again, since no group of it may fit
                continue
            for i in range(at, end):
                out[i] = self._pool(split[i])
            at, alone = end, False
        return out

    def _pool(self, words):
        if not words:
            return 0
        if any(w not in self.known for w in words):  # more distinct words than are kept: in parts
            sums, size = 0.0, 0.0
            for i in range(0, len(words), KEPT // 4):
                part = words[i : i + KEPT // 4]
                fresh = [w for w in dict.fromkeys(part) if w not in self.known]
                if not self._learn(fresh):
                    self._learn(list(dict.fromkeys(part)))
                index = np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))
                sums, size = sums + self.sums[index].sum(axis=0), size + self.sizes[index].sum()
        else:
            index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            sums, size = self.sums[index].sum(axis=0), self.sizes[index].sum()
        return sums / size if size else 0


def remainder():
    """crc32 of the doc_id as text, modulo 4; null counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)), F.lit(0))


def train(docs, held_out=None, sample_docs=SAMPLE_DOCS, sample_chars=SAMPLE_CHARS, seed=7):
    """A network fitted to ``text`` and non-null ``lang`` of the rows outside ``held_out``; None without such rows.

    The languages are all that occur, however rare. The fit uses a bounded sample: ``sample_docs`` documents, spread
    evenly over the languages and chosen by a hash of the row, and of each ``sample_chars`` characters around its
    middle. Only these and one count per language reach the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if held_out is not None:
        rows = rows.where(~held_out)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    classes = sorted(counts)
    each = max(1, sample_docs // len(classes))
    draw = F.pmod(F.xxhash64("doc_id", "lang", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(v) for c in classes for v in (c, min(1.0, 1.5 * each / counts[c] + 20 / counts[c]))])
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - sample_chars) / 2)).cast("int")
    some = (
        rows.select("lang", "text", draw.alias("u"))
        .where(F.col("u") < share[F.col("lang")])
        .select("lang", F.col("text").substr(middle, F.lit(sample_chars)).alias("text"), "u")
        .orderBy("u", "lang", "text")
        .limit(4 * sample_docs + 40 * len(classes))
        .collect()
    )
    taken, sequences, labels = dict.fromkeys(classes, 0), [], []
    for row in some:
        if taken[row["lang"]] < each:
            taken[row["lang"]] += 1
            parts = [p for w in row["text"].lower().split() if any(map(str.isalpha, w)) for p in pieces_of(w)]
            sequences += parts
            labels += [classes.index(row["lang"])] * len(parts)
    network = Network(classes, seed=seed)
    return network.fit(sequences, labels) if len(classes) > 1 and sequences else network


def predict(docs, network):
    """``docs`` with lang_pred and score, the probability of that language averaged over all positions.

    A text that is null or has no letter is ``und`` with score 0, and so is every text where there was nothing to
    learn from (``network`` is None). Texts are read whole, in any length. Repeated rows get equal results; columns
    stay, and those named lang_pred or score are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    if network is None:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    bounded_batches(docs.sparkSession)
    state = docs.sparkSession.sparkContext.broadcast(network)

    def label(batches):
        reader = Reader(state.value)
        names = np.array(state.value.classes, object)
        for batch in batches:
            prob = reader.read(texts(batch))
            best = prob.argmax(axis=1)
            score = np.clip(prob[np.arange(len(prob)), best], 0, 1)
            found = [str(names[b]) if s > 0 else "und" for b, s in zip(best, score)]
            columns = [batch.column(c) for c in kept] + [pa.array(found, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])

    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.select(*kept).mapInArrow(label, schema)
