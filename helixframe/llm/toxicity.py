"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Each word step has as inputs a learned embedding of the word, the mean of learned embeddings of its character 5- and 6-grams
(word edges included), the word's evidence, the strongest and the mean evidence of these grams, and its length.  A word of more than
LONG bytes, such as a sentence of a script without spaces, is several steps, and no gram of it is left out.  Evidence is the signed root of the
likelihood-ratio statistic of a hashed word or character gram between toxic and clean training texts.  A gated recurrent layer reads each window in both directions, attention pools its states, and a logistic unit
scores it.  Windows of WINDOW words start every STRIDE words, so that each passage of up to WINDOW - STRIDE words stands whole in one; the text's score is its largest window
score.  Everything, embeddings included, is trained in numpy on the driver by back-propagation through time, on a bounded sample of labelled
rows (``per_class`` of each label, those of least id hash); evidence for a training text comes from the other folds, and half of the training windows
go without embeddings, so that the network does not learn to trust words seen once.  Words and grams of fewer than SEEN training texts have no embedding.

Null, empty and wordless texts are one window without words.  Texts of any length are read whole, in pieces; equal texts have equal
scores, so repeated rows repeat their result; a score of exactly the threshold counts as toxic.  Without labelled rows of both kinds,
evidence and weights stay as initialised and every score is about 0.5 or lower.  Rows with a null id are scored and count as not held out.
An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_SEP_LUT, Words, _hash_spans, arrow_map, crc_mod5, mix64, pieces, texts_of

WINDOW, STRIDE = 64, 32
#: Inputs that are evidence or length, numbers of an embedding, all inputs of a step, and numbers of a state.
GIVEN, EMBED, HIDDEN = 4, 6, 8
INPUTS = GIVEN + 2 * EMBED
#: Bits of the bucket of a word or gram for its evidence, and for its embedding (the first of them); training texts that an embedded one stands in.
BITS, EMBED_BITS, SEEN = 21, 16, 5
#: Bytes of a step: a longer word, or a run of a script without spaces, is several steps.
LONG = 40
#: Bytes whose grams are expanded at once.
BLOCK = 1 << 20
GRAMS = (5, 6)
BATCH = 2048


class Steps(Words):
    """Words, those of more than LONG bytes cut into steps of about LONG bytes at borders of characters, and the distinct steps.

    A step's grams start in it and run on to ``reach``, over its end into the next step of the word; only the first and the last
    step have an edge (``opens``, ``closes``).  ``distinct`` holds a step of each kind, ``rows`` the kind of each step.
    """

    __slots__ = ("closes", "distinct", "opens", "reach", "rows")

    def __init__(self, texts: list[bytes]):
        super().__init__(texts, ALNUM_SEP_LUT)
        sizes, key = self.ends - self.starts, self.hash
        self.reach, self.opens, self.closes = self.ends, np.ones(len(sizes), bool), np.ones(len(sizes), bool)
        if sizes.max(initial=0) > LONG:
            parts = -(-sizes // LONG)
            last = np.cumsum(parts) - 1
            k = np.arange(int(parts.sum())) - np.repeat(last + 1 - parts, parts)
            whole, word_end = np.repeat(parts == 1, parts), np.repeat(self.ends, parts)
            starts = np.repeat(self.starts, parts) + LONG * k
            for _ in range(3):  # back to the first byte of a character
                starts -= (k > 0) & (self.buf[starts] & 0xC0 == 0x80)
            ends = np.append(starts[1:], 0)
            ends[last] = self.ends
            self.opens, self.closes = k == 0, np.zeros(len(k), bool)
            self.closes[last] = True
            self.reach = np.minimum(ends + max(GRAMS) - 1, word_end)
            hashes = np.repeat(self.hash, parts)
            key = hashes.copy()
            hashes[~whole] = _hash_spans(self.buf, starts[~whole], ends[~whole])
            with np.errstate(over="ignore"):
                kind = self.opens + 2 * self.closes + 4 * (ends - starts)
                key[~whole] = mix64(_hash_spans(self.buf, starts[~whole], self.reach[~whole]) + kind[~whole].astype(np.uint64))
            self.starts, self.ends, self.hash = starts, ends, hashes
            bounds = np.searchsorted(starts, self.text_at)
            self.first, self.n = bounds[:-1], np.diff(bounds)
        _, self.distinct, self.rows = np.unique(key, return_index=True, return_inverse=True)

    def buckets(self) -> np.ndarray:
        """Word bucket of each distinct step."""
        return self.hash[self.distinct] >> np.uint64(64 - BITS)

    def grams(self):
        """(gram buckets, distinct step of each gram) of blocks of the distinct steps, of about BLOCK bytes each."""
        upto = np.cumsum(self.reach[self.distinct] - self.starts[self.distinct])
        low = 0
        while low < len(upto):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + BLOCK, "right")))
            first = self.distinct[low:high]
            starts, opens = self.starts[first], self.opens[first].astype(np.int64)
            used = self.reach[first] - starts
            full = used + opens + self.closes[first]
            total = int(full.sum())
            head = np.cumsum(full) - full
            edge = np.full(total, 1, np.uint64)  # a byte that no word has marks the edges
            k = np.arange(int(used.sum())) - np.repeat(np.cumsum(used) - used, used)
            edge[np.repeat(head + opens, used) + k] = self.buf[np.repeat(starts, used) + k]
            owner = np.repeat(np.arange(low, high), full)
            grams, owners = [], []
            with np.errstate(over="ignore"):
                for n in GRAMS:
                    if total >= n:
                        acc = np.zeros(total - n + 1, np.uint64)
                        for j in range(n):
                            acc = acc * np.uint64(257) + edge[j : total - n + 1 + j]
                        inside = owner[: total - n + 1] == owner[n - 1 :]
                        grams.append(mix64(acc[inside] + np.uint64(n << 56)) >> np.uint64(64 - BITS))
                        owners.append(owner[: total - n + 1][inside])
            if grams:
                yield np.concatenate(grams), np.concatenate(owners)
            low = high


def _grams_of(s: Steps) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the grams of all distinct steps, by step, and where those of each step begin."""
    parts = [(g, o) for g, o in s.grams()]
    gram = np.concatenate([np.empty(0, np.uint64), *(g for g, _ in parts)])
    owner = np.concatenate([np.empty(0, np.int64), *(o for _, o in parts)])
    order = np.argsort(owner, kind="stable")
    return gram[order], np.searchsorted(owner[order], np.arange(len(s.distinct) + 1))


def _given(s: Steps, words: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Evidence and length of each distinct step."""
    return _inputs(s, {"words": words, "grams": grams, "word_vectors": None})


def _inputs(s: Steps, model: dict) -> np.ndarray:
    """Inputs of each distinct step; without embeddings where the model has none."""
    embedded = model["word_vectors"] is not None
    x = np.zeros((len(s.distinct), INPUTS if embedded else GIVEN), np.float32)
    buckets = s.buckets()
    x[:, 0] = model["words"][buckets]
    if embedded:
        x[:, GIVEN : GIVEN + EMBED] = model["word_vectors"][buckets >> np.uint64(BITS - EMBED_BITS)]
    for gram, owner in s.grams():
        order = np.argsort(owner, kind="stable")
        gram, owner = gram[order], owner[order]
        at = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(at):
            has, n = owner[at], np.diff(np.append(at, len(owner)))
            value = model["grams"][gram]
            x[has, 1], x[has, 2] = np.maximum.reduceat(value, at), np.add.reduceat(value, at) / n
            if embedded:
                x[has, GIVEN + EMBED :] = np.add.reduceat(model["gram_vectors"][gram >> np.uint64(BITS - EMBED_BITS)], at) / n[:, None]
    x[:, 3] = np.log1p((s.ends - s.starts)[s.distinct]) / 3
    return x


def windows_of(n: int) -> np.ndarray:
    """First words of the windows over n words."""
    return np.array([0]) if n <= WINDOW else np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    """Weights of both directions, stacked on the first axis, and of attention and output."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {
            "x": g.normal(0, 0.4, (2, INPUTS, 3 * h)), "h": g.normal(0, 0.3, (2, h, 3 * h)), "b": np.zeros((2, 3 * h)),
            "a": g.normal(0, 0.3, 2 * h), "o": g.normal(0, 0.3, 2 * h), "c": np.full(1, -1.0),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; x: (time, windows, inputs), mask: (time, windows), 1 where there is a word."""
        w, h = self.w, HIDDEN
        steps, n = mask.shape
        states = np.zeros((2, steps, n, h), np.float32)
        tape: list[list] = [[], []]
        for d in range(2):
            now = np.zeros((n, h), np.float32)
            into = x @ w["x"][d] + w["b"][d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                rec = now @ w["h"][d]
                gates = _sigmoid(into[t, :, : 2 * h] + rec[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(into[t, :, 2 * h :] + r * rec[:, 2 * h :])
                z = z * mask[t][:, None]
                if keep:
                    tape[d].append((t, now, z, r, new, rec[:, 2 * h :]))
                now = now + z * (new - now)
                states[d, t] = now
        both = np.concatenate([states[0], states[1]], axis=2)
        score = both @ w["a"] + (mask - 1) * 1e4
        alpha = np.exp(score - score.max(0, keepdims=True)) * mask
        alpha /= np.maximum(alpha.sum(0, keepdims=True), 1e-9)
        pooled = (alpha[:, :, None] * both).sum(0)
        logit = pooled @ w["o"] + w["c"][0]
        return (logit, both, alpha, pooled, tape) if keep else logit

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weights, and of the inputs under the name "inputs"."""
        w, h = self.w, HIDDEN
        logit, both, alpha, pooled, tape = self.forward(x, mask, keep=True)
        err = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["inputs"] = np.zeros_like(x)
        g["o"], g["c"][0] = pooled.T @ err, err.sum()
        dpool = err[:, None] * w["o"]
        dalpha = (both * dpool).sum(2)
        dscore = alpha * (dalpha - (alpha * dalpha).sum(0, keepdims=True))
        g["a"] = np.einsum("tn,tnk->k", dscore, both)
        dboth = alpha[:, :, None] * dpool + dscore[:, :, None] * w["a"]
        for d in range(2):
            carry = np.zeros((x.shape[1], h), np.float32)
            for t, was, z, r, new, rec in reversed(tape[d]):
                dh = dboth[t, :, d * h : (d + 1) * h] + carry
                dz = dh * (new - was) * mask[t][:, None]
                dnew = dh * z * (1 - new * new)
                zz = np.where(mask[t][:, None] > 0, z, 0.5)
                pre = np.concatenate([dz * zz * (1 - zz), dnew * rec * r * (1 - r), dnew], 1)
                drec = np.concatenate([pre[:, : 2 * h], dnew * r], 1)
                g["x"][d] += x[t].T @ pre
                g["inputs"][t] += pre @ w["x"][d].T
                g["b"][d] += pre.sum(0)
                g["h"][d] += was.T @ drec
                carry = dh * (1 - z) + drec @ w["h"][d].T
        return g


def _evidence(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Signed root of the likelihood-ratio statistic of presence in toxic (row 1) against clean (row 0) texts, in thirds, cut at 4."""
    out = np.zeros(counts.shape[1], np.float32)
    has = np.flatnonzero(counts.any(0))  # most buckets are empty, and their evidence is 0
    counts, total = counts[:, has].astype(np.float64), max(n.sum(), 1.0)
    rate = np.clip(counts.sum(0) / total, 1e-12, 1 - 1e-12)
    g2 = np.zeros(len(has))
    for c in (0, 1):
        own = counts[c] / max(n[c], 1.0)
        g2 += 2 * counts[c] * np.log(np.maximum(own, 1e-12) / rate) + 2 * (n[c] - counts[c]) * np.log(np.maximum(1 - own, 1e-12) / (1 - rate))
    sign = np.sign(counts[1] * n[0] - counts[0] * n[1])
    out[has] = np.clip(sign * np.sqrt(np.maximum(g2, 0)) / 3, -4, 4)
    return out


def train(texts: list[bytes], toxic: np.ndarray, folds: int = 3, steps: int = 240, batch: int = 192, seed: int = 5) -> dict:
    """The model of labelled texts: evidence tables and network weights."""
    net = BiGru()
    y = np.asarray(toxic, np.int64)
    tables = [Steps([t]) for t in texts]
    fold = np.arange(len(texts)) % folds
    size = 1 << BITS
    counts = np.zeros((folds, 2, 2, size), np.uint16 if len(texts) < 65_000 else np.uint32)  # fold, word or gram, label, bucket
    for i, table in enumerate(tables):
        if len(table.hash):
            counts[fold[i], 0, y[i], np.unique(table.buckets())] += 1
            counts[fold[i], 1, y[i], np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(gram) for gram, _ in table.grams())]))] += 1
    n = np.array([[np.sum((fold == f) & (y == c)) for c in (0, 1)] for f in range(folds)], np.float64)
    g = np.random.default_rng(seed)
    known = [(counts[:, part].sum((0, 1), dtype=np.uint32).reshape(1 << EMBED_BITS, -1).sum(1) >= SEEN).astype(np.float32) for part in (0, 1)]
    vectors = [(g.normal(0, 0.03, (1 << EMBED_BITS, EMBED)) * k[:, None]).astype(np.float32) for k in known]
    model = {
        "words": _evidence(counts[:, 0].sum(0, dtype=np.uint32), n.sum(0)), "grams": _evidence(counts[:, 1].sum(0, dtype=np.uint32), n.sum(0)), "net": net.w,
        "word_vectors": vectors[0], "gram_vectors": vectors[1],
    }
    if len(set(y.tolist())) < 2:
        return model
    xs, ms, ys, word_at, gram_at, step_at = [], [], [], [], [], []  # of each window: given inputs, mask, label, buckets of its words, and of its grams with their steps
    for f in range(folds):
        others = [k for k in range(folds) if k != f]
        ev = [_evidence(counts[others, part].sum(0, dtype=np.uint32), n[others].sum(0)) for part in (0, 1)]
        for i in np.flatnonzero(fold == f):
            if not len(tables[i].hash):
                continue
            rows = tables[i].rows
            x = _given(tables[i], *ev)[rows]
            words, (grams, first) = tables[i].buckets() >> np.uint64(BITS - EMBED_BITS), _grams_of(tables[i])
            at = windows_of(len(x))
            best = [float(np.sort(x[a : a + WINDOW, :2].max(1))[-3:].sum()) for a in at]
            picks = {int(at[int(np.argmax(best))])}
            if not y[i]:
                picks.add(int(g.choice(at)))
            for a in picks:
                piece, own = x[a : a + WINDOW], rows[a : a + WINDOW]
                many = np.diff(first)[own]
                place = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
                xs.append(np.pad(piece, ((0, WINDOW - len(piece)), (0, 0))))
                ms.append(np.arange(WINDOW) < len(piece))
                ys.append(y[i])
                word_at.append(np.pad(words[own].astype(np.int32), (0, WINDOW - len(piece))))
                gram_at.append((grams[place] >> np.uint64(BITS - EMBED_BITS)).astype(np.int32))
                step_at.append(np.repeat(np.arange(len(own)), many).astype(np.int32))
    del tables, counts
    x, m, yy, word_at = np.stack(xs).astype(np.float32), np.stack(ms).astype(np.float32), np.array(ys, np.float32), np.stack(word_at)
    weight = np.where(yy > 0, 0.25 / max(yy.sum(), 1), 0.75 / max((1 - yy).sum(), 1)).astype(np.float32)
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    squares = [np.full_like(v, 1e-4) for v in vectors]
    for step in range(1, steps + 1):
        pick = g.choice(len(yy), min(batch, len(yy)), replace=False)
        rate = 0.02 * (1 if step < steps * 0.7 else 0.3)
        used = (g.random(len(pick)) < 0.5).astype(np.float32)[:, None, None]
        gram = np.concatenate([gram_at[i] for i in pick])
        owner = np.concatenate([step_at[i] + WINDOW * k for k, i in enumerate(pick)])
        many = np.maximum(np.bincount(owner, minlength=len(pick) * WINDOW), 1).astype(np.float32)
        mean = _by_row(owner, vectors[1][gram], len(many)) / many[:, None]
        full = np.concatenate([x[pick], vectors[0][word_at[pick]] * used, mean.reshape(len(pick), WINDOW, EMBED) * used], 2)
        grads = net.gradients(full.transpose(1, 0, 2), m[pick].T, yy[pick], weight[pick])
        back = grads.pop("inputs").transpose(1, 0, 2)[:, :, GIVEN:] * used
        into = (back[:, :, :EMBED].reshape(-1, EMBED), (back[:, :, EMBED:].reshape(-1, EMBED) / many[:, None])[owner])
        for table, square, seen, bucket, grad in zip(vectors, squares, known, (word_at[pick].ravel(), gram), into, strict=True):
            at, place = np.unique(bucket, return_inverse=True)
            total = _by_row(place, grad, len(at)) * seen[at][:, None]
            square[at] += total * total
            table[at] -= 0.1 * rate * total / np.sqrt(square[at])
        for k, v in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            net.w[k] = (net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    model["net"] = net.w
    return model


def _by_row(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by row number."""
    return np.stack([np.bincount(row, values[:, k], minlength=n) for k in range(values.shape[1])], 1).astype(np.float32)


def score(model: dict, texts: list[bytes]) -> np.ndarray:
    """Score of each text: its largest window score."""
    net = BiGru()
    net.w = model["net"]
    out = np.zeros(len(texts))
    for i, j in pieces(texts):
        w = Steps(texts[i:j])
        starts, ends, owner = [], [], []
        for t in range(j - i):
            at = w.first[t] + windows_of(int(w.n[t]))
            starts.append(at)
            ends.append(np.minimum(at + WINDOW, w.first[t] + w.n[t]))
            owner.append(np.full(len(at), i + t))
        start, end, owner = np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)
        x = np.concatenate([_inputs(w, model)[w.rows], np.zeros((1, INPUTS), np.float32)])
        order = np.argsort(end - start, kind="stable")
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            long = int((end[pick] - start[pick]).max())
            at = start[pick][None, :] + np.arange(max(long, 1))[:, None]
            mask = (at < end[pick][None, :]).astype(np.float32)
            logit = net.forward(x[np.where(mask > 0, at, len(x) - 1)], mask)
            np.maximum.at(out, owner[pick], _sigmoid(logit.astype(np.float64)))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most per_class ids of each label, those of least id hash; rows held out (crc32 of the id modulo 5 is 0) never.

    An id with both labels counts as 1, one with several texts gives the least, so that repeated rows add nothing.  The texts come to the driver
    whole: 2 * per_class of them, whatever the size of the table.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (crc_mod5(F.col("id")) != 0))
    parts = [rows.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    picked = parts[0].unionByName(parts[1]).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    found = texts.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy(F.xxhash64("id"), "id").toPandas()
    return [t.encode() for t in found["text"]], found["y"].to_numpy(np.int64)


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id_col, held_out, score, predicted) for each row of docs, by a model that ``train`` made (a fixed size, broadcast)."""
    spec = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(id_col, F.coalesce(crc_mod5(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("__text"))
    schema = source.drop("__text").schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for batch in batches:
            s = score(spec.value, texts_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return arrow_map(source, run, schema)
