"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_i<j <v_i, v_j> x_i x_j).  The pairwise term is computed in linear time as
(|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2.  Word features are log counts over the text's distinct hashed words, scaled to unit
length; structure statistics and the length (the only metadata that may be an input) are one-hot bins.  Weights are trained in numpy by AdaGrad on a
bounded sample of labelled rows (``per_class`` of each label, those of least id hash).

Null and empty texts have structure features only.  Texts of any length are read whole, in pieces.  Equal texts have equal scores, so
repeated rows repeat their result; a score of exactly the threshold counts as good.  Without labelled rows of both kinds every score is the sigmoid of the
prior.  Rows with a null id are scored and count as not held out.  An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_LUT, Words, arrow_map, crc_mod5, mix64, pieces, texts_of

BITS, RANK = 18, 4
BINS = 12

_CLASS = np.zeros(256, np.uint8)  # 0 letters and bytes of longer letters, 1 digits, 2 upper case, 3 white space, 4 line feed, 5 plain punctuation, 6 other symbols
_CLASS[48:58], _CLASS[65:91] = 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 3, 4
_CLASS[[ord(c) for c in ".,;:'\"()?-"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[[*range(0, 9), *range(14, 32), 127]] = 6


def structure(w: Words) -> np.ndarray:
    """Bin numbers of the structure statistics of each text: (texts, statistics)."""
    n = len(w.first)
    kind = _CLASS[w.raw]
    ends = w.text_at[1:] - 1
    size = np.maximum(ends - w.text_at[:-1], 0)
    count = np.stack([np.diff(np.concatenate(([0], np.cumsum(kind == k)))[np.stack([w.text_at[:-1], ends])], axis=0)[0] for k in range(7)], 1).astype(float)
    words = np.maximum(w.n, 1)
    share = lambda a, b: np.minimum((np.sqrt(a / np.maximum(b, 1)) * (BINS - 1)).astype(int), BINS - 1)
    owner = np.repeat(np.arange(n), w.n)
    distinct, same = np.zeros(n), np.zeros(n)
    if len(owner):
        order = np.lexsort((w.hash, owner))
        same = np.bincount(owner[1:], (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1]), minlength=n)
        new = np.concatenate(([True], (w.hash[order][1:] != w.hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])))
        distinct = np.bincount(owner[order][new], minlength=n)
    length = np.minimum(np.log2(size + 1).astype(int), BINS * 2 - 1) // 2
    mean = np.minimum((np.bincount(owner, (w.ends - w.starts), minlength=n) / words).astype(int), BINS - 1)
    return np.stack([
        length, np.minimum(np.log2(words).astype(int), BINS - 1), mean, share(count[:, 1], size), share(count[:, 2], size), share(count[:, 4] * 20, size),
        share(count[:, 5] * 4, size), share(count[:, 6], size), share(count[:, 6], words), share(distinct, words), share(count[:, 2], words), share(same, words),
    ], 1)


STATS = 12


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature number and value of every feature that is not 0."""
    w = Words(texts, SPACE_LUT, lower=False)
    n = len(texts)
    bins = structure(w)
    fixed = (1 << BITS) + bins + np.arange(STATS) * BINS
    owner = np.repeat(np.arange(n), w.n)
    key = (owner.astype(np.uint64) << np.uint64(BITS)) | (mix64(w.hash) >> np.uint64(64 - BITS))
    key, count = np.unique(key, return_counts=True)
    who, what, value = (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.log1p(count)
    norm = np.sqrt(np.bincount(who, value * value, minlength=n))
    value = value / np.maximum(norm[who], 1e-9)
    rows = np.concatenate([who, np.repeat(np.arange(n), STATS)])
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate([what, fixed.ravel()])[order], np.concatenate([value, np.full(n * STATS, 0.5)])[order].astype(np.float32)


def _sums(n: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values by row; every row has features, and they stand together."""
    return np.add.reduceat(values, np.searchsorted(rows, np.arange(n)), axis=0)


def logits(model: dict, n: int, rows, cols, x) -> tuple[np.ndarray, np.ndarray]:
    """Logits and the sums of v_i x_i, in time linear in the number of features."""
    vx = model["v"][cols] * x[:, None]
    total = _sums(n, rows, np.concatenate([vx, (vx * vx).sum(1, keepdims=True), (model["w"][cols] * x)[:, None]], 1))
    s = total[:, :RANK]
    return model["w0"] + total[:, RANK + 1] + 0.5 * ((s * s).sum(1) - total[:, RANK]), s


def train(texts: list[bytes], good: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.08, decay: float = 1e-4, seed: int = 3) -> dict:
    g = np.random.default_rng(seed)
    size = (1 << BITS) + STATS * BINS
    y = np.asarray(good, np.float64)
    prior = (y.sum() + 1) / (len(y) + 2)
    model = {"w0": float(np.log(prior / (1 - prior))), "w": np.zeros(size, np.float32), "v": g.normal(0, 0.05, (size, RANK)).astype(np.float32)}
    if len(set(y.tolist())) < 2:
        model["v"][:] = 0
        return model
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    data = []
    for i, j in pieces(texts, 1 << 20):
        rows, cols, x = features(texts[i:j])
        cut = np.searchsorted(rows, np.arange(j - i + 1))
        data += [(cols[a:b], x[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    hw, hv, h0 = np.full(size, 1e-6, np.float32), np.full((size, RANK), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = g.permutation(len(data))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            rows = np.repeat(np.arange(len(pick)), [len(data[i][0]) for i in pick])
            cols, x = np.concatenate([data[i][0] for i in pick]), np.concatenate([data[i][1] for i in pick])
            z, s = logits(model, len(pick), rows, cols, x)
            err = (((1 / (1 + np.exp(-z))) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            e = err[rows] * x
            used, at = np.unique(cols, return_inverse=True)
            gw = np.bincount(at, e, minlength=len(used)) + decay * model["w"][used]
            pair = e[:, None] * (s[rows] - model["v"][cols] * x[:, None])
            gv = np.stack([np.bincount(at, pair[:, f], minlength=len(used)) for f in range(RANK)], 1) + decay * model["v"][used]
            hw[used] += gw * gw
            hv[used] += gv * gv
            h0 += float(err.sum()) ** 2
            model["w"][used] -= (rate * gw / np.sqrt(hw[used])).astype(np.float32)
            model["v"][used] -= (rate * gv / np.sqrt(hv[used])).astype(np.float32)
            model["w0"] -= rate * float(err.sum()) / h0**0.5
    return model


def score(model: dict, texts: list[bytes]) -> np.ndarray:
    out = np.zeros(len(texts))
    for i, j in pieces(texts):
        z, _ = logits(model, j - i, *features(texts[i:j]))
        out[i:j] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, held_out, score, predicted) for each row of docs, by a model that ``train`` made (a fixed size, broadcast)."""
    spec = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(id_col, *keep, F.coalesce(crc_mod5(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("__text"))
    schema = source.drop("__text").schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for batch in batches:
            s = score(spec.value, texts_of(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return arrow_map(source, run, schema)


def keep_good(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    spec, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score(spec.value, texts_of(batch.column(at))) >= threshold))

    return arrow_map(docs, run, docs.schema)
