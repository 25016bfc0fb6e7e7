"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of ``PASSAGE`` words. Each passage is encoded by a dense layer over features of its form and hashed words; a
gated attention (tanh times sigmoid) gives it a weight; the weighted sum of the encodings is scored by a logistic layer. All weights are
learnt together, by gradient descent in numpy, from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, steps, utf8
from .language import bucket
from .sampling import draw
from .shingles import word_hashes, words

#: Words of a passage, labelled rows learnt from at most (half of each label; their bytes: ``sampling.SAMPLE_BYTES``), and size of an encoding.
PASSAGE, TRAIN_DOCS, HIDDEN = 64, 2000, 16
#: Hashed words: places of the bag.
BAG = 16
STEPS, RATE, DECAY = 90, 0.03, 1e-4

_KINDS = np.zeros((6, 256), bool)
_KINDS[0, 65:91] = True
_KINDS[1, 48:58] = True
_KINDS[2, [ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~"]] = True
_KINDS[3, [ord(c) for c in ".,;:?'\"()-"]] = True
_KINDS[4, [9, 10, 13]] = True
_KINDS[5, 128:] = True
FEATURES = len(_KINDS) + 7 + BAG


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and for each text the number of its first (one more at the end). A text without words has one empty passage."""
    start, end, first = words(data, offs)
    h = word_hashes(data, start, end)
    per = np.diff(first)
    many = np.maximum(1, -(-per // PASSAGE))
    begin = np.concatenate(([0], np.cumsum(many)))
    doc = np.repeat(np.arange(len(per)), per)
    own = begin[doc] + (np.arange(len(h)) - first[doc]) // PASSAGE
    n = int(begin[-1])
    x = np.zeros((n, FEATURES))
    count = np.bincount(own, minlength=n).astype(float)
    some = np.maximum(count, 1)
    size = np.bincount(own, end - start, n)
    run = np.zeros(len(data) + 1, np.int32)
    gap = np.append(start[1:], len(data)) if len(start) else start
    for k, kind in enumerate(_KINDS):
        np.cumsum(kind[data], out=run[1:])
        x[:, k] = np.bincount(own, run[gap] - run[start], n) / np.maximum(size, 1)
    k = len(_KINDS)
    same = np.zeros((2, len(h)))
    for d in (1, 2):
        same[d - 1, d:] = (h[d:] == h[:-d]) & (doc[d:] == doc[:-d])
        x[:, k + d - 1] = np.bincount(own, same[d - 1], n) / some
    different = np.unique((own.astype(np.uint64) << np.uint64(40)) ^ (h >> np.uint64(24)))
    x[:, k + 2] = np.bincount((different >> np.uint64(40)).astype(np.int64), minlength=n)[:n] / some
    x[:, k + 3] = size / some / 8
    x[:, k + 4] = np.bincount(own, np.minimum(end - start, 64) ** 2, n) / some / 64
    x[:, k + 5] = count / PASSAGE
    x[:, k + 6] = count == 0
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    bag = np.bincount(own * BAG + (h & np.uint64(BAG - 1)).astype(np.int64), sign, n * BAG).reshape(n, BAG)
    x[:, k + 7 :] = bag / np.sqrt(some)[:, None] / 4
    return x, begin


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, begin[:-1], axis=0)


class Model:
    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.w = mean, scale, weights

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict:
        a, b, v, u, w, c, d = self.w
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ a + b)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * s) @ w
        bag = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        e = np.exp(e - np.maximum.reduceat(e, begin[:-1])[bag])
        att = e / _sums(e, begin)[bag]
        z = _sums(h * att[:, None], begin)
        return {"x": x, "h": h, "t": t, "s": s, "bag": bag, "att": att, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ c + d, -30, 30)))}

    def gradients(self, f: dict, begin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        a, b, v, u, w, c, d = self.w
        g = (f["p"] - y) * weight / weight.sum()
        dz = g[:, None] * c
        h, t, s, att, bag = f["h"], f["t"], f["s"], f["att"], f["bag"]
        dh = att[:, None] * dz[bag]
        datt = (h * dz[bag]).sum(1)
        de = att * (datt - _sums(att * datt, begin)[bag])
        dt, ds = de[:, None] * w * s * (1 - t * t), de[:, None] * w * t * s * (1 - s)
        dh += dt @ v.T + ds @ u.T
        dx = dh * (1 - h * h)
        return [f["x"].T @ dx, dx.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, f["z"].T @ g, g.sum()]

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if len(offs) < 2:
            return np.zeros(0)
        x, begin = passages(data, offs)
        return self.forward(x, begin)["p"]


def fit(texts: list[str], labels: list[int]) -> Model:
    """Learns from document labels 0 and 1, each class with the same weight in all. Without texts, every score is 0.5."""
    r = np.random.default_rng(9)
    shapes = [(FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, HIDDEN), (HIDDEN, HIDDEN), (HIDDEN,), (HIDDEN,), ()]
    if not texts:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), [np.zeros(s) for s in shapes])
    raw = [t.encode() for t in texts]
    x, begin = passages(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw]))))
    y = np.array(labels, float)
    share = np.bincount(y.astype(int), minlength=2) / len(y)
    weight = 1 / np.maximum(share[y.astype(int)], 1e-3)
    model = Model(x.mean(0), x.std(0) + 1e-3, [r.normal(0, 1 / np.sqrt(max(s[0] if s else 1, 1)), s) for s in shapes])
    one, two = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for k in range(1, STEPS + 1):
        grads = model.gradients(model.forward(x, begin), begin, y, weight)
        for i, g in enumerate(grads):
            g = g + DECAY * model.w[i]
            one[i] = 0.9 * one[i] + 0.1 * g
            two[i] = 0.99 * two[i] + 0.01 * g * g
            model.w[i] = model.w[i] - RATE * (one[i] / (1 - 0.9**k)) / (np.sqrt(two[i] / (1 - 0.99**k)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Learns from labels.quality of rows whose crc32(doc_id) mod 3 is not 1; at most ``most`` rows come to the driver, drawn by id and text, so
    an id that many rows of docs or labels share counts no more than others. Of an id with both labels, both count."""
    own = labels.select("doc_id", "quality", F.col("doc_id").cast("string").alias("text")).where((bucket() % 3 != 1) & F.col("quality").isin(0, 1)).distinct()
    ids = labels.sparkSession.createDataFrame([(r.doc_id, r._label) for r in draw(own, most, "quality")], "doc_id long, quality int")
    rows = draw(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id"), most, "quality")  # at most `most` ids
    return fit([r.text for r in rows], [r._label for r in rows])


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", 2 << 20):
            score = model.value.score(*utf8(b.column(b.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, "quality_score"])

    return run


def score(df: DataFrame, model: Model) -> DataFrame:
    """Adds quality_score (0 to 1; higher: label 1 is likelier) to df; a column of that name is replaced. A null text is empty, and an
    empty text has one empty passage. Whole texts are scored; nothing is shuffled."""
    ship(df.sparkSession)
    df = df.drop("quality_score")
    return df.mapInArrow(_scored(df.sparkSession.sparkContext.broadcast(model)), T.StructType([*df.schema.fields, T.StructField("quality_score", T.DoubleType())]))
