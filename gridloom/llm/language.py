"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. A word's probability in a language is the sum, over all
ways to cut it into pieces, of the products of their probabilities; the forward algorithm computes it in one pass over the word, for
all words of a block and all languages at once (long words letter by letter). All lower-case pieces of letters count, whatever their length,
and texts are read as their words of letters in lower case. A text's score is the product over its words times the language's share, normalised
over the languages. The piece probabilities are learnt by expectation maximisation (forward and backward) on labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, steps
from .sampling import draw
from .shingles import mix

#: Labelled texts that the probabilities are learnt from at most, the same share of each language; their bytes: ``sampling.SAMPLE_BYTES``.
TRAIN_DOCS = 2400
#: Words of more letters are worked on one by one, so that their cost is in proportion to their length.
LONG = 128
#: Rounds of expectation maximisation, pseudo-count of a piece, and probability of a letter without a piece.
ROUNDS, PSEUDO, UNKNOWN = 4, 0.05, 1e-7
#: Words of one length that are worked on at once.
WIDE = 20_000
#: A letter's probability is scaled by this, so that products stay near one.
_SCALE = 12.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARK = 0x2581
_BITS = 21


class Vocabulary:
    """The lower-case letter pieces of a SentencePiece model, by hash; number 0 is none, 1 an unknown letter. Beginnings of pieces that are no
    piece themselves have numbers from ``len(pieces)`` on, so a search goes on only where a longer piece may follow."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        bare = (p.piece for p in proto.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL)
        own = [p for p in bare if (w := p.removeprefix("▁")) == w.lower() and (not w or w.isalpha())]
        self.pieces = ["", "?", *own]
        self.number = {p: i for i, p in enumerate(self.pieces) if i > 1}
        self.longest = max(map(len, own), default=1)
        self.begun = {p[:k] for p in own for k in range(1, len(p))}
        h = np.array([0, 1, *(self._hash(p) for p in own), *(self._hash(p) for p in sorted(self.begun - set(own)))], np.uint64)
        self.goes_on = np.array([False, False, *(p in self.begun for p in own), *([True] * (len(h) - len(self.pieces)))])
        self.hash = h
        self.first, self.second = np.zeros(1 << _BITS, np.int32), np.zeros(1 << _BITS, np.int32)
        for i in range(2, len(h)):
            a, b = int(h[i]) >> (64 - _BITS), int(h[i]) & ((1 << _BITS) - 1)
            if self.first[a] == 0:
                self.first[a] = i
            elif self.second[b] == 0:
                self.second[b] = i
            else:
                raise ValueError("two pieces share both places")

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * _BASE + np.uint64(ord(c))
        return mix(h)[0]

    def find(self, h: np.ndarray) -> np.ndarray:
        h = mix(h)
        i = self.first[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
        miss = np.flatnonzero(self.hash[i] != h)
        if len(miss):
            j = self.second[(h[miss] & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
            i[miss] = np.where(self.hash[j] == h[miss], j, 0)
        return i


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and its lower case (the first letter of it)."""
    n = 0x110000
    letter = np.array([chr(c).isalpha() for c in range(n)])
    lower = np.arange(n, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        lower[c] = ord(chr(c).lower()[0])
    return letter, lower


def words_of(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Different words as arrays of code points by length, the word (by number) at each place, and the first place of each text."""
    letter, lower = _letters()
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    is_letter = letter[code]
    edge = np.zeros(len(code) + 1, bool)
    edge[edges] = True
    before, after = np.ones(len(code), bool), np.ones(len(code), bool)
    before[1:], after[:-1] = ~is_letter[:-1], ~is_letter[1:]
    start = np.flatnonzero(is_letter & (before | edge[:-1]))
    end = np.flatnonzero(is_letter & (after | edge[1:])) + 1
    first = np.searchsorted(start, edges)
    code = lower[code]
    size = end - start
    h = np.zeros(len(start), np.uint64)
    left = np.arange(len(start))
    for k in range(int(size.max()) if len(size) else 0):
        left = left[size[left] > k]
        h[left] = h[left] * _BASE + code[start[left] + k]
    _, at, number = np.unique(mix(h), return_index=True, return_inverse=True)
    order = np.argsort(size[at], kind="stable")
    at = at[order]
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(len(order))
    groups, sizes = [], size[at]
    for n in np.unique(sizes).tolist():
        own = at[sizes == n]
        m = np.full((len(own), n + 1), _MARK, np.uint32)
        m[:, 1:] = code[start[own][:, None] + np.arange(n)]
        groups.append(m)
    return groups, to[number.reshape(-1)], first


def _forward(v: Vocabulary, codes: np.ndarray, p: np.ndarray, counts: np.ndarray | None = None, sums: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities (words by languages) of words of one length; with counts, adds expected counts of pieces to sums."""
    w, n = codes.shape
    kinds, known = p.shape[1], len(v.pieces)
    alpha = np.zeros((n + 1, w, kinds))
    alpha[0] = 1
    log = np.zeros((w, kinds))
    found = []
    for i in range(n):
        if i and i % 32 == 0 and counts is None:
            by = alpha[i].copy()
            by[by <= 0] = 1
            log += np.log(by)
            alpha[i : i + v.longest] /= by
        at, h = np.arange(w), np.zeros(w, np.uint64)
        for size in range(1, min(v.longest, n - i) + 1):
            h = h * _BASE + codes[at, i + size - 1]
            ids = v.find(h)
            goes_on = v.goes_on[ids]
            ids[ids >= known] = 0
            if size == 1:
                ids[ids == 0] = 1
            if len(hit := np.flatnonzero(ids)):
                ids, own = ids[hit], at[hit]
                alpha[i + size, own] += alpha[i, own] * p[ids]
                if counts is not None:
                    found.append((i, size, own, ids))
            at, h = at[goes_on], h[goes_on]
            if not len(at):
                break
    whole = np.maximum(alpha[n], 1e-300)
    if counts is not None:
        beta = np.zeros_like(alpha)
        beta[n] = 1
        share = counts / whole
        for i, size, at, ids in reversed(found):
            step = p[ids] * beta[i + size, at]
            beta[i, at] += step
            mass = alpha[i, at] * step * share[at]
            for k in range(kinds):
                sums[:, k] += np.bincount(ids, mass[:, k], len(sums))
    return np.log(whole) + log - n * np.log(_SCALE)


def _single(v: Vocabulary, codes: np.ndarray, p: np.ndarray, counts: np.ndarray | None = None, sums: np.ndarray | None = None) -> np.ndarray:
    """The same for one word (1 by letters) of any length, in time in proportion to it; sums are rescaled as they go."""
    word = codes[0].tobytes().decode("utf-32-le", "surrogatepass")
    n, kinds, number, begun = len(word), p.shape[1], v.number, v.begun
    cuts = []  # for each place the pieces that start there: their sizes and numbers
    for i in range(n):
        own = [(1, number.get(word[i], 1))]
        size = 1
        while i + size < n and word[i : i + size] in begun:
            size += 1
            if k := number.get(word[i : i + size]):
                own.append((size, k))
        cuts.append(own)
    out = np.zeros((1, kinds))
    for lang in range(kinds):
        own = p[:, lang].tolist()
        ring, log, scales = [0.0] * (n + 1), 0.0, []
        ring[0] = 1.0
        for i, found in enumerate(cuts):
            a = ring[i]
            if i % 32 == 0 and i and a > 0:
                log += np.log(a)
                for k in range(i, min(n + 1, i + v.longest + 1)):
                    ring[k] /= a
                scales.append((i, a))
                a = 1.0
            for size, k in found:
                ring[i + size] += a * own[k]
        out[0, lang] = np.log(max(ring[n], 1e-300)) + log - n * np.log(_SCALE)
        if counts is not None and counts[0, lang]:
            by = dict(scales)
            beta, many = [0.0] * (n + 1), counts[0, lang] / max(ring[n], 1e-300)
            beta[n] = 1.0
            # ring[i] is as left by the scales up to i; what follows is divided by the same scales when they are passed
            for i in range(n - 1, -1, -1):
                total = 0.0
                for size, k in cuts[i]:
                    step = own[k] * beta[i + size]
                    total += step
                    sums[k, lang] += ring[i] * step * many
                beta[i] = total
                if i in by:
                    a = by[i]
                    for k in range(i, min(n + 1, i + v.longest + 1)):
                        beta[k] /= a
    return out


def _each(v: Vocabulary, group: np.ndarray, p: np.ndarray, counts: np.ndarray | None = None, sums: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities of a group of words of one length."""
    long = group.shape[1] > LONG
    step, one = (1, _single) if long else (WIDE, _forward)
    return np.concatenate([one(v, group[a : a + step], p, None if counts is None else counts[a : a + step], sums) for a in range(0, len(group), step)])


class Model:
    def __init__(self, path: str, langs: list[str], p: np.ndarray, prior: np.ndarray):
        self.path, self.langs, self.p, self.prior = path, langs, p, prior

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """For each text the likeliest language, ``und`` without a letter, and its share of the probability (0 for ``und``)."""
        v = vocabulary(self.path)
        groups, number, first = words_of(texts)
        logs = [_each(v, g, self.p) for g in groups]
        total = np.zeros((len(number) + 1, len(self.langs)))
        if logs:
            np.cumsum(np.concatenate(logs)[number], axis=0, out=total[1:])
        each = total[first[1:]] - total[first[:-1]] + self.prior
        best = each.argmax(axis=1)
        share = 1 / np.exp(each - each.max(axis=1, keepdims=True)).sum(axis=1)
        none = first[1:] == first[:-1]
        return ["und" if no else self.langs[k] for k, no in zip(best.tolist(), none.tolist())], np.where(none, 0.0, share)


def fit(texts: list[str], langs: list[str], path: str) -> Model:
    """Learns from labelled texts; without any, a model that answers ``und``."""
    v = vocabulary(path)
    kinds = sorted(set(langs)) or ["und"]
    place = {k: i for i, k in enumerate(kinds)}
    groups, number, first = words_of(texts)
    words = sum(map(len, groups))
    label = np.repeat(np.array([place[x] for x in langs], np.int64), np.diff(first)) if texts else np.zeros(0, np.int64)
    counts = np.bincount(number * len(kinds) + label, minlength=words * len(kinds)).reshape(words, len(kinds)).astype(float)
    size = np.array([len(x) for x in v.pieces])
    scale = (_SCALE**size)[:, None]
    p = np.full((len(v.pieces), len(kinds)), 1 / len(v.pieces)) * scale
    p[0], p[1] = 0, UNKNOWN * _SCALE
    for _ in range(ROUNDS):
        sums, at = np.zeros_like(p), 0
        for g in groups:
            _each(v, g, p, counts[at : at + len(g)], sums)
            at += len(g)
        sums[:2] = 0
        sums[2:] += PSEUDO
        p = sums / sums.sum(axis=0) * scale
        p[1] = UNKNOWN * _SCALE
    share = np.bincount(np.array([place[x] for x in langs], np.int64), minlength=len(kinds)) + 1.0
    return Model(path, kinds, p, np.log(share / share.sum()))


def bucket(column: str = "doc_id"):
    """crc32 of the id as text, by which rows are held out and samples drawn."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def train(docs: DataFrame, path: str, most: int = TRAIN_DOCS) -> Model:
    """Learns from text and lang of docs whose crc32(doc_id) mod 4 is not 2; at most ``most`` rows come to the driver, the same share of each
    lang (fewer rows of a lang that has fewer), drawn by id and text."""
    got = draw(docs.select("doc_id", "text", "lang").where(bucket() % 4 != 2), most, "lang")
    return fit([r.text for r in got], [r.lang for r in got], path)


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in steps(batches, "text", 3 << 20):
            lang, score = m.score([t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "lang_score"])

    return run


def identify(df: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred (a learnt language, or ``und`` where the text is null or has no letter) and lang_score (0 to 1) to df.

    Columns of df with these names are replaced. Ties go to the language that sorts first. Whole texts are scored; nothing is shuffled.
    """
    ship(df.sparkSession)
    df = df.drop("lang_pred", "lang_score")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return df.mapInArrow(_predicted(df.sparkSession.sparkContext.broadcast(model)), schema)
