"""Personal data: exact rules, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The rules find e-mail addresses, IP addresses, card numbers and phone numbers in their plain forms. The network finds forms that no rule
has: spelled-out or broken addresses, numbers with other separators, and secrets (keys and tokens), which have no rule at all. It is
trained in numpy from labelled spans: windows of the corpus with the rules' spans, and windows of the corpus in which a labelled form
(``pii_forms.TAUGHT``) or a harmless number was planted. It reads overlapping windows of ``WINDOW`` characters, each is decoded by
Viterbi with exact marginals, and the spans of all windows of a text are reconciled at once: of overlapping spans the set with the largest
sum of scores stays. The rules' spans always stay, and what a rule has looked at and turned down (a card number that fails Luhn) is not added.

A span holds a digit, an at sign or an "at" in brackets, by definition. So a window without one has no span and is not decoded; all others
are.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pii_forms
from .common import ship, steps
from .sampling import draw

#: Kinds that the rules know, and all.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Characters of a window and between window starts, so that a span of half a window lies whole in one.
WINDOW, STRIDE = 96, 48
HIDDEN, EPOCHS, BATCH, RATE = 14, 12, 64, 0.03
#: Characters of the windows that it is taught on.
LESSON = 64
#: Texts that come to the driver at most, and windows that the network is trained on: of the texts, with planted forms, with harmless numbers.
TRAIN_DOCS, OWN, PLANTED, HARMLESS = 2000, 500, 1200, 400
#: Mean marginal probability that an added span needs, and its least number of characters. It must also begin and end with a word.
SURE, SHORTEST = 0.9, 6
#: Windows decoded together.
TOGETHER = 512

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_NUMBERED = re.compile(r"(?:[^\s0-9]*[0-9]){5}\S*")
_AT = re.compile(r"[(\[{] ?at", re.I)

#: Tags: 0 outside, then beginning and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Characters: ASCII, one for all other letters, one for the rest, one beyond the text's ends.
CODES = 131


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, whether it passes its test): leftmost, non-overlapping matches of each kind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at)):
            out.append((a, 0, m.end(), True))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))) for m in _IP.finditer(text)]
        for m in _CARD.finditer(text):
            n = m.end() - m.start()
            if n >= 14:
                d = "".join(_DIGITS.findall(m[0])) if n <= 40 else ""
                out.append((m.start(), 2, m.end(), 14 <= len(d) <= 19 and _luhn(d)))
        out += [(m.start(), 3, m.end(), 10 <= len(_DIGITS.findall(m[0])) <= 15) for m in _PHONE.finditer(text)]
    return sorted(out)


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind as listed. Leftmost and non-overlapping for each kind; a match that fails its test goes."""
    return [(KINDS[k], a, b) for a, k, b, fine in _matches(text) if fine]


def _code_table() -> np.ndarray:
    t = np.full(0x10000, 129, np.uint8)
    t[:128] = np.arange(128)
    for c in range(128, 0x10000):
        if chr(c).isalpha():
            t[c] = 128
    return t


_CODE = _code_table()


def codes_of(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODE[np.minimum(c, 0xFFFF)]


def window_starts(codes: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit, an at sign or an "at" in brackets; every such character is in two, but near the start."""
    hit = ((codes >= 48) & (codes <= 57)) | (codes == 64)
    for k in np.flatnonzero((codes == 40) | (codes == 91) | (codes == 123)).tolist():
        hit[k] = bytes(codes[k + 1 : k + 4]).strip().lower().startswith(b"at")
    hit = np.flatnonzero(hit) // STRIDE
    return np.unique(np.maximum(np.concatenate((hit, hit - 1)), 0)) * STRIDE


def cut(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate((codes, np.full(WINDOW, CODES - 1, np.uint8)))
    return padded[starts[:, None] + np.arange(WINDOW)]


class Tagger:
    """The network: for each direction a table of input weights by character, recurrent weights; then emissions and transitions.

    Both directions run side by side: the backward one reads the window from its end.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 11) -> Tagger:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["x" + d] = r.normal(0, 0.3, (CODES, 4 * HIDDEN))
            w["x" + d][:, HIDDEN : 2 * HIDDEN] += 1  # the forget gate starts open
            w["h" + d] = r.normal(0, 0.5 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w["o"], w["c"], w["t"] = r.normal(0, 0.3, (2 * HIDDEN, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS))
        for k in range(len(KINDS)):  # inside follows only its own kind
            bad = [t for t in range(TAGS) if t not in (1 + 2 * k, 2 + 2 * k)]
            w["t"][bad, 2 + 2 * k] = -8
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, codes: np.ndarray, keep: bool):
        """Hidden states (steps, 2, HIDDEN, windows), the backward direction from the end; with keep, the gates, cells and their tanh too."""
        n, many, size = len(codes), codes.shape[1], HIDDEN
        kind = self.w["o"].dtype
        half = np.ones((4 * size, 1), kind)
        half[: 3 * size] = 0.5  # a sigmoid is half a tanh of the half, and a half
        gates = np.empty((many, 2, 4 * size, n), kind)
        for k, (d, own) in enumerate((("f", codes.T), ("b", codes[:, ::-1].T))):
            np.copyto(gates[:, k], (self.w["x" + d] * half[:, 0])[own].transpose(0, 2, 1))
        back = np.stack((self.w["hf"].T, self.w["hb"].T)) * half
        h, c = np.zeros((2, size, n), kind), np.zeros((2, size, n), kind)
        held = many if keep else 0
        hidden, cells, tanhs = np.empty((many, 2, size, n), kind), np.empty((held, 2, size, n), kind), np.empty((held, 2, size, n), kind)
        for s in range(many):
            g = gates[s]
            g += back @ h
            np.tanh(g, out=g)
            three = g[:, : 3 * size]
            three *= 0.5
            three += 0.5
            c = three[:, size : 2 * size] * c
            c += three[:, :size] * g[:, 3 * size :]
            tc = np.tanh(c)
            h = np.multiply(three[:, 2 * size :], tc, out=hidden[s])
            if keep:
                cells[s], tanhs[s] = c, tc
        return hidden, gates, cells, tanhs

    def emissions(self, codes: np.ndarray, keep: bool = False):
        states = self._run(codes, keep)
        both = np.concatenate((states[0][:, 0], states[0][::-1, 1]), axis=1)
        return (self.w["o"].T @ both).transpose(0, 2, 1) + self.w["c"], both, states

    def marginals(self, e: np.ndarray):
        """Scaled forward and backward probabilities, log partition sums and marginals of the tags; last the scales and exponentials used."""
        move, n = np.exp(self.w["t"].astype(np.float64)), len(e)
        top = e.max(2, keepdims=True)
        x = np.exp((e - top).astype(np.float64))
        a, b, scale = np.empty_like(x), np.ones_like(x), np.empty(x.shape[:2])
        for s in range(n):
            p = x[s] if s == 0 else (a[s - 1] @ move) * x[s]
            scale[s] = p.sum(1)
            a[s] = p / scale[s][:, None]
        for s in range(n - 2, -1, -1):
            b[s] = ((x[s + 1] * b[s + 1]) @ move.T) / scale[s + 1][:, None]
        return a, b, np.log(scale).sum(0) + top[:, :, 0].sum(0), a * b, (scale, x, move)

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        e, both, (hidden, gates, cells, tanhs) = self.emissions(codes, True)
        a, b, _, m, (scale, x, move) = self.marginals(e)
        n, many = codes.shape
        size, kind = HIDDEN, e.dtype
        gold = tags.T
        de = m.copy()
        de[np.arange(many)[:, None], np.arange(n)[None], gold] -= 1
        de = (de / n).astype(kind)
        ahead = x[1:] * b[1:] / scale[1:, :, None]
        dt = move * (a[:-1].reshape(-1, TAGS).T @ ahead.reshape(-1, TAGS)) / n
        np.add.at(dt, (gold[:-1], gold[1:]), -1 / n)
        wide = lambda x: x.transpose(1, 0, 2).reshape(x.shape[1], -1)
        g = {"o": wide(both) @ de.reshape(-1, TAGS), "c": de.sum((0, 1)), "t": dt}
        out = self.w["o"] @ de.transpose(0, 2, 1)
        out = np.stack((out[:, :size], out[::-1, size:]), 1)
        back = np.stack((self.w["hf"], self.w["hb"]))
        dgates = np.empty_like(gates)
        dh, dc = np.zeros((2, size, n), kind), np.zeros((2, size, n), kind)
        for s in range(many - 1, -1, -1):
            i, f, o, z = (gates[s][:, k * size : (k + 1) * size] for k in range(4))
            tc, dg = tanhs[s], dgates[s]
            dh += out[s]
            dc += dh * o * (1 - tc * tc)
            dg[:, :size] = dc * z * i * (1 - i)
            dg[:, size : 2 * size] = dc * cells[s - 1] * f * (1 - f) if s else 0
            dg[:, 2 * size : 3 * size] = dh * tc * o * (1 - o)
            dg[:, 3 * size :] = dc * i * (1 - z * z)
            dc *= f
            dh = back @ dg
        for k, (d, own) in enumerate((("f", codes.T), ("b", codes[:, ::-1].T))):
            flat, rows = own.ravel(), dgates[:, k].transpose(0, 2, 1).reshape(-1, 4 * size)
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.diff(flat[order].astype(np.int16), prepend=-1))
            g["x" + d] = np.zeros_like(self.w["x" + d])
            g["x" + d][flat[order][first]] = np.add.reduceat(rows[order], first)
            g["h" + d] = wide(hidden[:-1, k]) @ wide(dgates[1:, k]).T
        return g

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each window, and their marginal probabilities (1 all along a window without a span)."""
        e = self.emissions(codes)[0]
        many, n, _ = e.shape
        best, back = e[0], np.zeros((many, n, TAGS), np.int8)
        for s in range(1, many):
            every = best[:, :, None] + self.w["t"][None]
            back[s] = every.argmax(1)
            best = np.take_along_axis(every, back[s][:, None].astype(np.int64), 1)[:, 0] + e[s]
        tags = np.zeros((many, n), np.int8)
        tags[-1] = best.argmax(1)
        for s in range(many - 1, 0, -1):
            tags[s - 1] = back[s][np.arange(n), tags[s]]
        sure = np.ones((n, many))
        if len(some := np.flatnonzero(tags.any(0))):
            m = self.marginals(e[:, some])[3]
            sure[some] = np.take_along_axis(m, tags[:, some, None].astype(np.int64), 2)[:, :, 0].T
        return tags.T, sure


def tag_row(size: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(size, np.int8)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


def _windows(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    c = codes_of(text)
    starts = window_starts(c)
    own = [s for k, s in enumerate(spans) if not k or s[1] >= spans[k - 1][2]]
    row = np.concatenate((tag_row(len(c), own), np.zeros(WINDOW, np.int8)))
    return cut(c, starts)[:, :LESSON], row[starts[:, None] + np.arange(LESSON)]


def lessons(texts: list[str], r: np.random.Generator, kinds: dict[str, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: of the texts with the rules' spans, half of them with one where there are as many; with planted forms; with
    harmless numbers. A window of a text teaches nothing where nobody has labelled it: where it holds what a rule has turned down, or a word
    with five digits or more outside the rules' spans."""
    codes, tags = [], []
    for text in texts:
        own = rule_spans(text)
        c, t = _windows(text, own)
        no = [(a, b) for a, _, b, fine in _matches(text) if not fine]
        no += [m.span() for m in _NUMBERED.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in own)]
        if len(c) and no:
            at = window_starts(codes_of(text))
            keep = np.array([not any(a < w + LESSON and w < b for a, b in no) for w in at.tolist()])
            c, t = c[keep], t[keep]
        codes.append(c)
        tags.append(t)
    codes, tags = np.concatenate(codes), np.concatenate(tags)
    broken = (tags[:, 0] > 0) & (tags[:, 0] % 2 == 0)
    codes, tags = codes[~broken], tags[~broken]  # a window that starts inside a span has no beginning to learn
    with_, without = np.flatnonzero((tags > 0).any(1)), np.flatnonzero(~(tags > 0).any(1))
    half = OWN // 2
    pick = np.concatenate((r.permutation(with_)[: max(half, OWN - len(without))], r.permutation(without)[: max(half, OWN - len(with_))]))
    codes, tags = [codes[pick]], [tags[pick]]
    for own, n in ((kinds or pii_forms.TAUGHT, PLANTED), ({"": pii_forms.PLAIN}, HARMLESS)):
        for text, spans in pii_forms.planted(texts, own, n, r, LESSON):
            base = rule_spans(text)
            if not spans or not any(a < spans[0][2] and spans[0][1] < b for _, a, b in base):
                text, spans = text[:LESSON], [s for s in [*base, *spans] if s[2] <= LESSON]
                c = codes_of(text)
                codes.append(cut(c, np.zeros(1, np.int64))[:, :LESSON])
                tags.append(np.concatenate((tag_row(len(c), sorted(spans, key=lambda s: s[1])), np.zeros(LESSON, np.int8)))[None, :LESSON])
    return np.concatenate(codes), np.concatenate(tags).astype(np.int64)


def fit(texts: list[str], kinds: dict[str, list] | None = None) -> Tagger | None:
    """A tagger taught with the rules' spans in the texts and with forms planted in them. None without texts."""
    if not texts:
        return None
    r = np.random.default_rng(3)
    net = Tagger.fresh()
    codes, tags = lessons(texts, r, kinds)
    one, two, k = {}, {}, 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(codes))
        rate = RATE * (1 - 0.9 * epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            k += 1
            own = order[at : at + BATCH]
            for name, g in net.gradients(codes[own], tags[own]).items():
                one[name] = 0.9 * one.get(name, 0) + 0.1 * g
                two[name] = 0.99 * two.get(name, 0) + 0.01 * g * g
                net.w[name] = (net.w[name] - rate * (one[name] / (1 - 0.9**k)) / (np.sqrt(two[name] / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
    return net


def candidates(tags: np.ndarray, sure: np.ndarray, start: int, size: int) -> list[tuple[str, int, int, float]]:
    """Spans of a window, in the text's places, with their scores; one that touches an end of the window that is not the text's goes."""
    out, at, n = [], 0, len(tags)
    while at < n:
        t = int(tags[at])
        if not t:
            at += 1
            continue
        k, to = (t - 1) // 2, at + 1
        while to < n and tags[to] == 2 + 2 * k:
            to += 1
        if t == 1 + 2 * k and (at or not start) and (to < n or start + n >= size) and start + to <= size:
            out.append((KINDS[k], start + at, start + to, float(sure[at:to].mean())))
        at = to
    return out


def reconcile(base: list[tuple[str, int, int]], added: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """All base spans, and of the added ones, clear of those, the non-overlapping set with the largest sum of scores (earlier ends win ties)."""
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for kind, a, b, s in added:
        if not any(x < b and a < y for _, x, y in base):
            best[a, b] = max(best.get((a, b), (0.0, "")), (s, kind))
    rows = sorted(((b, a, s, kind) for (a, b), (s, kind) in best.items()))
    ends = [r[0] for r in rows]
    total, take = [0.0], []
    for i, (b, a, s, _) in enumerate(rows):
        j = bisect.bisect_right(ends, a, 0, i)
        take.append((total[j] + s > total[i], j))
        total.append(max(total[i], total[j] + s))
    chosen, i = [], len(rows)
    while i:
        if take[i - 1][0]:
            b, a, _, kind = rows[i - 1]
            chosen.append((kind, a, b))
            i = take[i - 1][1]
        else:
            i -= 1
    return sorted([*base, *chosen], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _holds(part: str) -> bool:
    return "@" in part or bool(_DIGITS.search(part)) or bool(_AT.search(part))


def spans_of(texts: list[str], net: Tagger | None) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text; without a network they are the same."""
    every = [_matches(t) for t in texts]
    base = [[(KINDS[k], a, b) for a, k, b, fine in m if fine] for m in every]
    added: list[list] = [[] for _ in texts]
    wins, who, at, sizes = [], [], [], {}
    for i, t in enumerate(texts):
        if net and _holds(t):
            c = codes_of(t)
            starts = window_starts(c)
            sizes[i] = len(c)
            wins.append(cut(c, starts))
            who += [i] * len(starts)
            at += starts.tolist()
    if wins:
        rows = np.concatenate(wins)
        for k in range(0, len(rows), TOGETHER):
            tags, sure = net.decode(rows[k : k + TOGETHER])
            for row in np.flatnonzero((tags > 0).any(1)).tolist():
                i = who[k + row]
                for kind, a, b, s in candidates(tags[row], sure[row], at[k + row], sizes[i]):
                    part, edges = texts[i][a:b], texts[i][a - 1 : a] + texts[i][b : b + 1] if a else texts[i][b : b + 1]
                    if s >= SURE and b - a >= SHORTEST and part == part.strip() and not any(map(str.isalnum, edges)) and _holds(part):
                        added[i].append((kind, a, b, s))
    for i, own in enumerate(added):
        if own and (no := [(a, b) for a, _, b, fine in every[i] if not fine]):
            added[i] = [x for x in own if not any(a < x[2] and x[1] < b for a, b in no)]
    return [(b, reconcile(b, a)) for b, a in zip(base, added)]


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Tagger | None:
    """A tagger taught on texts with a digit or an at sign; at most ``most`` texts, of ``sampling.SAMPLE_BYTES`` at most, come to the driver."""
    return fit([r.text for r in draw(docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]")), most)])


def _found(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            got = spans_of([t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()], net.value)
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in g[k]] for g in got], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "base_spans", "pii_spans"])

    return run


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(df: DataFrame, net: Tagger | None) -> DataFrame:
    """Adds base_spans and pii_spans (arrays of kind, start, end in code points, by start) to df; columns of these names are replaced.

    A null text is empty. Whole texts are read; nothing is shuffled.
    """
    ship(df.sparkSession)
    df = df.drop("base_spans", "pii_spans")
    return df.mapInArrow(_found(df.sparkSession.sparkContext.broadcast(net)), T.StructType([*df.schema.fields, T.StructField("base_spans", _SPANS), T.StructField("pii_spans", _SPANS)]))


def digests(df: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *map(count, BASE), F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))


def _masked(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            for i, (_, spans) in enumerate(spans_of([t or "" for t in texts], net.value)):
                if spans:
                    texts[i] = mask(texts[i], spans)
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return run


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in square brackets."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def masked(df: DataFrame, net: Tagger | None) -> DataFrame:
    """df with the personal data of every text replaced, and n_chars, where df has it, counted anew."""
    ship(df.sparkSession)
    out = df.mapInArrow(_masked(df.sparkSession.sparkContext.broadcast(net)), T.StructType(df.schema.fields))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(df.schema["n_chars"].dataType))) if "n_chars" in df.columns else out
