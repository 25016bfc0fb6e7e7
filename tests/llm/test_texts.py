"""Text operators against brute force, the libraries, and held-out labels, on small fixtures with hard rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from gridloom.llm import components, containment, html_text, language, ngram_join, pii, piece_codec, quality, token_orc
from gridloom.llm.common import Scratch

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))
HARD = [
    (1, BASE), (2, BASE.upper()), (3, BASE + " more words here"), (4, BASE.replace("word30", "other")), (5, None), (6, ""), (7, "  \n\t"), (8, "one two"), (9, "One  TWO"),
    (10, LONG), (11, LONG + " tail"), (12, "a\x1fb é ́x 'tis <|endoftext|> İ ß ﬁ ▁x  y"), (12, BASE), (None, BASE), (14, " ".join(f"word{i}" for i in range(30))), (15, "123 @ 4"),
]


def frame(spark, rows=HARD):
    extra = [(*r, 7, "y", 3) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, n int, fp string, shard int")


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """Rows with an id are the vertices; a component has the smallest id of its rows."""
    own = [(d, shingles(t)) for d, t in rows if d is not None]
    up = list(range(len(own)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    where = collections.defaultdict(set)
    for i, (_, s) in enumerate(own):
        for j in {j for g in s for j in where[g]}:
            t = own[j][1]
            if 100 * len(s & t) >= 75 * len(s | t):
                up[top(i)] = top(j)
        for g in s:
            where[g].add(i)
    least = {}
    for i, (d, _) in enumerate(own):
        least[top(i)] = min(d, least.get(top(i), d))
    out = collections.Counter((d, len(s), least[top(i)]) for i, (d, s) in enumerate(own))
    return out + collections.Counter((None, len(shingles(t)), None) for d, t in rows if d is None)


def test_ngram_join_hard_rows(spark):
    got = ngram_join.ngram_jaccard_components(frame(spark)).collect()
    assert collections.Counter(map(tuple, got)) == brute_components(HARD)
    kept = ngram_join.ngram_jaccard_keep(frame(spark)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 5, 6, 7, 8, 10, 12, 14, 15]
    assert ngram_join.ngram_jaccard_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block, long, few", [(4096, 64, 0), (3, 1 << 40, 1 << 20), (2, 0, 1 << 20)])
def test_ngram_join_chains(spark, monkeypatch, block, long, few):
    """Chains of near copies, in which neighbours link and distant ones do not; with small blocks too."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(components, "FEW", few)
    r = np.random.default_rng(1)
    rows, k = [], 0
    for g in range(6):
        w = [f"g{g}v{i}" for i in range(80)]
        for step in range(12):
            w = list(w)
            for at in r.integers(0, 80, 2):
                w[at] = f"g{g}s{step}a{at}"
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k + i, "shared passage of exactly eight words stands here " + " ".join(f"d{i}q{j}" for j in range(int(r.integers(1, 12))))) for i in range(40)]
    got = ngram_join.ngram_jaccard_components(frame(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == brute_components(rows)


def test_containment(spark):
    items = [(1, " ".join(f"word{i}" for i in range(10, 30))), (2, "absent words " * 9), (3, None), (4, "one two"), (1, " ".join(f"word{i}" for i in range(10, 30))), (5, " ".join(f"word{i}" for i in range(20)) + " z y x w")]
    items_df = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    want = collections.Counter()
    for d, t in HARD:
        for i, q in items:
            s = shingles(q)
            if s and 4 * len(s & shingles(t)) >= 3 * len(s):
                want[d, i, len(s), len(s & shingles(t)), len(s & shingles(t)) / len(s)] += 1
    assert want
    assert collections.Counter(map(tuple, containment.contained_items(frame(spark), items_df).collect())) == want
    held = lambda t: any((s := shingles(q)) and 4 * len(s & shingles(t)) >= 3 * len(s) for _, q in items)
    clean = containment.without_items(frame(spark), items_df)
    assert collections.Counter(r.doc_id for r in clean.collect()) == collections.Counter(d for d, t in HARD if not held(t))
    assert clean.columns == frame(spark).columns
    assert containment.contained_items(frame(spark, []), items_df).count() == 0
    assert containment.contained_items(frame(spark), items_df.limit(0)).count() == 0


def test_containment_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK", 20)
    items = spark.createDataFrame([(i, " ".join(f"word{j}" for j in range(i, i + 20))) for i in range(6)], "item_id long, text string")
    got = containment.contained_items(frame(spark), items)
    assert {r.item_id for r in got.where("doc_id = 1").collect()} == set(range(6))


def test_pieces_equal_library(spark):
    rows = piece_codec.encode_pieces(frame(spark), PIECES).collect()
    c = piece_codec.codec(PIECES)
    texts = {d: t or "" for d, t in HARD if d != 12}
    assert len(rows) == len(HARD)
    for r in rows:
        text = r.text or ""
        ids = np.frombuffer(r.piece_ids, "<u4").tolist()
        assert ids == c.library.encode(text, add_bos=True, add_eos=True)
        assert r.decoded == c.library.decode(ids)
        a, b, raw = np.frombuffer(r.piece_starts, "<u4"), np.frombuffer(r.piece_ends, "<u4"), text.encode()
        assert b"".join(raw[x:y] for x, y in zip(a, b)) == raw
    assert texts
    assert piece_codec.digests(piece_codec.encode_pieces(frame(spark, []), PIECES)).count() == 0


def test_character_map():
    """A hand-built double array with the keys A -> a, AE -> ae (longest prefix wins), and a space run."""
    pool = b"a\0ae\0"
    units = [0] * 2048

    def place(node, offset, leaf=False):
        units[node] = (units[node] & 0xFF) | (offset ^ node) << 10 | leaf << 8

    units[0] = 0
    place(0, 256)
    at = 256 ^ ord("A")
    units[at] = ord("A")
    place(at, 512, True)
    units[512] = 0x80000000 | 0
    two = 512 ^ ord("E")
    units[two] = ord("E")
    place(two, 1024, True)
    units[1024] = 0x80000000 | 2
    m = piece_codec.CharacterMap((len(units) * 4).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + pool)
    assert m.longest(b"AEx", 0) == (2, b"ae") and m.longest(b"AxE", 0) == (1, b"a") and m.longest(b"xA", 0) is None
    c = piece_codec.Codec(PIECES)
    c.map, c.trim = m, True
    text, source = c.normalise("  AE  bA ".encode())
    assert text.decode() == "▁ae▁ba"
    assert source.tolist() == [2, 2, 2, 2, 2, 4, 4, 4, 6, 7, 8]


def test_tokens_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    token_orc.write_tokens(frame(spark), path, WORDS, 2)
    t = token_orc.WordTokens(WORDS).whole
    at, want = 0, []
    for d, text in sorted(HARD, key=lambda r: -1 if r[0] is None else r[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((d, ids))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids) for r in token_orc.read_tokens(spark, path).collect())
    assert sorted((str(d), i) for d, i in want) == sorted((str(r[1]), r[3]) for r in got)
    assert [r[1] for r in got] == [d for d, _ in want]
    for start, _, n, ids in got:
        assert start == at and n == len(ids)
        at += n
    sums = {(r.start, r.ids_crc32) for r in token_orc.digests(spark, path).collect()}
    assert sums == {(s, zlib.crc32(np.array(i, "<u4").tobytes())) for s, _, _, i in got}
    assert [r.doc_id for r in token_orc.read_tokens(spark, path, [8]).collect()] == [8]
    plan = token_orc.read_tokens(spark, path, [8])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,8)" in plan or "EqualTo(doc_id,8)" in plan


def test_tokens_words_equal_whole_texts():
    w = token_orc.WordTokens(WORDS)
    texts = [t or "" for _, t in HARD] + ["Ça va! 12,5% d'été×÷", "naïve—dash “quotes” 漢字 x y", "I'LL've <|startoftext|>x<|endoftext|>"]
    for t in texts:
        assert w.ids(pa.array([t]), 2)[0].tolist() == w.whole.encode(t, add_special_tokens=False).ids + [2], t[:40]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language(spark, documents):
    model = language.train(documents, PIECES)
    got = language.identify(documents, model).select("doc_id", "lang", "lang_pred", "lang_score").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.lang_score <= 1 for r in got)
    hard = {r.doc_id: r for r in language.identify(frame(spark, [x for x in HARD if x[0] != 12]), model).collect()}
    assert [hard[k].lang_pred for k in (5, 6, 7, 15)] == ["und"] * 4 and hard[1].lang_pred != "und"
    assert set(hard[1].asDict()) == {"doc_id", "text", "n", "fp", "shard", "lang_pred", "lang_score"}
    none = language.train(documents.limit(0), PIECES)
    assert {r.lang_pred for r in language.identify(frame(spark), none).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    v = language.vocabulary(PIECES)
    number = {p: i for i, p in enumerate(v.pieces)}
    p = np.random.default_rng(0).uniform(0.1, 1, (len(v.pieces), 2))

    def brute(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(word) + 1):
            i = number.get(word[:k], 1 if k == 1 else 0)
            if i:
                out = out + p[i] * brute(word[k:])
        return out

    for word in ("▁the", "▁nation", "▁xq漢"):
        got = language._forward(v, np.array([[ord(c) for c in word]], np.uint32), p)
        assert np.allclose(got + len(word) * np.log(language._SCALE), np.log(brute(word)))


def test_quality(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(documents, labels)
    got = quality.score(documents, model).join(labels, "doc_id").select("doc_id", "quality", "quality_score").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.quality_score >= 0.5) == r.quality for r in held) >= 0.9 * len(held)
    assert all(0 <= r.quality_score <= 1 for r in quality.score(frame(spark), model).collect())
    assert {r.quality_score for r in quality.score(frame(spark), quality.train(documents, labels.limit(0))).collect()} == {0.5}


def test_quality_gradients():
    texts = ["some words here " * 40, "BAD!! BAD!! " * 80, "x"]
    raw = [t.encode() for t in texts]
    x, begin = quality.passages(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw]))))
    assert begin.tolist() == [0, 2, 5, 6]
    r = np.random.default_rng(0)
    h = quality.HIDDEN
    m = quality.Model(x.mean(0), x.std(0) + 1, [r.normal(0, 0.5, s) for s in ((quality.FEATURES, h), (h,), (h, h), (h, h), (h,), (h,), ())])
    y, w = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    loss = lambda: -(w * (y * np.log(m.forward(x, begin)["p"]) + (1 - y) * np.log(1 - m.forward(x, begin)["p"]))).sum() / w.sum()
    for i, g in enumerate(m.gradients(m.forward(x, begin), begin, y, w)):
        at = (0,) * m.w[i].ndim
        keep = m.w[i]
        m.w[i] = keep.copy()
        m.w[i][at] += 1e-5
        high = loss()
        m.w[i] = keep.copy()
        m.w[i][at] -= 1e-5
        low = loss()
        m.w[i] = keep
        assert abs((high - low) / 2e-5 - np.asarray(g)[at]) < 1e-6


def plain_rules(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_pii_rules_and_network(spark, documents):
    r = np.random.default_rng(4)
    for _ in range(4000):
        t = "".join(r.choice(list("a1.@+-( )5 %é"), int(r.integers(0, 50))))
        assert pii.rule_spans(t) == plain_rules(t), t
    rows = [x.text for x in documents.select("text").collect()]
    assert [pii.rule_spans(t) for t in rows] == [plain_rules(t) for t in rows]
    net = pii.train(documents)
    made = [(1, "mail a.b@mail3.example.com or +1 (803) 555-5351, 10.20.30.40 end"), (2, None), (3, ""), (4, "x" * 50_000 + " a@b.cc"), (4, "no data")]
    got = pii.find(frame(spark, made), net).collect()
    assert collections.Counter((r.doc_id, tuple(map(tuple, r.base_spans))) for r in got) == collections.Counter((d, tuple(plain_rules(t or ""))) for d, t in made)
    assert all(set(map(tuple, r.base_spans)) <= set(map(tuple, r.pii_spans)) for r in got)
    row = next(r for r in pii.digests(pii.find(frame(spark, made), net)).collect() if r.doc_id == 1)
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_rules(made[0][1]))
    assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 0, 1)
    text = next(r.text for r in pii.masked(frame(spark, made), net).collect() if r.doc_id == 1)
    assert text == "mail [EMAIL] or [PHONE], [IP] end"
    assert pii.train(documents.limit(0)) is None
    assert pii.find(frame(spark, made), None).count() == len(made)


def test_pii_gradients():
    net = pii.Tagger({k: v.astype(np.float64) for k, v in pii.Tagger.fresh().w.items()})
    codes = np.array([[65, 49, 64, 50, 32], [49, 49, 32, 66, 46]], np.uint8)
    tags = np.array([[0, 1, 2, 2, 0], [7, 8, 0, 0, 0]])

    def loss():
        e = net.emissions(codes)[0].astype(np.float64)
        z = net.marginals(e)[2]
        own = sum(e[s, [0, 1], tags[:, s]] + (net.w["t"][tags[:, s - 1], tags[:, s]] if s else 0) for s in range(5))
        return float((z - own).mean())

    grads = net.gradients(codes, tags)
    for name, at in (("o", (3, 2)), ("c", (1,)), ("t", (1, 2)), ("xf", (49, 5)), ("hf", (2, 30)), ("xb", (64, 40)), ("hb", (1, 7))):
        keep = net.w[name][at]
        net.w[name][at] = keep + 1e-4
        high = loss()
        net.w[name][at] = keep - 1e-4
        low = loss()
        net.w[name][at] = keep
        assert abs((high - low) / 2e-4 - grads[name][at]) < 2e-3, name


def test_reconcile():
    assert pii.reconcile([("ip", 5, 9)], [("phone", 8, 20, 0.99), ("card", 20, 30, 0.5), ("phone", 25, 40, 0.9), ("email", 41, 45, 0.6)]) == [("ip", 5, 9), ("phone", 25, 40), ("email", 41, 45)]


def test_html(spark):
    nav = "<nav><a href='/x'>Menu one two</a></nav>"
    body = " ".join(f"unique{i}" for i in range(12))
    note = "<div><p>this notice stands on every page of this host today again</p></div>"
    rows = [
        (1, "http://h/1", f"<html><head><title>t</title><style>p{{}}</style></head><body>{nav}<article><h1>Head &amp; more</h1><p><b>a <i>b</i>c<br>d<p>two\n three</p><script>var t='</p>';</script><section class='comments'><p>no</p></section></article><footer>f</footer>"),
        (2, "http://h/2", f"<body>{nav}{note}<p>{body}</p></body>"), (3, "http://h/3", f"<body>{nav}{note}<p>other {body[::-1]}</p></body>"),
        (4, None, None), (5, "http://h/5", ""), (6, "x", "just &lt;text&gt; 1 < 2"), (7, "http://H/7", "<main><p>m</p><form><input><p>no</p></form></main><p>out</p>"), (7, "http://g/7", "<p>a</p><aside>b<div>c</div></aside><p>d</p>"),
        (8, "http://k/8", "<div class='page has-sidebar'><div class='sidebar'>s</div><article><header class='article-header'><h1>T</h1></header><p>x</p><article class='comment'>c</article><p>y</p></article></div>"),
    ]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, salt int")
    got = collections.Counter((r.page_id, r.url, r.text) for r in html_text.extract(df).collect())
    want = ["Head & more\na bc d\ntwo three", body, f"other {body[::-1]}", "", "", "just <text> 1 < 2", "m", "a\nd", "T\nx\ny"]
    assert got == collections.Counter((p, u, t) for (p, u, _), t in zip(rows, want))
    assert all(r.n_chars == len(r.text) for r in html_text.extract(df).collect())
    assert html_text.extract(df.limit(0)).count() == 0


def test_covered_against_brute_force():
    r = np.random.default_rng(5)
    pages = [r.integers(0, 3, int(r.integers(0, 60))).astype(np.uint64) for _ in range(8)]
    k = html_text.LONG
    for own, flags in zip(pages, html_text.covered(pages)):
        want = np.zeros(len(own), bool)
        for i in range(len(own) - k + 1):
            if any(np.array_equal(own[i : i + k], p[j : j + k]) for p in pages if p is not own for j in range(len(p) - k + 1)):
                want[i : i + k] = True
        assert np.array_equal(flags, want)


def test_scratch_is_shared(spark):
    s = Scratch(spark)
    df = s.save(spark.range(3), "x")
    assert df.count() == 3
    s.drop(df)
