"""Hard rows, repeated rows, long texts and the registered queries on whole small tables."""

import collections
import re
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from gridloom.llm import html_text, language, ngram_join, pii, pii_forms, piece_codec, quality, registry, sampling
from gridloom.llm.common import Scratch

from test_texts import HARD, PIECES, brute_components, frame, plain_rules

SF = "/root/testdata/sf0.001"


def saved(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


@pytest.mark.parametrize("n", [0, 1, 8, 24, 40, 100])
def test_reshard_query_returns_every_empty_text(spark, tmp_path, n):
    got = registry.op6_reshard(spark, saved(spark, tmp_path, documents=([(i, None) for i in range(n)], "doc_id long, text string"))).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    by = collections.Counter(r.shard for r in got)
    assert n < 8 or max(by.values()) - min(by.get(s, 0) for s in range(8)) <= 1


def test_reshard_query_parts_equal_rows(spark, tmp_path):
    rows = [(7, "x" * 28)] * 800 + [(1000 + i, "y" * (i % 30)) for i in range(200)]
    got = registry.op6_reshard(spark, saved(spark, tmp_path, documents=(rows, "doc_id long, text string"))).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in rows)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(size.values()) - min(size.values()) <= 30 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_token_query_with_a_hot_id(spark, tmp_path):
    rows = [(5, f"text {i}") for i in range(300)] + [(i, None) for i in range(5)] + [(9, "same"), (9, "same")]
    got = sorted(registry.op7_token_orc(spark, saved(spark, tmp_path, documents=(rows, "doc_id long, text string"))).collect(), key=lambda r: r.start)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)


def test_joined_sets_whose_first_prints_clash(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_print", lambda s: (len(s) % 3, int(s.view(np.int64).sum())))
    rows = [(d, t) for d, t in HARD if d != 10 and d != 11] + [(100 + i, " ".join(f"c{i}q{k}" for k in range(9))) for i in range(30)]
    texts = [(t or "").encode() for d, t in rows if d is not None]
    sets = [ngram_join.shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    shared = collections.defaultdict(set)
    for s in sets:
        if len(s):
            shared[ngram_join._print(s)[0]].add(s.tobytes())
    clashes = frozenset(k for k, own in shared.items() if len(own) > 1)
    assert clashes
    names = {}
    for s in sets:
        if len(s):
            assert names.setdefault(ngram_join._name(ngram_join._print(s), clashes), s.tobytes()) == s.tobytes()
    printed = spark.createDataFrame([(i, *map(int, ngram_join._print(s)), len(s)) for i, s in enumerate(sets)], "doc_id long, fp long, fp2 long, n long")
    named, own, found = ngram_join._classes(printed, Scratch(spark))
    assert found == clashes and own.count() == len(names)
    assert {r.fp for r in named.where("n > 0").collect()} == set(names)


def test_sample_is_bounded_whole_and_fair(spark):
    rows = [(6, f"hot {i}", "a") for i in range(3000)] + [(k, f"t{k}", "b") for k in range(50)] + [(1, "same", "c")] * 2000 + [(2, None, "c"), (None, "n", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sampling.draw(df, 300, "lang")
    by = collections.Counter(r._label for r in got)
    assert by["b"] == 51 and by["c"] == 1 and 60 <= by["a"] <= 200 and len(got) <= 300
    assert [tuple(r) for r in got] == [tuple(r) for r in sampling.draw(df.repartition(5), 300, "lang")]
    assert sum(len(r.text) for r in sampling.draw(df, 10_000, "lang", 3000)) <= 3000
    assert len(sampling.draw(df, 10_000)) == len(rows) - 1 and sampling.draw(df.limit(0), 10) == []


def test_a_hot_id_teaches_its_language(spark):
    rows = [(6, f"the nation of {w} {i}", "en") for i, w in enumerate(["house", "water", "people"] * 300)] + [(8, f"une maison avec {i} fleurs", "fr") for i in range(20)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES)
    want = {x for d, x in ((6, "en"), (8, "fr")) if zlib.crc32(str(d).encode()) % 4 != 2}
    assert want and set(model.langs) == want


def test_words_of_any_length():
    v = language.vocabulary(PIECES)
    r = np.random.default_rng(0)
    p = r.uniform(0.01, 0.3, (len(v.pieces), 3))
    p[0] = 0
    for word in ("▁internationalization" * 9, "▁" + "漢字" * 100, "▁a"):
        codes, counts = np.array([[ord(c) for c in word]], np.uint32), np.array([[1.0, 2.0, 0.0]])
        a, b = np.zeros_like(p), np.zeros_like(p)
        assert np.allclose(language._forward(v, codes, p, counts, a), language._single(v, codes, p, counts, b), atol=1e-9)
        assert np.allclose(a[:, :2], b[:, :2])
    model = language.Model(PIECES, ["x", "y"], p[:, :2], np.zeros(2))
    took = []
    for n in (50_000, 200_000):
        began = time.perf_counter()
        lang, score = model.score(["".join(r.choice(list("etaoins"), n)), "123"])
        took.append(time.perf_counter() - began)
        assert lang[0] in "xy" and lang[1] == "und" and 0.5 <= score[0] <= 1
    assert took[1] < 8 * took[0] + 1 and took[1] < 20


def test_scores_are_those_of_brute_force():
    """Whole scores of texts: sums over all segmentations of all words, times the languages' shares."""
    v = language.vocabulary(PIECES)
    model = language.fit(["the nation and the people", "un homme et une femme", "the end"], ["en", "fr", "en"], PIECES)

    def word(w, k):
        best = [1.0] + [0.0] * len(w)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                n = v.number.get(w[i:j], 1 if j == i + 1 else 0)
                if n:
                    best[j] += best[i] * model.p[n, k] / language._SCALE ** (j - i)
        return best[-1]

    for text in ("The people, a Femme!", "nation42 ÉTÉ", "x"):
        logs = np.array([sum(np.log(word("▁" + w.lower(), k)) for w in re.findall(r"[^\W\d_]+", text)) + model.prior[k] for k in range(2)])
        share = np.exp(logs - logs.max())
        lang, score = model.score([text])
        assert lang[0] == model.langs[int(logs.argmax())] and np.isclose(score[0], share.max() / share.sum())


def test_long_texts(spark):
    long = "word1 next2 . " * 60_000 + "a.b@mail.example.com"
    rows = [(1, long), (2, None), (3, "")]
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    net = pii.fit(texts[:60])
    got = {r.doc_id: r for r in pii.find(frame(spark, rows), net).collect()}
    assert [tuple(s) for s in got[1].base_spans] == plain_rules(long) and got[2].pii_spans == [] == got[3].pii_spans
    model = quality.fit(texts[:40], [k % 2 for k in range(40)])
    assert {r.doc_id for r in quality.score(frame(spark, rows), model).collect()} == {1, 2, 3}
    page = "<article>" + "<p>one two</p>" * 50_000 + "</article>"
    got = html_text.extract(spark.createDataFrame([(1, "http://h/1", page)], "page_id long, url string, html string")).first()
    assert got.text == "\n".join(["one two"] * 50_000)


@pytest.fixture(scope="module")
def tagger():
    rows = [x for x in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist() if x and re.search("[0-9@]", x)]
    return rows, pii.fit(rows[: len(rows) // 2])


def test_tagger_finds_forms_it_was_never_taught(tagger):
    rows, net = tagger
    rows = rows[len(rows) // 2 :]
    r = np.random.default_rng(9)
    hit = {}
    for kind, forms in pii_forms.HELD.items():
        made = pii_forms.planted(rows, {kind: forms}, 200, r, 300)
        hit[kind] = sum(any(a < s[0][2] and s[0][1] < b for _, a, b in found) for (_, s), (_, found) in zip(made, pii.spans_of([t for t, _ in made], net))) / 200
    assert hit["secret"] >= 0.6 and hit["email"] >= 0.5 and np.mean(list(hit.values())) >= 0.45, hit
    taught = pii_forms.planted(rows, pii_forms.TAUGHT, 300, r, 300)
    assert sum(s[0] in found for (_, s), (_, found) in zip(taught, pii.spans_of([t for t, _ in taught], net))) >= 0.55 * 300
    plain = pii_forms.planted(["no number stands in this text at all but the one that is planted here " * 9], {"": pii_forms.PLAIN}, 400, r, 300)
    assert sum(len(found) for _, found in pii.spans_of([t for t, _ in plain], net)) <= 0.1 * 400


def test_tagger_adds_secrets_to_documents(tagger):
    """Of documents it was not taught on: what it adds are the tokens that stand there, and it finds many of them."""
    rows, net = tagger
    rows = rows[len(rows) // 2 :]
    added = truth = right = 0
    for text, (base, every) in zip(rows, pii.spans_of(rows, net)):
        own = {m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', text, re.I)}
        truth += len(own)
        for kind, a, b in set(every) - set(base):
            added, right = added + 1, right + ((a, b) in own and kind == "secret")
        assert set(base) <= set(every)
    assert truth and right >= 0.4 * truth and right >= 0.9 * added, (truth, added, right)


def test_turned_down_matches_are_not_added(tagger):
    _, net = tagger
    for text in ("card 4111 1111 1111 1112 here", "at 300.1.2.3 now", "call +1 23 4 or"):
        base, every = pii.spans_of([text], net)[0]
        assert base == [] and not [s for s in every if s[0] != "secret"], (text, every)


def test_windows_overlap_and_are_reconciled_globally():
    """A span anywhere in a text lies whole in one of its windows."""
    for at in range(0, 200, 7):
        text = "x" * at + " 0123456789 " + "y" * 200
        codes = pii.codes_of(text)
        starts = pii.window_starts(codes)
        assert any(s <= at and at + 12 <= s + pii.WINDOW for s in starts.tolist())


def test_normaliser_equals_the_library(tmp_path):
    """The model with the library's own compiled character maps."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    texts = ["ﬁne ＡＢＣ １２ é  ½  ", "  lead\tand\ntrail  ", "Ⅳ ㎏ ｶﾞ ﷺ", "plain text", "", "a b​c ­ x", "한국어 ÅÅ"]
    for rule in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf"):
        try:
            own = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        except Exception:
            pytest.skip("this build has no compiled maps")
        spec = pb.ModelProto()
        spec.ParseFromString(own.serialized_model_proto())
        proto.normalizer_spec.CopyFrom(spec.normalizer_spec)
        proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = True, True, True
        path = str(tmp_path / rule)
        with open(path, "wb") as f:
            f.write(proto.SerializeToString())
        c = piece_codec.Codec(path)
        assert c.map
        for text, (ids, a, b) in zip(texts, c.encode(texts)):
            assert ids.tolist() == c.library.encode(text, add_bos=True, add_eos=True), (rule, text)
            assert (a <= b).all() and (b <= len(text.encode())).all()


def brute_text(pages, k):
    """What an unmarked page keeps: words of its lines in no run of k words that another different page of the host has."""
    streams = [[w for line in p for w in line.split()] for p in pages]
    out = []
    for p, own in zip(pages, streams):
        gone = [False] * len(own)
        for i in range(len(own) - k + 1):
            if any(own[i : i + k] == q[j : j + k] for q in streams if q != own for j in range(len(q) - k + 1)):
                gone[i : i + k] = [True] * k
        at, kept = 0, []
        for line in p:
            words = line.split()
            left = [w for w, g in zip(words, gone[at : at + len(words)]) if not g]
            at += len(words)
            if left:
                kept.append(" ".join(left))
        out.append("\n".join(kept))
    return out


def test_extraction_against_brute_force(spark):
    r = np.random.default_rng(8)
    notes = [[f"n{k}w{i}" for i in range(9 + k)] for k in range(3)]
    pages = []
    for i in range(14):
        lines = [[f"p{i}l{j}w{k}" for k in range(int(r.integers(1, 12)))] for j in range(3)]
        lines.insert(int(r.integers(0, 3)), notes[int(r.integers(0, 3))])
        pages.append([" ".join(x) for x in lines])
    pages.append(pages[0])
    rows = [(i, f"http://h/{i}", "<nav>menu</nav>" + "".join(f"<p>{x}</p>" for x in p)) for i, p in enumerate(pages)]
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(pages))] == brute_text(pages, html_text.LONG)


def test_pages_in_forms_and_buttons_in_lines(spark):
    rows = [
        (1, "http://h/1", "<form id='aspnet'><div><article><p>whole page</p></article></div></form>"),
        (2, "http://h/2", "<article><p>before <button>press</button> after</p><form><p>no</p></form></article>"),
    ]
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "whole page", 2: "before after"}


EMPTY = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int",
    "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int",
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_queries_on_empty_and_hard_tables(spark, tmp_path, name):
    empty = saved(spark, tmp_path / "e", **{k: ([], v) for k, v in EMPTY.items()})
    assert registry.QUERIES[name](spark, empty).collect() == []
    docs = [(d, t, None if d == 3 else "en", None, None) for d, t in HARD if d != 10 and d != 11]
    rows = {
        "documents": docs, "pages": [(1, None, None), (None, "http://h/1", "<p>x"), (1, None, None)], "embeddings": [(100, [1.0, 0.0], 1), (1, [1.0, 0.1], None), (None, [1.0, 1.0], 1), (2, None, 1), (1, [1.0, 0.1], 1)],
        "benchmark": [(None, None), (1, "one two")], "labels": [(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (14, 0, 0)],
    }
    hard = saved(spark, tmp_path / "h", **{k: (rows[k], v) for k, v in EMPTY.items()})
    got = registry.QUERIES[name](spark, hard).collect()
    if name in ("op3_html_text",):
        assert len(got) == 3
    elif name == "op4_nearest":
        assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(100, 1, 1), (100, 2, 1)]
    elif name == "op5_decontamination":
        assert {(r.doc_id, r.item_id) for r in got} == {(8, 1), (9, 1)} - ({(9, 1)} if not any(r.doc_id == 9 for r in got) else set())
    else:
        assert len(got) == len(docs)


def test_registered_join_is_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert collections.Counter(map(tuple, registry.op1_ngram_jaccard(spark, SF).collect())) == brute_components(rows)


def test_registered_languages_and_quality_are_those_of_their_models(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs, PIECES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in registry.op10_language(spark, SF).collect():
        lang, score = model.score([texts[r.doc_id] or ""])
        assert (lang[0], r.held_out) == (r.lang_pred, zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and abs(score[0] - r.score) < 1e-9
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for r in registry.op9_quality(spark, SF).collect():
        raw = (texts[r.doc_id] or "").encode()
        score = model.score(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert abs(score - r.score) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_registered_join_is_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(registry.ORACLE_SQL["op1_ngram_jaccard"]).fetchall()) == sorted(map(tuple, registry.op1_ngram_jaccard(spark, SF).collect()))
