"""Results are whole, and the same whatever the input's size or the blocks it is dealt to."""

import collections
import os
import pathlib
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import html_text, ngram_join, registry
from gridloom.llm.common import Scratch
from gridloom.sources.shared import shared_root


def test_copies_of_an_unmarked_page_keep_their_text(spark):
    text = " ".join(f"u{i}" for i in range(20))
    rows = [(1, "http://h/1", f"<p>{text}</p>"), (1, "http://h/1", f"<p>{text}</p>"), (2, "http://h/2", f"<div><p>{text}</p></div>"), (3, "http://h/3", "<p>another text</p>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text, r.n_repeated) for r in got) == [(1, text, 0), (1, text, 0), (2, text, 0), (3, "another text", 0)]


def test_hosts_of_marked_pages_alone_are_searched_for_repeated_runs(spark):
    shared = " ".join(f"s{i}" for i in range(9))
    rows = [(i, f"http://h/{i}", f"<article><p>{shared}</p><p>own{i}</p></article>") for i in range(2)] + [(2, "http://g/2", f"<article><p>{shared}</p></article>"), (3, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text, r.n_repeated) for r in got) == [(0, f"{shared}\nown0", 9), (1, f"{shared}\nown1", 9), (2, shared, 0), (3, "", 0)]


def test_a_host_in_blocks_gives_what_a_host_in_one_gives(spark, monkeypatch):
    """Runs shared by pages of different blocks, copies, pages with an article and without, a second host."""
    r = np.random.default_rng(3)
    shared = [" ".join(f"s{k}w{i}" for i in range(8 + k)) for k in range(12)]
    rows = []
    for i in range(60):
        own = [" ".join(f"p{i}q{j}n{k}" for k in range(int(r.integers(1, 15)))) for j in range(3)]
        own += [shared[k] for k in r.integers(0, 12, 2)]
        html = "".join(f"<p>{x}</p>" for x in own)
        rows.append((i, f"http://h{i % 7 == 0}/{i}", f"<article>{html}</article>" if i % 3 == 0 else html))
    rows += [(100 + i, f"http://hFalse/c{i}", rows[1][2]) for i in range(5)] + [(200, None, None), (201, "http://hFalse/e", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(repr, html_text.extract(df).collect()))
    monkeypatch.setattr(html_text, "BLOCK_BYTES", 900)
    monkeypatch.setattr(html_text, "BUCKET_BYTES", 2000, raising=False)
    assert sorted(map(repr, html_text.extract(df).collect())) == want
    assert sum("n_repeated=0" not in x for x in want) > 10


def test_a_stream_whose_copies_are_longer_than_a_block_is_spread(spark, monkeypatch):
    """Copies in many blocks still count as one page, and all of them learn what another page shares with them."""
    words = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    rows = [(i, f"http://h/{i}", f"<article><p>{words('c', 40)}</p></article>") for i in range(40)] + [(40 + i, f"http://h/u{i}", f"<p>{words('d', 30)}</p>") for i in range(40)]
    rows += [(100, "http://h/a", f"<article><p>x {words('c', 9)} y</p></article>"), (101, "http://h/b", f"<p>x {words('d', 9)} y</p>"), *((200 + i, f"http://h/o{i}", f"<p>{words(f'o{i}', 30)}</p>") for i in range(10))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = sorted(map(repr, html_text.extract(df).collect()))
    assert sum("n_repeated=9" in x for x in want) == 41 and "Row(page_id=101, url='http://h/b', text='x y', n_chars=3, n_repeated=0)" in want
    monkeypatch.setattr(html_text, "BLOCK_BYTES", 900)
    monkeypatch.setattr(html_text, "BUCKET_BYTES", 2000)
    assert sorted(map(repr, html_text.extract(df).collect())) == want


def test_pages_leave_less_on_disk_than_half_as_much_again_as_they_take(spark, monkeypatch):
    """Bytes shuffled and written to scratch tables; hosts of one block and of many."""
    monkeypatch.setattr(html_text, "BLOCK_BYTES", 1 << 17)
    path, scratch = "/root/testdata/sf0.1/pages.parquet", pathlib.Path(urlparse(shared_root(spark)).path)
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() + sum(f.stat().st_size for f in scratch.rglob("*.parquet") if f.is_file())
    before = moved()
    assert html_text.extract(spark.read.parquet(path)).selectExpr("sum(n_chars)").first()[0] > 0
    assert 0 < moved() - before < 1.5 * os.path.getsize(path)


def test_reshard_returns_shards_that_stay(spark, tmp_path):
    """Equal sizes: old shard 0 holds just its new capacity, so it is not written again."""
    by = collections.defaultdict(list)
    for r in spark.range(200).select("id", F.pmod(F.xxhash64("id"), F.lit(registry.OLD_SHARDS)).alias("s")).collect():
        by[r.s].append(r.id)
    ids = [by[0][0], *by[1][:3], *by[2][:2], *by[3][:2]]
    spark.createDataFrame([(i, None) for i in ids], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op6_reshard(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(ids) and sorted(r.shard for r in got) == list(range(8))


def test_rows_at_the_edge_of_a_part_stay(monkeypatch):
    """A column of more rows than LONGEST; rows of size 200 on both sides of the edge between its parts."""
    monkeypatch.setattr(ngram_join, "LONGEST", 20_000)
    part = lambda n, fp: ngram_join._batch(ngram_join._ROWS, np.ones(len(n), np.int64), n, fp, np.zeros(len(n), np.int32))
    first = part(np.append(np.full(19_999, 100, np.int32), np.int32(200)), np.arange(20_000))
    got = [b.column(2).to_pylist() for b in ngram_join._shared(iter([first, part(np.array([200], np.int32), np.array([20_000]))]))]
    assert {19_999, 20_000} <= {x for b in got for x in b}


def test_rows_of_a_repeated_id_are_kept_by_their_text(spark):
    """Id 12: a text of its own, a near copy of document 1's and its own text again; id 13: two texts that do not link; id 14: two empty ones."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (12, f"{a} tail"), (12, b), (12, b), (13, c), (13, d), (14, ""), (14, ""), (15, c), (None, a)]
    for order in (rows, rows[::-1]):
        kept = ngram_join.ngram_jaccard_keep(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, a), (1, a), (12, b), (13, c), (13, d), (14, "")]


def test_pairs_of_a_group_of_near_copies_do_not_grow_with_its_square(spark, monkeypatch):
    """One copy in ten has one word changed, the others three each: these link with the tenth, hardly with each other."""
    made, save = [], Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name == "tried":
            made[-1] += out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    r = np.random.default_rng(4)
    rows = []
    for i in range(800):
        words = [f"w{k}" for k in range(150)]
        for at in r.choice(150, 1 if i % 10 == 0 else 3, replace=False):
            words[at] = f"c{i}a{at}"
        rows.append((i, " ".join(words)))
    for many in (400, 800):
        made.append(0)
        got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows[:many], "doc_id long, text string")).collect()
        assert [(x.doc_id, x.component_id) for x in sorted(got)] == [(i, 0) for i in range(many)]
    assert made[1] < 2.6 * made[0], made
