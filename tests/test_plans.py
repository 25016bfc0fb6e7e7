"""Index arithmetic, splits and orders: properties, and brute force."""

import collections
import hashlib
import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators import ordering
from gridloom.plans import geometry
from gridloom.plans.geometry import Geometry, Grid, chunks_read, valid_anchors
from gridloom.plans.ranks import before, ranked, ranked_by_hash
from gridloom.plans.split import SPLITS, Manifest, split_by_chunk


@given(st.integers(1, 400), st.integers(1, 40))
def test_chunks_cover_samples_once(n, spc):
    g = Geometry("x", (n, 5), (spc, 2))
    assert [i for c in range(g.n_chunks) for i in g.samples(c)] == list(range(n))
    assert all(i in g.samples(i // spc) for i in range(n))


@given(st.lists(st.integers(1, 9), min_size=2, max_size=3), st.data())
def test_tiles_cover_an_array_once(shape, data):
    chunks = [data.draw(st.integers(1, s + 1)) for s in shape]
    axis = data.draw(st.integers(0, len(shape) - 1))
    g = Geometry("x", tuple(shape), tuple(chunks), "<i8", sample_axis=axis)
    whole = np.arange(np.prod(shape)).reshape(shape)
    found = []
    for c in range(g.n_chunks):
        out = np.full((len(g.samples(c)), *g.field), -1)
        for cell in g.tiles(c):
            found.append(cell)
            part = whole[tuple(slice(r.start, r.stop) for r in g.grid.box(cell))]
            tile = np.full(chunks, -2)
            tile[tuple(map(slice, part.shape))] = part
            g.scatter(cell, tile, out)
        assert np.array_equal(out, np.moveaxis(whole, axis, 0)[g.samples(c).start : g.samples(c).stop])
    assert sorted(found) == list(np.ndindex(*g.grid.counts))


def test_frames_say_what_geometries_say(spark):
    found = {"a": Geometry("p", (11, 9, 7), (4, 4, 4), sample_axis=1, offset=2), "b": Geometry("q", (9,), (2,), "<f8")}
    rows = {r.label: r for r in geometry.measured(geometry.frame(spark, found)).collect()}
    for k, g in found.items():
        assert (rows[k].n_samples, rows[k].spc, rows[k].n_chunks, tuple(rows[k].inner_shape)) == (g.n_samples, g.sample_chunk_size, g.n_chunks, g.field)
    tiles = {(r.label, r.chunk_index, tuple(r.cell)): (r.key, tuple(r.box)) for r in geometry.tile_rows(geometry.frame(spark, found)).collect()}
    want = {(k, c, cell): ("c/" + "/".join(map(str, cell)), tuple(map(len, g.grid.box(cell)))) for k, g in found.items() for c in range(g.n_chunks) for cell in g.tiles(c)}
    assert tiles == want


@given(st.integers(1, 60), st.lists(st.integers(-30, 30), max_size=4))
def test_valid_anchors(n, offsets):
    lo, hi = valid_anchors(n, offsets)
    assert list(range(lo, hi)) == [t for t in range(n) if all(0 <= t + o < n for o in offsets)]


@given(st.integers(1, 60), st.integers(1, 9), st.integers(1, 9), st.integers(-20, 20), st.integers(0, 9))
def test_chunks_read(n, ref, spc, offset, chunk):
    want = {(t + offset) // spc for t in range(chunk * ref, min((chunk + 1) * ref, n)) if 0 <= t + offset < n}
    assert set(chunks_read(Grid((n,), (ref,)).piece(0, chunk), offset, Grid((n,), (spc,)))) == want


def test_geometry_checks(spark):
    for bad in (((3,), (1,), 1), ((3, 2), (1,), 0)):
        with pytest.raises(ValueError):
            Geometry("x", bad[0], bad[1], sample_axis=bad[2])
    g = Geometry("x", (20, 4), (4, 4)).shift(3).shift(-1)
    assert g.offset == 2 and g.chunk_bytes == 64
    need = lambda found, *how: geometry.residency(geometry.frame(spark, dict(enumerate_labels(found))), *how).first().bytes
    assert need([Geometry("x", (1000, 4), (10, 4))], 4, 80, 10, True) == 2 * 4 * 160
    x = Geometry("x", (1000, 4), (10, 4))
    assert need([x, x.shift(15)], 4, 80, 10, False) == 2 * 4 * (2 + 2) * 320 and need([x, x.shift(1)], 4, 80, 10, True) == 80 * 320
    assert need([Geometry("a", (100,), (1,)), Geometry("b", (100,), (8,))], 2, 50, 1, False) == (5 + (1 + 1) * 8) * 4


def enumerate_labels(found):
    return ((f"l{k}", g) for k, g in enumerate(found))


def test_ranks_in_parts(spark, monkeypatch):
    from gridloom.plans import ranks

    monkeypatch.setattr(ranks, "WIDE", 7)
    ids = sorted(np.random.default_rng(0).choice(200, 60, replace=False).tolist())
    df = spark.createDataFrame([(i, i % 5) for i in ids], "id long, v long")
    assert [(r.id, r.k) for r in ranked(df, "id", "k").orderBy("id").collect()] == [(i, k) for k, i in enumerate(ids)]
    sums = [(r.id, r.s) for r in before(df, "id", F.col("v"), "s").orderBy("id").collect()]
    assert sums == [(i, sum(j % 5 for j in ids if j < i)) for i in ids]
    order = [r.id for r in ranked_by_hash(df, "id", F.md5(F.col("id").cast("string")), "k").orderBy("k").collect()]
    assert order == sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))


@given(st.integers(1, 500), st.integers(1, 20), st.sampled_from([(0.8, 0.1, 0.1), (0.5, 0.5, 0.0), (1.0, 0.0, 0.0), (1 / 3, 1 / 3, 1 / 3)]))
def test_split_counts(n, spc, fractions):
    m = split_by_chunk(n, spc, fractions)
    assert sum(m.counts) == m.n_chunks and min(m.counts) >= 0 and m.counts[0] == round(fractions[0] * m.n_chunks)


def test_split_errors_and_json(tmp_path):
    for bad in ({"fractions": (0.5, 0.2, 0.2)}, {"sample_range": (5, 5)}, {"sample_range": (0, 2000)}):
        with pytest.raises(ValueError):
            split_by_chunk(1000, 10, **bad)
    m = split_by_chunk(1000, 10, sample_range=(95, 505), contiguous=False, seed=4)
    assert (m.first, sum(m.counts)) == (9, 42)
    m.to_json(str(tmp_path / "m.json"))
    again = Manifest.from_json(str(tmp_path / "m.json"))
    assert again.listed() == m.listed() and (again.n_chunks, again.counts, again.seed) == (100, m.counts, 4)
    body = json.loads((tmp_path / "m.json").read_text())
    assert set(body) == {"n_chunks", "sample_chunk_size", "n_samples", "chunks", "seed"} and set(body["chunks"]) == set(SPLITS)
    body["chunks"]["val"] = body["chunks"]["train"][:1]
    (tmp_path / "bad.json").write_text(json.dumps(body))
    with pytest.raises(ValueError):
        Manifest.from_json(str(tmp_path / "bad.json"))
    assert split_by_chunk(50, 10, (0.5, 0.5, 0.0)).counts == (2, 2, 1)


def test_lists_and_rules_agree(spark, tmp_path):
    for contiguous in (True, False):
        m = split_by_chunk(1003, 10, contiguous=contiguous, seed=2)
        m.to_json(str(tmp_path / "m.json"))
        listed = Manifest.from_json(str(tmp_path / "m.json"))
        rows = [sorted(map(tuple, x.chunks(spark).collect())) for x in (m, listed)]
        assert rows[0] == rows[1] == sorted((s, c) for s, own in m.listed().items() for c in own)
        assert listed.sample_indices(spark, "val").count() == m.sample_indices(spark, "val").count()


def test_split_disjoint_and_whole(spark):
    for m in (split_by_chunk(1003, 10), split_by_chunk(1003, 10, contiguous=False, seed=1)):
        rows = m.sample_indices(spark).collect()
        assert sorted(r.sample_index for r in rows) == list(range(1003))
        by = collections.defaultdict(set)
        for r in rows:
            by[r.chunk_id].add(r.split)
        assert all(len(s) == 1 for s in by.values())
    with pytest.raises(ValueError):
        m.chunks(spark, "dev")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 90), st.integers(1, 12), st.integers(1, 5), st.integers(0, 3))
def test_orders_cover_once(spark, n, spc, block, epoch):
    chunks = split_by_chunk(n, spc).chunks(spark)
    seq = ordering.sequential_order(chunks, spc, n, block_chunks=block).orderBy("draw_pos").collect()
    assert [r.anchor for r in seq] == list(range(n)) == [r.draw_pos for r in seq]
    mixed = ordering.block_shuffled_order(chunks, spc, n, block_chunks=block, seed=3, epoch=epoch).orderBy("draw_pos").collect()
    assert sorted(r.anchor for r in mixed) == list(range(n)) and [r.draw_pos for r in mixed] == list(range(n))
    in_block = collections.defaultdict(set)
    for r in mixed:
        in_block[r.block_id].add(r.chunk_id)
        assert r.anchor == r.chunk_id * spc + r.within
    assert all(len(s) <= block for s in in_block.values()) and sum(map(len, in_block.values())) == -(-n // spc)


def test_epochs_differ_and_quality(spark):
    chunks = split_by_chunk(400, 10).chunks(spark)
    order = lambda **k: ordering.block_shuffled_order(chunks, 10, 400, **k)
    rows = lambda df: [r.anchor for r in df.orderBy("draw_pos").collect()]
    assert rows(order(epoch=1)) == rows(order(epoch=1).repartition(7)) != rows(order(epoch=2))
    q = [ordering.shuffle_quality(order(block_chunks=b)).first().quality for b in (1, 8, 40)]
    assert q[0] < q[1] < q[2] <= 1
    assert ordering.shuffle_quality(ordering.sequential_order(split_by_chunk(1, 1).chunks(spark), 1, 1)).first().quality == 0
