"""The tile source, transforms, cache, loader, hand-off and command line against numpy."""

import importlib
import itertools
import json
import linecache
import shutil
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from gridloom import Dataset, StandardScaler, open_geometries, split_by_chunk
from gridloom.check_transform import main
from gridloom.functions import arrays, handoff, metrics, reports
from gridloom.operators import transforms
from gridloom.operators.cache import ChunkCache, StaleCache, bare, bare_name
from gridloom.operators.views import View, gather
from gridloom.plans.geometry import Geometry
from gridloom.sources import codecs, generators, references, stores, ztensor
from gridloom.streaming.windows import windowed

RAGGED = np.random.default_rng(0).normal(size=(5, 9, 7)).astype("f4")


def values(df, inner=()):
    rows = df.orderBy("sample_index").collect()
    return np.array([r.value for r in rows]).reshape(len(rows), *inner)


@pytest.mark.parametrize("version, codec, chunks", list(itertools.product((2, 3), (None, "zstd", "gzip"), ((2, 9, 7), (2, 4, 4)))))
def test_tiles_round_trip(spark, tmp_path, version, codec, chunks):
    ztensor.write_array(str(tmp_path), "x", RAGGED, chunks, version=version, codec=codec)
    got = ztensor.read_samples(spark, str(tmp_path), chunks_per_task=1)["x"]
    assert np.array_equal(values(got, (9, 7)).astype("f4"), RAGGED)


def test_fill_bad_and_axis(spark, tmp_path):
    url = str(tmp_path)
    ztensor.write_array(url, "a", RAGGED, (2, 4, 4), fill_value=-1, skip=frozenset({(1, 0, 1)}))
    want = RAGGED.copy()
    want[2:4, 0:4, 4:7] = -1
    assert np.array_equal(values(ztensor.read_samples(spark, url, ["a"])["a"], (9, 7)).astype("f4"), want)
    (tmp_path / "a" / "c" / "0" / "1" / "1").write_bytes(b"\0\1\2")
    tiles = ztensor.read_tiles(spark, url, ["a"])
    assert [tuple(r) for r in ztensor.bad_tiles(tiles).collect()] == [("a", 0, [1, 1])]
    want[0:2, 4:8, 4:7] = np.nan
    got = values(ztensor.read_samples(spark, url, ["a"], on_bad_chunk="nan")["a"], (9, 7)).astype("f4")
    assert np.array_equal(got, want, equal_nan=True)
    with pytest.raises(Exception, match="cannot be decoded"):
        ztensor.read_samples(spark, url, ["a"])["a"].count()
    with pytest.raises(ValueError):
        ztensor.assemble(tiles, open_geometries(url, ["a"])["a"], "skip")
    z = np.arange(2 * 6 * 8 * 8, dtype="f4").reshape(2, 6, 8, 8)
    ztensor.write_array(url + "/z", "raw", z, (2, 1, 4, 4))
    got = ztensor.read_samples(spark, url + "/z", sample_axis=1)["raw"]
    assert np.array_equal(values(got, (2, 8, 8)).astype("f4"), np.moveaxis(z, 1, 0))


def test_metadata_errors(tmp_path):
    ztensor.write_array(str(tmp_path), "u", np.zeros((40, 2), "f4"), (8, 2))
    ztensor.write_array(str(tmp_path), "v", np.zeros((32, 2), "f4"), (8, 2))
    with pytest.raises(ValueError, match="sample-axis length"):
        open_geometries(str(tmp_path))
    with pytest.raises(KeyError):
        open_geometries(str(tmp_path), ["w"])
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "zarr.json").write_text('{"zarr_format": 3, "node_type": "group"}')
    with pytest.raises(TypeError):
        open_geometries(str(tmp_path), ["g"])
    assert open_geometries(str(tmp_path), ["u"])["u"].sample_chunk_size == 8


def test_ready(tmp_path):
    g = Geometry("u", (40, 2), (8, 2), "<f4")
    assert not ztensor.ready(str(tmp_path), {"u": g})
    ztensor.write_array(str(tmp_path), "u", np.zeros((40, 2), "f4"), (8, 2))
    assert ztensor.ready(str(tmp_path), {"u": g}) and not ztensor.ready(str(tmp_path), {"u": Geometry("u", (40, 2), (4, 2), "<f4")})


def test_timed():
    t = handoff.Timed(iter(range(4)))
    assert list(t) == [0, 1, 2, 3] and t.first >= 0 and len(t.waits) == 3 and 0 <= t.stall <= 1


def test_filters_prune_tiles(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    ztensor.write_array(str(tmp_path), "u", np.zeros((40, 2), "f4"), (4, 2))
    r = ztensor._PruningReader({"path": str(tmp_path), "chunks_per_task": "2"}, ztensor.layouts(str(tmp_path)))
    assert len(list(r.pushFilters([EqualTo(("path",), "u"), GreaterThanOrEqual(("chunk_index",), 3), LessThan(("chunk_index",), 6)]))) == 3
    assert [p.chunks for p in r.partitions()] == [[3, 4], [5]]


def frame(spark, a):
    return spark.createDataFrame(pa.table({"sample_index": pa.array(range(len(a)), pa.int64()), "value": pa.array(a.reshape(len(a), -1).tolist(), pa.list_(pa.float32()))}))


class Halve:
    def output_inner(self, g):
        return (g.field[0] // 2, g.field[1] // 2), "<f8"

    def __call__(self, name, x, first):
        n, h, w = x.shape
        return x[:, : h // 2 * 2, : w // 2 * 2].reshape(n, h // 2, 2, w // 2, 2).mean((2, 4))


def drop_column(name, x, first):
    return x[..., :-1]


def test_chunk_transforms(spark):
    g = Geometry("x", (5, 9, 7), (2, 9, 7))
    got = transforms.apply_chunk_transforms(frame(spark, RAGGED), g, [Halve()])
    want = RAGGED[:, :8, :6].reshape(5, 4, 2, 3, 2).mean((2, 4))
    assert np.allclose(values(got, (4, 3)), want)
    with pytest.raises(Exception, match="declare output_inner"):
        transforms.apply_chunk_transforms(frame(spark, RAGGED), g, [drop_column]).count()
    assert transforms.identity([Halve()]) == transforms.identity([Halve()]) != transforms.identity([drop_column])


def test_median_filter_and_regrid(spark):
    want = np.empty_like(RAGGED)
    for i, j in np.ndindex(9, 7):
        ys, xs = np.clip([i - 1, i, i + 1], 0, 8), np.clip([j - 1, j, j + 1], 0, 6)
        want[:, i, j] = np.median(RAGGED[:, ys][:, :, xs].reshape(5, 9), axis=1)
    assert np.array_equal(transforms.median_filter("x", RAGGED, 0), want)
    g = Geometry("x", (5, 9, 7), (2, 9, 7))
    half = transforms.Regrid(np.array([0, 0, 1]), np.array([0, 1, 62]), np.array([0.5, 0.5, 2.0]), (2,))
    got = values(transforms.apply_chunk_transforms(frame(spark, RAGGED), g, [half]), (2,))
    flat = RAGGED.reshape(5, -1)
    assert np.allclose(got, np.stack(((flat[:, 0] + flat[:, 1]) / 2, 2 * flat[:, 62]), 1), atol=1e-6)


def test_generators(spark, tmp_path):
    a, b = (generators.normal_fields(spark, 200, (4, 4), seed=1, mean=3).repartition(k) for k in (2, 5))
    assert np.array_equal(values(a, (4, 4)), values(b, (4, 4))) and abs(values(a, (4, 4)).mean() - 3) < 0.1
    assert all(np.isnan(r.value).sum() <= 5 for r in generators.star_frames(spark, 4, 16).collect())
    raw, mask = values(generators.cell_planes(spark, 3, 24), (2, 24, 24)), values(generators.cell_mask(spark, 3, 24), (24, 24))
    assert raw[:, 0][mask > 0].mean() > raw[:, 0][mask == 0].mean() and 0 < mask.mean() < 1
    generators.advected(str(tmp_path), 30, 12, chunk=8)
    t = values(ztensor.read_samples(spark, str(tmp_path), ["t2m"])["t2m"], (12, 12))
    assert len(t) == 30 and abs(t.std() - 1) < 1e-3 and np.abs(t[1] - t[0]).mean() < np.abs(t[20] - t[0]).mean()
    f = RAGGED[0]
    assert np.allclose(generators.bilinear(f, np.array([1.0, 8.5]), np.array([2.0, 6.5])), [f[1, 2], (f[8, 6] + f[8, 0] + f[0, 6] + f[0, 0]) / 4])


def test_references_and_reports(spark, tmp_path):
    (tmp_path / "blob").write_bytes(bytes(range(50)))
    refs = spark.createDataFrame([("k", str(tmp_path / "blob"), 5, 3)], "key string, url string, offset long, length long")
    assert bytes(references.read_ranges(refs).first().data) == b"\5\6\7"
    (tmp_path / "uris.json").write_text('["s3://a/b", "s3://a/c"]')
    assert [r.uri for r in references.uri_list(spark, str(tmp_path / "uris.json")).collect()] == ["s3://a/b", "s3://a/c"]
    ztensor.write_array(str(tmp_path / "z"), "x", RAGGED, (2, 4, 4), codec="zstd")
    assert references.raw_chunks(spark, str(tmp_path / "z"), "x").count() == 18
    rows = spark.createDataFrame([(("a", 1), 0, 5.0), (("a", 1), 1, 7.0), (("b", 1), 0, 4.0)], "config struct<engine: string, geom: int>, epoch int, mb double")
    reports.append_rows(rows, str(tmp_path / "m"))
    got = reports.load_rows(spark, str(tmp_path / "m"), "config struct<engine: string, geom: int>, epoch int, mb double")
    assert got.columns == ["engine", "geom", "epoch", "mb"]
    assert {r.engine: r.steady for r in metrics.steady_mean(got, ["engine"], "epoch", "mb").collect()} == {"a": 7.0, "b": 4.0}
    top = spark.createDataFrame([("a", 10.0)], "engine string, top double")
    assert {(r.engine, r.pct_of_ceiling) for r in reports.with_ceiling(got.where("epoch = 0"), top, ["engine"], "mb", "top").collect()} == {("a", 50.0), ("b", None)}
    assert reports.throughput(got, 2.0, 8).first().samples_per_s == 1.5
    assert reports.as_table(top).splitlines() == ["| engine | top    |", "|--------|--------|", "| a      | 10.000 |"]


def test_expressions(spark):
    df = frame(spark, RAGGED)
    one = lambda c, shape: values(df.select("sample_index", c.alias("value")), shape)
    x = RAGGED.astype(float)
    v = F.col("value")
    assert np.allclose(one(arrays.coarsened(v, 9, 7, 2), (4, 3)), x[:, :8, :6].reshape(5, 4, 2, 3, 2).mean((2, 4)))
    assert np.allclose(one(arrays.row_means(v, 9, 7), (9,)), x.mean(2))
    assert np.array_equal(one(arrays.crop(v, 9, 7, F.lit(2), F.lit(1), 4, 3), (4, 3)), x[:, 2:6, 1:4])
    assert np.array_equal(one(arrays.clip(v, -0.5, 0.5), (9, 7)).astype("f4"), RAGGED.clip(-0.5, 0.5))
    bad = spark.createDataFrame([(0, [float("nan"), 1.0, float("-inf")])], "sample_index long, value array<double>")
    assert bad.select(arrays.scrub(F.col("value"))).first()[0] == [0.0, 1.0, 0.0] and bad.select(arrays.not_finite(F.col("value"))).first()[0] == 2
    noisy = transforms.batch_noise(df.withColumnRenamed("sample_index", "anchor"), "value", 1.0, 1, 0)
    a, b = (noisy.repartition(k).orderBy("anchor").collect() for k in (1, 3))
    assert a == b and 0.8 < np.std([np.subtract(r.value_noisy, r.value) for r in a]) < 1.2


def test_scaler_and_metrics(spark, tmp_path):
    df = frame(spark, 5 * RAGGED + 10)
    s = StandardScaler.fit(df, ["value"])
    assert np.isclose(s.mean["value"], (5 * RAGGED + 10).mean()) and np.isclose(s.std["value"], (5 * RAGGED + 10).std())
    s.save(spark, str(tmp_path / "s"))
    t = StandardScaler.load(spark, str(tmp_path / "s"))
    assert (t.mean, t.std) == (s.mean, s.std)
    assert abs(values(t.apply(df), (63,)).mean()) < 1e-5
    pairs = spark.createDataFrame([(1.0, 1.0, True, True), (3.0, 1.0, True, False)], "p double, t double, a boolean, b boolean")
    r = pairs.agg(metrics.rmse(F.col("p"), F.col("t")), metrics.iou(F.col("a"), F.col("b")), metrics.iou(F.lit(False), F.lit(False))).first()
    assert np.allclose(r, (np.sqrt(2), 0.5, 1.0))
    flat = spark.createDataFrame([(1, [2.0, 2.0]), (2, [0.0, 9.0, 0.1, 9.5])], "k long, v array<double>")
    got = {r.k: r.t for r in flat.select("k", metrics.otsu(F.col("v")).alias("t")).collect()}
    assert got[1] == 2.0 and 0.05 < got[2] < 9
    bad = spark.createDataFrame([([float("nan"), 1.0, 3.0, float("inf"), -50.0],)], "v array<double>").select(metrics.robust_scaled(F.col("v"))).first()[0]
    x = np.array([0, 1, 3, 0, -50.0])
    assert np.allclose(bad, np.clip((x - 0) / (1.4826 * np.median(np.abs(x)) + 1e-6), -5, 5))


def test_scaler_by_level(spark, tmp_path):
    x = RAGGED * np.arange(1, 10)[None, :, None].astype("f4")
    df = frame(spark, x)
    s = StandardScaler.fit(df, ["value"], {"value": 9})
    assert np.allclose(s.mean["value"], x.mean((0, 2))) and np.allclose(s.std["value"], x.std((0, 2)))
    s.save(spark, str(tmp_path / "s"))
    assert StandardScaler.load(spark, str(tmp_path / "s")) == s
    assert np.allclose(values(s.apply(df), (9, 7)), (x - x.mean((0, 2))[None, :, None]) / x.std((0, 2))[None, :, None], atol=1e-4)


def test_cache_revives_and_goes_stale(spark, tmp_path):
    path, calls = str(tmp_path / "c"), []
    wanted = lambda *c: spark.createDataFrame([(x,) for x in c], "chunk_id long")

    def compute(miss):
        calls.append(sorted(r.chunk_id for r in miss.collect()))
        return miss.select((F.col("chunk_id") * 10).alias("sample_index"), F.array(F.col("chunk_id").cast("double")).alias("value"), "chunk_id")

    schema = "sample_index bigint, value array<double>"
    c = ChunkCache(spark, path, "one", schema)
    assert c.get(wanted(0, 1), compute).count() == 2 and (c.hits, c.misses) == (0, 2)
    c = ChunkCache(spark, path, "one", schema)
    assert c.get(wanted(1, 2), compute).count() == 2 and (c.hits, c.misses) == (1, 1)
    assert calls == [[0, 1], [2]]
    with pytest.raises(StaleCache):
        ChunkCache(spark, path, "two", schema)
    c = ChunkCache(spark, path, "two", schema, reset_stale=True)
    assert c.stored().count() == 0
    c.clear()


def test_cache_trusts_nothing_but_its_log(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "sample_index bigint, value array<double>"
    wanted = spark.createDataFrame([(0,), (1,)], "chunk_id long")
    make = lambda miss: miss.select(F.col("chunk_id").alias("sample_index"), F.array(F.lit(1.0)).alias("value"), "chunk_id")
    c = ChunkCache(spark, path, "one", schema)
    c.get(wanted, make)
    (tmp_path / "c" / "mine.txt").write_text("not the cache's")
    make(wanted).write.parquet(f"{path}/write-unlisted")
    assert ChunkCache(spark, path, "one", schema).stored().count() == 2
    folder = c.folders()[0]
    spark.createDataFrame([(5, 1, "../out"), (6, 1, "gone"), (1, 9, folder)], "chunk_id long, samples long, folder string").write.mode("append").parquet(f"{path}/log")
    c = ChunkCache(spark, path, "one", schema)
    assert c.get(wanted, make).count() == 2 and (c.hits, c.misses, c.missing, c.mismatches) == (2, 0, 2, 1)
    spark.createDataFrame([(json.dumps(c.header),), ("x",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    ChunkCache(spark, path, "two", schema, reset_stale=True)
    assert (tmp_path / "c" / "mine.txt").exists() and (tmp_path / "c" / "write-unlisted").exists() and not (tmp_path / "c" / folder).exists()
    c = ChunkCache(spark, path, "two", schema)
    c.get(wanted, make)
    shutil.rmtree(tmp_path / "c" / "header")
    with pytest.raises(StaleCache, match="no header"):
        ChunkCache(spark, path, "two", schema)
    assert [bare_name(x) for x in ("a", "write-1", "", ".", "..", "a/b", "a\\b", None)] == [True, True, False, False, False, False, False, False]


def test_fingerprints_follow_the_source(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    prints = []
    for body in ("x - 1", "x - 273.15"):
        (tmp_path / "own_steps.py").write_text(f"def step(name, x, first):\n    return {body}\n")
        sys.modules.pop("own_steps", None)
        importlib.invalidate_caches()
        shutil.rmtree(tmp_path / "__pycache__", ignore_errors=True)
        linecache.clearcache()
        prints.append(transforms.identity([importlib.import_module("own_steps").step]))
    sys.modules.pop("own_steps", None)
    assert prints[0] != prints[1]


def test_store_options_and_backends(spark, tmp_path):
    ztensor.write_array(str(tmp_path), "x", RAGGED, (2, 4, 4))
    got = ztensor.read_samples(spark, f"file://{tmp_path}", storage_options={"use_mmap": True})["x"]
    assert np.array_equal(values(got, (9, 7)).astype("f4"), RAGGED)
    with pytest.raises(TypeError):
        ztensor.read_samples(spark, str(tmp_path), storage_options={"no_such_option": 1})
    with pytest.raises(ValueError):
        stores.filesystem("ftp://x/y", {"a": 1})
    with pytest.raises(ValueError):
        stores.filesystem(str(tmp_path), backend="other")
    fs, path = stores.filesystem("s3://bucket/key", {"anonymous": True, "region": "eu-west-1", "endpoint_override": "localhost:9"})
    assert fs.type_name == "s3" and path == "bucket/key"
    assert stores.filesystem("file:/tmp/x")[1] == "/tmp/x"
    try:
        import fsspec  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="fsspec"):
            stores.filesystem(str(tmp_path), backend="fsspec")


def frame_of(data, item, block, kind, shuffle=True, split=True):
    """A Blosc 1 frame, written by its description."""
    codec = {1: "lz4_raw", 2: "snappy"}.get(kind)
    pack = lambda x: pa.Codec(codec).compress(x).to_pybytes() if codec else zlib.compress(x) if kind == 3 else zstandard.ZstdCompressor().compress(x)
    parts = []
    for k in range(0, len(data), block):
        own = data[k : k + block]
        if shuffle:
            many = len(own) // item
            own = np.frombuffer(own[: many * item], np.uint8).reshape(many, item).T.tobytes() + own[many * item :]
        n = item if split and len(own) == block and block // item >= 128 else 1
        out = b""
        for s in range(n):
            piece = own[s * len(own) // n : (s + 1) * len(own) // n]
            packed = pack(piece)
            packed = packed if len(packed) < len(piece) else piece
            out += struct.pack("<i", len(packed)) + packed
        parts.append(out)
    starts, at = [], 16 + 4 * len(parts)
    for p in parts:
        starts.append(at)
        at += len(p)
    body = b"".join(struct.pack("<i", s) for s in starts) + b"".join(parts)
    return struct.pack("<BBBBIII", 2, 1, kind << 5 | shuffle | (not split) << 4, item, len(data), block, 16 + len(body)) + body


def test_blosc_frames_checksums_and_shards(spark, tmp_path):
    data = np.arange(5000, dtype="<f4").tobytes() + np.random.default_rng(0).bytes(60)
    for kind, split, shuffle in itertools.product((1, 2, 3, 4), (True, False), (True, False)):
        assert codecs.blosc(frame_of(data, 4, 4096, kind, shuffle, split)) == data
    assert codecs.blosc(struct.pack("<BBBBIII", 2, 1, 2, 4, 5, 5, 21) + b"hello") == b"hello"
    with pytest.raises(ValueError):
        codecs.blosc(struct.pack("<BBBBIII", 2, 1, 0, 4, 5, 5, 21) + b"hello")
    assert codecs.crc32c(b"123456789") == 0xE3069283
    with pytest.raises(ValueError):
        codecs.checked(b"123456789\0\0\0\0")
    # version 2 with Blosc
    (tmp_path / "b").mkdir()
    x = np.arange(6 * 300, dtype="<f4").reshape(6, 300)
    (tmp_path / "b" / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [6, 300], "chunks": [3, 300], "dtype": "<f4", "compressor": {"id": "blosc", "cname": "lz4"}, "fill_value": 0, "order": "C", "filters": None}))
    for k in range(2):
        (tmp_path / "b" / f"{k}.0").write_bytes(frame_of(x[3 * k : 3 * k + 3].tobytes(), 4, 1200, 1))
    assert np.array_equal(values(ztensor.read_samples(spark, str(tmp_path), ["b"])["b"], (300,)).astype("f4"), x)
    # version 3 with shards of 2 x 2 inner chunks, one of them absent
    (tmp_path / "s" / "c" / "0").mkdir(parents=True)
    y = np.arange(16, dtype="<f4").reshape(4, 4)
    little, crc = {"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}
    meta = {"zarr_format": 3, "node_type": "array", "shape": [4, 4], "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 4]}}, "fill_value": -1, "codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 2], "codecs": [little, crc], "index_codecs": [little, crc]}}]}
    (tmp_path / "s" / "zarr.json").write_text(json.dumps(meta))
    body, index = b"", b""
    for i, j in itertools.product(range(2), range(2)):
        raw = y[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].tobytes()
        raw += struct.pack("<I", codecs.crc32c(raw))
        index += struct.pack("<QQ", 2**64 - 1, 2**64 - 1) if (i, j) == (1, 0) else struct.pack("<QQ", len(body), len(raw))
        body += b"" if (i, j) == (1, 0) else raw
    (tmp_path / "s" / "c" / "0" / "0").write_bytes(body + index + struct.pack("<I", codecs.crc32c(index)))
    y[2:, :2] = -1
    assert np.array_equal(values(ztensor.read_samples(spark, str(tmp_path), ["s"])["s"], (4,)).astype("f4"), y)


def test_written_by_tasks_and_read_without_a_shuffle(spark, tmp_path):
    df = frame(spark, RAGGED).repartition(3)
    assert ztensor.write_samples(df, str(tmp_path), "x", 5, (9, 7), (2, 4, 4), codec="zstd") == (3, 18)
    got = ztensor.read_samples(spark, str(tmp_path), transforms=(Halve(),))["x"]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert np.allclose(values(got, (4, 3)), RAGGED[:, :8, :6].reshape(5, 4, 2, 3, 2).mean((2, 4)))
    with pytest.raises(Exception, match="declare output_inner"):
        ztensor.read_samples(spark, str(tmp_path), transforms=(drop_column,))["x"].count()


def test_dataset_opened_from_a_store(spark, tmp_path):
    url = str(tmp_path / "z")
    ztensor.write_array(url, "a", np.arange(40 * 4, dtype="f4").reshape(40, 4), (8, 4), codec="zstd")
    (tmp_path / "z" / "a" / "c" / "1" / "0").write_bytes(b"\0\1\2\3")
    m = split_by_chunk(40, 8, (1.0, 0.0, 0.0))
    ds = Dataset.open(spark, url, {"x": "a", "y": ("a", 1)}, m, on_bad_chunk="nan", batch_size=4, max_batches=3, shuffle=False)
    rows = ds.train.orderBy("draw_pos").collect()
    assert [r.anchor for r in rows] == list(range(12)) and np.isnan(rows[7].y).all() and np.isnan(rows[8].x).all() and rows[0].y == [4.0, 5.0, 6.0, 7.0]
    assert [tuple(r) for r in ds.bad_chunks().collect()] == [("a", 1, [0])]
    with pytest.raises(Exception, match="cannot be decoded"):
        Dataset.open(spark, url, {"x": "a"}, m).train.count()
    with pytest.raises(ValueError):
        Dataset(spark, {"a": ds.frames["a"]}, {"x": open_geometries(url)["a"]}, m).bad_chunks()
    add = lambda name, x, first: x + 1
    runs = [Dataset.open(spark, url, {"x": "a"}, m, on_bad_chunk="nan", chunk_transforms=(add,), cache_dir=str(tmp_path / "cache")) for _ in range(2)]
    assert runs[1].caches["a"].hits == 5 and runs[1].train.where("anchor = 0").first().x == [1.0, 2.0, 3.0, 4.0]
    it = ds.iterate("train")
    assert len(next(it)) == 4
    it.close()  # an early end leaves nothing behind
    assert ds.train.count() == 12


def test_loader_forecast_history_and_uneven_chunks(spark, tmp_path):
    n = 48
    a, b = (np.arange(n * 9, dtype="f4").reshape(n, 3, 3) + k for k in (0, 1000))
    ztensor.write_array(str(tmp_path), "raw", a, (2, 3, 3))
    ztensor.write_array(str(tmp_path), "labels", b, (12, 2, 3))
    found = open_geometries(str(tmp_path))
    m = split_by_chunk(n, 2, (0.5, 0.25, 0.25))
    ds = Dataset(spark, ztensor.read_samples(spark, str(tmp_path)), {"x": found["raw"], "past": found["raw"].shift(-1), "y": found["labels"].shift(5)}, m, batch_size=5, block_chunks=4, persist=True)
    train = ds.train.collect()
    assert sorted(r.anchor for r in train) == list(range(1, 24))
    for r in train:
        assert r.x == a[r.anchor].ravel().tolist() and r.past == a[r.anchor - 1].ravel().tolist() and r.y == b[r.anchor + 5].ravel().tolist()
    assert [r.draw_pos for r in sorted(train, key=lambda r: r.draw_pos)] == list(range(23))
    first = [r.anchor for r in sorted(train, key=lambda r: r.draw_pos)]
    ds.set_epoch(1)
    assert first != [r.anchor for r in ds.train.orderBy("draw_pos").collect()]
    assert sorted(r.anchor for r in ds.all.collect()) == list(range(1, 43))
    got = list(ds.iterate("test"))
    assert [r.anchor for rows in got for r in rows] == list(range(36, 43)) and [len(rows) for rows in got] == [5, 2]
    assert handoff.arrays(got[0], ["x"], {"x": (3, 3)})["x"].shape == (5, 3, 3)
    assert ds.working_set_bytes() > 0
    ds.close()


def test_loader_checks_and_empty_split(spark, tmp_path):
    g = Geometry("x", (10, 3, 3), (2, 3, 3))
    x = {"x": frame(spark, np.zeros((10, 3, 3), "f4"))}
    with pytest.raises(ValueError):
        Dataset(spark, x, {"x": g}, split_by_chunk(12, 2))
    with pytest.raises(TypeError):
        Dataset(spark, x, {"x": g}, split_by_chunk(10, 2), wrong=1)
    with pytest.warns(UserWarning):
        ds = Dataset(spark, x, {"x": g}, split_by_chunk(10, 2, (1.0, 0.0, 0.0)), max_inflight=4)
    assert ds.val.count() == 0 and ds.val.columns == ds.train.columns
    cached = [Dataset(spark, x, {"x": g}, split_by_chunk(10, 2), chunk_transforms=(lambda name, v, first: v + 1,), batch_transforms=(lambda df: df.withColumn("more", F.size("x")),), cache_dir=str(tmp_path), reset_stale_cache=True) for _ in range(2)]
    assert cached[0].caches["x"].misses == 5 and cached[1].caches["x"].hits == 5
    row = cached[1].train.first()
    assert row.x == [1.0] * 9 and row.more == 9


def test_gather_from_tables(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    x = View(events, "event_id", "value")
    got = gather(events.select(F.col("event_id").alias("anchor")), {"x": x, "y": x.shift(2)})
    assert got.count() == events.count() - 2


def test_handoff_names_the_missing_framework():
    for f, name in ((handoff.to_torch, "torch"), (handoff.to_jax, "jax"), (handoff.to_tf, "tensorflow")):
        try:
            __import__(name)
        except ImportError:
            with pytest.raises(ImportError, match=name):
                f({"x": np.zeros(2)})


def test_check_transform_command(tmp_path, capsys):
    ztensor.write_array(str(tmp_path), "t2m", np.ones((24, 6, 8), "f4"), (8, 6, 8))
    (tmp_path / "t.py").write_text("def fine(n, x, f):\n    return x - 273.15\ndef wrong(n, x, f):\n    return x[..., :-1]\ndef nan(n, x, f):\n    return x * float('nan')\n")
    run = lambda attr, *more: main([str(tmp_path), "--var", "t2m", "--transform", f"{tmp_path}/t.py:{attr}", *more])
    assert run("fine") == 0 and run("wrong") == 1 and run("nan") == 0
    assert "not finite" in capsys.readouterr().out
    assert run("absent") == 2 and run("fine", "--chunk", "9") == 2 and main([str(tmp_path), "--var", "q", "--transform", "os:path"]) == 2


def test_event_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("windows").drop("total").collect())) == sorted(map(str, windowed(events).drop("total").collect()))


def test_bare_names_of_a_column(spark):
    names = ["a", "write-1", ".hidden", "", ".", "..", "a/b", "a\\b", "/", "a\0b", "a\n", "b\n/", None]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, name string")
    assert [r.b for r in rows.select("k", bare(F.col("name")).alias("b")).orderBy("k").collect()] == [bare_name(n) for n in names]
