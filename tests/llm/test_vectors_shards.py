"""Nearest neighbours against brute force, and resharding against its laws."""

import collections
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ann, reshard
from gridloom.llm.common import Scratch


def test_nearest_recall_and_ties(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = collections.defaultdict(list)
    for r in ann.nearest(vectors, vectors.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        near = ids[np.lexsort((ids, d))[:10]].tolist()
        hit += len(set(near) & {v for v, _ in got[q]})
        assert all(abs(s - d[ids == v][0]) < 1e-12 for v, s in got[q])
    assert hit >= 0.9 * 10 * len(got)


def test_nearest_hard_rows(spark):
    bad = [(100, None), (200, []), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [float("nan"), 1.0]), (600, [float("inf"), 1.0]), (None, [1.0, 1.0]), (700, [1.0, 1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in bad + good], "vec_id long, embedding array<float>, label int, rank int")
    got = [tuple(r)[:3] for r in ann.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (0, 4, 3)]
    assert ann.nearest(df.limit(0), df).count() == 0
    far = spark.createDataFrame([(100 * i, [float(i), 1.0]) for i in range(8)], "vec_id long, embedding array<double>")
    assert ann.nearest(far, far).groupBy("query_id").count().where("count = 7").count() == 8


def test_nearest_in_blocks(spark, monkeypatch):
    """Small parts of buckets and small exact passes give the same rows."""
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = lambda: sorted(map(tuple, ann.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect()))
    want = rows()
    assert len(want) == 100 and len({r[0] for r in want}) == 10
    monkeypatch.setattr(ann, "QUERIES", 3)
    monkeypatch.setattr(ann, "ROWS", 5)
    monkeypatch.setattr(ann, "HELD", 40)
    assert rows() == want
    monkeypatch.setattr(ann, "QUERY_BYTES", 0)
    assert rows() == want


def test_nearest_among_copies(spark):
    """A third of all rows are copies of one vector, with ids and without order."""
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(600, 6)), 3)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for row in ann.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[row.query_id].append(row.vec_id)
    copies = list(range(0, 600, 3))
    assert got[0] == copies[1:11] and got[300] == copies[:10] and all(len(v) == 10 for v in got.values())


@pytest.mark.parametrize("spread", [0.0, 0.15])
def test_probes_visit_part_of_the_table(spread):
    """How much of the table the probes visit, and the recall: of vectors without structure, where most must be visited, and of clusters."""
    r = np.random.default_rng(1)
    x = r.normal(size=(12_000, 64))
    if spread:
        x = x[r.integers(0, 150, len(x))] + spread * r.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = np.sqrt(np.maximum(2 - 2 * x[:512] @ x[:512].T, 0))
    np.fill_diagonal(near, np.inf)
    hashes = ann.Hashes(64, ann.CELL * float(np.quantile(near.min(1), 0.9)))
    q = x[::200]
    d = 2 - 2 * q @ x.T
    d[np.arange(len(q)), np.arange(0, len(x), 200)] = np.inf
    top = np.argsort(d, 1)[:, : ann.K]
    hit = np.zeros(d.shape, bool)
    for t in range(ann.TABLES):
        own, probes = hashes.buckets(x, t), hashes.probes(q, t)
        for i in range(len(q)):
            hit[i] |= np.isin(own, probes[i])
    recall, share = np.take_along_axis(hit, top, 1).mean(), hit.mean()
    assert recall >= 0.9 and share <= (0.1 if spread else 0.8), (recall, share)


def brute_moves(supply, capacity):
    """The least number of units that move, by trying all ways."""
    best = None
    for rows in itertools.product(*[[c for c in itertools.product(range(s + 1), repeat=len(capacity)) if sum(c) == s] for s in supply]):
        if all(sum(r[j] for r in rows) <= c for j, c in enumerate(capacity)):
            moved = sum(f for i, r in enumerate(rows) for j, f in enumerate(r) if i != j)
            best = moved if best is None else min(best, moved)
    return best


def test_flow_is_cheapest():
    r = np.random.default_rng(2)
    for _ in range(12):
        supply = r.integers(0, 5, 3).tolist()
        capacity = reshard.even(sum(supply), int(r.integers(2, 4)))
        flow = reshard.minimum_cost_flow(supply, capacity, [[int(i != j) for j in range(len(capacity))] for i in range(3)])
        assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= c for j, c in enumerate(capacity))
        assert sum(x for i, f in enumerate(flow) for j, x in enumerate(f) if i != j) == brute_moves(supply, capacity)
    flow = reshard.minimum_cost_flow([3, 3], [3, 3], [[1, 2], [1, 9]])
    assert flow == [[0, 3], [3, 0]]  # the first path is taken back


def test_reshard(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hard = spark.createDataFrame([(None, "null id"), (5000, None), (5001, ""), (5002, "x"), (5002, "x"), (5003, "é" * 9)], "doc_id long, text string")
    docs = docs.unionByName(hard, allowMissingColumns=True).withColumn("slot", F.lit(1)).withColumn("size", F.lit("clash"))
    scratch = Scratch(spark)
    rows, blocks = reshard.assign(docs, F.pmod(F.xxhash64("doc_id"), F.lit(6)), 8, scratch)
    path = str(tmp_path / "shards")
    assert reshard.rewrite(rows, blocks, 8, path) == list(range(8))
    out = reshard.slots(reshard.read_shards(spark, path, rows.schema), scratch).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    total = sum(r.size for r in out)
    moved = sum(r.size for r in out if r.shard != r.old_shard)
    least = sum(f for i, parts in blocks.items() for j, f in parts if i != j)
    assert set(by) == set(range(8)) and abs(moved - least) < 0.02 * total
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) < 0.02 * total / 8 + 2000


def test_reshard_keeps_unaffected_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 9) for i in range(30)], "doc_id long, text string")
    scratch = Scratch(spark)
    rows, blocks = reshard.assign(docs, F.col("doc_id") % 3, [100, 50, 150], scratch)
    assert reshard.affected(blocks, 3) == [1, 2]
    assert reshard.rewrite(rows, blocks, 3, str(tmp_path / "a")) == [1, 2]
    assert collections.Counter(r.shard for r in rows.collect()) == {0: 10, 1: 5, 2: 15}
    rows, blocks = reshard.assign(docs.limit(0), F.col("doc_id") % 3, 4, scratch)
    assert rows.count() == 0 and blocks == {}
