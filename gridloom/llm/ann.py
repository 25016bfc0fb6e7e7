"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by ``WIDTH`` quantised random projections (normal, hence 2-stable), floor((a . x + b) / w); w is set from a
bounded sample of distances. A query visits its own bucket and perturbed ones, which move some of the projections to the next cell, in
the order of their estimated chance of success (the expected squared distance to the borders that they cross).

Vectors and probes are each hashed once and dealt by (table, bucket), where they meet: a bucket's vectors are compared only with the
queries that visit it. The candidates of all tables are merged by the exact double-precision distances of the original vectors. A bucket
of over ``ROWS`` vectors or visits is cut into a grid of such parts, so it may hold any share of the rows. Queries whose buckets hold
fewer than K vectors are searched for again among all vectors, exactly, in blocks of ``QUERIES``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, ship

#: Hash tables, projections of a table, probes of a table, and the cell's width in units of the sampled neighbour distance.
TABLES, WIDTH, PROBES, CELL = 8, 6, 160, 1.12
#: Vectors or visits of a bucket that one task compares at once; queries of an exact pass; vectors sampled for the cell's width.
ROWS, QUERIES, SAMPLE = 4096, 2048, 512
#: Bytes of queries (counted) up to which they are broadcast; beyond, each visit carries its query's vector.
QUERY_BYTES = 64 << 20
#: Candidates that a task holds before it keeps the K best of each query.
HELD = 200_000
K = 10
_FOUND = "query_id long, vec_id long, row long, score double"
_DEALT = "t int, bucket long, kind int, id long, row long, v binary"


def valid(column: str = "embedding"):
    """Whether a vector takes part: not null or empty, all components finite numbers, not all zero."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


class Hashes:
    def __init__(self, size: int, width: float, seed: int = 7):
        r = np.random.default_rng(seed)
        self.a = r.normal(size=(TABLES, WIDTH, size))
        self.b = r.uniform(0, width, (TABLES, WIDTH))
        self.w = width
        self.key = r.integers(1, 1 << 62, (TABLES, WIDTH), dtype=np.int64) | 1

    def project(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.a[t].T + self.b[t]) / self.w

    def buckets(self, x: np.ndarray, t: int) -> np.ndarray:
        return (np.floor(self.project(x, t)).astype(np.int64) * self.key[t]).sum(1)

    def probes(self, q: np.ndarray, t: int) -> np.ndarray:
        """Buckets of a table that each query visits, its own first, then by the estimated chance of success of their moves."""
        p = self.project(q, t)
        cell = np.floor(p)
        inner = p - cell
        order = np.argsort(np.concatenate((inner, 1 - inner), axis=1), axis=1, kind="stable")
        step = np.concatenate((-self.key[t], self.key[t]))[order]
        own = (cell.astype(np.int64) * self.key[t]).sum(1)
        return np.concatenate((own[:, None], own[:, None] + step @ _moves().T), axis=1)


@cache
def _moves() -> np.ndarray:
    """The sets of moves, as rows of 0 and 1 over a query's moves from the nearest border to the farthest, by rising expected squared distance.
    The k-th nearest border of WIDTH cells is opposite the k-th farthest, and no set has both. A set is followed by the one whose last move
    is replaced by the next, and by the one that adds it."""
    w = WIDTH
    near = lambda k: k * (k + 1) / (4 * (w + 1) * (w + 2))
    cost = [near(k) if k <= w else 1 - (2 * w + 1 - k) / (w + 1) + near(2 * w + 1 - k) for k in range(1, 2 * w + 1)]
    heap, out = [(cost[0], (0,))], []
    while heap and len(out) < PROBES - 1:
        total, own = heapq.heappop(heap)
        last = own[-1]
        if last + 1 < 2 * w:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*own[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*own, last + 1)))
        if not any(2 * w - 1 - k in own for k in own):
            out.append([int(k in own) for k in range(2 * w)])
    return np.array(out, np.int64).reshape(-1, 2 * w)


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    return b.column(b.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)


def _dealt(hashes, probing: bool, kind: str | None):
    """A row for each table (and probe) of each vector (id, row, embedding), with its components in the type given, or without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashes.value
        for big in batches:
            for at in range(0, big.num_rows, 512 if probing else 4096):
                b = big.slice(at, 512 if probing else 4096)
                x = _vectors(b)
                raw = np.array([r.tobytes() if kind else None for r in x.astype(kind or "f8")], object)
                ids, rows = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for t in range(TABLES):
                    bucket = h.probes(x, t) if probing else h.buckets(x, t)[:, None]
                    who = np.repeat(np.arange(len(x)), bucket.shape[1])
                    n = len(who)
                    cols = [pa.array(np.full(n, t, np.int32)), pa.array(bucket.ravel()), pa.array(np.full(n, not probing, np.int32)), pa.array(ids[who]), pa.array(rows[who]), pa.array(raw[who], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["t", "bucket", "kind", "id", "row", "v"])

    return run


def _sizes(hashes, probing: bool):
    """How many vectors, or visits, each bucket has, counted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b)
            for t in range(TABLES):
                bucket, n = np.unique(hashes.value.probes(x, t) if probing else hashes.value.buckets(x, t), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, np.int32)), pa.array(bucket), pa.array(n.astype(np.int64))], ["t", "bucket", "n"])

    return run


class Best:
    """The K best candidates of each query so far, a row of vectors once."""

    def __init__(self):
        self.parts, self.count = [], 0

    def add(self, query, ids, rows, score) -> None:
        self.parts.append((query, ids, rows, score))
        self.count += len(ids)
        if self.count > HELD:
            self.parts = [self.kept()]
            self.count = len(self.parts[0][0])

    def kept(self) -> tuple[np.ndarray, ...]:
        q, ids, rows, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((rows, q))
        q, ids, rows, score = (x[order] for x in (q, ids, rows, score))
        once = np.concatenate(([True], (q[1:] != q[:-1]) | (rows[1:] != rows[:-1])))
        q, ids, rows, score = (x[once] for x in (q, ids, rows, score))
        order = np.lexsort((rows, ids, score, q))
        q, ids, rows, score = (x[order] for x in (q, ids, rows, score))
        at = np.arange(len(q))
        first = np.maximum.accumulate(np.where(np.concatenate(([True], q[1:] != q[:-1])), at, 0))
        near = at - first < K
        return tuple(x[near] for x in (q, ids, rows, score))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in self.kept()], ["query_id", "vec_id", "row", "score"])


def _compare(best: Best, queries: tuple[np.ndarray, np.ndarray], ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
    """Adds the vectors that may be among each query's K nearest of these. A product of matrices says which (with room for its rounding); their
    distances are then taken from the differences."""
    for a in range(0, len(queries[0]), 256):
        own, q = (y[a : a + 256] for y in queries)
        norms = (q**2).sum(1)[:, None] + (x**2).sum(1)[None]
        rough = norms - 2 * q @ x.T
        rough[own[:, None] == ids[None]] = np.inf
        if len(x) > K + 1:
            rough = np.where(rough <= np.partition(rough, K - 1, axis=1)[:, K - 1 : K] + 1e-9 * norms, rough, np.inf)
        i, j = np.nonzero(np.isfinite(rough))
        if len(i):
            best.add(own[i], ids[j], rows[j], np.sqrt(((x[j] - q[i]) ** 2).sum(1)))


def _meet(kind: str, queries=None):
    """Rows come sorted by part of a bucket, visits first: each part's vectors are compared with its visits. queries: all of them, sorted by id,
    where they are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, last, asked = Best(), None, []
        for b in batches:
            if not b.num_rows:
                continue
            t, bucket, sv, sq, side, ids, rows = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("t", "bucket", "sv", "sq", "kind", "id", "row"))
            v = b.column(b.schema.get_field_index("v"))
            edge = np.zeros(b.num_rows, bool)
            for c in (t, bucket, sv, sq, side):
                edge[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(edge).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                key = t[lo], bucket[lo], sv[lo], sq[lo]
                if key != last:
                    last, asked = key, []
                if side[lo] and not asked:
                    continue
                if queries is not None and not side[lo]:
                    every, q = queries.value
                    x = q[np.searchsorted(every, ids[lo:hi])]
                else:
                    x = np.frombuffer(b"".join(v.slice(lo, hi - lo).to_pylist()), kind).astype(np.float64).reshape(hi - lo, -1)
                if not side[lo]:
                    asked.append((ids[lo:hi], x))
                    continue
                if len(asked) > 1:
                    asked = [tuple(np.concatenate(y) for y in zip(*asked))]
                _compare(best, asked[0], ids[lo:hi], rows[lo:hi], x)
        yield from best.batches()

    return run


def _searched(block):
    """Every vector with every query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best()
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                b = big.slice(at, 4096)
                _compare(best, block.value, *(b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)), _vectors(b))
        yield from best.batches()

    return run


def hashes_for(rows: DataFrame) -> Hashes | None:
    """Hashes for vectors of the commonest length, with a cell as wide as a bounded sample's neighbours are apart."""
    seen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not seen:
        return None
    size = int(np.bincount([len(r.embedding) for r in seen]).argmax())
    x = np.array([r.embedding for r in seen if len(r.embedding) == size])
    gaps = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    gaps[np.arange(len(x)), np.arange(len(x))] = np.inf
    near = float(np.quantile(gaps.min(1), 0.9)) if len(x) > 1 else 1.0  # a high quantile: copies may be many
    return Hashes(size, CELL * (near if np.isfinite(near) and near > 0 else 1.0))


def candidates(rows: DataFrame, asked: DataFrame, hashes: Hashes, scratch: Scratch, kind: str = "f8") -> DataFrame:
    """Rows (vec_id, row, embedding) that meet a query in a bucket: the best K of each task. Queries are broadcast up to QUERY_BYTES; kind: the
    type of components, as they were in the table."""
    spark = rows.sparkSession
    size = hashes.a.shape[2]
    queries = None
    if asked.count() * size * 8 <= QUERY_BYTES:
        own = sorted(asked.select("vec_id", "embedding").collect(), key=lambda r: r.vec_id)
        queries = spark.sparkContext.broadcast((np.array([r.vec_id for r in own], np.int64), np.array([r.embedding for r in own]).reshape(-1, size)))
    shared = spark.sparkContext.broadcast(hashes)
    large = [df.mapInArrow(_sizes(shared, probing), "t int, bucket long, n long").groupBy("t", "bucket").agg(F.ceil(F.sum("n") / ROWS).cast("int").alias(name)).where(f"{name} > 1") for df, probing, name in ((rows, False, "pv"), (asked, True, "pq"))]
    large = scratch.save(large[0].join(large[1], ["t", "bucket"], "full"), "large")  # at most rows and visits by ROWS
    one = rows.mapInArrow(_dealt(shared, False, kind), _DEALT).unionAll(asked.mapInArrow(_dealt(shared, True, kind if queries is None else None), _DEALT))
    if large.isEmpty():
        dealt = one.withColumns({"sv": F.lit(0), "sq": F.lit(0)})
    else:
        dealt = one.join(large, ["t", "bucket"], "left").withColumns({"pv": F.coalesce("pv", F.lit(1)), "pq": F.coalesce("pq", F.lit(1)), "h": F.xxhash64("row", "id")})
        own = lambda kind, parts: F.when(F.col("kind") == kind, F.array(F.pmod("h", parts).cast("int"))).otherwise(F.sequence(F.lit(0), F.col(parts) - 1))
        dealt = dealt.withColumn("sv", F.explode(own(1, "pv"))).withColumn("sq", F.explode(own(0, "pq"))).select(*one.columns, "sv", "sq")
    return dealt.repartition("t", "bucket", "sv", "sq").sortWithinPartitions("t", "bucket", "sv", "sq", "kind").mapInArrow(_meet(kind, queries), _FOUND)


def nearest(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """vectors, queries (vec_id, embedding, ...) -> query_id, rank, vec_id, score: the K nearest found of each query, itself left out.

    Vectors that are null, empty, zero, hold a null or non-finite component, or are not of the commonest length among the sample (which
    have no distance to those that are), take no part. Ties go to the smaller vec_id. Of rows with one vec_id all are candidates; as queries
    such rows are searched for once. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    shape = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col("embedding").cast(T.ArrayType(T.DoubleType())).alias("embedding")).where(valid() & F.col("vec_id").isNotNull())
    rows, asked = shape(vectors), shape(queries).dropDuplicates(["vec_id"])
    hashes = hashes_for(rows)
    if not hashes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = (x.where(F.size("embedding") == hashes.a.shape[2]) for x in (rows, asked))
    scratch = Scratch(spark)
    asked = scratch.save(asked, "queries")
    kind = "f4" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "f8"
    found = scratch.save(candidates(rows, asked, hashes, scratch, kind), "found")
    enough = found.select("query_id", "row").distinct().groupBy("query_id").count().where(F.col("count") >= K).select(F.col("query_id").alias("vec_id"))
    held, more = [], [found]

    def exact() -> DataFrame:
        block = np.array([r.vec_id for r in held], np.int64), np.array([r.embedding for r in held])
        return scratch.save(rows.mapInArrow(_searched(spark.sparkContext.broadcast(block)), _FOUND), "found")

    for r in asked.join(enough, "vec_id", "left_anti").toLocalIterator():
        held.append(r)
        if len(held) == QUERIES:
            more, held = [*more, exact()], []
    if held:
        more.append(exact())
    every = more[0]
    for x in more[1:]:
        every = every.unionAll(x)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id", "row")
    return every.dropDuplicates(["query_id", "row"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")
