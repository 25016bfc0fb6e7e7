"""Resharding by minimum-cost flow.

The flow runs from the old shards (their sizes in bytes) to the new ones (their capacities in bytes); a byte that stays in its shard costs
nothing, one that moves costs one, so the cheapest flow moves the fewest bytes. The network has a node a shard and is solved on the
driver by successive shortest paths. Each old shard, its documents sorted by falling size, is then cut into blocks as the flow says: the
block that stays first, so that cuts fall among small documents. A cut is one key (size, id, checksum), so a row's new shard is an
expression over the row. Where rows of equal keys stand on both sides of a cut, these rows alone are written down once and counted off, so
any number of equal rows is parted as the flow says. Only shards that lose or gain rows are written again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, ship


def minimum_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units sent from each source to each sink at the least total cost. All supply is sent; capacities must hold it."""
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold the supply")
    n, m = len(supply), len(capacity)
    end = n + m
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    high = [0] * (n + m + 1)  # potentials keep all reduced costs at zero or more
    while any(left):
        far: list[float] = [0 if i < n and left[i] else float("inf") for i in range(n + m + 1)]
        back: list[int | None] = [None] * (n + m + 1)
        queue = [(0, i) for i in range(n) if left[i]]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u] or u == end:
                continue
            if u < n:
                edges = [(n + j, cost[u][j]) for j in range(m)]
            else:
                edges = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
                if room[u - n]:
                    edges.append((end, 0))
            for v, c in edges:
                to = d + c + high[u] - high[v]
                if to < far[v]:
                    far[v], back[v] = to, u
                    heapq.heappush(queue, (to, v))
        for v in range(n + m + 1):
            if far[v] < float("inf"):
                high[v] += int(far[v])
        path, v = [], back[end]
        first = v
        while v is not None:
            path.append(v)
            first, v = v, back[v]
        path.reverse()
        much = min(left[first], room[path[-1] - n])
        for a, b in zip(path, path[1:]):
            if a >= n:
                much = min(much, flow[b][a - n])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a][b - n] += much
            else:
                flow[b][a - n] -= much
        left[first] -= much
        room[path[-1] - n] -= much
    return flow


def plan(sizes: dict[int, int], capacities: list[int]) -> dict[int, list[tuple[int, int]]]:
    """For each old shard its blocks (new shard, bytes), the one that stays first."""
    old = sorted(sizes)
    flow = minimum_cost_flow([sizes[i] for i in old], capacities, [[int(i != j) for j in range(len(capacities))] for i in old])
    return {i: sorted(((j, f) for j, f in enumerate(row) if f), key=lambda x: (x[0] != i, x[0])) for i, row in zip(old, flow)}


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def _local(group: str, size: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, rank, done = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(b.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            s = b.column(b.schema.get_field_index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.arange(len(g))
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            start = np.maximum.accumulate(np.where(new, at, 0))
            before = np.concatenate(([0], np.cumsum(s)))
            r, x = at - start, before[:-1] - before[start]
            if last == g[0]:
                own = start == 0
                r[own] += rank
                x[own] += done
            last, rank, done = g[-1], int(r[-1]) + 1, int(x[-1] + s[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(g), part, np.int32)), pa.array(r), pa.array(x)], names=[*b.schema.names, "part", "rank", "before"])

    return run


def running(df: DataFrame, group: str, order: list[str], size: str, scratch: Scratch) -> DataFrame:
    """Adds to each row its rank in its group and the sum of sizes before it, both in the order given, equal rows in any order. No group is
    gathered: rows are sorted by ranges, each range counts by itself, and the ranges' totals (a row for each range and group) give the
    rest. A row number, given where a row is read, is the last key, so that a range never has to hold all equal rows."""
    more = [T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("before", T.LongType())]
    apart = df.withColumn("apart", F.monotonically_increasing_id())
    local = apart.repartitionByRange(group, *order, "apart").sortWithinPartitions(group, *order, "apart").drop("apart").mapInArrow(_local(group, size), T.StructType([*df.schema.fields, *more]))
    local = scratch.save(local, "ranks")
    totals = local.groupBy("part", group).agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    ahead = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", group, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("s0"))
    return local.join(totals, ["part", group]).select(*df.columns, (F.col("rank") + F.col("n0")).alias("rank"), (F.col("before") + F.col("s0")).alias("before"))


def measured(docs: DataFrame) -> DataFrame:
    """docs with size (UTF-8 bytes of the text and one) and text_crc32 (of an empty text where it is null)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})


def _key(size, doc_id, crc) -> Column:
    return F.struct((-size).alias("s"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("d"), crc.alias("c"))


def assign(docs: DataFrame, old_shard: Column, capacities: list[int] | int, scratch: Scratch) -> tuple[DataFrame, dict[int, list[tuple[int, int]]]]:
    """docs (doc_id, text, ...) with size, text_crc32, old_shard and shard (its new one), and the plan. capacities: bytes of each new
    shard, or a number of shards of even size. Columns of docs with these names are replaced. A null text has size 1; rows with a null
    doc_id sort first among their size; equal rows go to as many shards as the flow says. Without rows there is no plan."""
    ship(docs.sparkSession)
    docs = measured(docs).withColumn("old_shard", old_shard.cast("int"))
    rows = scratch.save(docs.select(F.col("old_shard"), (-F.col("size")).alias("neg"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), "text_crc32", "size"), "sizes")
    sizes = {r.old_shard: int(r.s) for r in rows.groupBy("old_shard").agg(F.sum("size").alias("s")).collect()}  # a row a shard
    if isinstance(capacities, int):
        capacities = even(sum(sizes.values()), capacities)
    blocks = plan(sizes, capacities)
    at = running(rows, "old_shard", ["neg", "id", "text_crc32"], "size", scratch)
    middle = F.col("before") + F.col("size") / 2
    target = F.lit(None).cast("int")
    for i, parts in blocks.items():
        done, own = 0, F.lit(parts[-1][0])
        ends = []
        for j, f in parts:
            done += f
            ends.append((j, done))
        for j, to in reversed(ends[:-1]):
            own = F.when(middle < to, j).otherwise(own)
        target = F.when(F.col("old_shard") == i, own).otherwise(target)
    placed = at.withColumn("shard", target)
    cuts = placed.groupBy("old_shard", "shard").agg(F.min(F.struct("neg", "id", "text_crc32")).alias("k")).collect()  # shards by shards at most
    key = _key(F.col("size"), F.col("doc_id").cast("long"), F.col("text_crc32"))
    literal = lambda k: F.struct(F.lit(k.neg).cast("long").alias("s"), F.lit(k.id).cast("long").alias("d"), F.lit(k.text_crc32).cast("long").alias("c"))
    shard, same = F.lit(None).cast("int"), F.lit(False)
    for i in sizes:
        first = {r.shard: r.k for r in cuts if r.old_shard == i}
        parts = [j for j, _ in blocks[i] if j in first]
        own = F.lit(parts[0])
        for j in parts[1:]:
            own = F.when(key >= literal(first[j]), j).otherwise(own)
            same = same | ((F.col("old_shard") == i) & (F.struct(F.col("neg").alias("s"), F.col("id").alias("d"), F.col("text_crc32").alias("c")) == literal(first[j])))
        shard = F.when(F.col("old_shard") == i, own).otherwise(shard)
    ties: dict[tuple, dict[int, int]] = {}
    for r in placed.where(same).groupBy("old_shard", "neg", "id", "text_crc32", "shard").count().collect():  # cuts by shards at most
        ties.setdefault((r.old_shard, r.neg, r.id, r.text_crc32), {})[r.shard] = r["count"]
    ties = {k: v for k, v in ties.items() if len(v) > 1}
    out = docs.withColumn("shard", shard.cast("int"))
    return (_parted(out, ties, blocks, scratch) if ties else out), blocks


def _parted(docs: DataFrame, ties: dict[tuple, dict[int, int]], blocks: dict, scratch: Scratch) -> DataFrame:
    """docs with the rows of equal keys that stand on both sides of a cut counted off: for each key how many rows which shard has.

    These rows are written down with a number that tells the task that wrote them and the place there, so counting is by task, and tasks'
    totals (a row for each task and key) say how many come before.
    """
    number, share = F.lit(None).cast("int"), F.lit(None).cast("int")
    for t, ((i, neg, doc, crc), counts) in enumerate(ties.items()):
        own = (F.col("old_shard") == i) & (F.col("size") == -neg) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) == doc) & (F.col("text_crc32") == crc)
        number = F.when(own, t).otherwise(number)
        order = [j for j, _ in blocks[i] if j in counts]
        to, ends = 0, []
        for j in order:
            to += counts[j]
            ends.append((j, to))
        place = F.lit(order[-1])
        for j, end in reversed(ends[:-1]):
            place = F.when(F.col("_place") < end, j).otherwise(place)
        share = F.when(F.col("_tie") == t, place).otherwise(share)
    numbered = docs.withColumn("_tie", number)
    tied = scratch.save(numbered.where("_tie is not null").withColumn("_row", F.monotonically_increasing_id()), "ties").withColumn("_task", F.shiftright("_row", 33))
    totals = tied.groupBy("_tie", "_task").count()
    ahead = Window.partitionBy("_tie").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_tie", "_task", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("_tie", "_task").orderBy("_row")) - 1
    tied = tied.withColumn("_place", own).join(totals, ["_tie", "_task"]).withColumn("_place", F.col("_place") + F.col("_ahead")).withColumn("shard", share.cast("int"))
    return numbered.where("_tie is null").drop("_tie").unionByName(tied.select(*docs.columns))


def affected(blocks: dict[int, list[tuple[int, int]]], shards: int) -> list[int]:
    """New shards that do not stay as they are: those that lose or gain bytes, and old ones that end."""
    changed = {j for i, parts in blocks.items() for j, _ in parts if i != j} | {i for i, parts in blocks.items() if any(j != i for j, _ in parts)}
    return sorted(j for j in changed | (set(range(shards)) - set(blocks)) if j < shards)


def rewrite(assigned: DataFrame, blocks: dict[int, list[tuple[int, int]]], shards: int, path: str) -> list[int]:
    """Writes the affected shards below path, a folder a shard, from the scan's own tasks; returns them. Others keep their old files."""
    todo = affected(blocks, shards)
    assigned.where(F.col("shard").isin(todo)).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return todo


def read_shards(spark, path: str, schema: T.StructType) -> DataFrame:
    fields = [f for f in schema.fields if f.name != "shard"]
    return spark.read.schema(T.StructType([*fields, T.StructField("shard", T.IntegerType())])).parquet(path)


def slots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the rank in the shard by falling size, then id), grown_shard."""
    light = measured(rows).select("shard", (-F.col("size")).alias("neg"), F.col("doc_id").cast("long").alias("doc_id"), "text_crc32", "size", "old_shard")
    out = running(light, "shard", ["neg", "doc_id", "text_crc32"], "size", scratch)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")
