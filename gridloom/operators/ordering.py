"""Draw orders, blocks and batches of a split's anchors.

Nothing of the sample axis' size passes one task: samples are ranked inside a block of a few chunks; chunks, and running sums over blocks, are
ranked in parts (``plans.ranks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ranks import before, ranked, ranked_by_hash


def key(*parts) -> Column:
    """A hash order that any engine with md5 repeats: parts joined by bars."""
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts)).cast("binary"))


def chunk_permutation(chunks: DataFrame, seed: int, epoch: int) -> DataFrame:
    """(chunk_id) -> (chunk_id, pos): a permutation that seed and epoch alone decide."""
    return ranked_by_hash(chunks.select("chunk_id"), "chunk_id", key(seed, epoch, F.col("chunk_id")), "pos")


def in_order(chunks: DataFrame) -> DataFrame:
    return ranked(chunks.select("chunk_id"), "chunk_id", "pos")


def _drawn(placed: DataFrame, spc: int, n: int, block_chunks: int, order: list[Column], lo: int, hi: int) -> DataFrame:
    """Anchors of placed chunks (chunk_id, pos) within [lo, hi), with block and draw position."""
    first, last = F.greatest(F.col("chunk_id") * spc, F.lit(lo)), F.least((F.col("chunk_id") + 1) * spc, F.lit(n), F.lit(hi)) - 1
    placed = placed.select("chunk_id", "pos", F.expr(f"pos div {block_chunks}").alias("block_id"), first.alias("a"), last.alias("b")).where("a <= b")
    sizes = placed.groupBy("block_id").agg(F.sum(F.col("b") - F.col("a") + 1).alias("m"))
    starts = before(sizes, "block_id", F.col("m"), "start").select("block_id", "start")
    anchors = placed.select("chunk_id", "pos", "block_id", F.explode(F.sequence("a", "b")).alias("anchor"))
    rank = F.row_number().over(Window.partitionBy("block_id").orderBy(*order)) - 1
    return anchors.withColumn("row_in_block", rank.cast("long")).join(starts, "block_id").select((F.col("start") + F.col("row_in_block")).alias("draw_pos"), "block_id", "row_in_block", "chunk_id", (F.col("anchor") - F.col("chunk_id") * spc).alias("within"), "anchor")


def sequential_order(chunks: DataFrame, spc: int, n: int, *, block_chunks: int = 16, anchors: tuple[int, int] | None = None) -> DataFrame:
    """Anchors of the chunks in ascending order: draw_pos, block_id, row_in_block, chunk_id, within, anchor."""
    return _drawn(in_order(chunks), spc, n, block_chunks, [F.col("anchor")], *(anchors or (0, n)))


def block_shuffled_order(chunks: DataFrame, spc: int, n: int, *, block_chunks: int = 16, seed: int = 0, epoch: int = 0, anchors: tuple[int, int] | None = None) -> DataFrame:
    """The chunks permuted, and all anchors of each block of block_chunks chunks shuffled together. Blocks are taken before anchors outside
    ``anchors`` go, so an anchor range never breaks blocks up."""
    return _drawn(chunk_permutation(chunks, seed, epoch), spc, n, block_chunks, [key(seed, epoch, "s", F.col("anchor")), F.col("anchor")], *(anchors or (0, n)))


def batches(order: DataFrame, batch_size: int) -> DataFrame:
    """Adds batch_in_block and row_in_batch: batches of batch_size within each block, the last of a block may be short."""
    return order.withColumns({"batch_in_block": F.expr(f"row_in_block div {batch_size}"), "row_in_batch": F.col("row_in_block") % batch_size})


def numbered(batched: DataFrame, batch_size: int) -> DataFrame:
    """Adds batch_id: batches numbered through all blocks."""
    per = batched.groupBy("block_id").agg(F.ceil(F.count("*") / batch_size).alias("k"))
    starts = before(per, "block_id", F.col("k"), "first").select("block_id", "first")
    return batched.join(starts, "block_id").withColumn("batch_id", F.col("first") + F.col("batch_in_block")).drop("first")


def first_batches(order: DataFrame, batch_size: int, most: int | None) -> DataFrame:
    """The rows of an order in numbered batches: of the first ``most`` batches by number, not of whichever rows arrive first."""
    rows = numbered(batches(order, batch_size), batch_size)
    return rows if most is None else rows.where(F.col("batch_id") < most)


def read_order(plan: DataFrame, blocks: DataFrame) -> DataFrame:
    """A read plan (chunk_id, path, chunk_index) in the order of need: for each stored chunk once the first block of the draw order that needs it,
    and the last one. blocks: (chunk_id, block_id)."""
    own = plan.join(blocks, "chunk_id").groupBy("path", "chunk_index").agg(F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"))
    return own


def residents(reads: DataFrame) -> DataFrame:
    """How many stored chunks each block holds at once: those first needed by then and last needed from then on. Blocks are dense."""
    ends = reads.select(F.col("first_block").alias("block_id"), F.lit(1).alias("d")).unionAll(reads.select(F.col("last_block") + 1, F.lit(-1)))
    steps = ends.groupBy("block_id").agg(F.sum("d").alias("d"))
    out = before(steps, "block_id", F.col("d"), "held").select("block_id", (F.col("held") + F.col("d")).alias("resident"))
    return out


def shuffle_quality(order: DataFrame, n: int | None = None) -> DataFrame:
    """One row, quality: the mean distance of successive anchors over a third of their number, 1 at most, 0 for one anchor or none.

    Neighbours are found by an equi-join of draw positions, so the order is not gathered for a window.
    """
    a, b = order.select("draw_pos", "anchor"), order.select((F.col("draw_pos") - 1).alias("draw_pos"), F.col("anchor").alias("next"))
    gaps = a.join(b, "draw_pos", "left").agg(F.sum(F.abs(F.col("next") - F.col("anchor"))).alias("gap"), F.count("*").alias("n"))
    return gaps.select(F.when(F.col("n") <= 1, 0.0).otherwise(F.least(F.col("gap") / (F.col("n") - 1) / (F.col("n") / 3), F.lit(1.0))).alias("quality"))
