"""Named queries over the star-schema tables, each with the SQL that must give the same rows.

``events`` is a sampled axis (event_id is dense), ``embeddings`` a second one whose payload is an 8 x 8 field, ``orders`` a co-registered
variable with chunks of its own. Every query covers its whole table (``max_batches`` and ``single_chunk`` ask for a part by definition); those of
the tile source write their table as an array and read it back.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..check_transform import read_chunk
from ..dataset import Dataset
from ..functions import arrays, metrics, reports
from ..operators import cache, ordering, transforms, views
from ..operators.views import View
from ..sources import references, ztensor
from ..sources.shared import fresh_folder
from ..sources.stores import filesystem
from ..streaming.windows import windowed
from .geometry import Geometry, chunk_rows, frame, measured, placed_rows, residency, tile_rows, valid_anchors
from .split import Manifest, split_by_chunk

FLAGSHIP = "gather_forecast"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Samples a chunk, chunks a block, rows a batch, steps ahead, and seed and epoch of shuffled orders.
SPC, BLOCK, BATCH, AHEAD, SEED, EPOCH = 100, 4, 32, 24, 0, 3
FRACTIONS = (0.7, 0.15, 0.15)
SIDE = 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def axis(spark: SparkSession, sf_dir: str, name: str = "events") -> tuple[DataFrame, int]:
    """A table and its number of samples, which parquet footers hold."""
    df = read(spark, sf_dir, name)
    return df, df.count()


def manifest(n: int, **options) -> Manifest:
    return split_by_chunk(n, SPC, FRACTIONS, **options)


def train_order(spark: SparkSession, n: int, offsets=(0,)) -> DataFrame:
    return ordering.sequential_order(manifest(n).chunks(spark, "train").select("chunk_id"), SPC, n, block_chunks=BLOCK, anchors=valid_anchors(n, list(offsets)))


def fields(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("pos", "val"))


#: The split as SQL: c has the counts, m a row a chunk.
M = f"""p AS (SELECT count(*) n, CAST(ceil(count(*) / {SPC}.0) AS BIGINT) k FROM events),
c AS (SELECT n, k, CAST(round_even({FRACTIONS[0]}::DOUBLE * k, 0) AS BIGINT) a, CAST(round_even({FRACTIONS[1]}::DOUBLE * k, 0) AS BIGINT) b FROM p),
m AS (SELECT CASE WHEN i < a THEN 'train' WHEN i < a + b THEN 'val' ELSE 'test' END AS split, i AS chunk_id, n FROM (SELECT unnest(range(k)) i, a, b, n FROM c))"""
#: The train split's anchors in order, for offsets 0 and AHEAD: block, row in block.
T = f"""{M}, o AS (SELECT e.event_id anchor, chunk_id, chunk_id // {BLOCK} block_id FROM events e JOIN m ON e.event_id // {SPC} = m.chunk_id WHERE split = 'train' AND e.event_id + {AHEAD} < n),
r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY anchor) - 1 r FROM o)"""
#: All chunks permuted, their anchors with blocks and rows.
P = f"""ch AS (SELECT DISTINCT event_id // {SPC} chunk_id FROM events),
pm AS (SELECT chunk_id, row_number() OVER (ORDER BY md5(concat('{SEED}|{EPOCH}|', CAST(chunk_id AS VARCHAR))), chunk_id) - 1 pos FROM ch),
w AS (SELECT e.event_id anchor, chunk_id, pos // {BLOCK} block_id FROM events e JOIN pm ON e.event_id // {SPC} = pm.chunk_id),
d AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY md5(concat('{SEED}|{EPOCH}|s|', CAST(anchor AS VARCHAR))), anchor) - 1 r FROM w),
z AS (SELECT block_id, count(*) m FROM w GROUP BY block_id),
f AS (SELECT block_id, coalesce(sum(m) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) s FROM z),
dr AS (SELECT CAST(f.s + d.r AS BIGINT) draw_pos, d.block_id, d.r, d.chunk_id, d.anchor FROM d JOIN f USING (block_id))"""
#: Embedding elements.
E = "e AS (SELECT vec_id, CAST(i AS INTEGER) pos, embedding[i + 1] val FROM (SELECT vec_id, embedding, unnest(range(64)) i FROM embeddings))"


@query(f"WITH {M} SELECT split, chunk_id FROM m")
def split_manifest(spark, d):
    return manifest(axis(spark, d)[1]).chunks(spark)


@query(f"WITH {M} SELECT split, chunk_id, event_id AS sample_index FROM m JOIN events ON event_id // {SPC} = chunk_id")
def split_sample_indices(spark, d):
    return manifest(axis(spark, d)[1]).sample_indices(spark)


@query(f"WITH {M}, q AS (SELECT chunk_id, row_number() OVER (ORDER BY md5(concat('7|', CAST(chunk_id AS VARCHAR))), chunk_id) - 1 q FROM m) SELECT CASE WHEN q < a THEN 'train' WHEN q < a + b THEN 'val' ELSE 'test' END AS split, chunk_id FROM q, c")
def split_random(spark, d):
    return manifest(axis(spark, d)[1], contiguous=False, seed=7).chunks(spark)


@query(f"""WITH p AS (SELECT count(*) n FROM events), s AS (SELECT (n // 8) // {SPC} lo, CAST(ceil((n // 2 + 7) / {SPC}.0) AS BIGINT) hi FROM p),
c AS (SELECT lo, hi - lo k, CAST(round_even(0.7::DOUBLE * (hi - lo), 0) AS BIGINT) a, CAST(round_even(0.15::DOUBLE * (hi - lo), 0) AS BIGINT) b FROM s)
SELECT CASE WHEN i < a THEN 'train' WHEN i < a + b THEN 'val' ELSE 'test' END AS split, lo + i AS chunk_id FROM (SELECT unnest(range(k)) i, lo, a, b FROM c)""")
def split_sample_range(spark, d):
    n = axis(spark, d)[1]
    return manifest(n, sample_range=(n // 8, n // 2 + 7)).chunks(spark)


@query(f"SELECT DISTINCT event_id // {SPC} AS chunk_id FROM events")
def split_all_union(spark, d):
    m = manifest(axis(spark, d)[1])
    out = m.chunks(spark, "train")
    for s in ("val", "test"):
        out = out.unionByName(m.chunks(spark, s))
    return out.select("chunk_id").distinct()


@query(f"""SELECT name, n AS n_samples, spc AS sample_chunk_size, CAST(ceil(n / CAST(spc AS DOUBLE)) AS BIGINT) AS n_chunks, n - (CAST(ceil(n / CAST(spc AS DOUBLE)) AS BIGINT) - 1) * spc AS tail
FROM (SELECT 'events' AS name, count(*) n, CAST({SPC} AS BIGINT) spc FROM events UNION ALL SELECT 'embeddings', count(*), 64 FROM embeddings UNION ALL SELECT 'orders', count(*), 1000 FROM orders)""")
def chunk_geometry(spark, d):
    found = {name: Geometry(name, (axis(spark, d, name)[1],), (spc,)) for name, spc in (("events", SPC), ("embeddings", 64), ("orders", 1000))}
    return measured(frame(spark, found)).select(F.col("label").alias("name"), "n_samples", F.col("spc").alias("sample_chunk_size"), "n_chunks", "tail")


@query(f"SELECT event_id // {SPC} AS chunk_id, min(event_id) AS start, max(event_id) + 1 AS stop FROM events GROUP BY 1")
def samples_in_chunk(spark, d):
    g = Geometry("events", (axis(spark, d)[1],), (SPC,))
    return chunk_rows(frame(spark, {"x": g})).select(F.col("chunk_index").alias("chunk_id"), "start", "stop")


@query(f"SELECT CAST(3 AS BIGINT) AS lo, count(*) - {AHEAD} AS hi FROM events")
def valid_anchor_range(spark, d):
    return spark.createDataFrame([valid_anchors(axis(spark, d)[1], [-3, 0, AHEAD])], "lo bigint, hi bigint")


@query(f"SELECT event_id AS anchor FROM events, (SELECT count(*) n FROM events) WHERE event_id >= 3 AND event_id + {AHEAD} < n")
def edge_anchor_filter(spark, d):
    df, n = axis(spark, d)
    lo, hi = valid_anchors(n, [-3, 0, AHEAD])
    return df.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).select(F.col("event_id").alias("anchor"))


@query(f"SELECT event_id AS draw_pos, event_id // {SPC} AS chunk_id, event_id % {SPC} AS within, event_id AS anchor FROM events")
def sequential_order(spark, d):
    n = axis(spark, d)[1]
    return ordering.sequential_order(manifest(n).chunks(spark, "all"), SPC, n, block_chunks=BLOCK).select("draw_pos", "chunk_id", "within", "anchor")


@query(f"WITH {P} SELECT chunk_id, pos FROM pm")
def chunk_permutation(spark, d):
    return ordering.chunk_permutation(manifest(axis(spark, d)[1]).chunks(spark), SEED, EPOCH)


def _gathered(spark, d, rows):
    x = View(axis(spark, d)[0], "event_id", "value")
    return views.gather(rows.select("draw_pos", "anchor"), {"x": x, "y": x.shift(-1)}).select("draw_pos", "anchor", "x", "y")


def _shuffled(spark, d):
    n = axis(spark, d)[1]
    return ordering.block_shuffled_order(manifest(n).chunks(spark), SPC, n, block_chunks=BLOCK, seed=SEED, epoch=EPOCH)


@query(f"WITH {P} SELECT draw_pos, block_id, chunk_id, anchor FROM dr")
def block_shuffled_order(spark, d):
    return _shuffled(spark, d).select("draw_pos", "block_id", "chunk_id", "anchor")


@query(f"WITH {P}, g AS (SELECT abs(lead(anchor) OVER (ORDER BY draw_pos) - anchor) g FROM dr) SELECT round(least(CAST(sum(g) AS DOUBLE) / (count(*) - 1) / (count(*) / 3.0::DOUBLE), 1.0), 9) AS quality FROM g")
def shuffle_quality(spark, d):
    return ordering.shuffle_quality(_shuffled(spark, d)).select(F.round("quality", 9).alias("quality"))


@query(f"WITH {P} SELECT block_id, count(*) AS n_rows, count(DISTINCT chunk_id) AS n_chunks, min(draw_pos) AS first_pos, max(draw_pos) AS last_pos FROM dr GROUP BY block_id")
def block_partition(spark, d):
    return _shuffled(spark, d).groupBy("block_id").agg(F.count("*").alias("n_rows"), F.countDistinct("chunk_id").alias("n_chunks"), F.min("draw_pos").alias("first_pos"), F.max("draw_pos").alias("last_pos"))


@query(f"WITH {P} SELECT block_id, r // {BATCH} AS batch_in_block, r % {BATCH} AS row_in_batch, anchor FROM dr")
def batch_assignment(spark, d):
    return ordering.batches(_shuffled(spark, d), BATCH).select("block_id", "batch_in_block", "row_in_batch", "anchor")


@query(f"""WITH {P}, b AS (SELECT block_id, r // {BATCH} bi, count(*) n FROM dr GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY block_id, bi) - 1 AS batch_id, n FROM b""")
def batch_sizes(spark, d):
    return ordering.numbered(ordering.batches(_shuffled(spark, d), BATCH), BATCH).groupBy("batch_id").agg(F.count("*").alias("n"))


@query(f"WITH {P} SELECT draw_pos, anchor FROM dr WHERE block_id = 0 AND r // {BATCH} < 2")
def max_batches(spark, d):
    """The first batches of an order, by number, not by whichever rows arrive first."""
    return ordering.first_batches(_shuffled(spark, d), BATCH, 2).select("draw_pos", "anchor")


@query(f"""WITH {M}, t AS (SELECT chunk_id FROM m WHERE split = 'train' UNION ALL SELECT chunk_id FROM m WHERE split = 'train'), i AS (SELECT unnest(range(4)) i)
SELECT DISTINCT 'value' AS path, chunk_id AS chunk_index, i // 2 AS inner_y, i % 2 AS inner_x FROM t, i""")
def read_plan_dedup(spark, d):
    """Two labels of one path, tiled 2 x 2: each stored chunk once."""
    n = axis(spark, d)[1]
    labels = {"x": {"path": "value", "spc": SPC, "offset": 0}, "again": {"path": "value", "spc": SPC, "offset": 0}}
    plan = views.read_plan(manifest(n).chunks(spark, "train"), labels, SPC, n).select("path", "chunk_index")
    g = Geometry("value", (n, 8, 8), (SPC, 4, 4))
    tiles = tile_rows(frame(spark, {"x": g})).select("path", "chunk_index", F.col("cell")[1].alias("inner_y"), F.col("cell")[2].alias("inner_x"))
    return plan.join(tiles, ["path", "chunk_index"]).distinct()


@query(f"""WITH {M} SELECT DISTINCT 'value' AS path, x // {SPC} AS chunk_index FROM (SELECT e.event_id + o x, n FROM events e JOIN m ON e.event_id // {SPC} = m.chunk_id, (SELECT unnest([-3, 0, {AHEAD}]) o) WHERE split = 'train') WHERE x >= 0 AND x < n""")
def read_plan_windowed(spark, d):
    n = axis(spark, d)[1]
    labels = {str(o): {"path": "value", "spc": SPC, "offset": o} for o in (-3, 0, AHEAD)}
    return views.read_plan(manifest(n).chunks(spark, "train"), labels, SPC, n).select("path", "chunk_index").distinct()


@query(f"""SELECT DISTINCT e.event_id // {SPC} AS chunk_id, (e.event_id + {AHEAD}) // 32 AS chunk_index FROM events e, (SELECT count(*) n FROM events) WHERE e.event_id + {AHEAD} < n""")
def uneven_chunk_map(spark, d):
    n = axis(spark, d)[1]
    plan = views.read_plan(manifest(n).chunks(spark, "all"), {"y": {"path": "y", "spc": 32, "offset": AHEAD}}, SPC, n)
    return plan.select("chunk_id", "chunk_index")


@query(f"""WITH {P} SELECT (anchor + o) // {SPC} AS chunk_index, max(block_id) AS last_block FROM dr, (SELECT unnest([0, {AHEAD}]) o), (SELECT count(*) n FROM events) WHERE anchor + o < n GROUP BY 1""")
def last_use_block(spark, d):
    n = axis(spark, d)[1]
    blocks = ordering.chunk_permutation(manifest(n).chunks(spark), SEED, EPOCH).select("chunk_id", F.expr(f"pos div {BLOCK}").alias("block_id"))
    labels = {str(o): {"path": "value", "spc": SPC, "offset": o} for o in (0, AHEAD)}
    return views.read_plan(blocks, labels, SPC, n).join(blocks, "chunk_id").groupBy("chunk_index").agg(F.max("block_id").alias("last_block"))


@query("SELECT e.event_id AS anchor, e.value AS x, o.o_totalprice AS y FROM events e JOIN orders o ON o.o_orderkey = e.event_id")
def gather_co_anchor(spark, d):
    df, n = axis(spark, d)
    return views.gather(df.select(F.col("event_id").alias("anchor")), {"x": View(df, "event_id", "value"), "y": View(read(spark, d, "orders"), "o_orderkey", "o_totalprice")})


@query(f"WITH {T} SELECT block_id, r // {BATCH} AS batch_in_block, anchor, x.value AS x, y.value AS y FROM r JOIN events x ON x.event_id = anchor JOIN events y ON y.event_id = anchor + {AHEAD}")
def gather_forecast(spark, d):
    """For each anchor of the train split its value and the one AHEAD steps later, in batches."""
    df, n = axis(spark, d)
    x = View(df, "event_id", "value")
    rows = ordering.batches(train_order(spark, n, (0, AHEAD)), BATCH)
    return views.gather(rows, {"x": x, "y": x.shift(AHEAD)}).select("block_id", "batch_in_block", "anchor", "x", "y")


@query(f"""WITH {P} SELECT d.draw_pos, d.anchor, x.value AS x, y.value AS y FROM dr d JOIN events x ON x.event_id = d.anchor JOIN events y ON y.event_id = d.anchor - 1 WHERE d.anchor >= 1""")
def gather_shuffled(spark, d):
    """For each anchor of all shuffled blocks its value and the one before."""
    return _gathered(spark, d, _shuffled(spark, d))


@query("SELECT a.event_id AS anchor, CAST(s AS INTEGER) AS step, b.value AS value FROM events a, (SELECT unnest(range(3)) s) JOIN events b ON b.event_id = a.event_id + s - 2 WHERE a.event_id >= 2")
def gather_history_stack(spark, d):
    df, n = axis(spark, d)
    x = View(df, "event_id", "value")
    labels = {f"h{k}": x.shift(k) for k in (-2, -1, 0)}
    rows = views.gather(df.select(F.col("event_id").alias("anchor")), labels)
    return views.stacked(rows, list(labels)).select("anchor", F.posexplode("stack").alias("step", "value"))


@query(f"WITH {T} SELECT anchor, label, anchor + o AS read_index FROM r, (SELECT 'x' AS label, 0 AS o UNION ALL SELECT 'y', {AHEAD})")
def batch_read_indices(spark, d):
    df, n = axis(spark, d)
    x = View(df, "event_id", "value")
    return views.read_indices(train_order(spark, n, (0, AHEAD)).select("anchor"), {"x": x, "y": x.shift(AHEAD)})


@query(f"WITH {E} SELECT vec_id, pos, CAST(val::DOUBLE - 273.15 AS FLOAT) AS val FROM e")
def kelvin_to_celsius(spark, d):
    df = read(spark, d, "embeddings")
    return fields(df.select("vec_id", arrays.to_celsius(F.col("embedding")).alias("embedding")))


@query(f"""WITH {M}, v AS (SELECT value FROM events JOIN m ON event_id // {SPC} = chunk_id WHERE split = 'train')
SELECT 'value' AS variable, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std FROM v UNION ALL SELECT 'embedding', round(avg(x), 9), round(stddev_pop(x), 9) FROM (SELECT unnest(embedding)::DOUBLE x FROM embeddings)""")
def standard_scaler_fit(spark, d):
    df, n = axis(spark, d)
    m = manifest(n)
    last = m.counts[0] * SPC
    s = metrics.StandardScaler.fit(df.where(F.col("event_id") < last), ["value"])
    e = metrics.StandardScaler.fit(read(spark, d, "embeddings"), ["embedding"])
    rows = [("value", s.mean["value"], s.std["value"]), ("embedding", e.mean["embedding"], e.std["embedding"])]
    return spark.createDataFrame(rows, "variable string, mean double, std double").select("variable", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query("SELECT event_id, round((value - m) / (s + 1e-8), 6) AS z FROM events, (SELECT avg(value) m, stddev_pop(value) s FROM events)")
def standard_scaler_apply(spark, d):
    df = axis(spark, d)[0]
    return metrics.StandardScaler.fit(df, ["value"]).apply(df.select("event_id", "value")).select("event_id", F.round("value", 6).alias("z"))


@query(f"WITH {E} SELECT pos, round(avg(val::DOUBLE), 9) AS mean, round(stddev_pop(val::DOUBLE), 9) AS std FROM e GROUP BY pos")
def scaler_per_pixel(spark, d):
    v = F.col("val").cast("double")
    return fields(read(spark, d, "embeddings")).groupBy("pos").agg(F.round(F.avg(v), 9).alias("mean"), F.round(F.stddev_pop(v), 9).alias("std"))


@query(f"WITH {E} SELECT vec_id, CAST((pos // 8) // 2 * 4 + (pos % 8) // 2 AS INTEGER) AS pos, round(avg(val::DOUBLE), 6) AS val FROM e GROUP BY 1, 2")
def coarsen(spark, d):
    df = read(spark, d, "embeddings").select("vec_id", arrays.coarsened(F.col("embedding"), SIDE, SIDE, 2).alias("embedding"))
    return fields(df).withColumn("val", F.round("val", 6))


@query(f"WITH {E} SELECT vec_id, CAST(pos // 8 AS INTEGER) AS pos, round(avg(val::DOUBLE), 6) AS val FROM e GROUP BY 1, 2")
def mean_last_axis(spark, d):
    df = read(spark, d, "embeddings").select("vec_id", arrays.row_means(F.col("embedding"), SIDE, SIDE).alias("embedding"))
    return fields(df).withColumn("val", F.round("val", 6))


@query(f"""WITH {E}, a AS (SELECT vec_id, median(val::DOUBLE) med FROM e GROUP BY vec_id), b AS (SELECT vec_id, median(abs(val::DOUBLE - med)) mad FROM e JOIN a USING (vec_id) GROUP BY vec_id)
SELECT vec_id, pos, round(greatest(least((val::DOUBLE - med) / (mad * 1.4826::DOUBLE + 1e-6), 5.0), -5.0), 6) AS scaled FROM e JOIN a USING (vec_id) JOIN b USING (vec_id)""")
def robust_normalize(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", metrics.robust_scaled(F.col("embedding")).alias("embedding"))
    return rows.select("vec_id", F.posexplode("embedding").alias("pos", "scaled")).withColumn("scaled", F.round("scaled", 6))


PAIR = "q AS (SELECT a.vec_id, a.pos, a.val x, b.val y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND b.pos = a.pos)"


def _pairs(spark, d) -> DataFrame:
    df = read(spark, d, "embeddings")
    u = View(df, "vec_id", "embedding")
    return views.gather(df.select(F.col("vec_id").alias("anchor")), {"u": u, "v": u.shift(1)})


@query(f"WITH {E}, {PAIR} SELECT vec_id, pos, round(sqrt(x::DOUBLE * x::DOUBLE + y::DOUBLE * y::DOUBLE), 6) AS val FROM q")
def windspeed(spark, d):
    rows = _pairs(spark, d).select(F.col("anchor").alias("vec_id"), arrays.wind_speed(F.col("u"), F.col("v")).alias("embedding"))
    return fields(rows).withColumn("val", F.round("val", 6))


@query(f"WITH {E} SELECT vec_id, pos, CAST(CASE WHEN val > 0 THEN 1 ELSE 0 END AS FLOAT) AS val FROM e")
def binarize_mask(spark, d):
    df = read(spark, d, "embeddings")
    return fields(df.select("vec_id", arrays.binarise(F.col("embedding")).alias("embedding")))


@query(f"SELECT round(sqrt(avg(pow(b.value - a.value, 2))), 6) AS rmse, count(*) AS n FROM events a JOIN events b ON b.event_id = a.event_id + {AHEAD}")
def rmse_persistence(spark, d):
    df = axis(spark, d)[0]
    x = View(df, "event_id", "value")
    rows = views.gather(df.select(F.col("event_id").alias("anchor")), {"x": x, "y": x.shift(AHEAD)})
    return rows.agg(F.round(metrics.rmse(F.col("x"), F.col("y")), 6).alias("rmse"), F.count("*").alias("n"))


@query(f"WITH {E}, {PAIR}, b AS (SELECT vec_id // {BATCH} g, avg(pow(x::DOUBLE - y::DOUBLE, 2)) mse FROM q GROUP BY 1) SELECT round(avg(10 * log10(100.0 / mse)), 6) AS psnr FROM b")
def psnr(spark, d):
    rows = _pairs(spark, d).select(F.expr(f"anchor div {BATCH}").alias("batch"), F.explode(F.arrays_zip("u", "v")).alias("e"))
    mse = rows.groupBy("batch").agg(F.avg(F.pow(F.col("e.u").cast("double") - F.col("e.v").cast("double"), F.lit(2.0))).alias("mse"))
    return mse.agg(F.round(F.avg(metrics.psnr(F.col("mse"))), 6).alias("psnr"))


@query(f"WITH {E}, {PAIR} SELECT round(sum(CASE WHEN x > 0 AND y > 0 THEN 1.0 ELSE 0 END)::DOUBLE / sum(CASE WHEN x > 0 OR y > 0 THEN 1.0 ELSE 0 END)::DOUBLE, 9) AS iou FROM q")
def iou(spark, d):
    rows = _pairs(spark, d).select(F.explode(F.arrays_zip("u", "v")).alias("e"))
    return rows.agg(F.round(metrics.iou(F.col("e.u") > 0, F.col("e.v") > 0), 9).alias("iou"))


@query(f"""WITH {E}, n AS (SELECT vec_id, min(val::DOUBLE) lo, max(val::DOUBLE) hi FROM e GROUP BY vec_id),
h AS (SELECT vec_id, least(CAST(floor((val::DOUBLE - lo) / ((hi - lo) / 256)) AS INTEGER), 255) bin, lo, hi, count(*)::DOUBLE w FROM e JOIN n USING (vec_id) GROUP BY ALL),
k AS (SELECT *, lo + (bin + 0.5::DOUBLE) * ((hi - lo) / 256) c FROM h),
s AS (SELECT *, sum(w) OVER r wf, sum(w) OVER a nn, sum(w * c) OVER r cs, sum(w * c) OVER a al FROM k WINDOW r AS (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY vec_id)),
g AS (SELECT *, round(wf * (nn - wf) * pow(cs / greatest(wf, 1) - (al - cs) / greatest(nn - wf, 1), 2), 9) v FROM s)
SELECT vec_id, round(c, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, bin) q FROM g) WHERE q = 1""")
def otsu_threshold(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(metrics.otsu(F.col("embedding")), 6).alias("threshold"))


@query(f"""WITH {M} SELECT DISTINCT (e.event_id + o) // {SPC} AS chunk_index, (e.event_id + o) // {SPC} % 3 <> 0 AS hit FROM events e JOIN m ON e.event_id // {SPC} = m.chunk_id, (SELECT unnest([0, {AHEAD}]) o) WHERE split = 'train' AND e.event_id + o < n""")
def cache_hit_miss(spark, d):
    """Two chunks of three go through a cache; which of a plan's chunks it then holds."""
    n = axis(spark, d)[1]
    labels = {str(o): {"path": "value", "spc": SPC, "offset": o} for o in (0, AHEAD)}
    plan = views.read_plan(manifest(n).chunks(spark, "train"), labels, SPC, n).select("chunk_index").distinct()
    kept = _cached(spark, d, fresh_folder(spark, "cache"), "chunk_id % 3 <> 0", 0)[1]
    return cache.coverage(plan, kept.stored().select(F.col("chunk_id").alias("chunk_index")), ["chunk_index"])


def _cached(spark, d, path: str, where: str, more: int):
    """The chunks of events that a condition names, through a cache that computes misses with ``more`` added."""
    df, n = axis(spark, d)
    kept = cache.ChunkCache(spark, path, "catalogue", "sample_index bigint, value array<double>")
    chunk = F.expr(f"event_id div {SPC}")
    rows = df.select(F.col("event_id").alias("sample_index"), F.array(F.col("value") + more).alias("value"), chunk.alias("chunk_id"))
    return kept.get(manifest(n).chunks(spark).where(where).select("chunk_id"), lambda miss: rows.join(miss, "chunk_id", "left_semi")), kept


@query(f"SELECT event_id // {SPC} AS chunk_id, round(sum(value + CASE WHEN event_id // {SPC} % 3 = 0 THEN 1000 ELSE 0 END), 5) AS total FROM events GROUP BY 1")
def cache_revive(spark, d):
    """A second run is served what the first one stored, and computes the rest."""
    path = fresh_folder(spark, "cache")
    _cached(spark, d, path, "chunk_id % 3 <> 0", 0)
    rows = _cached(spark, d, path, "true", 1000)[0]
    return rows.groupBy("chunk_id").agg(F.round(F.sum(F.col("value")[0]), 5).alias("total"))


@query(f"WITH {M} SELECT greatest(2 * {BLOCK} * 3 * 2 * {SPC} * 8, a * 2 * {SPC} * 8) AS bytes FROM c")
def residency_estimate(spark, d):
    n = axis(spark, d)[1]
    g = Geometry("value", (n,), (SPC,), "<f8")
    return residency(frame(spark, {"x": g, "y": g.shift(AHEAD)}), BLOCK, manifest(n).counts[0], SPC, True)


@query(f"SELECT event_id // {SPC} AS chunk_id, sum(CASE WHEN event_id // {SPC} % 7 = 3 THEN 1 ELSE 0 END)::BIGINT AS n_nan, round(sum(CASE WHEN event_id // {SPC} % 7 = 3 THEN 0 ELSE value END), 6) AS total FROM events GROUP BY 1")
def bad_tile_fill(spark, d):
    """Chunks whose stored bytes are broken are NaN, under the policy that fills; the others stand."""
    url, n = _events_store(spark, d, codec="zstd")
    fs, top = filesystem(url)
    for c in range(3, -(-n // SPC), 7):
        ztensor._put(fs, f"{top}/value/c/{c}", b"\0\1\2\3")
    rows = ztensor.read_samples(spark, url, on_bad_chunk="nan")["value"].select(F.expr(f"sample_index div {SPC}").alias("chunk_id"), arrays.squeezed(F.col("value")).alias("v"))
    return rows.groupBy("chunk_id").agg(F.sum(F.isnan("v").cast("long")).alias("n_nan"), F.round(F.sum(F.when(F.isnan("v"), 0.0).otherwise(F.col("v"))), 6).alias("total"))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) AS INTEGER) AS bad FROM embeddings")
def finite_check(spark, d):
    return read(spark, d, "embeddings").select("vec_id", arrays.not_finite(F.col("embedding")).alias("bad"))


@query("SELECT l_returnflag AS engine, median(l_quantity) AS median, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr FROM lineitem GROUP BY 1")
def report_median_iqr(spark, d):
    return metrics.median_iqr(read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "engine"), ["engine"], "l_quantity")


@query("SELECT engine, max(m) AS best FROM (SELECT l_returnflag engine, l_linenumber, median(l_extendedprice) m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def report_best_tuning(spark, d):
    return metrics.best_of_medians(read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "engine"), ["l_linenumber"], ["engine"], "l_extendedprice")


@query("SELECT engine, round(coalesce(avg(CASE WHEN e > 0 THEN l_quantity END), avg(l_quantity)), 6) AS steady FROM (SELECT l_returnflag engine, l_linenumber - 1 e, l_quantity FROM lineitem) GROUP BY 1")
def steady_mean(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("engine"), (F.col("l_linenumber") - 1).alias("epoch"), "l_quantity")
    return metrics.steady_mean(rows, ["engine"], "epoch", "l_quantity").withColumn("steady", F.round("steady", 6))


@query("""SELECT g.r_name AS region, g.pct FROM (SELECT r.r_name, round(100 * n.total / m.top, 6) pct FROM region r LEFT JOIN (SELECT n_regionkey, sum(s_acctbal) total FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) n ON n.n_regionkey = r.r_regionkey,
(SELECT max(total) top FROM (SELECT n_regionkey, sum(s_acctbal) total FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)) m) g""")
def report_percent_of_ceiling(spark, d):
    """A left join of group totals with their ceiling, as reports do."""
    totals = read(spark, d, "nation").join(read(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.sum("s_acctbal").alias("total"))
    rows = read(spark, d, "region").join(totals, F.col("n_regionkey") == F.col("r_regionkey"), "left").withColumn("geom", F.lit("all"))
    top = totals.agg(F.max("total").alias("top")).withColumn("geom", F.lit("all"))
    return reports.with_ceiling(rows, top, ["geom"], "total", "top").select(F.col("r_name").alias("region"), F.round("pct_of_ceiling", 6).alias("pct"))


@query("SELECT event_type, CAST(floor(event_id / 1000) AS BIGINT) AS part, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_totals(spark, d):
    rows = axis(spark, d)[0].select("event_type", F.expr("event_id div 1000").alias("part"), "value")
    return rows.groupBy("event_type", "part").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT event_type, count(*) AS n_windows, sum(n)::BIGINT AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) w, count(*) n FROM events GROUP BY 1, 2) GROUP BY 1")
def event_windows(spark, d):
    return windowed(axis(spark, d)[0]).groupBy("event_type").agg(F.count("*").alias("n_windows"), F.sum("n").alias("n"))


@query()
def random_noise_pair(spark, d):
    """Seeded noise by sample and place; no SQL engine shares the hash."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("anchor"), "embedding")
    return transforms.batch_noise(rows, "embedding", 0.1, SEED, EPOCH)


@query(f"""WITH {E}, k AS (SELECT DISTINCT vec_id, CAST(('0x' || substr(md5(concat('{SEED}|{EPOCH}|y|', CAST(vec_id AS VARCHAR))), 1, 8)) AS BIGINT) % 5 AS top, CAST(('0x' || substr(md5(concat('{SEED}|{EPOCH}|x|', CAST(vec_id AS VARCHAR))), 1, 8)) AS BIGINT) % 5 AS lft FROM embeddings) SELECT vec_id, CAST((pos // 8 - top) * 4 + pos % 8 - lft AS INTEGER) AS pos, val FROM e JOIN k USING (vec_id) WHERE pos // 8 BETWEEN top AND top + 3 AND pos % 8 BETWEEN lft AND lft + 3""")
def random_crop(spark, d):
    """A part whose corner seed, epoch and sample decide."""
    rows = read(spark, d, "embeddings")
    top, left = (arrays.random_corner(F.col("vec_id"), SEED, EPOCH, SIDE - 4, a) for a in "yx")
    return fields(rows.select("vec_id", arrays.crop(F.col("embedding"), SIDE, SIDE, top, left, 4, 4).alias("embedding")))


@query(f"""WITH {E}, k AS (SELECT DISTINCT vec_id // {BATCH} b, CAST(('0x' || substr(md5(concat('{SEED}|{EPOCH}|y|', CAST(vec_id // {BATCH} AS VARCHAR))), 1, 8)) AS BIGINT) % 5 AS top, CAST(('0x' || substr(md5(concat('{SEED}|{EPOCH}|x|', CAST(vec_id // {BATCH} AS VARCHAR))), 1, 8)) AS BIGINT) % 5 AS lft FROM embeddings) SELECT vec_id, CAST((pos // 8 - top) * 4 + pos % 8 - lft AS INTEGER) AS pos, val FROM e JOIN k ON b = vec_id // {BATCH} WHERE pos // 8 BETWEEN top AND top + 3 AND pos % 8 BETWEEN lft AND lft + 3""")
def random_crop_by_batch(spark, d):
    """The same, with one corner for all samples of a batch."""
    rows = read(spark, d, "embeddings")
    top, left = (arrays.random_corner(F.expr(f"vec_id div {BATCH}"), SEED, EPOCH, SIDE - 4, a) for a in "yx")
    return fields(rows.select("vec_id", arrays.crop(F.col("embedding"), SIDE, SIDE, top, left, 4, 4).alias("embedding")))


@query(f"WITH {E} SELECT vec_id, CAST((pos // 8 - 2) * 4 + pos % 8 - 2 AS INTEGER) AS pos, val FROM e WHERE pos // 8 BETWEEN 2 AND 5 AND pos % 8 BETWEEN 2 AND 5")
def center_crop(spark, d):
    df = read(spark, d, "embeddings")
    return fields(df.select("vec_id", arrays.crop(F.col("embedding"), SIDE, SIDE, F.lit(2), F.lit(2), 4, 4).alias("embedding")))


def _store(spark, d, **how) -> tuple[str, int]:
    """The embeddings as an array of 8 x 8 fields."""
    df, n = axis(spark, d, "embeddings")
    url = fresh_folder(spark, "store")
    ztensor.write_samples(df.select(F.col("vec_id").alias("sample_index"), F.col("embedding").alias("value")), url, "field", n, (SIDE, SIDE), **how)
    return url, n


def _events_store(spark, d, codec: str | None = None, names=("value",), where: str = "true") -> tuple[str, int]:
    """The values of events as arrays of scalars, of the samples that a condition names."""
    df, n = axis(spark, d)
    url = fresh_folder(spark, "store")
    for name in names:
        ztensor.write_samples(df.where(where).select(F.col("event_id").alias("sample_index"), arrays.with_axis(F.col("value")).alias("value")), url, name, n, (), (SPC,), dtype="f8", codec=codec, fill_value=-1)
    return url, n


def _samples(df: DataFrame) -> DataFrame:
    return df.select(F.col("sample_index").alias("vec_id"), F.posexplode("value").alias("pos", "val"))


@query(f"WITH {E} SELECT vec_id, pos, val FROM e")
def ztensor_scan(spark, d):
    """Version 3, zstd, ragged tiles on every axis."""
    return _samples(ztensor.read_samples(spark, _store(spark, d, chunks=(64, 3, 5), codec="zstd")[0])["field"])


@query(f"WITH {E} SELECT vec_id, pos, val FROM e")
def ztensor_scan_v2(spark, d):
    """Version 2, gzip, and the tiles put together by a shuffle instead."""
    url, n = _store(spark, d, chunks=(50, 8, 3), codec="gzip", version=2)
    return _samples(ztensor.assemble(ztensor.read_tiles(spark, url), ztensor.open_geometries(url)["field"]))


@query(f"SELECT event_id AS sample_index, CASE WHEN event_id // {SPC} % 3 = 0 THEN -1 ELSE value END AS value FROM events")
def absent_tile_fill(spark, d):
    url, _ = _events_store(spark, d, where=f"event_id div {SPC} % 3 <> 0")
    return ztensor.read_samples(spark, url)["value"].select("sample_index", arrays.squeezed(F.col("value")).alias("value"))


@query(f"SELECT 'value' AS path, chunk_id AS chunk_index FROM (SELECT DISTINCT event_id // {SPC} chunk_id FROM events) WHERE chunk_id % 7 = 3")
def bad_tile_list(spark, d):
    """The stored tiles that cannot be decoded, as the loader lists them."""
    url, n = _events_store(spark, d, codec="zstd")
    fs, top = filesystem(url)
    for c in range(3, -(-n // SPC), 7):
        ztensor._put(fs, f"{top}/value/c/{c}", b"\0\1\2\3")
    return Dataset.open(spark, url, {"x": "value"}, manifest(n), on_bad_chunk="nan").bad_chunks().select("path", "chunk_index")


@query(f"SELECT event_id AS sample_index, value FROM events WHERE event_id // {SPC} = 3")
def single_chunk(spark, d):
    values, g = read_chunk(_events_store(spark, d, codec="gzip")[0], "value", 3)
    return spark.createDataFrame([(i, float(v)) for i, v in zip(g.samples(3), values)], "sample_index bigint, value double")


@query(f"SELECT spc, CAST(count(*) AS BIGINT) AS n, round(sum(value), 5) AS total FROM events, (SELECT unnest([{SPC}, 1000]) spc) GROUP BY spc")
def samples_by_chunk_size(spark, d):
    """One logical array at several chunk sizes."""
    df, n = axis(spark, d)
    out = None
    for spc in (SPC, 1000):
        url = fresh_folder(spark, "store")
        ztensor.write_samples(df.select(F.col("event_id").alias("sample_index"), arrays.with_axis(F.col("value")).alias("value")), url, "value", n, (), (spc,), dtype="f8", codec="zstd")
        rows = ztensor.read_samples(spark, url)["value"].agg(F.lit(spc).alias("spc"), F.count("*").alias("n"), F.round(F.sum(arrays.squeezed(F.col("value"))), 5).alias("total"))
        out = rows if out is None else out.unionAll(rows)
    return out


@query(f"SELECT event_id // {SPC} AS chunk_index, CAST(800 AS BIGINT) AS length FROM events GROUP BY 1")
def raw_chunk_lengths(spark, d):
    """Stored chunks as they are: without a codec, all have the whole tile's bytes."""
    rows = references.raw_chunks(spark, _events_store(spark, d)[0], "value")
    return rows.select(F.regexp_extract("path", r"/(\d+)$", 1).cast("bigint").alias("chunk_index"), F.col("length").cast("bigint").alias("length"))


@query(f"WITH {E} SELECT vec_id, pos, val FROM e")
def virtual_array(spark, d):
    """An array of chunks of 8 samples whose bytes lie inside the files of one of 64: a reference table says where."""
    url, n = _store(spark, d, chunks=(64, SIDE, SIDE))
    layout = ztensor.Layout("field", ztensor.metadata("field", (n, SIDE, SIDE), (8, SIDE, SIDE), np.dtype("f4"))[1], 3, 0)
    k, size = F.col("id"), 8 * SIDE * SIDE * 4
    refs = spark.range(layout.geometry.n_chunks).select(k.alias("chunk_index"), F.array(F.lit(0), F.lit(0)).alias("inner_coord"), F.concat(F.lit(f"{url}/field/c/"), F.expr("id div 8").cast("string"), F.lit("/0/0")).alias("url"), (k % 8 * size).alias("offset"), F.lit(size).cast("bigint").alias("length"))
    return _samples(ztensor.assemble(references.reference_tiles(refs, layout), layout.geometry))


class RowMeans:
    """A chunk transform with a declared reshape: the mean over the last axis, in doubles."""

    def output_inner(self, geometry):
        return geometry.field[:-1], "<f8"

    def __call__(self, name, x, first):
        return x.astype("f8").mean(-1)


def doubled_field(name, x, first):
    """A chunk transform that acts on one variable alone."""
    return x * 2 if name == "twice" else x


@query(f"WITH {E} SELECT vec_id, CAST(pos // 8 AS INTEGER) AS pos, round(avg(val::DOUBLE), 6) AS val FROM e GROUP BY 1, 2")
def chunk_transform(spark, d):
    """Applied where the chunks are read, without a shuffle."""
    rows = ztensor.read_samples(spark, _store(spark, d, chunks=(64, 3, 5), codec="zstd")[0], transforms=(RowMeans(),))["field"]
    return _samples(rows).withColumn("val", F.round("val", 6))


@query(f"WITH {E} SELECT vec_id, CAST(pos // 8 AS INTEGER) AS pos, round(avg(val::DOUBLE), 6) AS val FROM e GROUP BY 1, 2")
def chunk_transform_of_frame(spark, d):
    """Applied to any frame of samples, by one shuffle."""
    df, n = axis(spark, d, "embeddings")
    rows = df.select(F.col("vec_id").alias("sample_index"), F.col("embedding").alias("value"))
    return _samples(transforms.apply_chunk_transforms(rows, Geometry("field", (n, SIDE, SIDE), (64, SIDE, SIDE)), [RowMeans()])).withColumn("val", F.round("val", 6))


@query("SELECT event_id AS sample_index, value AS once, value * 2 AS twice FROM events")
def name_gated_transform(spark, d):
    url, _ = _events_store(spark, d, names=("once", "twice"))
    found = ztensor.read_samples(spark, url, transforms=(doubled_field,))
    rows = [f.select("sample_index", arrays.squeezed(F.col("value")).alias(k)) for k, f in sorted(found.items())]
    return rows[0].join(rows[1], "sample_index")


@query(f"WITH {T} SELECT dense_rank() OVER (ORDER BY block_id, r // {BATCH}) - 1 AS batch_id, r % {BATCH} AS row_in_batch, anchor, x.value AS x, y.value AS y FROM r JOIN events x ON x.event_id = anchor JOIN events y ON y.event_id = anchor + {AHEAD}")
def loader_batches(spark, d):
    """A store opened as a dataset: batches of the train split, in order, with a label AHEAD steps later."""
    url, n = _events_store(spark, d, codec="zstd")
    scalar = lambda df: df.withColumns({k: arrays.squeezed(F.col(k)) for k in "xy"})
    ds = Dataset.open(spark, url, {"x": "value", "y": ("value", AHEAD)}, manifest(n), batch_size=BATCH, block_chunks=BLOCK, shuffle=False, batch_transforms=(scalar,))
    return ds.train.select("batch_id", "row_in_batch", "anchor", "x", "y")


@query(f"WITH {M}, q AS (SELECT chunk_id, row_number() OVER (ORDER BY md5(concat('7|', CAST(chunk_id AS VARCHAR))), chunk_id) - 1 q FROM m) SELECT CASE WHEN q < a THEN 'train' WHEN q < a + b THEN 'val' ELSE 'test' END AS split, chunk_id FROM q, c")
def manifest_json(spark, d):
    """A split written as lists and read back."""
    url = f"{fresh_folder(spark, 'manifest')}.json"
    manifest(axis(spark, d)[1], contiguous=False, seed=7).to_json(url)
    return Manifest.from_json(url).chunks(spark)


@query(f"WITH {M} SELECT count(*) AS chunks, count(DISTINCT chunk_id) AS covered, CAST(0 AS BIGINT) AS shared FROM m")
def split_leakage(spark, d):
    """How many chunks there are and are covered, and how many more than one split has."""
    rows = manifest(axis(spark, d)[1], contiguous=False, seed=7).chunks(spark).groupBy("chunk_id").agg(F.countDistinct("split").alias("k"))
    return rows.agg(F.sum("k").alias("chunks"), F.count("*").alias("covered"), F.sum((F.col("k") > 1).cast("bigint")).alias("shared"))


@query("""WITH n AS (SELECT count(*) n FROM embeddings), a AS (SELECT 'field' AS label, c, i, j, n FROM n, unnest(range(CAST(ceil(n / 64.0) AS BIGINT))) x(c), unnest(range(3)) y(i), unnest(range(2)) z(j)),
b AS (SELECT 'flat' AS label, c, i, n FROM n, unnest(range(CAST(ceil(n / 30.0) AS BIGINT))) x(c), unnest(range(2)) y(i))
SELECT label, c AS chunk_index, concat('c/', c, '/', i, '/', j) AS key, least(64, n - c * 64) * least(3, 8 - i * 3) * least(5, 8 - j * 5) AS elements FROM a
UNION ALL SELECT label, c, concat('c/', i, '/', c), least(4, 5 - i * 4) * least(30, n - c * 30) FROM b""")
def tile_grid(spark, d):
    """The stored tiles of two arrays, the second sampled on its other axis: keys, and elements that lie inside."""
    n = axis(spark, d, "embeddings")[1]
    found = {"field": Geometry("field", (n, SIDE, SIDE), (64, 3, 5)), "flat": Geometry("flat", (5, n), (4, 30), sample_axis=1)}
    return tile_rows(frame(spark, found)).select("label", "chunk_index", "key", F.aggregate("box", F.lit(1).cast("bigint"), lambda a, k: a * k).alias("elements"))


@query(f"""WITH {P}, u AS (SELECT (anchor + o) // {SPC} k, min(block_id) a, max(block_id) b FROM dr, (SELECT unnest([0, {AHEAD}]) o), (SELECT count(*) n FROM events) WHERE anchor + o < n GROUP BY 1)
SELECT block_id, count(*) AS resident FROM u, (SELECT DISTINCT block_id FROM dr) WHERE block_id BETWEEN a AND b GROUP BY 1""")
def resident_chunks(spark, d):
    """How many stored chunks each block of a shuffled order holds, from first need to last."""
    n = axis(spark, d)[1]
    blocks = ordering.chunk_permutation(manifest(n).chunks(spark), SEED, EPOCH).select("chunk_id", F.expr(f"pos div {BLOCK}").alias("block_id"))
    labels = {str(o): {"path": "value", "spc": SPC, "offset": o} for o in (0, AHEAD)}
    return ordering.residents(ordering.read_order(views.read_plan(blocks, labels, SPC, n), blocks)).where("resident > 0")


@query(f"""WITH {P}, u AS (SELECT (anchor + o) // {SPC} k, min(block_id) a, max(block_id) b FROM dr, (SELECT unnest([0, {AHEAD}]) o), (SELECT count(*) n FROM events) WHERE anchor + o < n GROUP BY 1)
SELECT max(r) AS peak FROM (SELECT block_id, count(*) r FROM u, (SELECT DISTINCT block_id FROM dr) WHERE block_id BETWEEN a AND b GROUP BY 1)""")
def resident_peak(spark, d):
    return resident_chunks(spark, d).agg(F.max("resident").alias("peak"))


@query(f"WITH {E} SELECT CAST(pos // 8 AS INTEGER) AS level, round(avg(val::DOUBLE), 9) AS mean, round(stddev_pop(val::DOUBLE), 9) AS std FROM e GROUP BY 1")
def scaler_per_level(spark, d):
    s = metrics.StandardScaler.fit(read(spark, d, "embeddings"), ["embedding"], {"embedding": SIDE})
    return spark.createDataFrame([(k, m, x) for k, (m, x) in enumerate(zip(s.mean["embedding"], s.std["embedding"]))], "level int, mean double, std double").select("level", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(f"WITH {E}, l AS (SELECT pos // 8 k, avg(val::DOUBLE) m, stddev_pop(val::DOUBLE) s FROM e GROUP BY 1) SELECT vec_id, pos, round(CAST((val::DOUBLE - m) / (s + 1e-8) AS FLOAT)::DOUBLE, 4) AS val FROM e JOIN l ON k = pos // 8")
def scaler_saved(spark, d):
    """Fitted by level, saved, loaded and applied."""
    df, path = read(spark, d, "embeddings"), fresh_folder(spark, "scaler")
    metrics.StandardScaler.fit(df, ["embedding"], {"embedding": SIDE}).save(spark, path)
    return fields(metrics.StandardScaler.load(spark, path).apply(df.select("vec_id", "embedding"))).withColumn("val", F.round(F.col("val").cast("double"), 4))


@query(f"WITH {E} SELECT vec_id, pos, CASE WHEN abs(val) > CAST(0.1 AS FLOAT) THEN 0.0 ELSE greatest(least(val, CAST(0.05 AS FLOAT)), CAST(-0.05 AS FLOAT)) END::FLOAT AS val FROM e")
def scrub_and_clip(spark, d):
    """Values beyond 0.1 are made infinite or NaN, scrubbed to 0, and the rest is clipped."""
    tenth = F.lit(0.1).cast("float")
    broken = F.transform("embedding", lambda v: F.when(v > tenth, F.lit(float("inf")).cast("float")).when(v < -tenth, F.lit(float("nan")).cast("float")).otherwise(v))
    rows = read(spark, d, "embeddings").select("vec_id", F.transform(arrays.clip(arrays.scrub(broken), -0.05, 0.05), lambda v: v.cast("float")).alias("embedding"))
    return fields(rows)


@query(f"WITH {E} SELECT vec_id, CAST(pos % 16 AS INTEGER) AS pos, round(avg(val::DOUBLE), 6) AS val FROM e GROUP BY 1, 2")
def channel_mean(spark, d):
    """The field as four channels of sixteen."""
    return fields(read(spark, d, "embeddings").select("vec_id", arrays.channel_mean(F.col("embedding"), 4, 16).alias("embedding"))).withColumn("val", F.round("val", 6))


@query(f"WITH {E} SELECT a.vec_id, a.pos, round(sum(w * b.val::DOUBLE), 6) AS val FROM e a, (VALUES (0, 0, 0.375), (0, 1, 0.375), (1, 0, 0.125), (1, 1, 0.125)) k(dy, dx, w) JOIN e b ON b.vec_id = a.vec_id AND b.pos = (a.pos // 8 + dy) % 8 * 8 + (a.pos % 8 + dx) % 8 GROUP BY 1, 2")
def bilinear_sample(spark, d):
    """The periodic field a quarter down and half a step right."""
    rows = read(spark, d, "embeddings").select("vec_id", arrays.bilinear(F.col("embedding"), SIDE, SIDE, F.lit(0.25), F.lit(0.5)).alias("embedding"))
    return fields(rows).withColumn("val", F.round("val", 6))


@query(f"WITH {E} SELECT a.vec_id, a.pos, median(b.val) AS val FROM e a, (SELECT unnest([-1, 0, 1]) dy), (SELECT unnest([-1, 0, 1]) dx) JOIN e b ON b.vec_id = a.vec_id AND b.pos = greatest(least(a.pos // 8 + dy, 7), 0) * 8 + greatest(least(a.pos % 8 + dx, 7), 0) GROUP BY 1, 2")
def median_filter(spark, d):
    """As a chunk transform, where the chunks are read."""
    rows = ztensor.read_samples(spark, _store(spark, d, chunks=(64, SIDE, SIDE))[0], transforms=(transforms.median_filter,))["field"]
    return _samples(rows).withColumn("val", F.col("val").cast("double"))


@query("SELECT engine, count(*) AS samples, count(*) / 2.0::DOUBLE AS samples_per_s, count(*) * 8 / 2.0::DOUBLE / 1e6 AS mb_per_s FROM (SELECT l_returnflag engine FROM lineitem) GROUP BY 1")
def throughput_report(spark, d):
    """Rows of measurements appended as JSON lines with a nested config, read back flat, and their rates over two seconds."""
    path = fresh_folder(spark, "rows")
    rows = read(spark, d, "lineitem").select(F.struct(F.col("l_returnflag").alias("engine"), F.col("l_linenumber").alias("geom")).alias("config"), F.col("l_quantity").alias("mb"))
    for part in ("config.geom <= 3", "config.geom > 3"):
        reports.append_rows(rows.where(part), path)
    return reports.throughput(reports.load_rows(spark, path, "config struct<engine: string, geom: int>, mb double"), 2.0, 8, ["engine"])


@query("""WITH g AS (SELECT count(*) n FROM embeddings),
f AS (SELECT c, i, j, least(64, n - 64 * c) s FROM g, (SELECT unnest(range((n + 63) // 64)) c FROM g), (SELECT unnest([0, 1, 2]) i), (SELECT unnest([0, 1]) j)),
t AS (SELECT c, i, least(30, n - 30 * c) s FROM g, (SELECT unnest(range((n + 29) // 30)) c FROM g), (SELECT unnest([0, 1]) i))
SELECT 'field' AS label, concat('c/', c, '/', i, '/', j) AS key, concat(s, ',8,8') AS slot_shape, concat('0,', 3 * i, ',', 5 * j) AS slot_start, concat(s, ',', least(3, 8 - 3 * i), ',', least(5, 8 - 5 * j)) AS slot_size FROM f
UNION ALL SELECT 'flat', concat('c/', i, '/', c), concat(s, ',5'), concat('0,', 4 * i), concat(s, ',', least(4, 5 - 4 * i)) FROM t""")
def tile_placement(spark, d):
    """Where each stored tile of two arrays goes in its chunk, the second sampled on its other axis."""
    n = axis(spark, d, "embeddings")[1]
    found = {"field": Geometry("field", (n, SIDE, SIDE), (64, 3, 5)), "flat": Geometry("flat", (5, n), (4, 30), sample_axis=1)}
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return placed_rows(frame(spark, found)).select("label", "key", *map(text, ("slot_shape", "slot_start", "slot_size")))


@query("""SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS file, sha256(url) AS fingerprint, coalesce(strpos(url, '/') = 0 AND strpos(url, chr(92)) = 0 AND url NOT IN ('', '.', '..'), false) AS is_bare,
coalesce(regexp_extract(url, '[^/]*$') NOT IN ('', '.', '..') AND strpos(regexp_extract(url, '[^/]*$'), chr(92)) = 0, false) AS last_is_bare FROM pages""")
def cache_names(spark, d):
    """File names and fingerprints for the urls of all pages, and which urls, or last parts of them, are names of one folder's own files."""
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", cache.file_name(url).alias("file"), F.sha2(url.cast("binary"), 256).alias("fingerprint"), cache.bare(url).alias("is_bare"), cache.bare(F.substring_index(url, "/", -1)).alias("last_is_bare"))
