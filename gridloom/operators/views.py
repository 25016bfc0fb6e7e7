"""Labels over variables, and the gather: an equi-join of every label with the anchors."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.geometry import valid_anchors


@dataclass(frozen=True)
class View:
    """A label: a frame with a dense sample index and a payload column, read at anchor + offset. Several labels may share a frame."""

    frame: DataFrame
    index: str
    payload: str
    offset: int = 0

    def shift(self, by: int) -> View:
        return replace(self, offset=self.offset + by)


def anchor_range(n: int, views: dict[str, View]) -> tuple[int, int]:
    return valid_anchors(n, [v.offset for v in views.values()])


def gather(anchors: DataFrame, views: dict[str, View], how: str = "inner") -> DataFrame:
    """anchors (anchor, ...) with a column for each label. The joins are plain equi-joins on a shifted key: any split of rows will do, and
    a frame that several labels share is scanned with its two columns only."""
    out = anchors
    for label, v in views.items():
        side = v.frame.select((F.col(v.index) - v.offset).alias("anchor"), F.col(v.payload).alias(label))
        out = out.join(side, "anchor", how)
    return out


def read_indices(anchors: DataFrame, views: dict[str, View]) -> DataFrame:
    """(anchor, label, read_index): which row of its variable each label reads. An unknown label reads the anchor's own."""
    labels = F.array(*(F.struct(F.lit(k).alias("label"), (F.col("anchor") + v.offset).alias("read_index")) for k, v in sorted(views.items())))
    return anchors.select(*anchors.columns, F.explode(labels).alias("r")).select(*anchors.columns, "r.label", "r.read_index")


def stacked(gathered: DataFrame, labels: list[str], name: str = "stack") -> DataFrame:
    """Labels as one array column, in the order given."""
    return gathered.withColumn(name, F.array(*labels))


def read_plan(anchor_chunks: DataFrame, arrays: dict[str, dict], reference: int, n: int) -> DataFrame:
    """Distinct stored chunks that the anchors of some chunks need: (path, chunk_index). arrays: label -> path, spc, offset.

    The chunk-to-chunk range is arithmetic (an exploded sequence), so it needs no theta join; labels of one path share their reads.
    """
    parts = []
    for a in arrays.values():
        last = F.least((F.col("chunk_id") + 1) * reference, F.lit(n)) - 1 + a["offset"]
        lo, hi = F.greatest(F.col("chunk_id") * reference + a["offset"], F.lit(0)), F.least(last, F.lit(n - 1))
        rows = anchor_chunks.select("chunk_id", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
        parts.append(rows.select("chunk_id", F.lit(a["path"]).alias("path"), F.explode(F.sequence(F.expr(f"lo div {a['spc']}"), F.expr(f"hi div {a['spc']}"))).alias("chunk_index")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
