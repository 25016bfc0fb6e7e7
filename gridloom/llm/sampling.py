"""Bounded samples of labelled rows for the models that are trained on the driver."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a sample brings to the driver at most, over all labels.
SAMPLE_BYTES = 32 << 20


def fill(totals: dict, most: int) -> dict:
    """What each label may have, so that none has more than it holds and small ones leave their rest to the others."""
    out, left = {}, most
    for k, (label, total) in enumerate(sorted(totals.items(), key=lambda x: (x[1], str(x[0])))):
        out[label] = min(total, left // (len(totals) - k))
        left -= out[label]
    return out


def draw(rows: DataFrame, most: int, label: str | None = None, most_bytes: int = SAMPLE_BYTES) -> list:
    """At most ``most`` rows (doc_id, text, ...) with about ``most_bytes`` bytes of text, the same share of each label.

    Rows are drawn by a hash of id and text, so one id may hold any share of the rows. One pass counts rows and bytes by label and level of
    the hash (an eighth of a power of two, 513 at most), which says what levels fit; nothing is sorted or gathered. A level that does not
    fit, as one that thousands of equal rows share, is passed over. A label of which nothing fits still has one row. Null texts stay out.
    """
    part = F.col(label) if label else F.lit(0)
    share = (F.xxhash64("doc_id", "text").cast("double") + float(1 << 63) + 1) / float(1 << 64)
    rows = rows.where(F.col("text").isNotNull() & part.isNotNull()).withColumns({"_label": part, "_level": F.floor(-8 * F.log2(share)).cast("int"), "_bytes": F.octet_length("text")})
    counted = rows.groupBy("_label", "_level").agg(F.count("*").alias("n"), F.sum("_bytes").alias("b")).collect()  # 513 rows a label at most
    levels = defaultdict(list)
    for r in counted:
        levels[r._label].append((r._level, r.n, r.b))
    many = fill({k: sum(n for _, n, _ in v) for k, v in levels.items()}, most)
    big = fill({k: sum(b for _, _, b in v) for k, v in levels.items()}, most_bytes)
    wanted, single = F.lit(False), []
    for k, v in levels.items():
        n, b, taken = many[k], big[k], []
        for level, own, size in sorted(v, reverse=True):
            if own <= n and size <= b:
                n, b = n - own, b - size
                taken.append(level)
        if taken:
            wanted = wanted | (F.col("_label").eqNullSafe(F.lit(k)) & F.col("_level").isin(taken))
        elif many[k]:
            single.append((k, max(v)[0]))
    out = rows.where(wanted).drop("_level", "_bytes").collect()
    for k, level in single:
        out += rows.where(F.col("_label").eqNullSafe(F.lit(k)) & (F.col("_level") == level)).limit(1).drop("_level", "_bytes").collect()
    return sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text, str(r._label)))
