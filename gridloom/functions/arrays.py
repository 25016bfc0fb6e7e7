"""Column expressions over flattened array payloads; a field of shape (rows, cols) is an array in row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_celsius(x) -> Column:
    return F.transform(x, lambda v: (v.cast("double") - 273.15).cast("float"))


def standardise(x, mean: float, std: float, eps: float = 1e-8) -> Column:
    return F.transform(x, lambda v: ((v.cast("double") - mean) / (std + eps)).cast("float"))


def wind_speed(u, v) -> Column:
    return F.zip_with(u, v, lambda a, b: F.sqrt(a.cast("double") * a.cast("double") + b.cast("double") * b.cast("double")))


def binarise(x) -> Column:
    return F.transform(x, lambda v: F.when(v > 0, 1.0).otherwise(0.0).cast("float"))


def scrub(x) -> Column:
    """Non-finite values become 0."""
    return F.transform(x, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def clip(x, lo: float, hi: float) -> Column:
    return F.transform(x, lambda v: F.greatest(F.least(v, F.lit(hi)), F.lit(lo)))


def not_finite(x) -> Column:
    return F.size(F.filter(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))


def squeezed(x) -> Column:
    """A field of one element as that element."""
    return F.element_at(x, 1)


def with_axis(x) -> Column:
    """A scalar as a field of one element; a flat field has the same elements with a singleton axis as without."""
    return F.array(x)


def channel_mean(x, channels: int, size: int) -> Column:
    """The mean over the leading axis of (channels, size)."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(channels - 1)), F.lit(0.0), lambda s, c: s + F.element_at(x, c * size + i + 1).cast("double")) / channels)


def bilinear(x, rows: int, cols: int, dy, dx) -> Column:
    """The periodic field at each place moved by (dy, dx)."""

    def at(k):
        y, z = F.floor(k / cols) + dy, k % cols + dx
        y0, x0 = F.floor(y), F.floor(z)
        fy, fx = y - y0, z - x0
        v = lambda a, b: F.element_at(x, (F.pmod(y0 + a, F.lit(rows)) * cols + F.pmod(x0 + b, F.lit(cols)) + 1).cast("int")).cast("double")
        return (1 - fy) * ((1 - fx) * v(0, 0) + fx * v(0, 1)) + fy * ((1 - fx) * v(1, 0) + fx * v(1, 1))

    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), at)


def median_3x3(x, rows: int, cols: int) -> Column:
    """The median of each place and its eight neighbours, edges repeated."""

    def at(k):
        near = []
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                y = F.greatest(F.least(F.floor(k / cols) + dy, F.lit(rows - 1)), F.lit(0))
                z = F.greatest(F.least(k % cols + dx, F.lit(cols - 1)), F.lit(0))
                near.append(F.element_at(x, (y * cols + z + 1).cast("int")))
        return F.element_at(F.array_sort(F.array(*near)), 5)

    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), at)


def middle(x) -> Column:
    """The median of an array of doubles."""
    s, n = F.array_sort(x), F.size(x)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def row_means(x, rows: int, cols: int) -> Column:
    """Means over the last axis."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.aggregate(F.slice(x, r * cols + 1, cols), F.lit(0.0), lambda s, v: s + v.cast("double")) / cols)


def coarsened(x, rows: int, cols: int, by: int, kind: str = "double") -> Column:
    """Means of by x by cells, taken in doubles and given in the type asked for (the input's, to keep it); ragged edges are cut off."""
    high, wide = rows // by, cols // by

    def cell(k):
        top, left = F.floor(k / wide).cast("int") * by, (k % wide) * by
        total = F.aggregate(F.sequence(F.lit(0), F.lit(by - 1)), F.lit(0.0), lambda s, d: s + F.aggregate(F.slice(x, (top + d) * cols + left + 1, by), F.lit(0.0), lambda t, v: t + v.cast("double")))
        return (total / (by * by)).cast(kind)

    return F.transform(F.sequence(F.lit(0), F.lit(high * wide - 1)), cell)


def crop(x, rows: int, cols: int, top, left, high: int, wide: int) -> Column:
    """A high x wide part whose corner may differ by row."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(high - 1)), lambda r: F.slice(x, (top + r) * cols + left + 1, wide)))


def random_corner(index, seed: int, epoch: int, room: int, axis: str) -> Column:
    """A corner from seed, epoch and sample alone, so a retried task draws the same."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.lit(epoch), F.lit(axis), index.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(room + 1)).cast("int")
