"""Synthetic arrays for tests and benchmarks. Independent samples are drawn where they lie, from (seed, sample); only a field that each
step carries on is stepped through on the driver, and is meant to be small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import ztensor


def _frame(spark: SparkSession, n: int, make, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                ids = b.column(0).slice(at, 64)
                rows = [make(np.random.default_rng((seed, i)), i).ravel().astype("f4") for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(pa.float32()))], ["sample_index", "value"])

    return spark.range(n).mapInArrow(run, "sample_index long, value array<float>")


def normal_fields(spark: SparkSession, n: int, inner: tuple[int, ...], *, seed: int = 0, mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """Independent N(mean, std) fields."""
    return _frame(spark, n, lambda r, i: r.normal(mean, std, inner), seed)


def star_frames(spark: SparkSession, n: int, size: int, *, stars: int = 20, seed: int = 0) -> DataFrame:
    """Points with a soft edge on a noisy pedestal, and up to five NaN pixels a frame."""
    y, x = np.mgrid[:size, :size]

    def make(r, i):
        frame = 100 + r.normal(0, 3, (size, size))
        for cy, cx, flux in zip(r.uniform(0, size, stars), r.uniform(0, size, stars), r.exponential(200, stars)):
            frame += flux * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 3)
        for _ in range(int(r.integers(0, 6))):
            frame[tuple(r.integers(0, size, 2))] = np.nan
        return frame

    return _frame(spark, n, make, seed)


def cell_planes(spark: SparkSession, n: int, size: int, *, cells: int = 8, seed: int = 0) -> DataFrame:
    """sample_index, value (two channels of blurred cells, one with a smooth haze) and the mask comes of ``cell_mask`` over the same seed."""
    return _frame(spark, n, lambda r, i: _cells(r, size, cells)[0], seed)


def cell_mask(spark: SparkSession, n: int, size: int, *, cells: int = 8, seed: int = 0) -> DataFrame:
    return _frame(spark, n, lambda r, i: _cells(r, size, cells)[1], seed)


def _cells(r: np.random.Generator, size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[:size, :size] / size
    clean = np.zeros((size, size))
    for cy, cx, s in zip(r.uniform(0, 1, cells), r.uniform(0, 1, cells), r.uniform(0.02, 0.06, cells)):
        clean = np.maximum(clean, np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s)))
    haze = 0.6 * np.sin(np.pi * (x + r.uniform())) ** 2
    return np.stack((clean + r.normal(0, 0.05, clean.shape), clean + haze + r.normal(0, 0.05, clean.shape))), clean > 0.5


def bilinear(field: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of a periodic field at fractional places."""
    h, w = field.shape
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    at = lambda dy, dx: field[(y0 + dy) % h, (x0 + dx) % w]
    return (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))


def advected(url: str, steps: int, size: int, *, chunk: int = 48, seed: int = 0, speed: float = 0.6) -> None:
    """Writes t2m (a field carried by a constant wind, forced a little and kept at unit scale), u10 and v10."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size].astype(float)
    wave = lambda: sum(r.normal() * np.cos(2 * np.pi * (k * y + m * x) / size + r.uniform(0, 6.28)) for k in range(3) for m in range(3) if k + m)
    u, v, t = speed * wave(), speed * wave(), wave()
    out = np.empty((steps, size, size), "f4")
    for k in range(steps):
        t = bilinear(t, y - v, x - u) + 0.05 * wave()
        t = (t - t.mean()) / t.std()
        out[k] = t
    for name, values in (("t2m", out), ("u10", np.broadcast_to(u, out.shape).astype("f4")), ("v10", np.broadcast_to(v, out.shape).astype("f4"))):
        ztensor.write_array(url, name, values, (chunk, size, size), codec="zstd")
