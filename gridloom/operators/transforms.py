"""Chunk transforms (deterministic, before the shuffle, cacheable) and batch transforms (after the gather, never cached).

A chunk transform is a function of (name, values: n x inner, first sample index); one that changes the inner shape or type has an
``output_inner(geometry) -> (shape, dtype)``. A batch transform maps a DataFrame with batch_id and labels to another.
"""

from __future__ import annotations

import hashlib
import inspect
import pickle
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.geometry import Geometry
from ..sources.ztensor import element, sample_rows

ChunkTransform = Callable[[str, np.ndarray, int], np.ndarray]


def output_geometry(geometry: Geometry, transforms: list[ChunkTransform]) -> Geometry:
    """The geometry after all declared reshapes; the sampled axis never changes."""
    for t in transforms:
        if declared := getattr(t, "output_inner", None):
            inner, dtype = declared(geometry)
            axis = geometry.sample_axis if len(inner) >= geometry.sample_axis else 0
            fit = lambda whole, one: (*whole[:axis], one, *whole[axis:])  # noqa: B023, E731
            geometry = replace(geometry, shape=fit(tuple(inner), geometry.n_samples), chunks=fit(tuple(inner), geometry.sample_chunk_size), dtype=np.dtype(dtype).str, sample_axis=axis)
    return geometry


def checked(values: np.ndarray, geometry: Geometry) -> np.ndarray:
    """Values of the declared shape, in the declared type."""
    if values.shape[1:] != geometry.field:
        raise ValueError(f"{geometry.path}: a transform gave {values.shape[1:]}, declared is {geometry.field}; declare output_inner")
    return values.astype(geometry.dtype)


def apply_chunk_transforms(samples: DataFrame, geometry: Geometry, transforms: list[ChunkTransform]) -> DataFrame:
    """(sample_index, value) of any frame -> the same with every chunk passed through the transforms once, whole. One shuffle by chunk; samples
    of a store need none, as ``ztensor.read_samples`` applies transforms where it reads."""
    if not transforms:
        return samples
    out = output_geometry(geometry, transforms)
    sql, arrow = element(out.dtype)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("sample_index")
        index = group.column("sample_index").to_numpy()
        flat = group.column("value").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        values = flat.astype(geometry.dtype).reshape(len(index), *geometry.field)
        for t in transforms:
            values = t(geometry.path, values, int(index[0]))
        rows = sample_rows(checked(values, out), 0, arrow)
        return pa.table([pa.array(index), rows.column(1)], ["sample_index", "value"])

    dealt = samples.withColumn("chunk", F.expr(f"sample_index div {geometry.sample_chunk_size}"))
    return dealt.groupBy("chunk").applyInArrow(run, f"sample_index bigint, value array<{sql}>")


def identity(transforms: list) -> str:
    """A fingerprint of a pipeline: of each transform its cache_key, or else its pickle and the source of the module that it comes from, as a
    pickle holds only the name of what can be imported."""
    h = hashlib.sha256()
    for t in transforms:
        own = getattr(t, "cache_key", None)
        if isinstance(own, str):
            tokens = [own.encode()]
        else:
            tokens = []
            for token in (lambda: cloudpickle.dumps(t), lambda: inspect.getsource(inspect.getmodule(t if inspect.isroutine(t) else type(t))).encode()):  # noqa: B023
                try:
                    tokens.append(token())
                except (TypeError, OSError, AttributeError, pickle.PicklingError):  # no source, or nothing to pickle
                    tokens.append(b"")
            if not any(tokens):
                raise ValueError(f"{t!r} can be told apart by nothing; give it a cache_key")
        for token in tokens:
            h.update(hashlib.sha256(token).digest())
    return h.hexdigest()


def batch_noise(df: DataFrame, column: str, sigma: float, seed: int, epoch: int, index: str = "anchor") -> DataFrame:
    """Adds <column>_noisy: normal noise from (seed, epoch, sample, place) by Box and Muller, so a retried task draws the same."""
    unit = lambda i, salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(index), i, F.lit(salt)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    noise = lambda v, i: (v.cast("double") + F.sqrt(F.log(unit(i, 1)) * -2) * F.cos(unit(i, 2) * (2 * np.pi)) * sigma).cast("float")
    return df.withColumn(f"{column}_noisy", F.transform(column, noise))


def median_filter(name: str, x: np.ndarray, first: int, size: int = 3) -> np.ndarray:
    """A chunk transform: the median of size x size places, edges repeated."""
    pad = size // 2
    padded = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(pad, pad)] * 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (size, size), (-2, -1)), axis=(-2, -1)).astype(x.dtype)


class Regrid:
    """A chunk transform by sparse weights: rows of (target, source, weight) over the flattened inner field."""

    def __init__(self, target: np.ndarray, source: np.ndarray, weight: np.ndarray, inner: tuple[int, ...]):
        self.target, self.source, self.weight, self.inner = target, source, weight, tuple(inner)

    def output_inner(self, geometry: Geometry) -> tuple[tuple[int, ...], str]:
        return self.inner, geometry.dtype

    def __call__(self, name: str, x: np.ndarray, first: int) -> np.ndarray:
        flat = x.reshape(len(x), -1)[:, self.source] * self.weight
        out = np.zeros((len(x), int(np.prod(self.inner))))
        np.add.at(out, (slice(None), self.target), flat)
        return out.reshape(len(x), *self.inner).astype(x.dtype)
