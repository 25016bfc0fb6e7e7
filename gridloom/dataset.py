"""The loader: variables of one sample axis, a manifest, and batches of a split as a DataFrame."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ordering
from .operators.cache import ChunkCache
from .operators.transforms import apply_chunk_transforms, identity, output_geometry
from .operators.views import View, anchor_range, gather
from .plans.geometry import Geometry, frame, residency
from .plans.split import Manifest
from .sources import ztensor
from .sources.ztensor import element


class Dataset:
    """Batches of train, val, test or all. Only train is shuffled. set_epoch reseeds the order; nothing else does.

    samples: for each path a frame (sample_index, value). geometries: for each label the array it reads and its offset; labels of one path
    share its samples, which are transformed once and, with cache_dir, stored between runs. ``open`` reads a store instead, and applies the
    transforms where it reads. max_batches: of each split the first batches by number.
    """

    def __init__(
        self, spark: SparkSession, samples: dict[str, DataFrame], geometries: dict[str, Geometry], manifest: Manifest, *, batch_size: int = 32, block_chunks: int = 16, seed: int = 0, shuffle: bool = True,
        chunk_transforms: tuple = (), batch_transforms: tuple[Callable[[DataFrame], DataFrame], ...] = (), persist: bool = False, storage: StorageLevel = StorageLevel.MEMORY_AND_DISK, cache_dir: str | None = None,
        reset_stale_cache: bool = False, max_batches: int | None = None, **ignored,
    ):
        if unknown := set(ignored) - {"max_inflight", "prefetch_depth", "cache_budget_bytes"}:
            raise TypeError(f"unknown arguments {sorted(unknown)}")
        if ignored:
            warnings.warn(f"Spark schedules and caches by itself; {sorted(ignored)} have no effect", stacklevel=2)
        lengths = {g.n_samples for g in geometries.values()}
        if len(lengths) != 1:
            raise ValueError(f"variables differ in sample-axis length: {sorted(lengths)}")
        if lengths != {manifest.n_samples}:
            raise ValueError("the manifest is for another sample-axis length")
        self.spark, self.manifest, self.geometries = spark, manifest, geometries
        self.batch_size, self.block_chunks, self.seed, self.shuffle, self.epoch, self.max_batches = batch_size, block_chunks, seed, shuffle, 0, max_batches
        self.chunk_transforms, self.batch_transforms = list(chunk_transforms), list(batch_transforms)
        self.cache_dir, self.reset_stale = cache_dir, reset_stale_cache
        self.caches: dict[str, ChunkCache] = {}
        self.frames, self._store = {}, None
        for path in {g.path for g in geometries.values()}:
            g = next(g for g in geometries.values() if g.path == path)
            f = self._transformed(path, samples[path], g)
            self.frames[path] = f.persist(storage) if persist else f
        self.views = {label: View(self.frames[g.path], "sample_index", "value", g.offset) for label, g in geometries.items()}

    @classmethod
    def open(cls, spark: SparkSession, url: str, labels: dict[str, str | tuple[str, int]], manifest: Manifest, *, sample_axis: int = 0, on_bad_chunk: str = "raise", chunk_transforms: tuple = (), storage_options: dict | None = None, backend: str = "arrow", chunks_per_task: int = 8, **rest) -> Dataset:
        """labels: for each label a variable of the store, or one with an offset. on_bad_chunk: raise, or nan (see ``bad_chunks``)."""
        reads = {k: (v, 0) if isinstance(v, str) else v for k, v in labels.items()}
        names = sorted({v for v, _ in reads.values()})
        found = ztensor.open_geometries(url, names, sample_axis=sample_axis, options=storage_options, backend=backend)
        how = {"sample_axis": sample_axis, "storage_options": storage_options, "backend": backend, "chunks_per_task": chunks_per_task}
        done = () if rest.get("cache_dir") else tuple(chunk_transforms)  # a cache applies them to what it lacks
        samples = ztensor.read_samples(spark, url, names, on_bad_chunk=on_bad_chunk, transforms=done, **how)
        out = cls(spark, samples, {k: found[v].shift(by) for k, (v, by) in reads.items()}, manifest, chunk_transforms=() if done else chunk_transforms, **rest)
        out._store = url, names, how
        return out

    def bad_chunks(self) -> DataFrame:
        """path, chunk_index, inner_coord of the stored tiles that cannot be decoded, of a dataset that was opened from a store."""
        if not self._store:
            raise ValueError("this dataset was not opened from a store")
        url, names, how = self._store
        return ztensor.bad_tiles(ztensor.read_tiles(self.spark, url, names, **how))

    def _transformed(self, path: str, samples: DataFrame, g: Geometry) -> DataFrame:
        if not self.cache_dir:
            return apply_chunk_transforms(samples, g, self.chunk_transforms)
        out = output_geometry(g, self.chunk_transforms)
        kind = element(out.dtype)[0] if self.chunk_transforms else samples.schema["value"].dataType.elementType.simpleString()
        cache = ChunkCache(self.spark, f"{self.cache_dir.rstrip('/')}/{path}", identity(self.chunk_transforms), f"sample_index bigint, value array<{kind}>", reset_stale=self.reset_stale)
        self.caches[path] = cache
        spc = g.sample_chunk_size

        def compute(miss: DataFrame) -> DataFrame:
            todo = samples.withColumn("chunk_id", F.expr(f"sample_index div {spc}")).join(miss, "chunk_id", "left_semi").drop("chunk_id")
            return apply_chunk_transforms(todo, g, self.chunk_transforms).withColumn("chunk_id", F.expr(f"sample_index div {spc}"))

        out = cache.get(self.spark.range(g.n_chunks).withColumnRenamed("id", "chunk_id"), compute).drop("chunk_id")
        if cache.found and not cache.hits:
            warnings.warn(f"the cache of {path} served none of its chunks", stacklevel=3)
        return out

    def set_epoch(self, epoch: int) -> None:
        self.epoch = epoch

    def order(self, split: str) -> DataFrame:
        m = self.manifest
        chunks = m.chunks(self.spark, split).select("chunk_id")
        within = anchor_range(m.n_samples, self.views)
        if split == "train" and self.shuffle:
            return ordering.block_shuffled_order(chunks, m.sample_chunk_size, m.n_samples, block_chunks=self.block_chunks, seed=self.seed, epoch=self.epoch, anchors=within)
        return ordering.sequential_order(chunks, m.sample_chunk_size, m.n_samples, block_chunks=self.block_chunks, anchors=within)

    def batches(self, split: str) -> DataFrame:
        """batch_id, row_in_batch, draw_pos, anchor, and a column for each label. An empty split gives an empty frame."""
        rows = ordering.first_batches(self.order(split), self.batch_size, self.max_batches)
        out = gather(rows.select("batch_id", "row_in_batch", "draw_pos", "anchor"), self.views)
        for t in self.batch_transforms:
            out = t(out)
        return out

    train, val, test, all = (property(lambda self, s=s: self.batches(s)) for s in ("train", "val", "test", "all"))

    def iterate(self, split: str) -> Iterator[list]:
        """Batches as lists of rows in draw order, a partition ahead of the consumer."""
        held: list = []
        for r in self.batches(split).orderBy("draw_pos").toLocalIterator(prefetchPartitions=True):
            if held and held[0].batch_id != r.batch_id:
                yield held
                held = []
            held.append(r)
        if held:
            yield held

    def working_set_bytes(self) -> int:
        m = self.manifest
        outs = {k: output_geometry(g, self.chunk_transforms) for k, g in self.geometries.items()}
        return residency(frame(self.spark, outs), self.block_chunks, m.counts[0], m.sample_chunk_size, self.shuffle).first().bytes

    def close(self) -> None:
        for f in self.frames.values():
            f.unpersist()
