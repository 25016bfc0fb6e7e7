"""Splits of the sample axis by whole chunks, so that no chunk leaks between train, val and test.

A manifest says which chunks each split has, as lists (which any tool can write) or as a rule (which needs no list, whatever the number of
chunks). Both have the same JSON form, which holds the lists.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import Grid
from .ranks import ranked_by_hash

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class Manifest:
    """``counts`` chunks of each split. Without lists: chunks from ``first`` on, in order or permuted by the seed, go to train, then val, then test."""

    n_samples: int
    sample_chunk_size: int
    counts: tuple[int, int, int]
    first: int = 0
    contiguous: bool = True
    seed: int = 0
    lists: dict[str, tuple[int, ...]] | None = field(default=None, hash=False)

    @property
    def n_chunks(self) -> int:
        return Grid((self.n_samples,), (self.sample_chunk_size,)).counts[0]

    def listed(self) -> dict[str, list[int]]:
        """The chunk ids of each split, in draw order of the split."""
        if self.lists is not None:
            return {s: list(self.lists.get(s, ())) for s in SPLITS}
        ids = list(range(self.first, self.first + sum(self.counts)))
        if not self.contiguous:
            ids.sort(key=lambda c: (hashlib.md5(f"{self.seed}|{c}".encode()).hexdigest(), c))
        ends = [0, self.counts[0], self.counts[0] + self.counts[1], len(ids)]
        return {s: ids[a:b] for s, a, b in zip(SPLITS, ends, ends[1:])}

    def to_json(self, url: str) -> None:
        from ..sources.stores import filesystem

        fs, path = filesystem(url)
        body = {"n_chunks": self.n_chunks, "sample_chunk_size": self.sample_chunk_size, "n_samples": self.n_samples, "chunks": self.listed(), "seed": self.seed}
        with fs.open_output_stream(path) as f:
            f.write(json.dumps(body).encode())

    @classmethod
    def from_json(cls, url: str) -> Manifest:
        from ..sources.stores import filesystem

        fs, path = filesystem(url)
        with fs.open_input_stream(path) as f:
            body = json.loads(f.read())
        lists = {s: tuple(body["chunks"].get(s, ())) for s in SPLITS}
        out = cls(body["n_samples"], body["sample_chunk_size"], tuple(len(lists[s]) for s in SPLITS), seed=body.get("seed") or 0, lists=lists)
        every = [c for s in SPLITS for c in lists[s]]
        if out.n_chunks != body["n_chunks"] or len(set(every)) != len(every) or any(c not in range(out.n_chunks) for c in every):
            raise ValueError(f"{url}: the chunks do not split {out.n_chunks} chunks")
        return out

    def chunks(self, spark: SparkSession, split: str | None = None) -> DataFrame:
        """(split, chunk_id); all three splits, or one. A rule is an expression over a range (a seeded one ranks hashes of ids, in parts)."""
        if split not in (None, "all", *SPLITS):
            raise ValueError(f"no split {split!r}")
        if self.lists is not None:
            rows = [(s, c) for s in SPLITS for c in self.lists.get(s, ())]
            out = spark.createDataFrame(pa.table({"split": pa.array([s for s, _ in rows], pa.string()), "chunk_id": pa.array([c for _, c in rows], pa.int64())}))
        else:
            ids = spark.range(self.first, self.first + sum(self.counts)).withColumnRenamed("id", "chunk_id")
            placed = ids.withColumn("place", F.col("chunk_id") - self.first) if self.contiguous else ranked_by_hash(ids, "chunk_id", F.md5(F.concat_ws("|", F.lit(self.seed), F.col("chunk_id"))), "place")
            train, val, _ = self.counts
            out = placed.select(F.when(F.col("place") < train, "train").when(F.col("place") < train + val, "val").otherwise("test").alias("split"), "chunk_id")
        return out if split in (None, "all") else out.where(F.col("split") == split)

    def sample_indices(self, spark: SparkSession, split: str | None = None) -> DataFrame:
        """(split, chunk_id, sample_index): chunks expanded where they are, without a join."""
        spc = self.sample_chunk_size
        samples = F.explode(F.sequence(F.col("chunk_id") * spc, F.least((F.col("chunk_id") + 1) * spc, F.lit(self.n_samples)) - 1))
        return self.chunks(spark, split).select("split", "chunk_id", samples.alias("sample_index"))


def shares(n: int, fractions: tuple[float, ...]) -> list[int]:
    """n dealt by fractions: each share rounds half to even and takes no more than is left; the last one is what is left."""
    out: list[int] = []
    for f in fractions[:-1]:
        out.append(min(round(f * n), n - sum(out)))
    return [*out, n - sum(out)]


def split_by_chunk(n_samples: int, sample_chunk_size: int, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1), *, contiguous: bool = True, seed: int = 0, sample_range: tuple[int, int] | None = None) -> Manifest:
    """A manifest by fractions of the chunks that a range of samples (all by default) touches."""
    picked = range(n_samples) if sample_range is None else range(*sample_range)
    problem = None
    if abs(1 - sum(fractions)) > 1e-6:
        problem = f"fractions {fractions} do not sum to 1"
    elif sample_range is not None and not (picked and picked[0] >= 0 and picked[-1] < n_samples):
        problem = f"sample_range {sample_range} is empty or beyond {n_samples} samples"
    if problem:
        raise ValueError(problem)
    touched = range(picked[0] // sample_chunk_size, picked[-1] // sample_chunk_size + 1) if picked else range(0)
    return Manifest(n_samples, sample_chunk_size, tuple(shares(len(touched), fractions)), touched.start, contiguous, seed)
