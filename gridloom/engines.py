"""Ways to read the same shuffled samples, measured side by side, and probes of a store.

python -m gridloom.engines URL --variable NAME --out ROWS [--engine E ...] [--epochs N] runs engines over a store, appends a row a pass to ROWS (JSON
lines) and prints the report. Engines: ``dataset`` (the loader), ``cached`` (the loader, persisted), ``naive`` (each sample reads and decodes its
whole chunk, one after the other), ``workers`` (the same, a task a group of samples), ``memory`` (the array held by the driver: the ceiling).
"""

from __future__ import annotations

import argparse
import os
import resource
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import Dataset
from .functions import metrics, reports
from .plans.split import split_by_chunk
from .sources import ztensor
from .sources.stores import filesystem, read_whole

ROW = "config struct<engine: string, spc: bigint, batch_size: int>, epoch int, seconds double, samples_per_s double, mb_per_s double, peak_rss_mb double"


def _whole(url: str, variable: str, chunk: int) -> np.ndarray:
    layout = ztensor.layouts(url, [variable])[variable]
    fs, top = filesystem(url)
    return ztensor.whole_chunk(layout, chunk, lambda key: read_whole(fs, f"{top}/{variable}/{key}"))


def _order(n: int, epoch: int) -> np.ndarray:
    return np.random.default_rng(epoch).permutation(n)


def naive(spark: SparkSession, url: str, variable: str, epoch: int, batch_size: int) -> int:
    g = ztensor.open_geometries(url, [variable])[variable]
    rows = 0
    for i in _order(g.n_samples, epoch).tolist():
        chunk = i // g.sample_chunk_size
        rows += _whole(url, variable, chunk)[i - g.samples(chunk).start].size > 0
    return rows


def workers(spark: SparkSession, url: str, variable: str, epoch: int, batch_size: int) -> int:
    g = ztensor.open_geometries(url, [variable])[variable]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                chunk = i // g.sample_chunk_size
                values = _whole(url, variable, chunk)[i - g.samples(chunk).start]
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([values.ravel()], pa.list_(pa.from_numpy_dtype(values.dtype)))], ["sample_index", "value"])

    ztensor.register(spark)
    order = spark.range(g.n_samples).orderBy(F.xxhash64(F.lit(epoch), "id"))
    rows = order.mapInArrow(run, f"sample_index bigint, value array<{ztensor.element(g.dtype)[0]}>")
    return rows.agg(F.count("value")).first()[0]


def memory(spark: SparkSession, url: str, variable: str, epoch: int, batch_size: int, held: dict = {}) -> int:  # noqa: B006
    g = ztensor.open_geometries(url, [variable])[variable]
    if (url, variable) not in held:
        held[url, variable] = np.concatenate([_whole(url, variable, c) for c in range(g.n_chunks)])
    x, rows = held[url, variable], 0
    order = _order(g.n_samples, epoch)
    for at in range(0, len(order), batch_size):
        rows += len(x[order[at : at + batch_size]])
    return rows


def _loader(persist: bool) -> Callable:
    made: dict = {}

    def run(spark: SparkSession, url: str, variable: str, epoch: int, batch_size: int) -> int:
        if (spark.sparkContext.applicationId, url, variable) not in made:
            g = ztensor.open_geometries(url, [variable])[variable]
            manifest = split_by_chunk(g.n_samples, g.sample_chunk_size, (1.0, 0.0, 0.0))
            made[spark.sparkContext.applicationId, url, variable] = Dataset.open(spark, url, {"x": variable}, manifest, batch_size=batch_size, persist=persist)
        ds = made[spark.sparkContext.applicationId, url, variable]
        ds.set_epoch(epoch)
        return ds.train.agg(F.count("x")).first()[0]

    return run


ENGINES: dict[str, Callable] = {"dataset": _loader(False), "cached": _loader(True), "naive": naive, "workers": workers, "memory": memory}


def peak_rss_mb() -> float:
    """The most memory that this process and its ended children have held, and that its living ones (the JVM) hold now."""
    most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss + resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    by_parent: dict[int, list[int]] = {}
    for p in filter(str.isdigit, os.listdir("/proc") if os.path.isdir("/proc") else ()):
        try:
            with open(f"/proc/{p}/stat") as f:
                by_parent.setdefault(int(f.read().rsplit(")", 1)[1].split()[1]), []).append(int(p))
        except OSError:  # it has ended
            continue
    queue, living = list(by_parent.get(os.getpid(), ())), 0
    while queue:
        p = queue.pop()
        queue += by_parent.get(p, ())
        try:
            with open(f"/proc/{p}/status") as f:
                living += next((int(x.split()[1]) for x in f if x.startswith("VmHWM")), 0)
        except OSError:
            continue
    return (most + living) / 1024


def measure(spark: SparkSession, engine: str, url: str, variable: str, *, epochs: int = 2, batch_size: int = 32) -> DataFrame:
    """A row a pass. Every engine must return every sample."""
    g = ztensor.open_geometries(url, [variable])[variable]
    rows, size = [], g.chunk_bytes / g.sample_chunk_size / 1e6
    for epoch in range(epochs):
        began = time.perf_counter()
        n = ENGINES[engine](spark, url, variable, epoch, batch_size)
        took = time.perf_counter() - began
        if n != g.n_samples:
            raise ValueError(f"{engine} gave {n} of {g.n_samples} samples")
        rows.append(((engine, g.sample_chunk_size, batch_size), epoch, took, n / took, n * size / took, peak_rss_mb()))
    return spark.createDataFrame(rows, ROW)


def report(spark: SparkSession, path: str) -> DataFrame:
    """For each engine and chunk size the median and spread of the passes, the mean without the first, and the share of the ceiling in memory."""
    rows = reports.load_rows(spark, path, ROW)
    keys = ["engine", "spc"]
    best = metrics.best_of_medians(rows.where("engine = 'memory'"), ["batch_size"], ["spc"], "mb_per_s").withColumnRenamed("best", "ceiling")
    steady = metrics.steady_mean(rows, keys, "epoch", "mb_per_s")
    return reports.with_ceiling(metrics.median_iqr(rows, keys, "mb_per_s").join(steady, keys), best, ["spc"], "median", "ceiling").orderBy("spc", "engine")


def probe_decode(url: str, variable: str) -> dict[str, float]:
    """MB a second of reading a variable's stored chunks as they are, and of reading and decoding them, one after the other."""
    layout = ztensor.layouts(url, [variable])[variable]
    g = layout.geometry
    fs, top = filesystem(url)
    cells = [cell for c in range(g.n_chunks) for cell in g.tiles(c)]
    began = time.perf_counter()
    stored = sum(len(read_whole(fs, f"{top}/{variable}/{layout.key(cell)}") or b"") for cell in cells)
    raw = time.perf_counter() - began
    began = time.perf_counter()
    decoded = sum(layout.decode(read_whole(fs, f"{top}/{variable}/{layout.key(cell)}")).nbytes for cell in cells)
    both = time.perf_counter() - began
    return {"raw_mb_per_s": stored / raw / 1e6, "decoded_mb_per_s": decoded / both / 1e6, "stored_share": stored / max(decoded, 1)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="engines")
    p.add_argument("url")
    p.add_argument("--variable", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--engine", action="append", choices=sorted(ENGINES))
    p.add_argument("--epochs", type=int, default=2)
    p.add_argument("--batch-size", type=int, default=32)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    for engine in a.engine or sorted(ENGINES):
        reports.append_rows(measure(spark, engine, a.url, a.variable, epochs=a.epochs, batch_size=a.batch_size), a.out)
    print(reports.as_table(report(spark, a.out)))
    print(probe_decode(a.url, a.variable))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
