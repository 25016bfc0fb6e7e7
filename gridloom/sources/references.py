"""Arrays whose bytes lie inside other files: a reference table says where. Also URI lists and raw reads of stored chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stores import filesystem
from .ztensor import TILES, Layout


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = []
        for url, offset, length in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("url", "offset", "length"))):
            fs, path = filesystem(url)
            with fs.open_input_file(path) as f:
                data.append(f.read_at(length, offset))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=[*b.schema.names, "data"])


def read_ranges(references: DataFrame) -> DataFrame:
    """references (url, offset, length, ...) with data, the bytes that each row points at. Each task opens only its rows' files."""
    return references.mapInArrow(_ranges, T.StructType([*references.schema.fields, T.StructField("data", T.BinaryType())]))


def reference_tiles(references: DataFrame, layout: Layout) -> DataFrame:
    """references (chunk_index, inner_coord, url, offset, length, ...) -> tiles of an array whose stored bytes lie inside other files, for
    ``ztensor.assemble``. Cells without a reference have to be listed with a null url: they are filled."""
    g = layout.geometry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("chunk_index", "inner_coord", "url", "offset", "length"))))
            data = []
            for _, _, url, offset, length in rows:
                raw = None
                if url is not None:
                    fs, path = filesystem(url)
                    with fs.open_input_file(path) as f:
                        raw = f.read_at(length, offset)
                try:
                    data.append(np.ascontiguousarray(np.moveaxis(layout.decode(raw), g.sample_axis, 0)).tobytes())
                except Exception:  # any codec's own error
                    data.append(None)
            cols = [pa.array([g.path] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array(data, pa.binary()), pa.array([d is not None for d in data])]
            yield pa.RecordBatch.from_arrays(cols, ["path", "chunk_index", "inner_coord", "data", "ok"])

    return references.select("chunk_index", "inner_coord", "url", "offset", "length").mapInArrow(run, TILES)


def uri_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of URIs as rows (uri)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("uri"))


def raw_chunks(spark: SparkSession, url: str, variable: str) -> DataFrame:
    """path, length: the stored, still encoded chunks of a variable, read as they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{url.rstrip('/')}/{variable}")
    return files.where(~F.col("path").rlike(r"/(zarr\.json|\.z[a-z]+)$")).select("path", F.length("content").alias("length"))
