"""``spark.read.format("ztensor")``: chunked array groups (Zarr v2 and v3), through any file system that pyarrow or fsspec opens.

Options: ``path`` (a URL), ``variables`` (comma-joined; all arrays by default), ``sample_axis`` (0), ``chunks_per_task`` (8), ``backend``
(arrow, fsspec), ``storage_options`` (JSON, see ``stores``).

Rows are tiles: path, chunk_index, inner_coord, data (raw little-endian elements of the whole tile, samples first), ok. A tile that is absent
is its fill value; one that cannot be decoded has ok false and no data. With ``emit`` = samples (of one variable), rows are sample_index and
value: a task puts its chunks together itself, passes them through the chunk transforms (``transforms``, pickled) and emits their samples, so
nothing is shuffled. ``on_bad_chunk`` then says whether a bad tile raises or is filled. With ``prune`` true, which needs
``spark.sql.python.filterPushdown.enabled``, filters on path and chunk_index prune tiles before they are read.
"""

from __future__ import annotations

import base64
import gzip
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..plans.geometry import Geometry
from .codecs import Chain
from .shared import ship
from .stores import filesystem, read_whole

TILES = "path string, chunk_index bigint, inner_coord array<int>, data binary, ok boolean"
_KIND = {"f": lambda n: ("float", pa.float32()) if n <= 4 else ("double", pa.float64()), "b": lambda n: ("boolean", pa.bool_()), "i": lambda n: ("int", pa.int32()) if n <= 4 else ("bigint", pa.int64()), "u": lambda n: ("int", pa.int32()) if n < 4 else ("bigint", pa.int64())}


def element(dtype: str) -> tuple[str, pa.DataType]:
    """The SQL and Arrow types that hold a stored type: the next wider signed one of unsigned integers, float of halves."""
    k = np.dtype(dtype)
    return _KIND[k.kind](k.itemsize)


class Layout:
    """What the store's metadata says of one array: geometry, key encoding, codecs and fill value."""

    def __init__(self, name: str, meta: dict, version: int, sample_axis: int):
        if version == 3:
            if meta.get("node_type") != "array":
                raise TypeError(f"{name} is a group, not an array")
            chunks, dtype = meta["chunk_grid"]["configuration"]["chunk_shape"], np.dtype(meta["data_type"])
            codecs = [(c["name"], c.get("configuration", {})) for c in meta["codecs"]]
            endian = next((c.get("endian", "little") for n, c in codecs if n == "bytes"), "little")
            stored, order = dtype.newbyteorder("<" if endian == "little" else ">"), "C"
            encoding = meta.get("chunk_key_encoding", {"name": "default"})
            self.prefix = "c/" if encoding["name"] == "default" else ""
            self.separator = encoding.get("configuration", {}).get("separator", "/" if self.prefix else ".")
        else:
            chunks, stored, order = meta["chunks"], np.dtype(meta["dtype"]), meta.get("order", "C")
            codecs = [(c["id"], c) for c in [*(meta.get("filters") or ()), *([meta["compressor"]] if meta.get("compressor") else ())]]
            self.prefix, self.separator = "", meta.get("dimension_separator", ".")
        fill = meta.get("fill_value")
        self.fill = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf, None: 0}.get(fill, fill) if not isinstance(fill, list) else 0
        try:
            self.chain = Chain(codecs, stored, order, self.fill)
        except ValueError as e:
            raise ValueError(f"{name}: {e}") from e
        self.geometry = Geometry(name, tuple(meta["shape"]), tuple(chunks), stored.newbyteorder("<").str, 0, sample_axis)

    def key(self, cell: tuple[int, ...]) -> str:
        if not cell:
            return "c" if self.prefix else "0"
        return self.prefix + self.separator.join(map(str, cell))

    def decode(self, raw: bytes | None) -> np.ndarray:
        """A tile in stored order; an absent one is filled."""
        g = self.geometry
        return np.full(g.chunks, self.fill, g.dtype) if raw is None else self.chain.decode(raw, g.chunks).astype(g.dtype)

    def filler(self):
        """What stands in for a tile that cannot be decoded: NaN, or for other than floats the fill value."""
        return np.nan if np.dtype(self.geometry.dtype).kind == "f" else self.fill


def layouts(url: str, variables: list[str] | None = None, sample_axis: int = 0, options: dict | str | None = None, backend: str = "arrow") -> dict[str, Layout]:
    fs, top = filesystem(url, options, backend)
    if variables is None:
        names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(top)) if i.type == pafs.FileType.Directory]
        names = sorted(n for n in names if _meta(fs, f"{top}/{n}", strict=False))
    else:
        names = variables
    out = {}
    for n in names:
        found = _meta(fs, f"{top}/{n}", strict=True)
        if found is None:
            raise KeyError(n)
        out[n] = Layout(n, *found, sample_axis)
    lengths = {g.geometry.n_samples for g in out.values()}
    if len(lengths) > 1:
        raise ValueError(f"variables differ in sample-axis length: {sorted(lengths)}")
    return out


def _meta(fs: pafs.FileSystem, path: str, strict: bool) -> tuple[dict, int] | None:
    if raw := read_whole(fs, f"{path}/zarr.json"):
        meta = json.loads(raw)
        return (meta, 3) if strict or meta.get("node_type") == "array" else None
    if raw := read_whole(fs, f"{path}/.zarray"):
        return json.loads(raw), 2
    if strict and read_whole(fs, f"{path}/.zgroup"):
        raise TypeError(f"{path} is a group, not an array")
    return None


def open_geometries(url: str, variables: list[str] | None = None, *, sample_axis: int = 0, options: dict | str | None = None, backend: str = "arrow") -> dict[str, Geometry]:
    return {n: x.geometry for n, x in layouts(url, variables, sample_axis, options, backend).items()}


def ready(url: str, expected: dict[str, Geometry]) -> bool:
    """Whether a store already holds these arrays, with these shapes, chunks and types."""
    try:
        found = open_geometries(url, list(expected))
    except (KeyError, TypeError, ValueError, OSError):
        return False
    same = lambda a, b: (a.shape, a.chunks, np.dtype(a.dtype)) == (b.shape, b.chunks, np.dtype(b.dtype))
    return all(same(found[n], g) for n, g in expected.items())


class _Tiles(InputPartition):
    def __init__(self, name: str, chunks: list[int]):
        super().__init__(0)
        self.name, self.chunks = name, chunks


def whole_chunk(layout: Layout, chunk: int, read, on_bad_chunk: str = "raise") -> np.ndarray:
    """A chunk, samples first, from read(key), the stored bytes of a tile or None."""
    g = layout.geometry
    out = np.empty((len(g.samples(chunk)), *g.field), g.dtype)
    for cell in g.tiles(chunk):
        raw = read(layout.key(cell))
        try:
            tile = layout.decode(raw)
        except Exception as e:  # any codec's own error
            if on_bad_chunk == "raise":
                raise ValueError(f"{g.path}: tile {cell} of chunk {chunk} cannot be decoded") from e
            tile = np.full(g.chunks, layout.filler(), g.dtype)
        g.scatter(cell, tile, out)
    return out


def sample_rows(values: np.ndarray, first: int, arrow: pa.DataType) -> pa.RecordBatch:
    flat = np.ascontiguousarray(values).reshape(len(values), -1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, max(1, flat.shape[1]), dtype=np.int32)), pa.array(flat.ravel(), from_pandas=False).cast(arrow))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(flat)), pa.int64()), lists], ["sample_index", "value"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict, found: dict[str, Layout]):
        self.url, self.found, self.per_task = options["path"], found, int(options.get("chunks_per_task", 8))
        self.store = options.get("storage_options"), options.get("backend", "arrow")
        self.samples, self.on_bad = options.get("emit") == "samples", options.get("on_bad_chunk", "raise")
        self.transforms = options.get("transforms")
        self.paths, self.lo, self.hi = set(found), 0, None

    def partitions(self):
        out = []
        for name in sorted(self.paths):
            n = self.found[name].geometry.n_chunks
            every = list(range(self.lo, n if self.hi is None else min(n, self.hi + 1)))
            out += [_Tiles(name, every[a : a + self.per_task]) for a in range(0, len(every), self.per_task)]
        return out or [_Tiles("", [])]

    def read(self, part: _Tiles) -> Iterator[pa.RecordBatch]:
        if not part.chunks:
            return
        fs, top = filesystem(self.url, *self.store)
        layout = self.found[part.name]
        get = lambda key: read_whole(fs, f"{top}/{part.name}/{key}")
        yield from self._chunks(layout, part.chunks, get) if self.samples else self._tiles(layout, part.chunks, get)

    def _chunks(self, layout: Layout, chunks: list[int], get) -> Iterator[pa.RecordBatch]:
        from ..operators.transforms import checked, output_geometry

        g = layout.geometry
        steps = cloudpickle.loads(base64.b64decode(self.transforms)) if self.transforms else []
        out = output_geometry(g, steps)
        for c in chunks:
            values = whole_chunk(layout, c, get, self.on_bad)
            for t in steps:
                values = t(g.path, values, g.samples(c).start)
            yield sample_rows(checked(values, out) if steps else values, g.samples(c).start, element(out.dtype)[1])

    def _tiles(self, layout: Layout, chunks: list[int], get) -> Iterator[pa.RecordBatch]:
        g = layout.geometry
        for c in chunks:
            rows = []
            for cell in g.tiles(c):
                raw = get(layout.key(cell))
                try:
                    data, ok = np.ascontiguousarray(np.moveaxis(layout.decode(raw), g.sample_axis, 0)).tobytes(), True
                except Exception:  # any codec's own error
                    data, ok = None, False
                rows.append((np.delete(cell, g.sample_axis).tolist(), data, ok))
            n = len(rows)
            cols = [pa.array([g.path] * n), pa.array([c] * n, pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows])]
            yield pa.RecordBatch.from_arrays(cols, ["path", "chunk_index", "inner_coord", "data", "ok"])


class _PruningReader(_Reader):
    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("path",) and isinstance(f, (EqualTo, In)):
                self.paths &= set([f.value] if isinstance(f, EqualTo) else f.value)
            elif name == ("chunk_index",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = f.value - isinstance(f, LessThan)
                    self.hi = top if self.hi is None else min(self.hi, top)
            yield f  # Spark checks every filter again


class ZTensor(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ztensor"

    def _found(self) -> dict[str, Layout]:
        o = self.options
        names = o.get("variables")
        return layouts(o["path"], names.split(",") if names else None, int(o.get("sample_axis", 0)), o.get("storage_options"), o.get("backend", "arrow"))

    def schema(self) -> str:
        if self.options.get("emit") != "samples":
            return TILES
        found = self._found()
        if len(found) != 1:
            raise ValueError(f"samples are of one variable, not {sorted(found)}")
        from ..operators.transforms import output_geometry

        steps = self.options.get("transforms")
        out = output_geometry(next(iter(found.values())).geometry, cloudpickle.loads(base64.b64decode(steps)) if steps else [])
        return f"sample_index bigint, value array<{element(out.dtype)[0]}>"

    def reader(self, schema) -> _Reader:
        kind = _PruningReader if self.options.get("prune") == "true" else _Reader
        return kind(dict(self.options), self._found())


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ZTensor)


def _opened(spark: SparkSession, url: str, variables: list[str] | None, options: dict) -> DataFrame:
    register(spark)
    names = {"variables": ",".join(variables)} if variables else {}
    as_text = {k: json.dumps(v) if isinstance(v, dict) else str(v) for k, v in options.items() if v is not None}
    return spark.read.format("ztensor").options(path=url, **names, **as_text).load()


def read_tiles(spark: SparkSession, url: str, variables: list[str] | None = None, *, sample_axis: int = 0, **options) -> DataFrame:
    """Stored tiles. options: those of the source, storage_options as a dict among them."""
    prune = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    return _opened(spark, url, variables, {"sample_axis": sample_axis, "prune": prune, **options})


def bad_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.where("not ok").select("path", "chunk_index", "inner_coord")


def read_samples(spark: SparkSession, url: str, variables: list[str] | None = None, *, sample_axis: int = 0, on_bad_chunk: str = "raise", transforms: tuple = (), **options) -> dict[str, DataFrame]:
    """For each variable a frame (sample_index, value), its chunks put together and transformed where they are read.

    A bad tile raises, or under "nan" is NaN (for other than floats the fill value).
    """
    if on_bad_chunk not in ("raise", "nan"):
        raise ValueError(f"on_bad_chunk is raise or nan, not {on_bad_chunk!r}")
    found = open_geometries(url, variables, sample_axis=sample_axis, options=options.get("storage_options"), backend=options.get("backend", "arrow"))
    steps = base64.b64encode(cloudpickle.dumps(list(transforms))).decode() if transforms else None
    return {n: _opened(spark, url, [n], {"sample_axis": sample_axis, "emit": "samples", "on_bad_chunk": on_bad_chunk, "transforms": steps, **options}) for n in found}


def assemble(tiles: DataFrame, geometry: Geometry, on_bad_chunk: str = "raise") -> DataFrame:
    """Tiles of one array, from wherever they come (a reference table, a join), -> (sample_index, value). The tiles of a chunk are one group."""
    if on_bad_chunk not in ("raise", "nan"):
        raise ValueError(f"on_bad_chunk is raise or nan, not {on_bad_chunk!r}")
    g, kind = geometry, np.dtype(geometry.dtype)
    sql, arrow = element(g.dtype)
    tile = np.moveaxis(np.empty(g.chunks, bool), g.sample_axis, 0).shape

    def run(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk_index")[0].as_py()
        out = np.empty((len(g.samples(chunk)), *g.field), kind)
        for inner, data, ok in zip(*(group.column(c).to_pylist() for c in ("inner_coord", "data", "ok"))):
            if not ok and on_bad_chunk == "raise":
                raise ValueError(f"{g.path}: tile {inner} of chunk {chunk} cannot be decoded")
            part = np.frombuffer(data, kind).reshape(tile) if ok else np.full(tile, np.nan if kind.kind == "f" else 0, kind)
            g.scatter(tuple(np.insert(inner, g.sample_axis, chunk).tolist()), np.moveaxis(part, 0, g.sample_axis), out)
        return pa.Table.from_batches([sample_rows(out, g.samples(chunk).start, arrow)])

    return tiles.where(F.col("path") == g.path).groupBy("chunk_index").applyInArrow(run, f"sample_index bigint, value array<{sql}>")


def metadata(name: str, shape: tuple[int, ...], chunks: tuple[int, ...], dtype: np.dtype, *, version: int = 3, codec: str | None = None, fill_value: float = 0) -> tuple[str, dict]:
    """The metadata's file name and body. codec: zstd, gzip (both versions), zlib (2)."""
    if version == 3:
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec, "configuration": {"level": 3}}] if codec else [])
        return "zarr.json", {"zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill_value, "codecs": codecs, "attributes": {}}
    return ".zarray", {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype.newbyteorder("<").str, "compressor": {"id": codec, "level": 3} if codec else None, "fill_value": fill_value, "order": "C", "filters": None}


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(data)


def _packed(raw: bytes, codec: str | None) -> bytes:
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(raw)
    return gzip.compress(raw) if codec == "gzip" else zlib.compress(raw) if codec == "zlib" else raw


def _write_chunk(fs: pafs.FileSystem, folder: str, layout: Layout, chunk: int, values: np.ndarray, codec: str | None, skip=frozenset()) -> int:
    """Writes the tiles of a chunk (samples first) but those to skip; returns how many."""
    g, n = layout.geometry, 0
    stored = np.moveaxis(values, 0, g.sample_axis)
    for cell in g.tiles(chunk):
        if cell in skip:
            continue
        box = g.grid.box(cell)
        part = stored[tuple(slice(None) if a == g.sample_axis else slice(r.start, r.stop) for a, r in enumerate(box))]
        tile = np.full(g.chunks, layout.fill, g.dtype)
        tile[tuple(slice(k) for k in part.shape)] = part
        _put(fs, f"{folder}/{layout.key(cell)}", _packed(tile.tobytes(), codec))
        n += 1
    return n


def write_array(url: str, name: str, values: np.ndarray, chunks: tuple[int, ...], *, version: int = 3, codec: str | None = None, fill_value: float = 0, skip: frozenset = frozenset(), options: dict | None = None) -> None:
    """Writes an array that the caller holds, in tiles; those in skip (cells) stay absent."""
    fs, top = filesystem(url, options)
    file, meta = metadata(name, values.shape, chunks, values.dtype, version=version, codec=codec, fill_value=fill_value)
    _put(fs, f"{top}/{name}/{file}", json.dumps(meta).encode())
    layout = Layout(name, meta, version, 0)
    for c in range(layout.geometry.n_chunks):
        own = layout.geometry.samples(c)
        _write_chunk(fs, f"{top}/{name}", layout, c, values[own.start : own.stop], codec, skip)


def write_samples(samples: DataFrame, url: str, name: str, n_samples: int, field: tuple[int, ...], chunks: tuple[int, ...], *, dtype: str = "f4", version: int = 3, codec: str | None = None, fill_value: float = 0, storage_options: dict | None = None) -> tuple[int, int]:
    """Writes (sample_index, value) as an array (samples first): each chunk by one task, wherever it runs; the driver writes the metadata
    alone. Returns how many chunks and tiles were written; chunks without samples stay absent, missing samples are filled. A task that
    is run again writes the same files."""
    ship(samples.sparkSession)
    fs, top = filesystem(url, storage_options)
    file, meta = metadata(name, (n_samples, *field), chunks, np.dtype(dtype), version=version, codec=codec, fill_value=fill_value)
    layout = Layout(name, meta, version, 0)
    g = layout.geometry

    def run(group: pa.Table) -> pa.Table:
        at = group.column("sample_index").to_numpy()
        chunk = int(at[0]) // g.sample_chunk_size
        values = np.full((len(g.samples(chunk)), *g.field), layout.fill, g.dtype)
        flat = group.column("value").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        values[at - g.samples(chunk).start] = flat.reshape(len(at), *g.field)
        own, path = filesystem(url, storage_options)
        return pa.table({"chunk_index": pa.array([chunk], pa.int64()), "tiles": pa.array([_write_chunk(own, f"{path}/{name}", layout, chunk, values, codec)], pa.int64())})

    written = samples.groupBy(F.expr(f"sample_index div {g.sample_chunk_size}").alias("c")).applyInArrow(run, "chunk_index bigint, tiles bigint")
    total = written.agg(F.count("*").alias("chunks"), F.sum("tiles").alias("tiles")).first()
    _put(fs, f"{top}/{name}/{file}", json.dumps(meta).encode())
    return total.chunks, total.tiles or 0
