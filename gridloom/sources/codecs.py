"""Decoders of stored chunks: zstd, gzip, zlib, Blosc frames, checksums and shards."""

from __future__ import annotations

import gzip
import struct
import zlib
from functools import cache
from math import prod

import numpy as np
import pyarrow as pa


def zstd(raw: bytes, size: int | None = None) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


@cache
def _crc_table() -> list[int]:
    """CRC-32C (Castagnoli), by its reflected polynomial."""
    out = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0x82F63B78 if k & 1 else 0)
        out.append(k)
    return out


def crc32c(raw: bytes) -> int:
    table, c = _crc_table(), 0xFFFFFFFF
    for x in raw:
        c = table[(c ^ x) & 0xFF] ^ c >> 8
    return c ^ 0xFFFFFFFF


def checked(raw: bytes) -> bytes:
    """The bytes before their checksum, which must be right."""
    if len(raw) < 4 or crc32c(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("the checksum does not fit")
    return raw[:-4]


def blosc(raw: bytes) -> bytes:
    """A Blosc 1 frame: a header of 16 bytes, the start of each block, and in each block one or more compressed streams, byte-shuffled.

    Inner codecs LZ4, Snappy, zlib and Zstandard; BloscLZ and bit shuffles raise.
    """
    _, _, flags, item, whole, block, packed = struct.unpack_from("<BBBBIII", raw)
    if flags & 0x4:
        raise ValueError("bit-shuffled Blosc frames are not supported")
    if flags & 0x2:
        return raw[16 : 16 + whole]
    kind = flags >> 5
    if kind not in (1, 2, 3, 4):
        raise ValueError("BloscLZ frames are not supported")
    unpack = {1: lambda x, n: pa.Codec("lz4_raw").decompress(x, n).to_pybytes(), 2: lambda x, n: pa.Codec("snappy").decompress(x, n).to_pybytes(), 3: lambda x, n: zlib.decompress(x), 4: zstd}[kind]
    out = []
    for k in range(-(-whole // block) if block else 0):
        size = min(block, whole - k * block)
        at = struct.unpack_from("<i", raw, 16 + 4 * k)[0]
        streams = item if not flags & 0x10 and size == block and item <= 16 and block // max(item, 1) >= 128 else 1
        parts = []
        for _ in range(streams):
            n = struct.unpack_from("<i", raw, at)[0]
            part, want = raw[at + 4 : at + 4 + n], size // streams
            parts.append(part if n == want else unpack(part, want))
            at += 4 + n
        data = b"".join(parts)
        if len(data) != size:
            raise ValueError("a Blosc block has the wrong size")
        if flags & 0x1 and item > 1:
            many = size // item
            data = np.frombuffer(data[: many * item], np.uint8).reshape(item, many).T.tobytes() + data[many * item :]
        out.append(data)
    return b"".join(out)


_BYTES = {"zstd": lambda raw, _: zstd(raw), "gzip": lambda raw, _: gzip.decompress(raw), "zlib": lambda raw, _: zlib.decompress(raw), "blosc": lambda raw, _: blosc(raw), "crc32c": lambda raw, _: checked(raw)}
KNOWN = {*_BYTES, "bytes", "transpose", "sharding_indexed"}


class Chain:
    """The codecs of an array, as its metadata lists them, and the type of its stored elements."""

    def __init__(self, codecs: list[tuple[str, dict]], stored: np.dtype, order: str = "C", fill=0):
        self.codecs, self.stored, self.order, self.fill = codecs, stored, order, fill
        if unknown := [n for n, _ in self.codecs if n not in KNOWN]:
            raise ValueError(f"codecs {unknown} are not supported")

    def raw(self, raw: bytes) -> bytes:
        for name, conf in reversed(self.codecs):
            if name in _BYTES:
                raw = _BYTES[name](raw, conf)
        return raw

    def decode(self, raw: bytes, shape: tuple[int, ...]) -> np.ndarray:
        if shards := [conf for name, conf in self.codecs if name == "sharding_indexed"]:
            return self._shard(raw, shape, shards[0])
        axes = next((tuple(c["order"]) for n, c in self.codecs if n == "transpose"), None)
        flat = np.frombuffer(self.raw(raw), self.stored)
        if len(flat) != prod(shape):
            raise ValueError("a tile has the wrong number of elements")
        if axes:
            return flat.reshape([shape[a] for a in axes]).transpose(np.argsort(axes))
        return flat.reshape(shape, order=self.order)

    def _shard(self, raw: bytes, shape: tuple[int, ...], conf: dict) -> np.ndarray:
        """A shard: inner chunks anywhere in it, and an index of their places (all ones: absent) at its end or start."""
        inner = tuple(conf["chunk_shape"])
        own = Chain([(c["name"], c.get("configuration", {})) for c in conf["codecs"]], self.stored, fill=self.fill)
        index = Chain([(c["name"], c.get("configuration", {})) for c in conf.get("index_codecs", [])], np.dtype("<u8"))
        grid = tuple(n // c for n, c in zip(shape, inner))
        size = 16 * prod(grid) + 4 * sum(n == "crc32c" for n, _ in index.codecs)
        table = raw[:size] if conf.get("index_location") == "start" else raw[len(raw) - size :]
        places = np.frombuffer(index.raw(table), "<u8").reshape(-1, 2)
        out = np.full(shape, self.fill, self.stored)
        for cell, (at, n) in zip(np.ndindex(*grid), places.tolist()):
            if at != 2**64 - 1:
                out[tuple(slice(k * c, (k + 1) * c) for k, c in zip(cell, inner))] = own.decode(raw[at : at + n], inner)
        return out
