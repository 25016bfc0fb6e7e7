"""Offset-preserving SentencePiece encoding, and decoding.

A text is normalised here, not in the library: at each byte the longest prefix found in the model's compiled character map (a double
array trie and a pool of replacements) gives its replacement, any other character stays, and every byte of the result is aligned with
the source bytes it came from. The normalised text is cut into pieces by a segmenter that is the model with its normaliser switched
off, and the pieces' lengths, carried through the alignment, give each piece its span of bytes of the original text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, steps

_SPACE = "▁".encode()


class CharacterMap:
    """A compiled character map: longest-prefix lookup in its double-array trie."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size :] if blob else b""

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that text has at a place."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.pool[start : self.pool.index(0, start)]
        return found


class Codec:
    """One model: its normaliser, its bare segmenter, and the library's own decoder."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            raw = f.read()
        proto = pb.ModelProto()
        proto.ParseFromString(raw)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix or any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with white space as suffix or user-defined pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = pb.ModelProto.SentencePiece
        self.width = np.array([1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = self.bare.unk_id()
        self.ends = self.bare.bos_id(), self.bare.eos_id()

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """The normalised text, and for each of its bytes (and its end) the source byte where what it came from starts; None: by ``plain``."""
        if not self.map and not self.trim and self.escape:
            return (_SPACE if self.dummy and text else b"") + text.replace(b" ", _SPACE), None
        out, source, n, at = bytearray(), [], len(text), 0
        space = _SPACE if self.escape else b" "

        def one(at: int) -> tuple[int, bytes]:
            if self.map and (hit := self.map.longest(text, at)):
                return hit
            b = text[at]
            return (w := 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4), text[at : at + w]

        if self.trim:
            while at < n and (hit := one(at))[1] == b" ":
                at += hit[0]
        if self.dummy and at < n:
            out += space
            source += [at] * len(space)
        last = self.trim
        while at < n:
            width, new = one(at)
            if last and new.startswith(b" "):
                new = new.lstrip(b" ")
            if new:
                last = self.trim and new.endswith(b" ")
                for c in new:
                    piece = space if c == 32 else bytes([c])
                    out += piece
                    source += [at] * len(piece)
            at += width
        if self.trim:
            while out.endswith(space) and out:
                del out[-len(space) :]
                n = source[-len(space)]
                del source[-len(space) :]
        return bytes(out), np.array([*source, n], np.int64)

    def plain(self, text: bytes) -> np.ndarray:
        """The alignment where no map applies: each byte with itself, a space with the three bytes it became, the prefix with the start."""
        wide = np.ones(len(text), np.int64)
        wide[np.frombuffer(text, np.uint8) == 32] = 3
        lead = np.zeros(3 if self.dummy and text else 0, np.int64)
        return np.concatenate((lead, np.repeat(np.arange(len(text)), wide), [len(text)]))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids with begin and end, and each piece's first byte and end in the text (the two added ids have empty spans)."""
        raw = [t.encode() for t in texts]
        normal = [self.normalise(r) for r in raw]
        found = self.bare.encode([x.decode() for x, _ in normal], num_threads=1)
        out = []
        for r, (x, source), own in zip(raw, normal, found):
            ids = np.array(own, np.uint32)
            width = self.width[ids]
            if (lost := ids == self.unknown).any():
                width = self._unknown_widths(x, ids, width, lost)
            end = np.cumsum(width)
            if len(ids) and end[-1] != len(x):
                raise ValueError("pieces do not cover the normalised text")
            source = self.plain(r) if source is None else source
            a, b = source[end - width], source[end]
            out.append((np.concatenate(([self.ends[0]], ids, [self.ends[1]])).astype("<u4"), np.concatenate(([0], a, [len(r)])).astype("<u4"), np.concatenate(([0], b, [len(r)])).astype("<u4")))
        return out

    def _unknown_widths(self, text: bytes, ids: np.ndarray, width: np.ndarray, lost: np.ndarray) -> np.ndarray:
        """For models without byte pieces: an unknown id covers what the segmenter says it covers."""
        pieces = self.bare.encode(text.decode(), out_type=str)
        return np.array([len(p.encode()) if no else w for p, no, w in zip(pieces, lost, width)], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _coded(path: str, column: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in steps(batches, column):
            got = c.encode([t or "" for t in b.column(b.schema.get_field_index(column)).to_pylist()])
            new = [pa.array([x[k].tobytes() for x in got], pa.binary()) for k in range(3)]
            if decoded:
                new.append(pa.array([c.decode(x[0]) for x in got], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "piece_ids", "piece_starts", "piece_ends", *["decoded"] * decoded])

    return run


def encode_pieces(df: DataFrame, path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """Adds piece_ids, piece_starts, piece_ends (binary: little-endian unsigned 32-bit integers; bytes of the UTF-8 text, end exclusive)
    and decoded (what the library makes of the ids) to df.

    A null text is encoded as the empty one: the begin and the end id. Columns of df with these names are replaced; others stay. Rows
    are independent: nothing is shuffled, and a worker holds a few MB of texts at a time.
    """
    ship(df.sparkSession)
    df = df.drop("piece_ids", "piece_starts", "piece_ends", "decoded")
    more = [T.StructField(n, T.BinaryType()) for n in ("piece_ids", "piece_starts", "piece_ends")] + [T.StructField("decoded", T.StringType())] * decoded
    return df.mapInArrow(_coded(path, text, decoded), T.StructType([*df.schema.fields, *more]))


def digests(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, more columns as they are, and the length and digests of the coded columns."""
    return df.select("doc_id", *more, F.expr("cast(length(piece_ids) div 4 as bigint)").alias("n_tokens"), F.sha2("piece_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.crc32(F.concat("piece_starts", "piece_ends")).alias("spans_crc32"))
