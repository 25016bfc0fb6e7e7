"""Token ids in ORC: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of doc_id (rows of one id by their number in the scan, so no range has to hold them all), sorted, tokenised and
written, one file a range, so files and rows follow the ids. A row has its
range's number and the ids that its range holds before it; the ranges' totals (one row a file) turn that into a place in the whole
stream. Readers split files by stripe, and a lookup by doc_id skips stripes and row groups by their minima, maxima and Bloom filters.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship, steps, utf8
from .shingles import SPACE, words

#: ORC writer: stripes of 16 MB, an index entry each 1,000 rows, Bloom filters on the ids.
OPTIONS = {"orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
#: Words whose ids a worker remembers.
KNOWN = 300_000
_ROWS = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def _classes() -> np.ndarray:
    c = np.full(256, 3, np.uint8)
    c[np.arange(256) >= 128] = 1
    for lo, hi in ((65, 91), (97, 123)):
        c[lo:hi] = 1
    c[48:58] = 2
    c[SPACE] = 0
    return c


#: Kinds of bytes: white space, letter, digit, other. Bytes over 127 count as letters; ODD has those that are not.
_CLASS = _classes()
#: Characters whose words are left whole to the tokenizer: apostrophes (contractions), angle brackets (special tokens), controls, and
#: all beyond the letters of Latin-1 and Latin Extended-A and B, which normalisation and the pattern leave as they are.
ODD = re.compile("['<\x00-\x08\x0e-\x1f\x7f-\xbf×÷İ\u0250-\U0010ffff]")


class WordTokens:
    """Ids of whole texts from the ids of their words, which the tokenizers library encodes.

    The tokenizer lower-cases, drops white space, and splits into runs of letters, single digits and runs of other characters before
    it merges; so a text's ids are those of these units one after another, and each different unit of a block is encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.unit = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.unit.normalizer = normalizers.Sequence([])
        self.unit.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, np.ndarray] = {}

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with ``end`` after each text, and the offsets of each text's."""
        data, offs = utf8(texts)
        start, first = self._units(data, offs)
        keep = ~SPACE[data]
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        bounds = np.append(at[start], at[-1]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(data[keep])).dictionary_encode()
        each = self._words(coded.dictionary.to_pylist())
        each.append(np.array([end], np.int32))
        code = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first[1:], len(each) - 1)
        length = np.array([len(x) for x in each])
        flat, at = np.concatenate(each), np.concatenate(([0], np.cumsum(length)[:-1]))
        n = length[code]
        to = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(at[code] - to[:-1], n) + np.arange(to[-1])]
        return out, to[first + np.arange(len(first))]

    def _units(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte at which each unit starts, and for each text the index of its first unit."""
        kind = _CLASS[data]
        begin = np.ones(len(data), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        begin |= edge[:-1]
        begin &= kind > 0
        odd = _MAYBE[data]
        if odd.any():  # a word with such a byte is one unit
            w0, w1, _ = words(data, offs)
            count = np.concatenate(([0], np.cumsum(odd)))
            whole = count[w1] > count[w0]
            inside = np.zeros(len(data) + 1, np.int8)
            inside[w0[whole] + 1] += 1
            inside[w1[whole]] -= 1
            begin &= ~np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        start = np.flatnonzero(begin)
        return start, np.searchsorted(start, offs)

    def _words(self, every: list[str]) -> list[np.ndarray]:
        known = self.known
        got = [known.get(w) for w in every]
        new = [i for i, x in enumerate(got) if x is None]
        odd = [i for i in new if ODD.search(every[i])]
        left = set(odd)
        for own, texts, tokenizer in ((odd, [every[i] for i in odd], self.whole), (plain := [i for i in new if i not in left], [every[i].lower() for i in plain], self.unit)):
            for i, e in zip(own, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                got[i] = np.array(e.ids, np.int32)
                if len(known) < KNOWN:
                    known[every[i]] = got[i]
        return got


#: Bytes of which ODD's characters have at least one.
_MAYBE = np.zeros(256, bool)
_MAYBE[[c for c in range(128) if ODD.match(chr(c)) and not SPACE[c]]] = True
_MAYBE[[0xC2, *range(0xCA, 256)]] = True
_MAYBE[[0x97, 0xB7, 0xB0]] = True  # the second bytes of the three letters left out


@cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _tokenised(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in steps(batches, "text", 6 << 20):
            ids, offs = word_tokens(path).ids(b.column(1), end)
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), b.column(0), pa.array(total + offs[:-1]), pa.array(np.diff(offs)), lists], ["part", "doc_id", "local_start", "n_tokens", "ids"])
            total += int(offs[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2) -> None:
    """Writes docs (doc_id, text, ...) as ORC below path, in ascending doc_id order.

    A null text is empty and has the end id alone; null ids come first; repeated rows are all written. Rows of one id stand in the order in
    which the table is read, which the same files and settings repeat. Other columns are not read.
    """
    ship(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    read = read.withColumn("at", F.monotonically_increasing_id())
    rows = read.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text").mapInArrow(_tokenised(tokenizer, end), _ROWS)
    rows.write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the file; with doc_ids only those, found through the indexes."""
    rows = spark.read.schema(_ROWS).orc(path)
    starts = part_starts(rows)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.join(starts, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def part_starts(rows: DataFrame) -> DataFrame:
    """part, before: the ids of all ranges before each. One row a file."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(b.schema.get_field_index("ids"))
        values, offs = ids.flatten().to_numpy().astype("<u4", copy=False), np.concatenate(([0], np.cumsum(np.diff(ids.offsets.to_numpy()))))
        view = memoryview(np.ascontiguousarray(values)).cast("B")
        sums = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in ("part", "doc_id", "local_start", "n_tokens")), pa.array(sums, pa.int64())], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    rows = spark.read.schema(_ROWS).orc(path)
    sums = rows.mapInArrow(_checksums, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return sums.join(part_starts(rows), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
