"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents may be long, so Jaccard similarity is useless and containment |Q & D| / |Q| is searched for. The
items are partitioned by the size of their shingle sets. An item Q of n shingles has as its sketch the
n - ceil(3 n / 4) + 1 shingles with the smallest hashes (bottom-k MinHash): a document that holds at least 3/4 of Q cannot miss all
of them, so probing for the sketch loses nothing. A partition whose smallest item is too large for a document is not probed for it.
Every document and item that share a sketch value are then compared by their whole shingle sets.

Items are broadcast in blocks of at most ``BLOCK`` shingles, one pass over the documents a block, so any number of items will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ship, steps, utf8
from .shingles import shingle_sets

#: Shingles of the items that one pass over the documents looks for (8 MB of hashes).
BLOCK = 1 << 20
_BITS = 20
_PAIRS = "doc_id long, item_id long, n_item long, n_shared long"


def required(n: int) -> int:
    """Shared shingles that a document needs to hold 3/4 of an item of n shingles."""
    return -(-3 * n // 4)


class Index:
    """Sketches of a block of items, by size partition, with the items' whole sets."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.items = items
        parts: dict[int, list[int]] = {}
        for i, (_, s) in enumerate(items):
            parts.setdefault(len(s).bit_length(), []).append(i)
        self.parts = []
        for _, own in sorted(parts.items()):
            sketch = [items[i][1][: len(items[i][1]) - required(len(items[i][1])) + 1] for i in own]
            h = np.concatenate(sketch)
            who = np.repeat(np.array(own), [len(x) for x in sketch])
            order = np.argsort(h, kind="stable")
            self.parts.append((min(required(len(items[i][1])) for i in own), h[order], who[order]))
        self.field = np.zeros(1 << _BITS, bool)
        for _, h, _ in self.parts:
            self.field[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def search(self, sets: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(document, item, shared) for all documents (by place) that hold 3/4 of an item."""
        if not sets or not self.parts:
            return []
        sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        hit = np.flatnonzero(self.field[(every >> np.uint64(64 - _BITS)).astype(np.int64)])
        doc = np.searchsorted(np.cumsum(sizes), hit, "right")
        every = every[hit]
        pairs = []
        for least, h, who in self.parts:
            fits = sizes[doc] >= least
            x, d = every[fits], doc[fits]
            lo, hi = np.searchsorted(h, x, "left"), np.searchsorted(h, x, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else lo, n) + np.arange(n.sum())
            if len(at):
                pairs.append(np.unique(np.repeat(d, n) * len(self.items) + who[at]))
        out = []
        for p in np.concatenate(pairs).tolist() if pairs else ():
            d, i = divmod(p, len(self.items))
            q, s = self.items[i][1], sets[d]
            at = np.minimum(np.searchsorted(s, q), len(s) - 1)
            shared = int(np.count_nonzero(s[at] == q))
            if shared >= required(len(q)):
                out.append((d, i, shared))
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    block, held = [], 0
    for r in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        text = (r.text or "").encode()
        s = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        if not len(s):
            continue
        if block and held + len(s) > BLOCK:
            yield block
            block, held = [], 0
        block.append((r.item_id, s))
        held += len(s)
    if block:
        yield block


def _matches(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            found = index.value.search(shingle_sets(*utf8(b.column(1))))
            ids, items = b.column(0).to_pylist(), index.value.items
            cols = [[ids[d] for d, _, _ in found], [items[i][0] for _, i, _ in found], [len(items[i][1]) for _, i, _ in found], [n for _, _, n in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_item", "n_shared"])

    return run


def _clean(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            keep = np.ones(b.num_rows, bool)
            keep[[d for d, _, _ in index.value.search(shingle_sets(*utf8(b.column(b.schema.get_field_index("text")))))]] = False
            yield b.filter(pa.array(keep))

    return run


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...), items (item_id, text, ...) -> doc_id, item_id, n_item, n_shared, containment: each pair in which the
    document holds at least 3/4 of the item's shingles.

    A text without words, or null, holds nothing and is held by nothing. An item of under five words is one shingle and is only held
    by the same sequence as a whole text. Repeated rows of either table give repeated pairs; null ids stay null.
    """
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, scratch = [], None
    for block in _blocks(items):
        if out and scratch is None:
            scratch = Scratch(spark)
            out = [scratch.save(f, "pairs") for f in out]
        index = spark.sparkContext.broadcast(Index(block))
        found = read.mapInArrow(_matches(index), _PAIRS)
        out.append(scratch.save(found, "pairs") if scratch else found)
    whole = reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], _PAIRS)
    return whole.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that hold 3/4 of no item."""
    spark = docs.sparkSession
    ship(spark)
    for block in _blocks(items):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(Index(block))), T.StructType(docs.schema.fields))
    return docs


#: Five-word shingles and containment in DuckDB's SQL.
SQL = r"""
WITH w AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), s AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g
  FROM w WHERE len(w) > 0
), q AS (SELECT id, g, count(*) OVER (PARTITION BY id) AS n FROM s WHERE side = 1)
SELECT d.id AS doc_id, q.id AS item_id, q.n AS n_item, count(*) AS n_shared, count(*) / q.n AS containment
FROM s d JOIN q ON d.g = q.g WHERE d.side = 0 GROUP BY d.id, q.id, q.n HAVING 4 * count(*) >= 3 * q.n
"""
