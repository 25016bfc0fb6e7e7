"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows are distinct shingle sets (equal sets collapse first), columns are shingles. Two rows link when their overlap o and sizes a, b
satisfy 7 o >= 3 (a + b), which is Jaccard >= 0.75. The product is never formed whole:

1. Columns are put in one global order, rare ones first. A row of n shingles can only link with rows that share one of its first
   floor(n / 4) + 1 columns, so only this prefix of the incidence is dealt to blocks of columns (a shuffle by shingle).
2. A block multiplies its columns: rows that share a column and whose sizes and positions still allow the overlap are kept. A column
   is first multiplied sparsely (every row with the first row of its size band and with its neighbour by size). The kept pairs are
   multiplied over folded columns (ranges of hashes), an upper bound that few unlike pairs reach, then over all columns, and linked
   rows are joined to components.
3. While columns that still hold several components are long, rows of other components are multiplied with a few members of each large
   one (``PIVOTS``, then sixteen times as many in each round), as one link of many joins a row to its group and spares the others.
4. Then every pair of rows of *different* components that share a column is multiplied, in blocks of at most ``BLOCK`` rows of a
   column, so no link between components is missed; pairs inside a component cannot change the result and are not formed.

The column order only decides the cost: it ranks shingles by a table of the ``RANKED`` most frequent ones, of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, ship, steps, trim, utf8
from .components import components
from .shingles import shingle_sets

#: Rows of a column that are multiplied with each other in one task.
BLOCK = 4096
#: Rows of one column that are held at once when rows without a possible partner are dropped; of longer columns, which come in parts, all rows stay.
LONGEST = 1 << 22
#: Mean length of columns that still hold several components, up to which they are multiplied whole at once.
LONG = 64
#: Earlier columns that a row knows when columns are multiplied whole.
EARLIER = 4
#: Runs of other components that a row looks back on in a sparse round.
DEPTH = 4
#: Members of a component that stand for it in the first round after the sparse one.
PIVOTS = 128
#: Most frequent shingles whose frequency the column order knows.
RANKED = 1 << 17
#: Bits of the filters by which the second reading of the texts finds rows that have a candidate, at least and at most (64 MB); a false hit only
#: costs. Between, there are 16 bits a candidate.
FILTER_BITS, MOST_FILTER_BITS = 1 << 24, 1 << 29
#: Shingles that are counted together when a task looks for frequent ones.
COUNTED = 1 << 21

_SETS = "kind int, x long, fp long, fp2 long, n long"
_ROWS = "h long, n int, fp long, pos int"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _print(s: np.ndarray) -> tuple[int, int]:
    """Two prints of a set, 64 bits each. The first names it, unless ``_classes`` finds that another set has it too; then the second does."""
    d = xxhash.xxh3_128(s.tobytes()).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    parts = [p.split() for p in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for (_, k), c in zip(parts, columns)], [n for n, _ in parts])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a document (x: its id) with the fingerprint and size of its set; kind 1: a shingle (x) seen n times among COUNTED."""
    held, count = [], 0

    def frequent():
        x = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        n = np.diff(np.append(first, len(x)))
        often = n >= 3
        k = int(often.sum())
        return _batch(_SETS, np.ones(k, np.int32), _signed(x[first[often]]), np.zeros(k, np.int64), np.zeros(k, np.int64), n[often])

    for b in steps(batches, "text"):
        sets = shingle_sets(*utf8(b.column(1)))
        prints = [_print(s) for s in sets]
        yield _batch(_SETS, np.zeros(len(sets), np.int32), b.column(0), [p[0] for p in prints], [p[1] for p in prints], [len(s) for s in sets])
        held += sets
        count += sum(map(len, sets))
        if count >= COUNTED:
            yield frequent()
            held, count = [], 0
    if count:
        yield frequent()


def _name(prints: tuple[int, int], clashes: frozenset[int]) -> int:
    return prints[1] if prints[0] in clashes else prints[0]


def _classes(sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """sets (doc_id, fp, n) under their names; classes (fp, n, rep: the smallest id) of those that can link; and the first prints that different
    sets share: as good as none among 10^8 sets, a handful among 10^10."""

    def grouped(sets: DataFrame) -> DataFrame:
        own = F.struct("fp2", "n")
        some = sets.where("n > 0 and doc_id is not null").groupBy("fp")
        return scratch.save(some.agg(F.min("n").alias("n"), F.min("doc_id").alias("rep"), F.min(own).alias("a"), F.max(own).alias("b")), "classes")

    out = grouped(sets)
    clashes = frozenset(r.fp for r in out.where("a <> b").select("fp").collect())
    if clashes:
        sets = sets.withColumn("fp", F.when(F.col("fp").isin(*clashes), F.col("fp2")).otherwise(F.col("fp")))
        out = grouped(sets)
    return sets.drop("fp2"), out.select("fp", "n", "rep"), clashes


def _prefixes(ranked, clashes: frozenset[int]):
    """Rows of the incidence's prefix, once for each distinct set of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, level = ranked.value
        seen: set[int] = set()
        for b in steps(batches, "text"):
            out = []
            for s in shingle_sets(*utf8(b.column(0))):
                if not len(s) or (fp := _name(_print(s), clashes)) in seen:
                    continue
                seen.add(fp)
                size = len(s)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    rank = np.where(keys[at] == s, level[at], 0)
                    s = s[np.argsort(rank, kind="stable")] if rank.any() else s
                out.append((s[: size // 4 + 1], size, fp))
            if out:
                h = np.concatenate([o[0] for o in out])
                each = np.array([len(o[0]) for o in out])
                n = np.repeat(np.array([o[1] for o in out]), each)
                yield _batch(_ROWS, _signed(h), n.astype(np.int32), np.repeat(np.array([o[2] for o in out], np.int64), each), np.concatenate([np.arange(e, dtype=np.int32) for e in each]))

    return run


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in b.columns]


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows of whole columns with their place in the column, and whether it comes in parts, as one of over ``LONGEST`` rows does."""
    held: list[list[np.ndarray]] = []
    count, last, cutoff = 0, None, False
    for b in batches:
        if not b.num_rows:
            continue
        held.append(_columns(b))
        if sum(len(x[0]) for x in held) < 20_000:
            continue
        c = [np.concatenate(x) for x in zip(*held)]
        cuts = np.flatnonzero(c[0][1:] != c[0][:-1]) + 1
        cut = int(cuts[-1]) if len(cuts) else len(c[0]) if len(c[0]) >= LONGEST else 0
        held = [[x[cut:] for x in c]] if cut < len(c[0]) else []
        if cut:
            own = [x[:cut] for x in c]
            ranks = _places(own[0])
            parted = np.full(cut, not len(cuts))
            if last == own[0][0]:
                ranks[own[0] == last] += count
                parted |= (own[0] == last) & cutoff
            last, count, cutoff = own[0][-1], int(ranks[-1]) + 1, not len(cuts)
            yield [*own, ranks, parted]
    if held:
        own = [np.concatenate(x) for x in zip(*held)]
        ranks = _places(own[0])
        parted = np.zeros(len(ranks), bool)
        if len(ranks) and last == own[0][0]:
            ranks[own[0] == last] += count
            parted |= own[0] == last
        yield [*own, ranks, parted]
    trim()


def _places(h: np.ndarray) -> np.ndarray:
    at = np.arange(len(h))
    start = np.ones(len(h), bool)
    start[1:] = h[1:] != h[:-1]
    return at - np.maximum.accumulate(np.where(start, at, 0))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, n, fp): those that may link by their column, each with the number of its block in it.

    A row goes if no other row of its column has a size that its own size and position still allow; twice, as rows that go free others. Rows of a
    column that comes in parts stay.
    """
    for h, n, fp, pos, rank, parted in _ranked(batches):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])
        h, n, fp, pos, rank, parted = (x[new] for x in (h, n, fp, pos, rank, parted))
        for _ in range(2):
            if not len(h):
                break
            run = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
            wide = np.int64(1) << 32
            key = run * wide + n
            low = run * wide + (3 * n.astype(np.int64) + 3) // 4
            at = np.searchsorted(key, low)
            itself = at == np.arange(len(h))
            at = np.minimum(at + itself, len(h) - 1)
            keep = (run[at] == run) & (at != np.arange(len(h))) & (3 * n[at].astype(np.int64) <= 4 * n.astype(np.int64) - 7 * pos)
            keep |= parted
            h, n, fp, pos, rank, parted = (x[keep] for x in (h, n, fp, pos, rank, parted))
        if len(h):
            yield _batch(_ROWS + ", blk int", h, n, fp, pos, rank // BLOCK)


def _may_link(n1, p1, n2, p2):
    """Sizes (n1 <= n2) and positions of a common column that still allow 7 o >= 3 (n1 + n2), were it their first common one."""
    return (4 * n1 >= 3 * n2) & (7 * np.minimum(n1 - p1, n2 - p2) >= 3 * (n1 + n2))


def _runs(batches: Iterator[pa.RecordBatch], keys: int, most: int = 200_000) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Column arrays of whole runs of the first ``keys`` columns; a run of over ``most`` rows comes in parts, each led by the run's first row and the last one before."""
    held: list[list[np.ndarray]] = []
    lead = None

    def joined():
        return [np.concatenate(x) for x in zip(*held)]

    for b in batches:
        if not b.num_rows:
            continue
        held.append(_columns(b))
        if sum(len(x[0]) for x in held) < 20_000:
            continue
        c = joined()
        change = np.zeros(len(c[0]), bool)
        for x in c[:keys]:
            change[1:] |= x[1:] != x[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            yield [x[: cuts[-1]] for x in c]
            held = [[x[cuts[-1] :] for x in c]]
        elif len(c[0]) >= most:
            yield c
            held = [[x[[0, -1]] for x in c]]
        else:
            held = [c]
    if held:
        yield joined()
    trim()


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a column with the first of its size band, and with the last rows of the DEPTH runs of other components before it."""
    for h, n, fp, pos, comp in _runs(batches, 1):
        at = np.arange(len(h))
        start = np.ones(len(h), bool)
        start[1:] = h[1:] != h[:-1]
        band = np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3)).astype(np.int64)
        lead = start.copy()
        lead[1:] |= band[1:] != band[:-1]
        lead = np.maximum.accumulate(np.where(lead, at, 0))
        other = start.copy()
        other[1:] |= comp[1:] != comp[:-1]
        other = np.maximum.accumulate(np.where(other, at, 0)) - 1
        first = np.maximum.accumulate(np.where(start, at, 0))
        partner, tries = other, [lead]
        for _ in range(DEPTH):
            tries.append(partner)
            partner = np.where(partner > 0, other[partner], -1)
        a, b = np.concatenate(tries), np.tile(at, len(tries))
        ok = (a >= first[b]) & (a < b)
        a, b = a[ok], b[ok]
        a, b = (x[(comp[a] != comp[b]) & _may_link(n[a], pos[a], n[b], pos[b])] for x in (a, b))
        if len(a):
            yield _batch("a long, b long", np.minimum(fp[a], fp[b]), np.maximum(fp[a], fp[b]))


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of rows of different components in a block (of one column, sorted by size) that may link.

    A row knows the last EARLIER columns that it has before this one; two rows that share one of those meet there, or yet earlier. One of the two
    has to lead.
    """
    for h, i, j, n, fp, pos, blk, comp, leads, *earlier in _runs(batches, 3, 1 << 60):
        group = np.zeros(len(h), np.int64)
        group[1:] = np.cumsum((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        a, d = np.arange(len(h)), 1
        while True:
            a = a[a + d < len(h)]
            b = a + d
            on = (group[a] == group[b]) & (4 * n[a] >= 3 * n[b])
            a, b = a[on], b[on]
            if not len(a):
                break
            ok = (comp[a] != comp[b]) & (leads[a] | leads[b]) & ((blk[a] != blk[b]) | (i[a] == j[a])) & _may_link(n[a], pos[a], n[b], pos[b])
            x, y = a[ok], b[ok]
            for e in earlier if len(x) else ():
                known = e[x] != 0
                met = np.zeros(len(x), bool)
                for f in earlier:
                    met |= e[x] == f[y]
                keep = ~(met & known)
                x, y = x[keep], y[keep]
            if len(x):
                yield _batch("a long, b long", np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y]))
            d += 1


def _fold(s: np.ndarray) -> bytes:
    """Shingles of a set by ranges of their hashes, a byte each: about as many ranges as half to all of the set's size. Empty: no such table."""
    bits = max(len(s).bit_length() - 1, 3)
    n = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def _most(x: bytes, y: bytes, n1: int, n2: int) -> int:
    """The most that two sets' overlap can be by their folded columns."""
    if not x or not y:
        return min(n1, n2)
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(x) < len(y):
        y = y.reshape(len(x), -1).sum(1)
    return int(np.minimum(x, y).sum())


def _wanted(bits, of_ids, clashes: frozenset[int]):
    """Sets, and their folded columns, of documents whose fingerprint and id pass the filters: the first document of each class, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, ids = (np.frombuffer(x.value, np.uint8) for x in (bits, of_ids))
        seen: set[int] = set()
        on = lambda field, k: field[(k := k & (8 * len(field) - 1)) >> 3] >> (k & 7) & 1
        for b in steps(batches, "text"):
            own = np.array(b.column(0).to_numpy(zero_copy_only=False))
            b = b.filter(pa.array(np.fromiter((bool(on(ids, k)) for k in own.tolist()), bool, len(own))))
            out = []
            for s in shingle_sets(*utf8(b.column(1))):
                if len(s) and (fp := _name(_print(s), clashes)) not in seen and on(prints, fp):
                    seen.add(fp)
                    out.append((fp, len(s), _fold(s), s.tobytes()))
            if out:
                yield _batch("fp long, n int, f binary, s binary", *([o[k] for o in out] for k in range(4)))

    return run


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose product over folded columns still reaches the bound that their sizes set."""
    for b in batches:
        keep = [7 * _most(x, y, n1, n2) >= 3 * (n1 + n2) for n1, n2, x, y in zip(*(b.column(k).to_pylist() for k in range(2, 6)))]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole overlap counts of a block of pairs; those below the bound that their sizes set go."""
    for b in batches:
        links = []
        for a, c, x, y in zip(*(b.column(k).to_pylist() for k in (0, 1)), b.column(2), b.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            z = np.concatenate((x, y))
            z.sort()
            if 7 * int(np.count_nonzero(z[1:] == z[:-1])) >= 3 * (len(x) + len(y)):
                links.append((a, c))
        yield _batch("a long, b long", [x[0] for x in links], [x[1] for x in links])
    trim()


def _bitmaps(keys: DataFrame, columns: list[str], many: int) -> list[bytes]:
    """A filter over each long column of ``many`` rows: as many bits as they ask for, within fixed bounds."""
    bits = min(max(FILTER_BITS, 1 << (16 * many).bit_length()), MOST_FILTER_BITS)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.col(c).bitwiseAND(F.lit(bits - 1)) + 1).alias("k")) for i, c in enumerate(columns)))).alias("e")
    rows = keys.select(each).select("e.*").groupBy("i", F.expr("bitmap_bucket_number(k)").alias("g")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(k))").alias("m"))
    out = np.zeros((len(columns), bits // 8), np.uint8)
    for r in rows.toLocalIterator():
        out[r.i, (r.g - 1) * 4096 : r.g * 4096] = np.frombuffer(r.m, np.uint8)
    return [x.tobytes() for x in out]


def _known(keys: DataFrame, column: str):
    """An expression: may a long be in a column of keys? Only rows that pass need a shuffle to find out; a null does not pass."""
    field = keys.sparkSession.sparkContext.broadcast(_bitmaps(keys, [column], keys.count())[0])

    def run(k: pd.Series) -> pd.Series:
        bits = np.frombuffer(field.value, np.uint8)
        at = k.to_numpy() & (8 * len(bits) - 1)
        return pd.Series((bits[at >> 3] >> (at & 7) & 1).astype(bool))

    on = F.pandas_udf(run, "boolean")
    return lambda c: F.when(c.isNull(), False).otherwise(on(F.coalesce(c.cast("long"), F.lit(0))))


def _linked(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """Rows that have an id and a shingle: doc_id, fp and n_shingles of their set, comp, component_id; the other rows; and the prints that clash."""
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    seen = scratch.save(read.mapInArrow(_fingerprints, _SETS), "prints")
    sets = seen.where("kind = 0").select(F.col("x").alias("doc_id"), "fp", "fp2", "n")
    sets, classes, clashes = _classes(sets, scratch)
    top = _most_frequent(scratch.save(seen.where("kind = 1").groupBy("x").agg(F.sum("n").alias("n")), "frequent"))
    keys = np.array([r.x for r in top], np.int64).view(np.uint64)
    order = np.argsort(keys)
    ranked = sc.broadcast((keys[order], np.array([int(r.n).bit_length() for r in top], np.int16)[order]))
    texts = read.where("doc_id is not null").select("text")
    rows = texts.mapInArrow(_prefixes(ranked, clashes), _ROWS)
    shared = scratch.save(rows.repartition("h").sortWithinPartitions("h", "n", "fp").mapInArrow(_shared, _ROWS + ", blk int"), "shared")
    del rows
    scratch.release()

    own = F.col("fp").alias("comp")
    pairs = shared.select("h", "n", "fp", "pos", own).repartition("h").sortWithinPartitions("h", "n", "fp").mapInArrow(_sparse, "a long, b long")
    tried = scratch.save(pairs.distinct(), "tried")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that link. The texts are read again for the sets of documents in a pair alone."""
        ends = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(classes, "fp").select("fp", "rep"), "ends")
        bits, of_ids = map(sc.broadcast, _bitmaps(ends, ["fp", "rep"], ends.count()))
        whole = scratch.save(read.where("doc_id is not null").mapInArrow(_wanted(bits, of_ids, clashes), "fp long, n int, f binary, s binary"), "sets")
        left = scratch.save(_matched(pairs, whole, ["n", "f"]).mapInArrow(_possible, "a long, b long").distinct(), "possible")
        in_left = scratch.save(left.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "ends")
        known = _known(in_left, "fp")  # whole sets are dealt only where a pair is left
        out = scratch.save(_matched(left, whole.where(known(F.col("fp"))), ["s"]).mapInArrow(_overlaps, "a long, b long"), "links")
        scratch.drop(whole, left, in_left, ends)
        return out

    links = linked(tried)

    last, found_more, pivots, base = False, True, PIVOTS, shared
    while not last:
        comps = scratch.save(components(links, scratch), "comps")
        rows = base.join(comps.withColumnsRenamed({"v": "fp", "c": "comp"}), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        mixed = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("blk").alias("top"), F.count("*").alias("m")).where("lo <> hi").select("h", "top", "m")
        rows = scratch.save(rows.join(mixed, "h"), "mixed")
        base = rows.select("h", "n", "fp", "pos", "blk")  # components only merge: a column of one stays so
        some = rows.agg(F.count("*"), F.sum("m")).first()
        if not some[0]:
            break
        # Rounds go on while they join components and the columns left are long, with more and more members of those components that have more than
        # that; what they leave is multiplied whole.
        large = scratch.save(comps.groupBy(F.col("c").alias("comp")).agg(F.count("*").alias("size")).where(F.col("size") > pivots), "large")
        last = some[1] <= LONG * some[0] or not found_more or large.isEmpty()
        before = Window.partitionBy("fp").orderBy("pos")
        rows = rows.select("*", *(F.coalesce(F.lag("h", k).over(before), F.lit(0)).alias(f"e{k}") for k in range(1, EARLIER + 1)))
        if last:
            rows = rows.withColumn("leads", F.lit(True))
        else:
            rows = rows.join(large, "comp", "left").where(F.col("size").isNull() | (F.pmod(F.xxhash64("fp"), "size") < pivots)).withColumn("leads", F.col("size").isNotNull())
            pivots *= 16
        columns = ["n", "fp", "pos", "blk", "comp", "leads", *(f"e{k}" for k in range(1, EARLIER + 1))]
        other = F.explode(F.sequence(F.lit(0), F.col("top")))
        dealt = rows.withColumn("o", other).select("h", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), *columns)
        pairs = dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "n", "fp").mapInArrow(_full, "a long, b long")
        new = scratch.save(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "tried")
        found = linked(new)
        found_more = last or not found.isEmpty()
        links, tried = links.unionAll(found), tried.unionAll(new)

    comps = scratch.save(components(links, scratch), "comps").withColumnsRenamed({"v": "fp", "c": "comp"})
    named = classes.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    ids = named.join(least, "comp").select("fp", "n", "comp", "component_id")
    linked = sets.where("n > 0 and doc_id is not null").join(ids, ["fp", "n"]).select("doc_id", "fp", F.col("n").alias("n_shingles"), "comp", "component_id")
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked, alone, clashes


def ngram_jaccard_components(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per row of docs: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach. A text that is null or has no word has no shingle and links with nothing;
    a text of under five words is one shingle. Equal sets always link. Rows with a null doc_id are returned with a null component and
    link with nothing. Rows are what links, so rows with one id but different texts may be in different components. Other columns are not read.
    """
    linked, alone, _ = _linked(docs, scratch or Scratch(docs.sparkSession))
    return linked.select("doc_id", "n_shingles", "component_id").unionAll(alone)


def _most_frequent(counts: DataFrame) -> list:
    """Rows (x, n) of the RANKED largest counts at most: a histogram of eighths of powers of two says from which count on."""
    level = F.floor(F.log2("n") * 8).cast("int")
    left, cut = RANKED, 1 << 30
    for r in sorted(counts.groupBy(level.alias("k")).count().collect(), reverse=True):  # 512 rows at most
        left -= r["count"]
        if left < 0:
            break
        cut = r.k
    return counts.where(level >= cut).collect()


def _matched(pairs: DataFrame, whole: DataFrame, columns: list[str]) -> DataFrame:
    sides = [whole.select(F.col("fp").alias(k), *(F.col(c).alias(c + k) for c in columns)) for k in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", *(c + k for c in columns for k in "ab"))


def _printed(clashes: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "_text"):
            sets = shingle_sets(*utf8(b.column(b.schema.get_field_index("_text"))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_name(_print(s), clashes) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], [*b.schema.names, "_fp", "_n"])

    return run


def ngram_jaccard_keep(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component a row with its smallest id stays, whole and with all columns. Rows of one id
    go only if their texts are equal or linked. Rows with a null id stay. Only rows whose id may be dropped or repeated are shuffled."""
    scratch = Scratch(docs.sparkSession)
    linked, alone, clashes = _linked(docs, scratch)
    found = linked.select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("own")).unionAll(alone.where("doc_id is not null").select("doc_id", F.lit(True).alias("own")))
    ids = scratch.save(found.groupBy("doc_id").agg(F.count("*").alias("m"), F.max("own").alias("own")), "ids")
    known = _known(ids.where("m > 1 or not own"), "doc_id")(F.col("doc_id"))
    doubtful = docs.where(known)
    kept = docs.where(~known).unionByName(doubtful.join(ids.where("m = 1 and own").select("doc_id"), "doc_id", "left_semi").select(*docs.columns))
    many = ids.where("m > 1").select("doc_id")
    if not many.isEmpty():  # which row of a repeated id stays is said by its set
        first = linked.where("doc_id = component_id").join(many, "doc_id", "left_semi").groupBy("comp").agg(F.min(F.struct("doc_id", "fp", "n_shingles")).alias("k"))
        first = first.select(F.col("k.doc_id").alias("_id"), F.col("k.fp").alias("_fp"), F.col("k.n_shingles").cast("long").alias("_n"))
        rows = doubtful.join(many, "doc_id", "left_semi").select(*docs.columns, F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
        rows = rows.mapInArrow(_printed(clashes), T.StructType([*rows.schema.fields, T.StructField("_fp", T.LongType()), T.StructField("_n", T.LongType())]))
        sets = rows.where("_n > 0").join(first, ["_id", "_fp", "_n"], "left_semi").dropDuplicates(["_id", "_fp", "_n"])
        empty = rows.where("_n = 0").dropDuplicates(["_id", "_text"])
        kept = kept.unionByName(sets.select(*docs.columns)).unionByName(empty.select(*docs.columns))
    return kept


#: The same in DuckDB's SQL: shingle sets, links by their overlaps, and components by reaching.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(c.c, d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) c ON c.v = d.doc_id
"""
