"""Main text of web pages: structure, and a suffix array over all pages of a host.

A page becomes a stream of blocks of tokens. What stands in menus, headers, footers, sidebars, notices, adverts, forms, comments of
readers, scripts and styles goes. If the page marks its article (``article``, or else ``main``), what is left of it is the text.

Otherwise the host decides: the token streams of its pages are concatenated, a suffix array (built by prefix doubling) sorts all places
by their first ``LONG`` tokens, places whose next ``LONG`` tokens also stand in another page are covered, and covered runs are removed as
boilerplate; unique runs stay. Inside a marked article repetition is not held against the text: articles are copied between pages.

All hosts are searched, those whose pages all mark their article too. Pages are parsed where they are read, once for each pass, so that
nothing but the packed main texts (Zstandard) and the runs below is ever on disk. Texts are dealt to blocks of about ``BLOCK_BYTES``: a host
that fits is one block; a longer one is dealt by its pages' streams, so copies of a page meet in one block (a stream whose copies alone are
longer has blocks of its own). The suffix array runs over each block. Runs that two blocks of a host share are found by dealing a hash of
every run of ``LONG`` tokens, sorted and coded by differences, to buckets; what two blocks hold goes back to them. Both find the runs that
two different streams of the host share, so blocks do not show.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, steps, trim

#: Tokens of the shortest repeated run that is boilerplate: a power of two.
LONG = 8
#: Bytes of text whose suffix array is built at once.
BLOCK_BYTES = 8 << 20
#: Bytes of text whose runs are counted in one bucket.
BUCKET_BYTES = 16 << 20
#: Bytes of text that a task packs at once.
PACK_BYTES = 16 << 20
#: Hosts share this many slots, whose bytes say into how many blocks their hosts are dealt.
SLOTS = 1 << 20

_RAW = r"script|style|noscript|template|iframe|svg|math|object|textarea|select|title|head"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:{_RAW})\b[^>]*/>|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|[^<]+|<", re.S | re.I)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset("nav aside form footer menu dialog button search".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark what is no main text.
_MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail footer header masthead topbar "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond related recommended share sharing social "
    "contentinfo complementary search pagination pager toolbar widget alert".split()
)
#: Of these, the words that count inside a marked article, and those that make an article element itself no main text.
_INSIDE = _MARKED - frozenset("header footer masthead topbar banner side rail menu widget alert overlay contentinfo search complementary toolbar login signup notice notices promo promotion".split())
_NO_ARTICLE = frozenset("ad ads advert advertisement comment comments reply replies related recommended sponsored promo".split())
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


def _marked(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _DROP or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main") or "=" not in attrs:
        return False
    words = _NO_ARTICLE if tag == "article" else _INSIDE if in_article else _MARKED
    return any(w in words for m in _NAMES.finditer(attrs) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower()))


def blocks(page: str) -> tuple[list[str], bool]:
    """The blocks of a page's article, in order, and True; of a page that marks none, all blocks that structure leaves, and False."""
    out: dict[str, list[str]] = {"": [], "main": [], "article": []}
    piece: list[str] = []
    inside = {"article": 0, "main": 0}
    seen = {"article": False, "main": False}
    drop, depth = "", 0

    def flush():
        if piece:
            text = " ".join(entities.unescape("".join(piece)).split())
            piece.clear()
            if text:
                out["article" if inside["article"] else "main" if inside["main"] else ""].append(text)
                if inside["article"] and inside["main"]:
                    out["main"].append(text)
                if inside["article"] or inside["main"]:
                    out[""].append(text)

    for m in _TOKEN.finditer(page):
        tag = m[3] or m[6]
        if not tag:
            first = m[0][:1]
            if not drop and (first != "<" or m[0] == "<"):
                piece.append(m[0])
            elif not drop and m[1]:
                flush()
            continue
        tag, close, attrs = tag.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if drop in ("div", "section", "form") and tag in inside and not close and not any(inside.values()) and not _marked(tag, attrs, False):
            drop, depth = "", 0  # what holds the article was named after something beside it, or is a form about the whole page
        if drop:
            ends = close and (tag in ("body", "html") or tag in inside and inside[tag]) and tag != drop
            if not ends:
                if tag == drop and (close or not attrs.endswith("/")):
                    depth += -1 if close else 1
                    drop = drop if depth else ""
                continue
            drop, depth = "", 0  # an element that was never closed ends with what it stands in
        if tag == "br":
            piece.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if tag in _VOID:
            continue
        if not close and not attrs.endswith("/") and _marked(tag, attrs, inside["article"] > 0):
            drop, depth = tag, 1  # what is dropped inside a line does not end the line
        elif tag in inside:
            inside[tag] = max(0, inside[tag] + (-1 if close else 1))
            seen[tag] |= not close
    flush()
    for kind in ("article", "main"):
        if seen[kind]:
            return out[kind], True
    return out[""], False


def covered(streams: list[np.ndarray], also: np.ndarray | None = None) -> list[np.ndarray]:
    """For each page's token hashes which tokens lie in a run of LONG tokens that another page has too, or that starts at a place of ``also``
    (places in all streams, one after another)."""
    size = [len(s) for s in streams]
    n = sum(size)
    out = np.zeros(n + 1, np.int64)
    if n:
        rank = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64) + 1
        page = np.repeat(np.arange(len(size)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(n)
        k = 1
        while k < LONG:  # ranks of the first k tokens of every suffix, then of the first 2 k
            ahead = np.zeros(n, np.int64)
            ahead[: max(n - k, 0)] = rank[k:]
            ahead[left <= k] = 0
            rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
            k *= 2
        order = np.argsort(rank, kind="stable")  # the suffix array by the first LONG tokens; equal ones in page order
        r, p = rank[order], page[order]
        start = np.concatenate(([True], r[1:] != r[:-1]))
        group = np.cumsum(start) - 1
        first, last = p[start], p[np.concatenate((np.flatnonzero(start)[1:] - 1, [n - 1]))]
        hit = order[(first != last)[group]]
        hit = hit[left[hit] >= LONG]
        if also is not None:
            hit = np.union1d(hit, also)
        out[hit] += 1  # a place is there once
        out[hit + LONG] -= 1
    flags = np.cumsum(out[:-1]) > 0
    return np.split(flags, np.cumsum(size)[:-1]) if size else []


def streams(texts: list[str]) -> list[np.ndarray]:
    """The hashes of each text's tokens; each different token is hashed once."""
    words = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts if t], pa.large_string()), " ")
    coded = words.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    flat, offs = hashes[coded.indices.to_numpy()], words.offsets.to_numpy()
    found = iter(zip(offs[:-1], offs[1:]))
    return [flat[slice(*next(found))] if t else flat[:0] for t in texts]


_FACTORS = np.array([xxhash.xxh3_64_intdigest(f"run{k}") | 1 for k in range(2 * LONG + 2)], np.uint64)


def runs(stream: np.ndarray, host: int, second: bool = False) -> np.ndarray:
    """A hash of each run of LONG tokens of a host's page; second: another one, from other factors."""
    n, f = len(stream) - LONG + 1, _FACTORS[(LONG + 1) * second :]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, host % (1 << 64), np.uint64) * f[LONG]
    for k in range(LONG):
        out += stream[k : n + k] * f[k]
    return out


def packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, as differences by planes of bytes, compressed."""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return len(keys).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(planes), asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[4:], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _name(*of: int) -> int:
    """A signed 64-bit name of a block or a stream."""
    return xxhash.xxh3_64_intdigest(":".join(map(str, of))) - (1 << 63)


def _print(text: str) -> int:
    """A print of a text's stream."""
    return xxhash.xxh3_64_intdigest(text.replace("\n", " ")) - (1 << 63)


def _parsed(batches: Iterator[pa.RecordBatch], only: dict | None = None) -> Iterator[list[tuple]]:
    """Host's number, host, page_id, url, text, marked of each step's pages; only those of the slots named."""
    for b in steps(batches, "html"):
        if only is not None:
            b = b.filter(pa.array([n % SLOTS in only for n in b.column(0).to_pylist()], pa.bool_()))
        rows = []
        for *names, page in zip(*(c.to_pylist() for c in b.columns)):
            own, marked = blocks(page or "")
            rows.append((*names, "\n".join(own), marked))
        yield rows


def _together(parts: Iterator[list[tuple]], most: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for rows in parts:
        held += rows
        size += sum(len(r[4]) for r in rows)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _parsed(batches):
        cols = [r[0] for r in rows], [_print(r[4]) for r in rows], [len(r[4].encode()) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["number", "print", "bytes"])


def _counted(parts: dict[int, int], heavy: dict[tuple[int, int], int], buckets: int, own: range, most: int) -> Callable:
    """Of long hosts' pages, the runs by bucket (those of ``own``) and block: sorted hashes, each once, and the number of blocks to answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(_parsed(batches, parts), most):
            by: dict[tuple[int, int], dict] = {}
            for r in rows:
                p = _print(r[4])
                m = heavy.get((r[0], p), 0)
                by.setdefault((_name(r[0], p) if m else _name(r[0], 0, p % parts[r[0] % SLOTS]), m), {})[r[0], p] = r[4]
            out = []
            for (block, m), texts in by.items():
                each = [(runs(s, n), runs(s, n, True)) for (n, _), s in zip(texts, streams(list(texts.values())))]
                key, bucket = (np.concatenate(x) for x in zip(*each))
                bucket = (bucket >> np.uint64(33)) % np.uint64(buckets)
                mine = (bucket >= own.start) & (bucket < own.stop)
                key, bucket = key[mine], bucket[mine]
                order = np.lexsort((key, bucket))
                key, bucket = key[order], bucket[order]
                if len(key):
                    new = np.concatenate(([True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])))
                    key, bucket = key[new], bucket[new]
                    at = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(key)]
                    out += [(int(bucket[i]), block, m, packed(key[i:j])) for i, j in zip(at, at[1:])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["bucket", "block", "spread", "keys"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: for each block the hashes of its runs that another block holds too."""
    held, last = [], None

    def done():
        number: dict[tuple[int, int], int] = {}
        which = [number.setdefault((r[1], r[2]), len(number)) for r in held]
        each = [unpacked(r[3]) for r in held]
        key, block = np.concatenate(each), np.repeat(np.array(which, np.int32), [len(k) for k in each])
        order = np.lexsort((block, key))
        key, block = key[order], block[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))  # steps may send the same
        key, block = key[new], block[new]
        same = key[1:] == key[:-1]
        two = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        key, block = key[two], block[two]
        order = np.argsort(block, kind="stable")
        key, edges = key[order], np.searchsorted(block[order], np.arange(len(number) + 1))
        out = []
        for (name, m), i, j in zip(number, edges, edges[1:]):
            if i < j:
                data = packed(key[i:j])
                out += [(x, data) for x in ([_name(name, k) for k in range(m)] if m else [name])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], ["block", "data"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != last and held:
                yield done()
                held = []
            last = row[0]
            held.append(row)
    if held:
        yield done()


def _lines(text: str) -> list[str]:
    return text.split("\n") if text else []


def main_texts(pages: list[tuple[str, bool]], host: int = 0, repeated: np.ndarray | None = None) -> list[tuple[str, int]]:
    """The main text of each page of a host, and how many of its tokens stand in a run that another page has too. A page is what structure
    leaves of it (a line a block) and whether it marks its article. If pages are but a block of the host, ``repeated`` holds the hashes of
    the runs that other blocks of it have too.

    The lines of all pages make the streams; those of pages that mark no article lose their covered runs. Pages of equal streams are copies
    and count as one page.
    """
    number: dict[str, int] = {}
    which = [number.setdefault(text.replace("\n", " "), len(number)) for text, _ in pages]
    distinct = streams(list(number))
    also = None
    if repeated is not None and len(repeated):
        hashes = [runs(s, host) for s in distinct]
        starts = np.concatenate(([0], np.cumsum([len(s) for s in distinct])[:-1]))
        places = np.concatenate([np.arange(len(h)) + at for h, at in zip(hashes, starts)])
        also = places[np.isin(np.concatenate(hashes), repeated)].astype(np.int64)
    flagged = covered(distinct, also)
    out = []
    for (whole, marked), k in zip(pages, which):
        flags = flagged[k]
        if marked:
            out.append((whole, int(flags.sum())))
            continue
        kept, at = [], 0
        for text in _lines(whole):
            words = text.split(" ")
            gone = flags[at : at + len(words)].tolist()
            at += len(words)
            if not all(gone):
                kept.append(" ".join(w for w, x in zip(words, gone) if not x))
        out.append(("\n".join(kept), 0))
    return out


_OUT = "page_id long, url string, text string, n_chars long, n_repeated long"


def _dealt(parts: dict[int, int], heavy: dict[tuple[int, int], int], most: int) -> Callable:
    """Pages packed by block: host's number, host, page_id, url, text, marked of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for rows in _together(_parsed(batches), most):
            by: dict[int, list] = {}
            for k, r in enumerate(rows):
                n = parts.get(r[0] % SLOTS)
                p = _print(r[4]) if n else 0
                m = heavy.get((r[0], p)) if n else None
                by.setdefault(_name(_name(r[0], p), k % m) if m else _name(r[0], 0, p % n) if n else _name(r[0]), []).append(r)
            size, data = [], []
            for own in by.values():
                plain = json.dumps(own, ensure_ascii=False).encode()
                size.append(len(plain))
                data.append(codec.compress(plain, asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())], ["block", "size", "data"])

    return run


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; those without a size are its repeated runs. The pages of a block are held at a time."""
    held, repeated, last = [], [], None

    def done():
        keys = np.concatenate(repeated) if repeated else None
        hosts: dict[tuple[int, str], list] = {}
        for r in held:
            hosts.setdefault((r[0], r[1]), []).append(r)
        for (number, _), own in hosts.items():
            texts = main_texts([(r[4], r[5]) for r in own], number, keys)
            yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in own], pa.int64()), pa.array([r[3] for r in own], pa.string()), pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([n for _, n in texts], pa.int64())], ["page_id", "url", "text", "n_chars", "n_repeated"])

    codec = pa.Codec("zstd")
    for b in batches:
        for block, size, data in zip(*(c.to_pylist() for c in b.columns)):
            if block != last:
                yield from done()
                held, repeated, last = [], [], block
            if size is None:
                repeated.append(unpacked(data))
            else:
                held += json.loads(codec.decompress(data, size, asbytes=True))
    yield from done()
    trim()


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars, n_repeated (tokens of a marked article that other pages of the host
    repeat in long runs; they stay in the text), a row for each row of pages.

    A null html is empty and gives an empty text. Pages whose url is null or has no host are a host of their own. Other columns are not
    read. Rows may repeat; copies of one page count as one page. A page of any length is held by one worker while it is parsed.
    """
    ship(pages.sparkSession)
    scratch = Scratch(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    read = pages.select(F.xxhash64(host).alias("number"), host.alias("host"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sizes = scratch.save(read.mapInArrow(_sized, "number long, print long, bytes long"), "sizes").withColumn("slot", F.pmod("number", F.lit(SLOTS)))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    # both have a row for BLOCK_BYTES of text at most
    parts = {r.slot: -(-r.bytes // BLOCK_BYTES) for r in sizes.groupBy("slot").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > BLOCK_BYTES).collect()}
    heavy = {(r.number, r.print): -(-r.bytes // BLOCK_BYTES) for r in sizes.groupBy("number", "print").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > BLOCK_BYTES).collect()} if parts else {}
    dealt = read.mapInArrow(_dealt(parts, heavy, PACK_BYTES), "block long, size long, data binary")
    if parts:
        long = sizes.groupBy("slot").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > BLOCK_BYTES).agg(F.sum("bytes")).first()[0]
        buckets, rounds = -(-long // BUCKET_BYTES), -(-2 * long // total)  # a round's runs take about as much room as all packed texts
        edges = [buckets * k // rounds for k in range(rounds + 1)]
        for own in map(range, edges, edges[1:]):
            if own:
                counted = read.mapInArrow(_counted(parts, heavy, buckets, own, BUCKET_BYTES), "bucket int, block long, spread int, keys binary")
                repeated = scratch.save(counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "block long, data binary"), "repeated")
                del counted
                scratch.release()
                scratch.release()  # some of it is found unused only by the collector's second run
                dealt = dealt.unionByName(repeated, allowMissingColumns=True)
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_extracted, _OUT)
