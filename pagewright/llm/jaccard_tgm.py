"""N-gram Jaccard join by a token-group matrix.

A document's set holds the hashes of its distinct five-word shingles; two documents link
when 100 * intersection >= 75 * union.  All pairs of different sets that link are
connected, whatever their number, without writing out the pairs of a group:

1. Equal sets are one class, named by a hash of the set.
2. Shingles are counted over all documents.  Counts travel as packed sorted blocks, a
   range of hashes each.  The most frequent shingles (at most FREQUENT, whatever the
   input) are known to every task, so that shingles can be ordered rare first.  Ranges
   grow in number with the bytes of text, so what a task gets does not.
3. Of each class only the first n - ceil(3 n / 4) + l(n) shingles in that order are
   matched, with l(n) = max(1, n // 16): two sets that link share l of the smaller one
   among those.  Blocks again; a shingle in one class only falls away, and so does a
   class with fewer than l(ceil(3 n / 4)) shingles left.
4. Groups hold at most about GROUP classes of about one size with one leading class (that
   of most of their matched shingles).  Each is opened for its own members and gives the
   union of their shingles; links found so far make components.
5. Token-group matrix: it says which matched shingles occur in which group, and how many
   a member has left from there on, in one order of all shingles, rare first.  A link
   within the group's sizes takes so many common entries, so the first common one has as
   many left on either side: only there a class meets a group, and asks it if it holds
   another component.  Shingles that all of a large group have are among a set's last, so
   sets that cannot link do not meet there.  The group's stored union bounds the overlap
   with any of its members; only groups whose bound qualifies are opened, that is, meet
   their sets.
6. Of two components the smaller one asks.  Of a component about ASKING classes ask first,
   and the others only what is then left.

Links inside one component add nothing to it, and a group gives no more links than join
what it holds, so thousands of near copies cost each class its own group.  Step 5 leaves
out no other pair, so components are exact (up to 64-bit hashes).  ``similar_classes``
gives every pair of linked classes instead.

Defined cases: null, empty and blank texts have no shingles and are their own component;
fewer words than the shingle length make one shingle of all of them; equal ids are rows of their
own; a null id names no component (a component of null ids alone has a null id); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, row_hash, shuffle_partitions, small_batches, sole_memory, trimmed, written
from .components import connected_components

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
FREQUENT, LEAST_COUNT = 1 << 21, 4
GROUP, GROUP_SHINGLES, QUERIES, SIZE_STEP = 1024, 1 << 20, 2000, 1.15
ANCHORS, ASKING, FEW = 16, 16, 1 << 17
WORD = r"[^\x20\x09-\x0D]"
SHARED = 16  # of a set's shingles, one in so many must be shared with a linked set within the prefixes
FLUSH, MOST_HELD, SLICE, SLICE_BYTES = 1 << 19, 1 << 22, 256, 4 << 20
ROWS = 1 << 14  # in a batch that goes back to Spark
RANGE_BYTES = 64 << 20  # of text whose shingles one range of hashes holds
BLOOM_BITS, PAGE = 1 << 27, 1 << 15

# --- shingles -------------------------------------------------------------------------------

_rng = np.random.default_rng(58)
_weights = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
_low_bytes = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_places = [np.zeros(0, np.uint64)]


def _keys(n: int) -> np.ndarray:
    """A number for each place in a word."""
    if len(_places[0]) < n:
        _places[0] = _mix(np.arange(1, 1 << max(12, n.bit_length()), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _places[0]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each run of bytes other than white space.

    Eight bytes at a time are mixed with a number for their place, one to one, and added up:
    unlike a polynomial this has no family of long words that all get one hash.
    """
    n = len(raw)
    gaps = np.flatnonzero(_space[np.frombuffer(raw, np.uint8)])
    start = np.concatenate([[0], gaps + 1])
    size = np.concatenate([gaps, [n]]) - start
    start, size = start[size > 0], size[size > 0]
    if not len(start):
        return np.zeros(0, np.uint64)
    blocks = (size + 7) >> 3
    last = np.cumsum(blocks)
    first = last - blocks
    place = np.arange(last[-1]) - np.repeat(first, blocks)
    at = np.repeat(start, blocks) + (place << 3)
    v = np.ndarray((n + 1,), "<u8", raw + bytes(8), strides=(1,))[at]
    v[last - 1] &= _low_bytes[size - ((blocks - 1) << 3)]
    return _mix(np.add.reduceat(_mix(v ^ _keys(int(blocks.max()))[place]), first) + size.astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(n, words)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = h + w[k : n - width + 1 + k] * _weights[k]
    return np.unique(_mix(h))


def class_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def linked(overlap, a, b):
    return DENOMINATOR * overlap >= NUMERATOR * (a + b - overlap)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


# --- blocks ---------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, bytes of equal rank together, compressed."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<Q", blob)
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    n, out, at = size // sum(widths), [], 0
    for t, w in zip(types, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(t).ravel())
        at += n * w
    return out


def _steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def ranges_for(rows: DataFrame) -> int:
    """Ranges of hashes, one for about RANGE_BYTES of text, so that a range's task stays as it is while the input grows."""
    n = rows.agg(F.sum(F.octet_length("t").cast("decimal(38,0)"))).first()[0] or 0
    return max(shuffle_partitions(rows.sparkSession), -(-int(n) // RANGE_BYTES))


def held_at_most(ranges: int) -> int:
    """Shingles that a task holds before it writes blocks: more where there are many ranges, so that blocks do not get too small."""
    return min(max(FLUSH, 64 * ranges), MOST_HELD)


def _ranges(top: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """Slices by range of sorted 32-bit tops of hashes."""
    bounds = [-(-(k << 32) // n) for k in range(1, n)]
    cut = np.concatenate([[0], np.searchsorted(top, np.array(bounds, np.uint64).astype(top.dtype)), [len(top)]]) if n > 1 else np.array([0, len(top)])
    return [(k, slice(int(a), int(b))) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


def _sets(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int | None]]]:
    sole_memory("sets", lambda: None)
    for whole in batches:
        upto = np.cumsum(np.concatenate([[0], np.asarray(pc.fill_null(pc.binary_length(whole.column(column)), 0))]))
        k = 0
        while k < whole.num_rows:  # by bytes, at least one row
            end = min(max(int(np.searchsorted(upto, upto[k] + SLICE_BYTES, "right")) - 1, k + 1), k + SLICE, whole.num_rows)
            batch = whole.slice(k, end - k)
            sets = [shingles(t) for t in batch.column(column).to_pylist()]
            yield batch, sets, [class_id(s) if len(s) else None for s in sets]
            k = end


def _count_pass(batches: Iterator[pa.RecordBatch], ranges: int, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: id, set size, class; of kind 1: counts of shingle hashes in a range."""
    names = ["kind", "doc_id", "n", "cid", "rng", "blob"]
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0

    def blocks() -> pa.RecordBatch:
        top, counts = np.unique(np.concatenate(held), return_counts=True)
        parts = _ranges(top, ranges)
        blobs = [pack(_steps(top[s]), counts[s].astype(np.uint32)) for _, s in parts]
        m = len(parts)
        none = [None] * m
        return pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.array(none, key_type), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array([k for k, _ in parts], pa.int32()), pa.array(blobs, pa.binary())], names)

    for batch, sets, cids in _sets(batches, 1):
        m = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(cids, pa.int64()), pa.array([None] * m, pa.int32()), pa.array([None] * m, pa.binary())], names)
        for s, c in zip(sets, cids):
            if c is not None and c not in seen:
                seen.add(c)
                held.append((s >> np.uint64(32)).astype(np.uint32))
                size += len(s)
                if size >= held_at_most(ranges):
                    yield blocks()
                    held, size = [], 0
    if held:
        yield blocks()


def _sum_counts(blobs: pd.DataFrame, least: int) -> pd.DataFrame:
    """Of one range, the hashes counted at least so often: a block for each power of two of the count."""
    both = [np.cumsum(t, dtype=np.uint64) << np.uint64(32) | c for t, c in (unpack(b, np.uint32, np.uint32) for b in blobs["blob"])]
    both = np.concatenate(both)
    both.sort()  # hash and count in one number: sorted in place, without the order as an array beside it
    top = (both >> np.uint64(32)).astype(np.uint32)
    both &= np.uint64((1 << 32) - 1)
    new = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    top, total = top[new], np.add.reduceat(both, new).astype(np.uint32)
    rows = []
    keep = total >= least
    top, total = top[keep], total[keep]
    level = np.log2(np.maximum(total, 1)).astype(np.int32)
    for k in np.unique(level):
        here = level == k
        rows.append((int(k), int(here.sum()), pack(_steps(top[here]), total[here])))
    return pd.DataFrame(rows, columns=["level", "n", "blob"])


def _by_range(blocks: DataFrame, ranges: int, f: Callable[[pd.DataFrame], pd.DataFrame], columns: str) -> DataFrame:
    """f over all blocks (rng, blob) of each range.  A task gets one range (and of those from ``ranges`` on one more): dealt by
    their numbers, not by hashes of these, no task gets several."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, blob in zip(*(batch.column(i).to_pylist() for i in range(2))):
                held.setdefault(k, []).append(blob)
        for k in sorted(held):
            found = pa.RecordBatch.from_pandas(f(pd.DataFrame({"rng": k, "blob": held.pop(k)})), schema, preserve_index=False)
            for first in range(0, found.num_rows, ROWS):  # Spark holds a whole batch beside its heap
                yield found.slice(first, ROWS)

    return blocks.select("rng", "blob").repartitionById(ranges, F.col("rng")).mapInArrow(trimmed(run), columns)


def frequent(base: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent hashes and their counts: whole powers of two of the count, ``most`` hashes at the most."""
    blocks = base.filter("kind = 1")
    ranges = 1 + (blocks.agg(F.max("rng")).first()[0] or 0)
    levels, path = written(_by_range(blocks, ranges, lambda b: _sum_counts(b, LEAST_COUNT), "level int, n long, blob binary"), "shingle-counts")
    lowest, held = None, 0
    for r in levels.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        if held + r.n > most:
            break
        held, lowest = held + r.n, r.level
    tops, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    if lowest is not None:
        for r in levels.filter(F.col("level") >= lowest).select("blob").collect():
            t, c = unpack(r.blob, np.uint32, np.uint32)
            tops.append(np.cumsum(t, dtype=np.uint32))
            counts.append(c)
    remove(base.sparkSession, path)
    top, count = np.concatenate(tops), np.concatenate(counts)
    order = np.argsort(top)
    return top[order], count[order]


def least_shared(n: int) -> int:
    return max(1, n // SHARED)


def _least_shared(n):
    return F.greatest(F.lit(1), F.floor(n / SHARED))


def _shared_with(q, low, high):
    """How many prefix shingles a set of size q shares at least with a linked one of size low to high.

    Sizes q and m link at an overlap of o = 3 (q + m) / 7 or more.  Outside its prefix a
    set has ceil(3 n / 4) - l(n) shingles, so o less that many of the common ones, the
    first in order, are in its prefix; the smaller number of both sides counts.  For the
    asking set that number grows with m; for the other it falls by a quarter a step, give
    or take rounding by less than three, so its least is among the last 16 sizes.
    """
    low = F.greatest(low, F.ceil(q * NUMERATOR / DENOMINATOR)).cast("long")
    high = F.least(high, F.floor(q * DENOMINATOR / NUMERATOR)).cast("long")
    outside = lambda n: F.ceil(n * NUMERATOR / DENOMINATOR) - _least_shared(n)
    overlap = lambda m: F.ceil((q + m) * NUMERATOR / (NUMERATOR + DENOMINATOR))
    other = F.array_min(F.transform(F.sequence(F.greatest(low, high - 16), high), lambda m: overlap(m) - outside(m)))
    return F.least(overlap(low) - outside(q), other)


def prefix(tokens: np.ndarray, top: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles to match, rare first: those of no known count, then by count."""
    need = len(tokens) - -(-NUMERATOR * len(tokens) // DENOMINATOR) + least_shared(len(tokens))
    if not len(top):
        return tokens[:need], tokens[:0]
    mine = (tokens >> np.uint64(32)).astype(np.uint32)
    at = np.searchsorted(top, mine)
    at[at == len(top)] = 0
    known = top[at] == mine
    rare = tokens[~known][:need]
    if len(rare) == need:
        return rare, tokens[:0]
    often = tokens[known]
    return rare, often[np.lexsort((often, count[at[known]]))][: need - len(rare)]


def _prefix_pass(batches: Iterator[pa.RecordBatch], ranges: int, counted) -> Iterator[pa.RecordBatch]:
    """Blocks of (shingle, class, its size): the rare ones by range, the frequent ones by task, numbered from ``ranges``."""
    top, count = counted.value
    apart = ranges + TaskContext.get().partitionId() % ranges
    seen: set[int] = set()
    held: tuple[list, list] = ([], [])
    size = 0

    def block(tokens: np.ndarray, cid: np.ndarray, n: np.ndarray) -> bytes:
        own, first, where = np.unique(cid, return_index=True, return_inverse=True)
        a, b = pack(_steps(tokens), where.astype(np.uint32)), pack(own, n[first].astype(np.uint32))
        return struct.pack("<Q", len(a)) + a + b

    def flush() -> Iterator[pa.RecordBatch]:
        keys, blobs = [], []
        for kind, parts in enumerate(held):
            if not parts:
                continue
            counts = [len(t) for t, _, _ in parts]
            tokens = np.concatenate([t for t, _, _ in parts])
            order = np.argsort(tokens)
            tokens = tokens[order]
            cid = np.repeat(np.array([c for _, c, _ in parts], np.int64), counts)[order]
            n = np.repeat(np.array([m for _, _, m in parts], np.int64), counts)[order]
            cuts = [(apart, slice(0, len(tokens)))] if kind else _ranges((tokens >> np.uint64(32)).astype(np.uint32), ranges)
            keys += [k for k, _ in cuts]
            blobs += [block(tokens[x], cid[x], n[x]) for _, x in cuts]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["rng", "blob"])

    for _, sets, cids in _sets(batches, 0):
        for s, c in zip(sets, cids):
            if c is None or c in seen:
                continue
            seen.add(c)
            for parts, t in zip(held, prefix(s, top, count)):
                if len(t):
                    parts.append((t.copy(), c, len(s)))  # a view would hold the whole set
                    size += len(t)
            if size >= held_at_most(ranges):
                yield from flush()
                held, size = ([], []), 0
    yield from flush()


def _match(blobs: pd.DataFrame, ranges: int) -> pd.DataFrame:
    """Of one range, (shingle, class, size) where a shingle is in several classes; frequent shingles as they are."""
    tokens, cids, sizes = [], [], []
    for blob in blobs["blob"]:
        (size,) = struct.unpack_from("<Q", blob)
        t, where = unpack(blob[8 : 8 + size], np.uint64, np.uint32)
        own, n = unpack(blob[8 + size :], np.int64, np.uint32)
        tokens.append(np.cumsum(t, dtype=np.uint64))
        cids.append(own[where])
        sizes.append(n[where])
    token, cid, n = np.concatenate(tokens), np.concatenate(cids), np.concatenate(sizes)
    often = bool(blobs["rng"].iloc[0] >= ranges)
    if not often:
        order = np.lexsort((cid, token))
        token, cid, n = token[order], cid[order], n[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])
        token, cid, n = token[new], cid[new], n[new]
        same = token[1:] == token[:-1]
        several = np.zeros(len(token), bool)
        several[1:] |= same
        several[:-1] |= same
        token, cid, n = token[several], cid[several], n[several]
    return pd.DataFrame({"token": token.view(np.int64), "cid": cid, "n": n.astype(np.int64), "often": often})


# --- comparing sets -------------------------------------------------------------------------


def bloom(cids: DataFrame) -> np.ndarray:
    """A bit for the class ids, BLOOM_BITS wide whatever their number."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.asarray(batch.column(0)).astype(np.int64) & (BLOOM_BITS - 1)
            page = bit // PAGE
            ids = np.unique(page)
            rows = []
            for k in ids:
                bits = np.zeros(PAGE, bool)
                bits[bit[page == k] % PAGE] = True
                rows.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["page", "bits"])

    def either(b: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in b["bits"]])
        return pd.DataFrame({"page": b["page"][:1], "bits": [bits.tobytes()]})

    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in cids.mapInArrow(pages, "page long, bits binary").groupBy("page").applyInPandas(either, "page long, bits binary").collect():
        out[r.page * PAGE // 8 : (r.page + 1) * PAGE // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _set_pass(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    bits = wanted.value
    seen: set[int] = set()
    for _, sets, cids in _sets(batches, 0):
        rows = []
        for s, c in zip(sets, cids):
            if c is None or c in seen:
                continue
            seen.add(c)
            at = c & (BLOOM_BITS - 1)
            if bits[at >> 3] >> (at & 7) & 1:
                rows.append((c, len(s), pack(_steps(s))))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["cid", "n", "tokens"])


def _tokens(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64)[0], dtype=np.uint64)


class Group:
    """Members' sets side by side: overlaps with all of them from one look-up of a query's shingles."""

    def __init__(self, members: list[np.ndarray]) -> None:
        self.sizes = np.array([len(t) for t in members])
        tokens = np.concatenate(members)
        order = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(len(members)), self.sizes)[order]
        self.union, first = np.unique(tokens[order], return_index=True)
        self.first = np.append(first, len(tokens))

    def hits(self, q: np.ndarray) -> np.ndarray:
        """The members linked with q, by their numbers."""
        at = _within(self.union, q)
        if not qualifies(len(at), len(q), self.sizes.min()):
            return at[:0]
        counts = self.first[at + 1] - self.first[at]
        where = np.repeat(self.first[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        overlap = np.bincount(self.owner[where], minlength=len(self.sizes))
        return np.flatnonzero(linked(overlap, self.sizes, len(q)))


def _within(union: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Where in a union the shingles of q are that it has."""
    at = np.searchsorted(union, q)
    at[at == len(union)] = 0
    return at[union[at] == q]


def qualifies(bound: int, n: int, low: int) -> bool:
    """Whether a group that shares ``bound`` shingles with a set of n can hold a linked member, none being smaller than low."""
    smallest = max(low, -(-NUMERATOR * n // DENOMINATOR))
    return (NUMERATOR + DENOMINATOR) * bound >= NUMERATOR * (n + smallest)


class Forest:
    """Union-find: ``join`` says whether two nodes were apart until now."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def _pairs(found: list[tuple[int, int]]) -> list[pa.Array]:
    return [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())]


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns; of a run at most one batch is held at a time, so keys may come again."""
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))))
        at = 0
        while at < len(rows):
            end, key = at, rows[at][:keys]
            while end < len(rows) and rows[end][:keys] == key:
                end += 1
            yield key, [r[keys:] for r in rows[at:end]]
            at = end


OPENED = "a long, b long, g long, tokens binary"


def _own_groups(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Rows (group, own, class, set) in order: each group's links, a spanning forest or all, and the union of its own members."""
    current, held = None, []

    def close() -> pa.RecordBatch:
        tokens = [t for _, _, t in held]
        union = np.unique(np.concatenate([t for own, _, t in held if own]))
        found, forest, apart = [], Forest(), len(held) - 1
        group = Group(tokens) if apart else None
        for k, (_, c, t) in enumerate(held):
            if not apart and not every:
                break
            for j in group.hits(t) if group else ():
                if j < k and (joins := forest.join(int(j), k) | every):
                    found.append((c, held[j][1]))
                    apart -= joins
        n = len(found)
        a, b = _pairs(found)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([a, pa.nulls(1, pa.int64())]), pa.concat_arrays([b, pa.nulls(1, pa.int64())]),
            pa.concat_arrays([none, pa.array([current], pa.int64())]), pa.array([None] * n + [pack(_steps(union))], pa.binary()),
        ], ["a", "b", "g", "tokens"])

    for (g,), rows in _by_group(batches, 1):
        if g != current and held:
            yield close()
            held = []
        current = g
        # own members come first; a cut that has none is no group
        held += [(own, c, _tokens(blob)) for own, c, blob in rows if own or held]
    if held:
        yield close()


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, salt, role, class, component, least size, set) in order, first a group's union (role 0), then
    those that ask: the ones whose overlap with the union a link allows."""
    current, union, low = None, None, 0
    for key, rows in _by_group(batches, 2):
        out, blobs = [], []
        for role, c, comp, least, blob in rows:
            if role == 0:
                current, union, low = key, _tokens(blob), least
            elif key == current:
                q = _tokens(blob)
                if qualifies(len(_within(union, q)), len(q), low):
                    out.append((c, comp))
                    blobs.append(blob)
        q, comp = _pairs(out)
        yield pa.RecordBatch.from_arrays([q, comp, pa.array([key[0]] * len(out), pa.int64()), pa.array(blobs, pa.binary())], ["q", "comp", "g", "asking"])


def _open_groups(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Rows (group, salt, role, class, component, least size, set) in order, first the members (role 0), then those that
    ask: links between components, of which no more than join them, or all."""
    current, members, group, forest = None, [], None, Forest()
    for key, rows in _by_group(batches, 2):
        if key != current:
            current, members, group, forest = key, [], None, Forest()
        found: list[tuple[int, int]] = []
        for role, c, comp, _, blob in rows:
            if role == 0:
                members.append((c, comp, _tokens(blob)))
                continue
            if not members:
                continue
            group = group or Group([t for _, _, t in members])
            for k in group.hits(_tokens(blob)):
                m, other, _ = members[k]
                if (every and m != c) or (not every and forest.join(comp, other)):
                    found.append((c, m))
        yield pa.RecordBatch.from_arrays(_pairs(found), ["a", "b"])


def _grouped(matched: DataFrame) -> DataFrame:
    """(cid, n, step, grp, lead, cuts, cut, anchor): classes of about one size with one leading class make a group.

    Too many of them, or too long ones, are cut by hash into groups of about GROUP
    classes; about ANCHORS of them sit in all of these, so that the cuts find each other.
    """
    led = matched.groupBy("cid", "lead").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"))
    nodes = led.groupBy("cid").agg(F.max_by("lead", F.struct("shared", "lead")).alias("lead"), F.first("n").alias("n"))
    nodes, path = written(nodes.withColumn("step", F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).cast("int")), "jaccard-nodes")
    many = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)), F.ceil(F.sum("n") / F.lit(GROUP_SHINGLES)))
    cuts = nodes.groupBy("lead", "step").agg(many.cast("int").alias("cuts")).select(F.col("lead").alias("z_lead"), F.col("step").alias("z_step"), "cuts")
    nodes = nodes.join(cuts, (F.col("lead") == F.col("z_lead")) & (F.col("step") == F.col("z_step"))).drop("z_lead", "z_step")
    nodes = nodes.withColumn("cut", F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int"))
    anchor = (F.col("cuts") > 1) & (F.pmod(F.xxhash64("cid", F.lit("anchor")), F.ceil(F.col("cuts") * (GROUP / ANCHORS))) == 0)
    out, kept = written(nodes.withColumn("anchor", anchor).withColumn("grp", _group_name("cut")), "jaccard-groups")
    remove(matched.sparkSession, path)
    return out, kept


def _group_name(cut: str):
    return F.xxhash64("lead", "step", cut)


def _own_links(nodes: DataFrame, sets: DataFrame, every: bool) -> DataFrame:
    """Every group opened for its own members (OPENED)."""
    guests = nodes.filter("anchor").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).filter("at <> cut")
    seats = nodes.select("grp", F.lit(1).alias("own"), "cid").unionByName(guests.select(_group_name("at").alias("grp"), F.lit(0).alias("own"), "cid"))
    s = sets.select(F.col("cid").alias("s_cid"), "tokens")
    rows = seats.join(s, F.col("cid") == F.col("s_cid")).select("grp", "own", "cid", "tokens")
    return rows.repartition("grp").sortWithinPartitions("grp", F.desc("own"), "cid").mapInArrow(trimmed(lambda b: _own_groups(b, every)), OPENED)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df broadcast where it has no more than FEW rows of a few numbers; else Spark chooses."""
    return F.broadcast(df) if rows <= FEW else df


def _facing(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Rows (g, salt, role, cid, comp, low, tokens) in order: what a group holds (role 0) beside the classes that ask it.

    asked: (q, comp, g, asking); held: (grp, cid, comp, low, tokens).  Groups asked by
    many are held several times, each time for some of them.
    """
    salts = asked.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("int").alias("salts")).select(F.col("g").alias("k"), "salts")
    of = asked.join(salts, F.col("g") == F.col("k"))
    of = of.select("g", F.pmod(F.xxhash64("q"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("q").alias("cid"), "comp", F.lit(0).cast("long").alias("low"), F.col("asking").alias("tokens"))
    held = held.join(salts, F.col("grp") == F.col("k")).select(F.col("grp").alias("g"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "cid", "comp", "low", "tokens")
    return of.unionByName(held).repartition("g", "salt").sortWithinPartitions("g", "salt", "role")


def _mixed(entries: DataFrame) -> DataFrame:
    """Entries whose shingle is in several components, with ``tail``: how many of its class's there are from this one on.

    All classes have their entries in one order, rare shingles first, so two that share
    k entries have k or more left at the first of them.
    """
    tokens = entries.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("often"))
    tokens = tokens.filter("lo <> hi").select(F.col("token").alias("t"), "often")
    onwards = Window.partitionBy("cid").orderBy(F.desc("often"), F.desc("token"))
    return entries.join(tokens, F.col("token") == F.col("t")).withColumn("tail", F.row_number().over(onwards)).drop("t", "often")


def _asked_links(entries: DataFrame, nodes: DataFrame, unions: DataFrame, sets: DataFrame, every: bool = False, both_ways: bool = True) -> tuple[DataFrame, list[str]]:
    """Links that the classes marked ``ask`` find in groups of other components, by the token-group matrix.

    entries: (token, cid, n, comp, of, grp, ask, tail); nodes: (n_cid, n_comp, n_of, n_grp, n_n) of all classes,
    ``of`` being the number of classes in the component.  Of two classes the one in the smaller
    component (by size, then name) asks; with ``both_ways``, where only some of a
    component with more than ASKING classes ask, those ask in either case.
    """
    large = F.col("n_of") > ASKING
    spread = nodes.groupBy("n_grp").agg(
        F.min("n_n").alias("low"), F.max("n_n").alias("high"), F.max(F.struct("n_of", "n_comp")).alias("most"),
        F.min(F.when(large, F.col("n_comp"))).alias("one"), F.max(F.when(large, F.col("n_comp"))).alias("other"),
    )
    entries = entries.filter(F.col("tail") >= _least_shared(F.ceil(F.col("n") * NUMERATOR / DENOMINATOR)))  # what any link takes
    matrix = entries.groupBy("token", "grp").agg(F.max("tail").alias("g_tail")).join(spread, F.col("grp") == F.col("n_grp"))
    matrix = matrix.select(F.col("token").alias("g_token"), F.col("grp").alias("g"), "g_tail", "one", "other", "low", "high", "most")
    larger = F.struct(F.col("of").alias("n_of"), F.col("comp").alias("n_comp")) < F.col("most")
    if both_ways:
        larger = larger | ((F.col("of") > ASKING) & F.col("one").isNotNull() & ((F.col("one") != F.col("other")) | (F.col("one") != F.col("comp"))))
    meets = (F.col("token") == F.col("g_token")) & (F.col("grp") != F.col("g")) & (75 * F.col("low") <= 100 * F.col("n")) & (100 * F.col("high") >= 75 * F.col("n")) & larger
    meets = meets & (F.least("tail", "g_tail") >= _shared_with(F.col("n"), F.col("low"), F.col("high")))
    asked, p0 = written(entries.filter("ask").join(matrix, meets).select(F.col("cid").alias("q"), "comp", "g").distinct(), "jaccard-asked")
    n = asked.count()
    s = sets.select(F.col("cid").alias("s_cid"), "tokens")
    of = _few(asked, n).join(s, F.col("q") == F.col("s_cid")).select("q", "comp", "g", F.col("tokens").alias("asking"))
    none = F.lit(None).cast("long")
    lows = _few(spread.select(F.col("n_grp").alias("grp"), "low").join(_few(asked.select(F.col("g").alias("k")).distinct(), n), F.col("grp") == F.col("k"), "left_semi"), n)
    held = unions.join(lows, F.col("g") == F.col("grp")).select("grp", none.alias("cid"), none.alias("comp"), "low", "tokens")
    qualified, p1 = written(_facing(of, held).mapInArrow(trimmed(_bounded), "q long, comp long, g long, asking binary"), "jaccard-qualified")
    members = nodes.join(qualified.select("g").distinct(), F.col("n_grp") == F.col("g"))
    members = members.select(F.col("n_grp").alias("grp"), F.col("n_cid").alias("cid"), F.col("n_comp").alias("comp"), F.col("n_n").alias("low"))
    members = _few(members, members.count()).join(s, F.col("cid") == F.col("s_cid")).drop("s_cid")
    return _facing(qualified, members).mapInArrow(trimmed(lambda b: _open_groups(b, every)), "a long, b long"), [p0, p1]


def _in_components(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """nodes with their component and the number of classes in it."""
    of = parts.select(F.col("node").alias("p_node"), "component")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("of")).withColumnRenamed("component", "z")
    of = of.join(sizes, F.col("component") == F.col("z")).drop("z")
    out = nodes.join(of, F.col("cid") == F.col("p_node"), "left")
    return out.withColumn("comp", F.coalesce("component", "cid")).withColumn("of", F.coalesce("of", F.lit(1).cast("long"))).drop("p_node", "component")


def _as_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"n_{c}") for c in ("cid", "comp", "of", "grp", "n")])


def _entries(led: DataFrame, nodes: DataFrame) -> DataFrame:
    return led.select("token", F.col("cid").alias("m_cid")).join(nodes, F.col("m_cid") == F.col("cid")).drop("m_cid")


def _compared(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Of rows (doc_id, t): (doc_id, n, cid) of each, matched shingles with their leads, and the sets to compare."""
    spark = rows.sparkSession
    small_batches(spark)
    ranges = ranges_for(rows)
    key = dict(rows.dtypes)["doc_id"]
    key_type = rows.select("doc_id").limit(0).toArrow().schema.field(0).type
    texts = rows.select("t")

    base, p0 = written(rows.mapInArrow(trimmed(lambda b: _count_pass(b, ranges, key_type)), f"kind int, doc_id {key}, n long, cid long, rng int, blob binary"), "jaccard-sets")
    counted = spark.sparkContext.broadcast(frequent(base))
    kept, own = written(base.filter("kind = 0").select("doc_id", "n", "cid"), "jaccard-classes")
    remove(spark, p0)
    blocks = texts.mapInArrow(trimmed(lambda b: _prefix_pass(b, ranges, counted)), "rng int, blob binary")
    found, p1 = written(_by_range(blocks, ranges, lambda b: _match(b, ranges), "token long, cid long, n long, often boolean"), "jaccard-matched")
    counted.destroy()
    matched = found.filter("not often").drop("often").unionByName(found.filter("often").drop("often").distinct())
    alive = matched.groupBy("cid").agg(F.count(F.lit(1)).alias("left"), F.first("n").alias("of")).filter(F.col("left") >= _least_shared(F.ceil(F.col("of") * NUMERATOR / DENOMINATOR)))
    matched, p2 = written(matched.join(alive.select("cid"), "cid", "left_semi"), "jaccard-alive")
    remove(spark, p1)
    leads = matched.groupBy("token").agg(F.min("cid").alias("lead"), F.max("cid").alias("last")).filter("lead <> last").select(F.col("token").alias("t"), "lead")
    led, p3 = written(matched.join(leads, F.col("token") == F.col("t")).select("token", "cid", "n", "lead"), "jaccard-led")
    remove(spark, p2)
    bits = spark.sparkContext.broadcast(bloom(led.select("cid").distinct()))
    # a class that only shares its bit does no harm
    sets = texts.mapInArrow(trimmed(lambda b: _set_pass(b, bits)), "cid long, n long, tokens binary")
    sets, p4 = written(sets.groupBy("cid").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "jaccard-compared")
    bits.destroy()
    return kept, led, sets, [own, p3, p4]


def _components(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Of rows (doc_id, t): (doc_id, n, cid) of each, and (node, component) of the classes that link to another."""
    spark = rows.sparkSession
    kept, led, sets, (own, *paths) = _compared(rows)
    nodes, p0 = _grouped(led)
    opened, p1 = written(_own_links(nodes, sets, False), "jaccard-opened")
    links, unions = opened.filter("a is not null").select("a", "b"), opened.filter("g is not null").select("g", "tokens")
    parts, p2 = written(connected_components(links), "jaccard-parts")
    # some of each component ask first: mostly that joins what belongs together, and the rest has nothing to ask
    nodes = nodes.select("cid", "n", "grp")
    ask = F.pmod(F.xxhash64("cid", F.lit("ask")), F.ceil(F.col("of") / F.lit(ASKING))) == 0
    first, p3 = written(_in_components(nodes, parts).withColumn("ask", ask), "jaccard-nodes")
    entries, p4 = written(_mixed(_entries(led, first)), "jaccard-entries")
    more, used = _asked_links(entries, _as_nodes(first), unions, sets)
    more, p5 = written(more, "jaccard-links")
    parts, p6 = written(connected_components(links.unionByName(more)), "jaccard-parts")
    remove(spark, p2, *used)
    rest, p7 = written(_mixed(_in_components(entries.drop("comp", "of", "tail").withColumn("ask", ~F.col("ask")), parts)), "jaccard-entries")
    if not rest.filter("ask").isEmpty():
        last, used = _asked_links(rest, _as_nodes(_in_components(nodes, parts)), unions, sets, both_ways=False)
        last, p8 = written(last, "jaccard-links")
        if not last.isEmpty():
            remove(spark, p6)
            parts, p6 = written(connected_components(links.unionByName(more).unionByName(last)), "jaccard-parts")
        remove(spark, p8, *used)
    remove(spark, *paths, p0, p1, p3, p4, p5, p7)
    return kept, parts, [own, p6]


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join itself: every pair of linked classes (a < b), and the class of every row (doc_id, n_shingles, cid).

    A class is the rows with one set, so copies are not expanded into pairs.  Here every
    class asks every group whose entries and union qualify, of its own component or not.
    """
    kept, led, sets, _ = _compared(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")))
    nodes, _ = _grouped(led)
    opened, _ = written(_own_links(nodes, sets, True), "jaccard-opened")
    alone = nodes.select("cid", "n", "grp", F.col("cid").alias("comp"), F.lit(1).cast("long").alias("of"), F.lit(True).alias("ask"))
    more, _ = _asked_links(_mixed(_entries(led, alone)), _as_nodes(alone), opened.filter("g is not null").select("g", "tokens"), sets, True)
    pairs = opened.filter("a is not null").select("a", "b").unionByName(more)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs, kept.select("doc_id", F.col("n").alias("n_shingles"), "cid")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    kept, parts, _ = _components(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")))
    least = kept.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least")).select(F.col("cid").alias("c"), "least")
    of = least.join(parts, F.col("c") == F.col("node"), "left").select("c", "least", F.coalesce("component", "c").alias("comp"))
    least_of = of.groupBy("comp").agg(F.min("least").alias("component_id")).select(F.col("comp").alias("k"), "component_id")
    named = of.join(least_of, F.col("comp") == F.col("k")).select("c", "component_id")
    out = kept.join(named, F.col("cid") == F.col("c"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Filtering stage: of each component one row, the least by (id, nulls last; class; hash of the row).

    Ids may repeat or be null: rows are told apart by all their columns, and of rows
    equal in all of them one stays.  Rows without shingles are components of their own and stay.
    """
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    some = docs.filter(worded)
    keyed = some.withColumn("__nd_row", row_hash(docs))
    rows = keyed.select(F.struct(F.col("doc_id").alias("id"), F.col("__nd_row").alias("row")).alias("doc_id"), F.col("text").alias("t"))
    kept, parts, paths = _components(rows)
    # counted and reduced before every shuffle, so neither a hot id nor a hot text lands in one task
    same = kept.groupBy("cid", "doc_id.id", "doc_id.row").agg(F.count(F.lit(1)).alias("rows"))
    first = same.groupBy("cid").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "cid", "row", "rows")).alias("f"))
    of = first.join(parts, F.col("cid") == F.col("node"), "left").groupBy(F.coalesce("component", "cid")).agg(F.min("f").alias("f"))
    ids, _ = written(of.select(F.col("f.id").alias("__nd_id"), F.col("f.row").alias("__nd_of"), F.col("f.rows").alias("__nd_rows")), "jaccard-kept")
    remove(docs.sparkSession, *paths)
    joined = keyed.join(ids, (F.col("__nd_row") == F.col("__nd_of")) & F.col("doc_id").eqNullSafe(F.col("__nd_id")))
    single = joined.filter("__nd_rows = 1")
    if not ids.filter("__nd_rows > 1").isEmpty():
        single = single.unionByName(joined.filter("__nd_rows > 1").dropDuplicates(["__nd_of", "__nd_id"]))
    return single.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter(~worded))


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


