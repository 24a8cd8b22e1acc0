"""Token ids in binary shards, with keyed access through minimal perfect hash indexes.

Documents are partitioned by ranges of their id, sorted, encoded and written as shards
of raw little-endian ids (16 bits where the vocabulary fits, else 32), each document
followed by an end id.  Keys (document id, occurrence) are hashed into index parts; a
part is a minimal perfect hash function (levels of bit arrays, a key sits in the first
level in which it has a bit to itself; its slot is that bit's rank) over slots holding a
32-bit fingerprint, the shard, the offset and the length.  A lookup is a few hashes and
one slot, whatever the number of documents.

Shards and parts are written under a temporary name and renamed, with contents that do
not depend on the attempt, so a task that runs again leaves the same files.

Defined cases: null text counts as empty (the end id alone); a null id sorts first and
is a key of its own; rows with equal ids are occurrences 0, 1, ... in order of their
text; very long texts are encoded whole; an empty table gives no shards; other columns
of the input are not read.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import remove, shared_path, shuffle_partitions, sole_memory, written

MAGIC, PART_MAGIC = b"PWTOKEN1", b"PWINDEX1"
END_ID = 2
WORDS_KEPT, PIECES_KEPT = 500_000, 500_000
NUMBERED = 1 << 16  # occurrences of an id that one task numbers
SENTENCE_MARKS = frozenset(b"%c" % c for c in b".,;:!?")


# --- encoding -------------------------------------------------------------------------------

#: Words of printable ASCII and Latin letters: here normalising is lower-casing, and the
#: split rule can be applied outside the library.  Any other word goes through it whole.
_plain = regex.compile(r"[!-~¡-©«¬®-¹»-įı-ňŊ-ž]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes are themselves, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts by the tokenizers library, asked once a word.

    The vocabulary's normaliser and split rule never join what white space parts, so a
    text's ids are those of its words in order.  Words seen and their pieces are kept up
    to a fixed number; beyond it the memory starts afresh.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"]) if self.by_word else None
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        if any("<|" not in x for x in self.special) or sys.byteorder != "little":
            self.by_word = False

    def forget(self) -> None:
        self.words, self.pieces = {}, {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, raw: bytes) -> bytes:
        """Ids of one lower-case piece of the split rule."""
        ids = self.pieces.get(raw)
        if ids is None:
            letters = raw.decode("latin-1")
            if not raw.isalpha():
                letters = letters.translate(self.letters)
            ids = array(self.code, [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
            if len(self.pieces) >= PIECES_KEPT:
                self.pieces.clear()
            self.pieces[raw] = ids
        return ids

    def _word(self, raw: bytes) -> bytes:
        if raw.isalpha():  # ASCII letters
            return self._piece(raw.lower())
        if raw[:-1].isalpha() and raw[-1:] in SENTENCE_MARKS:
            return self._piece(raw[:-1].lower()) + self._piece(raw[-1:])
        word = raw.decode("utf-8", "replace")
        if not _plain.fullmatch(word) or ("<|" in word and any(s in word for s in self.special)):
            return self.whole(word)
        return b"".join([self._piece(p.encode()) for p in self.pattern.findall(word.lower())])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self.whole(text)
        words = text.encode("utf-8", "replace").split()
        known = self.words
        fresh = set(words).difference(known)
        if fresh:
            if len(known) >= WORDS_KEPT:  # those of this text stay
                known = self.words = {w: known[w] for w in set(words).difference(fresh)}
            for w in fresh:
                known[w] = self._word(w)
        return b"".join(map(known.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    sole_memory("words", lambda: [e.forget() for e in _encoders.values()])
    return _encoders[path]


# --- files ----------------------------------------------------------------------------------


def _put(path: str, name: str, chunks: Iterator[bytes]) -> None:
    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(base, recursive=True)
    final, partial = f"{base}/{name}", f"{base}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(partial) as out:
        for chunk in chunks:
            out.write(chunk)
    if fs.get_file_info(final).type != pafs.FileType.NotFound:
        fs.delete_file(final)  # left by an earlier attempt, with the same contents
    fs.move(partial, final)


def shard_name(k: int) -> str:
    return f"shard-{k:06d}.ids"


def _write_shard(batches: Iterator[pa.RecordBatch], path: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in order to one shard; yields its entries: id, occurrence here, shard, offset, length."""
    enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
    end = np.asarray([end_id], enc.dtype).tobytes()
    width = enc.dtype.itemsize
    entries: list[pa.RecordBatch] = []

    def chunks() -> Iterator[bytes]:
        yield MAGIC + struct.pack("<II", 1, width)
        at, last, times, first = 0, None, 0, True
        for batch in batches:
            coded = [enc.encode(t) + end for t in batch.column(1).to_pylist()]
            sizes = np.asarray([len(c) // width for c in coded], np.int64)
            offsets = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            occurrence = []
            for k in batch.column(0).to_pylist():
                times = times + 1 if not first and k == last else 0
                last, first = k, False
                occurrence.append(times)
            n = len(coded)
            entries.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array(occurrence, pa.int64()), pa.array(np.full(n, shard, np.int32)), pa.array(offsets), pa.array(sizes)], ENTRY_NAMES))
            yield b"".join(coded)

    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    rest = batches
    batches = (b for group in ([first], rest) for b in group)
    _put(path, shard_name(shard), chunks())
    yield from entries


ENTRY_NAMES = ["doc_id", "here", "shard", "offset", "n_tokens"]
ENTRIES = "doc_id long, here long, shard int, offset long, n_tokens long"


def write_shards(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes the shards under path; returns the entries (a written table) with
    ``start``, the number of ids before the document, and ``occurrence``."""
    spark = docs.sparkSession
    n = shards or shuffle_partitions(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("row", F.monotonically_increasing_id())
    # the further range keys part the rows of one hot id, and equal ones among them
    placed = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    entries, _ = written(placed.select("doc_id", "text").mapInArrow(lambda b: _write_shard(b, path, tokenizer, end_id), ENTRIES), "token-entries")
    # a row a shard from here: ids before it, and earlier rows with its first id; as ids are
    # in order these are the last rows of the shards before, as far as they end in that id
    per_shard = entries.groupBy("shard").agg(F.sum("n_tokens").alias("ids"), F.min_by("doc_id", "offset").alias("first_id"), F.max_by("doc_id", "offset").alias("last_id"), (F.max_by("here", "offset") + 1).alias("last_rows"))
    in_turn = W.partitionBy(F.lit(1)).orderBy("shard")
    of_id = W.partitionBy("last_id").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)
    per_shard = per_shard.withColumn("so_far", F.sum("last_rows").over(of_id))
    before = F.lag("so_far").over(in_turn)
    goes_on = F.lag("last_id").over(in_turn).eqNullSafe(F.col("first_id")) & before.isNotNull()
    starts = per_shard.select(
        F.col("shard").alias("s"), "first_id", F.coalesce(F.sum("ids").over(in_turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.when(goes_on, before).otherwise(F.lit(0)).alias("earlier"),
    )
    out = entries.join(starts, F.col("shard") == F.col("s")).select(
        "doc_id", (F.col("here") + F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("earlier")).otherwise(0)).alias("occurrence"),
        "shard", "offset", "n_tokens", (F.col("base") + F.col("offset")).alias("start"),
    )
    return out


# --- minimal perfect hash -------------------------------------------------------------------

GAMMA, LEVELS = 1.6, 64
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def key_hash(doc_id: pa.Array, occurrence: pa.Array) -> np.ndarray:
    ids = np.asarray(doc_id.fill_null(0)).astype(np.int64).view(np.uint64)
    null = np.asarray(doc_id.is_null())
    occ = np.asarray(occurrence).astype(np.uint64)
    with np.errstate(over="ignore"):
        return _mix(_mix(ids) + _mix(occ * _U(2) + null.astype(np.uint64)) * _U(0x9E3779B97F4A7C15))


class PerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1; other keys to anything or to -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        # rank directory: ones before each block of 512 bits
        ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % 64))).reshape(-1, 64).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(keys + _U(0x9E3779B97F4A7C15) * _U(level + 1)) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, -int(-len(left) * GAMMA // 64) * 64)
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def _rank(self, bit: np.ndarray) -> np.ndarray:
        block, byte = bit >> 9, bit >> 3
        out = self.before[block].copy()
        for k in range(64):  # whole bytes of the block in front of the bit's byte
            here = (block << 6) + k
            inside = here < byte
            if not inside.any():
                break
            out[inside] += np.bitwise_count(self.bits[here[inside]])
        return out + np.bitwise_count(self.bits[byte] & ((1 << (bit & 7)) - 1).astype(np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            bit = self.first[level] + self._place(keys[open_], level, size)
            hit = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            out[open_[hit]] = self._rank(bit[hit])
            open_ = open_[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys ^ _U(0xD6E8FEB86659FD93)) >> _U(32)).astype(np.uint32)


PART_KEYS = 1 << 19  # keys of an index part, at about the most
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("n", "<u8"), ("offset", "<u8"), ("start", "<u8")])


def part_name(k: int) -> str:
    return f"part-{k:06d}.idx"


def part_bytes(keys: np.ndarray, shard, offset, n, start) -> bytes:
    mph = PerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = mph.slots(keys)
    for name, values in (("fingerprint", fingerprint(keys)), ("shard", shard), ("n", n), ("offset", offset), ("start", start)):
        slots[name][at] = values
    head = json.dumps({"sizes": mph.sizes, "keys": len(keys)}).encode()
    return PART_MAGIC + struct.pack("<I", len(head)) + head + mph.bits.tobytes() + slots.tobytes()


class Part:
    def __init__(self, data: bytes) -> None:
        if data[:8] != PART_MAGIC:
            raise ValueError("not an index part")
        (size,) = struct.unpack_from("<I", data, 8)
        head = json.loads(data[12 : 12 + size])
        n_bits = sum(head["sizes"]) // 8
        self.mph = PerfectHash(head["sizes"], np.frombuffer(data, np.uint8, n_bits, 12 + size))
        self.slots = np.frombuffer(data, SLOT, head["keys"], 12 + size + n_bits)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, by its fingerprint, and its slot."""
        if not len(self.slots):
            return np.zeros(len(keys), bool), np.zeros(len(keys), SLOT)
        at = self.mph.slots(keys)
        got = self.slots[np.maximum(at, 0)]
        return (at >= 0) & (got["fingerprint"] == fingerprint(keys)), got


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of equal values of a sorted column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        v = np.asarray(batch.column(column))
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1), len(v)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(v[a]), batch.slice(a, b - a)


def _with_part(df: DataFrame, parts: int) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(parts)).cast("int"))


def build_index(entries: DataFrame, path: str, parts: int | None = None) -> int:
    """Writes the index parts under path; returns their number."""
    parts = parts or max(shuffle_partitions(entries.sparkSession), -(-entries.count() // PART_KEYS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, current, held = [], None, []

        def close() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            columns = [np.asarray(t.column(c)) for c in ("shard", "offset", "n_tokens", "start")]
            keys = key_hash(t.column("doc_id").combine_chunks(), t.column("occurrence").combine_chunks())
            _put(path, part_name(current), iter([part_bytes(keys, *columns)]))
            done.append(current)

        for part, rows in _runs(batches, 6):
            if part != current and held:
                close()
                held = []
            current = part
            held.append(rows)
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], ["part"])

    placed = _with_part(entries.select("doc_id", "occurrence", "shard", "offset", "n_tokens", "start"), parts)
    placed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "part int").agg(F.count(F.lit(1))).collect()
    return parts


def lookup(keys: DataFrame, path: str, parts: int) -> DataFrame:
    """(doc_id, occurrence) to shard, offset, n_tokens and start; keys that are not indexed get nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        current, part = None, None
        for k, rows in _runs(batches, 2):
            if k != current:
                name = f"{base}/{part_name(k)}"
                part = None
                if fs.get_file_info(name).type != pafs.FileType.NotFound:
                    with fs.open_input_stream(name) as f:
                        part = Part(f.read())
                current = k
            hashes = key_hash(rows.column(0), rows.column(1))
            ok, got = part.find(hashes) if part else (np.zeros(len(hashes), bool), np.zeros(len(hashes), SLOT))
            columns = [pa.array(got[c].astype(np.int64), mask=~ok) for c in ("shard", "offset", "n", "start")]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *columns], ["doc_id", "occurrence", "shard", "offset", "n_tokens", "start"])

    placed = _with_part(keys.select("doc_id", "occurrence"), parts)
    return placed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "doc_id long, occurrence long, shard long, offset long, n_tokens long, start long")


class ShardReader:
    def __init__(self, path: str) -> None:
        self.fs, self.base = pafs.FileSystem.from_uri(path)
        self.shard, self.file, self.dtype = None, None, None

    def ids(self, shard: int, offset: int, n: int) -> np.ndarray:
        if shard != self.shard:
            if self.file:
                self.file.close()
            self.file = self.fs.open_input_file(f"{self.base}/{shard_name(shard)}")
            head = self.file.read_at(16, 0)
            if head[:8] != MAGIC:
                raise ValueError("not a token shard")
            self.dtype = np.dtype(f"<u{struct.unpack_from('<I', head, 12)[0]}")
            self.shard = shard
        raw = self.file.read_at(n * self.dtype.itemsize, 16 + offset * self.dtype.itemsize)
        return np.frombuffer(raw, self.dtype)


def read_digests(found: DataFrame, path: str) -> DataFrame:
    """Lookup results to digests of the ids in the files; sorted by place, so shards are read forwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(path)
        for batch in batches:
            shard, offset, n = (batch.column(k).to_pylist() for k in (1, 2, 3))
            crc = [zlib.crc32(reader.ids(s, o, m).astype("<u4").tobytes()) for s, o, m in zip(shard, offset, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(3), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = found.filter("shard is not null").select("doc_id", "shard", "offset", "n_tokens", "start").repartition("shard").sortWithinPartitions("shard", "offset")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def all_keys(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, occurrence) of every row; the occurrences of a hot id are numbered by many tasks."""
    counts = docs.groupBy(F.col(f"`{doc_id}`").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    counts, _ = written(counts, "token-keys")
    few = counts.filter(F.col("n") <= NUMBERED).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("occurrence"))
    hot = counts.filter(F.col("n") > NUMBERED)
    if hot.isEmpty():
        return few
    parts = hot.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(NUMBERED).cast("long"))).alias("first"))
    parts = parts.repartition(shuffle_partitions(docs.sparkSession))
    last = F.least(F.col("n"), F.col("first") + NUMBERED) - 1
    return few.unionByName(parts.select("doc_id", F.explode(F.sequence("first", last)).alias("occurrence")))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_path(spark, "tokens")
    entries = write_shards(docs, f"{path}/shards", tokenizer_path("word_bpe_49k.json"))
    parts = build_index(entries, f"{path}/index")
    remove(spark, *{f.rpartition("/")[0] for f in entries.inputFiles()})  # the index holds all that they say
    return read_digests(lookup(all_keys(docs), f"{path}/index", parts), f"{path}/shards")
