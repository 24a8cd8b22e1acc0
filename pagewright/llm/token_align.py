r"""Alignment of two tokenizers' tokens, as relations.

Tokens A are of space+text by a byte-level byte-pair tokenizer, tokens B of the text by a
SentencePiece model, which adds that space.  Both cover the same bytes, and where a token of
either ends at one byte the text is cut: what lies between two cuts is a group.  Two tokens are
linked if their byte ranges overlap.

How: tokens are exploded with their places, a window's running sum of their lengths gives their
ends, and A and B meet in a full equi-join on text and end, a row for each end of either.  Read from the end, the running count of
rows that both sides have numbers the groups, and the last id seen of either side is the token that
covers the bytes up to there.  Each row then is one link: two tokens overlap in a single range, and
that range ends where one of the two does.  So links are found without comparing a group's
tokens with each other, however long it is.

Units: neither tokenizer joins what a single space between two visible characters divides (A's
pattern starts a new word there; no piece of B has the mark inside), nor a letter and punctuation, a
letter and a digit, or a single line's end and what is visible around it, unless a piece of B holds
such neighbours (Seams).  So the tokens of a text are those of its units, one after the other, and every
boundary of units is a cut.  A unit has the space in front of it, if any; it is tokenized and
aligned once for all its occurrences, with their number as its weight.  Where a tokenizer is of
another kind, whole texts are units.

Back to documents: of the units, and of the pairs of ids, the most frequent ones within a budget
of bytes are broadcast; the others, of which none is frequent, are joined by a shuffle.  So no key
is hot, at any size: what is not broadcast occurs less than (bytes of all texts) / (budget) times.
A document's units become codes in one pass, and its groups are put together from them in another.

Defined cases: null and empty texts, and texts whose joined tokens are not space+text in either
tokenizer (as with the space mark itself in the text), have no tokens: zeros and no groups; rows
with equal ids, and equal rows, are documents of their own; a null id keeps its row; texts of any
length are whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import pickle
import time
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let_go, remove, shuffle_partitions, small_batches, sole_memory, trimmed, written
from .spm_wfst import MARK, NORMAL, USER, _fields
from .token_index import tokenizer_path

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BUDGET = 48 << 20  # bytes of what is broadcast
VISIBLE = r"[\p{L}\p{N}\p{P}\p{S}]"
BOUNDARY = f" (?<={VISIBLE} )(?={VISIBLE})"
TOKENS = "array<struct<b:boolean,id:int,n:int>>"
PART, TOGETHER = 1 << 20, 256  # characters, and units of a text, that are encoded at a time
BLOCK, COUNTED = 1 << 20, 24 << 20  # bytes that are divided, and whose units are counted, at a time
OTHER, LETTER, NUMBER, SIGN, QUOTE, SPACE, LINE, NEWER = range(8)  # classes of characters; those that are NEWER are visible too
UNUSED = 5  # type of a piece that is merged, then divided again


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level tokenizers write for bytes: visible Latin-1 as itself, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers in one worker, with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = byte_of_letter()
        self.bytes_a = [bytes(letters[c] for c in self.a.id_to_token(k) or "" if c in letters) for k in range(self.a.get_vocab_size())]
        pieces = [(self.b.id_to_piece(k), self.b.is_byte(k), self.b.is_control(k)) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if byte else b"" if control else p.replace(MARK, " ").encode() for p, byte, control in pieces]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int32) for t in (self.bytes_a, self.bytes_b))

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of either side of a text with a space in front, which B adds itself; None where they do not spell it."""
        ids_a, ids_b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        spelled = b"".join(map(self.bytes_a.__getitem__, ids_a)) == text.encode("utf-8", "surrogatepass") == b"".join(map(self.bytes_b.__getitem__, ids_b))
        return (np.array(ids_a, np.int32), np.array(ids_b, np.int32)) if spelled else None

    def _together(self, units: list[str], seams: Seams) -> tuple[np.ndarray, ...] | None:
        """A's ids and their number in each unit, then B's, of units that are tokenized as one text; None if a token crosses their bounds or they are spelled otherwise."""
        fronts = ["" if u[0] == " " else seams.front(u[0]) for u in units]
        found = self._ids("".join([x for pair in zip(fronts, units) for x in pair]))
        if found is None:
            return None
        lengths = np.array([(len(f), len(u) if u.isascii() else len(u.encode("utf-8", "surrogatepass"))) for f, u in zip(fronts, units)], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])  # front, unit, front, ..., end
        out = []
        for ids, sizes in zip(found, (self.sizes_a, self.sizes_b)):
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])
            at = np.searchsorted(ends, bounds)
            if (ends[at] != bounds).any():
                return None
            numbers = np.diff(at)
            out += [ids[np.repeat(np.arange(len(numbers)) % 2 == 1, numbers)], numbers[1::2]]
        return tuple(out)

    def _alone(self, unit: str, seams: Seams | None) -> tuple[np.ndarray, ...]:
        """As above for one unit, with no ids where they do not spell it."""
        if unit[0] != " ":
            return self._together([unit], seams) or (np.zeros(0, np.int32), np.zeros(1, np.int64)) * 2
        ids = self._ids(unit) or (np.zeros(0, np.int32),) * 2
        return tuple(x for i in ids for x in (i, np.array([len(i)])))

    def encode(self, units: list[str], seams: Seams | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all units A's ids, then B's: whether B's, the ids, and the number of ids of each unit.  Where texts divide, many are tokenized at once."""
        inside = np.array([seams is not None and (u[0] != " " or u[1:2].isprintable() and u[1:2] != " ") and u[-1] != " " and u[-1].isprintable() for u in units], bool)
        order, parts = [], []
        where = np.flatnonzero(inside)
        for first in range(0, len(where), TOGETHER):
            some = where[first : first + TOGETHER]
            found = self._together([units[k] for k in some.tolist()], seams)
            if found is None:
                inside[some] = False
            else:
                order.append(some)
                parts.append(found)
        for k in np.flatnonzero(~inside).tolist():
            order.append(np.array([k]))
            parts.append(self._alone(units[k], seams))
        places = np.concatenate(order)
        keys = np.concatenate([np.repeat(2 * places + side, np.concatenate([p[2 * side + 1] for p in parts])) for side in (0, 1)])
        ids = np.concatenate([p[2 * side] for side in (0, 1) for p in parts])
        by_unit = np.argsort(keys, kind="stable")
        keys = keys[by_unit]
        return keys % 2 == 1, ids[by_unit], np.bincount(keys // 2, minlength=len(units))


@lru_cache(1)
def _loaded(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """This worker's tokenizers, until another step of an operator needs its memory."""
    sole_memory("tokenizers", _loaded.cache_clear)
    return _loaded(path_a, path_b)


def _room_for_known() -> None:
    """The worker is past tokenizing: what that held goes back to the system."""
    if _loaded.cache_info().currsize:
        sole_memory("known units", lambda: None)
        let_go()


def divides_at_spaces(path_a: str, path_b: str) -> bool:
    """Whether both tokenizers are of the kinds whose tokens end at every BOUNDARY."""
    with open(path_a, encoding="utf-8") as f:
        a = json.load(f)
    before = a.get("pre_tokenizer") or {}
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    added = all(" " not in t["content"] and t.get("special") for t in a.get("added_tokens") or [])
    with open(path_b, "rb") as f:
        fields = list(_fields(f.read()))
    messages = {n: dict(_fields(v)) for n, v in fields if n in (2, 3)}
    pieces = [dict(_fields(v)) for n, v in fields if n == 1]
    inside = any(MARK in p.get(1, b"").decode().lstrip(MARK) for p in pieces if p.get(3, NORMAL) in (NORMAL, USER))
    rules = messages.get(3, {})  # no character map, a mark in front, spaces neither squeezed nor left as they are
    plain = not rules.get(2) and rules.get(3, 1) and not rules.get(4, 1) and rules.get(5, 1) and not messages.get(2, {}).get(24, 0)
    return bool(level and added and not a.get("normalizer") and plain and not inside)


def _free(spark: SparkSession, *paths: str) -> None:
    """Removes tables, and shuffle files once more when the events of the job just ended, which hold its plan, are past."""
    remove(spark, *paths)
    time.sleep(0.5)
    remove(spark)


def units_of(text: Column, divided: bool) -> Column:
    """A text between its BOUNDARY spaces.  Seams divide what stands between them further."""
    return F.split(text, BOUNDARY, -1) if divided else F.array(text)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every character below the last entry, which stands for all others.

    Only a class that a character has had since Unicode 3.2 counts: tokenizers know other versions.
    """
    old, kinds = unicodedata.ucd_3_2_0, {"L": LETTER, "N": NUMBER, "P": SIGN, "S": SIGN}
    out = np.zeros(0x30000, np.uint8)
    for k in range(len(out) - 1):
        kind = kinds.get(unicodedata.category(chr(k))[0], OTHER)
        out[k] = kind if kind == kinds.get(old.category(chr(k))[0], OTHER) else kind and NEWER
    out[[ord("'"), ord(" "), ord("\n")]] = QUOTE, SPACE, LINE
    return out


def _classed(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of whole UTF-8 characters belongs to."""
    known = classes()
    out = np.frombuffer(bytearray(data.tobytes().translate(known[:256].tobytes())), np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        head, last = data[lead], len(data) - 1
        more = [np.minimum(lead + k, last) for k in (1, 2, 3)]
        x, y, z = (data[m].astype(np.int32) & 0x3F for m in more)
        two, three, h = head < 0xE0, head < 0xF0, head.astype(np.int32)
        codes = np.where(two, (h & 0x1F) << 6 | x, np.where(three, (h & 0x0F) << 12 | x << 6 | y, (h & 0x07) << 18 | x << 12 | y << 6 | z))
        kinds = known[np.minimum(codes, len(known) - 1)]
        for at, some in zip([lead, *more], (slice(None), slice(None), ~two, ~three)):
            out[at[some]] = kinds[some]
    return out


@dataclass(frozen=True)
class Seams:
    """Where texts divide besides BOUNDARY spaces: between neighbours of these classes, and around a single line's end."""

    pairs: frozenset[tuple[int, int]]
    lines: bool

    def front(self, first: str) -> str:
        """What ends before a unit that begins so and has no space in front."""
        kind = int(_classed(np.frombuffer(first.encode("utf-8", "surrogatepass"), np.uint8))[0])
        if kind == LINE:
            return " x"
        return next(f for f, before in ((" x", LETTER), (" .", SIGN), (" 1", NUMBER), (" x\n", LINE)) if (before, kind) in self.pairs or before == LINE)

    def _tables(self) -> tuple[bytes, bytes]:
        """For each class whether it is visible, and for each 8 * class + next class whether a unit begins between."""
        visible, joint = bytearray(256), bytearray(256)
        for k in (LETTER, NUMBER, SIGN, QUOTE, NEWER):
            visible[k] = 1
        for x, y in self.pairs:
            joint[8 * x + y] = 1
        return bytes(visible), bytes(joint)

    def _starts(self, data: np.ndarray) -> np.ndarray:
        """Whether a unit begins at each byte, but for those of the first and last characters, which lack neighbours."""
        visible, joint = self._tables()
        c = _classed(data)
        v = np.frombuffer(c.tobytes().translate(visible), bool)
        starts = np.zeros(len(c), bool)
        starts[1:] = np.frombuffer((8 * c[:-1] + c[1:]).tobytes().translate(joint), bool)
        between = v[:-2] & v[2:]
        starts[1:-1] |= (c[1:-1] == SPACE) & between
        if self.lines:
            alone = np.flatnonzero((c[1:-1] == LINE) & between) + 1
            starts[alone] = starts[alone + 1] = True
        return starts

    def divide(self, texts: pa.Array) -> pa.ListArray:
        """The units of texts that begin with a space each: the same bytes between other bounds."""
        if not len(texts):
            return pa.array([], pa.list_(pa.string()))
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        data = np.frombuffer(texts.buffers()[2], np.uint8)[base : base + size] if size else np.zeros(0, np.uint8)
        begins = lambda k: next(x for x in range(k, size + 1) if x == size or data[x] & 0xC0 != 0x80)
        starts = np.zeros(size + 1, bool)
        for first in range(0, size, BLOCK):
            low, high = begins(max(0, first - 16)), begins(min(size, first + BLOCK + 16))
            last = min(size, first + BLOCK)
            starts[first:last] = self._starts(data[low:high])[first - low : last - low]
        starts[offsets - base] = starts[size] = True
        bounds = np.flatnonzero(starts).astype(np.int32)
        units = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(bounds, offsets - base), pa.int32()), units)


def seams_of(path_b: str) -> Seams:
    """Letters, numbers and signs part in A's pattern, but for what an apostrophe begins; in B where no piece holds such neighbours."""
    with open(path_b, "rb") as f:
        pieces = [dict(_fields(v)) for n, v in _fields(f.read()) if n == 1]
    text = "".join(" " + p.get(1, b"").decode().lstrip(MARK) + " " for p in pieces if p.get(3, NORMAL) in (NORMAL, USER, UNUSED))
    c = _classed(np.frombuffer(text.encode(), np.uint8)).tolist()
    kinds = {(x, y) for x in (LETTER, NUMBER, SIGN) for y in (LETTER, NUMBER, SIGN, QUOTE) if x != y and (x, y) != (SIGN, QUOTE)}
    return Seams(frozenset(kinds - set(zip(c, c[1:]))), LINE not in c)


def _units(texts: pa.Array, seams: Seams | None) -> pa.ListArray:
    """The units of each text, with the space that the tokenizers put in front; none for null."""
    spaced = pc.binary_join_element_wise("", texts, " ")
    if seams:
        return seams.divide(spaced)
    at = np.concatenate([[0], np.cumsum(pc.is_valid(texts).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), spaced.drop_null())


def count_units(texts: DataFrame, seams: Seams | None) -> DataFrame:
    """(u, n): every unit and its number, counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0

        def counts() -> pa.RecordBatch:
            found = pa.chunked_array(held, pa.string()).value_counts()
            return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["u", "n"])

        for batch in batches:
            held.append(_units(batch.column(0), seams).flatten())
            size += batch.column(0).nbytes
            if size >= COUNTED:
                yield counts()
                held, size = [], 0
        if held:
            yield counts()

    return texts.select("text").mapInArrow(trimmed(run), "u string, n long").groupBy("u").agg(F.sum("n").alias("n"))


def place_units(texts: DataFrame, seams: Seams | None) -> DataFrame:
    """(row, u): every unit of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(1), seams)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pc.list_parent_indices(units)), units.flatten()], ["row", "u"])

    return texts.select("row", "text").mapInArrow(trimmed(run), "row long, u string")


def encode_units(units: DataFrame, path_a: str, path_b: str, seams: Seams | None) -> DataFrame:
    """(unit, n, tokens) for rows (unit, u, n): A's tokens, then B's, with their lengths in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        for batch in batches:
            texts, first = batch.column(1).to_pylist(), 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and size < PART:
                    size += len(texts[last])
                    last += 1
                of_b, ids, numbers = t.encode(texts[first:last], seams)
                sizes = np.where(of_b, t.sizes_b[np.where(of_b, ids, 0)], t.sizes_a[np.where(of_b, 0, ids)]).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(numbers)])
                tokens = pa.StructArray.from_arrays([pa.array(of_b), pa.array(ids), pa.array(sizes)], ["b", "id", "n"])
                kept = [batch.column(k).slice(first, last - first) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens)], ["unit", "n", "tokens"])
                first = last

    return units.select("unit", "u", "n").mapInArrow(trimmed(run), f"unit long, n long, tokens {TOKENS}")


def align(encoded: DataFrame) -> DataFrame:
    """A row for each link, of rows (unit, n, tokens): (unit, n, end, grp, a, b, a_ends, b_ends), a unit's from its end.

    ``grp`` numbers the groups from the unit's last one; ``a_ends``: token a's last byte is here.
    Ends are unique on either side, so a row a unit and end is the sides' full equi-join; written as
    a grouping it leaves the table dealt by unit as it is, and the windows need no other shuffle.
    """
    dealt = encoded.repartition(2 * shuffle_partitions(encoded.sparkSession), "unit")
    rows = dealt.select("unit", "n", F.posexplode("tokens").alias("pos", "token")).select("unit", "n", "pos", "token.b", "token.id", F.col("token.n").alias("bytes"))
    so_far = Window.partitionBy("unit", "b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.select("unit", "n", F.sum("bytes").over(so_far).alias("end"), F.when(~F.col("b"), F.col("id")).alias("a_id"), F.when(F.col("b"), F.col("id")).alias("b_id"))
    met = ends.groupBy("unit", "end").agg(F.max("n").alias("n"), F.max("a_id").alias("a_id"), F.max("b_id").alias("b_id"))
    back = Window.partitionBy("unit").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    here = lambda c: F.last(c, True).over(back)
    a_ends, b_ends = F.col("a_id").isNotNull(), F.col("b_id").isNotNull()
    grp = F.sum(F.when(a_ends & b_ends, 1).otherwise(0)).over(back)
    return met.select("unit", "n", "end", grp.cast("int").alias("grp"), here("a_id").alias("a"), here("b_id").alias("b"), a_ends.alias("a_ends"), b_ends.alias("b_ends"))


def _joined_ids(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """Ids as text, joined by commas within the runs that begin at ``first``."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pc.cast(pa.array(ids), pa.string())), ",")


def _unit_rows(table: pa.Table) -> pa.RecordBatch:
    """Whole units' links, from the end, as a row a unit."""
    unit, n, grp, a, b, a_ends, b_ends = (np.ascontiguousarray(table.column(c).to_numpy()[::-1]) for c in ("unit", "n", "grp", "a", "b", "a_ends", "b_ends"))
    first = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1))
    new = np.diff(grp, prepend=grp[0] - 1) != 0
    new[first] = True
    group = np.cumsum(new) - 1  # of every link
    sides = [_joined_ids(x[ends], np.flatnonzero(np.diff(group[ends], prepend=-1))) for x, ends in ((a, a_ends), (b, b_ends))]
    whole = pc.binary_join_element_wise(*sides, "|")
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(group[first], len(whole)), pa.int32()), whole), ";")
    count = lambda x: np.add.reduceat(x.astype(np.int64), first)
    links = pa.ListArray.from_arrays(pa.array(np.append(first, len(a)), pa.int32()), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]))
    columns = [unit[first], n[first], count(a_ends), count(b_ends), count(new), np.diff(np.append(first, len(a)))]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), groups, links], ["unit", "n", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])


def gather(links: DataFrame) -> DataFrame:
    """A row for each unit, of align's rows: its numbers, its groups as text, and its links (a, b) in order.

    A unit's rows come one after the other, as the window left them, and only whole units are
    put together: the last unit of a batch waits for the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column(0).to_numpy()
            whole = int(np.flatnonzero(np.diff(unit, prepend=unit[0] - 1))[-1])  # rows before those of the last unit
            if whole or (held and held[-1].column(0)[0].as_py() != unit[0]):
                done = [*held, batch.slice(0, whole)]
                yield _unit_rows(pa.Table.from_batches(done))
                held = []
            held.append(batch.slice(whole))
        if held:
            yield _unit_rows(pa.Table.from_batches(held))

    rows = links.select("unit", "n", "grp", "a", "b", "a_ends", "b_ends")
    return rows.mapInArrow(trimmed(run), "unit long, n long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a:int,b:int>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, links, rows, best): how many links hold the pair, in how many of its units' links, and whether no other pair of b has more."""
    counted = aligned.select("n", F.explode("links").alias("x")).groupBy("x.a", "x.b").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("rows"))
    counted, _ = written(counted, "token-pairs")
    most = counted.groupBy(F.col("b").alias("m_b")).agg(F.max("links").alias("most"))  # a row an id of B's vocabulary
    return counted.join(F.broadcast(most), F.col("b") == F.col("m_b")).select("a", "b", "links", "rows", (F.col("links") == F.col("most")).alias("best"))


def _bucket(weight: str) -> Column:
    return F.floor(F.log2(F.col(weight)) * 4).cast("int")


def frequent_from(table: DataFrame, weight: str, size: Column, budget: int) -> int:
    """The bucket of weight from which on all entries fit into the budget.  A few hundred rows reach the driver."""
    left, bucket = budget, 4 * 64
    for r in table.groupBy(_bucket(weight).alias("bucket")).agg(F.sum(size).alias("bytes")).orderBy(F.desc("bucket")).collect():
        left -= r.bytes
        if left < 0:
            break
        bucket = r.bucket
    return bucket


def _split(table: DataFrame, weight: str, size: Column, budget: int) -> tuple[DataFrame, DataFrame]:
    """The entries that are broadcast, and the others."""
    bucket = frequent_from(table, weight, size, budget)
    return table.filter(_bucket(weight) >= bucket), table.filter(_bucket(weight) < bucket)


def score_units(aligned: DataFrame, pairs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(unit, n_best, count_sum): links whose pair is the most frequent of its b, and the sum of all links' counts."""
    pairs = pairs.select(F.col("a").alias("p_a"), F.col("b").alias("p_b"), F.col("links").alias("held"), "rows", "best")
    often, seldom = _split(pairs, "rows", F.lit(64), budget)
    links = aligned.select("unit", F.explode("links").alias("x")).select("unit", "x.a", "x.b")
    on = (F.col("a") == F.col("p_a")) & (F.col("b") == F.col("p_b"))
    scored = links.join(F.broadcast(often), on).unionByName(links.join(F.broadcast(often.select("p_a", "p_b")), on, "left_anti").join(seldom, on))
    return scored.groupBy("unit").agg(F.sum(F.when(F.col("best"), 1).otherwise(0)).alias("n_best"), F.sum("held").alias("count_sum"))


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@dataclass(frozen=True)
class Alignment:
    """documents: (row, doc_id, numbers, groups); units: (u, n, numbers, groups); aligned: their links; pairs: counts of id pairs."""

    documents: DataFrame
    units: DataFrame | None
    aligned: DataFrame | None
    pairs: DataFrame | None


# --- from units back to documents -----------------------------------------------------------


class _Known:
    """The broadcast units, and their groups and numbers by place.  Sent and kept on disk compressed."""

    def __init__(self, table: pa.Table) -> None:
        self.u, self.groups = (pa.concat_arrays(table.column(c).chunks) if table.num_rows else pa.array([], pa.string()) for c in ("k_u", "groups"))
        self.numbers = [table.column(c).to_numpy() if table.num_rows else np.zeros(1, np.int64) for c in NUMBERS]

    def __getstate__(self) -> bytes:
        raw = pickle.dumps((self.u, self.groups, self.numbers), 5)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    def __setstate__(self, state: bytes) -> None:
        raw = pa.decompress(state[8:], decompressed_size=int.from_bytes(state[:8], "little"), codec="zstd", asbytes=True)
        self.u, self.groups, self.numbers = pickle.loads(raw)


def _starts(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _packed(codes: np.ndarray) -> bytes:
    """Numbers of 32 bits, bytes of equal rank together, compressed: what a document's codes take on the way."""
    raw = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(codes).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    size = 4 * int.from_bytes(blob[:4], "little")
    raw = np.frombuffer(pa.decompress(blob[4:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _code(batches: Iterator[pa.RecordBatch], known, seams: Seams | None) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, text): each unit's place among the known ones, from 1, and 0 for the others, which follow as texts."""
    _room_for_known()
    table = known.value
    for batch in batches:
        units = _units(batch.column(2), seams)
        at, flat = _starts(units), units.flatten()
        places = pc.fill_null(pc.index_in(flat, table.u), -1).to_numpy() + 1
        other = places == 0
        upto = np.concatenate([[0], np.cumsum(other)])[at]
        codes = pa.array([_packed(places[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
        others = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat.filter(pa.array(other)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, others], ["row", "doc_id", "codes", "others"])


def _assemble(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, codes, groups of the others in order, their numbers): a document's numbers and groups."""
    _room_for_known()
    table = known.value
    for batch in batches:
        codes = [_unpacked(c) for c in batch.column(2).to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
        places = np.concatenate([*codes, np.zeros(0, np.uint32)]).astype(np.int32) - 1
        other = places < 0
        groups = pc.take(table.groups, pa.array(places, pa.int32(), mask=other))
        if other.any():
            groups = pc.replace_with_mask(groups, pa.array(other), batch.column(3).flatten())
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), groups), ";")
        numbers = []
        for k in range(len(NUMBERS)):
            upto = np.concatenate([[0], np.cumsum(np.where(other, 0, table.numbers[k][np.maximum(places, 0)]))])
            numbers.append(pa.array(np.diff(upto[at]) + pc.fill_null(batch.column(4 + k), 0).to_numpy()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, whole], ["row", "doc_id", *NUMBERS, "groups"])


def _documents(texts: DataFrame, known: DataFrame, seams: Seams | None, budget: int, *paths: str) -> DataFrame:
    """(row, doc_id, numbers, groups) of texts by their units; none for null texts.

    Known units within the budget are looked up where the texts are; the others of a document are
    joined by their text, and meet its codes by row.  The tables at ``paths`` go when they are used:
    texts first, then, where it is given, what is known.
    """
    spark = texts.sparkSession
    doc_id = dict(texts.dtypes)["doc_id"]
    small = [F.col(c).cast("long" if c == "count_sum" else "int").alias(c) for c in NUMBERS]
    entry = F.octet_length("k_u") + F.octet_length("groups") + 48
    often, seldom = _split(known.withColumnRenamed("u", "k_u"), "n", entry, budget)
    table = spark.sparkContext.broadcast(_Known(often.select("k_u", *small, "groups").toArrow()))
    none = F.array().cast("array<string>")
    coded, _ = written(texts.select("row", "doc_id", "text").mapInArrow(trimmed(lambda b: _code(b, table, seams)), f"row long, doc_id {doc_id}, codes binary, others array<string>"), "align-codes")
    _free(spark, *paths[:1])
    other = coded.select("row", F.posexplode("others").alias("pos", "u")).join(seldom, F.col("u") == F.col("k_u")).select("row", "pos", *small, "groups")
    other, _ = written(other, "align-others")
    _free(spark, *paths[1:])
    sums = [F.sum(c).alias(c) for c in NUMBERS]
    other = other.groupBy(F.col("row").alias("o_row")).agg(*sums, F.array_sort(F.collect_list(F.struct("pos", "groups"))).alias("parts"))
    met = coded.select("row", "doc_id", "codes").join(other, F.col("row") == F.col("o_row"), "left")
    groups = F.coalesce(F.transform("parts", lambda p: p.groups), none)
    columns = ", ".join(f"{c} long" for c in NUMBERS)
    return met.select("row", "doc_id", "codes", groups.alias("others"), *NUMBERS).mapInArrow(trimmed(lambda b: _assemble(b, table)), f"row long, doc_id {doc_id}, {columns}, groups string")


def _tokenized(texts: DataFrame, seams: Seams | None, path_a: str, path_b: str, budget: int) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(texts, null where their tokens do not spell them; units (unit, u, n) of the others; the units' tokens; paths of both)."""
    spark = texts.sparkSession
    filled = texts.filter("text is not null")
    counted = count_units(filled, seams)
    units, p0 = written(counted.select(F.monotonically_increasing_id().alias("unit"), "u", "n"), "align-units")
    _free(spark)
    encoded, p1 = written(encode_units(units, path_a, path_b, seams), "align-tokens")
    without = encoded.filter(F.size("tokens") == 0).select(F.col("unit").alias("w_unit"))
    if not without.head(1):
        return texts, units, encoded, [p0, p1]
    # whole texts go with such a unit: their other units must not be counted
    wrong, _ = written(units.join(without, F.col("unit") == F.col("w_unit"), "left_semi").select(F.col("u").alias("w_u"), "n"), "align-wrong")
    often, seldom = _split(wrong, "n", F.octet_length("w_u") + 64, budget)
    placed = place_units(filled, seams)
    holding = placed.join(F.broadcast(often), F.col("u") == F.col("w_u"), "left_semi").unionByName(placed.join(seldom, F.col("u") == F.col("w_u"), "left_semi"))
    good = texts.join(holding.select(F.col("row").alias("w_row")).distinct(), F.col("row") == F.col("w_row"), "left")
    good, _ = written(good.select("row", "doc_id", F.when(F.col("w_row").isNull(), F.col("text")).alias("text")), "align-good")
    remove(spark, p0, p1)
    return _tokenized(good, seams, path_a, path_b, budget)


def align_documents(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET, keep: bool = True) -> Alignment:
    """keep: whether units, their links and the pairs' counts stay as tables beside the documents."""
    spark = docs.sparkSession
    small_batches(spark)
    divided = divides_at_spaces(path_a, path_b)
    seams = seams_of(path_b) if divided else None
    t = F.col(f"`{text}`")
    # B reads the mark as a space, so a text that holds it is never spelled
    filled = F.when((t != "") & (~F.contains(t, F.lit(MARK)) if divided else F.lit(True)), t)
    texts, texts_path = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), filled.alias("text")), "align-texts")
    texts, units, encoded, paths = _tokenized(texts, seams, path_a, path_b, budget)
    aligned, aligned_path = written(gather(align(encoded)), "align-links")
    _free(spark, paths[1])
    pairs = pair_counts(aligned)
    _free(spark)
    scored = score_units(aligned, pairs, budget).withColumnRenamed("unit", "s_unit")
    numbers = aligned.drop("n", "links").withColumnRenamed("unit", "a_unit")
    known = units.join(numbers, F.col("unit") == F.col("a_unit")).join(scored, F.col("unit") == F.col("s_unit")).select("u", "n", *NUMBERS, "groups")
    known, known_path = written(known, "align-known")
    _free(spark, paths[0], *[] if keep else [aligned_path])
    used = [texts_path] if keep else [texts_path, known_path]
    side = (known, aligned, pairs) if keep else (None, None, None)
    return Alignment(_documents(texts, known, seams, budget, *used), *side)


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = align_documents(docs, tokenizer_path(MODEL_A), tokenizer_path(MODEL_B), keep=False).documents
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return found.select("doc_id", *NUMBERS, digest)
