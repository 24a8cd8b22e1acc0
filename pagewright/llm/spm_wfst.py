"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiling reads the model file into three transducers:

* the normaliser: arcs from (state, space or other character) to (state, output), which
  write the space mark for a space and one in front of the text, where the model says so;
* the pieces: a trie whose arcs read characters; a node that ends a piece writes its id;
* the byte fallback: an arc for every character that is no piece, which writes the ids of
  its bytes (or unk).

An input is composed with them as it is read: its states are (position, last piece), its
arcs the pieces and fallbacks found at every position.  The path of least weight in the
tropical semiring (min, +) gives the ids; all arcs into a position are relaxed, for many
words side by side.

Weights.  For a unigram model an arc costs minus the piece's score.  A byte-pair model's
greedy merges are no sum of scores, so there the weight is on pairs of adjacent pieces:
0 if merging their characters alone ends in just these two pieces, else infinity.  A
sequence whose neighbours all cost 0 is what merging gives, and there is only one, so the
shortest path equals the library's ids, and of a position's states one at most has a
finite weight.  Whether a pair costs 0 follows from the two pieces' merge trees: going up
both edges along the cut in order of merge rank, no merge across the cut may come first.

Where no piece spans two neighbouring characters the lattice has one state, so it is cut
there.  Paths of words are remembered up to a fixed number.

User-defined pieces: a byte-pair model takes them out of the text first, the longest one from
the left, and merges nothing over them; in a unigram model their weight is 0.1, or less where some
score is positive.  Unknown characters that follow each other are one unk.  Models that mark spaces behind
words, have a character map, unused byte-pair pieces, or spaces in user-defined pieces are
refused: their ids would not be the library's.

Defined cases: null and empty texts have no ids; texts of any length are encoded whole;
characters the model cannot spell become byte pieces (or unk without byte fallback); the
space mark itself reads as a space, as in the library; equal texts get equal ids; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, sole_memory, trimmed
from .token_index import tokenizer_path

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the model format
UNIGRAM, BPE = 1, 2  # fixed values: model types
WORDS_KEPT, PAIRS_KEPT = 150_000, 1 << 19
SIDE_BY_SIDE = 1 << 15  # characters of new words whose paths are sought together; a longer word goes alone
INF = float("inf")
NONE, FALLBACK = -1, -2  # in place of a position's last piece


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("not a model file")
        yield tag >> 3, value


class Normaliser:
    """Arcs (state, is a space) to (state, output); COPY in an output stands for the character read."""

    START, INSIDE, GAP = range(3)
    COPY = "\0"
    _runs = re.compile(" +|[^ ]+")

    def __init__(self, dummy_prefix: bool, squeeze: bool) -> None:
        mark, copy = MARK if dummy_prefix else "", self.COPY
        if squeeze:  # spaces at the ends write nothing, others one mark before the next character
            self.arcs = {
                (self.START, True): (self.START, ""), (self.START, False): (self.INSIDE, mark + copy), (self.INSIDE, False): (self.INSIDE, copy),
                (self.INSIDE, True): (self.GAP, ""), (self.GAP, True): (self.GAP, ""), (self.GAP, False): (self.INSIDE, MARK + copy),
            }
        else:
            self.arcs = {(self.START, True): (self.INSIDE, mark + MARK), (self.START, False): (self.INSIDE, mark + copy), (self.INSIDE, True): (self.INSIDE, MARK), (self.INSIDE, False): (self.INSIDE, copy)}
        #: once inside, a letter-for-letter machine is one substitution
        self.by_letter = self.arcs[self.INSIDE, True] == (self.INSIDE, MARK) and self.arcs[self.INSIDE, False] == (self.INSIDE, copy)

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.by_letter:
            return self.arcs[self.START, text[0] == " "][1].replace(self.COPY, text[0]) + text[1:].replace(" ", MARK)
        state, out = self.START, []
        for run in self._runs.findall(text):
            space, at = run[0] == " ", 0
            while at < len(run):
                after, write = self.arcs[state, space]
                if after == state:  # a loop reads the rest of the run
                    out.append(run[at:] if write == self.COPY else write * (len(run) - at))
                    break
                out.append(write.replace(self.COPY, run[at]))
                state, at = after, at + 1
        return "".join(out)


class Trie:
    """Piece arcs: a table from (node, symbol) to node, and the piece that ends at a node."""

    def __init__(self, ids: dict[str, int]) -> None:
        letters = sorted({c for p in ids for c in p})
        self.symbol = np.full(0x110001, -1, np.int32)
        self.symbol[[ord(c) for c in letters]] = np.arange(len(letters))
        number, self.width = {c: k for k, c in enumerate(letters)}, len(letters)
        arcs: dict[int, int] = {}
        ends = {0: NONE}
        for p, k in ids.items():
            node = 0
            for c in p:
                node = arcs.setdefault(node * self.width + number[c], len(arcs) + 1)
                ends.setdefault(node, NONE)
            ends[node] = k
        self.ends = np.array([ends[k] for k in range(len(ends))], np.int32)
        bits = max(8, (4 * len(arcs)).bit_length())
        self.shift, self.keys, self.nodes = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys, nodes = np.array(list(arcs), np.int64), np.array(list(arcs.values()), np.int32)
        for key, slot, node in zip(keys.tolist(), self._slot(keys).tolist(), nodes.tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.nodes[slot] = key, node

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The nodes that the arcs lead to; -1 where there is none."""
        keys = nodes.astype(np.int64) * self.width + symbols
        slot = self._slot(keys)
        met = self.keys[slot]
        out = np.where(met == keys, self.nodes[slot], -1)
        out[symbols < 0] = -1
        left = np.flatnonzero((met != keys) & (met >= 0) & (symbols >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            met = self.keys[slot[left]]
            hit = met == keys[left]
            out[left[hit]] = self.nodes[slot[left[hit]]]
            left = left[~hit & (met >= 0)]
        return out

    def arcs(self, symbols: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in an input as (begin, end, piece), shorter ones first; ``end``: where the word of each position ends."""
        at, node, length, found = np.arange(len(symbols)), np.zeros(len(symbols), np.int32), 0, []
        while len(at):
            node = self.step(node, symbols[at + length])
            alive = node >= 0
            at, node, length = at[alive], node[alive], length + 1
            piece = self.ends[node]
            here = piece >= 0
            found.append((at[here], at[here] + length, piece[here]))
            more = at + length < end[at]
            at, node = at[more], node[more]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


class Transducer:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.dummy_prefix, self.squeeze, self.byte_fallback = UNIGRAM, True, True, False
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.types.append(got.get(3, NORMAL))
            elif number == 2:
                got = dict(_fields(value))
                self.kind, self.byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
                if got.get(24, 0):
                    raise NotImplementedError("only models that mark spaces in front of words")
            elif number == 3:
                got = dict(_fields(value))
                self.dummy_prefix, self.squeeze = bool(got.get(3, 1)), bool(got.get(4, 1))
                if got.get(2) or not got.get(5, 1):
                    raise NotImplementedError("only models without a character map, with marked spaces")
        if self.kind not in (UNIGRAM, BPE):
            raise NotImplementedError("only unigram and byte-pair models")
        normal = [self.scores[k] for k, kind in enumerate(self.types) if kind == NORMAL]
        own = {p: k for k, p in enumerate(self.pieces) if self.types[k] == USER}
        if any(MARK in p or " " in p for p in own):
            raise NotImplementedError("only user-defined pieces without spaces")
        if self.kind == BPE and UNUSED in self.types:
            raise NotImplementedError("only byte-pair models without unused pieces")
        self.ids = {p: k for k, p in enumerate(self.pieces) if self.types[k] == NORMAL}
        self.own = own if self.kind == BPE else {}
        if self.kind == UNIGRAM:
            self.ids |= own
        self.apart = re.compile("|".join(re.escape(p) for p in sorted(self.own, key=len, reverse=True))) if self.own else None
        self.unk = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.bytes = {int(p[1:-1], 16): k for k, p in enumerate(self.pieces) if self.types[k] == BYTE}
        letters = {c for p in self.ids for c in p}
        self.normalise = Normaliser(self.dummy_prefix, self.squeeze)
        self.trie = Trie(self.ids)
        self.by_word = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.cuts_lines = "\n" not in letters
        self.segment = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if self.cuts_lines else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.spelled = [self._spelling(k) for k in range(len(self.pieces))]
        if self.kind == BPE:
            self._compile_pairs()
            self.weights = np.where([e is None for e in self.left_edge], INF, 0.0)  # merging never makes some pieces
            self.fallback_weight = 1.0
        else:
            self.weights = -np.array(self.scores)
            for p, k in own.items():
                self.weights[k] = 0.1 - len(p.encode()) * max([0.0, *normal])
            self.fallback_weight = 10 - min(normal, default=0.0)
        self.forget()

    def _spelling(self, k: int) -> bytes:
        if self.types[k] == BYTE:
            return bytes([int(self.pieces[k][1:-1], 16)])
        return self.pieces[k].replace(MARK, " ").encode() if self.types[k] in (NORMAL, USER) else b" \xe2\x81\x87 " if k == self.unk else b""

    # --- weights of adjacent pieces in a byte-pair model ---

    def _merge_tree(self, piece: str) -> list | None:
        """The piece as merging its characters builds it: [text, left, right]; None if it ends in several."""
        nodes: list[list] = [[c, None, None] for c in piece]
        while len(nodes) > 1:
            best, at = None, -1
            for k in range(len(nodes) - 1):
                i = self.ids.get(nodes[k][0] + nodes[k + 1][0])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return None
            nodes[at : at + 2] = [[nodes[at][0] + nodes[at + 1][0], nodes[at], nodes[at + 1]]]
        return nodes[0]

    def _compile_pairs(self) -> None:
        """For every piece the parts along its left and right edge, from the character up, each with the rank at
        which it is merged away (rank: minus the score, so smaller merges first; the whole piece never is)."""
        self.left_edge: list[list[tuple[str, float]] | None] = [None] * len(self.pieces)
        self.right_edge = list(self.left_edge)
        same: dict[tuple[str, float], tuple[str, float]] = {}  # pieces share most parts, and every worker holds them all
        for piece, k in self.ids.items():
            tree = self._merge_tree(piece)
            if tree is None:
                continue  # no input is ever merged into it
            for edge, side in ((self.left_edge, 1), (self.right_edge, 2)):
                parts, node, rank = [], tree, INF
                while node:
                    parts.append(same.setdefault((node[0], rank), (node[0], rank)))
                    node, rank = node[side], -self.scores[self.ids[node[0]]] if node[1] else INF
                edge[k] = parts[::-1]

    def _stays(self, a: int, b: int) -> bool:
        """Whether merging a's and b's characters together ends in a, b."""
        left, right = self.right_edge[a], self.left_edge[b]
        i = j = 0
        while True:
            (x, away_x), (y, away_y) = left[i], right[j]
            across = self.ids.get(x + y)
            if across is not None:
                rank = -self.scores[across]
                if rank < away_x and rank <= away_y:  # of equal ranks the leftmost merges first
                    return False
            if away_x == INF and away_y == INF:
                return True
            if away_x <= away_y:
                i += 1
            else:
                j += 1

    def _pair_weights(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """0 or infinity for every pair; those seen stay in a table of fixed size."""
        keys = a.astype(np.int64) * len(self.pieces) + b
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (PAIRS_KEPT - 1).bit_length())).astype(np.int64)
        new = self.pair_keys[slot] != keys
        out = self.pair_weights[slot]
        if new.any():
            fresh, where = np.unique(keys[new], return_inverse=True)
            weights = np.array([0.0 if self._stays(*divmod(k, len(self.pieces))) else INF for k in fresh.tolist()])
            out[new] = weights[where]
            self.pair_keys[slot[new]], self.pair_weights[slot[new]] = keys[new], weights[where]
        return out

    # --- composition and shortest path ---

    def compose(self, words: Sequence[str]) -> tuple[np.ndarray, ...]:
        """The lattice of normalised words, one after the other: text (code points), arcs (begin, end, piece, weight), and
        the positions that no piece spans.  Fallback arcs write FALLBACK."""
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.trie.symbol[text]
        begin, end, piece = self.trie.arcs(symbols, np.repeat(np.cumsum(sizes), sizes))
        single = np.zeros(len(text), bool)
        single[begin[end == begin + 1]] = True
        spelled = np.flatnonzero(~single)
        weight = np.concatenate([np.full(len(spelled), self.fallback_weight), self.weights[piece]])
        begin, end = np.concatenate([spelled, begin]), np.concatenate([spelled + 1, end])
        piece = np.concatenate([np.full(len(spelled), FALLBACK), piece])
        real = weight < INF
        reach = np.zeros(len(text) + 1, np.int64)
        np.maximum.at(reach, begin, end)
        reach = np.maximum.accumulate(reach)
        cut = np.flatnonzero(np.concatenate([[True], reach[:-1] <= np.arange(1, len(text) + 1)]))
        return text, begin[real], end[real], piece[real], weight[real], cut

    def shortest(self, words: Sequence[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of the shortest path through each word's lattice."""
        text, begin, end, piece, weight, cut = self.compose(words)
        n = len(text)
        cost, last, back = np.full(n + 1, INF), np.full(n + 1, NONE), np.zeros(n + 1, np.int64)
        # arcs by the distance of their end from the cut before: all parts advance together
        starts = np.zeros(n + 1, np.int64)
        starts[cut] = cut
        starts = np.maximum.accumulate(starts)
        depth = end - starts[end - 1]
        order = np.argsort(depth, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(depth, minlength=1))])
        begin, end, piece, weight = begin[order], end[order], piece[order], weight[order]
        is_cut = np.zeros(n + 1, bool)
        is_cut[cut] = True
        for d in range(1, len(bounds) - 1):
            b, e, t, w = (x[bounds[d] : bounds[d + 1]] for x in (begin, end, piece, weight))
            inside = ~is_cut[b]
            c = w + np.where(inside, cost[b], 0.0)
            if self.kind == BPE:
                before = last[b]
                pairs = np.flatnonzero(inside & (before >= 0) & (t >= 0) & (c < INF))
                c[pairs] += self._pair_weights(before[pairs], t[pairs])
            np.minimum.at(cost, e, c)
            best = np.flatnonzero((c == cost[e]) & (c < INF))
            last[e[best]], back[e[best]] = t[best], b[best]
        return self._read(words, text, last, back)

    def _read(self, words: Sequence[str], text: np.ndarray, last: np.ndarray, back: np.ndarray) -> list[bytes]:
        """The ids along the paths, found from their ends."""
        on = np.zeros(len(text) + 1, bool)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = np.unique(ends[ends > 0])
        while len(at):
            on[at] = True
            at = back[at]
            at = at[(at > 0) & ~on[at]]
        stops = np.flatnonzero(on)
        ids, counts = last[stops], np.ones(len(stops), np.int64)
        spelled = np.flatnonzero(ids == FALLBACK)
        if len(spelled):
            codes = [self._fallback(chr(c)) for c in text[stops[spelled] - 1].tolist()]
            counts[spelled] = [len(c) for c in codes]
            ids = np.repeat(ids, counts)
            ids[ids == FALLBACK] = [k for c in codes for k in c]
        upto = np.concatenate([[0], np.cumsum(counts)])
        cuts = upto[np.searchsorted(stops, ends, side="right")].tolist()
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts)]

    def _fallback(self, c: str) -> list[int]:
        if self.byte_fallback:
            return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return [self.unk]

    def learn(self, words: set[str]) -> None:
        """Paths of words that are not known."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        self.known.update((w, self.own[w].to_bytes(4, "little")) for w in fresh if w in self.own)
        fresh = [w for w in fresh if w not in self.own] if self.own else fresh
        first = 0
        while first < len(fresh):
            last, size = first + 1, len(fresh[first])
            while last < len(fresh) and size + len(fresh[last]) <= SIDE_BY_SIDE:
                size += len(fresh[last])
                last += 1
            part = fresh[first:last]
            self.known.update(zip(part, self.shortest(part)))
            first = last

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        if self.kind == BPE:
            self.pair_keys, self.pair_weights = np.full(PAIRS_KEPT, -1, np.int64), np.zeros(PAIRS_KEPT)

    def _words(self, marked: str) -> list[str]:
        return self.segment.findall(marked) if self.by_word else [marked] if marked else []

    def _split(self, marked: str) -> list[str]:
        """Words of a normalised text; user-defined pieces are words of their own."""
        if not self.apart:
            return self._words(marked)
        out, at = [], 0
        for m in self.apart.finditer(marked):
            out += [*self._words(marked[at : m.start()]), m[0]]
            at = m.end()
        return out + self._words(marked[at:])

    def _one_unk(self, ids: bytes) -> bytes:
        """Unknown characters that follow each other are one unk, also across words."""
        if self.byte_fallback:
            return ids
        x = np.frombuffer(ids, "<u4")
        again = np.zeros(len(x), bool)
        again[1:] = (x[1:] == self.unk) & (x[:-1] == self.unk)
        return x[~again].tobytes() if again.any() else ids

    def encode_batch(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self._split(self.normalise(t)) if t else [] for t in texts]
        if self.by_word:
            self.learn({s for words in split for s in words})
            known = self.known
            return [self._one_unk(b"".join(map(known.__getitem__, words))) for words in split]
        own = {p: k.to_bytes(4, "little") for p, k in self.own.items()}
        return [self._one_unk(b"".join(own[w] if w in own else self.shortest([w])[0] for w in words)) for words in split]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        out = b"".join(map(self.spelled.__getitem__, ids))
        return out[1:] if self.dummy_prefix and out.startswith(b" ") else out

    def decode(self, ids: Sequence[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    sole_memory("pieces", _transducers.clear)  # the next step of a pipeline needs the room more than this one the time to compile
    if path not in _transducers:
        _transducers[path] = Transducer(path)
        let_go()  # compiling takes more than it leaves
    return _transducers[path]


CHUNK = 1 << 18


def encode(docs: DataFrame, model: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with ids, their number and digest, and whether decoding gives the text back."""
    kinds = dict(docs.dtypes)
    n = len(keep)
    names = ["piece_ids", "n_pieces", "ids_crc32", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            first = 0
            texts = batch.column(n).to_pylist()
            while first < len(texts):  # parts of about CHUNK characters, at least one row
                last, size = first, 0
                while last < len(texts) and size < CHUNK:
                    size += len(texts[last] or "")
                    last += 1
                part = texts[first:last]
                coded = t.encode_batch(part)
                ids = [np.frombuffer(c, "<u4") for c in coded]
                back = [t.decode_bytes(i.tolist()) == (x or "").encode("utf-8", "surrogatepass") for i, x in zip(ids, part)]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(k).slice(first, last - first) for k in range(n)], pa.ListArray.from_arrays(pa.array(offsets), flat),
                    pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array(back, pa.bool_()),
                ], [*[f"c{k}" for k in range(n)], *names])
                first = last

    schema = ", ".join([*[f"c{k} {kinds[c]}" for k, c in enumerate(keep)], "piece_ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean"])
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(trimmed(run), schema).toDF(*keep, *names)


def decode(df: DataFrame, model: str, ids: str = "piece_ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with the text that the ids spell; null ids give null."""
    kinds = dict(df.dtypes)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            texts = pa.array([None if i is None else t.decode(i) for i in batch.column(n).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(n)], texts], [*[f"c{k}" for k in range(n)], "text"])

    schema = ", ".join([*[f"c{k} {kinds[c]}" for k, c in enumerate(keep)], "text string"])
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(f"`{ids}`").alias("i"))
    return rows.mapInArrow(run, schema).toDF(*keep, "text")


MODEL = "piece_bpe_32k.model"


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, tokenizer_path(MODEL)).select("doc_id", "n_pieces", "ids_crc32", "round_trip")
