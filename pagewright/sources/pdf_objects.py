"""Reading PDF files from bytes: objects, cross references, streams and page trees.

Standard library only.  Objects are Python values: Name for names, Ref for references,
dict and list, bytes for strings, and Stream.  Everything that cannot be read raises
PdfError with a short text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field


class PdfError(ValueError):
    pass


class Name(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Stream:
    dict: dict
    raw: bytes


class Word(str):
    """An operator or keyword."""

    __slots__ = ()


_WHITE = b"\x00\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
#: White space and comments, then a token, a name or a mark.
_NEXT = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*(?:([^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(<<|>>|[()<>\[\]{}]))?")
_CONSTANTS = {b"true": True, b"false": False, b"null": None}
_PLAIN = re.compile(rb"[^\\()]+")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_ESCAPED = re.compile(rb"#([0-9A-Fa-f]{2})")
_ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}
END = Word("")


class Lexer:
    def __init__(self, data: bytes, at: int = 0, document: Document | None = None) -> None:
        self.data, self.at, self.document = data, at, document

    def value(self):
        """The next object or keyword; END at the end."""
        m = _NEXT.match(self.data, self.at)
        self.at, kind = m.end(), m.lastindex
        if kind == 1:
            raw = m[1]
            if raw.isdigit():
                return int(raw)
            if _NUMBER.match(raw):
                return float(raw) if b"." in raw else int(raw)
            return _CONSTANTS[raw] if raw in _CONSTANTS else Word(raw.decode("latin-1"))
        if kind == 2:
            raw = m[2]
            if b"#" in raw:
                raw = _ESCAPED.sub(lambda h: bytes([int(h[1], 16)]), raw)
            return Name(raw.decode("utf-8", "replace"))
        if kind is None:
            return END
        mark = m[3]
        if mark == b"<<":
            items = self._items(">>")
            return {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}
        if mark == b"[":
            return self._items("]")
        if mark == b"(":
            self.at -= 1
            return self._string()
        if mark == b"<":
            self.at -= 1
            return self._hex()
        return Word(mark.decode())

    def _items(self, last: str) -> list:
        """Objects up to a closing mark or the end; two integers and an R are a reference."""
        out: list = []
        while True:
            v = self.value()
            if type(v) is Word:
                if v is END or v == last:
                    return out
                if v == "R" and len(out) >= 2 and type(out[-1]) is int and type(out[-2]) is int:
                    generation, number = out.pop(), out.pop()
                    v = Ref(number, generation)
            out.append(v)

    def _string(self) -> bytes:
        data, out, depth, at = self.data, bytearray(), 1, self.at + 1
        while at < len(data):
            m = _PLAIN.match(data, at)
            if m:  # a run of bytes that mean themselves
                out += m[0]
                at = m.end()
                continue
            c = data[at]
            at += 1
            if c == 0x5C and at < len(data):
                e = data[at]
                at += 1
                if e in _ESCAPES:
                    out += _ESCAPES[e]
                elif 48 <= e <= 55:
                    digits = _OCTAL.match(data, at - 1)[0]
                    at += len(digits) - 1
                    out.append(int(digits, 8) & 255)
                elif e in b"\r\n":
                    at += e == 13 and data[at : at + 1] == b"\n"
                else:
                    out.append(e)
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            out.append(c)
        self.at = at
        return bytes(out)

    def _hex(self) -> bytes:
        end = self.data.find(b">", self.at)
        if end < 0:
            raise PdfError("unterminated hex string")
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end])
        self.at = end + 1
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def object(self):
        """An indirect object's value: after its header, with its stream if it has one."""
        v = self.value()
        if type(v) is int:  # may be a reference
            mark = self.at
            g, r = self.value(), self.value()
            if type(g) is int and isinstance(r, Word) and r == "R":
                return Ref(v, g)
            self.at = mark
            return v
        if not isinstance(v, dict):
            return v
        mark = self.at
        word = self.value()
        if not (isinstance(word, Word) and word == "stream"):
            self.at = mark
            return v
        start = self.at
        start += 2 if self.data[start : start + 2] == b"\r\n" else 1
        size = self.document.resolve(v.get("Length")) if self.document else v.get("Length")
        if type(size) is not int or not self.data[start + size : start + size + 20].lstrip(_WHITE).startswith(b"endstream"):
            end = self.data.find(b"endstream", start)
            if end < 0:
                raise PdfError("stream without end")
            size = end - start
            size -= self.data[start : start + size].endswith(b"\r\n") + self.data[start : start + size].endswith((b"\n", b"\r"))
        return Stream(v, self.data[start : start + size])


def _unpredict(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    if kind < 2:
        return data
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        out = bytearray(data)
        for row in range(0, len(out), width):
            for k in range(row + step, min(row + width, len(out))):
                out[k] = out[k] + out[k - step] & 255
        return bytes(out)
    out, above = bytearray(), bytes(width)
    for at in range(0, len(data), width + 1):
        tag, line = data[at], bytearray(data[at + 1 : at + 1 + width])
        for k in range(len(line)):
            a = line[k - step] if k >= step else 0
            b = above[k] if k < len(above) else 0
            c = above[k - step] if k >= step else 0
            if tag == 1:
                add = a
            elif tag == 2:
                add = b
            elif tag == 3:
                add = a + b >> 1
            elif tag == 4:
                p = a + b - c
                add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                add = 0
            line[k] = line[k] + add & 255
        out += line
        above = bytes(line)
    return bytes(out)


def _lzw(data: bytes, early: int) -> bytes:
    table: list[bytes] = []
    out, buffer, held, width, before = bytearray(), 0, 0, 9, b""
    for byte in data:
        buffer, held = buffer << 8 | byte, held + 8
        while held >= width:
            code = buffer >> held - width & (1 << width) - 1
            held -= width
            if code == 256:
                table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return bytes(out)
            if not table:
                table = [bytes([k]) for k in range(256)] + [b"", b""]
            if code < len(table):
                entry = table[code]
            elif before:
                entry = before + before[:1]
            else:
                raise PdfError("bad LZW code")
            out += entry
            if before:
                table.append(before + entry[:1])
            before = entry
            width = max(9, min(12, (len(table) + early).bit_length()))
    return bytes(out)


def _ascii85(data: bytes) -> bytes:
    data = re.sub(rb"\s", b"", data.split(b"~>")[0]).removeprefix(b"<~")
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A and not group:
            out += bytes(4)
            continue
        group.append(c - 33)
        if len(group) == 5:
            out += sum(d * 85 ** (4 - k) for k, d in enumerate(group)).to_bytes(5, "big")[-4:]
            group = []
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += sum(d * 85 ** (4 - k) for k, d in enumerate(group)).to_bytes(5, "big")[-4:][: n - 1]
    return bytes(out)


def _run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


IMAGE_FILTERS = {"DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode"}
_HEADER = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj\b")


@dataclass
class Document:
    data: bytes
    places: dict[int, tuple] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    cache: dict[int, object] = field(default_factory=dict)
    opened: dict[int, tuple] = field(default_factory=dict)  # object streams: bytes, first, heads
    version: str = ""

    @classmethod
    def open(cls, data: bytes) -> Document:
        doc = cls(data)
        m = re.search(rb"%PDF-(\d+\.\d+)", data[:1024])
        if not m:
            raise PdfError("not a PDF file: invalid header")
        doc.version = m[1].decode()
        try:
            doc._cross_references()
            if not isinstance(doc.resolve(doc.trailer.get("Root")), dict):
                raise PdfError("no catalog")
        except (PdfError, RecursionError, IndexError, zlib.error, AttributeError, TypeError):
            doc._rebuild()
        if not isinstance(doc.resolve(doc.trailer.get("Root")), dict):
            raise PdfError("malformed PDF: no catalog")
        return doc

    @property
    def encrypted(self) -> bool:
        return self.trailer.get("Encrypt") is not None

    def resolve(self, v, depth: int = 0):
        while isinstance(v, Ref):
            if depth > 64:
                raise PdfError("reference loop")
            v, depth = self.load(v.number), depth + 1
        return v

    def load(self, number: int):
        if number in self.cache:
            return self.cache[number]
        place = self.places.get(number)
        out = None
        if place:
            self.cache[number] = None
            if place[0] == "at":
                m = _HEADER.match(self.data, _SKIP.match(self.data, place[1]).end())
                if m and int(m[1]) == number:
                    out = Lexer(self.data, m.end(), self).object()
            else:
                out = self._packed(place[1], place[2])
        self.cache[number] = out
        return out

    def _packed(self, container: int, index: int):
        if container not in self.opened:  # once, as each of its objects asks for it
            s = self.resolve(Ref(container, 0))
            if not isinstance(s, Stream):
                return None
            body, first = self.decode(s)[0], self.resolve(s.dict.get("First"))
            numbers = Lexer(body)
            self.opened[container] = body, first, [(numbers.value(), numbers.value()) for _ in range(self.resolve(s.dict.get("N")))]
        body, first, heads = self.opened[container]
        return Lexer(body, first + heads[index][1], self).object() if index < len(heads) else None

    def _cross_references(self) -> None:
        starts = [m for m in re.finditer(rb"startxref\s+(\d+)", self.data[-2048:])]
        if not starts:
            raise PdfError("no startxref")
        queue, seen = [int(starts[-1][1])], set()
        while queue:
            at = queue.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            lex = Lexer(self.data, at, self)
            first = lex.value()
            trailer = self._table(lex) if isinstance(first, Word) and first == "xref" else self._stream_table(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            queue += [trailer[k] for k in ("XRefStm", "Prev") if type(trailer.get(k)) is int]
        if "Root" not in self.trailer:
            raise PdfError("no root")

    def _table(self, lex: Lexer) -> dict:
        while True:
            start = lex.value()
            if type(start) is not int:
                break
            count = lex.value()
            for k in range(count):
                offset, _, use = lex.value(), lex.value(), lex.value()
                if isinstance(use, Word) and use == "n":
                    self.places.setdefault(start + k, ("at", offset))
        trailer = lex.value() if isinstance(start, Word) and start == "trailer" else None
        if not isinstance(trailer, dict):
            raise PdfError("no trailer")
        return trailer

    def _stream_table(self, at: int) -> dict:
        m = _HEADER.match(self.data, at)
        s = Lexer(self.data, m.end(), self).object() if m else None
        if not isinstance(s, Stream):
            raise PdfError("no cross references")
        widths, data = s.dict["W"], self.decode(s)[0]
        index = s.dict.get("Index") or [0, s.dict["Size"]]
        row = sum(widths)
        numbers = (n for a, c in zip(index[::2], index[1::2]) for n in range(a, a + c))
        for k, number in zip(range(0, len(data) - row + 1, row), numbers):
            fields_, here = [], k
            for w in widths:
                fields_.append(int.from_bytes(data[here : here + w], "big"))
                here += w
            kind = fields_[0] if widths[0] else 1
            if kind == 1:
                self.places.setdefault(number, ("at", fields_[1]))
            elif kind == 2:
                self.places.setdefault(number, ("in", fields_[1], fields_[2]))
        return s.dict

    def _rebuild(self) -> None:
        """Without usable cross references: every object header and trailer in the file."""
        self.places, self.cache, self.opened, self.trailer = {}, {}, {}, {}
        for m in _HEADER.finditer(self.data):
            self.places[int(m[1])] = ("at", m.start())
        for m in re.finditer(rb"\btrailer\b", self.data):
            t = Lexer(self.data, m.end(), self).value()
            if isinstance(t, dict):
                self.trailer |= t
        for number in list(self.places):
            try:
                v = self.load(number)
            except PdfError:
                continue
            if isinstance(v, Stream) and v.dict.get("Type") == "ObjStm":
                numbers = Lexer(self.decode(v)[0])
                for k in range(self.resolve(v.dict.get("N")) or 0):
                    inner, _ = numbers.value(), numbers.value()
                    self.places.setdefault(inner, ("in", number, k))
            elif isinstance(v, Stream) and v.dict.get("Type") == "XRef":
                for k, x in v.dict.items():
                    self.trailer.setdefault(k, x)
        if "Root" not in self.trailer:
            for number in list(self.places):
                v = self.load(number)
                if isinstance(v, dict) and v.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(number, 0)

    def decode(self, s: Stream) -> tuple[bytes, str]:
        """A stream's bytes up to the first image filter, and that filter's name or ''."""
        filters = self.resolve(s.dict.get("Filter", s.dict.get("F")))
        parms = self.resolve(s.dict.get("DecodeParms", s.dict.get("DP")))
        filters = [] if filters is None else filters if isinstance(filters, list) else [filters]
        parms = parms if isinstance(parms, list) else [parms]
        data = s.raw
        for k, f in enumerate(filters):
            f = self.resolve(f)
            p = self.resolve(parms[k]) if k < len(parms) else None
            p = {a: self.resolve(b) for a, b in p.items()} if isinstance(p, dict) else {}
            if f in ("FlateDecode", "Fl"):
                d = zlib.decompressobj()
                try:
                    data = d.decompress(data) + d.flush()
                except zlib.error as e:
                    raise PdfError(f"bad Flate data: {e}") from None
                data = _unpredict(data, p)
            elif f in ("LZWDecode", "LZW"):
                data = _unpredict(_lzw(data, p.get("EarlyChange", 1)), p)
            elif f in ("ASCIIHexDecode", "AHx"):
                data = Lexer(b"<" + data.split(b">")[0] + b">").value()
            elif f in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            elif f in ("RunLengthDecode", "RL"):
                data = _run_length(data)
            elif f in IMAGE_FILTERS or f in ("DCT", "CCF"):
                return data, str(f)
            elif f != "Crypt":
                raise PdfError(f"unknown filter {f}")
        return data, ""

    def pages(self) -> Iterator[dict]:
        """Page dictionaries in order, with inherited entries under ``inherited``."""
        root = self.resolve(self.trailer.get("Root"))
        stack = [(root.get("Pages"), {})]
        seen: set[int] = set()
        while stack:
            ref, inherited = stack.pop()
            if isinstance(ref, Ref):
                if ref.number in seen:
                    continue
                seen.add(ref.number)
            node = self.resolve(ref)
            if not isinstance(node, dict):
                continue
            mine = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            kids = self.resolve(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                stack += [(k, mine) for k in reversed(kids)]
            else:
                yield node | {"inherited": mine}
