"""Text of a page from its content streams: fonts, character maps, and lines.

A new line starts where the text position moves down or up by more than a third of the
font size, a space where a gap within a line is wider than a fifth of it.
"""

from __future__ import annotations

import re

from .pdf_objects import END, Document, Lexer, Name, PdfError, Stream, Word

_RANGE = re.compile(rb"begin(bfchar|bfrange|codespacerange)(.*?)end\1", re.S)


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace")


class Font:
    def __init__(self, doc: Document, spec: dict | None) -> None:
        spec = spec if isinstance(spec, dict) else {}
        self.wide = spec.get("Subtype") == "Type0"
        self.map: dict[bytes, str] = {}
        self.lengths = {2 if self.wide else 1}
        cmap = doc.resolve(spec.get("ToUnicode"))
        if isinstance(cmap, Stream):
            self._read_map(doc.decode(cmap)[0])
        encoding = doc.resolve(spec.get("Encoding"))
        self.codec = "mac_roman" if "MacRomanEncoding" in (encoding, (encoding or {}).get("BaseEncoding") if isinstance(encoding, dict) else None) else "cp1252"
        self.names: dict[int, str] = {}
        if isinstance(encoding, dict):
            code = 0
            for x in doc.resolve(encoding.get("Differences")) or []:
                x = doc.resolve(x)
                if type(x) is int:
                    code = x
                else:
                    self.names[code] = _glyph(str(x))
                    code += 1

    def _read_map(self, data: bytes) -> None:
        for kind, body in _RANGE.findall(data):
            lex, values = Lexer(body), []
            while (v := lex.value()) is not END:
                values.append(v)
            if kind == b"codespacerange":
                self.lengths = {len(v) for v in values if isinstance(v, bytes)} or self.lengths
            elif kind == b"bfchar":
                for code, text in zip(values[::2], values[1::2]):
                    if isinstance(code, bytes) and isinstance(text, bytes):
                        self.map[code] = _utf16(text)
            else:
                for low, high, to in zip(values[::3], values[1::3], values[2::3]):
                    n = len(low)
                    for k in range(int.from_bytes(low, "big"), min(int.from_bytes(high, "big"), int.from_bytes(low, "big") + 65535) + 1):
                        step = k - int.from_bytes(low, "big")
                        if isinstance(to, list):
                            text = _utf16(to[step]) if step < len(to) else ""
                        else:
                            text = _utf16((int.from_bytes(to, "big") + step).to_bytes(len(to), "big"))
                        self.map[k.to_bytes(n, "big")] = text

    def text(self, raw: bytes) -> str:
        if not self.wide and not self.map:  # every byte is a character
            return "".join([self.names.get(c) or bytes((c,)).decode(self.codec, "replace") for c in raw]) if self.names else raw.decode(self.codec, "replace")
        out, at = [], 0
        lengths = sorted(self.lengths)
        while at < len(raw):
            for n in lengths:
                hit = self.map.get(raw[at : at + n])
                if hit is not None:
                    break
            else:
                n = max(lengths) if self.wide else 1
                code = raw[at : at + n]
                hit = _utf16(code) if self.wide and not self.map else self.names.get(code[0]) or code.decode(self.codec, "replace") if n == 1 else ""
            out.append(hit)
            at += n
        return "".join(out)

    def advance(self, raw: bytes) -> float:
        """Estimated width in ems."""
        return 0.5 * len(raw) / (2 if self.wide else 1)


def _glyph(name: str) -> str:
    import unicodedata

    if len(name) == 1:
        return name
    m = re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name)
    if m:
        return chr(int(m[1] or m[2], 16))
    # Glyph names that are not those of the character they show.
    plain = {"space": " ", "hyphen": "-", "period": ".", "comma": ",", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "bullet": "•", "endash": "–", "emdash": "—", "fi": "ﬁ", "fl": "ﬂ"}
    if name in plain:
        return plain[name]
    digits = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
    if name in digits:
        return str(digits.index(name))
    m = re.fullmatch(r"([A-Za-z])(acute|grave|circumflex|dieresis|tilde|cedilla|ring|caron)", name)
    try:
        if m:
            mark = {"dieresis": "DIAERESIS", "ring": "RING ABOVE"}.get(m[2], m[2].upper())
            return unicodedata.lookup(f"LATIN {'SMALL' if m[1].islower() else 'CAPITAL'} LETTER {m[1]} WITH {mark}")
        return unicodedata.lookup(name.upper())
    except KeyError:
        return ""


def _times(m: list[float], n: list[float]) -> list[float]:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]


def contents(doc: Document, page: dict) -> bytes:
    c = doc.resolve(page.get("Contents"))
    parts = c if isinstance(c, list) else [c]
    return b"\n".join(doc.decode(s)[0] for s in map(doc.resolve, parts) if isinstance(s, Stream))


class Painter:
    """Runs a content stream for its text."""

    def __init__(self, doc: Document) -> None:
        self.doc = doc
        self.out: list[str] = []
        self.last: tuple[float, float, float] | None = None  # end of the text so far: x, y, size
        self.fonts: dict[int, Font] = {}

    def run(self, data: bytes, resources: dict, outer: list[float], depth: int = 0) -> None:
        doc, lex, args = self.doc, Lexer(data), []
        fonts = doc.resolve(resources.get("Font")) or {}
        objects = doc.resolve(resources.get("XObject")) or {}
        state = {"ctm": outer, "font": None, "size": 12.0, "leading": 0.0, "rise": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0}
        saved: list[dict] = []
        line = text = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]

        def show(raw: bytes) -> None:
            nonlocal text
            font = state["font"]
            m = _times(text, state["ctm"])
            size = abs(state["size"]) * (abs(m[3]) or abs(m[1]) or 1)
            said = font.text(raw) if font else raw.decode("cp1252", "replace")
            x, y = m[4], m[5]
            if self.last and said:
                lx, ly, ls = self.last
                if abs(y - ly) > max(size, ls) / 3:
                    self._line()
                elif x - lx > size / 5 and self.out and not self.out[-1].endswith((" ", "\n")) and not said.startswith(" "):
                    self.out.append(" ")
            self.out.append(said)
            wide = ((font.advance(raw) if font else 0.5 * len(raw)) * state["size"] + state["char"] * len(raw)) * state["scale"]
            text = _times([1, 0, 0, 1, wide, 0], text)
            end = _times(text, state["ctm"])
            self.last = (end[4], end[5], size)

        while (v := lex.value()) is not END:
            if not isinstance(v, Word):
                args.append(v)
                continue
            try:
                if v == "BT":
                    line = text = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
                elif v == "Tf":
                    spec = fonts.get(args[-2])
                    key = id(doc.resolve(spec))
                    if key not in self.fonts:
                        self.fonts[key] = Font(doc, doc.resolve(spec))
                    state["font"], state["size"] = self.fonts[key], float(args[-1])
                elif v in ("Td", "TD"):
                    if v == "TD":
                        state["leading"] = -args[-1]
                    line = text = _times([1, 0, 0, 1, args[-2], args[-1]], line)
                elif v == "Tm":
                    line = text = [float(x) for x in args[-6:]]
                elif v == "T*":
                    line = text = _times([1, 0, 0, 1, 0, -state["leading"]], line)
                elif v == "TL":
                    state["leading"] = args[-1]
                elif v == "Tc":
                    state["char"] = args[-1]
                elif v == "Tz":
                    state["scale"] = args[-1] / 100
                elif v == "Tj":
                    show(args[-1])
                elif v in ("'", '"'):
                    line = text = _times([1, 0, 0, 1, 0, -state["leading"]], line)
                    show(args[-1])
                elif v == "TJ":
                    for x in args[-1]:
                        if isinstance(x, bytes):
                            show(x)
                        else:
                            text = _times([1, 0, 0, 1, -x / 1000 * state["size"] * state["scale"], 0], text)
                elif v == "q":
                    saved.append(dict(state))
                elif v == "Q" and saved:
                    state = saved.pop()
                elif v == "cm":
                    state["ctm"] = _times([float(x) for x in args[-6:]], state["ctm"])
                elif v == "Do" and depth < 8:
                    form = doc.resolve(objects.get(args[-1]))
                    if isinstance(form, Stream) and form.dict.get("Subtype") == "Form":
                        m = doc.resolve(form.dict.get("Matrix")) or [1, 0, 0, 1, 0, 0]
                        self.run(doc.decode(form)[0], doc.resolve(form.dict.get("Resources")) or resources, _times([float(x) for x in m], state["ctm"]), depth + 1)
                elif v == "BI":
                    end = re.compile(rb"\sEI(?=[\s/]|$)").search(data, lex.at)
                    lex.at = end.end() if end else len(data)
            except (IndexError, TypeError, AttributeError, ValueError):
                pass  # an operator with bad operands changes nothing
            args = []

    def _line(self) -> None:
        if self.out and not self.out[-1].endswith("\n"):
            self.out.append("\n")


def page_text(doc: Document, page: dict) -> str:
    painter = Painter(doc)
    resources = doc.resolve(page.get("Resources", page["inherited"].get("Resources")))
    painter.run(contents(doc, page), resources if isinstance(resources, dict) else {}, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0])
    return "".join(painter.out)


def text_string(raw) -> str | None:
    """A document-level text string."""
    if isinstance(raw, Name):
        return str(raw)
    if not isinstance(raw, bytes):
        return None if raw is None else str(raw)
    if raw.startswith(b"\xfe\xff"):
        return _utf16(raw[2:])
    if raw.startswith(b"\xff\xfe"):
        return raw[2:].decode("utf-16-le", "replace")
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1")


def numbers(doc: Document, v, n: int) -> list[float] | None:
    v = doc.resolve(v)
    if not isinstance(v, list) or len(v) < n:
        return None
    out = [doc.resolve(x) for x in v[:n]]
    return [float(x) for x in out] if all(isinstance(x, (int, float)) for x in out) else None


__all__ = ["Font", "Painter", "PdfError", "numbers", "page_text", "text_string"]
