"""Small valid PDF files from texts, for tests and generated inputs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field


@dataclass
class Page:
    text: str = ""
    #: width, height, filter, colour space, bits, data
    images: Sequence[tuple[int, int, str | None, str, int, bytes]] = ()
    #: subtype, contents, rectangle or None
    annotations: Sequence[tuple[str | None, str, tuple | None]] = ()
    media_box: tuple | None = None
    rotate: int = 0


@dataclass
class Writer:
    compress: bool = True
    packed: bool = False  # objects in object streams, cross references as a stream
    objects: list[bytes] = field(default_factory=lambda: [b"", b"", b""])

    def add(self, body: bytes) -> int:
        self.objects.append(body)
        return len(self.objects)

    def stream(self, data: bytes, head: bytes = b"", flate: bool | None = None) -> bytes:
        if self.compress if flate is None else flate:
            data, head = zlib.compress(data), head + b" /Filter /FlateDecode"
        return b"<<%s /Length %d>>\nstream\n%s\nendstream" % (head, len(data), data)


def quoted(text: str) -> bytes:
    try:
        raw = text.encode("cp1252")
    except UnicodeEncodeError:
        raw = b"\xfe\xff" + text.encode("utf-16-be")
    return b"(" + raw.replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)").replace(b"\r", rb"\r") + b")"


def _content(page: Page) -> bytes:
    shown = b"\n".join(b"%s Tj T*" % quoted(line) for line in page.text.split("\n"))
    return b"BT /F1 10 Tf 12 TL 72 720 Td\n%s\nET" % shown if page.text else b""


def write(pages: Sequence[Page], info: dict[str, str] | None = None, media_box: tuple = (0, 0, 612, 792), compress: bool = True, packed: bool = False) -> bytes:
    """A file with one font; pages without a media box of their own inherit the tree's."""
    w = Writer(compress, packed)
    font = w.objects.__setitem__(2, b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding>>") or 3
    box = lambda b: b"[%s]" % b" ".join(b"%g" % x for x in b)
    kids = []
    for p in pages:
        names = []
        for k, (width, height, kind, space, bits, data) in enumerate(p.images):
            head = b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /%s /BitsPerComponent %d" % (width, height, space.encode(), bits)
            flate = kind == "FlateDecode"
            head += b" /Filter /%s" % kind.encode() if kind and not flate else b""
            names.append(b"/Im%d %d 0 R" % (k, w.add(w.stream(data, head, flate))))
        notes = []
        for kind, text, rect in p.annotations:
            notes.append(b"%d 0 R" % w.add(b"<</Type /Annot%s /Contents %s%s>>" % (b" /Subtype /" + kind.encode() if kind else b"", quoted(text), b" /Rect " + box(rect) if rect else b"")))
        content = w.add(w.stream(_content(p)))
        kids.append(w.add(b"<</Type /Page /Parent 2 0 R /Contents %d 0 R /Resources <</Font <</F1 %d 0 R>> /XObject <<%s>>>>%s%s%s>>" % (
            content, font, b" ".join(names), b" /MediaBox " + box(p.media_box) if p.media_box else b"", b" /Annots [%s]" % b" ".join(notes) if notes else b"", b" /Rotate %d" % p.rotate if p.rotate else b"",
        )))
    w.objects[0] = b"<</Type /Catalog /Pages 2 0 R>>"
    w.objects[1] = b"<</Type /Pages /Count %d /MediaBox %s /Kids [%s]>>" % (len(kids), box(media_box), b" ".join(b"%d 0 R" % k for k in kids))
    trailer = b"/Root 1 0 R"
    if info:
        trailer += b" /Info %d 0 R" % w.add(b"<<%s>>" % b" ".join(b"/%s %s" % (k.encode(), quoted(v)) for k, v in info.items()))
    return _packed(w, trailer) if packed else _plain(w, trailer)


def _plain(w: Writer, trailer: bytes) -> bytes:
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for k, body in enumerate(w.objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<</Size %d %s>>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, trailer, at))


def _packed(w: Writer, trailer: bytes) -> bytes:
    out, entries = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {0: (0, 0, 65535)}
    inside = [(k, b) for k, b in enumerate(w.objects, 1) if b"stream\n" not in b]
    holder, table = len(w.objects) + 1, len(w.objects) + 2
    heads, bodies = [], bytearray()
    for n, (k, body) in enumerate(inside):
        heads.append(b"%d %d" % (k, len(bodies)))
        bodies += body + b"\n"
        entries[k] = (2, holder, n)
    head = b" ".join(heads) + b"\n"
    for k, body in enumerate(w.objects, 1):
        if k not in entries:
            entries[k] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    entries[holder] = (1, len(out), 0)
    out += b"%d 0 obj\n%s\nendobj\n" % (holder, w.stream(head + bytes(bodies), b"/Type /ObjStm /N %d /First %d" % (len(inside), len(head)), True))
    at = entries[table] = (1, len(out), 0)
    rows = b"".join(struct.pack(">BIH", *entries[k]) for k in range(table + 1))
    out += b"%d 0 obj\n%s\nendobj\n" % (table, w.stream(rows, b"/Type /XRef /Size %d /W [1 4 2] %s" % (table + 1, trailer), True))
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at[1])
