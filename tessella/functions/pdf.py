"""Text of PDF files: objects, Flate streams, page trees and text operators, as far as text needs them; and a writer of text pages.

Objects are found by their heads, so a damaged cross-reference table does no harm; compressed object streams are opened.
A page's text is given as runs with their height, for ``ingest.run_lines`` to make lines of.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np

#: Bytes that a stream may have when it is unpacked, and levels of the page tree.
MOST_STREAM = 256 * 1024 * 1024
MOST_LEVELS = 64
LINES = 40


class Ref(NamedTuple):
    number: int


class Word(NamedTuple):
    """An operator, or another bare word."""

    name: bytes


_HEAD = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
_SKIP = re.compile(rb"(?:[\x00\t\n\f\r ]+|%[^\r\n]*)*")
_REF = re.compile(rb"(\d+)\s+(\d+)\s+R(?![^\s/<>\[\]()])")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_NAME = re.compile(rb"/[^\x00\t\n\f\r ()<>\[\]{}/%]*")
_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")
_WORD = re.compile(rb"[^\x00\t\n\f\r ()<>\[\]{}/%]+")
_IN_STRING = re.compile(rb"[()\\]")
_STREAM = re.compile(rb"\s*stream\r?\n")
_STREAM_END = re.compile(rb"\s*endstream")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_END = object()


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose first bracket is before ``at``."""
    out, depth = [], 1
    while True:
        hit = _IN_STRING.search(data, at)
        if hit is None:
            raise ValueError("a string has no end")
        out.append(data[at : hit.start()])
        mark, at = hit[0], hit.end()
        if mark == b"\\":
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if octal:
                out.append(bytes([int(octal[0], 8) & 255]))
                at += len(octal[0])
            else:
                end = at + (2 if data[at : at + 2] == b"\r\n" else 1)
                out.append(b"" if data[at : at + 1] in b"\r\n" else _ESCAPED.get(data[at:end], data[at:end]))
                at = end
            continue
        depth += 1 if mark == b"(" else -1
        if not depth:
            return b"".join(out), at
        out.append(mark)


_BARE = ((_WORD, lambda m: Word(m[0])),)
_SIGNED = ((_NUMBER, lambda m: float(m[0])), *_BARE)
_KINDS = {
    b"/": ((_NAME, lambda m: m[0].decode("latin-1")),),
    b"<": ((_HEX, lambda m: bytes.fromhex((h := re.sub(rb"\s", b"", m[1]).decode()) + "0" * (len(h) % 2))),),
    **{c: _SIGNED for c in (b"+", b"-", b".")},
    **{b"%d" % n: ((_REF, lambda m: Ref(int(m[1]))), *_SIGNED) for n in range(10)},
}


def _value(data: bytes, at: int) -> tuple[Any, int]:
    """The value at a place and where it ends; ``_END`` at a closing bracket or the end."""
    at = _SKIP.match(data, at).end()
    two = data[at : at + 2]
    if two == b"<<":
        items, at = _items(data, at + 2)
        return dict(zip(items[::2], items[1::2], strict=False)), at
    if two == b">>":
        return _END, at + 2
    one = two[:1]
    if one in (b"]", b"}", b""):
        return _END, at + 1
    if one in (b"[", b"{"):
        return _items(data, at + 1)
    if one == b"(":
        return _string(data, at + 1)
    # What a value can be goes by its first byte.
    for pattern, make in _KINDS.get(one, _BARE):
        if hit := pattern.match(data, at):
            return make(hit), hit.end()
    return Word(one), at + 1


def _items(data: bytes, at: int) -> tuple[list, int]:
    out = []
    while True:
        value, at = _value(data, at)
        if value is _END:
            return out, at
        out.append(value)


class Document:
    """The objects of a file. The last object of a number counts, as later revisions are appended. An object is read once."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF header")
        self.data = data
        self.places = {int(m[1]): m.end() for m in _HEAD.finditer(data)}
        self.packed: dict[int, tuple[bytes, int]] = {}
        self.known: dict[int, tuple[Any, int]] = {}
        if b"/Encrypt" in data and re.search(rb"trailer.*?/Encrypt", data, re.S):
            raise ValueError("the file is encrypted")
        for number in list(self.places):
            found = self.get(Ref(number))
            if isinstance(found, dict) and found.get("/Type") == "/ObjStm":
                inside, first = self.stream(Ref(number)), int(self.get(found["/First"]))
                heads = [int(x) for x in inside[:first].split()]
                opened = {n: (inside, first + at) for n, at in zip(heads[::2], heads[1::2], strict=True) if n not in self.places}
                self.packed |= opened
                for n in opened:
                    self.known.pop(n, None)

    def get(self, value: Any) -> Any:
        """A value, or the object that it refers to."""
        for _ in range(MOST_LEVELS):
            if not isinstance(value, Ref):
                return value
            if value.number not in self.places and value.number not in self.packed:
                return None
            value = self._read(value.number)[0]
        raise ValueError("references form a circle")

    def _read(self, number: int) -> tuple[Any, int]:
        """The object of a number, and where it ends."""
        if number not in self.known:
            self.known[number] = _value(*((self.data, self.places[number]) if number in self.places else self.packed[number]))
        return self.known[number]

    def stream(self, ref: Ref) -> bytes:
        """The unpacked bytes of a stream object."""
        if ref.number not in self.places:
            raise ValueError(f"object {ref.number} is missing")
        head, at = self._read(ref.number)
        begin = _STREAM.match(self.data, at)
        if not isinstance(head, dict) or begin is None:
            raise ValueError(f"object {ref.number} is no stream")
        size = self.get(head.get("/Length"))
        end = begin.end() + int(size) if isinstance(size, float) else -1
        if end < 0 or not _STREAM_END.match(self.data, end):
            end = self.data.find(b"endstream", begin.end())
        if end < 0:
            raise ValueError(f"stream {ref.number} has no end")
        raw, filters = self.data[begin.end() : end], self.get(head.get("/Filter"))
        for name in filters if isinstance(filters, list) else [filters] if filters else []:
            if name != "/FlateDecode":
                raise ValueError(f"filter {name} is not read")
            unpack = zlib.decompressobj()
            raw = unpack.decompress(raw, MOST_STREAM)
            if unpack.unconsumed_tail:
                raise ValueError("a stream is too large")
        return raw

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """Pages in order, each with its resources, which it may have from above."""
        roots = [self.get(Ref(n)) for n in (*self.places, *self.packed)]
        catalogs = [r for r in roots if isinstance(r, dict) and r.get("/Type") == "/Catalog"]
        if not catalogs:
            raise ValueError("the file has no catalog")
        todo = [(catalogs[-1].get("/Pages"), {}, 0)]
        while todo:
            node, resources, level = todo.pop()
            node = self.get(node)
            if not isinstance(node, dict) or level > MOST_LEVELS:
                raise ValueError("the page tree is damaged")
            resources = self.get(node.get("/Resources")) or resources
            if "/Kids" in node:
                todo += [(kid, resources, level + 1) for kid in reversed(self.get(node["/Kids"]))]
            else:
                yield node, resources


@functools.lru_cache(maxsize=8)
def _character_map(source: bytes) -> dict[int, str]:
    """Codes to text, of a ToUnicode map. Files of one writer share their maps, so the last ones are kept."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", source, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", source, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first, start = int(low, 16), int(to, 16)
            out |= {first + i: chr(start + i) for i in range(min(int(high, 16) - first, 0xFFFF) + 1)}
    return out


@functools.lru_cache(maxsize=8)
def _wide_map(source: bytes) -> dict[int, str]:
    """The codes of two bytes that do not stand for themselves."""
    return {code: text for code, text in _character_map(source).items() if code <= 0xFFFF and text != chr(code)}


def _reader(document: Document, font: Any):
    """Function from a shown string to text, for one font."""
    font = document.get(font) or {}
    source = document.stream(font["/ToUnicode"]) if isinstance(font.get("/ToUnicode"), Ref) else b""
    if font.get("/Subtype") == "/Type0":

        known = _wide_map(source)

        def wide(shown: bytes) -> str:
            codes = np.frombuffer(shown[: len(shown) // 2 * 2], dtype=">u2").astype("<u4")
            joined = codes.tobytes().decode("utf-32-le", "surrogatepass")
            joined = joined.translate(known) if known else joined
            return joined.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")

        return wide
    known = {code: text for code, text in _character_map(source).items() if code <= 0xFF}
    if not known:
        return lambda shown: shown.decode("cp1252", "replace")
    table = {c: bytes([c]).decode("cp1252", "replace") for c in range(256)} | known
    return lambda shown: shown.decode("latin-1").translate(table)


def page_runs(document: Document, page: dict, resources: dict) -> list[tuple[str, float]]:
    """Shown strings of a page with their height, in the order of its content."""
    contents = page.get("/Contents")
    listed = document.get(contents) if not isinstance(contents, Ref) or isinstance(document.get(contents), list) else [contents]
    body = b"\n".join(document.stream(ref) for ref in listed or [])
    fonts = document.get((resources or {}).get("/Font")) or {}
    readers: dict[str, Any] = {}
    read = _reader(document, None)
    runs: list[tuple[str, float]] = []
    stack: list[Any] = []
    # Height of the line: the text matrix is kept as far as it moves lines.
    scale, y, leading, at = 1.0, 0.0, 0.0, 0
    while at < len(body):
        value, at = _value(body, at)
        if not isinstance(value, Word):
            if value is not _END:
                stack.append(value)
            continue
        name, numbers = value.name, [v for v in stack if isinstance(v, float)]
        if name == b"BT":
            scale, y = 1.0, 0.0
        elif name == b"Tf" and stack:
            font = stack[0]
            if font not in readers:
                readers[font] = _reader(document, fonts.get(font))
            read = readers[font]
        elif name == b"TL" and numbers:
            leading = numbers[-1]
        elif name in (b"Td", b"TD") and len(numbers) >= 2:
            y += numbers[-1] * scale
            leading = -numbers[-1] if name == b"TD" else leading
        elif name == b"Tm" and len(numbers) >= 6:
            scale, y = numbers[-3], numbers[-1]
        elif name in (b"T*", b"'", b'"'):
            y -= leading * scale
        if name in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
            runs.append((read(stack[-1]), y))
        elif name == b"TJ" and stack and isinstance(stack[-1], list):
            # A wide gap between strings is a space.
            parts = [read(v) if isinstance(v, bytes) else " " if isinstance(v, float) and v < -200 else "" for v in stack[-1]]
            runs.append(("".join(parts), y))
        stack.clear()
    return runs


def runs_of(data: bytes) -> list[list[tuple[str, float]]]:
    """Runs of every page of a file."""
    document = Document(data)
    return [page_runs(document, page, resources) for page, resources in document.pages()]


_WIDE_MAP = b"1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n1 beginbfrange\n<0000> <FFFF> <0000>\nendbfrange\n"


def _literal(line: str) -> bytes:
    return b"(" + re.sub(rb"([\\()])", rb"\\\1", line.encode("cp1252")).replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"


def write(pages: list[list[str]], compress: bool = True) -> bytes:
    """A file with a line of text a row, in a font of one byte a character if all are of Windows-1252, else of two."""
    try:
        for lines in pages:
            "".join(lines).encode("cp1252")
        show, font = _literal, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    except UnicodeEncodeError:
        show = lambda line: b"<" + line.encode("utf-16-be", "surrogatepass").hex().encode() + b">"
        font = b"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /ToUnicode 4 0 R >>"

    def stream(body: bytes) -> bytes:
        body, packed = (zlib.compress(body), b" /Filter /FlateDecode") if compress else (body, b"")
        return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), packed, body)

    numbers = [5 + 2 * i for i in range(len(pages))]
    kids = b" ".join(b"%d 0 R" % n for n in numbers)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages)), font, stream(_WIDE_MAP)]
    for number, lines in zip(numbers, pages, strict=True):
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (number + 1))
        shown = [show(line) + b" Tj" for line in lines]
        objects.append(stream(b"BT /F1 11 Tf 16 TL 56 760 Td\n" + b" T*\n".join(shown) + b"\nET"))
    out, places = b"%PDF-1.4\n", []
    for number, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    table = b"".join(b"%010d 00000 n \n" % place for place in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (
        len(objects) + 1, table, len(objects) + 1, len(out),
    )


def paged(text: str | None, lines: int = LINES) -> list[list[str]]:
    """A text's lines by pages of ``lines``."""
    split = (text or "").split("\n")
    return [split[at : at + lines] for at in range(0, len(split), lines)]
