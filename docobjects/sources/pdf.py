"""PDF objects: reading (tables, streams, object streams), page trees, and writing whole files anew.

Encrypted files are refused; inline images are skipped by the content tokeniser.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

_SPACE = b"\x00\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    """The bytes are no PDF that can be read."""


class Name(str):
    """A PDF name, without its slash."""

    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int

    def __str__(self) -> str:
        return f"{self.num} {self.gen} R"


@dataclass
class Stream:
    info: dict
    raw: bytes

    def data(self, doc: Document | None = None) -> bytes:
        """Decoded bytes; only Flate (with predictors) and ASCIIHex are undone, other filters are an error."""
        get = doc.resolve if doc else lambda x: x
        filters, parms = get(self.info.get("Filter")), get(self.info.get("DecodeParms"))
        filters = [] if filters is None else filters if isinstance(filters, list) else [filters]
        parms = parms if isinstance(parms, list) else [parms] * len(filters)
        out = self.raw
        for name, parm in zip(filters, parms, strict=False):
            name, parm = get(name), get(parm)
            if name in ("FlateDecode", "Fl"):
                out = _inflate(out)
                if isinstance(parm, dict) and get(parm.get("Predictor", 1)) > 1:
                    out = _unpredict(out, *(get(parm.get(k, d)) for k, d in (("Predictor", 1), ("Columns", 1), ("Colors", 1), ("BitsPerComponent", 8))))
            elif name in ("ASCIIHexDecode", "AHx"):
                out = _hex_bytes(out.split(b">")[0])
            else:
                raise PdfError(f"filter {name}")
        return out


class Operator(str):
    """An operator of a content stream."""

    __slots__ = ()


def _inflate(data: bytes) -> bytes:
    unpacker = zlib.decompressobj()
    try:
        return unpacker.decompress(data) + unpacker.flush()
    except zlib.error as error:
        raise PdfError(f"Flate stream: {error}") from error


def _unpredict(data: bytes, predictor: int, columns: int, colors: int, bits: int) -> bytes:
    step, row = max(1, colors * bits // 8), (columns * colors * bits + 7) // 8
    if predictor == 2:
        out = bytearray(data)
        for start in range(0, len(out), row):
            for i in range(start + step, min(start + row, len(out))):
                out[i] = (out[i] + out[i - step]) & 255
        return bytes(out)
    out, before = bytearray(), bytes(row)
    for start in range(0, len(data), row + 1):
        kind, line = data[start], bytearray(data[start + 1 : start + 1 + row])
        for i in range(len(line)):
            a, b = (line[i - step] if i >= step else 0), before[i]
            c = before[i - step] if i >= step else 0
            if kind == 1:
                guess = a
            elif kind == 2:
                guess = b
            elif kind == 3:
                guess = (a + b) // 2
            elif kind == 4:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                guess = 0
            line[i] = (line[i] + guess) & 255
        before = bytes(line).ljust(row, b"\0")
        out += line
    return bytes(out)


def _hex_bytes(digits: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class Lexer:
    """Reads objects from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def read(self, references: bool = True) -> Any:
        """The next object; an Operator for a bare word; None at the end raises EOFError."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            raise EOFError
        c = data[at : at + 1]
        if c == b"/":
            m = _REGULAR.match(data, at + 1)
            word = m.group() if m else b""
            self.at = at + 1 + len(word)
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), word).decode("latin-1"))
        if c == b"(":
            return self._string()
        if data[at : at + 2] == b"<<":
            self.at += 2
            return self._dict(references)
        if c == b"<":
            end = data.find(b">", at)
            if end < 0:
                raise PdfError("open hex string")
            self.at = end + 1
            return _hex_bytes(data[at + 1 : end])
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.read(references))
        m = _REGULAR.match(data, at)
        if not m:
            self.at += 1
            return Operator(c.decode("latin-1"))
        self.at, word = m.end(), m.group()
        if _NUMBER.match(word):
            if b"." in word:
                return float(word)
            if references and word.isdigit():
                ref = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])").match(data, self.at)
                if ref:
                    self.at = ref.end()
                    return Ref(int(word), int(ref[1]))
            return int(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Operator(word.decode("latin-1")))

    def _dict(self, references: bool) -> dict:
        out: dict = {}
        while True:
            self.skip()
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            key = self.read(references)
            if not isinstance(key, Name):
                raise PdfError("dictionary key")
            out[key] = self.read(references)

    def _string(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(data):
            c = data[at : at + 1]
            if c == b"\\":
                n = data[at + 1 : at + 2]
                octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
                if octal:
                    out.append(int(octal.group(), 8) & 255)
                    at = octal.end()
                    continue
                if n in (b"\r", b"\n"):
                    at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
                    continue
                out += _ESCAPES.get(n, n)
                at += 2
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                self.at = at + 1
                return bytes(out)
            out += c
            at += 1
        raise PdfError("open string")


@dataclass
class Page:
    number: int
    ref: Ref
    info: dict
    resources: dict
    width: float
    height: float
    rotate: int


@dataclass
class Document:
    """A PDF file's objects by number; objects are read when they are asked for."""

    data: bytes
    places: dict[int, tuple] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    changed: dict[int, Any] = field(default_factory=dict)
    _read: dict[int, Any] = field(default_factory=dict)

    @classmethod
    def open(cls, data: bytes) -> Document:
        if not has_signature(data):
            raise PdfError("not a PDF")
        doc = cls(data)
        try:
            m = list(re.finditer(rb"startxref\s+(\d+)", data))
            doc._tables(int(m[-1][1]))
            if not isinstance(doc.resolve(doc.trailer.get("Root")), dict):
                raise PdfError("no root")
        except (PdfError, EOFError, IndexError, ValueError, TypeError, AttributeError):
            doc._recover()
        if "Encrypt" in doc.trailer:
            raise PdfError("encrypted")
        if not isinstance(doc.resolve(doc.trailer.get("Root")), dict):
            raise PdfError("no document catalogue")
        return doc

    def _tables(self, at: int) -> None:
        seen = set()
        while at is not None and at not in seen:
            seen.add(at)
            lexer = Lexer(self.data, at)
            lexer.skip()
            if self.data.startswith(b"xref", lexer.at):
                info = self._table(lexer)
                if isinstance(info.get("XRefStm"), int):
                    self._xref_stream(info["XRefStm"])
            else:
                info = self._xref_stream(lexer.at)
            for k, v in info.items():
                self.trailer.setdefault(k, v)
            at = info.get("Prev")

    def _table(self, lexer: Lexer) -> dict:
        lexer.at += 4
        while True:
            first = lexer.read(False)
            if first == "trailer":
                return lexer.read()
            count = lexer.read(False)
            for num in range(first, first + count):
                place, _, use = lexer.read(False), lexer.read(False), lexer.read(False)
                if use == "n":
                    self.places.setdefault(num, ("at", place))
                else:
                    self.places.setdefault(num, ("free",))

    def _xref_stream(self, at: int) -> dict:
        stream = self._object_at(at)[1]
        if not isinstance(stream, Stream):
            raise PdfError("cross-reference stream")
        widths, data, i = stream.info["W"], stream.data(self), 0
        index = stream.info.get("Index", [0, stream.info["Size"]])
        for first, count in zip(index[::2], index[1::2], strict=False):
            for num in range(first, first + count):
                values = []
                for w in widths:
                    values.append(int.from_bytes(data[i : i + w], "big") if w else None)
                    i += w
                kind = 1 if values[0] is None else values[0]
                place = ("at", values[1]) if kind == 1 else ("in", values[1], values[2]) if kind == 2 else ("free",)
                self.places.setdefault(num, place)
        return stream.info

    def _recover(self) -> None:
        """Objects by looking for 'n g obj'; the last of equal numbers holds."""
        self.places = {int(m[1]): ("at", m.start()) for m in re.finditer(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b", self.data)}
        self._read.clear()
        self.trailer = {}
        for m in re.finditer(rb"\btrailer\b", self.data):
            try:
                self.trailer.update(Lexer(self.data, m.end()).read())
            except (PdfError, EOFError):
                continue
        for num in list(self.places):
            try:
                value = self.object(num)
            except (PdfError, EOFError):
                continue
            if isinstance(value, Stream) and value.info.get("Type") == "ObjStm":
                for k, inner in enumerate(self._packed(num)[0]):
                    self.places.setdefault(inner, ("in", num, k))
            if isinstance(value, Stream) and value.info.get("Type") == "XRef":
                self.trailer.update({k: v for k, v in value.info.items() if k in ("Root", "Encrypt", "Info")})
        if "Root" not in self.trailer:
            for num in self.places:
                value = self.object(num)
                if isinstance(value, dict) and value.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(num, 0)
        if "Root" not in self.trailer:
            raise PdfError("no cross-reference table and no catalogue")

    def _object_at(self, at: int) -> tuple[int, Any]:
        lexer = Lexer(self.data, at)
        num, _, word = lexer.read(False), lexer.read(False), lexer.read(False)
        if word != "obj" or not isinstance(num, int):
            raise PdfError("object header")
        value = lexer.read()
        lexer.skip()
        if isinstance(value, dict) and self.data.startswith(b"stream", lexer.at):
            begin = lexer.at + 6
            begin += 2 if self.data.startswith(b"\r\n", begin) else 1
            length = self.resolve(value.get("Length"))
            if not isinstance(length, int) or not re.compile(rb"\s*endstream").match(self.data, begin + length):
                end = self.data.find(b"endstream", begin)
                if end < 0:
                    raise PdfError("open stream")
                length = len(self.data[begin:end].rstrip(b"\r\n"))
            value = Stream(value, self.data[begin : begin + length])
        return num, value

    def _packed(self, num: int) -> tuple[list[int], list[Any]]:
        stream = self.object(num)
        data, count = stream.data(self), self.resolve(stream.info["N"])
        lexer, heads = Lexer(data), []
        for _ in range(count):
            heads.append((lexer.read(False), lexer.read(False)))
        first = self.resolve(stream.info["First"])
        return [n for n, _ in heads], [Lexer(data, first + offset).read() for _, offset in heads]

    def object(self, num: int) -> Any:
        if num in self.changed:
            return self.changed[num]
        if num not in self._read:
            place = self.places.get(num, ("free",))
            if place[0] == "at":
                found, value = self._object_at(place[1])
                if found != num:
                    raise PdfError(f"object {num} is not where the table says")
                self._read[num] = value
            elif place[0] == "in":
                numbers, values = self._packed(place[1])
                self._read.update({n: v for n, v in zip(numbers, values, strict=True) if self.places.get(n, ("", ""))[:2] == ("in", place[1])})
                self._read.setdefault(num, None)
            else:
                self._read[num] = None
        return self._read[num]

    def resolve(self, value: Any) -> Any:
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.object(value.num)
        raise PdfError("reference loop")

    def get(self, info: dict, *path: str) -> Any:
        value: Any = info
        for key in path:
            value = self.resolve(value)
            value = value.info if isinstance(value, Stream) else value
            if not isinstance(value, dict):
                return None
            value = value.get(key)
        return self.resolve(value)

    def pages(self) -> Iterator[Page]:
        root = self.resolve(self.trailer["Root"])
        todo, seen, number = [(root.get("Pages"), {})], set(), 0
        while todo:
            ref, given = todo.pop()
            node = self.resolve(ref)
            if not isinstance(node, dict) or not isinstance(ref, Ref) or ref in seen:
                continue
            seen.add(ref)
            given = given | {k: node[k] for k in ("Resources", "MediaBox", "Rotate") if k in node}
            kids = self.resolve(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(kid, given) for kid in reversed(kids)]
                continue
            number += 1
            box = [self.resolve(v) for v in self.resolve(given.get("MediaBox")) or [0, 0, 612, 792]]
            resources = self.resolve(given.get("Resources"))
            rotate = self.resolve(given.get("Rotate")) or 0
            yield Page(number, ref, node, resources if isinstance(resources, dict) else {}, abs(float(box[2]) - float(box[0])), abs(float(box[3]) - float(box[1])), int(rotate))

    def content(self, page: Page) -> bytes:
        """All content streams of a page, joined by line ends."""
        value = self.resolve(page.info.get("Contents"))
        parts = value if isinstance(value, list) else [value]
        return b"\n".join(s.data(self) for s in map(self.resolve, parts) if isinstance(s, Stream))

    def add(self, value: Any) -> Ref:
        num = max([0, *self.places, *self.changed]) + 1
        self.changed[num] = value
        return Ref(num, 0)

    def save(self, dropped: frozenset[int] = frozenset()) -> bytes:
        """The whole file anew: every live object that can be reached from the trailer, but not the dropped ones."""
        trailer = {k: v for k, v in self.trailer.items() if k in ("Root", "Info", "ID")}
        live, todo = {}, [trailer]
        while todo:
            for ref in references(todo.pop()):
                if ref.num not in live and ref.num not in dropped:
                    live[ref.num] = value = self.object(ref.num)
                    todo.append(value)
        return write_file({n: v for n, v in live.items() if v is not None}, trailer)


def references(value: Any) -> Iterator[Ref]:
    """All references that stand in a value."""
    todo = [value]
    while todo:
        value = todo.pop()
        if isinstance(value, Ref):
            yield value
        elif isinstance(value, Stream):
            todo.append(value.info)
        elif isinstance(value, dict):
            todo += value.values()
        elif isinstance(value, list):
            todo += value


def has_signature(data: bytes) -> bool:
    """At least 64 bytes, with %PDF- among the first 1024."""
    return len(data) >= 64 and b"%PDF-" in data[:1024]


def serialise(value: Any) -> bytes:
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Ref):
        return str(value).encode()
    if isinstance(value, Operator):
        return value.encode("latin-1")
    if isinstance(value, Name):
        return b"/" + re.sub(rb"[^!-~]|[()<>\[\]{}/%#]", lambda m: b"#%02X" % m[0][0], value.encode("latin-1"))
    if isinstance(value, float):
        return (f"{value:.6f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(value, int):
        return str(value).encode()
    if isinstance(value, bytes):
        if all(32 <= c < 127 for c in value):
            return b"(" + re.sub(rb"([()\\])", rb"\\\1", value) + b")"
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, list):
        return b"[" + b" ".join(map(serialise, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b" ".join(serialise(Name(k)) + b" " + serialise(v) for k, v in value.items()) + b">>"
    if isinstance(value, Stream):
        return serialise(value.info | {"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    raise PdfError(f"cannot write {type(value).__name__}")


def write_file(objects: dict[int, Any], trailer: dict) -> bytes:
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for num in sorted(objects):
        value = objects[num]
        if isinstance(value, Stream) and value.info.get("Type") in ("ObjStm", "XRef"):
            continue
        places[num] = len(out)
        out += b"%d 0 obj\n" % num + serialise(value) + b"\nendobj\n"
    start, size = len(out), max(places, default=0) + 1
    out += b"xref\n0 %d\n" % size
    for num in range(size):
        out += b"%010d 00000 n \n" % places[num] if num in places else b"0000000000 65535 f \n"
    out += b"trailer\n" + serialise(trailer | {"Size": size}) + b"\nstartxref\n%d\n%%%%EOF\n" % start
    return bytes(out)


class Op(NamedTuple):
    operands: list
    name: str


def operators(content: bytes) -> list[Op]:
    """A content stream as operators; inline images (BI ... EI) are left out."""
    lexer, operands, out = Lexer(content), [], []
    while True:
        try:
            value = lexer.read(False)
        except (EOFError, PdfError):
            return out
        if not isinstance(value, Operator):
            operands.append(value)
            continue
        if value == "ID":
            end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(content, lexer.at)
            lexer.at = end.end() if end else len(content)
        elif value != "BI":
            out.append(Op(operands, str(value)))
        operands = []


def serialise_operators(ops: list[Op]) -> bytes:
    return b"\n".join(b" ".join([*map(serialise, op.operands), op.name.encode("latin-1")]) for op in ops) + b"\n"
