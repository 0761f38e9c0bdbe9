"""Character codes of a font: their text (ToUnicode) and their widths."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from .pdf import Document, PdfError, Stream

# Widths where a font gives none (thousandths of the size), and the most codes of one range.
SIMPLE_WIDTH, CID_WIDTH, MOST_CODES = 500.0, 1000.0, 65_536

_HEX = rb"<\s*([0-9A-Fa-f\s]*)>"


def utf16(digits: bytes) -> str:
    digits = re.sub(rb"\s", b"", digits)
    return bytes.fromhex(("0" * (len(digits) % 2)) + digits.decode()).decode("utf-16-be", "replace")


@dataclass
class CMap:
    """Codes of fixed width to text; unknown codes are U+FFFD."""

    width: int = 1
    text: dict[int, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, source: bytes) -> CMap:
        out = cls()
        if m := re.search(rb"begincodespacerange\s*" + _HEX, source):
            out.width = max(1, (len(re.sub(rb"\s", b"", m[1])) + 1) // 2)
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", source, re.S):
            for code, to in re.findall(_HEX + rb"\s*" + _HEX, block):
                out.text[int(code, 16)] = utf16(to)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", source, re.S):
            for low, high, to, many in re.findall(_HEX + rb"\s*" + _HEX + rb"\s*(?:" + _HEX + rb"|\[(.*?)\])", block, re.S):
                first, last = int(low, 16), min(int(high, 16), int(low, 16) + MOST_CODES - 1)
                if many:
                    for code, one in zip(range(first, last + 1), re.findall(_HEX, many), strict=False):
                        out.text[code] = utf16(one)
                elif start := utf16(to):
                    for code in range(first, last + 1):
                        out.text[code] = start[:-1] + chr(min(ord(start[-1]) + code - first, 0x10FFFF))
        return out

    def decode(self, raw: bytes) -> str:
        w = self.width
        return "".join(self.text.get(int.from_bytes(raw[i : i + w], "big"), "�") for i in range(0, len(raw) - w + 1, w))


@dataclass
class Font:
    """What a text operator needs of a font; the default stands for a font that is not there."""

    cmap: CMap | None = None
    composite: bool = False
    widths: dict[int, float] = field(default_factory=dict)
    missing: float = SIMPLE_WIDTH

    def text(self, raw: bytes) -> str:
        return self.cmap.decode(raw) if self.cmap else raw.decode("latin-1")

    def codes(self, raw: bytes) -> list[int]:
        return [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if self.composite else list(raw)

    def width(self, code: int) -> float:
        w = self.widths.get(code, 0.0)
        return w if w > 0 else self.missing


def _number(value: Any, default: float) -> float:
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else default


def read_font(doc: Document, info: Any) -> Font:
    """A font from its dictionary; whatever is malformed falls back to the defaults."""
    info = doc.resolve(info)
    font = Font()
    if not isinstance(info, dict):
        return font
    try:
        source = doc.resolve(info.get("ToUnicode"))
        if isinstance(source, Stream):
            cmap = CMap.parse(source.data(doc))
            font.cmap = cmap if cmap.text else None
    except (PdfError, ValueError):
        font.cmap = None
    if info.get("Subtype") == "Type0":
        font.composite, font.missing = True, CID_WIDTH
        kids = doc.resolve(info.get("DescendantFonts"))
        inner = doc.resolve(kids[0]) if isinstance(kids, list) and kids else {}
        font.missing = _number(doc.resolve(inner.get("DW")), CID_WIDTH)
        entries, i = [doc.resolve(x) for x in doc.resolve(inner.get("W")) or []], 0
        while i + 1 < len(entries):
            first, second = entries[i], entries[i + 1]
            if isinstance(second, list):
                font.widths.update({first + k: _number(doc.resolve(w), 0) for k, w in enumerate(second[:MOST_CODES])})
                i += 2
            else:
                last = min(second, first + MOST_CODES - 1)
                if i + 2 < len(entries):
                    font.widths.update(dict.fromkeys(range(first, last + 1), _number(entries[i + 2], 0)))
                i += 3
    else:
        first = doc.resolve(info.get("FirstChar")) or 0
        for k, w in enumerate(doc.resolve(info.get("Widths")) or []):
            font.widths[first + k] = _number(doc.resolve(w), 0)
        missing = _number(doc.get(info, "FontDescriptor", "MissingWidth"), 0)
        font.missing = missing if missing > 0 else SIMPLE_WIDTH
    return font
