"""One pass over a page's operators: drawn names, shown texts and painted paths, each with its box and operators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_EVEN, Decimal

from .fonts import Font
from .pdf import Name, Op

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

# A text's box reaches 0.85 of the size above the baseline and 0.25 below it; operators that build and
# paint paths, how many points they take, and which of them fill or stroke.
ASCENT, DESCENT = 0.85, 0.25
BUILD = {"m": 1, "l": 1, "c": 3, "v": 2, "y": 2, "re": 2, "h": 0}
PAINT = {"S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"}
FILLS = {"f", "F", "f*", "B", "B*", "b", "b*"}
STROKES = {"S", "s", "B", "B*", "b", "b*"}


def multiply(m: Matrix, n: Matrix) -> Matrix:
    """m first, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def point(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def box_of(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = zip(*points, strict=True)
    return min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)


def mapped_box(m: Matrix, x: float, y: float, w: float, h: float) -> tuple[float, float, float, float]:
    return box_of([point(m, p, q) for p, q in ((x, y), (x + w, y), (x, y + h), (x + w, y + h))])


@dataclass
class Hit:
    """Something a page shows: kind 'draw', 'text' or 'shape'; operators first to last (inclusive)."""

    kind: str
    value: str
    box: tuple[float, float, float, float]
    first: int
    last: int
    matrix: Matrix = IDENTITY
    hides: bool = True
    points: list = field(default_factory=list)
    stroke: tuple | None = None
    fill: tuple | None = None


@dataclass
class _Graphics:
    matrix: Matrix = IDENTITY
    width: float = 1.0
    stroke: tuple | None = None
    fill: tuple | None = None


def _numbers(op: Op, n: int) -> list[float] | None:
    last = op.operands[-n:] if n else []
    return [float(v) for v in last] if len(last) == n and all(isinstance(v, int | float) for v in last) else None


def _byte(share: float) -> int:
    return int(min(max(share * 255, 0), 255))


def _colour(op: Op) -> tuple | None:
    kind = op.name.lower()
    v = _numbers(op, {"g": 1, "rg": 3, "k": 4}[kind])
    if v is None:
        return None
    if kind == "g":
        return (_byte(v[0]),) * 3
    if kind == "rg":
        return tuple(map(_byte, v))
    return tuple(_byte((1 - c) * (1 - v[3])) for c in v[:3])


def rounded(value: float, digits: int) -> str:
    """Half to even, without trailing zeros: 1.0 is '1'."""
    d = Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN)
    text = f"{d:f}".rstrip("0").rstrip(".") if digits else f"{d:f}"
    return "0" if text in ("-0", "") else text


def signature(path: list[tuple[str, list]], paint: str, g: _Graphics) -> str:
    """A path relative to its least corner in tenths of a point, with paint operator, line width and colours."""
    points = [p for _, ps in path for p in ps]
    x0, y0 = min(x for x, _ in points), min(y for _, y in points)
    parts = [name + "".join(f" {rounded(x - x0, 1)},{rounded(y - y0, 1)}" for x, y in ps) for name, ps in path]
    colour = lambda c: "-" if c is None else ",".join(map(str, c))
    return ";".join(parts) + f"|{paint}|w:{rounded(g.width, 3)}|s:{colour(g.stroke)}|f:{colour(g.fill)}"


def walk(ops: list[Op], fonts: dict[str, Font], start: Matrix = IDENTITY) -> Iterator[Hit]:
    """All hits of a page in operator order. q and Q keep graphics state alone; an extra Q changes nothing."""
    g, stack = _Graphics(start), []
    path, began, clip = [], None, False
    font, size, spacing, word_spacing, scale, leading, rise = Font(), 0.0, 0.0, 0.0, 1.0, 0.0, 0.0
    line: Matrix = IDENTITY
    at: Matrix = IDENTITY

    def show(index: int, parts: list) -> Hit | None:
        nonlocal at
        text, x = "", 0.0
        for part in parts:
            if isinstance(part, bytes):
                text += font.text(part)
                for code in font.codes(part):
                    x += (font.width(code) / 1000 * size + spacing + (word_spacing if code == 32 and not font.composite else 0.0)) * scale
            elif isinstance(part, int | float):
                x -= part / 1000 * size * scale
        here = multiply(at, g.matrix)
        box = mapped_box(here, 0.0, rise - DESCENT * size, x, (ASCENT + DESCENT) * size)
        at = multiply((1, 0, 0, 1, x, 0), at)
        return Hit("text", text, box, index, index, here) if text else None

    for i, op in enumerate(ops):
        name = op.name
        if name == "q":
            stack.append(_Graphics(g.matrix, g.width, g.stroke, g.fill))
        elif name == "Q":
            g = stack.pop() if stack else g
        elif name == "cm":
            if m := _numbers(op, 6):
                g.matrix = multiply(tuple(m), g.matrix)
        elif name == "w":
            if v := _numbers(op, 1):
                g.width = v[0]
        elif name in ("G", "RG", "K"):
            g.stroke = _colour(op) or g.stroke
        elif name in ("g", "rg", "k"):
            g.fill = _colour(op) or g.fill
        elif name == "Do":
            if len(op.operands) == 1 and isinstance(op.operands[0], Name):
                yield Hit("draw", str(op.operands[0]), mapped_box(g.matrix, 0, 0, 1, 1), i, i, g.matrix)
        elif name in BUILD:
            began = i if began is None else began
            v = _numbers(op, 4 if name == "re" else 2 * BUILD[name])
            if v is not None:
                pairs = [(v[0], v[1]), (v[0] + v[2], v[1]), (v[0] + v[2], v[1] + v[3]), (v[0], v[1] + v[3])] if name == "re" else list(zip(v[::2], v[1::2], strict=True))
                path.append((name, [point(g.matrix, x, y) for x, y in pairs]))
        elif name in ("W", "W*"):
            clip = True
        elif name in PAINT:
            points = [p for _, ps in path for p in ps]
            if points and not clip:
                yield Hit("shape", signature(path, name, g), box_of(points), began, i, g.matrix, name in FILLS, points, g.stroke, g.fill)
            path, began, clip = [], None, False
        elif name == "BT":
            line = at = IDENTITY
        elif name == "Tf":
            if len(op.operands) == 2 and isinstance(op.operands[1], int | float):
                font, size = fonts.get(str(op.operands[0]), Font()), float(op.operands[1])
        elif name in ("Tc", "Tw", "Tz", "TL", "Ts"):
            if v := _numbers(op, 1):
                if name == "Tc":
                    spacing = v[0]
                elif name == "Tw":
                    word_spacing = v[0]
                elif name == "Tz":
                    scale = v[0] / 100
                elif name == "TL":
                    leading = v[0]
                else:
                    rise = v[0]
        elif name in ("Td", "TD"):
            if v := _numbers(op, 2):
                leading = -v[1] if name == "TD" else leading
                line = at = multiply((1, 0, 0, 1, v[0], v[1]), line)
        elif name == "Tm":
            if m := _numbers(op, 6):
                line = at = tuple(m)
        elif name == "T*":
            line = at = multiply((1, 0, 0, 1, 0, -leading), line)
        elif name in ("Tj", "'", '"', "TJ"):
            if name == '"' and len(op.operands) == 3 and all(isinstance(v, int | float) for v in op.operands[:2]):
                word_spacing, spacing = map(float, op.operands[:2])
            if name in ("'", '"'):
                line = at = multiply((1, 0, 0, 1, 0, -leading), line)
            shown = op.operands[-1] if op.operands else []
            hit = show(i, shown if isinstance(shown, list) else [shown])
            if hit:
                yield hit
