"""Synthetic PDF files with known contents, for tests and for queries that need real files."""

from __future__ import annotations

import zlib

import numpy as np

from .pdf import Name, Ref, Stream, write_file

A4 = (595, 842)


def picture(width: int, height: int, seed: int) -> bytes:
    """RGB samples that no other seed has."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, 3)
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    out = np.stack([(base[0] + x) % 256, (base[1] + y) % 256, (base[2] + x * y // 7) % 256], axis=2)
    return out.astype(np.uint8).tobytes()


class Builder:
    """Collects the objects of a file."""

    def __init__(self, size: tuple[int, int] = A4):
        self.objects: dict = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: None, 3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}}
        self.size, self.pages = size, []

    def add(self, value) -> Ref:
        num = max(self.objects) + 1
        self.objects[num] = value
        return Ref(num, 0)

    def image(self, width: int, height: int, seed: int = 0, samples: bytes | None = None, space: str = "DeviceRGB", mask: Ref | None = None, flate: bool = False) -> Ref:
        samples = picture(width, height, seed) if samples is None else samples
        info = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "ColorSpace": Name(space), "BitsPerComponent": 8}
        if mask:
            info["SMask"] = mask
        if flate:
            info["Filter"] = Name("FlateDecode")
        return self.add(Stream(info, zlib.compress(samples) if flate else samples))

    def form(self, content: bytes, box: tuple = (0, 0, 200, 200), resources: dict | None = None) -> Ref:
        return self.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": list(box), "Resources": resources or {}}, content))

    def page(self, content: str, xobjects: dict[str, Ref] | None = None, rotate: int = 0, extra: dict | None = None) -> None:
        info = {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, *self.size], "Contents": self.add(Stream({}, content.encode("latin-1")))}
        info["Resources"] = {"Font": {"F1": Ref(3, 0)}, "XObject": dict((xobjects or {}).items())}
        if rotate:
            info["Rotate"] = rotate
        self.pages.append(self.add(info | (extra or {})))

    def bytes(self) -> bytes:
        self.objects[2] = {"Type": Name("Pages"), "Kids": list(self.pages), "Count": len(self.pages)}
        return write_file(self.objects, {"Root": Ref(1, 0)})


def draw(name: str, x: float, y: float, w: float, h: float) -> str:
    return f"q {w} 0 0 {h} {x} {y} cm /{name} Do Q\n"


def text(value: str, x: float, y: float, size: float = 12) -> str:
    return f"BT /F1 {size} Tf {x} {y} Td ({value}) Tj ET\n"


def tiny_jpeg() -> bytes:
    """A grey JPEG of one pixel: flat tables, one code of one bit in each, and both codes as its data."""
    segment = lambda mark, body: bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body
    codes = bytes([1] + [0] * 15 + [0])
    frame = segment(0xC0, bytes([8, 0, 1, 0, 1, 1, 1, 0x11, 0]))
    head = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([1] * 64)) + frame + segment(0xC4, b"\x00" + codes) + segment(0xC4, b"\x10" + codes)
    return head + segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + b"\x3f\xff\xd9"


def samples() -> dict[str, bytes]:
    """Files by name; what they hold is told by their names."""
    out = {}
    b = Builder()
    logo = b.image(240, 80, 1)
    b.page(draw("Im1", 40, 722, 240, 80) + text("A paragraph", 40, 600), {"Im1": logo})
    out["one-image.pdf"] = b.bytes()

    b = Builder()
    logo = b.image(240, 80, 1)
    for i in range(5):
        b.page(draw("Im1", 40, 722, 240, 80) + text(f"Page {i + 1}", 40, 600), {"Im1": logo})
    out["repeated-logo.pdf"] = b.bytes()

    b = Builder()
    entries = {"Im1": b.image(240, 80, 1), "Im2": b.image(400, 300, 2), "Im3": b.image(64, 64, 3)}
    b.page(draw("Im1", 40, 722, 240, 80) + draw("Im2", 40, 400, 300, 220) + draw("Im3", 40, 300, 64, 64), entries)
    out["multiple-images.pdf"] = b.bytes()

    b = Builder()
    b.page(draw("Im1", 40, 400, 500, 300) + text("Text over it", 100, 500), {"Im1": b.image(400, 300, 2)})
    out["image-and-text.pdf"] = b.bytes()

    b = Builder()
    b.page(draw("Im1", 40, 400, 500, 300) + text("Text over it", 100, 500), {"Im1": b.image(400, 300, 2)}, rotate=90)
    out["rotated-page.pdf"] = b.bytes()

    b = Builder()
    b.page(draw("Im1", 0, 0, *A4), {"Im1": b.image(80, 110, 4)})
    out["scanned-page.pdf"] = b.bytes()

    b = Builder()
    b.page(draw("Im1", 0, 0, *A4) + text("A caption on the scan", 60, 742), {"Im1": b.image(80, 110, 4)})
    out["full-page-overlap.pdf"] = b.bytes()

    b = Builder()
    info = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 1, "Height": 1, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8, "Filter": Name("DCTDecode")}
    b.page(draw("Im1", 100, 500, 200, 150), {"Im1": b.add(Stream(info, tiny_jpeg()))})
    out["jpeg-image.pdf"] = b.bytes()

    b = Builder()
    for i in range(3):
        b.page(text("CONFIDENTIAL", 200, 800) + text(f"Only on page {i + 1}", 40, 500) + text("Company Footer 2026", 40, 30))
    out["repeated-text.pdf"] = b.bytes()

    b = Builder()
    for i in range(3):
        rule = "1 w 0 0 0 RG 40 790 m 500 790 l S\n"
        border = "40 80 460 680 re S\n"
        diagonal = f"40 {100 + 50 * i} m 300 {200 + 90 * i} l S\n"
        square = f"0 0 1 RG {60 + 40 * i} 300 30 30 re S\n"
        b.page(rule + border + diagonal + square)
    out["repeated-shapes.pdf"] = b.bytes()

    b = Builder()
    form = b.form(b"q 240 0 0 80 0 0 cm /Im1 Do Q\n", resources={"XObject": {"Im1": b.image(240, 80, 1)}})
    for _ in range(2):
        b.page("q 1 0 0 1 40 700 cm /Fm1 Do Q\n", {"Fm1": form})
    out["form-embedded-image.pdf"] = b.bytes()

    b = Builder()
    form = b.form(b"10 10 80 40 re f 20 20 m 60 90 l S\n")
    for _ in range(2):
        b.page("20 20 555 802 re S q 1 0 0 1 100 500 cm /Fm1 Do Q\n", {"Fm1": form})
    out["form-drawn-shapes.pdf"] = b.bytes()

    b = Builder()
    for i in range(3):
        b.page(text("S", 40, 700) + text("   ", 40, 600) + text(f"Body {i}", 40, 500) + (text("X", 40, 400) if i == 2 else ""))
    out["single-character-text.pdf"] = b.bytes()

    b = Builder()
    mask = b.image(64, 48, samples=bytes(range(256)) * 12, space="DeviceGray")
    b.page("q 200 0 0 150 60 500 cm /ImSoft Do Q\n", {"ImSoft": b.image(64, 48, 6, mask=mask)})
    out["soft-masked-image.pdf"] = b.bytes()

    b = Builder()
    mask = b.image(48, 32, samples=bytes(range(96)) * 16, space="DeviceGray")
    entries = {"ImShadow": b.image(48, 32, samples=bytes(48 * 32 * 3), mask=mask, flate=True), "ImPic": b.image(48, 32, 7, mask=mask), "ImFlat": b.image(48, 32, samples=b"\x10\x20\x30" * 48 * 32)}
    b.page("".join(draw(n, 60, y, 120, 80) for n, y in zip(entries, (600, 480, 360), strict=True)), entries)
    out["shadow-layer.pdf"] = b.bytes()

    b = Builder()
    stamp = b.image(32, 32, 8)
    look = b.form(b"/Im1 Do", resources={"XObject": {"Im1": stamp}})
    note = b.add({"Type": Name("Annot"), "Subtype": Name("Stamp"), "Rect": [10, 10, 42, 42], "AP": {"N": look}})
    b.page(draw("Im1", 100, 100, 32, 32), {"Im1": stamp}, extra={"Annots": [note]})
    out["annotation-shared-image.pdf"] = b.bytes()

    for name, pages in (("flatten-units-a.pdf", 2), ("flatten-units-b.pdf", 2)):
        b = Builder()
        logo = b.image(240, 80, 1)
        for i in range(pages):
            b.page(draw("Im1", 100, 600, 240, 80) + text("Caption", 150, 640) + ("1 0.5 0 rg 300 650 80 60 re f\n" if i == 0 and name.endswith("a.pdf") else "") + text("Alone", 40, 100), {"Im1": logo})
        out[name] = b.bytes()
    return out
