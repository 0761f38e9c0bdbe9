"""Cleaned copies of PDF files: removal, hiding, flattening, pruning, image reduction, and their verification."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import A4, LIMIT_DPI
from ..schema import DRAWING, IMAGE, SHADOW, SHAPE, TEXT
from ..sources.content import Hit, walk
from ..sources.documents import masks_of, page_fonts, parse_file, sha, xobjects
from ..sources.images import jpeg_quality, resize
from ..sources.pdf import Document, Name, Op, Page, PdfError, Ref, Stream, operators, references, serialise_operators

#: Placements that differ by less are at the same place.
SAME_PLACE = 0.1


@dataclass
class Place:
    """A region of a page: its box, and the objects (kind, identity) that are its members. A place without picture is hidden."""

    page_number: int
    box: tuple[float, float, float, float]
    members: list[tuple[int, str]]
    flatten: bool = False


@dataclass
class Selection:
    """What goes from a file: identities by kind everywhere, and places."""

    images: set[str] = field(default_factory=set)  # hashes of images, shadows and drawings
    texts: set[str] = field(default_factory=set)
    shapes: set[str] = field(default_factory=set)
    places: list[Place] = field(default_factory=list)

    def empty(self) -> bool:
        return not (self.images or self.texts or self.shapes or self.places)


@dataclass
class Reduction:
    """Limits for images: a resolution level (index of LIMIT_DPI) and the best JPEG quality that stays as it is."""

    level: int = 2
    jpeg_limit: int = 85


@dataclass
class Report:
    pages_modified: int = 0
    draw_calls_removed: int = 0
    places_flattened: int = 0
    kept_back: int = 0
    objects_removed: int = 0
    images_resized: int = 0


#: Renders the box of a one-page copy without its other objects: (file bytes, page, box, dpi) -> PNG-like RGB samples
#: (width, height, bytes), or None if it cannot.
Rasterizer = Callable[[bytes, int, tuple, int], tuple[int, int, bytes] | None]


def _overlaps(a: tuple, b: tuple) -> bool:
    def edges(r: tuple) -> tuple:
        x, y, w, h = r
        gx, gy = max(1.0 - abs(w), 0) / 2, max(1.0 - abs(h), 0) / 2
        return min(x, x + w) - gx, min(y, y + h) - gy, max(x, x + w) + gx, max(y, y + h) + gy

    p, q = edges(a), edges(b)
    return p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3]


class _PageEdit:
    """A page's operators and hits, and which operators go."""

    def __init__(self, doc: Document, page: Page):
        self.doc, self.page = doc, page
        self.ops = operators(doc.content(page))
        self.hits = list(walk(self.ops, page_fonts(doc, page)))
        self.names = {name: (ref, stream) for name, ref, stream in xobjects(doc, page.resources)}
        self.gone: set[int] = set()

    def identity(self, hit: Hit) -> tuple[int, str] | None:
        if hit.kind == "text":
            return TEXT, hit.value
        if hit.kind == "shape":
            return SHAPE, hit.value
        if hit.value not in self.names:
            return None
        _, stream = self.names[hit.value]
        return (IMAGE if stream.info.get("Subtype") == "Image" else DRAWING), sha(stream.raw)

    def remove(self, hit: Hit) -> None:
        self.gone.update(range(hit.first, hit.last + 1))

    def members(self, place: Place) -> list[Hit]:
        wanted = {(IMAGE if k == SHADOW else k, i) for k, i in place.members}
        return [h for h in self.hits if self.identity(h) in wanted and _overlaps(h.box, place.box)]

    def insertion_point(self, target: int) -> int:
        """After the last operator up to target that leaves no q open; -1 if a cm stands outside all q."""
        depth, out = 0, 0
        for i, op in enumerate(self.ops[: target + 1]):
            depth += (op.name == "q") - (op.name == "Q")
            if depth == 0:
                if op.name == "cm":
                    return -1
                out = i + 1
        return out

    def write(self, inserted: dict[int, list[Op]], appended: list[Op]) -> None:
        out: list[Op] = []
        for i, op in enumerate(self.ops):
            out += inserted.get(i, [])
            if i not in self.gone:
                out.append(op)
        out += inserted.get(len(self.ops), [])
        if appended:
            out = [Op([], "q"), *out, Op([], "Q"), *appended]
        ref = self.doc.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(serialise_operators(out))))
        info = dict(self.page.info) | {"Contents": ref}
        self.doc.changed[self.page.ref.num] = info
        self.page.info = info

    def set_xobjects(self, entries: dict) -> None:
        resources = dict(self.page.resources) | {"XObject": entries}
        info = dict(self.page.info) | {"Resources": resources}
        self.doc.changed[self.page.ref.num] = info
        self.page.info, self.page.resources = info, resources


def isolated(data: bytes, number: int, place: Place) -> bytes:
    """A copy whose page `number` shows the members of a place alone."""
    doc = Document.open(data)
    for page in doc.pages():
        if page.number == number:
            edit = _PageEdit(doc, page)
            keep = {id(h) for h in edit.members(place)}
            for hit in edit.hits:
                if id(hit) not in keep and (hit.kind != "draw" or edit.identity(hit)):
                    edit.remove(hit)
            edit.write({}, [])
    return doc.save()


def clean(data: bytes, selection: Selection, rasterizer: Rasterizer | None = None, reduction: Reduction | None = None, dpi: int = 200) -> tuple[bytes, Report]:
    """The file without what is selected. Places go first; a place whose picture cannot be made, or without members, stays
    as it is. Objects of removed images are deleted unless something else still refers to them."""
    doc, report = Document.open(data), Report()
    if any(p.flatten for p in selection.places) and rasterizer is None:
        raise PdfError("flattening needs a renderer")
    doomed: dict[Ref, Stream] = {}
    for page in list(doc.pages()):
        edit = _PageEdit(doc, page)
        inserted: dict[int, list[Op]] = {}
        appended: list[Op] = []
        pictures: dict[str, Ref] = {}
        for k, place in enumerate(p for p in selection.places if p.page_number == page.number):
            members = edit.members(place)
            if not members:
                continue
            if place.flatten:
                picture = rasterizer(isolated(data, page.number, place), page.number, place.box, dpi)
                if picture is None:
                    continue
                w, h, samples = picture
                name = f"Flat{page.number}x{k}"
                info = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": h, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}
                pictures[name] = doc.add(Stream(info, zlib.compress(samples)))
                x, y, bw, bh = place.box
                ops = [Op([], "q"), Op([bw, 0, 0, bh, x, y], "cm"), Op([Name(name)], "Do"), Op([], "Q")]
                at = edit.insertion_point(min(m.first for m in members))
                if at < 0:
                    appended += ops
                else:
                    inserted.setdefault(at, []).extend(ops)
                report.places_flattened += 1
            for hit in members:
                edit.remove(hit)
        before = len(edit.gone)
        for hit in edit.hits:
            found = edit.identity(hit)
            wanted = found and found[1] in {IMAGE: selection.images, DRAWING: selection.images, TEXT: selection.texts, SHAPE: selection.shapes}[found[0]]
            if wanted and hit.first not in edit.gone:
                edit.remove(hit)
                report.draw_calls_removed += 1
        if edit.gone or inserted or appended:
            edit.write(inserted, appended)
            report.pages_modified += 1
        drawn = {h.value for h in edit.hits if h.kind == "draw" and h.first not in edit.gone}
        dropped = {n for n, (_, s) in edit.names.items() if n not in drawn and (sha(s.raw) in selection.images or before and any(h.value == n and h.first in edit.gone for h in edit.hits if h.kind == "draw"))}
        if dropped or pictures:
            doomed |= {edit.names[n][0]: edit.names[n][1] for n in dropped}
            entries = doc.resolve(page.resources.get("XObject")) or {}
            edit.set_xobjects({k: v for k, v in entries.items() if k not in dropped} | {Name(k): v for k, v in pictures.items()})
    _prune(doc, doomed, report)
    if reduction is not None:
        _reduce(doc, reduction, report)
    return doc.save(), report


def _live(doc: Document) -> set[int]:
    """Numbers of all objects that the trailer reaches."""
    seen: set[int] = set()
    todo: list[Any] = [{k: v for k, v in doc.trailer.items() if k in ("Root", "Info")}]
    while todo:
        for ref in references(todo.pop()):
            if ref.num not in seen:
                seen.add(ref.num)
                todo.append(doc.object(ref.num))
    return seen


def _prune(doc: Document, doomed: dict[Ref, Stream], report: Report) -> None:
    """Counts what is deleted and what has to stay. Objects that nothing reaches are not written, so neither are their masks."""
    live = _live(doc)
    for ref, stream in doomed.items():
        if ref.num in live:
            report.kept_back += 1
        else:
            report.objects_removed += 1 + sum(mask.num not in live for mask in masks_of(doc, stream))


def ceilings(doc: Document, level: int) -> dict[Ref, tuple[int, int]]:
    """Per image the most pixels that a page naming it can use at a resolution level."""
    dpi, out = LIMIT_DPI[level], {}
    for page in doc.pages():
        size = (page.width, page.height) if page.width > 0 and page.height > 0 else A4
        w, h = (max(1, round(p / 72 * dpi)) for p in size)
        for _, ref, stream in xobjects(doc, page.resources):
            if stream.info.get("Subtype") == "Image":
                a, b = out.get(ref, (0, 0))
                out[ref] = max(a, w), max(b, h)
    return out


def _channels(doc: Document, space: Any) -> int | None:
    space = doc.resolve(space)
    if isinstance(space, list) and len(space) == 2 and space[0] == "ICCBased":
        n = doc.get({"x": space[1]}, "x", "N")
        return n if n in (1, 3) else None
    return {"DeviceRGB": 3, "DeviceGray": 1}.get(space) if isinstance(space, str) else None


def _reduce(doc: Document, reduction: Reduction, report: Report) -> None:
    """Shrinks images that have more pixels than any page can use; kept only if they get smaller. JPEG streams need a codec
    that is not here and stay; so do masks, odd depths, decode arrays and filter chains."""
    for ref, (most_w, most_h) in ceilings(doc, reduction.level).items():
        stream = doc.resolve(ref)
        info = stream.info
        w, h, channels = doc.resolve(info.get("Width")), doc.resolve(info.get("Height")), _channels(doc, info.get("ColorSpace"))
        scale = min(1.0, max(most_w / w, most_h / h)) if w and h else 1.0
        filters = doc.resolve(info.get("Filter"))
        if filters == "DCTDecode" and (jpeg_quality(stream.raw) or 0) <= reduction.jpeg_limit:
            continue
        if scale >= 1.0 or channels is None or doc.resolve(info.get("BitsPerComponent")) != 8 or filters not in (None, "FlateDecode", ["FlateDecode"]):
            continue
        if info.get("ImageMask") or "Decode" in info or "DecodeParms" in info:
            continue
        new_w, new_h = max(1, round(w * scale)), max(1, round(h * scale))
        small = resize(stream.data(doc), w, h, channels, new_w, new_h)
        packed = zlib.compress(small) if small is not None else None
        if packed is not None and len(packed) < len(stream.raw):
            doc.changed[ref.num] = Stream(info | {"Width": new_w, "Height": new_h, "Filter": Name("FlateDecode")}, packed)
            report.images_resized += 1


def verify(data: bytes, pages: int, removed: set[str], retained: set[str], strict: bool = False) -> dict[str, bool]:
    """Checks of a cleaned file: it has bytes, opens, has its pages, shows and names no removed object, and still has
    retained ones (one of them; all of them if strict)."""
    out = {"has_bytes": len(data) > 0, "opens": False, "page_count": False, "no_removed_calls": False, "no_removed_entries": False, "retained": False}
    try:
        doc = Document.open(data)
        out["opens"] = True
        found, drawn, count = set(), set(), 0
        for page in doc.pages():
            count += 1
            names = {name: sha(stream.raw) for name, _, stream in xobjects(doc, page.resources)}
            found |= set(names.values())
            drawn |= {names.get(op.operands[0]) for op in operators(doc.content(page)) if op.name == "Do" and op.operands}
        out["page_count"] = count == pages
        out["no_removed_calls"], out["no_removed_entries"] = not drawn & removed, not found & removed
        left = retained - removed
        out["retained"] = left <= found if strict else not left or bool(left & found)
    except (PdfError, EOFError, KeyError, TypeError):
        pass
    return out | {"passed": all(out.values())}


CLEANED = "file_id string, content binary, report string, checks string, error string"


def clean_files(files: DataFrame, selected: DataFrame, rasterizer: Rasterizer | None = None, reduction: Reduction | None = None) -> DataFrame:
    """Cleaned copies of the files that hold something selected: file_id, content, report, checks (JSON), error.

    files: file_id, content; selected: file_id, kind, identity. One row per file meets its selection in a join; a file that
    fails has an error and no content.
    """
    chosen = selected.groupBy("file_id").agg(F.collect_set(F.struct("kind", "identity")).alias("chosen"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for file_id, content, picks in zip(pdf.file_id, pdf.content, pdf.chosen, strict=True):
                pick = Selection()
                for p in picks:
                    {TEXT: pick.texts, SHAPE: pick.shapes}.get(p["kind"], pick.images).add(p["identity"])
                try:
                    before = [r for r in parse_file(bytes(content)) if r[0] in ("pages", "placements")]
                    out, report = clean(bytes(content), pick, rasterizer, reduction)
                    kept = {r["identity"] for name, r in before if name == "placements" and r["kind"] in (IMAGE, DRAWING, SHADOW) and r["is_safe"]}
                    checks = verify(out, sum(name == "pages" for name, _ in before), pick.images, kept if reduction is None else set())
                    row = (file_id, out if checks["passed"] else None, json.dumps(asdict(report)), json.dumps(checks), None if checks["passed"] else "verification failed")
                except Exception as error:  # one bad file does not stop the others
                    row = (file_id, None, None, None, f"{type(error).__name__}: {error}")
                yield pd.DataFrame([row], columns=["file_id", "content", "report", "checks", "error"])

    return files.select("file_id", "content").join(chosen, "file_id").mapInPandas(run, CLEANED)


def commit(content: bytes, source: str, destination: str) -> None:
    """Writes a cleaned copy beside its destination and moves it there in one step; never over the source."""
    if os.path.normcase(os.path.realpath(source)) == os.path.normcase(os.path.realpath(destination)):
        raise PdfError("the destination is the source")
    part = f"{destination}.part"
    try:
        with open(part, "wb") as out:
            out.write(content)
        os.replace(part, destination)
    finally:
        if os.path.exists(part):
            os.unlink(part)
