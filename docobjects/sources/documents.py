"""PDF files as relations: pages, placements, images, references, rejects.

Files are read with Spark's binary file source and parsed once, one file at a time, in Arrow batches; everything after that is
relational. A file that cannot be parsed becomes a row of rejects and does not disturb the others.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DRAWING, IMAGE, IMAGES, PAGES, PLACEMENTS, REFERENCES, REJECTS, SHADOW, SHAPE, TEXT
from .content import box_of, mapped_box, walk
from .fonts import read_font
from .images import is_flat
from .pdf import Document, Page, PdfError, Ref, Stream, operators, references

#: Why an image may not be removed; fixed text.
IN_FORM = "The image is part of a form that may be used in several places."

PARSED = "file_id string, relation string, body string"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest().upper()


def text_of(value: Any) -> str:
    return "+".join(str(v) for v in value) if isinstance(value, list) else "" if value is None else str(value)


def xobjects(doc: Document, resources: dict) -> Iterator[tuple[str, Ref, Stream]]:
    """(resource name, reference, stream) of the direct entries, in their order."""
    entries = doc.resolve(resources.get("XObject"))
    for name, ref in (entries or {}).items():
        stream = doc.resolve(ref)
        if isinstance(ref, Ref) and isinstance(stream, Stream):
            yield str(name), ref, stream


def nested_images(doc: Document, form: Stream, seen: set[Ref]) -> Iterator[tuple[str, Ref, Stream]]:
    """Images in a form's own resources, at any depth; each form is entered once."""
    resources = doc.resolve(form.info.get("Resources"))
    for name, ref, stream in xobjects(doc, resources if isinstance(resources, dict) else {}):
        if stream.info.get("Subtype") == "Image":
            yield name, ref, stream
        elif stream.info.get("Subtype") == "Form" and ref not in seen:
            seen.add(ref)
            yield from nested_images(doc, stream, seen)


def form_drawing(doc: Document, form: Stream) -> tuple[float, float, float, float] | None:
    """The box of the paths that a form paints itself, in the space of its caller; None if it paints none."""
    matrix = doc.resolve(form.info.get("Matrix")) or [1, 0, 0, 1, 0, 0]
    try:
        ops = operators(form.data(doc))
    except PdfError:
        return None
    points = [p for hit in walk(ops, {}, tuple(float(doc.resolve(v)) for v in matrix)) if hit.kind == "shape" and ops[hit.last].name != "n" for p in hit.points]
    return box_of(points) if points else None


def is_shadow(doc: Document, image: Stream) -> bool:
    """A flat colour under a soft mask: eight-bit RGB or grey, without filter or with Flate alone."""
    info = image.info
    channels = {"DeviceRGB": 3, "DeviceGray": 1}.get(text_of(doc.resolve(info.get("ColorSpace"))))
    filters = doc.resolve(info.get("Filter"))
    filters = filters if isinstance(filters, list) else [] if filters is None else [filters]
    if "SMask" not in info or channels is None or doc.resolve(info.get("BitsPerComponent")) != 8 or filters not in ([], ["FlateDecode"]):
        return False
    try:
        return is_flat(image.data(doc), int(doc.resolve(info["Width"])), int(doc.resolve(info["Height"])), channels)
    except (PdfError, KeyError, TypeError):
        return False


def masks_of(doc: Document, image: Stream) -> list[Ref]:
    """References of an image's masks that are images themselves."""
    out = []
    for key in ("SMask", "Mask"):
        ref = image.info.get(key)
        mask = doc.resolve(ref)
        if isinstance(ref, Ref) and isinstance(mask, Stream) and mask.info.get("Subtype") == "Image":
            out.append(ref)
    return out


def page_fonts(doc: Document, page: Page) -> dict:
    fonts = doc.resolve(page.resources.get("Font"))
    return {str(k): read_font(doc, v) for k, v in fonts.items()} if isinstance(fonts, dict) else {}


def parse_file(data: bytes) -> Iterator[tuple[str, dict]]:
    """(relation, row) for everything a file shows. seq numbers a page's objects: images, then texts, then shapes, then
    what forms hold. Images in forms stand at the box of the form's call (unsafe); a form that paints is a drawing."""
    doc = Document.open(data)
    images: dict[Ref, dict] = {}
    drawings: dict[Ref, Any] = {}

    def image_row(ref: Ref, stream: Stream) -> dict:
        if ref not in images:
            info, masks = stream.info, masks_of(doc, stream)
            images[ref] = {
                "object_id": str(ref),
                "hash": sha(stream.raw),
                "width": doc.resolve(info.get("Width")),
                "height": doc.resolve(info.get("Height")),
                "color_space": text_of(doc.resolve(info.get("ColorSpace"))),
                "bpc": doc.resolve(info.get("BitsPerComponent")),
                "filter": text_of(doc.resolve(info.get("Filter"))) or "Raw",
                "n_bytes": len(stream.raw),
                "is_mask": bool(doc.resolve(info.get("ImageMask"))),
                "smask_id": str(masks[0]) if masks else None,
                "is_shadow": is_shadow(doc, stream),
            }
        return images[ref]

    for page in doc.pages():
        yield "pages", {"page_number": page.number, "width_pt": page.width, "height_pt": page.height, "rotate": page.rotate}
        hits = list(walk(operators(doc.content(page)), page_fonts(doc, page)))
        seq, rows = 0, []

        def place(kind: int, identity: str, box: tuple, hides: bool, ref: Ref | None = None, name: str | None = None, reason: str | None = None, page=page, rows=rows) -> None:
            x, y, w, h = box
            rows.append({"page_number": page.number, "kind": kind, "identity": identity, "x": x, "y": y, "w": w, "h": h, "hides": hides, "object_id": None if ref is None else str(ref), "resource_name": name, "is_safe": reason is None, "unsafe_reason": reason})

        entries = list(xobjects(doc, page.resources))
        calls = {}
        for hit in hits:
            if hit.kind == "draw":
                calls.setdefault(hit.value, []).append(hit)
        for name, ref, stream in entries:
            if stream.info.get("Subtype") == "Image":
                row = image_row(ref, stream)
                for hit in calls.get(name, []):
                    place(SHADOW if row["is_shadow"] else IMAGE, row["hash"], hit.box, True, ref, name)
        for hit in hits:
            if hit.kind == "text":
                place(TEXT, hit.value, hit.box, True)
        for hit in hits:
            if hit.kind == "shape":
                place(SHAPE, hit.value, hit.box, hit.hides)
        for name, ref, stream in entries:
            if stream.info.get("Subtype") == "Form" and name in calls:
                for _, inner, image in nested_images(doc, stream, {ref}):
                    for hit in calls[name]:
                        place(IMAGE, image_row(inner, image)["hash"], hit.box, True, inner, name, IN_FORM)
                if ref not in drawings:
                    drawings[ref] = form_drawing(doc, stream)
                if drawings[ref]:
                    for hit in calls[name]:
                        place(DRAWING, sha(stream.raw), mapped_box(hit.matrix, *drawings[ref]), True, ref, name)
        for row in rows:
            seq += 1
            yield "placements", row | {"seq": seq}
    for row in images.values():
        yield "images", row
    for num in sorted(doc.places):
        for to in references(doc.object(num)):
            yield "refs", {"from_object": f"{num} 0 R", "to_object": str(to)}


def _parse(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        for file_id, content in zip(pdf.file_id, pdf.content, strict=True):
            try:
                rows = list(parse_file(bytes(content)))
            except Exception as error:  # a bad file becomes a row; its kind is told from type and message
                rows = [("rejects", {"error_kind": type(error).__name__, "message": str(error)})]
            yield pd.DataFrame({"file_id": file_id, "relation": [r for r, _ in rows], "body": [json.dumps(b) for _, b in rows]})


class PdfCorpus:
    """The relations of a set of files; parsed is computed once and shared by all of them."""

    def __init__(self, files: DataFrame):
        """files: file_id, content."""
        self.parsed = files.select("file_id", "content").mapInPandas(_parse, PARSED).persist()

    def _relation(self, name: str, ddl: str) -> DataFrame:
        rows = self.parsed.where(F.col("relation") == name).select("file_id", F.from_json("body", ddl).alias("r"))
        return rows.select("file_id", *[f"r.{c.strip().split(' ')[0]}" for c in ddl.split(",") if not c.strip().startswith("file_id ")])

    @property
    def pages(self) -> DataFrame:
        return self._relation("pages", PAGES)

    @property
    def placements(self) -> DataFrame:
        return self._relation("placements", PLACEMENTS)

    @property
    def images(self) -> DataFrame:
        return self._relation("images", IMAGES)

    @property
    def references(self) -> DataFrame:
        return self._relation("refs", REFERENCES)

    @property
    def rejects(self) -> DataFrame:
        return self._relation("rejects", REJECTS)


def read_pdfs(spark: SparkSession, path: str | list[str]) -> PdfCorpus:
    """All PDF files under a path (or several), from any file system that Spark reads; the same path counts once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return PdfCorpus(files.dropDuplicates(["path"]).select(F.col("path").alias("file_id"), "content"))


def has_pdf_signature(content: Column) -> Column:
    """Column: at least 64 bytes with %PDF- among the first 1024, as bytes (no text decoding)."""
    head = F.hex(F.substring(content, 1, 1024))
    return (F.octet_length(content) >= 64) & head.rlike(r"^(?:..)*255044462D")


def wanted_images(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted image hash that can be shown: not masked, and no filter that nothing here decodes."""
    readable = images.where(~F.col("filter").rlike("JPXDecode|JBIG2Decode|CCITTFaxDecode"))
    return readable.join(wanted.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])



def png(samples: bytes, width: int, height: int, channels: int) -> bytes:
    """Eight-bit grey or RGB samples as a PNG file."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    row = width * channels
    lines = b"".join(b"\0" + samples[y * row : (y + 1) * row] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def thumbnail(doc: Document, image: Stream) -> tuple[str, bytes] | None:
    """(format, bytes) of an image: PNG where its samples can be read, its own bytes where it is a JPEG, otherwise nothing."""
    info = image.info
    filters = doc.resolve(info.get("Filter"))
    last = filters[-1] if isinstance(filters, list) and filters else filters
    try:
        data = image.raw if last == "DCTDecode" and filters in ("DCTDecode", ["DCTDecode"]) else image.data(doc)
        if last == "DCTDecode":
            return ("jpeg", bytes(data)) if data[:2] == b"\xff\xd8" else None
        channels = {"DeviceRGB": 3, "DeviceGray": 1}.get(text_of(doc.resolve(info.get("ColorSpace"))))
        width, height = int(doc.resolve(info["Width"])), int(doc.resolve(info["Height"]))
        if channels is None or doc.resolve(info.get("BitsPerComponent")) != 8 or len(data) < width * height * channels:
            return None
        return "png", png(data, width, height, channels)
    except (PdfError, KeyError, TypeError, ValueError, zlib.error):
        return None


def thumbnails(files: DataFrame, images: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash, format, thumbnail for the wanted image hashes; an image that cannot be shown has null.

    Only wanted images are decoded, each hash once, in the first file that holds it; a file without one is not opened.
    """
    chosen = images.join(wanted.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.min(F.struct("file_id", "object_id")).alias("x"))
    # Per file the objects to decode; what is listed here is one file's own wanted images.
    by_file = chosen.groupBy("x.file_id").agg(F.collect_list(F.struct("hash", "x.object_id")).alias("todo"))

    def decode(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for content, todo in zip(pdf.content, pdf.todo, strict=True):
                doc, rows = Document.open(bytes(content)), []
                for x in todo:
                    num, gen, _ = x["object_id"].split(" ")
                    image = doc.resolve(Ref(int(num), int(gen)))
                    shown = thumbnail(doc, image) if isinstance(image, Stream) else None
                    rows.append((x["hash"], *(shown or (None, None))))
                yield pd.DataFrame(rows, columns=["hash", "format", "thumbnail"])

    return files.select("file_id", "content").join(by_file, "file_id").mapInPandas(decode, "hash string, format string, thumbnail binary")
