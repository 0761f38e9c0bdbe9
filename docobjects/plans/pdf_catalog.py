"""Queries over generated PDF files, and what these are known to hold as SQL: they are drawn here, so it is told beforehand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import covers_page
from ..functions.text import REMEDIES, error_kind, error_remedy
from ..lineage import cut
from ..operators import grouping as A
from ..operators import overlap as O
from ..operators.cleaning import clean_files
from ..sources.documents import IN_FORM, PdfCorpus, has_pdf_signature, thumbnails
from ..sources.samples import samples


def sample_files(spark: SparkSession) -> DataFrame:
    """The generated files and a broken one, as file_id and content."""
    rows = [(name, bytearray(data)) for name, data in samples().items()] + [("broken.pdf", bytearray(b"%PDF-1.4 " + b"?" * 80)), ("empty.pdf", bytearray())]
    return spark.createDataFrame(rows, "file_id string, content binary").repartition(4)


def pdf_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that the sample files show, by file. Texts and shapes are named by what they are, pictures and drawings by
    the number of files that show the same."""
    groups = A.number_within_file(A.object_groups(PdfCorpus(sample_files(spark)).placements))
    files = groups.groupBy("kind", "identity").agg(F.count_distinct("file_id").alias("files"))
    named = F.when(F.col("kind").isin(1, 2), F.col("identity")).alias("label")
    return groups.join(files, ["kind", "identity"]).select("file_id", "object_id", "kind", named, "usage_count", "page_count", "files", "is_safe", "unsafe_reason")


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of the sample files."""
    return PdfCorpus(sample_files(spark)).pages.select("file_id", "page_number", "width_pt", "height_pt", "rotate")


def pdf_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sample files show pictures, shapes, drawings and shadows, in drawing order."""
    placed = PdfCorpus(sample_files(spark)).placements.where("kind <> 1")
    hundredths = [F.round(c, 2).alias(c) for c in ("x", "y", "w", "h")]
    return placed.select("file_id", "page_number", "kind", *hundredths, "hides", "is_safe")


def pdf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored images that the sample files show."""
    return PdfCorpus(sample_files(spark)).images.select("file_id", "width", "height", "color_space", "bpc", "filter", "is_mask", F.col("smask_id").isNotNull().alias("masked"), "is_shadow")


def pdf_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of all images that are drawn, each once: the size that the picture itself tells, and the files that show it."""
    files = sample_files(spark)
    corpus = PdfCorpus(files)
    drawn = corpus.placements.where("kind in (0, 4)")
    shown = thumbnails(files, corpus.images, drawn.select(F.col("identity").alias("hash")))
    places = drawn.groupBy(F.col("identity").alias("hash")).agg(F.count_distinct("file_id").alias("files"))
    side = lambda at: F.when(F.col("format") == "png", F.conv(F.hex(F.substring("thumbnail", at, 4)), 16, 10).cast("long"))
    return shown.join(places, "hash").select("format", side(17).alias("width"), side(21).alias("height"), "files")


def pdf_merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the sample files merged over all files: uses, files, bytes, safety, full pages, and whether there is a thumbnail."""
    files = sample_files(spark)
    corpus = PdfCorpus(files)
    key = ["file_id", "kind", "identity"]
    placed = corpus.placements.where("kind in (0, 4)").join(corpus.pages, ["file_id", "page_number"])
    groups = A.object_groups(placed).select(*key, "usage_count", "is_safe")
    full = placed.groupBy(*key).agg(F.bool_or(covers_page(F.col("w"), F.col("h"), F.col("width_pt"), F.col("height_pt"))).alias("full_page"))
    sizes = corpus.images.groupBy("file_id", F.col("hash").alias("identity")).agg(F.sum("n_bytes").alias("estimated_bytes"))
    found = thumbnails(files, corpus.images, placed.select(F.col("identity").alias("hash")))
    pictures = A.first_thumbnails(placed, found, key)
    merged = A.merge_files(groups.join(full, key).join(sizes, ["file_id", "identity"]).join(pictures, key), ["kind", "identity"], "file_id")
    # Bytes of uncompressed samples are told by the sample files; of others only that there are some.
    return merged.select("kind", "usage_count", "file_count", F.when(F.col("estimated_bytes") > 5000, F.col("estimated_bytes")).alias("estimated_bytes"), "is_safe", "full_page", F.col("thumbnail").isNotNull().alias("has_thumbnail"))


def pdf_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the sample files where objects of different kinds overlap, in reading order."""
    page = ["file_id", "page_number"]
    corpus = PdfCorpus(sample_files(spark))
    size = corpus.pages.select(*page, "width_pt", "height_pt")
    width, height = F.col("width_pt"), F.col("height_pt")
    placed = corpus.placements.where("is_safe and kind <> 3").join(size, page).withColumn("obj", F.col("seq"))
    members = O.region_members(O.overlap_edges(placed, page, width, height), page)
    found = O.regions(placed, members, page, width, height)
    return O.reading_order(found, page, "top", "left", ["region"], "unit_no").select(*page, "unit_no", "members", "kinds", "left", "bottom", "right", "top", "covers_page")


def pdf_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cannot be analysed, with their kind of error and what to do."""
    files = sample_files(spark)
    rejects = PdfCorpus(files).rejects.join(files.select("file_id", has_pdf_signature(F.col("content")).alias("signature")), "file_id")
    kind = F.when(~F.col("signature"), "NotAPdf").otherwise(error_kind(F.col("error_kind"), F.col("message")))
    return rejects.select("file_id", "signature", kind.alias("kind")).withColumn("remedy", error_remedy(F.col("kind")))


def pdf_clean_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned copies of the sample files without objects drawn at least twice, parsed again: what is left of these is nothing."""
    files = sample_files(spark)
    groups = A.object_groups(PdfCorpus(files).placements).where("usage_count >= 2 and is_safe")
    cleaned = cut(clean_files(files, groups.select("file_id", "kind", "identity")))
    again = A.object_groups(PdfCorpus(cleaned.where("content is not null")).placements)
    left = groups.join(again, ["file_id", "kind", "identity"], "left_semi").groupBy("file_id").agg(F.count(F.lit(1)).alias("left_over"))
    report = F.from_json("report", "pages_modified int, draw_calls_removed int, kept_back int, objects_removed int").alias("r")
    return cleaned.select("file_id", report, "error").join(left, "file_id", "left").select("file_id", "r.*", F.coalesce("left_over", F.lit(0)).cast("long").alias("left_over"), "error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (pdf_placements, pdf_pages, pdf_boxes, pdf_images, pdf_thumbnails, pdf_merged_groups, pdf_regions, pdf_rejects, pdf_clean_roundtrip)
}


def values(columns: str, types: str, rows: list[tuple]) -> str:
    """SQL for these rows."""
    literal = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    names, kinds = columns.split(), types.split()
    listed = ", ".join(f'CAST("{n}" AS {t}) AS "{n}"' for n, t in zip(names, kinds, strict=True))
    quoted = ", ".join(f'"{n}"' for n in names)
    return f"SELECT {listed} FROM (VALUES {', '.join('(' + ', '.join(literal(v) for v in r) + ')' for r in rows)}) AS t({quoted})"


# What the sample files hold, as they are drawn: the logo stands in six files, the photo in three, the scan in two.
_FLATTEN = ("flatten-units-a.pdf", "flatten-units-b.pdf")
_TEXTS = {
    "one-image.pdf": {"A paragraph": 1},
    "repeated-logo.pdf": {f"Page {i}": 1 for i in range(1, 6)},
    "image-and-text.pdf": {"Text over it": 1},
    "rotated-page.pdf": {"Text over it": 1},
    "full-page-overlap.pdf": {"A caption on the scan": 1},
    "repeated-text.pdf": {"CONFIDENTIAL": 3, "Company Footer 2026": 3, **{f"Only on page {i}": 1 for i in range(1, 4)}},
    "single-character-text.pdf": {"   ": 3, "S": 3, "Body 0": 1, "Body 1": 1, "Body 2": 1, "X": 1},
    **{f: {"Alone": 2, "Caption": 2} for f in _FLATTEN},
}
# By file, the images in the order of their hashes: uses, files that show the same, kind.
_IMAGES = {
    "one-image.pdf": [(1, 6, 0)],
    "repeated-logo.pdf": [(5, 6, 0)],
    "multiple-images.pdf": [(1, 1, 0), (1, 3, 0), (1, 6, 0)],
    "image-and-text.pdf": [(1, 3, 0)],
    "rotated-page.pdf": [(1, 3, 0)],
    "scanned-page.pdf": [(1, 2, 0)],
    "full-page-overlap.pdf": [(1, 2, 0)],
    "jpeg-image.pdf": [(1, 1, 0)],
    "soft-masked-image.pdf": [(1, 1, 0)],
    "shadow-layer.pdf": [(1, 1, 0), (1, 1, 0), (1, 1, 4)],
    "annotation-shared-image.pdf": [(1, 1, 0)],
    "form-embedded-image.pdf": [(2, 6, 0)],
    **{f: [(2, 6, 0)] for f in _FLATTEN},
}
_LINE = "|S|w:1|s:0,0,0|f:-"
_SHAPES = {
    "repeated-shapes.pdf": [
        ("m 0,0;l 460,0" + _LINE, 3),
        ("re 0,0 30,0 30,30 0,30|S|w:1|s:0,0,255|f:-", 3),
        ("re 0,0 460,0 460,680 0,680" + _LINE, 3),
        *[(f"m 0,0;l 260,{100 + 40 * i}" + _LINE, 1) for i in range(3)],
    ],
    "form-drawn-shapes.pdf": [("re 0,0 555,0 555,802 0,802|S|w:1|s:-|f:-", 2)],
    "flatten-units-a.pdf": [("re 0,0 80,0 80,60 0,60|f|w:1|s:-|f:255,127,0", 1)],
}
_PAGES = {"repeated-logo.pdf": 5, "repeated-text.pdf": 3, "repeated-shapes.pdf": 3, "single-character-text.pdf": 3} | {f: 2 for f in ("form-embedded-image.pdf", "form-drawn-shapes.pdf", *_FLATTEN)}
_PREFIXES = ["IMG", "TXT", "SHP", "DRW", "SHD"]


def _placements() -> list[tuple]:
    rows = []

    def add(file: str, kind: int, own: list[tuple]) -> None:
        for i, (label, uses, files) in enumerate(own):
            unsafe = file == "form-embedded-image.pdf"
            rows.append((file, f"{_PREFIXES[kind]}_{i + 1:03d}", kind, label, uses, uses, files, not unsafe, IN_FORM if unsafe else None))

    for file, texts in _TEXTS.items():
        add(file, 1, [(t, n, sum(t in x for x in _TEXTS.values())) for t, n in sorted(texts.items(), key=lambda x: (-x[1], x[0]))])
    for file, images in _IMAGES.items():
        for kind in (0, 4):
            add(file, kind, [(None, n, f) for n, f, k in images if k == kind])
    for file, shapes in _SHAPES.items():
        add(file, 2, [(t, n, 1) for t, n in sorted(shapes, key=lambda x: (-x[1], x[0]))])
    add("form-drawn-shapes.pdf", 3, [(None, 2, 1)])
    return rows


def _boxes() -> list[tuple]:
    rows = [
        ("one-image.pdf", 1, 0, 40, 722, 240, 80),
        *[("repeated-logo.pdf", i, 0, 40, 722, 240, 80) for i in range(1, 6)],
        ("multiple-images.pdf", 1, 0, 40, 722, 240, 80),
        ("multiple-images.pdf", 1, 0, 40, 400, 300, 220),
        ("multiple-images.pdf", 1, 0, 40, 300, 64, 64),
        *[(f, 1, 0, 40, 400, 500, 300) for f in ("image-and-text.pdf", "rotated-page.pdf")],
        *[(f, 1, 0, 0, 0, 595, 842) for f in ("scanned-page.pdf", "full-page-overlap.pdf")],
        ("jpeg-image.pdf", 1, 0, 100, 500, 200, 150),
        ("soft-masked-image.pdf", 1, 0, 60, 500, 200, 150),
        *[("shadow-layer.pdf", 1, kind, 60, y, 120, 80) for kind, y in ((4, 600), (0, 480), (0, 360))],
        ("annotation-shared-image.pdf", 1, 0, 100, 100, 32, 32),
        *[(f, i, 0, 100, 600, 240, 80) for f in _FLATTEN for i in (1, 2)],
        ("flatten-units-a.pdf", 1, 2, 300, 650, 80, 60),
        *[("form-drawn-shapes.pdf", i, 2, 20, 20, 555, 802) for i in (1, 2)],
        *[("form-drawn-shapes.pdf", i, 3, 110, 510, 80, 80) for i in (1, 2)],
    ]
    for i in range(3):
        rows += [("repeated-shapes.pdf", i + 1, 2, *box) for box in ((40, 790, 460, 0), (40, 80, 460, 680), (40, 100 + 50 * i, 260, 100 + 40 * i), (60 + 40 * i, 300, 30, 30))]
    # Strokes alone hide nothing; an image in a form is placed by the unit square of the form's call.
    hides = lambda r: r[2] != 2 or r[0] == "flatten-units-a.pdf"
    return [(*r, hides(r), True) for r in rows] + [("form-embedded-image.pdf", i, 0, 40, 700, 1, 1, True, False) for i in (1, 2)]


_RGB = ("DeviceRGB", 8, "Raw", False)
ORACLES = {
    "pdf_placements": values("file_id object_id kind label usage_count page_count files is_safe unsafe_reason", "VARCHAR VARCHAR INT VARCHAR BIGINT BIGINT BIGINT BOOLEAN VARCHAR", _placements()),
    "pdf_pages": values(
        "file_id page_number width_pt height_pt rotate",
        "VARCHAR INT DOUBLE DOUBLE INT",
        [(f, i, 595, 842, 90 if f == "rotated-page.pdf" else 0) for f in sorted({*_TEXTS, *_IMAGES, *_SHAPES}) for i in range(1, _PAGES.get(f, 1) + 1)],
    ),
    "pdf_boxes": values("file_id page_number kind x y w h hides is_safe", "VARCHAR INT INT DOUBLE DOUBLE DOUBLE DOUBLE BOOLEAN BOOLEAN", _boxes()),
    "pdf_images": values(
        "file_id width height color_space bpc filter is_mask masked is_shadow",
        "VARCHAR INT INT VARCHAR INT VARCHAR BOOLEAN BOOLEAN BOOLEAN",
        [
            *[(f, 240, 80, *_RGB, False, False) for f in ("one-image.pdf", "repeated-logo.pdf", "multiple-images.pdf", "form-embedded-image.pdf", *_FLATTEN)],
            *[(f, 400, 300, *_RGB, False, False) for f in ("multiple-images.pdf", "image-and-text.pdf", "rotated-page.pdf")],
            ("multiple-images.pdf", 64, 64, *_RGB, False, False),
            *[(f, 80, 110, *_RGB, False, False) for f in ("scanned-page.pdf", "full-page-overlap.pdf")],
            ("jpeg-image.pdf", 1, 1, "DeviceGray", 8, "DCTDecode", False, False, False),
            ("soft-masked-image.pdf", 64, 48, *_RGB, True, False),
            ("shadow-layer.pdf", 48, 32, "DeviceRGB", 8, "FlateDecode", False, True, True),
            ("shadow-layer.pdf", 48, 32, *_RGB, True, False),
            ("shadow-layer.pdf", 48, 32, *_RGB, False, False),
            ("annotation-shared-image.pdf", 32, 32, *_RGB, False, False),
        ],
    ),
    "pdf_thumbnails": values(
        "format width height files",
        "VARCHAR BIGINT BIGINT BIGINT",
        [("png", 240, 80, 6), ("png", 400, 300, 3), ("png", 80, 110, 2), ("png", 64, 64, 1), ("png", 64, 48, 1), ("png", 32, 32, 1), *[("png", 48, 32, 1)] * 3, ("jpeg", None, None, 1)],
    ),
    "pdf_merged_groups": values(
        "kind usage_count file_count estimated_bytes is_safe full_page has_thumbnail",
        "INT BIGINT BIGINT BIGINT BOOLEAN BOOLEAN BOOLEAN",
        [
            (0, 13, 6, 6 * 240 * 80 * 3, False, False, True),
            (0, 3, 3, 3 * 400 * 300 * 3, True, False, True),
            (0, 2, 2, 2 * 80 * 110 * 3, True, True, True),
            (0, 1, 1, 64 * 64 * 3, True, False, True),
            (0, 1, 1, 64 * 48 * 3, True, False, True),
            (0, 1, 1, None, True, False, True),
            (0, 1, 1, None, True, False, True),
            (0, 1, 1, None, True, False, True),
            (0, 1, 1, None, True, False, True),
            (4, 1, 1, None, True, False, True),
        ],
    ),
    "pdf_regions": values(
        "file_id page_number unit_no members kinds left bottom right top covers_page",
        "VARCHAR INT INT BIGINT BIGINT DOUBLE DOUBLE DOUBLE DOUBLE BOOLEAN",
        [
            *[(f, 1, 1, 2, 2, 40, 400, 540, 700, False) for f in ("image-and-text.pdf", "rotated-page.pdf")],
            ("full-page-overlap.pdf", 1, 1, 2, 2, 0, 0, 595, 842, True),
            ("flatten-units-a.pdf", 1, 1, 3, 3, 100, 600, 380, 710, False),
            *[(f, i, 1, 2, 2, 100, 600, 340, 680, False) for f, i in (("flatten-units-a.pdf", 2), ("flatten-units-b.pdf", 1), ("flatten-units-b.pdf", 2))],
        ],
    ),
    "pdf_rejects": values("file_id signature kind remedy", "VARCHAR BOOLEAN VARCHAR VARCHAR", [("broken.pdf", True, "PdfCorrupted", REMEDIES["PdfCorrupted"]), ("empty.pdf", False, "NotAPdf", REMEDIES["NotAPdf"])]),
    # Draw calls: uses of what is drawn at least twice; stored objects: the images and forms among it.
    "pdf_clean_roundtrip": values(
        "file_id pages_modified draw_calls_removed kept_back objects_removed left_over error",
        "VARCHAR INT INT INT INT BIGINT VARCHAR",
        [
            *[(f, 2, 6, 0, 1, 0, None) for f in _FLATTEN],
            ("form-drawn-shapes.pdf", 2, 4, 0, 1, 0, None),
            ("repeated-logo.pdf", 5, 5, 0, 1, 0, None),
            ("repeated-shapes.pdf", 3, 9, 0, 0, 0, None),
            ("repeated-text.pdf", 3, 6, 0, 0, 0, None),
            ("single-character-text.pdf", 3, 6, 0, 0, 0, None),
        ],
    ),
}

__all__ = ["ORACLES", "QUERIES", "sample_files"]
