"""PDF files with known contents: parsing, cleaning, verification; and the bytes that are no PDF."""

import zlib
from collections import Counter

import pytest

from docobjects.operators.cleaning import Place, Reduction, Selection, clean, clean_files, commit, isolated, verify
from docobjects.plans import pdf_catalog
from docobjects.sources import images
from docobjects.sources.content import walk
from docobjects.sources.documents import PdfCorpus, has_pdf_signature, parse_file, read_pdfs
from docobjects.sources.fonts import CMap, Font
from docobjects.sources.pdf import Document, Lexer, Name, PdfError, Ref, Stream, has_signature, operators, serialise
from docobjects.sources.samples import Builder, draw, samples
from docobjects.sources.settings import ImageLimit, Settings, load, save, unused_name

FILES = samples()


def rows(data, relation="placements"):
    return [r for name, r in parse_file(data) if name == relation]


def usage(data):
    return Counter((r["kind"], r["identity"]) for r in rows(data))


def hits(content, fonts=None):
    return list(walk(operators(content), fonts or {}))


# ---- objects -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "value",
    [None, True, 12, -3.5, b"text (with) \\ marks", bytes(range(256)), Name("A B#/"), [1, [Ref(3, 0)], {"K": Name("V")}], {"A": {"B": []}}],
)
def test_objects_round_trip(value):
    assert Lexer(serialise(value)).read() == value


def test_strings_and_names():
    assert Lexer(rb"(a\n\101\)(x)\
b)").read() == b"a\nA)(x)b"
    assert Lexer(b"<48656C6C6F7>").read() == b"Hellop"
    assert Lexer(b"/A#20B").read() == "A B"
    assert Lexer(b"% note\n 7").read() == 7


def test_inline_images_are_skipped():
    assert [op.name for op in operators(b"q BI /W 1 /H 1 ID \x00Q\xff EI Q /Im1 Do")] == ["q", "Q", "Do"]


def object_stream_file():
    """A file whose page tree lies in an object stream, with a cross-reference stream and a predictor."""
    inner = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R]/Count 1>>"), (3, b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 100 100]/Contents 5 0 R>>")]
    heads, body = "", b""
    for n, b in inner:
        heads += f"{n} {len(body)} "
        body += b + b" "
    packed = zlib.compress(heads.encode() + body)
    out = b"%PDF-1.5\n" + b"%" * 60 + b"\n"
    at4 = len(out)
    out += b"4 0 obj\n<</Type/ObjStm/N 3/First %d/Filter/FlateDecode/Length %d>>\nstream\n" % (len(heads), len(packed)) + packed + b"\nendstream\nendobj\n"
    at5 = len(out)
    out += b"5 0 obj\n<</Length 14>>\nstream\n0 0 10 10 re f\nendstream\nendobj\n"
    at6 = len(out)
    entries = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0), (1, at6, 0)]
    table = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([c]) for k, a, c in entries)
    lines, before = b"", bytes(4)
    for i in range(0, len(table), 4):
        row = table[i : i + 4]
        lines += b"\2" + bytes((a - b) & 255 for a, b in zip(row, before))
        before = row
    packed = zlib.compress(lines)
    out += b"6 0 obj\n<</Type/XRef/Size 7/W[1 2 1]/Root 1 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 4>>/Length %d>>\nstream\n" % len(packed)
    return out + packed + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at6


def test_object_streams_and_predictors():
    assert [(r["kind"], r["w"]) for r in rows(object_stream_file())] == [(2, 10.0)]


def test_recovers_without_table():
    data = FILES["repeated-text.pdf"]
    broken = data[: data.rindex(b"startxref")] + b"startxref\n99999999\n%%EOF"
    assert usage(broken) == usage(data)


@pytest.mark.parametrize("data", [b"", b"%PDF-1.4", b"x" * 2000 + b"%PDF-1.7" + b"y" * 100, b"plain text " * 20])
def test_no_signature(data):
    assert not has_signature(data)


def test_signature_after_junk():
    assert has_signature(b"junk" * 10 + b"%PDF-1.4" + b" " * 100)


def test_encrypted_and_broken_files_are_refused():
    data = FILES["one-image.pdf"].replace(b"trailer\n<<", b"trailer\n<</Encrypt 9 0 R ")
    with pytest.raises(PdfError):
        Document.open(data)
    with pytest.raises(PdfError):
        Document.open(b"%PDF-1.4 " + b"?" * 80)


# ---- content -----------------------------------------------------------------------------------------------


def test_text_positions():
    (hit,) = hits(b"BT /F1 12 Tf 100 700 Td (Hello) Tj ET")
    assert hit.value == "Hello" and hit.box == pytest.approx((100, 697, 30, 13.2))
    first, second = hits(b"BT /F1 12 Tf 14 TL 100 700 Td (a) Tj T* (b) Tj ET")
    assert second.box[:2] == pytest.approx((100, 683)) and first.box[0] == 100
    (hit,) = hits(b"BT /F1 12 Tf [(ab) -1000 (cd)] TJ ET")
    assert hit.value == "abcd" and hit.box[2] == pytest.approx(36)
    assert hits(b"BT /F1 12 Tf () Tj ET") == []


def test_transform_stack():
    (hit,) = hits(b"Q q 2 0 0 2 0 0 cm q 1 0 0 1 5 5 cm /A Do Q Q")
    assert hit.box == pytest.approx((10, 10, 2, 2))


def test_paths():
    clip, box = b"0 0 10 10 re W n\n", b"1 0 0 1 5 5 cm 0 0 1 rg 0 0 10 20 re f"
    (hit,) = hits(clip + box)
    assert hit.box == (5, 5, 10, 20) and hit.hides and hit.fill == (0, 0, 255)
    (line,) = hits(b"0 0 m 10 0 l S")
    assert not line.hides
    a, b = hits(b"10 10 m 20 30 l S 110.04 10 m 120.04 30 l S")
    assert a.value == b.value
    assert [h.fill for h in hits(b"0.5 g 0 0 1 1 re f 0 0 0 1 k 0 0 1 1 re f")] == [(127, 127, 127), (0, 0, 0)]


def test_cmap():
    cmap = CMap.parse(b"begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0041> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <00790079>] endbfrange")
    assert cmap.width == 2 and cmap.decode(b"\0\3\0\x11\0\x21\0\x99") == "Abyy�"
    font = Font(cmap=cmap, composite=True, widths={3: 250.0}, missing=1000.0)
    (hit,) = hits(b"BT /F 10 Tf <00030010> Tj ET", {"F": font})
    assert hit.value == "Aa" and hit.box[2] == pytest.approx(12.5)


# ---- files -------------------------------------------------------------------------------------------------


def test_known_contents():
    def images_of(name):
        return [r for r in rows(FILES[name]) if r["kind"] in (0, 4)]

    assert len(images_of("one-image.pdf")) == 1 and images_of("one-image.pdf")[0]["is_safe"]
    assert [r["page_number"] for r in images_of("repeated-logo.pdf")] == [1, 2, 3, 4, 5]
    assert len(usage(FILES["multiple-images.pdf"])) == 3
    assert sorted(usage(FILES["repeated-shapes.pdf"]).values()) == [1, 1, 1, 3, 3, 3]
    assert all(not r["is_safe"] and r["unsafe_reason"] for r in images_of("form-embedded-image.pdf"))
    assert [k for k, _ in usage(FILES["form-drawn-shapes.pdf"])] == [2, 3]
    drawing = [r for r in rows(FILES["form-drawn-shapes.pdf"]) if r["kind"] == 3][0]
    assert (drawing["x"], drawing["y"], drawing["w"], drawing["h"]) == (110, 510, 80, 80)
    assert sorted(r["kind"] for r in rows(FILES["shadow-layer.pdf"])) == [0, 0, 4]
    assert rows(FILES["rotated-page.pdf"], "pages")[0]["rotate"] == 90


def test_remove_shapes_and_texts():
    data = FILES["repeated-shapes.pdf"]
    often = {i for (_, i), n in usage(data).items() if n == 3}
    out, report = clean(data, Selection(shapes=often))
    assert (report.pages_modified, report.draw_calls_removed) == (3, 9)
    assert not often & {i for _, i in usage(out)} and len(usage(out)) == 3
    out, report = clean(FILES["repeated-text.pdf"], Selection(texts={"CONFIDENTIAL"}))
    assert report.draw_calls_removed == 3 and usage(out)[1, "Company Footer 2026"] == 3 and usage(out)[1, "CONFIDENTIAL"] == 0


def test_removed_images_leave_the_file_unless_used():
    data = FILES["soft-masked-image.pdf"]
    h = rows(data)[0]["identity"]
    out, report = clean(data, Selection(images={h}))
    assert report.objects_removed == 2 and report.kept_back == 0 and len(out) < 1000
    data = FILES["annotation-shared-image.pdf"]
    h = rows(data)[0]["identity"]
    out, report = clean(data, Selection(images={h}))
    assert report.kept_back == 1 and rows(out) == [] and verify(out, 1, {h}, set())["passed"]


def grey(data, page, box, dpi):
    return 2, 2, b"\x80" * 12


def test_flatten_hide_and_isolate():
    data = FILES["flatten-units-a.pdf"]
    logo = next(r for r in rows(data) if r["kind"] == 0)
    box = tuple(logo[k] for k in "xywh")
    place = Place(1, box, [(0, logo["identity"]), (1, "Caption")], flatten=True)
    out, report = clean(data, Selection(places=[place]), grey)
    assert report.places_flattened == 1
    first = [r for r in rows(out) if r["page_number"] == 1]
    assert [r["kind"] for r in first] == [0, 1, 2] and first[0]["identity"] != logo["identity"] and (first[0]["x"], first[0]["w"]) == (100, 240)
    assert usage(out)[1, "Caption"] == 1 and usage(out)[0, logo["identity"]] == 1
    same, report = clean(data, Selection(places=[place]), lambda *_: None)
    assert report.places_flattened == 0 and usage(same) == usage(data)
    with pytest.raises(PdfError):
        clean(data, Selection(places=[place]))
    hidden, _ = clean(data, Selection(places=[Place(2, box, [(0, logo["identity"])])]))
    assert usage(hidden)[0, logo["identity"]] == 1 and usage(hidden)[1, "Caption"] == 2
    assert [(r["kind"], r["page_number"]) for r in rows(isolated(data, 1, place)) if r["page_number"] == 1] == [(0, 1), (1, 1)]


def test_reduction():
    b = Builder((72, 72))
    b.page(draw("Im1", 0, 0, 72, 72), {"Im1": b.image(400, 400, 5, flate=True)})
    out, report = clean(b.bytes(), Selection(), None, Reduction(level=1))
    (image,) = rows(out, "images")
    assert report.images_resized == 1 and (image["width"], image["height"]) == (140, 140)
    out, report = clean(b.bytes(), Selection(), None, Reduction(level=4))
    assert report.images_resized == 0


def test_verification_finds_what_is_left():
    data = FILES["multiple-images.pdf"]
    hashes = [r["identity"] for r in rows(data)]
    assert not verify(data, 1, {hashes[0]}, set())["passed"]
    assert verify(data, 1, set(), {hashes[0], "not there"})["passed"] and not verify(data, 1, set(), {hashes[0], "not there"}, strict=True)["passed"]
    assert not verify(data, 2, set(), set())["passed"] and not verify(b"", 1, set(), set())["opens"]


def test_commit(tmp_path):
    source = tmp_path / "a.pdf"
    source.write_bytes(b"old")
    with pytest.raises(PdfError):
        commit(b"new", str(source), str(source))
    commit(b"new", str(source), str(tmp_path / "b.pdf"))
    assert (tmp_path / "b.pdf").read_bytes() == b"new" and sorted(p.name for p in tmp_path.iterdir()) == ["a.pdf", "b.pdf"]


# ---- images and settings -----------------------------------------------------------------------------------


def png(w, h, chunk=b"IHDR"):
    return b"\x89PNG\r\n\x1a\n\0\0\0\x0d" + chunk + w.to_bytes(4, "big") + h.to_bytes(4, "big")


def jpeg(quality, w=30, h=20):
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    table = bytes(min(max((int(v) * scale + 50) // 100, 1), 255) for v in images.STANDARD_LUMINANCE.ravel())
    return b"\xff\xd8\xff\xdb\0\x43\0" + table + b"\xff\xc0\0\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\3" + bytes(9) + b"\xff\xd9"


def test_image_headers():
    assert images.dimensions(png(7, 9)) == (7, 9) and images.dimensions(jpeg(50)) == (30, 20)
    assert images.safe_to_decode(png(8000, 10_000)) and not images.safe_to_decode(png(40_000, 40_000))
    assert not any(images.safe_to_decode(x) for x in (png(0, 5), png(5, 5)[:20], png(5, 5, b"IDAT"), b"GIF89a", b""))


@pytest.mark.parametrize("quality", [10, 50, 75, 85, 95])
def test_jpeg_quality(quality):
    assert abs(images.jpeg_quality(jpeg(quality)) - quality) <= 1


def test_jpeg_quality_is_unknown():
    assert images.jpeg_quality(b"no jpeg") is None and images.jpeg_quality(b"\xff\xd8\xff\xd9") is None


def test_flat_and_resize():
    assert images.is_flat(b"\1\2\3" * 6, 3, 2, 3) and not images.is_flat(b"\1\2\3" * 5 + b"\1\2\4", 3, 2, 3) and not images.is_flat(b"\1", 3, 2, 3)
    assert images.resize(b"\7" * 48, 4, 4, 3, 2, 2) == b"\7" * 12 and images.resize(b"", 4, 4, 3, 2, 2) is None


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert load(path) == Settings()
    save(Settings(True, ImageLimit.FINE, 20), path)
    assert load(path) == Settings(True, ImageLimit.FINE, 50)
    (tmp_path / "s.json").write_text("{broken")
    assert load(path) == Settings()
    assert unused_name("a.pdf", {"a.pdf", "a (2).pdf"}) == "a (3).pdf" and unused_name("b", set()) == "b"


# ---- on Spark ----------------------------------------------------------------------------------------------


def test_corpus_from_files(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 " + b"?" * 80)
    (tmp_path / "note.txt").write_text("no pdf")
    corpus = read_pdfs(spark, str(tmp_path))
    assert corpus.placements.count() == sum(len(rows(d)) for d in FILES.values())
    assert corpus.images.where("is_shadow").count() == 1 and corpus.pages.count() == sum(len(rows(d, "pages")) for d in FILES.values())
    assert [r.file_id.rsplit("/")[-1] for r in corpus.rejects.collect()] == ["broken.pdf"]
    assert corpus.references.count() > 100


def test_signature_column(spark):
    import pyspark.sql.functions as F

    data = [FILES["one-image.pdf"], b"", b"\xff\xfe" * 40 + b"%PDF-1.4" + b" " * 90, b"A%PDF" * 40, b" " * 1020 + b"%PDF-1.4" + b" " * 50]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, content binary")
    got = {r.i: r.ok for r in df.select("i", has_pdf_signature(F.col("content")).alias("ok")).collect()}
    assert got == {i: has_signature(d) for i, d in enumerate(data)}


def test_catalogue(spark):
    groups = pdf_catalog.pdf_placements(spark, "").collect()
    assert {r.object_id for r in groups if r.file_id == "repeated-logo.pdf"} == {"IMG_001", "TXT_001", "TXT_002", "TXT_003", "TXT_004", "TXT_005"}
    regions = {(r.file_id, r.page_number): (r.members, r.kinds) for r in pdf_catalog.pdf_regions(spark, "").collect()}
    assert regions["image-and-text.pdf", 1] == (2, 2) and regions["flatten-units-a.pdf", 1] == (3, 3) and ("repeated-text.pdf", 1) not in regions
    assert {(r.file_id, r.kind) for r in pdf_catalog.pdf_rejects(spark, "").collect()} == {("broken.pdf", "PdfCorrupted"), ("empty.pdf", "NotAPdf")}
    cleaned = pdf_catalog.pdf_clean_roundtrip(spark, "").collect()
    assert len(cleaned) >= 7 and all(r.left_over == 0 and r.error is None for r in cleaned)


def test_clean_files_isolates_failures(spark):
    files = spark.createDataFrame([("a", bytearray(FILES["repeated-text.pdf"])), ("b", bytearray(b"%PDF-1.4 " + b"?" * 80))], "file_id string, content binary")
    selected = spark.createDataFrame([("a", 1, "CONFIDENTIAL"), ("b", 1, "x")], "file_id string, kind int, identity string")
    got = {r.file_id: r for r in clean_files(files, selected).collect()}
    assert got["a"].content and got["a"].error is None and got["b"].content is None and "PdfError" in got["b"].error


def test_streaming_ingest(spark, tmp_path):
    from docobjects.streaming.ingest import current_groups, start_ingest

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.pdf").write_bytes(FILES["repeated-logo.pdf"])
    kept, progress = str(tmp_path / "groups"), str(tmp_path / "progress")
    for name, source in (("a", None), ("b", "one-image.pdf")):  # the second run goes on from where the first one stopped
        if source:
            (inbox / f"{name}.pdf").write_bytes(FILES[source])
        query = start_ingest(spark, str(inbox), kept, progress)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    (row,) = current_groups(spark, kept).where("kind = 0").collect()
    assert (row.usage_count, row.files, row.is_safe) == (6, 2, True)
    assert len(list((tmp_path / "groups").glob("batch=*"))) == 2


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    from docobjects.streaming.ingest import CHANGES, current_groups

    kept = str(tmp_path / "groups")
    for batch, rows in ((0, [(0, "a", 2, 1, True), (1, "b", 1, 1, True)]), (1, [(0, "a", 5, 2, False)]), (1, [(0, "a", 5, 2, False)])):
        spark.createDataFrame([(*r, batch) for r in rows], CHANGES).drop("batch").write.mode("overwrite").parquet(f"{kept}/batch={batch}")
    assert sorted(map(tuple, current_groups(spark, kept).collect())) == [(0, "a", 5, 2, False), (1, "b", 1, 1, True)]


def test_corpus_of_nothing(spark):
    corpus = PdfCorpus(spark.createDataFrame([], "file_id string, content binary"))
    assert corpus.placements.collect() == [] and corpus.rejects.collect() == []


def test_streams_decode():
    assert Stream({"Filter": [Name("ASCIIHexDecode"), Name("FlateDecode")]}, zlib.compress(b"abc").hex().encode() + b">").data() == b"abc"
    with pytest.raises(PdfError):
        Stream({"Filter": Name("JPXDecode")}, b"").data()
