"""Operators on small tables with known answers, and against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docobjects import lineage
from docobjects.functions import geometry as G
from docobjects.functions import text as X
from docobjects.operators import grouping as A
from docobjects.operators import overlap as O
from docobjects.operators import selection as S
from docobjects.plans import catalog
from docobjects.sources import adapters

PLACED = "file_id long, page_number int, obj long, seq long, kind int, identity string, x double, y double, w double, h double, hides boolean"
PAGE = ["page_number"]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def placed(spark, objects, page_number=1):
    rows = [(1, page_number, i, i, *o) for i, o in enumerate(objects, start=1)]
    return spark.createDataFrame(rows, PLACED)


def image(x, y, w, h):
    return 0, "img", float(x), float(y), float(w), float(h), True


def text(x, y, w=40, h=12, value="txt"):
    return 1, value, float(x), float(y), float(w), float(h), True


def shape(x, y, w, h, hides=True):
    return 2, "shp", float(x), float(y), float(w), float(h), hides


def regions_of(spark, objects):
    df = placed(spark, objects)
    members = O.region_members(O.overlap_edges(df, PAGE, F.lit(800), F.lit(600)), PAGE)
    return O.regions(df, members, PAGE, F.lit(800), F.lit(600)).collect()


@pytest.mark.parametrize(
    "objects, want",
    [
        ([image(100, 100, 200, 200), text(150, 150)], [(2, 100, 100, 300, 300)]),
        ([image(100, 100, 100, 100), text(200, 150)], []),
        ([image(100, 100, 100, 100), text(199, 150, 41)], [(2, 100, 100, 240, 200)]),
        ([text(0, 0), text(10, 5)], []),
        ([shape(0, 0, 50, 50), shape(20, 20, 50, 50)], []),
        ([text(100, 100), shape(130, 90, 100, 30), image(220, 80, 60, 60)], [(3, 100, 80, 280, 140)]),
        ([shape(10, 10, 780, 580, False), text(100, 100)], []),
        ([shape(0, 0, 800, 600), text(100, 100), image(90, 90, 60, 40)], [(2, 90, 90, 150, 130)]),
        ([image(0, 0, 800, 600), text(100, 100)], [(2, 0, 0, 800, 600)]),
        ([shape(100, 100, 100, 100, False), text(190, 150)], []),
        ([shape(100, 100, 100, 100, False), text(110, 110)], []),
        ([image(100, 100, 100, 100), shape(110, 110, 20, 20, False)], [(2, 100, 100, 200, 200)]),
        ([shape(110, 110, 20, 20, False), image(100, 100, 100, 100)], [(2, 100, 100, 200, 200)]),
    ],
)
def test_overlap_regions(spark, objects, want):
    got = regions_of(spark, objects)
    assert sorted((r.members, r.left, r.bottom, r.right, r.top) for r in got) == want


def test_overlap_matches_plain_python(spark):
    rng = random.Random(3)
    objects = []
    for _ in range(70):
        kind = rng.randrange(3)
        hides = kind != 2 or rng.random() < 0.5
        objects.append((kind, "o", float(rng.randrange(400)), float(rng.randrange(300)), float(rng.randrange(90)), float(rng.randrange(60)), hides))
    boxes = []
    for _, _, x, y, w, h, _ in objects:
        gx, gy = max(1 - w, 0) / 2, max(1 - h, 0) / 2
        boxes.append((x - gx, y - gy, x + w + gx, y + h + gy))
    inside = lambda p, q: p[0] >= q[0] and p[1] >= q[1] and p[2] <= q[2] and p[3] <= q[3]
    want = set()
    for i, j in itertools.combinations(range(len(objects)), 2):
        p, q = boxes[i], boxes[j]
        if not objects[i][6]:
            hit = inside(p, q)
        elif not objects[j][6]:
            hit = inside(q, p)
        else:
            hit = p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3]
        if hit:
            want.add((i + 1, j + 1))
    df = placed(spark, objects)
    edges = O.overlap_edges(df.repartition(3), PAGE, F.lit(800), F.lit(600))
    assert {(r.a, r.b) for r in edges.collect()} == want
    gridded = O.overlap_edges(df, PAGE, F.lit(800), F.lit(600), cell=37.5).collect()
    assert {(r.a, r.b) for r in gridded} == want and len(gridded) == len(want)
    root = list(range(len(objects) + 1))
    changed = True
    while changed:
        changed = False
        for a, b in want:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    touched = {x for e in want for x in e}
    assert {(r.obj, r.region) for r in O.region_members(edges, PAGE).collect()} == {(i, root[i]) for i in touched}


def test_reading_order(spark):
    # Tops 540, 535 and 528 are one line (each within 8 of the one before); 500 begins another.
    rows = [(1, "a", 300.0, 540.0), (1, "b", 50.0, 535.0), (1, "c", 150.0, 528.0), (1, "d", 10.0, 500.0)]
    df = spark.createDataFrame(rows, "page_number int, identity string, x double, top double")
    got = {r.identity: (r.line_no, r.position) for r in O.reading_order(df, PAGE, "top", "x", ["identity"]).collect()}
    assert got == {"b": (0, 1), "c": (0, 2), "a": (0, 3), "d": (1, 4)}


def test_groups_and_numbers(spark):
    rows = [(1, p, 1, "A") for p in (3, 1, 2, 2)] + [(1, 1, 1, "B"), (2, 5, 1, "B"), (2, 5, 0, "C")]
    df = spark.createDataFrame([(f, p, i, k, v, 0.0, 0.0) for i, (f, p, k, v) in enumerate(rows)], "file_id long, page_number int, seq long, kind int, identity string, x double, y double")
    groups = A.number_within_file(A.object_groups(df))
    got = {(r.file_id, r.identity): (r.object_id, r.usage_count, r.pages) for r in groups.collect()}
    assert got == {(1, "A"): ("TXT_001", 4, [1, 2, 3]), (1, "B"): ("TXT_002", 1, [1]), (2, "B"): ("TXT_001", 1, [5]), (2, "C"): ("IMG_001", 1, [5])}
    merged = A.merge_files(A.object_groups(df), ["kind", "identity"], "file_id")
    got = {r.identity: (r.object_id, r.usage_count, r.file_count) for r in A.number_corpus(merged, "identity").collect()}
    assert got == {"A": ("TXT_001", 4, 1), "B": ("TXT_002", 2, 2), "C": ("IMG_001", 1, 1)}


def test_corpus_numbers_are_gapless(spark):
    df = spark.range(2500).select((F.col("id") % 3).cast("int").alias("kind"), (F.col("id") % 7).alias("usage_count"), F.col("id").cast("string").alias("hash"))
    got = A.number_corpus(df).collect()
    for kind in range(3):
        own = sorted((r for r in got if r.kind == kind), key=lambda r: (-r.usage_count, r.hash))
        assert [r.number for r in own] == list(range(1, len(own) + 1))
    assert {len(r.object_id) for r in got} == {7}


def test_unsafe_groups_keep_the_first_reason(spark):
    rows = [(1, 1, i, 0, "A", 0.0, 0.0, s, r) for i, (s, r) in enumerate([(True, None), (False, "second"), (False, "third")])]
    df = spark.createDataFrame(rows, "file_id long, page_number int, seq long, kind int, identity string, x double, y double, is_safe boolean, unsafe_reason string")
    (row,) = A.object_groups(df).collect()
    assert (row.is_safe, row.unsafe_reason) == (False, "second")


def test_repeated_texts(spark):
    rows = [(1, p, v) for p, v in [(1, "S"), (2, "S"), (1, "  "), (2, "  "), (3, "X"), (1, "　"), (2, "　")]]
    df = spark.createDataFrame(rows, "doc_id long, page_number long, value string")
    assert [(r.value, r.usage_count) for r in A.repeated_texts(df).collect()] == [("S", 2)]


@pytest.mark.parametrize("pages, want", [([1, 2, 3, 5, 7, 8, 9], "1〜3, 5, 7〜9"), ([2, 1], "1, 2"), ([4, 4, 4], "4"), ([10, 9, 2, 11], "2, 9〜11")])
def test_page_runs(spark, pages, want):
    df = spark.createDataFrame([(1, p) for p in pages], "g int, page_number int")
    assert A.page_runs(df, ["g"]).first().page_ranges == want


def test_visible_window():
    assert A.visible_window(25, 20) == (15, 55) and A.visible_window(3, 20) == (0, 33)


@pytest.mark.parametrize("n, want", [(-5, "0 B"), (0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (12288, "12 KB"), (2621440, "2.5 MB"), (3 << 30, "3 GB")])
def test_byte_size(spark, n, want):
    assert one(spark, X.byte_size(F.lit(n).cast("long"))) == (want,)


@pytest.mark.parametrize("name, want", [("a.pdf", "a_cleaned.pdf"), ("a_cleaned.PDF", "a_cleaned(2).PDF"), ("a_cleaned(2).pdf", "a_cleaned(3).pdf"), ("a_cleaned(0).pdf", "a_cleaned(0)_cleaned.pdf"), ("b", "b_cleaned")])
def test_cleaned_name(spark, name, want):
    assert one(spark, X.cleaned_name(F.lit(name))) == (want,)


def test_labels(spark):
    assert one(spark, X.filter_label(F.lit("/FlateDecode+/DCTDecode")), X.filter_label(F.lit(None)), X.filter_label(F.lit("/Odd"))) == ("Flate+JPEG", "Raw", "Odd")
    assert one(spark, X.thumbnail_text(F.lit(" \t")), X.object_label(F.lit("x" * 41)), X.utf16_hex(F.lit("0410")), X.utf16_hex(F.lit("410")), X.utf16_hex(F.lit("41"))) == ('" \t"', "x" * 40 + "…", "А", "А", "A")
    assert one(spark, X.warning_label(F.lit(False), F.lit(True)), X.warning_label(F.lit(True), F.lit(True)), X.warning_label(F.lit(True), F.lit(False))) == ("unsafe", "full page", "")
    assert one(spark, X.progress(F.lit(3), F.lit(4)), X.progress(F.lit(9), F.lit(4)), X.progress(F.lit(1), F.lit(0))) == (0.75, 1.0, None)
    assert one(spark, X.content_hash(F.lit("abc"))) == ("BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD",)
    assert one(spark, X.error_kind(F.lit("PdfError"), F.lit("encrypted")), X.error_kind(F.lit("PdfError"), F.lit(None)), X.error_kind(F.lit("Odd"), F.lit(""))) == ("PdfEncrypted", "PdfCorrupted", "Unexpected")


def test_page_geometry(spark):
    full = lambda w, h, pw=100, ph=200: G.covers_page(F.lit(float(w)), F.lit(float(h)), F.lit(pw), F.lit(ph))
    assert one(spark, full(90, 180), full(89, 180), full(90, 10), full(90, 180, 0, 0), full(90, 180, None, None)) == (True, False, False, False, False)
    size = lambda w, h, dpi: G.page_ceilings(F.lit(float(w)), F.lit(float(h)), F.lit(dpi))
    assert one(spark, *size(595.28, 841.89, 300)) == (2480, 3508)
    assert one(spark, *size(841.89, 595.28, 200)) == (2339, 1654)
    assert one(spark, *size(595.28, 841.89, 92)) == (761, 1076) == one(spark, *size(0, 0, 92))
    assert one(spark, *[G.rotation(F.lit(d)) for d in (-90, 450, 45, 360)]) == (270, 90, 0, 0)
    assert one(spark, *G.display_size(F.lit(10), F.lit(20), F.lit(90))) == (20, 10)
    rect = lambda d: one(spark, *G.display_rect(*[F.lit(v) for v in (1, 2, 3, 4, 10, 20)], F.lit(d)).values())
    assert [rect(d) for d in (0, 90, 180, 270)] == [(1, 14, 3, 4), (2, 1, 4, 3), (6, 2, 3, 4), (14, 6, 4, 3)]
    assert one(spark, G.flatten_dpi(F.lit(True), F.lit(300)), G.flatten_dpi(F.lit(True), F.lit(92)), G.flatten_dpi(F.lit(False), F.lit(300))) == (300, 200, 200)


def test_matrices_and_colours(spark):
    m = [F.lit(float(v)) for v in (2, 0, 0, 3, 10, 20)]
    box = G.mapped_box(m, *[F.lit(float(v)) for v in (1, 1, 4, 5)])
    assert one(spark, *box.values()) == (12.0, 23.0, 20.0, 38.0)
    n = [F.lit(float(v)) for v in (0, 1, -1, 0, 5, 6)]
    assert one(spark, *G.multiply(m, n)) == (0.0, 2.0, -3.0, 0.0, -15.0, 16.0)
    assert one(spark, G.colour_byte(F.lit(0.5)), G.colour_byte(F.lit(2.0)), G.colour_byte(F.lit(-1.0))) == (127, 255, 0)
    parts = lambda *c: F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("rgb", p)]) for p in c])
    assert one(spark, G.needs_dark_background(parts((255, 255, 255))), G.needs_dark_background(parts((255, 255, 255), (0, 0, 0)))) == (True, False)


def test_selection(spark):
    groups = spark.createDataFrame([("a", True), ("b", True), ("b", False)], "identity string, is_safe boolean")
    checked = S.check_selection(spark.createDataFrame([("a",), ("b",), ("c",)], "identity string"), groups, "identity")
    assert {tuple(r) for r in checked.collect()} == {("a", "accepted"), ("b", "unsafe"), ("c", "unknown")}
    with pytest.raises(S.SelectionError):
        S.require_accepted(checked)
    S.require_accepted(checked.where("identity = 'a'"))


def test_pruning(spark):
    doomed = spark.createDataFrame([(1,), (2,)], "object_id long")
    refs = spark.createDataFrame([(9, 2), (1, 11), (2, 12), (8, 13)], "from_object long, to_object long")
    masks = spark.createDataFrame([(1, 11), (1, 13), (2, 12)], "image_id long, mask_id long")
    gone, orphans = S.prunable(doomed, refs, masks)
    assert [r.object_id for r in gone.collect()] == [1] and [r.object_id for r in orphans.collect()] == [11]


def test_pruning_takes_more_tasks_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS_A_TASK", 100)
    doomed = spark.range(300).select(F.col("id").alias("object_id"))
    refs = spark.range(900).selectExpr("id + 250 as from_object", "case when id % 3 = 0 then id + 1000 when id % 3 = 1 then id % 200 end as to_object")
    masks = spark.range(300).selectExpr("id as image_id", "id + 1100 as mask_id")
    gone, orphans = S.prunable(doomed, refs, masks)
    told = [(r.from_object, r.to_object) for r in refs.collect()]
    want = set(range(300)) - {t for _, t in told}
    kept = {t for f, t in told if f not in want}
    assert {r.object_id for r in gone.collect()} == want
    assert {r.object_id for r in orphans.collect()} == {i + 1100 for i in want} - kept
    assert "hashpartitioning(to_object" in (plan := gone._jdf.queryExecution().toString()) and "REPARTITION_BY_NUM" in plan


def test_placements_are_dealt_to_as_many_tasks_as_there_are_rows_for(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS_A_TASK", 1000)
    dealt = adapters.placements(spark, "/root/testdata/sf0.001", ["file_id", "identity"])
    assert dealt.rdd.getNumPartitions() == 6
    assert A.page_runs(dealt, ["file_id", "identity"]).rdd.getNumPartitions() == 6
    grouped = catalog._groups(spark, "/root/testdata/sf0.001")
    assert grouped.rdd.getNumPartitions() == 6


def test_group_facts_equal_the_operators_side_by_side(spark):
    by = ["file_id", "kind", "identity"]
    p = spark.range(400).selectExpr("id % 3 as file_id", "cast(id % 2 as int) as kind", "id % 7 as identity", "id as seq", "id % 5 as w", "id % 11 as h", "id % 6 <> 1 as is_safe", "id % 13 = 0 as full_page", "id * 7 % 40 as n_bytes", "0d as x", "0d as y", "id % 4 as page_number")
    pictures = spark.range(0, 11, 3).selectExpr("id as hash", "concat('t', id) as thumbnail")
    sizes = A.estimated_sizes(p.groupBy(*by, "w").agg(F.max("n_bytes").alias("n_bytes")), p, by, ["w"]).select(*by, "estimated_bytes")
    side = A.object_groups(p).select(*by, "usage_count", "is_safe").join(p.groupBy(*by).agg(F.bool_or("full_page").alias("full_page")), by).join(sizes, by).join(A.first_thumbnails(p, pictures, by, "h"), by)
    assert sorted(map(tuple, A.group_facts(p, pictures, by, ["w"], "h").collect()), key=str) == sorted(map(tuple, side.collect()), key=str)


def test_units(spark):
    members = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 1, 4), (2, 0, 1), (2, 1, 2)], "page_number int, unit long, obj long")
    checked = spark.createDataFrame([(1, 1), (1, 3), (2, 1)], "page_number int, obj long")
    as_sets = lambda df: {frozenset(o for q, u, o in rows if (q, u) == k) | {f"page {k[0]}"} for rows in [[(r.page_number, r.unit, r.obj) for r in df.collect()]] for k in {(q, u) for q, u, _ in rows}}
    assert as_sets(S.merge_units(members, checked, PAGE)) == {frozenset({1, 3, "page 1"}), frozenset({2, "page 1"}), frozenset({4, "page 1"}), frozenset({1, "page 2"}), frozenset({2, "page 2"})}
    checked = spark.createDataFrame([(1, 1), (2, 1)], "page_number int, obj long")
    assert as_sets(S.split_unit(members, checked, PAGE)) == {frozenset({1, "page 1"}), frozenset({2, "page 1"}), frozenset({3, 4, "page 1"}), frozenset({1, "page 2"}), frozenset({2, "page 2"})}


def test_absorb_earlier_places(spark):
    places = spark.createDataFrame([(1, 7, 10.0, 10.0, 50.0, 50.0)], "page_number int, place long, x double, y double, w double, h double")
    rows = spark.createDataFrame([(1, 8, 10.05, 10.0, 50.0, 50.0, 100), (1, 8, 300.0, 300.0, 5.0, 5.0, 101)], "page_number int, place long, x double, y double, w double, h double, obj long")
    pictures = spark.createDataFrame([(1, 7, 1), (1, 7, 2)], "page_number int, place long, obj long")
    assert sorted(tuple(r) for r in S.absorb_places(places, rows, pictures, PAGE).collect()) == [(1, 8, 1), (1, 8, 2), (1, 8, 101)]


def test_insertion_points(spark):
    def at(names, target):
        rows = [(1, i, n, target) for i, n in enumerate(names)]
        return S.insertion_points(spark.createDataFrame(rows, "page_number int, idx int, op string, target int"), PAGE).first().insert_at

    assert at(["q", "cm", "Do", "Q", "q", "Do", "Q"], 5) == 4
    assert at(["cm", "Do"], 1) == -1 and at(["Do", "q", "Do"], 2) == 1 and at(["q", "Do"], 1) == 0


def test_verification(spark):
    names = spark.createDataFrame([("f", "a"), ("f", "b")], "file_id string, identity string")
    removed, retained = names.where("identity = 'x'"), spark.createDataFrame([("f", "a"), ("f", "z")], "file_id string, identity string")
    assert S.verification(names, removed, retained, "file_id", "identity").first().passed
    assert not S.verification(names, removed, retained, "file_id", "identity", strict=True).first().passed
    assert not S.verification(names, names.where("identity = 'b'"), retained, "file_id", "identity").first().passed


def test_bands_lose_no_match(spark):
    rng = random.Random(8)
    value = lambda: None if rng.random() < 0.05 else rng.choice([0.0, -0.1, 0.2, 5.0]) + rng.choice([0.0, 0.05, 0.0999999, 0.1, -0.07])
    rows = [(rng.choice([1, 2, None]), i, value(), value(), 3.0, 4.0, "extra") for i in range(120)]
    df = spark.createDataFrame(rows, "page_number int, obj long, x double, y double, w double, h double, _place string")
    near = lambda a, b: all(p is not None and q is not None and abs(p - q) < 0.1 for p, q in zip(a[2:6], b[2:6], strict=True))
    drawn = df.where("obj % 3 = 0").withColumnRenamed("obj", "place")
    got = sorted((r.obj, r.page_number, r.place) for r in S.flatten_behind(df, drawn, PAGE, "obj", "place").collect())
    want = [(b[1], b[0], min((a[1] for a in rows if a[1] % 3 == 0 and a[0] is not None and a[0] == b[0] and near(a, b)), default=None)) for b in rows]
    assert got == sorted(want)
    assert S.flatten_behind(df.limit(0), drawn, PAGE, "obj", "place").collect() == []
    assert {r.place for r in S.flatten_behind(df, drawn.limit(0), PAGE, "obj", "place").collect()} == {None}


def test_boxes_of_a_page(spark):
    rows = [(1, 1, float(i % 7), None if i % 5 == 0 else 1.0, 2.0, 3.0) for i in range(70)] + [(1, None, 1.0, 1.0, 1.0, 1.0)] * 3 + [(2, 1, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "file_id long, page_number int, x double, y double, w double, h double").withColumn("times", F.lit(9)).withColumn("piece", F.lit(1))
    by = ["file_id", "page_number"]
    for a_row in (1000, 4):
        got = A.usage_boxes(df, by, a_row).collect()
        boxes = sorted(((r.file_id, r.page_number, *b) for r in got for b in r.boxes), key=str)
        assert boxes == sorted(((*k, rows.count(k)) for k in set(rows)), key=str)
        assert sum(r.shown for r in got) == len(rows)
        assert all(r.pieces == (4 if a_row == 4 and (r.file_id, r.page_number) == (1, 1) else 1) and 0 <= r.piece < r.pieces for r in got)
    assert A.usage_boxes(df.limit(0), by).collect() == []
