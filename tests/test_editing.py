"""Places, ranges, transformations, components, names, assertions and published files against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docobjects import lineage
from docobjects.functions import jpeg
from docobjects.operators import assertions, naming, places, ranges, transforms
from docobjects.operators.components import keyed_components
from docobjects.plans import editing
from docobjects.sources import publish, published


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- components ----


def plain_components(edges):
    near = {}
    for k, a, b in edges:
        if a is not None and b is not None:
            near.setdefault((k, a), set()).add((k, b))
            near.setdefault((k, b), set()).add((k, a))
    out = set()
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            for w in near[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        out.add((v[0], v[1], min(w[1] for w in seen)))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowded", [10**9, 30, 0])
def test_components_of_quiet_and_crowded_keys(spark, crowded):
    rng = random.Random(1)
    edges = [(f"p{k}", rng.randrange(40), rng.randrange(40)) for k in range(12) for _ in range(rng.choice([1, 5, 25, 60]))]
    edges += [("chain", i, i + 1) for i in range(70)] + [(None, 1, 2), (None, 2, 5), ("", 7, 7), ("", None, 3), ("", 3, None)] + edges[:9]
    df = spark.createDataFrame([(*e, 1, 2) for e in edges], "page string, a long, b long, obj int, component int").repartition(5)
    assert rows(keyed_components(df, ["page"], crowded)) == plain_components(edges)
    assert keyed_components(df.limit(0), ["page"], crowded).count() == 0


def test_components_with_two_keys_and_batches(spark, monkeypatch):
    from docobjects.operators import components

    monkeypatch.setattr(components, "AT_ONCE", 3)
    edges = [(f, p, i, i + 1) for f in range(3) for p in range(4) for i in range(0, 12, 2)]
    df = spark.createDataFrame(edges, "f long, p int, a long, b long").coalesce(1)
    assert rows(keyed_components(df, ["f", "p"])) == sorted(((f, p, v, v - v % 2) for f, p, a, b in edges for v in (a, b)), key=str)


# ---- places ----


def plain_absorb(made, members):
    """Places of one page, one after another, as a list that each new place takes its absorbed ones from."""
    applied = []
    for place, *box in sorted(made):
        own, gone = set(), []
        for _, obj, kind, *at in [m for m in members if m[0] == place]:
            hit = [a for a in applied if kind == 0 and None not in at and None not in a[1] and all(abs(p - q) < 0.1 for p, q in zip(at, a[1]))]
            if hit:
                gone += hit
            else:
                own.add(obj)
        for a in gone:
            own |= a[2]
            if a in applied:
                applied.remove(a)
        applied.append((place, box, own))
    return sorted(a[0] for a in applied), sorted((a[0], o) for a in applied for o in a[2])


PLACES = "page string, place long, x double, y double, w double, h double"
MEMBERS = "page string, place long, obj long, kind int, x double, y double, w double, h double"


def absorb_case(seed):
    rng = random.Random(seed)
    made = [(k, 16.0 * (k % 5), 15.97 + 16 * (k % 3), 10.0, 5.0) for k in range(1, 30)]
    members = []
    for k, *_ in made:
        members += [(k, 100 * k + j, rng.randrange(3), 500.0 + j, 3.0, 1.0, 1.0) for j in range(rng.randrange(3))]
        for j in range(rng.randrange(3)):
            e = rng.choice(made)
            members.append((k, 100 * k + 50 + j, rng.choice([0, 0, 0, 2]), e[1] + rng.choice([-0.05, 0.0, 0.06, 0.2]), e[2] + 0.05, e[3], e[4]))
    return made, members


@pytest.mark.parametrize("seed", range(3))
def test_absorption_is_carried_to_its_end(spark, seed):
    want_places, want_members, made, members = [], [], [], []
    for page in ("p", "q", "r"):
        m, o = absorb_case(f"{seed}{page}")
        p, q = plain_absorb(m, o)
        want_places += [(page, x) for x in p]
        want_members += [(page, *x) for x in q]
        made += [(page, *x) for x in m]
        members += [(page, *x) for x in o]
    left, held = places.absorb_all(spark.createDataFrame(made + made[:3], PLACES), spark.createDataFrame(members + members[:3], MEMBERS), ["page"])
    assert rows(left.select("page", "place")) == sorted(want_places, key=str)
    assert rows(held) == sorted(want_members, key=str)
    assert len(want_places) < len(made)


def test_a_chain_of_places_ends_in_the_last(spark):
    made = [("p", k, float(k), 0.0, 9.0, 9.0) for k in range(40)]
    members = [("p", k, 1000 + k, 1, 0.0, 0.0, 1.0, 1.0) for k in range(40)] + [("p", k, k, 0, k - 1.0, 0.0, 9.0, 9.0) for k in range(1, 40)]
    left, held = places.absorb_all(spark.createDataFrame(made, PLACES), spark.createDataFrame(members, MEMBERS), ["page"])
    assert rows(left.select("place")) == [(39,)]
    assert rows(held.select("place", "obj")) == sorted(((39, 1000 + k) for k in range(40)), key=str)


def test_volumes_are_published_by_more_tasks_as_documents_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(editing, "DOCUMENTS_A_TASK", 20)
    monkeypatch.setattr(editing, "scratch", lambda spark, name: str(tmp_path / name))
    assert editing.published_manifest(spark, "/root/testdata/sf0.001").count() > 0
    assert len(list(tmp_path.glob("published/batch-*/manifest/*.parquet"))) == 10


def test_more_edges_take_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS_A_TASK", 50)
    edges = spark.range(400).selectExpr("id % 20 as page", "id as a", "id + 20 as b")
    found = keyed_components(edges, ["page"])
    assert found.rdd.getNumPartitions() == 8
    assert {(r.page, r.obj, r.component) for r in found.collect()} == {(i % 20, i, i % 20) for i in range(420)}


def test_placements_of_loose_units_are_numbered_once(spark):
    plan = editing.QUERIES["loose_units"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1  # that of the units; the placements are read as they were written down


def test_deep_chains_take_no_more_jobs_than_short_ones(spark):
    def jobs(depth):
        group = f"chain of {depth}"
        spark.sparkContext.setJobGroup(group, group)
        parents = spark.range(depth).selectExpr("'p' as page", "id as child", "id + 1 as parent")
        got = {(r.child, r.root) for r in places.roots(parents, ["page"]).collect()}
        assert got == {(i, depth) for i in range(depth)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        assert jobs(200) == jobs(3)
    finally:
        spark.sparkContext.setJobGroup("others", "others")


def test_places_left_need_no_ends_of_chains(spark):
    made = spark.createDataFrame([("p", 1, 5.0, 5.0, 1.0, 1.0), ("p", 1, 5.0, 5.0, 1.0, 1.0), ("p", 2, 0.0, 0.0, 1.0, 1.0)] * 2, PLACES)
    parents = spark.createDataFrame([("p", 1, 2)], "page string, child long, parent long")
    assert rows(places.places_left(made, parents, ["page"]).select("place")) == [(2,)]


def test_absorption_with_nulls_and_nothing(spark):
    made = [("p", 1, None, 0.0, 1.0, 1.0), ("p", 2, 5.0, 5.0, 1.0, 1.0)]
    members = [("p", 2, 7, 0, None, 0.0, 1.0, 1.0), ("p", 2, 8, None, 5.0, 5.0, 1.0, 1.0), ("p", 3, 9, 0, 5.0, 5.0, 1.0, 1.0)]
    a, b = spark.createDataFrame(made, PLACES), spark.createDataFrame(members, MEMBERS)
    left, held = places.absorb_all(a, b, ["page"])
    assert rows(left.select("place")) == [(1,)] and rows(held.select("place", "obj")) == [(3, 7), (3, 8)]
    left, held = places.absorb_all(a.limit(0), b.limit(0), ["page"])
    assert left.count() == held.count() == 0


def test_a_cycle_is_an_error(spark):
    with pytest.raises(Exception, match="cannot absorb a later one"):
        places.roots(spark.createDataFrame([("p", 1, 2), ("p", 2, 1)], "page string, child long, parent long"), ["page"]).collect()


def test_the_place_behind_an_occurrence(spark):
    made = spark.createDataFrame([("p", 4, 1.0, 1.0, 5.0, 5.0), ("p", 3, 1.05, 1.0, 5.0, 5.0), ("q", 1, 1.0, 1.0, 5.0, 5.0)], PLACES)
    shown = spark.createDataFrame([("p", 10, 1.02, 0.95, 5.0, 5.0), ("p", 11, 2.0, 1.0, 5.0, 5.0), (None, 12, 1.0, 1.0, 5.0, 5.0)], "page string, id long, x double, y double, w double, h double")
    assert rows(places.place_behind(shown, made, ["page"], "id")) == [("p", 10, 3)]


LOG = "page string, version long, place long, action string"


def plan_log():
    rng = random.Random(4)
    log = [(rng.choice("pqr"), v, rng.randrange(4), rng.choice(["add", "add", "undo", "hide", "show"])) for v in range(120)]
    return log + log[:5] + [("p", None, 1, "add"), ("p", 200, None, "add"), ("p", 201, 1, "other"), ("p", 7, 9, None)]


def plain_plan(log):
    """What is live on each page after each of its versions."""
    out = {}
    for page in {r[0] for r in log}:
        live = set()
        for v in sorted({r[1] for r in log if r[0] == page and r[1] is not None}):
            for layer, on, off in (("flat", "add", "undo"), ("hidden", "hide", "show")):
                for place in {r[2] for r in log if r[:2] == (page, v) and r[2] is not None}:
                    did = {r[3] for r in log if r[:3] == (page, v, place)} & {on, off}
                    if off in did:
                        live.discard((place, layer))
                    elif on in did:
                        live.add((place, layer))
            out[page, v] = set(live)
    return out


def test_any_version_of_a_plan_is_rebuilt(spark):
    log = plan_log()
    df = spark.createDataFrame([(*r, 1, 2) for r in log], LOG + ", since int, until int")
    want = plain_plan(log)
    intervals = places.live_intervals(df, ["page"])
    asked = spark.createDataFrame([(p, v) for p, v in want], "page string, version long")
    assert rows(places.as_of(intervals, asked, ["page"])) == sorted(((p, v, *x) for (p, v), live in want.items() for x in live), key=str)
    keys = {(r.page, r.version): r for r in places.copy_keys(df, ["page"]).collect()}
    assert {k: (r.places, r.hidden) for k, r in keys.items()} == {k: (sum(x[1] == "flat" for x in v), sum(x[1] == "hidden" for x in v)) for k, v in want.items()}
    for name, part in (("working_key", lambda v: frozenset(x for x in v if x[1] == "flat")), ("preview_key", frozenset)):
        by_plan = {}
        for k, live in want.items():
            by_plan.setdefault(part(live), set()).add(keys[k][name])
        assert all(len(x) == 1 for x in by_plan.values()) and len(set().union(*by_plan.values())) == len(by_plan)
    assert places.live_intervals(df.limit(0), ["page"]).count() == places.copy_keys(df.limit(0), ["page"]).count() == 0


# ---- ranges ----


@pytest.mark.parametrize("stretch", [1, 7, 4096])
def test_rows_inside_ranges(spark, stretch):
    rng = random.Random(2)
    ops = [(rng.choice("pq"), rng.randrange(-30, 300)) for _ in range(400)] + [(None, 5), ("p", None)]
    spans = [(rng.choice("pq"), a := rng.randrange(-40, 290), a + rng.choice([-3, 0, 1, 5, 60])) for _ in range(14)] + [("p", 3, None), (None, 0, 99), ("r", 0, 9)]
    spans += spans[:3]
    df = spark.createDataFrame([(*r, i, 1) for i, r in enumerate(ops)], "page string, idx long, n long, first int").repartition(3)
    got = ranges.mark_inside(df, spark.createDataFrame(spans, "page string, first long, last long"), ["page"], stretch=stretch)
    inside = lambda p, i: p is not None and i is not None and any(q == p and b is not None and a <= i <= b for q, a, b in spans)
    assert rows(got) == sorted(((p, i, k, 1, inside(p, i)) for k, (p, i) in enumerate(ops)), key=str)


def test_semi_and_anti_range_joins(spark):
    df = spark.createDataFrame([("p", i) for i in range(10)], "page string, idx long")
    spans = spark.createDataFrame([("p", 2, 4), ("p", 3, 6)], "page string, first long, last long")
    assert [r.idx for r in ranges.inside_ranges(df, spans, ["page"]).sort("idx").collect()] == [2, 3, 4, 5, 6]
    assert [r.idx for r in ranges.outside_ranges(df, spans, ["page"]).sort("idx").collect()] == [0, 1, 7, 8, 9]
    assert ranges.outside_ranges(df, spans.limit(0), ["page"]).count() == 10
    assert ranges.inside_ranges(df.limit(0), spans, ["page"]).count() == 0


def test_members_and_others_of_regions(spark):
    instances = [("p", 1, 0, "a", 0.0, 0.0, 10.0, 10.0), ("p", 2, 0, "a", 50.0, 0.0, 10.0, 10.0), ("p", 3, 1, "b", 5.0, 5.0, 2.0, 2.0), ("p", 4, 1, "a", 5.0, 5.0, 2.0, 2.0), ("q", 1, 0, "a", 0.0, 0.0, 10.0, 10.0), ("p", 5, 0, "a", 20.0, 0.0, 10.0, 10.0), ("p", 6, None, "a", 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(instances, "page string, obj long, kind int, identity string, x double, y double, w double, h double")
    regions = spark.createDataFrame([("p", 1, 0.0, 0.0, 20.0, 20.0), ("p", 2, 5.0, 5.0, 30.0, 30.0)], "page string, region long, left double, bottom double, right double, top double")
    wanted = spark.createDataFrame([("p", 1, 0, "a"), ("p", 1, 1, "b"), ("p", 2, 0, "a"), ("p", 1, 0, "a")], "page string, region long, kind int, identity string")
    got = ranges.region_instances(df, regions, wanted, ["page"])
    assert [r.obj for r in got.where("member").sort("obj").collect()] == [1, 3, 5] and got.count() == 7


# ---- transformations ----


def plain_stack(ops):
    out, current, saved = [], np.eye(3), []
    for op, m in ops:
        if op == "q":
            saved.append(current)
        elif op == "Q" and saved:
            current = saved.pop()
        elif op == "cm" and m is not None and None not in m:
            current = np.array([[m[0], m[1], 0], [m[2], m[3], 0], [m[4], m[5], 1]], float) @ current
        out.append((current[:, :2].ravel().tolist(), len(saved)))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_matrices_in_force_equal_a_walk(spark, partitions, monkeypatch):
    rng = random.Random(partitions)
    monkeypatch.setattr(transforms, "width", lambda _: partitions)
    pages = {p: [(rng.choice(["q", "Q", "Q", "cm", "Do"]) if p == "down" else rng.choice(["q", "Q", "cm", "cm", "re"]), None) for _ in range(n)] for p, n in (("one", 1), ("down", 60), ("long", 400), (None, 30))}
    pages = {p: [(op, [rng.choice([1.0, 0.5, -1.0, 2.0, 0.0]) for _ in range(5)] + [rng.choice([3.0, None])] if op == "cm" else None) for op, _ in ops] for p, ops in pages.items()}
    data = [(p, 3 * i, op, *(m or [None] * 6), 1) for p, ops in pages.items() for i, (op, m) in enumerate(ops)]
    df = spark.createDataFrame(data + [("one", None, "q", *[None] * 6, 1)], "page string, idx long, op string, a double, b double, c double, d double, e double, f double, depth int").repartition(4)
    got = {(r.page, r.idx): ([r.a, r.b, r.c, r.d, r.e, r.f], r.depth) for r in transforms.current_matrices(df, ["page"]).collect()}
    want = {(p, 3 * i): x for p, ops in pages.items() for i, x in enumerate(plain_stack(ops))}
    assert got.keys() == want.keys()
    for k, (m, depth) in want.items():
        assert got[k][1] == depth and np.allclose(got[k][0], m), k
    assert transforms.current_matrices(df.limit(0), ["page"]).count() == 0


def test_matrices_are_worked_out_in_more_tasks_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS_A_TASK", 40)
    far = 1 << 60  # positions and pages beyond what a float holds
    df = spark.range(400).selectExpr("cast(id % 2 + 1152921504606846977 as bigint) as page", f"{far} + id as idx", "'cm' as op", "1d as a", "0d as b", "0d as c", "1d as d", "1d as e", "0d as f")
    found = transforms.current_matrices(df, ["page"])
    assert found.rdd.getNumPartitions() == 10
    assert {(r.page, r.idx): r.e for r in found.collect()} == {(i % 2 + far + 1, far + i): i // 2 + 1.0 for i in range(400)}


# ---- names ----


def test_free_names_are_the_first_numbers_left(spark):
    rng = random.Random(6)
    candidates = [rng.choice(["a.pdf", "a.pdf", "a.pdf", "b", "c (2).pdf", "c.pdf", "d.v1.pdf", ".x"]) for _ in range(60)] + [None]
    existing = ["a.pdf", "a (2).pdf", "a (4).pdf", "a (5).pdf", "a (9).pdf", "b (3)", "c (02).pdf", "c (1).pdf", "other", None, "a (2).pdf", "d.v1 (2).pdf"]
    df = spark.createDataFrame([(i, c, 1) for i, c in enumerate(candidates)], "id long, candidate string, number int").repartition(4)
    got = {r.id: r.final for r in naming.free_names(df, spark.createDataFrame([(e,) for e in existing], "name string"), ["id"]).collect()}
    taken, want = {e for e in existing if e} , {}
    reserved = {c for c in candidates if c}
    for i, c in enumerate(candidates):
        if c is None:
            want[i] = None
            continue
        stem, ext = re.fullmatch(r"(.*?)(\.[^.]*)?", c).groups()
        k, name = 1, c
        while name in taken or k > 1 and name in reserved:
            k += 1
            name = f"{stem} ({k}){ext or ''}"
        taken.add(name)
        want[i] = name
    assert got == want
    assert len({v for v in got.values() if v}) == 60
    assert naming.free_names(df.limit(0), df.select(F.lit("a").alias("name")), ["id"]).count() == 0


# ---- assertions ----

OCCURRENCES = "file_id string, page_number int, w double, h double"
PAGES = "file_id string, page_number int, width_pt double, height_pt double"


def test_full_page_occurrences(spark):
    shown = spark.createDataFrame([("f", 1, 90.0, 180.0), ("f", 1, 89.0, 200.0), ("f", 2, 900.0, 900.0), ("f", 3, 9.0, 9.0), ("f", None, 9.0, 9.0), ("f", 1, None, 200.0)], OCCURRENCES)
    pages = spark.createDataFrame([("f", 1, 100.0, 200.0), ("f", 3, 0.0, 5.0)], PAGES)
    assert [r.full_page for r in assertions.full_page_occurrences(shown, pages, ["file_id", "page_number"]).sort(F.desc_nulls_last("w"), "h").collect()].count(True) == 1
    twice = pages.unionByName(pages.limit(1))
    with pytest.raises(Exception, match="duplicate page number: f, 1"):
        assertions.full_page_occurrences(shown, twice, ["file_id", "page_number"]).collect()


def test_a_region_without_members_is_an_error(spark):
    members = spark.createDataFrame([("p", 0.0, 0.0, 1.0, 1.0), ("p", 5.0, 5.0, 3.0, 3.0), ("q", 0.0, 0.0, 1.0, 1.0)], "page string, x double, y double, w double, h double")
    asked = spark.createDataFrame([("p",), ("p",)], "page string")
    assert rows(assertions.region_covering(members, ["page"], asked)) == [("p", 2, 0.0, 0.0, 8.0, 8.0)]
    with pytest.raises(Exception, match="needs a member to cover: z"):
        assertions.region_covering(members, ["page"], spark.createDataFrame([("z",)], "page string")).collect()


@pytest.mark.parametrize(
    ("job", "options", "message"),
    [
        (("a.pdf", "A.PDF", 1, 0, 0, True), {}, "destination is the source"),
        (("a.pdf", "b.pdf", 1, 0, 0, False), {}, "not a readable file"),
        (("a.pdf", "b.pdf", 1, 0, 0, None), {}, "not a readable file"),
        (("a.pdf", "b.pdf", 0, 1, 0, True), {}, "needs a renderer"),
        (("a.pdf", "b.pdf", 0, None, 0, True), {}, "nothing to do"),
        (("a.pdf", "b.pdf", 0, None, 0, True), {"final": True}, None),
        (("a.pdf", "b.pdf", 0, 1, 0, True), {"renderer": True}, None),
        (("a.pdf", "b.pdf", 0, 0, 1, True), {}, None),
    ],
)
def test_preconditions_of_cleaning(spark, job, options, message):
    df = spark.createDataFrame([job], "file_id string, destination string, n_selected int, n_flatten int, n_clear int, readable boolean")
    checked = assertions.clean_preconditions(df, **options)
    if message is None:
        assert checked.count() == 1
    else:
        with pytest.raises(Exception, match=message):
            checked.count()


def test_quality_of_any_sum_is_that_of_a_search(spark):
    totals = [*range(-5, max(jpeg.SUMS) + 50, 3), *jpeg.SUMS, None]
    got = spark.createDataFrame([(t,) for t in totals], "t long").select("t", jpeg.nearest_quality(F.col("t")).alias("q")).collect()
    assert all(r.q == (None if r.t is None else min(range(1, 101), key=lambda q: (abs(jpeg.SUMS[q - 1] - r.t), q))) for r in got)


def test_table_qualities_are_worked_out_in_more_than_one_task(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS_A_TASK", 20)
    assert editing.table_quality(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 10


def test_quality_from_table_sums(spark):
    tables = [(q, jpeg.scaled(q)) for q in range(1, 101)] + [(0, [1] * 63), (0, [None] * 64), (0, None), (-1, [10**6] * 64)]
    got = [(r.q, r.found) for r in spark.createDataFrame(tables, "q int, t array<int>").select("q", jpeg.table_quality(F.col("t")).alias("found")).collect()]
    first = {s: q for q, s in reversed(list(enumerate(jpeg.SUMS, 1)))}
    assert all(found == first[jpeg.SUMS[q - 1]] for q, found in got if q > 0)
    assert [f for q, f in got if q == 0] == [None] * 3 and [f for q, f in got if q == -1] == [1]
    assert jpeg.SUMS == sorted(jpeg.SUMS, reverse=True)


# ---- published files ----

FILES = "name string, content binary, passed boolean, extra int"


def test_a_batch_is_published_whole(spark, tmp_path):
    target = str(tmp_path / "out")
    files = [(f"f{i}.bin", bytes([i % 256]) * i * 50, True, 1) for i in range(40)]
    publish.publish(spark.createDataFrame(files, FILES).repartition(5), target)
    publish.publish(spark.createDataFrame([("more", b"x", True, 2)], FILES), f"file:{target}")
    publish.publish(spark.createDataFrame([], FILES), target)
    told = publish.manifest(spark, target).collect()
    assert {(r.name, r.n_bytes, r.sha256, r.error) for r in told} == {(n, len(c), hashlib.sha256(c).hexdigest(), None) for n, c, *_ in [*files, ("more", b"x", True, 2)]}
    for r in told:
        assert hashlib.sha256((tmp_path / "out" / r.path).read_bytes()).hexdigest() == r.sha256
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_staging")] and len(list((tmp_path / "out").iterdir())) == 3


@pytest.mark.parametrize("bad", [("g", None, True, 1), ("g", b"x", False, 1), ("g", b"x", None, 1), ("a/b", b"x", True, 1), ("", b"x", True, 1), (None, b"x", True, 1), ("f1", b"x", True, 1), ("_f", b"x", True, 1)])
def test_a_failing_file_leaves_nothing_behind(spark, tmp_path, bad):
    target = tmp_path / "out"
    with pytest.raises(Exception, match="verification failed|not a name|comes twice"):
        publish.publish(spark.createDataFrame([("f1", b"1", True, 1), ("f2", b"2", True, 1), bad], FILES).repartition(3), str(target))
    assert not target.exists() or list(target.iterdir()) == []


def test_failing_files_can_be_left_out(spark, tmp_path):
    target = str(tmp_path / "out")
    publish.publish(spark.createDataFrame([("f1", b"1", True, 1), ("f2", b"2", False, 1), ("f3", None, True, 1)], FILES), target, failures="skip")
    assert sorted((r.name, r.n_bytes, r.error) for r in publish.manifest(spark, target).collect()) == [("f1", 1, None), ("f2", None, "verification failed"), ("f3", None, "verification failed")]
    with pytest.raises(Exception, match="destination is the source"):
        publish.publish(spark.createDataFrame([("f1", b"1", True, 1)], FILES), target, source=f"file://{target}")


def test_attempts_that_were_lost_are_not_published(tmp_path):
    writer = publish.FileBatchWriter(str(tmp_path), "abort", None, ["name", "content", "passed"])
    fs, staging, place = writer._staging()
    for part in ("part-000000-1", "part-000000-2"):
        fs.create_dir(f"{staging}/files/{part}", recursive=True)
        fs.create_dir(f"{staging}/manifest", recursive=True)
        with fs.open_output_stream(f"{staging}/files/{part}/f") as out:
            out.write(b"1")
        with fs.open_output_stream(f"{staging}/manifest/{part}.parquet") as out:
            out.write(b"")
    writer.commit([publish.Staged("part-000000-2", 1, 1), None])
    assert sorted(str(p.relative_to(place)) for p in __import__("pathlib").Path(place).rglob("*") if p.is_file()) == ["files/part-000000-2/f", "manifest/part-000000-2.parquet"]


def test_cleaned_copies_are_published_under_their_names(spark, tmp_path):
    cleaned = spark.createDataFrame([("in/a", b"A", None), ("in/b", None, "PdfError: bad")], "file_id string, content binary, error string")
    names = spark.createDataFrame([("in/a", "a_cleaned.pdf"), ("in/b", "b_cleaned.pdf")], "file_id string, name string")
    publish.publish_cleaned(cleaned, names, str(tmp_path / "out"))
    assert sorted((r.name, r.error) for r in publish.manifest(spark, str(tmp_path / "out")).collect()) == [("a_cleaned.pdf", None), ("b_cleaned.pdf", "verification failed")]


def _digest(content):
    return hashlib.sha256(content).hexdigest()


def _place(spark, target, name):
    return target / publish.manifest(spark, str(target)).where(F.col("name") == name).first().path


def test_only_wanted_files_are_opened(spark, tmp_path):
    target = tmp_path / "out"
    files = [(f"f{i}", b"%d" % (i // 2), True, 1) for i in range(40)] + [("empty", b"", True, 1), ("failed", b"3", False, 1)]
    publish.publish(spark.createDataFrame(files, FILES).repartition(3), str(target), failures="skip")
    want = [(_digest(b"3"), "x"), (_digest(b"3"), "y"), (_digest(b""), "z"), ("0" * 64, "nowhere"), (None, "null")]
    wanted = spark.createDataFrame(want, "sha256 string, name string")
    found = {(r.name, bytes(r.content), r.n_bytes, r.sha256) for r in published.read_published(spark, str(target), wanted).collect()}
    assert found == {("f6", b"3", 1, _digest(b"3")), ("f7", b"3", 1, _digest(b"3")), ("empty", b"", 0, _digest(b""))}
    assert sorted((r.name, bytes(r.content)) for r in published.read_published(spark, str(target), wanted, once=True).collect()) == [("empty", b""), ("f6", b"3")]
    assert published.read_published(spark, str(target)).count() == 41 and published.read_published(spark, str(target), once=True).count() == 21
    assert published.read_published(spark, str(target), wanted.limit(0)).count() == 0
    # A changed file is noticed where it is read, and nowhere else.
    _place(spark, target, "f20").write_bytes(b"changed")
    assert published.read_published(spark, str(target), wanted).count() == 3
    with pytest.raises(Exception, match="does not hold what was published"):
        published.read_published(spark, str(target)).collect()


def test_conditions_on_the_manifest_are_handed_down(spark, tmp_path):
    target = tmp_path / "out"
    publish.publish(spark.createDataFrame([(f"f{i}", b"x" * i, True, 1) for i in range(30)], FILES).repartition(3), str(target))
    publish.publish(spark.createDataFrame([("g1", b"xxxxx", True, 1)], FILES), str(target))
    for name in ("f3", "f17"):
        _place(spark, target, name).unlink()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        files = published.read_published(spark, str(target))
        names = lambda df: sorted(r.name for r in df.collect())
        assert names(files.where("name = 'f5'")) == ["f5"] and names(files.where("name in ('f5', 'g1', 'none')")) == ["f5", "g1"]
        assert names(files.where("n_bytes > 25 and n_bytes <= 27")) == ["f26", "f27"] and names(files.where("name like 'g%'")) == ["g1"]
        assert names(files.where(F.col("sha256") == _digest(b"xxxxx"))) == ["f5", "g1"]
        assert names(files.where("name = 'f5' and name = 'f6'")) == [] and names(files.where("name > 'f8' and n_bytes < 9")) == ["g1"]
        with pytest.raises(Exception, match="f17"):
            files.where("n_bytes = 17").collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_nothing_published_is_an_empty_result(spark, tmp_path):
    assert published.read_published(spark, str(tmp_path / "none")).count() == 0
    publish.publish(spark.createDataFrame([], FILES), str(tmp_path / "out"))
    assert published.read_published(spark, str(tmp_path / "out"), spark.createDataFrame([("0" * 64,)], "sha256 string")).count() == 0


def test_a_filter_of_digests_loses_none(spark, tmp_path):
    digests = [(_digest(b"%d" % i),) for i in range(3000)]
    bits = published.write_digest_filter(spark.createDataFrame(digests, "sha256 string").repartition(3), str(tmp_path / "bits"))
    kept = published.DigestFilter(str(tmp_path / "bits"), bits)
    assert all(kept.may_hold(d) for (d,) in digests)
    assert sum(kept.may_hold(_digest(b"no %d" % i)) for i in range(3000)) < 60
