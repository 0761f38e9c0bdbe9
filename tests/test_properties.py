"""Properties that hold for all inputs."""

import math
import random
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docobjects.functions import text as X
from docobjects.operators import grouping as A
from docobjects.operators import overlap as O
from docobjects.sources.content import IDENTITY, mapped_box, multiply, point, rounded
from docobjects.sources.images import resize
from docobjects.sources.pdf import Lexer, Name, Op, Ref, operators, serialise, serialise_operators

names = st.text(st.characters(min_codepoint=1, max_codepoint=255), min_size=1, max_size=8).map(Name)
plain = st.one_of(st.none(), st.booleans(), st.integers(-(10**9), 10**9), st.binary(max_size=30), names, st.builds(Ref, st.integers(1, 99999), st.integers(0, 9)))
values = st.recursive(plain, lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(names, inner, max_size=4)), max_leaves=12)
matrices = st.tuples(*[st.floats(-9, 9).map(lambda v: round(v, 3))] * 6)


@given(values)
@settings(max_examples=300, deadline=None)
def test_what_is_written_is_read(value):
    assert Lexer(serialise(value)).read() == value


@given(st.lists(st.tuples(st.lists(st.one_of(st.integers(-999, 999), st.binary(max_size=9), names), max_size=3), st.sampled_from(["q", "Q", "cm", "re", "f*", "Tj", "'", "T*"])), max_size=12))
@settings(max_examples=200, deadline=None)
def test_operators_round_trip(ops):
    ops = [Op(a, b) for a, b in ops]
    assert operators(serialise_operators(ops)) == ops


@given(st.binary(max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_bytes_are_a_content_stream(data):
    operators(data)


@given(matrices, matrices, st.floats(-99, 99), st.floats(-99, 99))
def test_matrices_compose(m, n, x, y):
    a, b = point(multiply(m, n), x, y), point(n, *point(m, x, y))
    assert all(math.isclose(p, q, abs_tol=1e-6) for p, q in zip(a, b))
    assert mapped_box(IDENTITY, x, y, 1, 2) == (x, y, (x + 1) - x, (y + 2) - y)


@given(st.floats(-1e6, 1e6), st.integers(1, 3))
def test_rounding_is_near_and_short(value, digits):
    text = rounded(value, digits)
    assert abs(Decimal(text) - Decimal(repr(value))) <= Decimal(1).scaleb(-digits) / 2 and text != "-0" and not (("." in text) and text.endswith("0"))


@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 255), st.integers(1, 9), st.integers(1, 9))
@settings(deadline=None)
def test_flat_images_stay_flat(w, h, value, new_w, new_h):
    assert resize(bytes([value]) * w * h, w, h, 1, new_w, new_h) == bytes([value]) * new_w * new_h


def test_page_runs_of_many_sets(spark):
    rng = random.Random(1)
    sets = {g: {rng.randint(1, 30) for _ in range(rng.randint(1, 20))} for g in range(150)}

    def want(pages):
        out, pages = [], sorted(pages)
        while pages:
            k = 1
            while k < len(pages) and pages[k] == pages[0] + k:
                k += 1
            out += [f"{pages[0]}〜{pages[k - 1]}"] if k >= 3 else map(str, pages[:k])
            pages = pages[k:]
        return ", ".join(out)

    df = spark.createDataFrame([(g, p) for g, pages in sets.items() for p in [*pages, min(pages)]], "g int, page_number int").repartition(5)
    assert {r.g: r.page_ranges for r in A.page_runs(df, ["g"]).collect()} == {g: want(p) for g, p in sets.items()}


def test_reading_order_of_many_pages(spark):
    rng = random.Random(2)
    rows = [(p, i, float(rng.randrange(5) * 40), float(rng.randrange(120))) for p in range(40) for i in range(rng.randint(1, 25))]

    def want(page):
        own = sorted((r for r in rows if r[0] == page), key=lambda r: (-r[3], r[2], r[1]))
        line, lines = 0, []
        for k, r in enumerate(own):
            line += k > 0 and own[k - 1][3] - r[3] > O.LINE_GAP
            lines.append((line, r[2], r[1]))
        return [i for _, _, i in sorted(lines)]

    df = spark.createDataFrame(rows, "page_number int, obj int, x double, top double").repartition(7)
    got = O.reading_order(df, ["page_number"], "top", "x", ["obj"]).collect()
    for page in range(40):
        assert [r.obj for r in sorted((r for r in got if r.page_number == page), key=lambda r: r.position)] == want(page)


def test_byte_sizes_of_many_numbers(spark):
    rng = random.Random(3)
    numbers = [rng.randrange(1 << rng.randrange(1, 45)) for _ in range(500)]

    def want(n):
        for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
            if n >= 1024**power:
                return f"{Decimal(n) / 1024**power:.1f}".removesuffix(".0") + f" {unit}"
        return f"{n} B"

    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", X.byte_size(F.col("n")).alias("t"))
    # Exact halves of a tenth may be rounded either way by different formatters.
    assert all(r.t == want(r.n) for r in df.collect() if not any((20 * r.n) % (1024**p) == 0 for p in (1, 2, 3)))
