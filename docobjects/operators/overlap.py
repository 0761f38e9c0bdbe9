"""Where objects of different kinds lie over one another: edges, regions and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import FULL_PAGE, padded
from ..lineage import cut
from ..schema import SHAPE
from .components import keyed_components

#: Tops farther apart than this begin a new line of the reading order.
LINE_GAP = 8


def with_boxes(placements: DataFrame) -> DataFrame:
    """placements with their padded boxes: left, bottom, right, top."""
    return placements.withColumns(padded(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def is_furniture(page_w, page_h):
    """A shape whose box has at least 0.9 of the page in both directions: frames and backgrounds join nothing."""
    return (F.col("kind") == SHAPE) & (F.col("right") - F.col("left") >= FULL_PAGE * page_w) & (F.col("top") - F.col("bottom") >= FULL_PAGE * page_h)


#: Side of a cell of the grid that pairs are formed in, in points.
CELL = 64.0


def overlap_edges(placements: DataFrame, page: list[str], page_w, page_h, cell: float = CELL) -> DataFrame:
    """Pairs a < b (by obj) of a page that belong together; obj numbers a page's objects in drawing order.

    An object that does not hide what is below joins what it lies inside; otherwise, if the other does not hide, that one
    has to lie inside; two that hide join where they truly overlap (common edges do not count). Page and grid cell are equality
    keys: an object stands in every cell that its box touches (cells beyond the page count as its border cells), and a
    pair is formed in the one cell that holds the lower left corner of what both cover. So a crowded page is no hot key.
    """
    boxed = with_boxes(placements).where(~is_furniture(page_w, page_h))
    last = {"x": F.ceil(F.lit(page_w) / cell) if isinstance(page_w, (int, float)) else F.ceil(page_w / cell), "y": F.ceil(F.lit(page_h) / cell) if isinstance(page_h, (int, float)) else F.ceil(page_h / cell)}
    boxed = boxed.select(*page, "obj", "hides", "left", "bottom", "right", "top", last["x"].alias("nx"), last["y"].alias("ny"))
    index = lambda at, n: f"least(greatest(floor({at} / {cell}D), -1L), {n})"
    cells = lambda low, high, n: F.explode(F.expr(f"sequence({index(low, n)}, {index(high, n)})"))
    boxed = boxed.withColumn("cx", cells("left", "right", "nx")).withColumn("cy", cells("bottom", "top", "ny"))
    inside = lambda p, q: f"({p}.left >= {q}.left and {p}.right <= {q}.right and {p}.bottom >= {q}.bottom and {p}.top <= {q}.top)"
    strict = "(a.left < b.right and b.left < a.right and a.bottom < b.top and b.bottom < a.top)"
    keys = " and ".join(f"a.{k} = b.{k}" for k in [*page, "cx", "cy"])
    corner = f"a.cx = {index('greatest(a.left, b.left)', 'a.nx')} and a.cy = {index('greatest(a.bottom, b.bottom)', 'a.ny')}"
    rule = f"case when not a.hides then {inside('a', 'b')} when not b.hides then {inside('b', 'a')} else {strict} end"
    # The plain touch test goes first; it needs no branches and rejects nearly all pairs.
    touch = "a.left <= b.right and b.left <= a.right and a.bottom <= b.top and b.bottom <= a.top"
    joined = boxed.alias("a").join(boxed.alias("b"), F.expr(f"{keys} and a.obj < b.obj and {touch} and {corner} and {rule}"))
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in page], F.col("a.obj").alias("a"), F.col("b.obj").alias("b"))


def region_members(edges: DataFrame, page: list[str]) -> DataFrame:
    """page, obj, region for every object with an edge; region is the least obj that edges reach. Pages are independent.

    They are written down, as regions and what is left over both read them.
    """
    return cut(keyed_components(edges, page).withColumnRenamed("component", "region"))


def regions(placements: DataFrame, members: DataFrame, page: list[str], page_w, page_h) -> DataFrame:
    """Regions of at least two objects and two kinds: box of their padded boxes, members, kinds, covers_page.

    page_w and page_h are numbers, or columns of placements that are the same all over a page.
    """
    boxed = with_boxes(placements).join(members, [*page, "obj"])
    out = boxed.groupBy(*page, "region").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_distinct("kind").alias("kinds"),
        F.min("left").alias("left"),
        F.min("bottom").alias("bottom"),
        F.max("right").alias("right"),
        F.max("top").alias("top"),
        F.max(page_w if isinstance(page_w, Column) else F.lit(page_w)).alias("_width"),
        F.max(page_h if isinstance(page_h, Column) else F.lit(page_h)).alias("_height"),
    )
    full = (F.col("right") - F.col("left") >= FULL_PAGE * F.col("_width")) & (F.col("top") - F.col("bottom") >= FULL_PAGE * F.col("_height"))
    return out.where("members >= 2 and kinds >= 2").withColumn("covers_page", full).drop("_width", "_height")


def reading_order(objects: DataFrame, page: list[str], top: str, left: str, ties: list[str], out: str = "position") -> DataFrame:
    """objects with line_no and their position on the page: lines from the top, in a line from the left.

    A new line begins where an object's top is more than LINE_GAP below the one before it.
    """
    down = Window.partitionBy(*page).orderBy(F.desc(top), left, *ties)
    gap = F.coalesce((F.lag(top).over(down) - F.col(top) > LINE_GAP).cast("int"), F.lit(0))
    lines = objects.withColumn("_gap", gap).withColumn("line_no", F.sum("_gap").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
    return lines.withColumn(out, F.row_number().over(Window.partitionBy(*page).orderBy("line_no", left, *ties)))
