"""Rows inside and outside of ranges: which operators of a page a removal covers, and which instances a region holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .overlap import with_boxes

#: Positions of a stretch: ranges are cut at its borders, so that a long range meets its rows in many tasks.
STRETCH = 4096


def mark_inside(rows: DataFrame, ranges: DataFrame, keys: list[str], at: str = "idx", first: str = "first", last: str = "last", stretch: int = STRETCH, out: str = "inside") -> DataFrame:
    """rows with whether their position lies in one of their key's ranges [first, last].

    Ranges are cut at the borders of stretches of positions and meet the rows of the same key and stretch, where one pass in the
    order of positions tells how far the ranges begun so far reach. So a row is never copied and no pair of row and range is
    formed, however many ranges overlap; a page that holds most rows is spread over its stretches, and a range costs one
    row for each stretch it touches.

    Rows with a null position or key lie outside; ranges with a null end or a last before their first hold nothing; repeated rows
    and ranges change nothing. Empty tables give empty tables, and no ranges leave all rows outside. Ends and positions are integers.
    """
    position, border = "_at", "_stretch"
    usable = ranges.where(F.col(first) <= F.col(last)).select(*keys, F.col(first).cast("long").alias("_first"), F.col(last).cast("long").alias("_last")).distinct()
    block = lambda c: F.floor(F.col(c) / F.lit(stretch))
    pieces = usable.withColumn(border, F.explode(F.sequence(block("_first"), block("_last"))))
    pieces = pieces.select(*keys, border, F.greatest("_first", F.col(border) * stretch).alias(position), F.least("_last", (F.col(border) + 1) * stretch - 1).alias("_reach"))
    # Ranges of a stretch that begin together count by the one that reaches farthest.
    pieces = pieces.groupBy(*keys, border, position).agg(F.max("_reach").alias("_reach"))
    dealt = rows.withColumn(position, F.col(at).cast("long")).withColumn(border, block(position)).withColumn("_row", F.lit(True))
    both = dealt.withColumn("_reach", F.lit(None).cast("long")).unionByName(pieces.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys, border).orderBy(position, "_row").rowsBetween(Window.unboundedPreceding, 0)
    covered = F.coalesce(F.max("_reach").over(upto) >= F.col(position), F.lit(False))
    for k in keys:
        covered = covered & F.col(k).isNotNull()
    return both.withColumn(out, covered).where("_row").select(*rows.columns, out)


def outside_ranges(rows: DataFrame, ranges: DataFrame, keys: list[str], at: str = "idx", first: str = "first", last: str = "last", stretch: int = STRETCH) -> DataFrame:
    """rows (range anti join) that no range of their key covers: what is left of a page when whole operator ranges go."""
    return mark_inside(rows, ranges, keys, at, first, last, stretch, "_inside").where("not _inside").drop("_inside")


def inside_ranges(rows: DataFrame, ranges: DataFrame, keys: list[str], at: str = "idx", first: str = "first", last: str = "last", stretch: int = STRETCH) -> DataFrame:
    """rows (range semi join) that a range of their key covers, each once."""
    return mark_inside(rows, ranges, keys, at, first, last, stretch, "_inside").where("_inside").drop("_inside")


def region_instances(instances: DataFrame, regions: DataFrame, wanted: DataFrame, page: list[str], id_col: str = "obj") -> DataFrame:
    """instances with whether they are members of a listed region: same page, kind and identity as something the region
    lists, and a box that truly overlaps the region's (common edges do not count).

    instances: page, id, kind, identity, x, y, w, h; regions: page, region, left, bottom, right, top; wanted: page, region, kind,
    identity. A member counts once, however many regions hold it; null kinds, identities or boxes are no members. What is not
    a member is one of the others, which stay.
    """
    listed = wanted.select(*page, "region", "kind", "identity").distinct().join(regions.select(*page, "region", "left", "bottom", "right", "top"), [*page, "region"])
    boxed = with_boxes(instances.select(*page, id_col, "kind", "identity", "x", "y", "w", "h"))
    keys = " and ".join(f"i.{k} = r.{k}" for k in [*page, "kind", "identity"])
    meets = "i.left < r.right and r.left < i.right and i.bottom < r.top and r.bottom < i.top"
    members = boxed.alias("i").join(listed.alias("r"), F.expr(f"{keys} and {meets}"), "left_semi").select(*page, id_col).distinct().withColumn("member", F.lit(True))
    return instances.join(members, [*page, id_col], "left").withColumn("member", F.coalesce("member", F.lit(False)))
