"""Conditions that a query must meet, checked in the plan itself: what breaks them fails the job that reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import covers_page
from .overlap import with_boxes


def require(df: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """df, which fails with `message` at the first row that does not meet the condition; null counts as not met.

    The check is part of a filter, so it stays when later steps read fewer columns; only a joined side that nothing reads is never run.
    """
    message = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message)))


def one_page_each(pages: DataFrame, by: list[str], sizes: list[str]) -> DataFrame:
    """by and sizes of pages, one row for each page; a page that comes twice, in equal rows or not, is an error."""
    counted = pages.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in sizes])
    told = F.concat(F.lit("duplicate page number: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in by]))
    return require(counted, F.col("_n") == 1, told).drop("_n")


def full_page_occurrences(occurrences: DataFrame, pages: DataFrame, by: list[str], width: str = "width_pt", height: str = "height_pt") -> DataFrame:
    """occurrences with full_page: whether each covers 0.9 of its page both ways.

    occurrences: by, w, h; pages: by, width, height. Pages that are not known, or have no size, warn of nothing; a page
    listed twice is an error. Occurrences with null boxes do not cover anything.
    """
    joined = occurrences.join(one_page_each(pages, by, [width, height]), by, "left")
    sized = (F.col(width) > 0) & (F.col(height) > 0)
    full = F.coalesce(sized & covers_page(F.col("w"), F.col("h"), F.col(width), F.col(height)), F.lit(False))
    return joined.withColumn("full_page", full).select(*occurrences.columns, "full_page")


def region_covering(members: DataFrame, by: list[str], regions: DataFrame) -> DataFrame:
    """by, members, left, bottom, right, top for every row of regions (by): the box of all its members' padded boxes, whether they overlap or
    not. A region without members is an error; members of regions that are not asked for are left out."""
    boxes = with_boxes(members).groupBy(*by).agg(
        F.count(F.lit(1)).alias("members"), F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top")
    )
    told = F.concat(F.lit("a region needs a member to cover: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in by]))
    return require(regions.select(*by).distinct().join(boxes, by, "left"), F.col("members") > 0, told)


def clean_preconditions(jobs: DataFrame, renderer: bool = False, final: bool = False) -> DataFrame:
    """jobs (file_id, destination, n_selected, n_flatten, n_clear, readable) that may be cleaned; one that may not fails the query.

    The destination must not be the source; a file must still be readable; what is flattened needs a renderer; and there must be
    something to do, unless the output is the final one, which is owed to the user either way. Null counts are 0.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    told = lambda what: F.concat(F.lit(f"{what}: "), F.coalesce("file_id", F.lit("null")))
    jobs = require(jobs, F.lower("destination") != F.lower("file_id"), told("the destination is the source"))
    jobs = require(jobs, F.col("readable"), told("not a readable file"))
    jobs = require(jobs, F.lit(renderer) | (n("n_flatten") == 0), told("flattening needs a renderer"))
    return require(jobs, F.lit(final) | (n("n_selected") + n("n_flatten") + n("n_clear") > 0), told("nothing to do"))
