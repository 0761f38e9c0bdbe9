"""Placements and showings from the test tables, so that every relational operator runs without PDF files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import dealt

LINES_PER_PAGE = 40
PAGE_WIDTH, PAGE_HEIGHT = 600, 840


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def showings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a text showing: doc_id, line_no, page_number, value."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), (F.floor(F.col("pos") / LINES_PER_PAGE) + 1).cast("long").alias("page_number"), "value")


def placements(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    """Every line item as a placed object on a page; file_id, page_uid, page_number, seq, kind, identity, box, hides.

    With `by` they are dealt by these columns to as many tasks as there are rows for.
    """
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 1000000 + cast(l_linenumber as bigint) * 100000 + l_partkey as seq",
        "cast(floor(l_orderkey / 2000.0) as bigint) as file_id",
        "cast(floor(l_orderkey / 40.0) as bigint) as page_uid",
        "cast(floor(l_orderkey / 40.0) as bigint) % 50 + 1 as page_number",
        "cast(l_partkey % 5 as int) as kind",
        "l_partkey as identity",
        "(l_orderkey * 31 + l_linenumber * 97) % 560 as x",
        "(l_suppkey * 37 + l_linenumber * 53 + l_partkey) % 800 as y",
        "5 + cast(l_quantity as bigint) as w",
        "4 + l_partkey % 30 as h",
        "l_returnflag <> 'N' as hides",
    )
    return dealt(rows, by) if by else rows


def numbered_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements with obj, their number on the page in drawing order (ties by position)."""
    order = Window.partitionBy("page_uid").orderBy("seq", "x", "y", "w", "h", "hides")
    return placements(spark, sf_dir, ["page_uid"]).withColumn("obj", F.row_number().over(order))
