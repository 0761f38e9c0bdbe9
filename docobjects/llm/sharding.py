"""Contiguous shards of equal bytes: global prefix sums of document sizes, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut, width


def document_bytes(text: Column, overhead: int = 8) -> Column:
    """UTF-8 bytes of a text (null: none) plus the fixed bytes that a record takes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)


def running_totals(df: DataFrame, order: list[str], size: str) -> DataFrame:
    """df with before (bytes of all rows ahead in the global order), row (index in it, from 0) and total.

    Rows are dealt to ranges of the order; one total per range is summed up over the ranges and added to
    the running sum inside each range. Nothing but one row per range meets in a single task.
    Ties in `order` are broken by a row number taken once, before the ranges are written down.
    """
    parts = 4 * width(df.sparkSession)
    ranged = cut(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *[F.col(c).asc_nulls_last() for c in order], F.col("_tie"))
        .withColumn("_part", F.spark_partition_id())
    )
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = (
        ranged.groupBy("_part")
        .agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_bytes_ahead"),
            F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows_ahead"),
            F.sum("_bytes").over(everything).alias("total"),
        )
    )
    inside = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_last() for c in order], "_tie")
    return (
        ranged.withColumns(
            {
                "_sum": F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
                "_n": F.row_number().over(inside),
            }
        )
        .join(F.broadcast(totals), "_part")  # one row per range: at most 4 x shuffle partitions
        .withColumns(
            {
                "before": F.col("_bytes_ahead") + F.col("_sum") - F.col(size),
                "row": F.col("_rows_ahead") + F.col("_n") - 1,
            }
        )
        .drop("_part", "_tie", "_sum", "_n", "_bytes_ahead", "_rows_ahead")
    )


def shard_by_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24) -> DataFrame:
    """Assigns every row to one of `n_shards` contiguous shards whose byte sizes are near equal.

    Rows stand in the order of (id, CRC, size), null ids last. A row belongs to the shard whose target
    interval holds the middle of its bytes, so no shard is off its target by more than one document.
    slot counts the rows of each shard gaplessly from 0, in that order.

    A null text has no bytes (CRC 0); an empty table gives an empty result; rows that repeat an id keep
    their own slots, equal rows being interchangeable; a document larger than a target leaves some
    shards empty. Other columns are neither read nor returned. n_shards x 2 x total bytes must stay
    below 2**63 (24 shards: 190 petabytes).

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law).
    """
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        document_bytes(F.col(text_col)).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
    )
    placed = running_totals(rows, ["doc_id", "text_crc32", "size"], "size").withColumn(
        "shard",
        F.least(F.expr(f"((2 * before + size) * {n_shards}) div (2 * total)"), F.lit(n_shards - 1)).cast("int"),
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row per shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
