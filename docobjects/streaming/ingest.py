"""Continuous ingestion of new PDF files: an addition to the batch operators, with the same relations and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import PLACEMENTS
from ..sources.documents import PARSED, _parse

CHANGES = "kind int, identity string, usage_count long, files long, is_safe boolean, batch long"


def placements_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Placements of every PDF file that appears in a folder, each file parsed once."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.pdf")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(folder)
    )
    parsed = files.select(F.col("path").alias("file_id"), "content").mapInPandas(_parse, PARSED)
    rows = parsed.where("relation = 'placements'").select("file_id", F.from_json("body", PLACEMENTS).alias("r"))
    return rows.select("file_id", "r.kind", "r.identity", "r.page_number", "r.is_safe")


def group_counts(placements: DataFrame) -> DataFrame:
    """Running corpus groups: usage_count, approximate file count and safety by kind and identity."""
    return placements.groupBy("kind", "identity").agg(F.count(F.lit(1)).alias("usage_count"), F.approx_count_distinct("file_id").alias("files"), F.bool_and("is_safe").alias("is_safe"))


def keep_groups(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the groups that every batch changes under `path`, one folder a batch.

    The running counts are state of the stream, keyed by group and spread over its tasks; a batch costs what it changes, and nothing
    passes through the driver. A batch that is run again after a failure writes the same folder anew, so no change counts twice.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def current_groups(spark: SparkSession, path: str) -> DataFrame:
    """The groups as the last batch that changed each of them left them; a path without batches is an error."""
    changes = spark.read.schema(CHANGES).parquet(path)
    last = changes.groupBy("kind", "identity").agg(F.max_by(F.struct("usage_count", "files", "is_safe"), "batch").alias("r"))
    return last.select("kind", "identity", "r.*")


def start_ingest(spark: SparkSession, folder: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the groups of a folder's files under `path` (see current_groups); state and progress live in `checkpoint`."""
    return keep_groups(group_counts(placements_stream(spark, folder)), path, checkpoint)
