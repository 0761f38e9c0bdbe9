"""The labelled rows that a classifier learns from, and optimisation helpers in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut

#: At most so many labelled rows of each class are learned from.
ROWS_PER_CLASS = 3000


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", held_out_fold: int = 0, rows_per_class: int = ROWS_PER_CLASS, bytes_per_class: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """(id, text, y) of a bounded sample of labelled rows, and how many labelled rows each class has.

    Only ids whose crc32(id as text) mod 5 is not `held_out_fold` count. Rows of `labels` with a null id or
    label are left out; if an id has several labels the larger holds. Of each class the `rows_per_class` rows
    with the smallest id hashes are taken, so the sample does not depend on partitions; of rows of `docs` that repeat an id, the
    text of least hash. With `bytes_per_class`, texts in that order are taken up to so many bytes, and longer ones passed over.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .where(F.crc32(F.col(id_col).cast("string")) % 5 != held_out_fold)
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
    )
    totals = {r.y: r["count"] for r in known.groupBy("y").count().collect() if r.y in (0, 1)}
    chosen = None
    for y in (0, 1):
        own = known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows_per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    joined = rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # at most 2 x rows_per_class rows
    sample = cut(joined.groupBy(F.col("_id").alias("id"), "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "y"))
    if bytes_per_class is not None:
        upto = F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
        sizes = sample.select("id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
        taken = sizes.where(F.col("size") <= bytes_per_class).withColumn("upto", upto).where(F.col("upto") <= bytes_per_class).select("id")
        sample = sample.join(F.broadcast(taken), "id", "left_semi")  # at most 2 x rows_per_class rows
    return sample, totals


class Adam:
    """Adam over a list of arrays that are changed in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m = [np.zeros_like(a) for a in arrays]
        self.v = [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
