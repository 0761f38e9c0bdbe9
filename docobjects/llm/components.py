"""Connected components of a graph that lies in a DataFrame: trees within each task, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Edges of a task: few edges lie in few partitions, so that a round of them leaves few files behind.
EDGES = 20_000


def _each(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """For every row the named pairs of its columns as (u, v)."""
    return df.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("x")).select("x.u", "x.v")


def _hung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition as (vertex, smallest vertex that they reach), smallest ones included."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            above[max(u, v)] = min(u, v)
    if above:
        yield pa.record_batch([pa.array(list(above), schema.field(0).type), pa.array([top(x) for x in list(above)], schema.field(1).type)], names=["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that an edge between two different ids touches; component is the smallest
    id that can be reached.

    A task gets about EDGES edges and hangs its vertices under the smallest one that these reach. Where one task
    has all edges, that is the result. Else rounds follow: each hangs the larger neighbours of every vertex under its
    smallest one (large star), then the smaller ones too (small star), so the depth of the forest shrinks by a constant
    factor; hubs cost a join that can be split, never a group in one task. Edges with a null end and loops are left out; no
    edges give no rows. Edges are read twice, so they should be written down; those of every round are checkpointed.
    """
    pair = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    hung = lambda df, tasks: df.coalesce(tasks).mapInArrow(_hung, df.schema)
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    few, mark = ends.count() // EDGES + 1, None
    now = hung(ends, few)
    while few > 1:
        now = cut(pair(now))
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark:
            return _each(now, ("u", "v"), ("v", "v")).distinct().toDF("id", "component")
        mark, few = (seen.n, seen.h), seen.n // EDGES + 1
        now = hung(now, few)
        if few > 1:
            both = _each(now.where("u <> v"), ("u", "v"), ("v", "u"))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = cut(large.where("u <> v").coalesce(few))
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            now = _each(large.join(least, "u"), ("v", "m"), ("u", "m"))
    return now.toDF("id", "component")
