"""Connected components of many graphs at once, each under a key of its own: the pages of a collection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, tasks_for

#: Edges of a key that one task may hold; keys with more are contracted by joins that spread over all tasks.
CROWDED = 200_000
#: Edges that a task works on at once, besides those of the key it is in.
AT_ONCE = 500_000


def _least_reached(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, obj, least obj that edges of the key reach) for all objects of the edges; all keys in one pass."""
    ends = np.stack([np.concatenate([key, key]), np.concatenate([a, b])], axis=1)
    vertices, at = np.unique(ends, axis=0, return_inverse=True)
    left, right = at.reshape(2, -1)
    root = np.arange(len(vertices))
    while True:
        low = root.copy()
        np.minimum.at(low, left, root[right])
        np.minimum.at(low, right, root[left])
        low = low[low]
        if (low == root).all():
            return vertices[:, 0], vertices[:, 1], vertices[root, 1]
        root = low


def _whole_keys(keys: list[str]):
    """Components of keys that lie whole and sorted in a partition."""

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        first = pdf.loc[~pd.Series(codes).duplicated().to_numpy(), keys].reset_index(drop=True)
        key, obj, least = _least_reached(codes, pdf.a.to_numpy(), pdf.b.to_numpy())
        return first.iloc[key].reset_index(drop=True).assign(obj=obj, component=least)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in pdfs:
            held.append(pdf)
            if sum(map(len, held)) < AT_ONCE:
                continue
            rows = pd.concat(held, ignore_index=True)
            # The last key may go on in the next batch.
            last = np.ones(len(rows), bool)
            for k in keys:
                last &= (rows[k] == rows[k].iloc[-1]).to_numpy() | (rows[k].isna() & pd.isna(rows[k].iloc[-1])).to_numpy()
            if not last.all():
                yield told(rows[~last].reset_index(drop=True))
            held = [rows[last]]
        if held and sum(map(len, held)):
            yield told(pd.concat(held, ignore_index=True))

    return run


def _stars(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, obj, component) by alternating large and small stars, all keys side by side.

    Each round hangs the larger neighbours of an object under its least one and then the smaller ones; the joins are on key and
    object, so a key's work spreads over all tasks. Rounds end when the edges no longer change.
    """
    both = lambda df: df.select(*keys, "u", "v").unionByName(df.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    downward = lambda df: df.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = cut(downward(edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v"))))
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not seen.n or mark == (seen.n, seen.h):
            break
        mark = seen.n, seen.h
        ways = both(now)
        least = ways.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = cut(downward(ways.where("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))))
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"])
        now = cut(downward(small.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select(*keys, "u", F.col("m").alias("v")))))
    child = now.select(*keys, F.col("u").alias("obj"), F.col("v").alias("component"))
    return child.unionByName(now.select(*keys, F.col("v").alias("obj"), F.col("v").alias("component"))).distinct()


def keyed_components(edges: DataFrame, keys: list[str], crowded: int = CROWDED) -> DataFrame:
    """(keys, obj, component) for every object that an edge a - b of its key touches; component is the least object reached.

    Keys of up to `crowded` edges are worked out whole, many at a time, in the task they are dealt to; those of more, each
    at the cost of a few joins a round that spread over all tasks, so that no key has to fit into one. Edges with a null end are
    left out, loops make an object a component of its own, repeated edges count once, and null keys are keys like others. No
    edges give no rows. Ends must be integers; other columns are not read. The edges are written down once.
    """
    private = [f"_k{i}" for i in range(len(keys))]
    plain = edges.where("a is not null and b is not null").select(*[F.col(k).alias(p) for k, p in zip(keys, private, strict=True)], F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    plain = cut(plain)
    kinds = dict(plain.dtypes)
    ddl = ", ".join(f"{k} {kinds[k]}" for k in private) + ", obj long, component long"
    # One row for so many edges at most.
    busy = cut(plain.groupBy(*private).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowded))
    some = bool(busy.limit(1).count())
    same = F.expr(" and ".join(f"e.{k} <=> c.{k}" for k in private))
    few = plain.alias("e").join(busy.alias("c"), same, "left_anti") if some else plain
    out = few.repartition(tasks_for(plain), *private).sortWithinPartitions(*private).mapInPandas(_whole_keys(private), ddl)
    if some:
        # Null keys meet in the joins of the rounds as values of their own.
        many = plain.alias("e").join(busy.alias("c"), same, "left_semi")
        flags = [f"_f{i}" for i in range(len(private))]
        blank = {k: F.coalesce(F.col(k), _blank(kinds[k])) for k in private}
        many = many.select(*[F.col(k).isNull().alias(f) for k, f in zip(private, flags, strict=True)], *[c.alias(k) for k, c in blank.items()], "a", "b")
        loops = many.where("a = b").select(*flags, *private, F.col("a").alias("obj"), F.col("a").alias("component"))
        found = _stars(many, [*flags, *private])
        found = found.unionByName(loops.join(found, [*flags, *private, "obj"], "left_anti").distinct())
        out = out.unionByName(found.select(*[F.when(~F.col(f), F.col(k)).alias(k) for k, f in zip(private, flags, strict=True)], "obj", "component"))
    return out.select(*[F.col(p).alias(k) for k, p in zip(keys, private, strict=True)], "obj", "component")


def _blank(kind: str):
    return F.lit("" if kind == "string" else 0).cast(kind)
