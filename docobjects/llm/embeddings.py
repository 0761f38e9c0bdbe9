"""Near-duplicate embeddings: random-hyperplane signatures in several tables, exact cosines, components.

Tables hold sketches (all signs of a vector, a bit each) instead of vectors; a vector itself goes only where its sketch
has found it a partner that no earlier table has.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, width
from .components import connected_components

#: Most vectors of a bucket that are compared at once; larger buckets are compared part by part.
PART = 1500
#: Most large buckets whose names are broadcast (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Least signs of a sketch; where the tables have fewer, hyperplanes that belong to no table are added.
LEAST_SIGNS = 160


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Usable vectors (finite, no null component, not zero), None for the rest."""
    flat, offsets = column.values, column.offsets.to_numpy()
    holes = flat.is_null().to_numpy(zero_copy_only=False)
    dtype = np.float32 if pa.types.is_float32(flat.type) else np.float64
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype)
    bad = np.concatenate([[0], np.cumsum(holes | ~np.isfinite(values))])
    some = np.concatenate([[0], np.cumsum(values != 0)])
    ok = column.is_valid().to_numpy(zero_copy_only=False)
    spans = zip(offsets[:-1], offsets[1:], strict=True)
    return [values[i:j] + 0 if v and bad[j] == bad[i] and some[j] > some[i] else None for v, (i, j) in zip(ok, spans, strict=True)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, key, body): a vector's bytes and their digest, null where it is not usable."""
    for batch in batches:
        body = [None if v is None else v.tobytes() for v in _vectors(batch.column(2))]
        key = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in body]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(key, pa.binary()), pa.array(body, pa.binary())], names=["vec_id", "label", "key", "body"])


def plan_tables(n: int, threshold: float, recall: float = 0.998) -> tuple[int, int]:
    """Bits and tables: buckets of a few dozen vectors on average, and enough tables that a pair just at the
    threshold meets in one of them with probability `recall`."""
    bits = min(max(round(math.log2(max(n, 1))) - 6, 6), 24)
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p))


def sketch_bound(signs: int, threshold: float, miss: float = 1e-6) -> int:
    """Most signs in which the sketches of a candidate may differ: a pair just at the threshold differs in more
    with probability `miss` at most (closer pairs less often), each sign differing by itself."""
    p = math.acos(threshold) / math.pi
    term, total, h = (1 - p) ** signs, 0.0, 0
    while h < signs:
        total += term
        if total >= 1 - miss:
            break
        term *= (signs - h) / (h + 1) * p / (1 - p)
        h += 1
    return h


def sketches(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The side of every hyperplane on which each row lies, packed into bytes."""
    return np.packbits(unit @ planes >= 0, axis=1)


def _signs(packed, signs: int) -> np.ndarray:
    """A row of 0 and 1 for every packed sketch."""
    flat = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    return np.unpackbits(flat, axis=1, count=signs)


def _words(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One number a table for every row of signs."""
    return signs[:, : bits * tables].reshape(len(signs), tables, bits).astype(np.int32) @ (1 << np.arange(bits, dtype=np.int32))


def _unit(bodies, dtype) -> np.ndarray:
    v = np.frombuffer(b"".join(bodies), dtype=dtype).reshape(len(bodies), -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _sketch(signs: int, seed: int, dtype):
    """Adds every vector's sketch and length to (vec_id, label, key, body), and leaves its body out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for batch in _digest(batches):
            body = batch.column(3).to_pylist()
            sizes = [None if x is None else len(x) for x in body]
            out: list[bytes | None] = [None] * len(body)
            for size in {x for x in sizes if x is not None}:
                at = [i for i, x in enumerate(sizes) if x == size]
                unit = _unit([body[i] for i in at], dtype)
                dim = unit.shape[1]
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, signs))
                for i, x in zip(at, sketches(unit, planes[dim]), strict=True):
                    out[i] = x.tobytes()
            yield pa.record_batch([*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "label", "key", "size", "sketch"])

    return run


def _deal(bits: int, tables: int, signs: int):
    """For every (label, size, uid, sketch) one row a table, with the table's signs as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _words(_signs(batch.column(3).to_pylist(), signs), bits, tables)
            again = pa.array(np.repeat(np.arange(batch.num_rows), tables))
            slot = pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows))
            yield pa.record_batch([*[c.take(again) for c in batch.columns], slot, pa.array(words.ravel().astype(np.int32))], names=["label", "size", "uid", "sketch", "slot", "sign"])

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest one reachable by the edges (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _pairs(close: np.ndarray, left: np.ndarray, right: np.ndarray, words: np.ndarray, slot: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that close marks among left and right rows, each once, without those that met in an earlier table."""
    rows, cols = np.nonzero(close)
    i, j = left[rows], right[cols]
    # Where a bucket is met by itself, left and right are the same rows.
    once = i < j if left is right else np.ones(len(i), bool)
    i, j = i[once], j[once]
    fresh = ~(words[i, :slot] == words[j, :slot]).any(axis=1)
    return i[fresh], j[fresh]


def _candidates(bits: int, tables: int, signs: int, bound: int):
    """Of every bucket the vectors that have a partner by their sketches, named by their part of the graph of partners."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "p", "q", "part", "uid"], ignore_index=True)
        name = pdf[["bucket", "p", "q"]].to_numpy(np.int64)
        starts = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]).any(axis=1)])
        out = {"uid": [], "cell": [], "slot": [], "side": []}
        part, slots, uids, packed = pdf.part.to_numpy(), pdf.slot.to_numpy(), pdf.uid.to_numpy(), pdf.sketch.to_numpy()
        for a, b in zip(starts, np.r_[starts[1:], len(pdf)], strict=True):
            if b - a < 2:
                continue
            _, p, q = name[a]
            left = np.arange(b - a) if p == q else np.flatnonzero(part[a:b] == p)
            right = left if p == q else np.flatnonzero(part[a:b] == q)
            if not len(left) or not len(right):
                continue
            flat = _signs(packed[a:b], signs)
            sides = flat.astype(np.float32) * 2 - 1
            i, j = _pairs(sides[left] @ sides[right].T >= signs - 2 * bound, left, right, _words(flat, bits, tables), int(slots[a]))
            if not len(i):
                continue
            root = _roots(b - a, i, j)
            for x in np.unique(np.concatenate([i, j])):
                out["uid"].append(uids[a + x])
                out["cell"].append(hashlib.blake2b(name[a].tobytes() + uids[a + root[x]], digest_size=16).digest())
                out["slot"].append(slots[a])
                out["side"].append(0 if p == q else 1 if part[a + x] == p else 2)
        return pd.DataFrame(out).astype({"slot": np.int32, "side": np.int32})

    return run


def _compare(bits: int, tables: int, signs: int, threshold: float, dtype):
    """Links of the vectors of each cell by their exact cosines: how many a class has, and the smallest id it reaches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby(["cell", "label", "size"], sort=False):
            side = own.side.to_numpy()
            left = np.flatnonzero(side < 2)
            right = left if side[0] == 0 else np.flatnonzero(side == 2)
            if len(own) < 2 or not len(left) or not len(right):
                continue
            unit = _unit(list(own.body), dtype)
            i, j = _pairs(unit[left] @ unit[right].T >= threshold, left, right, _words(_signs(list(own.sketch), signs), bits, tables), int(own.slot.iloc[0]))
            if not len(i):
                continue
            times, ids = own.times.to_numpy(np.float64), own.id.to_numpy()
            links = np.bincount(i, weights=times[j], minlength=len(own)) + np.bincount(j, weights=times[i], minlength=len(own))
            root, hit = _roots(len(own), i, j), links > 0
            smallest = {r: ids[root == r].min() for r in np.unique(root[hit])}
            out.append(pd.DataFrame({"uid": own.uid.to_numpy()[hit], "id": ids[hit], "links": links[hit].astype(np.int64), "root": [smallest[r] for r in root[hit]]}))
        return pd.concat(out) if out else pd.DataFrame({"uid": pd.Series(dtype=object), **{c: pd.Series(dtype=np.int64) for c in ("id", "links", "root")}})

    return run


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, seed: int = 7) -> DataFrame:
    """Links vectors of equal, non-null label whose cosine (in double precision) is at least `threshold`.

    Equal vectors of a label are one class, compared once and counted as often as they occur. Classes fall into
    buckets of equal signature, in as many tables as give a recall of 0.998 at the threshold (more for closer pairs);
    pairs of a bucket whose sketches (all their signs) differ in no more places than all but a millionth of the pairs at
    the threshold do are verified by their cosine, and counted in the first table where they meet. Buckets beyond
    PART classes are compared part against part by several tasks. Ids must be integers.

    Vectors that are null, empty or zero, or hold null or non-finite components, null labels and null ids link
    with nothing. Vectors of different length are not compared. Rows that repeat an id are vectors with
    links of their own but one vertex of the graph. An empty table gives an empty result; other columns are not read.

    One row per row of df: vec_id, n_links (other vectors linked directly), component_id (smallest id
    reachable, itself included), kept (vec_id = component_id).
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    kinds = dict(source.dtypes)
    dtype = np.float32 if kinds["embedding"] == "array<float>" else np.float64
    named = f"vec_id {kinds['vec_id']}, label {kinds['label']}, key binary"
    uid = F.unhex(F.md5(F.concat("key", F.col("label").cast("string").cast("binary")))).alias("uid")
    can = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("key").isNotNull()

    whole = source.mapInArrow(_digest, named + ", body binary").where(can).select(uid, "body")
    n = whole.select("uid").distinct().count()
    bits, tables = plan_tables(n, threshold)
    signs = max(bits * tables, LEAST_SIGNS)
    bound = sketch_bound(signs, threshold)
    rows = cut(source.mapInArrow(_sketch(signs, seed, dtype), named + ", size int, sketch binary").select("vec_id", "label", F.when(can, uid).alias("uid"), "size", "sketch"))
    usable = rows.where("uid is not null")
    firsts = [F.first(c).alias(c) for c in ("label", "size", "sketch")]
    classes = cut(usable.groupBy("uid").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("times"), *firsts))

    dealt = classes.select("label", "size", "uid", "sketch").mapInArrow(_deal(bits, tables, signs), f"label {kinds['label']}, size int, uid binary, sketch binary, slot int, sign int")
    dealt = dealt.select(F.xxhash64("label", "size", "slot", "sign").alias("bucket"), "slot", "uid", "sketch")
    large = cut(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART).select("bucket", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    beyond = F.broadcast(large) if large.count() <= MOST_BROADCAST else large
    groups = max(1, tables * n // (2 * PART), width(spark))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("uid"), "parts")).otherwise(0)
    meets = F.expr("transform(sequence(0, parts - 1), q -> struct(least(part, q) as p, greatest(part, q) as q))")
    task = F.when(F.col("parts") > 1, F.xxhash64("bucket", "m.p", "m.q")).otherwise(F.pmod(F.col("bucket"), F.lit(groups)))
    tasks = (
        dealt.join(beyond, "bucket", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", part.cast("int"))
        .withColumn("m", F.explode(meets))
        .select("bucket", "slot", "uid", "sketch", "part", "m.p", "m.q", task.alias("task"))
    )
    cells = cut(tasks.groupBy("task").applyInPandas(_candidates(bits, tables, signs, bound), "uid binary, cell binary, slot int, side int"))

    few = max(1, cells.count() // PART, width(spark))
    one = whole.groupBy("uid").agg(F.first("body").alias("body"))
    near = cells.join(classes, "uid").join(one, "uid").withColumn("task", F.pmod(F.xxhash64("cell"), F.lit(few)))
    found = cut(near.groupBy("task").applyInPandas(_compare(bits, tables, signs, threshold, dtype), "uid binary, id long, links long, root long"))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    # Rows that share a class are linked with one another through its smallest id.
    inner = usable.select("vec_id", "uid").join(classes.select("uid", "id", "times"), "uid").join(links, "uid", "left")
    inner = cut(inner.select("vec_id", "id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(inner.where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b")))
    component = connected_components(edges.where("a <> b"))
    counted_rows = inner.select("vec_id", "n_links").unionByName(rows.where("uid is null").select("vec_id", F.lit(0).cast("long").alias("n_links")))
    return (
        counted_rows.join(component, F.col("vec_id") == F.col("id"), "left")
        .select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
