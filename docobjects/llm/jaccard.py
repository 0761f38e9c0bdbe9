"""N-gram Jaccard self-join by vertical partitioning.

The distinct shingles of all documents lie in one global order, cut into fragments by ranges of their hashes. Each
fragment counts in how many documents each of its shingles stands; a shingle that stands in one document alone can
be in no overlap. What is left of a document is ordered by (document frequency, hash): two documents can
only reach the threshold if they share a shingle of their prefixes in that order (shingles of their own go first), at
places that leave enough shingles behind them. Every such pair is verified in one way: its overlap is counted in each
fragment apart, and the partial overlaps are summed per pair.

A large group of copies is not expanded into all its pairs. Stars come first: of each list one document is verified with all
others that no link has yet joined to it, so that pairs are no more than places, and links go to few documents. Only pairs of
different components that still meet anywhere are verified then, as long as there are many one for each two components first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ..lineage import cut, steady, width
from .components import connected_components
from .kernels import U64, Tokens, blocks, gaps, home_key, mix, narrow, pack, release, shingles, text_bytes, unpack
from .names import own_columns, private

#: Bytes of text in a block, and in the slices it is tokenised in.
BLOCK, SLICE = 16 << 20, 2 << 20
#: Bits of a shingle's hash: two different shingles of a pair of documents with 1000 shingles each agree with probability 2**-36.
BITS = 56
#: Bits of a shingle's hash that say in which fragment its overlaps are counted.
FRAGMENT_BITS = 3
#: Pairs for each document that are left to be verified at once; if there are more, one for each two components comes first.
PAIRS = 0.05
#: Stars over all places end when they find less links for each document.
STARS = 0.05
#: Vertices of a task: few vertices lie in few partitions, so that a turn leaves few files behind.
VERTICES = 500
#: Places of a document's prefix whose lists have the first stars.
STAR_PLACES = 3

ROWS = pa.schema([("key", pa.int32()), ("block", pa.string()), ("kind", pa.int32()), ("body", pa.binary())])
ROWS_DDL = "key int, block string, kind int, body binary"


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), ROWS, strict=True)] if rows else [pa.array([], t.type) for t in ROWS], schema=ROWS)


def _set_digest(doc: np.ndarray, value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128-bit digest of each document's shingle set, as pairs of uint64."""
    out = np.zeros((len(n), 2), dtype=U64)
    some = n > 0
    starts = (np.cumsum(n) - n)[some]
    if len(starts):
        for i, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
            out[some, i] = mix(np.add.reduceat(mix(value ^ U64(salt)), starts) + n[some].astype(U64))
    return out


def _deal(keys: int, words: int):
    """Blocks of documents: to each fragment its shingles with the documents they stand in; the documents' own figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                docs, values, sizes, at = [], [], [], 0
                for part in blocks(block, "text", SLICE):
                    d, v = shingles(Tokens(*text_bytes(part.column(1))), words)
                    docs.append((d + at).astype(np.int32)), values.append(v), sizes.append(np.bincount(d, minlength=part.num_rows))
                    at += part.num_rows
                doc, value, n = np.concatenate(docs), np.concatenate(values), np.concatenate(sizes)
                digest = _set_digest(doc, value, n)
                value = value >> U64(64 - BITS)
                order = np.argsort(value, kind="stable")
                value, doc = value[order], doc[order]
                name = f"{TaskContext.get().partitionId()}.{number}"
                number += 1
                edges = np.searchsorted(((value >> U64(BITS - 32)) * U64(keys)) >> U64(32), np.arange(keys + 1))
                rows = [(k, name, 0, pack(gaps(value[i:j]), narrow(doc[i:j]))) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
                ids = block.column(0)
                valid, plain = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)).astype(np.int64)
                mark = np.asarray(block.column(2)).astype(np.int64)
                rows.append((home_key(name, keys), name, 1, pack(plain, valid.astype(np.uint8), narrow(n), digest[:, 0].copy(), digest[:, 1].copy(), mark)))
                yield from _rows(rows).to_batches()

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """A fragment: document frequencies of its shingles; tells each block about those that stand in several documents."""
    release()
    rows, asks = [], []
    for key, block, kind, body in zip(*(table.column(c).to_pylist() for c in ROWS.names), strict=True):
        if kind == 1:
            rows.append((key, block, kind, body))
        else:
            gap, doc = unpack(body)
            asks.append((key, block, np.cumsum(gap), doc))
    if asks:
        _, at, count = np.unique(np.concatenate([a[2] for a in asks]), return_inverse=True, return_counts=True)
        often, edge = count[at], np.cumsum([0, *(len(a[2]) for a in asks)])
        for i, (key, block, value, doc) in enumerate(asks):
            own = often[edge[i] : edge[i + 1]]
            if (own > 1).any():
                rows.append((key, block, 0, pack(gaps(value[own > 1]), doc[own > 1], narrow(own[own > 1]))))
    return _rows(rows)


#: Words of 64 bits in the map of a prefix, and in that of all shared shingles.
MAP, SKETCH = 4, 16
DOCS_DDL = "doc_id long, mark long, n long, class binary, prefix array<long>, parts array<array<long>>, " + ", ".join(f"m{k} long" for k in range(MAP)) + ", sketch array<long>"


def _prefixes(percent: int):
    """A block's documents: size, digest of the set, and, if it can reach the threshold at all, the shared part of its prefix in
    the global order and its shared shingles by fragment."""
    fragments = 1 << FRAGMENT_BITS

    def run(table: pa.Table) -> pa.Table:
        release()
        head, parts = None, []
        for kind, body in zip(table.column("kind").to_pylist(), table.column("body").to_pylist(), strict=True):
            if kind == 1:
                head = unpack(body)
            else:
                gap, doc, often = unpack(body)
                parts.append((np.cumsum(gap), doc.astype(np.int64), often.astype(np.int64)))
        ids, valid, n, d0, d1, mark = head
        n = n.astype(np.int64)
        value, doc, often = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        value = value.astype(np.int64)
        shared = np.bincount(doc, minlength=len(n))
        need = -(-percent * n // 100)
        prefix = np.clip(n - need + 1 - (n - shared), 0, shared)
        order = np.lexsort((value, often, doc))
        rank = np.arange(len(doc)) - (np.cumsum(shared) - shared)[doc[order]]
        first = order[rank < prefix[doc[order]]]
        live = np.flatnonzero((prefix > 0)[doc])
        live = live[np.lexsort((value[live], doc[live]))]
        cell = doc[live] * fragments + (value[live] >> (BITS - FRAGMENT_BITS))
        edges = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        inner = pa.ListArray.from_arrays(edges(np.bincount(cell, minlength=len(n) * fragments).reshape(len(n), fragments)[prefix > 0].reshape(-1)), pa.array(value[live]))
        digest = np.stack([d0, d1], axis=1)

        def bits(of: np.ndarray, words: int) -> np.ndarray:
            out = np.zeros((len(n), words), dtype=np.int64)
            np.bitwise_or.at(out, (doc[of], value[of] % words), np.int64(1) << (value[of] // words % 64))
            return out

        maps, sketch = bits(first, MAP), bits(live, SKETCH)
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=valid == 0),
                "mark": pa.array(mark),
                "n": pa.array(n),
                "class": pa.array([x.tobytes() if k else None for x, k in zip(digest, n, strict=True)], pa.binary()),
                "prefix": pa.ListArray.from_arrays(edges(np.bincount(doc[first], minlength=len(n))), pa.array(value[first])),
                "parts": pa.ListArray.from_arrays(edges(np.where(prefix > 0, fragments, 0)), inner),
                **{f"m{k}": pa.array(maps[:, k].copy()) for k in range(MAP)},
                "sketch": pa.ListArray.from_arrays(edges(np.where(prefix > 0, SKETCH, 0)), pa.array(sketch[prefix > 0].reshape(-1))),
            }
        )

    return run


#: What is known of a document at each place of its prefix: size, shingles of the prefix that others have too, its map.
FACTS = ["c", "n", "p", *[f"m{k}" for k in range(MAP)]]


def _reach(percent: int) -> Column:
    """Whether x and y can reach the threshold by sizes and prefixes.

    One prefix ends first: up to there, all that is common stands in both prefixes (each bit that one map has and the other
    lacks is a shingle that is not), and behind it less than its document's `percent` share is left.
    """
    apart = lambda a, b: " + ".join(f"bit_count({a}.m{k} & ~{b}.m{k})" for k in range(MAP))
    common = F.expr(f"least(x.p - ({apart('x', 'y')}), y.p - ({apart('y', 'x')}))")
    behind = F.floor((percent * F.greatest("x.n", "y.n") + 99) / 100) - 1
    return (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & ((100 + percent) * (common + behind) >= percent * (F.col("x.n") + F.col("y.n")))


def _reach_from(percent: int) -> Column:
    """Whether x and y can reach the threshold if x.place and y.place are their first common shingle: all others stand behind."""
    return (100 + percent) * F.expr("least(x.n - x.place, y.n - y.place)") >= percent * (F.col("x.n") + F.col("y.n"))


def count_overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """pairs (a, b, and others) with `common`, the size of their overlap.

    parts: c, f, part (the shingles of c in fragment f). Each fragment counts its part of the overlap; parts are summed per pair.
    """
    left = pairs.join(parts.select(F.col("c").alias("a"), "f", F.col("part").alias("left")), "a")
    both = left.join(parts.select(F.col("c").alias("b"), "f", F.col("part").alias("right")), ["b", "f"])
    partial = both.withColumn("part", F.size(F.array_intersect("left", "right")))
    return partial.groupBy(*pairs.columns).agg(F.sum("part").alias("common"))


def _sketched(percent: int) -> Column:
    """Whether x and y can reach the threshold by their sketches: a bit of one that the other lacks is a shingle that is not common."""
    apart = lambda a, b: f"aggregate(zip_with({a}.sketch, {b}.sketch, (p, q) -> bit_count(p & ~q)), 0, (t, k) -> t + k)"
    most = F.expr(f"least(x.shared - {apart('x', 'y')}, y.shared - {apart('y', 'x')})")
    return (100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n"))


def _few(df: DataFrame, vertices: DataFrame) -> DataFrame:
    """df written down in no more partitions than the vertices have."""
    return cut(df.coalesce(vertices.rdd.getNumPartitions()))


def _verified(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, na, nb) those that reach the threshold."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    parts = vertices.select("c", "parts").join(needed, "c", "left_semi").select("c", F.posexplode("parts").alias("f", "part")).where(F.size("part") > 0)
    return count_overlaps(pairs, parts).where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _links(vertices: DataFrame, n: int, percent: int) -> DataFrame:
    """Components of the n vertices (c, n, prefix, parts) under all linked pairs: (a, b), b the smallest of a's component, a others of it."""
    prefixes = vertices.withColumn("p", F.size("prefix")).select(*FACTS, (F.col("n") - F.col("shared")).alias("lone"), F.transform("prefix", lambda s, i: F.struct((i + 0).alias("i"), s.alias("shingle"))).alias("prefix"))
    facts = [*FACTS, "shared", "sketch", "place", "component"]
    joined = None

    def of_components(rows: DataFrame) -> DataFrame:
        """Rows (c, and others) with the components so far."""
        if joined is None:
            return rows.withColumn("component", F.col("c"))
        return rows.join(joined.select(F.col("a").alias("c"), F.col("b").alias("component")), "c", "left").withColumn("component", F.coalesce("component", "c"))

    def of_sides(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, and others) with the components of both."""
        for x in "ab":
            pairs = of_components(pairs.withColumnRenamed(x, "c")).withColumnsRenamed({"c": x, "component": f"of_{x}"})
        return pairs

    def open_lists(now: DataFrame) -> DataFrame:
        """Places of shingles that stand in several components, with the one that most of the shingle's places are in as `main`."""
        sizes = now.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle")
        open_ = sizes.agg(F.max(F.struct("k", "component")).alias("most"), F.count(F.lit(1)).alias("several")).where("several > 1")
        return now.join(open_.select("shingle", F.col("most.component").alias("main")), "shingle")

    def placed(own: DataFrame) -> DataFrame:
        own = own.select(*FACTS, "lone", F.explode("prefix").alias("x")).select(*FACTS, "lone", "x.shingle", (F.col("lone") + F.col("x.i")).alias("place"))
        return _few(open_lists(of_components(own)).join(vertices.select("c", "shared", "sketch"), "c"), vertices)

    def compared(some: DataFrame, others: DataFrame, which: Column) -> DataFrame:
        """Pairs of different components that meet on a place and can reach the threshold by all that is known without a count."""
        apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component"))
        met = some.alias("x").join(others.alias("y"), apart & which & _reach(percent) & _sketched(percent))
        low, high = (f(F.struct("x.c", "x.n"), F.struct("y.c", "y.n")) for f in (F.least, F.greatest))
        return _few(met.select(low["c"].alias("a"), high["c"].alias("b"), low["n"].alias("na"), high["n"].alias("nb")).distinct(), vertices)

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs that are written down those that reach the threshold; none are not looked up."""
        return pairs.select("a", "b") if pairs.isEmpty() else _few(_verified(pairs, vertices, percent), vertices)

    def star(now: DataFrame, some: DataFrame, heads: DataFrame, rank: Column) -> DataFrame:
        """Links of some places with the head of their list, the document of least rank, whether or not they met before."""
        heads = heads.groupBy("shingle").agg(F.min(F.struct(rank.alias("rank"), *facts)).alias("h")).select("shingle", "h.*")
        return linked(compared(some, heads, F.lit(True)))

    def with_found(found: DataFrame) -> DataFrame:
        """Components as stars: those so far, joined by what was found."""
        edges = found if joined is None else joined.unionByName(found)
        return _few(connected_components(edges).where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")), vertices)

    # Documents that share much of their prefixes are likely to share the shingles of least hash.
    order = F.transform("prefix", lambda x: F.struct(F.xxhash64(x["shingle"]).alias("h"), x["i"].alias("i"), x["shingle"].alias("shingle")))
    now = placed(prefixes.withColumn("prefix", F.slice(F.array_sort(order), 1, STAR_PLACES)))
    # The first stars stand around the documents with the fewest shingles of their own, the next ones around any of the list's main component.
    joined = with_found(star(now, now, now, F.col("lone")))
    now, turn = placed(prefixes), 1
    main = F.col("component") == F.col("main")
    while True:
        found = star(now, now.where(~main), now.where(main), F.xxhash64("c", F.lit(turn)))
        few = found.count()
        if few:
            joined, turn = with_found(found), turn + 1
            now = _few(open_lists(of_components(now.drop("component", "main"))), vertices)
        if few <= STARS * n:
            break
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.c") < F.col("y.c"))
    pairs = compared(now.where(~main), now, once & _reach_from(percent))
    left, before = pairs.count(), None
    while left > PAIRS * n and (before is None or 2 * left < before):
        one = of_sides(pairs).groupBy(F.least("of_a", "of_b"), F.greatest("of_a", "of_b")).agg(F.min(F.struct(*pairs.columns)).alias("x"))
        one = _few(one.select("x.*"), vertices)
        joined = with_found(linked(one))
        apart = of_sides(pairs).where("of_a <> of_b").select(*pairs.columns)
        pairs = _few(apart.join(one.select("a", "b"), ["a", "b"], "left_anti"), vertices)
        left, before = pairs.count(), left
    return with_found(linked(pairs)) if left else joined


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """docs (doc_id, text, mark) as rows (doc_id, mark, n, group, own): rows of equal group and own, n > 0, are a component."""
    keys = 8 * width(docs.sparkSession)
    dealt = steady(docs).mapInArrow(_deal(keys, words), ROWS_DDL)
    counted = dealt.groupBy("key").applyInArrow(_frequencies, ROWS_DDL)
    sets = cut(counted.groupBy("block").applyInArrow(_prefixes(percent), DOCS_DDL))
    # One vertex for each class that can link; its number holds since it is written down.
    alive = sets.where(F.size("prefix") > 0).groupBy("class").agg(F.first(F.struct("n", "prefix", "parts", *[f"m{k}" for k in range(MAP)], "sketch")).alias("x"))
    shared = F.expr("aggregate(x.parts, 0L, (t, p) -> t + size(p))")
    vertices = cut(alive.select(F.monotonically_increasing_id().alias("c"), "class", "x.*", shared.alias("shared")))
    n = vertices.count()
    vertices = vertices.coalesce(n // VERTICES + 1)
    joined = _links(vertices, n, percent)
    of_class = vertices.select("class", "c").join(joined, F.col("c") == F.col("a"), "left").select("class", F.coalesce("b", "c").alias("group"))
    # Documents of equal sets share a group; a class without vertex is a group of its own.
    rows = sets.select("doc_id", "mark", "n", "class").join(of_class, "class", "left").select("doc_id", "mark", "n", "class", "group")
    return cut(rows.withColumn("own", F.when(F.col("group").isNull(), F.col("class"))).drop("class"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Links documents whose sets of distinct word shingles have a Jaccard similarity of at least percent/100.

    Words are maximal runs of bytes other than space and 0x09-0x0D, A-Z in lower case. A text with fewer than
    `words` words has its whole sequence as one shingle; a null or empty text, or one without words, has none and
    links with nothing. Ids must be integers. Documents of equal sets are one class from the start.

    Every linked pair of classes is either found and verified, or lies within one component that verified links
    already hold together; no list of documents, however large, is capped or skipped. Rows that repeat an id are documents of
    their own, with the component of their own set; a null id takes part but is nobody's component_id (a component
    without other ids has null). Very long texts are blocks of their own. An empty table gives an empty result; other columns
    are not read, whatever their names.

    One row per row of df: doc_id, n_shingles, component_id (smallest id reachable by links, itself included).
    """
    rows = _grouped(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("mark")), words, percent)
    smallest = rows.where("n > 0").groupBy("group", "own").agg(F.min("doc_id").alias("component_id")).select(F.col("group").alias("g"), F.col("own").alias("o"), "component_id")
    placed = rows.where("n > 0").join(smallest, F.col("group").eqNullSafe(F.col("g")) & F.col("own").eqNullSafe(F.col("o")))
    lone = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(lone.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def one_of_each_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df, with all their columns, that stand for their group.

    Of each component one row stays: the one with the smallest id (null after all others) and, where an id has several texts,
    the least hash of the text; rows that repeat both id and text are one row, the one with the least hash of its
    columns. Documents without words are in no group and stay all. Nothing else goes, whichever ids repeat. Very long texts,
    empty tables and columns of any name are handled as by `jaccard_components`.
    """
    text_hash = F.xxhash64(F.col(text_col))
    rows = _grouped(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash.alias("mark")), words, percent)
    of_text = rows.where("n > 0").groupBy("group", "own", "doc_id", "mark").agg(F.count(F.lit(1)).alias("times"))
    chosen = of_text.groupBy("group", "own").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "times")).alias("x"))
    key, mark, times = (private(df, x) for x in ("id", "mark", "times"))
    stay = chosen.select(F.col("x.doc_id").alias(key), F.col("x.mark").alias(mark), F.col("x.times").alias(times))
    wordless = rows.where("n = 0").select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.lit(0).cast("long").alias(times)).distinct()
    kept = df.join(stay.unionByName(wordless), F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (text_hash == F.col(mark)))
    once = kept.where(F.col(times) < 2).select(*own_columns(df))
    of_row = F.xxhash64(*[F.to_json(F.struct(c)) for c in own_columns(df)])
    several = kept.where(F.col(times) > 1).groupBy(key, mark).agg(F.min_by(F.struct(*own_columns(df)), of_row).alias(times))
    return once.unionByName(several.select(f"{times}.*"))
