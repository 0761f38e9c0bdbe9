"""Filter interaction audit: what every filter removes in every order, from one count of failure masks per part."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Null ids match no label; they are spread over so many keys of the join.
NULL_KEYS = 256
WORD_BREAK = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


def document_filters() -> dict[str, Column]:
    """The row-local filters by name, as conditions of failure over the columns text and words."""
    text, words = F.col("text"), F.col("words")
    n_words = F.size(words).cast("long")
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n_words,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask and how many documents (n), good and toxic ones have that mask in that part.

    Bit i of a mask says that filter i fails; the bit after the last filter says that a smaller id has the same text
    anywhere in the table. Equal texts have equal SHA-256 digests. Rows are aggregated by id and text first, so that neither a
    text nor a part that holds most rows gathers in one task.
    """
    failed = sum((F.when(how, 1 << i).otherwise(0) for i, how in enumerate(filters.values())), F.lit(0))
    rows = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("words", F.filter(F.split("text", WORD_BREAK), lambda w: w != ""))
        .select("id", "part", failed.alias("mask"), F.unhex(F.sha2("text", 256)).alias("key"))
        .withColumn("spread", F.when(F.col("id").isNull(), F.pmod(F.hash("key"), F.lit(NULL_KEYS))).otherwise(0))
    )
    true = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(true("quality").alias("good"), true("toxic").alias("toxic")).withColumn("spread", F.lit(0))
    labelled = rows.join(known, ["id", "spread"], "left").fillna(0, ["good", "toxic"])
    per_id = labelled.groupBy("id", "spread", "key", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    known_id = F.col("id").isNotNull()
    per_text = cut(
        per_id.groupBy("key", "part", "mask", "good", "toxic").agg(
            F.sum("n").alias("n"),
            F.sum(F.when(known_id, F.col("n")).otherwise(0)).alias("n_ids"),
            F.min(F.when(known_id, F.struct("id", "n"))).alias("first"),
        )
    )
    firsts = per_text.groupBy("key").agg(F.min("first.id").alias("first_id"))
    copies = F.col("n_ids") - F.when(F.col("first.id") == F.col("first_id"), F.col("first.n")).otherwise(0)
    own, copy = F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), F.col("copies").alias("n"))
    halves = per_text.join(firsts, "key").withColumn("copies", copies).select("part", "good", "toxic", F.explode(F.array(own, copy)).alias("x"))
    return halves.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic")
    )


def _with_subsets_lacking(bit: int):
    """A step of the transform: what a cell has, and what the cell without `bit` has if the cell's set holds it."""

    def add(x: Column, i: Column) -> Column:
        less = F.col("cells")[i - F.lit(bit)]
        return F.when(i.bitwiseAND(F.lit(bit)) != 0, F.struct(*[(x[c] + less[c]).alias(c) for c in COUNTS])).otherwise(x)

    return add


def survivors(masks: DataFrame, n_filters: int) -> DataFrame:
    """part and cells: at position T the counts of the documents whose mask is a subset of T.

    The subset-zeta transform: one pass a filter over an array of 2**n_filters cells, one row a part. What survives
    a set S of filters stands in the cell of all other filters.
    """
    size = 1 << n_filters
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    by_mask = F.map_from_entries(F.collect_list(F.struct(F.col("mask").cast("int"), F.struct(*COUNTS))))  # 2**n_filters entries at most
    out = masks.groupBy("part").agg(by_mask.alias("m")).select("part", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i], zero)).alias("cells"))
    for b in range(n_filters):
        out = out.withColumn("cells", F.transform("cells", _with_subsets_lacking(1 << b)))
    return out


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each filter does at each step of every order of the filters, in each part of the table.

    filters: conditions of failure by one-letter name, over text (null: empty) and words (maximal runs of bytes other than white
    space); document_filters() unless given. `copies` names the filter that a document fails whose text a smaller id has too.

    A null part counts as the part ''. A null id is neither smaller than another nor a copy, and has no labels. Rows that
    repeat an id are documents of their own, and no copies of one another; ids with several labels count as good (toxic)
    if one of them says 1; labels of other values or none say nothing. An empty table gives no rows. Other columns are not read.

    One row per part, order and step: part, filter_order, step (from 1; its filter is that letter of the order), and as longs
    kept, removed, redundant (failing, removed before), unique_fails (failing nothing else), good_lost, toxic_lost, shapley (the
    filter's removed, summed over all orders).
    """
    filters = document_filters() if filters is None else filters
    names = [*filters, copies]
    if any(len(x) != 1 or not x.isalnum() for x in names) or len(set(names)) < len(names):
        raise ValueError("filters need different names of one letter or digit")
    n, everything = len(names), (1 << len(names)) - 1
    cells = survivors(failure_masks(docs, labels, filters, id_col, text_col, part_col), n)
    left = lambda s: f"cells[{everything} - {s}]"

    def shapley(bit: int) -> str:
        weight = lambda s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())
        return " + ".join(f"{weight(s)} * ({left(s)}.n - {left(s | bit)}.n)" for s in range(everything + 1) if not s & bit)

    shares = cells.withColumn("shapley", F.expr(f"array({', '.join(shapley(1 << i) for i in range(n))})"))
    orders = shares.withColumn("filter_order", F.explode(F.split(F.lit(",".join("".join(p) for p in permutations(names))), ",")))
    place = f"instr('{''.join(names)}', substring(filter_order, i, 1))"
    steps = (
        orders.withColumn("letters", F.expr(f"transform(sequence(1, {n}), i -> {place})"))
        .select("part", "filter_order", "cells", "shapley", "letters", F.posexplode("letters").alias("before", "at"))
        .withColumns({"bit": F.expr("shiftleft(1, at - 1)"), "gone": F.expr("aggregate(slice(letters, 1, before), 0, (s, x) -> s + shiftleft(1, x - 1))")})
    )
    now, then, fails = left("(gone + bit)"), left("gone"), f"({left(0)}.n - {left('bit')}.n)"
    return steps.selectExpr(
        "part",
        "filter_order",
        "cast(before + 1 as int) as step",
        f"{now}.n as kept",
        f"{then}.n - {now}.n as removed",
        f"{fails} - ({then}.n - {now}.n) as redundant",
        "cells[bit].n - cells[0].n as unique_fails",
        f"{then}.good - {now}.good as good_lost",
        f"{then}.toxic - {now}.toxic as toxic_lost",
        "element_at(shapley, at) as shapley",
    )
