"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut
from .flow import cheapest_flow, flow_in_parts
from .names import own_columns, private, quoted

#: Membership patterns whose flow is worked out at once; of more, so many lie in a part. The flow costs the same either way.
MOST_PATTERNS = 100_000


def word_count(text: Column) -> Column:
    """Number of maximal runs of bytes other than 0x20 and 0x09-0x0D (null: 0)."""
    spaces, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    tail = F.regexp_replace(text, f"^{spaces}+", "")
    return F.coalesce(F.length(F.regexp_replace(tail, f"{word}+{spaces}*", "x")), F.lit(0)).cast("long")


def capped_targets(sizes: dict, weights: dict, share: Fraction, most: int) -> dict:
    """Shares of share x all sizes by weight; a share above most x its source's size stops there and the
    excess is dealt again by weight among the others, until none is above."""
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        weight = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / weight > most * sizes[s]} if weight else set()
        if not over:
            out.update({s: left * weights[s] / weight if weight else Fraction(0) for s in open_})
            break
        out.update({s: Fraction(most * sizes[s]) for s in over})
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


@dataclass
class Mix:
    """A mix that is worked out: `apply` says how often each row is taken; targets and sizes by source."""

    source_col: str
    id_col: str
    text_col: str
    seed: int
    plan: DataFrame
    small: bool
    ties: bool
    targets: dict
    sizes: dict

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        """df with the column `out`, a struct of times, source_size and target, by a join with one row per membership pattern."""
        pattern, order, p, plan = (private(df, f"{x}_{out}") for x in ("pattern", "order", "p", "plan"))
        keyed = df.select(*own_columns(df), pattern_of(df, self.source_col).alias(pattern), seeded_order(self.seed, F.col(quoted(self.id_col)), F.col(quoted(self.text_col))).alias(order))
        plans = self.plan.select(F.col("p").alias(p), F.struct("passes", "last", "tied", "some", "source_size", "target").alias(plan))
        joined = keyed.join(F.broadcast(plans) if self.small else plans, F.col(pattern).eqNullSafe(F.col(p)))  # small: at most MOST_PATTERNS rows
        taken = lambda more: F.struct((F.col(f"{plan}.passes") + F.when(more, 1).otherwise(0)).alias("times"), f"{plan}.source_size", f"{plan}.target").alias(out)
        whole = F.coalesce(F.col(order) <= F.col(f"{plan}.last"), F.lit(False))
        if not self.ties:
            return joined.select(*own_columns(df), taken(whole))
        # Rows of one id and text of which only some are taken once more: they are written down with numbers, and counted off
        # within the stretches that the numbers fall into, after the sum of all stretches before.
        tie = F.coalesce(F.col(order) == F.col(f"{plan}.tied"), F.lit(False))
        number, stretch, at, before = (private(df, f"{x}_{out}") for x in ("number", "stretch", "at", "before"))
        tied = cut(joined.where(tie).withColumn(number, F.monotonically_increasing_id())).withColumn(stretch, F.shiftright(number, 33))
        along = Window.partitionBy(p).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
        counts = tied.groupBy(p, stretch).agg(F.count(F.lit(1)).alias(before)).withColumn(before, F.coalesce(F.sum(before).over(along), F.lit(0)))
        counts = counts.select(F.col(p).alias(f"{p}_"), F.col(stretch).alias(f"{stretch}_"), before)
        inside = Window.partitionBy(p, stretch).orderBy(number)
        placed = tied.withColumn(at, F.row_number().over(inside)).join(counts, F.col(p).eqNullSafe(F.col(f"{p}_")) & (F.col(stretch) == F.col(f"{stretch}_")))
        some = placed.select(*own_columns(df), taken(F.col(at) + F.col(before) <= F.col(f"{plan}.some")))
        return joined.where(~tie).select(*own_columns(df), taken(whole)).unionByName(some)


def pattern_of(df: DataFrame, source_col: str) -> Column:
    """The sorted sources of a row as an array; a null source or an empty array is the null source."""
    names, none = F.col(quoted(source_col)), F.array(F.lit(None).cast("string"))
    if df.schema[source_col].dataType.typeName() != "array":
        return F.array(names.cast("string"))
    return F.coalesce(F.when(F.size(names) > 0, F.array_sort(F.array_distinct(names)).cast("array<string>")), none)


def seeded_order(seed: int, id_col: Column, text: Column) -> Column:
    """A pseudo-random rank of a row that depends on its id, its text and the seed."""
    return F.xxhash64(F.lit(seed), id_col, text).bitwiseAND(F.lit((1 << 63) - 1))


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: Fraction = Fraction(3, 2),
    most: int = 2,
    seed: int = 17,
) -> Mix:
    """Works out how many times a mix takes each document so that each source comes near its target.

    source_col holds a source name or an array of names (a document in several sources). Documents are
    summed by membership pattern; the patterns' words are routed to the sources' quotas at least cost,
    where a second pass over a pattern costs more than the first. Each pattern then takes whole passes
    over all its documents and, for the rest, documents in the order of a seeded hash up to the one that
    brings it nearest to the words routed. Of rows that repeat id and text, as many are taken once more as bring it nearest.
    More than MOST_PATTERNS patterns are dealt into parts by their hash and routed by tasks, with paths over all parts in the
    end, so that as many words are sent at the same cost as at once; the driver holds sums by source and part.

    Sources stand in code point order, null last (an empty array counts as null), and weights repeat
    along it. Null or empty texts have size 0 and can be taken with 0 words; very long texts count whole. Rows with equal ids
    and different texts are decided apart; an empty table gives an empty result. The result
    depends on the rows alone, not on their order or partitions. Other columns are not looked at, whatever their names.
    """
    spark = df.sparkSession
    rows = cut(df.select(pattern_of(df, source_col).alias("pattern"), word_count(F.col(quoted(text_col))).alias("size"), seeded_order(seed, F.col(quoted(id_col)), F.col(quoted(text_col))).alias("order")))
    totals = cut(rows.groupBy("pattern").agg(F.sum("size").alias("words")))
    by_code = lambda s: (s is None, (s or "").encode())
    of_source = totals.select(F.explode("pattern").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("words")).collect()  # one row per source
    sizes = {r.source: r.words for r in sorted(of_source, key=lambda r: by_code(r.source))}
    targets = capped_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(sizes)}, share, most)
    at = {s: i for i, s in enumerate(sizes)}
    parts, quota = max(1, -(-totals.count() // MOST_PATTERNS)), [round(targets[s]) for s in sizes]
    if parts == 1:
        own = {tuple(r.pattern): r.words for r in totals.collect()}  # MOST_PATTERNS at most
        patterns = sorted(own, key=lambda p: [by_code(s) for s in p])
        flow = cheapest_flow([own[p] for p in patterns], [[at[s] for s in p] for p in patterns], quota, list(range(most)))
        lines = []
        for i, p in enumerate(patterns):
            passes, rest = divmod(sum(flow[i].values()), own[p]) if own[p] else (0, 0)
            lines.append((list(p), passes, rest, sum(sizes[s] for s in p), float(sum(targets[s] for s in p))))
        plan = spark.createDataFrame(lines, "p array<string>, passes int, rest long, source_size long, target double")
    else:
        of_member = spark.createDataFrame([(i, sizes[s], float(targets[s])) for s, i in at.items()], "i int, size long, target double")
        sent = flow_in_parts(totals, list(sizes), quota, most, parts)
        each = sent.select("p", "words", "sent", F.explode("members").alias("i")).join(F.broadcast(of_member), "i")  # a row a source
        summed = each.groupBy("p", "words", "sent").agg(F.sum("size").alias("source_size"), F.sum("target").alias("target"))
        used = F.when(F.col("words") > 0, F.expr("cast(sent div words as int)")).otherwise(0)
        rest = F.when(F.col("words") > 0, F.col("sent") % F.col("words")).otherwise(0)
        plan = cut(summed.select("p", used.alias("passes"), rest.cast("long").alias("rest"), "source_size", "target"))
    # Where a pattern's cut lies: its documents fall into 1024 ranges of the seeded order, those of the range that holds
    # the cut into 1024 again, and only what is left in that range is ranked, by distinct id and text.
    same, hint = F.col("pattern").eqNullSafe(F.col("p")), F.broadcast if parts == 1 else (lambda x: x)
    cuts, near = plan.where("rest > 0").select("p", F.lit(0).cast("long").alias("low"), F.col("rest").alias("left")), rows
    for shift in (53, 43):
        near = near.join(hint(cuts), same).where(F.shiftright("order", shift + 10) == F.col("low"))  # one row per pattern at most
        along = Window.partitionBy("p").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
        cuts = cut(
            near.groupBy("p", "left", F.shiftright("order", shift).alias("range"))
            .agg(F.sum("size").alias("words"))
            .withColumn("upto", F.sum("words").over(along))
            .where("upto - words < left and upto >= left")
            .select("p", F.col("range").alias("low"), (F.col("left") - F.col("upto") + F.col("words")).alias("left"))
        )
        near = near.select("pattern", "size", "order")
    inside = Window.partitionBy("p").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        near.join(hint(cuts), same)
        .where(F.shiftright("order", 43) == F.col("low"))
        .groupBy("p", "low", "left", "order")
        .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        .withColumn("open", F.col("left") - F.sum("words").over(inside) + F.col("words"))
        .withColumn("some", F.when(F.col("words") > 0, F.floor(F.col("open") * F.col("rows") / F.col("words") + 0.5)).when(F.col("open") >= 0, F.col("rows")).otherwise(0))
        .withColumn("some", F.greatest(F.lit(0), F.least("rows", "some")).cast("long"))
    )
    partial = F.expr("some > 0 and some < rows")
    lasts = (
        ranked.groupBy("p", "low")
        .agg(F.max(F.when(F.col("some") == F.col("rows"), F.col("order"))).alias("whole"), F.max(F.when(partial, F.col("order"))).alias("tied"), F.max(F.when(partial, F.col("some"))).alias("some"))
        .select("p", F.coalesce("whole", F.shiftleft("low", 43) - 1).alias("last"), "tied", "some")
    )
    done = cut(plan.alias("a").join(lasts.alias("b"), F.expr("a.p <=> b.p"), "left").select("a.*", "last", "tied", "some").drop("rest"))
    ties = not done.where("tied is not null").isEmpty()
    return Mix(source_col, id_col, text_col, seed, done, parts == 1, ties, {s: float(t) for s, t in targets.items()}, sizes)


def mixed_sizes(df: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Nulls, ties, repeated rows and empty tables are handled as by `mix_sources`.
    """
    mix = mix_sources(df, **options)
    rows = mix.apply(df.select(*dict.fromkeys((mix.id_col, mix.text_col, mix.source_col))), "_mix")
    size = word_count(F.col(quoted(mix.text_col)))
    return rows.select(F.col(quoted(mix.id_col)).alias("doc_id"), size.alias("size"), F.col("_mix.source_size").alias("source_size"), F.col("_mix.target").alias("target"), (size * F.col("_mix.times")).alias("taken"))


def repeat_documents(df: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of df as many times as the mix takes it, with df's columns, whatever their names.

    Nulls, ties, repeated rows and empty tables are handled as by `mix_sources`.
    """
    mix = private(df, "mix")
    rows = mix_sources(df, **options).apply(df, mix)
    turn = private(df, "turn")
    return rows.select(*own_columns(df), F.explode(F.expr(f"if({mix}.times > 0, sequence(1, {mix}.times), cast(array() as array<int>))")).alias(turn)).drop(turn)
