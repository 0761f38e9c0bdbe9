"""Free names for a whole batch of outputs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import global_positions

#: A name with a number before its extension, as free names are made.
NUMBERED = r"^(.*) \(([2-9]|[1-9][0-9]{1,8})\)(\.[^.]*)?$"


def free_names(wanted: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """wanted with final: a name that nothing else has, for every row.

    wanted: candidate and the columns of `order`; existing: name. Rows of a candidate get, in order, the candidate itself and
    then ' (2)', ' (3)', ... before its extension; what exists already is passed over, and so is any numbered name that some row has
    as its candidate. The k-th row takes the k-th number that is free: among the rows of a candidate and the numbers taken of
    it, each taken number t with f = t - (taken numbers up to t) free ones below it, sorted by k and f, a row's place is its number.
    So numbers are found by sorting alone, without trying one after another, and a candidate that most rows share is dealt to
    many tasks.

    Null candidates have null as their final name; an empty batch gives no rows; rows that are equal in `order` get their
    numbers in any order. Columns of wanted are kept.
    """
    by, n = ["candidate"], F.col("number")
    named = wanted.where("candidate is not null")
    candidates = named.select("candidate").distinct()
    taken_names = existing.where("name is not null").select("name").distinct()
    # What is taken of each candidate: the name itself is its number 1.
    itself = taken_names.select(F.col("name").alias("candidate"), F.lit(1).cast("long").alias("number"))
    used = taken_names.unionByName(candidates.select(F.col("candidate").alias("name"))).distinct()
    part = lambda i: F.regexp_extract("name", NUMBERED, i)
    numbered = used.where(F.col("name").rlike(NUMBERED)).select(F.concat(part(1), part(3)).alias("candidate"), part(2).cast("long").alias("number"))
    taken = itself.unionByName(numbered).distinct().join(candidates, "candidate", "left_semi")
    below = global_positions(taken, [n.asc()], by, "rank").select("candidate", (n - F.col("rank")).alias("at"), F.lit(False).alias("row"))
    ranked = global_positions(named.withColumn("_id", F.struct(*order)), [F.col("_id").asc()], by, "at").withColumn("row", F.lit(True))
    # A number taken goes before the rows that have more free ones below them.
    both = ranked.unionByName(below, allowMissingColumns=True)
    placed = global_positions(both, [F.col("at").asc(), F.col("row").desc()], by, "_number").where("row")
    stem, ending = F.regexp_extract("candidate", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("candidate", r"^(.*?)(\.[^.]*)?$", 2)
    final = F.when(F.col("_number") == 1, F.col("candidate")).otherwise(F.concat(stem, F.lit(" ("), F.col("_number").cast("string"), F.lit(")"), ending))
    out = placed.withColumn("final", final).select(*wanted.columns, "final")
    return out.unionByName(wanted.where("candidate is null").withColumn("final", F.lit(None).cast("string")))
