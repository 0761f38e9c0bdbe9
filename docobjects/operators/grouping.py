"""Groups of equal objects within and across files, their numbering and formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_hash, readable_count
from ..lineage import cut, width
from ..schema import KIND_LABELS, KIND_PREFIXES, TEXT


def kind_name(kind: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), kind.cast("int") + 1)


def repeated_texts(showings: DataFrame, file_col: str = "doc_id", least: int = 2) -> DataFrame:
    """Readable texts shown at least `least` times in a file: file, value, usage_count, first_page, last_page, page_count."""
    readable = showings.where(readable_count(F.col("value")) >= 1)
    grouped = readable.groupBy(file_col, "value").agg(
        F.count(F.lit(1)).alias("usage_count"),
        F.min("page_number").alias("first_page"),
        F.max("page_number").alias("last_page"),
        F.count_distinct("page_number").alias("page_count"),
    )
    return grouped.where(F.col("usage_count") >= least)


def object_groups(placements: DataFrame) -> DataFrame:
    """One row per file, kind and identity: usage_count, page_count, pages (sorted, distinct), is_safe, unsafe_reason, first values.

    first_x, first_y come from the placement with the least (seq, x, y); a group is safe if all its placements are, and
    carries the reason of its first unsafe one. is_safe and unsafe_reason may be missing from the input.
    """
    safe = F.col("is_safe") if "is_safe" in placements.columns else F.lit(True)
    reason = F.col("unsafe_reason") if "unsafe_reason" in placements.columns else F.lit(None).cast("string")
    first = F.min(F.struct("seq", "x", "y"))
    return (
        placements.groupBy("file_id", "kind", "identity")
        .agg(
            F.count(F.lit(1)).alias("usage_count"),
            F.array_sort(F.collect_set("page_number")).alias("pages"),
            F.bool_and(safe).alias("is_safe"),
            F.min(F.when(~safe, F.struct("seq", reason.alias("reason"))))["reason"].alias("unsafe_reason"),
            first.alias("f"),
        )
        .select("file_id", "kind", "identity", "usage_count", F.size("pages").cast("long").alias("page_count"), "pages", "is_safe", "unsafe_reason", F.col("f.seq").alias("first_seq"), F.col("f.x").alias("first_x"), F.col("f.y").alias("first_y"))
    )


def merge_files(groups: DataFrame, by: list[str], file_col: str) -> DataFrame:
    """Per-file groups merged across files: usage_count, file_count and, where the groups have them, the sum of
    estimated_bytes, is_safe (of all), full_page (of any) and the thumbnail of the first file that has one."""
    more = {
        "estimated_bytes": F.sum("estimated_bytes"),
        "is_safe": F.bool_and("is_safe"),
        "full_page": F.bool_or("full_page"),
        "thumbnail": F.min_by("thumbnail", F.when(F.col("thumbnail").isNotNull(), F.col(file_col))),
    }
    return groups.groupBy(*by).agg(
        F.sum("usage_count").alias("usage_count"), F.count_distinct(file_col).alias("file_count"), *[how.alias(c) for c, how in more.items() if c in groups.columns]
    )


def first_thumbnails(placements: DataFrame, thumbnails: DataFrame, by: list[str], hash_col: str = "identity") -> DataFrame:
    """by and the thumbnail of a group's first placement (by seq) that has one; null where no placement has.

    thumbnails: hash and thumbnail, one row per hash.
    """
    seen = placements.join(thumbnails.select(F.col("hash").alias(hash_col), "thumbnail"), hash_col, "left")
    return seen.groupBy(*by).agg(F.min_by("thumbnail", F.when(F.col("thumbnail").isNotNull(), F.col("seq"))).alias("thumbnail"))


def group_facts(placements: DataFrame, thumbnails: DataFrame, by: list[str], object_key: list[str], hash_col: str = "identity") -> DataFrame:
    """What merge_files merges, from one pass over the placements: by, usage_count, is_safe, full_page, estimated_bytes, thumbnail.

    placements: by, object_key (the stored object within a group), seq, is_safe, full_page, n_bytes and the hash of the picture;
    thumbnails: hash and thumbnail, one row per hash. The same as object_groups, estimated_sizes (of the greatest n_bytes of each
    stored object) and first_thumbnails side by side; of equal seq the least thumbnail counts.
    """
    seen = placements.join(thumbnails.select(F.col("hash").alias(hash_col), "thumbnail"), hash_col, "left")
    stored = seen.groupBy(*by, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(object_key)]).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and("is_safe").alias("_safe"),
        F.bool_or("full_page").alias("_full"),
        F.max("n_bytes").alias("_bytes"),
        F.min(F.when(F.col("thumbnail").isNotNull(), F.struct("seq", "thumbnail"))).alias("_first"),
    )
    return stored.groupBy(*by).agg(
        F.sum("_n").alias("usage_count"),
        F.bool_and("_safe").alias("is_safe"),
        F.bool_or("_full").alias("full_page"),
        F.sum("_bytes").alias("estimated_bytes"),
        F.min("_first")["thumbnail"].alias("thumbnail"),
    )


def occurrences(placements: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Every showing of a group as a row, numbered in order over all files: what a list of occurrences would hold, without
    gathering it in one place, so that a group shown everywhere is no hot key."""
    return global_positions(placements, [F.col(c).asc() for c in order], by, "occurrence_no")


def text_groups(showings: DataFrame) -> DataFrame:
    """Repeated texts of all files, merged by value: kind, hash, value, usage_count, file_count."""
    merged = merge_files(repeated_texts(showings), ["value"], "doc_id")
    return merged.select(F.lit(1).alias("kind"), content_hash(F.col("value"), "TEXT:").alias("hash"), "value", "usage_count", "file_count")


def number_within_file(groups: DataFrame, key: str = "identity") -> DataFrame:
    """object_id by file and kind: prefix and a counter of three digits at least, most used first."""
    order = Window.partitionBy("file_id", "kind").orderBy(F.desc("usage_count"), key)
    return groups.withColumn("object_id", F.format_string("%s_%03d", kind_name(F.col("kind"), KIND_PREFIXES), F.row_number().over(order)))


def global_positions(rows: DataFrame, order: list[Column], by: list[str] | None = None, out: str = "position") -> DataFrame:
    """rows with their position (from 1) in one global order, or in that of each value of `by` (which comes first in it).

    The rows are dealt to ranges of the order and numbered inside each; one count per range (and value) is summed up over
    the ranges, so neither the whole table nor one value of `by` has to pass through a single task.
    """
    by = by or []
    full = [F.col(c).asc() for c in by] + order
    ranged = cut(rows.repartitionByRange(2 * width(rows.sparkSession), *full).withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_part", *[F.col(c).alias(f"_{c}") for c in by], F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_part", *by).orderBy(*full)
    same = " and ".join(["g._part = c._part", *[f"g.{c} <=> c._{c}" for c in by]])
    numbered = ranged.withColumn("_row", F.row_number().over(inside)).alias("g")
    # A row per range, small; with `by` a row per range and value, which the planner may broadcast if it is small.
    counts = counts.alias("c") if by else F.broadcast(counts.alias("c"))
    joined = numbered.join(counts, F.expr(same))
    return joined.select(*[F.col(f"g.{c}") for c in rows.columns], (F.col("_row") + F.col("_ahead")).cast("long").alias(out))


def number_corpus(groups: DataFrame, key: str = "hash") -> DataFrame:
    """number and object_id by kind over the whole corpus: most used first, ties by key."""
    numbered = global_positions(groups, [F.col("usage_count").desc(), F.col(key).asc()], ["kind"], "number")
    return numbered.withColumn("object_id", F.format_string("%s_%03d", kind_name(F.col("kind"), KIND_PREFIXES), F.col("number")))


def page_runs(pages: DataFrame, by: list[str], page: str = "page_number", out: str = "page_ranges") -> DataFrame:
    """Distinct pages as text: runs of three and more as a〜b, others one by one, joined by ', '."""
    distinct = pages.select(*by, F.col(page).cast("long").alias("_p")).distinct()
    island = F.col("_p") - F.row_number().over(Window.partitionBy(*by).orderBy("_p"))
    runs = distinct.withColumn("_i", island).groupBy(*by, "_i").agg(F.min("_p").alias("_a"), F.max("_p").alias("_b"))
    a, b = F.col("_a").cast("string"), F.col("_b").cast("string")
    text = F.when(F.col("_b") - F.col("_a") >= 2, F.concat(a, F.lit("〜"), b)).when(F.col("_b") > F.col("_a"), F.concat(a, F.lit(", "), b)).otherwise(a)
    return runs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_a", text.alias("t")))), lambda x: x["t"]), ", ").alias(out))


def kind_summary(placements: DataFrame, by: list[str]) -> DataFrame:
    """The kinds of a group as text: labels in code order, joined by ' + '."""
    kinds = placements.groupBy(*by).agg(F.array_sort(F.collect_set("kind")).alias("_k"))
    return kinds.select(*by, F.array_join(F.transform("_k", lambda k: kind_name(k, KIND_LABELS)), " + ").alias("kinds"))


def estimated_sizes(discoveries: DataFrame, occurrences: DataFrame, by: list[str], object_key: list[str]) -> DataFrame:
    """Bytes of a group's distinct stored objects and its usage: each stored object counts once, however often it is drawn."""
    sizes = discoveries.groupBy(*by).agg(F.sum("n_bytes").alias("estimated_bytes"), F.count(F.lit(1)).alias("objects"))
    usage = occurrences.groupBy(*by).agg(F.count(F.lit(1)).alias("usage_count"))
    return sizes.join(usage, by)


#: Columns that a list can be sorted by, and whether a first click sorts them upwards; the list starts with the most used.
SORT_COLUMNS = {"kind": True, "object_id": True, "size": False, "usage_count": False, "file_count": False, "warning": True}
DEFAULT_SORT = ("usage_count", False)


def size_key(kind: Column, width: Column, height: Column, value: Column) -> Column:
    """What a list sorts by under size: the length of a text in UTF-16 units, the area of anything else."""
    units = F.length(F.encode(F.coalesce(value, F.lit("")), "UTF-16BE")) / 2
    return F.when(kind == TEXT, units.cast("double")).otherwise((width * height).cast("double"))


def warning_key(is_safe: Column, full_page: Column) -> Column:
    """What a list sorts by under warnings: unsafe groups, then those that cover a page, then all others."""
    return F.when(~is_safe, 0).when(full_page, 1).otherwise(2)


def display_positions(groups: DataFrame, column: str | None = None, ascending: bool | None = None, key: str = "identity", out: str = "position") -> DataFrame:
    """groups with their position in a list sorted by a column, then most used, then the key.

    Without a column the list's default holds; without a direction that of the column's first click.
    """
    column, up = (column, SORT_COLUMNS.get(column, True)) if column else DEFAULT_SORT
    up = up if ascending is None else ascending
    first = F.col(column).asc() if up else F.col(column).desc()
    return global_positions(groups, [first, F.col("usage_count").desc(), F.col(key).asc()], out=out)


def kept_selection(selected: DataFrame, rebuilt: DataFrame, key: list[str]) -> DataFrame:
    """What stays selected when a list is built anew: what it still holds."""
    return selected.join(rebuilt, key, "left_semi")


def shown_kinds(shown: set[int], turned_off: int) -> set[int]:
    """The kinds that a list shows after one is turned off; the last one cannot be."""
    return shown - {turned_off} or shown


def visible_window(first: int, count: int) -> tuple[int, int]:
    """Rows [start, stop) to have ready for a view of `count` rows from `first`: half a view more on both sides."""
    margin = count // 2
    return max(first - margin, 0), first + count + margin


def first_warnings(warnings: DataFrame, by: list[str], order: list[str], message: str, most: int = 4) -> DataFrame:
    """The first few warnings of a group, line by line, and how many more there are."""
    ranked = warnings.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    shown = F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.struct("_k", F.col(message).alias("m")))))
    return ranked.groupBy(*by).agg(F.array_join(F.transform(shown, lambda x: x["m"]), "\n").alias("shown"), F.greatest(F.count(F.lit(1)) - most, F.lit(0)).cast("long").alias("more"))


def batch_report(rows: DataFrame, file_col: str, page: Column, counts: dict[str, Column]) -> DataFrame:
    """file, level ('file' or 'batch'), pages_modified (distinct non-null pages) and one count a condition: every file's totals and the
    whole batch's (with a null file) from one pass over the rows."""
    told = [F.sum(F.when(how, 1).otherwise(0)).alias(name) for name, how in counts.items()]
    rolled = rows.withColumn("_page", page).rollup(file_col).agg(F.grouping_id().alias("_g"), F.count_distinct("_page").alias("pages_modified"), *told)
    return rolled.select(file_col, F.when(F.col("_g") == 1, "batch").otherwise("file").alias("level"), "pages_modified", *counts)


#: Different boxes in a row of usage_boxes, on average.
BOXES_A_ROW = 1000


def usage_boxes(placements: DataFrame, by: list[str], a_row: int = BOXES_A_ROW) -> DataFrame:
    """Per group (a page of a file): shown, its placements, and boxes, their different boxes (x, y, w, h, times) in order.

    Groups of more than a_row different boxes give several rows, each with the boxes of its piece (dealt by hash), so that no
    row and no task holds a crowded page; pieces is 1 and piece is 0 for all others. Nulls in a box or a group are
    values like others.
    """
    each = placements.groupBy(*by, "x", "y", "w", "h").agg(F.count(F.lit(1)).alias("times"))
    crowded = each.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > a_row)
    same = F.expr(" and ".join(f"p.{k} <=> c.{k}" for k in by))
    dealt = each.alias("p").join(crowded.alias("c"), same, "left").select("p.*", F.coalesce(F.ceil(F.col("_n") / a_row), F.lit(1)).cast("long").alias("pieces"))
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("x", "y", "w", "h"), "pieces"))
    box = F.struct("x", "y", "w", "h", "times")
    return dealt.groupBy(*by, "pieces", "piece").agg(F.sum("times").alias("shown"), F.array_sort(F.collect_list(box)).alias("boxes"))
