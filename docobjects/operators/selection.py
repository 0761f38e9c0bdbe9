"""Selections, plans and checks: which objects go, which files are touched, what may be deleted, what is left to verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import tasks_for

#: Places that differ by less than this are the same place.
SAME_PLACE = 0.1


class SelectionError(ValueError):
    """A selection holds unknown or unsafe objects."""


def check_selection(selection: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Every selected key with verdict 'accepted', 'unsafe' or 'unknown'."""
    known = groups.groupBy(key).agg(F.bool_and("is_safe").alias("_safe"))
    verdict = F.when(F.col("_safe").isNull(), "unknown").when(F.col("_safe"), "accepted").otherwise("unsafe")
    return selection.select(key).distinct().join(known, key, "left").select(key, verdict.alias("verdict"))


def require_accepted(checked: DataFrame) -> None:
    """Raises SelectionError if a selection holds anything that is not accepted."""
    bad = checked.where("verdict <> 'accepted'").limit(5).collect()
    if bad:
        raise SelectionError(f"not removable: {[tuple(r) for r in bad]}")


def affected_files(selected: DataFrame, flattened: DataFrame, hidden: DataFrame, file_col: str = "file_id") -> DataFrame:
    """Files that hold a selected object, a flattened place or a hidden placement."""
    return selected.select(file_col).unionByName(flattened.select(file_col)).unionByName(hidden.select(file_col)).distinct()


def prunable(doomed: DataFrame, references: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects that nothing refers to any more, and then the masks that only these had.

    doomed: object_id; references: from_object, to_object; masks: image_id, mask_id. References from doomed
    objects that do go no longer count for their masks.
    """
    tasks = tasks_for(doomed, references, masks)
    ends = references.select("to_object", "from_object").repartition(tasks, "to_object")
    used = ends.select(F.col("to_object").alias("object_id")).distinct()
    gone = doomed.select("object_id").repartition(tasks, "object_id").distinct().join(used, "object_id", "left_anti")
    had = masks.repartition(tasks, "image_id").join(gone.select(F.col("object_id").alias("image_id")), "image_id", "left_semi")
    orphans = had.select(F.col("mask_id").alias("object_id")).repartition(tasks, "object_id").distinct()
    # Only references to these masks can keep one.
    asked = ends.join(orphans.select(F.col("object_id").alias("to_object")), "to_object", "left_semi")
    left = asked.repartition(tasks, "from_object").join(gone.select(F.col("object_id").alias("from_object")), "from_object", "left_anti")
    return gone, orphans.join(left.select(F.col("to_object").alias("object_id")).distinct(), "object_id", "left_anti")


def same_box(a: str, b: str, edges: tuple[str, ...] = ("x", "y", "w", "h")) -> Column:
    """All values of two boxes differ by less than SAME_PLACE."""
    return F.expr(" and ".join(f"abs({a}.{e} - {b}.{e}) < {SAME_PLACE}" for e in edges))


def first_match(left: DataFrame, right: DataFrame, keys: list[str], condition: Column, id_col: str, order: list[str], band: tuple[str, ...] = ()) -> DataFrame:
    """left (alias l) with the first of right (alias r) in `order` that meets keys and condition.

    band names columns of both whose values the condition wants closer than SAME_PLACE. They are cut into cells of twice that
    width and become equality keys (left stands in a cell and its neighbours), so a page with many objects is no product of
    its rows. Nulls in keys or band columns match nothing.
    """
    cells = []
    for n, c in enumerate(band):
        cell = F.floor(F.col(c) / (2 * SAME_PLACE))
        left = left.withColumn(f"_cell{n}", F.explode(F.sequence(cell - 1, cell + 1)))
        right = right.withColumn(f"_cell{n}", cell)
        cells.append(f"_cell{n}")
    equal = F.expr(" and ".join(f"l.{k} = r.{k}" for k in [*keys, *cells]))
    joined = left.alias("l").join(right.alias("r"), equal & condition)
    rank = F.row_number().over(Window.partitionBy(*[f"l.{k}" for k in keys], f"l.{id_col}").orderBy(*order))
    return joined.withColumn("_rank", rank).where("_rank = 1").drop("_rank", *cells)


def flatten_behind(occurrences: DataFrame, places: DataFrame, page: list[str], id_col: str, order: str) -> DataFrame:
    """page, id_col and `order` of the place that each occurrence is the picture of; null for ordinary occurrences.

    occurrences: page, id_col, x, y, w, h; places: page, order, x, y, w, h (where flattening drew a picture). The first place
    in `order` at the occurrence's box counts. Occurrences are kept as often as they are there; id_col is unique in a page.
    """
    boxes = ["x", "y", "w", "h"]
    drawn = places.select(*page, *boxes, F.col(order).alias("_place"))
    found = first_match(occurrences.select(*page, id_col, *boxes), drawn, page, same_box("l", "r"), id_col, ["r._place"], ("x", "y"))
    found = found.select(*[F.col(f"l.{k}").alias(k) for k in page], F.col(f"l.{id_col}").alias(id_col), F.col("r._place").alias(order))
    return occurrences.select(*page, id_col).join(found, [*page, id_col], "left")


def uncovered(placements: DataFrame, covered: DataFrame, page: list[str]) -> DataFrame:
    """Placements that are no member of a listed unit: no member of same page, kind and identity lies at the same place."""
    keys = " and ".join(f"p.{k} = c.{k}" for k in [*page, "kind", "identity"])
    near = f"abs(p.x - c.x) < {SAME_PLACE} and abs(p.y - c.y) < {SAME_PLACE}"
    return placements.alias("p").join(covered.alias("c"), F.expr(f"{keys} and {near}"), "left_anti")


def merge_units(members: DataFrame, checked: DataFrame, page: list[str]) -> DataFrame:
    """members (page, unit, obj) after the checked objects of at least two units of a page became one unit.

    The new unit has the least of the units it was taken from, and what stays of that unit is negated (-1 - unit), so that
    units stay distinct; a unit that loses all its objects vanishes.
    """
    chosen = members.join(checked, [*page, "obj"], "left_semi")
    merged = chosen.groupBy(*page).agg(F.min("unit").alias("new_unit"), F.count_distinct("unit").alias("sources")).where("sources >= 2")
    flagged = members.join(chosen.select(*page, "obj", F.lit(True).alias("taken")), [*page, "obj"], "left").join(merged.select(*page, "new_unit"), page, "left")
    unit = F.when(F.col("new_unit").isNotNull() & F.col("taken").isNotNull(), F.col("new_unit")).when(F.col("unit") == F.col("new_unit"), -1 - F.col("unit")).otherwise(F.col("unit"))
    return flagged.select(*page, "obj", unit.alias("unit"))


def split_unit(members: DataFrame, checked: DataFrame, page: list[str]) -> DataFrame:
    """members after the checked objects of a unit (a proper part of it) became a unit of their own (-1 - unit)."""
    chosen = members.join(checked, [*page, "obj"], "left_semi").select(*page, "obj", F.lit(1).alias("taken"))
    flagged = members.join(chosen, [*page, "obj"], "left")
    sizes = flagged.groupBy(*page, "unit").agg(F.count(F.lit(1)).alias("n"), F.count("taken").alias("k"))
    joined = flagged.join(sizes, [*page, "unit"])
    return joined.select(*page, "obj", F.when(F.col("taken").isNotNull() & (F.col("k") < F.col("n")), -1 - F.col("unit")).otherwise(F.col("unit")).alias("unit"))


def absorb_places(places: DataFrame, member_rows: DataFrame, pictures: DataFrame, page: list[str]) -> DataFrame:
    """Members of new places, where a member that is the picture of an earlier place is replaced by that place's members.

    places: page, place, x, y, w, h (earlier places' pictures); member_rows: page, place, x, y, w, h, obj (new places' members);
    pictures: page, place, obj (earlier places' members).
    """
    keys = " and ".join(f"m.{k} = p.{k}" for k in page)
    hit = member_rows.alias("m").join(places.alias("p"), F.expr(keys) & same_box("m", "p"), "left")
    plain = hit.where("p.place is null").select(*[F.col(f"m.{k}").alias(k) for k in page], F.col("m.place").alias("place"), F.col("m.obj").alias("obj"))
    found = hit.where("p.place is not null").select(*[F.col(f"m.{k}").alias(k) for k in page], F.col("m.place").alias("new_place"), F.col("p.place").alias("place"))
    return plain.unionByName(found.join(pictures, [*page, "place"]).select(*page, F.col("new_place").alias("place"), "obj")).distinct()


def insertion_points(ops: DataFrame, page: list[str]) -> DataFrame:
    """Where a picture may be put into a page's operators: after the last operator that leaves no q open, up to target.

    ops: page, idx, op, target. -1 if a cm stands outside all q (the page's own space is then not the plain one).
    A Q without q leaves the depth at 0 or below; only a depth of exactly 0 counts.
    """
    running = Window.partitionBy(*page).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0)).over(running)
    deep = ops.withColumn("depth", depth).where("idx <= target")
    return deep.groupBy(*page).agg(
        F.when(F.bool_or((F.col("op") == "cm") & (F.col("depth") == 0)), -1).otherwise(F.coalesce(F.max(F.when(F.col("depth") == 0, F.col("idx") + 1)), F.lit(0))).cast("long").alias("insert_at")
    )


def verification(names: DataFrame, removed: DataFrame, retained: DataFrame, by: str, key: str, strict: bool = False) -> DataFrame:
    """Per file: no removed object is left, and retained ones are there (one of them; all of them if strict).

    names: file, key after cleaning; removed, retained: file, key.
    """
    seen = names.select(by, key).distinct()
    removed, retained = removed.select(by, key).distinct(), retained.select(by, key).distinct()
    flags = (
        removed.withColumn("role", F.lit("removed"))
        .unionByName(retained.join(removed, [by, key], "left_anti").withColumn("role", F.lit("retained")))
        .join(seen.withColumn("there", F.lit(True)), [by, key], "left")
        .groupBy(by)
        .agg(
            F.sum(F.when((F.col("role") == "removed") & F.col("there"), 1).otherwise(0)).alias("removed_left"),
            F.sum(F.when(F.col("role") == "retained", 1).otherwise(0)).alias("retained"),
            F.sum(F.when((F.col("role") == "retained") & F.col("there"), 1).otherwise(0)).alias("retained_there"),
        )
    )
    kept = F.col("retained") == F.col("retained_there") if strict else (F.col("retained") == 0) | (F.col("retained_there") > 0)
    return flags.select(by, "removed_left", "retained", "retained_there", ((F.col("removed_left") == 0) & kept).alias("passed"))
