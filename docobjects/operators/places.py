"""Places that are made, absorbed and taken back: what a plan holds in the end, and what it held at any version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut
from ..schema import IMAGE
from .components import keyed_components
from .selection import same_box

#: Side of a cell that boxes are looked up by, in points; wider than the tolerance of same_box.
CELL = 16.0


def first_parents(places: DataFrame, members: DataFrame, page: list[str]) -> DataFrame:
    """page, child, parent: the first later place with an image member where the earlier place's picture was drawn.

    A picture's corner is in one cell; a member looks into the cells that its own corner may have come from.
    """
    at = lambda c: F.floor(c / CELL)
    near = lambda c: F.array_distinct(F.array(at(F.col(c) - 0.1), at(F.col(c) + 0.1)))
    pictures = places.select(*page, F.col("place").alias("child"), "x", "y", "w", "h", at(F.col("x")).alias("cx"), at(F.col("y")).alias("cy"))
    images = members.where(F.col("kind") == IMAGE).select(*page, F.col("place").alias("parent"), "x", "y", "w", "h")
    images = images.withColumn("cx", F.explode(near("x"))).withColumn("cy", F.explode(near("y")))
    keys = " and ".join(f"m.{k} = p.{k}" for k in [*page, "cx", "cy"])
    hit = images.alias("m").join(pictures.alias("p"), F.expr(f"{keys} and p.child < m.parent") & same_box("m", "p"))
    return hit.groupBy(*[F.col(f"p.{k}").alias(k) for k in page], "child").agg(F.min("parent").alias("parent"))


def roots(parents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, child, root: where following parents ends. Places are whole numbers.

    A parent must come after its child; a chain that leads back to itself is an error, not an endless loop. As every child has one
    parent, which comes later, what hangs together ends in its last place: pages are worked out whole, crowded ones by joins.
    """
    ordered = F.when(F.col("parent") > F.col("child"), F.col("parent")).otherwise(F.raise_error(F.concat(F.lit("a place cannot absorb a later one: "), F.col("child").cast("string"))))
    kind = dict(parents.dtypes)["child"]
    down = lambda c: -c.cast("long")
    found = keyed_components(parents.select(*keys, down(F.col("child")).alias("a"), down(ordered).alias("b")), keys)
    return found.where("obj <> component").select(*keys, (-F.col("obj")).cast(kind).alias("child"), (-F.col("component")).cast(kind).alias("root"))


def places_left(places: DataFrame, parents: DataFrame, page: list[str]) -> DataFrame:
    """places, each once, that no later place has taken over by parents (page, child, parent)."""
    places = places.select(*page, "place", "x", "y", "w", "h")
    return places.join(parents.select(*page, F.col("child").alias("place")), [*page, "place"], "left_anti").distinct()


def absorb_all(places: DataFrame, members: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    """(places, members) after all places of a page were made in their order, absorption carried to its end.

    places: page, place (their order, whole numbers), x, y, w, h of the picture that each leaves; members: page, place, obj, kind, x, y, w,
    h. A member that is an image where an earlier place's picture lies stands for that place: the first later place with such a
    member takes it over with everything it has taken over itself, and the earlier place is gone. A later image at the same spot
    finds nothing and stays a member. All earlier places at a member's spot are taken.

    Members with null boxes or kinds stay; places with null boxes are never absorbed; repeated rows count once; places without
    members stay places. Empty tables give empty tables. Other columns are not read.
    """
    places, members = places.select(*page, "place", "x", "y", "w", "h"), members.select(*page, "place", "obj", "kind", "x", "y", "w", "h")
    parents = cut(first_parents(places, members, page))
    top = roots(parents, page)
    taken = parents.join(places.withColumnRenamed("place", "child"), [*page, "child"]).select(*page, F.col("parent").alias("place"), "x", "y", "w", "h")
    keys = F.expr(" and ".join(f"m.{k} = p.{k}" for k in [*page, "place"]))
    # Only an image can stand for a place.
    image = F.coalesce(F.col("kind") == IMAGE, F.lit(False))
    stay = members.where(image).alias("m").join(taken.alias("p"), keys & same_box("m", "p"), "left_anti").select(*page, "place", "obj")
    plain = members.where(~image).select(*page, "place", "obj").unionByName(stay)
    moved = plain.join(top.select(*page, F.col("child").alias("place"), "root"), [*page, "place"], "left")
    return places_left(places, parents, page), moved.select(*page, F.coalesce("root", "place").alias("place"), "obj").distinct()


def place_behind(occurrences: DataFrame, places: DataFrame, page: list[str], id_col: str) -> DataFrame:
    """page, id, place: the first place whose picture an occurrence is, for occurrences that are one."""
    keys = F.expr(" and ".join(f"o.{k} = p.{k}" for k in page))
    hit = occurrences.alias("o").join(places.alias("p"), keys & same_box("o", "p"))
    return hit.groupBy(*[F.col(f"o.{k}").alias(k) for k in page], F.col(f"o.{id_col}").alias(id_col)).agg(F.min("p.place").alias("place"))


#: Actions of a plan's log: a place is made or taken back, or hidden or shown again in the preview.
ADD, UNDO, HIDE, SHOW = "add", "undo", "hide", "show"


def live_intervals(log: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, layer ('flat' or 'hidden'), since, until: the versions [since, until) in which a place was in a layer; until is null
    for what still is.

    log: keys, version, place, action. Only changes count: making what is there and taking back what is not do nothing. Of several
    actions on a place in one version the last in the order add, hide, show, undo holds. Rows with null versions, places or
    unknown actions are left out; repeated rows count once; an empty log gives no rows.
    """
    on = F.col("action").isin(ADD, HIDE)
    layer = F.when(F.col("action").isin(ADD, UNDO), "flat").when(F.col("action").isin(HIDE, SHOW), "hidden")
    known = log.where("version is not null and place is not null").withColumn("layer", layer).where("layer is not null")
    states = known.groupBy(*keys, "place", "layer", "version").agg(F.bool_and(on).alias("on"))
    by = Window.partitionBy(*keys, "place", "layer").orderBy("version")
    changes = states.withColumn("was", F.coalesce(F.lag("on").over(by), F.lit(False))).where("on <> was")
    return changes.withColumn("until", F.lead("version").over(by)).where("on").select(*keys, "place", "layer", F.col("version").alias("since"), "until")


def as_of(intervals: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, version, place, layer: what was live at each version asked for (keys, version)."""
    same = " and ".join(f"i.{k} = v.{k}" for k in keys)
    live = f"{same} and i.since <= v.version and (i.until is null or v.version < i.until)"
    joined = versions.select(*keys, "version").distinct().alias("v").join(intervals.alias("i"), F.expr(live))
    return joined.select(*[F.col(f"v.{k}").alias(k) for k in keys], "v.version", "i.place", "i.layer")


def copy_keys(log: DataFrame, keys: list[str]) -> DataFrame:
    """keys, version, places, hidden, working_key, preview_key for every version of a log, however many places are live.

    A working copy shows the places made; a preview also lacks what is hidden. Copies of equal plans have equal keys, so a cache
    may use them. The keys are sums of hashes of what is live, kept up to date by what each version changes: no list of
    live places is ever gathered, and a version costs one step of a running sum.
    """
    intervals = live_intervals(log, keys)
    mark = F.xxhash64("place", "layer").cast("decimal(38,0)")
    counted = lambda name: F.sum(F.when(F.col("layer") == name, F.col("sign")).otherwise(0))
    hashed = lambda name: F.sum(F.when(F.col("layer") == name, F.col("sign") * mark).otherwise(F.lit(0).cast("decimal(38,0)")))
    starts = intervals.select(*keys, F.col("since").alias("version"), "place", "layer", F.lit(1).alias("sign"))
    ends = intervals.where("until is not null").select(*keys, F.col("until").alias("version"), "place", "layer", F.lit(-1).alias("sign"))
    changed = starts.unionByName(ends).groupBy(*keys, "version").agg(
        counted("flat").alias("n_flat"), counted("hidden").alias("n_hidden"), hashed("flat").alias("h_flat"), hashed("hidden").alias("h_hidden")
    )
    versions = log.where("version is not null").select(*keys, "version").distinct().join(changed, [*keys, "version"], "left")
    running = Window.partitionBy(*keys).orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(running), F.lit(0))
    summed = versions.select(*keys, "version", *[total(c).alias(c) for c in ("n_flat", "n_hidden", "h_flat", "h_hidden")])
    key = lambda *columns: _key(*columns)
    return summed.select(*keys, "version", F.col("n_flat").alias("places"), F.col("n_hidden").alias("hidden"), key("n_flat", "h_flat").alias("working_key"), key("n_flat", "h_flat", "n_hidden", "h_hidden").alias("preview_key"))


def _key(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
