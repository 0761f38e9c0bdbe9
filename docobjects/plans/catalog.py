"""The query catalogue: operators over the test tables, and DuckDB SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as X
from ..lineage import cut
from ..operators import grouping as A
from ..operators import overlap as O
from ..operators import selection as S
from ..schema import KIND_LABELS, KIND_PREFIXES
from ..sources.adapters import PAGE_HEIGHT, PAGE_WIDTH, numbered_placements, placements, showings, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHOWINGS = """showings AS (
  SELECT doc_id, pos + 1 AS line_no, CAST(floor(pos / 40.0) AS BIGINT) + 1 AS page_number, value
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))"""
READABLE = r"length(regexp_replace(value, '[\s\p{Z}\p{Cc}]', '', 'g'))"
REPEATED = f"""{SHOWINGS}, repeated AS (
  SELECT doc_id, value, count(*) AS usage_count, min(page_number) AS first_page, max(page_number) AS last_page, count(DISTINCT page_number) AS page_count
  FROM showings WHERE {READABLE} >= 1 GROUP BY ALL HAVING count(*) >= 2)"""
PLACED = """placed AS (
  SELECT l_orderkey * 1000000 + CAST(l_linenumber AS BIGINT) * 100000 + l_partkey AS seq, CAST(floor(l_orderkey / 2000.0) AS BIGINT) AS file_id,
    CAST(floor(l_orderkey / 40.0) AS BIGINT) AS page_uid, CAST(floor(l_orderkey / 40.0) AS BIGINT) % 50 + 1 AS page_number, CAST(l_partkey % 5 AS INT) AS kind,
    l_partkey AS identity, (l_orderkey * 31 + l_linenumber * 97) % 560 AS x, (l_suppkey * 37 + l_linenumber * 53 + l_partkey) % 800 AS y,
    5 + CAST(l_quantity AS BIGINT) AS w, 4 + l_partkey % 30 AS h, l_returnflag <> 'N' AS hides FROM lineitem)"""
NUMBERED = f"{PLACED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY page_uid ORDER BY seq, x, y, w, h, hides) AS obj FROM placed)"
GROUPS = f"""{PLACED}, grouped AS (
  SELECT file_id, kind, identity, count(*) AS usage_count, count(DISTINCT page_number) AS page_count, bool_and(hides OR w > 10) AS is_safe,
    min(page_number) AS first_page, max(page_number) AS last_page FROM placed GROUP BY ALL)"""
PREFIX = "list_value(" + ", ".join(f"'{p}'" for p in KIND_PREFIXES) + ")[kind + 1]"
LABEL = "list_value(" + ", ".join(f"'{p}'" for p in KIND_LABELS) + ")[kind + 1]"
FULL = f"(w >= 0.9 * {PAGE_WIDTH} AND h >= 0.9 * {PAGE_HEIGHT})"
INSIDE = "({p}.x >= {q}.x AND {p}.x + {p}.w <= {q}.x + {q}.w AND {p}.y >= {q}.y AND {p}.y + {p}.h <= {q}.y + {q}.h)"
EDGES = f"""{NUMBERED}, cells AS (SELECT page_uid, obj, x, y, w, h, hides, unnest(range(x // 100, (x + w) // 100 + 1)) AS cx FROM numbered), gridded AS (SELECT *, unnest(range(y // 100, (y + h) // 100 + 1)) AS cy FROM cells), edges AS (
  SELECT a.page_uid, a.obj AS a, b.obj AS b FROM gridded a JOIN gridded b ON a.page_uid = b.page_uid AND a.cx = b.cx AND a.cy = b.cy AND a.obj < b.obj
    AND a.cx = greatest(a.x, b.x) // 100 AND a.cy = greatest(a.y, b.y) // 100 AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h
    AND CASE WHEN NOT a.hides THEN {INSIDE.format(p="a", q="b")} WHEN NOT b.hides THEN {INSIDE.format(p="b", q="a")}
      ELSE a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h END)"""
REGIONS = f"""{EDGES}, both_ways AS (SELECT page_uid, a, b FROM edges UNION ALL SELECT page_uid, b, a FROM edges),
  reach AS (SELECT page_uid, a AS obj, a AS region FROM both_ways UNION SELECT e.page_uid, e.b, r.region FROM reach r JOIN both_ways e ON e.page_uid = r.page_uid AND e.a = r.obj AND r.region < e.b),
  members AS (SELECT page_uid, obj, min(region) AS region FROM reach GROUP BY ALL),
  regions AS (SELECT n.page_uid, m.region, count(*) AS members, count(DISTINCT kind) AS kinds, CAST(min(x) AS DOUBLE) AS "left", CAST(min(y) AS DOUBLE) AS bottom, CAST(max(x + w) AS DOUBLE) AS "right", CAST(max(y + h) AS DOUBLE) AS top
    FROM numbered n JOIN members m ON n.page_uid = m.page_uid AND n.obj = m.obj GROUP BY n.page_uid, m.region HAVING count(*) >= 2 AND count(DISTINCT kind) >= 2)"""


def query(sql: str | None = None, recursive: bool = False):
    """Registers a query under its function's name, with its DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{sql}"
        return f

    return add


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placements(spark, sf_dir, ["file_id", "kind", "identity"]).withColumn("is_safe", F.expr("hides or w > 10"))
    return A.object_groups(p).withColumns({"first_page": F.array_min("pages"), "last_page": F.array_max("pages")})


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.overlap_edges(numbered_placements(spark, sf_dir), ["page_uid"], PAGE_WIDTH, PAGE_HEIGHT)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = numbered_placements(spark, sf_dir)
    members = O.region_members(O.overlap_edges(placed, ["page_uid"], PAGE_WIDTH, PAGE_HEIGHT), ["page_uid"])
    return O.regions(placed, members, ["page_uid"], PAGE_WIDTH, PAGE_HEIGHT)


# ---- texts -------------------------------------------------------------------------------------------------


@query(f"{REPEATED} SELECT * FROM repeated")
def text_repeats_per_file(spark, sf_dir):
    return A.repeated_texts(showings(spark, sf_dir))


@query(
    f"""{REPEATED}, merged AS (SELECT upper(sha256('TEXT:' || value)) AS hash, value, CAST(sum(usage_count) AS BIGINT) AS usage_count, count(DISTINCT doc_id) AS file_count FROM repeated GROUP BY value)
    SELECT format('TXT_{{:03d}}', row_number() OVER (ORDER BY usage_count DESC, hash)) AS object_id, hash, value, usage_count, file_count FROM merged"""
)
def text_cross_file_groups(spark, sf_dir):
    return A.number_corpus(A.text_groups(showings(spark, sf_dir))).select("object_id", "hash", "value", "usage_count", "file_count")


@query(f"{SHOWINGS} SELECT DISTINCT value, upper(sha256('TEXT:' || value)) AS hash FROM showings")
def text_group_hash(spark, sf_dir):
    return showings(spark, sf_dir).select("value").distinct().withColumn("hash", X.content_hash(F.col("value"), "TEXT:"))


@query(f"{SHOWINGS} SELECT doc_id, CAST(sum({READABLE}) AS BIGINT) AS readable, count(*) AS lines, CAST(sum(CASE WHEN {READABLE} >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS eligible FROM showings GROUP BY doc_id")
def readable_char_count(spark, sf_dir):
    n = X.readable_count(F.col("value")).cast("long")
    return showings(spark, sf_dir).groupBy("doc_id").agg(F.sum(n).alias("readable"), F.count(F.lit(1)).alias("lines"), F.sum((n >= 1).cast("long")).alias("eligible"))


@query(f"""{SHOWINGS} SELECT doc_id, line_no, CASE WHEN length(value) > 40 THEN left(value, 40) || '…' ELSE value END AS label,
    CASE WHEN trim(regexp_replace(value, '\\s', ' ', 'g')) = '' THEN '"' || value || '"' ELSE value END AS shown, length(value) || ' chars' AS size FROM showings""")
def object_labels(spark, sf_dir):
    v = F.col("value")
    return showings(spark, sf_dir).select("doc_id", "line_no", X.object_label(v).alias("label"), X.thumbnail_text(v).alias("shown"), X.size_label(F.lit(1), F.lit(0), F.lit(0), v).alias("size"))


@query(f"{PLACED} SELECT seq, x, y, CASE WHEN kind = 1 THEN length('text ' || identity) || ' chars' WHEN kind IN (2, 3) THEN w || 'x' || h || ' pt' ELSE w || 'x' || h END AS size FROM placed")
def size_labels(spark, sf_dir):
    shown = F.concat(F.lit("text "), F.col("identity").cast("string"))
    return placements(spark, sf_dir).select("seq", "x", "y", X.size_label(F.col("kind"), F.col("w"), F.col("h"), shown).alias("size"))


# ---- groups ------------------------------------------------------------------------------------------------


@query(f"""{GROUPS} SELECT file_id, kind, identity, format('{{}}_{{:03d}}', {PREFIX}, row_number() OVER (PARTITION BY file_id, kind ORDER BY usage_count DESC, identity)) AS object_id,
    usage_count, page_count, is_safe, first_page, last_page FROM grouped""")
def groups_per_file(spark, sf_dir):
    return A.number_within_file(_groups(spark, sf_dir)).select("file_id", "kind", "identity", "object_id", "usage_count", "page_count", "is_safe", "first_page", "last_page")


@query(f"""{GROUPS}, merged AS (SELECT kind, identity, CAST(sum(usage_count) AS BIGINT) AS usage_count, count(DISTINCT file_id) AS file_count, bool_and(is_safe) AS is_safe FROM grouped GROUP BY ALL)
    SELECT format('{{}}_{{:03d}}', {PREFIX}, row_number() OVER (PARTITION BY kind ORDER BY usage_count DESC, identity)) AS object_id, * FROM merged""")
def groups_across_files(spark, sf_dir):
    merged = _groups(spark, sf_dir).groupBy("kind", "identity").agg(F.sum("usage_count").alias("usage_count"), F.count_distinct("file_id").alias("file_count"), F.bool_and("is_safe").alias("is_safe"))
    return A.number_corpus(merged, "identity").drop("number")


@query(f"{PLACED} SELECT file_id, kind, identity, s.seq AS first_seq, s.x AS first_x, s.y AS first_y FROM (SELECT file_id, kind, identity, min({{'seq': seq, 'x': x, 'y': y}}) AS s FROM placed GROUP BY ALL)")
def groups_first_scalar(spark, sf_dir):
    return _groups(spark, sf_dir).select("file_id", "kind", "identity", "first_seq", "first_x", "first_y")


@query(f"{PLACED}, unsafe AS (SELECT file_id, kind, identity, min({{'seq': seq, 'x': x}}) AS u FROM placed WHERE NOT hides GROUP BY ALL) SELECT file_id, kind, identity, 'inside form at ' || u.x AS unsafe_reason FROM unsafe")
def first_warning(spark, sf_dir):
    p = placements(spark, sf_dir).withColumns({"is_safe": F.col("hides"), "unsafe_reason": F.concat(F.lit("inside form at "), F.col("x").cast("string"))})
    # Ties of seq are broken by the reason's own number, as in the oracle.
    first = p.where(~F.col("is_safe")).groupBy("file_id", "kind", "identity").agg(F.min(F.struct("seq", "x", "unsafe_reason")).alias("u"))
    return first.select("file_id", "kind", "identity", "u.unsafe_reason")


@query(f"""{PLACED}, stored AS (SELECT file_id, kind, identity, w, max(w * h) AS n_bytes FROM placed GROUP BY ALL), sizes AS (SELECT file_id, kind, identity, CAST(sum(n_bytes) AS BIGINT) AS estimated_bytes, count(*) AS objects FROM stored GROUP BY ALL),
    usage AS (SELECT file_id, kind, identity, count(*) AS usage_count FROM placed GROUP BY ALL) SELECT * FROM sizes JOIN usage USING (file_id, kind, identity)""")
def estimated_size_by_group(spark, sf_dir):
    p, by = placements(spark, sf_dir), ["file_id", "kind", "identity"]
    stored = p.groupBy(*by, "w").agg(F.max(F.col("w") * F.col("h")).alias("n_bytes"))
    return A.estimated_sizes(stored, p, by, ["w"])


@query(f"""{PLACED}, pages AS (SELECT DISTINCT file_id, identity, page_number AS p FROM placed), islands AS (SELECT *, p - row_number() OVER (PARTITION BY file_id, identity ORDER BY p) AS i FROM pages),
    runs AS (SELECT file_id, identity, min(p) AS a, max(p) AS b FROM islands GROUP BY file_id, identity, i)
    SELECT file_id, identity, string_agg(CASE WHEN b - a >= 2 THEN a || '〜' || b WHEN b > a THEN a || ', ' || b ELSE CAST(a AS VARCHAR) END, ', ' ORDER BY a) AS page_ranges FROM runs GROUP BY file_id, identity""")
def usage_page_ranges(spark, sf_dir):
    return A.page_runs(placements(spark, sf_dir, ["file_id", "identity"]), ["file_id", "identity"])


@query(f"{PLACED}, k AS (SELECT DISTINCT file_id, page_number, kind FROM placed) SELECT file_id, page_number, string_agg({LABEL}, ' + ' ORDER BY kind) AS kinds FROM k GROUP BY file_id, page_number")
def kind_summary(spark, sf_dir):
    return A.kind_summary(placements(spark, sf_dir), ["file_id", "page_number"])


@query(f"{PLACED} SELECT file_id, page_number, count(*) AS shown, CAST(sum(w * h) AS BIGINT) AS area, count(DISTINCT identity) AS identities FROM placed WHERE w > 0 OR h > 0 GROUP BY ALL")
def usage_rows(spark, sf_dir):
    p = placements(spark, sf_dir).where("w > 0 or h > 0")
    return p.groupBy("file_id", "page_number").agg(F.count(F.lit(1)).alias("shown"), F.sum(F.col("w") * F.col("h")).alias("area"), F.count_distinct("identity").alias("identities"))


@query(f"{PLACED}, g AS (SELECT identity, kind, count(*) AS usage_count, max(w * h) AS area, bool_and(hides) AS is_safe FROM placed GROUP BY ALL) SELECT *, CASE WHEN NOT is_safe THEN 0 ELSE 2 END AS warning_key, row_number() OVER (ORDER BY CASE WHEN NOT is_safe THEN 0 ELSE 2 END, usage_count DESC, identity) AS position FROM g")
def display_sort(spark, sf_dir):
    g = placements(spark, sf_dir).groupBy("identity", "kind").agg(F.count(F.lit(1)).alias("usage_count"), F.max(F.col("w") * F.col("h")).alias("area"), F.bool_and("hides").alias("is_safe"))
    g = g.withColumn("warning_key", F.when(~F.col("is_safe"), 0).otherwise(2))
    return A.global_positions(g, [F.col("warning_key").asc(), F.col("usage_count").desc(), F.col("identity").asc()])


@query(f"{PLACED}, g AS (SELECT identity, count(*) AS usage_count, row_number() OVER (ORDER BY count(*) DESC, identity) AS position FROM placed GROUP BY identity) SELECT * FROM g WHERE position > 15 AND position <= 55")
def viewport_window(spark, sf_dir):
    start, stop = A.visible_window(25, 20)
    g = placements(spark, sf_dir).groupBy("identity").agg(F.count(F.lit(1)).alias("usage_count"))
    # A view on the sorted list: its rows are the feature.
    ranked = A.global_positions(g, [F.col("usage_count").desc(), F.col("identity").asc()])
    return ranked.where((F.col("position") > start) & (F.col("position") <= stop))


@query(f"{GROUPS} SELECT file_id, kind, identity FROM grouped WHERE kind IN (0, 2, 4) AND is_safe")
def visible_kinds(spark, sf_dir):
    return _groups(spark, sf_dir).where(F.col("kind").isin(0, 2, 4) & F.col("is_safe")).select("file_id", "kind", "identity")


@query(
    f"""{PLACED}, g AS (SELECT kind, identity, count(*) AS usage_count, max(w * h) AS area, bool_and(hides OR w > 10) AS is_safe, bool_or(w >= 0.05 * {PAGE_WIDTH} AND h >= 0.03 * {PAGE_HEIGHT}) AS full_page FROM placed GROUP BY ALL),
    k AS (SELECT *, CASE WHEN NOT is_safe THEN 0 WHEN full_page THEN 1 ELSE 2 END AS warning, CASE WHEN kind = 1 THEN CAST(length('text ' || identity) AS DOUBLE) ELSE CAST(area AS DOUBLE) END AS size FROM g)
    SELECT kind, identity, usage_count, warning, size, row_number() OVER (ORDER BY usage_count DESC, identity) AS by_default, row_number() OVER (ORDER BY size DESC, usage_count DESC, identity) AS by_size,
      row_number() OVER (ORDER BY size, usage_count DESC, identity) AS by_size_up, row_number() OVER (ORDER BY warning, usage_count DESC, identity) AS by_warning FROM k"""
)
def display_sort_keys(spark, sf_dir):
    p = placements(spark, sf_dir)
    wide = (F.col("w") >= 0.05 * PAGE_WIDTH) & (F.col("h") >= 0.03 * PAGE_HEIGHT)
    g = p.groupBy("kind", "identity").agg(F.count(F.lit(1)).alias("usage_count"), F.max(F.col("w") * F.col("h")).alias("area"), F.expr("bool_and(hides or w > 10)").alias("is_safe"), F.bool_or(wide).alias("full_page"))
    shown = F.concat(F.lit("text "), F.col("identity").cast("string"))
    keyed = g.withColumns({"warning": A.warning_key(F.col("is_safe"), F.col("full_page")), "size": A.size_key(F.col("kind"), F.col("area"), F.lit(1), shown)})
    out = keyed.select("kind", "identity", "usage_count", "warning", "size")
    for name, column, up in (("by_default", None, None), ("by_size", "size", None), ("by_size_up", "size", True), ("by_warning", "warning", None)):
        out = A.display_positions(out, column, up, out=name)
    return out


@query(f"{PLACED} SELECT kind, identity, seq, file_id, page_number, x, y, row_number() OVER (PARTITION BY kind, identity ORDER BY seq, x, y, w, h) AS occurrence_no FROM placed")
def group_occurrences(spark, sf_dir):
    listed = A.occurrences(placements(spark, sf_dir), ["kind", "identity"], ["seq", "x", "y", "w", "h"])
    return listed.select("kind", "identity", "seq", "file_id", "page_number", "x", "y", "occurrence_no")


@query(
    f"""{GROUPS}, stored AS (SELECT file_id, kind, identity, w, max(w * h) AS n_bytes FROM placed GROUP BY ALL), sizes AS (SELECT file_id, kind, identity, sum(n_bytes) AS n_bytes FROM stored GROUP BY ALL),
    pages AS (SELECT file_id, kind, identity, bool_or(w >= 0.05 * {PAGE_WIDTH} AND h >= 0.03 * {PAGE_HEIGHT}) AS full_page, min(CASE WHEN h % 3 = 0 THEN {{'seq': seq, 't': 'thumb ' || h}} END).t AS thumbnail FROM placed GROUP BY ALL)
    SELECT kind, identity, CAST(sum(usage_count) AS BIGINT) AS usage_count, count(*) AS file_count, CAST(sum(n_bytes) AS BIGINT) AS estimated_bytes, bool_and(is_safe) AS is_safe, bool_or(full_page) AS full_page,
      min(CASE WHEN thumbnail IS NOT NULL THEN {{'file_id': file_id, 't': thumbnail}} END).t AS thumbnail FROM grouped JOIN sizes USING (file_id, kind, identity) JOIN pages USING (file_id, kind, identity) GROUP BY kind, identity"""
)
def groups_merged_over_files(spark, sf_dir):
    by = ["file_id", "kind", "identity"]
    wide = (F.col("w") >= 0.05 * PAGE_WIDTH) & (F.col("h") >= 0.03 * PAGE_HEIGHT)
    p = placements(spark, sf_dir, by).withColumns({"is_safe": F.expr("hides or w > 10"), "full_page": wide, "n_bytes": F.col("w") * F.col("h")})
    pictures = spark.range(100).where("id % 3 = 0").select(F.col("id").alias("hash"), F.concat(F.lit("thumb "), F.col("id").cast("string")).alias("thumbnail"))
    return A.merge_files(A.group_facts(p, pictures, by, ["w"], "h"), ["kind", "identity"], "file_id")


@query(f"{GROUPS} SELECT file_id, kind, identity, least(usage_count + 1, greatest(page_count, 1)) AS step FROM grouped WHERE kind <> 3")
def progress_steps(spark, sf_dir):
    shown = A.shown_kinds({0, 1, 2, 3, 4}, 3)
    g = _groups(spark, sf_dir).where(F.col("kind").isin(*A.shown_kinds(shown, 9)))
    return g.select("file_id", "kind", "identity", X.shown_step(F.col("usage_count"), F.col("page_count")).alias("step"))


@query(f"{GROUPS}, selected AS (SELECT p_partkey AS identity FROM part WHERE p_size <= 10 UNION SELECT -1) SELECT DISTINCT identity FROM selected SEMI JOIN grouped USING (identity)")
def selection_kept(spark, sf_dir):
    chosen = _selected(spark, sf_dir).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("identity"))).distinct()
    return A.kept_selection(chosen, _groups(spark, sf_dir), ["identity"])


# ---- geometry ----------------------------------------------------------------------------------------------


@query(f"{PLACED} SELECT identity, kind, max(CASE WHEN kind = 0 THEN {FULL.replace('0.9', '0.05')} ELSE false END) AS wide, bool_or(kind = 0 AND {FULL}) AS full_page FROM placed GROUP BY identity, kind")
def full_page_flags(spark, sf_dir):
    p = placements(spark, sf_dir)
    wide = (F.col("w") >= 0.05 * PAGE_WIDTH) & (F.col("h") >= 0.05 * PAGE_HEIGHT)
    full = G.covers_page(F.col("w"), F.col("h"), F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT))
    return p.groupBy("identity", "kind").agg(F.bool_or((F.col("kind") == 0) & wide).alias("wide"), F.bool_or((F.col("kind") == 0) & full).alias("full_page"))


@query(f"""{PLACED}, turned AS (SELECT *, CASE WHEN identity % 7 = 0 THEN -w ELSE w END AS sw, CASE WHEN identity % 11 = 0 THEN 0.5 ELSE h END AS sh FROM placed), low AS (SELECT *, least(x, x + sw) AS lx, abs(sw) AS aw FROM turned)
    SELECT seq, x, y, CAST(lx - greatest(1 - aw, 0) / 2.0 AS DOUBLE) AS "left", CAST(lx + aw + greatest(1 - aw, 0) / 2.0 AS DOUBLE) AS "right", CAST(y - greatest(1 - sh, 0) / 2 AS DOUBLE) AS bottom, CAST(y + sh + greatest(1 - sh, 0) / 2 AS DOUBLE) AS top FROM low""")
def padded_bbox(spark, sf_dir):
    p = placements(spark, sf_dir)
    w, h = F.when(F.col("identity") % 7 == 0, -F.col("w")).otherwise(F.col("w")), F.when(F.col("identity") % 11 == 0, F.lit(0.5)).otherwise(F.col("h"))
    box = G.padded(F.col("x"), F.col("y"), w, h)
    return p.select("seq", "x", "y", *[box[k].alias(k) for k in ("left", "right", "bottom", "top")])


@query(f"{PLACED} SELECT seq, page_uid FROM placed WHERE kind = 2 AND w * 12 >= 0.9 * {PAGE_WIDTH} AND h * 30 >= 0.9 * {PAGE_HEIGHT}")
def page_furniture(spark, sf_dir):
    p = placements(spark, sf_dir).withColumns({"w": F.col("w") * 12, "h": F.col("h") * 30})
    return O.with_boxes(p).where(O.is_furniture(PAGE_WIDTH, PAGE_HEIGHT)).select("seq", "page_uid")


@query(f"""{PLACED} SELECT seq, least(0, 2 * w) + least(0, -h) + x AS "left", greatest(0, 2 * w) + greatest(0, -h) + x AS "right", y AS bottom, y + w + 3 * h AS top FROM placed""")
def affine_bbox(spark, sf_dir):
    m = [F.lit(v) for v in (2, 1, -1, 3)] + [F.col("x"), F.col("y")]
    box = G.mapped_box(m, F.lit(0), F.lit(0), F.col("w"), F.col("h"))
    return placements(spark, sf_dir).select("seq", *[box[k].alias(k) for k in ("left", "right", "bottom", "top")])


@query(f"""{PLACED}, t AS (SELECT *, ((CAST(identity % 9 AS INT) * 45 - 90) % 360 + 360) % 360 AS d FROM placed), r AS (SELECT *, CASE WHEN d % 90 = 0 THEN d ELSE 0 END AS turn FROM t)
    SELECT seq, x, y, turn, CASE turn WHEN 90 THEN y WHEN 180 THEN {PAGE_WIDTH} - x - w WHEN 270 THEN {PAGE_HEIGHT} - y - h ELSE x END AS dx, CASE turn WHEN 90 THEN x WHEN 180 THEN y WHEN 270 THEN {PAGE_WIDTH} - x - w ELSE {PAGE_HEIGHT} - y - h END AS dy,
      CASE WHEN turn IN (90, 270) THEN h ELSE w END AS dw, CASE WHEN turn IN (90, 270) THEN w ELSE h END AS dh FROM r""")
def rotation_display_rect(spark, sf_dir):
    degrees = (F.col("identity") % 9).cast("int") * 45 - 90
    rect = G.display_rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT), degrees)
    return placements(spark, sf_dir).select("seq", "x", "y", G.rotation(degrees).alias("turn"), *[rect[k].alias(k) for k in rect])


@query(f"{PLACED} SELECT file_id, identity, CAST(max(greatest(1, round_even(w / 72.0 * 300, 0))) AS BIGINT) AS max_w, CAST(max(greatest(1, round_even(h / 72.0 * 300, 0))) AS BIGINT) AS max_h FROM placed GROUP BY ALL")
def image_ceiling_max(spark, sf_dir):
    w, h = (G.pixel_ceiling(F.col(c), F.lit(G.LIMIT_DPI[3])) for c in ("w", "h"))
    return placements(spark, sf_dir).groupBy("file_id", "identity").agg(F.max(w).alias("max_w"), F.max(h).alias("max_h"))


@query(f"{PLACED} SELECT seq, x, y, CAST(round((0.299 * (x % 256) + 0.587 * (y % 256) + 0.114 * (w % 256)) * 1000) AS BIGINT) AS luma FROM placed")
def luminance(spark, sf_dir):
    luma = G.luminance(F.col("x") % 256, F.col("y") % 256, F.col("w") % 256)
    return placements(spark, sf_dir).select("seq", "x", "y", F.round(luma * 1000).cast("long").alias("luma"))


@query(f"{PLACED} SELECT seq, x, y, CAST(floor(least(greatest((x % 101) / 100.0 * 255, 0), 255)) AS BIGINT) AS grey, CAST(floor(least(greatest((CAST(1 AS DOUBLE) - (x % 5) / 4.0) * (CAST(1 AS DOUBLE) - (y % 3) / 2.0) * 255, 0), 255)) AS BIGINT) AS cyan FROM placed")
def colour_bytes(spark, sf_dir):
    share = lambda c, n: (F.col(c) % n) / F.lit(float(n - 1))
    cyan = G.cmyk(share("x", 5), F.lit(0.0), F.lit(0.0), share("y", 3))[0]
    return placements(spark, sf_dir).select("seq", "x", "y", G.colour_byte(share("x", 101)).cast("long").alias("grey"), cyan.cast("long").alias("cyan"))


# ---- overlap and order -------------------------------------------------------------------------------------


@query(f"{EDGES} SELECT * FROM edges")
def overlap_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"{REGIONS} SELECT * FROM regions", recursive=True)
def overlap_regions(spark, sf_dir):
    return _regions(spark, sf_dir).drop("covers_page")


@query(f"""{REGIONS} SELECT page_uid, region, "right" - "left" >= 0.1 * {PAGE_WIDTH} AND top - bottom >= 0.05 * {PAGE_HEIGHT} AS large, "right" - "left" >= 0.9 * {PAGE_WIDTH} AND top - bottom >= 0.9 * {PAGE_HEIGHT} AS covers_page FROM regions""", recursive=True)
def covers_whole_page(spark, sf_dir):
    large = (F.col("right") - F.col("left") >= 0.1 * PAGE_WIDTH) & (F.col("top") - F.col("bottom") >= 0.05 * PAGE_HEIGHT)
    return _regions(spark, sf_dir).select("page_uid", "region", large.alias("large"), "covers_page")


ORDERED = """gaps AS (SELECT *, CASE WHEN lag({top}) OVER w - {top} > 8 THEN 1 ELSE 0 END AS g FROM {source} WINDOW w AS (PARTITION BY page_uid ORDER BY {top} DESC, {left}, {ties})),
  lines AS (SELECT *, CAST(sum(g) OVER (PARTITION BY page_uid ORDER BY {top} DESC, {left}, {ties} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line_no FROM gaps)"""


@query(
    f"{NUMBERED}, topped AS (SELECT *, y + h AS top FROM numbered), {ORDERED.format(top='top', left='x', ties='kind, identity, obj', source='topped')} "
    "SELECT page_uid, obj, line_no, row_number() OVER (PARTITION BY page_uid ORDER BY line_no, x, kind, identity, obj) AS position FROM lines"
)
def reading_order(spark, sf_dir):
    topped = numbered_placements(spark, sf_dir).withColumn("top", F.col("y") + F.col("h"))
    return O.reading_order(topped, ["page_uid"], "top", "x", ["kind", "identity", "obj"]).select("page_uid", "obj", "line_no", "position")


@query(f"""{REGIONS}, {ORDERED.format(top="top", left='"left"', ties="region", source="regions")} SELECT page_uid, region, row_number() OVER (PARTITION BY page_uid ORDER BY line_no, "left", region) AS unit_no FROM lines""", recursive=True)
def region_numbers(spark, sf_dir):
    return O.reading_order(_regions(spark, sf_dir), ["page_uid"], "top", "left", ["region"], "unit_no").select("page_uid", "region", "unit_no")


@query(f"""{REGIONS}, covered AS (SELECT n.page_uid, kind, identity, x, y FROM numbered n JOIN members m ON n.page_uid = m.page_uid AND n.obj = m.obj JOIN regions r ON r.page_uid = m.page_uid AND r.region = m.region),
    units AS (SELECT page_uid, count(*) AS n FROM regions GROUP BY page_uid), loose AS (SELECT * FROM numbered n WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.page_uid = n.page_uid AND c.kind = n.kind AND c.identity = n.identity AND abs(c.x - n.x) < 0.1 AND abs(c.y - n.y) < 0.1))
    SELECT l.page_uid, obj, coalesce(n, 0) + row_number() OVER (PARTITION BY l.page_uid ORDER BY obj) AS unit_no FROM loose l LEFT JOIN units u ON l.page_uid = u.page_uid""", recursive=True)
def loose_units(spark, sf_dir):
    # Edges, regions and what is left over all read them: they are numbered once.
    placed = cut(numbered_placements(spark, sf_dir).select("page_uid", "obj", "kind", "identity", "x", "y", "w", "h", "hides"))
    members = O.region_members(O.overlap_edges(placed, ["page_uid"], PAGE_WIDTH, PAGE_HEIGHT), ["page_uid"])
    units = O.regions(placed, members, ["page_uid"], PAGE_WIDTH, PAGE_HEIGHT).select("page_uid", "region")
    covered = placed.join(members.join(units, ["page_uid", "region"]), ["page_uid", "obj"]).select("page_uid", "kind", "identity", "x", "y")
    loose = S.uncovered(placed, covered, ["page_uid"])
    counts = units.groupBy("page_uid").agg(F.count(F.lit(1)).alias("n"))
    number = F.coalesce("n", F.lit(0)) + F.row_number().over(Window.partitionBy("page_uid").orderBy("obj"))
    return loose.join(counts, "page_uid", "left").select("page_uid", "obj", number.cast("long").alias("unit_no"))


# ---- selections and plans ----------------------------------------------------------------------------------

SELECTED = "selected AS (SELECT p_partkey AS identity FROM part WHERE p_size <= 10)"


def _selected(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("identity"))


@query(f"{GROUPS}, {SELECTED} SELECT file_id, kind, identity, usage_count FROM grouped SEMI JOIN selected USING (identity)")
def selection_semi(spark, sf_dir):
    return _groups(spark, sf_dir).join(_selected(spark, sf_dir), "identity", "left_semi").select("file_id", "kind", "identity", "usage_count")


@query(f"{GROUPS}, {SELECTED}, known AS (SELECT identity, bool_and(is_safe) AS safe FROM grouped GROUP BY identity), wanted AS (SELECT * FROM selected UNION SELECT -1) SELECT identity, CASE WHEN safe IS NULL THEN 'unknown' WHEN safe THEN 'accepted' ELSE 'unsafe' END AS verdict FROM wanted LEFT JOIN known USING (identity)")
def selection_check(spark, sf_dir):
    wanted = _selected(spark, sf_dir).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("identity")))
    return S.check_selection(wanted, _groups(spark, sf_dir), "identity")


@query(f"{GROUPS}, {SELECTED} SELECT DISTINCT file_id, kind, identity FROM grouped ANTI JOIN selected USING (identity)")
def selection_anti(spark, sf_dir):
    return _groups(spark, sf_dir).join(_selected(spark, sf_dir), "identity", "left_anti").select("file_id", "kind", "identity").distinct()


@query(f"{PLACED}, {SELECTED} SELECT file_id FROM placed SEMI JOIN selected USING (identity) UNION SELECT file_id FROM placed WHERE x < 5 AND y < 40 UNION SELECT file_id FROM placed WHERE w = 50 AND h = 30")
def affected_files(spark, sf_dir):
    p = placements(spark, sf_dir)
    return S.affected_files(p.join(_selected(spark, sf_dir), "identity", "left_semi"), p.where("x < 5 and y < 40"), p.where("w = 50 and h = 30"))


@query(f"{GROUPS}, {SELECTED} SELECT file_id, identity FROM grouped WHERE kind IN (0, 3, 4) EXCEPT SELECT file_id, identity FROM grouped SEMI JOIN selected USING (identity)")
def retained_except(spark, sf_dir):
    g = _groups(spark, sf_dir)
    removed = g.join(_selected(spark, sf_dir), "identity", "left_semi").select("file_id", "identity")
    return g.where(F.col("kind").isin(0, 3, 4)).select("file_id", "identity").exceptAll(removed).distinct()


@query(
    """refs AS (SELECT l_orderkey AS from_object, l_partkey AS to_object FROM lineitem UNION ALL SELECT p_partkey AS from_object, p_partkey + 1 AS to_object FROM part WHERE p_size % 2 = 0),
    doomed AS (SELECT p_partkey AS object_id FROM part UNION SELECT o_orderkey FROM orders), gone AS (SELECT object_id FROM doomed WHERE object_id NOT IN (SELECT to_object FROM refs)),
    masks AS (SELECT o_orderkey AS image_id, 2 * o_orderkey + 1 AS mask_id FROM orders), left_refs AS (SELECT * FROM refs WHERE from_object NOT IN (SELECT object_id FROM gone)),
    orphans AS (SELECT DISTINCT mask_id AS object_id FROM masks WHERE image_id IN (SELECT object_id FROM gone) AND mask_id NOT IN (SELECT to_object FROM left_refs))
    SELECT object_id, 'object' AS role FROM gone UNION ALL SELECT object_id, 'mask' AS role FROM orphans"""
)
def prune_unreferenced(spark, sf_dir):
    """Line items refer to parts and even parts to the next one; orders have masks, and most of them nothing refers to."""
    orders, items, parts = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    refs = items.select(F.col("l_orderkey").alias("from_object"), F.col("l_partkey").alias("to_object"))
    refs = refs.unionByName(parts.where("p_size % 2 = 0").select(F.col("p_partkey").alias("from_object"), (F.col("p_partkey") + 1).alias("to_object")))
    doomed = parts.select(F.col("p_partkey").alias("object_id")).unionByName(orders.select(F.col("o_orderkey").alias("object_id")))
    gone, orphans = S.prunable(doomed, refs, orders.select(F.col("o_orderkey").alias("image_id"), (2 * F.col("o_orderkey") + 1).alias("mask_id")))
    return gone.withColumn("role", F.lit("object")).unionByName(orphans.withColumn("role", F.lit("mask")))


@query("drawn AS (SELECT l_orderkey AS k, count(*) AS calls FROM lineitem GROUP BY 1) SELECT o_orderkey AS object_id, o_orderpriority AS filter, calls FROM orders JOIN drawn ON k = o_orderkey")
def orphan_drop(spark, sf_dir):
    drawn = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("calls"))
    return table(spark, sf_dir, "orders").join(drawn, F.col("o_orderkey") == F.col("k")).select(F.col("o_orderkey").alias("object_id"), F.col("o_orderpriority").alias("filter"), "calls")


@query(
    f"""{NUMBERED}, m AS (SELECT l.page_uid, l.obj AS place, r.obj AS picture, row_number() OVER (PARTITION BY l.page_uid, l.obj ORDER BY r.obj) AS k FROM numbered l JOIN numbered r ON l.page_uid = r.page_uid
    AND abs(l.x - r.x - 0.05) < 0.1 AND abs(l.w - r.w) < 0.1 AND l.obj <> r.obj) SELECT page_uid, place, picture FROM m WHERE k = 1"""
)
def picture_match(spark, sf_dir):
    p = numbered_placements(spark, sf_dir)
    left = p.withColumn("x", F.col("x") - 0.05)
    return S.first_match(left, p, ["page_uid"], S.same_box("l", "r", ("x", "w")) & F.expr("l.obj <> r.obj"), "obj", ["r.obj"], ("x", "w")).select(F.col("l.page_uid").alias("page_uid"), F.col("l.obj").alias("place"), F.col("r.obj").alias("picture"))


COARSE = "page_uid, obj, x // 40 * 40 AS x, y // 50 * 50 AS y, w // 10 AS w, h // 10 AS h"


@query(
    f"""{NUMBERED}, o AS (SELECT {COARSE}, kind = 0 AND hides AS flattened FROM numbered)
    SELECT o.page_uid, o.obj, min(p.obj) AS place FROM o LEFT JOIN o p ON p.flattened AND o.page_uid = p.page_uid AND abs(o.x - p.x) < 0.1 AND abs(o.y - p.y) < 0.1 AND abs(o.w - p.w) < 0.1 AND abs(o.h - p.h) < 0.1 GROUP BY o.page_uid, o.obj"""
)
def flatten_behind(spark, sf_dir):
    """Opaque images are taken for the pictures of flattened places; coordinates are coarse, so that places lie over one another."""
    coarse = numbered_placements(spark, sf_dir).select("page_uid", "obj", "kind", "hides", *[F.expr(f"{c} div {n} * {k}").alias(c) for c, n, k in (("x", 40, 40), ("y", 50, 50), ("w", 10, 1), ("h", 10, 1))])
    drawn = coarse.where("kind = 0 and hides").withColumnRenamed("obj", "place")
    return S.flatten_behind(coarse, drawn, ["page_uid"], "obj", "place")


@query(f"""{PLACED}, each AS (SELECT file_id, page_number, x, y, w, h, count(*) AS times FROM placed GROUP BY ALL)
    SELECT file_id, page_number, CAST(1 AS BIGINT) AS pieces, CAST(0 AS BIGINT) AS piece, CAST(sum(times) AS BIGINT) AS shown, string_agg(concat_ws(' ', x, y, w, h, times), ';' ORDER BY x, y, w, h) AS boxes FROM each GROUP BY file_id, page_number""")
def usage_boxes(spark, sf_dir):
    boxes = F.array_join(F.transform("boxes", lambda b: F.concat_ws(" ", b["x"], b["y"], b["w"], b["h"], b["times"])), ";")
    return A.usage_boxes(placements(spark, sf_dir), ["file_id", "page_number"]).withColumn("boxes", boxes)


UNITS = f"{NUMBERED}, units AS (SELECT page_uid, CAST(obj % 6 AS BIGINT) AS unit, obj, w FROM numbered), chosen AS (SELECT page_uid, unit, obj FROM units WHERE w > 45)"


def _units(spark, sf_dir):
    return numbered_placements(spark, sf_dir).select("page_uid", (F.col("obj") % 6).cast("long").alias("unit"), "obj", "w")


@query(
    f"""{UNITS}, merged AS (SELECT page_uid, min(unit) AS new_unit FROM chosen GROUP BY page_uid HAVING count(DISTINCT unit) >= 2)
    SELECT u.page_uid, u.obj, CASE WHEN new_unit IS NOT NULL AND c.obj IS NOT NULL THEN new_unit WHEN u.unit = new_unit THEN -1 - u.unit ELSE u.unit END AS unit
    FROM units u LEFT JOIN chosen c ON u.page_uid = c.page_uid AND u.obj = c.obj LEFT JOIN merged m ON u.page_uid = m.page_uid"""
)
def merge_units(spark, sf_dir):
    units = _units(spark, sf_dir)
    return S.merge_units(units.drop("w"), units.where("w > 45").select("page_uid", "obj"), ["page_uid"])


@query(
    f"""{UNITS}, sizes AS (SELECT u.page_uid, u.unit, count(*) AS n, count(c.obj) AS k FROM units u LEFT JOIN chosen c ON u.page_uid = c.page_uid AND u.obj = c.obj GROUP BY ALL)
    SELECT u.page_uid, u.obj, CASE WHEN c.obj IS NOT NULL AND k < n THEN -1 - u.unit ELSE u.unit END AS unit FROM units u LEFT JOIN chosen c ON u.page_uid = c.page_uid AND u.obj = c.obj JOIN sizes s ON s.page_uid = u.page_uid AND s.unit = u.unit"""
)
def split_units(spark, sf_dir):
    units = _units(spark, sf_dir)
    return S.split_unit(units.drop("w"), units.where("w > 45").select("page_uid", "obj"), ["page_uid"])


@query(
    f"""{NUMBERED}, ops AS (SELECT page_uid, obj AS idx, CASE WHEN obj % 4 = 1 THEN 'q' WHEN obj % 4 = 3 THEN 'Q' WHEN obj % 97 = 0 THEN 'cm' ELSE 'Do' END AS op, 60 AS target FROM numbered),
    d AS (SELECT *, sum(CASE op WHEN 'q' THEN 1 WHEN 'Q' THEN -1 ELSE 0 END) OVER (PARTITION BY page_uid ORDER BY idx ROWS UNBOUNDED PRECEDING) AS depth FROM ops)
    SELECT page_uid, CAST(CASE WHEN bool_or(op = 'cm' AND depth = 0) THEN -1 ELSE coalesce(max(CASE WHEN depth = 0 THEN idx + 1 END), 0) END AS BIGINT) AS insert_at FROM d WHERE idx <= target GROUP BY page_uid"""
)
def depth_insertion_point(spark, sf_dir):
    op = F.when(F.expr("obj % 4 = 1"), "q").when(F.expr("obj % 4 = 3"), "Q").when(F.expr("obj % 97 = 0"), "cm").otherwise("Do")
    return S.insertion_points(numbered_placements(spark, sf_dir).select("page_uid", F.col("obj").alias("idx"), op.alias("op"), F.lit(60).alias("target")), ["page_uid"])


@query(
    f"""{PLACED}, {SELECTED}, names AS (SELECT DISTINCT file_id, identity FROM placed WHERE h > 9), removed AS (SELECT DISTINCT file_id, identity FROM placed SEMI JOIN selected USING (identity) WHERE h <= 12),
    kept AS (SELECT DISTINCT file_id, identity FROM placed WHERE kind IN (0, 3, 4) EXCEPT SELECT * FROM removed), roles AS (SELECT *, 'removed' AS role FROM removed UNION ALL SELECT *, 'retained' FROM kept),
    f AS (SELECT r.file_id, CAST(sum(CASE WHEN role = 'removed' AND n.identity IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS removed_left, CAST(sum(CASE WHEN role = 'retained' THEN 1 ELSE 0 END) AS BIGINT) AS retained,
      CAST(sum(CASE WHEN role = 'retained' AND n.identity IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS retained_there FROM roles r LEFT JOIN names n ON n.file_id = r.file_id AND n.identity = r.identity GROUP BY r.file_id)
    SELECT *, removed_left = 0 AND (retained = 0 OR retained_there > 0) AS passed FROM f"""
)
def verify_flags(spark, sf_dir):
    p = placements(spark, sf_dir)
    names = p.where("h > 9")
    removed = p.join(_selected(spark, sf_dir), "identity", "left_semi").where("h <= 12")
    return S.verification(names, removed, p.where(F.col("kind").isin(0, 3, 4)), "file_id", "identity")


# ---- formats -----------------------------------------------------------------------------------------------


@query(
    f"""{PLACED}, n AS (SELECT DISTINCT 2 * identity * identity * (CASE WHEN kind = 0 THEN 1 WHEN kind = 1 THEN 1024 ELSE 70000 END) - 9 AS n FROM placed)
    SELECT n, CASE WHEN n >= 1073741824 THEN regexp_replace(printf('%.1f', n / 1073741824.0), '\\.0$', '') || ' GB' WHEN n >= 1048576 THEN regexp_replace(printf('%.1f', n / 1048576.0), '\\.0$', '') || ' MB'
      WHEN n >= 1024 THEN regexp_replace(printf('%.1f', n / 1024.0), '\\.0$', '') || ' KB' ELSE greatest(n, 0) || ' B' END AS size FROM n"""
)
def byte_size_format(spark, sf_dir):
    # Odd numbers never lie half way between two tenths, which formatters round differently.
    n = F.expr("2 * identity * identity * (case when kind = 0 then 1 when kind = 1 then 1024 else 70000 end) - 9")
    return placements(spark, sf_dir).select(n.alias("n")).distinct().withColumn("size", X.byte_size(F.col("n")))


NAMES = "SELECT DISTINCT source || (CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '_cleaned.PDF' WHEN 2 THEN '_cleaned(' || (doc_id % 13) || ').pdf' WHEN 3 THEN '_cleaned' ELSE '' END) AS name FROM documents"


@query(
    rf"""n AS ({NAMES}), p AS (SELECT name, regexp_extract(name, '^(.*?)(\.[^.]*)?$', 1) AS stem, regexp_extract(name, '^(.*?)(\.[^.]*)?$', 2) AS ext FROM n),
    q AS (SELECT *, regexp_extract(stem, '^(.*_cleaned)\(([1-9][0-9]*)\)$', 1) AS base, regexp_extract(stem, '^(.*_cleaned)\(([1-9][0-9]*)\)$', 2) AS k FROM p)
    SELECT name, (CASE WHEN base <> '' THEN base || '(' || (CAST(k AS BIGINT) + 1) || ')' WHEN ends_with(stem, '_cleaned') THEN stem || '(2)' ELSE stem || '_cleaned' END) || ext AS cleaned FROM q"""
)
def cleaned_name(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("_names_documents")
    return spark.sql(NAMES.replace("documents", "_names_documents")).withColumn("cleaned", X.cleaned_name(F.col("name")))


CHAINS = "list_value('/DCTDecode', 'FlateDecode+DCTDecode', '/JPXDecode', 'Custom', '/LZWDecode+/RunLengthDecode', 'JBIG2Decode', 'CCITTFaxDecode')[CAST(p_partkey % 7 AS INT) + 1]"
LABELLED = "list_value('JPEG', 'Flate+JPEG', 'JPEG2000', 'Custom', 'LZW+RunLength', 'JBIG2', 'CCITT')[CAST(p_partkey % 7 AS INT) + 1]"


@query(f"k AS (SELECT p_partkey, {CHAINS} AS chain, {LABELLED} AS label, CAST(p_size % 5 AS INT) AS kind FROM part) SELECT p_partkey, chain, label, CASE WHEN kind IN (0, 4) THEN label ELSE 'N/A' END AS shown FROM k")
def compression_label(spark, sf_dir):
    chains = ["/DCTDecode", "FlateDecode+DCTDecode", "/JPXDecode", "Custom", "/LZWDecode+/RunLengthDecode", "JBIG2Decode", "CCITTFaxDecode"]
    chain = F.element_at(F.array(*[F.lit(c) for c in chains]), (F.col("p_partkey") % 7).cast("int") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", chain.alias("chain"), X.filter_label(chain).alias("label"), X.compression_label(F.col("p_size") % 5, chain).alias("shown"))


@query("q AS (SELECT unnest(range(1, 101)) AS q), s AS (SELECT q, CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END AS scale FROM q), d AS (SELECT p_partkey, q, abs(scale - p_size * 10) AS dist FROM part, s) SELECT p_partkey, min({'dist': dist, 'q': q}).q AS quality FROM d GROUP BY p_partkey")
def quality_argmin(spark, sf_dir):
    scale = F.expr("transform(sequence(1, 100), q -> struct(abs((case when q < 50 then 5000 div q else 200 - 2 * q end) - p_size * 10) as dist, cast(q as bigint) as q))")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_min(scale)["q"].alias("quality"))


@query("e AS (SELECT * FROM events) SELECT event_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE least(greatest(value / (user_id % 4), 0), 1) END AS progress FROM e")
def progress(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.progress(F.col("value"), F.col("user_id") % 4).alias("progress"))


#: Failures, each with the kind that it is to be told as.
FAILURES = [
    ("PdfError", "the Password is wrong", "PdfEncrypted"),
    ("PdfError", "encrypted", "PdfEncrypted"),
    ("ValueError", "this is not a PDF", "NotAPdf"),
    ("PdfError", "no header found", "NotAPdf"),
    ("PdfError", "no trailer", "PdfCorrupted"),
    ("IndexError", None, "PdfCorrupted"),
    ("FileNotFoundError", "gone from disk", "PdfCorrupted"),
    ("PermissionError", "no space here", "DestinationNotWritable"),
    ("OSError", "No space left on device", "DiskFull"),
    ("OSError", "the DISK is full", "DiskFull"),
    ("OSError", "it is being used", "FileInUse"),
    ("OSError", "used by another process", "FileInUse"),
    ("OSError", "anything else", "DestinationNotWritable"),
    ("KeyboardInterrupt", "", "UserCanceled"),
    ("PdfPasswordRequired", None, "PdfPasswordRequired"),
    ("UnsupportedEncryption", None, "UnsupportedEncryption"),
    ("ImageExtractionFailed", None, "ImageExtractionFailed"),
    ("ImageRemovalUnsafe", None, "ImageRemovalUnsafe"),
    ("PostSaveVerificationFailed", "disk", "PostSaveVerificationFailed"),
    ("MemoryError", "password", "Unexpected"),
    (None, None, "Unexpected"),
]


@query(
    f"""t(k, kind) AS (VALUES {", ".join(f"({k}, '{kind}')" for k, (_, _, kind) in enumerate(FAILURES))}), r(kind, remedy) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in X.REMEDIES.items())})
    SELECT event_id, kind, remedy FROM events JOIN t ON k = event_id % {len(FAILURES)} JOIN r USING (kind)"""
)
def error_kinds_and_remedies(spark, sf_dir):
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]).cast("string") for x in FAILURES]), (F.col("event_id") % len(FAILURES)).cast("int") + 1)
    told = table(spark, sf_dir, "events").select("event_id", X.error_kind(pick(0), pick(1)).alias("kind"))
    return told.withColumn("remedy", X.error_remedy(F.col("kind")))


# ---- lists and totals --------------------------------------------------------------------------------------


@query(f"{GROUPS} SELECT file_id, count(*) AS group_count, CAST(sum(usage_count) AS BIGINT) AS total_usage FROM grouped GROUP BY file_id")
def document_totals(spark, sf_dir):
    return _groups(spark, sf_dir).groupBy("file_id").agg(F.count(F.lit(1)).alias("group_count"), F.sum("usage_count").alias("total_usage"))


@query(f"""{PLACED}, {SELECTED}, hit AS (SELECT p.*, s.identity IS NOT NULL AS chosen FROM placed p LEFT JOIN selected s USING (identity)) SELECT file_id, count(DISTINCT CASE WHEN chosen THEN page_uid END) AS pages_modified,
    CAST(sum(CASE WHEN chosen THEN 1 ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN chosen AND kind = 0 AND w > 50 THEN 1 ELSE 0 END) AS BIGINT) AS flattened, CAST(sum(CASE WHEN chosen AND NOT hides THEN 1 ELSE 0 END) AS BIGINT) AS kept_back FROM hit GROUP BY file_id""")
def batch_totals(spark, sf_dir):
    chosen = placements(spark, sf_dir).join(_selected(spark, sf_dir).withColumn("chosen", F.lit(True)), "identity", "left")
    n = lambda condition: F.sum(F.when(F.expr(condition), 1).otherwise(0)).alias
    return chosen.groupBy("file_id").agg(
        F.count_distinct(F.when(F.col("chosen"), F.col("page_uid"))).alias("pages_modified"),
        n("chosen")("removed"),
        n("chosen and kind = 0 and w > 50")("flattened"),
        n("chosen and not hides")("kept_back"),
    )


@query(f"{NUMBERED}, f AS (SELECT DISTINCT page_uid, identity FROM numbered WHERE kind = 0 AND w > 30), d AS (SELECT DISTINCT page_uid, identity FROM numbered WHERE kind = 0 AND w <= 30) SELECT * FROM f EXCEPT SELECT * FROM d")
def undrawn_names(spark, sf_dir):
    drawn = numbered_placements(spark, sf_dir).where("kind = 0").select("page_uid", "identity", "w")
    return drawn.where("w > 30").select("page_uid", "identity").distinct().join(drawn.where("w <= 30"), ["page_uid", "identity"], "left_anti")


@query(f"""{NUMBERED}, k AS (SELECT *, row_number() OVER (PARTITION BY page_uid ORDER BY obj) AS k FROM numbered WHERE NOT hides)
    SELECT page_uid, string_agg(CASE WHEN k <= 4 THEN 'object ' || obj || ' hides nothing' END, chr(10) ORDER BY k) AS shown, CAST(greatest(count(*) - 4, 0) AS BIGINT) AS more FROM k GROUP BY page_uid""")
def warnings_top4(spark, sf_dir):
    warnings = numbered_placements(spark, sf_dir).where("not hides").select("page_uid", "obj", F.concat(F.lit("object "), F.col("obj").cast("string"), F.lit(" hides nothing")).alias("message"))
    return A.first_warnings(warnings, ["page_uid"], ["obj"], "message")


@query(f"""{NUMBERED}, units AS (SELECT DISTINCT file_id, page_uid, CAST(obj % 4 AS BIGINT) AS unit, 0 AS loose FROM numbered WHERE hides), loose AS (SELECT file_id, page_uid, obj AS unit, 1 AS loose FROM numbered WHERE NOT hides),
    l AS (SELECT * FROM units UNION ALL SELECT * FROM loose) SELECT *, dense_rank() OVER (ORDER BY file_id) AS document_no, row_number() OVER (PARTITION BY file_id ORDER BY page_uid, loose, unit) AS row_no FROM l""")
def unit_list(spark, sf_dir):
    p = numbered_placements(spark, sf_dir)
    units = p.where("hides").select("file_id", "page_uid", (F.col("obj") % 4).cast("long").alias("unit"), F.lit(0).alias("loose")).distinct()
    both = units.unionByName(p.where("not hides").select("file_id", "page_uid", F.col("obj").cast("long").alias("unit"), F.lit(1).alias("loose")))
    documents = A.global_positions(both.select("file_id").distinct(), [F.col("file_id").asc()], out="document_no")
    listed = A.global_positions(both, [F.col("page_uid").asc(), F.col("loose").asc(), F.col("unit").asc()], ["file_id"], "row_no")
    return listed.join(documents, "file_id")


@query(f"{GROUPS}, {SELECTED}, g AS (SELECT g.*, s.identity IS NOT NULL AS chosen FROM grouped g LEFT JOIN selected s USING (identity)) SELECT file_id, kind, identity, chosen, row_number() OVER (ORDER BY chosen DESC, usage_count DESC, file_id, kind, identity) AS position FROM g")
def selected_first_sort(spark, sf_dir):
    g = _groups(spark, sf_dir).join(_selected(spark, sf_dir).withColumn("chosen", F.lit(True)), "identity", "left").select("file_id", "kind", "identity", "usage_count", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    return A.global_positions(g, [F.col("chosen").desc(), F.col("usage_count").desc(), F.col("file_id").asc(), F.col("kind").asc(), F.col("identity").asc()]).drop("usage_count")


@query("h AS (SELECT p_partkey, printf('%04X', 1024 + p_partkey % 200) || printf('%04X', 65 + p_partkey % 26) AS code FROM part) SELECT p_partkey, code, chr(CAST(1024 + p_partkey % 200 AS INT)) || chr(CAST(65 + p_partkey % 26 AS INT)) AS text FROM h")
def hex_text(spark, sf_dir):
    code = F.concat(F.format_string("%04X", 1024 + F.col("p_partkey") % 200), F.format_string("%04X", 65 + F.col("p_partkey") % 26))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), X.utf16_hex(code).alias("text"))


@query(rf"""p AS (SELECT doc_id, '/in/' || lang || '/' || source || (CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.v2.PDF' ELSE '' END) AS path FROM documents)
    SELECT doc_id, path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '([^/]*?)(\.[^./]*)?$', 1) AS stem, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS ext FROM p""")
def file_name_parts(spark, sf_dir):
    ending = F.when(F.expr("doc_id % 3 = 0"), ".pdf").when(F.expr("doc_id % 3 = 1"), ".v2.PDF").otherwise("")
    path = F.concat(F.lit("/in/"), F.col("lang"), F.lit("/"), F.col("source"), ending)
    name, stem, ext = X.file_parts(F.col("path"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).select("doc_id", "path", name.alias("name"), stem.alias("stem"), ext.alias("ext"))
