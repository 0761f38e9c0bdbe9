"""Queries over plans and their outcome: places, versions, ranges, transformations, names, checks and published files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import jpeg
from ..lineage import dealt, scratch, width
from ..operators import assertions, naming, places, ranges, transforms
from ..operators import grouping as A
from ..sources import publish, published
from ..sources.adapters import numbered_placements, placements, table
from .catalog import NUMBERED, ORACLES, PLACED, QUERIES, SELECTED, _selected, query

_BEFORE = set(QUERIES)

# ---- published files ---------------------------------------------------------------------------------------

VOLUMES = """volumes AS (SELECT coalesce(source, 'none') || '-' || CAST(floor(doc_id / 100.0) AS BIGINT) || '.txt' AS name, count(*) AS n, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id, text) AS t FROM documents GROUP BY 1)"""


def _volumes(spark, sf_dir):
    # A hundred ids at most lie in a volume.
    volume = F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit(".txt"))
    rows = table(spark, sf_dir, "documents").select(volume.alias("name"), F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("d"))
    volumes = rows.groupBy("name").agg(F.array_sort(F.collect_list("d")).alias("d"))
    content = F.encode(F.array_join(F.transform("d", lambda d: d["text"]), "\n"), "UTF-8")
    return volumes.select("name", content.alias("content"), (F.size("d") > 1).alias("passed"))


#: Documents whose volumes a task publishes, on average.
DOCUMENTS_A_TASK = 4000


def _volume_tasks(spark, sf_dir) -> int:
    return max(width(spark), -(-table(spark, sf_dir, "documents").count() // DOCUMENTS_A_TASK))


@query(f"""{VOLUMES} SELECT name, CASE WHEN n > 1 THEN CAST(octet_length(encode(t)) AS BIGINT) END AS n_bytes, CASE WHEN n > 1 THEN sha256(t) END AS sha256, CASE WHEN n = 1 THEN 'verification failed' END AS error FROM volumes""")
def published_manifest(spark, sf_dir):
    """Volumes of documents of a source, written, read back and published as one batch; volumes of one document do not pass."""
    path = scratch(spark, "published")
    publish.publish(_volumes(spark, sf_dir), path, failures="skip", tasks=_volume_tasks(spark, sf_dir))
    return publish.manifest(spark, path).select("name", "n_bytes", "sha256", "error")


@query(
    f"""{VOLUMES}, numbered_volumes AS (SELECT *, CAST(regexp_extract(name, '-([0-9]+).txt$', 1) AS BIGINT) AS no FROM volumes)
    SELECT name, sha256(t) AS sha256, CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes, CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS BIGINT) AS n_lines FROM numbered_volumes WHERE n > 1 AND sha256(t) IN (SELECT sha256(t) FROM numbered_volumes WHERE no % 3 = 1)"""
)
def published_wanted(spark, sf_dir):
    """Every third volume, wanted by its digest, read back from what is published; other files are not opened."""
    volumes, path = _volumes(spark, sf_dir), scratch(spark, "published")
    publish.publish(volumes, path, failures="skip", tasks=_volume_tasks(spark, sf_dir))
    wanted = volumes.where("cast(regexp_extract(name, '-([0-9]+).txt$', 1) as bigint) % 3 = 1").select(F.sha2("content", 256).alias("sha256"))
    text = F.decode("content", "UTF-8")
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return published.read_published(spark, path, wanted).select("name", "sha256", "n_bytes", lines.alias("n_lines"))


# ---- places ------------------------------------------------------------------------------------------------

_SAME = "abs({a}.x - {b}.x) < 0.1 AND abs({a}.y - {b}.y) < 0.1 AND abs({a}.w - {b}.w) < 0.1 AND abs({a}.h - {b}.h) < 0.1"
MADE = f"""{NUMBERED}, made AS (SELECT page_uid, obj AS place, identity, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM numbered WHERE obj % 3 = 0),
  held AS (SELECT page_uid, obj - obj % 3 + 3 AS place, obj, kind, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM numbered WHERE obj % 3 <> 0
    UNION ALL SELECT m.page_uid, m.place, 1000000 + m.place, 0, e.x + 0.05, e.y, e.w, e.h FROM made m JOIN made e ON e.page_uid = m.page_uid AND e.place = m.place - 3 WHERE m.identity % 4 <> 0
    UNION ALL SELECT m.page_uid, m.place, 2000000 + m.place, 0, e.x, e.y - 0.05, e.w, e.h FROM made m JOIN made e ON e.page_uid = m.page_uid AND e.place = m.place - 6 WHERE m.identity % 5 = 0),
  parents AS (SELECT m.page_uid, e.place AS child, min(m.place) AS parent FROM held m JOIN made e ON e.page_uid = m.page_uid AND e.place < m.place AND m.kind = 0 AND {_SAME.format(a="m", b="e")} GROUP BY ALL),
  up AS (SELECT * FROM parents UNION SELECT u.page_uid, u.child, p.parent FROM up u JOIN parents p ON p.page_uid = u.page_uid AND p.child = u.parent),
  top AS (SELECT page_uid, child, max(parent) AS root FROM up GROUP BY ALL)"""


def _made(spark, sf_dir):
    p = numbered_placements(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in "xywh"}).withColumn("obj", F.col("obj").cast("long"))
    # Objects are numbered without gaps: the places made one and two before lie three and six objects back.
    order = Window.partitionBy("page_uid").orderBy("seq", "x", "y", "w", "h", "hides")
    box = F.struct("x", "y", "w", "h")
    p = p.withColumns({"e3": F.lag(box, 3).over(order), "e6": F.lag(box, 6).over(order)})
    row = lambda place, obj, kind, x, y, w, h: F.expr(f"struct({place} as place, {obj} as obj, {kind} as kind, {x} as x, {y} as y, {w} as w, {h} as h)")
    plain = F.when(F.expr("obj % 3 <> 0"), row("obj - obj % 3 + 3", "obj", "kind", "x", "y", "w", "h"))
    one = F.when(F.expr("obj % 3 = 0 and identity % 4 <> 0 and e3 is not null"), row("obj", "obj + 1000000", "0", "e3.x + 0.05", "e3.y", "e3.w", "e3.h"))
    two = F.when(F.expr("obj % 3 = 0 and identity % 5 = 0 and e6 is not null"), row("obj", "obj + 2000000", "0", "e6.x", "e6.y - 0.05", "e6.w", "e6.h"))
    held = p.select("page_uid", F.explode(F.array(plain, one, two)).alias("m")).where("m is not null").select("page_uid", "m.*")
    made = p.where("obj % 3 = 0").withColumnRenamed("obj", "place")
    return made.select("page_uid", "place", "x", "y", "w", "h"), held


@query(
    f"""{MADE} SELECT DISTINCT h.page_uid, coalesce(root, h.place) AS place, h.obj FROM held h LEFT JOIN top ON top.page_uid = h.page_uid AND top.child = h.place
    WHERE NOT EXISTS (SELECT 1 FROM parents p JOIN made e ON e.page_uid = p.page_uid AND e.place = p.child WHERE p.page_uid = h.page_uid AND p.parent = h.place AND h.kind = 0 AND {_SAME.format(a="h", b="e")})""",
    recursive=True,
)
def absorbed_members(spark, sf_dir):
    return places.absorb_all(*_made(spark, sf_dir), ["page_uid"])[1]


@query(f"{MADE} SELECT page_uid, place FROM made m WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.page_uid = m.page_uid AND p.child = m.place)", recursive=True)
def places_left(spark, sf_dir):
    made, held = _made(spark, sf_dir)
    return places.places_left(made, places.first_parents(made, held, ["page_uid"]), ["page_uid"]).select("page_uid", "place")


@query(f"""{NUMBERED} SELECT o.page_uid, o.obj, min(p.obj) AS place FROM numbered o JOIN numbered p ON p.page_uid = o.page_uid AND p.obj % 4 = 0 AND abs(o.x + 0.05 - p.x) < 0.1 AND abs(o.y - p.y) < 0.1 AND abs(o.w - p.w) < 0.1 AND abs(o.h - p.h) < 0.1 GROUP BY ALL""")
def flatten_behind(spark, sf_dir):
    p = numbered_placements(spark, sf_dir)
    made = p.where("obj % 4 = 0").select("page_uid", F.col("obj").alias("place"), "x", "y", "w", "h")
    return places.place_behind(p.withColumn("x", F.col("x") + 0.05), made, ["page_uid"], "obj")


PLAN = """plan AS (SELECT user_id, event_id AS version, event_id * 7 % 5 AS place, CASE event_type WHEN 'purchase' THEN 'add' WHEN 'click' THEN 'add' WHEN 'error' THEN 'undo' WHEN 'view' THEN 'hide' ELSE 'show' END AS action FROM events),
  layers AS (SELECT *, CASE WHEN action IN ('add', 'undo') THEN 'flat' ELSE 'hidden' END AS layer, action IN ('add', 'hide') AS is_on FROM plan),
  live AS (SELECT v.user_id, v.version, l.place, l.layer FROM (SELECT DISTINCT user_id, version FROM plan) v JOIN layers l ON l.user_id = v.user_id AND l.version <= v.version GROUP BY ALL HAVING arg_max(l.is_on, l.version))"""


def _plan(spark, sf_dir):
    action = F.when(F.col("event_type").isin("purchase", "click"), "add").when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "view", "hide").otherwise("show")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("version"), F.expr("event_id * 7 % 5").alias("place"), action.alias("action"))


@query(f"{PLAN} SELECT * FROM live")
def plan_as_of(spark, sf_dir):
    log = _plan(spark, sf_dir)
    return places.as_of(places.live_intervals(log, ["user_id"]), log, ["user_id"])


@query(f"""{PLAN} SELECT v.user_id, v.version, count(*) FILTER (WHERE layer = 'flat') AS places, count(*) FILTER (WHERE layer = 'hidden') AS hidden FROM (SELECT DISTINCT user_id, version FROM plan) v LEFT JOIN live l ON l.user_id = v.user_id AND l.version = v.version GROUP BY ALL""")
def plan_copies(spark, sf_dir):
    return places.copy_keys(_plan(spark, sf_dir), ["user_id"]).select("user_id", "version", "places", "hidden")


# ---- ranges and transformations ----------------------------------------------------------------------------


@query(f"""{NUMBERED}, ops AS (SELECT page_uid, obj * 8 + unnest(range(2 + identity % 3)) AS idx FROM numbered), gone AS (SELECT page_uid, obj * 8 AS a, obj * 8 + w AS b FROM numbered WHERE h > 25)
    SELECT page_uid, idx FROM ops o WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.page_uid = o.page_uid AND o.idx BETWEEN g.a AND g.b)""")
def operators_left(spark, sf_dir):
    p = numbered_placements(spark, sf_dir).withColumn("obj", F.col("obj").cast("long"))
    ops = p.select("page_uid", F.explode(F.expr("sequence(obj * 8, obj * 8 + 1 + identity % 3)")).alias("idx"))
    return ranges.outside_ranges(ops, p.where("h > 25").selectExpr("page_uid", "obj * 8 as first", "obj * 8 + w as last"), ["page_uid"])


@query(f"""{NUMBERED}, listed AS (SELECT n.page_uid, r.region, kind, identity, r.l, r.b, r.r, r.t FROM numbered n, (VALUES (1, 40, 100, 200, 400), (2, 180, 50, 500, 300)) r(region, l, b, r, t) WHERE (identity + region) % 3 = 0)
    SELECT page_uid, obj, EXISTS (SELECT 1 FROM listed s WHERE s.page_uid = n.page_uid AND s.kind = n.kind AND s.identity = n.identity AND n.x < s.r AND s.l < n.x + n.w AND n.y < s.t AND s.b < n.y + n.h) AS member FROM numbered n""")
def region_members_and_others(spark, sf_dir):
    p = numbered_placements(spark, sf_dir)
    regions = p.select("page_uid").distinct().withColumn("r", F.explode(F.expr("array(struct(1L as region, 40d as left, 100d as bottom, 200d as right, 400d as top), struct(2L as region, 180d as left, 50d as bottom, 500d as right, 300d as top))"))).select("page_uid", "r.*")
    wanted = p.withColumn("region", F.explode(F.expr("array(1L, 2L)"))).where("(identity + region) % 3 = 0").select("page_uid", "region", "kind", "identity")
    return ranges.region_instances(p, regions, wanted, ["page_uid"]).select("page_uid", "obj", "member")


@query(
    f"""{NUMBERED}, cms AS (SELECT page_uid, obj, CASE WHEN obj % 5 IN (1, 2) THEN CASE WHEN identity % 2 = 0 THEN 1 ELSE -1 END ELSE 1 END AS s, CASE WHEN obj % 5 IN (1, 2) THEN w ELSE 0 END AS e, CASE WHEN obj % 5 IN (1, 2) THEN h ELSE 0 END AS f FROM numbered),
    base AS (SELECT a.page_uid, a.s * coalesce(b.s, 1) AS s, coalesce(b.e, 0) * a.s + a.e AS e, coalesce(b.f, 0) * a.s + a.f AS f FROM cms a LEFT JOIN cms b ON b.page_uid = a.page_uid AND b.obj = 2 WHERE a.obj = 1),
    first AS (SELECT page_uid, s, e, f FROM cms WHERE obj = 1),
    below AS (SELECT n.page_uid, n.obj, CASE WHEN n.obj = 1 THEN f1.s ELSE b.s END AS s, CASE WHEN n.obj = 1 THEN f1.e ELSE b.e END AS e, CASE WHEN n.obj = 1 THEN f1.f ELSE b.f END AS f FROM cms n JOIN base b ON b.page_uid = n.page_uid JOIN first f1 ON f1.page_uid = n.page_uid),
    one AS (SELECT l.page_uid, l.obj, l.s * coalesce(c.s, 1) AS s, coalesce(c.e, 0) * l.s + l.e AS e, coalesce(c.f, 0) * l.s + l.f AS f FROM below l LEFT JOIN cms c ON c.page_uid = l.page_uid AND l.obj >= 5 AND l.obj % 5 IN (1, 2) AND c.obj = l.obj - l.obj % 5 + 1),
    two AS (SELECT l.page_uid, l.obj, l.s * coalesce(c.s, 1) AS s, coalesce(c.e, 0) * l.s + l.e AS e, coalesce(c.f, 0) * l.s + l.f AS f FROM one l LEFT JOIN cms c ON c.page_uid = l.page_uid AND l.obj >= 5 AND l.obj % 5 = 2 AND c.obj = l.obj)
    SELECT page_uid, CAST(obj AS BIGINT) AS idx, CAST(s AS BIGINT) AS scale, CAST(e AS BIGINT) AS dx, CAST(f AS BIGINT) AS dy, CAST(CASE WHEN obj >= 5 AND obj % 5 < 3 THEN 1 ELSE 0 END AS BIGINT) AS depth FROM two"""
)
def matrices_in_force(spark, sf_dir):
    """Operators of a page by number: q (0), cm (1, 2), Q (3), others; the first Q of a page has nothing to take back."""
    op = F.expr("case obj % 5 when 0 then 'q' when 3 then 'Q' when 4 then 'Do' else 'cm' end")
    scale = F.expr("case when identity % 2 = 0 then 1d else -1d end")
    ops = numbered_placements(spark, sf_dir).select("page_uid", F.col("obj").alias("idx"), op.alias("op"), scale.alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), scale.alias("d"), F.col("w").alias("e"), F.col("h").alias("f"))
    found = transforms.current_matrices(ops, ["page_uid"])
    return found.select("page_uid", "idx", *[F.col(a).cast("long").alias(b) for a, b in (("a", "scale"), ("e", "dx"), ("f", "dy"))], "depth")


# ---- names, checks, totals ---------------------------------------------------------------------------------


@query(
    """wanted AS (SELECT doc_id, source || '_cleaned.pdf' AS candidate, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL),
    taken AS (SELECT DISTINCT source || '_cleaned.pdf' AS candidate, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE doc_id % 97 + 2 END AS n FROM documents WHERE doc_id % 3 = 0 AND source IS NOT NULL),
    sizes AS (SELECT candidate, count(*) + 100 AS n FROM wanted GROUP BY candidate), numbers AS (SELECT candidate, unnest(range(1, n)) AS n FROM sizes),
    free AS (SELECT candidate, n, row_number() OVER (PARTITION BY candidate ORDER BY n) AS k FROM numbers ANTI JOIN taken USING (candidate, n))
    SELECT doc_id, candidate, CASE WHEN n = 1 THEN candidate ELSE replace(candidate, '.pdf', ' (' || n || ').pdf') END AS final FROM wanted JOIN free USING (candidate, k)"""
)
def batch_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null")
    existing = docs.where("doc_id % 3 = 0").select(F.expr("concat(source, '_cleaned', case when doc_id % 5 = 0 then '' else concat(' (', doc_id % 97 + 2, ')') end, '.pdf')").alias("name"))
    return naming.free_names(docs.select("doc_id", F.concat("source", F.lit("_cleaned.pdf")).alias("candidate")), existing, ["doc_id"])


SHEETS = "sheets AS (SELECT DISTINCT file_id, page_number, CASE WHEN page_number % 7 = 0 THEN 0 ELSE 60 - page_number % 20 END AS width_pt, 34 - page_number % 9 AS height_pt FROM placed WHERE page_number % 11 <> 0)"


@query(f"""{PLACED}, {SHEETS} SELECT file_id, page_number, seq, x, y, coalesce(width_pt > 0 AND w >= 0.9 * width_pt AND h >= 0.9 * height_pt, false) AS full_page FROM placed LEFT JOIN sheets USING (file_id, page_number)""")
def full_page_by_sheet(spark, sf_dir):
    p = placements(spark, sf_dir)
    sheets = p.where("page_number % 11 <> 0").selectExpr("file_id", "page_number", "case when page_number % 7 = 0 then 0 else 60 - page_number % 20 end as width_pt", "34 - page_number % 9 as height_pt").distinct()
    return assertions.full_page_occurrences(p, sheets, ["file_id", "page_number"]).select("file_id", "page_number", "seq", "x", "y", "full_page")


@query(f"""{PLACED} SELECT file_id, kind, count(*) AS members, CAST(min(x) AS DOUBLE) AS "left", CAST(min(y) AS DOUBLE) AS bottom, CAST(max(x + w) AS DOUBLE) AS "right", CAST(max(y + h) AS DOUBLE) AS top FROM placed GROUP BY ALL""")
def region_covering(spark, sf_dir):
    p = placements(spark, sf_dir)
    return assertions.region_covering(p, ["file_id", "kind"], p.select("file_id", "kind"))


@query(f"{PLACED}, {SELECTED} SELECT CAST(file_id AS VARCHAR) AS file_id, count(*) FILTER (WHERE s.identity IS NOT NULL) AS n_selected, count(*) FILTER (WHERE x < 5) AS n_clear FROM placed p LEFT JOIN selected s USING (identity) GROUP BY file_id")
def cleaning_jobs(spark, sf_dir):
    chosen = placements(spark, sf_dir).join(_selected(spark, sf_dir).withColumn("chosen", F.lit(True)), "identity", "left")
    jobs = chosen.groupBy(F.col("file_id").cast("string").alias("file_id")).agg(F.count("chosen").alias("n_selected"), F.count(F.when(F.expr("x < 5"), 1)).alias("n_clear"))
    jobs = jobs.withColumns({"destination": F.concat("file_id", F.lit("_cleaned")), "n_flatten": F.lit(0), "readable": F.lit(True)})
    return assertions.clean_preconditions(jobs, final=True).select("file_id", "n_selected", "n_clear")


@query(
    f"""standard AS (SELECT {jpeg.STANDARD} AS t), sums AS (SELECT q, list_sum(list_transform(t, lambda v: least(greatest((v * CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END + 50) // 100, 1), 255))) AS s FROM standard, (SELECT unnest(range(1, 101)) AS q)),
    tables AS (SELECT p_partkey, list_transform(t, lambda v: least(greatest((v * CASE WHEN p_partkey % 100 + 1 < 50 THEN 5000 // (p_partkey % 100 + 1) ELSE 198 - 2 * (p_partkey % 100) END + 50) // 100, 1), 255) + p_size % 3) AS t FROM part, standard),
    away AS (SELECT p_partkey, q, CAST(list_sum(t) AS BIGINT) AS total, abs(s - list_sum(t)) AS d FROM tables, sums)
    SELECT p_partkey, total, CAST(min({{'d': d, 'q': q}}).q AS INTEGER) AS quality FROM away GROUP BY p_partkey, total"""
)
def table_quality(spark, sf_dir):
    """Qualities of quantisation tables of 64 entries, each scaled from the standard one and moved up a little."""
    q = "(p_partkey % 100 + 1)"
    percent = f"(case when {q} < 50 then 5000 div {q} else 200 - 2 * {q} end)"
    entries = F.expr(f"array({', '.join(f'least(greatest(({v} * {percent} + 50) div 100, 1), 255) + p_size % 3' for v in jpeg.STANDARD)})")
    # A file of small rows is one task's read, however many tables its rows make.
    tables = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"]).select("p_partkey", jpeg.table_sum(entries).alias("total"))
    return tables.select("p_partkey", "total", jpeg.nearest_quality(F.col("total")).alias("quality"))


@query(f"""{PLACED}, {SELECTED}, hit AS (SELECT p.*, s.identity IS NOT NULL AS chosen FROM placed p LEFT JOIN selected s USING (identity)) SELECT file_id, CASE WHEN grouping(file_id) = 1 THEN 'batch' ELSE 'file' END AS level, count(DISTINCT CASE WHEN chosen THEN page_uid END) AS pages_modified,
    CAST(sum(CASE WHEN chosen THEN 1 ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN chosen AND kind = 0 AND w > 50 THEN 1 ELSE 0 END) AS BIGINT) AS flattened, CAST(sum(CASE WHEN chosen AND kind = 0 AND w <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS resized FROM hit GROUP BY ROLLUP (file_id)""")
def batch_report(spark, sf_dir):
    chosen = placements(spark, sf_dir).join(_selected(spark, sf_dir).withColumn("chosen", F.lit(True)), "identity", "left")
    n = {"removed": "chosen", "flattened": "chosen and kind = 0 and w > 50", "resized": "chosen and kind = 0 and w <= 10"}
    return A.batch_report(chosen, "file_id", F.when(F.col("chosen"), F.col("page_uid")), {name: F.expr(how) for name, how in n.items()})


@query(f"{PLACED} SELECT file_id, page_number, identity, x, y, w, h, row_number() OVER (PARTITION BY file_id, page_number ORDER BY seq, x, y, w, h) AS box_no FROM placed WHERE w > 0 OR h > 0")
def usage_boxes(spark, sf_dir):
    """The boxes behind each row of a page, numbered as they are drawn."""
    boxes = A.global_positions(placements(spark, sf_dir).where("w > 0 or h > 0"), [F.col(c).asc() for c in ("seq", "x", "y", "w", "h")], ["file_id", "page_number"], "box_no")
    return boxes.select("file_id", "page_number", "identity", "x", "y", "w", "h", "box_no")


#: What this module registers, besides the catalogue.
ADDED = {k: v for k, v in QUERIES.items() if k not in _BEFORE}
SQL = {k: ORACLES[k] for k in ADDED if k in ORACLES}
