"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from .licenses import END, RULES, SENTENCES, STEPS, sentence_pattern

_LOWER = f"translate(coalesce(text, ''), '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
_WORD = r"[^\x20\x09-\x0D]+"

#: Label propagation along links, to the smallest id that can be reached.
_REACH = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT a AS id, a AS root FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.id AND r.root < e.b),
  roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""

OP3 = """WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents), n AS (SELECT *, length(h) // 2 AS n_bytes FROM d),
  w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 200) AS s FROM (SELECT *, unnest(range(n_bytes - 99)) AS p FROM n WHERE n_bytes >= 100)),
  later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
  steps AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM later),
  islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM steps),
  gone AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM islands GROUP BY doc_id, i),
  sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM gone GROUP BY doc_id),
  parts AS (SELECT doc_id, a, substr(h, CAST(2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS BIGINT), CAST(2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0)) AS BIGINT)) AS part FROM gone JOIN n USING (doc_id)),
  kept AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS head FROM parts GROUP BY doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM n LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP4 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
  w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
  five AS (SELECT doc_id, n, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
  s AS (SELECT DISTINCT doc_id, s FROM five WHERE n >= 5 AND s IS NOT NULL UNION SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
  sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), {_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON id = doc_id"""

OP5 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
  links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98), {_REACH},
  degree AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept FROM embeddings LEFT JOIN degree d ON d.id = vec_id LEFT JOIN roots r ON r.id = vec_id"""


def _licenses() -> str:
    known = ", ".join(f"('{s}', '{name}')" for name, variants in SENTENCES.items() for s in variants)
    text = "lower(coalesce(text, ''))"
    quote = lambda x: "'" + x.replace(END, "' || chr(1) || '")+ "'"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, {quote(pattern or r'[.!?;:]+([\x20\x09-\x0D]|$)')}, {quote(to)}, 'g')"
    text = f"regexp_replace(chr(1) || {text} || chr(1), {quote(f'[ \n]?{END}[ \n{END}]*')}, chr(1), 'g')"
    # Every end stands twice, so that a sentence does not take the one before the next.
    twice = f"regexp_replace({text}, {quote(f'([\n{END}])')}, '\\1\\1', 'g')"
    found = f"regexp_extract_all({twice}, {quote(f'[\n{END}](' + sentence_pattern([s for variants in SENTENCES.values() for s in variants], '(?: |\n\n)') + f')[\n{END}]')}, 1)"
    marked = "' ' || coalesce(sentence_ids, '') || ' '"
    for k, (_, parts) in enumerate(RULES):
        # Twice, since neighbours share the space between them.
        for _ in range(2):
            marked = f"regexp_replace({marked}, ' {' '.join(parts)} ', ' ={k} ', 'g')"
    names = ", ".join(f"({k}, '{name}')" for k, (name, _) in enumerate(RULES))
    return f"""WITH known(s, id) AS (VALUES {known}), names(k, name) AS (VALUES {names}),
  cut AS (SELECT doc_id, unnest(a) AS raw, unnest(range(len(a))) AS p FROM (SELECT doc_id, {found} AS a FROM documents)),
  hits AS (SELECT doc_id, p, id FROM cut JOIN known ON s = replace(raw, chr(10) || chr(10), ' ')),
  seq AS (SELECT doc_id, count(*) AS n_known, string_agg(id, ' ' ORDER BY p) AS sentence_ids FROM hits GROUP BY doc_id),
  marked AS (SELECT *, {marked} AS m FROM seq),
  parts AS (SELECT doc_id, unnest(string_split(trim(m), ' ')) AS part FROM marked),
  found AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(DISTINCT name) AS n FROM parts JOIN names ON part = '=' || k GROUP BY doc_id),
  rest AS (SELECT doc_id, count(*) AS unmatched FROM parts WHERE part NOT LIKE '=%' GROUP BY doc_id)
SELECT doc_id, coalesce(n_known, 0) AS n_known, coalesce(sentence_ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, coalesce(unmatched, 0) AS unmatched,
  CASE WHEN n_known IS NULL THEN 'none' WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'single' ELSE 'multiple' END AS verdict
FROM documents LEFT JOIN seq USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN rest USING (doc_id)"""


OP6 = _licenses()

OP11 = f"""WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
  known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  fails AS (SELECT part, doc_id, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
  marked AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS f,
    count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails LEFT JOIN known USING (doc_id) GROUP BY ALL),
  l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
  orders AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
  told AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic, f,
    contains(f, substr(filter_order, step, 1)) AS fails, len(f) > 0 AND regexp_matches(f, '[' || substr(filter_order, 1, step - 1) || '-]') AS before FROM steps, marked),
  sums AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE NOT before AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT before AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE before AND fails), 0) AS redundant, coalesce(sum(n) FILTER (WHERE f = letter), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT before AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT before AND fails), 0) AS toxic_lost FROM told GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM sums"""

OP13 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
