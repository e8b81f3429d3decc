"""DuckDB SQL with the results of the registered queries.

Shared parts are written once: BOX derives the boxes and their candidate pairs from line items, GREEDY walks the pairs
of each image in order and keeps what is free, which is the definition that the rounds of the Spark side must meet.
"""

from __future__ import annotations

from gaugeflow.plans.queries import EFFECTS, THRESHOLDS

ITEMS = """
items AS (
  SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS gi,
         l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity AS q, round(100 * l_discount) AS disc
  FROM lineitem
)"""

# All pairs of an image are formed here, overlapping or not, as the definitions of the taxonomies read.
BOX = ITEMS + """,
gt AS (
  SELECT image, gi AS gt, n % 3 AS cls, 10 * q AS x1, 10 * disc AS y1, 10 * q + 20 + p % 40 AS x2, 10 * disc + 20 + s % 40 AS y2,
         10 * q AS mx1, 10 * disc AS my1, 10 * q + 20 + p % 40 - p % 7 AS mx2, 10 * disc + 20 + s % 40 AS my2 FROM items
), pr0 AS (
  SELECT image, gi AS pred, (n + CASE WHEN p % 10 = 0 THEN 1 ELSE 0 END) % 3 AS cls, ((31 * p + 17 * s + 7 * n) % 1000)::DOUBLE / 1000 AS conf,
         10 * q + p % 7 - 3 + CASE WHEN s % 13 = 0 THEN 200 ELSE 0 END AS x1, 10 * disc + s % 5 - 2 AS y1, 20 + p % 40 + 4 * (n % 3) AS w, 20 + s % 40 AS h, s, n
  FROM items WHERE p % 11 <> 0
), pr AS (
  SELECT image, pred, cls, conf, x1, y1, x1 + w AS x2, y1 + h AS y2, x1 + s % 3 AS mx1, y1 AS my1, x1 + w AS mx2, y1 + h - n % 4 AS my2 FROM pr0
), inter AS (
  SELECT g.image, gt, pred, g.cls AS gt_cls, p.cls AS pred_cls, conf,
         greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS box_common,
         (g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS box_areas,
         greatest(0, least(g.mx2, p.mx2) - greatest(g.mx1, p.mx1)) * greatest(0, least(g.my2, p.my2) - greatest(g.my1, p.my1)) AS mask_common,
         (g.mx2 - g.mx1) * (g.my2 - g.my1) + (p.mx2 - p.mx1) * (p.my2 - p.my1) AS mask_areas
  FROM gt g JOIN pr p ON g.image = p.image
), cand AS (
  SELECT image, gt, pred, gt_cls, pred_cls, conf, mask_common / (mask_areas - mask_common) AS mask_iou, box_common / (box_areas - box_common) AS box_iou FROM inter
)"""


def greedy(name: str, source: str, keys: str = "image", where: str = "gt_cls = pred_cls") -> str:
    """CTEs that end in ``name``: the matches of ``source`` by a walk in order of (mask_iou, gt, pred) downwards."""
    join = " AND ".join(f"r.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    rkeys = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_o AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY mask_iou DESC, gt DESC, pred DESC) AS k FROM {source} WHERE mask_iou >= 0.5 AND {where}
), {name}_r AS (
  SELECT DISTINCT {keys}, 0::BIGINT AS k, []::BIGINT[] AS ug, []::BIGINT[] AS up, false AS ok, NULL::BIGINT AS gt, NULL::BIGINT AS pred, NULL::BIGINT AS gt_cls, NULL::BIGINT AS pred_cls, NULL::DOUBLE AS conf, NULL::DOUBLE AS mask_iou, NULL::DOUBLE AS box_iou FROM {name}_o
  UNION ALL
  SELECT {rkeys}, c.k,
         CASE WHEN list_contains(ug, c.gt) OR list_contains(up, c.pred) THEN ug ELSE list_append(ug, c.gt) END,
         CASE WHEN list_contains(ug, c.gt) OR list_contains(up, c.pred) THEN up ELSE list_append(up, c.pred) END,
         NOT (list_contains(ug, c.gt) OR list_contains(up, c.pred)), c.gt, c.pred, c.gt_cls, c.pred_cls, c.conf, c.mask_iou, c.box_iou
  FROM {name}_r r JOIN {name}_o c ON {join} AND c.k = r.k + 1
), {name} AS (
  SELECT {keys}, gt, pred, gt_cls, pred_cls, conf, mask_iou, box_iou FROM {name}_r WHERE ok
)"""


def boxed(*parts: str) -> str:
    return "WITH RECURSIVE" + BOX + "".join("," + p for p in parts)


FN = """
missed AS (SELECT g.image, g.gt, g.cls FROM gt g WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.image = g.image AND b.gt = g.gt)),
seen AS (SELECT m.cls, c.* FROM missed m JOIN cand c ON m.image = c.image AND m.gt = c.gt WHERE {where}),
recover AS (SELECT *, row_number() OVER (PARTITION BY image, gt ORDER BY mask_iou DESC, pred) AS k FROM seen WHERE pred_cls = cls AND mask_iou >= 0.5 AND conf < {low}),
spatial AS (SELECT *, row_number() OVER (PARTITION BY image, gt ORDER BY greatest(mask_iou, box_iou) DESC, pred) AS k FROM seen WHERE pred_cls <> cls AND (mask_iou >= 0.5 OR box_iou >= 0.5)),
same AS (SELECT *, row_number() OVER (PARTITION BY image, gt ORDER BY mask_iou DESC, pred) AS k FROM seen WHERE pred_cls = cls),
ruled AS (
  SELECT image, gt, 1 AS rule, 'LOW_CONF_RECOVERABLE' AS category, pred, conf, mask_iou, box_iou FROM recover WHERE k = 1
  UNION ALL SELECT image, gt, 2, 'WRONG_CLASS', pred, conf, mask_iou, box_iou FROM spatial WHERE k = 1
  UNION ALL SELECT image, gt, 3, 'LOCALIZATION_FAILURE', pred, conf, mask_iou, box_iou FROM same WHERE k = 1
), first_rule AS (SELECT *, row_number() OVER (PARTITION BY image, gt ORDER BY rule) AS k FROM ruled),
fn AS (
  SELECT m.image, m.gt, m.cls, coalesce(category, 'NO_RESPONSE') AS category, pred, conf, mask_iou, box_iou
  FROM missed m LEFT JOIN first_rule r ON m.image = r.image AND m.gt = r.gt AND r.k = 1
)"""

BASE = greedy("base", "cand", where="gt_cls = pred_cls AND conf >= 0.25")
KEPT = "prk AS (SELECT * FROM pr WHERE conf >= 0.25), candk AS (SELECT * FROM cand WHERE conf >= 0.25)"
FN_LOW = FN.format(low="0.25", where="true")
FN_TEST = FN.format(low="-1", where="conf >= 0.25")
FALSE_ALARMS = "fp AS (SELECT * FROM prk p WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.image = p.image AND b.pred = p.pred))"
TESTED = """
tested AS (
  SELECT image, 'gt' AS side, cls, category FROM fn UNION ALL SELECT image, 'gt', gt_cls, CASE WHEN mask_iou < 0.65 THEN 'POOR_MASK_BOUNDARY' ELSE 'TP' END FROM base UNION ALL SELECT image, 'pred', cls, 'FP' FROM fp
)"""
POOL = """
pool_kinds AS (SELECT image, count(*) FILTER (category = 'WRONG_CLASS') AS wrong, count(*) FILTER (category = 'LOCALIZATION_FAILURE') AS loc, count(*) FILTER (category = 'NO_RESPONSE') AS fn FROM fn GROUP BY image),
pool_fp AS (SELECT image, count(*) AS fp FROM fp GROUP BY image),
pool_all AS (
  SELECT i.image, coalesce(k.fn, 0) AS fn, coalesce(wrong, 0) AS wrong, coalesce(loc, 0) AS loc, coalesce(fp, 0) AS fp, 3 * coalesce(k.fn, 0) + 2 * coalesce(wrong, 0) + 2 * coalesce(loc, 0) + coalesce(fp, 0) AS score
  FROM (SELECT DISTINCT image FROM gt) i LEFT JOIN pool_kinds k ON i.image = k.image LEFT JOIN pool_fp f ON i.image = f.image
), pool AS (
  SELECT *, rank <= ceil(0.3 * count(*) OVER ()) AS is_hard, rank_desc <= ceil(0.3 * count(*) OVER ()) AS is_hard_desc
  FROM (SELECT *, row_number() OVER (ORDER BY score DESC, image::VARCHAR) AS rank, row_number() OVER (ORDER BY score DESC, image::VARCHAR DESC) AS rank_desc FROM pool_all)
)"""
POOLED = boxed(BASE, KEPT, FN_TEST, FALSE_ALARMS, POOL)

PRINTS = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings {copies}),
m AS (SELECT vec_id, label, v, list_sort(v) AS o, len(v) AS n FROM v),
m2 AS (SELECT vec_id, label, v, (o[(n - 1) // 2 + 1] + o[n // 2 + 1]) / 2 AS med, list_sum(v) / n AS mean, n FROM m),
c AS (
  SELECT vec_id, label, list_transform(v, lambda x: x >= med) AS pb, list_transform(range(1, n), lambda i: v[i + 1] >= v[i]) AS db, list_transform(v, lambda x: x - mean) AS ce FROM m2
), prints AS (
  SELECT vec_id, label, pb, db, ce, sqrt(list_dot_product(ce, ce)) AS norm FROM c
), pairs AS (
  SELECT a.vec_id AS l, b.vec_id AS r, a.label AS ll, b.label AS rl,
    list_sum(list_transform(list_zip(a.pb, b.pb), lambda z: (z[1] <> z[2])::INT)) AS pd, list_sum(list_transform(list_zip(a.db, b.db), lambda z: (z[1] <> z[2])::INT)) AS dd,
    list_dot_product(a.ce, b.ce) / (a.norm * b.norm) AS corr
  FROM prints a JOIN prints b ON {on}
)"""


def near(p: int, d: int, corr: float, copies: str = "") -> str:
    return f"WITH {PRINTS.format(copies=copies, on='a.vec_id < b.vec_id')} SELECT l AS left, r AS right, pd::INT AS phash_distance, dd::INT AS dhash_distance, round(corr, 6) AS correlation FROM pairs WHERE pd <= {p} AND dd <= {d} AND corr >= {corr}"


NEAREST = """
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY corr DESC, r) AS k FROM pairs) WHERE k = 1)"""

EXACT = """
h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents),
z AS (SELECT sha256, count(*) AS size, min(doc_id) AS first FROM h GROUP BY sha256 HAVING count(*) > 1),
zn AS (SELECT *, 'exact_' || lpad(row_number() OVER (ORDER BY size DESC, first)::VARCHAR, 4, '0') AS group_id FROM z)"""

MEASURED = ITEMS + """,
poly AS (
  SELECT image, gi, [{'x': 10*q, 'y': 10*disc}, {'x': 10*q + 20 + p % 40, 'y': 10*disc + p % 5}, {'x': 10*q + 20 + p % 40, 'y': 10*disc + 20 + s % 40}, {'x': 10*q, 'y': 10*disc + 20 + s % 40}] AS pts,
    CASE WHEN image % 10 < 7 THEN 'train' WHEN image % 10 < 9 THEN 'val' ELSE 'test' END AS split
  FROM items
), measured AS (
  SELECT image, gi, split, pts, abs(list_sum(list_transform(range(1, 5), lambda i: pts[i].x * pts[i % 4 + 1].y - pts[i % 4 + 1].x * pts[i].y))) / 2 AS area,
    list_max(list_transform(pts, lambda a: a.x)) - list_min(list_transform(pts, lambda a: a.x)) AS w, list_max(list_transform(pts, lambda a: a.y)) - list_min(list_transform(pts, lambda a: a.y)) AS h
  FROM poly
)"""

RAW = ITEMS + """,
shapes AS (
  SELECT image, gi, p, s, n, 10*q AS x, 10*disc AS y, 20 + p % 40 AS w, 20 + s % 40 AS h, p % 5 AS t,
    CASE WHEN p % 29 = 0 THEN 'bow' WHEN p % 31 = 0 THEN 'two' WHEN p % 37 = 0 THEN 'closed' WHEN p % 41 = 0 THEN 'nan' WHEN p % 47 = 0 THEN 'short' ELSE 'plain' END AS defect, p % 43 = 0 AS rect, s % 47 = 0 AS unlabelled
  FROM items
), shaped AS (
  SELECT *, x + w > 500 OR greatest(y + h, CASE WHEN defect <> 'bow' THEN y + t ELSE 0 END) > 140 AS out_full, x + w > 500 OR y + t > 140 AS out_two FROM shapes
)"""

SPLIT = """
docs AS (SELECT doc_id, sha256(text) AS sha FROM documents),
firsts AS (SELECT sha, min(doc_id) AS component, count(*) AS n FROM docs GROUP BY sha),
grouped AS (SELECT doc_id, d.sha, CASE WHEN n > 1 THEN 'group_' || component ELSE 'singleton_' || doc_id END AS grp FROM docs d JOIN firsts f ON d.sha = f.sha),
hashed AS (SELECT *, ('0x' || substr(md5(grp), 1, 8))::BIGINT % 100 AS r, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS ri FROM grouped),
rows0 AS (SELECT h.doc_id, sha, grp, CASE WHEN r < 70 THEN 'train' WHEN r < 85 THEN 'val' ELSE 'test' END AS split, CASE WHEN ri < 70 THEN 'train' WHEN ri < 85 THEN 'val' ELSE 'test' END AS by_id,
  CASE WHEN quality IS NOT NULL THEN ['quality' || quality, 'toxic' || toxic] ELSE [] END AS labels FROM hashed h LEFT JOIN labels l ON h.doc_id = l.doc_id),
flat AS (SELECT doc_id, split, unnest(labels) AS cls FROM rows0),
profiled AS (
  SELECT r.split, NULL::VARCHAR AS cls, count(*) AS images, (SELECT count(*) FROM flat f WHERE f.split = r.split) AS instances FROM rows0 r GROUP BY r.split
  UNION ALL SELECT split, cls, count(DISTINCT doc_id), count(*) FROM flat GROUP BY split, cls
)"""

RUNS = """
runs AS (
  SELECT (day(ts) - 1) // 6 AS seed, event_type AS model, round(avg(value), 6) AS metric FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL
), deltas AS (
""" + " UNION ALL ".join(f"SELECT '{a}-{b}' AS effect, x.metric - y.metric AS delta FROM runs x JOIN runs y ON x.seed = y.seed WHERE x.model = '{a}' AND y.model = '{b}'" for a, b in EFFECTS) + """
), paired AS (
  SELECT effect, count(*) AS n, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, round(min(delta), 6) AS lowest, round(max(delta), 6) AS highest, count(*) FILTER (delta > 0) AS positive FROM deltas GROUP BY effect
)"""

CURVE = """
curve0 AS (SELECT day(ts) AS epoch, round(avg(value), 6) AS loss, max(value) AS fitness FROM events GROUP BY 1),
curve AS (SELECT epoch, CASE WHEN epoch % 7 = 0 THEN 'nan'::DOUBLE ELSE loss END AS loss, fitness FROM curve0)"""

SWEPT = boxed(
    f"t AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold)",
    "passed AS (SELECT threshold, c.* FROM cand c JOIN t ON conf >= threshold WHERE mask_iou >= 0.5)",
    greedy("m", "passed", "threshold, image"),
    """
lev AS (SELECT unnest([-1, 0, 1, 2])::INT AS cls),
sw AS (
  SELECT threshold, lev.cls, (SELECT count(*) FROM gt g WHERE lev.cls = -1 OR g.cls = lev.cls) AS actual,
    (SELECT count(*) FROM pr p WHERE p.conf >= threshold AND (lev.cls = -1 OR p.cls = lev.cls)) AS predicted, (SELECT count(*) FROM m WHERE m.threshold = t.threshold AND (lev.cls = -1 OR m.gt_cls = lev.cls)) AS tp
  FROM t, lev
), swept AS (
  SELECT threshold, cls, tp, predicted - tp AS fp, actual - tp AS fn, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(actual, 0), 0) AS recall, coalesce(2 * tp / nullif(predicted + actual, 0), 0) AS f1 FROM sw WHERE actual > 0
)""",
)

DRAWS = """
srows AS (SELECT doc_id, doc_id % 10 < 3 AS is_hard, CASE WHEN doc_id % 10 < 3 THEN 2 ELSE 1 END AS w FROM documents),
cum AS (SELECT doc_id, is_hard, w, sum(w) OVER (ORDER BY doc_id) AS hi FROM srows),
dr AS (SELECT range AS draw, floor(('0x' || substr(md5('seed42:' || range), 1, 8))::BIGINT::DOUBLE / 4294967296.0 * (SELECT max(hi) FROM cum)) AS a FROM range(2048)),
drawn AS (SELECT draw, doc_id, is_hard FROM dr JOIN cum ON a >= hi - w AND a < hi)"""

TRAINING = "WITH " + ITEMS + """,
ln AS (
  SELECT image, gi, p % 61 = 0 AS broken, p % 53 = 0 AS bad_class, (p % 40) / 100 AS w, q / 100 AS x, disc / 20 AS y, CASE WHEN s % 59 = 0 THEN 3.0::DOUBLE ELSE 0.25::DOUBLE END AS h FROM items
), st AS (SELECT image, min(gi) FILTER (broken) AS stop FROM ln GROUP BY 1),
ag AS (
  SELECT l.image, count(stop) = 0 AS parsed, bool_and(broken OR (x + w <= 1 AND y + h <= 1)) AS in_range, bool_and(broken OR NOT bad_class) AS cls_ok,
    count(*) FILTER (stop IS NULL OR gi < stop) AS n, count(*) FILTER ((stop IS NULL OR gi < stop) AND w = 0) AS flat, coalesce(sum(w * h / 2) FILTER (stop IS NULL OR gi < stop), 0) AS area
  FROM ln l JOIN st ON l.image = st.image GROUP BY 1
), trained AS (
  SELECT o_orderkey AS dataset_index, o_orderkey AS image_stem, o_orderkey % 10 < 3 AS is_hard, '/images/' || o_orderkey || '.png' AS image_path, '/labels/' || o_orderkey || '.txt' AS label_path,
    o_orderkey % 211 <> 0 AS image_decode_ok, o_orderkey % 211 <> 0 AS image_finite, coalesce(parsed, true) AS label_parse_ok, coalesce(parsed, true) AS polygon_finite, coalesce(parsed AND in_range, true) AS coordinate_range_ok, coalesce(parsed AND cls_ok, true) AS class_id_ok,
    coalesce(n, 0) AS instance_count, coalesce(flat, 0) AS degenerate_polygon_count, coalesce(flat, 0) AS degenerate_bbox_count, round(coalesce(area, 0), 9) AS relative_polygon_area_sum, o_orderkey % 211 <> 0 AS valid_image,
    coalesce(parsed AND in_range AND cls_ok AND n > 0 AND flat = 0, false) AS valid_target
  FROM orders LEFT JOIN ag ON image = o_orderkey
)"""

ORACLES: dict[str, str] = {
    "q01_class_stats": """
WITH t AS (SELECT count(DISTINCT user_id) AS ai, count(*) AS an FROM events)
SELECT event_type AS class, count(DISTINCT user_id) AS images, count(*) AS instances, count(DISTINCT user_id) / any_value(ai) AS image_share, count(*) / any_value(an) AS instance_share,
  count(*) FILTER (value < 5) AS tiny, count(*) FILTER (value < 5) / count(*) AS tiny_share, quantile_cont(value, 0.5) AS median_area
FROM events, t GROUP BY event_type""",
    "q01_shape_stats": f"""
WITH {MEASURED}, l AS (SELECT m.*, area / 70000 AS rel, CASE WHEN s % 47 = 0 THEN '' ELSE 'class' || (n % 3) END AS label FROM measured m JOIN items i ON m.image = i.image AND m.gi = i.gi), t AS (SELECT count(DISTINCT image) AS ai, count(*) AS an FROM l)
SELECT label AS class, count(DISTINCT image) AS images, count(*) AS instances, count(*) FILTER (rel < 0.01::DOUBLE) AS tiny, 4.0::DOUBLE AS median_vertices, round(count(DISTINCT image) / any_value(ai), 9) AS image_share, round(count(*) / any_value(an), 9) AS instance_share,
  round(count(*) FILTER (rel < 0.01::DOUBLE) / count(*), 9) AS tiny_share, round(median(rel), 9) AS median_relative_area, round(median(w / h), 9) AS median_aspect FROM l, t GROUP BY label""",
    "q02_cooccurrence": """
WITH h AS (SELECT DISTINCT user_id, event_type FROM events), n AS (SELECT DISTINCT event_type AS c FROM events)
SELECT a.c AS class_a, b.c AS class_b, (SELECT count(*) FROM h x JOIN h y ON x.user_id = y.user_id WHERE x.event_type = a.c AND y.event_type = b.c) AS images FROM n a, n b""",
    "q03_describe": """
SELECT l_returnflag, count(l_extendedprice) AS n, min(l_extendedprice) AS lowest, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.75) AS p75,
  quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.95) AS p95, max(l_extendedprice) AS highest, round(avg(l_extendedprice), 4) AS mean
FROM lineitem GROUP BY l_returnflag""",
    "q04_instances_hist": "SELECT children, count(*) AS parents FROM (SELECT o_orderkey, count(l_orderkey) AS children FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey) GROUP BY children",
    "q05_exact_duplicates": f"WITH {EXACT} SELECT group_id, size, doc_id, h.sha256 FROM h JOIN zn ON h.sha256 = zn.sha256",
    "q06_near_pairs": near(6, 8, 0.98, "UNION ALL SELECT vec_id + 1000000, label, list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN i - 1 = vec_id % 7 THEN 0.03125::DOUBLE ELSE 0 END) FROM embeddings WHERE vec_id % 50 = 0"),
    "q06_near_pairs_relaxed": near(24, 64, 0.35),
    "q07_components": f"""
WITH RECURSIVE {PRINTS.format(copies='', on='a.vec_id < b.vec_id')}, {EXACT},
e0 AS (SELECT l AS a, r AS b FROM pairs WHERE pd <= 24 AND dd <= 64 AND corr >= 0.35 UNION ALL SELECT first, doc_id FROM h JOIN zn ON h.sha256 = zn.sha256 WHERE doc_id <> first),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
reach AS (SELECT DISTINCT a AS member, a AS other FROM e UNION SELECT r.member, e.b FROM reach r JOIN e ON r.other = e.a),
comp AS (SELECT member, min(other) AS component FROM reach GROUP BY member),
g AS (SELECT component, count(*) AS size, min(member) AS first FROM comp GROUP BY component),
gn AS (SELECT *, 'near_' || lpad(row_number() OVER (ORDER BY size DESC, first)::VARCHAR, 4, '0') AS group_id FROM g)
SELECT group_id, size, member FROM comp JOIN gn ON comp.component = gn.component""",
    "q08_consistency": f"""
WITH {EXACT},
s AS (SELECT doc_id, 'quality' || quality || ':1|toxic' || toxic || ':1' AS signature, 'quality' || quality || '|toxic' || toxic AS labels FROM labels),
j AS (SELECT group_id, signature IS NULL AS gone, coalesce(signature, '<NO_JSON>') AS signature, coalesce(labels, '<NO_JSON>') AS labels FROM h JOIN zn ON h.sha256 = zn.sha256 LEFT JOIN s ON h.doc_id = s.doc_id)
SELECT group_id, count(*) AS size, count(DISTINCT signature) AS signatures, count(DISTINCT labels) AS label_sets, count(*) FILTER (gone) AS missing, count(DISTINCT labels) > 1 AS label_mismatch,
  count(DISTINCT labels) = 1 AND count(DISTINCT signature) > 1 AS count_only_mismatch FROM j GROUP BY group_id""",
    "q09_pair_audit": """
SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'paired' END AS status
FROM (SELECT DISTINCT doc_id::VARCHAR AS k FROM documents) a FULL JOIN (SELECT DISTINCT doc_id::VARCHAR AS k FROM labels) b ON a.k = b.k""",
    "q10_numeric_runs": """
WITH i AS (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM (SELECT DISTINCT doc_id AS v FROM labels))
SELECT min(v) AS first, max(v) AS last, count(*) AS length FROM i GROUP BY g HAVING count(*) >= 3""",
    "q11_even_sample": """
WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)
SELECT doc_id, source, place FROM r WHERE place IN (SELECT (i * (n - 1)) // (least(20, n) - 1) FROM range(20) t(i), (SELECT count(*) AS n FROM documents))""",
    "q12_nearest_labeled": f"""
WITH {PRINTS.format(copies='', on='a.label IN (8, 9) AND b.label NOT IN (8, 9)')}, {NEAREST}
SELECT l AS left, r AS right, pd::INT AS phash_distance, dd::INT AS dhash_distance, round(corr, 6) AS correlation,
  CASE WHEN pd <= 6 AND dd <= 8 AND corr >= 0.98 THEN 'possible_missing_json' WHEN pd <= 12 AND dd <= 14 AND corr >= 0.95 THEN 'possible_missing_annotation' ELSE 'unknown' END AS hint FROM best""",
    "q13_polygon_metrics": f"WITH {MEASURED} SELECT image, gi, 4 AS vertices, area, w * h AS box_area, round(w / h, 6) AS aspect, round(area / 70000.0, 9) AS relative_area FROM measured",
    "q14_polygon_issues": f"""
WITH {RAW},
copied AS (SELECT *, false AS copy FROM shaped UNION ALL SELECT * REPLACE (gi + 100 AS gi), true FROM shaped WHERE gi % 5 = 1),
-- the points that are left, as far as they tell polygons of one document apart
keyed AS (SELECT *, row_number() OVER (PARTITION BY image, unlabelled, CASE WHEN unlabelled THEN 0 ELSE n % 3 END, x, y, w, CASE WHEN defect IN ('bow', 'two') THEN defect ELSE 'quad' END,
  CASE WHEN defect = 'two' THEN 0 ELSE h END, CASE WHEN defect = 'bow' THEN 0 ELSE t END ORDER BY gi) AS occurrence FROM copied),
issues AS (
  SELECT image, gi, 'empty_label' AS issue FROM keyed WHERE unlabelled UNION ALL SELECT image, gi, 'non_polygon_shape' FROM keyed WHERE rect
  UNION ALL SELECT image, gi, 'nan_or_inf_coordinate' FROM keyed WHERE defect = 'nan' UNION ALL SELECT image, gi, 'invalid_point_structure' FROM keyed WHERE defect = 'short'
  UNION ALL SELECT image, gi, 'fewer_than_3_unique_points' FROM keyed WHERE defect = 'two' UNION ALL SELECT image, gi, 'zero_area_polygon' FROM keyed WHERE defect IN ('two', 'bow')
  UNION ALL SELECT image, gi, 'self_intersection' FROM keyed WHERE defect = 'bow' UNION ALL SELECT image, gi, 'polygon_out_of_bounds' FROM keyed WHERE CASE WHEN defect = 'two' THEN out_two ELSE out_full END
  UNION ALL SELECT image, gi, 'duplicate_polygon' FROM keyed WHERE occurrence > 1
) SELECT * FROM issues""",
    "q14_conversion_rejects": f"""
WITH {RAW}
SELECT CASE WHEN rect THEN 'non_polygon' WHEN defect IN ('two', 'nan', 'short') THEN 'fewer_than_3_valid_points' WHEN defect = 'bow' THEN 'degenerate_polygon' WHEN out_full THEN 'coordinate_out_of_bounds' ELSE 'ok' END AS reason, count(*) AS shapes FROM shaped GROUP BY 1""",
    "q15_canonical_dups": f"""
WITH {ITEMS},
k AS (SELECT image, gi, concat_ws('|', CASE WHEN s % 47 = 0 THEN '' ELSE 'class' || (n % 3) END, q, disc, p % 40, s % 40, p % 5) AS key FROM items),
a AS (SELECT * FROM k UNION ALL SELECT image, gi + 100, key FROM k WHERE gi % 3 = 0)
SELECT * FROM (SELECT image, gi, row_number() OVER (PARTITION BY image, key ORDER BY gi)::INT AS occurrence FROM a) WHERE occurrence > 1""",
    "q16_split_profile": f"WITH {SPLIT} SELECT split, cls, images, instances FROM profiled",
    "q16_split_objective": f"""
WITH {SPLIT},
want AS (SELECT * FROM (VALUES ('train', 0.7::DOUBLE), ('val', 0.15::DOUBLE), ('test', 0.15::DOUBLE)) t(split, share)),
whole AS (SELECT * FROM profiled WHERE cls IS NULL), per AS (SELECT * FROM profiled WHERE cls IS NOT NULL),
sz AS (SELECT 800 * sum(pow(coalesce(images, 0) / (SELECT sum(images) FROM whole) - share, 2)) AS c FROM want LEFT JOIN whole ON want.split = whole.split),
sums AS (SELECT cls, sum(images) AS ai, sum(instances) AS an FROM per GROUP BY cls),
grid AS (SELECT s.cls, ai, an, w.split, share, coalesce(images, 0) AS i, coalesce(instances, 0) AS n FROM sums s CROSS JOIN want w LEFT JOIN per p ON p.split = w.split AND p.cls = s.cls),
cc AS (SELECT sum(pow((i - ai * share) / greatest(3.0, ai * share), 2)) + 0.35 * sum(pow((n - an * share) / greatest(3.0, an * share), 2)) AS c, 1000.0 * count(*) FILTER (i = 0) AS e FROM grid)
SELECT round(sz.c, 6) AS size_cost, round(cc.c, 6) AS class_cost, round(e, 6)::DOUBLE AS empty_cost, round(sz.c + cc.c + e, 6) AS cost FROM sz, cc""",
    "q17_train_only_bins": f"""
WITH {MEASURED},
qs AS (SELECT quantile_cont(area, 0.25) AS a, quantile_cont(area, 0.5) AS b, quantile_cont(area, 0.75) AS c FROM measured WHERE split = 'train'),
bins AS (SELECT split, CASE WHEN area <= a THEN 'tiny' WHEN area <= b THEN 'small' WHEN area <= c THEN 'medium' ELSE 'large' END AS bin FROM measured, qs),
grid AS (SELECT s.split, t.bin FROM (VALUES ('train'), ('val'), ('test')) s(split), (VALUES ('tiny'), ('small'), ('medium'), ('large')) t(bin))
SELECT g.split, g.bin, count(b.split) AS shapes FROM grid g LEFT JOIN bins b ON g.split = b.split AND g.bin = b.bin GROUP BY ALL""",
    "q18_greedy_match": boxed(greedy("m", "cand")) + " SELECT image, gt, pred, round(mask_iou, 9) AS mask_iou, round(box_iou, 9) AS box_iou FROM m",
    "q19_agnostic_match": boxed(
        greedy("m", "cand", where="true"),
        """
best_same AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, gt ORDER BY mask_iou DESC, pred) AS k FROM cand WHERE gt_cls = pred_cls) WHERE k = 1),
g2 AS (
  SELECT 'gt' AS side, g.cls, CASE WHEN m.gt_cls = m.pred_cls THEN 'TP' WHEN m.gt IS NOT NULL THEN 'wrong_class' WHEN b.gt IS NULL THEN 'FN_no_same_class_candidate' WHEN b.box_iou >= 0.5 THEN 'low_mask_iou' ELSE 'low_box_iou' END AS category
  FROM gt g LEFT JOIN m ON g.image = m.image AND g.gt = m.gt LEFT JOIN best_same b ON g.image = b.image AND g.gt = b.gt
), p2 AS (
  SELECT 'pred' AS side, p.cls, CASE WHEN m.gt_cls = m.pred_cls THEN 'TP' WHEN m.pred IS NOT NULL THEN 'wrong_class_FP' ELSE 'FP_unmatched' END AS category FROM pr p LEFT JOIN m ON p.image = m.image AND p.pred = m.pred
)""",
    ) + " SELECT side, cls, category, count(*) AS n FROM (SELECT * FROM g2 UNION ALL SELECT * FROM p2) GROUP BY ALL",
    "q20_threshold_sweep": SWEPT + " SELECT threshold, cls, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM swept",
    "q21_f1_best_recall95": SWEPT + """ SELECT max(threshold) FILTER (f1 >= (SELECT max(f1) FROM swept WHERE cls = -1) - 1e-12) AS best_f1_threshold, round(max(f1), 9) AS best_f1,
  max(threshold) FILTER (recall >= 0.95 * (SELECT max(recall) FROM swept WHERE cls = -1)) AS recall95_threshold FROM swept WHERE cls = -1""",
    "q22_fn_taxonomy": boxed(BASE, FN_LOW) + " SELECT image, gt, cls, category, pred, round(mask_iou, 9) AS mask_iou, round(box_iou, 9) AS box_iou, conf FROM fn",
    "q23_test_taxonomy": boxed(BASE, KEPT, FN_TEST, FALSE_ALARMS, TESTED) + " SELECT side, cls, category, count(*) AS n FROM tested GROUP BY ALL",
    "q23_image_categories": boxed(BASE, KEPT, FN_TEST, FALSE_ALARMS, TESTED, """
areas AS (SELECT image, gt, (mx2 - mx1) * (my2 - my1) AS area FROM gt),
median AS (SELECT quantile_cont(area, 0.5) AS q50 FROM areas WHERE image % 10 < 7),
cats AS (
  SELECT DISTINCT image, category FROM tested
  UNION SELECT image, 'TP' FROM tested WHERE category = 'POOR_MASK_BOUNDARY'
  UNION SELECT a.image, 'TINY_SMALL_MISS' FROM areas a JOIN missed m ON a.image = m.image AND a.gt = m.gt, median WHERE area <= q50
  UNION SELECT image, 'MULTI_DEFECT_SCENE' FROM gt GROUP BY image HAVING count(*) > 1
)""") + " SELECT category, count(*) AS images FROM cats GROUP BY 1",
    "q23_bottom_classes": boxed(BASE, KEPT, """
per AS (SELECT g.cls, g.n AS actual, coalesce(p.n, 0) AS predicted, coalesce(b.n, 0) AS tp FROM (SELECT cls, count(*) AS n FROM gt GROUP BY 1) g
  LEFT JOIN (SELECT cls, count(*) AS n FROM prk GROUP BY 1) p ON g.cls = p.cls LEFT JOIN (SELECT gt_cls AS cls, count(*) AS n FROM base GROUP BY 1) b ON g.cls = b.cls)""")
    + " SELECT * FROM (SELECT row_number() OVER (ORDER BY tp / actual, cls)::INT AS place, cls, tp, predicted - tp AS fp, actual - tp AS fn, round(tp / actual, 9) AS recall FROM per) WHERE place <= 2",
    "q24_hard_pool": POOLED + " SELECT image, fn, wrong, loc, fp, score, rank, is_hard FROM pool",
    "q25_hard_pool_presence": POOLED + " SELECT 'class' || g.cls AS label, count(DISTINCT p.image) AS images, min(score) AS lowest, max(score) AS highest FROM pool p JOIN gt g ON p.image = g.image WHERE is_hard GROUP BY 1",
    "q26_paired_deltas": f"WITH {RUNS} SELECT * FROM paired",
    "q27_decision_rule": f"""WITH {RUNS}
SELECT effect,
  CASE WHEN positive = 5 AND mean > 0 THEN 'HARD_MINING_STRONG_ROBUST_POSITIVE' WHEN positive >= 2 AND mean > 0 THEN 'HARD_MINING_ROBUST_POSITIVE' WHEN mean <= 0 AND positive <= 1 THEN 'HARD_MINING_NOT_CONFIRMED' ELSE 'HARD_MINING_UNSTABLE' END AS seeds,
  CASE WHEN positive >= 0.3::DOUBLE * (n * 2) THEN 'POSITIVE' WHEN positive >= 0.1::DOUBLE * (n * 2) THEN 'LIMITED' ELSE 'NEGATIVE' END AS recovery,
  CASE WHEN mean / 10 >= 0.005 AND highest >= lowest + 1 - 0.02 THEN 'POSITIVE_CANDIDATE' WHEN mean / 10 <= -0.005 THEN 'NEGATIVE' ELSE 'NO_CLEAR_GAIN' END AS delta,
  CASE WHEN highest > 0.505 AND mean >= lowest THEN 'POSITIVE' WHEN highest < 0.495 THEN 'NEGATIVE' ELSE 'NO_CLEAR_GAIN' END AS one_class,
  CASE WHEN highest > sd + 0.02 THEN 'POSITIVE_CANDIDATE' WHEN highest >= sd THEN 'TRADEOFF_ONLY' ELSE 'NEGATIVE' END AS second_stage,
  CASE WHEN mean > 0 AND lowest / 10 > -0.1 THEN 'SUPCON_POSITIVE' WHEN abs(mean) < 0.01 THEN 'NO_CLEAR_GAIN' ELSE 'NEGATIVE' END AS roi,
  CASE WHEN mean > 0 AND highest > 0.5 AND NOT lowest > 0 THEN 'CASE C AMP_ONLY_TRAIN_FORWARD_INSTABILITY'
       WHEN (NOT mean > 0 OR NOT highest > 0.5) AND n > 3 AND sd < 1 AND sd > 0 THEN 'CASE D GPU_FP32_RUNTIME_OR_KERNEL_ANOMALY'
       WHEN positive = 1 AND highest > 0.5 THEN 'CASE A EXP10_1A_FALSE_FP32_REPLAY'
       WHEN highest > 0.5 AND lowest > 0 AND positive > 1 THEN 'CASE B REPLAY_OR_PREPROCESS_PIPELINE_BUG'
       WHEN (NOT mean > 0 OR NOT highest > 0.5) AND n > 3 AND NOT sd < 1 THEN 'CASE E TRUE_FP32_MODEL_FORWARD_NONFINITE' END AS cause
FROM paired""",
    "q28_curve_audit": f"""WITH {CURVE}
SELECT count(*) AS rows, list_sort(list(epoch::INT)) = range(1, 31)::INT[] AS complete, count(*) FILTER (isnan(loss)) AS bad_rows, min(epoch) FILTER (isnan(loss)) AS first_bad,
  CASE WHEN count(*) FILTER (isnan(loss)) > 0 THEN 'loss' END AS first_bad_column, max(fitness) AS best, min(epoch) FILTER (fitness = (SELECT max(fitness) FROM curve)) AS best_epoch FROM curve""",
    "q29_first_nonfinite": f"""WITH {CURVE}, f AS (SELECT min(epoch) AS first FROM curve WHERE isnan(loss))
SELECT epoch, isnan(loss) AS bad, fitness, epoch - first AS offset FROM curve, f WHERE epoch BETWEEN first - 3 AND first + 3""",
    "q30_confusion": f"""
WITH {PRINTS.format(copies='', on='a.vec_id <> b.vec_id')}, {NEAREST},
cls AS (SELECT range::INT AS c FROM range(10)),
s AS (SELECT c, (SELECT count(*) FROM best WHERE ll = c) AS support, (SELECT count(*) FROM best WHERE rl = c) AS predicted, (SELECT count(*) FROM best WHERE ll = c AND rl = c) AS tp FROM cls),
r AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re, coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f FROM s)
SELECT c AS cls, support, round(pr, 9) AS precision, round(re, 9) AS recall, round(f, 9) AS f1, NULL::DOUBLE AS accuracy, NULL::DOUBLE AS macro_f1, NULL::DOUBLE AS weighted_f1 FROM r
UNION ALL SELECT NULL, sum(support)::BIGINT, NULL, NULL, NULL, round(sum(tp) / sum(support), 9), round(avg(f) FILTER (support + predicted > 0), 9), round(sum(f * support) / sum(support), 9) FROM r""",
    "q31_sampler_audit": f"""WITH {DRAWS}, k AS (SELECT draw // 32 AS batch, doc_id, count(*) AS n, count(*) FILTER (is_hard) AS h FROM drawn GROUP BY ALL)
SELECT batch, count(*) AS unique_keys, (sum(n) - count(*))::BIGINT AS duplicates, max(n) AS most, sum(h)::BIGINT AS hard FROM k GROUP BY batch""",
    "q31_draw_summary": f"""WITH {DRAWS}, a AS (SELECT count(*) FILTER (is_hard) AS n_hard, count(*) FILTER (NOT is_hard) AS n_normal FROM srows), b AS (SELECT count(*) AS draws, count(*) FILTER (is_hard) AS hard_draws FROM drawn)
SELECT n_hard, n_normal, draws, hard_draws, round(2 * n_hard / (2 * n_hard + n_normal), 9) AS expected FROM a, b""",
    "q32_registry_upsert": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders",
    "q33_language_audit": r"""
WITH c AS (SELECT doc_id, ['docs/exp01_run.md', 'docs/handoffs/a.md', 'README.md', 'docs/final_report.md', 'docs/other.md', 'notes/x.md'][doc_id % 6 + 1] AS path,
  len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]')) AS n_zh, len(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.+-]*')) AS n_en FROM documents),
r AS (SELECT *, n_zh / greatest(1, n_zh + n_en) AS zh, n_en / greatest(1, n_zh + n_en) AS en, regexp_matches(lower(path), 'docs/(exp\d|handoffs/|project_state|decision_log|historical_methods)|changelog') AS a,
  regexp_matches(lower(path), 'review|timeline|takeaways|index|final_|paper|readme|roadmap|project_scope') AS s FROM c),
n AS (SELECT *, (a OR s) AND en > 0.45 AS needs_translation, s AND en > 0.30 AS needs_rewrite FROM r)
SELECT doc_id, path, n_zh, n_en, CASE WHEN zh >= 0.70 THEN 'zh-dominant' WHEN en >= 0.70 THEN 'en-dominant' ELSE 'mixed' END AS language,
  CASE WHEN a THEN 'authoritative_experiment_or_gate' WHEN s THEN 'project_summary' ELSE 'supporting_document' END AS document_type, needs_translation, needs_rewrite,
  CASE WHEN needs_translation AND a THEN 'keep_original_create_zh_companion' WHEN needs_rewrite THEN 'keep_original_create_full_zh_reorganization' WHEN a OR s THEN 'keep_original_reference_from_zh_hub' ELSE 'keep_original_and_index' END AS action FROM n""",
    "q34_field_profile": """
WITH e AS (SELECT unnest(json_keys(props)) AS key, props FROM events), v AS (SELECT key, json_extract_string(props, '$.' || key) AS value FROM e)
SELECT key, CASE WHEN value IS NULL THEN 'null' WHEN regexp_full_match(value, '-?[0-9]+(\\.[0-9]+)?') THEN 'number' WHEN value IN ('true', 'false') THEN 'boolean' WHEN value[1] IN ('[', '{') THEN 'other' ELSE 'string' END AS kind,
  count(*) AS n, count(DISTINCT value) AS n_values, min(length(value))::INT AS shortest, max(length(value))::INT AS longest FROM v GROUP BY ALL""",
    "q35_config_diff": """
WITH b AS (SELECT 'part' || (l_partkey % 50) AS name, count(*) AS a, count(*) FILTER (l_linenumber <> 7) AS b, min(l_partkey) % 50 AS k FROM lineitem GROUP BY 1),
x AS (SELECT name, a::VARCHAR AS v FROM b WHERE k % 9 <> 0), y AS (SELECT name, (CASE WHEN k % 2 = 0 THEN a ELSE b END)::VARCHAR AS v FROM b WHERE k % 8 <> 0)
SELECT * FROM (SELECT coalesce(x.name, y.name) AS name, x.v AS a, y.v AS b, CASE WHEN y.name IS NULL THEN 'missing' WHEN x.name IS NULL THEN 'unexpected' WHEN x.v = y.v THEN 'equal' WHEN x.name IN ('part1', 'part3') THEN 'expected' ELSE 'different' END AS status
FROM x FULL JOIN y ON x.name = y.name) WHERE status <> 'equal'""",
    "q36_leakage_gate": f"""
WITH {SPLIT},
a AS (SELECT count(*) AS v FROM (SELECT sha FROM rows0 GROUP BY sha HAVING count(DISTINCT by_id) > 1)), b AS (SELECT count(*) AS v FROM (SELECT sha FROM rows0 GROUP BY sha HAVING count(DISTINCT split) > 1)),
c AS (SELECT count(*) AS v FROM (SELECT grp FROM rows0 GROUP BY grp HAVING count(DISTINCT split) > 1))
SELECT 'sha_by_id' AS "check", v AS violations, v = 0 AS passed FROM a UNION ALL SELECT 'sha_by_group', v, v = 0 FROM b UNION ALL SELECT 'group_by_group', v, v = 0 FROM c""",
    "q37_artifact_manifest": """
SELECT r.page_id, CASE WHEN p.page_id IS NULL THEN 'missing' WHEN coalesce(length(p.html), 0) = 0 THEN 'empty' WHEN NOT starts_with(p.html, '<!DOCTYPE html>') THEN 'bad_head' ELSE 'ok' END AS status
FROM (SELECT page_id * 2 AS page_id FROM pages) r LEFT JOIN pages p ON r.page_id = p.page_id""",
    "q39_negative_sampling": boxed("""
best AS (SELECT p.image, p.pred, p.conf, coalesce(max(box_iou), 0) AS best FROM pr p LEFT JOIN cand c ON p.image = c.image AND p.pred = c.pred WHERE p.conf >= 0.1 GROUP BY ALL),
part AS (SELECT *, CASE WHEN image % 10 < 7 THEN 'train' WHEN image % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM best WHERE best < 0.5),
pos AS (SELECT CASE WHEN image % 10 < 7 THEN 'train' WHEN image % 10 < 9 THEN 'val' ELSE 'test' END AS split, count(*) // 2 AS most FROM gt GROUP BY 1),
ranked AS (SELECT p.*, most, row_number() OVER (PARTITION BY p.split ORDER BY conf DESC, image, pred) AS k FROM part p JOIN pos ON p.split = pos.split)""")
    + " SELECT split, image, pred, conf, round(best, 9) AS best FROM ranked WHERE k <= most",
    "q40_state_tree": """
WITH t AS (SELECT vec_id, 'layer.' || vec_id || '.' || ['conv.weight', 'bn.bias', 'bn.running_mean', 'bn.num_batches_tracked', 'gamma', 'bn.running_var', 'bn.weight', 'head.weight'][vec_id % 8 + 1] AS name, list_transform(embedding, lambda x: CASE WHEN vec_id % 7 = 0 AND x > 0.25 THEN 'nan'::DOUBLE ELSE x::DOUBLE END) AS v FROM embeddings),
o AS (SELECT *, list_filter(v, lambda x: isfinite(x)) AS ok FROM t)
SELECT vec_id, name, ['conv_weight', 'bn_bias', 'bn_running_mean', 'bn_num_batches_tracked', 'other', 'bn_running_var', 'bn_weight', 'conv_weight'][vec_id % 8 + 1] AS category, len(ok) / len(v) AS finite_ratio, list_min(ok) AS lowest, list_max(ok) AS highest, round(list_sum(ok) / len(ok), 6) AS mean,
  (len(v) - len(ok))::INT AS n_nan, 0 AS n_inf FROM o""",
    "q42_label_lines": f"""
WITH {ITEMS} SELECT n % 3 AS class_id, NULL::VARCHAR AS problem, count(*) AS lines, 4 * count(*) AS points FROM items WHERE s % 47 <> 0 GROUP BY 1""",
    "q44_probe_rollup": """
WITH e AS (SELECT day(ts) AS day, event_type, event_id, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE value END AS loss FROM events)
SELECT day, event_type, count(*) AS batches, count(*) FILTER (isnan(loss)) AS non_finite, arg_min(loss, event_id) AS first_value FROM e GROUP BY ALL""",
    "q45_integrity": "SELECT o_orderkey, o_orderkey % 101 = 0 AS gone FROM orders WHERE o_orderkey % 101 = 0 OR (o_orderkey % 103 = 0 AND o_orderstatus <> 'X')",
    "q46_class_weights": "SELECT label, count(*) AS n, 1.0::DOUBLE AS total FROM embeddings GROUP BY label",
    "q47_pool_tie_rules": POOLED + " SELECT count(*) FILTER (is_hard) AS rule_b, count(*) FILTER (is_hard_desc) AS rule_a, count(*) FILTER (is_hard AND is_hard_desc) AS both FROM pool",
    "q49_grouped_recall": boxed(BASE) + """
SELECT CASE WHEN g.image % 10 < 7 THEN 'train' WHEN g.image % 10 < 9 THEN 'val' ELSE 'test' END AS split, g.cls, count(*) AS instances, count(mask_iou) AS hits, round(count(mask_iou) / count(*), 9) AS recall, round(avg(mask_iou), 6) AS mean_iou, round(quantile_cont(mask_iou, 0.5), 6) AS median_iou
FROM gt g LEFT JOIN base b ON g.image = b.image AND g.gt = b.gt GROUP BY ALL""",
    "q50_top_values": "SELECT props AS value, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1 ORDER BY n DESC, first LIMIT 20",
    "q48_table_digest": """
WITH r AS (SELECT sha256(concat_ws(chr(31), 'n_name=' || coalesce(n_name, '\\N'), 'n_nationkey=' || coalesce(n_nationkey::VARCHAR, '\\N'), 'n_regionkey=' || coalesce(n_regionkey::VARCHAR, '\\N'))) AS h FROM nation)
SELECT count(*) AS rows, sha256(concat_ws(':', count(*)::VARCHAR, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT)::VARCHAR, sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT)::VARCHAR,
  sum(('0x' || substr(h, 31, 15))::BIGINT::HUGEINT)::VARCHAR, sum(('0x' || substr(h, 46, 15))::BIGINT::HUGEINT)::VARCHAR)) AS digest FROM r""",
    "q39_background_boxes": boxed("""
imgs AS (SELECT DISTINCT image FROM gt), tries AS (SELECT image, range AS a FROM imgs, range(1, 21)),
sizes AS (SELECT row_number() OVER (ORDER BY image, gt) - 1 AS place, x2 - x1 AS w, y2 - y1 AS h, count(*) OVER () AS n FROM gt WHERE image % 10 < 7),
u AS (SELECT image, a, """ + ", ".join(f"('0x' || substr(md5('bg{k}:' || image || ':' || a), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u{k}" for k in "swhxy") + """ FROM tries),
s AS (SELECT u.*, greatest(8, floor(z.w * (0.8::DOUBLE + 0.4::DOUBLE * uw)))::BIGINT AS w, greatest(8, floor(z.h * (0.8::DOUBLE + 0.4::DOUBLE * uh)))::BIGINT AS h FROM u JOIN sizes z ON z.place = floor(us * z.n)::BIGINT),
b AS (SELECT image, a, w, h, floor(ux * (640 - w + 1))::BIGINT AS x1, floor(uy * (160 - h + 1))::BIGINT AS y1 FROM s), bb AS (SELECT *, x1 + w AS x2, y1 + h AS y2 FROM b),
hit AS (SELECT DISTINCT image, a FROM (SELECT b.image, b.a, b.w * b.h + (t.x2 - t.x1) * (t.y2 - t.y1) AS areas, greatest(0, least(b.x2, t.x2) - greatest(b.x1, t.x1)) * greatest(0, least(b.y2, t.y2) - greatest(b.y1, t.y1)) AS common
  FROM bb b JOIN gt t ON b.image = t.image) WHERE common >= 0.05::DOUBLE * (areas - common)),
free AS (SELECT b.*, row_number() OVER (PARTITION BY b.image ORDER BY b.a) AS place FROM bb b WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.image = b.image AND hit.a = b.a))""")
    + " SELECT image, place::INT AS place, x1, y1, x2, y2 FROM free WHERE place <= 2",
    "q43_two_stage": boxed(
        BASE,
        KEPT,
        """
probs AS (
  SELECT image, pred, cls, CASE WHEN cls = 1 THEN [round(1 - u, 6), round(u * 0.3, 6), round(u * 0.5, 6), round(u * 0.2, 6)] ELSE [round(1 - u, 6), round(u * 0.5, 6), round(u * 0.3, 6), round(u * 0.2, 6)] END AS p
  FROM (SELECT *, (conf * 7) % 1 AS u FROM prk)
), settings AS (SELECT * FROM (VALUES ('A'), ('B')) m(mode), (VALUES (0.3::DOUBLE), (0.45::DOUBLE)) t(threshold)),
second AS (
  SELECT mode, threshold, image, pred, CASE WHEN mode = 'A' THEN cls ELSE list_position(p, list_max(p)) - 2 END AS cls FROM probs, settings
  WHERE CASE WHEN mode = 'A' THEN 1 - p[1] >= threshold ELSE list_position(p, list_max(p)) > 1 AND list_max(p) >= threshold END
), again AS (SELECT s.mode, s.threshold, c.image, c.gt, c.pred, c.gt_cls, s.cls AS pred_cls, c.conf, c.mask_iou, c.box_iou FROM cand c JOIN second s ON c.image = s.image AND c.pred = s.pred)""",
        greedy("after", "again", "mode, threshold, image"),
        """
counts AS (
  SELECT mode, threshold, (SELECT count(*) FROM gt) AS actual, (SELECT count(*) FROM second s WHERE s.mode = x.mode AND s.threshold = x.threshold) AS predicted, (SELECT count(*) FROM after a WHERE a.mode = x.mode AND a.threshold = x.threshold) AS tp,
    (SELECT count(*) FROM base) AS eligible, (SELECT count(*) FROM base b JOIN after a ON a.image = b.image AND a.gt = b.gt WHERE a.mode = x.mode AND a.threshold = x.threshold) AS kept FROM settings x
)""",
    )
    + " SELECT mode, threshold, tp, predicted - tp AS fp, actual - tp AS fn, round(tp / predicted, 9) AS precision, round(tp / actual, 9) AS recall, round(2 * tp / (predicted + actual), 9) AS f1, eligible, kept, tp - kept AS corrected, eligible - kept AS harmed FROM counts",
    "q51_duplicate_context": f"""
WITH {SPLIT},
r AS (SELECT CASE WHEN starts_with(grp, 'group_') THEN grp END AS near, array_to_string(labels, '|') AS label_set, CASE WHEN list_contains(labels, 'toxic1') THEN 'wrong_class' WHEN list_contains(labels, 'quality0') THEN 'low_box_iou' ELSE 'TP' END AS category FROM rows0),
s AS (SELECT near, count(DISTINCT label_set) AS sets FROM r WHERE near IS NOT NULL GROUP BY near),
a AS (SELECT CASE WHEN r.near IS NULL THEN 'singleton' WHEN sets > 1 THEN 'near_cross_label' ELSE 'near_same_label' END AS duplicate_context, category FROM r LEFT JOIN s ON r.near = s.near)
SELECT c.duplicate_context, count(category) AS gt_instances, count(*) FILTER (category <> 'TP') AS errors, count(*) FILTER (category = 'wrong_class') AS wrong_class, coalesce(round(count(*) FILTER (category <> 'TP') / nullif(count(category), 0), 9), 0) AS error_rate
FROM (VALUES ('singleton'), ('near_same_label'), ('near_cross_label')) c(duplicate_context) LEFT JOIN a ON a.duplicate_context = c.duplicate_context GROUP BY 1""",
    "q52_value_profile": """
WITH v AS (SELECT json_type(props, '$.k') AS t, json_extract_string(props, '$.k') AS value FROM events),
k AS (SELECT CASE WHEN t IS NULL THEN 'missing' WHEN t IN ('UBIGINT', 'BIGINT') THEN 'bigint' WHEN t = 'VARCHAR' THEN 'string' ELSE lower(t) END AS type, value FROM v),
top AS (SELECT value, count(*) AS n FROM k WHERE type <> 'missing' GROUP BY 1 ORDER BY n DESC, value LIMIT 50)
SELECT 'type' AS part, type AS value, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'length', length(value)::VARCHAR, count(*) FROM k WHERE type = 'string' GROUP BY 2 UNION ALL SELECT 'value', value, n FROM top""",
    "q52_version_profile": """
WITH d AS (SELECT CASE WHEN o_orderstatus = 'P' THEN '<missing>' ELSE coalesce(o_orderstatus, '<missing>') END AS version, o_orderpriority AS label, CASE WHEN o_orderkey % 2 = 0 THEN '.jpg' ELSE '.png' END AS suffix, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS num FROM orders)
SELECT version, 'documents' AS part, NULL::VARCHAR AS value, count(*) AS n, NULL::BIGINT AS lowest, NULL::BIGINT AS highest FROM d GROUP BY 1
UNION ALL SELECT version, 'label', label, count(*), NULL, NULL FROM d GROUP BY 1, 3 UNION ALL SELECT version, 'suffix', suffix, count(*), NULL, NULL FROM d GROUP BY 1, 3
UNION ALL SELECT version, 'stem', NULL, count(num), min(num), max(num) FROM d WHERE num IS NOT NULL GROUP BY 1""",
    "q53_name_counts": """
WITH k AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'scan' WHEN 2 THEN 'x_y' || (o_orderkey % 5) ELSE 'none' END AS name, o_orderkey % 4 AS m FROM orders)
SELECT CASE WHEN m = 0 THEN 'numeric' ELSE 'prefix' END AS kind, name, count(*) AS n FROM k WHERE m < 3 GROUP BY 1, 2""",
    "q54_split_filter": f"""
WITH {SPLIT} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, doc_id, split, 2 * (row_number() OVER (ORDER BY doc_id) - 1) AS twice FROM rows0 WHERE split = 'val'""",
    "q55_pairing": """
WITH l AS (SELECT 's' || (o_custkey % 400) AS stem, 'd' || (o_orderkey % 40) AS parent, '3/' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT 's' || (o_custkey % 400) AS stem, 'd' || (o_orderkey % 40) AS parent, '4/' || o_orderkey AS path FROM orders WHERE o_orderkey % 4 <> 0),
l1 AS (SELECT *, count(*) OVER (PARTITION BY stem) AS ns, count(*) OVER (PARTITION BY stem, parent) AS np FROM l), r1 AS (SELECT *, count(*) OVER (PARTITION BY stem) AS ns, count(*) OVER (PARTITION BY stem, parent) AS np FROM r),
plain AS (SELECT l1.path AS left_path, r1.path AS right_path FROM l1 JOIN r1 ON l1.stem = r1.stem AND l1.ns = 1 AND r1.ns = 1)
SELECT * FROM plain UNION ALL
SELECT l1.path, r1.path FROM l1 JOIN r1 ON l1.stem = r1.stem AND l1.parent = r1.parent AND l1.np = 1 AND r1.np = 1 WHERE l1.path NOT IN (SELECT left_path FROM plain) AND r1.path NOT IN (SELECT right_path FROM plain)""",
    "q56_source_leak": f"""
WITH {SPLIT}, r AS (SELECT split, source FROM rows0 JOIN documents USING (doc_id)) SELECT DISTINCT source FROM r WHERE split = 'train' AND EXISTS (SELECT 1 FROM r b WHERE b.split = 'val' AND b.source IS NOT DISTINCT FROM r.source)""",
    "q57_unknown_labels": f"""
WITH {ITEMS}, l AS (SELECT CASE WHEN s % 47 <> 0 THEN 'class' || (n % 3) END AS label FROM items)
SELECT label, CASE WHEN label IS NULL THEN 'missing_or_null' ELSE 'present_non_null' END AS presence, count(*) AS n FROM l WHERE label IS NULL OR label NOT IN ('class0', 'class1') GROUP BY 1""",
    "q58_coverage": f"WITH {MEASURED} SELECT image, round(sum(area) / 70000.0, 9) AS coverage FROM measured GROUP BY image",
    "q58_label_counts": f"""
WITH {ITEMS}, c AS (SELECT image, count(DISTINCT n % 3) AS k FROM items GROUP BY 1), z AS (SELECT count(*) AS m FROM items GROUP BY n % 3)
SELECT (SELECT count(*) FROM c WHERE k = 1) AS single, (SELECT count(*) FROM c WHERE k > 1) AS multiple, (SELECT round(max(m) / min(m), 9) FROM z) AS imbalance""",
    "q59_one_class": f"WITH {ITEMS} SELECT image, count(*) FILTER (n % 3 = 1) AS instances, CASE WHEN count(*) FILTER (n % 3 = 1) > 0 THEN 0 END AS class_id FROM items GROUP BY image",
    "q60_latency": """
WITH i AS (SELECT o_orderkey AS k, o_totalprice::DOUBLE / 1000 AS ms FROM orders), c AS (SELECT l_orderkey AS k, l_quantity::DOUBLE AS ms FROM lineitem WHERE l_linenumber > 2), s AS (SELECT k, sum(ms) AS ms FROM c GROUP BY k),
a AS (SELECT i.ms, i.ms + coalesce(s.ms, 0) AS al FROM i LEFT JOIN s ON i.k = s.k)
SELECT round(avg(ms), 6) AS first_mean, round(median(ms), 6) AS first_median, round(avg(al), 6) AS all_mean, round(median(al), 6) AS all_median, (SELECT round(avg(ms), 6) FROM c) AS second_mean, (SELECT round(median(ms), 6) FROM c) AS second_median FROM a""",
    "q61_mask_iou": """
WITH b AS (SELECT p_partkey AS k, p_partkey % 20 AS x1, p_partkey % 15 AS y1, 25 + p_partkey % 38 AS x2, 18 + p_partkey % 29 AS y2, p_partkey % 2 AS dy FROM part),
a AS (SELECT *, (least(x2 + 1, 63) - x1) AS wb, (least(y2 + dy, 47) - y1 - dy + 1) AS hb FROM b),
c AS (SELECT k, (x2 - x1 + 1) * (y2 - y1 + 1) AS na, (least(x2 + 1, 63) - (x1 + 1) + 1) * hb AS nb, (x2 - (x1 + 1) + 1) * (y2 - (y1 + dy) + 1) AS common FROM a)
SELECT k, round(common / (na + nb - common), 9) AS iou FROM c""",
    "q62_padded_boxes": boxed("""
s AS (SELECT image, gt, x1, y1, x2, y2, greatest(1.2::DOUBLE * (x2 - x1), 2) AS w, greatest(1.2::DOUBLE * (y2 - y1), 2) AS h FROM gt)""")
    + " SELECT image, gt, greatest(0, round_even((x1 + x2) / 2 - w / 2, 0))::INT AS x1, greatest(0, round_even((y1 + y2) / 2 - h / 2, 0))::INT AS y1, least(500, round_even((x1 + x2) / 2 + w / 2, 0))::INT AS x2, least(140, round_even((y1 + y2) / 2 + h / 2, 0))::INT AS y2 FROM s",
    "q63_tensor_diff": """
WITH s AS (SELECT label, CASE WHEN vec_id % 13 = 0 THEN CASE WHEN vec_id % 11 <> 0 THEN 'missing' END WHEN vec_id % 11 = 0 THEN 'unexpected' WHEN vec_id % 3 = 0 THEN 'different' WHEN vec_id % 17 = 0 THEN 'shape_mismatch' ELSE 'exact' END AS status FROM embeddings),
x AS (SELECT * FROM s WHERE status IS NOT NULL AND status <> 'exact')
SELECT 'status' AS "grouping", status AS value, count(*) AS n FROM x GROUP BY 2 UNION ALL SELECT 'label', label::VARCHAR, count(*) FROM x GROUP BY 2""",
    "q63_state_tree": """
SELECT event_id, 'a' AS path, event_type AS value FROM events UNION ALL SELECT event_id, 'b.0.u', user_id::VARCHAR FROM events UNION ALL SELECT event_id, 'b.1.u', (event_id % 7)::VARCHAR FROM events""",
    "q64_metrics_long": """
SELECT n_nationkey, 'Box_P' AS metric, round(n_nationkey / 25, 9) AS value FROM nation UNION ALL SELECT n_nationkey, 'Box_R', round(n_regionkey / 5, 9) FROM nation
UNION ALL SELECT n_nationkey, 'Mask_P', round(n_nationkey / 50, 9) FROM nation UNION ALL SELECT n_nationkey, 'Mask_R', round(n_regionkey / 10, 9) FROM nation""",
    "q65_counters": boxed("""
c AS (SELECT image, 'class' || cls AS label, count(*) AS n FROM gt GROUP BY 1, 2),
e AS (SELECT image, '{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}' AS counts FROM c GROUP BY 1)""")
    + " SELECT c.image, label, n, counts, (SELECT max(x2) FROM gt WHERE gt.image = c.image)::DOUBLE AS right FROM c JOIN e ON c.image = e.image",
    "q66_freeze_checks": f"""
WITH {SPLIT},
m AS (SELECT doc_id AS stem, by_id AS split, sha, grp FROM rows0), l AS (SELECT stem, split, stem % 3 AS c, stem % 101 = 1 AS bad FROM m WHERE stem % 97 <> 0),
p AS (SELECT m.split, count(DISTINCT m.stem) AS i, count(DISTINCT l.stem) AS n FROM m LEFT JOIN l ON m.stem = l.stem GROUP BY 1),
v AS (SELECT 'pair_count' AS "check", (SELECT count(*) FROM p WHERE i <> n) AS violations UNION ALL SELECT 'missing_label', (SELECT count(*) FROM m WHERE stem % 97 = 0) UNION ALL SELECT 'invalid_label', (SELECT count(*) FROM l WHERE bad)
  UNION ALL SELECT 'sha256_leakage', (SELECT count(*) FROM (SELECT sha FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1)) UNION ALL SELECT 'group_leakage', (SELECT count(*) FROM (SELECT grp FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1))
  UNION ALL SELECT 'overlay_class_coverage', 1)
SELECT "check", violations, violations = 0 AS passed FROM v""",
    "q67_training_rows": TRAINING + " SELECT * FROM trained",
    "q67_training_summary": TRAINING + """
SELECT count(*) FILTER (NOT valid_image) AS invalid_images, count(*) FILTER (NOT valid_target) AS invalid_targets, count(*) FILTER (is_hard AND NOT valid_image) AS hard_invalid_images, count(*) FILTER (is_hard AND NOT valid_target) AS hard_invalid_targets FROM trained""",
    "q68_gate_chain": """
SELECT * FROM (VALUES (0, 'no_negative_key', '0', (SELECT count(*) FILTER (o_orderkey < 0) FROM orders)::VARCHAR, 'passed'), (1, 'unique_keys', 'true', (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders)::VARCHAR, 'passed'),
  (2, 'equal_steps', 'true', 'false', 'failed'), (3, 'equal_images', 'true', 'true', 'not_reached')) t(place, gate, expected, found, status)""",
    "q69_reproduction": """
WITH e AS (SELECT DISTINCT day(ts) AS epoch FROM events)
SELECT epoch, CASE WHEN epoch % 7 = 0 THEN 'loss' ELSE '' END AS bad_a, CASE WHEN epoch <> 5 THEN CASE WHEN epoch % 7 = 0 AND epoch % 14 <> 0 THEN 'loss' ELSE '' END END AS bad_b FROM e WHERE epoch = 5 OR epoch % 14 = 0""",
    "q70_conflict_review": boxed("""
g AS (SELECT o_custkey AS group_id, gt.* FROM gt JOIN orders ON o_orderkey = image),
per AS (SELECT group_id, image, 'class' || cls AS label, count(*) AS n FROM g GROUP BY ALL),
mem AS (SELECT group_id, image, string_agg(label, '|' ORDER BY label) AS class_set, string_agg(label || ':' || n, '|' ORDER BY label) AS signature, list(label ORDER BY label) AS labels FROM per GROUP BY ALL),
ctr AS (SELECT group_id, image, avg((x1 + x2) / 1000) AS x, avg((y1 + y2) / 280) AS y FROM g GROUP BY ALL),
spread AS (SELECT a.group_id, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS spread FROM ctr a JOIN ctr b ON a.group_id = b.group_id GROUP BY 1),
sub AS (SELECT DISTINCT a.group_id FROM mem a JOIN mem b ON a.group_id = b.group_id WHERE list_has_all(b.labels, a.labels) AND len(b.labels) > len(a.labels)),
z AS (SELECT group_id, count(*) AS member_count, string_agg(image::VARCHAR, '|' ORDER BY image::VARCHAR) AS members, array_to_string(list_sort(list(DISTINCT class_set)), ';') AS class_sets, array_to_string(list_sort(list(DISTINCT signature)), ';') AS annotation_signatures,
  min(image % 6) AS min_phash_distance, max(image % 6) AS max_phash_distance, min(image % 9) AS min_dhash_distance, max(image % 9) AS max_dhash_distance, round(min(0.98::DOUBLE + image % 3 / 100), 6) AS min_correlation, round(max(0.98::DOUBLE + image % 3 / 100), 6) AS max_correlation
  FROM mem GROUP BY 1 HAVING count(DISTINCT class_set) > 1)""") + """
SELECT z.*, CASE WHEN spread <= 0.12 THEN 'LIKELY' ELSE 'UNCERTAIN' END AS same_defect_location_program_hint, round(spread, 6) AS normalized_mean_centroid_spread,
  CASE WHEN sub.group_id IS NOT NULL THEN 'POSSIBLE' ELSE 'NOT_INFERRED' END AS one_image_seems_incompletely_annotated_program_hint, 'PENDING_HUMAN_REVIEW' AS human_group_decision
FROM z JOIN spread ON z.group_id = spread.group_id LEFT JOIN sub ON z.group_id = sub.group_id""",
    "q71_document_issues": """
WITH k AS (SELECT o_orderkey AS k FROM orders)
SELECT 'shapes_not_list' AS issue, NULL::INT AS shape_index, count(*) AS n FROM k WHERE k % 5 IN (0, 2) HAVING count(*) > 0
UNION ALL SELECT 'shape_not_object', i, count(*) FROM k, (VALUES (1), (2)) t(i) WHERE k % 5 = 1 GROUP BY i
UNION ALL SELECT 'image_dimension_mismatch', NULL, count(*) FROM k WHERE k % 3 <> 0 AND k % 4 <> 2 HAVING count(*) > 0""",
    "q72_paths": """
SELECT page_id, page_id % 3 <> 1 AS absolute, CASE page_id % 3 WHEN 0 THEN 'IMG' || page_id WHEN 1 THEN 'report' || page_id ELSE page_id::VARCHAR END AS stem, CASE page_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.md' ELSE '' END AS suffix,
  CASE page_id % 3 WHEN 0 THEN '/data/labels/IMG' || page_id || '.txt' WHEN 1 THEN 'docs/report' || page_id || '.txt' ELSE 'C:\\x\\' || page_id END AS label_path, CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'document' ELSE 'other' END AS kind FROM pages""",
    "q73_records": """
SELECT k, sha256('float32|2,3|abc') AS digest, '{"k":' || k || ',"v":"NaN","w":"-Infinity"}' AS record FROM (SELECT max(o_orderkey) FILTER (o_orderkey % 3 = 0) AS k FROM orders)""",
    "q74_number_violations": """
SELECT o_orderkey, 'a' AS "column", 'n/a' AS value FROM orders WHERE o_orderkey % 17 = 0 UNION ALL SELECT o_orderkey, 'b', '' FROM orders WHERE o_orderkey % 19 = 0""",
}
