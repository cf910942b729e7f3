"""Named queries over the driver's tables, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scores as s
from ..functions import text as t
from ..operators import boxes as bx
from ..operators import curation as cu
from ..operators import entities as en
from ..operators import evaluation as ev
from ..operators import routing as ro
from ..schemas import ALLOWED, FIELD_GROUPS, LABELS, label_table
from ..sources.files import label_files, original_files
from ..storage import store
from . import inputs as i

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _size():
    return F.lit(i.WIDTH), F.lit(i.HEIGHT)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Key-information extraction


@query(f"WITH {i.LOGITS} SELECT vec_id, pred_id, round(score, 6) AS score FROM preds")
def kie_softmax_argmax(spark, d):
    p = s.softmax(F.col("logits"))
    return i.logits(spark, d).withColumn("p", p).select("vec_id", s.argmax(F.col("p")).alias("pred_id"), F.round(F.array_max("p"), 6).alias("score"))


@query(f"WITH {i.LOGITS}, first AS (SELECT image_id, token_idx // 3 AS word_id, pred_id, score, row_number() OVER (PARTITION BY image_id, token_idx // 3 ORDER BY token_idx) AS rn FROM preds WHERE vec_id % 7 <> 0) SELECT image_id, word_id, pred_id, round(score, 6) AS score FROM first WHERE rn = 1")
def kie_first_subtoken(spark, d):
    tokens = i.logits(spark, d).withColumn("word_id", F.when(F.col("vec_id") % 7 != 0, F.floor(F.col("token_idx") / 3).cast("int")))
    return en.first_subtoken(en.score_tokens(tokens)).select("image_id", "word_id", "pred_id", F.round("score", 6).alias("score"))


_WORDS = "words AS (SELECT image_id, b AS box_idx, CASE WHEN (image_id + b) % 5 = 0 THEN ' ' ELSE 'w' || b END AS text FROM (SELECT DISTINCT image_id FROM preds), range(6) r(b))"


@query(
    f"WITH {i.LOGITS}, {_WORDS}, valid AS (SELECT image_id, box_idx, row_number() OVER (PARTITION BY image_id ORDER BY box_idx) - 1 AS w FROM words WHERE trim(text) <> ''), "
    "first AS (SELECT image_id, token_idx // 3 AS w, arg_min(pred_id, token_idx) AS pred_id, arg_min(score, token_idx) AS score FROM preds GROUP BY ALL) "
    "SELECT words.image_id, CAST(words.box_idx AS INT) AS box_idx, words.text, CAST(coalesce(f.pred_id, 12) AS INT) AS pred_id, round(coalesce(f.score, 0), 6) AS score FROM words LEFT JOIN valid USING (image_id, box_idx) LEFT JOIN first f ON f.image_id = words.image_id AND f.w = valid.w"
)
def kie_word_left_default(spark, d):
    scored = en.score_tokens(i.logits(spark, d).withColumn("word_id", F.floor(F.col("token_idx") / 3).cast("int")))
    words = scored.select("image_id").distinct().withColumn("box_idx", F.explode(F.sequence(F.lit(0), F.lit(5))))
    words = words.withColumn("text", F.when((F.col("image_id") + F.col("box_idx")) % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("w"), "box_idx")))
    return en.predictions_of_words(words, en.first_subtoken(scored)).select("image_id", "box_idx", "text", "pred_id", F.round("score", 6).alias("score"))


_LABEL_VALUES = "lab(label_id, label) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in enumerate(LABELS)) + "), named AS (SELECT image_id, token_idx, vec_id, score, lab.label FROM preds JOIN lab ON pred_id = label_id)"
_KIE = f"{i.TOKEN_LOGITS}, {_LABEL_VALUES}"
_KEPT = "score >= 0.5 AND label <> 'OTHER' AND NOT ends_with(label, '_PREFIX')"
_ALLOWED = f"{_KEPT} AND label IN ({', '.join(repr(x) for x in ALLOWED)})"


def _labelled(spark, d):
    words = en.score_tokens(i.token_logits(spark, d)).select("image_id", F.col("token_idx").alias("idx"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("text"), "pred_id", "score")
    return en.label_words(words, label_table(spark))


@query(f"WITH {_KIE} SELECT image_id, token_idx AS idx, label, round(score, 6) AS score FROM named")
def kie_labels(spark, d):
    return _labelled(spark, d).select("image_id", "idx", "label", F.round("score", 6).alias("score"))


@query(f"WITH {_KIE} SELECT image_id, token_idx AS idx, label, 't' || vec_id AS text, round(score, 6) AS score FROM named WHERE {_ALLOWED}")
def kie_entities_filter(spark, d):
    return en.keep_entities(_labelled(spark, d)).select("image_id", "idx", "label", "text", F.round("score", 6).alias("score"))


@query(f"WITH {_KIE} SELECT image_id, label, string_agg('t' || vec_id, ' ' ORDER BY token_idx) AS value, round(avg(score), 6) AS mean_score FROM named WHERE {_KEPT} GROUP BY ALL")
def kie_extract(spark, d):
    """Flagship: logits to joined fields with their mean confidence."""
    kept = en.keep_entities(_labelled(spark, d), allowed=None)
    return kept.groupBy("image_id", "label").agg(F.array_join(en.in_order(t.strip_text(F.col("text")), F.col("idx")), " ").alias("value"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("SELECT conv_id AS image_id, role AS label, string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY turn) AS value FROM conversations WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY ALL")
def kie_extract_joined(spark, d):
    rows = i.table(spark, d, "conversations").select(F.col("conv_id").alias("image_id"), F.col("role").alias("label"), F.col("turn").alias("idx"), "text")
    return en.joined_by_label(rows).select("image_id", "label", "value")


_FIELDS = (
    "fields AS (SELECT image_id, regexp_replace(label, '_PREFIX$', '') AS base, coalesce(string_agg('t' || vec_id, ' ' ORDER BY token_idx) FILTER (NOT ends_with(label, '_PREFIX')), '') AS value, "
    "coalesce(string_agg('t' || vec_id, ' ' ORDER BY token_idx) FILTER (ends_with(label, '_PREFIX')), '') AS prefix, coalesce(avg(score) FILTER (NOT ends_with(label, '_PREFIX')), avg(score) FILTER (ends_with(label, '_PREFIX'))) AS confidence "
    "FROM named WHERE score >= 0.5 AND label <> 'OTHER' GROUP BY ALL)"
)


@query(f"WITH {_KIE}, {_FIELDS} SELECT * REPLACE (round(confidence, 6) AS confidence) FROM fields")
def kie_mean_conf_fallback(spark, d):
    return en.values_and_prefixes(_labelled(spark, d)).withColumn("confidence", F.round("confidence", 6))


_GROUPS = "grp(base, field_group, group_pos, field_pos) AS (VALUES " + ", ".join(f"('{f}', '{name}', {g_}, {k})" for g_, (name, fields) in enumerate(FIELD_GROUPS.items()) for k, f in enumerate(fields)) + ")"
_DASH = "CASE WHEN {v} = '' THEN '-' WHEN length({v}) > {n} THEN left({v}, {n} - 3) || '...' ELSE {v} END"


@query(
    f"WITH {_KIE}, {_FIELDS}, {_GROUPS}, body AS (SELECT image_id, coalesce(group_pos, {len(FIELD_GROUPS)}) AS group_pos, 1 AS level, coalesce(field_pos, 0) AS field_pos, base AS field, "
    f"{_DASH.format(v='prefix', n=24)} AS prefix, {_DASH.format(v='value', n=42)} AS value, printf('%.2f', confidence) AS conf, coalesce(field_group, 'Other fields') AS field_group FROM fields LEFT JOIN grp USING (base)), "
    "every AS (SELECT * EXCLUDE (field_group) FROM body UNION ALL SELECT DISTINCT image_id, group_pos, 0, 0, field_group, '', '', '' FROM body) "
    "SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY group_pos, level, field_pos, field) AS INT) AS row, field, prefix, value, conf FROM every"
)
def kie_report_rows(spark, d):
    return en.report_rows(en.values_and_prefixes(_labelled(spark, d)), label_table(spark))


@query(
    f"WITH {_KIE}, kept AS (SELECT image_id, token_idx, label, 't' || vec_id AS text FROM named WHERE {_ALLOWED}), per AS (SELECT image_id, label, min(token_idx) AS place, list(text ORDER BY token_idx) AS texts FROM kept GROUP BY ALL), "
    "lists AS (SELECT image_id, '[' || string_agg('{\"' || label || '\":\"' || text || '\"}', ',' ORDER BY token_idx) || ']' AS entities FROM kept GROUP BY ALL) "
    "SELECT image_id, any_value(entities) AS entities, '{' || string_agg('\"' || label || '\":[\"' || array_to_string(texts, '\",\"') || '\"]', ',' ORDER BY place) || '}' AS texts, "
    "'{' || string_agg('\"' || label || '\":\"' || array_to_string(texts, ' ') || '\"', ',' ORDER BY place) || '}' AS joined FROM per JOIN lists USING (image_id) GROUP BY image_id"
)
def kie_entity_maps(spark, d):
    return en.entity_maps(en.keep_entities(_labelled(spark, d))).select("image_id", F.to_json("entities").alias("entities"), F.to_json("texts").alias("texts"), F.to_json("joined").alias("joined"))


# Boxes

_CLIP = "greatest(0, least(CAST(round_even({v}, 0) AS INT), {most}))"


def _clip_sql(x1, y1, x2, y2):
    parts = [_CLIP.format(v=v, most=m) for v, m in ((x1, i.WIDTH - 1), (y1, i.HEIGHT - 1), (x2, i.WIDTH), (y2, i.HEIGHT))]
    return f"least({parts[0]}, {parts[2]}) AS x1, least({parts[1]}, {parts[3]}) AS y1, greatest({parts[0]}, {parts[2]}) AS x2, greatest({parts[1]}, {parts[3]}) AS y2"


@query(f"WITH {i.BOXES} SELECT image_id, box_idx, {_clip_sql('x1', 'y1', 'x2', 'y2')} FROM boxes")
def box_clip_round(spark, d):
    return i.boxes(spark, d).select("image_id", "box_idx", *(v.alias(k) for k, v in g.clip_box(bx.CORNERS, *_size()).items()))


@query(f"WITH {i.BOXES}, grown AS (SELECT image_id, box_idx, x1 - (x2 - x1) * 0.01e0 AS a, y1 - (y2 - y1) * 0.02e0 AS b, x2 + (x2 - x1) * 0.01e0 AS c, y2 + (y2 - y1) * 0.02e0 AS d, conf FROM boxes WHERE conf >= 0.08e0), clipped AS (SELECT image_id, box_idx, {_clip_sql('a', 'b', 'c', 'd')} FROM grown) SELECT *, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS area FROM clipped WHERE greatest(0, x2 - x1) * greatest(0, y2 - y1) >= 16")
def box_expand_area(spark, d):
    out = bx.postprocess(i.boxes(spark, d).withColumns({"width": F.lit(i.WIDTH), "height": F.lit(i.HEIGHT)}))
    return out.select("image_id", "box_idx", *bx.CORNERS, g.box_area(bx.CORNERS).alias("area"))


@query(f"WITH {i.BOXES} SELECT image_id, box_idx, " + ", ".join(f"CAST(least(1000, greatest(0, trunc(1000 * {c} / {m}))) AS INT) AS n{c}" for c, m in zip(bx.CORNERS, (i.WIDTH, i.HEIGHT, i.WIDTH, i.HEIGHT))) + " FROM boxes")
def box_norm1000(spark, d):
    return i.boxes(spark, d).select("image_id", "box_idx", *(v.alias(k) for k, v in g.normalize_box(bx.CORNERS, *_size()).items()))


_CLAMP = "CAST(least(1000, greatest(0, trunc({v}))) AS INT)"
_STORED = ("x1 - 100", "y1", "x2 + 300.75e0", "-y2")


@query(
    f"WITH {i.BOXES} SELECT image_id, box_idx, CASE WHEN box_idx % 2 = 0 THEN [{', '.join(_CLAMP.format(v=v) for v in _STORED)}] "
    f"ELSE [{', '.join(_CLAMP.format(v=f'1000 * {c} / {m}') for c, m in zip(bx.CORNERS, (i.WIDTH, i.HEIGHT, i.WIDTH, i.HEIGHT)))}] END AS box FROM boxes"
)
def box_stored_or_computed(spark, d):
    """Normalized boxes as an OCR document stores them, clamped; computed ones where it stores none."""
    stored = F.when(F.col("box_idx") % 2 == 0, F.array(F.array(*(F.expr(v.replace("e0", "D")) for v in _STORED))))
    computed = F.array(F.array(*g.normalize_box(bx.CORNERS, *_size()).values()))
    return i.boxes(spark, d).select("image_id", "box_idx", F.element_at(g.stored_or_computed(stored, computed), 1).alias("box"))


_YOLO = ", ".join(f"least(1e0, greatest(0e0, {e})) AS {n}" for n, e in (("xc", f"(x1 + x2) / 2e0 / {i.WIDTH}"), ("yc", f"(y1 + y2) / 2e0 / {i.HEIGHT}"), ("w", f"(x2 - x1) / {i.WIDTH}"), ("h", f"(y2 - y1) / {i.HEIGHT}")))
_BACK = ", ".join(f"greatest(0, least({m}, CAST(trunc(({a} {o} {b} / 2) * {m}) AS INT))) AS {n}" for n, a, o, b, m in (("x1", "xc", "-", "w", i.WIDTH), ("y1", "yc", "-", "h", i.HEIGHT), ("x2", "xc", "+", "w", i.WIDTH), ("y2", "yc", "+", "h", i.HEIGHT)))


@query(f"WITH {i.BOXES}, y AS (SELECT image_id, box_idx, {_YOLO} FROM boxes), back AS (SELECT image_id, box_idx, {_BACK} FROM y) SELECT * FROM back WHERE x2 > x1 AND y2 > y1")
def box_yolo_roundtrip(spark, d):
    y = i.boxes(spark, d).select("image_id", "box_idx", *(v.alias(k) for k, v in g.yolo_fields(bx.CORNERS, *_size()).items()))
    back = g.yolo_pixels(F.col("xc"), F.col("yc"), F.col("w"), F.col("h"), *_size())
    return y.select("image_id", "box_idx", *(v.alias(k) for k, v in back.items())).where("x2 > x1 AND y2 > y1")


@query(f"WITH {i.BOXES}, y AS (SELECT image_id, box_idx, cls_id, {_YOLO} FROM boxes) SELECT image_id, box_idx, printf('%d %.6f %.6f %.6f %.6f', cls_id, xc, yc, w, h) AS line FROM y")
def box_yolo_text(spark, d):
    b = i.boxes(spark, d)
    return b.select("image_id", "box_idx", g.yolo_line(F.col("cls_id"), g.yolo_fields(bx.CORNERS, *_size())).alias("line"))


@query(f"WITH {i.BOXES}, y AS (SELECT image_id, box_idx, cls_id, {_YOLO} FROM boxes WHERE conf >= 0.05) SELECT 'labels/' || o_orderkey || '.txt' AS name, coalesce(string_agg(printf('%d %.6f %.6f %.6f %.6f', cls_id, xc, yc, w, h) || chr(10), '' ORDER BY box_idx), '') AS content FROM orders LEFT JOIN y ON image_id = o_orderkey GROUP BY o_orderkey")
def box_label_files(spark, d):
    sure = i.boxes(spark, d).where("conf >= 0.05").withColumns(dict(zip(("width", "height"), _size())))
    return label_files(sure, i.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id")))


_PAIR = (
    "pairs AS (SELECT a.image_id, a.box_idx AS a, b.box_idx AS b, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1, greatest(a.x2, b.x2) AS x2, greatest(a.y2, b.y2) AS y2, greatest(a.conf, b.conf) AS conf, CASE WHEN a.conf >= b.conf THEN a.cls_id ELSE b.cls_id END AS cls_id "
    "FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_idx < b.box_idx WHERE greatest(a.y2 - a.y1, b.y2 - b.y1) > 0 "
    "AND abs((a.y1 + a.y2) / 2e0 - (b.y1 + b.y2) / 2e0) <= 0.30e0 * greatest(a.y2 - a.y1, b.y2 - b.y1) "
    "AND greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) <= 0.50e0 * least(a.x2 - a.x1, b.x2 - b.x1) "
    "AND greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) <= 0.25e0 * greatest(a.y2 - a.y1, b.y2 - b.y1))"
)


@query(f"WITH {i.BOXES}, {_PAIR} SELECT image_id, a, b FROM pairs")
def box_merge_pairs(spark, d):
    return bx.line_pairs(i.boxes(spark, d))


@query(f"WITH {i.BOXES}, {_PAIR} SELECT * FROM pairs")
def box_merge_two(spark, d):
    return bx.merged_pairs(i.boxes(spark, d))


# One step tests the next waiting box against the line; then the line starts another pass or is done.
_LINES = (
    "walk AS (SELECT image_id, list({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': conf::DOUBLE, 'cls_id': cls_id} ORDER BY y1, x1, box_idx) AS wait, wait[1:0] AS left_, wait[1:0] AS done, CAST(NULL AS STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, conf DOUBLE, cls_id INT)) AS cur, false AS grew FROM boxes GROUP BY image_id "
    "UNION ALL SELECT image_id, CASE WHEN len(wait) > 0 THEN wait[2:] ELSE left_ END, "
    "CASE WHEN cur IS NULL THEN left_ WHEN len(wait) = 0 THEN left_[1:0] WHEN joins THEN left_ ELSE list_append(left_, b) END, "
    "CASE WHEN len(wait) = 0 AND NOT grew THEN list_append(done, cur) ELSE done END, "
    "CASE WHEN cur IS NULL THEN b WHEN len(wait) = 0 AND NOT grew THEN NULL WHEN joins THEN {'x1': least(cur.x1, b.x1), 'y1': least(cur.y1, b.y1), 'x2': greatest(cur.x2, b.x2), 'y2': greatest(cur.y2, b.y2), 'conf': greatest(cur.conf, b.conf), 'cls_id': CASE WHEN cur.conf >= b.conf THEN cur.cls_id ELSE b.cls_id END} ELSE cur END, "
    "CASE WHEN cur IS NULL OR len(wait) = 0 THEN false ELSE grew OR joins END FROM ("
    "SELECT *, coalesce(cur IS NOT NULL AND greatest(cur.y2 - cur.y1, b.y2 - b.y1) > 0 AND abs((cur.y1 + cur.y2) / 2e0 - (b.y1 + b.y2) / 2e0) <= 0.30e0 * greatest(cur.y2 - cur.y1, b.y2 - b.y1) "
    "AND greatest(0, least(cur.x2, b.x2) - greatest(cur.x1, b.x1)) <= 0.50e0 * least(cur.x2 - cur.x1, b.x2 - b.x1) "
    "AND greatest(0, greatest(cur.x1, b.x1) - least(cur.x2, b.x2)) <= 0.25e0 * greatest(cur.y2 - cur.y1, b.y2 - b.y1), false) AS joins FROM (SELECT *, wait[1] AS b FROM walk WHERE cur IS NOT NULL OR len(wait) > 0))), "
    "lines AS (SELECT image_id, unnest(done) AS l, generate_subscripts(done, 1) AS place FROM walk WHERE cur IS NULL AND len(wait) = 0)"
)


@query(f"WITH RECURSIVE {i.BOXES}, {_LINES} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY l.y1, l.x1, place) - 1 AS INT) AS box_idx, l.x1 AS x1, l.y1 AS y1, l.x2 AS x2, l.y2 AS y2, l.conf AS conf, l.cls_id AS cls_id FROM lines")
def box_line_merge(spark, d):
    return bx.merge_lines(i.boxes(spark, d))


# One step tests the surest waiting detection against the kept ones.
_SUPPRESSED = (
    "walk AS (SELECT image_id, list({'x1': x1::DOUBLE, 'y1': y1::DOUBLE, 'x2': x2::DOUBLE, 'y2': y2::DOUBLE, 'conf': conf, 'det_idx': det_idx, 'cls_id': cls_id} ORDER BY conf DESC, det_idx) AS wait, wait[1:0] AS kept FROM dets GROUP BY image_id "
    "UNION ALL SELECT image_id, wait[2:], CASE WHEN len(list_filter(shares, lambda s: s.shared > 0.45e0 * greatest(s.areas - s.shared, 1e-9))) > 0 THEN kept ELSE list_append(kept, b) END FROM ("
    "SELECT *, list_transform(kept, lambda k: {'shared': greatest(least(b.x2, k.x2) - greatest(b.x1, k.x1), 0) * greatest(least(b.y2, k.y2) - greatest(b.y1, k.y1), 0), "
    "'areas': (k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)}) AS shares FROM (SELECT *, wait[1] AS b FROM walk WHERE len(wait) > 0))), "
    "kept AS (SELECT image_id, unnest(kept) AS b FROM walk WHERE len(wait) = 0)"
)


@query(f"WITH RECURSIVE {i.CROWDED_BOXES}, {_SUPPRESSED} SELECT image_id, b.det_idx AS det_idx, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2, b.conf AS conf, b.cls_id AS cls_id FROM kept")
def box_suppress(spark, d):
    return bx.suppress(i.crowded_boxes(spark, d))


@query(f"WITH {i.BOXES} SELECT image_id, box_idx, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y1, x1, box_idx) - 1 AS INT) AS position FROM boxes")
def box_reading_order(spark, d):
    return bx.reading_order(i.boxes(spark, d)).select("image_id", "box_idx", "position")


# Orientation and instances


@query(f"WITH {i.ROTATIONS} SELECT image_id, angle AS best_rotation_angle, round(p0, 6) AS best_p0 FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY p0 DESC, angle) AS rn FROM rot) WHERE rn = 1")
def rot_best_of_four(spark, d):
    return ro.best_rotation(ro.rotation_scores(i.rotations(spark, d))).withColumn("best_p0", F.round("best_p0", 6))


_WIDE = ", ".join([f"round(max(p0) FILTER (angle = {a}), 6) AS p0_rot{a}" for a in ro.ANGLES] + [f"max(pred_class) FILTER (angle = {a}) AS pred_class_rot{a}" for a in ro.ANGLES])


@query(f"WITH {i.ROTATIONS} SELECT image_id, arg_max(angle, {{'p': p0, 'a': -angle}}) AS best_rotation_angle, round(max(p0), 6) AS best_p0, CASE WHEN max(p0) >= 0.9e0 THEN 'accepted' WHEN max(p0) >= 0.6e0 THEN 'review' ELSE 'suspect' END AS status, {_WIDE} FROM rot GROUP BY image_id")
def rot_status_log(spark, d):
    return ro.rotation_log(ro.rotation_scores(i.rotations(spark, d)))


_COARSE = "g AS (SELECT vec_id AS image_id, k AS i, label + (k - 10) / 5e0 AS angle, CAST((vec_id * 7 + k * k * 3) % 17 AS DOUBLE) AS score FROM embeddings, range(21) r(k))"


@query(f"WITH {_COARSE} SELECT image_id, angle AS refined_angle, score AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, i) AS rn FROM g) WHERE rn = 1")
def deskew_grid_best(spark, d):
    images = i.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("coarse_angle"))
    scored = ro.angle_grid(images).withColumn("score", ((F.col("image_id") * 7 + F.col("i") * F.col("i") * 3) % 17).cast("double"))
    return ro.best_angle(scored)


@query("SELECT image_id, idx, conf FROM (SELECT o_custkey AS image_id, o_orderkey AS idx, round(o_totalprice / 100000) AS conf, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 100000) DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def seg_best_instance(spark, d):
    rows = i.table(spark, d, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("idx"), F.round(F.col("o_totalprice") / 100000).alias("conf"))
    return ro.best_instance(rows)


# Perceptual hashes, groups, leakage


@query(f"WITH {i.PHASHES} SELECT vec_id, h AS canonical_hash_int, lpad(lower(hex(h)), 16, '0') AS canonical_hash_hex FROM ph")
def phash_bits(spark, d):
    return i.phashes(spark, d).withColumn("canonical_hash_hex", s.hash_hex(F.col("canonical_hash_int")))


@query(f"WITH {i.NEAR_HASHES} SELECT a.vec_id AS record_a, b.vec_id AS record_b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS hamming_distance FROM ph a JOIN ph b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 2")
def phash_hamming_pairs(spark, d):
    return cu.near_pairs(i.near_hashes(spark, d), 2, id_col="vec_id")


@query(f"WITH RECURSIVE {i.NEAR_HASHES}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ph a JOIN ph b ON a.vec_id <> b.vec_id AND bit_count(xor(a.h, b.h)) <= 2), w AS (SELECT vec_id AS n, vec_id AS r FROM ph UNION SELECT w.n, e.b FROM w JOIN e ON w.r = e.a), c AS (SELECT n AS record_id, min(r) AS first FROM w GROUP BY n), f AS (SELECT first, 'doc_' || lpad(CAST(row_number() OVER (ORDER BY first) - 1 AS VARCHAR), 6, '0') AS document_group_id FROM (SELECT DISTINCT first FROM c)) SELECT record_id, document_group_id FROM c JOIN f USING (first)")
def phash_components(spark, d):
    """Groups of what hashes within a distance of 2 connect: pairs between distinct hashes, membership by record."""
    return cu.document_groups(i.near_hashes(spark, d).withColumnRenamed("vec_id", "record_id"), 2).select("record_id", "document_group_id")


@query(f"WITH {i.RECORDS}, f AS (SELECT canonical_hash_int AS h, min(record_id) AS first FROM recs GROUP BY ALL), n AS (SELECT h, 'doc_' || lpad(CAST(row_number() OVER (ORDER BY first) - 1 AS VARCHAR), 6, '0') AS document_group_id FROM f) SELECT record_id, document_group_id FROM recs JOIN n ON canonical_hash_int = h")
def doc_exact_groups(spark, d):
    return cu.document_groups(i.records(spark, d)).select("record_id", "document_group_id")


_LEAK = "leak AS (SELECT a.split_name AS split_a, b.split_name AS split_b, a.record_id AS record_id_a, b.record_id AS record_id_b FROM recs a JOIN recs b ON a.canonical_hash_int = b.canonical_hash_int AND list_position(['train', 'valid', 'test'], a.split_name) < list_position(['train', 'valid', 'test'], b.split_name))"


@query(f"WITH {i.RECORDS}, {_LEAK} SELECT * FROM leak")
def leak_split_pairs(spark, d):
    return cu.split_leakage(i.records(spark, d), 0).select("split_a", "split_b", "record_id_a", "record_id_b")


@query(f"WITH {i.RECORDS}, {_LEAK} SELECT split_a, split_b, count(*) AS matched_pairs, count(DISTINCT record_id_a) AS items_a, count(DISTINCT record_id_b) AS items_b FROM leak GROUP BY ALL")
def leak_summary(spark, d):
    return cu.leakage_summary(i.records(spark, d), 0)


# Classes, balance, manifest


@query("WITH dim(class_name) AS (VALUES ('de'), ('en'), ('es'), ('fr'), ('vi')), c AS (SELECT class_name, count(lang) AS n FROM dim LEFT JOIN documents ON lang = class_name GROUP BY ALL) SELECT class_name, n, round(100e0 * n / sum(n) OVER (), 6) AS percentage FROM c")
def class_counts_pct(spark, d):
    dim = spark.createDataFrame([("de",), ("en",), ("es",), ("fr",), ("vi",)], ["class_name"])
    return cu.class_counts(i.records(spark, d), dim).select("class_name", "n", F.round("percentage", 6).alias("percentage"))


@query(
    "WITH c AS (SELECT lang AS class_name, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, max(n) OVER () - n AS need, max(n) OVER () / min(n) OVER () AS ratio FROM c) "
    "SELECT class_name, n, need, round(ratio, 6) AS ratio, CASE WHEN ratio <= 1.5e0 THEN 'balanced' WHEN ratio <= 3 THEN 'moderate' ELSE 'severe' END AS advice FROM r"
)
def class_balance_need(spark, d):
    rows = i.records(spark, d)
    dim = rows.select("class_name").distinct()
    ratio = cu.class_counts(rows, dim).select("class_name", F.round("ratio", 6).alias("ratio"), "advice")
    return cu.class_needs(rows, dim).join(ratio, "class_name")


@query(
    "SELECT l_suppkey, greatest(a, n, r) AS largest, least(a, n, r) AS least, CASE WHEN least(a, n, r) = 0 THEN 'missing' WHEN greatest(a, n, r) / least(a, n, r) <= 1.5e0 THEN 'balanced' WHEN greatest(a, n, r) / least(a, n, r) <= 3 THEN 'moderate' ELSE 'severe' END AS advice "
    "FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey)"
)
def imbalance_advice(spark, d):
    counts = i.table(spark, d, "lineitem").groupBy("l_suppkey").agg(*(F.count_if(F.col("l_returnflag") == f).alias(f) for f in "ANR"))
    rows = counts.select("l_suppkey", F.greatest(*"ANR").alias("largest"), F.least(*"ANR").alias("least"))
    return rows.withColumn("advice", s.imbalance_advice(s.imbalance(F.col("largest"), F.col("least"))))


_TARGETS = ["0", "90", "180", "270"]


def _balanced(spark, d):
    """Records of all splits, each split's grouped by itself, and the picks that balance train."""
    rows = i.records(spark, d).withColumn("class_name", F.element_at(F.array(*map(F.lit, _TARGETS)), (F.pmod(F.col("record_id").cast("int"), F.lit(7)) % 4 + 1).cast("int")))
    rows = store(rows.withColumn("canonical_hash_hex", s.hash_hex(F.col("canonical_hash_int"))), "records")
    grouped = store(cu.document_groups(rows, within=["split_name"]), "groups")
    dim = spark.createDataFrame([(c,) for c in _TARGETS], ["class_name"])
    return grouped, cu.balance(grouped.where("split_name = 'train'"), dim)


# The picks are made one after the other, in the order of hashes.
_BALANCE = (
    f"{i.RECORDS}, r AS (SELECT record_id, split_name, path, canonical_hash_int AS h, ['0', '90', '180', '270'][CAST(record_id AS INT) % 7 % 4 + 1] AS class_name, lpad(lower(hex(canonical_hash_int)), 16, '0') AS canonical_hash_hex FROM recs), "
    "gf AS (SELECT split_name, h, min(record_id) AS first FROM r GROUP BY ALL), gn AS (SELECT split_name, h, 'doc_' || lpad(CAST(row_number() OVER (PARTITION BY split_name ORDER BY first) - 1 AS VARCHAR), 6, '0') AS document_group_id FROM gf), "
    "g AS (SELECT r.*, document_group_id FROM r JOIN gn USING (split_name, h)), tr AS (SELECT * FROM g WHERE split_name = 'train'), "
    "dim(class_name) AS (VALUES ('0'), ('90'), ('180'), ('270')), cnt AS (SELECT class_name, count(record_id) AS n FROM dim LEFT JOIN tr USING (class_name) GROUP BY ALL), needs AS (SELECT class_name AS target_class, (SELECT max(n) FROM cnt) - n AS need FROM cnt), "
    "held AS (SELECT document_group_id, list(DISTINCT class_name ORDER BY class_name) AS classes FROM tr GROUP BY ALL), "
    "el AS (SELECT target_class, need, document_group_id, list_filter(classes, lambda c: c <> target_class) AS options, md5('42:' || target_class || ':' || document_group_id) AS turn FROM held CROSS JOIN needs WHERE need > 0), "
    "pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_class ORDER BY turn, document_group_id) AS rn FROM el WHERE len(options) > 0) WHERE rn <= need), "
    "sq AS (SELECT *, rn AS seq FROM pk), "
    "walk AS (SELECT target_class, 0::BIGINT AS seq, [0, 0, 0, 0] AS used, ''::VARCHAR AS document_group_id, ''::VARCHAR AS source_class FROM (SELECT DISTINCT target_class FROM sq) "
    "UNION ALL SELECT w.target_class, s.seq, list_transform(range(1, 5), lambda k: w.used[k] + CASE WHEN ['0', '180', '270', '90'][k] = best THEN 1 ELSE 0 END), s.document_group_id, best FROM walk w JOIN sq s ON s.target_class = w.target_class AND s.seq = w.seq + 1, "
    "LATERAL (SELECT list_sort(list_transform(s.options, lambda o: lpad(CAST(w.used[list_position(['0', '180', '270', '90'], o)] AS VARCHAR), 9, '0') || o))[1][10:] AS best)), "
    "src AS (SELECT document_group_id, class_name AS source_class, min({'record_id': record_id, 'path': path, 'x': canonical_hash_hex}) AS one FROM tr GROUP BY ALL), "
    "picks AS (SELECT target_class, source_class, document_group_id, one.record_id AS record_id, one.path AS path, one.x AS canonical_hash_hex, CAST((CAST(target_class AS INT) - CAST(source_class AS INT) + 360) % 360 AS INT) AS rotation_applied FROM walk JOIN src USING (document_group_id, source_class) WHERE seq > 0)"
)
_MANIFEST = (
    "man AS (SELECT 'original' AS row_type, split_name, class_name AS target_class, class_name AS source_class, 0 AS rotation_applied, path AS source_path, split_name || '/' || class_name || '/orig_' || record_id AS output_path, record_id, document_group_id, canonical_hash_hex FROM g "
    "UNION ALL SELECT 'augmented', 'train', target_class, source_class, rotation_applied, path, 'train/' || target_class || '/aug_target_' || target_class || '_from_' || source_class || '_' || record_id, record_id, document_group_id, canonical_hash_hex FROM picks)"
)


@query(f"WITH RECURSIVE {_BALANCE} SELECT * FROM picks")
def balance_pick(spark, d):
    return _balanced(spark, d)[1]


@query(f"WITH RECURSIVE {_BALANCE}, {_MANIFEST} SELECT * FROM man")
def manifest_union(spark, d):
    return cu.manifest(*_balanced(spark, d))


@query(
    f"WITH RECURSIVE {_BALANCE}, {_MANIFEST}, per AS (SELECT split_name, list({{'target_class': target_class, 'n': n}} ORDER BY target_class) AS classes FROM (SELECT split_name, target_class, count(*) AS n FROM man GROUP BY ALL) GROUP BY ALL), "
    "sp AS (SELECT split_name, count(*) AS images, count(DISTINCT document_group_id) AS documents, count(*) FILTER (row_type = 'augmented') AS augmented FROM man GROUP BY ALL) "
    "SELECT CAST(to_json(list({'split_name': split_name, 'images': images, 'documents': documents, 'augmented': augmented, 'classes': classes} ORDER BY split_name)) AS VARCHAR) AS splits, CAST(sum(images) AS BIGINT) AS total FROM sp JOIN per USING (split_name)"
)
def curation_report(spark, d):
    return cu.curation_report(cu.manifest(*_balanced(spark, d))).select(F.to_json("splits").alias("splits"), "total")


@query("SELECT page_id, substr(CASE WHEN z = '' THEN 'img' ELSE z END, 1, 40) AS name, regexp_replace(url, '[^\\p{L}\\p{N}._-]', '_', 'g') AS file FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS z FROM pages)")
def curate_safe_name(spark, d):
    return i.table(spark, d, "pages").select("page_id", t.safe_name(F.col("url")).alias("name"), t.safe_filename(F.col("url")).alias("file"))


@query("SELECT doc_id, CASE WHEN length(text) > 42 THEN left(text, 39) || '...' ELSE text END AS short, regexp_replace(text, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS stripped FROM documents")
def text_shorten_strip(spark, d):
    return i.table(spark, d, "documents").select("doc_id", t.shorten(F.col("text"), 42).alias("short"), t.strip_text(F.col("text")).alias("stripped"))


@query(
    f"WITH {i.RECORDS}, s AS (SELECT *, regexp_replace(regexp_replace(split_part(path, '/', -1), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS z FROM (SELECT record_id, split_name, class_name, path || '/Scan ' || record_id || '.JPG' AS path FROM recs)) "
    "SELECT record_id, concat_ws('/', split_name, class_name, 'orig_' || regexp_replace(z, '[.]JPG$', '') || '_' || lpad(CAST(row_number() OVER (PARTITION BY split_name, class_name ORDER BY path, record_id) - 1 AS VARCHAR), 6, '0') || '.jpg') AS name FROM s"
)
def curate_original_files(spark, d):
    rows = i.records(spark, d).withColumn("path", F.concat("path", F.lit("/Scan "), "record_id", F.lit(".JPG")))
    return original_files(rows, ["path", "record_id"]).select("record_id", "name")


@query("SELECT DISTINCT l_linenumber, l_suppkey % 4 AS k, CAST(((l_suppkey % 4) * 90 - (l_linenumber % 4) * 90 + 360) % 360 AS INT) AS rotation FROM lineitem")
def required_rotation(spark, d):
    rows = i.table(spark, d, "lineitem").select("l_linenumber", (F.col("l_suppkey") % 4).alias("k")).distinct()
    return rows.withColumn("rotation", s.required_rotation(F.col("l_linenumber") % 4 * 90, F.col("k") * 90).cast("int"))


# Evaluation


def _predictions(spark, d):
    return en.score_tokens(i.logits(spark, d)).select(F.col("label").cast("int").alias("y_true"), F.col("pred_id").alias("y_pred"))


@query(f"WITH {i.LOGITS} SELECT c AS y_true, " + ", ".join(f"coalesce(count(*) FILTER (pred_id = {c} AND label IS NOT NULL), 0) AS \"{c}\"" for c in range(10)) + " FROM range(10) r(c) LEFT JOIN preds ON label = c GROUP BY c")
def eval_confusion(spark, d):
    return ev.confusion(_predictions(spark, d), list(range(10)))


_PER = (
    "per AS (SELECT c, (SELECT count(*) FROM preds WHERE label = c AND pred_id = c) AS hits, (SELECT count(*) FROM preds WHERE label = c) AS sup, (SELECT count(*) FROM preds WHERE pred_id = c) AS pre FROM (SELECT label AS c FROM preds UNION SELECT pred_id FROM preds)), "
    "pr AS (SELECT c, hits, sup, CASE WHEN pre > 0 THEN hits / pre ELSE 0 END AS p, CASE WHEN sup > 0 THEN hits / sup ELSE 0 END AS r FROM per), sc AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr), "
    "rep AS (SELECT CAST(c AS VARCHAR) AS label, p, r, f, sup FROM sc UNION ALL SELECT 'accuracy', sum(hits) / sum(sup), sum(hits) / sum(sup), sum(hits) / sum(sup), sum(sup) FROM sc "
    "UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(sup) FROM sc UNION ALL SELECT 'weighted avg', sum(p * sup) / sum(sup), sum(r * sup) / sum(sup), sum(f * sup) / sum(sup), sum(sup) FROM sc)"
)


@query(f"WITH {i.LOGITS}, {_PER} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(sup AS BIGINT) AS support FROM rep")
def eval_report(spark, d):
    return ev.report(_predictions(spark, d)).select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean_loss FROM lineitem GROUP BY ALL")
def eval_weighted_loss(spark, d):
    return i.table(spark, d, "lineitem").groupBy("l_returnflag").agg(ev.weighted_loss(None, "l_discount", "l_quantity")).withColumn("mean_loss", F.round("mean_loss", 6))


@query("WITH h AS (SELECT CAST(user_id % 40 AS INT) AS epoch, count(*) AS metric FROM events GROUP BY ALL) SELECT min(epoch) AS epoch, metric FROM h WHERE metric = (SELECT max(metric) FROM h) GROUP BY metric")
def eval_best_epoch(spark, d):
    history = i.table(spark, d, "events").groupBy((F.col("user_id") % 40).cast("int").alias("epoch")).agg(F.count("*").alias("metric"))
    return ev.best_epoch(history, "metric")


@query("SELECT CAST(sum(l_quantity) AS DOUBLE) AS total, CAST(sum(l_quantity) FILTER (l_returnflag = 'N') AS DOUBLE) AS trainable FROM lineitem")
def parameter_totals(spark, d):
    return ev.parameter_totals(i.table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("numel"), (F.col("l_returnflag") == "N").alias("trainable")))


@query("SELECT event_id, CASE WHEN value >= 80 THEN 'evaluation' WHEN value < 10 THEN 'summary' ELSE 'step' END AS kind FROM events")
def log_kinds(spark, d):
    sparse = i.table(spark, d, "events").select("event_id", F.when(F.col("value") >= 80, F.col("value")).alias("eval_loss"), F.when(F.col("value") < 10, F.col("value")).alias("train_runtime"))
    return ev.log_kinds(sparse).select("event_id", "kind")


@query("SELECT event_id, CAST(user_id % 30 + 1 AS INT) AS epoch, round(0.5e0 * 0.001e0 * (1 + cos(3.141592653589793e0 * (user_id % 30) / 30)), 10) AS lr FROM events")
def lr_cosine(spark, d):
    steps = i.table(spark, d, "events").select("event_id", (F.col("user_id") % 30 + 1).cast("int").alias("epoch"))
    return steps.withColumn("lr", F.round(s.cosine_rate(0.001, F.col("epoch"), 30), 10))


# Batches, sets, logs


@query("SELECT event_type AS split, count(*) FILTER (value >= 50) AS success, count(*) FILTER (NOT value >= 50) AS error, count(*) AS total FROM events GROUP BY ROLLUP (event_type)")
def batch_rollup_status(spark, d):
    return ro.batch_totals(i.table(spark, d, "events").select(F.col("event_type").alias("split"), (F.col("value") >= 50).alias("ok")))


@query("WITH dim(class_name) AS (VALUES ('en'), ('fr'), ('vi')) SELECT class_name, 'missing' AS status FROM dim WHERE class_name NOT IN (SELECT lang FROM documents) UNION ALL SELECT DISTINCT lang, 'unexpected' FROM documents WHERE lang NOT IN (SELECT class_name FROM dim)")
def dim_anti_missing(spark, d):
    dim = spark.createDataFrame([("en",), ("fr",), ("vi",)], ["class_name"])
    return cu.unexpected_and_missing(i.records(spark, d), dim)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return i.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 16 AS INT) AS batch, event_id FROM events")
def batch_slices(spark, d):
    numbered = cu.number_rows(i.table(spark, d, "events").select("event_type", "event_id"), ["event_id"], ["event_type"])
    return numbered.select("event_type", F.floor(F.col("number") / 16).cast("int").alias("batch"), "event_id")


@query(f"WITH {i.RECORDS} SELECT record_id, format('{{}}_{{}}_{{:06d}}', split_name, class_name, row_number() OVER (PARTITION BY split_name, class_name ORDER BY record_id) - 1) AS name FROM recs")
def record_names(spark, d):
    numbered = cu.number_rows(i.records(spark, d).select("record_id", "split_name", "class_name"), ["record_id"], ["split_name", "class_name"])
    return numbered.select("record_id", t.record_id(F.col("split_name"), F.col("class_name"), F.col("number")).alias("name"))


_COLOURS = ", ".join(f"('{k}', '{v}')" for k, v in t.LABEL_COLOURS.items())


@query(f"WITH {_KIE}, c(base, colour) AS (VALUES {_COLOURS}) SELECT image_id, token_idx AS idx, label, coalesce(colour, '#333333') AS colour FROM named LEFT JOIN c ON regexp_replace(label, '_PREFIX$', '') = base")
def label_colours(spark, d):
    return _labelled(spark, d).select("image_id", "idx", "label", t.label_colour(F.col("label")).alias("colour"))


_LATEX = reduce(lambda e, sign: f"replace({e}, '{sign[0]}', '{sign[1]}')", t.LATEX, "p_name || ' & 5% #_ $x {y} ~ ^'")


@query(f"SELECT p_partkey, {_LATEX} AS cell FROM part")
def latex_cells(spark, d):
    return i.table(spark, d, "part").select("p_partkey", t.latex_escape(F.concat("p_name", F.lit(" & 5% #_ $x {y} ~ ^"))).alias("cell"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 500000 >= 0.9e0 THEN 'accepted' WHEN o_totalprice / 500000 >= 0.6e0 THEN 'review' ELSE 'suspect' END AS status, CAST(trunc(o_totalprice / 500000 * 100) AS INT) AS percent FROM orders")
def route_by_confidence(spark, d):
    p = F.col("o_totalprice") / 500000
    return i.table(spark, d, "orders").select("o_orderkey", s.decide_status(p).alias("status"), t.percent(p).alias("percent"))
