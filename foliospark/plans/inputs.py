"""Inputs of the registered queries, derived from the driver's tables; in DuckDB's SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LABELS

WIDTH, HEIGHT = 900, 1200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with corners at quarter pixels; an order is an image, a line number a box."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("box_idx")).agg(
        (F.min((F.col("l_partkey") * 7) % 900) + F.min(F.col("l_partkey") % 4) * F.lit(0.25)).alias("x1"),
        (F.min((F.col("l_suppkey") * 13) % 1200) + F.min(F.col("l_suppkey") % 4) * F.lit(0.25)).alias("y1"),
        F.min("l_quantity").alias("q"),
        F.max("l_discount").alias("conf"),
    )
    return rows.select("image_id", "box_idx", "x1", "y1", (F.col("x1") + 10 + F.col("q")).alias("x2"), (F.col("y1") + 8 + F.col("box_idx") % 5).alias("y2"), "conf", (F.col("box_idx") % 3).cast("int").alias("cls_id"))


BOXES = """boxes AS (SELECT image_id, box_idx, x1, y1, x1 + 10 + q AS x2, y1 + 8 + box_idx % 5 AS y2, conf, CAST(box_idx % 3 AS INT) AS cls_id FROM (
  SELECT l_orderkey AS image_id, l_linenumber AS box_idx, min((l_partkey * 7) % 900) + min(l_partkey % 4) * 0.25e0 AS x1,
    min((l_suppkey * 13) % 1200) + min(l_suppkey % 4) * 0.25e0 AS y1, min(l_quantity) AS q, max(l_discount) AS conf
  FROM lineitem GROUP BY ALL))"""


def crowded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: each box three times, moved a little and a little surer each time."""
    k, idx = F.col("k"), F.col("box_idx")
    moved = lambda c, by: (F.col(c) + k * by).alias(c)
    rows = boxes(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    right, down = 1 + idx % 4 * 7, idx % 3
    return rows.select("image_id", (idx * 3 + k).alias("det_idx"), moved("x1", right), moved("y1", down), moved("x2", right), moved("y2", down), (F.col("conf").cast("double") + k * F.lit(0.25)).alias("conf"), "cls_id")


CROWDED_BOXES = BOXES + """, dets AS (SELECT image_id, box_idx * 3 + k AS det_idx, x1 + k * (1 + box_idx % 4 * 7) AS x1, y1 + k * (box_idx % 3) AS y1, x2 + k * (1 + box_idx % 4 * 7) AS x2, y2 + k * (box_idx % 3) AS y2, conf::DOUBLE + k * 0.25e0 AS conf, cls_id
  FROM boxes, (SELECT unnest([0, 1, 2]) AS k))"""

def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-class logits with their true label; ten vectors are an image."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.floor(F.col("vec_id") / 10).alias("image_id"), (F.col("vec_id") % 10).cast("int").alias("token_idx"), F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double") * 10).alias("logits"), "label")


LOGITS = """logits AS (SELECT vec_id, vec_id // 10 AS image_id, CAST(vec_id % 10 AS INT) AS token_idx, list_transform(embedding[1:10], lambda v: v::DOUBLE * 10) AS logits, label FROM embeddings),
soft AS (SELECT *, list_transform(logits, lambda v: exp(v - list_max(logits))) AS ex FROM logits),
preds AS (SELECT vec_id, image_id, token_idx, label, CAST(list_position(logits, list_max(logits)) - 1 AS INT) AS pred_id, list_max(ex) / list_sum(ex) AS score FROM soft)"""


def token_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of all 37 labels, so far apart that many are sure; ten vectors are an image."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.floor(F.col("vec_id") / 10).alias("image_id"), (F.col("vec_id") % 10).cast("int").alias("token_idx"), F.transform(F.slice("embedding", 1, len(LABELS)), lambda v: v.cast("double") * 60).alias("logits"))


TOKEN_LOGITS = LOGITS.replace("embedding[1:10]", f"embedding[1:{len(LABELS)}]").replace("v::DOUBLE * 10", "v::DOUBLE * 60")


def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four candidate rotations of four logits per vector."""
    e = table(spark, sf_dir, "embeddings")
    four = [F.struct(F.lit(a).alias("angle"), F.transform(F.slice("embedding", 4 * i + 1, 4), lambda v: v.cast("double") * 10).alias("logits")) for i, a in enumerate((0, 90, 180, 270))]
    return e.select(F.col("vec_id").alias("image_id"), F.explode(F.array(*four)).alias("c")).select("image_id", "c.angle", "c.logits")


ROTATIONS = """cand AS (SELECT vec_id AS image_id, unnest([0, 90, 180, 270]) AS angle, unnest([embedding[1:4], embedding[5:8], embedding[9:12], embedding[13:16]]) AS l FROM embeddings),
lg AS (SELECT image_id, angle, list_transform(l, lambda v: v::DOUBLE * 10) AS l FROM cand),
ex AS (SELECT image_id, angle, l, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM lg),
rot AS (SELECT image_id, angle, e[1] / list_sum(e) AS p0, CAST(list_position(l, list_max(l)) - 1 AS INT) AS pred_class FROM ex)"""


def phashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scores import hash_bits

    return table(spark, sf_dir, "embeddings").select("vec_id", hash_bits(F.col("embedding")).alias("canonical_hash_int"))


PHASHES = """ph AS (SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[2:64], lambda v: CASE WHEN v > list_sort(embedding[2:64])[32] THEN 1::BIGINT ELSE 0::BIGINT END)), lambda a, b: a * 2 + b) AS h FROM embeddings)"""


def near_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hashes, every third also with one bit, every fifth with two bits turned, every seventh once more."""
    h, bit = F.col("canonical_hash_int"), lambda k: F.expr(f"shiftleft(1L, cast((vec_id * {k}) % 61 AS int))")
    entry = lambda k, value, every: F.when(F.col("vec_id") % every == 0, F.struct(F.lit(k).alias("k"), value.alias("h")))
    made = F.array(entry(0, h, 1), entry(1, h.bitwiseXOR(bit(1)), 3), entry(2, h.bitwiseXOR(bit(1)).bitwiseXOR(bit(7)), 5), entry(3, h, 7))
    rows = phashes(spark, sf_dir).select("vec_id", F.explode(made).alias("x")).where("x IS NOT NULL")
    return rows.select((F.col("vec_id") * 4 + F.col("x.k")).alias("vec_id"), F.col("x.h").alias("canonical_hash_int"))


NEAR_HASHES = PHASHES.replace("ph AS", "ph0 AS") + """, ph AS (SELECT vec_id * 4 AS vec_id, h FROM ph0 UNION ALL SELECT vec_id * 4 + 1, xor(h, 1::BIGINT << CAST(vec_id % 61 AS INT)) FROM ph0 WHERE vec_id % 3 = 0
  UNION ALL SELECT vec_id * 4 + 2, xor(xor(h, 1::BIGINT << CAST(vec_id % 61 AS INT)), 1::BIGINT << CAST(vec_id * 7 % 61 AS INT)) FROM ph0 WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id * 4 + 3, h FROM ph0 WHERE vec_id % 7 = 0)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as image records: three splits, languages as classes, a 60-bit content hash."""
    d = table(spark, sf_dir, "documents")
    split = F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))
    bits = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 15), 16, 10).cast("long")
    return d.select(F.format_string("%08d", "doc_id").alias("record_id"), split.alias("split_name"), F.col("lang").alias("class_name"), F.col("source").alias("path"), bits.alias("canonical_hash_int"))


RECORDS = """recs AS (SELECT format('{:08d}', doc_id) AS record_id, ['train', 'valid', 'test'][doc_id % 3 + 1] AS split_name, lang AS class_name, source AS path,
  CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS canonical_hash_int FROM documents)"""
