"""Choosing orientations and instances, and routing by confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import argmax, decide_status, softmax

ANGLES = (0, 90, 180, 270)


def rotation_scores(candidates: DataFrame) -> DataFrame:
    """Of (image_id, angle, logits): p0, probability of upright, and the predicted class index."""
    return candidates.withColumn("p", softmax(F.col("logits"))).select("image_id", "angle", F.element_at("p", 1).alias("p0"), argmax(F.col("p")).alias("pred_class"))


def best_rotation(scores: DataFrame) -> DataFrame:
    """The angle of largest p0, the first of 0, 90, 180, 270 on ties."""
    best = F.max(F.struct("p0", (-F.col("angle")).alias("a"))).alias("b")
    return scores.groupBy("image_id").agg(best).select("image_id", (-F.col("b.a")).alias("best_rotation_angle"), F.col("b.p0").alias("best_p0"))


def rotation_log(scores: DataFrame, accept: float = 0.90, review: float = 0.60, digits: int = 6) -> DataFrame:
    """One wide row per image: each angle's p0 and predicted class, the best angle and the status. One shuffle."""
    at = lambda c, a: F.max(F.when(F.col("angle") == a, F.col(c)))
    wide = [F.round(at("p0", a), digits).alias(f"p0_rot{a}") for a in ANGLES] + [at("pred_class", a).alias(f"pred_class_rot{a}") for a in ANGLES]
    best = F.max(F.struct("p0", (-F.col("angle")).alias("a")))
    rows = scores.groupBy("image_id").agg(best.alias("b"), *wide)
    return rows.select("image_id", (-F.col("b.a")).alias("best_rotation_angle"), F.round("b.p0", digits).alias("best_p0"), decide_status(F.col("b.p0"), accept, review).alias("status"), *(f"p0_rot{a}" for a in ANGLES), *(f"pred_class_rot{a}" for a in ANGLES))


def angle_grid(images: DataFrame, steps: int = 10, per_degree: float = 5.0) -> DataFrame:
    """(…, i, angle): coarse_angle and its neighbours, 21 of them 0.2 degrees apart."""
    grid = images.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2 * steps))))
    return grid.withColumn("angle", F.col("coarse_angle") + (F.col("i") - steps) / F.lit(per_degree))


def best_angle(scored: DataFrame) -> DataFrame:
    """Per image the angle of the largest score, the lowest on ties; scores below 0 never win against none."""
    top = F.max(F.struct("score", (-F.col("i")).alias("o"), "angle")).alias("b")
    return scored.groupBy("image_id").agg(top).select("image_id", F.col("b.angle").alias("refined_angle"), F.col("b.score").alias("best_score"))


def best_instance(instances: DataFrame) -> DataFrame:
    """Per image the surest instance, the first on ties."""
    top = F.max(F.struct("conf", (-F.col("idx")).alias("o"))).alias("b")
    return instances.groupBy("image_id").agg(top).select("image_id", (-F.col("b.o")).alias("idx"), F.col("b.conf").alias("conf"))


def batch_totals(rows: DataFrame, split: str = "split", ok: str = "ok") -> DataFrame:
    """Successes and errors per split and over all (split null)."""
    return rows.rollup(split).agg(F.count_if(F.col(ok)).alias("success"), F.count_if(~F.col(ok)).alias("error"), F.count("*").alias("total"))


def deskew_log(normalized: DataFrame) -> DataFrame:
    """Log of normalized images by path: status, angles and score to 2, 2 and 4 digits (empty on errors), error text."""
    return normalized.select(F.col("image_id").alias("image_path"), "status", F.round("coarse_angle", 2).alias("coarse_angle"), F.round("refined_angle", 2).alias("refined_angle"), F.round("best_score", 4).alias("best_score"), "error").orderBy("image_path")
