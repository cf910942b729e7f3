"""Classifier metrics over (y_true, y_pred) and training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _per_class(predictions: DataFrame) -> DataFrame:
    """Per label: hits, support, predicted. One pass; labels of either column."""
    sides = F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    cells = predictions.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    flat = cells.select(sides.alias("s"), "n", (F.col("y_true") == F.col("y_pred")).alias("hit"))
    return flat.groupBy("s.label").agg(F.sum(F.when(F.col("hit") & (F.col("s.t") == 1), F.col("n")).otherwise(0)).alias("hits"), F.sum(F.col("s.t") * F.col("n")).alias("support"), F.sum(F.col("s.p") * F.col("n")).alias("predicted"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_scores(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a denominator is 0."""
    per = _per_class(predictions).select("label", _ratio(F.col("hits"), F.col("predicted")).alias("precision"), _ratio(F.col("hits"), F.col("support")).alias("recall"), F.col("support"), "hits")
    return per.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def averages(scores: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted averages of class scores, one row."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
    names = ("precision", "recall", "f1")
    return scores.agg((F.sum("hits") / F.sum("support")).alias("accuracy"), *(F.avg(c).alias(f"macro_{c}") for c in names), *(weighted(c) for c in names), F.sum("support").alias("support"))


def report(predictions: DataFrame) -> DataFrame:
    """Rows per class, then accuracy, macro avg and weighted avg: label, precision, recall, f1, support."""
    scores = class_scores(predictions)
    total = averages(scores)
    row = lambda name, p, r, f: total.select(F.lit(name).alias("label"), F.col(p).alias("precision"), F.col(r).alias("recall"), F.col(f).alias("f1"), "support")
    tail = row("accuracy", "accuracy", "accuracy", "accuracy").unionByName(row("macro avg", "macro_precision", "macro_recall", "macro_f1")).unionByName(row("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1"))
    return scores.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support").unionByName(tail)


def confusion(predictions: DataFrame, classes: list) -> DataFrame:
    """A row per true class, a column per predicted one, zeros included."""
    spark = predictions.sparkSession
    every = spark.createDataFrame([(c,) for c in classes], ["y_true"])
    counts = predictions.groupBy("y_true").pivot("y_pred", classes).count()
    return every.join(counts, "y_true", "left").na.fill(0)


def weighted_loss(batches: DataFrame, loss: str = "loss", n: str = "n") -> Column:
    return (F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("mean_loss")


def best_epoch(history: DataFrame, metric: str, largest: bool = True) -> DataFrame:
    """The first epoch with the best value: epoch and the value."""
    value = F.col(metric) if largest else -F.col(metric)
    return history.where(F.col(metric).isNotNull()).agg(F.max_by("epoch", F.struct(value.alias("v"), (-F.col("epoch")).alias("e"))).alias("epoch"), (F.max(metric) if largest else F.min(metric)).alias(metric))


def log_kinds(log: DataFrame) -> DataFrame:
    """Add kind to sparse trainer logs: evaluation, summary or step."""
    return log.withColumn("kind", F.when(F.col("eval_loss").isNotNull(), "evaluation").when(F.col("train_runtime").isNotNull(), "summary").otherwise("step"))


def parameter_totals(parameters: DataFrame) -> DataFrame:
    """Total and trainable counts of rows (numel, trainable)."""
    return parameters.agg(F.sum("numel").alias("total"), F.sum(F.when(F.col("trainable"), F.col("numel")).otherwise(0)).alias("trainable"))
