"""From token scores to extracted fields.

token_scores(image_id, token_idx, word_id, logits) -> word_preds(image_id,
box_idx, pred_id, score) -> entities(image_id, idx, label, text, score) -> the
four shapes in which they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import argmax, top_probability
from ..functions.text import base_label, is_prefix_label, shorten, strip_text
from ..schemas import ALLOWED, FIELD_GROUPS, MIN_SCORE, OTHER, OTHER_FIELDS, OTHER_ID


def score_tokens(tokens: DataFrame) -> DataFrame:
    """Add pred_id and score (its probability) to rows with logits."""
    return tokens.withColumns({"pred_id": argmax(F.col("logits")), "score": top_probability(F.col("logits"))})


def first_subtoken(scored: DataFrame) -> DataFrame:
    """A word takes the prediction of its first sub-token; rows without a word_id are special tokens."""
    first = F.min_by(F.struct("pred_id", "score"), F.col("token_idx")).alias("f")
    return scored.where("word_id IS NOT NULL").groupBy("image_id", "word_id").agg(first).select("image_id", "word_id", "f.pred_id", "f.score")


def valid_words(words: DataFrame) -> DataFrame:
    """Words with text, numbered anew inside their image: adds word_id."""
    order = Window.partitionBy("image_id").orderBy("box_idx")
    return words.where(strip_text(F.col("text")) != "").withColumn("word_id", (F.row_number().over(order) - 1).cast("int"))


def predictions_of_words(words: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every word with its prediction; words that were cut off or blank are OTHER with score 0."""
    numbered = valid_words(words).select("image_id", "box_idx", "word_id")
    joined = words.join(numbered, ["image_id", "box_idx"], "left").join(predictions, ["image_id", "word_id"], "left")
    return joined.withColumns({"pred_id": F.coalesce("pred_id", F.lit(OTHER_ID)), "score": F.coalesce("score", F.lit(0.0))}).drop("word_id")


def label_words(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Add label; an unknown id is OTHER. The label table has a few dozen rows."""
    names = F.broadcast(labels.select(F.col("label_id").alias("pred_id"), "label"))
    return predicted.join(names, "pred_id", "left").withColumn("label", F.coalesce("label", F.lit(OTHER)))


def keep_entities(labelled: DataFrame, min_score: float = MIN_SCORE, allowed: tuple[str, ...] | None = ALLOWED) -> DataFrame:
    """Sure, not OTHER, not a prefix, and allowed (None: any)."""
    kept = labelled.where((F.col("label") != OTHER) & (F.col("score") >= min_score) & ~is_prefix_label(F.col("label")))
    return kept if allowed is None else kept.where(F.col("label").isin(list(allowed)))


def in_order(value: Column, index: Column) -> Column:
    """Aggregate: the values as an array in the order of the index."""
    return F.transform(F.array_sort(F.collect_list(F.struct(index.alias("i"), value.alias("v")))), lambda x: x["v"])


def texts_by_label(entities: DataFrame) -> DataFrame:
    return entities.groupBy("image_id", "label").agg(in_order(F.col("text"), F.col("idx")).alias("texts"), F.min("idx").alias("first_idx"))


def joined_by_label(entities: DataFrame) -> DataFrame:
    """One string per label of the stripped texts that are not blank; labels without any are left out."""
    clean = entities.withColumn("text", strip_text(F.col("text"))).where("text <> ''")
    return texts_by_label(clean).select("image_id", "label", F.array_join("texts", " ").alias("value"), "first_idx")


def entity_maps(entities: DataFrame) -> DataFrame:
    """Per image: list of one-entry maps in reading order, map of lists, map of joined strings."""
    single = F.transform(F.array_sort(F.collect_list(F.struct("idx", "label", "text"))), lambda x: F.create_map(x["label"], x["text"]))
    lists = entities.groupBy("image_id").agg(single.alias("entities"))
    by_label = texts_by_label(entities).groupBy("image_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("first_idx", "label", "texts"))), lambda x: F.struct(x["label"], x["texts"]))).alias("texts"))
    joined = joined_by_label(entities).groupBy("image_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("first_idx", "label", "value"))), lambda x: F.struct(x["label"], x["value"]))).alias("joined"))
    return lists.join(by_label, "image_id", "left").join(joined, "image_id", "left")


def values_and_prefixes(labelled: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Per image and base label: values, prefixes and the mean confidence.

    The mean is that of the values, or else of the prefixes.
    """
    kept = labelled.withColumn("text", strip_text(F.col("text"))).where((F.col("text") != "") & (F.col("label") != OTHER) & (F.col("score") >= min_score))
    kept = kept.withColumns({"is_prefix": is_prefix_label(F.col("label")), "base": base_label(F.col("label"))})
    own, prefix = ~F.col("is_prefix"), F.col("is_prefix")
    join = lambda when: F.array_join(in_order(F.when(when, F.col("text")), F.col("idx")), " ")
    mean = F.coalesce(F.avg(F.when(own, F.col("score"))), F.avg(F.when(prefix, F.col("score"))))
    return kept.groupBy("image_id", "base").agg(join(own).alias("value"), join(prefix).alias("prefix"), mean.alias("confidence"))


def report_rows(fields: DataFrame, labels: DataFrame, prefix_chars: int = 24, value_chars: int = 42) -> DataFrame:
    """Rows of the report table: a header per group that has fields, then its fields.

    Fields without a group, those of unknown labels too, come last as other
    fields, in the order of their names. Empty
    prefixes, values and confidences are shown as "-".
    """
    groups = F.broadcast(labels.where("NOT is_prefix").select(F.col("base_label").alias("base"), "field_group", "group_pos", "field_pos"))
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    known = fields.join(groups, "base", "left").fillna({"field_group": OTHER_FIELDS, "group_pos": len(FIELD_GROUPS), "field_pos": 0})
    body = known.select(
        "image_id", "group_pos", F.lit(1).alias("level"), "field_pos", F.col("base").alias("field"),
        dash(shorten(F.col("prefix"), prefix_chars)).alias("prefix"), dash(shorten(F.col("value"), value_chars)).alias("value"),
        dash(F.when(F.col("confidence").isNotNull(), F.format_string("%.2f", "confidence"))).alias("conf"), "field_group",
    )
    heads = body.select("image_id", "group_pos", F.lit(0).alias("level"), F.lit(0).alias("field_pos"), F.col("field_group").alias("field"), F.lit("").alias("prefix"), F.lit("").alias("value"), F.lit("").alias("conf")).distinct()
    order = Window.partitionBy("image_id").orderBy("group_pos", "level", "field_pos", "field")
    return heads.unionByName(body.drop("field_group")).withColumn("row", F.row_number().over(order)).select("image_id", "row", "field", "prefix", "value", "conf")
