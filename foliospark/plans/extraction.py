"""From images to extracted fields, stage by stage as tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import normalize_box
from ..operators.boxes import CORNERS, merge_lines, postprocess
from ..operators.entities import entity_maps, first_subtoken, keep_entities, label_words, predictions_of_words, score_tokens, valid_words
from ..operators.scoring import Scorer, detect_boxes, normalize_images, read_texts, tag_words
from ..schemas import ALLOWED, DETECTOR_CONF, MIN_SCORE, label_table
from ..storage import stage_table, store


@dataclass(frozen=True)
class Settings:
    detector_conf: float = DETECTOR_CONF
    min_score: float = MIN_SCORE
    allowed: tuple[str, ...] | None = ALLOWED
    on_missing: str = "passthrough"


def extract(images: DataFrame, scorer: Scorer, settings: Settings = Settings(), at: str | None = None, profile: ResourceProfile | None = None) -> dict[str, DataFrame]:
    """All stages' tables: normalized, boxes, texts, tagged, words, entities, extracted.

    What models give (normalized, boxes, texts, tagged) is stored before it is
    read, so a lost executor repeats no stage that is done. at: a folder that
    driver and executors share, of these images; a later call with the same
    scorer (of a class that can be imported) and settings goes on after the
    last stage that was stored there whole. Without it the tables are in the shared folder until the driver ends.
    profile: the resources (memory, GPUs) of the tasks that run models; on a
    cluster only.
    """
    spark = images.sparkSession
    made_of = hashlib.sha256(cloudpickle.dumps((scorer, settings))).hexdigest()[:16]

    def stage(df: DataFrame, name: str) -> DataFrame:
        return stage_table(df, f"{at.rstrip('/')}/{name}-{made_of}") if at else store(df, name)

    normalized = stage(normalize_images(images, scorer, settings.on_missing, profile=profile), "normalized")
    found = postprocess(detect_boxes(normalized, scorer, settings.detector_conf, profile), settings.detector_conf)
    boxes = stage(merge_lines(found.withColumnRenamed("det_idx", "box_idx")), "boxes")
    texts = stage(read_texts(normalized, boxes, scorer, profile), "texts")
    sizes = normalized.where("status = 'ok'").select("image_id", "width", "height")
    words = texts.join(boxes.select("image_id", "box_idx", *CORNERS), ["image_id", "box_idx"]).join(sizes, "image_id")
    words = words.select("image_id", "box_idx", "text", *(v.alias(k) for k, v in normalize_box(CORNERS, F.col("width"), F.col("height")).items()))
    tokens = stage(tag_words(valid_words(words), scorer, profile), "tagged")
    tagged = first_subtoken(score_tokens(tokens))
    labelled = label_words(predictions_of_words(words, tagged), label_table(spark)).withColumnRenamed("box_idx", "idx")
    entities = keep_entities(labelled, settings.min_score, settings.allowed)
    return {"normalized": normalized, "boxes": boxes, "texts": texts, "tagged": tokens, "words": labelled, "entities": entities, "extracted": entity_maps(entities)}


def entities_of_ocr(tokens: DataFrame, token_scores: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Entities of stored OCR words (image_id, box_idx, text) and their sub-token logits."""
    predicted = predictions_of_words(tokens, first_subtoken(score_tokens(token_scores)))
    labelled = label_words(predicted, label_table(tokens.sparkSession)).withColumnRenamed("box_idx", "idx")
    return keep_entities(labelled, settings.min_score, settings.allowed)
