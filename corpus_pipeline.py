"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored
and read again as the next one's docs. All but the last return the columns of
documents, whatever further columns there are and whatever they are called. An
empty table gives an empty one in each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import pii, quality
from foliospark.llm.common import table
from foliospark.llm.neardup import near_duplicates
from foliospark.llm.packing import pack
from foliospark.llm.substring import remove_repeats
from foliospark.storage import drop, scratch, store


def _held(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns in one, so that none of them can clash with an operator's own."""
    return docs.select("doc_id", "text", F.struct([c for c in docs.columns if c != "text"]).alias("__row"))


def _changed(found: DataFrame, text: str, columns: list[str], measure: bool) -> DataFrame:
    """The held rows with a text in its place, and (measure) n_chars as it now is."""
    new = {"text": F.col(text)} | ({"n_chars": F.length(text).cast("long")} if measure else {})
    return found.select([(new[c] if c in new else F.col("__row")[c]).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base test nor the learned decision list rejects.

    A null or empty text has no words and is rejected. Repeated rows and rows
    without doc_id are judged by their text like any other. Without labels, or
    with labels of one kind only, nothing is learned and the base test decides.
    """
    kept = quality.apply_rules(_held(docs), table(spark, sf_dir, "labels")).where("kept")
    return _changed(kept, "text", docs.columns, measure=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, on five-word shingles, the document of least doc_id.

    Rows without doc_id stay, as do null and empty texts, which are like
    nothing. Rows of one doc_id are one document: they all stay or all go.
    """
    gone = near_duplicates(docs, size=5).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that documents of smaller doc_id have, too.

    Every row stays. Null texts become empty, rows without doc_id are left as
    they are, and rows of one doc_id take nothing from each other. n_chars, if
    there is such a column, is that of the text as it now is.
    """
    return remove_repeats(docs, carry=True).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, masked.

    Every row stays, repeated ones and those without doc_id too; a null text
    stays null. n_chars is that of the text as it now is.
    """
    return _changed(pii.sanitize(_held(docs)), "sanitized", docs.columns, measure=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences.

    A null or empty text is its end token alone; repeated rows are packed as
    often as they come, rows without doc_id too.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("personal data", personal_data),
    ("packing", packing),
]

#: The learned rules, the tokenizer and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage stored on its way, and its input, is removed when its output is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch(spark):
            docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"), scoped=False)
        drop(before)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
