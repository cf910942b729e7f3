"""Packing documents into sequences of a fixed length with little padding.

Each document is cut into blocks of the full length and one rest. Rests are
counted by length in a histogram whose size does not depend on the corpus;
cutting_stock finds the patterns; pieces are ranked inside their length and
the ranks dealt to the patterns' slots. A length that a third of all pieces
have is ranked in hash buckets, whose offsets come from their counts.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keyed_texts, materialize, remembering
from .cutting_stock import plan

SEQUENCE_TOKENS = 2048
#: Tokens in a unit of the histogram: rests are rounded up to it when patterns are made.
UNIT = 8
#: Entries of each dictionary; a full one is emptied.
WORD_ENTRIES = 500_000
_SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space for str.split, not for the tokenizer


class WordIds(dict):
    """Words to their token ids, packed, in dictionaries of bounded size.

    The tokenizer drops white space and never joins across it, so words can be
    encoded one by one. A word of common Latin letters is cut by the
    tokenizer's own pattern and its pieces go straight to the merges; any other
    word, one that holds a special token's text too, takes the whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = _PieceIds(self.tokenizer.model)
        self._cut = regex.compile(spec).findall
        self._plain = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
        self._special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        if self._plain(word):
            out = b"".join(map(self.pieces.__getitem__, self._cut(word.lower())))
        else:
            out = self._whole(word)
        if len(self) >= WORD_ENTRIES:
            self.clear()
        if len(word) < 64:
            self[word] = out
        return out

    def _whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str, end: int) -> bytes:
        words = text.split(" ") if any(c in text for c in _SEPARATORS) else text.split()
        if any(t in text for t in self._special):
            return b"".join([self._whole(w) if any(t in w for t in self._special) else self[w] for w in words]) + struct.pack("<I", end)
        return b"".join(map(self.__getitem__, words)) + struct.pack("<I", end)


class _PieceIds(dict):
    def __init__(self, model):
        self._merge = model.tokenize

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self._merge("".join([_BYTE_SIGNS[b] for b in piece.encode("utf-8")]))]
        if len(self) >= WORD_ENTRIES:
            self.clear()
        out = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out


def _byte_signs() -> list[str]:
    """The visible character that byte-level tokenizers write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


_BYTE_SIGNS = _byte_signs()


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _forget_words() -> None:
    _word_ids.cache_clear()


def cut_pieces(docs: DataFrame, tokenizer_path: str, end: int = 1, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens. Narrow: no shuffle."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _word_ids(tokenizer_path)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                packed = ids.encode(text, end)
                n = len(packed) // 4
                for start in range(0, n, size):
                    length = min(size, n - start)
                    rows.append((key, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)]), n))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return keyed_texts(docs).mapInArrow(remembering(run, "packing", _forget_words), ", ".join(f"{n} long" for n in names))


def assign(pieces: DataFrame, size: int = SEQUENCE_TOKENS, unit: int = UNIT) -> DataFrame:
    """Add sequence_id and offset to pieces, which must be a stored table (it is read several times)."""
    spark = pieces.sparkSession
    sized = pieces.withColumn("units", F.ceil(F.col("length") / unit).cast("int"))
    histogram = {r["units"]: r["n"] for r in sized.groupBy("units").agg(F.count("*").alias("n")).collect()}  # size / unit rows at most
    slots, first, taken = [], 0, {}
    for pattern, times in plan(histogram, size // unit):
        for units, per in pattern:
            at = taken.get(units, 0)
            slots.append((units, at, at + per * times, first, per))
            taken[units] = at + per * times
        first += times
    slot_table = spark.createDataFrame(slots, "units int, low long, high long, first long, per long")

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(histogram.values()) // 100_000)
    keyed = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("units", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("units", "bucket", (F.sum("n").over(Window.partitionBy("units").orderBy("bucket")) - F.col("n")).alias("before"))
    within = Window.partitionBy("units", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = keyed.join(before, ["units", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    dealt = ranked.join(F.broadcast(slot_table), "units").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    dealt = dealt.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("per")).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank")
    return dealt.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, end: int = 1, size: int = SEQUENCE_TOKENS, unit: int = UNIT) -> DataFrame:
    """Pack all documents into sequences of at most size tokens.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A null or empty text is the end id alone. Repeated
    rows are packed as often as they come, null doc_ids too; an empty table
    gives no pieces; other columns are ignored. Only numbers are shuffled.
    """
    return assign(materialize(cut_pieces(docs, tokenizer_path, end, size), "pieces"), size, unit)
