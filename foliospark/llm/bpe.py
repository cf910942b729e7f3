"""Byte-level BPE encoding and decoding.

A segment tree over the byte positions of one pre-token holds, in every node,
the smallest (rank, position) of the pairs below it. Its root is the leftmost
pair of least rank; a merge changes three leaves (the merged pair, its live
left neighbour's pair, the swallowed symbol's pair), so it costs three
logarithmic point updates. A piece of n bytes takes O(n log n).

Texts repeat their words, so results are remembered per blank-delimited chunk
and per pre-token, in dictionaries of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import keyed_texts

#: Entries of each dictionary; a full one is emptied.
CACHE_ENTRIES = 300_000
#: Twice as many pre-tokens as chunks are kept: a miss there costs the merges.
PIECE_ENTRIES = 600_000
_POS_BITS = 40
_NONE = 1 << 80

# Unicode's White_Space characters. The regex module's \s is
# spelled out with them, so that the pattern means the same in any engine.
_WHITE = r"\t-\r\x20\x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class MinTree:
    """Segment tree of the least value; a value is rank << _POS_BITS | position."""

    __slots__ = ("half", "node")

    def __init__(self, leaves: list[int]):
        half = 1 << max(0, len(leaves) - 1).bit_length()
        node = [_NONE] * (2 * half)
        node[half : half + len(leaves)] = leaves
        for i in range(half - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b
        self.half, self.node = half, node

    def put(self, pos: int, value: int) -> None:
        node, i = self.node, self.half + pos
        node[i] = value
        while i > 1:
            sibling = node[i ^ 1]
            i >>= 1
            value = value if value < sibling else sibling
            if node[i] == value:
                return
            node[i] = value


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: repeatedly join the leftmost adjacent pair of least rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    end = list(range(1, n + 1))  # of the symbol that starts here
    left = list(range(-1, n - 1))  # start of the live symbol before

    leaves = []
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        leaves.append(_NONE if rank is None else rank << _POS_BITS | i)
    tree = MinTree(leaves or [_NONE])
    node, put, mask = tree.node, tree.put, (1 << _POS_BITS) - 1
    while (best := node[1]) != _NONE:
        i = best & mask
        j = end[i]
        stop = end[i] = end[j]
        if j < n - 1:
            put(j, _NONE)
        if stop < n:
            left[stop] = i
            rank = get(piece[i : end[stop]])
            put(i, _NONE if rank is None else rank << _POS_BITS | i)
        else:
            put(i, _NONE)
        h = left[i]
        if h >= 0:
            rank = get(piece[h:stop])
            put(h, _NONE if rank is None else rank << _POS_BITS | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Pieces(dict):
    """Pre-token to packed ids, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECE_ENTRIES:
            self.clear()
        out = self[piece] = array("I", merge_piece(piece.encode("utf-8"), self.ranks)).tobytes()
        return out


class _Chunks(dict):
    """Blank-delimited chunk to packed ids, filled on demand."""

    def __init__(self, pattern: regex.Pattern, pieces: _Pieces):
        self.find, self.pieces = pattern.findall, pieces

    def __missing__(self, chunk: str) -> bytes:
        if "\n" in chunk:
            # One newline between visible characters is a pre-token of its own.
            lines = chunk.split("\n")
            if all(lines) and lines[0] != " " and all(map(str.isprintable, lines)):
                return self.pieces["\n"].join([self[x] for x in lines])
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = b"".join(map(self.pieces.__getitem__, self.find(chunk)))
        if len(chunk) < 64:
            self[chunk] = out
        return out


class Encoder:
    """Encodes texts to packed little-endian unsigned 32-bit ids, and back."""

    def __init__(self, rank_path: str, pattern: str):
        self.ranks = load_ranks(rank_path)
        self.vocab = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.vocab[rank] = token
        spelled = regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))
        self._chunks = _Chunks(spelled, _Pieces(self.ranks))
        # A blank between two characters that are not white space always starts
        # a pre-token, whatever surrounds it; texts may be cut there. What
        # isprintable() says no to, and doubled blanks, take the slower cut.
        self._cut = regex.compile(r"(?<=[!-~\p{L}]) (?=[!-~\p{L}])")

    def encode(self, text: str) -> bytes:
        get = self._chunks.__getitem__
        parts = text.split(" ")
        if "" in parts or not text.replace("\n", "").isprintable() or "\n " in text or " \n" in text:
            parts = self._cut.split(text)
        out = [get(parts[0])]
        out += [get(" " + p) for p in parts[1:]]
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.vocab.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(rank_path: str, pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(rank_path, pattern)


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Encode every text and decode its ids again.

    Returns doc_id, ids (array<int>, only with with_ids), n_tokens, ids_sha256,
    decoded_sha256, round_trip (the decoded bytes are the text's). A null text
    counts as empty: no ids. An empty table gives an empty one; repeated rows
    and null doc_ids give a row each; other columns are ignored. Narrow: no
    shuffle, one Arrow batch in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_path, pattern)
        for batch in batches:
            ids, counts, id_hash, text_hash, same = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                packed = enc.encode(text)
                plain = enc.decode(packed)
                counts.append(len(packed) // 4)
                id_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(hashlib.sha256(plain).hexdigest())
                same.append(plain == text.encode("utf-8"))
                if with_ids:
                    ids.append(array("i", packed))
            cols = [batch.column("doc_id")] + ([pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))] if with_ids else []) + [pa.array(counts, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id"] + ["ids"] * with_ids + ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    schema = "doc_id long, " + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return keyed_texts(docs).mapInArrow(run, schema)
