"""Removal of long passages that an earlier document has too.

A de Bruijn graph over the token k-mers of the corpus, sparsified to the
k-mers that are least in some window (minimisers): these are its nodes, and
the words from one to the next its edges. Spark aggregates and joins find the
repeated nodes, and of these the ones that all occurrences enter and leave by
one edge; runs of such nodes are its nonbranching paths. A path is compacted
to one span per document: every occurrence is the same words, so the least
document that holds one of its nodes decides for all windows inside. Only
windows across a branch or a path's end are compared one by one, by their
hashes.

Hashes of 64 bits only propose. Every proposal names its source's coordinates,
and stands if what the source itself made of its words there agrees: for a path
a 128-bit digest of all its words, for a window a second hash by another
function. A proposal that does not agree removes nothing.

Every window of ``window`` words holds its own minimiser, which is chosen
whatever surrounds the window, so no repeated window is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forgetting, keyed_texts, materialize, small_batches

WINDOW_WORDS = 50
NODE_WORDS = 10
WORD_ENTRIES = 300_000

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


class _WordHash(dict):
    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_ENTRIES:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word, seed=self.seed)
        return out


#: For what is proposed, and for the test of windows.
_words, _test_words = _WordHash(0), _WordHash(0x5851F42D4C957F2D)


def forget() -> None:
    _words.clear()
    _test_words.clear()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _UNBASE**i modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1024, 2 * n)
        _powers[:] = [np.cumprod(np.array([1] + [b] * size, dtype=np.uint64), dtype=np.uint64) for b in (_BASE, _UNBASE)]
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any span of a text's words, from one prefix sum."""

    def __init__(self, words: list[bytes], table: _WordHash = _words):
        n = len(words)
        up, down = _power_tables(n + 1)
        hashes = np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=n)
        self.up = up
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * down[:n], out=self.prefix[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        size = (stop - start).astype(np.uint64)
        return _mix((self.prefix[stop] - self.prefix[start]) * self.up[start] + size * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    def all(self, size: int) -> np.ndarray:
        start = np.arange(len(self.prefix) - size)
        return self.hash(start, start + size)


def _slide(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Least or largest of every size neighbours, by doubling."""
    take = np.minimum if least else np.maximum
    width = 1
    while 2 * width <= size:
        x = take(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return take(x[:-rest], x[rest:]) if rest else x


def minimisers(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of node hashes: least of every size neighbours; positions that are least in some of them."""
    least = _slide(values, size, True)
    low = np.iinfo(np.int64).min
    reach = _slide(np.concatenate([np.full(size - 1, low), least, np.full(size - 1, low)]), size, False)
    return least, np.flatnonzero(values == reach)


def _nodes(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts: list[tuple] = []
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            words = text.encode("utf-8").split()
            if key is None or len(words) < window:
                continue
            spans = Spans(words)
            values = spans.all(k)
            at = minimisers(values, window - k + 1)[1]
            edges = spans.hash(at[:-1], at[1:] + k)
            parts.append((np.full(len(at), key), at, values[at], edges))
        if parts:
            n = sum(len(p[1]) for p in parts)
            before, after = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            first, last, i = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), 0
            for _, at, _, edges in parts:
                j = i + len(at)
                before[i + 1 : j], after[i : j - 1] = edges, edges
                first[i] = last[j - 1] = True
                i = j
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([p[0] for p in parts]), pa.int64()), pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32)), pa.array(np.concatenate([p[2] for p in parts])), pa.array(before, mask=first), pa.array(after, mask=last)],
                ["doc_id", "pos", "node", "before", "after"],
            )


def repeated_nodes(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, marks) of documents with nodes that other documents have too; marks by position, each with the first occurrence's place."""
    # Aggregates are stored before they are joined: between two stored tables
    # Spark can split the partition of a node that very many documents have.
    nodes = materialize(texts.select("doc_id", "text").mapInArrow(forgetting(lambda it: _nodes(it, window, k), forget), "doc_id long, pos int, node long, before long, after long"), "nodes")
    shared = nodes.groupBy("node").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("most")).where("first.doc_id < most").select("node", F.col("first.doc_id").alias("source"), F.col("first.pos").alias("source_at"))
    found = materialize(nodes.join(materialize(shared, "shared"), "node"), "repeated")
    degree = found.groupBy("node").agg(*(f(c).alias(f"{n}_{c}") for c in ("before", "after") for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))), F.count("*").alias("n"))
    one = degree.select("node", *((F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}")) & (F.col(f"n_{c}") == F.col("n"))).alias(f"one_{c}") for c in ("before", "after")))
    marked = found.join(materialize(one, "degrees"), "node").select("doc_id", F.struct("pos", "node", "source", "source_at", "one_before", "one_after").alias("mark"))
    return marked.groupBy("doc_id").agg(F.array_sort(F.collect_list("mark")).alias("marks"))


def _covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, stops, -1)
    return np.cumsum(steps[:n]) > 0


def _paths(words: list[bytes], marks: tuple, window: int, k: int) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Paths that several documents have, as (start, length, source, source_at, test), and positions, hashes and tests of windows that are still open."""
    spans = Spans(words)
    values = spans.all(k)
    least, at = minimisers(values, window - k + 1)
    order = {int(p): i for i, p in enumerate(at)}
    n = len(at)
    seen, one_before, one_after = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    source, source_at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for pos, node, first, first_at, before, after in zip(*marks):
        i = order.get(pos)
        if i is not None and values[pos] == node:
            seen[i], source[i], source_at[i], one_before[i], one_after[i] = True, first, first_at, before, after
    joined = seen[:-1] & seen[1:] & one_after[:-1] & one_before[1:]
    head = np.flatnonzero(np.concatenate([[True], ~joined]))
    tail = np.concatenate([head[1:], [n]]) - 1
    starts, stops = at[head], at[tail] + k
    known = seen[head] & (stops - starts >= window)
    inside = np.zeros(len(words) - window + 1, bool)
    paths = []
    for h, a, b in zip(head[known].tolist(), starts[known].tolist(), stops[known].tolist()):
        inside[a : b - window + 1] = True
        paths.append((a, b - a, int(source[h]), int(source_at[h]), hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest()))
    still = np.flatnonzero(np.isin(least, values[at[seen]]) & ~inside)
    tests = Spans(words, _test_words).hash(still, still + window) if len(still) else still
    return paths, still, spans.hash(still, still + window), tests


def _result(text: str, words: list[bytes], removed: np.ndarray | None) -> tuple[str, int, str]:
    if removed is None or not removed.any():
        return text, 0, hashlib.sha256(b" ".join(words)).hexdigest()
    kept = b" ".join([w for w, r in zip(words, removed.tolist()) if not r])
    return kept.decode("utf-8"), int(removed.sum()), hashlib.sha256(kept).hexdigest()


_OUT = "n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, k: int = NODE_WORDS, with_text: bool = True, carry: bool = False) -> DataFrame:
    """Remove every word in a window of words that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 and (with_text) text: the
    kept words joined by blanks where any was removed, else the text as it is.
    Windows are judged on the input. A null text has no words; texts shorter
    than the window, and rows without a doc_id, are kept; rows of one doc_id
    are the same document to each other and each gives a row; an empty table
    gives an empty one. Other columns are ignored, or (carry) exactly the
    columns of docs are returned, with text and n_chars as they now are.
    """
    if carry:
        small_batches(docs.sparkSession)
        rest = F.struct([c for c in docs.columns if c != "text"])
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest"))
        with_text = True
    else:
        texts = keyed_texts(docs).withColumn("rest", F.struct("doc_id"))
    rest_type = texts.schema["rest"].dataType.simpleString()
    marks = repeated_nodes(texts, window, k)
    by_key = texts.withColumn("own", F.xxhash64("text")).join(marks, "doc_id", "left")  # own tells rows of one doc_id apart
    parts = f"rest {rest_type}, doc_id long, own long, text string, open boolean, n_words long, n_removed long, kept_sha256 string, paths array<struct<at:int,length:int,source:long,source_at:int,test:binary>>, at array<int>, hashes array<long>, tests array<long>"
    path_type = pa.struct([("at", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_at", pa.int32()), ("test", pa.binary())])

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            marks = batch.column("marks")
            for i, (key, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
                words = text.encode("utf-8").split()
                paths, at, hashes, tests = [], *[np.zeros(0, np.int64)] * 3
                if marks[i].is_valid and len(words) >= window:
                    paths, at, hashes, tests = _paths(words, tuple(f.to_pylist() for f in marks[i].values.flatten()), window, k)
                is_open = len(at) > 0 or any(source < key for _, _, source, *_ in paths)
                digest = None if is_open else hashlib.sha256(b" ".join(words)).hexdigest()
                rows.append((key, text if with_text or is_open else None, is_open, len(words), 0, digest, [dict(zip(("at", "length", "source", "source_at", "test"), p)) for p in paths], at.tolist(), hashes.tolist(), tests.tolist()))
            cols = list(zip(*rows)) or [()] * 10
            types = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.list_(path_type), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 2]
            first, *others = (pa.array(c, t) for c, t in zip(cols, types))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), first, batch.column("own"), *others], ["rest", "doc_id", "own", "text", "open", "n_words", "n_removed", "kept_sha256", "paths", "at", "hashes", "tests"])

    state = materialize(by_key.mapInArrow(forgetting(compact, forget), parts), "paths")
    paths = state.select("doc_id", "own", F.explode("paths").alias("p")).select("doc_id", "own", "p.*")
    there = ["source", "source_at", "length", "test"]
    sources = materialize(paths.where("doc_id = source AND at = source_at").select(there).distinct(), "sources")
    proven = paths.where("doc_id > source").join(sources, there, "left_semi").select("doc_id", "own", "at", "length")
    windows = state.select("doc_id", "own", F.explode(F.arrays_zip("at", "hashes", "tests")).alias("w")).select("doc_id", "own", F.col("w.at").alias("at"), F.col("w.hashes").alias("hash"), F.col("w.tests").alias("test"))
    first = windows.groupBy("hash").agg(F.min(F.struct("doc_id", "at", "test")).alias("first"), F.max("doc_id").alias("most")).where("first.doc_id < most").drop("most")
    hits = windows.join(materialize(first, "windows"), "hash").where("first.doc_id < doc_id AND first.test = test").select("doc_id", "own", "at", F.lit(window).alias("length"))
    gone = proven.unionByName(hits).groupBy("doc_id", "own").agg(F.collect_set(F.struct("at", "length")).alias("gone"))
    opened = state.where("open").select("rest", "doc_id", "own", "text").join(gone, ["doc_id", "own"], "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            gone = batch.column("gone")
            for i, (key, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
                words, removed = text.encode("utf-8").split(), None
                if gone[i].is_valid:
                    at, length = (np.array(f.to_pylist(), dtype=np.int64) for f in gone[i].values.flatten())
                    removed = _covered(len(words), at, at + length)
                kept, n, digest = _result(text, words, removed)
                rows.append((key, kept if with_text else None, len(words), n, digest))
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), *(pa.array(c, t) for c, t in zip(cols, types))], ["rest", "doc_id", "text", "n_words", "n_removed", "kept_sha256"])

    done = state.where("NOT open").select("rest", "doc_id", "text", "n_words", "n_removed", "kept_sha256")
    out = done.unionByName(opened.mapInArrow(forgetting(finish, forget), f"rest {rest_type}, doc_id long, text string, " + _OUT))
    if carry:
        return out.select([F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("rest")[c].alias(c) for c in docs.columns])
    return out.drop("rest") if with_text else out.drop("rest", "text")
