"""Masked pseudo-likelihood of documents.

Every word has a class, by its last letters, and in its class a cell: the most
frequent words of a class have cells of their own, the others share the rest by
their hashes. A window network (one table per position for the cells of the two
words on either side, a tanh layer) predicts a masked word's class, then, given
the class, its cell; the word's own share of its cell gives the word. All three
probabilities sum to one, so a word's is their product, and a document's score
is the sum of its words' conditional log-probabilities.

Word counts cover the whole corpus. So does training: documents are dealt to
shards by a hash, as many shards as the corpus has words for; in each round
every shard starts from the shared weights, trains on the masked words of its
documents in a fixed order, and the shards' weights are averaged by their
number of words. Rounds go through disjoint masks, which together hold every
word. Scores do not depend on how the rows lie, but for rounding. Classes,
cells and with them the network grow with the number of distinct words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forgetting, keyed_texts, materialize

#: Classes, and cells of a class, up to so many distinct words; with more, they grow with the fourth root.
SIDE, TYPES = 48, 1 << 22
#: The most frequent words, which every worker knows; the counts of all others are joined. Scores do not depend on it.
FREQUENT = 100_000
OFFSETS = (-2, -1, 1, 2)
HIDDEN = 16
ROUNDS = 2
#: Share of a document's positions that a round masks at least; more, where the rounds would not else mask each once.
MASKED = 0.5
BATCH = 4096
RATE = 0.1
#: Words of a training shard, so that a task's length does not grow with the corpus.
SHARD_WORDS = 4_000_000
WORD_ENTRIES = 300_000
_CHUNK = 16_384
_SUFFIX = 0xFFF  # the bits of a word's id that its last two bytes alone decide


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


class _WordIds(dict):
    """Word to its 64-bit id: 52 bits of its hash, 12 of the hash of its last two bytes."""

    def __missing__(self, word: bytes) -> int:
        value = (xxhash.xxh3_64_intdigest(word) & ~_SUFFIX) | (xxhash.xxh32_intdigest(word[-2:]) & _SUFFIX)
        if len(self) >= WORD_ENTRIES:
            self.clear()
        out = value - (1 << 64) if value >> 63 else value
        if len(word) < 64:
            self[word] = out
        return out


_ids = _WordIds()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) by word id over all texts, summed inside the workers before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(map(_ids.__getitem__, held)), pa.int64()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(_words(text))
            if len(held) > 200_000:
                yield out()
                held.clear()
        yield out()

    return texts.select("text").mapInArrow(forgetting(run, _ids.clear), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The known words (sorted ids, cells, logarithms of counts), the logarithm of each cell's count and one, all words' number."""

    ids: np.ndarray
    cells: np.ndarray
    logs: np.ndarray
    masses: np.ndarray
    side: int
    total: int

    @property
    def own(self) -> int:
        return self.side // 2

    @property
    def kind(self) -> type:
        """Numbers in which a cell, and one more for a document's edge, are stored."""
        return np.uint16 if self.side**2 < 65535 else np.uint32

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells of word ids, their log-shares of their cells (of unknown ones as if seen once), and which are known."""
        at = np.minimum(np.searchsorted(self.ids, words), max(len(self.ids) - 1, 0))
        known = self.ids[at] == words if len(self.ids) else np.zeros(len(words), bool)
        shared = (words & _SUFFIX) % self.side * self.side + self.own + ((words.view(np.uint64) >> np.uint64(12)) % np.uint64(self.side - self.own)).astype(np.int64)
        cells = np.where(known, self.cells[at], shared) if len(self.ids) else shared
        return cells, (np.where(known, self.logs[at], 0.0) if len(self.ids) else 0.0) - self.masses[cells], known


def learn_vocabulary(counts: DataFrame, size: int = FREQUENT) -> Vocabulary:
    """From (word, n), a stored table. What is collected: two rows a cell, and the frequent words."""
    types, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    side = 2 * round(SIDE / 2 * max(1.0, (types / TYPES) ** 0.25))
    own = side // 2
    klass = F.pmod(F.col("word").bitwiseAND(F.lit(_SUFFIX)), F.lit(side)).cast("int").alias("class")
    bucket = F.pmod(F.shiftrightunsigned("word", 12), F.lit(side - own)).cast("int").alias("bucket")
    first = Window.partitionBy("class").orderBy(F.desc("n"), "word")
    top = counts.select("word", "n", klass).withColumn("place", F.row_number().over(first)).where(F.col("place") <= own).collect()
    mass = np.zeros((side, side))
    for r in counts.groupBy(klass, bucket).agg(F.sum("n").alias("n")).collect():
        mass[r["class"], own + r["bucket"]] = r["n"]
    cell_of, count_of = {}, {}
    for r in top:
        mass[r["class"], r["place"] - 1] = r["n"]
        mass[r["class"], own + (r["word"] % (1 << 64) >> 12) % (side - own)] -= r["n"]
        cell_of[r["word"]], count_of[r["word"]] = r["class"] * side + r["place"] - 1, r["n"]
    # A histogram of rounded logarithms, a thousand rows at most, gives the count from which words are known; of the
    # next level an even share by hash. Sorting would send every task's first words to the driver.
    level, left, picked = F.floor(F.log2("n") * 16).cast("int"), size, F.lit(False)
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("types")).orderBy(F.desc("level")).collect():
        share = min(1.0, max(left, 0) / r["types"])
        picked = (level > r["level"]) | ((level == r["level"]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))))
        if share < 1.0:
            break
        left -= r["types"]
    for r in counts.where(picked).collect():
        count_of[r["word"]] = r["n"]
    ids = np.array(sorted(count_of), dtype=np.int64)
    shared = (ids & _SUFFIX) % side * side + own + ((ids.view(np.uint64) >> np.uint64(12)) % np.uint64(side - own)).astype(np.int64)
    cells = np.array([cell_of.get(w, c) for w, c in zip(ids.tolist(), shared.tolist())], dtype=np.int64)
    return Vocabulary(ids, cells, np.log([count_of[w] for w in ids.tolist()]), np.log(mass.ravel() + 1), side, total)


class Network:
    """Views into one flat array of weights."""

    def __init__(self, weights: np.ndarray, side: int):
        self.flat, self.side = weights.astype(np.float32).copy(), side
        self.seen = np.full_like(self.flat, 1e-3)
        self.parts, self.sums = self._views(self.flat), self._views(self.seen)

    @staticmethod
    def shapes(side: int) -> dict[str, tuple[int, ...]]:
        return {"tables": (len(OFFSETS), side * side + 1, HIDDEN), "classes": (side, HIDDEN), "out": (HIDDEN, side), "inner": (HIDDEN, side), "prior": (side,), "inner_prior": (side, side), "bias": (HIDDEN,)}

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes(self.side).items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    @staticmethod
    def initial(vocabulary: Vocabulary, seed: int = 7) -> np.ndarray:
        """Small random weights; the priors are the corpus's own shares of classes and cells."""
        side, rng = vocabulary.side, np.random.default_rng(seed)
        mass = np.exp(vocabulary.masses).reshape(side, side)
        made = {k: rng.normal(0, 0.1, shape) for k, shape in Network.shapes(side).items()}
        made |= {"prior": np.log(mass.sum(axis=1) / mass.sum()), "inner_prior": np.log(mass / mass.sum(axis=1, keepdims=True)), "bias": np.zeros(HIDDEN)}
        return np.concatenate([made[k].ravel() for k in Network.shapes(side)]).astype(np.float32)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """Of rows of context cells; a document's edge is the cell after the last."""
        tables = self.parts["tables"]
        h = self.parts["bias"] + tables[0].take(context[:, 0], axis=0)
        for p in range(1, len(OFFSETS)):
            h += tables[p].take(context[:, p], axis=0)
        return np.tanh(h, out=h)

    def logits(self, h: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the classes; the second hidden layer, which knows the class; of the cells inside the class."""
        one = h @ self.parts["out"]
        one += self.parts["prior"]
        inner = h + self.parts["classes"].take(classes, axis=0)
        np.tanh(inner, out=inner)
        two = inner @ self.parts["inner"]
        two += self.parts["inner_prior"].take(classes, axis=0)
        return one, inner, two

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the target cells."""
        classes, cells = target // self.side, target % self.side
        one, _, two = self.logits(self.hidden(context), classes)
        at, out = np.arange(len(target)), 0.0
        for z, hit in ((one, classes), (two, cells)):
            z -= z.max(axis=1, keepdims=True)
            chosen = z[at, hit].astype(np.float64)
            out = out + chosen - np.log(np.exp(z, out=z).sum(axis=1))
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
        """One Adagrad step on a batch; of the tables only the rows in use are touched."""
        n, at = len(target), np.arange(len(target))
        classes, cells = target // self.side, target % self.side
        h = self.hidden(context)
        one, inner, two = self.logits(h, classes)
        for z, hit in ((one, classes), (two, cells)):
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
            z[at, hit] -= 1
            z /= n
        mid = two @ self.parts["inner"].T
        mid *= 1 - inner * inner
        back = one @ self.parts["out"].T
        back += mid
        back *= 1 - h * h
        whole = {"out": h.T @ one, "inner": inner.T @ two, "prior": one.sum(axis=0), "bias": back.sum(axis=0)}
        for name, grad in whole.items():
            self.sums[name] += grad * grad
            self.parts[name] -= rate * grad / np.sqrt(self.sums[name])
        used, order, edges = _groups(classes)
        self._touch("classes", None, used, np.add.reduceat(mid.take(order, axis=0), edges, axis=0), rate)
        self._touch("inner_prior", None, used, np.add.reduceat(two.take(order, axis=0), edges, axis=0), rate)
        for p in range(len(OFFSETS)):
            used, order, edges = _groups(context[:, p])
            self._touch("tables", p, used, np.add.reduceat(back.take(order, axis=0), edges, axis=0), rate)

    def _touch(self, name: str, part: int | None, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
        weights, sums = (v[name] if part is None else v[name][part] for v in (self.parts, self.sums))
        seen = sums[rows] + grad * grad
        sums[rows] = seen
        weights[rows] -= rate * grad / np.sqrt(seen)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, an order that brings equal ones together, and where each begins in it."""
    values = values.astype(np.uint16) if values.max() < 65536 else values
    order = np.argsort(values, kind="stable")
    held = values[order]
    edges = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    return held[edges].astype(np.int64), order, edges


def _padded(cells: list[bytes], kind: type, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' cells in one array, with the edge cell around each; where the words are in it; the documents' lengths."""
    reach, width = max(OFFSETS), np.dtype(kind).itemsize
    counts = np.array([len(x) // width for x in cells], dtype=np.int64)
    place = np.arange(int(counts.sum())) + reach + 2 * reach * np.repeat(np.arange(len(counts)), counts)
    padded = np.full(len(place) + 2 * reach * len(counts), edge, np.int64)
    padded[place] = np.frombuffer(b"".join(cells), kind)
    return padded, place, counts


def _contexts(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([padded[at + o] for o in OFFSETS], axis=1)


def classify(texts: DataFrame, vocabulary) -> DataFrame:
    """(row, doc_id, n_words, cells in two or four bytes each, word_log, rare, times).

    word_log is the sum of the words' log-shares of their cells, where each of
    the rare words, which occurs so many times, counts as once seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        width = np.dtype(known.kind).itemsize
        for batch in batches:
            found = [_words(text) for text in batch.column("text").to_pylist()]
            counts = np.array([len(x) for x in found], dtype=np.int64)
            words = np.fromiter(map(_ids.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(counts.sum()))
            of = np.repeat(np.arange(len(found)), counts)
            cells, logs, held = known.look_up(words)
            sums = np.bincount(of, weights=logs, minlength=len(found)) if len(words) else np.zeros(len(found))
            others = np.flatnonzero(~held)
            order = others[np.lexsort((words[others], of[others]))]
            new = np.ones(len(order), bool)
            new[1:] = (words[order[1:]] != words[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
            first = np.flatnonzero(new)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[order[first]], minlength=len(found)))]).astype(np.int32))
            rare, times = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (words[order[first]], np.diff(np.append(first, len(order)))))
            starts = np.concatenate([[0], np.cumsum(counts)]) * width
            data = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(starts.astype(np.int64).tobytes()), pa.py_buffer(cells.astype(known.kind).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(counts), data, pa.array(sums), rare, times], ["row", "doc_id", "n_words", "cells", "word_log", "rare", "times"])

    ddl = "row long, doc_id long, n_words long, cells binary, word_log double, rare array<long>, times array<long>"
    return texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(forgetting(run, _ids.clear), ddl)


def with_rare_words(classified: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, n_words, cells, word_log) with the rare words' own counts in word_log."""
    rare = classified.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    logs = rare.join(counts.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("rare_log"))
    rows = classified.select("row", "doc_id", "n_words", "cells", "word_log").join(logs, "row", "left")
    return rows.select("doc_id", "n_words", "cells", (F.col("word_log") + F.coalesce("rare_log", F.lit(0.0))).alias("word_log"))


def masked(keys: np.ndarray, positions: np.ndarray, number: int, masks: int) -> np.ndarray:
    """Whether round number masks positions of documents, by hashes: any `masks` rounds in a row mask each once."""
    x = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (positions.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(33)) % np.uint64(masks) == number % masks


class _Trainer:
    """A shard's network, which takes steps on batches of a fixed size, however its documents come."""

    def __init__(self, net: Network, number: int, masks: int):
        self.net, self.number, self.masks = net, number, masks
        self.contexts, self.targets, self.waiting, self.trained = [], [], 0, 0

    def add(self, keys: np.ndarray, cells: list[bytes], kind: type) -> None:
        padded, place, counts = _padded(cells, kind, self.net.side**2)
        starts = np.cumsum(counts) - counts
        at = place[masked(np.repeat(keys, counts), np.arange(len(place)) - np.repeat(starts, counts), self.number, self.masks)]
        self.contexts.append(_contexts(padded, at))
        self.targets.append(padded[at])
        self.waiting += len(at)
        if self.waiting >= BATCH:
            self._steps(self.waiting - self.waiting % BATCH)

    def _steps(self, n: int) -> None:
        context, target = np.concatenate(self.contexts), np.concatenate(self.targets)
        for i in range(0, n, BATCH):
            self.net.step(context[i : min(i + BATCH, n)], target[i : min(i + BATCH, n)])
        self.contexts, self.targets, self.waiting, self.trained = [context[n:]], [target[n:]], self.waiting - n, self.trained + n

    def finish(self) -> int:
        if self.waiting:
            self._steps(self.waiting)
        return self.trained


def _train_round(classified: DataFrame, weights: np.ndarray, vocabulary: Vocabulary, number: int, masks: int) -> np.ndarray:
    """Average of the weights that the shards come to, chunk by chunk."""
    shards, side, kind = -(-vocabulary.total // SHARD_WORDS), vocabulary.side, vocabulary.kind
    if not shards:
        return weights
    start = classified.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trainer = None, None

        def done() -> pa.RecordBatch:
            n, flat = trainer.finish(), trainer.net.flat
            cuts = range(0, len(flat), _CHUNK)
            return _chunk_rows([at] * len(cuts), list(range(len(cuts))), [flat[i : i + _CHUNK].tobytes() for i in cuts], [n] * len(cuts))

        for batch in batches:
            of, keys, cells = batch.column("shard").to_numpy(), batch.column("doc_id").fill_null(0).to_numpy(), batch.column("cells").to_pylist()
            edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else np.zeros(1, np.int64)
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                if of[a] != at:
                    if at is not None:
                        yield done()
                    at, trainer = int(of[a]), _Trainer(Network(start.value, side), number, masks)
                trainer.add(keys[a:b], cells[a:b], kind)
        if at is not None:
            yield done()

    dealt = classified.where("n_words > 0").select(F.pmod(F.xxhash64("doc_id", "cells"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "cells")
    moved = dealt.repartitionById(int(shards), F.col("shard")).sortWithinPartitions("shard", "doc_id", "cells").mapInArrow(run, _CHUNK_DDL)
    left = int(shards)
    while left > 1:  # 64 shards at a time, so that no task reads all of a chunk
        grouped = moved.withColumn("into", F.floor(F.col("shard") / 64).cast("int"))
        moved = grouped.repartition("chunk", "into").sortWithinPartitions("chunk", "into", "shard").mapInArrow(_average, _CHUNK_DDL)
        left = -(-left // 64)
    sums = moved.collect()
    start.destroy()
    return np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(sums, key=lambda r: r["chunk"])])


_CHUNK_DDL = "shard int, chunk int, values binary, n long"


def _chunk_rows(shard: list, chunk: list, values: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(chunk, pa.int32()), pa.array(values, pa.binary()), pa.array(n, pa.int64())], ["shard", "chunk", "values", "n"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the rows of each (chunk, into), weighted by n, in their order."""
    at, total, n = None, None, 0

    def done() -> pa.RecordBatch:
        return _chunk_rows([at[1]], [at[0]], [(total / max(n, 1)).astype(np.float32).tobytes()], [n])

    for batch in batches:
        for chunk, into, values, times in zip(*(batch.column(c).to_pylist() for c in ("chunk", "into", "values", "n"))):
            if (chunk, into) != at:
                if at is not None:
                    yield done()
                at, total, n = (chunk, into), 0.0, 0
            total, n = total + np.frombuffer(values, np.float32).astype(np.float64) * times, n + times
    if at is not None:
        yield done()


@dataclass
class Model:
    vocabulary: Vocabulary
    counts: DataFrame
    classified: DataFrame
    weights: np.ndarray


def fit(texts: DataFrame, size: int = FREQUENT, rounds: int = ROUNDS, masked: float = MASKED) -> Model:
    """Count and train on all texts (doc_id, text). Texts are read twice; each round reads some two stored bytes a word."""
    spark = texts.sparkSession
    counts = materialize(count_words(texts), "words")
    vocabulary = learn_vocabulary(counts, size)
    held = spark.sparkContext.broadcast(vocabulary)
    classified = materialize(classify(texts, held), "cells")
    held.destroy()
    weights, masks = Network.initial(vocabulary), max(1, min(rounds, int(1 / masked)))
    for number in range(rounds):
        weights = _train_round(classified, weights, vocabulary, number, masks)
    return Model(vocabulary, counts, classified, weights)


def score_texts(docs: DataFrame, size: int = FREQUENT, rounds: int = ROUNDS, masked: float = MASKED) -> DataFrame:
    """Pseudo-log-likelihood of every document under a network trained on all of them.

    Returns doc_id, n_words, pll (sum of the words' log-probabilities) and
    mean_log_prob (0 without words). A null or empty text has no words and
    scores 0. Repeated rows and null doc_ids give a row each; an empty table
    gives an empty one; other columns are ignored. Every word has its own share
    of its cell: the most frequent words are broadcast, the counts of the
    others are joined. What reaches the driver is the frequent words, two rows
    a cell, and one set of weights a round.
    """
    model = fit(keyed_texts(docs), size, rounds, masked)
    side, kind = model.vocabulary.side, model.vocabulary.kind
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value, side)
        for batch in batches:
            padded, place, counts = _padded(batch.column("cells").to_pylist(), kind, side**2)
            logs = np.zeros(len(place))
            for i in range(0, len(place), BATCH):
                at = place[i : i + BATCH]
                logs[i : i + BATCH] = net.log_probabilities(_contexts(padded, at), padded[at])
            of = np.repeat(np.arange(len(counts)), counts)
            sums = (np.bincount(of, weights=logs, minlength=len(counts)) if len(logs) else np.zeros(len(counts))) + np.array(batch.column("word_log").to_pylist(), dtype=float)
            sums = np.round(sums, 2)
            mean = np.round(sums / np.maximum(counts, 1), 5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums), pa.array(mean)], ["doc_id", "n_words", "pll", "mean_log_prob"])

    return with_rare_words(model.classified, model.counts).mapInArrow(run, "doc_id long, n_words long, pll double, mean_log_prob double")
