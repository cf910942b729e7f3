"""Picks of the class used least so far, one after the other, without one task that goes through all of them.

What a stretch of picks does depends on the counters before it only through
their differences. Going through a stretch from one start gives how often it
picks each class, and the differences for which every one of its picks would
be the same: each pick bounds the difference of the class picked to each of the
others it was picked from. So a stretch is a translation inside known bounds.
The driver chains the stretches' translations, of which there are few, and
where a start lies outside the known bounds asks for the stretch to be gone
through from there, for all such stretches at once and in parallel. Starts
further on are guesses until those before are known; usually they come true,
as different starts soon lead to the same differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Picks in a stretch.
STRETCH = 50_000

Counts = tuple[int, ...]


@dataclass(frozen=True)
class Piece:
    """The picks per class of a stretch, for starts whose count of class c less that of class o is bounds[c][o] at most."""

    picks: Counts
    bounds: tuple[tuple[int | None, ...], ...]

    def holds(self, start: Counts) -> bool:
        return all(b is None or start[c] - start[o] <= b for c, row in enumerate(self.bounds) for o, b in enumerate(row))


def pick(options: tuple[int, ...], counts: list[int]) -> int:
    """Of the classes, in order of their names, the first of those used least."""
    return min(options, key=counts.__getitem__)


def go_through(stretch: list[tuple[int, ...]], start: Counts) -> Piece:
    size = len(start)
    now = list(start)
    bounds: list[list[int | None]] = [[None] * size for _ in range(size)]
    for options in stretch:
        c = pick(options, now)
        for o in options:
            if o != c:
                room = (now[o] - start[o]) - (now[c] - start[c]) - (o < c)
                if bounds[c][o] is None or room < bounds[c][o]:
                    bounds[c][o] = room
        now[c] += 1
    return Piece(tuple(b - a for a, b in zip(start, now)), tuple(map(tuple, bounds)))


def chain(stretches: int, known: dict[int, list[Piece]], size: int) -> tuple[list[Counts], list[int]]:
    """Each stretch's start as far as it is known or guessed, and the stretches whose piece for it is missing."""
    now, starts, missing = (0,) * size, [], []
    for s in range(stretches):
        starts.append(now)
        piece = next((p for p in known.get(s, ()) if p.holds(now)), None)
        if piece is None and s < stretches - 1:  # nothing follows the last one
            missing.append(s)
            piece = known[s][-1] if known.get(s) else None
        if piece:
            now = tuple(a + b for a, b in zip(now, piece.picks))
    return starts, missing


def _stretches(rows: DataFrame) -> DataFrame:
    return rows.repartition("target", "stretch").sortWithinPartitions("target", "stretch", "number")


def _by_stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[int], list[tuple[int, ...]]]]:
    key, numbers, options = None, [], []
    for batch in batches:
        for target, stretch, number, some in zip(*(batch.column(c).to_pylist() for c in ("target", "stretch", "number", "options"))):
            if (target, stretch) != key:
                if key is not None:
                    yield key, numbers, options
                key, numbers, options = (target, stretch), [], []
            numbers.append(number)
            options.append(tuple(some))
    if key is not None:
        yield key, numbers, options


def least_used(rows: DataFrame, classes: int, stretch: int = STRETCH) -> DataFrame:
    """(target, number, choice) of rows (target, number, options).

    Each target's rows are numbered from 0 without gaps; options are indexes
    below classes, rising, at least one. In the order of the numbers each row
    picks the one of its options that the target's rows before it picked
    least often, the first on ties. Rows are read again in each round; a single
    stretch needs none. A task holds one stretch.
    """
    spark = rows.sparkSession
    cut = rows.select("target", "number", F.col("options").cast("array<int>").alias("options"), F.floor(F.col("number") / stretch).alias("stretch"))
    sizes = {r["target"]: r["n"] for r in cut.groupBy("target").agg((F.max("stretch") + 1).alias("n")).collect()}
    known: dict[str, dict[int, list[Piece]]] = {t: {} for t in sizes}
    while True:
        starts, asked = {}, {}
        for t, n in sizes.items():
            at, missing = chain(n, known[t], classes)
            starts |= {(t, s): at[s] for s in range(n)}
            asked |= {(t, s): at[s] for s in missing}
        if not asked:
            break
        wanted = spark.createDataFrame(list(asked), "target string, stretch long")

        def run(batches: Iterator[pa.RecordBatch], asked: dict = asked) -> Iterator[pa.RecordBatch]:
            for (target, s), _, options in _by_stretch(batches):
                piece = go_through(options, asked[target, s])
                yield pa.RecordBatch.from_pylist([{"target": target, "stretch": s, "picks": piece.picks, "bounds": piece.bounds}], pa.schema([("target", pa.string()), ("stretch", pa.int64()), ("picks", pa.list_(pa.int64())), ("bounds", pa.list_(pa.list_(pa.int64())))]))

        gone = _stretches(cut.join(F.broadcast(wanted), ["target", "stretch"])).mapInArrow(run, "target string, stretch long, picks array<long>, bounds array<array<long>>")
        for r in gone.collect():  # a few numbers for each stretch
            known[r["target"]].setdefault(r["stretch"], []).append(Piece(tuple(r["picks"]), tuple(map(tuple, r["bounds"]))))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (target, s), numbers, options in _by_stretch(batches):
            now, out = list(starts[target, s]), []
            for some in options:
                out.append(pick(some, now))
                now[out[-1]] += 1
            yield pa.RecordBatch.from_arrays([pa.array([target] * len(out), pa.string()), pa.array(numbers, pa.int64()), pa.array(out, pa.int32())], ["target", "number", "choice"])

    return _stretches(cut).mapInArrow(choose, "target string, number long, choice int")
