"""Vector codes: each part of a vector is named by the nearest entry of its position's codebook.

Components become integers, so that all sums and distances are exact. Equal
parts of a position are one row with a weight, however many vectors share
them; Lloyd's rounds run over those distinct rows only, and the codes are
joined back to the vectors by the part itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Codebooks:
    """entries[position][index] is a list of integer components."""

    entries: list[list[list[int]]]

    def sha256(self) -> str:
        """Of all components in decimal, by position, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for e in book for x in e).encode()).hexdigest()


def _nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, the lower one on ties, and the squared distance."""
    best, code = None, np.zeros(len(parts), np.int64)
    for k, entry in enumerate(book):
        off = parts - entry
        d = np.einsum("ij,ij->i", off, off)
        if best is None:
            best = d
        else:
            closer = d < best
            best[closer], code[closer] = d[closer], k
    return code, best


def _positions(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("p").to_numpy(), batch.column("part").flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _moved(distinct: DataFrame, books: Codebooks, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(position, entry) -> number of parts nearest to it, and their sums. A task sends one row for each, however many rows it has read."""
    held = [np.array(b, np.int64) for b in books.entries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in held]
        total = [np.zeros(b.shape, object) for b in held]
        for batch, at, parts in _positions(batches, width):
            n = batch.column("n").to_numpy()
            kind = np.int64 if int(n.sum()) * int(np.abs(parts).max()) < 2**62 else object  # what a batch's sums may need
            for p, book in enumerate(held):
                here = at == p
                code, _ = _nearest(parts[here], book)
                np.add.at(count[p], code, n[here])
                own = np.zeros(book.shape, kind)
                np.add.at(own, code, parts[here].astype(kind) * n[here].astype(kind)[:, None])
                total[p] += own
        rows = [{"p": p, "k": k, "i": i, "n": int(count[p][k]), "s": str(int(total[p][k][i]))} for p in range(len(held)) for k in range(len(held[p])) if count[p][k] for i in range(width)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("p", pa.int32()), ("k", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.string())]))

    sums = distinct.mapInArrow(run, "p int, k int, i int, n long, s string").groupBy("p", "k", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sums.collect():  # positions x entries x width numbers
        out.setdefault((r["p"], r["k"]), (r["n"], [0] * width))[1][r["i"]] = int(r["s"])
    return out


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, codes, code, error, label_error) of every usable row, and the codebooks.

    Rows whose vector is null or holds null, NaN or infinite components are
    left out. A codebook starts as the parts of the vectors of the smallest
    ids; several rows of one id are one start, its least vector; rows without
    an id come last and are coded like any other. Repeated rows all stay and
    all count. Fewer usable ids than entries make a shorter codebook. Vectors
    shorter than the longest, or of a length that the parts do not divide, go on
    with zeros. Components are held within the range in which a squared
    distance over the whole vector fits 64 bits (beyond 40,000 for 64
    components). label_error is null where it does not fit 64 bits. An empty
    table, or one without a usable row, gives an empty one. Other columns are
    ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is two hex digits")
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    named = named.where(_finite(F.col("v")))
    longest = named.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // parts))
    bound = math.isqrt(2**61 // (parts * width))
    whole = F.transform("v", lambda x: F.floor(F.least(F.lit(float(bound)), F.greatest(F.lit(float(-bound)), x * F.lit(scale)))).cast("int"))
    whole = F.concat(whole, F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("v")))
    vectors = materialize(named.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("whole")), "vectors")

    ids = [r[0] for r in vectors.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    wanted = F.col("vec_id").isin([x for x in ids if x is not None]) | (F.col("vec_id").isNull() & F.lit(None in ids))
    starts = {r["vec_id"]: list(r["least"]) for r in vectors.where(wanted).groupBy("vec_id").agg(F.min("whole").alias("least")).collect()}
    books = Codebooks([[starts[x][p * width : (p + 1) * width] for x in ids] for p in range(parts)])

    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("whole", p * width + 1, F.lit(width)))
    dealt = vectors.select("row", "vec_id", "label", F.posexplode(cut).alias("p", "part"))
    distinct = materialize(dealt.groupBy("p", "part").agg(F.count("*").alias("n")), "parts")
    for _ in range(rounds if ids else 0):
        moved = _moved(distinct, books, width)
        books = Codebooks([[[s // moved[p, k][0] for s in moved[p, k][1]] if (p, k) in moved else e for k, e in enumerate(book)] for p, book in enumerate(books.entries)])
    held = [np.array(b, np.int64).reshape(len(b), width) for b in books.entries]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, values in _positions(batches, width):
            code, error = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for p, book in enumerate(held):
                here = at == p
                code[here], error[here] = _nearest(values[here], book)
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("part"), pa.array(code, pa.int32()), pa.array(error)], ["p", "part", "code", "error"])

    coded = distinct.mapInArrow(assign, "p int, part array<int>, code int, error long")
    each = dealt.join(coded, ["p", "part"]).groupBy("row", "vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("p", "code"))).alias("c"), F.sum("error").alias("error"))
    digits = F.array_join(F.transform("c", lambda x: F.lower(F.lpad(F.hex(x["code"]), 2, "0"))), "")
    found = materialize(each.select("vec_id", "label", F.col("c.code").alias("codes"), digits.alias("code"), "error"), "codes")
    total = found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).select("label", F.expr("try_cast(total AS long)").alias("label_error"))
    out = found.alias("a").join(materialize(total, "labels").alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")))
    return out.select("a.vec_id", "a.label", "codes", "code", "error", "label_error"), books
