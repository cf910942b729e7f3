"""Vector codes against plain Python on small tables."""

import hashlib
import math

import numpy as np

from foliospark.llm.vector_codes import compress

SCHEMA = "vec_id long, embedding array<float>, label int, row string, p int, part int, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 1, 2, 3) for i, v, c in rows], SCHEMA)


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), c) for i, v, c in kept]
    starts = {}
    for i, v, _ in kept:
        starts[i] = min(starts.get(i, v), v)
    ids = sorted(starts, key=lambda i: (i is None, i))[:entries]
    at = lambda v, p: v[p * width : (p + 1) * width]
    books = [[at(starts[i], p) for i in ids] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(at(v, p), book)[1], []).append(at(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(book)]
    found = [(i, c, [nearest(at(v, p), books[p]) for p in range(parts)]) for i, v, c in kept]
    totals = {}
    for _, c, x in found:
        totals[c] = totals.get(c, 0) + sum(d for d, _ in x)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in x), sum(d for d, _ in x), totals[c]) for i, c, x in found), key=repr), sha


def run(spark, rows):
    out, books = compress(table(spark, rows))
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()), key=repr), books.sha256()


def test_equals_plain_lloyd(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 16).astype(np.float32)], int(i) % 3 if i % 5 else None) for i in rng.permutation(300)]
    hot = rows[7][1]
    rows += [(1000 + i, hot, 1) for i in range(150)]  # a third of the rows are one vector
    assert run(spark, rows) == plain(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.5, -0.25, 0.125], 1), (5, [0.5, -0.5, 0.125], 1), (5, [0.5, -0.5, 0.125], 1), (None, [1.0] * 17, None), (1, None, 1), (2, [nan], 1), (3, [inf, 1.0], 2), (4, [None, 1.0], 2), (9, [], 7), (8, [-1e-9] * 16, None)]
    assert run(spark, rows) == plain(rows)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [float(i % 2)] * 8, 0) for i in range(2)] + [(9, [0.5] * 8, 0)]
    got, _ = compress(table(spark, rows), entries=2, rounds=0)
    assert {r["vec_id"]: r["code"] for r in got.collect()}[9] == "00" * 8


def test_very_large_components_stay_in_range(spark):
    got, _ = compress(table(spark, [(1, [3e38] * 8, 0), (2, [-3e38] * 8, 0), (3, [0.0] * 8, 0)]), entries=1)
    assert all(0 <= r["error"] < 2**63 for r in got.collect())


def test_empty(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")], 2)]):
        out, books = compress(table(spark, rows))
        assert out.collect() == [] and books.sha256() == hashlib.sha256(b"").hexdigest()
