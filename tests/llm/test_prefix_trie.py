"""The trie of turns against plain Python; its sort and its open paths by themselves."""

import hashlib
import random
import re
import zlib

import pytest

from foliospark.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, tokens int, k int, depth string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    return trie(convs)


def trie(convs):
    nodes = {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids = {k: [x for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k] for k in nodes}
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0

    def below(k):
        return [k] + [y for x in kids[k] for y in below(x)]

    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids[k]), sum(not kids[x] for x in below(k)), sum((len(nodes[x]) - 1) * words(x) for x in below(k)), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(nodes):
    return sorted((tuple(r[c] for c in COLUMNS) for r in nodes.collect()), key=repr)


def run(spark, rows):
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    return found(pt.prefix_trie(pt.rebuilt(table)))


def some(n, seed=1):
    """Conversations over few texts; a third of them begin alike, a third are equal."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        if c % 3 == 0:
            texts = ["hot start"] * 3 + [rng.choice("abc") for _ in range(rng.randint(0, 4))]
        elif c % 3 == 1:
            texts = ["the", "same one"]
        else:
            texts = [rng.choice(["a b", "b", "c  d e", ""]) for _ in range(rng.randint(1, 6))]
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    return rows


def test_equals_plain(spark):
    rows = some(150)
    random.Random(2).shuffle(rows)
    assert run(spark, rows) == plain(rows)


def test_many_rounds_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(pt, "RANGE_BYTES", 200)
    monkeypatch.setattr(pt, "FAN_IN", 3)
    rows = some(120, seed=5)
    assert run(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    long = "word " * 20_000
    rows = [
        (None, 1, "user", "no id"), (20, None, "user", "b"), (20, None, "user", "a"), (20, 0, None, None), (20, 0, None, None),
        (21, 5, "user", long), (21, 3, "user", "first"), (22, 1, "", ""), (27, 1, "user", "only"), (-7, 0, "user", "x"),
        (41, 0, "a", "12"), (42, 0, "a1", "2"), (45, 0, "a", None), (45, 0, "a", "z"), (45, 0, "a", "y"),
    ]
    rows += [(60, i, "user", f"t{i % 7}") for i in range(400)] + [(80, i, "user", f"t{i % 7}") for i in range(300)]
    minus = lambda c: c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))  # noqa: E731  the remainder has the sign of the id
    assert minus(-7) == 0
    assert run(spark, rows) == plain(rows)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []


def test_turnless_conversation(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(c, 0, "user", "gone")]
    assert run(spark, rows) == plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("seed", range(30))
def test_loser_tree_shares_what_neighbours_share(seed):
    rng = random.Random(seed)
    turn = lambda: bytes([rng.randint(0, 2)]) * pt.TOKEN
    rows = list({b"".join(turn() for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 200))})
    runs = [[] for _ in range(rng.randint(1, 9))]
    for r in rows:
        rng.choice(runs).append((r,))
    merged = list(pt.LoserTree([[(x[0], shared, None) for shared, x in pt.sorted_run(run)] for run in runs]))
    assert [m[0] for m in merged] == sorted(rows)
    for (a, _, _), (b, shared, _) in zip(merged, merged[1:]):
        assert shared == next((i for i in range(min(len(a), len(b)) // pt.TOKEN) if a[i * 20 : i * 20 + 20] != b[i * 20 : i * 20 + 20]), min(len(a), len(b)) // pt.TOKEN)
