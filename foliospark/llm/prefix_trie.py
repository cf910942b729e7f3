"""The trie of turns that conversations begin with, from their sorted order.

A turn is known by a token of 20 bytes: 128 bits of the SHA-256 of its role
and text, and its number of words. A conversation is the string of its tokens,
so texts are read once and never shuffled. Equal conversations become one row.
Tasks sort theirs into runs, in which each row carries the number of turns it
shares with the row before. Runs are stored, cut by ranges of the sort order,
and merged by a loser tree that compares turns only beyond what is known to be
shared. The merged stream drives a stack of open nodes; a node that the stream
leaves is finished. Nodes on the first and the last path of a range go on in
its neighbours: they are the input of the next round, range by range again, in
which the same stack merges 64 ranges into one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, materialize

TOKEN = 20
#: Bytes of tokens in a sorted run and in a range that one task merges.
RUN_BYTES = 8 << 20
RANGE_BYTES = 4 << 20
#: Ranges that one task of a further round merges.
FAN_IN = 64
#: Characters of conversation ids that are joined at a time.
CHUNK = 1 << 20
NONE = hashlib.sha256(b"").digest()


def _token(role: Column, text: Column) -> Column:
    words = F.regexp_count(text, F.lit(rf"[^{SPACE}]+")).cast("long")
    return F.concat(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32), F.lpad(F.hex(words), 8, "0"))


def turn_lists(rows: DataFrame, group: Column) -> DataFrame:
    """(group, conv_id, turns): the tokens of each conversation in hexadecimal, in order; partitioned by the group, an expression of conv_id.

    Only where rows of one conversation share a turn number are their texts
    compared, as role and text decide their order.
    """
    plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    hashed = materialize(plain.select("conv_id", "turn", F.lit(0).alias("place"), _token(F.col("role"), F.col("text")).alias("token")), "turns")
    tied = hashed.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    tied = materialize(tied, "tied")
    if not tied.isEmpty():
        same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        placed = plain.join(tied, same, "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
        hashed = hashed.join(tied, same, "left_anti").unionByName(placed.select("conv_id", "turn", "place", _token(F.col("role"), F.col("text")).alias("token")))
    listed = hashed.withColumn("group", group).repartition("group").groupBy("group", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "place", "token"))).alias("x"))
    return listed.select("group", "conv_id", F.col("x.token").alias("turns"))


def rebuilt(rows: DataFrame, block: int = 20) -> DataFrame:
    """(conv_id, tokens) where each conversation c begins with the first h turns of c - c % block instead of its own, h = crc32(c) % 4."""
    lists = turn_lists(rows, F.col("conv_id") - F.col("conv_id") % block)
    heads = lists.where("conv_id = group").select("group", F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    begun = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    return lists.join(heads, "group", "left").withColumn("h", h).select("conv_id", F.unhex(F.array_join(F.concat(begun, own), "")).alias("tokens"))


# Sorted runs


def shared_turns(a: bytes, b: bytes, at: int = 0) -> int:
    """How many turns two conversations share, if they are known to share at."""
    most = min(len(a), len(b)) // TOKEN
    step = 1
    while at < most:
        stop = min(at + step, most)
        if a[at * TOKEN : stop * TOKEN] == b[at * TOKEN : stop * TOKEN]:
            at, step = stop, step * 2
        elif step == 1 or stop - at == 1:
            return at
        else:
            most, step = stop - 1, 1  # they differ before stop
            if a[at * TOKEN : most * TOKEN] == b[at * TOKEN : most * TOKEN]:
                return most
    return at


class LoserTree:
    """Merges sorted runs of (tokens, turns shared with the row before, payload); yields the same of the whole."""

    def __init__(self, runs: list[list[tuple[bytes, int, object]]]):
        self.runs, self.next = runs, [0] * len(runs)
        self.now: list[tuple | None] = [None] * len(runs)
        self.shared = [0] * len(runs)  # of a run's row with the row that it was last compared to, at first with nothing
        for r in range(len(runs)):
            self._advance(r, 0)
        self.losers = [-1] * len(runs)
        self.winner = self._play(1) if runs else -1

    def _advance(self, r: int, shared: int | None = None) -> None:
        at = self.next[r]
        if at < len(self.runs[r]):
            self.now[r], self.next[r] = self.runs[r][at], at + 1
            self.shared[r] = self.now[r][1] if shared is None else shared
        else:
            self.now[r] = None

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser remembers what it shares with the winner."""
        if self.now[a] is None or self.now[b] is None:
            return (b, a) if self.now[a] is None else (a, b)
        known = self.shared[a]
        if known != self.shared[b]:
            return (a, b) if known > self.shared[b] else (b, a)
        x, y = self.now[a][0], self.now[b][0]
        at = shared_turns(x, y, known)
        if x[at * TOKEN : (at + 1) * TOKEN] <= y[at * TOKEN : (at + 1) * TOKEN]:
            self.shared[b] = at
            return a, b
        self.shared[a] = at
        return b, a

    def _play(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        winner, self.losers[node] = self._match(self._play(2 * node), self._play(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        k = len(self.runs)
        while k and self.now[self.winner] is not None:
            r = self.winner
            tokens, _, payload = self.now[r]
            yield tokens, self.shared[r], payload
            self._advance(r)
            node = (r + k) // 2
            while node:
                r, self.losers[node] = self._match(r, self.losers[node])
                node //= 2
            self.winner = r


def sorted_run(rows: list[tuple]) -> list[tuple[int, tuple]]:
    """Rows by their tokens (the first of each), with the number of turns each shares with the one before."""
    rows.sort(key=lambda x: x[0])
    return [(shared_turns(rows[i - 1][0], x[0]) if i else 0, x) for i, x in enumerate(rows)]


# Open nodes


@dataclass(slots=True)
class Node:
    token: bytes
    least: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: bytes | None = None
    key: bytes | None = None  # of a node that goes on in other ranges
    first: bool = False  # on the first path of the range
    place: int = 0  # among the nodes that stay open
    waiting: list[int] = field(default_factory=list)  # finished children, by their row


ROOT_KEY = bytes(16)
COLUMNS = (("seg", pa.int64()), ("place", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.int64()), ("parent_key", pa.binary()), ("key", pa.binary()), ("token", pa.binary()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.binary()), ("kind", pa.int32()))
DDL = "seg long, place long, conv_id long, depth long, parent long, parent_key binary, key binary, token binary, n long, children long, leaves long, saved long, ends binary, kind int"
_SCHEMA = pa.schema(list(COLUMNS))
#: Kinds of rows: finished with its parent, finished below a node that is still open, open.
DONE, BELOW, OPEN = 0, 1, 2


def _key(above: bytes, token: bytes) -> bytes:
    return hashlib.blake2b(above + token, digest_size=16).digest()


class OpenPath:
    """The path that the sorted stream is on; final: no neighbour goes on with what is open at the end."""

    def __init__(self, seg: int, final: bool):
        self.seg, self.final = seg, final
        self.path: list[Node] = []
        self.rows: list[list] = []  # finished, in the order of COLUMNS
        self.open: list[tuple[int, int, Node]] = []
        self.pushed = 0

    def push(self, token: bytes, first: bool) -> Node:
        node = Node(token, first=first and not self.final, place=self.pushed)
        self.pushed += 1
        if node.first:
            node.key = _key(self.path[-1].key, token) if self.path else ROOT_KEY
        self.path.append(node)
        return node

    def pop(self) -> None:
        node, depth = self.path.pop(), len(self.path)
        if node.first:
            self._stay(node, depth)
            return
        words = int.from_bytes(node.token[16:], "big")
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * words
        for i in node.waiting:
            self.rows[i][4], self.rows[i][-1] = node.least, DONE
        if self.path:
            above = self.path[-1]
            above.n += node.n
            above.least = node.least if above.least is None else min(above.least, node.least)
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            above.waiting.append(len(self.rows))
        self.rows.append([self.seg, 0, node.least, depth, None, None, node.key, None, node.n, node.children, leaves, saved, node.ends or NONE, DONE])

    def _stay(self, node: Node, depth: int) -> None:
        for i in node.waiting:
            self.rows[i][5], self.rows[i][-1] = node.key, BELOW
        self.open.append((node.place, depth, node))

    def leave(self, depth: int) -> None:
        """Go back to the node of this depth."""
        while len(self.path) > depth + 1:
            self.pop()

    def sequence(self, tokens: bytes, shared: int, n: int, least: int, ends: bytes) -> None:
        """The next conversation of the order, which shares so many turns with the one before."""
        first = not self.pushed
        if first:
            self.push(b"", True)
            shared = 0
        self.leave(shared)
        for at in range(shared * TOKEN, len(tokens), TOKEN):
            self.push(tokens[at : at + TOKEN], first)
        self._end(self.path[-1], n, least, ends)

    @staticmethod
    def _end(node: Node, n: int, least: int, ends: bytes) -> None:
        node.n += n
        node.least = least if node.least is None else min(node.least, least)
        node.ends = ends

    def listed(self, row: dict, first: bool) -> None:
        """An open node of a range. Its parent was listed before and is on the path; so is the node itself, if an earlier range had it."""
        depth = row["depth"]
        if depth < len(self.path) and self.path[depth].token == row["token"]:
            node = self.path[depth]
        else:
            self.leave(depth - 1)
            node = self.push(row["token"], first)
            node.key = row["key"]
        node.n += row["n"]
        if row["conv_id"] is not None:
            node.least = row["conv_id"] if node.least is None else min(node.least, row["conv_id"])
        node.children += row["children"]
        node.leaves += row["leaves"]
        node.saved += row["saved"]
        node.ends = node.ends or row["ends"]

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.final:  # the last path goes on, too
            key = ROOT_KEY
            for depth, node in enumerate(self.path):
                key = node.key = node.key or (_key(key, node.token) if depth else ROOT_KEY)
                node.first = True
        while self.path:
            self.pop()
        for place, depth, x in sorted(self.open, key=lambda x: x[0]):
            self.rows.append([self.seg, place, x.least, depth, None, None, x.key, x.token, x.n, x.children, x.leaves, x.saved, x.ends, OPEN])
        for at in range(0, len(self.rows), 20_000):
            part = self.rows[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*part), COLUMNS)], schema=_SCHEMA)


# Spark jobs


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (k, conv_id) become pieces of the text of each k's ids; the first piece of a task has the tokens."""
    schema = pa.schema([("k", pa.binary()), ("part", pa.int32()), ("no", pa.int64()), ("tokens", pa.binary()), ("ids", pa.string()), ("n", pa.int64()), ("least", pa.int64())])
    key, part, no, tokens, ids, size = None, 0, 0, None, [], 0

    def row() -> dict:
        return {"k": key, "part": part, "no": no, "tokens": tokens, "ids": ",".join(map(str, ids)), "n": len(ids), "least": ids[0]}

    for batch in batches:
        out = []
        for k, p, c, t in zip(*(batch.column(x).to_pylist() for x in ("k", "part", "conv_id", "tokens"))):
            if ids and (k != key or size > CHUNK):
                out.append(row())
                no, tokens, ids, size = no + 1, None, [], 0
            if k != key:
                key, part, tokens = k, p, t
            ids.append(c)
            size += 12
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if ids:
        yield pa.RecordBatch.from_pylist([row()], schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by (k, part, no) become distinct conversations with the hash of their ids; these become sorted runs."""
    schema = pa.schema([("run", pa.int64()), ("pos", pa.int64()), ("shared", pa.int64()), ("tokens", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.binary())])
    held: list[tuple] = []
    size, run, task = 0, 0, 0
    key, tokens, n, least, sha = None, b"", 0, 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, size, run
        rows = [{"run": (task << 32) + run, "pos": i, "shared": shared, "tokens": t, "n": m, "least": lo, "ends": ends} for i, (shared, (t, m, lo, ends)) in enumerate(sorted_run(held))]
        held, size, run = [], 0, run + 1
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema)

    for batch in batches:
        for k, t, ids, m, lo, at in zip(*(batch.column(x).to_pylist() for x in ("k", "tokens", "ids", "n", "least", "task"))):
            task = at
            if k != key:
                if key is not None:
                    held.append((tokens, n, least, sha.digest()))
                    size += len(tokens) + 100
                    if size > RUN_BYTES:
                        yield from flush()
                key, tokens, n, least, sha = k, t, m, lo, hashlib.sha256(ids.encode())
            else:
                n += m
                sha.update(("," + ids).encode())
    if key is not None:
        held.append((tokens, n, least, sha.digest()))
        yield from flush()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs' rows of one range, by (run, pos), as nodes."""
    runs: list[list[tuple]] = []
    last, seg = (None, None), 0
    for batch in batches:
        for at, run, pos, shared, *x in zip(*(batch.column(c).to_pylist() for c in ("seg", "run", "pos", "shared", "tokens", "n", "least", "ends"))):
            seg = at
            if (run, pos - 1) != last:
                runs.append([])
                shared = 0
            runs[-1].append((x[0], shared, x[1:]))
            last = (run, pos)
    if runs:
        path = OpenPath(seg, final=False)
        for tokens, shared, (n, least, ends) in LoserTree(runs):
            path.sequence(tokens, shared, n, least, ends)
        yield from path.finish()


def _joined(final: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Open nodes by (group, seg, place) as nodes; each group is one range of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: OpenPath | None = None
        start, deep = None, -1
        for batch in batches:
            for row in batch.to_pylist():
                if path is None or path.seg != row["group"]:
                    if path is not None:
                        yield from path.finish()
                    path, start, deep = OpenPath(row["group"], final), row["seg"], -1
                first = row["seg"] == start and deep is not None and row["depth"] == deep + 1  # on the group's first path
                deep = row["depth"] if first else None
                path.listed(row, first)
        if path is not None:
            yield from path.finish()

    return run


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The trie's nodes of (conv_id, tokens) rows, a row per conversation.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Without conversations there is no node, not even
    a root. Very many equal conversations are one row from the first shuffle
    on, but for their ids, which are sorted in ranges and hashed as pieces; the
    ranges of the sort order cut the conversations below a frequent turn at
    later turns. One task holds a range's tokens, some 4 MB, or one longer
    conversation's.
    """
    spark = sequences.sparkSession
    keyed = materialize(sequences.select("conv_id", "tokens", F.unhex(F.md5("tokens")).alias("k")), "conversations")
    part = F.spark_partition_id()
    ranged = keyed.repartitionByRange("k", "conv_id").sortWithinPartitions("k", "conv_id").withColumn("part", part)
    pieces = ranged.mapInArrow(_id_chunks, "k binary, part int, no long, tokens binary, ids string, n long, least long")
    by_key = pieces.repartition("k").sortWithinPartitions("k", "part", "no").withColumn("task", part)
    runs = materialize(by_key.mapInArrow(_runs, "run long, pos long, shared long, tokens binary, n long, least long, ends binary"), "runs")

    size = runs.agg(F.sum(F.length("tokens") + TOKEN)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    cut = runs.repartitionByRange(ranges, "tokens").withColumn("seg", part).sortWithinPartitions("run", "pos")
    level = materialize(cut.mapInArrow(_merged, DDL), "nodes", by=("kind",))
    done, spine = [level], []
    while True:
        still = level.where(F.col("kind") == OPEN)
        last = still.agg(F.max("seg")).first()[0]
        if last is None:
            break
        group = F.floor(F.col("seg") / FAN_IN).alias("group")
        dealt = still.drop("kind").select("*", group).repartition("group").sortWithinPartitions("group", "seg", "place")
        level = materialize(dealt.mapInArrow(_joined(last < FAN_IN), DDL), "nodes", by=("kind",))
        done.append(level)
        spine.append(level.where(F.col("kind") != OPEN).select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent")))
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    finished = nodes.where(F.col("kind") == DONE)
    if spine:
        parents = spine[0]
        for more in spine[1:]:
            parents = parents.unionByName(more)
        below = nodes.where(F.col("kind") == BELOW).drop("parent").join(parents, "parent_key")
        finished = finished.unionByName(below.select(finished.columns))
    return finished.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.lower(F.hex("ends")).alias("ends_sha256"))
