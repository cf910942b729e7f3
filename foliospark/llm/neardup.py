"""MinHash near-duplicates with SetSketch registers.

Copies of one shingle set, known by 128 bits and its size, are one node. Bands of registers bring nodes into
buckets; in each bucket every node is paired with the bucket's least node
only, and pairs whose similarity, estimated jointly by likelihood, is far too
low are dropped. Two nodes of a bucket that are unlike its least node, as pages
made of shared blocks are, might miss their link so: nodes of which that holds
in several buckets are filed again by a fine sketch, in whose long bands unlike
nodes hardly meet. What hangs
together is a candidate group. Inside a group,
all links are confirmed on the full shingle sets. A group of more than two
blocks is dealt out: each block by itself, then each block with the group's
most linked nodes; what a few blocks hold of loose nodes then meets every
block. A group with more of them is grouped anew, by the fine sketch alone, so
that what hung together over estimates that were a little too high falls apart;
if many are still loose (pages of one template, say), by
the rarest fifth of each set: two linked sets share a shingle there,
whatever order of rarity is used, so no link is lost, and pages that have only
their template in common fall apart. A block's links leave it as a spanning
forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forgetting, keyed_texts, materialize
from .components import connected_components
from .setsketch import REGISTERS, estimate, fingerprint, forget, shingles, sketch

SHINGLE_WORDS = 4
#: Links have 100 * intersection >= MIN_PERCENT * union.
MIN_PERCENT = 80
#: Registers in a band; at similarity 0.8 all 25 bands miss a pair with odds of 5e-5.
BAND = 5
#: Estimated similarity to a bucket's least node from which a node joins its candidate group.
#: Two linked nodes lie within 0.2 (as distance) of each other, so both join unless one is far from all the least nodes.
FLOOR = 0.45
#: A node this far from a least node may be linked with one that was dropped there: FLOOR, the distance of linked nodes, and what the estimate may be off.
SETTLED = 0.7
#: Buckets in which a node's links might be lost, from which it is filed again. With two such, the other 23 miss a link at similarity 0.8 with odds of 1e-4.
RISKY = 3
#: Registers of the fine sketch, and in a band of it: at similarity 0.8 all 102 bands miss a pair with odds of 1e-5, at 0.45 one of them joins a pair with odds of 3 %.
FINE_REGISTERS = 1024
FINE_BAND = 10
FINE_FLOOR = 0.55
BLOCK = 256
#: Texts of a large group from which the order of its shingles' rarity is taken. Links do not depend on it.
SAMPLE = 64
#: Blocks of loose nodes up to which they meet every block of their group, which is linear in the group's size and cheaper than grouping it anew.
FEW = 8


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, marks, registers = [], [], []
            for text in batch.column("text").to_pylist():
                elements = shingles(text, size)
                n.append(len(elements))
                marks.append(fingerprint(elements) if len(elements) else None)
                registers.append(sketch(elements).astype("<u2").tobytes() if len(elements) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(registers, pa.binary())], ["doc_id", "n_shingles", "mark", "registers"])

    return texts.mapInArrow(forgetting(run, forget), "doc_id long, n_shingles long, mark binary, registers binary")


def _similar(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) with their estimated similarity: u, v, similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
            found = estimate(a, b, *(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(found)], ["u", "v", "similarity"])

    side = lambda key, tag: nodes.select(F.col("node").alias(key), F.col("n").alias(f"n{tag}"), F.col("registers").alias(f"r{tag}"))
    given = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "na", "nb", "ra", "rb")
    return given.mapInArrow(run, "u long, v long, similarity double")


def _bands(registers: int, band: int) -> Column:
    """The buckets that registers file a node under."""
    return F.expr(f"explode(transform(sequence(0, {registers // band - 1}), b -> xxhash64(b, substring(registers, b * {2 * band} + 1, {2 * band}))))").alias("bucket")


def _risky(met: DataFrame, near: DataFrame) -> DataFrame:
    """Nodes that might have lost links in RISKY buckets or more.

    A link of two nodes is lost in a bucket only if one of them was dropped
    there and both are less than SETTLED similar to its least node: a node more
    similar keeps all its linked ones, as distances add up. So a bucket puts
    its far nodes at risk if there are several and one was dropped.
    """
    far = near.where(F.col("similarity") < SETTLED).select(F.col("u").alias("hub"), F.col("v").alias("node"), "similarity")
    placed = materialize(met.join(far, ["hub", "node"]).select("bucket", "node", "similarity"), "far")
    unsafe = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("similarity").alias("least")).where((F.col("n") > 1) & (F.col("least") < FLOOR))
    return placed.join(materialize(unsafe.select("bucket"), "unsafe"), "bucket").groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= RISKY).select("node")


def _by_fine_sketch(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Pairs (u, v) of the wanted nodes that are alike by the fine sketch.

    In each bucket every node is paired with the least, and with the first by
    one of four orders of hashes, so a node of smaller id that is unlike all
    others hides none of them for long. Linked nodes share some eleven buckets.
    With one unlike node in each of them, which takes some 200,000 pages that
    are 0.3 similar, a link is missed with odds of about 1e-6. The orders are few,
    so that in a large group of near copies most buckets agree on whom to pick.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            registers = [sketch(shingles(text, size), FINE_REGISTERS).astype("<u2").tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(registers, pa.binary())], ["node", "registers"])

    held = texts.join(wanted.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")
    fine = held.mapInArrow(forgetting(run, forget), "node long, registers binary")
    rows = materialize(fine.select("node", _bands(FINE_REGISTERS, FINE_BAND)).distinct(), "fine")
    picked = F.min_by("node", F.xxhash64("node", F.pmod("bucket", F.lit(4))))
    hubs = rows.groupBy("bucket").agg(F.min("node").alias("least"), picked.alias("picked"), F.max("node").alias("last")).where("least < last").drop("last")
    met = rows.join(materialize(hubs, "hubs"), "bucket").select("node", "least", "picked").distinct()
    met = met.select("node", F.explode(F.array("least", "picked")).alias("hub")).where("hub <> node")
    pairs = met.select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct()
    return _similar(pairs, nodes).where(F.col("similarity") >= FINE_FLOOR).select("u", "v")


def confirmed_links(sets: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """Matrix of whether each two sets are linked, from the exact sizes of all intersections."""
    g = len(sets)
    sizes = np.array([len(s) for s in sets])
    if g <= 3:
        shared = np.zeros((g, g))
        for i in range(g):
            for j in range(i + 1, g):
                shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        values, owner = np.concatenate(sets), np.repeat(np.arange(g), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.concatenate([[True], values[1:] != values[:-1]])
        group = np.cumsum(new) - 1
        often = np.bincount(group) > 1
        column = np.cumsum(often) - 1
        use = often[group]
        owner, column = owner[use], column[group[use]]
        shared = np.zeros((g, g), dtype=np.float64)
        for low in range(0, int(often.sum()), columns):
            i, j = np.searchsorted(column, [low, low + columns])
            held = np.zeros((g, columns), dtype=np.float32)
            held[owner[i:j], column[i:j] - low] = 1
            shared += held @ held.T
    links = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(links, False)
    return links


def _forest(keys: list[int], links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect: breadth first from every node not yet seen."""
    seen, edges = np.zeros(len(keys), bool), []
    for root in range(len(keys)):
        if seen[root]:
            continue
        seen[root], queue = True, [root]
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(links[i] & ~seen).tolist():
                seen[j] = True
                edges.append((keys[i], keys[j]))
                queue.append(j)
    return edges


def _confirm(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (u, v) between the nodes of each (group, i, j), whose rows are made to come one after the other.

    One more row for each that has links: v is null, u its most linked node, degree the number of u's links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, sets = None, [], []

        def found() -> list[tuple]:
            if len(keys) < 2:
                return []
            links = confirmed_links(sets, percent)
            degrees = links.sum(axis=1)
            top = int(degrees.argmax())
            edges = [(at[0], at[1], u, v, None) for u, v in _forest(keys, links)]
            return edges + ([(at[0], at[1], keys[top], None, int(degrees[top]))] if degrees[top] else [])

        for batch in batches:
            out = []
            for *key, node, text in zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j", "node", "text"))):
                if key != at:
                    out += found()
                    at, keys, sets = key, [], []
                if keys and keys[-1] == node:  # rows of one doc_id, or a node that comes from both sides
                    continue
                keys.append(node)
                sets.append(shingles(text, size))
            yield _edge_batch(out)
        yield _edge_batch(found())

    dealt = members.select("group", "i", "j", "node", "text").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node")
    return dealt.mapInArrow(forgetting(run, forget), "group long, i int, u long, v long, degree long")


def _edge_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["group", "i", "u", "v", "degree"])


def _common(sample: DataFrame, size: int) -> DataFrame:
    """(group, common): the shingles that several of a group's sampled texts have, the rarest first. Rows of a group come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []

        def found() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64),) * 2
            order = np.lexsort((values, counts))
            order = order[counts[order] > 1]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([values[order].tobytes()], pa.binary())], ["group", "common"])

        for batch in batches:
            for group, text in zip(batch.column("group").to_pylist(), batch.column("text").to_pylist()):
                if group != at:
                    if at is not None:
                        yield found()
                    at, sets = group, []
                sets.append(shingles(text, size))
        if at is not None:
            yield found()

    return sample.select("group", "text").repartition("group").sortWithinPartitions("group").mapInArrow(forgetting(run, forget), "group long, common binary")


def _rarest(members: DataFrame, common: DataFrame, size: int, percent: int) -> DataFrame:
    """(group, shingle, node): of each set so many of its rarest shingles that two linked sets share one.

    A linked set shares percent of its shingles at least, so one of any
    n - ceil(percent n) + 1 first in an order that both use. Here the order is:
    those that the group's sample does not have twice, then the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rank = np.zeros(0, np.uint64)
        for batch in batches:
            parts: list[tuple[int, int, np.ndarray]] = []
            for group, node, text, given in zip(*(batch.column(c).to_pylist() for c in ("group", "node", "text", "common"))):
                if node is None:  # a block's first row
                    given = np.frombuffer(given, np.uint64)
                    by_value = np.argsort(given)
                    known, rank = given[by_value], by_value + 1
                    continue
                elements = shingles(text, size)
                at = np.minimum(np.searchsorted(known, elements), max(len(known) - 1, 0))
                place = np.where(known[at] == elements, rank[at], 0) if len(known) else np.zeros(len(elements))
                keep = len(elements) - -(-percent * len(elements) // 100) + 1
                parts.append((group, node, elements[np.lexsort((elements, place))[:keep]]))
            many = [len(x) for *_, x in parts]
            values = np.concatenate([x for *_, x in parts]).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([g for g, *_ in parts], many).astype(np.int64)), pa.array(values), pa.array(np.repeat([n for _, n, _ in parts], many).astype(np.int64))], ["group", "shingle", "node"])

    none = F.lit(None)
    heads = common.select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), none.cast("long").alias("node"), none.cast("string").alias("text"), "common")
    rows = members.select("group", "own", "node", "text", none.cast("binary").alias("common")).unionByName(heads)
    return rows.repartition("group", "own").sortWithinPartitions("group", "own", F.asc_nulls_first("node")).mapInArrow(forgetting(run, forget), "group long, shingle long, node long")


def _by_rarest(members: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of groups anew: what shares one of its rarest shingles, directly or over others."""
    sizes = materialize(members.groupBy("group", "blocks").agg(F.ceil(F.count("*") / SAMPLE).alias("one_in")), "sizes")
    sample = members.join(sizes.select("group", "one_in"), "group").where(F.pmod(F.xxhash64("node", F.lit(2)), F.col("one_in")) == 0)
    common = materialize(_common(sample, size), "common").join(sizes, "group", "right").withColumn("common", F.coalesce("common", F.lit(b"")))
    rows = materialize(_rarest(members, common, size, percent), "rarest")
    buckets = rows.groupBy("group", "shingle").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    pairs = rows.join(materialize(buckets, "hubs"), ["group", "shingle"]).where("hub <> node").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    return materialize(connected_components(pairs), "groups")


def _links(groups: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int, block: int, hubs: int = 8, anew: int = 0) -> DataFrame:
    """Edges (u, v) that connect what the links inside all groups (node, component) connect; anew: how often they were grouped anew."""
    n_blocks = F.when(F.count("*") > 2 * block, F.ceil(F.count("*") / block)).otherwise(1).cast("int")
    blocks = materialize(groups.groupBy(F.col("component").alias("group")).agg(n_blocks.alias("blocks")), "blocks")
    placed = groups.withColumnRenamed("component", "group").join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    held = materialize(placed.join(texts, placed["node"] == texts["doc_id"]).select("group", "blocks", "own", "node", "text"), "members")
    own = held.withColumns({"i": F.col("own"), "j": F.col("own")})
    first = materialize(_confirm(own, size, percent), "links")
    wide = held.where("blocks > 1")
    edges = first.where("v IS NOT NULL").select("u", "v")
    if wide.isEmpty():  # then every group was in one task
        return edges

    centre = F.max(F.struct("degree", F.col("u").alias("node"))).alias("top")
    centres = materialize(first.where("v IS NULL").groupBy("group", (F.col("i") % hubs).alias("part")).agg(centre).select("group", F.col("top.node").alias("node")), "centres")
    everywhere = wide.join(centres, ["group", "node"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.col("i"))
    parts = ["group", "i", "j", "node", "text"]
    second = materialize(_confirm(own.where("blocks > 1").select(parts).unionByName(everywhere.select(parts)), size, percent).where("v IS NOT NULL"), "links")
    edges = edges.unionByName(second.select("u", "v"))

    of_wide = first.where("v IS NOT NULL").select("group", "u", "v").unionByName(second.select("group", "u", "v")).join(blocks.where("blocks > 1"), "group", "left_semi")
    known = wide.select("group", "node").distinct().join(connected_components(of_wide.select("u", "v")), "node", "left").select("group", "node", F.coalesce("component", "node").alias("class"))
    known = materialize(known, "known")
    sizes = known.groupBy("group", "class").agg(F.count("*").alias("n")).groupBy("group").agg(F.max(F.struct("n", (-F.col("class")).alias("c"))).alias("m")).select("group", (-F.col("m.c")).alias("largest"))
    loose = materialize(known.join(materialize(sizes, "largest"), "group").where("class <> largest").select("group", "node"), "loose")
    loose_blocks = materialize(loose.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("loose_blocks")), "loose")
    groups_left, most = loose_blocks.agg(F.count("*"), F.max("loose_blocks")).first()
    if not groups_left:
        return edges
    if anew < 2 and most > FEW:
        many = wide.join(loose_blocks.where(F.col("loose_blocks") > FEW).select("group"), "group", "left_semi")
        if anew:
            again = _by_rarest(many, size, percent)
        else:
            again = materialize(connected_components(_by_fine_sketch(many, nodes, texts, size)), "groups")
        edges = edges.unionByName(_links(again, nodes, texts, size, percent, block, hubs, anew + 1))
        loose_blocks = loose_blocks.where(F.col("loose_blocks") <= FEW)
    # Few loose ones, or sets that share their rarest shingles too and are still not linked: every loose one meets every block.
    wide = wide.join(loose_blocks, "group")
    every = wide.withColumns({"j": F.col("own"), "i": F.explode(F.sequence(F.lit(0), F.col("loose_blocks") - 1))})
    alone = wide.join(loose, ["group", "node"]).withColumns({"i": F.pmod(F.xxhash64("node", F.lit(1)), F.col("loose_blocks")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    third = _confirm(every.select(parts).unionByName(alone.select(parts)), size, percent)
    return edges.unionByName(third.where("v IS NOT NULL").select("u", "v"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = MIN_PERCENT, block: int = BLOCK) -> DataFrame:
    """Classes of documents with similar shingle sets.

    Returns doc_id, n_shingles, component_id (least doc_id reachable over
    links) and kept (doc_id = component_id). A null or empty text has an empty
    set and is linked with nothing. Rows of one doc_id are one document and
    each give a row; rows without doc_id are linked with nothing, their
    component_id is null and they are kept. An empty table gives an empty one;
    other columns are ignored.
    """
    texts = keyed_texts(docs)
    sketches = materialize(_sketches(texts, size), "sketches")
    given = sketches.where("doc_id IS NOT NULL AND mark IS NOT NULL")
    least = materialize(given.groupBy("mark").agg(F.min("doc_id").alias("node")), "copies")
    nodes = given.join(least, (given["doc_id"] == least["node"]) & (given["mark"] == least["mark"])).select("node", F.col("n_shingles").alias("n"), "registers")

    nodes = materialize(nodes, "nodes")
    rows = nodes.select(_bands(REGISTERS, BAND), "node")
    hubs = rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    # Stored first: between two stored tables Spark can split a bucket that very many nodes share.
    met = materialize(rows.join(materialize(hubs, "hubs"), "bucket").where("hub <> node").select("bucket", "hub", "node"), "met")
    pairs = met.select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    near = materialize(_similar(pairs, nodes), "near")
    alike = near.where(F.col("similarity") >= FLOOR).select("u", "v")
    unsettled = materialize(_risky(met, near), "unsettled")
    if not unsettled.isEmpty():
        alike = alike.unionByName(_by_fine_sketch(unsettled, nodes, texts, size)).distinct()
    groups = materialize(connected_components(alike), "groups")

    links = connected_components(_links(groups, nodes, texts, size, percent, block))

    classes = materialize(least.join(links, "node", "left").select("mark", F.coalesce("component", "node").alias("component_id")), "classes")
    found = sketches.drop("registers").join(classes, "mark", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
