"""Connected components: edges are contracted inside parts of a bounded size, then parts are joined by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges that one task contracts.
PART_EDGES = 500_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges, sorted, and the least node that each can reach."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(at, 2)
    parent = np.arange(len(ids))
    while len(a):
        pa_, pb = parent[a], parent[b]
        open_ = pa_ != pb
        a, b, pa_, pb = a[open_], b[open_], pa_[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return ids, ids[parent]


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Of the edges in each part, dealt out evenly, a star for each of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column("u").to_numpy(), batch.column("v").to_numpy()) for batch in batches if batch.num_rows]
        if held:
            ids, least = least_reachable(*(np.concatenate(x) for x in zip(*held)))
            keep = ids != least
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(least[keep], pa.int64())], ["u", "v"])

    return edges.repartition(parts).mapInArrow(run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(materialize(least, "least"), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or is the smaller neighbour of others, not both."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("above")).where("below > 1 OR (below = 1 AND above = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in the edges (u, v); component is the least node reachable.

    Ids are long and not null; loops and repeated edges do no harm. A node
    that only loops is not returned. Each round is written to the shared
    folder, so that the lineage stays short and the least neighbours are joined
    as a table: Spark can then split a node of very many neighbours. It ends
    when the edges are stars, which they become, as their smaller ends only
    ever get smaller; those of a single part are so from the start.
    """
    flat = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    flat = materialize(flat, "edges")
    parts = -(-flat.count() // PART_EDGES) or 1
    flat = materialize(_contracted(flat, parts), "edges")
    while parts > 1 and not _are_stars(flat):
        starred = materialize(_large_star(flat).distinct(), "edges")
        flat = materialize(_small_star(starred).distinct(), "edges")
    return flat.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(flat.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
