"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: Edges that a task contracts at once.
CONTRACTED = 2_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component), for every node of an edge (src bigint, dst bigint).

    Alternating large-star and small-star steps: each links a node's neighbours to its smallest one, so edges never grow
    in number and long chains halve; rounds end when no edge changes any more. Each round is written to the shared folder. Self-loops and repeated edges are
    allowed; no edges give no rows. Hot nodes are aggregated before the shuffle, and joins leave them to AQE's splitting.
    """
    # Edges are contracted in each task first: a task's edges become one per node, to the smallest node it is linked with.
    known = edges.where("src is not null and dst is not null").select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    forward = stage(known.mapInArrow(_contract, "u bigint, v bigint"), "edges")
    if forward.count() < CONTRACTED:
        # What is left is bounded and contracted once more, in one task; that settles it.
        forward = stage(forward.coalesce(1).mapInArrow(_contract, "u bigint, v bigint"), "edges")
        return _labelled(forward.where("u <> v"), forward.where("u = v").select(F.col("u").alias("node")))
    alone = forward.where("u = v").select(F.col("u").alias("node")).distinct()
    current = stage(forward.where("u <> v").distinct(), "edges")
    while not _settled(current):
        # Large-star: every larger neighbour of u is linked to the smallest of u and its neighbours.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small-star: u and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = stage(small, "edges")
    return _labelled(current, alone)


def _labelled(stars_: DataFrame, alone: DataFrame) -> DataFrame:
    """node, root of edges to roots and of nodes without edges, which may be roots too."""
    found = stars_.select(F.col("u").alias("node"), F.col("v").alias("root"))
    rest = stars_.select(F.col("v").alias("node")).unionByName(alone).distinct().join(found, "node", "left_anti")
    return found.unionByName(rest.select("node", F.col("node").alias("root")))


def _settled(edges: DataFrame) -> bool:
    """Every node has one edge, and that to a node without any: the edges are stars."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    chained = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return several.unionByName(chained).isEmpty()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of at most CONTRACTED edges of a task: (larger node, smallest node it is linked with), self-loops kept for nodes without other edges."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns], 1))
        if sum(map(len, held)) >= CONTRACTED:
            yield _batch(stars(np.concatenate(held)))
            held = []
    if held:
        yield _batch(stars(np.concatenate(held)))


def stars(edges: np.ndarray) -> np.ndarray:
    """Edges (node, smallest node that it is linked with), and (node, node) for nodes with no edge but to themselves."""
    nodes, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[at[:, 0]], label[at[:, 1]])
        new = label.copy()
        for side in (0, 1):
            np.minimum.at(new, at[:, side], least)
            np.minimum.at(new, label[at[:, side]], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    star = label != np.arange(len(nodes))
    lone = ~star & ~np.isin(np.arange(len(nodes)), label[star])
    keep = star | lone
    return np.stack([nodes[keep], nodes[label[keep]]], 1)


def _batch(edges: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])
