"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.session import write_table


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces links between a and b by as few that join the same nodes: each node to the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``) that is not its component's smallest node.

    Rounds of a large star (each node's larger neighbours move to its smallest neighbour) and a small star (the same for
    the smaller ones) until nothing changes; their number grows with the logarithm of the longest chain. Both are a
    grouped minimum, combined before the shuffle, and a join; minima are written first, so that both sides are dealt anew
    and Spark can split a hub. Each round is written to the shared folder. Links from a node to itself, nulls and repeated links are dropped; no links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = write_table(edges.where("a <> b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = write_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lowest")
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = write_table(moved.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
