"""Connected components of an edge table, spread over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.llm.common import cut


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Large-star and small-star steps in turn: each node hands the smallest of its neighbourhood to its larger, then to
    its smaller neighbours, until every node points at the smallest of its component. Neighbourhoods are never
    collected: a step is a minimum by key, which is summed up before the shuffle, and a join whose large keys can be
    split. Each round is written to the checkpoint folder; only one row of counts comes to the driver.
    """
    return labels(contracted(edges.select(F.col(u).alias("u"), F.col(v).alias("v"))))


def contracted(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges (u, v), v < u, that connect what the given ones connect, after so many rounds; without a number, until all are stars."""
    e = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state, done = _state(e) if rounds is None else (1,), 0
    while state[0] and done != rounds:
        done += 1
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(rest.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        if rounds is None:
            now = _state(e)
            if now == state:
                break
            state = now
    return e


def labels(e: DataFrame) -> DataFrame:
    """(node, component) of contracted edges: nodes of one component are connected; of stars, all that are."""
    own = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().join(own, "node", "left_anti")
    return own.unionAll(roots.select("node", F.col("node").alias("component")))


def _state(e: DataFrame) -> tuple:
    """A fingerprint of an edge set: its size, and order-free sums of two hashes."""
    row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(2**40)), F.sum(F.hash("u", "v").cast("bigint"))).first()
    return tuple(row)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes can reach over the edges (a[i], b[i])."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label
