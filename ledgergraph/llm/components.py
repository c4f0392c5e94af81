"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgergraph.llm.common import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links with the same components as (a, b): each node but the least of its component, with that least node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the least node that can be reached, for each node of ``links (a, b)`` but the least ones.

    Each round a node links its larger neighbours to the least node around it (large star), then all its smaller
    neighbours to the least of them (small star), until every component is one star. A round reads the table of the
    round before, so nothing is computed twice and lost executors cost one round at most. Minima and joins only: the
    neighbours of a node are never gathered.
    """
    both = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(links.select(both.alias("l")).select("l.a", "l.b").where("a <> b").distinct(), "links")
    seen = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = state
        around = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(stars.union(small.select("a", F.col("m").alias("b"))).distinct(), "links")
