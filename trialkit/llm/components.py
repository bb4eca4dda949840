"""Connected components of links: spanning forests of bounded blocks of links, then label propagation and pointer jumping on written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialkit.session import cut, settle

#: links a task makes one forest of
BLOCK_LINKS = 1_000_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that links reach from each), for links of at most a block."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, label[side], low)  # roots hang themselves below lower ones
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def forests(links: DataFrame, block: int = BLOCK_LINKS) -> DataFrame:
    """Links (a, b) with the same components as the given ones, but no more in a block than it has nodes: each node with the least one it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for batch in batches:
            for side, part in enumerate(parts):
                part.append(batch.column(side).to_numpy().copy())
        node, root = least_reachable(*map(np.concatenate, parts))
        for lo in range(0, len(node), 100_000):
            hi = lo + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(root[lo:hi]), pa.array(node[lo:hi])], names=["a", "b"])

    return links.repartition(-(-max(1, links.count()) // block)).mapInArrow(run, "a long, b long")


def components(links: DataFrame, a: str = "a", b: str = "b", block: int = BLOCK_LINKS) -> DataFrame:
    """(node, label) for every node of the links; the label is the smallest node of its component. Null ends link nothing.

    Blocks of links are first reduced to a forest each. Then each round gives a node the smallest label around it, and the label of that label.
    Nothing but a count goes to the driver.
    """
    known = cut(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")))
    edges = cut(forests(known, block).distinct())
    labels = cut(edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    edges = cut(edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.filter("a <> b").select("b", "a")))
    while True:
        around = edges.join(labels, edges["v"] == labels["node"]).groupBy(F.col("u").alias("n")).agg(F.min("label").alias("near"))
        lower = labels.join(around, labels["node"] == around["n"], "left").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        moved = settle(lower.join(jump, F.col("low") == F.col("at"), "left").select("node", F.coalesce("next", "low").alias("next"), F.col("label").alias("old")))
        changed = moved.filter("next <> old").limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
