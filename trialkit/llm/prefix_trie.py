"""Prefix trie of conversations, with sums over subtrees by centroid decomposition.

A node is a distinct sequence of first turns. Its key is the XOR of hashes of (place, turn), 128 bits, so a parent's key is the node's own
key without its last turn; keys of a conversation are running XORs, taken in chunks, so that no conversation meets in one task.

Sums over subtrees: the number of turns that conversations have at or below a node is known without any walk (from the length of each
conversation) and serves as its weight. In a component the nodes with more than half of its weight are a path from its top; the last of them is
the centroid. The totals of the component at and below the centroid are aggregated and added to the nodes on that path; then the
centroid goes, its children head components of their own, and what is above it stays one. Weights halve, so the number of rounds is
the logarithm of the number of turns, whatever the depth. Components of at most `TASK_NODES` nodes are finished by the same rounds in tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialkit.llm.numbering import numbered
from trialkit.session import broadcast_if_small, cut, settle

CHUNK = 4096
TASK_NODES = 10_000
BUCKET_NODES = 20_000
HUB_CHILDREN = 10_000
_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["a", "b"]


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, x, y, words): turns of each conversation from 0 in the order of turn (null first), role, text.

    x and y are hashes of role and text, null as empty. Rows without a conversation belong to none and are left out; equal rows are turns of their own.
    """
    known = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    spoken = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    kept = cut(
        known.withColumn("h", spoken).select("*", F.xxhash64(F.lit(1), "h").alias("x"), F.xxhash64(F.lit(2), "h").alias("y"), F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words")).drop("h")
    )
    return numbered(kept, "conv", ["turn", "role", "text"], kept.count(), "place", ["conv", "x", "y", "words"])


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, a, b, pa, pb, words, length): the key of every prefix, and of the one before it."""
    hashed = turns.select(
        "conv", "place", "words", F.floor(F.col("place") / CHUNK).alias("chunk"),
        F.xxhash64(F.lit(3), "x", "y", "place").alias("ha"), F.xxhash64(F.lit(4), "x", "y", "place").alias("hb"),
    )
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = hashed.groupBy("conv", "chunk").agg(F.bit_xor("ha").alias("ta"), F.bit_xor("hb").alias("tb"))
    none = F.lit(0).cast("long")
    carried = totals.select("conv", "chunk", F.coalesce(F.bit_xor("ta").over(before), none).alias("ta"), F.coalesce(F.bit_xor("tb").over(before), none).alias("tb"))
    upto = Window.partitionBy("conv", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.select("*", F.bit_xor("ha").over(upto).alias("ia"), F.bit_xor("hb").over(upto).alias("ib"))
    keyed = inside.join(carried.join(convs, "conv"), ["conv", "chunk"]).select(
        "*", F.col("ia").bitwiseXOR(F.col("ta")).alias("a"), F.col("ib").bitwiseXOR(F.col("tb")).alias("b")
    )
    return keyed.select(
        "conv", (F.col("place") + 1).alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb"),
        "words", "length",
    )


def _same(left: str, right: str) -> Column:
    return (F.col(f"{left}a") == F.col(f"{right}a")) & (F.col(f"{left}b") == F.col(f"{right}b"))


def _with_parent(nodes: DataFrame) -> DataFrame:
    """Add parent_conv_id. Parents with very many children are few and are sent to all tasks, the others meet their children by key."""
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hubs = cut(parents.filter(F.col("n_children") > HUB_CHILDREN).drop("n_children"))
    near = broadcast_if_small(hubs, hubs.count(), 48)
    others = parents.filter(F.col("n_children") <= HUB_CHILDREN).drop("n_children")
    return nodes.join(near, ["pa", "pb"]).unionByName(nodes.join(near, ["pa", "pb"], "left_anti").join(others, ["pa", "pb"], "left"))


def _ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes where conversations end: their ids ascending, comma-joined. Ids travel in blocks and pass the hash one after another."""
    last = prefixes.filter("depth = length").select("conv", F.struct("a", "b").alias("node"))
    whole = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    ended = cut(last.unionByName(convs.filter("length = 0").select("conv", whole.alias("node"))))
    placed = numbered(ended, "node", ["conv"], ended.count(), "place")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = placed.groupBy("node", F.floor(F.col("place") / CHUNK).alias("block")).agg(ids.alias("ids"))
    streams = blocks.select("node.a", "node.b", "block", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        for batch in batches:
            done = []
            for a, b, ids in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ids").to_pylist()):
                if node == (a, b):
                    state.update(b",")
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield _digests(done)
        if node:
            yield _digests([(*node, state.hexdigest())])

    return streams.mapInArrow(run, "a long, b long, ends_sha256 string")


def _digests(done: list[tuple]) -> pa.RecordBatch:
    a, b, ends = zip(*done) if done else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ends, pa.string())], names=["a", "b", "ends_sha256"])


# ---- sums over subtrees


def _preorder(parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, size): places at which each subtree is one run, and its number of nodes."""
    size = np.ones(len(parent), np.int64)
    by_depth = np.argsort(depth, kind="stable")
    inner = [level[parent[level] >= 0] for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)]
    for level in inner[::-1]:
        np.add.at(size, parent[level], size[level])
    place = np.zeros(len(parent), np.int64)
    tops = np.flatnonzero(parent < 0)
    place[tops] = np.cumsum(size[tops]) - size[tops]
    for level in inner:
        level = level[np.argsort(parent[level], kind="stable")]
        up, before = parent[level], np.cumsum(size[level]) - size[level]
        place[level] = place[up] + 1 + before - before[np.searchsorted(up, up)]
    return place, size


def decompose(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray, added: np.ndarray) -> np.ndarray:
    """Sums of `values` (one row per node) over every subtree of a forest, plus `added`; `parent` is -1 for a top. `weight` is the sum of positive
    node weights over the subtree. All components go through a round together."""
    n = len(parent)
    place, size = _preorder(parent, depth)
    weight, out = weight.copy(), added.copy()
    tops = np.flatnonzero(parent < 0)
    tops = tops[np.argsort(place[tops])]
    top = tops[np.searchsorted(place[tops], place, side="right") - 1] if n else np.zeros(0, np.int64)
    live = np.arange(n)
    while len(live):
        path = live[2 * weight[live] > weight[top[live]]]
        centroid = np.full(n, -1)
        path = path[np.argsort(depth[path], kind="stable")]
        centroid[top[path]] = path  # the deepest comes last
        own = centroid[top[live]]
        below = (place[live] >= place[own]) & (place[live] < place[own] + size[own])
        totals = np.zeros_like(values)
        np.add.at(totals, top[live[below]], values[live[below]])
        out[path] += totals[top[path]]
        above = path[centroid[top[path]] != path]
        weight[above] -= weight[centroid[top[above]]]
        inside = live[below & (live != own)]
        over = centroid[top[inside]]
        heads = inside[parent[inside] == over]
        heads = heads[np.lexsort((place[heads], parent[heads]))]
        at = np.searchsorted(parent[heads] * n + place[heads], over * n + place[inside], side="right") - 1
        top[inside] = heads[at]
        live = live[live != own]
    return out


def _in_tasks(nodes: DataFrame, count: int) -> DataFrame:
    """(a, b, leaves, saved) of whole small components, many to a task."""
    bucket = F.pmod(F.xxhash64("la", "lb"), F.lit(max(1, -(-count // BUCKET_NODES)))).alias("bucket")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pd.MultiIndex.from_frame(pdf[["a", "b"]])
        parent = keys.get_indexer(pd.MultiIndex.from_frame(pdf[["pa", "pb"]].rename(columns={"pa": "a", "pb": "b"})))
        la, lb = pdf["la"].to_numpy(), pdf["lb"].to_numpy()
        parent[(la[parent] != la) | (lb[parent] != lb) | ((pdf["a"] == la) & (pdf["b"] == lb)).to_numpy()] = -1
        depth, weight = pdf["depth"].to_numpy(), pdf["weight"].to_numpy()
        sums = decompose(parent, depth, weight, pdf[["leaf", "save"]].to_numpy(), pdf[["leaves", "saved"]].to_numpy())
        return pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "leaves": sums[:, 0], "saved": sums[:, 1]})

    return nodes.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(run, "a long, b long, leaves long, saved long")


def subtree_sums(nodes: DataFrame, prefixes: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """(a, b, leaves, saved): sums of `leaf` and `save` over every subtree. `nodes` is a materialised table with a, b, pa, pb, conv_id (a member), depth,
    weight (turns of members at and below the node), leaf and save; `prefixes` gives the node of a conversation at a depth."""
    zero = F.lit(0).cast("long")
    parent = [F.coalesce(c, zero).alias(c) for c in ("pa", "pb")]
    state = nodes.select("a", "b", *parent, "conv_id", "depth", "weight", "leaf", "save", zero.alias("leaves"), zero.alias("saved"), zero.alias("la"), zero.alias("lb"))
    columns = state.columns
    finished, small = [], []
    steps = prefixes.select(F.col("conv").alias("conv_id"), F.col("depth").alias("at"), *[F.col(c).alias(f"s{c}") for c in ("a", "b", "pa", "pb")])
    while True:
        sizes = cut(state.groupBy("la", "lb").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("all")).filter(F.col("n") > task_nodes))
        groups = sizes.count()
        if not groups:
            small.append(state)
            break
        near = broadcast_if_small(sizes.drop("n"), groups, 48)
        small.append(state.join(near, ["la", "lb"], "left_anti"))
        large = state.join(near, ["la", "lb"])
        best = F.min_by(F.struct("a", "b", "depth", "weight"), "weight").alias("c")
        centroids = cut(large.filter("2 * weight > `all`").groupBy("la", "lb").agg(best).select("la", "lb", *[F.col(f"c.{c}").alias(f"c{c}") for c in ("a", "b", "depth", "weight")]))
        met = large.join(broadcast_if_small(centroids, groups, 80), ["la", "lb"])
        deep = met.filter("depth > cdepth").withColumn("at", F.col("cdepth") + 1).join(steps, ["conv_id", "at"]).withColumn("under", _same("sp", "c"))
        level = met.filter("depth <= cdepth").withColumns({"at": F.col("cdepth"), "sa": F.col("a"), "sb": F.col("b"), "spa": F.col("a"), "spb": F.col("b"), "under": _same("", "c")})
        placed = cut(deep.unionByName(level))
        totals = placed.filter("under").groupBy("la", "lb").agg(F.sum("leaf").alias("tleaf"), F.sum("save").alias("tsave"))
        known = placed.join(broadcast_if_small(totals, groups, 48), ["la", "lb"])
        path, centroid = F.expr("2 * weight > `all`"), _same("", "c")
        added = known.withColumns({
            "leaves": F.col("leaves") + F.when(path, F.col("tleaf")).otherwise(0), "saved": F.col("saved") + F.when(path, F.col("tsave")).otherwise(0),
            "weight": F.col("weight") - F.when(path & ~centroid, F.col("cweight")).otherwise(0),
            "la": F.when(F.col("under"), F.col("sa")).otherwise(F.col("la")), "lb": F.when(F.col("under"), F.col("sb")).otherwise(F.col("lb")),
        })
        split = settle(added.select(*columns, centroid.alias("gone")))
        finished.append(split.filter("gone").select("a", "b", "leaves", "saved"))
        state = split.filter("NOT gone").drop("gone")
    rest = cut(reduce(DataFrame.unionByName, small))
    return reduce(DataFrame.unionByName, [*finished, _in_tasks(rest, rest.count())])


def trie(turns: DataFrame, convs: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """One row per node: key (a, b), parent key (pa, pb; null for the root), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    `turns` has (conv, place, x, y, words), places from 0 without gaps; `convs` has (conv, length) for every conversation, those without turns too,
    which end at the root. n_leaves counts the childless nodes of the subtree, saved_tokens sums (members - 1) * words of the node over it.
    Without conversations there is no node. Two nodes are taken for one with a chance of about 2^-128 per pair.
    """
    prefixes = cut(_prefixes(turns, convs))
    words = F.max("words").alias("words")
    inner = prefixes.groupBy("a", "b", "pa", "pb", "depth").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), words, F.sum(F.col("length") - F.col("depth")).alias("below")
    )
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("length").alias("below")).filter("n_convs > 0").select(
        zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("words"), "below"
    )
    nodes = cut(inner.unionByName(root))
    children = nodes.filter("pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, _KEY, "left").withColumns({
        "n_children": F.coalesce("n_children", zero), "leaf": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
        "save": (F.col("n_convs") - 1) * F.col("words"), "weight": F.col("n_convs") + F.col("below"),
    }))
    sums = subtree_sums(nodes, prefixes, task_nodes)
    named = _with_parent(nodes).join(sums, _KEY).join(_ends(prefixes, convs), _KEY, "left")
    return named.select(
        *_KEY, "pa", "pb", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
