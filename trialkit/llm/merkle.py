"""Merkle manifest of a dataset: one tree per group of rows, one tree over their roots, proofs for every row.

Rows are leaves, numbered in order within their group. A level is built by a slot pivot: conditional aggregates spread the children of
each parent into `fanout` columns; the columns concatenated hash to the parent, and without a child's own column they are its siblings.
Going down again, every parent hands its children their siblings on the way to the root. All steps are keyed by (group, place), so a
group of any size is spread, and a level's rows combine before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialkit.llm.numbering import numbered
from trialkit.session import broadcast_if_small, cut

FANOUT = 16
_PATH = "array<struct<left:string,right:string>>"


def digest(parts: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other, as UTF-8; nulls add nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf_digest(values: Sequence[Column | str]) -> Column:
    """Digest of a row: each value as its number of UTF-8 bytes, a colon and its text; `-` for null."""

    def part(value: Column | str) -> Column:
        text = (F.col(value) if isinstance(value, str) else value).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest([part(v) for v in values])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to with the siblings of `path`, from the leaf upwards."""
    return F.aggregate(path, leaf, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level from the leaf, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


@dataclass
class Tree:
    """Trees of many groups: nodes per level (_g, _n nodes of the group there, _pos, _own), and the pivots between levels."""

    levels: list[DataFrame]
    pivots: list[DataFrame]

    def tops(self) -> list[DataFrame]:
        """The last node of every group, in the list at the place of its level."""
        return [level.filter("_n = 1") for level in self.levels]


def _slots(fanout: int) -> list[Column]:
    return [F.col(f"_c{i}") for i in range(fanout)]


def _grow(nodes: DataFrame, most: int, fanout: int) -> Tree:
    """Levels until every group has one node; `most` is the size of the largest group."""
    tree = Tree([nodes], [])
    while most > 1:
        slot = F.pmod("_pos", F.lit(fanout))
        spread = [F.max(F.when(slot == i, F.col("_own"))).alias(f"_c{i}") for i in range(fanout)]
        parent = F.floor(F.col("_pos") / fanout).alias("_pos")
        pivot = cut(tree.levels[-1].filter("_n > 1").groupBy("_g", "_n", parent).agg(*spread))
        own = F.struct(digest([c["digest"] for c in _slots(fanout)]).alias("digest"))
        tree.pivots.append(pivot)
        tree.levels.append(pivot.select("_g", F.ceil(F.col("_n") / fanout).alias("_n"), "_pos", own.alias("_own")))
        most = -(-most // fanout)
    return tree


def _children(pivot: DataFrame, paths: DataFrame, fanout: int) -> DataFrame:
    """The children of the nodes with known paths, with theirs."""
    slots = _slots(fanout)
    digests = [c["digest"] for c in slots]

    def child(i: int) -> Column:
        beside = F.struct(F.concat_ws("", *digests[:i]).alias("left"), F.concat_ws("", *digests[i + 1 :]).alias("right"))
        place = (F.col("_pos") * fanout + i).alias("_pos")
        return F.when(slots[i].isNotNull(), F.struct(place, slots[i].alias("_own"), F.concat(F.array(beside), F.col("_path")).alias("_path")))

    met = pivot.drop("_n").join(paths.select("_g", "_pos", "_top", "_path"), ["_g", "_pos"])
    found = met.select("_g", "_top", F.explode(F.array_compact(F.array(*[child(i) for i in range(fanout)]))).alias("_c"))
    return found.select("_g", "_c._pos", "_c._own", "_top", "_c._path")


def _descend(tree: Tree, above: DataFrame, fanout: int) -> DataFrame:
    """(_g, _pos, _own, _top, _path) of every leaf; `above` has (_g, _top, _path) for the last node of every group."""
    paths = None
    for k, tops in reversed(list(enumerate(tree.tops()))):
        ends = tops.join(above, "_g").select("_g", "_pos", "_own", "_top", "_path")
        paths = ends if paths is None else ends.unionByName(_children(tree.pivots[k], paths, fanout))
    return paths


def _sized(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(rows per group, all rows, rows of the largest group)."""
    sizes = cut(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    return sizes, total or 0, most or 0


@dataclass
class Manifest:
    """`subroots` has one row per group: (group, subroot); `root` is None for a table without rows."""

    leaves: Tree
    top: Tree
    subroots: DataFrame
    root: str | None
    group: str
    carried: list[str]
    fanout: int


def build(
    docs: DataFrame, fields: Sequence[str], group: str = "source", order: str = "doc_id", carry: Mapping[str, Column] | None = None, fanout: int = FANOUT
) -> Manifest:
    """Manifest over the digests of `fields` of every row; `carry` names further columns that `proofs` returns with each row.

    Leaves of a group ascend by (`order`, digest), nulls first; while several nodes remain, every `fanout` consecutive ones (the last run may
    be shorter) become their digest. What remains is the subroot; the subroots, ordered by group (null first, bytewise),
    likewise give the root. Nulls in fields are a mark of their own; an empty text is not null. A null group is a group. Repeated rows are
    leaves of their own, one after the other. Other columns are not read, so their names do not matter. Long texts are hashed where they
    are read. No rows: no subroots, and the root is None.
    """
    carry = {order: F.col(order), group: F.col(group), **(carry or {})}
    payload = [F.col(f"_k{i}").alias(name) for i, name in enumerate(carry)]
    key = F.coalesce(F.concat(F.lit("."), F.col(group).cast("string")), F.lit(""))  # null before all others, which keep their order
    rows = cut(docs.select(key.alias("_g"), leaf_digest(fields).alias("_d"), *[c.alias(f"_k{i}") for i, c in enumerate(carry.values())]))
    sizes, total, most = _sized(rows)
    placed = numbered(rows, "_g", ["_k0", "_d"], total, "_pos")
    own = F.struct(F.col("_d").alias("digest"), *payload).alias("_own")
    nodes = cut(placed.join(broadcast_if_small(sizes, sizes.count(), 96), "_g").select("_g", "_n", "_pos", own))
    leaves = _grow(nodes, most, fanout)
    subroots = cut(reduce(DataFrame.unionByName, [t.select("_g", F.col("_own.digest").alias("_d")) for t in leaves.tops()]))
    groups = subroots.count()
    listed = numbered(subroots.withColumn("_all", F.lit("")), "_all", ["_g"], groups, "_pos", ["_g", "_d"])
    named = F.struct(F.col("_d").alias("digest"), F.col("_g").alias("group")).alias("_own")
    top = _grow(cut(listed.select(F.lit("").alias("_g"), F.lit(groups).cast("long").alias("_n"), "_pos", named)), groups, fanout)
    last = top.tops()[-1].select("_own.digest").first()
    names = subroots.select(F.expr("substring(_g, 2)").alias(group), F.col("_d").alias("subroot"), (F.col("_g") == "").alias("_null"))
    listing = names.select(F.when(~F.col("_null"), F.col(group)).alias(group), "subroot")
    return Manifest(leaves, top, listing, last[0] if last else None, group, list(carry), fanout)


def proofs(m: Manifest) -> DataFrame:
    """One row per leaf: the carried columns, leaf, subroot, root, and `path`: its siblings (left, right) per level, from the leaf to the root."""
    spark = m.subroots.sparkSession
    start = spark.range(1).select(F.lit("").alias("_g"), F.lit(m.root).cast("string").alias("_top"), F.array().cast(_PATH).alias("_path"))
    tops = _descend(m.top, start, m.fanout).select(F.col("_own.group").alias("_g"), F.col("_own.digest").alias("_top"), "_path")
    found = _descend(m.leaves, tops, m.fanout)
    carried = [F.col("_own")[c].alias(c) for c in m.carried]
    return found.select(
        *carried, F.col("_own.digest").alias("leaf"), F.col("_top").alias("subroot"), F.lit(m.root).cast("string").alias("root"), F.col("_path").alias("path")
    )
