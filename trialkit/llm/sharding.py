"""Weighted rendezvous hashing: records go to the shard that scores highest for their key.

The score of a shard depends on the key, the shard's number and its weight only. A new shard takes the rows for which it
scores highest, and no row moves between the others. All of it is column expressions; only the numbering shuffles, and it
moves keys, never texts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialkit.session import broadcast_if_small, cut

BUCKET_ROWS = 2_000
COPY_BLOCK = 10_000


def _hash(key: Column, salt: str) -> Column:
    """53 bits that depend on the key's text; a null key counts as its own value."""
    return F.shiftrightunsigned(F.xxhash64(F.concat(F.lit(f"{salt}:"), F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null")))), 11)


def shard_of(key: Column, shards: int | Mapping[int, float]) -> Column:
    """Number of the shard of a key; `shards` is a count of equal shards, or the weight (above 0) of each shard number.

    Score: -weight / ln(u) with u uniform in (0, 1) from the hash of key and shard. With equal weights the order of the scores
    is the order of the hashes. Equal scores go to the lower number.
    """
    weights = {s: 1.0 for s in range(shards)} if isinstance(shards, int) else dict(shards)
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("shards need weights above 0")
    equal = len(set(weights.values())) == 1

    def score(s: int, w: float) -> Column:
        h = _hash(key, str(s))
        return h.cast("double") if equal else F.lit(-w) / F.log((h + F.lit(0.5)) / F.lit(float(1 << 53)))

    best = F.array_max(F.array(*[F.struct(score(s, w).alias("score"), F.lit(-s).alias("minus")) for s, w in weights.items()]))
    return (-best["minus"]).cast("int")


def with_shard(df: DataFrame, key: str, shards: int | Mapping[int, float], out: str = "shard") -> DataFrame:
    """The table with its shard, for writing with partitionBy(out). No shuffle. A column of that name is an error."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {out}; choose another name for the result")
    return df.withColumn(out, shard_of(F.col(key), shards))


def numbered(df: DataFrame, shard: str, out: str = "slot", expected_shards: int = 16) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order of the hash of the whole row; for narrow tables.

    Equal rows are counted before anything shuffles on a key and dealt out again in blocks, so neither a key with very many copies
    nor one with very many different rows meets a single task. Each shard is cut into buckets of the hash, about 2,000 distinct rows each; a small table of
    counts carries the totals across.
    """
    columns = df.columns
    h, n = "__order", "__copies"
    counted = cut(df.groupBy(*columns).agg(F.count(F.lit(1)).alias(n)).withColumn(h, F.shiftrightunsigned(F.xxhash64(*columns), 11)))
    rows = counted.count()
    bits = max(0, math.ceil(math.log2(max(1.0, rows / (BUCKET_ROWS * expected_shards)))))
    counted = counted.withColumn("__bucket", F.shiftrightunsigned(F.col(h), 53 - bits) if bits else F.lit(0).cast("long"))
    totals = counted.groupBy(shard, "__bucket").agg(F.sum(n).alias("__total"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(shard, "__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inner = Window.partitionBy(shard, "__bucket").orderBy(h, *[c for c in columns if c != shard]).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__rank", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    offsets = broadcast_if_small(offsets, expected_shards << bits, 64)
    placed = placed.join(offsets.withColumnRenamed(shard, "__shard"), (F.col(shard).eqNullSafe(F.col("__shard"))) & (placed["__bucket"] == offsets["__bucket"]))
    first = (F.col("__offset") + F.col("__rank")).alias(out)
    single = placed.filter(F.col(n) == 1).select(*columns, first)
    many = placed.filter(F.col(n) > 1).select(*columns, n, first)
    blocks = many.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPY_BLOCK))))
    inside = F.sequence(F.col("__block") * COPY_BLOCK, F.least(F.col(n), (F.col("__block") + 1) * COPY_BLOCK) - 1)
    copies = blocks.repartition("__block").withColumn("__copy", F.explode(inside))
    return single.union(copies.select(*columns, (F.col(out) + F.col("__copy")).alias(out)))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """One row per document: key, size (UTF-8 bytes of the text plus 1), text_crc32 (unsigned), law, shard, slot and the shard
    among one more. Law `key`: the key and the number of shards decide.

    Null text: no bytes, size 1, checksum 0 as of an empty text. Null keys share a shard. Repeated rows share a shard and get
    slots of their own. Texts are reduced to a size and a checksum in the scan; very long ones need nothing special. No
    rows in, no rows out. Other columns are not looked at, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col(key), shards).alias("shard"), shard_of(F.col(key), shards + 1).alias("grown_shard"),
    )
    return numbered(narrow, "shard", expected_shards=shards)
