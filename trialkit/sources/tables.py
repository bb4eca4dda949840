"""Scans with fixed schemas, and sinks laid out for partition pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_parquet(spark: SparkSession, folder: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df


def read_delimited(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Delimited text under a fixed schema; types are never inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_name_list(lines: DataFrame, text: str, name: str = "name") -> DataFrame:
    """JSON lists of names, one list per row, flattened to a distinct dimension."""
    items = F.from_json(F.col(text), "array<string>")
    return lines.select(F.explode(items).alias(name)).distinct()


def nest_history(
    events: DataFrame, keys: Sequence[str], name: str, date: str, value: str, list_size: int = 10_000
) -> DataFrame:
    """Long (key, name, date, value) to date-sorted arrays of (date, value, copies).

    A key's history is one array, or several numbered parts when it has far more than `list_size`
    different entries, so no array grows with the longest history.
    """
    by = [*keys, name]
    entries = events.groupBy(*by, date, value).agg(F.count(F.lit(1)).alias("_copies"))
    parts = entries.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / list_size).alias("_parts"))
    item = F.struct(F.col(date).alias("date"), F.col(value).alias("value"), F.col("_copies").alias("copies"))
    part = F.pmod(F.xxhash64(date, value), F.col("_parts")).alias("part")
    return (
        entries.join(parts, by)
        .select(*by, part, item.alias("_item"))
        .groupBy(*by, "part")
        .agg(F.sort_array(F.collect_list("_item")).alias("history"))
    )


def flatten_history(nested: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    items = nested.select(*keys, name, F.explode("history").alias("item"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("item.copies")))
    return items.select(*keys, name, "item", copies.alias("_copy")).select(*keys, name, "item.date", "item.value")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite a table; with partition columns, rows of one partition are written together.

    AQE splits a partition value that is far larger than the rest, so a hot value becomes several files.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").format(fmt).partitionBy(*partition_by).save(path)


def reuse(df: DataFrame) -> DataFrame:
    """Pin a result that several steps read; blocks lost with an executor are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
