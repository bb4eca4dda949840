"""Joins between event histories and anchors.

Every join has an equality on the patient, so Spark hashes or sorts on that key and AQE splits patients
with very long histories; dates are residual comparisons.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialkit.functions.dates import within_days
from trialkit.operators.ranks import keep_first
from trialkit.session import BROADCAST_BYTES, broadcast_if_small, cut


def _match(event_date: str, anchors: DataFrame, key: str, condition, events: DataFrame) -> DataFrame:
    e, a = events.alias("e"), anchors.alias("a")
    joined = e.join(a, (F.col(f"e.{key}") == F.col(f"a.{key}")) & condition(F.col(f"e.{event_date}")), "inner")
    extra = [c for c in anchors.columns if c not in events.columns]
    return joined.select("e.*", *[F.col(f"a.{c}") for c in extra])


def patient_list(ids: DataFrame, key: str = "ptid") -> DataFrame:
    """The distinct ids, made once; broadcast wherever it is joined if it is small when counted."""
    listed = cut(ids.select(key).distinct())
    return broadcast_if_small(listed, listed.count(), 64)


def of_patients(events: DataFrame, ids: DataFrame, key: str = "ptid") -> DataFrame:
    """Events of the listed ids only, so long histories of everybody else are dropped where they are read."""
    return events.join(patient_list(ids, key), key, "left_semi")


def with_cohort(events: DataFrame, cohort: DataFrame, key: str = "ptid") -> DataFrame:
    """Events joined to a one-row-per-patient table by patient, ready for a grouped aggregate.

    A small counted cohort is broadcast: events stay where they are until their partial aggregates move. A larger one
    is joined by shuffling; the rows are the same either way.
    """
    return events.join(broadcast_if_small(cohort, cohort.count(), 24 * (len(cohort.columns) + 2)), key)


def in_window(
    events: DataFrame, anchors: DataFrame, key: str, event_date: str, anchor_date: str, before: int, after: int
) -> DataFrame:
    """Events from `before` days ahead of the anchor to `after` days past it, both ends included."""
    return _match(event_date, anchors, key, lambda d: within_days(d, F.col(f"a.{anchor_date}"), before, after), events)


def on_or_after(events: DataFrame, anchors: DataFrame, key: str, event_date: str, anchor_date: str, days: int) -> DataFrame:
    return in_window(events, anchors, key, event_date, anchor_date, 0, days)


def strictly_before(
    events: DataFrame, anchors: DataFrame, key: str, event_date: str, anchor_date: str, days: int | None = None
) -> DataFrame:
    """Events ahead of the anchor: all of them, or those at most `days` ahead."""

    def condition(d: Column) -> Column:
        a = F.col(f"a.{anchor_date}")
        return d < a if days is None else (d < a) & (d >= F.date_sub(a, days))

    return _match(event_date, anchors, key, condition, events)


def on_or_after_all(events: DataFrame, anchors: DataFrame, key: str, event_date: str, anchor_dates: Sequence[str]) -> DataFrame:
    """Events on or after every one of several anchor dates."""

    def condition(d: Column) -> Column:
        return reduce(lambda x, y: x & y, [d >= F.col(f"a.{c}") for c in anchor_dates])

    return _match(event_date, anchors, key, condition, events)


def spread(df: DataFrame, rows: int, *by: str, task_rows: int = 1_000_000) -> DataFrame:
    """Shuffle a small table whose rows become many into as many tasks as those `rows` need."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows // task_rows + 1), *by)


_BLOCK_BITS = 6
_WIDTHS = {"bigint": 8, "int": 4, "date": 4, "smallint": 2, "tinyint": 1, "boolean": 1, "double": 8}


def join_numbered(rows: DataFrame, table: DataFrame, on: Sequence[str], number: Column, how: str = "left", row_bytes: int = 96) -> DataFrame:
    """Join very many rows to a table with one row per key, where `number` makes an integer of the key columns `on`, another for every key of the table.

    The table is sent out in blocks of 64 numbers: a bit mask of those in use and one array per column, so a row takes little more than its values and far
    larger tables than by rows are broadcast. `how` is left, inner or left_anti. A table that is too large even so, or that repeats a key, is joined as it is.
    """
    on, held = list(on), [c for c in table.columns if c not in on]
    place = F.col("_at").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).cast("int")
    one, upto = F.lit(1).cast("long"), F.lit(-1).cast("long")
    keyed = table.withColumn("_at", number.cast("long")).where(F.col("_at").isNotNull())
    sorted_rows = F.array_sort(F.collect_list(F.struct("_at", *held)))
    blocks = keyed.groupBy(F.shiftright("_at", _BLOCK_BITS).alias("_block")).agg(
        F.bit_or(F.call_function("shiftleft", one, place)).alias("_mask"), sorted_rows.alias("_rows")
    )
    arrays = [F.col("_rows").getField(c).alias(f"_v{i}") for i, c in enumerate(held)]
    blocks = cut(blocks.select("_block", "_mask", F.size("_rows").alias("_n"), *arrays))
    n, size, single = blocks.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.bool_and(F.bit_count("_mask") == F.col("_n")), F.lit(True))
    ).first()
    width = sum(_WIDTHS.get(table.schema[c].dataType.simpleString(), 48) for c in held)
    if not single or n * (48 + 24 * len(held)) + size * width > BROADCAST_BYTES:
        return rows.join(broadcast_if_small(table, table.count(), row_bytes), on, how)
    met = rows.withColumn("_at", number.cast("long")).join(F.broadcast(blocks.drop("_n")), F.shiftright("_at", _BLOCK_BITS) == F.col("_block"), "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", "_mask", place).bitwiseAND(one) == 1, F.lit(False))
    if how == "left_anti":
        return met.where(~hit).select(*rows.columns)
    index = F.bit_count(F.col("_mask").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", upto, place))))
    met = met.where(hit) if how == "inner" else met
    return met.select(*rows.columns, *[F.when(hit, F.get(f"_v{i}", index)).alias(c) for i, c in enumerate(held)])


def left_all(base: DataFrame, blocks: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left joins on one key set; the base keeps repeats, each block must have one row per key.

    All joins share the key, so Spark shuffles the base once.
    """
    return reduce(lambda left, block: left.join(block, list(keys), "left"), blocks, base)


def prefer_first(primary: DataFrame, secondary: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per id; ids that `primary` lacks come from `secondary`."""
    extra = secondary.join(primary.select(key).distinct(), key, "left_anti")
    return keep_first(primary.unionByName(extra), [key], order)


def with_codes(records: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """Records whose code is in the set; a null code never matches."""
    return records.join(codes.select(code).where(F.col(code).isNotNull()).distinct(), code, "left_semi")


def not_in_ignoring_case(df: DataFrame, col: str, listed: DataFrame, listed_col: str) -> DataFrame:
    names = listed.select(F.lower(listed_col).alias("_lowered")).where(F.col("_lowered").isNotNull()).distinct()
    return df.join(names, F.lower(df[col]) == names["_lowered"], "left_anti")


def match_terms(texts: DataFrame, text: str, terms: DataFrame, term: str, end_anchored: Sequence[str] = ()) -> DataFrame:
    """(text, term): which terms of a dictionary occur in which distinct texts, for dictionaries of any size.

    A term is anchored by its prefix of the largest power of two of characters. Texts send the hash of every window of those lengths, so a text brings at most
    log2(longest term) rows per character, and one equality join finds the candidates, which are then compared whole. No pattern is gathered from the
    dictionary. A term of `end_anchored` must end its text. Terms are plain characters; null and empty terms and null texts match nothing.
    Meant for codes and names: a window carries its text.
    """
    known = terms.select(F.col(term).alias("term")).where("length(term) > 0").distinct()
    known = known.withColumn("_size", F.expr("shiftleft(1, length(bin(length(term))) - 1)"))
    known = cut(known.withColumns({"_key": F.expr("xxhash64(substring(term, 1, _size))"), "_last": F.col("term").isin(list(end_anchored))}))
    counted = known.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per power of two
    sizes, n_terms = sorted(r["_size"] for r in counted), sum(r["n"] for r in counted)
    own = texts.select(F.col(text).alias("text")).where(F.col(text).isNotNull()).distinct()
    starts = lambda s: f"if(length(text) >= {s}, sequence(1, length(text) - {s} + 1), array())"
    windows = [f"transform({starts(s)}, i -> struct(i AS _at, {s} AS _size, xxhash64(substring(text, i, {s})) AS _key))" for s in sizes]
    if not windows:
        return own.select("text", F.lit("").alias("term")).limit(0)
    at = own.select("text", F.explode(F.expr(f"concat({', '.join(windows)})")).alias("_w")).select("text", "_w.*")
    longest = known.agg(F.max(F.octet_length("term"))).first()[0]
    met = at.join(broadcast_if_small(known, n_terms, 64 + longest), ["_size", "_key"])
    here = F.expr("substring(text, _at, length(term)) = term")
    ends = ~F.col("_last") | (F.col("_at") + F.length("term") - 1 == F.length("text"))
    return met.where(here & ends).select("text", "term").distinct()
