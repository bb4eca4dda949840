"""From records to arms: dual-therapy cohort, new users, candidate drugs, control draws.

Expected columns: records (ptid, rx_date, drug, code), cohort (ptid, dx_date, ...), treated
(drug, ptid, therapy_date, index_date, delta_days).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialkit.functions.dates import within_days
from trialkit.functions.hashing import hash32_many
from trialkit.operators.joins import join_numbered, not_in_ignoring_case, spread, with_cohort
from trialkit.operators.ranks import dense_positions
from trialkit.session import cut


def gap_or_null(event: Column, anchor: Column, days: int = 365 * 5) -> Column:
    """True when there is no event, or it is more than `days` away from the anchor."""
    return event.isNull() | (F.abs(F.datediff(event, anchor)) > days)


def dual_therapy(cohort: DataFrame, records: DataFrame, codes: DataFrame, before: int = 14, after: int = 90) -> DataFrame:
    """Cohort with combined_therapy (1 if both classes occur around diagnosis) and the first date of either.

    `codes` has one row per code with 0/1 columns class_a and class_b. The cohort is read more than once,
    so pass a materialised table.
    """
    coded = records.select("ptid", "rx_date", "code").join(codes.where("class_a + class_b > 0"), "code")
    around = with_cohort(coded.select("ptid", "rx_date", "class_a", "class_b"), cohort.select("ptid", "dx_date"))
    per_patient = (
        around.where(within_days(F.col("rx_date"), F.col("dx_date"), before, after))
        .groupBy("ptid")
        .agg(F.max("class_a").alias("_a"), F.max("class_b").alias("_b"), F.min("rx_date").alias("_first"))
        .where("_a = 1 and _b = 1")
    )
    return cohort.join(per_patient, "ptid", "left").select(
        *cohort.columns,
        F.when(F.col("_first").isNotNull(), 1).otherwise(0).alias("combined_therapy"),
        F.col("_first").alias("combined_therapy_date"),
    )


def drug_users(cohort: DataFrame, records: DataFrame, follow: int = 90, washout: int = 90) -> DataFrame:
    """Everybody with the drug within `follow` days of therapy, one row per (drug, patient).

    treated = 1 for new users: at least two distinct days in the window, and the last earlier record (if
    any) more than `washout` days ahead of the first. All other cohort members are controls of the drug.
    The cohort is read more than once, so pass a materialised table.
    """
    joined = with_cohort(records.select("ptid", "drug", "rx_date"), cohort.select("ptid", "therapy_date"))
    day, start = F.col("rx_date"), F.col("therapy_date")
    inside = (day >= start) & (day <= F.date_add(start, follow))
    spans = (
        joined.where(day <= F.date_add(start, follow))
        .groupBy("drug", "ptid", "therapy_date")
        .agg(
            F.min(F.when(inside, day)).alias("index_date"),
            F.max(F.when(inside, day)).alias("last_date"),
            F.max(F.when(day < start, day)).alias("history_date"),
        )
        .where("index_date is not null")
    )
    washed = F.col("history_date").isNull() | (F.datediff("index_date", "history_date") > washout)
    return spans.select(
        "drug",
        "ptid",
        "therapy_date",
        "index_date",
        F.datediff("index_date", "therapy_date").alias("delta_days"),
        ((F.col("last_date") > F.col("index_date")) & washed).cast("int").alias("treated"),
    )


def new_users(cohort: DataFrame, records: DataFrame, follow: int = 90, washout: int = 90) -> DataFrame:
    return drug_users(cohort, records, follow, washout).where("treated = 1").drop("treated")


def candidate_drugs(
    records_in_window: DataFrame, users: DataFrame, excluded: DataFrame, excluded_col: str,
    min_records: int = 100, min_treated: int = 100,
) -> DataFrame:
    """Drugs with enough records and treated patients that are not on the excluded list."""
    frequent = records_in_window.groupBy("drug").agg(F.count(F.lit(1)).alias("n_records")).where(F.col("n_records") > min_records)
    treated = users.groupBy("drug").agg(F.sum("treated").alias("n_treated")).where(F.col("n_treated") > min_treated)
    return not_in_ignoring_case(frequent, "drug", excluded, excluded_col).join(treated, "drug")


def control_members(cohort: DataFrame, treated: DataFrame, drug: str) -> DataFrame:
    """The control pool of one drug: cohort members who are not its new users."""
    return cohort.join(treated.where(F.col("drug") == drug).select("ptid"), "ptid", "left_anti")


@dataclass
class DrawTables:
    """What draws are made of: numbered cohort members, the arm rows of every drug with their numbers, and swaps of drawn numbers that are treated."""

    members: DataFrame
    arm: DataFrame
    swaps: DataFrame
    n_members: int
    n_arm: int


def draw_tables(treated: DataFrame, cohort: DataFrame) -> DrawTables:
    """Members (ptid, therapy_date, member), arm (drug, ptid, delta_days, t_pos, n_treated, drug_no, n_control) and swaps (drug_no, control, swap); see `control_draws`."""
    members = cut(dense_positions(cohort.select("ptid", "therapy_date"), [], "ptid", "member"))
    n_members = members.count()
    sizes = treated.groupBy("drug").agg(F.count(F.lit(1)).alias("n_treated"))
    arm = cut(
        dense_positions(treated.select("drug", "ptid", "delta_days"), ["drug"], "ptid", "t_pos")
        .join(dense_positions(sizes, [], "drug", "drug_no"), "drug")
        .withColumn("n_control", n_members - F.col("n_treated"))
    )
    n_arm = arm.count()
    taken = arm.join(members.select("ptid", "member"), "ptid").select("drug", "drug_no", "member", "n_control")
    holes = dense_positions(
        taken.where("member < n_control").select("drug", "drug_no", F.col("member").alias("control")), ["drug"], "control", "k"
    )
    fillers = arm.select("drug", (F.col("n_control") + F.col("t_pos")).alias("member")).join(
        taken.select("drug", "member"), ["drug", "member"], "left_anti"
    )
    swaps = holes.join(dense_positions(fillers, ["drug"], "member", "k"), ["drug", "k"]).select(
        "drug_no", "control", F.col("member").alias("swap")
    )
    return DrawTables(members, arm, swaps, n_members, n_arm)


def control_draws(
    treated: DataFrame, cohort: DataFrame, n_boot: int = 100, ratio: int = 5, seed: int = 0
) -> DataFrame:
    """`n_boot` draws with replacement of `ratio` x treated controls per drug, all drugs at once.

    Returns (drug, boot_id, rep, ptid, therapy_date, delta_days, index_date). A control's index date is
    its own therapy date plus a day offset drawn from the treated.

    The control pool of a drug is never listed. Cohort members are numbered once; control number u of a
    drug with c controls is member u, unless that member is treated: the treated numbers below c (holes)
    are paired one to one with the untreated numbers from c on (fillers). Draw slots hang on the treated
    rows, so a big drug's slots are spread over as many tasks as its treated patients; their hashes are taken
    many at a time, and members, offsets and swaps are found by number.
    """
    tables = draw_tables(treated, cohort)
    members, arm, swaps, n_members, n_arm = tables.members, tables.arm, tables.swaps, tables.n_members, tables.n_arm
    slots = spread(arm.where("n_control > 0").select("drug", "drug_no", "t_pos", "n_treated", "n_control"), n_arm * n_boot * ratio, "drug", "t_pos")
    text = slots.schema["drug"].dataType
    drawn = slots.withColumn("_text", F.col("drug").cast("string")).mapInArrow(
        partial(_drawn, n_boot=n_boot, ratio=ratio, seed=seed), f"drug {text.simpleString()}, drug_no long, boot_id int, rep long, control long, t_pos long"
    )
    # a number for every drug and position; as long as these tables are small when counted, the draws are never shuffled
    span = -(-n_members // 64) * 64
    number = lambda position: F.col("drug_no") * F.lit(span) + F.col(position)
    swapped = join_numbered(drawn, swaps, ["drug_no", "control"], number("control")).withColumn("member", F.coalesce("swap", "control"))
    offsets = arm.where("n_control > 0").select("drug_no", "t_pos", "delta_days")
    placed = join_numbered(swapped, members, ["member"], F.col("member"), "inner", 48)
    return join_numbered(placed, offsets, ["drug_no", "t_pos"], number("t_pos"), "inner").select(
        "drug", "boot_id", "rep", "ptid", "therapy_date", "delta_days",
        F.date_add("therapy_date", F.col("delta_days")).alias("index_date"),
    )


def _drawn(batches: Iterator[pa.RecordBatch], n_boot: int, ratio: int, seed: int, at_once: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The drawn positions of all slots of treated rows; they equal `hash_position` of the same parts."""
    per_row = n_boot * ratio
    boots, turns = np.repeat(np.arange(n_boot), ratio), np.tile(np.arange(ratio), n_boot)
    for batch in batches:
        step = max(1, at_once // max(1, per_row))
        for lo in range(0, batch.num_rows, step) if per_row else ():
            part = batch.slice(lo, step)
            drug, drug_no, t_pos, n_treated, n_control, text = part.columns
            coded, n = text.dictionary_encode(), part.num_rows
            texts = [t.encode() for t in coded.dictionary.to_pylist()]
            codes = np.repeat(coded.indices.to_numpy(), per_row)
            boot, rep = np.tile(boots, n), np.repeat(t_pos.to_numpy() * ratio, per_row) + np.tile(turns, n)
            sizes = (np.repeat(size.to_numpy(), per_row) for size in (n_control, n_treated))
            drawn = [drawn_positions(what, seed, (texts, codes), boot, rep) % size for what, size in zip(("control", "offset"), sizes, strict=True)]
            row = pa.array(np.repeat(np.arange(n), per_row))
            arrays = [drug.take(row), drug_no.take(row), pa.array(boot, pa.int32()), *(pa.array(a) for a in (rep, *drawn))]
            yield pa.RecordBatch.from_arrays(arrays, names=["drug", "drug_no", "boot_id", "rep", "control", "t_pos"])


def drawn_positions(what: str, seed: int, drug: bytes | tuple[Sequence[bytes], np.ndarray], boot: bytes | np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Hashes of slots; the remainder by the number of controls ("control") or treated ("offset") is the number drawn."""
    return hash32_many(f"{what}|{seed}|".encode(), drug, b"|", boot, b"|", rep)


def union_records(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Stack record sources under one schema with a `source` tag."""
    tagged = [df.withColumn("source", F.lit(tag)) for tag, df in sources]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
