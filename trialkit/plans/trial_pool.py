"""Trials made inside the tasks that estimate them, from tables of the size of the cohort.

Draws are hashes, so a trial needs no rows of its own on disk: a task that holds the numbered cohort, the arm rows and the covariates of every stretch of
days in which they stay the same makes the rows of one trial after another, estimates it and keeps its estimates only. The tables are packed into
binary rows, every task gets a copy by the shuffle, and nothing of them passes through the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialkit.functions.hashing import hash32_many
from trialkit.plans.cohort import drawn_positions
from trialkit.plans.survival import event_sums
from trialkit.plans.trial_fit import TrialRows, estimates_in

#: bytes that the copies for all tasks may take before they are compressed, unless there are more cores
COPIES_BYTES = 2 * 1024**3
PACKED = "kind string, payload binary"
ESTIMATES = ("hr_ori", "hr_ori_low", "hr_ori_high", "hr", "hr_low", "hr_high")
COUNTS = ("ori_unbalanced_covariates", "unbalanced_covariates")
SUMS = ("a", "b", "c", "d", "treated_days", "control_days")


def packed(df: DataFrame, kind: str) -> DataFrame:
    """The table as binary rows of some thousand rows each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["kind", "payload"])

    return df.mapInArrow(pack, PACKED)


def narrowed(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, int]:
    """Whole numbers of the columns in the smallest type that holds them, found in one pass; and the bytes of a row of these columns."""
    widths = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "boolean": 1}
    whole = [c for c in cols if df.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")]
    ends = df.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(whole) for n, f in (("lo", F.min), ("hi", F.max))]).first() if whole else None
    kinds = {}
    for i, c in enumerate(whole):
        low, high = ends[f"lo{i}"] or 0, ends[f"hi{i}"] or 0
        fits = next((k for k, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)) if -(1 << bits) <= low and high < 1 << bits), "bigint")
        kinds[c] = fits
    out = df.withColumns({c: F.col(f"`{c}`").cast(k) for c, k in kinds.items()}) if kinds else df
    return out, sum(widths.get(kinds.get(c, df.schema[c].dataType.simpleString()), 8) for c in cols)


@dataclass(frozen=True)
class Job:
    """What a task does for each trial."""

    n_boot: int
    ratio: int
    covariates: tuple[str, ...]
    strata: tuple[str, ...]
    labelled: bool  # the stratum is part of the key of the training split
    classes: tuple[str, ...] = ()
    horizons: tuple[tuple[str, int | None], ...] = ()
    threshold: float = 0.2
    draw_seed: int = 0
    split_seed: int = 0


def estimates_schema(keys: str) -> str:
    sums = ", ".join(f"{s}: double" for s in SUMS)
    return ", ".join([
        keys, "stratum string", *[f"{c} double" for c in ESTIMATES], *[f"{c} long" for c in COUNTS],
        f"sums array<struct<class: string, horizon: string, {sums}>>",
    ])


def estimated(tables: DataFrame, n_trials: int, n_bytes: int, job: Job) -> DataFrame:
    """One row per trial (drug_no, boot_id) and stratum. `tables` holds the packed tables `drugs`, `members`, `arm`, `swaps` and `stretches`."""
    cores = tables.sparkSession.sparkContext.defaultParallelism
    n_tasks = max(1, min(n_trials, cores * min(4, max(1, COPIES_BYTES // max(1, n_bytes * cores)))))
    copies = tables.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(n_tasks - 1))))
    return copies.repartitionById(n_tasks, "_task").mapInArrow(partial(_run, job=job, n_tasks=n_tasks), estimates_schema("drug_no long, boot_id int"))


def _run(batches: Iterator[pa.RecordBatch], job: Job, n_tasks: int) -> Iterator[pa.RecordBatch]:
    parts, task = defaultdict(list), None
    for batch in batches:
        for kind, payload, task in zip(*(batch.column(c) for c in ("kind", "payload", "_task")), strict=True):
            parts[kind.as_py()].append(pa.ipc.open_stream(payload.as_buffer()).read_all())
    if task is None:
        return
    task = task.as_py()
    pool = Pool({kind: pa.concat_tables(tables) for kind, tables in parts.items()}, job)
    parts.clear()
    for at in range(len(pool.drugs)):
        boots = [b for b in range(job.n_boot) if (at * job.n_boot + b) % n_tasks == task]
        if boots:
            drug = pool.drug(at)
            for boot in boots:
                yield from pool.estimate(drug, boot)


def _numbers(table: pa.Table, name: str, kind: type | None = None) -> np.ndarray:
    values = table.column(name).to_numpy()
    return values if kind is None else values.astype(kind, copy=False)


@dataclass
class _Drug:
    number: int
    text: bytes
    n_treated: int
    n_control: int
    arm_members: np.ndarray
    arm_days: np.ndarray
    delays: np.ndarray  # from therapy to index, by place in the arm
    swap: np.ndarray  # by drawn number, -1 where it stands for itself
    own: np.ndarray  # by member, whether treated
    ids: np.ndarray  # treated rows, then slots
    order: np.ndarray  # that settles equal scores


class Pool:
    """The unpacked tables of a task."""

    def __init__(self, tables: dict[str, pa.Table], job: Job):
        self.job = job
        self.drugs, self.arms, self.swaps = (tables.get(k) for k in ("drugs", "arm", "swaps"))
        members = tables["members"]
        order = np.argsort(_numbers(members, "member"))
        self.therapy_day, self.flag = _numbers(members, "therapy_day", np.int64)[order], _numbers(members, "d_flag", float)[order] == 1
        self.end = _numbers(members, "end_day", float)[order]
        rows = tables["stretches"]
        member, day = _numbers(rows, "member", np.int64), _numbers(rows, "start_day", np.int64)
        order = np.lexsort((day, member))
        member, day = member[order], day[order]
        self.columns = [_numbers(rows, f"x{i}")[order] for i in range(len(job.covariates))]
        self.gaps = [bool(np.isnan(c).any()) for c in self.columns]
        self.strata = _numbers(rows, "strata", np.int64)[order]
        self.flags, self.after = ([_numbers(rows, f"{what}{i}", float)[order] for i in range(len(job.classes))] for what in ("flag", "days"))
        # a stretch has one row, or several where covariates repeat a key
        new = np.ones(len(member), bool)
        new[1:] = (member[1:] != member[:-1]) | (day[1:] != day[:-1])
        self.row = np.flatnonzero(new)
        self.copies = np.diff(np.append(self.row, len(member)))
        self.repeated = bool(len(self.copies)) and int(self.copies.max()) > 1
        self.start = day[self.row]
        self.first = np.searchsorted(member[self.row], np.arange(len(self.therapy_day) + 1))

    def drug(self, at: int) -> _Drug:
        number, text, n_treated, n_control = (self.drugs.column(c)[at].as_py() for c in ("drug_no", "text", "n_treated", "n_control"))
        here = np.flatnonzero(_numbers(self.arms, "drug_no") == number)
        here = here[np.argsort(_numbers(self.arms, "t_pos")[here])]
        members, days, delays, ids = (_numbers(self.arms, c, np.int64)[here] for c in ("member", "index_day", "delta_days", "id"))
        swap = np.full(max(0, n_control), -1)
        if self.swaps is not None:
            of = _numbers(self.swaps, "drug_no") == number
            swap[_numbers(self.swaps, "control")[of]] = _numbers(self.swaps, "swap")[of]
        own = np.zeros(len(self.therapy_day), bool)
        own[members] = True
        slots = np.arange(n_treated * self.job.ratio if n_control > 0 else 0)
        ties = np.concatenate((hash32_many(b"-", -ids), hash32_many(slots)))
        ids = np.concatenate((ids, slots))
        return _Drug(number, text.encode(), n_treated, n_control, members, days, delays, swap, own, ids, np.lexsort((ids, ties)))

    def rows(self, drug: _Drug, boot: int) -> tuple[TrialRows, np.ndarray, np.ndarray]:
        """The rows of a trial, their places in the table of stretches, and the days since the start of their stretch."""
        job, n_treated = self.job, len(drug.arm_members)
        slots, number = np.arange(len(drug.ids) - n_treated), str(boot).encode()
        control, offset = (drawn_positions(what, job.draw_seed, drug.text, number, slots) for what in ("control", "offset"))
        if len(slots):
            control, offset = control % drug.n_control, offset % drug.n_treated
        swapped = drug.swap[control]
        drawn = np.where(swapped < 0, control, swapped)
        member = np.concatenate((drug.arm_members, drawn))
        day = np.concatenate((drug.arm_days, self.therapy_day[drawn] + drug.delays[offset]))
        kept = drug.order
        if drug.own[drawn].any():  # draws that are treated patients of the drug
            kept = kept[np.concatenate((np.ones(n_treated, bool), ~drug.own[drawn]))[kept]]
        member, day, treated, ids = member[kept], day[kept], kept < n_treated, drug.ids[kept]
        at, last = self.first[member], self.first[member + 1] - 1
        open_rows = np.flatnonzero(at < last)
        while len(open_rows):
            open_rows = open_rows[self.start[at[open_rows] + 1] <= day[open_rows]]
            at[open_rows] += 1
            open_rows = open_rows[at[open_rows] < last[open_rows]]
        since, row = day - self.start[at], self.row[at]
        if self.repeated:
            times = self.copies[at]
            row = np.repeat(row, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            member, day, treated, ids, since = (np.repeat(v, times) for v in (member, day, treated, ids, since))

        def fill(j: int, here: np.ndarray, out: np.ndarray) -> bool:
            column, places = self.columns[j], row if len(here) == len(row) else row[here]
            if column.dtype == out.dtype:
                np.take(column, places, out=out, mode="clip")
            else:
                out[:] = column[places]
            return self.gaps[j]

        def train(k: int, here: np.ndarray) -> np.ndarray:
            label = b"|".join([str(job.split_seed).encode(), drug.text, number, *([job.strata[k].encode()] if job.labelled else []), b""])
            own, out = treated[here], np.empty(len(here), np.int64)
            out[own], out[~own] = hash32_many(label + b"-", -ids[here[own]]), hash32_many(label, ids[here[~own]])
            return out % 100 < 70

        rows = TrialRows(ids, treated, self.end[member] - day, self.flag[member], self.strata[row], len(self.columns), fill, train, self.repeated)
        return rows, row, since

    def estimate(self, drug: _Drug, boot: int) -> Iterator[pa.RecordBatch]:
        job = self.job
        rows, row, since = self.rows(drug, boot)
        found = estimates_in(rows, len(job.strata), job.threshold)
        if not found:
            return
        schema = pa.schema([("drug_no", pa.int64()), ("boot_id", pa.int32()), ("stratum", pa.string()), *[(c, pa.float64()) for c in ESTIMATES], *[(c, pa.int64()) for c in COUNTS], (
            "sums", pa.list_(pa.struct([("class", pa.string()), ("horizon", pa.string()), *[(s, pa.float64()) for s in SUMS]]))
        )])
        values = [
            {"drug_no": drug.number, "boot_id": boot, "stratum": job.strata[f["stratum"]], **{c: f[c] for c in (*ESTIMATES, *COUNTS)}, "sums": self._sums(rows, row, since, f["matched"])}
            for f in found
        ]
        yield from pa.Table.from_pylist(values, schema).to_batches()

    def _sums(self, rows: TrialRows, row: np.ndarray, since: np.ndarray, matched: np.ndarray) -> list[dict]:
        """Events and days at risk of the matched rows by arm, for every class and horizon."""
        if not len(matched) or not self.job.classes:
            return []
        if rows.repeated:  # rows of an id meet all its matches
            known, times = np.unique(rows.ids[matched], return_counts=True)
            place = np.minimum(np.searchsorted(known, rows.ids), len(known) - 1)
            matched = np.repeat(np.arange(len(rows.ids)), np.where(known[place] == rows.ids, times[place], 0))
        at, gone, arm, out = row[matched], since[matched], rows.treated[matched], []
        for i, c in enumerate(self.job.classes):
            hit, days = self.flags[i][at] == 1, self.after[i][at] - gone
            for name, horizon in self.job.horizons:
                out.append({"class": c, "horizon": name, **dict(zip(SUMS, event_sums(arm, hit, days, horizon), strict=True))})
        return out
