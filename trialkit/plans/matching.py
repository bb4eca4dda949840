"""Matching treated to control rows on one score, many trials at once.

Nearest-neighbour matching without replacement is done closest pair first, which does not depend on row
order. Only neighbours in score order can be the closest pair, so no table of distances is built:

* Sort a trial by score. It falls into runs of treated and runs of controls.
* At the border of two runs, the k-th row to the left can only be paired with the k-th row to the right.
* A border pair is taken when neither member has a closer row across its other border. All pairs taken in
  one round are exactly those that taking one closest pair at a time would take.
* Taken rows leave, runs merge, and rounds go on until none adds a pair.

Equal distances are settled by a fixed mixing of the border number. Trials up to `task_rows` rows are
finished inside one task; larger ones go through the same rounds as DataFrame steps. Both give the same pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from trialkit.functions.hashing import hash32
from trialkit.operators.ranks import ordered_chunks, running
from trialkit.session import cut
from trialkit.sources.tables import reuse

TASK_ROWS = 200_000
_MIX, _MOD = 2654435761, 4294967296


def _rank_cols(df: DataFrame) -> DataFrame:
    return df.withColumn("_arm", 1 - F.col("treatment")).withColumn("_tie", hash32("id"))


# ---- inside one task -------------------------------------------------------------------------------


def _round_pairs(score: np.ndarray, treated: np.ndarray, caliper: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (left, right) of the pairs one round takes; the input is sorted."""
    n = len(score)
    change = np.flatnonzero(treated[1:] != treated[:-1]) + 1
    start = np.concatenate(([0], change))
    end = np.concatenate((change, [n])) - 1
    if len(start) < 2:
        return np.empty(0, int), np.empty(0, int)
    run = np.repeat(np.arange(len(start)), end - start + 1)
    before = np.concatenate(([-np.inf], score[end[:-1]]))
    after = np.concatenate((score[start[1:]], [np.inf]))
    # k-th row left of border b (between run b-1 and b) against k-th row right of it
    left = np.arange(n)[run < len(start) - 1]
    border = run[left] + 1
    right = start[border] + (end[run[left]] - left)
    fits = right <= end[border]
    left, right, border = left[fits], right[fits], border[fits]
    d = score[right] - score[left]
    other_l = score[left] - before[run[left]]
    other_r = after[run[right]] - score[right]
    mix = lambda b: (b * _MIX) % _MOD
    mine = mix(border)
    ok_l = (d < other_l) | ((d == other_l) & (mine < mix(border - 1)))
    ok_r = (d < other_r) | ((d == other_r) & (mine < mix(border + 1)))
    ok = ok_l & ok_r & (d <= caliper)
    return left[ok], right[ok]


def match_sorted(ids, score, treated, caliper, ratio):
    """Pairs (treated id, control id, distance, pass) of one trial, rows already in order."""
    free = np.ones(len(ids), bool)
    open_treated = treated.copy()
    out = []
    for turn in range(1, ratio + 1):
        active = np.flatnonzero(free & (~treated | open_treated))
        got = np.zeros(len(ids), bool)
        while True:
            left, right = _round_pairs(score[active], treated[active], caliper)
            if not len(left):
                break
            a, b = active[left], active[right]
            t, c = np.where(treated[a], a, b), np.where(treated[a], b, a)
            out.append(pd.DataFrame({"t_id": ids[t], "c_id": ids[c], "distance": np.abs(score[a] - score[b]), "turn": turn}))
            free[c] = False
            got[t] = True
            keep = np.ones(len(active), bool)
            keep[left] = keep[right] = False
            active = active[keep]
        open_treated &= got
        if not open_treated.any():
            break
    return out


def _match_in_tasks(rows: DataFrame, keys: list[str], ratio: int) -> DataFrame:
    schema = StructType(
        [rows.schema[k] for k in keys]
        + [
            StructField("t_id", LongType()),
            StructField("c_id", LongType()),
            StructField("distance", DoubleType()),
            StructField("turn", IntegerType()),
        ]
    )
    names = [f.name for f in schema]

    def per_trial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "_arm", "_tie", "id"], kind="stable")
        caliper = pdf["caliper"].iloc[0]
        found = match_sorted(
            pdf["id"].to_numpy(), pdf["score"].to_numpy(), pdf["treatment"].to_numpy() == 1,
            np.inf if pd.isna(caliper) else caliper, ratio,
        )
        out = pd.concat(found) if found else pd.DataFrame({"t_id": [], "c_id": [], "distance": [], "turn": []})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[names]

    return rows.groupBy(*keys).applyInPandas(per_trial, schema)


# ---- as DataFrame rounds ---------------------------------------------------------------------------


def _order() -> list[Column]:
    return [F.col("score"), F.col("_arm"), F.col("_tie"), F.col("id")]


def _round_as_frames(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs one round takes, for trials of any size."""
    local = Window.partitionBy(*keys, "_chunk").orderBy(*_order())
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_prev", F.lag("treatment").over(local)).withColumn(
        "_step", F.coalesce((F.col("_prev") != F.col("treatment")).cast("long"), F.lit(0))
    )
    inside = marked.select(
        "*", F.row_number().over(local).alias("_i"), F.sum("_step").over(upto).alias("_r")
    )
    ends = inside.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_step").alias("_steps"),
        F.min_by("treatment", "_i").alias("_first"),
        F.max_by("treatment", "_i").alias("_last"),
    )
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    joint = F.coalesce((F.lag("_last").over(by_chunk) != F.col("_first")).cast("long"), F.lit(0))
    carry = (
        ends.withColumn("_joint", joint)
        .withColumn("_n0", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_r0", F.coalesce(F.sum("_steps").over(earlier), F.lit(0)) + F.sum("_joint").over(by_chunk))
        .select(*keys, "_chunk", "_n0", "_r0")
    )
    placed = cut(
        inside.join(carry, [*keys, "_chunk"]).select(
            *keys, "id", "treatment", "score", "caliper",
            (F.col("_n0") + F.col("_i")).alias("_at"), (F.col("_r0") + F.col("_r")).alias("_run"),
        )
    )
    runs = cut(
        placed.groupBy(*keys, "_run").agg(
            F.min("_at").alias("_start"), F.max("_at").alias("_end"), F.min("score").alias("_low"), F.max("score").alias("_high")
        )
    )
    before = runs.select(*keys, (F.col("_run") + 1).alias("_run"), F.col("_high").alias("_before"))
    after = runs.select(*keys, (F.col("_run") - 1).alias("_run"), F.col("_low").alias("_after"))
    spans = runs.join(before, [*keys, "_run"], "left").join(after, [*keys, "_run"], "left")
    edged = placed.join(spans, [*keys, "_run"])
    left = edged.select(
        *keys, (F.col("_run") + 1).alias("_border"), (F.col("_end") - F.col("_at")).alias("_k"),
        F.col("id").alias("l_id"), F.col("treatment").alias("l_treated"), F.col("score").alias("l_score"),
        (F.col("score") - F.col("_before")).alias("l_other"), "caliper",
    )
    right = edged.select(
        *keys, F.col("_run").alias("_border"), (F.col("_at") - F.col("_start")).alias("_k"),
        F.col("id").alias("r_id"), F.col("score").alias("r_score"), (F.col("_after") - F.col("score")).alias("r_other"),
    )

    def mixed(b: Column) -> Column:
        return (b * F.lit(_MIX)) % F.lit(_MOD)

    d, mine = F.col("r_score") - F.col("l_score"), mixed(F.col("_border"))

    def prefers(other: str, step: int) -> Column:
        o = F.col(other)
        tie = (d == o) & (mine < mixed(F.col("_border") + step))
        return o.isNull() | (d < o) | tie

    near = F.col("caliper").isNull() | (d <= F.col("caliper"))
    return (
        left.join(right, [*keys, "_border", "_k"])
        .where(prefers("l_other", -1) & prefers("r_other", 1) & near)
        .select(
            *keys,
            F.when(F.col("l_treated") == 1, F.col("l_id")).otherwise(F.col("r_id")).alias("t_id"),
            F.when(F.col("l_treated") == 1, F.col("r_id")).otherwise(F.col("l_id")).alias("c_id"),
            d.alias("distance"),
        )
    )


def _match_by_rounds(rows: DataFrame, keys: list[str], ratio: int, task_rows: int) -> DataFrame:
    """Rounds over whole trials; each round is cut so that a lost executor costs one round at most.

    When the rows still free in every trial fit a task, the rest of the turn is finished in tasks: the
    next rounds there are the same rounds.
    """
    rows = cut(ordered_chunks(rows, keys, "score", F.col("_arm"), F.col("_tie")))
    pairs = None
    open_rows = rows
    for turn in range(1, ratio + 1):
        active, this_turn = open_rows, None
        while True:
            most = active.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
            fits = most <= task_rows
            step = _match_in_tasks(active, keys, 1).drop("turn") if fits else _round_as_frames(active, keys)
            found = cut(step.withColumn("turn", F.lit(turn)))
            if found.isEmpty():
                break
            this_turn = found if this_turn is None else this_turn.unionByName(found)
            gone = found.select(*keys, F.explode(F.array("t_id", "c_id")).alias("id"))
            if fits:
                break
            active = cut(active.join(gone, [*keys, "id"], "left_anti"))
        if this_turn is None:
            break
        pairs = this_turn if pairs is None else pairs.unionByName(this_turn)
        matched = this_turn.select(*keys, F.col("t_id").alias("id"))
        used = pairs.select(*keys, F.col("c_id").alias("id"))
        open_rows = cut(
            rows.where("treatment = 1").join(matched, [*keys, "id"], "left_semi")
            .unionByName(rows.where("treatment = 0").join(used, [*keys, "id"], "left_anti"))
        )
    if pairs is None:
        pairs = _round_as_frames(rows.limit(0), keys).withColumn("turn", F.lit(0))
    return pairs


def match_nearest(
    rows: DataFrame, keys: Sequence[str], caliper: Column | None = None, ratio: int = 1, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Pairs (keys, t_id, c_id, distance, turn), closest pair first, every control used at most once.

    `rows` has the trial keys, a long `id` unique in its trial, `treatment` 0/1 and `score`. With `ratio`
    N, N turns are made; in each turn every treated row may take one more control, and a treated row that
    finds none within the caliper drops out. Without a caliper and with enough controls, nobody is left.
    """
    keys = list(keys)
    cap = F.lit(None).cast("double") if caliper is None else caliper.cast("double")
    base = rows.select(
        *keys, F.col("id").cast("long").alias("id"), F.col("treatment").cast("int").alias("treatment"),
        F.col("score").cast("double").alias("score"), cap.alias("caliper"),
    ).where(F.col("score").isNotNull() & ~F.isnan("score"))
    base = reuse(_rank_cols(base))
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = reuse(sizes.where(F.col("_rows") > task_rows).select(*keys))
    if large.isEmpty():
        pairs = _match_in_tasks(base, keys, ratio)
    else:
        small_pairs = _match_in_tasks(base.join(large, keys, "left_anti"), keys, ratio)
        large_pairs = _match_by_rounds(base.join(large, keys, "left_semi"), keys, ratio, task_rows)
        pairs = small_pairs.unionByName(large_pairs)
    pairs = cut(pairs)
    base.unpersist()
    large.unpersist()
    return pairs


def matched_rows(rows: DataFrame, pairs: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """The rows of matched treated and controls, with all their columns."""
    keys = list(keys)
    ids = pairs.select(*keys, F.col("t_id").alias(id_col)).unionByName(pairs.select(*keys, F.col("c_id").alias(id_col)))
    return rows.join(ids.distinct(), [*keys, id_col], "left_semi")


# ---- neighbours with replacement, distances --------------------------------------------------------


def nearest_controls(rows: DataFrame, keys: Sequence[str], k: int = 1) -> DataFrame:
    """The k nearest controls of every treated row (keys, t_id, c_id, distance, nth), with replacement.

    Controls are numbered in score order once ascending and once descending in the tie order; a treated
    row looks up k numbers on either side. Equal distances go by hashed id, then id.
    """
    keys = list(keys)
    base = _rank_cols(
        rows.select(*keys, F.col("id").cast("long").alias("id"), F.col("treatment").cast("int").alias("treatment"),
                    F.col("score").cast("double").alias("score"))
    )
    # controls first at equal scores, so a treated row counts every control at or below its own score
    base = ordered_chunks(base, keys, "score", F.col("treatment"), F.col("_tie"))
    is_control = (F.col("treatment") == 0).cast("long")
    up = [F.col("score"), F.col("treatment"), F.col("_tie"), F.col("id")]
    numbered = running(base, keys, up, sums={"_upto": is_control})
    controls = numbered.where("treatment = 0")
    # position among equal scores reversed: the smallest hashed id is nearest from above as well
    same = controls.groupBy(*keys, "score").agg(F.min("_upto").alias("_lo"), F.max("_upto").alias("_hi"))
    flipped = controls.join(same, [*keys, "score"]).select(
        *keys, F.col("id").alias("c_id"), F.col("score").alias("c_score"), F.col("_tie").alias("c_tie"),
        F.col("_upto").alias("_above"), (F.col("_lo") + F.col("_hi") - F.col("_upto")).alias("_below"),
    )
    steps = F.explode(F.sequence(F.lit(1), F.lit(k)))
    treated = numbered.where("treatment = 1").select(*keys, F.col("id").alias("t_id"), F.col("score").alias("t_score"), "_upto", steps.alias("_s"))
    above = treated.withColumn("_above", F.col("_upto") + F.col("_s")).join(flipped.drop("_below"), [*keys, "_above"])
    below = treated.withColumn("_below", F.col("_upto") - F.col("_s") + 1).join(flipped.drop("_above"), [*keys, "_below"])
    cols = [*keys, "t_id", "c_id", F.abs(F.col("t_score") - F.col("c_score")).alias("distance"), "c_tie"]
    both = above.select(*cols).unionByName(below.select(*cols))
    near = F.array_sort(F.collect_list(F.struct("distance", "c_tie", "c_id")))  # 2k entries at most
    best = both.groupBy(*keys, "t_id").agg(F.slice(near, 1, k).alias("_near"))
    return best.select(*keys, "t_id", F.posexplode("_near").alias("_i", "_p")).select(
        *keys, "t_id", F.col("_p.c_id").alias("c_id"), F.col("_p.distance").alias("distance"), (F.col("_i") + 1).alias("nth")
    )


def distance_profile(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distances of every treated row to all controls of its trial: count, nearest, mean, farthest.

    Running counts and sums over the score order give these without forming the pairs.
    """
    keys = list(keys)
    base = _rank_cols(
        rows.select(*keys, F.col("id").cast("long").alias("id"), F.col("treatment").cast("int").alias("treatment"),
                    F.col("score").cast("double").alias("score"))
    )
    base = ordered_chunks(base, keys, "score", F.col("treatment"), F.col("_tie"))
    control = F.col("treatment") == 0
    up = [F.col("score"), F.col("treatment"), F.col("_tie"), F.col("id")]
    forward = running(
        base, keys, up,
        sums={"_n": control.cast("long"), "_s": F.when(control, F.col("score")).otherwise(F.lit(0.0))},
        maxes={"_prev": F.when(control, F.col("score"))},
    )
    both = running(
        forward, keys, [c.desc() for c in up], maxes={"_next": F.when(control, -F.col("score"))}, backward=True
    )
    totals = base.where(control).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_controls"), F.sum("score").alias("_all"), F.min("score").alias("_min"), F.max("score").alias("_max")
    )
    t = F.col("score")
    total = t * F.col("_n") - F.col("_s") + (F.col("_all") - F.col("_s")) - t * (F.col("n_controls") - F.col("_n"))
    return both.where("treatment = 1").join(totals, keys).select(
        *keys,
        F.col("id").alias("t_id"),
        "n_controls",
        F.least(t - F.col("_prev"), -F.col("_next") - t).alias("nearest"),
        (total / F.col("n_controls")).alias("mean_distance"),
        F.greatest(F.abs(t - F.col("_min")), F.abs(F.col("_max") - t)).alias("farthest"),
    )


def distance_mad(rows: DataFrame, keys: Sequence[str], resolution: float = 1e-6) -> DataFrame:
    """Median and MAD of all treated-control distances per trial, as the matching caliper.

    Scores are taken in steps of `resolution` (scores on that grid give the exact values). Rows collapse
    to counts per step, so a trial brings at most (score range / resolution) rows to its task however many
    patients it has; pairs are counted from cumulative counts, never listed.
    """
    keys = list(keys)
    step = F.round(F.col("score") / resolution).cast("long")
    levels = rows.groupBy(*keys, step.alias("_step")).agg(
        F.sum((F.col("treatment") == 1).cast("long")).alias("_t"), F.sum((F.col("treatment") == 0).cast("long")).alias("_c")
    )
    schema = StructType(
        [rows.schema[k] for k in keys]
        + [StructField("median_distance", DoubleType()), StructField("caliper", DoubleType())]
    )

    def per_trial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_step")
        c = pdf[pdf["_c"] > 0]
        t = pdf[pdf["_t"] > 0]
        c_at, t_at, t_n = c["_step"].to_numpy(), t["_step"].to_numpy(), t["_t"].to_numpy()
        cum = np.concatenate(([0], np.cumsum(c["_c"].to_numpy())))
        total = int(t_n.sum()) * int(cum[-1])
        head = [pdf[k].iloc[0] for k in keys]
        if total == 0:
            return pd.DataFrame([[*head, None, None]], columns=schema.names)

        def within(low: int, high: int) -> int:
            """Pairs with low <= distance <= high, all in steps."""
            if high < 0 or low > high:
                return 0

            def closer(d: int) -> int:
                if d < 0:
                    return 0
                hits = cum[np.searchsorted(c_at, t_at + d, "right")] - cum[np.searchsorted(c_at, t_at - d, "left")]
                return int((hits * t_n).sum())

            return closer(high) - closer(low - 1)

        width = int(max(c_at[-1], t_at[-1]) - min(c_at[0], t_at[0]))

        def nth(count, n: int, top: int) -> int:
            """Smallest d in [0, top] with count(d) > n."""
            lo, hi = 0, top
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if count(mid) > n else (mid + 1, hi)
            return lo

        ranks = ((total - 1) // 2, total // 2)
        twice_median = sum(nth(lambda d: within(0, d), r, width) for r in ranks)

        def near_median(e: int) -> int:
            # |2d - twice_median| <= e
            return within(max(-((e - twice_median) // 2), 0), (twice_median + e) // 2)

        twice_mad = sum(nth(near_median, r, 2 * width) for r in ranks) / 2
        return pd.DataFrame([[*head, twice_median / 2 * resolution, twice_mad / 2 * resolution]], columns=schema.names)

    return levels.groupBy(*keys).applyInPandas(per_trial, schema)
