from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from trialkit import session
from trialkit.functions.hashing import hash32, hash32_many
from trialkit.operators import joins
from trialkit.plans import cohort as ch
from trialkit.plans import outcomes

D0 = date(2020, 1, 1)


def test_hashes_of_many_keys_equal_those_of_columns(spark):
    texts = ["LARGE", "é", "", "x" * 130, "a\0"]
    rng = np.random.default_rng(1)
    small, big = rng.integers(0, 100, 300), rng.integers(0, 2**62, 300)
    small[:4], big[:8] = [0, 9, 10, 99], [0, 9, 10, 10**9, 10**10 - 1, 10**10, 2**32, 10**18]
    code = rng.integers(0, len(texts), 300)
    rows = spark.createDataFrame([(int(i), texts[c], int(a), int(b)) for i, (c, a, b) in enumerate(zip(code, small, big))], "i int, t string, a int, b long")
    want = [r["h"] for r in rows.select("i", hash32(F.lit("control"), F.lit(0), "t", "a", "b").alias("h")).orderBy("i").collect()]
    assert hash32_many(b"control|0|", ([t.encode() for t in texts], code), b"|", small, b"|", big).tolist() == want
    assert hash32_many(b"x", np.zeros(0, np.int64)).tolist() == []


def test_numbered_joins_equal_plain_ones(spark):
    table = spark.createDataFrame(
        [(i, i * 10, None if i % 5 == 0 else f"v{i}", D0 + timedelta(days=i % 9999)) for i in [0, 1, 2, 62, 63, 64, 65, 127, 128, 5000, 2**40, -1, -64, -65]] + [(None, 7, "none", D0)],
        "k long, n long, s string, d date",
    )
    rows = spark.createDataFrame([(k, j) for j, k in enumerate([0, 1, 3, 63, 64, 64, 66, 128, 129, 2**40, 2**40 + 64, -1, -2, -65, None])], "k long, j int")
    plain = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for how in ("left", "inner", "left_anti"):
        assert plain(joins.join_numbered(rows, table, ["k"], F.col("k"), how)) == plain(rows.join(table, "k", how)), how
    twice = table.unionByName(table.limit(3))
    assert plain(joins.join_numbered(rows, twice, ["k"], F.col("k"))) == plain(rows.join(twice, "k", "left"))
    assert plain(joins.join_numbered(rows, table.limit(0), ["k"], F.col("k"))) == plain(rows.join(table.limit(0), "k", "left"))


def test_draws_of_tables_beyond_the_bound_by_rows_are_not_shuffled(spark, monkeypatch):
    """At 48 to 96 bytes a row the members, offsets, swaps and outcomes pass the bound; in blocks they do not."""
    for module in (session, joins):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 60_000)
    therapy = spark.range(3000).select(F.col("id").alias("ptid"), F.lit(D0).alias("therapy_date"))
    treated = therapy.where("ptid % 2 = 0").select(
        F.lit("x").alias("drug"), "ptid", "therapy_date", F.date_add("therapy_date", (F.col("ptid") % 90).cast("int")).alias("index_date"), (F.col("ptid") % 90).cast("int").alias("delta_days")
    )
    outcome = therapy.select("ptid", F.lit(0).alias("d_flag"), F.lit(None).cast("date").alias("available_date"), F.date_add("therapy_date", 300).alias("last_act_dt"))
    trials = outcomes.assemble_trials(treated, ch.control_draws(treated, therapy, n_boot=3), outcome, 3)
    plan = trials._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "md5" not in plan
    counts = {(r["boot_id"], r["treatment"]): r["count"] for r in trials.groupBy("boot_id", "treatment").count().collect()}
    assert counts == {(b, t): 1500 if t else 7500 for b in range(3) for t in (0, 1)}
    assert trials.where("treatment = 0 and ptid % 2 = 0").isEmpty()


def test_draws_of_treated_patients_are_dropped_only_for_their_drug(spark):
    treated = spark.createDataFrame([("x", 1, D0), ("y", 2, D0)], "drug string, ptid long, index_date date")
    draws = spark.createDataFrame([(d, 0, j, p, D0) for j, (d, p) in enumerate([("x", 1), ("x", 2), ("y", 1), ("y", 2), ("z", 1), ("x", -63), ("y", -63), ("x", 65), ("x", 9999), (None, 1)])],
                                  "drug string, boot_id int, rep long, ptid long, index_date date")
    outcome = spark.createDataFrame([(1, 0, None, D0)], "ptid long, d_flag int, available_date date, last_act_dt date")
    want = {("x", 2), ("y", 1), ("z", 1), ("x", -63), ("y", -63), ("x", 65), ("x", 9999), (None, 1)}
    for kind in ("long", "string"):
        cast = lambda df, kind=kind: df.withColumn("ptid", F.col("ptid").cast(kind))
        got = outcomes.assemble_trials(cast(treated), cast(draws), cast(outcome), 1).where("treatment = 0").collect()
        assert {(r["drug"], int(r["ptid"])) for r in got} == want and len(got) == len(want)
