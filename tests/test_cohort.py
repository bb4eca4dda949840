from datetime import date, timedelta

from pyspark.sql import functions as F

from trialkit.functions import dates, text
from trialkit.operators import joins, reshape
from trialkit.plans import cohort as ch
from trialkit.plans import features, outcomes

D0 = date(2020, 1, 1)


def day(n):
    return D0 + timedelta(days=n)


def test_window_halves_make_the_whole(spark):
    events = spark.createDataFrame([(1, day(i), i) for i in range(-40, 130)], "ptid int, rx_date date, n int")
    anchors = spark.createDataFrame([(1, D0)], "ptid int, dx date")
    after = joins.on_or_after(events, anchors, "ptid", "rx_date", "dx", 90)
    before = joins.strictly_before(events, anchors, "ptid", "rx_date", "dx", 14)
    both = joins.in_window(events, anchors, "ptid", "rx_date", "dx", 14, 90)
    assert sorted(r["n"] for r in after.unionByName(before).collect()) == sorted(r["n"] for r in both.collect()) == list(range(-14, 91))


def test_new_user_rules(spark):
    therapy = spark.createDataFrame([(i, D0) for i in range(1, 8)], "ptid int, therapy_date date")
    rows = [
        (1, day(0)), (1, day(10)),  # two days, no history: treated
        (2, day(5)), (2, day(5)),  # one distinct day
        (3, day(5)), (3, day(9)), (3, day(-85)),  # gap of exactly 90 days
        (4, day(5)), (4, day(9)), (4, day(-86)),  # gap of 91 days: treated
        (5, day(80)), (5, day(91)),  # second record past the window
        (6, day(-5)),  # history only
    ]
    records = spark.createDataFrame([(p, d, "x") for p, d in rows], "ptid int, rx_date date, drug string")
    users = {r["ptid"]: r["treated"] for r in ch.drug_users(therapy, records).collect()}
    assert users == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0}
    treated = ch.new_users(therapy, records)
    assert {r["ptid"] for r in ch.control_members(therapy, treated, "x").collect()} == {2, 3, 5, 6, 7}


def test_control_draws_cover_exactly_the_untreated(spark):
    therapy = spark.range(60).select(F.col("id").alias("ptid"), F.lit(D0).alias("therapy_date"))
    treated = therapy.where("ptid % 3 = 0").select(
        F.lit("x").alias("drug"), "ptid", "therapy_date", F.date_add("therapy_date", F.col("ptid").cast("int")).alias("index_date"), F.col("ptid").cast("int").alias("delta_days")
    ).unionByName(therapy.where("ptid < 45").select(
        F.lit("most").alias("drug"), "ptid", "therapy_date", F.col("therapy_date").alias("index_date"), F.lit(0).alias("delta_days")))
    draws = ch.control_draws(treated, therapy, n_boot=40).toPandas()
    x = draws[draws.drug == "x"]
    assert len(x) == 40 * 20 * 5 and (x.groupby("boot_id").size() == 100).all()
    assert set(x.ptid) == {i for i in range(60) if i % 3} and set(draws[draws.drug == "most"].ptid) == set(range(45, 60))
    counts = x.groupby("ptid").size()
    assert counts.max() < 2 * counts.min()  # every control is about equally likely
    assert set(x.delta_days) == set(range(0, 60, 3))
    again = ch.control_draws(treated.repartition(7), therapy.repartition(3), n_boot=40).toPandas()
    key = ["drug", "boot_id", "rep"]
    assert draws.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_death_rules_and_trial_rows(spark):
    patients = spark.createDataFrame(
        [(1, day(10), day(0), D0, D0), (2, day(10), day(39), D0, D0), (3, day(10), day(40), D0, D0), (4, None, day(5), D0, D0)],
        "ptid int, unvalidated_dod date, last_act_dt date, dx date, tx date",
    )
    events = spark.createDataFrame([(4, day(50)), (4, day(-3))], "ptid int, date date")
    out = outcomes.validated_death(outcomes.last_activity(patients, [events], ["dx", "tx"]))
    got = {r["ptid"]: (r["d_flag"], r["last_act_dt"]) for r in out.collect()}
    assert got == {1: (1, D0), 2: (1, day(39)), 3: (0, day(40)), 4: (0, day(50))}
    treated = spark.createDataFrame([("x", 1, day(20)), ("x", 2, D0)], "drug string, ptid int, index_date date")
    draws = spark.createDataFrame([("x", 0, 0, 4, D0), ("x", 0, 1, 4, D0), ("x", 0, 2, 2, D0)], "drug string, boot_id int, rep int, ptid int, index_date date")
    every = outcomes.assemble_trials(treated, draws, out, n_boot=1)
    assert every.count() == 4 and tuple(outcomes.dropped_follow_up(every).first())[2:] == (4, 1)
    rows = outcomes.assemble_trials(treated, draws, out, n_boot=1, min_days=0).collect()
    assert sorted((r["ptid"], r["treatment"], r["d_delta_days"]) for r in rows) == [(2, 1, 10), (4, 0, 50), (4, 0, 50)]



def test_lookback_ends_are_included(spark):
    h = spark.createDataFrame(
        [(1, "a", day(-365), 1.0, "1"), (1, "a", day(0), 3.0, "5d"), (1, "a", day(1), 100.0, "7"), (1, "a", day(-366), 50.0, "9")],
        "ptid int, name string, date date, value double, result string",
    )
    keys = spark.createDataFrame([(1, D0), (2, D0)], "ptid int, index_date date")
    mean = {r["ptid"]: r["v_a"] for r in features.window_mean(h, keys, ["a"], "v_").collect()}
    last = {r["ptid"]: r["l_a"] for r in features.window_last_number(h, keys, ["a"], "l_").collect()}
    flag = {r["ptid"]: r["m_b"] for r in features.window_any(h, keys, ["b"], "m_").collect()}
    sites = {r["ptid"]: (r["s_total"], r["s_a"]) for r in features.sites_before(h, keys, ["a"], "s_").collect()}
    assert mean == {1: 2.0, 2: None} and last == {1: 1.0, 2: None} and flag == {1: 0, 2: 0} and sites == {1: (1, 1), 2: (0, 0)}


def test_first_event_is_strictly_after_the_index(spark):
    keys = spark.createDataFrame([(1, D0)], "ptid int, index_date date")
    ev = spark.createDataFrame([(1, "a", D0), (1, "a", day(200)), (1, "b", day(3))], "ptid int, name string, date date")
    last = spark.createDataFrame([(1, day(250))], "ptid int, last_act_dt date")
    got = {r["class"]: (r["sae_flag"], r["sae_delta_days"]) for r in outcomes.first_event_after(keys, ev, ["a", "b", "c"], last).collect()}
    assert got == {"any": (1, 3), "a": (1, 200), "b": (1, 3), "c": (0, 250)}
    short = {r["class"]: (r["sae_flag"], r["sae_delta_days"]) for r in outcomes.first_event_after(keys, ev, ["a", "b", "c"], last, 180).collect()}
    assert short == {"any": (1, 3), "a": (0, 180), "b": (1, 3), "c": (0, 180)}


def test_null_codes_never_match(spark):
    records = spark.createDataFrame([(1, "n1"), (2, None)], "ptid int, ndc string")
    codes = spark.createDataFrame([("n1",), (None,)], "ndc string")
    assert [r["ptid"] for r in joins.with_codes(records, codes, "ndc").collect()] == [1]


def test_number_text(spark):
    cases = {"5": 5.0, " 1.5e2 ": 150.0, "-.5": -0.5, "5d": None, "nan": None, "inf": None, "": None, "1 2": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.parse_number(F.col("t")).alias("v"))
    assert {r["t"]: r["v"] for r in df.collect()} == cases


def test_intervals_patterns_and_ages(spark):
    df = spark.createDataFrame([("[0.85 1.2]",), ("[0.85, 1.2]",), ("[ 0.85  1.2 ]",)], "t string")
    assert {tuple(r["b"]) for r in df.select(text.interval_bounds(F.col("t")).alias("b")).collect()} == {(0.85, 1.2)}
    terms = spark.createDataFrame([("a",), ("c",), ("b",), ("a",)], "t string")
    assert text.alternation_from_table(terms, "t", ["b"]).first()["pattern"] == "(a|b$|c)"
    ages = spark.sql("select date'2000-05-01' d, b from values ('1935 and Earlier'), ('1960'), ('unknown') t(b)").select(dates.age_at(F.col("d"), F.col("b")).alias("a"))
    assert [r["a"] for r in ages.collect()] == [65, 40, None]


def test_constant_and_empty_columns_are_dropped(spark):
    df = spark.sql("select * from values (1, 'x', cast(null as int), 5), (2, 'x', null, null) t(a, b, c, d)")
    assert reshape.drop_all_null(df).columns == ["a", "b", "d"]
    assert reshape.drop_constant(df, ["a", "b", "d"]).columns == ["a", "c", "d"]


def test_wide_level_lists_are_refused_and_have_a_long_form(spark):
    import pytest

    long = reshape.one_hot_long(spark.range(1001).withColumn("c", F.col("id")), ["id"], "c")
    assert long.select("level").distinct().count() == 1001 and long.agg(F.sum("flag")).first()[0] == 1001
    with pytest.raises(ValueError):
        reshape.distinct_levels(spark.range(50), "id", at_most=10)
