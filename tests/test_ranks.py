import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trialkit.operators import ranks
from trialkit.operators.ranks import dense_positions, exact_percentiles, keep_first, ordered_chunks, running
from trialkit.functions.hashing import hash32


def frame(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    value = np.where(rng.random(n) < 0.4, 7.0, np.round(rng.normal(7, 3, n), 1))  # 40% of the rows on one value
    group = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"g": group, "id": np.arange(n), "v": value})
    return pdf, spark.createDataFrame(pdf)


def test_percentiles_match_linear_interpolation(spark):
    pdf, df = frame(spark)
    got = exact_percentiles(df, ["g"], "v", [0.01, 0.5, 0.9, 1.0], ["p1", "p50", "p90", "top"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g, ["p1", "p50", "p90", "top"]].to_numpy(float), np.quantile(part["v"], [0.01, 0.5, 0.9, 1.0]))


def test_percentiles_do_not_depend_on_the_bins(spark, monkeypatch):
    pdf, df = frame(spark)
    for bins in (2, 5000):
        monkeypatch.setattr(ranks, "BINS", bins)
        got = exact_percentiles(df, ["g"], "id", [0.33, 0.5], ["a", "b"]).toPandas().set_index("g")
        for g, part in pdf.groupby("g"):
            assert np.allclose(got.loc[g].to_numpy(float), np.quantile(part["id"], [0.33, 0.5]))


def test_percentiles_of_extreme_values(spark):
    values = [float("-inf"), -1.7e308, -1.0, -1e-308, 0.0, 5e-324, 1e-300, 2.0, 1.7e308, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [i / 10 for i in range(11)]
    got = exact_percentiles(df, [], "v", probs, [f"p{i}" for i in range(11)]).first()
    assert list(got) == sorted(values)


def test_percentiles_skip_nulls_and_work_without_keys(spark):
    df = spark.sql("select cast(v as double) v from values (1), (null), (4), (2) t(v)")
    assert exact_percentiles(df, [], "v", [0.5], ["m"]).first()["m"] == 2.0


def test_dense_positions_number_each_group(spark):
    pdf, df = frame(spark)
    got, fine = dense_positions(df, ["g"], "id").toPandas(), dense_positions(df, ["g"], "id", bucket_rows=7).toPandas()
    assert got.set_index("id")["pos"].sort_index().equals(fine.set_index("id")["pos"].sort_index())
    for g, part in got.groupby("g"):
        assert sorted(part["pos"]) == list(range(len(part)))


def test_running_totals_across_chunks(spark):
    pdf, df = frame(spark)
    rows = df.withColumn("tie", hash32("id")).withColumn("arm", (F.col("id") % 2).cast("int"))
    chunked = ordered_chunks(rows, ["g"], "v", F.col("arm"), F.col("tie"), chunks=8)
    order = [F.col(c) for c in ("v", "arm", "tie", "id")]
    out = running(chunked, ["g"], order, sums={"s": F.col("id")}, maxes={"m": F.col("id")})
    got = out.toPandas().sort_values(["g", "v", "arm", "tie", "id"])
    assert (got.groupby("g")["id"].cumsum() == got["s"]).all()
    assert (got.groupby("g")["id"].cummax() == got["m"]).all()
    # the hot value of the hot group does not sit in one chunk
    assert got[(got["g"] == "hot") & (got["v"] == 7.0)]["_chunk"].nunique() > 10
    back = running(chunked, ["g"], [c.desc() for c in order], sums={"s": F.col("id")}, backward=True)
    got = back.toPandas().sort_values(["g", "v", "arm", "tie", "id"], ascending=False)
    assert (got.groupby("g")["id"].cumsum() == got["s"]).all()


def test_keep_first_takes_the_smallest(spark):
    df = spark.sql("select * from values ('a', 2, 'x'), ('a', 1, 'y'), ('b', null, 'z') t(k, o, w)")
    assert {tuple(r) for r in keep_first(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", None, "z")}
