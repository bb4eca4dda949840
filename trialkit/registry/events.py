"""Baseline covariates, reshaping, cleaning and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialkit.operators import reshape
from trialkit.plans import features
from trialkit.registry import views as v
from trialkit.registry.base import query

_IN = "h.date BETWEEN i.index_date - 7 AND i.index_date"
_TYPES = v.EVENT_TYPES


def _keys(spark, d):
    return features.index_keys(v.index_rows(spark, d))


def _rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


_MEANS = ", ".join(f"round(avg(CASE WHEN h.name = '{e}' AND {_IN} THEN h.value END), 6) AS vital_{e}" for e in _TYPES)
_LASTS = ", ".join(
    f"max_by(h.num, epoch(h.date) * 1000 + h.num) FILTER (WHERE h.name = '{e}' AND {_IN} AND h.num IS NOT NULL) AS lab_{e}" for e in _TYPES
)
_FLAGS = ", ".join(f"CAST(coalesce(max(CASE WHEN h.name = '{e}' AND {_IN} THEN 1 END), 0) AS INTEGER) AS {{p}}_{e}" for e in _TYPES)
_SITES = ", ".join(f"CAST(coalesce(max(CASE WHEN h.name = '{e}' AND h.date <= i.index_date THEN 1 END), 0) AS INTEGER) AS meta_{e}" for e in _TYPES)
_TOTAL = "CAST(count(DISTINCT CASE WHEN h.date <= i.index_date THEN h.name END) AS INTEGER) AS meta_total"
_FROM = "FROM index_rows i LEFT JOIN (SELECT *, CASE WHEN regexp_full_match(result, '[0-9]+') THEN TRY_CAST(result AS DOUBLE) END AS num FROM history) h ON i.ptid = h.ptid GROUP BY 1, 2"
_VIEWS = ["index_rows", "history"]


@query("agg_window_mean", f"SELECT i.ptid, i.index_date, {_MEANS} {_FROM}", _VIEWS)
def agg_window_mean(spark, d):
    return _rounded(features.window_mean(v.history(spark, d), _keys(spark, d), _TYPES, "vital_", v.LOOKBACK_DAYS), [f"vital_{e}" for e in _TYPES])


@query("agg_window_last_numeric", f"SELECT i.ptid, i.index_date, {_LASTS} {_FROM}", _VIEWS)
def agg_window_last_numeric(spark, d):
    return features.window_last_number(v.history(spark, d), _keys(spark, d), _TYPES, "lab_", v.LOOKBACK_DAYS)


@query("agg_window_any_flag", f"SELECT i.ptid, i.index_date, {_FLAGS.format(p='med')} {_FROM}", _VIEWS)
def agg_window_any_flag(spark, d):
    return features.window_any(v.history(spark, d), _keys(spark, d), _TYPES, "med_", v.LOOKBACK_DAYS)


@query("agg_distinct_sites_before", f"SELECT i.ptid, i.index_date, {_TOTAL}, {_SITES} {_FROM}", _VIEWS)
def agg_distinct_sites_before(spark, d):
    return features.sites_before(v.history(spark, d), _keys(spark, d), _TYPES, "meta_")


@query("features_baseline", f"""
    SELECT b.*, CASE c.gender WHEN 'Male' THEN 1 WHEN 'Female' THEN 0 END AS gender, CASE WHEN c.race = 'Caucasian' THEN 1 ELSE 0 END AS race,
           year(b.index_date) - CASE WHEN c.birth_yr = '1935 and Earlier' THEN 1935 ELSE CAST(c.birth_yr AS INTEGER) END AS age_at_index
    FROM (SELECT i.ptid, i.index_date, {_TOTAL}, {_SITES}, {_MEANS}, {_LASTS}, {_FLAGS.format(p='med')}, {_FLAGS.format(p='com')} {_FROM}) b
    LEFT JOIN clinical c ON b.ptid = c.ptid""", [*_VIEWS, "clinical"])
def features_baseline(spark, d):
    h = v.history(spark, d)
    wide = features.baseline(
        _keys(spark, d), v.clinical(spark, d), h, h, h, h, h, sites=_TYPES, vitals=_TYPES, labs=_TYPES, drugs=_TYPES, diagnoses=_TYPES, days=v.LOOKBACK_DAYS
    )
    return _rounded(wide, [f"vital_{e}" for e in _TYPES])


# ---- shape -----------------------------------------------------------------------------------------


_STATUS = ["F", "O", "P"]


def _status_matrix(spark, d):
    o = v.table(spark, d, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice")
    means = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return reshape.matrix(means, ["o_orderpriority"], "o_orderstatus", _STATUS, F.col("mean"))


@query("reshape_melt", "SELECT o_orderpriority, o_orderstatus AS status, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1, 2")
def reshape_melt(spark, d):
    return reshape.melt(_status_matrix(spark, d), ["o_orderpriority"], _STATUS, "status", "mean")


@query("reshape_pivot", """
    SELECT p_type, max(CASE WHEN l_returnflag = 'A' THEN cell END) AS ret_A, max(CASE WHEN l_returnflag = 'N' THEN cell END) AS ret_N,
           max(CASE WHEN l_returnflag = 'R' THEN cell END) AS ret_R FROM (
        SELECT p_type, l_returnflag, CASE WHEN avg(l_quantity) > 25.5 THEN round(avg(l_quantity), 3) END AS cell
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1""")
def reshape_pivot(spark, d):
    lines = v.table(spark, d, "lineitem", "l_partkey", "l_returnflag", "l_quantity").join(
        v.table(spark, d, "part", "p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")
    )
    q = F.avg("l_quantity")
    cells = lines.groupBy("p_type", "l_returnflag").agg(F.when(q > 25.5, F.round(q, 3)).alias("cell"))
    return reshape.matrix(cells, ["p_type"], "l_returnflag", ["A", "N", "R"], F.col("cell"), "ret_")


@query("encode_one_hot", """
    SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS c_mktsegment_AUTOMOBILE, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS c_mktsegment_BUILDING,
           CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS c_mktsegment_FURNITURE, CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS c_mktsegment_HOUSEHOLD,
           CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS c_mktsegment_MACHINERY FROM customer""")
def encode_one_hot(spark, d):
    c = v.table(spark, d, "customer", "c_custkey", "c_mktsegment")
    return reshape.one_hot(c, "c_mktsegment", reshape.distinct_levels(c, "c_mktsegment"))


@query("encode_bool_int", "SELECT doc_id, CAST(quality = 1 AS INTEGER) AS good, CAST(toxic = 1 AS INTEGER) AS toxic FROM labels")
def encode_bool_int(spark, d):
    flags = v.table(spark, d, "labels", "doc_id", "quality", "toxic").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return flags.withColumns({c: F.col(c).cast("int") for c, t in flags.dtypes if t == "boolean"})


@query("infer_covariate_kind", """
    WITH x AS (SELECT CAST(o_totalprice AS VARCHAR) AS price_text, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS key_text FROM orders)
    SELECT 'price_text' AS covariate, CASE WHEN max(CAST(contains(price_text, '.') AS INTEGER)) = 1 THEN 'continuous' ELSE 'categorical' END AS kind FROM x
    UNION ALL SELECT 'status', CASE WHEN max(CAST(contains(status, '.') AS INTEGER)) = 1 THEN 'continuous' ELSE 'categorical' END FROM x
    UNION ALL SELECT 'key_text', CASE WHEN max(CAST(contains(key_text, '.') AS INTEGER)) = 1 THEN 'continuous' ELSE 'categorical' END FROM x
    UNION ALL SELECT 'o_totalprice', 'continuous'""")
def infer_covariate_kind(spark, d):
    o = v.table(spark, d, "orders", "o_totalprice", "o_orderstatus", "o_custkey").select(
        F.col("o_totalprice").cast("string").alias("price_text"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("key_text"), "o_totalprice"
    )
    return reshape.covariate_kinds(o, ["price_text", "status", "key_text", "o_totalprice"])


@query("clean_trim_outliers", """
    SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_extendedprice BETWEEN plo AND phi THEN l_extendedprice END AS l_extendedprice,
           CASE WHEN l_quantity BETWEEN qlo AND qhi THEN l_quantity END AS l_quantity
    FROM lineitem JOIN (SELECT l_returnflag AS f, quantile_cont(l_extendedprice, 0.01) AS plo, quantile_cont(l_extendedprice, 0.99) AS phi,
                        quantile_cont(l_quantity, 0.01) AS qlo, quantile_cont(l_quantity, 0.99) AS qhi FROM lineitem GROUP BY 1) ON l_returnflag = f""")
def clean_trim_outliers(spark, d):
    lines = v.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity")
    return reshape.trim_outliers(lines, ["l_returnflag"], ["l_extendedprice", "l_quantity"])


_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_TRIMMED = ", ".join(f"CASE WHEN x.{c} BETWEEN {c}_lo AND {c}_hi THEN x.{c} END AS {c}" for c in ("bal", "bal_text"))


@query("clean_covariate_table", f"""
    WITH x AS (SELECT CAST(c_nationkey % 5 AS INTEGER) AS trial, c_custkey AS id, CAST(c_custkey % 2 AS DOUBLE) AS treatment,
               CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS bal_text,
               CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_acctbal > 4500 AS INTEGER) END AS rich FROM customer),
    q AS (SELECT trial, {", ".join(f"quantile_cont({c}, {p}) AS {c}_{n}" for c in ("bal", "bal_text") for p, n in ((0.01, "lo"), (0.99, "hi")))}, avg(rich) AS rich_mean FROM x GROUP BY 1),
    y AS (SELECT x.trial, id, treatment, segment, {_TRIMMED}, coalesce(rich, rich_mean) AS rich FROM x JOIN q ON x.trial = q.trial),
    m AS (SELECT trial, avg(bal) AS bal_mean, avg(bal_text) AS text_mean FROM y GROUP BY 1),
    c AS (SELECT trial, segment AS mode FROM (SELECT trial, segment, row_number() OVER (PARTITION BY trial ORDER BY count(*) DESC, segment) AS rn
          FROM x WHERE segment IS NOT NULL GROUP BY 1, 2) WHERE rn = 1)
    SELECT y.trial, id, treatment, round(coalesce(bal, bal_mean), 6) AS bal, round(coalesce(bal_text, text_mean), 6) AS bal_text, round(rich, 6) AS rich,
           {", ".join(f"CAST(coalesce(segment, mode) = '{lv}' AS INTEGER) AS segment_{lv}" for lv in _LEVELS)}
    FROM y JOIN m ON y.trial = m.trial JOIN c ON y.trial = c.trial""")
def clean_covariate_table(spark, d):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    rows = v.table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment").select(
        (F.col("c_nationkey") % 5).cast("int").alias("trial"), k.alias("id"), (k % 2).alias("treatment"), F.when(k % 11 != 0, bal).alias("bal"),
        F.when(k % 13 != 0, bal.cast("string")).alias("bal_text"), F.when(k % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 5 != 0, bal > 4500).alias("rich"),
    )
    cleaned = reshape.clean_covariates(rows, ["trial"], ["id"], ["bal", "bal_text", "segment", "rich"], numbers=["treatment"])
    return _rounded(cleaned.rows, cleaned.continuous)


_HOLES = "SELECT event_id, name, CASE WHEN event_id % 11 <> 0 THEN value END AS value, CASE WHEN event_id % 7 <> 0 THEN result END AS result FROM history"


def _holes(spark, d):
    h = v.history(spark, d)
    return h.select(
        "event_id", "name", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 7 != 0, F.col("result")).alias("result")
    )


@query("impute_mean_mode", f"""
    WITH x AS ({_HOLES}), m AS (SELECT name, avg(value) AS mean FROM x GROUP BY 1),
         c AS (SELECT name, result, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, result) AS rn FROM x WHERE result IS NOT NULL GROUP BY 1, 2)
    SELECT x.event_id, x.name, round(coalesce(x.value, m.mean), 6) AS value, coalesce(x.result, c.result) AS result
    FROM x JOIN m ON x.name = m.name JOIN c ON x.name = c.name AND c.rn = 1""", ["history"])
def impute_mean_mode(spark, d):
    filled = reshape.impute_mode(reshape.impute_mean(_holes(spark, d), ["name"], ["value"]), ["name"], "result")
    return _rounded(filled, ["value"])


@query("impute_median_train", f"""
    WITH x AS (SELECT event_id, name, value, CAST({v.h32("'0'", "event_id")} % 100 < 70 AS INTEGER) AS train FROM ({_HOLES})),
         m AS (SELECT name, median(value) AS med FROM x WHERE train = 1 GROUP BY 1)
    SELECT x.event_id, x.name, x.train, round(coalesce(x.value, m.med), 6) AS value FROM x JOIN m ON x.name = m.name""", ["history"])
def impute_median_train(spark, d):
    rows = _holes(spark, d).select("event_id", "name", "value", reshape.split_flag(0, 70, "event_id").alias("train"))
    return _rounded(reshape.impute_median_from_train(rows, ["name"], ["value"], "train"), ["value"])


@query("split_train_test", f"SELECT o_orderkey, CAST({v.h32("'7'", 'o_orderkey')} % 100 < 70 AS INTEGER) AS train FROM orders")
def split_train_test(spark, d):
    return v.table(spark, d, "orders", "o_orderkey").withColumn("train", reshape.split_flag(7, 70, "o_orderkey"))


@query("scale_minmax", """
    SELECT c_custkey, c_nationkey, round((c_acctbal - min(c_acctbal) OVER w) / nullif(max(c_acctbal) OVER w - min(c_acctbal) OVER w, 0), 6) AS c_acctbal
    FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def scale_minmax(spark, d):
    return _rounded(reshape.scale_min_max(v.table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], ["c_acctbal"]), ["c_acctbal"])
