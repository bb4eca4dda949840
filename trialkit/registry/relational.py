"""Joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialkit.operators import joins, reshape
from trialkit.operators.ranks import keep_first
from trialkit.plans import matching, reports, synthesis
from trialkit.plans.cohort import union_records
from trialkit.plans.survival import life_table
from trialkit.registry import views as v
from trialkit.registry.base import query

_ORDERS_DX = "SELECT o.ptid, o.order_id, o.order_day, c.dx_date FROM ord o JOIN cohort c ON o.ptid = c.ptid"


def _orders_dx(spark, d):
    return v.orders(spark, d).select("ptid", "order_id", "order_day"), v.cohort(spark, d).select("ptid", "dx_date")


@query("join_window_after", f"""
    {_ORDERS_DX} WHERE o.order_day >= c.dx_date AND abs(datediff('day', c.dx_date, o.order_day)) <= 90""", ["ord", "cohort"])
def join_window_after(spark, d):
    o, c = _orders_dx(spark, d)
    return joins.on_or_after(o, c, "ptid", "order_day", "dx_date", 90)


@query("join_window_before", f"""
    {_ORDERS_DX} WHERE o.order_day < c.dx_date AND abs(datediff('day', c.dx_date, o.order_day)) <= 14""", ["ord", "cohort"])
def join_window_before(spark, d):
    o, c = _orders_dx(spark, d)
    return joins.strictly_before(o, c, "ptid", "order_day", "dx_date", 14)


@query("join_window_two_sided", f"""
    {_ORDERS_DX} WHERE datediff('day', c.dx_date, o.order_day) BETWEEN -14 AND 90""", ["ord", "cohort"])
def join_window_two_sided(spark, d):
    o, c = _orders_dx(spark, d)
    return joins.in_window(o, c, "ptid", "order_day", "dx_date", 14, 90)


@query("join_history_before", f"{_ORDERS_DX} WHERE o.order_day < c.dx_date", ["ord", "cohort"])
def join_history_before(spark, d):
    o, c = _orders_dx(spark, d)
    return joins.strictly_before(o, c, "ptid", "order_day", "dx_date")


@query("join_on_or_after_two_anchors", """
    SELECT r.ptid, r.order_id, r.line, r.ship_day, t.dx_date, t.therapy_date FROM rx r JOIN therapy t ON r.ptid = t.ptid
    WHERE r.ship_day >= t.dx_date AND r.ship_day >= t.therapy_date""", ["rx", "therapy"])
def join_on_or_after_two_anchors(spark, d):
    lines = v.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").join(
        v.table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(F.col("o_custkey").alias("ptid"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), v.day("l_shipdate").alias("ship_day"))
    return joins.on_or_after_all(lines, v.therapy(spark, d).select("ptid", "dx_date", "therapy_date"), "ptid", "ship_day", ["dx_date", "therapy_date"])


@query("join_inner_project", """
    SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def join_inner_project(spark, d):
    c = v.table(spark, d, "customer", "c_custkey", "c_nationkey")
    n = v.table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = v.table(spark, d, "region", "r_regionkey", "r_name")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("join_full_outer_using", """
    WITH a AS (SELECT p_brand || ' ' || p_name AS drug, min(p_partkey) AS ndc FROM part WHERE p_size <= 25 GROUP BY 1),
         b AS (SELECT p_brand || ' ' || p_name AS drug, max(p_retailprice) AS price FROM part WHERE p_size > 25 GROUP BY 1)
    SELECT DISTINCT drug, ndc, price FROM a FULL OUTER JOIN b USING (drug)""")
def join_full_outer_using(spark, d):
    p = v.table(spark, d, "part", "p_partkey", "p_brand", "p_name", "p_size", "p_retailprice").withColumn("drug", F.concat_ws(" ", "p_brand", "p_name"))
    a = p.where("p_size <= 25").groupBy("drug").agg(F.min("p_partkey").alias("ndc"))
    b = p.where("p_size > 25").groupBy("drug").agg(F.max("p_retailprice").alias("price"))
    return a.join(b, on="drug", how="outer").dropDuplicates()


@query("join_semi_codes", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'ring|gear$'))""")
def join_semi_codes(spark, d):
    listed = v.codes(spark, d).where("class_a = 1").select(F.col("code").alias("l_partkey"))
    return joins.with_codes(v.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), listed, "l_partkey")


@query("join_anti_exclude", """
    WITH c AS (SELECT o.priority AS drug, o.ptid, min(o.order_day) AS first_day FROM ord o GROUP BY 1, 2),
         t AS (SELECT DISTINCT priority AS drug, ptid FROM ord WHERE status = 'F')
    SELECT c.drug, c.ptid, c.first_day FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.drug = c.drug AND t.ptid = c.ptid)""", ["ord"])
def join_anti_exclude(spark, d):
    o = v.orders(spark, d).withColumnRenamed("priority", "drug")
    controls = o.groupBy("drug", "ptid").agg(F.min("order_day").alias("first_day"))
    return controls.join(o.where("status = 'F'").select("drug", "ptid"), ["drug", "ptid"], "left_anti")


@query("join_fill_missing_ids", """
    WITH a AS (SELECT ptid, min(order_day) AS first_day, 'filled' AS source FROM ord WHERE status = 'F' AND priority = '2-HIGH' GROUP BY ptid),
         b AS (SELECT ptid, min(order_day) AS first_day, 'open' AS source FROM ord WHERE status = 'O' GROUP BY ptid)
    SELECT ptid, first_day, source FROM a UNION ALL SELECT ptid, first_day, source FROM b WHERE ptid NOT IN (SELECT ptid FROM a)""", ["ord"])
def join_fill_missing_ids(spark, d):
    o = v.orders(spark, d).select("ptid", "order_day", "status", "priority")
    filled = o.where("status = 'F' and priority = '2-HIGH'").select("ptid", F.col("order_day").alias("first_day"), F.lit("filled").alias("source"))
    still_open = o.where("status = 'O'").select("ptid", F.col("order_day").alias("first_day"), F.lit("open").alias("source"))
    return joins.prefer_first(filled, still_open, "ptid", ["first_day", "source"])


@query("join_left_multi", """
    WITH base AS (SELECT i.ptid, i.index_date, r.rep FROM index_rows i, (SELECT unnest([0, 1]) AS rep) r)
    SELECT b.ptid, b.index_date, b.rep, c.clicks, e.errors FROM base b
    LEFT JOIN (SELECT ptid, count(*) AS clicks FROM history WHERE name = 'click' GROUP BY ptid) c ON b.ptid = c.ptid
    LEFT JOIN (SELECT ptid, count(*) AS errors FROM history WHERE name = 'error' GROUP BY ptid) e ON b.ptid = e.ptid""",
    ["index_rows", "history"])
def join_left_multi(spark, d):
    base = v.index_rows(spark, d)
    h = v.history(spark, d)
    keys = ["ptid", "index_date"]

    def counted(rows, name):
        return base.join(rows, "ptid").groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    blocks = [counted(h.where("name = 'click'"), "clicks"), counted(h.where("name = 'error'"), "errors")]
    return joins.left_all(base.withColumn("rep", F.explode(F.array(F.lit(0), F.lit(1)))), blocks, keys)


@query("join_dim_lookup", """
    SELECT p_partkey, p_type, CASE p_type WHEN 'ECONOMY' THEN 'Economy' WHEN 'LARGE' THEN 'Large' WHEN 'MEDIUM' THEN 'Medium'
           WHEN 'PROMO' THEN 'Promotion' END AS display, CASE p_type WHEN 'ECONOMY' THEN 'price' WHEN 'PROMO' THEN 'price'
           WHEN 'LARGE' THEN 'size' WHEN 'MEDIUM' THEN 'size' END AS category FROM part""")
def join_dim_lookup(spark, d):
    names = [("ECONOMY", "Economy", "price"), ("LARGE", "Large", "size"), ("MEDIUM", "Medium", "size"), ("PROMO", "Promotion", "price")]
    dim = spark.createDataFrame(names, "p_type string, display string, category string")
    return v.table(spark, d, "part", "p_partkey", "p_type").join(F.broadcast(dim), "p_type", "left")  # four literal rows


@query("join_asof_history", """
    WITH f AS (SELECT r.ptid, r.drug, min(r.rx_date) AS first_day FROM records r JOIN therapy t ON r.ptid = t.ptid
               WHERE r.rx_date >= t.therapy_date AND datediff('day', t.therapy_date, r.rx_date) <= 90 GROUP BY 1, 2)
    SELECT f.ptid, f.drug, f.first_day, h.last_day, datediff('day', h.last_day, f.first_day) AS gap FROM f
    LEFT JOIN (SELECT r.ptid, r.drug, max(r.rx_date) AS last_day FROM records r JOIN therapy t ON r.ptid = t.ptid
               WHERE r.rx_date < t.therapy_date GROUP BY 1, 2) h ON f.ptid = h.ptid AND f.drug = h.drug""", ["records", "therapy"])
def join_asof_history(spark, d):
    r = v.records(spark, d).join(v.therapy(spark, d).select("ptid", "therapy_date"), "ptid")
    inside = (F.col("rx_date") >= F.col("therapy_date")) & (F.col("rx_date") <= F.date_add("therapy_date", 90))
    return (
        r.groupBy("ptid", "drug")
        .agg(F.min(F.when(inside, F.col("rx_date"))).alias("first_day"), F.max(F.when(F.col("rx_date") < F.col("therapy_date"), F.col("rx_date"))).alias("last_day"))
        .where("first_day is not null")
        .withColumn("gap", F.datediff("first_day", "last_day"))
    )


@query("join_pairwise_distance", """
    SELECT t.trial, t.id AS t_id, count(*) AS n_controls, round(min(abs(t.score - c.score)), 6) AS nearest,
           round(sum(abs(t.score - c.score)), 4) AS total_distance, round(max(abs(t.score - c.score)), 6) AS farthest
    FROM cust_trial t JOIN cust_trial c ON t.trial = c.trial AND t.treatment = 1 AND c.treatment = 0 GROUP BY 1, 2""", ["cust_trial"])
def join_pairwise_distance(spark, d):
    p = matching.distance_profile(v.cust_trial(spark, d).select("trial", "id", "treatment", "score"), ["trial"])
    total = F.round(F.col("mean_distance") * F.col("n_controls"), 4).alias("total_distance")
    return p.select("trial", "t_id", "n_controls", total, *[F.round(c, 6).alias(c) for c in ("nearest", "farthest")])


# ---- aggregates ------------------------------------------------------------------------------------


@query("agg_value_counts", "SELECT p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def agg_value_counts(spark, d):
    lines = v.table(spark, d, "lineitem", "l_partkey").join(v.table(spark, d, "part", "p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type")


@query("agg_count_threshold", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 75")
def agg_count_threshold(spark, d):
    return v.table(spark, d, "part", "p_brand").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).where("n > 75")


@query("agg_both_classes_first_date", """
    SELECT r.ptid, CASE WHEN max(k.class_a) = 1 AND max(k.class_b) = 1 THEN 1 ELSE 0 END AS both_classes, min(r.rx_date) AS first_day
    FROM records r JOIN codes k ON r.code = k.code WHERE k.class_a + k.class_b > 0 GROUP BY r.ptid""", ["records", "codes"])
def agg_both_classes_first_date(spark, d):
    known = v.codes(spark, d).where("class_a + class_b > 0")
    r = v.records(spark, d, known).join(known, "code")
    both = ((F.max("class_a") == 1) & (F.max("class_b") == 1)).cast("int")
    return r.groupBy("ptid").agg(both.alias("both_classes"), F.min("rx_date").alias("first_day"))


@query("agg_distinct_rows", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def agg_distinct_rows(spark, d):
    return v.table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority").dropDuplicates()


@query("agg_keep_first_by_key", """
    SELECT ptid, order_id, order_day, price FROM (
        SELECT *, row_number() OVER (PARTITION BY ptid ORDER BY order_day, order_id) AS rn FROM ord) WHERE rn = 1""", ["ord"])
def agg_keep_first_by_key(spark, d):
    return keep_first(v.orders(spark, d).select("ptid", "order_id", "order_day", "price"), ["ptid"], ["order_day", "order_id"])


@query("agg_unique_values", "SELECT DISTINCT o_custkey FROM orders")
def agg_unique_values(spark, d):
    return v.table(spark, d, "orders", "o_custkey").distinct()


@query("agg_nonempty_members", """
    SELECT name AS sae_class, count(DISTINCT ptid) AS n_patients FROM history GROUP BY name HAVING count(DISTINCT ptid) > 10""", ["history"])
def agg_nonempty_members(spark, d):
    h = v.history(spark, d).select(F.col("name").alias("sae_class"), "ptid")
    return h.groupBy("sae_class").agg(F.count_distinct("ptid").alias("n_patients")).where("n_patients > 10")


@query("agg_median_iqr", """
    WITH x AS (SELECT c_acctbal, CAST(c_nationkey AS DOUBLE) AS nation FROM customer)
    SELECT 'c_acctbal' AS variable, round(median(c_acctbal), 2) AS median, round(quantile_cont(c_acctbal, 0.25), 2) AS q1, round(quantile_cont(c_acctbal, 0.75), 2) AS q3 FROM x
    UNION ALL SELECT 'c_nationkey', round(median(nation), 2), round(quantile_cont(nation, 0.25), 2), round(quantile_cont(nation, 0.75), 2) FROM x""")
def agg_median_iqr(spark, d):
    return reports.median_iqr(v.table(spark, d, "customer", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"])


@query("agg_category_share", """
    WITH u AS (SELECT 'gender' AS variable, gender AS category FROM clinical UNION ALL SELECT 'race', race FROM clinical
               UNION ALL SELECT 'region', region FROM clinical UNION ALL SELECT 'ecog', CAST(ecog AS VARCHAR) FROM clinical)
    SELECT variable, category, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY variable) AS BIGINT) AS total,
           round(count(*) / sum(count(*)) OVER (PARTITION BY variable) * 100, 2) AS percent FROM u GROUP BY 1, 2""", ["clinical"])
def agg_category_share(spark, d):
    return reports.category_shares(v.clinical(spark, d), ["gender", "race", "region", "ecog"])


@query("agg_group_mean_std", """
    SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_quantity, round(stddev_samp(l_quantity), 6) AS std_quantity,
           round(avg(l_discount), 6) AS mean_discount, round(stddev_samp(l_discount), 6) AS std_discount FROM lineitem GROUP BY 1""")
def agg_group_mean_std(spark, d):
    cols = ("quantity", "discount")
    return v.table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_discount").groupBy("l_returnflag").agg(
        *[F.round(F.avg(f"l_{c}"), 6).alias(f"mean_{c}") for c in cols], *[F.round(F.stddev_samp(f"l_{c}"), 6).alias(f"std_{c}") for c in cols]
    )


@query("agg_mad", """
    SELECT l_returnflag, round(any_value(m), 6) AS median, round(median(abs(l_extendedprice - m)), 6) AS mad
    FROM (SELECT l_returnflag, l_extendedprice, median(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY 1""")
def agg_mad(spark, d):
    found = reshape.median_abs_deviation(v.table(spark, d, "lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return found.select("l_returnflag", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("agg_percentiles", """
    SELECT drug, round(quantile_cont(hr, 0.025), 4) AS p025, round(quantile_cont(hr, 0.975), 4) AS p975, round(quantile_cont(hr, 0.05), 4) AS p05,
           round(quantile_cont(hr, 0.5), 4) AS p50, round(quantile_cont(hr, 0.95), 4) AS p95 FROM estimates GROUP BY drug""", ["estimates"])
def agg_percentiles(spark, d):
    probs = {"p025": 0.025, "p975": 0.975, "p05": 0.05, "p50": 0.5, "p95": 0.95}
    found = synthesis.estimate_percentiles(v.estimates(spark, d), ["drug"], "hr", probs)
    return found.select("drug", *[F.round(p, 4).alias(p) for p in probs])


# ---- windows ---------------------------------------------------------------------------------------


@query("win_first_by_closest", """
    SELECT ptid, index_date, status, test_date FROM (
        SELECT h.ptid, i.index_date, CASE WHEN name = 'error' THEN 'former' WHEN name = 'view' THEN 'never' ELSE 'current' END AS status, h.date AS test_date,
               row_number() OVER (PARTITION BY h.ptid ORDER BY abs(datediff('day', h.date, i.index_date)),
                   CASE WHEN name = 'error' THEN 2 WHEN name = 'view' THEN 3 ELSE 1 END, h.date) AS rn
        FROM history h JOIN index_rows i ON h.ptid = i.ptid
        WHERE h.date BETWEEN i.index_date - INTERVAL 7 DAY AND i.index_date - INTERVAL 1 DAY AND h.name <> 'signup') WHERE rn = 1""", ["history", "index_rows"])
def win_first_by_closest(spark, d):
    h = joins.in_window(v.history(spark, d).where("name <> 'signup'").select("ptid", "name", "date"), v.index_rows(spark, d), "ptid", "date", "index_date", 7, -1)
    status = F.when(F.col("name") == "error", "former").when(F.col("name") == "view", "never").otherwise("current")
    rank = F.when(F.col("name") == "error", 2).when(F.col("name") == "view", 3).otherwise(1)
    rows = h.select("ptid", "index_date", status.alias("status"), F.col("date").alias("test_date"), rank.alias("_rank"))
    return keep_first(rows, ["ptid"], [F.abs(F.datediff("index_date", "test_date")), "_rank", "test_date"]).drop("_rank")


@query("win_first_last_in_group", """
    SELECT ptid, drug, min(rx_date) AS first_day, max(rx_date) AS last_day, datediff('day', min(rx_date), max(rx_date)) AS span FROM records GROUP BY 1, 2""", ["records"])
def win_first_last_in_group(spark, d):
    spans = v.records(spark, d).groupBy("ptid", "drug").agg(F.min("rx_date").alias("first_day"), F.max("rx_date").alias("last_day"))
    return spans.withColumn("span", F.datediff("last_day", "first_day"))


@query("win_ordered_category_rank", """
    SELECT p_partkey, p_type, CAST(r AS INTEGER) AS type_rank FROM part JOIN (
        SELECT p_type AS k, dense_rank() OVER (ORDER BY p_type) AS r FROM (SELECT DISTINCT p_type FROM part)) ON p_type = k""")
def win_ordered_category_rank(spark, d):
    p = v.table(spark, d, "part", "p_partkey", "p_type")
    levels = p.select("p_type").distinct().withColumn("type_rank", F.dense_rank().over(Window.orderBy("p_type")))  # one row per level
    return p.join(levels, "p_type")


LIFE_SQL = """
    daily AS (SELECT trial, days AS time, CAST(sum(CASE WHEN flag = 1 AND treatment = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS d0,
        CAST(sum(CASE WHEN flag = 1 AND treatment = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS d1,
        CAST(sum(CASE WHEN treatment = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS m0, CAST(sum(treatment) AS DOUBLE) AS m1
        FROM cust_trial GROUP BY 1, 2),
    life AS (SELECT trial, time, d0, d1, sum(m0) OVER w AS n0, sum(m1) OVER w AS n1 FROM daily
        WINDOW w AS (PARTITION BY trial ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("win_risk_set", f"WITH {LIFE_SQL} SELECT trial, time, d0, d1, n0, n1 FROM life", ["cust_trial"])
def win_risk_set(spark, d):
    return life_table(v.cust_trial(spark, d), ["trial"], "days", "flag")


# ---- sorts, limits, top-k --------------------------------------------------------------------------


@query("sort_by_keys", "SELECT ptid, order_id, order_day, price FROM ord", ["ord"])
def sort_by_keys(spark, d):
    return v.orders(spark, d).select("ptid", "order_id", "order_day", "price").orderBy("order_day", F.desc("price"), "order_id")


@query("limit_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def limit_preview(spark, d):
    return v.table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("reorder_rows", """
    SELECT x.pos, x.p_type, c.n FROM (VALUES (1, 'STANDARD'), (2, 'SMALL'), (3, 'MISSING'), (4, 'LARGE'), (5, 'ECONOMY')) x(pos, p_type)
    LEFT JOIN (SELECT p_type, count(*) AS n FROM part GROUP BY 1) c ON x.p_type = c.p_type""")
def reorder_rows(spark, d):
    order = ["STANDARD", "SMALL", "MISSING", "LARGE", "ECONOMY"]
    places = spark.createDataFrame([(i + 1, t) for i, t in enumerate(order)], "pos int, p_type string")
    counts = v.table(spark, d, "part", "p_type").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return places.join(counts, "p_type", "left").select("pos", "p_type", "n").orderBy("pos")


@query("topk_nearest", f"""
    SELECT trial, t_id, c_id, round(distance, 6) AS distance, CAST(rn AS INTEGER) AS nth FROM (
        SELECT t.trial, t.id AS t_id, c.id AS c_id, abs(t.score - c.score) AS distance,
               row_number() OVER (PARTITION BY t.trial, t.id ORDER BY abs(t.score - c.score), {v.h32('c.id')}, c.id) AS rn
        FROM cust_trial t JOIN cust_trial c ON t.trial = c.trial AND t.treatment = 1 AND c.treatment = 0) WHERE rn <= 2""", ["cust_trial"])
def topk_nearest(spark, d):
    near = matching.nearest_controls(v.cust_trial(spark, d), ["trial"], 2)
    return near.select("trial", "t_id", "c_id", F.round("distance", 6).alias("distance"), "nth")


# ---- set operations --------------------------------------------------------------------------------


@query("union_all_sources", """
    SELECT o_custkey AS ptid, CAST(o_orderdate AS DATE) AS rx_date, 'pres' AS source FROM orders
    UNION ALL SELECT l_suppkey, CAST(l_shipdate AS DATE), 'adm' FROM lineitem""")
def union_all_sources(spark, d):
    pres = v.table(spark, d, "orders", "o_custkey", "o_orderdate").select(F.col("o_custkey").alias("ptid"), v.day("o_orderdate").alias("rx_date"))
    adm = v.table(spark, d, "lineitem", "l_suppkey", "l_shipdate").select(F.col("l_suppkey").alias("ptid"), v.day("l_shipdate").alias("rx_date"))
    return union_records([("pres", pres), ("adm", adm)])


_BRANDS = "SELECT p_brand, p_name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_linestatus = '{}'"


@query("intersect_lists", f"SELECT DISTINCT p_brand, p_name FROM ({_BRANDS.format('O')}) INTERSECT SELECT p_brand, p_name FROM ({_BRANDS.format('F')})")
def intersect_lists(spark, d):
    lines = v.table(spark, d, "lineitem", "l_partkey", "l_linestatus").join(
        v.table(spark, d, "part", "p_partkey", "p_brand", "p_name"), F.col("l_partkey") == F.col("p_partkey")
    )
    run = lambda status: lines.where(F.col("l_linestatus") == status).select("p_brand", "p_name")
    return run("O").intersect(run("F"))


@query("except_ids", """
    SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""")
def except_ids(spark, d):
    o = v.table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    return o.where("o_orderstatus = 'O'").select("o_custkey").subtract(o.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select("o_custkey"))
