"""Study-shaped views over the test tables, as Spark plans and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialkit.functions.hashing import hash32
from trialkit.plans.cohort import dual_therapy
from trialkit.session import cut
from trialkit.sources.tables import read_parquet

# Fixed values of the stand-in study.
CLASS_A, CLASS_B = "ring|gear$", "bolt|widget"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LOOKBACK_DAYS = 7


def table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    return read_parquet(spark, d, name, cols)


def h32(*parts: str) -> str:
    """SQL text of functions.hashing.hash32."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def day(col: str) -> Column:
    return F.col(col).cast("date")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("ptid"), F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"), day("o_orderdate").alias("order_day"), F.col("o_orderpriority").alias("priority"),
    )


def cohort(spark: SparkSession, d: str) -> DataFrame:
    """Diagnosis = first urgent order; prior event = last order ahead of it."""
    o = orders(spark, d).select("ptid", "order_day", "priority")
    dx = o.where("priority = '1-URGENT'").groupBy("ptid").agg(F.min("order_day").alias("dx_date"))
    return (
        o.join(dx, "ptid")
        .groupBy("ptid", "dx_date")
        .agg(F.max(F.when(F.col("order_day") < F.col("dx_date"), F.col("order_day"))).alias("prior_date"))
    )


def records(spark: SparkSession, d: str, coded: DataFrame | None = None, patients: DataFrame | None = None) -> DataFrame:
    """Prescriptions (order date) and administrations (ship date) of the ordered parts, from one pass.

    With `coded` (code) or `patients` (ptid) only their records: parts and orders are cut down before they meet the line items, and the lines
    left are doubled last.
    """
    parts = table(spark, d, "part", "p_partkey", "p_type")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    if coded is not None:
        parts = parts.join(coded.select(F.col("code").alias("p_partkey")), "p_partkey", "left_semi")
    if patients is not None:
        o = o.join(patients.select(F.col("ptid").alias("o_custkey")), "o_custkey", "left_semi")
    lines = (
        table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    dated = F.explode(
        F.array(
            F.struct(F.lit("pres").alias("source"), day("o_orderdate").alias("rx_date")),
            F.struct(F.lit("adm").alias("source"), day("l_shipdate").alias("rx_date")),
        )
    )
    return lines.select(
        F.col("o_custkey").alias("ptid"), F.col("p_type").alias("drug"), F.col("p_partkey").alias("code"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), dated.alias("r"),
    ).select("ptid", "drug", "code", "order_id", "line", "r.source", "r.rx_date")


def codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_name").select(
        F.col("p_partkey").alias("code"), F.col("p_name").rlike(CLASS_A).cast("int").alias("class_a"),
        F.col("p_name").rlike(CLASS_B).cast("int").alias("class_b"),
    )


def dual(spark: SparkSession, d: str) -> DataFrame:
    patients, known = cut(cohort(spark, d)), codes(spark, d)
    return dual_therapy(patients, records(spark, d, known.where("class_a + class_b > 0"), patients), known)


def therapy(spark: SparkSession, d: str) -> DataFrame:
    return dual(spark, d).where("combined_therapy = 1").select(
        "ptid", "dx_date", "prior_date", F.col("combined_therapy_date").alias("therapy_date")
    )


def death(spark: SparkSession, d: str) -> DataFrame:
    """Recorded death = last filled order; recorded last activity = first order."""
    return orders(spark, d).groupBy("ptid").agg(
        F.max(F.when(F.col("status") == "F", F.col("order_day"))).alias("unvalidated_dod"), F.min("order_day").alias("last_act_dt")
    )


def clinical(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation", "n_nationkey", "n_regionkey")
    r = table(spark, d, "region", "r_regionkey", "r_name")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    return (
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            k.alias("ptid"),
            F.when(k % 17 == 0, "Unknown").when(k % 2 == 0, "Male").otherwise("Female").alias("gender"),
            F.when(seg.isin("BUILDING", "FURNITURE"), "Caucasian").otherwise(seg).alias("race"),
            F.when(k % 10 == 0, "1935 and Earlier").otherwise((1936 + k % 50).cast("string")).alias("birth_yr"),
            F.col("r_name").alias("region"),
            F.when(k % 7 != 0, (k % 5).cast("int")).alias("ecog"),
        )
    )


def history(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("ptid"), F.col("event_type").alias("name"), day("ts").alias("date"), "value", "event_id",
        F.when(i % 13 == 0, "n/a").when(i % 17 == 0, "5d").otherwise(F.get_json_object("props", "$.k")).alias("result"),
    )


def index_rows(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "events", "ts", "user_id", "event_type")
    first = F.min(day("ts")).alias("index_date")
    return (
        h.where("event_type = 'purchase'")
        .groupBy(F.col("user_id").alias("ptid")).agg(first)
    )


def cust_trial(spark: SparkSession, d: str) -> DataFrame:
    """Five trials of customers: an arm that depends on the balance, covariates, follow-up and an event flag."""
    o = orders(spark, d)
    seen = o.groupBy("ptid").agg(
        F.count(F.lit(1)).cast("int").alias("n_orders"), F.avg("price").alias("spend"), F.min("order_day").alias("first_day"),
        F.max("order_day").alias("last_day"), F.max(F.when(F.col("status") == "F", F.col("order_day"))).alias("last_f"),
    )
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    arm = (hash32(k, F.lit("arm")) % 100 < F.when(bal > 4500, 45).otherwise(25)).cast("int")
    return c.join(seen, k == F.col("ptid")).select(
        (F.col("c_nationkey") % 5).cast("int").alias("trial"), k.alias("id"), arm.alias("treatment"), bal.alias("bal"), "n_orders", "spend",
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("building"),
        F.datediff("last_day", "first_day").alias("days"),
        F.coalesce((F.col("last_f") == F.col("last_day")).cast("int"), F.lit(0)).alias("flag"),
        F.round(1 / (1 + F.exp(-(bal - 4500) / 4000)), 4).alias("score"),
    )


def estimates(spark: SparkSession, d: str) -> DataFrame:
    """A hundred trial estimates per part type."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax")
    parts = table(spark, d, "part", "p_partkey", "p_type")
    means = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_type").alias("drug"), (F.col("l_orderkey") % 100).cast("int").alias("boot_id"))
        .agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("di"), F.avg("l_tax").alias("ta"), F.count(F.lit(1)).alias("n"))
    )
    hr = F.round(F.col("q") / 25.4, 6)
    return means.select(
        "drug", "boot_id", hr.alias("hr"), F.round(hr * (0.7 + F.col("di")), 6).alias("hr_low"),
        F.round(hr * (1.3 + F.col("ta")), 6).alias("hr_high"), (F.col("n") % 30 + 5).cast("int").alias("ori_unbalanced_covariates"),
        (F.col("n") % 30).cast("int").alias("unbalanced_covariates"),
    )



def closest_first(rows: str, score: str, ratio: int = 1, caliper: str | None = None) -> str:
    """SQL of matching one closest pair at a time: `pairs` and the recursive `taken`.

    A treated row's turn is one more than the controls it has; earlier turns go first.
    """
    near = "" if caliper is None else f" JOIN {caliper} q ON q.trial = t.trial AND abs(t.{score} - c.{score}) <= q.caliper"
    turn = "1" if ratio == 1 else "1 + len(list_filter(k.used_t, lambda x: x = p.t_id))"
    fresh = "NOT list_contains(k.used_t, p.t_id)" if ratio == 1 else f"len(list_filter(k.used_t, lambda x: x = p.t_id)) < {ratio}"
    return f"""
    pairs AS (SELECT t.trial, t.id AS t_id, c.id AS c_id, abs(t.{score} - c.{score}) AS distance
        FROM {rows} t JOIN {rows} c ON t.trial = c.trial AND t.treatment = 1 AND c.treatment = 0{near}),
    taken AS (
        SELECT trial, CAST([] AS BIGINT[]) AS used_t, CAST([] AS BIGINT[]) AS used_c, CAST(NULL AS BIGINT) AS t_id, CAST(NULL AS BIGINT) AS c_id,
               CAST(NULL AS DOUBLE) AS distance, 0 AS turn FROM (SELECT DISTINCT trial FROM {rows})
        UNION ALL
        SELECT trial, list_append(used_t, best.t_id), list_append(used_c, best.c_id), best.t_id, best.c_id, best.distance, CAST(best.turn AS INTEGER) FROM (
            SELECT k.trial, k.used_t, k.used_c, min(struct_pack(turn := {turn}, distance := p.distance, t_id := p.t_id, c_id := p.c_id)) AS best
            FROM taken k JOIN pairs p ON k.trial = p.trial WHERE NOT list_contains(k.used_c, p.c_id) AND {fresh} GROUP BY k.trial, k.used_t, k.used_c))"""


# name -> (views it reads, statement)
VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "ord": ((), """
        SELECT o_custkey AS ptid, o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS price,
               CAST(o_orderdate AS DATE) AS order_day, o_orderpriority AS priority FROM orders"""),
    "cohort": (("ord",), """
        SELECT o.ptid, u.dx_date, max(CASE WHEN o.order_day < u.dx_date THEN o.order_day END) AS prior_date
        FROM ord o JOIN (SELECT ptid, min(order_day) AS dx_date FROM ord WHERE priority = '1-URGENT' GROUP BY ptid) u
          ON o.ptid = u.ptid GROUP BY o.ptid, u.dx_date"""),
    "rx": ((), """
        SELECT o.o_custkey AS ptid, p.p_type AS drug, p.p_partkey AS code, l.l_orderkey AS order_id, l.l_linenumber AS line,
               CAST(o.o_orderdate AS DATE) AS order_day, CAST(l.l_shipdate AS DATE) AS ship_day
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey"""),
    "records": (("rx",), """
        SELECT ptid, drug, code, order_id, line, 'pres' AS source, order_day AS rx_date FROM rx
        UNION ALL SELECT ptid, drug, code, order_id, line, 'adm', ship_day FROM rx"""),
    "codes": ((), f"""
        SELECT p_partkey AS code, CAST(regexp_matches(p_name, '{CLASS_A}') AS INTEGER) AS class_a,
               CAST(regexp_matches(p_name, '{CLASS_B}') AS INTEGER) AS class_b FROM part"""),
    "dual": (("cohort", "records", "codes"), """
        SELECT c.ptid, c.dx_date, c.prior_date, CASE WHEN x.a = 1 AND x.b = 1 THEN 1 ELSE 0 END AS combined_therapy,
               CASE WHEN x.a = 1 AND x.b = 1 THEN x.first_day END AS combined_therapy_date
        FROM cohort c LEFT JOIN (
            SELECT r.ptid, max(k.class_a) AS a, max(k.class_b) AS b, min(r.rx_date) AS first_day
            FROM records r JOIN cohort c ON r.ptid = c.ptid JOIN codes k ON r.code = k.code
            WHERE datediff('day', c.dx_date, r.rx_date) BETWEEN -14 AND 90 AND k.class_a + k.class_b > 0
            GROUP BY r.ptid) x ON c.ptid = x.ptid"""),
    "therapy": (("dual",), """
        SELECT ptid, dx_date, prior_date, combined_therapy_date AS therapy_date FROM dual WHERE combined_therapy = 1"""),
    "death": (("ord",), """
        SELECT ptid, max(CASE WHEN status = 'F' THEN order_day END) AS unvalidated_dod, min(order_day) AS last_act_dt
        FROM ord GROUP BY ptid"""),
    "clinical": ((), """
        SELECT c_custkey AS ptid,
               CASE WHEN c_custkey % 17 = 0 THEN 'Unknown' WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
               CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'Caucasian' ELSE c_mktsegment END AS race,
               CASE WHEN c_custkey % 10 = 0 THEN '1935 and Earlier' ELSE CAST(1936 + c_custkey % 50 AS VARCHAR) END AS birth_yr,
               r_name AS region, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 5 AS INTEGER) END AS ecog
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "history": ((), """
        SELECT user_id AS ptid, event_type AS name, CAST(ts AS DATE) AS date, value, event_id,
               CASE WHEN event_id % 13 = 0 THEN 'n/a' WHEN event_id % 17 = 0 THEN '5d'
                    ELSE json_extract_string(props, '$.k') END AS result FROM events"""),
    "index_rows": ((), """
        SELECT user_id AS ptid, min(CAST(ts AS DATE)) AS index_date FROM events
        WHERE event_type = 'purchase' GROUP BY user_id"""),
    "cust_trial": (("ord",), f"""
        SELECT CAST(c_nationkey % 5 AS INTEGER) AS trial, c_custkey AS id,
               CAST({h32('c_custkey', "'arm'")} % 100 < CASE WHEN c_acctbal > 4500 THEN 45 ELSE 25 END AS INTEGER) AS treatment,
               c_acctbal AS bal, s.n_orders, s.spend, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS building,
               datediff('day', s.first_day, s.last_day) AS days,
               coalesce(CAST(s.last_f = s.last_day AS INTEGER), 0) AS flag,
               round(1 / (1 + exp(-(c_acctbal - 4500) / 4000)), 4) AS score
        FROM customer JOIN (
            SELECT ptid, CAST(count(*) AS INTEGER) AS n_orders, avg(price) AS spend, min(order_day) AS first_day,
                   max(order_day) AS last_day, max(CASE WHEN status = 'F' THEN order_day END) AS last_f
            FROM ord GROUP BY ptid) s ON c_custkey = s.ptid"""),
    "estimates": ((), """
        SELECT drug, boot_id, hr, round(hr * (0.7 + di), 6) AS hr_low, round(hr * (1.3 + ta), 6) AS hr_high,
               CAST(n % 30 + 5 AS INTEGER) AS ori_unbalanced_covariates, CAST(n % 30 AS INTEGER) AS unbalanced_covariates
        FROM (SELECT p_type AS drug, CAST(l_orderkey % 100 AS INTEGER) AS boot_id, round(avg(l_quantity) / 25.4, 6) AS hr,
                     avg(l_discount) AS di, avg(l_tax) AS ta, count(*) AS n
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""),
}
