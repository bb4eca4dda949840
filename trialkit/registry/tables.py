"""Scans, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialkit.functions.text import path_safe
from trialkit.operators import reshape
from trialkit.operators.joins import not_in_ignoring_case
from trialkit.plans.cohort import gap_or_null
from trialkit.plans.synthesis import finite
from trialkit.registry import views as v
from trialkit.registry.base import query
from trialkit.session import scratch_path
from trialkit.sources import tables as src


@query("scan_table", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders""")
def scan_table(spark, d):
    return v.table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


@query("scan_delimited", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_delimited(spark, d):
    path = scratch_path(spark, "customer")
    v.table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").write.option("header", True).csv(path)
    return src.read_delimited(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("scan_json_list", """
    SELECT DISTINCT name FROM (SELECT unnest([event_type, 'k' || json_extract_string(props, '$.k')]) AS name FROM events)""")
def scan_json_list(spark, d):
    lists = v.table(spark, d, "events", "event_type", "props").select(
        F.to_json(F.array("event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k")))).alias("text")
    )
    return src.read_name_list(lists, "text")


@query("scan_nested_history", "SELECT ptid, name, date, value FROM history", ["history"])
def scan_nested_history(spark, d):
    nested = src.nest_history(v.history(spark, d), ["ptid"], "name", "date", "value")
    return src.flatten_history(nested, ["ptid"], "name")


@query("sink_table", "SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def sink_table(spark, d):
    path = scratch_path(spark, "orders")
    df = v.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    src.write_table(df.withColumn("o_orderdate", F.col("o_orderdate").cast("date")), path)
    return spark.read.parquet(path)


@query("sink_partitioned", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def sink_partitioned(spark, d):
    path = scratch_path(spark, "lineitem")
    src.write_table(v.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), path, partition_by=["l_returnflag"])
    return spark.read.parquet(path)


@query("path_safe_key", "SELECT p_partkey, replace(p_type || '/' || p_brand, '/', '-') AS drug_key FROM part")
def path_safe_key(spark, d):
    p = v.table(spark, d, "part", "p_partkey", "p_type", "p_brand")
    return p.select("p_partkey", path_safe(F.concat_ws("/", "p_type", "p_brand")).alias("drug_key"))


@query("cache_reuse", """
    WITH a AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)
    SELECT o_orderstatus, count(*) AS n_customers, (SELECT count(*) FROM a) AS n_rows FROM a GROUP BY 1""")
def cache_reuse(spark, d):
    pinned = src.reuse(v.table(spark, d, "orders", "o_custkey", "o_orderstatus").distinct())
    total = pinned.agg(F.count(F.lit(1))).scalar()
    return pinned.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_customers")).withColumn("n_rows", total)


@query("project_rename", """
    SELECT o_custkey AS ptid, CAST(o_orderdate AS DATE) AS rx_date, o_orderpriority AS generic_desc, 'adm' AS source FROM orders""")
def project_rename(spark, d):
    return (
        v.table(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderpriority")
        .withColumnsRenamed({"o_custkey": "ptid", "o_orderpriority": "generic_desc"})
        .select("ptid", F.col("o_orderdate").cast("date").alias("rx_date"), "generic_desc", F.lit("adm").alias("source"))
    )


@query("drop_duplicate_columns", """
    SELECT o_custkey AS ptid, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def drop_duplicate_columns(spark, d):
    o = v.table(spark, d, "orders", "o_custkey", "o_orderkey").withColumnRenamed("o_custkey", "ptid")
    c = v.table(spark, d, "customer", "c_custkey", "c_name").withColumnRenamed("c_custkey", "ptid")
    return o.join(c, "ptid")  # USING keeps one copy of the key


@query("drop_columns", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem")
def drop_columns(spark, d):
    return v.table(spark, d, "lineitem").drop(
        "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
    )


@query("column_order", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS d_flag, o_custkey, o_totalprice FROM orders")
def column_order(spark, d):
    o = v.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return o.withColumn("d_flag", (F.col("o_orderstatus") == "F").cast("int")).select("o_orderkey", "d_flag", "o_custkey", "o_totalprice")


@query("filter_rlike", """
    SELECT p_partkey, p_name, CAST(regexp_matches(p_name, '(bolt|gear$)') AS INTEGER) AS hit FROM part
    WHERE regexp_matches(p_name, '(bolt|gear$)') OR NOT regexp_matches(p_name, '(red|blue|small)')""")
def filter_rlike(spark, d):
    name = F.col("p_name")
    hit = name.rlike("(bolt|gear$)")
    return v.table(spark, d, "part", "p_partkey", "p_name").where(hit | ~name.rlike("(red|blue|small)")).withColumn("hit", hit.cast("int"))


@query("filter_in_list", """
    SELECT p_partkey, p_type, p_brand FROM part WHERE p_type IN ('SMALL', 'PROMO', 'LARGE') AND p_brand NOT IN ('Brand#1', 'Brand#2')""")
def filter_in_list(spark, d):
    return v.table(spark, d, "part", "p_partkey", "p_type", "p_brand").where(
        F.col("p_type").isin("SMALL", "PROMO", "LARGE") & ~F.col("p_brand").isin("Brand#1", "Brand#2")
    )


@query("filter_not_in_ci", """
    SELECT p_partkey, p_brand FROM part
    WHERE lower(p_brand) NOT IN (SELECT lower(upper(p_brand)) FROM part WHERE p_size > 45 AND p_type = 'SMALL')""")
def filter_not_in_ci(spark, d):
    p = v.table(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_type")
    listed = p.where("p_size > 45 and p_type = 'SMALL'").select(F.upper("p_brand").alias("listed"))
    return not_in_ignoring_case(p.select("p_partkey", "p_brand"), "p_brand", listed, "listed")


@query("filter_gap_or_null", """
    SELECT ptid, dx_date, prior_date FROM cohort WHERE prior_date IS NULL OR abs(datediff('day', dx_date, prior_date)) > 365""", ["cohort"])
def filter_gap_or_null(spark, d):
    return v.cohort(spark, d).where(gap_or_null(F.col("prior_date"), F.col("dx_date"), 365))


@query("filter_between_interval", """
    SELECT h.ptid, h.event_id, h.date, i.index_date FROM history h JOIN index_rows i ON h.ptid = i.ptid
    WHERE h.date BETWEEN i.index_date - INTERVAL 7 DAY AND i.index_date - INTERVAL 1 DAY""", ["history", "index_rows"])
def filter_between_interval(spark, d):
    joined = v.history(spark, d).select("ptid", "event_id", "date").join(v.index_rows(spark, d), "ptid")
    return joined.where(F.col("date").between(F.expr("index_date - INTERVAL 7 DAY"), F.expr("index_date - INTERVAL 1 DAY")))


@query("filter_finite", """
    SELECT l_orderkey, l_linenumber, round(l_quantity / l_discount, 6) AS ratio FROM lineitem WHERE l_discount <> 0""")
def filter_finite(spark, d):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_quantity", "l_discount"))
    rows = v.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount").withColumn("ratio", ratio)
    return rows.where(finite(F.col("ratio"))).select("l_orderkey", "l_linenumber", F.round("ratio", 6).alias("ratio"))


_WIDE = ", ".join(f"round(sum(CASE WHEN name = '{e}' THEN value END), 6) AS total_{e}" for e in v.EVENT_TYPES)


@query("drop_all_null_columns", f"SELECT ptid, {_WIDE} FROM history GROUP BY ptid", ["history"])
def drop_all_null_columns(spark, d):
    names = [*v.EVENT_TYPES, "never_seen"]
    wide = v.history(spark, d).groupBy("ptid").agg(
        *[F.round(F.sum(F.when(F.col("name") == n, F.col("value"))), 6).alias(f"total_{n}") for n in names]
    )
    return reshape.drop_all_null(wide)


@query("drop_constant_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def drop_constant_columns(spark, d):
    o = v.table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return reshape.drop_constant(o.withColumn("site", F.lit("one")).withColumn("version", F.lit(0)))
