"""Column functions: strings, dates, numbers, recodes, maps and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialkit.functions import dates, normal, recode, text
from trialkit.operators import joins
from trialkit.registry import sqlmath
from trialkit.registry import views as v
from trialkit.registry.base import query


@query("str_build_alternation", r"""
    WITH nouns AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS noun FROM part WHERE p_brand IN ('Brand#3', 'Brand#4') AND p_size < 10),
         pat AS (SELECT '(' || string_agg(CASE WHEN noun = 'gear' THEN 'gear$' ELSE noun END, '|'
                 ORDER BY CASE WHEN noun = 'gear' THEN 'gear$' ELSE noun END) || ')' AS pattern FROM nouns)
    SELECT p_partkey, p_name, pattern FROM part, pat WHERE regexp_matches(p_name, pattern)""")
def str_build_alternation(spark, d):
    p = v.table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size")
    terms = p.where(F.col("p_brand").isin("Brand#3", "Brand#4") & (F.col("p_size") < 10)).select(F.substring_index("p_name", " ", -1).alias("noun"))
    pattern = text.alternation_from_table(terms, "noun", ["gear"]).scalar()
    return p.select("p_partkey", "p_name", pattern.alias("pattern")).where(F.rlike("p_name", F.col("pattern")))


@query("match_term_dictionary", """
    WITH terms AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part UNION SELECT DISTINCT p_type FROM part
                   UNION SELECT DISTINCT substr(p_name, 3, 5) FROM part)
    SELECT p_partkey, p_name, term FROM part JOIN terms ON CASE WHEN term = 'gear' THEN ends_with(p_name, term) ELSE contains(p_name, term) END
    WHERE length(term) > 0""")
def match_term_dictionary(spark, d):
    """Names with every dictionary term that they contain; the dictionary grows with the table."""
    p = v.table(spark, d, "part", "p_partkey", "p_name", "p_type")
    terms = p.select(F.explode(F.concat(F.split("p_name", " "), F.array("p_type", F.substring("p_name", 3, 5)))).alias("term"))
    hits = joins.match_terms(p, "p_name", terms, "term", ["gear"])
    return p.select("p_partkey", "p_name").join(hits, F.col("p_name") == F.col("text")).select("p_partkey", "p_name", "term")


@query("str_regexp_extract", """
    SELECT p_partkey, regexp_extract(p_name, '(bolt|gear$|ring)', 1) AS as_is, regexp_extract(lower(upper(p_name)), '(bolt|gear$|ring)', 1) AS lowered FROM part""")
def str_regexp_extract(spark, d):
    p = v.table(spark, d, "part", "p_partkey", "p_name")
    terms = p.select(F.substring_index("p_name", " ", -1).alias("noun")).where(F.col("noun").isin("ring", "gear", "bolt"))
    pattern = text.alternation_from_table(terms, "noun", ["gear"]).scalar()
    found = p.withColumn("pattern", pattern).withColumn("low", F.lower(F.upper("p_name")))
    return found.select("p_partkey", F.expr("regexp_extract(p_name, pattern, 1)").alias("as_is"), F.expr("regexp_extract(low, pattern, 1)").alias("lowered"))


@query("str_lower", "SELECT p_partkey, lower(p_brand) AS brand, lower(p_type) AS kind FROM part")
def str_lower(spark, d):
    return v.table(spark, d, "part", "p_partkey", "p_brand", "p_type").select("p_partkey", F.lower("p_brand").alias("brand"), F.lower("p_type").alias("kind"))


@query("str_value_replace", """
    SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'STANDARD' WHEN 'ECONOMY' THEN 'SMALL' ELSE p_type END AS p_type FROM part""")
def str_value_replace(spark, d):
    p = v.table(spark, d, "part", "p_partkey", "p_type")
    return p.withColumn("p_type", recode.replace_values(F.col("p_type"), {"PROMO": "STANDARD", "ECONOMY": "SMALL"}))


@query("str_parse_interval", "SELECT l_orderkey, l_linenumber, l_discount AS lo, l_quantity AS hi FROM lineitem")
def str_parse_interval(spark, d):
    lines = v.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    sep = F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(", ")
    made = F.concat(F.lit("["), F.col("l_discount").cast("string"), sep, F.col("l_quantity").cast("string"), F.lit("]"))
    return lines.select("l_orderkey", "l_linenumber", text.interval_bounds(made).alias("b")).select("l_orderkey", "l_linenumber", "b.lo", "b.hi")


@query("str_format_number", """
    SELECT o_orderpriority, printf('%.3f', avg(o_totalprice)) AS mean_text,
           CAST(count(*) AS VARCHAR) || ' (' || CAST(round(count(*) / sum(count(*)) OVER () * 100, 2) AS VARCHAR) || '%)' AS share,
           CASE WHEN min(o_totalprice) < 2000 THEN '<2000.0000' ELSE printf('%.4f', min(o_totalprice)) END AS floor_text
    FROM orders GROUP BY 1""")
def str_format_number(spark, d):
    o = v.table(spark, d, "orders", "o_orderpriority", "o_totalprice")
    total = o.agg(F.count(F.lit(1))).scalar()
    return o.groupBy("o_orderpriority").agg(
        F.format_string("%.3f", F.avg("o_totalprice")).alias("mean_text"), F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low")
    ).select("o_orderpriority", "mean_text", text.count_percent(F.col("n"), total).alias("share"), text.p_value_text(F.col("low"), 2000).alias("floor_text"))


@query("date_diff_abs", """
    SELECT ptid, dx_date, prior_date, datediff('day', prior_date, dx_date) AS days, abs(datediff('day', dx_date, prior_date)) AS abs_days FROM cohort""", ["cohort"])
def date_diff_abs(spark, d):
    return v.cohort(spark, d).select(
        "ptid", "dx_date", "prior_date", dates.days_between(F.col("dx_date"), F.col("prior_date")).alias("days"),
        F.abs(dates.days_between(F.col("prior_date"), F.col("dx_date"))).alias("abs_days"),
    )


@query("date_add_days", """
    SELECT order_id, order_day + CAST(order_id % 90 AS INTEGER) AS later, order_day - 365 AS earlier FROM ord""", ["ord"])
def date_add_days(spark, d):
    return v.orders(spark, d).select(
        "order_id", F.date_add("order_day", (F.col("order_id") % 90).cast("int")).alias("later"), F.date_sub("order_day", 365).alias("earlier")
    )


@query("date_parse_trunc", """
    SELECT order_id, order_day AS parsed, CAST(NULL AS DATE) AS unparsed, order_day AS from_stamp FROM ord""", ["ord"])
def date_parse_trunc(spark, d):
    o = v.table(spark, d, "orders", "o_orderkey", "o_orderdate")
    as_day, as_stamp = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return o.select(
        F.col("o_orderkey").alias("order_id"), dates.parse_day(as_day).alias("parsed"),
        dates.parse_day(F.concat(F.lit("x"), as_day)).alias("unparsed"), dates.parse_day(as_stamp, "yyyy-MM-dd HH:mm:ss").alias("from_stamp"),
    )


@query("age_at_index", """
    SELECT c.ptid, year(t.dx_date) - CASE WHEN birth_yr = '1935 and Earlier' THEN 1935 ELSE CAST(birth_yr AS INTEGER) END AS age
    FROM clinical c JOIN cohort t ON c.ptid = t.ptid""", ["clinical", "cohort"])
def age_at_index(spark, d):
    joined = v.clinical(spark, d).join(v.cohort(spark, d), "ptid")
    return joined.select("ptid", dates.age_at(F.col("dx_date"), F.col("birth_yr")).alias("age"))


@query("num_guard", """
    SELECT event_id, result, CASE WHEN regexp_full_match(result, '[0-9]+') THEN CAST(result AS DOUBLE) END AS value FROM
    (SELECT event_id, CASE WHEN result = 'n/a' THEN 'nan' ELSE result END AS result FROM history)""".replace("CAST(result AS DOUBLE)", "TRY_CAST(result AS DOUBLE)"), ["history"])
def num_guard(spark, d):
    h = v.history(spark, d).select("event_id", F.when(F.col("result") == "n/a", "nan").otherwise(F.col("result")).alias("result"))
    return h.withColumn("value", text.parse_number(F.col("result")))


@query("cond_case_rlike", """
    SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'ring') THEN 'current' WHEN regexp_matches(lower(p_name), '^(red|blue)') THEN 'former'
           WHEN regexp_matches(lower(p_name), 'never|bolt$') THEN 'never' ELSE 'unknown' END AS status,
           CASE WHEN regexp_matches(lower(p_name), 'ring') THEN 1 WHEN regexp_matches(lower(p_name), '^(red|blue)') THEN 2
           WHEN regexp_matches(lower(p_name), 'never|bolt$') THEN 3 ELSE 4 END AS status_rank FROM part""")
def cond_case_rlike(spark, d):
    rules = [("ring", "current"), ("^(red|blue)", "former"), ("never|bolt$", "never")]
    name = F.col("p_name")
    return v.table(spark, d, "part", "p_partkey", "p_name").select(
        "p_partkey", recode.first_match(name, rules, "unknown").alias("status"),
        recode.first_match(name, [(p, i + 1) for i, (p, _) in enumerate(rules)], 4).alias("status_rank"),
    )


@query("cond_recode_binary", """
    SELECT ptid, CASE gender WHEN 'Male' THEN 1 WHEN 'Female' THEN 0 END AS gender, CASE WHEN race = 'Caucasian' THEN 1 ELSE 0 END AS race FROM clinical""", ["clinical"])
def cond_recode_binary(spark, d):
    return v.clinical(spark, d).select(
        "ptid", recode.binary_flag(F.col("gender"), "Male", "Female").alias("gender"), recode.is_value(F.col("race"), "Caucasian").alias("race")
    )


@query("cond_collapse_levels", """
    SELECT ptid, CASE WHEN region IN ('AMERICA', 'EUROPE', 'ASIA') THEN region ELSE 'Other/Unknown' END AS region,
           CASE WHEN ecog >= 2 THEN 2 WHEN ecog >= 0 THEN ecog ELSE 0 END AS ecog, CASE WHEN gender IN ('Male', 'Female') THEN gender ELSE 'Female' END AS gender
    FROM clinical""", ["clinical"])
def cond_collapse_levels(spark, d):
    return v.clinical(spark, d).select(
        "ptid", recode.collapse_levels(F.col("region"), ["AMERICA", "EUROPE", "ASIA"], "Other/Unknown").alias("region"),
        recode.cap_ordinal(F.col("ecog"), 2).alias("ecog"), recode.collapse_levels(F.col("gender"), ["Male", "Female"], "Female").alias("gender"),
    )


@query("cond_greatest_least", """
    SELECT ptid, greatest(dx_date, prior_date) AS latest, least(dx_date, prior_date) AS earliest FROM cohort""", ["cohort"])
def cond_greatest_least(spark, d):
    return v.cohort(spark, d).select("ptid", F.greatest("dx_date", "prior_date").alias("latest"), F.least("dx_date", "prior_date").alias("earliest"))


@query("math_log_exp_sqrt", """
    SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 6) AS ln_q, round(exp(-l_discount), 6) AS exp_d, round(sqrt(l_quantity), 6) AS sqrt_q,
           round(l_tax * l_tax, 6) AS tax_2, round(abs(l_discount - 0.05), 6) AS dev, CAST(ceil(l_quantity * 0.02) AS BIGINT) AS ceil_q FROM lineitem""")
def math_log_exp_sqrt(spark, d):
    q, di = F.col("l_quantity"), F.col("l_discount")
    return v.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").select(
        "l_orderkey", "l_linenumber", F.round(F.ln(q), 6).alias("ln_q"), F.round(F.exp(-di), 6).alias("exp_d"), F.round(F.sqrt(q), 6).alias("sqrt_q"),
        F.round(F.pow("l_tax", F.lit(2)), 6).alias("tax_2"), F.round(F.abs(di - 0.05), 6).alias("dev"), F.ceil(q * 0.02).alias("ceil_q"),
    )


@query("math_normal_cdf", f"""
    WITH x AS (SELECT l_suppkey, (avg(l_discount) - 0.05) / (stddev_samp(l_discount) / sqrt(count(*))) AS z FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round(z, 6) AS z, round(0.5 + sign(z) * {sqlmath.half_normal('z')}, 6) AS cdf, round(1 - 2 * {sqlmath.half_normal('z')}, 6) AS p,
           1.959964::DOUBLE AS z975 FROM x""")
def math_normal_cdf(spark, d):
    lines = v.table(spark, d, "lineitem", "l_suppkey", "l_discount").groupBy("l_suppkey").agg(
        ((F.avg("l_discount") - 0.05) / (F.stddev_samp("l_discount") / F.sqrt(F.count(F.lit(1))))).alias("z")
    )
    return lines.select(
        "l_suppkey", F.round("z", 6).alias("z"), F.round(normal.normal_cdf("z"), 6).alias("cdf"), F.round(normal.two_sided_p("z"), 6).alias("p"),
        F.lit(round(normal.normal_quantile(0.975), 6)).alias("z975"),
    )


# ---- maps and arrays -------------------------------------------------------------------------------


@query("map_lookup_default", """
    SELECT i.ptid, coalesce(sum(CASE WHEN h.name = 'click' THEN 1 END), 0)::BIGINT AS clicks, 0::BIGINT AS never_seen,
           coalesce(sum(CASE WHEN h.name = 'view' AND h.value > 30 THEN 1 END), 0)::BIGINT AS big_views
    FROM (SELECT DISTINCT c_custkey AS ptid FROM customer) i LEFT JOIN history h ON i.ptid = h.ptid GROUP BY i.ptid""", ["history"])
def map_lookup_default(spark, d):
    h = v.history(spark, d).withColumn("key", F.when((F.col("name") == "view") & (F.col("value") > 30), "big view").otherwise(F.col("name")))
    counts = h.groupBy("ptid", "key").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("ptid").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("seen"))  # one entry per name
    patients = v.table(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("ptid"))

    def lookup(name):
        return F.coalesce(F.try_element_at("seen", F.lit(name)), F.lit(0)).cast("long")

    return patients.join(maps, "ptid", "left").select(
        "ptid", lookup("click").alias("clicks"), lookup("nothing").alias("never_seen"), lookup("big view").alias("big_views")
    )


@query("array_scan_range", """
    SELECT i.ptid, h.name, count(DISTINCT CASE WHEN h.date BETWEEN i.index_date - 7 AND i.index_date THEN h.date END) AS n_days,
           min(CASE WHEN h.date BETWEEN i.index_date - 7 AND i.index_date THEN h.date END) AS first_day
    FROM index_rows i JOIN history h ON i.ptid = h.ptid GROUP BY 1, 2""", ["history", "index_rows"])
def array_scan_range(spark, d):
    # days of one patient and name: bounded by the calendar, not by the number of events
    nested = v.history(spark, d).groupBy("ptid", "name").agg(F.sort_array(F.collect_set("date")).alias("days"))
    inside = F.filter("days", lambda x: x.between(F.date_sub("index_date", v.LOOKBACK_DAYS), F.col("index_date")))
    return v.index_rows(spark, d).join(nested, "ptid").select(
        "ptid", "name", F.size(inside).cast("long").alias("n_days"), F.get(inside, F.lit(0)).alias("first_day")
    )


@query("set_collect_sites", """
    SELECT ptid, string_agg(name, ',' ORDER BY name) AS sites, count(*) AS n_sites, CAST(max(CASE WHEN name = 'error' THEN 1 ELSE 0 END) AS INTEGER) AS has_error
    FROM (SELECT DISTINCT ptid, name FROM history) GROUP BY ptid""", ["history"])
def set_collect_sites(spark, d):
    sets = v.history(spark, d).groupBy("ptid").agg(F.sort_array(F.collect_set("name")).alias("s"))  # five types
    return sets.select("ptid", F.array_join("s", ",").alias("sites"), F.size("s").cast("long").alias("n_sites"), F.array_contains("s", "error").cast("int").alias("has_error"))
