"""Cohorts, arms, control draws, outcomes, trial tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialkit.plans import cohort as ch
from trialkit.plans import outcomes
from trialkit.registry import views as v
from trialkit.registry.base import query
from trialkit.session import cut

MIN_TREATED = 100
N_BOOT = 100


@query("cohort_dual_therapy", "SELECT ptid, dx_date, prior_date, combined_therapy, combined_therapy_date FROM dual", ["dual"])
def cohort_dual_therapy(spark, d):
    return v.dual(spark, d)


USERS_SQL = """
    spans AS (SELECT r.drug, r.ptid, t.therapy_date,
        min(CASE WHEN r.rx_date >= t.therapy_date AND datediff('day', t.therapy_date, r.rx_date) <= 90 THEN r.rx_date END) AS index_date,
        max(CASE WHEN r.rx_date >= t.therapy_date AND datediff('day', t.therapy_date, r.rx_date) <= 90 THEN r.rx_date END) AS last_date,
        max(CASE WHEN r.rx_date < t.therapy_date THEN r.rx_date END) AS history_date
        FROM records r JOIN therapy t ON r.ptid = t.ptid GROUP BY 1, 2, 3),
    users AS (SELECT drug, ptid, therapy_date, index_date, datediff('day', therapy_date, index_date) AS delta_days,
        CASE WHEN last_date > index_date AND (history_date IS NULL OR datediff('day', history_date, index_date) > 90) THEN 1 ELSE 0 END AS treated
        FROM spans WHERE index_date IS NOT NULL),
    arm AS (SELECT drug, ptid, therapy_date, index_date, delta_days FROM users WHERE treated = 1)"""
_SV = ["records", "therapy"]


@query("arm_new_user", f"WITH {USERS_SQL} SELECT drug, ptid, therapy_date, index_date, delta_days, treated FROM users", _SV)
def arm_new_user(spark, d):
    return ch.drug_users(cut(v.therapy(spark, d)), v.records(spark, d))


@query("select_candidate_drugs", f"""
    WITH {USERS_SQL},
    seen AS (SELECT r.drug, count(*) AS n_records FROM records r JOIN therapy t ON r.ptid = t.ptid
             WHERE r.rx_date >= t.therapy_date AND datediff('day', t.therapy_date, r.rx_date) <= 90 GROUP BY 1 HAVING count(*) > 100)
    SELECT s.drug, s.n_records, CAST(sum(u.treated) AS BIGINT) AS n_treated FROM seen s JOIN users u ON s.drug = u.drug
    WHERE lower(s.drug) NOT IN ('promo') GROUP BY 1, 2 HAVING sum(u.treated) > 100""", _SV)
def select_candidate_drugs(spark, d):
    from trialkit.operators.joins import on_or_after

    therapy, records = cut(v.therapy(spark, d)), v.records(spark, d)
    in_window = on_or_after(records, therapy.select("ptid", "therapy_date"), "ptid", "rx_date", "therapy_date", 90)
    excluded = v.table(spark, d, "part", "p_type").where("p_type = 'PROMO'").select(F.initcap("p_type").alias("name")).distinct()
    return ch.candidate_drugs(in_window, ch.drug_users(therapy, records), excluded, "name", 100, MIN_TREATED)


DRAWS_SQL = f"""
    members AS (SELECT ptid, therapy_date, row_number() OVER (ORDER BY {v.h32('ptid')}, ptid) - 1 AS member FROM therapy),
    numbered AS (SELECT a.*, row_number() OVER (PARTITION BY drug ORDER BY {v.h32('a.ptid')}, a.ptid) - 1 AS t_pos,
        count(*) OVER (PARTITION BY drug) AS n_treated, (SELECT count(*) FROM therapy) - count(*) OVER (PARTITION BY drug) AS n_control,
        m.member FROM arm a JOIN members m ON a.ptid = m.ptid),
    holes AS (SELECT drug, member AS control, row_number() OVER (PARTITION BY drug ORDER BY {v.h32('member')}, member) - 1 AS k
        FROM numbered WHERE member < n_control),
    fillers AS (SELECT f.drug, f.member, row_number() OVER (PARTITION BY f.drug ORDER BY {v.h32('f.member')}, f.member) - 1 AS k
        FROM (SELECT drug, n_control + t_pos AS member FROM numbered) f
        WHERE NOT EXISTS (SELECT 1 FROM numbered n WHERE n.drug = f.drug AND n.member = f.member)),
    swaps AS (SELECT h.drug, h.control, f.member AS swap FROM holes h JOIN fillers f ON h.drug = f.drug AND h.k = f.k),
    slots AS (SELECT drug, b.boot_id, t_pos * 5 + j.j AS rep, n_treated, n_control FROM numbered,
        (SELECT unnest(range({N_BOOT})) AS boot_id) b, (SELECT unnest(range(5)) AS j) j),
    drawn AS (SELECT drug, boot_id, rep, {v.h32("'control'", "'0'", 'drug', 'boot_id', 'rep')} % n_control AS control,
        {v.h32("'offset'", "'0'", 'drug', 'boot_id', 'rep')} % n_treated AS t_pos FROM slots),
    draws AS (SELECT d.drug, CAST(d.boot_id AS INTEGER) AS boot_id, d.rep, m.ptid, m.therapy_date, n.delta_days,
        m.therapy_date + CAST(n.delta_days AS INTEGER) AS index_date
        FROM drawn d LEFT JOIN swaps s ON d.drug = s.drug AND d.control = s.control
        JOIN members m ON m.member = coalesce(s.swap, d.control) JOIN numbered n ON n.drug = d.drug AND n.t_pos = d.t_pos)"""


def _draws(spark, d, n_boot=N_BOOT):
    therapy = cut(v.therapy(spark, d))
    treated = cut(ch.new_users(therapy, v.records(spark, d)))
    return therapy, treated, ch.control_draws(treated, therapy, n_boot)


@query("bootstrap_controls", f"WITH {USERS_SQL}, {DRAWS_SQL} SELECT drug, boot_id, rep, ptid, therapy_date FROM draws", _SV)
def bootstrap_controls(spark, d):
    return _draws(spark, d)[2].select("drug", "boot_id", "rep", "ptid", "therapy_date")


@query("index_date_transplant", f"WITH {USERS_SQL}, {DRAWS_SQL} SELECT drug, boot_id, rep, ptid, delta_days, index_date FROM draws", _SV)
def index_date_transplant(spark, d):
    return _draws(spark, d)[2].select("drug", "boot_id", "rep", "ptid", "delta_days", "index_date")


# ---- outcomes --------------------------------------------------------------------------------------


@query("agg_last_activity", f"""
    WITH p AS (SELECT d.ptid, d.unvalidated_dod, d.last_act_dt, t.dx_date, t.therapy_date FROM death d JOIN therapy t ON d.ptid = t.ptid),
    e AS (SELECT ptid, order_day AS date FROM ord WHERE status = 'F' UNION ALL SELECT ptid, order_day FROM ord WHERE status <> 'F'
          UNION ALL SELECT ptid, ship_day FROM rx WHERE line = 1 UNION ALL SELECT ptid, ship_day FROM rx WHERE line > 1)
    SELECT p.ptid, p.unvalidated_dod, p.dx_date, p.therapy_date, greatest(p.last_act_dt, p.dx_date, p.therapy_date, max(e.date)) AS last_act_dt
    FROM p LEFT JOIN e ON p.ptid = e.ptid AND e.date >= p.dx_date AND e.date >= p.therapy_date GROUP BY p.ptid, p.unvalidated_dod, p.dx_date, p.therapy_date, p.last_act_dt""",
    ["death", "therapy", "rx", "ord"])
def agg_last_activity(spark, d):
    patients = v.death(spark, d).join(v.therapy(spark, d).select("ptid", "dx_date", "therapy_date"), "ptid")
    o = v.orders(spark, d).select("ptid", "status", F.col("order_day").alias("date"))
    ships = v.records(spark, d).where("source = 'adm'").select("ptid", "line", F.col("rx_date").alias("date"))
    events = [o.where("status = 'F'"), o.where("status <> 'F'"), ships.where("line = 1"), ships.where("line > 1")]
    return outcomes.last_activity(patients, events, ["dx_date", "therapy_date"]).select("ptid", "unvalidated_dod", "dx_date", "therapy_date", "last_act_dt")


OUTCOME_SQL = """
    active AS (SELECT d.ptid, d.unvalidated_dod, greatest(d.last_act_dt, t.dx_date, t.therapy_date, max(o.order_day)) AS last_act_dt
        FROM death d JOIN therapy t ON d.ptid = t.ptid LEFT JOIN ord o ON o.ptid = d.ptid AND o.order_day >= t.dx_date AND o.order_day >= t.therapy_date
        GROUP BY d.ptid, d.unvalidated_dod, d.last_act_dt, t.dx_date, t.therapy_date),
    outcome AS (SELECT ptid, unvalidated_dod, last_act_dt,
        CASE WHEN unvalidated_dod IS NOT NULL AND last_act_dt >= unvalidated_dod + 30 THEN NULL ELSE unvalidated_dod END AS available_date,
        CASE WHEN unvalidated_dod IS NULL OR last_act_dt >= unvalidated_dod + 30 THEN 0 ELSE 1 END AS d_flag FROM active)"""
_OV = ["records", "therapy", "death", "ord"]


def outcome_of(spark, d, therapy):
    patients = v.death(spark, d).join(therapy.select("ptid", "dx_date", "therapy_date"), "ptid")
    o = v.orders(spark, d).select("ptid", F.col("order_day").alias("date"))
    return outcomes.validated_death(outcomes.last_activity(patients, [o], ["dx_date", "therapy_date"]))


def outcome(spark, d):
    return outcome_of(spark, d, cut(v.therapy(spark, d)))


@query("death_validation", f"WITH {OUTCOME_SQL} SELECT ptid, unvalidated_dod, last_act_dt, available_date, d_flag FROM outcome", _OV)
def death_validation(spark, d):
    return outcome(spark, d).select("ptid", "unvalidated_dod", "last_act_dt", "available_date", "d_flag")


@query("follow_up_time", f"""
    WITH {OUTCOME_SQL} SELECT o.ptid, o.d_flag, datediff('day', t.therapy_date, CASE WHEN o.d_flag = 1 THEN o.available_date ELSE o.last_act_dt END) AS d_delta_days
    FROM outcome o JOIN therapy t ON o.ptid = t.ptid""", _OV)
def follow_up_time(spark, d):
    days = outcomes.follow_up_days(F.col("therapy_date"), F.col("d_flag"), F.col("available_date"), F.col("last_act_dt"))
    return outcome(spark, d).select("ptid", "d_flag", days.alias("d_delta_days"))


TRIALS_SQL = f"""
    {USERS_SQL}, {DRAWS_SQL}, {OUTCOME_SQL},
    stacked AS (SELECT drug, CAST(b.boot_id AS INTEGER) AS boot_id, ptid, index_date, 0::BIGINT AS rep, 1 AS treatment
            FROM arm, (SELECT unnest(range({N_BOOT})) AS boot_id) b
        UNION ALL SELECT d.drug, d.boot_id, d.ptid, d.index_date, d.rep, 0 FROM draws d
            WHERE NOT EXISTS (SELECT 1 FROM arm a WHERE a.drug = d.drug AND a.ptid = d.ptid)),
    trials AS (SELECT s.*, o.d_flag, datediff('day', s.index_date, CASE WHEN o.d_flag = 1 THEN o.available_date ELSE o.last_act_dt END) AS d_delta_days
        FROM stacked s LEFT JOIN outcome o ON s.ptid = o.ptid)"""


@query("trial_assemble", f"""
    WITH {TRIALS_SQL} SELECT drug, boot_id, ptid, index_date, rep, treatment, d_flag, d_delta_days FROM trials""", _OV)
def trial_assemble(spark, d):
    therapy, treated, draws = _draws(spark, d)
    return outcomes.assemble_trials(treated, draws, cut(outcome_of(spark, d, therapy)), N_BOOT)


@query("trial_subset_stratum", """
    WITH x AS (SELECT c.ptid, CASE c.gender WHEN 'Male' THEN 1 WHEN 'Female' THEN 0 END AS gender,
            2001 - CASE WHEN c.birth_yr = '1935 and Earlier' THEN 1935 ELSE CAST(c.birth_yr AS INTEGER) END AS age, o.total, o.f, o.p
        FROM clinical c JOIN (SELECT ptid, count(DISTINCT status) AS total, max(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS f,
            max(CASE WHEN status = 'P' THEN 1 ELSE 0 END) AS p FROM ord GROUP BY 1) o ON c.ptid = o.ptid)
    SELECT ptid, 'gender_0' AS stratum FROM x WHERE gender = 0 UNION ALL SELECT ptid, 'gender_1' FROM x WHERE gender = 1
    UNION ALL SELECT ptid, 'age_less_65' FROM x WHERE age < 65 UNION ALL SELECT ptid, 'age_large_65' FROM x WHERE age >= 65
    UNION ALL SELECT ptid, 'meta_total_0' FROM x WHERE total = 0 UNION ALL SELECT ptid, 'meta_total_1' FROM x WHERE total = 1
    UNION ALL SELECT ptid, 'meta_total_2' FROM x WHERE total >= 2 UNION ALL SELECT ptid, 'meta_F_1' FROM x WHERE f = 1
    UNION ALL SELECT ptid, 'meta_P_1' FROM x WHERE p = 1""", ["clinical", "ord"])
def trial_subset_stratum(spark, d):
    from trialkit.functions.dates import age_at
    from trialkit.functions.recode import binary_flag

    sites = v.orders(spark, d).groupBy("ptid").agg(
        F.count_distinct("status").alias("meta_total"), *[F.max((F.col("status") == s).cast("int")).alias(f"meta_{s}") for s in ("F", "P")]
    )
    rows = v.clinical(spark, d).join(sites, "ptid").select(
        "ptid", binary_flag(F.col("gender"), "Male", "Female").alias("gender"),
        age_at(F.lit("2001-01-01").cast("date"), F.col("birth_yr")).alias("age_at_index"), "meta_total", "meta_F", "meta_P",
    )
    return outcomes.explode_strata(rows, outcomes.study_strata(("F", "P"))).select("ptid", "stratum")


_SAE = "', '".join(v.EVENT_TYPES)


@query("outcome_adverse_event", f"""
    WITH last AS (SELECT ptid, max(date) AS last_act_dt FROM history GROUP BY ptid),
    cls AS (SELECT unnest(['any', '{_SAE}']) AS class),
    f AS (SELECT i.ptid, i.index_date, c.class, min(h.date) AS event_date FROM index_rows i CROSS JOIN cls c
          LEFT JOIN history h ON h.ptid = i.ptid AND h.date > i.index_date AND h.name IN ('{_SAE}') AND (c.class = 'any' OR c.class = h.name) GROUP BY 1, 2, 3),
    g AS (SELECT f.ptid, f.index_date, f.class, event_date IS NOT NULL AS hit, datediff('day', f.index_date, coalesce(event_date, last_act_dt)) AS days
          FROM f JOIN last l ON f.ptid = l.ptid)
    SELECT ptid, index_date, class, CAST(hit AND days <= 3 AS INTEGER) AS sae_flag, least(days, 3) AS sae_delta_days FROM g""", ["history", "index_rows"])
def outcome_adverse_event(spark, d):
    h = v.history(spark, d)
    last = h.groupBy("ptid").agg(F.max("date").alias("last_act_dt"))
    return outcomes.first_event_after(v.index_rows(spark, d), h, v.EVENT_TYPES, last, horizon=3)
