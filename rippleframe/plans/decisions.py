"""Triage, alerts, privacy gates and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.functions import scoring as sc
from rippleframe.functions import triage as tr
from rippleframe.operators import rules
from rippleframe.operators import sequence as seqs
from rippleframe.plans.registry import Tables, epoch_us, query, r6
from rippleframe.plans.windows import node_sequence
from rippleframe.sources import privacy_frames as pf

# Survivors: one per customer, vitals derived from the account.
SURVIVOR = """sv AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE floor(abs(c_acctbal) / 250) END AS br,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE floor(abs(c_acctbal) / 60) END AS hr,
  CASE c_custkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'tremor' WHEN 2 THEN 'fine' WHEN 3 THEN 'gross' WHEN 4 THEN 'walking' END AS mv,
  c_custkey % 11 = 3 AS vol, (c_custkey % 97) / 97.0 AS conf, CASE WHEN c_custkey % 13 = 0 THEN 'agonal' ELSE 'normal' END AS pat, c_mktsegment AS zone FROM customer),
ct AS (SELECT *, CASE WHEN vol THEN 'responsive' WHEN mv IS NULL THEN 'unknown' WHEN mv = 'none' THEN 'none' WHEN mv = 'tremor' THEN 'involuntary'
  WHEN mv = 'fine' THEN 'minimal' WHEN mv = 'gross' THEN 'moving' ELSE 'responsive' END AS cat FROM sv),
st AS (SELECT *, CASE WHEN conf < 0.35 THEN 'unknown' WHEN br IS NULL AND hr IS NULL AND mv IS NULL THEN 'unknown'
  WHEN cat = 'none' AND br <= 0 AND (hr IS NULL OR hr <= 0) THEN 'deceased' WHEN pat = 'agonal' THEN 'immediate'
  WHEN br <= 0 OR br < 10 OR br > 30 THEN 'immediate' WHEN hr <= 0 OR hr < 40 OR hr > 130 THEN 'immediate' WHEN cat = 'none' AND br IS NOT NULL THEN 'immediate'
  WHEN cat = 'involuntary' THEN 'immediate' WHEN cat = 'responsive' THEN 'minor' WHEN cat IN ('moving', 'minimal') THEN 'delayed'
  WHEN br IS NOT NULL OR hr IS NOT NULL THEN 'delayed' ELSE 'unknown' END AS status FROM ct)"""


def _survivors(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    k = F.col("c_custkey")
    rate = lambda d: F.floor(F.abs("c_acctbal") / d).cast("double")
    words = F.when(k % 6 == 0, "none").when(k % 6 == 1, "tremor").when(k % 6 == 2, "fine").when(k % 6 == 3, "gross").when(k % 6 == 4, "walking")
    rows = c.select(
        k.alias("id"), F.when(k % 7 != 0, rate(250)).alias("br"), F.when(k % 5 != 0, rate(60)).alias("hr"), words.alias("mv"),
        (k % 11 == 3).alias("vol"), ((k % 97) / 97.0).alias("conf"), F.when(k % 13 == 0, "agonal").otherwise("normal").alias("pat"), F.col("c_mktsegment").alias("zone"),
    )
    rows = rows.withColumn("cat", tr.movement_category(F.col("mv"), F.col("vol")))
    args = [F.col(x) for x in ("br", "hr", "mv", "cat", "conf", "pat")]
    return rows.withColumn("status", tr.status(*args)).withColumn("reason", tr.reason(*args))


@query(
    f"""WITH {SURVIVOR} SELECT id, status, CASE status WHEN 'immediate' THEN 1 WHEN 'delayed' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END AS priority,
  round(conf, 6) AS confidence, CASE WHEN conf >= 0.35 AND NOT (br IS NULL AND hr IS NULL AND mv IS NULL) AND NOT coalesce(cat = 'none' AND br <= 0 AND (hr IS NULL OR hr <= 0), false)
    AND pat <> 'agonal' AND br > 0 AND br < 10 THEN 'respiration ' || printf('%.1f', br) || ' BPM below START lower bound' END AS low_breathing FROM st"""
)
def triage_batch(spark, sf_dir):
    """Status of every survivor, in order of priority, confidence and id."""
    s = _survivors(spark, sf_dir)
    out = s.select(
        "id", "status", tr.priority(F.col("status")).alias("priority"), r6("conf").alias("confidence"),
        F.when(F.col("reason").contains("lower bound"), F.col("reason")).alias("low_breathing"),
    )
    return out.orderBy("priority", F.desc("confidence"), "id")


@query(
    f"""WITH {SURVIVOR} SELECT id AS survivor_id, upper(status) || ' survivor detected - ' || zone AS title, CASE status WHEN 'immediate' THEN 1 WHEN 'delayed' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END AS priority,
  CASE status WHEN 'immediate' THEN 'Immediate rescue required. Prioritize extraction and prepare airway/critical-care support.'
  ELSE 'Rescue team required. Mark location and monitor for deterioration while immediate cases are handled.' END AS action FROM st WHERE status IN ('immediate', 'delayed') AND conf >= 0.5"""
)
def alert_generate(spark, sf_dir):
    """Alerts for the sure immediate and delayed cases."""
    s = _survivors(spark, sf_dir).filter(F.col("status").isin("immediate", "delayed") & (F.col("conf") >= 0.5))
    return s.select(
        F.col("id").alias("survivor_id"), F.concat(F.upper("status"), F.lit(" survivor detected - "), F.col("zone")).alias("title"),
        tr.priority(F.col("status")).alias("priority"), tr.lookup(F.col("status"), tr.ACTIONS).alias("action"),
    )


@query(
    """WITH a AS (SELECT o_orderkey AS alert_id, left(o_orderpriority, 1)::INT AS p, o_orderstatus AS s, epoch_us(o_orderdate) // 1000000 AS t0 FROM orders)
SELECT alert_id, CASE WHEN now - t0 >= 86400 * 700 THEN greatest(p - 1, 1) ELSE p END AS priority, now - t0 >= 86400 * 700 AS escalated
FROM a, (SELECT max(t0) AS now FROM a) WHERE s <> 'F'"""
)
def alert_escalation(spark, sf_dir):
    """Open alerts as of the latest order, escalated after 700 days."""
    o = Tables(spark, sf_dir).orders
    a = o.filter(F.col("o_orderstatus") != "F").select(
        F.col("o_orderkey").alias("alert_id"), F.substr("o_orderpriority", F.lit(1), F.lit(1)).cast("int").alias("p"),
        F.floor(epoch_us("o_orderdate") / 1_000_000).alias("at"),
    )
    now = o.agg(F.floor(F.max(epoch_us("o_orderdate")) / 1_000_000).alias("now")).scalar()
    a = a.withColumn("escalated", now - F.col("at") >= 86_400 * 700)
    return a.select("alert_id", F.when(F.col("escalated"), tr.escalated(F.col("p"))).otherwise(F.col("p")).alias("priority"), "escalated")


@query(
    """SELECT left(o_orderpriority, 1)::INT AS priority, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus <> 'F') AS open,
  min(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END) AS first_open FROM orders GROUP BY 1"""
)
def alerts_by_priority(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    level = F.substr("o_orderpriority", F.lit(1), F.lit(1)).cast("int")
    is_open = F.col("o_orderstatus") != "F"
    return o.groupBy(level.alias("priority")).agg(
        F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count_if(is_open).alias("open"),
        F.min(F.when(is_open, F.col("o_orderkey"))).alias("first_open"),
    )


@query(f"""WITH {SURVIVOR} SELECT zone, status, count(*) AS n, round(avg(conf), 6) AS confidence FROM st GROUP BY zone, status""")
def status_counts(spark, sf_dir):
    s = _survivors(spark, sf_dir)
    return s.groupBy("zone", "status").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("conf")).alias("confidence"))


CONDITION = """cd AS (SELECT *, CASE WHEN br IS NOT NULL AND pat IN ('agonal', 'apnea') THEN 'immediate' WHEN br < 10 OR br > 30 THEN 'immediate'
  WHEN br IS NOT NULL AND NOT br BETWEEN 12 AND 24 THEN CASE WHEN mv <> 'none' THEN 'delayed' ELSE 'immediate' END
  WHEN br IS NOT NULL THEN CASE WHEN mv <> 'none' THEN 'minor' ELSE 'delayed' END WHEN mv <> 'none' OR hr IS NOT NULL THEN 'immediate' ELSE 'deceased' END AS condition FROM st)"""


@query(
    f"""WITH {SURVIVOR}, {CONDITION} SELECT zone, count(*) FILTER (condition = 'immediate') AS immediate, count(*) FILTER (condition = 'delayed') AS delayed,
  count(*) FILTER (condition = 'minor') AS minor, count(*) FILTER (condition = 'deceased') AS deceased FROM cd GROUP BY zone"""
)
def condition_pivot(spark, sf_dir):
    moving = F.coalesce(F.col("mv") != "none", F.lit(False))
    s = _survivors(spark, sf_dir).withColumn("condition", tr.condition(F.col("br"), F.col("pat"), moving, F.col("hr").isNotNull()))
    kinds = ["immediate", "delayed", "minor", "deceased"]
    out = s.groupBy("zone").pivot("condition", kinds).agg(F.count(F.lit(1)))
    return out.select("zone", *[F.coalesce(k, F.lit(0)).cast("bigint").alias(k) for k in kinds])


@query(
    f"""WITH {SURVIVOR}, p AS (SELECT id, zone, CASE WHEN br IS NOT NULL THEN conf END AS b, CASE WHEN hr IS NOT NULL THEN conf / 2 END AS h, CASE WHEN mv <> 'none' THEN 0.7 END AS m FROM sv)
SELECT id, round(coalesce((coalesce(b * 1.5, 0) + coalesce(h, 0) + coalesce(m, 0)) / nullif(CASE WHEN b IS NULL THEN 0 ELSE 1.5 END + (h IS NOT NULL)::INT + (m IS NOT NULL)::INT, 0), 0), 6) AS confidence,
  round(0.5 * coalesce(b, 0) + 0.3 * coalesce(h, 0) + 0.2 * coalesce(m, 0), 6) AS ensemble FROM p"""
)
def vitals_confidence(spark, sf_dir):
    """Reading confidence over present signals, and the detector ensemble .5/.3/.2."""
    s = _survivors(spark, sf_dir)
    b, h = F.when(F.col("br").isNotNull(), F.col("conf")), F.when(F.col("hr").isNotNull(), F.col("conf") / 2)
    m = F.when(F.col("mv") != "none", F.lit(0.7))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return s.select("id", r6(tr.vitals_confidence(b, h, m)).alias("confidence"), r6(0.5 * z(b) + 0.3 * z(h) + 0.2 * z(m)).alias("ensemble"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(1, l_quantity / 47) * (1 - l_discount) * (1 - l_tax) AS risk FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(risk, 6) AS risk,
  CASE WHEN risk >= 0.9 THEN 'recalibrate' WHEN risk >= 0.7 THEN 'reject' WHEN risk >= 0.5 THEN 'predict_only' ELSE 'accept' END AS action FROM r"""
)
def identity_risk(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    risk = sc.identity_risk(F.col("l_quantity") / 47, 1 - F.col("l_discount"), 1 - F.col("l_tax"))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", risk.alias("risk"))
    return rows.withColumn("action", sc.identity_gate(F.col("risk"))).withColumn("risk", r6("risk"))


_RULES = [
    rules.Rule("hot", [{"above": 100.0}], [{"not": [{"state": "error"}]}]),
    rules.Rule("returned", [{"state": "purchase", "from": "view"}]),
    rules.Rule("first_signup", [{"event": "signup"}], [{"or": [{"below": 20.0}, {"and": [{"above": 50.0}, {"template": "yes"}]}]}], ignore_first=True),
    rules.Rule("timed", [{"time": "08:00"}]),
    rules.Rule("off", [{"event": "click"}], enabled=False),
]


@query(
    """WITH o AS (SELECT event_id, ts, event_type AS t, value AS v, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events),
f AS (SELECT min((ts, event_id)) AS k FROM events WHERE event_type = 'signup')
SELECT event_id, 'hot' AS rule_id FROM o WHERE v > 100 AND t <> 'error'
UNION ALL SELECT event_id, 'returned' FROM o WHERE t = 'purchase' AND coalesce(old, 'unavailable') = 'view'
UNION ALL SELECT event_id, 'first_signup' FROM o WHERE t = 'signup' AND (v < 20 OR v > 50) AND (ts, event_id) <> (SELECT k FROM f)"""
)
def rule_engine(spark, sf_dir):
    """State, numeric, event and time triggers with condition trees and ignore-first."""
    seq = node_sequence(spark, sf_dir, "event_type", "value", "us")
    seq = seqs.framed(seq, ["user_id"], {"old": lambda w: F.lag("event_type").over(w)}, before=1)
    out = rules.evaluate(seq, _RULES, "event_type", "old", "value", "event_type", ["us", "event_id"])
    return out.select("event_id", "rule_id")


@query(
    """WITH m AS (SELECT * FROM (VALUES ('BUILDING', 'RawResearch', 1, 0), ('MACHINERY', 'PrivateHome', 10, 2), ('HOUSEHOLD', 'EnterpriseAnonymous', 26, 2),
  ('AUTOMOBILE', 'CareWithConsent', 1, 1), ('FURNITURE', 'StrictNoIdentity', 30, 3)) t(seg, mode, bits, cls))
SELECT c_custkey, mode, bits AS action_bits, cls AS class, (bits & 2) <> 0 AS suppress_identity, least(cls + (c_custkey % 2), 3)::INT AS effective_class FROM customer JOIN m ON seg = c_mktsegment"""
)
def privacy_modes(spark, sf_dir):
    """Action bits, class and suppression of each site's mode; uncalibrated sites one class stricter."""
    segments = dict(zip(["BUILDING", "MACHINERY", "HOUSEHOLD", "AUTOMOBILE", "FURNITURE"], pf.MODE_BITS))
    c = Tables(spark, sf_dir).customer.select("c_custkey", tr.lookup(F.col("c_mktsegment"), segments).alias("mode")).filter("mode IS NOT NULL")
    bits, cls = tr.lookup(F.col("mode"), pf.MODE_BITS), tr.lookup(F.col("mode"), pf.MODE_CLASS)
    return c.select(
        "c_custkey", "mode", bits.alias("action_bits"), cls.alias("class"), (bits.bitwiseAND(pf.SUPPRESS) != 0).alias("suppress_identity"),
        F.when(F.col("c_custkey") % 2 == 1, pf.demote_class(cls)).otherwise(cls).alias("effective_class"),
    )
