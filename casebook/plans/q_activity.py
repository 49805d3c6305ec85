"""Driver queries for timing, timelines and customer breakdowns.

Events stand in for operations (category = event_type, duration = value
seconds) and for incident timelines (incident = user_id, team/stage =
event_type)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity as A
from ..session import read_table
from . import sqltext as S
from .registry import register

AS_OF = "2024-02-01"


def ops(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    start = A.epoch_seconds_of(e, "ts")
    return e.select(F.col("event_id").alias("operation_id"), F.col("event_type").alias("category"),
                    F.col("value").alias("duration"), start.alias("start_time"),
                    (start + F.col("value")).alias("end_time"), "user_id", "ts")


@register("timing_by_category", """
SELECT event_type AS category, round(sum(value), 6) AS total_time, count(*) AS operation_count,
       round(avg(value), 6) AS average_time FROM events GROUP BY event_type
""")
def q_timing_by_category(spark, sf_dir):
    t = A.timing_by_category(ops(spark, sf_dir))
    return t.select("category", F.round("total_time", 6).alias("total_time"), "operation_count",
                    F.round("average_time", 6).alias("average_time"))


@register("timing_totals", """
SELECT count(*) AS operation_count, round(sum(value), 6) AS total_operations_time,
       round(max(epoch_us(ts) / 1000000.0 + value) - min(epoch_us(ts) / 1000000.0), 6) AS total_workflow_duration
FROM events
""")
def q_timing_totals(spark, sf_dir):
    t = A.timing_totals(ops(spark, sf_dir))
    return t.select("operation_count", F.round("total_operations_time", 6).alias("total_operations_time"),
                    F.round("total_workflow_duration", 6).alias("total_workflow_duration"))


@register("slowest_ops", """
SELECT event_id AS operation_id, event_type AS category, value AS duration FROM events
ORDER BY value DESC, event_id LIMIT 10
""")
def q_slowest_ops(spark, sf_dir):
    """The ten slowest operations (the limit is the report)."""
    return A.slowest(ops(spark, sf_dir)).select("operation_id", "category", "duration")


@register("slowest_per_category", """
SELECT operation_id, category, duration, CAST(rank AS INTEGER) AS rank FROM (
  SELECT event_id AS operation_id, event_type AS category, value AS duration,
         row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3
""")
def q_slowest_per_category(spark, sf_dir):
    return A.slowest_per_category(ops(spark, sf_dir), 3).select("operation_id", "category", "duration", "rank")


def gaps(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return A.gap_to_next(e, "user_id", "ts", "event_id")


GAPS_SQL = """SELECT event_id, user_id, event_type, ts, value,
  lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 1000000.0 - epoch_us(ts) / 1000000.0 AS gap_seconds
FROM events"""


@register("gap_to_next", f"SELECT event_id, user_id, round(gap_seconds, 6) AS gap_seconds FROM ({GAPS_SQL})")
def q_gap_to_next(spark, sf_dir):
    """Seconds to the next entry of the same incident (two-level lead)."""
    return gaps(spark, sf_dir).select("event_id", "user_id", F.round("gap_seconds", 6).alias("gap_seconds"))


@register("wait_time_by_team", f"""
SELECT event_type AS team, count(*) AS waits, round(avg(gap_seconds), 6) AS avg_wait_seconds,
       round(max(gap_seconds), 6) AS max_wait_seconds FROM ({GAPS_SQL}) WHERE gap_seconds IS NOT NULL GROUP BY event_type
""")
def q_wait_time_by_team(spark, sf_dir):
    """Waiting time until the next action per team."""
    w = A.wait_time_by_team(gaps(spark, sf_dir).withColumnRenamed("event_type", "team"), "team")
    return w.select("team", "waits", F.round("avg_wait_seconds", 6).alias("avg_wait_seconds"),
                    F.round("max_wait_seconds", 6).alias("max_wait_seconds"))


@register("stage_duration", f"""
SELECT user_id, event_type AS stage, round(sum(gap_seconds), 6) AS stage_seconds, count(*) AS entries
FROM ({GAPS_SQL}) WHERE gap_seconds IS NOT NULL GROUP BY user_id, event_type
""")
def q_stage_duration(spark, sf_dir):
    """Time spent per incident and stage."""
    s = A.stage_durations(gaps(spark, sf_dir), "user_id", "event_type")
    return s.select("user_id", F.col("event_type").alias("stage"), F.round("stage_seconds", 6).alias("stage_seconds"),
                    "entries")


@register("resolution_delay", f"""
SELECT user_id, round(max(gap_seconds), 6) AS longest_gap_seconds,
       arg_max(event_type, (gap_seconds, -event_id)) AS delayed_stage
FROM ({GAPS_SQL}) WHERE gap_seconds IS NOT NULL GROUP BY user_id
""")
def q_resolution_delay(spark, sf_dir):
    """Longest gap per incident and the stage it followed."""
    r = A.resolution_delay(gaps(spark, sf_dir), "user_id", "event_type", "event_id")
    return r.select("user_id", F.round("longest_gap_seconds", 6).alias("longest_gap_seconds"), "delayed_stage")


@register("ownership_change", """
SELECT event_id, user_id, from_team, to_team, 'reassignment' AS change_type FROM (
  SELECT event_id, user_id, event_type AS to_team,
         lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_team FROM events)
WHERE from_team IS NOT NULL AND from_team <> to_team
""")
def q_ownership_change(spark, sf_dir):
    """Team hand-overs per incident (two-level lag)."""
    e = read_table(spark, sf_dir, "events")
    o = A.ownership_changes(e, "user_id", "ts", "event_id", "event_type")
    return o.select("event_id", "user_id", "from_team", "to_team", "change_type")


@register("active_days", f"""
SELECT user_id, CAST(datediff('day', min(ts)::DATE, DATE '{AS_OF}') AS INTEGER) AS active_days FROM events GROUP BY user_id
""")
def q_active_days(spark, sf_dir):
    """Days since each incident's first entry, as of a fixed date."""
    e = read_table(spark, sf_dir, "events")
    return A.active_days(e, "user_id", "ts", F.to_date(F.lit(AS_OF)))


@register("team_interactions", """
SELECT event_type AS team, CASE WHEN value > 50 THEN 'escalation' ELSE 'consultation' END AS interaction_type,
       count(*) AS frequency, count(DISTINCT user_id) AS incidents FROM events GROUP BY ALL
""")
def q_team_interactions(spark, sf_dir):
    """Interaction frequency per team and type."""
    e = read_table(spark, sf_dir, "events")
    kind = F.when(F.col("value") > 50, F.lit("escalation")).otherwise(F.lit("consultation"))
    t = A.team_interactions(e, "user_id", "event_type", kind)
    return t.select(F.col("event_type").alias("team"), "interaction_type", "frequency", "incidents")


@register("vip_breakdown", """
SELECT c_name AS customer, o_orderstatus AS status, o_orderpriority AS severity, count(*) AS incidents,
       CAST(GROUPING(c_name, o_orderstatus, o_orderpriority) AS BIGINT) AS gid
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY GROUPING SETS ((c_name), (o_orderstatus), (o_orderpriority), ())
""")
def q_vip_breakdown(spark, sf_dir):
    """Incident counts by customer, status and severity."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_name").alias("customer"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("severity"))
    return A.vip_breakdown(j, "customer", "status", "severity").select(
        "customer", "status", "severity", "incidents", F.col("gid").cast("long").alias("gid"))


@register("vip_scan", f"""
WITH aliases AS (SELECT '  ' || upper(c_name) || ' ' AS alias FROM customer WHERE c_acctbal > 9000),
chosen AS (SELECT c_custkey FROM customer WHERE regexp_replace(lower(trim(c_name)), '\\s+', ' ', 'g')
             IN (SELECT regexp_replace(lower(trim(alias)), '\\s+', ' ', 'g') FROM aliases)
           UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_nationkey = 0)
SELECT o_custkey, count(*) AS incidents, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open_incidents
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM chosen) GROUP BY o_custkey
""")
def q_vip_scan(spark, sf_dir):
    """Incidents of chosen customers by spelling-variant name or by id."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    names = c.filter(F.col("c_acctbal") > 9000).select(
        F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("alias"), F.lit(None).cast("long").alias("tenant_id"))
    ids = c.filter((F.col("c_mktsegment") == "AUTOMOBILE") & (F.col("c_nationkey") == 0)).select(
        F.lit(None).cast("string").alias("alias"), F.col("c_custkey").alias("tenant_id"))
    v = A.vip_scan(o, c, names.unionByName(ids))
    return v.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("incidents"),
                                      F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).cast("long")
                                      .alias("open_incidents"))


@register("team_collaboration", """
WITH p AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT a.event_type AS team_a, b.event_type AS team_b, count(*) AS incidents
FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL
""")
def q_team_collaboration(spark, sf_dir):
    """Incidents shared by each pair of teams."""
    e = read_table(spark, sf_dir, "events")
    return A.team_collaboration(e, "user_id", "event_type").filter(F.col("incidents") > 0)


@register("teams_per_incident", """
SELECT user_id, count(DISTINCT event_type) AS teams FROM events GROUP BY user_id
""")
def q_teams_per_incident(spark, sf_dir):
    """Distinct teams per incident."""
    return A.teams_per_incident(read_table(spark, sf_dir, "events"), "user_id", "event_type")


@register("active_days_summary", f"""
SELECT count(*) AS incidents, round(avg(d), 6) AS mean_active_days, max(d) AS longest_active_days FROM (
  SELECT CAST(datediff('day', min(ts)::DATE, DATE '{AS_OF}') AS INTEGER) AS d FROM events GROUP BY user_id)
""")
def q_active_days_summary(spark, sf_dir):
    """Mean and longest active days across incidents."""
    d = A.active_days(read_table(spark, sf_dir, "events"), "user_id", "ts", F.to_date(F.lit(AS_OF)))
    return d.agg(F.count(F.lit(1)).alias("incidents"), F.round(F.avg("active_days"), 6).alias("mean_active_days"),
                 F.max("active_days").alias("longest_active_days"))
