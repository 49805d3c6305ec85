"""Operation timing and incident timelines (A8, A9, O4, A15-A19, W6, W7) and
customer breakdowns (A16, S12).

Per-key sequence steps (time to the next entry, previous owner) are computed
in two levels so a key holding a large share of all rows never lands in one
task: ``lead``/``lag`` run within ``(key, time bucket)``, and the boundary
rows take their neighbour from the first/last row of the adjacent non-empty
bucket (one small row per bucket, windowed per key).  The result is exactly
the per-key ``lead``/``lag``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import range_parts
from .tfidf import top_k


# --------------------------------------------------------------------------- timing
def timing_by_category(ops: DataFrame, category: str = "category", duration: str = "duration") -> DataFrame:
    """Total, count and average duration per category."""
    return ops.groupBy(category).agg(F.sum(duration).alias("total_time"),
                                     F.count(F.lit(1)).alias("operation_count"),
                                     F.avg(duration).alias("average_time"))


def timing_totals(ops: DataFrame, start: str = "start_time", end: str = "end_time",
                  duration: str = "duration") -> DataFrame:
    """Operation count, summed operation time and workflow duration
    (last end minus first start)."""
    return ops.agg(F.count(F.lit(1)).alias("operation_count"),
                   F.sum(duration).alias("total_operations_time"),
                   (F.max(end) - F.min(start)).alias("total_workflow_duration"))


def slowest(ops: DataFrame, n: int = 10, duration: str = "duration", tiebreak: str = "operation_id") -> DataFrame:
    """The ``n`` slowest operations overall (TakeOrderedAndProject: a
    partial top-n per partition, then one merge)."""
    return ops.orderBy(F.desc(duration), F.asc(tiebreak)).limit(n)


def slowest_per_category(ops: DataFrame, n: int, category: str = "category", duration: str = "duration",
                         tiebreak: str = "operation_id") -> DataFrame:
    """The ``n`` slowest operations within each category."""
    return top_k(ops, category, [F.desc(duration), F.asc(tiebreak)], n)


# --------------------------------------------------------------------------- sequences
def neighbour(df: DataFrame, key: str, order_cols, value: Column, bucket: Column | None = None, direction: str = "next",
              out: str = "neighbour") -> DataFrame:
    """Exact per-key ``lead`` (direction='next') or ``lag`` ('prev') of
    ``value`` in ``order_cols`` order, computed in two levels by ``bucket``
    (a monotone coarsening of the first order column).  Without ``bucket`` the
    rows are dealt by range of (key, order), so a key whose rows share one
    bucket, or one time, spreads too."""
    order = [F.col(c) for c in order_cols]
    d = range_parts(df, key, order_cols, "_b") if bucket is None else df.withColumn("_b", bucket)
    d = d.withColumn("_v", value)
    w = Window.partitionBy(key, "_b").orderBy(*order)
    if direction == "next":
        d = d.withColumn("_in", F.lead("_v").over(w))
        edge = F.min(F.struct(*order, F.col("_v").alias("v")))
    else:
        d = d.withColumn("_in", F.lag("_v").over(w))
        edge = F.max(F.struct(*order, F.col("_v").alias("v")))
    edges = d.groupBy(key, "_b").agg(edge["v"].alias("_edge"))
    wb = Window.partitionBy(key).orderBy("_b")
    if direction == "next":
        edges = edges.withColumn("_across", F.lead("_edge").over(wb))
    else:
        edges = edges.withColumn("_across", F.lag("_edge").over(wb))
    j = d.join(edges.select(key, "_b", "_across"), [key, "_b"])
    # the first/last row of a bucket has no in-bucket neighbour
    return j.withColumn(out, F.coalesce(F.col("_in"), F.col("_across"))).drop("_b", "_v", "_in", "_across")


def epoch_seconds(ts: str, dtype: str = "timestamp") -> Column:
    """Seconds since the epoch.  A ``timestamp_ntz`` (wall-clock) column is
    measured from the wall-clock epoch, so the result never depends on the
    session time zone; an instant ``timestamp`` uses its instant."""
    if dtype == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)") / 1_000_000.0
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000.0


def epoch_seconds_of(df: DataFrame, ts: str) -> Column:
    return epoch_seconds(ts, dict(df.dtypes)[ts])


def gap_to_next(events: DataFrame, key: str, ts: str, tiebreak: str, bucket: Column | None = None) -> DataFrame:
    """Seconds from each entry to the next entry of the same key (null
    for the last)."""
    secs = epoch_seconds_of(events, ts)
    n = neighbour(events, key, [ts, tiebreak], secs, bucket, "next", "_next_s")
    return n.withColumn("gap_seconds", F.col("_next_s") - secs).drop("_next_s")


def ownership_changes(events: DataFrame, key: str, ts: str, tiebreak: str, team: str, bucket: Column | None = None,
                      context: Column | None = None, reason: Column | None = None) -> DataFrame:
    """Rows where the owning team differs from the previous entry's team.
    ``context`` (the entry's text) and ``reason`` come from the entry that
    changes hands; two entries of different teams leave no doubt, so the
    confidence is 1."""
    said = events.withColumn("_context", F.coalesce(F.lit("") if context is None else context, F.lit(""))) \
        .withColumn("_reason", F.lit(None).cast("string") if reason is None else reason)
    n = neighbour(said, key, [ts, tiebreak], F.col(team), bucket, "prev", "from_team")
    return (n.filter(F.col("from_team").isNotNull() & (F.col("from_team") != F.col(team)))
            .select(key, ts, tiebreak, "from_team", F.col(team).alias("to_team"), F.lit("reassignment").alias("change_type"),
                    F.col("_context").alias("context"), F.lit(1.0).alias("confidence"), F.col("_reason").alias("reason")))


def wait_time_by_team(gaps: DataFrame, team: str) -> DataFrame:
    """Waiting time until the next action, attributed to the team that
    acted last."""
    g = gaps.filter(F.col("gap_seconds").isNotNull())
    return g.groupBy(team).agg(F.count(F.lit(1)).alias("waits"), F.avg("gap_seconds").alias("avg_wait_seconds"),
                               F.max("gap_seconds").alias("max_wait_seconds"))


def stage_durations(gaps: DataFrame, key: str, stage: str) -> DataFrame:
    """Time spent per (key, stage) = summed gaps after entries of that stage."""
    return (gaps.filter(F.col("gap_seconds").isNotNull())
            .groupBy(key, stage).agg(F.sum("gap_seconds").alias("stage_seconds"), F.count(F.lit(1)).alias("entries")))


def resolution_delay(gaps: DataFrame, key: str, stage: str, tiebreak: str) -> DataFrame:
    """Longest gap per key and the stage it followed."""
    g = gaps.filter(F.col("gap_seconds").isNotNull())
    pick = F.max(F.struct(F.col("gap_seconds"), (-F.col(tiebreak)).alias("_t"), F.col(stage).alias("s")))
    return g.groupBy(key).agg(pick["gap_seconds"].alias("longest_gap_seconds"), pick["s"].alias("delayed_stage"))


def active_days(events: DataFrame, key: str, ts: str, as_of: Column) -> DataFrame:
    """Whole days from each key's first entry to ``as_of``."""
    return events.groupBy(key).agg(F.min(ts).alias("first_ts")).select(
        key, F.datediff(as_of, F.to_date("first_ts")).alias("active_days"))


def team_interactions(events: DataFrame, key: str, team: str, kind: Column) -> DataFrame:
    """Frequency per (team, interaction type) with the number of distinct
    incidents involved."""
    return (events.withColumn("_kind", kind).groupBy(team, "_kind")
            .agg(F.count(F.lit(1)).alias("frequency"), F.countDistinct(key).alias("incidents"))
            .withColumnRenamed("_kind", "interaction_type"))


# --------------------------------------------------------------------------- customers
def vip_breakdown(incidents: DataFrame, customer: str, status: str, severity: str) -> DataFrame:
    """Counts by customer, by status, by severity and overall
    (GROUPING SETS; ``grouping_id`` tells the rows apart)."""
    return (incidents.groupingSets([[customer], [status], [severity], []], customer, status, severity)
            .agg(F.count(F.lit(1)).alias("incidents"), F.grouping_id().alias("gid")))


def normalized_name(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.trim(col)), r"\s+", " ")


def vip_scan(incidents: DataFrame, customers: DataFrame, aliases: DataFrame, name: str = "c_name",
             cust_key: str = "c_custkey", inc_cust: str = "o_custkey") -> DataFrame:
    """Incidents of chosen customers, matched by normalised name
    (spelling variants in ``aliases.alias``) or by id (``aliases.tenant_id``)."""
    by_name = customers.join(
        aliases.select(normalized_name("alias").alias("_n")).distinct(),
        normalized_name(name) == F.col("_n"), "left_semi").select(cust_key)
    by_id = aliases.select(F.col("tenant_id").alias(cust_key)).filter(F.col(cust_key).isNotNull())
    chosen = by_name.unionByName(by_id).distinct()
    return incidents.join(chosen, incidents[inc_cust] == chosen[cust_key], "left_semi")


def team_collaboration(events: DataFrame, key: str, team: str) -> DataFrame:
    """For every pair of teams that met, the number of incidents both
    worked on: the distinct (incident, team) table joined with itself, counted
    per pair with partial sums.  Any number of teams; a pair that never met
    has no row."""
    presence = events.select(F.col(key).alias("k"), F.col(team).alias("t")).where("k IS NOT NULL AND t IS NOT NULL").distinct()
    a, b = presence.withColumnRenamed("t", "team_a"), presence.withColumnRenamed("t", "team_b")
    return a.join(b, "k").where("team_a < team_b").groupBy("team_a", "team_b").agg(F.count(F.lit(1)).alias("incidents"))


def teams_per_incident(events: DataFrame, key: str, team: str) -> DataFrame:
    """Distinct teams involved per incident."""
    return events.groupBy(key).agg(F.countDistinct(team).alias("teams"))
