"""Conversation assembly (P5, F-1, A1-A5, A12, A13, J8, F-11).

Input is a long table of discussion entries, one row per entry:
``incident_id, ts, author, content`` plus an optional input-order column that
keeps the sort stable.  All operators are batch operators over many incidents.

Scale notes
-----------
* Cleaning, normalising and the noise filter are narrow projections.
* Ordered text per incident is built in two levels: entries are first
  concatenated per ``(incident, bucket)`` where the bucket is a monotone
  coarsening of the sort key, then the bucket strings are concatenated in
  bucket order.  A single incident holding a large share of all rows is thus
  spread over many tasks in the first (heavy) level; the second level only
  sees one pre-joined string per bucket.
* Counts use partial (map-side) aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..session import cut_lineage


def _first_present(df: DataFrame, names) -> Column:
    """First non-empty value among the alternate column names that exist."""
    cols = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    if not cols:
        return F.lit(None).cast("string")
    return F.coalesce(*cols)


def normalize_entries(df: DataFrame, ts_cols=("Date", "timestamp", "ts"),
                      author_cols=("ChangedBy", "author"),
                      content_cols=("Text", "content")) -> DataFrame:
    """P5: pick timestamp/author/content among alternate names (empty string
    counts as missing) and clean the content with P1."""
    raw = T.strip_ws(F.coalesce(_first_present(df, content_cols), F.lit("")))
    keep = [c for c in df.columns if c not in set(ts_cols) | set(author_cols) | set(content_cols)]
    return df.select(
        *keep,
        _first_present(df, ts_cols).alias("ts") if not _is_typed_ts(df, ts_cols) else _typed_ts(df, ts_cols),
        _first_present(df, author_cols).alias("author"),
        F.when(raw == "", F.lit("")).otherwise(T.clean_html(raw)).alias("content"),
    )


def _is_typed_ts(df: DataFrame, ts_cols) -> bool:
    present = [n for n in ts_cols if n in df.columns]
    return len(present) == 1 and dict(df.dtypes)[present[0]] != "string"


def _typed_ts(df: DataFrame, ts_cols) -> Column:
    name = [n for n in ts_cols if n in df.columns][0]
    return F.col(name).alias("ts")


def noise_flag(author: str = "author", content: str = "content",
               account: str | None = None, prefix: str | None = None) -> Column:
    """F-1 predicate: service account *and* boilerplate prefix (null author -> keep).
    Without an account and a prefix nothing is noise."""
    if account is None or prefix is None:
        return F.lit(False)
    return F.coalesce((F.col(author) == account) & F.col(content).startswith(prefix), F.lit(False))


def drop_service_noise(df: DataFrame, **kw) -> DataFrame:
    """F-1: drop service-account boilerplate entries."""
    return df.filter(~noise_flag(**kw))


def filtered_counts(df: DataFrame, key: str = "incident_id", **kw) -> DataFrame:
    """Per incident, entries seen, dropped by F-1 and kept."""
    flag = noise_flag(**kw)
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(flag).alias("filtered_count"),
        F.count_if(~flag).alias("total_entries"),
    )


def ordered_concat(df: DataFrame, key: str, order_cols, line: Column, sep: str,
                   bucket: Column | None = None, out: str = "text") -> DataFrame:
    """Concatenate ``line`` per ``key`` in ``order_cols`` order, joined by ``sep``.

    With ``bucket`` (a monotone function of the first order column) the work
    is split in two levels so one hot key never lands in a single task for
    the heavy part.
    """
    order_cols = list(order_cols)
    if bucket is None:
        agg = df.groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_cols], line.alias("_l"))))
            .alias("_xs"))
        return agg.select(key, F.array_join(F.transform("_xs", lambda x: x["_l"]), sep).alias(out))
    part = (df.withColumn("_b", bucket)
            .groupBy(key, "_b")
            .agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_cols], line.alias("_l"))))
                 .alias("_xs"))
            .select(key, "_b", F.array_join(F.transform("_xs", lambda x: x["_l"]), sep).alias("_chunk")))
    return (part.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("_b", "_chunk"))).alias("_cs"))
            .select(key, F.array_join(F.transform("_cs", lambda x: x["_chunk"]), sep).alias(out)))


def build_conversation(df: DataFrame, key: str = "incident_id", order_cols=("ts", "pos"),
                       bucket: Column | None = None) -> DataFrame:
    """A1: one row per incident with the entries as an ordered array of
    ``struct(timestamp, author, content)`` and ``total_entries``.  (The nested
    form is the document shape written by K2; analytics use the long form.)
    With ``bucket`` the sort runs per ``(incident, bucket)`` and the sorted
    chunks are concatenated in bucket order."""
    order_cols = [c for c in order_cols if c in df.columns]
    entry = F.struct(*[F.col(c) for c in order_cols], F.col("ts").cast("string").alias("timestamp"),
                     F.col("author"), F.col("content"))
    if bucket is None:
        agg = df.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_xs"),
                                  F.count(F.lit(1)).alias("total_entries"))
    else:
        part = (df.withColumn("_b", bucket).groupBy(key, "_b")
                .agg(F.array_sort(F.collect_list(entry)).alias("_chunk"), F.count(F.lit(1)).alias("_n")))
        agg = (part.groupBy(key)
               .agg(F.array_sort(F.collect_list(F.struct("_b", "_chunk"))).alias("_cs"),
                    F.sum("_n").alias("total_entries"))
               .select(key, F.flatten(F.transform("_cs", lambda c: c["_chunk"])).alias("_xs"), "total_entries"))
    return agg.select(key, F.col("total_entries").cast("long").alias("total_entries"),
                      F.transform("_xs", lambda x: F.struct(x["timestamp"].alias("timestamp"),
                                                             x["author"].alias("author"),
                                                             x["content"].alias("content"))).alias("conversation"))


def conversation_text(entries: DataFrame, summaries: DataFrame | None = None,
                      key: str = "incident_id", order_cols=("ts", "pos"),
                      bucket: Column | None = None, support_title: str | None = None) -> DataFrame:
    """A2: ``[ts] author: content`` lines (content with P4 applied, given a ``support_title``) joined by
    newlines; prefixed by ``--- Authored Summary ---`` block when the incident
    has a non-empty summary (left join, J2)."""
    line = T.format_entry(F.col("ts"), F.col("author"), T.strip_support_section(F.col("content"), support_title))
    order_cols = [c for c in order_cols if c in entries.columns]
    conv = ordered_concat(entries, key, order_cols, line, "\n", bucket=bucket, out="conversation_text")
    if summaries is None:
        return conv
    s = summaries.select(key, F.col("summary"))
    joined = conv.join(s, key, "left")
    clean_sum = T.strip_support_section(F.col("summary"), support_title)
    return joined.select(
        key,
        F.when(F.coalesce(F.col("summary"), F.lit("")) != "",
               F.concat(F.lit("--- Authored Summary ---\n"), clean_sum, F.lit("\n\n"),
                        F.col("conversation_text")))
        .otherwise(F.col("conversation_text")).alias("conversation_text"))


def conversation_with_counts(entries: DataFrame, summaries: DataFrame | None = None, key: str = "incident_id",
                             order_cols=("ts", "pos"), bucket: Column | None = None,
                             support_title: str | None = None, **noise) -> DataFrame:
    """A2 + F-1 + A12 in one pass over the cleaned entries: the noise flag is
    evaluated once, kept lines are concatenated (two levels with ``bucket``)
    and the total / dropped counts ride along in the same aggregations.
    Incidents whose entries were all dropped have no text row."""
    flag = noise_flag(**noise)
    order_cols = [c for c in order_cols if c in entries.columns]
    line = T.format_entry(F.col("ts"), F.col("author"), T.strip_support_section(F.col("content"), support_title))
    item = F.when(~flag, F.struct(*[F.col(c) for c in order_cols], line.alias("_l")))
    b = bucket if bucket is not None else F.lit(0)
    lvl1 = (entries.withColumn("_b", b).groupBy(key, "_b")
            .agg(F.array_sort(F.collect_list(item)).alias("_xs"), F.count(F.lit(1)).alias("_n"),
                 F.count_if(flag).alias("_f")))
    chunk = F.when(F.size("_xs") > 0, F.array_join(F.transform("_xs", lambda x: x["_l"]), "\n"))
    lvl2 = (lvl1.select(key, "_b", chunk.alias("_chunk"), "_n", "_f")
            .groupBy(key)
            .agg(F.array_sort(F.collect_list(F.when(F.col("_chunk").isNotNull(), F.struct("_b", "_chunk"))))
                 .alias("_cs"), F.sum("_n").alias("_n"), F.sum("_f").alias("_f"))
            .filter(F.size("_cs") > 0))
    conv = lvl2.select(key, (F.col("_n") - F.col("_f")).alias("total_entries"), F.col("_f").alias("filtered_count"),
                       F.array_join(F.transform("_cs", lambda c: c["_chunk"]), "\n").alias("conversation_text"))
    if summaries is None:
        return conv
    j = conv.join(summaries.select(key, "summary"), key, "left")
    return j.select(
        key, "total_entries", "filtered_count",
        F.when(F.coalesce(F.col("summary"), F.lit("")) != "",
               F.concat(F.lit("--- Authored Summary ---\n"), T.strip_support_section(F.col("summary"), support_title), F.lit("\n\n"),
                        F.col("conversation_text")))
        .otherwise(F.col("conversation_text")).alias("conversation_text"))


def authored_summary(rows: DataFrame, key: str = "incident_id", row_no: str = "row_no",
                     cells: str = "cells", summary_cell: str = "summary", rows_per_bucket: int | None = 64) -> DataFrame:
    """A3: per row, non-empty cells joined by a space and stripped; rows
    joined by newlines and stripped; the first row's ``Summary`` cell wins
    only when strictly longer.  Rows are concatenated in two levels of
    ``rows_per_bucket``."""
    row_text = T.strip_ws(F.array_join(F.filter(F.col(cells), lambda x: x.isNotNull() & (x != "")), " "))
    per_row = rows.select(key, row_no, row_text.alias("_rt"), F.col(summary_cell).alias("_sc"))
    bucket = F.floor(F.col(row_no) / rows_per_bucket) if rows_per_bucket else None
    agg = ordered_concat(per_row.filter(F.col("_rt") != ""), key, [row_no], F.col("_rt"), "\n", bucket=bucket,
                         out="_agg")
    first_cell = (per_row.groupBy(key)
                  .agg(F.min_by(F.coalesce(F.col("_sc"), F.lit("")), F.col(row_no)).alias("_single")))
    j = first_cell.join(agg, key, "left").select(
        key, T.strip_ws(F.coalesce(F.col("_agg"), F.lit(""))).alias("_agg"), "_single")
    return j.select(key, F.when(F.length("_agg") >= F.length("_single"), F.col("_agg"))
                    .otherwise(F.col("_single")).alias("summary"))


def full_content(entries: DataFrame, key: str = "incident_id", order_cols=("ts", "pos"),
                 bucket: Column | None = None) -> DataFrame:
    """``' ' + content`` for every message, concatenated in order."""
    order_cols = [c for c in order_cols if c in entries.columns]
    line = F.concat(F.lit(" "), F.coalesce(F.col("content"), F.lit("")))
    return ordered_concat(entries, key, order_cols, line, "", bucket=bucket, out="full_content")


def unified_content(texts: DataFrame, batch: str = "batch_id", ordinal: str = "ordinal",
                    key: str = "incident_id", text: str = "conversation_text") -> DataFrame:
    """A4: ``=== Incident <id> ===`` blocks joined by blank lines in batch
    order; the batch result id is ``combined_<ids joined by _>``."""
    texts = cut_lineage(texts.select(batch, ordinal, key, text), "batch-texts")
    block = F.concat(F.lit("=== Incident "), F.col(key).cast("string"), F.lit(" ===\n"), F.col(text))
    body = ordered_concat(texts, batch, [ordinal], block, "\n\n", out="unified_content")
    ids = ordered_concat(texts, batch, [ordinal], F.col(key).cast("string"), "_", out="_ids")
    counts = texts.groupBy(batch).agg(F.count(F.lit(1)).alias("total_incidents"))
    return (body.join(ids, batch).join(counts, batch)
            .select(batch, F.concat(F.lit("combined_"), F.col("_ids")).alias("combined_id"),
                    "total_incidents", "unified_content"))


def plan_content(texts: DataFrame, batch: str = "batch_id", ordinal: str = "ordinal",
                 role: str = "role", key: str = "incident_id",
                 text: str = "conversation_text") -> DataFrame:
    """A5 + J8 + F-11: primary incident text followed by the historical
    reference block; only batches with at least two incidents and a primary."""
    texts = cut_lineage(texts.select(batch, ordinal, role, key, text), "plan-texts")
    is_primary = F.col(role) == "primary"
    hist = texts.filter(~is_primary)
    hist_block = F.concat(F.lit("=== Historical Incident "), F.col(key).cast("string"), F.lit(" ===\n"),
                          F.col(text))
    hist_text = ordered_concat(hist, batch, [ordinal], hist_block, "\n\n", out="_hist")
    hist_ids = ordered_concat(hist, batch, [ordinal], F.col(key).cast("string"), "_", out="_hids")
    prim = texts.filter(is_primary).select(batch, F.col(key).cast("string").alias("_pid"),
                                           F.col(text).alias("_ptext"))
    sizes = texts.groupBy(batch).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    j = prim.join(sizes, batch).join(hist_text, batch, "left").join(hist_ids, batch, "left")
    content = F.concat(
        F.lit("=== PRIMARY INCIDENT "), F.col("_pid"), F.lit(" ===\n"), F.col("_ptext"), F.lit("\n\n"),
        F.when(F.col("_hist").isNotNull(),
               F.concat(F.lit("=== HISTORICAL REFERENCE INCIDENTS ===\n"), F.col("_hist")))
        .otherwise(F.lit("")))
    return j.select(
        batch,
        F.concat(F.lit("troubleshooting_plan_"), F.col("_pid"), F.lit("_with_"),
                 F.coalesce(F.col("_hids"), F.lit(""))).alias("plan_id"),
        F.col("_n").alias("total_incidents"),
        content.alias("plan_content"))
