"""Writers for the reference's outputs (K1-K9).

Each sink is a distributed DataFrame write (partitioned directories, one
task per partition); nothing is gathered on the driver.  Append-style sinks
(results, examples, memories, timing reports) add rows, and readers pick the
latest per key; with a run's name a repeated run replaces its own rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage
from .section_parts import section_files_sink


def section_csv_sink(sections: DataFrame, path: str) -> None:
    """K1: one table per section (``section=<name>`` directories); each row
    keeps its incident id and row number so the multi-section layout can be
    re-created per incident."""
    (sections.select("incident_id", "section", "row_no", F.to_json("row").alias("row_json"))
     .write.mode("overwrite").partitionBy("section").parquet(path))


def section_csv_text(sections: DataFrame, path: str) -> None:
    """K1, single-file-per-incident layout: blank line, ``--- name ---``,
    header, rows.  ``section_parts.section_parts_sink`` is the layout for
    incidents of any size."""
    section_files_sink(sections, path)


def incident_json_sink(conversations: DataFrame, path: str) -> None:
    """K2: one JSON document per incident (``incident_id, total_entries,
    conversation[], summary?``)."""
    conversations.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str, run: str | None = None, partition_by: tuple = (), fmt: str = "parquet") -> None:
    """Add rows to a store.  With ``run`` (a name that a repeated run gives
    again) they have the folder ``run=<name>`` to themselves and replace what it
    held, so a run that is repeated, whole or after a failure between two sinks,
    leaves its rows once; other runs are not touched."""
    if run is None:
        df.write.mode("append").partitionBy(*partition_by).format(fmt).save(path)
        return
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"not a folder name: {run!r}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).format(fmt).save(f"{path}/run={run}")


def result_sink(results: DataFrame, path: str, run: str | None = None) -> None:
    """K3: the full record and the slim summary record
    (``ai_summary, prompt_type, operation_time, model_used``) from one
    result table, both partitioned by prompt type.  The results are staged
    first, so that both come from one computation."""
    results = cut_lineage(results, "results")
    append(results, f"{path}/processed", run, ("prompt_type",), "json")
    append(results.select("incident_id", "ai_summary", "prompt_type", "operation_time", "model_used"),
           f"{path}/summaries", run, ("prompt_type",), "json")


def example_append(examples: DataFrame, path: str, run: str | None = None) -> None:
    """K4: append new examples (``prompt_type`` section, keywords, category,
    input, output); a new section is simply a new partition value."""
    append(examples.select("prompt_type", "keywords", "category", "input", "output"), path, run, ("prompt_type",))


def memory_append(memories: DataFrame, path: str, run: str | None = None, stored_at: Column | None = None) -> None:
    """K5: append processed incidents with their vectors and a store time (now,
    or the run's own); readers keep the latest row per incident."""
    append(memories.withColumn("stored_at", F.current_timestamp() if stored_at is None else stored_at), path, run)


def screenshot_sink(images: DataFrame, path: str) -> None:
    """K6: decoded images as a binary column, one directory per extension."""
    images.write.mode("overwrite").partitionBy("extension").parquet(path)


def processed_summary_sink(summaries: DataFrame, path: str, text: str = "summary", key: str = "incident_id") -> None:
    """K7: summary text with every decodable image URL replaced by its
    screenshot reference."""
    from ..operators.screenshots import extract_screenshots

    extract_screenshots(summaries, key, text).select(key, F.col("processed_text").alias(text), "screenshot_count") \
        .write.mode("overwrite").parquet(path)


def timing_report_sink(by_category: DataFrame, slowest: DataFrame, path: str, session_ts: str, run: str | None = None) -> None:
    """K8: append the category breakdown and the slowest operations of one
    session, keyed by the session timestamp."""
    append(by_category.withColumn("session_ts", F.lit(session_ts)), f"{path}/by_category", run)
    append(slowest.withColumn("session_ts", F.lit(session_ts)), f"{path}/slowest", run)


def gap_report_sink(reports: DataFrame, path: str) -> None:
    """K9: one report row per (incident, article) with its path-safe name."""
    reports.write.mode("overwrite").parquet(path)


def redacted_text(c):
    """Helper re-export: P2 applied before any sink that keeps raw cells."""
    return T.redact_image_data(c)
