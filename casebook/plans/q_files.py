"""Driver queries for file shapes that have no query elsewhere: section files of
many incidents (K1), the older incident document (S3), the nested batch (S4),
image files (K6), a pattern catalogue (S7), and the gap request (P34)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as TM
from ..operators import conversation as C
from ..operators import prompting as PR
from ..operators import screenshots as SS
from ..operators.ordered import positions
from ..session import cut_lineage, ensure_checkpoint_dir, read_table
from ..sinks import writers as W
from ..sinks.section_parts import section_parts, section_parts_sink
from ..sources import readers as RD
from . import inputs as I
from . import sqltext as S
from .q_conversation import KEPT_SQL, TURN_BUCKET, _entries
from .q_extra import _fill_sql
from .q_gap import CHOSEN_SQL
from .q_retrieval import r4_candidates
from .q_text import SHOT_DOCS_SQL, _shot_docs
from .registry import ORACLES, register


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/casebook-{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- K1: many incidents a file
FILES = 16


def _section_store(spark, sf_dir) -> str:
    """Every conversation as three sections: discussions that are out of date,
    roles, and the discussions opened again."""
    c = read_table(spark, sf_dir, "conversations")
    turn, text = F.col("turn").cast("string"), F.col("text")

    def section(order: int, name: str, row) -> DataFrame:
        return c.select(F.col("conv_id").cast("string").alias("incident_id"), F.lit(name).alias("section"),
                        F.lit(order).alias("section_order"), F.col("turn").cast("int").alias("row_no"), row.alias("row"))

    stale = section(0, "Discussions", F.create_map(F.lit("Date"), turn, F.lit("Text"), F.lit("stale")))
    roles = section(1, "Roles", F.create_map(F.lit("Date"), turn, F.lit("Text"), F.col("role")))
    now = section(2, "Discussions", F.create_map(F.lit("Date"), turn, F.lit("Text"), text))
    out = _folder(spark, "section-store")
    section_parts_sink(stale.unionByName(roles).unionByName(now), out, FILES)
    return out


SECTIONS_SQL = """
SELECT CAST(conv_id AS VARCHAR) AS incident_id, section, CAST(pos AS BIGINT) AS pos, CAST(turn AS VARCHAR) AS "Date", md5(cell) AS text_md5
FROM (SELECT conv_id, section, turn, cell, row_number() OVER (PARTITION BY conv_id ORDER BY ord, turn) - 1 AS pos FROM (
  SELECT conv_id, 1 AS ord, 'Roles' AS section, turn, role AS cell FROM conversations
  UNION ALL SELECT conv_id, 2, 'Discussions', turn, text FROM conversations))
"""


def _section_table(rows: DataFrame) -> DataFrame:
    placed = positions(rows, "incident_id", ["section_order", "part", "row_no"], "pos")
    return placed.select("incident_id", "section", "pos", F.col("row")["Date"].alias("Date"),
                         F.md5(F.col("row")["Text"].cast("binary")).alias("text_md5"))


@register("section_parts_roundtrip", SECTIONS_SQL)
def q_section_parts_roundtrip(spark, sf_dir):
    """Many conversations a file, in order, the reopened
    section once; whole cells."""
    return _section_table(section_parts(spark, _section_store(spark, sf_dir), cell_cap=None))


@register("section_parts_requested", f"""
SELECT * FROM ({SECTIONS_SQL})
WHERE incident_id IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations GROUP BY conv_id HAVING count(*) >= 8)
""")
def q_section_parts_requested(spark, sf_dir):
    """K1 + J1: the long conversations, from the files that the index names."""
    long = read_table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("incident_id")).agg(
        F.count(F.lit(1)).alias("n")).where("n >= 8").select("incident_id")
    return _section_table(section_parts(spark, _section_store(spark, sf_dir), long, None))


# --------------------------------------------------------------------------- S3 / S4: older and nested documents
@register("incident_json_older", f"""
SELECT CAST(incident_id AS VARCHAR) AS incident_id, count(*) AS total_entries,
       to_json(list({{'timestamp': CAST(ts AS VARCHAR), 'author': author, 'content': content}} ORDER BY ts, pos))::VARCHAR
         AS conversation, 'Summary of ' || CAST(incident_id AS VARCHAR) AS summary
FROM ({KEPT_SQL}) GROUP BY incident_id
""")
def q_incident_json_older(spark, sf_dir):
    """S3: incident documents of the older shape (``content``, a nested summary)."""
    kept = C.drop_service_noise(_entries(spark, sf_dir), **I.NOISE)
    docs = C.build_conversation(kept, bucket=F.floor(F.col("ts") / TURN_BUCKET))
    number = F.col("incident_id").cast("string")
    summary = F.struct(F.concat(F.lit("Summary of "), number).alias("summary"))
    out = _folder(spark, "older-incidents")
    docs.select(number.alias("incident_id"), F.col("conversation").alias("content"), summary.alias("ai_summary")).write.json(out)
    back = RD.incident_json(spark, out, json_lines=True)
    return back.select("incident_id", F.size("conversation").cast("long").alias("total_entries"),
                       F.to_json("conversation").alias("conversation"), "summary")


@register("combined_json_nested", f"""
WITH r AS ({ORACLES['combined_json_roundtrip']})
SELECT batch_id, ordinal, incident_id, CAST(total_incidents AS BIGINT) AS total_incidents, 'troubleshooting' AS mode,
       CASE WHEN ordinal = 0 THEN 'primary' ELSE 'historical' END AS role, md5(summary) AS summary_md5
FROM r
""")
def q_combined_json_nested(spark, sf_dir):
    """Batches whose incidents lie under ``content``, each with its role;
    ids under the older name."""
    from .q_conversation import BATCH, _texts

    t = _texts(spark, sf_dir).select((F.col("incident_id") / BATCH).cast("long").alias("b"), "incident_id", "conversation_text")
    batches = t.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("incident_id", "conversation_text"))).alias("xs"))
    incidents = F.transform("xs", lambda x, at: F.struct(
        x["incident_id"].cast("string").alias("incident_id"),
        F.when(at == 0, F.lit("primary")).otherwise(F.lit("historical")).alias("role"), x["conversation_text"].alias("summary")))
    docs = batches.select(F.col("b").cast("string").alias("batch_id"), F.lit("troubleshooting").alias("mode"),
                          F.struct(incidents.alias("incidents")).alias("content"))
    out = _folder(spark, "nested-batches")
    docs.write.json(out)
    back = RD.combined_json(spark, out, json_lines=True)
    return back.select("batch_id", F.col("ordinal").cast("int").alias("ordinal"), "incident_id", "total_incidents", "mode", "role",
                       F.md5(F.col("summary").cast("binary")).alias("summary_md5"))


# --------------------------------------------------------------------------- K6
@register("screenshot_files", ORACLES["screenshot_images"].replace(
    "CAST(octet_length(", "lower(hex(").replace(") AS INTEGER) AS n_bytes", ")) AS image_hex"))
def q_screenshot_files(spark, sf_dir):
    """K6: every decoded image through the sink, read back by extension folder."""
    out = _folder(spark, "screenshots")
    W.screenshot_sink(SS.screenshot_images(_shot_docs(spark, sf_dir), "doc_id", "text"), out)
    return spark.read.parquet(out).select("doc_id", "image_no", "name", F.col("extension").cast("string").alias("extension"),
                                          F.lower(F.hex("image")).alias("image_hex"))


# --------------------------------------------------------------------------- S7
@register("pattern_catalog_keywords", r"""
WITH p AS (SELECT list(DISTINCT lower(lang)) AS names FROM documents WHERE lang IS NOT NULL)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(
         regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda t: list_contains(names, t)))), '|') AS keywords
FROM documents, p
""")
def q_pattern_catalog_keywords(spark, sf_dir):
    """S7 -> P17: a catalogue with a pattern for each language name, read back
    and applied to every document."""
    d = read_table(spark, sf_dir, "documents")
    name = F.regexp_replace(F.lower("lang"), r"([^\p{L}\p{N}_])", r"\\$1")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])("), name, F.lit(r")(?![\p{L}\p{N}_])"))
    catalog = d.where(F.col("lang").isNotNull()).agg(F.collect_set(pattern).alias("technical_patterns"))
    out = _folder(spark, "patterns")
    catalog.select(F.to_json(F.struct("technical_patterns"))).coalesce(1).write.text(out)
    found = TM.keywords("text", RD.pattern_catalog(spark, out)) if d.take(1) else F.array().cast("array<string>")
    return d.select("doc_id", F.array_join(found, "|").alias("keywords"))


# --------------------------------------------------------------------------- P34: the gap request
_GAP_COLS = {"summary": "coalesce(b.text, 'No summary available')", "article": "coalesce(d.text, '')",
             "topic": "coalesce(nullif(d.source, ''), 'issue')"}


@register("gap_requests", f"""
SELECT c.item_id, c.doc_id, md5({_fill_sql(PR.GAP_TEMPLATE, _GAP_COLS)}) AS request_md5,
       CAST(length({_fill_sql(PR.GAP_TEMPLATE, _GAP_COLS)}) AS INTEGER) AS n_chars
FROM ({CHOSEN_SQL}) c JOIN benchmark b USING (item_id) JOIN documents d ON d.doc_id = c.doc_id
""")
def q_gap_requests(spark, sf_dir):
    """The gap analysis request of each query text and its top article."""
    # staged, so that a few rows are sent to the documents, not the texts to them
    chosen = cut_lineage(r4_candidates(spark, sf_dir).filter(F.col("rank") == 1).select("item_id", "doc_id"), "gap-chosen")
    b = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("summary"))
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("article_text"), F.col("source").alias("topic"))
    r = PR.gap_requests(chosen.join(d, "doc_id").join(b, "item_id"), topic="topic")
    return r.select("item_id", "doc_id", F.md5(F.col("gap_request").cast("binary")).alias("request_md5"),
                    F.length("gap_request").alias("n_chars"))
