"""Driver queries for conversation assembly, gates and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversation as C
from ..operators import ordered as OR
from ..session import read_table
from . import inputs as I
from . import sqltext as S
from .inputs import RAW_DISCUSSIONS_SQL, raw_discussions
from .registry import register

# Sort-key bucket for the two-level ordered concatenation (turns per chunk).
TURN_BUCKET = 64


def _entries(spark, sf_dir):
    return C.normalize_entries(raw_discussions(spark, sf_dir))


ENTRIES_SQL = (f"SELECT incident_id, ts, pos, author, "
               f"CASE WHEN {S.strip_ws('content')} = '' THEN '' ELSE {S.clean_html(S.strip_ws('content'))} END "
               f"AS content FROM ({RAW_DISCUSSIONS_SQL})")
KEPT_SQL = (f"SELECT * FROM ({ENTRIES_SQL}) e WHERE NOT coalesce(author = {S.q(I.SERVICE_ACCOUNT)} "
            f"AND starts_with(content, {S.q(I.SERVICE_BOILERPLATE)}), false)")
LINE_SQL = S.format_entry("ts", "author", S.strip_support_section("content", I.SUPPORT_SECTION_TITLE))
SUMMARY_SQL = "SELECT doc_id AS incident_id, text AS summary FROM documents"


def _summaries(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("incident_id"), F.col("text").alias("summary"))


@register("conversation_text", f"""
WITH kept AS ({KEPT_SQL}),
conv AS (SELECT incident_id, string_agg({LINE_SQL}, chr(10) ORDER BY ts, pos) AS conversation_text
         FROM kept GROUP BY incident_id),
counts AS (SELECT incident_id, count(*) AS total_rows,
                  count(*) FILTER (WHERE coalesce(author = {S.q(I.SERVICE_ACCOUNT)}
                     AND starts_with(content, {S.q(I.SERVICE_BOILERPLATE)}), false)) AS filtered_count
           FROM ({ENTRIES_SQL}) GROUP BY incident_id)
SELECT conv.incident_id, counts.total_rows - counts.filtered_count AS total_entries, counts.filtered_count,
       CASE WHEN coalesce(s.summary, '') <> ''
            THEN '--- Authored Summary ---' || chr(10) || {S.strip_support_section('s.summary', I.SUPPORT_SECTION_TITLE)}
                 || chr(10) || chr(10) || conv.conversation_text
            ELSE conv.conversation_text END AS conversation_text
FROM conv JOIN counts USING (incident_id) LEFT JOIN ({SUMMARY_SQL}) s USING (incident_id)
""")
def q_conversation_text(spark, sf_dir):
    """E1 minimum slice: discussions -> P5 clean -> F-1 -> A2 (+J2 summary) with
    A12 counts."""
    r = C.conversation_with_counts(_entries(spark, sf_dir), _summaries(spark, sf_dir),
                                   bucket=F.floor(F.col("ts") / TURN_BUCKET),
                                   support_title=I.SUPPORT_SECTION_TITLE, **I.NOISE)
    return r.select("incident_id", F.col("total_entries").cast("long").alias("total_entries"),
                    F.col("filtered_count").cast("long").alias("filtered_count"), "conversation_text")


def entry_query(spark, sf_dir):
    return q_conversation_text(spark, sf_dir)


CONV_TEXT_SQL = f"""
WITH kept AS ({KEPT_SQL}),
conv AS (SELECT incident_id, string_agg({LINE_SQL}, chr(10) ORDER BY ts, pos) AS conversation_text
         FROM kept GROUP BY incident_id)
SELECT conv.incident_id,
       CASE WHEN coalesce(s.summary, '') <> ''
            THEN '--- Authored Summary ---' || chr(10) || {S.strip_support_section('s.summary', I.SUPPORT_SECTION_TITLE)}
                 || chr(10) || chr(10) || conv.conversation_text
            ELSE conv.conversation_text END AS conversation_text
FROM conv LEFT JOIN ({SUMMARY_SQL}) s USING (incident_id)
"""
BATCH = 5


def _texts(spark, sf_dir):
    kept = C.drop_service_noise(_entries(spark, sf_dir), **I.NOISE)
    return C.conversation_text(kept, _summaries(spark, sf_dir), bucket=F.floor(F.col("ts") / TURN_BUCKET),
                               support_title=I.SUPPORT_SECTION_TITLE)


@register("unified_content", f"""
WITH t AS ({CONV_TEXT_SQL})
SELECT incident_id // {BATCH} AS batch_id,
       'combined_' || string_agg(CAST(incident_id AS VARCHAR), '_' ORDER BY incident_id) AS combined_id,
       count(*) AS total_incidents,
       string_agg('=== Incident ' || CAST(incident_id AS VARCHAR) || ' ===' || chr(10) || conversation_text,
                  chr(10) || chr(10) ORDER BY incident_id) AS unified_content
FROM t GROUP BY incident_id // {BATCH}
""")
def q_unified_content(spark, sf_dir):
    """A4 (+S4 shape): incidents grouped into batches of five, one combined text per batch."""
    t = _texts(spark, sf_dir).select(
        (F.col("incident_id") / BATCH).cast("long").alias("batch_id"), F.col("incident_id").alias("ordinal"),
        "incident_id", "conversation_text")
    return C.unified_content(t)


def _plan_texts(spark, sf_dir):
    t = _texts(spark, sf_dir)
    b = (F.col("incident_id") / BATCH).cast("long")
    firsts = t.groupBy(b.alias("batch_id")).agg(F.min("incident_id").alias("_first"))
    return t.withColumn("batch_id", b).join(firsts, "batch_id").select(
        "batch_id", F.col("incident_id").alias("ordinal"), "incident_id", "conversation_text",
        F.when(F.col("incident_id") == F.col("_first"), F.lit("primary")).otherwise(F.lit("historical")).alias("role"))


@register("plan_content", f"""
WITH t AS (SELECT incident_id // {BATCH} AS batch_id, incident_id, conversation_text,
                  CASE WHEN incident_id = min(incident_id) OVER (PARTITION BY incident_id // {BATCH})
                       THEN 'primary' ELSE 'historical' END AS role FROM ({CONV_TEXT_SQL})),
n AS (SELECT batch_id, count(*) AS n FROM t GROUP BY batch_id HAVING count(*) >= 2),
h AS (SELECT batch_id, string_agg('=== Historical Incident ' || CAST(incident_id AS VARCHAR) || ' ===' || chr(10)
             || conversation_text, chr(10) || chr(10) ORDER BY incident_id) AS hist,
             string_agg(CAST(incident_id AS VARCHAR), '_' ORDER BY incident_id) AS hids
      FROM t WHERE role = 'historical' GROUP BY batch_id)
SELECT p.batch_id, 'troubleshooting_plan_' || CAST(p.incident_id AS VARCHAR) || '_with_' || coalesce(h.hids, '') AS plan_id,
       n.n AS total_incidents,
       '=== PRIMARY INCIDENT ' || CAST(p.incident_id AS VARCHAR) || ' ===' || chr(10) || p.conversation_text
       || chr(10) || chr(10) || CASE WHEN h.hist IS NOT NULL
            THEN '=== HISTORICAL REFERENCE INCIDENTS ===' || chr(10) || h.hist ELSE '' END AS plan_content
FROM t p JOIN n USING (batch_id) LEFT JOIN h USING (batch_id) WHERE p.role = 'primary'
""")
def q_plan_content(spark, sf_dir):
    """A5 + J8 + F-11: the first incident of each batch is primary, the rest
    historical; only batches with at least two incidents."""
    return C.plan_content(_plan_texts(spark, sf_dir))


CHUNK_TEXTS = 2  # texts of a chunk here; a batch of five is three chunks


@register("unified_content_chunks", f"""
WITH t AS ({CONV_TEXT_SQL}),
p AS (SELECT incident_id // {BATCH} AS batch_id, incident_id, conversation_text,
             row_number() OVER (PARTITION BY incident_id // {BATCH} ORDER BY incident_id) - 1 AS pos FROM t)
SELECT batch_id, CAST(pos // {CHUNK_TEXTS} AS INTEGER) AS chunk,
       string_agg(CASE WHEN pos > 0 THEN chr(10) || chr(10) ELSE '' END || '=== Incident ' || CAST(incident_id AS VARCHAR)
                  || ' ===' || chr(10) || conversation_text, '' ORDER BY pos) AS text
FROM p GROUP BY batch_id, pos // {CHUNK_TEXTS}
""")
def q_unified_content_chunks(spark, sf_dir):
    """A4 written as ordered chunks: no batch is one value."""
    t = _texts(spark, sf_dir).select(
        (F.col("incident_id") / BATCH).cast("long").alias("batch_id"), F.col("incident_id").alias("ordinal"),
        "incident_id", "conversation_text")
    return OR.unified_chunks(t, chunk_rows=CHUNK_TEXTS)


@register("plan_content_chunks", f"""
WITH t AS ({CONV_TEXT_SQL}),
p AS (SELECT incident_id // {BATCH} AS batch_id, incident_id, conversation_text,
             row_number() OVER (PARTITION BY incident_id // {BATCH} ORDER BY incident_id) - 1 AS pos,
             count(*) OVER (PARTITION BY incident_id // {BATCH}) AS n FROM t)
SELECT batch_id, CAST(pos // {CHUNK_TEXTS} AS INTEGER) AS chunk,
       string_agg(CASE WHEN pos = 0 THEN '=== PRIMARY INCIDENT ' || CAST(incident_id AS VARCHAR) || ' ===' || chr(10)
                            || conversation_text || chr(10) || chr(10)
                       ELSE CASE WHEN pos = 1 THEN '=== HISTORICAL REFERENCE INCIDENTS ===' || chr(10) ELSE chr(10) || chr(10) END
                            || '=== Historical Incident ' || CAST(incident_id AS VARCHAR) || ' ===' || chr(10)
                            || conversation_text END, '' ORDER BY pos) AS text
FROM p WHERE n >= 2 GROUP BY batch_id, pos // {CHUNK_TEXTS}
""")
def q_plan_content_chunks(spark, sf_dir):
    """A5 written as ordered chunks."""
    return OR.plan_chunks(_plan_texts(spark, sf_dir), chunk_rows=CHUNK_TEXTS)


@register("plan_batches", f"""
WITH t AS (SELECT incident_id // {BATCH} AS batch_id, incident_id FROM ({CONV_TEXT_SQL}) WHERE incident_id % {BATCH} <> 0
           OR incident_id // {BATCH} % 3 > 0)
SELECT batch_id, count(*) AS incidents, count(*) FILTER (WHERE incident_id % {BATCH} = 0) AS primaries,
       CASE WHEN count(*) < 2 THEN 'Troubleshooting plan mode requires at least 2 incidents'
            WHEN count(*) FILTER (WHERE incident_id % {BATCH} = 0) = 0 THEN 'Primary incident not found' END AS refused
FROM t GROUP BY batch_id
""")
def q_plan_batches(spark, sf_dir):
    """F-11: every batch with the reason for which it makes no plan; every third
    one has lost its primary incident."""
    i = F.col("incident_id")
    t = _texts(spark, sf_dir).filter((i % BATCH != 0) | (F.floor(i / BATCH) % 3 > 0))
    role = F.when(i % BATCH == 0, F.lit("primary")).otherwise(F.lit("historical"))
    return OR.plan_batches(t.select((i / BATCH).cast("long").alias("batch_id"), role.alias("role")))


@register("authored_summary", """
WITH r AS (SELECT conv_id AS incident_id, turn AS row_no,
                  [role, text, CASE WHEN turn % 3 = 0 THEN '' ELSE 'note ' || CAST(turn AS VARCHAR) END] AS cells,
                  CASE WHEN turn % 4 = 1 THEN '' ELSE text END AS summary FROM conversations),
rt AS (SELECT incident_id, row_no, regexp_replace(array_to_string(list_filter(cells, lambda x: x IS NOT NULL AND x <> ''), ' '),
              '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g') AS rt, summary FROM r),
agg AS (SELECT incident_id, regexp_replace(coalesce(string_agg(rt, chr(10) ORDER BY row_no) FILTER (WHERE rt <> ''), ''),
               '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g') AS agg,
               arg_min(coalesce(summary, ''), row_no) AS single FROM rt GROUP BY incident_id)
SELECT incident_id, CASE WHEN length(agg) >= length(single) THEN agg ELSE single END AS summary FROM agg
""")
def q_authored_summary(spark, sf_dir):
    """A3: multi-row, multi-cell summaries (conversation turns as summary rows)."""
    c = read_table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("incident_id"), F.col("turn").alias("row_no"),
                    F.array(F.col("role"), F.col("text"),
                            F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(
                                F.concat(F.lit("note "), F.col("turn").cast("string")))).alias("cells"),
                    F.when(F.col("turn") % 4 == 1, F.lit("")).otherwise(F.col("text")).alias("summary"))
    return C.authored_summary(rows)


@register("build_conversation", f"""
SELECT incident_id, count(*) AS total_entries,
       to_json(list({{'timestamp': CAST(ts AS VARCHAR), 'author': author, 'content': content}} ORDER BY ts, pos))::VARCHAR
         AS conversation
FROM ({KEPT_SQL}) GROUP BY incident_id
""")
def q_build_conversation(spark, sf_dir):
    """A1 (+O1): the nested per-incident document (as JSON text)."""
    kept = C.drop_service_noise(_entries(spark, sf_dir), **I.NOISE)
    b = C.build_conversation(kept, bucket=F.floor(F.col("ts") / TURN_BUCKET))
    return b.select("incident_id", "total_entries", F.to_json("conversation").alias("conversation"))


@register("format_entries", f"""
SELECT incident_id, ts, {S.format_entry('ts', 'author', 'content')} AS line,
       {S.format_entry('ts', 'author', S.strip_support_section('content', I.SUPPORT_SECTION_TITLE))} AS prompt_line
FROM ({ENTRIES_SQL})
""")
def q_format_entries(spark, sf_dir):
    """P5 + P11: normalised entries as ``[ts] author: content`` lines."""
    e = _entries(spark, sf_dir)
    return e.select("incident_id", "ts", T.format_entry("ts", "author", "content").alias("line"),
                    T.format_entry("ts", "author", T.strip_support_section(F.col("content"), I.SUPPORT_SECTION_TITLE)).alias("prompt_line"))


@register("full_content", f"""
SELECT incident_id, CAST(length(full_content) AS INTEGER) AS content_length, full_content FROM (
  SELECT incident_id, string_agg(' ' || content, '' ORDER BY ts, pos) AS full_content FROM ({KEPT_SQL}) GROUP BY incident_id)
""")
def q_full_content(spark, sf_dir):
    """Every message prefixed by a space, concatenated in order."""
    kept = C.drop_service_noise(_entries(spark, sf_dir), **I.NOISE)
    f = C.full_content(kept, bucket=F.floor(F.col("ts") / TURN_BUCKET))
    return f.select("incident_id", F.length("full_content").alias("content_length"), "full_content")


@register("empty_fetch_gate", """
SELECT doc_id AS incident_id FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)
""")
def q_empty_fetch_gate(spark, sf_dir):
    """F-4: requested incidents (every document id) with no discussion rows are skipped."""
    req = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("incident_id"))
    disc = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("incident_id"))
    return req.join(disc, "incident_id", "left_anti")


@register("incident_scan", """
WITH req AS (SELECT DISTINCT doc_id AS incident_id FROM labels),
rows AS (SELECT conv_id AS incident_id, count(*) AS n_rows FROM conversations
         WHERE conv_id IN (SELECT incident_id FROM req) GROUP BY conv_id)
SELECT req.incident_id, coalesce(rows.n_rows, 0) AS n_rows,
       CASE WHEN rows.n_rows IS NULL THEN 'missing' ELSE 'processed' END AS status
FROM req LEFT JOIN rows USING (incident_id)
""")
def q_incident_scan(spark, sf_dir):
    """S1 + J1 + J3: requested ids (labelled documents) semi-joined to the
    discussion rows; requested ids without rows are reported as missing."""
    req = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("incident_id")).distinct()
    disc = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("incident_id"))
    from ..sources import readers as RD
    rows = RD.scan_requested(disc, req, "incident_id").groupBy("incident_id").agg(F.count(F.lit(1)).alias("n_rows"))
    j = req.join(rows, "incident_id", "left")
    return j.select("incident_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                    F.when(F.col("n_rows").isNull(), F.lit("missing")).otherwise(F.lit("processed")).alias("status"))


@register("format_items", """
SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN '[Image: ' || text || ']' ELSE text END, chr(10) ORDER BY turn)
  AS conversation FROM conversations GROUP BY conv_id
""")
def q_format_items(spark, sf_dir):
    """Content items joined, non-text items shown as ``[Image: …]``."""
    from ..operators import prompting as PR
    c = read_table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("pos"),
        F.when(F.col("role") == "system", F.lit("image")).otherwise(F.lit("text")).alias("type"),
        F.col("text").alias("content"))
    return PR.format_items(c, "conv_id", bucket=F.floor(F.col("pos") / TURN_BUCKET))


@register("section_csv_roundtrip", """
SELECT CAST(conv_id AS VARCHAR) AS incident_id,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS row_no,
       CAST(turn AS VARCHAR) AS "Date", role AS "ChangedBy", text AS "Text"
FROM conversations
""")
def q_section_csv_roundtrip(spark, sf_dir):
    """K1 (single file per incident) + S2: every conversation written as a
    multi-section CSV file under the shared checkpoint folder, then parsed
    back into discussion rows (rows are numbered in turn order)."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sinks import writers as W
    from ..sources import readers as RD

    c = read_table(spark, sf_dir, "conversations")
    row = F.create_map(F.lit("Date"), F.col("turn").cast("string"), F.lit("ChangedBy"), F.col("role"),
                       F.lit("Text"), F.col("text"))
    sections = c.select(F.col("conv_id").cast("string").alias("incident_id"), F.lit("Discussions").alias("section"),
                        F.lit(0).alias("section_order"), F.col("turn").cast("int").alias("row_no"), row.alias("row"))
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/casebook-sections-{uuid.uuid4().hex}"
    W.section_csv_text(sections, out)
    d = RD.discussions_from_sections(RD.multi_section_csv(spark, out))
    return d.select("incident_id", F.col("pos").alias("row_no"), "Date", "ChangedBy", "Text")


@register("incident_json_roundtrip", f"""
SELECT CAST(incident_id AS VARCHAR) AS incident_id, count(*) AS total_entries,
       to_json(list({{'timestamp': CAST(ts AS VARCHAR), 'author': author, 'content': content}} ORDER BY ts, pos))::VARCHAR
         AS conversation
FROM ({KEPT_SQL}) GROUP BY incident_id
""")
def q_incident_json_roundtrip(spark, sf_dir):
    """K2 + S3: one JSON document per incident written under the shared
    checkpoint folder and read back through the incident-document reader."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sinks import writers as W
    from ..sources import readers as RD

    kept = C.drop_service_noise(_entries(spark, sf_dir), **I.NOISE)
    docs = C.build_conversation(kept, bucket=F.floor(F.col("ts") / TURN_BUCKET)).withColumn(
        "incident_id", F.col("incident_id").cast("string"))
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/casebook-incidents-{uuid.uuid4().hex}"
    W.incident_json_sink(docs, out)
    back = RD.incident_json(spark, out, json_lines=True)
    return back.select("incident_id", F.size("conversation").cast("long").alias("total_entries"),
                       F.to_json("conversation").alias("conversation"))


@register("combined_json_roundtrip", f"""
WITH t AS ({CONV_TEXT_SQL})
SELECT CAST(incident_id // {BATCH} AS VARCHAR) AS batch_id,
       CAST(row_number() OVER (PARTITION BY incident_id // {BATCH} ORDER BY incident_id) - 1 AS INTEGER) AS ordinal,
       CAST(incident_id AS VARCHAR) AS incident_id, count(*) OVER (PARTITION BY incident_id // {BATCH}) AS total_incidents,
       'standard' AS mode, conversation_text AS summary
FROM t
""")
def q_combined_json_roundtrip(spark, sf_dir):
    """S4 (+A4 batches): batches of five incidents written as combined
    documents (``incidents`` array, no ``mode`` / ``total_incidents`` so the
    defaults apply) under the shared checkpoint folder and read back."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import readers as RD

    t = _texts(spark, sf_dir).select((F.col("incident_id") / BATCH).cast("long").alias("b"), "incident_id",
                                      "conversation_text")
    inc = F.struct(F.col("incident_id").cast("string").alias("incident_number"),
                   F.col("conversation_text").alias("summary"))
    docs = (t.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("incident_id", inc.alias("i")))).alias("_xs"))
            .select(F.col("b").cast("string").alias("batch_id"),
                    F.transform("_xs", lambda x: x["i"]).alias("incidents")))
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/casebook-combined-{uuid.uuid4().hex}"
    docs.write.mode("overwrite").json(out)
    back = RD.combined_json(spark, out, json_lines=True)
    return back.select("batch_id", F.col("ordinal").cast("int").alias("ordinal"), "incident_id", "total_incidents",
                       "mode", "summary")
