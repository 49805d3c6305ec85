"""Driver queries for log-folder analysis.  The file tree is derived from
the documents table: incident = 27 consecutive ids, date folder from the text
length, analyzer folder / file name from the document id, so that every document
has a path of its own; content = the document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import logs as LG
from . import sqltext as S
from ..session import cut_lineage, ensure_checkpoint_dir, read_table
from ..sinks import file_tree as FT
from .inputs import INJECTED_DOCUMENTS_SQL, injected_documents
from .registry import ORACLES, register

INNER = K.KEY_LOG_FILES + ["nested", "notes.md"]


def listing(spark, sf_dir):
    d = injected_documents(spark, sf_dir)
    date = F.when(F.col("doc_id") % 10 == 9, F.lit("misc")).otherwise(
        F.concat(F.lit("0"), (F.col("n_chars") % 3 + 1).cast("string"), F.lit("-15")))
    an = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Output_run"), (F.col("doc_id") % 2).cast("string"))) \
        .otherwise(F.concat(F.lit("raw_run"), (F.col("doc_id") % 3).cast("string")))
    slot = (F.floor(F.col("doc_id") / 3) % 9).cast("int")
    inner = F.element_at(F.array(*[F.lit(x) for x in INNER]), slot + 1)
    inner = F.when(inner == "nested", F.concat(F.lit("nested/d"), F.col("doc_id").cast("string"),
                                               F.lit("/agent.log"))).otherwise(inner)
    incident = F.concat(F.lit("inc"), F.floor(F.col("doc_id") / 27).cast("string"))
    rel = F.concat_ws("/", incident, date, an, inner)
    raw = d.select(rel.alias("rel"), "doc_id", F.col("text").alias("content"))
    return raw.groupBy("rel").agg(F.max_by("content", "doc_id").alias("content"))


LISTING_SQL = f"""
SELECT rel, arg_max(content, doc_id) AS content FROM (
  SELECT concat_ws('/', 'inc' || CAST(doc_id // 27 AS VARCHAR),
           CASE WHEN doc_id % 10 = 9 THEN 'misc' ELSE '0' || CAST(n_chars % 3 + 1 AS VARCHAR) || '-15' END,
           CASE WHEN doc_id % 3 = 0 THEN 'Output_run' || CAST(doc_id % 2 AS VARCHAR) ELSE 'raw_run' || CAST(doc_id % 3 AS VARCHAR) END,
           CASE WHEN {S.lit_list(INNER)}[(doc_id // 3) % 9 + 1] = 'nested'
                THEN 'nested/d' || CAST(doc_id AS VARCHAR) || '/agent.log'
                ELSE {S.lit_list(INNER)}[(doc_id // 3) % 9 + 1] END) AS rel, doc_id, text AS content
  FROM ({INJECTED_DOCUMENTS_SQL})) GROUP BY rel
"""
PARSED_SQL = f"""
SELECT rel, content, p[1] AS incident_id, CASE WHEN len(p) >= 3 THEN p[2] END AS date_folder,
       CASE WHEN len(p) >= 4 THEN p[3] END AS analyzer_folder, p[-1] AS file_name, len(p) - 3 AS depth
FROM (SELECT rel, content, string_split(rel, '/') AS p FROM ({LISTING_SQL}))
"""
SELECTED_SQL = f"""
WITH dated AS (SELECT * FROM ({PARSED_SQL}) WHERE regexp_matches(date_folder, '^\\d{{2}}-\\d{{2}}')),
ld AS (SELECT incident_id, max(date_folder) AS date_folder FROM dated GROUP BY incident_id),
o AS (SELECT dated.* FROM dated JOIN ld USING (incident_id, date_folder) WHERE contains(lower(analyzer_folder), 'output')),
la AS (SELECT incident_id, date_folder, max(analyzer_folder) AS analyzer_folder FROM o GROUP BY ALL)
SELECT o.* FROM o JOIN la USING (incident_id, date_folder, analyzer_folder)
"""
KEYS_SQL = f"""
SELECT incident_id, date_folder, analyzer_folder, file_name,
       content, 'key' AS kind
FROM ({SELECTED_SQL}) WHERE depth = 1 AND file_name IN ({', '.join(S.q(x) for x in K.KEY_LOG_FILES)})
"""
NESTED_SQL = f"""
SELECT incident_id, date_folder, analyzer_folder, file_name, arg_max(content, rel) AS content,
       'nested' AS kind
FROM ({SELECTED_SQL}) WHERE depth > 1 AND ends_with(file_name, '.log') GROUP BY ALL
"""


def _sel(spark, sf_dir):
    return cut_lineage(LG.select_newest(listing(spark, sf_dir)), "log-selection")


@register("newest_folder", f"SELECT DISTINCT incident_id, date_folder, analyzer_folder FROM ({SELECTED_SQL})")
def q_newest_folder(spark, sf_dir):
    """W3 + S10: newest dated folder and newest output folder per incident."""
    return _sel(spark, sf_dir).select("incident_id", "date_folder", "analyzer_folder").distinct()


@register("log_insights", f"""
SELECT incident_id, file_name, CAST(n - 1 AS INTEGER) AS n, insight FROM (
  SELECT incident_id, file_name, unnest(m) AS insight, generate_subscripts(m, 1) AS n FROM (
    SELECT incident_id, file_name, list_filter([
      CASE WHEN contains(lower(content), 'error') OR contains(lower(content), 'fail')
           THEN file_name || ': Contains error indicators' END,
      CASE WHEN contains(lower(content), 'policy') THEN file_name || ': Contains policy-related information' END,
      CASE WHEN contains(lower(content), 'device') THEN file_name || ': Contains device-related information' END],
      lambda x: x IS NOT NULL) AS m FROM ({KEYS_SQL})))
""")
def q_log_insights(spark, sf_dir):
    """P22 on the chosen key files."""
    return LG.log_insights(LG.key_files(_sel(spark, sf_dir)))


@register("file_stats", f"""
SELECT incident_id, file_name, kind, CAST(length(content) AS INTEGER) AS chars,
       contains(lower(content), 'error') OR contains(lower(content), 'fail') AS has_error,
       contains(lower(content), 'warn') AS has_warning, true AS flags_checked FROM ({KEYS_SQL})
UNION ALL
SELECT incident_id, file_name, kind, CAST(length(content) AS INTEGER), false, false, false FROM ({NESTED_SQL})
""")
def q_file_stats(spark, sf_dir):
    """Characters and error / warning flags per analysed file."""
    s = _sel(spark, sf_dir)
    return LG.file_stats(LG.key_files(s), LG.nested_logs(s))


@register("log_file_count", f"""
SELECT incident_id, count(*) AS files_analyzed FROM (
  SELECT incident_id FROM ({KEYS_SQL}) UNION ALL SELECT incident_id FROM ({NESTED_SQL})) GROUP BY incident_id
""")
def q_log_file_count(spark, sf_dir):
    """Files analysed per incident."""
    s = _sel(spark, sf_dir)
    return LG.log_file_count(LG.key_files(s), LG.nested_logs(s))


def _cap(x, n):
    return f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '...' ELSE {x} END"


@register("logs_prompt_content", f"""
WITH k AS (SELECT incident_id, 1 AS sec,
             lpad(CAST(list_position({S.lit_list(K.LOG_PROMPT_FILES)}, file_name) AS VARCHAR), 3, '0') AS o, chr(10) || 'FILE: ' || file_name || chr(10) || 'PATH: '
             || incident_id || '/' || date_folder || '/' || analyzer_folder || '/' || file_name || chr(10)
             || 'CONTENT:' || chr(10) || {_cap('content', 500)} AS txt
           FROM ({KEYS_SQL}) WHERE file_name IN ({', '.join(S.q(x) for x in K.LOG_PROMPT_FILES)})),
n AS (SELECT incident_id, 3 AS sec, file_name AS o, chr(10) || 'FILE: ' || file_name || chr(10) || 'PATH: '
             || incident_id || '/' || date_folder || '/' || analyzer_folder || '/' || file_name || chr(10)
             || 'CONTENT:' || chr(10) || {_cap(S.tail('content', K.LOG_TAIL_CAP), 300)} AS txt FROM ({NESTED_SQL})),
fk AS (SELECT incident_id, 1 AS sec,
             lpad(CAST(list_position({S.lit_list(K.KEY_LOG_FILES)}, file_name) AS VARCHAR), 3, '0') AS o,
             concat_ws(chr(10), '- ' || file_name || ': ' || CAST(length(content) AS VARCHAR) || ' characters',
               CASE WHEN contains(lower(content), 'error') OR contains(lower(content), 'fail')
                    THEN '  Contains error indicators' END,
               CASE WHEN contains(lower(content), 'warn') THEN '  Contains warning indicators' END) AS txt
      FROM ({KEYS_SQL})),
fn AS (SELECT incident_id, 3 AS sec, file_name AS o,
              '- ' || file_name || ': ' || CAST(length(content) AS VARCHAR) || ' characters' AS txt FROM ({NESTED_SQL})),
fparts AS (SELECT DISTINCT incident_id, 0 AS sec, '' AS o, 'Log File Analysis:' AS txt FROM fk
           UNION ALL SELECT * FROM fk
           UNION ALL SELECT DISTINCT incident_id, 2, '', chr(10) || 'Additional Logs Analysis:' FROM fn
           UNION ALL SELECT * FROM fn),
fa AS (SELECT incident_id, 5 AS sec, '' AS o, chr(10) || 'COMPREHENSIVE FILE ANALYSIS:' || chr(10)
              || string_agg(txt, chr(10) ORDER BY sec, o, txt) AS txt FROM fparts GROUP BY incident_id),
parts AS (SELECT DISTINCT incident_id, 0 AS sec, '' AS o, chr(10) || 'KEY LOG FILES:' AS txt FROM k
          UNION ALL SELECT * FROM k
          UNION ALL SELECT DISTINCT incident_id, 2, '', chr(10) || 'ADDITIONAL LOGS:' FROM n
          UNION ALL SELECT * FROM n
          UNION ALL SELECT * FROM fa)
SELECT incident_id, string_agg(txt, chr(10) ORDER BY sec, o, txt) AS logs_content FROM parts GROUP BY incident_id
""")
def q_logs_prompt_content(spark, sf_dir):
    """Ordered prompt sections built from the chosen log files."""
    s = _sel(spark, sf_dir)
    return LG.logs_prompt_content(LG.key_files(s), LG.nested_logs(s))


# --------------------------------------------------------------------------- S10 / J14
@register("requested_logs", f"""
SELECT incident_id, date_folder, analyzer_folder, file_name, kind, CAST(length(content) AS INTEGER) AS chars,
       md5(content) AS content_md5
FROM (SELECT * FROM ({KEYS_SQL}) UNION ALL SELECT * FROM ({NESTED_SQL}))
WHERE incident_id IN (SELECT 'inc' || CAST(item_id AS VARCHAR) FROM benchmark)
""")
def q_requested_logs(spark, sf_dir):
    """S10 + J14: the file tree written below the shared checkpoint folder, the
    newest folders of the incidents that the benchmark items name chosen from
    its listing, and only their files read."""
    import uuid

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/casebook-logs-{uuid.uuid4().hex}"
    FT.write_tree(listing(spark, sf_dir), root)
    # each choice reads the listing: made once, in few tasks (Spark's own has one for a few files)
    files = FT.tree_listing(spark, root).coalesce(4 * spark.sparkContext.defaultParallelism)
    files = cut_lineage(files, "log-listing")
    asked = read_table(spark, sf_dir, "benchmark").select(F.concat(F.lit("inc"), F.col("item_id").cast("string")).alias("incident_id"))
    chosen = cut_lineage(LG.wanted_files(files, asked), "log-choice")
    read = FT.tree_contents(spark, chosen)
    both = LG.key_files(read).unionByName(LG.nested_logs(read).select("incident_id", "date_folder", "analyzer_folder", "file_name", "content", "kind"))
    return both.select("incident_id", "date_folder", "analyzer_folder", "file_name", "kind", F.length("content").alias("chars"),
                       F.md5(F.col("content").cast("binary")).alias("content_md5"))


# --------------------------------------------------------------------------- P35 with all sections
_ALL_PARTS = f"""UNION ALL SELECT * FROM fa
UNION ALL SELECT incident_id, 4, '', chr(10) || 'GITHUB REFERENCE:' || chr(10) || arg_min(text, doc_id)
          FROM (SELECT 'inc' || CAST(doc_id // 27 AS VARCHAR) AS incident_id, doc_id, text FROM ({INJECTED_DOCUMENTS_SQL})
                WHERE contains(lower(text), 'github.com')) GROUP BY incident_id
UNION ALL SELECT 'inc' || CAST(item_id AS VARCHAR), -1, '', 'INCIDENT SUMMARY:' || chr(10) || {_cap('text', 1000)}
          FROM benchmark WHERE coalesce(text, '') <> '')"""


@register("logs_prompt_complete", ORACLES["logs_prompt_content"].replace("UNION ALL SELECT * FROM fa)", _ALL_PARTS))
def q_logs_prompt_complete(spark, sf_dir):
    """P35 with every section: the incident summary and the first message that
    mentions a repository, too."""
    s = _sel(spark, sf_dir)
    d = injected_documents(spark, sf_dir)
    messages = d.select(F.concat(F.lit("inc"), F.floor(F.col("doc_id") / 27).cast("string")).alias("incident_id"),
                        F.col("doc_id").alias("ts"), F.lit(0).alias("pos"), F.col("text").alias("content"))
    summaries = read_table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("inc"), F.col("item_id").cast("string")).alias("incident_id"), F.col("text").alias("summary"))
    return LG.logs_prompt_content(LG.key_files(s), LG.nested_logs(s), summaries, messages)
