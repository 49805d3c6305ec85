"""Driver queries for the stores: each writes whole tables through a sink into
the shared checkpoint folder and reads them back (S5, S6, S8, K3-K5, K7, K8,
W10 on appended memories, J9 on what a store returns)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import vectors as V
from ..session import ensure_checkpoint_dir, read_table
from ..sinks import writers as W
from ..sources import readers as RD
from ..sources.section_csv import redacted_files
from . import sqltext as S
from .q_activity import ops
from .q_retrieval import EMB_SQL, cos_sql
from .q_text import SHOT_DOCS_SQL, _shot_docs
from .registry import ORACLES, register

FILE_ROWS = 200  # rows that one catalogue or vector file holds


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/casebook-{name}-{uuid.uuid4().hex}"


def _documents_of(rows: DataFrame, block: str, value) -> DataFrame:
    """One JSON text per block of at most ``FILE_ROWS`` rows."""
    return rows.groupBy(block).agg(value.alias("value"))


def _files(docs: DataFrame, block: str, path: str) -> None:
    """One file per row."""
    docs.repartition(F.col(block)).write.partitionBy(block).text(path)


# --------------------------------------------------------------------------- S8
@register("vector_db_shapes", f"""
SELECT 'kb/vec_' || CAST(vec_id AS VARCHAR) || '.md' AS article_path, CAST(len(embedding) AS INTEGER) AS dims,
       CASE WHEN vec_id // {FILE_ROWS} % 3 <> 2 THEN 'Vector ' || CAST(vec_id AS VARCHAR) END AS title,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS checksum
FROM embeddings WHERE len(embedding) > 0
""")
def q_vector_db_shapes(spark, sf_dir):
    """Vector files of the three shapes in turn (a list of articles, an
    object of articles, an object of vectors by path), one document a file."""
    path = F.concat(F.lit("kb/vec_"), F.col("vec_id").cast("string"), F.lit(".md"))
    e = read_table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / FILE_ROWS).alias("block"), path.alias("article_path"),
        F.concat(F.lit("Vector "), F.col("vec_id").cast("string")).alias("title"), F.col("embedding"))
    arts = F.collect_list(F.struct("article_path", "title", "embedding"))
    by_path = F.map_from_entries(F.collect_list(F.struct("article_path", "embedding")))
    shape = F.first("block") % 3
    value = (F.when(shape == 0, F.to_json(arts)).when(shape == 1, F.to_json(F.struct(arts.alias("articles"))))
             .otherwise(F.to_json(F.struct(by_path.alias("embeddings")))))
    out = _folder(spark, "vector-shapes")
    _files(_documents_of(e, "block", value), "block", out)
    v = RD.vector_db(spark, out).filter(F.col("embedding").isNotNull())
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return v.select("article_path", F.size("embedding").alias("dims"), "title", F.round(total, 4).alias("checksum"))


# --------------------------------------------------------------------------- S5 / S6
@register("example_catalog_roundtrip", f"""
SELECT lang || '_' || CAST(doc_id // {FILE_ROWS} AS VARCHAR) AS prompt_type,
       CAST(row_number() OVER (PARTITION BY lang, doc_id // {FILE_ROWS} ORDER BY doc_id) - 1 AS INTEGER) AS ordinal,
       source || '|' || lang AS keywords, CASE WHEN doc_id % 3 = 0 THEN 'high' END AS severity, source AS category,
       md5(text) AS input_md5, 'document ' || CAST(doc_id AS VARCHAR) AS output
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL
""")
def q_example_catalog_roundtrip(spark, sf_dir):
    """Every document as an example of its catalogue file, read back."""
    d = read_table(spark, sf_dir, "documents").filter(
        F.col("lang").isNotNull() & F.col("source").isNotNull() & F.col("text").isNotNull())
    block = F.floor(F.col("doc_id") / FILE_ROWS)
    item = F.struct("doc_id", F.struct(
        F.array("source", "lang").alias("keywords"), F.when(F.col("doc_id") % 3 == 0, F.lit("high")).alias("severity"),
        F.col("source").alias("category"),
        F.struct(F.col("text").alias("input"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("output"))
        .alias("example")).alias("x"))
    rows = d.select(F.concat("lang", F.lit("_"), block.cast("string")).alias("name"), item.alias("item"))
    xs = F.transform(F.sort_array(F.collect_list("item")), lambda s: s["x"])
    docs = _documents_of(rows, "name", F.to_json(F.create_map(F.first("name"), xs)))
    out = _folder(spark, "examples")
    _files(docs, "name", out)
    c = RD.example_catalog(spark, out)
    return c.select("prompt_type", "ordinal", F.array_join("keywords", "|").alias("keywords"), "severity", "category",
                    F.md5(F.col("input").cast("binary")).alias("input_md5"), "output")


@register("prompt_catalog_roundtrip", """
SELECT 'item_' || CAST(item_id AS VARCHAR) AS prompt_type, 'System ' || CAST(item_id AS VARCHAR) AS system_prompt,
       md5(text) AS user_prompt_md5, CASE WHEN item_id % 2 = 0 THEN 'short|exact' END AS additional_guidelines
FROM benchmark WHERE text IS NOT NULL
""")
def q_prompt_catalog_roundtrip(spark, sf_dir):
    """Every benchmark item as a prompt type of a catalogue file, read back."""
    b = read_table(spark, sf_dir, "benchmark").filter(F.col("text").isNotNull())
    name = F.concat(F.lit("item_"), F.col("item_id").cast("string"))
    prompt = F.struct(F.concat(F.lit("System "), F.col("item_id").cast("string")).alias("system_prompt"),
                      F.col("text").alias("user_prompt"),
                      F.when(F.col("item_id") % 2 == 0, F.array(F.lit("short"), F.lit("exact"))).alias("additional_guidelines"))
    rows = b.select(F.floor(F.col("item_id") / FILE_ROWS).alias("block"), F.struct(name.alias("k"), prompt.alias("v")).alias("kv"))
    out = _folder(spark, "prompts")
    _files(_documents_of(rows, "block", F.to_json(F.map_from_entries(F.collect_list("kv")))), "block", out)
    c = RD.prompt_catalog(spark, out)
    return c.select("prompt_type", "system_prompt", F.md5(F.col("user_prompt").cast("binary")).alias("user_prompt_md5"),
                    F.array_join("additional_guidelines", "|").alias("additional_guidelines"))


# --------------------------------------------------------------------------- K3
@register("result_sink_roundtrip", """
SELECT CAST(doc_id AS VARCHAR) AS incident_id, lang || '_summary' AS prompt_type, md5(text) AS content_md5,
       'Summary of ' || CAST(doc_id AS VARCHAR) AS ai_summary, 'offline' AS model_used
FROM documents WHERE lang IS NOT NULL
""")
def q_result_sink_roundtrip(spark, sf_dir):
    """K3: one result per document through the sink; the full records joined
    with the slim ones."""
    d = read_table(spark, sf_dir, "documents").filter(F.col("lang").isNotNull())
    res = d.select(F.col("doc_id").cast("string").alias("incident_id"), F.concat("lang", F.lit("_summary")).alias("prompt_type"),
                   F.concat(F.lit("Summary of "), F.col("doc_id").cast("string")).alias("ai_summary"),
                   F.lit("2024-01-01T00:00:00").alias("operation_time"), F.lit("offline").alias("model_used"),
                   F.col("text").alias("content"))
    out = _folder(spark, "results")
    W.result_sink(res, out)
    full = spark.read.schema("incident_id string, content string, prompt_type string").json(f"{out}/processed")
    slim = spark.read.schema("incident_id string, ai_summary string, model_used string, prompt_type string").json(f"{out}/summaries")
    return full.join(slim, ["incident_id", "prompt_type"]).select(
        "incident_id", "prompt_type", F.md5(F.col("content").cast("binary")).alias("content_md5"), "ai_summary", "model_used")


# --------------------------------------------------------------------------- K4
@register("example_append_roundtrip", """
SELECT lang AS prompt_type, source || '|' || lang AS keywords, source AS category, md5(text) AS input_md5,
       CAST(doc_id AS VARCHAR) AS output
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL
""")
def q_example_append_roundtrip(spark, sf_dir):
    """K4: the documents appended in two runs; the second brings new sections too."""
    d = read_table(spark, sf_dir, "documents").filter(F.col("lang").isNotNull() & F.col("source").isNotNull())
    ex = d.select("doc_id", F.col("lang").alias("prompt_type"), F.array("source", "lang").alias("keywords"),
                  F.col("source").alias("category"), F.col("text").alias("input"), F.col("doc_id").cast("string").alias("output"))
    out = _folder(spark, "example-store")
    W.example_append(ex.filter(F.col("doc_id") % 2 == 0), out)
    W.example_append(ex.filter(F.col("doc_id") % 2 == 1), out)
    return spark.read.parquet(out).select(
        F.col("prompt_type").cast("string").alias("prompt_type"), F.array_join("keywords", "|").alias("keywords"), "category",
        F.md5(F.col("input").cast("binary")).alias("input_md5"), "output")


# --------------------------------------------------------------------------- K5, W10 on a store, J9
@register("memory_store_knn", f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN v ELSE list_reverse(v) END AS v FROM ({EMB_SQL})),
s AS (SELECT a.vec_id AS q_id, b.vec_id AS i_id, {cos_sql('a.v', 'b.v')} AS sim
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v))
SELECT q_id, i_id, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(sim, 12) DESC, i_id) AS rank FROM s) WHERE rank <= 3
""")
def q_memory_store_knn(spark, sf_dir):
    """K5 -> latest per incident -> J9: every vector stored reversed, every
    third stored again as it is; neighbours among what the store holds last."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    out = _folder(spark, "memories")
    W.memory_append(e.withColumn("embedding", F.reverse("embedding")), out)
    W.memory_append(e.filter(F.col("vec_id") % 3 == 0), out)
    now = RD.latest_per_key(spark.read.parquet(out), "vec_id", "stored_at")
    r = V.cosine_knn(now, "vec_id", "embedding", now, "vec_id", "embedding", 3, exclude_self=True)
    return r.select("q_id", "i_id", F.round("similarity", 6).alias("similarity"), "rank")


# --------------------------------------------------------------------------- K7
@register("processed_summary_roundtrip", f"""
WITH i AS (SELECT doc_id, text, {S.screenshot_items('doc_id', 'text')} AS items FROM ({SHOT_DOCS_SQL}))
SELECT doc_id, list_reduce(items, lambda acc, x: CASE WHEN x.ok THEN replace(acc, x.url, '[SCREENSHOT: ' || x.name || ']')
                           ELSE acc END, text) AS text, len(list_filter(items, lambda x: x.ok)) AS screenshot_count
FROM i
""")
def q_processed_summary_roundtrip(spark, sf_dir):
    """K7: processed summaries through the sink and back."""
    out = _folder(spark, "processed")
    W.processed_summary_sink(_shot_docs(spark, sf_dir), out, "text", "doc_id")
    return spark.read.parquet(out).select("doc_id", "text", F.col("screenshot_count").cast("bigint").alias("screenshot_count"))


# --------------------------------------------------------------------------- K8
@register("timing_report_roundtrip", f"""
SELECT 'by_category' AS section, session_ts, category, operation_count AS operations, total_time AS seconds
FROM ({ORACLES['timing_by_category']}), (VALUES ('2024-01-01'), ('2024-01-02')) s(session_ts)
UNION ALL
SELECT 'slowest', session_ts, category, operation_id, round(duration, 6)
FROM ({ORACLES['slowest_ops']}), (VALUES ('2024-01-01'), ('2024-01-02')) s(session_ts)
""")
def q_timing_report_roundtrip(spark, sf_dir):
    """K8: the reports of two sessions appended and read back."""
    o = ops(spark, sf_dir)
    out = _folder(spark, "timing")
    for session in ("2024-01-01", "2024-01-02"):
        W.timing_report_sink(A.timing_by_category(o), A.slowest(o), out, session)
    cats = spark.read.parquet(f"{out}/by_category").select(
        F.lit("by_category").alias("section"), "session_ts", "category", F.col("operation_count").alias("operations"),
        F.round("total_time", 6).alias("seconds"))
    slow = spark.read.parquet(f"{out}/slowest").select(
        F.lit("slowest").alias("section"), "session_ts", "category", F.col("operation_id").alias("operations"),
        F.round("duration", 6).alias("seconds"))
    return cats.unionByName(slow)


# --------------------------------------------------------------------------- S2 / W5 / W10 / F-2
def _section_files(spark, sf_dir) -> str:
    """Every document in a section of its own, ``FILE_ROWS`` documents a file:
    opened with a stale row, closed by a nameless mark, opened again with the
    row that counts (and a second one where the id leaves 4 by 7).  The file ends
    with an authored summary, redacted in every third file."""
    d = read_table(spark, sf_dir, "documents")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    name = F.concat(F.lit("--- Document "), F.col("doc_id").cast("string"), F.lit(" ---\n"))
    piece = F.concat(name, F.lit("Id,Text\nstale,row\n---\nId,Text\nno,section\n"), name, F.lit("Id,Text,Lang\n"),
                     F.col("doc_id").cast("string"), F.lit(","), quoted(F.coalesce("text", F.lit(""))), F.lit(","),
                     F.coalesce("lang", F.lit("")), F.when(F.col("doc_id") % 7 == 4, F.lit("\n,** REDACTED **")).otherwise(F.lit("")))
    rows = d.select(F.floor(F.col("doc_id") / FILE_ROWS).alias("block"), F.struct("doc_id", piece.alias("p")).alias("p"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["p"]), "\n")
    summary = F.when(F.first("block") % 3 == 0, F.lit("** redacted **")).otherwise(F.lit("fine"))
    out = _folder(spark, "sections")
    _files(_documents_of(rows, "block", F.concat(text, F.lit("\n--- Authored summary ---\nSummary\n"), summary)), "block", out)
    return out


@register("section_csv_reopened", """
SELECT 'Document ' || CAST(doc_id AS VARCHAR) AS section, 0 AS row_no, CAST(doc_id AS VARCHAR) AS id,
       md5(coalesce(text, '')) AS text_md5, coalesce(lang, '') AS lang, 0 AS bad_rows
FROM documents
UNION ALL
SELECT 'Document ' || CAST(doc_id AS VARCHAR), 1, '', md5('** REDACTED **'), NULL, 0 FROM documents WHERE doc_id % 7 = 4
""")
def q_section_csv_reopened(spark, sf_dir):
    """Files of many sections, nameless and opened again, read in
    splits; whole cells."""
    s = RD.multi_section_csv(spark, _section_files(spark, sf_dir), cell_cap=None).filter(F.col("section") != "Authored summary")
    row = F.col("row")
    return s.select("section", "row_no", row["Id"].alias("id"), F.md5(row["Text"].cast("binary")).alias("text_md5"),
                    row["Lang"].alias("lang"), "bad_rows")


@register("section_csv_redaction", f"""
SELECT CAST(doc_id // {FILE_ROWS} AS VARCHAR) AS block, (doc_id // {FILE_ROWS}) % 3 = 0 AS redacted
FROM documents GROUP BY doc_id // {FILE_ROWS}
""")
def q_section_csv_redaction(spark, sf_dir):
    """F-2 over section files: any cell of the authored summary."""
    r = redacted_files(spark, _section_files(spark, sf_dir))
    return r.select(F.regexp_extract("path", r"block=([^/]+)/", 1).alias("block"), "redacted")


# --------------------------------------------------------------------------- K3-K5, K8: repeated runs
@register("repeated_runs", """
SELECT lang AS prompt_type, run, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
FROM documents, (VALUES ('first'), ('second')) AS r(run) WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang, run
""")
def q_repeated_runs(spark, sf_dir):
    """K4 by two runs, the second one repeated as after a failure: every
    document is there once for each run."""
    d = read_table(spark, sf_dir, "documents").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = d.select(F.col("lang").alias("prompt_type"), F.array("source").alias("keywords"), F.col("source").alias("category"),
                    F.col("text").alias("input"), F.col("doc_id").cast("string").alias("output"))
    out = _folder(spark, "repeated-runs")
    for run in ("first", "second", "second"):
        W.example_append(rows, out, run)
    got = spark.read.parquet(out)
    return got.groupBy("prompt_type", "run").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("input").cast("long")).alias("chars"))
