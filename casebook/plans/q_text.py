"""Driver queries for the text-cleaning projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..session import read_table
from . import sqltext as S
from .registry import register


# FIXED VALUES — markup appended to the pages (by page_id % 4)
PAGE_EXTRA = ["<p>if a < 5 and b > 3 then</p>", "<a title=\"1 > 0\">x</a>", " it&#8217;s caf&eacute;&hellip;&nbsp;end"]
PAGES_SQL = ("SELECT page_id, html || CASE page_id % 4 " + " ".join(f"WHEN {i} THEN {S.q(x)}" for i, x in enumerate(PAGE_EXTRA))
             + " ELSE '' END AS html FROM pages")


@register("clean_html", f"""
SELECT page_id, {S.clean_html('html')} AS text, CAST(length({S.clean_html('html')}) AS INTEGER) AS n_chars FROM ({PAGES_SQL})
""")
def q_clean_html(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    extra = F.lit("")
    for i, x in enumerate(PAGE_EXTRA):
        extra = F.when(F.col("page_id") % 4 == i, F.lit(x)).otherwise(extra)
    cleaned = p.select("page_id", T.clean_html(F.concat(F.col("html"), extra)).alias("text"))
    return cleaned.select("page_id", "text", F.length("text").alias("n_chars"))


from ..functions import constants as K  # noqa: E402
from ..operators import screenshots as SS  # noqa: E402
from .inputs import (  # noqa: E402
    INJECTED_DOCUMENTS_SQL,
    SERVICE_BOILERPLATE,
    SUPPORT_SECTION_TITLE,
    injected_documents,
)

# FIXED VALUES — extra image markers for the screenshot queries (by doc_id % 5)
SHOT_EXTRA_0 = " data:image/jpeg;base64,QUJDRA== and again data:image/png;base64,QUJD"
SHOT_EXTRA_1 = " data:image/gif;base64,QUJ DATA:IMAGE/PNG;base64,QUJD"
SHOT_EXTRA_2 = " data:image/png;base64,QUJD= and data:image/png;base64,QUJDRA==QUJD or data:image/png;base64,QU=JDR="


def _shot_docs(spark, sf_dir):
    d = injected_documents(spark, sf_dir)
    k = F.col("doc_id") % 5
    extra = (F.when(k == 0, F.lit(SHOT_EXTRA_0)).when(k == 1, F.lit(SHOT_EXTRA_1))
             .when(k == 2, F.lit(SHOT_EXTRA_2)).otherwise(F.lit("")))
    return d.select("doc_id", F.concat(F.col("text"), extra).alias("text"))


SHOT_DOCS_SQL = (f"SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN {S.q(SHOT_EXTRA_0)} "
                 f"WHEN 1 THEN {S.q(SHOT_EXTRA_1)} WHEN 2 THEN {S.q(SHOT_EXTRA_2)} ELSE '' END AS text FROM ({INJECTED_DOCUMENTS_SQL})")


@register("redact_image_data", f"""
SELECT doc_id, {S.redact_image_data('text')} AS text FROM ({SHOT_DOCS_SQL})
""")
def q_redact_image_data(spark, sf_dir):
    d = _shot_docs(spark, sf_dir)
    return d.select("doc_id", T.redact_image_data(F.col("text")).alias("text"))


@register("extract_data_urls", f"""
WITH i AS (SELECT doc_id, text, {S.screenshot_items('doc_id', 'text')} AS items FROM ({SHOT_DOCS_SQL}))
SELECT doc_id,
       list_reduce(items, lambda acc, x: CASE WHEN x.ok THEN replace(acc, x.url, '[SCREENSHOT: ' || x.name || ']')
                   ELSE acc END, text) AS processed_text,
       len(list_filter(items, lambda x: x.ok)) AS screenshot_count
FROM i
""")
def q_extract_data_urls(spark, sf_dir):
    d = _shot_docs(spark, sf_dir)
    return SS.extract_screenshots(d, "doc_id", "text").select(
        "doc_id", "processed_text", F.col("screenshot_count").cast("bigint").alias("screenshot_count"))


@register("screenshot_images", f"""
WITH i AS (SELECT doc_id, {S.screenshot_items('doc_id', 'text')} AS items FROM ({SHOT_DOCS_SQL})),
e AS (SELECT doc_id, unnest(items) AS it, generate_subscripts(items, 1) AS image_no FROM i)
SELECT doc_id, CAST(image_no AS INTEGER) AS image_no, it.name AS name,
       CASE regexp_extract(it.url, '^data:image/([^;]+);', 1)
         {' '.join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in K.IMAGE_EXTENSIONS.items())}
         ELSE {S.q(K.DEFAULT_IMAGE_EXTENSION)} END AS extension,
       CAST(octet_length({S.data_url_bytes('it.url')}) AS INTEGER) AS n_bytes
FROM e WHERE it.ok
""")
def q_screenshot_images(spark, sf_dir):
    imgs = SS.screenshot_images(_shot_docs(spark, sf_dir), "doc_id", "text")
    return imgs.select("doc_id", "image_no", "name", "extension", F.length("image").alias("n_bytes"))


@register("screenshot_counts", f"""
WITH i AS (SELECT doc_id % 20 AS bucket, len(list_filter({S.screenshot_items('doc_id', 'text')}, lambda x: x.ok)) AS n
           FROM ({SHOT_DOCS_SQL}))
SELECT bucket, CAST(sum(n) AS BIGINT) AS screenshots, count(*) AS docs FROM i GROUP BY bucket
""")
def q_screenshot_counts(spark, sf_dir):
    """Decoded images per group and total (grouped by a doc bucket)."""
    x = SS.extract_screenshots(_shot_docs(spark, sf_dir), "doc_id", "text")
    return (x.groupBy((F.col("doc_id") % 20).alias("bucket"))
            .agg(F.sum("screenshot_count").cast("bigint").alias("screenshots"),
                 F.count(F.lit(1)).alias("docs")))


@register("strip_support_section", f"""
SELECT doc_id, {S.strip_support_section('text', SUPPORT_SECTION_TITLE)} AS text,
       {S.strip_support_section('text', SUPPORT_SECTION_TITLE)} IS DISTINCT FROM text AS changed
FROM ({INJECTED_DOCUMENTS_SQL})
""")
def q_strip_support_section(spark, sf_dir):
    d = injected_documents(spark, sf_dir)
    s = T.strip_support_section(F.col("text"), SUPPORT_SECTION_TITLE)
    return d.select("doc_id", s.alias("text"), (~s.eqNullSafe(F.col("text"))).alias("changed"))


# Noise phrases of the line denoising query (the operator takes any list)
NOISE_PHRASES = ["Transferred from", "Acknowledging incident", SERVICE_BOILERPLATE]
# Phrases present in the driver prose, so the filter has an effect on it.
DATA_NOISE_PHRASES = ["nicht", "pour"]


@register("denoise_lines", f"""
SELECT doc_id, {S.denoise_lines('text', NOISE_PHRASES + DATA_NOISE_PHRASES)} AS text
FROM ({INJECTED_DOCUMENTS_SQL})
""")
def q_denoise_lines(spark, sf_dir):
    d = injected_documents(spark, sf_dir)
    return d.select("doc_id", T.denoise_lines(F.col("text"), NOISE_PHRASES + DATA_NOISE_PHRASES).alias("text"))


@register("truncate_text", f"""
SELECT doc_id,
       {S.head('text', K.CELL_CAP, K.CELL_CAP_SUFFIX)} AS cell_text,
       {S.head('text', K.FILE_HEAD_CAP, K.FILE_HEAD_SUFFIX)} AS file_head,
       {S.tail('text', K.LOG_TAIL_CAP)} AS log_tail,
       {S.head('text', 500, '...')} AS short_text
FROM documents
""")
def q_truncate_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        T.head(F.col("text"), K.CELL_CAP, K.CELL_CAP_SUFFIX).alias("cell_text"),
        T.head(F.col("text"), K.FILE_HEAD_CAP, K.FILE_HEAD_SUFFIX).alias("file_head"),
        T.tail(F.col("text"), K.LOG_TAIL_CAP).alias("log_tail"),
        T.head(F.col("text"), 500, "...").alias("short_text"),
    )


DOC_PATH_SQL = "source || '/' || lang || '_' || CAST(doc_id AS VARCHAR) || '-guide.md'"


@register("title_from_path", f"""
SELECT 'page' AS kind, page_id AS id, url AS path, {S.title_from_path('url')} AS title FROM pages
UNION ALL
SELECT 'document', doc_id, {DOC_PATH_SQL}, {S.title_from_path(DOC_PATH_SQL)} FROM documents
""")
def q_title_from_path(spark, sf_dir):
    """P7 of every page's address and every document's path."""
    p = read_table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("path"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"),
                    F.lit("-guide.md"))
    d = read_table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), path.alias("path"))
    return p.unionByName(d).withColumn("title", T.title_from_path(F.col("path")))


@register("article_summary", f"""
SELECT doc_id, {S.article_summary('text')} AS summary FROM documents
""")
def q_article_summary(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", T.article_summary(F.col("text")).alias("summary"))


@register("incident_id_from_name", f"""
SELECT page_id, {S.incident_id_from_name("'incident_' || CAST(page_id AS VARCHAR) || '.csv'")} AS from_file,
       {S.incident_id_from_name('url')} AS from_url,
       regexp_replace(regexp_extract(url, '[^/]*$'), '\\D', '', 'g') AS digits_only
FROM pages
""")
def q_incident_id_from_name(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    f = F.concat(F.lit("incident_"), F.col("page_id").cast("string"), F.lit(".csv"))
    return p.select("page_id", T.incident_id_from_name(f).alias("from_file"),
                    T.incident_id_from_name(F.col("url")).alias("from_url"),
                    T.digits_only(F.col("url")).alias("digits_only"))


@register("preview", f"""
SELECT doc_id, {S.preview('text', 600)} AS preview_600, {S.preview('text', 1000)} AS preview_1000
FROM documents
""")
def q_preview(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", T.preview(F.col("text"), 600).alias("preview_600"),
                    T.preview(F.col("text"), 1000).alias("preview_1000"))


@register("redaction_gate", f"""
SELECT doc_id, {S.is_redacted('text')} AS is_redacted,
       CASE WHEN {S.is_redacted('text')} THEN 'quarantined' ELSE 'passed' END AS route
FROM ({INJECTED_DOCUMENTS_SQL})
""")
def q_redaction_gate(spark, sf_dir):
    """F-2 + F-3: redacted summaries are routed to quarantine, never dropped."""
    d = injected_documents(spark, sf_dir)
    r = T.is_redacted(F.col("text"))
    return d.select("doc_id", r.alias("is_redacted"),
                    F.when(r, F.lit("quarantined")).otherwise(F.lit("passed")).alias("route"))


@register("keyword_csv", f"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), ','),
         lambda x: {S.strip_ws('x')}), lambda x: x <> ''), '|') AS keywords
FROM documents
""")
def q_keyword_csv(spark, sf_dir):
    """P33 on each whole document read as a comma-separated list."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(T.keyword_csv(F.col("text")), "|").alias("keywords"))


@register("article_text", f"""
WITH a AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '  ' || chr(10) ELSE text END AS content,
                  CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN ' ' ELSE 'summary of ' || CAST(doc_id AS VARCHAR) END
                    AS content_summary FROM documents),
f AS (SELECT page_id AS doc_id, {S.clean_html('html')} AS file_text FROM pages)
SELECT doc_id, full_text FROM (
  SELECT a.doc_id, coalesce(nullif(a.content, ''), f.file_text, a.content_summary) AS full_text
  FROM a LEFT JOIN f USING (doc_id))
WHERE {S.strip_ws("coalesce(full_text, '')")} <> ''
""")
def q_article_text(spark, sf_dir):
    """S9 + F-9: inline content, else the page text, else the stored summary;
    blank articles skipped."""
    from ..sources.readers import resolve_article_text

    d = read_table(spark, sf_dir, "documents")
    k6, k4 = F.col("doc_id") % 6, F.col("doc_id") % 4
    arts = d.select("doc_id",
                    F.when(k6 == 0, F.lit("")).when(k6 == 1, F.lit("  \n")).otherwise(F.col("text")).alias("content"),
                    F.when(k4 == 0, F.lit(None).cast("string")).when(k4 == 1, F.lit(" "))
                    .otherwise(F.concat(F.lit("summary of "), F.col("doc_id").cast("string"))).alias("content_summary"))
    files = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"),
                                                       T.clean_html(F.col("html")).alias("file_text"))
    return resolve_article_text(arts, files, "doc_id").select("doc_id", "full_text")
