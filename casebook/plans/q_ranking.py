"""Driver queries for scoring, ranking, explanation and reply parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as SC
from ..functions import text as T
from ..operators import ranking as RK
from ..session import cut_lineage, read_table
from . import sqltext as S
from .q_retrieval import CANDIDATES, _r4_sql, r4_candidates
from .registry import register

TOP_K = 5
# first-stage similarities are sums whose last bits depend on summation
# order; they are rounded (exactly) to this many decimals before scoring
SIM_DIGITS = 10
PATH_SQL = "source || '/' || lang || '_' || CAST(doc_id AS VARCHAR) || '.md'"


def article_path(c_source="source", c_lang="lang", c_id="doc_id"):
    return F.concat(F.col(c_source), F.lit("/"), F.col(c_lang), F.lit("_"), F.col(c_id).cast("string"), F.lit(".md"))


def candidates(spark, sf_dir):
    """R6 stage 1 with every query falling back to R4 (the documents carry no
    vectors), joined to titles and summaries.  The search's rows are staged, so
    that a few of them are sent to the documents, not the documents to them."""
    c = cut_lineage(r4_candidates(spark, sf_dir), "first-stage")
    d = read_table(spark, sf_dir, "documents").select(
        "doc_id", article_path().alias("article_path"), T.article_summary(F.col("text")).alias("content_summary"))
    b = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query_text"))
    return (c.join(d, "doc_id").join(b, "item_id")
            .select(F.col("item_id").alias("q_id"), F.col("rank").alias("cand_pos"), "doc_id", "article_path",
                    T.title_from_path(F.col("article_path")).alias("title"), "content_summary", "query_text",
                    F.lit("").alias("context"),
                    SC.exact_round(F.col("score"), SIM_DIGITS).alias("semantic_similarity")))


def cands_sql(queries: str = "benchmark", qkey: str = "item_id", qtext: str = "text", ctx: str = "''",
              first: str = "") -> str:
    """``first``: the first stage's rows, with a ``stage``; else R4 for every query."""
    stage = ", r.stage" if first else ""
    first = first or _r4_sql(CANDIDATES, queries, qkey, qtext).replace("round(score, 6) AS score", "score")
    return f"""
SELECT r.{qkey} AS q_id, CAST(r.rank AS INTEGER) AS cand_pos, r.doc_id, {PATH_SQL} AS article_path,
       {S.title_from_path(PATH_SQL)} AS title, {S.article_summary('d.text')} AS content_summary,
       b.{qtext} AS query_text, {ctx} AS context, {S.exact_round('r.score', SIM_DIGITS)} AS semantic_similarity{stage}
FROM ({first}) r
JOIN documents d USING (doc_id) JOIN ({queries}) b USING ({qkey})
"""


def norm_sql(cands: str) -> str:
    return f"""
SELECT c.*, CASE WHEN m.mx - m.mn < 1e-8 THEN 6.0
                 ELSE 3.0 + (semantic_similarity - m.mn) * 6.0 / (m.mx - m.mn) END AS norm
FROM ({cands}) c JOIN (SELECT q_id, min(semantic_similarity) AS mn, max(semantic_similarity) AS mx
                       FROM ({cands}) GROUP BY q_id) m USING (q_id)
"""


OV = S.jaccard(S.term_set("query_text || chr(10) || coalesce(context, '')"), S.term_set("content_summary"))


def scored_sql(cands: str) -> str:
    return f"""
SELECT *, {S.exact_round('least(10.0, norm + least(1.0, ov * 2.0))', 2)} AS llm_relevance_score,
       'Heuristic: semantic similarity ' || {S.fmt_fixed('semantic_similarity', 3)} || ' + token overlap '
         || {S.fmt_fixed('ov', 3)} AS llm_reasoning
FROM (SELECT *, {OV} AS ov FROM ({norm_sql(cands)}))
"""


def ranked_sql(cands: str) -> str:
    return f"""
SELECT *, {S.heuristic_explanation('query_text', 'context', 'title', 'content_summary', 'llm_relevance_score')}
          AS intelligent_explanation, llm_relevance_score AS relevance_score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY llm_relevance_score DESC, cand_pos) AS INTEGER) AS rank
  FROM ({scored_sql(cands)})) WHERE rank <= {TOP_K}
"""


def formatted_sql(ranked: str) -> str:
    return f"""
SELECT q_id, count(*) AS n_results, string_agg(CAST(rank AS VARCHAR) || '. ' || coalesce(title, 'Unknown Title') || chr(10)
  || '   URL: ' || coalesce(article_path, 'No URL available') || chr(10)
  || '   Relevance Score: ' || {S.tenths_text('coalesce(relevance_score, 0.0)')} || '/10' || chr(10)
  || CASE WHEN coalesce(intelligent_explanation, '') <> ''
          THEN '   Why relevant: ' || intelligent_explanation || chr(10) ELSE '' END, chr(10) ORDER BY rank)
  AS formatted_results
FROM ({ranked}) GROUP BY q_id
"""


CANDS_SQL = cands_sql()
NORM_SQL = norm_sql(CANDS_SQL)
SCORED_SQL = scored_sql(CANDS_SQL)
RANKED_SQL = ranked_sql(CANDS_SQL)


def advanced(spark, sf_dir):
    scored = RK.score_candidates(cut_lineage(candidates(spark, sf_dir), "search-candidates"), None)
    ranked = RK.rank_candidates(scored, TOP_K)
    return RK.heuristic_explanation(ranked)


@register("advanced_search", f"""
SELECT q_id, rank, doc_id, article_path, title, round(semantic_similarity, 6) AS semantic_similarity,
       llm_relevance_score, llm_reasoning, intelligent_explanation, relevance_score
FROM ({RANKED_SQL})
""")
def q_advanced_search(spark, sf_dir):
    """R6 (+R2, W1, W2, P32, J11, O2, O5): candidates -> heuristic score ->
    order -> explanation -> top 5 per query."""
    r = advanced(spark, sf_dir)
    return r.select("q_id", "rank", "doc_id", "article_path", "title",
                    F.round("semantic_similarity", 6).alias("semantic_similarity"),
                    "llm_relevance_score", "llm_reasoning", "intelligent_explanation", "relevance_score")


@register("minmax_per_query", f"""
SELECT q_id, cand_pos, doc_id, round(norm, 6) AS norm FROM ({NORM_SQL})
""")
def q_minmax_per_query(spark, sf_dir):
    """W1 over every query's first-stage candidates."""
    n = RK.minmax_scale(cut_lineage(candidates(spark, sf_dir), "search-candidates"), "q_id", "semantic_similarity")
    return n.select("q_id", "cand_pos", "doc_id", F.round("norm", 6).alias("norm"))


@register("format_results", f"""
SELECT q_id, formatted_results FROM ({formatted_sql(RANKED_SQL)})
""")
def q_format_results(spark, sf_dir):
    """P31 on the advanced-search results (the article path is the URL)."""
    r = advanced(spark, sf_dir).withColumnRenamed("article_path", "url")
    return RK.format_results(r)


REPLY_SQL = """CASE doc_id % 8
  WHEN 0 THEN 'Score: ' || CAST(quality * 7 + toxic AS STRING)
  WHEN 1 THEN CAST(doc_id % 11 AS STRING) || '.5/10'
  WHEN 2 THEN 'I would say ' || CAST(doc_id % 13 AS STRING) || ' out of 10'
  WHEN 3 THEN 'Relevance: ' || CAST(doc_id % 9 AS STRING)
  WHEN 4 THEN 'Reasoning first' || chr(10) || CAST(doc_id % 50 AS STRING)
  WHEN 5 THEN 'about ' || CAST(doc_id AS STRING) || ' things'
  WHEN 6 THEN 'no number here'
  ELSE '' END"""
COMPARE_SQL = """CASE doc_id % 5 WHEN 0 THEN '1' WHEN 1 THEN ' -1' WHEN 2 THEN '0' WHEN 3 THEN 'Equal' ELSE '10' END"""


def _replies(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    return lab.select("doc_id", "quality", "toxic", F.expr(REPLY_SQL).alias("reply"),
                      F.expr(COMPARE_SQL).alias("comparison_reply"))


@register("parse_replies", f"""
SELECT doc_id, reply, {S.relevance_score('reply')} AS score, comparison_reply,
       {S.comparison_result('comparison_reply')} AS comparison
FROM (SELECT doc_id, {REPLY_SQL} AS reply, {COMPARE_SQL} AS comparison_reply FROM labels)
""")
def q_parse_replies(spark, sf_dir):
    """P15 + P16 on synthetic model replies built from the labels table."""
    r = _replies(spark, sf_dir)
    return r.select("doc_id", "reply", SC.relevance_score(F.col("reply")).alias("score"), "comparison_reply",
                    SC.comparison_result(F.col("comparison_reply")).alias("comparison"))


@register("valid_llm_reply", f"""
SELECT doc_id % 40 AS q_id, NOT bool_or(trim(coalesce(reply, '')) = '' OR ({S.relevance_score('reply')} = 5.0
         AND NOT contains(coalesce(reply, ''), 'Score:') AND NOT regexp_matches(coalesce(reply, ''), '\\d'))) AS replies_valid
FROM (SELECT doc_id, {REPLY_SQL} AS reply FROM labels) GROUP BY doc_id % 40
""")
def q_valid_llm_reply(spark, sf_dir):
    """F-12: per query group, whether every reply is usable."""
    r = _replies(spark, sf_dir).withColumn("q_id", F.col("doc_id") % 40)
    return RK.reply_validity(r, "q_id")


@register("pairwise_rerank", f"""
WITH c AS ({SCORED_SQL}),
p AS (SELECT a.q_id, a.cand_pos AS a, b.cand_pos AS b,
             {S.comparison_result(COMPARE_SQL.replace('doc_id', '(a.doc_id + b.doc_id)'))} AS result
      FROM c a JOIN c b ON a.q_id = b.q_id AND a.cand_pos < b.cand_pos),
w AS (SELECT q_id, cand_pos, CAST(sum(w) AS BIGINT) AS net_wins FROM (
        SELECT q_id, a AS cand_pos, result AS w FROM p UNION ALL SELECT q_id, b AS cand_pos, -result AS w FROM p)
      GROUP BY q_id, cand_pos)
SELECT q_id, doc_id, coalesce(net_wins, 0) AS net_wins, CAST(rank AS INTEGER) AS rank FROM (
  SELECT c.*, w.net_wins, row_number() OVER (PARTITION BY q_id ORDER BY coalesce(w.net_wins, 0) DESC,
         llm_relevance_score DESC, cand_pos) AS rank
  FROM c LEFT JOIN w USING (q_id, cand_pos)) WHERE rank <= {TOP_K}
""")
def q_pairwise_rerank(spark, sf_dir):
    """Pairwise preferences among each query's first-stage
    candidates (bounded: at most 3 x top_k per query) ranked by net wins."""
    found = cut_lineage(candidates(spark, sf_dir), "search-candidates")
    scored = cut_lineage(RK.score_candidates(found, None), "scored-candidates")
    a = scored.select("q_id", F.col("cand_pos").alias("a"), F.col("doc_id").alias("da"))
    b = scored.select("q_id", F.col("cand_pos").alias("b"), F.col("doc_id").alias("db"))
    reply = F.expr(COMPARE_SQL.replace("doc_id", "(da + db)"))
    prefs = (a.join(b, "q_id").filter(F.col("a") < F.col("b"))
             .select("q_id", "a", "b", SC.comparison_result(reply).alias("result")))
    ranked = RK.rank_candidates(scored, TOP_K, net_wins=RK.pairwise_net_wins(prefs))
    return ranked.select("q_id", "doc_id", "net_wins", "rank")


# Synthetic score replies per (query, candidate): every 7th query has one
# blank reply, which switches that whole query to the heuristic score.
CAND_REPLY_SQL = """CASE WHEN q_id % 7 = 0 AND cand_pos = 2 THEN ''
  WHEN (q_id + doc_id) % 3 = 0 THEN 'Score: ' || CAST((q_id + doc_id) % 11 AS STRING)
  WHEN (q_id + doc_id) % 3 = 1 THEN CAST((q_id * doc_id) % 10 AS STRING) || '/10'
  ELSE 'Relevance: ' || CAST(doc_id % 9 AS STRING) || '.5' END"""


@register("advanced_search_replies", f"""
WITH s AS ({SCORED_SQL}),
r AS (SELECT q_id, cand_pos, {CAND_REPLY_SQL} AS reply FROM s),
v AS (SELECT q_id, NOT bool_or(trim(coalesce(reply, '')) = '' OR ({S.relevance_score('reply')} = 5.0
         AND NOT contains(coalesce(reply, ''), 'Score:') AND NOT regexp_matches(coalesce(reply, ''), '\\d'))) AS ok
      FROM r GROUP BY q_id),
j AS (SELECT s.q_id, s.cand_pos, s.doc_id,
             CASE WHEN v.ok THEN {S.relevance_score('r.reply')} ELSE s.llm_relevance_score END AS llm_relevance_score,
             CASE WHEN v.ok THEN 'replies' ELSE 'heuristic' END AS scored_by
      FROM s JOIN r USING (q_id, cand_pos) JOIN v USING (q_id))
SELECT q_id, CAST(rank AS INTEGER) AS rank, doc_id, llm_relevance_score, scored_by FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY llm_relevance_score DESC, cand_pos) AS rank FROM j)
WHERE rank <= {TOP_K}
""")
def q_advanced_search_replies(spark, sf_dir):
    """R6 stage 2 with model replies (P15 + F-12): parsed reply scores when
    every reply of the query is usable, else the heuristic score for all of
    the query's candidates; then ordered and cut to top 5."""
    c = cut_lineage(candidates(spark, sf_dir), "search-candidates")
    replies = c.select("q_id", "cand_pos", F.expr(CAND_REPLY_SQL).alias("reply"))
    scored = RK.score_candidates(c, replies)
    valid = RK.reply_validity(replies, "q_id")
    ranked = RK.rank_candidates(scored, TOP_K).join(valid, "q_id")
    return ranked.select("q_id", "rank", "doc_id", "llm_relevance_score",
                         F.when(F.col("replies_valid"), F.lit("replies")).otherwise(F.lit("heuristic"))
                         .alias("scored_by"))


@register("search_result_roundtrip", f"""
SELECT CAST(q_id AS VARCHAR) AS incident_number, rank, title, article_path,
       round(semantic_similarity, 6) AS semantic_similarity, relevance_score, intelligent_explanation
FROM ({RANKED_SQL})
""")
def q_search_result_roundtrip(spark, sf_dir):
    """K3 + S11: each query's ranked results saved as one result document
    (``content.search_results.search_results``) under the shared checkpoint
    folder and read back through the search-result reader."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import readers as RD

    r = advanced(spark, sf_dir)
    item = F.struct("title", F.lit(None).cast("string").alias("url"), "article_path", "content_summary",
                    "relevance_score", "semantic_similarity", "intelligent_explanation")
    docs = (r.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("it")))).alias("_xs"))
            .select(F.col("q_id").cast("string").alias("incident_number"),
                    F.struct(F.struct(F.transform("_xs", lambda x: x["it"]).alias("search_results"))
                             .alias("search_results")).alias("content")))
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/casebook-search-results-{uuid.uuid4().hex}"
    docs.write.mode("overwrite").json(out)
    back = RD.search_result_json(spark, out, json_lines=True)
    return back.select("incident_number", F.col("rank").cast("int").alias("rank"), "title", "article_path",
                       F.round("semantic_similarity", 6).alias("semantic_similarity"), "relevance_score",
                       "intelligent_explanation")
