"""Driver queries for example selection, prompt assembly and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scoring as SC
from ..functions import terms as TM
from ..functions import text as T
from ..operators import activity as A
from ..operators import examples as EX
from ..operators import prompting as PR
from ..operators import vectors as V
from ..session import read_table
from . import sqltext as S
from .inputs import INJECTED_DOCUMENTS_SQL, injected_documents
from .q_retrieval import EMB_SQL, cos_sql, term_counts_sql
from .registry import register

# FIXED VALUES — keyword patterns made of words present in the driver prose
DATA_PATTERNS = [r"\b(the|that|and)\b", r"\b(nicht|und|die)\b", r"\b(pour|les|des)\b", r"\b(que|los|las)\b"]
LANGS = ["en", "fr", "de", "es"]
# FIXED VALUES — prompt catalogue used by the queries (prompt_type, system, user)
CATALOG = [(f"{lang}_molecular", f"You summarise {lang} support incidents.",
            f"Summarise the {lang} incident below.") for lang in LANGS] + [
    ("stage_duration_analysis", "You measure stage durations.", "List the stages and their durations."),
    ("sentiment_analysis", "You rate sentiment.", "Rate the customer sentiment."),
    ("_comment", "not a prompt", "not a prompt"),
]
CATALOG_SQL = "(VALUES " + ", ".join(f"({S.q(a)}, {S.q(b)}, {S.q(c)})" for a, b, c in CATALOG) + \
    ") AS cat(prompt_type, system_prompt, user_prompt)"


def catalog(spark):
    return spark.createDataFrame(CATALOG, "prompt_type string, system_prompt string, user_prompt string")


def incidents(spark, sf_dir):
    d = injected_documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("incident_id"), F.concat(F.col("lang"), F.lit("_molecular")).alias("prompt_type"),
                    "text", TM.keywords(F.col("text"), DATA_PATTERNS).alias("keywords"), "source", "lang")


def examples(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark")
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]), (F.col("item_id") % 4 + 1).cast("int"))
    return b.select(F.concat(lang, F.lit("_molecular")).alias("prompt_type"), F.col("item_id").alias("ordinal"),
                    TM.keywords(F.col("text"), DATA_PATTERNS).alias("keywords"),
                    F.concat(F.lit("cat_"), (F.col("item_id") % 6).cast("string")).alias("category"),
                    F.col("text").alias("input"),
                    F.concat(F.lit("Resolution for item "), F.col("item_id").cast("string")).alias("output"))


INC_SQL = (f"SELECT doc_id AS incident_id, lang || '_molecular' AS prompt_type, text, "
           f"{S.keywords_wordwise("text", DATA_PATTERNS)} AS keywords, source, lang FROM ({INJECTED_DOCUMENTS_SQL})")
EX_SQL = (f"SELECT ['en','fr','de','es'][item_id % 4 + 1] || '_molecular' AS prompt_type, item_id AS ordinal, "
          f"{S.keywords_wordwise("text", DATA_PATTERNS)} AS keywords, 'cat_' || CAST(item_id % 6 AS VARCHAR) AS category, "
          f"text AS input, 'Resolution for item ' || CAST(item_id AS VARCHAR) AS output FROM benchmark")
def select_sql(inc_sql: str = INC_SQL) -> str:
    return f"""
WITH inc AS ({inc_sql}), ex AS ({EX_SQL}),
a AS ({term_counts_sql('inc', 'incident_id', 'text')}),
b AS ({term_counts_sql('ex', 'ordinal', 'input')}),
sa AS (SELECT incident_id, sum(tf * tf) AS sa FROM a GROUP BY ALL),
sb AS (SELECT ordinal, sum(tf * tf) AS sb FROM b GROUP BY ALL),
sh AS (SELECT incident_id, ordinal, sum(a.tf * b.tf) AS dot, sum(a.tf * a.tf) AS sha, sum(b.tf * b.tf) AS shb
       FROM a JOIN b USING (term) GROUP BY ALL),
p AS (SELECT inc.incident_id, ex.ordinal,
             len(list_intersect(list_distinct(inc.keywords), list_distinct(ex.keywords))) AS overlap, len(ex.keywords) AS n_kw,
             coalesce(dot, 0) AS dot, coalesce(sha, 0) AS sha, coalesce(shb, 0) AS shb, coalesce(sa, 0) AS sa,
             coalesce(sb, 0) AS sb
      FROM inc JOIN ex USING (prompt_type) LEFT JOIN sh USING (incident_id, ordinal)
      LEFT JOIN sa USING (incident_id) LEFT JOIN sb USING (ordinal)),
n AS (SELECT *, sqrt(sha + (1 + ln(1.5)) * (1 + ln(1.5)) * (sa - sha)) AS na,
             sqrt(shb + (1 + ln(1.5)) * (1 + ln(1.5)) * (sb - shb)) AS nb FROM p),
s AS (SELECT incident_id, ordinal,
             (CASE WHEN n_kw > 0 THEN overlap / n_kw ELSE 0.0 END) * 0.6
             + (CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE dot / (na * nb) END) * 0.4 AS score FROM n)
SELECT incident_id, ordinal, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY round(score, 12) DESC, ordinal) AS rank FROM s)
WHERE rank <= 5
"""


SELECT_SQL = select_sql()


def selected(spark, sf_dir):
    return EX.select_examples(incidents(spark, sf_dir), examples(spark, sf_dir), 5)


@register("example_selection", f"""
SELECT incident_id, rank, ordinal, round(score, 6) AS score FROM ({SELECT_SQL})
""")
def q_example_selection(spark, sf_dir):
    """J4 (+A6, R9): top 5 examples per incident of the same prompt type."""
    s = selected(spark, sf_dir)
    return s.select("incident_id", "rank", "ordinal", F.round("score", 6).alias("score"))


BUILD_SQL = f"""
WITH sel AS ({SELECT_SQL}), ex AS ({EX_SQL}), inc AS ({INC_SQL}),
blk AS (SELECT incident_id, count(*) AS n, string_agg(chr(10) || 'Example ' || CAST(rank AS VARCHAR) || ':' || chr(10)
          || 'Input: ' || input || chr(10) || 'Output: ' || output || chr(10), '' ORDER BY rank) AS blk
        FROM sel JOIN ex USING (ordinal) GROUP BY incident_id)
SELECT inc.incident_id, inc.prompt_type, cat.system_prompt,
       CASE WHEN ends_with(inc.prompt_type, '_molecular') AND blk.n IS NOT NULL
            THEN cat.user_prompt || chr(10) || chr(10) || 'Relevant examples for context:' || chr(10) || blk.blk
                 || chr(10) || 'Now process the following incident:' || chr(10)
            ELSE cat.user_prompt END AS enhanced_prompt,
       CAST(CASE WHEN ends_with(inc.prompt_type, '_molecular') AND blk.n IS NOT NULL THEN blk.n ELSE 0 END AS INTEGER)
         AS examples_used, inc.text, inc.source, inc.lang
FROM inc JOIN {CATALOG_SQL} USING (prompt_type) LEFT JOIN blk USING (incident_id)
"""


def built(spark, sf_dir):
    inc = incidents(spark, sf_dir)
    base = EX.attach_prompts(inc.select("incident_id", "prompt_type"), catalog(spark))
    p = EX.build_prompt(selected(spark, sf_dir), examples(spark, sf_dir), base)
    return p.join(base.select("incident_id", "system_prompt"), "incident_id").join(
        inc.select("incident_id", "text", "source", "lang"), "incident_id")


@register("build_prompt", f"""
SELECT incident_id, examples_used, enhanced_prompt FROM ({BUILD_SQL})
""")
def q_build_prompt(spark, sf_dir):
    """P27 + J10: base prompt with the selected examples appended."""
    return built(spark, sf_dir).select("incident_id", "examples_used", "enhanced_prompt")


def _tok_sql(x):
    return f"len(regexp_extract_all(coalesce({x}, ''), {S.q(SC.TOKEN_ESTIMATE)}))"


CALLS_SQL = f"""
SELECT incident_id, source AS model, lang AS prompt_type, {_tok_sql("concat_ws(chr(10), system_prompt, enhanced_prompt, text)")}
         AS input_tokens, {_tok_sql('text')} AS output_tokens
FROM ({BUILD_SQL})
"""


def calls(spark, sf_dir):
    b = built(spark, sf_dir).withColumnRenamed("text", "conversation")
    m = PR.assemble_messages(b)
    m = m.withColumn("output_tokens", SC.token_count(F.col("conversation")))
    return PR.usage(m.select("incident_id", F.col("source").alias("model"), F.col("lang").alias("prompt_type"),
                             "input_tokens", "output_tokens"))


@register("llm_cost", f"""
SELECT incident_id, model, prompt_type, CAST(input_tokens AS INTEGER) AS input_tokens,
       CAST(output_tokens AS INTEGER) AS output_tokens, CAST(input_tokens + output_tokens AS INTEGER) AS total_tokens,
       round(input_tokens / 1000.0 * {K.INPUT_COST_PER_1K} + output_tokens / 1000.0 * {K.OUTPUT_COST_PER_1K}, 8) AS cost
FROM ({CALLS_SQL})
""")
def q_llm_cost(spark, sf_dir):
    """P30 + P13 + P14: messages, token estimates and cost per call (the
    reply stand-in is each document's whole text)."""
    c = calls(spark, sf_dir)
    return c.select("incident_id", "model", "prompt_type", "input_tokens", "output_tokens", "total_tokens",
                    F.round("cost", 8).alias("cost"))


@register("usage_rollup", f"""
SELECT model, prompt_type, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       round(sum(input_tokens / 1000.0 * {K.INPUT_COST_PER_1K} + output_tokens / 1000.0 * {K.OUTPUT_COST_PER_1K}), 6) AS cost
FROM ({CALLS_SQL}) GROUP BY ROLLUP (model, prompt_type)
""")
def q_usage_rollup(spark, sf_dir):
    """Calls, tokens and cost by model and prompt type with subtotals."""
    r = PR.usage_rollup(calls(spark, sf_dir))
    return r.select("model", "prompt_type", "calls", "input_tokens", "output_tokens", F.round("cost", 6).alias("cost"))


@register("categories", f"""
WITH ex AS ({EX_SQL}), c AS (SELECT DISTINCT prompt_type, category FROM ex WHERE coalesce(category, '') <> '')
SELECT prompt_type, array_to_string(list_sort(list(category)), '|') AS categories FROM c GROUP BY prompt_type
UNION ALL SELECT '__all__', array_to_string(list_sort(list(DISTINCT category)), '|') FROM c
""")
def q_categories(spark, sf_dir):
    """A10: distinct categories per prompt type and overall."""
    c = EX.categories(examples(spark, sf_dir))
    return c.select("prompt_type", F.array_join("categories", "|").alias("categories"))


@register("prompt_validate", f"""
WITH req AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'unknown_analysis' WHEN doc_id % 9 = 1 THEN '_comment'
                         ELSE lang || '_molecular' END AS prompt_type FROM documents),
bad AS (SELECT * FROM req WHERE prompt_type NOT IN (SELECT prompt_type FROM {CATALOG_SQL} WHERE NOT starts_with(prompt_type, '_'))),
menu AS (SELECT prompt_type FROM {CATALOG_SQL} WHERE ends_with(prompt_type, '_molecular')
         OR prompt_type IN ({', '.join(S.q(x) for x in EX.MENU_EXTRA_TYPES)}))
SELECT req.prompt_type, count(*) AS requests, bool_or(req.prompt_type IN (SELECT prompt_type FROM bad)) AS unknown,
       bool_or(req.prompt_type IN (SELECT prompt_type FROM menu)) AS in_menu
FROM req GROUP BY req.prompt_type
""")
def q_prompt_validate(spark, sf_dir):
    """F-5 + F-6 + S5: requested prompt types counted, flagged unknown
    (missing from the catalogue, ``_`` keys excluded) and menu membership."""
    d = read_table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 9
    req = d.select(F.when(k == 0, F.lit("unknown_analysis")).when(k == 1, F.lit("_comment"))
                   .otherwise(F.concat(F.col("lang"), F.lit("_molecular"))).alias("prompt_type"))
    cat = catalog(spark)
    bad = EX.unknown_prompt_types(req.distinct(), cat).withColumn("unknown", F.lit(True))
    menu = EX.menu_prompt_types(cat).select("prompt_type").withColumn("in_menu", F.lit(True))
    counts = req.groupBy("prompt_type").agg(F.count(F.lit(1)).alias("requests"))
    return (counts.join(bad, "prompt_type", "left").join(menu, "prompt_type", "left")
            .select("prompt_type", "requests", F.coalesce("unknown", F.lit(False)).alias("unknown"),
                    F.coalesce("in_menu", F.lit(False)).alias("in_menu")))


MEM_KNN_SQL = f"""SELECT q_id, i_id, rank FROM (
  SELECT a.vec_id AS q_id, b.vec_id AS i_id, row_number() OVER (PARTITION BY a.vec_id
         ORDER BY round({cos_sql('a.v', 'b.v')}, 12) DESC, b.vec_id) AS rank
  FROM ({EMB_SQL}) a JOIN ({EMB_SQL}) b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)) WHERE rank <= 3"""


@register("append_memory_context", f"""
WITH hits AS ({MEM_KNN_SQL}),
mem AS (SELECT q_id, substring('Previous similar incidents:' || chr(10) || string_agg(CAST(rank AS VARCHAR) || '. Incident '
          || CAST(i_id AS VARCHAR) || ': label ' || CAST(e.label AS VARCHAR) || ' memory of vector '
          || CAST(i_id AS VARCHAR), chr(10) ORDER BY rank), 1, 1000) AS mem
        FROM hits JOIN embeddings e ON e.vec_id = hits.i_id GROUP BY q_id),
p AS (SELECT vec_id AS incident_id, 'Please analyze incident ' || CAST(vec_id AS VARCHAR) AS enhanced_prompt,
             CAST(vec_id % 2 AS INTEGER) AS examples_used FROM embeddings)
SELECT incident_id, CASE WHEN mem IS NULL THEN enhanced_prompt ELSE enhanced_prompt || chr(10) || chr(10)
  || CASE WHEN examples_used > 0 THEN {S.q(PR.MEMORY_HEADER_WITH_EXAMPLES)} ELSE {S.q(PR.MEMORY_HEADER_PLAIN)} END
  || chr(10) || mem || chr(10) || chr(10)
  || CASE WHEN examples_used > 0 THEN {S.q(PR.MEMORY_FOOTER_WITH_EXAMPLES)} ELSE {S.q(PR.MEMORY_FOOTER_PLAIN)} END END
  AS enhanced_prompt
FROM p LEFT JOIN mem ON mem.q_id = p.incident_id
""")
def q_append_memory_context(spark, sf_dir):
    """J9 + P28: each stored incident vector's 3 nearest memories appended to its prompt."""
    e = read_table(spark, sf_dir, "embeddings")
    knn = V.cosine_knn(e, "vec_id", "embedding", e, "vec_id", "embedding", 3, exclude_self=True)
    memories = e.select(F.col("vec_id").alias("memory_id"),
                        F.concat(F.lit("label "), F.col("label").cast("string"), F.lit(" memory of vector "),
                                 F.col("vec_id").cast("string")).alias("memory_summary"))
    hits = PR.nearest_memories(knn, memories)
    prompts = e.select(F.col("vec_id").alias("incident_id"),
                       F.concat(F.lit("Please analyze incident "), F.col("vec_id").cast("string")).alias("enhanced_prompt"),
                       (F.col("vec_id") % 2).cast("int").alias("examples_used"))
    return PR.append_memory_context(prompts, hits).select("incident_id", "enhanced_prompt")


# FIXED VALUES — team knowledge table used by the team-context query
TEAM_KB = [
    ("error", ["triage", "root cause", "hotfix", "postmortem"], ["debugging", "logs"], "Owns production errors " * 8),
    ("purchase", ["billing"], [], ""),
    ("signup", [], ["identity", "onboarding", "email", "sso"], "Handles account creation"),
]


def teams(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    kind = F.when(F.col("value") > 50, F.lit("escalation")).otherwise(F.lit("consultation"))
    per = ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"),
                                                    F.array_sort(F.collect_set(kind)).alias("interaction_types"))
    tot = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("tot"))
    return per.join(tot, "user_id").select(
        F.col("user_id").alias("incident_id"), F.col("event_type").alias("team_name"), "interaction_types",
        (F.col("n") / F.col("tot")).alias("confidence"),
        F.when(F.col("event_type") == "view", F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("domain_"), F.col("event_type")))).alias("matched_domains"))


TEAMS_SQL = """
SELECT p.user_id AS incident_id, event_type AS team_name, interaction_types, n / tot AS confidence,
       CASE WHEN event_type = 'view' THEN []::VARCHAR[] ELSE ['domain_' || event_type] END AS matched_domains
FROM (SELECT user_id, event_type, count(*) AS n,
             list_sort(list(DISTINCT CASE WHEN value > 50 THEN 'escalation' ELSE 'consultation' END)) AS interaction_types
      FROM events GROUP BY ALL) p JOIN (SELECT user_id, count(*) AS tot FROM events GROUP BY ALL) t USING (user_id)
"""


def _kb_sql():
    rows = ", ".join(f"({S.q(n)}, {S.lit_list(r)}::VARCHAR[], {S.lit_list(e)}::VARCHAR[], {S.q(c)})"
                     for n, r, e, c in TEAM_KB)
    return f"(VALUES {rows}) AS kb(team_name, responsibilities, expertise, capabilities)"


@register("append_team_context", f"""
WITH t AS ({TEAMS_SQL}), j AS (SELECT t.*, kb.responsibilities, kb.expertise, kb.capabilities, kb.team_name AS kbn
                               FROM t LEFT JOIN {_kb_sql()} USING (team_name)),
l AS (SELECT incident_id, team_name, confidence,
        team_name || ' (' || CASE WHEN len(interaction_types) > 0 THEN array_to_string(interaction_types, ', ') ELSE 'unknown' END
        || ', confidence: ' || {S.fmt_fixed('confidence', 2)} || ')'
        || CASE WHEN len(matched_domains) > 0 THEN ' - Expertise: ' || array_to_string(matched_domains, ', ') ELSE '' END AS info,
        CASE WHEN kbn IS NOT NULL THEN team_name || ':'
          || CASE WHEN len(responsibilities) > 0 THEN ' Responsibilities: ' || array_to_string(responsibilities[1:3], ', ') ELSE '' END
          || CASE WHEN len(expertise) > 0 THEN ' | Expertise: ' || array_to_string(expertise[1:3], ', ') ELSE '' END
          || CASE WHEN coalesce(capabilities, '') <> '' THEN ' | ' || substring(capabilities, 1, 100) || '...' ELSE '' END
        END AS kb
      FROM j)
SELECT incident_id, concat_ws(chr(10), 'Teams involved: ' || string_agg(team_name, ', ' ORDER BY -confidence, team_name),
  CASE WHEN count(kb) > 0 THEN 'Team Knowledge Database:' || chr(10)
       || string_agg(kb, chr(10) ORDER BY -confidence, team_name) END,
  string_agg(info, chr(10) ORDER BY -confidence, team_name)) AS team_context
FROM l GROUP BY incident_id
""")
def q_append_team_context(spark, sf_dir):
    """P29 + J13: team context per incident (users as incidents, event types as teams)."""
    kb = spark.createDataFrame(TEAM_KB, "team_name string, responsibilities array<string>, expertise array<string>, "
                                        "capabilities string")
    return PR.team_context(teams(spark, sf_dir), kb)


@register("serialize_team", """
SELECT incident_id, to_json({'team_name': team_name, 'interaction_types': interaction_types,
       'confidence': confidence, 'matched_domains': matched_domains})::VARCHAR AS team_json
FROM (""" + TEAMS_SQL + ")")
def q_serialize_team(spark, sf_dir):
    """Detected teams as JSON records."""
    return PR.serialize_team(teams(spark, sf_dir))


@register("serialize_ownership", """
SELECT incident_id, to_json({'incident_id': incident_id::VARCHAR, 'from_team': from_team, 'to_team': to_team,
       'change_type': 'reassignment', 'timestamp': strftime(ts, '%Y-%m-%d %H:%M:%S'), 'context': coalesce(props, ''),
       'confidence': 1.0::DOUBLE, 'reason': reason})::VARCHAR AS change_json
FROM (SELECT user_id AS incident_id, event_type AS to_team, ts, props,
             CASE WHEN value > 50 THEN 'escalation' END AS reason,
             lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_team FROM events)
WHERE from_team IS NOT NULL AND from_team <> to_team
""")
def q_serialize_ownership(spark, sf_dir):
    """W7 + P36: hand-overs with context, confidence and reason as JSON records."""
    e = read_table(spark, sf_dir, "events")
    o = A.ownership_changes(e, "user_id", "ts", "event_id", "event_type", None, F.col("props"),
                            F.when(F.col("value") > 50, F.lit("escalation")))
    o = o.withColumnRenamed("user_id", "incident_id").withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return PR.serialize_ownership(o)


@register("serialize_patterns", """
SELECT to_json({'pattern_type': pattern_type, 'team_name': team_name, 'frequency': frequency, 'confidence': 0.0::DOUBLE,
       'examples': CAST([] AS VARCHAR[]), 'description': 'seen in ' || CAST(incidents AS VARCHAR) || ' incidents'})::VARCHAR
       AS pattern_json
FROM (SELECT event_type AS team_name, CASE WHEN value > 50 THEN 'escalation' ELSE 'consultation' END AS pattern_type,
             count(*) AS frequency, count(DISTINCT user_id) AS incidents FROM events GROUP BY ALL)
""")
def q_serialize_patterns(spark, sf_dir):
    """A19 + P36: interaction patterns as JSON records."""
    kind = F.when(F.col("value") > 50, F.lit("escalation")).otherwise(F.lit("consultation"))
    t = A.team_interactions(read_table(spark, sf_dir, "events"), "user_id", "event_type", kind)
    return PR.serialize_patterns(t.select(
        F.col("interaction_type").alias("pattern_type"), F.col("event_type").alias("team_name"), "frequency",
        F.concat(F.lit("seen in "), F.col("incidents").cast("string"), F.lit(" incidents")).alias("description")))


def _e1_sql():
    from .inputs import INJECTED_DOCUMENTS_SQL
    from .q_conversation import CONV_TEXT_SQL

    conv = CONV_TEXT_SQL.replace("SELECT doc_id AS incident_id, text AS summary FROM documents",
                                 f"SELECT doc_id AS incident_id, text AS summary FROM ({INJECTED_DOCUMENTS_SQL})")
    gate = (f"SELECT doc_id AS incident_id, lang || '_molecular' AS prompt_type, {S.is_redacted('text')} AS red "
            f"FROM ({INJECTED_DOCUMENTS_SQL})")
    inc = (f"SELECT t.incident_id, coalesce(g.prompt_type, 'en_molecular') AS prompt_type, t.conversation_text AS text, "
           f"{S.keywords_wordwise('t.conversation_text', DATA_PATTERNS)} AS keywords "
           f"FROM ({conv}) t LEFT JOIN ({gate}) g USING (incident_id) WHERE NOT coalesce(g.red, false)")
    return f"""
WITH sel AS ({select_sql(inc)}), ex AS ({EX_SQL}), inc AS ({inc}),
blk AS (SELECT incident_id, count(*) AS n, string_agg(chr(10) || 'Example ' || CAST(rank AS VARCHAR) || ':' || chr(10)
          || 'Input: ' || input || chr(10) || 'Output: ' || output || chr(10), '' ORDER BY rank) AS blk
        FROM sel JOIN ex USING (ordinal) GROUP BY incident_id),
p AS (SELECT inc.incident_id, inc.prompt_type, cat.system_prompt, inc.text,
        CASE WHEN ends_with(inc.prompt_type, '_molecular') AND blk.n IS NOT NULL
             THEN cat.user_prompt || chr(10) || chr(10) || 'Relevant examples for context:' || chr(10) || blk.blk
                  || chr(10) || 'Now process the following incident:' || chr(10)
             ELSE cat.user_prompt END AS enhanced_prompt,
        CAST(CASE WHEN ends_with(inc.prompt_type, '_molecular') AND blk.n IS NOT NULL THEN blk.n ELSE 0 END AS INTEGER)
          AS examples_used
      FROM inc JOIN {CATALOG_SQL} USING (prompt_type) LEFT JOIN blk USING (incident_id))
SELECT incident_id, 'passed' AS route, prompt_type, examples_used,
       CAST({_tok_sql("concat_ws(chr(10), system_prompt, enhanced_prompt, text)")} AS INTEGER) AS input_tokens FROM p
UNION ALL
SELECT t.incident_id, 'quarantined', g.prompt_type, 0, 0 FROM ({conv}) t JOIN ({gate}) g USING (incident_id) WHERE g.red
"""


@register("incident_summary_job", _e1_sql())
def q_incident_summary_job(spark, sf_dir):
    """E1 end to end for every conversation (summary and prompt type from the
    document with the same id; redacted summaries are quarantined)."""
    from .incident_summary import incident_summary_job
    from .inputs import NOISE, SUPPORT_SECTION_TITLE, raw_discussions
    from .q_conversation import TURN_BUCKET

    d = injected_documents(spark, sf_dir)
    summaries = d.select(F.col("doc_id").alias("incident_id"), F.col("text").alias("summary"),
                         F.concat(F.col("lang"), F.lit("_molecular")).alias("prompt_type"))
    r = incident_summary_job(raw_discussions(spark, sf_dir), summaries, examples(spark, sf_dir), catalog(spark),
                             DATA_PATTERNS, bucket=F.floor(F.col("ts") / TURN_BUCKET),
                             support_title=SUPPORT_SECTION_TITLE, **NOISE)
    return r.select("incident_id", "route", "prompt_type", F.col("examples_used").cast("int").alias("examples_used"),
                    F.col("input_tokens").cast("int").alias("input_tokens"))
