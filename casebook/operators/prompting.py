"""Prompt assembly and usage accounting as columns (P13, P14, P26, P28, P29,
P30, P34, P36, A14).

The model call itself is out of scope; requests, replies, token counts and
cost are plain columns, so usage roll-ups are ordinary aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as SC
from .tfidf import top_k


def format_items(items: DataFrame, key: str, pos: str = "pos", kind: str = "type",
                 content: str = "content", bucket: Column | None = None) -> DataFrame:
    """Text items verbatim, other items as ``[Image: …]``, joined by
    newlines in ``pos`` order (two-level with ``bucket``, see
    ``conversation.ordered_concat``)."""
    from .conversation import ordered_concat

    line = F.when(F.col(kind) == "text", F.col(content)).otherwise(
        F.concat(F.lit("[Image: "), F.col(content), F.lit("]")))
    return ordered_concat(items, key, [pos], line, "\n", bucket=bucket, out="conversation")


def assemble_messages(df: DataFrame, system: str = "system_prompt", prompt: str = "enhanced_prompt",
                      conversation: str = "conversation") -> DataFrame:
    """P30 + P13: chat messages and the input token count (system, prompt and
    content joined by newlines)."""
    user = F.concat(F.col(prompt), F.lit("\n\nContent:\n"), F.col(conversation))
    input_text = F.concat_ws("\n", F.col(system), F.col(prompt), F.col(conversation))
    return df.select(
        "*",
        F.array(F.struct(F.lit("system").alias("role"), F.col(system).alias("content")),
                F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"),
        SC.token_count(input_text).alias("input_tokens"),
    )


def usage(df: DataFrame, input_tokens: str = "input_tokens", output_tokens: str = "output_tokens",
          in_rate: float | None = None, out_rate: float | None = None, per: int = 1000) -> DataFrame:
    """Total tokens and cost per call."""
    kw = {}
    if in_rate is not None:
        kw["in_rate"] = in_rate
    if out_rate is not None:
        kw["out_rate"] = out_rate
    return df.withColumn("total_tokens", F.col(input_tokens) + F.col(output_tokens)).withColumn(
        "cost", SC.llm_cost(F.col(input_tokens), F.col(output_tokens), per=per, **kw))


def usage_rollup(calls: DataFrame, dims=("model", "prompt_type")) -> DataFrame:
    """Calls, tokens and cost by model and prompt type with subtotals
    (ROLLUP; grouping columns are null on subtotal rows)."""
    return calls.rollup(*dims).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.sum("cost").alias("cost"),
    )


MEMORY_HEADER_PLAIN = "Context from previous similar incidents:"
MEMORY_HEADER_WITH_EXAMPLES = "Additional context from previous similar incidents:"
MEMORY_FOOTER_PLAIN = "Use this context to provide more informed and consistent analysis."
MEMORY_FOOTER_WITH_EXAMPLES = "Use this additional context alongside the provided examples for more informed analysis."


def append_memory_context(prompts: DataFrame, hits: DataFrame, key: str = "incident_id",
                          limit: int = 3, max_chars: int = 1000) -> DataFrame:
    """Append the numbered block of the ``limit`` nearest past incidents
    (``hits``: key, rank, memory_id, memory_summary), capped at ``max_chars``;
    wording depends on whether examples were used; unchanged without hits."""
    h = hits.filter(F.col("rank") <= limit)
    line = F.concat(F.col("rank").cast("string"), F.lit(". Incident "), F.col("memory_id").cast("string"),
                    F.lit(": "), F.col("memory_summary"))
    agg = (h.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("_xs"))
           .select(key, F.substring(F.concat(F.lit("Previous similar incidents:\n"),
                                             F.array_join(F.transform("_xs", lambda x: x["l"]), "\n")),
                                    1, max_chars).alias("_mem")))
    j = prompts.join(agg, key, "left")
    used = F.coalesce(F.col("examples_used"), F.lit(0)) > 0
    header = F.when(used, F.lit(MEMORY_HEADER_WITH_EXAMPLES)).otherwise(F.lit(MEMORY_HEADER_PLAIN))
    footer = F.when(used, F.lit(MEMORY_FOOTER_WITH_EXAMPLES)).otherwise(F.lit(MEMORY_FOOTER_PLAIN))
    out = F.when(F.col("_mem").isNull(), F.col("enhanced_prompt")).otherwise(
        F.concat(F.col("enhanced_prompt"), F.lit("\n\n"), header, F.lit("\n"), F.col("_mem"), F.lit("\n\n"), footer))
    return j.withColumn("enhanced_prompt", out).withColumn("memory_enhanced", F.col("_mem").isNotNull()).drop("_mem")


def team_context(teams: DataFrame, knowledge: DataFrame | None = None, key: str = "incident_id") -> DataFrame:
    """P29 + J13: ``Teams involved`` line, optional knowledge lines (first 3
    responsibilities / expertise, 100 characters of capabilities), then one
    line per team ``name (types, confidence: 0.00) - Expertise: domains``.
    Teams are ordered by confidence desc, then name."""
    t = teams.withColumn("_o", F.struct((-F.col("confidence")).alias("c"), F.col("team_name").alias("n")))
    types = F.when(F.size(F.coalesce(F.col("interaction_types"), F.array())) > 0,
                   F.array_join("interaction_types", ", ")).otherwise(F.lit("unknown"))
    info = F.concat(F.col("team_name"), F.lit(" ("), types, F.lit(", confidence: "),
                    SC.fmt_fixed(F.col("confidence"), 2), F.lit(")"),
                    F.when(F.size(F.coalesce(F.col("matched_domains"), F.array())) > 0,
                           F.concat(F.lit(" - Expertise: "), F.array_join("matched_domains", ", ")))
                    .otherwise(F.lit("")))
    kb_line: Column | None = None
    if knowledge is not None:
        t = t.join(knowledge, "team_name", "left")
        resp = F.coalesce(F.col("responsibilities"), F.array())
        exp = F.coalesce(F.col("expertise"), F.array())
        cap = F.coalesce(F.col("capabilities"), F.lit(""))
        kb_line = F.when(F.col("responsibilities").isNotNull() | F.col("expertise").isNotNull()
                         | F.col("capabilities").isNotNull(),
                         F.concat(F.col("team_name"), F.lit(":"),
                                  F.when(F.size(resp) > 0, F.concat(F.lit(" Responsibilities: "),
                                                                    F.array_join(F.slice(resp, 1, 3), ", ")))
                                  .otherwise(F.lit("")),
                                  F.when(F.size(exp) > 0, F.concat(F.lit(" | Expertise: "),
                                                                   F.array_join(F.slice(exp, 1, 3), ", ")))
                                  .otherwise(F.lit("")),
                                  F.when(cap != "", F.concat(F.lit(" | "), F.substring(cap, 1, 100), F.lit("...")))
                                  .otherwise(F.lit(""))))
    cols = [F.struct("_o", F.col("team_name").alias("name"), info.alias("info"),
                     (kb_line if kb_line is not None else F.lit(None).cast("string")).alias("kb"))]
    agg = t.groupBy(key).agg(F.array_sort(F.collect_list(cols[0])).alias("_xs"))
    names = F.array_join(F.transform("_xs", lambda x: x["name"]), ", ")
    kb = F.filter(F.transform("_xs", lambda x: x["kb"]), lambda x: x.isNotNull())
    infos = F.array_join(F.transform("_xs", lambda x: x["info"]), "\n")
    ctx = F.concat_ws("\n", F.concat(F.lit("Teams involved: "), names),
                      F.when(F.size(kb) > 0, F.concat(F.lit("Team Knowledge Database:\n"), F.array_join(kb, "\n"))),
                      infos)
    return agg.select(key, ctx.alias("team_context"))


def serialize_team(teams: DataFrame, key: str = "incident_id") -> DataFrame:
    """Detected teams as plain JSON with defaults for missing fields."""
    s = F.struct(F.coalesce(F.col("team_name"), F.lit("")).alias("team_name"),
                 F.coalesce(F.col("interaction_types"), F.array().cast("array<string>")).alias("interaction_types"),
                 F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence"),
                 F.coalesce(F.col("matched_domains"), F.array().cast("array<string>")).alias("matched_domains"))
    return teams.select(key, F.to_json(s).alias("team_json"))


def _or_default(df: DataFrame, name: str, kind: str, default) -> Column:
    value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind) if default != [] else F.array().cast(kind))


def _serialized(df: DataFrame, fields: list[tuple]) -> Column:
    """The fields as JSON, with defaults for missing columns and null values;
    a null without a default stays a null in the JSON."""
    return F.to_json(F.struct(*[_or_default(df, n, kind, d).alias(n) for n, kind, d in fields]), {"ignoreNullFields": "false"})


def serialize_ownership(changes: DataFrame, key: str = "incident_id") -> DataFrame:
    """Ownership changes (W7) as plain JSON."""
    return changes.select(key, _serialized(changes, [
        ("incident_id", "string", ""), ("from_team", "string", None), ("to_team", "string", ""), ("change_type", "string", ""),
        ("timestamp", "string", ""), ("context", "string", ""), ("confidence", "double", 0.0), ("reason", "string", None),
    ]).alias("change_json"))


def serialize_patterns(patterns: DataFrame) -> DataFrame:
    """Collaboration patterns (A19) as plain JSON."""
    return patterns.select(_serialized(patterns, [
        ("pattern_type", "string", "unknown"), ("team_name", "string", "unknown"), ("frequency", "long", 0),
        ("confidence", "double", 0.0), ("examples", "array<string>", []), ("description", "string", ""),
    ]).alias("pattern_json"))


def nearest_memories(knn: DataFrame, memories: DataFrame, limit: int = 3) -> DataFrame:
    """J9 hits shaped for P28: (incident_id, rank, memory_id, memory_summary)."""
    h = top_k(knn, "q_id", [F.asc("rank")], limit, rank="_r").drop("_r")
    return h.join(memories, h.i_id == memories.memory_id).select(
        F.col("q_id").alias("incident_id"), "rank", "memory_id", "memory_summary")


# ---------------------------------------------------------------------------
# FIXED VALUES — model request templates (P34).  ``{name}`` marks a column.
# ---------------------------------------------------------------------------
SCORING_TEMPLATE = """
# Technical Support Article Relevance Assessment

## Incident Query
{query}

## Incident Context
{context}

## Article to Evaluate
**Title:** {title}
**URL:** {url}
**Content Summary:** {summary}

## Scoring Criteria
Rate the relevance of this article to the incident on a scale of 0-10:

- **10**: Directly addresses the exact issue described in the incident
- **8-9**: Highly relevant troubleshooting guide for similar issues
- **6-7**: Moderately relevant, contains useful information for the problem domain
- **4-5**: Somewhat relevant, may contain tangential information
- **2-3**: Barely relevant, minimal connection to the incident
- **0-1**: Not relevant, no connection to the incident

Consider:
- Technical compatibility (platforms, versions, components)
- Problem domain alignment (security, performance, configuration, etc.)
- Troubleshooting methodology applicability
- Specificity of the solution to the described issue

## Response Format
Provide your score as a single integer between 0 and 10, followed by a brief explanation of your reasoning.

Score: [0-10]
Reasoning: [Brief explanation of why this score was assigned]
"""

EXPLANATION_TEMPLATE = """
# Technical Support Article Relevance Explanation

## Incident Query
{query}

## Incident Context
{context}

## Article
**Title:** {title}
**URL:** {url}
**Content Summary:** {summary}
**Relevance Score:** {score}/10

## Task
Explain why this article is relevant to the incident in 2-3 sentences. Focus on:
- Specific technical aspects that match the incident
- Troubleshooting steps that apply to the described problem
- Platform, component, or domain alignment
- How this article would help resolve the incident

Be specific and technical, avoiding generic statements.

## Response
Provide a clear, concise explanation of the relevance:
"""

PAIRWISE_TEMPLATE = """
# Technical Support Article Comparison

## Incident Query
{query}

## Incident Context
{context}

## Article A
**Title:** {title_a}
**Content Summary:** {summary_a}
**Current Score:** {score_a}

## Article B
**Title:** {title_b}
**Content Summary:** {summary_b}
**Current Score:** {score_b}

## Task
Compare these two articles and determine which is more relevant to the incident.

Consider:
- Technical specificity to the described problem
- Troubleshooting methodology alignment
- Platform/component compatibility
- Solution completeness and applicability

## Response Format
Respond with:
- "1" if Article A is more relevant
- "-1" if Article B is more relevant  
- "0" if both articles are equally relevant

Response: [1, -1, or 0]
"""


def template_parts(template: str):
    """Split a ``{name}`` template into ('lit', text) / ('col', name) parts."""
    import re

    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(("lit", template[pos:m.start()]))
        parts.append(("col", m.group(1)))
        pos = m.end()
    parts.append(("lit", template[pos:]))
    return [p for p in parts if p != ("lit", "")]


def fill_template(template: str, columns: dict) -> Column:
    """A template filled from columns as one ``concat`` (no UDF)."""
    return F.concat(*[F.lit(v) if kind == "lit" else columns[v] for kind, v in template_parts(template)])


def request_texts(cands: DataFrame) -> DataFrame:
    """Scoring and explanation requests per candidate (``url`` defaults
    to ``Unknown`` when the candidate has none)."""
    cols = {
        "query": F.coalesce(F.col("query_text"), F.lit("")),
        "context": F.coalesce(F.col("context"), F.lit("")),
        "title": F.coalesce(F.col("title"), F.lit("Unknown")),
        "url": F.coalesce(F.col("url"), F.lit("Unknown")) if "url" in cands.columns else F.lit("Unknown"),
        "summary": F.coalesce(F.col("content_summary"), F.lit("No summary available")),
        "score": F.coalesce(F.col("llm_relevance_score"), F.lit(0.0)).cast("string"),
    }
    return cands.select("*", fill_template(SCORING_TEMPLATE, cols).alias("scoring_request"),
                        fill_template(EXPLANATION_TEMPLATE, cols).alias("explanation_request"))


def pairwise_requests(pairs: DataFrame) -> DataFrame:
    """The comparison request of each candidate pair."""
    cols = {"query": F.coalesce(F.col("query_text"), F.lit("")), "context": F.coalesce(F.col("context"), F.lit(""))}
    for n in "ab":
        cols[f"title_{n}"] = F.coalesce(F.col(f"title_{n}"), F.lit("Unknown"))
        cols[f"summary_{n}"] = F.coalesce(F.col(f"summary_{n}"), F.lit("No summary available"))
        cols[f"score_{n}"] = F.coalesce(F.col(f"score_{n}"), F.lit(0.0)).cast("string")
    return pairs.withColumn("pairwise_request", fill_template(PAIRWISE_TEMPLATE, cols))


# FIXED VALUES — gap analysis request; the topic, a column here, takes the place of a fixed one.
GAP_TEMPLATE = """
IMPORTANT: You must analyze the specific incident data provided below. Do NOT generate generic troubleshooting steps.

INCIDENT DATA TO ANALYZE:
{summary}

TROUBLESHOOTING ARTICLE CONTENT:
{article}

Your task is to:
1. Analyze the SPECIFIC incident data above ({topic})
2. Compare it against the troubleshooting article procedures
3. Identify gaps and create an execution plan

Focus ONLY on the {topic} described in the incident data. Do NOT analyze network connectivity or any other generic issues.
"""
DEFAULT_TOPIC = "issue"


def gap_requests(pairs: DataFrame, summary: str = "summary", article: str = "article_text", topic: str | None = None) -> DataFrame:
    """The gap analysis request of each (incident, article) row; ``topic``
    names the column that says what the incident is about."""
    about = F.lit(DEFAULT_TOPIC) if topic is None else F.coalesce(F.nullif(F.col(topic), F.lit("")), F.lit(DEFAULT_TOPIC))
    cols = {"summary": F.coalesce(F.col(summary), F.lit("No summary available")), "article": F.coalesce(F.col(article), F.lit("")),
            "topic": about}
    return pairs.withColumn("gap_request", fill_template(GAP_TEMPLATE, cols))
