"""Incident summary job (E1) as one Spark plan: discussion rows -> clean
and normalise -> service-noise filter -> ordered conversation text with the
authored summary -> redaction gate -> example selection -> prompt ->
messages and input token count.  Redacted incidents are routed to
``quarantined`` and get no request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as TM
from ..functions import text as T
from ..operators import conversation as C
from ..operators import examples as EX
from ..operators import prompting as PR
from ..session import cut_lineage


def incident_summary_job(raw_entries: DataFrame, summaries: DataFrame, examples: DataFrame, catalog: DataFrame,
                         patterns, bucket: Column | None = None, key: str = "incident_id",
                         support_title: str | None = None, **noise) -> DataFrame:
    """``summaries``: (incident_id, summary, prompt_type).  Returns one row per
    incident: route, prompt type, examples used, input tokens."""
    kept = C.drop_service_noise(C.normalize_entries(raw_entries), **noise)
    texts = cut_lineage(C.conversation_text(kept, summaries, bucket=bucket, support_title=support_title), "incident-texts")
    gate = summaries.select(key, "prompt_type", T.is_redacted(F.col("summary")).alias("_red"))
    j = texts.join(gate, key, "left")
    red = F.coalesce(F.col("_red"), F.lit(False))
    passed = j.filter(~red).select(
        key, F.coalesce("prompt_type", F.lit("en_molecular")).alias("prompt_type"),
        F.col("conversation_text").alias("text"),
        TM.keywords(F.col("conversation_text"), patterns).alias("keywords"))
    passed = cut_lineage(passed, "incident-requests")
    sel = EX.select_examples(passed, examples, 5, inc_key=key)
    base = EX.attach_prompts(passed.select(key, "prompt_type"), catalog)
    prompts = EX.build_prompt(sel, examples, base, inc_key=key)
    msgs = PR.assemble_messages(
        prompts.join(base.select(key, "system_prompt"), key).join(passed.select(key, F.col("text").alias("conversation")),
                                                                  key))
    ok = msgs.select(key, F.lit("passed").alias("route"), "prompt_type", "examples_used", "input_tokens")
    quarantined = j.filter(red).select(key, F.lit("quarantined").alias("route"), "prompt_type",
                                       F.lit(0).alias("examples_used"), F.lit(0).alias("input_tokens"))
    return ok.unionByName(quarantined)
