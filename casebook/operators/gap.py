"""Gap analysis, data part (J7, J15, K9 naming).

For each (incident, chosen article) pair the article is split into steps
(non-blank lines); a step is *uncovered* when fewer than ``threshold`` of
its terms occur in the incident text.  Step terms and incident terms are
joined as exploded rows on ``(incident, term)``, so no incident's term list
is copied onto every step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import terms as TM
from ..functions import text as T


def article_steps(chosen: DataFrame, articles: DataFrame, inc_key: str, doc_key: str, text: str = "text") -> DataFrame:
    """Incident ⋈ chosen article ⋈ article text, one row per non-blank line."""
    j = chosen.select(inc_key, doc_key).join(articles.select(doc_key, text), doc_key)
    steps = j.select(inc_key, doc_key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("step_no", "step"))
    return steps.filter(T.strip_ws(F.col("step")) != "").withColumn("step_no", F.col("step_no") + 1)


def step_coverage(steps: DataFrame, incidents: DataFrame, inc_key: str, doc_key: str, inc_text: str = "text",
                  threshold: float = 0.5) -> DataFrame:
    """Per step, its term count, the terms found in the incident, the
    coverage ratio and whether it is uncovered."""
    st = steps.select(inc_key, doc_key, "step_no", F.explode(TM.term_set(F.col("step"))).alias("term"))
    it = incidents.select(inc_key, F.explode(TM.term_set(F.col(inc_text))).alias("term")).withColumn("_hit", F.lit(1))
    j = st.join(it, [inc_key, "term"], "left")
    agg = j.groupBy(inc_key, doc_key, "step_no").agg(F.count(F.lit(1)).alias("n_terms"),
                                                      F.count("_hit").alias("covered"))
    cov = F.col("covered") / F.col("n_terms")
    return agg.withColumn("coverage", cov).withColumn("uncovered", cov < threshold)


def report_name(inc_id, title) -> "F.Column":
    """K9: ``<prefix><incident>_<title with spaces and slashes as _><suffix>``."""
    return F.concat(F.lit(K.GAP_REPORT_PREFIX), F.col(inc_id).cast("string"), F.lit("_"),
                    F.translate(F.coalesce(F.col(title), F.lit("unknown")), " /", "__"), F.lit(K.GAP_REPORT_SUFFIX))
