import pytest
from pyspark.sql import functions as F

from casebook.functions import rules as R
from casebook.functions import scoring as SC
from casebook.functions import terms as TM
from conftest import one


@pytest.mark.parametrize("reply,score", [
    ("Score: 8", 8.0), ("7.5/10", 7.5), ("I give it 9 out of 10", 9.0), ("Relevance: 3", 3.0),
    ("thinking\n4\n", 4.0), ("42", 10.0), ("no number", 5.0), ("", 5.0), (None, 5.0),
])
def test_relevance_score(spark, reply, score):
    assert one(spark, SC.relevance_score(F.col("x")), reply) == score


@pytest.mark.parametrize("reply,res", [("1", 1), ("-1", -1), ("0", 0), ("equal", 0), ("10", 1), (" -1 ", -1)])
def test_comparison(spark, reply, res):
    assert one(spark, SC.comparison_result(F.col("x")), reply) == res


def test_cost_and_tokens(spark):
    assert one(spark, SC.llm_cost(F.lit(1000), F.lit(2000)), None) == pytest.approx(0.07)
    assert one(spark, SC.token_count(F.col("x")), "Hello, world!") == 4


def test_jaccard_properties(spark):
    j = TM.text_jaccard(F.lit("alpha beta gamma"), F.col("x"))
    assert one(spark, j, "alpha beta gamma") == 1.0
    assert one(spark, j, "delta epsilon") == 0.0
    assert one(spark, j, "the and") == 0.0  # stop words only -> empty set -> 0
    v = one(spark, j, "alpha delta")
    assert 0.0 < v < 1.0
    assert one(spark, TM.text_jaccard(F.col("x"), F.lit("alpha beta gamma")), "alpha delta") == v


def test_keywords_and_rules(spark):
    kw = one(spark, F.array_join(TM.keywords(F.col("x")), ","), "Agent crash on macOS; agent memory")
    assert kw == "agent,crash,macos,memory"
    labels = one(spark, R.rule_set_column(F.col("x"), "platforms"), "runs on Linux and Mac OS")
    assert labels == ["Linux", "macOS"]
    det = one(spark, R.rule_set_column(F.col("x"), "technical_details"), "300 machines lost the JWT")
    assert det == "JWT token authentication, large scale deployment"
    shared = one(spark, F.array_join(TM.shared_terms_ranked(
        TM.term_set(F.col("x"), TM.EXPLAIN_TOKEN), TM.term_set(F.lit("device-control policy"), TM.EXPLAIN_TOKEN),
        TM.term_set(F.lit("zzz"), TM.EXPLAIN_TOKEN)), ","), "policy for device-control")
    assert shared == "device-control,policy"


def test_minmax_scale(spark):
    from casebook.operators.ranking import minmax_scale, tenths_text

    df = spark.createDataFrame([(1, 0.2), (1, 0.4), (1, 0.3), (2, 0.5), (2, 0.5)], "q int, s double")
    rows = {(r.q, r.s): r.norm for r in minmax_scale(df, "q", "s").collect()}
    assert rows[(1, 0.2)] == 3.0 and rows[(1, 0.4)] == 9.0 and rows[(1, 0.3)] == pytest.approx(6.0)
    assert rows[(2, 0.5)] == 6.0
    assert one(spark, tenths_text(F.col("x")), 6.25, "x double") == "6.2"
    assert one(spark, tenths_text(F.col("x")), 6.35, "x double") == "6.3"   # as Python prints it (6.3499...)
