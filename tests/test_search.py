"""The whole article search: every branch of its stages."""

from pyspark.sql import functions as F

from casebook.operators import ranking as RK

SF = "/root/testdata/sf0.001"


def test_full_search_takes_every_branch(spark):
    import __spark_entry__ as E

    r = E.queries()["advanced_search_full"](spark, SF).persist()
    assert {x.stage for x in r.select("stage").distinct().collect()} == {"semantic", "tfidf"}
    assert r.groupBy("q_id").agg(F.countDistinct("stage").alias("n")).filter("n > 1").count() == 0
    said = F.col("intelligent_explanation").startswith("It treats topic")
    per = r.groupBy("q_id").agg(F.min(said).alias("lo"), F.max(said).alias("hi")).collect()
    assert all(x.lo == x.hi for x in per) and {x.lo for x in per} == {True, False}
    assert all(not x.lo for x in per if x.q_id % 6 in (1, 2)) and all(x.lo for x in per if x.q_id % 6 not in (1, 2))
    r.unpersist()


def _cands(spark):
    return spark.createDataFrame(
        [(q, c, "agent crash", "", "Agent crash", "the agent has a crash", 7.0) for q in (1, 2, 3) for c in (1, 2)],
        "q_id long, cand_pos int, query_text string, context string, title string, content_summary string, "
        "llm_relevance_score double")


def test_explanations_of_a_query_stand_or_fall_together(spark):
    replies = spark.createDataFrame([(1, 1, "  a good explanation "), (1, 2, "another good one"), (2, 1, "a good explanation"),
                                     (2, 2, " short   "), (3, 1, "a good explanation")], "q_id long, cand_pos int, reply string")
    got = {(r.q_id, r.cand_pos): r.intelligent_explanation for r in RK.explain_candidates(_cands(spark), replies).collect()}
    assert got[1, 1] == "a good explanation" and got[1, 2] == "another good one"
    heuristic = {(r.q_id, r.cand_pos): r.intelligent_explanation for r in RK.explain_candidates(_cands(spark), None).collect()}
    assert all(got[q, c] == heuristic[q, c] for q in (2, 3) for c in (1, 2))


def test_candidate_pairs_stay_inside_a_query(spark):
    c = _cands(spark).withColumn("doc_id", F.col("cand_pos").cast("long"))
    assert sorted((r.q_id, r.a, r.b) for r in RK.candidate_pairs(c).collect()) == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
