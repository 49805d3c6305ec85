"""The TF-IDF index: counted in the documents' rows, the rare terms joined."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from casebook.functions import constants as K
from casebook.operators import tfidf as TF

DOCS = [(1, "alpha beta beta the x"), (2, "beta gamma Straße"), (1, "alpha delta"), (None, "alpha beta"), (None, "eps beta é1"),
        (5, ""), (6, None), (7, "the of beta"), (8, "beta beta beta zeta_1 alpha")]


def brute(docs, max_df):
    stop, bags = set(K.english_stopwords()), collections.defaultdict(collections.Counter)
    for key, text in docs:
        bags[key].update(w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in stop)
    n = sum(bool((t or "").strip()) for _, t in docs)
    df = collections.Counter(t for bag in bags.values() for t in bag)
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items() if c <= max_df * n}
    rows = {}
    for key, bag in bags.items():
        w = {t: c * idf[t] for t, c in sorted(bag.items()) if t in idf}
        if w:
            rows[key] = (list(w), [round(x, 9) for x in w.values()], round(math.sqrt(sum(x * x for x in w.values())), 9))
    return rows, idf


@pytest.mark.parametrize("head", [0, 2, 1000])
@pytest.mark.parametrize("max_df", [0.9, 0.5])
def test_index_is_the_brute_force_one(spark, monkeypatch, head, max_df):
    monkeypatch.setattr(TF, "HEAD_TERMS", head)
    index, vocab = TF.docs_only_index(spark.createDataFrame(DOCS, "k long, t string"), "k", "t", max_df)
    rows, idf = brute(DOCS, max_df)
    got = index.collect()
    assert len(got) == len(rows)
    assert {r.k: (r.terms, [round(x, 9) for x in r.w], round(r.norm, 9)) for r in got} == rows
    assert {r.term: round(r.idf, 9) for r in vocab.collect()} == {t: round(x, 9) for t, x in idf.items()}


def test_only_entries_of_the_queries_are_sent(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k % 7} other{k} more{k} and{k}") for k in range(40)], "id long, text string")
    index, vocab = TF.docs_only_index(docs, "id", "text")
    queries = docs.filter("id = 3").withColumnRenamed("id", "q")
    sent = []
    real = TF._shared
    monkeypatch.setattr(TF, "_shared", lambda *a: sent.append(real(*a)) or sent[0])
    assert TF.probe_docs_only(index, vocab, "id", queries, "q", "text", 9).count() == 6  # of ids 3, 10, ..., 38
    assert sent[0][0].agg(F.sum(F.size("terms"))).first()[0] == 9  # word3 six times, the others of id 3 once


def test_pruned_search_sends_only_entries_of_the_queries(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k % 7} other{k} more{k} and{k}") for k in range(40)], "id long, text string")
    index = TF.PrunedIndex.build(docs, "id", "text", block_docs=5)
    sent = []
    real = TF._shared
    monkeypatch.setattr(TF, "_shared", lambda *a: sent.append(real(*a)) or sent[-1])
    got = index.probe(docs.filter("id = 3").withColumnRenamed("id", "q"), "q", "text", 9)
    assert sorted(r.id for r in got.collect()) == [3, 10, 17, 24, 31, 38]
    assert len(sent) == 2 and {s[0].agg(F.sum(F.size("terms"))).first()[0] for s in sent} == {9}


@pytest.mark.parametrize("head,max_df,entries", [(0, 0.9, 100), (2, 0.5, 100), (2, 0.9, 1), (1000, 0.5, 100)])
def test_small_batch_finds_what_the_whole_index_finds(spark, monkeypatch, head, max_df, entries):
    monkeypatch.setattr(TF, "HEAD_TERMS", head)
    docs = spark.createDataFrame(DOCS, "k long, t string")
    queries = spark.createDataFrame([(1, "beta zeta_1"), (2, "alpha alpha delta"), (3, "unknown"), (None, "straße é1"), (4, None)], "q long, t string")
    found = lambda df: sorted(((r.q or 0, r["rank"], r.k or 0, round(r.score, 9)) for r in df.collect()))
    index, vocab = TF.docs_only_index(docs, "k", "t", max_df)
    whole = found(TF.probe_docs_only(index, vocab, "k", queries, "q", "t", 9))
    monkeypatch.setattr(TF, "QUERY_ENTRIES", entries)  # 1: more than one block, the whole index
    assert whole and found(TF.fallback_search(docs, "k", "t", queries, "q", "t", 9, max_df)) == whole


@pytest.mark.parametrize("head", [0, 1000])
def test_small_batch_moves_only_its_entries(spark, monkeypatch, head):
    monkeypatch.setattr(TF, "HEAD_TERMS", head)
    docs = spark.createDataFrame([(k, f"word{k % 7} other{k} more{k} and{k}") for k in range(40)], "id long, text string")
    queries = docs.filter("id = 3").withColumnRenamed("id", "q")
    staged, real = {}, TF.cut_lineage
    monkeypatch.setattr(TF, "cut_lineage", lambda df, name: staged.setdefault(name, real(df, name)))
    assert TF.fallback_search(docs, "id", "text", queries, "q", "text", 9).count() == 6
    index = {r.id: r for r in staged["tfidf-index"].collect()}
    assert sorted(index) == [3, 10, 17, 24, 31, 38] and sum(len(r.terms) for r in index.values()) == 9
    idf = {r.term: r.idf for r in staged["tfidf-vocab"].selectExpr("term", "ln(41 / (1 + df)) + 1 AS idf").collect()}
    for k, r in index.items():  # the norm is the whole document's
        assert r.norm == pytest.approx(math.sqrt(sum(idf[t] ** 2 for t in (f"word{k % 7}", f"other{k}", f"more{k}", f"and{k}"))))


def test_small_batch_sends_numbers_to_the_norms(spark, monkeypatch):
    monkeypatch.setattr(TF, "HEAD_TERMS", 0)  # every term is rare: the rows are joined with their norms
    docs = spark.createDataFrame([(k, f"word{k % 7} other{k} more{k} and{k}") for k in range(40)], "id long, text string")
    queries = docs.filter("id = 3").withColumnRenamed("id", "q")
    built, real = [], TF._weighted_for
    monkeypatch.setattr(TF, "_weighted_for", lambda *a: built.append(real(*a)) or built[0])
    assert TF.fallback_search(docs, "id", "text", queries, "q", "text", 9).count() == 6

    def joins(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        return [plan] * (plan.nodeName() == "Join") + [j for p in below for j in joins(p)]

    # the first join is that of the rows with the sums of their rare terms
    sides = [side.schema().simpleString() for side in (lambda j: (j.left(), j.right()))(
        joins(built[0]._jdf.queryExecution().optimizedPlan())[0])]
    assert "key:bigint" in sides[0] and "rare:double" in sides[1]
    assert "string" not in sides[0] and "array<double>" not in sides[0], sides


def test_documents_are_not_shuffled_to_what_was_found(spark, tmp_path):
    from casebook.operators import gap as GP
    from casebook.plans import q_files, q_gap, q_ranking

    letters = "".join(chr(97 + k * k * 31 % 26) for k in range(3000))
    docs = [(k, f"topic{k % 9} step{k}\n{letters[k:k + 900]} {letters[3 * k:3 * k + 900]}", "en", "wiki", 9) for k in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet", compression="none")
    spark.createDataFrame([(k, f"topic{k} step{k}") for k in range(5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    real, steps = GP.article_steps, []
    try:
        GP.article_steps = lambda *a: steps.append(real(*a)) or steps[0]
        q_gap.q_gap_steps(spark, str(tmp_path))
        for rows in (steps[0], q_files.q_gap_requests(spark, str(tmp_path)), q_ranking.candidates(spark, str(tmp_path))):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(doc_id" not in plan, plan
            assert rows.count() >= 5
    finally:
        GP.article_steps = real
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
