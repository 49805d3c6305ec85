import random

import pytest

from casebook.operators import tfidf as TF


def corpus(rng, n):
    topics = [[f"{name}{k}" for k in range(30)] for name in ("net", "disk", "agent", "mail", "proxy", "kernel", "print", "vpn")]
    rows = []
    for k in range(n):
        words = rng.choices(topics[k % 8], k=rng.randint(3, 25)) + rng.choices(["common", "report", "ticket"], k=2)
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, rows[3][1]) for k in range(n // 3)]  # a third are copies
    return rows + [(5000, None), (5001, "  "), (5002, "common report ticket"), (None, "net1 net2")], topics


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows, topics = corpus(rng, 240)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS block", "1 AS term")
    queries = [(k, " ".join(rng.choices(topics[k % 8], k=4)) + " common") for k in range(24)]
    queries += [(100, rows[3][1]), (101, "nothing known"), (102, None), (103, "ticket")]
    return docs, spark.createDataFrame(queries, "item_id long, text string"), queries


def listed(df):
    return sorted((r["item_id"], r["rank"], -1 if r["doc_id"] is None else r["doc_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("block_docs,k,entries", [(6, 4, 30), (40, 15, 100_000), (100_000, 3, 100_000)])
def test_same_rows_as_the_search_over_all_blocks(spark, data, monkeypatch, block_docs, k, entries):
    monkeypatch.setattr(TF, "QUERY_ENTRIES", entries)
    docs, queries, _ = data
    index, vocab = TF.docs_only_index(docs, "doc_id", "text")
    want = listed(TF.probe_docs_only(index, vocab, "doc_id", queries, "item_id", "text", k))
    pruned = TF.PrunedIndex.of(index, vocab, "doc_id", block_docs)
    assert listed(pruned.probe(queries, "item_id", "text", k)) == want
    monkeypatch.setattr(TF, "LOOKUP_TERMS", 3)  # no lookup by filter
    assert listed(pruned.probe(queries, "item_id", "text", k)) == want
    assert want and pruned.probe(queries.limit(0), "item_id", "text", k).count() == 0


def test_blocks_without_a_term_or_below_the_kth_score_are_not_read(spark, data, monkeypatch):
    docs, queries, listed_queries = data
    pruned = TF.PrunedIndex.build(docs, "doc_id", "text", block_docs=6)
    sizes = [r["count"] for r in pruned.blocks.groupBy("block").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 30  # the copies are spread
    read = []
    real = TF.PrunedIndex.scored

    def scored(self, q, pairs, k):
        read.append(pairs.count())
        return real(self, q, pairs, k)

    monkeypatch.setattr(TF.PrunedIndex, "scored", scored)
    pruned.probe(queries, "item_id", "text", 4).count()
    every = len(sizes) * len(listed_queries)
    assert sum(read) < 0.4 * every
    one = queries.where("item_id = 0")
    read.clear()
    pruned.probe(one, "item_id", "text", 2).count()
    assert sum(read) < 0.4 * len(sizes)


def test_one_index_serves_many_batches(spark, data):
    docs, queries, _ = data
    pruned = TF.PrunedIndex.build(docs, "doc_id", "text", block_docs=20)
    whole = listed(pruned.probe(queries, "item_id", "text", 5))
    parts = listed(pruned.probe(queries.where("item_id < 9"), "item_id", "text", 5)) + listed(
        pruned.probe(queries.where("item_id >= 9"), "item_id", "text", 5))
    assert sorted(parts) == whole


def test_empty_corpus(spark, data):
    _, queries, _ = data
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert TF.PrunedIndex.build(empty, "doc_id", "text").probe(queries, "item_id", "text", 5).count() == 0


def test_search_takes_a_stored_index(spark, data):
    from casebook.plans.article_search import search_candidates

    docs, queries, _ = data
    d = docs.selectExpr("doc_id", "text", "'src' AS source", "'en' AS lang").where("doc_id IS NOT NULL")
    inc = queries.selectExpr("item_id AS incident_id", "text AS technical_query", "text AS incident_context")
    key = lambda df: sorted((r["q_id"], r["cand_pos"], r["doc_id"]) for r in df.collect())
    args = (inc, d, 2, "incident_id", "technical_query", "incident_context")
    assert key(search_candidates(*args, index=TF.PrunedIndex.build(d, "doc_id", "text"))) == key(search_candidates(*args))
