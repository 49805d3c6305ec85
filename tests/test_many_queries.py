"""The article search with many incidents: what is counted, sent and written once."""

import collections
import hashlib
import math
import re

import pytest

from casebook.functions import constants as K
from casebook.operators import tfidf as TF
from casebook.operators import vectors as V
from casebook.plans import article_search as AS
from casebook.plans import q_gap

DOCS = [(1, "alpha beta beta the x"), (2, "beta gamma Straße"), (1, "alpha delta"), (None, "alpha beta"), (None, "eps beta é1"),
        (5, ""), (6, None), (7, "the of beta"), (8, "beta beta beta zeta_1 alpha")]


def words(text):
    stop = set(K.english_stopwords())
    return [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in stop]


def bags_of(docs):
    bags = collections.defaultdict(collections.Counter)
    for key, text in docs:
        bags[key].update(words(text))
    return {k: b for k, b in bags.items() if b}, collections.Counter(t for b in bags.values() for t in b)


def many(n=60):
    return [(k, f"word{k % 7} other{k} more{k % 11} and{k % 2} all") for k in range(n)]


def brute(docs, queries, k, max_df=0.9):
    bags, df = bags_of(docs)
    n = sum(bool((t or "").strip()) for _, t in docs)
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items() if c <= max_df * n}
    unit = {}
    for key, bag in bags.items():
        w = {t: c * idf[t] for t, c in bag.items() if t in idf}
        unit[key] = {t: x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    out = []
    for q, text in queries:
        w = {t: c * idf[t] for t, c in collections.Counter(words(text)).items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        found = sorted((-round(s, 12), d) for d, u in unit.items() if (s := sum(x / norm * u.get(t, 0) for t, x in w.items())) > 0)
        out += [(q, d, r, round(-s, 9)) for r, (s, d) in enumerate(found[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r.q, r.id, r["rank"], round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("entries", [20, 10_000])
def test_many_queries_find_what_brute_force_finds(spark, monkeypatch, entries):
    """In several sets and document blocks; words of one document among many, and of half of them."""
    monkeypatch.setattr(TF, "NUMBERED_ENTRIES", entries)
    monkeypatch.setattr(TF, "HEAD_TERMS", 9)
    docs, queries = many(), [(100 + k, f"{t} other{k}") for k, (_, t) in enumerate(many(12))] + [(200, "other5"), (201, "and1"), (202, "none")]
    got = TF.fallback_search(spark.createDataFrame(docs, "id long, text string"), "id", "text",
                             spark.createDataFrame(queries, "q long, text string"), "q", "text", 4)
    assert found(got) == brute(docs, queries, 4)


def test_many_query_entries_get_the_index_once_as_numbers(spark, monkeypatch):
    monkeypatch.setattr(TF, "QUERY_ENTRIES", 5)
    staged, real = {}, TF.cut_lineage
    monkeypatch.setattr(TF, "cut_lineage", lambda df, name: staged.setdefault(name, real(df, name)))
    docs = spark.createDataFrame(many(), "id long, text string")
    got = TF.fallback_search(docs, "id", "text", docs.withColumnRenamed("id", "q"), "q", "text", 3)
    assert "sequence(0, 0" in got._jdf.queryExecution().toString()
    assert dict(staged["tfidf-index"].dtypes)["terms"] == "array<int>"


@pytest.mark.parametrize("head", [0, 2, 1000])
def test_embeddings_of_bags_are_the_brute_force_ones(spark, monkeypatch, head):
    monkeypatch.setattr(TF, "HEAD_TERMS", head)
    dims = 16
    bags, df = bags_of(DOCS)
    n = sum(bool((t or "").strip()) for _, t in DOCS)
    wanted = {}
    for key, bag in bags.items():
        v = [0.0] * dims
        for t, c in bag.items():
            v[int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % dims] += c * (math.log((1 + n) / (1 + df[t])) + 1)
        norm = math.sqrt(sum(x * x for x in v))
        wanted[key] = [round(x / norm, 9) for x in v]
    docs = spark.createDataFrame(DOCS, "k long, t string")
    e, (known, unknown) = V.corpus_embedding(docs, "k", "t", dims)
    assert e.columns == ["k", "embedding"]
    assert {r.k: [round(x, 9) for x in r.embedding] for r in e.collect()} == wanted
    assert known.columns == ["term", "idf"] and known.count() == len(df) and unknown == pytest.approx(math.log(1 + n) + 1)
    again = V.hashed_embedding(docs, "k", "t", (known, unknown), dims)
    assert {r.k: [round(x, 9) for x in r.embedding] for r in again.collect()} == wanted


@pytest.mark.parametrize("sent", [0, 1000])
def test_job_counts_once_and_writes_no_text_with_each_candidate(spark, tmp_path, monkeypatch, sent):
    spark.createDataFrame([(k, f"topic{k % 3} story{k} agent", "en", "web", 9) for k in range(40)],
                          "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(c, t, "user", f"message {t} of topic{c}") for c in range(6) for t in range(2)] + [(99, 0, "user", "no summary")],
                          "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(q_gap, "SENT_IDS", sent)
    staged, real = collections.defaultdict(list), TF.packed
    for module in (TF, AS, q_gap):
        monkeypatch.setattr(module, "packed", lambda df, name: staged[name].append(real(df, name)) or staged[name][-1])
    rows = {r.incident_id: r.n_results for r in q_gap.q_article_search_job(spark, str(tmp_path)).collect()}
    assert rows.keys() == {0, 1, 2, 3, 4, 5, 99} and rows[1] == 5
    assert len(staged["tfidf-bags"]) == 1
    assert sorted(r.incident_id for r in staged["incident-summaries"][0].collect()) == [0, 1, 2, 3, 4, 5]
    assert not {"context", "query_text"} & set(staged["search-candidates"][0].columns)
