"""Retrieval operators against brute-force references on small fixtures."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casebook.functions import constants as K
from casebook.operators import examples as EX
from casebook.operators import tfidf as TF
from casebook.operators import vectors as V

DOCS = [
    (1, "Defender agent crash on macOS after update"),
    (2, "Network firewall blocks the sensor connection"),
    (3, "Agent crash and memory error on Linux servers"),
    (4, "Policy configuration for device control"),
    (5, ""),
    (6, "crash crash crash agent agent"),
]
QUERIES = [(10, "agent crash on macos"), (11, "firewall network"), (12, "nothing matches zzz")]


def toks(t):
    sw = set(K.english_stopwords())
    return [w for w in re.findall(r"\w{2,}", t.lower()) if w not in sw]


def brute_fallback(k):
    n = sum(bool(t.strip()) for _, t in DOCS)  # blank documents do not count
    tf = {d: Counter(toks(t)) for d, t in DOCS}
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items() if c <= 0.9 * n}
    out = {}
    for q, qt in QUERIES:
        qc = Counter(w for w in toks(qt) if w in idf)
        qv = {w: c * idf[w] for w, c in qc.items()}
        qn = math.sqrt(sum(v * v for v in qv.values()))
        res = []
        for d, c in tf.items():
            dv = {w: x * idf[w] for w, x in c.items() if w in idf}
            dn = math.sqrt(sum(v * v for v in dv.values()))
            if qn == 0 or dn == 0:
                continue
            s = sum(qv[w] * dv.get(w, 0) for w in qv) / (qn * dn)
            if s > 0:
                res.append((round(-s, 12), d, s))
        out[q] = [(d, s) for _, d, s in sorted(res)[:k]]
    return out


def test_fallback_search_matches_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    qs = spark.createDataFrame(QUERIES, "item_id long, text string")
    got = TF.fallback_search(docs, "doc_id", "text", qs, "item_id", "text", 3).collect()
    exp = brute_fallback(3)
    by_q = {}
    for r in sorted(got, key=lambda r: (r.item_id, r["rank"])):
        by_q.setdefault(r.item_id, []).append((r.doc_id, r.score))
    for q in exp:
        assert [d for d, _ in by_q.get(q, [])] == [d for d, _ in exp[q]]
        for (_, a), (_, b) in zip(by_q.get(q, []), exp[q]):
            assert a == pytest.approx(b)


def test_search_over_many_blocks_with_copies(spark, monkeypatch):
    """Small blocks give what one block gives; copies tie by key, both ways."""
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(60)] + ["word1 word2 word3"] * 30
    docs = spark.createDataFrame([(f"d{i:03d}", t) for i, t in enumerate(texts)], "doc string, text string")
    qs = spark.createDataFrame([(i, " ".join(rng.choice(words, 4))) for i in range(12)] + [(90, "word1 word2 word3"), (91, "nothing")],
                               "item_id int, text string")

    def found():
        return [[tuple(r) for r in f(docs, "doc", "text", qs, "item_id", "text", 7).select("item_id", "doc", "rank", F.round("score", 9))
                 .orderBy("item_id", "rank").collect()] for f in (TF.fallback_search, TF.query_fit_search)]

    whole = found()
    monkeypatch.setattr(TF, "DOC_ENTRIES", 50)
    monkeypatch.setattr(TF, "QUERY_ENTRIES", 20)
    assert found() == whole
    copies = [[r[1] for r in rows if r[0] == 90] for rows in whole]
    assert copies[0] == [f"d{i:03d}" for i in range(60, 67)] and copies[1] == [f"d{i:03d}" for i in range(89, 82, -1)]
    assert not [r for rows in whole for r in rows if r[0] == 91]


def test_search_over_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    qs = spark.createDataFrame(QUERIES, "item_id long, text string")
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    for f in (TF.fallback_search, TF.query_fit_search):
        assert f(none, "doc_id", "text", qs, "item_id", "text", 3).count() == 0
        assert f(docs, "doc_id", "text", qs.limit(0), "item_id", "text", 3).count() == 0


def test_search_shuffles_no_pairs(spark):
    """Scores leave the block sums through the partial top-k only."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    qs = spark.createDataFrame(QUERIES, "item_id long, text string")
    plan = TF.fallback_search(docs, "doc_id", "text", qs, "item_id", "text", 3)._jdf.queryExecution().executedPlan().toString()
    lines = [x.split("#")[0] for x in plan.splitlines()]
    sums = next(i for i, x in enumerate(lines) if "CoGroups" in x)
    limits = [i for i, x in enumerate(lines) if "WindowGroupLimit" in x]
    exchanges = [i for i, x in enumerate(lines) if "Exchange" in x and i < sums]
    assert len(exchanges) == 1 and any(exchanges[0] < i < sums for i in limits), plan


def test_pair_cosine(spark):
    a = spark.createDataFrame([(1, "t", 2), (1, "u", 1), (2, "x", 1), (3, "s", 1)], "k long, term string, tf long")
    b = spark.createDataFrame([(1, "t", 2), (1, "u", 1), (2, "y", 1)], "k long, term string, tf long")
    r = {x.k: x.pair_tfidf for x in TF.pair_cosine(a, b, "k").collect()}
    assert r[1] == pytest.approx(1.0) and r[2] == 0.0 and r[3] == 0.0


def test_cosine_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    items = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    items.append((60, [0.0] * 8))          # zero vector -> similarity 0
    items.append((61, [1.0, 2.0]))         # other dimension -> skipped
    qs = [(100 + j, rng.normal(size=8).tolist()) for j in range(7)]
    di = spark.createDataFrame(items, "id long, v array<double>")
    dq = spark.createDataFrame(qs, "id long, v array<double>")
    got = V.cosine_knn(dq, "id", "v", di, "id", "v", 5, q_block_rows=3, i_block_rows=16).collect()
    M = np.array([v for _, v in items[:61]])
    for qid, qv in qs:
        q = np.array(qv)
        sims = [(float(M[i] @ q / (np.linalg.norm(M[i]) * np.linalg.norm(q))) if np.linalg.norm(M[i]) else 0.0, i)
                for i in range(61)]
        exp = [i for _, i in sorted(sims, key=lambda x: (-round(x[0], 12), x[1]))[:5]]
        mine = [r.i_id for r in sorted([r for r in got if r.q_id == qid], key=lambda r: r["rank"])]
        assert mine == exp


def test_cosine_knn_exclude_self_and_floor(spark):
    vs = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])]
    d = spark.createDataFrame(vs, "id long, v array<double>")
    got = V.cosine_knn(d, "id", "v", d, "id", "v", 3, exclude_self=True, min_similarity=0.1).collect()
    pairs = {(r.q_id, r.i_id) for r in got}
    assert (1, 1) not in pairs and (1, 2) in pairs and (1, 4) not in pairs


def brute_examples(incidents, examples, k):
    out = {}
    u = 1 + math.log(1.5)
    for iid, pt, text, kws in incidents:
        scored = []
        for ept, ordn, ekw, inp in examples:
            if ept != pt:
                continue
            kw = len(set(kws) & set(ekw)) / len(ekw) if ekw else 0.0
            a, b = Counter(toks(text)), Counter(toks(inp))
            shared = set(a) & set(b)
            na = math.sqrt(sum(a[t] ** 2 for t in shared) + u * u * sum(a[t] ** 2 for t in set(a) - shared))
            nb = math.sqrt(sum(b[t] ** 2 for t in shared) + u * u * sum(b[t] ** 2 for t in set(b) - shared))
            cos = sum(a[t] * b[t] for t in shared) / (na * nb) if na and nb else 0.0
            scored.append((0.6 * kw + 0.4 * cos, ordn))
        scored.sort(key=lambda x: (-round(x[0], 12), x[1]))
        out[iid] = [o for _, o in scored[:k]]
    return out


def test_select_examples_matches_all_pairs(spark):
    incidents = [(1, "p", "agent crash on macos", ["agent", "crash"]),
                 (2, "p", "firewall blocked", []),
                 (3, "q", "policy sync failure", ["sync"])]
    examples = [("p", 0, ["agent", "agent", "memory"], "agent memory leak"),
                ("p", 1, [], "firewall rules"),
                ("p", 2, ["crash"], "macos crash"),
                ("p", 3, ["x"], "unrelated text"),
                ("p", 4, ["y"], "unrelated words"),
                ("p", 5, ["z"], "more unrelated"),
                ("p", 6, ["crash"], "crash"),
                ("q", 7, ["sync"], "sync failure on policy")]
    di = spark.createDataFrame(incidents, "incident_id long, prompt_type string, text string, keywords array<string>")
    de = spark.createDataFrame([(pt, o, kw, "c", i, "out") for pt, o, kw, i in examples],
                               "prompt_type string, ordinal long, keywords array<string>, category string, "
                               "input string, output string")
    got = EX.select_examples(di, de, 5).collect()
    exp = brute_examples(incidents, examples, 5)
    for iid, ords in exp.items():
        mine = [r.ordinal for r in sorted([r for r in got if r.incident_id == iid], key=lambda r: r["rank"])]
        assert mine == ords


def test_example_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(25)]
    incidents = [(i, "pq"[i % 2], " ".join(rng.choice(words, 6)), list(rng.choice(words, 2))) for i in range(30)] + [(90, "p", None, None)]
    examples = [("pq"[i % 2], i, list(rng.choice(words, 2)), "c", " ".join(rng.choice(words, 6)), "out") for i in range(40)]
    di = spark.createDataFrame([(a, b, c, [str(x) for x in d] if d else d) for a, b, c, d in incidents],
                               "incident_id long, prompt_type string, text string, keywords array<string>")
    de = spark.createDataFrame([(a, b, [str(x) for x in c], *rest) for a, b, c, *rest in examples],
                               "prompt_type string, ordinal long, keywords array<string>, category string, input string, output string")

    def found():
        return [tuple(r) for r in EX.select_examples(di, de, 5).select("incident_id", "rank", "ordinal", F.round("score", 9))
                .orderBy("incident_id", "rank").collect()]

    whole = found()
    assert [r[2] for r in whole if r[0] == 90] == [0, 2, 4, 6, 8]  # nothing shared: the catalogue's order
    exp = brute_examples([x for x in incidents if x[0] != 90], [(a, b, c, e) for a, b, c, _, e, _ in examples], 5)
    assert {i: [r[2] for r in whole if r[0] == i] for i in exp} == exp
    monkeypatch.setattr(EX, "INCIDENT_ROWS", 7)
    monkeypatch.setattr(EX, "EXAMPLE_ROWS", 9)
    assert found() == whole


def test_blank_documents_do_not_count(spark):
    blank = DOCS + [(900, ""), (901, "  "), (902, None)]
    found = [TF.docs_only_index(spark.createDataFrame(d, "doc_id long, text string"), "doc_id", "text")[1].orderBy("term").collect()
             for d in (DOCS, blank)]
    assert found[0] == found[1]


def test_index_follows_its_files(spark, tmp_path):
    p = str(tmp_path / "docs")
    for word in ("first", "second"):  # the same path, replaced in place
        spark.createDataFrame([(1, f"{word} zebra"), (2, "other thing")], "doc_id long, text string").write.mode("overwrite").parquet(p)
        vocab = TF.docs_only_index(spark.read.parquet(p), "doc_id", "text")[1]
        assert vocab.filter(F.col("term").contains(word)).count() == 1


def test_model_embedding_slot(spark):
    def encode(texts):
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    col = V.model_embedding(encode, 2)
    df = spark.createDataFrame([(1, "banana"), (2, ""), (3, None)], "id int, t string")
    got = {r.id: r.v for r in df.select("id", col("t").alias("v")).collect()}
    assert got[1] == [6.0, 3.0] and got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]


@pytest.mark.parametrize("k,exclude,floor", [(1, True, None), (4, False, None), (15, True, 0.1)])
def test_tiles_give_the_best_of_all_pairs(monkeypatch, k, exclude, floor):
    monkeypatch.setattr(V, "TILE", (7, 90))
    rng = np.random.default_rng(k)
    x = rng.standard_normal((300, 9))
    x[50:150] = x[50]  # copies
    x[200:205] = 0.0
    x[205:210] *= 1e-141
    ids = rng.integers(0, 250, 300)  # some repeat
    sizes = np.linalg.norm(x, axis=1)
    whole = np.divide(x @ x.T, np.outer(sizes, sizes), out=np.zeros((300, 300)), where=np.outer(sizes, sizes) > 0)
    want = []
    for q in range(300):
        some = [j for j in range(300) if not (exclude and ids[j] == ids[q]) and (floor is None or whole[q, j] > floor)]
        want += [(int(ids[q]), int(ids[j])) for j in sorted(some, key=lambda j: (-round(whole[q, j], 12), ids[j]))[:k]]
    table = pa.table({"id": ids, "v": pa.array(list(x), pa.list_(pa.float64()))})
    got = V.block_scorer(k, exclude, floor)(table, table)
    assert sorted(zip(got["q_id"].to_pylist(), got["i_id"].to_pylist())) == sorted(want)


def test_vectors_of_a_search_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(20)], "id long, v array<double>").mapInArrow(count, "id long, v array<double>")
    assert V.cosine_knn(d, "id", "v", d, "id", "v", 2, exclude_self=True).count() == 40
    assert seen.value == 20


def test_embedding_has_no_expression_for_each_element(spark):
    d = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (None, "delta"), (4, " ")], "id long, text string")
    e, _ = V.corpus_embedding(d, "id", "text", 16)
    assert "transform(" not in e._jdf.queryExecution().toString()
    rows = {r.id: r.embedding for r in e.collect()}
    assert rows.keys() == {1, 2, None} and all(len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-12 for v in rows.values())


def test_a_small_batch_reads_the_index_once(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} other{k}") for k in range(40)], "id long, text string")
    index, vocab = TF.docs_only_index(docs, "id", "text")
    got = TF.probe_docs_only(index, vocab, "id", docs.limit(3).withColumnRenamed("id", "q"), "q", "text", 2)
    assert "sequence(0, 0" in got._jdf.queryExecution().toString()
