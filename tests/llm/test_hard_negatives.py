from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.llm import hard_negatives as H


def clustered(n, dims, rng, centres=12, spread=0.15):
    x = rng.standard_normal((centres, dims))[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dims))
    return np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)


def brute_windows(ids, labels, vectors, names, q, windows, k, same):
    s = vectors @ vectors[q]
    fits = (labels == labels[q]) if same else (labels != labels[q])
    if same:
        fits[q] = False
    return [sorted((-int(s[r]), int(ids[r])) for r in np.flatnonzero(fits & (s >= lo) & (s <= hi)))[:k] for lo, hi in windows]


@pytest.mark.parametrize("spread", [0.15, 3.0])
@pytest.mark.parametrize("same", [True, False])
def test_tree_is_exact_and_leaves_out_siblings(spread, same):
    rng = np.random.default_rng(3)
    n = 3000
    vectors = clustered(n, 8, rng, spread=spread)
    vectors[100:160] = vectors[100]  # ties
    ids, labels = rng.permutation(n), rng.integers(0, 4, n)
    names = [np.arange(n), np.arange(n) * 7, np.zeros(n, np.int64)]
    top = float((vectors ** 2).sum(axis=1).max())
    tree = H.Tree(ids, labels, vectors, names, top, fanout=6, leaf_rows=20)
    anchors = rng.choice(n, 80, replace=False)
    windows = [[(H.LEAST, H.MOST)] if same else [(int(0.8 * p), p) for p in (65000, 60000, 50000, 0)] for _ in anchors]
    owner = np.repeat(np.arange(80), [len(w) for w in windows])
    lo, hi = np.array([x for w in windows for x in w]).T
    queries = H.Queries(vectors[anchors], labels[anchors], (names[0][anchors], names[1][anchors]), owner, lo, hi)
    window, found, score = tree.search(queries, 5, same)
    got = [[] for _ in owner]
    for w, i, s in zip(window.tolist(), found.tolist(), score.tolist()):
        got[w].append((-s, i))
    want = [x for q, w in zip(anchors, windows) for x in brute_windows(ids, labels, vectors, names, q, w, 5, same)]
    assert got == want
    if spread < 1:
        assert tree.scored < 0.5 * n * 80


def test_large_components_are_scored_as_integers():
    vectors = np.array([[2**29, 1], [2**29, -1], [2**29, 3], [5, 5]], np.int64)
    names = [np.arange(4)] * 2 + [np.zeros(4, np.int64)]
    tree = H.Tree(np.arange(4), np.array([0, 1, 1, 0]), vectors, names, float((vectors.astype(float) ** 2).sum(axis=1).max()))
    queries = H.Queries(vectors[:1], np.array([0]), (np.array([0]), np.array([0])), np.array([0]), np.array([0]), np.array([H.MOST]))
    window, ids, score = tree.search(queries, 1, False)
    assert (ids.tolist(), score.tolist()) == ([2], [2**58 + 3])


def rows(rng):
    out = [(k, [float(v) for v in x / 256], int(rng.integers(0, 4))) for k, x in enumerate(clustered(700, 5, rng, spread=0.6))]
    out += [(k, [1.0, 0.5, 0.0, 0.0, 0.0], k % 3) for k in range(800, 860)]  # ties
    out += [(800, [1.0, 0.5, 0.0, 0.0, 0.0], 2)] * 9 + [(1100, [0.5, 0.5, 0.0, 0.0, 0.1], 1)] * 3  # repeated rows, anchors among them
    out += [(900, None, 1), (1000, [1.0, None, 0.0, 0.0, 0.0], 1), (1001, [float("nan")] * 5, 1), (1002, [float("inf")] * 5, 1),
            (1003, [1.0] * 5, None), (None, [1.0] * 5, 1), (1200, [1.0, 2.0], 1), (1201, [1.5, 2.0], 1), (1203, [1.5, 1.9], 3),
            (1300, [], 1), (1301, [], 1), (1303, [], 2), (1400, [-1.0, 0.0, 0.0, 0.0, 0.0], 9), (1500, [0.0] * 5, 3), (100, [0.3] * 5, 1)]
    return out


@pytest.mark.parametrize("block_rows,request_rows", [(60, 3), (1 << 14, 1 << 14)])
def test_equals_sql(spark, block_rows, request_rows):
    data = rows(np.random.default_rng(1))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rank", "'x' AS v", "2 AS n")
    df = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    anchors = lambda c: c % 100 == 0
    got = H.hard_negatives(df, anchors, block_rows=block_rows, request_rows=request_rows, fanout=4, leaf_rows=8)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings(vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?,?,?)", data)
    want = con.execute(H.ORACLE_SQL)
    assert got.columns == [c[0] for c in want.description]
    want = Counter(want.fetchall())
    assert Counter(map(tuple, got.collect())) == want
    assert {800, 1100, 1200, 1300} <= {r[0] for r in want}
    if block_rows > 1000:
        assert H.hard_negatives(df.limit(0), anchors).count() == 0
        assert H.hard_negatives(df.where("vec_id = 1"), anchors).count() == 0
