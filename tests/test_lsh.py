import numpy as np
import pytest

from casebook.operators import lsh as L
from casebook.operators import vectors as V


def clustered(n, dims, rng, centres, spread):
    x = rng.standard_normal((centres, dims))[rng.integers(0, centres, n)]
    return x + spread * rng.standard_normal((n, dims))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(c) for c in v]) for k, v in enumerate(x)], "id long, v array<double>")


def test_tuned_on_clusters_reaches_the_recall_with_few_pairs(spark):
    rng = np.random.default_rng(0)
    x = clustered(3000, 32, rng, 150, 0.25)
    x[500:1500] = x[500]  # a third are copies: one bucket, many blocks
    items = frame(spark, x)
    queries = frame(spark, np.concatenate([x[::25], x[:20] * 3]), 10_000)
    exact = V.cosine_knn(queries, "id", "v", items, "id", "v", 5, min_similarity=0.1).cache()
    got = L.lsh_knn(queries, "id", "v", items, "id", "v", 5, min_similarity=0.1, sample_queries=64, block_rows=300).cache()
    assert L.recall_of(got, exact) >= 0.9
    rounded = lambda rows: {(r["q_id"], r["i_id"]): round(r["similarity"], 9) for r in rows.collect()}
    a, b = rounded(got), rounded(exact)
    assert all(a[p] == b[p] for p in a.keys() & b.keys())  # similarities are exact
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "bucket" in plan

    truth = [(r["q_id"], r["i_id"]) for r in exact.collect()]
    q = {k: v for k, v in zip(range(10_000, 11_000), np.concatenate([x[::25], x[:20] * 3]))}
    hashing = L.tune(np.array([q[t] for t, _ in truth]), np.array([x[t] for _, t in truth]), 3000, 0.9)
    assert hashing.tables * hashing.probes / 2 ** hashing.bits < 0.35


def test_unclustered_vectors_fall_back_to_the_exact_search(spark):
    rng = np.random.default_rng(1)
    d = frame(spark, rng.standard_normal((200, 48)))
    got = L.lsh_knn(d, "id", "v", d, "id", "v", 3, exclude_self=True, recall=0.99)
    exact = V.cosine_knn(d, "id", "v", d, "id", "v", 3, exclude_self=True)
    key = lambda rows: sorted((r["q_id"], r["i_id"], r["rank"]) for r in rows.collect())
    assert key(got) == key(exact)


def test_probes_are_in_order_and_reach_every_bucket():
    rng = np.random.default_rng(2)
    h = L.Hashing(5, 32)
    m = h.margins(rng.standard_normal((7, 9)))
    p = h.probed(m)
    assert all(sorted(p[r, t].tolist()) == list(range(32)) for r in range(7) for t in range(h.tables))
    assert (p[:, :, 0] == h.buckets(m)).all()
    a, b = rng.standard_normal((40, 9)), rng.standard_normal((40, 9))
    need, to, own = h.needed(a, b), h.probed(h.margins(a)), h.buckets(h.margins(b))
    for r in range(40):
        assert need[r] == min(to[r, t].tolist().index(own[r, t]) + 1 for t in range(h.tables))


@pytest.mark.parametrize("hashing", [L.Hashing(3, 8), None])
def test_awkward_rows(spark, hashing):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [1.0, 0.0, 0.0]), (6, [0.9, 0.1, 0.0]), (7, []), (1, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("*", "1 AS bucket", "'x' AS t")
    got = L.lsh_knn(d, "id", "v", d, "id", "v", 2, exclude_self=True, min_similarity=0.5, hashing=hashing)
    pairs = {(r["q_id"], r["i_id"]) for r in got.collect()}
    assert {(1, 2), (2, 1), (5, 6), (6, 5)} <= pairs and not {4, 7} & {p[0] for p in pairs}
    assert L.lsh_knn(d.limit(0), "id", "v", d, "id", "v", 2, hashing=hashing).count() == 0
    assert L.lsh_knn(d, "id", "v", d.limit(0), "id", "v", 2, hashing=hashing).count() == 0


def test_a_query_goes_once_to_a_shard(spark):
    rows = L._vectors(frame(spark, np.random.default_rng(3).standard_normal((50, 16))), "id", "v")
    h = L.Hashing(8, 100)
    got = L._hashed(rows, h, 4, True).collect()
    assert len({(r.id, r.t, r.shard) for r in got}) == len(got) <= 50 * h.tables * 4
    x = np.array([r.v for r in rows.orderBy("id").collect()])
    want = [set(b.ravel().tolist()) for b in h.probed(h.margins(x))[:, 0]]
    assert [{b for r in got if r.id == k and r.t == 0 for b in r.buckets} for k in range(50)] == want
    assert all(b % 4 == r.shard for r in got for b in r.buckets)


def test_shards_give_the_rows_of_their_buckets(spark):
    rng = np.random.default_rng(4)
    x = clustered(300, 8, rng, 12, 0.4)
    x[100:160] = x[100]
    h, d = L.Hashing(5, 6), frame(spark, x)
    got = {}
    for r in L.lsh_knn(d, "id", "v", d, "id", "v", 3, exclude_self=True, hashing=h, block_rows=40).collect():
        got.setdefault(r.q_id, []).append((r.i_id, round(r.similarity, 9)))
    m = h.margins(x)
    own, to, n = h.buckets(m), h.probed(m), np.linalg.norm(x, axis=1)
    sims = x @ x.T / np.outer(n, n)
    for q in range(300):
        met = [i for i in range(300) if i != q and any(own[i, t] in to[q, t] for t in range(h.tables))]
        best = sorted(met, key=lambda i: (-round(sims[q, i], 12), i))[:3]
        assert sorted(got.get(q, [])) == sorted((i, round(float(sims[q, i]), 9)) for i in best)
