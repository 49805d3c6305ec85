import duckdb
import numpy as np
import pytest

from casebook.llm import topk as T


def test_threshold_algorithm_stops_early_and_is_exact():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.standard_normal((500, 6)) ** 3).astype(np.int64)
    lists = T.SortedLists(np.arange(500) * 7, x)
    depths = []
    for own in range(40):
        q = x[own] * (rng.random(6) < 0.7)
        ids, scores, depth = lists.best(q, own * 7, 5)
        s = x @ q
        want = sorted((-int(s[k]), k * 7) for k in range(500) if k != own)[:5]
        assert [(-int(a), int(b)) for a, b in zip(scores, ids)] == want
        depths.append(depth)
    assert min(depths) < 100
    big = np.array([[2**40, 1], [2**40, -1], [3, 4]], np.int64)
    assert T.SortedLists(np.arange(3), big).best(np.array([1, 2**30]), 2, 2)[1].tolist() == [2**40 + 2**30, 2**40 - 2**30]


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_equals_sql(spark, block_rows):
    rng = np.random.default_rng(1)
    rows = [(k, [float(v) for v in np.round(rng.standard_normal(4), 1)]) for k in range(200)]
    rows += [(k, [1.0, 1.0, 0.5, 0.0]) for k in range(300, 330)]  # ties
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0]), (450, [float("nan"), 0.0, 0.0, 0.0]), (452, [float("inf"), 0.0, 0.0, 0.0]),
             (500, [0.0] * 4), (550, [1.0, 2.0]), (551, [2.0, 2.0]), (600, [1.0]), (0, rows[0][1]), (3, [9.0, 9.0, 9.0, 9.0]), (None, [1.0] * 4),
             (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "'x' AS v")
    got = sorted(tuple(r) for r in T.top_k(df, lambda c: c % 50 == 0, block_rows=block_rows, query_rows=3).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings(vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?,?)", rows)
    assert got == sorted(con.execute(T.ORACLE_SQL).fetchall())
    assert {r[0] for r in got} >= {0, 50, 500, 550} and not {400, 450, 600} & {r[0] for r in got}
    assert T.top_k(df.limit(0), lambda c: c % 50 == 0).count() == 0


def test_rows_that_share_an_id_are_all_searched(spark):
    rows = [(1, [0.1, 0.1]), (1, [0.9, 0.9]), (50, [1.0, 1.0])] + [(2, [0.5, 0.5])] * 30 + [(100, [1.0, 0.0])] * 8 + [(100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in T.top_k(df, lambda c: c % 50 == 0, block_rows=3, query_rows=2).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings(vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?,?)", rows)
    assert got == sorted(con.execute(T.ORACLE_SQL).fetchall())
    assert len(got) == 5 * 10 and (50, 1, 1, 460) not in got and any(r[0] == 50 and r[2] == 1 for r in got)
