"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors become integers, floor(256 * x).  Candidates are dealt into blocks of
about ``BLOCK_ROWS`` by the hash of their id, queries into blocks of
``QUERY_ROWS``; every block of queries meets every block of candidates in a
cogroup.  In a block each dimension has a list of the candidates sorted by
their value.  A query reads all lists from its own side (largest values for
positive weights, smallest for negative ones) a few entries deeper each time,
scores every candidate that it sees for the first time in full, and stops once
the sum of weight times current list value, which no unseen candidate can
exceed, is below its k-th score.  Equal scores keep it reading, since a smaller
id may still come.  The best k of each block are merged per query.

Cases: vectors that are null, empty or hold null or non-finite components take
no part; rows that share an id are rows of their own, each a candidate for the
others and each, where its id is asked for, a query of its own (so a query_id can
come with several answers); equal rows are searched once, with their number, of
which a search needs no more than k + 1; vectors of other lengths than the
query's are no candidates; fewer than k candidates give as
many rows; an empty table gives an empty result; other columns are not read.
Scores are 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
BLOCK_ROWS = 1024
QUERY_ROWS = 1024
SCALE = 256


class SortedLists:
    """One block's vectors and, per dimension, its rows by rising value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.exact = vectors.astype(np.float64)
        self.largest = int(np.abs(vectors).max(initial=0))
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def own_row(self, query: np.ndarray, own: int) -> np.ndarray:
        """Mask of one row that has the id and the vector, if there is any."""
        mask = np.zeros(len(self.ids), bool)
        for row in np.flatnonzero(self.ids == own):
            if np.array_equal(self.vectors[row], query):
                mask[row] = True
                break
        return mask

    def best(self, query: np.ndarray, own: int, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best rows but those of the id ``own`` (or those
        of the mask ``skip``), and how deep the lists were read."""
        n = len(self.ids)
        small = self.largest * int(np.abs(query).max(initial=0)) * len(query) < 2**53  # exact as doubles
        table, weights = (self.exact, query.astype(np.float64)) if small else (self.vectors, query)
        up, down = np.flatnonzero(query > 0 if query.any() else query == 0), np.flatnonzero(query < 0)
        seen = self.ids == own if skip is None else skip.copy()
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, 8
        while depth < n:
            to = min(n, depth + step)
            new = np.zeros(n, bool)
            new[self.order[n - to:n - depth, up].reshape(-1)] = True
            new[self.order[depth:to, down].reshape(-1)] = True
            fresh = np.flatnonzero(new & ~seen)
            seen |= new
            if len(fresh):
                got = (table[fresh] @ weights).astype(np.int64)
                rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, got])
                keep = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[keep], scores[keep]
            depth, step = to, step * 2
            bound = int(self.sorted[n - to, up] @ query[up]) + int(self.sorted[to - 1, down] @ query[down])
            if len(rows) == k and scores[-1] > bound:
                break
        return self.ids[rows], scores, depth


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, n, dims): the distinct integer vectors of each id that take
    part, with their number of rows."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(finite)
    ints = rows.select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE).cast("bigint")).alias("v"))
    return ints.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("dims", F.size("v"))


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for
    which ``is_query`` (a function of the id column) holds.  A query is named by
    its id and 128 bits of its vector's digest."""
    vectors = whole_vectors(df, id_col, vector_col)
    counts = df.select(F.count(F.lit(1)).alias("n"), F.count_if(is_query(F.col(f"`{id_col}`"))).alias("q")).first()
    n_blocks, n_sets = (max(1, -(-counts[c] // size)) for c, size in (("n", block_rows), ("q", query_rows)))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    digest = F.md5(F.array_join(F.col("v").cast("array<string>"), ",").cast("binary"))
    candidates = vectors.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k + 1))))).select(
        "vec_id", "v", "dims", part(n_blocks).alias("block")).withColumn("part", every(n_sets))
    queries = vectors.where(is_query(F.col("vec_id"))).select(
        "vec_id", "v", "n", digest.alias("name"), "dims", part(n_sets).alias("part")).withColumn("block", every(n_blocks))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        asked, ids, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            lists = SortedLists(left["vec_id"].to_numpy(np.int64), np.stack(left["v"].to_numpy()).astype(np.int64))
            for row, (own, v) in enumerate(zip(right["vec_id"].tolist(), right["v"])):
                v = np.asarray(v, np.int64)
                got, values, _ = lists.best(v, own, k, lists.own_row(v, own))
                asked += [row] * len(got)
                ids.append(got)
                scores.append(values)
        queries = right.iloc[asked][["vec_id", "name", "n"]].reset_index(drop=True).set_axis(["query_id", "name", "n"], axis=1)
        return queries.assign(vec_id=np.concatenate(ids), score=np.concatenate(scores))

    keys = ["block", "part", "dims"]
    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(
        search, "query_id bigint, name string, n bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rows = best.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))  # equal rows have equal answers
    return rows.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.row_id, q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.row_id <> q.row_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
