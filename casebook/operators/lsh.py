"""Approximate cosine k-nearest neighbours for stores too large for the exact
search (J5, J9, R3): random-hyperplane hashing with several tables, probes
directed by the query, exact similarities.

* A table is a set of random hyperplanes; a vector's bucket is the sides it lies
  on.  A query visits, in each table, its own bucket and those behind the
  hyperplanes nearest to it, in the order of the squared distances crossed.
* ``tune`` picks hyperplanes and probes for a wanted recall: the exact
  neighbours of a bounded sample of queries are found once, and for every number
  of hyperplanes it is counted how many probes would have met them.  The setting
  that compares the fewest pairs wins; where none compares fewer than all pairs,
  the exact search runs instead.
* The buckets of a table are dealt into shards of about ``BLOCK_ROWS`` items.
  Queries and items meet in a co-group per (table, shard): a query's vector goes
  once to a shard, with the list of the buckets that it visits there, so what is
  shuffled follows the shards and not the probes.  A shard with more than
  ``BLOCK_ROWS`` items or queries is dealt into blocks, so copies of one vector
  do not end in one task.  In a block pair every bucket is one matrix product;
  it hands on at most ``k`` rows a query, and a pair found in several tables
  counts once.
* Nothing hashed is written: the shards' sizes come from a pass of their own.

So the similarities are exact, no pair is a row before the cut, and a query meets
only the buckets it probes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tfidf import top_k
from .vectors import OUT_SCHEMA, OUT_TYPES, best_pairs, cosine_knn, found_rows, ids_of, kept, kth_of, plain_vectors, vectors_of

TABLES = 4
RECALL = 0.95
SAMPLE_QUERIES = 256
BUCKET_ROWS = 64  # mean size of the smallest buckets tried
MAX_BITS = 24
FLIP_BITS = 10  # hyperplanes a probe may cross
BLOCK_ROWS = 32768
MERGE_ROWS = 1 << 21  # rows of a block pair's buckets that are held before a cut
SEED = 7


@dataclass(frozen=True)
class Hashing:
    """``tables`` tables of ``bits`` hyperplanes; queries visit ``probes``
    buckets of each."""

    bits: int
    probes: int
    tables: int = TABLES
    seed: int = SEED

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        """[row, table, hyperplane]: signed distances of the unit vectors."""
        dims = vectors.shape[1]
        planes = np.random.default_rng([self.seed, dims]).standard_normal((self.tables, MAX_BITS, dims))[:, :self.bits]
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = np.divide(vectors, length, out=np.zeros(vectors.shape), where=length > 0)
        return np.einsum("nd,tbd->ntb", unit, planes, optimize=True)

    def buckets(self, margins: np.ndarray) -> np.ndarray:
        """[row, table]: the bucket of each row."""
        return (margins >= 0).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))

    def crossings(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[row, table, set]: the bits flipped by every set of the hyperplanes
        nearest to the row, and the squared distance it crosses."""
        near = min(self.bits, FLIP_BITS)
        low = np.argsort(np.abs(margins), axis=2, kind="stable")[:, :, :near]
        sets = (np.arange(1 << near)[:, None] >> np.arange(near)) & 1
        cost = np.take_along_axis(margins, low, axis=2) ** 2 @ sets.T
        return (np.int64(1) << low.astype(np.int64)) @ sets.T.astype(np.int64), cost

    def probed(self, margins: np.ndarray) -> np.ndarray:
        """[row, table, probe]: the buckets a query visits, nearest first."""
        flips, cost = self.crossings(margins)
        order = np.argsort(cost, axis=2, kind="stable")[:, :, :self.probes]
        return self.buckets(margins)[:, :, None] ^ np.take_along_axis(flips, order, axis=2)

    def needed(self, query: np.ndarray, neighbour: np.ndarray) -> np.ndarray:
        """Per row, the probes after which the query's tables have met the
        neighbour (infinite: more than FLIP_BITS hyperplanes lie between)."""
        mine, theirs = self.margins(query), self.margins(neighbour)
        flips, cost = self.crossings(mine)
        apart = self.buckets(mine) ^ self.buckets(theirs)
        same = flips == apart[:, :, None]
        at = np.where(same, cost, np.inf).min(axis=2)
        rank = (cost < at[:, :, None]).sum(axis=2) + 1.0
        return np.where(same.any(axis=2), rank, np.inf).min(axis=1)


def tune(query: np.ndarray, neighbour: np.ndarray, n_items: int, recall: float, tables: int = TABLES,
         bucket_rows: int = BUCKET_ROWS) -> Hashing | None:
    """The cheapest hashing under which the sampled queries meet the wanted
    share of their neighbours (row by row); None if that is the exact search."""
    best, least = None, 1.0
    for bits in range(1, min(MAX_BITS, math.ceil(math.log2(max(2.0, n_items / bucket_rows)))) + 1):
        needs = np.sort(Hashing(bits, 1, tables).needed(query, neighbour))
        probes = needs[max(0, math.ceil(recall * len(needs)) - 1)] if len(needs) else np.inf
        share = tables * probes / 2.0 ** bits
        if share < least:
            best, least = Hashing(bits, int(probes), tables), share
    return best


def _vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    return plain_vectors(df, key, vec).where(F.col("v").isNotNull()).withColumn("dims", F.size("v"))


def _hashed(rows: DataFrame, hashing: Hashing, shards: int, probe: bool) -> DataFrame:
    """(id, v, dims, t, shard, buckets): a row for each shard of each table that
    a vector visits (an item: lies in), with its buckets there."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                dims = batch.column(2).to_numpy()
                for d in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == d))
                    margins = hashing.margins(np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, d))
                    to = hashing.probed(margins) if probe else hashing.buckets(margins)[:, :, None]
                    for t in range(hashing.tables):
                        yield by_shard(part, t, to[:, t])

    def by_shard(part, t, buckets):
        by = np.argsort(buckets % shards, axis=1, kind="stable")
        buckets = np.take_along_axis(buckets, by, axis=1)
        shard = buckets % shards
        starts = np.flatnonzero(np.concatenate([np.ones((len(shard), 1), bool), np.diff(shard, axis=1) != 0], axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, shard.size).astype(np.int32)), pa.array(buckets.reshape(-1).astype(np.int32)))
        columns = part.take(pa.array(starts // shard.shape[1])).columns
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.full(len(starts), t, np.int32)), pa.array(shard.reshape(-1)[starts].astype(np.int32)), lists],
            names=["id", "v", "dims", "t", "shard", "buckets"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(run, f"id long, v {kind}, dims int, t int, shard int, buckets array<int>")


def _dealt(rows: DataFrame, other_sizes: DataFrame, own_sizes: DataFrame, own: str, other: str) -> DataFrame:
    """Each row in one block of its own side, repeated for every block of the
    other side; shards that the other side lacks go."""
    keys = ["dims", "t", "shard"]
    both = rows.join(other_sizes.withColumnRenamed("blocks", "theirs"), keys).join(own_sizes, keys)
    return both.select(*keys, F.pmod(F.xxhash64("id"), "blocks").cast("int").alias(own),
                       F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)).alias(other), "id", "v", "buckets")


def bucket_scorer(k: int, exclude_self: bool, min_similarity: float | None):
    """The ``k`` best items of a block for each of its queries, among the items of
    the buckets that the query visits; tables of (id, v, buckets)."""
    kk, excl, floor = int(k), bool(exclude_self), min_similarity

    def members(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, place) of each visit, in the order of the buckets."""
        visits = table["buckets"].combine_chunks()
        buckets = visits.flatten().to_numpy()
        order = np.argsort(buckets, kind="stable")
        return buckets[order], np.repeat(np.arange(len(visits)), visits.value_lengths().to_numpy())[order]

    def score(qs: pa.Table, its: pa.Table) -> pa.Table:
        if not qs.num_rows or not its.num_rows:
            return OUT_TYPES.empty_table()
        ((q_key, q),), ((i_key, i),) = vectors_of(qs).values(), vectors_of(its).values()
        qids, iids = ids_of(q_key), ids_of(i_key)
        (q_bucket, q_at), (i_bucket, i_at) = members(qs), members(its)
        reached = np.full(len(q), -np.inf)
        held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

        def cut():
            rows, cols, sims = (np.concatenate([h[x] for h in held]) for x in range(3))
            few = kept(rows, iids[cols], sims, kk)
            return [(rows[few], cols[few], sims[few])]

        for bucket in np.intersect1d(q_bucket, i_bucket).tolist():
            a, b = (at[slice(*np.searchsorted(of, [bucket, bucket + 1]))] for of, at in ((q_bucket, q_at), (i_bucket, i_at)))
            rows, cols, sims = best_pairs(qids[a], q[a], iids[b], i[b], kk, excl, floor, reached[a])
            reached[a] = np.maximum(reached[a], kth_of(rows, sims, len(a), kk))
            held.append((a[rows], b[cols], sims))
            n += len(rows)
            if n > MERGE_ROWS:
                held, n = cut(), 0
        return found_rows(q_key, i_key, *cut()[0])

    return score


def lsh_knn(queries: DataFrame, q_key: str, q_vec: str, items: DataFrame, i_key: str, i_vec: str, k: int,
            exclude_self: bool = False, min_similarity: float | None = None, recall: float = RECALL,
            hashing: Hashing | None = None, sample_queries: int = SAMPLE_QUERIES, bucket_rows: int = BUCKET_ROWS,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``cosine_knn`` with a wanted recall: ``q_id, i_id, similarity, rank``.

    Without ``hashing`` it is tuned on ``sample_queries`` queries (the first by
    a hash of their key), whose exact neighbours are searched among all items.
    Rows without a vector take no part; the zero vector has similarity 0 to the
    items of the buckets it visits."""
    q = cut_lineage(_vectors(queries, q_key, q_vec), "lsh-queries")
    i = cut_lineage(_vectors(items, i_key, i_vec), "lsh-items")
    exact = lambda some: cosine_knn(some, "id", "v", i, "id", "v", k, exclude_self, min_similarity)
    if hashing is None:
        some = q.orderBy(F.xxhash64("id"), "id").limit(sample_queries)
        met = exact(some).select("q_id", "i_id")
        pairs = (met.join(some.select(F.col("id").alias("q_id"), F.col("v").alias("a")), "q_id")
                 .join(i.select(F.col("id").alias("i_id"), F.col("v").alias("b")), "i_id").select("a", "b").collect())
        by_dims: dict[int, list] = {}
        for p in pairs:
            by_dims.setdefault(len(p["a"]), []).append(p)
        # vectors of one length are tuned for; the others are searched with the same setting
        chosen = max(by_dims.values(), key=len, default=[])
        if chosen:
            hashing = tune(*(np.array([p[c] for p in chosen]) for c in ("a", "b")), i.count(), recall, bucket_rows=bucket_rows)
        if hashing is None:
            return exact(q)
    keys = ["dims", "t", "shard"]
    shards = min(1 << hashing.bits, 1 << max(0, math.ceil(math.log2(max(1.0, i.count() / block_rows)))))
    asked, stored = (_hashed(rows, hashing, shards, probe) for rows, probe in ((q, True), (i, False)))
    sizes = [cut_lineage(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")), "lsh-sizes")
             for rows in (asked, stored)]
    left = _dealt(asked, sizes[1], sizes[0], "qb", "ib").groupBy(*keys, "qb", "ib")
    right = _dealt(stored, sizes[0], sizes[1], "ib", "qb").groupBy(*keys, "qb", "ib")
    found = left.cogroup(right).applyInArrow(bucket_scorer(k, exclude_self, min_similarity), OUT_SCHEMA)
    # tables find the same pair; a similarity's last bits depend on its block, so the largest stands
    once = found.groupBy("q_id", "i_id").agg(F.max("similarity").alias("similarity"))
    return top_k(once, "q_id", [F.desc(F.round("similarity", 12)), F.asc("i_id")], k)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (q_id, i_id) pairs that were found."""
    total = exact.count()
    return found.select("q_id", "i_id").join(exact.select("q_id", "i_id"), ["q_id", "i_id"], "left_semi").count() / total if total else 1.0
