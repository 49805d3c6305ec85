"""TF-IDF retrieval without a fit step.

Definitions (the vectorizer defaults being reproduced): lower-case tokens of
two or more word characters, stop words removed, raw term counts, smooth idf
``ln((1+n)/(1+df)) + 1``, L2-normalised rows.

Plan shape
----------
* ``term_counts`` (queries, other operators): explode tokens ->
  ``groupBy(doc, term).count`` -> anti-join the fixed stop list (broadcast, 181
  rows).  Partial aggregation collapses a document's repeated tokens before the
  shuffle.
* The index counts a document's terms inside its row (``_bags``); only rows that
  share a key are brought together.
* Document frequency is a ``groupBy(term)`` with partial aggregation, so a
  term present in a third of all documents costs one row per map partition.
* Weights are made in the document's row as well: tasks hold the idf of the
  ``HEAD_TERMS`` most frequent terms; only entries of rarer ones are joined with
  theirs, which come to the documents in one join by key.
* A search sends the blocks only the entries of the terms that one of its
  queries has (``_shared``).  For a batch that is searched once the index is made of
  these entries alone (``_weighted_for``), as numbers of terms and counts: of a
  document's rare terms only the squared weights, which its norm needs, are joined.
* The index has one row per document, ``(doc, terms, weights, ...)``; queries
  have the same shape.  Both are dealt into blocks by a hash of their key, and
  one co-group per (query block, document block) sums the products of shared
  terms and keeps the block's top ``k`` per query.  So a (query, document)
  pair is a sum inside one task: no pair is ever a row, let alone shuffled,
  and at most ``k`` rows per query leave a block pair.  Shuffle volume is the
  index times the query blocks plus the queries times the document blocks.
* The number of blocks follows the number of entries (``DOC_ENTRIES``,
  ``QUERY_ENTRIES``; where entries are numbers and counts ``NUMBERED_ENTRIES``, with
  a search for each set of so many query entries), so a task's memory does not grow with the data, and the key is a hash of
  unique keys, so no block is hot.
* Queries are one block while they have few entries, so a small batch reads the
  index once; document blocks are at least ``MIN_BLOCKS``.
* The documents' counts and the index are each written once per call as parquet
  tables into the shared checkpoint folder (the index-build step).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import terms as TM
from ..functions.text import strip_ws
from ..session import cut_lineage, packed


DOC_ENTRIES = 1_000_000  # (document, term) entries of a document block
QUERY_ENTRIES = 100_000  # (query, term) entries of a query block
NUMBERED_ENTRIES = 4_000_000  # entries of a block of either kind that holds numbers and counts
MIN_BLOCKS = 4
BLOCK_DOCS = 512  # documents of a block of the pruned index
SEED_BLOCKS = 2  # blocks that set a query's k-th score
HEAD_TERMS = 500_000  # terms whose idf every task of the index build holds
LOOKUP_TERMS = 1000  # a batch of up to so many terms looks them up by a filter


def _stop_table(spark, stopwords=None) -> DataFrame:
    words = K.english_stopwords() if stopwords is None else stopwords
    return spark.createDataFrame([(w,) for w in sorted(set(words))], "term string")


def term_counts(df: DataFrame, key: str, text: str, stopwords=None) -> DataFrame:
    """(key, term, tf) with stop words removed."""
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), TM.NON_WORD)
    toks = df.select(key, F.explode(parts).alias("term")).filter(F.length("term") >= 2)
    counts = toks.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    # stop words removed after counting: fewer rows probe the (fixed, 181-row) broadcast list
    return counts.join(F.broadcast(_stop_table(df.sparkSession, stopwords)), "term", "left_anti")


def top_k(df: DataFrame, part: str, order, k: int, rank: str = "rank") -> DataFrame:
    """``row_number`` per ``part`` in ``order`` and keep the first ``k``."""
    w = Window.partitionBy(part).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def smooth_idf(n: int, df: str) -> Column:
    """``ln((1 + n) / (1 + df)) + 1``."""
    return F.log(F.lit(1.0 + n) / (F.col(df) + 1.0)) + 1.0


def _vectors(entries: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row per ``key`` of a (key, term, value ...) table: ``terms`` and one
    array per value, in the order of the terms."""
    rows = entries.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", *values))).alias("_xs"))
    # a field of an array of structs is the array of that field
    return rows.select(key, F.col("_xs.term").alias("terms"), *[F.col(f"_xs.{v}").alias(v) for v in values])


def _total(values: str, value=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + value(x))


def docs_only_index(docs: DataFrame, doc_key: str, doc_text: str, max_df: float = 0.9, stopwords=None):
    """A7(i) index build: idf over the documents (terms in more than
    ``max_df`` of them dropped), weights L2-normalised per document.
    Returns two staged tables: ``index(doc_key, terms, w, norm)`` and
    ``vocab(term, idf)``.  Built once, probed by any number of query batches."""
    return _build_docs_only(docs, doc_key, doc_text, max_df, stopwords)


def doc_terms(docs: DataFrame, doc_key: str, doc_text: str, stopwords=None) -> DataFrame:
    """The staged (doc, term, tf) table of a document set."""
    return cut_lineage(term_counts(docs, doc_key, doc_text, stopwords), "doc-terms")


def _build_docs_only(docs, doc_key, doc_text, max_df, stopwords):
    bags, counts, _ = counted(docs, doc_key, doc_text, max_df, stopwords)
    return cut_lineage(_weighted(bags, counts).withColumnRenamed("key", doc_key), "tfidf-index"), _vocab(counts)


def counted(docs: DataFrame, doc_key: str, doc_text: str, max_df: float = 0.9, stopwords=None) -> tuple[DataFrame, DataFrame, int]:
    """Staged (key, terms, tf) of the documents and (term, df, idf) of their terms,
    those in more than ``max_df`` of the documents without idf; and the number of
    documents.  For embeddings and searches of the same documents."""
    bags = _bags(docs, doc_key, doc_text, stopwords)
    n_docs = docs.filter(strip_ws(doc_text) != "").count()  # blank documents are no documents (F-9)
    counts = cut_lineage(bags.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")),
                         "tfidf-vocab")
    return bags, counts.withColumn("idf", F.when(F.col("df") <= F.lit(max_df * n_docs), smooth_idf(n_docs, "df"))), n_docs


def _vocab(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("idf").isNotNull()).select("term", "idf")


def _lists(lengths: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def _bags(docs: DataFrame, key: str, text: str, stopwords=None) -> DataFrame:
    """Staged (key, terms, tf): a document's terms in ascending order, stop words
    removed.  They are counted in the document's row; only rows that share a key
    are brought together."""
    stop = pa.array(sorted(set(K.english_stopwords() if stopwords is None else stopwords)), pa.string())
    kind = docs.schema[key].dataType.simpleString()

    def count(batches):
        for batch in batches:
            words = batch.column("words")
            owner = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            found = words.flatten().dictionary_encode()
            terms = found.dictionary
            order = pc.sort_indices(terms).to_numpy()
            place = np.empty(len(terms), np.int64)
            place[order] = np.arange(len(terms))
            terms = terms.take(pa.array(order))
            wanted = pc.and_(pc.greater_equal(pc.utf8_length(terms), 2), pc.invert(pc.is_in(terms, value_set=stop)))
            at = place[found.indices.to_numpy()]
            keep = wanted.to_numpy(zero_copy_only=False)[at]
            pairs, tf = np.unique(owner[keep] * len(terms) + at[keep], return_counts=True)
            lengths = np.bincount(pairs // max(1, len(terms)), minlength=len(words))
            bags = pa.RecordBatch.from_arrays([
                batch.column("key"), _lists(lengths, terms.take(pa.array(pairs % max(1, len(terms))))),
                _lists(lengths, pa.array(tf, pa.int32()))], names=["key", "terms", "tf"])
            yield bags.filter(pa.array(lengths > 0))

    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), TM.NON_WORD)
    bags = packed(docs.select(F.col(key).alias("key"), words.alias("words"))
                  .mapInArrow(count, f"key {kind}, terms array<string>, tf array<int>"), "tfidf-bags")
    twice = cut_lineage(bags.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("_key")),
                        "tfidf-twice")
    if twice.isEmpty():
        return bags
    same = F.col("key").eqNullSafe(F.col("_key"))
    entries = bags.join(twice, same, "left_semi").select("key", F.explode(F.arrays_zip("terms", "tf")).alias("e"))
    entries = entries.groupBy("key", F.col("e.terms").alias("term")).agg(F.sum("e.tf").cast("int").alias("tf"))
    return packed(bags.join(twice, same, "left_anti").unionByName(_vectors(entries, "key", ["tf"])), "tfidf-bags")


def _owners(lists: pa.ListArray) -> np.ndarray:
    """The row of each entry."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _places(terms: pa.Array, known: pa.Table) -> np.ndarray:
    """The place of each entry's term in the head; -1 if it is a rare one."""
    found = terms.dictionary_encode()
    at = pc.fill_null(pc.index_in(found.dictionary, value_set=known["term"]), -1).to_numpy()
    return at[found.indices.to_numpy()]


def _head(counts: DataFrame, *values: str):
    """The (term, value ...) of up to ``HEAD_TERMS`` of the most frequent terms, which
    make up nearly all entries, for the tasks to hold; and the terms up to which
    frequency are left out as the rare ones (none: no term)."""
    cut, held = None, 0
    for df, n in counts.groupBy("df").count().orderBy(F.desc("df")).toLocalIterator():
        if held + n > HEAD_TERMS:
            cut = df
            break
        held += n
    head = counts if cut is None else counts.filter(F.col("df") > cut)
    return counts.sparkSession.sparkContext.broadcast(head.select("term", *values).toArrow().combine_chunks()), cut


def _rare_entries(bags: DataFrame, counts: DataFrame, known, cut: int) -> DataFrame:
    """(key, term, tf) of the entries whose term is not in the head, with the other
    columns of ``counts``."""
    def rare(batches):
        for batch in batches:
            lists = batch.column("terms")
            of, terms = _owners(lists), lists.flatten()
            keep = _places(terms, known.value) < 0
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of[keep])), terms.filter(pa.array(keep)),
                                              batch.column("tf").flatten().filter(pa.array(keep))], names=["key", "term", "tf"])

    kind = bags.schema["key"].dataType.simpleString()
    return bags.mapInArrow(rare, f"key {kind}, term string, tf int").join(counts.filter(F.col("df") <= cut), "term")


def _weighted(bags: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, terms, w, norm) of (key, terms, tf) and (term, df, idf); terms
    without idf are left out, documents without any other, too.

    Tasks hold the idf of the head.  Only where there are more terms are the
    entries of the others joined with theirs, and these brought to the documents."""
    known, cut = _head(counts, "idf")

    def weigh(batches):
        idfs = known.value["idf"].to_numpy().astype(float)  # null: nan
        for batch in batches:
            lists = batch.column("terms")
            terms, owner = lists.flatten(), _owners(lists)
            at = _places(terms, known.value)
            idf = np.append(idfs, np.nan)[at]
            if "rare" in batch.schema.names:
                idf[at < 0] = batch.column("rare").flatten().to_numpy()
            keep = ~np.isnan(idf)
            w = (batch.column("tf").flatten().to_numpy() * idf)[keep]
            lengths = np.bincount(owner[keep], minlength=len(lists))
            norm = np.sqrt(np.bincount(owner[keep], w * w, minlength=len(lists)))
            rows = pa.RecordBatch.from_arrays([batch.column("key"), _lists(lengths, terms.filter(pa.array(keep))),
                                               _lists(lengths, pa.array(w, pa.float64())), pa.array(norm, pa.float64())],
                                              names=["key", "terms", "w", "norm"])
            yield rows.filter(pa.array(lengths > 0))

    kind = bags.schema["key"].dataType.simpleString()
    if cut is not None:
        # a rare idf may be null, too; the lists are in the order of the terms, like the bags
        idfs = (_rare_entries(bags, counts, known, cut).groupBy(F.col("key").alias("_key"))
                .agg(F.sort_array(F.collect_list(F.struct("term", F.coalesce("idf", F.lit(float("nan"))).alias("idf"))))["idf"].alias("rare")))
        bags = bags.join(idfs.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key")
    return bags.mapInArrow(weigh, f"key {kind}, terms array<string>, w array<double>, norm double")


def _asked(counts: DataFrame, queries: DataFrame):
    """The (term, idf) of the terms that one of the queries has, for the tasks to hold."""
    asked = queries.select(F.explode("terms").alias("term")).distinct().join(_vocab(counts), "term")
    return queries.sparkSession.sparkContext.broadcast(asked.toArrow().combine_chunks())


def _weighted_for(bags: DataFrame, counts: DataFrame, asked) -> DataFrame:
    """(key, terms, tf, norm): the documents that a batch of queries reaches, with the
    entries of the asked terms: their numbers among these, and their counts.  The
    norm is that of the whole document.

    A document is weighed in its row; of the entries of rare terms only the
    squared weights are brought to it, so no whole document moves."""
    known, cut = _head(counts, "idf")
    rows, squares, w = _asked_entries(bags, known, asked), F.col("squares"), F.col("tf") * F.col("idf")
    if cut is not None:
        # summed in ascending order: copies have the same norm to the last bit
        rare = (_rare_entries(bags, counts, known, cut).groupBy(F.col("key").alias("_key"))
                .agg(F.sort_array(F.collect_list(w * w)).alias("_xs"))
                .select("_key", _total("_xs").alias("rare")))
        rows = rows.join(rare, F.col("key").eqNullSafe(F.col("_key")), "left")
        squares = squares + F.coalesce("rare", F.lit(0.0))
    return rows.select("key", F.col("at").alias("terms"), "tf", F.sqrt(squares).alias("norm"))


def _numbered(queries: DataFrame, asked) -> DataFrame:
    """The query vectors with the numbers of their terms among the asked."""
    def number(batches):
        for batch in batches:
            lists, tf = batch.column("terms"), batch.column("tf").flatten().cast(pa.int32())
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            at = pc.index_in(lists.flatten(), value_set=asked.value["term"])
            yield pa.RecordBatch.from_arrays([batch.column("key"), _lists(lengths, at), _lists(lengths, tf), batch.column("norm")],
                                             names=["key", "terms", "tf", "norm"])

    key = queries.columns[0]
    kind = queries.schema[key].dataType.simpleString()
    rows = queries.select(F.col(key).alias("key"), "terms", "tf", "norm").mapInArrow(
        number, f"key {kind}, terms array<int>, tf array<int>, norm double")
    return rows.withColumnRenamed("key", key)


def _asked_entries(bags: DataFrame, known, asked) -> DataFrame:
    """(key, at, tf, squares): for each document with an asked term the places of
    these among the asked, their counts, and the sum of the squared weights of its
    entries in the head."""
    def pick(batches):
        idfs = np.append(np.nan_to_num(known.value["idf"].to_numpy().astype(float)), 0.0)
        for batch in batches:
            lists, tf = batch.column("terms"), batch.column("tf").flatten()
            terms, owner = lists.flatten(), _owners(lists)
            w = tf.to_numpy() * idfs[_places(terms, known.value)]
            squares = np.bincount(owner, w * w, minlength=len(lists))
            at = pc.index_in(terms, value_set=asked.value["term"])
            keep = pc.is_valid(at)
            lengths = np.bincount(owner[keep.to_numpy(zero_copy_only=False)], minlength=len(lists))
            rows = pa.RecordBatch.from_arrays([batch.column("key"), _lists(lengths, at.filter(keep)), _lists(lengths, tf.filter(keep)),
                                               pa.array(squares, pa.float64())], names=["key", "at", "tf", "squares"])
            yield rows.filter(pa.array(lengths > 0))

    kind = bags.schema["key"].dataType.simpleString()
    return bags.mapInArrow(pick, f"key {kind}, at array<int>, tf array<int>, squares double")


def _query_vectors(entries: DataFrame, q_key: str) -> DataFrame:
    """Staged query vectors of (query, term, value ..., n): ``norm`` is the length of ``n``."""
    values = [c for c in entries.columns if c not in (q_key, "term")]
    rows = _vectors(entries, q_key, values).withColumn("norm", F.sqrt(_total("n", lambda x: x * x)))
    return cut_lineage(rows.drop("n"), "tfidf-queries")


class Postings:
    """The entries of a block's rows (a list column) by their term."""

    def __init__(self, lists: pa.ChunkedArray):
        entries = pc.list_flatten(lists).combine_chunks().dictionary_encode()
        codes = entries.indices.to_numpy()
        self.words = entries.dictionary
        self.order = np.argsort(codes, kind="stable")
        self.owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[self.order]
        self.starts = np.searchsorted(codes[self.order], np.arange(len(self.words) + 1))

    def hits(self, lists: pa.ChunkedArray):
        """For each row of ``lists`` its (first posting, last, place among all
        entries of ``lists``) of every known term."""
        asked = pc.fill_null(pc.index_in(pc.list_flatten(lists).combine_chunks(), self.words), -1).to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield [(self.starts[c], self.starts[c + 1], lo + j) for j, c in enumerate(asked[lo:hi].tolist()) if c >= 0]


def entries_of(table: pa.Table, column: str) -> np.ndarray:
    return pc.list_flatten(table[column]).combine_chunks().to_numpy(zero_copy_only=False)


def key_order(keys: pa.ChunkedArray) -> np.ndarray:
    """The place of each key in ascending order, nulls first as in Spark."""
    place = np.empty(len(keys), np.int64)
    place[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
    return place


def _blocked(rows: DataFrame, entries: int, least: int = MIN_BLOCKS) -> int:
    """How many blocks the rows are dealt into."""
    n = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    return max(least, math.ceil(n / entries))


def block_scorer(k: int, last_first: bool = False, asked=None):
    """The ``k`` best documents of a block for each query of a block, as tables
    of (key, terms, w, norm | corr, base).  A query costs the postings of its
    terms, not the block's documents.  With ``asked`` (term, idf), broadcast, the
    terms are numbers of its rows and their counts ``tf`` stand for the weights."""

    def weights(rows: pa.Table) -> np.ndarray:
        if asked is None:
            return entries_of(rows, "w")
        return entries_of(rows, "tf") * asked.value["idf"].to_numpy()[entries_of(rows, "terms")]

    def best(qs: pa.Table, ds: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if qs.num_rows and ds.num_rows:
            posted = Postings(ds["terms"])
            place = key_order(ds["key"]) * (-1 if last_first else 1)
            owner, weight = posted.owner, weights(ds)[posted.order]
            weighted = "base" in ds.column_names
            if weighted:
                corr, base = entries_of(ds, "corr")[posted.order], ds["base"].to_numpy()
            else:
                weight /= ds["norm"].to_numpy()[owner]
            q_weight = weights(qs) / np.repeat(qs["norm"].to_numpy(), pc.list_value_length(qs["terms"]).to_numpy())
            for i, hits in enumerate(posted.hits(qs["terms"])):
                if not hits:
                    continue
                of = at = np.concatenate([owner[a:b] for a, b, _ in hits])
                if len(at) * 8 < ds.num_rows:  # few: sorted; else a sum for each document of the block
                    of, at = np.unique(at, return_inverse=True)
                score = np.bincount(at, np.concatenate([weight[a:b] * q_weight[x] for a, b, x in hits]))
                norms = np.bincount(at, np.concatenate([corr[a:b] for a, b, _ in hits])) if weighted else None
                if of is at:
                    of = np.flatnonzero(score)
                    score, norms = score[of], norms[of] if weighted else None
                if weighted:
                    score /= np.sqrt(base[of] + norms)
                of, score = of[score > 0], score[score > 0]
                if len(of) > k:  # all that tie with the k-th stay for the order by key
                    few = score >= np.partition(score, len(of) - k)[len(of) - k] - 2e-12
                    of, score = of[few], score[few]
                level = np.round(score, 12)
                order = np.lexsort((place[of], -level))[:k]
                found.append((i, of[order], score[order]))
        rows = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
        cols = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        return pa.table({"q": qs["key"].take(pa.array(rows)), "d": ds["key"].take(pa.array(cols)),
                         "score": pa.array(np.concatenate([f[2] for f in found]) if found else [], pa.float64())})

    return best


def _shared(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the entries that no query of the (one) block has, the terms
    as numbers: what is sent to the blocks."""
    asked = queries.select(F.explode("terms").alias("term")).distinct().toArrow()["term"].combine_chunks()
    asked = queries.sparkSession.sparkContext.broadcast(asked)

    def pick(batches):
        for batch in batches:
            lists = batch.column("terms")
            owner = _owners(lists)
            at = pc.index_in(lists.flatten(), value_set=asked.value)
            keep = pc.is_valid(at)
            lengths = np.bincount(owner[keep.to_numpy(zero_copy_only=False)], minlength=len(lists))
            cols = [(_lists(lengths, (at if name == "terms" else batch.column(name).flatten()).filter(keep))
                     if name in ("terms", "w", "corr") else batch.column(name)) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names).filter(pa.array(lengths > 0))

    def picked(rows):
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields} | {"terms": "array<int>"}
        return rows.mapInArrow(pick, ", ".join(f"`{n}` {t}" for n, t in kinds.items()))

    return picked(index), picked(queries)


def block_top_k(index: DataFrame, doc_key: str, queries: DataFrame, q_key: str, k: int,
                last_first: bool = False, asked=None) -> DataFrame:
    """The ``k`` best documents of every query: ``(query, doc, score, rank)``.

    ``index(doc_key, terms, w, norm | corr, base)`` and ``queries(q_key,
    terms, w, norm)`` have one row per key.  The score is the sum of products
    over shared terms, over both norms; an index with ``base`` has
    ``sqrt(base + sum of corr over shared terms)`` for its norm.  Only scores
    above 0 count; ties go to the smaller document key (``last_first``: the
    larger).  ``asked``: as in ``block_scorer``, of an index and one block of
    queries in numbers."""
    if asked is None:
        nd, nq = _blocked(index, DOC_ENTRIES), _blocked(queries, QUERY_ENTRIES, 1)
        if nq == 1:
            index, queries = _shared(index, queries)
    else:
        nd, nq = _blocked(index, NUMBERED_ENTRIES), 1
    d_cols = ["terms"] + [c for c in ("w", "tf", "corr", "base", "norm") if c in index.columns]
    q_cols = ["terms", "w" if asked is None else "tf", "norm"]
    d = (index.withColumn("_d", F.pmod(F.xxhash64(doc_key), F.lit(nd)))
         .withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
         .select((F.col("_q") * nd + F.col("_d")).alias("block"), F.col(doc_key).alias("key"), *d_cols))
    q = (queries.withColumn("_q", F.pmod(F.xxhash64(q_key), F.lit(nq)))
         .withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(nd - 1))))
         .select((F.col("_q") * nd + F.col("_d")).alias("block"), F.col(q_key).alias("key"), *q_cols))
    keys = [(n, t.schema["key"].dataType.simpleString()) for n, t in (("q", q), ("d", d))]

    best = block_scorer(k, last_first, asked)
    got = q.groupBy("block").cogroup(d.groupBy("block")).applyInArrow(
        best, ", ".join(f"{n} {t}" for n, t in keys) + ", score double")
    got = got.select(F.col("q").alias(q_key), F.col("d").alias(doc_key), "score")
    tie = F.desc(doc_key) if last_first else F.asc(doc_key)
    return top_k(got, q_key, [F.desc(F.round("score", 12)), tie], k)


def _probes(vocab: DataFrame, queries: DataFrame, q_key: str, q_text: str, stopwords=None) -> DataFrame:
    """Query vectors over the known terms."""
    w = F.col("tf") * F.col("idf")
    q_tf = term_counts(queries, q_key, q_text, stopwords)
    return _query_vectors(q_tf.join(vocab, "term").select(q_key, "term", "tf", w.alias("w"), w.alias("n")), q_key)


def probe_docs_only(index: DataFrame, vocab: DataFrame, doc_key: str, queries: DataFrame, q_key: str, q_text: str,
                    k: int, stopwords=None) -> DataFrame:
    """R4 query side: L2-normalised query weights over the known terms."""
    return block_top_k(index, doc_key, _probes(vocab, queries, q_key, q_text, stopwords), q_key, k)


def fallback_search(docs: DataFrame, doc_key: str, doc_text: str,
                    queries: DataFrame, q_key: str, q_text: str,
                    k: int, max_df: float = 0.9, stopwords=None, terms=None) -> DataFrame:
    """TF-IDF fitted on the documents only; cosine of L2 rows; keep the
    top ``k`` positive scores per query (ties: lower document key first).  For
    one batch; an index that many batches probe is a ``PrunedIndex``.  The queries
    are searched in sets of ``NUMBERED_ENTRIES``; the index of a set holds the
    entries of its terms and the whole documents' norms.  ``terms``: what
    ``counted`` gives for the documents, where it is at hand."""
    bags, counts, _ = terms or counted(docs, doc_key, doc_text, max_df, stopwords)
    probes = _probes(_vocab(counts), queries, q_key, q_text, stopwords)
    sets = _blocked(probes, NUMBERED_ENTRIES, 1)

    def search(some):
        asked = _asked(counts, some)
        index = cut_lineage(_weighted_for(bags, counts, asked).withColumnRenamed("key", doc_key), "tfidf-index")
        return block_top_k(index, doc_key, _numbered(some, asked), q_key, k, asked=asked)

    return reduce(DataFrame.unionByName, [search(probes.filter(F.pmod(F.xxhash64(q_key), F.lit(sets)) == n)) for n in range(sets)])


# ---------------------------------------------------------------------------
# Pruned index: blocks of documents with the largest weight of each term
# ---------------------------------------------------------------------------
@dataclass
class PrunedIndex:
    """A stored index that any number of query batches probe.

    ``blocks``: (block, key, terms, w, norm), a block in one file.  A
    document's block comes from its heaviest term, so documents about the same
    thing, copies first of all, stand together; a block of more than twice
    ``BLOCK_DOCS`` is split by the hash of the key.  ``maxima``: (term, block,
    top), each file in the order of the terms, the largest normalised weight of a term in a
    block.  ``vocab``: (term, idf)."""

    blocks: DataFrame
    maxima: DataFrame
    vocab: DataFrame
    doc_key: str

    @staticmethod
    def build(docs: DataFrame, doc_key: str, doc_text: str, max_df: float = 0.9, stopwords=None,
              block_docs: int = BLOCK_DOCS) -> PrunedIndex:
        """A7(i) as ``docs_only_index``, stored in blocks."""
        return PrunedIndex.of(*docs_only_index(docs, doc_key, doc_text, max_df, stopwords), doc_key, block_docs)

    @staticmethod
    def of(index: DataFrame, vocab: DataFrame, doc_key: str, block_docs: int = BLOCK_DOCS) -> PrunedIndex:
        heaviest = F.element_at("terms", F.array_position("w", F.array_max("w")).cast("int"))
        n = max(1, math.ceil(index.count() / block_docs))
        rows = index.select(F.col(doc_key).alias("key"), "terms", "w", "norm", F.pmod(F.xxhash64(heaviest), F.lit(n)).alias("_b"))
        sizes = rows.groupBy("_b").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / (2 * block_docs))).cast("long").alias("_n"))
        block = F.col("_b") * F.lit(1 << 24) + F.pmod(F.xxhash64("key"), F.col("_n"))
        # one row of sizes for about ``block_docs`` documents, so these stay where they are
        rows = rows.join(F.broadcast(sizes), "_b").select(block.alias("block"), "key", "terms", "w", "norm")
        blocks = cut_lineage(rows.repartition("block").sortWithinPartitions("block"), "tfidf-blocks")
        entries = blocks.select("block", "norm", F.explode(F.arrays_zip("terms", "w")).alias("e"))
        tops = entries.groupBy(F.col("e.terms").alias("term"), "block").agg(F.max(F.col("e.w") / F.col("norm")).alias("top"))
        maxima = cut_lineage(tops.sortWithinPartitions("term"), "tfidf-maxima")
        return PrunedIndex(blocks, maxima, vocab, doc_key)

    def probe(self, queries: DataFrame, q_key: str, q_text: str, k: int, stopwords=None) -> DataFrame:
        """R4 query side: ``(query, doc, score, rank)``, the same rows as
        ``probe_docs_only``."""
        return self.top_k(_probes(self.vocab, queries, q_key, q_text, stopwords), q_key, k)

    def top_k(self, queries: DataFrame, q_key: str, k: int) -> DataFrame:
        """The ``k`` best documents of each query vector (q_key, terms, w, norm).

        1. Over the block maxima of its terms a query's score in a block has an
           upper bound; blocks without one of its terms have no row.
        2. The ``SEED_BLOCKS`` blocks of the largest bounds are scored, and the
           k-th score is what a document has to reach.
        3. Of the others the blocks are scored whose bound reaches it."""
        q = queries.select(F.col(q_key).alias("q"), "terms", "w", "norm")
        bounds = cut_lineage(self.bounds(q), "tfidf-bounds")
        order = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
        seeds = cut_lineage(bounds.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= SEED_BLOCKS)
                            .select("q", "block"), "tfidf-seeds")
        first = cut_lineage(self.scored(q, seeds, k), "tfidf-first")
        kth = (top_k(first, "q", [F.desc(F.round("score", 12)), F.asc("d")], k).groupBy("q")
               .agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("kth")).filter(F.col("held") == k))
        rest = self.reaching(bounds.join(seeds, ["q", "block"], "left_anti"), kth)
        got = first.unionByName(self.scored(q, rest, k))
        got = got.select(F.col("q").alias(q_key), F.col("d").alias(self.doc_key), "score")
        return top_k(got, q_key, [F.desc(F.round("score", 12)), F.asc(self.doc_key)], k)

    def bounds(self, q: DataFrame) -> DataFrame:
        """(q, block, bound) of the blocks that hold one of the query's terms.
        A small batch's terms are a filter that the stored order lets skip."""
        asked = q.select("q", "norm", F.explode(F.arrays_zip("terms", "w")).alias("e")).select(
            "q", F.col("e.terms").alias("term"), (F.col("e.w") / F.col("norm")).alias("qw"))
        terms = [r[0] for r in asked.select("term").distinct().limit(LOOKUP_TERMS + 1).collect()]
        maxima = self.maxima if len(terms) > LOOKUP_TERMS else self.maxima.filter(F.col("term").isin(terms))
        return asked.join(maxima, "term").groupBy("q", "block").agg(F.sum(F.col("qw") * F.col("top")).alias("bound"))

    @staticmethod
    def reaching(bounds: DataFrame, kth: DataFrame) -> DataFrame:
        """The (q, block) whose bound reaches the query's k-th score; a little
        slack for the rounding of sums keeps all ties."""
        return bounds.join(kth, "q", "left").filter(F.col("bound") >= F.coalesce("kth", F.lit(0.0)) - 1e-9).select("q", "block")

    def scored(self, q: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """(q, d, score): up to ``k`` rows of each (q, block) pair.  Queries of a
        block are dealt into sets, so a block that all queries want is several
        groups."""
        sets = _blocked(q, QUERY_ENTRIES, 1)
        pairs = cut_lineage(pairs.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(sets))), "tfidf-pairs")
        wanted = pairs.select(F.col("block").alias("block"), F.col("part").alias("part")).distinct()
        blocks = self.blocks
        if sets == 1:
            blocks, q = _shared(blocks, q)
        left = pairs.join(q, "q").select("block", "part", F.col("q").alias("key"), "terms", "w", "norm")
        right = blocks.join(F.broadcast(wanted) if sets == 1 else wanted, "block").select("block", "part", "key", "terms", "w", "norm")
        kinds = [f"{n} {t.schema['key'].dataType.simpleString()}" for n, t in (("q", left), ("d", right))]
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
            block_scorer(k), ", ".join(kinds) + ", score double")


def query_fit_search(docs: DataFrame, doc_key: str, doc_text: str,
                     queries: DataFrame, q_key: str, q_text: str,
                     k: int = 5, max_features: int = 1000, stopwords=None) -> DataFrame:
    """TF-IDF fitted on the documents plus the query (n = N + 1, and the
    query adds one to the document frequency of its own terms), vocabulary
    = the ``max_features`` most frequent corpus terms (ties alphabetical),
    cosine; top ``k`` per query with score > 0, ties higher document key
    first; ``relevance_score`` = 10 x score.

    Exact per query without refitting: for terms outside the query the idf
    is query-independent, so ``|d|^2(q) = base(d) + sum_{t in d∩q} tf^2 (idf1^2 - idf0^2)``.
    The staged index holds ``(doc, terms, w, corr, base)`` over the vocabulary.
    """
    index, vocab = _build_query_fit(docs, doc_key, doc_text, max_features, stopwords)
    q_tf = term_counts(queries, q_key, q_text, stopwords).join(F.broadcast(vocab), "term")
    qv = _query_vectors(q_tf.select(q_key, "term", F.col("tf").cast("double").alias("w"),
                                    (F.col("tf") * F.col("idf1")).alias("n")), q_key)
    ranked = block_top_k(index, doc_key, qv, q_key, k, last_first=True)
    return ranked.withColumn("relevance_score", F.col("score") * 10.0)


def _build_query_fit(docs, doc_key, doc_text, max_features, stopwords):
    doc_tf = doc_terms(docs, doc_key, doc_text, stopwords)
    n = docs.filter(strip_ws(doc_text) != "").count()
    totals = doc_tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    # top-n by count: partial top-n per partition, one merge (bounded: max_features rows)
    vocab = totals.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    vocab = cut_lineage(vocab.select(
        "term",
        (F.log(F.lit(n + 2.0) / (F.col("df") + 1.0)) + 1.0).alias("idf0"),
        (F.log(F.lit(n + 2.0) / (F.col("df") + 2.0)) + 1.0).alias("idf1")), "tfidf-qfit-vocab")
    tf, idf0, idf1 = F.col("tf"), F.col("idf0"), F.col("idf1")
    entries = doc_tf.join(F.broadcast(vocab), "term").select(
        doc_key, "term", (tf * idf1 * idf1).alias("w"), (tf * tf * (idf1 * idf1 - idf0 * idf0)).alias("corr"),
        F.pow(tf * idf0, 2).alias("b"))
    index = _vectors(entries, doc_key, ["w", "corr", "b"]).withColumn("base", _total("b")).drop("b")
    return cut_lineage(index, "tfidf-qfit"), vocab


def pair_cosine(a_tf: DataFrame, b_tf: DataFrame, key: str) -> DataFrame:
    """TF-IDF cosine of two texts fitted on just the pair (n = 2): shared
    terms have idf 1, the others ``1 + ln 1.5``.  Inputs are (key, term, tf)
    for side a and side b; output (key, pair_tfidf).  Only shared terms are
    joined; the unshared mass comes from the per-side totals."""
    u = 1.0 + math.log(1.5)
    sa = a_tf.groupBy(key).agg(F.sum(F.col("tf") * F.col("tf")).alias("sa"))
    sb = b_tf.groupBy(key).agg(F.sum(F.col("tf") * F.col("tf")).alias("sb"))
    shared = (a_tf.alias("a").join(b_tf.alias("b"), [key, "term"])
              .groupBy(key).agg(F.sum(F.col("a.tf") * F.col("b.tf")).alias("dot"),
                                F.sum(F.col("a.tf") * F.col("a.tf")).alias("sha"),
                                F.sum(F.col("b.tf") * F.col("b.tf")).alias("shb")))
    j = sa.join(sb, key, "full").join(shared, key, "left").fillna(0, ["dot", "sha", "shb", "sa", "sb"])
    na = F.sqrt(F.col("sha") + u * u * (F.col("sa") - F.col("sha")))
    nb = F.sqrt(F.col("shb") + u * u * (F.col("sb") - F.col("shb")))
    cos = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(F.col("dot") / (na * nb))
    return j.select(key, cos.alias("pair_tfidf"))
