"""Benchmark decontamination: BM25 over test items with block-max bounds.

*Index.*  The test items are the indexed documents of a BM25 index; words that
occur in a passage are the query.  Inverse document frequencies and the mean
length come from all items (a Spark aggregate).  Items are grouped by length
class (16, 32, 64, ... words) and by their threshold into blocks of ``BLOCK``
items; for every word and block the index holds the block's largest impact.

*Passages.*  Texts are cut into cells of 5/4 of a class's length; a passage is
two neighbouring cells, so whatever lies in as many words as a cell has is
inside one passage.  Every passage of every text is a query for every class.

*Threshold.*  An item counts as leaked if a passage holds ``OVERLAP`` of its
5-word shingles.  The words that such a passage may lack are at most as many as
shingles may be lacking, so the item's own score less its that many largest
impacts is a lower bound for the passage's score.  That bound is the item's
threshold: retrieving all items above it loses none.

*Search.*  A passage's bound for a block is the sum of its words' block
maxima.  Words in more than a quarter of the items are not summed; their
maxima are taken off the threshold instead (the non-essential lists).  Blocks
whose bound stays below their lowest threshold are skipped; the others' items
are scored in full and compared with their own threshold.

*Verification.*  An item above its threshold must have ``OVERLAP`` of its
5-word shingles in the passage, and of both its question (up to the first
question mark or line end, else its first half) and its answer (the rest) at
least ``PART_OVERLAP`` of the words.

Items are taken in shards of ``SHARD_ITEMS`` (by hash of the id), one shard's
index at a time being sent to the tasks, so that its size has a bound however
many items there are.

Cases: items without words match nothing; items of fewer than five words have
one shingle, the whole sequence; null and empty texts have no passage; passages
never cross texts; repeated documents each get their rows, repeated items (same
id) count by each of their texts and give one row; a null item id is an id like
others; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, KeyTable, TextBlock, byte_table, fresh, map_text, text_blocks, word_ranges

SHINGLE = 5
OVERLAP = 0.8
PART_OVERLAP = 0.5
BLOCK = 8
SHARD_ITEMS = 2048
K1, B = 1.2, 0.75
COMMON_SHARE = 0.25
GATHERED = 1 << 22

WORD_BYTES = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def item_words(text: str | None) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    m = re.search(r"\?|\n", text)
    if m and item_words(text[:m.end()]) and item_words(text[m.end():]):
        return item_words(text[:m.end()]), item_words(text[m.end():])
    words = item_words(text)
    return words[:(len(words) + 1) // 2], words[(len(words) + 1) // 2:]


@dataclass
class Item:
    item_id: object
    words: list[int]
    shingles: set[tuple[int, ...]]
    question: set[int]
    answer: set[int]
    impact: dict[int, float]
    threshold: float


class LengthClass:
    """The blocks of the items of up to ``length`` words."""

    def __init__(self, length: int, items: list[Item], n_words: int, common: np.ndarray):
        self.cell = max(1, -(-5 * length // 4))
        self.items = sorted(items, key=lambda x: x.threshold)
        n_blocks = -(-len(items) // BLOCK)
        most = np.zeros((n_words, n_blocks), np.float32)
        for k, item in enumerate(self.items):
            for w, x in item.impact.items():
                most[w, k // BLOCK] = max(most[w, k // BLOCK], np.float32(x) * np.float32(1 + 1e-6))
        lowest = np.array([self.items[k * BLOCK].threshold for k in range(n_blocks)])
        self.needed = (lowest - most[common].sum(0, dtype=np.float64)) * (1 - 1e-5) - 1e-6
        self.used = most.any(1) & ~common  # words that some list of this class sums
        self.row = np.cumsum(self.used) - 1
        self.most = most[self.used]

    def bounds(self, ids: np.ndarray, cells: np.ndarray, n_cells: int) -> np.ndarray:
        """Sums of block maxima per cell; ``cells`` rise along the words."""
        out = np.zeros((n_cells, self.most.shape[1]), np.float32)
        of = np.flatnonzero((ids >= 0) & self.used[ids])
        step = max(1, GATHERED // max(1, self.most.shape[1]))
        for lo in range(0, len(of), step):
            part = of[lo:lo + step]
            cell = cells[part]
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            out[cell[first]] += np.add.reduceat(self.most[self.row[ids[part]]], first, axis=0)
        return out


class Index:
    def __init__(self, rows: list[tuple[object, str]], n_items: int, mean_length: float, item_counts: dict[str, int]):
        texts = [(i, t, w) for i, t in rows if (w := item_words(t))]
        vocabulary = sorted({x for _, _, w in texts for x in w})
        self.table = [w.encode() for w in vocabulary]
        ids = {w: k for k, w in enumerate(vocabulary)}
        df = np.array([item_counts.get(w, 1) for w in vocabulary], np.float64)
        idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
        common = df > max(1.0, COMMON_SHARE * n_items)
        classes: dict[int, list[Item]] = {}
        for item_id, text, words in texts:
            row = [ids[w] for w in words]
            counts: dict[int, int] = {}
            for w in row:
                counts[w] = counts.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(row) / mean_length)
            impact = {w: float(idf[w]) * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
            shingles = {tuple(row[k:k + SHINGLE]) for k in range(max(1, len(row) - SHINGLE + 1))}
            lacking = len(shingles) - math.ceil(OVERLAP * len(shingles) - 1e-9)
            largest = sorted(impact.values(), reverse=True)[:lacking]
            question, answer = question_and_answer(text)
            item = Item(item_id, row, shingles, {ids[w] for w in question}, {ids[w] for w in answer}, impact,
                        sum(impact.values()) - sum(largest) - 1e-9)
            classes.setdefault(max(16, 1 << (len(row) - 1).bit_length()), []).append(item)
        self.classes = [LengthClass(n, x, len(ids), common) for n, x in sorted(classes.items())]


@dataclass
class Leak:
    score: float
    overlap: float
    question_overlap: float
    answer_overlap: float


class Searcher:
    def __init__(self, index: Index):
        self.index, self.table = index, KeyTable(index.table)

    def search(self, block: TextBlock) -> list[dict[object, Leak]]:
        """For each text the leaked items, with the best passage's figures."""
        out: list[dict[object, Leak]] = [{} for _ in range(len(block))]
        data = LOWER[block.data]
        starts, ends, before = word_ranges(data, block.offsets, WORD_BYTES)
        if not len(starts):
            return out
        which, rows = self.table.find(data, starts, ends)
        ids = np.full(len(starts), -1, np.int64)
        ids[which] = rows
        doc = np.repeat(np.arange(len(block)), np.diff(before))
        place = np.arange(len(starts)) - before[doc]
        for group in self.index.classes:
            n_cells = -(-np.diff(before) // group.cell)
            first = np.r_[0, np.cumsum(n_cells)]
            sums = group.bounds(ids, first[doc] + place // group.cell, int(first[-1]))
            pair = sums.copy()  # passage: this cell and the text's next one
            inner = np.ones(len(sums), bool)
            inner[first[1:][n_cells > 0] - 1] = False
            inner = np.flatnonzero(inner)
            pair[inner] += sums[inner + 1]
            cells, blocks = np.nonzero(pair >= group.needed)
            owners = np.searchsorted(first, cells, "right") - 1
            for cell, b, d in zip(cells.tolist(), blocks.tolist(), owners.tolist()):
                lo = int(before[d]) + (cell - int(first[d])) * group.cell
                self._score(ids[lo:min(lo + 2 * group.cell, int(before[d + 1]))], group.items[b * BLOCK:(b + 1) * BLOCK], out[d])
        return out

    @staticmethod
    def _score(passage: np.ndarray, items: list[Item], out: dict[object, Leak]) -> None:
        words = passage.tolist()
        present = set(words)
        shingles: dict[int, set] = {}
        for item in items:
            score = sum(x for w, x in item.impact.items() if w in present)
            if score < item.threshold:
                continue
            n = min(SHINGLE, len(item.words))
            if n not in shingles:
                shingles[n] = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)}
            overlap = len(item.shingles & shingles[n]) / len(item.shingles)
            if overlap < OVERLAP - 1e-9:
                continue
            parts = [len(p & present) / len(p) if p else 1.0 for p in (item.question, item.answer)]
            old = out.get(item.item_id)
            if min(parts) >= PART_OVERLAP and (old is None or (overlap, score) > (old.overlap, old.score)):
                out[item.item_id] = Leak(score, overlap, *parts)


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_items: int = SHARD_ITEMS):
    """The index of each shard, one after the other."""
    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = rows.select("id", "text", F.regexp_extract_all(lowered, F.lit(r"([0-9a-z\x{80}-\x{10ffff}]+)"), 1).alias("words"))
    total = words.where(F.size("words") > 0).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean")).first()
    if not total["n"]:
        return
    shards = -(-total["n"] // shard_items)
    counts = words.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    sharded = words.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    for k in range(shards):
        mine = sharded.where(F.col("shard") == k)
        own = counts if shards == 1 else counts.join(mine.select(F.explode("words").alias("word")).distinct(), "word", "left_semi")
        yield Index([(r["id"], r["text"]) for r in mine.select("id", "text").orderBy("id", "text").collect()],
                    total["n"], total["mean"], {r["word"]: r["df"] for r in own.collect()})


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row for each document row and leaked item: the two ids, the best
    passage's BM25 score, overlap (of 5-word shingles), question_overlap and
    answer_overlap (of words)."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type, item_type = source.schema["doc_id"].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, score double, overlap double, question_overlap double, answer_overlap double"

    def searched(index: Index) -> DataFrame:
        def run(batches):
            searcher = Searcher(index)
            for batch in batches:
                for lo, _, block in text_blocks(batch.column(1)):
                    found = [(lo + k, i, x) for k, got in enumerate(searcher.search(block)) for i, x in got.items()]
                    if found:
                        items_ = pa.array([i for _, i, _ in found], arrow_item)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([k for k, _, _ in found])), items_,
                             *[pa.array([getattr(x, f) for _, _, x in found], pa.float64())
                               for f in ("score", "overlap", "question_overlap", "answer_overlap")]],
                            names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        return source.mapInArrow(run, schema)

    arrow_item = to_arrow_type(items.schema[item_id_col].dataType)
    out = None
    for index in indexes(items, item_id_col, item_text_col, shard_items):
        out = searched(index) if out is None else out.unionAll(searched(index))
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``docs`` without the rows that hold a leaked item."""
    names = docs.columns
    mark = fresh("leak_text", names)
    for index in indexes(items, item_id_col, item_text_col, shard_items):
        def make(index=index):
            searcher = Searcher(index)
            return lambda block: [pa.array([len(x) for x in searcher.search(block)], pa.int64())]

        found = map_text(docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias(mark)), mark, names,
                         [("n_leaks", "bigint")], make)
        docs = found.where(F.col(f"`{found.columns[-1]}`") == 0).select(*[F.col(f"`{c}`") for c in names])
    return docs
