"""Shared plumbing: text columns as byte blocks inside ``mapInArrow`` tasks,
staged tables in the cluster's shared folder.

A *block* is a run of rows of one Arrow batch whose text stays under a byte
bound, so a task holds one bounded block at a time however long the texts of
a batch are (a single text longer than the bound is a block of its own).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.session import ensure_checkpoint_dir

BLOCK_BYTES = 2 << 20


@dataclass
class TextBlock:
    """UTF-8 bytes of consecutive texts; text ``i`` is
    ``data[offsets[i]:offsets[i + 1]]``; a null text is empty and marked."""

    data: np.ndarray
    offsets: np.ndarray
    nulls: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self) -> list[bytes]:
        data, at = self.data.tobytes(), self.offsets.tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]

    def texts(self) -> list[str]:
        return [x.decode("utf-8", "replace") for x in self.raw()]


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, TextBlock]]:
    """(first row, past last row, block) over an Arrow text column."""
    nulls = np.asarray(column.is_null())
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1)
        hi = min(hi, n)
        a, b = int(offsets[lo]), int(offsets[hi])
        yield lo, hi, TextBlock(data[a:b], offsets[lo:hi + 1] - a, nulls[lo:hi])
        lo = hi


def fresh(name: str, taken) -> str:
    """``name``, with underscores added until it clashes with no column."""
    while name in taken:
        name += "_"
    return name


def col(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def map_text(df: DataFrame, text_col: str, keep: list[str], fields: list[tuple[str, str]],
             make: Callable[[], Callable[[TextBlock], list[pa.Array]]],
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``keep`` columns of every row, then one column for each of
    ``fields`` (name, Spark type) that the function made by ``make`` (once a
    task) returns for a block.  Other columns are not read; a field whose name
    is kept already gets underscores added (see ``fresh``)."""
    names, spec = [], []
    for name, kind in fields:
        names.append(fresh(name, [*keep, *names]))
        spec.append(T.StructField(names[-1], T._parse_datatype_string(kind)))
    text = fresh("_text", keep)
    source = df.select(*[col(c) for c in keep], col(text_col).cast("string").alias(text))
    schema = T.StructType([*source.schema.fields[:-1], *spec])
    width = len(keep)

    def run(batches):
        work = make()
        for batch in batches:
            for lo, hi, block in text_blocks(batch.column(width), block_bytes):
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(width)]
                yield pa.RecordBatch.from_arrays([*kept, *work(block)], names=[*batch.schema.names[:-1], *names])

    return source.mapInArrow(run, schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder that ``spark.checkpoint.dir``
    names, and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# Words of a block, as byte ranges
# ---------------------------------------------------------------------------
def word_ranges(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs of word bytes inside each
    text, and the number of words that start before each text's offset."""
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, true for the bytes of the inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_KEEP = np.array([(1 << (8 * k)) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], np.uint64)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit key for each byte range, from its length, its first 16 and
    its last 8 bytes; ranges of up to 24 bytes that differ rarely share one."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    size = ends - starts
    a = words[starts] & _KEEP[np.minimum(size, 8)]
    b = words[np.minimum(starts + 8, len(data))] & _KEEP[np.clip(size - 8, 0, 8)]
    c = np.where(size > 16, words[np.maximum(ends - 8, 0)], 0)
    h = (a + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = (h + b) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    h = (h + c + size.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class KeyTable:
    """Row numbers of a fixed set of byte strings, found by key and then
    compared byte by byte, so a shared key never gives a wrong row."""

    def __init__(self, words: list[bytes]):
        self.words = list(dict.fromkeys(words))
        data = np.frombuffer(b"".join(self.words), np.uint8)
        ends = np.cumsum([len(w) for w in self.words]).astype(np.int64)
        starts = ends - np.array([len(w) for w in self.words], np.int64)
        keys = word_keys(data, starts, ends) if self.words else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], order
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two words of the table share a key")
        bits = 16
        self.small = np.zeros(1 << bits, bool)
        self.shift = np.uint64(64 - bits)
        self.small[keys >> self.shift] = True

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which ranges are in the table, the row of each of these)."""
        if not len(self.keys) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = word_keys(data, starts, ends)
        may = np.flatnonzero(self.small[keys >> self.shift])
        at = np.minimum(np.searchsorted(self.keys, keys[may]), len(self.keys) - 1)
        same = self.keys[at] == keys[may]
        which, rows = may[same], self.rows[at[same]]
        long = np.flatnonzero(ends[which] - starts[which] > 16)
        if len(long):
            wrong = [i for i in long.tolist()
                     if data[starts[which[i]]:ends[which[i]]].tobytes() != self.words[rows[i]]]
            which, rows = np.delete(which, wrong), np.delete(rows, wrong)
        return which, rows
