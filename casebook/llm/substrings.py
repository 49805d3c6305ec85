"""Exact substring deduplication: bytes covered by a string of ``MIN_LENGTH``
bytes that also starts elsewhere.

*Segments.*  A window is a start of ``MIN_LENGTH`` bytes inside a text.  Its
key is the least hash of the ``SEED``-byte strings in it, so equal windows have
equal keys.  A run of windows with one key is a segment, stored as (row, start,
number of windows, key, hash of its text); about one in 70 bytes starts one.
Equal windows inside one segment (periodic text) have the key's string at two
places; a segment that has is marked ``inner``.  Keys that occur once, in a
segment without the mark, hold no repeated window and go (count and join by
key, both partially aggregated or split where skewed).

*Groups.*  Segments of one key and text are one, with a weight.  A key with a
single text of weight two or more has only repeated windows.  The texts of the
others, lone marked ones too, are fetched once each, and keys are dealt to
tasks.

*Burrows-Wheeler transform.*  A task joins the segments of whole groups up to
``BLOCK_BYTES``, sorts their suffixes, and expands intervals breadth first: the
interval of a string w is extended backwards by every byte before its rows;
the right end of an extended interval, if it was not known yet, is a place
where the common prefix is as long as w, and the interval is kept for the next
round.  So common prefixes come out by rising length, and the expansion stops
at ``MIN_LENGTH``: places without a value by then lie inside a class of equal
windows, repeated if its weight is two or more.

*Hot keys.*  A passage in a third of all texts gives one key as many segments,
which share a core but not their surroundings.  The windows of a group of more
than ``GROUP_ROWS`` segments get a longer key: the least hash of strings half
way or more between the last length and ``MIN_LENGTH``.  Equal windows still have equal
keys, and fewer others do.  Segments that are alone are done (marked
ones after expansion), groups of one text are repeated as a whole, the others
go on until groups are small or the strings are as long as the windows, where those
of a group are equal.  Nothing is dropped.

Rows are named by 96 bits of hash of id and text (repeated rows are one name
and stay apart in the counts), segments by 128 bits of key and text hash.
Two bit tables of fixed size, ``ROW_BITS``, of the rows that are needed spare
the other texts the shuffle; rows that share a bit merely are shuffled too.

Cases: null and empty texts, and those shorter than ``MIN_LENGTH``, lose
nothing; matches never cross texts; of repeated rows each loses all bytes that
windows cover; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, map_text, staged

MIN_LENGTH = 200
SEED = 64
GROUP_ROWS = 400
BLOCK_BYTES = 256 << 10
ROW_BITS = 26


# ---------------------------------------------------------------------------
# Segments
# ---------------------------------------------------------------------------
def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the ``seed`` bytes from each place."""
    if len(data) < seed:
        return np.zeros(0, np.uint64)
    have = next(k for k in (8, 4, 2, 1) if k <= seed)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    h = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    h = h[:len(data) - have + 1] & np.uint64((1 << 8 * have) - 1)
    while have < seed:
        on = min(have, seed - have)
        h = h[:-on] * np.uint64(0xD6E8FEB86659FD93) + (h[on:] ^ (h[on:] >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        have += on
    return _mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` neighbours from each place."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if have < width else x


def segments(block: TextBlock, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text number, start in it, windows, key) of the block's segments."""
    return marked_segments(block, length, seed)[:4]


def marked_segments(block: TextBlock, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """``segments``, and whether each may hold equal windows: of two that are
    equal, p bytes apart, the first p windows have one that starts with the
    key's string, the last p one that ends with it, at different places."""
    reach = length - seed + 1
    hashes = seed_hashes(block.data, seed)
    size = np.diff(block.offsets)
    if len(hashes) < reach or size.max(initial=0) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    key = sliding_min(hashes, reach)
    step = np.zeros(len(block.data) + 1, np.int8)
    of = np.flatnonzero(size >= length)
    step[block.offsets[of]] += 1
    step[block.offsets[of] + size[of] - length + 1] -= 1
    valid = np.flatnonzero(np.cumsum(step, dtype=np.int8)[:len(key)])
    new = np.r_[True, (valid[1:] != valid[:-1] + 1) | (key[valid[1:]] != key[valid[:-1]])]
    doc_start = np.zeros(len(block.data) + 1, bool)
    doc_start[block.offsets] = True
    new |= doc_start[valid]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(valid)])
    parts = -(-count // reach)  # longer runs are cut, so a segment's windows share a seed's bytes
    start = np.repeat(valid[first], parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * reach
    left = np.repeat(valid[first] + count, parts) - start
    text = np.searchsorted(block.offsets, start, "right") - 1
    n = np.minimum(left, reach)
    opens = np.append(np.flatnonzero(hashes[:len(key)] == key), len(key))
    closes = np.append(-1, np.flatnonzero(hashes[reach - 1:] == key))
    low = opens[np.searchsorted(opens[:-1], start)]
    high = closes[np.searchsorted(closes[1:], start + n)]
    inner = (low < start + n) & (high >= start) & (low < high + reach - 1)
    return text, start - block.offsets[text], n, key[start], inner


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"),
                     F.xxhash64(F.col(f"`{id_col}`"), text).alias("ra"), F.hash(text).alias("rb"))


def all_segments(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(ra, rb, start, n, h, s, inner) of every segment: row name, place,
    windows, key, hash of the segment's text, mark."""
    def run(batches):
        import xxhash

        from .common import text_blocks
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for lo, _, block in text_blocks(batch.column(2)):
                text, start, n, key, inner = marked_segments(block, length, seed)
                if not len(text):
                    continue
                raw, at = block.data.tobytes(), (block.offsets[text] + start)
                s = np.array([digest(raw[a:b]) for a, b in zip(at.tolist(), (at + n + length - 1).tolist())], np.uint64)
                of = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), pa.array(start.astype(np.int32)),
                     pa.array(n.astype(np.int16)), pa.array(key.view(np.int64)), pa.array(s.view(np.int64)), pa.array(inner)],
                    names=["ra", "rb", "start", "n", "h", "s", "inner"])

    return rows.select("ra", "rb", "text").mapInArrow(run, "ra bigint, rb int, start int, n smallint, h bigint, s bigint, inner boolean")


# ---------------------------------------------------------------------------
# Interval expansion on a Burrows-Wheeler transform
# ---------------------------------------------------------------------------
def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes' first ``depth`` symbols at
    least; symbols are below 512."""
    n, have = len(symbols), 7
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(have, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(have):
        key = (key << 9) | padded[k:n + k]
    while True:
        order = np.argsort(key, kind="stable")
        now = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, now[1:] != now[:-1]])
        if have >= depth or int(rank[order[-1]]) == n - 1:
            return order
        behind = np.zeros(n, np.int64)
        behind[:max(0, n - have)] = rank[have:] + 1
        key = rank * (n + 1) + behind
        have *= 2


def equal_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and for each of its rows the number of its class of
    suffixes that agree in their first ``length`` symbols."""
    n = len(symbols)
    suffixes = suffix_array(symbols, length)
    before = symbols[suffixes - 1].astype(np.uint16)  # the transform
    order = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)  # row of the suffix that is one symbol longer
    to[order] = np.arange(n)
    same = before[order[1:]] == before[order[:-1]]
    later, earlier = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    later[order[:-1][same]] = order[1:][same]
    earlier[order[1:][same]] = order[:-1][same]
    known = np.zeros(n + 1, bool)  # common prefix before this row is known, so shorter than length
    known[[0, n]] = True
    left, right = np.array([0]), np.array([n])
    for _ in range(length):
        width = right - left
        rows = np.arange(width.sum()) + np.repeat(left - (np.cumsum(width) - width), width)
        first = np.sort(to[rows[earlier[rows] < np.repeat(left, width)]])
        last = np.sort(to[rows[later[rows] >= np.repeat(right, width)]]) + 1
        new = ~known[last]
        left, right = first[new], last[new]
        known[right] = True
        if not len(left):
            break
    return suffixes, np.cumsum(known[:n])


def repeated_windows(texts: list[bytes], weights: list[int], length: int):
    """(text number, first window, windows): the runs of windows of ``length``
    bytes that occur twice or more, a text counting as often as it weighs."""
    sizes = np.array([len(t) + 1 for t in texts])
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    symbols[ends - 1] = 0
    suffixes, group = equal_prefixes(symbols, length)
    owner = np.repeat(np.arange(len(texts)), sizes)
    window = np.arange(len(symbols)) + length < ends[owner]  # the mark behind a text is in no window
    weight = np.where(window, np.array(weights, np.int64)[owner], 0)[suffixes]
    twice = (np.bincount(group, weights=weight) >= 2)[group]
    hit = np.zeros(len(symbols) + 1, bool)
    hit[suffixes[twice]] = True
    hit[:-1] &= window
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
    return owner[at[first]], at[first] - (ends - sizes)[owner[at[first]]], np.diff(np.r_[first, len(at)])


def expand_groups(parts: DataFrame, length: int) -> DataFrame:
    """(h, s, at, n): the repeated windows of the segments in ``parts`` (k, h,
    s, at, weight, text), found among those with the same k."""
    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) + 1
        if held:
            yield found(held)

    def found(held):
        which, first, n = repeated_windows([r[5] for r in held], [r[4] for r in held], length)
        of = [held[k] for k in which.tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in of], pa.int64()), pa.array([r[2] for r in of], pa.int64()),
             pa.array([r[3] + int(f) for r, f in zip(of, first)], pa.int32()), pa.array(n.astype(np.int32), pa.int32())],
            names=["h", "s", "at", "n"])

    dealt = parts.select("k", "h", "s", "at", "weight", "text").repartition("k").sortWithinPartitions("k")
    return dealt.mapInArrow(run, "h bigint, s bigint, at int, n int")


def refine(parts: DataFrame, length: int, seed: int) -> DataFrame:
    """The parts' windows by keys from strings of ``seed`` bytes."""
    def run(batches):
        for batch in batches:
            h, s, at, weight, texts = (c.to_pylist() for c in batch.columns)
            data = np.frombuffer(b"".join(texts), np.uint8)
            block = TextBlock(data, np.cumsum([0, *map(len, texts)]), np.zeros(len(texts), bool))
            of, start, n, key, inner = marked_segments(block, length, seed)
            take = lambda x: [x[k] for k in of.tolist()]
            cut = [texts[k][a:a + m + length - 1] for k, a, m in zip(of.tolist(), start.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(take(h), pa.int64()), pa.array(take(s), pa.int64()),
                 pa.array((np.array(take(at), np.int64) + start).astype(np.int32)), pa.array(take(weight), pa.int64()),
                 pa.array(cut, pa.binary()), pa.array(inner)], names=["k", "h", "s", "at", "weight", "text", "inner"])

    return parts.select("h", "s", "at", "weight", "text").mapInArrow(
        run, "k bigint, h bigint, s bigint, at int, weight bigint, text binary, inner boolean")


def repeated_segments(parts: DataFrame, length: int, seed: int, group_rows: int) -> DataFrame:
    """(h, s, at, n) of all parts (k, h, s, at, weight, text, inner), whose keys k
    come from strings of ``seed`` bytes."""
    found = []
    while True:
        text = F.xxhash64("text")
        groups = parts.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("total"), F.max("inner").alias("inner"),
                                        ((F.min(text) == F.max(text)) & (F.sum("weight") > 1)).alias("same"))
        groups = groups.where("total > 1 or inner").drop("inner")
        live = parts.join(groups, "k")
        hot = (F.col("rows") > group_rows) & ~F.col("same")
        # one text only, twice or more: all its windows are repeated
        found.append(live.where("same").select("h", "s", "at", (F.length("text") - (length - 1)).alias("n")))
        found.append(expand_groups(live.where((F.col("rows") <= group_rows) & ~F.col("same")), length))
        if groups.where(hot).isEmpty():
            return _union(found)
        if seed == length:  # a part is one window
            return _union([*found, live.where(hot).select("h", "s", "at", F.lit(1).alias("n"))])
        seed = min(length, seed + -(-(length - seed) * 13 // 20))
        parts = staged(refine(live.where(hot), length, seed), f"parts-{seed}")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


# ---------------------------------------------------------------------------
# The operator
# ---------------------------------------------------------------------------
class RowBits:
    """A table of 2^bits flags for the rows of a name table; a row's flag is
    given by its name.  Its size does not depend on the number of rows."""

    def __init__(self, names: DataFrame, bits: int = ROW_BITS):
        self.mask = (1 << bits) - 1
        place = F.col("ra").bitwiseAND(F.lit(self.mask))
        words = (names.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(ra & 63L as int))").alias("flag"))
                 .groupBy("word").agg(F.bit_or("flag").alias("flags")).toArrow())
        self.flags = np.zeros(1 << (bits - 6), np.uint64)
        self.flags[np.asarray(words["word"])] = np.asarray(words["flags"]).view(np.uint64)

    def has(self, names: np.ndarray) -> np.ndarray:
        place = names & self.mask
        return (self.flags[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _needed(rows: DataFrame, names: DataFrame, wanted: bool = True) -> DataFrame:
    """The rows whose flag is set (or not) in the bit table of ``names``."""
    table, k = rows.sparkSession.sparkContext.broadcast(RowBits(names)), rows.columns.index("ra")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(table.value.has(np.asarray(batch.column(k))) == wanted))

    return rows.mapInArrow(run, rows.schema)


def _fetch(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(k, h, s, at, weight, text, inner) of the segments in ``wanted`` (ra, rb,
    start, n, h, s, weight, inner)."""
    lists = staged(wanted.groupBy("ra", "rb").agg(F.collect_list(F.struct("start", "n", "h", "s", "weight", "inner")).alias("of")), "wanted")
    texts = _needed(rows.select("ra", "rb", "text"), lists).dropDuplicates(["ra", "rb"])
    both = texts.join(lists, ["ra", "rb"]).select("text", "of")

    def run(batches):
        for batch in batches:
            for text, of in zip(batch.column(0), batch.column(1)):
                raw = text.as_buffer().to_pybytes() if hasattr(text, "as_buffer") else text.as_py().encode()
                got = of.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["h"] for x in got], pa.int64()), pa.array([x["h"] for x in got], pa.int64()),
                     pa.array([x["s"] for x in got], pa.int64()), pa.array([0] * len(got), pa.int32()),
                     pa.array([x["weight"] for x in got], pa.int64()),
                     pa.array([raw[x["start"]:x["start"] + x["n"] + length - 1] for x in got], pa.binary()),
                     pa.array([x["inner"] for x in got], pa.bool_())],
                    names=["k", "h", "s", "at", "weight", "text", "inner"])

    return both.mapInArrow(run, "k bigint, h bigint, s bigint, at int, weight bigint, text binary, inner boolean")


def repeated_runs(rows: DataFrame, length: int, seed: int, group_rows: int) -> DataFrame:
    """(ra, rb, runs): of each row that has any, the runs of repeated windows
    as array<struct<start, n>>."""
    found = all_segments(rows, length, seed)
    keys = found.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.max("inner").alias("inner")).where("c > 1 or inner").select("h")
    held = staged(found.join(keys, "h"), "segments")
    texts = held.groupBy("h", "s").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("ra", "rb", "start", "n", "inner")).alias("one"))
    texts = staged(texts.select("h", "s", "weight", "one.*"), "texts")
    kinds = texts.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    marked = texts.join(kinds, "h")
    single = marked.where("kinds = 1 and weight > 1").select("h", "s", F.lit(0).cast("int").alias("at"), F.col("n").cast("int"))
    parts = staged(_fetch(rows, marked.where("kinds > 1 or weight = 1").drop("kinds"), length), "parts")
    repeated = staged(single.unionAll(repeated_segments(parts, length, seed, group_rows)), "repeated")
    # One row a segment (at most as many runs as it has windows), so the join
    # gives one row for each of ``held``; rows of one name have equal runs.
    of_segment = repeated.groupBy("h", "s").agg(F.collect_list(F.struct("at", "n")).alias("of"))
    placed = held.select("ra", "rb", "h", "s", "start").join(of_segment, ["h", "s"])
    moved = F.transform("of", lambda x: F.struct((F.col("start") + x["at"]).alias("start"), x["n"].alias("n")))
    return staged(placed.groupBy("ra", "rb").agg(F.flatten(F.collect_set(moved)).alias("runs")), "runs")


def _digest(raw: bytes, runs: list[tuple[int, int]], length: int) -> tuple[int, int, int, str]:
    """Bytes, removed bytes, removed spans, hash of the bytes that are left."""
    if not runs:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    step = np.zeros(len(raw) + 1, np.int64)
    at = np.array(runs, np.int64)
    np.add.at(step, at[:, 0], 1)
    np.add.at(step, at[:, 0] + at[:, 1] + length - 1, -1)
    gone = np.cumsum(step[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()


def substring_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = MIN_LENGTH,
                         seed: int = SEED, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans and kept_sha256."""
    rows = _rows(df, id_col, text_col)
    runs = repeated_runs(rows, length, seed, group_rows)
    names, kinds = ["n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def make():
        return lambda block: [pa.array(c, t) for c, t in zip(zip(*[_digest(x, [], length) for x in block.raw()]), kinds)]

    clean = map_text(_needed(rows, runs, False).select("id", "text"), "text", ["id"],
                     list(zip(names, ("bigint", "bigint", "bigint", "string"))), make)
    cut = _needed(rows, runs).join(runs, ["ra", "rb"], "left").select("id", "text", "runs")

    def run(batches):
        for batch in batches:
            out = []
            for text, of in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                out.append(_digest(raw, [(x["start"], x["n"]) for x in of.as_py() or []], length))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, kinds)]], names=["id", *names])

    done = cut.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return clean.unionAll(done).withColumnRenamed("id", id_col)
