"""SimHash near-duplicates by anchor points of a covering code.

*Fingerprints.*  Lower-cased words, shingles of ``SHINGLE`` words, XXH64 of
each (seed 42); a bit is set that is set in over half of the hashes.

*Anchors.*  The 64 bits are cut into ``blocks`` parts.  Two fingerprints that
differ in at most ``threshold`` bits differ in at most threshold // blocks bits
of one part.  Each part has a covering code: a Hamming code on its first
2^r - 1 bits and all words on the rest, so every value lies within radius 1 of
exactly one anchor with its own rest, its home.  A fingerprint is sent to all
anchors within radius plus the part's threshold; the home anchor of one of two
linked fingerprints then also has the other.  Per anchor, home fingerprints
are compared with all others there.

*Hot anchors.*  An anchor with more than ``ANCHOR_ROWS`` fingerprints is cut
into tiles (home part x other part), so no task gets an unbounded group.  The
table of hot anchors is broadcast; a code has a fixed number of anchors, which
bounds it (about half a million with three parts).  Exact copies share a
fingerprint and are compared once.

*Links.*  A task gives for its comparisons a forest that connects what the
links connect (at most one edge a fingerprint), not all pairs; components of
these edges are found by star contraction.

Cases: null, empty and white-space texts have fingerprint zero and link like
others; repeated rows stay rows of their own; a row without id takes part, and
``component_id`` is the smallest id reachable, null if there is none; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, fresh, map_text, staged
from .components import connected_components

SHINGLE = 4
THRESHOLD = 4
BLOCKS = 3
ANCHOR_ROWS = 20_000
PAIRS_AT_ONCE = 1 << 20
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    cuts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    ends = np.append(cuts, len(line))[shingle - 1:].tolist() or [len(line)]
    starts = np.append(0, cuts + 1)[:len(ends)].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), HASHES_AT_ONCE):
        part = [digest(line[a:b], 42) for a, b in zip(starts[at:at + HASHES_AT_ONCE], ends[at:at + HASHES_AT_ONCE])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The id and ``fp``, the fingerprint as a signed 64-bit number."""
    def make():
        def work(block: TextBlock) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint(x, shingle) for x in block.raw()], np.uint64).view(np.int64))]
        return work

    return map_text(df, text_col, [id_col], [("fp", "bigint")], make)


class CoveringCode:
    """Anchors of one part of ``width`` bits: the words whose first 2^r - 1
    bits are a Hamming codeword."""

    def __init__(self, width: int, near: int):
        r = width.bit_length() - (0 if (1 << width.bit_length()) - 1 <= width else 1)
        self.bits = (1 << r) - 1
        self.parity = [sum(1 << (j - 1) for j in range(1, self.bits + 1) if j >> k & 1) for k in range(r)]
        reach = 1 + near
        flips: dict[int, list[tuple[int, int]]] = {}
        for n in range(reach + 1):
            for places in combinations(range(1, self.bits + 1), n):
                syndrome = 0
                for j in places:
                    syndrome ^= j
                flips.setdefault(syndrome, []).append((sum(1 << (j - 1) for j in places), n))
        rest = range(self.bits, width)
        self.masks = []  # by syndrome: masks that lead to the anchors within reach, the home first
        for syndrome in range(self.bits + 1):
            masks = [(m | sum(1 << j for j in more), n + k) for m, n in flips.get(syndrome, [])
                     for k in range(reach - n + 1) for more in combinations(rest, k)]
            home = 1 << (syndrome - 1) if syndrome else 0
            masks.sort(key=lambda x: (x[0] != home, x))
            self.masks.append(np.array([m for m, _ in masks], np.uint64))

    def anchors(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, is home) of each value and anchor within reach."""
        syndrome = np.zeros(len(values), np.int64)
        for k, mask in enumerate(self.parity):
            syndrome |= (np.bitwise_count(values & np.uint64(mask)).astype(np.int64) & 1) << k
        rows, anchors, home = [], [], []
        for s in range(self.bits + 1):
            of = np.flatnonzero(syndrome == s)
            if len(of):
                masks = self.masks[s]
                rows.append(np.repeat(of, len(masks)))
                anchors.append((values[of][:, None] ^ masks[None, :]).reshape(-1))
                home.append(np.tile(np.arange(len(masks)) == 0, len(of)))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        return np.concatenate(rows), np.concatenate(anchors), np.concatenate(home)


def _parts(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each part of the 64 bits."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def replicate(prints: DataFrame, threshold: int = THRESHOLD, blocks: int = BLOCKS) -> DataFrame:
    """(anchor, fp, home) of every fingerprint at all anchors within reach."""
    near = threshold // blocks

    def run(batches):
        codes = [(first, width, CoveringCode(width, near)) for first, width in _parts(blocks)]
        for batch in batches:
            every = np.asarray(batch.column(0)).view(np.uint64)
            for lo in range(0, len(every), 4096):
                fp = every[lo:lo + 4096]
                for k, (first, width, code) in enumerate(codes):
                    part = (fp >> np.uint64(first)) & np.uint64((1 << width) - 1)
                    rows, anchors, home = code.anchors(part)
                    anchors = (anchors | np.uint64(k << 40)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(fp[rows].view(np.int64)), pa.array(home)],
                                                     names=["anchor", "fp", "home"])

    return prints.select("fp").mapInArrow(run, "anchor bigint, fp bigint, home boolean")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) that connect what the edges a-b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _links(group: np.ndarray, fp: np.ndarray, role: np.ndarray, threshold: int):
    """Forest edges of the links between rows of one group (a sorted group
    number for each row) of which one has role bit 1 and the other bit 2."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    rows = np.repeat(np.arange(len(first)), size)
    home = np.flatnonzero((role & 1 > 0) & (size[rows] > 1))
    if not len(home):
        return
    many = size[rows[home]]
    total = np.cumsum(many)
    at = 0
    while at < len(home):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        h, n = home[at:to], many[at:to]
        left = np.repeat(h, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows[h]], n)
        linked = (np.bitwise_count(fp[left] ^ fp[right]) <= threshold) & (role[right] & 2 > 0) & (fp[left] != fp[right])
        if linked.any():
            yield forest(fp[left[linked]].view(np.int64), fp[right[linked]].view(np.int64))
        at = to


def links(prints: DataFrame, threshold: int = THRESHOLD, blocks: int = BLOCKS,
          anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(a, b): edges between fingerprints of ``prints`` (distinct, column fp)
    that connect all pairs within ``threshold`` bits, and no others."""
    placed = staged(replicate(prints, threshold, blocks), "anchors")
    hot = placed.groupBy("anchor").count().where(F.col("count") > anchor_rows).select(
        "anchor", F.ceil(F.col("count") / anchor_rows).cast("int").alias("tiles"))
    cut = placed.join(F.broadcast(hot), "anchor", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    lines = F.sequence(F.lit(0), F.col("tiles") - 1)
    cells = F.when(F.col("tiles") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"),
                                                         F.when(F.col("home"), 3).otherwise(2).alias("role")))).otherwise(
        F.concat(F.transform(lines, lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(2).alias("role"))),
                 F.when(F.col("home"), F.transform(lines, lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(1).alias("role"))))
                 .otherwise(F.array().cast("array<struct<i:int,j:int,role:int>>"))))
    dealt = (cut.select("anchor", "fp", F.explode(cells).alias("c")).select("anchor", "fp", "c.i", "c.j", "c.role")
             .repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j"))

    def run(batches):
        held = None
        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            now[1] = now[1].view(np.uint64)
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            same = np.ones(len(held[0]), bool)
            for k in (0, 2, 3):
                same &= held[k] == held[k][-1]
            whole = int(np.argmax(same))
            if whole:
                yield from edges([c[:whole] for c in held])
                held = [c[whole:] for c in held]
        if held is not None:
            yield from edges(held)

    def edges(rows):
        anchor, fp, i, j, role = rows
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])] if len(anchor) else np.zeros(0, bool)
        for a, b in _links(np.cumsum(new), fp, role, threshold):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    threshold: int = THRESHOLD, blocks: int = BLOCKS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hexadecimal digits) and
    ``component_id``, the smallest id reachable over links of at most
    ``threshold`` bits."""
    all_prints = staged(fingerprints(df, id_col, text_col, shingle).toDF("id", "fp"), "fingerprints")
    distinct = staged(all_prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = connected_components(links(distinct, threshold, blocks, anchor_rows))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = rooted.join(least, "root").select("fp", "component_id")
    return all_prints.join(found, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             threshold: int = THRESHOLD, blocks: int = BLOCKS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """``df`` with one document of each component: the one with the smallest
    id (rows that repeat it are one document); in a component without ids, a
    document with the smallest fingerprint."""
    names = df.columns
    groups = near_duplicates(df, id_col, text_col, shingle, threshold, blocks, anchor_rows).toDF("id", "fp", "least")
    no_id = groups.where("least is null").select("fp").distinct()  # in such a component no row has an id
    wanted = staged(groups.where("id = least").select("id", "fp").distinct(), "kept")
    made = fingerprints_beside(df, text_col, shingle)
    fp = made.columns[-1]
    key = fresh("_key", made.columns)
    own = fresh("_id", [*made.columns, key])
    rows = made.select("*", F.lpad(F.lower(F.hex(F.col(f"`{fp}`"))), 16, "0").alias(key), F.col(f"`{id_col}`").alias(own))
    with_id = rows.join(wanted, (rows[key] == wanted["fp"]) & (rows[own] == wanted["id"]), "left_semi")
    roots = _roots_without_id(no_id, threshold, blocks, anchor_rows)
    without = rows.where(F.col(own).isNull()).join(roots, rows[key] == roots["key"], "left_semi")
    return (with_id.dropDuplicates([key, own]).unionAll(without.dropDuplicates([key]))
            .select(*[F.col(f"`{c}`") for c in names]))


def fingerprints_beside(df: DataFrame, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``df``, then the fingerprint."""
    names = df.columns
    mark = fresh("_marked", names)

    def make():
        return lambda block: [pa.array(np.array([fingerprint(x, shingle) for x in block.raw()], np.uint64).view(np.int64))]

    return map_text(df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias(mark)), mark, names, [("fp", "bigint")], make)


def _roots_without_id(keys: DataFrame, threshold: int, blocks: int, anchor_rows: int) -> DataFrame:
    """Of fingerprints (16 digits) that only rows without id have, the smallest
    of each component, as column ``key``."""
    prints = staged(keys.select(F.conv("fp", 16, -10).cast("bigint").alias("fp")), "without-id")
    if prints.isEmpty():
        return keys.select(F.col("fp").alias("key"))
    roots = connected_components(links(prints, threshold, blocks, anchor_rows)).where("node <> root")
    least = prints.join(roots, prints["fp"] == roots["node"], "left_anti")
    return least.select(F.lpad(F.lower(F.hex("fp")), 16, "0").alias("key"))
