"""Hard negatives by a GNAT-style tree: multiway hyperplane splits with
distance ranges between every split point and every sibling subtree.

*Space.*  Vectors are integers, floor(256 * x).  With M the largest norm of
all, a stored vector x gets one more component, sqrt(M^2 - |x|^2), and a query
gets 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so a window of inner products
is an annulus of distances around the query.

*Tree.*  A node has up to ``FANOUT`` split points, each as far as possible from
those before it; every row goes to its nearest one.  For split point i and
sibling j the node keeps the smallest and the largest distance from i to the
rows of j.  A query at distance d from i is between max(d - high, low - d) and
d + high from every row of j, for all i; where this interval misses the window's
annulus the sibling is left out.  The inner end of the annulus is the positive's
score, the outer one its lower limit or, once there are enough rows, the worst
row kept.  Leaves are scored in full, in integers; distances only leave out
subtrees, with some slack for rounding.

*Spark.*  The root node comes from a sample of ``SAMPLE_ROWS`` rows and deals
all rows into cells; its ranges are an aggregate over all rows.  A cell is cut
into blocks of about ``BLOCK_ROWS`` by hash, so a cell of equal vectors spreads;
each block's task builds the rest of the tree.  A request (an anchor with its
windows) is sent to the cells that the root does not rule out: for positives
first to its own cell, then, with the worst score found there, to the others.

Cases: rows with a null id, label or vector or with a null or non-finite
component take no part; vectors meet only vectors of their own length (empty
ones score 0); a repeated row (equal id, label and vector) is a row of its own
everywhere: a candidate for its copies, and an anchor as often as it stands
there; ties go to the smaller id; an anchor without positives, or positives
with a negative score, give no rows; an empty table gives an empty result; other
columns are not read.  Products must fit 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, staged

POSITIVES = 5
NEGATIVES = 5
FLOOR_PERCENT = 80
SCALE = 256
FANOUT = 16
LEAF_ROWS = 64
MAX_DEPTH = 40
SAMPLE_ROWS = 2048
BLOCK_ROWS = 1 << 14
REQUEST_ROWS = 1 << 14
CELLS = (8, 256)
CHUNK = 512
LEAST, MOST = -(1 << 62), 1 << 62
SLACK = 1e-6


# ---------------------------------------------------------------------------
# The tree
# ---------------------------------------------------------------------------
def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that brings every norm to sqrt(top)."""
    x = vectors.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0))])


def distances(points: np.ndarray, split: np.ndarray) -> np.ndarray:
    a, b = np.einsum("ij,ij->i", points, points), np.einsum("ij,ij->i", split, split)
    return np.sqrt(np.maximum(a[:, None] + b - 2 * (points @ split.T), 0))


def split_points(points: np.ndarray, most: int, near: float) -> np.ndarray:
    """Up to ``most`` of the points, each the farthest from those before it
    among evenly spaced candidates; none nearer than ``near`` to another."""
    candidates = points[np.unique(np.linspace(0, len(points) - 1, min(len(points), 8 * most)).astype(np.int64))]
    chosen = [0]
    gap = distances(candidates, candidates[:1])[:, 0]
    while len(chosen) < most:
        far = int(gap.argmax())
        if gap[far] <= near:
            break
        chosen.append(far)
        gap = np.minimum(gap, distances(candidates, candidates[far:far + 1])[:, 0])
    return candidates[chosen]


def ranges(dist: np.ndarray, cell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """[split point, cell]: smallest and largest distance to the cell's rows."""
    low, high = np.full((dist.shape[1], n), np.inf), np.full((dist.shape[1], n), -np.inf)
    order = np.argsort(cell, kind="stable")
    held, starts = np.unique(cell[order], return_index=True)
    low[:, held] = np.minimum.reduceat(dist[order], starts, axis=0).T
    high[:, held] = np.maximum.reduceat(dist[order], starts, axis=0).T
    return low, high


def interval(dist: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[query, cell]: bounds of the distance from a query to the cell's rows."""
    least = np.maximum(dist[:, :, None] - high, low - dist[:, :, None]).max(axis=1)
    return np.maximum(least, 0), (dist[:, :, None] + high).min(axis=1)


@dataclass
class Node:
    rows: np.ndarray
    split: np.ndarray | None = None
    held: list[int] | None = None  # the split point of each child
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    labels: np.ndarray | None = None  # [child, (smallest, largest)]
    children: list[Node] = field(default_factory=list)


class Tree:
    """Rows of one block: ids, labels, integer vectors, and names (two hashes
    and a copy number) by which an anchor knows its own row."""

    def __init__(self, ids, labels, vectors, names, top: float, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS):
        self.ids, self.labels, self.names, self.top = ids, labels, names, top
        largest = int(np.abs(vectors).max(initial=0))
        self.largest, self.vectors, self.exact = largest, vectors, vectors.astype(np.float64)
        self.slack = SLACK * (1 + float(np.sqrt(top)))
        self.scored = 0
        points = lifted(vectors, top)
        self.root = Node(np.arange(len(ids)))
        todo = [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            if len(node.rows) <= leaf_rows or depth >= MAX_DEPTH:
                continue
            mine = points[node.rows]
            split = split_points(mine, fanout, self.slack)
            if len(split) < 2:
                continue
            dist = distances(mine, split)
            cell = dist.argmin(axis=1)
            parts = [node.rows[cell == j] for j in range(len(split))]
            held = [j for j, p in enumerate(parts) if len(p)]
            if len(held) < 2:
                continue
            low, high = ranges(dist, cell, len(split))
            node.split, node.held, node.low, node.high = split, held, low[:, held], high[:, held]
            node.children = [Node(parts[j]) for j in held]
            node.labels = np.array([(labels[c.rows].min(), labels[c.rows].max()) for c in node.children])
            todo += [(c, depth + 1) for c in node.children]

    def search(self, queries: Queries, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """(window, id, score) of the k best rows of every window, with the
        query's label or with another one."""
        queries.reset(k)
        if len(queries.owner) and len(self.ids):
            self.seed(self.root, np.arange(len(queries.vectors)), queries, same)
            self.descend(self.root, np.arange(len(queries.owner)), queries, same)
        window, place = np.nonzero(queries.row >= 0)
        return window, queries.id[window, place], queries.score[window, place]

    def to_split(self, node: Node, queries: Queries, which: np.ndarray) -> np.ndarray:
        squares = queries.square[which, None] + self.top - 2 * (queries.vectors[which] @ node.split[:, :-1].T)
        return np.sqrt(np.maximum(squares, 0))

    def seed(self, node: Node, which: np.ndarray, queries: Queries, same: bool) -> None:
        """Each query goes to its nearest leaf, for a first worst score."""
        if not node.children:
            self.leaf(node, np.flatnonzero(np.isin(queries.owner, which)), queries, same)
            return
        nearest = self.to_split(node, queries, which)[:, node.held].argmin(axis=1)
        for j in np.unique(nearest).tolist():
            self.seed(node.children[j], which[nearest == j], queries, same)

    def descend(self, node: Node, alive: np.ndarray, queries: Queries, same: bool) -> None:
        alive = alive[queries.lowest(alive) <= queries.hi[alive]]
        if not node.children:
            self.leaf(node, alive, queries, same)
            return
        which, place = np.unique(queries.owner[alive], return_inverse=True)
        least, most = interval(self.to_split(node, queries, which), node.low, node.high)
        for j in np.argsort(least.mean(axis=0), kind="stable").tolist() if len(which) else ():
            near, far = queries.annulus(alive, self.top)
            label, (a, b) = queries.label[queries.owner[alive]], node.labels[j]
            may = (label >= a) & (label <= b) if same else (label != a) | (label != b)
            stay = may & (least[place, j] <= far + self.slack) & (most[place, j] >= near - self.slack)
            if stay.any():
                self.descend(node.children[j], alive[stay], queries, same)

    def leaf(self, node: Node, alive: np.ndarray, queries: Queries, same: bool) -> None:
        which, place = np.unique(queries.owner[alive], return_inverse=True)
        if not len(which) or not len(node.rows):
            return
        step = max(1, (1 << 22) // max(1, len(alive)))
        small = self.largest * queries.largest * max(1, self.vectors.shape[1]) < 2**53  # exact as doubles
        for at in range(0, len(node.rows), step):
            rows = node.rows[at:at + step]
            self.scored += len(rows) * len(which)
            if small:
                scores = (self.exact[rows] @ queries.vectors[which].T).astype(np.int64)
            else:
                scores = self.vectors[rows] @ queries.whole[which].T
            fits = self.labels[rows][:, None] == queries.label[which]
            fits = fits & ~self.own(rows, queries, which) if same else ~fits
            by_window = scores[:, place]
            fits = fits[:, place] & (by_window >= queries.lowest(alive)) & (by_window <= queries.hi[alive])
            r, w = np.nonzero(fits)
            queries.keep(alive[w], by_window[r, w], self.ids[rows[r]], rows[r])

    def own(self, rows: np.ndarray, queries: Queries, which: np.ndarray) -> np.ndarray:
        a, b, copy = (n[rows][:, None] for n in self.names)
        return (a == queries.names[0][which]) & (b == queries.names[1][which]) & (copy == 0)


class Queries:
    """Anchors and their windows of scores (both ends inclusive), with the best
    rows found so far."""

    def __init__(self, vectors, labels, names, owner, lo, hi):
        self.whole, self.vectors, self.label, self.names = vectors, vectors.astype(np.float64), labels, names
        self.square = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.largest = int(np.abs(vectors).max(initial=0))
        self.owner, self.lo, self.hi = owner, lo, hi

    def reset(self, k: int) -> None:
        self.k = k
        self.score = np.full((len(self.owner), k), LEAST, np.int64)
        self.id, self.row = np.zeros_like(self.score), np.full_like(self.score, -1)

    def lowest(self, windows: np.ndarray) -> np.ndarray:
        """The smallest score that a row still needs."""
        return np.maximum(self.lo[windows], self.score[windows, -1])

    def annulus(self, windows: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
        base = self.square[self.owner[windows]] + top
        ends = (base - 2.0 * s for s in (self.hi[windows], self.lowest(windows)))
        return tuple(np.sqrt(np.maximum(e, 0)) for e in ends)

    def keep(self, window, score, ids, row) -> None:
        """Merge rows into the best of their windows; a row counts once."""
        if not len(window):
            return
        touched = np.unique(window)
        old, place = np.nonzero(self.row[touched] >= 0)
        window = np.concatenate([touched[old], window])
        score = np.concatenate([self.score[touched[old], place], score])
        ids = np.concatenate([self.id[touched[old], place], ids])
        row = np.concatenate([self.row[touched[old], place], row])
        order = np.lexsort((row, ids, -score, window))
        window, score, ids, row = window[order], score[order], ids[order], row[order]
        new = np.ones(len(window), bool)
        new[1:] = (window[1:] != window[:-1]) | (row[1:] != row[:-1])
        window, score, ids, row = window[new], score[new], ids[new], row[new]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        best = rank < self.k
        at = window[best], rank[best]
        self.score[at], self.id[at], self.row[at] = score[best], ids[best], row[best]


# ---------------------------------------------------------------------------
# Cells of the root node
# ---------------------------------------------------------------------------
def matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dims)


def ints(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy(), np.int64)


@dataclass
class Root:
    """The root node: split points and ranges by vector length."""

    top: float
    split: dict[int, np.ndarray]
    low: dict[int, np.ndarray] = field(default_factory=dict)
    high: dict[int, np.ndarray] = field(default_factory=dict)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Each row's cell, and its distances from the split points."""
        split = self.split.get(vectors.shape[1])
        if split is None:
            return np.zeros(len(vectors), np.int64), None
        dist = distances(lifted(vectors, self.top), split)
        return dist.argmin(axis=1), dist

    def reached(self, vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """[query, cell]: cells that one of the query's windows may reach."""
        dims = vectors.shape[1]
        if dims not in self.split:
            return np.ones((len(vectors), 1), bool)
        x = vectors.astype(np.float64)
        base = np.einsum("ij,ij->i", x, x) + self.top
        dist = np.sqrt(np.maximum(base[:, None] - 2 * (x @ self.split[dims][:, :-1].T), 0))
        least, most = interval(dist, self.low[dims], self.high[dims])
        near, far = (np.sqrt(np.maximum(base[owner] - 2.0 * s, 0))[:, None] for s in (hi, lo))
        slack = SLACK * (1 + float(np.sqrt(self.top)))
        met = (least[owner] <= far + slack) & (most[owner] >= near - slack) & np.isfinite(self.low[dims].min(axis=0))
        out = np.zeros((len(vectors), met.shape[1]), bool)
        np.logical_or.at(out, owner, met)
        return out


def by_length(batch: pa.RecordBatch, dims_at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = ints(batch.column(dims_at))
    for d in np.unique(dims).tolist():
        yield d, batch if (dims == d).all() else batch.filter(pa.array(dims == d))


def whole_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v (integers), dims, n (copies), ka and kb (its name)."""
    x = col(vector_col).cast("array<double>")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(col(id_col).cast("bigint").alias("vec_id"), col(label_col).cast("bigint").alias("label"), x.alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(finite)
    rows = rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * SCALE).cast("bigint")).alias("v"))
    rows = rows.groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("n"))
    name = lambda k: F.xxhash64(F.lit(k), "vec_id", "label", "v")
    return rows.select("*", F.size("v").alias("dims"), name(1).alias("ka"), name(2).alias("kb"))


def make_root(rows: DataFrame, n_cells: int) -> Root:
    """Split points from a sample of SAMPLE_ROWS rows, by hash."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    top = rows.agg(F.max(square)).first()[0] or 0.0
    sample = rows.select("v", "dims", "ka", "kb").orderBy("ka", "kb").limit(SAMPLE_ROWS).collect()
    split = {}
    for dims in sorted({r["dims"] for r in sample}):
        vectors = [r["v"] for r in sample if r["dims"] == dims]
        points = lifted(np.array(vectors, np.int64).reshape(len(vectors), dims), top)
        split[dims] = split_points(points, n_cells, SLACK * (1 + float(np.sqrt(top))))
    return Root(top, split)


def deal(rows: DataFrame, root: Root) -> DataFrame:
    """The rows with their cell."""
    v_at, dims_at = rows.columns.index("v"), rows.columns.index("dims")

    def run(batches):
        for batch in batches:
            for dims, part in by_length(batch, dims_at):
                cell, _ = root.nearest(matrix(part.column(v_at), dims))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int64())], names=[*part.schema.names, "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())]))


def with_ranges(root: Root, cells: DataFrame) -> Root:
    """The root with its ranges over all rows: one number for each split point
    and cell of the sampled lengths comes to the driver."""

    def run(batches):
        for batch in batches:
            for dims, part in by_length(batch, 0):
                cell, dist = ints(part.column(1)), root.nearest(matrix(part.column(2), dims))[1]
                if dist is None:
                    continue
                low, high = ranges(dist, cell, dist.shape[1])
                i, j = np.nonzero(np.isfinite(low))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dims), pa.int64()), pa.array(i), pa.array(j),
                                                  pa.array(low[i, j]), pa.array(high[i, j])],
                                                 names=["dims", "i", "j", "low", "high"])

    found = cells.select("dims", "cell", "v").mapInArrow(run, "dims bigint, i bigint, j bigint, low double, high double")
    for dims, split in root.split.items():
        root.low[dims], root.high[dims] = np.full((2, len(split), len(split)), np.inf)
        root.high[dims] *= -1
    for r in found.groupBy("dims", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        root.low[r["dims"]][r["i"], r["j"]], root.high[r["dims"]][r["i"], r["j"]] = r["low"], r["high"]
    return root


# ---------------------------------------------------------------------------
# Requests
# ---------------------------------------------------------------------------
REQUEST = "ka bigint, kb bigint, label bigint, v array<bigint>, dims int, lo array<bigint>, hi array<bigint>"


def windows_of(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, lo and hi of all windows of a table of requests."""
    parts = [table.column(c) for c in ("lo", "hi")]
    parts = [p.combine_chunks() if isinstance(p, pa.ChunkedArray) else p for p in parts]
    owner = np.repeat(np.arange(len(parts[0])), np.asarray(parts[0].value_lengths().to_numpy(zero_copy_only=False), np.int64))
    return owner, ints(parts[0].flatten()), ints(parts[1].flatten())


def route(requests: DataFrame, root: Root, own_cell: bool | None = None) -> DataFrame:
    """The requests with each cell they go to: their own, all but their own, or
    (None) all, as far as their windows reach."""
    spec = T.StructType([*T._parse_datatype_string(REQUEST).fields, T.StructField("cell", T.LongType())])
    requests = requests.select(*spec.names[:-1])

    def run(batches):
        for batch in batches:
            for dims, part in by_length(batch, 4):
                vectors = matrix(part.column(3), dims)
                owner, lo, hi = windows_of(part)
                home = root.nearest(vectors)[0]
                to = root.reached(vectors, lo, hi, owner)
                mine = np.arange(to.shape[1]) == home[:, None]
                which, cell = np.nonzero(mine if own_cell else to & ~mine if own_cell is False else to)
                taken = part.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int64())], names=spec.names)

    return requests.mapInArrow(run, spec)


@dataclass
class Index:
    """Dealt rows, their root node and the sizes of its cells."""

    rows: DataFrame
    cells: DataFrame
    root: Root
    sizes: DataFrame
    sets: int
    fanout: int
    leaf_rows: int

    def search(self, requests: DataFrame, k: int, same: bool, own_cell: bool | None = None) -> DataFrame:
        """ka, kb, w (number of the window), id, score: up to k rows of each
        window and block."""
        top, fanout, leaf_rows = self.root.top, self.fanout, self.leaf_rows
        part = F.pmod(F.xxhash64("kb"), F.lit(self.sets)).cast("int")
        asked = route(requests, self.root, own_cell).join(self.sizes, ["dims", "cell"])
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", part)
        stored = self.cells.join(self.sizes, ["dims", "cell"]).withColumn(
            "block", F.pmod(F.xxhash64("ka", "copy"), "blocks").cast("int")).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.lit(self.sets - 1))))
        schema = "ka bigint, kb bigint, w int, id bigint, score bigint"
        arrow = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("w", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                dims = int(right.column("dims")[0].as_py())
                tree = Tree(*(ints(left.column(c)) for c in ("vec_id", "label")), matrix(left.column("v"), dims),
                            [ints(left.column(c)) for c in ("ka", "kb", "copy")], top, fanout, leaf_rows)
                for at in range(0, right.num_rows, CHUNK):
                    chunk = right.slice(at, CHUNK)
                    ka, kb = ints(chunk.column("ka")), ints(chunk.column("kb"))
                    owner, lo, hi = windows_of(chunk)
                    queries = Queries(matrix(chunk.column("v"), dims), ints(chunk.column("label")), (ka, kb), owner, lo, hi)
                    window, ids, score = tree.search(queries, k, same)
                    first = np.searchsorted(owner, owner[window])
                    out.append(pa.Table.from_arrays([pa.array(ka[owner[window]]), pa.array(kb[owner[window]]),
                                                     pa.array(window - first, pa.int32()), pa.array(ids), pa.array(score)],
                                                    schema=arrow))
            return pa.concat_tables(out) if out else arrow.empty_table()

        keys = ["dims", "cell", "block", "part"]
        left = stored.select(*keys, "vec_id", "label", "v", "ka", "kb", "copy")
        right = asked.select(*keys, "label", "v", "ka", "kb", "lo", "hi")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def build_index(df: DataFrame, id_col: str, vector_col: str, label_col: str, most: int, is_anchor: Callable[[Column], Column],
                block_rows: int, request_rows: int, fanout: int, leaf_rows: int) -> Index:
    rows = staged(whole_rows(df, id_col, vector_col, label_col), "negatives-rows")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor(F.col("vec_id"))).alias("a")).first()
    root = make_root(rows, min(CELLS[1], max(CELLS[0], -(-counts["n"] // block_rows))))
    # Of a row's copies at most ``most`` rank, beside the anchor itself.
    copies = F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(most + 1)).cast("int") - 1))
    cells = staged(deal(rows, root).withColumn("copy", copies), "negatives-cells")
    sizes = cells.groupBy("dims", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    return Index(rows, cells, with_ranges(root, cells), staged(sizes, "negatives-sizes"), max(1, -(-counts["a"] // request_rows)), fanout, leaf_rows)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ka", "kb", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Callable[[Column], Column], id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES,
                   negatives: int = NEGATIVES, floor_percent: int = FLOOR_PERCENT, block_rows: int = BLOCK_ROWS,
                   request_rows: int = REQUEST_ROWS, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """For every anchor (``is_anchor``, a function of the id) and each of its
    first ``positives`` rows of the same label: the first ``negatives`` rows of
    other labels whose score is ``floor_percent`` to 100 percent of the
    positive's.  anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score."""
    index = build_index(df, id_col, vector_col, label_col, max(positives, negatives), is_anchor,
                        block_rows, request_rows, fanout, leaf_rows)
    one = lambda value: F.array(F.lit(value).cast("bigint") if isinstance(value, int) else value)
    anchors = index.rows.where(is_anchor(F.col("vec_id")))
    near = staged(index.search(anchors.withColumns({"lo": one(LEAST), "hi": one(MOST)}), positives, True, own_cell=True),
                  "negatives-near")
    # A cell of several blocks gives k rows a block: the k-th of all is the bound.
    bound = best(near, positives).groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("worst"))
    bounded = anchors.join(bound, ["ka", "kb"], "left").withColumns(
        {"lo": one(F.when(F.col("held") == positives, F.col("worst")).otherwise(F.lit(LEAST))), "hi": one(MOST)})
    others = index.search(bounded, positives, True, own_cell=False)
    chosen = staged(best(near.unionByName(others), positives), "negatives-positives").select(
        "ka", "kb", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    limits = chosen.where(F.col("positive_score") >= 0).groupBy("ka", "kb").agg(
        F.sort_array(F.collect_list(F.struct("nth", "positive_score"))).alias("p"))
    limits = limits.select("ka", "kb", F.expr(f"transform(p, x -> (x.positive_score * {int(floor_percent)} + 99) div 100)").alias("lo"),
                           F.col("p.positive_score").alias("hi"))
    found = best(index.search(anchors.join(limits, ["ka", "kb"]), negatives, False), negatives)
    numbered = chosen.where(F.col("positive_score") >= 0).withColumn("w", F.col("nth") - 1)
    out = found.select("ka", "kb", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(numbered, ["ka", "kb", "w"]).join(anchors.select("ka", "kb", F.col("vec_id").alias("anchor_id"), "n"), ["ka", "kb"])
    out = out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
    coalesce(CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT), 0) AS score
  FROM v a JOIN v c ON c.r <> a.r AND len(c.v) = len(a.v)
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM (
    SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score,
      row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS nth
    FROM pairs WHERE same)
  WHERE nth <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.nth ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.same
    AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
