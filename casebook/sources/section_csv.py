"""Multi-section CSV files of any size, read in splits.

A file is read as lines, so a large one is many tasks.  What a line means
depends on the lines before it in three ways, each settled by one row a split:

1. *Quotes.*  A split may start inside a quoted cell.  Every split is scanned
   from both states (outside, inside) and gives the state it ends in; composing
   these in the order of a file's splits gives the state each one starts in.
   A file in one split starts outside and is not read for this.  Only the
   splits that start inside come to the driver: two numbers for each
   of them, one split being ``spark.sql.files.maxPartitionBytes`` of input.
2. *Rows across splits.*  The last row of a split that ends inside a cell and
   the first one of the next are pieces of one row and are joined.
3. *Sections.*  Inside a split the section of a row is the last mark before it;
   a row before the split's first mark takes the last one of the splits before.
   Row numbers are positions in the file, from running sums of rows a split.

A section's first row is its header; a section opened again counts from its last
opening.  A mark is a row whose first cell starts and ends with ``---``; one
without a name opens nothing, its rows are dropped.  A cell still open at the
end of a file ends with a line break.  A task holds one split's lines.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as TX
from ..session import cut_lineage

END = "end of split"


def file_text(spark: SparkSession, path: str) -> DataFrame:
    """The files as read; their folders are listed here, once."""
    return spark.read.option("lineSep", "\n").text(path)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, line): every line as bytes, with its split's first byte."""
    return lines_of_text(file_text(spark, path))


def lines_of_text(text: DataFrame) -> DataFrame:
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("value").cast("binary").alias("line"))


def _bytes(spark: SparkSession, name: str, default: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]?)i?b?", str(spark.conf.get(name, default)).strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit if unit not in ("", "b") else " ")


def several_splits(text: DataFrame) -> DataFrame:
    """The lines of the files that are read in several splits; files too small
    for that are not opened."""
    spark = text.sparkSession
    least = min(_bytes(spark, "spark.sql.files.openCostInBytes", "4m"), _bytes(spark, "spark.sql.files.maxPartitionBytes", "128m"))
    return lines_of_text(text.where(F.col("_metadata.file_size") > least)
                         .where(F.col("_metadata.file_block_length") < F.col("_metadata.file_size")))


def csv_rows(lines: Iterator[str], inside: bool) -> Iterator[tuple[list[str] | None, bool]]:
    """(cells, open) of the rows of consecutive lines that start outside or
    inside a quoted cell; None in place of a row that cannot be read; ``open`` if
    the last cell goes on behind the lines."""
    csv.field_size_limit(2**31 - 1)
    ended = False

    def fed() -> Iterator[str]:
        nonlocal ended
        first = '"' if inside else ""
        for line in lines:
            for part in io.StringIO(line, newline="") if "\r" in line else (line,):
                yield first + part
                first = ""
        if first:
            yield first + "\n"  # no line at all: nothing closes the cell
        ended = True
        yield END + "\n"

    rows = csv.reader(fed())
    while not ended:
        try:
            row = next(rows)
        except csv.Error:
            yield None, False
            continue
        if not ended:
            yield row, False
        elif row != [END]:  # the end was read as part of a cell
            yield [*row[:-1], row[-1][:-len(END) - 1]], True


def by_split(batches) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(path, start, lines) of each split of a task; the lines of one have to be
    read before the next is asked for."""
    def items():
        for batch in batches:
            paths, starts, lines = (batch.column(k).to_pylist() for k in range(3))
            yield from zip(paths, starts, lines)

    source = items()
    held = next(source, None)

    def lines_of(path: str, start: int) -> Iterator[str]:
        nonlocal held
        while held is not None and held[0] == path and held[1] == start:
            line = held[2]
            held = next(source, None)
            yield line.decode("utf-8", "replace") + "\n"

    while held is not None:
        path, start = held[:2]
        lines = lines_of(path, start)
        yield path, start, lines
        for _ in lines:
            pass


def starts_inside(lines: DataFrame) -> set[tuple[int, int]]:
    """(hash of the path, start) of the splits that start inside a cell."""

    def scan(batches):
        out = []
        for path, start, of in by_split(batches):
            text = list(of)
            ends = [any(is_open for _, is_open in csv_rows(iter(text), inside)) for inside in (False, True)]
            out.append((path, start, ends[0], ends[1]))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(
            (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], names=["path", "start", "outside", "inside"])

    splits = lines.mapInArrow(scan, "path string, start long, outside boolean, inside boolean")
    files = splits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "outside", "inside"))).alias("splits"))
    # the state before each split, and those that start inside
    empty = F.struct(F.lit(False).alias("now"), F.array().cast("array<bigint>").alias("found"))
    walked = F.aggregate("splits", empty, lambda acc, s: F.struct(
        F.when(acc["now"], s["inside"]).otherwise(s["outside"]).alias("now"),
        F.when(acc["now"], F.concat(acc["found"], F.array(s["start"]))).otherwise(acc["found"]).alias("found")))
    name = F.conv(F.substring(F.md5(F.col("path").cast("binary")), 1, 15), 16, 10).cast("long")
    found = files.select(name.alias("file"), F.explode(walked["found"]).alias("start"))
    return {(r["file"], r["start"]) for r in found.collect()}


def split_rows(lines: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """(path, start, r, cells, joins, open): the rows of each split in order;
    ``joins``: the row goes on from the split before.  A row that cannot be read
    has no cells.  ``several``: the lines of files in several splits, where known."""
    inside = lines.sparkSession.sparkContext.broadcast(starts_inside(lines if several is None else several))

    def scan(batches):
        held: list[tuple] = []
        for path, start, of in by_split(batches):
            within = (int(hashlib.md5(path.encode()).hexdigest()[:15], 16), start) in inside.value
            for r, (cells, is_open) in enumerate(csv_rows(of, within)):
                held.append((path, start, r, cells, within and r == 0, is_open))
                if len(held) >= 1024:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)

    def batch_of(held):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate(kinds)],
                                          names=["path", "start", "r", "cells", "joins", "open"])

    return lines.mapInArrow(scan, "path string, start long, r long, cells array<string>, joins boolean, open boolean")


def whole_rows(rows: DataFrame) -> DataFrame:
    """(path, start, r, cells): rows in pieces are joined at their first piece's
    place.  Pieces are at most two rows a split."""
    order = Window.partitionBy("path").orderBy("start", "r")
    pieces = rows.where("joins or open").withColumn("n", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order))
    lists = pieces.groupBy("path", "n").agg(F.sort_array(F.collect_list(F.struct("start", "r", "cells"))).alias("of"))
    joined = F.aggregate(F.slice("of", 2, F.size("of")), F.col("of")[0]["cells"], lambda acc, p: F.concat(
        F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), p["cells"][0])),
        F.slice(p["cells"], 2, F.size(p["cells"]))))
    pieces = lists.select("path", F.col("of")[0]["start"].alias("start"), F.col("of")[0]["r"].alias("r"), joined.alias("cells"))
    return rows.where("not joins and not open").select("path", "start", "r", "cells").unionByName(pieces)


def marked_rows(rows: DataFrame, strip_marks: bool = False) -> DataFrame:
    """(path, g, cells, name, at): the rows from a file's first mark on that are
    not blank, with their place ``g`` among the file's rows, the section's name
    and the place ``at`` of its mark (a mark stands at its own place)."""
    rows = rows.where(F.col("cells").isNotNull() & (TX.strip_ws(F.array_join("cells", "", "")) != ""))
    head = F.col("cells")[0]
    head = TX.strip_ws(head) if strip_marks else head
    is_mark = head.startswith("---") & head.endswith("---")
    name = TX.strip_ws(F.regexp_replace(head, r"^[- ]+|[- ]+$", ""))
    inside = Window.partitionBy("path", "start").orderBy("r")
    rows = rows.select("path", "start", "r", "cells", F.when(is_mark, name).alias("mark")).withColumn("k", F.row_number().over(inside))
    place = F.when(F.col("mark").isNotNull(), F.struct("k", "mark"))
    rows = rows.withColumn("own", F.last(place, ignorenulls=True).over(inside))
    rows = cut_lineage(rows, "section-rows")
    # one row a split: its number of rows and its last mark
    splits = rows.groupBy("path", "start").agg(F.max("k").alias("n"), F.max(place).alias("last"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = F.when(F.col("last").isNotNull(), F.struct((F.col("offset") + F.col("last.k")).alias("at"), F.col("last.mark").alias("name")))
    splits = splits.withColumn("carried", F.last(last, ignorenulls=True).over(before)).select("path", "start", "offset", "carried")
    placed = rows.join(splits, ["path", "start"]).select("path", (F.col("offset") + F.col("k")).alias("g"), "cells",
                         F.coalesce("own.mark", "carried.name").alias("name"),
                         F.when(F.col("own").isNotNull(), F.col("offset") + F.col("own.k")).otherwise(F.col("carried.at")).alias("at"))
    return placed.where("at is not null")


def _cell_map(cell_cap: int | None) -> Column:
    """Header and cells as a map; cells beyond the header go, of equal headers
    the last counts."""
    n = F.least(F.size("header"), F.size("cells"))
    names, cells = F.slice("header", 1, n), F.slice("cells", 1, n)
    pairs = F.filter(F.arrays_zip(names.alias("name"), cells.alias("cell"), F.sequence(F.lit(1), n).alias("at")),
                     lambda p: F.array_position(F.reverse(names), p["name"]) == n - p["at"] + 1)
    cap = (lambda c: c) if cell_cap is None else (
        lambda c: F.when(F.length(c) > cell_cap, F.concat(F.substring(c, 1, cell_cap), F.lit(K.CELL_CAP_SUFFIX))).otherwise(c))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["name"], cap(p["cell"]))))


def section_rows(spark: SparkSession, path: str, cell_cap: int | None = K.CELL_CAP) -> DataFrame:
    """(path, section, row_no, row, bad_rows): one row per data row of every
    section of every file, with the file's number of unreadable rows."""
    text = file_text(spark, path)
    scanned = cut_lineage(split_rows(lines_of_text(text), several_splits(text)), "section-splits")
    bad = scanned.where("cells is null").groupBy("path").agg(F.count(F.lit(1)).alias("bad"))
    rows = cut_lineage(marked_rows(whole_rows(scanned)).where(F.col("name") != ""), "section-marked")
    # of the last opening only; its first row is the header
    latest = rows.where("g = at").groupBy(F.col("path").alias("path"), F.col("name").alias("name")).agg(F.max("at").alias("at"))
    rows = cut_lineage(rows.where("g > at").join(latest, ["path", "name", "at"]), "section-latest")
    headers = rows.where("g = at + 1").select(F.col("path").alias("path"), F.col("at").alias("at"), F.col("cells").alias("header"))
    data = rows.where("g > at + 1").join(headers, ["path", "at"])
    data = data.join(bad, "path", "left")
    return data.select("path", F.col("name").alias("section"), (F.col("g") - F.col("at") - 2).cast("int").alias("row_no"),
                       _cell_map(cell_cap).alias("row"), F.coalesce("bad", F.lit(0)).cast("int").alias("bad_rows"))


def redacted_files(spark: SparkSession, path: str, section: str = "authored summary") -> DataFrame:
    """F-2 over section files: (path, redacted), one row a file; true if a cell
    of the section (any opening, in any letter case) is the redaction token."""
    text = file_text(spark, path)
    lines = lines_of_text(text)
    rows = marked_rows(whole_rows(cut_lineage(split_rows(lines, several_splits(text)), "section-splits")), strip_marks=True)
    hit = F.exists("cells", lambda c: TX.is_redacted(c)) & (F.lower("name") == section)
    found = rows.where("g > at").where(hit).select("path").distinct().withColumn("hit", F.lit(True))
    return lines.select("path").distinct().join(found, "path", "left").select("path", F.coalesce("hit", F.lit(False)).alias("redacted"))
