"""Work along an order inside a key that may hold most of all rows: ranges of
(key, order) instead of a group per key (A4, A5, W6, W7).

The rows are dealt by range over (key, order), so a hot key spreads over as many
parts as its rows fill, whatever its values are; ties in the first order column
are split by the others.  A part's place is its number, and what has to cross
parts (row counts, edges) is one row for each key and part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK_ROWS = 64


def range_parts(df: DataFrame, key: str, order_cols, part: str = "_part", n: int | None = None) -> DataFrame:
    """The rows, written once, with the number of their range of (key, order);
    ``n`` ranges, or as many as the shuffle makes."""
    cols = [F.col(key), *[F.col(c) for c in order_cols]]
    dealt = df.repartitionByRange(*cols) if n is None else df.repartitionByRange(n, *cols)
    return cut_lineage(dealt.withColumn(part, F.spark_partition_id()), "range-parts")


def positions(df: DataFrame, key: str, order_cols, out: str = "_pos") -> DataFrame:
    """The rows with their place, from 0, in the order of their key."""
    parts = range_parts(df, key, order_cols)
    counts = parts.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(key, "_part").orderBy(*[F.col(c) for c in order_cols])
    placed = parts.withColumn("_in", F.row_number().over(inside)).join(
        counts.withColumnRenamed(key, "_key"), (F.col(key).eqNullSafe(F.col("_key"))) & (parts["_part"] == counts["_part"]))
    return placed.withColumn(out, F.col("_before") + F.col("_in") - 1).select(*df.columns, out)


def ordered_chunks(df: DataFrame, key: str, order_cols, line: Callable[[Column], Column],
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, chunk, text): the lines of each key in order, ``chunk_rows`` a row;
    the texts of a key's chunks one after the other are its whole text.  ``line``
    gives a row's text from its place, separator included."""
    rows = positions(df, key, order_cols)
    rows = rows.select(key, F.floor(F.col("_pos") / chunk_rows).cast("int").alias("chunk"),
                       F.struct(F.col("_pos"), line(F.col("_pos")).alias("line")).alias("_l"))
    lists = rows.groupBy(key, "chunk").agg(F.sort_array(F.collect_list("_l")).alias("_xs"))
    return lists.select(key, "chunk", F.array_join(F.col("_xs.line"), "", "").alias("text"))


def unified_chunks(texts: DataFrame, batch: str = "batch_id", ordinal: str = "ordinal", key: str = "incident_id",
                   text: str = "conversation_text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A4 as ordered chunks: the unified content of a batch of any size."""
    block = F.concat(F.lit("=== Incident "), F.col(key).cast("string"), F.lit(" ===\n"), F.col(text))
    line = lambda at: F.concat(F.when(at > 0, F.lit("\n\n")).otherwise(F.lit("")), block)
    return ordered_chunks(texts, batch, [ordinal, key], line, chunk_rows)


def plan_batches(texts: DataFrame, batch: str = "batch_id", role: str = "role") -> DataFrame:
    """F-11: (batch, incidents, primaries, refused): why a batch makes no plan,
    null for one that does."""
    sizes = texts.groupBy(batch).agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.col(role) == "primary").alias("primaries"))
    refused = (F.when(F.col("incidents") < 2, F.lit("Troubleshooting plan mode requires at least 2 incidents"))
               .when(F.col("primaries") == 0, F.lit("Primary incident not found"))
               .when(F.col("primaries") > 1, F.lit("More than one primary incident")))
    return sizes.withColumn("refused", refused)


def plan_chunks(texts: DataFrame, batch: str = "batch_id", ordinal: str = "ordinal", role: str = "role",
                key: str = "incident_id", text: str = "conversation_text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A5 as ordered chunks: the primary incident, then the historical ones, of
    the batches that ``plan_batches`` does not refuse."""
    taken = plan_batches(texts, batch, role).where("refused is null").select(batch)
    rows = texts.join(taken, batch, "left_semi").withColumn("_later", F.when(F.col(role) == "primary", 0).otherwise(1))
    name = F.concat(F.col(key).cast("string"), F.lit(" ===\n"), F.coalesce(F.col(text), F.lit("")))
    line = lambda at: F.when(at == 0, F.concat(F.lit("=== PRIMARY INCIDENT "), name, F.lit("\n\n"))).otherwise(
        F.concat(F.when(at == 1, F.lit("=== HISTORICAL REFERENCE INCIDENTS ===\n")).otherwise(F.lit("\n\n")),
                 F.lit("=== Historical Incident "), name))
    return ordered_chunks(rows, batch, ["_later", ordinal, key], line, chunk_rows)
