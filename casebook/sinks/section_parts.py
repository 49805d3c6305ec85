"""Section files that hold many incidents each, for incidents of any size (K1).

The rows are dealt by range of (incident, section, row number), one file a
range, so small incidents share a file and a large one fills several.  Every
section says whose it is: its mark names the incident, the section and the
section's place, and is repeated, with the header, where a section goes on in
the next file, so that each file can be read alone.  An index says which files
hold an incident; a reader of few incidents opens only theirs.

    path/data/part=N/   the section files
    path/index          (part, incident_id, rows)

A section opened again replaces its earlier rows, in whatever file these are.
The format has no place for a row of blank cells, nor for one whose first cell
starts and ends with ``---``: the first is not read back, the second opens a
section.  A null cell is an empty one.  A cell reads back as it was written,
but for a carriage return, which keeps its place and ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.ordered import range_parts
from ..sources.section_csv import section_rows
from .file_tree import folder_name, mounted_folder, write_files
from .file_tree import folder_name, mounted_folder, write_files
from .file_tree import folder_name, mounted_folder, write_files

SECTION = ["incident_id", "section_order", "section"]
MARK = "incident_id string, section_order int, section string"


def csv_line(cells: Column) -> Column:
    """An array of cells as one CSV row, quoted where it must be."""
    quoted = F.transform(cells, lambda c: F.when(
        c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    line = F.array_join(quoted, ",")
    return F.when(line == "", F.lit('""')).otherwise(line)


def section_headers(sections: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header): the names of a section's cells, in the order in which its
    rows bring them."""
    names = sections.select(*keys, "row_no", F.posexplode(F.map_keys("row")).alias("pos", "name"))
    first = names.groupBy(*keys, "name").agg(F.min(F.struct("row_no", "pos")).alias("at"))
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "name")))["name"].alias("header"))


def section_lines(sections: DataFrame, keys: list[str], name: Column) -> DataFrame:
    """(keys, kind, row_no, value): the lines of every section, its mark and
    header (kind 0) before its rows (kind 1)."""
    headers = section_headers(sections, SECTION)
    heads = sections.select(*keys).distinct().join(headers.select(*[F.col(c).alias(f"_{c}") for c in SECTION], "header"),
                                                   _same(SECTION), "inner")
    mark = csv_line(F.array(F.concat(F.lit("--- "), name, F.lit(" ---"))))
    marks = heads.select(*keys, F.lit(0).alias("kind"), F.lit(None).cast("int").alias("row_no"),
                         F.concat(F.lit("\n"), mark, F.lit("\n"), csv_line(F.col("header"))).alias("value"))
    cells = F.transform("header", lambda h: F.coalesce(F.element_at("row", h), F.lit("")))
    rows = sections.join(heads.select(*[F.col(c).alias(f"_{c}") for c in keys], "header"), _same(keys), "inner")
    return marks.unionByName(rows.select(*keys, F.lit(1).alias("kind"), "row_no", csv_line(cells).alias("value")))


def _same(keys: list[str]) -> Column:
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return same


def section_parts_sink(sections: DataFrame, path: str, files: int | None = None) -> None:
    """Writes (incident_id, section, section_order, row_no, row) to ``files``
    files, or to one for each partition that the shuffle makes."""
    parts = range_parts(sections.withColumn("incident_id", F.col("incident_id").cast("string"))
                        .withColumn("section_order", F.col("section_order").cast("int")),
                        "incident_id", ["section_order", "section", "row_no"], "part", files)
    order = ["part", *SECTION]
    mark = F.to_json(F.struct(*SECTION))
    lines = section_lines(parts, order, mark).repartition("part").sortWithinPartitions(*order, "kind", "row_no")
    lines.select("part", "value").write.mode("overwrite").partitionBy("part").text(f"{path}/data")
    parts.groupBy("part", "incident_id").agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/index")


def section_parts(spark: SparkSession, path: str, incidents: DataFrame | None = None,
                  cell_cap: int | None = K.CELL_CAP) -> DataFrame:
    """(incident_id, section, section_order, part, row_no, row): the rows of the
    last opening of each section; (section_order, part, row_no) is their order.
    With ``incidents`` only the files that hold one of its ids are opened."""
    schema = f"{MARK}, part int, row_no int, row map<string,string>"
    folder = f"{path}/data"
    if incidents is not None:
        index = spark.read.parquet(f"{path}/index").join(incidents.select(F.col("incident_id").cast("string")), "incident_id", "left_semi")
        numbers = [r["part"] for r in index.select("part").distinct().collect()]  # file names, as in a listing
        folder = [f"{path}/data/part={n}" for n in sorted(numbers)]
    if not folder:
        return spark.createDataFrame([], schema)
    rows = section_rows(spark, folder, cell_cap).select(
        F.from_json("section", MARK).alias("s"), F.regexp_extract("path", r"part=(\d+)/", 1).cast("int").alias("part"), "row_no", "row")
    rows = rows.select("s.*", "part", "row_no", "row")
    if incidents is not None:
        rows = rows.join(incidents.select(F.col("incident_id").cast("string")).distinct(), "incident_id", "left_semi")
    last = rows.groupBy(F.col("incident_id").alias("_incident_id"), F.col("section").alias("_section")).agg(
        F.max("section_order").alias("_section_order"))
    return rows.join(last, _same(SECTION)).select(*SECTION, "part", "row_no", "row")


def section_files_sink(sections: DataFrame, path: str) -> None:
    """One file an incident (folder ``incident_id=``) with plain marks, for
    readers that know no others: its lines are sorted and streamed, so a large
    incident is one task's stream but never held whole."""
    named = sections.withColumn("incident_id", F.coalesce(F.col("incident_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    lines = section_lines(named, SECTION, F.col("section"))
    lines = lines.repartition("incident_id").sortWithinPartitions(*SECTION, "kind", "row_no").select("incident_id", "value")
    folder = mounted_folder(sections.sparkSession, path)
    if folder is None:
        lines.write.mode("overwrite").partitionBy("incident_id").text(path)
        return
    write_files(lines, folder, lambda incident: f"{folder_name('incident_id', incident)}/part-00000.txt", overwrite=True)
