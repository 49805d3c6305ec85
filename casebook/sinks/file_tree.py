"""Trees of many small files: a log tree, one file an incident.

On a mounted disk Hadoop's file system starts a ``chmod`` process for every
file, checksum file and folder that it makes, which takes longer than the rest of
the write.  There each task writes its files itself: under a hidden name first,
then in place, so a task that is repeated leaves the same files.  In other stores
Spark writes them, a folder ``file=<name>`` each.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers as RD
from ..sources.readers import mounted_folder

NO_NAME = "__HIVE_DEFAULT_PARTITION__"  # Spark's name of a null or empty one
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")  # by Spark in the name of a folder


def folder_name(column: str, value: str | None) -> str:
    """``column=value`` as Spark names a partition's folder."""
    return f"{column}={ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', value) if value else NO_NAME}"


def write_files(rows: DataFrame, folder: str, place=lambda name: name or NO_NAME, end: str = "\n",
                overwrite: bool = False) -> int:
    """Writes (name, piece) to a file below ``folder`` for each name, its pieces
    each followed by ``end``; returns the number of files.  Rows of a name stand
    together in one partition.  ``place``: the path of a name.  A folder
    that is not empty is refused, or emptied with ``overwrite``, as Spark does."""

    def write(batches):
        files, name, out, hidden, made = 0, None, None, "", set()
        path = ""

        def close():
            out.close()
            os.replace(hidden, path)

        for batch in batches:
            for of, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None or of != name:
                    if out is not None:
                        close()
                    name, path = of, f"{folder}/{place(of)}"
                    at, base = os.path.split(path)
                    if at not in made:
                        os.makedirs(at, exist_ok=True)
                        made.add(at)
                    hidden = f"{at}/.{uuid.uuid4().hex}"
                    out = open(hidden, "wb")
                    files += 1
                out.write(((piece or "") + end).encode())
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    if os.path.isdir(folder) and os.listdir(folder):
        if not overwrite:
            raise FileExistsError(folder)
        shutil.rmtree(folder)
    if os.path.isdir(folder) and os.listdir(folder):
        if not overwrite:
            raise FileExistsError(folder)
        shutil.rmtree(folder)
    if os.path.isdir(folder) and os.listdir(folder):
        if not overwrite:
            raise FileExistsError(folder)
        shutil.rmtree(folder)
    os.makedirs(folder, exist_ok=True)
    return rows.mapInArrow(write, "files long").agg(F.sum("files")).first()[0] or 0


def write_tree(files: DataFrame, root: str, mounted: bool = True) -> None:
    """Writes (rel, content), one row a file, as a tree below ``root``; each file
    ends with a line break more, as Spark lists no empty files."""
    folder = mounted_folder(files.sparkSession, root) if mounted else None
    rows = files.select("rel", "content")
    if folder is not None:
        write_files(rows, folder)
        return
    rows.select(F.col("rel").alias("file"), F.col("content").alias("value")).repartition("file") \
        .write.partitionBy("file").option("lineSep", "\n").text(root)


def tree_listing(spark: SparkSession, root: str) -> DataFrame:
    """The listing (path, length, rel) of a tree written by ``write_tree``."""
    files = RD.log_listing(spark, root)
    spark_made = F.regexp_extract("rel", r"^file=([^/]*)/part-[^/]*$", 1)
    return files.withColumn("rel", F.when(spark_made != "", F.replace(spark_made, F.lit("%2F"), F.lit("/"))).otherwise(F.col("rel")))


def tree_contents(spark: SparkSession, chosen: DataFrame) -> DataFrame:
    """The chosen rows of a listing with ``content``; other files are not read."""
    return RD.log_contents(spark, chosen).withColumn("content", F.regexp_replace("content", r"\n\z", ""))
