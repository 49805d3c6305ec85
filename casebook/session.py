"""Session helpers: building a session, and the shared checkpoint folder.
Which joins broadcast is left to the planner's size threshold and AQE.

Nothing here runs work; it only configures Spark so the operators in
``casebook.operators`` plan well at any scale (AQE on, skew-join splitting on,
partial top-k below shuffles).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "casebook") -> SparkSession:
    """Session used by tests and the bench.  On a cluster, pass the cluster
    master and a shuffle-partition count sized to the data (~128-256 MB per
    partition)."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CASEBOOK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object-store) folder there and we use it
    as-is.  Where it is unset, a local session gets a scratch folder of its
    own; on a cluster that would be a folder per machine, so it is refused.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="casebook-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame, name: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table under the shared checkpoint folder
    and continue from the written table.

    Used where one expensive intermediate (e.g. the document-term table)
    feeds several branches of a plan: it is computed once, the lineage is
    cut, and a lost executor only costs re-reading files, never recomputing
    the upstream stages.  Parquet keeps the intermediate columnar, so the
    readers get column pruning and predicate pushdown.  ``codec``: the
    compression, where not the session's.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/casebook-{name}-{uuid.uuid4().hex}"
    rows = df.write.mode("overwrite")
    (rows.option("compression", codec) if codec else rows).parquet(path)
    return spark.read.parquet(path)


def packed(df: DataFrame, name: str) -> DataFrame:
    """``cut_lineage`` for a table as large as the input: less disk for some time."""
    return cut_lineage(df, name, "zstd")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
