"""Conversations of discussion rows as they land.

A file stream of discussion rows runs in micro-batches.  Each appends its kept
entries to a store, under its own number, and writes the text of every incident
that it touched, from all entries stored so far; so an incident whose rows come
in several batches has one whole text in the last of them, and
``current_conversations`` gives that one.  The store is dealt into buckets by
incident, and a batch reads the buckets of its own incidents only.

A batch that is run again replaces what it wrote: its entries and its texts,
from the entries of the batches up to it.  Rows without an incident id are one
conversation; a batch of noise alone touches nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversation as C
from ..sinks import writers as W
from ..sources.readers import latest_per_key

DISCUSSION_SCHEMA = "incident_id long, ts long, pos long, author string, content string"
BUCKETS = 64


def conversation_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                        schema: str = DISCUSSION_SCHEMA, trigger_once: bool = True,
                        support_title: str | None = None, store_dir: str | None = None, buckets: int = BUCKETS, **noise):
    """Start a stream: parquet discussion files in ``source_dir`` -> entries in
    ``store_dir`` (beside the sink if not given) -> the texts of the batch's
    incidents under ``sink_dir/batch_id=<n>``."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    store = store_dir or f"{sink_dir.rstrip('/')}-entries"

    def process(batch: DataFrame, batch_id: int) -> None:
        entries = C.drop_service_noise(C.normalize_entries(batch), **noise)
        entries = entries.withColumn("bucket", F.pmod(F.xxhash64("incident_id"), F.lit(buckets)).cast("int"))
        W.append(entries, store, str(batch_id), ("bucket",))
        stored = batch.sparkSession.read.schema(entries.schema.add("run", "long")).parquet(store).where(F.col("run") <= batch_id)
        touched = stored.where(F.col("run") == batch_id).select(
            F.col("bucket").alias("_bucket"), F.col("incident_id").alias("_id")).distinct()
        same = (F.col("bucket") == F.col("_bucket")) & F.col("incident_id").eqNullSafe(F.col("_id"))
        text = C.conversation_text(stored.join(touched, same, "left_semi").drop("run", "bucket"), support_title=support_title)
        text.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def current_conversations(spark: SparkSession, sink_dir: str) -> DataFrame:
    """(incident_id, conversation_text, batch_id): each incident's text of the
    last batch that touched it."""
    return latest_per_key(spark.read.parquet(sink_dir), "incident_id", "batch_id")
