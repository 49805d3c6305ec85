"""Micro-batches: incidents in several batches, repeated batches, noise."""

from pyspark.sql import functions as F

from casebook.operators import conversation as C
from casebook.streaming.incremental import DISCUSSION_SCHEMA, conversation_stream, current_conversations

NOISE = {"account": "bot", "prefix": "auto"}


def land(spark, src, name, rows):
    spark.createDataFrame(rows, DISCUSSION_SCHEMA).write.parquet(str(src / name))


def test_incidents_in_several_batches_are_whole(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    landed = [[(1, 5, 1, "a", "late"), (2, 1, 1, "b", "only"), (None, 1, 1, "x", "no id")],
              [(1, 2, 2, "c", "<p>early</p>"), (3, 1, 1, "bot", "auto: noise")],
              [(3, 9, 1, "bot", "auto: noise")],
              [(1, 9, 3, "a", "last"), (None, 2, 1, "y", "nor here"), (4, 1, 1, "d", "new")]]
    for k, rows in enumerate(landed):
        land(spark, src, f"p{k}", rows)
        conversation_stream(spark, str(src / "*"), out, ck, **NOISE).awaitTermination(120)
    got = {r.incident_id: r.conversation_text for r in current_conversations(spark, out).collect()}
    everything = spark.createDataFrame([r for rows in landed for r in rows], DISCUSSION_SCHEMA)
    want = C.conversation_text(C.drop_service_noise(C.normalize_entries(everything), **NOISE))
    assert got == {r.incident_id: r.conversation_text for r in want.collect()}
    assert got[1] == "[2] c: early\n[5] a: late\n[9] a: last" and got[None].count("\n") == 1 and 3 not in got
    assert spark.read.parquet(out).where("incident_id = 2").count() == 1  # touched by one batch only


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    land(spark, src, "p0", [(1, 1, 1, "a", "x")])
    for ck in ("ck1", "ck2"):  # a lost checkpoint: batch 0 runs twice
        conversation_stream(spark, str(src / "*"), out, str(tmp_path / ck)).awaitTermination(120)
    assert [r.conversation_text for r in current_conversations(spark, out).collect()] == ["[1] a: x"]
    assert spark.read.parquet(f"{out}-entries").count() == 1
    assert spark.read.parquet(f"{out}-entries").agg(F.countDistinct("run")).first()[0] == 1
