import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casebook.operators import activity as A
from casebook.operators import ordered as OR


@pytest.fixture(scope="module")
def hot(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part
    yield hot_rows(spark)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot_rows(spark):
    # key 0 has two thirds of all rows, most of them at one time; a null key and null times
    rows = [(0 if i % 3 else i, 5 if i % 4 else i * 37 % 1000, i) for i in range(3000)] + [(None, 1, -1), (None, 1, -2), (7, None, -3), (7, None, -4)]
    return spark.createDataFrame(rows, "k long, t long, tb long").selectExpr("*", "'x' AS chunk")


def test_positions_and_spread(spark, hot):
    parts = OR.range_parts(hot, "k", ["t", "tb"])
    assert parts.where("k = 0").select("_part").distinct().count() > 1  # a hot key, most at one time, is several parts
    w = Window.partitionBy("k").orderBy("t", "tb")
    want = {(r["k"], r["tb"], r["p"]) for r in hot.withColumn("p", F.row_number().over(w) - 1).collect()}
    assert {(r["k"], r["tb"], r["_pos"]) for r in OR.positions(hot, "k", ["t", "tb"]).collect()} == want


@pytest.mark.parametrize("direction,plain", [("next", F.lead), ("prev", F.lag)])
def test_neighbours_without_a_bucket(spark, hot, direction, plain):
    d = hot.where("k is not null")
    got = A.neighbour(d, "k", ["t", "tb"], F.col("tb"), None, direction, "nx")
    w = Window.partitionBy("k").orderBy("t", "tb")
    want = {(r["k"], r["tb"]): r["nx"] for r in d.withColumn("nx", plain("tb").over(w)).collect()}
    assert {(r["k"], r["tb"]): r["nx"] for r in got.collect()} == want


def test_chunks_make_the_whole_text(spark):
    rows = [(0 if i % 3 else i, i, f"inc{i}", f"text {i}" if i % 11 else None) for i in range(600)]
    t = spark.createDataFrame(rows, "batch_id long, ordinal long, incident_id string, conversation_text string")
    t = t.fillna("", ["conversation_text"])
    chunks = OR.unified_chunks(t, chunk_rows=16).collect()
    assert max(r["text"].count("=== Incident") for r in chunks) == 16
    by = {}
    for r in sorted(chunks, key=lambda r: (r["batch_id"], r["chunk"])):
        by[r["batch_id"]] = by.get(r["batch_id"], "") + r["text"]
    for b in (0, 3, 597):
        assert by[b] == "\n\n".join(f"=== Incident {i} ===\n{x or ''}" for k, _, i, x in rows if k == b)


def test_plan_chunks_and_refusals(spark):
    rows = [(1, 1, "a", "p", "primary"), (1, 2, "b", "h", "historical"), (1, 3, "c", None, "historical"),
            (2, 1, "d", "x", "primary"), (3, 1, "e", "x", "historical"), (3, 2, "f", "x", "historical"),
            (4, 1, "g", "x", "primary"), (4, 2, "h", "x", "primary")]
    t = spark.createDataFrame(rows, "batch_id long, ordinal long, incident_id string, conversation_text string, role string")
    got = sorted((r["batch_id"], r["chunk"], r["text"]) for r in OR.plan_chunks(t, chunk_rows=2).collect())
    assert got == [(1, 0, "=== PRIMARY INCIDENT a ===\np\n\n=== HISTORICAL REFERENCE INCIDENTS ===\n=== Historical Incident b ===\nh"),
                   (1, 1, "\n\n=== Historical Incident c ===\n")]
    reasons = {r["batch_id"]: r["refused"] for r in OR.plan_batches(t).collect()}
    assert reasons[1] is None and "at least 2" in reasons[2] and "not found" in reasons[3] and "More than one" in reasons[4]
    assert OR.plan_chunks(t.limit(0)).count() == 0
