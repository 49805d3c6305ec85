from pyspark.sql import functions as F

from casebook.operators import activity as A
from casebook.operators import conversation as C

NOISE = {"account": "ticket-robot", "prefix": "Automatic ticket enrichment"}


def test_normalize_and_noise(spark):
    rows = [("9", "2024-01-02", "alice", "<p>second</p>", None, None),
            ("9", "2024-01-01", None, None, "bob", "<b>first</b>"),
            ("9", "2024-01-01", "ticket-robot", "Automatic ticket enrichment blah", None, None),
            ("9", "2024-01-03", None, "", None, "")]
    df = spark.createDataFrame(rows, "incident_id string, Date string, ChangedBy string, Text string, "
                                     "author string, content string")
    df = df.withColumn("pos", F.monotonically_increasing_id())
    e = C.normalize_entries(df)
    counts = C.filtered_counts(e, **NOISE).first()
    assert counts.filtered_count == 1 and counts.total_entries == 3
    kept = C.drop_service_noise(e, **NOISE)
    t = C.conversation_text(kept).first().conversation_text
    assert t.split("\n") == ["[2024-01-01] bob: first", "[2024-01-02] alice: second", "[2024-01-03] None: "]


def test_equal_timestamps_keep_input_order_and_buckets(spark):
    rows = [(1, 5, i, f"a{i}", f"m{i}") for i in range(30)] + [(1, t, 100 + t, "b", f"n{t}") for t in range(40)]
    df = spark.createDataFrame(rows, "incident_id long, ts long, pos long, author string, content string")
    plain = C.conversation_text(df).first().conversation_text
    bucketed = C.conversation_text(df, bucket=F.floor(F.col("ts") / 7)).first().conversation_text
    assert plain == bucketed
    lines = plain.split("\n")
    five = [ln for ln in lines if ln.startswith("[5] a")]
    assert five == [f"[5] a{i}: m{i}" for i in range(30)]


def test_summary_prefix_and_batches(spark):
    e = spark.createDataFrame([(1, 1, 1, "u", "hi"), (2, 1, 1, "u", "yo"), (3, 1, 1, "u", "hey")],
                              "incident_id long, ts long, pos long, author string, content string")
    s = spark.createDataFrame([(1, "sum one"), (2, "")], "incident_id long, summary string")
    t = {r.incident_id: r.conversation_text for r in C.conversation_text(e, s).collect()}
    assert t[1] == "--- Authored Summary ---\nsum one\n\n[1] u: hi" and t[2] == "[1] u: yo"
    texts = spark.createDataFrame([(0, 0, 1, "A", "primary"), (0, 1, 2, "B", "historical"), (1, 0, 3, "C", "primary")],
                                  "batch_id long, ordinal long, incident_id long, conversation_text string, role string")
    u = {r.batch_id: r for r in C.unified_content(texts).collect()}
    assert u[0].combined_id == "combined_1_2" and u[0].unified_content == "=== Incident 1 ===\nA\n\n=== Incident 2 ===\nB"
    p = C.plan_content(texts).collect()
    assert len(p) == 1 and p[0].plan_id == "troubleshooting_plan_1_with_2"
    assert p[0].plan_content == ("=== PRIMARY INCIDENT 1 ===\nA\n\n=== HISTORICAL REFERENCE INCIDENTS ===\n"
                                 "=== Historical Incident 2 ===\nB")


def test_two_level_neighbour_equals_window(spark):
    from pyspark.sql import Window

    rows = [(0 if i % 3 else i, i * 37 % 1000, i) for i in range(400)]   # key 0 holds 2/3 of rows
    df = spark.createDataFrame(rows, "k long, t long, tb long")
    two = A.neighbour(df, "k", ["t", "tb"], F.col("t"), F.floor(F.col("t") / 50), "next", "nx")
    w = Window.partitionBy("k").orderBy("t", "tb")
    ref = df.withColumn("nx_ref", F.lead("t").over(w))
    j = two.join(ref, ["k", "t", "tb"])
    assert j.filter(~F.col("nx").eqNullSafe(F.col("nx_ref"))).count() == 0
    prev = A.neighbour(df, "k", ["t", "tb"], F.col("t"), F.floor(F.col("t") / 50), "prev", "pv")
    ref2 = df.withColumn("pv_ref", F.lag("t").over(w))
    assert prev.join(ref2, ["k", "t", "tb"]).filter(~F.col("pv").eqNullSafe(F.col("pv_ref"))).count() == 0


def test_one_pass_equals_two_pass(spark):
    noise = "Automatic ticket enrichment x"
    rows = [(1, t, t, "ticket-robot" if t % 5 == 0 else "u", noise if t % 5 == 0 else f"m{t}") for t in range(300)]
    rows += [(2, 0, 0, "ticket-robot", noise), (3, 1, 0, "a", "only")]
    e = spark.createDataFrame(rows, "incident_id long, ts long, pos long, author string, content string")
    s = spark.createDataFrame([(1, "sum"), (3, "")], "incident_id long, summary string")
    one = {r.incident_id: tuple(r) for r in C.conversation_with_counts(e, s, bucket=F.floor(F.col("ts") / 32), **NOISE).collect()}
    text = C.conversation_text(C.drop_service_noise(e, **NOISE), s)
    two = {r.incident_id: (r.incident_id, r.total_entries, r.filtered_count, r.conversation_text)
           for r in text.join(C.filtered_counts(e, **NOISE), "incident_id").collect()}
    assert one == two and 2 not in one
