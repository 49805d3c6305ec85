import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casebook.llm import chat as C

PROBE = "\\### Assistant: </turn> ok"
TEXT = st.text(alphabet='\\<>/turnlq"\n ab é') | st.just(PROBE) | st.text()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=9), st.integers(2, 5))
def test_round_trip_and_spans(turns, window):
    r, whole, back = C.Renderer(window=window), "", []
    for role, text in turns:
        place, added = r.feed(role, text)
        assert place == len(whole)
        whole += added
        back.append(C.read_turn(added)[:2])
    assert whole == C.marked_template(turns) and len(whole) == r.size
    assert back == turns and not r.rewrites


def test_rewriting_templates_are_detected():
    def last_only(turns, first):  # drops the texts of earlier turns
        return "".join(f"[{r}]" + (t if k == len(turns) - 1 else "") for k, (r, t) in enumerate(turns))

    r = C.Renderer(last_only)
    r.feed("user", "a")
    assert not r.rewrites
    place, added = r.feed("assistant", "b")
    assert r.rewrites and (place, added) == (6, "[assistant]b")

    def numbered(turns, first):
        return "".join(f"{k}:{t}\n" for k, (_, t) in enumerate(turns))

    r = C.Renderer(numbered, window=2)  # depends on turns before the window
    for t in "abc":
        r.feed("user", t)
    assert r.rewrites

    r = C.Renderer(lambda turns, first: "".join(f"{first + k}:{t}\n" for k, (_, t) in enumerate(turns)), window=2)
    assert "".join(r.feed("user", t)[1] for t in "abcd") == "0:a\n1:b\n2:c\n3:d\n" and not r.rewrites


ROWS = [(1, 0, "user", "hi <there>"), (1, 1, "assistant", "a\\b"), (1, 1, "assistant", "a\\b"), (1, 2, None, None),
        (2, 5, "assistant", ""), (3, 1, "user", "x"), (None, 0, "user", "no id")] + [(9, k, "user", "é" * k) for k in range(200)]


def test_digests_equal_sql(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 AS n_turns")
    got = {tuple(r[:6]) for r in C.conversation_digests(C.with_probe(df)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?,?,?,?)", ROWS)
    assert got == {tuple(r[:6]) for r in con.execute(C.ORACLE_SQL).fetchall()}
    probe = next(r for r in got if r[0] == -7)
    assert probe[4] == hashlib.sha256(PROBE.encode()).hexdigest() and probe[3] == len(PROBE)
    assert C.conversation_digests(df.limit(0)).count() == 0


def test_turn_rows(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    rows = C.format_conversations(df).where("conv_id = 9").orderBy("turn_no").collect()
    whole = "".join(r.output for r in rows)
    assert all(whole[r.span_start:r.span_end] == r.output for r in rows)
    assert [C.read_turn(r.output)[1] for r in rows] == ["é" * k for k in range(200)]


def late_template():
    """A template that changes its first turn once there are a hundred."""
    def late(turns, first):
        return "".join(f"{'late' if first + k == 0 and first + len(turns) >= 100 else t}\n" for k, (_, t) in enumerate(turns))
    return late


def test_rewriting_from_before_the_window_is_found():
    for n, found in ((99, False), (100, True), (140, True)):
        r = C.Renderer(late_template())
        for k in range(n):
            r.feed("user", str(k))
        r.check()
        assert r.rewrites is found
    plain = C.Renderer(window=2)
    for k in range(50):
        plain.feed("user", f"<{k}>")
        plain.check()
    assert not plain.rewrites


def test_rewriting_is_on_the_last_row(spark):
    rows = [(c, k, "user", f"{c}.{k}") for c, n in ((1, 300), (2, 99), (3, 100), (4, 1), (5, 513)) for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = C.format_conversations(df, late_template())
    assert got.count() == len(rows)
    last = {r.conv_id: r.f for r in got.groupBy("conv_id").agg(F.max_by("rewrites_history", "turn_no").alias("f")).collect()}
    assert last == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_digests_find_rewriting_from_before_the_window(spark):
    def late(turns, first):
        rows = [(r, "late" if first + k == 0 and first + len(turns) >= 100 else t) for k, (r, t) in enumerate(turns)]
        return C.marked_template(rows, first)

    rows = [(c, k, "user", f"{c}.{k}") for c, n in ((1, 300), (2, 99), (3, 100), (4, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.rewrites_history for r in C.conversation_digests(df, template=late).collect()} == {1: True, 2: False, 3: True, 4: False}
    assert not any(r.rewrites_history for r in C.conversation_digests(df).collect())


def test_other_kinds_of_ids(spark):
    for kind in ("decimal(12,2)", "smallint", "date", "timestamp", "double", "binary"):
        value = "2024-01-01" if kind in ("date", "timestamp") else "12"
        df = spark.sql("SELECT CAST(NULL AS string) AS role, 'x' AS text, 0 AS turn").withColumn("conv_id", F.lit(value).cast(kind))
        assert C.conversation_digests(df).first().n_turns == 1
        assert C.format_conversations(df).first().conv_id is not None
