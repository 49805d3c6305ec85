import json
import os

import pytest
from pyspark.sql import functions as F

from casebook.operators import conversation as C
from casebook.operators import logs as LG
from casebook.sinks import writers as W
from casebook.sources import readers as RD

SECTION_CSV = '''--- Discussions ---
Date,ChangedBy,Text
2024-01-02T10:00:00Z,alice,"line one
line two"

2024-01-01T09:00:00Z,bob,<p>hello</p>,surplus
2024-01-03T09:00:00Z,carol

--- Authored summary ---
Summary
** REDACTED **
--- Authored summary ---
Summary,Extra
final,cell
'''


def test_sections_of_awkward_files():
    big = "x" * 200_000
    text = ("stray,row\n--- A ---\nh,h\n1,2\n--- B ---\nk\n\"" + big + "\"\n,\n--- Empty ---\n--- Head only ---\nq\n"
            "--- A ---\nn,m\nr,s,surplus\nshort\n")
    found, bad = RD.sections_of(text, cell_cap=None)
    assert found == {"A": [{"n": "r", "m": "s"}, {"n": "short"}], "B": [{"k": big}], "Head only": []} and bad == 0
    assert RD.sections_of(text)[0]["B"][0]["k"] == big[:100_000] + "... [TRUNCATED]"
    assert RD.sections_of("--- A ---\nh,h\n1,2\n")[0] == {"A": [{"h": "2"}]}
    assert RD.sections_of("") == ({}, 0)


def test_multi_section_csv(spark, tmp_path):
    p = tmp_path / "incident_12345.csv"
    p.write_text(SECTION_CSV)
    rows = RD.multi_section_csv(spark, str(tmp_path)).orderBy("section", "row_no").collect()
    disc = [r for r in rows if r.section == "Discussions"]
    assert [r.row["ChangedBy"] for r in disc] == ["alice", "bob", "carol"]
    assert disc[0].row["Text"] == "line one\nline two"
    assert "Text" not in disc[2].row           # short row: missing cell absent
    summ = [r for r in rows if r.section == "Authored summary"]
    assert len(summ) == 1 and summ[0].row == {"Summary": "final", "Extra": "cell"}   # re-opened section wins
    d = RD.discussions_from_sections(RD.multi_section_csv(spark, str(tmp_path)))
    e = C.drop_service_noise(C.normalize_entries(d))
    text = C.conversation_text(e).first()
    assert text.incident_id == "12345"
    assert text.conversation_text.splitlines()[0] == "[2024-01-01T09:00:00Z] bob: hello"


def test_incident_json_shapes_and_sink_roundtrip(spark, tmp_path):
    new = {"incident_id": "1", "total_entries": 1, "conversation": [{"timestamp": "t", "author": "a", "content": "c"}],
           "summary": "s"}
    old = {"incident_number": "2", "content": [{"timestamp": "t", "author": "b", "content": "d"}],
           "ai_summary": {"summary": "old s"}}
    d = tmp_path / "in"
    d.mkdir()
    (d / "one.json").write_text(json.dumps(new))
    (d / "incident_3.json").write_text(json.dumps({"conversation": []}))
    (d / "two.json").write_text(json.dumps(old))
    r = {x.incident_id: x for x in RD.incident_json(spark, str(d)).collect()}
    assert r["1"].summary == "s" and r["2"].summary == "old s" and r["2"].conversation[0].author == "b"
    assert "3" in r and r["3"].conversation == []
    # K2 round trip
    e = spark.createDataFrame([("9", 2, 0, "x", "hi"), ("9", 1, 1, "y", "yo")],
                              "incident_id string, ts long, pos long, author string, content string")
    out = str(tmp_path / "out")
    W.incident_json_sink(C.build_conversation(e), out)
    back = RD.incident_json(spark, out, json_lines=True).first()
    assert back.incident_id == "9" and [c.author for c in back.conversation] == ["y", "x"]


def test_combined_json(spark, tmp_path):
    doc = {"content": {"incidents": [{"incident_number": "5", "conversation": []}, {"incident_id": "6"}, {}]}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    r = RD.combined_json(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [x.incident_id for x in r] == ["5", "6", "unknown"]
    assert r[0].mode == "standard" and r[0].total_incidents == 3


def test_vector_db_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"url": "kb/a.md", "embedding": [1, 2]},
                                                 {"url": "kb/b.md", "embedding": []}]))
    (tmp_path / "b.json").write_text(json.dumps({"articles": [{"path": "kb/c.md", "content": "x"}]}))
    (tmp_path / "c.json").write_text(json.dumps({"embeddings": {"kb/d.md": [0.5], "kb/e.md": []}}))
    r = {x.article_path: x.embedding for x in RD.vector_db(spark, str(tmp_path)).collect()}
    assert r["kb/a.md"] == [1.0, 2.0] and r["kb/b.md"] is None and r["kb/c.md"] is None
    assert r["kb/d.md"] == [0.5] and r["kb/e.md"] is None


def test_catalogs(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"a_molecular": {"system_prompt": "s", "user_prompt": "u"},
                                                 "_comment": {"system_prompt": "x"}}))
    cat = RD.prompt_catalog(spark, str(tmp_path / "p.json"))
    assert {r.prompt_type for r in cat.collect()} == {"a_molecular", "_comment"}
    (tmp_path / "e.json").write_text(json.dumps({"a_molecular": [
        {"keywords": ["k"], "category": "c1", "example": {"input": "i", "output": "o"}},
        {"keywords": [], "category": "", "example": {"input": "j", "output": "p"}}]}))
    ex = RD.example_catalog(spark, str(tmp_path / "e.json")).orderBy("ordinal").collect()
    assert [x.ordinal for x in ex] == [0, 1] and ex[0].keywords == ["k"]
    (tmp_path / "t.json").write_text(json.dumps({"technical_patterns": [r"\b(x)\b"]}))
    assert RD.pattern_catalog(spark, str(tmp_path / "t.json")) == [r"\b(x)\b"]
    (tmp_path / "u.json").write_text(json.dumps({"other": 1}))
    assert RD.pattern_catalog(spark, str(tmp_path / "u.json")) == []
    assert len(RD.pattern_catalog(spark, None)) == 12


def test_log_tree(spark, tmp_path):
    def put(rel, text):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    put("111/01-05/client_output_a/health.txt", "old")
    put("111/02-10/client_output_a/health.txt", "device error " + "x" * 20000)
    put("111/02-10/client_output_b/config.txt", "policy ok")
    put("111/02-10/client_output_b/sub/one/agent.log", "y" * 6000)
    put("111/02-10/client_output_b/sub/two/agent.log", "z" * 10)
    put("111/02-10/raw/health.txt", "ignored")
    put("111/notes/x.txt", "ignored")
    files = RD.log_tree(spark, str(tmp_path))
    sel = LG.select_newest(files)
    assert {(r.date_folder, r.analyzer_folder) for r in sel.collect()} == {("02-10", "client_output_b")}
    keys = LG.key_files(sel).collect()
    assert [k.file_name for k in keys] == ["config.txt"]
    nested = LG.nested_logs(sel).collect()
    assert len(nested) == 1 and nested[0].content == "z" * 10    # the last path wins for a repeated name
    # findings and sizes read whole files; caps are the caller's choice
    long = spark.createDataFrame([("7/01-01/output/health.txt", "x" * 20000 + " error"),
                                  ("7/01-01/output/sub/agent.log", "y" * 6000)], "rel string, content string")
    chosen = LG.select_newest(long)
    stats = {r.file_name: (r.chars, r.has_error) for r in LG.file_stats(LG.key_files(chosen), LG.nested_logs(chosen)).collect()}
    assert stats == {"health.txt": (20006, True), "agent.log": (6000, False)}
    assert len(LG.key_files(chosen, head_cap=100).first().content) == 100 + len("... [truncated]")
    assert len(LG.nested_logs(chosen, tail_cap=100).first().content) == 100
    ins = [r.insight for r in LG.log_insights(LG.key_files(sel)).collect()]
    assert ins == ["config.txt: Contains policy-related information"]


def test_only_the_chosen_logs_are_read(spark, tmp_path):
    def put(rel, data):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    put("111/01-05/output_a/health.txt", b"old")
    put("111/02-10/output [b]/health.txt", b"device error")
    put("111/02-10/output [b]/sub/one/agent.log", b"tail")
    put("111/02-10/output [b]/picture.png", bytes(range(256)))
    put("222/02-10/output_b/health.txt", b"not asked for")
    listing = RD.log_listing(spark, str(tmp_path))
    assert set(listing.columns) == {"path", "length", "rel"} and listing.count() == 5
    asked = spark.createDataFrame([("111",), ("333",), ("111",)], "incident_id string")
    chosen = LG.wanted_files(listing, asked)
    assert {r.file_name for r in chosen.collect()} == {"health.txt", "agent.log"}
    read = RD.log_contents(spark, chosen)
    assert {(r.file_name, r.content) for r in read.collect()} == {("health.txt", "device error"), ("agent.log", "tail")}
    assert [r.content for r in LG.key_files(read).collect()] == ["device error"]
    assert RD.log_contents(spark, chosen.limit(0)).count() == 0


def test_sinks_write(spark, tmp_path):
    from casebook.operators.screenshots import screenshot_images

    df = spark.createDataFrame([(1, "a data:image/png;base64,QUJD b")], "id long, t string")
    W.screenshot_sink(screenshot_images(df, "id", "t"), str(tmp_path / "shots"))
    assert os.path.isdir(tmp_path / "shots" / "extension=png")
    ex = spark.createDataFrame([("a_molecular", ["k"], "c", "i", "o")],
                               "prompt_type string, keywords array<string>, category string, input string, output string")
    W.example_append(ex, str(tmp_path / "ex"))
    W.example_append(ex, str(tmp_path / "ex"))
    assert spark.read.parquet(str(tmp_path / "ex")).count() == 2


def test_more_sinks(spark, tmp_path):
    # K1: section tables and the single-file-per-incident text layout, read back by S2
    sec = spark.createDataFrame(
        [("42", "Discussions", 0, 0, {"Date": "d1", "Text": "a, \"quoted\"\nnext"}),
         ("42", "Discussions", 0, 1, {"Date": "d2", "Text": "b"}),
         ("42", "Authored summary", 1, 0, {"Summary": "s"})],
        "incident_id string, section string, section_order int, row_no int, row map<string,string>")
    W.section_csv_sink(sec, str(tmp_path / "k1"))
    assert spark.read.parquet(str(tmp_path / "k1")).count() == 3
    W.section_csv_text(sec, str(tmp_path / "k1txt"))
    back = RD.multi_section_csv(spark, str(tmp_path / "k1txt")).collect()
    disc = sorted([r for r in back if r.section == "Discussions"], key=lambda r: r.row_no)
    assert [r.row["Text"] for r in disc] == ["a, \"quoted\"\nnext", "b"]
    # K3: full and slim records
    res = spark.createDataFrame([("1", "summary text", "x_molecular", "2024-01-01T00:00:00", "m", "content")],
                                "incident_id string, ai_summary string, prompt_type string, operation_time string, "
                                "model_used string, content string")
    W.result_sink(res, str(tmp_path / "k3"))
    slim = spark.read.json(str(tmp_path / "k3" / "summaries"))
    assert set(slim.columns) == {"incident_id", "ai_summary", "operation_time", "model_used", "prompt_type"}
    # K5: append memories twice, latest per incident wins on read
    mem = spark.createDataFrame([("1", "first", [1.0, 0.0])], "incident_id string, summary string, embedding array<double>")
    W.memory_append(mem, str(tmp_path / "k5"))
    W.memory_append(mem.withColumn("summary", F.lit("second")), str(tmp_path / "k5"))
    latest = RD.latest_per_key(spark.read.parquet(str(tmp_path / "k5")), "incident_id", "stored_at").collect()
    assert len(latest) == 1
    # K7: processed summary with screenshot references
    summ = spark.createDataFrame([("1", "see data:image/png;base64,QUJD")], "incident_id string, summary string")
    W.processed_summary_sink(summ, str(tmp_path / "k7"))
    r = spark.read.parquet(str(tmp_path / "k7")).first()
    assert r.summary == "see [SCREENSHOT: screenshot_1_001]" and r.screenshot_count == 1
    # K8: timing report appends keyed by session
    cat = spark.createDataFrame([("ai", 1.0, 1, 1.0)], "category string, total_time double, operation_count long, "
                                                       "average_time double")
    W.timing_report_sink(cat, cat, str(tmp_path / "k8"), "s1")
    W.timing_report_sink(cat, cat, str(tmp_path / "k8"), "s2")
    assert spark.read.parquet(str(tmp_path / "k8" / "by_category")).select("session_ts").distinct().count() == 2


def test_a_repeated_run_leaves_its_rows_once(spark, tmp_path):
    a = spark.createDataFrame([("t1", ["k"], "c", "x", "y"), ("t2", ["k"], "c", "x", "y")],
                              "prompt_type string, keywords array<string>, category string, input string, output string")
    path = str(tmp_path / "examples")
    W.example_append(a, path, "r1")
    W.example_append(a, path, "r2")
    W.example_append(a.limit(1), path, "r2")  # the repeated run has fewer rows: nothing of the first try stays
    assert sorted((r.run, r.prompt_type) for r in spark.read.parquet(path).collect()) == [("r1", "t1"), ("r1", "t2"), ("r2", "t1")]
    with pytest.raises(ValueError):
        W.example_append(a, path, "../r1")
    m = spark.createDataFrame([(1, [0.5], "a"), (1, [0.5], "b"), (2, [1.0], "c")], "incident_id long, embedding array<double>, note string")
    store = str(tmp_path / "memories")
    for _ in range(2):
        W.memory_append(m, store, "r1", F.lit("2024-01-01").cast("timestamp"))
    rows = spark.read.parquet(store)
    assert rows.count() == 3
    for order in (rows, rows.orderBy("note"), rows.orderBy(F.desc("note"))):
        assert sorted((r.incident_id, r.note) for r in RD.latest_per_key(order, "incident_id", "stored_at").collect()) == [(1, "b"), (2, "c")]


def test_vector_store_parses_once(spark, tmp_path):
    for name, text in {"a.json": '[{"path": "p1", "title": "T", "embedding": [1, 2.5]}, null, {"url": "u", "embedding": []}]',
                       "b.json": '{"articles": [{"article_path": "p2", "content": "c", "embedding": "bad"}]}',
                       "c.json": '{"embeddings": {"p3": [0.5], "p4": null}}', "d.json": "not json", "e.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    v = RD.vector_db(spark, str(tmp_path))
    got = sorted((r.article_path, r.title, r.content, r.embedding) for r in v.collect())
    assert got == [("p1", "T", None, [1.0, 2.5]), ("p2", None, "c", None), ("p3", None, None, [0.5]), ("p4", None, None, None), ("u", None, None, None)]
    assert v._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 3 and "from_json" not in v._jdf.queryExecution().toString()
