"""Section files of many incidents: round trips over parts, openings, the index."""

import os

import pytest
from pyspark.sql import functions as F

from casebook.sinks import section_parts as P
from casebook.sinks import writers as W
from casebook.sources import readers as RD

SCHEMA = "incident_id string, section string, section_order int, row_no int, row map<string,string>"
AWKWARD = ['a, "quoted"\nnext', "", "--- x", "日本   é", "'", '"', "a;b\tc", "\n", "--- Details ---\nId"]


def rows_of(incident, n, order=0, section="Discussions", word="t"):
    return [(incident, section, order, k, {"Date": str(k), "Text": word + AWKWARD[k % len(AWKWARD)]}) for k in range(n)]


def read_back(df):
    got = {}
    for r in df.orderBy("incident_id", "section_order", "part", "row_no").collect():
        got.setdefault((r.incident_id, r.section), []).append(r.row)
    return got


def test_hot_incident_and_sections_opened_again(spark, tmp_path):
    data = rows_of("hot", 400, word="old") + rows_of("hot", 50, 1, "Details") + rows_of("hot", 300, 2)
    data += [r for k in range(30) for r in rows_of(f"-{k}", 3)] + rows_of(None, 2) + rows_of('q"1,\n', 2)
    path = str(tmp_path / "store")
    P.section_parts_sink(spark.createDataFrame(data, SCHEMA).repartition(5), path, 12)
    index = spark.read.parquet(f"{path}/index")
    assert index.where("incident_id = 'hot'").count() > 1  # one incident, several files
    assert index.groupBy("part").count().agg(F.max("count")).first()[0] > 1  # one file, several incidents
    want = {}
    for incident, section, order, _, row in data:
        if (incident, section, order) != ("hot", "Discussions", 0):
            want.setdefault((incident, section), []).append(row)
    assert read_back(P.section_parts(spark, path, cell_cap=None)) == want


def test_index_opens_the_files_of_the_asked_incidents(spark, tmp_path):
    data = [r for k in range(40) for r in rows_of(f"i{k:02}", 20)]
    path = str(tmp_path / "store")
    P.section_parts_sink(spark.createDataFrame(data, SCHEMA), path, 12)
    parts = [r.part for r in spark.read.parquet(f"{path}/index").where("incident_id = 'i07'").select("part").distinct().collect()]
    asked = spark.createDataFrame([("i07",), ("i07",), ("none",)], "incident_id string")
    got = P.section_parts(spark, path, asked)
    assert {r.part for r in got.collect()} == set(parts) and len(parts) < len(os.listdir(f"{path}/data"))
    assert read_back(got) == {("i07", "Discussions"): [r[4] for r in rows_of("i07", 20)]}
    assert P.section_parts(spark, path, asked.where("incident_id = 'none'")).count() == 0


def test_headers_follow_the_rows(spark, tmp_path):
    data = [("1", "S", 0, 0, {"b": "1"}), ("1", "S", 0, 1, {"a": "2", "b": None}), ("1", "S", 0, 2, {}), ("1", "Only", 1, 0, {"x": "v"})]
    path = str(tmp_path / "files")
    W.section_csv_text(spark.createDataFrame(data, SCHEMA), path)
    (name,) = [f for f in os.listdir(f"{path}/incident_id=1") if f.startswith("part-")]
    text = open(f"{path}/incident_id=1/{name}", newline="").read()
    assert text == '\n--- S ---\nb,a\n1,\n,2\n,\n\n--- Only ---\nx\nv\n'
    assert RD.sections_of(text)[0] == {"S": [{"b": "1", "a": ""}, {"b": "", "a": "2"}], "Only": [{"x": "v"}]}


@pytest.mark.parametrize("sink", [P.section_parts_sink, P.section_files_sink])
def test_empty_table(spark, tmp_path, sink):
    sink(spark.createDataFrame([], SCHEMA), str(tmp_path / "empty"))


def test_one_file_an_incident_keeps_its_order(spark, tmp_path):
    data = rows_of("a", 300) + rows_of("b", 200, 0, "Details") + rows_of("b", 100, 1)
    path = str(tmp_path / "files")
    P.section_files_sink(spark.createDataFrame(data, SCHEMA).repartition(7), path)
    for incident in "ab":
        (name,) = [f for f in os.listdir(f"{path}/incident_id={incident}") if f.startswith("part-")]
        sections, bad = RD.sections_of(open(f"{path}/incident_id={incident}/{name}", newline="").read(), None)
        want = {}
        for i, s, _, _, row in data:
            if i == incident:
                want.setdefault(s, []).append(row)
        assert sections == want and bad == 0


def test_gap_request_topics(spark):
    from casebook.operators import prompting as PR

    rows = [("s", "a {topic}", "VPN"), (None, None, None), ("s", "a", "")]
    df = spark.createDataFrame(rows, "summary string, article_text string, topic string")
    got = [r.gap_request for r in PR.gap_requests(df, topic="topic").collect()]
    assert "data above (VPN)" in got[0] and "the VPN described" in got[0] and "a {topic}" in got[0]
    assert "No summary available" in got[1] and "(issue)" in got[1] and "(issue)" in got[2]
    assert "(issue)" in PR.gap_requests(df).first().gap_request
