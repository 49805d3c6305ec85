"""Trees of small files: what is written is what is listed and read."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from casebook.plans import q_logs as QL
from casebook.sinks import file_tree as FT

ROWS = [("inc1/01-15/Output_run0/health.txt", "a\nb\n"), ("inc1/01-15/Output_run0/nested/d1/agent.log", ""),
        ("inc2/02-15/raw_run1/log.txt", "é\r\n"), ("inc2/02-15/raw_run1/config.txt", None), ("03-15", "x")]


@pytest.mark.parametrize("mounted", [True, False])
def test_tree_reads_back(spark, tmp_path, mounted):
    root = str(tmp_path / "tree")
    FT.write_tree(spark.createDataFrame(ROWS, "rel string, content string"), root, mounted)
    listed = FT.tree_listing(spark, root).filter(F.col("rel") != "03-15")
    got = {r.rel: r.content for r in FT.tree_contents(spark, listed).collect()}
    assert got == {rel: content or "" for rel, content in ROWS if rel != "03-15"}
    assert FT.tree_listing(spark, root).count() == len(ROWS)


def test_requested_logs_writes_one_plain_file_a_log(spark, tmp_path, monkeypatch):
    """No checksum file and no folder of its own for each log: Hadoop's local
    file system starts a process for each of these."""
    sf = tmp_path / "sf"
    spark.createDataFrame([(i, f"text {i}", "en", "web", 30) for i in range(60)],
                          "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "q")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    monkeypatch.setattr(QL, "ensure_checkpoint_dir", lambda spark: f"file://{tmp_path}/kept")
    rows = QL.q_requested_logs(spark, str(sf)).collect()
    root, = glob.glob(f"{tmp_path}/kept/casebook-logs-*")
    paths = [os.path.relpath(f"{at}/{f}", root) for at, _, files in os.walk(root) for f in files]
    wanted = {r.rel for r in QL.listing(spark, str(sf)).collect()}
    assert sorted(paths) == sorted(wanted)
    assert rows and {r.incident_id for r in rows} == {"inc1"}


def test_section_files_are_plain_and_read_in_one_pass(spark, tmp_path):
    from casebook.sinks import writers as W
    from casebook.sources import readers as RD
    from casebook.sources import section_csv as SC

    path = str(tmp_path / "sections")
    texts = {"a/b=1": "two\nlines", "7": 'a "quote", comma', None: "x", "": "y", "é%": ""}
    rows = [(i, "Discussions", 0, n, {"Date": str(n), "Text": t}) for i, t in texts.items() for n in range(2)]
    sections = spark.createDataFrame(rows, "incident_id string, section string, section_order int, row_no int, row map<string,string>")
    for _ in range(2):  # written again in place
        W.section_csv_text(sections.filter("incident_id is not null and incident_id != ''"), path)
    assert sorted(os.listdir(path)) == ["incident_id=7", "incident_id=a%2Fb%3D1", "incident_id=é%25"]
    assert not [f for _, _, files in os.walk(path) for f in files if f.startswith(".")]
    got = RD.multi_section_csv(spark, path).select("row_no", "row.Date", "row.Text").collect()
    assert sorted((r.row_no, r.Date, r.Text) for r in got) == sorted((n, str(n), t) for i, t in texts.items() if i for n in range(2))
    assert SC.several_splits(SC.file_text(spark, path)).count() == 0
    other = str(tmp_path / "unnamed")
    W.section_csv_text(sections.filter("incident_id is null or incident_id = ''"), other)
    assert os.listdir(other) == ["incident_id=__HIVE_DEFAULT_PARTITION__"]
    assert len(RD.discussions_from_sections(RD.multi_section_csv(spark, other)).collect()) >= 2


def test_several_splits_gives_all_lines_of_a_large_file(spark, tmp_path):
    from casebook.sources import section_csv as SC

    (tmp_path / "large.csv").write_text("".join(f"line {n}\n" for n in range(4000)))
    (tmp_path / "small.csv").write_text("line\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4KB")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = SC.several_splits(SC.file_text(spark, str(tmp_path))).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(lines) >= 4000 and len({r.start for r in lines}) > 5
