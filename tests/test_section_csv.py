import csv
import io
import random

import pytest

from casebook.sources import readers as RD
from casebook.sources import section_csv as SC


def awkward(rng, n):
    """A file of sections, some nameless, opened again, empty or with odd rows."""
    buf = io.StringIO()
    w = csv.writer(buf, lineterminator="\n")
    buf.write("stray,row\n\n")
    for k in range(n):
        mark = rng.choice(["--- A ---", "--- B ---", "---", "-----", "--- ---", "---C---", f"--- s{k} ---", "--- two\nlines ---", " --- x ---"])
        w.writerow([mark] + ["z"] * (k % 2))
        if rng.random() < 0.8:
            w.writerow(rng.choice([["h"], ["h", "k"], ["h", "h"], ["k", "", "q"]]))
        for _ in range(rng.choice([0, 1, 3, 8])):
            cell = lambda: rng.choice(["v", "", "a,b", 'say "hi"', "one\ntwo", "x\r\ny", '"\n"', "--- A ---", " ", "ü日🙂", "l\n" * 30])
            w.writerow([cell() for _ in range(rng.choice([1, 2, 3, 4]))])
        if rng.random() < 0.3:
            buf.write('mid"quote,"tail"x\n')
        if rng.random() < 0.2:
            buf.write("\n , \n")
    return buf.getvalue()


def expected(files, cell_cap=None):
    out = []
    for name, text in files.items():
        found, bad = RD.sections_of(text, cell_cap)
        out += [(name, s, k, tuple(sorted(row.items())), bad) for s, rows in found.items() for k, row in enumerate(rows)]
    return sorted(out)


def listed(df):
    return sorted((r["path"].rsplit("/", 1)[1], r["section"], r["row_no"], tuple(sorted(r["row"].items())), r["bad_rows"]) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", size), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", ["90", "400", "100000"])
def test_equals_the_parser_of_one_text(spark, tmp_path, small_splits, size):
    rng = random.Random(int(size))
    files = {f"incident_{k}.csv": awkward(rng, rng.choice([2, 9, 14])) for k in range(4)}
    files["incident_8.csv"] = ""
    files["incident_9.csv"] = '--- A ---\nh,k\n"' + 'long "" cell\n' * 60 + '",end\nplain,"q"\n'  # a cell over many splits
    files["incident_10.csv"] = '--- A ---\nh\n1\n--- A ---\n'  # opened again without rows
    files["incident_11.csv"] = "--- A ---\nh\n1\n---\nq\n2\n--- B ---\r\nk\r\nv\r\n"
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    small_splits(size)
    want = expected(files)
    assert listed(RD.multi_section_csv(spark, str(tmp_path), cell_cap=None)) == want
    if size == "90":
        tasks = SC.file_lines(spark, str(tmp_path)).rdd.getNumPartitions()
        assert tasks > 20 and SC.starts_inside(SC.file_lines(spark, str(tmp_path)))
        assert listed(RD.multi_section_csv(spark, str(tmp_path), cell_cap=5)) == expected(files, 5)


def test_nameless_mark_ends_a_section():
    assert RD.sections_of("--- A ---\nh\n1\n---\nq\n2\n----\nr\n3\n")[0] == {"A": [{"h": "1"}]}


def test_redaction_in_any_cell_of_the_section(spark, tmp_path, small_splits):
    files = {"a.csv": "--- Authored summary ---\nS,T\nx,** redacted **\n", "b.csv": "--- Discussions ---\nText\n** REDACTED **\n",
             "c.csv": "--- AUTHORED SUMMARY ---\n**REDACTED**\n", "d.csv": "--- Authored summary ---\nS\nnot ** REDACTED **\n",
             "e.csv": " --- Authored summary --- \nS\n\"** REDACTED **\n\"\n--- Authored summary ---\nS\nfine\n", "f.csv": "x\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    for size in ("20", "100000"):
        small_splits(size)
        got = {r["path"].rsplit("/", 1)[1]: r["redacted"] for r in SC.redacted_files(spark, str(tmp_path)).collect()}
        assert got == {"a.csv": True, "b.csv": False, "c.csv": True, "d.csv": False, "e.csv": True, "f.csv": False}
