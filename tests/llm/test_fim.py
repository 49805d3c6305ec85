import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casebook.llm import fim as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        form, out = "plain", text
    elif h4 % 100 < 80:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    chars = (None, None) if form == "plain" else (len(prefix), len(middle))
    return doc_id, len(units), form, *chars, out


TEXTS = [None, "", " ", "\n\n", "a", " a", "a ", "  a  b\tc\r\n", "é ü ñ", "日本語 テスト　全角", "🙂🙂 🙂", "x" * 5000, "a b " * 3000,
         "<P>", "a <S> b", "a <M", "<", "<P", "S> <P x", "a\x00b\x1fc\x85d e", "one two three four five six seven eight nine"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0e\x1f!ab\x7f\x80é日🙂", max_size=40), min_size=1, max_size=8))
def test_unit_ends_and_lengths(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    words = M.words_of(np.frombuffer(b"".join(raw), np.uint8))
    ends, inner = M.unit_ends(words, offsets), M.continuations(words)
    for t, lo, hi in zip(texts, offsets.tolist(), offsets[1:].tolist()):
        want = np.cumsum([len(u.encode()) for u in UNIT.findall(t)]).tolist()
        first, n = int(ends.before(np.array([lo]))[0]), int(ends.before(np.array([hi]))[0])
        assert [lo + w for w in want] == (ends.place(np.arange(first + 1, n + 1)) + 1).tolist()
        assert hi - lo - int(np.diff(inner.before(np.array([lo, hi])))[0]) == len(t)


def rows():
    return [(k, t) for k in range(60) for t in (TEXTS[k % len(TEXTS)], TEXTS[-1])] + [(None, "a b c"), (-5, "p q r"), (7, "a a"), (7, "a a")]


def test_equals_brute_force_with_real_outputs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS form", "2 AS output")
    got = M.fill_in_middle(df)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((brute(*r) for r in rows()), key=key)
    back = got.select("doc_id", M.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(((r[0] or 0, r[1]) for r in back.collect())) == sorted((k or 0, t or "") for k, t in rows())
    assert M.fill_in_middle(df.limit(0)).count() == 0


def test_equals_sql(spark):
    plain = [r for r in rows() if r[1] is None or "\x00" not in r[1]]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?,?)", plain)
    got = M.fim_digests(spark.createDataFrame(plain, "doc_id long, text string"))
    want = con.execute(M.ORACLE_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_other_names_and_percentages(spark):
    df = spark.createDataFrame([("k1", "a b"), ("k2", "c d")], "n string, body string")
    got = M.fill_in_middle(df, "n", "body", fim_percent=100, spm_percent=0, sentinels=("[p]", "[s]", "[m]"))
    assert got.columns[:2] == ["n", "n_"] and {r["form"] for r in got.collect()} == {"psm"}
    assert all(r["output"].startswith("[p]") for r in got.collect())


@pytest.mark.parametrize("bad", [("aa", "b", "c"), ("<P>", "<P>", "<M>"), ("ab", "ba", "x"), ("", "b", "c"), ("abc", "b", "x")])
def test_sentinels_that_overlap_are_refused(bad):
    with pytest.raises(ValueError):
        M.check_sentinels(bad)
