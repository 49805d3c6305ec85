import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casebook.llm import common, substrings as S


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(x[k:k + length] for x in raw for k in range(len(x) - length + 1))
    out = []
    for (d, _), x in zip(rows, raw):
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if count[x[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(x)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abé", min_size=0, max_size=60).map(str.encode), st.integers(1, 2)), min_size=1, max_size=6),
       st.integers(1, 20))
def test_expansion_finds_repeated_windows(parts, length):
    texts, weights = [t for t, _ in parts], [w for _, w in parts]
    count = Counter()
    for t, w in parts:
        for k in range(len(t) - length + 1):
            count[t[k:k + length]] += w
    want = {(i, k) for i, t in enumerate(texts) for k in range(len(t) - length + 1) if count[t[k:k + length]] > 1}
    got = {(int(i), int(a) + k) for i, a, n in zip(*S.repeated_windows(texts, weights, length)) for k in range(n)}
    assert got == want


def test_segments_cover_each_window_once_by_content():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab \xc3\xa9") for _ in range(n)) for n in (0, 5, 19, 20, 400)] + [b"a" * 300] * 2
    block = common.TextBlock(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.zeros(len(texts), bool))
    key, seen = {}, Counter()
    for text, start, n, h in zip(*S.segments(block, 20, 8)):
        assert n <= 13
        for k in range(start, start + n):
            seen[text, k] += 1
            assert key.setdefault(texts[text][k:k + 20], h) == h
    assert seen == Counter((i, k) for i, t in enumerate(texts) for k in range(len(t) - 19))


def corpus(seed, n_docs):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [line(rng.choice([15, 30, 80, 300])) for _ in range(6)]
    rows = []
    for k in range(n_docs):
        t = line(rng.choice([0, 10, 60, 200]))
        for _ in range(rng.choice([0, 1, 1, 3])):
            t += rng.choice(passages[:3] if k % 3 else passages)[rng.choice([0, 0, 2]):] + line(rng.choice([0, 1, 40]))
        rows.append((k, t))
    rows += [(900, None), (901, ""), (902, "x" * 500), (903, "ab" * 300), (None, rows[0][1]), (5, rows[5][1]), (5, line(90)),
             (904, rows[7][1][:-3] + "!!" + rows[8][1])]
    return rows


@pytest.mark.parametrize("length,seed,group_rows,n_docs", [(24, 8, 400, 60), (24, 8, 5, 120), (24, 16, 1, 30), (200, 64, 400, 60), (200, 64, 4, 60)])
def test_operator(spark, length, seed, group_rows, n_docs):
    rows = corpus(length + group_rows, n_docs)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS h", "1L AS ra")
    got = sorted([tuple(r) for r in S.substring_duplicates(df, length=length, seed=seed, group_rows=group_rows).collect()], key=str)
    want = brute(rows, length)
    assert got == want and any(r[2] for r in want)


@pytest.mark.parametrize("length,seed,group_rows", [(200, 64, 400), (24, 8, 400), (24, 8, 1)])
def test_repeats_inside_one_segment(spark, length, seed, group_rows):
    rng = random.Random(length + group_rows)
    noise = lambda: "".join(rng.choice("ABCDEFGH") for _ in range(20))
    rows = [(0, "x" * (length + 50)), (1, "abcde" * (length // 4)), (2, "0123456789 a line of forty bytes, again\n" * 7)]
    for k in range(80):  # some cores are in many texts, so their groups are refined
        period = "".join(rng.choice("pqrst") for _ in range(rng.randint(1, 15)))
        run = (period * length)[:length + rng.randint(0, length // 2)]
        rows.append((10 + k, noise() + (run if k % 2 else run[:9] + "common core" * 2 + run) + noise()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in S.substring_duplicates(df, length=length, seed=seed, group_rows=group_rows).collect()], key=str)
    want = brute(rows, length)
    assert got == want and all(r[2] for r in want if r[0] in (0, 1))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.substring_duplicates(df).count() == 0


@pytest.mark.parametrize("copies", [50, 200])
def test_equal_rows_have_the_runs_of_one(spark, copies):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    near = [(k, text[:700] + str(k) + text[700:]) for k in range(20)]
    rows = S._rows(spark.createDataFrame([(7, text)] * copies + near, "doc_id long, text string"), "doc_id", "text")
    runs = S.repeated_runs(rows, S.MIN_LENGTH, S.SEED, S.GROUP_ROWS).collect()
    assert len(runs) == 21 and max(len(r["runs"]) for r in runs) <= 60
