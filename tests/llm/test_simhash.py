import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from casebook.llm import components, simhash as S


def plain_fingerprint(text: str) -> int:
    words, word = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é\n\x0b\x85\xa0") | st.lists(st.sampled_from(["x", "Yz", "é", "q"]), max_size=600).map(" ".join))
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def brute(rows, threshold=4):
    prints = [plain_fingerprint(t or "") for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                label[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if root(k) == root(i) and rows[k][0] is not None]
        out.append((d, f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def test_covering_code():
    for width, near in ((21, 1), (22, 1), (12, 0), (32, 2)):
        code = S.CoveringCode(width, near)
        values = np.random.default_rng(1).integers(0, 1 << width, 200, dtype=np.uint64)
        rows, anchors, home = code.anchors(values)
        assert home.sum() == len(values)
        assert (np.bitwise_count(anchors[home] ^ values[rows[home]]) <= 1).all()
        homes = dict(zip(rows[home].tolist(), anchors[home].tolist()))
        placed = {k: set(anchors[rows == k].tolist()) for k in range(len(values))}
        rng = random.Random(2)
        for k, v in enumerate(values.tolist()):
            w = v
            for bit in rng.sample(range(width), near):
                w ^= 1 << bit
            other = set(code.anchors(np.array([w], np.uint64))[1].tolist())
            assert homes[k] in other and len(placed[k]) == (rows == k).sum()


@pytest.mark.parametrize("anchor_rows,blocks", [(20_000, 3), (5, 3), (20_000, 2)])
def test_links_connect_all_close_fingerprints(spark, anchor_rows, blocks):
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            prints.add(p)
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                p ^= 1 << bit
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    got = components.connected_components(S.links(df, anchor_rows=anchor_rows, blocks=blocks)).collect()
    root = {r.node: r.root for r in got}
    label = {p: p for p in prints}
    for _ in prints:
        for p in prints:
            label[p] = min(label[q] for q in prints if (p ^ q).bit_count() <= 4)
    mine = {}
    for p in prints:
        s = int(np.uint64(p).view(np.int64))
        mine.setdefault(root.get(s, s), set()).add(p)
    theirs = {}
    for p in prints:
        theirs.setdefault(label[p], set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_operator(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(6)]
    texts = [None, "", " \n", "one two", "ONE  two"] + base + base[:3]
    for b in base:
        w = b.split()
        for _ in range(4):
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows = [(100 - k, t) for k, t in enumerate(texts)] + [(100, None), (None, base[0]), (None, "alone here")]
    df = spark.createDataFrame([(d, t, "f") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted([tuple(r) for r in S.near_duplicates(df).collect()], key=str)
    assert got == brute(rows)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_with_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a", "b", "c", "d"), (2, text, "e", "f", "g", "h"), (None, "quite another text without an id here", "i", "j", "k", "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _id string, key string, fp string")
    got = S.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r["_key"] for r in got.collect()) == ["a", "i"]
