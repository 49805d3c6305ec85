import random

import pytest

from casebook.llm import decontaminate as D


def brute(docs, items):
    """Every item against every run of words as long as two cells."""
    out = set()
    for d, text in docs:
        words = D.item_words(text)
        for i, t in items:
            item = D.item_words(t)
            if not item or not words:
                continue
            n = min(5, len(item))
            want = {tuple(item[k:k + n]) for k in range(len(item) - n + 1)}
            cell = -(-5 * max(16, 1 << (len(item) - 1).bit_length()) // 4)
            for at in range(0, len(words), cell):
                part = words[at:at + 2 * cell]
                got = {tuple(part[k:k + n]) for k in range(len(part) - n + 1)}
                q, a = (set(x) for x in D.question_and_answer(t))
                if len(want & got) >= 0.8 * len(want) - 1e-9 and all(not p or len(p & set(part)) >= 0.5 * len(p) for p in (q, a)):
                    out.add((d, i))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(120)] + ["the", "of", "Ünter"] * 30
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, line(rng.choice([2, 4, 5, 9, 20, 40, 90]))) for k in range(30)]
    items += [(100, "What is it? " + line(12)), (101, ""), (102, None), (103, "..."), (0, line(30)), (104, line(3) + "\n" + line(25))]
    docs = [(None, line(50)), (1, None), (2, ""), (3, "the")]
    for k in range(120):
        body = line(rng.choice([0, 30, 300])).split()
        for _ in range(rng.choice([0, 1, 2])):
            item = D.item_words(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if item:
                    item[rng.randrange(len(item))] = "zzz"
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "," if rng.random() < 0.2 else w for w in item]
        docs.append((10 + k, " ".join(body)))
    return docs + [docs[20]], items


@pytest.mark.parametrize("seed,shard_items", [(1, 2048), (2, 2048), (3, 7)])
def test_no_leak_is_lost(spark, seed, shard_items):
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS item_id")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_leaks(d, b, shard_items=shard_items).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(want) > 20
    assert all(r.overlap >= 0.8 and r.score > 0 for r in rows)
    kept = D.drop_leaks(d, b, shard_items=shard_items)
    leaked = {x for x, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x, _ in docs if x not in leaked)
    assert kept.columns == d.columns


def test_empty_tables(spark):
    docs, items = corpus(1)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.find_leaks(d, b.limit(0)).count() == 0 and D.find_leaks(d.limit(0), b).count() == 0
    assert D.drop_leaks(d, b.limit(0)).count() == len(docs)


@pytest.mark.parametrize("kind", ["decimal(12,2)", "smallint", "date", "double", "string"])
def test_other_kinds_of_ids(spark, kind):
    text = "the quick brown fox jumps over the lazy dog near the river bank while seven grey geese watch from a distant hill"
    value = "2024-01-01" if kind == "date" else "12"
    rows = spark.createDataFrame([(value, text), (value, None)], "id string, text string").selectExpr(f"CAST(id AS {kind}) AS k", "text")
    got = D.find_leaks(rows, rows, "k", "text", "k", "text")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:2] == [("doc_id", kind), ("item_id", kind)]
    assert [r.doc_id == r.item_id for r in got.collect()] == [True]
