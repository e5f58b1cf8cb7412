import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import jaccard
from tidemark.llm.data import table


def shingles(t):
    data = (t or "").encode()
    s, _ = jaccard.shingled(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return frozenset(s.tolist())


def brute(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    post = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            post[x].append(i)
    links = [set() for _ in rows]
    for i, s in enumerate(sets):
        for j in {j for x in s for j in post[x]}:
            if j != i and len(s & sets[j]) >= similarity * len(s | sets[j]) - 1e-9:
                links[i].add(j)
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, min(ids) if ids else None, len(links[i])))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, set int")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.join(docs).collect()), key=str)
    assert got == brute(rows)


def made(n, groups, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(5000)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(60, 160))] for _ in range(groups)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append((i, " ".join(words)))
    return rows


def test_against_brute_force(spark):
    check(spark, made(300, 60, 1))


@pytest.mark.parametrize("depth", [0, 3])
def test_large_buckets(spark, monkeypatch, depth):
    monkeypatch.setattr(jaccard, "LIMIT", 20)
    monkeypatch.setattr(jaccard, "BLOCK", 15)
    monkeypatch.setattr(jaccard, "DEPTH", depth)
    check(spark, made(160, 2, 2))


def test_defined_cases(spark):
    check(spark, [(None, "a b c d e f"), (4, "A b, c d e f"), (4, "A b, c d e f"), (5, None), (6, ""), (7, "..."), (8, "two words"), (9, "two words"), (1, "x " * 30_000), (2, "x y")])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(docs).count() == 0


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    check(spark, rows)


def test_recursion_on_documents(spark, monkeypatch):
    """Buckets of more than 4 sets are split on sf0.01: the rows are those of the SQL-checked setting."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = sorted(map(tuple, jaccard.join(docs).collect()))
    seen = []
    split = jaccard._split
    monkeypatch.setattr(jaccard, "_split", lambda root: seen.append(root) or split(root))
    for name, value in (("LIMIT", 4), ("BLOCK", 10)):
        monkeypatch.setattr(jaccard, name, value)
    assert sorted(map(tuple, jaccard.join(docs).collect())) == want
    assert seen.count(False) >= 1


def test_alike_buckets(spark):
    """One bucket of near copies, one of sets that share a token only."""
    sig = np.random.default_rng(1).integers(0, 1 << 32, (600, jaccard.SIGNATURE), dtype=np.uint32)
    sig[:300] = np.where(np.random.default_rng(2).random((300, jaccard.SIGNATURE)) < 0.85, sig[0], sig[:300])
    rows = [(bytes([i // 256, i % 256]), x.tobytes(), int(i < 300), 300) for i, x in enumerate(sig)]
    sets = spark.createDataFrame(rows, "set binary, sig binary, path long, n long")
    assert [r["path"] for r in jaccard._alike(sets.select("set", "path", "n"), sets.select("set", "sig")).collect()] == [1]
