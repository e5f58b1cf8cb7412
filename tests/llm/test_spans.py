import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import spans
from tidemark.llm.data import table


def brute(rows, length, keep):
    where = defaultdict(list)
    raws = [(t or "").encode() for _, t in rows]
    for i, raw in enumerate(raws):
        for p in range(len(raw) - length + 1):
            where[raw[p : p + length]].append((i, p))
    hit = [bytearray(len(r)) for r in raws]
    for places in where.values():
        if len(places) > 1:
            for i, p in places if keep == "none" else places[1:]:
                hit[i][p : p + length] = b"\1" * length
    out = []
    for (d, _), raw, h in zip(rows, raws, hit, strict=True):
        out.append((d, len(raw), sum(h), sum(h[i] and not (i and h[i - 1]) for i in range(len(h))), hashlib.sha256(bytes(b for b, x in zip(raw, h, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def got(docs, length, keep):
    return sorted(((r[0], r["n_bytes"], sum(x["e"] - x["s"] for x in r["spans"]), len(r["spans"]), hashlib.sha256(r["bytes"]).hexdigest()) for r in spans.removed(docs, keep, length).collect()), key=str)


def made(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rnd.randint(10, 60)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            parts += [p[rnd.randint(0, 20) : len(p) - rnd.randint(0, 20)], text(rnd.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    whole = text(80)
    rows += [(60, whole), (61, whole), (62, "x" + whole[1:]), (63, None), (64, ""), (65, "ab " * 200), (66, "aaaa" * 100), (67, passages[0] + passages[0]), (68, "É" * 90)]
    return rows


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("length", [64, 101])
def test_against_brute_force(spark, keep, length):
    rows = made(length)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, hash int")
    assert got(docs, length, keep) == brute(rows, length, keep)


def test_factors_against_brute_force():
    """LPF and LNF of random strings over their suffix arrays, against all pairs of positions."""
    rnd = random.Random(8)
    for _ in range(300):
        text, length = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))), rnd.randint(1, 5)
        places = list(range(len(text) - length + 1))
        order = sorted(places, key=lambda p: (text[p : p + length], rnd.random()))  # equal prefixes in any order
        same = np.array([text[p : p + length] == text[q : q + length] for p, q in zip(order, order[1:])], dtype=bool)
        lpf, lnf = spans.factors(same, np.array(order, dtype=np.int64), length)
        for p, x, y in zip(order, lpf.tolist(), lnf.tolist(), strict=True):
            common = lambda q: next((k for k in range(length) if text[p + k] != text[q + k]), length)
            assert x == (length if any(common(q) == length for q in places if q < p) else 0)
            assert y == (length if any(common(q) == length for q in places if q > p) else 0)


def test_suffix_order_does_not_depend_on_batches():
    rnd = random.Random(9)
    rows = sorted((rnd.randint(0, 5), rnd.randint(0, 1), i, rnd.random() < 0.7) for i in range(60))
    for keep in ("none", "first"):
        want = []
        for k, (h1, h2, i, single) in enumerate(rows):
            before = k > 0 and rows[k - 1][:2] == (h1, h2)
            behind = k + 1 < len(rows) and rows[k + 1][:2] == (h1, h2)
            if (before if keep == "first" else (before or behind) and single):
                want.append(i)
        for size in (1, 2, 7, 60):
            batches = [pa.RecordBatch.from_pydict({"h1": [r[0] for r in rows[a : a + size]], "h2": [r[1] for r in rows[a : a + size]], "context": [r[2] for r in rows[a : a + size]], "rel": pa.array([0] * len(rows[a : a + size]), pa.int16()), "single": [r[3] for r in rows[a : a + size]]}) for a in range(0, 60, size)]
            assert [x for b in spans._matched(keep, 400)(iter(batches)) for x in b.column(0).to_pylist()] == want


def test_first_copies_stay_whole(spark):
    """The same places kept whichever row holds a copy first; rows that agree in id and text are one place."""
    rnd = random.Random(1)
    body = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    rows = [(3, "x" + body), (1, body), (2, body[100:700] + "tail"), (1, body), (None, body[:500])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r["doc_id"], r["n_bytes"]): len(r["bytes"]) for r in spans.removed(docs, "first", 200).collect()}
    assert kept == {(None, 500): 500, (1, 900): 199 + 201, (2, 604): 4, (3, 901): 1}


def test_shuffled_lookups(spark, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST_ROWS", 0)
    rows = made(3) + [(60, made(3)[60][1]), (None, "z" * 200), (None, "z" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, 80, "none") == brute(rows, 80, "none")


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect())
    assert sorted(map(tuple, spans.op6_substrings(spark, sf).collect()), key=str) == brute(rows, 400, "none")
    assert spans.removed(table(spark, sf, "documents").limit(0)).count() == 0
