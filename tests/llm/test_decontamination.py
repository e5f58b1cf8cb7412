import hashlib
import re

from tidemark.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(len(iw), 10)
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for p in range(len(w) - n + 1 if n else 0):
            if tuple(w[p : p + n]) in wins:
                hit.update(range(p, p + n))
                ids.add("" if item is None else str(item))
    return len(w), len(hit), sorted(ids)


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (10, LONG), (2, "Solo"), (3, "alpha beta gamma"), (4, None), (5, "..."), (None, "one two three four five six seven eight nine"), (7, "a a a a a a a a a a a a"), (1, LONG)]
DOCS = [
    (0, None), (1, ""), (2, "x " + LONG + " y"), (3, " ".join(LONG.split()[5:15])), (4, " ".join(LONG.split()[5:14])), (5, "the solo SOLO."), (6, "alpha, beta; Gamma alpha beta"),
    (7, "a " * 30), (8, "zero one two three four five six seven eight nine ten"), (8, "dup solo"), (9, "Éa É " + LONG.upper() + " w39"), (9, "Éa É " + LONG.upper() + " w39"), (10, (LONG + " ") * 60), (11, "a " * 9),
]


def check(spark, items):
    docs = spark.createDataFrame([(i, t, 0) for i, t in DOCS], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n"], r["ids"]) for r in dec.hits(docs, bench).selectExpr("doc_id", "n_words", "spans", "items ids").withColumn("n", dec.covered(dec.F.col("spans"))).collect())
    assert got == sorted((i, *brute(t, items)) for i, t in DOCS)


def test_against_brute_force(spark):
    check(spark, ITEMS)


def test_long_items_only(spark):
    check(spark, [ITEMS[0], ITEMS[7]])


def test_shuffled_lookup(spark, monkeypatch):
    monkeypatch.setattr(dec, "BROADCAST_ROWS", 0)
    check(spark, ITEMS)


def test_empty_benchmark(spark):
    check(spark, [])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dec.hits(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_digest(spark):
    rows = dec.op5_decontamination(spark, "/root/testdata/sf0.001").collect()
    assert any(r["contaminated"] for r in rows)
    assert all((r["n_items"] > 0) == r["contaminated"] == (r["items_sha256"] != hashlib.sha256(b"").hexdigest()) for r in rows)
