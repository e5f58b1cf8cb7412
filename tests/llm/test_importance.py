import math

import numpy as np

from tidemark.llm import importance as imp
from tidemark.llm.data import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Fitted on the labels of even ids, held against those of odd ids."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = {r["doc_id"] for r in imp.resample(docs, labels.filter("doc_id % 2 = 0")).collect()}
    odd = labels.filter("doc_id % 2 = 1").collect()
    good = [r["doc_id"] in kept for r in odd if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["doc_id"] in kept for r in odd if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_held_out_toxic_documents_go(spark):
    """Fitted on the labels of even ids, held against toxic ones of odd ids."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = {r["doc_id"] for r in imp.resample(docs, labels.filter("doc_id % 2 = 0")).collect()}
    odd = labels.filter("doc_id % 2 = 1 and quality = 1").collect()
    toxic, good = ([r["doc_id"] in kept for r in odd if r["toxic"] == x] for x in (1, 0))
    print(f"kept: toxic {np.mean(toxic):.3f} of {len(toxic)}, good {np.mean(good):.4f} of {len(good)}")
    assert np.mean(toxic) < 0.2 and np.mean(good) > 0.98


def test_toxicity_is_the_most_telling_n_grams():
    ratio = np.array([0, 5, -9, 7, 1, 2], dtype=np.int64) * imp.UNIT
    grams, first = np.array([3, 3, 1, 4, 5, 2, 2, 0, 4]), np.array([0, 6, 6, 8, 9])
    assert imp._toxicity(ratio, grams, first).tolist() == [14, 0, 0, 1]


def test_scores_follow_the_formula(spark):
    docs = spark.createDataFrame([(1, "good words here", 0), (2, "bad ### text", 0), (3, None, 0), (3, None, 0), (None, "", 1), (4, "x" * 100_000, 1)], "doc_id long, text string, keep int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, None, None)], "doc_id long, quality int, toxic int")
    model, scores, bound = imp.marked(docs, labels, k=2)
    rows = scores.collect()
    assert len(rows) == 6 and [r["_importance"] for r in rows if r["doc_id"] == 3] == [0.0, 0.0]
    one = next(r for r in rows if r["doc_id"] == 1)
    grams, first = imp.ngrams(np.frombuffer(b"good words here", np.uint8), np.array([0, 15]))
    assert len(grams) == 5 and list(first) == [0, 5]
    assert math.isclose(one["_importance"], sum(model[grams]) / imp.UNIT)
    assert bound == sorted((r["_key"] for r in rows), reverse=True)[1]
    assert imp.resample(docs, labels, k=2).columns == docs.columns


def test_top_bound_is_exact(spark):
    values = [1e300, -1e300, 0.0, 0.0, 1e-300, 5.5, 5.5, 5.500000000000001, -2.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, 10):
        assert imp.bound_of_top(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert imp.bound_of_top(df, "x", 50) == -1e300 and imp.bound_of_top(df, "x", 0) is None


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert imp.resample(docs, labels).count() == 1
    assert imp.resample(docs.limit(0), labels).count() == 0


def test_clashing_names(spark):
    rows = [(i, f"some good words number {i}" if i % 2 else "bad ### text $$$", i, i, i, i) for i in range(20)]
    docs = spark.createDataFrame(rows, "_id long, _text string, _hash int, _importance int, _key int, c0 int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    kept = imp.resample(docs, labels, k=10, doc_id="_id", text="_text")
    assert kept.columns == docs.columns
    got = kept.collect()
    assert got and all(r["_id"] == r["_hash"] == r["_importance"] == r["_key"] == r["c0"] for r in got)


def words_of(text):
    import re

    return [x.lower() if x.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]+", text)]


def test_whole_result_by_counting_strings(spark):
    """The query on sf0.001 against models that count n-grams as strings, so that none shares a bucket:
    the same documents are kept but for a few that stand at the cut, and importance agrees in order."""
    from collections import Counter

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    labels = table(spark, sf, "labels")
    good = {r["_id"]: r["half"] for r in imp._good(labels).collect()}
    toxic = {r["doc_id"] for r in labels.collect() if r["toxic"] == 1}

    def grams(text):
        w = words_of(text)
        return w + [("", "") if a == b else (a, b) for a, b in zip(w, w[1:])]

    of = {i: grams(t) for i, t in docs.items()}
    raw, target = Counter(g for x in of.values() for g in x), Counter(g for i, x in of.items() if good.get(i) == 0 for g in x)
    share = sum(target.values()) / sum(raw.values())
    ratio = {g: math.log((target[g] + imp.PRIOR) / (n * share + imp.PRIOR)) for g, n in raw.items()}
    score = {i: sum(ratio[g] for g in x) * min(1.0, imp.SPAN / max(len(x), 1)) for i, x in of.items()}
    holds = [Counter(g for i, x in of.items() if i in ids for g in set(x)) for ids in ({i for i, h in good.items() if h == 0}, toxic)]
    n_good, n_toxic = (sum(i in docs for i in ids) for ids in ({i for i, h in good.items() if h == 0}, toxic))
    against = lambda g: math.log((holds[1][g] + 1) / (holds[0][g] * n_toxic / n_good + 1))
    bad = {i: sum(sorted((max(against(g), 0) for g in set(x)), reverse=True)[: imp.TELLING]) for i, x in of.items()}
    held = [i for i, h in good.items() if h == 1 and i in docs]
    cut, limit = min(score[i] for i in held), max(bad[i] for i in held)
    want = {i for i in docs if score[i] >= cut and bad[i] <= limit}
    rows = imp.op9_importance(spark, sf).collect()
    got = {r["doc_id"] for r in rows}
    assert len(got ^ want) <= 0.05 * len(docs)
    near = [abs(r["importance"] - score[r["doc_id"]]) for r in rows]
    assert np.median(near) < 0.5 and np.corrcoef([r["importance"] for r in rows], [score[r["doc_id"]] for r in rows])[0, 1] > 0.99
    assert all(r["n_grams"] == len(of[r["doc_id"]]) for r in rows)
