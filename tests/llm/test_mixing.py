import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.data import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(1, 2, 3), most=3):
    """By resharing the excess until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= full
    return out


def check(rows, planned):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want, taken = targets(sizes), {}
    assert len(planned) == len(rows)
    for r in planned:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12, abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


def test_against_resharing(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 10, 200])), rnd.choice(["a", "b", "b", "b", "é", "Z", None])) for i in range(120)] + [(5, None, "tiny"), (6, "x", "tiny"), (6, "x", "tiny"), (None, "y z", "void")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    first = mixing.plan(docs).collect()
    check(rows, first)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, first)) == sorted(map(key, mixing.plan(docs.repartition(7)).collect()))


def test_empty_sources_and_tables(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.plan(docs).collect()] == [0, 0]
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.takings(mixing.plan(docs.limit(0))).count() == 0


@pytest.mark.parametrize("knots", [[(0, 1), (1, 1)], [(0, 0), (1, 2)], [(0, 2), (0.5, 0), (1, 2)], [(0, 1), (0.25, 1), (1, 4)]])
def test_inverse_of_the_integral(spark, knots):
    u = [i / 50 for i in range(51)]
    got = [r["t"] for r in spark.createDataFrame([(x,) for x in u], "u double").select(mixing.inverse(F.col("u"), knots).alias("t")).collect()]

    def integral(t):
        total = 0.0
        for (a, x), (b, y) in zip(knots, knots[1:]):
            if t > a:
                end = min(t, b)
                total += (end - a) * (x + x + (y - x) * (end - a) / (b - a)) / 2
        return total / mixing.area(knots)

    assert all(abs(integral(t) - x) < 1e-9 for x, t in zip(u, got)) and got == sorted(got)


def test_takings_follow_the_schedule(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.plan(docs)
    rising = mixing.takings(planned, [(0.0, 0.0), (1.0, 2.0)]).collect()
    assert sum(r["words_taken"] for r in rising) == sum(r["taken"] for r in planned.collect()) == 900
    positions = [r["position"] for r in rising]
    assert positions == sorted(positions) and sum(p > 0.5 for p in positions) / len(positions) == pytest.approx(0.75, abs=0.03)
    assert spark.range(1).select(mixing.cut(F.lit("  a\tb  c d"), F.lit(3))).first()[0] == "  a\tb  c"


def test_each_source_follows_its_own_schedule(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(900)]
    planned = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    taken = mixing.takings(planned).collect()
    early = {s: sum(r["words_taken"] for r in taken if r["source"] == s and r["position"] < 0.5) / sum(r["words_taken"] for r in taken if r["source"] == s) for s in "abc"}
    assert early == pytest.approx({"a": 0.75, "b": 0.5, "c": 0.25}, abs=0.01)
    assert [r["position"] for r in taken] == sorted(r["position"] for r in taken)
    # areas count for each source alone
    steep = [[(0.0, 6.0), (1.0, 0.0)], mixing.CONSTANT, mixing.CONSTANT]
    areas = {r["source"]: r["target"] for r in mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), schedules=steep).collect()}
    assert areas == pytest.approx({"a": 9000 * 3 / 8, "b": 9000 * 2 / 8, "c": 9000 * 3 / 8})


def test_query_is_in_training_order(spark):
    """Documents of sources that fade out come before those of sources that fade in."""
    sf = "/root/testdata/sf0.01"
    source = {r["doc_id"]: r["source"] for r in table(spark, sf, "documents").collect()}
    rank = {s: i for i, s in enumerate(sorted(set(source.values())))}
    order = [rank[source[r["doc_id"]]] % 3 for r in mixing.op7_mixing(spark, sf).collect() if r["taken"]]
    mean = [sum(i for i, k in enumerate(order) if k == x) / order.count(x) for x in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    rows = [{**r.asDict(), "source": docs[r["doc_id"]]["source"]} for r in mixing.op7_mixing(spark, sf).collect()]
    check([(d["doc_id"], d["text"], d["source"]) for d in docs.values()], rows)


def test_mixed_rows(spark, monkeypatch):
    """Takings with their texts: in the order of :func:`takings`, the same whether they are broadcast or
    not; rows that agree in all columns have the takings of all."""
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{rnd.randint(0, 99)}" for _ in range(rnd.choice([0, 1, 7, 30]))), rnd.choice(["a", "b", "c", None]), i) for i in range(60)]
    rows += [(70, "same row twice", "a", 1)] * 3 + [(None, None, "b", 2), (5, "id twice", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    want = sorted((r["doc_id"], r["words_taken"]) for r in mixing.takings(mixing.plan(docs)).collect())
    seen = []
    for most in (mixing.BROADCAST_ROWS, 0):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
        out = mixing.mixed(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted((r["doc_id"], len(WORD.findall(r["text"]))) for r in got) == want
        assert all(r["text"] in {t for d, t, *_ in rows if d == r["doc_id"]} or any((t or "").startswith(r["text"]) for d, t, *_ in rows if d == r["doc_id"]) for r in got)
        seen.append([tuple(r) for r in got])
    assert seen[0] == seen[1]
    rank = {"a": 0, "b": 1, "c": 2, None: 0}
    place = [(i / len(seen[0]), rank[r[2]]) for i, r in enumerate(seen[0])]
    mean = lambda k: sum(p for p, x in place if x == k) / sum(x == k for _, x in place)
    assert mean(0) < mean(2)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_first_positions(spark):
    """Against a walk over each source's takings with the integrated schedules inverted by bisection."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    rows = mixing.op7_mixing(spark, sf).collect()
    names = sorted({d["source"] for d in docs.values()})
    for s in names:
        of = sorted((r for r in rows if docs[r["doc_id"]]["source"] == s and r["taken"]), key=lambda r: __import__("hashlib").md5(str(r["doc_id"]).encode()).hexdigest())
        demand, begin = int(of[0]["target"] + 0.5), 0
        every = sorted((d for d in docs.values() if d["source"] == s), key=lambda d: __import__("hashlib").md5(str(d["doc_id"]).encode()).hexdigest())
        begins = {}
        for d in every:
            begins[d["doc_id"]] = begin
            begin += len(WORD.findall(d["text"] or ""))
        (t0, w0), (t1, w1) = mixing.SCHEDULES[names.index(s) % 3]
        for r in of:
            low, high = 0.0, 1.0
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if w0 * mid + (w1 - w0) * mid * mid / 2 < begins[r["doc_id"]] / demand else (low, mid)
            assert r["first_position"] == pytest.approx(high, abs=1e-7)
    assert all(r["first_position"] is None for r in rows if not r["taken"])
