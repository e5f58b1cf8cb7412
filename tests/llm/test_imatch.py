import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import imatch, kernels
from tidemark.llm.data import table

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def term_hash(words):
    out = {}
    for w in words:
        h = kernels.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0]
        out[int(h[0])] = w
    return out


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_lexicon_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(imatch, "MOST_CANDIDATES", most)
    docs = table(spark, SF, "documents")
    n, df = 0, Counter()
    for r in docs.collect():
        n += 1
        df.update(set(WORD.findall(bytes(kernels.LOWER[np.frombuffer(r["text"].encode(), np.uint8)]))))
    want = {w for w, c in df.items() if imatch.LOW * n <= c <= imatch.HIGH * n}
    terms, count = imatch.lexicon(docs.repartition(5))
    assert count == n and set(term_hash(want)) == set(terms.tolist())


def test_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect())
    rows = {r["doc_id"]: r for r in imatch.op8_imatch(spark, SF).collect()}
    assert len(rows) == len(docs)
    by_text = {}
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        k = len(t) // 4
        edited = t[: len(t) - k] + u[:k]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.35 > 0.1 > np.mean([r["near_next"] for r in rows.values()])
    for (i, _), (j, _) in zip(docs, docs[1:] + docs[:1], strict=True):
        a, b = (np.array([0 if x == "-" else int(x, 16) for x in rows[q]["fingerprint"].split(",")]) for q in (i, j))
        assert rows[i]["near_next"] == pytest.approx(imatch.likeness(a[None], b[None])[0])


def test_defined_cases(spark):
    rows = [(None, "solo text"), (1, None), (1, "same words same"), (1, "same words same"), (2, ""), (9, "é " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_chars int")
    got = imatch.compared(docs).collect()
    assert len(got) == 6 and all(0 <= r["near_edited"] <= 1 for r in got)
    same = [r["fingerprint"] for r in got if r["n_chars"] == 15]
    assert len(same) == 2 and len(set(same)) == 1
    one = imatch.compared(docs.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert imatch.compared(docs.limit(0)).count() == 0


def test_order_of_words_does_not_matter():
    data = lambda *t: kernels.buffers(pa.array([x.encode() for x in t], pa.large_binary()))
    h, _, _, first = kernels.word_hashes(*data("b a c a", "c b a", "d"))
    prints = imatch.fingerprints(h, first, np.sort(np.unique(h)), 16, (2,))
    assert (prints[0] == prints[1]).all() and (prints[0] != prints[2]).any()


BASE, WRAP = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1


def mixed(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & WRAP
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & WRAP
    return h ^ h >> 31


def plain_print(words, band):
    """A fingerprint by the definition, in plain integers."""
    every = sorted({mixed(sum((b + 1) * pow(BASE, k, 1 << 64) for k, b in enumerate(w)) & WRAP) for w in words})
    hashed = lambda terms: mixed(sum(x * pow(BASE, k, 1 << 64) for k, x in enumerate(terms)) & WRAP) >> 32
    out = []
    for k in range(imatch.SUBSETS):
        rate = imatch.RATES[k % len(imatch.RATES)]
        coins = [mixed(h ^ (0xA5A5A5A5A5A5A5A5 + k * 0x9E3779B97F4A7C15 & WRAP)) for h in every if h in band]
        inside = [c for c in coins if c >> 40 < (1 << 24) // rate]
        kept = inside and (len(inside) <= imatch.MOST or rate == imatch.RATES[-1])
        out.append(max(hashed([mixed(c) for c in inside]), 1) if kept else 0)
    if not any(out) and every:
        out = [max(hashed([mixed(h) for h in every]), 1)] * imatch.SUBSETS
    return ",".join(f"{v:08x}" if v else "-" for v in out)


def test_whole_result_in_plain_integers(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"] or "") for r in table(spark, sf, "documents").collect())
    words = lambda t: WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()))
    df = Counter(w for _, t in docs for w in set(words(t)))
    hash_of = {w: mixed(sum((b + 1) * pow(BASE, k, 1 << 64) for k, b in enumerate(w)) & WRAP) for w in df}
    band = {hash_of[w] for w, c in df.items() if imatch.LOW * len(docs) <= c <= imatch.HIGH * len(docs)}
    rows = {r["doc_id"]: r for r in imatch.op8_imatch(spark, sf).collect()}
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        k = len(t) // 4
        edited = t[: len(t) - k] + u[:k]
        a, b, c = (plain_print(words(x), band) for x in (t, edited, u))
        like = lambda x, y: (lambda p: sum(v == w for v, w in p) / len(p) if p else 1.0)([(v, w) for v, w in zip(x.split(","), y.split(","), strict=True) if (v, w) != ("-", "-")])
        assert (rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (a, b)
        assert rows[i]["near_edited"] == pytest.approx(like(a, b)) and rows[i]["near_next"] == pytest.approx(like(a, c))


def test_short_and_long_texts_are_told(spark):
    """Edited copies of texts of all lengths are alike, other texts are not."""
    rows = imatch.op8_imatch(spark, "/root/testdata/sf0.1").collect()
    for low, high in ((60, 200), (200, 2000), (2000, 8000), (8000, 20_000), (20_000, 1 << 30)):
        of = [r for r in rows if low <= r["n_chars"] < high]
        near, none, other = np.mean([r["near_edited"] for r in of]), np.mean([r["near_edited"] == 0 for r in of]), np.mean([r["near_next"] for r in of])
        print(f"{low} to {high} characters: {len(of)} texts, near_edited {near:.2f}, of which 0 {none:.2f}, near_next {other:.3f}")
        assert near > 0.25 and none < 0.15 and other < 0.1


def test_lexicons_too_large_are_refused(spark, monkeypatch):
    monkeypatch.setattr(imatch, "MOST_TERMS", 10)
    with pytest.raises(ValueError, match="distinct terms"):
        imatch.op8_imatch(spark, "/root/testdata/sf0.001")
