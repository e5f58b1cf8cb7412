import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import token_files  # noqa: E402
from tidemark.llm.data import table  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"file://{tmp_path}/{i}"))
    rows = [[r.asDict() for r in s.collect()] for s in seen]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in table(spark, SF, "labels").collect()}
    ids = [{r["doc_id"] for r in x} for x in rows]
    good = [i for i in ids[0] if labels.get(i) == (1, 0)]
    assert sum(i in ids[1] for i in good) > 0.95 * len(good)
    # one of each group: no equal texts are left, and every text that went has a class
    texts = [r["text"] for r in rows[2]]
    assert ids[2] < ids[1] and len(set(texts)) == len(texts)
    # no benchmark window is left
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    wins = {tuple(w[k : k + 10]) for r in table(spark, SF, "benchmark").collect() for w in [words(r["text"])] for k in range(len(w) - 9)}
    dirty = {r["doc_id"] for r in rows[2] for w in [words(r["text"])] if any(tuple(w[k : k + 10]) in wins for k in range(len(w) - 9))}
    assert ids[3] == ids[2] - dirty and dirty
    # sources come near their weights
    sizes, taken = {}, {}
    for src, x in ((sizes, rows[3]), (taken, rows[4])):
        for r in x:
            src[r["source"]] = src.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    total = sum(sizes.values())
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
    open_, target = set(sizes), {}
    left = total
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 3 * sizes[s]}
        if not full:
            break
        target |= {s: 3 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    target |= {s: weights[s] * level for s in open_}
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in sizes)
    # the files hold the ids of all rows of the mix, in its order
    t = Tokenizer.from_file(token_files.vocabulary())
    start, want = 0, []
    for r in rows[4]:
        enc = [*t.encode(r["text"] or "", add_special_tokens=False).ids, token_files.END_ID]
        want.append((r["doc_id"], len(enc), zlib.crc32(np.array(enc, dtype="<u4").tobytes())))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows[5])
    assert sorted(x[1:] for x in got) == sorted(want)
    for s, _, n, _ in got:
        assert s == start
        start += n


def test_one_of_each_group(spark):
    from tidemark.llm import jaccard

    body = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, body, 0), (1, body, 0), (2, body + " tail", 1), (3, "other words here", 2), (None, body, 3), (None, "lonely", 4), (5, "", 5)], "doc_id long, text string, extra int")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in jaccard.representatives(docs).collect())
    assert kept == [(0, "lonely"), (1, body), (3, "other words here"), (5, "")]


def test_stages_bear_nulls_repeats_and_clashing_columns(spark, tmp_path):
    item = " ".join(f"b{i}" for i in range(20))
    tables = {
        "benchmark": spark.createDataFrame([(1, item), (None, None)], "item_id long, text string"),
        "labels": spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, None, 1)], "doc_id long, quality int, toxic int"),
    }
    for name, df in tables.items():
        df.write.parquet(f"file://{tmp_path}/sf/{name}.parquet")
    rows = [(None, item, None, None, 7), (None, "clean text of a document", "fr", "a", 8), (1, "some good words in a row", "en", "a", 1), (1, "some good words in a row", "en", "a", 2), (2, None, None, "b", 3), (3, "", "en", None, 4), (4, "word " * 50_000, "en", "c", 5), (4, "another text, same id", "de", "c", 6)]
    docs = spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), extra, "x") for d, t, lang, s, extra in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, _text string")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, f"file://{tmp_path}/sf")
            path = f"file://{tmp_path}/{empty}/{i}"
            out.write.parquet(path)
            now = spark.read.parquet(path)
            if i < 4:
                assert now.columns == docs.columns
                kept = {(r["doc_id"], r["size"]) for r in now.collect()}
                assert kept <= {(d, e) for d, _, _, _, e in rows}
            if i == 2 and not empty:
                assert (None, 7) not in kept and (None, 8) in kept
        assert (now.count() == 0) == empty
