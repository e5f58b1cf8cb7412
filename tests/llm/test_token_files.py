import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_files as tf
from tidemark.llm.data import table

SF = "/root/testdata/sf0.001"


def brute(rows):
    t = Tokenizer.from_file(tf.vocabulary())
    out, start = [], 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, tf.END_ID]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark):
    got = sorted(map(tuple, tf.op3_token_files(spark, SF).collect()))
    assert got == brute(sorted((r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()))


def test_odd_texts_and_ties(spark):
    rows = [(5, None), (3, ""), (None, "first"), (9, "<|endoftext|> Don't STOP\x1cIT\tÉé é  ǅ İ ΑΣ"), (7, "a" * 5000 + " b"), (7, "a" * 5000 + " b"), (8, "word " * 9000), (10, "Stop. stop, STOP! it's ñÑ, Ñandú. a.b ., x., ǆ, ß. ß2 İstanbul, l'été. e\u0301t, \u0301 ﬁn, Ωω. <|startoftext|>, α\u00b7β, 中文. ｗ, dž.")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")
    folder, shards = tf.encode(docs, tf.vocabulary(), length=64)
    got = [tuple(r) for r in tf.digest(spark, folder, shards).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=lambda r: r[1]) == brute(sorted(rows, key=key))
    shard = tf.Shard(folder, shards[-1]["shard"])
    assert len(shard.sequence(0)) == 64 and shard.sequence(0).base is not None
    n = shards[-1]["n_tokens"]
    masks = np.concatenate([np.array(shard.mask(i).to_pylist()) for i in range(-(-n // 64))])
    assert masks[:n].all() and not masks[n:].any()


def test_frequent_pieces_outlive_a_full_cache(monkeypatch):
    """Pieces of every text are encoded once, however many rare ones come between; the ids stay right."""
    monkeypatch.setattr(tf, "CACHE_PIECES", 60)
    often = ["Often", "seen,", "words.", "42", "a-b"]
    texts = [" ".join([*often, *(f"{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + j)}q" for j in range(20))]) for i in range(200)]
    encoder, encoded = tf.Encoder(tf.vocabulary()), []
    plain, words = encoder._encode, encoder._encode_words
    monkeypatch.setattr(encoder, "_encode", lambda some: encoded.extend(some) or plain(some))
    monkeypatch.setattr(encoder, "_encode_words", lambda some: encoded.extend(some) or words(some))
    got, kept = [], 0
    for t in texts:
        got += encoder.encode([t])
        kept = max(kept, len(encoder.cache) + len(encoder.old))
    t = Tokenizer.from_file(tf.vocabulary())
    assert got == [np.array(t.encode(x, add_special_tokens=False).ids, dtype=encoder.dtype).tobytes() for x in texts]
    assert all(encoded.count(w) <= 1 for w in ["often", "seen", "words", "42", "a-b"])
    assert kept < 4 * 60


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tf.digest(spark, *tf.encode(docs, tf.vocabulary())).count() == 0


@pytest.mark.parametrize("cuts", [[], [5], [1, 4, 9, 12, 30]])
def test_parts(spark, cuts):
    from pyspark.sql import functions as F

    from tidemark.llm.ordered import part_of

    df = spark.createDataFrame([(i,) for i in [None, *range(-3, 40)]], "i int").select("i", part_of(F.col("i"), cuts).alias("p"))
    assert all(r["p"] == (0 if r["i"] is None else sum(c <= r["i"] for c in cuts)) for r in df.collect())


def test_file_order(spark, tmp_path, monkeypatch):
    """Rows keep the order of their files and within them, however many files make a shard; rows without
    files have no order."""
    for k in range(5):
        spark.createDataFrame([(100 - 10 * k - i, f"text {k} {i}") for i in range(4)], "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/in/part={k}")
    docs = spark.read.parquet(*[f"file://{tmp_path}/in/part={k}" for k in range(5)])
    want = brute([(100 - 10 * k - i, f"text {k} {i}") for k in range(5) for i in range(4)])
    for most in (tf.MOST_PARTS, 2):
        monkeypatch.setattr(tf, "MOST_PARTS", most)
        folder, shards = tf.encode_in_file_order(docs, tf.vocabulary())
        assert len(shards) == min(5, most)
        assert sorted(map(tuple, tf.digest(spark, folder, shards).collect()), key=lambda r: r[1]) == want
    with pytest.raises(ValueError):
        tf.encode_in_file_order(spark.createDataFrame([(1, "x")], "doc_id long, text string"), tf.vocabulary())
    assert tf.encode_in_file_order(spark.createDataFrame([], "doc_id long, text string"), tf.vocabulary())[1] == []
