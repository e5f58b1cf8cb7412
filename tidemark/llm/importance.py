"""Quality by importance resampling: hashed n-gram models of target and raw text.

Words and punctuation runs, and pairs of them, are hashed into ``2**BITS`` buckets (all pairs of a
token with itself into one). One bag model counts the raw text (all documents), one the target text
(labelled good). A document's importance is the log ratio of the two, summed over its n-grams and,
beyond ``SPAN`` of them, scaled to ``SPAN``; adding ``PRIOR`` to counts of equal scale makes buckets
with little evidence neutral. Keys importance + Gumbel noise, and the k largest are kept: a sample
without replacement in proportion to the importance ratio.

The good documents with the least hashed ids, ``MOST_LABELLED`` at most, are split in two: one half
is the target text, and of the other all but the share ``LOSS`` must reach the cut. By default k is
the number of documents that reach it.

A few words make a document toxic, so toxicity is not summed over all: a second ratio compares, for
each bucket, the share of toxic labelled documents that hold it with that of good ones, and a
document's toxicity is the sum of its ``TELLING`` largest positive ratios. Documents beyond what all
held-out good ones but the share ``LOSS`` stay within have no key and are never kept. The raw model counts every document. Counts are added up
within each task before they meet; the driver holds one model of fixed size and bounds.

Defined results: texts without n-grams have importance 0; null ids and repeated rows are kept or
left like others (equal rows together); no labels, or an empty table, keep everything;
no toxic or no held-out good label, no document is toxic. :func:`scored` adds columns whose names begin with
an underscore; :func:`resample` takes columns of any name.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm import kernels as K
from tidemark.llm.data import table
from tidemark.llm.storage import written

BITS = 20
PRIOR = 10.0
SPAN = 100
LOSS = 0.002
UNIT = 1 << 20
MOST_LABELLED = 20_000
TELLING = 3

CLASS = np.where(K.IS_WORD[K.LOWER], 1, 2).astype(np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = 0


def ngrams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the texts, and for each text the index of its first (n+1 entries);
    a text's n-grams are its single tokens and, behind them, its pairs."""
    n = len(data)
    kind = CLASS[data]
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    some = kind[starts] > 0 if n else np.zeros(0, dtype=bool)
    starts, ends = starts[some], ends[some]
    sums = K.prefix_sums(K.LOWER[data])
    h = K.mix((sums[ends] - sums[starts]) * K.powers(K.BASE_INV, n + 1)[starts])
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pair = text[:-1] == text[1:] if len(text) else np.zeros(0, dtype=bool)
    pairs = K.mix(h[:-1] * K.U64(3) + h[1:] * K.U64(K.BASE))[pair] if len(h) else h
    if len(h):
        pairs[(h[:-1] == h[1:])[pair]] = K.U64(K.BASE)
    both = np.concatenate([h, pairs]) >> K.U64(64 - bits)
    of = np.concatenate([text, text[:-1][pair] if len(text) else text])
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=len(offsets) - 1) if len(of) else np.zeros(len(offsets) - 1, dtype=np.int64)
    return both[order].astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, good, toxic -> bucket, raw count, target count, good documents and toxic documents
    that hold it, of this task; bucket ``2**BITS`` counts the labelled documents."""
    every = 1 << BITS
    raw, target, *holding = (np.zeros(every + 1, dtype=np.int64) for _ in range(4))
    for batch in batches:
        data, offsets = K.buffers(batch.column(0))
        good, toxic = (batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (1, 2))
        for a, b, part, off in K.chunks(data, offsets):
            grams, first = ngrams(part, off)
            raw += np.bincount(grams, minlength=every + 1)
            text = np.repeat(np.arange(b - a), np.diff(first))
            chosen = good[a:b][text]
            if chosen.any():
                target += np.bincount(grams[chosen], minlength=every + 1)
            for docs, marks in zip(holding, (good[a:b], toxic[a:b]), strict=True):
                if marks.any():
                    of = marks[text]
                    docs += np.bincount(np.unique(text[of] << BITS | grams[of]) & (every - 1), minlength=every + 1)
                    docs[every] += marks.sum()
    at = np.append(np.flatnonzero(raw), every)
    yield pa.record_batch([pa.array(at), *[pa.array(x[at]) for x in (raw, target, *holding)]], names=["bucket", "raw", "target", "good", "toxic"])


def _good(labels: DataFrame) -> DataFrame:
    """Ids (``_id``) of good documents, at most ``MOST_LABELLED``, in two halves."""
    return _labelled(labels, (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))


def _labelled(labels: DataFrame, which: Column) -> DataFrame:
    ids = labels.filter(which & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    return ids.orderBy(F.xxhash64("_id"), "_id").limit(MOST_LABELLED).withColumn("half", (F.row_number().over(Window.orderBy(F.xxhash64("_id"), "_id")) - 1) % 2)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray | None, np.ndarray | None]:
    """The log ratio of each bucket, target to raw and toxic to good, in units of 1/``UNIT``; None
    where no labelled document is good, or toxic. In integers, so that sums do not depend on how rows
    are batched."""
    mark = lambda of, good, toxic: of.select("_id", F.lit(good).alias("_good"), F.lit(toxic).alias("_toxic"))
    known = mark(_good(labels).filter("half = 0"), True, False).unionByName(mark(_labelled(labels, F.col("toxic") == 1), False, True)).groupBy("_id").agg(F.max("_good").alias("_good"), F.max("_toxic").alias("_toxic"))
    marked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id", "left")
    rows = marked.select("_text", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("_good", "_toxic")]).mapInArrow(_counts, "bucket long, raw long, target long, good long, toxic long")
    names = ("raw", "target", "good", "toxic")
    found = written(rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]), "ngram-model").toArrow()  # at most 2**BITS rows and one
    at = found.column("bucket").to_numpy()
    counts = np.zeros((4, (1 << BITS) + 1))
    for i, c in enumerate(names):
        counts[i, at] = found.column(c).to_numpy()
    (raw, target, good, toxic), (_, _, n_good, n_toxic) = counts[:, :-1], counts[:, -1]
    if not target.sum():
        return None, None
    units = lambda ratio: np.rint(np.log(ratio) * UNIT).astype(np.int64)
    model = units((target + PRIOR) / (raw * (target.sum() / raw.sum()) + PRIOR))
    return model, units((toxic + 1) / (good * (n_toxic / n_good) + 1)) if n_toxic else None


def _toxicity(ratio: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text the sum of the ``TELLING`` largest positive ratios of different n-grams."""
    n = len(first) - 1
    telling = ratio[grams] > 0
    pair = np.unique(np.repeat(np.arange(n), np.diff(first))[telling] << BITS | grams[telling])
    text, value = pair >> BITS, ratio[pair & ((1 << BITS) - 1)]
    order = np.lexsort((-value, text))
    text, value = text[order], value[order]
    top = np.arange(len(text)) - np.searchsorted(text, text) < TELLING
    return np.bincount(text[top], weights=value[top], minlength=n) / UNIT


def scored(docs: DataFrame, model: np.ndarray, toxic: np.ndarray | None = None, limit: float | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``_importance`` (log ratio of target to raw), ``_n_grams``, ``_toxicity``
    and ``_key``, which is null where toxicity is above ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast((model, toxic))
    width = len(docs.columns)
    schema = T.StructType([*docs.schema, T.StructField("_hash", T.LongType()), T.StructField("_importance", T.DoubleType()), T.StructField("_n_grams", T.LongType()), T.StructField("_toxicity", T.DoubleType())])
    at = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, against = shared.value
        for batch in batches:
            data, offsets = K.buffers(batch.column(at))
            out, n, bad = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            for a, b, part, off in K.chunks(data, offsets):
                grams, first = ngrams(part, off)
                sums = np.concatenate([[0], np.cumsum(ratio[grams])])
                n[a:b] = np.diff(first)
                out[a:b] = (sums[first[1:]] - sums[first[:-1]]) / UNIT * np.minimum(1.0, SPAN / np.maximum(n[a:b], 1))
                if against is not None:
                    bad[a:b] = _toxicity(against, grams, first)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width + 1)], pa.array(out), pa.array(n), pa.array(bad)], names=schema.names)

    rows = docs.withColumn("_hash", F.xxhash64(text)).mapInArrow(score, schema)
    return _within(rows.withColumn("_key", F.col("_importance") + gumbel(F.col(doc_id), F.col("_hash"))), limit)


def _within(scores: DataFrame, limit: float | None) -> DataFrame:
    return scores if limit is None else scores.withColumn("_key", F.when(F.col("_toxicity") <= limit, F.col("_key")))


def gumbel(*seed: Column) -> Column:
    """Standard Gumbel noise that follows from the seed columns alone."""
    u = (F.pmod(F.xxhash64(*seed), F.lit(1 << 53)).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def bound_of_top(df: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a double column, exactly, from counts in 1,024 slots a pass: the
    slot that holds it is cut again until it holds one value. None for no rows or k < 1."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None or k < 1:
        return None
    while low < high:
        step = (high - low) / 1024
        slot = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(step)), F.lit(1023)) if step > 0 else F.col(key)
        rows = df.filter(F.col(key).between(low, high)).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(rows, key=lambda r: r["slot"], reverse=True):
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
        else:
            return low  # fewer rows than k: all
    return low


def marked(docs: DataFrame, labels: DataFrame, k: int | None = None, *, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray | None, DataFrame, float | None]:
    """The model, a narrow table of scores, and the least key that is kept (ties at it are kept)."""
    model, _, _, scores, bound = _marked(docs, labels, k, doc_id=doc_id, text=text)
    return model, scores, bound


def _marked(docs: DataFrame, labels: DataFrame, k: int | None, *, doc_id: str, text: str) -> tuple[np.ndarray | None, np.ndarray | None, float | None, DataFrame, float | None]:
    """As :func:`marked`, with the toxic ratios and the largest toxicity that is kept behind the model."""
    model, toxic = fit(docs, labels, doc_id=doc_id, text=text)
    neutral = np.zeros(1 << BITS, dtype=np.int64)
    scores = scored(docs.select(doc_id, text), neutral if model is None else model, toxic, doc_id=doc_id, text=text).drop(text)
    scores = written(scores, "importance")
    if model is None:
        return None, None, None, scores, None
    held_out = F.broadcast(_good(labels).filter("half = 1").select(F.col("_id").alias(doc_id)))
    cut, limit = scores.join(held_out, doc_id, "left_semi").agg(F.percentile_approx("_importance", LOSS, 100_000), F.percentile_approx("_toxicity", 1 - LOSS, 100_000)).first()
    limit = None if toxic is None else limit
    scores = _within(scores, limit)
    if k is None:
        k = scores.filter((F.col("_importance") >= (0.0 if cut is None else cut)) & F.col("_key").isNotNull()).count()
    return model, toxic, limit, scores, bound_of_top(scores, "_key", k)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` kept by Gumbel top-k. Texts are scored once more rather than shuffled. Columns go by
    place inside, so that none clashes with the scores."""
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {"doc_id": f"c{docs.columns.index(doc_id)}", "text": f"c{docs.columns.index(text)}"}
    model, toxic, limit, _, bound = _marked(inner, labels, k, **at)
    if model is None:
        return docs
    kept = scored(inner, model, toxic, limit, **at)
    return kept.filter(F.lit(False) if bound is None else F.col("_key") >= bound).select(*[F.col(n).alias(c) for n, c in zip(inner.columns, docs.columns, strict=True)])


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept documents with their importance and key."""
    model, scores, bound = marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    kept = scores if model is None else scores.filter(F.lit(False) if bound is None else F.col("_key") >= bound)
    return kept.select("doc_id", F.col("_importance").alias("importance"), F.col("_n_grams").alias("n_grams"), F.col("_key").alias("key"))
