"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words; each run of ``K`` words is hashed; of every ``WINDOW - K + 1`` runs in a row
the smallest hash is kept, on both sides. Two texts that share ``WINDOW`` words share that window's
smallest hash, so joining the kept hashes misses no shared span. Each hit is compared word by word
and extended both ways by up to ``WINDOW - K`` words; where the common run reaches ``WINDOW``
words, its document words are hit. Items of fewer words than ``WINDOW`` are one window each: their
whole hash is looked up at every document position, in the same pass.

The document side is read once and never shuffled with its text: hashes are looked up in a
broadcast table while that table has at most ``BROADCAST_ROWS`` rows, and in a shuffled join that
carries 15 words a row beyond it. Only hits (and one row a document) are grouped.

Defined results: null and empty texts have no words; a null ``item_id`` counts as ''; rows repeated
in ``documents`` stay repeated; items with one text are all named; an empty benchmark hits nothing.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.data import table

WINDOW = 10
K = 5
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def runs(hashes: str, k: int) -> Column:
    """Hash of each run of k words; ``hashes`` is the column of word hashes."""
    h = F.col(hashes)
    every = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
    return F.slice(every, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0)))


def window_minima(df: DataFrame, column: str, w: int, to: str) -> DataFrame:
    """Minimum of each full window of w values, by doubling."""
    size, names = 1, {1: column}
    low = lambda a, b, by: F.zip_with(F.col(a), F.slice(F.col(b), F.lit(by + 1), F.greatest(F.size(b), F.lit(1))), lambda x, y: F.least(x, y))
    while size * 2 <= w:
        names[size * 2] = f"_min{size * 2}"
        df = df.withColumn(names[size * 2], low(names[size], names[size], size))
        size *= 2
    last, rest = names[size], w - size
    if rest:
        df = df.withColumn(to, low(last, last, rest))
    else:
        df = df.withColumn(to, F.col(last))
    return df.withColumn(to, F.slice(F.col(to), F.lit(1), F.greatest(F.size(column) - (w - 1), F.lit(0)))).drop(*[n for s, n in names.items() if s > 1])


def _salted(hashes: Column, n: int) -> Column:
    """Hashes of runs of n words, apart from those of other lengths."""
    return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(n)))


def winnowed(df: DataFrame, keep: list[str], k: int, window: int, short: Sequence[int] = (), sentinel: bool = False) -> DataFrame:
    """One row (``_at``, ``_hash``, ``_len`` 0) for each run that is smallest in a full window, and for
    each run of ``_len`` words, of the lengths in ``short``; ``df`` has the words in ``_words``. With
    ``sentinel`` each input row also gives one with ``_at`` -1."""
    w = window - k + 1
    df = df.withColumn("_wh", F.transform("_words", lambda x: F.xxhash64(x))).withColumn("_runs", runs("_wh", k))
    df = window_minima(df, "_runs", w, "_least")
    first = F.array(F.lit(None).cast("long")) if sentinel else F.slice(F.col("_runs"), F.lit(1), F.lit(0))
    more = [_salted(runs("_wh", n), n) for n in short]
    rows = df.select(*keep, "_words", "_least", F.posexplode(F.concat(first, F.col("_runs"), *more)).alias("_at", "_hash"))
    # the runs of each length stand behind those of the lengths before
    begin, at, length = F.greatest(F.size("_words") - (k - 1), F.lit(0)) + int(sentinel), F.col("_at") - int(sentinel), F.lit(0)
    for n in short:
        at, length = F.when(F.col("_at") >= begin, F.col("_at") - begin).otherwise(at), F.when(F.col("_at") >= begin, n).otherwise(length)
        begin = begin + F.greatest(F.size("_words") - (n - 1), F.lit(0))
    rows = rows.select(*keep, "_words", "_least", "_hash", at.alias("_at"), length.alias("_len"))
    smallest = F.greatest(*[F.get(F.col("_least"), F.col("_at") - j) for j in range(w)])
    return rows.filter((F.col("_at") == -1) | (F.col("_len") > 0) | (F.col("_hash") == smallest)).drop("_least")


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """One row for each distinct word sequence of the benchmark: ``_iwords`` and all its ids."""
    named = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("_id"), words(F.col(text)).alias("_iwords"))
    return named.filter(F.size("_iwords") > 0).groupBy("_iwords").agg(F.array_sort(F.collect_set("_id")).alias("_ids"))


def _around(array: str, at: Column, reach: int, k: int) -> Column:
    begin = F.greatest(at - reach, F.lit(0))
    return F.slice(F.col(array), begin + 1, at - begin + k + reach)


def hits(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, the columns in ``keep``, ``n_words``, ``spans`` (hit word
    ranges, sorted, not merged), ``items`` (ids, sorted as strings)."""
    spark = docs.sparkSession
    items = _items(benchmark, item_id, item_text).cache()
    try:
        short = sorted(r[0] for r in items.filter(F.size("_iwords") < window).select(F.size("_iwords")).distinct().collect())  # at most window-1 rows
        n_words = items.agg(F.sum(F.size("_iwords"))).first()[0] or 0
        small = n_words <= BROADCAST_ROWS
    finally:
        items.unpersist()
    hint = F.broadcast if small else (lambda x: x)
    base = docs.select(F.col(doc_id).alias("_doc"), F.struct(*[F.col(c) for c in keep]).alias("_kept") if keep else F.lit(0).alias("_kept"), F.xxhash64(F.col(text)).alias("_text_hash"), words(F.col(text)).alias("_words"))
    base = base.withColumn("_n", F.size("_words"))
    key = ["_doc", "_text_hash", "_n", "_kept"]
    reach = window - k

    prints = winnowed(items.filter(F.size("_iwords") >= window).withColumnRenamed("_iwords", "_words"), ["_ids"], k, window)
    prints = prints.select("_hash", "_ids", _around("_words", F.col("_at"), reach, k).alias("_iwords"), F.least(F.col("_at"), F.lit(reach)).alias("_iat"))
    for n in short:
        whole = items.filter(F.size("_iwords") == n).withColumn("_wh", F.transform("_iwords", lambda x: F.xxhash64(x)))
        prints = prints.unionByName(whole.select(F.xxhash64(F.element_at(runs("_wh", n), 1), F.lit(n)).alias("_hash"), "_ids", "_iwords", F.lit(0).alias("_iat")))
    rows = winnowed(base, key, k, window, short, sentinel=True)
    near = F.when(F.col("_len") > 0, F.slice("_words", F.greatest(F.col("_at"), F.lit(0)) + 1, F.greatest(F.col("_len"), F.lit(1)))).otherwise(_around("_words", F.col("_at"), reach, k))
    context = rows.withColumn("_near", near).drop("_words")
    # The sentinel has no hash, finds nothing and stands for its document.
    found = context.join(hint(prints), "_hash", "left").filter(F.col("_ids").isNotNull() | (F.col("_at") == -1))
    near_at = F.greatest(F.least(F.col("_at"), F.lit(reach)), F.lit(0))
    same = lambda j: F.get("_near", near_at + j) == F.get("_iwords", F.col("_iat") + j)
    step = lambda sign, base_: F.aggregate(F.sequence(F.lit(1), F.lit(reach)), F.lit(0), lambda n, j: F.when((n == j - 1) & F.coalesce(same(j * sign + base_), F.lit(False)), j).otherwise(n))
    equal = F.slice(F.col("_near"), near_at + 1, F.lit(k)) == F.slice(F.col("_iwords"), F.col("_iat") + 1, F.lit(k))
    run = (F.col("_at") >= 0) & (F.col("_len") == 0)
    found = found.withColumn("_left", F.when(run, step(-1, 0))).withColumn("_right", F.when(run, step(1, k - 1)))
    whole = F.struct(F.col("_at").alias("s"), (F.col("_at") + F.col("_len")).alias("e"))
    span = F.when(F.col("_len") > 0, whole).otherwise(F.struct((F.col("_at") - F.col("_left")).alias("s"), (F.col("_at") + k + F.col("_right")).alias("e")))
    hit = F.coalesce(F.when(F.col("_len") > 0, F.col("_near") == F.col("_iwords")).otherwise(equal & (F.col("_left") + F.col("_right") + k >= window)), F.lit(False))
    everything = found.select(*key, (F.col("_at") == -1).cast("int").alias("_row"), F.when(hit, span).alias("_span"), F.when(hit, F.col("_ids")).alias("_ids"))
    grouped = everything.groupBy(*key).agg(F.sum("_row").alias("_copies"), F.array_sort(F.collect_set("_span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_ids")))).alias("items"))
    grouped = grouped.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return grouped.select(F.col("_doc").alias(doc_id), *[F.col("_kept")[c].alias(c) for c in keep], F.col("_n").cast("long").alias("n_words"), "spans", "items")


def covered(spans: Column) -> Column:
    """Number of words in the union of sorted ranges."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(spans, zero, lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], x["e"]).alias("upto")), lambda a: a["n"])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", covered(F.col("spans")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT item_id, least(len(w), 10) AS n, list_aggregate(w[p:p + least(len(w), 10) - 1], 'string_agg', ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, p, list_aggregate(w[p:p + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
