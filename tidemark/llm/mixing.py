"""Mixing sources to target weights: a time-varying curriculum.

Each source has a weight schedule of its own over curriculum time 0..1, piecewise linear between
knots. Its integral times the source's weight gives the source's share of all words; a share may not pass ``max_repeats`` times the
source's size, and what is above is shared again by weight until none is above (water filling).
Documents of a source stand in a hashed order; cumulative word demand along it, inverted through
the integrated schedule, is each taking's training position, and takings are range-sorted by it.

Prefix sums over a source never gather it in one task: documents fall into ``BUCKETS`` hashed
buckets a source, bucket totals are summed first, and only a bucket is ordered within a task. Plans and
positions are made of narrow rows; :func:`mixed` cuts the positions into parts there and then joins the
texts, which move once where the takings can be broadcast and twice otherwise.

Defined results: null text has size 0; null source is a source of its own, the last; size 0 is
taken 0 times; repeated rows are separate documents; an empty table gives no rows. Columns named
as the added ones are replaced.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.data import table
from tidemark.llm.ordered import boundaries, part_of
from tidemark.llm.storage import narrow_parts, written

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
#: Positions are cut into parts as integers of this unit; takings are broadcast up to so many (48 bytes each).
UNIT, BROADCAST_ROWS = 1 << 52, 1_000_000
CONSTANT = ((0.0, 1.0), (1.0, 1.0))
#: Schedules of the sources by code point, repeating: fading out, constant, fading in; of area 1 each.
SCHEDULES = (((0.0, 2.0), (1.0, 0.0)), CONSTANT, ((0.0, 0.0), (1.0, 2.0)))

Knots = Sequence[tuple[float, float]]


def sized(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def area(knots: Knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def inverse(u: Column, knots: Knots) -> Column:
    """The curriculum time at which the share ``u`` (0..1) of a schedule's area is used up."""
    total, done, out = area(knots), 0.0, F.lit(float(knots[-1][0]))
    cases = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        part = (t1 - t0) * (w0 + w1) / 2
        if part <= 0:
            continue
        need = u * F.lit(total) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        if abs(slope) < 1e-12:
            step = need / F.lit(w0)
        else:  # w0*x + slope*x^2/2 = need, in the form without cancellation
            step = F.when(need > 0, F.try_divide(2 * need, F.lit(float(w0)) + F.sqrt(F.greatest(F.lit(float(w0 * w0)) + 2 * slope * need, F.lit(0.0))))).otherwise(F.lit(0.0))
        done += part
        cases.append((done / total, F.lit(t0) + step))
    for upto, value in reversed(cases):
        out = F.when(u <= F.lit(upto), value).otherwise(out)
    return out


def plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", schedules: Sequence[Knots] = SCHEDULES, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs``, or the columns ``keep`` of it, with ``size``, ``source_size``, ``target``, ``taken`` and the inner columns
    ``_source``, ``_rank`` (of the source by code point, from 0), ``_begin`` (words of the source
    before this document), ``_demand`` (words the source gives) and ``_full`` (whole passes over it).
    Sources by code point weigh ``weights`` times the areas of ``schedules``, both repeating."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "source_size", "target", "taken")]
    base = docs.select(
        *names,
        sized(docs, text).alias("size"),
        F.col(doc_id).alias("_id"),
        F.col(source).alias("_name"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("_source"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("_order"),
        F.xxhash64(text).alias("_text_hash"),
    ).withColumn("_bucket", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    totals = written(base.groupBy("_source", "_bucket").agg(F.sum("size").alias("n"), F.first("_name").alias("name")), "mix-totals", small=True)
    by_source = totals.groupBy("_source").agg(F.sum("n").alias("source_size"), F.first("name", ignorenulls=True).alias("name"))
    # From here to `goals` one row a source.
    turn = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("_rank") % len(values) + 1)
    ranked = by_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("name").asc_nulls_last())) - 1).withColumn("_weight", turn(weights) * turn([area(s) for s in schedules]))
    cap = F.col("source_size") * max_repeats
    fill = Window.orderBy((cap / F.col("_weight")).asc(), F.col("name").asc_nulls_last())
    upto, behind = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(upto), F.lit(0))) / F.sum("_weight").over(behind)
    goals = (
        ranked.withColumn("_level", level)
        .withColumn("_at", F.row_number().over(fill))  # sources that fill up at the same level have an order too
        .withColumn("_fits", F.col("_level") * F.col("_weight") <= cap)
        .withColumn("_level", F.min(F.when(F.col("_fits"), F.struct("_at", "_level"))).over(everything)["_level"])
        .withColumn("target", F.when(F.col("_level").isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), F.col("_weight") * F.col("_level"))))
        .select("_source", "_rank", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("_demand"))
    )
    before = totals.select("_source", "_bucket", F.coalesce(F.sum("n").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    starts = before.join(goals, "_source")
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", "_id", "size", "_text_hash").rowsBetween(Window.unboundedPreceding, -1)
    begun = base.join(starts, ["_source", "_bucket"]).withColumn("_begin", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    full = F.expr("if(source_size = 0, 0L, _demand div source_size)")
    rest = F.col("_demand") - F.col("_full") * F.col("source_size")
    part = F.greatest(F.least(rest - F.col("_begin"), F.col("size")), F.lit(0))
    return begun.withColumn("_full", full).withColumn("taken", F.col("_full") * F.col("size") + part).select(*names, "size", "source_size", "target", "taken", "_source", "_rank", "_begin", "_demand", "_full")


def placed(planned: DataFrame, schedules: Sequence[Knots] = SCHEDULES) -> DataFrame:
    """One row for each time a document is taken: ``words_taken`` of this taking and its training
    ``position`` 0..1, by the schedule of its source."""
    whole = F.col("taken") - F.col("_full") * F.col("size")
    times = F.col("_full") + (whole > 0).cast("int")
    rows = planned.filter(F.col("taken") > 0).withColumn("_pass", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
    share = F.least((F.col("_pass") * F.col("source_size") + F.col("_begin")) / F.col("_demand"), F.lit(1.0))
    position = inverse(share, schedules[-1])
    for i in reversed(range(len(schedules) - 1)):
        position = F.when(F.col("_rank") % len(schedules) == i, inverse(share, schedules[i])).otherwise(position)
    return rows.withColumn("words_taken", F.when(F.col("_pass") < F.col("_full"), F.col("size")).otherwise(whole)).withColumn("position", position)


def takings(planned: DataFrame, schedule: Knots | None = None, *, schedules: Sequence[Knots] = SCHEDULES) -> DataFrame:
    """:func:`placed`, sorted by position across partitions. ``schedule``: one for all sources."""
    rows = placed(planned, [schedule] if schedule else schedules)
    parts = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "position").sortWithinPartitions("position")


def cut(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), 0), F.lit(1), words.cast("int")), "")


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, once for each taking, in training order over partitions and within them. A
    taking that ends within a document has its text cut there (and ``n_chars``, where there is such a
    column, set to what is left). Rows that agree in all columns are one text with the takings of all."""
    spark = docs.sparkSession
    names = [f"_doc_{c}" for c in docs.columns]
    inner = docs.toDF(*names)
    key = [F.xxhash64(*names).alias("_k1"), F.xxhash64(F.lit(1), *names).alias("_k2")]
    inner = inner.select(*key, *names)
    planned = plan(inner, doc_id=f"_doc_{doc_id}", text=f"_doc_{text}", source=f"_doc_{source}", keep=["_k1", "_k2"])
    fixed = F.floor(F.col("position") * F.lit(float(UNIT))).cast("long")
    rows = written(placed(planned).select("_k1", "_k2", "size", "words_taken", "position", fixed.alias("_at")), "takings", small=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = boundaries(rows, "_at", parts)
    rows = rows.withColumn("_part", part_of(F.col("_at"), cuts)).drop("_at")
    several = not rows.groupBy("_k1", "_k2").agg(F.count("*").alias("n"), F.count_distinct("position").alias("m")).filter("n > m").isEmpty()
    several = several or not inner.groupBy("_k1", "_k2").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    texts = inner.dropDuplicates(["_k1", "_k2"]) if several else inner
    takings_ = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    out = texts.join(takings_, ["_k1", "_k2"]).repartitionById(len(cuts) + 1, "_part").sortWithinPartitions("_part", "position", "_k1", "_k2")
    partly = F.col("words_taken") < F.col("size")
    body = f"_doc_{text}"
    out = out.withColumn(body, F.when(partly, cut(F.col(body), F.col("words_taken"))).otherwise(F.col(body)))
    if n_chars in docs.columns:
        out = out.withColumn(f"_doc_{n_chars}", F.when(partly, F.char_length(body)).otherwise(F.col(f"_doc_{n_chars}")).cast(docs.schema[n_chars].dataType))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, with the words of all its takings and its first training position, in the
    order of these; documents that are never taken have none and come last."""
    names = ["doc_id", "size", "source_size", "target"]
    planned = written(plan(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(*names, "taken", "_source", "_rank", "_begin", "_demand", "_full"), "mix-plan", small=True)
    # documents that are taken have words, so that no two of a source begin at the same one
    first = [F.first(c).alias(c) for c in names]
    taken = placed(planned).groupBy("_source", "_begin").agg(*first, F.sum("words_taken").alias("taken"), F.min("position").alias("first_position"))
    rows = taken.select(*names, "taken", "first_position").unionByName(planned.filter("taken = 0").select(*names, "taken", F.lit(None).cast("double").alias("first_position")))
    never = 2 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))  # dealt over tasks
    rows = rows.withColumn("_order", F.coalesce("first_position", never))
    return rows.repartitionByRange(narrow_parts(spark), "_order").sortWithinPartitions("_order").drop("_order")


OP7_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS skey, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents),
src AS (SELECT skey, any_value(source) AS name, sum(size)::BIGINT AS source_size FROM base GROUP BY skey),
ranked AS (SELECT *, (rank + 1)::DOUBLE AS w FROM (SELECT *, (row_number() OVER (ORDER BY name NULLS LAST) - 1) % 3 AS rank FROM src)),
filled AS (
  SELECT *, source_size * 3 AS cap,
    (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked WINDOW f AS (ORDER BY source_size * 3 / w, name NULLS LAST)),
lvl AS (SELECT arg_min(level, cap / w) AS level FROM filled WHERE level * w <= cap),
goals AS (
  SELECT skey, rank, source_size, CASE WHEN lvl.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, w * lvl.level) END AS target
  FROM filled, lvl),
begun AS (
  SELECT b.doc_id, b.size, g.source_size, g.target, g.rank, floor(g.target + 0.5)::BIGINT AS demand,
    coalesce(sum(b.size) OVER (PARTITION BY b.skey ORDER BY b.ord, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS beg
  FROM base b JOIN goals g USING (skey)),
took AS (
  SELECT *, (CASE WHEN source_size = 0 THEN 0 ELSE (demand // source_size) * size
     + greatest(least(demand - (demand // source_size) * source_size - beg, size), 0) END)::BIGINT AS taken,
     CASE WHEN demand > 0 THEN least(beg::DOUBLE / demand::DOUBLE, 1.0::DOUBLE) END AS share
  FROM begun)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken = 0 THEN NULL WHEN rank = 1 THEN share WHEN share = 0 THEN 0.0::DOUBLE
    WHEN rank = 0 THEN 2.0::DOUBLE * share / (2.0::DOUBLE + sqrt(greatest(4.0::DOUBLE - 4.0::DOUBLE * share, 0.0::DOUBLE)))
    ELSE 2.0::DOUBLE * share / sqrt(greatest(4.0::DOUBLE * share, 0.0::DOUBLE)) END AS first_position
FROM took
"""
