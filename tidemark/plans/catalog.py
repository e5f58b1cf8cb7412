"""Queries over the test tables, one or more for each operator, and the SQL they must agree with."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S
from tidemark import schemas
from tidemark.operators import alerts, dedup, evaluate, lookup, merge, models, monitoring, sampling, temporal
from tidemark.session import shared_folder
from tidemark.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DAY0 = 1704067200.0
GAP = 21600.0
CLASSES = [str(i) for i in range(10)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _detections(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return e.select("event_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("video_name"), F.col("event_type").alias("model_name"), (S.seconds("ts") - F.lit(DAY0)).alias("timestamp_seconds"), F.col("value").alias("confidence"))


def _videos(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer")
    return c.select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("video_name"), (F.lit(1728000.0) + F.col("c_acctbal") * 100).alias("duration_seconds"))


_DET = "det AS (SELECT event_id, 'user_' || user_id AS video_name, event_type AS model_name, epoch_us(ts) / 1e6::DOUBLE - 1704067200 AS timestamp_seconds, value AS confidence FROM events)"
_VID = "vid AS (SELECT 'user_' || c_custkey AS video_name, 1728000.0::DOUBLE + c_acctbal * 100 AS duration_seconds FROM customer)"
_SESSIONS = f"""{_DET}, {_VID},
flagged AS (SELECT d.*, v.duration_seconds, CASE WHEN timestamp_seconds - lag(timestamp_seconds) OVER w > 21600 THEN 1 ELSE 0 END AS starts
  FROM det d JOIN vid v USING (video_name) WHERE confidence >= 5 WINDOW w AS (PARTITION BY video_name, model_name ORDER BY timestamp_seconds)),
sessions AS (SELECT *, sum(starts) OVER (PARTITION BY video_name, model_name ORDER BY timestamp_seconds ROWS UNBOUNDED PRECEDING) AS session FROM flagged),
bounds AS (SELECT video_name, model_name, duration_seconds, min(timestamp_seconds) AS first_ts, max(timestamp_seconds) AS last_ts, count(*) AS n, max(confidence) AS conf FROM sessions GROUP BY video_name, model_name, duration_seconds, session),
intervals AS (SELECT video_name, model_name, round_even(greatest(0.0, first_ts - 3) * 1000, 0) / 1000 AS start_seconds, round_even(least(duration_seconds, last_ts + 7) * 1000, 0) / 1000 AS end_seconds, n::INTEGER AS detection_count, conf AS max_confidence FROM bounds)"""


def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.build_intervals(_detections(spark, sf), _videos(spark, sf), min_confidence=5.0, gap=GAP)


@query(f"WITH {_SESSIONS} SELECT * FROM intervals")
def gap_intervals(spark, sf):
    """P-1 J-1 W-1 A-3 W-2: detections to padded, clamped intervals."""
    return _intervals(spark, sf).select("video_name", "model_name", "start_seconds", "end_seconds", "detection_count", "max_confidence")


@query("SELECT event_id, 'det_' || substr(sha1(event_id::VARCHAR || chr(31) || event_type || chr(31) || user_id::VARCHAR || chr(31)), 1, 16) AS uid FROM events")
def interval_uid(spark, sf):
    """F-1: content-derived ids."""
    return _t(spark, sf, "events").select("event_id", S.make_uid("det", "event_id", "event_type", "user_id").alias("uid"))


def _crops(spark: SparkSession, sf: str) -> DataFrame:
    d = _detections(spark, sf)
    return d.select(F.col("video_name").alias("video_stem"), F.floor(F.col("timestamp_seconds") * 1000).cast("long").alias("ms"), F.col("event_id").alias("name"))


_GROUPS = f"""{_DET}, crops AS (SELECT video_name AS video_stem, floor(timestamp_seconds * 1000)::BIGINT AS ms, event_id AS name FROM det),
flagged AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY video_stem ORDER BY ms, name) > 21600000 THEN 1 ELSE 0 END AS starts FROM crops),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY video_stem ORDER BY ms, name ROWS UNBOUNDED PRECEDING) AS cluster FROM flagged),
groups AS (SELECT *, printf('group_%03d', dense_rank() OVER (ORDER BY video_stem, cluster)) AS group_name, row_number() OVER (PARTITION BY video_stem, cluster ORDER BY ms, name) = 1 AS is_preview FROM numbered)"""


@query(f"WITH {_GROUPS} SELECT name, group_name, is_preview FROM groups")
def crop_groups(spark, sf):
    """W-3 W-4: gap clusters in milliseconds, numbered over all videos; the first is the preview."""
    return temporal.group_crops(_crops(spark, sf), gap_seconds=GAP).select("name", "group_name", "is_preview")


@query(f"WITH {_GROUPS}, sizes AS (SELECT group_name, count(*) AS n FROM groups GROUP BY 1) SELECT min(n) AS min_size, max(n) AS max_size, avg(n) AS avg_size, count(*) AS n_groups FROM sizes")
def group_size_stats(spark, sf):
    """A-6."""
    return temporal.group_size_stats(temporal.group_crops(_crops(spark, sf), gap_seconds=GAP), ["group_name"])


_GRID = f"{_SESSIONS}, grid AS (SELECT video_name, model_name, start_seconds, round_even((start_seconds + i * 600.0::DOUBLE) * 1000, 0) / 1000 AS timestamp_seconds FROM (SELECT *, unnest(generate_series(0, floor((end_seconds - start_seconds + 1e-9) / 600)::BIGINT)) AS i FROM intervals WHERE end_seconds >= start_seconds))"


@query(f"WITH {_GRID} SELECT * FROM grid")
def timestamp_grid(spark, sf):
    """F-3: inclusive grids of timestamps over intervals."""
    return temporal.expand_intervals(_intervals(spark, sf), 600.0).select("video_name", "model_name", "start_seconds", "timestamp_seconds")


@query(f"WITH {_GRID} SELECT DISTINCT video_name || '__ts_' || printf('%010d', round_even(timestamp_seconds * 1000, 0)::BIGINT) || '.jpg' AS frame_name FROM grid")
def frame_names(spark, sf):
    """F-2."""
    grid = temporal.expand_intervals(_intervals(spark, sf), 600.0)
    return grid.select(S.frame_name("video_name", "timestamp_seconds").alias("frame_name")).distinct()


@query(f"""WITH {_GRID}, frames AS (SELECT video_name, min(event_id) AS frame, timestamp_seconds + 1e-6 AS p FROM det GROUP BY video_name, timestamp_seconds)
SELECT g.video_name, g.model_name, g.timestamp_seconds, f.frame FROM grid g ASOF JOIN frames f ON g.video_name = f.video_name AND g.timestamp_seconds <= f.p""")
def frame_edges_asof(spark, sf):
    """J-16 S-8: each target takes the first frame at or after it."""
    targets = temporal.expand_intervals(_intervals(spark, sf), 600.0).select("video_name", "model_name", "timestamp_seconds")
    frames = _detections(spark, sf).groupBy("video_name", F.col("timestamp_seconds").alias("pts")).agg(F.min("event_id").alias("frame"))
    return lookup.forward_asof(targets, frames, "video_name", "timestamp_seconds", "pts", "frame").select("video_name", "model_name", "timestamp_seconds", "frame")


def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select("vec_id", "label", S.sign_bits("embedding").alias("phash"))


_DEDUP = """bits AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0) AS b, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
fold AS (
  SELECT label, n, vec_id, b AS leader, false AS is_duplicate FROM bits WHERE n = 1
  UNION ALL
  SELECT x.label, x.n, x.vec_id, CASE WHEN d.near THEN f.leader ELSE x.b END, d.near
  FROM fold f JOIN bits x ON x.label = f.label AND x.n = f.n + 1,
  LATERAL (SELECT len(list_filter(list_zip(f.leader, x.b), lambda p: p[1] <> p[2])) <= 26 AS near) d)"""


@query(f"WITH RECURSIVE {_DEDUP} SELECT label, vec_id, is_duplicate FROM fold")
def leader_dedup(spark, sf):
    """F-16 W-5: distance to the last kept item of the group."""
    return dedup.leader_dedup(_hashed(spark, sf), "label", ["vec_id"], "phash", "vec_id", 26)


@query(f"WITH RECURSIVE {_DEDUP} SELECT vec_id FROM fold WHERE NOT is_duplicate")
def dedup_keep(spark, sf):
    """P-3 D-10 D-11: flags set anew, and the rows that are no duplicate."""
    h = _hashed(spark, sf)
    return dedup.not_duplicate(dedup.flag_duplicates(h, h, "label", ["vec_id"], "phash", "vec_id", 26)).select("vec_id")


_VOTES = """acc AS (SELECT event_id, user_id, ts, event_type, value / 490 AS conf FROM events WHERE value / 490 >= 0.05),
win AS (SELECT *, list({'name': event_type, 'conf': conf}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) AS w FROM acc),
votes AS (SELECT event_id, user_id, ts, r.name AS name, count(*) AS votes, sum(r.conf ORDER BY pos) AS total, min(pos) AS pos FROM (SELECT *, unnest(w) AS r, generate_subscripts(w, 1) AS pos FROM win WHERE len(w) = 5) GROUP BY event_id, user_id, ts, r.name),
best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY votes DESC, pos) AS k FROM votes),
alerts AS (SELECT event_id, user_id, ts, name, votes, total / votes AS mean_conf FROM best WHERE k = 1 AND votes >= 3 AND total / votes >= 0.05)"""


def _majority(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").withColumn("conf", F.col("value") / 490)
    return alerts.majority_windows(e, ["user_id"], ["ts", "event_id"], "event_type", "conf", least=3, threshold=0.05)


@query(f"WITH {_VOTES} SELECT event_id, name, votes::INTEGER AS votes, round_even(mean_conf * 1e6, 0) / 1e6 AS mean_conf FROM alerts")
def majority_window(spark, sf):
    """W-7 A-12 A-13: a majority of the last five accepted rows."""
    return _majority(spark, sf).select("event_id", F.col("majority_name").alias("name"), "votes", S.rounded("mean_conf", 6).alias("mean_conf"))


@query(f"""WITH RECURSIVE {_VOTES}, line AS (SELECT user_id, name, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM alerts),
fold AS (
  SELECT user_id, n, name, t, true AS fired, name AS last_name, t AS last_t FROM line WHERE n = 1
  UNION ALL
  SELECT l.user_id, l.n, l.name, l.t, f.last_name <> l.name OR l.t >= f.last_t + 172800,
    CASE WHEN f.last_name <> l.name OR l.t >= f.last_t + 172800 THEN l.name ELSE f.last_name END,
    CASE WHEN f.last_name <> l.name OR l.t >= f.last_t + 172800 THEN l.t ELSE f.last_t END
  FROM fold f JOIN line l ON l.user_id = f.user_id AND l.n = f.n + 1)
SELECT user_id, t, name FROM fold WHERE fired""")
def cooldown_alerts(spark, sf):
    """W-8: at most one alert of a name in two days, unless another fired between."""
    m = _majority(spark, sf).select("user_id", S.seconds("ts").alias("t"), F.col("majority_name").alias("name"), "event_id")
    return alerts.cooldown(m, "user_id", "t", "name", 172800.0, ["event_id"])


_THROTTLED = """line AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
fold AS (
  SELECT user_id, event_id, n, true AS processed, t AS last_t FROM line WHERE n = 1
  UNION ALL
  SELECT l.user_id, l.event_id, l.n, l.t - f.last_t >= 7200, CASE WHEN l.t - f.last_t >= 7200 THEN l.t ELSE f.last_t END FROM fold f JOIN line l ON l.user_id = f.user_id AND l.n = f.n + 1)"""


@query(f"WITH RECURSIVE {_THROTTLED} SELECT user_id, event_id FROM fold WHERE processed")
def throttled_frames(spark, sf):
    """T-1: a frame is processed two hours after the last processed one, or later."""
    e = _t(spark, sf, "events").select("user_id", S.seconds("ts").alias("t"), "event_id")
    return alerts.throttle(e, "user_id", "t", 7200.0, ["event_id"]).select("user_id", "event_id")


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream."""
    reader = spark.readStream.schema(_t(spark, sf, "events").schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/events.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf}/events.parquet")
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf)


def _drained(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there; its rows, by way of the shared folder."""
    folder = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        if mode == "append":
            batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        else:
            batch.write.mode("overwrite").parquet(f"{folder}/rows")

    writer = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


@query(ORACLE_SQL["cooldown_alerts"].replace("SELECT user_id, t, name FROM fold", "SELECT user_id::VARCHAR AS source, t AS ts, name FROM fold"))
def stream_alerts(spark, sf):
    """T-1 T-2 T-3: the stateful stream gives what the batch operators give."""
    e = _streamed(spark, sf)
    rows = e.select(F.col("user_id").cast("string").alias("source"), S.seconds("ts").alias("ts"), F.col("event_id").alias("idx"), F.col("event_type").alias("name"), (F.col("value") / 490).alias("conf"))
    out = live.live_alerts(rows, least=3, threshold=0.05, seconds=172800.0)
    return _drained(spark, out, "stream-alerts").select("source", "ts", "name")


@query("""WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT user_id, count(*) AS n, round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e3::DOUBLE, 0)::BIGINT AS length_ms FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    """W-1 as a stream: sessions with a gap of six hours."""
    e = _streamed(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    out = _drained(spark, live.sessions(e, "ts", "user_id", "6 hours"), "stream-sessions", "complete")
    return out.select("user_id", "n", F.bround((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1000).cast("long").alias("length_ms"))


@query("SELECT x.name, x.source, x.value FROM (SELECT event_type, user_id, value, event_id FROM events WHERE value / 490 >= 0.5) e, LATERAL (SELECT 'detected' AS name, user_id::VARCHAR AS source, 1.0::DOUBLE AS value UNION ALL SELECT 'confidence', user_id::VARCHAR, e.value / 490) x")
def detection_samples(spark, sf):
    """T-5 P-14: two metric samples for each accepted prediction."""
    rows = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("name"), (F.col("value") / 490).alias("conf"), "ts").filter("conf >= 0.5")
    return live.detection_metrics(rows).select("name", F.col("labels")["source"].alias("source"), "value")


@query("""WITH todo AS (SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM todo)
SELECT doc_id FROM r WHERE k % greatest(1, n // least(10, n)) = 0 AND k < greatest(1, n // least(10, n)) * least(10, n)""")
def stride_sample(spark, sf):
    """J-13 W-9: ten of the documents without a label, evenly spread."""
    todo = lookup.missing(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels"), ["doc_id"])
    return sampling.stride_sample(todo, ["doc_id"], 10)


@query("SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY vec_id) <= greatest(1, floor(count(*) OVER (PARTITION BY label) * (1 - 0.2::DOUBLE))) THEN 'train' ELSE 'val' END AS split FROM embeddings")
def class_split(spark, sf):
    """W-10."""
    return sampling.class_split(_t(spark, sf, "embeddings").select("vec_id", "label"), "label", ["vec_id"])


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def orphans(spark, sf):
    """J-11: frames without an interval."""
    return lookup.missing(_t(spark, sf, "orders").select("o_orderkey"), _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT count(*) AS n_kept, (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)) AS n_gone FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def prune_keep(spark, sf):
    """D-9: what stays and what goes."""
    frames = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("frame_uid"), F.col("o_orderpriority").alias("frame_path"))
    edges = _t(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("frame_uid"))
    kept, _, gone = merge.prune_orphans(frames, frames.select("frame_uid"), edges)
    return kept.agg(F.count("*").alias("n_kept")).crossJoin(gone.agg(F.count("*").alias("n_gone")))  # one row each


_LAST = "last AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS k FROM lineitem) WHERE k = 1)"
_LINE = ["l_orderkey", "l_linenumber"]


def _last_lines(spark: SparkSession, sf: str) -> DataFrame:
    return merge.latest(_t(spark, sf, "lineitem"), _LINE, ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"])


@query(f"WITH {_LAST} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice > 50000 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_extendedprice FROM last")
def upsert_latest(spark, sf):
    """D-1 D-3 D-5: duplicates reduced to the latest; a subset of columns updated by key."""
    target = _last_lines(spark, sf).select(*_LINE, "l_partkey", "l_quantity", "l_extendedprice")
    source = target.filter("l_extendedprice > 50000").select(*_LINE, (F.col("l_quantity") + 1).alias("l_quantity"), F.lit(0.0).alias("l_extendedprice"))
    return merge.upsert(target, source, _LINE, ["l_quantity"])


@query(f"WITH {_LAST} SELECT l_orderkey, l_linenumber, CASE WHEN EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = last.l_orderkey AND o.l_linenumber = last.l_linenumber AND o.l_returnflag = 'R') THEN 'old' ELSE 'new' END AS origin FROM last")
def insert_ignore(spark, sf):
    """D-6 D-7: what is there stays."""
    old = _t(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(*_LINE).distinct().withColumn("origin", F.lit("old"))
    return merge.insert_ignore(old, _t(spark, sf, "lineitem").select(*_LINE).withColumn("origin", F.lit("new")), _LINE)


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' END, o_orderstatus) AS o_orderstatus FROM orders")
def update_flags(spark, sf):
    """D-10: update by a list of keys."""
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return merge.update_by_key(o, _t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("X").alias("o_orderstatus")), ["o_orderkey"], ["o_orderstatus"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) UNION ALL SELECT o_orderkey, o_custkey, 'R' FROM orders WHERE o_totalprice > 400000")
def replace_part(spark, sf):
    """D-8: delete by key, then insert."""
    o = _t(spark, sf, "orders")
    new = o.filter("o_totalprice > 400000").select("o_orderkey", "o_custkey", F.lit("R").alias("o_orderstatus"))
    return merge.replace_where(o.select("o_orderkey", "o_custkey", "o_orderstatus"), new, ["o_custkey"])


@query("SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def label_join(spark, sf):
    """J-6 J-9 J-10: lookup by name, nulls where there is none."""
    labels = lookup.last_by_name(_t(spark, sf, "labels"), "doc_id", "quality")
    return _t(spark, sf, "documents").select("doc_id", "source").join(labels, "doc_id", "left")


@query("SELECT d.doc_id, coalesce(l.name, 'unknown') AS name FROM documents d LEFT JOIN (SELECT doc_id, CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END AS name FROM labels) l ON l.doc_id = d.doc_id")
def label_default(spark, sf):
    """J-7 J-8: a default where the category is not known."""
    names = _t(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("name"))
    return lookup.with_default(_t(spark, sf, "documents").select("doc_id"), names, "doc_id", "name", "unknown")


@query("""SELECT folder, label FROM (SELECT f.n_name || '_x' AS folder, l.label, row_number() OVER (PARTITION BY f.n_name ORDER BY length(l.label) DESC, l.label) AS k
FROM nation f JOIN (SELECT lower(n_name) AS label FROM nation WHERE n_regionkey < 3) l ON contains(lower(f.n_name || '_x'), lower(l.label))) WHERE k = 1""")
def longest_label_match(spark, sf):
    """J-15."""
    n = _t(spark, sf, "nation")
    return lookup.longest_label(n.select(F.concat("n_name", F.lit("_x")).alias("folder")), "folder", n.filter("n_regionkey < 3").select(F.lower("n_name").alias("label")), "label")


_BOX = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity * 10 AS x, l_discount * 1000 AS y, l_extendedprice / 500 AS w, l_extendedprice / 700 AS h FROM lineitem"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", (F.col("l_quantity") * 10).alias("x"), (F.col("l_discount") * 1000).alias("y"), (F.col("l_extendedprice") / 500).alias("w"), (F.col("l_extendedprice") / 700).alias("h"))


@query(f"SELECT b.l_orderkey, b.l_linenumber, b.l_partkey, o.o_custkey FROM ({_BOX}) b JOIN orders o ON o.o_orderkey = b.l_orderkey WHERE b.x IS NOT NULL AND b.y IS NOT NULL AND b.w IS NOT NULL AND b.h IS NOT NULL AND b.w >= 50 AND b.h >= 50")
def annotation_filter(spark, sf):
    """J-5 P-2 P-8: annotations with a whole box of at least 50."""
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    boxes = _boxes(spark, sf).dropna(subset=["x", "y", "w", "h"]).filter(S.large_enough("w", "h", 50))
    return boxes.join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey")


@query(f"""SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, round_even(x - w * 0.15::DOUBLE, 0)::INTEGER) AS "left", greatest(0, round_even(y - h * 0.15::DOUBLE, 0)::INTEGER) AS top,
least(640, round_even(x + w + w * 0.15::DOUBLE, 0)::INTEGER) AS "right", least(480, round_even(y + h + h * 0.15::DOUBLE, 0)::INTEGER) AS bottom FROM ({_BOX})) WHERE "right" > "left" AND bottom > top""")
def bbox_pad_clip(spark, sf):
    """F-6 F-8 P-9."""
    boxes = _boxes(spark, sf).withColumn("b", S.padded_box("x", "y", "w", "h", 0.15, F.lit(640), F.lit(480)))
    return boxes.filter(S.has_area(F.col("b"))).select("l_orderkey", "l_linenumber", "l_partkey", "b.*")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 37 AS w, l_extendedprice / 31 AS h FROM lineitem), s AS (SELECT *, least(1.0::DOUBLE, 512.0::DOUBLE / greatest(w, h)) AS k FROM d),
r AS (SELECT *, round_even(w * k, 0)::INTEGER AS rw, round_even(h * k, 0)::INTEGER AS rh FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, greatest(2, rw - rw % 2) AS width, greatest(2, rh - rh % 2) AS height FROM r""")
def resize_dims(spark, sf):
    """F-5."""
    li = _t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", S.resize_dims(F.col("l_quantity") * 37, F.col("l_extendedprice") / 31, 512).alias("d")).select("l_orderkey", "l_linenumber", "l_partkey", "d.*")


@query("""WITH n AS (SELECT event_id, 'raw/' || 'video_' || strftime(ts, '%Y%m%d_%H%M%S') || '.mkv' AS path FROM events)
SELECT event_id, strftime(t, '%Y-%m-%d') AS date, strftime(t, '%H:%M:%S') AS time, hour(t)::INTEGER AS hour,
CASE WHEN hour(t) BETWEEN 7 AND 18 THEN 'day' WHEN hour(t) >= 22 OR hour(t) <= 5 THEN 'night' ELSE 'unknown' END AS lighting
FROM (SELECT event_id, strptime(regexp_extract(path, 'video_([0-9]{8}_[0-9]{6})', 1), '%Y%m%d_%H%M%S') AS t FROM n)""")
def filename_parse(spark, sf):
    """F-11 F-12 F-13 S-4: date, time, hour and lighting from a recording's name."""
    e = _t(spark, sf, "events")
    t = S.video_time(F.concat(F.lit("raw/video_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".mkv")))
    return e.select("event_id", t.alias("t")).filter(F.col("t").isNotNull()).select("event_id", F.date_format("t", "yyyy-MM-dd").alias("date"), F.date_format("t", "HH:mm:ss").alias("time"), F.hour("t").alias("hour"), S.lighting(F.hour("t")).alias("lighting"))


@query("""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '.(\\.[^.]*)$', 1)) AS suffix,
CASE WHEN len(string_split(url, '/')) > 1 THEN list_extract(string_split(url, '/'), len(string_split(url, '/')) - 1) END AS parent FROM pages""")
def path_parts(spark, sf):
    """F-14 F-23: basename, stem, suffix, parent folder."""
    return _t(spark, sf, "pages").select("page_id", S.basename("url").alias("base"), S.stem("url").alias("stem"), S.suffix("url").alias("suffix"), S.parent_name("url").alias("parent"))


@query("SELECT event_id, 'user_' || user_id AS stem, floor(value * 1000)::BIGINT AS ms FROM events WHERE event_type <> 'view'")
def crop_names(spark, sf):
    """F-10 P-13: crop names parsed; what does not parse is dropped."""
    name = F.concat(F.lit("crops/user_"), F.col("user_id").cast("string"), F.lit("__ts_"), F.format_string("%010d", F.floor(F.col("value") * 1000).cast("long")), F.when(F.col("event_type") != "view", F.lit("__box_0.jpg")).otherwise(F.lit(".jpg")))
    e = _t(spark, sf, "events").withColumn("name", name)
    return e.select("event_id", S.crop_stem("name").alias("stem"), S.crop_ms("name").alias("ms")).filter(F.col("stem").isNotNull())


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'unknown' ELSE regexp_replace(trim(p_name || ' ü/' || p_brand), '[^\\pL\\pN_\\-.]+', '_', 'g') END AS label FROM part""")
def sanitize(spark, sf):
    """F-9."""
    raw = F.when(F.col("p_partkey") % 10 == 0, F.lit("  ")).otherwise(F.concat("p_name", F.lit(" ü/"), "p_brand"))
    return _t(spark, sf, "part").select("p_partkey", S.sanitize_label(raw).alias("label"))


_SCORES = """logits AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: x::DOUBLE * 20) AS z FROM embeddings),
pow AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM logits),
prob AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM pow)"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 20)
    return _t(spark, sf, "embeddings").select("vec_id", "label", z.alias("z")).select("vec_id", "label", S.softmax("z").alias("p"))


@query(f"WITH {_SCORES} SELECT vec_id, CASE WHEN list_max(p) >= 0.5 THEN (list_position(p, list_max(p)) - 1)::VARCHAR ELSE 'unknown' END AS name, round_even(list_max(p) * 1e6, 0) / 1e6 AS score FROM prob")
def classify_threshold(spark, sf):
    """F-17 F-18 P-14 P-15 M-3 M-4: the best class, or unknown below the threshold."""
    top = _scores(spark, sf).withColumn("top", S.top_class("p", CLASSES))
    return top.select("vec_id", S.or_unknown("top.name", "top.score", 0.5).alias("name"), S.rounded("top.score", 6).alias("score"))


@query(f"WITH {_SCORES} SELECT vec_id, name, k::INTEGER AS rank, round_even(score * 1e6, 0) / 1e6 AS score FROM (SELECT vec_id, i::VARCHAR AS name, p[i + 1] AS score, row_number() OVER (PARTITION BY vec_id ORDER BY p[i + 1] DESC, i) AS k FROM prob, range(10) t(i)) WHERE k <= 3")
def top3_scores(spark, sf):
    """W-11."""
    rows = _scores(spark, sf).select("vec_id", F.posexplode("p").alias("i", "score"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("score"), "i")
    return rows.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("vec_id", F.col("i").cast("string").alias("name"), "rank", S.rounded("score", 6).alias("score"))


@query("SELECT c AS class, count(*) FILTER (quality = c AND toxic = 0) AS pred_0, count(*) FILTER (quality = c AND toxic = 1) AS pred_1 FROM labels, (VALUES (0), (1)) v(c) GROUP BY c")
def confusion_matrix(spark, sf):
    """A-9 J-17."""
    return evaluate.confusion_matrix(_t(spark, sf, "labels"), "quality", "toxic", [0, 1])


@query("""WITH s AS (SELECT c AS class, count(*) FILTER (quality = c AND toxic = c) AS tp, count(*) FILTER (quality <> c AND toxic = c) AS fp, count(*) FILTER (quality = c AND toxic <> c) AS fn FROM labels, (VALUES (0), (1), (2)) v(c) GROUP BY c)
SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS precision, tp / greatest(tp + fn, 1)::DOUBLE AS recall FROM s""")
def precision_recall(spark, sf):
    """A-10."""
    return evaluate.precision_recall(_t(spark, sf, "labels"), "quality", "toxic", [0, 1, 2])


@query("SELECT count(*) AS total, count(*) FILTER (quality = toxic) AS correct, count(*) FILTER (quality = toxic) / greatest(count(*), 1)::DOUBLE AS accuracy FROM labels")
def accuracy(spark, sf):
    """A-11."""
    return evaluate.accuracy(_t(spark, sf, "labels"), "quality", "toxic")


@query("SELECT round_even(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1) * 1e9, 0) / 1e9 AS loss FROM lineitem")
def weighted_loss(spark, sf):
    """A-11: a mean weighted by batch size."""
    return evaluate.weighted_loss(_t(spark, sf, "lineitem"), "l_discount", "l_quantity").select(S.rounded("loss", 9).alias("loss"))


_NAMES = "customer events orders".split()


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in _NAMES))
def table_counts(spark, sf):
    """A-1."""
    return monitoring.table_counts({n: _t(spark, sf, n) for n in _NAMES})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def label_counts(spark, sf):
    """A-5 A-7 A-15 S-23."""
    return monitoring.label_counts(_t(spark, sf, "events"), "event_type")


@query("SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name")
def class_counts(spark, sf):
    """A-8: zero-filled over the known classes."""
    nation = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rich = _t(spark, sf, "customer").filter("c_acctbal > 9000").join(nation, "c_nationkey")
    return evaluate.class_counts(rich, "n_name", nation)


@query("SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def detections_per_hour(spark, sf):
    """Q-2."""
    return monitoring.per_hour(_t(spark, sf, "events"), "event_type", "ts")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY floor(epoch_us(ts) / 1e6::DOUBLE)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n_trailing FROM events")
def trailing_hour(spark, sf):
    """Q-2, trailing form."""
    e = _t(spark, sf, "events").select("event_id", "event_type", S.seconds("ts").alias("t"))
    return monitoring.trailing_count(e, ["event_type"], "t", 3600).select("event_id", "n_trailing")


@query("SELECT event_id, user_id, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def recent_series(spark, sf):
    """Q-3 Q-5: the raw series of the last hour."""
    e = _t(spark, sf, "events")
    last = e.agg((F.max("ts") - F.expr("interval 1 hour")).alias("since"))
    return e.join(F.broadcast(last), F.col("ts") >= F.col("since")).select("event_id", "user_id", "value")  # one row


@query("SELECT event_type, max(ts) AS last_seen FROM events WHERE regexp_full_match(event_type, 'click|vi.*') GROUP BY 1")
def last_seen(spark, sf):
    """Q-4."""
    return monitoring.last_seen(_t(spark, sf, "events"), "event_type", "ts", "click|vi.*")


@query("SELECT user_id, arg_max(value, ts) FILTER (value > 1) AS last_value FROM events GROUP BY 1 HAVING count(*) FILTER (value > 1) > 0")
def last_not_null(spark, sf):
    """Q-6 Q-7: the last value that is there."""
    e = _t(spark, sf, "events").withColumn("value", F.when(F.col("value") > 1, F.col("value")))
    return monitoring.last_not_null(e, "user_id", "ts", "value")


@query("SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL ORDER BY 1")
def label_values(spark, sf):
    """Q-1 A-2."""
    return monitoring.label_values(_t(spark, sf, "events"), "event_type")


@query("SELECT event_id, CASE WHEN value / 490 >= 0.9 THEN 'green' WHEN value / 490 >= 0.7 THEN 'yellow' ELSE 'red' END AS color FROM events")
def bands(spark, sf):
    """Q-8."""
    return _t(spark, sf, "events").select("event_id", S.band(F.col("value") / 490, [(0.7, "yellow"), (0.9, "green")], "red").alias("color"))


@query("SELECT event_id, 'detected{event=\"' || event_type || '\",user=\"' || user_id || '\"} ' || event_id AS line FROM events")
def metric_lines(spark, sf):
    """F-21 S-18."""
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_type"))
    return _t(spark, sf, "events").select("event_id", S.metric_line(F.lit("detected"), labels, F.col("event_id")).alias("line"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, coalesce(json_extract_string(props, '$.iscrowd')::INTEGER, 0) <> 0 AS is_crowd, NULL::DOUBLE AS area FROM events")
def json_props(spark, sf):
    """F-22 S-12: JSON with defaults for what is missing."""
    p = F.from_json("props", "k int, iscrowd int, area double, bbox array<double>")
    return _t(spark, sf, "events").select("event_id", p.alias("p")).select("event_id", "p.k", (F.coalesce("p.iscrowd", F.lit(0)) != 0).alias("is_crowd"), F.coalesce("p.area", F.get("p.bbox", F.lit(3))).alias("area"))


_DAYS = "days AS (SELECT (epoch_us(ts) // 86400000000 - 19723)::BIGINT AS epoch, round_even(avg(value) * 1e6, 0) / 1e6 AS acc FROM events GROUP BY 1)"


def _history(spark: SparkSession, sf: str) -> DataFrame:
    day = (F.unix_date(F.to_date("ts")) - 19723).cast("long")
    return _t(spark, sf, "events").groupBy(day.alias("epoch")).agg(S.rounded(F.avg("value"), 6).alias("acc"))


@query(f"WITH {_DAYS} SELECT epoch, acc FROM days ORDER BY acc DESC, epoch LIMIT 1")
def best_epoch(spark, sf):
    """W-13."""
    return evaluate.best_epoch(_history(spark, sf), "epoch", "acc")


@query(f"""WITH {_DAYS}, m AS (SELECT *, coalesce(acc > max(acc) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved, max(acc) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best_so_far FROM days),
b AS (SELECT *, sum(improved::INTEGER) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS block FROM m), s AS (SELECT *, (row_number() OVER (PARTITION BY block ORDER BY epoch) - 1)::INTEGER AS streak FROM b)
SELECT epoch, acc, improved, best_so_far, streak, max(streak >= 7) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stopped FROM s""")
def early_stop(spark, sf):
    """W-12."""
    return evaluate.training_progress(_history(spark, sf), "epoch", "acc")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey >= (SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= 100) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def filter_topk(spark, sf):
    """P-4 P-5 P-6 J-2 J-4 O-1 O-2 O-4: equality, membership, from a start on, top k by order."""
    lines = _t(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = _t(spark, sf, "orders").filter("o_orderstatus = 'F' and o_orderkey >= 100")
    return lookup.matched(rows, lines, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT o_orderkey, o_orderpriority FROM orders o WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def exclusions(spark, sf):
    """P-7 P-12 J-14 O-3: reserved names out, and what was done before."""
    done = _t(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return lookup.missing(_t(spark, sf, "orders").filter(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW")), done, ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query("SELECT page_id, url FROM pages WHERE lower(regexp_extract(regexp_extract(url, '[^/]*$'), '.(\\.[^.]*)$', 1)) IN ('.html', '.htm')")
def suffix_filter(spark, sf):
    """P-11 S-13: a whitelist of suffixes, case ignored."""
    return _t(spark, sf, "pages").filter(S.has_suffix("url", [".HTML", ".htm"])).select("page_id", "url")


@query("SELECT count(*) AS n_rows, count(l.doc_id) AS n_matched, count(*) - count(l.doc_id) AS n_missing, count(*) FILTER (l.quality = 0) AS n_rejected FROM documents d LEFT JOIN labels l USING (doc_id)")
def run_counters(spark, sf):
    """A-14 P-10 P-13 P-17 P-18: what a run saw, matched, missed and rejected."""
    labels = _t(spark, sf, "labels").select("doc_id", "quality", F.lit(1).alias("hit"))
    rows = _t(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    n = F.count("*")
    return rows.agg(n.alias("n_rows"), F.count("hit").alias("n_matched"), (n - F.count("hit")).alias("n_missing"), F.count(F.when(F.col("quality") == 0, 1)).alias("n_rejected"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_matched(spark, sf):
    """J-3 J-12: DELETE with IN, as what is kept."""
    open_ = _t(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lookup.missing(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), open_, ["l_orderkey"])


def _box_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with up to 16 boxes, made of vectors."""
    v = F.transform(F.slice("embedding", 1, 16), lambda x, i: F.struct((i * 10.0).alias("x1"), F.lit(0.0).alias("y1"), (i * 10.0 + F.abs(x).cast("double") * 400).alias("x2"), (F.abs(x).cast("double") * 300).alias("y2"), F.abs(x).cast("double").alias("confidence")))
    vid = F.col("vec_id").cast("string")
    return _t(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("video_name"), (F.col("vec_id") * 5.0).alias("timestamp_seconds"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.concat(F.lit("frm_"), vid).alias("frame_uid"), F.concat(F.lit("f"), vid, F.lit(".jpg")).alias("frame_name"), v.alias("boxes"))


_BOXES = "boxes AS (SELECT vec_id, label, i, abs(embedding[i + 1])::DOUBLE AS c, i * 10.0::DOUBLE AS x1, i * 10.0::DOUBLE + abs(embedding[i + 1])::DOUBLE * 400 AS x2, abs(embedding[i + 1])::DOUBLE * 300 AS y2 FROM embeddings, range(16) t(i))"


@query(f"""WITH {_BOXES} SELECT 'det_' || substr(sha1('v' || label || chr(31) || 'm' || chr(31) || (vec_id * 5.0::DOUBLE)::VARCHAR || chr(31)), 1, 16) AS detection_uid, 'v' || label AS video_name, vec_id * 5.0::DOUBLE AS timestamp_seconds,
round_even(max(c) * 10000, 0) / 10000 AS confidence FROM boxes WHERE c >= 0.25 GROUP BY vec_id, label""")
def frame_detections(spark, sf):
    """A-4 M-1 P-16 P-20: the best box of each frame that has one."""
    return models.detections(_box_frames(spark, sf), "m").select("detection_uid", "video_name", "timestamp_seconds", "confidence")


@query(f"""WITH {_BOXES}, big AS (SELECT *, x2 - x1 AS w, y2 AS h FROM boxes WHERE c >= 0.3 AND x2 - x1 >= 50 AND y2 >= 50),
p AS (SELECT *, greatest(0, round_even(x1 - w * 0.15::DOUBLE, 0)::INTEGER) AS l, greatest(0, round_even(0 - h * 0.15::DOUBLE, 0)::INTEGER) AS t, least(640, round_even(x1 + w + w * 0.15::DOUBLE, 0)::INTEGER) AS r, least(480, round_even(h + h * 0.15::DOUBLE, 0)::INTEGER) AS b FROM big)
SELECT 'frm_' || vec_id AS frame_uid, 'f' || vec_id || '__box_' || i || '.jpg' AS crop_path, r - l AS crop_width, b - t AS crop_height FROM p WHERE r > l AND b > t""")
def box_crops(spark, sf):
    """M-2 W-14 T-8 F-7 S-15: each box a crop, padded and inside the frame."""
    return models.crops(_box_frames(spark, sf)).select("frame_uid", "crop_path", "crop_width", "crop_height")


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'crops/' || p_partkey ELSE '/other/' || p_partkey END AS path, CASE WHEN p_size < 15 THEN p_partkey::INTEGER END AS device, floor(p_retailprice)::BIGINT::VARCHAR AS version,
greatest(0, p_size - 20) AS "left", least(30, p_size + 5) AS "right" FROM part""")
def path_and_device(spark, sf):
    """F-4 F-8 F-24 F-25: relative paths, clipping, model versions, device numbers."""
    p = _t(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    path = S.relative_path(F.when(F.col("p_size") > 25, F.concat(F.lit("/data/crops/"), key)).otherwise(F.concat(F.lit("/other/"), key)), "/data")
    source = F.when(F.col("p_size") < 15, key).otherwise(F.concat(F.lit("rtsp://"), key))
    box = S.clipped_box((F.col("p_size") - 20).cast("double"), F.lit(0.0), (F.col("p_size") + 5).cast("double"), F.lit(9.0), F.lit(30), F.lit(9))
    return p.select("p_partkey", path.alias("path"), S.device_id(source).alias("device"), S.model_version("p_retailprice").alias("version"), box["left"].alias("left"), box["right"].alias("right"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_violations(spark, sf):
    """D-13: an invariant to check where there is no unique index."""
    edges = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_uid"), F.col("l_linenumber").alias("interval_uid"))
    return schemas.violations(edges, "frame_intervals").select(F.col("frame_uid").alias("l_orderkey"), F.col("interval_uid").alias("l_linenumber"), "n")


@query("SELECT event_id::VARCHAR AS crop_uid, coalesce(CASE WHEN value > 100 THEN event_type END, 'unsorted') AS label, false AS is_duplicate, NULL::DOUBLE AS padding FROM events")
def schema_defaults(spark, sf):
    """D-11 D-12 P-19: columns added with their defaults, surplus ones dropped."""
    rows = _t(spark, sf, "events").select(F.col("event_id").cast("string").alias("crop_uid"), F.when(F.col("value") > 100, F.col("event_type")).alias("label"), F.lit("gone").alias("annotation_uid"))
    return merge.reset(schemas.conform(rows, "crops"), "is_duplicate", False).select("crop_uid", "label", "is_duplicate", "padding")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderdate < DATE '1998-01-01' THEN o_totalprice ELSE -1.0::DOUBLE END AS o_totalprice FROM orders WHERE o_orderdate < DATE '1998-01-01' OR o_orderstatus = 'F'")
def upsert_subset(spark, sf):
    """D-2 D-4: known keys keep what the update does not list; new keys come whole."""
    o = _t(spark, sf, "orders")
    source = o.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("new").alias("o_orderstatus"), F.lit(-1.0).alias("o_totalprice"))
    return merge.upsert(o.filter("o_orderdate < '1998-01-01'").select("o_orderkey", "o_orderstatus", "o_totalprice"), source, ["o_orderkey"], ["o_orderstatus"])


@query("SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS rank FROM events")
def global_ranks(spark, sf):
    """O-5: ranks of a total order without a sort in one task."""
    e = _t(spark, sf, "events").select("event_id", "value")
    return sampling.ranked(e, ["value", "event_id"], "rank").select("event_id", "rank")


@query("""SELECT label, count(*) AS n FROM (SELECT f.n_name AS folder, l.label, row_number() OVER (PARTITION BY f.n_name ORDER BY length(l.label) DESC, l.label) AS k
FROM nation f JOIN (SELECT lower(n_name) AS label FROM nation WHERE n_regionkey < 3) l ON contains(lower(f.n_name), lower(l.label))) g JOIN nation n ON n.n_name = g.folder JOIN customer ON c_nationkey = n_nationkey WHERE k = 1 GROUP BY label""")
def scattered_labels(spark, sf):
    """A-7 S-16: members of groups take the label that their folder's name holds."""
    n = _t(spark, sf, "nation")
    chosen = lookup.longest_label(n.select(F.col("n_name").alias("folder")), "folder", n.filter("n_regionkey < 3").select(F.lower("n_name").alias("label")), "label")
    members = _t(spark, sf, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("folder")), "c_nationkey")
    return members.join(chosen, "folder").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id, max_by(value, ts) AS value FROM events WHERE value / 490 < 0.9 GROUP BY 1, 2 HAVING count(*) >= 2")
def gauge_series(spark, sf):
    """Q-3 Q-5: one last value a series, of series with two samples at least."""
    e = _t(spark, sf, "events").filter(F.col("value") / 490 < 0.9)
    return e.groupBy("event_type", "user_id").agg(F.max_by("value", "ts").alias("value"), F.count("*").alias("_n")).filter("_n >= 2").drop("_n")
