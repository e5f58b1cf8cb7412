"""Live alerts over a stream of classified boxes, with the batch operators' semantics.

State per source: the time of the last processed frame, the last accepted predictions, and the last
alert. Times are event times, so a replay gives the same alerts. Within a micro-batch, whose size the
source bounds, rows are put in order by (ts, idx). Rows older than the last processed frame are late and
change nothing. With ``idle``, the state of a source that is silent for so many seconds is dropped.
"""
from __future__ import annotations

import json
import signal
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.alerts import COOLDOWN, MAJORITY, SIZE, THRESHOLD
from tidemark.sources.video import resolve

STATE = "checked double, names array<string>, confs array<double>, last_name string, last_ts double, boxes array<string>"
OUTPUT = "source string, ts double, idx long, name string, votes int, mean_conf double, box string, seen string, conf double"


class Debounce:
    """Throttle, majority window and cooldown of one source."""

    def __init__(self, state: tuple | None = None, *, size: int = SIZE, least: int = MAJORITY, threshold: float = THRESHOLD, seconds: float = COOLDOWN, interval: float = 0.0, max_span: float | None = None) -> None:
        self.size, self.least, self.threshold, self.seconds, self.interval, self.max_span = size, least, threshold, seconds, interval, max_span
        self.checked, names, confs, self.last_name, self.last_ts, boxes = state or (None, [], [], None, None, [])
        self.window = list(zip(names, confs, boxes, strict=True))

    def state(self) -> tuple:
        return self.checked, [w[0] for w in self.window], [float(w[1]) for w in self.window], self.last_name, self.last_ts, [w[2] for w in self.window]

    def frame(self, ts: float) -> bool:
        """Whether a frame at ``ts`` is processed: the first, or ``interval`` after the last one that was."""
        if self.checked is not None and ts != self.checked and ts - self.checked < self.interval:
            return False
        self.checked = ts
        return True

    def box(self, ts: float, name: str, conf: float, box: str | None = None) -> tuple[str, int, float, str | None] | None:
        """The alert that a prediction fires, if any, with the last box of its name."""
        if conf is None or conf < self.threshold:
            return None
        self.window = [*self.window, (name, conf, box)][-self.size :]
        if len(self.window) < self.size:
            return None
        best, votes = Counter(w[0] for w in self.window).most_common(1)[0]
        total = 0.0
        for n, c, _ in self.window:
            if n == best:
                total += c
        mean = total / votes
        if votes < self.least or mean < self.threshold:
            return None
        if self.last_name == best and ts < self.last_ts + self.seconds:
            return None
        self.last_name, self.last_ts = best, ts
        return best, votes, mean, [b for n, _, b in self.window if n == best][-1]


def live_alerts(stream: DataFrame, idle: float | None = None, every: bool = False, **options) -> DataFrame:
    """``source, ts, idx, name, conf`` rows (a row a box), with ``box`` or without -> alerts, each with
    the prediction that fired it (``seen``, ``conf``). ``every``: a row for each accepted prediction,
    with null ``name`` where it fires nothing."""

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine = Debounce(tuple(state.get) if state.exists else None, **options)
        rows = pd.concat(list(batches)).sort_values(["ts", "idx"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            if not machine.frame(r.ts):
                continue
            hit = machine.box(r.ts, r.name, r.conf, r.box)
            if hit or (every and r.conf is not None and r.conf >= machine.threshold):
                out.append((key[0], r.ts, r.idx, *(hit or (None,) * 4), r.name, r.conf))
        state.update(machine.state())
        if idle:
            state.setTimeoutDuration(int(idle * 1000))
        yield pd.DataFrame(out, columns=["source", "ts", "idx", "name", "votes", "mean_conf", "box", "seen", "conf"]).astype({"votes": "Int32"})

    rows = stream if "box" in stream.columns else stream.withColumn("box", F.lit(None).cast("string"))
    rows = rows.select("source", "ts", "idx", "name", "conf", "box")
    return rows.groupBy("source").applyInPandasWithState(handle, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


PREDICTIONS = "source string, ts double, idx long, name string, conf double, box string"


def predictions(frames: DataFrame, models: str, *, every: float = 3600.0) -> DataFrame:
    """Frames (``source, ts, width, height, content``) -> a row for each box of each frame, in the
    detector's order, with the best class. ``models``, importable on executors as ``module:function``,
    gives (version, load): ``version()`` says what model is current, ``load(version)`` gives a detector,
    from images to lists of boxes (x1, y1, x2, y2), and a classifier, from an image and its boxes to a
    (name, confidence) each. A worker asks for the version at most every ``every`` seconds and loads
    anew when it has changed. Boxes are rounded and kept within the frame; those without area go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if models not in _loaded:
                _loaded[models] = Reloading(*resolve(models)(), every)
            detect, classify = _loaded[models].get(time.monotonic())
            rows = []
            for r, found in zip(pdf.itertuples(index=False), detect(pdf["content"].tolist()), strict=True):
                inside = [(max(0, round(x1)), max(0, round(y1)), min(r.width, round(x2)), min(r.height, round(y2))) for x1, y1, x2, y2 in found]
                inside = [b for b in inside if b[2] > b[0] and b[3] > b[1]]
                for i, (box, (name, conf)) in enumerate(zip(inside, classify(r.content, inside) if inside else [], strict=True)):
                    x1, y1, x2, y2 = box
                    rows.append((r.source, r.ts, i, name, float(conf), json.dumps({"x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1})))
            yield pd.DataFrame(rows, columns=["source", "ts", "idx", "name", "conf", "box"])

    return frames.mapInPandas(run, PREDICTIONS)


def detection_metrics(rows: DataFrame) -> DataFrame:
    """Two samples a prediction: that it was seen, and its confidence."""
    labels = F.create_map(F.lit("name"), F.col("name"), F.lit("source"), F.col("source"))
    pair = F.array(F.struct(F.lit("detected").alias("name"), F.lit(1.0).alias("value")), F.struct(F.lit("confidence").alias("name"), F.col("conf").alias("value")))
    return rows.select(labels.alias("labels"), F.explode(pair).alias("x"), "ts").select("x.name", "labels", "x.value", "ts")


def boxes(frames: DataFrame, predictions: str = "predictions") -> DataFrame:
    """One row for each predicted box of a frame, in the detector's order."""
    return frames.select("source", "ts", F.posexplode(predictions).alias("idx", "p")).select("source", "ts", F.col("idx").cast("long").alias("idx"), "p.*")


def sessions(stream: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """Sessions of a key; with a watermark on ``ts`` their state is bounded."""
    return stream.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


class Reloading:
    """A model that is loaded anew when its version changes, asked at most every ``every`` seconds;
    to be called at the start of a micro-batch."""

    def __init__(self, version: Callable[[], str], load: Callable[[str], object], every: float = 3600.0) -> None:
        self.version, self.load, self.every = version, load, every
        self.known, self.asked, self.model = None, None, None

    def get(self, now: float):
        if self.asked is None or now - self.asked >= self.every:
            self.asked, current = now, self.version()
            if current != self.known:
                self.known, self.model = current, self.load(current)
        return self.model


#: Models of this worker, by the name they come from.
_loaded: dict[str, Reloading] = {}


def start(alerts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Runs ``sink`` on each micro-batch. ``query.stop()`` ends it; a restart goes on from the checkpoint."""
    writer = alerts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stop_on_signals(*queries) -> None:
    """SIGTERM and SIGINT stop the queries; their checkpoints let them go on later."""

    def stop(*_) -> None:
        for q in queries:
            q.stop()

    for number in (signal.SIGTERM, signal.SIGINT):
        signal.signal(number, stop)
