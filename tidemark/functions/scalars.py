"""Scalar functions as column expressions (all stay in the JVM)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: ColumnLike, places: int = 0) -> Column:
    """Half-even rounding by scaling, which other engines reproduce bit for bit."""
    scale = F.lit(float(10**places))
    return F.bround(_c(x) * scale) / scale


def seconds(ts: ColumnLike) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    t = _c(ts)
    micros = (F.unix_date(F.to_date(t)).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    return micros / F.lit(1_000_000.0)


def make_uid(prefix: str, *parts: ColumnLike) -> Column:
    """``prefix_`` and 16 hex digits of SHA-1 over the parts, each closed by the unit separator."""
    pieces = [x for p in parts for x in (_c(p).cast("string"), F.lit("\x1f"))]
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat(*pieces).cast("binary")), 1, 16))


def frame_name(stem: ColumnLike, ts: ColumnLike) -> Column:
    return F.format_string("%s__ts_%010d.jpg", _c(stem), F.bround(_c(ts) * 1000).cast("long"))


def timestamp_grid(start: ColumnLike, end: ColumnLike, step: float) -> Column:
    """start, start+step .. end (inclusive up to 1e-9), rounded to milliseconds; empty if end is before."""
    n = F.floor((_c(end) - _c(start) + 1e-9) / step).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: rounded(_c(start) + i * F.lit(step), 3))
    return F.when(n >= 0, grid).otherwise(F.array().cast("array<double>"))


# --- names and paths -------------------------------------------------------------------------

def relative_path(path: ColumnLike, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    p = _c(path)
    return F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 30)).otherwise(p)


def basename(path: ColumnLike) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def parent_name(path: ColumnLike) -> Column:
    """Name of the folder that holds the file; null for a bare name."""
    parts = F.split(_c(path), "/")
    return F.get(parts, F.size(parts) - 2)


def stem(path: ColumnLike) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: ColumnLike) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def has_suffix(path: ColumnLike, allowed: Sequence[str]) -> Column:
    return suffix(path).isin(*[s.lower() for s in allowed])


def sanitize_label(label: ColumnLike) -> Column:
    clean = F.regexp_replace(F.trim(_c(label)), r"(?U)[^\w\-.]+", "_")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("unknown")).otherwise(clean)


CROP_NAME = r"^(.+?)__ts_(\d+)__box_.*$"


def crop_stem(name: ColumnLike) -> Column:
    """The video stem of a crop's file name; null where the name does not parse."""
    return F.nullif(F.regexp_extract(basename(name), CROP_NAME, 1), F.lit(""))


def crop_ms(name: ColumnLike) -> Column:
    return F.nullif(F.regexp_extract(basename(name), CROP_NAME, 2), F.lit("")).try_cast("long")


def video_time(name: ColumnLike) -> Column:
    """Timestamp in a recording's file name, ``video_YYYYMMDD_HHMMSS`` or ``YYYY-MM-DD_HH-MM-SS``;
    null where there is none or it is no valid time."""
    digits = F.regexp_replace(F.regexp_extract(stem(name), r"^(?:video_)?(\d{8}_\d{6}|\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})$", 1), "[-_]", "")
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss"))


def lighting(hour: ColumnLike) -> Column:
    h = _c(hour)
    return F.when(h.between(7, 18), "day").when((h >= 22) | (h <= 5), "night").otherwise("unknown")


def device_id(source: ColumnLike) -> Column:
    """The number of an all-digit source, else null (a stream's address)."""
    return F.when(_c(source).rlike("^[0-9]+$"), _c(source).try_cast("int"))


def model_version(mtime: ColumnLike) -> Column:
    return F.floor(_c(mtime)).cast("string")


# --- geometry --------------------------------------------------------------------------------

def resize_dims(width: ColumnLike, height: ColumnLike, max_side: int) -> Column:
    """struct(width, height): shrunk to ``max_side``, even, two at least; null for no area."""
    w, h = _c(width), _c(height)
    scale = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(w, h))
    even = lambda n: F.greatest(F.lit(2), n - n % 2)
    side = lambda n: even(F.bround(n * scale).cast("int"))
    return F.when((w > 0) & (h > 0), F.struct(side(w).alias("width"), side(h).alias("height")))


def padded_box(x: ColumnLike, y: ColumnLike, w: ColumnLike, h: ColumnLike, padding: float, frame_w: ColumnLike, frame_h: ColumnLike) -> Column:
    """struct(left, top, right, bottom): the box grown by a share of its sides, rounded, inside the frame."""
    x, y, w, h = _c(x), _c(y), _c(w), _c(h)
    low = lambda v: F.greatest(F.lit(0), F.bround(v).cast("int"))
    high = lambda v, most: F.least(_c(most).cast("int"), F.bround(v).cast("int"))
    return F.struct(low(x - w * padding).alias("left"), low(y - h * padding).alias("top"), high(x + w + w * padding, frame_w).alias("right"), high(y + h + h * padding, frame_h).alias("bottom"))


def clipped_box(x1: ColumnLike, y1: ColumnLike, x2: ColumnLike, y2: ColumnLike, frame_w: ColumnLike, frame_h: ColumnLike) -> Column:
    x1, y1, x2, y2 = _c(x1), _c(y1), _c(x2), _c(y2)
    return padded_box(x1, y1, x2 - x1, y2 - y1, 0.0, frame_w, frame_h)


def xywh(x1: ColumnLike, y1: ColumnLike, x2: ColumnLike, y2: ColumnLike) -> Column:
    return F.struct(_c(x1).alias("x"), _c(y1).alias("y"), (_c(x2) - _c(x1)).alias("w"), (_c(y2) - _c(y1)).alias("h"))


def has_area(box: Column) -> Column:
    return (box["right"] > box["left"]) & (box["bottom"] > box["top"])


def large_enough(w: ColumnLike, h: ColumnLike, least: float) -> Column:
    return (_c(w) >= least) & (_c(h) >= least)


# --- hashes and scores -----------------------------------------------------------------------

def hamming(a: ColumnLike, b: ColumnLike) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def sign_bits(vector: ColumnLike) -> Column:
    """64 bits: bit i is set where value i is above 0."""
    v = _c(vector)
    bits = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def softmax(logits: ColumnLike) -> Column:
    v = _c(logits)
    powers = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def top_class(scores: ColumnLike, classes: Sequence[str]) -> Column:
    """struct(name, score) of the highest score, the first class on ties."""
    v = _c(scores)
    names = F.array(*[F.lit(c) for c in classes])
    return F.struct(F.element_at(names, F.array_position(v, F.array_max(v)).cast("int")).alias("name"), F.array_max(v).alias("score"))


def or_unknown(name: ColumnLike, score: ColumnLike, threshold: float) -> Column:
    return F.when(_c(score) >= threshold, _c(name)).otherwise(F.lit("unknown"))


# --- metrics and JSON ------------------------------------------------------------------------

def metric_line(name: ColumnLike, labels: ColumnLike, value: ColumnLike) -> Column:
    """``name{key="value",...} value`` with keys sorted; no braces without labels."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(_c(labels))), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    body = F.when(F.size(F.map_keys(_c(labels))) > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(F.lit(""))
    return F.concat(_c(name), body, F.lit(" "), _c(value).cast("string"))


def band(value: ColumnLike, steps: Sequence[tuple[float, str]], below: str) -> Column:
    """The name of the highest step that a value reaches."""
    out = F.lit(below)
    for least, name in sorted(steps):
        out = F.when(_c(value) >= least, F.lit(name)).otherwise(out)
    return out
