"""Secret scans in DataFrame functions only: patterns, and sliding-window Shannon entropy.

Base kinds are regular expressions, leftmost and non-overlapping per kind; ``\\G`` keeps the pass
that finds positions linear. The entropy part looks at maximal runs of a character class: a window
slides over the run, the counts of the class's characters change by one in and one out, and the sum
of ``c*log2(c)`` follows from those two counts alone (in integers, so every order gives one result).
Windows at or above the class's entropy merge into spans; runs that match the allow-list add none.

Defined results: null text is empty; offsets are code points, ends exclusive; no span gives an
empty string and the digest of one; repeated rows stay repeated; columns of any name, but for ``base``
and ``entropy``, which are replaced. Time grows with a text's length, and with the square root of its
matches for each match.
"""
from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.data import table

# Fixed patterns of the base kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ with 16 characters or more
SCALE = 1 << 20
#: Window places of a run that are slid over at a time.
PIECE = 2048


@dataclass(frozen=True)
class CharClass:
    """Runs of ``alphabet`` (``pattern``) whose window of ``window`` characters has ``bits`` bits."""

    kind: str
    alphabet: str
    pattern: str
    window: int
    bits: float


CLASSES = (
    CharClass("entropy_hex", "0123456789abcdefABCDEF", r"[0-9A-Fa-f]{20,}", 20, 3.0),
    CharClass("entropy_base64", string.ascii_letters + string.digits + "+/_=-", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.9),
)
#: Runs that no entropy span is made of: placeholders, repeated or sequential characters, plain
#: numbers, UUIDs.
ALLOW = (r"(?i)example|placeholder|changeme|your[_-]?(?:api|key|token|secret)", r"(.)\1{7,}", r"(?i)0123456789|abcdefghijkl", r"^[0-9]+$", r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def _lengths(gaps: Column, matches: Column) -> Column:
    return F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m))


def _before(blocks: Column, totals: Column) -> Column:
    """The sum before each number of ``blocks``: that of the blocks before (``totals`` are their sums)
    and that of the numbers before in its block. A fold that collected sums would copy them at each step;
    with blocks of the square root of n numbers this adds up n times that root."""
    plus = lambda a, x: a + x
    upto = F.transform(totals, lambda t, j: F.aggregate(F.slice(totals, F.lit(1), j), F.lit(0), plus))
    return F.flatten(F.zip_with(blocks, upto, lambda b, o: F.transform(b, lambda x, k: o + F.aggregate(F.slice(b, F.lit(1), k), F.lit(0), plus))))


def located(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """``df`` with a column for each pattern: an array of struct(s, e, m) of its matches in ``text``.
    Steps are columns of their own, so that each is computed once."""
    cols = df.columns
    gap = lambda p: F.regexp_extract_all(F.col(text), F.lit(r"\G([\s\S]*?)(?:" + p + ")"), 1)
    step = df.select(*cols, *[F.regexp_extract_all(F.col(text), F.lit(p), 0).alias(f"{c}_m") for c, p in patterns.items()])
    step = step.select("*", *[F.when(F.size(f"{c}_m") > 0, gap(p)).otherwise(F.array().cast("array<string>")).alias(f"{c}_g") for c, p in patterns.items()])
    step = step.select("*", *[_lengths(F.col(f"{c}_g"), F.col(f"{c}_m")).alias(f"{c}_n") for c in patterns])
    width = lambda c: F.greatest(F.ceil(F.sqrt(F.size(f"{c}_n"))), F.lit(1)).cast("int")
    block = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(f"{c}_n") / width(c)).cast("int") - 1, F.lit(0))), lambda j: F.slice(f"{c}_n", j * width(c) + 1, width(c)))
    step = step.select("*", *[block(c).alias(f"{c}_b") for c in patterns])
    step = step.select("*", *[F.transform(f"{c}_b", lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)).alias(f"{c}_t") for c in patterns])
    step = step.select("*", *[_before(F.col(f"{c}_b"), F.col(f"{c}_t")).alias(f"{c}_p") for c in patterns])
    start = lambda c: F.zip_with(f"{c}_p", f"{c}_g", lambda p, g: p + F.length(g))
    return step.select(*cols, *[F.zip_with(start(c), f"{c}_m", lambda s, m: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"))).alias(c) for c in patterns])


def hot_spans(run: Column, cls: CharClass) -> Column:
    """Array of struct(s, e): merged windows of ``run`` (a string of the class's characters only)
    whose entropy reaches the class's bits. The windows of ``PIECE`` places at a time are slid over by
    themselves; spans that touch across pieces become one."""
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(run) - (cls.window - 1)) / PIECE).cast("int") - 1, F.lit(0)))

    def piece(i: Column) -> Column:
        found = _slid(F.substring(run, i * PIECE + 1, F.lit(PIECE + cls.window - 1)), cls)
        return F.transform(found, lambda x: F.struct((x["s"] + i * PIECE).alias("s"), (x["e"] + i * PIECE).alias("e")))

    def joined(a: Column) -> Column:  # spans rise in begins and ends
        first = F.filter(a, lambda x, i: F.coalesce(F.get(a, i - 1)["e"] < x["s"], F.lit(True)))
        last = F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1)["s"] > x["e"], F.lit(True)))
        return F.zip_with(first, last, lambda x, y: F.struct(x["s"].alias("s"), y["e"].alias("e")))

    # as the one element of an array, what was found is computed once and then looked at from all places
    return F.flatten(F.transform(F.array(F.flatten(F.transform(pieces, piece))), joined))


def _slid(run: Column, cls: CharClass) -> Column:
    """The same of one piece, by a fold; its state is copied at each step and so must stay short."""
    w = cls.window
    weight = F.array(*[F.lit(round(c * math.log2(c) * SCALE) if c else 0) for c in range(w + 1)])
    most = math.floor((math.log2(w) - cls.bits) * w * SCALE)
    f = lambda c: F.element_at(weight, c + 1)
    char = lambda at: F.call_function("locate", F.substring(run, at, F.lit(1)), F.lit(cls.alphabet))
    empty = F.struct(F.array_repeat(F.lit(0), len(cls.alphabet)).alias("counts"), F.lit(0).alias("sum"), F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def slide(a: Column, i: Column) -> Column:
        come, go = char(i), F.when(i > w, char(i - w)).otherwise(F.lit(0))
        c_in = F.element_at(a["counts"], come)
        c_out = F.when(go > 0, F.element_at(a["counts"], F.greatest(go, F.lit(1)))).otherwise(F.lit(0))
        total = F.when(come == go, a["sum"]).otherwise(a["sum"] + f(c_in + 1) - f(c_in) + F.when(go > 0, f(c_out - 1) - f(c_out)).otherwise(F.lit(0)))
        counts = F.transform(a["counts"], lambda c, j: c + (j + 1 == come).cast("int") - (j + 1 == go).cast("int"))
        hot = (i >= w) & (total <= most)
        joins = hot & (a["e"] >= i - w)
        s = F.when(joins, a["s"]).when(hot, i - w).otherwise(a["s"])
        out = F.when(hot & ~joins & (a["s"] >= 0), F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).otherwise(a["out"])
        return F.struct(counts.alias("counts"), total.alias("sum"), s.alias("s"), F.when(hot, i).otherwise(a["e"]).alias("e"), out.alias("out"))

    done = lambda a: F.when(a["s"] >= 0, F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).otherwise(a["out"])
    return F.aggregate(F.sequence(F.lit(1), F.length(run)), empty, slide, done)


def scan(docs: DataFrame, *, text: str = "text", classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW) -> DataFrame:
    """``docs`` with ``base`` and ``entropy``: arrays of struct(s, kind rank k, e, kind)."""
    cols = [c for c in docs.columns if c not in ("base", "entropy")]
    inner = [f"c{i}" for i in range(len(cols))]  # columns go by place inside, so that none clashes
    df = docs.select(*[F.col(c).alias(i) for c, i in zip(cols, inner, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("_body"))
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    df = located(df, "_body", {f"_{k}": p for k, p in kinds.items()} | {f"_run{i}": c.pattern for i, c in enumerate(classes)})
    keep = {"assign": lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12, "access": lambda x: F.length(x["m"]) >= 18}
    tag = lambda xs, rank, kind: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))
    base = [tag(F.filter(f"_{k}", keep[k]) if k in keep else F.col(f"_{k}"), rank, k) for rank, k in enumerate(kinds)]
    parts = []
    for i, c in enumerate(classes):
        runs = F.filter(f"_run{i}", lambda x: ~_any(x["m"], allow))
        parts.append(tag(F.flatten(F.transform(runs, _shifted(c))), len(kinds) + i, c.kind))
    spans = "array<struct<s:int,k:int,e:int,kind:string>>"
    some = sum((F.size(f"_run{i}") for i in range(len(classes))), F.lit(0)) > 0
    entropy = F.when(some, F.array_sort(F.concat(*parts)) if parts else F.array().cast(spans)).otherwise(F.array().cast(spans))
    return df.select(*[F.col(i).alias(c) for c, i in zip(cols, inner, strict=True)], F.array_sort(F.concat(*base)).alias("base"), entropy.alias("entropy"))


def _shifted(cls: CharClass):
    """The hot spans of a located run, in the offsets of its text."""
    return lambda r: F.transform(hot_spans(r["m"], cls), lambda h: F.struct((r["s"] + h["s"]).alias("s"), (r["s"] + h["e"]).alias("e")))


def _any(m: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | m.rlike(p)
    return out


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return df.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.array_sort(F.concat("base", "entropy"))).alias("spans"), F.size("entropy").cast("long").alias("n_entropy"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds AS (SELECT * FROM (VALUES
  (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'), (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]{16,}'),
  (3, 'entropy_hex', '[0-9A-Fa-f]{20,}'), (4, 'entropy_base64', '[A-Za-z0-9+/_=-]{20,}')) v(k, kind, p)),
hit AS (
  SELECT doc_id, k, kind, regexp_extract_all(t, CASE k WHEN 0 THEN '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+' WHEN 1 THEN 'AKIA[A-Z0-9]+' WHEN 2 THEN '[0-9a-f]{16,}' WHEN 3 THEN '[0-9A-Fa-f]{20,}' ELSE '[A-Za-z0-9+/_=-]{20,}' END) AS m,
    regexp_extract_all(t, '([\s\S]*?)(?:' || p || ')', 1) AS g
  FROM d, kinds),
found AS (
  SELECT doc_id, k, kind, m[i] AS m, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hit)),
base AS (
  SELECT doc_id, k, kind, s, s + length(m) AS e FROM found
  WHERE k = 0 AND length(regexp_extract(m, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12 OR k = 1 AND length(m) >= 18 OR k = 2),
runs AS (
  SELECT * FROM found
  WHERE k >= 3 AND NOT regexp_matches(m, '(?i)example|placeholder|changeme|your[_-]?(?:api|key|token|secret)|0123456789|abcdefghijkl')
    AND NOT regexp_matches(m, '^[0-9]+$|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$')
    AND len(list_filter(range(1, length(m) - 6), lambda i: m[i:i + 7] = repeat(m[i], 8))) = 0),
wins AS (
  SELECT *, string_split(m[p:p + 19], '') AS c FROM (SELECT *, unnest(range(1, length(m) - 18)) AS p FROM runs)),
hot AS (
  SELECT doc_id, k, kind, s, p - 1 AS a FROM wins
  WHERE list_sum(list_transform(list_distinct(c), lambda x: round(len(list_filter(c, lambda y: y = x)) * log2(len(list_filter(c, lambda y: y = x))) * 1048576)))
    <= floor((log2(20) - CASE k WHEN 3 THEN 3.0 ELSE 3.9 END) * 20 * 1048576)),
isl AS (
  SELECT doc_id, k, kind, s + min(a) AS s, s + max(a) + 20 AS e
  FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, k, s ORDER BY a ROWS UNBOUNDED PRECEDING) AS g
    FROM (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY doc_id, k, s ORDER BY a) <= 20 THEN 0 ELSE 1 END AS n FROM hot))
  GROUP BY doc_id, k, kind, s, g),
spans AS (SELECT *, 1 AS b FROM base UNION ALL SELECT *, 0 FROM isl)
SELECT d.doc_id, coalesce(count(*) FILTER (k = 0), 0) AS n_assign, coalesce(count(*) FILTER (k = 1), 0) AS n_access, coalesce(count(*) FILTER (k = 2), 0) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (b = 1), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e), '') AS spans, coalesce(count(*) FILTER (b = 0), 0) AS n_entropy
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""
