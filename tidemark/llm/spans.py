"""Removal of repeated strings: every byte that a string of ``LENGTH`` bytes covers which also
starts elsewhere.

The longest previous factor (LPF) of a position, the longest string that starts there and also starts
earlier, comes from suffix order: it is shared with the previous or the next smaller position in that
order (:func:`factors`). The longest next factor (LNF) is shared with the previous or next greater one.
``keep="first"`` removes what an LPF of ``LENGTH`` bytes or more covers, and so keeps the first copy;
``keep="none"`` also what such an LNF covers. Factors are told up to ``LENGTH`` bytes, as no longer one
covers more than the factors of the positions behind it. Suffixes are thus ordered by their first
``LENGTH`` bytes only, for which a 96-bit hash stands, and by position among equals.

Ordering all suffixes of a corpus would move many times its size, so suffixes that cannot repeat
leave first. Each window of LENGTH bytes has an anchor, the least hash of its ``GRAM``-byte grams;
windows with one anchor form a context of at most 2*LENGTH bytes, and equal windows have equal
anchors at equal places. Contexts that occur twice as a whole need no more than that. Of the rest,
a window lies with LENGTH/2 bytes left or right of its anchor, so contexts that share neither half
with another are unique; of the others, an eighth of the window places at a time is held against
the bytes that all windows there have. What remains (the borders of repeated passages, and one representative of
each repeated context they may match) is ordered suffix by suffix. Whole contexts have their own
order, by content and position, of which an aggregation keeps the first and the last position: a
context has an LPF where it is not the first and an LNF where it is not the last. A passage in a third
of all documents is one context, aggregated before it is shuffled. What is gathered in one row is of one
text: its contexts, its found spans.

Defined results: null text is empty; matches never cross documents; rows that agree in id and text
match each other and, keeping the first, are one place; texts below LENGTH bytes lose nothing; a null id
sorts first.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.data import table
from tidemark.llm.storage import release, written

LENGTH = 400
GRAM = 16
BROADCAST_ROWS = 300_000
BASE2 = 0xD6E8FEB86659FD93
BASE2_INV = pow(BASE2, -1, 1 << 64)


class Hashes:
    """Hashes of any substring of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        self.sums = K.prefix_sums(data), K.prefix_sums(data, BASE2)
        self.inverse = K.powers(K.BASE_INV, n), K.powers(BASE2_INV, n)

    def of(self, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return K.mix((s[end] - s[begin]) * self.inverse[which][begin] + (end - begin).astype(np.uint64) * K.U64(K.BASE))


def contexts(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the texts: hashes, and per context its text, first and last window start
    and anchor, as places in ``data``."""
    hashes = Hashes(data)
    n = len(data)
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return hashes, none, none, none, none
    at = np.arange(n - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    key = (grams >> K.U64(32) << K.U64(32)) | at.astype(np.uint64)
    anchor = (K.sliding_min(key, length - GRAM + 1) & K.U64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.arange(n - length + 1)
    valid = text[starts] == text[starts + length - 1]
    starts, anchor = starts[valid], anchor[valid]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return hashes, text[starts[first]], starts[first], starts[last], anchor[first]


def _anchors(length: int):
    half = (length - GRAM) // 2  # windows start 0 .. 2*half (+1) bytes before their anchor

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(2))
            for a, b, part, off in K.chunks(data, offsets):
                hashes, text, s1, s2, p = contexts(part, off, length)
                if not len(text):
                    continue
                begin = off[text]
                # in an anchor's context, some window has its right half whole, or some its left half
                right, left = p - s2 <= half, p - s1 >= half
                r = np.where(right, hashes.of(p, np.where(right, p + length - half, p)), K.U64(0))
                lft = np.where(left, hashes.of(np.where(left, p - half, p), np.where(left, p + GRAM, p)) ^ K.U64(1), K.U64(0))
                yield pa.record_batch([
                    batch.column(0).slice(a, b - a).take(pa.array(text)), batch.column(1).slice(a, b - a).take(pa.array(text)),
                    pa.array((s1 - begin).astype(np.int64)), pa.array((s2 - s1).astype(np.int32)), pa.array((p - s1).astype(np.int32)),
                    *[pa.array(x.view(np.int64)) for x in (hashes.of(s1, s2 + length), hashes.of(s1, s2 + length, 1))],
                    pa.array(r.view(np.int64), mask=~right), pa.array(lft.view(np.int64), mask=~left),
                ], names=["doc", "hash", "at", "more", "off", "f1", "f2", "r", "l"])

    return anchors


def _block_size(length: int) -> int:
    return max(1, (length - GRAM) // 8)


def _each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Hashes, list[dict], pa.RecordBatch, int]]:
    """The hashes of each text and what is wanted of it, some at a time."""
    for batch in batches:
        texts, wanted_lists = batch.column("text"), batch.column("wanted")
        for i in range(batch.num_rows):
            wanted = wanted_lists.slice(i, 1).to_pylist()[0]
            hashes = Hashes(np.frombuffer((texts[i].as_py() or "").encode(), dtype=np.uint8))
            for k in range(0, len(wanted), 500):
                yield hashes, wanted[k : k + 500], batch, i


def _blocks(length: int):
    """wanted (list of at, more, off, context, single, right, left), text -> for each block of window
    places in the shared halves, a hash of the bytes that all windows of the block have."""
    half, size = (length - GRAM) // 2, _block_size(length)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, some, _, _ in _each_text(batches):
            rows = []
            for w in some:
                low, high = w["off"] - w["more"], w["off"]  # windows start so many bytes before the anchor
                low, high = (low if w["right"] else max(low, half)), (high if w["left"] else min(high, half))
                anchor = w["at"] + w["off"]
                rows += [(anchor - g * size, anchor - min(g * size + size - 1, length - GRAM) + length, g, w["context"], w["single"]) for g in range(low // size, high // size + 1) if low <= high]
            begin, end, block, context, single = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, dtype=np.int64),) * 5
            key = hashes.of(begin, end) ^ block.astype(np.uint64)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(block.astype(np.int32)), pa.array(context.astype(np.int64)), pa.array(single.astype(bool))], names=["key", "block", "context", "single"])

    return blocks


def _windows(length: int):
    """wanted (list of at, more, off, context, single, blocks), text -> one row a suffix whose first
    ``length`` bytes are a window of the blocks."""
    size = _block_size(length)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, some, batch, i in _each_text(batches):
            get = lambda name, some=some: np.array([w[name] for w in some])
            n = get("more") + 1
            rel = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            wanted = np.repeat(get("blocks"), n) >> ((np.repeat(get("off"), n) - rel) // size) & 1 > 0
            rel, of = rel[wanted], np.repeat(np.arange(len(some)), n)[wanted]
            start = get("at")[of] + rel
            first = np.zeros(len(rel), dtype=np.int64)
            yield pa.RecordBatch.from_pydict({
                "h1": pa.array(hashes.of(start, start + length).view(np.int64)), "h2": pa.array((hashes.of(start, start + length, 1) >> K.U64(32)).astype(np.uint32).view(np.int32)),
                "context": pa.array(get("context")[of]), "rel": pa.array(rel.astype(np.int16)), "single": pa.array(get("single")[of]),
                "order": batch.column("order").slice(i, 1).take(pa.array(first)), "start": pa.array(start),
            })

    return windows


def factors(same: np.ndarray, position: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """LPF and LNF, up to ``length``, of suffixes in suffix order at different places ``position`` >= 0.
    ``same[i]`` says that suffix i+1 begins with the ``length`` bytes of suffix i. Suffixes with equal
    ones are a class, with all others a suffix shares less: its previous and next smaller (greater)
    positions are sought within the class, and where there is none the factor is told as 0."""
    if not len(position):
        return (np.zeros(0, dtype=np.int64),) * 2
    span = int(position.max()) + 1
    of = np.concatenate([[0], np.cumsum(~same)])
    rising, falling = of * span + position, (of[-1] - of) * span + position  # by class, then by position
    least, most = np.minimum.accumulate, np.maximum.accumulate
    smaller = (least(falling) < falling) | (least(rising[::-1])[::-1] < rising)  # before, or behind
    greater = (most(rising) > rising) | (most(falling[::-1])[::-1] > falling)
    return np.where(smaller, length, 0), np.where(greater, length, 0)


def _matched(keep: str, length: int):
    """Suffixes in suffix order -> context, place: those that a factor of ``length`` bytes starts at.
    Equal ones stand by position, so that across the border of a batch the row before has the previous
    smaller position and the row behind the next greater one; a batch's last row waits for that."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, tail_before = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            line = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks().to_batches()[0]
            h1, h2 = line.column("h1").to_numpy(), line.column("h2").to_numpy()
            same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            lpf, lnf = factors(same, np.arange(line.num_rows), length)
            lpf[0] = max(int(lpf[0]), length * tail_before)
            yield _hit(line.slice(0, line.num_rows - 1), lpf[:-1], lnf[:-1], keep, length)
            tail, tail_before = line.slice(line.num_rows - 1), bool(lpf[-1])
        if tail is not None:
            yield _hit(tail, np.array([length * tail_before]), np.array([0]), keep, length)

    return matched


def _hit(rows: pa.RecordBatch, lpf: np.ndarray, lnf: np.ndarray, keep: str, length: int) -> pa.RecordBatch:
    hit = lpf >= length
    if keep == "none":  # of contexts that repeat as a whole nothing more is to be told
        hit = (hit | (lnf >= length)) & rows.column("single").to_numpy(zero_copy_only=False)
    return pa.record_batch([rows.column("context"), rows.column("rel")], names=["context", "rel"]).filter(pa.array(hit))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            lists = [[{"s": a, "e": b} for a, b in merged(x)] for x in some.column("found").to_pylist()]
            yield pa.record_batch([some.column("doc"), some.column("hash"), pa.array(lists, spans)], names=["doc", "hash", "found"])


def _hint(df: DataFrame, most: int | None = None) -> DataFrame:
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def _needed(distinct: DataFrame, keep: str) -> DataFrame:
    """The contexts whose windows must be looked at, and which of their halves others share."""
    sides = F.array(F.struct(F.col("r").alias("key"), F.lit(True).alias("right")), F.struct(F.col("l").alias("key"), F.lit(False).alias("right")))
    keys = distinct.select("f1", "f2", (F.col("n") == 1).alias("single"), F.explode(sides).alias("x")).select("f1", "f2", "single", "x.*").filter("key is not null")
    shared = keys.groupBy("key").agg(F.count("*").alias("c"), F.max("single").alias("any")).filter(F.col("c") > 1)
    shared = (shared.filter("any") if keep == "none" else shared).select("key")
    return keys.join(shared, "key", "left_semi").groupBy("f1", "f2").agg(F.max("single").alias("single"), F.max("right").alias("right"), F.max(~F.col("right")).alias("left"))


def _marked(anchors: DataFrame, keep: str) -> DataFrame:
    """The places of contexts that must be looked at suffix by suffix (``needed``), or that a factor
    covers as a whole (``again``): an earlier one, which all places but the first have, or, keeping
    none, a later one, which all but the last have."""
    spark = anchors.sparkSession
    place = F.struct("doc", "hash", "at")
    distinct = written(anchors.groupBy("f1", "f2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("r").alias("r"), F.first("l").alias("l")), "contexts")
    release(spark)
    twice = distinct.filter("n > 1").select("f1", "f2", "first")
    flags = written(twice.join(_needed(distinct, keep).withColumn("needed", F.lit(True)), ["f1", "f2"], "full_outer"), "flags")
    release(spark, distinct)
    here = anchors.drop("r", "l").join(flags, ["f1", "f2"])
    again = F.col("first").isNotNull() if keep == "none" else F.coalesce(place > F.col("first"), F.lit(False))
    marked = written(here.withColumn("again", again).drop("first").filter(F.col("again") | F.col("needed")), "marked")
    release(spark, flags, anchors)
    return marked


def _texts_of(base: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The texts of which something is wanted, with the list of it."""
    per_text = written(wanted.groupBy("doc", "hash").agg(F.collect_list(F.struct(*columns)).alias("wanted")), "wanted-texts", small=True)
    few = per_text.count() <= BROADCAST_ROWS and wanted.count() <= 4 * BROADCAST_ROWS  # at most about 64 bytes each
    return base.join(F.broadcast(per_text) if few else per_text, base["doc"].eqNullSafe(per_text["doc"]) & (base["hash"] == per_text["hash"])).select(base["doc"].alias("order"), base["hash"], "wanted", "text")


def _matches(base: DataFrame, wanted: DataFrame, keep: str, length: int, kind: str) -> DataFrame:
    """``context``, ``rels``: the windows of each context that repeat."""
    spark = base.sparkSession
    texts = _texts_of(base, wanted, ["at", "more", "off", "context", "single", "right", "left"])
    keys = written(texts.select("wanted", "text").mapInArrow(_blocks(length), "key long, block int, context long, single boolean"), "blocks")
    shared = keys.groupBy("key").agg(F.count("*").alias("c"), F.max("single").alias("any")).filter(F.col("c") > 1)
    shared = written((shared.filter("any") if keep == "none" else shared).select("key"), "shared-blocks", small=True)
    kept = keys.join(_hint(shared), "key", "left_semi").groupBy("context").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("block"))).alias("blocks"))
    texts = _texts_of(base, written(wanted.join(kept, "context"), "narrowed", small=True), ["at", "more", "off", "context", "single", "blocks"])
    if keep == "first":  # a row that repeats another is no earlier place
        texts = texts.dropDuplicates(["order", "hash"])
    rows = texts.select("wanted", "text", "order").mapInArrow(_windows(length), f"h1 long, h2 int, context long, rel short, single boolean, order {kind}, start long")
    order = ["h1", "h2", F.col("order").asc_nulls_first(), "start"]
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h1").sortWithinPartitions(*order)
    hits = rows.mapInArrow(_matched(keep, length), "context long, rel short")
    return written(hits.groupBy("context").agg(F.collect_list("rel").alias("rels")), "hits", small=True)  # at most LENGTH of a context


def repeated(docs: DataFrame, keep: str = "none", length: int = LENGTH, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``hash`` (of the text) and ``found``, the byte ranges (s, e) that repeat, for every
    text that loses something."""
    if keep not in ("none", "first"):
        raise ValueError(keep)
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    anchors = written(base.mapInArrow(_anchors(length), f"doc {kind}, hash long, at long, more int, off int, f1 long, f2 long, r long, l long"), "anchors")
    marked = _marked(anchors, keep)
    one = marked.filter("needed").groupBy("f1", "f2").agg(F.min(F.struct("doc", "hash", "at", "more", "off")).alias("of"), *[F.first(c).alias(c) for c in ("single", "right", "left")])
    wanted = written(one.select("of.*", F.xxhash64("f1", "f2").alias("context"), "single", "right", "left"), "wanted", small=True)
    hits = _matches(base, wanted, keep, length, kind)
    release(spark)
    part = wanted.join(hits, "context").select("doc", "hash", F.explode(F.transform("rels", lambda r: F.struct((F.col("at") + r).alias("s"), (F.col("at") + r + length).alias("e")))).alias("x")).select("doc", "hash", "x.s", "x.e")
    whole = marked.filter("again")
    whole = whole.select("doc", "hash", F.col("at").alias("s"), (F.col("at") + F.col("more") + length).alias("e"))
    found = whole.unionByName(part).groupBy("doc", "hash").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    found = written(found.mapInArrow(_merge, f"doc {kind}, hash long, found array<struct<s:long,e:long>>"), "found")
    release(spark, marked, wanted, hits)
    return found


def merged(found: list[dict]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap, as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def removed(docs: DataFrame, keep: str = "none", length: int = LENGTH, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: its id, ``bytes`` left, ``n_bytes`` before, ``spans`` removed."""
    kind = docs.schema[doc_id].dataType.simpleString()
    found = repeated(docs, keep, length, doc_id=doc_id, text=text)
    base = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    cover = F.broadcast(found) if found.count() <= BROADCAST_ROWS and _list_bytes(found) <= 64 << 20 else found
    rows = base.join(cover, base["doc"].eqNullSafe(found["doc"]) & (base["hash"] == found["hash"]), "left").select(base["doc"], "text", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                out: list[tuple[int, list, bytes]] = []
                for t, found in zip(some.column("text").to_pylist(), some.column("found").to_pylist(), strict=True):
                    raw = (t or "").encode()
                    spans = [(x["s"], x["e"]) for x in found or []]
                    edges = [0, *(x for span in spans for x in span), len(raw)]
                    out.append((len(raw), [{"s": a, "e": b} for a, b in spans], b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
                yield pa.record_batch([some.column("doc"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array([x[2] for x in out], pa.binary())], names=["doc", "n_bytes", "spans", "bytes"])

    return rows.mapInArrow(cut, f"doc {kind}, n_bytes long, spans array<struct<s:long,e:long>>, bytes binary").withColumnRenamed("doc", doc_id)


def _list_bytes(found: DataFrame) -> int:
    return 16 * (found.agg(F.sum(F.size("found"))).first()[0] or 0)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed(table(spark, sf_dir, "documents"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("bytes", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, p, b[p:p + 399] AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS p FROM d WHERE octet_length(b) >= 400)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY hash(s), md5(s)) AS n FROM win) WHERE n > 1),
isl AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new FROM dup)) GROUP BY doc_id, g),
cut AS (SELECT doc_id, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e, sum(e - a) AS n, count(*) AS k FROM isl GROUP BY doc_id),
kept AS (SELECT d.doc_id, d.b, coalesce(n, 0) AS n, coalesce(k, 0) AS k, list_concat([1], coalesce(e, [])) AS s, list_concat(coalesce(a, []), [octet_length(b) + 1]) AS f FROM d LEFT JOIN cut USING (doc_id))
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, n::BIGINT AS n_removed, k::BIGINT AS n_spans,
  sha256(unhex(list_aggregate(list_transform(list_zip(s, f), lambda x: hex(b[x[1]:x[2] - 1])), 'string_agg', ''))) AS kept_sha256
FROM kept
"""
