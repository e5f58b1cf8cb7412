"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of ``WORDS`` words. Equal sets are joined first; what follows
works on distinct sets. ``RUNS`` runs each put a set into a bucket by one of its minimum hashes, a
sampled token it shares with similar sets. A bucket of more than ``LIMIT`` sets is split again: for
each further minimum hash that the bucket's path samples (``CHILDREN`` expected), its sets go to the
bucket of their token. Small buckets are compared by brute force, exactly. Two sets of similarity s
part in a run with a chance below 1 - s/2, and ``RUNS`` follows from that and the target recall.

A bucket that a split would leave together, as the share ``ALIKE`` of its sets agree in further minimum
hashes (``PROBES``), or that ``DEPTH`` splits left large, holds sets that are alike in earnest: they are
compared in pairs of blocks of ``BLOCK`` sets, for which each of n sets is listed n/BLOCK times, as often
as its row of n comparisons needs. Within a bucket, only groups joined by agreeing
signatures are compared set by set, and groups with the same members once. A pair that
several buckets hold counts in the least of them: each set carries the list of its buckets. A bucket
gives one row a set (its links, and the least set it reaches in this bucket), never pairs.

Defined results: null text is empty; texts without words link to nothing; texts of fewer words than
``WORDS`` have one run of them all; repeated rows are copies of each other; the class of a document
is the least id linked to it through any chain; a null id has class null where it is alone.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.components import components
from tidemark.llm.data import table
from tidemark.llm.imatch import distinct_terms
from tidemark.llm.storage import few_files, written

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - SIMILARITY / 2))
SIGNATURE = 48
CHILDREN = 1.67
LIMIT, BLOCK = 256, 1000
DEPTH, ALIKE, PROBES = 4, 0.7, (20, 30, 40)
#: Sets are compared where this share of minimum hashes agrees, or a chain of such sets joins them:
#: 4.5 standard deviations below a similarity of 0.8.
AGREE = 0.54
BROADCAST_ROWS = 500_000
SEEDS = K.mix(np.arange(1, 2 * SIGNATURE + 1, dtype=np.uint64) * K.U64(K.BASE)) | K.U64(1)


def shingled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted within it, and the index of each text's first."""
    h, _, _, first = K.word_hashes(data, offsets)
    s, text = K.shingle_hashes(h, first, WORDS)
    return distinct_terms(s, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(offsets) - 1))]).astype(np.int64))


def set_ids(shingles: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each set; None for an empty one."""
    sums = [np.concatenate([[K.U64(0)], np.cumsum(K.mix(shingles * K.U64(m)))]) for m in (3, 5)]
    out = np.stack([x[first[1:]] - x[first[:-1]] for x in sums], axis=1)
    some = np.diff(first) > 0
    return [row.tobytes() if ok else None for row, ok in zip(out, some.tolist(), strict=True)]


def signatures(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SIGNATURE minimum hashes of each set as 32-bit values."""
    n = len(first) - 1
    out = np.zeros((n, SIGNATURE), dtype=np.uint32)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        for c in range(SIGNATURE):
            h = (shingles ^ SEEDS[c]) * SEEDS[SIGNATURE + c]
            out[some, c] = np.minimum.reduceat(h, first[some]) >> K.U64(32)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.buffers(batch.column(1))
        for a, b, part, off in K.chunks(data, offsets):
            s, first = shingled(part, off)
            sig = signatures(s, first)
            yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(set_ids(s, first), pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc", "hash", "set", "sig"])


def _paths(sig: np.ndarray, path: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Row and path of each child. At the root, run r follows minimum hash r."""
    if path is None:
        run = np.arange(RUNS, dtype=np.uint64)[None, :]
        child = K.mix((sig[:, :RUNS].astype(np.uint64) + K.U64(1)) * K.U64(K.BASE) + run)
        return np.repeat(np.arange(len(sig)), RUNS), child.ravel()
    coin = K.mix(path[:, None] ^ SEEDS[None, :SIGNATURE])
    row, c = np.nonzero((coin >> K.U64(11)).astype(np.float64) < CHILDREN / SIGNATURE * (1 << 53))
    return row, K.mix(path[row] + (sig[row, c].astype(np.uint64) + K.U64(1)) * K.U64(K.BASE) + c.astype(np.uint64))


def _split(root: bool):
    """set, path, sig -> the set in each child of its path."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(some.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, SIGNATURE)
                path = None if root else some.column("path").to_numpy().view(np.uint64)
                row, child = _paths(sig, path)
                yield pa.record_batch([some.column("set").take(pa.array(row)), pa.array(child.view(np.int64))], names=["set", "path"])

    return split


def _alike(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``path`` of the buckets whose sets agree in the probed minimum hashes, of which a hash into 16
    values is counted: on average over the probes, the share ``ALIKE`` has the most frequent one."""
    digit = {c: F.substring(F.hex(F.substring("sig", 4 * c + 1, 1)), 2, 1) for c in PROBES}
    probed = sets.select("set", *[digit[c].alias(f"v{c}") for c in PROBES])
    tally = {(c, d): F.sum((F.col(f"v{c}") == d).cast("int")).alias(f"k{c}{d}") for c in PROBES for d in "0123456789ABCDEF"}
    counts = rows.join(probed, "set").groupBy("path", "n").agg(*tally.values())  # added up within each task first
    most = sum((F.greatest(*[F.col(f"k{c}{d}") for d in "0123456789ABCDEF"]) for c in PROBES), F.lit(0)) / len(PROBES)
    return counts.filter(most >= ALIKE * F.col("n")).select("path")


def buckets(sets: DataFrame) -> DataFrame:
    """``set``, ``bucket``: which sets meet in which brute-force comparison. ``sets`` has ``set``
    and ``sig``."""
    rows = sets.mapInArrow(_split(True), "set binary, path long")
    leaves, blocked = [], []
    for depth in range(DEPTH + 1):
        if depth:
            rows = written(rows, f"paths-{depth}", small=True)
        big = written(rows.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > LIMIT), "big", small=True)
        n_big = big.count()
        hint = F.broadcast if n_big <= BROADCAST_ROWS else (lambda x: x)
        small = rows.join(hint(big.select("path")), "path", "left_anti") if n_big else rows
        met = small.groupBy("path").agg(F.sort_array(F.collect_set("set")).alias("sets")).filter(F.size("sets") > 1)  # at most LIMIT
        leaves.append(met.select(F.xxhash64("sets").alias("bucket"), "sets"))
        if not n_big:
            break
        rows = written(rows.join(hint(big), "path"), "large", small=True)
        if depth == DEPTH:
            blocked.append(_in_blocks(rows))
        else:
            alike = hint(written(_alike(rows, sets), "alike", small=True))
            blocked.append(_in_blocks(rows.join(alike, "path", "left_semi")))
            rows = rows.join(alike, "path", "left_anti").select("set", "path").join(sets, "set").mapInArrow(_split(False), "set binary, path long")
    out = _exploded(leaves)
    for more in blocked:
        out = out.unionByName(more)
    return out.distinct() if blocked else out


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Each set of a bucket of ``n`` in one bucket for every pair of blocks that its own is in."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    pairs = rows.withColumn("own", F.pmod(F.xxhash64("set", "path"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return pairs.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "set")


def _exploded(leaves: list[DataFrame]) -> DataFrame:
    out = leaves[0]
    for more in leaves[1:]:
        out = out.union(more)
    return out.dropDuplicates(["bucket"]).select("bucket", F.explode("sets").alias("set"))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets in order -> the groups within each that pairs of agreeing signatures connect."""
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        ids = [h[1] for h in held]
        sig = np.frombuffer(b"".join(h[2] for h in held), dtype=np.uint32).reshape(-1, SIGNATURE)
        m = len(ids)
        same = np.zeros((m, m), dtype=np.uint8)
        for c in range(SIGNATURE):
            same += sig[:, None, c] == sig[None, :, c]
        label = _labels(same >= AGREE * SIGNATURE)
        groups: dict[int, list[bytes]] = {}
        for x, i in zip(label.tolist(), ids, strict=True):
            groups.setdefault(x, []).append(i)
        return pa.record_batch([pa.array([sorted(g) for g in groups.values() if len(g) > 1], pa.list_(pa.binary()))], names=["sets"])

    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            some = batch.slice(at, 2000)
            for row in zip(*(some.column(c).to_pylist() for c in ("bucket", "set", "sig")), strict=True):
                if held and held[0][0] != row[0]:
                    yield done()
                    held = []
                held.append(row)
    if held:
        yield done()


def _labels(linked: np.ndarray) -> np.ndarray:
    """The least index that each row of a symmetric matrix reaches."""
    m = len(linked)
    np.fill_diagonal(linked, True)
    label = np.arange(m, dtype=np.int32)
    while True:
        new = np.where(linked, label[None, :], np.int32(m)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 blocks over shared shingles."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    index = np.cumsum(counts > 1) - 1
    row, column = row[shared], index[column[shared]]
    out = np.zeros((m, m), dtype=np.float32)
    width = max(256, (1 << 22) // m)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        block = np.zeros((m, width), dtype=np.float32)
        block[row[lo:hi], column[lo:hi] - a] = 1
        out += block @ block.T
    return out


def _linked(bucket: int, sets: list[np.ndarray], ids: list[bytes], copies: np.ndarray, where: list[list[int]], similarity: float) -> tuple[np.ndarray, list[bytes]]:
    """Links of each set that no lesser bucket counts, and the least set each reaches here."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    inter = _intersections(sets)
    alike = np.empty((m, m), dtype=bool)
    for i in range(0, m, 256):
        n = inter[i : i + 256].astype(np.float64)
        alike[i : i + 256] = n >= similarity * (sizes[i : i + 256, None] + sizes[None, :] - n) - 1e-9
    np.fill_diagonal(alike, False)
    root = [ids[x] for x in _labels(alike.copy()).tolist()]  # ids are sorted
    lesser: dict[int, list[int]] = {}
    for i, mine in enumerate(where):
        for b in mine:
            if b < bucket:
                lesser.setdefault(b, []).append(i)
    for members in lesser.values():
        if len(members) > 1:
            alike[np.ix_(members, members)] = False
    return alike @ copies, root


def _compare(similarity: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            links, root = _linked(held[0][0], [np.frombuffer(h[2], np.uint64) for h in held], [h[1] for h in held], np.array([h[3] for h in held]), [h[4] for h in held], similarity)
            return pa.record_batch([pa.array([h[1] for h in held], pa.binary()), pa.array(links), pa.array(root, pa.binary())], names=["set", "links", "root"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for row in zip(*(some.column(c).to_pylist() for c in ("bucket", "set", "shingles", "copies", "buckets")), strict=True):
                    if held and held[0][0] != row[0]:
                        yield done()
                        held = []
                    held.append(row)
        if held:
            yield done()

    return compare


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.buffers(batch.column(0))
        for _, _, part, off in K.chunks(data, offsets):
            s, first = shingled(part, off)
            yield pa.record_batch([pa.array(set_ids(s, first), pa.binary()), pa.array([s[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], names=["set", "shingles"])


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links`` (other documents of at least this similarity, copies
    counted), ``copy_of`` (the least id with the same set); one row a row of ``docs``."""
    return _joined(docs, doc_id, text, similarity).select(F.col("doc").alias(doc_id), "class_id", "n_links", "copy_of")


def _joined(docs: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """The rows of join(), with ``hash`` of the text and ``label`` of the class (null: no words)."""
    base = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    described = written(base.mapInArrow(_describe, f"doc {docs.schema[doc_id].dataType.simpleString()}, hash long, set binary, sig binary"), "sets")
    sets = described.filter("set is not null").groupBy("set").agg(F.min("doc").alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    sets = written(sets, "distinct-sets", small=True)
    met = buckets(sets.select("set", "sig"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    likely = met.join(sets.select("set", "sig"), "set").repartition(parts, "bucket").sortWithinPartitions("bucket", "set").mapInArrow(_likely, "sets array<binary>")
    likely = likely.select(F.xxhash64("sets").alias("bucket"), "sets").dropDuplicates(["bucket"]).select("bucket", F.explode("sets").alias("set"))
    of = likely.groupBy("set").agg(F.sort_array(F.collect_set("bucket")).alias("buckets")).join(sets.select("set", "least", "copies"), "set")
    of = written(of, "met")
    ids = of.select(F.col("least").alias("doc")).distinct()
    hint = F.broadcast if of.count() <= BROADCAST_ROWS else (lambda x: x)
    shingles = base.join(hint(ids), base["doc"].eqNullSafe(ids["doc"]), "left_semi").select("text").mapInArrow(_texts, "set binary, shingles binary").dropDuplicates(["set"])
    compared = of.join(shingles, "set").select(F.explode("buckets").alias("bucket"), "set", "shingles", "copies", "buckets")
    found = compared.repartition(parts, "bucket").sortWithinPartitions("bucket", "set").mapInArrow(_compare(similarity), "set binary, links long, root binary")
    found = written(found, "compared")
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    labels = components(found.select("set", "root").filter("set != root").distinct(), "set", "root")
    known = sets.select("set", "least", "copies").join(links, "set", "left").join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    known = written(known, "known", small=True)
    classes = known.groupBy("label").agg(F.min("least").alias("class_id"))
    known = known.join(classes, "label").select("set", "label", F.col("least").alias("copy_of"), "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = described.select("doc", "hash", "set").join(known, "set", "left")
    alone = F.col("set").isNull()
    return out.select("doc", "hash", "label", F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("doc")).otherwise(F.col("copy_of")).alias("copy_of"))


def representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the one of the least id (and hash of its text, where
    ids repeat). Texts without words stay; of rows equal in id and text one stays."""
    rows = written(_joined(docs, doc_id, text, similarity).select("doc", "hash", "label"), "classes", small=True)
    key = F.struct(F.col("doc").isNull().alias("none"), "doc", "hash")
    least = rows.filter("label is not null").groupBy("label").agg(F.min(key).alias("least"))
    gone = rows.join(least, "label").filter(~key.eqNullSafe(F.col("least"))).select(F.col("doc").alias("_gone"), F.col("hash").alias("_gone_hash")).distinct()
    gone = written(gone, "gone", small=True)
    hint = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    named = docs.withColumn("_text_hash", F.xxhash64(text))
    kept = named.join(hint, named[doc_id].eqNullSafe(gone["_gone"]) & (named["_text_hash"] == gone["_gone_hash"]), "left_anti")
    if not rows.groupBy("doc", "hash").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        kept = kept.dropDuplicates([doc_id, "_text_hash"])
    return kept.select(*docs.columns)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(join(table(spark, sf_dir, "documents")))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(w[p:p + 4], 'string_agg', ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT i.x, i.y, a.n = i.i AND b.n = i.i AS copy
  FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL) i
  JOIN n a ON a.doc_id = i.x JOIN n b ON b.doc_id = i.y
  WHERE i.i >= 0.8::DOUBLE * (a.n + b.n - i.i) - 1e-9),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, p.y FROM reach r JOIN p ON p.x = r.other)
SELECT w.doc_id, c.class_id, coalesce(l.n_links, 0)::BIGINT AS n_links, least(w.doc_id, coalesce(l.copy_of, w.doc_id)) AS copy_of
FROM w JOIN (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY 1) c USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links, min(y) FILTER (copy) AS copy_of FROM p GROUP BY 1) l USING (doc_id)
"""
