"""Document fingerprints by I-Match with randomised lexicons.

A term's inverse document frequency is counted over all documents. The lexicon holds the terms
whose share of documents lies between ``LOW`` and ``HIGH``; as document frequencies sum up to the
distinct terms of all documents, at most (mean distinct terms of a document)/``LOW`` terms can be
in it, however many documents there are. That bound is checked against ``MOST_TERMS`` before the lexicon
is broadcast; a corpus of longer documents on average is refused with an error and needs a higher ``LOW``.
``SUBSETS`` randomised lexicons each hold a pseudo-random part of it, one in ``RATES`` terms in turn: dense
ones tell short texts, sparse ones long texts. Within each, a text's distinct terms are sorted and hashed;
the fingerprint is the list of these hashes (``-`` where no term is left, or, but for the sparsest, more
than ``MOST``, which hardly an edit leaves as they are). A text none of whose terms is in any subset has the hash of all its terms in every place.
Two fingerprints are alike by the share of subsets with equal hashes, of those in which either has
terms; two texts without terms are alike.

A term common in a share ``LOW`` of all documents is so in at least one task's documents; a first
pass finds each task's frequent terms, a second counts just these, exactly, over all documents.

Defined results: null text is empty; ids are integers, and one that does not read as such fails the job;
a null id comes first; repeated rows each have their row; the
last document's next is the first; a single document is its own next.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.data import table
from tidemark.llm.ordered import boundaries, part_of, text_parts
from tidemark.llm.storage import written

#: The band of document frequency, as shares of all documents: idf between ln(1/HIGH) and ln(1/LOW).
LOW, HIGH = 0.0005, 0.05
SUBSETS = 64
#: A term is in a subset with a chance of one in its rate. Small subsets survive edits of other terms.
RATES = (4, 16, 64, 256, 1024)
MOST = 2
#: Terms that are broadcast at most (8 bytes each): documents may have 8,000 distinct terms on average.
MOST_TERMS = 16_000_000
#: Candidates that the second pass looks up; beyond it all terms are counted through a shuffle.
MOST_CANDIDATES = 4_000_000


def distinct_terms(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct term hashes of each text, sorted within it, and the index of each text's first."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(t[new], minlength=len(first) - 1))]).astype(np.int64)


def _tally(kept: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(np.concatenate(more), return_counts=True)
    both = np.concatenate([kept, found])
    uniq, at = np.unique(both, return_inverse=True)
    return uniq, np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(uniq)).astype(np.int64)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms that are in a share LOW of this task's documents, and (term 0) how many documents
    and distinct terms there were."""
    kept, counts, n, terms = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 0, 0
    more: list[np.ndarray] = []
    held = 0
    for batch in batches:
        data, offsets = K.buffers(batch.column(0))
        n += batch.num_rows
        for _, _, part, off in K.chunks(data, offsets):
            h, _, _, first = K.word_hashes(part, off)
            h, _ = distinct_terms(h, first)
            more.append(h)
            held += len(h)
            terms += len(h)
            if held > 1 << 21:
                kept, counts = _tally(kept, counts, more)
                more, held = [], 0
    if more:
        kept, counts = _tally(kept, counts, more)
    frequent = kept[counts >= LOW * n]
    yield pa.record_batch([pa.array(frequent.view(np.int64)), pa.array(np.zeros(len(frequent), dtype=np.int64)), pa.array(np.zeros(len(frequent), dtype=np.int64))], names=["term", "docs", "terms"])
    yield pa.record_batch([pa.array([0]), pa.array([n]), pa.array([terms])], names=["term", "docs", "terms"])


def lexicon(docs: DataFrame, *, text: str = "text") -> tuple[np.ndarray, int]:
    """The sorted hashes of the terms in the band, and the number of documents."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("_text"))
    found = texts.mapInArrow(_frequent, "term long, docs long, terms long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms"))
    found = written(found, "terms", small=True)
    total = found.filter("term = 0").first()
    n = total["docs"] if total else 0
    if not n:
        return np.zeros(0, dtype=np.uint64), 0
    if total["terms"] / n / LOW > MOST_TERMS:
        raise ValueError(f"{total['terms'] / n:.0f} distinct terms a document: the lexicon may be too large to broadcast")
    if found.count() <= MOST_CANDIDATES:
        candidates = spark.sparkContext.broadcast(np.sort(found.filter("docs = 0").select("term").toArrow().column(0).to_numpy().view(np.uint64)))
        df = texts.mapInArrow(_counter(candidates), "term long, n long")
    else:
        df = texts.mapInArrow(_count_all, "term long, n long")
    df = df.groupBy("term").agg(F.sum("n").alias("n"))
    # at most (mean distinct terms of a document) / LOW rows
    band = df.filter((F.col("n") >= LOW * n) & (F.col("n") <= max(HIGH * n, 1))).select("term").coalesce(8).toArrow().column(0).to_numpy()
    return np.sort(band.view(np.uint64)), n


def _count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of all terms, summed over about two million at a time."""
    more: list[np.ndarray] = []
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def row() -> pa.RecordBatch:
        terms, counts = _tally(*none, more)
        return pa.record_batch([pa.array(terms.view(np.int64)), pa.array(counts)], names=["term", "n"])

    for batch in batches:
        data, offsets = K.buffers(batch.column(0))
        for _, _, part, off in K.chunks(data, offsets):
            h, _, _, first = K.word_hashes(part, off)
            more.append(distinct_terms(h, first)[0])
            if sum(map(len, more)) > 1 << 21:
                yield row()
                more = []
    if more:
        yield row()


def _counter(candidates):
    """Counts the documents of each candidate term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = candidates.value
        counts = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            data, offsets = K.buffers(batch.column(0))
            for _, _, part, off in K.chunks(data, offsets):
                h, _, _, first = K.word_hashes(part, off)
                h, _ = distinct_terms(h, first)
                at = np.searchsorted(terms, h)
                at[at == len(terms)] = 0
                if len(terms):
                    counts += np.bincount(at[terms[at] == h], minlength=len(terms))
        some = counts > 0
        yield pa.record_batch([pa.array(terms[some].view(np.int64)), pa.array(counts[some])], names=["term", "n"])

    return count


def fingerprints(hashes: np.ndarray, first: np.ndarray, terms: np.ndarray, subsets: int = SUBSETS, rates: Sequence[int] = RATES) -> np.ndarray:
    """A (texts x subsets) array of 32-bit hashes; 0 where a subset keeps no term, or too many."""
    h, first = distinct_terms(hashes, first)
    all_terms = h
    n = len(first) - 1
    out = np.zeros((n, subsets), dtype=np.uint32)
    at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
    inside = terms[at] == h if len(terms) else np.zeros(len(h), dtype=bool)
    h, text = h[inside], np.repeat(np.arange(n), np.diff(first))[inside]
    for k in range(subsets):
        coin = K.mix(h ^ K.U64(0xA5A5A5A5A5A5A5A5 + k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        rate = rates[k % len(rates)]
        some = coin >> K.U64(40) < K.U64((1 << 24) // rate)
        if rate != rates[-1]:
            some[some] = np.bincount(text[some], minlength=n)[text[some]] <= MOST
        # terms are sorted within a text: a polynomial of their order is one hash of the sorted list
        t, x = text[some], K.mix(coin[some])
        begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, dtype=np.int64)
        if not len(begin):
            continue
        place = np.arange(len(t)) - np.repeat(begin, np.diff(np.r_[begin, len(t)]))
        sums = np.add.reduceat(x * K.powers(K.BASE, int(place.max()) + 1)[place], begin)
        out[t[begin], k] = np.maximum((K.mix(sums) >> K.U64(32)).astype(np.uint32), 1)
    bare = np.flatnonzero(~out.any(axis=1) & (np.diff(first) > 0))
    for i in bare.tolist():
        h = all_terms[first[i] : first[i + 1]]
        out[i] = max(int(K.mix(np.array([(K.mix(h) * K.powers(K.BASE, len(h))).sum()], dtype=np.uint64))[0] >> K.U64(32)), 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; 1 where neither side has any term in a subset."""
    either = (a > 0) | (b > 0)
    some = either.sum(axis=1)
    return np.where(some > 0, ((a == b) & either).sum(axis=1) / np.maximum(some, 1), 1.0)


def told(prints: np.ndarray) -> list[str]:
    return [",".join("-" if not v else f"{v:08x}" for v in row) for row in prints.tolist()]


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness to it and to the next
    document. Documents are cut into ranges of ids; each range also gets the first of the next."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    terms, n = lexicon(rows, text="_text")
    if not n:
        return spark.createDataFrame([], SCHEMA)
    cuts = boundaries(rows, "_id", text_parts(docs))
    parts = len(cuts) + 1
    placed = rows.withColumn("_part", part_of(F.col("_id"), cuts)).withColumn("_extra", F.lit(0))
    # each cut is the first id of its part; the very first row also follows the last
    order = lambda df: df.orderBy(F.col("_id").asc_nulls_first(), F.xxhash64("_text")).limit(1)
    ahead = order(rows).withColumn("_part", F.lit(parts - 1))
    if cuts:
        starts = rows.filter(F.col("_id").isin(cuts) if len(cuts) <= 1000 else F.col("_id").isNotNull())
        if len(cuts) > 1000:
            starts = starts.join(F.broadcast(spark.createDataFrame([(c,) for c in cuts], "_id long")), "_id")
        first = starts.groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
        ahead = first.withColumn("_part", part_of(F.col("_id"), cuts) - 1).unionByName(ahead)
    placed = placed.unionByName(ahead.withColumn("_extra", F.lit(1)))
    placed = placed.repartitionById(parts, "_part").sortWithinPartitions("_part", "_extra", F.col("_id").asc_nulls_first(), F.xxhash64("_text"))
    shared = spark.sparkContext.broadcast(terms)

    def prints(texts: list[str]) -> np.ndarray:
        data, offsets = K.buffers(pa.array([t.encode() for t in texts], pa.large_binary()))
        out = np.zeros((len(texts), SUBSETS), dtype=np.uint32)
        for a, b, part, off in K.chunks(data, offsets):
            h, _, _, first = K.word_hashes(part, off)
            out[a:b] = fingerprints(h, first, shared.value)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # id, text, extra: waits for its next
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids, texts, extra = some.column("_id").to_pylist(), some.column("_text").to_pylist(), some.column("_extra").to_pylist()
                part = some.column("_part").to_pylist()
                line = ([last] if last else []) + list(zip(ids, texts, extra, part, strict=True))
                last = line[-1]
                pairs = [(a, b) for a, b in zip(line, line[1:], strict=False) if not a[2]]
                if pairs:
                    own, after = [a[1] for a, _ in pairs], [b[1] for _, b in pairs]
                    edited = [_edited(a, b) for a, b in zip(own, after, strict=True)]
                    x, y, z = prints([*own, after[-1]]), prints(edited), None
                    z = np.concatenate([x[1:-1], x[-1:]]) if all(p[1] is q[0] for p, q in zip(pairs, pairs[1:], strict=False)) else prints(after)
                    x = x[:-1]
                    yield pa.record_batch([
                        pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                        pa.array(told(x)), pa.array(told(y)), pa.array(likeness(x, y)), pa.array(likeness(x, z)),
                    ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return placed.mapInArrow(run, SCHEMA)


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
