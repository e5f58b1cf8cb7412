"""Token-ID output: Arrow IPC stream-files of fixed-size lists, for zero-copy random access.

Documents stand in one order, are cut into parts, and each part becomes one shard of two files:

``tokens-NNNNNN.arrow``  record batches of ``BATCH`` rows (the last fewer) with ``input_ids`` and
    ``attention_mask``, both fixed-size lists of ``length`` values. All rows but a shard's last are
    full, so row i lies in batch i // BATCH at a place known without reading; memory-mapped, a
    sequence and its mask are views of the file.
``index-NNNNNN.arrow``  ``doc_id``, ``start`` (ids of the shard before the document), ``n_tokens``.

A shard is written under a name of its own and then renamed, and its content follows from its rows
alone, so a task that runs again after a lost executor replaces it with the same bytes. Files lie
in the shared folder; ``pyarrow.fs`` opens it by its URI. The driver holds one row a shard
(at most ``ordered.MOST_PARTS``).

Defined results: null text is empty; every document ends with ``end_id``; ids are integers, and one that
does not read as such fails the job; a null id comes first; repeated rows are encoded each; an empty table
makes no shard.
"""
from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.data import table
from tidemark.llm.ordered import MOST_PARTS, boundaries, part_of, text_parts
from tidemark.llm.storage import fresh_path

LENGTH = 2048
BATCH = 64
END_ID = 2
#: Pieces of text between blanks are encoded once a worker; at most about twice so many are kept, none longer.
CACHE_PIECES, CACHE_CHARS = 750_000, 48

#: Letters, then ASCII marks without apostrophe: the tokenizer cuts there too.
WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]*)")

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Encodes with a tokenizer file. Blanks end a word for the tokenizer, so a text's ids are
    those of its pieces between blanks; frequent pieces come from a bounded cache. A full cache becomes the
    old one, from which pieces that occur again are taken over, and the old one before it goes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # With a mark at words' ends (and lower-casing), words can be encoded many at a time.
        model = json.loads(self.tokenizer.to_str())
        mark, steps = model["model"].get("end_of_word_suffix"), [n.get("type") for n in (model.get("normalizer") or {}).get("normalizers", [])]
        self.ends_word = None
        if mark and "Lowercase" in steps:
            self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.ends_word[i] = token.endswith(mark)

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Of words of letters only: together, and cut where the tokenizer marks a word's end."""
        out: list[bytes] = []
        for at in range(0, len(words), 400):
            some = words[at : at + 400]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * self.dtype.itemsize
            if len(ends) != len(some):  # a letter that the tokenizer takes for more than one word
                out += self._encode(some)
                continue
            raw, begin = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[begin:end])
                begin = end
        return out

    def _missing(self, pieces: set[str]) -> set[str]:
        """Those of ``pieces`` that neither cache has; what the old one has is taken over."""
        cache, old = self.cache, self.old
        missing = pieces.difference(cache)
        new = missing.difference(old)
        cache.update((p, old[p]) for p in missing.difference(new))
        return new

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Encodes pieces that are in no cache; short ones go into the cache, long ones are returned."""
        cache, words, plain, long = self.cache, {}, [], []
        for p in self._missing(pieces):
            if len(p) > CACHE_CHARS:
                long.append(p)
                continue
            m = WORD_AND_MARKS.fullmatch(p) if self.ends_word is not None else None
            if m and m[1].isalpha():
                words[p] = (m[1].lower() if m[1].isascii() else m[1], m[2])
            else:
                plain.append(p)
        cache.update(zip(plain, self._encode(plain), strict=True))
        tails = list(self._missing({t for _, t in words.values()}))
        cache.update(zip(tails, self._encode(tails), strict=True))
        new = list(self._missing({w for w, _ in words.values()}))
        cache.update(zip(new, self._encode_words(new), strict=True))
        for p, (word, tail) in words.items():
            cache[p] = cache[word] + cache[tail]
        return dict(zip(long, self._encode(long), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of ``dtype``."""
        if len(self.cache) > CACHE_PIECES:
            self.old, self.cache = self.cache, {}
        cache = self.cache
        pieces = [t.replace("\n", " ").split(" ") for t in texts]
        long = self._learn(set().union(*pieces))
        if not long:
            return [b"".join(map(cache.__getitem__, p)) for p in pieces]
        return [b"".join([cache[x] if x in cache else long[x] for x in p]) for p in pieces]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, folder: str, shard: int, dtype: np.dtype, length: int) -> None:
        self.fs, self.folder = _filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.shard, self.dtype, self.length = shard, dtype, length
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("attention_mask", pa.list_(pa.bool_(), length))])
        self.mark = uuid.uuid4().hex
        self.out = self.fs.open_output_stream(f"{self.folder}/.tokens-{shard:06d}.{self.mark}")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.left: list[bytes] = []
        self.left_bytes = self.total = 0
        self.ids: list = []
        self.starts: list[int] = []
        self.counts: list[int] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.ids.append(doc_id)
        self.starts.append(self.total)
        self.counts.append(n)
        self.total += n
        self.left.append(ids)
        self.left_bytes += len(ids)
        if self.left_bytes >= BATCH * self.length * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.left), dtype=self.dtype)
        step, at = BATCH * self.length, 0
        while len(values) - at >= step or (last and at < len(values)):
            part = values[at : at + step]
            at += len(part)
            rows = -(-len(part) // self.length)
            pad = rows * self.length - len(part)
            mask = np.ones(rows * self.length, dtype=bool)
            if pad:
                mask[len(part) :] = False
                part = np.concatenate([part, np.zeros(pad, dtype=self.dtype)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.left = [values[at:].tobytes()]
        self.left_bytes = len(self.left[0])

    def close(self) -> dict:
        self._flush(True)
        self.writer.close()
        self.out.close()
        index = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "start": pa.array(self.starts, pa.int64()), "n_tokens": pa.array(self.counts, pa.int64())})
        with self.fs.open_output_stream(f"{self.folder}/.index-{self.shard:06d}.{self.mark}") as out, pa.ipc.new_file(out, index.schema) as writer:
            writer.write_table(index)
        for kind in ("index", "tokens"):
            self.fs.move(f"{self.folder}/.{kind}-{self.shard:06d}.{self.mark}", f"{self.folder}/{kind}-{self.shard:06d}.arrow")
        return {"shard": self.shard, "n_docs": len(self.ids), "n_tokens": self.total}


class Shard:
    """Random access to a written shard; on a local file system every array is a view of it."""

    def __init__(self, folder: str, shard: int) -> None:
        fs, path = _filesystem(folder)
        local = type(fs).__name__ == "LocalFileSystem"
        read = lambda kind: pa.ipc.open_file(pa.memory_map(p) if local else fs.open_input_file(p)) if (p := f"{path}/{kind}-{shard:06d}.arrow") else None
        self.tokens, self.index = read("tokens"), read("index").read_all()
        self.length = self.tokens.schema.field("input_ids").type.list_size
        self._at, self._batch = -1, None

    def _batch_of(self, i: int):
        if self._at != i:
            self._at, self._batch = i, self.tokens.get_batch(i)
        return self._batch

    def sequence(self, i: int) -> np.ndarray:
        """Row i, a view of the file."""
        return self._batch_of(i // BATCH).column("input_ids").values.to_numpy()[i % BATCH * self.length :][: self.length]

    def mask(self, i: int) -> pa.Array:
        """The mask of row i, bits that are a view of the file."""
        return self._batch_of(i // BATCH).column("attention_mask").values.slice(i % BATCH * self.length, self.length)

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids start .. start+n, as views of the batches that hold them."""
        step = BATCH * self.length
        while n > 0:
            values = self._batch_of(start // step).column("input_ids").values.to_numpy()
            part = values[start % step : start % step + n]
            yield part
            start += len(part)
            n -= len(part)


def encode(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", part: Column | None = None, parts: int = 0, order: tuple[Column, ...] = (), end_id: int = END_ID, length: int = LENGTH) -> tuple[str, list[dict]]:
    """Writes the shards of ``docs`` and returns their folder and, in order, a dict a shard with
    ``shard``, ``n_docs``, ``n_tokens`` and ``first`` (ids of all shards before it). The order is
    ascending ``doc_id`` unless ``part`` (of ``parts``) and ``order`` within a part are given."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    if part is None:
        cuts = boundaries(docs, doc_id, text_parts(docs))
        part, parts, order = part_of(F.col(doc_id), cuts), len(cuts) + 1, (F.col(doc_id), F.xxhash64(text))
    names = [f"_order{i}" for i in range(len(order))]
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), part.cast("int").alias("_part"), *[o.alias(n) for o, n in zip(order, names, strict=True)])
    rows = rows.repartitionById(parts, "_part").sortWithinPartitions("_part", *[F.col(n).asc_nulls_first() for n in names]).select("_id", "_text", "_part")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = Encoder.of(tokenizer), None
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        done = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                ids, texts, shards = (some.column(i).to_pylist() for i in range(3))
                for i, shard, tokens in zip(ids, shards, encoder.encode([t or "" for t in texts]), strict=True):
                    if writer is None or writer.shard != shard:
                        done += [writer.close()] if writer else []
                        writer = ShardWriter(folder, shard, encoder.dtype, length)
                    writer.add(i, tokens + end)
        done += [writer.close()] if writer else []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    shards = sorted((r.asDict() for r in rows.mapInArrow(write, "shard int, n_docs long, n_tokens long").collect()), key=lambda r: r["shard"])
    first = 0
    for s in shards:
        s["first"] = first
        first += s["n_tokens"]
    return folder, shards


def encode_in_file_order(docs: DataFrame, tokenizer: str, **options) -> tuple[str, list[dict]]:
    """Encodes a table read from files in the order of their paths and of the rows within them. Each file
    becomes a shard, or, of more than ``MOST_PARTS`` files, consecutive ones do. An error for rows that
    have no files, as their order is not known."""
    if not docs.inputFiles():
        if not docs.isEmpty():
            raise ValueError("rows that were not read from files have no file order")
        return encode(docs, tokenizer, **options)
    paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())  # a row a file
    number = docs.sparkSession.createDataFrame([(i, i * min(MOST_PARTS, len(paths)) // len(paths), p) for i, p in enumerate(paths)], "_file int, _part int, _path string")
    rows = docs.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.join(F.broadcast(number), "_path")
    return encode(rows, tokenizer, part=F.col("_part"), parts=min(MOST_PARTS, max(1, len(paths))), order=(F.col("_file"), F.col("_row")), **options)


def digest(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """Reads the shards back: per document its id, place, length and the checksum of its ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(folder, number)
                for some in shard.index.to_batches(4096):
                    starts, counts = some.column("start").to_numpy(), some.column("n_tokens").to_numpy()
                    sums = np.empty(len(starts), dtype=np.int64)
                    for i, (s, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
                        crc = 0
                        for piece in shard.pieces(s, n):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        sums[i] = crc
                    yield pa.record_batch([some.column("doc_id"), pa.array(starts + first), some.column("n_tokens"), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame([(s["shard"], s["first"]) for s in shards], "shard int, first long")
    return rows.repartition(len(shards)).mapInArrow(read, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark, *encode(table(spark, sf_dir, "documents"), vocabulary()))
