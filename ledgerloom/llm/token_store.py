"""Operator 10: token ids in binary blocks, compressed document by document with one shared zstandard dictionary.

A block is ``HEADER | doc_ids | n_tokens | frame ends | frames``, all little-endian: the header holds a magic string, the
sha256 of the dictionary, the numbers of documents, the width of an id and the block's place; a document's
frame is found by its index entry alone and decompressed by itself. Blocks hold ascending doc_ids (nulls first).

A store is a folder with two Parquet tables, so any store that Spark reaches will do: ``dictionary`` (one row: its sha256 and its bytes) and ``blocks``
(each with the first and last doc_id in it, so that a document's block is found by Parquet's statistics). It holds all that a reader
needs: another process opens it with ``open_store``, or with pyarrow and ``BlockReader`` alone.

Defined results: a null or empty text has the end id alone; repeated rows and doc_ids are all written, equal doc_ids side by
side; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import scratch

from .chunks import encoder
from .common import id_and_text, materialize, sample_texts, slices

MAGIC = b"LLTOKEN1"
#: magic, dictionary's sha256, documents, bytes of an id, 1 if the first doc_id is null for `nulls` documents
HEADER = struct.Struct("<8s32sIII")
FRAMES = "doc_id long, n_tokens long, frame binary"
BLOCKS = "shard int, number int, first_token long, n_tokens long, first_id long, last_id long, block binary"
DICTIONARY = "sha256 string, dictionary binary"
ENTRIES = "shard int, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long"


def id_type(path: str) -> np.dtype:
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, kind: np.dtype, size: int, sample: int, sample_chars: int) -> bytes:
    """A zstandard dictionary from the serialized ids of ``sample`` distinct texts, those of the least hashes, of each the first ``sample_chars``
    characters; empty where these are too few to train one. The sample sets how small frames get, never what they hold."""
    texts = [t for t in sample_texts(docs.select(F.substring("text", 1, sample_chars).alias("text")), sample) if t]
    if not texts:
        return b""
    ids, ends = encoder(tokenizer, end_id).encode(pa.array(texts))
    samples = [x.astype(kind).tobytes() for x in np.split(ids, ends[:-1])]
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


class BlockWriter:
    def __init__(self, dictionary: bytes, width: int):
        self.digest, self.width = hashlib.sha256(dictionary).digest(), width
        self.rows: list[tuple[int | None, int, bytes]] = []
        self.size = 0

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.rows.append((doc_id, n, frame))
        self.size += len(frame)

    def take(self) -> bytes:
        ids, counts, frames = zip(*self.rows, strict=True)
        nulls = sum(i is None for i in ids)
        index = (np.array([i or 0 for i in ids], "<i8"), np.array(counts, "<i8"), np.cumsum([len(f) for f in frames]).astype("<i8"))
        self.rows, self.size = [], 0
        return HEADER.pack(MAGIC, self.digest, len(ids), self.width, nulls) + b"".join(x.tobytes() for x in index) + b"".join(frames)


class BlockReader:
    """Reads a block; ``ids(i)`` decompresses document ``i`` alone."""

    def __init__(self, block: bytes, dictionary: bytes):
        magic, digest, n, width, nulls = HEADER.unpack_from(block)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a block of this dictionary")
        self.kind, at = np.dtype(f"<u{width}"), HEADER.size
        self.doc_ids, self.counts, self.ends = (np.frombuffer(block, "<i8", n, at + 8 * n * k) for k in range(3))
        self.nulls, self.frames = nulls, memoryview(block)[at + 24 * n :]
        self.library = zstandard.ZstdDecompressor(**_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.counts)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else int(self.doc_ids[i])

    def find(self, doc_id: int) -> int:
        """The place of ``doc_id``, or -1."""
        i = self.nulls + int(np.searchsorted(self.doc_ids[self.nulls :], doc_id))
        return i if i < len(self) and self.doc_ids[i] == doc_id else -1

    def ids(self, i: int) -> np.ndarray:
        frame = self.frames[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])]
        return np.frombuffer(self.library.decompress(frame), self.kind)


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, block_bytes: int = 4 << 20, dictionary_bytes: int = 64 << 10, sample: int = 1000, sample_chars: int = 16_384) -> None:
    """Writes the store to ``path``, a new folder: the dictionary, then blocks in shards of ascending doc_id ranges."""
    spark = docs.sparkSession
    docs = id_and_text(docs)
    kind = id_type(tokenizer)
    raw = train_dictionary(docs, tokenizer, end_id, kind, dictionary_bytes, sample, sample_chars)
    spark.createDataFrame([(hashlib.sha256(raw).hexdigest(), raw)], DICTIONARY).coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, library = encoder(tokenizer, end_id), zstandard.ZstdCompressor(level=3, **_dictionary(raw))
        for whole in batches:
            for batch in slices(whole):
                ids, ends = tokens.encode(batch.column("text"))
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                narrow = ids.astype(kind)
                frames = [library.compress(narrow[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ends - starts, pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "n_tokens", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first, n, writer = TaskContext.get().partitionId(), 0, 0, 0, BlockWriter(raw, kind.itemsize)

        def block() -> pa.RecordBatch:
            nonlocal number, first, n
            ids = [writer.rows[0][0], writer.rows[-1][0]]
            cells = ((shard, pa.int32()), (number, pa.int32()), *((x, pa.int64()) for x in (first, n, *ids)), (writer.take(), pa.binary()))
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in cells], names=["shard", "number", "first_token", "n_tokens", "first_id", "last_id", "block"])
            number, first, n = number + 1, first + n, 0
            return out

        for batch in batches:
            for doc_id, count, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer.add(doc_id, count, frame)
                n += count
                if writer.size >= block_bytes:
                    yield block()
        if writer.rows:
            yield block()

    # Written first: range partitioning reads its input twice, and no text is encoded again if an executor is lost.
    frames = materialize(docs.mapInArrow(encode, FRAMES), "frames")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The row's place in the written table splits many rows of one doc_id over shards.
    order = F.col("doc_id").asc_nulls_first(), F.col("place").asc()
    ordered = frames.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ordered.drop("place").mapInArrow(write, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """The blocks of a store and its dictionary."""
    row = spark.read.schema(DICTIONARY).parquet(f"{path}/dictionary").first()
    raw = bytes(row.dictionary)
    if hashlib.sha256(raw).hexdigest() != row.sha256:
        raise ValueError("the dictionary is damaged")
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), raw


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this doc_id (as many as repeat it): their blocks alone are read, of these their frames alone decompressed."""
    blocks, raw = open_store(spark, path)
    out = []
    for row in blocks.where((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id)).orderBy("shard", "number").select("block").toLocalIterator():
        reader = BlockReader(bytes(row.block), raw)
        i = reader.find(doc_id)
        while 0 <= i < len(reader) and reader.doc_id(i) == doc_id:
            out.append(reader.ids(i).tolist())
            i += 1
    return out


def read_index(blocks: DataFrame, dictionary: bytes) -> DataFrame:
    """One row for each document of written blocks, from decompressed ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, block in zip(*(batch.column(c).to_pylist() for c in ("shard", "first_token", "block")), strict=True):
                reader = BlockReader(block, dictionary)
                rows = [(reader.doc_id(i), x) for i in range(len(reader)) for x in [reader.ids(i).astype("<u4")]]
                counts = np.array([len(x) for _, x in rows], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(rows), pa.int32()), pa.array([i for i, _ in rows], pa.int64()), pa.array(first + np.cumsum(counts) - counts), pa.array(counts), pa.array([zlib.crc32(x) for _, x in rows], pa.int64())],
                    names=["shard", "doc_id", "start_in_shard", "n_tokens", "ids_crc32"],
                )

    entries = blocks.select("shard", "first_token", "block").mapInArrow(read, ENTRIES)
    # One number for each shard (as many as shuffle partitions), from two narrow columns.
    totals = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in totals)]).tolist()
    spark = blocks.sparkSession
    offsets = spark.createDataFrame([(s, b) for (s, _), b in zip(totals, before, strict=False)], "shard int, before long")
    return entries.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def store_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes all documents' ids in ascending doc_id order to ``path`` (by default a scratch folder, gone with the driver), and reads them back from there."""
    path = path or scratch(docs.sparkSession, "store")
    write_store(docs, tokenizer, path, end_id)
    return read_index(*open_store(docs.sparkSession, path))
