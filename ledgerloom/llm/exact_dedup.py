"""Operator 1: exact deduplication by a Golomb-coded fingerprint exchange.

1. Every source block (a task's next rows) sorts its distinct 64-bit fingerprints by owner (the leading bits) and
   sends each owner one message: the sorted fingerprints, their gaps in Golomb-Rice code.
2. An owner decodes its messages, finds the fingerprints that came from two blocks or more, and answers each message with a bitmap.
3. Rows whose bit is set, or whose fingerprint occurs twice within their own block, are suspects. Only texts that pass a filter of
   the suspects' fingerprints (a table of bounded size) are shuffled, and grouped byte by byte.

A hot text counts once per block in the exchange and once per task in the shuffle (partial aggregation), so no task meets all its copies.

Defined results: null texts are empty texts; texts are equal when their bytes are; among equal texts the row with the
largest doc_id stays, of rows that repeat doc_id and text exactly one; null doc_ids come last; an empty table gives an empty
result; other columns are ignored here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fingerprint, fingerprint_filter, id_and_text, keep_rows, materialize
from .common import marked as matching

SENT = "block long, owner int, place int, position int, local boolean, doc_id long, digest string, fingerprint long, message binary"
#: Fingerprints that an owner is to get at most.
OWNED = 4_000_000
_SENT = [x.split()[0] for x in SENT.split(", ")]
_HEAD = struct.Struct("<QIII")


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Ascending distinct unsigned values below ``span`` above the first: the first, then gaps as unary quotients and fixed-width remainders."""
    gaps = np.diff(values)
    k = max(0, int(np.log2(max(1.0, 0.69 * span / (len(gaps) + 1)))))
    quotients, n = (gaps >> np.uint64(k)).astype(np.int64), len(gaps)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return _HEAD.pack(int(values[0]), n, k, len(unary)) + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(message: bytes) -> np.ndarray:
    first, n, k, n_unary = _HEAD.unpack_from(message)
    at = _HEAD.size + (n_unary + 7) // 8
    unary = np.unpackbits(np.frombuffer(message, np.uint8, (n_unary + 7) // 8, _HEAD.size), count=n_unary)
    rest = np.unpackbits(np.frombuffer(message, np.uint8, offset=at), count=n * k).reshape(n, k).astype(np.uint64)
    quotients = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) + (rest << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum(np.concatenate([np.array([first], np.uint64), gaps]), dtype=np.uint64)


def exchange(docs: DataFrame, owner_bits: int, block_rows: int) -> DataFrame:
    """Rows with their place in their block's message, and the messages (rows without a position)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 24, 0
        rows: list[pa.RecordBatch] = []

        def sent() -> pa.RecordBatch:
            nonlocal number
            own = pa.Table.from_batches(rows).combine_chunks()
            prints = own["fingerprint"].to_numpy().view(np.uint64)
            distinct, inverse, counts = np.unique(prints, return_inverse=True, return_counts=True)
            owners = (distinct >> np.uint64(64 - owner_bits)).astype(np.int64) if owner_bits else np.zeros(len(distinct), np.int64)
            known, firsts = np.unique(owners, return_index=True)
            places = np.arange(len(distinct)) - firsts[np.searchsorted(known, owners)]
            span = 1 << (64 - owner_bits)
            messages = [golomb_encode(x, span) for x in np.split(distinct, firsts[1:])]
            n, m, block = len(prints), len(known), task + number
            number += 1
            nothing = lambda kind, k: pa.nulls(k, kind)
            columns = [
                pa.array(np.full(n + m, block)),
                pa.array(np.concatenate([owners[inverse], known]).astype(np.int32)),
                pa.concat_arrays([pa.array(places[inverse].astype(np.int32)), nothing(pa.int32(), m)]),
                pa.concat_arrays([pa.array(np.arange(n, dtype=np.int32)), nothing(pa.int32(), m)]),
                pa.concat_arrays([pa.array(counts[inverse] > 1), nothing(pa.bool_(), m)]),
                *(pa.concat_arrays([own[c].combine_chunks(), nothing(own[c].type, m)]) for c in ("doc_id", "digest", "fingerprint")),
                pa.concat_arrays([nothing(pa.binary(), n), pa.array(messages, pa.binary())]),
            ]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=_SENT)

        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                if rows and sum(r.num_rows for r in rows) + part.num_rows > block_rows:
                    yield sent()
                rows.append(part)
        if rows:
            yield sent()

    prints = docs.select("doc_id", F.sha2("text", 256).alias("digest"), fingerprint())
    return materialize(prints.mapInArrow(send, SENT), "sent")


def answers(messages: DataFrame) -> DataFrame:
    """For every message with a duplicate, the bitmap of its fingerprints that another block sent as well."""

    def own(table: pa.Table) -> pa.Table:
        sent = [golomb_decode(m) for m in table["message"].to_pylist()]
        distinct, counts = np.unique(np.concatenate(sent), return_counts=True)
        twice = distinct[counts > 1]
        at = np.cumsum([0, *map(len, sent)])
        hit = np.zeros(at[-1], bool)
        if len(twice):
            every = np.concatenate(sent)
            hit = twice[np.minimum(np.searchsorted(twice, every), len(twice) - 1)] == every
        maps = [np.packbits(hit[a:b]).tobytes() if hit[a:b].any() else None for a, b in zip(at, at[1:], strict=False)]
        out = pa.table([table["block"], table["owner"], pa.array(maps, pa.binary())], names=["block", "owner", "bitmap"])
        return out.filter(out["bitmap"].is_valid())

    return messages.groupBy("owner").applyInArrow(own, "block long, owner int, bitmap binary")


def _groups(docs: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """All rows, with whether they are suspects, and the groups of equal texts (digest, n, winner)."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = max(partitions - 1, docs.count() // OWNED)
    sent = exchange(docs, owners.bit_length(), block_rows)
    bitmaps = answers(sent.where("position is null").select("block", "owner", "message"))
    bit = F.expr("shiftright(cast(conv(hex(substring(bitmap, cast(place div 8 as int) + 1, 1)), 16, 10) as int), 7 - place % 8) & 1")
    marked = sent.where("position is not null").drop("message").join(bitmaps, ["block", "owner"], "left")
    marked = materialize(marked.select("doc_id", "digest", "fingerprint", F.struct("block", "position").alias("row"), (F.col("local") | F.coalesce(bit == 1, F.lit(False))).alias("suspect")), "marked")
    suspects = marked.where("suspect")

    passed = matching(docs.select("text", fingerprint()), fingerprint_filter(suspects.select("fingerprint")), "inner")
    # Byte by byte: equal digests stand for equal texts only as far as one text was found for each.
    equal = passed.groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("texts"))
    winners = suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("winner")).where("n > 1").join(equal, "digest")
    one = F.expr("assert_true(texts = 1, 'two texts with one digest')")
    winners = materialize(winners.where(one.isNull()).select("digest", "n", "winner"), "groups")

    return marked, winners


def exact_duplicates(docs: DataFrame, block_rows: int = 1 << 16) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    marked, winners = _groups(id_and_text(docs), block_rows)
    copies = marked.where("suspect").join(winners, "digest", "left").select(
        "doc_id",
        F.when(F.col("winner").isNull(), F.col("doc_id")).otherwise(F.col("winner.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("winner.row"), F.lit(True)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    single = marked.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    return single.unionByName(copies)


def without_copies(docs: DataFrame, block_rows: int = 1 << 16) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each text, that with the largest doc_id."""
    marked, winners = _groups(id_and_text(docs), block_rows)
    rows = marked.where("suspect").select("doc_id", "fingerprint", "digest").join(winners, "digest")
    stays = F.col("doc_id").eqNullSafe(F.col("winner.doc_id"))
    classes = rows.groupBy("doc_id", "fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max(stays.cast("int")).alias("stay")).where("stay < n")
    return keep_rows(docs, materialize(classes.drop("n"), "classes"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
