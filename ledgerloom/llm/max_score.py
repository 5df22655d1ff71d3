"""Operator 12: exact top-k by integer inner product, pruned by MaxScore.

The components of a vector are its terms; a shard (some thousand vectors within a task) keeps one postings column per term, with the least
and the largest impact in it. What a term can add to a score lies between two bounds, so a score is a base (all lower bounds) plus gains
that are not negative, and MaxScore applies to signed weights:

1. Terms are ordered by how far they can raise a score. Those whose gains together stay below what the k-th best score so far asks for are
   not essential.
2. Essential postings are traversed for the whole shard.
3. The others are probed, largest first, only for vectors that can still reach the k-th best score.
4. A task keeps the k best of each query over its shards; the tasks' lists are merged by rank.

Queries are a stated set (every vec_id divisible by ``EVERY``) and go out in blocks of ``BLOCK_BYTES``, one pass over the vectors for each block: a
broadcast never grows with the input, and candidates are not shuffled at all.

Defined results: vectors that are null, or hold null or components that are not finite, take no part; an empty vector has the score 0, and
of vectors of different lengths the shorter one counts as filled up with zeros; a row whose vec_id is null is no query, but a candidate that
comes last of its score; rows that repeat are candidates and, each for itself, queries; scores beyond 64 bits raise OverflowError; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import scratch

from .common import bounded_batches, materialize

#: Factor of the whole numbers that components become.
SCALE = 1024
#: Every vector whose id this divides is a query.
EVERY = 100
#: Bytes of the queries that are sent out at a time, and vectors of a shard.
BLOCK_BYTES, SHARD = 16 << 20, 16384
#: Terms that are probed before candidates are counted again.
STEP = 4
FOUND = "number long, vec_id long, score long"


def whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list]:
    """Whole-number vectors (rows x terms, shorter ones filled up) of the rows that take part, their numbers in the batch, their ids."""
    lists = batch["embedding"]
    if not pa.types.is_list(lists.type):
        lists = lists.cast(pa.list_(lists.type.value_type))
    values = pc.list_flatten(lists).cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False)  # nulls become nan
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
    of = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    odd = np.bincount(of[~np.isfinite(flat)], minlength=len(lengths)) > 0
    rows = np.flatnonzero((lengths >= 0) & ~odd)
    kept = np.isin(of, rows)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    place = np.cumsum(np.isin(np.arange(len(lengths)), rows)) - 1
    scaled = np.floor(SCALE * flat[kept])
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("a component is too large for scores of 64 bits")
    out = np.zeros((len(rows), int(lengths[rows].max(initial=0))), np.int64)
    out[place[of[kept]], (np.arange(len(flat)) - starts[of])[kept]] = scaled.astype(np.int64)
    return out, rows, batch["vec_id"].take(pa.array(rows)).to_pylist()


def widened(matrix: np.ndarray, terms: int) -> np.ndarray:
    return matrix if matrix.shape[1] >= terms else np.pad(matrix, ((0, 0), (0, terms - matrix.shape[1])))


class Shard:
    """Postings of some vectors: a column of impacts for each term, vectors in the order of their ids, and each column's bounds."""

    def __init__(self, vectors: np.ndarray, ids: list):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        self.known = np.array([i for i in self.ids if i is not None], np.int64)
        self.postings = np.ascontiguousarray(vectors[order].T)
        self.least, self.most = self.postings.min(1), self.postings.max(1)
        self.largest = int(np.abs(self.postings).max(initial=0))

    def same(self, vec_id: int, query: np.ndarray) -> np.ndarray:
        """Where rows with this id and vector lie."""
        a, b = np.searchsorted(self.known, [vec_id, vec_id + 1])
        return a + np.flatnonzero((self.postings[:, a:b] == query[:, None]).all(0))

    def search(self, query: np.ndarray, vec_id: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of at most ``k`` vectors other than the query's own row: the best that reach ``floor``."""
        if int(np.abs(query).max(initial=0)) * self.largest * max(1, len(query)) >= 1 << 62:
            raise OverflowError("scores beyond 64 bits")
        low, high = np.minimum(query * self.least, query * self.most), np.maximum(query * self.least, query * self.most)
        terms = np.argsort(low - high, kind="stable")  # what raises a score most comes first
        gains = (high - low)[terms]
        rest = np.append(np.cumsum(gains[::-1])[::-1], 0)  # of a term and all that follow
        base, n = int(low.sum()), self.postings.shape[1]
        own = self.same(vec_id, query)
        if floor is None:  # the first vectors' scores are one: k of them are at least so good
            first = np.setdiff1d(np.arange(min(n, 4 * k)), own)
            if len(first) >= k:
                scores = query @ self.postings[:, first]
                floor = int(np.partition(scores, len(scores) - k)[-k])
        essential = len(terms) if floor is None else int(np.searchsorted(-rest[:-1], -(floor - base), "right"))
        sums = np.full(n, base, np.int64)
        for t in terms[:essential]:
            sums += query[t] * self.postings[t] - low[t]
        sums[own] = np.iinfo(np.int64).min >> 1
        alive = np.arange(n) if floor is None else np.flatnonzero(sums + rest[essential] >= floor)
        alive = np.setdiff1d(alive, own, assume_unique=True) if floor is None else alive
        sums = sums[alive]
        for at in range(essential, len(terms), STEP):
            for t in terms[at : at + STEP]:
                sums += query[t] * self.postings[t, alive] - low[t]
            if len(sums) >= 4 * k:  # the k-th best so far, with the least that is to come
                floor = max(floor, int(np.partition(sums, len(sums) - k)[-k]))
            good = sums + rest[min(at + STEP, len(terms))] >= floor
            alive, sums = alive[good], sums[good]
        if len(sums) > k:
            good = np.lexsort((alive, -sums))[:k]
            alive, sums = alive[good], sums[good]
        return alive, sums


def best_of_task(queries: np.ndarray, query_ids: list[int], numbers: list[int], k: int, shard_rows: int) -> object:
    """The function that searches a task's vectors shard by shard and keeps the ``k`` best of each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in numbers]
        held: list[tuple[np.ndarray, list]] = []

        def searched() -> None:
            terms = max([queries.shape[1], *(v.shape[1] for v, _ in held)])
            shard = Shard(np.concatenate([widened(v, terms) for v, _ in held]), [i for _, ids in held for i in ids])
            held.clear()
            for j, query in enumerate(widened(queries, terms)):
                known = best[j]
                at, scores = shard.search(query, query_ids[j], k, -known[-1][0] if len(known) == k else None)
                found = [(-int(s), (shard.ids[i] is None, shard.ids[i] or 0), shard.ids[i]) for i, s in zip(at.tolist(), scores.tolist(), strict=True)]
                best[j] = sorted([*known, *found])[:k] if found else known

        for batch in batches:
            vectors, _, ids = whole(batch)
            for start in range(0, len(ids), shard_rows):
                part = (vectors[start : start + shard_rows], ids[start : start + shard_rows])
                if held and sum(len(x) for _, x in held) + len(part[1]) > shard_rows:
                    searched()
                held.append(part)
        if held:
            searched()
        for start in range(0, len(numbers), 4096):
            rows = [(numbers[j], vec_id, -score) for j in range(start, min(start + 4096, len(numbers))) for score, _, vec_id in best[j]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["number", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, k: int = 10, every: int = EVERY, shard_rows: int = SHARD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best candidates of each query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    bounded_batches(vectors)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    distinct = own.where(F.col("vec_id") % every == 0).mapInArrow(_asked, "vec_id long, vector array<long>").groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("n_rows"))
    asked = materialize(distinct.select("vec_id", "n_rows", F.monotonically_increasing_id().alias("number"), "vector"), "queries")
    path = scratch(spark, "found")
    held: list[pa.RecordBatch] = []

    def passed() -> None:
        sent = spark.sparkContext.broadcast(pa.Table.from_batches(held).combine_chunks())
        held.clear()
        own.mapInArrow(_searching(sent, k, shard_rows), FOUND).write.mode("append").parquet(path)
        sent.destroy()

    for batch in _batches(asked):
        rows = max(1, block_bytes * batch.num_rows // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            if held and sum(b.nbytes for b in held) + part.nbytes > block_bytes:
                passed()
            held.append(part)
    if held:
        passed()
    else:
        spark.createDataFrame([], FOUND).write.mode("append").parquet(path)
    found = spark.read.schema(FOUND).parquet(path)

    # A query's row is not its own candidate, its copies are.
    names = asked.select("number", F.col("vec_id").alias("query_id"), "n_rows")
    copies = materialize(asked.where("n_rows > 1").mapInArrow(_own_scores, "number long, vec_id long, n_rows long, score long"), "copies")
    copies = copies.select("number", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least(F.col("n_rows") - 1, F.lit(k)).cast("int")))).drop("col")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.unionByName(copies).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))
    return ranked.join(names, "number").select("query_id", "rank", "vec_id", "score", again).drop("col")


def _batches(rows: DataFrame) -> Iterator[pa.RecordBatch]:
    """The rows, a partition's at a time on the driver."""
    names, kinds = rows.columns, [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    buffer: list = []
    for row in rows.toLocalIterator():
        buffer.append(row)
        if len(buffer) == 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*buffer, strict=True), kinds, strict=True)], names=names)
            buffer = []
    if buffer:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*buffer, strict=True), kinds, strict=True)], names=names)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    rows = batch["vector"].to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for own, row in zip(out, rows, strict=True):
        own[: len(row)] = row
    return out


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries as whole numbers, without zeros at the end."""
    for batch in batches:
        vectors, _, ids = whole(batch)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([np.trim_zeros(v, "b").tolist() for v in vectors], pa.list_(pa.int64()))], names=["vec_id", "vector"])


def _searching(sent: Broadcast, k: int, shard_rows: int) -> object:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (batch,) = sent.value.to_batches()
        yield from best_of_task(_matrix(batch), batch["vec_id"].to_pylist(), batch["number"].to_pylist(), k, shard_rows)(batches)

    return search


def _own_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [sum(x * x for x in v) for v in batch["vector"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("number", "vec_id", "n_rows")), pa.array(scores, pa.int64())], names=["number", "vec_id", "n_rows", "score"])


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.own <> c.own WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
