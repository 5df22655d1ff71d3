"""Operator 3: sharding by extendible hashing.

A document's address is 60 bits of the md5 of its doc_id, then 60 bits that tell rows with one doc_id apart. A directory of address
prefixes starts as one bucket; a bucket over the byte limit splits on its next bit, the others stay as they are. Buckets
are summed, never held: each round sums the rows of oversized buckets by their next bits (partial aggregation), takes as a
shard every shortest prefix that fits, and goes on with those that do not fit at the round's last bit.

Defined results: null texts have 0 bytes; a null doc_id hashes as the empty string; a shard over the limit is a single document
(``oversized``); rows that repeat a doc_id share a shard as far as they fit, the rest split on their rows' own bits; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS = 60
#: Limit of a shard's text by default, and in the registered query, whose tables are small: it splits them too.
LIMIT_BYTES = 16 << 20
QUERY_LIMIT = 16 << 10
_ROUND = 12


def _prefix(depth: int) -> str:
    """SQL for the first ``depth`` address bits: a pair of longs."""
    a = f"shiftright(address, {BITS - min(depth, BITS)})"
    b = f"shiftright(salt, {2 * BITS - depth})" if depth > BITS else "0L"
    return f"named_struct('a', {a}, 'b', {b})"


def _shorter(by: str) -> str:
    """SQL for the prefix (of ``top`` bits) cut to ``by`` bits."""
    return f"named_struct('a', shiftright(prefix.a, least(top, {BITS}) - least({by}, {BITS})), 'b', if({by} > {BITS}, shiftright(prefix.b, top - {by}), 0L))"


def shard_documents(docs: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_bytes, shard (its prefix in binary digits), depth, shard_bytes, shard_docs, oversized."""
    address = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_bytes"), address.alias("address"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.select("*", F.expr(f"shiftrightunsigned(xxhash64(row), {64 - BITS})").alias("salt")).drop("row"), "addresses")
    done: list[DataFrame] = []
    depth, most = 0, 2 * BITS
    while True:
        top = min(depth + _ROUND, most)
        cells = rows.groupBy(F.expr(_prefix(top)).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")).withColumn("top", F.lit(top))
        cells = materialize(cells, "cells")
        levels = cells.select("*", F.explode(F.sequence(F.lit(depth), F.lit(top))).alias("depth")).select("depth", F.expr(_shorter("depth")).alias("at"), "prefix", "bytes", "docs")
        sums = levels.groupBy("depth", "at").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("shard_docs") == 1) | (F.col("depth") == most)
        # Sums fall with depth: a cell's shard is the first level that fits.
        chosen = levels.select("depth", "at", "prefix").join(sums.where(fits), ["depth", "at"]).groupBy("prefix").agg(F.min(F.struct("depth", "at", "shard_bytes", "shard_docs")).alias("shard"))
        directory = materialize(cells.select("prefix").join(chosen, "prefix", "left"), "directory")
        placed = rows.withColumn("prefix", F.expr(_prefix(top))).join(directory, "prefix")
        done.append(placed.where("shard is not null").select("doc_id", "n_bytes", "shard"))
        if top == most or directory.where("shard is null").isEmpty():
            break
        rows = materialize(placed.where("shard is null").select("doc_id", "n_bytes", "address", "salt"), "oversized")
        depth = top + 1
    digits = F.expr(f"lpad(bin(shard.at.a), least(shard.depth, {BITS}), '0') || if(shard.depth > {BITS}, lpad(bin(shard.at.b), shard.depth - {BITS}, '0'), '')")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "n_bytes", F.when(F.col("shard.depth") == 0, "").otherwise(digits).alias("shard"), F.col("shard.depth").alias("depth"), F.col("shard.shard_bytes").alias("shard_bytes"), F.col("shard.shard_docs").alias("shard_docs"), (F.col("shard.shard_bytes") > limit_bytes).alias("oversized"))


SQL = f"""
WITH addressed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT) AS address
  FROM documents),
levels AS (SELECT doc_id, n_bytes, depth, address >> ({BITS} - depth) AS prefix FROM addressed, (SELECT unnest(range(0, 49)) AS depth)),
sums AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs FROM levels GROUP BY ALL
         HAVING sum(n_bytes) <= {QUERY_LIMIT} OR count(*) = 1),
chosen AS (SELECT l.doc_id, l.n_bytes, l.depth, l.prefix, s.shard_bytes, s.shard_docs
           FROM levels l JOIN sums s USING (depth, prefix)
           QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS depth,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs, shard_bytes > {QUERY_LIMIT} AS oversized
FROM chosen
"""
