"""What the corpus operators share: the scratch folder, batches of bounded size, tables of a data folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import scratch

#: Bytes of text that a Python worker holds decoded at a time.
SLICE_BYTES = 8 << 20
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Drops what a Python worker keeps from task to task.
droppers: list[Callable[[], None]] = []
_owner: list[str] = [""]


def trim() -> None:
    """Gives freed memory back to the system: workers are used again, and an executor's workers share its memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def claim(name: str) -> None:
    """Called by an operator's task: what other operators keep in this worker goes."""
    if _owner[0] != name:
        for drop in droppers:
            drop()
        trim()
        _owner[0] = name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(docs: DataFrame) -> None:
    """Sets how much text goes to a Python worker at a time, unless the session already says less."""
    conf = docs.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty; other columns, whatever their names, are not read."""
    bounded_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def sample_texts(docs: DataFrame, n: int) -> list[str]:
    """``n`` distinct texts at most, those of the least hashes, in their order: a sample that does not depend on how rows lie."""
    texts = docs.select("text", F.xxhash64("text").alias("hash"))
    rows = docs.count()
    if rows > 2 * n:  # as many hashes as lie below this are twice as many as wanted, unless most texts are copies
        last = int(-(1 << 63) + (1 << 64) * (2 * n / rows))
        found = {r.hash: r.text for r in texts.where(F.col("hash") <= last).dropDuplicates(["hash"]).collect()}
        if len(found) >= n:
            return [found[h] for h in sorted(found)[:n]]
    last = texts.select("hash").distinct().orderBy("hash").limit(n).agg(F.max("hash")).first()[0]
    if last is None:
        return []
    found = {r.hash: r.text for r in texts.where(F.col("hash") <= last).dropDuplicates(["hash"]).collect()}
    return [found[h] for h in sorted(found)]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with at most ``limit`` bytes in ``column``, or one row if that is longer."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


#: Words of 64 bits in a filter of fingerprints: what is broadcast never exceeds this many rows.
FILTER_WORDS = 1 << 20
_WORD = f"fingerprint & {FILTER_WORDS - 1}L"
_SHIFT = f"cast(shiftrightunsigned(fingerprint, {FILTER_WORDS.bit_length() - 1}) & 63 as int)"


def fingerprint() -> Column:
    return F.xxhash64("text").alias("fingerprint")


def fingerprint_filter(fingerprints: DataFrame) -> DataFrame:
    """A Bloom filter of one hash as a table: a word for each value of the lowest bits, in it a bit for the next six."""
    return fingerprints.groupBy(F.expr(_WORD).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {_SHIFT}))").alias("bits"))


def marked(rows: DataFrame, bits: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` with ``maybe``: whether their ``fingerprint`` passes the filter (with ``how`` "inner": only those)."""
    joined = rows.join(F.broadcast(bits), F.expr(_WORD) == F.col("word"), how)
    maybe = F.coalesce(F.expr(f"shiftrightunsigned(bits, {_SHIFT}) & 1") == 1, F.lit(False))
    joined = joined.withColumn("maybe", maybe).drop("word", "bits")
    return joined.where("maybe").drop("maybe") if how == "inner" else joined


def keep_rows(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``docs`` without rows that a decision drops. ``classes`` (doc_id, fingerprint, stay) names rows by doc_id and text, with how many of
    these stay; rows not named stay. Only texts that pass a filter of bounded size are shuffled; other columns are kept as they are."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    inner = inner.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("fingerprint"))
    split = marked(inner, fingerprint_filter(classes.select("fingerprint")))
    named = classes.select(F.col("doc_id").alias("named_id"), F.col("fingerprint").alias("named"), "stay")
    judged = split.where("maybe").join(named, (F.col("fingerprint") == F.col("named")) & F.col("doc_id").eqNullSafe(F.col("named_id")), "left")
    out = split.where("not maybe").select("row.*").unionByName(judged.where("stay is null").select("row.*"))
    if not classes.where("stay > 0").isEmpty():  # of rows that repeat doc_id and text, some stay
        order = Window.partitionBy("doc_id", "fingerprint").orderBy(F.lit(0))
        some = judged.where("stay > 0").withColumn("number", F.row_number().over(order)).where("number <= stay")
        out = out.unionByName(some.select("row.*"))
    return out
