"""Window-like operators; every one has an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def carry_down(rows: DataFrame, columns: dict[str, Column], partition: Sequence[str], order: str) -> DataFrame:
    """WIN-03, WIN-04: where the condition holds, the value of the last row in which it does not."""
    window = Window.partitionBy(*partition).orderBy(order).rowsBetween(*_SO_FAR)
    return rows.select(*[c for c in rows.columns if c not in columns], *[F.last(F.when(~same, F.col(c)), ignorenulls=True).over(window).alias(c) for c, same in columns.items()])


def carry_context(rows: DataFrame, is_header: Column, values: Sequence[str], partition: Sequence[str], order: str) -> DataFrame:
    """WIN-05, WIN-10: every row gets its last header's values, and the number of headers so far."""
    window = Window.partitionBy(*partition).orderBy(order).rowsBetween(*_SO_FAR)
    out = rows.withColumn("_header", is_header)
    for v in values:
        out = out.withColumn(f"header_{v}", F.last(F.when(F.col("_header"), F.col(v)), ignorenulls=True).over(window))
    return out.withColumn("section", F.sum(F.col("_header").cast("int")).over(window)).drop("_header")


def ring(turns: DataFrame, key: str, order: str, size: int = 12, limit: int = 0) -> DataFrame:
    """WIN-06, SRT-04: the last ``size`` turns of each session, of these the last ``limit`` (0: all)."""
    n = min(size, limit) if limit else size
    number = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("_n", number).where(F.col("_n") <= n).drop("_n")


def snapshots(rows: DataFrame, key: str, order: Sequence[str], content: str) -> DataFrame:
    """WIN-09, STM-02: each snapshot against the one before: new, same or changed; and the version it belongs to."""
    window = Window.partitionBy(key).orderBy(*order)
    before = F.lag(content).over(window)
    change = F.when(before.isNull(), "new").when(before == F.col(content), "same").otherwise("changed")
    out = rows.withColumn("change", change)
    return out.withColumn("version", F.sum((F.col("change") != "same").cast("int")).over(window.rowsBetween(*_SO_FAR)))


def next_version(ids: DataFrame, column: str = "id") -> DataFrame:
    """WIN-08: for each base id, the first suffix ``-vN`` that is free (N from 2)."""
    base = F.regexp_replace(column, r"-v\d+$", "")
    number = F.when(F.col(column).rlike(r"-v\d+$"), F.regexp_extract(column, r"-v(\d+)$", 1)).cast("int")
    taken = ids.select(base.alias("base"), F.coalesce(number, F.lit(1)).alias("n")).distinct()
    # Up to the first gap the n-th suffix in order is n; those below 2 (the id itself) count as one place.
    place = F.row_number().over(Window.partitionBy("base").orderBy("n")) + 1
    own = taken.where("n >= 2").withColumn("place", place).where("n = place").groupBy("base").agg(F.max("n").alias("last"))
    free = taken.select("base").distinct().join(own, "base", "left").select("base", (F.coalesce("last", F.lit(1)) + 1).alias("n"))
    return free.select("base", F.concat("base", F.lit("-v"), F.col("n").cast("string")).alias("next"))


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """SRT-03, SRT-05: k rows a group; Spark limits each task's rows before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def capped_union(first: DataFrame, second: DataFrame, order: str, cap: int) -> DataFrame:
    """SRT-06: all of the first, then the second, up to the cap."""
    both = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)))
    return both.orderBy("_part", order).limit(cap).drop("_part")


def distinct_citations(rows: DataFrame, keys: Sequence[str], order: str, cap: int = 40) -> DataFrame:
    """SRT-07: the first row of each key, in order, up to the cap."""
    first = rows.groupBy(*keys).agg(F.min(order).alias(order))
    return first.orderBy(order).limit(cap)
