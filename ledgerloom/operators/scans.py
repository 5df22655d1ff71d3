"""Numbers and running values within a key of which one task need not hold all rows.

Rows are laid out by range over (key, order), so a hot key lies in as many partitions as it fills. Each partition runs alone; what it
ends with (one row for each key and partition) is run over partitions and added as an offset. Any associative running value goes: counts,
sums, and the last value that is not null.

Keys must not be null. Rows that tie in key and order keep an arbitrary order among themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import scratch

#: What two runs that follow each other make together, from the earlier and the later one's value.
KINDS = ("count", "sum", "last")
#: Rows of a partition, about.
ROWS = 1 << 19


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` by way of a table in the shared folder: cuts the lineage, and fixes what is not computed alike twice."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def partitions(rows: DataFrame) -> int:
    """Partitions for a written table, whose rows are counted from its footers: the session's number, and more where one would hold over ROWS rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))


def laid_out(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column], sized: bool = True) -> DataFrame:
    """``rows`` as a written table with ``part`` and ``place``: a key's rows ascend by both, whatever partitions they lie in. A part has 2^16 rows at most.
    Partitions are as many as the rows need (``sized``; for that the rows are written once more), else the session's number."""
    by = [*map(F.col, key), *(F.col(c) if isinstance(c, str) else c for c in order)]
    source = written(rows, "rows") if sized else rows
    ranged = source.repartitionByRange(partitions(source), *by) if sized else source.repartitionByRange(*by)
    laid = ranged.sortWithinPartitions(*by).select("*", F.monotonically_increasing_id().alias("place"))
    return written(laid.withColumn("part", F.shiftright("place", 16)), "laid")


def running(laid: DataFrame, key: Sequence[str], values: dict[str, tuple[str, str | None]], part: str = "part", place: str = "place", sized: bool = True) -> DataFrame:
    """``laid`` with running values: ``values`` maps a new column to its kind and the column that it runs over (None for "count").
    With ``sized``, ``laid`` is a written table, or columns of one, and gets as many partitions as its rows need. ``part`` must ascend with ``place`` within a key; it is what a task's window holds at most."""
    if wrong := {kind for kind, _ in values.values()} - {*KINDS}:
        raise ValueError(f"not a kind of running value: {wrong}")
    within = Window.partitionBy(*key, part).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)

    def over(kind: str, column: str | None, window: object) -> Column:
        return F.last(column, ignorenulls=True).over(window) if kind == "last" else (F.count(F.lit(1)) if column is None else F.sum(column)).over(window)

    ends = laid.groupBy(*key, part).agg(F.count(F.lit(1)).alias("_n"), *[(F.count(F.lit(1)) if kind == "count" else F.sum(c)).alias(f"_before_{name}") for name, (kind, c) in values.items() if kind != "last"])
    for name, (kind, c) in values.items():
        if kind == "last":  # only rows that have a value are read
            ends = ends.join(laid.where(F.col(c).isNotNull()).groupBy(*key, part).agg(F.max_by(c, place).alias(f"_before_{name}")), [*key, part], "left")
    offsets = ends.select(*key, part, *[over("last" if kind == "last" else "sum", f"_before_{name}", earlier).alias(f"_before_{name}") for name, (kind, _) in values.items()])
    dealt = laid.repartition(partitions(laid), *key, part) if sized else laid
    own = dealt.withColumns({name: over(kind, c, within) for name, (kind, c) in values.items()})
    both = own.join(offsets, [*key, part], "left")
    found = {name: F.coalesce(name, f"_before_{name}") if kind == "last" else F.col(name) + F.coalesce(f"_before_{name}", F.lit(0)) for name, (kind, _) in values.items()}
    return both.withColumns(found).select(*laid.columns, *values)


def numbered(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column], name: str = "number") -> DataFrame:
    """``rows`` with their number within ``key``, from 1, in ``order``."""
    return running(laid_out(rows, key, order), key, {name: ("count", None)}).drop("part", "place")
