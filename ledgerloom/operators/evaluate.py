"""Evaluation: matches of expected facts, ratios by groups, regressions, deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_facts(expected: DataFrame, produced: DataFrame, key: Sequence[str]) -> DataFrame:
    """JON-12: whether an expected fact was produced, and whether by any row of the expected source."""
    own = produced.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("source").alias("_source"))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    joined = expected.join(own, same, "left")
    return joined.groupBy("want").agg(F.bool_or(F.col("_source").isNotNull()).alias("found"), F.coalesce(F.bool_or(F.col("_source") == F.col("source")), F.lit(False)).alias("source_matches"))


def set_equal(a: Column, b: Column) -> Column:
    """SET-04: equal as sets."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def grouped_ratios(rows: DataFrame, hit: Column, groups: Sequence[str], hidden: Column | None = None) -> DataFrame:
    """AGG-13, EVL-01: hits and totals overall and for each value of each group (one pass with grouping sets); hidden rows
    count overall only. Ratios are for display: hits and totals are exact."""
    hidden = F.lit(False) if hidden is None else hidden
    shown = rows.withColumn("_hit", hit.cast("int")).withColumn("_hidden", hidden)
    sets = [[F.lit(0)]] and [[], *[[F.col(g)] for g in groups]]
    grouped = shown.groupingSets(sets, *[F.col(g) for g in groups]).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("_n"), F.sum("_hit").alias("_h"), F.count_if(~F.col("_hidden")).alias("_vn"), F.sum(F.when(~F.col("_hidden"), F.col("_hit")).otherwise(0)).alias("_vh")
    )
    overall = F.col("_g") == (1 << len(groups)) - 1
    name = F.when(overall, "all")
    value = F.lit("")
    for i, g in enumerate(groups):
        bit = (1 << len(groups)) - 1 - (1 << (len(groups) - 1 - i))
        name = name.when(F.col("_g") == bit, g)
        value = F.when(F.col("_g") == bit, F.col(g).cast("string")).otherwise(value)
    out = grouped.select(name.alias("grouping"), value.alias("value"), F.when(overall, F.col("_h")).otherwise(F.col("_vh")).alias("hits"), F.when(overall, F.col("_n")).otherwise(F.col("_vn")).alias("total"))
    return out.where("total > 0")


def ratio(hits: Column, total: Column) -> Column:
    """MTH-03: NULL without a total."""
    return F.round(F.try_divide(hits, total), 4)


def regressions(current: DataFrame, baseline: DataFrame, max_drop: float) -> DataFrame:
    """EVL-02: metrics that fell by more than ``max_drop`` or are gone (keys: metric, grouping)."""
    joined = baseline.select("metric", "grouping", F.col("score").alias("before")).join(current.select("metric", "grouping", "score"), ["metric", "grouping"], "left")
    return joined.where(F.col("score").isNull() | (F.col("before") - F.col("score") > max_drop))


def failure_changes(current: DataFrame, known: DataFrame) -> DataFrame:
    """SET-03: (row, field) failing now but not before (new), and before but not now (fixed)."""
    keys = ["row", "field"]
    new = current.select(keys).join(known.select(keys), keys, "left_anti").distinct().withColumn("change", F.lit("new"))
    return new.unionByName(known.select(keys).join(current.select(keys), keys, "left_anti").distinct().withColumn("change", F.lit("fixed")))


def stratified_sample(rows: DataFrame, stratum: str, key: str, share: tuple[int, int], seed: str) -> DataFrame:
    """AGG-19, STR-16: share (as a fraction of two integers) of all rows: each stratum its floor, the seats left to the largest
    remainders (then by hash), within a stratum by sha256 of seed and key. Integers throughout, so equal on any engine."""
    a, b = share
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    parts = sizes.select(stratum, F.expr(f"_n * {a} div {b}").alias("_floor"), F.expr(f"_n * {a} % {b}").alias("_rest"), "_n")
    total = parts.agg(F.sum("_n").alias("_all"), F.sum("_floor").alias("_given"))
    # One row for each stratum: numbered on one task, whatever the number of rows.
    number = F.row_number().over(Window.orderBy(F.desc("_rest"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(stratum).cast("string")), 256)))
    seats = parts.withColumn("_number", number).join(F.broadcast(total)).select(stratum, (F.col("_floor") + F.when(F.col("_number") <= F.expr(f"_all * {a} div {b} - _given"), 1).otherwise(0)).alias("_seats"))
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key)
    return rows.withColumn("_order", F.row_number().over(order)).join(seats, stratum).where("_order <= _seats").drop("_order", "_seats")


def frozen_append(rows: DataFrame, frozen: DataFrame, key: str, **sample) -> DataFrame:
    """SET-05: what was frozen, and a sample of the others."""
    fresh = stratified_sample(rows.join(frozen.select(key), key, "left_anti"), key=key, **sample)
    return frozen.select(key).withColumn("fresh", F.lit(False)).unionByName(fresh.select(key).withColumn("fresh", F.lit(True)))


def bigrams(text: Column) -> Column:
    """SET-06: the set of character bigrams."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def bigram_overlap(question: Column, text: Column) -> tuple[Column, Column]:
    """SET-06: shared bigrams and the question's bigrams; their ratio is 0 when the question has none."""
    own = bigrams(question)
    return F.size(F.array_intersect(own, bigrams(text))), F.size(own)


def pass_rates(rows: DataFrame, group: str, passed: Column, numeric: str = "numeric", least: tuple[int, int] = (9, 10)) -> DataFrame:
    """AGG-17: passes by group; the numeric group is accepted from a share on, the others when all pass."""
    out = rows.groupBy(group).agg(F.count_if(passed).alias("passed"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("accepted", F.when(F.col(group) == numeric, F.col("passed") * least[1] >= F.col("total") * least[0]).otherwise(F.col("passed") == F.col("total")))


def intent_scores(rows: DataFrame) -> DataFrame:
    """EVL-01: rows (id, expected and predicted structs of schools, codes, year, operation, metrics, privacy; the predicted one has prefixes too) with
    whether each field matches, and whether all do. Metrics count only where some are expected, and may be among others."""
    e, p = (lambda c: F.col(f"expected.{c}")), (lambda c: F.col(f"predicted.{c}"))
    none = F.array().cast("array<string>")
    full = lambda c: F.coalesce(c, none)
    codes = F.array_union(full(p("codes")), full(p("prefixes")))
    fields = {
        "schools": set_equal(full(p("schools")), full(e("schools"))),
        "codes": set_equal(codes, full(e("codes"))),
        "year": p("year").eqNullSafe(e("year")),
        "operation": p("operation").eqNullSafe(e("operation")),
        "privacy": F.coalesce(p("privacy"), F.lit(False)) == F.coalesce(e("privacy"), F.lit(False)),
        "metrics": F.when(F.size(full(e("metrics"))) > 0, subset(full(e("metrics")), full(p("metrics")))),
    }
    scored = rows.select("*", *[c.alias(f"{n}_ok") for n, c in fields.items()])
    exact = F.lit(True)
    for n in fields:
        exact = exact & F.coalesce(F.col(f"{n}_ok"), F.lit(True))
    return scored.withColumn("exact", exact)


def recall_summary(checks: DataFrame, group: str) -> DataFrame:
    """EVL-01: of checks (row, found, source_matches, scorable) per group: rows scored and not, how many rows have all their facts, facts found, sources right."""
    rows = checks.groupBy(group, "row").agg(F.bool_and("found").alias("all"), F.count(F.lit(1)).alias("n"), F.count_if("found").alias("found"), F.count_if(F.col("found") & F.col("source_matches")).alias("right"), F.bool_and("scorable").alias("scorable"))
    s = F.col("scorable")
    return rows.groupBy(group).agg(F.count_if(s).alias("rows"), F.count_if(~s).alias("unscorable"), F.count_if(s & F.col("all")).alias("passed"), F.sum(F.when(s, F.col("n")).otherwise(0)).alias("facts"), F.sum(F.when(s, F.col("found")).otherwise(0)).alias("found"), F.sum(F.when(s, F.col("right")).otherwise(0)).alias("sources"))
