"""References to entities, and extracted facts against a trusted seed that is never overwritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import written

ASKED = ("school", "college", "code", "mode")
#: Tasks over which the facts of one pool are dealt.
SPREAD = 16


def resolve_references(references: DataFrame, programs: DataFrame) -> DataFrame:
    """JON-07: school equal, any college key equal (or none asked), code equal, or its prefix for a pool; then the mode.

    references: fact, school, college, code, mode, pool. Without a program: unresolved; several without a pool: ambiguous; a pool
    needs a college. One row for each program found, or one with a status.
    """
    facts = references.select("fact", F.coalesce("pool", F.lit(False)).alias("pool"), *ASKED).distinct()
    # What is asked is resolved once, however many facts ask it; pairs of facts and programs are made last and are not moved.
    asked = written(facts.select("pool", *ASKED).distinct().select(F.monotonically_increasing_id().alias("ask"), "pool", *ASKED), "asked")
    college = F.col("r.college").isNull() | F.col("r.college").isin(F.col("p.college_id"), F.col("p.college_code"), F.col("p.college_name"))
    mode = F.col("r.mode").isNull() | (F.col("r.mode") == F.col("p.mode"))
    p = programs.alias("p")
    # A pool meets its programs by school, college and the code's first characters (as many as it has): all equalities.
    exact = asked.where("NOT pool").alias("r")
    found = exact.join(p, (F.col("r.school") == F.col("p.school")) & (F.col("r.code") == F.col("p.code")) & college & mode).select("r.ask", "p.program")
    keys = F.array_distinct(F.array_compact(F.array(*[F.col(c).cast("string") for c in ("college_id", "college_code", "college_name")])))
    sizes = [r[0] for r in asked.where("pool AND code IS NOT NULL").select(F.length("code")).distinct().collect()]  # lengths of codes: few
    if sizes:
        named = programs.select("program", "school", "mode", "code", F.explode(keys).alias("college")).select("*", F.explode(F.array(*map(F.lit, sorted(sizes)))).alias("size"))
        named = named.where(F.length("code") >= F.col("size")).withColumn("prefix", F.expr("substring(code, 1, size)")).alias("p")
        pools = asked.where("pool AND college IS NOT NULL").alias("r")
        same = (F.col("r.school") == F.col("p.school")) & (F.col("r.college") == F.col("p.college")) & (F.col("r.code") == F.col("p.prefix")) & (F.length("r.code") == F.col("p.size"))
        found = found.unionByName(pools.join(named, same & mode).select("r.ask", "p.program").distinct())
    found = written(found, "found")
    counts = found.groupBy("ask").agg(F.count("program").alias("n"))
    match = F.lit(True)
    for c in ("pool", *ASKED):
        match = match & F.col(f"f.{c}").eqNullSafe(F.col(f"a.{c}"))
    known = facts.alias("f").join(asked.join(counts, "ask", "left").alias("a"), match).select("f.fact", "f.pool", "a.ask", F.coalesce("a.n", F.lit(0)).alias("n"))
    n = F.sum("n").over(Window.partitionBy("fact"))
    status = F.when(F.col("n") == 0, "unresolved").when((F.col("n") > 1) & ~F.col("pool"), "ambiguous").otherwise("resolved")
    known = known.withColumns({"asks": F.count(F.lit(1)).over(Window.partitionBy("fact")), "n": n}).withColumn("status", status)
    judged = written(known, "judged")
    plain = judged.where("status <> 'resolved'").select("fact", "status", F.lit(None).cast(programs.schema["program"].dataType).alias("program"))
    # A pool's programs are many and asked for by many facts: its facts are dealt over SPREAD tasks.
    spread = F.when(F.col("pool"), F.pmod(F.xxhash64("fact"), F.lit(SPREAD)).cast("int")).otherwise(0)
    own = found.join(asked.select("ask", "pool"), "ask").select("ask", "program", F.explode(F.when(F.col("pool"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))).alias("spread"))
    resolved = judged.where("status = 'resolved'").withColumn("spread", spread)
    one = resolved.where("asks = 1").join(own, ["ask", "spread"]).select("fact", "status", "program")
    # Facts that ask several things have the programs of all, each once.
    several = resolved.where("asks > 1").select("fact", "status").distinct().join(judged.select("fact", "ask"), "fact").join(found, "ask").select("fact", "status", "program")
    return one.unionByName(several.distinct()).unionByName(plain.distinct())


def first_by_key(rows: DataFrame, key: Sequence[str], order: str = "id") -> DataFrame:
    """WIN-01, EXT-22: rows numbered within their key (NULLs equal), in order."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*key).orderBy(order)))


def reconcile(facts: DataFrame, seed: DataFrame, key: Sequence[str], fields: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """EXT-13, EXT-14, JON-08: the first fact of a key is match, conflict or new against the first seed row of that key (NULLs
    equal), later ones are duplicates. A NULL seed field, a missing optional field and white space make no difference."""
    own = first_by_key(facts, key)
    trusted = first_by_key(seed, key).where("number = 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[F.col(f).alias(f"_s_{f}") for f in fields], F.lit(True).alias("_seed"))
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))

    def differs(field: str) -> Column:
        a, b = (F.regexp_replace(F.col(c).cast("string"), r"(?U)\s+", "") for c in (field, f"_s_{field}"))
        out = F.col(f"_s_{field}").isNotNull() & ~a.eqNullSafe(b)
        return out & F.col(field).isNotNull() if field in optional else out

    changed = F.array_compact(F.array(*[F.when(differs(f), f) for f in fields]))
    joined = own.join(trusted, same, "left").withColumn("differences", F.when((F.col("number") == 1) & F.col("_seed"), F.array_join(changed, ",")).otherwise(""))
    status = F.when(F.col("number") > 1, "duplicate").when(F.col("_seed").isNull(), "new").when(F.col("differences") == "", "match").otherwise("conflict")
    return joined.withColumn("status", status).withColumn("verified", F.col("status") == "match").select("id", *key, *fields, "status", "differences", "verified")


def coverage(seed: DataFrame, results: DataFrame, document: str = "source") -> DataFrame:
    """AGG-11, AGG-12: for each document its seed rows, how many were matched, conflicting or missing, and whether it passes."""
    statuses = results.groupBy(document).agg(F.count_if(F.col("status") == "match").alias("matched"), F.count_if(F.col("status") == "conflict").alias("conflicts"), F.count_if(F.col("status") == "new").alias("new"))
    rows = seed.groupBy(document).agg(F.count(F.lit(1)).alias("seed"))
    joined = rows.join(statuses, document, "full_outer").na.fill(0, ["seed", "matched", "conflicts", "new"])
    return joined.withColumn("missing", F.greatest(F.col("seed") - F.col("matched") - F.col("conflicts"), F.lit(0))).withColumn("passed", (F.col("seed") > 0) & (F.col("matched") == F.col("seed")) & (F.col("conflicts") == 0))


def missing_reason(status: Column, personal: Column, extractor: Column, conflict: Column) -> Column:
    """FLT-15: why a seed row was not found again; the first rule wins."""
    return F.when(status == "seed_only", "document not held").when(status == "removed", "document removed").when(personal, "personal document").when(~extractor, "no extractor").when(conflict, "other value").otherwise("not found")


def exactly_one(facts: DataFrame, key: str = "key") -> DataFrame:
    """JON-13: how many distinct verified (value, source) a key has: none, one (then given) or many."""
    pair = F.struct("value", "source")
    counted = facts.groupBy(key).agg(F.countDistinct(F.when(F.col("verified"), pair)).alias("n"), F.min(F.when(F.col("verified"), pair)).alias("_one"))
    verdict = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many")
    return counted.select(key, "n", verdict.alias("verdict"), F.when(F.col("n") == 1, F.col("_one.value")).alias("value"))


def best_fact(facts: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """JON-14: one fact a program: scope's rank, latest year, verified first, smallest source."""
    place = F.array_position(F.lit(list(ranks)), F.col("kind"))
    order = Window.partitionBy("program").orderBy(F.when(place > 0, place).otherwise(len(ranks) + 1), F.desc("year"), F.desc("verified"), "source", "id")
    return facts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def known_lookup(found: DataFrame, known: DataFrame, keys: Sequence[str] = ("key", "url", "digest")) -> DataFrame:
    """JON-10: the known document of each found one, by the first of the keys that has one."""
    out, matches = found, []
    for k in keys:
        one = known.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_{k}")).agg(F.min("doc").alias(f"_doc_{k}"))
        out = out.join(one, F.col(k) == F.col(f"_{k}"), "left").drop(f"_{k}")
        matches.append(f"_doc_{k}")
    by = F.coalesce(*[F.when(F.col(m).isNotNull(), k) for m, k in zip(matches, keys, strict=True)])
    return out.withColumn("known", F.coalesce(*matches)).withColumn("by", by).drop(*matches)


def pick_source(candidates: DataFrame, weights: dict[str, int]) -> DataFrame:
    """EXT-21: the candidate with the highest sum of weights, earliest of equals; personal ones only if there is no other."""
    score = sum((F.when(F.col(flag), w).otherwise(0) for flag, w in weights.items()), F.lit(0))
    return candidates.groupBy("fact").agg(F.max_by("doc", F.struct(~F.col("personal"), score, -F.col("position"))).alias("doc"), F.max(F.when(~F.col("personal"), score)).alias("score"))


def pools(rows: DataFrame, says_pool: str = "says_pool") -> DataFrame:
    """EXT-03: groups in which several codes share one value, and the text says that it is shared."""
    out = rows.groupBy("group").agg(F.countDistinct("code").alias("codes"), F.countDistinct("value").alias("values"), F.bool_or(says_pool).alias("_says"))
    return out.select("group", "codes", ((F.col("codes") > 1) & (F.col("values") == 1) & F.col("_says")).alias("is_pool"))


def unpivot_seed(wide: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """EXT-20: one fact for each filled column of a wide row; columns: column → kind."""
    names = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])
    return wide.unpivot([key], list(columns), "column", "value").where("value IS NOT NULL").select(key, names[F.col("column")].alias("kind"), "value")
