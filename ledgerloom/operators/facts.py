"""Facts with provenance: catalogue filters, first-wins merging, bounded estimates, three-valued search.

Every operator takes and returns DataFrames and is one declarative plan; order-dependent rules carry an explicit order column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compact(text: Column) -> Column:
    """STR-02: without white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def code_matches(code: Column, wanted: str) -> Column:
    """FLT-03: four characters are a prefix, else the whole code."""
    wanted = "".join(wanted.split()).upper()
    return code.startswith(wanted) if len(wanted) == 4 else code == wanted


def college_matches(text: str, *, ids: Sequence[str] = ("college_id", "college_code", "college_slug"), name: str = "college_name", suffix: str = "学院") -> Column:
    """FLT-02: an id, code, slug or name, or names that hold each other without their suffix."""
    text = "".join(text.split())
    core = text.removesuffix(suffix)
    own = F.regexp_replace(name, f"{suffix}$", "")
    out = F.col(name) == text
    for c in ids:
        out = out | (F.col(c).cast("string") == text)
    return F.coalesce(out, F.lit(False)) | F.coalesce((F.lit(core) != "") & (own != "") & (F.col(name).contains(core) | F.lit(text).contains(own)), F.lit(False))


def find_programs(programs: DataFrame, directions: DataFrame | None = None, *, school: str | None = None, college: str | None = None, code: str | None = None, degree: str | None = None, mode: str | None = None, keyword: str | None = None, ids: Sequence | None = None) -> DataFrame:
    """FLT-01: conjunctive optional filters; a list of ids stands alone; the keyword may be in the name or in a direction's name."""
    if ids is not None:
        return programs.where(F.col("program").isin(list(ids)))
    if school:
        programs = programs.where(F.col("school") == school)
    if college:
        programs = programs.where(college_matches(college))
    if code:
        programs = programs.where(code_matches(F.col("code"), code))
    for column, value in (("degree", degree), ("mode", mode)):
        if value:
            programs = programs.where(F.col(column) == value.strip())
    if keyword:
        named = F.col("name").contains(keyword)
        if directions is None:
            return programs.where(named)
        having = directions.where(F.col("direction").contains(keyword)).select("program").distinct().withColumn("has", F.lit(True))
        programs = programs.join(having, "program", "left").where(named | F.col("has")).drop("has")
    return programs


def discipline(code: Column) -> Column:
    """FLT-08: professional codes (third character 5) give four characters, others two."""
    return F.when(F.substring(code, 3, 1) == "5", F.substring(code, 1, 4)).otherwise(F.substring(code, 1, 2))


def latest(facts: DataFrame, *keys: str, year: str = "year") -> DataFrame:
    """AGG-01, WIN-02, JON-03: the rows of each key's latest year, ties kept."""
    return facts.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(year)))).where("_rank = 1").drop("_rank")


def value_label(value: Column, upper: Column, source: Column, pool: Column | None = None) -> Column:
    """AGG-02: ``[≤]value[pool]@source``; NULL without a value."""
    mark = F.when(upper, "≤").otherwise("")
    scope = F.when(pool.isNotNull(), F.concat(F.lit("["), pool, F.lit("]"))).otherwise("") if pool is not None else F.lit("")
    return F.concat(mark, value.cast("string"), scope, F.lit("@"), source.cast("string"))


def facts_view(plans: DataFrame, kinds: Sequence[str], names: Sequence[str]) -> DataFrame:
    """AGG-02..04: for each program and kind the latest year's distinct labels, first one first, as one column for each kind."""
    now = latest(plans, "program", "kind")
    item = value_label(F.col("value"), F.col("is_upper_bound"), F.col("source"))
    items = now.groupBy("program", "kind", item.alias("item")).agg(F.min("id").alias("first"))
    lists = items.groupBy("program", "kind").agg(F.expr("listagg(item, '; ') WITHIN GROUP (ORDER BY first)").alias("items"))
    pivoted = lists.groupBy("program").pivot("kind", list(kinds)).agg(F.first("items"))
    return pivoted.select("program", *[F.col(f"`{k}`").alias(n) for k, n in zip(kinds, names, strict=True)])


def merge_facts(facts: DataFrame, key: Sequence[str], values: Sequence[str], *, rank: str = "rank", backfill: Sequence[str] = ("evidence",)) -> DataFrame:
    """AGG-06, WIN-01, AGG-20: of rows with one key (NULLs equal) the first by (rank, id) wins; verified by any; methods joined;
    empty texts are filled from the first later row that has one."""
    order = F.struct(rank, "id")
    filled = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", order)).alias(c) for c in backfill]
    return facts.groupBy(*key).agg(
        F.min_by(F.struct("id", *values), order).alias("_first"),
        F.bool_or("verified").alias("verified"),
        F.array_join(F.array_sort(F.collect_set(F.col("method").cast("string"))), ",").alias("methods"),
        *filled,
    ).select(*key, "_first.*", "verified", "methods", *backfill)


def estimates(plans: DataFrame, *, explicit: Sequence[str], catalog: str, quota: str) -> DataFrame:
    """AGG-07, JON-09, MTH-01: explicit values, and catalogue less quota of one year: exact less exact is exact, exact less an upper
    bound is a lower bound. Pairs of one source are preferred to others of the year. Pooled values are no estimates."""
    usable = plans.where(F.col("pool").isNull() & F.col("value").isNotNull())
    direct = usable.where(F.col("kind").isin(list(explicit))).select("program", "year", "value", F.when(F.col("is_upper_bound"), "upper").otherwise("exact").alias("bound"), F.lit("explicit").alias("basis"), F.col("value").cast("string").alias("formula"))
    total = usable.where((F.col("kind") == catalog) & ~F.col("is_upper_bound")).select("program", "year", F.col("id").alias("catalog_id"), F.col("value").alias("total"), F.col("source").alias("catalog_source"))
    part = usable.where(F.col("kind") == quota).select("program", "year", F.col("value").alias("part"), F.col("is_upper_bound").alias("open"), F.col("source").alias("quota_source"))
    same = F.col("catalog_source") == F.col("quota_source")
    pairs = total.join(part, ["program", "year"]).withColumn("_any", F.max(same).over(Window.partitionBy("catalog_id"))).where(same | ~F.col("_any"))
    derived = pairs.select("program", "year", (F.col("total") - F.col("part")).alias("value"), F.when(F.col("open"), "lower").otherwise("exact").alias("bound"), F.lit("derived").alias("basis"), F.concat(F.col("total").cast("string"), F.lit(" - "), F.when(F.col("open"), "≤").otherwise(""), F.col("part").cast("string")).alias("formula"))
    return direct.unionByName(derived).groupBy("program", "year", "value", "bound", "basis").agg(F.min("formula").alias("formula"))


def pooled_reasons(plans: DataFrame, explicit: Sequence[str]) -> DataFrame:
    """AGG-07: why a pooled value is no estimate of a program."""
    pooled = plans.where(F.col("pool").isNotNull() & F.col("kind").isin(list(explicit)))
    text = F.concat(F.col("kind"), F.lit(" is pooled in "), F.col("pool").cast("string"))
    return pooled.groupBy("program").agg(F.array_join(F.array_sort(F.collect_set(text)), "; ").alias("reasons"))


def basis(found: DataFrame) -> DataFrame:
    """AGG-08, STM-14: the latest year alone, and explicit estimates where there are any."""
    now = latest(found, "program")
    own = F.bool_or(F.col("basis") == "explicit").over(Window.partitionBy("program"))
    return now.withColumn("_explicit", own).where((F.col("basis") == "explicit") | ~F.col("_explicit")).drop("_explicit")


def threshold_verdicts(based: DataFrame, least: int) -> DataFrame:
    """FLT-05: any value (even a lower bound) of ``least`` or more passes; else any exact value refutes; else unknown."""
    return based.groupBy("program").agg(F.bool_or(F.col("value") >= least).alias("_pass"), F.bool_or(F.col("bound") != "lower").alias("_exact")).select(
        "program", F.when(F.col("_pass"), "match").when(F.col("_exact"), "excluded").otherwise("unknown").alias("threshold")
    )


STATUS_ORDER = ("known", "no_exam", "unknown")


def subject_groups(subjects: DataFrame, special: str = "408") -> DataFrame:
    """AGG-09: slots of one (program, year, status, source) joined in order; later groups that repeat year, status and codes go;
    numbered by year (latest first) and status."""
    groups = subjects.groupBy("program", "year", "status", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "id", F.col("code").cast("string").alias("code")))), lambda x: x["code"]), "/").alias("codes"), F.min("id").alias("first"))
    once = groups.groupBy("program", "year", "status", "codes").agg(F.min(F.struct("first", "source")).alias("_f"))
    place = F.array_position(F.lit(list(STATUS_ORDER)), F.col("status"))
    number = F.row_number().over(Window.partitionBy("program").orderBy(F.desc("year"), place, "first"))
    out = once.select("program", "year", "status", "codes", F.col("_f.source").alias("source"), F.col("_f.first").alias("first"))
    return out.select("*", F.array_contains(F.split("codes", "/"), special).alias("is_special"), number.alias("number")).drop("first")


def search(programs: DataFrame, groups: DataFrame, based: DataFrame, *, special: bool | None = None, contains: str | None = None, lacks: str | None = None, least: int | None = None) -> DataFrame:
    """FLT-04: match, unknown or excluded, each with its reasons. Subject conditions use the latest group; a threshold is looked at
    only where they do not exclude."""
    newest = groups.where("number = 1").select("program", "status", "codes", "is_special")
    rows = programs.join(newest, "program", "left")
    codes = F.split("codes", "/")
    wrong = F.lit(False)
    for asked, holds in ((special, F.col("is_special")), (True if contains else None, F.array_contains(codes, contains or "")), (False if lacks else None, F.array_contains(codes, lacks or ""))):
        if asked is not None:
            wrong = wrong | (holds != asked)
    conditions = special is not None or contains or lacks
    open_ = F.col("status").isNull() | (F.col("status") == "unknown") if conditions else F.lit(False)
    out = F.coalesce((F.col("status") == "no_exam") | (~open_ & wrong), F.lit(False)) if conditions else F.lit(False)
    subject = F.when(out & (F.col("status") == "no_exam"), "no exam").when(out, "subjects differ").when(open_, "subjects unknown")
    rows = rows.withColumn("_out", out).withColumn("_subject", subject)
    if least is None:
        limit = F.lit(None).cast("string")
    else:
        rows = rows.join(threshold_verdicts(based, least), "program", "left")
        limit = F.when(~F.col("_out"), F.when(F.coalesce("threshold", F.lit("unknown")) == "unknown", "value unknown").when(F.col("threshold") == "excluded", "value too small"))
    rows = rows.withColumn("_limit", limit)
    verdict = F.when(F.col("_out") | (F.col("_limit") == "value too small"), "excluded").when(F.col("_subject").isNotNull() | F.col("_limit").isNotNull(), "unknown").otherwise("match")
    reasons = F.when(F.col("_limit") == "value too small", F.col("_limit")).otherwise(F.concat_ws("; ", "_subject", "_limit"))
    return rows.select("program", verdict.alias("verdict"), reasons.alias("reasons"))


def lines_with_baselines(programs: DataFrame, lines: DataFrame, baselines: DataFrame, no_exam: DataFrame) -> DataFrame:
    """JON-06, SET-01, FLT-17: a program's own lines and its school's lines for its discipline, but for programs without an exam."""
    own = lines.select("program", "year", "total", F.lit("college").alias("scope"))
    wide = programs.withColumn("discipline", discipline(F.col("code"))).join(baselines, ["school", "discipline"]).join(no_exam.select("program").distinct(), "program", "left_anti")
    return own.unionByName(wide.select("program", "year", "total", F.lit("baseline").alias("scope")))


def with_source(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """JON-02, JON-05: a fact's document by id: the page's URL else the attachment's; the attachment shows only beside a page."""
    docs = documents.select(F.col("id").alias("source"), "title", "page_url", "attachment_url")
    joined = facts.join(docs, "source", "left")
    return joined.select(*facts.columns, "title", F.coalesce("page_url", "attachment_url").alias("url"), F.when(F.col("page_url").isNotNull(), F.col("attachment_url")).alias("attachment"))


def compare(programs: DataFrame, lines: DataFrame, plans: DataFrame) -> DataFrame:
    """QRY-03, SRT-01: one flat row a program: its main line (college else baseline) and plan of the latest year, and what is missing."""
    order = F.struct(F.col("year"), F.when(F.col("scope") == "college", 1).otherwise(0), -F.col("total"))
    main = lines.groupBy("program").agg(F.max_by(F.struct("year", "scope", "total"), order).alias("line"))
    plan = plans.groupBy("program").agg(F.max_by("value", F.struct("year", -F.col("id"))).alias("plan"))
    joined = programs.join(main, "program", "left").join(plan, "program", "left")
    gaps = F.concat_ws("; ", F.when(F.col("line").isNull(), "line: not found"), F.when(F.col("plan").isNull(), "plan: not found"))
    return joined.select("program", F.col("line.total").alias("line"), F.col("line.scope").alias("scope"), F.col("line.year").alias("line_year"), "plan", gaps.alias("gaps"))


def label_codes(column: str, labels: dict[str, str]) -> Column:
    """MAP-01: the label of a code, else the code."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column))


def split_list(text: Column) -> Column:
    """ARR-07: parts between commas, ASCII or full-width, without the empty ones."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, "，", ","), ","), lambda x: F.trim(x)), lambda x: x != "")


def nested_facts(programs: DataFrame, **facts: DataFrame) -> DataFrame:
    """QRY-01: each program with an array of structs for every kind of fact, ordered by year (latest first) and id."""
    for name, rows in facts.items():
        columns = [c for c in rows.columns if c != "program"]
        lists = rows.groupBy("program").agg(F.array_sort(F.collect_list(F.struct((-F.col("year")).alias("_y"), "id", *[c for c in columns if c != "id"]))).alias(name))
        programs = programs.join(lists, "program", "left").withColumn(name, F.coalesce(name, F.array()))
    return programs


def lookup(programs: DataFrame, facts: DataFrame, value: str, year: int | None) -> DataFrame:
    """QRY-02: facts of a year (None or 0: all); programs without any stay, as unknown."""
    rows = facts.where(F.col("year") == year) if year else facts
    return programs.select("program").join(rows, "program", "left").select("program", "year", F.coalesce(F.col(value).cast("string"), F.lit("unknown")).alias(value))
