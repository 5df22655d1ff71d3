"""The document that a fact is taken from (STR-23, EXT-21): the best of its school's documents by a sum of points.

Points depend on a fact's context (what kind of source, school, college, program, mode, year) and not on the fact, so contexts are scored once however many
facts share them, and against documents of the wanted types only. Documents that the fact's own row lists, and those at a link that the note gives, are few and
scored for each fact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """Document types in order of preference, words that a title should have (or must), and whether an attachment is better."""

    types: tuple[str, ...]
    words: tuple[str, ...] = ()
    must: bool = False
    attachment: bool = False


# What each kind of source prefers.
KINDS = {
    "catalog": Kind(("catalog", "tm_catalog", "brochure"), ("目录",)),
    "subjects": Kind(("catalog", "subject_change", "tm_catalog", "brochure"), ("目录", "科目"), attachment=True),
    "college_line": Kind(("retest_rules", "score_line"), ("分数线",), attachment=True),
    "school_baseline": Kind(("score_line",), ("基本要求", "基本分数线", "分数线"), attachment=True),
    "rules_plan": Kind(("retest_rules",), ("细则", "招生人数"), attachment=True),
    "retest_plan": Kind(("retest_rules",), ("复试方案",)),
    "special": Kind(("retest_rules", "score_line"), ("分数线", "细则", "复试方案")),
    "college_exam_plan": Kind(("plan_quota", "notice", "retest_rules"), ("统考计划", "招生计划")),
    "available_exam": Kind(("plan_quota",), ("统考可用计划",), must=True, attachment=True),
    "tm_catalog": Kind(("tm_catalog",)),
    "tm_policy": Kind(("tm_policy",), ("推免",)),
    "admission": Kind(("admission_list",), ("拟录取",)),
    "retest_count": Kind(("retest_list", "retest_rules", "admission_list"), ("复试名单", "复试方案")),
}
# Points.
TYPE, NEXT_TYPE, LISTED, COLLEGE, OTHER_COLLEGE, YEAR, OTHER_YEAR, WORD, OTHER_CODE, PART_TIME, NOT_PART_TIME, ATTACHED, PERSONAL = 100, -10, 20, 30, -50, 10, -40, 15, -50, 10, -20, 2, -3
PART = "非全日制"
CODE = r"(?<![0-9A-Z])(\d{4}[0-9A-Z]{2})(?![0-9A-Z])"
CONTEXT = ["source_kind", "school", "college_code", "college_name", "code", "mode", "year"]


def preferences(facts: DataFrame) -> DataFrame:
    """One row for each kind and document type."""
    rows = [(k, t, TYPE + NEXT_TYPE * i, list(v.words), v.must, v.attachment) for k, v in KINDS.items() for i, t in enumerate(v.types)]
    return F.broadcast(facts.sparkSession.createDataFrame(rows, "source_kind string, doc_type string, _points int, _words array<string>, _must boolean, _attached boolean"))


def points(in_row: bool) -> Column:
    """Points of a document for a context; NULL where a word that it must have is missing."""
    none = F.lit(0)
    title = F.coalesce("title", F.lit(""))
    word = F.exists("_words", lambda w: title.contains(w))
    same = F.when(F.coalesce("college_code", F.lit("")) != "", F.col("doc_college_code").eqNullSafe(F.col("college_code"))).otherwise(F.col("doc_college_name").eqNullSafe(F.col("college_name")))
    codes = F.regexp_extract_all(title, F.lit(CODE), 1)
    part = F.concat(title, F.coalesce("local_path", F.lit(""))).contains(PART)
    total = (
        F.col("_points") + (LISTED if in_row else 0)
        + F.when(F.coalesce("school_level", F.lit(False)), none).when(same, COLLEGE).otherwise(OTHER_COLLEGE)
        + F.when(F.col("year").isNull() | F.col("intake_year").isNull(), none).when(F.col("year") == F.col("intake_year"), YEAR).otherwise(OTHER_YEAR)
        + F.when(word, WORD).otherwise(none)
        + F.when((F.size(codes) > 0) & (F.coalesce("code", F.lit("")) != "") & ~F.array_contains(codes, F.coalesce("code", F.lit(""))), OTHER_CODE).otherwise(none)
        + F.when(part & F.col("mode").eqNullSafe(PART), PART_TIME).when(part, NOT_PART_TIME).otherwise(none)
        + F.when(F.col("_attached") & F.col("attachment_url").isNotNull(), ATTACHED).otherwise(none)
        + F.when(F.coalesce("personal", F.lit(False)), PERSONAL).otherwise(none)
    )
    return F.when(word | ~F.col("_must"), total)


def best_sources(facts: DataFrame, documents: DataFrame, listed: DataFrame) -> DataFrame:
    """``facts`` (fact, row and the columns of CONTEXT, url) with ``doc``: of documents at the fact's link the best, else the best of those that its row
    lists (``listed``: row, doc, position) and of all its school's; if none fits, the first that its row lists, personal ones last.
    ``documents``: doc, position, school, doc_type, title, doc_college_code, doc_college_name, school_level, intake_year, local_path, page_url,
    attachment_url, personal."""
    wanted = preferences(facts)
    docs = documents.withColumnRenamed("position", "_position").withColumnRenamed("school", "_school")
    best = lambda rows, by, *ties: rows.where("_score IS NOT NULL").groupBy(*by).agg(F.max(F.struct("_score", *[(-F.col(t)).alias(f"_{i}") for i, t in enumerate(ties)], "doc")).alias("_best"))

    contexts = facts.select(*CONTEXT).distinct().join(wanted, "source_kind")
    pairs = contexts.join(docs.withColumnRenamed("doc_type", "_type"), (F.col("school") == F.col("_school")) & (F.col("doc_type") == F.col("_type")))
    general = best(pairs.withColumn("_score", points(False)), CONTEXT, "_position").select(*CONTEXT, F.col("_best").alias("_general"))

    own = facts.join(wanted, "source_kind")
    candidates = listed.join(docs, "doc").withColumnRenamed("doc_type", "_type")
    in_row = own.join(candidates, "row").where("doc_type = _type").withColumn("_score", points(True))
    of_row = best(in_row, ["fact"], "position").select("fact", F.col("_best").alias("_row_best"))
    links = docs.select("*", F.explode(F.array(F.struct(F.col("attachment_url").alias("url"), F.lit(0).alias("kind")), F.struct(F.col("page_url").alias("url"), F.lit(1).alias("kind")))).alias("_link")).where("_link.url IS NOT NULL")
    links = links.withColumnsRenamed({"doc_type": "_type"}).withColumns({"_url": F.col("_link.url"), "_by": F.col("_link.kind")}).drop("_link")
    at_link = own.join(links, F.col("url") == F.col("_url")).where("doc_type = _type").withColumn("_score", points(True))
    of_link = best(at_link, ["fact"], "_by", "_position").select("fact", F.col("_best.doc").alias("_linked"))
    first = listed.join(documents.select("doc", "personal"), "doc").groupBy("row").agg(F.min_by("doc", F.struct(F.coalesce("personal", F.lit(False)), "position")).alias("_first"))

    same = F.lit(True)
    for c in CONTEXT:
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"g.{c}"))
    found = facts.alias("f").join(general.alias("g"), same, "left").select("f.*", "_general").join(of_row, "fact", "left").join(of_link, "fact", "left").join(first, "row", "left")
    listed_wins = F.col("_row_best").isNotNull() & (F.col("_general").isNull() | (F.col("_row_best._score") >= F.col("_general._score")))
    doc = F.coalesce("_linked", F.when(listed_wins, F.col("_row_best.doc")), "_general.doc", "_first")
    return found.select(*facts.columns, doc.alias("doc"))
