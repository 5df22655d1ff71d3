"""Questions as structs (FLT-12, STR-11): the schools named, found by one automaton over all aliases, and what is asked, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import SCHOOL_ALIASES, any_word

# Patterns of codes, disciplines, years and colleges, and the words that lead into a college's name.
PROGRAM = r"(?<![0-9A-Za-z])((?:0[1-9]|1[0-4])\d{2}[0-9A-Z]{2})(?![0-9A-Za-z])"
DISCIPLINE = r"(?<![0-9A-Za-z])((?:0[1-9]|1[0-4])\d{2})(?![0-9A-Za-z])"
YEAR = r"(?<!\d)(20[2-3]\d)(?!\d)"
COLLEGE, LEADS_IN = r"([一-鿿]{2,14}?学院)", "的在查看问请帮我"
# Words of each kind of question, in this order; words of a question of this field; of an export.
KINDS = {
    "score_line": ("复试线", "分数线", "国家线", "校线", "基本线", "多少分", "进复试"),
    "plan": ("招多少", "招几", "多少人", "几个人", "计划", "名额", "统招", "统考招", "推免多少", "公开招考", "拟招"),
    "subjects": ("考什么", "考不考", "考408", "考 408", "初试科目", "科目", "专业课", "考哪"),
    "compare": ("对比", "比较", "相比", "vs", "VS"),
    "filter": ("哪些", "筛选", "有哪些", "哪几个", "列出所有"),
    "directions": ("有没有", "方向"),
}
FIELD = ("复试", "推免", "统招", "统考", "考研", "招生", "研究生", "硕士", "408", "初试", "拟录取", "专硕", "学硕", "调剂", "分数线", "研招", "招多少", "考什么")
EXPORT = ("导出", "excel", "Excel", "xlsx", "markdown", "Markdown", "报告文件", "落盘")
# What asks for a person, a least plan, a subject to be skipped (and its code), a name.
PRIVATE = r"(名单|录取|复试名单|拟录取).{0,12}(有没有|是否有|查|找|姓名|名字|编号|某某)|考生编号|准考证|姓名|个人成绩"
LEAST = r"(统招|统考|公开招考)[^0-9]{0,6}?(>=|≥|>|＞|大于等于|大于|超过|多于|不少于|至少)\s*(\d+)"
STRICT = (">", "＞", "大于", "超过", "多于")
SKIPPED = r"不(?:用|需要)?考\s*(\d{3}|数学[一二]?|英语[一二]?|政治|日语|俄语)"
SUBJECT_CODES = {"数学一": "301", "数学二": "302", "英语一": "201", "英语二": "204"}
NAME = r"有没有([一-鿿A-Za-z]{2,12}?)(?:学硕|专硕|专业|方向|学位|[（(？?，,]|$)"

NAMED = "struct<ids:array<string>,rest:string>"
INTENT = ("schools", "codes", "prefixes", "colleges", "year", "kinds", "numeric", "privacy", "export", "filters", "name")


def find_aliases(aliases: dict[str, Sequence[str]] = SCHOOL_ALIASES):
    """STR-11: a function of texts to (ids in order of appearance, the text with a space for each alias). Longer aliases win, none overlap, and one in ASCII
    needs borders that are no ASCII letters or digits. The automaton is built once and goes out with the task; a text is read once, however many aliases there are."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for own, names in sorted(aliases.items()):
        for name in sorted(names):
            if name and name.lower() not in found:
                found.add_word(name.lower(), (name.lower(), own))
    if len(found):
        found.make_automaton()

    def one(text: str | None) -> tuple[list[str], str]:
        text = text or ""
        low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        inner = lambda i: 0 <= i < len(low) and low[i].isascii() and low[i].isalnum()
        hits = []
        for end, (name, own) in found.iter(low) if len(found) else ():
            start = end + 1 - len(name)
            if not name.isascii() or not (inner(start - 1) or inner(end + 1)):
                hits.append((-len(name), name, start, own))
        taken: dict[int, tuple[int, str]] = {}
        covered = bytearray(len(low))
        for size, _, start, own in sorted(hits):
            if not any(covered[start : start - size]):
                covered[start : start - size] = b"\1" * -size
                taken[start] = (start - size, own)
        rest, at = [], 0
        for start in sorted(taken):
            rest += [text[at:start], " "]
            at = taken[start][0]
        return list(dict.fromkeys(taken[s][1] for s in sorted(taken))), "".join([*rest, text[at:]])

    return one


def schools_named(text: Column, aliases: dict[str, Sequence[str]] = SCHOOL_ALIASES) -> Column:
    one = find_aliases(aliases)

    @F.pandas_udf(NAMED)
    def named(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["ids", "rest"])

    return named(text)


def intents(questions: DataFrame, question: str, aliases: dict[str, Sequence[str]] = SCHOOL_ALIASES) -> DataFrame:
    """FLT-12: ``questions`` with ``intent``: schools, codes, prefixes (disciplines), colleges, year, kinds (in order; ``narrative`` without any), whether it is
    numeric, asks for a person (to be refused) or an export, the filters, and the name it looks for; ``in_field`` says whether it belongs here at all."""
    text = F.coalesce(F.col("_named.text"), F.lit(""))
    every = lambda pattern, of: F.array_distinct(F.regexp_extract_all(of, F.lit(pattern), 1))
    first = lambda pattern, group=1: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))
    has = lambda words: any_word(text, words)
    schools, codes = F.col("_named.found.ids"), every(PROGRAM, text)
    prefixes = F.filter(every(DISCIPLINE, F.regexp_replace(text, PROGRAM, " ")), lambda p: ~p.rlike(f"^{YEAR}$"))
    colleges = F.filter(F.transform(F.regexp_extract_all("_named.found.rest", F.lit(COLLEGE), 1), lambda c: F.regexp_replace(c, f"^[{LEADS_IN}]+", "")), lambda c: F.length(c) > 2)
    private, least = text.rlike(PRIVATE), first(LEAST, 3).cast("int")
    kinds = {k: has(words) for k, words in KINDS.items()}
    four = text.contains("四校") & ~kinds["compare"] & (text.contains("复试线") | text.contains("计划"))
    told = [*kinds.items(), ("compare", four), ("privacy", private), ("export", has(EXPORT))]
    own = F.array_compact(F.array(*[F.when(when, F.lit(k)) for k, when in told]))
    own = F.when(F.size(own) == 0, F.array(F.lit("narrative"))).otherwise(own)
    own = F.when(least.isNotNull() & ~F.array_contains(own, "filter"), F.concat(own, F.array(F.lit("filter")))).otherwise(own)
    narrowed = kinds["filter"] | kinds["compare"] | four
    skipped = first(SKIPPED)
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SUBJECT_CODES.items() for x in pair]), skipped), skipped)
    part, full = text.contains("非全"), text.contains("全日制")
    academic, applied = text.contains("学硕"), text.contains("专硕")
    filters = F.struct(
        F.when(narrowed, F.when(skipped == "408", F.lit(False)).when(skipped.isNull() & text.contains("408"), F.lit(True))).alias("is_408"),
        F.when(narrowed & (skipped != "408"), code).alias("exclude_subject"),
        F.when(narrowed, F.when(part, "非全日制").when(full, "全日制")).alias("study_mode"),
        F.when(narrowed, F.when(academic & ~applied, "学硕").when(applied & ~academic, "专硕")).alias("degree_type"),
        (least + F.when(first(LEAST, 2).isin(*STRICT), 1).otherwise(0)).alias("min_public_plan"),
    )
    numeric = F.arrays_overlap("kinds", F.array(*map(F.lit, ("score_line", "plan", "filter", "compare"))))
    asked = questions.select("*", F.struct(F.col(question).alias("text"), schools_named(F.col(question), aliases).alias("found")).alias("_named"))
    asked = asked.withColumns({"kinds": own, "_parts": F.struct(
        schools.alias("schools"), codes.alias("codes"), prefixes.alias("prefixes"), colleges.alias("colleges"), first(YEAR).cast("int").alias("year"), private.alias("privacy"),
        has(EXPORT).alias("export"), filters.alias("filters"), F.when(~private, first(NAME)).alias("name"), ((F.size(schools) > 0) | (F.size(codes) > 0) | has(FIELD)).alias("in_field"),
    )})
    parts = {c: F.col(f"_parts.{c}") for c in INTENT if c not in ("kinds", "numeric")} | {"kinds": F.col("kinds"), "numeric": numeric}
    return asked.select(*questions.columns, F.struct(*[parts[c].alias(c) for c in INTENT], F.col("_parts.in_field").alias("in_field")).alias("intent"))
