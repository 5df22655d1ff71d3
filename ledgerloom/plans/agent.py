"""From a question to operators: intent, plan, calls, checks of the answer (FLT-12, AGT-01..06, UDF-05, API-02, API-04).

The loop runs on the driver over small results; every call is a DataFrame operator, and a model is any callable from text to text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T

MARKER = "[unsupported]"


def intent(question: Column) -> Column:
    """FLT-12: schools apart (see alias_finder), what a question asks: codes, prefixes, year, skipped subject, 408, mode, least plan, and whether it
    asks for lines, plans, subjects, private data or an export."""
    plain = F.regexp_replace(question, r"(?U)\s+", "")
    codes = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?<![0-9A-Za-z])(\d{4}[0-9A-Z]{2})(?![0-9A-Za-z])"), 1))
    year = T.extract(plain, r"(?<!\d)(20[0-3]\d)(?=年|级|届|(?!\d))")
    four = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?<![0-9A-Za-z])(\d{4})(?![0-9A-Za-z])"), 1))
    least = T.extract(plain, r"(?:统招|计划|招生|人数|名额)[^0-9>≥＞]{0,4}(?:>=|≥|>|＞|至少|不少于|超过)(\d{1,5})").cast("int")
    strict = plain.rlike(r"(?:统招|计划|招生|人数|名额)[^0-9>≥＞]{0,4}(?:>(?!=)|＞|超过)\d")
    return F.struct(
        codes.alias("codes"),
        F.filter(four, lambda x: ~x.rlike(r"^20[0-3]\d$")).alias("prefixes"),
        year.cast("int").alias("year"),
        F.when(plain.rlike(r"考408|408"), ~plain.rlike(r"(?:不考|非|除)408")).alias("is_408"),
        T.study_mode(plain).alias("mode"),
        (least + F.when(strict, 1).otherwise(0)).alias("least"),
        T.any_word(plain, ("复试线", "分数线", "过线")).alias("lines"),
        T.any_word(plain, ("招多少", "招生人数", "计划", "名额", "统招", "推免")).alias("plans"),
        T.any_word(plain, ("考什么", "科目", "408", "专业课")).alias("subjects"),
        T.any_word(plain, ("身份证", "准考证", "考生编号", "手机号", "姓名")).alias("private"),
        T.any_word(plain, ("导出", "下载", "excel", "Excel", "markdown", "报告")).alias("export"),
    )


def plan(asked: dict) -> list[str]:
    """AGT-02: steps in a fixed order; nothing structured asked for means a search of the text."""
    if asked.get("private"):
        return ["refuse"]
    steps = [name for name in ("subjects", "lines", "plans") if asked.get(name)]
    if asked.get("least") or asked.get("is_408") is not None:
        steps = ["search", *steps]
    return [*(steps or ["retrieve"]), *(["export"] if asked.get("export") else [])]


def calls(asked: dict) -> list[tuple[str, dict]]:
    """AGT-01: operators with arguments; several schools or codes are one scope each."""
    scopes = [{"school": s, "code": c} for s in asked.get("schools") or [None] for c in (asked.get("codes") or asked.get("prefixes") or [None])]
    out = []
    for step in plan(asked):
        for scope in scopes if step not in ("export", "refuse") else [{}]:
            extra = {k: asked[k] for k in ("year", "least", "is_408", "mode") if asked.get(k) is not None}
            out.append((step, {k: v for k, v in (scope | extra).items() if v is not None}))
    return out


def strip_unsupported(answer: str, evidence: str) -> tuple[str, list[str]]:
    """AGT-04, STR-18: numbers that the evidence lacks give way to a marker, right to left; years 1990 to 2035 are exempt."""
    canonical = lambda x: (x.rstrip("0").rstrip(".") if "." in x else x).lstrip("0") or "0"
    found = re.compile(r"\d+(?:\.\d+)?")
    given = {canonical(x) for x in found.findall(re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", evidence))}
    wrong = [m for m in found.finditer(answer) if canonical(m[0]) not in given and not ("." not in m[0] and 1990 <= int(m[0]) <= 2035)]
    for m in reversed(wrong):
        answer = answer[: m.start()] + MARKER + answer[m.end() :]
    return answer, [m[0] for m in wrong]


@dataclass
class Agent:
    """AGT-03, AGT-05: plan, act, reflect, finalize. ``tools``: step → operator returning a DataFrame; an exception becomes a text result."""

    tools: dict[str, Callable[..., DataFrame]]
    model: Callable[[str], str] | None = None
    max_calls: int = 10
    rows: int = 50
    log: list[tuple[str, dict, int]] = field(default_factory=list)

    def act(self, step: str, arguments: dict) -> tuple[list[str], list[str]]:
        """What is shown of a step's rows, and what of them counts as evidence: values, but not names of columns or ids."""
        try:
            rows = [r.asDict(True) for r in self.tools[step](**arguments).limit(self.rows).collect()]
        except Exception as e:  # noqa: BLE001 a tool's failure is a result
            self.log.append((step, arguments, 0))
            return [f"{step} failed: {type(e).__name__}"], []
        self.log.append((step, arguments, len(rows)))
        told = lambda row: ", ".join(f"{k}: {v}" for k, v in row.items() if v is not None)
        return [told(r) for r in rows], [str(v) for r in rows for k, v in r.items() if v is not None and k != "id" and not k.endswith("_id")]

    def answer(self, question: str, asked: dict) -> dict:
        """AGT-04: a model's numbers must be among the evidence: it is asked once more if not, then what is left gives way to a mark. What was
        asked for by year or code and has no evidence is said."""
        shown: list[str] = []
        evidence: list[str] = []
        steps = calls(asked)
        for step, arguments in steps[: min(max(self.max_calls, 1), 10)]:
            if step == "refuse":
                return {"answer": "Personal data is not given.", "evidence": [], "removed": [], "asked_again": False}
            if step in self.tools:
                rows, values = self.act(step, arguments)
                shown, evidence = shown + rows, evidence + values
        if not evidence and "retrieve" in self.tools and all(step != "retrieve" for step, _ in steps):
            rows, values = self.act("retrieve", {"query": question})
            shown, evidence = shown + rows, evidence + values
        facts, again = "\n".join(evidence), False
        if not evidence or not self.model:
            text = "\n".join(shown) or "Nothing found."
        else:
            text = self.model("\n".join([question, *shown]))
            if strip_unsupported(text, facts)[1]:
                text, again = self.model("\n".join([question, *shown, "Use no numbers but those above."])), True
        answer, removed = strip_unsupported(text, facts) if self.model and evidence else (text, [])
        wanted = [str(asked["year"])] if asked.get("year") else []
        for missing in [w for w in [*wanted, *(asked.get("codes") or [])] if evidence and w not in facts]:
            answer += f"\nNothing was found for {missing}."
        return {"answer": answer, "evidence": shown, "removed": removed, "asked_again": again}


def no_filter(**arguments):
    """UDF-05: at the tools' boundary 0 and '' mean no filter."""
    return {k: v for k, v in arguments.items() if v not in ("", 0, None)}


def validated(*, year: int | None = None, least: int | None = None, limit: int = 20) -> dict:
    """API-02, API-04: arguments in range, or an error envelope."""
    problems = [p for p, bad in (("year must be from 2000 to 2100", year is not None and not 2000 <= year <= 2100), ("least must not be negative", least is not None and least < 0)) if bad]
    if problems:
        return {"error": {"code": "invalid", "message": "; ".join(problems), "details": {"year": year, "least": least}}}
    return {"year": year, "least": least, "limit": min(max(limit, 1), 100)}


def citations(facts: DataFrame, documents: DataFrame, keys: Sequence[str] = ("source", "evidence")) -> DataFrame:
    """AGT-06: facts as citations: document, URL, the first 160 characters of evidence; each once."""
    docs = documents.select(F.col("id").alias("source"), "title", F.coalesce("page_url", "attachment_url").alias("url"))
    return facts.select("source", F.substring("evidence", 1, 160).alias("evidence")).dropDuplicates(list(keys)).join(docs, "source", "left")
