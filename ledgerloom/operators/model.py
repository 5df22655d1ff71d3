"""Models as callables over tables: embeddings in batches, extraction with grounding, caches, gold rows (UDF-06, UDF-07, SNK-12, EVL-03)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import written

# The kinds that a model may name for each table.
KINDS = {
    "plans": ("catalog_total", "rules_total", "tm", "public_exam", "college_exam_plan", "available_exam", "special_veteran", "special_minority"),
    "score_lines": ("college", "school_baseline", "special_veteran", "special_minority"),
    "admission_stats": ("admit_count", "retest_count", "score_min", "score_max"),
}
ITEM = "array<struct<table:string,kind:string,code:string,value:int,evidence:string,dropped:string>>"
#: Characters of a document that a model is given.
DOCUMENT = 12_000


def embed(rows: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """UDF-06: ``rows`` with ``embedding``: the model sees each distinct text of a task's batch once, ``batch`` at a time; null and blank texts have none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            wanted = list(dict.fromkeys(t for t in texts if t and t.strip()))
            found: dict[str, list[float]] = {}
            for i in range(0, len(wanted), batch):
                part = wanted[i : i + batch]
                found.update(zip(part, model(part), strict=True))
            yield texts.map(lambda t, found=found: found.get(t))

    return rows.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))


def parse_items(answer: str | None) -> list[dict]:
    """JSN-01: the objects of the first list in an answer that JSON can read; none of anything else."""
    text = answer or ""
    for start in (m.start() for m in re.finditer(r"\[", text)):
        try:
            found, _ = json.JSONDecoder().raw_decode(text[start:])
        except ValueError:
            continue
        if isinstance(found, list) and (not found or any(isinstance(x, dict) for x in found)):
            return [x for x in found if isinstance(x, dict)]
    return []


def judged(item: dict, text: str) -> dict:
    """An item with why it does not count: an unknown kind, evidence that the text lacks, that looks like a person's number or lacks the value, a bad code."""
    squash = lambda x: re.sub(r"\s+", "", x)
    evidence, code = str(item.get("evidence") or "").strip(), str(item.get("program_code") or "").strip()
    table, kind = str(item.get("table")), str(item.get("kind"))
    value = item.get("total" if table == "score_lines" else "value")
    given = "" if value is None else str(value).strip()
    reason = None
    if kind not in KINDS.get(table, ()):
        reason = "unknown kind"
    elif not evidence or squash(evidence) not in squash(text):
        reason = "evidence not in document"
    elif re.search(r"(?<!\d)(?:\d{15}|\d{17}[\dXx])(?!\d)", evidence):
        reason = "evidence looks like personal data"
    elif not re.fullmatch(r"\d{1,9}", given):
        reason = "no value"
    elif given not in re.findall(r"\d+", evidence):
        reason = "value not in evidence"
    elif code and not re.fullmatch(r"\d{4}[0-9A-Z]{2}", code):
        reason = "bad code"
    elif not code and kind != "school_baseline":
        reason = "no program"
    return {"table": table, "kind": kind, "code": code or None, "value": int(given) if re.fullmatch(r"\d{1,9}", given) else None, "evidence": evidence, "dropped": reason}


def model_facts(docs: DataFrame, model: Callable[[str], str], text: str = "text") -> DataFrame:
    """UDF-07, EXT-15: what a model finds in each document (the other columns are kept), and why an item is dropped. The model sees the first DOCUMENT characters; evidence is
    looked for in the whole text. A model that fails on a document gives one dropped row."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for own in texts:
            if not own or not own.strip():
                out.append([])
                continue
            try:
                out.append([judged(x, own) for x in parse_items(model(own[:DOCUMENT]))])
            except Exception as e:  # noqa: BLE001 a document's failure is a result
                out.append([{"table": None, "kind": None, "code": None, "value": None, "evidence": None, "dropped": f"model failed: {type(e).__name__}"}])
        return pd.Series(out)

    return docs.select(*[c for c in docs.columns if c != text], F.inline(F.pandas_udf(run, ITEM)(F.col(text))))


def cache_misses(requests: DataFrame, cache: DataFrame, keys: Sequence[str] = ("backend", "sha256")) -> DataFrame:
    """SNK-12: each distinct request that the cache does not hold."""
    return requests.dropDuplicates(list(keys)).join(cache.select(*keys), list(keys), "left_anti")


ANSWERS = "backend string, sha256 string, answer string"


def cached_answers(requests: DataFrame, table, backend: str, model: Callable[[str], str], content: str = "content") -> DataFrame:
    """SNK-12: ``requests`` with ``sha256`` and ``answer``: each distinct content is asked for once for each backend, ever: answers go to ``table`` (a versioned table of
    ANSWERS), and those there are not asked for again. Where the model fails the answer is NULL, and the next run asks again."""

    @F.pandas_udf("string")
    def answer(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                return model(text)
            except Exception:  # noqa: BLE001 a request's failure is a result
                return None

        return texts.map(one)

    own = requests.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    asked = own.where(F.col(content).isNotNull()).select(F.lit(backend).alias("backend"), "sha256", F.col(content).alias("_content"))
    fresh = cache_misses(asked, table.read(ANSWERS)).select("backend", "sha256", answer("_content").alias("answer"))
    fresh = written(fresh, "answers").where("answer IS NOT NULL")  # a write that is tried again asks nothing again
    if not fresh.isEmpty():
        table.insert_new(fresh, ["backend", "sha256"])
    return own.join(table.read(ANSWERS).where(F.col("backend") == backend).select("sha256", "answer"), "sha256", "left").select(*own.columns, "answer")


def gold_rows(templates: DataFrame, subjects: DataFrame, reviews: DataFrame) -> DataFrame:
    """EVL-03: a question for each template (template, text with {name}, operation, split) and subject of its group (group, id, name, value); a review (id) of
    its id replaces the text or, as ``drop``, removes it."""
    made = templates.join(subjects, "group").select(F.concat_ws("-", "template", F.col("id").cast("string")).alias("id"), F.replace("text", F.lit("{name}"), F.col("name")).alias("question"), "operation", "split", "value")
    reviewed = made.join(reviews.select("id", F.col("text").alias("_text"), F.col("verdict").alias("_verdict")), "id", "left")
    kept = reviewed.where(F.coalesce(F.col("_verdict") != "drop", F.lit(True)))
    return kept.select("id", F.coalesce("_text", "question").alias("question"), "operation", "split", "value", F.col("_verdict").isNotNull().alias("reviewed"))
