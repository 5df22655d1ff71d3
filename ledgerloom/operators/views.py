"""Rows for readers: slim projections, hits, presentation rows, facts in tool output, pages with their tables (FLT-09, RET-06, VIEW-01, JSN-02, ARR-05)."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import written

# For each list of a program's facts the table, the name of the kind, and the fields that are values (a slot's code is one fact for
# each subject of an entry); of these lists those whose facts stay without a value; the word for what is missing.
LINE_FIELDS = ("total", "politics", "foreign_lang", "subject1", "subject2")
FACT_LISTS = {
    "lines": ("score_lines", "scope", LINE_FIELDS),
    "score_lines": ("score_lines", "scope", LINE_FIELDS),
    "plans": ("plans", "kind", ("value",)),
    "admission_stats": ("admission_stats", "kind", ("value",)),
    "exam_subjects": ("exam_subjects", "slot", ("code",)),
    "directions": ("directions", "code", ("advisors",)),
}
VALUELESS = ("plans", "admission_stats", "exam_subjects")
MISSING = "未找到"


def slim_json(columns: Sequence[str], limit: int = 12_000) -> Column:
    """FLT-09, RET-06: a row as JSON without its nulls, cut after ``limit`` characters with a mark."""
    text = F.to_json(F.struct(*columns))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("…[截断]")))


def hit_rows(hits: DataFrame, chunks: DataFrame, metadata: Sequence[str], text: int = 200) -> DataFrame:
    """RET-06: hits (chunk_id, score, backend) with the beginning of their text and what of the metadata they have."""
    joined = hits.join(chunks.select("chunk_id", "piece", *metadata), "chunk_id")
    return joined.select("chunk_id", "score", "backend", F.substring("piece", 1, text).alias("text"), F.to_json(F.struct(*metadata)).alias("metadata"))


def json_leaves(text: str | None) -> list[tuple[list[str], str | None]]:
    """Path and text of every value that is no object or list; what is no JSON has none."""
    try:
        todo: list[tuple[tuple[str, ...], Any]] = [((), json.loads(text or ""))]
    except ValueError:
        return []
    out = []
    while todo:
        path, value = todo.pop()
        if isinstance(value, (dict, list)):
            todo += [((*path, str(k)), v) for k, v in (value.items() if isinstance(value, dict) else enumerate(value))]
        else:
            out.append((list(path), None if value is None else str(value)))
    return out


def tool_facts(outputs: DataFrame, output: str) -> DataFrame:
    """JSN-02: one row for each fact in each output, with the other columns. A fact is an entry of one of ``FACT_LISTS`` in an object with a
    ``program_id``, wherever that lies: leaves are told apart by their path, put together by entry, and meet their program by the
    object's path. A year that is no number is NULL."""
    leaf = F.pandas_udf(lambda texts: texts.map(json_leaves), "array<struct<path:array<string>,value:string>>")
    others = [c for c in outputs.columns if c != output]
    told = outputs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_other"), F.col(output).alias("_text"), F.monotonically_increasing_id().alias("_id"))
    told = written(told, "outputs")  # ids must be the same for programs and entries
    leaves = told.select("_id", "_other", F.explode(leaf("_text")).alias("l")).select("_id", "_other", "l.*").withColumn("n", F.size("path"))
    at = lambda i: F.element_at("path", i)
    programs = leaves.where(F.get("path", F.col("n") - 1) == "program_id").select("_id", F.slice("path", 1, F.col("n") - 1).alias("object"), F.col("value").alias("program_id"))
    # A leaf below several lists belongs to an entry of each of them.
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.col("n") - 2, F.lit(1))), lambda i: (i <= F.col("n") - 2) & at(i).isin(*FACT_LISTS) & F.get("path", i).rlike(r"^\d+$"))
    inner = leaves.select("*", F.explode(places).alias("i"))
    inner = inner.select("_id", "_other", F.slice("path", 1, F.col("i") - 1).alias("object"), at(F.col("i")).alias("list"), F.get("path", F.col("i")).alias("entry"), F.array_join(F.slice("path", F.col("i") + 2, F.col("n")), "/").alias("field"), "value")
    entries = inner.groupBy("_id", "object", "list", "entry").agg(F.first("_other").alias("_other"), F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("own"))
    has = lambda name: F.try_element_at("own", F.lit(name) if isinstance(name, str) else name)
    rule = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in FACT_LISTS.items() for x in (k, v[i])]), F.col("list"))
    fact = lambda kind, field, value: F.struct(kind.alias("kind"), F.lit(field).alias("field"), value.alias("value"))
    plain = {name: F.array(*[fact(has(kind), f if f in LINE_FIELDS else "total", has(f)) for f in fields]) for name, (_, kind, fields) in FACT_LISTS.items() if name != "exam_subjects"}
    numbers = F.array_distinct(F.filter(F.transform(F.map_keys("own"), lambda k: F.regexp_extract(k, r"^subjects/(\d+)/", 1)), lambda x: x != ""))
    subjects = F.transform(numbers, lambda i: fact(F.concat(F.lit("slot"), F.coalesce(has(F.concat(F.lit("subjects/"), i, F.lit("/slot"))), F.lit("None"))), "total", has(F.concat(F.lit("subjects/"), i, F.lit("/code")))))
    found = subjects
    for name, facts in plain.items():
        found = F.when(F.col("list") == name, facts).otherwise(found)
    facts = entries.join(programs, ["_id", "object"]).select("_other", "program_id", rule(0).alias("table"), "own", F.explode(found).alias("f"))
    kept = (F.col("f.value").isNotNull() | F.col("table").isin(*VALUELESS)) & ~((F.col("table") == "directions") & F.coalesce(F.col("f.value") == "", F.lit(False)))
    return facts.where(kept).select("_other.*", "table", "program_id", "f.kind", F.expr("try_cast(try_element_at(own, 'year') AS int)").alias("year"), "f.field", "f.value", has("source/doc_id").alias("source"))


def presentation_rows(programs: DataFrame, subjects: DataFrame, lines: DataFrame, plans: DataFrame, catalog: str) -> DataFrame:
    """VIEW-01: one row a program for a reader: its latest subjects, main line (a special one only where there is no other) and catalogue plan, with
    words where one is missing."""
    entry = subjects.groupBy("program").agg(F.max_by(F.struct("status", "codes", "is_special", "year"), F.struct("year", -F.col("number"))).alias("s"))
    main = F.col("scope").isin("college", "baseline", "program")
    line = lines.groupBy("program").agg(F.max_by(F.struct("total", "scope", "year"), F.struct(main, "year", -F.col("total"))).alias("l"))
    plan = plans.where(F.col("kind") == catalog).groupBy("program").agg(F.max_by(F.struct("value", "year", "pool"), F.struct("year", -F.col("id"))).alias("p"))
    rows = programs.join(entry, "program", "left").join(line, "program", "left").join(plan, "program", "left")
    known = F.concat(F.col("s.codes"), F.lit("（"), F.col("s.year").cast("string"), F.lit("）"))
    return rows.select(
        "program",
        F.col("school"),
        F.concat_ws(" ", "college_id", "college_name").alias("college"),
        F.concat_ws(" ", "code", "name").alias("title"),
        F.when(F.col("s").isNull(), MISSING).when(F.col("s.status") == "no_exam", "不考统考").when(F.col("s.status") == "unknown", "未知").otherwise(known).alias("subjects"),
        F.when(F.col("s").isNull() | (F.col("s.status") == "unknown"), "未知").when((F.col("s.status") != "no_exam") & F.col("s.is_special"), "是").otherwise("否").alias("special"),
        F.when(F.col("l").isNotNull(), F.concat_ws(" ", F.col("l.total").cast("string"), F.col("l.year").cast("string"), F.col("l.scope"))).otherwise(MISSING).alias("line"),
        F.when(F.col("p").isNotNull(), F.concat(F.col("p.value").cast("string"), F.lit("（"), F.col("p.year").cast("string"), F.when(F.col("p.pool").isNotNull(), F.concat(F.lit("，"), F.col("p.pool").cast("string"), F.lit(" 合计"))).otherwise(""), F.lit("）"))).otherwise(MISSING).alias("plan"),
    )


_MARKER = re.compile(r"\[\[TABLE:(\d+)\]\]")


def render_page(prose: str, tables: dict[int, str]) -> str:
    """ARR-05: a page's lines without blank ones: prose with its tables where their markers ``[[TABLE:n]]`` stand, then the tables that have none."""
    pieces = _MARKER.split(prose)  # text and numbers in turn
    shown = [int(n) for n in pieces[1::2]]
    parts = [x for text, n in zip(pieces[::2], [*shown, None], strict=True) for x in (text, tables.get(n, ""))]
    rest = [text for n, text in tables.items() if n not in shown]
    return "\n".join(filter(None, map(str.strip, "\n".join(parts + rest).splitlines())))
