"""What runs on over page and table breaks: catalogues (EXT-10), tables that go on without a header (EXT-03, EXT-05), lists of names (EXT-19).

A document may be longer than a task: what a row takes over from rows above it (its college, its program, its header) is a running value in
the sense of ``scans``, worked out per partition and carried over partitions. No rule looks at a whole document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean, compact, leading_int, split_subjects

from .scans import laid_out, running

# Rows of a catalogue, the words that end a row's exam subjects and that rule an exam out, the first cell of a header, study modes.
COLLEGE = r"^(\d{3})\s+(\S.*)$"
PROGRAM = r"^(\d{4}[0-9A-Z]{2})\s+(\S.*)$"
DIRECTION = r"^([0-9A-Z]{2})\s+(.+?)\s*[（(](全日制|非全日制)[）)]\s*$"
EXAM_ENDS, NO_EXAM, HEADER, FIRST_SUBJECT = "复试专业课", "仅招收推免生", "学科代码", "①"


def exam_part(text: Column) -> Column:
    return clean(F.substring_index(text, EXAM_ENDS, 1))


def catalogue_rows(rows: DataFrame) -> DataFrame:
    """Rows of a catalogue, (doc, table, row, page, values, last: the row's last cell), with what they say and what they stand under: ``college``, and
    ``block``, the place of their program's row (-1 behind a college's row)."""
    first = F.get("values", F.lit(0))
    subjects = F.coalesce(F.try_element_at(F.filter(F.slice("values", 2, 1 << 20), lambda v: v.contains(FIRST_SUBJECT)), F.lit(1)), F.lit(""))
    told = rows.where(F.size("values") > 0).where(~first.startswith(HEADER)).withColumns({"_first": first, "_subjects": subjects})
    is_program = F.col("_first").rlike(PROGRAM) & ~F.col("_first").rlike(DIRECTION)
    is_college = F.col("_first").rlike(COLLEGE) & (F.col("_subjects") == "")
    told = told.withColumn("kind", F.when(is_program, "program").when(is_college, "college").when(F.col("_first").rlike(DIRECTION), "direction")).where("kind IS NOT NULL")
    laid = laid_out(told, ["doc"], ["table", "row"])
    laid = laid.withColumns({"_college": F.when(F.col("kind") == "college", F.regexp_extract("_first", COLLEGE, 1)), "_block": F.when(F.col("kind") == "program", F.col("place")).when(F.col("kind") == "college", F.lit(-1))})
    return running(laid, ["doc"], {"college": ("last", "_college"), "block": ("last", "_block")})


def catalogue_facts(rows: DataFrame) -> DataFrame:
    """EXT-10: a catalogue's facts, (doc, kind, college, code, mode, value, detail, evidence, page): each program's total, its subjects (its own,
    else those of its first direction with any) or that there is no exam, and its directions. Programs before any college are left out."""
    under = catalogue_rows(rows).where("college IS NOT NULL AND block >= 0 AND kind <> 'college'")
    own = F.col("kind") == "program"
    second = F.when(~F.get("values", F.lit(1)).contains(FIRST_SUBJECT), F.get("values", F.lit(1)))
    count = leading_int(F.when(F.size("values") > 1, second))
    last = clean(F.coalesce("last", F.lit("")))
    note = F.when(~last.contains(FIRST_SUBJECT) & ~last.rlike(PROGRAM), last)
    row = F.struct(
        F.regexp_extract("_first", PROGRAM, 1).alias("code"), count.alias("value"), F.array_join("values", " | ").alias("evidence"), "page", exam_part(F.col("_subjects")).alias("subjects"),
        F.coalesce(note, F.lit("")).contains(NO_EXAM).alias("no_exam"),
    )
    of = lambda group: F.regexp_extract("_first", DIRECTION, group)
    direction = F.struct("place", of(1).alias("code"), of(2).alias("name"), of(3).alias("mode"), exam_part(F.col("_subjects")).alias("subjects"), F.col("_first").alias("raw"), "page")
    # A program's directions are few; what is put together here is one program.
    blocks = under.groupBy("doc", "block").agg(
        F.max(F.when(own, F.col("college"))).alias("college"), F.max_by(row, F.when(own, F.col("place"))).alias("p"),
        F.array_sort(F.collect_list(F.when(~own, direction))).alias("directions"),
    )
    modes = F.array_distinct(F.col("directions.mode"))
    told = F.filter("directions", lambda d: d["subjects"] != "")
    text = F.when(F.col("p.subjects") != "", F.col("p.subjects")).otherwise(F.coalesce(F.try_element_at(told, F.lit(1))["subjects"], F.lit("")))
    listed = F.array_join(F.transform(split_subjects(text), lambda s: F.concat_ws(" ", s["code"], s["name"])), "/")
    mode = F.when(F.size(modes) == 1, F.get(modes, F.lit(0)))
    fact = lambda kind, when, mode, value, detail, evidence, page: F.when(when, F.struct(F.lit(kind).alias("kind"), mode.alias("mode"), value.cast("int").alias("value"), detail.alias("detail"), evidence.alias("evidence"), page.alias("page")))
    none, page = F.lit(None).cast("string"), F.col("p.page")
    single = F.array(
        fact("catalog_total", F.lit(True), mode, F.col("p.value"), none, F.col("p.evidence"), page), fact("no_exam", F.col("p.no_exam"), mode, F.lit(None), none, F.col("p.evidence"), page),
        fact("subjects", ~F.col("p.no_exam") & (listed != ""), mode, F.lit(None), listed, text, page),
    )
    each = F.transform("directions", lambda d: fact("direction", F.lit(True), d["mode"], F.lit(None), F.concat_ws(" ", d["code"], d["name"]), d["raw"], d["page"]))
    facts = blocks.select("doc", "college", F.col("p.code").alias("code"), F.explode(F.filter(F.concat(single, each), lambda f: f.isNotNull())).alias("f"))
    return facts.select("doc", "f.kind", "college", "code", "f.mode", "f.value", "f.detail", "f.evidence", "f.page")


def column_kinds(cells: Column) -> Column:
    """A row's layout as one word: for each cell a code (c), a count (n), text (t) or nothing (-)."""
    own = F.transform(cells, lambda x: compact(clean(F.coalesce(x, F.lit("")))))
    return F.array_join(F.transform(own, lambda x: F.when(x == "", "-").when(x.rlike(r"^\d{4}[0-9A-Z]{2}$"), "c").when(x.rlike(r"^(?:≤|<=|＜=)?\d+(?:[（(]\d+[)）])?$"), "n").otherwise("t")), "")


def with_headers(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """EXT-03, WIN-10: rows of tables (doc, table, row, cells) with the ``header`` (array) that they stand under: the last row above, in the document and of
    this width, that holds one of ``names``. A table of a width that no header had gets one from its kinds of columns: the header, last
    above in the document, whose own first row had the same kinds. Header rows themselves are left out."""
    is_header = F.exists("cells", lambda x: F.coalesce(compact(clean(x)).isin(*names), F.lit(False)))
    told = rows.withColumns({"_width": F.size("cells"), "_is": is_header, "_kinds": column_kinds(F.col("cells"))})
    laid = laid_out(told, ["doc", "_width"], ["table", "row"]).withColumn("_header", F.when(F.col("_is"), F.col("cells")))
    under = running(laid, ["doc", "_width"], {"header": ("last", "_header")}).drop("part", "place").where("NOT _is")
    kept, bare = under.where("header IS NOT NULL").drop("_header"), under.where("header IS NULL").drop("_header", "header")
    # A header's kinds, without what is blank, are those of the row below it.
    shape = lambda c: F.regexp_replace(c, "-", "")
    known = kept.groupBy("doc", shape(F.col("_kinds")).alias("_shape"), "header").agg(F.max(F.struct("table", "row")).alias("_at"))
    newest = known.groupBy("doc", "_shape").agg(F.max_by("header", "_at").alias("header"))
    guessed = bare.withColumn("_shape", shape(F.col("_kinds"))).join(newest, ["doc", "_shape"], "left").drop("_shape")
    columns = [*rows.columns, "header"]
    return kept.select(columns).unionByName(guessed.select(columns))


def filled_down(rows: DataFrame, columns: Sequence[str], key: Sequence[str] = ("doc", "table"), order: Sequence[str] = ("row",)) -> DataFrame:
    """EXT-05, WIN-04: a blank cell of a merged column has the value above it."""
    marked = rows.withColumns({f"_{c}": F.when(clean(F.coalesce(c, F.lit(""))) != "", F.col(c)) for c in columns})
    ran = running(laid_out(marked, list(key), list(order)), list(key), {f"_full_{c}": ("last", f"_{c}") for c in columns})
    return ran.select(*[F.coalesce(f"_full_{c}", F.lit("")).alias(c) if c in columns else F.col(c) for c in rows.columns])


def roster_counts(lines: DataFrame, code: str = r"(?<![0-9A-Z])(\d{4}[0-9A-Z]{2})(?![0-9A-Z])") -> DataFrame:
    """EXT-19: of a list's lines (doc, page, line, text), how many name exactly one program, by program. Where a page's last line and the next page's
    first hold a code together that neither holds alone, they are one line. Nothing but counts leaves."""
    codes = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(code), 1))
    told = lines.select("doc", "page", "line", F.coalesce("text", F.lit("")).alias("text"))
    ends = told.groupBy("doc", "page").agg(F.max_by("text", "line").alias("last"), F.min_by("text", "line").alias("first"))
    pairs = ends.select("doc", (F.col("page") + 1).alias("page"), "last").join(ends.select("doc", "page", "first"), ["doc", "page"])
    cut = pairs.withColumn("whole", codes(F.concat("last", "first"))).where(F.size("whole") > F.size(codes(F.col("last"))) + F.size(codes(F.col("first"))))
    counted = told.select("doc", codes(F.col("text")).alias("codes"), F.lit(1).alias("n")).unionByName(
        cut.select("doc", F.explode(F.array(F.struct(F.col("whole").alias("codes"), F.lit(1).alias("n")), *[F.struct(codes(F.col(c)).alias("codes"), F.lit(-1).alias("n")) for c in ("last", "first")])).alias("e")).select("doc", "e.codes", "e.n")
    )
    people = counted.where(F.size("codes") == 1).groupBy("doc", F.get("codes", F.lit(0)).alias("code")).agg(F.sum("n").alias("people"))
    return people.where("people > 0")
