"""Tables as blocks of text for retrieval (DOC-02, ARR-06): each repeats the caption, the header, and the college and program that its rows belong to.

What a row stands under is a running value over the table (``scans``), so tables are not read in one task for it. A college opens a block, so
its rows (a section) are packed on their own, by a fold over the section's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import laid_out, running

# Cells that are no label, and rows that name a college or a program; rows that are looked through for a header, and its most rows.
NUMERIC_CELL = r"^[\d\s.,%()（）≤<=＜~～\-–—/:：]+$"
LEADING_CODE = r"^\d{3}"
COLLEGE_ROW = r"^\d{3}(?!\d)"
PROGRAM_ROW = r"^(?:\d{6}|\d{4}[A-Z]\d)"
SCANNED, MOST = 8, 3
TABLE = ["doc", "table"]


def is_labels(values: Column) -> Column:
    """A row of two labels or more, and of nothing else."""
    return (F.size(F.array_distinct(values)) > 1) & ~F.exists(values, lambda v: v.rlike(NUMERIC_CELL) | v.rlike(LEADING_CODE))


def headers(rows: DataFrame) -> DataFrame:
    """ARR-06: for each table (doc, table) with one, the ``header``: lines of its first row of labels among the first eight rows and of those right
    behind it, three at most; ``from`` and ``until`` are its rows."""
    first = rows.where(F.col("row") < SCANNED + MOST - 1).select(*TABLE, F.struct("row", is_labels(F.col("values")).alias("label"), F.array_join("values", " | ").alias("line")).alias("r"))
    tops = first.groupBy(*TABLE).agg(F.array_sort(F.collect_list("r")).alias("top"))
    start = F.array_position(F.slice(F.col("top.label"), 1, SCANNED), True).cast("int")
    found = tops.withColumn("start", start).where("start > 0").withColumn("span", F.slice("top", F.col("start"), F.lit(MOST)))
    stop = F.array_position(F.col("span.label"), False).cast("int")
    found = found.withColumn("span", F.slice("span", F.lit(1), F.when(stop == 0, F.size("span")).otherwise(stop - 1)))
    return found.select(*TABLE, F.col("span.line").alias("header"), F.col("span")[0]["row"].alias("from"), F.element_at("span", -1)["row"].alias("until"))


def _fold(lines: Column, prefix: Column, size: int) -> Column:
    """A section's blocks: lines are added while they fit; a program opens a block if half of the room is used."""
    prefix_size = F.length(F.array_join(prefix, "\n"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("body"), F.lit(0).alias("n"))
    whole = lambda body: F.array(F.array_join(F.concat(prefix, body), "\n"))

    def add(state: Column, x: Column) -> Column:
        n = F.length(x["line"])
        full = (state["n"] > 0) & ((x["opens"] & (state["n"] + n > size // 2)) | (prefix_size + state["n"] + n + 1 > size))
        context = F.filter(F.array(x["college"], x["program"]), lambda c: (c != "") & (c != x["line"]))
        empty = full | (state["n"] == 0)
        body = F.when(empty, context).otherwise(state["body"])
        used = F.when(empty, F.aggregate(context, F.lit(0), lambda total, c: total + F.length(c) + 1)).otherwise(state["n"])
        done = F.when(full, F.concat(state["done"], whole(state["body"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.concat(body, F.array(x["line"])).alias("body"), (used + n + 1).alias("n"))

    return F.aggregate(lines, start, add, lambda state: F.concat(state["done"], whole(state["body"])))


def table_blocks(rows: DataFrame, size: int) -> DataFrame:
    """DOC-02: rows of tables (doc, table, row, width, caption, values: cells with merges across as one and without blanks) as blocks of about ``size``
    characters: doc, table, section, number, text. A longer row is a block with what it stands under."""
    told = rows.where(F.size("values") > 0).join(headers(rows), TABLE, "left")
    line = F.array_join("values", " | ")
    header = F.coalesce("header", F.array().cast("array<string>"))
    told = told.where(~F.coalesce(F.col("row").between(F.col("from"), F.col("until")), F.lit(False)) & ~F.array_contains(header, line))
    group = F.size(F.array_distinct("values")) <= F.greatest(F.lit(2), F.floor(F.col("width") / 2))
    first = F.get("values", F.lit(0))
    college = group & first.rlike(COLLEGE_ROW)
    program = group & ~college & first.rlike(PROGRAM_ROW)
    prefix = F.filter(F.concat(F.array(F.coalesce("caption", F.lit(""))), header), lambda x: x != "")
    told = told.select(
        *TABLE, "row", line.alias("line"), program.alias("opens"), prefix.alias("prefix"), college.cast("int").alias("_college"), F.when(college, line).alias("_c"), F.when(program, line).when(college, "").alias("_p"),
    )
    under = running(laid_out(told, TABLE, ["row"]), TABLE, {"section": ("sum", "_college"), "college": ("last", "_c"), "program": ("last", "_p")})
    entry = F.struct("row", "line", "opens", F.coalesce("college", F.lit("")).alias("college"), F.coalesce("program", F.lit("")).alias("program"))
    sections = under.groupBy(*TABLE, "section").agg(F.array_sort(F.collect_list(entry)).alias("lines"), F.first("prefix").alias("prefix"))
    return sections.select(*TABLE, "section", F.posexplode(_fold(F.col("lines"), F.col("prefix"), size)).alias("number", "text"))
