"""The fact model: column types, allowed values and their checks (SNK-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns that every fact carries beside its own.
PROVENANCE = "id long, definition string, source string, source_page int, method string, verified boolean, evidence string"
TABLES = {
    "schools": "id string, name string",
    "colleges": "id string, school string, code string, name string, slug string",
    "documents": "id string, school string, title string, doc_type string, format string, publish_date string, page_url string, attachment_url string, local_path string, sha256 string, status string, parent string, personal boolean, bytes long, first_seen string, last_seen string",
    "programs": "id string, college string, code string, name string, degree string, mode string",
    "directions": f"program string, name string, advisors string, {PROVENANCE}",
    "exam_subjects": f"program string, year int, slot int, code string, name string, status string, reason string, {PROVENANCE}",
    "plans": f"program string, year int, kind string, value int, is_upper_bound boolean, pool_scope string, {PROVENANCE}",
    "score_lines": f"program string, school string, discipline string, year int, scope string, total int, s1 int, s2 int, s3 int, s4 int, {PROVENANCE}",
    "admission_stats": f"program string, year int, kind string, count int, min_score int, max_score int, {PROVENANCE}",
    "crawl_runs": "id string, school string, started string, ended string, status string, stats string",
}
ALLOWED = {
    ("documents", "status"): ("active", "seed_only", "removed", "blocked"),
    ("exam_subjects", "status"): ("known", "unknown", "no_exam"),
    ("score_lines", "scope"): ("college", "baseline", "special"),
}
KEYS = {"schools": ("id",), "colleges": ("id",), "documents": ("id",), "programs": ("id",), "crawl_runs": ("id",)}


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the model: missing columns are NULL, types are cast, others are dropped."""
    columns = [c.strip().rsplit(" ", 1) for c in TABLES[name].split(",")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns])


#: What a type may become without loss.
WIDER = {"tinyint": ("smallint", "int", "bigint"), "smallint": ("int", "bigint"), "int": ("bigint", "double"), "float": ("double",), "date": ("timestamp",)}


def difference(stored: StructType | None, declared: str) -> dict[str, list]:
    """SNK-05: how a stored schema differs from a declared one (DDL): names added, widened (name, from, to) and kept though not declared. A type that would
    lose something is an error."""
    wanted = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(declared)}
    there = {f.name: f.dataType.simpleString() for f in stored or ()}
    changed = [(c, there[c], t) for c, t in wanted.items() if c in there and there[c] != t]
    if lost := [x for x in changed if x[2] not in WIDER.get(x[1], ())]:
        raise TypeError(f"types cannot change so: {lost}")
    return {"added": [c for c in wanted if c not in there], "widened": changed, "kept": [c for c in there if c not in wanted]}


def evolved(df: DataFrame, declared: str, defaults: dict | None = None) -> DataFrame:
    """``df`` with the declared columns first: missing ones have their default, narrower types are cast; other columns stay."""
    changes = difference(df.schema, declared)
    fields = StructType.fromDDL(declared)
    own = [(F.col(f"`{f.name}`") if f.name not in changes["added"] else F.lit((defaults or {}).get(f.name))).cast(f.dataType).alias(f.name) for f in fields]
    return df.select(*own, *[f"`{c}`" for c in changes["kept"]])


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows that break a rule of the table, with the rule; duplicates of a key once for each key."""
    rules: list[tuple[str, Column]] = [(f"{c} not allowed", ~F.col(c).isin(*values)) for (t, c), values in ALLOWED.items() if t == name]
    found = [df.where(rule).select(F.lit(text).alias("rule"), F.to_json(F.struct("*")).alias("row")) for text, rule in rules]
    for key in [KEYS[name]] if name in KEYS else []:
        twice = df.groupBy(*key).count().where("count > 1").drop("count")
        found.append(twice.select(F.lit("key repeated").alias("rule"), F.to_json(F.struct("*")).alias("row")))
        found.append(df.where(" OR ".join(f"{k} IS NULL" for k in key)).select(F.lit("key missing").alias("rule"), F.to_json(F.struct("*")).alias("row")))
    out = found[0] if found else df.limit(0).select(F.lit("").alias("rule"), F.lit("").alias("row"))
    for more in found[1:]:
        out = out.unionByName(more)
    return out
