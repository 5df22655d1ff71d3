"""Queries on facts: catalogue, merging, estimates, search, resolution, reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import facts as ops
from ledgerloom.operators import resolve
from ledgerloom.session import table

from . import base
from .base import with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


P, PR, S, G, E, B, L, D = base.SQL_PLANS, base.SQL_PROGRAMS, base.SQL_SUBJECTS, base.SQL_GROUPS, base.SQL_ESTIMATES, base.SQL_BASIS, base.SQL_LINES, base.SQL_DOCUMENTS


@query(with_(PR) + """SELECT program, code, name, college_name, school FROM programs p
WHERE school = 'ASIA' AND (name LIKE '%77%' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = program AND o_orderpriority LIKE '%URG%' AND o_orderstatus = 'F'))""")
def program_catalog(spark, sf):
    directions = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("program"), F.concat("o_orderpriority", F.lit("")).alias("direction"))
    named = ops.find_programs(base.programs(spark, sf), school="ASIA")
    has = directions.where(F.col("direction").contains("URG")).select("program").distinct().withColumn("has", F.lit(True))
    found = named.join(has, "program", "left").where(F.col("name").contains("77") | F.col("has"))
    return found.select("program", "code", "name", "college_name", "school")


@query(with_(PR) + "SELECT program, code FROM programs WHERE code LIKE '0812%' OR code LIKE '0007%'")
def program_code_prefix(spark, sf):
    p = base.programs(spark, sf)
    return ops.find_programs(p, code="0812").unionByName(ops.find_programs(p, code=" 00 07")).select("program", "code")


@query(with_(PR) + """SELECT program, college_name FROM programs WHERE college_name = 'NATION_1' OR college_id = 'NATION_1' OR strpos(college_name, 'NATION_1') > 0 OR strpos('NATION_1', college_name) > 0""")
def fuzzy_group_match(spark, sf):
    p = base.programs(spark, sf)
    return p.where(ops.college_matches("NATION_1", ids=("college_id",))).select("program", "college_name")


@query(with_(P) + "SELECT id, program, year, kind, value FROM (SELECT *, rank() OVER (PARTITION BY program, kind ORDER BY year DESC) AS r FROM plans) WHERE r = 1")
def latest_plan_per_kind(spark, sf):
    return ops.latest(base.plans(spark, sf), "program", "kind").select("id", "program", "year", "kind", "value")


@query(with_(P) + """, now AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY program, kind ORDER BY year DESC) AS r FROM plans) WHERE r = 1),
items AS (SELECT program, kind, CASE WHEN is_upper_bound THEN '≤' ELSE '' END || CAST(value AS VARCHAR) || '@' || CAST(source AS VARCHAR) AS item, min(id) AS first FROM now GROUP BY ALL),
lists AS (SELECT program, kind, string_agg(item, '; ' ORDER BY first) AS items FROM items GROUP BY ALL)
SELECT program, """ + ", ".join(f"max(CASE WHEN kind = '{k}' THEN items END) AS {n}" for k, n in zip(base.KINDS, base.NAMES, strict=True)) + " FROM lists GROUP BY program")
def program_facts_view(spark, sf):
    return ops.facts_view(base.plans(spark, sf), base.KINDS, base.NAMES)


@query(with_(P) + """SELECT program, year, kind, arg_min(id, (method, id)) AS id, arg_min(value, (method, id)) AS value, bool_or(verified) AS verified,
  string_agg(DISTINCT CAST(method AS VARCHAR), ',' ORDER BY CAST(method AS VARCHAR)) AS methods, arg_min(evidence, (method, id)) FILTER (WHERE evidence <> '') AS evidence
FROM plans GROUP BY program, year, kind""")
def merge_facts(spark, sf):
    return ops.merge_facts(base.plans(spark, sf).withColumn("rank", F.col("method")), ("program", "year", "kind"), ("value",))


@query(with_(P, E) + "SELECT * FROM estimates")
def public_plan_estimates(spark, sf):
    return ops.estimates(base.plans(spark, sf), explicit=["1-URGENT"], catalog="2-HIGH", quota="3-MEDIUM")


@query(with_(P, E, B) + "SELECT * FROM basis")
def public_plan_basis(spark, sf):
    return ops.basis(public_plan_estimates(spark, sf))


@query(with_(P) + """SELECT program, string_agg(DISTINCT t, '; ' ORDER BY t) AS reasons FROM (
  SELECT program, kind || ' is pooled in ' || CAST(pool AS VARCHAR) AS t FROM plans WHERE pool IS NOT NULL AND kind = '1-URGENT') GROUP BY program""")
def pooled_reasons(spark, sf):
    return ops.pooled_reasons(base.plans(spark, sf), ["1-URGENT"])


@query(with_(P, PR, S, G, E, B) + """, limits AS (
  SELECT program, CASE WHEN bool_or(value >= 200000) THEN 'match' WHEN bool_or(bound <> 'lower') THEN 'excluded' ELSE 'unknown' END AS t FROM basis GROUP BY program),
judged AS (
  SELECT p.program, g.status, g.is_special, t,
         coalesce(g.status = 'no_exam' OR (g.status <> 'unknown' AND NOT g.is_special), false) AS gone, g.status IS NULL OR g.status = 'unknown' AS open
  FROM programs p LEFT JOIN subject_groups g ON p.program = g.program AND g.number = 1 LEFT JOIN limits l ON p.program = l.program),
told AS (
  SELECT *, CASE WHEN gone AND status = 'no_exam' THEN 'no exam' WHEN gone THEN 'subjects differ' WHEN open THEN 'subjects unknown' END AS a,
         CASE WHEN gone THEN NULL WHEN coalesce(t, 'unknown') = 'unknown' THEN 'value unknown' WHEN t = 'excluded' THEN 'value too small' END AS b
  FROM judged)
SELECT program, CASE WHEN gone OR b = 'value too small' THEN 'excluded' WHEN a IS NOT NULL OR b IS NOT NULL THEN 'unknown' ELSE 'match' END AS verdict,
       CASE WHEN b = 'value too small' THEN b ELSE concat_ws('; ', a, b) END AS reasons FROM told""")
def search_three_valued(spark, sf):
    groups = ops.subject_groups(base.subjects(spark, sf))
    return ops.search(base.programs(spark, sf), groups, public_plan_basis(spark, sf), special=True, least=200_000)


@query(with_(P, PR, S, L) + "SELECT * FROM scoped")
def baseline_lines(spark, sf):
    no_exam = base.subjects(spark, sf).where("status = 'no_exam'")
    return ops.lines_with_baselines(base.programs(spark, sf), base.lines(spark, sf), base.baselines(spark, sf), no_exam)


@query(with_(P, S, G) + "SELECT * FROM subject_groups")
def subject_groups(spark, sf):
    return ops.subject_groups(base.subjects(spark, sf))


@query(with_(P, D) + """SELECT p.id, p.source, title, coalesce(page_url, attachment_url) AS url, CASE WHEN page_url IS NOT NULL THEN attachment_url END AS attachment
FROM plans p LEFT JOIN docs d ON p.source = d.id""")
def source_lookup(spark, sf):
    return ops.with_source(base.plans(spark, sf).select("id", "source"), base.documents_of_facts(spark, sf))


@query(with_(P, PR, S, L) + """, main AS (
  SELECT program, year, scope, total FROM scoped QUALIFY row_number() OVER (PARTITION BY program ORDER BY year DESC, scope = 'college' DESC, total) = 1),
plan AS (SELECT program, value FROM plans QUALIFY row_number() OVER (PARTITION BY program ORDER BY year DESC, id) = 1)
SELECT p.program, m.total AS line, m.scope, m.year AS line_year, n.value AS plan,
       concat_ws('; ', CASE WHEN m.program IS NULL THEN 'line: not found' END, CASE WHEN n.value IS NULL THEN 'plan: not found' END) AS gaps
FROM programs p LEFT JOIN main m ON p.program = m.program LEFT JOIN plan n ON p.program = n.program""")
def compare_rows(spark, sf):
    return ops.compare(base.programs(spark, sf).select("program"), baseline_lines(spark, sf), base.plans(spark, sf))


REFERENCES = """SELECT o_orderkey AS fact, CASE o_orderkey % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE' ELSE 'MIDDLE EAST' END AS school,
  CASE WHEN o_orderkey % 3 > 0 THEN 'NATION_' || CAST(o_orderkey % 25 AS {string}) END AS college, o_orderkey % 4 = 0 AS pool,
  CASE WHEN o_orderkey % 4 = 0 THEN lpad(CAST(o_orderkey % 3 AS {string}), 2, '0') ELSE lpad(CAST(o_custkey % 3000 AS {string}), 4, '0') || 'HO' END AS code,
  CASE WHEN o_orderkey % 7 = 0 THEN 'HOUSEHOLD' END AS mode
  FROM orders"""


@query(with_(PR) + ", refs AS (" + REFERENCES.format(string="VARCHAR") + """),
found AS (
  SELECT r.fact, r.pool, p.program, count(p.program) OVER (PARTITION BY r.fact) AS n FROM refs r LEFT JOIN programs p
    ON r.school = p.school AND (r.college IS NULL OR r.college IN (p.college_id, p.college_name))
   AND CASE WHEN r.pool THEN starts_with(p.code, r.code) ELSE p.code = r.code END AND (r.mode IS NULL OR r.mode = p.mode) AND NOT (r.pool AND r.college IS NULL))
SELECT DISTINCT fact, CASE WHEN n = 0 THEN 'unresolved' WHEN n > 1 AND NOT pool THEN 'ambiguous' ELSE 'resolved' END AS status,
       CASE WHEN n = 1 OR (n > 1 AND pool) THEN program END AS program FROM found""")
def resolve_refs(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    school = F.element_at(F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))), (key % 5 + 1).cast("int"))
    code = F.when(key % 4 == 0, F.lpad((key % 3).cast("string"), 2, "0")).otherwise(F.concat(F.lpad((F.col("o_custkey") % 3000).cast("string"), 4, "0"), F.lit("HO")))
    references = o.select(key.alias("fact"), school.alias("school"), F.when(key % 3 > 0, F.concat(F.lit("NATION_"), (key % 25).cast("string"))).alias("college"), (key % 4 == 0).alias("pool"), code.alias("code"), F.when(key % 7 == 0, "HOUSEHOLD").alias("mode"))
    return resolve.resolve_references(references, base.programs(spark, sf).withColumn("college_code", F.col("college_id")))


RECONCILED = with_(P) + """, extracted AS (SELECT id, program, year, kind, CASE WHEN id % 13 > 0 THEN pool END AS pool, value + CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS value, method, source FROM plans WHERE id % 2 = 0),
seed AS (SELECT id, program, year, kind, pool, value, method, source FROM plans WHERE id % 3 > 0),
first_seed AS (SELECT * FROM seed QUALIFY row_number() OVER (PARTITION BY program, year, kind, pool ORDER BY id) = 1),
own AS (SELECT *, row_number() OVER (PARTITION BY program, year, kind, pool ORDER BY id) AS number FROM extracted),
joined AS (
  SELECT o.*, s.id AS seed_id, CASE WHEN o.number = 1 AND s.id IS NOT NULL
         THEN concat_ws(',', CASE WHEN o.value IS DISTINCT FROM s.value THEN 'value' END, CASE WHEN o.method IS DISTINCT FROM s.method THEN 'method' END) ELSE '' END AS differences
  FROM own o LEFT JOIN first_seed s ON o.program = s.program AND o.year = s.year AND o.kind = s.kind AND o.pool IS NOT DISTINCT FROM s.pool),
results AS (
  SELECT id, program, year, kind, pool, value, method, CASE WHEN number > 1 THEN 'duplicate' WHEN seed_id IS NULL THEN 'new' WHEN differences = '' THEN 'match' ELSE 'conflict' END AS status, differences, source
  FROM joined)"""


def _sides(spark, sf):
    p = base.plans(spark, sf)
    columns = ["id", "program", "year", "kind", "pool", "value", "method", "source"]
    extracted = p.where("id % 2 = 0").withColumn("pool", F.when(F.col("id") % 13 > 0, F.col("pool"))).withColumn("value", F.col("value") + F.when(F.col("id") % 17 == 0, 1).otherwise(0))
    return extracted.select(*columns), p.where("id % 3 > 0").select(*columns)


@query(RECONCILED + "SELECT id, program, year, kind, pool, value, method, status, differences, status = 'match' AS verified FROM results")
def reconcile_seed(spark, sf):
    extracted, seed = _sides(spark, sf)
    return resolve.reconcile(extracted, seed, ("program", "year", "kind", "pool"), ("value", "method"))


@query(RECONCILED + """, a AS (SELECT source, count(*) AS seed FROM seed GROUP BY source),
b AS (SELECT source, count(*) FILTER (WHERE status = 'match') AS matched, count(*) FILTER (WHERE status = 'conflict') AS conflicts, count(*) FILTER (WHERE status = 'new') AS new FROM results GROUP BY source),
c AS (SELECT coalesce(a.source, b.source) AS source, coalesce(seed, 0) AS seed, coalesce(matched, 0) AS matched, coalesce(conflicts, 0) AS conflicts, coalesce(new, 0) AS new FROM a FULL JOIN b ON a.source = b.source)
SELECT *, greatest(seed - matched - conflicts, 0) AS missing, seed > 0 AND matched = seed AND conflicts = 0 AS passed FROM c""")
def coverage_report(spark, sf):
    extracted, seed = _sides(spark, sf)
    results = resolve.reconcile(extracted, seed, ("program", "year", "kind", "pool"), ("value", "method")).join(extracted.select("id", "source"), "id")
    return resolve.coverage(seed, results)


@query(RECONCILED + """SELECT s.id, CASE WHEN s.id % 7 = 1 THEN 'document not held' WHEN s.id % 7 = 2 THEN 'personal document' WHEN s.id % 7 = 3 THEN 'no extractor' WHEN r.n > 0 THEN 'other value' ELSE 'not found' END AS reason
FROM seed s LEFT JOIN (SELECT program, year, kind, count(*) AS n FROM results WHERE status = 'conflict' GROUP BY ALL) r ON s.program = r.program AND s.year = r.year AND s.kind = r.kind""")
def missing_reasons(spark, sf):
    extracted, seed = _sides(spark, sf)
    results = resolve.reconcile(extracted, seed, ("program", "year", "kind", "pool"), ("value", "method"))
    conflicts = results.where("status = 'conflict'").groupBy("program", "year", "kind").agg(F.count(F.lit(1)).alias("n"))
    joined = seed.join(conflicts, ["program", "year", "kind"], "left")
    left = F.col("id") % 7
    reason = resolve.missing_reason(F.when(left == 1, "seed_only").otherwise("active"), left == 2, left != 3, F.coalesce(F.col("n") > 0, F.lit(False)))
    return joined.select("id", reason.alias("reason"))


@query("""SELECT source, sum(plans) AS plans, sum(lines) AS lines, sum(stats) AS stats FROM (
  SELECT o_orderkey % 7 AS source, 1 AS plans, 0 AS lines, 0 AS stats FROM orders UNION ALL SELECT l_orderkey % 7, 0, 1, 0 FROM lineitem UNION ALL SELECT user_id % 7, 0, 0, 1 FROM events)
GROUP BY source""")
def fact_counts_per_source(spark, sf):
    parts = [table(spark, sf, t).select((F.col(k) % 7).alias("source"), F.lit(n).alias("kind")) for t, k, n in (("orders", "o_orderkey", "plans"), ("lineitem", "l_orderkey", "lines"), ("events", "user_id", "stats"))]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").pivot("kind", ["plans", "lines", "stats"]).count()
    return counts.na.fill(0)


@query("""SELECT user_id, arg_max(event_type, (n, -first)) AS most, max(n) AS n FROM (
  SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id""")
def mode_by_group(spark, sf):
    """AGG-15: the most common value, of equals the one seen first."""
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return counts.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("most"), F.max("n").alias("n"))


@query(with_(P) + """SELECT program, year, kind, arg_min(id, (method, id)) AS id, arg_min(value, (method, id)) AS value, arg_min(code, (method, id)) AS code, bool_or(verified) AS verified,
  string_agg(DISTINCT CAST(method AS VARCHAR), ',' ORDER BY CAST(method AS VARCHAR)) AS methods, arg_min(evidence, (method, id)) FILTER (WHERE evidence <> '') AS evidence
FROM plans GROUP BY program, year, kind""")
def merged_statistics(spark, sf):
    """AGG-20: merged statistics carry several values."""
    rows = base.plans(spark, sf).withColumn("rank", F.col("method"))
    return ops.merge_facts(rows, ("program", "year", "kind"), ("value", "code"))


@query(with_(P) + "SELECT id, year FROM plans p WHERE year = (SELECT max(year) FROM plans q WHERE q.program = p.program AND q.pool IS NOT DISTINCT FROM p.pool)")
def correlated_latest(spark, sf):
    """JON-04: a correlated, null-safe maximum."""
    p = base.plans(spark, sf)
    top = p.groupBy(F.col("program").alias("q"), F.col("pool").alias("qp")).agg(F.max("year").alias("top"))
    return p.join(top, (F.col("program") == F.col("q")) & F.col("pool").eqNullSafe(F.col("qp")) & (F.col("year") == F.col("top"))).select("id", "year")


@query("""WITH k AS (SELECT page_id AS doc, 'k' || CAST(page_id % 60 AS VARCHAR) AS key, url, md5(html) AS digest FROM pages WHERE page_id % 3 = 0),
f AS (SELECT page_id AS id, 'k' || CAST(page_id % 90 AS VARCHAR) AS key, url, md5(html) AS digest FROM pages)
SELECT f.id, coalesce(a.doc, b.doc, c.doc) AS known, CASE WHEN a.doc IS NOT NULL THEN 'key' WHEN b.doc IS NOT NULL THEN 'url' WHEN c.doc IS NOT NULL THEN 'digest' END AS by FROM f
LEFT JOIN (SELECT key, min(doc) AS doc FROM k GROUP BY key) a ON f.key = a.key
LEFT JOIN (SELECT url, min(doc) AS doc FROM k GROUP BY url) b ON f.url = b.url
LEFT JOIN (SELECT digest, min(doc) AS doc FROM k GROUP BY digest) c ON f.digest = c.digest""")
def known_lookup(spark, sf):
    p = table(spark, sf, "pages")
    cols = lambda n: [F.concat(F.lit("k"), (F.col("page_id") % n).cast("string")).alias("key"), "url", F.md5("html").alias("digest")]
    known = p.where("page_id % 3 = 0").select(F.col("page_id").alias("doc"), *cols(60))
    return resolve.known_lookup(p.select(F.col("page_id").alias("id"), *cols(90)), known).select("id", "known", "by")


@query(with_(P) + """, e AS (SELECT id AS want, program, year, kind, value, source FROM plans WHERE id % 2 = 0), g AS (SELECT program, year, kind, value, source FROM plans WHERE id % 5 > 0)
SELECT e.want, g.value IS NOT NULL AS found, coalesce(bool_or(g.source = e.source), false) AS source_matches FROM e LEFT JOIN g USING (program, year, kind, value) GROUP BY e.want, g.value IS NOT NULL""")
def fact_match(spark, sf):
    from ledgerloom.operators.evaluate import match_facts

    p = base.plans(spark, sf)
    return match_facts(p.where("id % 2 = 0").withColumn("want", F.col("id")), p.where("id % 5 > 0"), ("program", "year", "kind", "value"))


@query(with_(P) + """SELECT program, year, count(DISTINCT CASE WHEN verified THEN (value, source) END) AS n, CASE count(DISTINCT CASE WHEN verified THEN (value, source) END) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS verdict,
  CASE WHEN count(DISTINCT CASE WHEN verified THEN (value, source) END) = 1 THEN min(value) FILTER (WHERE verified) END AS value FROM plans GROUP BY program, year""")
def resolve_exactly_one(spark, sf):
    out = resolve.exactly_one(base.plans(spark, sf).withColumn("key", F.struct("program", "year")))
    return out.select("key.program", "key.year", "n", "verdict", "value")


@query(with_(P) + """SELECT program, id, kind, year, value FROM plans QUALIFY row_number() OVER (PARTITION BY program
  ORDER BY CASE kind WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, year DESC, verified DESC, source, id) = 1""")
def best_fact(spark, sf):
    return resolve.best_fact(base.plans(spark, sf), ("3-MEDIUM", "1-URGENT")).select("program", "id", "kind", "year", "value")


@query(with_(P, D) + """, c AS (SELECT program AS fact, id AS doc, year >= 1998 AS y, kind = '1-URGENT' AS k, verified AS v, source = 0 AS personal FROM plans),
s AS (SELECT *, CASE WHEN y THEN 3 ELSE 0 END + CASE WHEN k THEN 5 ELSE 0 END + CASE WHEN v THEN 1 ELSE 0 END AS score FROM c)
SELECT fact, arg_max(doc, (NOT personal, score, -doc)) AS doc, max(score) FILTER (WHERE NOT personal) AS score FROM s GROUP BY fact""")
def source_pick(spark, sf):
    c = base.plans(spark, sf).select(F.col("program").alias("fact"), F.col("id").alias("doc"), F.col("id").alias("position"), (F.col("year") >= 1998).alias("y"), (F.col("kind") == "1-URGENT").alias("k"), F.col("verified").alias("v"), (F.col("source") == 0).alias("personal"))
    return resolve.pick_source(c, {"y": 3, "k": 5, "v": 1})


@query(with_(P) + """SELECT "group", codes, codes > 1 AND vals = 1 AND says AS is_pool FROM (
  SELECT program % 400 AS "group", count(DISTINCT code) AS codes, count(DISTINCT value // 200000) AS vals, bool_or(pool IS NOT NULL) AS says FROM plans GROUP BY 1)""")
def pool_detection(spark, sf):
    rows = base.plans(spark, sf).select((F.col("program") % 400).alias("group"), "code", F.expr("value div 200000").alias("value"), F.col("pool").isNotNull().alias("says_pool"))
    return resolve.pools(rows)


@query("""SELECT s_suppkey AS id, kind, value FROM (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS nation, s_name AS title, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 9 AS VARCHAR) END AS grade FROM supplier)
UNPIVOT (value FOR kind IN (nation AS 'n', title AS 't', grade AS 'g'))""")
def unpivot_seed(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("nation"), F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 3 > 0, (F.col("s_suppkey") % 9).cast("string")).alias("grade"))
    return resolve.unpivot_seed(s, "id", {"nation": "n", "title": "t", "grade": "g"})


@query(with_(P) + """SELECT id FROM plans QUALIFY row_number() OVER (PARTITION BY program, year, kind, pool ORDER BY id) = 1""")
def once_per_key(spark, sf):
    return resolve.first_by_key(base.plans(spark, sf), ("program", "year", "kind", "pool")).where("number = 1").select("id")


@query(with_(PR, P) + """SELECT p.program, count(l.id) AS n_plans, coalesce(sum(l.value), 0) AS total FROM programs p LEFT JOIN plans l ON p.program = l.program GROUP BY p.program""")
def nested_facts(spark, sf):
    nested = ops.nested_facts(base.programs(spark, sf).select("program"), plans=base.plans(spark, sf).select("program", "year", "id", "value"))
    return nested.select("program", F.size("plans").cast("long").alias("n_plans"), F.aggregate("plans", F.lit(0).cast("long"), lambda a, x: a + x["value"]).alias("total"))


@query(with_(PR, P) + """SELECT p.program, l.year, coalesce(CAST(l.value AS VARCHAR), 'unknown') AS value FROM programs p LEFT JOIN (SELECT * FROM plans WHERE year = 1996) l ON p.program = l.program""")
def lookup_with_unknown(spark, sf):
    return ops.lookup(base.programs(spark, sf), base.plans(spark, sf), "value", 1996)


@query("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS label,
  list_aggregate(list_filter(list_transform(string_split(replace(o_orderpriority || '，' || o_orderstatus || ', ,', '，', ','), ','), lambda x: trim(x)), lambda x: x <> ''), 'string_agg', '|') AS parts FROM orders""")
def labels(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat("o_orderpriority", F.lit("，"), "o_orderstatus", F.lit(", ,"))
    return o.select(F.col("o_orderkey").alias("id"), ops.label_codes("o_orderstatus", {"F": "finished", "O": "open"}).alias("label"), F.array_join(ops.split_list(text), "|").alias("parts"))


@query("""SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 400000)""")
def exists_child(spark, sf):
    """FLT-17."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_totalprice > 400000")
    c = table(spark, sf, "customer")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("id"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src1'")
def document_filter(spark, sf):
    """FLT-06, FLT-07: filters by metadata are given to the scan."""
    return table(spark, sf, "documents").where((F.col("lang") == "en") & (F.col("source") == "src1")).select("doc_id", "lang", "source")
