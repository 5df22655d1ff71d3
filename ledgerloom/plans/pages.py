"""Queries on notes, catalogues, collection and views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import crawl, documents, evaluate, model, notes, views
from ledgerloom.session import table
from ledgerloom.sources import html

from . import agent, base, facts
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


PARTS = "p AS (SELECT p_partkey AS id, p_size AS n, CAST(p_size AS VARCHAR) AS s, CAST(p_size + 1 AS VARCHAR) AS t, p_partkey % 4 AS k FROM part)"


@query(with_(PARTS) + """SELECT id, "table", kind, year, value, pool_scope, evidence FROM (
  SELECT id, 'plan' AS "table", 'rules_total' AS kind, 2026 AS year, n + 100 AS value, NULL AS pool_scope, '学院细则为总' || CAST(n + 100 AS VARCHAR) || '/已招推免' || s || '/公开' || t AS evidence FROM p WHERE k = 0
  UNION ALL SELECT id, 'plan', 'tm', 2026, n, NULL, '学院细则为总' || CAST(n + 100 AS VARCHAR) || '/已招推免' || s || '/公开' || t FROM p WHERE k = 0
  UNION ALL SELECT id, 'plan', 'public_exam', 2026, n + 1, NULL, '学院细则为总' || CAST(n + 100 AS VARCHAR) || '/已招推免' || s || '/公开' || t FROM p WHERE k = 0
  UNION ALL SELECT id, 'plan', 'special_veteran', 2026, n, NULL, '另退役' || s || '（线296）' FROM p WHERE k < 2
  UNION ALL SELECT id, 'score', 'special_veteran', 2026, 296, NULL, '另退役' || s || '（线296）' FROM p WHERE k < 2
  UNION ALL SELECT id, 'plan', 'catalog_total', 2027, n, '0812', '2027目录只给出0812合计' || s || '人（含推免）' FROM p WHERE k = 2
  UNION ALL SELECT id, 'baseline', 'school_baseline', 2026, 280, NULL, '工学[08]学硕 280/45/60' FROM p WHERE k < 3)""")
def note_facts(spark, sf):
    """STR-23."""
    n, t, k = F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string"), F.col("p_partkey") % 4
    rules = F.when(k == 0, F.concat(F.lit("学院细则为总"), (F.col("p_size") + 100).cast("string"), F.lit("/已招推免"), n, F.lit("/公开"), t, F.lit("。"))).otherwise("")
    veterans = F.when(k < 2, F.concat(F.lit("另退役"), n, F.lit("（线296）；"))).otherwise("")
    pool = F.when(k == 2, F.concat(F.lit("2027目录只给出0812合计"), n, F.lit("人（含推免）。"))).when(k == 3, F.concat(F.lit("2027目录只给出0854合计"), n, F.lit("人（含推免）。无"))).otherwise("")
    line = F.when(k < 3, "工学[08]学硕 280/45/60").otherwise("")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(rules, veterans, pool, line).alias("note"), F.lit("081200").alias("code"))
    return notes.note_facts(rows, "note", "code").select("id", "table", "kind", "year", "value", "pool_scope", "evidence")


@query(with_(PARTS) + """SELECT id, label, discipline, total, '45/45/60/60' AS lines FROM (
  SELECT id, '工学' AS label, '08' AS discipline, n + 200 AS total FROM p WHERE k = 0 UNION ALL SELECT id, '电子信息', '0854', n + 200 FROM p WHERE k IN (1, 2) UNION ALL SELECT id, '机械', '0855', n + 200 FROM p WHERE k = 2)""")
def explode_codes(spark, sf):
    """EXT-08."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "工学[08]").when(k == 1, "电子信息[0854]").when(k == 2, "电子信息[0854]、机械 [0855]").otherwise("无代码")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), (F.col("p_size") + 200).alias("total"), F.lit(45).alias("low"), F.lit(60).alias("high"))
    return notes.explode_codes(rows, "name", "total", "low", "high").select("id", "label", "discipline", "total", F.array_join(F.transform("lines", lambda x: x.cast("string")), "/").alias("lines"))


@query("""WITH c AS (SELECT o_custkey AS cell, CAST(o_orderkey % 9 AS VARCHAR) AS subject, min(o_orderkey) AS first FROM orders GROUP BY ALL),
g AS (SELECT cell, string_agg(subject, '/' ORDER BY first) AS subjects FROM c GROUP BY cell)
SELECT cell, unnest(CASE WHEN cell % 2 = 0 THEN ['081200', '085404'] ELSE ['0812Z3'] END) AS code, subjects FROM g""")
def group_by_origin(spark, sf):
    """EXT-09: a customer's orders as the rows under one merged cell."""
    programs = F.when(F.col("o_custkey") % 2 == 0, "081200、085404、081200").otherwise("0812Z3 方向")
    cells = table(spark, sf, "orders").select(F.col("o_custkey").alias("cell"), programs.alias("programs"), (F.col("o_orderkey") % 9).cast("string").alias("subject"), F.col("o_orderkey").alias("line"))
    return notes.group_by_origin(cells, ["cell"], "programs", "subject", "line")


@query("""WITH c AS (SELECT c_nationkey AS doc, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer)
SELECT doc, '041' AS college, CASE WHEN id % 2 = 0 THEN '081200' ELSE '085404' END AS code, CASE WHEN id % 3 = 0 THEN CAST(id % 50 AS INTEGER) WHEN id % 2 = 0 THEN 24 ELSE NULL END AS value,
  CASE WHEN id % 3 > 0 AND id % 2 = 0 THEN '0812' END AS pool_scope, CAST(2 AS BIGINT) AS directions, CASE WHEN id % 5 > 0 THEN '①101 ②408' END AS subjects FROM c""")
def catalogue_rows(spark, sf):
    """EXT-01, WIN-05: a college's row, then each customer as a program with two directions. Only programs of a discipline with a pool get its
    count."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("id"))
    colleges = c.select("doc").distinct().select("doc", F.lit(0).cast("long").alias("line"), F.lit("041信息学院 | 拟招生总人数 | 30 | 计算机科学与技术指标为24个，以上均按一级学科统筹").alias("text"))
    program = F.when(F.col("id") % 2 == 0, "081200 计算机科学与技术").otherwise("085404 计算机技术")
    count = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" | "), (F.col("id") % 50).cast("string"))).otherwise("")
    other = F.when(F.col("id") % 5 == 0, "①101 ②302").otherwise("①101 ②408")
    texts = F.array(F.concat(program, count), F.lit("01 方向甲 | ①101 ②408"), F.concat(F.lit("02 方向乙 | "), other))
    rows = c.select("doc", F.posexplode(texts).alias("p", "text"), "id").select("doc", ((F.col("id") + 1) * 10 + F.col("p")).alias("line"), "text")
    return notes.catalogue(colleges.unionByName(rows), pools={"计算机科学与技术": "0812"}).select("doc", "college", "code", "value", "pool_scope", "directions", "subjects")


@query("""SELECT page_id, regexp_matches(url, '/[a-z]{2}/[0-9]+') AND NOT contains(url, '?') AND NOT regexp_matches(url, '\\.pdf$') AS accepted FROM pages""")
def url_accept(spark, sf):
    """FLT-13."""
    fits = crawl.is_article(F.col("url"), F.col("url"), (r"/[a-z]{2}/[0-9]+",), (r"\?", r"\.pdf$"))
    return table(spark, sf, "pages").select("page_id", fits.alias("accepted"))


@query("SELECT s_suppkey AS id, s_suppkey % 4 IN (0, 2) AS inside, s_suppkey % 4 = 0 AND s_suppkey % 3 = 0 AS personal FROM supplier")
def path_rules(spark, sf):
    """FLT-16, SRC-14."""
    key, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    path = F.when(k == 0, F.concat(F.lit("/data/raw/./"), key)).when(k == 1, F.concat(F.lit("/data/raw/../other/"), key)).when(k == 2, F.concat(F.lit("/data//raw/a/b/../"), key)).otherwise(F.concat(F.lit("/data/rawer/"), key))
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), path.alias("path"))
    entries = table(spark, sf, "supplier").select(F.concat(F.lit("raw/"), key).alias("local_path"), (F.col("s_suppkey") % 12 == 0).alias("contains_personal_data"), F.col("s_suppkey").alias("position"))
    personal = crawl.personal_files(files, crawl.by_local_path(entries), "/data").select("id", F.lit(True).alias("personal"))
    return files.join(personal, "id", "left").select("id", crawl.is_within(F.col("path"), F.lit("/data/raw/")).alias("inside"), F.coalesce("personal", F.lit(False)).alias("personal"))


LINKS = """links AS (SELECT user_id AS source, event_id AS position, event_id % 7 AS key, CASE WHEN event_id % 3 = 0 THEN '更多' WHEN event_id % 3 = 1 THEN event_type END AS attribute,
  CASE WHEN event_id % 5 = 0 THEN 'inner ' || event_type END AS inner_title, CASE WHEN event_id % 4 > 0 THEN 'text ' || event_type ELSE '' END AS text, CASE WHEN event_id % 2 = 0 THEN CAST(ts AS DATE) END AS day FROM events),
titled AS (SELECT *, CASE WHEN attribute IS NOT NULL AND attribute <> '更多' THEN attribute WHEN inner_title IS NOT NULL THEN inner_title WHEN text <> '' THEN text END AS title,
  CASE WHEN attribute IS NOT NULL AND attribute <> '更多' THEN 2 WHEN inner_title IS NOT NULL THEN 1 ELSE 0 END AS quality FROM links),
ranked AS (SELECT *, quality * 100000 + length(title) AS rank, max(quality * 100000 + length(title)) OVER (PARTITION BY source, key ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM titled WHERE title IS NOT NULL),
leads AS (SELECT *, last_value(day IGNORE NULLS) OVER (PARTITION BY source, key ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM ranked WHERE before IS NULL OR rank > before)"""


@query(with_(LINKS) + "SELECT source, key, arg_max(title, position) AS title, arg_max(quality, position) AS quality, max_by(known, position) AS day FROM (SELECT source, key, title, quality, position, coalesce(known, DATE '1900-01-01') AS known FROM leads) GROUP BY source, key")
def list_entries(spark, sf):
    """STM-07: a user's events as the links of a list."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    links = e.select(F.col("user_id").alias("source"), k.alias("position"), (k % 7).alias("key"), F.lit("u").alias("url"), F.when(k % 3 == 0, "更多").when(k % 3 == 1, F.col("event_type")).alias("attribute"), F.when(k % 5 == 0, F.concat(F.lit("inner "), "event_type")).alias("inner"), F.when(k % 4 > 0, F.concat(F.lit("text "), "event_type")).otherwise("").alias("text"), F.when(k % 2 == 0, F.col("ts").cast("date")).alias("day"))
    return crawl.list_entries(links).select("source", "key", "title", "quality", F.coalesce("day", F.to_date(F.lit("1900-01-01"))).alias("day"))


@query("""WITH p AS (SELECT s_suppkey AS source, unnest(range(1, 6)) AS page FROM supplier),
u AS (SELECT source, page, CASE WHEN page = 1 THEN 'http://l/' || source WHEN source % 3 > 0 THEN 'http://l/' || source || '/' || page || '-' || (page - 1) END AS url FROM p),
s AS (SELECT source, min(page) AS stop FROM u WHERE url IS NOT NULL AND (source * page) % 7 = 0 GROUP BY source)
SELECT u.source, u.page, u.url FROM u LEFT JOIN s ON u.source = s.source WHERE url IS NOT NULL AND (stop IS NULL OR page < stop)""")
def list_pages(spark, sf):
    """STM-08."""
    key = F.col("s_suppkey").cast("string")
    lists = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source"), F.concat(F.lit("http://l/"), key).alias("url"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("http://l/"), key, F.lit("/{n}-{n0}"))).alias("template"))
    pages = crawl.page_urls(lists, 5).withColumn("ok", F.lit(True)).withColumn("entries", (F.col("source") * F.col("page")) % 7)
    return crawl.pages_until_empty(pages).select("source", F.col("page").cast("long").alias("page"), "url")


@query("""WITH t AS (SELECT o_custkey AS school, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 404 ELSE 500 END AS status FROM orders WHERE o_orderkey > 500),
r AS (SELECT *, sum(CASE WHEN status = 404 THEN 1 ELSE 0 END) OVER (PARTITION BY school ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS gone FROM t),
e AS (SELECT *, coalesce(max(CASE WHEN gone >= 2 OR status = 500 THEN 1 ELSE 0 END) OVER (PARTITION BY school ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM r)
SELECT school, id FROM e WHERE ended = 0 AND status = 200""")
def probe_ids(spark, sf):
    """STM-09."""
    o = table(spark, sf, "orders")
    known = o.select(F.col("o_custkey").alias("school"), F.lit(500).cast("long").alias("id")).distinct()
    status = F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 404).otherwise(500)
    return crawl.probe_ids(known, o.select(F.col("o_custkey").alias("school"), F.col("o_orderkey").alias("id"), status.alias("status")))


@query("""SELECT 'new_' || doc_type AS kind, page_id, year, latest_known FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'catalog' ELSE 'brochure' END AS doc_type, 2020 + CAST(page_id % 9 AS INTEGER) AS year, CASE WHEN page_id % 3 = 0 THEN 2025 END AS latest_known FROM pages WHERE page_id % 3 < 2 AND page_id % 5 > 0) WHERE latest_known IS NULL OR year > latest_known""")
def title_alerts(spark, sf):
    """STM-10."""
    k = F.col("page_id")
    what = F.when(k % 3 == 0, "硕士专业目录").when(k % 3 == 1, "招生简章").otherwise("通知")
    title = F.concat((k % 9 + 2020).cast("string"), F.lit("年"), F.when(k % 5 == 0, "推免").otherwise(""), what)
    known = spark.createDataFrame([("catalog", 2024), ("catalog", 2025), ("notice", 2030)], "doc_type string, year int")
    found = crawl.title_alerts(table(spark, sf, "pages").select(title.alias("title"), k.cast("string").alias("url")), known)
    return found.select("kind", F.col("url").cast("long").alias("page_id"), "year", "latest_known")


@query("""WITH e AS (SELECT user_id AS run, event_id AS moment, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'done' ELSE 'running' END AS status, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
l AS (SELECT run, min(moment) AS started, arg_max(status, moment) AS status, arg_max(k, moment) AS requests, max(moment) AS last FROM e GROUP BY run)
SELECT run, started, CASE WHEN status <> 'running' THEN last END AS ended, status, requests, 2 AS schools FROM l""")
def run_ledger(spark, sf):
    """STM-13, JSN-04."""
    e, kind = table(spark, sf, "events"), F.col("event_type")
    stats = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("requests"), F.lit("a,,b").alias("schools")))
    entries = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), F.when(kind == "error", "error").when(kind == "purchase", "done").otherwise("running").alias("status"), stats.alias("stats"))
    return crawl.run_ledger(entries).select("run", "started", "ended", "status", "requests", F.size("schools").alias("schools"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'removed' WHEN 2 THEN 'login' WHEN 3 THEN 'failed' ELSE CASE WHEN b IS NULL THEN 'new' WHEN b = event_type THEN 'unchanged' ELSE 'changed' END END AS outcome
FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)""")
def fetch_outcomes(spark, sf):
    """STM-02, STM-05: conditional fetches."""
    from pyspark.sql import Window

    k = F.col("event_id") % 8
    status = F.when(k == 0, 304).when(k == 1, 404).when(k == 2, 403).when(k == 3, 500).otherwise(200)
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select("event_id", "event_type", status.alias("status"), before.alias("before")).select("event_id", crawl.fetch_outcome(F.col("status"), F.col("event_type"), F.col("before")).alias("outcome"))


@query("""SELECT c_custkey AS id, '{"name":"' || c_name || '"' || CASE WHEN c_custkey % 3 > 0 THEN ',"segment":"' || c_mktsegment || '"' ELSE '' END || '}' AS slim FROM customer""")
def slim_projection(spark, sf):
    """FLT-09."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"))
    return c.select("id", views.slim_json(["name", "segment"]).alias("slim"))


@query("""SELECT o_orderkey AS id, "table", kind, field, value FROM (
  SELECT o_orderkey, 'score_lines' AS "table", o_orderstatus AS kind, 'total' AS field, CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 'exam_subjects', 'slot4', 'total', '408' FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 'plans', 'tm', 'total', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 2 = 0)""")
def json_facts(spark, sf):
    """JSN-02, JSN-03: programs at any depth of a tool's output."""
    o = table(spark, sf, "orders")
    subjects = F.array(F.struct(F.lit(4).alias("slot"), F.lit("408").alias("code")))
    program = F.struct(F.lit("x").alias("program_id"), F.array(F.struct(F.col("o_orderstatus").alias("scope"), F.col("o_orderkey").alias("total"))).alias("lines"), F.array(F.struct(F.lit("tm").alias("kind"), F.col("o_custkey").alias("value"))).alias("plans"), F.array(F.struct(F.lit(2026).alias("year"), subjects.alias("subjects"))).alias("exam_subjects"))
    nested = F.to_json(F.struct(F.struct(F.array(F.struct(program.alias("deep"))).alias("programs")).alias("result")))
    outputs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, nested).otherwise("no json {").alias("output"))
    return views.tool_facts(outputs, "output").select("id", "table", "kind", "field", "value")


@query(with_(base.SQL_PLANS, base.SQL_PROGRAMS, base.SQL_SUBJECTS, base.SQL_GROUPS, base.SQL_LINES) + """, s AS (SELECT * FROM subject_groups QUALIFY row_number() OVER (PARTITION BY program ORDER BY year DESC, number) = 1),
l AS (SELECT * FROM scoped QUALIFY row_number() OVER (PARTITION BY program ORDER BY year DESC, total) = 1),
c AS (SELECT * FROM plans WHERE kind = '2-HIGH' QUALIFY row_number() OVER (PARTITION BY program ORDER BY year DESC, id) = 1)
SELECT p.program, CASE WHEN s.program IS NULL THEN '未找到' WHEN s.status = 'no_exam' THEN '不考统考' WHEN s.status = 'unknown' THEN '未知' ELSE s.codes || '（' || s.year || '）' END AS subjects,
  CASE WHEN s.program IS NULL OR s.status = 'unknown' THEN '未知' WHEN s.status <> 'no_exam' AND s.is_special THEN '是' ELSE '否' END AS special,
  CASE WHEN l.program IS NULL THEN '未找到' ELSE CAST(l.total AS VARCHAR) || ' ' || l.year END AS line,
  CASE WHEN c.program IS NULL THEN '未找到' ELSE CAST(c.value AS VARCHAR) || '（' || c.year || CASE WHEN c.pool IS NOT NULL THEN '，' || c.pool || ' 合计' ELSE '' END || '）' END AS plan
FROM programs p LEFT JOIN s ON p.program = s.program LEFT JOIN l ON p.program = l.program LEFT JOIN c ON p.program = c.program""")
def presentation_rows(spark, sf):
    """VIEW-01."""
    rows = views.presentation_rows(base.programs(spark, sf), facts.subject_groups(spark, sf), facts.baseline_lines(spark, sf), base.plans(spark, sf), "2-HIGH")
    return rows.select("program", "subjects", "special", F.regexp_replace("line", " (?:college|baseline)$", "").alias("line"), "plan")


@query(with_(base.SQL_PLANS, base.SQL_DOCUMENTS) + """SELECT DISTINCT p.source, p.evidence, title, coalesce(page_url, attachment_url) AS url FROM plans p LEFT JOIN docs d ON p.source = d.id""")
def citations(spark, sf):
    """AGT-06."""
    return agent.citations(base.plans(spark, sf), base.documents_of_facts(spark, sf)).select("source", "evidence", "title", "url")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE false END AS grounded FROM orders""")
def evidence_grounding(spark, sf):
    """EXT-15: evidence in the text that holds the value; another value; evidence that is not there; none."""
    key, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    text = F.concat(F.lit("本专业 拟招 "), key, F.lit(" 人，含推免。"))
    evidence = F.when(k == 0, F.concat(F.lit("拟招"), key, F.lit("人"))).when(k == 1, "含推免").when(k == 2, F.concat(F.lit("实招"), key)).otherwise("")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), documents.grounded(text, evidence, F.col("o_orderkey")).alias("grounded"))


@query("""WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS n, 40.0 * floor((l_linenumber - 1) / 3) + l_linenumber % 2 AS y, 100.0 - l_linenumber AS x FROM lineitem)
SELECT doc, CAST(dense_rank() OVER (PARTITION BY doc ORDER BY third) - 1 AS BIGINT) AS line, text FROM (
  SELECT doc, floor((n - 1) / 3) AS third, string_agg('w' || n, ' ' ORDER BY x) AS text FROM b GROUP BY ALL)""")
def line_grouping(spark, sf):
    """EXT-17: an order's items as words on a page, three on a line."""
    n = F.col("l_linenumber")
    boxes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), (100.0 - n).cast("double").alias("x"), (F.floor((n - 1) / 3) * 40 + n % 2).cast("double").alias("y"), F.lit(10.0).alias("height"), F.concat(F.lit("w"), n.cast("string")).alias("text"))
    return documents.group_lines(boxes).select("doc", F.col("line").cast("long").alias("line"), "text")


@query("""SELECT p_partkey AS id, k AS kind, code, value, bound FROM (
  SELECT p_partkey, 'catalog' AS k, '0854' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS code, p_size AS value, false AS bound FROM part WHERE p_partkey % 5 > 1
  UNION ALL SELECT p_partkey, 'quota', '0854' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0'), p_size // 2, true FROM part WHERE p_partkey % 5 > 1
  UNION ALL SELECT p_partkey, 'failed', NULL, NULL, NULL FROM part WHERE p_partkey % 5 = 1)""")
def routing(spark, sf):
    """UDF-01, FLT-10, EXT-02..07, EXT-12: each part as a document with a table; some have no extractor, some an extractor that fails."""
    registry = documents.Registry()
    registry.register(documents.Extractor("plans", F.col("kind") > 1, documents.plan_table))
    registry.register(documents.Extractor("broken", F.col("kind") == 1, lambda rows: [][1]))
    size = F.col("p_size").cast("string")
    code = F.concat(F.lit("0854"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))
    rows = F.array(F.array(F.lit("专业 代码"), F.lit("拟招生人数"), F.lit("推免人数")), F.array(code, size, F.concat(F.lit("≤"), F.floor(F.col("p_size") / 2).cast("string"))))
    docs = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc"), (F.col("p_partkey") % 5).alias("kind"), F.lit(2026).alias("year"), rows.alias("rows"))
    found = registry.run(docs)
    return found.select(F.col("doc").cast("long").alias("id"), "kind", "code", "value", F.col("is_upper_bound").alias("bound"))


@query("""SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')) AS title, CAST(0 AS BIGINT) AS tables,
  len(list_distinct(list_filter(regexp_extract_all(html, '<[a-z][^>]*?\\shref\\s*=\\s*["'']([^"''>]+)', 1, 'i') || regexp_extract_all(html, '<[a-z][^>]*?\\ssrc\\s*=\\s*["'']([^"''>]+)', 1, 'i'), lambda x: NOT regexp_matches(x, '^(data:|javascript:|mailto:|#)')))) AS files FROM pages""")
def page_documents(spark, sf):
    """SRC-05, SRC-18."""
    p = table(spark, sf, "pages").select("page_id", html.linked_files(F.col("html")).alias("files"), "html")
    return html.page_documents(p).select("page_id", "title", F.size("tables").cast("long").alias("tables"), F.size("files").cast("long").alias("files"))


@query("""SELECT p_partkey AS id, scope, '085404' AS code, total, first FROM (
  SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'college' WHEN 1 THEN 'special_veteran' ELSE 'special_minority' END AS scope, p_size + 300 AS total, 50 AS first FROM part WHERE p_partkey % 4 > 0
  UNION ALL SELECT p_partkey, unnest(['rules_total', 'tm', 'public_exam']), unnest([p_size + 300, 2, p_size]), NULL FROM part WHERE p_partkey % 4 = 0)""")
def retest_lines(spark, sf):
    """EXT-11: lines under two header rows with special scopes, and the triple of plan numbers."""
    k, total = F.col("p_partkey"), (F.col("p_size") + 300).cast("string")
    remark = F.when(k % 3 == 1, "退役士兵计划").when(k % 3 == 2, "少干计划").otherwise("")
    cells = lambda *x: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in x])
    lines = F.array(cells("专业代码", "复试分数线", "复试分数线", "复试分数线", "备注"), cells("专业代码", "总分", "政治", "业务课一", ""), cells("085404", total, "50", "60", remark))
    plans = F.array(cells("代码", "总计划", "已招推免", "公开招考", "备注"), cells("085404", total, "2", F.col("p_size").cast("string"), ""))
    docs = table(spark, sf, "part").select(k.cast("string").alias("doc"), F.lit(2026).alias("year"), F.when(k % 4 > 0, lines).otherwise(plans).alias("rows"))
    found = documents.Registry([documents.Extractor("lines", F.lit(True), documents.line_table)]).run(docs)
    return found.select(F.col("doc").cast("long").alias("id"), F.col("kind").alias("scope"), "code", F.col("value").alias("total"), F.col("lines")[0].alias("first"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 3 = o_custkey % 3 AS codes_ok, o_orderstatus = 'F' AS year_ok, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 2 = 0 END AS metrics_ok FROM orders)
SELECT id, codes_ok, year_ok, metrics_ok, codes_ok AND year_ok AND coalesce(metrics_ok, true) AS exact FROM r""")
def intent_scores(spark, sf):
    """EVL-01."""
    key, none = F.col("o_orderkey"), F.array().cast("array<string>")
    code = lambda c: F.array((c % 3).cast("string"))
    metrics = F.when(key % 5 > 0, F.array(F.lit("lines"))).otherwise(none)
    expected = F.struct(none.alias("schools"), code(key).alias("codes"), F.lit(2026).alias("year"), F.lit("lookup").alias("operation"), metrics.alias("metrics"), F.lit(False).alias("privacy"))
    year = F.when(F.col("o_orderstatus") == "F", 2026)
    predicted = F.struct(none.alias("schools"), none.alias("codes"), code(F.col("o_custkey")).alias("prefixes"), year.alias("year"), F.lit("lookup").alias("operation"), F.when(key % 2 == 0, F.array(F.lit("plans"), F.lit("lines"))).otherwise(F.array(F.lit("plans"))).alias("metrics"), F.lit(None).cast("boolean").alias("privacy"))
    rows = table(spark, sf, "orders").select(key.alias("id"), expected.alias("expected"), predicted.alias("predicted"))
    return evaluate.intent_scores(rows).select("id", "codes_ok", "year_ok", "metrics_ok", "exact")


@query("""SELECT source, count(*) FILTER (WHERE s) AS rows, count(*) FILTER (WHERE NOT s) AS unscorable, count(*) FILTER (WHERE s AND a) AS passed, coalesce(sum(n) FILTER (WHERE s), 0)::BIGINT AS facts, coalesce(sum(f) FILTER (WHERE s), 0)::BIGINT AS found, coalesce(sum(r) FILTER (WHERE s), 0)::BIGINT AS sources
FROM (SELECT l_orderkey % 7 AS source, l_orderkey, count(*) AS n, bool_and(l_quantity > 5) AS a, count(*) FILTER (WHERE l_quantity > 5) AS f, count(*) FILTER (WHERE l_quantity > 5 AND l_partkey % 2 = 0) AS r, l_orderkey % 11 > 0 AS s FROM lineitem GROUP BY l_orderkey) GROUP BY source""")
def fact_recall(spark, sf):
    """EVL-01: an order's items as its expected facts."""
    checks = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 7).alias("source"), F.col("l_orderkey").alias("row"), (F.col("l_quantity") > 5).alias("found"), (F.col("l_partkey") % 2 == 0).alias("source_matches"), (F.col("l_orderkey") % 11 > 0).alias("scorable"))
    return evaluate.recall_summary(checks, "source")


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, row_number() OVER (PARTITION BY page_id % 9 ORDER BY page_id) AS n FROM pages)
SELECT page_id, CAST(3.0 * (row_number() OVER (PARTITION BY host ORDER BY page_id) - 1) AS DOUBLE) AS earliest FROM u WHERE n <= 20""")
def request_schedule(spark, sf):
    """STM-04."""
    urls = table(spark, sf, "pages").select((F.col("page_id") % 9).alias("school"), "url", F.col("page_id").alias("position"))
    return crawl.schedule(urls, 3.0, 20).select(F.col("position").alias("page_id"), "earliest")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'e' || page_id END AS etag, CASE WHEN page_id % 2 = 0 AND page_id % 5 > 0 THEN 'm' || page_id END AS modified FROM pages""")
def conditional_headers(spark, sf):
    """STM-05: validators of earlier answers, and the headers that they give."""
    key = F.col("page_id").cast("string")
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("u"), key).alias("url"))
    old = p.select("url", F.lit("old").alias("etag"), F.lit(None).cast("string").alias("last_modified")).where("page_id % 6 = 0")
    answers = p.select("url", F.lit(1).alias("at"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("e"), key)).alias("etag"), F.when((F.col("page_id") % 2 == 0) & (F.col("page_id") % 5 > 0), F.concat(F.lit("m"), key)).otherwise("").alias("last_modified"))
    found = crawl.conditional_requests(p, crawl.newest_validators(old, answers))
    return found.select("page_id", F.try_element_at("headers", F.lit("If-None-Match")).alias("etag"), F.try_element_at("headers", F.lit("If-Modified-Since")).alias("modified"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN NOT (contains(url, '/en/') OR contains(url, '/de/7')) WHEN 1 THEN true ELSE false END AS allowed
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '^$', '/') AS url FROM pages)""")
def robots_rules(spark, sf):
    """STM-06: origins whose file allows some, is missing, fails, or was not fetched."""
    k = F.col("page_id") % 4
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/?#]*", ""), "^$", "/")
    urls = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://H"), k.cast("string"), F.lit(".org"), path).alias("url"))
    body = "User-agent: *\nDisallow: /en/\nDisallow: /de/7\n\nUser-agent: other\nDisallow: /"
    robots = spark.createDataFrame([("https://h0.org", 200, body), ("https://h1.org", 404, None), ("https://h2.org", 503, None)], "origin string, status int, body string")
    return crawl.robots_allowed(urls, robots, "loom").select("page_id", "allowed")


@query("""WITH s AS (SELECT user_id AS job, event_id AS moment, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events)
SELECT job, CASE WHEN m = 1 THEN 'queued' WHEN m = 2 THEN 'running' WHEN job % 2 = 0 THEN 'done' ELSE 'error' END AS state, greatest(m - 3, 0) AS refused FROM s WHERE n = 1""")
def job_states(spark, sf):
    """STM-11: a user's first three events as queued, running and the end; later ones are steps that follow from nothing."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), n.alias("n"))
    end = F.when(F.col("job") % 2 == 0, "done").otherwise("error")
    found = crawl.job_states(e.select("job", "at", F.when(F.col("n") == 1, "queued").when(F.col("n") == 2, "running").otherwise(end).alias("state")))
    return found.select("job", "state", F.col("refused").cast("long").alias("refused"))


@query("SELECT DISTINCT md5(text) AS sha256 FROM documents WHERE text IS NOT NULL EXCEPT SELECT md5(text) FROM documents WHERE doc_id % 3 = 0")
def cache_misses(spark, sf):
    """SNK-12."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.lit("x").alias("backend"), F.md5("text").alias("sha256"))
    return model.cache_misses(d.select("backend", "sha256"), d.where("doc_id % 3 = 0")).select("sha256")


@query("""SELECT o_orderkey AS id, CAST(o_custkey AS INTEGER) AS value, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'evidence not in document' WHEN 2 THEN 'value not in evidence' ELSE 'unknown kind' END AS dropped FROM orders""")
def model_facts(spark, sf):
    """UDF-07, JSN-01, EXT-15: an answer that quotes its document, or does not."""

    def answer(text: str) -> str:
        key, value = (int(x) for x in text.split(":")[0].split(" "))
        evidence = {0: f"拟招{value}人", 1: f"实招{value}人", 2: "含推免"}.get(key % 4, f"拟招{value}人")
        return 'Here: [x] [{"table": "plans", "kind": "%s", "program_code": "085404", "value": %d, "evidence": "%s"}] done' % ("tm" if key % 4 < 3 else "other", value, evidence)

    o = table(spark, sf, "orders")
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_custkey").cast("string"), F.lit(": 本专业 拟招 "), F.col("o_custkey").cast("string"), F.lit(" 人，含推免。"))
    return model.model_facts(o.select(F.col("o_orderkey").alias("id"), text.alias("text")), answer).select("id", "value", "dropped")


@query("""WITH t AS (SELECT * FROM (VALUES ('a', 0, '{name} 招多少人？', 'lookup', 'dev'), ('b', 1, '比较 {name}', 'compare', 'test')) v(template, g, text, operation, split))
SELECT template || '-' || CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 7 = 1 THEN '改写' ELSE replace(text, '{name}', s_name) END AS question, operation, split, s_suppkey % 7 = 1 AS reviewed
FROM supplier JOIN t ON s_suppkey % 2 = g WHERE s_suppkey % 7 <> 2""")
def gold_rows(spark, sf):
    """EVL-03."""
    templates = spark.createDataFrame([("a", 0, "{name} 招多少人？", "lookup", "dev"), ("b", 1, "比较 {name}", "compare", "test")], "template string, group int, text string, operation string, split string")
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") % 2).cast("int").alias("group"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(1).alias("value"))
    named = F.concat(F.when(F.col("group") == 0, "a").otherwise("b"), F.lit("-"), F.col("id").cast("string"))
    reviews = s.where("id % 7 IN (1, 2)").select(named.alias("id"), F.when(F.col("id") % 7 == 1, "改写").alias("text"), F.when(F.col("id") % 7 == 1, "edit").otherwise("drop").alias("verdict"))
    return model.gold_rows(templates, s, reviews).select("id", "question", "operation", "split", "reviewed")


@query("""SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'failed' WHEN page_id % 4 = 0 THEN 'needs_ocr' WHEN page_id % 3 = 0 THEN 'empty' WHEN page_id % 2 = 0 THEN 'redacted' ELSE 'indexed' END AS status,
  page_id % 11 = 0 OR page_id % 7 > 0 AS listed FROM pages""")
def ingest_report(spark, sf):
    """DOC-03."""
    k = F.col("page_id")
    p = table(spark, sf, "pages").select("page_id", k.cast("string").alias("path"))
    loaded = p.select("path", F.when((k % 3 > 0) & (k % 4 > 0), 2).otherwise(0).alias("chunks"), (k % 2 == 0).alias("redacted"), (k % 4 == 0).alias("needs_ocr"), F.when(k % 5 == 0, "x").alias("error"))
    listed = p.where("page_id % 11 = 0 OR page_id % 7 > 0").select("path", F.lit("d").alias("doc"))
    return documents.ingest_report(p.where("page_id % 11 > 0").select("path"), listed, loaded).select(F.col("path").cast("long").alias("page_id"), "status", "listed")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '085404' END AS code, CASE WHEN p_partkey % 2 = 0 THEN 2026 END AS year, p_partkey % 4 = 0 AS lines, p_partkey % 5 = 0 AS private,
  CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 END AS least, CASE WHEN p_partkey % 6 = 1 THEN true WHEN p_partkey % 6 = 2 THEN false END AS is_408 FROM part""")
def intent_parse(spark, sf):
    """FLT-12: questions put together from clauses."""
    k, some = F.col("p_partkey"), lambda condition, text: F.when(condition, text).otherwise("")
    text = F.concat(F.lit("请问"), some(k % 2 == 0, "2026年"), some(k % 3 == 0, " 085404 "), some(k % 4 == 0, "复试线"), some(k % 5 == 0, "、身份证"), some(k % 6 == 1, "考408的"), some(k % 6 == 2, "不考408的"), F.when(k % 7 == 0, F.concat(F.lit("，招生人数超过"), F.col("p_size").cast("string"))).otherwise(""))
    found = table(spark, sf, "part").select(k.alias("id"), agent.intent(text).alias("i"))
    return found.select("id", F.try_element_at("i.codes", F.lit(1)).alias("code"), "i.year", "i.lines", "i.private", "i.least", "i.is_408")
