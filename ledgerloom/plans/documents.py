"""Queries on pages, files, sinks and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import model, retrieval, views
from ledgerloom.session import scratch, table
from ledgerloom.sources import content, files, html
from ledgerloom.sources.sinks import VersionedTable
from ledgerloom.streaming import jobs, listing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g') AS t FROM pages),
told AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS t FROM bare)
SELECT page_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS text FROM told""")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.page_text("html").alias("text"))


@query("SELECT page_id, 'a | ' || page_id || chr(10) || 'b | c | ' || page_id AS rows FROM pages")
def table_grids(spark, sf):
    """Rows of tables; the given pages hold none, so one is put into each."""
    cell = F.concat(F.lit("<table><tr><td colspan=2>a</td><td rowspan=2>"), F.col("page_id").cast("string"), F.lit("</td></tr><tr><td>b</td><td>c</td></tr></table>"))
    return table(spark, sf, "pages").select("page_id", F.array_join(html.table_rows(F.concat("html", cell)), "\n").alias("rows"))


@query("""SELECT page_id, list_aggregate(list_distinct(regexp_extract_all(html, '<a\\s[^>]*?href=["'']([^"''>]+)', 1, 'i')), 'count') AS n,
  regexp_extract_all(html, '<a\\s[^>]*?href=["'']([^"''>]+)', 1, 'i')[1] AS first FROM pages""")
def page_links(spark, sf):
    found = html.links(F.col("html"))
    return table(spark, sf, "pages").select("page_id", found.alias("l")).select("page_id", F.size("l").cast("long").alias("n"), F.try_element_at("l", F.lit(1)).alias("first"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS copies FROM documents GROUP BY text")
def exact_dedupe(spark, sf):
    """STM-03, STR-16: by content digest, the first id stays."""
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("""SELECT page_id, page_id IN (SELECT doc_id FROM labels) AS known FROM pages""")
def new_known_split(spark, sf):
    """JON-11."""
    pages, known = table(spark, sf, "pages").select("page_id"), table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"))
    return pages.join(known, "page_id", "left_semi").withColumn("known", F.lit(True)).unionByName(pages.join(known, "page_id", "left_anti").withColumn("known", F.lit(False)))


@query("""WITH m AS (SELECT page_id AS path, md5(url) AS s, page_id % 2 = 0 AS c FROM pages WHERE page_id % 5 > 0), f AS (SELECT page_id AS path, CASE WHEN page_id % 7 = 0 THEN 'x' ELSE md5(url) END AS s FROM pages WHERE page_id % 3 > 0)
SELECT CAST(coalesce(m.path, f.path) AS VARCHAR) AS path, CASE WHEN m.path IS NULL THEN 'unlisted' WHEN f.path IS NULL AND m.c THEN 'missing' WHEN f.path IS NULL THEN 'local_only' WHEN m.s <> f.s THEN 'changed' ELSE 'ok' END AS status FROM m FULL JOIN f ON m.path = f.path""")
def bundle_audit(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("path"), F.md5("url").alias("sha256"))
    manifest = p.where("page_id % 5 > 0").select("path", "sha256", (F.col("page_id") % 2 == 0).alias("committed"))
    there = p.where("page_id % 3 > 0").select("path", F.when(F.col("page_id") % 7 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return files.audit(manifest, there)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 77 AND o_totalprice >= 1000")
def parameterised_scan(spark, sf):
    return files.scan(spark, "SELECT o_orderkey, o_totalprice FROM scanned_orders WHERE o_custkey = :customer AND o_totalprice >= :least", {"scanned_orders": table(spark, sf, "orders")}, customer=77, least=1000)


@query("""SELECT g.n_nationkey, g.n_name, coalesce(CASE WHEN g.n_nationkey % 2 = 0 THEN 'kept' END, 'new') AS rule FROM nation g""")
def site_merge(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return files.merge_config(n.withColumn("rule", F.lit("new")), n.where("n_nationkey % 2 = 0").withColumn("rule", F.lit("kept")), ("n_nationkey",), ("rule",))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'text/plain' END AS mime, CASE WHEN page_id % 2 = 0 THEN url END AS body FROM pages")
def data_uri(spark, sf):
    p = table(spark, sf, "pages")
    uri = html.data_uri(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.encode("url", "UTF-8")), r"\s", ""))).otherwise(F.col("url")))
    return p.select("page_id", uri["mime"].alias("mime"), F.decode(uri["bytes"], "UTF-8").alias("body"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS value FROM customer WHERE NOT (c_custkey % 3 > 0 AND c_custkey % 10 = 1)
UNION ALL SELECT c_custkey + 1000000, 'added' FROM customer WHERE c_custkey % 50 = 0""")
def upsert_roundtrip(spark, sf):
    """SNK-01..04: written, upserted, deleted, inserted, and read back."""
    target, c = VersionedTable(spark, scratch(spark, "table")), table(spark, sf, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.lit("old").alias("value"))
    target.replace(old)
    target.upsert(old.where("id % 3 = 0").withColumn("value", F.lit("new")), ["id"])
    target.delete(old.where("id % 3 > 0 AND id % 10 = 1").select("id"))
    target.insert_new(old.where("id % 50 = 0").select((F.col("id") + 1_000_000).alias("id"), F.lit("added").alias("value")).unionByName(old.where("id % 3 = 0")), ["id"])
    return target.read()


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, sf, make, name, mode="append"):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    stream = jobs.events_stream(spark, sf, _EVENTS, glob="events.parquet")
    return jobs.run_available(make(stream), scratch(spark, name), scratch(spark, f"{name}-state"), mode)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf):
    return _stream(spark, sf, jobs.daily_counts, "daily", "complete")


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedupe(spark, sf):
    """STM-03: state without expiry, so a repeat in any later file is dropped too."""
    return _stream(spark, sf, lambda s: jobs.first_seen(s.select("ts", "user_id", "event_type"), "user_id", "event_type").select("user_id", "event_type"), "dedupe")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS number FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, number""")
def stream_sessions(spark, sf):
    return _stream(spark, sf, jobs.sessions, "sessions", "complete").select("user_id", F.unix_micros("start").alias("start"), "n")


@query("""SELECT DISTINCT 's' || page_id % 3 AS folder, substr(sha256(html), 1, 12) || '_' || 'page_' || page_id % 40 || '.html' AS name, strlen(html) AS bytes FROM pages WHERE html IS NOT NULL""")
def saved_files(spark, sf):
    """SNK-14: pages saved twice as files named by their content, and found again; equal names keep apart what differs."""
    root = scratch(spark, "files")
    rows = table(spark, sf, "pages").select(F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("folder"), F.concat(F.lit("page "), (F.col("page_id") % 40).cast("string"), F.lit(".html")).alias("name"), F.col("html").alias("content"))
    content.save_files(rows, root, folder="folder")
    content.save_files(rows, root, folder="folder")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return there.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


@query("""WITH e AS (SELECT 's' || page_id % 3 AS school, CAST(page_id % 9 AS INTEGER) AS page, page_id, 'k' || page_id % 20 AS key, CAST(length(html) % 2 AS VARCHAR) AS digest FROM pages),
b AS (SELECT *, lag(digest) OVER (PARTITION BY school, key ORDER BY page, page_id) AS before FROM e)
SELECT school, page, key, CAST(page_id AS VARCHAR) AS title, CASE WHEN before IS NULL THEN 'new' WHEN before = digest THEN 'same' ELSE 'changed' END AS status FROM b""")
def incremental_run(spark, sf):
    """STM-01: list pages of three schools, two of each taken a run; every entry against what is known of its key."""
    lists, target, state = scratch(spark, "lists"), scratch(spark, "seen"), scratch(spark, "run")
    p = table(spark, sf, "pages")
    rows = p.select(F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("school"), (F.col("page_id") % 9).cast("int").alias("page"), F.col("page_id").alias("position"), F.concat(F.lit("k"), (F.col("page_id") % 20).cast("string")).alias("key"), F.col("page_id").cast("string").alias("title"), (F.length("html") % 2).cast("string").alias("digest"))
    listing.listed(rows, lists)
    while not listing.dry_run(spark, lists, state, 2).isEmpty():
        listing.run(spark, lists, target, state, 2)
    return spark.read.schema(listing.SEEN).parquet(target).select("school", "page", "key", "title", "status")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE CAST(c_nationkey AS INTEGER) END AS page, c_custkey % 2 = 0 AS old FROM customer""")
def schema_growth(spark, sf):
    """SNK-05: rows from before two columns were added, and rows from after it."""
    target, c = VersionedTable(spark, scratch(spark, "grown")), table(spark, sf, "customer")
    target.replace(c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"), F.lit(True).alias("old")))
    for _ in range(2):
        target.declare("id bigint, name string, page int", {"page": 1})
    target.append(c.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"), F.col("c_nationkey").cast("int").alias("page"), F.lit(False).alias("old")))
    return target.read()


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey AS turn FROM orders")
def numbered_turns(spark, sf):
    """SNK-09: turns numbered on in their order, in three appends, by range partitions."""
    target, o = VersionedTable(spark, scratch(spark, "turns")), table(spark, sf, "orders")
    year = F.year("o_orderdate")
    for part in (year < 1995, year == 1995, year > 1995):
        target.append_numbered(o.where(part).select(F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("turn")), ["day", "turn"])
    return target.read().select("id", "turn")


@query("""SELECT CASE c_custkey % 7 WHEN 0 THEN 'blank' WHEN 1 THEN 'bad' WHEN 2 THEN 'no key' ELSE 'row' END AS kind, count(DISTINCT CASE WHEN c_custkey % 7 > 2 THEN c_custkey % 1000 ELSE c_custkey END) AS n,
  CASE WHEN c_custkey % 7 > 2 THEN sum(last) END AS newest FROM (SELECT *, CASE WHEN c_custkey % 7 > 2 AND row_number() OVER (PARTITION BY c_custkey % 7 > 2, c_custkey % 1000 ORDER BY c_custkey DESC) = 1 THEN c_custkey END AS last FROM customer)
GROUP BY kind, c_custkey % 7 > 2""")
def jsonl_reread(spark, sf):
    """SRC-16: written lines of which some are blank, broken or without a key; of a key the last one stays."""
    path, k = scratch(spark, "lines"), F.col("c_custkey")
    good = F.to_json(F.struct((k % 1000).alias("id"), k.alias("value")))
    line = F.when(k % 7 == 0, "  ").when(k % 7 == 1, F.concat(F.lit('{"id": '), k.cast("string"))).when(k % 7 == 2, F.to_json(F.struct(k.alias("value")))).otherwise(good)
    table(spark, sf, "customer").repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").select(line.alias("value")).write.text(path)
    rows, problems = files.read_lines(spark, path, "id long, value long", "id")
    told = problems.groupBy(F.col("problem").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("newest"))
    return told.unionByName(rows.agg(F.lit("row").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("newest")))


@query("""SELECT c_custkey AS id, 'first' AS value FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT c_custkey, 'second' FROM customer WHERE c_custkey % 4 = 0""")
def insert_new_only(spark, sf):
    """SNK-10: the second write brings only the ids that the first lacks."""
    target, c = VersionedTable(spark, scratch(spark, "inserted")), table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    target.insert_new(c.where("id % 4 > 0").withColumn("value", F.lit("first")), ["id"])
    target.insert_new(c.withColumn("value", F.lit("second")), ["id"])
    return target.read()


@query("""SELECT o_orderkey AS id, o_orderpriority AS method FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '3-MEDIUM')""")
def delete_by_method(spark, sf):
    """SNK-03: facts of some methods go, the others stay."""
    target = VersionedTable(spark, scratch(spark, "deleted"))
    target.replace(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("method")))
    target.delete(method=["1-URGENT", "3-MEDIUM"])
    return target.read()


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'x "' || c_mktsegment || '", y' END AS note FROM customer""")
def csv_scan(spark, sf):
    """SRC-13: written and read as CSV: strings with quotes and commas, trimmed, nulls as empty ones."""
    path, c = scratch(spark, "csv"), table(spark, sf, "customer")
    note = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit('　x "'), "c_mktsegment", F.lit('", y ')))
    c.select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_name", F.lit("\u00a0")).alias("name"), note.alias("note")).write.option("header", True).option("escape", '"').csv(path)
    return files.read_strings(spark, path, escape='"')


@query("""SELECT doc_id || '::c0' AS chunk_id, CAST(doc_id AS DOUBLE) / 2 AS score, CASE WHEN doc_id % 2 = 0 THEN 'bm25' ELSE 'dense' END AS backend, substr(text, 1, 200) AS text, '{"lang":"' || lang || '"' || CASE WHEN doc_id % 3 > 0 THEN ',"source":"' || source || '"' ELSE '' END || '}' AS metadata
FROM documents WHERE length(text) BETWEEN 1 AND 800""")
def hit_rows(spark, sf):
    """RET-06: hits with the beginning of their text and what of the metadata they have."""
    docs = table(spark, sf, "documents").where(F.length("text").between(1, 800))
    chunks = retrieval.chunks(docs, "doc_id", "text", 800, 100).join(docs.select("doc_id", "lang", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source")), "doc_id")
    hits = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("::c0")).alias("chunk_id"), (F.col("doc_id") * 0.5).alias("score"), F.when(F.col("doc_id") % 2 == 0, "bm25").otherwise("dense").alias("backend"))
    return views.hit_rows(hits, chunks, ["lang", "source"])


@query("""SELECT doc_id, sha256(source || lang) AS sha256, upper(source || lang) AS answer FROM documents""")
def cached_answers(spark, sf):
    """SNK-12: the second run finds the first one's answers, and asks for the rest."""
    cache = VersionedTable(spark, scratch(spark, "cache"))
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", "lang").alias("content"))
    model.cached_answers(d.where("doc_id % 2 = 0"), cache, "upper", str.upper)
    return model.cached_answers(d, cache, "upper", str.upper).drop("content")
