"""Incremental collection as operators on tables of fetched pages: entries of lists, paging, probes, alerts, the run ledger (FLT-13, FLT-16,
SRC-14, STM-02, STM-04..11, STM-13, DAT-04). Fetching itself is the caller's."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Titles that say nothing, words of a link to the next page, and titles that announce a year's catalogue.
GENERIC_TITLES = ("查看", "详细", "详情", "更多", "more", "下载", "阅读全文", "点击查看")
NEXT_WORDS = ("下一页", "下页", "next", "next page", ">", "»")
NEW_YEAR = r"(20\d{2})年.{0,20}?(专业目录|招生简章)"


def is_article(url: Column, key: Column, accept: Sequence[str], skip: Sequence[str] = ()) -> Column:
    """FLT-13: an accepting pattern fits the URL as it is or its normal form, and no skipping one does."""
    fits = F.lit(False)
    for pattern in accept:
        fits = fits | url.rlike(pattern) | key.rlike(pattern)
    for pattern in skip:
        fits = fits & ~url.rlike(pattern)
    return F.coalesce(fits, F.lit(False))


def canonical_path(path: Column) -> Column:
    """Without empty parts and ``.``, and each ``..`` taken off with the part before it."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def is_within(path: Column, root: Column) -> Column:
    """FLT-16: the path is the root or lies under it."""
    own, top = canonical_path(path), canonical_path(root)
    return (own == top) | (top == "/") | own.startswith(F.concat(top, F.lit("/")))


def personal_files(files: DataFrame, documents: DataFrame, root: str) -> DataFrame:
    """FLT-16: the files that a document with personal data is kept in; ``local_path`` is relative to ``root``."""
    known = documents.where("contains_personal_data AND local_path IS NOT NULL AND local_path <> ''").select(canonical_path(F.concat(F.lit(root + "/"), "local_path")).alias("_path")).distinct()
    return files.withColumn("_path", canonical_path(F.col("path"))).join(known, "_path", "left_semi").drop("_path")


def by_local_path(entries: DataFrame) -> DataFrame:
    """SRC-14: entries that have a file, the last one of each path."""
    own = entries.where("local_path IS NOT NULL AND local_path <> ''")
    return own.groupBy("local_path").agg(F.max_by(F.struct(*[c for c in own.columns if c != "local_path"]), "position").alias("_e")).select("local_path", "_e.*")


def list_entries(links: DataFrame, generic: Sequence[str] = GENERIC_TITLES) -> DataFrame:
    """STM-07: one entry for each article key of a list. ``links``: source, position, key, url, attribute (the title attribute), inner (an
    inner title's text), text (the link's text), day. A title's quality is 2, 1 or 0 in that order; the best (quality, length), first of equals, is
    the entry's; its day, where it has none, is that of the last link before it that was the best so far."""
    low = lambda c: F.lower(F.trim(F.col(c)))
    some = lambda c: (F.coalesce(low(c), F.lit("")) != "") & ~low(c).isin(*generic)
    title = F.when(some("attribute"), F.trim("attribute")).when(F.coalesce(F.trim("inner"), F.lit("")) != "", F.trim("inner")).when(some("text"), F.trim("text"))
    quality = F.when(some("attribute"), 2).when(F.coalesce(F.trim("inner"), F.lit("")) != "", 1).otherwise(0)
    rows = links.select("source", "position", "key", "url", "day", title.alias("title"), quality.alias("quality")).where("title IS NOT NULL")
    rank = F.struct("quality", F.length("title").alias("n"))
    so_far = Window.partitionBy("source", "key").orderBy("position")
    best = F.max(rank).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    leads = rows.withColumn("_lead", best.isNull() | (rank > best)).where("_lead")  # each was the entry for a while
    days = leads.withColumn("day", F.last("day", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return days.groupBy("source", "key").agg(F.max_by(F.struct("url", "title", "day", "quality"), "position").alias("_e"), F.min("position").alias("position")).select("source", "key", "_e.*", "position")


def page_urls(sources: DataFrame, depth: int) -> DataFrame:
    """STM-08: pages 1 to ``depth`` of each list (source, url, template with {n} or {n0}): the first is the list's own URL."""
    numbered = sources.select("source", "url", "template", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("page"))
    made = F.replace(F.replace("template", F.lit("{n}"), F.col("page").cast("string")), F.lit("{n0}"), (F.col("page") - 1).cast("string"))
    return numbered.select("source", "page", F.when(F.col("page") == 1, F.col("url")).otherwise(made).alias("url")).where("url IS NOT NULL")


def next_page(links: DataFrame, words: Sequence[str] = NEXT_WORDS) -> DataFrame:
    """STM-08: the page that the first link called "next" leads to, if it is another one."""
    own = links.where(F.lower(F.trim("text")).isin(*words) & ~F.col("href").rlike(r"^(?:javascript:|#)") & (F.col("href") != ""))
    first = own.groupBy("source").agg(F.min_by("href", "position").alias("next"))
    return first.where("next <> source")


def pages_until_empty(pages: DataFrame) -> DataFrame:
    """STM-08: a list's pages (source, page, ok, entries) up to the first that failed or has no entry."""
    stop = pages.where("NOT ok OR entries = 0").groupBy("source").agg(F.min("page").alias("_stop"))
    return pages.join(stop, "source", "left").where(F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))).drop("_stop")


def probe_ids(known: DataFrame, fetched: DataFrame, misses: int = 2) -> DataFrame:
    """STM-09: articles with ids above a school's highest known one, up to ``misses`` gone in a row or the first failure. ``known``:
    school, id; ``fetched``: school, id, status (200, 404, 410, else failed)."""
    top = known.groupBy("school").agg(F.max("id").alias("_top"))
    tried = fetched.join(top, "school").where(F.col("id") > F.col("_top"))
    order = Window.partitionBy("school").orderBy("id")
    gone, failed = F.col("status").isin(404, 410), ~F.col("status").isin(200, 404, 410)
    row = F.sum(gone.cast("int")).over(order.rowsBetween(-(misses - 1), Window.currentRow))
    ended = F.max(((row >= misses) | failed).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = tried.withColumn("_row", row).withColumn("_ended", F.coalesce(ended, F.lit(0))).where("_ended = 0")
    return seen.where("status = 200").select("school", "id")


def title_alerts(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """STM-10: fresh titles (title, url) that announce a catalogue or a brochure of a year after the latest known one (doc_type, year) of that type;
    titles on recommended students are none."""
    year, word = F.regexp_extract("title", NEW_YEAR, 1), F.regexp_extract("title", NEW_YEAR, 2)
    rows = fresh.where((year != "") & ~F.col("title").contains("推免")).select("title", "url", year.cast("int").alias("year"), F.when(word == "专业目录", "catalog").otherwise("brochure").alias("doc_type"))
    latest = known.where(F.col("doc_type").isin("catalog", "brochure")).groupBy("doc_type").agg(F.max("year").alias("latest_known"))  # two rows
    joined = rows.join(F.broadcast(latest), "doc_type", "left").where(F.col("latest_known").isNull() | (F.col("year") > F.col("latest_known")))
    return joined.select(F.concat(F.lit("new_"), "doc_type").alias("kind"), "title", "url", "year", "latest_known")


def fetch_outcome(status: Column, digest: Column, before: Column) -> Column:
    """STM-02: what a conditional fetch says of a page: unchanged (304, or the digest before), changed, new, removed, login or failed."""
    return F.when(status == 304, "unchanged").when(status.isin(404, 410), "removed").when(status.isin(401, 403), "login").when(status != 200, "failed").when(before.isNull(), "new").when(before == digest, "unchanged").otherwise("changed")


def run_ledger(entries: DataFrame) -> DataFrame:
    """STM-13: runs as their latest entry says (run, at, status, stats as JSON), with the numbers in it."""
    last = entries.groupBy("run").agg(F.min("at").alias("started"), F.max_by(F.struct("status", "stats", "at"), "at").alias("_e"))
    stats = F.from_json("_e.stats", "requests int, found int, registered int, schools string")
    ended = F.when(F.col("_e.status").isin("done", "error"), F.col("_e.at"))
    return last.select("run", "started", ended.alias("ended"), F.col("_e.status").alias("status"), stats["requests"].alias("requests"), stats["found"].alias("found"), stats["registered"].alias("registered"), F.filter(F.split(stats["schools"], ","), lambda x: x != "").alias("schools"))


def iso_stamp(time: Column) -> Column:
    """DAT-04: a time as the text of its UTC second."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def schedule(urls: DataFrame, interval: float, budget: int | None = None) -> DataFrame:
    """STM-04: when each request (school, url, position) may start at the earliest, in seconds from the run's start: a host's requests one after
    the other, ``interval`` apart; of a school no more than the budget."""
    rows = urls
    if budget is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("school").orderBy("position"))).where(F.col("_n") <= budget).drop("_n")
    place = F.row_number().over(Window.partitionBy(F.regexp_extract(origin_of(F.col("url")), "://(.*)", 1)).orderBy("position")) - 1
    return rows.withColumn("earliest", place * F.lit(float(interval)))


def conditional_requests(urls: DataFrame, validators: DataFrame) -> DataFrame:
    """STM-05: URLs with the headers of a conditional request, as far as an earlier answer (url, etag, last_modified) gave them."""
    some = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.lit(name).alias("key"), F.col(c).alias("value")))
    headers = F.map_from_entries(F.array_compact(F.array(some("If-None-Match", "etag"), some("If-Modified-Since", "last_modified"))))
    return urls.join(validators, "url", "left").select(*urls.columns, headers.alias("headers"))


def newest_validators(validators: DataFrame, answers: DataFrame) -> DataFrame:
    """STM-05: validators after a run: an answer (url, at, etag, last_modified) that has any replaces the earlier ones whole; others leave them."""
    given = answers.where("coalesce(etag, '') <> '' OR coalesce(last_modified, '') <> ''").select("url", "at", "etag", "last_modified")
    both = given.unionByName(validators.select("url", F.lit(None).cast(given.schema["at"].dataType).alias("at"), "etag", "last_modified"))
    last = both.groupBy("url").agg(F.max_by(F.struct("etag", "last_modified"), F.struct(F.col("at").isNotNull(), "at")).alias("_v"))
    return last.select("url", "_v.*")


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """STM-06: whether each URL may be fetched by its origin's robots file (origin, status, body): a file that there is counts as it says, answers 400 to 499
    allow all, others (and files not fetched) nothing. One small row an origin is joined to its URLs."""

    def judge(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}
        out = []
        for text, url in zip(texts, wanted, strict=True):
            if text not in parsers:
                parsers[text] = RobotFileParser()
                parsers[text].parse(text.splitlines())
            out.append(parsers[text].can_fetch(agent, url))
        return pd.Series(out)

    joined = urls.withColumn("_o", origin_of(F.col("url"))).join(robots.select(F.lower("origin").alias("_o"), "status", "body"), "_o", "left")
    says = F.pandas_udf(judge, "boolean")(F.coalesce("body", F.lit("")), F.col("url"))
    allowed = F.when(F.col("status") == 200, says).otherwise(F.coalesce(F.col("status").between(400, 499), F.lit(False)))
    return joined.select(*urls.columns, allowed.alias("allowed"))


JOB_STEPS = {"queued": ("running", "error"), "running": ("done", "error"), "done": (), "error": ()}


def job_states(events: DataFrame) -> DataFrame:
    """STM-11: jobs as their events (job, at, state) leave them: the first is ``queued``, and a step that does not follow from the state before is left out and counted."""
    following = F.create_map(*[x for state, after in JOB_STEPS.items() for x in (F.lit(state), F.array(*map(F.lit, after)).cast("array<string>"))])
    steps = F.array_sort(F.collect_list(F.struct("at", "state")))
    ordered = events.groupBy("job").agg(steps.alias("steps"))  # a job has a handful
    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).alias("refused"))

    def step(now: Column, e: Column) -> Column:
        fits = F.when(now["state"].isNull(), e["state"] == "queued").otherwise(F.array_contains(F.try_element_at(following, now["state"]), e["state"]))
        fits = F.coalesce(fits, F.lit(False))
        return F.struct(F.when(fits, e["state"]).otherwise(now["state"]).alias("state"), (now["refused"] + F.when(fits, 0).otherwise(1)).alias("refused"))

    return ordered.select("job", F.aggregate("steps", start, step).alias("_s")).select("job", "_s.state", "_s.refused")
