"""The driver tables seen as facts, once for Spark and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import table

KINDS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
NAMES = ("urgent", "high", "medium", "open_kind", "low")


def programs(spark: SparkSession, sf: str) -> DataFrame:
    """customer → nation → region as program → college → school; the dimensions are small enough for Catalyst to broadcast."""
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.concat(F.lpad((F.col("c_custkey") % 3000).cast("string"), 4, "0"), F.substring("c_mktsegment", 1, 2))
    return joined.select(F.col("c_custkey").alias("program"), code.alias("code"), F.col("c_name").alias("name"), F.col("n_nationkey").cast("string").alias("college_id"), F.col("n_name").alias("college_name"), F.col("r_name").alias("school"), F.col("c_mktsegment").alias("mode"))


SQL_PROGRAMS = """programs AS (
  SELECT c_custkey AS program, lpad(CAST(c_custkey % 3000 AS VARCHAR), 4, '0') || substr(c_mktsegment, 1, 2) AS code, c_name AS name,
         CAST(n_nationkey AS VARCHAR) AS college_id, n_name AS college_name, r_name AS school, c_mktsegment AS mode
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def plans(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as facts of (program, year, kind)."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("program"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("kind"),
        F.floor("o_totalprice").cast("long").alias("value"), (F.col("o_orderkey") % 3 == 0).alias("is_upper_bound"), (F.col("o_orderkey") % 7).alias("source"),
        (F.col("o_orderkey") % 5).alias("method"), (F.col("o_orderstatus") == "F").alias("verified"), F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey") % 4).alias("pool"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("e"), F.col("o_orderkey").cast("string"))).otherwise("").alias("evidence"), (F.col("o_orderkey") % 500).alias("code"), F.col("o_orderstatus").alias("status"),
    )


SQL_PLANS = """plans AS (
  SELECT o_orderkey AS id, o_custkey AS program, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS kind,
         CAST(floor(o_totalprice) AS BIGINT) AS value, o_orderkey % 3 = 0 AS is_upper_bound, o_orderkey % 7 AS source, o_orderkey % 5 AS method,
         o_orderstatus = 'F' AS verified, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 4 END AS pool,
         CASE WHEN o_orderkey % 2 = 0 THEN 'e' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS evidence, o_orderkey % 500 AS code, o_orderstatus AS status
  FROM orders)"""


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("status") == "O", "known").when(F.col("status") == "P", "unknown").otherwise("no_exam")
    return plans(spark, sf).select("id", "program", "year", status.alias("status"), (F.col("id") % 2).alias("source"), (F.col("id") % 4).alias("slot"), F.when(F.col("code") % 5 == 0, 408).otherwise(F.col("code")).alias("code"))


SQL_SUBJECTS = """subjects AS (
  SELECT id, program, year, CASE status WHEN 'O' THEN 'known' WHEN 'P' THEN 'unknown' ELSE 'no_exam' END AS status,
         id % 2 AS source, id % 4 AS slot, CASE WHEN code % 5 = 0 THEN 408 ELSE code END AS code FROM plans)"""
SQL_GROUPS = """subject_sets AS (
  SELECT program, year, status, source, string_agg(CAST(code AS VARCHAR), '/' ORDER BY slot, id) AS codes, min(id) AS first FROM subjects GROUP BY ALL),
subject_once AS (SELECT program, year, status, codes, arg_min(source, first) AS source, min(first) AS first FROM subject_sets GROUP BY program, year, status, codes),
subject_groups AS (
  SELECT program, year, status, codes, source, list_contains(string_split(codes, '/'), '408') AS is_special,
         row_number() OVER (PARTITION BY program ORDER BY year DESC, CASE status WHEN 'known' THEN 1 WHEN 'no_exam' THEN 2 ELSE 3 END, first) AS number
  FROM subject_once)"""
SQL_ESTIMATES = """usable AS (SELECT * FROM plans WHERE pool IS NULL),
pairs AS (
  SELECT c.id, c.program, c.year, c.value AS total, q.value AS part, q.is_upper_bound AS open, c.source = q.source AS same
  FROM usable c JOIN usable q ON c.program = q.program AND c.year = q.year
  WHERE c.kind = '2-HIGH' AND NOT c.is_upper_bound AND q.kind = '3-MEDIUM'),
preferred AS (SELECT *, bool_or(same) OVER (PARTITION BY id) AS any_same FROM pairs),
estimates AS (
  SELECT program, year, value, bound, basis, min(formula) AS formula FROM (
    SELECT program, year, value, CASE WHEN is_upper_bound THEN 'upper' ELSE 'exact' END AS bound, 'explicit' AS basis, CAST(value AS VARCHAR) AS formula
    FROM usable WHERE kind = '1-URGENT'
    UNION ALL
    SELECT program, year, total - part, CASE WHEN open THEN 'lower' ELSE 'exact' END, 'derived',
           CAST(total AS VARCHAR) || ' - ' || CASE WHEN open THEN '≤' ELSE '' END || CAST(part AS VARCHAR)
    FROM preferred WHERE same OR NOT any_same)
  GROUP BY program, year, value, bound, basis)"""
SQL_BASIS = """newest AS (SELECT *, rank() OVER (PARTITION BY program ORDER BY year DESC) AS r FROM estimates),
basis AS (
  SELECT program, year, value, bound, basis, formula FROM (
    SELECT *, bool_or(basis = 'explicit') OVER (PARTITION BY program) AS own FROM newest WHERE r = 1)
  WHERE basis = 'explicit' OR NOT own)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Score lines of programs: lineitems by their order's number."""
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") % 1500).alias("program"), F.year("l_shipdate").alias("year"), F.floor("l_quantity").cast("long").alias("total"))


def baselines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines for each school and discipline."""
    p = table(spark, sf, "part")
    return p.select(F.element_at(F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))), (F.col("p_partkey") % 5 + 1).cast("int")).alias("school"), F.lpad((F.col("p_partkey") % 30).cast("string"), 2, "0").alias("discipline"), F.lit(2024).alias("year"), F.col("p_size").cast("long").alias("total")).distinct()


SQL_LINES = """lines AS (
  SELECT l_orderkey % 1500 AS program, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(floor(l_quantity) AS BIGINT) AS total FROM lineitem),
baselines AS (
  SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE' ELSE 'MIDDLE EAST' END AS school,
         lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0') AS discipline, 2024 AS year, CAST(p_size AS BIGINT) AS total
  FROM part),
scoped AS (
  SELECT program, year, total, 'college' AS scope FROM lines
  UNION ALL
  SELECT p.program, b.year, b.total, 'baseline' FROM programs p JOIN baselines b
    ON p.school = b.school AND b.discipline = CASE WHEN substr(p.code, 3, 1) = '5' THEN substr(p.code, 1, 4) ELSE substr(p.code, 1, 2) END
  WHERE NOT EXISTS (SELECT 1 FROM subjects s WHERE s.program = p.program AND s.status = 'no_exam'))"""


def documents_of_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as the documents of facts."""
    p = table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("id"), F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"), F.when(F.col("page_id") != 1, F.col("url")).alias("page_url"), F.concat(F.lit("a/"), F.col("page_id").cast("string")).alias("attachment_url"))


SQL_DOCUMENTS = """docs AS (
  SELECT page_id AS id, 't' || CAST(page_id AS VARCHAR) AS title, CASE WHEN page_id <> 1 THEN url END AS page_url, 'a/' || CAST(page_id AS VARCHAR) AS attachment_url
  FROM pages)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
