"""Operator 13: how the sources of a language diverge in their words.

1. Tasks read whole texts as bytes, a slice at a time: letters are lower-cased and all else made blank by one table, words get integer ids from
   the slice's dictionary, and counts and documents for each (group, word) come from bincounts of ids. A task adds slices up before it sends
   rows; these are summed once more before the shuffle.
2. Rows are laid out by range over (language, term), so the terms of a task ascend in UTF-8 order. A chunk is the next ``CHUNK`` or so terms with
   enough documents: a sorted array of kept terms. The chunk's rows get their ids by searchsorted, and a bincount for each source makes its
   dense vector. A chunk is one row.
3. Sums over chunks give each group's N and each language's V. They meet the chunks by language and a salt, so a hot language is spread.
4. From a chunk's dense vectors come its part of every pair's value and its ten best terms for each source; ids break ties. Parts are
   summed, lists merged.

No dictionary is broadcast, and no source's or language's words meet in one task. All arithmetic is in whole numbers.

Defined results: a null text, lang or source is ''; every row is a document, also one that repeats; a language without kept terms has pairs
of value 0 and no terms; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, slices

#: Documents of its language that a kept term occurs in; terms listed for each group.
LEAST, TOP = 10, 10
#: Kept terms of a chunk at most, and cells (terms x sources).
CHUNK, CELLS = 4096, 1 << 20
#: Rows that a task adds up before it sends them.
HELD = 400_000
UNIT = 1_000_000_000
_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
BLANKED = bytes(i + 32 if 0x41 <= i < 0x5B else i if i in _LETTERS else 32 for i in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in a row, and the text that each is of."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = (data.to_pybytes()[ends[0] : ends[-1]] if data else b"").translate(BLANKED)
    blank = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(raw)])
    parts = pc.ascii_split_whitespace(blank)
    words, of = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    real = pc.not_equal(words, "")
    return words.filter(real), of[real.to_numpy(zero_copy_only=False)]


def count_slice(part: pa.RecordBatch) -> pa.Table:
    """Counts and documents of each (lang, source, term) in some rows; a row without a term for each group that occurs."""
    lang, source = part["lang"].dictionary_encode(), part["source"].dictionary_encode()
    n_sources = max(1, len(source.dictionary))
    groups, of_row = np.unique(lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy(), return_inverse=True)
    langs, sources = lang.dictionary.take(pa.array(groups // n_sources)), source.dictionary.take(pa.array(groups % n_sources))
    words, of = words_of(part["text"])
    coded = words.dictionary_encode()
    ids, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    n = max(1, len(terms))
    pairs, counts = np.unique(of * n + ids, return_counts=True)  # (document, term)
    cells, where = np.unique(of_row[pairs // n] * n + pairs % n, return_inverse=True)
    total, docs = np.bincount(where, counts, len(cells)).astype(np.int64), np.bincount(where, minlength=len(cells))
    names, group = ["lang", "source", "term", "n", "docs"], pa.array(cells // n)
    found = pa.table([langs.take(group), sources.take(group), terms.take(pa.array(cells % n)).cast(pa.string()), pa.array(total), pa.array(docs)], names=names)
    zero = pa.array(np.zeros(len(groups), np.int64))
    return pa.concat_tables([found, pa.table([langs, sources, pa.nulls(len(groups), pa.string()), zero, zero], names=names)])


def added(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    out = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])


def count_terms(docs: DataFrame) -> DataFrame:
    """Written rows (lang, source, term, n, docs), one for each that occurs, and one with a null term for each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in slices(batch):
                held.append(count_slice(part))
                if sum(t.num_rows for t in held) > HELD:
                    held = [added(held)]
                    if held[0].num_rows > HELD // 2:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from added(held).to_batches()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text")).mapInArrow(count, COUNTED)
    return materialize(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counted")


CHUNKED = "lang string, number long, terms array<string>, sources array<string>, counts binary"


def chunks_of(counted: DataFrame, least: int, chunk: int, cells: int) -> DataFrame:
    """Written chunks: a language's next kept terms in order, the sources that have any of them, and a dense count for each source and term."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def chunked(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
            """Chunks of whole terms; the rows of what may go on."""
            rows = rows.combine_chunks()
            lang, term = rows["lang"].combine_chunks(), rows["term"].combine_chunks()
            n = rows.num_rows
            new = np.ones(n, bool)
            new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False) if n > 1 else True
            starts = np.flatnonzero(new)
            docs = np.add.reduceat(rows["docs"].to_numpy(), starts)
            kept = docs >= least
            if not last:
                kept[-1] = False  # its rows may go on
            until = n if last else starts[-1]
            rest = None if last else rows.slice(until)
            out = []
            keep_rows = np.repeat(kept, np.diff([*starts, n]))
            own = rows.slice(0, until).filter(pa.array(keep_rows[:until]))
            if own.num_rows:
                langs = own["lang"].combine_chunks().dictionary_encode()
                bounds = np.flatnonzero(np.diff(langs.indices.to_numpy())) + 1
                for a, b in zip([0, *bounds], [*bounds, own.num_rows], strict=True):
                    out += encoded(own.slice(a, b - a).combine_chunks())
            return out, rest

        def encoded(rows: pa.Table) -> list[pa.RecordBatch]:
            """Chunks of one language: ids of sorted kept terms, and bincounts."""
            terms = np.array([t.encode() for t in pc.unique(rows["term"]).to_pylist()], object)  # ascending as the rows are
            coded = rows["source"].combine_chunks().dictionary_encode()
            of = coded.indices.to_numpy()
            ids = np.searchsorted(terms, np.array([t.encode() for t in rows["term"].to_pylist()], object))
            counts = rows["n"].to_numpy()
            step = max(1, min(chunk, cells // max(1, len(coded.dictionary))))
            made = []
            for first in range(0, len(terms), step):
                part = terms[first : first + step]
                a, b = np.searchsorted(ids, [first, first + len(part)])
                used, local = np.unique(of[a:b], return_inverse=True)
                dense = np.zeros(len(used) * len(part), np.int64)
                np.add.at(dense, local * len(part) + ids[a:b] - first, counts[a:b])
                made.append(((rows["lang"][0].as_py(), [t.decode() for t in part], coded.dictionary.take(pa.array(used)).to_pylist(), dense.tobytes())))
            return [pa.RecordBatch.from_arrays([pa.array([m[0]]), pa.array([0], pa.int64()), pa.array([m[1]], pa.list_(pa.string())), pa.array([m[2]], pa.list_(pa.string())), pa.array([m[3]], pa.binary())], names=["lang", "number", "terms", "sources", "counts"]) for m in made]

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += batch.num_rows
            if size > HELD:
                out, rest = chunked(pa.concat_tables(held), False)
                yield from out
                held, size = [rest], rest.num_rows
        if size:
            yield from chunked(pa.concat_tables(held), True)[0]

    by = ["lang", "term", "source"]
    rows = counted.where("term is not null").repartitionByRange(*by[:2]).sortWithinPartitions(*by)
    chunks = rows.mapInArrow(cut, CHUNKED).withColumn("number", F.monotonically_increasing_id())
    return materialize(chunks, "chunks")


def probabilities(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), by long division in three digits of 1000: exact up to totals of 9 * 10^15."""
    over = total + 2 * terms
    left = counts + 2
    out, left = left // over, left % over
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // over, left % over
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


FOUND = "lang string, source string, part string, item string, value long"


def compare(chunks: DataFrame, top: int) -> DataFrame:
    """From chunks with their language's sums (``groups`` of source and n, ``lang_n``, ``lang_terms``): every pair's part of its value (once, the
    smaller source first), and each source's best terms."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list[str], np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                every = sorted(((g["source"], g["n"]) for g in row["groups"]), key=lambda g: g[0].encode())
                names, at = [s for s, _ in every], {s: i for i, (s, _) in enumerate(every)}
                counts = np.zeros((len(every), len(row["terms"])), np.int64)
                counts[[at[s] for s in row["sources"]]] = np.frombuffer(row["counts"], np.int64).reshape(len(row["sources"]), -1)
                p = np.stack([probabilities(own, n, row["lang_terms"]) for own, (_, n) in zip(counts, every, strict=True)])
                _, total = sums.setdefault(row["lang"], (names, np.zeros((len(every), len(every)), np.int64)))
                for i in range(len(every) - 1):
                    for j in range(i + 1, len(every), 64):
                        total[i, j : j + 64] += divergence(p[i], p[j : j + 64]).sum(1)
                q = probabilities(counts.sum(0), row["lang_n"], row["lang_terms"])
                best = []
                for i, own in enumerate(p):
                    ids = np.flatnonzero((counts[i] > 0) & (own > q))
                    values = divergence(own[ids], q[ids])
                    for k in np.lexsort((ids, -values))[:top]:
                        best.append((row["lang"], names[i], "term", row["terms"][ids[k]], int(values[k])))
                if best:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*best, strict=True)], names=["lang", "source", "part", "item", "value"])
        for lang, (names, total) in sums.items():
            for i in range(len(names) - 1):
                n = len(names) - 1 - i
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([names[i]] * n), pa.array(["pair"] * n), pa.array(names[i + 1 :]), pa.array(total[i, i + 1 :])], names=["lang", "source", "part", "item", "value"])

    return chunks.mapInArrow(per_task, FOUND)


def divergences(docs: DataFrame, least: int = LEAST, top: int = TOP, chunk: int = CHUNK, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: each source against every other one of its language, and its most telling terms."""
    bounded_batches(docs)
    spark = docs.sparkSession
    counted = count_terms(docs)
    chunks = chunks_of(counted, least, chunk, cells)
    groups = counted.where("term is null").select("lang", "source")

    # What a chunk has of each source, and how many terms: one row for each source and chunk.
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, terms, sources, counts in zip(*(batch[c].to_pylist() for c in ("lang", "terms", "sources", "counts")), strict=True):
                own = np.frombuffer(counts, np.int64).reshape(len(sources), len(terms)).sum(1)
                n = len(sources)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(sources), pa.array(own), pa.array([len(terms)] + [0] * (n - 1))], names=["lang", "source", "n", "terms"])

    per_group = materialize(chunks.mapInArrow(sums, "lang string, source string, n long, terms long").groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")), "sums")
    totals = per_group.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("terms").alias("lang_terms"))
    whole = groups.join(per_group, ["lang", "source"], "left").groupBy("lang").agg(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n"))).alias("groups"))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = totals.join(whole, "lang").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    salted = chunks.withColumn("salt", (F.col("number").bitwiseXOR(F.shiftright("number", 33)) % salts).cast("long"))
    found = materialize(compare(salted.join(known, ["lang", "salt"]), top), "found")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    every = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(every).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= top))


SQL = """
WITH w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{80}-\\x{10FFFF}]+')) AS term
  FROM (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM w GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
u AS (SELECT lang, source, sum(c.n)::BIGINT AS n FROM c JOIN k USING (lang, term) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(u.n, 0) + 2 * v.v) AS p,
         1 + 1000000000 * (k.n + 2) // (v.n + 2 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN u ON u.lang = g.lang AND u.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
