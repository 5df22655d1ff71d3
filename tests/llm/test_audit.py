"""The divergence of sources against brute force in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import queries, source_audit

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"
COLUMNS = ("lang", "source", "part", "item", "value", "rank")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least=10):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: c for (g, s), c in groups.items() if g == lang}
        whole = sum(own.values(), Counter())
        chance = lambda c, kept=kept: (lambda n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, q = {s: chance(c) for s, c in own.items()}, chance(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])[:10]
            out += [(lang, s, part, i, -v, r + 1) for part, found in (("pair", pairs), ("term", terms)) for r, (v, _, i) in enumerate(found)]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "The", "THE", "é", "É", "naïve", "x" * 3000, "中文", "a-b", "b1c", "🙂", "z z"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    out = [(" ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["hot"] * 5 + ["b", "Ç", None, "d"])) for _ in range(300)]
    out += [("the the", "en", "hot")] * 200 + [("", "en", "empty"), (None, "xx", "one"), ("few", "xx", "two"), ("few words", "yy", "alone"), ("the " * 100_000, "en", "long")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("chunk", "held"), [(4096, 400_000), (7, 50)])
def test_equals_brute_force(spark, rows, chunk, held, monkeypatch):
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    monkeypatch.setattr(source_audit, "HELD", held)
    assert found(source_audit.divergences(df, chunk=chunk)) == brute_force(rows)


def test_empty_table(spark):
    assert source_audit.divergences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_counts_are_exact():
    counts, total = np.array([0, 5, 10**15, 4 * 10**15 + 7]), 8 * 10**15
    assert source_audit.probabilities(counts, total, 3).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 6) for c in counts]


def test_query_equals_sql_and_brute_force(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = found(queries.op13_source_audit(spark, sf))
    assert got == sorted(con.sql(source_audit.SQL).select(", ".join(COLUMNS)).fetchall())
    assert got == brute_force(con.sql("SELECT text, lang, source FROM documents").fetchall())
