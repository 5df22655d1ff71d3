"""The trie of conversations against brute force, with primes so small that fingerprints collide and blocks so short that they are carried."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from ledgerloom.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn int, role string, text string, depth string, fp int"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_force(rows):
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[conv].append((role or "", text or ""))
    members, last = defaultdict(list), defaultdict(list)
    for conv in sorted(own):
        h = zlib.crc32(str(conv).encode()) % 9
        path = tuple(own.get(conv - conv % 5, [])[:h] + own[conv][h:])
        last[path].append(conv)
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
    ends = {p: hashlib.sha256(",".join(map(str, last[p])).encode()).hexdigest() for p in members}
    return sorted((c[0], len(p), members[p[:-1]][0] if p else None, len(c), len(kids[p]), leaves[p], saved[p], ends[p]) for p, c in members.items())


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def talks():
    rng, rows = random.Random(1), []
    for conv in [*range(0, 60), 101, 102, 104, 10**12 + 1, 999]:
        for turn in range(rng.choice([1, 2, 5, 9, 14])):
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["user", None, ""]), rng.choice(["a", "é", "a", "b" * 70, None, ""]), "x", 1))
    rows += [(7, i, "user", "same", "x", 1) for i in range(500)] + [(7, 3, "user", "tie", "x", 1)] * 3 + [(8, 3, "user", "z" * 200_000, "x", 1), (None, 1, "user", "lost", "x", 1)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, talks):
    df = spark.createDataFrame(talks, SCHEMA).repartition(7)
    assert found(prefix_trie.trie_shape(df)) == brute_force([r[:4] for r in talks])


@pytest.mark.parametrize(("prime", "block"), [(7, 3), (1009, 1)])
def test_collisions_are_split(spark, talks, prime, block):
    few = [r for r in talks if r[0] != 7]
    df = spark.createDataFrame(few, SCHEMA)
    assert found(prefix_trie.prefix_trie(df, prime=prime, block=block)) == brute_force([r[:4] for r in few])


def test_texts_and_conversations_as_given(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "ho"), (2, 0, "user", "hi"), (2, 1, "bot", "he")]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), rebuild=False).collect()
    assert sorted((r.conv_id, r.depth, r.role, r.text, r.n_convs, r.saved_tokens) for r in got if r.depth) == [(1, 1, "user", "hi", 2, 2), (1, 2, "bot", "ho", 1, 0), (2, 2, "bot", "he", 1, 0)]
    assert next((r.n_convs, r.n_leaves, r.text) for r in got if not r.depth) == (2, 2, None)


def test_empty_table(spark):
    assert prefix_trie.trie_shape(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql_and_brute_force(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = found(queries.op11_prefix_trie(spark, sf))
    assert got == sorted(con.sql(prefix_trie.SQL).select(", ".join(COLUMNS)).fetchall())
    assert got == brute_force(con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())
