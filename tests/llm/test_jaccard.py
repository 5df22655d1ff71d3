"""The Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import jaccard_join as J


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct, degree = {}, {}
    for i, s in enumerate(sets):
        if s:
            if s in distinct:
                parent[find(i)] = find(distinct[s])
            distinct.setdefault(s, i)
    own = list(distinct)
    for i, a in enumerate(own):
        for b in own[:i]:
            if 3 * len(a) <= 4 * len(b) and 3 * len(b) <= 4 * len(a) and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(distinct[a])] = find(distinct[b])
                degree[a] = degree.get(a, 0) + 1
                degree[b] = degree.get(b, 0) + 1
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return sorted(((d, len(s), least[find(i)], degree.get(s, 0)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near(rng, base, n):
    words = base.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(500)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(8)
    bases = [" ".join(f"v{rng.randrange(2000)}" for _ in range(rng.choice([6, 20, 60, 200]))) for _ in range(25)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [near(rng, b, rng.randrange(0, 1 + len(b.split()) // 15)) for b in bases for _ in range(rng.choice([1, 2, 8]))]
    texts += [near(rng, bases[3], rng.randrange(6)) for _ in range(120)] + [bases[3]] * 80
    texts += [f"{near(rng, bases[k % 25], 40)} {passage}" for k in range(40)]
    texts += ["", None, " \n", "one", "ONE", "one two", "a b c d", "a b c d e", "a b c\nd E", "a b c d e f", "é É b c d", "x" * 3000, "y " * 3000]
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[0], (None, texts[-1], "", 1), (None, bases[0], "", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, n int").repartition(7)


@pytest.mark.parametrize(("tile", "hot", "broadcast"), [(J.TILE, J.HOT, 500_000), (16, 3, 0)])
def test_components_equal_brute_force(spark, made, tile, hot, broadcast, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_ROWS", broadcast)
    rows = [(r.doc_id, r.text) for r in made.collect()]
    want = brute(rows)
    got = J.jaccard_components(made, tile, hot).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_regions_are_divided_by_pivots(spark, monkeypatch):
    """Eight groups of 300 texts that share one line, whose shingles are as frequent (for the saturated sketch) as any: one region of
    more than TILE sets, which the pivots divide by distances of nearly 1 between groups."""
    rng = random.Random(12)
    line = " ".join(f"l{i}" for i in range(20))
    rows = []
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(80)]
        for _ in range(300):
            words = list(base)
            words[rng.randrange(80)] = f"u{len(rows)}"
            rows.append((len(rows), f"{line} {' '.join(words)}"))
    rng.shuffle(rows)
    seen, divide = [], J.divided

    def spy(members, sets, tile):
        cells, crowds = divide(members, sets, tile)
        before = members.groupBy("pivot").count().orderBy("count", ascending=False).first()["count"]
        after = cells.groupBy("pivot").count().orderBy("count", ascending=False).first()["count"]
        seen.append((before, after, crowds.count()))
        return cells, crowds

    monkeypatch.setattr(J, "divided", spy)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    ((before, after, crowd),) = seen
    assert before > J.TILE >= after and not crowd


def test_crowds_are_compared_ring_by_ring(spark, monkeypatch):
    """400 near copies in one region of 50 at most: no pivot divides them, rings do."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(120)] = f"x{rng.randrange(4000)}"
        rows.append((i, " ".join(words)))
    seen, tiles = [], J.tiles_of

    def spy(members, crowds, tile):
        out = tiles(members, crowds, tile)
        seen.append((crowds.count(), out.groupBy("pivot", "low", "high").count().agg({"count": "max"}).first()[0]))
        return out

    monkeypatch.setattr(J, "tiles_of", spy)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), tile=50).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    ((crowd, most),) = seen
    assert crowd >= 400 and most <= 4 * 50


def test_sets_that_share_a_node_are_told_apart(spark, monkeypatch):
    """Nodes of three bits: most sets share theirs with others, and the second sum takes its place."""
    monkeypatch.setattr(J, "NODE_MASK", 7)
    rows = [(i, f"{'a b c d e f g h ' * 4}t{i % 20}") for i in range(40)] + [(40 + i, f"k{i} l m n o p") for i in range(30)]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = J.jaccard_components(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert J.jaccard_components(docs.limit(0)).count() == 0


def test_links_with_recursion(monkeypatch):
    monkeypatch.setattr(J, "LEAF", 8)
    rng = np.random.default_rng(2)
    sets = []
    for c in range(12):
        base = rng.choice(4000, 80, replace=False)
        for _ in range(9):
            own = base.copy()
            k = rng.integers(0, 25)
            own[:k] = rng.integers(5000, 9000, k)
            sets.append(np.unique(own).astype(np.uint64))
    got = J.links(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and 100 * both >= 75 * (len(a) + len(b) - both))


def test_hashes_do_not_depend_on_windows(monkeypatch):
    from ledgerloom.llm import hashing

    texts = pa.array(["a bc  def", "", "x" * 50, "Hello hello\nworld " * 9, " "])
    whole = hashing.WordHasher(b" \n").hashes(texts)
    monkeypatch.setattr(hashing, "_WINDOW", 16)
    small = hashing.WordHasher(b" \n").hashes(texts)
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all()
    assert len(np.unique(whole[0])) == 6


def twisted(k):
    """Two words that any polynomial hash with an odd base maps to one value modulo 2**64."""
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("k", [3, 6, 7, 10, 12])
def test_structured_words_do_not_collide(spark, k):
    from ledgerloom.llm import decontamination, hashing, license_scan

    one, other = twisted(k)
    for hasher in (hashing.WordHasher(J.SEPARATORS), decontamination.Matcher([]).hasher, license_scan.Grams().hasher):
        found, _ = hasher.hashes(pa.array([f"{one} {other}"]))
        assert found[0] != found[1]
    rows = [(1, f"{one} x1 x2 x3 x4"), (2, f"{other} x1 x2 x3 x4"), (3, f"{one} x1 x2 x3 x4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(docs).collect())) == brute(rows)
    items = spark.createDataFrame([(7, f"{one} x1 x2 x3")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.contamination(docs, items).collect()) == [1, 3]


def test_shingles_that_share_a_list_lose_no_link(spark, monkeypatch):
    """Lists known by no bits below their bucket: all rare shingles meet in a few lists, which only makes more candidates."""
    monkeypatch.setattr(J, "LIST_BITS", 3)
    entries = np.zeros(3, J.ENTRY)
    entries["node"], entries["size"], entries["place"] = [1, 1, 2], [10, 10, 10], [2, 0, 0]
    assert J.owner_pairs(entries).tolist() == [[1, 2]]
    rng = random.Random(9)
    base = [[f"b{g}w{i}" for i in range(40)] for g in range(12)]
    rows = [(i, near(rng, " ".join(base[i % 12]), rng.randrange(4))) for i in range(90)]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_messages_round_trip():
    rng = np.random.default_rng(3)
    entries = np.zeros(500, J.ENTRY)
    for name, top in (("shingle", 1 << 63), ("node", 40)):
        entries[name] = rng.integers(0, top, 500)
    entries["size"], entries["place"] = entries["node"] * 7, rng.integers(0, 90, 500)
    got = J.unpack_entries(J.pack_entries(entries))
    assert sorted(got.tolist()) == sorted(entries.tolist())


def test_one_row_of_each_component_stays(spark, made):
    kept = J.one_of_each_component(made, 16, 3)
    assert kept.columns == made.columns
    rows = [(r.doc_id, r.text) for r in made.collect()]
    component = {r.doc_id: r.component_id for r in J.jaccard_components(made).collect()}
    got = [r.doc_id for r in kept.collect()]
    with_words = [d for d, t in rows if (t or "").split()]
    want = sorted({component[d] for d in with_words if component[d] is not None})
    assert sorted(d for d in got if d in set(with_words) and d is not None) == want
    assert sum(d not in set(with_words) for d in got) == sum(not (t or "").split() for _, t in rows)


def test_histograms_never_hide_a_link():
    rng = np.random.default_rng(5)
    for n in (3, 60, 700, 3000):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(n) < f, rng.integers(0, 1 << 63, n).astype(np.uint64), base)) for f in (0, 0.05, 0.12, 0.3, 1, 1)]
        keep = J.may_overlap([J.histogram(s) for s in sets], np.array([len(s) for s in sets]))
        linked = J.links(sets).any(1)
        assert (keep | ~linked).all() and linked[:3].any()
        assert n < 60 or not keep[5]


def test_sets_round_trip():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2))
    assert (J.unpack_set(J.pack_set(x)) == x).all()
