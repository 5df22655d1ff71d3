"""Deduplication, sharding, decontamination and URL rules against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, exact_dedup, sharding, url_filter

SCHEMA = "doc_id long, text string, digest string, block int"


@pytest.fixture(scope="module")
def copies(spark):
    texts = ["hot"] * 60 + ["", None, "", "a b", "a  b", "A b", "hot "] + ["x" * 5000] * 3 + [f"t{i % 40}" for i in range(90)]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(3, "hot", "clash", 1), (3, "hot", "clash", 1), (None, "hot", "", 1), (None, "alone", "", 1)]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@given(st.sets(st.integers(0, (1 << 64) - 1), min_size=1))
@settings(max_examples=60, deadline=None)
def test_golomb_round_trip(values):
    ordered = np.array(sorted(values), np.uint64)
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(ordered, 1 << 64)) == ordered).all()


def test_dedup_equals_brute_force(spark, sf, copies):
    for docs, block in ((spark.read.parquet(f"{sf}/documents.parquet"), 1 << 16), (copies, 8), (copies.limit(0), 8)):
        rows = [(r.doc_id, r.text or "") for r in docs.collect()]
        size = Counter(t for _, t in rows)
        best = {}
        for i, t in rows:
            best[t] = max(best.get(t, -1), -1 if i is None else i)
        got = exact_dedup.exact_duplicates(docs, block_rows=block).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, best[t] if best[t] >= 0 else None, size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept.values()) <= {1} and len(kept) == len(size)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_shards_fit(spark, sf, copies):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for own, limit in ((docs, 20_000), (docs, 1 << 30), (copies, 40), (copies.limit(0), 40)):
        got = sharding.shard_documents(own, limit).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in own.collect())
        shards = {}
        for r in got:
            shards.setdefault(r.shard, []).append(r)
        for name, rows in shards.items():
            total = sum(r.n_bytes for r in rows)
            assert len(name) == rows[0].depth and {(r.shard_bytes, r.shard_docs) for r in rows} == {(total, len(rows))}
            assert total <= limit or (len(rows) == 1 and rows[0].oversized)
            assert not any(o != name and o.startswith(name) for o in shards)
            if name:  # only oversized buckets were split
                assert sum(r.n_bytes for o, rs in shards.items() if o.startswith(name[:-1]) for r in rs) > limit
    assert {r.shard for r in sharding.shard_documents(docs, 1 << 30).collect()} == {""}


def test_rows_of_one_key_are_split(spark):
    docs = spark.range(200).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(5).alias("doc_id"), F.lit("ten bytes!").alias("text"))
    got = sharding.shard_documents(docs, 100).collect()
    assert len(got) == 200 and max(r.shard_bytes for r in got) <= 100


def levenshtein(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=30))
@settings(max_examples=200, deadline=None)
def test_myers_distance(pattern, text):
    assert decontamination.edit_distance(pattern, text)[0] == levenshtein(pattern, text)


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() or ord(c) > 127 else " " for c in text or "").split()


def edited(rng, text, n):
    own = text.split()
    for _ in range(n):
        i = rng.randrange(len(own))
        own[i : i + 1] = rng.choice([["zzz"], [], [own[i], "yyy"]])
    return " ".join(own)


def test_decontamination_equals_brute_force(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id < 40")
    items = {r.item_id: words(r.text) for r in bench.collect()}
    rng = random.Random(3)
    base = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 900").limit(60).collect()]
    texts = [b if i % 2 else f"{b[:200]} {edited(rng, bench_text, i % 12)}\n{b[200:]}" for i, (b, bench_text) in enumerate(zip(base, [r.text for r in bench.collect()] * 2, strict=False))]
    texts += ["", None, " ".join(texts[0].split()[:2]) + ".", texts[0], texts[0].upper()]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int").repartition(3)
    want = set()
    for i, t in enumerate(texts):
        own = words(t)
        for k, item in items.items():
            if len(item) >= 4 and (d := levenshtein(item, own)) <= decontamination.budget(len(item)):
                want.add((i or None, k, d))
    assert len(want) > 20
    for block in (50_000, 7):
        got = decontamination.contamination(docs, bench, block).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want)
    clean = decontamination.uncontaminated(docs, bench)
    hit = {i for i, *_ in want}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i or None for i in range(len(texts))} - hit
    assert decontamination.contamination(docs.limit(0), bench).count() == 0 and decontamination.contamination(docs, bench.limit(0)).count() == 0


def test_repeated_lines_rows_and_items(spark):
    """An item whose pieces occur thousands of times in a text is found once for each row; repeated rows and items count each."""
    item = "one two three four five six seven eight nine ten"
    close = item.replace("five", "x")
    near = " ".join(["one two three four five"] * 3000)
    rows = [(1, item), (1, item), (2, f"{near} {close} {near}"), (3, near), (4, f"{item} " * 2000), (None, close)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, item), (6, item), (None, item), (7, None)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.distance) for r in decontamination.contamination(docs, bench).collect())
    assert got == Counter((i, k, d) for i, d in ((1, 0), (1, 0), (2, 1), (4, 0), (None, 1)) for k in (5, 6, None))
    assert sorted(r.doc_id for r in decontamination.uncontaminated(docs, bench).collect()) == [3]
    assert decontamination.spans({5, 9, 40}, 10, 2) == [(3, 21), (38, 52)]


def units(text):
    """Words, or characters where a script has no spaces (the ranges that this test uses)."""
    return [x.lower() for x in re.findall(r"[\u0e00-\u0e7f\u3041-\u3096\u30a1-\u30fa\u30fc\u4e00-\u9fff]|[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\u0e00-\u0e7f\u3000-\u3004\u3041-\u30ff\u4e00-\u9fff\uff01-\uff0f\uff1a-\uff20]+", text or "")]


def test_decontamination_of_short_and_unspaced_items(spark):
    """A benchmark item of any length and script is found where a document holds it, against brute force."""
    texts = ["Yes", "blue whale", "one, two three", "a b c d", "水是生命之源，人类离不开水和空气，也离不开阳光。", "東京はサーバーが多いです", "ประเทศไทยมีประชากรมาก", "水", "用Python编写 fast code", "?!", "", None, "blue whale"]
    items = {i: units(t) for i, t in enumerate(texts)}
    rng = random.Random(7)
    docs = ["no such thing", "Yes", "say yes, please", "eyes yesterday", "the BLUE: whale. blue whale", "blue", "whale blue", "one two", "one two three", "x a b c d", "a b c", "", None, "用python编写 FAST code", "fast code"]
    docs += [f"前文也在{t}后文" for t in texts[4:8]] + [f"head {t} tail" for t in texts[4:7]] + [texts[4].replace("，", ""), texts[4].replace("生命", "生 命")]
    for t in texts[4:7] * 3:
        own = list(t)
        for _ in range(rng.randrange(1, 7)):
            i = rng.randrange(len(own))
            own[i : i + 1] = rng.choice([["山"], [], [own[i], "火"]])
        docs.append("甲乙" + "".join(own) + "丙丁")
    want = set()
    for d, t in enumerate(docs):
        own = units(t)
        for k, item in items.items():
            if item and (n := levenshtein(item, own)) <= decontamination.budget(len(item)):
                want.add((d, k, n))
    assert {(1, 0, 0), (2, 0, 0), (4, 1, 0), (4, 12, 0), (8, 2, 0), (15, 4, 0), (17, 6, 0), (18, 7, 0)} <= want and any(n for *_, n in want) and {d for d, *_ in want}.isdisjoint({0, 3, 5, 6, 7, 10, 11, 12, 14})
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    for block in (50_000, 3):
        got = decontamination.contamination(frame, bench, block).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want)
        assert all(r.item_words == len(items[r.item_id]) and (r.distance or units(docs[r.doc_id])[r.start_word : r.start_word + r.item_words] == items[r.item_id]) for r in got)
    assert {r.doc_id for r in decontamination.uncontaminated(frame, bench).collect()} == set(range(len(docs))) - {d for d, *_ in want}


URLS = ["https://a.example.com/en/7?x=1", "http://EXAMPLE.com/en/8", "ftp://example.net/de/81", "x://net/de/", "http://org/es", "http://u.org/es/?q", "http://u.org/es/#f", "http://notcom/en/1", "no scheme", None, "", "http://", "http:///en/", "http://example.com?x=/en/7", "HTTP://a.b.example.com/en/77.html#z", "a://b://c", "http://h\nost.com/en/\n7"]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def test_url_rules(spark, sf):
    odd = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(0, URLS[0], "")], "page_id long, url string, host string")
    labels = url_filter.page_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    for pages in (odd, spark.read.parquet(f"{sf}/pages.parquet"), odd.limit(0)):
        want = Counter((r.page_id, *judged(r.url)) for r in pages.collect())
        got = url_filter.filter_urls(pages, labels).collect()
        assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got) == want


def plain_tokens(url):
    """The tokens of a URL, with plain string operations."""
    if url is None or "://" not in url:
        return frozenset()
    host, path, *_ = judged(url)
    labels, scheme = host.split("."), re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", url)
    query = (re.match(r"(?s)[^?#]*\?([^#]*)", url) or [0, ""])[1]
    pairs = [x for x in query.split("&") if x]
    ending = re.search(r"\.([A-Za-z0-9]{1,5})\Z", path)
    out = [f"scheme={scheme[1].lower()}" if scheme else None, f"ending={ending[1].lower()}" if ending else None, "fragment" if "#" in url else None]
    out += [f"host={x}" for i in range(len(labels)) if (x := ".".join(labels[i:]))]
    out += [f"path={x}" for x in path.split("/") if x] + [f"query={k}" for x in pairs if (k := x.split("=", 1)[0])] + [f"pair={x}" for x in pairs]
    return frozenset(x for x in out if x)


LONG = "https://a.b.c.example.com/" + "/".join(f"s{i}" for i in range(3000)) + "/x.HTML?" + "&".join(f"k{i}=v{i}" for i in range(3000)) + "#top"


def test_tokens_of_whole_urls(spark):
    urls = [*URLS, LONG, "https://a.b.adult-x.example.com/en/1/casino/?x=1&ad=2", "http://h/?a=b=c&&=d"]
    got = url_filter.judged_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).collect()
    assert {r.page_id: frozenset(r.tokens) for r in got} == {i: plain_tokens(u) for i, u in enumerate(urls)}
    assert len(plain_tokens(LONG)) > 9000 and all(len(set(r.tokens)) == len(r.tokens) for r in got)


def test_mined_rules_equal_counts(spark):
    """Rules against counts of every token set, mined in three quarters of the pages and held against the rest."""
    from itertools import combinations

    rng = random.Random(5)
    rows = [(i, f"http://{rng.choice(['bad', 'good', 'odd'])}.h.com/{rng.choice('ab')}/{rng.choice('cd')}/{i}?t={rng.randrange(2)}") for i in range(1600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    block = {i: "bad." in u and "/a/" in u or rng.random() < 0.1 for i, u in rows}
    labels = spark.createDataFrame([*block.items(), (None, True)], "page_id long, block boolean")
    fold = {r.page_id: r.fold for r in pages.select("page_id", F.pmod(F.xxhash64("page_id", F.lit(2)), F.lit(4)).alias("fold")).collect()}
    tokens = {i: plain_tokens(u) for i, u in rows}
    n, both = ({k: Counter() for k in (True, False)} for _ in range(2))
    for i, own in tokens.items():
        own = [t for t in own if t.split("=")[1] != str(i)]
        for k in range(1, len(own) + 1):
            for c in combinations(sorted(own), k):
                n[fold[i] > 0][frozenset(c)] += 1
                both[fold[i] > 0][frozenset(c)] += block[i]
    support = 0.05 * sum(f > 0 for f in fold.values())
    sure = {c: both[True][c] / n[True][c] for c in n[True] if both[True][c] >= int(support) and both[True][c] / n[True][c] >= 0.6}
    least = {c for c, s in sure.items() if not any(g < c and sure[g] >= s for g in sure)}
    held = {c: both[False][c] / n[False][c] for c in least if n[False][c] >= url_filter.TRIED and both[False][c] / n[False][c] >= 0.6}
    mined = dict(url_filter.mine_rules(url_filter.judged_urls(pages), labels, 0.05, 0.6))
    assert frozenset({"host=bad.h.com", "path=a"}) in mined and mined == {c: pytest.approx(held[c]) for c in mined} and set(held) >= set(mined)
    got = {r.page_id: (r.verdict, r.confidence) for r in url_filter.filter_urls(pages, labels, (), 0.05, 0.6).collect()}
    best = {i: max((s for c, s in mined.items() if c <= own), default=None) for i, own in tokens.items()}
    assert got == {i: ("allow" if s is None else "block", s if s is None else pytest.approx(s)) for i, s in best.items()}
    judged_right = [block[i] == (got[i][0] == "block") for i in block]
    assert sum(judged_right) > 0.85 * len(block) and sum(got[i][0] == "block" and block[i] for i in block) > 0.9 * sum(v[0] == "block" for v in got.values())


def test_no_rules_from_labels_that_urls_do_not_tell(spark):
    """On the given pages the labels have nothing to do with the URLs: what is mined there must still beat the share of blocked pages."""
    pages, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("pages", "labels"))
    labels = url_filter.page_labels(labels)
    even = url_filter.mine_rules(url_filter.judged_urls(pages), labels.where("page_id % 2 = 0"), 0.005, 0.6)
    judged_pages = url_filter.judge(url_filter.judged_urls(pages), (), even).join(labels, "page_id").where("page_id % 2 = 1")
    rows = judged_pages.select("verdict", "block").collect()
    blocked = [r.block for r in rows if r.verdict == "block"]
    assert not blocked or sum(blocked) / len(blocked) > sum(r.block for r in rows) / len(rows)


def test_toxicity_on_held_out_documents(spark):
    from ledgerloom.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    right = [r.predicted == r.toxic for r in got]
    assert sum(right) / len(right) > 0.97
    assert sum(r.predicted for r in got if not r.toxic) < 0.01 * len(got)


def test_gains_equal_plain_compression(spark):
    """Both dictionaries come from zstandard's training, and a gain is the difference of two plain compressions of a window."""
    import pyarrow as pa
    import zstandard

    from ledgerloom.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    for raw in (model.toxic, model.ordinary):
        assert zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT).dict_id() > 0 and len(raw) > 2000
    texts = [r.text for r in docs.where("length(text) > 0").orderBy("doc_id").limit(40).collect()] + ["", "word " * 5000]
    gauge = toxicity.Gauge(model.toxic, model.ordinary)
    noise = np.random.default_rng(3).bytes(len(model.toxic))
    coder = toxicity.Coder()
    total = 0
    for text, got in zip(texts, gauge.gains(pa.array(texts)), strict=True):
        codes, _ = coder.codes(pa.array([text]))
        want = []
        for i in range(0, len(codes), toxicity.WINDOW_WORDS):
            window = b"".join(int(c).to_bytes(8, "little")[:6] for pair in codes[i : i + toxicity.WINDOW_WORDS] for c in pair)
            with_toxic, without = (len(toxicity.Gauge.compressor(x + model.ordinary).compress(window)) for x in (model.toxic, noise))
            want.append(without - with_toxic)
        assert got.tolist() == want
        total += len(want)
    assert total > 100


def test_toxicity_of_odd_rows(spark, copies):
    from ledgerloom.llm import toxicity

    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(None, 1, "")], "doc_id long, toxic int, text string")
    model = toxicity.train(copies, labels, sample=10)
    for docs in (copies, copies.limit(0)):
        got = toxicity.score_toxicity(docs, model).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
        kept = toxicity.drop_toxic(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    one = toxicity.train(copies, labels.where("toxic = 1"))
    assert {r.score for r in toxicity.score_toxicity(copies, one).collect()} == {1.0}
    assert {r.score for r in toxicity.score_toxicity(copies, toxicity.train(copies, labels.limit(0))).collect()} == {0.0}


def test_one_row_of_each_text_stays(copies):
    kept = exact_dedup.without_copies(copies, block_rows=8)
    assert kept.columns == copies.columns
    best = {}
    for r in copies.collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == sorted(best.items())


def test_very_long_texts(spark):
    """Texts longer than a worker's slice and than a window of the hasher, one of them a single word."""
    from ledgerloom.llm import jaccard_join, toxicity

    rng = random.Random(2)
    words_ = [f"w{rng.randrange(10**6)}" for _ in range(1_300_000)]
    long, item = " ".join(words_), "these twelve words are an item of the benchmark that is found"
    near = " ".join([*words_[:-40], *item.split()])
    rows = [(1, long), (2, near), (3, long), (4, "x" * 9_000_000), (5, "X" * 9_000_000), (6, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()} == {(1, 3, 2), (3, 3, 2), (2, 2, 1), (4, 4, 1), (5, 5, 1), (6, 6, 1)}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert found == {1: (1_299_996, 1), 2: (len(words_) - 40 + 12 - 4, 1), 3: (1_299_996, 1), 4: (1, 4), 5: (1, 4), 6: (8, 6)}
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {(r.doc_id, r.distance) for r in decontamination.contamination(docs, bench).collect()} == {(2, 0), (6, 0)}
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    assert {r.doc_id: r.windows for r in scored} == {1: 20313, 2: -(-(len(words_) - 28) // 64), 3: 20313, 4: 1, 5: 1, 6: 1}
