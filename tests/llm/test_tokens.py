"""Token operators against the libraries themselves."""

import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import packing, token_counts, token_store

ROOT = str(Path(__file__).resolve().parents[2])
ODD = ["", None, " ", "   ", "a", "a  b", " a\n \nb ", "x\n", "\n\n x", "foo <|endoftext|> bar <s>", "naïve ŠIŠ İI ﬁ ǅ", "don't it's WE'LL 123 4567", "▁a ▁▁b", "\t\ta  b　c", "é é", "word" * 3000, "日本語 テキスト 🙂🙂", "a" * 5000, "same text", "same text", "\x00 \x1f x"]
SCHEMA = "doc_id long, text string, length int, n_tokens string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i if i else None, t, 1, "clash") for i, t in enumerate(ODD)], SCHEMA).repartition(3)


def tables(spark, sf, odd):
    return [spark.read.parquet(f"{sf}/documents.parquet"), odd, odd.limit(0)]


def rows(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def encoded(df, name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(name))
    return {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in rows(df)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_counts_equal_the_library(spark, sf, odd):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for docs in tables(spark, sf, odd):
        got = {r.doc_id: tuple(r)[1:] for r in token_counts.count_tokens(docs, path).collect()}
        want = {i: (len(t.encode()), n, n > 4096) for i, t in rows(docs) for n in [len(library.encode(t))]}
        assert got == want


def test_packing_holds_every_id_once(spark, sf, odd):
    path = P.path("word_bpe_49k.json")
    for docs in tables(spark, sf, odd):
        want = encoded(docs, "word_bpe_49k.json")
        got = packing.pack_documents(docs, path, block_tokens=50_000).collect()
        pieces, sequences = {}, {}
        for r in got:
            pieces.setdefault(r.doc_id, []).append(r)
            sequences.setdefault(r.sequence_id, []).append(r)
        assert set(pieces) == set(want)
        for i, ids in want.items():
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
                assert r.ids_crc32 == crc(ids[at : at + r.length])
                at += r.length
            assert at == len(ids)
        groups = {}
        for own in sequences.values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 4096 and at & (at - 1) == 0 and {r.tier for r in own} == {at}
            assert len({r.step_group for r in own}) == 1
            groups[own[0].step_group] = groups.get(own[0].step_group, 0) + at
        assert all(n <= 2 * (1 << 16) for n in groups.values())


def test_packing_cuts_seldom():
    packer = packing.Packer()
    rng = np.random.default_rng(1)
    sequences = [s for i in range(2000) for s in packer.add(i, np.zeros(rng.integers(1, 3000), np.uint32))]
    sequences += [*packer.pack(), *packer.end()]
    assert sum(len(s) for s in sequences) < 1.5 * 2000


def test_store_round_trip(spark, sf, odd):
    path = P.path("byte_bpe_50k.json")
    for docs in tables(spark, sf, odd):
        want, start = {}, 0
        for i, ids in sorted(encoded(docs, "byte_bpe_50k.json").items(), key=lambda x: (x[0] is not None, x[0])):
            want[i] = (start, len(ids), crc(ids))
            start += len(ids)
        got = token_store.store_tokens(docs, path).collect()
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_store_reads_one_document(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = encoded(docs, "byte_bpe_50k.json")
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, P.path("byte_bpe_50k.json"), path, block_bytes=20_000)
    blocks, raw = token_store.open_store(spark, path)
    assert raw and blocks.count() > 4
    block = blocks.where(F.col("number") == 1).first().block
    reader = token_store.BlockReader(bytes(block), raw)
    i = reader.find(reader.doc_id(3))
    assert i == 3 and reader.ids(i).tolist() == want[reader.doc_id(3)] and reader.find(-5) == -1
    with pytest.raises(ValueError):
        token_store.BlockReader(bytes(block), b"other")
    assert [token_store.read_document(spark, path, i) for i in (0, 150, -1)] == [[list(want[0])], [list(want[150])], []]
    # Another process, without Spark, reads the folder alone.
    code = f"""
import glob, pyarrow.parquet as pq, sys
sys.path.insert(0, {str(ROOT)!r})
from ledgerloom.llm.token_store import BlockReader
raw = pq.read_table(glob.glob({str(tmp_path)!r} + "/store/dictionary/*.parquet")[0])["dictionary"][0].as_py()
for f in sorted(glob.glob({str(tmp_path)!r} + "/store/blocks/*.parquet")):
    for block in pq.read_table(f)["block"].to_pylist():
        reader = BlockReader(block, raw)
        if (i := reader.find(77)) >= 0:
            print(*reader.ids(i).tolist())
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split() == [str(x) for x in want[77]]


def test_repeated_rows_and_long_texts(spark):
    """Rows of one doc_id, whole repeated rows, and texts longer than a slice: each row counts."""
    from collections import Counter

    import sentencepiece
    from tokenizers import Tokenizer

    long = "a few words, repeated. " * 420_000  # more than a worker's slice
    texts = [(7, "same text"), (7, "same text"), (7, "other"), (None, "x y"), (None, "x y"), (3, long), (3, ""), (2, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = [(i, t or "") for i, t in texts]
    model = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    want = Counter((i, len(t.encode()), n, n > 4096) for i, t in rows for n in [len(library.encode(t))])
    assert Counter(map(tuple, token_counts.count_tokens(docs, model).collect())) == want

    words, counted = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for i, t in rows:
        counted[i, len(words.encode(t, add_special_tokens=False).ids) + 1] += 1
    pieces = packing.pack_documents(docs, P.path("word_bpe_49k.json")).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == counted
    assert sum(r.length for r in pieces) == sum(n * k for (_, n), k in counted.items())
    sequences = Counter()
    for r in pieces:
        sequences[r.sequence_id] += r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sequences.values())

    bytes_ = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = token_store.store_tokens(docs, P.path("byte_bpe_50k.json")).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids), crc(ids)) for i, t in rows for ids in [[*bytes_.encode(t, add_special_tokens=False).ids, 2]])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 2, 3, 3, 7, 7, 7]
