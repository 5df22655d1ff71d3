"""The pipeline against plain applications of its decisions."""

import corpus_pipeline
from ledgerloom.llm import decontamination, toxicity
from tests.llm.test_jaccard import brute


def test_pipeline_equals_plain_decisions(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).where("predicted = 1").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    best = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for t, i in best.items()}
    component = {i: c for i, _, c, _ in brute(list(rows.items()))}
    rows = {i: t for i, t in rows.items() if component[i] == i}
    hit = {r.doc_id for r in decontamination.contamination(docs, bench).collect()}
    want = set(rows) - hit
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == want and len(want) < docs.count()
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())


def test_stages_keep_columns_and_bear_odd_tables(spark):
    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(1, None, "x", 3), (None, "a b c d e f", None, None), (1, "", "", 0), (1, None, "x", 3), (2, "z" * 9000, "y", 1)], "doc_id long, text string, fingerprint string, node long")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.schema.names == docs.schema.names, name
            n = {"toxicity": 5, "exact_dedup": 3, "jaccard_join": 5, "decontamination": 5}[name]
            assert out.count() == (n if docs is odd else 0), name
        assert corpus_pipeline.pack(spark, docs, sf).count() >= (docs is odd)


def test_odd_labels_and_benchmark(spark, tmp_path):
    """Null labels, and null, empty and repeated items, change nothing; clashing columns are carried through."""
    from pyspark.sql import functions as F

    sf, odd = "/root/testdata/sf0.001", f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("fingerprint", F.lit("x")).withColumn("row", F.lit(1)).withColumn("maybe", F.lit(True))
    docs.write.parquet(f"{odd}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    labels.unionByName(labels.limit(3).withColumn("toxic", F.lit(None).cast("int")).withColumn("doc_id", F.lit(None).cast("long")), allowMissingColumns=True).write.parquet(f"{odd}/labels.parquet")
    nothing = spark.createDataFrame([(None, None), (1, ""), (2, None)], "item_id long, text string")
    bench.unionByName(bench).select("item_id", "text").unionByName(nothing).write.parquet(f"{odd}/benchmark.parquet")
    got, want = corpus_pipeline.run(spark, odd).collect(), corpus_pipeline.run(spark, sf).collect()
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows if r.start == 0 and r.length == r.doc_tokens)
    assert {r.doc_id: r.doc_tokens for r in got} == {r.doc_id: r.doc_tokens for r in want} and key(got)
