"""A corpus pipeline of operators in ``ledgerloom.llm``: what it returns is the corpus without toxic texts, exact and near copies and
benchmark passages, packed into training sequences.

Every stage but the last takes documents and returns documents with the same columns. Each is given its predecessor's rows as written
and read again, so nothing is computed twice and a lost executor costs one stage's tasks at most.

Defined results: null texts are empty texts and are kept by every stage (but exact copies of them but one go); rows that repeat doc_id and text are
copies, one of them stays; a null doc_id stays null; of documents whose doc_ids tie, one stays; without labels, or with those of one
class only, nothing or everything is toxic as the labels' share says (0 without labels); null labels and null, empty or repeated benchmark items
change nothing; empty tables give empty results; other columns, whatever their names, are carried through to the last stage, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontamination, exact_dedup, jaccard_join, packing, toxicity
from ledgerloom.llm.common import materialize, table
from ledgerloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled ones among ``docs``; drops those predicted toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, that with the largest doc_id."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of the Jaccard join."""
    return jaccard_join.one_of_each_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item occurs within its edit budget."""
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]
#: Dictionaries, edit distances and token ids are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
