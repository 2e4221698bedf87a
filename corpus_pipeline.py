"""Corpus pipeline: toxicity, exact dedup, MinHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on everything that the stage before kept, and returns
documents with their columns; the last returns the packed pieces.

Defined results of all stages: extra columns are kept as they are, also where their names are those of results; an empty table gives an empty one. Null
texts count as empty. A row without an id passes the first, third and fourth stage by its own text; the second keeps it only if no equal text has an id. Rows that
repeat an id are one document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import decontaminate, exact_dedup, minhash, packing, toxicity
from memloom.llm.queries import table, tokenizer
from memloom.operators.scratch import Scratch


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is fitted to the labelled ones among ``docs``. An empty text has the score of a text without known words."""
    return toxicity.remove_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, the longest stays, of equally long ones the smallest id; all empty and blank texts are one."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 similarity of five-word shingles, the smallest id stays; a text without words is linked with nothing and stays."""
    return minhash.deduplicate(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item, those without words among them."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences; an empty text is the end token alone."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: The classifier and the tokenizer have no SQL form; a brute-force version in the tests stands for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, f"{k}-{name}")
    return docs
