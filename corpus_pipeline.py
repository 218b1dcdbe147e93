"""From raw documents to packed sequences: STAGES in order, and run() that applies them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, line_dedup, packing, simhash, toxicity
from palimpsest.llm.common import table, written
from palimpsest.llm.queries import packing_tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go; it learns from the labels table, less the held-out fold.

    Null and empty texts are scored like others, by the machine's bias. Rows that repeat an id are judged each
    by its own text, so rows of one text stay or go together. Empty tables give empty results; without labels
    nothing goes. All columns stay as they are, whatever their names.
    """
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), learn=toxicity.learnable())
    return toxicity.without_toxic(docs, machine)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 code points found in at least 3 documents stay in the largest doc_id only; no document goes.

    Rows of one id are one document, a null id is the smallest; a null text stays null, an empty one empty.
    """
    return line_dedup.dedup_lines(docs, least_chars=20, least_docs=3).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (three-word shingles, 3 bits) stays: the smallest doc_id.

    Texts without words, null or empty, are copies of each other; rows without an id stay; rows of one id are
    one document, which stays or goes whole. An empty table stays empty.
    """
    return simhash.keep_one(docs, shingle=3, radius=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lie inside 13-word windows of the benchmark go.

    Null and empty texts have no words and stay; rows of one text stay or go together. An empty benchmark
    lets all stay.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in windows of 2048 tokens.

    A null or empty text is the end id alone; every row is packed, be its id repeated or null. An empty table
    gives no pieces.
    """
    return packing.pack(docs, packing_tokenizer(), window=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: Toxicity, SimHash and packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep; each stage's result is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
