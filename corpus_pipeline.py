"""From raw documents to encoded training data, in five stages.

Each stage is written as Parquet in the shared folder and read again as the next
one's documents, so a lost executor costs no more than a stage's own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import bpe, line_dedup, mixing, quality_classifier, simhash
from tallymark.llm.common import column, table, written
from tallymark.llm.queries import BYTE_BPE


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts get the score of the model's bias and stay or go together;
    repeated rows are judged alike; without labels every document stays.
    """
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; what has none left goes.

    A null text and one that never had a word stay as they are; ``n_chars``, where
    there is such a column, follows the cut.
    """
    cut = line_dedup.dedup(docs)
    left = cut.where((F.size("removed") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    length = F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    columns = [length.alias("n_chars") if c == "n_chars" else column(c) for c in docs.columns]
    return left.select(*columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: three-word shingles, three differing bits.

    Null and empty texts are one group; a row without an id ranks last in its own.
    """
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, in hashed order.

    A null source is a source; a document whose draw is zero goes, as the method has it.
    """
    return mixing.mix(docs).select(*[column(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of token ids of every document, and digests of ids and decoded text; null is the empty text."""
    ids = bpe.round_trip(docs, BYTE_BPE)
    return bpe.digests(ids)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("near-dedup", one_of_near_copies),
    ("mixing", mixed),
    ("BPE encoding", encoded),
]
#: SQL cannot train the classifier or encode; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
