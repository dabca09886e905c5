"""A corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, encoding; each stage reads what the one before kept.

In every stage a null text counts as empty, rows are judged by their own text whatever their id, null ids sort after all others,
columns beyond those of documents are carried, whatever their names, and an empty table gives an empty result. The last stage returns
columns of its own.
"""

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import stored, table
from tidewater.llm.decontaminate import decontaminate
from tidewater.llm.exact_dedup import exact_dedup
from tidewater.llm.sentencepiece_codec import round_trip
from tidewater.llm.simhash_dedup import drop_near_duplicates
from tidewater.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents and their labels, does not reject; all of them where labels are of one kind."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id; of rows alike in id and text, one."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; texts without words are one group."""
    return drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark; items without words are in none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with the check of the round trip; an empty text has none."""
    return round_trip(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece", encoding),
]

#: A trained classifier and a tokenizer are not SQL: tests hold run() against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stored before the next; for odd rows see above."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
