"""A corpus pipeline over the table documents: toxic documents go, repeated lines go, one document of
each group of near duplicates stays, documents that repeat benchmark items go, and the rest is
cut into pieces.

Each stage takes (spark, docs, sf_dir); docs is what the stage before kept, reread from Parquet.
Stages 1 to 4 return the columns of documents; the last one returns doc_id, score (of the best
segmentation, in millionths) and ids. n_chars stays as it came. Nulls, empty texts, repeated rows
and empty tables are treated as the operators say; a document whose text a stage leaves empty
stays, empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import decontamination, line_dedup, near_dedup, sentencepiece_nbest, toxicity
from lamina.llm.common import new_folder
from lamina.llm.queries import tokenizer_file
from lamina.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, judged by the labels of the corpus."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that one of a smaller id holds too."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked by shingles of five words at a similarity of 0.8."""
    found = near_dedup.near_duplicates(docs, shingle_words=5, percent=80)
    return found.where(found.columns[-1]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def cut_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, score and ids of the best segmentation."""
    return sentencepiece_nbest.best_ids(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("sentencepiece", cut_pieces),
]
#: SQL can express neither the classifier nor the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = new_folder(spark, f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
