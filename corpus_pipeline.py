"""The training-data pipeline over documents: classifier, rules, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assertloom.llm import ngram_join, packing, quality_gam, quality_rules, recompression
from assertloom.session import release, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects, as low or as toxic, go. It is fitted on the labels beside the documents.

    A null or empty text is scored as one without words; null and repeated doc_ids are judged each; very long texts are read whole. Ties at the
    threshold go. No documents, or no labels, are no error: without labels all stay. All columns stay, whatever their names.
    """
    return quality_gam.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go.

    Null and empty texts break the rule of length; null and repeated doc_ids are judged each; very long texts are read whole. A value at a
    bound is within it. An empty table stays empty. All columns stay, whatever their names.
    """
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays.

    Rows with a null doc_id, and null, empty or wordless texts, have no group and stay. Equal rows of one doc_id stay together; of a doc_id with
    several texts each is judged. Very long texts are compared whole. An empty table stays empty. All columns stay, whatever their names.
    """
    return ngram_join.one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 tokens or more stay only where they stand first, in the order of doc_id, text hash and position.

    Rows with a null doc_id or text stay as they are; a text that is all repeats becomes empty and its row stays. Equal rows get equal texts.
    Very long texts are read whole. An empty table stays empty. All columns stay, whatever their names, but one called n_removed goes.
    """
    return recompression.substring_dedup(docs).drop("n_removed")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 2048 tokens; longer texts are cut into pieces.

    Null, empty and blank texts have nothing to pack; a null doc_id is carried; repeated rows are packed each. Ties are between equal rows
    only. An empty table gives no sequences. Columns other than doc_id and text play no part, whatever their names.
    """
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", pack),
]

#: The classifier is trained, so SQL can't give the rows; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if last is not None:
            release(last)  # it has been read for the last time
        last = docs
    return docs
