"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and its result is written as
Parquet and reread as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import cut, table, without
from reelspark.llm.jaccard_join import jaccard_components
from reelspark.llm.mixing import thin
from reelspark.llm.packing import pack_documents
from reelspark.llm.quality_rules import keep_good
from reelspark.llm.secret_scans import labelled_findings, redact, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the isolation forest rejects go.

    A null or empty text fails the base rule; repeated rows and null ids are judged by their text
    alone; other columns stay whatever their names; an empty table stays one.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that link, the one with the least doc_id stays.

    Documents without words, null ids and columns of any name stay; rows that repeat a doc_id are one
    document. An empty table stays one.
    """
    return without(docs, jaccard_components(docs).where("component_id <> doc_id").select("doc_id"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are struck out of the texts, and n_chars counted anew there.

    A null text stays null; all rows and other columns stay, whatever their names.
    """
    return redact(docs, train(labelled_findings(spark)), "source")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of other domains than clean, good ones are thinned or repeated to the target weights.

    Copies are whole rows. Null and empty texts have the posteriors of a text without words; null ids
    draw from the text's facts; without labels all rows stay; an empty table stays one.
    """
    return thin(docs, table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences; a null or empty text is the end's id alone, each
    repeated row is packed, an empty table gives no pieces."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither the forests nor the tokenizer. Tests hold the second and last stage against
#: brute force, the first and third against their operators' rows, the fourth against its targets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
