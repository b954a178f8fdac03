"""A training corpus from documents: language ID, exact dedup, n-gram Jaccard join, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last give
back the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.llm.common import free_name
from kinsift.llm.exact_dedup import drop_exact_duplicates
from kinsift.llm.jaccard import drop_near_duplicates
from kinsift.llm.langid import UNDETERMINED, fit_filters, held_out, identify
from kinsift.llm.mixing import length_weight, mixed_documents
from kinsift.llm.packing import pack_documents
from kinsift.plans.lineage import kept, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay in which n-grams of a learned language are found more often than filters err; where none was learned, those with letters.

    Null and empty texts and those without letters go. Rows held out of training are judged like all others. Equal
    scores play no part, repeated rows are judged alike, an empty table gives no rows.
    """
    filters = fit_filters(docs.filter(~held_out(F.col("doc_id"))))
    names = free_name(docs, "lang_pred"), free_name(docs, "score")
    if not filters.languages:
        return docs.filter(F.col("text").rlike(r"\pL"))
    return identify(docs, filters, names=names).filter((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) > 0)).select(*[f"`{c}`" for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for blanks, the one with the smallest doc_id stays; null texts are empty ones, null ids come last, one of rows repeated with an id stays."""
    return drop_exact_duplicates(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.8 or more, directly or through others, the one with the smallest doc_id stays.

    Documents without words all stay; null ids come last, one of rows repeated with an id and a set of shingles stays.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it; longer ones have higher odds.

    Documents without words go; a null source is one; rows that repeat an id, a source and a size share their copies.
    """
    return mixed_documents(docs, weight=length_weight)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences; a null text is an end id alone, repeated rows are documents of their own."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has no n-gram filters, tokenizer or packing: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # what a stage has written on its way goes; its result stays for the next
        with scratch(spark) as made:
            docs = kept(stage(spark, docs, sf_dir), name, made)
    return STAGES[-1][1](spark, docs, sf_dir)
