"""The queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.llm.exact_dedup import exact_duplicates
from kinsift.llm.jaccard import jaccard_components
from kinsift.llm.langid import identify_languages
from kinsift.llm.media import find_copies, vector_planes
from kinsift.llm.mixing import length_weight, pareto_mix
from kinsift.llm.packing import Limits, pack_conversations, pack_documents
from kinsift.llm.warc import archive_and_resolve
from kinsift.llm.html_text import extract_pages
from kinsift.llm.secrets import find_secrets
from kinsift.llm.token_counts import count_sections, sentence_sections
from kinsift.sources.tables import table


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty, ties go to the smallest id; cases as exact_duplicates says."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are an end id alone, repeated ids documents of their own; cases as pack_documents says."""
    return pack_documents(table(spark, sf_dir, "documents"))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations under three limits that all bind: tokens, segments and loss-bearing tokens; cases as pack_conversations says."""
    return pack_conversations(table(spark, sf_dir, "conversations"), Limits(tokens=2048, segments=16, loss=1024))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer documents have higher odds; null texts and sources, ties and repeated ids as pareto_mix says."""
    return pareto_mix(table(spark, sf_dir, "documents"), weight=length_weight).select("doc_id", "size", "source_size", "target", "taken")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without words are linked with nothing; cases as jaccard_components says."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are null or without letters are und; ties go to the first language by name; cases as identify says."""
    return identify_languages(table(spark, sf_dir, "documents"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null pages have empty payloads, ties go to the largest page_id; cases as warc_records says."""
    return archive_and_resolve(table(spark, sf_dir, "pages"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty pages have empty texts; cases as extract_pages says."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty; cases as find_secrets says."""
    return find_secrets(table(spark, sf_dir, "documents")).drop("found")


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of whole documents; a null text is one empty section; cases as count_sections says."""
    return count_sections(table(spark, sf_dir, "documents"), sections=sentence_sections)


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images: each vector of embeddings is read as a picture of 8 x 8 cells. Every 50th asks all."""
    return find_copies(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, "vec_id", "embedding", vector_planes)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_image_copies": op10_image_copies,
    "op1_token_attribution": op1_token_attribution,
    "op7_secret_scan": op7_secret_scan,
    "op2_html_extraction": op2_html_extraction,
    "op3_packing": op3_packing,
    "instruction_packing": instruction_packing,
    "op4_source_mix": op4_source_mix,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_warc_revisits": op9_warc_revisits,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept,
               sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
}
