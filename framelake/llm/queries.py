"""The queries of this subpackage, with their production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm.ann import nearest_neighbours
from framelake.llm.html_text import extract_main_text
from framelake.llm.jaccard_join import jaccard_components
from framelake.llm.language_id import identify_languages
from framelake.llm.line_dedup import SQL as LINE_DEDUP_SQL
from framelake.llm.line_dedup import remove_repeated_chunks
from framelake.llm.mixing import mix_sources
from framelake.llm.multi_index import near_duplicate_vectors
from framelake.llm.packing import pack_documents
from framelake.llm.quality import score_quality
from framelake.llm.warc import SQL as WARC_SQL
from framelake.llm.warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).drop("copies")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op8_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_html_extraction": op6_html_extraction,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_approximate_neighbours": op8_approximate_neighbours,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP_SQL,
    "op4_warc": WARC_SQL,
}
