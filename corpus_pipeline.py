"""A corpus pipeline: quality classifier, line dedup, near-duplicate removal, mixing and packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all but the
last return the columns of documents, whatever their names. ``run`` writes each stage's result as Parquet to the shared
folder and reads it again as the next one's documents. An empty table goes through every stage and gives no rows. Equal
rows, rows that share a doc_id and rows without one are rows of their own to every stage, but for what its docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.jaccard_join import jaccard_components
from framelake.llm.line_dedup import remove_repeated_chunks
from framelake.llm.mixing import mix_sources, take_mix
from framelake.llm.packing import pack_documents
from framelake.llm.quality import score_quality
from framelake.llm.scratch import Scratch, released
from framelake.llm.spread import free_name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score below 0.5). A null text is scored as an empty one. Without
    labels nothing is dropped."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels, keep=tuple(docs.columns)).where("predicted = 1").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated chunks of lines from the texts, those of one line next to another. Documents that this leaves without a word are dropped, as all
    they had is kept elsewhere; those that had none before, null texts among them, stay. Of equal chunks the one in the
    document with the smallest doc_id stays; rows that share a doc_id and a place, or have no doc_id, keep theirs alike."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = remove_repeated_chunks(docs.select("doc_id", "text", F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("others")), owner="pipeline-op1", runs=True)
    emptied = (F.col("removed_lines") > 0) & (F.trim(F.translate("text", "\t\n\r\x0b\x0c", "     ")) == "")
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*[own.get(c, F.col("others")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest doc_id, one with an id before one
    without. Texts that are null or have no word are in no group, so they stay. Rows that share a doc_id, or have none,
    are told apart: if there are any, all rows get numbers, in a table of their own."""
    key, old = free_name(docs.columns, "_row"), F.col("doc_id").cast("long")
    ids = docs.groupBy(old.alias("i")).agg(F.count("*").alias("n"))
    if ids.where("n > 1 or i is null").isEmpty():
        found = jaccard_components(docs, owner="pipeline-op5")
        first = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key))
        return docs.join(first, old == F.col(key), "left_semi")
    rows = Scratch(spark, "pipeline-rows").table("rows", docs.withColumn(key, F.monotonically_increasing_id()))
    found = jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), owner="pipeline-op5").select(F.col("doc_id").alias("r"), F.col("component_id").alias("c"))
    place = F.struct(F.col("i").isNull().alias("nameless"), "i", "r")
    first = rows.select(F.col(key).alias("k"), old.alias("i")).join(found, F.col("k") == F.col("r")).groupBy("c").agg(F.min(place).alias("first"))
    kept = free_name([*docs.columns, key], "_kept")
    return rows.join(first.select(F.col("first.r").alias(kept)), F.col(key) == F.col(kept), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources wants it; null is a source of its own. Documents without a word
    are never taken; rows that share a doc_id are taken as often as that one of them that is taken least."""
    return take_mix(docs, mix_sources(docs, owner="pipeline-op3"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into training sequences; all of them bear loss. A null text is packed as an empty one."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the trained classifier nor the random mix nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        with released():  # what the operators keep for a lazily read result goes once it is written
            docs = scratch.table(name, stage(spark, docs, sf_dir))
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
