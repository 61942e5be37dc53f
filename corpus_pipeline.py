"""From raw documents to packed token sequences: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, whatever
columns those are.  An empty table passes through; null texts count as empty ones, null sources as one
source; rows that repeat, or lack, a doc_id are documents of their own but for the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from foliospark.llm import mixing, near_duplicates, packing, quality, secrets
from foliospark.llm.common import forget, read, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_quality(docs, read(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8).

    Of rows that repeat a doc_id the one with the least text (then other columns) stays; rows without a
    doc_id all stay.
    """
    marked = near_duplicates.near_duplicates(docs, k=5)
    kept = marked.where("kept").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("_kept")).distinct()
    mine = docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    order = ["text", *[f.name for f in docs.schema if isinstance(f.dataType, AtomicType) and f.name != "text"]]
    one = mine.groupBy("doc_id").agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")
    return one.union(docs.where("doc_id IS NULL"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found in a text are replaced by their kind in brackets."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their place in the training sequences."""
    from foliospark.llm.registry import tokenizer_path

    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier and the tokenizer cannot be stated in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are a table in the shared folder, deleted once the next stage's are written."""
    docs, held = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        done = table(stage(spark, docs, sf_dir), "pipeline")
        if held is not None:
            forget(held)
        docs = held = done
    return STAGES[-1][1](spark, docs, sf_dir)
