"""From raw documents to packed token rows: quality, near duplicates, decontamination, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, whatever others there are.

Defined results: null, empty and blank texts are rejected by the quality stage; where a later stage meets them, near duplicates and
decontamination leave them as they are, the mix takes nothing of them and they have no tokens. Rows with a null doc_id are judged by their own texts, are never
near duplicates and are packed under null. Rows that repeat a doc_id are kept or dropped by their own texts, but are one document
for near duplicates; of equal texts the smallest doc_id stays. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphscore.llm.base import staged
from graphscore.llm.decontaminate import decontaminated
from graphscore.llm.mixing import mixed
from graphscore.llm.neardup import deduplicated
from graphscore.llm.packing import packed
from graphscore.llm.quality import good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a row holds what one round takes of a document."""
    return mixed(docs)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed rows."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_packing", token_packing),
]

#: SQL can express neither the fitted vote model nor the hashes that the mix draws by: tests/llm/test_pipeline.py checks the rows of each stage
#: by brute force (which words the mix draws only by its bounds), tests/llm/test_stages.py the votes and awkward rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
