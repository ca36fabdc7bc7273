"""From raw documents to packed training sequences, in five stages that each call one operator.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of documents; the last returns the pieces of the packed sequences. Between stages the
documents are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.llm import line_dedup, packing, quality, secrets, simhash
from keystrata.llm.common import components, written
from keystrata.session import table

#: The quality rules, the fingerprints and the vector packing aren't expressible in SQL.
ORACLE_SQL: str | None = None


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars again, where a stage has changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of windows that occurred before go."""
    return _sized(line_dedup.dedup_lines(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest id stays; rows without an id stay.

    Links are between texts, as one id may be on rows of different texts. Of repeated rows one stays.
    """
    row = F.struct(*docs.columns)
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(row).alias("whole"), row.alias("row"))
    texts = named.select(F.col("text").alias("doc_id"), F.col("row.text").alias("text"))
    fps = written(simhash.fingerprints(texts).withColumnRenamed("doc_id", "text").distinct())
    key = ["id", "text", "whole"]
    first = named.groupBy("text").agg(F.min(F.struct("id", "whole")).alias("c")).select("text", "c.*")
    found = components(simhash.links(fps.select("fp", F.col("fp").alias("rep")).distinct())).withColumnRenamed("id", "fp")
    groups = fps.join(first, "text").join(found, "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    chosen = groups.groupBy("group").agg(F.min(F.struct(*key)).alias("c")).select("c.*")
    named = named.join(chosen, key, "left_semi")
    # In the order of the join, so that whole texts are not sorted again.
    named = named.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*key))).where("nth = 1")
    return named.select("row.*").unionByName(docs.where("doc_id is null"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _sized(secrets.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 1024 tokens at most."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("secret scan", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
