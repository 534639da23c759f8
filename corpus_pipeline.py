"""A training corpus in five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._keys import numbered, unused
from plumbline.llm.decontam import contaminated
from plumbline.llm.jaccard import jaccard_join
from plumbline.llm.knn import keep_good
from plumbline.llm.packing import pack_documents
from plumbline.llm.pii import mask
from plumbline.llm.queries import quality_model, tokenizer
from plumbline.store import place

#: Neighbour votes, shared shingles and packing are no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour classifier rejects go."""
    return keep_good(docs, quality_model(docs, _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links one row stays: that of the smallest id, one without an id only where none has any."""
    row = unused(docs, "_row")
    d, renamed = numbered(docs, "doc_id", row)
    of = jaccard_join(d.select(row, "text"), row).withColumnRenamed(row, "row")
    if renamed:
        of = of.join(d.select(F.col(row).alias("row"), "doc_id"), "row")
        least = of.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("stays"))
        of = of.join(least, "component_id")
    else:
        of = of.withColumn("stays", F.col("component_id"))
    return d.join(of.where("row <> stays").select(F.col("row").alias(row)), row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into whose own text a benchmark item leaked go."""
    row = unused(docs, "_row")
    d, _ = numbered(docs, "doc_id", row)
    leaks = contaminated(d.select(row, "text"), _table(spark, sf_dir, "benchmark"), row).select(row).distinct()
    return d.join(leaks, row, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind, and n_chars follows."""
    return mask(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), 0, 2048).drop("tokens")


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = place(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
