"""From raw documents to a training mixture in five stages, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybird.llm.decontaminate import drop_contaminated
from tallybird.llm.mixing import mix_sources
from tallybird.llm.ngram_join import drop_near_duplicates
from tallybird.llm.quality import ACCEPT, fit_quality, score_quality
from tallybird.llm.secret_ledger import redact_documents
from tallybird.llm.staging import new_folder
from tallybird.llm.texts import remainder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Without labels of both kinds there is no classifier, and
    all documents stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, remainder(labels["doc_id"], 4) != 2)
    if model.layers is None:
        return docs
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return score_quality(docs, model, name).where(F.col(name) >= ACCEPT).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays."""
    return redact_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with the words taken of each: its columns, size, source_size, target
    and taken."""
    mixed = mix_sources(docs, keep=docs.columns)
    return mixed.where("taken > 0").select("row.*", "size", "source_size", "target", "taken")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: A trained network and edit distances are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read by
    the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
