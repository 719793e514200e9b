"""A training corpus out of ``documents``, stage by stage; each stage is one operator of ``hedgerow.llm``.

A stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept and returns the columns of ``documents``;
the last one adds the sampling weight and probability of what it keeps.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.llm import decontam, mixing, neardup, pii, toxicity
from hedgerow.llm.shared import remainder, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar's score puts under 0.5; its weights are learnt from the labels of four fifths of the ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, remainder("doc_id", 5) != 0)
    return toxicity.toxicity(docs, model).where(F.col("toxicity") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    found = neardup.near_duplicates(docs)
    return docs.join(found.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; ``n_chars`` follows the new text."""
    redacted = pii.redact(docs, pii.fit(docs))
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the tempered margins of source, language and layout."""
    mixed = mixing.mix_sources(docs)
    return mixed.where("mix_kept").select(*COLUMNS, "mix_weight", "mix_probability")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_to_targets),
]

#: Learnt scores, redaction by message passing and fitted weights are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
