"""A corpus pipeline of five stages, each over all rows that its predecessor kept.

toxicity: documents scored at or above the cut go. near duplicates: one document of each group stays. secrets: every span is masked in the
text. mixing: documents are repeated or left out by source rates. packing: documents become pieces of token sequences.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from carrierlake.llm import jaccard, mixing, packing, secrets, toxicity
from carrierlake.session import delete_at_exit, remove, scratch_folder

#: Toxicity, near duplicates and packing are not expressible in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the cut; learned from the labels of the training fold.

    A row is judged by its own text: rows without doc_id too, and rows that share one apart.
    """
    labels = toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity_scores(docs, labels).where(F.col("score") < toxicity.CUT).select("row.*")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates; ``jaccard.deduplicated`` states what null and repeated ids do."""
    return jaccard.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document; secrets in its text are masked and n_chars follows. Texts without secrets stay as they are."""
    found = secrets.scan_secrets(docs)
    text = F.when(F.size("spans") > 0, secrets.redacted(secrets.text_of("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    changed = found.withColumn("_text", text).withColumn("_n", F.when(F.size("spans") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    new = {"text": F.col("_text"), "n_chars": F.col("_n")}
    return changed.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids; a repeated document is packed each time."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_group),
    ("secrets", mask_secrets),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's input.

    A stage's folder goes once the next one is written, the last one when the driver ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        else:
            delete_at_exit(spark, folder)
        before = path
    return docs
