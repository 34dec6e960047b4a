"""The corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written and read
again before the next. All but the last return the columns of ``documents``, whatever these are named.

Decisions are by row. A null or empty text is judged like any other: it has the classifier's bias as its score,
no near duplicate, no contamination and no secret, and is packed as the end id alone. Rows without an id stay apart
by their texts; of rows with equal id and text one stays (near duplicates); an id with several texts is several
documents. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, jaccard, packing, quality, secret_scans
from quarry.llm.common import fresh, shared_dir, stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects."""
    weights = quality.fit(quality.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "quality")
    names = fresh(docs, "score"), fresh(docs, "predicted")
    return quality.score(docs, weights, docs.columns, names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of alike documents the one with the least id stays."""
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark windows in a twentieth or more of their words, told by their texts."""
    digest = fresh(docs, "digest")
    docs_by = docs.withColumn(digest, jaccard.digest_of("text"))
    judged = decontamination.contamination(docs_by, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=digest)
    bad = stored(judged.where("contaminated").select(digest).distinct())
    return docs_by.join(bad.hint("shuffle_hash"), digest, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays."""
    return secret_scans.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces, each with its place in a sequence."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_filter),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can't express the classifier, the masking or the packing; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/stage{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
