"""A corpus pipeline of five stages: toxicity, language, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import decontam, langid, minhash, packing, toxicity
from furlong.llm.queries import labelled
from furlong.llm.shared import shared_dir

#: Benchmark items of fewer words are no evidence that a text holds them.
LEAST_ITEM_WORDS = 5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold; the grammar learns from all labels."""
    grammar = toxicity.fit(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.keep_clean(docs, grammar)


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is not rejected."""
    return langid.keep_known(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    Equal rows of one id are one row. Rows that share an id, but not the text, are one document of several texts, and stay or go together.
    Rows without an id stay, whatever they hold.
    """
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg((F.count("*") > 1).alias("_several"))
    mine = docs.join(kept, "doc_id")
    several = mine.where("_several").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return mine.where("not _several").select(docs.columns).unionByName(several).unionByName(docs.where(F.col("doc_id").isNull()))


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=LEAST_ITEM_WORDS, keep=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in windows of 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("language", reject_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", reject_contaminated),
    ("packing", pack),
]

#: SQL cannot express the learned stages; tests hold each stage's decisions against plain re-computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. What each returns is written to the shared folder and read again; the last one's rows are the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/furlong/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.schema(made.schema).parquet(f"{top}/{k}-{name}")
    return docs
