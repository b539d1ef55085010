"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, collocations, decontam, embeddings, fertility, langid, lm, minhash, packing, sharding, token_counts, toxicity, warc
from .shared import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    """crc32 of doc_id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _remainder(7) == 2
    scored = lm.score(_table(spark, sf_dir, "documents"), ~held, public_tokenizers.path("byte_bpe_50k.json"))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_remainder(4) != 2))
    return langid.identify(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    grammar = toxicity.fit(labelled(docs, _table(spark, sf_dir, "labels")).where(_remainder(3) != 1))
    return toxicity.score(docs, grammar).select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of the documents that have a label; of several labels of one document the largest."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(marks, "doc_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/furlong/warc-{uuid.uuid4().hex}"
    warc.write(warc.as_records(_table(spark, sf_dir, "pages")), path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).cast("long")
    # header lines alone say what a revisit has; payloads are inflated for responses only, and measured again
    revisits = warc.read(spark, path, payload=False).where(F.col("record_type") == "revisit").select("record_id", "record_type", "refers_to", "payload_length", F.substring("payload_digest", 8, 64).alias("payload_digest"))
    responses = warc.read(spark, path).where(F.col("record_type") == "response").select("record_id", "record_type", "refers_to", F.length("payload").cast("long").alias("payload_length"), F.sha2("payload", 256).alias("payload_digest"))
    rows = responses.unionByName(revisits)
    return rows.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.cluster(_table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_score, op3_pack, op4_shard, op5_language, op6_toxicity, op7_warc, op8_minhash, op9_near_vectors, op10_token_counts, op11_collocations, op12_clusters, op13_quality)}
ORACLE = {"op1_decontaminate": decontam.ORACLE, "op4_shard": sharding.ORACLE, "op7_warc": warc.ORACLE, "op8_minhash": minhash.ORACLE, "op9_near_vectors": embeddings.ORACLE, "op11_collocations": collocations.ORACLE, "op12_clusters": bitplanes.ORACLE}
