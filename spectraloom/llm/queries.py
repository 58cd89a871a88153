"""The queries of the ten operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, exact_dedup, licenses, mixing, packing, quality, scratch, simhash, token_store, toxicity

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The tokenizer's file; it is where the public_tokenizers package keeps it on each machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id"), 5, 0))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", F.size("passages").alias("n_passages"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark)
    token_store.write(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_store.read(spark, path)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, capacity=4096)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = toxicity.held_out(F.col("doc_id"), 4, 2)
    found = quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels"), ~held))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.decisions(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.formatted(turns))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("matches")


QUERIES = {"op1_toxicity": op1_toxicity, "op2_token_store": op2_token_store, "op3_packing": op3_packing, "op4_simhash": op4_simhash, "op5_exact_dedup": op5_exact_dedup, "op6_quality": op6_quality, "op7_embeddings": op7_embeddings, "op8_mixing": op8_mixing, "op9_chat": op9_chat, "op10_licenses": op10_licenses}
ORACLE_SQL: dict[str, str] = {"op5_exact_dedup": exact_dedup.SQL, "op7_embeddings": embeddings.SQL, "op8_mixing": mixing.SQL, "op9_chat": chat.SQL, "op10_licenses": licenses.SQL}
