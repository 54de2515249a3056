"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.llm import (byte_bpe, centroids, id_store, jaccard, line_dedup, media, mixing, neighbour_graph, phrases, ppm,
                            quality, secrets, token_counts)

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as of good quality."""
    return read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return media.stored_payloads(media.pack_text(docs))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_columns(docs, trusted_ids(spark, sf_dir), ["doc_id"], prior=quality.PRIOR)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(read(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    return found.select("doc_id", *[count(r.kind) for r in secrets.BASE_RULES],
                        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op4_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), PIECES)


def op6_token_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    store = id_store.write_ids(docs, id_store.word_encoder(WORD_TOKENIZER, END_ID), 2)
    places = id_store.look_up(store, docs.select(F.col("doc_id").alias("key"))).unionByName(id_store.keyless(store))
    return id_store.read_ids(store, places, digest=True).withColumnRenamed("key", "doc_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoding_digests(read(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"), distance=None)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(read(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", dims=64, k=40, rounds=5)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"), longest=3, least=10, inside_percent=50, top=2000)


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_graph.near_duplicates(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", threshold=0.9)


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_quality_rules, op3_secret_scans, op4_ppm_scoring, op5_token_counts,
                                   op6_token_id_store, op7_byte_bpe, op8_line_dedup, op9_ngram_jaccard, op10_source_mixing, op11_centroid_clustering,
                                   op12_phrase_collocations, op13_embedding_near_dedup)}
ORACLE_SQL = {"op10_source_mixing": mixing.MIX_SQL, "op11_centroid_clustering": centroids.cluster_sql(64, 40, 5),
              "op12_phrase_collocations": phrases.COLLOCATION_SQL}
