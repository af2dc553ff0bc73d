"""The registered queries opN_<name>, each over a whole table with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import oracles
from plumbline.functions.frames import join_groups
from plumbline.llm.common import saved, table
from plumbline.llm.embedding_dedup import near_duplicate_vectors
from plumbline.llm.hard_negatives import mine_hard_negatives
from plumbline.llm.langid import held_out, identify_language, language_prototypes
from plumbline.llm.line_dedup import deduplicate_lines
from plumbline.llm.minhash import near_duplicates
from plumbline.llm.packing import pack_documents
from plumbline.llm.piece_codec import encode_pieces
from plumbline.llm.pii import KINDS, find_personal_data, learn_field
from plumbline.llm.quality import quality_rules
from plumbline.llm.secrets import BASE, RULES, count_of, find_secrets, listed
from plumbline.llm.substring_dedup import remove_repeated_passages
from plumbline.llm.vector_codes import codebook_rows, encode, train_codebooks
from plumbline.llm.warc import read_archive, write_archive

Builder = Callable[[SparkSession, str], DataFrame]


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), least_cosine=0.93).drop("row")


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(table(spark, sf_dir, "pages"))
    return read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count_of(spans, r.kind).alias(f"n_{r.kind}") for r in RULES[:BASE]],
        F.sha2(listed(spans, [r.kind for r in RULES[:BASE]]), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_lines(table(spark, sf_dir, "documents"), short_copies=True).select("doc_id", "n_lines", "n_dropped", "text")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = F.filter("spans", lambda s: s["base"])
    return find_personal_data(docs, learn_field(docs)).select(
        "doc_id",
        *[count_of(base, kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language_prototypes(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return identify_language(docs, prototypes).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    codebooks = train_codebooks(vectors, scale=1024, parts=4, entries=256, rounds=4)
    digest = hashlib.sha256(",".join(str(v) for *_, v in codebook_rows(codebooks)).encode()).hexdigest()
    coded = saved(
        encode(vectors, codebooks, scale=1024).select(F.col("id").alias("vec_id"), "code", "error", F.col("source.label").alias("label")),
        "vector-codes",
    )
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return join_groups(coded, errors, ["label"]).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents"), width=13).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


QUERIES: dict[str, Builder] = {
    "op1_packing": packing,
    "op2_embedding_near_dedup": embedding_near_dedup,
    "op3_warc": warc,
    "op4_piece_codec": piece_codec,
    "op5_secrets": secrets,
    "op6_minhash": minhash,
    "op7_quality": quality,
    "op8_line_dedup": line_dedup,
    "op9_personal_data": personal_data,
    "op10_language_id": language_id,
    "op11_vector_codes": vector_codes,
    "op12_hard_negatives": hard_negatives,
    "op13_substring_dedup": substring_dedup,
}
ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": oracles.EMBEDDINGS,
    "op3_warc": oracles.WARC,
    "op5_secrets": oracles.SECRETS,
    "op6_minhash": oracles.MINHASH,
    "op11_vector_codes": oracles.VECTOR_CODES,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
    "op13_substring_dedup": oracles.SUBSTRINGS,
}
