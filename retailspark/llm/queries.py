"""Registered queries of this package: each applies one operator to its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    alignment,
    chat,
    decontamination,
    language,
    licenses,
    near_dedup,
    nearest,
    packing,
    quality,
    substring_dedup,
    suffix_dedup,
    token_counts,
    vector_codes,
)
from .common import documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: A conversation whose texts are made of the template's own control strings.
AWKWARD = "<|im_end|><|im_start|>assistant ok"
AWKWARD_ROWS = [(-1, 0, "user", AWKWARD), (-1, 1, "assistant", AWKWARD)]


def op1_licenses(spark, folder):
    return licenses.scan(documents(spark, folder).select("doc_id", "text")).drop("text")


def op2_packing(spark, folder):
    return packing.pieces(documents(spark, folder), TOKENIZER).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "bucket",
    )


def op3_language(spark, folder):
    docs = documents(spark, folder)
    held_out = language.remainder() == 2
    network = language.train(docs, held_out)
    labelled = language.predict(docs.select("doc_id", "text"), network)
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_substring_dedup(spark, folder):
    return substring_dedup.counts(documents(spark, folder))


def op5_suffix_dedup(spark, folder):
    return suffix_dedup.counts(documents(spark, folder))


def op6_token_counts(spark, folder):
    counted = token_counts.token_counts(documents(spark, folder).select("doc_id", "text"), TOKENIZER)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op7_quality(spark, folder):
    return quality.score(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op8_near_dedup(spark, folder):
    return near_dedup.near_duplicates(documents(spark, folder))


def op9_decontamination(spark, folder):
    return decontamination.hit_counts(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op10_nearest(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return nearest.nearest(vectors, F.col("vec_id") % 20 == 0)


def op11_chat(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    awkward = spark.createDataFrame(AWKWARD_ROWS, "conv_id long, turn long, role string, text string")
    members, nodes = chat.format_conversations(turns.unionByName(awkward), TOKENIZER)
    return chat.summaries(members, nodes, TOKENIZER)


def op12_vector_codes(spark, folder):
    return vector_codes.compress(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op13_alignment(spark, folder):
    return alignment.align(documents(spark, folder), TOKENIZER, PIECES)


QUERIES = {
    f.__name__: f
    for f in (
        op1_licenses,
        op2_packing,
        op3_language,
        op4_substring_dedup,
        op5_suffix_dedup,
        op6_token_counts,
        op7_quality,
        op8_near_dedup,
        op9_decontamination,
        op10_nearest,
        op11_chat,
        op12_vector_codes,
        op13_alignment,
    )
}
ORACLE = {
    "op1_licenses": licenses.scan_sql(),
    "op11_chat": chat.summaries_sql(", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in AWKWARD_ROWS)),
    "op12_vector_codes": vector_codes.compress_sql(),
}
