"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.llm import chat, fingerprints, langid, licenses, media, media_build, mixing, ngram_join, ngram_join_sql, packing, sharding, sharding_sql, suffix_dedup, suffix_dedup_sql
from orrery.llm.common import table


def op1_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op4_chat_format(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_pareto_mix(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_lpt_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), F.md5("text"), F.length("text"))


def op8_length_buckets(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_media_columns(spark, sf_dir):
    files = media_build.from_pages(table(spark, sf_dir, "pages"))
    spots = F.concat_ws(",", F.transform("keyframes", lambda k: F.concat_ws(":", k.offset, k.size)))
    return media.media_columns(files, "page_id", "media").withColumn("keyframes", F.when(F.col("keyframes").isNotNull(), spots))


def op10_document_fingerprints(spark, sf_dir):
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_ngram_jaccard_join,
        op3_suffix_array_dedup,
        op4_chat_format,
        op5_pareto_mix,
        op6_language_id,
        op7_lpt_shards,
        op8_length_buckets,
        op9_media_columns,
        op10_document_fingerprints,
    )
}
ORACLE = {
    "op2_ngram_jaccard_join": ngram_join_sql.SQL,
    "op3_suffix_array_dedup": suffix_dedup_sql.SQL,
    "op4_chat_format": chat.SQL,
    "op5_pareto_mix": mixing.SQL,
    "op7_lpt_shards": sharding_sql.SQL,
    "op8_length_buckets": packing.SQL,
    "op9_media_columns": media_build.SQL,
    "op10_document_fingerprints": fingerprints.SQL,
}
