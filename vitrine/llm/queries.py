"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    attribution, language, lexical, licenses, maxent, minhash, mixing, oracles, packing, permutations, quality, repair,
    repeats, secrets,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op1_hierarchical_packing(spark, folder):
    pieces = packing.pack(documents(spark, folder))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "window", "step_id",
    )


@query
def op2_minhash_components(spark, folder):
    return minhash.near_duplicates(documents(spark, folder))


@query
def op7_hypergeometric_mix(spark, folder):
    return mixing.mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_blob_ledger(spark, folder):
    docs = secrets.find_secrets(documents(spark, folder).select("doc_id", "text"))
    base = F.filter("secret_spans", lambda x: x["place"] <= len(secrets.BASE))

    def count(kind):
        return F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return docs.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"),
    )


@query
def op4_permutation_index(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return permutations.search(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op5_string_kernel(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    held_out = F.coalesce(~language.in_training(F.col("doc_id")), F.lit(False))
    return language.identify(docs).select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


@query
def op10_offset_attribution(spark, folder):
    return attribution.token_counts(documents(spark, folder))


@query
def op6_line_frequency(spark, folder):
    return quality.line_frequency(documents(spark, folder)).drop("text")


@query
def op8_license_rules(spark, folder):
    return licenses.scan_licenses(documents(spark, folder))


ORACLES["op2_minhash_components"] = oracles.NEAR_DUPLICATES
ORACLES["op3_lyndon_suffixes"] = oracles.REPEATS
ORACLES["op6_line_frequency"] = quality.ORACLE_SQL
ORACLES["op9_blob_ledger"] = oracles.SECRETS


@query
def op3_lyndon_suffixes(spark, folder):
    found = repeats.remove_repeats(documents(spark, folder))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_norm_buckets(spark, folder):
    return lexical.search(spark.read.parquet(f"{folder}/benchmark.parquet"), documents(spark, folder))


ORACLES["op13_norm_buckets"] = lexical.ORACLE_SQL


@query
def op11_grammar_repair(spark, folder):
    return repair.damage_and_repair(spark.read.parquet(f"{folder}/conversations.parquet"))


ORACLES["op11_grammar_repair"] = repair.ORACLE_SQL


@query
def op12_hashed_maxent(spark, folder):
    return maxent.learn_and_score(documents(spark, folder))
