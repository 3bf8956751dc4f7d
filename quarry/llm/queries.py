"""One query per training-data operator, over its whole table with production parameters, and oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, fingerprint, language, lines, media, minhash, mixing, repair, repeats, sharding, toxicity, urlfilter
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "spans")


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identified(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query
def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_features(spark, table(spark, sf_dir, "documents"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLES["op2_mixing"] = mixing.ORACLE


@query
def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


ORACLES["op4_lines"] = lines.ORACLE


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, version = sharding.sharded(table(spark, sf_dir, "documents"))
    return sharding.told(store, version)


ORACLES["op6_sharding"] = sharding.ORACLE


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.removed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark))


ORACLES["op11_urls"] = urlfilter.ORACLE


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings")).drop("candidates")


ORACLES["op12_centroids"] = centroids.ORACLE


@query
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations"))).drop("repaired")
