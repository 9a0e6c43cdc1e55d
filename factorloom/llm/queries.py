"""Queries of the language-model data problems (pN_...), over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import bpe, language, mixing


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_texts(read_table(spark, d, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the largest mixture of the target shares, and how often each is used."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, d)[1]


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """What the mixture breaks of its targets, which must be nothing: documents used too often, sources off their share by over two documents, unknown documents."""
    docs, shares = _mix(spark, d)
    goal = read_table(spark, d, "mix_targets").select("source", F.col("max_repeats").alias("most"))
    used = docs.join(F.broadcast(goal), "source", "left").agg(F.count(F.when(F.col("most").isNull() | (F.col("repeats") > F.col("most")), 1)).alias("too_often"), F.max("n_tokens").alias("_longest"))
    whole = shares.agg(F.sum("tokens").alias("_all"), F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("_held"))
    # one row per source
    off = shares.crossJoin(whole).crossJoin(used)
    away = F.abs(F.col("tokens") - F.col("_all") * F.col("target_share") / F.col("_held"))
    return off.agg(F.max("too_often").alias("too_often"), F.count(F.when((F.col("tokens") > 0) & (away > 2 * F.col("_longest")), 1)).alias("off_share"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return language.assign_languages(read_table(spark, d, "documents"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of missing or wrong label, and the paragraphs of mixed documents."""
    return _languages(spark, d).where(language.wrong_or_mixed()).select("doc_id", "seg_no", "lang")


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document and paragraph with its language and confidence."""
    return _languages(spark, d).select("doc_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence"), "chars")


QUERIES = {f.__name__: f for f in (p8_ids, p9_mix, p9_shares, p9_check, p10_found, p10_languages)}
ORACLES: dict[str, str] = {"p9_check": "select cast(0 as bigint) as too_often, cast(0 as bigint) as off_share"}
