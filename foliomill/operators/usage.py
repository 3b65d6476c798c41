"""Result cache and token usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_usage(results: DataFrame) -> DataFrame:
    """``op, results, tokens, cached`` — results delivered twice (result_id) count once; cached ones have 0 tokens."""
    once = results.groupBy("result_id", "op").agg(F.max("total_tokens").alias("total_tokens"))
    return once.groupBy("op").agg(F.count(F.lit(1)).alias("results"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("total_tokens") == 0).alias("cached"))


def cache_key(prefix: Column, payload: Column, models: Column) -> Column:
    """Content-addressed key: SHA-256 of operation, arguments and the hash of the model names."""
    return F.sha2(F.concat_ws(":", prefix, payload, F.sha2(models, 256)), 256)


def cache_entries(results: DataFrame) -> DataFrame:
    """One row per key: ``cache_key, op, first_id, uses`` — the earliest result fills the cache, later ones hit it."""
    w = Window.partitionBy("cache_key").orderBy("created_at", "result_id")
    once = results.where("cache_key IS NOT NULL").select("cache_key", "op", "result_id", "created_at").distinct()
    first = once.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("cache_key", "op", F.col("result_id").alias("first_id"))
    return first.join(once.groupBy("cache_key").agg(F.countDistinct("result_id").alias("uses")), "cache_key")


def answered_before(results: DataFrame) -> DataFrame:
    """Results (result_id, cache_key, op, created_at) with ``hit``: whether an earlier one had their key; null keys never hit."""
    once = results.select("result_id", "cache_key", "op", "created_at").distinct()
    first = once.where("cache_key IS NOT NULL").groupBy("cache_key").agg(F.min(F.struct("created_at", "result_id")).alias("first"))
    met = once.join(first, "cache_key", "left")
    return met.withColumn("hit", F.coalesce(F.struct("created_at", "result_id") > F.col("first"), F.lit(False))).drop("first")


def with_cache(work: DataFrame, cache: DataFrame, bypass: bool = False) -> DataFrame:
    """Work items (cache_key, ...) with ``hit``; bypassing skips reading only."""
    if bypass:
        return work.withColumn("hit", F.lit(False))
    known = cache.select("cache_key", F.lit(True).alias("_h")).distinct()
    return work.join(known, "cache_key", "left").withColumn("hit", F.coalesce("_h", F.lit(False))).drop("_h")
