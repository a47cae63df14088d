"""Queries of the text problems (p6 to p8) over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import leakage, lookalike, packing
from skyloom.session import table


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "pack_limits"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of any packing: every text in containers of each capacity once, none over it, none split that fits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = p6_packing(spark, sf_dir).join(table(spark, sf_dir, "pack_limits").distinct(), "limit_id")
    whole = p.groupBy("limit_id", "capacity_tokens", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("size"))
    split = F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens")))
    texts = whole.groupBy("limit_id").agg(F.count("*").alias("n_texts"), F.sum("pieces").alias("pieces"), F.count_if(split).alias("n_wrongly_split"))
    full = p.groupBy("limit_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("held"), F.first("used").alias("used"))
    full = full.groupBy("limit_id").agg(F.count_if((F.col("held") > F.col("capacity_tokens")) | (F.col("held") != F.col("used"))).alias("n_overfull"))
    lacking = docs.select("doc_id").distinct().join(p.select("limit_id", "doc_id").distinct(), "doc_id", "left").groupBy("doc_id").agg(F.count("limit_id").alias("n"))
    n_limits = texts.agg(F.count("*").alias("n_limits"))
    lacking = lacking.join(F.broadcast(n_limits), F.col("n") < F.col("n_limits")).agg(F.count("*").alias("n_lacking"))
    return texts.join(full, "limit_id").join(F.broadcast(lacking)).select("limit_id", "n_texts", "n_wrongly_split", "n_overfull", "n_lacking")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.equal_looks(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.forms(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that looks like another of another spelling."""
    return lookalike.groups(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p6_packing": p6_packing, "p6_invariants": p6_invariants, "p7_found": p7_found, "p8_found": p8_found, "p8_forms": p8_forms, "p8_groups": p8_groups}
SQL: dict[str, str] = {
    "p6_invariants": """SELECT l.limit_id, d.n AS n_texts, CAST(0 AS BIGINT) AS n_wrongly_split, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_lacking
FROM (SELECT DISTINCT limit_id FROM pack_limits WHERE capacity_tokens > 0) l, (SELECT count(DISTINCT doc_id) AS n FROM documents) d""",
}
