"""Queries of the problems tagged llm (p4, p6, p7, p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import table
from . import bpe, linkage, mixing, spam, sql


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.repeated(table(spark, sf_dir, "files"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, digest): the MD5 of each text encoded and decoded again; null texts come back empty."""
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.md5("text").alias("digest"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.pages(table(spark, sf_dir, "documents")).where("flagged").select("doc_id")


def p8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.pages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p6_ids, p6_round_trip, p7_mixture, p7_shares, p8_found, p8_pages)}
ORACLES = sql.ORACLES
