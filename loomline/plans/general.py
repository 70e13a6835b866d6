"""Queries of the general training-data problems (p1, p2, p3, p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..operators import history, orphans, units
from ..store import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.versions(history.build(table(spark, sf_dir, "instrument_ref_json")))


def p1_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history.build(table(spark, sf_dir, "instrument_ref_json"))
    return h.select(F.col("entity").alias("isin"), "valid_from", "valid_to", *history.ATTRIBUTES)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.rates_known_late(table(spark, sf_dir, "trade_feed_venue_a"), table(spark, sf_dir, "fx_rates"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.found(*orphans.load(spark, sf_dir))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.counts(*orphans.load(spark, sf_dir))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.trade_units(*[table(spark, sf_dir, n) for n in ("trade_feed_venue_a", "trade_feed_venue_b", "instrument_ref_json", "fx_rates")])


def _money(spark: SparkSession) -> DataFrame:
    return units.conversions(spark, units.money_graph(), [f"{c}|1" for c in units.CURRENCIES])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.units_found(_units(spark, sf_dir), _money(spark))


def p5_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.amounts_in_usd(store.materialize(_units(spark, sf_dir), "units"), table(spark, sf_dir, "fx_rates"))


QUERIES = {f.__name__: f for f in (p1_found, p1_history, p2_found, p3_found, p3_counts, p5_found, p5_amounts)}
