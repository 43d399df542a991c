"""Queries of the analytics part by name, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import boards, dumps, frags, items, matches, movement, official, texts, timeline, views

_MODULES = (timeline, movement, frags, texts, boards, views, items, dumps, official, matches)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucketed health, armor and held weapons of every player of every match."""
    return timeline.buckets_first(spark, sf_dir)
