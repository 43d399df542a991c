"""Halves and ties that a rule decides."""

from pyspark.sql import functions as F

from arenalake.functions import text as X
from arenalake.operators import points as P


def test_seconds_are_rounded_by_exact_value(spark):
    got = {r.id: r.s for r in spark.range(0, 4_000_000, 50).unionByName(spark.range(-3000, 3001)).distinct().select("id", X.seconds(F.col("id")).alias("s")).collect()}
    assert got == {n: f"{n / 1000:.1f}s" for n in got}
    assert got[250] == "0.2s" and got[350] == "0.3s" and got[750] == "0.8s"


def test_of_equal_times_the_first_position_counts(spark):
    """Two positions of one time before the probe, at it, and after it: the lower sequence counts."""
    places = [("p", 90, 2, 1), ("p", 90, 3, 2), ("q", 100, 5, 4), ("q", 100, 4, 3), ("r", 105, 7, 6), ("r", 105, 6, 5), ("t", 95, 8, 7), ("t", 95, 9, 8), ("t", 105, 9, 9)]
    positions = spark.createDataFrame([(1, *p, 0, 0) for p in places], "match_id int, player string, t_ms int, seq long, x int, y int, z int")
    probes = spark.createDataFrame([(1, p, 100) for p in "pqrt"], "match_id int, player string, t_ms int")
    assert {r.player: r.x for r in P.state_at(probes, {}, {}, positions).collect()} == {"p": 1, "q": 3, "r": 5, "t": 7}
