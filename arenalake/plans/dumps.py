"""Queries over event dumps: the given events are written as one dump a match, some with broken lines, and run in bulk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalake.sources import bulk
from arenalake.sources.lens import SQL, Lens
from arenalake.sources.shared import shared_dir


def _killers(events: DataFrame) -> DataFrame:
    """Fails on a match that has an event of this value."""
    at = lambda field: F.try_variant_get("data", f"$.{field}", "int")
    wrong = (F.col("kind") == "click") & (at("value") > 150)
    return events.groupBy("match_id").agg(F.sum(at("k")).alias("total"), F.max(F.when(wrong, "value out of range")).alias("error"))


def _kinds(events: DataFrame) -> DataFrame:
    return events.groupBy("match_id").agg(F.count_distinct("kind").alias("kinds"), F.max("t_ms").alias("last_ms"))


def _run(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a run over dumps of the given events."""
    home = f"{shared_dir(spark)}/dumps-{uuid.uuid4().hex}"
    data = F.struct("k", F.col("iv").alias("value"), "player")
    good = F.to_json(F.struct(F.col("event_type").alias("kind"), (F.col("t_ms") / 1000).alias("time"), data.alias("data")))
    line = F.when(F.col("k") == 99, F.concat(F.lit("{"), good)).when(F.col("k") == 98, F.lit('{"time": 1}')).otherwise(good)
    rows = Lens(spark, sf_dir).base.select("match_id", "seq", line.alias("value")).repartition("match_id").sortWithinPartitions("match_id", "seq")
    rows.select("match_id", "value").write.partitionBy("match_id").text(f"{home}/in")
    bulk.run_folder(spark, f"{home}/in", f"{home}/out", {"kinds": _kinds, "killers": _killers})
    return f"{home}/out"


def bulk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each dump, with what the analyzers found: null where one failed, or had nothing to read."""
    out = _run(spark, sf_dir)
    read = lambda name, schema: spark.read.schema("match_id int, " + schema).json(f"{out}/{name}")
    found = read("files", "status string, events long, bad_lines long").join(read("kinds", "kinds long, last_ms int"), "match_id", "left")
    return found.join(read("killers", "total long"), "match_id", "left")


def bulk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a run by match, analyzer and kind of error."""
    rows = spark.read.schema("match_id int, analyzer string, line int, reason string, payload string").json(f"{_run(spark, sf_dir)}/errors")
    reason = F.when(F.col("analyzer") == "reader", F.col("reason")).otherwise("raised")
    return rows.groupBy("match_id", "analyzer", reason.alias("reason")).agg(F.count("*").alias("n"), F.count("payload").alias("payloads"))


QUERIES = {f.__name__: f for f in (bulk_results, bulk_errors)}

_READ = SQL + """, cut AS (SELECT match_id, min(seq) AS seq FROM base WHERE k = 99 GROUP BY match_id),
good AS (SELECT b.* FROM base b LEFT JOIN cut USING (match_id) WHERE k NOT IN (98, 99) AND (cut.seq IS NULL OR b.seq < cut.seq)),
ill AS (SELECT DISTINCT match_id FROM good WHERE event_type = 'click' AND iv > 150)
"""
ORACLES = {
    "bulk_results": _READ + """SELECT m.match_id, CASE WHEN g.n > 0 THEN 'processed' ELSE 'failed' END AS status, coalesce(g.n, 0)::BIGINT AS events, bad_lines::BIGINT AS bad_lines, kinds::BIGINT AS kinds, last_ms,
  CASE WHEN m.match_id NOT IN (FROM ill) THEN total END::BIGINT AS total
FROM (SELECT match_id, count(*) FILTER (k IN (98, 99)) AS bad_lines FROM base GROUP BY match_id) m
LEFT JOIN (SELECT match_id, count(*) AS n, count(DISTINCT event_type) AS kinds, max(t_ms) AS last_ms, sum(k) AS total FROM good GROUP BY match_id) g USING (match_id)""",
    "bulk_errors": _READ + """SELECT match_id, 'reader' AS analyzer, CASE k WHEN 99 THEN 'unreadable' ELSE 'no kind' END AS reason, count(*) AS n, count(*) AS payloads FROM base WHERE k IN (98, 99) GROUP BY ALL
UNION ALL SELECT match_id, 'killers', 'raised', 1, 0 FROM ill""",
}
