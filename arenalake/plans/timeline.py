"""Bucket, point, slice and trail queries over the lens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from arenalake.functions import fields
from arenalake.functions.temporal import KEYS, grid
from arenalake.operators import buckets as B
from arenalake.operators import points as P
from arenalake.sources.lens import MATCH_END, SQL, Lens

DAY = 86_400


def _cells(lens: Lens, window_ms: int = DAY) -> DataFrame:
    return B.cells(grid(lens.matches, window_ms), lens.players)


def _rows(lens: Lens, window_ms: int = DAY, more: tuple[str, ...] = ()) -> DataFrame:
    streams = {"h": (lens.number("h"), "number", "first"), "a": (lens.number("a"), "number", "first")} | {f: (lens.interval(f), "interval", "first") for f in ("rl", "lg", "q", *more)}
    if more:
        streams["at"] = lens.armor_type, "text", "first"
    return B.table(_cells(lens, window_ms), streams, (lens.marks("sp"), lens.marks("d"), lens.positions))


def buckets_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(Lens(spark, sf_dir)).select(*B.CELL, "b_start", "h", "a", "rl", "lg", "q")


def buckets_columnar(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["h", "a", "rl", "lg", "q"]
    return B.from_columns(B.to_columns(_rows(Lens(spark, sf_dir)), fields), fields)


def _swing(samples: Column) -> Column:
    """How far a value moves within its samples, up and down together."""
    n = F.size(samples)
    steps = F.zip_with(F.slice(samples, F.lit(2), n), F.slice(samples, F.lit(1), n - 1), lambda a, b: F.abs(a - b))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def _middle(v: Column) -> Column:
    """The median, by a grouped-aggregate pandas UDF."""

    def median(values: pd.Series) -> float:
        return values.median()

    return F.pandas_udf(median, DoubleType())(v.cast("double"))


fields.register_reducer("swing", _swing, empty=0)
fields.register_reducer("middle", _middle, grouped=True)


def _reduced(kind: str, field: str, reducer: str | None, value: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lens = Lens(spark, sf_dir)
        stream = {"number": lambda: lens.number(field), "text": lambda: lens.armor_type, "interval": lambda: lens.interval(field), "mark": lambda: lens.marks(field), "position": lambda: lens.positions.withColumn("v", F.col("x"))}[kind]()
        out = B.table(_cells(lens), {"value": (stream, kind, reducer)}, fill=False).select(*B.CELL, "value")
        return out.withColumn("value", F.round(F.col("value").cast("double"), 6) if value == "double" else F.col("value").cast(value))

    return query


def team_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return B.team_counters(_rows(lens, more=("gl", "pe", "r")), lens.players)


def team_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return B.stacked(B.team_counters(_rows(lens), lens.players), ["rllg", "rl", "lg"])


def bucket_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(Lens(spark, sf_dir).matches, 100_000)


def bucket_grid_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(Lens(spark, sf_dir).matches, 1_000_000, 500_000, 2_400_000, "half_up").drop("partial")


def _probes(lens: Lens) -> DataFrame:
    return lens.players.select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(MATCH_END - 1), F.lit(DAY))).alias("t_ms"))


def state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return P.state_at(_probes(lens), {"h": lens.number("h"), "a": lens.number("a")}, {f: lens.interval(f) for f in ("rl", "lg", "q")}, lens.positions)


def stream_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return P.slice_changes(lens.number("h"), lens.players, 600_000, 1_800_000)


def interval_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.slice_intervals(Lens(spark, sf_dir).interval("rl"), 600_000, 1_800_000)


def health_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.deltas(Lens(spark, sf_dir).number("h"), 600_000, 1_800_000)


def events_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    frag = lens.frag_log.select("match_id", "t_ms", F.col("killer").alias("player"), F.concat_ws(" ", "weapon", "victim").alias("detail"))
    mark = lambda m: lens.marks(m).select(*KEYS, "t_ms", F.lit("").alias("detail"))
    parts = {"frag": frag, "spawn": mark("sp"), "death": mark("d"), "weapon": P.gains_and_losses(lens.interval("rl"), "rl").unionByName(P.gains_and_losses(lens.interval("lg"), "lg")), "item": P.gains_and_losses(lens.interval("q"), "q")}
    parts["health"] = P.deltas(lens.number("h"), 0, 0).withColumn("detail", F.col("v"))
    return P.events(parts, None, 300_000, 2_000_000)


QUERIES = {f.__name__: f for f in (buckets_first, buckets_columnar, team_counters, team_series, bucket_grid, bucket_grid_rounded, state_at, stream_slice, interval_slice, health_deltas, events_timeline)}

_CELLS = SQL + """, cell AS (SELECT match_id, player, b AS bucket, b * 86400 AS b_start, least((b + 1) * 86400, 2592000) AS b_end FROM (SELECT DISTINCT match_id, player FROM base), range(0, 30) r(b)),
marks AS (SELECT match_id, player, t_ms, 1 AS up FROM spawns UNION ALL SELECT match_id, player, t_ms, 0 FROM deaths),
alive AS (SELECT c.* FROM cell c WHERE
  EXISTS (SELECT 1 FROM spawns s WHERE s.match_id = c.match_id AND s.player = c.player AND s.t_ms >= c.b_start AND s.t_ms < c.b_end)
  OR CASE (SELECT max(m.t_ms * 2 + m.up) FROM marks m WHERE m.match_id = c.match_id AND m.player = c.player AND m.t_ms < c.b_start) % 2 WHEN 1 THEN true WHEN 0 THEN false ELSE
    EXISTS (SELECT 1 FROM positions p WHERE p.match_id = c.match_id AND p.player = c.player AND p.t_ms >= c.b_start - 100 AND p.t_ms < c.b_end)
    OR NOT EXISTS (SELECT 1 FROM marks m WHERE m.match_id = c.match_id AND m.player = c.player) AND NOT EXISTS (SELECT 1 FROM positions p WHERE p.match_id = c.match_id AND p.player = c.player) END)"""
_CARRY = "(SELECT arg_max(x.v, (x.t_ms, x.seq)) FROM changes x WHERE x.field = '{f}' AND x.match_id = c.match_id AND x.player = c.player AND x.t_ms <= c.b_start)"
_FIRST = "coalesce(" + _CARRY + ", (SELECT arg_min(x.v, (x.t_ms, x.seq)) FROM changes x WHERE x.field = '{f}' AND x.match_id = c.match_id AND x.player = c.player AND x.t_ms > c.b_start AND x.t_ms < c.b_end))"
_HELD = "CASE WHEN EXISTS (SELECT 1 FROM intervals i WHERE i.field = '{f}' AND i.match_id = c.match_id AND i.player = c.player) THEN EXISTS (SELECT 1 FROM intervals i WHERE i.field = '{f}' AND i.match_id = c.match_id AND i.player = c.player AND i.start_ms <= c.b_start AND c.b_start < i.end_ms) END"
_FIELDS = ", ".join(f"{_FIRST.format(f=f)} AS {f}" for f in ("h", "a")) + ", " + ", ".join(f"{_HELD.format(f=f)} AS {f}" for f in ("rl", "lg", "q"))
_ROWS = _CELLS + f", bucket_rows AS (SELECT * FROM (SELECT match_id, player, bucket, b_start, {_FIELDS} FROM alive c) WHERE coalesce(h::VARCHAR, a::VARCHAR, rl::VARCHAR, lg::VARCHAR, q::VARCHAR) IS NOT NULL)"
_WIDE = ", ".join(f"coalesce({_HELD.format(f=f)}, false) AS {f}" for f in ("rl", "lg", "q", "gl", "pe", "r"))
_TEAMS = _CELLS + f""", wide AS (SELECT match_id, player, bucket, {_FIRST.format(f="h")} AS h, {_FIRST.format(f="a")} AS a, {_FIRST.format(f="at")} AS kind, {_WIDE} FROM alive c),
counters AS (SELECT match_id, bucket, team, count(*) FILTER (rl AND lg) AS rllg, count(*) FILTER (rl AND NOT lg) AS rl, count(*) FILTER (lg AND NOT rl) AS lg, count(*) FILTER (rl OR lg) AS w, count(*) FILTER (gl) AS gl,
  count(*) FILTER (q) AS q, count(*) FILTER (pe) AS pe, count(*) FILTER (r) AS r, coalesce(sum(h), 0)::BIGINT AS th, coalesce(sum(a), 0)::BIGINT AS ta, count(*) FILTER (kind = 3) AS abt_ra, count(*) FILTER (kind = 2) AS abt_ya, count(*) FILTER (kind = 1) AS abt_ga,
  count(*) FILTER (q) + count(*) FILTER (pe) + count(*) FILTER (r) AS pw FROM wide JOIN players USING (match_id, player) GROUP BY match_id, bucket, team)"""
_SET = _CELLS + """, sample AS (
  SELECT field, match_id, player, bucket, b_start AS t_ms, -1 AS seq, v FROM (SELECT x.field, c.match_id, c.player, c.bucket, c.b_start, arg_max(x.v, (x.t_ms, x.seq)) AS v
    FROM cell c JOIN changes x ON x.match_id = c.match_id AND x.player = c.player AND x.t_ms <= c.b_start GROUP BY ALL) UNION ALL
  SELECT x.field, c.match_id, c.player, c.bucket, x.t_ms, x.seq, x.v FROM cell c JOIN changes x ON x.match_id = c.match_id AND x.player = c.player AND x.t_ms > c.b_start AND x.t_ms < c.b_end),
probe AS (SELECT i.field, c.match_id, c.player, c.bucket, k, CAST(trunc(c.b_start + k * (c.b_end - c.b_start) / 8) AS INT) AS t FROM cell c JOIN (SELECT DISTINCT field, match_id, player FROM intervals) i USING (match_id, player), range(0, 8) r(k)),
held AS (SELECT p.*, EXISTS (SELECT 1 FROM intervals i WHERE i.field = p.field AND i.match_id = p.match_id AND i.player = p.player AND i.start_ms <= p.t AND p.t < i.end_ms) AS v FROM probe p)
"""
_BY = " FROM sample WHERE field = '{f}' GROUP BY match_id, player, bucket"
_PICK = "SELECT match_id, player, bucket, "

ORACLES = {
    "buckets_first": _ROWS + " SELECT * FROM bucket_rows",
    "buckets_columnar": _ROWS + " SELECT match_id, player, bucket, h, a, rl, lg, q FROM bucket_rows",
    "team_counters": _TEAMS + " SELECT * FROM counters",
    "team_series": _TEAMS + """, part AS (SELECT match_id, team, bucket, unnest([0, 1, 2]) AS place, unnest(['rllg', 'rl', 'lg']) AS field, unnest([rllg, rl, lg]) AS v FROM counters),
s AS (SELECT *, sum(v) OVER (PARTITION BY match_id, team, bucket ORDER BY place) AS hi FROM part)
SELECT match_id, team, bucket, field, (hi - v)::BIGINT AS low, hi::BIGINT AS high, (max(hi) OVER (PARTITION BY match_id))::BIGINT AS top FROM s""",
    "bucket_grid": SQL + " SELECT match_id, b::INT AS bucket, (b * 100000)::INT AS b_start, least((b + 1) * 100000, 2592000)::INT AS b_end, (b + 1) * 100000 > 2592000 AS partial FROM matches, range(0, 26) r(b)",
    "bucket_grid_rounded": SQL + " SELECT match_id, b::INT AS bucket, (500000 + b * 1000000)::INT AS b_start, (500000 + (b + 1) * 1000000)::INT AS b_end FROM matches, range(0, 2) r(b)",
    "state_at": SQL + """, probe AS (SELECT match_id, player, b * 86400 AS t_ms FROM (SELECT DISTINCT match_id, player FROM base), range(0, 30) r(b))
SELECT p.match_id, p.player, p.t_ms::INT AS t_ms,
  (SELECT arg_max(v, (t_ms, seq)) FROM changes x WHERE field = 'h' AND x.match_id = p.match_id AND x.player = p.player AND x.t_ms <= p.t_ms) AS h,
  (SELECT arg_max(v, (t_ms, seq)) FROM changes x WHERE field = 'a' AND x.match_id = p.match_id AND x.player = p.player AND x.t_ms <= p.t_ms) AS a,
""" + ", ".join(f"EXISTS (SELECT 1 FROM intervals i WHERE field = '{f}' AND i.match_id = p.match_id AND i.player = p.player AND i.start_ms <= p.t_ms AND p.t_ms < i.end_ms) AS {f}" for f in ("rl", "lg", "q")) + "".join(f", (SELECT arg_min({c}, (abs(x.t_ms - p.t_ms), x.t_ms, x.seq)) FROM positions x WHERE x.match_id = p.match_id AND x.player = p.player) AS {c}" for c in "xyz") + " FROM probe p",
    "stream_slice": SQL + """, rows AS (SELECT match_id, player, 600000 AS t_ms, -1 AS seq, arg_max(v, (t_ms, seq)) AS v FROM changes WHERE field = 'h' AND t_ms < 600000 GROUP BY match_id, player
  UNION ALL SELECT match_id, player, t_ms, seq, v FROM changes WHERE field = 'h' AND t_ms >= 600000 AND t_ms < 1800000)
SELECT match_id, player, t_ms, v FROM (SELECT *, lag(v) OVER (PARTITION BY match_id, player ORDER BY t_ms, seq) AS was FROM rows) WHERE was IS DISTINCT FROM v""",
    "interval_slice": SQL + " SELECT match_id, player, greatest(start_ms, 600000) AS start_ms, least(end_ms, 1800000) AS end_ms FROM intervals WHERE field = 'rl' AND end_ms > 600000 AND start_ms < 1800000",
    "health_deltas": SQL + """, n AS (SELECT match_id, player, seq, t_ms, v, row_number() OVER (PARTITION BY match_id, player ORDER BY t_ms, seq) AS i FROM changes WHERE field = 'h')
SELECT match_id, player, seq, t_ms, v, CASE WHEN i > 1 THEN v - lag(v, 1, 0) OVER (PARTITION BY match_id, player ORDER BY t_ms, seq) END AS delta FROM n WHERE t_ms BETWEEN 600000 AND 1800000""",
    "events_timeline": SQL + """, e AS (SELECT match_id, t_ms, 'frag' AS type, killer AS player, weapon || ' ' || victim AS detail FROM frags
  UNION ALL SELECT match_id, t_ms, 'spawn', player, '' FROM spawns UNION ALL SELECT match_id, t_ms, 'death', player, '' FROM deaths
  UNION ALL SELECT match_id, start_ms, CASE field WHEN 'q' THEN 'item' ELSE 'weapon' END, player, 'gain ' || field FROM intervals WHERE field IN ('rl', 'lg', 'q')
  UNION ALL SELECT match_id, end_ms, CASE field WHEN 'q' THEN 'item' ELSE 'weapon' END, player, 'lose ' || field FROM intervals WHERE field IN ('rl', 'lg', 'q'))
SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY t_ms, type, player, detail)::INT AS pos FROM e WHERE t_ms BETWEEN 300000 AND 2000000""",
}
for _name, _spec, _sql in (
    ("reduce_last", ("number", "h", "last", "int"), _PICK + "arg_max(v, (t_ms, seq))::INT AS value" + _BY.format(f="h")),
    ("reduce_swing", ("number", "h", "swing", "int"), _PICK + "coalesce(sum(abs(v - was)), 0)::INT AS value FROM (SELECT *, lag(v) OVER (PARTITION BY match_id, player, bucket ORDER BY t_ms, seq) AS was FROM sample WHERE field = 'h') GROUP BY match_id, player, bucket"),
    ("reduce_middle", ("number", "a", "middle", "double"), _PICK + "round(median(v), 6)::DOUBLE AS value" + _BY.format(f="a")),
    ("reduce_default", ("number", "h", None, "int"), _PICK + "arg_min(v, (t_ms, seq))::INT AS value" + _BY.format(f="h")),
    ("reduce_mean", ("number", "h", "mean", "double"), _PICK + "round(avg(v::DOUBLE), 6) AS value" + _BY.format(f="h")),
    ("reduce_min", ("number", "h", "min", "double"), _PICK + "min(v)::DOUBLE AS value" + _BY.format(f="h")),
    ("reduce_max", ("number", "a", "max", "double"), _PICK + "max(v)::DOUBLE AS value" + _BY.format(f="a")),
    ("reduce_dominant", ("text", "at", "dominant", "string"), "SELECT match_id, player, bucket, arg_max(['', 'ga', 'ya', 'ra'][v + 1], (n, t, s)) AS value FROM (SELECT match_id, player, bucket, v, count(*) AS n, max(t_ms) AS t, max(seq) AS s FROM sample WHERE field = 'at' GROUP BY ALL) GROUP BY match_id, player, bucket"),
    ("reduce_held_any", ("interval", "rl", "held-any", "boolean"), _PICK + "bool_or(v) AS value FROM held WHERE field = 'rl' GROUP BY match_id, player, bucket"),
    ("reduce_majority", ("interval", "lg", "majority", "boolean"), _PICK + "2 * count(*) FILTER (v) >= count(*) AS value FROM held WHERE field = 'lg' GROUP BY match_id, player, bucket"),
    ("reduce_any", ("mark", "sp", "any", "boolean"), "SELECT DISTINCT c.match_id, c.player, bucket, true AS value FROM cell c JOIN spawns s ON s.match_id = c.match_id AND s.player = c.player AND s.t_ms >= b_start AND s.t_ms < b_end"),
    ("reduce_position", ("position", "pos", "first", "int"), "SELECT match_id, player, bucket, coalesce((SELECT arg_min(x, (t_ms, seq)) FROM positions p WHERE p.match_id = c.match_id AND p.player = c.player AND p.t_ms >= b_start AND p.t_ms < b_end), (SELECT arg_max(x, (t_ms, seq)) FROM positions p WHERE p.match_id = c.match_id AND p.player = c.player AND p.t_ms <= b_start)) AS value FROM cell c WHERE EXISTS (SELECT 1 FROM positions p WHERE p.match_id = c.match_id AND p.player = c.player AND p.t_ms < b_end)"),
):
    QUERIES[_name] = _reduced(*_spec)
    ORACLES[_name] = _SET + _sql
