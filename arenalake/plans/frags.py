"""Kill, streak and score queries over the lens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalake.functions.temporal import KEYS, grid
from arenalake.operators import kills as K
from arenalake.operators import regions as R
from arenalake.sources.lens import MATCH_END, SQL, Lens


def kill_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return K.kills(K.named(lens.frag_log), lens.marks("d"))


def kills_by_weapon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kills_by_weapon(Lens(spark, sf_dir).frag_log)


def kills_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kills_by_weapon(K.filter_kills(Lens(spark, sf_dir).frag_log, ["u1", "u12", "u25"], "rl"))


def weapon_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.weapon_histogram(Lens(spark, sf_dir).frag_log).withColumn("pct", F.round("pct", 4))


def team_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return K.team_totals(K.deltas(lens.frag_log), lens.players)


def life_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return K.lives(lens.marks("sp"), lens.marks("d"), F.lit(MATCH_END))


def frag_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return K.streaks(K.lives(lens.marks("sp"), lens.marks("d"), F.lit(MATCH_END)).drop("closed"), lens.frag_log)


def powerup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return K.powerup_runs(lens.interval("q"), lens.frag_log)


def guarded_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    rows = lens.base.filter("event_type in ('purchase', 'click')")
    # three or so players follow each other in a slot, for some time each
    occupant = F.concat(F.lit("o"), (F.floor(F.col("t_ms") / 250_000) % 3).cast("string"))
    return K.guarded_deltas(rows.select("match_id", (F.col("user_id") % 4).cast("int").alias("slot"), "t_ms", "seq", occupant.alias("occupant"), (F.col("iv") % 12).alias("frags")))


def frag_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return K.frag_bins(K.deltas(lens.frag_log), lens.players, 100_000)


def frags_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    probes = lens.players.select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(MATCH_END - 1), F.lit(259_200))).alias("t_ms"))
    return K.frags_at(probes, K.deltas(lens.frag_log))


def score_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return K.score_difference(grid(lens.matches, 100_000), K.deltas(lens.frag_log), lens.players, R.infer_teams(lens.players))


def duel_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    pairs = lens.players.withColumn("match_id", F.floor(F.substring("player", 2, 9).cast("int") / F.when(F.col("match_id") % 2 == 0, 2).otherwise(5)).cast("int") * 2 + F.col("match_id") % 2)
    return K.duel_teams(pairs, pairs)


def synthesized_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    frags = Lens(spark, sf_dir).frag_log
    return K.synthesize(K.deltas(frags.filter("weapon = 'axe'")), frags)


QUERIES = {f.__name__: f for f in (kill_totals, kills_by_weapon, kills_filtered, weapon_histogram, team_totals, life_runs, frag_streaks, powerup_runs, guarded_deltas, frag_bins, frags_at, score_difference, duel_teams, synthesized_deltas)}

_D = SQL + ", d AS (SELECT match_id, t_ms, seq, killer AS player, CASE WHEN is_suicide OR is_team_kill THEN -1 ELSE 1 END AS delta FROM frags)"
_KW = "SELECT match_id, killer AS player, weapon, count(*) AS kills FROM frags WHERE NOT is_suicide AND NOT is_team_kill{} GROUP BY ALL"
_LIFE = SQL + """, s AS (SELECT match_id, player, t_ms, row_number() OVER (PARTITION BY match_id, player ORDER BY t_ms) AS k FROM spawns),
e AS (SELECT match_id, player, t_ms, row_number() OVER (PARTITION BY match_id, player ORDER BY t_ms) AS r FROM deaths),
f AS (SELECT s.*, coalesce((SELECT min(r) FROM e WHERE e.match_id = s.match_id AND e.player = s.player AND e.t_ms > s.t_ms), (SELECT count(*) FROM e WHERE e.match_id = s.match_id AND e.player = s.player) + 1) AS f FROM s),
m AS (SELECT *, k + max(f - k) OVER (PARTITION BY match_id, player ORDER BY k) AS r FROM f),
life AS (SELECT m.match_id, m.player, m.t_ms AS start_ms, coalesce(e.t_ms, 2592000) AS end_ms, e.t_ms IS NOT NULL AS closed FROM m LEFT JOIN e USING (match_id, player, r))"""
ORACLES = {
    "guarded_deltas": SQL.replace("WITH base", "WITH RECURSIVE base", 1) + """, u AS (SELECT match_id, (user_id % 4)::INT AS slot, t_ms, 'o' || (floor(t_ms / 250000)::INT % 3) AS occupant, iv % 12 AS frags, row_number() OVER (PARTITION BY match_id, user_id % 4 ORDER BY t_ms, seq) AS n FROM base WHERE event_type IN ('purchase', 'click')),
r AS (SELECT match_id, slot, n, t_ms, occupant, frags AS own, NULL::INT AS delta FROM u WHERE n = 1
  UNION ALL SELECT u.match_id, u.slot, u.n, u.t_ms, u.occupant, CASE WHEN u.occupant <> r.occupant OR abs(u.frags - r.own) <= 5 THEN u.frags ELSE r.own END,
    CASE WHEN u.occupant = r.occupant AND abs(u.frags - r.own) BETWEEN 1 AND 5 THEN u.frags - r.own END FROM r JOIN u ON u.match_id = r.match_id AND u.slot = r.slot AND u.n = r.n + 1)
SELECT match_id, slot, t_ms, delta FROM r WHERE delta IS NOT NULL""",
    "kill_totals": SQL + """, own AS (SELECT match_id, killer AS player, count(*) FILTER (NOT is_suicide AND NOT is_team_kill) AS kills, count(*) FILTER (is_suicide) AS suicides, count(*) FILTER (is_team_kill) AS team_kills FROM frags GROUP BY ALL),
dead AS (SELECT match_id, player, count(*) AS deaths FROM deaths GROUP BY ALL)
SELECT match_id, player, coalesce(kills, 0) AS kills, coalesce(suicides, 0) AS suicides, coalesce(team_kills, 0) AS team_kills, coalesce(deaths, 0) AS deaths FROM own FULL JOIN dead USING (match_id, player)""",
    "kills_by_weapon": SQL + _KW.format(""),
    "kills_filtered": SQL + _KW.format(" AND weapon = 'rl' AND (killer IN ('u1', 'u12', 'u25') OR victim IN ('u1', 'u12', 'u25'))"),
    "weapon_histogram": SQL + ", n AS (SELECT match_id, weapon, count(*) AS n FROM frags GROUP BY ALL) SELECT match_id, weapon, n, round(n * 100.0 / max(n) OVER (PARTITION BY match_id), 4)::DOUBLE AS pct FROM n",
    "team_totals": _D + " SELECT match_id, team, sum(delta)::BIGINT AS frags FROM d JOIN players USING (match_id, player) GROUP BY ALL",
    "life_runs": _LIFE + " SELECT * FROM life",
    "frag_streaks": _LIFE + """, i AS (SELECT l.match_id, l.player, start_ms, end_ms, weapon, count(*) AS n FROM life l JOIN frags f ON f.match_id = l.match_id AND f.killer = l.player AND NOT is_suicide AND NOT is_team_kill AND f.t_ms BETWEEN start_ms AND end_ms GROUP BY ALL),
b AS (SELECT match_id, player, start_ms, end_ms, sum(n)::BIGINT AS frags, arg_min(weapon, (-n, weapon)) AS weapon, end_ms - start_ms AS duration_ms FROM i GROUP BY match_id, player, start_ms, end_ms)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frags DESC, duration_ms, start_ms, player)::INT AS rank FROM b) WHERE rank <= 10""",
    "powerup_runs": SQL + " SELECT i.match_id, i.player, i.start_ms, i.end_ms, (SELECT count(*) FROM frags f WHERE f.match_id = i.match_id AND f.killer = i.player AND NOT is_suicide AND NOT is_team_kill AND f.t_ms BETWEEN i.start_ms AND i.end_ms) AS frags, i.end_ms - i.start_ms AS duration_ms FROM intervals i WHERE field = 'q'",
    "frag_bins": _D + " SELECT match_id, team, floor(t_ms / 100000)::INT AS bin, sum(delta)::BIGINT AS delta FROM d JOIN players USING (match_id, player) GROUP BY ALL",
    "frags_at": _D + ", p AS (SELECT match_id, player, b * 259200 AS t_ms FROM players, range(0, 10) r(b)) SELECT match_id, player, t_ms::INT AS t_ms, coalesce((SELECT sum(delta) FROM d WHERE d.match_id = p.match_id AND d.player = p.player AND d.t_ms <= p.t_ms), 0)::BIGINT AS frags FROM p",
    "score_difference": _D + """, teams AS (SELECT match_id, min(team) AS a, max(team) AS b FROM players GROUP BY match_id HAVING count(DISTINCT team) > 1),
x AS (SELECT match_id, t_ms, CASE team WHEN a THEN delta WHEN b THEN -delta ELSE 0 END AS delta FROM d JOIN players USING (match_id, player) JOIN teams USING (match_id))
SELECT match_id, b::INT AS bucket, (b * 100000)::INT AS t_ms, coalesce((SELECT sum(delta) FROM x WHERE x.match_id = m.match_id AND x.t_ms <= b * 100000), 0)::BIGINT AS diff FROM matches m, range(0, 26) r(b)""",
    "duel_teams": SQL + ", q AS (SELECT floor(substr(player, 2)::INT / CASE WHEN match_id % 2 = 0 THEN 2 ELSE 5 END)::INT * 2 + match_id % 2 AS match_id, player, team FROM players) SELECT match_id, player, CASE WHEN (SELECT count(DISTINCT player) FROM q r WHERE r.match_id = q.match_id) = 2 THEN player ELSE team END AS team FROM q",
    "synthesized_deltas": _D + ", own AS (SELECT d.* FROM d JOIN frags f USING (match_id, seq) WHERE weapon = 'axe') SELECT match_id, t_ms, seq, player, delta FROM own UNION ALL SELECT match_id, t_ms, seq, player, delta FROM d ANTI JOIN own USING (match_id, player)",
}
