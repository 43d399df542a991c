"""Queries over official scoreboards, made of the events' players, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalake.functions.temporal import KEYS
from arenalake.operators import kills as K
from arenalake.operators import official as O
from arenalake.operators import scoreboard as S
from arenalake.plans.boards import _BOARD as BOARD_SQL
from arenalake.plans.boards import _board
from arenalake.sources.lens import MATCH_END, SQL, Lens


def board(lens: Lens) -> DataFrame:
    """A board of every match, with gaps: third players lack weapons, items, damage or a team."""
    rows = lens.base.groupBy(*KEYS, "team", "user_id").agg(F.count("*").alias("n"), F.sum("k").alias("s"))
    n, s = F.col("n").cast("int"), F.col("s").cast("int")
    weapon = lambda k: F.struct((s % (7 + k)).alias("hits"), (n * k % 41).alias("attacks"), (s % 3 * k).alias("kills"), (n % 5 + k).alias("enemy_kills"), (s % 300).alias("damage"), (n % 9).alias("taken"), (s % 4).alias("dropped"), (n % 9 + k).alias("total_taken"), (n % 4).alias("spawn_taken"), (n % 4 + k % 2).alias("spawn_total_taken"))
    item = lambda k: F.struct((s % (3 + k)).alias("took"), (n * k % 50).alias("time"))
    third = F.col("user_id") % 3
    weapons = F.when(third == 0, F.create_map(F.lit("rl"), weapon(1), F.lit("lg"), weapon(2), F.lit("sg"), weapon(3))).when(third == 1, F.create_map(F.lit("rl"), weapon(4), F.lit("gl"), weapon(5)))
    items = F.when(third != 0, F.create_map(F.lit("ra"), item(1), F.lit("q"), item(2), F.lit("health_100"), item(3), F.lit("ya"), item(4)))
    stats = F.struct((s % 60 - 5).alias("frags"), (n % 40).alias("kills"), (s % 33).alias("deaths"), (n % 3).alias("tk"), (s % 2).alias("suicides"))
    dmg = F.when(third != 2, F.struct((s * 3).alias("given"), (n * 5).alias("taken"), (s % 500).alias("enemy_weapons"), (n % 150).alias("taken_to_die")))
    return rows.select(*KEYS, F.when(F.col("user_id") % 7 != 0, F.col("team")).alias("team"), (n % 60).alias("ping"), (s % 3).alias("xfer_rl"), F.when(third == 0, n % 2).alias("xfer_lg"), stats.alias("stats"), dmg.alias("dmg"), weapons.alias("weapons"), items.alias("items"))


def official_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.player_stats(board(Lens(spark, sf_dir)))


def official_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.player_stats(board(Lens(spark, sf_dir)), by_team=True)


def official_weapons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.weapon_stats(board(Lens(spark, sf_dir)), by_team=True)


def official_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.item_stats(board(Lens(spark, sf_dir)), by_team=True)


def _pickups(lens: Lens) -> tuple[DataFrame, DataFrame]:
    """Weapon pickups, and takes of entities; third by nobody."""
    team = F.when(F.col("user_id") % 7 != 0, F.col("team")).otherwise("")
    clicks = lens.base.filter("event_type = 'click'").withColumn("team", team)
    weapon = F.get(F.array(*map(F.lit, ("rl", "lg", "gl", "sg"))), F.col("k") % 4)
    source = F.when(F.col("k") % 4 < 2, F.when(F.col("iv") % 2 == 0, "backpack")).otherwise(None)
    weapons = clicks.select(*KEYS, "team", weapon.alias("weapon"), F.coalesce(source, F.lit("world")).alias("source"), (F.col("iv") % 3 == 0).alias("had_before"))
    kind = F.get(F.array(*map(F.lit, ("ra", "ya", "mh", "quad", "rl", "gl"))), F.col("k") % 6)
    views = lens.base.filter("event_type = 'view'")
    nobody = F.col("k") % 10 == 9
    takes = views.select("match_id", F.when(~nobody, F.col("player")).alias("player"), F.when(~nobody, team).alias("team"), (F.col("k") % 12).alias("ent"), kind.alias("kind"))
    return weapons, takes


def pickups_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pickups of a life, by player."""
    lens = Lens(spark, sf_dir)
    return O.verify_pickups(*_pickups(lens), board(lens))


def pickups_verified_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every touch, by team."""
    lens = Lens(spark, sf_dir)
    return O.verify_pickups(*_pickups(lens), board(lens), first=False, by="team")


def entity_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.entity_counts(_pickups(Lens(spark, sf_dir))[1], "team")


def overview_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overviews with what has been found out of a match: locations, whether regions are controlled, and errors."""
    lens = Lens(spark, sf_dir)
    runs = K.lives(lens.marks("sp"), lens.marks("d"), F.lit(MATCH_END)).drop("closed")
    names = lens.base.filter("event_type = 'view' and k < 30").select("match_id", (F.col("k") % 30).alias("li"))
    errors = lens.base.filter("k = 97").select("match_id", F.concat(F.lit("bad "), "event_type").alias("reason"))
    view = S.overview(lens.matches, _board(lens), K.streaks(runs, lens.frag_log), K.powerup_runs(lens.interval("q"), lens.frag_log), locs=names, regions=lens.matches.filter("match_id % 3 = 0").select("match_id"), errors=errors)
    return view.select("match_id", "duration_ms", F.element_at("players", 1).alias("first"), F.size("teams").alias("n_teams"), "loc_count", "has_region_control", F.array_join("errors", "; ").alias("errors"))


QUERIES = {f.__name__: f for f in (official_players, official_teams, official_weapons, official_items, pickups_verified, pickups_verified_teams, entity_takes, overview_full)}

_BOARD = SQL + """, pl AS (SELECT match_id, player, CASE WHEN user_id % 7 <> 0 THEN team ELSE '' END AS team, user_id % 3 AS third, count(*) AS n, sum(k)::BIGINT AS s FROM base GROUP BY match_id, player, team, user_id),
wp AS (SELECT *, unnest(CASE third WHEN 0 THEN [{'w': 'rl', 'k': 1}, {'w': 'lg', 'k': 2}, {'w': 'sg', 'k': 3}] WHEN 1 THEN [{'w': 'rl', 'k': 4}, {'w': 'gl', 'k': 5}] ELSE [] END) AS u FROM pl),
wf AS (SELECT match_id, player, team, u.w AS w, s % (7 + u.k) AS hits, n * u.k % 41 AS attacks, CASE WHEN s % 3 * u.k > 0 THEN s % 3 * u.k ELSE n % 5 + u.k END AS kills, n % 5 + u.k AS enemy_kills, s % 300 AS damage,
  n % 9 AS taken, s % 4 AS dropped, n % 9 + u.k AS total_taken, n % 4 AS spawn_taken, n % 4 + u.k % 2 AS spawn_total_taken FROM wp),
it AS (SELECT match_id, player, team, u.i AS i, s % (3 + u.k) AS took, n * u.k % 50 AS secs FROM (SELECT *, unnest(CASE WHEN third <> 0 THEN [{'i': 'ra', 'k': 1}, {'i': 'quad', 'k': 2}, {'i': 'mh', 'k': 3}, {'i': 'ya', 'k': 4}] ELSE [] END) AS u FROM pl)),
st AS (SELECT match_id, player, team, s % 60 - 5 AS frags, n % 40 AS kills, s % 33 AS deaths, n % 3 AS tk, s % 2 AS suicides, coalesce((SELECT enemy_kills FROM wf WHERE wf.match_id = p.match_id AND wf.player = p.player AND w = 'rl'), 0) AS rl_kills,
  coalesce((SELECT enemy_kills FROM wf WHERE wf.match_id = p.match_id AND wf.player = p.player AND w = 'lg'), 0) AS lg_kills, CASE WHEN third <> 2 THEN s * 3 ELSE 0 END AS given, CASE WHEN third <> 2 THEN n * 5 ELSE 0 END AS taken,
  CASE WHEN third <> 2 THEN s % 500 ELSE 0 END AS enemy_weapons, CASE WHEN third <> 2 THEN n % 150 ELSE 0 END AS to_die, n % 60 AS ping FROM pl p)"""
_EFF = "round(CASE WHEN kills + deaths > 0 THEN kills * 100.0 / (kills + deaths) ELSE 0 END::DOUBLE, 1) AS efficiency"
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in O.PLAYER)
_PACKS = "coalesce(sum({c}) FILTER (w = '{w}'), 0)::BIGINT AS {w}_{c}"
_TAKES = _BOARD + """, wpk AS (SELECT match_id, player, CASE WHEN user_id % 7 <> 0 THEN team ELSE '' END AS team, ['rl', 'lg', 'gl', 'sg'][k % 4 + 1] AS weapon, k % 4 < 2 AND iv % 2 = 0 AS pack, iv % 3 = 0 AS had FROM base WHERE event_type = 'click'),
tk AS (SELECT match_id, player, CASE WHEN user_id % 7 <> 0 THEN team ELSE '' END AS team, k % 12 AS ent, ['ra', 'ya', 'mh', 'quad', 'rl', 'gl'][k % 6 + 1] AS kind FROM base WHERE event_type = 'view' AND k % 10 <> 9)"""
_ALL = """, ks AS (SELECT DISTINCT match_id, {by}, unnest(['sg', 'ssg', 'sng', 'gl', 'rl', 'lg']) AS kind, 'sum' AS cell FROM pl UNION SELECT DISTINCT match_id, {by}, unnest(['rl', 'lg']), 'pack' FROM pl UNION SELECT DISTINCT match_id, {by}, unnest(['ra', 'ya', 'ga', 'mh', 'quad', 'pent', 'ring']), 'item' FROM pl)
SELECT match_id, {by}, kind, cell, coalesce(found, 0)::BIGINT AS found, coalesce(official, 0)::BIGINT AS official, (coalesce(found, 0) - coalesce(official, 0))::BIGINT AS diff FROM (FROM ks FULL JOIN fd USING (match_id, {by}, kind, cell) LEFT JOIN ofc USING (match_id, {by}, kind, cell))"""
ORACLES = {
    "official_players": _BOARD + f" SELECT match_id, player, team, row_number() OVER (PARTITION BY match_id ORDER BY best, -frags, player)::INT AS rank, {', '.join(O.PLAYER)}, to_die, ping, {_EFF} FROM (SELECT *, min((-frags, player)) OVER (PARTITION BY match_id, team) AS best FROM st)",
    "official_teams": _BOARD + f" SELECT * EXCLUDE (best), {_EFF}, row_number() OVER (PARTITION BY match_id ORDER BY best)::INT AS rank FROM (SELECT match_id, team, min((-frags, player)) AS best, {_SUMS}, round(avg(to_die))::BIGINT AS to_die, round(avg(ping))::BIGINT AS ping FROM st GROUP BY match_id, team)",
    "official_weapons": _BOARD + " SELECT t.match_id, t.team, " + ", ".join(f"round(CASE WHEN sum(attacks) FILTER (w = '{w}') > 0 THEN sum(hits) FILTER (w = '{w}') * 100.0 / sum(attacks) FILTER (w = '{w}') END::DOUBLE, 1) AS {w}_accuracy, coalesce(sum(kills) FILTER (w = '{w}'), 0)::BIGINT AS {w}_kills, coalesce(sum(damage) FILTER (w = '{w}'), 0)::BIGINT AS {w}_damage" for w in O.WEAPONS)
    + " FROM (SELECT DISTINCT match_id, team FROM pl) t LEFT JOIN wf USING (match_id, team) GROUP BY t.match_id, t.team",
    "official_items": _BOARD + " SELECT t.match_id, t.team, " + ", ".join(f"coalesce((SELECT sum(took) FROM it WHERE it.match_id = t.match_id AND it.team = t.team AND i = '{i}'), 0)::BIGINT AS {i}" for i in O.ITEMS) + ", "
    + ", ".join(f"coalesce((SELECT sum(secs) FROM it WHERE it.match_id = t.match_id AND it.team = t.team AND i = '{i}'), 0)::BIGINT AS {i}_s" for i in O.POWERUPS) + ", "
    + ", ".join(f"coalesce((SELECT sum({c}) FROM wf WHERE wf.match_id = t.match_id AND wf.team = t.team AND w = '{w}'), 0)::BIGINT AS {w}_{c}" for w in O.PACKS for c in ("taken", "dropped"))
    + ", (SELECT sum(s % 3) FROM pl WHERE pl.match_id = t.match_id AND pl.team = t.team)::BIGINT AS rl_xfer, coalesce((SELECT sum(n % 2) FROM pl WHERE pl.match_id = t.match_id AND pl.team = t.team AND third = 0), 0)::BIGINT AS lg_xfer FROM (SELECT DISTINCT match_id, team FROM pl) t",
    "pickups_verified": _TAKES + """, fd AS (SELECT match_id, player, weapon AS kind, 'pack' AS cell, count(*) AS found FROM wpk WHERE pack AND NOT had GROUP BY ALL UNION ALL SELECT match_id, player, weapon, 'sum', count(*) FROM wpk WHERE NOT had GROUP BY ALL
  UNION ALL SELECT match_id, player, kind, 'item', count(*) FROM tk WHERE kind IN ('ra', 'ya', 'mh', 'quad') GROUP BY ALL),
ofc AS (SELECT match_id, player, w AS kind, 'pack' AS cell, taken - spawn_taken AS official FROM wf WHERE w IN ('rl', 'lg') UNION ALL SELECT match_id, player, w, 'sum', CASE WHEN w IN ('rl', 'lg') THEN taken ELSE spawn_taken END FROM wf UNION ALL SELECT match_id, player, i, 'item', took FROM it)""" + _ALL.format(by="player"),
    "pickups_verified_teams": _TAKES + """, fd AS (SELECT match_id, team, weapon AS kind, 'pack' AS cell, count(*) AS found FROM wpk WHERE pack GROUP BY ALL
  UNION ALL SELECT match_id, team, kind, 'sum', count(*) FROM (SELECT match_id, team, kind FROM tk WHERE kind IN ('rl', 'gl') UNION ALL SELECT match_id, team, weapon FROM wpk WHERE pack) GROUP BY ALL UNION ALL SELECT match_id, team, kind, 'item', count(*) FROM tk WHERE kind IN ('ra', 'ya', 'mh', 'quad') GROUP BY ALL),
ofc AS (SELECT match_id, team, w AS kind, 'pack' AS cell, sum(total_taken - spawn_total_taken) AS official FROM wf WHERE w IN ('rl', 'lg') GROUP BY ALL UNION ALL SELECT match_id, team, w, 'sum', sum(CASE WHEN w IN ('rl', 'lg') THEN total_taken ELSE spawn_total_taken END) FROM wf GROUP BY ALL UNION ALL SELECT match_id, team, i, 'item', sum(took) FROM it GROUP BY ALL)""" + _ALL.format(by="team"),
    "entity_takes": _TAKES + " SELECT match_id, team, ent::INT AS ent, kind, count(*) AS n FROM tk GROUP BY ALL",
    "overview_full": BOARD_SQL + """SELECT m.match_id, match_end_ms - match_start_ms AS duration_ms, (SELECT arg_min(player || ':' || frags, (-frags, player)) FROM brd WHERE brd.match_id = m.match_id) AS first, (SELECT count(DISTINCT team) FROM brd WHERE brd.match_id = m.match_id)::INT AS n_teams,
  (SELECT count(DISTINCT k % 30) FROM base WHERE base.match_id = m.match_id AND event_type = 'view' AND k < 30) AS loc_count, m.match_id % 3 = 0 AS has_region_control,
  coalesce((SELECT string_agg(DISTINCT 'bad ' || event_type, '; ' ORDER BY 'bad ' || event_type) FROM base WHERE base.match_id = m.match_id AND k = 97), '') AS errors FROM matches m""",
}
