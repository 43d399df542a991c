"""Filtered, sliced and drawn views over the lens: timelines of all kinds, chat, pickups, items, heatmaps, trails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arenalake.functions.temporal import KEYS, changed
from arenalake.functions.text import death_type
from arenalake.operators import filters as V
from arenalake.operators import kills as K
from arenalake.operators import pickups as U
from arenalake.operators import points as P
from arenalake.operators import regions as R
from arenalake.operators import scoreboard as S
from arenalake.operators import spatial as G
from arenalake.plans.boards import _BOARD, _STATE, _holds, _states
from arenalake.plans.frags import _LIFE
from arenalake.plans.movement import _CTL, _LOC, _control, _located, _named
from arenalake.sources.lens import MATCH_END, SQL, Lens


def _chat(lens: Lens) -> DataFrame:
    kinds = F.get(F.array(*map(F.lit, ("chat", "teamsay", "server"))), F.col("k") % 3)
    return lens.base.filter("event_type = 'view'").select(*KEYS, "t_ms", "seq", kinds.alias("type"), F.concat(F.lit("text "), (F.col("iv") % 4).cast("string")).alias("message"))


def events_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    own = lambda df, detail: df.select("match_id", "t_ms", "player", detail.cast("string").alias("detail"))
    streaks = K.streaks(K.lives(lens.marks("sp"), lens.marks("d"), F.lit(MATCH_END)).drop("closed"), lens.frag_log, 3).withColumn("t_ms", F.col("start_ms"))
    runs = K.powerup_runs(lens.interval("q"), lens.frag_log).withColumn("t_ms", F.col("start_ms"))
    loc = changed(_named(lens), "loc")
    parts = {
        "powerup": own(runs, F.col("frags")), "streak": own(streaks, F.concat_ws(" ", "frags", "weapon")), "chat": own(V.chat(_chat(lens)), F.concat_ws(": ", "type", "message")),
        "health": own(P.deltas(lens.number("h"), 0, 0), F.concat_ws(" ", "v", "delta")), "armor": own(P.deltas(lens.number("a"), 0, 0), F.concat_ws(" ", "v", "delta")), "loc": own(loc, F.col("loc")),
    }
    return P.events(parts, list(parts), 200_000, 2_200_000)


def chat_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.chat(_chat(Lens(spark, sf_dir)), names=["u1", "u2", "u13"], start_ms=100_000, end_ms=2_000_000)


def pickups_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    kind = lambda *v: F.get(F.array(*map(F.lit, v)), F.col("k") % len(v))
    rows = lens.base.filter("event_type = 'click'").select(*KEYS, "t_ms", "seq", kind("rl", "lg", "gl").alias("weapon"), kind("world", "pack").alias("source"))
    return V.pickups(rows, ["u1", "u3", "u22", "u25"], "rl", "pack")


def items_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    taker = F.when(F.col("taken_at").isNotNull(), F.concat(F.lit("u"), (F.col("taken_at") % 7).cast("string")))
    rows = U.phases(_states(lens), _holds(lens)).withColumns({"name": F.concat_ws("_", "kind", "ent"), "taken_by": taker})
    return V.items(rows, kinds=["POWERUP", "mega", "rl"], takers=["u1", "u2"]).select("match_id", "ent", "phase_no", "name", "taken_by")


def stats_sane(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = Lens(spark, sf_dir).base.filter("event_type in ('purchase', 'click')")
    return V.sane_stats(base.select(*KEYS, "seq", F.when(F.col("event_type") == "purchase", "h").otherwise("a").alias("field"), F.col("iv").alias("v")))


def loc_name_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    stream = changed(_located(lens).withColumn("v", F.col("li") % 5), "v").select(*KEYS, "t_ms", "seq", "v")
    table = lens.matches.select("match_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("li")).withColumn("name", F.concat(F.lit("place "), F.floor(F.col("li") / 2).cast("string")))
    return P.slice_loc_names(stream, table, lens.players, 700_000, 2_000_000)


def loc_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    rows = _located(lens).select(*KEYS, "seq", "map", "li")
    # a match's table holds the points that its rows name, not all of its map
    named = lens.locs.filter("loc_id % 3 <> 0").select("map", F.col("loc_id").alias("li"), "name")
    table = rows.select("match_id", "map", "li").distinct().join(named, ["map", "li"]).select("match_id", "li", "name")
    return V.loc_names(rows.drop("map"), table)


def powerup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    runs = lens.interval("q").withColumn("item", F.lit("quad")).unionByName(lens.interval("pe").withColumn("item", F.lit("pent")))
    return P.powerup_rows(runs, lens.players.withColumn("team", F.when(F.col("player").endswith("3"), "green").otherwise(F.col("team"))), R.infer_teams(lens.players), 500_000, 1_500_000)


def movement_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    rows = lens.positions.withColumns({"death": F.col("seq") % 41 == 0, "spawn": F.col("seq") % 43 == 0})
    return P.movement_trail(rows, 400.0, 1500.0)


def region_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.heatmap(R.shares(_control(Lens(spark, sf_dir))[1]))
    return out.select("match_id", "region", *[F.round(c, 6).alias(c) for c in out.columns if c.endswith("_shade")])


def regions_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    word = lambda n, *v: F.get(F.array(*map(F.lit, v)), F.col("loc_id") % n)
    # the second map has no red armor: its yellow one marks a region
    first = F.when(F.col("map") == "m1", word(3, "ya", "quad", "stairs")).otherwise(word(3, "ra", "quad", "ya"))
    return G.detect_regions(lens.locs.withColumn("name", F.concat_ws(".", first, word(4, "low", "high", "low", "rl"))), reach=900.0)


def damage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Lens(spark, sf_dir).table("lineitem")
    return li.groupBy((F.col("l_orderkey") % 50).alias("match_id"), death_type(F.col("l_linenumber").cast("int") * 2).alias("weapon")).agg(F.count("*").alias("n"))


def fallback_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    known = lens.players.filter("player like '%1'").withColumn("frags", F.lit(7).cast("long"))
    board = K.kills(lens.frag_log, lens.marks("d"))
    generic = lens.matches.select("match_id", F.lit("His teammate").alias("player"), F.lit(3).cast("long").alias("kills"), F.lit(0).cast("long").alias("deaths"))
    return S.fallback(board.select(*KEYS, "kills", "deaths").unionByName(generic), known).select(*KEYS, "kills", "deaths", "team", "frags", "rank")


def armor_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    kinds = lambda k: F.count_if(F.col("v") == k).alias(k)
    totals = lens.armor_type.groupBy(*KEYS).agg(kinds("ga"), kinds("ya"), kinds("ra"), F.count("*").alias("ta"))
    out = S.armor_split(totals)
    return out.select(*KEYS, *[F.round(f"{k}_armor", 6).alias(f"{k}_armor") for k in ("ga", "ya", "ra")])


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    sums = K.deltas(lens.frag_log).groupBy(*KEYS).agg(F.sum("delta").alias("frags"))
    official = lens.players.select(*KEYS, (F.substring("player", 2, 9).cast("long") % 9 - 3).alias("frags"))
    stats = lens.base.filter("event_type = 'purchase'").select(*KEYS, F.lit("h").alias("field"), F.col("iv").alias("v"))
    kind = F.get(F.array(*map(F.lit, ("ra", "quad", "rl"))), F.col("k") % 3)
    pickups = lens.base.filter("event_type = 'click'").select("match_id", kind.alias("kind"), F.when(F.col("k") % 50 > 2, F.col("player")).alias("player"))
    return S.quality(sums, official, stats, lens.players.unionByName(lens.players.filter("player like '%4'")), pickups)


def pickup_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    weapon = F.get(F.array(F.lit("rl"), F.lit("lg")), F.col("k") % 2)
    taken = lens.base.filter("event_type = 'click'").select(*KEYS, "t_ms", "seq", weapon.alias("weapon"))
    bits = lens.base.filter("event_type = 'purchase'").select(*KEYS, "t_ms", "seq", F.when(F.col("k") % 3 == 0, 96).when(F.col("k") % 3 == 1, 32).otherwise(0).alias("bits"))
    official = lens.players.select(*KEYS, F.explode(F.array(F.lit("rl"), F.lit("gl"))).alias("weapon")).withColumn("official", F.lit(5).cast("long"))
    return U.verify(U.had_before(taken, bits), official)


def visibility_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = Lens(spark, sf_dir).base
    frames = base.select("match_id", F.floor(F.col("t_ms") / 50_000).cast("int").alias("frame")).distinct()
    seen = base.filter("event_type = 'view'").select("match_id", (F.col("k") % 4).alias("ent"), F.floor(F.col("t_ms") / 50_000).cast("int").alias("frame")).distinct()
    return U.visibility(frames, seen)


def pack_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    hints = lens.base.filter("event_type = 'error'").select(*KEYS, "t_ms", "seq", ((F.col("k") % 4) * 32).cast("int").alias("flags"))
    found = U.backpacks(hints, lens.positions.select(*KEYS, "t_ms", "seq", "x", "y", "z", "map"), lens.locs)
    return found.select(*KEYS, "seq", "weapon", "x", "y", "z", "li")


def stat_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    deaths = F.count_if(F.col("event_type") == "error")
    lives = lens.base.withColumn("life", deaths.over(Window.partitionBy(*KEYS).orderBy("t_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)))
    stat = F.when(F.col("event_type") == "purchase", "health").when(F.col("event_type") == "click", "items").otherwise("rockets")
    v = F.when(F.col("event_type") == "purchase", F.col("iv") % 120).when(F.col("event_type") == "click", (F.col("k") % 8) * 16).otherwise(F.col("k") % 30)
    return U.evidence(lives.filter("event_type in ('purchase', 'click', 'view')").select(*KEYS, "t_ms", "seq", "life", stat.alias("stat"), v.cast("int").alias("v"))).select(*KEYS, "seq", "kind")


QUERIES = {f.__name__: f for f in (
    events_full, chat_filtered, pickups_filtered, items_filtered, stats_sane, loc_name_slice, loc_names, powerup_rows, movement_trail, region_heatmap, regions_detected,
    damage_by_type, fallback_board, armor_shares, quality_report, pickup_checks, visibility_edges, pack_origins, stat_evidence,
)}

_CHAT = SQL + ", chat AS (SELECT match_id, player, t_ms, seq, ['chat', 'teamsay', 'server'][k % 3 + 1] AS type, 'text ' || (iv % 4) AS message FROM base WHERE event_type = 'view')"
_DELTA = "SELECT match_id, t_ms, '{t}' AS type, player, CASE WHEN i = 1 THEN v::VARCHAR ELSE v || ' ' || (v - was) END AS detail FROM (SELECT *, row_number() OVER w AS i, lag(v, 1, 0) OVER w AS was FROM changes WHERE field = '{f}' WINDOW w AS (PARTITION BY match_id, player ORDER BY t_ms, seq))"
_SIX = ("a_control", "a_weak", "contested", "weak_contested", "b_weak", "b_control")
ORACLES = {
    "movement_trail": SQL.replace("WITH base", "WITH RECURSIVE base", 1) + """, s AS (SELECT match_id, player, t_ms, seq, x, y, seq % 41 = 0 AS death, seq % 43 = 0 AS spawn, row_number() OVER w AS n, coalesce(greatest(abs(x - lag(x) OVER w), abs(y - lag(y) OVER w)) > 1500, false) AS far
  FROM positions WHERE x <> 0 OR y <> 0 WINDOW w AS (PARTITION BY match_id, player ORDER BY t_ms, seq)),
r AS (SELECT match_id, player, n, x AS lx, y AS ly, true AS kept FROM s WHERE n = 1
  UNION ALL SELECT match_id, player, n, CASE WHEN kept THEN x ELSE lx END, CASE WHEN kept THEN y ELSE ly END, kept
  FROM (SELECT s.*, r.lx, r.ly, s.death OR s.spawn OR greatest(abs(s.x - r.lx), abs(s.y - r.ly)) > 400 AS kept FROM r JOIN s ON s.match_id = r.match_id AND s.player = r.player AND s.n = r.n + 1))
SELECT match_id, player, t_ms, seq, x, y, death, spawn, far AND NOT death AND NOT spawn AS teleport FROM s JOIN r USING (match_id, player, n) WHERE kept""",
    "regions_detected": SQL.replace("WITH base", "WITH RECURSIVE base", 1) + """, w AS (SELECT map, loc_id, x, y, list_distinct([CASE WHEN map = 'm1' THEN ['YA', 'QUAD', 'STAIRS'][loc_id % 3 + 1] ELSE ['RA', 'QUAD', 'YA'][loc_id % 3 + 1] END, ['LOW', 'HIGH', 'LOW', 'RL'][loc_id % 4 + 1]]) AS words FROM locs),
k AS (SELECT *, unnest(list_filter(words, lambda q: q IN ('RL', 'LG', 'QUAD') OR q = CASE WHEN map = 'm1' THEN 'YA' ELSE 'RA' END)) AS key FROM w),
g AS (SELECT a.map, a.key, a.loc_id AS a, b.loc_id AS b FROM k a JOIN k b ON a.map = b.map AND a.key = b.key AND a.loc_id <> b.loc_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 810000),
r AS (SELECT map, key, loc_id, loc_id AS top FROM k UNION SELECT g.map, g.key, g.b, r.top FROM r JOIN g ON g.map = r.map AND g.key = r.key AND g.a = r.loc_id WHERE r.top < g.b),
c AS (SELECT map, key, loc_id, min(top) AS cluster FROM r GROUP BY ALL),
o AS (SELECT map, key, cluster, word, count(*) AS n FROM (SELECT c.*, unnest(list_filter(words, lambda q: q <> key)) AS word FROM c JOIN w USING (map, loc_id)) GROUP BY ALL),
t AS (SELECT map, key, cluster, arg_min(word, (-n, word)) AS word FROM o GROUP BY ALL)
SELECT map, loc_id, key || coalesce(' ' || word, '') AS region FROM c LEFT JOIN t USING (map, key, cluster)""",
    "events_full": _LIFE.replace(SQL, _LOC + ", chat AS (SELECT match_id, player, t_ms, ['chat', 'teamsay', 'server'][k % 3 + 1] AS type, 'text ' || (iv % 4) AS message FROM base WHERE event_type = 'view')", 1) + """,
i AS (SELECT l.match_id, l.player, start_ms, end_ms, weapon, count(*) AS n FROM life l JOIN frags f ON f.match_id = l.match_id AND f.killer = l.player AND NOT is_suicide AND NOT is_team_kill AND f.t_ms BETWEEN start_ms AND end_ms GROUP BY ALL),
b AS (SELECT match_id, player, start_ms, end_ms, sum(n)::BIGINT AS frags, arg_min(weapon, (-n, weapon)) AS weapon FROM i GROUP BY match_id, player, start_ms, end_ms),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frags DESC, end_ms - start_ms, start_ms, player) AS r FROM b) WHERE r <= 3),
ev AS (SELECT match_id, start_ms AS t_ms, 'powerup' AS type, player, (SELECT count(*) FROM frags f WHERE f.match_id = q.match_id AND f.killer = q.player AND NOT is_suicide AND NOT is_team_kill AND f.t_ms BETWEEN q.start_ms AND q.end_ms)::VARCHAR AS detail FROM intervals q WHERE field = 'q'
  UNION ALL SELECT match_id, start_ms, 'streak', player, frags || ' ' || weapon FROM st UNION ALL SELECT match_id, t_ms, 'chat', player, type || ': ' || message FROM chat WHERE type <> 'server'
  UNION ALL """ + _DELTA.format(t="health", f="h") + " UNION ALL " + _DELTA.format(t="armor", f="a") + """
  UNION ALL SELECT match_id, t_ms, 'loc', player, loc FROM (SELECT *, lag(loc) OVER (PARTITION BY match_id, player ORDER BY t_ms, seq) AS was FROM located WHERE loc IS NOT NULL) WHERE was IS DISTINCT FROM loc)
SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY t_ms, type, player, detail)::INT AS pos FROM ev WHERE t_ms BETWEEN 200000 AND 2200000""",
    "overview": _LIFE.replace(SQL, _BOARD, 1) + """, i AS (SELECT l.match_id, l.player, start_ms, end_ms, count(*) AS n FROM life l JOIN frags f ON f.match_id = l.match_id AND f.killer = l.player AND NOT is_suicide AND NOT is_team_kill AND f.t_ms BETWEEN start_ms AND end_ms GROUP BY ALL),
pw AS (SELECT match_id, player, start_ms, (SELECT count(*) FROM frags f WHERE f.match_id = q.match_id AND f.killer = q.player AND NOT is_suicide AND NOT is_team_kill AND f.t_ms BETWEEN q.start_ms AND q.end_ms) AS n FROM intervals q WHERE field = 'q'),
tm AS (SELECT match_id, team, sum(frags)::BIGINT AS n FROM brd GROUP BY ALL),
al AS (SELECT 'p' AS part, match_id, player AS name, frags AS n, row_number() OVER (PARTITION BY match_id ORDER BY frags DESC, player) AS r FROM brd
  UNION ALL SELECT 't', match_id, team, n, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, team) FROM tm
  UNION ALL SELECT 's', match_id, player, n, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, end_ms - start_ms, player) FROM i
  UNION ALL SELECT 'u', match_id, player, n, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, start_ms, player) FROM pw),
li AS (SELECT match_id, part, string_agg(name || ':' || n, ', ' ORDER BY r) AS x FROM al WHERE r <= 5 GROUP BY ALL)
SELECT m.match_id, '# Match ' || m.match_id || ' - teams ' || coalesce((SELECT x FROM li WHERE li.match_id = m.match_id AND part = 't'), '') || '; players ' || coalesce((SELECT x FROM li WHERE li.match_id = m.match_id AND part = 'p'), '')
  || '; streaks ' || coalesce((SELECT x FROM li WHERE li.match_id = m.match_id AND part = 's'), '') || '; powerups ' || coalesce((SELECT x FROM li WHERE li.match_id = m.match_id AND part = 'u'), '') AS line FROM matches m""",
    "chat_filtered": _CHAT + " SELECT * FROM chat WHERE type IN ('chat', 'teamsay') AND player IN ('u1', 'u2', 'u13') AND t_ms BETWEEN 100000 AND 2000000",
    "pickups_filtered": SQL + " SELECT match_id, player, t_ms, seq, 'rl' AS weapon, 'pack' AS source FROM base WHERE event_type = 'click' AND k % 3 = 0 AND k % 2 = 1 AND player IN ('u1', 'u3', 'u22', 'u25')",
    "items_filtered": _STATE + """, n AS (SELECT *, kind || '_' || ent AS name, 'u' || (taken_at % 7) AS taken_by FROM phase WHERE kind IN ('quad', 'pent', 'mh', 'rl'))
SELECT match_id, ent, phase_no, name, taken_by FROM n WHERE coalesce(taken_by, '') IN ('', 'u1', 'u2')""",
    "stats_sane": SQL + ", s AS (SELECT match_id, player, seq, CASE event_type WHEN 'purchase' THEN 'h' ELSE 'a' END AS field, iv AS v FROM base WHERE event_type IN ('purchase', 'click')) SELECT * FROM s WHERE v <= CASE field WHEN 'h' THEN 250 ELSE 200 END",
    "loc_name_slice": _LOC + """, z AS (SELECT *, li % 5 AS v FROM located), c AS (SELECT match_id, player, t_ms, seq, CASE WHEN v IN (1, 2, 3) THEN 'place ' || (v // 2) ELSE '' END AS v FROM (SELECT *, lag(v) OVER (PARTITION BY match_id, player ORDER BY t_ms, seq) AS was FROM z) WHERE was IS DISTINCT FROM v),
carry AS (SELECT match_id, player, 700000 AS t_ms, arg_max(v, (t_ms, seq)) AS v FROM c WHERE t_ms <= 700000 GROUP BY match_id, player),
f AS (SELECT *, row_number() OVER (PARTITION BY match_id, player ORDER BY t_ms, seq) AS n FROM c WHERE t_ms >= 700000 AND t_ms < 2000000)
SELECT * FROM carry UNION ALL SELECT f.match_id, f.player, f.t_ms, f.v FROM f LEFT JOIN carry USING (match_id, player) WHERE NOT coalesce(n = 1 AND f.t_ms = 700000 AND f.v = carry.v, false)""",
    "loc_names": _LOC + " SELECT match_id, player, seq, li, CASE WHEN li % 3 <> 0 THEN coalesce(loc, '') ELSE '' END AS loc FROM located",
    "powerup_rows": SQL + """, t AS (SELECT match_id, min(team) AS a, max(team) AS b FROM players GROUP BY match_id HAVING count(DISTINCT team) > 1), p AS (SELECT match_id, player, CASE WHEN player LIKE '%3' THEN 'green' ELSE team END AS team FROM players)
SELECT i.match_id, i.player, CASE field WHEN 'q' THEN 'quad' ELSE 'pent' END AS item, greatest(start_ms, 500000) AS start_ms, least(end_ms, 1500000) AS end_ms, CASE team WHEN a THEN 'teamA' WHEN b THEN 'teamB' ELSE 'other' END AS side
FROM intervals i JOIN p USING (match_id, player) JOIN t USING (match_id) WHERE field IN ('q', 'pe') AND end_ms > 500000 AND start_ms < 1500000 AND least(end_ms, 1500000) > greatest(start_ms, 500000)""",
    "region_heatmap": _CTL + ", sh AS (SELECT match_id, region, " + ", ".join(f"floor(count(*) FILTER (state = '{s}') / count(*) * 1000 + 0.5) / 10 AS {n}" for s, n in zip("AaCcbB", _SIX, strict=True)) + f" FROM ctl GROUP BY match_id, region), g AS (SELECT *, greatest({', '.join(_SIX)}) AS top FROM sh) SELECT match_id, region, " + ", ".join(f"round({n} / CASE WHEN top > 0 THEN top ELSE 1 END, 6) AS {n}_shade" for n in _SIX) + " FROM g",
    "damage_by_type": "SELECT l_orderkey % 50 AS match_id, coalesce(['axe', 'sg', 'ssg', 'ng', 'sng', 'gl', 'rl', 'lg', 'lg', 'lg'][l_linenumber * 2], 'unknown') AS weapon, count(*) AS n FROM lineitem GROUP BY ALL",
    "fallback_board": SQL + """, own AS (SELECT match_id, killer AS player, count(*) FILTER (NOT is_suicide AND NOT is_team_kill) AS kills FROM frags GROUP BY ALL), dead AS (SELECT match_id, player, count(*) AS deaths FROM deaths GROUP BY ALL),
j AS (SELECT match_id, player, coalesce(kills, 0) AS kills, coalesce(deaths, 0) AS deaths FROM own FULL JOIN dead USING (match_id, player))
SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frags DESC, player)::INT AS rank FROM (SELECT j.match_id, j.player, kills, deaths, p.team, CASE WHEN p.team IS NOT NULL THEN 7 ELSE kills - deaths END::BIGINT AS frags FROM j LEFT JOIN (SELECT * FROM players WHERE player LIKE '%1') p USING (match_id, player))""",
    "armor_shares": SQL + ", c AS (SELECT match_id, player, count(*) FILTER (v = 1) AS ga, count(*) FILTER (v = 2) AS ya, count(*) FILTER (v = 3) AS ra, count(*) AS ta FROM changes WHERE field = 'at' GROUP BY ALL) SELECT match_id, player, " + ", ".join(f"round(CASE WHEN ga + ya + ra > 0 THEN ta * {k} / (ga + ya + ra) ELSE 0 END, 6) AS {k}_armor" for k in ("ga", "ya", "ra")) + " FROM c",
    "quality_report": SQL + """, s AS (SELECT match_id, killer AS player, sum(CASE WHEN is_suicide OR is_team_kill THEN -1 ELSE 1 END) AS f FROM frags GROUP BY ALL), o AS (SELECT match_id, player, substr(player, 2)::BIGINT % 9 - 3 AS b FROM players)
SELECT 'frags' AS check, match_id, player AS subject FROM s FULL JOIN o USING (match_id, player) WHERE abs(coalesce(f, 0) - coalesce(b, 0)) > 2
UNION ALL SELECT DISTINCT 'range', match_id, player FROM base WHERE event_type = 'purchase' AND iv > 250 UNION ALL SELECT 'name', match_id, player FROM players WHERE player LIKE '%4' UNION ALL SELECT DISTINCT 'pickup', match_id, ['ra', 'quad', 'rl'][k % 3 + 1] FROM base WHERE event_type = 'click' AND k % 50 <= 2""".replace("AS check", 'AS "check"'),
    "pickup_checks": SQL + """, t AS (SELECT match_id, player, t_ms, seq, ['rl', 'lg'][k % 2 + 1] AS weapon FROM base WHERE event_type = 'click'), bt AS (SELECT match_id, player, t_ms, seq, [96, 32, 0][k % 3 + 1] AS bits FROM base WHERE event_type = 'purchase'),
h AS (SELECT t.*, coalesce((SELECT arg_max(bits, (t_ms, seq)) FROM bt WHERE bt.match_id = t.match_id AND bt.player = t.player AND bt.t_ms < t.t_ms), 0) & CASE weapon WHEN 'rl' THEN 32 ELSE 64 END AS had FROM t),
f AS (SELECT match_id, player, weapon, count(*) AS found FROM h WHERE had = 0 GROUP BY ALL), o AS (SELECT match_id, player, unnest(['rl', 'gl']) AS weapon, 5 AS official FROM players)
SELECT match_id, player, weapon, coalesce(found, 0)::BIGINT AS found, coalesce(official, 0)::BIGINT AS official, (coalesce(found, 0) - coalesce(official, 0))::BIGINT AS diff FROM f FULL JOIN o USING (match_id, player, weapon)""",
    "visibility_edges": SQL + """, fr AS (SELECT DISTINCT match_id, floor(t_ms / 50000)::INT AS frame FROM base), sn AS (SELECT DISTINCT match_id, k % 4 AS ent, floor(t_ms / 50000)::INT AS frame FROM base WHERE event_type = 'view'),
g AS (SELECT e.match_id, e.ent, fr.frame, s.frame IS NOT NULL AS there FROM (SELECT DISTINCT match_id, ent FROM sn) e JOIN fr USING (match_id) LEFT JOIN sn s ON s.match_id = e.match_id AND s.ent = e.ent AND s.frame = fr.frame)
SELECT match_id, ent, frame, CASE WHEN there THEN 'respawned' ELSE 'taken' END AS edge FROM (SELECT *, lag(there) OVER (PARTITION BY match_id, ent ORDER BY frame) AS was FROM g) WHERE was IS NOT NULL AND was <> there""",
    "pack_origins": _LOC + """, h AS (SELECT match_id, player, t_ms, seq, CASE k % 4 WHEN 1 THEN 'rl' ELSE 'lg' END AS weapon FROM base WHERE event_type = 'error' AND k % 4 IN (1, 2)),
p AS (SELECT h.*, (SELECT arg_max({'x': x, 'y': y, 'z': z, 'li': li}, (t_ms, seq)) FROM located l WHERE l.match_id = h.match_id AND l.player = h.player AND l.t_ms <= h.t_ms) AS s FROM h)
SELECT match_id, player, seq, weapon, s.x AS x, s.y AS y, s.z AS z, s.li AS li FROM p""",
    "stat_evidence": SQL + """, l AS (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY match_id, player ORDER BY t_ms, seq) AS life FROM base),
st AS (SELECT match_id, player, t_ms, seq, life, CASE event_type WHEN 'purchase' THEN 'health' WHEN 'click' THEN 'items' ELSE 'rockets' END AS stat, CASE event_type WHEN 'purchase' THEN iv % 120 WHEN 'click' THEN k % 8 * 16 ELSE k % 30 END::INT AS v FROM l WHERE event_type IN ('purchase', 'click', 'view')),
d AS (SELECT *, lag(v) OVER (PARTITION BY match_id, player, life, stat ORDER BY t_ms, seq) AS was FROM st)
SELECT match_id, player, seq, unnest(CASE WHEN stat = 'items' THEN list_filter([CASE WHEN v & 16 <> 0 AND was & 16 = 0 THEN 'gl' END, CASE WHEN v & 32 <> 0 AND was & 32 = 0 THEN 'rl' END, CASE WHEN v & 64 <> 0 AND was & 64 = 0 THEN 'lg' END], lambda x: x IS NOT NULL)
  WHEN stat = 'health' THEN CASE WHEN v - was BETWEEN 1 AND 25 THEN ['health'] WHEN v - was BETWEEN 26 AND 50 THEN ['health', 'health'] END WHEN v > was THEN [stat] END) AS kind FROM d WHERE was IS NOT NULL""",
}
