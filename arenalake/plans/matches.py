"""Queries of matches as a whole: durations, participants, teams, names, states, and sections that are written and read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arenalake.functions import text as X
from arenalake.functions.temporal import KEYS, grid
from arenalake.operators import identity as I
from arenalake.operators import kills as K
from arenalake.operators import pickups as U
from arenalake.operators import regions as R
from arenalake.operators import scoreboard as S
from arenalake.plans.boards import _BOARD, _board
from arenalake.plans.frags import _LIFE
from arenalake.plans.movement import _CTL, _GRAPH, STEP, _graph_input, _located, _marks
from arenalake.sources import sections
from arenalake.sources.lens import MATCH_END, SQL, Lens
from arenalake.sources.shared import settled, shared_dir


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of matches with a start and an end, a start only, or neither."""
    base = Lens(spark, sf_dir).base
    bounds = base.filter("match_id % 3 < 2").groupBy("match_id").agg(F.min(F.when(F.col("event_type") == "signup", F.col("t_ms"))).alias("start_ms"), F.max(F.when((F.col("event_type") == "error") & (F.col("match_id") % 3 == 0), F.col("t_ms"))).alias("end_ms"))
    return K.duration(bounds, base.groupBy("match_id").agg(F.max("t_ms").alias("last_ms")))


def rebased_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    starts = lens.matches.filter("match_id % 4 > 0").select("match_id", ((F.col("match_id") % 3 - 1) * 500_000).cast("int").alias("start_ms"))
    return I.rebase_intervals(lens.interval("rl"), starts)


def fuzzy_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they may be typed: exact, in capitals, with a part missing or added, or of nobody."""
    lens = Lens(spark, sf_dir)
    players = lens.players.select("match_id", (F.substring("player", 2, 9).cast("int") % 10).alias("slot"), "player")
    way = F.col("slot") % 5
    query = F.when(way == 0, F.col("player")).when(way == 1, F.upper("player")).when(way == 2, F.concat(F.lit("["), "player", F.lit("]!"))).when(way == 3, F.concat("player", F.lit("x"))).otherwise(F.lit("zz"))
    return I.fuzzy(players.select("match_id", query.alias("query")).distinct(), players)


def player_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams from three sources in order: few, then some with a slot suffix, then all."""
    lens = Lens(spark, sf_dir)
    number = F.substring("player", 2, 9).cast("int")
    few = lens.players.filter(number % 4 == 0).select(*KEYS, F.when(number % 8 == 0, "green").otherwise("").alias("team"))
    some = lens.players.filter(number % 3 == 0).select("match_id", F.concat("player", F.lit("#2")).alias("player"), F.lit("yellow").alias("team"))
    return R.team_of(few, some, lens.players)


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    number = F.substring("player", 2, 9).cast("int")
    team = F.when(number % 6 == 0, "Spectators").when(number % 6 == 1, "").when(number % 6 == 2, F.concat(F.col("team"), F.lit("\u0007"))).otherwise(F.col("team"))
    return S.participants(lens.players.select(*KEYS, team.alias("team"), (number % 4).alias("frags")))


def last_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Lens(spark, sf_dir).base.select(*KEYS, "seq", "event_type", F.col("iv").alias("v"))
    return S.last_state(rows, [*KEYS, "event_type"], "v")


def server_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of bulk texts and of single settings, the last write of each key by sequence."""
    rows = Lens(spark, sf_dir).base
    text = F.concat(F.lit("\\map\\m"), F.col("k").cast("string"), F.lit("\\mode\\"), "event_type", F.lit("\\limit\\"), F.col("iv").cast("string"))
    bulk = rows.filter("k % 20 = 0").select("match_id", "seq", F.explode(X.key_values(text)).alias("key", "value"))
    single = rows.filter("k % 20 = 7").select("match_id", "seq", F.when(F.col("k") % 3 == 0, "mode").otherwise(F.concat(F.lit("x"), (F.col("k") % 2).cast("string"))).alias("key"), F.col("iv").cast("string").alias("value"))
    return S.last_state(bulk.unionByName(single), ["match_id", "key"], "value")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown reports, by a digest of each."""
    lens = Lens(spark, sf_dir)
    runs = K.lives(lens.marks("sp"), lens.marks("d"), F.lit(MATCH_END)).drop("closed")
    powerups = K.powerup_runs(lens.interval("q"), lens.frag_log).withColumn("powerup", F.lit("quad"))
    odd = F.col("match_id") % 2 == 1
    settings = lens.matches.filter("match_id % 3 > 0").select("match_id", F.when(odd, "4on4").alias("mode"), (F.col("match_id") % 4 * 5).alias("timelimit"), F.when(odd, "").otherwise("cup").alias("matchtag"))
    out = S.markdown(lens.matches, _board(lens), K.streaks(runs, lens.frag_log), powerups, settings)
    return out.select("match_id", F.sha2("text", 256).alias("sha"), F.length("text").alias("n"))


def map_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = Lens(spark, sf_dir).table("nation")
    path = F.concat(F.lit("qw\\Maps/"), "n_name", F.when(F.col("n_nationkey") % 2 == 0, ".BSP").otherwise(" by  Somebody"))
    return n.select("n_nationkey", X.map_name(path).alias("map"))


def loc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lens(spark, sf_dir).locs.select("loc_id", X.loc_label(F.concat(F.lit(" *"), "name", F.lit("\u00e9 +Hi"))).alias("label"))


def bit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weapons, powerups and the best armor of item bit fields."""
    rows = Lens(spark, sf_dir).base.filter("event_type = 'click'")
    bits = (F.col("k") % 128) + F.when(F.col("iv") % 3 == 0, 8192).otherwise(0) + F.when(F.col("iv") % 5 == 0, 32768).otherwise(0) + F.when(F.col("iv") % 7 == 0, 4194304).otherwise(0)
    return U.from_bits(rows.select(*KEYS, "seq", bits.cast("int").alias("bits"))).select(*KEYS, "seq", "rl", "lg", "gl", "q", "at")


def region_control_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control with other teams than the players' own: two players change sides, one is left out."""
    lens = Lens(spark, sf_dir)
    last = F.substring("player", 2, 9).cast("int") % 10
    override = lens.players.filter(last < 3).select(*KEYS, F.when(last == 0, "blue").when(last == 1, "red").otherwise("").alias("team"))
    players, cells = R.with_teams(lens.players, override), grid(lens.matches, STEP, rounding="half_up")
    where = R.presence(cells, players, _located(lens), lens.regions, [lens.interval("rl"), lens.interval("lg")])
    return R.control(where, cells, lens.regions, R.infer_teams(players), lens.matches)


def graph_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges as sections: post-processed, written in order, and one match of them read back as written."""
    lens = Lens(spark, sf_dir)
    rows = _graph_input(lens)  # one search for both
    nodes = R.graph_nodes(rows, _marks(lens), STEP).groupBy("match_id", F.col("loc").alias("name")).agg(F.sum("ms").alias("n"))
    edges = R.graph_edges(rows, _marks(lens), 500.0).groupBy("match_id", "from_loc", "to_loc").agg(F.sum("n").alias("n"))
    edges = settled(edges)  # nodes count them, and they are a section themselves
    counted = lambda t: {"nodes": t["nodes"].join(t["edges"].groupBy("match_id", F.col("from_loc").alias("name")).agg(F.sum("n").alias("out")), ["match_id", "name"], "left").na.fill(0, ["out"])}
    tables = sections.processed({"nodes": nodes, "edges": edges}, [counted, lambda t: {"edges": t["edges"].filter("n > 1")}])
    path = f"{shared_dir(spark)}/sections-{uuid.uuid4().hex}"
    sections.write(tables, path)
    out = None
    for name, label in (("nodes", F.col("name")), ("edges", F.concat_ws(">", "from_loc", "to_loc"))):
        rows = sections.read(spark, path, name, 1).select(F.lit(name).alias("section"), label.alias("label"), "n", F.col("out") if name == "nodes" else F.lit(None).cast("long").alias("out"))
        rows = rows.withColumn("_at", F.monotonically_increasing_id())  # the order of the file
        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("section").orderBy("_at"))).drop("_at")
        out = rows if out is None else out.unionByName(rows)
    return out


def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two time-ordered lists as one, with the place of each row in its match."""
    lens = Lens(spark, sf_dir)
    rows = lens.base.withColumn("t_ms", F.floor(F.col("t_ms") / 50_000).cast("int"))
    one = rows.filter("event_type = 'signup'").select("match_id", "t_ms", "seq", "player")
    other = rows.filter("event_type = 'error'").select("match_id", "t_ms", "seq", F.col("k").alias("damage"))
    order = Window.partitionBy("match_id").orderBy("t_ms", "side", "seq")
    return sections.merged(one, other, ["t_ms"]).withColumn("pos", F.row_number().over(order))


QUERIES = {f.__name__: f for f in (durations, rebased_intervals, fuzzy_players, player_teams, participants, last_states, server_settings, reports, map_names, loc_labels, bit_states, region_control_teams, graph_sections, merged_events)}

_N = "substr(player, 2)::INT"
ORACLES = {
    "durations": SQL + """, b AS (SELECT match_id, min(t_ms) FILTER (event_type = 'signup') AS s, CASE WHEN match_id % 3 = 0 THEN max(t_ms) FILTER (event_type = 'error') END AS e, max(t_ms) AS l FROM base GROUP BY match_id)
SELECT match_id, CASE WHEN match_id % 3 = 0 THEN coalesce(e - s, l - s, l) WHEN match_id % 3 = 1 THEN coalesce(l - s, l) ELSE l END AS duration_ms FROM b""",
    "rebased_intervals": SQL + """, i AS (SELECT i.*, CASE WHEN match_id % 4 > 0 THEN greatest((match_id % 3 - 1) * 500000, 0) ELSE 0 END AS s FROM intervals i WHERE field = 'rl')
SELECT match_id, player, (greatest(start_ms, s) - s)::INT AS start_ms, (end_ms - s)::INT AS end_ms FROM i WHERE end_ms > s""",
    "fuzzy_players": SQL + f""", p AS (SELECT match_id, {_N} % 10 AS slot, player FROM players),
q AS (SELECT DISTINCT match_id, CASE slot % 5 WHEN 0 THEN player WHEN 1 THEN upper(player) WHEN 2 THEN '[' || player || ']!' WHEN 3 THEN player || 'x' ELSE 'zz' END AS query FROM p),
n AS (SELECT q.match_id, query, player, slot, regexp_replace(lower(query), '[^a-z0-9]', '', 'g') AS a, lower(player) AS b FROM q JOIN p USING (match_id)),
r AS (SELECT *, CASE WHEN query = player THEN 0 WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN 2 END AS rank FROM n)
SELECT match_id, query, arg_min(player, (rank, slot)) AS player FROM r WHERE rank IS NOT NULL GROUP BY match_id, query""",
    "player_teams": SQL + f" SELECT match_id, player, CASE WHEN {_N} % 8 = 0 THEN 'green' WHEN {_N} % 3 = 0 THEN 'yellow' ELSE team END AS team FROM players",
    "participants": SQL + f" SELECT match_id, player, team, {_N} % 4 AS frags FROM players WHERE {_N} % 6 > 2 AND {_N} % 4 <> 0",
    "last_states": SQL + " SELECT match_id, player, event_type, arg_max(iv, seq) AS v FROM base GROUP BY ALL",
    "server_settings": SQL + """, w AS (SELECT match_id, seq, unnest(['map', 'mode', 'limit']) AS key, unnest(['m' || k, event_type, iv::VARCHAR]) AS value FROM base WHERE k % 20 = 0
  UNION ALL SELECT match_id, seq, CASE WHEN k % 3 = 0 THEN 'mode' ELSE 'x' || (k % 2) END, iv::VARCHAR FROM base WHERE k % 20 = 7)
SELECT match_id, key, arg_max(value, seq) AS value FROM w GROUP BY ALL""",
    "reports": _LIFE.replace(SQL, _BOARD, 1) + """, i AS (SELECT l.match_id, l.player, start_ms, end_ms, weapon, count(*) AS n FROM life l JOIN frags f ON f.match_id = l.match_id AND f.killer = l.player AND NOT is_suicide AND NOT is_team_kill AND f.t_ms BETWEEN start_ms AND end_ms GROUP BY ALL),
sk AS (SELECT match_id, player, start_ms, end_ms - start_ms AS d, sum(n)::BIGINT AS n, arg_min(weapon, (-n, weapon)) AS weapon FROM i GROUP BY match_id, player, start_ms, end_ms),
pw AS (SELECT match_id, player, start_ms, end_ms - start_ms AS d, (SELECT count(*) FROM frags f WHERE f.match_id = q.match_id AND f.killer = q.player AND NOT is_suicide AND NOT is_team_kill AND f.t_ms BETWEEN q.start_ms AND q.end_ms) AS n FROM intervals q WHERE field = 'q'),
s1 AS (SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, d, start_ms, player) AS r, '| ' || player || ' | ' || team || ' | ' || n || ' | ' || printf('%.1fs', d / 1000) || ' | ' || weapon || ' |' AS line FROM sk JOIN players USING (match_id, player)),
p1 AS (SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, start_ms, player) AS r, '| ' || player || ' | ' || team || ' | quad | ' || printf('%.1fs', d / 1000) || ' | ' || n || ' |' AS line FROM pw JOIN players USING (match_id, player)),
tx AS (SELECT match_id, '# ' || match_id || chr(10) || chr(10) || '- duration: ' || printf('%.1fs', (match_end_ms - match_start_ms) / 1000) || chr(10) || '- map: ' || map || chr(10)
    || CASE WHEN match_id % 3 > 0 AND match_id % 2 = 1 THEN '- mode: 4on4' || chr(10) ELSE '' END || CASE WHEN match_id % 3 > 0 AND match_id % 4 > 0 THEN '- timelimit: ' || (match_id % 4 * 5) || ' min' || chr(10) ELSE '' END
    || CASE WHEN match_id % 3 > 0 AND match_id % 2 = 0 THEN '- matchtag: cup' || chr(10) ELSE '' END
    || coalesce(chr(10) || '## Players' || chr(10) || chr(10) || '| Name | Team | Frags | Kills | Deaths |' || chr(10) || '|---|---|---:|---:|---:|' || chr(10) || (SELECT string_agg('| ' || player || ' | ' || team || ' | ' || frags || ' | ' || kills || ' | ' || deaths || ' |', chr(10) ORDER BY frags DESC, player) FROM brd WHERE brd.match_id = m.match_id) || chr(10), '')
    || coalesce(chr(10) || '## Teams' || chr(10) || chr(10) || '| Team | Frags |' || chr(10) || '|---|---:|' || chr(10) || (SELECT CASE WHEN count(*) > 1 THEN string_agg('| ' || team || ' | ' || n || ' |', chr(10) ORDER BY n DESC, team) END FROM (SELECT match_id, team, sum(frags)::BIGINT AS n FROM brd GROUP BY ALL) t WHERE t.match_id = m.match_id) || chr(10), '')
    || coalesce(chr(10) || '## Top frag streaks' || chr(10) || chr(10) || '| Player | Team | Frags | Duration | Weapon |' || chr(10) || '|---|---|---:|---:|---|' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY r) FROM s1 WHERE s1.match_id = m.match_id AND r <= 5) || chr(10), '')
    || coalesce(chr(10) || '## Top powerup runs' || chr(10) || chr(10) || '| Player | Team | Powerup | Duration | Frags |' || chr(10) || '|---|---|---|---:|---:|' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY r) FROM p1 WHERE p1.match_id = m.match_id AND r <= 5) || chr(10), '') AS text FROM matches m)
SELECT match_id, sha256(text) AS sha, length(text)::INT AS n FROM tx""",
    "map_names": "SELECT n_nationkey, lower(n_name) AS map FROM nation",
    "loc_labels": SQL + " SELECT loc_id, trim(regexp_replace(lower(name), '[^a-z0-9+/._-]+', ' ', 'g')) || ' +hi' AS label FROM locs",
    "bit_states": SQL + """, c AS (SELECT match_id, player, seq, k % 128 AS b, iv FROM base WHERE event_type = 'click')
SELECT match_id, player, seq, b & 32 <> 0 AS rl, b & 64 <> 0 AS lg, b & 16 <> 0 AS gl, iv % 7 = 0 AS q, CASE WHEN iv % 5 = 0 THEN 'ra' WHEN iv % 3 = 0 THEN 'ga' ELSE '' END AS at FROM c""".replace(" AS at FROM c", ' AS "at" FROM c'),
    "region_control_teams": _CTL.replace("players AS (SELECT DISTINCT match_id, player, team FROM base)", "players AS (SELECT DISTINCT match_id, player, CASE user_id % 10 WHEN 0 THEN 'blue' WHEN 1 THEN 'red' WHEN 2 THEN '' ELSE team END AS team FROM base)")
    .replace("count(DISTINCT team) > 1)", "count(DISTINCT team) > 1)", 1).replace("SELECT match_id, min(team) AS a, max(team) AS b FROM players GROUP BY", "SELECT match_id, min(team) AS a, max(team) AS b FROM players WHERE team <> '' GROUP BY") + " SELECT * FROM ctl",
    "graph_sections": _GRAPH + """, e AS (SELECT match_id, was AS from_loc, loc AS to_loc, count(*)::BIGINT AS n FROM run WHERE pbc = bc AND was <> loc GROUP BY ALL),
nd AS (SELECT match_id, loc AS name, sum(ms)::BIGINT AS n FROM node GROUP BY ALL)
SELECT 'nodes' AS section, name AS label, n, coalesce((SELECT sum(e.n) FROM e WHERE e.match_id = nd.match_id AND e.from_loc = nd.name), 0)::BIGINT AS out, row_number() OVER (ORDER BY name)::INT AS pos FROM nd WHERE match_id = 1
UNION ALL SELECT 'edges', from_loc || '>' || to_loc, n, NULL, row_number() OVER (ORDER BY from_loc, to_loc)::INT FROM e WHERE match_id = 1 AND n > 1""".replace(" AS out,", ' AS "out",'),
    "merged_events": SQL + """, m AS (SELECT match_id, floor(t_ms / 50000)::INT AS t_ms, (event_type = 'error')::INT AS side, seq, CASE WHEN event_type = 'signup' THEN player END AS player, CASE WHEN event_type = 'error' THEN k END AS damage FROM base WHERE event_type IN ('signup', 'error'))
SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY t_ms, side, seq)::INT AS pos FROM m""",
}
