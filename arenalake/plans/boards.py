"""Identity, pickup, scoreboard and catalog queries over the lens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalake.functions.temporal import KEYS
from arenalake.operators import identity as I
from arenalake.operators import kills as K
from arenalake.operators import pickups as U
from arenalake.operators import scoreboard as S
from arenalake.sources.lens import MATCH_END, SQL, Lens
from arenalake.sources.shared import shared_dir


def _userinfo(lens: Lens) -> DataFrame:
    return lens.base.filter("event_type = 'signup'").select("match_id", (F.col("user_id") % 4).cast("int").alias("slot"), "t_ms", "seq", (F.col("k") % 4).alias("user_id"), F.concat(F.lit("n"), (F.col("k") % 3).cast("string")).alias("name"), "team", F.when(F.col("k") % 5 == 0, F.concat(F.lit("a"), (F.col("k") % 3).cast("string"))).otherwise("").alias("auth"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sessions(_userinfo(Lens(spark, sf_dir)))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.unify(I.sessions(_userinfo(Lens(spark, sf_dir)))).select("match_id", "slot", "session", "identity")


def _logins(lens: Lens) -> DataFrame:
    """A scoreboard of even matches: one login with its name."""
    return lens.matches.filter("match_id % 2 = 0").select("match_id", F.lit("n1").alias("name"), F.lit("a2").alias("login"), F.lit("red").alias("team"))


def _lines(lens: Lens) -> DataFrame:
    """Reconnect lines of every third match, with names that are prefixes of each other."""
    rows = lens.base.filter("event_type = 'error' and match_id % 3 = 0 and k % 4 = 1")
    return rows.select("match_id", "t_ms", F.concat(F.lit("n"), (F.col("k") % 2).cast("string"), F.lit(" rejoins the game with "), F.col("k").cast("string"), F.lit(" frags")).alias("message"))


def _links(lens: Lens) -> tuple[DataFrame, DataFrame]:
    found = I.sessions(_userinfo(lens))
    return found, I.scoreboard_links(found, _logins(lens)).unionByName(I.reconnect_links(found, _lines(lens)))


def identities_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    found, links = _links(lens)
    return I.unify(found, links, _logins(lens)).select("match_id", "slot", "session", "identity")


def _slotted(lens: Lens) -> DataFrame:
    return lens.base.filter("event_type = 'purchase'").select("match_id", (F.col("user_id") % 4).cast("int").alias("slot"), "t_ms", "seq", (F.col("iv") % 5).alias("v"))


def stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    found, links = _links(lens)
    return I.stitch(_slotted(lens), I.unify(found, links, _logins(lens)))


def stitched_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    found, links = _links(lens)
    spans = _slotted(lens).filter("v = 1").select("match_id", "slot", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 40_000).alias("end_ms"))
    return I.stitch_intervals(spans, I.unify(found, links, _logins(lens)))


def teams_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    rows = lens.base.filter("event_type = 'error'").select("match_id", "seq", F.when(F.col("k") % 3 == 0, F.upper("player")).when(F.col("k") % 3 == 1, F.col("player")).otherwise(F.lit("nobody")).alias("player"))
    return I.team_by_name(rows, lens.players)


def victim_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    lines = lens.base.filter("event_type = 'error'").select("match_id", "seq", "t_ms", F.concat(F.lit("n"), (F.col("k") % 4).cast("string")).alias("victim"))
    return I.victim_slot(lines, _userinfo(lens))


def slot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    rows = lens.base.filter("event_type = 'view'").select("match_id", (F.col("user_id") % 4).cast("int").alias("slot"), "t_ms", "seq")
    return I.at_slot(rows, I.sessions(_userinfo(lens)), ["name"])


def first_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.first_user(_userinfo(Lens(spark, sf_dir)))


def rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    starts = lens.matches.select("match_id", ((F.col("match_id") % 3) * 400_000).cast("int").alias("start_ms"))
    return I.rebase(lens.number("h"), starts)


def death_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    rows = lens.base.filter("event_type in ('signup', 'error')")
    return I.deaths_and_spawns(rows.select("match_id", (F.col("user_id") % 4).cast("int").alias("slot"), "t_ms", "seq", (F.col("event_type") == "signup").alias("alive"), (F.col("k") % 10 == 0).alias("forced")))


def _signals(lens: Lens) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Health, dead flags, obituaries and match starts of four slots a match."""
    rows = lens.base.withColumn("slot", (F.col("user_id") % 4).cast("int"))
    of = lambda kind, *c: rows.filter(F.col("event_type") == kind).select("match_id", "slot", "t_ms", "seq", *c)
    health = of("purchase", (F.col("k") % 5 * 25 - 25).alias("health"))
    return health, of("view", (F.col("k") % 3 == 0).alias("dead")), of("error").filter("seq % 4 = 0"), lens.matches.select("match_id", F.lit(900_000).alias("start_ms"), F.lit(0).alias("start_seq"))


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.lifecycle(*_signals(Lens(spark, sf_dir)))


def _drops(lens: Lens) -> DataFrame:
    return lens.base.filter("event_type = 'error'").select("match_id", (F.col("k") % 6).alias("ent"), "t_ms", "seq", "player")


def _pickups(lens: Lens) -> DataFrame:
    return lens.base.filter("event_type = 'click'").select("match_id", (F.col("k") % 6).alias("ent"), "t_ms", "seq", "player")


def matched_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return U.match_drops(_drops(lens), _pickups(lens))


def drop_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return U.drops_with_pickups(_drops(lens), U.match_drops(_drops(lens), _pickups(lens))).select("match_id", "ent", "seq", "player", "taker", "taken_ms")


def drop_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops as expired, handed to a team mate or taken by an enemy, who may have had the weapon."""
    lens = Lens(spark, sf_dir)
    fates = U.drops_with_pickups(_drops(lens), U.match_drops(_drops(lens), _pickups(lens))).withColumn("had_before", F.col("taken_ms") % 3 == 0)
    return U.outcome(fates, lens.players).select("match_id", "ent", "seq", "player", "taker", "outcome")


def weapon_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    weapon = F.get(F.array(F.lit("rl"), F.lit("lg")), F.col("k") % 2)
    taken = lens.base.filter("event_type = 'click'").select(*KEYS, "t_ms", F.col("seq").alias("pickup_id"), weapon.alias("weapon"))
    return U.effect(U.next_death(taken, lens.marks("d")), lens.frag_log)


def _states(lens: Lens) -> DataFrame:
    kinds = F.array(*map(F.lit, ("ra", "quad", "rl", "shells", "mh", "pent")))
    return lens.base.filter("event_type in ('click', 'view')").select("match_id", (F.col("k") % 6).alias("ent"), F.get(kinds, F.col("k") % 6).alias("kind"), "t_ms", "seq", (F.col("event_type") == "click").alias("taken"))


def _holds(lens: Lens) -> DataFrame:
    """Respawn of large health boxes (entity 4) by their takers' health."""
    taken = lens.base.filter("event_type = 'click' and k % 6 = 4").select(*KEYS, "seq", "t_ms", (F.col("k") % 6).alias("ent"))
    held = U.long_hold(taken, lens.number("h"), lens.marks("d"))
    return held.select("match_id", "ent", F.col("t_ms").alias("taken_at"), "respawn_at")


def item_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return U.phases(_states(lens), _holds(lens))


def item_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    probes = _states(lens).select("match_id", "ent").distinct().select("match_id", "ent", F.explode(F.sequence(F.lit(0), F.lit(MATCH_END), F.lit(432_000))).alias("t_ms"))
    return U.status(probes, U.phases(_states(lens), _holds(lens))).select("match_id", "ent", "t_ms", "status")


def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = Lens(spark, sf_dir).table("part").select((F.col("p_partkey") % 9).alias("match_id"), F.col("p_partkey").alias("ent"), F.col("p_brand").alias("kind"), (F.col("p_size") % 5).alias("x"), F.floor("p_retailprice").cast("int").alias("y"), (F.col("p_size") % 3).alias("z"))
    return U.item_names(items).select("match_id", "ent", "name")


def _board(lens: Lens) -> DataFrame:
    d = K.deltas(lens.frag_log).groupBy(*KEYS).agg(F.sum("delta").alias("frags"))
    return K.kills(lens.frag_log, lens.marks("d")).join(lens.players, KEYS).join(d, KEYS, "left").na.fill(0, ["frags"])


def player_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.player_table(_board(Lens(spark, sf_dir)))


def team_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.team_table(_board(Lens(spark, sf_dir)))


def weapon_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    per = lens.frag_log.groupBy("match_id", F.col("killer").alias("player"), "weapon").agg(F.count("*").alias("attacks"), F.count_if(~F.col("is_suicide")).alias("hits"), F.count_if(~F.col("is_suicide") & ~F.col("is_team_kill")).alias("kills"))
    folded = per.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("weapon", F.struct("hits", "attacks", "kills")))).alias("weapons")).join(lens.players, KEYS)
    return S.accuracy(S.unfold(folded), "team")


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    runs = K.lives(lens.marks("sp"), lens.marks("d"), F.lit(MATCH_END)).drop("closed")
    view = S.overview(lens.matches, _board(lens), K.streaks(runs, lens.frag_log), K.powerup_runs(lens.interval("q"), lens.frag_log))
    return S.report(view)


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of two players' names and two teams; the index of words is written sorted, and read by word."""
    games = Lens(spark, sf_dir).games
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    S.token_index(games).repartitionByRange("token").sortWithinPartitions("token", "id").write.parquet(path)
    found = S.search(games, ["Supplier 000000003", "CUSTOMER"], ["NATION_14"], tag="i", since="1995-06-01", until="2001-06-30", limit=100, index=spark.read.parquet(path))
    return found.select("id", "map", "mode", "matchtag", F.array_join(F.array_sort("players"), ",").alias("players"), F.size("teams").alias("n_teams"))


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players who were killed by a rare weapon in the first days against those who bought something rare."""
    lens = Lens(spark, sf_dir)
    hit = lens.frag_log.filter("t_ms < 400000 and weapon = 'axe'").select("match_id", F.col("victim").alias("player"))
    return S.coverage(hit.distinct(), lens.base.filter("event_type = 'purchase' and k > 85").select(*KEYS).distinct())


def damage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Lens(spark, sf_dir).table("lineitem")
    types = spark.range(5).select(F.col("id").alias("death_type"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("weapon"))
    damage = li.select((F.col("l_orderkey") % 100).alias("match_id"), (F.col("l_partkey") % 10).alias("attacker"), (F.col("l_suppkey") % 10).alias("victim"), F.col("l_linenumber").cast("long").alias("death_type"), F.col("l_quantity").cast("long").alias("amount"), (F.col("l_linenumber") % 2 == 0).alias("splash"))
    return S.damage_table(damage, types)


def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Lens(spark, sf_dir).catalog.select("map", "mode", F.col("id").alias("match_id"), "player", F.floor("price").cast("long").alias("frags"))
    return S.rollup(c, ["map", "mode"])


QUERIES = {f.__name__: f for f in (
    sessions, identities, identities_linked, stitched, stitched_intervals, teams_by_name, victim_slots, slot_names, first_users, rebased, death_edges, lifecycle, matched_drops, drop_fates, drop_outcomes, weapon_effects, item_phases, item_status, item_names,
    player_table, team_table, weapon_accuracy, overview, catalog_search, coverage_gaps, damage_table, corpus_rollup,
)}

_INFO = SQL + """, info AS (SELECT match_id, CAST(user_id % 4 AS INT) AS slot, t_ms, seq, nullif(k % 4, 0) AS uid, k % 4 AS user_id, 'n' || (k % 3) AS name, team, CASE WHEN k % 5 = 0 THEN 'a' || (k % 3) END AS auth FROM base WHERE event_type = 'signup'),
f AS (SELECT *, last_value(uid IGNORE NULLS) OVER (PARTITION BY match_id, slot ORDER BY t_ms, seq) AS u FROM info),
g AS (SELECT *, sum((was IS NOT NULL AND u <> was)::INT) OVER (PARTITION BY match_id, slot ORDER BY t_ms, seq) AS session FROM (SELECT *, lag(u) OVER (PARTITION BY match_id, slot ORDER BY t_ms, seq) AS was FROM f)),
h AS (SELECT match_id, slot, session::BIGINT AS session, min(t_ms) AS t, arg_max(name, (t_ms, seq)) AS name, arg_max(team, (t_ms, seq)) AS team, coalesce(arg_max(auth, (t_ms, seq)) FILTER (auth IS NOT NULL), '') AS auth FROM g GROUP BY match_id, slot, session),
sess AS (SELECT match_id, slot, session, CASE WHEN session > 0 THEN t END AS start_ms, lead(t) OVER (PARTITION BY match_id, slot ORDER BY session) AS end_ms, name, team, auth FROM h)"""
_NODE = "lpad(slot::VARCHAR, 3, '0') || ':' || lpad(session::VARCHAR, 5, '0')"
_AUTH = f"SELECT match_id, slot, session, {_NODE} AS node, 'a:' || auth AS key FROM sess WHERE auth <> ''"
_LINKED = f"""{_AUTH} UNION ALL SELECT match_id, slot, session, {_NODE}, 's' FROM sess WHERE match_id % 2 = 0 AND (auth = 'a2' OR name = 'n1')
  UNION ALL SELECT match_id, slot, session, {_NODE}, 'r:' || name FROM sess SEMI JOIN (SELECT DISTINCT match_id, 'n' || (k % 2) AS name FROM base WHERE event_type = 'error' AND match_id % 3 = 0 AND k % 4 = 1) USING (match_id, name)"""


def _identity_sql(keys: str, rich: str) -> str:
    """Sessions with identity, by the closure of keys that stand together in a session."""
    return _INFO.replace("WITH base", "WITH RECURSIVE base", 1) + f""", rk AS ({keys}),
keyed AS (SELECT * FROM rk UNION ALL SELECT match_id, slot, session, {_NODE}, 'n:' || name FROM sess WHERE match_id NOT IN (SELECT match_id FROM rk UNION SELECT match_id FROM ({rich}))),
edge AS (SELECT DISTINCT a.match_id, a.key AS k1, b.key AS k2 FROM keyed a JOIN keyed b USING (match_id, node)),
reach AS (SELECT * FROM edge UNION SELECT r.match_id, r.k1, e.k2 FROM reach r JOIN edge e ON e.match_id = r.match_id AND e.k1 = r.k2),
root AS (SELECT match_id, k1 AS key, min(k2) AS root FROM reach GROUP BY ALL),
low AS (SELECT match_id, root, min(node) AS identity FROM keyed JOIN root USING (match_id, key) GROUP BY ALL),
mine AS (SELECT DISTINCT match_id, node, identity FROM keyed JOIN root USING (match_id, key) JOIN low USING (match_id, root)),
idn AS (SELECT s.*, coalesce(identity, {_NODE}) AS identity FROM sess s LEFT JOIN mine ON mine.match_id = s.match_id AND mine.node = {_NODE.replace("slot", "s.slot").replace("session", "s.session")})"""


_IDN = _identity_sql(_LINKED, "SELECT match_id FROM matches WHERE match_id % 2 = 0")
_PLAYER = _IDN + """, lst AS (SELECT match_id, identity, arg_max({'n': name, 's': slot}, (coalesce(start_ms, -2147483648), slot, session)) AS x FROM idn WHERE name <> '' GROUP BY ALL),
pl AS (SELECT match_id, identity, CASE WHEN count(*) OVER (PARTITION BY match_id, x.n) > 1 THEN x.n || '#' || x.s ELSE x.n END AS player FROM lst),
who AS (SELECT idn.*, player FROM idn LEFT JOIN pl USING (match_id, identity)),
slotted AS (SELECT match_id, CAST(user_id % 4 AS INT) AS slot, t_ms, seq, iv % 5 AS v FROM base WHERE event_type = 'purchase')"""
_DROP = SQL + """, dr AS (SELECT match_id, k % 6 AS ent, t_ms, seq, player FROM base WHERE event_type = 'error'), pk AS (SELECT match_id, k % 6 AS ent, t_ms, seq, player FROM base WHERE event_type = 'click'),
c AS (SELECT p.*, (SELECT arg_max(d.seq, (d.t_ms, d.seq)) FROM dr d WHERE d.match_id = p.match_id AND d.ent = p.ent AND d.t_ms <= p.t_ms) AS ds FROM pk p),
m AS (SELECT c.*, CASE WHEN ds IS NOT NULL AND row_number() OVER (PARTITION BY match_id, ent, ds ORDER BY t_ms, seq) = 1 THEN ds END AS own FROM c)"""
_STATE = SQL + """, st AS (SELECT match_id, k % 6 AS ent, ['ra', 'quad', 'rl', 'shells', 'mh', 'pent'][k % 6 + 1] AS kind, t_ms, seq, event_type = 'click' AS taken FROM base WHERE event_type IN ('click', 'view')),
ed AS (SELECT * FROM (SELECT *, coalesce(lag(taken) OVER (PARTITION BY match_id, ent ORDER BY t_ms, seq), false) AS was FROM st) WHERE taken <> was),
ph AS (SELECT match_id, ent, kind, n::BIGINT AS phase_no, coalesce(min(t_ms) FILTER (NOT taken), 0) AS available_from, min(t_ms) FILTER (taken) AS taken_at FROM (SELECT *, sum((NOT taken)::INT) OVER (PARTITION BY match_id, ent ORDER BY t_ms, seq) AS n FROM ed) GROUP BY ALL),
hp AS (SELECT *, lag(v) OVER (PARTITION BY match_id, player ORDER BY t_ms, seq) AS was FROM changes WHERE field = 'h' AND v <= 250),
low AS (SELECT match_id, player, t_ms FROM hp WHERE was > 100 AND v <= 100 UNION ALL SELECT match_id, player, t_ms FROM deaths),
hold AS (SELECT b.match_id, b.t_ms AS taken_at, min(greatest(b.t_ms + 5000, (SELECT min(l.t_ms) FROM low l WHERE l.match_id = b.match_id AND l.player = b.player AND l.t_ms > b.t_ms)) + 20000) AS held
  FROM (SELECT * FROM base WHERE event_type = 'click' AND k % 6 = 4) b WHERE EXISTS (SELECT 1 FROM low l WHERE l.match_id = b.match_id AND l.player = b.player AND l.t_ms > b.t_ms) GROUP BY ALL),
phase AS (SELECT ph.*, CASE WHEN ent = 4 THEN held ELSE ph.taken_at + [20, 60, 30, 30, 0, 300][ent + 1] * 1000 END AS respawn_at FROM ph LEFT JOIN hold ON ent = 4 AND hold.match_id = ph.match_id AND hold.taken_at = ph.taken_at)"""
_BOARD = SQL + """, board AS (SELECT p.match_id, p.player, p.team, count(f.seq) FILTER (NOT is_suicide AND NOT is_team_kill) AS kills, count(f.seq) FILTER (is_suicide) AS suicides, count(f.seq) FILTER (is_team_kill) AS team_kills,
  (SELECT count(*) FROM deaths d WHERE d.match_id = p.match_id AND d.player = p.player) AS deaths, coalesce(sum(CASE WHEN is_suicide OR is_team_kill THEN -1 WHEN f.seq IS NOT NULL THEN 1 END), 0)::BIGINT AS frags
  FROM players p LEFT JOIN frags f ON f.match_id = p.match_id AND f.killer = p.player GROUP BY p.match_id, p.player, p.team),
brd AS (SELECT * FROM board WHERE kills + suicides + team_kills + deaths > 0)"""
_EFF = "round(coalesce(kills * 100.0::DOUBLE / nullif(kills + deaths, 0), 0), 1) AS efficiency"
ORACLES = {
    "sessions": _INFO + " SELECT * FROM sess",
    "identities": _identity_sql(_AUTH, "SELECT 0 AS match_id WHERE false") + " SELECT match_id, slot, session, identity FROM idn",
    "identities_linked": _IDN + " SELECT match_id, slot, session, identity FROM idn",
    "stitched": _PLAYER + """, r AS (SELECT b.*, (SELECT arg_max({'p': player}, session) FROM who w WHERE w.match_id = b.match_id AND w.slot = b.slot AND (start_ms IS NULL OR start_ms <= b.t_ms)).p AS player FROM slotted b)
SELECT match_id, player, t_ms, seq, v FROM (SELECT *, lag(v) OVER (PARTITION BY match_id, player ORDER BY t_ms, seq) AS was FROM r WHERE player IS NOT NULL) WHERE was IS DISTINCT FROM v""",
    "stitched_intervals": _PLAYER + """, i AS (SELECT match_id, slot, t_ms AS s, t_ms + 40000 AS e FROM slotted WHERE v = 1)
SELECT match_id, player, greatest(s, coalesce(start_ms, s)) AS start_ms, least(e, coalesce(end_ms, e)) AS end_ms FROM i JOIN who USING (match_id, slot) WHERE player IS NOT NULL AND least(e, coalesce(end_ms, e)) > greatest(s, coalesce(start_ms, s))""",
    "teams_by_name": SQL + """, r AS (SELECT match_id, seq, CASE k % 3 WHEN 0 THEN upper(player) WHEN 1 THEN player ELSE 'nobody' END AS player FROM base WHERE event_type = 'error')
SELECT r.match_id, r.seq, r.player, p.team FROM r LEFT JOIN players p ON p.match_id = r.match_id AND p.player = lower(r.player)""",
    "victim_slots": _INFO + """, l AS (SELECT match_id, seq, t_ms, 'n' || (k % 4) AS victim FROM base WHERE event_type = 'error'), sl AS (SELECT DISTINCT match_id, slot FROM info),
n AS (SELECT l.*, slot, (SELECT arg_max(name, (t_ms, seq)) FROM info i WHERE i.match_id = l.match_id AND i.slot = sl.slot AND i.t_ms <= l.t_ms) AS name FROM l JOIN sl USING (match_id))
SELECT match_id, seq, t_ms, victim, min(slot) FILTER (name = victim) AS slot FROM n GROUP BY ALL""",
    "slot_names": _INFO + " SELECT b.match_id, CAST(b.user_id % 4 AS INT) AS slot, b.t_ms, b.seq, (SELECT arg_max(name, session) FROM sess s WHERE s.match_id = b.match_id AND s.slot = b.user_id % 4 AND (start_ms IS NULL OR start_ms <= b.t_ms)) AS name FROM base b WHERE event_type = 'view'",
    "first_users": _INFO + ", sl AS (SELECT match_id, slot, arg_min(user_id, seq) FILTER (user_id > 0) AS user_id, arg_max(name, seq) AS name FROM info GROUP BY ALL) SELECT match_id, name, arg_min(user_id, slot) AS user_id FROM sl WHERE user_id > 0 GROUP BY match_id, name",
    "rebased": SQL + """, s AS (SELECT *, CAST(match_id % 3 * 400000 AS INT) AS z FROM changes WHERE field = 'h'),
e AS (SELECT match_id, player, arg_max(seq, (t_ms, seq)) AS seq, arg_max(v, (t_ms, seq)) AS v FROM s WHERE t_ms < z GROUP BY match_id, player)
SELECT match_id, player, t_ms - z AS t_ms, seq, v FROM s WHERE t_ms >= z UNION ALL SELECT match_id, player, 0, seq, v FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.match_id = e.match_id AND s.player = e.player AND s.t_ms = s.z)""",
    "death_edges": SQL + """, s AS (SELECT match_id, CAST(user_id % 4 AS INT) AS slot, t_ms, seq, event_type = 'signup' AS alive, k % 10 = 0 AS forced FROM base WHERE event_type IN ('signup', 'error'))
SELECT match_id, slot, t_ms, seq, CASE WHEN alive THEN 'spawn' ELSE 'death' END AS event FROM (SELECT *, lag(alive) OVER (PARTITION BY match_id, slot ORDER BY t_ms, seq) AS was FROM s) WHERE forced OR was IS NULL OR alive <> was""",
    "lifecycle": SQL + """, e AS (SELECT match_id, (user_id % 4)::INT AS slot, t_ms, seq, event_type AS e, k FROM base),
hl AS (SELECT *, lag(k % 5 * 25 - 25, 1, 0) OVER (PARTITION BY match_id, slot ORDER BY t_ms, seq) > 0 AS up FROM e WHERE e = 'purchase'),
sg AS (SELECT match_id, slot, t_ms, seq, k % 5 > 1 AS alive, 'health' AS signal FROM hl WHERE up <> (k % 5 > 1)
  UNION ALL SELECT match_id, slot, t_ms, seq, k % 3 <> 0, CASE WHEN row_number() OVER (PARTITION BY match_id, slot ORDER BY t_ms, seq) = 1 AND k % 3 = 0 THEN 'seed' ELSE 'flag' END FROM e WHERE e = 'view'
  UNION ALL SELECT match_id, slot, t_ms, seq, false, 'text' FROM e WHERE e = 'error' AND seq % 4 = 0 AND t_ms >= 900000)
SELECT match_id, slot, t_ms, seq, CASE WHEN alive THEN 'spawn' ELSE 'death' END AS event, signal
FROM (SELECT *, lag(alive) OVER (PARTITION BY match_id, slot ORDER BY t_ms, seq) AS was FROM sg) WHERE signal = 'text' OR (signal <> 'seed' AND was IS DISTINCT FROM alive)""",
    "matched_drops": _DROP + " SELECT m.match_id, m.ent, m.t_ms, m.seq, m.player, d.t_ms AS drop_ms, d.player AS dropper FROM m LEFT JOIN dr d ON d.seq = m.own",
    "drop_fates": _DROP + " SELECT d.match_id, d.ent, d.seq, d.player, m.player AS taker, m.t_ms AS taken_ms FROM dr d LEFT JOIN (SELECT m.match_id, m.ent, x.t_ms AS dt, m.player, m.t_ms FROM m JOIN dr x ON x.seq = m.own) m ON m.match_id = d.match_id AND m.ent = d.ent AND m.dt = d.t_ms",
    "drop_outcomes": _DROP + """, ft AS (SELECT d.match_id, d.ent, d.seq, d.player, m.player AS taker, m.t_ms AS taken_ms FROM dr d LEFT JOIN (SELECT m.match_id, m.ent, x.t_ms AS dt, m.player, m.t_ms FROM m JOIN dr x ON x.seq = m.own) m ON m.match_id = d.match_id AND m.ent = d.ent AND m.dt = d.t_ms), o AS (SELECT f.*, a.team AS own, b.team AS other FROM ft f LEFT JOIN players a USING (match_id, player) LEFT JOIN players b ON b.match_id = f.match_id AND b.player = f.taker)
SELECT match_id, ent, seq, player, taker, CASE WHEN taker IS NULL THEN 'expired' ELSE CASE WHEN own = other THEN 'xfer' ELSE 'enemy' END || CASE WHEN taken_ms % 3 = 0 THEN ' had' ELSE '' END END AS outcome FROM o""",
    "weapon_effects": SQL + """, p AS (SELECT match_id, player, t_ms, seq AS pickup_id, ['rl', 'lg'][k % 2 + 1] AS weapon FROM base WHERE event_type = 'click'),
n AS (SELECT p.*, (SELECT min(t_ms) FROM deaths d WHERE d.match_id = p.match_id AND d.player = p.player AND d.t_ms > p.t_ms) AS next_death_ms FROM p),
b AS (SELECT f.seq, arg_max(pickup_id, (n.t_ms, pickup_id)) AS pickup_id FROM frags f JOIN n ON n.match_id = f.match_id AND n.player = f.killer AND n.weapon = f.weapon AND n.t_ms < f.t_ms AND (next_death_ms IS NULL OR f.t_ms <= next_death_ms) WHERE NOT is_suicide AND NOT is_team_kill GROUP BY f.seq)
SELECT match_id, player, t_ms, n.pickup_id, weapon, next_death_ms, (SELECT count(*) FROM b WHERE b.pickup_id = n.pickup_id) AS kills FROM n""",
    "item_phases": _STATE + " SELECT * FROM phase",
    "item_status": _STATE + """, pr AS (SELECT DISTINCT match_id, ent FROM st), q AS (SELECT match_id, ent, b * 432000 AS t_ms FROM pr, range(0, 7) r(b)),
z AS (SELECT q.*, (SELECT arg_max({'a': taken_at, 'b': respawn_at}, (available_from, phase_no)) FROM phase p WHERE p.match_id = q.match_id AND p.ent = q.ent AND available_from <= q.t_ms) AS s FROM q)
SELECT match_id, ent, t_ms::INT AS t_ms, CASE WHEN s.a IS NULL OR s.a > t_ms THEN 'up' WHEN s.b > t_ms THEN ceil((s.b - t_ms) / 1000)::BIGINT::VARCHAR ELSE 'pending' END AS status FROM z""",
    "item_names": "SELECT p_partkey % 9 AS match_id, p_partkey AS ent, CASE WHEN count(*) OVER (PARTITION BY p_partkey % 9, p_brand) > 1 THEN p_brand || '_' || row_number() OVER (PARTITION BY p_partkey % 9, p_brand ORDER BY p_size % 5, floor(p_retailprice), p_size % 3, p_partkey) ELSE p_brand END AS name FROM part",
    "player_table": _BOARD + f" SELECT *, {_EFF}, row_number() OVER (PARTITION BY match_id ORDER BY frags DESC, player)::INT AS rank FROM brd",
    "team_table": _BOARD + f", t AS (SELECT match_id, team, sum(frags)::BIGINT AS frags, sum(kills)::BIGINT AS kills, sum(deaths)::BIGINT AS deaths, sum(suicides)::BIGINT AS suicides, sum(team_kills)::BIGINT AS team_kills FROM brd GROUP BY ALL) SELECT *, {_EFF} FROM t",
    "weapon_accuracy": SQL + ", w AS (SELECT f.match_id, team, weapon, count(*) FILTER (NOT is_suicide) AS hits, count(*) AS attacks, count(*) FILTER (NOT is_suicide AND NOT is_team_kill) AS kills FROM frags f JOIN players p ON p.match_id = f.match_id AND p.player = f.killer GROUP BY ALL) SELECT *, round(hits * 100.0::DOUBLE / attacks, 1) AS accuracy FROM w",
    "catalog_search": SQL + """, sd AS (SELECT l_orderkey AS id, list_distinct(list(s_name)) AS names, list_distinct(list(n_name)) AS sides FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1),
gm AS (SELECT c.*, list_distinct([c.player] || coalesce(names, [])) AS players, list_distinct([c.map] || coalesce(sides, [])) AS teams FROM catalog c LEFT JOIN sd USING (id))
SELECT id, map, mode, matchtag, array_to_string(list_sort(players), ',') AS players, len(teams)::INT AS n_teams FROM gm
WHERE list_contains(players, 'Supplier#000000003') AND list_contains(teams, 'NATION_14') AND matchtag ILIKE '%i%' AND day BETWEEN DATE '1995-06-01' AND DATE '2001-06-30' ORDER BY day DESC, id LIMIT 100""",
    "coverage_gaps": SQL + ", l AS (SELECT DISTINCT match_id, victim AS player FROM frags WHERE t_ms < 400000 AND weapon = 'axe'), r AS (SELECT DISTINCT match_id, player FROM base WHERE event_type = 'purchase' AND k > 85) SELECT match_id, player, true AS in_left, false AS in_right FROM l ANTI JOIN r USING (match_id, player) UNION ALL SELECT match_id, player, false, true FROM r ANTI JOIN l USING (match_id, player)",
    "damage_table": "SELECT l_orderkey % 100 AS match_id, l_partkey % 10 AS attacker, l_suppkey % 10 AS victim, CASE WHEN l_linenumber < 5 THEN 'w' || l_linenumber ELSE 'unknown' END AS weapon, sum(l_quantity::BIGINT)::BIGINT AS damage, count(*) FILTER (l_linenumber % 2 = 0) AS splashes FROM lineitem GROUP BY ALL",
    "corpus_rollup": SQL + " SELECT map, mode, count(DISTINCT id) AS matches, count(DISTINCT player) AS players, sum(floor(price)::BIGINT)::BIGINT AS frags FROM catalog GROUP BY ROLLUP (map, mode)",
}
