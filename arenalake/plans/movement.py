"""Location, region and movement queries over the lens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalake.functions.temporal import KEYS, grid
from arenalake.operators import points as P
from arenalake.operators import regions as R
from arenalake.operators import spatial as S
from arenalake.sources.lens import MATCH_END, SQL, Lens

STEP = 100_000


def _located(lens: Lens) -> DataFrame:
    return S.locate(lens.positions, lens.locs)


def _named(lens: Lens) -> DataFrame:
    names = lens.locs.select(F.col("loc_id").alias("li"), F.col("name").alias("loc"))
    return _located(lens).join(names, "li")


def _marks(lens: Lens) -> DataFrame:
    return lens.marks("sp").unionByName(lens.marks("d"))


def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(Lens(spark, sf_dir)).select(*KEYS, "seq", "li")


def points_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return S.within(lens.positions, lens.locs, 600.0)


def visible_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    leaves = lens.positions.withColumn("leaf_id", F.col("seq") % 7)
    visible = lens.locs.select("map", (F.col("loc_id") % 5).cast("long").alias("leaf_id"), "loc_id")
    return S.visible_nearest(leaves, lens.locs, visible).select(*KEYS, "seq", "li")


def blip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    coarse = _located(lens).withColumn("li", F.col("li") % 3)
    return S.smooth(coarse.select(*KEYS, "seq", "t_ms", "li"), _marks(lens), STEP)


def loc_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return P.trails(_named(lens), 200_000, 2_400_000)


def loc_trails_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return P.trails(_named(lens).withColumn("loc", F.concat(F.lit("L"), (F.col("li") % 4).cast("string"))), 0, MATCH_END, 150_000)


def life_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    out = P.lives(lens.marks("sp"), lens.marks("d"), _named(lens))
    return out.withColumn("locs", F.array_join("locs", ">"))


def loc_intern(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return S.intern(_named(lens).withColumnRenamed("loc", "name"))


def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return S.bounds(lens.positions, lens.locs)


def height_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.height_range(Lens(spark, sf_dir).positions)


def region_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return S.centroids(lens.locs, lens.regions).select("map", "region", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))


def _control(lens: Lens) -> tuple[DataFrame, DataFrame]:
    cells = grid(lens.matches, STEP, rounding="half_up")
    where = R.presence(cells, lens.players, _located(lens), lens.regions, [lens.interval("rl"), lens.interval("lg")])
    return where, R.control(where, cells, lens.regions, R.infer_teams(lens.players), lens.matches)


def region_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _control(Lens(spark, sf_dir))[1]


def region_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shares(_control(Lens(spark, sf_dir))[1])


def region_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.spans(_control(Lens(spark, sf_dir))[1])


def region_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.state_strings(_control(Lens(spark, sf_dir))[1])


def region_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_player(_control(Lens(spark, sf_dir))[0])


def _graph_input(lens: Lens) -> DataFrame:
    return _named(lens).select(*KEYS, "seq", "t_ms", "x", "y", F.concat(F.lit("L"), (F.col("li") % 6).cast("string")).alias("loc"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return R.graph_nodes(_graph_input(lens), _marks(lens), STEP)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return R.graph_edges(_graph_input(lens), _marks(lens), 500.0)


def loc_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    out = R.heat(R.graph_nodes(_graph_input(lens), _marks(lens), STEP), "player", "ms")
    return out.select("match_id", "player", "loc", F.round("share", 6).alias("share"), F.round("shade", 6).alias("shade"))


QUERIES = {f.__name__: f for f in (
    nearest_point, points_within, visible_nearest, blip_filter, loc_trails, loc_trails_merged, life_tracks, loc_intern, map_bounds, height_range, region_centroids,
    region_control, region_shares, region_spans, region_strings, region_players, graph_nodes, graph_edges, loc_heatmap,
)}

_D2 = "(CAST(p.x AS FLOAT) - l.x) * (CAST(p.x AS FLOAT) - l.x) + (CAST(p.y AS FLOAT) - l.y) * (CAST(p.y AS FLOAT) - l.y) + (CAST(p.z AS FLOAT) - l.z) * (CAST(p.z AS FLOAT) - l.z)"
_LOC = SQL + f""", place AS (SELECT DISTINCT map, x, y, z FROM positions),
near AS (SELECT p.map, p.x, p.y, p.z, CASE WHEN p.x = 0 AND p.y = 0 AND p.z = 0 THEN 0 ELSE arg_min(l.loc_id, ({_D2}, l.loc_id)) END AS li FROM place p JOIN locs l ON l.map = p.map GROUP BY p.map, p.x, p.y, p.z),
located AS (SELECT p.*, near.li, name AS loc FROM positions p JOIN near USING (map, x, y, z) LEFT JOIN locs ON loc_id = near.li),
marks AS (SELECT match_id, player, t_ms FROM spawns UNION ALL SELECT match_id, player, t_ms FROM deaths)"""
_CTL = _LOC + """, cell AS (SELECT match_id, map, b AS bucket, b * 100000 AS t FROM matches, range(0, 26) r(b)),
latest AS (SELECT c.match_id, p.player, p.team, c.bucket, c.t, (SELECT arg_max(li, (t_ms, seq)) FROM located x WHERE x.match_id = c.match_id AND x.player = p.player AND x.t_ms <= c.t) AS li FROM cell c JOIN players p USING (match_id)),
place_at AS (SELECT l.match_id, l.player, l.team, bucket, region, EXISTS (SELECT 1 FROM intervals i WHERE i.field IN ('rl', 'lg') AND i.match_id = l.match_id AND i.player = l.player AND i.start_ms <= t AND t < i.end_ms) AS armed
  FROM latest l JOIN loc_regions ON loc_id = li),
teams AS (SELECT match_id, min(team) AS a, max(team) AS b FROM players GROUP BY match_id HAVING count(DISTINCT team) > 1),
cnt AS (SELECT match_id, region, bucket, count(*) FILTER (team = a AND armed) AS a_armed, count(*) FILTER (team = a AND NOT armed) AS a_not, count(*) FILTER (team = b AND armed) AS b_armed, count(*) FILTER (team = b AND NOT armed) AS b_not
  FROM place_at JOIN teams USING (match_id) GROUP BY match_id, region, bucket),
full_ AS (SELECT match_id, region, bucket::INT AS bucket, coalesce(a_armed, 0) AS a_armed, coalesce(a_not, 0) AS a_not, coalesce(b_armed, 0) AS b_armed, coalesce(b_not, 0) AS b_not
  FROM (SELECT match_id, bucket, region FROM (SELECT * FROM cell SEMI JOIN teams USING (match_id)) JOIN (SELECT DISTINCT map, region FROM loc_regions) USING (map)) LEFT JOIN cnt USING (match_id, region, bucket)),
ctl AS (SELECT *, CASE WHEN a_armed + a_not = 0 AND b_armed + b_not = 0 THEN 'Empty' WHEN b_armed + b_not = 0 AND a_armed = 0 THEN 'a' WHEN a_armed + a_not = 0 AND b_armed = 0 THEN 'b'
  WHEN a_armed > 0 AND b_armed > 0 THEN 'C' WHEN a_armed > 0 THEN 'A' WHEN b_armed > 0 THEN 'B' ELSE 'c' END AS state FROM full_)"""
_GRAPH = _LOC + """, g AS (SELECT match_id, player, seq, t_ms, x, y, 'L' || (li % 6) AS loc, (SELECT count(*) FROM marks m WHERE m.match_id = p.match_id AND m.player = p.player AND m.t_ms <= p.t_ms) AS bc FROM located p),
run AS (SELECT *, lead(t_ms) OVER w AS nt, lag(loc) OVER w AS was, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(bc) OVER w AS pbc FROM g WINDOW w AS (PARTITION BY match_id, player ORDER BY t_ms, seq)),
node AS (SELECT match_id, loc, player, sum(greatest(0, least(coalesce(nt - t_ms, 100000), 100000)))::BIGINT AS ms FROM run GROUP BY match_id, loc, player)"""
_TRAIL = """ c AS (SELECT match_id, player, t_ms, seq, loc FROM (SELECT *, lag(loc) OVER (PARTITION BY match_id, player ORDER BY t_ms, seq) AS was FROM src) WHERE was IS DISTINCT FROM loc),
s AS (SELECT match_id, player, t_ms AS start_ms, coalesce(lead(t_ms) OVER (PARTITION BY match_id, player ORDER BY t_ms, seq), {end}) AS end_ms, loc FROM c),
trail AS (SELECT match_id, player, greatest(start_ms, {start}) AS start_ms, least(end_ms, {end}) AS end_ms, loc FROM s WHERE end_ms > {start} AND start_ms < {end})"""

ORACLES = {
    "nearest_point": _LOC + " SELECT match_id, player, seq, li FROM located",
    "points_within": _LOC + f" SELECT p.map, p.x, p.y, p.z, l.loc_id FROM place p JOIN locs l ON l.map = p.map WHERE {_D2} <= CAST(360000 AS FLOAT)",
    "visible_nearest": _LOC + f""", leaf AS (SELECT DISTINCT map, x, y, z, seq % 7 AS leaf FROM positions),
seen AS (SELECT p.map, p.x, p.y, p.z, leaf, arg_min(l.loc_id, ({_D2}, l.loc_id)) AS li FROM leaf p JOIN locs l ON l.map = p.map AND l.loc_id % 5 = leaf GROUP BY ALL)
SELECT p.match_id, p.player, p.seq, coalesce(seen.li, p.li) AS li FROM located p LEFT JOIN seen ON seen.map = p.map AND seen.x = p.x AND seen.y = p.y AND seen.z = p.z AND leaf = p.seq % 7""",
    "blip_filter": _LOC + """, tr AS (SELECT match_id, player, seq, t_ms, li % 3 AS li, (SELECT count(*) FROM marks m WHERE m.match_id = p.match_id AND m.player = p.player AND m.t_ms <= p.t_ms) AS bc FROM located p),
a AS (SELECT *, lead(t_ms) OVER w AS nt, lag(li) OVER w AS pl, lag(bc) OVER w AS pb FROM tr WINDOW w AS (PARTITION BY match_id, player ORDER BY t_ms, seq)),
b AS (SELECT *, sum(CASE WHEN pl IS NULL OR pl = 0 OR pb <> bc THEN 1 ELSE 0 END) OVER w AS run, sum(CASE WHEN pl IS NULL OR pl = 0 OR pb <> bc OR pl <> li THEN 1 ELSE 0 END) OVER w AS seg FROM a WHERE li <> 0 WINDOW w AS (PARTITION BY match_id, player ORDER BY t_ms, seq)),
s AS (SELECT match_id, player, run, seg, min(t_ms) AS t0, max(t_ms) AS t1, arg_max(coalesce(nt, -1), (t_ms, seq)) AS n, min(li) AS own FROM b GROUP BY ALL),
s2 AS (SELECT *, coalesce(lead(t0) OVER (PARTITION BY match_id, player, run ORDER BY seg), nullif(n, -1), t1) - t0 >= 100000 AS st FROM s),
s3 AS (SELECT *, last_value(CASE WHEN st THEN own END IGNORE NULLS) OVER (PARTITION BY match_id, player, run ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  first_value(CASE WHEN st THEN own END IGNORE NULLS) OVER (PARTITION BY match_id, player, run ORDER BY seg ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx, sum(st::INT) OVER (PARTITION BY match_id, player, run ORDER BY seg) AS grp FROM s2),
j AS (SELECT b.*, st, pv, nx, row_number() OVER (PARTITION BY b.match_id, b.player, b.run, grp, st ORDER BY t_ms, seq) AS rn, count(*) OVER (PARTITION BY b.match_id, b.player, b.run, grp, st) AS cnt FROM b JOIN s3 USING (match_id, player, seg))
SELECT match_id, player, seq, t_ms, li, CASE WHEN st OR (pv IS NULL AND nx IS NULL) THEN li WHEN pv IS NULL THEN nx WHEN nx IS NULL THEN pv WHEN rn <= (cnt + 1) // 2 THEN pv ELSE nx END AS smooth FROM j
UNION ALL SELECT match_id, player, seq, t_ms, li, 0 FROM tr WHERE li = 0""",
    "loc_trails": _LOC + ", src AS (SELECT * FROM located)," + _TRAIL.format(start=200000, end=2400000) + " SELECT * FROM trail",
    "loc_trails_merged": _LOC + ", src AS (SELECT match_id, player, t_ms, seq, 'L' || (li % 4) AS loc FROM located)," + _TRAIL.format(start=0, end=2592000) + """,
k AS (SELECT *, row_number() OVER w = 1 AS f, row_number() OVER w = 1 OR end_ms - start_ms >= 150000 AS keep FROM trail WINDOW w AS (PARTITION BY match_id, player ORDER BY start_ms)),
m AS (SELECT *, last_value(CASE WHEN keep THEN loc END IGNORE NULLS) OVER (PARTITION BY match_id, player ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM k),
r AS (SELECT *, sum((keep AND (f OR loc IS DISTINCT FROM was))::INT) OVER (PARTITION BY match_id, player ORDER BY start_ms) AS run FROM m)
SELECT match_id, player, min(start_ms) AS start_ms, arg_max(end_ms, start_ms) AS end_ms, arg_min(loc, start_ms) AS loc FROM r GROUP BY match_id, player, run""",
    "life_tracks": _LOC + """, r AS (SELECT match_id, player, t_ms, seq, 1 AS kind, loc FROM located UNION ALL SELECT match_id, player, t_ms, seq, 0, NULL FROM spawns UNION ALL SELECT match_id, player, t_ms, seq, 2, NULL FROM deaths),
n AS (SELECT *, count(*) FILTER (kind = 0) OVER (PARTITION BY match_id, player ORDER BY t_ms, kind, seq ROWS UNBOUNDED PRECEDING) AS life FROM r),
d AS (SELECT *, min(t_ms) FILTER (kind = 2) OVER (PARTITION BY match_id, player, life) AS death_ms FROM n WHERE life > 0),
b AS (SELECT *, last_value(loc IGNORE NULLS) OVER (PARTITION BY match_id, player, life ORDER BY t_ms, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM d WHERE death_ms IS NULL OR t_ms <= death_ms)
SELECT match_id, player, life, min(t_ms) FILTER (kind = 0) AS spawn_ms, any_value(death_ms) AS death_ms, coalesce(string_agg(loc, '>' ORDER BY t_ms, seq) FILTER (kind = 1 AND loc IS DISTINCT FROM was), '') AS locs
FROM b GROUP BY match_id, player, life HAVING any_value(death_ms) IS NOT NULL OR count(*) FILTER (kind = 1) > 0""",
    "loc_intern": _LOC + " SELECT match_id, name, row_number() OVER (PARTITION BY match_id ORDER BY t, p, s)::INT AS li FROM (SELECT match_id, loc AS name, min(t_ms) AS t, arg_min(player, (t_ms, player, seq)) AS p, arg_min(seq, (t_ms, player, seq)) AS s FROM located GROUP BY match_id, loc)",
    "map_bounds": SQL + ", pts AS (SELECT match_id, x::DOUBLE AS x, y::DOUBLE AS y FROM positions WHERE x <> 0 OR y <> 0 OR z <> 0 UNION ALL SELECT m.match_id, l.x, l.y FROM (SELECT DISTINCT match_id, map FROM positions) m JOIN locs l USING (map)) SELECT match_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM pts GROUP BY match_id",
    "height_range": SQL + ", r AS (SELECT match_id, z, row_number() OVER (PARTITION BY match_id ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY match_id) AS n FROM positions) SELECT match_id, max(z) FILTER (i = least(floor(n * 0.02), n - 1)) AS z_low, max(z) FILTER (i = least(floor(n * 0.98), n - 1)) AS z_high FROM r GROUP BY match_id",
    "region_centroids": SQL + " SELECT map, region, round(avg(x::DOUBLE), 4) AS cx, round(avg(y::DOUBLE), 4) AS cy FROM locs JOIN loc_regions USING (map, loc_id) GROUP BY map, region",
    "region_control": _CTL + " SELECT * FROM ctl",
    "region_shares": _CTL + " SELECT match_id, region, " + ", ".join(f"floor(count(*) FILTER (state = '{s}') / count(*) * 1000 + 0.5) / 10 AS {n}" for s, n in zip(R.STATES, ("empty", "a_control", "a_weak", "b_control", "b_weak", "contested", "weak_contested"), strict=True)) + " FROM ctl GROUP BY match_id, region",
    "region_spans": _CTL + """, r AS (SELECT *, sum(n) OVER (PARTITION BY match_id, region ORDER BY bucket) AS run FROM (SELECT *, (lag(state) OVER (PARTITION BY match_id, region ORDER BY bucket) IS DISTINCT FROM state)::INT AS n FROM ctl))
SELECT match_id, region, state, min(bucket) AS first, max(bucket) AS last FROM r GROUP BY match_id, region, run, state""",
    "region_strings": _CTL + " SELECT match_id, region, string_agg(CASE state WHEN 'Empty' THEN '.' ELSE state END, '' ORDER BY bucket) AS states FROM ctl GROUP BY match_id, region",
    "region_players": _CTL + " SELECT match_id, region, player, team, count(*) FILTER (armed) AS armed, count(*) FILTER (NOT armed) AS unarmed FROM place_at GROUP BY ALL",
    "graph_nodes": _GRAPH + " SELECT * FROM node",
    "graph_edges": _GRAPH + """, e AS (SELECT match_id, was AS from_loc, loc AS to_loc, player, t_ms, seq, CASE WHEN greatest(abs(x - px), abs(y - py)) > 500 THEN 'teleport' ELSE 'normal' END AS k FROM run WHERE pbc = bc AND was <> loc)
SELECT match_id, from_loc, to_loc, player, count(*) AS n, any_value(kind) AS kind FROM e JOIN (SELECT match_id, from_loc, to_loc, arg_min(k, (t_ms, player, seq)) AS kind FROM e GROUP BY ALL) USING (match_id, from_loc, to_loc) GROUP BY match_id, from_loc, to_loc, player""",
    "loc_heatmap": _GRAPH + ", h AS (SELECT match_id, player, loc, CASE WHEN t > 0 THEN ms / t END AS share FROM (SELECT *, sum(ms) OVER (PARTITION BY match_id, player) AS t FROM node)) SELECT match_id, player, loc, round(share, 6) AS share, round(CASE WHEN m > 0 THEN sqrt(share / m) END, 6) AS shade FROM (SELECT *, max(share) OVER (PARTITION BY match_id, player) AS m FROM h)",
}
