"""Queries of who took which item, and the SQL that must give the same rows.

A day of the given events is a fifth of a second here, so that items come back, and evidence arrives, within a match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalake.functions.temporal import KEYS
from arenalake.operators import attribution as A
from arenalake.operators import pickups as U
from arenalake.sources.lens import SQL, Lens


def _inputs(lens: Lens) -> tuple[DataFrame, ...]:
    """Item states, hints, prints, stat evidence, positions and matches."""
    rows = lens.base.withColumn("t_ms", F.floor(F.col("t_ms") / 20).cast("int"))
    of = lambda *t: rows.filter(F.col("event_type").isin(*t))
    ent, kinds = F.col("k") % 4, F.array(*map(F.lit, ("ra", "rl", "h25", "mh")))
    place = [(ent * 40).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(24.0).alias("z")]
    states = of("click").filter("k < 12").select("match_id", ent.alias("ent"), kinds[ent].alias("kind"), *place, "t_ms", "seq", (F.col("iv") % 4 > 0).alias("taken"))
    hints = of("view").filter("k % 10 = 3").select("match_id", (F.floor(F.col("k") / 10) % 4).cast("int").alias("ent"), "t_ms", "seq", "player")
    prints = of("purchase").filter("k % 4 = 1").select(*KEYS, kinds[F.col("k") % 3].alias("kind"), "t_ms", "seq")
    stats = of("error", "signup", "purchase").select(*KEYS, kinds[F.col("k") % 3].alias("kind"), "t_ms", "seq")
    positions = rows.select(*KEYS, "t_ms", "seq", F.col("iv").alias("x"), (F.col("k") * 8 - 400).alias("y"), F.lit(0).alias("z"))
    matches = lens.matches.withColumn("match_end_ms", F.floor(F.col("match_end_ms") / 20).cast("int"))
    return states, hints, prints, stats, positions, matches


def items_resynth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.resynth(*_inputs(Lens(spark, sf_dir)))


def item_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.attribute(*_inputs(Lens(spark, sf_dir)))


def attribution_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.tally(A.resynth(*_inputs(Lens(spark, sf_dir))))


QUERIES = {f.__name__: f for f in (items_resynth, item_attribution, attribution_sources)}

#: {hint}: which hint serves a state, {more}: pickups that no state shows
_FOLD = (
    SQL.replace("WITH base", "WITH RECURSIVE base", 1)
    + """, ev AS (SELECT match_id, player, floor(t_ms / 20)::INT AS t, seq, event_type AS e, iv, k FROM base),
st AS (SELECT match_id, k % 4 AS ent, t, seq, iv % 4 > 0 AS taken FROM ev WHERE e = 'click' AND k < 12),
ch AS (SELECT * FROM (SELECT *, coalesce(lag(taken) OVER (PARTITION BY match_id, ent ORDER BY t, seq), false) AS was FROM st) WHERE taken <> was),
hi AS (SELECT match_id, (k // 10) % 4 AS ent, t, seq, player FROM ev WHERE e = 'view' AND k % 10 = 3),
ha AS (SELECT hi.*, coalesce((SELECT arg_max(taken, (t, seq)) FROM ch WHERE ch.match_id = hi.match_id AND ch.ent = hi.ent AND ch.t < hi.t), false) AS gone FROM hi),
tk AS (SELECT c.match_id, c.ent, c.t, c.seq, {hint} AS h FROM ch c WHERE taken),
t1 AS (SELECT match_id, ent, t, seq, CASE WHEN row_number() OVER (PARTITION BY match_id, ent, h.seq ORDER BY t, seq) = 1 THEN h.player END AS hint FROM tk),
b0 AS (SELECT * FROM t1{more}),
sg AS (SELECT match_id, ent, t, seq, hint, true AS own FROM b0 UNION ALL SELECT match_id, ent, t, seq, NULL, false FROM ch WHERE NOT taken),
b AS (SELECT match_id, ent, t, seq, hint, 0 AS chain, coalesce(until, 129601) AS until, ['ra', 'rl', 'h25', 'mh'][ent + 1] AS kind, t AS due, ent || ':' || seq AS base
      FROM (SELECT *, lead(t) OVER (PARTITION BY match_id, ent ORDER BY t, seq) AS until FROM sg) WHERE own),
x AS (SELECT * REPLACE (t + chain2 * step AS t, NULL AS hint, chain2 AS chain, t + chain2 * step + 500 AS due) FROM (
        SELECT *, unnest(range(1, least(60, greatest((until - 501 - t) // step, 0)) + 1)) AS chain2 FROM (SELECT *, CASE kind WHEN 'rl' THEN 30000 ELSE 20000 END AS step FROM b WHERE kind <> 'mh'))),
r AS (SELECT match_id, ent, t, seq, hint, chain, kind, due, base FROM b UNION ALL SELECT match_id, ent, t, seq, hint, chain, kind, due, base FROM x{synthetic}),
ps AS (SELECT match_id, player, t, seq, iv - 0 AS x, k * 8 - 400 AS y FROM ev),
pr AS (SELECT match_id, player, ['ra', 'rl', 'h25'][k % 3 + 1] AS kind, t, seq FROM ev WHERE e = 'purchase' AND k % 4 = 1),
es AS (SELECT match_id, player, ['ra', 'rl', 'h25'][k % 3 + 1] AS kind, t, seq FROM ev WHERE e IN ('error', 'signup', 'purchase')),
n AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY due, chain > 0, seq, chain) AS n FROM r),
np AS (SELECT n.match_id, n.n, list({'seq': p.seq, 'player': p.player} ORDER BY p.t, p.seq) AS prints FROM n JOIN pr p ON p.match_id = n.match_id AND p.kind = n.kind AND p.t - n.t BETWEEN -250 AND 250 WHERE chain = 0 GROUP BY ALL),
ns AS (SELECT n.match_id, n.n, list({'seq': p.seq, 'player': p.player} ORDER BY p.t, p.seq) AS stats FROM n JOIN es p ON p.match_id = n.match_id AND p.kind = n.kind AND p.t - n.t BETWEEN -100 AND 500 GROUP BY ALL),
nd AS (SELECT n.match_id, n.n, p.player, arg_max((p.x - ent * 40) * (p.x - ent * 40) + p.y * p.y + 576, CASE WHEN chain = 0 THEN (0, p.t, p.seq) ELSE (-abs(p.t - n.t), -p.t, p.seq) END) AS d
       FROM n JOIN ps p ON p.match_id = n.match_id AND p.t - n.t BETWEEN CASE WHEN chain = 0 THEN -250 ELSE -500 END AND CASE WHEN chain = 0 THEN 0 ELSE 500 END GROUP BY n.match_id, n.n, p.player),
nc AS (SELECT match_id, n, list(player ORDER BY d, player) AS close FROM nd WHERE d <= 65536 GROUP BY ALL),
d AS (SELECT n.*, coalesce(prints, []) AS prints, coalesce(stats, []) AS stats, coalesce(close, []) AS close FROM n LEFT JOIN np USING (match_id, n) LEFT JOIN ns USING (match_id, n) LEFT JOIN nc USING (match_id, n)),
f AS (
  SELECT DISTINCT match_id, 0::BIGINT AS n, []::VARCHAR[] AS used, []::VARCHAR[] AS broken, NULL::VARCHAR AS player, NULL::VARCHAR AS source FROM d
  UNION ALL
  SELECT match_id, n,
         CASE source WHEN 'print' THEN list_append(used, 'p' || fp[1].seq) WHEN 'stat' THEN list_append(used, 's' || fs[1].seq) WHEN 'synthetic' THEN list_append(used, 's' || list_filter(fs, lambda e: e.player = who)[1].seq)
           WHEN 'distance' THEN CASE WHEN len(sp) > 0 THEN list_append(used, 's' || list_filter(fs, lambda e: e.player = who)[1].seq) ELSE used END ELSE used END,
         CASE WHEN chain > 0 AND source IS NULL THEN list_append(broken, base) ELSE broken END, who, source
  FROM (
    SELECT *, CASE WHEN chain > 0 THEN CASE WHEN NOT dead AND len(sc) = 1 THEN sc[1] END WHEN hint IS NOT NULL THEN hint WHEN len(pp) = 1 THEN pp[1] WHEN len(sp) = 1 THEN sp[1] ELSE cl[1] END AS who,
           CASE WHEN chain > 0 THEN CASE WHEN NOT dead AND len(sc) = 1 THEN 'synthetic' END WHEN hint IS NOT NULL THEN 'hint' WHEN len(pp) = 1 THEN 'print' WHEN len(sp) = 1 THEN 'stat' WHEN len(cl) > 0 THEN 'distance' ELSE 'none' END AS source
    FROM (
      SELECT *, list_distinct(list_transform(fp, lambda e: e.player)) AS pp, list_distinct(list_transform(fs, lambda e: e.player)) AS sp,
             list_distinct(list_filter(list_transform(fs, lambda e: e.player), lambda q: list_contains(close, q))) AS sc,
             list_filter(close, lambda q: len(fs) = 0 OR list_contains(list_transform(fs, lambda e: e.player), q)) AS cl
      FROM (SELECT d.*, f.used, f.broken, list_contains(f.broken, d.base) AS dead, list_filter(d.prints, lambda e: NOT list_contains(f.used, 'p' || e.seq)) AS fp, list_filter(d.stats, lambda e: NOT list_contains(f.used, 's' || e.seq)) AS fs
            FROM f JOIN d ON d.match_id = f.match_id AND d.n = f.n + 1)))),
o AS (SELECT d.match_id, d.ent, d.kind, d.t AS t_ms, d.seq, d.chain, f.player, f.source FROM f JOIN d USING (match_id, n) WHERE f.source IS NOT NULL)
"""
)
_BEFORE = "(SELECT arg_max({'t': a.t, 'seq': a.seq, 'player': a.player}, (a.t, a.seq)) FROM ha a WHERE a.match_id = c.match_id AND a.ent = c.ent AND NOT a.gone AND a.t <= c.t AND c.t - a.t <= 250 AND NOT EXISTS (FROM ha z WHERE z.match_id = c.match_id AND z.ent = c.ent AND NOT z.gone AND z.t <= c.t AND (z.t, z.seq) > (a.t, a.seq)))"
_EITHER = "(SELECT arg_min({'t': a.t, 'seq': a.seq, 'player': a.player}, (abs(a.t - c.t), a.t > c.t, CASE WHEN a.t > c.t THEN a.seq ELSE -a.seq END)) FROM ha a WHERE a.match_id = c.match_id AND a.ent = c.ent AND abs(a.t - c.t) <= 250)"
_RESYNTH = _FOLD.replace("{hint}", _BEFORE).replace("{more}", " UNION ALL SELECT match_id, ent, t, seq, player FROM ha WHERE gone").replace("{synthetic}", "")
ORACLES = {
    "items_resynth": _RESYNTH + "SELECT * FROM o",
    "item_attribution": _FOLD.replace("{hint}", _EITHER).replace("{more}", "").replace("{synthetic}", " WHERE false") + "SELECT match_id, ent, kind, t_ms, seq, player, source FROM o",
    "attribution_sources": _RESYNTH + "SELECT match_id, source, count(*) AS n FROM o GROUP BY ALL",
}
