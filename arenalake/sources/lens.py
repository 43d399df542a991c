"""The driver's tables seen as match tables: each of ten users of ``events`` plays in one match.

``Lens`` gives the silver tables as DataFrames; ``SQL`` is the same projection for the oracle queries.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalake.functions.temporal import changed, flips

MATCH_END = 2_592_000


def _map(key: str) -> Column:
    """Two maps: matches and points alternate between them."""
    return F.concat(F.lit("m"), (F.col(key) % 2).cast("string")).alias("map")


class Lens:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        e = self.table("events")
        team = F.when(F.col("user_id") % 2 == 0, "red").otherwise("blue")
        return e.select(
            F.floor(F.col("user_id") / 10.0).cast("int").alias("match_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("player"),
            F.col("event_id").alias("seq"), team.alias("team"), F.expr("cast(timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) as int)").alias("t_ms"),
            "event_type", F.floor("value").cast("int").alias("iv"), F.floor(F.col("value") * 10).cast("int").alias("xv"),
            F.get_json_object("props", "$.k").cast("int").alias("k"), "user_id",
        )

    def _of(self, kind: str) -> DataFrame:
        return self.base.filter(F.col("event_type") == kind)

    @cached_property
    def matches(self) -> DataFrame:
        return self.base.select("match_id").distinct().select("match_id", F.lit(0).alias("match_start_ms"), F.lit(MATCH_END).alias("match_end_ms"), _map("match_id"))

    @cached_property
    def players(self) -> DataFrame:
        return self.base.select("match_id", "player", "team").distinct()

    def number(self, field: str) -> DataFrame:
        """(match_id, player, seq, t_ms, v): h from purchases, a from clicks."""
        kind, modulus = {"h": ("purchase", 251), "a": ("click", 201)}[field]
        return changed(self._of(kind).select("match_id", "player", "seq", "t_ms", (F.col("iv") % modulus).alias("v")), "v")

    @cached_property
    def armor_type(self) -> DataFrame:
        kinds = F.array(*map(F.lit, ("", "ga", "ya", "ra")))
        return changed(self._of("click").select("match_id", "player", "seq", "t_ms", kinds[F.col("k") % 4].alias("v")), "v")

    def interval(self, field: str) -> DataFrame:
        """(match_id, player, start_ms, end_ms) of rl, lg, gl, q, pe and r."""
        kind, flag = {"rl": ("purchase", F.col("k") % 2 == 1), "lg": ("click", F.col("k") % 3 == 0), "q": ("view", F.col("k") % 10 == 0), "gl": ("purchase", F.col("k") % 3 == 1), "pe": ("click", F.col("k") % 7 == 0), "r": ("view", F.col("k") % 9 == 1)}[field]
        return flips(self._of(kind).select("match_id", "player", "seq", "t_ms", flag.alias("on")), "on", F.lit(MATCH_END))

    @cached_property
    def positions(self) -> DataFrame:
        return self._of("view").select("match_id", "player", "seq", "t_ms", F.col("xv").alias("x"), (F.col("k") * 40 - 2000).alias("y"), ((F.col("user_id") % 8) * 64).cast("int").alias("z"), _map("match_id"))

    def marks(self, mark: str) -> DataFrame:
        return self._of({"sp": "signup", "d": "error"}[mark]).select("match_id", "player", "seq", "t_ms")

    @cached_property
    def frag_log(self) -> DataFrame:
        killer = F.floor(F.col("user_id") / 10) * 10 + F.col("k") % 10
        weapon = F.array(*map(F.lit, ("rl", "lg", "ssg", "axe")))[F.col("k") % 4]
        same = killer == F.col("user_id")
        return self._of("error").select(
            "match_id", "seq", "t_ms", F.concat(F.lit("u"), killer.cast("string")).alias("killer"), F.col("player").alias("victim"), weapon.alias("weapon"),
            same.alias("is_suicide"), (~same & (killer % 2 == F.col("user_id") % 2)).alias("is_team_kill"),
        )

    @cached_property
    def locs(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(F.col("s_suppkey").cast("int").alias("loc_id"), F.col("s_acctbal").cast("float").alias("x"), ((F.col("s_nationkey") - 12) * 160).cast("float").alias("y"), F.lit(0.0).cast("float").alias("z"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), _map("s_suppkey"))

    @cached_property
    def regions(self) -> DataFrame:
        """(map, loc_id, region): the region of a point's nation."""
        n, r = self.table("nation"), self.table("region")
        named = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("r_name").alias("region"))
        return self.locs.join(F.broadcast(named), F.col("nation") == F.col("n_nationkey")).select("map", "loc_id", "region")

    @cached_property
    def catalog(self) -> DataFrame:
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), F.col("n_name").alias("map"), F.col("o_orderpriority").alias("mode"), F.col("c_mktsegment").alias("matchtag"), F.col("c_name").alias("player"), F.col("o_totalprice").alias("price"))

    @cached_property
    def games(self) -> DataFrame:
        """The catalog with all players (who ordered, and who supplied what) and teams (both sides' nations)."""
        n = self.table("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("team"))
        s = self.table("supplier").select(F.col("s_suppkey").alias("supp"), "s_name", F.col("s_nationkey").alias("nation")).join(F.broadcast(n), "nation")
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("supp")).join(s, "supp")
        sides = lines.groupBy("id").agg(F.collect_set("s_name").alias("names"), F.collect_set("team").alias("sides"))
        empty = F.array().cast("array<string>")
        both = self.catalog.join(sides, "id", "left")
        return both.select("id", "day", "map", "mode", "matchtag", F.array_union(F.array("player"), F.coalesce("names", empty)).alias("players"), F.array_union(F.array("map"), F.coalesce("sides", empty)).alias("teams"))

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("match_id"), F.col("turn").alias("seq"), F.col("role").alias("player"), F.col("text").alias("message"))


SQL = """WITH base AS (
  SELECT CAST(floor(user_id / 10.0) AS INT) AS match_id, concat('u', CAST(user_id AS VARCHAR)) AS player, event_id AS seq,
         CASE WHEN user_id % 2 = 0 THEN 'red' ELSE 'blue' END AS team, CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS INT) AS t_ms,
         event_type, CAST(floor(value) AS INT) AS iv, CAST(floor(value * 10) AS INT) AS xv, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id
  FROM events),
matches AS (SELECT DISTINCT match_id, 0 AS match_start_ms, 2592000 AS match_end_ms, 'm' || (match_id % 2) AS map FROM base),
players AS (SELECT DISTINCT match_id, player, team FROM base),
raw AS (
  SELECT 'h' AS field, match_id, player, seq, t_ms, iv % 251 AS v FROM base WHERE event_type = 'purchase' UNION ALL
  SELECT 'a', match_id, player, seq, t_ms, iv % 201 FROM base WHERE event_type = 'click' UNION ALL
  SELECT 'at', match_id, player, seq, t_ms, k % 4 FROM base WHERE event_type = 'click' UNION ALL
  SELECT 'rl', match_id, player, seq, t_ms, CAST(k % 2 = 1 AS INT) FROM base WHERE event_type = 'purchase' UNION ALL
  SELECT 'lg', match_id, player, seq, t_ms, CAST(k % 3 = 0 AS INT) FROM base WHERE event_type = 'click' UNION ALL
  SELECT 'q', match_id, player, seq, t_ms, CAST(k % 10 = 0 AS INT) FROM base WHERE event_type = 'view' UNION ALL
  SELECT 'gl', match_id, player, seq, t_ms, CAST(k % 3 = 1 AS INT) FROM base WHERE event_type = 'purchase' UNION ALL
  SELECT 'pe', match_id, player, seq, t_ms, CAST(k % 7 = 0 AS INT) FROM base WHERE event_type = 'click' UNION ALL
  SELECT 'r', match_id, player, seq, t_ms, CAST(k % 9 = 1 AS INT) FROM base WHERE event_type = 'view'),
changes AS (SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY field, match_id, player ORDER BY t_ms, seq) AS was FROM raw) WHERE was IS NULL OR was <> v),
intervals AS (SELECT field, match_id, player, t_ms AS start_ms, coalesce(nxt, 2592000) AS end_ms
  FROM (SELECT *, lead(t_ms) OVER (PARTITION BY field, match_id, player ORDER BY t_ms, seq) AS nxt FROM changes WHERE field IN ('rl', 'lg', 'q', 'gl', 'pe', 'r')) WHERE v = 1),
positions AS (SELECT match_id, player, seq, t_ms, xv AS x, k * 40 - 2000 AS y, CAST((user_id % 8) * 64 AS INT) AS z, 'm' || (match_id % 2) AS map FROM base WHERE event_type = 'view'),
spawns AS (SELECT match_id, player, seq, t_ms FROM base WHERE event_type = 'signup'),
deaths AS (SELECT match_id, player, seq, t_ms FROM base WHERE event_type = 'error'),
frags AS (SELECT match_id, seq, t_ms, concat('u', CAST(CAST(floor(user_id / 10) * 10 + k % 10 AS BIGINT) AS VARCHAR)) AS killer, player AS victim,
    ['rl', 'lg', 'ssg', 'axe'][k % 4 + 1] AS weapon, floor(user_id / 10) * 10 + k % 10 = user_id AS is_suicide,
    floor(user_id / 10) * 10 + k % 10 <> user_id AND (k % 10) % 2 = (user_id % 10) % 2 AS is_team_kill FROM base WHERE event_type = 'error'),
locs AS (SELECT CAST(s_suppkey AS INT) AS loc_id, CAST(s_acctbal AS FLOAT) AS x, CAST((s_nationkey - 12) * 160 AS FLOAT) AS y, CAST(0 AS FLOAT) AS z, s_name AS name, s_nationkey AS nation, 'm' || (s_suppkey % 2) AS map FROM supplier),
loc_regions AS (SELECT map, loc_id, r_name AS region FROM locs JOIN nation ON nation = n_nationkey JOIN region ON n_regionkey = r_regionkey),
catalog AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, n_name AS map, o_orderpriority AS mode, c_mktsegment AS matchtag, c_name AS player, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""
