"""Territorial control, its shares and spans, and the movement graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalake.functions.temporal import KEYS, asof, held

STATES = "Empty", "A", "a", "B", "b", "C", "c"  #: nobody, A armed, A unarmed, B armed, B unarmed, contested, weakly contested


def infer_teams(players: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """(match_id, team_a, team_b): the first two teams of ``ranked`` (match_id, team, ord) where it names both, otherwise
    the first two by name; matches with fewer teams are left out."""
    own = players.filter("team <> ''").groupBy("match_id").agg(F.array_sort(F.collect_set("team")).alias("teams"))
    if ranked is not None:
        order = ranked.groupBy("match_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "team"))), lambda x: x["team"]).alias("order"))
        own = own.join(order, "match_id", "left").withColumn("teams", F.when(F.size(F.array_intersect("order", "teams")) >= 2, F.array_intersect("order", "teams")).otherwise(F.col("teams")))
    return own.filter(F.size("teams") >= 2).select("match_id", F.col("teams")[0].alias("team_a"), F.col("teams")[1].alias("team_b"))


def team_of(*sources: DataFrame) -> DataFrame:
    """(match_id, player, team) from sources in order of priority; a slot suffix (#...) of a name doesn't count."""
    plain = F.regexp_replace("player", "#[^#]*$", "")
    rows = None
    for rank, s in enumerate(sources):
        one = s.filter("team <> ''").select("match_id", plain.alias("player"), "team", F.lit(rank).alias("rank"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*KEYS).agg(F.min_by("team", F.struct("rank", "team")).alias("team"))


def with_teams(players: DataFrame, override: DataFrame) -> DataFrame:
    """``players`` with the teams that ``override`` (match_id, player, team) names; an empty team takes a player out of all."""
    own = override.select(*KEYS, F.col("team").alias("_team"))
    return players.join(own, KEYS, "left").withColumn("team", F.coalesce("_team", "team")).drop("_team")


def classify(a_armed: Column, a_not: Column, b_armed: Column, b_not: Column) -> Column:
    """The seven-state rule."""
    a, b = a_armed + a_not, b_armed + b_not
    one_sided = F.when((a == 0) & (b == 0), "Empty").when(b == 0, F.when(a_armed > 0, "A").otherwise("a")).when(a == 0, F.when(b_armed > 0, "B").otherwise("b"))
    return one_sided.when((a_armed > 0) & (b_armed > 0), "C").when(a_armed > 0, "A").when(b_armed > 0, "B").otherwise("c")


def presence(grid: DataFrame, players: DataFrame, located: DataFrame, regions: DataFrame, armed_spans: list[DataFrame], alive: DataFrame | None = None) -> DataFrame:
    """(match_id, player, team, bucket, region, armed): where each player's latest position at a bucket's start lies.

    There is no liveness gate unless ``alive`` (match_id, player, bucket) is given.
    """
    probes = players.join(grid, "match_id").select(*KEYS, "team", "bucket", F.col("b_start").alias("t_ms"))
    if alive is not None:
        probes = probes.join(alive, [*KEYS, "bucket"], "left_semi")
    at = asof(probes, located, ["li"]).filter(F.coalesce("li", F.lit(0)) != 0)
    at = at.join(regions.select(F.col("loc_id").alias("li"), "region"), "li")
    spans = armed_spans[0].select(*KEYS, "start_ms", "end_ms")
    for more in armed_spans[1:]:
        spans = spans.unionByName(more.select(*KEYS, "start_ms", "end_ms"))
    return held(at, spans, "armed").select(*KEYS, "team", "bucket", "region", "armed")


def control(where: DataFrame, grid: DataFrame, regions: DataFrame, teams: DataFrame, matches: DataFrame) -> DataFrame:
    """(match_id, region, bucket, a_armed, a_not, b_armed, b_not, state) for every bucket and region of the match's map."""
    sides = where.join(teams, "match_id")
    of = lambda team, armed: F.count_if((F.col("team") == F.col(team)) & (F.col("armed") == armed))
    counts = sides.groupBy("match_id", "region", "bucket").agg(of("team_a", True).alias("a_armed"), of("team_a", False).alias("a_not"), of("team_b", True).alias("b_armed"), of("team_b", False).alias("b_not"))
    own = matches.join(teams, "match_id", "left_semi").select("match_id", "map").join(regions.select("map", "region").distinct(), "map").select("match_id", "region")
    frame = grid.select("match_id", "bucket").join(own, "match_id")
    full = frame.join(counts, ["match_id", "region", "bucket"], "left").na.fill(0, ["a_armed", "a_not", "b_armed", "b_not"])
    return full.withColumn("state", classify(*map(F.col, ("a_armed", "a_not", "b_armed", "b_not"))))


def shares(states: DataFrame) -> DataFrame:
    """Percentage of buckets in each state, to one decimal, rounded half up."""
    n = F.count("*")
    share = lambda s: F.floor(F.count_if(F.col("state") == s) / n * 1000 + 0.5) / 10
    names = ("empty", "a_control", "a_weak", "b_control", "b_weak", "contested", "weak_contested")
    return states.groupBy("match_id", "region").agg(*[share(s).alias(name) for s, name in zip(STATES, names, strict=True)])


def heatmap(table: DataFrame) -> DataFrame:
    """``shares`` with a shade for each state: its share of the region's largest, the empty state aside (which has none)."""
    names = ["a_control", "a_weak", "contested", "weak_contested", "b_weak", "b_control"]
    top = F.greatest(*names)
    return table.withColumns({f"{n}_shade": F.col(n) / F.when(top > 0, top).otherwise(1.0) for n in names})


def by_player(where: DataFrame) -> DataFrame:
    """Buckets each player spent in a region, armed and not."""
    return where.groupBy("match_id", "region", "player", "team").agg(F.count_if("armed").alias("armed"), F.count_if(~F.col("armed")).alias("unarmed"))


def state_strings(states: DataFrame) -> DataFrame:
    """One letter a bucket, in order ('.' for nobody)."""
    letter = F.when(F.col("state") == "Empty", ".").otherwise(F.col("state"))
    return states.groupBy("match_id", "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", letter.alias("s")))), lambda x: x["s"]), "").alias("states"))


def spans(states: DataFrame) -> DataFrame:
    """Runs of equal states: (match_id, region, state, first, last) bucket."""
    w = Window.partitionBy("match_id", "region").orderBy("bucket")
    new = ~F.col("state").eqNullSafe(F.lag("state").over(w))
    runs = states.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("match_id", "region", "_run", "state").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last")).drop("_run")


def heat(times: DataFrame, column: str, value: str) -> DataFrame:
    """Share of each location in its column's total, and its square root against the column's largest share."""
    w = Window.partitionBy("match_id", column)
    share = F.try_divide(F.col(value), F.sum(value).over(w))
    return times.withColumn("share", share).withColumn("shade", F.sqrt(F.try_divide(F.col("share"), F.max("share").over(w))))


def _runs(located: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Located samples with the next sample's time, and the sample before in the same run (none across boundaries)."""
    w = Window.partitionBy(*KEYS).orderBy("t_ms", "seq")
    ranked = boundaries.select(*KEYS, "t_ms").withColumn("bc", F.row_number().over(Window.partitionBy(*KEYS).orderBy("t_ms")))
    x = asof(located, ranked, ["bc"]).withColumn("bc", F.coalesce("bc", F.lit(0)))
    before = {f"_{c}": F.lag(c).over(w) for c in ("loc", "x", "y", "bc")}
    x = x.withColumns({"_next": F.lead("t_ms").over(w), **before})
    joined = (F.col("_bc") == F.col("bc")) & (F.col("_loc") != "")
    return x.filter("loc <> ''").withColumn("_joined", F.coalesce(joined, F.lit(False)))


def graph_nodes(located: DataFrame, boundaries: DataFrame, cap_ms: int = 50) -> DataFrame:
    """Milliseconds spent at each location by player; a sample counts until the next one, at most ``cap_ms``."""
    x = _runs(located, boundaries).withColumn("ms", F.greatest(F.lit(0), F.least(F.coalesce(F.col("_next") - F.col("t_ms"), F.lit(cap_ms)), F.lit(cap_ms))))
    posture = [c for c in ("armed", "quad", "pent") if c in located.columns]
    return x.groupBy("match_id", "loc", "player").agg(F.sum("ms").alias("ms"), *[F.sum(F.when(F.col(c), F.col("ms")).otherwise(0)).alias(f"{c}_ms") for c in posture])


def graph_edges(located: DataFrame, boundaries: DataFrame, jump: float = 125.0) -> DataFrame:
    """Transitions between locations by player; an edge's kind is that of its first transition in the match
    (by time, player and sequence): teleport if x or y moved by more than ``jump`` between the two samples."""
    x = _runs(located, boundaries).filter(F.col("_joined") & (F.col("loc") != F.col("_loc")))
    far = F.greatest(F.abs(F.col("x") - F.col("_x")), F.abs(F.col("y") - F.col("_y"))) > jump
    x = x.select("match_id", F.col("_loc").alias("from_loc"), F.col("loc").alias("to_loc"), "player", "t_ms", "seq", F.when(far, "teleport").otherwise("normal").alias("k"))
    edge = ["match_id", "from_loc", "to_loc"]
    first = F.struct("t_ms", "player", "seq")
    by = x.groupBy(*edge, "player").agg(F.count("*").alias("n"), F.min(first).alias("_at"), F.min_by("k", first).alias("_k"))
    kind = F.first("_k").over(Window.partitionBy(*edge).orderBy("_at"))
    return by.select(*edge, "player", "n", kind.alias("kind"))
