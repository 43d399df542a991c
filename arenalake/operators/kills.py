"""Kill log aggregates, match bounds, streaks, powerup runs, frag deltas and score timelines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalake.functions.temporal import KEYS, asof, pair_runs

# Phrases that begin and end a match, in lower case.
START_PHRASES = ("match has begun", "match started", "fight!", "go!", "begins in 1", "game start")
END_PHRASES = ("match is over", "match ended", "match complete", "game over", "timelimit hit", "fraglimit hit")
# Words that stand for no player.
GENERIC = r"^(?:(?:his |her )?teammate|.*'s quad|.*'s quad rocket.*|.*'s quad shaft.*)$"


def match_bounds(messages: DataFrame, intermissions: DataFrame | None = None) -> DataFrame:
    """(match_id, start_ms, end_ms): the first start phrase, and the first end phrase or intermission after it, by (t_ms, seq)."""
    text = F.lower("message")
    has = lambda phrases: sum((text.contains(p).cast("int") for p in phrases), F.lit(0)) > 0
    rows = messages.select("match_id", "t_ms", "seq", has(START_PHRASES).alias("starts"), has(END_PHRASES).alias("ends"))
    if intermissions is not None:
        rows = rows.unionByName(intermissions.select("match_id", "t_ms", "seq", F.lit(False).alias("starts"), F.lit(True).alias("ends")))
    at = F.struct("t_ms", "seq")
    start = rows.filter("starts").groupBy("match_id").agg(F.min(at).alias("start"))
    later = rows.filter("ends").withColumn("at", at).join(start, "match_id").filter(F.col("at") > F.col("start"))
    end = later.groupBy("match_id").agg(F.min("at").alias("end"))
    return start.join(end, "match_id", "left").select("match_id", F.col("start.t_ms").alias("start_ms"), F.col("end.t_ms").alias("end_ms"))


def duration(bounds: DataFrame, last_event: DataFrame) -> DataFrame:
    """end - start, or last event - start, or the last event's time."""
    both = last_event.join(bounds, "match_id", "left")
    return both.select("match_id", F.coalesce(F.col("end_ms") - F.col("start_ms"), F.col("last_ms") - F.col("start_ms"), "last_ms").alias("duration_ms"))


def gate(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows between a match's start and end (an open end is no bound)."""
    b = bounds.select("match_id", "start_ms", "end_ms")
    return rows.join(b, "match_id").filter((F.col("t_ms") >= F.col("start_ms")) & (F.col("end_ms").isNull() | (F.col("t_ms") <= F.col("end_ms")))).drop("start_ms", "end_ms")


def named(frags: DataFrame) -> DataFrame:
    """Frags whose killer and victim are players, not generic words."""
    return frags.filter(~F.lower("killer").rlike(GENERIC) & ~F.lower("victim").rlike(GENERIC))


def kills(frags: DataFrame, deaths: DataFrame) -> DataFrame:
    """kills, suicides and team kills of each player, and deaths from death events (not from text)."""
    own = frags.groupBy("match_id", F.col("killer").alias("player")).agg(
        F.count_if(~F.col("is_suicide") & ~F.col("is_team_kill")).alias("kills"), F.count_if("is_suicide").alias("suicides"), F.count_if("is_team_kill").alias("team_kills")
    )
    dead = deaths.groupBy(*KEYS).agg(F.count("*").alias("deaths"))
    return own.join(dead, KEYS, "full_outer").na.fill(0, ["kills", "suicides", "team_kills", "deaths"])


def kills_by_weapon(frags: DataFrame) -> DataFrame:
    return frags.filter("not is_suicide and not is_team_kill").groupBy("match_id", F.col("killer").alias("player"), "weapon").agg(F.count("*").alias("kills"))


def filter_kills(frags: DataFrame, players: list[str] | None = None, weapon: str | None = None) -> DataFrame:
    """Frags of the players as killer or victim, and of the weapon; totals are taken before this filter."""
    out = frags.filter(F.col("killer").isin(players) | F.col("victim").isin(players)) if players else frags
    return out.filter(F.col("weapon") == weapon) if weapon else out


def weapon_histogram(frags: DataFrame) -> DataFrame:
    """Kills by weapon with their per cent of the match's most used weapon."""
    n = frags.groupBy("match_id", "weapon").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.max("n").over(Window.partitionBy("match_id")))


def deltas(frags: DataFrame) -> DataFrame:
    """(match_id, t_ms, seq, player, delta): +1 for a kill, -1 for a suicide or team kill."""
    return frags.select("match_id", "t_ms", "seq", F.col("killer").alias("player"), F.when(F.col("is_suicide") | F.col("is_team_kill"), -1).otherwise(1).alias("delta"))


def team_totals(d: DataFrame, players: DataFrame) -> DataFrame:
    return d.join(players, KEYS).groupBy("match_id", "team").agg(F.sum("delta").alias("frags"))


def guarded_deltas(updates: DataFrame, most: int = 5) -> DataFrame:
    """(match_id, slot, t_ms, delta) from cumulative frag updates (t_ms, seq, occupant, frags).

    A change of more than ``most`` is rejected and does not move the baseline; a new occupant resets it silently.  One
    slot's updates of one match, some hundreds, are gone through together.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        who, base, out = None, 0, []
        for row in pdf.sort_values(["t_ms", "seq"]).itertuples():
            change = row.frags - base
            fresh = row.occupant != who
            if not fresh and 0 < abs(change) <= most:
                out.append((row.match_id, row.slot, row.t_ms, change))
            if fresh or abs(change) <= most:
                base = row.frags
            who = row.occupant
        return pd.DataFrame(out, columns=["match_id", "slot", "t_ms", "delta"])

    types = dict(updates.dtypes)
    rows = updates.select("match_id", "slot", "t_ms", "seq", F.coalesce("occupant", F.lit("")).alias("occupant"), "frags")
    return rows.groupBy("match_id", "slot").applyInPandas(fold, f"match_id {types['match_id']}, slot {types['slot']}, t_ms {types['t_ms']}, delta {types['frags']}")


def lives(spawns: DataFrame, deaths: DataFrame, match_end: Column) -> DataFrame:
    return pair_runs(spawns, deaths, match_end)


def streaks(runs: DataFrame, frags: DataFrame, top: int = 10) -> DataFrame:
    """The lives with most frags of each match: frags, most used weapon (the first by name on a tie), duration, rank."""
    own = frags.filter("not is_suicide and not is_team_kill").select("match_id", F.col("killer").alias("player"), "t_ms", "weapon")
    inside = runs.join(own, KEYS).filter((F.col("t_ms") >= F.col("start_ms")) & (F.col("t_ms") <= F.col("end_ms")))
    by = inside.groupBy(*KEYS, "start_ms", "end_ms", "weapon").agg(F.count("*").alias("n"))
    best = by.groupBy(*KEYS, "start_ms", "end_ms").agg(F.sum("n").alias("frags"), F.min_by("weapon", F.struct(-F.col("n"), "weapon")).alias("weapon"))
    length = F.col("end_ms") - F.col("start_ms")
    w = Window.partitionBy("match_id").orderBy(F.desc("frags"), length, "start_ms", "player")
    return best.withColumns({"duration_ms": length, "rank": F.row_number().over(w)}).filter(F.col("rank") <= top)


def powerup_runs(spans: DataFrame, frags: DataFrame) -> DataFrame:
    """Each held interval with its duration and the holder's frags in it, both ends included."""
    own = frags.filter("not is_suicide and not is_team_kill").select("match_id", F.col("killer").alias("player"), "t_ms")
    inside = spans.join(own, KEYS).filter((F.col("t_ms") >= F.col("start_ms")) & (F.col("t_ms") <= F.col("end_ms")))
    counts = inside.groupBy(*KEYS, "start_ms").agg(F.count("*").alias("frags"))
    return spans.join(counts, [*KEYS, "start_ms"], "left").na.fill(0, ["frags"]).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def frag_bins(d: DataFrame, players: DataFrame, bin_ms: int = 10_000) -> DataFrame:
    """Sum of deltas by team in bins aligned to multiples of ``bin_ms``."""
    return d.join(players, KEYS).groupBy("match_id", "team", F.floor(F.col("t_ms") / bin_ms).cast("int").alias("bin")).agg(F.sum("delta").alias("delta"))


def running(d: DataFrame) -> DataFrame:
    """Cumulative frags of each player after each change."""
    return d.withColumn("frags", F.sum("delta").over(Window.partitionBy(*KEYS).orderBy("t_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)))


def frags_at(probes: DataFrame, d: DataFrame) -> DataFrame:
    return asof(probes, running(d), ["frags"]).na.fill(0, ["frags"])


def score_difference(grid: DataFrame, d: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    """Team A's frags minus team B's at the start of every bucket."""
    sides = d.join(players, KEYS).join(teams, "match_id")
    signed = sides.withColumn("delta", F.when(F.col("team") == F.col("team_a"), F.col("delta")).when(F.col("team") == F.col("team_b"), -F.col("delta")).otherwise(0))
    total = signed.select("match_id", "t_ms", "seq", F.sum("delta").over(Window.partitionBy("match_id").orderBy("t_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)).alias("diff"))
    return asof(grid.select("match_id", "bucket", F.col("b_start").alias("t_ms")), total, ["diff"], ["match_id"]).na.fill(0, ["diff"])


def duel(players: DataFrame) -> DataFrame:
    """(match_id, is_duel): exactly two participants."""
    return players.groupBy("match_id").agg((F.count_distinct("player") == 2).alias("is_duel"))


def duel_teams(rows: DataFrame, players: DataFrame) -> DataFrame:
    """In duels, each player is a team of their own."""
    return rows.join(duel(players), "match_id").withColumn("team", F.when(F.col("is_duel"), F.col("player")).otherwise(F.col("team"))).drop("is_duel")


def synthesize(d: DataFrame, frags: DataFrame) -> DataFrame:
    """Deltas with rows from the kill log for killers that have none of their own in the match."""
    missing = deltas(frags).join(d.select(*KEYS).distinct(), KEYS, "left_anti")
    return d.select("match_id", "t_ms", "seq", "player", "delta").unionByName(missing)
