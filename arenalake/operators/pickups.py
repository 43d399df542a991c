"""Items, drops and pickups: phases, attribution, backpacks, weapon pickups and their effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arenalake.functions.temporal import KEYS, asof
from arenalake.operators.spatial import locate

ENT = ["match_id", "ent"]
# Seconds until a kind is there again, and item bits of weapons, powerups and armor.
RESPAWN = {"h15": 20, "h25": 20, "ga": 20, "ya": 20, "ra": 20, "ssg": 30, "ng": 30, "sng": 30, "gl": 30, "rl": 30, "lg": 30, "shells": 30, "nails": 30, "rockets": 30, "cells": 30, "quad": 60, "pent": 300, "ring": 300, "suit": 60}
BITS = {"ssg": 2, "ng": 4, "sng": 8, "gl": 16, "rl": 32, "lg": 64, "ga": 8192, "ya": 16384, "ra": 32768, "r": 524288, "pe": 1048576, "q": 4194304}


def from_bits(stats: DataFrame) -> DataFrame:
    """Item bit fields as boolean columns; armor is the best kind held."""
    on = lambda k: F.col("bits").bitwiseAND(BITS[k]) != 0
    armor = F.when(on("ra"), "ra").when(on("ya"), "ya").when(on("ga"), "ga").otherwise("")
    return stats.withColumns({k: on(k) for k in ("ssg", "ng", "sng", "gl", "rl", "lg", "q", "pe", "r")}).withColumn("at", armor)


def match_drops(drops: DataFrame, pickups: DataFrame) -> DataFrame:
    """``pickups`` (match_id, ent, t_ms, seq) with drop_ms and dropper of the entity's latest drop, unless an earlier pickup
    took that drop."""
    d = drops.select(*ENT, "t_ms", "seq", F.col("t_ms").alias("drop_ms"), F.col("seq").alias("drop_seq"), F.col("player").alias("dropper"))
    got = asof(pickups, d, ["drop_ms", "drop_seq", "dropper"], ENT)
    first = F.row_number().over(Window.partitionBy(*ENT, "drop_seq").orderBy("t_ms", "seq")) == 1
    fresh = first & F.col("drop_seq").isNotNull()
    return got.withColumn("_f", fresh).select(*pickups.columns, F.when(F.col("_f"), F.col("drop_ms")).alias("drop_ms"), F.when(F.col("_f"), F.col("dropper")).alias("dropper"))


def drops_with_pickups(drops: DataFrame, matched: DataFrame) -> DataFrame:
    """Every drop with who picked it up and when, if anyone did."""
    got = matched.filter("drop_ms is not null").select(*ENT, F.col("drop_ms").alias("t_ms"), F.col("player").alias("taker"), F.col("t_ms").alias("taken_ms"))
    return drops.join(got, [*ENT, "t_ms"], "left")


def outcome(drops: DataFrame, teams: DataFrame) -> DataFrame:
    """Drops with a label: expired, xfer (to a team mate) or enemy, with ' had' where the taker already had the weapon."""
    t = teams.select("match_id", F.col("player").alias("taker"), F.col("team").alias("taker_team"))
    both = drops.join(teams, KEYS, "left").join(t, ["match_id", "taker"], "left")
    label = F.when(F.col("taker").isNull(), "expired").otherwise(F.concat(F.when(F.col("team") == F.col("taker_team"), "xfer").otherwise("enemy"), F.when(F.col("had_before"), " had").otherwise("")))
    return both.withColumn("outcome", label)


def next_death(rows: DataFrame, deaths: DataFrame) -> DataFrame:
    """``rows`` with next_death_ms, strictly after t_ms."""
    stamped = deaths.withColumn("next_death_ms", F.col("t_ms"))
    return asof(rows, stamped, ["next_death_ms"], inclusive=False, forward=True)


def effect(pickups: DataFrame, frags: DataFrame) -> DataFrame:
    """``pickups`` (pickup_id, player, weapon, t_ms, next_death_ms) with kills: frags by that weapon before the next death,
    each counted for the pickup that started last."""
    own = frags.filter("not is_suicide and not is_team_kill").select("match_id", F.col("killer").alias("player"), "weapon", F.col("t_ms").alias("frag_ms"), F.col("seq").alias("frag_seq"))
    cover = pickups.join(own, [*KEYS, "weapon"]).filter((F.col("t_ms") < F.col("frag_ms")) & (F.col("next_death_ms").isNull() | (F.col("frag_ms") <= F.col("next_death_ms"))))
    best = cover.groupBy("match_id", "frag_seq").agg(F.max_by("pickup_id", F.struct("t_ms", "pickup_id")).alias("pickup_id"))
    counts = best.groupBy("match_id", "pickup_id").agg(F.count("*").alias("kills"))
    return pickups.join(counts, ["match_id", "pickup_id"], "left").na.fill(0, ["kills"])


def had_before(pickups: DataFrame, bits: DataFrame) -> DataFrame:
    """``pickups`` (weapon) with had_before from the item bits known strictly before."""
    known = asof(pickups, bits, ["bits"], inclusive=False)
    mask = F.element_at(F.create_map(*[F.lit(x) for p in BITS.items() for x in p]), F.col("weapon"))
    return known.withColumn("had_before", F.coalesce(F.col("bits").bitwiseAND(mask) != 0, F.lit(False))).drop("bits")


def backpacks(hints: DataFrame, positions: DataFrame, locs: DataFrame | None = None) -> DataFrame:
    """Drops with a weapon (exactly one of rocket launcher and lightning gun in the flags) and the dropper's last position,
    with the number of the nearest point where points are given (null where no position is known)."""
    rl, lg = (F.col("flags").bitwiseAND(BITS[w]) != 0 for w in ("rl", "lg"))
    one = hints.filter(rl != lg).withColumn("weapon", F.when(rl, "rl").otherwise("lg"))
    if locs is None:
        return asof(one, positions, ["x", "y", "z"])
    placed = asof(one, positions, ["map", "x", "y", "z"])
    found = locate(placed.select("map", "x", "y", "z").filter("x is not null").distinct(), locs)
    return placed.join(found, ["map", "x", "y", "z"], "left")


def phases(states: DataFrame, holds: DataFrame | None = None) -> DataFrame:
    """(match_id, ent, phase_no, available_from, taken_at, respawn_at) from item states (kind, t_ms, seq, taken).

    A phase opens at the start and whenever the item is back, and closes when it is taken; repeated states change nothing.
    Kinds without a respawn time, as the large health box, have what ``holds`` (match_id, ent, taken_at, respawn_at) says.
    """
    w = Window.partitionBy(*ENT).orderBy("t_ms", "seq")
    was = F.coalesce(F.lag("taken").over(w), F.lit(False))
    edges = states.withColumn("_was", was).filter(F.col("taken") != F.col("_was"))
    edges = edges.withColumn("phase_no", F.count_if(~F.col("taken")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seconds = F.element_at(F.create_map(*[F.lit(x) for p in RESPAWN.items() for x in p]), F.col("kind"))
    out = edges.groupBy(*ENT, "kind", "phase_no").agg(F.min(F.when(~F.col("taken"), F.col("t_ms"))).alias("available_from"), F.min(F.when(F.col("taken"), F.col("t_ms"))).alias("taken_at"))
    out = out.withColumns({"available_from": F.coalesce("available_from", F.lit(0)), "respawn_at": F.col("taken_at") + seconds * 1000})
    if holds is None:
        return out
    own = holds.groupBy(*ENT, "taken_at").agg(F.min("respawn_at").alias("_held"))
    return out.join(own, [*ENT, "taken_at"], "left").withColumn("respawn_at", F.coalesce("respawn_at", "_held")).select(out.columns)


def status(probes: DataFrame, found: DataFrame) -> DataFrame:
    """Item status at times: up, the seconds until it is back, or pending."""
    at = asof(probes, found.withColumn("t_ms", F.col("available_from")), ["taken_at", "respawn_at"], ENT)
    up = F.col("taken_at").isNull() | (F.col("taken_at") > F.col("t_ms"))
    return at.withColumn("status", F.when(up, "up").when(F.col("respawn_at") > F.col("t_ms"), F.ceil((F.col("respawn_at") - F.col("t_ms")) / 1000).cast("string")).otherwise("pending"))


def evidence(stats: DataFrame) -> DataFrame:
    """Pickup evidence from stat updates (t_ms, seq, life, stat, v) within a life: newly set item bits, health gains (up to
    25 one box, up to 50 two), ammunition gains.  The first value of a life is the baseline."""
    w = Window.partitionBy(*KEYS, "life", "stat").orderBy("t_ms", "seq")
    x = stats.withColumn("was", F.lag("v").over(w)).filter("was is not null")
    bits = F.filter(F.array(*[F.when(F.col("v").bitwiseAND(b) != 0, F.when(F.col("was").bitwiseAND(b) == 0, F.lit(k))) for k, b in BITS.items()]), lambda k: k.isNotNull())
    gain = F.col("v") - F.col("was")
    boxes = F.when((gain >= 1) & (gain <= 25), F.array(F.lit("health"))).when((gain >= 26) & (gain <= 50), F.array(F.lit("health"), F.lit("health")))
    kinds = F.when(F.col("stat") == "items", bits).when(F.col("stat") == "health", boxes).when(gain > 0, F.array(F.col("stat")))
    return x.select(*KEYS, "t_ms", "seq", F.explode(kinds).alias("kind"))


def long_hold(pickups: DataFrame, health: DataFrame, deaths: DataFrame) -> DataFrame:
    """Respawn of the large health box: 20 s after the holder's health falls from above 100 to at most 100 or the holder dies,
    but no earlier than 25 s after the pickup.  Health above 250 is a signal of the server, not health."""
    w = Window.partitionBy(*KEYS).orderBy("t_ms", "seq")
    fallen = health.filter("v <= 250").withColumn("_was", F.lag("v").over(w)).filter("_was > 100 and v <= 100")
    low = fallen.select(*KEYS, "t_ms", "seq").unionByName(deaths.select(*KEYS, "t_ms", "seq")).withColumn("over_ms", F.col("t_ms"))
    after = asof(pickups, low, ["over_ms"], inclusive=False, forward=True)
    return after.withColumn("respawn_at", F.when(F.col("over_ms").isNotNull(), F.greatest(F.col("t_ms") + 5000, "over_ms") + 20_000))


def visibility(frames: DataFrame, seen: DataFrame) -> DataFrame:
    """taken / respawned edges of entities: presence in a frame against the frame before."""
    grid = frames.join(seen.select(*ENT).distinct(), "match_id")
    both = grid.join(seen.select(*ENT, "frame", F.lit(True).alias("there")), [*ENT, "frame"], "left").na.fill(False, ["there"])
    was = F.lag("there").over(Window.partitionBy(*ENT).orderBy("frame"))
    return both.withColumn("_was", was).filter("_was is not null and there <> _was").select(*ENT, "frame", F.when(F.col("there"), "respawned").otherwise("taken").alias("edge"))


def item_names(items: DataFrame) -> DataFrame:
    """kind, or kind_1, kind_2, ... by place and entity where a match has several of a kind."""
    by = Window.partitionBy("match_id", "kind")
    rank = F.row_number().over(by.orderBy("x", "y", "z", "ent"))
    return items.withColumn("name", F.when(F.count("*").over(by) > 1, F.concat_ws("_", "kind", rank)).otherwise(F.col("kind")))


def tally(pickups: DataFrame) -> DataFrame:
    return pickups.groupBy("match_id", "source").agg(F.count("*").alias("n"))


def verify(pickups: DataFrame, official: DataFrame, first_per_life: bool = True) -> DataFrame:
    """Pickups by player and weapon against the scoreboard's counts: first of a life (not had before), or every touch."""
    own = (pickups.filter(~F.col("had_before")) if first_per_life else pickups).groupBy(*KEYS, "weapon").agg(F.count("*").alias("found"))
    both = own.join(official, [*KEYS, "weapon"], "full_outer").na.fill(0, ["found", "official"])
    return both.withColumn("diff", F.col("found") - F.col("official"))
