"""Point, slice and trail queries: StateAt, StreamSlice, Events, location trails."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from arenalake.functions.temporal import KEYS, asof, changed, clamp, merge_short

DEFAULT_EVENTS = ["frag", "powerup", "streak", "spawn", "death", "weapon", "item", "chat"]


def state_at(probes: DataFrame, numbers: dict[str, DataFrame], intervals: dict[str, DataFrame], positions: DataFrame | None = None) -> DataFrame:
    """State at each probe (match_id, player, t_ms): latest values, held items, and the position nearest in time (the earlier
    one on a tie, by time and then by sequence).  All streams and the probes are merged in one sorted stream a player."""
    rows = probes.select(*KEYS, "t_ms", F.lit(None).cast("long").alias("seq"), F.lit(1).alias("_probe"), F.struct(*probes.columns).alias("_row"))

    def merge(stream: DataFrame, time: str, value: Column, name: str) -> None:
        nonlocal rows
        seq = F.col("seq").cast("long") if "seq" in stream.columns else F.lit(0).cast("long")
        rows = rows.unionByName(stream.select(*KEYS, F.col(time).alias("t_ms"), seq.alias("seq"), F.lit(0).alias("_probe"), value.alias(name)), allowMissingColumns=True)

    for field, stream in numbers.items():
        merge(stream, "t_ms", F.col("v"), f"_{field}")
    for field, spans in intervals.items():
        merge(spans, "start_ms", F.col("end_ms"), f"_{field}")
    if positions is not None:
        merge(positions, "t_ms", F.struct(F.col("t_ms").alias("at"), "x", "y", "z"), "_place")
    track = Window.partitionBy(*KEYS).orderBy("t_ms", "_probe", "seq")
    past = track.rowsBetween(Window.unboundedPreceding, 0)
    if positions is not None:  # of several positions of one time the first by sequence counts
        last = F.max(F.when(F.col("_place").isNotNull(), F.col("t_ms"))).over(track.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_place", F.when(last.isNull() | (last < F.col("t_ms")), F.col("_place")))
    seen = {field: F.last(f"_{field}", ignorenulls=True).over(past) for field in numbers}
    seen |= {field: F.coalesce(F.max(f"_{field}").over(past) > F.col("t_ms"), F.lit(False)) for field in intervals}
    if positions is None:
        return rows.withColumns(seen).filter("_probe = 1").select("_row.*", *numbers, *intervals)
    seen |= {"_before": F.last("_place", ignorenulls=True).over(past), "_after": F.first("_place", ignorenulls=True).over(track.rowsBetween(0, Window.unboundedFollowing))}
    older = F.col("_after").isNull() | (F.col("t_ms") - F.col("_before.at") <= F.col("_after.at") - F.col("t_ms"))
    near = F.when(F.col("_before").isNotNull() & older, F.col("_before")).otherwise(F.col("_after"))
    found = rows.withColumns(seen).filter("_probe = 1").withColumn("_near", near)
    return found.select("_row.*", *numbers, *intervals, "_near.x", "_near.y", "_near.z")


def slice_changes(stream: DataFrame, players: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Changes in [start, end) after a carry row at start; a change at start that equals the carry is the same row."""
    inside = stream.filter((F.col("t_ms") >= start_ms) & (F.col("t_ms") < end_ms)).select(*KEYS, "t_ms", F.col("seq"), "v")
    probes = players.select(*KEYS).distinct().withColumn("t_ms", F.lit(start_ms))
    carry = asof(probes, stream, ["v"], inclusive=False).filter("v is not null").select(*KEYS, "t_ms", F.lit(-1).cast("long").alias("seq"), "v")
    return changed(carry.unionByName(inside), "v").select(*KEYS, "t_ms", "v")


def slice_intervals(spans: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    return clamp(spans, start_ms, end_ms)


def in_window(t: Column, start_ms: int, end_ms: int) -> Column:
    """Both ends inclusive; 0 leaves an end open."""
    return (F.lit(start_ms == 0) | (t >= start_ms)) & (F.lit(end_ms == 0) | (t <= end_ms))


def deltas(stream: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Values in the window with the difference to the one before *in the window* (0 before the first);
    the stream's very first row has none."""
    w = Window.partitionBy(*KEYS).orderBy("t_ms", "seq")
    inside = stream.withColumn("_i", F.row_number().over(w)).filter(in_window(F.col("t_ms"), start_ms, end_ms))
    return inside.withColumn("delta", F.when(F.col("_i") > 1, F.col("v") - F.lag("v", 1, 0).over(w))).drop("_i")


def events(parts: dict[str, DataFrame], types: list[str] | None = None, start_ms: int = 0, end_ms: int = 0) -> DataFrame:
    """One timeline of (match_id, t_ms, type, player, detail) from parts with those columns; default types are the discrete ones.

    ``pos`` is a row's place in its match: by time, then type, then player and detail.
    """
    unknown = set(types or ()) - set(parts)
    if unknown or not parts:
        raise ValueError(f"no such event types: {', '.join(sorted(unknown))}")
    rows = None
    for kind in parts:
        if kind in (types or DEFAULT_EVENTS):
            one = parts[kind].select("match_id", "t_ms", F.lit(kind).alias("type"), "player", F.col("detail").cast("string").alias("detail"))
            rows = one if rows is None else rows.unionByName(one)
    inside = rows.filter(in_window(F.col("t_ms"), start_ms, end_ms))
    return inside.withColumn("pos", F.row_number().over(Window.partitionBy("match_id").orderBy("t_ms", "type", "player", "detail")))


def slice_loc_names(stream: DataFrame, table: DataFrame, players: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """``slice_changes`` of location numbers as names: only at the start a row equal to the carried name is left out.

    ``table``: (match_id, li, name); unknown numbers are ''.
    """
    named = stream.join(table.select("match_id", F.col("li").alias("v"), "name"), ["match_id", "v"], "left").select(*KEYS, "t_ms", "seq", F.coalesce("name", F.lit("")).alias("v"))
    asked = named.join(players.select(*KEYS, F.lit(True).alias("_asked")).distinct(), KEYS, "left").filter(F.col("t_ms") < F.greatest(F.lit(end_ms), F.lit(start_ms + 1)))
    at, inside = F.struct("t_ms", "seq"), (F.col("t_ms") >= start_ms) & (F.col("t_ms") < end_ms)
    own = Window.partitionBy(*KEYS)
    last = F.when(F.col("_asked"), F.max(F.when(F.col("t_ms") <= start_ms, F.struct("t_ms", "seq", "v"))).over(own))
    rows = asked.withColumns({"_carry": last, "_in": inside, "_first": F.min(F.when(inside, at)).over(own) == at})
    carries = F.coalesce((F.col("_carry.t_ms") == F.col("t_ms")) & (F.col("_carry.seq") == F.col("seq")), F.lit(False))
    told = F.coalesce(F.col("_first") & (F.col("t_ms") == start_ms) & (F.col("v") == F.col("_carry.v")), F.lit(False))
    # a row may be what is carried to the start, a row of the slice, or both
    times = F.filter(F.array(F.when(carries, F.lit(start_ms)), F.when(F.col("_in") & ~told, F.col("t_ms"))), lambda t: t.isNotNull())
    return rows.select(*KEYS, F.explode(times).alias("t_ms"), "v")


def powerup_rows(runs: DataFrame, players: DataFrame, teams: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Powerup runs (item, start_ms, end_ms) cut to the window, with side: teamA, teamB or other."""
    cut = clamp(runs, start_ms, end_ms).filter("end_ms > start_ms").join(players.select(*KEYS, "team"), KEYS, "left").join(teams, "match_id")
    side = F.when(F.col("team") == F.col("team_a"), "teamA").when(F.col("team") == F.col("team_b"), "teamB").otherwise("other")
    return cut.select(*KEYS, "item", "start_ms", "end_ms", side.alias("side"))


def movement_trail(samples: DataFrame, least: float, most: float) -> DataFrame:
    """Samples (t_ms, seq, x, y, death, spawn) worth drawing, with ``teleport``.

    Deaths and spawns stay; others only if they moved by more than ``least`` in x or y since the last one that stayed.  A
    sample is a teleport if it moved by more than ``most`` since the sample before.  The origin is no position.  One
    player's samples of a match are gone through together; they come to a few ten thousand.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_ms", "seq"])
        kept, jumps, last, before = [], [], None, None
        for row in pdf.itertuples():
            here = (row.x, row.y)
            marked = bool(row.death) or bool(row.spawn)
            moved = lambda since, by: max(abs(here[0] - since[0]), abs(here[1] - since[1])) > by
            if marked or last is None or moved(last, least):
                kept.append(row.Index)
                jumps.append(not marked and before is not None and moved(before, most))
                last = here
            before = here
        return pdf.loc[kept].assign(teleport=jumps)

    rows = samples.filter("x <> 0 or y <> 0").select(*KEYS, "t_ms", "seq", "x", "y", "death", "spawn")
    return rows.groupBy(*KEYS).applyInPandas(walk, StructType([*rows.schema.fields, StructField("teleport", BooleanType())]))


def gains_and_losses(spans: DataFrame, item: str) -> DataFrame:
    """Two rows for each interval, for ``events``."""
    edge = F.explode(F.array(F.struct(F.col("start_ms").alias("t_ms"), F.lit(f"gain {item}").alias("detail")), F.struct(F.col("end_ms").alias("t_ms"), F.lit(f"lose {item}").alias("detail"))))
    return spans.select(*KEYS, edge.alias("e")).select(*KEYS, "e.t_ms", "e.detail")


def trails(located: DataFrame, start_ms: int, end_ms: int, min_dwell_ms: int = 0) -> DataFrame:
    """Stays (start_ms, end_ms, loc) from location changes (t_ms, seq, loc), cut to the window; blank locations are dropped."""
    w = Window.partitionBy(*KEYS).orderBy("t_ms", "seq")
    stays = changed(located, "loc").withColumn("end_ms", F.coalesce(F.lead("t_ms").over(w), F.lit(end_ms)))
    cut = clamp(stays.select(*KEYS, F.col("t_ms").alias("start_ms"), "end_ms", "loc"), start_ms, end_ms).filter("loc <> ''")
    return merge_short(cut, "loc", min_dwell_ms)


def lives(spawns: DataFrame, deaths: DataFrame, located: DataFrame) -> DataFrame:
    """(life, spawn_ms, death_ms, locs): the de-duplicated locations of each life, in order; an open life has no death."""
    w = Window.partitionBy(*KEYS).orderBy("t_ms", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = located.select(*KEYS, "t_ms", "seq", F.lit(1).alias("kind"), "loc")
    rows = rows.unionByName(spawns.select(*KEYS, "t_ms", "seq", F.lit(0).alias("kind")), allowMissingColumns=True)
    rows = rows.unionByName(deaths.select(*KEYS, "t_ms", "seq", F.lit(2).alias("kind")), allowMissingColumns=True)
    rows = rows.withColumn("life", F.count_if(F.col("kind") == 0).over(w)).filter("life > 0")
    by_life = Window.partitionBy(*KEYS, "life").orderBy("t_ms", "kind", "seq")
    dead = F.min(F.when(F.col("kind") == 2, F.col("t_ms"))).over(Window.partitionBy(*KEYS, "life"))
    rows = rows.withColumn("death_ms", dead).filter(F.col("death_ms").isNull() | (F.col("t_ms") <= F.col("death_ms")))
    before = F.last("loc", ignorenulls=True).over(by_life.rowsBetween(Window.unboundedPreceding, -1))
    step = rows.withColumn("moved", (F.col("kind") == 1) & (F.col("loc") != "") & ~F.col("loc").eqNullSafe(before))
    path = F.transform(F.array_sort(F.collect_list(F.when(F.col("moved"), F.struct("t_ms", "seq", "loc")))), lambda x: x["loc"])
    return step.groupBy(*KEYS, "life").agg(F.min(F.when(F.col("kind") == 0, F.col("t_ms"))).alias("spawn_ms"), F.first("death_ms").alias("death_ms"), path.alias("locs")).filter(F.col("death_ms").isNotNull() | (F.size("locs") > 0))
