"""Filters of responses: players, chat, pickups, items, sane stats, and location names for their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenalake.operators.points import in_window

# Classes of item kinds.
CATEGORY = {
    "ga": "armor", "ya": "armor", "ra": "armor", "mh": "mega", "h15": "health", "h25": "health", "quad": "powerup", "pent": "powerup", "ring": "powerup", "suit": "powerup",
    "rl": "weapon", "lg": "weapon", "gl": "weapon", "ssg": "weapon", "sng": "weapon", "ng": "weapon", "shells": "ammo", "nails": "ammo", "rockets": "ammo", "cells": "ammo",
}
CHAT = ("chat", "teamsay")


def players(rows: DataFrame, names: list[str] = (), columns: tuple[str, ...] = ("player",)) -> DataFrame:
    """Rows in which one of the columns holds one of the names, case and all; no names mean everybody."""
    if not names:
        return rows
    fits = F.lit(False)
    for c in columns:
        fits = fits | F.coalesce(F.col(c).isin(*names), F.lit(False))
    return rows.filter(fits)


def chat(messages: DataFrame, types: list[str] = (), names: list[str] = (), start_ms: int = 0, end_ms: int = 0) -> DataFrame:
    """Messages of the types (all chat by default) and players in a window whose ends are inclusive and open at 0."""
    return players(messages, names).filter(F.col("type").isin(*(types or CHAT)) & in_window(F.col("t_ms"), start_ms, end_ms))


def distinct_chat(messages: DataFrame) -> DataFrame:
    """Messages once each: the same line at another time is another message."""
    return messages.dropDuplicates(["match_id", "t_ms", "type", "player", "message"])


def pickups(rows: DataFrame, names: list[str] = (), weapon: str | None = None, source: str | None = None) -> DataFrame:
    """Weapon pickups or backpack drops of the players, weapon and source."""
    out = players(rows, names)
    for column, value in (("weapon", weapon), ("source", source)):
        out = out.filter(F.col(column) == value) if value else out
    return out


def category(kind: Column) -> Column:
    """The class of an item kind, empty for kinds without one."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in CATEGORY.items() for x in p]), kind), F.lit(""))


def items(phases: DataFrame, names: list[str] = (), kinds: list[str] = (), takers: list[str] = ()) -> DataFrame:
    """Item phases (name, kind, taken_by) by item name or kind, by category or kind (both in any case), and by taker.

    Phases that nobody took stay; an item of which no phase is left has no rows.
    """
    low = lambda values: [v.lower() for v in values]
    out = phases
    if names:
        out = out.filter(F.lower("name").isin(*low(names)) | F.lower("kind").isin(*low(names)))
    if kinds:
        out = out.filter(category(F.col("kind")).isin(*low(kinds)) | F.lower("kind").isin(*low(kinds)))
    return out.filter(F.coalesce("taken_by", F.lit("")).isin("", *takers)) if takers else out


def sane_stats(stats: DataFrame) -> DataFrame:
    """Stats (field, v) without values that are signals of the server: health above 250, armor above 200."""
    return stats.filter(~((F.col("field") == "h") & (F.col("v") > 250)) & ~((F.col("field") == "a") & (F.col("v") > 200)))


def loc_names(rows: DataFrame, table: DataFrame, drop_blank: bool = False) -> DataFrame:
    """``rows`` (match_id, li) with loc, from the match's table (match_id, li, name); '' for 0 and unknown numbers."""
    out = rows.join(table.select("match_id", "li", F.col("name").alias("loc")), ["match_id", "li"], "left").withColumn("loc", F.coalesce("loc", F.lit("")))
    return out.filter("loc <> ''") if drop_blank else out
