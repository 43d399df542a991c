"""Scoreboards, overview and report tables, catalog search, response filters and data-quality checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalake.functions import text as X
from arenalake.functions.temporal import KEYS
from arenalake.operators.kills import GENERIC


def efficiency(kills: Column, deaths: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(kills * 100.0, kills + deaths), F.lit(0.0)), 1)


def player_table(board: DataFrame) -> DataFrame:
    """Rows (match_id, player, team, frags, kills, deaths, ...) with efficiency and rank by frags."""
    w = Window.partitionBy("match_id").orderBy(F.desc("frags"), "player")
    return board.withColumns({"efficiency": efficiency(F.col("kills"), F.col("deaths")), "rank": F.row_number().over(w)})


def team_table(board: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("frags", "kills", "deaths", "suicides", "team_kills")]
    return board.groupBy("match_id", "team").agg(*sums).withColumn("efficiency", efficiency(F.col("kills"), F.col("deaths")))


def unfold(board: DataFrame, weapons: str = "weapons") -> DataFrame:
    """(match_id, player, team, weapon, hits, attacks, kills) from a map of structs."""
    rows = board.select(*KEYS, "team", F.explode(weapons).alias("weapon", "w"))
    return rows.select(*KEYS, "team", "weapon", "w.hits", "w.attacks", "w.kills")


def accuracy(weapons: DataFrame, *by: str) -> DataFrame:
    """Hits per attack in per cent by weapon and ``by``."""
    out = weapons.groupBy("match_id", *by, "weapon").agg(*[F.sum(c).alias(c) for c in ("hits", "attacks", "kills")])
    return out.withColumn("accuracy", F.round(F.try_divide(F.col("hits") * 100.0, "attacks"), 1))


def fallback(kills: DataFrame, players: DataFrame) -> DataFrame:
    """A scoreboard from the kill log, ranked by frags: frags of the player table where known, otherwise kills - deaths.
    Words that stand for anybody (a teammate, somebody's quad) are no players."""
    named = kills.filter(~F.lower("player").rlike(GENERIC))
    own = named.join(players.select(*KEYS, "team", "frags"), KEYS, "left")
    own = own.withColumn("frags", F.coalesce("frags", F.col("kills") - F.col("deaths")))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("frags"), "player")))


def armor_split(totals: DataFrame) -> DataFrame:
    """Total armor (ta) shared out by the counts of green, yellow and red armors (ga, ya, ra)."""
    n = F.col("ga") + F.col("ya") + F.col("ra")
    return totals.withColumns({f"{c}_armor": F.coalesce(F.try_divide(F.col("ta") * F.col(c), n), F.lit(0.0)) for c in ("ga", "ya", "ra")})


def participants(players: DataFrame) -> DataFrame:
    """Players of real teams with frags: spectator teams, unprintable team names and zero frags are left out."""
    spectators = F.lower("team").isin("", "spec", "specs", "spectator", "spectators")
    return players.filter(~spectators & ~F.col("team").rlike(r"[^\x20-\x7e]") & (F.col("frags") != 0))


def tokens(text: Column) -> Column:
    """Words of a name, in order: lower case, cut at everything but letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def token_index(catalog: DataFrame) -> DataFrame:
    """(token, id): the words of all players' names by match.  Write it sorted by token, and a search reads only its words' pages."""
    words = F.array_distinct(F.flatten(F.transform("players", lambda p: tokens(p))))
    return catalog.select("id", F.explode(words).alias("token")).select("token", "id")


def with_tokens(index: DataFrame, wanted: list[str]) -> DataFrame:
    """(id) of the matches that hold every wanted word: equality on tokens, then a count."""
    return index.filter(F.col("token").isin(wanted)).groupBy("id").agg(F.count_distinct("token").alias("_n")).filter(F.col("_n") == len(wanted)).select("id")


def search(catalog: DataFrame, players: list[str] = (), teams: list[str] = (), map_name: str | None = None, mode: str | None = None, tag: str | None = None, since: str | None = None, until: str | None = None, limit: int = 20, offset: int = 0, index: DataFrame | None = None) -> DataFrame:
    """Matches of a catalog (id, day, map, mode, matchtag, players and teams as arrays) that fit all conditions, the latest
    first; at most 100 a page.

    Players are searched by full text: for every wanted name some player's name must have its words, one after the other.
    Matches that hold all the words come from ``index`` (a written ``token_index``; without one it is made on the way).  Teams are whole names, all of which played; the tag matches
    anywhere, in any case; days are inclusive.  Blank players and teams ask for nothing.
    """
    out = catalog
    names = [[w for w in re.split(r"[\W_]+", p.lower()) if w] for p in players]
    if any(names):
        words = sorted({w for name in names for w in name})
        out = out.join(with_tokens(token_index(catalog) if index is None else index, words), "id", "left_semi")
    for name in names:
        if len(name) > 1:
            phrase = F.lit(" ".join(["", *name, ""]))
            out = out.filter(F.exists("players", lambda p: F.contains(F.concat(F.lit(" "), F.array_join(tokens(p), " "), F.lit(" ")), phrase)))  # noqa: B023
    for team in (t.strip() for t in teams):
        if team:
            out = out.filter(F.array_contains("teams", team))
    for column, value in (("map", map_name), ("mode", mode)):
        if value:
            out = out.filter(F.col(column) == value)
    if tag:
        out = out.filter(F.col("matchtag").ilike("%" + re.sub(r"([%_\\])", r"\\\1", tag) + "%"))
    if since:
        out = out.filter(F.col("day") >= F.lit(since).cast("date"))
    if until:
        out = out.filter(F.col("day") <= F.lit(until).cast("date"))
    return out.orderBy(F.desc("day"), "id").offset(max(offset, 0)).limit(min(limit if limit > 0 else 20, 100))


def overview(matches: DataFrame, players: DataFrame, streaks: DataFrame, powerups: DataFrame, top: int = 5, locs: DataFrame | None = None, regions: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """One row a match: duration, players and teams by frags, and the best streaks and powerup runs, as arrays.

    With ``locs`` (match_id, li) the number of locations that were visited, with ``regions`` (match_id) whether regions are
    controlled, and with ``errors`` (match_id, reason) what went wrong, each once.
    """
    ranked = lambda rows, order, cols, name: rows.withColumn("_r", F.row_number().over(Window.partitionBy("match_id").orderBy(*order))).filter(F.col("_r") <= top).groupBy("match_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", *cols))), lambda x: F.concat_ws(":", *[x[c].cast("string") for c in cols])).alias(name)
    )
    out = matches.select("match_id", (F.col("match_end_ms") - F.col("match_start_ms")).alias("duration_ms"))
    teams = players.groupBy("match_id", "team").agg(F.sum("frags").alias("frags"))
    for rows, order, cols, name in ((players, [F.desc("frags"), "player"], ["player", "frags"], "players"), (teams, [F.desc("frags"), "team"], ["team", "frags"], "teams"), (streaks, [F.desc("frags"), "duration_ms", "player"], ["player", "frags"], "streaks"), (powerups, [F.desc("frags"), "start_ms", "player"], ["player", "frags"], "powerups")):
        out = out.join(ranked(rows, order, cols, name), "match_id", "left")
    if locs is not None:
        out = out.join(locs.groupBy("match_id").agg(F.count_distinct("li").alias("loc_count")), "match_id", "left").na.fill(0, ["loc_count"])
    if regions is not None:
        out = out.join(regions.select("match_id", F.lit(True).alias("has_region_control")).distinct(), "match_id", "left").na.fill(False, ["has_region_control"])
    if errors is not None:
        told = errors.groupBy("match_id").agg(F.array_sort(F.collect_set("reason")).alias("errors"))
        out = out.join(told, "match_id", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
    return out


def report(view: DataFrame) -> DataFrame:
    """A line of text for each match of an overview."""
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    return view.select("match_id", F.concat(F.lit("# Match "), F.col("match_id").cast("string"), F.lit(" - teams "), joined("teams"), F.lit("; players "), joined("players"), F.lit("; streaks "), joined("streaks"), F.lit("; powerups "), joined("powerups")).alias("line"))


def markdown(matches: DataFrame, players: DataFrame, streaks: DataFrame, powerups: DataFrame, settings: DataFrame | None = None, top: int = 5) -> DataFrame:
    """(match_id, text): a report of each match in Markdown: what is known of it, its players and teams by frags, and the
    best streaks and powerup runs.  Sections without rows are left out, and so is a single team.

    ``players``: match_id, player, team, frags, kills, deaths.  ``streaks`` (player, frags, duration_ms, weapon) and
    ``powerups`` (player, powerup, frags, duration_ms) get their teams from ``players``.  ``settings``: match_id, mode,
    timelimit and matchtag, each of which may be null.
    """
    side = players.select(*KEYS, F.coalesce("team", F.lit("")).alias("_team"))
    seconds = X.seconds(F.col("duration_ms"))

    def section(rows: DataFrame, order: list, head: str, names: str, rule: str, line: Column, name: str, least: int = 1) -> DataFrame:
        ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("match_id").orderBy(*order))).withColumn("_line", line)
        ranked = ranked.filter(F.col("_r") <= top) if name in ("streaks", "powerups") else ranked
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_line"))), lambda x: x["_line"]), "\n")
        text = F.concat(F.lit(f"\n## {head}\n\n{names}\n{rule}\n"), lines, F.lit("\n"))
        return ranked.groupBy("match_id").agg(F.when(F.count("*") >= least, text).alias(name))

    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *[x.cast("string") for x in c]), F.lit(" |"))
    col = F.col
    teams = players.filter("team <> ''").groupBy("match_id", "team").agg(F.sum("frags").alias("frags"))
    s, p = streaks.join(side, KEYS, "left"), powerups.join(side, KEYS, "left")
    parts = [
        section(players, [F.desc("frags"), "player"], "Players", "| Name | Team | Frags | Kills | Deaths |", "|---|---|---:|---:|---:|", cells(col("player"), F.coalesce("team", F.lit("")), col("frags"), col("kills"), col("deaths")), "players"),
        section(teams, [F.desc("frags"), "team"], "Teams", "| Team | Frags |", "|---|---:|", cells(col("team"), col("frags")), "teams", 2),
        section(s, [F.desc("frags"), "duration_ms", "start_ms", "player"], "Top frag streaks", "| Player | Team | Frags | Duration | Weapon |", "|---|---|---:|---:|---|", cells(col("player"), F.coalesce("_team", F.lit("")), col("frags"), seconds, col("weapon")), "streaks"),
        section(p, [F.desc("frags"), "start_ms", "player"], "Top powerup runs", "| Player | Team | Powerup | Duration | Frags |", "|---|---|---|---:|---:|", cells(col("player"), F.coalesce("_team", F.lit("")), col("powerup"), seconds, col("frags")), "powerups"),
    ]
    out = matches.select("match_id", "map", (F.col("match_end_ms") - F.col("match_start_ms")).alias("duration_ms"))
    out = out.join(settings, "match_id", "left") if settings is not None else out.withColumns({c: F.lit(None).cast("string") for c in ("mode", "timelimit", "matchtag")})
    for part in parts:
        out = out.join(part, "match_id", "left")
    known = lambda label, c, text: F.when(c, F.concat(F.lit(f"- {label}: "), text, F.lit("\n"))).otherwise("")
    head = F.concat(
        F.lit("# "), F.col("match_id").cast("string"), F.lit("\n\n- duration: "), seconds, F.lit("\n- map: "), F.col("map"), F.lit("\n"),
        known("mode", F.coalesce(F.col("mode") != "", F.lit(False)), F.col("mode")), known("timelimit", F.coalesce(F.col("timelimit").cast("int") > 0, F.lit(False)), F.concat(F.col("timelimit").cast("string"), F.lit(" min"))),
        known("matchtag", F.coalesce(F.col("matchtag") != "", F.lit(False)), F.col("matchtag")),
    )
    return out.select("match_id", F.concat(head, *[F.coalesce(c, F.lit("")) for c in ("players", "teams", "streaks", "powerups")]).alias("text"))


def quality(frag_sums: DataFrame, official: DataFrame, stats: DataFrame, players: DataFrame, pickups: DataFrame | None = None) -> DataFrame:
    """(check, match_id, subject): frag sums off by more than 2, health or armor out of range, names used twice, and items
    that were taken by nobody (``pickups``: match_id, kind, player), once a kind."""
    both = frag_sums.join(official.withColumnRenamed("frags", "board"), KEYS, "full_outer").na.fill(0, ["frags", "board"])
    off = both.filter(F.abs(F.col("frags") - F.col("board")) > 2).select(F.lit("frags").alias("check"), "match_id", F.col("player").alias("subject"))
    bad = stats.filter(((F.col("field") == "h") & (F.col("v") > 250)) | ((F.col("field") == "a") & (F.col("v") > 200))).select(F.lit("range").alias("check"), "match_id", F.col("player").alias("subject")).distinct()
    twice = players.groupBy("match_id", "player").count().filter("count > 1").select(F.lit("name").alias("check"), "match_id", F.col("player").alias("subject"))
    out = off.unionByName(bad).unionByName(twice)
    if pickups is None:
        return out
    lost = pickups.filter("player is null").select(F.lit("pickup").alias("check"), "match_id", F.col("kind").alias("subject")).distinct()
    return out.unionByName(lost)


def coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    """(match_id, player, in_left, in_right) of players that only one side has."""
    both = left.select(*KEYS, F.lit(True).alias("in_left")).join(right.select(*KEYS, F.lit(True).alias("in_right")), KEYS, "full_outer").na.fill(False)
    return both.filter("not (in_left and in_right)")


def damage_table(damage: DataFrame, types: DataFrame) -> DataFrame:
    """Damage by attacker, victim and weapon; ``types`` maps death types to weapons."""
    return damage.join(types, "death_type", "left").groupBy("match_id", "attacker", "victim", F.coalesce("weapon", F.lit("unknown")).alias("weapon")).agg(F.sum("amount").alias("damage"), F.count_if("splash").alias("splashes"))


def last_state(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last value of each key, by sequence."""
    return events.groupBy(*keys).agg(F.max_by(value, "seq").alias(value))


def rollup(board: DataFrame, dims: list[str]) -> DataFrame:
    """Matches, players and frags over all matches by each prefix of ``dims``."""
    return board.rollup(*dims).agg(F.count_distinct("match_id").alias("matches"), F.count_distinct("player").alias("players"), F.sum("frags").alias("frags"))
