"""Tables from official scoreboards: players, teams, weapons, items, and checks of found pickups against them.

A board is a row a player: match_id, player, team, ping, stats, dmg, weapons and items as in the server's JSON (``BOARD``).
What a board lacks counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalake.functions.temporal import KEYS
from arenalake.operators.scoreboard import efficiency

#: schema of a player's entry in a board, for ``files.join_blocks``
BOARD = (
    "player string, team string, ping int, xfer_rl int, xfer_lg int, stats struct<frags:int,kills:int,deaths:int,tk:int,suicides:int>, dmg struct<given:int,taken:int,enemy_weapons:int,taken_to_die:int>, "
    "weapons map<string,struct<hits:int,attacks:int,kills:int,enemy_kills:int,damage:int,taken:int,dropped:int,total_taken:int,spawn_taken:int,spawn_total_taken:int>>, items map<string,struct<took:int,time:int>>"
)
# Weapons of the accuracy table, those that packs hold, and items by their names on the board.
WEAPONS, PACKS = ("sg", "ssg", "sng", "gl", "rl", "lg"), ("rl", "lg")
ITEMS = {"ra": "ra", "ya": "ya", "ga": "ga", "mh": "health_100", "quad": "q", "pent": "p", "ring": "r"}
POWERUPS = ("quad", "pent", "ring")

PLAYER = ("frags", "kills", "deaths", "tk", "suicides", "rl_kills", "lg_kills", "given", "taken", "enemy_weapons")
MEANS = ("to_die", "ping")


def _zero(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(0))


def flat(board: DataFrame) -> DataFrame:
    """A column for each figure of a board's row."""
    stat = lambda c: _zero(F.col(f"stats.{c}"))
    dmg = lambda c: _zero(F.col(f"dmg.{c}"))
    weapon = lambda w, c: _zero(F.col("weapons")[w][c])
    item = lambda i, c: _zero(F.col("items")[ITEMS[i]][c])
    out = {c: stat(c) for c in ("frags", "kills", "deaths", "tk", "suicides")}
    out |= {f"{w}_kills": weapon(w, "enemy_kills") for w in PACKS} | {c: dmg(c) for c in ("given", "taken", "enemy_weapons")}
    out |= {"to_die": dmg("taken_to_die"), "ping": _zero("ping")}
    for w in WEAPONS:
        # a board gives all kills, or those of enemies alone
        kills = F.when(weapon(w, "kills") > 0, weapon(w, "kills")).otherwise(weapon(w, "enemy_kills"))
        out |= {f"w_{w}_hits": weapon(w, "hits"), f"w_{w}_attacks": weapon(w, "attacks"), f"w_{w}_kills": kills, f"w_{w}_damage": weapon(w, "damage")}
    out |= {f"i_{i}": item(i, "took") for i in ITEMS} | {f"i_{i}_s": item(i, "time") for i in POWERUPS}
    for w in PACKS:
        out |= {f"i_{w}_{c}": weapon(w, c) for c in ("taken", "dropped")} | {f"i_{w}_xfer": _zero(f"xfer_{w}")}
    return board.select(*KEYS, F.coalesce("team", F.lit("")).alias("team"), *[v.cast("long").alias(k) for k, v in out.items()])


def _summed(rows: DataFrame, columns: list[str], by_team: bool) -> DataFrame:
    """The columns by player, or summed by team; ``rank``: teams in the order of their first player by frags, and players by
    frags in that order."""
    best = F.struct(-F.col("frags"), "player")
    if by_team:
        out = rows.groupBy("match_id", "team").agg(F.min(best).alias("_best"), *[F.sum(c).alias(c) for c in columns])
        order = [F.col("_best")]
    else:
        out = rows.withColumn("_first", F.min(best).over(Window.partitionBy("match_id", "team"))).withColumn("_best", best)
        order = [F.col("_first"), F.col("_best")]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("match_id").orderBy(*order)))


def player_stats(board: DataFrame, by_team: bool = False) -> DataFrame:
    """Frags, efficiency, kills (all, and of enemies by rocket and lightning), deaths, damage given, taken and to enemies'
    weapons, damage taken a death, and ping: by player, or by team, where the last two are means."""
    rows = flat(board)
    out = _summed(rows, list(PLAYER), by_team)
    if by_team:
        means = rows.groupBy("match_id", "team").agg(*[F.round(F.avg(c)).cast("long").alias(c) for c in MEANS])
        out = out.join(means, ["match_id", "team"])
    out = out.withColumn("efficiency", efficiency(F.col("kills"), F.col("deaths")))
    return out.select("match_id", *(["team"] if by_team else ["player", "team"]), "rank", *PLAYER, *MEANS, "efficiency")


def weapon_stats(board: DataFrame, by_team: bool = False) -> DataFrame:
    """Accuracy in per cent (null without attacks), kills and damage of each weapon of the table, by player or team."""
    rows = flat(board)
    out = _summed(rows, [c for c in rows.columns if c.startswith("w_")], by_team)
    per = []
    for w in WEAPONS:
        accuracy = F.round(F.try_divide(F.col(f"w_{w}_hits") * 100.0, f"w_{w}_attacks"), 1)
        per += [accuracy.alias(f"{w}_accuracy"), F.col(f"w_{w}_kills").alias(f"{w}_kills"), F.col(f"w_{w}_damage").alias(f"{w}_damage")]
    return out.select("match_id", *(["team"] if by_team else ["player", "team"]), *per)


def item_stats(board: DataFrame, by_team: bool = False) -> DataFrame:
    """Armors, large health boxes and powerups taken, seconds of powerups, and launchers taken, dropped and handed on."""
    rows = flat(board)
    names = [c for c in rows.columns if c.startswith("i_")]
    out = _summed(rows, names, by_team)
    return out.select("match_id", *(["team"] if by_team else ["player", "team"]), *[F.col(c).alias(c[2:]) for c in names])


def entity_counts(takes: DataFrame, by: str = "player") -> DataFrame:
    """How often each player (or team) took each entity: (match_id, ``by``, ent, kind, n)."""
    return takes.filter(F.col(by).isNotNull()).groupBy("match_id", by, "ent", "kind").agg(F.count("*").alias("n"))


def verify_pickups(weapons: DataFrame, takes: DataFrame, board: DataFrame, first: bool = True, by: str = "player") -> DataFrame:
    """(match_id, ``by``, kind, cell, found, official, diff): found pickups against the board's, by player or team.

    ``weapons``: match_id, player, team, weapon, source ('world' or 'backpack') and had_before.  ``takes``: match_id, player,
    team, ent, kind of item entities.  ``first``: the first pickup of a weapon in a life, else every touch.  Cells: 'pack' of
    weapons that packs hold (the board's total less its spawned ones), 'sum' of every weapon, 'item' of items, for which a
    board counts every touch alone.
    """
    chosen = ~F.col("had_before") if first else F.lit(True)
    own = weapons.filter(F.col(by).isNotNull()).withColumn("_new", chosen)
    pack = own.filter(F.col("weapon").isin(*PACKS) & (F.col("source") == "backpack") & F.col("_new")).groupBy("match_id", by, F.col("weapon").alias("kind")).agg(F.count("*").alias("found")).withColumn("cell", F.lit("pack"))
    if first:
        rows = own.filter("_new").select("match_id", by, F.col("weapon").alias("kind"))
    else:  # touches of entities, and packs
        rows = takes.filter(F.col("kind").isin(*WEAPONS)).select("match_id", by, "kind").unionByName(own.filter(F.col("weapon").isin(*PACKS) & (F.col("source") == "backpack")).select("match_id", by, F.col("weapon").alias("kind")))
    total = rows.filter(F.col(by).isNotNull()).groupBy("match_id", by, "kind").agg(F.count("*").alias("found")).withColumn("cell", F.lit("sum"))
    items = takes.filter(F.col("kind").isin(*ITEMS) & F.col(by).isNotNull()).groupBy("match_id", by, "kind").agg(F.count("*").alias("found")).withColumn("cell", F.lit("item"))
    found = pack.unionByName(total).unionByName(items)

    of = lambda w, c: _zero(F.col("weapons")[w][c]).cast("long")
    mode = "" if first else "total_"
    cells = [F.struct(F.lit(w).alias("kind"), F.lit("pack").alias("cell"), (of(w, f"{mode}taken") - of(w, f"spawn_{mode}taken")).alias("official")) for w in PACKS]
    cells += [F.struct(F.lit(w).alias("kind"), F.lit("sum").alias("cell"), of(w, f"{mode}taken" if w in PACKS else f"spawn_{mode}taken").alias("official")) for w in WEAPONS]
    cells += [F.struct(F.lit(i).alias("kind"), F.lit("item").alias("cell"), _zero(F.col("items")[ITEMS[i]]["took"]).cast("long").alias("official")) for i in ITEMS]
    told = board.select("match_id", F.coalesce("team", F.lit("")).alias("team") if by == "team" else by, F.explode(F.array(*cells)).alias("c"))
    told = told.groupBy("match_id", by, F.col("c.kind").alias("kind"), F.col("c.cell").alias("cell")).agg(F.sum("c.official").alias("official"))
    both = found.join(told, ["match_id", by, "kind", "cell"], "full_outer").na.fill(0, ["found", "official"])
    return both.select("match_id", by, "kind", "cell", "found", "official", (F.col("found") - F.col("official")).alias("diff"))
