"""Who took an item: layers of evidence, used up in order of time, and pickups that no state shows.

Candidates come from time-binned band joins, so no two rows of a match meet that are not near in time.  What one decision
uses up, the next can't have, so the decisions of a match, some thousands, are folded in one ordered pass; all that is
unbounded (positions, stat updates) has been joined and reduced before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalake.functions.temporal import asof, band
from arenalake.operators.pickups import ENT, RESPAWN

# Windows in milliseconds, the radius in units, and the longest chain of pickups that no state shows.
HINT_MS, PRINT_MS, STAT_BACK_MS, STAT_AHEAD_MS, POSITION_MS, SETTLE_MS, RADIUS, CHAIN = 250, 250, 100, 500, 250, 500, 256, 60
BUFFER_MS = 1000  #: a stream keeps evidence so long


def seconds(kind: Column) -> Column:
    """Seconds until an item of a kind is back."""
    return F.element_at(F.create_map(*[F.lit(x) for p in RESPAWN.items() for x in p]), kind)


def _squared(a: str, b: str) -> Column:
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"), F.lit(0.0))


def close_by(taken: DataFrame, positions: DataFrame, back: int = POSITION_MS, ahead: int = 0) -> DataFrame:
    """Players within RADIUS of each row of ``taken`` (id, match_id, t_ms, x, y, z) -> (id, player, distance2).

    A player stands where the latest position at most ``back`` old has them (or, with ``ahead``, the nearest in time).
    """
    found = positions.select("match_id", F.col("t_ms").alias("e_ms"), F.col("seq").alias("e_seq"), "player", *[F.col(c).cast("double").alias(f"p_{c}") for c in "xyz"])
    near = band(taken.select("id", "match_id", "t_ms", *[F.col(c).cast("double").alias(f"i_{c}") for c in "xyz"]), found, ["match_id"], -back, ahead)
    nearest = F.struct(-F.abs(F.col("e_ms") - F.col("t_ms")), -F.col("e_ms") if ahead else F.col("e_ms"), "e_seq")
    last = near.groupBy("id", "player").agg(F.max_by(F.struct(_squared("i_", "p_").alias("distance2")), nearest).alias("at"))
    return last.select("id", "player", "at.distance2").filter(F.col("distance2") <= RADIUS * RADIUS)


def _candidates(rows: DataFrame, evidence: DataFrame, low: int, high: int, name: str) -> DataFrame:
    """(id, ``name``): the evidence of a row's kind in the band, by time."""
    found = evidence.select("match_id", "kind", F.col("t_ms").alias("e_ms"), F.col("seq").alias("e_seq"), "player")
    near = band(rows.select("id", "match_id", "kind", "t_ms"), found, ["match_id", "kind"], low, high)
    return near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("e_ms", "e_seq", "player"))).alias(name))


def _listed(close: DataFrame) -> DataFrame:
    return close.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance2", "player"))).alias("close"))


def expected(base: DataFrame) -> DataFrame:
    """``base`` (pickups with t_ms and ``until_ms``, the entity's next signal, if any) at each time at which the item would be
    taken if somebody always took it as it came back: ``chain`` 1, 2, ... up to CHAIN, as long as no signal has come by then."""
    step = (seconds(F.col("kind")) * 1000).cast("long")
    most = F.least(F.lit(CHAIN), F.floor((F.col("until_ms") - 1 - SETTLE_MS - F.col("t_ms")) / step)).cast("int")
    rows = base.withColumn("_step", step).filter("_step is not null").withColumn("_most", most).filter("_most >= 1")
    rows = rows.withColumn("chain", F.explode(F.sequence(F.lit(1), F.col("_most"))))
    return rows.withColumn("t_ms", (F.col("t_ms") + F.col("chain") * F.col("_step")).cast("int")).drop("_step", "_most")


def _free(row: dict, layer: str, used: set) -> dict[str, tuple]:
    """The first piece of evidence of each player that nothing has used up."""
    out: dict[str, tuple] = {}
    for e in row[layer] or ():
        if (layer, e["e_seq"]) not in used:
            out.setdefault(e["player"], (layer, e["e_seq"]))
    return out


def _layers(row: dict, used: set) -> tuple[str | None, str]:
    """Player and source of a pickup that is known to be one; ``used`` grows by what it takes."""
    if row["hint"] is not None:
        return row["hint"], "hint"
    for layer, source in (("prints", "print"), ("stats", "stat")):
        free = _free(row, layer, used)
        if len(free) == 1:
            ((who, e),) = free.items()
            used.add(e)
            return who, source
    # the nearest; of those with evidence, if several have some
    who = next((c["player"] for c in row["close"] or () if not free or c["player"] in free), None)
    if who in free:
        used.add(free[who])
    return who, "none" if who is None else "distance"


def decide_one(row: dict) -> tuple[tuple[dict, str | None, str], set]:
    """A pickup with its free evidence: (row, player, source), and what it uses up."""
    used: set = set()
    return (row, *_layers(row, used)), used


def _decide(rows: list[dict]) -> Iterator[tuple[dict, str | None, str]]:
    """The rows of a match that are decided, with player and source; ``rows`` in order."""
    used, broken = set(), set()
    for row in rows:
        if row["chain"] == 0:
            yield row, *_layers(row, used)
        elif row["base"] not in broken:
            close = {c["player"] for c in row["close"] or ()}
            among = [(p, e) for p, e in _free(row, "stats", used).items() if p in close]
            if len(among) == 1:
                used.add(among[0][1])
                yield row, among[0][0], "synthetic"
            else:
                broken.add(row["base"])


OUT = "match_id {}, ent {}, kind string, t_ms int, seq long, chain int, player string, source string"


def _fold(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: (r["due_ms"], r["chain"] > 0, r["seq"], r["chain"]))
    found = [(r["match_id"], r["ent"], r["kind"], r["t_ms"], r["seq"], r["chain"], who, source) for r, who, source in _decide(rows)]
    types = [table.schema.field("match_id").type, table.schema.field("ent").type, pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    names = ["match_id", "ent", "kind", "t_ms", "seq", "chain", "player", "source"]
    return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=names)


def decisions(states: DataFrame, hints: DataFrame, prints: DataFrame, stats: DataFrame, positions: DataFrame, matches: DataFrame, synthetic: bool = True) -> DataFrame:
    """What ``resynth`` decides, in rows with candidates: base pickups (chain 0) and, if ``synthetic``, those expected after them."""
    edge = Window.partitionBy(*ENT).orderBy("t_ms", "seq")
    changes = states.withColumn("_was", F.coalesce(F.lag("taken").over(edge), F.lit(False))).filter(F.col("taken") != F.col("_was")).drop("_was")
    items = states.groupBy(*ENT).agg(F.first("kind").alias("kind"), *[F.first(c).alias(c) for c in "xyz"])  # an item stays where it is
    # a hint at the time of a change comes before it
    at = asof(hints.select(*ENT, "t_ms", "seq", "player"), changes.select(*ENT, "t_ms", "seq", F.col("taken").alias("gone")), ["gone"], ENT, inclusive=False)
    at = at.withColumn("gone", F.coalesce("gone", F.lit(False)))
    took = changes.filter("taken").select(*ENT, "t_ms", "seq")
    hint = F.struct(F.col("t_ms").alias("at"), "seq", "player")
    waiting = (at.filter(~F.col("gone")) if synthetic else at).select(*ENT, "t_ms", "seq", hint.alias("before"), hint.alias("after"))
    seen = asof(took, waiting, ["before"], ENT)
    if synthetic:
        seen = seen.withColumn("after", F.lit(None).cast(seen.schema["before"].dataType))
    else:
        seen = asof(seen, waiting, ["after"], ENT, inclusive=False, forward=True)
    gap = lambda c: F.when(F.abs(F.col(f"{c}.at") - F.col("t_ms")) <= HINT_MS, F.abs(F.col(f"{c}.at") - F.col("t_ms")))
    use = F.when(gap("before").isNotNull() & (gap("after").isNull() | (gap("before") <= gap("after"))), F.col("before")).when(gap("after").isNotNull(), F.col("after"))
    seen = seen.withColumn("use", use)
    once = F.row_number().over(Window.partitionBy(*ENT, "use.seq").orderBy("t_ms", "seq")) == 1  # a hint serves one pickup
    base = seen.select(*ENT, "t_ms", "seq", F.when(once, F.col("use.player")).alias("hint"))
    if synthetic:  # the server names a taker though the item is gone: it came back and went unseen
        base = base.unionByName(at.filter("gone").select(*ENT, "t_ms", "seq", F.col("player").alias("hint")))
    ends = matches.select("match_id", F.col("match_end_ms").alias("end_ms"))
    signals = base.select(*ENT, "t_ms", "seq", "hint", F.lit(True).alias("own")).unionByName(changes.filter("not taken").select(*ENT, "t_ms", "seq", F.lit(None).cast("string").alias("hint"), F.lit(False).alias("own")))
    until = F.lead("t_ms").over(Window.partitionBy(*ENT).orderBy("t_ms", "seq"))
    base = signals.withColumn("until_ms", until).filter("own").join(ends, "match_id").join(items, ENT)
    base = base.select(*ENT, "kind", "t_ms", "seq", "hint", F.coalesce("until_ms", F.col("end_ms") + 1).alias("until_ms"), "x", "y", "z", F.lit(0).alias("chain"), F.concat_ws(":", "ent", "seq").alias("base"))
    first = base.withColumn("id", F.concat_ws(":", "match_id", "base", "chain"))
    rows = first.withColumn("due_ms", F.col("t_ms"))
    parts = [(rows, _candidates(first, prints, -PRINT_MS, PRINT_MS, "prints"), _candidates(first, stats, -STAT_BACK_MS, STAT_AHEAD_MS, "stats"), _listed(close_by(first, positions)))]
    if synthetic:
        later = expected(base).withColumn("hint", F.lit(None).cast("string")).withColumn("id", F.concat_ws(":", "match_id", "base", "chain"))
        backed = _candidates(later, stats, -STAT_BACK_MS, STAT_AHEAD_MS, "stats")
        rows = later.withColumn("due_ms", F.col("t_ms") + SETTLE_MS)
        parts.append((rows, None, backed, _listed(close_by(later.join(backed.select("id"), "id"), positions, STAT_AHEAD_MS, STAT_AHEAD_MS))))
    out = None
    for rows, printed, backed, close in parts:
        x = rows.join(printed, "id", "left") if printed is not None else rows.withColumn("prints", F.lit(None).cast(parts[0][1].schema["prints"].dataType))
        x = x.join(backed, "id", "left").join(close, "id", "left")
        x = x.select(*ENT, "kind", F.col("t_ms").cast("int").alias("t_ms"), F.col("seq").cast("long").alias("seq"), F.col("chain").cast("int").alias("chain"), "base", "hint", F.col("due_ms").cast("long").alias("due_ms"), "prints", "stats", "close")
        out = x if out is None else out.unionByName(x)
    return out


def resynth(states: DataFrame, hints: DataFrame, prints: DataFrame, stats: DataFrame, positions: DataFrame, matches: DataFrame, synthetic: bool = True) -> DataFrame:
    """(match_id, ent, kind, t_ms, seq, chain, player, source): every pickup and who made it.

    ``states``: match_id, ent, kind, x, y, z, t_ms, seq, taken.  ``hints``: match_id, ent, t_ms, seq, player.  ``prints`` and
    ``stats``: match_id, kind, t_ms, seq, player.  ``positions``: match_id, player, t_ms, seq, x, y, z.

    Layers of a state that turns taken: the hint of its entity (at most 250 ms before); a print of its kind (within 250 ms),
    if one player has one; stat evidence (100 ms before to 500 ms after), if one player has some; else the nearest player
    within 256 units by a position at most 250 ms old, and among several with evidence only those.  What a decision takes is
    used up.

    ``synthetic`` adds pickups that no state shows: a hint while the item is gone; and, at the time the item would be back
    and with 500 ms for evidence to arrive, a pickup by the one player with unused stat evidence and a position nearby.  Each
    such pickup predicts the next, 60 at most; a state or hint of the entity, or a time without just one candidate, ends it.
    """
    rows = decisions(states, hints, prints, stats, positions, matches, synthetic)
    types = dict(rows.dtypes)
    return rows.groupBy("match_id").applyInArrow(_fold, OUT.format(types["match_id"], types["ent"]))


def attribute(states: DataFrame, hints: DataFrame, prints: DataFrame, stats: DataFrame, positions: DataFrame, matches: DataFrame) -> DataFrame:
    """Pickups that states show, by layers alone: hints may also follow the state by up to 250 ms."""
    return resynth(states, hints, prints, stats, positions, matches, False).drop("chain")
