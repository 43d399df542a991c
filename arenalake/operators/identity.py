"""Who is who: sessions of a slot, identities across sessions, name resolution, stitching and rebasing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalake.functions.graph import components
from arenalake.functions.temporal import KEYS, asof, changed
from arenalake.functions.text import normalize_name
from arenalake.sources.shared import settled

SLOT = ["match_id", "slot"]


def sessions(userinfo: DataFrame) -> DataFrame:
    """(match_id, slot, session, start_ms, end_ms, name, team, auth) from user updates (t_ms, seq, user_id, name, team, auth).

    A session begins where the nonzero user id changes; the first reaches back without bound (null start), the last ahead
    (null end).  Name, team and auth are the latest that are not blank.
    """
    w = Window.partitionBy(*SLOT).orderBy("t_ms", "seq")
    uid = F.last(F.when(F.col("user_id") != 0, F.col("user_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = userinfo.withColumn("_uid", uid)
    x = x.withColumn("_was", F.lag("_uid").over(w))
    x = x.withColumn("session", F.sum((F.col("_was").isNotNull() & (F.col("_uid") != F.col("_was"))).cast("int")).over(w))
    at = F.struct("t_ms", "seq")
    latest = lambda c: F.coalesce(F.max_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", at)), F.lit("")).alias(c)
    out = x.groupBy(*SLOT, "session").agg(F.min("t_ms").alias("_start"), *map(latest, ("name", "team", "auth")))
    by = Window.partitionBy(*SLOT).orderBy("session")
    return out.select(*SLOT, "session", F.when(F.col("session") > 0, F.col("_start")).alias("start_ms"), F.lead("_start").over(by).alias("end_ms"), "name", "team", "auth")


def at_slot(rows: DataFrame, found: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` (match_id, slot, t_ms) with ``values`` of the session that holds the slot then."""
    begin = found.withColumn("t_ms", F.coalesce("start_ms", F.lit(-(1 << 31)))).withColumn("seq", F.col("session"))
    return asof(rows, begin, values, SLOT)


def unify(found: DataFrame, links: DataFrame | None = None, rich: DataFrame | None = None) -> DataFrame:
    """``found`` sessions with ``identity``: sessions joined, over any number of steps, by equal keys.

    Keys are a session's auth and ``links`` (match_id, slot, session, key), see ``scoreboard_links`` and
    ``reconnect_links``.  Normalised names are keys only in bare matches: without auth, links, and not in ``rich`` (match_id).
    """
    node = F.concat_ws(":", F.lpad(F.col("slot").cast("string"), 3, "0"), F.lpad(F.col("session").cast("string"), 5, "0"))
    base = found.withColumn("node", node)
    keyed = base.filter("auth <> ''").select("match_id", "node", F.concat(F.lit("a:"), "auth").alias("key"))
    if links is not None:
        keyed = keyed.unionByName(links.select("match_id", node.alias("node"), F.concat(F.lit("l:"), "key").alias("key")))
    known = keyed.select("match_id") if rich is None else keyed.select("match_id").union(rich.select("match_id"))
    bare = base.join(known.distinct(), "match_id", "left_anti")
    keyed = settled(keyed.unionByName(bare.select("match_id", "node", F.concat(F.lit("n:"), normalize_name(F.col("name"))).alias("key"))))
    hub = keyed.groupBy("match_id", "key").agg(F.min("node").alias("other"))
    star = keyed.join(hub, ["match_id", "key"]).select("match_id", "node", "other")
    both = star.unionByName(star.select("match_id", F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    labels = components(settled(both), ["match_id"], "node", "other", "identity")
    return base.join(labels, ["match_id", "node"], "left").withColumn("identity", F.coalesce("identity", "node")).drop("node")


def scoreboard_links(found: DataFrame, scoreboard: DataFrame) -> DataFrame:
    """(match_id, slot, session, key) of sessions that the scoreboard (match_id, name, login) knows by login or by name."""
    known = resolve(found, scoreboard, "name", F.col("auth")).filter("board is not null")
    return known.select(*SLOT, "session", F.concat(F.lit("s:"), "board").alias("key"))


def reconnect_links(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(match_id, slot, session, key): all sessions of a name that a reconnect line (match_id, t_ms, message) begins with."""
    names = reconnects(lines, found.filter("name <> ''").select("match_id", "name")).select("match_id", normalize_name(F.col("name")).alias("_norm")).distinct()
    own = found.withColumn("_norm", normalize_name(F.col("name"))).join(names, ["match_id", "_norm"])
    return own.select(*SLOT, "session", F.concat(F.lit("r:"), "_norm").alias("key"))


def _players(identities: DataFrame) -> DataFrame:
    """Identities with ``player``: the latest session's name, with its slot as a suffix where several identities share it."""
    last = identities.filter("name <> ''").groupBy("match_id", "identity").agg(F.max_by(F.struct("name", "slot"), F.struct(F.coalesce("start_ms", F.lit(-(1 << 31))), "slot", "session")).alias("x"))
    shared = F.count("*").over(Window.partitionBy("match_id", "x.name")) > 1
    names = last.select("match_id", "identity", F.when(shared, F.concat(F.col("x.name"), F.lit("#"), F.col("x.slot").cast("string"))).otherwise(F.col("x.name")).alias("player"))
    return identities.join(names, ["match_id", "identity"], "left")


def stitch(rows: DataFrame, identities: DataFrame) -> DataFrame:
    """A slot's value changes (t_ms, seq, v) as one stream a player, without repeats at the seams."""
    keyed = at_slot(rows, _players(identities), ["player"]).filter("player is not null")
    return changed(keyed.select(*KEYS, "t_ms", "seq", "v"), "v")


def stitch_intervals(spans: DataFrame, identities: DataFrame) -> DataFrame:
    """A slot's intervals (start_ms, end_ms) cut at its sessions, by player; what is empty then goes."""
    own = _players(identities).filter("player is not null").select(*SLOT, "player", F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"))
    cut = spans.join(own, SLOT).withColumns({"start_ms": F.greatest("start_ms", "_from"), "end_ms": F.least("end_ms", "_to")})
    return cut.filter("end_ms > start_ms").select(*KEYS, "start_ms", "end_ms")


def team_by_name(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """``rows`` (match_id, player) with team: by exact name, or else by the normalised name (the first by letters)."""
    exact = teams.groupBy(*KEYS).agg(F.min("team").alias("_exact"))
    norm = teams.groupBy("match_id", normalize_name(F.col("player")).alias("_norm")).agg(F.min_by("team", "player").alias("_like"))
    out = rows.withColumn("_norm", normalize_name(F.col("player"))).join(exact, KEYS, "left").join(norm, ["match_id", "_norm"], "left")
    return out.withColumn("team", F.coalesce("_exact", "_like")).drop("_norm", "_exact", "_like")


def victim_slot(lines: DataFrame, userinfo: DataFrame) -> DataFrame:
    """``lines`` (match_id, t_ms, victim) with slot: the lowest slot whose current name is the victim's, case and all."""
    slots = userinfo.select(*SLOT).distinct()
    asked = lines.withColumn("_id", F.monotonically_increasing_id())
    named = asof(settled(asked).join(slots, "match_id"), userinfo, ["name"], SLOT)
    hit = named.filter(F.col("name") == F.col("victim")).groupBy("_id").agg(F.min("slot").alias("slot"))
    return named.select(*lines.columns, "_id").distinct().join(hit, "_id", "left").drop("_id")


def rebase(stream: DataFrame, starts: DataFrame) -> DataFrame:
    """Times relative to the match start (match_id, start_ms): earlier rows go, but for one carried to 0; nothing happens where
    the start isn't positive."""
    begin = starts.filter("start_ms > 0")
    moved = stream.join(begin, "match_id")
    late = moved.filter("t_ms >= start_ms").select(*KEYS, (F.col("t_ms") - F.col("start_ms")).alias("t_ms"), "seq", "v")
    early = moved.filter("t_ms < start_ms").groupBy(*KEYS).agg(F.max_by(F.struct("seq", "v"), F.struct("t_ms", "seq")).alias("x"))
    at_zero = late.filter("t_ms = 0").select(*KEYS).distinct()
    carry = early.join(at_zero, KEYS, "left_anti").select(*KEYS, F.lit(0).alias("t_ms"), "x.seq", "x.v")
    same = stream.join(begin, "match_id", "left_anti").select(*KEYS, "t_ms", "seq", "v")
    return late.unionByName(carry).unionByName(same)


def rebase_intervals(spans: DataFrame, starts: DataFrame) -> DataFrame:
    begin = starts.select("match_id", F.greatest("start_ms", F.lit(0)).alias("_s"))
    out = spans.join(begin, "match_id", "left").na.fill(0, ["_s"])
    return out.filter(F.col("end_ms") > F.col("_s")).select(*KEYS, (F.greatest("start_ms", "_s") - F.col("_s")).alias("start_ms"), (F.col("end_ms") - F.col("_s")).alias("end_ms"))


def first_user(userinfo: DataFrame) -> DataFrame:
    """(match_id, name, user_id): the first nonzero user id of each slot, then the first of each name in the order of slots;
    a slot has its latest name."""
    slots = userinfo.groupBy(*SLOT).agg(F.min_by("user_id", F.when(F.col("user_id") > 0, F.col("seq"))).alias("user_id"), F.max_by("name", "seq").alias("name"))
    return slots.filter("user_id > 0").groupBy("match_id", "name").agg(F.min_by("user_id", "slot").alias("user_id"))


def resolve(rows: DataFrame, scoreboard: DataFrame, name: str, login: Column | None = None) -> DataFrame:
    """``rows`` with ``board``: the scoreboard name by login, or else by normalised name where that is unambiguous."""
    norm = scoreboard.select("match_id", F.col("name").alias("_board"), normalize_name(F.col("name")).alias("_norm"))
    alone = norm.withColumn("_n", F.count("*").over(Window.partitionBy("match_id", "_norm"))).filter("_n = 1 and _norm <> ''").drop("_n")
    out = rows.withColumns({"_norm": normalize_name(F.col(name)), "_login": login if login is not None else F.lit(None).cast("string")})
    by_login = scoreboard.filter("login <> ''").groupBy("match_id", F.col("login").alias("_login")).agg(F.min("name").alias("_by_login"))
    joined = out.join(by_login, ["match_id", "_login"], "left").join(alone, ["match_id", "_norm"], "left")
    return joined.withColumn("board", F.coalesce("_by_login", "_board")).drop("_login", "_norm", "_by_login", "_board")


def fuzzy(queries: DataFrame, players: DataFrame) -> DataFrame:
    """(match_id, query, player): exact name, then normalised, then one contained in the other; the first slot wins."""
    q = queries.withColumn("_q", normalize_name(F.col("query")))
    p = players.select("match_id", "slot", "player", normalize_name(F.col("player")).alias("_p"))
    rank = F.when(F.col("query") == F.col("player"), 0).when(F.col("_q") == F.col("_p"), 1).when(F.col("_q").contains(F.col("_p")) | F.col("_p").contains(F.col("_q")), 2)
    both = q.join(p, "match_id").withColumn("_rank", rank).filter(F.col("_rank").isNotNull() & (F.col("_q") != "") & (F.col("_p") != ""))
    return both.groupBy("match_id", "query").agg(F.min_by("player", F.struct("_rank", "slot")).alias("player"))


def reconnects(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(match_id, t_ms, name): the longest known name that a line starts with, followed by a space."""
    hit = lines.join(names.distinct(), "match_id").filter(F.expr("startswith(message, concat(name, ' '))"))
    return hit.groupBy("match_id", "t_ms", "message").agg(F.max_by("name", F.length("name")).alias("name"))


def deaths_and_spawns(signals: DataFrame) -> DataFrame:
    """Emitted events of signals (match_id, slot, t_ms, seq, alive, forced): where the known state changes, or it is forced.

    Every signal sets the known state, which is unknown before the first one.  ``signal`` is passed on; one that is called
    'seed' only sets the state.
    """
    w = Window.partitionBy(*SLOT).orderBy("t_ms", "seq")
    more = ["signal"] if "signal" in signals.columns else []
    told = F.col("signal") != "seed" if more else F.lit(True)
    out = signals.withColumn("_known", F.lag("alive").over(w)).filter(F.col("forced") | (told & ~F.col("alive").eqNullSafe(F.col("_known"))))
    return out.select(*SLOT, "t_ms", "seq", F.when(F.col("alive"), "spawn").otherwise("death").alias("event"), *more)


def lifecycle(health: DataFrame, flags: DataFrame, obituaries: DataFrame, starts: DataFrame) -> DataFrame:
    """(match_id, slot, t_ms, seq, event, signal): deaths and spawns from three signals that share one known state.

    ``health`` (match_id, slot, t_ms, seq, health): a fall to 0 or less is a death, a rise above it a spawn; before the first
    value health is 0.  ``flags`` (..., dead), a frame each: against the known state; the first one of a slot, if dead, only
    sets it.  ``obituaries`` (match_id, slot, t_ms, seq) of a started match (``starts``: match_id, start_ms, start_seq) are
    deaths in any case, as a player may die twice between two frames.
    """
    w = Window.partitionBy(*SLOT).orderBy("t_ms", "seq")
    at = [*SLOT, "t_ms", "seq"]
    up = F.col("health") > 0
    edges = health.withColumn("_was", F.lag("health", 1, 0).over(w) > 0).filter(F.col("_was") != up)
    seed = (F.row_number().over(w) == 1) & F.col("dead")
    framed = flags.withColumn("_seed", seed)
    begun = obituaries.join(starts.select("match_id", "start_ms", "start_seq"), "match_id")
    begun = begun.filter((F.col("t_ms") > F.col("start_ms")) | ((F.col("t_ms") == F.col("start_ms")) & (F.col("seq") >= F.col("start_seq"))))
    signals = edges.select(*at, up.alias("alive"), F.lit(False).alias("forced"), F.lit("health").alias("signal"))
    signals = signals.unionByName(framed.select(*at, (~F.col("dead")).alias("alive"), F.lit(False).alias("forced"), F.when(F.col("_seed"), "seed").otherwise("flag").alias("signal")))
    signals = signals.unionByName(begun.select(*at, F.lit(False).alias("alive"), F.lit(True).alias("forced"), F.lit("text").alias("signal")))
    return deaths_and_spawns(signals)
