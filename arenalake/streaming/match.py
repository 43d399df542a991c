"""Structured Streaming forms of the match operators.

Events carry ``ts`` (event time), match_id, player, kind and v.  Rows behind the watermark are dropped by Spark; ``LateRows``
counts them by query.  Each function takes and returns streaming DataFrames; the same code runs on batches where no
state is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from arenalake.operators.attribution import BUFFER_MS, HINT_MS, POSITION_MS, PRINT_MS, RADIUS, STAT_AHEAD_MS, STAT_BACK_MS, decide_one
from arenalake.operators.kills import END_PHRASES, START_PHRASES


def tumbling(events: DataFrame, window: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Mean, smallest, largest and last value of each player in tumbling windows."""
    w = F.window("ts", window)
    out = events.withWatermark("ts", late).groupBy(w, "match_id", "player").agg(F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.max_by("v", "ts").alias("last"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "match_id", "player", "mean", "low", "high", "last", "n")


def distinct_chat(messages: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Messages once each: the same line at another time is another message."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["match_id", "ts", "type", "player", "message"])


class _InOrder(StatefulProcessor):
    """Takes a key's rows in the order of ms and seq, once the watermark has passed them by ``delay`` ms.

    Rows wait in a list state; one event-time timer at the earliest wakes the key.  What is carried from row to row is a
    value state; it goes when the key has had no row for ``forget`` ms.  Times are milliseconds since the epoch throughout,
    whatever the session's time zone.
    """

    columns: str  #: of waiting rows; the first two are ms and seq
    carried: str  #: of the value state; ``last``, the ms of the latest row, comes last
    out: str
    delay = 0

    def __init__(self, forget: int) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.columns)
        self.own = handle.getValueState("own", self.carried)

    def step(self, state: tuple | None, row: dict) -> tuple[tuple, list[tuple]]:
        """The state after a row, and what the row gives."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names, types = zip(*(c.split() for c in self.columns.split(", ")), strict=True)
        fresh = [tuple(map(_plain, r, types)) for frame in rows for r in frame[list(names)].itertuples(index=False)]
        self.held.appendList(fresh)
        self.handle.registerTimer(min(r[0] for r in fresh) + self.delay)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.held.get(), key=lambda r: r[:2])
        state, found = self.own.get() if self.own.exists() else None, []
        state, rest = self.advance(key, state, rows, mark, found)
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(max(rest[0][0] + self.delay, mark + 1))
        else:
            self.held.clear()
        if state is None or (not rest and state[-1] + self.forget <= mark):
            self.own.clear()
        else:
            self.own.update(state)
            if not rest:
                self.handle.registerTimer(state[-1] + self.forget)
        if found:
            yield pd.DataFrame([(*key, *r) for r in found], columns=[c.split()[0] for c in self.out.split(", ")])

    def advance(self, key, state: tuple | None, rows: list[tuple], mark: int, found: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        names = [c.split()[0] for c in self.columns.split(", ")]
        for n, r in enumerate(rows):
            if r[0] + self.delay > mark:
                return state, [tuple(x) for x in rows[n:]]
            if state is not None and r[0] - state[-1] > self.forget:
                state = None
            state, given = self.step(state, dict(zip(names, r, strict=True)))
            found += given
        return state, []

    def close(self) -> None:
        pass


def _plain(v, kind: str):
    """A cell as a plain value: no NaN for null, no float for an integer."""
    return None if v is None or v is pd.NA or v != v else {"long": int, "double": float, "boolean": bool, "string": str}[kind](v)


def _millis(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def _run(events: DataFrame, keys: list[str], processor: _InOrder, late: str) -> DataFrame:
    """The processor over ``events``, with ms turned into times again outside of Python."""
    names = [c.split()[0] for c in processor.columns.split(", ")]
    marked = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    rows = marked.select(*keys, *names, "ts")
    found = rows.groupBy(*keys).transformWithStateInPandas(processor, processor.out, "Append", "EventTime")
    times = [c for c in found.columns if c == "ms" or c.endswith("_ms")]
    return found.select(*[F.timestamp_millis(c).alias({"ms": "ts"}.get(c, c.removesuffix("_ms"))) if c in times else F.col(c) for c in found.columns])


def stateful(spark: SparkSession) -> None:
    """Stateful processors keep their typed states in RocksDB: call it once for a session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Changes(_InOrder):
    columns, carried, out = "ms long, seq long, v double", "was double, last long", "match_id long, player string, ms long, seq long, v double"

    def step(self, state, row):
        new = state is None or row["v"] != state[0]
        return (row["v"], row["ms"]), [(row["ms"], row["seq"], row["v"])] if new else []


def changes(events: DataFrame, late: str = "10 seconds", forget: str = "1 hour") -> DataFrame:
    """Rows whose value differs from the player's one before, across batches, in the order of ts and seq.

    A player without rows for ``forget`` starts anew.
    """
    rows = events.select("match_id", "player", "ts", "seq", F.col("v").cast("double").alias("v"))
    return _run(rows, ["match_id", "player"], _Changes(_millis(forget)), late)


class _Gate(_InOrder):
    columns, carried, out = "ms long, seq long, message string", "begun boolean, ended boolean, last long", "match_id long, ms long, seq long, message string"

    def step(self, state, row):
        begun, ended, _ = state or (False, False, 0)
        text = (row["message"] or "").lower()
        begun = begun or any(p in text for p in START_PHRASES)
        keep = begun and not ended
        ended = ended or (begun and any(p in text for p in END_PHRASES))
        return (begun, ended, row["ms"]), [(row["ms"], row["seq"], row["message"])] if keep else []


def gate(events: DataFrame, late: str = "10 seconds", forget: str = "1 hour") -> DataFrame:
    """Rows between a match's start and end phrases, by ts and seq; a match without rows for ``forget`` is forgotten."""
    return _run(events.select("match_id", "ts", "seq", "message"), ["match_id"], _Gate(_millis(forget)), late)


class _Spans(_InOrder):
    columns, carried = "ms long, seq long, v string", "v string, start long, last long"

    def __init__(self, forget: int, key: str) -> None:
        super().__init__(forget)
        self.out = f"match_id long, {key}, v string, start_ms long, end_ms long"

    def step(self, state, row):
        was, start, _ = state or (None, None, None)
        if row["v"] == was:
            return (was, start, row["ms"]), []
        return (row["v"], row["ms"], row["ms"]), [(was, start, row["ms"])] if was is not None else []


def spans(events: DataFrame, key: str = "player", late: str = "10 seconds", forget: str = "1 hour") -> DataFrame:
    """(match_id, ``key``, v, start, end): runs of one value that another value has ended; null ends a run and begins none.

    A value that flips, not a gap, ends a session: lives are the runs of an 'alive' state by player, occupancies the runs of
    a name by slot.
    """
    rows = events.select("match_id", key, "ts", "seq", F.col("v").cast("string").alias("v"))
    return _run(rows, ["match_id", key], _Spans(_millis(forget), f"{key} {dict(rows.dtypes)[key]}"), late)


def lives(marks: DataFrame, late: str = "10 seconds", forget: str = "1 hour") -> DataFrame:
    """(match_id, player, start, end) from a spawn to the next death; ``marks``: match_id, player, ts, seq, kind."""
    alive = marks.select("match_id", "player", "ts", "seq", F.when(F.col("kind") == "spawn", "alive").alias("v"))
    return spans(alive, "player", late, forget).drop("v")


class _Attribution(_InOrder):
    """Evidence waits in the list; ``gone`` has the state of each entity."""

    columns = "ms long, seq long, kind string, ent long, item string, player string, taken boolean, x double, y double, z double, used boolean"
    carried, delay = "last long", STAT_AHEAD_MS
    out = "match_id long, ms long, seq long, ent long, item string, player string, source string"

    def init(self, handle):
        super().init(handle)
        self.gone = handle.getMapState("gone", "ent long", "taken boolean")

    def advance(self, key, state, rows, mark, found):
        names = [c.split()[0] for c in self.columns.split(", ")]
        every = [dict(zip(names, r, strict=True)) for r in rows]
        of = lambda kind, low, high, t: [e for e in every if e["kind"] == kind and low <= e["ms"] - t <= high]
        for row in [r for r in every if r["kind"] == "state" and r["ms"] + self.delay <= mark]:
            row["done"] = True
            if row["taken"] == (self.gone.containsKey((row["ent"],)) and self.gone.getValue((row["ent"],))[0]):
                continue
            self.gone.updateValue((row["ent"],), (row["taken"],))
            if not row["taken"]:
                continue
            t, hints = row["ms"], of("hint", -HINT_MS, HINT_MS, row["ms"])
            # the last one before or the first one after, whichever is nearer
            best = min((h for h in hints if h["ent"] == row["ent"]), key=lambda h: (abs(h["ms"] - t), h["ms"] > t, h["seq"] if h["ms"] > t else -h["seq"]), default=None)
            named = lambda kind, low, high: [{"e_seq": e["seq"], "player": e["player"]} for e in of(kind, low, high, t) if e["item"] == row["item"] and not e["used"]]  # noqa: B023, E731
            at = {}
            for e in of("position", -POSITION_MS, 0, t):  # rows come in order: the latest stays
                at[e["player"]] = sum((e[c] - row[c]) ** 2 for c in "xyz")
            close = [{"player": p} for d, p in sorted((d, p) for p, d in at.items() if d <= RADIUS * RADIUS)]
            fact = {"chain": 0, "hint": best["player"] if best and not best["used"] else None, "prints": named("print", -PRINT_MS, PRINT_MS), "stats": named("stat", -STAT_BACK_MS, STAT_AHEAD_MS), "close": close}
            (_, who, source), used = decide_one(fact)
            if source == "hint":
                best["used"] = True
            for e in every:
                e["used"] = e["used"] or (e["kind"] + "s", e["seq"]) in used
            found.append((t, row["seq"], row["ent"], row["item"], who, source))
        left = [r for r in every if not r.get("done") and r["ms"] + (self.delay if r["kind"] == "state" else BUFFER_MS) > mark]
        last = max([r["ms"] for r in every], default=mark)
        return (max(last, state[0] if state else last),), [tuple(r[c] for c in names) for r in left]


def attribute(events: DataFrame, late: str = "10 seconds", forget: str = "1 hour") -> DataFrame:
    """(match_id, ts, seq, ent, item, player, source): who took an item, by the layers of ``operators.attribution.attribute``.

    ``events``: match_id, ts, seq, kind ('state', 'hint', 'print', 'stat' or 'position'), ent and taken of states, ent of
    hints, item (its kind) of states, prints and stats, player, and x, y, z of states and positions.  A state is decided once
    the watermark is 500 ms past it; evidence goes after a second.
    """
    rows = events.select("match_id", "ts", "seq", "kind", F.col("ent").cast("long").alias("ent"), "item", "player", "taken", *[F.col(c).cast("double").alias(c) for c in "xyz"], F.lit(False).alias("used"))
    return _run(rows, ["match_id"], _Attribution(_millis(forget)), late)


class _Settled(_InOrder):
    columns, carried = "ms long, seq long, taken boolean, respawn_ms long", "due long, last long"
    out = "match_id long, ent long, ms long"

    def __init__(self, settle: int) -> None:
        super().__init__(0)
        self.settle = settle

    def advance(self, key, state, rows, mark, found):
        due = state[0] if state else None
        for n, (ms, _, taken, respawn) in enumerate(rows):
            if ms > mark:
                break
            if due is not None and due + self.settle <= ms:
                found.append((due,))
            due = ms + respawn if taken else None
        else:
            n = len(rows)
        if due is not None and due + self.settle <= mark:
            found.append((due,))
            due = None
        # ``last`` is when the timer has to wake the key
        return None if due is None else (due, due + self.settle), [tuple(r) for r in rows[n:]]


def settled_respawns(states: DataFrame, late: str = "10 seconds", settle_ms: int = 500) -> DataFrame:
    """(match_id, ent, ts): items that must be back, though no state says so: ``settle_ms`` after the respawn that a pickup
    predicts, unless another state of the entity came by then.

    ``states``: match_id, ent, ts, seq, taken and respawn_ms (milliseconds until the item is back).
    """
    return _run(states.select("match_id", "ent", "ts", "seq", "taken", "respawn_ms"), ["match_id", "ent"], _Settled(settle_ms), late)


class LateRows(StreamingQueryListener):
    """Counts the rows that queries drop behind their watermarks, by query name: ``spark.streams.addListener(LateRows())``."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.dropped.setdefault(event.name, 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.dropped[p.name] = self.dropped.get(p.name, 0) + sum(max(0, o.numRowsDroppedByWatermark) for o in p.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def drops_to_pickups(drops: DataFrame, pickups: DataFrame, within: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """Stream-stream interval join: pickups of an entity within a time after its drop."""
    d = drops.withWatermark("ts", late).select("match_id", "ent", F.col("ts").alias("drop_ts"), F.col("player").alias("dropper"))
    p = pickups.withWatermark("ts", late).select(F.col("match_id").alias("m"), F.col("ent").alias("e"), F.col("ts").alias("pick_ts"), F.col("player").alias("taker"))
    when = (F.col("pick_ts") >= F.col("drop_ts")) & (F.col("pick_ts") <= F.col("drop_ts") + F.expr(f"INTERVAL {within}"))
    return d.join(p, (F.col("match_id") == F.col("m")) & (F.col("ent") == F.col("e")) & when).drop("m", "e")


def sessions(events: DataFrame, gap: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """Runs of a player's events without a longer gap."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s, "match_id", "player").agg(F.count("*").alias("n")).select("match_id", "player", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
