"""Streams give what the same rows give as a batch, in any time zone."""

import random
import time

import pytest

from pyspark.sql import functions as F

from arenalake.functions import temporal
from arenalake.operators import attribution as A
from arenalake.streaming import match as M


@pytest.fixture(autouse=True, params=["UTC", "Asia/Tokyo", "America/New_York"])
def zone(request, spark):
    """State does not depend on the session's time zone."""
    M.stateful(spark)
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _split(spark, sf, path):
    rows = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'purchase'").select(F.floor(F.col("user_id") / 10).alias("match_id"), F.col("user_id").cast("string").alias("player"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.floor("value") % 5).cast("double").alias("v"), F.lit("x").alias("message"), F.lit("chat").alias("type"))
    for i in range(3):
        rows.filter(F.col("seq") % 1000 >= i * 333).filter(F.col("seq") % 1000 < (i + 1) * 333 + (i == 2)).coalesce(1).write.mode("append").parquet(path)
    return rows


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def _feed(spark, path, batches, schema):
    """A stream of one file a batch, in order; the last batch only moves the watermark."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema.replace("ts timestamp", "ms long")).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
        df.coalesce(1).write.parquet(f"{path}/{i}")
    read = spark.readStream.schema(spark.read.parquet(f"{path}/0").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return read.parquet(path)


T0 = 1_700_000_000_000


def test_changes_carry_over_batches(spark, tmp_path):
    row = lambda p, t, s, v: (1, p, T0 + t, s, v)
    batches = [[row("a", 0, 1, 5.0), row("a", 2000, 3, 6.0)], [row("a", 1000, 2, 5.0), row("b", 2500, 9, 1.0)], [row("a", 30_000, 4, 6.0), row("a", 31_000, 5, 7.0)], [row("z", 90_000, 7, 0.0)], [row("z", 200_000, 8, 0.0)], [row("z", 400_000, 10, 0.0)]]
    stream = _feed(spark, str(tmp_path / "c"), batches, "match_id long, player string, ts timestamp, seq long, v double")
    got = sorted((r.player, r.seq) for r in _run(spark, M.changes(stream, "5 seconds", "2 minutes"), "carried").collect())
    assert got == [("a", 1), ("a", 3), ("a", 5), ("b", 9), ("z", 7)]


def test_chat_keeps_lines_of_other_times(spark, tmp_path):
    row = lambda t: (1, "a", T0 + t, "chat", "gg")
    stream = _feed(spark, str(tmp_path / "d"), [[row(0), row(0)], [row(0), row(500)]], "match_id long, player string, ts timestamp, type string, message string")
    assert _run(spark, M.distinct_chat(stream, "10 seconds"), "chatty").count() == 2


def test_settle_timers(spark, tmp_path):
    row = lambda ent, t, s, taken: (1, ent, T0 + t, s, taken, 20_000)
    batches = [[row(1, 0, 1, True), row(2, 0, 2, True)], [row(2, 19_000, 3, False), row(3, 1000, 4, True)], [row(9, 60_000, 5, False)], [row(9, 99_000, 6, False)]]
    stream = _feed(spark, str(tmp_path / "f"), batches, "match_id long, ent long, ts timestamp, seq long, taken boolean, respawn_ms long")
    found = _run(spark, M.settled_respawns(stream, "5 seconds"), "timers").select("ent", (F.unix_millis("ts") - T0).alias("ms"))
    assert sorted(map(tuple, found.collect())) == [(1, 20_000), (3, 21_000)]


def _shuffled(rows, end, rnd, within=4000):
    """Batches in which a row comes up to ``within`` ms out of order; two more move the watermark on."""
    moved = sorted(rows, key=lambda r: r[1] + rnd.randint(0, within))
    size = -(-len(moved) // 4)
    return [moved[i : i + size] for i in range(0, len(moved), size)] + [[end(10_000_000)], [end(20_000_000)]]


def test_flip_sessions_as_in_batches(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(1, T0 + t, s, f"p{rnd.randint(0, 3)}", rnd.choice(["spawn", "death"])) for s, t in enumerate(sorted(rnd.sample(range(60_000), 120)))]
    batches = _shuffled(rows, lambda t: (9, T0 + t, t, "end", "death"), rnd)
    schema = "match_id long, ts timestamp, seq long, player string, kind string"
    got = _run(spark, M.lives(_feed(spark, str(tmp_path / "g"), batches, schema), "5 seconds"), "lives")
    plain = spark.createDataFrame(rows, "match_id long, t_ms long, seq long, player string, kind string").withColumn("on", F.expr("kind = 'spawn'"))
    want = temporal.flips(plain, "on", F.lit(None).cast("long")).filter("end_ms is not null")
    assert got.count() > 20
    assert {(r.player, r.a, r.b) for r in got.select("player", F.unix_millis("start").alias("a"), F.unix_millis("end").alias("b")).collect()} == {(r.player, r.start_ms, r.end_ms) for r in want.collect()}
    names = [(1, T0 + t, t, 3, n) for t, n in [(0, "a"), (10, "a"), (20, "b"), (30, None), (40, "b"), (50, "c")]] + [(1, T0 + 5, 5, 4, "z")]
    batches = _shuffled(names, lambda t: (9, T0 + t, t, 0, "end"), rnd)
    held = _run(spark, M.spans(_feed(spark, str(tmp_path / "h"), batches, "match_id long, ts timestamp, seq long, slot long, v string"), "slot", "5 seconds"), "slots")
    assert sorted((r.slot, r.v, r.a - T0, r.b - T0) for r in held.select("slot", "v", F.unix_millis("start").alias("a"), F.unix_millis("end").alias("b")).collect()) == [(3, "a", 0, 20), (3, "b", 20, 30), (3, "b", 40, 50)]


def test_attribution_as_in_batches(spark, tmp_path):
    """All layers, evidence used up and expired: shuffled batches decide what one batch decides."""
    rnd, rows, seq = random.Random(21), [], iter(range(1, 100_000))
    kinds = {1: "ra", 2: "ra", 3: "h25", 4: "rl"}
    row = lambda t, kind, ent=None, item=None, player=None, taken=None, x=0.0: (1, T0 + t, next(seq), kind, ent, item, player, taken, x, 0.0, 0.0)
    for t in range(0, 120_000, 900):
        ent, player = rnd.randint(1, 4), f"p{rnd.randint(0, 2)}"
        near = t + rnd.randint(-240, 240)
        rows.append(row(t, "state", ent, kinds[ent], None, rnd.random() < 0.6, 10.0 * ent))
        for _ in range(rnd.randint(0, 3)):
            rows.append(row(rnd.choice([near, t + rnd.randint(-90, 490)]), rnd.choice(["print", "stat", "stat"]), None, kinds[ent], f"p{rnd.randint(0, 2)}"))
        if rnd.random() < 0.25:
            rows.append(row(near, "hint", ent, None, player))
        rows += [row(t - rnd.randint(0, 400), "position", None, None, f"p{p}", None, rnd.choice([0.0, 100.0, 400.0])) for p in range(3)]
    rows.sort(key=lambda r: (r[1], r[2]))
    schema = "match_id long, ts timestamp, seq long, kind string, ent long, item string, player string, taken boolean, x double, y double, z double"
    batches = _shuffled(rows, lambda t: (9, T0 + t, next(seq), "position", None, None, "z", None, 0.0, 0.0, 0.0), rnd)
    got = _run(spark, M.attribute(_feed(spark, str(tmp_path / "i"), batches, schema), "5 seconds"), "takers")
    plain = spark.createDataFrame([(r[0], r[1] - T0 + 1_000_000, *r[2:]) for r in rows], schema.replace("ts timestamp", "t_ms int")).withColumnRenamed("kind", "of")
    of = lambda k, *c: plain.filter(F.col("of") == k).select("match_id", "t_ms", "seq", *c)
    item = F.col("item").alias("kind")
    matches = spark.createDataFrame([(1, 9_000_000)], "match_id long, match_end_ms int")
    want = A.attribute(of("state", "ent", item, "taken", "x", "y", "z"), of("hint", "ent", "player"), of("print", item, "player"), of("stat", item, "player"), of("position", "player", "x", "y", "z"), matches)
    want = sorted((r.seq, r.player or "", r.source) for r in want.collect())
    assert {s for _, _, s in want} == {"hint", "print", "stat", "distance", "none"}
    assert sorted((r.seq, r.player or "", r.source) for r in got.collect()) == want


def test_late_rows_are_counted(spark, tmp_path):
    row = lambda p, t, s: (1, p, T0 + t, s, float(s))
    # what is late is told by the watermark of the batch before
    batches = [[row("a", 0, 1)], [row("a", 60_000, 2)], [row("b", 60_500, 9)], [row("a", 1000, 3), row("b", 2000, 4), row("a", 61_000, 5)], [row("z", 200_000, 6)], [row("z", 400_000, 7)]]
    stream = _feed(spark, str(tmp_path / "j"), batches, "match_id long, player string, ts timestamp, seq long, v double")
    late = M.LateRows()
    spark.streams.addListener(late)
    try:
        got = {r.seq for r in _run(spark, M.changes(stream, "5 seconds"), "late").collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        for _ in range(50):
            if late.dropped.get("late"):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(late)
    assert got == {1, 2, 5, 6, 9} and late.dropped == {"late": 2}


def test_changes_and_windows(spark, sf, tmp_path):
    path = str(tmp_path / "in")
    rows = _split(spark, sf, path)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    w = "row_number() over (partition by match_id, player order by ts, seq)"
    later = rows.agg(F.max("ts")).first()[0]
    spark.createDataFrame([(-1, "end", 0)], "match_id long, player string, seq long").select("match_id", "player", (F.lit(later) + F.expr("interval 90 days")).alias("ts"), "seq", F.lit(0.0).alias("v"), F.lit("x").alias("message"), F.lit("chat").alias("type")).coalesce(1).write.mode("append").parquet(path)
    got = {(r.player, r.seq) for r in _run(spark, M.changes(stream(), "60 days", "900 days"), "changes").collect() if r.player != "end"}
    want = rows.withColumn("n", F.expr(w)).withColumn("was", F.expr("lag(v) over (partition by match_id, player order by ts, seq)")).filter("n = 1 or v <> was")
    assert got == {(r.player, r.seq) for r in want.collect()}
    windows = _run(spark, M.tumbling(stream(), "1 day", "30 days"), "windows", "complete")
    assert windows.agg(F.sum("n")).first()[0] == rows.count() + 1
    assert _run(spark, M.sessions(stream(), "1 day", "30 days"), "sess", "complete").agg(F.sum("n")).first()[0] == rows.count() + 1
    assert _run(spark, M.distinct_chat(stream(), "60 days"), "chat").count() == rows.select("match_id", "player", "ts").distinct().count() + 1


def test_gate_and_join(spark, tmp_path):
    path = str(tmp_path / "m")
    lines = ["hello", "The match has begun!", "shot", "the match is over", "bye"]
    late = str(tmp_path / "late")
    spark.createDataFrame([(1, i, t, 7, f"p{i}") for i, t in enumerate(lines)], "match_id long, seq long, message string, ent int, player string").withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_000_000_000)).write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = lambda: spark.readStream.schema(schema).parquet(path)
    spark.read.parquet(path).coalesce(1).write.parquet(f"{late}/0")
    spark.read.parquet(path).filter("seq = 4").withColumns({"match_id": F.lit(2).cast("long"), "ts": F.col("ts") + F.expr("interval 1 hour")}).coalesce(1).write.parquet(f"{late}/1")
    gated = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(late)
    assert [r.seq for r in _run(spark, M.gate(gated), "gated").orderBy("seq").collect()] == [1, 2, 3]
    pairs = _run(spark, M.drops_to_pickups(stream(), stream(), "1 second"), "pairs")
    assert pairs.count() == 9
