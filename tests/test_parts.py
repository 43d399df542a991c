"""Hand cases for files, text functions and folds."""

from pyspark.sql import functions as F

from arenalake.functions import fields, temporal
from arenalake.functions import text as X
from arenalake.operators import buckets as B
from arenalake.operators import identity as I
from arenalake.operators import kills as K
from arenalake.operators import pickups as U
from arenalake.operators import points as P
from arenalake.operators import spatial as S
from arenalake.plans import texts
from arenalake.sources import files


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first().x


def test_obituaries(spark):
    o = lambda t: (lambda r: r and (r.killer, r.victim, r.weapon, r.is_suicide, r.is_team_kill))(_one(spark, X.obituary, t))
    assert o("bob rides alice's quad rocket") == ("alice", "bob", "rl", False, False)
    assert o("bob discovers blast radius") == ("bob", "bob", "suicide", True, False)
    assert o("bob ate 2 loads of .N3.'s buckshot") == (".N3.", "bob", "ssg", False, False)
    assert o("alice rips bob a new one") == ("alice", "bob", "rl", False, False)
    assert o("bob was blown to chunks by alice's grenade") == ("alice", "bob", "gl", False, False)
    assert o("bob checks his glasses") == ("bob", "teammate", "teamkill", False, True)
    assert o("Satan's power deflects bob's telefrag") == ("bob", "bob", "tele", True, False)
    assert o("hello there") is None and o(" suicides") is None
    v = lambda t: _one(spark, X.victim, t)
    assert (v("bob rides alice's rocket"), v("bob was telefragged by his teammate"), v("bob ate 2 loads of al's buckshot"), v("al rips bob a new one"), v("bob suicides"), v("hi")) == ("bob", "bob", "bob", "bob", "bob", None)
    f = lambda t: (lambda r: r and tuple(r))(_one(spark, X.feed, t))
    assert f("bob checks his glasses") == ("bob", "teammate", "teamkill") and f("bob rides alice's rocket") == ("alice", "bob", "rl") and f("hi") is None
    assert _one(spark, X.killer_name, "3 rockets from alice") == "alice" and _one(spark, X.killer_name, "Cas' fall") == "Cas"


def test_text(spark):
    assert _one(spark, X.normalize, "\x12\x13\x10a\x11\x8d\x80\x1c") == "01[a]<(."
    assert _one(spark, X.strip_markup, "\r &cf00red&r {a} [b]\n x !Z") == "red a b x"
    assert _one(spark, X.normalize_name, "Ab-C.9é") == "abc9"
    assert _one(spark, X.key_values, "\\a\\1\\b\\2\\a\\3") == {"a": "3", "b": "2"}
    assert _one(spark, X.settings, "Countdown: 3\nDeathmatch  4\nRespawns  KT 2\n") == {"Deathmatch": "4", "Respawns": "KT 2"}
    assert _one(spark, lambda c: X.pickup_kind(c), "You got the Red Armor\n") == "ra" and _one(spark, lambda c: X.pickup_kind(c), "You receive 25 health") == "h25"
    assert tuple(_one(spark, lambda c: X.directive(c, "//drop ", ("ent", "flags")), "//drop 5 32\n")) == (5, 32)
    assert _one(spark, lambda c: X.item_kind(c, F.lit(1)), "progs/armor.mdl") == "ya"
    assert _one(spark, X.loc_name, "$R upper  ra$loc_name_separatorlow $5") == "upper ra.low 5"


def test_fields():
    assert fields.check_fields(["rl", "h"]) == ["h", "rl"] and fields.reducer_for("sp") == "any" and fields.reducer_for("h", {"h": ""}) == "last"
    for bad in (lambda: fields.check_fields(["zz"]), lambda: fields.reducer_for("h", {"h": "zz"})):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError


def test_bucket_fixture(spark):
    m = spark.createDataFrame([(1, 0, 10000)], "match_id int, match_start_ms int, match_end_ms int")
    p = spark.createDataFrame([(1, "p")], "match_id int, player string")
    h = spark.createDataFrame([(1, "p", i, t, v) for i, (t, v) in enumerate([(0, 100), (300, 60), (1200, 30), (2000, 100)])], "match_id int, player string, seq long, t_ms int, v int")
    cells = B.cells(temporal.grid(m, 1000), p)
    got = B.table(cells, {"h": (h, "number", "first")}).orderBy("bucket").collect()
    assert [r.h for r in got][:4] == [100, 60, 100, 100] and len(got) == 10
    assert [temporal.grid(m.withColumn("match_end_ms", F.lit(e)), w).count() for e, w in ((10000, 3000), (250, 50), (1000, 1000))] == [4, 5, 1]


def test_guarded_deltas(spark):
    rows = [(1, 0, i * 10, i, w, f) for i, (w, f) in enumerate([("a", 3), ("a", 4), ("a", 99), ("a", 6), ("b", 50), ("b", 49)])]
    d = spark.createDataFrame(rows, "match_id int, slot int, t_ms int, seq long, occupant string, frags int")
    assert [(r.t_ms, r.delta) for r in K.guarded_deltas(d).orderBy("t_ms").collect()] == [(10, 1), (30, 2), (50, -1)]


def test_identity(spark):
    info = [(1, 7, 5, 0, 8, "rusti", "r", ""), (1, 2, 609, 1, 14, "rusti", "r", ""), (1, 7, 766, 2, 15, "Luk", "b", "")]
    u = I.unify(I.sessions(spark.createDataFrame(info, "match_id int, slot int, t_ms int, seq long, user_id int, name string, team string, auth string")))
    key = {(r.slot, r.name): r.identity for r in u.collect()}
    assert key[7, "rusti"] == key[2, "rusti"] != key[7, "Luk"]


def test_identity_follows_chains(spark):
    info = [(1, s, 10 * s, s, s + 1, f"n{s}", "r", "") for s in range(16)]
    found = I.sessions(spark.createDataFrame(info, "match_id int, slot int, t_ms int, seq long, user_id int, name string, team string, auth string"))
    links = spark.createDataFrame([(1, s, 0, f"k{k}") for s in range(16) for k in (s // 2, (s + 1) // 2 + 100)], "match_id int, slot int, session long, key string")
    assert {r.identity for r in I.unify(found, links).collect()} == {"000:00000"}


def test_maps_do_not_mix(spark):
    locs = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 2, 30_000.0, 0.0, 0.0), ("b", 3, 9.0, 0.0, 0.0), ("b", 4, 3000.0, 10.0, 0.0)], "map string, loc_id int, x float, y float, z float")
    at = spark.createDataFrame([("a", 10, 0, 0), ("a", 16_000, 0, 0), ("a", 90_000, 5, 0), ("b", 1600, 0, 0), ("b", 0, 0, 0)], "map string, x int, y int, z int")
    assert {(r.map, r.x): r.li for r in S.locate(at, locs).collect()} == {("a", 10): 1, ("a", 16_000): 2, ("a", 90_000): 2, ("b", 1600): 4, ("b", 0): 0}


def test_trail_and_regions(spark):
    rows = [(1, "p", t, t, x, 5, d, False) for t, (x, d) in enumerate([(10, False), (12, False), (40, False), (41, True), (5000, False), (0, False)])]
    rows[-1] = (1, "p", 5, 5, 0, 0, False, False)
    got = P.movement_trail(spark.createDataFrame(rows, "match_id int, player string, t_ms int, seq long, x int, y int, death boolean, spawn boolean"), 5.0, 1000.0)
    assert [(r.x, r.teleport) for r in got.orderBy("t_ms").collect()] == [(10, False), (40, False), (41, False), (5000, True)]
    named = spark.createDataFrame([("m", 1, 0.0, 0.0, "RA low"), ("m", 2, 500.0, 0.0, "ra.low"), ("m", 3, 1100.0, 0.0, "ra high"), ("m", 4, 9000.0, 0.0, "quad"), ("m", 5, 0.0, 9.0, "YA"), ("n", 6, 0.0, 0.0, "ya top")], "map string, loc_id int, x double, y double, name string")
    assert {(r.loc_id, r.region) for r in S.detect_regions(named).collect()} == {(1, "RA LOW"), (2, "RA LOW"), (3, "RA LOW"), (4, "QUAD"), (6, "YA TOP")}


def test_weapon_pickup(spark):
    p = spark.createDataFrame([(1, "ace", 1, "rl", 10000)], "match_id int, player string, pickup_id int, weapon string, t_ms int")
    d = spark.createDataFrame([(1, "ace", 30000, 0)], "match_id int, player string, t_ms int, seq long")
    f = spark.createDataFrame([(1, "ace", w, t, i, False, False) for i, (w, t) in enumerate([("rl", 12000), ("axe", 15000), ("rl", 20000), ("rl", 40000)])], "match_id int, killer string, weapon string, t_ms int, seq long, is_suicide boolean, is_team_kill boolean")
    r = U.effect(U.next_death(p, d), f).first()
    assert (r.kills, r.next_death_ms) == (2, 30000)


def test_files(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "m1.jsonl").write_text('{"kind":"print","time":1.5,"data":{"a":"b"}}\nbroken\n{"time":2}\n')
    rows = files.read_events(spark, str(tmp_path / "e")).cache()
    good, bad = files.split_bad(rows)
    assert [(r.match_id, r.t_ms) for r in good.collect()] == [("m1", 1500)] and sorted(r.reason for r in bad.collect()) == ["no kind", "unreadable"]
    (tmp_path / "dm6.loc").write_text("// c\n80 160 -8 low ra\nx y z bad\n8 8 8 rl\n")
    points = files.read_points(spark, str(tmp_path / "dm6.loc"))
    assert [tuple(r) for r in points.orderBy("loc_id").collect()] == [("dm6", 0, 10.0, 20.0, -1.0, "low RA"), ("dm6", 1, 1.0, 1.0, 1.0, "RL")]
    (tmp_path / "dm6.json").write_text('{"regions":[{"name":"A","locs":["low ra","rl"]},{"name":"B","locs":["RL"]}]}')
    regions = files.read_regions(spark, str(tmp_path / "dm6.json"))
    assert {(r.loc_id, r.region) for r in files.loc_regions(points, regions).collect()} == {(0, "A"), (1, "B")}
    blocks = spark.createDataFrame([("m", 0, "2}"), ("m", 1, '{"a":'), ("n", 1, "{")], "match_id string, num int, content string")
    assert {r.match_id: r.board and r.board.a for r in files.join_blocks(blocks, "a int").collect()} == {"m": 2, "n": None}


def test_message_bounds_reads_whole_messages(spark, tmp_path):
    rows = [(1, 1, "user", "hello"), (1, 2, "user", "now the match is over"), (1, 3, "user", "bye"), (2, 2, "user", "The match has begun!")]
    spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {tuple(r) for r in texts.message_bounds(spark, str(tmp_path)).select("match_id", "start_ms", "end_ms").collect()} == {(1, 1000, 2000), (2, 2000, None)}
