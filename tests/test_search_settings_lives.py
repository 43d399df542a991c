"""Own reducers, full-text search, typed settings, and deaths and spawns from three signals."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from arenalake.functions import fields, temporal
from arenalake.functions import text as X
from arenalake.operators import buckets as B
from arenalake.operators import identity as I
from arenalake.operators import scoreboard as S


def test_own_reducers(spark):
    fields.register_reducer("ends", lambda s: F.concat_ws(">", F.element_at(s, 1).cast("string"), F.element_at(s, -1).cast("string")), empty="-")

    def spread(v: pd.Series) -> float:
        return v.max() - v.min()

    fields.register_reducer("spread", lambda v: F.pandas_udf(spread, DoubleType())(v.cast("double")), grouped=True, empty=-1.0)
    m = spark.createDataFrame([(1, 0, 3000)], "match_id int, match_start_ms int, match_end_ms int")
    p = spark.createDataFrame([(1, "p"), (1, "q")], "match_id int, player string")
    rows = [(1, "p", i, t, v) for i, (t, v) in enumerate([(0, 100), (300, 60), (1200, 30), (1300, 90)])] + [(1, "q", 9, 1500, 5)]
    h = spark.createDataFrame(rows, "match_id int, player string, seq long, t_ms int, v int")
    cells = B.cells(temporal.grid(m, 1000), p)
    got = {(r.player, r.bucket): (r.a, r.b, r.c) for r in B.table(cells, {"a": (h, "number", "ends"), "b": (h, "number", "spread"), "c": (h, "number", None)}).collect()}
    assert got == {("p", 0): ("100>60", 40.0, 100), ("p", 1): ("60>90", 60.0, 60), ("p", 2): ("90>90", 0.0, 90), ("q", 0): ("-", -1.0, None), ("q", 1): ("5>5", 0.0, 5), ("q", 2): ("5>5", 0.0, 5)}
    assert fields.reducer_for("h", {"h": "ends"}) == "ends"
    with pytest.raises(ValueError, match="reserved"):
        fields.register_reducer("first", lambda s: s)
    with pytest.raises(ValueError, match="unknown reducer"):
        B.table(cells, {"a": (h, "number", "nope")})


def test_search(spark):
    rows = [(1, "2024-01-01", "dm6", "4on4", "qwdl_s1", ["[abc] Éva", "mr.x"], ["abc", "x"]), (2, "2024-01-02", "dm3", "1on1", "100%", ["eva", "X-ray"], ["", "abc"]), (3, "2024-01-02", "dm6", "4on4", None, ["Evangeline x"], []), (4, "2024-01-01", "dm6", "4on4", "QWDL", None, None)]
    games = spark.createDataFrame(rows, "id int, day string, map string, mode string, matchtag string, players array<string>, teams array<string>").withColumn("day", F.col("day").cast("date"))
    ids = lambda **k: [r.id for r in S.search(games, **k).collect()]
    assert ids() == [2, 3, 1, 4] and ids(players=["", "  "]) == [2, 3, 1, 4]
    assert ids(players=["éva"]) == [1] and ids(players=["EVA x"]) == [] and ids(players=["x", "ray"]) == [2] and ids(players=["mr", "abc-éva"]) == [1]
    assert ids(players=["ev"]) == []  # words, not parts of them
    assert ids(teams=["abc"]) == [2, 1] and ids(teams=["abc", "x"]) == [1] and ids(teams=["ABC"]) == []
    assert ids(tag="qwdl") == [1, 4] and ids(tag="0%") == [2] and ids(tag="l_s") == [1]
    assert ids(since="2024-01-02", until="2024-01-02") == [2, 3] and ids(limit=1, offset=1) == [3] and ids(limit=-1, map_name="dm6") == [3, 1, 4]


def test_search_reads_its_words_only(spark, tmp_path):
    games = spark.range(2000).select("id", F.current_date().alias("day"), F.array(F.concat(F.lit("name"), F.col("id").cast("string"))).alias("players"))
    S.token_index(games).repartitionByRange(4, "token").sortWithinPartitions("token").write.parquet(str(tmp_path / "t"))
    hit = S.with_tokens(spark.read.parquet(str(tmp_path / "t")), ["name77"])
    assert [r.id for r in hit.collect()] == [77]
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,name77)]" in hit._jdf.queryExecution().toString()


def test_typed_settings(spark):
    text = "Countdown:  3\n\n  Mode      T e a m\nRespawns \t KT 2\nTimelimit   20\nFraglimit  \nDeathmatch abc\nMidair On\nAirstep off\nVWep   TRUE\nNoweapon  rl   lg\nno matchtag\nOther 5\nTimelimit 10\n"
    rows = spark.createDataFrame([(text,), ("Countdown: 3\nOther 5",), ("",), (None,), ("Respawns odd",)], "t string").select(X.typed_settings(F.col("t")).alias("s")).collect()
    s = rows[0].s
    assert (s.mode, s.respawns, s.spawn_k, s.timelimit, s.fraglimit, s.deathmatch, s.midair, s.airstep, s.vwep, s.noweapon) == ("Team", "KT2", 4, 10, 0, 0, True, False, True, "rl lg")
    assert s.matchtag is None and s.antilag is None and s.instagib is None
    assert [r.s for r in rows[1:4]] == [None] * 3 and (rows[4].s.respawns, rows[4].s.spawn_k) == ("odd", None)


def test_lifecycle(spark):
    seq = iter(range(1, 1000))
    of = lambda rows, more: spark.createDataFrame([(1, s, t, n, *x) for s, t, n, *x in rows], "match_id int, slot int, t_ms int, seq long" + more)
    events = [  # (slot, t, signal, value) in order
        (0, 10, "flag", True), (0, 20, "flag", False), (0, 30, "health", 100), (0, 40, "health", -5), (0, 41, "flag", True), (0, 50, "flag", False), (0, 55, "health", 90),
        (1, 10, "flag", False), (1, 15, "health", 100), (1, 90, "text", None), (1, 100, "text", None), (1, 101, "text", None), (1, 110, "flag", False), (1, 111, "flag", True),
        (2, 5, "health", 0), (2, 6, "health", 50), (2, 7, "flag", True), (2, 8, "flag", False), (3, 9, "flag", True), (3, 10, "health", 30),
    ]
    by = {k: [] for k in ("flag", "health", "text")}
    for slot, t, k, v in events:
        by[k].append((slot, t, next(seq), *([] if k == "text" else [v])))
    starts = spark.createDataFrame([(1, 100, 0)], "match_id int, start_ms int, start_seq int")
    got = [(r.slot, r.t_ms, r.event, r.signal) for r in I.lifecycle(of(by["health"], ", health int"), of(by["flag"], ", dead boolean"), of(by["text"], ""), starts).orderBy("slot", "seq").collect()]
    assert got == [
        (0, 20, "spawn", "flag"), (0, 40, "death", "health"), (0, 50, "spawn", "flag"),
        (1, 10, "spawn", "flag"), (1, 100, "death", "text"), (1, 101, "death", "text"), (1, 110, "spawn", "flag"), (1, 111, "death", "flag"),
        (2, 6, "spawn", "health"), (2, 8, "spawn", "flag"), (3, 10, "spawn", "health"),
    ]
