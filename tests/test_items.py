"""Layers of evidence, pickups that no state shows, and the band join below them."""

import random

import pytest

from arenalake.functions.temporal import band
from arenalake.operators import attribution as A

SEQ = iter(range(1, 1_000_000))


@pytest.fixture
def play(spark):
    """Runs a match: states (ent, kind, t, taken), hints (ent, t, player), prints and stats (kind, t, player), positions (player, t, x)."""

    def run(states, hints=(), prints=(), stats=(), positions=(), synthetic=True, end=10_000_000):
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        s = frame([(1, e, k, 0.0, 0.0, 0.0, t, next(SEQ), taken) for e, k, t, taken in states], "match_id int, ent int, kind string, x double, y double, z double, t_ms int, seq long, taken boolean")
        h = frame([(1, e, t, next(SEQ), p) for e, t, p in hints], "match_id int, ent int, t_ms int, seq long, player string")
        of = lambda rows: frame([(1, k, t, next(SEQ), p) for k, t, p in rows], "match_id int, kind string, t_ms int, seq long, player string")
        at = frame([(1, p, t, next(SEQ), x, 0, 0) for p, t, x in positions], "match_id int, player string, t_ms int, seq long, x int, y int, z int")
        m = frame([(1, end)], "match_id int, match_end_ms int")
        rows = A.resynth(s, h, of(prints), of(stats), at, m, synthetic).collect()
        return sorted((r.t_ms, r.ent, r.chain, r.player, r.source) for r in rows)

    return run


def test_layers_in_order(play):
    states = [(5, "ra", 100, True), (5, "ra", 30_000, False), (5, "ra", 30_100, True), (6, "ra", 200, True), (7, "rl", 9000, True), (8, "mh", 20_000, True), (9, "ga", 50_000, True)]
    hints = [(5, 90, "a"), (5, 30_100, "b")]
    prints = [("ra", 120, "c"), ("ra", 130, "c")]
    stats = [("rl", 9100, "d"), ("rl", 9200, "e")]
    positions = [("a", 8990, 1), ("e", 8990, 99), ("d", 8990, 120), ("b", 19_990, 900), ("f", 49_749, 1), ("g", 49_900, 100), ("g", 49_990, 300)]
    want = [(100, 5, 0, "a", "hint"), (200, 6, 0, "c", "print"), (9000, 7, 0, "e", "distance"), (20_000, 8, 0, None, "none"), (30_100, 5, 0, "b", "hint"), (50_000, 9, 0, None, "none")]
    assert play(states, hints, prints, stats, positions, synthetic=False) == want
    assert play(states, hints, prints, stats, positions) == want


def test_evidence_serves_once(play):
    """Two boxes at once: the second piece of evidence of the gainer takes the second box, not the bystander on it."""
    states = [(1, "h25", 10_000, True), (2, "h25", 10_000, True), (3, "h25", 10_000, True)]
    stats = [("h25", 9990, "gainer"), ("h25", 9990, "gainer")]
    positions = [("by", 9990, 0), ("gainer", 9990, 100)]
    assert [r[3:] for r in play(states, stats=stats, positions=positions)] == [("gainer", "stat"), ("gainer", "stat"), ("by", "distance")]


@pytest.mark.parametrize("n", [1, 2, 60, 61])
def test_chains(play, n):
    """A pickup predicts the next for as long as one player has evidence at the place, 60 times at most."""
    states = [(4, "ra", 1000, True)]
    stats = [("ra", 1000 + 20_000 * i + 300, "p") for i in range(1, n + 1)]
    positions = [("p", 1000 + 20_000 * i + 100, 50) for i in range(1, n + 1)]
    got = play(states, [(4, 990, "q")], stats=stats, positions=positions)
    assert got == [(1000, 4, 0, "q", "hint")] + [(1000 + 20_000 * i, 4, i, "p", "synthetic") for i in range(1, min(n, 60) + 1)]


def test_chains_end(play):
    stats = [("ra", t, "p") for t in (20_100, 60_100, 80_100)] + [("ra", 80_200, "q")]
    positions = [(p, t, 0) for t in (20_000, 40_000, 60_000, 80_000) for p in "pq"]
    took = [(1, "ra", 0, True)]
    assert [r[2] for r in play(took, stats=stats, positions=positions)] == [0, 1]  # nobody at 40,000, so nothing is asked at 60,000
    assert [r[2] for r in play(took, stats=[*stats, ("ra", 40_100, "p")], positions=positions)] == [0, 1, 2, 3]  # two candidates at 80,000
    back = [*took, (1, "ra", 20_400, False)]
    assert [r[2] for r in play(back, stats=stats, positions=positions)] == [0]  # the item is seen to be back before it settles
    assert [r[2] for r in play(took, stats=stats, positions=positions, end=20_499)] == [0]
    far = [(p, t, 300) for p, t, _ in positions]
    assert [r[2] for r in play(took, stats=stats, positions=far)] == [0]
    assert [r[2] for r in play([(1, "mh", 0, True)], stats=[("mh", 20_100, "p")], positions=positions)] == [0]


def test_hint_while_gone(play):
    """The server names a taker though the item is still gone: a pickup of its own, from which the next is expected."""
    states = [(1, "ra", 1000, True), (1, "ra", 60_000, False), (1, "ra", 61_000, True)]
    hints = [(1, 21_010, "b"), (1, 60_900, "c")]
    stats = [("ra", 41_200, "d")]
    positions = [("d", 41_000, 10)]
    got = play(states, hints, stats=stats, positions=positions)
    assert got == [(1000, 1, 0, None, "none"), (21_010, 1, 0, "b", "hint"), (41_010, 1, 1, "d", "synthetic"), (61_000, 1, 0, "c", "hint")]
    assert [r[3:] for r in play(states, hints, stats=stats, positions=positions, synthetic=False)] == [(None, "none"), ("c", "hint")]


def test_synthetic_uses_up_evidence(play):
    """Two items come back at once; one piece of evidence makes one pickup."""
    states = [(1, "ra", 1000, True), (2, "ra", 1000, True)]
    got = play(states, stats=[("ra", 21_100, "p")], positions=[("p", 21_000, 10)])
    assert [r for r in got if r[4] == "synthetic"] == [(21_000, 1, 1, "p", "synthetic")]


@pytest.mark.parametrize(("low", "high"), [(-250, 250), (-100, 500), (0, 0), (-7, -3), (5, 1000)])
def test_band(spark, low, high):
    rnd = random.Random(low)
    probes = [(rnd.randint(0, 2), rnd.randint(-3000, 3000), i) for i in range(150)]
    events = [(rnd.randint(0, 2), rnd.randint(-3000, 3000), i) for i in range(150)] + [(0, probes[0][1], 999)]
    found = band(spark.createDataFrame(probes, "k int, t_ms int, p int"), spark.createDataFrame(events, "k int, e_ms int, e int"), ["k"], low, high)
    want = sorted((p[2], e[2]) for p in probes for e in events if p[0] == e[0] and low <= e[1] - p[1] <= high)
    assert sorted((r.p, r.e) for r in found.collect()) == want
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
