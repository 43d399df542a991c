"""Nearest points against brute force, and what is nearest where little can be seen."""

import numpy as np
import pytest

from arenalake.operators import spatial as S


def brute(place, points):
    d = lambda p: sum((np.float32(a) - np.float32(b)) ** 2 for a, b in zip(place, p[1:], strict=True))
    return min(points, key=lambda p: (d(p), p[0]))[0]


@pytest.fixture(scope="module")
def world(spark):
    """Points on lines, some of them twice, one far from the others; places near, far above and far outside."""
    rng = np.random.default_rng(5)
    points = [(i, float(rng.integers(0, 3000)), float(rng.integers(0, 8) * 160), 0.0) for i in range(1, 200)]
    points += [(i + 300, *points[i][1:]) for i in range(40)] + [(900, 90_000.0, 0.0, 50.0)]
    places = [(int(x), int(y), int(z)) for x, y, z in zip(rng.integers(-500, 4000, 300), rng.integers(-500, 2000, 300), rng.integers(0, 9, 300) * 64, strict=True)]
    places += [(0, 0, 0), (1_000_000, 3, 4), (60_000, -9, 2000), places[0]]
    locs = spark.createDataFrame([("a", *p) for p in points], "map string, loc_id int, x float, y float, z float")
    rows = spark.createDataFrame([("a", i, i % 3, *p) for i, p in enumerate(places)] + [("none", 1000, 0, 1, 1, 1), ("a", 1001, 0, None, 1, 1)], "map string, seq int, leaf_id int, x int, y int, z int")
    return points, places, locs, rows


def test_nearest_is_brute_force(spark, world):
    points, places, locs, rows = world
    want = {i: 0 if p == (0, 0, 0) else brute(p, points) for i, p in enumerate(places)}
    assert sorted((r.seq, r.li) for r in S.locate(rows, locs).collect()) == sorted(want.items())


def test_leaves_see_their_points(spark, world):
    """Leaf 0 sees even points, leaf 1 a single one, leaf 2 and an unknown leaf none: they get what ``locate`` gives."""
    points, places, locs, rows = world
    visible = locs.filter("loc_id % 2 = 0").selectExpr("map", "0 AS leaf_id", "loc_id").unionByName(spark.createDataFrame([("a", 1, 900)], "map string, leaf_id int, loc_id int"))
    unknown = rows.filter("seq < 2 and map = 'a'").selectExpr("map", "seq + 5000 AS seq", "cast(null AS int) AS leaf_id", "x", "y", "z")
    origin = spark.createDataFrame([("a", 6000, 2, 0, 0, 0)], rows.schema)
    got = {r.seq: r.li for r in S.visible_nearest(rows.unionByName(unknown).unionByName(origin), locs, visible).collect()}
    seen = [[p for p in points if p[0] % 2 == 0], [p for p in points if p[0] == 900], points]
    want = {i: 0 if p == (0, 0, 0) and i % 3 == 2 else brute(p, seen[i % 3]) for i, p in enumerate(places)}
    want |= {5000 + i: brute(places[i], points) for i in range(2)} | {6000: 0}
    assert got == want


def test_a_row_is_settled_once_a_search(spark, world, monkeypatch):
    """Rows meet lists of points, not points: no search settles more rows than were asked."""
    sizes = []
    monkeypatch.setattr(S, "settled", lambda df, real=S.settled: sizes.append((out := real(df)).count()) or out)
    S.locate(world[3], world[2]).count()
    assert max(sizes[2:]) <= 304 and sizes[0] <= 200  # equal points are one


def test_names_are_of_points_in_use(spark, monkeypatch):
    """loc_names' table is no larger than its rows, however many matches share a map."""
    from arenalake.operators import filters as V
    from arenalake.plans import views

    seen = {}
    monkeypatch.setattr(V, "loc_names", lambda rows, table, real=V.loc_names: seen.update(rows=rows.count(), table=table.count()) or real(rows, table))
    assert views.loc_names(spark, "/root/testdata/sf0.1").count() == seen["rows"] >= seen["table"] > 0


def single_linkage(points, reach):
    """The smallest id of each id's cluster, all places compared with all; differences are of single precision."""
    top, xy = {i: i for i, _, _ in points}, [(None if None in p[1:] else np.float32(p[1:])) for p in points]
    links = [(p[0], q[0]) for i, p in enumerate(points) for j, q in enumerate(points) if p[0] != q[0] and xy[i] is not None and xy[j] is not None and float(np.sum(np.float64(xy[i] - xy[j]) ** 2)) < reach * reach]
    while lower := {b: top[a] for a, b in sorted(links, key=lambda e: -top[e[0]]) if top[a] < top[b]}:
        top |= lower
    return top


@pytest.mark.filterwarnings("ignore:invalid value")
@pytest.mark.parametrize("few", [1, S.FEW])
def test_clusters_are_brute_force(spark, monkeypatch, few):
    """A crowd, chains, distances of exactly the reach, equal places, far places, places on borders of cells, one id at two places, places that are none."""
    monkeypatch.setattr(S, "FEW", few)
    rng = np.random.default_rng(11)
    spots = [*rng.uniform(0, 1500, (60, 2)), *rng.uniform(-20_000, 9000, (120, 2)), *(rng.integers(0, 40, (60, 2)) * 300 + [50_000, -3000])]
    spots += [(90_000 + i * 899.5, i % 2) for i in range(12)] + [(120_000 + i * 900, 0) for i in range(6)] + [spots[0], spots[70]]
    spots += [(-40_000, 0), (-40_000 + 636.3, 636.3), (-40_000, 5000), (-40_000 + 636.5, 5636.5), (3e30, 5), (3e30, 800), (2e30, 5), (1e-40, 70_000), (2e-40, 70_899)]
    spots += [(630 * (2 * k + 400.5) + x, 40_000 + y) for k in range(0, 80, 10) for x, y in ((0, 0), (-183, -320), (603, 320))]
    spots += [(None, 3), (float("nan"), 3), (float("nan"), 3), (float("inf"), 3), (float("inf"), 3)]
    ids = rng.permutation(len(spots)) + 1
    points = [(int(i), *[None if v is None else float(v) for v in xy]) for i, xy in zip(ids, spots, strict=True)] + [(int(ids[0]), 90_000.0, 5.0), (int(ids[0]), None, 5.0)]
    rows = spark.createDataFrame([("a", *p) for p in points] + [("b", 1, 0.0, 0.0), ("b", 2, 900.0, 0.0)], "map string, loc_id int, x float, y float")
    got = S.clusters(rows, 900.0).collect()
    assert len(got) == len(ids) + 2
    assert {r.loc_id: r.cluster for r in got if r.map == "a"} == single_linkage(points, 900.0)
    assert {(r.loc_id, r.cluster) for r in got if r.map == "b"} == {(1, 1), (2, 2)}


def test_crowds_do_not_meet_in_pairs(spark, monkeypatch):
    """3,000 places within reach of most others: nothing larger than them is settled."""
    sizes = []
    monkeypatch.setattr(S, "settled", lambda df, real=S.settled: sizes.append((out := real(df)).count()) or out)
    rows = spark.range(3000).selectExpr("'a' AS map", "cast(id as int) AS loc_id", "cast(rand(5) * 2000 as float) AS x", "cast(rand(6) * 1000 as float) AS y")
    found = S.clusters(rows, 900.0)
    assert found.count() == 3000 and found.select("cluster").distinct().count() == 1
    assert max(sizes) <= 3000


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain whose ids are in no order: labels cross it in rounds by the logarithm of its length."""
    from arenalake.functions import graph

    rounds = []
    monkeypatch.setattr(graph, "settled", lambda df, real=graph.settled: rounds.append(1) or real(df))
    ids = [int(i) for i in np.random.default_rng(3).permutation(300)]
    links = [("a", *p) for a, b in zip(ids, ids[1:], strict=False) for p in ((a, b), (b, a))] + [("b", 7, 9), ("b", 9, 7), ("b", 5, 5)]
    got = graph.components(spark.createDataFrame(links, "map string, a int, b int"), ["map"], "a", "b", "top").collect()
    assert {(r.map, r.a): r.top for r in got} == {("a", i): 0 for i in ids} | {("b", 7): 7, ("b", 9): 7, ("b", 5): 5}
    assert len(rounds) <= 12
