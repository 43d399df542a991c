"""Spatial operators: nearest named point, radius join, location smoothing, bounds, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalake.functions.graph import components
from arenalake.functions.temporal import KEYS, asof
from arenalake.sources.shared import settled

SIDE = 256.0  #: side of grid cells in radius joins
PER_CELL = 3  #: points that a cell of the first search holds on average
PLACE = ["map", "x", "y", "z"]
SNUG = 0.7  #: side of the cells of clusters as a part of the reach: a cell's points are all within it
FEW = 256  #: pairs of places up to which two boxes are compared place by place
LAST = 40  #: halvings of a cell after which they are in any case


def _distance2(p: str, q: str) -> Column:
    """Squared distance in single precision."""
    d = lambda c: F.col(f"{p}{c}").cast("float") - F.col(f"{q}{c}")
    return d("x") * d("x") + d("y") * d("y") + d("z") * d("z")


def _cell(c: str, side: float) -> Column:
    return F.floor(F.col(c) / side).cast("int")


def _points(locs: DataFrame, side: float) -> DataFrame:
    return locs.select("map", "loc_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), _cell("x", side).alias("_cx"), _cell("y", side).alias("_cy"))


def _around(rows: DataFrame, cells: int, side: float) -> DataFrame:
    """A row for every cell within ``cells`` of a row's own."""
    steps = F.sequence(F.lit(-cells), F.lit(cells))
    wide = rows.withColumn("_cx", F.explode(F.transform(steps, lambda i: _cell("x", side) + i)))
    return wide.withColumn("_cy", F.explode(F.transform(steps, lambda i: _cell("y", side) + i)))


def _searched(rows: DataFrame, locs: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with loc_id, the nearest point of the row's ``keys`` in three dimensions, the lowest id on a tie; rows of keys
    without points are left out.

    A key's cells are as wide as its points are dense.  Each point is listed in the nine cells around it, so a row meets the
    list of its cell once, and nothing is joined in pairs.  A row outside the box of the points looks from the place of the
    box that is nearest to it: points beyond the nine cells are farther by Pythagoras.  Rows that have none as near as that
    look again in cells twice as wide, until a cell holds the whole box.  Each search is settled once.
    """
    axes = "xyz"
    at = lambda c: F.col(c).cast("float")
    finite = [at(c).isNotNull() & ~F.isnan(at(c)) for c in axes]
    points = locs.filter(finite[0] & finite[1] & finite[2]).groupBy(*keys, *[at(c).alias(f"_{c}") for c in axes]).agg(F.min("loc_id").alias("loc_id"))
    span = lambda c: F.max(f"_{c}").cast("double") - F.min(f"_{c}")
    area = F.greatest(span("x"), F.lit(1.0)) * F.greatest(span("y"), F.lit(1.0))
    ends = [f(f"_{c}").cast("double").alias(f"_{name}{c}") for c in axes for f, name in ((F.min, "lo"), (F.max, "hi"))]
    points = settled(points)
    boxes = settled(points.groupBy(*keys).agg(F.sqrt(area / F.count("*") * PER_CELL).alias("_side"), F.greatest(span("x"), span("y")).alias("_span"), *ends))
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    points, rest = points.join(boxes.select(*keys, "_side"), keys), rows.filter(known).join(boxes, keys)
    inside = {c: F.greatest(F.least(at(c).cast("double"), F.col(f"_hi{c}")), F.col(f"_lo{c}")) for c in axes}
    gap = sum((at(c).cast("double") - inside[c]) ** 2 for c in axes)
    out, wide = None, 1
    while True:
        side = F.col("_side") * wide
        of = lambda c: F.floor(c / side).cast("long")  # noqa: B023, E731
        around = lambda c: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: of(F.col(c)) + i))  # noqa: B023, E731
        there = points.withColumn("_cx", around("_x")).withColumn("_cy", around("_y"))
        there = there.groupBy(*keys, "_cx", "_cy").agg(F.collect_list(F.struct("_x", "_y", "_z", "loc_id")).alias("_near"))
        d = lambda p: [at(c) - p[f"_{c}"] for c in axes]
        far = lambda p: F.struct((d(p)[0] * d(p)[0] + d(p)[1] * d(p)[1] + d(p)[2] * d(p)[2]).alias("d2"), p["loc_id"].alias("loc_id"))
        asked = rest.withColumns({"_cx": of(inside["x"]), "_cy": of(inside["y"])})
        best = F.array_min(F.transform("_near", far))
        # the margin is that of single precision
        sure = (F.col("_best.d2") * (1 + 1e-6) <= gap + side * side) | (F.col("_span") <= side)
        near = asked.join(there, [*keys, "_cx", "_cy"], "left").withColumn("_best", best).withColumn("_sure", F.coalesce(sure, F.lit(False)))
        near = settled(near.select(*rest.columns, F.col("_best.loc_id").alias("loc_id"), "_sure"))
        found = near.filter("_sure").select(*rows.columns, "loc_id")
        out = found if out is None else out.unionByName(found)
        rest = near.filter(~F.col("_sure")).select(*rest.columns)
        if not rest.head(1):
            return out
        wide *= 2


def nearest_point(places: DataFrame, locs: DataFrame) -> DataFrame:
    """(map, x, y, z, loc_id) of distinct places: the map's nearest point, see ``_searched``."""
    return _searched(places.select(*PLACE).distinct(), locs, ["map"])


def locate(positions: DataFrame, locs: DataFrame) -> DataFrame:
    """``positions`` with li, the id of the map's nearest point; 0 for the origin, which stands for no position.

    The search is settled: what is asked of the result later does not search again.
    """
    origin = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)
    nowhere = positions.filter(origin).join(locs.select("map").distinct(), "map", "left_semi")
    found = _searched(positions.filter(~origin), locs, ["map"]).withColumnRenamed("loc_id", "li")
    return found.unionByName(nowhere.withColumn("li", F.lit(0).cast(found.schema["li"].dataType)))


def within(places: DataFrame, locs: DataFrame, radius: float) -> DataFrame:
    """(map, x, y, z, loc_id) of all points of the map within ``radius`` of each distinct place."""
    side = SIDE
    pairs = _around(places.select(*PLACE).distinct(), int(radius // side) + 1, side).join(_points(locs, side), ["map", "_cx", "_cy"])
    return pairs.filter(_distance2("", "_") <= F.lit(radius * radius).cast("float")).select(*PLACE, "loc_id")


def visible_nearest(positions: DataFrame, locs: DataFrame, visible: DataFrame) -> DataFrame:
    """``positions`` (with leaf_id) with li: the nearest among the points visible from the leaf, or, if none is, what
    ``locate`` gives.

    ``visible``: (map, leaf_id, loc_id).  The points of a leaf are searched as those of a map are.
    """
    keys = ["map", "leaf_id"]
    seen = visible.select(*keys, "loc_id").join(locs.select("map", "loc_id", "x", "y", "z"), ["map", "loc_id"])
    blind = positions.join(seen.select(*keys).distinct(), keys, "left_anti")
    return _searched(positions, seen, keys).withColumnRenamed("loc_id", "li").unionByName(locate(blind, locs))


def smooth(located: DataFrame, boundaries: DataFrame, threshold_ms: int = 250) -> DataFrame:
    """Blip filter: ``located`` (t_ms, seq, li) with ``smooth``, the location without short visits.

    Runs end at boundaries (spawns and deaths) and at li = 0; a segment of one location is stable from ``threshold_ms``
    on.  Unstable samples take the stable neighbour's location; between two different ones the first half (rounded up)
    goes to the left, the rest to the right; without a stable segment nothing changes.
    """
    order = ["t_ms", "_place", "seq"]
    track = Window.partitionBy(*KEYS).orderBy(*order)
    rows = located.select(*located.columns, F.lit(1).alias("_place"))
    rows = rows.unionByName(boundaries.select(*KEYS, "t_ms", F.lit(0).alias("_place")), allowMissingColumns=True)
    # boundaries stand before the samples of their time
    x = rows.withColumn("_bc", F.count_if(F.col("_place") == 0).over(track)).filter("_place = 1")
    x = x.withColumns({"_nt": F.coalesce(F.lead("t_ms").over(track), "t_ms"), "_was": F.lag("li").over(track), "_wbc": F.lag("_bc").over(track)})
    begun = F.col("_was").isNull() | (F.col("_wbc") != F.col("_bc")) | ((F.col("_was") == 0) != (F.col("li") == 0))
    fresh = begun | (F.col("_was") != F.col("li"))
    x = x.withColumns({"_run": F.count_if(begun).over(track), "_seg": F.count_if(fresh).over(track), "_head": fresh})
    seg = Window.partitionBy(*KEYS, "_seg")
    x = x.withColumn("_stable", F.max("_nt").over(seg) - F.min("t_ms").over(seg) >= threshold_ms)
    run = Window.partitionBy(*KEYS, "_run").orderBy(*order)
    good = F.when(F.col("_stable"), F.col("li"))
    x = x.withColumns({
        "_pv": F.last(good, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)),
        "_nx": F.first(good, ignorenulls=True).over(run.rowsBetween(0, Window.unboundedFollowing)),
        "_grp": F.count_if(F.col("_stable") & F.col("_head")).over(run.rowsBetween(Window.unboundedPreceding, 0)),
    })
    part = Window.partitionBy(*KEYS, "_run", "_grp", "_stable")
    rn, n = F.row_number().over(part.orderBy(*order)), F.count("*").over(part)
    half = F.when(rn <= F.floor((n + 1) / 2), F.col("_pv")).otherwise(F.col("_nx"))
    value = F.when(F.col("_stable") | (F.col("_pv").isNull() & F.col("_nx").isNull()), F.col("li")).when(F.col("_pv").isNull(), F.col("_nx")).when(F.col("_nx").isNull(), F.col("_pv")).otherwise(half)
    return x.withColumn("smooth", F.when(F.col("li") == 0, 0).otherwise(value)).select(*located.columns, "smooth")


def intern(names: DataFrame) -> DataFrame:
    """(match_id, name, li): names numbered from 1 by first appearance (t_ms, player, seq) in each match."""
    first = names.filter("name <> ''").groupBy("match_id", "name").agg(F.min(F.struct("t_ms", "player", "seq")).alias("at"))
    return first.withColumn("li", F.row_number().over(Window.partitionBy("match_id").orderBy("at"))).select("match_id", "name", "li")


def bounds(positions: DataFrame, locs: DataFrame | None = None) -> DataFrame:
    """Smallest and largest x and y of each match: of its positions, without the origin, and of its map's points."""
    rows = positions.filter("x <> 0 or y <> 0 or z <> 0").select("match_id", "x", "y")
    if locs is not None:
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]
        # two corners stand for all points of a map
        corners = F.explode(F.array(*[F.struct(F.col(f"{n}_x").alias("x"), F.col(f"{n}_y").alias("y")) for n in ("min", "max")]))
        boxes = locs.groupBy("map").agg(*ends).select("map", corners.alias("p"))
        rows = rows.unionByName(positions.select("match_id", "map").distinct().join(boxes, "map").select("match_id", "p.x", "p.y"))
    return rows.groupBy("match_id").agg(*[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)])


def height_range(positions: DataFrame) -> DataFrame:
    """The z at 2 % and 98 % of each match's positions by index, not interpolated."""
    w = Window.partitionBy("match_id").orderBy("z")
    ranked = positions.select("match_id", "z", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("match_id")).alias("n"))
    at = lambda q: F.max(F.when(F.col("i") == F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col("z")))
    return ranked.groupBy("match_id").agg(at(0.02).alias("z_low"), at(0.98).alias("z_high"))


def centroids(locs: DataFrame, regions: DataFrame) -> DataFrame:
    """Mean x and y of the points of each map's regions."""
    return locs.join(regions, ["map", "loc_id"]).groupBy("map", "region").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def _linked(places: DataFrame, reach: float) -> DataFrame:
    """(map, loc_id, other): pairs of cells, by their smallest ids, of which two places are nearer than ``reach``.

    Cells two steps apart at most meet as boxes of their places: a pair is linked where the farthest sides are near enough,
    and left where the nearest ones are not.  Two boxes of few places are compared place by place, others by their
    quarters, until their cells are linked or nothing is open.  Rounding keeps differences in order, so what holds for the
    sides of boxes holds for all that lies between.
    """
    cell, far = ["map", "_cx", "_cy"], ["map", "_ox", "_oy"]
    pair = [*cell, "_ox", "_oy", "loc_id", "other"]
    turned = {"_cx": "_ox", "_cy": "_oy", "loc_id": "other", "_a": "_b", "_x": "_x2", "_y": "_y2"}
    near = lambda dx, dy: dx.cast("double") * dx.cast("double") + dy.cast("double") * dy.cast("double") < reach * reach
    part = lambda level: [F.floor(F.col(c) * 2.0**level).alias(to) for c, to in (("_u", "_i"), ("_v", "_j"))]

    def boxes(level: int) -> DataFrame:
        """(cell, loc_id, _i, _j, _a): boxes of the cells' parts, with the parts that hold them one level before."""
        ends = [f(f"_{c}").alias(f"{c}{n}") for c in "xy" for n, f in enumerate((F.min, F.max))]
        box = F.struct(F.col("_i").alias("i"), F.col("_j").alias("j"), "n", "x0", "x1", "y0", "y1").alias("_a")
        sums = places.groupBy(*cell, *part(level)).agg(F.min("loc_id").alias("loc_id"), F.count("*").alias("n"), *ends)
        return sums.select(*cell, "loc_id", *[F.shiftright(c, 1).alias(c) for c in ("_i", "_j")], box)

    def met(pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """``pairs`` with what their boxes hold (parts: cell, _i, _j, values) for the boxes, each with each."""
        for box, keys in (("_a", cell), ("_b", far)):
            held = parts if box == "_a" else parts.withColumnsRenamed(turned)
            pairs = pairs.withColumns({"_i": F.col(f"{box}.i"), "_j": F.col(f"{box}.j")}).drop(box).join(held, [*keys, "_i", "_j"]).drop("_i", "_j")
        return pairs

    def ends(c: str, f: str, g: str) -> list[Column]:
        return [F.col(f"_a.{c}{f}") - F.col(f"_b.{c}{g}"), F.col(f"_b.{c}{f}") - F.col(f"_a.{c}{g}")]

    gaps = [F.greatest(*ends(c, "0", "1"), F.lit(0)) for c in "xy"]
    spans = [F.greatest(*ends(c, "1", "0")) for c in "xy"]
    whole = boxes(0).drop("_i", "_j")
    steps = F.array(*[F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)])
    around = whole.withColumn("_step", F.explode(steps)).withColumns({"_ox": F.col("_cx") + F.col("_step.i"), "_oy": F.col("_cy") + F.col("_step.j")})
    pairs = around.join(whole.withColumnsRenamed(turned), far)
    out, level = None, 0
    while True:
        pairs = settled(pairs.filter(near(*gaps)).select(*pair, "_a", "_b", near(*spans).alias("_sure")))
        sure = pairs.filter("_sure").select(*pair).distinct()
        few = (F.col("_a.n") * F.col("_b.n") <= FEW) | F.lit(level == LAST)
        asked = pairs.filter(few).join(sure, pair, "left_anti").select(*pair, "_a", "_b")
        places_met = met(asked, places.select(*cell, *part(level), "_x", "_y"))
        found = places_met.filter(near(F.col("_x") - F.col("_x2"), F.col("_y") - F.col("_y2"))).select(*pair)
        found = settled(sure.unionByName(found).distinct())
        out = found if out is None else out.unionByName(found)
        rest = pairs.filter(~few).join(found, pair, "left_anti").select(*pair, "_a", "_b")
        if not rest.head(1):
            return out.select("map", "loc_id", "other")
        level += 1
        pairs = met(rest, boxes(level).drop("loc_id"))


def clusters(points: DataFrame, reach: float = 800.0) -> DataFrame:
    """(map, loc_id, cluster): single-linkage clusters of a map's points by xy-distance below ``reach``; the cluster is the
    smallest id in it.  A point without a finite place is a cluster of its own.

    Points of a cell of side 0.7 ``reach`` are linked by that, whatever their number, so only cells are joined in pairs and
    only their links spread labels (``components``).  Work grows with the points, and with the pairs of cells' parts whose
    distance is close to ``reach``.
    """
    cell = ["map", "_cx", "_cy"]
    spots = points.select("map", "loc_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    at = {c: F.col(f"_{c}") / F.lit(SNUG * reach) for c in "xy"}
    known = spots.filter(finite("_x") & finite("_y")).withColumns({f"_c{c}": F.rint(at[c]) for c in "xy"})
    # below 1 on the border between two cells too: a cell is one box before it is halved
    inner = {to: F.least(at[c] - F.col(f"_c{c}") + 0.5, F.lit(1 - 2.0**-53)) for to, c in (("_u", "x"), ("_v", "y"))}
    places = settled(known.groupBy(*cell, "_x", "_y").agg(F.min("loc_id").alias("loc_id")).withColumns(inner))
    heads = places.groupBy(*cell).agg(F.min("loc_id").alias("_head"))
    lost = spots.filter(~(finite("_x") & finite("_y"))).select("map", "loc_id", F.col("loc_id").alias("_head"))
    placed = known.join(heads, cell).select("map", "loc_id", "_head").unionByName(lost)
    # an id that has several places links their cells
    owned = settled(placed.groupBy("map", "loc_id").agg(F.collect_set("_head").alias("_heads")).withColumn("_head", F.array_min("_heads")))
    links = _linked(places, reach).unionByName(owned.select("map", F.col("_head").alias("loc_id"), F.explode("_heads").alias("other")))
    links = links.unionByName(links.select("map", F.col("other").alias("loc_id"), F.col("loc_id").alias("other")))
    labels = components(settled(links.distinct()), ["map"], "loc_id", "other", "cluster").withColumnRenamed("loc_id", "_head")
    return owned.join(labels, ["map", "_head"]).select("map", "loc_id", "cluster")


#: Words of a point's name that mark a region, and the same in the order in which they are tried.  Fixed values.
KEYWORDS = ("RA", "RL", "LG", "QUAD")
SPARE = "YA"  #: taken where a map has no RA


def detect_regions(locs: DataFrame, curated: DataFrame | None = None, reach: float = 800.0) -> DataFrame:
    """(map, loc_id, region): points whose names hold a keyword, in clusters by keyword, named by the keyword and the
    commonest other word of the cluster's names (the first by letters on a tie).

    Maps that ``curated`` (map, loc_id, region) knows keep those regions alone.
    """
    words = F.filter(F.split(F.upper("name"), "[^A-Z0-9]+"), lambda w: w != "")
    named = locs.withColumn("words", words)
    armored = named.filter(F.array_contains("words", KEYWORDS[0])).select(F.col("map").alias("_armored"), F.lit(True).alias("_red")).distinct()
    named = named.join(armored, F.col("map").eqNullSafe(F.col("_armored")), "left").drop("_armored")
    keys = F.when(F.col("_red"), F.array(*map(F.lit, KEYWORDS))).otherwise(F.array(F.lit(SPARE), *map(F.lit, KEYWORDS[1:])))
    marked = named.withColumn("keys", F.array_intersect(keys, "words")).withColumn("key", F.explode("keys"))
    by_key = marked.withColumns({"place": F.col("map"), "map": F.concat_ws(":", "map", "key")})
    grouped = clusters(by_key, reach).join(by_key.select("map", "loc_id", "place", "key", "words"), ["map", "loc_id"])
    other = grouped.select("place", "key", "cluster", F.explode(F.array_except("words", F.array("key"))).alias("word")).groupBy("place", "key", "cluster", "word").agg(F.count("*").alias("n"))
    best = other.groupBy("place", "key", "cluster").agg(F.min_by("word", F.struct(-F.col("n"), "word")).alias("word"))
    out = grouped.join(best, ["place", "key", "cluster"], "left").select(F.col("place").alias("map"), "loc_id", F.concat_ws(" ", "key", "word").alias("region"))
    if curated is None:
        return out
    own = curated.select("map", "loc_id", "region")
    return out.join(own.select("map").distinct(), "map", "left_anti").unionByName(own)
