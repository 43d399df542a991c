"""Bucketed time series: sample sets, reducers, liveness, team counters, and the columnar layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalake.functions.fields import NUMERIC, default_reducer, known_reducer, own_reducer
from arenalake.functions.temporal import KEYS

CELL = [*KEYS, "bucket"]


def cells(grid: DataFrame, players: DataFrame) -> DataFrame:
    """One row for every match, player and bucket."""
    return players.select(*KEYS).join(grid, "match_id")


#: What a reducer gives where there are no samples.
EMPTY = {"held-any": False, "majority": False, "any": False}
# Places of rows at one time: changes, then the probe of a bucket that begins there, then marks (a spawn last) and positions.
_CHANGE, _PROBE, _DEATH, _SPAWN, _PLACE = range(5)


def _reduced(reducer: str, v: Column, order: Column) -> Column:
    """The reducer over the samples of a cell; ``v`` is null in rows that are no samples."""
    at, number = F.when(v.isNotNull(), order), v.cast("double")
    if (own := own_reducer(reducer)) is not None:
        samples = F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(order.alias("at"), v.alias("v"))))), lambda x: x["v"])
        return F.when(F.count(v) > 0, own.apply(samples))
    how = {
        "first": lambda: F.min_by(v, at), "last": lambda: F.max_by(v, at), "mean": lambda: F.avg(number), "min": lambda: F.min(number), "max": lambda: F.max(number),
        "held-any": lambda: F.bool_or(v), "majority": lambda: F.when(F.count(v) > 0, 2 * F.count_if(v) >= F.count(v)), "any": lambda: F.when(F.count(v) > 0, True),
    }
    return how[reducer]()


def table(grid_cells: DataFrame, streams: dict[str, tuple[DataFrame, str, str | None]], alive: tuple[DataFrame, DataFrame, DataFrame] | None = None, fill: bool = True) -> DataFrame:
    """Row layout: one row a cell with a column a field; ``streams``: field -> (stream, kind, reducer).

    A reducer is one of ``fields.REDUCERS`` or of ``fields.register_reducer``; none means the default of the kind (``any``
    for marks, ``first`` for all else), an empty name ``last``.

    All streams and the buckets' starts are merged into one sorted stream a player, in which every bucket sees what is
    carried to its start and every row its bucket; one aggregation then gives all fields.  The sample set of a cell is, by
    kind: number, text - the value carried to the start and every change after it; interval - held or not at eight probes,
    nothing for players without any interval; position - samples inside, or the carried one if there are none; mark -
    times inside.  Text and positions have no numeric reducers (null).

    ``alive`` (spawns, deaths, positions) leaves out cells in which the player takes no part: spawned inside, or the
    latest mark before is a spawn; without marks before, a position from 100 ms before the start on; without any signal
    at all, always.  Cells in which every field is null are left out; ``fill`` gives what a reducer says of no samples.
    """
    streams = {f: (s, kind, default_reducer(kind) if r is None else known_reducer(r or "last")) for f, (s, kind, r) in streams.items()}
    eight = any(kind == "interval" and reducer != "first" for _, kind, reducer in streams.values())
    steps = F.explode(F.sequence(F.lit(0), F.lit(7))) if eight else F.lit(0)
    starts = grid_cells.select(*CELL, "b_start", "b_end", "partial", steps.alias("_i"))
    at = (F.col("b_start") + F.col("_i") * (F.col("b_end") - F.col("b_start")) / 8).cast("int")
    rows = starts.select(*KEYS, at.alias("t_ms"), F.lit(-1).cast("long").alias("seq"), F.lit(_PROBE).alias("_kind"), "_i", F.struct("bucket", "b_start", "b_end", "partial").alias("_cell"))

    def merge(stream: DataFrame, place: int, value: Column | None, name: str, time: str = "t_ms") -> None:
        nonlocal rows
        seq = F.col("seq").cast("long") if "seq" in stream.columns else F.lit(0).cast("long")
        one = stream.select(*KEYS, F.col(time).alias("t_ms"), seq.alias("seq"), F.lit(place).alias("_kind"), *([value.alias(name)] if value is not None else []))
        rows = rows.unionByName(one, allowMissingColumns=True)

    for field, (stream, kind, _) in streams.items():
        if kind == "interval":
            merge(stream, _CHANGE, F.col("end_ms"), f"_{field}", "start_ms")
        else:
            merge(stream, {"mark": _DEATH, "position": _PLACE}.get(kind, _CHANGE), F.lit(True) if kind == "mark" else F.col("v"), f"_{field}")
    if alive is not None:
        for part, place in zip(alive, (_SPAWN, _DEATH, _PLACE), strict=True):
            merge(part, place, F.lit(place), "_mark")

    track = Window.partitionBy(*KEYS).orderBy("t_ms", "_kind", "seq", "_i").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*KEYS)
    probe, first = F.col("_kind") == _PROBE, (F.col("_kind") == _PROBE) & (F.col("_i") == 0)
    seen = {"_in": F.last("_cell", ignorenulls=True).over(track)}
    for field, (_, kind, reducer) in streams.items():
        c = f"_{field}"
        if kind == "interval":
            reach = F.max(c).over(track)
            held = F.when(F.max(c).over(whole).isNotNull(), F.coalesce(reach > F.col("t_ms"), F.lit(False)))
            seen[c] = F.when(first if reducer == "first" else probe, held)
        elif kind != "mark":
            seen[f"{c}_carry"] = F.when(first, F.last(c, ignorenulls=True).over(track))
    if alive is not None:
        # a position counts for the marks before it no more than any other row; only spawns and deaths do
        seen["_up"] = F.when(first, F.last(F.when(F.col("_mark") != _PLACE, F.col("_mark") == _SPAWN), ignorenulls=True).over(track))
        seen["_near"] = F.when(first, F.max(F.when(F.col("_mark") == _PLACE, F.col("t_ms"))).over(track) >= F.col("t_ms") - 100)
        seen["_signal"] = F.max("_mark").over(whole).isNotNull()
    rows = rows.withColumns(seen).filter(probe | (F.col("t_ms") < F.col("_in.b_end")))

    order, out, extra = F.struct("t_ms", "seq"), [], []
    for field, (_, kind, reducer) in streams.items():
        c = F.col(f"_{field}")
        own = own_reducer(reducer)
        if kind in ("text", "position") and reducer in NUMERIC:
            value = F.lit(None).cast("double")
        elif own is not None and own.grouped:  # an aggregation of its own: pandas and built-in aggregates don't mix
            value = F.lit(None)
            extra.append(field)
        elif reducer == "dominant":  # the most frequent value, the latest on a tie
            value = F.lit(None)
            extra.append(field)
        elif kind == "position":
            value = F.coalesce(_reduced(reducer, c, order), _reduced(reducer, F.col(f"_{field}_carry"), order))
        else:
            value = _reduced(reducer, c if kind in ("interval", "mark") else F.coalesce(f"_{field}_carry", c), order)
        empty = own.empty if own is not None and not own.grouped else EMPTY.get(reducer)
        out.append((F.coalesce(value, F.lit(empty)) if fill and empty is not None else value).alias(field))
    if alive is not None:
        spawned, placed = (F.coalesce(F.bool_or(F.col("_mark") == k), F.lit(False)) for k in (_SPAWN, _PLACE))
        up, near, signal = F.bool_or("_up"), F.coalesce(F.bool_or("_near"), F.lit(False)), F.bool_or("_signal")
        out.append(F.coalesce(F.when(spawned, True), up, F.when(placed | near, True), ~signal).alias("_alive"))
    cell = [F.first("_in.b_start").alias("b_start"), F.first("_in.b_end").alias("b_end"), F.first("_in.partial").alias("partial")]
    found = rows.groupBy(*KEYS, F.col("_in.bucket").alias("bucket")).agg(*cell, *out)
    for field in extra:
        c = F.col(f"_{field}") if streams[field][1] in ("interval", "mark") else F.coalesce(f"_{field}_carry", f"_{field}")
        samples = rows.select(*KEYS, F.col("_in.bucket").alias("bucket"), c.alias("v"), "t_ms", "seq").filter("v is not null")
        own = own_reducer(streams[field][2])
        if own is not None:
            found = found.drop(field).join(samples.groupBy(*CELL).agg(own.apply(F.col("v")).alias(field)), CELL, "left")
            if fill and own.empty is not None:
                found = found.withColumn(field, F.coalesce(field, F.lit(own.empty)))
            continue
        counts = samples.groupBy(*CELL, "v").agg(F.count("*").alias("n"), F.max(order).alias("at"))
        found = found.drop(field).join(counts.groupBy(*CELL).agg(F.max_by("v", F.struct("n", "at")).alias(field)), CELL, "left")
    if alive is not None:
        found = found.filter("_alive")
    return found.filter(F.coalesce(*[F.col(f).cast("string") for f in streams]).isNotNull()).select(*CELL, "b_start", "b_end", "partial", *streams)


def team_counters(rows: DataFrame, players: DataFrame) -> DataFrame:
    """Per team and bucket: players with both of rocket launcher and lightning gun, with one only, with any; with the
    other weapons and powerups; health and armor sums, and the players of each armor type.  Blank teams are left out;
    fields that ``rows`` lack count nothing.
    """
    teams = rows.join(players.filter("team <> ''"), KEYS)
    on = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long") if c in rows.columns else F.lit(0).cast("long")
    rl, lg = on("rl"), on("lg")
    armor = [F.count_if(F.col("at") == k).alias(f"abt_{k}") for k in ("ra", "ya", "ga")] if "at" in rows.columns else []
    counts = {"rllg": rl & lg, "rl": rl & ~lg, "lg": lg & ~rl, "w": rl | lg, "gl": on("gl"), "q": on("q"), "pe": on("pe"), "r": on("r")}
    out = teams.groupBy("match_id", "bucket", "team").agg(*[F.count_if(c).alias(k) for k, c in counts.items()], total("h").alias("th"), total("a").alias("ta"), *armor)
    return out.withColumn("pw", F.col("q") + F.col("pe") + F.col("r"))


def stacked(counters: DataFrame, fields: list[str]) -> DataFrame:
    """Team series for stacked bars: (match_id, team, bucket, field, low, high), each field on the ones before it, and the
    match's largest top of all teams and buckets."""
    w = Window.partitionBy("match_id", "team", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), F.col(f).cast("long").alias("v")) for i, f in enumerate(fields)]))
    rows = counters.select("match_id", "team", "bucket", parts.alias("p")).select("match_id", "team", "bucket", "p.*")
    high = rows.withColumn("high", F.sum("v").over(w)).withColumn("low", F.col("high") - F.col("v"))
    return high.withColumn("top", F.max("high").over(Window.partitionBy("match_id"))).select("match_id", "team", "bucket", "field", "low", "high", "top")


def to_columns(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Column layout: a dense array a field over the player's active span, with a mask and the first valid place.

    Missing values are typed zeros; players without any data are left out.
    """
    types = dict(rows.dtypes)
    zero = {f: F.lit(False) if types[f] == "boolean" else F.lit("") if types[f] == "string" else F.lit(0).cast(types[f]) for f in fields}
    # every row also stands for the buckets without the player until the next one
    after = F.coalesce(F.lead("bucket").over(Window.partitionBy(*KEYS).orderBy("bucket")) - 1, F.col("bucket"))
    full = rows.withColumn("_to", after).select(*CELL, *fields, F.explode(F.sequence("bucket", "_to")).alias("_b"))
    own = F.col("_b") == F.col("bucket")
    packed = F.array_sort(F.collect_list(F.struct("_b", own.alias("alive"), *[F.when(own & F.col(f).isNotNull(), F.col(f)).otherwise(zero[f]).alias(f) for f in fields])))
    valid = [F.min(F.when(own & F.col(f).isNotNull(), F.col("bucket"))).alias(f"valid_{f}") for f in fields]
    out = full.groupBy(*KEYS).agg(F.min("bucket").alias("first"), F.count("*").cast("int").alias("n"), packed.alias("x"), *valid)
    return out.select(*KEYS, "first", "n", F.col("x.alive").alias("alive"), *[F.col(f"x.{f}").alias(f) for f in fields], *[f"valid_{f}" for f in fields])


def from_columns(columns: DataFrame, fields: list[str]) -> DataFrame:
    """The row layout again; what stands before a field's first valid place is null."""
    zipped = F.arrays_zip("alive", *fields)
    flat = columns.select(*KEYS, "first", *[f"valid_{f}" for f in fields], F.posexplode(zipped).alias("i", "x")).filter("x.alive").withColumn("bucket", (F.col("first") + F.col("i")).cast("int"))
    return flat.select(*CELL, *[F.when(F.col("bucket") >= F.col(f"valid_{f}"), F.col(f"x.{f}")).alias(f) for f in fields])
