"""Temporal building blocks: as-of lookups, intervals, change streams, islands and grids.

Every function takes and returns DataFrames and stays lazy.  Streams are keyed by ``keys`` (a match and a player, as a
rule), ordered by ``t_ms`` and then ``seq``; windows never leave a key, so a task holds one stream at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["match_id", "player"]


def asof(probes: DataFrame, changes: DataFrame, values: list[str], keys: list[str] = KEYS, inclusive: bool = True, forward: bool = False) -> DataFrame:
    """``probes`` with ``values`` of the latest change at or before t_ms (before it if not inclusive; forward: from t_ms on).

    Probes and changes are merged in one sorted stream, so there is one shuffle and no range join.
    """
    changes = changes if "seq" in changes.columns else changes.withColumn("seq", F.lit(0))
    found = changes.select(*keys, "t_ms", F.col("seq").alias("_seq"), F.struct(*values).alias("_v"), F.lit(False).alias("_probe"))
    asked = probes.select(*keys, "t_ms", F.lit(None).cast("long").alias("_seq"), F.struct(*[c for c in probes.columns]).alias("_row"), F.lit(True).alias("_probe"))
    both = found.unionByName(asked, allowMissingColumns=True)
    # among equal times a change precedes a probe that may see it
    first = F.col("_probe") if inclusive != forward else ~F.col("_probe")
    order = [F.col("t_ms"), first, F.col("_seq")]
    if forward:
        order = [F.col("t_ms").desc(), F.col("_probe") if inclusive else ~F.col("_probe"), F.col("_seq").desc()]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(w)).filter("_probe")
    return seen.select("_row.*", *[F.col(f"_seen.{v}").alias(v) for v in values])


def nearest(probes: DataFrame, samples: DataFrame, values: list[str], keys: list[str] = KEYS) -> DataFrame:
    """``probes`` with ``values`` of the sample nearest in time; the earlier one wins a tie."""
    stamped = samples.withColumn("_at", F.col("t_ms"))
    back = [f"_b_{v}" for v in ["at", *values]]
    past = asof(probes, stamped, ["_at", *values], keys).withColumnsRenamed(dict(zip(["_at", *values], back, strict=True)))
    both = asof(past, stamped, ["_at", *values], keys, forward=True)
    older = F.col("_at").isNull() | (F.col("_b_at").isNotNull() & (F.col("t_ms") - F.col("_b_at") <= F.col("_at") - F.col("t_ms")))
    return both.select(*probes.columns, *[F.when(older, F.col(f"_b_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def held(probes: DataFrame, intervals: DataFrame, to: str, keys: list[str] = KEYS) -> DataFrame:
    """``probes`` with boolean ``to``: some half-open interval [start_ms, end_ms) of the key covers t_ms.

    Intervals may overlap: the running maximum of ends decides.
    """
    reach = F.max("end_ms").over(Window.partitionBy(*keys).orderBy("start_ms").rowsBetween(Window.unboundedPreceding, 0))
    starts = intervals.select(*keys, F.col("start_ms").alias("t_ms"), reach.alias("_reach"))
    return asof(probes, starts, ["_reach"], keys).withColumn(to, F.coalesce(F.col("_reach") > F.col("t_ms"), F.lit(False))).drop("_reach")


def clamp(intervals: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    """Intervals that overlap [start, end), cut to it."""
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return intervals.filter((F.col("end_ms") > lo) & (F.col("start_ms") < hi)).withColumns({"start_ms": F.greatest("start_ms", lo), "end_ms": F.least("end_ms", hi)})


def changed(stream: DataFrame, value: str, keys: list[str] = KEYS) -> DataFrame:
    """Rows whose value differs from the one before."""
    w = Window.partitionBy(*keys).orderBy("t_ms", "seq")
    marked = stream.withColumn("_first", F.row_number().over(w) == 1).withColumn("_was", F.lag(value).over(w))
    return marked.filter(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_was"))).drop("_first", "_was")


def flips(stream: DataFrame, flag: str, match_end: Column, keys: list[str] = KEYS) -> DataFrame:
    """Boolean changes as intervals: open at true, closed at false, or at ``match_end`` if still open."""
    w = Window.partitionBy(*keys).orderBy("t_ms", "seq")
    edges = changed(stream, flag, keys).withColumn("end_ms", F.coalesce(F.lead("t_ms").over(w), match_end))
    return edges.filter(flag).select(*keys, F.col("t_ms").alias("start_ms"), "end_ms")


def islands(rows: DataFrame, new: Column, order: list[str], to: str = "island", keys: list[str] = KEYS) -> DataFrame:
    """``rows`` numbered by running count of ``new`` (an expression that may use lag over the same order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_new", new).withColumn(to, F.sum(F.col("_new").cast("int")).over(w)).drop("_new")


def grid(matches: DataFrame, window_ms: int, start_ms: int = 0, end_ms: int = 0, rounding: str = "partial") -> DataFrame:
    """(match_id, bucket, b_start, b_end, partial) of every match; 0 bounds mean the match's own.

    ``partial``: whole windows plus a shorter last one; ``half_up``: the window count is rounded half up.
    """
    if window_ms < 0:
        raise ValueError("window_ms must not be negative")
    w = window_ms or 50
    lo = F.lit(start_ms) if start_ms else F.col("match_start_ms")
    hi = F.lit(end_ms) if end_ms else F.col("match_end_ms")
    if rounding == "half_up":
        lo, hi = F.greatest("match_start_ms", F.lit(start_ms)), F.least("match_end_ms", F.lit(end_ms or (1 << 31) - 1))
        count = F.floor((hi - lo + w // 2) / w)
    else:
        count = F.ceil((hi - lo) / w)
    base = matches.select("match_id", lo.alias("_lo"), hi.alias("_hi"), count.cast("int").alias("_n")).filter("_n > 0")
    cells = base.select("match_id", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("bucket"))
    begin = F.col("_lo") + F.col("bucket") * w
    end = begin + w if rounding == "half_up" else F.least(begin + w, F.col("_hi"))
    return cells.select("match_id", "bucket", begin.cast("int").alias("b_start"), end.cast("int").alias("b_end"), (begin + w > F.col("_hi")).alias("partial"))


def merge_short(spans: DataFrame, value: str, least_ms: int, keys: list[str] = KEYS) -> DataFrame:
    """Dwell merge of consecutive spans (start_ms, end_ms, value): spans shorter than ``least_ms`` extend the one before
    (the first is always kept), and equal neighbours become one.  Nothing happens for 0."""
    if least_ms <= 0:
        return spans
    w = Window.partitionBy(*keys).orderBy("start_ms")
    ends = spans.withColumn("_first", F.row_number().over(w) == 1)
    kept = ends.withColumn("_kept", F.col("_first") | (F.col("end_ms") - F.col("start_ms") >= least_ms))
    so_far = Window.partitionBy(*keys).orderBy("start_ms").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("_kept"), F.col(value)), ignorenulls=True).over(so_far)
    marked = kept.withColumn("_new", F.col("_kept") & (F.col("_first") | ~F.col(value).eqNullSafe(before)))
    runs = marked.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "start_ms").alias("end_ms"), F.min_by(value, "start_ms").alias(value)).drop("_run")


def pair_runs(starts: DataFrame, ends: DataFrame, match_end: Column, keys: list[str] = KEYS) -> DataFrame:
    """Each start with the first end after it that no earlier start consumed (start_ms, end_ms, closed).

    Closed form: with f(j) the rank of the first end after start j, start k takes end k + max over j <= k of f(j) - j.
    """
    s = starts.select(*keys, "t_ms").withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("t_ms")))
    e = ends.select(*keys, "t_ms").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("t_ms")))
    first = asof(s, e, ["rank"], keys, inclusive=False, forward=True)
    total = e.groupBy(*keys).agg(F.max("rank").alias("total"))
    m = first.join(total, keys, "left").withColumn("f", F.coalesce("rank", F.coalesce("total", F.lit(0)) + 1))
    running = F.max(F.col("f") - F.col("k")).over(Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("take", F.col("k") + running).select(*keys, F.col("t_ms").alias("start_ms"), F.col("take").alias("rank"))
    joined = m.join(e.select(*keys, "rank", F.col("t_ms").alias("_end")), [*keys, "rank"], "left")
    return joined.select(*keys, "start_ms", F.coalesce("_end", match_end).alias("end_ms"), F.col("_end").isNotNull().alias("closed"))


def band(probes: DataFrame, events: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """Pairs of a probe (all its columns, with t_ms) and an event (its other columns) whose e_ms lies ``low`` to ``high`` after t_ms.

    Time is cut into bins as wide as the band.  An event is in one bin, a probe looks into the two that its band touches,
    so rows of a key meet only where their times are near, and each pair once.
    """
    width = max(high - low, 1)
    bin_of = lambda t: F.floor(t / width).cast("long")
    asked = probes.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("t_ms") + low), bin_of(F.col("t_ms") + high))))
    there = events.select(*events.columns, bin_of(F.col("e_ms")).alias("_bin"))
    return asked.join(there, [*keys, "_bin"]).filter((F.col("e_ms") - F.col("t_ms")).between(low, high)).drop("_bin")
