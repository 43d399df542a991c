"""Event dumps, bulk runs, point and region files, split JSON blocks, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalake.functions.text import loc_name

EVENTS = "match_id string, seq long, kind string, time double, data map<string,string>, _corrupt_record string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines {kind, time, data}, with t_ms; unreadable lines keep their text in _corrupt_record.

    The match is the file's name unless a line names one.
    """
    rows = spark.read.schema(EVENTS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    own = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.jsonl?)?(?:\.gz)?$", 1)
    return rows.withColumns({"match_id": F.coalesce("match_id", own), "t_ms": F.round(F.col("time") * 1000).cast("int")})


def split_bad(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows as match_id, reason, payload)."""
    bad = F.col("_corrupt_record").isNotNull() | F.col("kind").isNull() | F.col("t_ms").isNull()
    reason = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(F.col("kind").isNull(), "no kind").otherwise("no time")
    return rows.filter(~bad).drop("_corrupt_record"), rows.filter(bad).select("match_id", reason.alias("reason"), F.coalesce("_corrupt_record", F.to_json("data")).alias("payload"))


def write_result(result: DataFrame, path: str, positions: bool = False) -> None:
    """One JSON document a row; positions only if asked for."""
    (result if positions or "positions" not in result.columns else result.drop("positions")).write.json(path)


def read_points(spark: SparkSession, path: str, variables: dict[str, str] | None = None) -> DataFrame:
    """(map, loc_id, x, y, z, name) of files with lines ``X Y Z name...`` in eighths of a unit; comments and malformed
    lines are skipped, points are numbered in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.lower(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.loc$", 1)).alias("map"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda i: (F.get(parts, F.lit(i)).try_cast("double") / 8).cast("float")
    rows = lines.filter(~F.col("value").rlike(r"^\s*(?://|#|;)")).select("map", "line", number(0).alias("x"), number(1).alias("y"), number(2).alias("z"), loc_name(F.regexp_extract(F.trim("value"), r"^\S+\s+\S+\s+\S+\s+(.*)$", 1), variables).alias("name"))
    good = rows.filter("x is not null and y is not null and z is not null and name <> ''")
    return good.select("map", (F.rank().over(_by_line()) - 1).alias("loc_id"), "x", "y", "z", "name")


def _by_line():
    from pyspark.sql import Window

    return Window.partitionBy("map").orderBy("line")


def read_regions(spark: SparkSession, path: str, override: DataFrame | None = None) -> DataFrame:
    """(map, region, loc, ord) of JSON files {regions: [{name, locs}]}; an override table replaces a map's own."""
    rows = spark.read.schema("regions array<struct<name:string,locs:array<string>>>").option("multiLine", True).json(path)
    own = rows.select(F.lower(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.json$", 1)).alias("map"), F.posexplode("regions").alias("ord", "r")).select("map", F.col("r.name").alias("region"), F.explode("r.locs").alias("loc"), "ord")
    return own if override is None else own.join(override.select("map").distinct(), "map", "left_anti").unionByName(override)


def loc_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(map, loc_id, region), names compared in any case; the last region that names a point wins."""
    last = regions.groupBy("map", F.lower("loc").alias("_loc")).agg(F.max_by("region", "ord").alias("region"))
    return points.join(last, (points["map"] == last["map"]) & (F.lower("name") == F.col("_loc"))).select(points["map"], "loc_id", "region")


def join_blocks(blocks: DataFrame, schema: str) -> DataFrame:
    """Scoreboards from JSON split in blocks (match_id, num, content): 1, 2, ... and 0 last; the raw text stays beside the
    parsed one, which is null where it cannot be read."""
    ordered = F.array_sort(F.collect_list(F.struct((F.col("num") == 0).alias("last"), "num", "content")))
    text = F.array_join(F.transform(ordered, lambda b: b["content"]), "")
    return blocks.groupBy("match_id").agg(text.alias("raw")).withColumn("board", F.from_json("raw", schema))
