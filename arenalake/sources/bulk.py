"""Bulk runs over a folder of event dumps: a result for each match, errors kept beside them, and counts.

Each file is a match (or several, of which lines name one).  A run is a stream with an available-now trigger: what has been
done is in its checkpoint, so a run that ended early goes on where it stopped, and a batch that is done again overwrites
the partitions of its own matches.  One scan of a batch feeds all sinks.  Spark's readers do not see files of no bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from arenalake.sources.shared import settled

#: Rows with match_id of the events given.  An optional column ``error`` is null, or says why a match fails: then none of
#: the match's rows are kept.
Analyzer = Callable[[DataFrame], DataFrame]
ERRORS = "match_id string, analyzer string, reason string"


class Counts(NamedTuple):
    """Files by outcome, and the rows of the errors table that the run added."""

    processed: int
    failed: int
    errors: int


def _own(path: str) -> Column:
    """The match that a file's place names."""
    folder, name = F.regexp_extract(path, r"match_id=([^/]+)/", 1), F.regexp_extract(path, r"([^/]+?)(?:\.[a-z]+)*$", 1)
    return F.when(folder != "", folder).otherwise(name)


def events_of(files: DataFrame) -> DataFrame:
    """Lines of whole files (path, value) as events: match_id, line, kind, t_ms, data (a VARIANT of any shape), reason and payload
    (of a line that is no event).

    The match is what the line names, else the folder ``match_id=...`` or the file's name.
    """
    lines = files.select("path", _own("path").alias("own"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).filter("trim(text) <> ''")
    e = lines.withColumn("e", F.try_parse_json("text"))
    at = lambda field, kind: F.try_variant_get("e", f"$.{field}", kind)
    e = e.select("path", F.coalesce(at("match_id", "string"), "own").alias("match_id"), "line", at("kind", "string").alias("kind"), F.round(at("time", "double") * 1000).cast("int").alias("t_ms"), at("data", "variant").alias("data"), "e", "text")
    reason = F.when(F.col("e").isNull() | ~F.schema_of_variant("e").startswith("OBJECT"), "unreadable").when(F.col("kind").isNull(), "no kind").when(F.col("t_ms").isNull(), "no time")
    return e.withColumn("reason", reason).select("path", "match_id", "line", "kind", "t_ms", "data", "reason", F.when(F.col("reason").isNotNull(), F.col("text")).alias("payload"))


def partial(events: DataFrame) -> DataFrame:
    """Events before a file's first unreadable line: reading stops there, and what has been read stays."""
    broken = F.min(F.when(F.col("reason") == "unreadable", F.col("line"))).over(Window.partitionBy("path"))
    kept = events.withColumn("_broken", broken).filter("reason is null and (_broken is null or line < _broken)")
    return kept.drop("_broken", "reason", "payload")


def outcomes(files: DataFrame, events: DataFrame, good: DataFrame) -> DataFrame:
    """(match_id, path, status, events, bad_lines) of every file: failed without a single event, else processed."""
    bad = events.groupBy("path").agg(F.min("match_id").alias("match_id"), F.count("reason").alias("bad_lines"))
    some = good.groupBy("path").agg(F.count("*").alias("events"))
    status = F.when(F.coalesce("events", F.lit(0)) > 0, "processed").otherwise("failed")
    every = files.select("path", _own("path").alias("_own")).join(bad, "path", "left").join(some, "path", "left")
    return every.select(F.coalesce("match_id", "_own").alias("match_id"), "path", status.alias("status"), F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("bad_lines", F.lit(0)).alias("bad_lines"))


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id").json(path)


def _analyzed(good: DataFrame, name: str, analyzer: Analyzer, path: str) -> DataFrame:
    """Writes an analyzer's results; its errors as (match_id, analyzer, reason).

    Matches for which it gives an error are told from its rows, all at once.  Where it raises instead, Spark says for no row
    why, and the matches that it raises on are found by halving, at some jobs for each; the others keep theirs.
    """
    spark = good.sparkSession

    def attempt(rows: DataFrame) -> DataFrame:
        out = analyzer(rows)
        if "error" not in out.columns:
            _write(out, path)
            return spark.createDataFrame([], ERRORS)
        out = settled(out)
        failed = out.filter("error is not null").groupBy("match_id").agg(F.min("error").alias("reason"))
        _write(out.join(failed, "match_id", "left_anti").drop("error"), path)
        return failed.select("match_id", F.lit(name).alias("analyzer"), "reason")

    def halved(matches: list[str]) -> DataFrame:
        try:
            return attempt(good.filter(F.col("match_id").isin(matches)))
        except Exception as e:  # noqa: BLE001 - whatever an analyzer does is kept as its error
            if len(matches) == 1:
                return spark.createDataFrame([(matches[0], name, str(e).strip().splitlines()[0][:500])], ERRORS)
            half = len(matches) // 2
            return halved(matches[:half]).unionByName(halved(matches[half:]))

    try:
        return attempt(good)
    except Exception:  # noqa: BLE001
        return halved(sorted(r[0] for r in good.select("match_id").distinct().collect()))


def run_folder(spark: SparkSession, source: str, target: str, analyzers: dict[str, Analyzer], files_per_batch: int = 500) -> Counts:
    """Analyses every file below ``source`` that no earlier run with the same ``target`` has done.

    Writes JSON by match: ``target/<analyzer>`` (its rows, with match_id), ``target/errors`` (match_id, analyzer, line, reason,
    payload) and ``target/files`` (see ``outcomes``).  A file without events fails, and the run goes on; so it does when an
    analyzer fails on a match.  Where an analyzer raises, the batch's match names pass through the driver,
    ``files_per_batch`` files at a time.
    """
    for name in (*analyzers, "errors", "files"):  # readers find a table, if an empty one, where all fails
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    total = [0, 0, 0]

    def batch(files: DataFrame, _: int) -> None:
        events = settled(events_of(files))  # one scan for all sinks
        good = partial(events)
        seen = Observation()
        found = outcomes(files, events, good).observe(seen, F.count_if(F.col("status") == "processed").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"))
        _write(found, f"{target}/files")
        own = spark.createDataFrame([], ERRORS)
        for name, analyzer in analyzers.items():
            own = own.unionByName(_analyzed(good, name, analyzer, f"{target}/{name}"))
        own = own.select("match_id", "analyzer", F.lit(None).cast("int").alias("line"), "reason", F.lit(None).cast("string").alias("payload"))
        noted = Observation()
        bad = events.filter("reason is not null").select("match_id", F.lit("reader").alias("analyzer"), "line", "reason", "payload")
        _write(bad.unionByName(own).observe(noted, F.count("*").alias("errors")), f"{target}/errors")
        for i, n in enumerate((seen.get["processed"], seen.get["failed"], noted.get["errors"])):
            total[i] += n

    stream = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(source)
    rows = stream.select(F.col("_metadata.file_path").alias("path"), "value")
    rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{target}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    return Counts(*total)
