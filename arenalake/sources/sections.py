"""Sections of results: named tables, sorted, partitioned by match, and read a match at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The order of a section's rows within a match.
ORDERS = {"nodes": ["name"], "edges": ["from_loc", "to_loc"], "events": ["t_ms", "seq"]}

Tables = dict[str, DataFrame]


def merged(one: DataFrame, other: DataFrame, order: list[str] = ORDERS["events"]) -> DataFrame:
    """Two lists of a match's rows as one; rows of equal order keep those of ``one`` first (``side`` 0, then 1).

    Sort it within partitions by match_id, the order and side: see ``write``.
    """
    return one.withColumn("side", F.lit(0)).unionByName(other.withColumn("side", F.lit(1)), allowMissingColumns=True).select("match_id", *order, "side", *[c for c in dict.fromkeys(one.columns + other.columns) if c not in ("match_id", *order)])


def processed(tables: Tables, steps: Iterable[Callable[[Tables], Tables]]) -> Tables:
    """The tables after each post-processor in turn; a step gives the tables that it changes or adds, the others stay."""
    for step in steps:
        tables = {**tables, **step(tables)}
    return tables


def write(tables: Tables, path: str, orders: dict[str, list[str]] = ORDERS) -> None:
    """Each table as ``path/<name>/match_id=...``: a file a match and task, its rows in the section's order.

    Folders cost more than rows, so all tasks share them, and each task puts its own in place: a folder that holds an
    earlier result is emptied first, and is whole again when the call returns.
    """
    for name, rows in tables.items():
        order = [*orders.get(name, []), *[c for c in ("side",) if c in rows.columns]]
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        writer = rows.repartition(tasks, "match_id").sortWithinPartitions("match_id", *order).write.mode("overwrite")
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("match_id").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, name: str, match_id: int | None = None) -> DataFrame:
    """A section as it was written, of all matches or of one: only that match's folder is listed and read."""
    if match_id is None:
        return spark.read.parquet(f"{path}/{name}")
    own = f"{path}/{name}/match_id={match_id}"
    place = spark._jvm.org.apache.hadoop.fs.Path(own)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):  # a match without rows
        return spark.read.parquet(f"{path}/{name}").filter(F.col("match_id") == match_id)
    return spark.read.option("basePath", f"{path}/{name}").parquet(own).filter(F.col("match_id") == match_id)
