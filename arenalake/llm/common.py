"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalake.sources.shared import shared_dir

#: ASCII white space between words; everything else belongs to a word.
WORD_GAP = r"[\x20\x09-\x0D]+"
BROADCAST_BYTES = 32 << 20  #: what a broadcast table may hold in memory, by its rows and their width


def words(text: Column) -> Column:
    """Words of a text (maximal runs without ASCII white space); null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body`` (a function of a column)."""
    return F.transform(F.array(value), body)[0]


_written: list[str] = []  #: folders that ``materialize`` wrote, oldest first


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet below the shared folder and read it back.

    The files outlive lost executors. They go when the driver's JVM ends, or earlier with ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arenalake-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _path(spark, path, lambda fs, p: fs.deleteOnExit(p))
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, key: str, n: int, dealt: bool = False) -> DataFrame:
    """``materialize`` into ``n`` buckets by ``key``: later joins on the key move only their other side.

    ``dealt``: the rows are in ``n`` parts by the key already.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arenalake-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    table = f"arenalake_{name}_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(n, key)).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    _path(spark, path, lambda fs, p: fs.deleteOnExit(p))
    _written.append(path)
    out = spark.table(table)
    out.schema  # resolved: the files and their buckets are known, so the catalog need not keep the entry
    spark.sql(f"DROP TABLE {table}")
    return out


@contextlib.contextmanager
def written():
    """Collects the folders that ``materialize`` writes meanwhile."""
    begin, found = len(_written), []
    yield found
    found += _written[begin:]


def drop(spark: SparkSession, paths: list[str], reader: DataFrame) -> None:
    """Delete folders of ``materialize`` that ``reader`` doesn't read from."""
    files = reader.inputFiles()
    for path in paths:
        if not any(path.rpartition("/")[2] in f for f in files):
            _path(spark, path, lambda fs, p: fs.delete(p, True))


def few(table: DataFrame, width: int = 64) -> DataFrame:
    """A materialized table, to be broadcast if its rows, of about ``width`` bytes in memory, are bounded."""
    return F.broadcast(table) if table.count() * width <= BROADCAST_BYTES else table


def most_frequent(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """The rows with the highest counts, about ``limit`` of them at most: all of the levels (in steps of log2 / 16) that fit,
    and of the next one as many, chosen by a hash of the row, as there is room for.

    Unlike a sorted limit, no task sends more to the driver than it has among these rows.  ``counts`` should be materialized.
    """
    level = F.floor(F.log2(n) * 16).cast("int")
    rows = counts.groupBy(level.alias("level")).count().collect()  # at most some 1,000 levels
    cut, total, part = 1 << 30, 0, F.lit(False)
    for r in sorted(rows, reverse=True):
        if total + r["count"] > limit:
            share = int(0.9 * (limit - total) / r["count"] * (1 << 20))
            part = (level == r["level"]) & (F.pmod(F.xxhash64(*counts.columns), F.lit(1 << 20)) < share)
            break
        total += r["count"]
        cut = r["level"]
    return counts.filter((level >= cut) | part)


def _path(spark: SparkSession, path: str, use):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return use(p.getFileSystem(spark._jsc.hadoopConfiguration()), p)
