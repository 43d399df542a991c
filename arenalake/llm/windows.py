"""Windows of a text's units (bytes or words) that occur again elsewhere, found by minimisers over Spark.

Equal windows have the same minimiser, the gram with the smallest hash in them.  Runs of neighbouring windows that share
a minimiser are strings; of a string first only hashes, 48 bits of its minimiser and 48 of its units, and its place
travel.  Where a string stands in several documents, all its windows are repeated in all but the smallest of them, and
nothing more needs to be known of those places; tasks settle this for their own rows before the shuffle, so a group of
copies sends one place a task's batch.  What remains are minimisers with different strings: the smallest document's text
of each string travels to a bucket, where windows are compared themselves.  A minimiser with very many different strings
is split: its windows are dealt again by the minimisers of longer grams, at last by the windows themselves, so no
bucket depends on how common one gram is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import SLICE, buckets, deal, small
from .common import materialize, materialize_by

LAST = (1 << 63) - 1  #: stands for a null doc_id, which is larger than any other
SEGMENT = 1 << 19  #: windows of a text that are scanned together
CROWD = 2048  #: different strings of one minimiser that are compared in its bucket
BUCKET = 16 << 20  #: characters of input whose places make a bucket, about
TEXTS = 4 << 20  #: characters of compared strings that make a bucket, about
GONE, APART, CROWDED = 0, 1, 2


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Kind(NamedTuple):
    """What a window is made of, and how windows are compared."""

    width: int  #: units of a window
    grams: tuple[int, ...]  #: units of the grams that minimisers are taken of, the last of them whole windows
    within: bool  #: an earlier start in the same row counts as well
    units: Callable[[bytes], np.ndarray]  #: a hash for each unit
    cut: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]]  #: the texts from unit ``first``, ``n`` units long
    compare: Callable[[list[np.ndarray], bytes], Iterator[tuple[np.ndarray, ...]]]  #: (key, doc, row, first, n), texts -> (row, lo, hi)
    size: int  #: characters of a unit, about
    gap: bytes = b""


_B = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        bases = (_B, pow(_B, -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64)), dtype=np.uint64) for b in bases]
    return _POWERS


def _strings(units: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, code, first, n) of the runs of windows that share a minimiser, in one segment."""
    power, inverse = _powers(SEGMENT + width)
    sums = np.append(np.uint64(0), np.cumsum(units * power[: len(units)], dtype=np.uint64))
    h = mix((sums[gram:] - sums[:-gram]) * inverse[: len(units) - gram + 1] + np.uint64(gram))
    low = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(h), dtype=np.uint64)
    span, done = width - gram + 1, 1
    while 2 * done <= span:  # smallest of ``done`` neighbours, by doubling
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    low = np.minimum(low[: len(low) - (span - done)], low[span - done :])
    at = (low & np.uint64(0xFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    n = np.diff(np.append(first, len(at)))
    code = mix((sums[first + n + width - 1] - sums[first]) * inverse[first] + n.astype(np.uint64))
    return (h[at[first]] >> np.uint64(16)).astype(np.int64), (code >> np.uint64(16)).astype(np.int64), first, n


def strings(units: np.ndarray, width: int, gram: int, ranges: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, ...]:
    """(key, code, first, n) of the runs of windows that share a minimiser, of all windows or those in (first, n) ranges."""
    out = [(np.zeros(0, np.int64),) * 4]
    for first, n in ranges if ranges is not None else [(0, len(units) - width + 1)]:
        for base in range(first, first + n, SEGMENT):
            key, code, at, m = _strings(units[base : min(first + n, base + SEGMENT) + width - 1], width, gram)
            out.append((key, code, at + base, m))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def settle(columns: list[np.ndarray], within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, gone, new): places (key, code, doc, row, first, n) in order, which of them are all repeated, where strings begin."""
    key, code, doc, row, first, _ = columns
    order = np.lexsort((first, row, doc, code, key))
    key, code, doc, row = (c[order] for c in (key, code, doc, row))
    new = np.append(True, (key[1:] != key[:-1]) | (code[1:] != code[:-1]))[: len(key)]
    least = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    gone = doc > least
    if within and len(key):
        gone[1:] |= ~new[1:] & (row[1:] == row[:-1])
    return order, gone, new


def _settled(source: DataFrame, kind: Kind, level: int, n_buckets: int) -> DataFrame:
    """(kind, key, doc, row, first, n) of places that are GONE, APART or CROWDED."""
    width, gram = kind.width, kind.grams[level]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in small(batches, 2, SLICE // 3):
            got = []
            for row, doc, z, *ranges in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                spans = [(x["first"], x["n"]) for x in ranges[0]] if ranges else None
                key, code, first, n = strings(kind.units(unpack.decompress(z)), width, gram, spans)
                got.append((key, code, np.full(len(key), LAST if doc is None else doc), np.full(len(key), row), first, n))
            columns = [np.concatenate(c) for c in zip(*got, strict=True)]
            if len(columns[0]):
                order, settled, _ = settle(columns, kind.within)
                gone = np.empty(len(order), bool)
                gone[order] = settled
                # what is settled here passes through by a bucket below zero, where hashes count no more; places stay in the
                # order of the texts, in which they take least room
                bucket = np.where(gone, -1 - columns[3] % n_buckets, columns[0] % n_buckets)
                yield deal(bucket, [np.where(gone, 0, c) if i < 2 else c for i, c in enumerate(columns)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, columns, _ in buckets(batches, 6):
            if bucket < 0:
                order, verdict = np.arange(len(columns[0])), np.full(len(columns[0]), GONE)
            else:
                order, gone, new = settle(columns, kind.within)
                key = columns[0][order]
                group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
                several = np.bincount(group, weights=new)[group]
                verdict = np.where(several > CROWD, CROWDED, np.where(several > 1, APART, -1))
                verdict = np.where(gone, GONE, np.where(level == len(kind.grams) - 1, -1, verdict))
            keep = verdict >= 0
            key, _, doc, row, first, n = (c[order][keep] for c in columns)
            yield pa.RecordBatch.from_pydict({"kind": verdict[keep].astype(np.int32), "key": key, "doc": doc, "row": row, "first": first.astype(np.int32), "n": n.astype(np.int32)})

    dealt = source.mapInArrow(out, "bucket long, payload binary").repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "kind int, key long, doc long, row long, first int, n int")


def _by_row(found: DataFrame, names: list[str], to: str, n: int) -> DataFrame:
    """(row, ``to``): the structs of each row, in the ``n`` parts that the texts' buckets are, so that a join moves no text
    (in more parts, as ``spark.sql.shuffle.partitions`` may ask for, Spark would rather move the texts)."""
    return found.select("row", *names).repartition(n, "row").groupBy("row").agg(F.collect_list(F.struct(*names)).alias(to))


def _compared(read: DataFrame, apart: DataFrame, kind: Kind, n: int) -> DataFrame:
    """(row, lo, hi): the repeated windows of the strings that are apart; ``read`` has ``n`` buckets."""
    total = apart.agg(F.sum(F.col("n") + kind.width)).first()[0] or 0
    n_buckets = max(read.sparkSession.sparkContext.defaultParallelism, -(-total * kind.size // TEXTS))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in small(batches, 1, SLICE // 3):
            got, texts = [], []
            for row, z, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                key, doc, first, n = (np.array([p[c] for p in places], np.int64) for c in ("key", "doc", "first", "n"))
                got.append((key, doc, np.full(len(key), row), first, n))
                texts += kind.cut(unpack.decompress(z), first, n + kind.width - 1)
            columns = [np.concatenate(c) for c in zip(*got, strict=True)]
            yield deal(columns[0] % n_buckets, columns, texts, kind.gap)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, columns, text in buckets(batches, 5):
            for row, lo, hi in kind.compare(columns, text):
                yield pa.RecordBatch.from_pydict({"row": row.astype(np.int64), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    places = _by_row(apart, ["key", "doc", "first", "n"], "places", n)
    dealt = read.join(places.hint("merge"), "row").select("row", "packed", "places").mapInArrow(out, "bucket long, payload binary")
    return dealt.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, "row long, lo int, hi int")


def _ordered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc``: a long in the order of doc_id, null where it is null."""
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return docs.withColumn("doc", F.col("doc_id").cast("long"))
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy("doc_id").withColumn("doc", F.monotonically_increasing_id())
    return docs.join(materialize(ids, "ids"), "doc_id", "left")


def repeats(docs: DataFrame, text: str, kind: Kind, plain: Callable[[str], bytes]) -> tuple[DataFrame, DataFrame]:
    """((doc_id, doc, row, packed), (row, runs)): the rows with their ``plain`` bytes compressed, and the unit runs to remove.

    Runs may overlap; together they cover the windows that also start in a smaller document (or earlier in the row).
    """

    def pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in small(batches, 2):
            packed = [pack.compress(plain(t or "")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "doc", "packed"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    read = _ordered(docs.select("doc_id", text)).select("doc_id", "doc", text).mapInArrow(pack_all, f"doc_id {id_type}, doc long, packed binary")
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    n_buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET))
    read = materialize_by(read.withColumn("row", F.monotonically_increasing_id()), "texts", "row", n_buckets)

    source, gone, apart = read.select("row", "doc", "packed"), [], []
    for level in range(len(kind.grams)):
        found = materialize(_settled(source, kind, level, n_buckets), "places")
        gone.append(found.filter(f"kind = {GONE}").select("row", F.col("first").alias("lo"), (F.col("first") + F.col("n") + kind.width - 1).alias("hi")))
        apart.append(found.filter(f"kind = {APART}"))
        crowded = found.filter(f"kind = {CROWDED}")
        if not crowded.head(1):
            break
        ranges = _by_row(crowded, ["first", "n"], "ranges", n_buckets)
        source = read.join(ranges.hint("merge"), "row").select("row", "doc", "packed", "ranges")
    apart = apart[0] if len(apart) == 1 else materialize(_union(apart), "apart")
    found = _union([*gone, _compared(read, apart, kind, n_buckets)])
    return read, materialize_by(_by_row(found, ["lo", "hi"], "runs", n_buckets), "runs", "row", n_buckets, dealt=True)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
