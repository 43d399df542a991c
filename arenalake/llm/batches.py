"""Arrow batches in Python tasks: bounded slices, and payloads dealt to buckets."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

SLICE = 4 << 20  #: bytes of the sized column in a slice, about


def small(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``size`` bytes of a string or binary column; a longer value stands alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            begun = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, begun + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int, least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of ``least`` rows or more, with a number for each row's key (the first ``n_keys`` integer columns), of a partition
    that is sorted by key: no key is in two tables."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def numbered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        keys = [table.column(i).to_numpy() for i in range(n_keys)]
        return table, np.cumsum(np.append(False, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= least:
            table, number = numbered(pa.Table.from_batches(held).combine_chunks())
            cut = int(np.searchsorted(number, number[-1]))  # the last key may go on
            if cut:
                yield table.slice(0, cut), number[:cut]
            held = table.slice(cut).to_batches()
            rows = len(table) - cut
    if rows:
        yield numbered(pa.Table.from_batches(held).combine_chunks())


def deal(bucket: np.ndarray, columns: list[np.ndarray], strings: list[bytes] | None = None, gap: bytes = b"") -> pa.RecordBatch:
    """(bucket, payload): the columns (byte by byte) and strings of each bucket, compressed together."""
    pack = zstandard.ZstdCompressor(level=3 if strings else 1)
    order = np.argsort(bucket, kind="stable")
    planes = [np.ascontiguousarray(c[order].astype(np.int64)).view(np.uint8).reshape(-1, 8) for c in columns]
    names, starts = np.unique(bucket[order], return_index=True)
    payloads = []
    for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
        text = gap.join([strings[i] for i in order[a:b].tolist()]) + gap if strings is not None else b""
        payloads.append(pack.compress(struct.pack("<q", b - a) + b"".join(p[a:b].T.tobytes() for p in planes) + text))
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(payloads, pa.binary())], names=["bucket", "payload"])


def buckets(batches: Iterator[pa.RecordBatch], n_columns: int) -> Iterator[tuple[int, list[np.ndarray], bytes]]:
    """Each bucket of a partition that is sorted by bucket, with its columns and joined strings."""
    unpack = zstandard.ZstdDecompressor()
    bucket, cols, texts = None, [], []
    for batch in batches:
        for b, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != bucket and cols:
                yield bucket, [np.concatenate(c) for c in zip(*cols, strict=True)], b"".join(texts)
                cols, texts = [], []
            bucket, raw = b, unpack.decompress(z)
            (n,) = struct.unpack_from("<q", raw)
            planes = np.frombuffer(raw, np.uint8, 8 * n * n_columns, 8).reshape(n_columns, 8, n)
            cols.append([np.ascontiguousarray(p.T).view(np.int64).reshape(-1) for p in planes])
            texts.append(raw[8 + 8 * n * n_columns :])
    if cols:
        yield bucket, [np.concatenate(c) for c in zip(*cols, strict=True)], b"".join(texts)
