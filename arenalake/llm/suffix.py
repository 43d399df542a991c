"""Substring deduplication on bytes by suffix arrays, built with the difference-cover algorithm.

Windows of 100 bytes meet in buckets by their anchors, the 32-byte grams with the smallest hashes in them (see
``windows``): copies of a string are settled by its hash and place; only anchors with different strings send texts, each
string once.  There the suffix array of a bucket's strings orders their windows: triples at two of three positions are
sorted and named, the names are sorted by recursion, the remaining third is merged in, and neighbours are compared over
100 bytes.  The sort is distributed by anchors, whose buckets are independent and bounded; names don't travel.

A window is removed if it also starts earlier: in a document with a smaller id, or further left in the same row.  Each
row is a document; null and short texts lose nothing; rows that share a doc_id are no smaller than each other, and a
null doc_id is larger than any other.  Windows never cross rows.  Long texts are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .windows import LAST, Kind, mix, repeats

WINDOW = 100
TEXT = 1 << 19  #: bytes of one suffix array, about; the strings of one anchor stay together
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))


def _ordered(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Numbers below 2**31 in threes -> one number each, in the same order."""
    if max(a.max(initial=0), b.max(initial=0), c.max(initial=0)) < 1 << 21:
        return (a << 42) | (b << 21) | c
    return (np.unique((a << 31) | b, return_inverse=True)[1].astype(np.int64) << 31) | c


def difference_cover(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers: triples, names, recursion, merge."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, np.int64)])
    tail = 1 if n % 3 == 1 else 0  # an empty suffix keeps the two residues apart
    ones, twos = np.arange(1, n + tail, 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    kinds, name = np.unique(_ordered(t[sample], t[sample + 1], t[sample + 2]), return_inverse=True)
    order = np.argsort(name) if len(kinds) == len(sample) else difference_cover(name.astype(np.int64) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    rest = sample[order]
    rest = rest[rest < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort((t[zero] << 31) | rank[zero + 1])]
    # a zero suffix's place among the others follows from a letter and a rank, or from two letters and a rank
    one, two = rest[rest % 3 == 1], rest[rest % 3 == 2]
    pair = lambda i: (t[i] << 31) | rank[i + 1]
    both = np.concatenate([two, zero])
    trio = _ordered(t[both], t[both + 1], rank[both + 2])
    at = np.searchsorted(pair(one), pair(zero)) + np.searchsorted(trio[: len(two)], trio[len(two) :]) + np.arange(len(zero))
    out = np.empty(n, np.int64)
    out[at] = zero
    free = np.ones(n, bool)
    free[at] = False
    out[free] = rest
    return out


def equal_windows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, group) of every window of the strings; equal windows, and only they, share a group."""
    text = np.frombuffer(b"\x00".join(strings) + b"\x00" * 8, np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.cumsum(sizes + 1) - sizes - 1
    body = len(text) - 8
    # bytes become 2.. and the gap between strings 1; zero stays for the end
    letters = text[:body] + 2
    letters[(starts + sizes)[:-1]] = 1
    array = difference_cover(letters)
    owner = np.repeat(np.arange(len(strings)), sizes + 1)[:body]
    offset = np.arange(body) - starts[owner]
    array = array[offset[array] <= sizes[owner[array]] - WINDOW]
    eight = text.copy()
    for i in (1, 2, 4):  # eight bytes in one number at every position
        eight[: len(eight) - i] = (eight[: len(eight) - i] << (8 * i)) ^ eight[i:]
    differs = np.zeros(len(array), bool)
    differs[:1] = True
    for i in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        word = eight[array + i]
        differs[1:] |= word[1:] != word[:-1]
    return owner[array], offset[array], np.cumsum(differs) - 1


def removals(strings: list[bytes], which: np.ndarray, doc: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, lo, hi): byte runs to remove; string ``which[i]`` stands at byte ``first[i]`` of ``row[i]``."""
    string, offset, group = equal_windows(strings)
    back = np.lexsort((offset, string))  # by string, then offset
    group_of = group[back]
    count = np.bincount(string, minlength=len(strings))
    begin = np.cumsum(count) - count
    order = np.argsort(which, kind="stable")
    least = np.full(len(strings), LAST)
    np.minimum.at(least, which, doc)
    lowest = np.full(int(group.max()) + 1, LAST)
    np.minimum.at(lowest, group_of, np.repeat(least, count))
    # every place of every window
    which, doc, row, first = which[order], doc[order], row[order], first[order]
    n = count[which]
    place = np.repeat(np.arange(len(which)), n)
    step = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    g = group_of[np.repeat(begin[which], n) + step]
    gone = doc[place] > lowest[g]
    own = np.flatnonzero(~gone)  # the smallest document: only a place further left in the same row counts
    p = place[own]
    by = np.lexsort((first[p] + step[own], row[p], g[own]))
    again = np.append(False, (g[own][by][1:] == g[own][by][:-1]) & (row[p][by][1:] == row[p][by][:-1])) if len(by) else np.zeros(0, bool)
    gone[own[by[again]]] = True
    hit = np.flatnonzero(gone)
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    cut = np.append(True, (np.diff(hit) > 1) | (place[hit[1:]] != place[hit[:-1]]))
    lo, hi = hit[cut], hit[np.append(cut[1:], True)]
    return row[place[lo]], first[place[lo]] + step[lo], first[place[hi]] + step[hi] + WINDOW


def _units(raw: bytes) -> np.ndarray:
    return _LETTERS[np.frombuffer(raw, np.uint8)]


def _cut(raw: bytes, first: np.ndarray, n: np.ndarray) -> list[bytes]:
    return [raw[a : a + k] for a, k in zip(first.tolist(), n.tolist(), strict=True)]


def _compare(columns: list[np.ndarray], text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, lo, hi) of a bucket, by suffix arrays of some TEXT bytes."""
    key, doc, row, first, n = columns
    ends = np.cumsum(n + WINDOW - 1)
    order = np.argsort(key, kind="stable")
    breaks = np.append(np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])), len(order))
    names: dict[bytes, int] = {}
    size, which, begun = 0, [], 0
    for a, b in zip(breaks[:-1].tolist(), breaks[1:].tolist(), strict=True):
        for i in order[a:b].tolist():
            s = text[ends[i] - n[i] - WINDOW + 1 : ends[i]]
            if s not in names:
                names[s] = len(names)
                size += len(s)
            which.append(names[s])
        if size > TEXT or b == len(order):
            o = order[begun:b]
            yield removals(list(names), np.array(which, np.int64), doc[o], row[o], first[o])
            begun, size, names, which = b, 0, {}, []


#: at most 69, 37, 5 and 1 windows share a minimiser
KIND = Kind(WINDOW, (32, 64, 96, WINDOW), True, _units, _cut, _compare, 1)


def runs(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((doc_id, doc, row, packed bytes), (row, byte runs to remove)) of the rows of ``docs``."""
    return repeats(docs, text, KIND, str.encode)


def keep(raw: bytes, spans: list) -> tuple[bytes, int]:
    """(the bytes outside the spans, number of maximal removed runs)."""
    out, at, n = [], 0, 0
    for lo, hi in sorted((r["lo"], r["hi"]) for r in spans):
        n += lo > at or at == 0
        if lo > at:
            out.append(raw[at:lo])
        at = max(at, hi)
    return b"".join(out) + raw[at:], n


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of op4, one row a document."""
    read, found = runs(docs, text)
    id_type = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = unpack.decompress(z)
                left, n = keep(raw, spans) if spans else (raw, 0)
                rows.append((len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = read.join(found.hint("merge"), "row", "left").select("doc_id", "packed", "runs")
    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
