"""Substring deduplication on word windows by super-k-mers.

A window is 13 consecutive words; its minimiser is the smallest hash among its three-word grams.  Consecutive windows
that share a minimiser form one string, a super-k-mer.  Super-k-mers meet in buckets by their minimisers (see
``windows``): copies are settled by the string's hash and place; only minimisers with different strings send words, each
string once and packed, and their bucket sorts the windows, by a fingerprint first, then word by word.  A window whose
words start in a document with a smaller id is repeated, and every word it covers goes.

Each row is a document; null and blank texts have no words; rows that share a doc_id are no smaller than each other, and
a null doc_id is larger than any other.  Windows never cross rows.  Long texts are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from .windows import Kind, mix, repeats

WINDOW = 13
_ODD = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)
_CACHE = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _units(raw: bytes) -> np.ndarray:
    words = raw.split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _cut(raw: bytes, first: np.ndarray, n: np.ndarray) -> list[bytes]:
    starts = np.append(0, np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1)
    starts = np.append(starts, len(raw) + 1)
    return [raw[a:b] for a, b in zip(starts[first].tolist(), (starts[first + n] - 1).tolist(), strict=True)]


def _compare(columns: list[np.ndarray], text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    _, doc, row, first, n = columns
    yield repeated(doc, row, first, n + WINDOW - 1, text.split())


#: at most 11, 6 and 1 windows share a minimiser
KIND = Kind(WINDOW, (3, 8, WINDOW), False, _units, _cut, _compare, 6, b"\n")


def repeated(doc: np.ndarray, row: np.ndarray, first: np.ndarray, size: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, ...]:
    """(row, from, to): word runs covered by windows that also start in a smaller doc, within each super-k-mer of a bucket."""
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    start = np.cumsum(size) - size
    count = size - WINDOW + 1
    owner = np.repeat(np.arange(len(size)), count)
    at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(len(owner))
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    mark = np.zeros(len(at), np.uint64)
    for j in range(WINDOW):
        mark += h[at + j] * _ODD[j]
    by_doc = np.argsort(doc, kind="stable")
    rank = np.empty(len(doc), np.int64)
    rank[by_doc] = np.arange(len(doc))
    order = np.lexsort((rank[owner], mark))
    while True:
        s = mark[order]
        new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))] if len(s) else order
        wrong = np.zeros(len(s), bool)
        twin = np.flatnonzero(~new)
        for j in range(WINDOW):
            wrong[twin] |= ids[at[order[twin]] + j] != ids[at[head[twin]] + j]
        if not wrong.any():
            break
        # equal fingerprints of different words: number the windows of such groups by their words
        again: dict[tuple, int] = {}
        clash = np.isin(mark, mark[order[wrong]])
        for i in np.flatnonzero(clash):
            mark[i] = again.setdefault(tuple(ids[at[i] : at[i] + WINDOW]), len(again))
        order = np.lexsort((rank[owner], mark))
    gone = np.zeros(len(at), bool)
    gone[order] = doc[owner[order]] > doc[owner[head]]
    # neighbouring windows of one super-k-mer make one run
    hit = np.flatnonzero(gone)
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    cut = np.append(True, (np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]]))
    lo, hi = hit[cut], hit[np.append(cut[1:], True)]
    place = lambda i: first[owner[i]] + at[i] - start[owner[i]]
    return row[owner[lo]], place(lo), place(hi) + WINDOW


def _plain(text: str) -> bytes:
    return b" ".join(text.encode().split())


def runs(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((doc_id, doc, row, packed words), (row, word runs to remove)) of the rows of ``docs``."""
    return repeats(docs, text, KIND, _plain)


def kept_words(words: list[bytes], spans: list) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int64)
    for r in spans:
        gone[r["lo"]] += 1
        gone[r["hi"]] -= 1
    return [w for w, g in zip(words, np.cumsum(gone), strict=False) if not g]


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of op7, one row a document."""
    read, found = runs(docs, text)
    id_type = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            n, gone, sha = [], [], []
            for z, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = unpack.decompress(z)
                words = raw.split()
                left = kept_words(words, spans) if spans else words
                n.append(len(words))
                gone.append(len(words) - len(left))
                sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return read.join(found.hint("merge"), "row", "left").select("doc_id", "packed", "runs").mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string")
