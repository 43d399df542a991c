"""N-gram Jaccard self-join by PartEnum signatures.

Sets of five-word shingles with |A & B| / |A | B| >= 0.75 differ in at most (|A| + |B|) / 7 elements.  The first pass has
PartEnum's smallest parameters, one second-level part: sets of one size band partition the shingle domain alike, and a
signature is a nonempty part with all the set's shingles in it.  Every difference spoils one part at most, so of the
parts in one order for all sets each set emits one more than |A| / 3.  The order puts parts that many documents share
last (shared passages), which changes the work but never the result: the lemma holds for any order.  Bands overlap so
that every pair within the size ratio has a band in common.

Sets that share a signature are candidates; equal sets are one node from the start.  First every member of a group is
verified against the group's first member (of about its size), which joins groups of near copies by stars.  Groups of up
to HOT members that still hold several components are compared where they meet.  The sets of larger groups, whatever
their number, are signed again, with second-level parts and all their subsets
(``enumerated``), which tells sets apart that have a passage in common.  What then still crowds, near copies about the
threshold, is signed by its rarest shingles (``prefixes``).  In all these groups members are first joined with their
nearest ones, so that few pairs of different components are left to compare.  Every pass is exact: no pair at the threshold is lost, and
members of one component are never paired.

Parities of the shingle counts in some cells bound the difference of two sets from below; a candidate that the bound
rules out is dropped before any words travel.

Each row is a document.  Null and blank texts have the empty set, which is linked with nothing; with fewer than five
words the whole sequence is the one shingle.  Repeated rows and ids are documents of equal sets.  Long texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import SLICE, small, whole_groups
from .common import few, materialize, most_frequent
from .graph import components

SHINGLE = 5
BAND = 8.0  #: each band starts at so many times the start of the one before
RATIO = 4 / 3  #: largest size ratio of similar sets
FINE = 2  #: the sets of so many smallest bands have their shingles as parts
SAMPLE = 8  #: one document in so many helps to find much-shared parts (for their order only)
SHARED = 400_000  #: much-shared parts that every task knows (3 MB)
ROWS = 1 << 20  #: signatures in a partition, about
HOT = 64  #: members of a group that are compared where they meet; sets of larger groups are enumerated
SECOND, SPOILT = 4, 2  #: enumeration: second-level parts, and how many of them may differ
NEAREST = 2  #: rounds in which members are joined with their nearest ones
STEP = 1.1  #: ratio of neighbouring size steps of the prefixes
COMPARED = 50_000  #: members that are compared in one go, in whole groups
PAIRS, WORDS = 1 << 20, 1 << 20  #: pairs, and words of their sketches, that are compared at once
BLOCK = 1024  #: members of a large group that are compared together
_CACHE = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], hashes: dict) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = [t.split() for t in texts]
    flat = [w for words in split for w in words]
    h = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
    n = max(0, len(h) - SHINGLE + 1)
    fives = _mix(sum((h[i : i + n] * _ODD[i] for i in range(SHINGLE)), np.zeros(n, np.uint64)))
    out, at = [], 0
    for words in split:
        end = at + len(words)
        if len(words) >= SHINGLE:
            out.append(np.unique(fives[at : end - SHINGLE + 1]))
        else:
            own = h[at:end]
            out.append(_mix((own * _ODD[: len(own)]).sum(keepdims=True) + np.uint64(len(own))) if len(own) else own)
        at = end
    return out


def bands(size: int) -> list[int]:
    """The one or two bands of a set's size: every pair within RATIO has one in common."""
    first = int(np.floor(np.log(size) / np.log(BAND) + 1e-9))
    # band b holds sizes from BAND**b to RATIO * BAND**(b + 1)
    return [first - 1, first] if first and size <= RATIO * BAND**first + 1e-6 else [first]


def differences(size: int) -> int:
    """Elements in which a set can differ from a similar one at most: (size + RATIO * size) / 7."""
    return size // 3


def signatures(h: np.ndarray, shared: np.ndarray | None) -> np.ndarray:
    """Signatures of a set; with ``shared`` (sorted) only as many as needed, those that are not shared first.

    The low six bits hold the size class, the others the band's part and all the set's shingles in it.
    """
    out = []
    k = differences(len(h)) + 1
    for band in bands(len(h)):
        if band < FINE:
            sig = _mix(h + np.uint64(band + 1))
        else:  # twice as many parts as the band's largest set has shingles
            part = (_mix(h + np.uint64(band + 1)) >> np.uint64(1)) % np.uint64(2 * RATIO * BAND ** (band + 1))
            at = np.argsort(part, kind="stable")
            p = part[at]
            starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            sig = _mix(np.add.reduceat(h[at] * _ODD[1], starts) + p[starts] * _ODD[0] + np.uint64(band))
        if len(sig) < k:  # at half a shingle a part, this has no chance worth a number
            raise ArithmeticError("a set has too few nonempty parts")
        sig &= ~np.uint64(63)
        if shared is not None and len(sig) > k:
            spot = np.minimum(np.searchsorted(shared, sig), max(0, len(shared) - 1))
            hot = shared[spot] == sig if len(shared) else np.zeros(len(sig), bool)
            sig = np.concatenate([np.sort(sig[~hot]), np.sort(sig[hot])])[:k]
        out.append(sig)
    return np.concatenate(out) | np.uint64(min(63, int(np.log(len(h)) / np.log(RATIO))))


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the shingle counts in 64 * 2**i cells, at least as many as shingles.

    Two sets differ in no fewer shingles than cells; a sketch of twice the cells folds to the smaller one.
    """
    words = 1 << max(2, int(np.ceil(np.log2(max(1, len(h)) / 64))))
    cell = h % np.uint64(64 * words)
    odd = np.bincount(cell.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)  # its halves, word by word, make the sketch of half the cells


def enumerated(h: np.ndarray) -> np.ndarray | None:
    """Enumerated subsets: FIRST-level parts of SECOND parts each, of which any SECOND - SPOILT form a signature.

    Sets sign in their own size class and the next one.  A pair differs in k elements at most, so of any k // (SPOILT + 1)
    + 1 first-level parts one is spoilt in SPOILT second-level parts at most, and one of its subsets is equal in both
    sets.  Empty subsets are left out; so a set takes more first-level parts, until those without an empty subset decide.
    Where they can't, the answer is None: such a set needs another way.
    """
    n, out = len(h), []
    own = int(np.floor(np.log(n) / np.log(RATIO) + 1e-9))
    for size_class in (own, own + 1):
        top = RATIO ** (size_class + 1)
        k = int((n + min(top, RATIO * n)) / 7 + 1e-9)
        parts = int(2 * top / 7) // (SPOILT + 1) + 1
        code = _mix(h + np.uint64(size_class + 101)) >> np.uint64(1)
        cell = ((code % np.uint64(parts)) * np.uint64(SECOND) + (code // np.uint64(parts)) % np.uint64(SECOND)).astype(np.int64)
        sums = np.zeros(parts * SECOND, np.uint64)
        np.add.at(sums, cell, h * _ODD[1])
        subsets = np.array(list(combinations(range(SECOND), SECOND - SPOILT)))
        full = np.bincount(cell, minlength=parts * SECOND).reshape(parts, SECOND)[:, subsets].sum(axis=2) > 0
        enough = np.flatnonzero(np.arange(1, parts + 1) - k // (SPOILT + 1) > np.cumsum(~full.all(axis=1)))
        if not len(enough):
            return None
        at = np.arange(enough[0] + 1)
        sig = sums.reshape(parts, SECOND)[at][:, subsets].sum(axis=2) + at[:, None].astype(np.uint64) * _ODD[0] + np.arange(len(subsets), dtype=np.uint64) * _ODD[2]
        out.append(_mix(sig[full[at]] + np.array([size_class], np.uint64) * _ODD[3]))
    return (np.concatenate(out) & ~np.uint64(63)) | np.uint64(min(63, own))


def size_step(size: np.ndarray | int) -> np.ndarray:
    return np.floor(np.log(size) / np.log(STEP) + 1e-9).astype(np.int64)


def prefixes(h: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Signatures of (shingle, size step): the set's first shingles by rank, unranked ones before, for every step of sizes
    from three quarters of its own on; of two similar sets the first common shingle is among them, at the smaller one's
    step.  The step's low six bits are the lowest of the group's key.
    """
    n = len(h)
    spot = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    place = np.where(known[spot] == h, rank[spot], 0) if len(known) else np.zeros(n, np.int64)
    ordered = h[np.lexsort((h, place))]
    out = []
    for s in range(int(size_step(-(-3 * n // 4))), int(size_step(n)) + 1):
        least = max(0.75 * n, STEP**s - 1e-6)
        first = ordered[: int(n - 3 * (n + least) / 7 + 1e-6) + 1]
        mixed = _mix(first + np.array([s], np.uint64) * _ODD[4] + np.uint64(7))
        out.append((mixed & ~np.uint64((1 << 12) - 1)) | np.uint64((s & 63) << 6))
    return np.concatenate(out)


def fitting(group: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, sketches: np.ndarray, ends: np.ndarray, step: np.ndarray, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group, but of different components and sides, whose sizes and sketches allow them to be similar.

    A row's sketch ends before ``ends`` in ``sketches``; a negative side is no side.  Where ``step`` is not
    negative, only pairs whose smaller set has that size step count: they have other groups of the same shingle as well.  ``nearest``: of each row's pairs with
    larger rows only the one whose sketches differ least.
    """
    width = np.diff(np.append(0, ends))
    order = np.lexsort((n, group))
    key = group[order] * (1 << 33) + n[order]
    upper = np.searchsorted(key, group[order] * (1 << 33) + 4 * n[order] // 3, side="right")
    count = upper - np.arange(len(order)) - 1
    total = np.append(0, np.cumsum(count))
    own_step = size_step(n) & 63
    out = [(np.zeros(0, np.int64),) * 2]
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(at, to), count[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[at:to] - total[at], count[at:to])
        i, j = order[i], order[j]
        other = (comp[i] != comp[j]) & ((side[i] < 0) | (side[i] != side[j])) & ((step[i] < 0) | (step[i] == own_step[i]))
        i, j = i[other], j[other]
        apart = np.empty(len(i), np.int64)
        for w in np.unique(width[i]).tolist():
            of = np.flatnonzero(width[i] == w)
            for part in np.array_split(of, max(1, len(of) * w // WORDS)):
                begin = lambda rows: (ends[rows] - width[rows])[:, None] + np.arange(w)
                theirs = sketches[begin(j[part])]
                wide = np.flatnonzero(width[j[part]] == 2 * w)  # a sketch of twice the width folds
                theirs[wide] ^= sketches[begin(j[part][wide]) + w]
                apart[part] = np.bitwise_count(sketches[begin(i[part])] ^ theirs).sum(axis=1)
        fit = 7 * apart <= n[i] + n[j]
        i, j, apart = i[fit], j[fit], apart[fit]
        if nearest and len(i):
            by = np.lexsort((apart, i))
            by = by[np.append(True, i[by[1:]] != i[by[:-1]])]
            i, j = i[by], j[by]
        out.append((i, j))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def _sampled(docs: DataFrame, text: str) -> DataFrame:
    """All signatures of one distinct text in SAMPLE, chosen by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in small(batches, 0):
            sets = shingle_sets([t.encode().lower() for t in batch.column(0).to_pylist()], hashes)
            sigs = [signatures(h, None) for h in sets if len(h)]
            if sigs:
                yield pa.RecordBatch.from_pydict({"sig": _signed(np.concatenate(sigs) & ~np.uint64(63))})

    chosen = docs.select(text).filter(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).filter(F.col(text).isNotNull())
    return chosen.dropDuplicates([text]).mapInArrow(run, "sig long")


def read_sets(docs: DataFrame, text: str, shared) -> DataFrame:
    """(doc_id, n, node, packed, sketch, sigs): set size, key of the set, compressed words, parities and signatures.

    ``shared``: a broadcast of the signatures to put last.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer = _Hashes(), zstandard.ZstdCompressor(level=3)
        for batch in small(batches, 1):
            texts = [(t or "").encode().lower() for t in batch.column(1).to_pylist()]
            sets = shingle_sets(texts, hashes)
            node = [int(_signed(_mix(_mix(h).sum(keepdims=True) + np.uint64(len(h))))[0]) if len(h) else None for h in sets]
            lists = [[_signed(signatures(h, shared.value)) if len(h) else np.zeros(0, np.int64) for h in sets], [sketch(h) for h in sets]]
            sigs, parities = (pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in a]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *a]), pa.int64())) for a in lists)
            columns = [batch.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(node, pa.int64()), pa.array([packer.compress(t) for t in texts], pa.binary()), parities, sigs]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "node", "packed", "sketch", "sigs"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {doc_type}, n long, node long, packed binary, sketch array<long>, sigs array<long>")


def _groups(sigs: DataFrame, partitions: int) -> DataFrame:
    """(sig, node, hub) of signatures that several nodes have: hub is the first of them in the node's size class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        sig, node = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in (0, 1))
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        key = sig >> 6
        new = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        several = (np.minimum.reduceat(node, first) != np.maximum.reduceat(node, first))[group]
        hub = node[np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))][np.cumsum(np.append(True, sig[1:] != sig[:-1])) - 1]
        yield pa.RecordBatch.from_pydict({"sig": sig[several], "node": node[several], "hub": hub[several]})

    return sigs.repartition(partitions, F.shiftright("sig", 6)).mapInArrow(run, "sig long, node long, hub long")


def _near(s_a: Column, s_b: Column, n_a: Column, n_b: Column) -> Column:
    """Sizes fit, and the sketches differ in no more cells than similar sets can differ in shingles."""

    def half(x: Column) -> Column:
        n = F.floor(F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))

    a = F.when(F.size(s_a) > F.size(s_b), half(s_a)).otherwise(s_a)
    b = F.when(F.size(s_b) > F.size(s_a), half(s_b)).otherwise(s_b)
    apart = F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, q: t + q)
    return (4 * F.least(n_a, n_b) >= 3 * F.greatest(n_a, n_b)) & (7 * apart <= n_a + n_b)


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) that ``_near`` doesn't rule out."""
    own = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.select("a", "b").join(own("a"), "a").join(own("b"), "b")
    return both.filter(_near(F.col("s_a"), F.col("s_b"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have 100 * intersection >= 75 * union, counted on the shingles themselves.

    The words of b travel to a; where a has many partners, they are split and a's words are sent along with each part.
    """
    pairs = materialize(pairs, "plausible")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / 200).alias("splits"))
    pairs = materialize(pairs.join(many, "a").select("a", "b", F.pmod(F.hash("b"), F.col("splits")).cast("int").alias("salt")), "pairs")
    nodes = few(materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes"))
    own = sets.select("node", "packed").join(nodes, "node", "left_semi")
    heads = pairs.select("a", "salt").distinct().join(own.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "packed")
    rows = pairs.join(own.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "packed").unionByName(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpacker = _Hashes(), zstandard.ZstdDecompressor()
        at, mine = None, None
        for batch in small(batches, 2, SLICE // 3):
            a_, b_ = [], []
            sets_ = shingle_sets([unpacker.decompress(z) for z in batch.column(2).to_pylist()], hashes)
            for a, b, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_, strict=True):
                if b is None:
                    at, mine = a, other
                    continue
                assert a == at, "a's own words come first"
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= 75 * (len(mine) + len(other) - both):
                    a_.append(a)
                    b_.append(b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a_, pa.int64()), "b": pa.array(b_, pa.int64())})

    dealt = rows.repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.select("a", "b", "packed").mapInArrow(run, "a long, b long")


def _apart(groups: DataFrame, known: DataFrame) -> DataFrame:
    """(key, node, m): groups of m members that hold several components; of the groups with the same members one."""
    members = groups.select(F.shiftright("sig", 6).alias("key"), "node").distinct().join(few(known.select("node", "comp")), "node")
    same = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("all")]
    apart = members.groupBy("key").agg(*same).filter("lo < hi")
    apart = apart.groupBy("lo", "hi", "m", "all").agg(F.min("key").alias("key")).select("key", "m")
    return members.join(apart, "key").select("key", "node", "m")


def _signed_sets(sets: DataFrame, chosen: DataFrame, sign) -> DataFrame:
    """(sig, node) of the chosen nodes, by ``sign`` (shingles -> signatures); a null sig where it gives None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpacker = _Hashes(), zstandard.ZstdDecompressor()
        for batch in small(batches, 1, SLICE // 3):
            sets_ = shingle_sets([unpacker.decompress(z) for z in batch.column(1).to_pylist()], hashes)
            sigs = [sign(h) for h in sets_]
            weak = np.array([sig is None for sig in sigs], bool)
            sizes = [1 if sig is None else len(sig) for sig in sigs]
            flat = np.concatenate([np.zeros(0, np.uint64), *(np.zeros(1, np.uint64) if sig is None else sig for sig in sigs)])
            yield pa.RecordBatch.from_pydict({"sig": pa.array(_signed(flat), pa.int64(), mask=np.repeat(weak, sizes)), "node": np.repeat(batch.column(0).to_numpy(), sizes)})

    return sets.join(few(chosen), "node", "left_semi").select("node", "packed").mapInArrow(run, "sig long, node long")


def _prefixed(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """(sig, node) by prefixes: the chosen nodes' rarest shingles, as many as a similar set of each size can miss."""

    def shingles(h: np.ndarray) -> np.ndarray:
        return h

    often = _signed_sets(sets, chosen, shingles).groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    often = most_frequent(materialize(often, "crowded"), "n", SHARED).toPandas().sort_values(["n", "sig"])  # at most SHARED rows
    keys = often["sig"].to_numpy(np.int64).view(np.uint64)
    by_key = np.argsort(keys)
    order = sets.sparkSession.sparkContext.broadcast((keys[by_key], (by_key + 1).astype(np.int64)))
    return _signed_sets(sets, chosen, lambda h: prefixes(h, *order.value))


def _compare(rows: DataFrame, known: DataFrame, nearest: bool) -> DataFrame:
    """(a, b): members of one group and different components that are ``fitting``; large groups meet in blocks.

    ``nearest``: each member with its nearest one in one group, its largest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, 3, COMPARED):
            key, i, j, own, stepped, node, n, comp = (rows.column(c).to_numpy() for c in range(8))
            sketches = rows.column(8).combine_chunks()
            flat, ends = sketches.flatten().to_numpy().view(np.uint64), np.cumsum(sketches.value_lengths().to_numpy())
            a, b = fitting(group, n, comp, np.where(i != j, own, -1), flat, ends, np.where((stepped > 0) & (not nearest), key & 63, -1), nearest)
            pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]), axis=1)
            yield pa.RecordBatch.from_pydict({"a": pairs[0], "b": pairs[1]})

    if nearest:
        rows = rows.join(rows.groupBy("node").agg(F.max_by("key", F.struct("m", "key")).alias("key")), ["node", "key"])
    dealt = rows.join(few(known), "node").select("key", "i", "j", "own", "stepped", "node", "n", "comp", "sketch")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (node, n, comp) with the components that the links join."""
    for side in "ab":
        own = few(known.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}")))
        links = links.join(own, side)
    comps = components(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).filter("a <> b").distinct())
    comps = few(comps.withColumnsRenamed({"comp": "top", "node": "comp"}))
    return materialize(known.join(comps, "comp", "left").select("node", "n", F.coalesce("top", "comp").alias("comp")), "known")


def join(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links), one row a document."""
    spark = docs.sparkSession
    often = materialize(_sampled(docs, text).groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    often = most_frequent(often, "n", SHARED).select("sig").toPandas()["sig"].to_numpy(np.int64)  # at most SHARED rows
    shared = spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))

    read = materialize(read_sets(docs, text, shared).withColumn("row", F.monotonically_increasing_id()), "sets")
    nodes = materialize(read.filter("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.first("n").alias("n")), "nodes")
    sets = read.join(few(nodes.select("row")), "row", "left_semi").select(F.col("row").alias("node"), "packed", "n", "sketch", "sigs")

    total = nodes.agg(F.sum(F.floor(F.col("n") / 3) + 1)).first()[0] or 0
    partitions = max(spark.sparkContext.defaultParallelism, -(-total // ROWS))
    groups = materialize(_groups(sets.select(F.explode("sigs").alias("sig"), "node"), partitions), "groups")
    stars = materialize(groups.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    known = nodes.select(F.col("row").alias("node"), "n", F.col("row").alias("comp"))
    known = _merged(known, materialize(verified(_plausible(stars, sets), sets), "links"))
    members = materialize(_apart(groups, known), "members")

    # sets in groups of more than HOT members are told apart by enumerated subsets, then by prefixes
    crowds = materialize(members.filter(F.col("m") > HOT), "crowds")
    members = members.filter(F.col("m") <= HOT).withColumn("stepped", F.lit(0))
    if crowds.head(1):
        for level, sign in enumerate((lambda chosen: _signed_sets(sets, chosen, enumerated), lambda chosen: _prefixed(sets, chosen))):
            chosen = materialize(crowds.select("node").distinct(), "crowd")
            sigs = materialize(sign(chosen), "signatures")
            found = materialize(_apart(_groups(sigs.filter("sig is not null"), partitions), known), "members").withColumn("stepped", F.lit(level))
            if level:
                members = members.unionByName(found)
                break
            members = members.unionByName(found.filter(F.col("m") <= HOT))
            weak = sigs.filter("sig is null").select(F.lit(0).cast("long").alias("key"), "node", F.lit(0).cast("long").alias("m"))
            crowds = found.drop("stepped").filter(F.col("m") > HOT).unionByName(weak)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = members.withColumn("own", F.pmod(F.hash("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "stepped", "m", "node").join(sets.select("node", "sketch"), "node")
    rows = materialize(rows, "rows")
    # every member's nearest pair first, some times: that joins most of what is to be joined and leaves few pairs to all
    for nearest in (*[True] * NEAREST, False):
        rest = materialize(_compare(rows, known, nearest).join(stars, ["a", "b"], "left_anti"), "rest")
        if rest.head(1):
            stars, known = stars.unionByName(rest), _merged(known, materialize(verified(rest, sets), "links"))

    comps = known.select(F.col("node").alias("row"), "comp")
    joined = nodes.join(comps, "row")
    least = joined.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = few(materialize(joined.join(least, "comp").select("node", "component_id"), "classes"))
    out = read.select("doc_id", "n", "node").join(classes, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def dedupe(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest doc_id; rows that share that id stay together.

    A component without any id stays whole.
    """
    gone = join(docs, text).filter("component_id < doc_id or (doc_id is null and component_id is not null)").select(F.col("doc_id").alias("_gone_id")).distinct()
    gone = few(materialize(gone, "gone"))
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"))
    return row.join(gone, F.col("_id").eqNullSafe(F.col("_gone_id")), "left_anti").select(*(F.col("_row")[c].alias(c) for c in docs.columns))
