"""Language-model scoring with a log-bilinear neural model, trained by noise-contrastive estimation.

The model predicts a *unit* from the two units before it: the most frequent words are units of their own, all other
words share units by their last letters.  Inside a shared unit a word has its smoothed share of the unit's training
tokens.  Units stand in classes of neighbouring frequency; the model gives a class its probability, and a unit its
probability inside the class, so token probabilities are normalised over a few hundred scores.  All training tokens are
counted, by a shuffle.  All of them are also trained on, in rounds that each take a share of the documents, dealt to
learners and put in order by a hash: every learner goes through the tokens of its rows in minibatches, with sampled noise,
by batched matrix products; what they have learned is averaged by Spark, weighted by tokens.  A learner with few tokens goes
through them several times.  How many learners there are follows from the tokens, so the model does not depend on how the
rows are partitioned.
Scoring reads every text once; what it needs of the words beyond the KNOWN most frequent ones comes by a join.

A row is a document; a null or blank text holds only the end token; repeated rows and ids are scored one by one; a null
id counts as an empty one when training documents are chosen.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import small
from .common import materialize, most_frequent

CLASSES, SIZE = 64, 128  #: classes, and units in each
UNITS = CLASSES * SIZE
SHARED = 64  #: units for all but the most frequent words
SINGLE = UNITS - SHARED  #: units that are one frequent word each
KNOWN = 1 << 18  #: most frequent words whose counts every task holds (2 MB)
WIDTH, NOISE, ROUNDS, RATE = 32, 12, 3, 0.08
BATCH = 1 << 13  #: tokens of a minibatch
LEARNER = 1 << 20  #: tokens that a learner gets in a round, about
LEAST = 500_000  #: ... and goes through again until it has taken so many
PART = 1 << 15  #: parameters that are averaged together
SCORED = 1 << 18  #: tokens that are scored together
BLOCK = 1 << 10  #: rows whose scores are in memory together
END = b"\n"  #: no word holds it
_CACHE = 200_000


class _Words(defaultdict):
    """Word -> number in this task, with the lists of hashes and shared units by number, which ``note`` completes."""

    def __init__(self) -> None:
        super().__init__(itertools.count().__next__)
        self.h: list[int] = []
        self.unit: list[int] = []

    def note(self) -> None:
        fresh = list(itertools.islice(self, len(self.h), None))
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh)) ^ np.uint64(1 << 63)
        self.h += h.view(np.int64).tolist()
        last = np.fromiter(map(zlib.crc32, [word[-2:] for word in fresh]), np.int64, len(fresh))
        self.unit += (SINGLE + last % SHARED).tolist()


def _tokens(batch: pa.RecordBatch, column: int, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens of a batch, and the offset of each text among them (one more than texts)."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(batch.column(column), "")))
    wordy = pc.not_equal(texts, "")
    split = pc.ascii_split_whitespace(texts.filter(wordy))
    sizes = np.ones(len(texts), np.int64)
    sizes[wordy.to_numpy(zero_copy_only=False)] += pc.list_value_length(split).to_numpy()
    offsets = np.append(0, np.cumsum(sizes))
    # a word is looked up once for all its places
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    numbers = np.full(offsets[-1], words[END])
    inner = np.ones(len(numbers), bool)
    inner[offsets[1:] - 1] = False
    numbers[inner] = np.fromiter(map(words.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
    words.note()
    return numbers, offsets


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def word_counts(train: DataFrame) -> DataFrame:
    """(h, unit, n) over all tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = _Words(), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"h": np.array(words.h, np.int64), "unit": np.array(words.unit, np.int32), "n": n})

        for batch in small(batches, 0):
            ids, _ = _tokens(batch, 0, words)
            fresh = np.bincount(ids, minlength=len(words.h)).astype(np.int64)
            fresh[: len(n)] += n
            n = fresh
            if len(n) > _CACHE:
                yield rows()
                words, n = _Words(), np.zeros(0, np.int64)
        if len(n):
            yield rows()

    return train.mapInArrow(count, "h long, unit int, n long").groupBy("h", "unit").agg(F.sum("n").alias("n"))


def _units(words: _Words, single: dict[int, int]) -> np.ndarray:
    return np.fromiter(map(single.get, words.h, words.unit), np.int64, len(words.h))


def _contexts(units: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units one and two places before each; UNITS stands before a text."""
    one = np.concatenate([[UNITS], units[:-1]])
    two = np.concatenate([[UNITS, UNITS], units[:-2]])[: len(units)]
    starts = offsets[:-1]
    one[starts] = two[starts] = UNITS
    two[starts[np.diff(offsets) > 1] + 1] = UNITS
    return one, two


def _split(p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Views: a unit's vector before a token, as a token, and as a class; the two positions' matrices; both biases."""
    shapes = ((UNITS + 1, WIDTH), (UNITS, WIDTH), (CLASSES, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (UNITS,), (CLASSES,))
    ends = np.cumsum([int(np.prod(x)) for x in shapes])
    return tuple(p[end - int(np.prod(x)) : end].reshape(x) for end, x in zip(ends, shapes, strict=True))


def start(mass: np.ndarray) -> np.ndarray:
    """Parameters that give each unit about its share of the training tokens."""
    rng = np.random.default_rng(7)
    n = (2 * UNITS + 1 + CLASSES) * WIDTH
    by_class = mass.reshape(CLASSES, SIZE).sum(axis=1)
    matrices = np.tile(np.eye(WIDTH).ravel() * 0.7, 2)
    return np.concatenate([rng.normal(0, 0.1, n), matrices, np.log(mass / np.repeat(by_class, SIZE)), np.log(by_class / by_class.sum())]).astype(np.float32)


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places of ``at``, which may repeat, and the sum of the rows of each."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # no place is above UNITS
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], np.add.reduceat(np.take(rows, order, axis=0), first, axis=0)


def _contrast(r: np.ndarray, target: np.ndarray, out: np.ndarray, bias: np.ndarray, q: np.ndarray, noise: np.ndarray, cuts: np.ndarray) -> tuple:
    """Slopes of the noise-contrastive objective: rows from ``cuts[i]`` to the next cut have the samples ``noise[i]`` of ``q``
    beside their targets.  Gives dr, (places, slopes) of ``out``, and those of ``bias``."""
    shift = (bias - np.log(NOISE * q)).astype(np.float32)
    dr = np.take(out, target, axis=0)
    right = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", r, dr) + shift[target], -30, 30)))
    dr *= right[:, None]
    parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    vectors = out[noise]
    wrong = np.repeat(shift[noise], np.diff(cuts), axis=0)
    for rows, v in zip(parts, vectors, strict=True):
        wrong[rows] += r[rows] @ v.T
    np.exp(np.negative(np.clip(wrong, -30, 30, out=wrong), out=wrong), out=wrong)
    wrong += 1
    np.divide(-1, wrong, out=wrong)
    slopes = np.empty_like(vectors)
    for i, rows in enumerate(parts):
        dr[rows] += wrong[rows] @ vectors[i]
        slopes[i] = wrong[rows].T @ r[rows]
    d_out = _summed(np.concatenate([target, noise.ravel()]), np.concatenate([right[:, None] * r, slopes.reshape(-1, WIDTH)]))
    d_bias = np.bincount(target, right, len(bias)) + np.bincount(noise.ravel(), np.add.reduceat(wrong, cuts[:-1], axis=0).ravel(), len(bias))
    return dr, d_out, d_bias


def learn(p: np.ndarray, squares: np.ndarray, unit: np.ndarray, one: np.ndarray, two: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> None:
    """One minibatch of NCE, for classes and for units inside each class, by AdaGrad in place.

    Vectors that the minibatch doesn't meet have no slope, and are not touched.
    """
    before, out, by_class, near, far, bias, class_bias = _split(p)
    order = np.argsort(unit.astype(np.uint16), kind="stable")
    unit, one, two = unit[order], one[order], two[order]
    group = unit // SIZE
    met, begun = np.unique(group, return_index=True)
    by = mass.reshape(CLASSES, SIZE)
    totals = by.sum(axis=1)
    draw = lambda q: np.minimum((np.cumsum(q, axis=1)[:, None] < rng.random((len(q), NOISE))[..., None]).sum(axis=2), q.shape[1] - 1)
    of_classes, of_units = (totals / totals.sum())[None], by / totals[:, None]
    first, second = np.take(before, one, axis=0), np.take(before, two, axis=0)
    r = first @ near + second @ far
    dr, d_class, d_class_bias = _contrast(r, group, by_class, class_bias, of_classes[0], draw(of_classes), np.array([0, len(r)]))
    more, d_out, d_bias = _contrast(r, unit, out, bias, of_units.ravel(), met[:, None] * SIZE + draw(of_units[met]), np.append(begun, len(r)))
    dr += more
    d_before = _summed(np.concatenate([one, two]), np.concatenate([dr @ near.T, dr @ far.T]))
    d_near, d_far = first.T @ dr, second.T @ dr
    every = slice(None)
    slopes = (d_before, d_out, d_class, (every, d_near), (every, d_far), (every, d_bias), (every, d_class_bias))
    for values, past, (at, slope) in zip(_split(p), _split(squares), slopes, strict=True):
        slope = (slope / len(unit)).astype(np.float32)
        now = past[at] + slope**2
        past[at] = now
        values[at] += RATE * slope / np.sqrt(now + 1e-8)


def _blocks(n: int) -> Iterator[slice]:
    return (slice(at, at + BLOCK) for at in range(0, n, BLOCK))


def _scores(r: np.ndarray, row: np.ndarray, vectors: np.ndarray, biases: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The score of vector ``at`` in each ``row`` of r."""
    found = biases[at]
    for x in _blocks(len(row)):
        found[x] += np.einsum("ij,ij->i", np.take(r, row[x], axis=0), np.take(vectors, at[x], axis=0))
    return found


def _log_sums(r: np.ndarray, vectors: np.ndarray, biases: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
    """log of the sum of exp(score) over all vectors, for each ``row`` of r (all, unless given)."""
    longest = np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max())
    to, ones, highest = vectors.T.copy(), np.ones(len(vectors), np.float32), np.abs(biases).max()
    found = np.empty(len(r) if row is None else len(row), np.float32)
    for x in _blocks(len(found)):
        some = r[x] if row is None else np.take(r, row[x], axis=0)
        s = some @ to
        s += biases
        # no score is larger than the product of lengths, and the bias; beyond 60 single precision needs a shift
        if longest * np.sqrt(np.einsum("ij,ij->i", some, some).max()) + highest < 60:
            found[x] = np.log(np.exp(s, out=s) @ ones)
        else:
            top = s.max(axis=1)
            s -= top[:, None]
            found[x] = np.log(np.exp(s, out=s) @ ones) + top
    return found


def log_probability(p: np.ndarray, unit: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """log10 P(unit | the two units before), normalised.

    Sums over classes are taken once for each distinct pair of units before, and those over a class's units once for each
    pair and class.
    """
    before, out, by_class, near, far, bias, class_bias = _split(p)
    pair, pairs = pd.factorize(two * (UNITS + 1) + one)
    r = np.take(before, pairs % (UNITS + 1), axis=0) @ near + np.take(before, pairs // (UNITS + 1), axis=0) @ far
    case, cases = pd.factorize(pair * CLASSES + unit // SIZE)
    of, group = cases // CLASSES, cases % CLASSES
    sums = (_scores(r, of, by_class, class_bias, group) - _log_sums(r, by_class, class_bias)[of]).astype(np.float64)
    order = np.argsort(group.astype(np.uint16), kind="stable")
    cuts = np.searchsorted(group[order], np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(cuts)):
        rows, own = order[cuts[c] : cuts[c + 1]], slice(c * SIZE, (c + 1) * SIZE)
        sums[rows] -= _log_sums(r, out[own], bias[own], of[rows])
    return (sums[case] + _scores(r, pair, out, bias, unit)) / np.log(10)


def _averaged(parts: DataFrame, key: str) -> DataFrame:
    """(part, ``key``) -> the mean of the vectors of each, weighted by n."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "learner"])  # the result does not depend on the order of rows
        total = sum(n * np.frombuffer(v, np.float32).astype(np.float64) for n, v in zip(pdf["n"], pdf["v"], strict=True))
        n = pdf["n"].sum()
        return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "learner": pdf["learner"].iloc[:1].to_numpy(), "n": [n], "v": [(total / n).astype(np.float32).tobytes()]})

    return parts.groupBy("part", key).applyInPandas(mean, "part int, learner int, n double, v binary")


def train_units(train: DataFrame, single: dict[int, int], mass: np.ndarray, n_tokens: int, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after ``rounds``, each over the documents of one share; what is gathered is one vector of them."""
    p = start(mass)
    groups = isqrt(n_tokens >> 20) + 1  #: learners are averaged in so many groups first
    spark = train.sparkSession
    dealt = train.withColumn("_h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    n_learners = max(1, round(n_tokens / rounds / LEARNER))

    def learners(model, take: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, q = _Words(), model.value
            single_, mass_, own = q["single"], q["mass"], q["p"].copy()
            squares, rng, n, held = np.zeros_like(own), np.random.default_rng(take), 0, []

            def go(unit: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
                order = rng.permutation(len(unit))
                for at in range(0, len(unit), BATCH):
                    i = order[at : at + BATCH]
                    learn(own, squares, unit[i], one[i], two[i], mass_, rng)

            for batch in small(batches, 0):
                ids, offsets = _tokens(batch, 0, words)
                units = _units(words, single_)[ids]
                tokens = (units, *_contexts(units, offsets))
                go(*tokens)
                n += len(units)
                if n < LEAST:
                    held.append(tokens)
                if len(words.h) > _CACHE:
                    words = _Words()
            if n:
                spent = n
                while spent < LEAST:
                    for tokens in held:
                        go(*tokens)
                    spent += n
                parts = [own[at : at + PART].tobytes() for at in range(0, len(own), PART)]
                me = int(squares.view(np.uint32).sum() % (1 << 31))  # the same whenever the task runs again
                yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(parts)), pa.int32()), "learner": pa.array([me] * len(parts), pa.int32()), "n": [float(n)] * len(parts), "v": pa.array(parts, pa.binary())})

        return run

    for take in range(rounds):
        model = spark.sparkContext.broadcast({"single": single, "mass": mass, "p": p})
        rows = dealt.filter(F.pmod(F.col("_h"), F.lit(rounds)) == take).withColumn("_to", F.pmod(F.xxhash64("_h"), F.lit(n_learners)).cast("int"))
        rows = rows.repartitionById(n_learners, "_to").sortWithinPartitions("_to", "_h").select("text", "_to")
        found = rows.mapInArrow(learners(model, take), "part int, learner int, n double, v binary")
        found = materialize(found.withColumn("few", F.pmod("learner", F.lit(groups))), "learned")
        means = sorted(_averaged(_averaged(found, "few").withColumn("all", F.lit(0)), "all").collect())  # one vector in parts
        p = np.concatenate([np.frombuffer(r["v"], np.float32) for r in means]) if means else p
    return p


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of op9, one row a document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col(text).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    train = docs.filter(~F.col("held_out")).select("text", "doc_id")
    counts = materialize(word_counts(train), "words")
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, "n", KNOWN).toPandas().sort_values(["n", "h"], ascending=[False, True])  # at most KNOWN rows
    single = {int(h): i for i, h in enumerate(top["h"][:SINGLE])}
    by_unit = {r["unit"]: r for r in counts.groupBy("unit").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # SHARED rows
    mass, kinds = np.zeros(UNITS), np.zeros(UNITS)
    for u, r in by_unit.items():
        mass[u], kinds[u] = r["n"], r["v"]
    for i, (unit, n) in enumerate(zip(top["unit"][:SINGLE], top["n"][:SINGLE], strict=True)):
        mass[unit] -= n
        kinds[unit] -= 1
        mass[i] = n
    inside = np.log10(mass + 0.5 * (kinds + 1))  # of shared units
    mass[:SINGLE] += np.where(mass[:SINGLE] > 0, 0.5, 1e-9)  # no word has the units that are left over
    mass[SINGLE:] += 0.5 * (kinds[SINGLE:] + 1)
    p = train_units(train, single, mass, n_tokens)
    top = top.sort_values("h")
    model = spark.sparkContext.broadcast({
        "single": single, "p": p, "inside": inside,
        "h": top["h"].to_numpy(np.int64), "n": top["n"].to_numpy(np.float64),
    })
    base_total = float(np.log10(n_tokens + 0.5 * (n_words + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        words = _Words()
        for batch in small(batches, 1):
            ids, offsets = _tokens(batch, 1, words)
            unit_of, h = _units(words, m["single"]), np.array(words.h, np.int64)
            at = np.minimum(np.searchsorted(m["h"], h), max(0, len(m["h"]) - 1))
            known = m["h"][at] == h if len(m["h"]) else np.zeros(len(h), bool)
            share = np.where(known, np.log10(np.where(known, m["n"][at] if len(m["h"]) else 0, 0) + 0.5), 0.0)
            units = unit_of[ids]
            one, two = _contexts(units, offsets)
            parts = [slice(at, at + SCORED) for at in range(0, len(units), SCORED)]
            likely = np.concatenate([log_probability(m["p"], units[x], one[x], two[x]) for x in parts]) + np.where(units >= SINGLE, share[ids] - m["inside"][units], 0.0)
            sums = lambda x: np.add.reduceat(x, offsets[:-1])
            rare = ~known[ids]
            cuts = np.concatenate([[0], np.cumsum(sums(rare.astype(np.int64)))]).astype(np.int32)
            sizes = np.diff(offsets)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "held_out": batch.column(2), "n_tokens": sizes, "n_known": sums(known[ids].astype(np.int64)),
                "base": sums(share[ids]) - sizes * base_total, "model": sums(likely.astype(np.float64)),
                "rare": pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[ids[rare]])),
            })
            if len(words.h) > _CACHE:
                words = _Words()

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    partial = docs.mapInArrow(run, f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<long>")
    partial = materialize(partial.withColumn("row", F.monotonically_increasing_id()), "scores")
    # the rest of the words: counted in training or not, each adds log10(n + 0.5) to both scores
    few = partial.select("row", F.explode("rare").alias("h")).join(counts.select("h", "n"), "h", "left")
    few = few.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("seen"))
    out = partial.drop("rare").join(few, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(int(n_tokens)).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))
