"""Filter interaction audit: what every filter of a chain removes, in every order of the chain.

A text is measured in one pass of a byte transducer: a table maps (state, byte) to the next state and to marks (word
begins, word ends, code point, capital, symbol).  Two states, between words and in a word, are enough, and the state after
a byte follows from that byte, so a slice of many texts is cut into lanes that run side by side, one table look-up a
step.  The words that the marks delimit go into an open-addressing hash table, where a word counts as known only if it
agrees with the slot's holder in text number, length and bytes; what is new in the table is a text's distinct words.

From there on only small rows move: copies are told by the SHA-256 of their text, and what fails is a bit mask, so the
whole audit of a part follows from its documents by mask (2 to the number of filters), however many orders there are.

Each row is a document.  A null text is empty; a null source is the part ''; a row with a null doc_id is never a copy (no
id is smaller) and has no labels; rows that share an id are no copies of each other, and a doc_id with several rows of
labels has a label if one of them has it.  An empty table has no parts and no rows.  Code points are the bytes that
continue no other, which for UTF-8 is what it says.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import small
from .windows import mix

BEGIN, END, POINT, CAPITAL, SYMBOL, INSIDE = 1, 2, 4, 8, 16, 256
LANES = 8192  #: of a slice, which the transducer runs through side by side
WIDE = 64  #: longer words are hashed and compared one by one
MEASURES = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]


def _transducer() -> np.ndarray:
    """(state | byte) -> next state (0 or INSIDE) | marks."""
    table = np.zeros((2, 256), np.uint16)
    for byte in range(256):
        gap = byte == 32 or 9 <= byte <= 13
        marks = (POINT if not 128 <= byte < 192 else 0) | (CAPITAL if 65 <= byte <= 90 else 0) | (SYMBOL if byte in b"#$%&*|" else 0)
        table[0, byte] = marks if gap else marks | BEGIN | INSIDE
        table[1, byte] = marks | END if gap else marks | INSIDE
    return table.reshape(-1)


TABLE = _transducer()


def transduce(raw: bytes) -> np.ndarray:
    """The marks of each byte; ``raw`` begins between words."""
    n = len(raw)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes) if n else 0
    grid = np.full(lanes * steps, 32, np.uint8)
    grid[:n] = np.frombuffer(raw, np.uint8)
    grid = grid.reshape(lanes, steps)
    at = np.zeros(lanes, np.uint16)
    if steps:
        at[1:] = TABLE[grid[:-1, -1]]  # the state after a byte doesn't depend on the state before it
    grid, marks = np.ascontiguousarray(grid.T), np.empty((steps, lanes), np.uint8)
    for j in range(steps):
        at &= INSIDE
        at |= grid[j]
        at = TABLE.take(at)
        marks[j] = at  # the low byte
    return np.ascontiguousarray(marks.T).reshape(-1)[:n]


class _Words:
    """Words of one buffer, as spans."""

    def __init__(self, raw: bytes, begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> None:
        self.raw, self.begin, self.n, self.text = raw, begin, end - begin, text
        self.eights = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each place on
        self.cut = np.append((np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1), ~np.uint64(0))
        self.hash = mix(text.astype(np.uint64)) ^ self.n.astype(np.uint64)
        for k in range(0, WIDE, 8):
            i = np.flatnonzero((self.n > k) & (self.n <= WIDE))
            if not len(i):
                break
            self.hash[i] = mix(self.hash[i] ^ self._piece(i, k))
        for i in np.flatnonzero(self.n > WIDE).tolist():
            self.hash[i] = np.uint64(xxhash.xxh3_64_intdigest(self._bytes(i), int(text[i])))

    def _piece(self, i: np.ndarray, k: int) -> np.ndarray:
        return self.eights[self.begin[i] + k] & self.cut[np.minimum(self.n[i] - k, 8)]

    def _bytes(self, i: int) -> bytes:
        return self.raw[self.begin[i] : self.begin[i] + self.n[i]]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b are equal, byte by byte, and of the same text."""
        out = (self.hash[a] == self.hash[b]) & (self.text[a] == self.text[b]) & (self.n[a] == self.n[b])
        for k in range(0, WIDE, 8):
            i = np.flatnonzero(out & (self.n[a] > k) & (self.n[a] <= WIDE))
            if not len(i):
                break
            out[i] = self._piece(a[i], k) == self._piece(b[i], k)
        for i in np.flatnonzero(out & (self.n[a] > WIDE)).tolist():
            out[i] = self._bytes(a[i]) == self._bytes(b[i])
        return out

    def new(self) -> np.ndarray:
        """Whether each word was new when it came into the table."""
        new = np.zeros(len(self.n), bool)
        room = 1 << max(4, int(2 * len(self.n)).bit_length())
        holder, slot, open_ = np.full(room, -1, np.int64), (self.hash & np.uint64(room - 1)).astype(np.int64), np.arange(len(self.n))
        while len(open_):
            s = slot[open_]
            free = holder[s] < 0
            holder[s[free]] = open_[free]  # of those that want a slot, one gets it
            held = holder[s]
            new[open_[held == open_]] = True
            left = np.flatnonzero(held != open_)
            left = left[~self.same(open_[left], held[left])]
            open_ = open_[left]
            slot[open_] = (slot[open_] + 1) & (room - 1)
        return new


def count(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The MEASURES of each text."""
    raw = b" ".join([*texts, b""])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    marks = transduce(raw)
    begin, end = np.flatnonzero(marks & BEGIN), np.flatnonzero(marks & END)
    text = np.searchsorted(ends, begin)
    found = {"n_words": np.bincount(text, minlength=len(texts)), "n_distinct": np.bincount(text[_Words(raw, begin, end, text).new()], minlength=len(texts))}
    for name, mark in (("n_capitals", CAPITAL), ("n_points", POINT), ("n_symbols", SYMBOL)):
        total = np.append(0, np.cumsum(marks & mark > 0))
        found[name] = total[ends] - total[ends - lengths]
    return found


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its MEASURES in place of the text."""
    kept = [c for c in docs.columns if c != text]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{m} long" for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, len(kept)):
            found = count([x or b"" for x in batch.column(len(kept)).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.array(found[m].astype(np.int64)) for m in MEASURES], names=[*kept, *MEASURES])

    return docs.select(*kept, F.col(text).cast("binary").alias(text)).mapInArrow(run, schema)


def filters() -> dict[str, Column]:
    """Filters by letter: the condition on which a document fails it, over the MEASURES and ``copy`` (a smaller id has the text)."""
    c = F.col
    return {
        "A": c("n_words") < 200,
        "B": 100 * c("n_distinct") < 50 * c("n_words"),
        "C": 100 * c("n_capitals") > 2 * c("n_points"),
        "D": c("n_symbols") > 0,
        "E": c("copy"),
    }


def masks(docs: DataFrame, labels: DataFrame, rules: dict[str, Column], text: str = "text", source: str = "source") -> DataFrame:
    """part, mask (bit i: fails the i-th rule), n, good, toxic: the documents by what they fail."""
    own = docs.select("doc_id", F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = measure(own.withColumn("h", F.unhex(F.sha2("text", 256))))
    # rows without an id meet no label: they are dealt out
    rows = rows.withColumn("lane", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("h", "part"), F.lit(1 << 20))).otherwise(0))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(known.withColumn("lane", F.lit(0).cast("long")), ["doc_id", "lane"], "left").fillna(False, ["good", "toxic"])
    # the rows of an id, then the ids of a text: a much-copied text sends a row a task, part and label
    per_text = ["h", "part", "good", "toxic"]
    per_id = rows.groupBy("doc_id", "lane", *per_text).agg(F.count("*").alias("n"), *(F.first(m).alias(m) for m in MEASURES))
    named = F.col("doc_id").isNotNull()
    texts = per_id.groupBy(*per_text).agg(F.sum("n").alias("n"), F.sum(F.when(~named, F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("least"), *(F.first(m).alias(m) for m in MEASURES))
    first = F.min("least.doc_id").over(Window.partitionBy("h"))  # a text has no more rows here than there are parts and labels
    texts = texts.withColumn("originals", F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.lit(False).alias("copy"), F.col("originals").alias("m")), F.struct(F.lit(True).alias("copy"), (F.col("n") - F.col("originals")).alias("m"))))
    texts = texts.select("part", "good", "toxic", *MEASURES, both.alias("x")).select("part", "good", "toxic", *MEASURES, "x.copy", "x.m").filter("m > 0")
    mask = sum((F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules.values())), F.lit(0))
    return texts.groupBy("part", mask.alias("mask")).agg(F.sum("m").alias("n"), F.sum(F.when(F.col("good"), F.col("m")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("m")).otherwise(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Column] | None = None, text: str = "text", source: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each
    part, order of the rules (a letter each, eight at most) and step."""
    rules = rules or filters()
    letters, k = list(rules), len(rules)
    cells = [F.sum(F.when(F.col("mask") == m, F.col(v)).otherwise(0)).alias(f"{v}{m}") for v in ("n", "good", "toxic") for m in range(1 << k)]
    parts = masks(docs, labels, rules, text, source).groupBy("part").agg(*cells)  # a row a part
    arrays = parts.select("part", *(F.array(*(F.col(f"{v}{m}") for m in range(1 << k))).alias(v) for v in ("n", "good", "toxic")))

    def total(values: str, test, weight=lambda m: F.lit(1)) -> Column:
        """Sum over the masks that pass the test."""
        return F.aggregate(F.sequence(F.lit(0), F.lit((1 << k) - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(test(m), F.element_at(values, m + 1) * weight(m)).otherwise(0))

    lined = arrays.select("*", F.explode(F.lit(["".join(o) for o in permutations(letters)])).alias("filter_order"))
    lined = lined.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bits = F.create_map(*(F.lit(x) for i, letter in enumerate(letters) for x in (letter, 1 << i)))
    earlier = F.filter(F.split(F.expr("left(filter_order, step - 1)"), ""), lambda x: x != "")
    lined = lined.withColumn("bit", bits[F.substr("filter_order", "step", F.lit(1))])
    lined = lined.withColumn("before", F.aggregate(earlier, F.lit(0), lambda a, x: a + bits[x]))
    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    return lined.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        F.element_at("n", bit + 1).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in as many orders
        total("n", fails, lambda m: (F.lit(factorial(k)) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(first_id < doc_id, false)::INT AS mask
      FROM w LEFT JOIN lab USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, a.bit AS b1, b.bit AS b2, c.bit AS b3, d.bit AS b4, e.bit AS b5
      FROM l a, l b, l c, l d, l e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, 1 AS step, b1 AS bit, 0 AS before FROM o UNION ALL SELECT filter_order, 2, b2, b1 FROM o UNION ALL SELECT filter_order, 3, b3, b1 | b2 FROM o
      UNION ALL SELECT filter_order, 4, b4, b1 | b2 | b3 FROM o UNION ALL SELECT filter_order, 5, b5, b1 | b2 | b3 | b4 FROM o),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER ((mask & (bit | before)) = 0), 0) AS kept,
             coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & before) = 0), 0) AS removed,
             coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & before) <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
             coalesce(sum(good) FILTER ((mask & bit) <> 0 AND (mask & before) = 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER ((mask & bit) <> 0 AND (mask & before) = 0), 0) AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
