"""Benchmark decontamination by a hash set of normalised test n-grams, in DataFrame expressions only.

A window is 13 consecutive words of an item (a shorter item is one window).  From every window of L words the grams of
L - s + 1 words at its first s = L / 2 places go into the hash set, so documents need to be probed at every s-th word
only: any occurrence of the window covers one probed gram.  Probe rows carry an id, a place and a hash, never a text.
Hits are then verified word by word against the document, and covered words, items and spans follow from that.

Each row of ``docs`` is a document; null or blank texts have no words; ids play no part in the search.  Benchmark rows without an id or words are no items; rows that share an id are one item.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, let, materialize

WINDOW = 13
SHARE = 20  #: contaminated from one hit word in so many on
ROW_BYTES = 400  #: of a gram with its window, and of a hit, in memory about
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _GAP + "+"), lambda w: w != "")


def _lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _stride(length: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length / 2)).cast("int")


def hash_set(benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """(h, back, item, window): gram hashes, how far before the gram its window starts, and the window's words.

    Hashes are taken of the words that the verification compares, lower-cased in A-Z only.
    """
    both = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), _words(_lowered(F.col(text))).alias("w"))
    size = F.least(F.lit(WINDOW), F.size("w"))
    windows = both.filter(F.size("w") > 0).select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    s = _stride(F.col("size"))
    grams = windows.select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("window"), "w", "at", s.alias("s"), F.explode(F.sequence(F.lit(0), s - 1)).alias("back"))
    gram = F.slice("w", F.col("at") + F.col("back"), F.col("size") - F.col("s") + 1)
    return grams.select(F.xxhash64("size", gram).alias("h"), "back", "item", "window").distinct()


def _key(text: str) -> Column:
    """Rows with equal texts are verified together, whatever their ids: a hash of the text, null where there is none."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))


def _candidates(docs: DataFrame, grams: DataFrame, text: str) -> DataFrame:
    """(_key, _found): per text the windows whose gram occurs, with the place where the window would start."""
    sizes = sorted(r[0] for r in grams.select(F.size("window")).distinct().collect())  # 13 values at most

    def grams_of(w: Column, size: int) -> Column:
        s = max(1, size // 2)
        k = size - s + 1
        at = F.sequence(F.lit(0), F.floor((F.size(w) - k) / s).cast("int"))
        each = F.transform(at, lambda i: F.struct((i * s).alias("at"), F.xxhash64(F.lit(size), F.slice(w, i * s + 1, F.lit(k))).alias("h")))
        return F.when(F.size(w) >= k, each).otherwise(none)

    none = F.expr("cast(array() as array<struct<at:int,h:bigint>>)")
    probes = lambda w: F.concat(none, *(grams_of(w, size) for size in sizes))
    # generated once a text: the words live in a lambda variable
    rows = docs.select(_key(text).alias("_key"), F.explode(let(_words(_lowered(F.col(text))), probes)).alias("p")).select("_key", "p.at", "p.h")
    hits = rows.join(few(grams, ROW_BYTES), "h")
    one = F.struct((F.col("at") - F.col("back")).alias("at"), "item", "window")
    return hits.filter("at >= back").groupBy("_key").agg(F.collect_set(one).alias("_found"))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """(_row, _text, _n_words, _hits): the rows of ``docs`` as structs, and verified (at, size, item), sorted; null where
    nothing was found."""
    grams = materialize(hash_set(benchmark, text, item), "grams")
    found = few(materialize(_candidates(docs, grams, text), "hits"), 4 * ROW_BYTES)
    joined = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), _key(text).alias("_key")).join(found, "_key", "left")

    def verified(w: Column) -> Column:
        true = F.filter("_found", lambda c: F.slice(w, c["at"] + 1, F.size(c["window"])) == c["window"])
        return F.array_sort(F.transform(true, lambda c: F.struct(c["at"].alias("at"), F.size(c["window"]).alias("size"), c["item"].alias("item"))))

    hits = F.when(F.col("_found").isNotNull(), let(_words(_lowered(F.col("_text"))), verified))
    return joined.select("_row", "_text", F.size(_words(F.col("_text"))).alias("_n_words"), hits.alias("_hits"))


def _n_hit(hits: Column) -> Column:
    """Words covered by sorted (at, size) runs."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        end = F.greatest(a["end"], x["at"] + x["size"])
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], F.least(x["at"], end))).alias("n"))

    return F.coalesce(F.aggregate(hits, start, step, lambda a: a["n"]), F.lit(0))


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of op6, one row a document."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    items = F.coalesce(F.sort_array(F.array_distinct(F.transform("_hits", lambda x: x["item"]))), F.array().cast("array<string>"))
    out = found.select("_row.doc_id", F.col("_n_words").cast("long").alias("n_words"), _n_hit(F.col("_hits")).cast("long").alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents; from the others the hit words go, with the gap before each."""
    found = scan(docs, benchmark, text)
    kept = found.filter(~_contaminated(_n_hit(F.col("_hits")), F.col("_n_words")))
    word = f"{_GAP}*+[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]++"

    def cut(tokens: Column) -> Column:
        # the tokens between the hits, run by run: hits are sorted by their starts
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(a: Column, h: Column) -> Column:
            gap = F.array_join(F.slice(tokens, a["at"] + 1, F.greatest(h["at"] - a["at"], F.lit(0))), "")
            return F.struct(F.greatest(a["at"], h["at"] + h["size"]).alias("at"), F.concat(a["out"], gap).alias("out"))

        rest = F.aggregate("_hits", start, step, lambda a: F.concat(a["out"], F.array_join(F.slice(tokens, a["at"] + 1, F.greatest(F.size(tokens) - a["at"], F.lit(0))), "")))
        return F.concat(rest, F.regexp_extract("_text", f"{_GAP}*$", 0))

    rest = F.when(F.size("_hits") > 0, let(F.regexp_extract_all("_text", F.lit(word), F.lit(0)), cut)).otherwise(F.col("_text"))
    return kept.select(*(rest.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns))


SQL = r"""
WITH lo AS (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM lo),
bs AS (SELECT item_id, w, least(13, len(w)) AS l FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM bs)),
dw AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
occ AS (SELECT r, i, l, item_id FROM dg JOIN win USING (l, g)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + l)) AS p FROM occ) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
