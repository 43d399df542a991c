"""Quality rules on cross-document line frequency, in DataFrame expressions only.

Lines are normalised (lower case, digit runs as one 0, white space runs as one space) and hashed.  For every host the
number of distinct documents that hold a line is counted; copies of a document, told by a hash of all their normalised
lines in order, count once, so a much-copied document does not turn its own lines into boilerplate.  Lines in more
documents than the host's limit, a share of its distinct documents, are removed, and documents that lose most of their
words are rejected.

Each row is a document.  Null or blank texts have no words and fail the base rule; a null host is a host of its own;
repeated rows and ids get their own verdicts; extra columns pass through ``clean`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, few, let, materialize, words

MIN_DOCS = 10  #: a line is never boilerplate in fewer documents of its host
DOC_SHARE = 0.01  #: ... or in a smaller share of the host's documents
MIN_WORDS = 50  #: base rule: fewer words fail
MAX_REPEAT = 50  #: base rule: per cent of words in repeated three-word windows
MIN_KEPT = 0.3  #: a document that keeps a smaller share of its words is depleted
SPREAD = 1024  #: lists of a document's or host's boilerplate lines are looked up in so many parts
LISTED = 1 << 13  #: hosts without longer lists are looked up themselves, otherwise each document gets a list of its own


def _hash(line: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))
    return F.conv(F.substring(F.md5(plain), 1, 15), 16, 10).cast("long")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _repeat_words(w: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the text."""
    n = F.size(w)

    def covered(h: Column) -> Column:
        # equal windows are neighbours once sorted by (hash, place); the places of those with an equal neighbour, in order
        def twins(s: Column) -> Column:
            return F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"]))

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(ordered, twins)
        total = F.aggregate(places, F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(i - a["at"], F.lit(3))).alias("n")), lambda a: a["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(total)

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 4, 0).otherwise(let(windows, covered))


def measure(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host key, base figures, and the document's distinct line hashes with their words, one row a document."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select("doc_id", F.concat(F.lit("="), F.col(host)).alias("host"), t.alias("t"), words(t).alias("w"))
    base = base.withColumn("host", F.coalesce("host", F.lit("-")))
    wordy = F.filter(_lines(F.col("t")), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    per_line = F.transform(wordy, lambda line: F.struct(_hash(line).alias("h"), F.size(words(line)).alias("n")))
    out = base.select(
        "doc_id", "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size(wordy) - F.size(F.array_distinct(wordy))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        per_line.alias("lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def boilerplate(measured: DataFrame) -> DataFrame:
    """(host, h) of lines above their host's limit."""
    hashes = F.transform("lines", lambda x: x["h"])
    docs = measured.select("host", F.xxhash64(hashes).alias("doc"), F.array_distinct(hashes).alias("hashes"))
    hosts = docs.groupBy("host").agg(F.greatest(F.lit(MIN_DOCS), DOC_SHARE * F.countDistinct("doc")).alias("limit"))
    seen = docs.select("host", "doc", F.explode("hashes").alias("h"))
    counts = seen.groupBy("host", "h").agg(F.countDistinct("doc").alias("n_docs")).filter(F.col("n_docs") > MIN_DOCS)
    return counts.join(hosts, "host").filter(F.col("n_docs") > F.col("limit")).select("host", "h")


def _joined(left: DataFrame, hits: DataFrame) -> DataFrame:
    hits = hits.withColumnsRenamed({"doc_id": "_hit_id", "host": "_hit_host"})
    return left.join(hits, F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.col("host") == F.col("_hit_host")), "left").drop("_hit_id", "_hit_host")


def judge(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, the base figures, base_failed, n_kept_words after the removal of lines, and kept."""
    measured = materialize(measure(docs, text, host).withColumn("row", F.monotonically_increasing_id()), "quality")
    common = few(materialize(boilerplate(measured), "boilerplate"))
    lines = measured.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.h", "x.n")
    lost = lines.join(common, ["host", "h"]).groupBy("row").agg(F.sum("n").alias("lost"))
    out = measured.join(lost, "row", "left").withColumn("n_kept_words", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_kept_words") >= MIN_KEPT * F.col("n_words"))).drop("row", "host", "lines", "lost")


def clean(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` without boilerplate lines and without the documents that the rules reject; columns as they were.

    A line goes with its line break; a document that loses none keeps its text unchanged.
    """
    measured = materialize(measure(docs, text, host), "quality")
    common = materialize(boilerplate(measured), "boilerplate")
    n_hosts, most = common.groupBy("host").count().agg(F.count("*"), F.max("count")).first()
    by_host = (most or 0) <= LISTED and n_hosts * 8 * (SPREAD + (most or 0)) <= BROADCAST_BYTES
    if by_host:  # the texts stay where they are
        hits = common.groupBy("host").agg(F.collect_set("h").alias("common"))
    else:
        lines = measured.select("doc_id", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
        hits = lines.join(few(common), ["host", "h"]).groupBy("doc_id", "host").agg(F.collect_set("h").alias("common"))
    # in parts by the hash, so that many lines against many lines stay cheap
    part = lambda h: F.pmod(h, F.lit(SPREAD)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda i: F.filter("common", lambda h: part(h) == i))
    hits = hits.withColumn("common", F.when(F.size("common") > SPREAD // 16, parts).otherwise(F.array("common")))
    hits = materialize(hits, "lines")  # by document, Spark broadcasts it where it is below its own threshold
    own = docs.select(F.struct("*").alias("row"), "doc_id", F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("-")).alias("host"), F.col(text).alias("t"))

    def known(h: Column) -> Column:
        return F.array_contains(F.get("common", F.when(F.size("common") > 1, part(h)).otherwise(0)), h)

    rest = F.array_join(F.filter(_lines(F.col("t")), lambda line: ~let(_hash(line), known)), "\n")
    rest = F.when(F.col("common").isNull(), F.col("t")).otherwise(rest)

    def enough(w: Column) -> Column:
        return (F.size(w) >= MIN_WORDS) & (100 * _repeat_words(w) <= MAX_REPEAT * F.size(w)) & (F.size(words(rest)) >= MIN_KEPT * F.size(w))

    # let() keeps the words of a text evaluated once, also where the filter is pushed below the projection
    both = own.join(F.broadcast(hits), "host", "left") if by_host else _joined(own, hits)
    out = both.filter(let(words(F.col("t")), enough))
    return out.select(*(rest.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '-') AS host, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twin AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twin, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
line AS (SELECT r, host, line, i, ('0x' || md5(trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '))[1:15])::BIGINT AS h,
                len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
         FROM (SELECT r, host, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT r, host, string_split(t, chr(10)) AS l FROM d)) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM line GROUP BY r),
same AS (SELECT r, md5(string_agg(h::VARCHAR, ',' ORDER BY i)) AS doc FROM line GROUP BY r),
sk AS (SELECT host, h, doc FROM line JOIN same USING (r)),
lim AS (SELECT host, greatest(10, 0.01 * count(DISTINCT coalesce(doc, ''))) AS lim FROM d LEFT JOIN same USING (r) GROUP BY host),
common AS (SELECT host, h FROM (SELECT host, h, count(DISTINCT doc) AS n FROM sk GROUP BY host, h) JOIN lim USING (host) WHERE n > 10 AND n > lim),
lost AS (SELECT r, sum(n) AS n FROM line SEMI JOIN common USING (host, h) GROUP BY r),
base AS (SELECT d.doc_id, d.r, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
                length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
                coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
         FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (n_words - lost)::BIGINT AS n_kept_words,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)) AND (n_words - lost) >= 0.3 * n_words AS kept
FROM base
"""
