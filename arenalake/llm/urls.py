"""URL filters: rules first, then host segmentation and naive Bayes.

A unigram model from a corpus (all words of all its texts) lets a Viterbi search split the labels of a host into words.
Multinomial naive Bayes over those words and the path's tokens is trained on every url that a rule decides, and judges
the others.  Words and tokens stay in tables: what labels and urls use most is looked up by broadcast, the rest by a
shuffle, and equal urls, hosts and labels are handled once.

Each row of ``pages`` is a page.  A null url, or one without ``://``, has an empty host and path, fits no rule and is
judged by the class priors; an empty host with a path is judged by its path.  A tie of the classes is allowed.  Repeated
rows are judged one by one; extra columns pass through ``judge``.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, materialize, most_frequent

#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest that fits wins.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
VOCABULARY = 50_000  #: parts of labels that are looked up by broadcast, the most used ones
FEATURES = 100_000  #: tokens that are looked up by broadcast, the most used ones
ROW_BYTES = 512  #: of a host or url with its tokens in memory, about
UNIT = 10**9  #: scores are whole numbers of this part, so that sums don't depend on their order
_FLUSH = 300_000


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, r"://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest comes last and so is tried first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(verdict)
    return name, verdict


def unigrams(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all words of a-z in all texts; every text is counted whole."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(re.findall("[a-z]+", (t or "").lower()))
                if len(seen) > _FLUSH:
                    yield rows()
        yield rows()

    counts = corpus.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counts, "unigrams")


def _looked_up(rows: DataFrame, key: str, table: DataFrame, limit: int) -> DataFrame:
    """``rows`` that have a row in ``table``, with its columns; the ``limit`` keys that rows use most, in the table or not,
    are broadcast, so none of them meets in one task."""
    used = rows.groupBy(key).agg(F.count("*").alias("_uses")).join(table.withColumn("_found", F.lit(True)), key, "left")
    used = materialize(used, "used")
    head = F.broadcast(most_frequent(used, "_uses", limit))
    often = rows.join(head, key).filter("_found")
    seldom = rows.join(head.select(key), key, "left_anti").join(used.filter("_found"), key)
    return often.unionByName(seldom).drop("_uses", "_found")


def _joined(left: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(few(table, ROW_BYTES), keys, "left")


def segment(name: str, model: dict[str, float]) -> list[str]:
    """The most probable split of a name into words; an unknown word of n letters costs as 1 in total * 10**(n - 1).

    Of equal splits the one whose last words are longest wins.  The best unknown word that ends at a place follows from a
    running maximum, so words of any length are weighed in one step a place and length of a known word.
    """
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    unknown, lengths = model.get("", 0.0), sorted({len(w) for w in model} - {0}, reverse=True)
    reach, reach_at = -math.inf, 0  # the best start of an unknown word, which costs 1 a letter
    for end in range(1, len(name) + 1):
        if best[end - 1] + end - 1 > reach:
            reach, reach_at = best[end - 1] + end - 1, end - 1
        p, at = reach - unknown - (end - 1), reach_at
        for n in lengths:
            if n <= end and (q := model.get(name[end - n : end])) is not None:
                q += best[end - n]
                if q > p or (q == p and end - n < at):
                    p, at = q, end - n
        best[end], back[end] = p, at
    words, at = [], len(name)
    while at:
        words.append(name[back[at] : at])
        at = back[at]
    return words[::-1]


def _pieces(names: DataFrame, lengths: list[int]) -> DataFrame:
    """(part, word): the distinct substrings of each name that are as long as some word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, word = [], []
        rows = lambda: pa.RecordBatch.from_pydict({"part": pa.array(part, pa.string()), "word": pa.array(word, pa.string())})
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for n in lengths:
                    if n > len(name):
                        break
                    found = {name[a : a + n] for a in range(len(name) - n + 1)}
                    part += [name] * len(found)
                    word += found
                    if len(word) > _FLUSH:
                        yield rows()
                        part, word = [], []
        yield rows()

    return names.select("part").mapInArrow(run, "part string, word string")


def host_tokens(hosts: DataFrame, corpus_words: DataFrame) -> DataFrame:
    """(host, of_host) of distinct hosts: the segmented words of the labels, and the last label; digit runs count by their
    length."""
    total = math.log10(corpus_words.agg(F.sum("n")).first()[0] or 1)

    @F.pandas_udf("array<string>")
    def segmented(names: pd.Series, known: pd.Series) -> pd.Series:
        models = ({w["word"]: math.log10(w["n"]) - total for w in (k if k is not None else ())} for k in known)
        return pd.Series([segment(s, m | {"": total}) for s, m in zip(names, models, strict=True)])

    @F.pandas_udf("array<string>")
    def together(names: pd.Series, parts: pd.Series) -> pd.Series:
        def one(host: str, split: dict[str, list[str]]) -> list[str]:
            *labels, last = host.split(".")
            runs = [r for label in labels for r in re.findall("[a-z]+|[0-9]+", label)]
            return [f"h:{w}" for r in runs for w in (split[r] if r.isalpha() else [f"#{len(r)}"])] + [f"t:{last}"]

        return pd.Series([one(h, {x["part"]: list(x["words"]) for x in (p if p is not None else ())}) for h, p in zip(names, parts, strict=True)])

    runs = F.array_distinct(F.regexp_extract_all(F.regexp_replace("host", r"(^|\.)[^.]*$", ""), F.lit("[a-z]+"), F.lit(0)))
    parts = materialize(hosts.select("host", F.explode(runs).alias("part")), "parts")
    names = parts.select("part").distinct()
    lengths = sorted(r[0] for r in corpus_words.select(F.length("word")).distinct().collect())  # some hundreds
    found = _looked_up(_pieces(names, lengths), "word", corpus_words, VOCABULARY)
    found = found.groupBy("part").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    words = materialize(names.join(found, "part", "left").select("part", segmented("part", "known").alias("words")), "segments")
    split_hosts = _joined(parts, words, ["part"]).groupBy("host").agg(F.collect_list(F.struct("part", "words")).alias("parts"))
    return hosts.join(split_hosts, "host", "left").select("host", together("host", "parts").alias("of_host"))


def path_tokens(path: Column) -> Column:
    """The path's words; digit runs count by their length."""

    @F.pandas_udf("array<string>")
    def found(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: [f"p:#{len(w)}" if w.isdigit() else f"p:{w.lower()}" for w in re.findall(r"[^\W_]+", p)])

    return found(path)


def judge(pages: DataFrame, corpus: DataFrame, url: str = "url", text: str = "text", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (replaced where such columns are there)."""
    host, path = split(F.col(url))
    parsed = pages.withColumns({"host": host, "path": path})
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    decided = parsed.withColumns({"rule": rule, "verdict": verdict})

    urls = materialize(decided.groupBy("host", "path", "verdict").agg(F.count("*").alias("n")), "urls")
    hosts = materialize(urls.filter("host <> ''").select("host").distinct(), "hosts")
    split_hosts = materialize(host_tokens(hosts, unigrams(corpus, text)), "split")
    words = F.concat(F.coalesce("of_host", F.array().cast("array<string>")), path_tokens(F.col("path")))
    urls = materialize(_joined(urls, split_hosts, ["host"]).select("host", "path", "verdict", "n", words.alias("tokens")), "tokens")

    priors = {r[0]: r[1] for r in urls.groupBy("verdict").agg(F.sum("n")).collect()}
    counts = urls.filter("verdict is not null").select(F.explode("tokens").alias("token"), (F.col("verdict") == "block").alias("bad"), "n")
    counts = counts.groupBy("token").agg(*(F.sum(F.when(F.col("bad") == bad, F.col("n")).otherwise(0)).alias(k) for k, bad in (("block", True), ("allow", False))))
    counts = materialize(counts, "counts")
    sums = counts.agg(F.count("*").alias("size"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("block", "allow"))).first()
    rest = round(UNIT * math.log((sums["allow"] + sums["size"] + 1) / (sums["block"] + sums["size"] + 1)))  # a token without evidence, with add-one smoothing
    prior = round(UNIT * math.log((priors.get("block", 0) + 1) / (priors.get("allow", 0) + 1)))

    open_ = urls.filter("verdict is null and size(tokens) > 0")
    odds = counts.select("token", F.round(UNIT * (F.log(F.col("block") + 1) - F.log(F.col("allow") + 1))).cast("long").alias("odds"))
    seen = _looked_up(open_.select("host", "path", F.explode("tokens").alias("token")), "token", odds, FEATURES).select("host", "path", "odds")
    unseen = open_.select("host", "path", (F.size("tokens").cast("long") * F.lit(rest)).alias("odds"))
    scores = materialize(seen.unionByName(unseen).groupBy("host", "path").agg(F.sum("odds").alias("_score")), "scores")
    out = _joined(decided, scores, ["host", "path"])
    judged = F.when(F.coalesce("_score", F.lit(0)) + F.lit(prior) > 0, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("verdict", judged)).select(*decided.columns)


def digest(pages: DataFrame, corpus: DataFrame) -> DataFrame:
    """The columns of op8."""
    return judge(pages.select("page_id", "url"), corpus.select("text")).select("page_id", "host", "path", "rule", "verdict")
