"""PII by weak supervision, in DataFrame expressions only.

Candidates are the matches of strict patterns (the *base*) and of looser ones (bracketed e-mail addresses, phone
numbers without a plus sign, eight-group addresses).  Six labelers vote on every candidate: 1 personal, 0 not,
2 abstains.  The distinct vote patterns and their counts form a small table (at most 4 kinds * 3**6 votes * 4 lengths
rows, however many documents there are); expectation-maximisation on it estimates each labeler's reliability, and its
posteriors train a logistic span classifier.  Base spans always stay; other candidates that the classifier accepts and
that touch no base span are added.

A row is a document: repeated rows and ids are labelled one by one, a null text is empty, extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone")
# The strict patterns, written so that the regular-expression engine neither backtracks nor recurses.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}+\x20?[\[({]at[\])}]\x20?[A-Za-z0-9\-]++(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+)(\-])\(?[0-9]{3}\)?[\x20.\-][0-9]{3}[\x20.\-][0-9]{4}(?![0-9\-])",
}
#: A cheap test of the whole text before the pattern itself is tried.
HINT = {"email": "[@\\]})]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:", "card": r"[0-9](?:[\x20\-]?[0-9]){12}", "phone": r"\+[0-9]|[0-9]\)?[\x20.\-][0-9]"}
# Gazetteers of cue words before a candidate, of words that speak against it, and of last name labels.
CUES = {
    "email": r"(?i)(?:e-?mail|mailto|contact|reach|write|address)[^\n]{0,12}$",
    "ip": r"(?i)\b(?:ip|host|server|client|from|login|addr)[^\n]{0,12}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|payment)[^\n]{0,12}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp|sms)[^\n]{0,12}$",
}
AGAINST = r"(?i)(?:version|isbn|issn|invoice|order|ref|ticket|serial|sku|chapter|section|doi|v)[\x20.:#]{0,3}$"
LAST_LABELS = r"(?i)\.(?:com|net|org|edu|gov|io|info|biz|[a-z]{2})$"
VOTERS = 6
BLOCK = 128  #: spans of a text that are placed together
SPREAD = 64  #: parts of a text with many base spans in which overlaps are looked for
PATTERN = "kind", "length", *(f"v{i}" for i in range(VOTERS))


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(2) if no is not None else F.when(yes, 1).otherwise(2)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    """The check that a strict match must also pass."""
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), F.expr("true") & F.call_function("luhn_check", _digits(value))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _running(sizes: Column) -> Column:
    """The sum of the sizes before each element, in blocks, so that the work is linear in the number of elements."""

    def block(i: Column) -> Column:
        return F.slice(sizes, i * BLOCK + 1, F.lit(BLOCK))

    def add(a: Column, x: Column) -> Column:
        return F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))

    def before(values: Column, at: Column) -> Column:
        return F.aggregate(values, F.struct(at.alias("at"), F.expr("cast(array() as array<int>)").alias("out")), add, lambda a: a["out"])

    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda i: F.aggregate(block(i), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(sizes) <= BLOCK, before(sizes, F.lit(0))).otherwise(let(before(sums, F.lit(0)), lambda first: F.flatten(F.transform(blocks, lambda i: before(block(i), first[i])))))


def _found(text: Column, kind: str, strict: bool) -> Column:
    """Leftmost non-overlapping matches with their places (code points) and votes, as an array of structs."""
    pattern = (STRICT if strict else LOOSE)[kind]
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(x: Column) -> Column:
        sizes = F.zip_with(x["gaps"], x["hits"], lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))

        def spans(at: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = at[i] + F.length(x["gaps"][i])
                behind = F.concat(F.left(x["gaps"][i + 1], F.lit(1)), F.coalesce(F.left(F.get(x["hits"], i + 1), F.lit(1)), F.lit("")))
                return F.struct(start.alias("s"), (start + F.length(m)).alias("e"), m.alias("m"), F.right(x["gaps"][i], F.lit(40)).alias("pre"), F.left(behind, F.lit(1)).alias("after"))

            return F.transform(x["hits"], one)

        return let(_running(sizes), spans)

    spans = let(F.struct(gaps.alias("gaps"), hits.alias("hits")), placed)
    k = KINDS.index(kind)

    def label(x: Column) -> Column:
        value, pre = x["m"], x["pre"]
        digits, good = _digits(value), _holds(kind, value)
        after = x["after"]
        shape = {
            "email": _vote(value.rlike(LAST_LABELS), ~value.rlike(LAST_LABELS)),
            "ip": _vote(~value.rlike(r"^(?:0|127|255)\."), value.rlike(r"^(?:0|255)\.")),
            "card": _vote(digits.rlike(r"^(?:4|5[1-5]|3[47]|6011|65|2[2-7])"), ~digits.rlike(r"^[2-6]")),
            "phone": _vote(F.length(digits) >= 10, digits.rlike(r"^0+$|^(.)\1+$")),
        }[kind]
        votes = (
            F.lit(1 if strict else 2),  # the strict pattern itself
            F.when(good, 1).otherwise(0) if kind != "email" else _vote(~value.contains(".."), value.contains("..")),
            _vote(pre.rlike(CUES[kind])),
            F.when(pre.rlike(AGAINST), 0).otherwise(2),
            _vote(~pre.rlike(r"[\p{L}\p{N}_]$") & ~after.rlike(r"[\p{L}\p{N}_]"), pre.rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"[\p{L}\p{N}_]")),
            shape,
        )
        size = F.when(F.length(value) < 12, 0).when(F.length(value) < 16, 1).when(F.length(value) < 24, 2).otherwise(3)
        base = good if strict else F.lit(False)
        return F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), base.alias("base"), size.alias("length"), *(v.alias(f"v{i}") for i, v in enumerate(votes)))

    return F.transform(spans, label)


def candidates(text: Column) -> Column:
    """All candidates of a text, by kind in the order of KINDS and then by start."""
    text = F.coalesce(text, F.lit(""))
    parts = []
    for kind in KINDS:
        found = _found(text, kind, True)
        if kind in LOOSE:
            found = F.array_sort(F.concat(found, _found(text, kind, False)))
        parts.append(F.when(text.rlike(HINT[kind]), found))
    none = F.filter(_found(F.lit(""), "card", True), lambda x: F.lit(False))
    return F.concat(*(F.coalesce(p, none) for p in parts))


def _total(array: Column, of) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + of(x))


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def fit(docs: DataFrame, text: str = "text", rounds: int = 20, steps: int = 60) -> dict[str, list[float]]:
    """Reliabilities and classifier weights from the vote patterns of all documents.

    Both loops run inside one aggregate expression over the bounded pattern table; what reaches the driver is one row:
    P(vote | personal), P(vote | not) for every labeler and vote, and a weight for every vote, kind and length.
    """
    one = docs.select(F.explode(candidates(F.col(text))).alias("c")).groupBy(*(F.col(f"c.{x}").alias(x) for x in PATTERN)).agg(F.count("*").cast("double").alias("n"))
    p = one.agg(F.collect_list(F.struct(F.array(*PATTERN).alias("x"), "n")).alias("p"))
    cells = F.sequence(F.lit(0), F.lit(3 * VOTERS - 1))

    def vote(x: Column, i: Column) -> Column:  # the x-array holds kind, length and then the votes
        return x["x"][(i / 3).cast("int") + 2] == i % 3

    def score(state: Column, x: Column) -> Column:
        own = F.aggregate(F.sequence(F.lit(0), F.lit(VOTERS - 1)), F.log(state["prior"][x["x"][0]] / (1.0 - state["prior"][x["x"][0]])), lambda a, l: a + F.log(state["yes"][l * 3 + x["x"][l + 2]] / state["no"][l * 3 + x["x"][l + 2]]))
        return F.struct(x["x"].alias("x"), x["n"].alias("n"), _sigmoid(own).alias("q"))

    def em(state: Column, _: Column, pats: Column) -> Column:
        def renewed(scored: Column) -> Column:
            side = lambda w: F.transform(cells, lambda i: (_total(scored, lambda x: F.when(vote(x, i), x["n"] * w(x)).otherwise(0.0)) + 0.5) / (_total(scored, lambda x: x["n"] * w(x)) + 1.5))
            prior = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (_total(scored, lambda x: F.when(x["x"][0] == k, x["n"] * x["q"]).otherwise(0.0)) + 1.0) / (_total(scored, lambda x: F.when(x["x"][0] == k, x["n"]).otherwise(0.0)) + 2.0))
            return F.struct(prior.alias("prior"), side(lambda x: x["q"]).alias("yes"), side(lambda x: 1.0 - x["q"]).alias("no"))

        return let(F.transform(pats, lambda x: score(state, x)), renewed)

    first = F.struct(F.array(*[F.lit(0.5)] * 4).alias("prior"), F.array(*[F.lit(v) for v in (0.1, 0.6, 0.3)] * VOTERS).alias("yes"), F.array(*[F.lit(v) for v in (0.4, 0.2, 0.4)] * VOTERS).alias("no"))
    model = p.select("p", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda s, i: em(s, i, F.col("p"))).alias("m"))
    scored = model.select("m", F.transform("p", lambda x: score(F.col("m"), x)).alias("p"))
    width = 3 * VOTERS + 8

    def fires(x: Column, j: Column) -> Column:
        return F.when(j < 3 * VOTERS, vote(x, j)).when(j < 3 * VOTERS + 4, x["x"][0] == j - 3 * VOTERS).otherwise(x["x"][1] == j - 3 * VOTERS - 4)

    def descend(w: Column, _: Column) -> Column:
        def moved(errors: Column) -> Column:
            total = _total(errors, lambda x: x["n"]) + 1.0
            return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: w[j] + 2.0 * (_total(errors, lambda x: F.when(fires(x, j), x["n"] * x["d"]).otherwise(0.0)) / total - 1e-4 * w[j]))

        return let(F.transform(F.col("p"), lambda x: F.struct(x["x"].alias("x"), x["n"].alias("n"), (x["q"] - _sigmoid(_logit(w, x))).alias("d"))), moved)

    def _logit(w: Column, x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(VOTERS - 1)), w[3 * VOTERS + x["x"][0]] + w[3 * VOTERS + 4 + x["x"][1]], lambda a, l: a + w[l * 3 + x["x"][l + 2]])

    zero = F.array(*[F.lit(0.0)] * width)
    row = scored.select("m.prior", "m.yes", "m.no", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, descend).alias("weights")).first()
    return row.asDict()


def spans(text: Column, model: dict[str, list[float]], threshold: float = 0.9) -> Column:
    """array<struct<kind, s, e, base>> of a text: base spans and accepted others, by kind in the order of KINDS, then start."""
    w = F.array(*[F.lit(float(x)) for x in model["weights"]])
    cut = math.log(threshold / (1 - threshold))

    def keep(all_: Column) -> Column:
        base = F.filter(all_, lambda x: x["base"])
        wide = F.size(base) > SPREAD
        part = F.when(wide, F.floor(F.length(text) / SPREAD).cast("int") + 1).otherwise(F.length(text) + 1)

        def accepted(parts: Column) -> Column:
            def one(x: Column) -> Column:
                logit = sum((w[i * 3 + x[f"v{i}"]] for i in range(VOTERS)), w[3 * VOTERS + x["kind"]] + w[3 * VOTERS + 4 + x["length"]])
                near = F.sequence(F.floor(x["s"] / part).cast("int"), F.floor(x["e"] / part).cast("int"))
                return x["base"] | ((logit >= cut) & ~F.exists(near, lambda i: F.exists(parts[i], lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))

            return F.filter(all_, one)

        split = F.transform(F.sequence(F.lit(0), F.lit(SPREAD)), lambda i: F.filter(base, lambda b: (b["s"] < (i + 1) * part) & (b["e"] >= i * part)))
        return let(F.when(wide, split).otherwise(F.array(base)), accepted)

    return let(candidates(text), keep)


def find(docs: DataFrame, text: str = "text", to: str = "pii_spans", model: dict | None = None) -> DataFrame:
    """``docs`` with the spans of each text in column ``to`` (replaced if it is there)."""
    return docs.withColumn(to, spans(F.col(text), model or fit(docs, text)))


def redact(docs: DataFrame, text: str = "text", model: dict | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; a null text stays null.

    Where spans overlap, the one that starts first (the longer, on a tie) names the whole overlapping run.
    """
    model = model or fit(docs, text)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col(text)

    def rewrite(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))

        def step(acc: Column, x: Column) -> Column:
            fresh = x["s"] >= acc["at"]
            piece = F.concat(F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), names[x["kind"]])
            return F.struct(F.greatest(acc["at"], -x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))

    return docs.withColumn(text, let(spans(t, model), lambda f: F.when(F.size(f) == 0, t).otherwise(rewrite(f))))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op1: counts and digest of the base spans, and all spans as text."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", kind[x["kind"]], x["s"], x["e"])), ",")
    found = find(docs.select("doc_id", "text"), to="spans").select("doc_id", "spans", F.filter("spans", lambda x: x["base"]).alias("base"))
    of = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
