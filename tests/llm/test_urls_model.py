"""Host segmentation against all splits, and verdicts against plain counts and naive Bayes, on hundreds of urls."""

import itertools
import math
import random
import re
from collections import Counter

from arenalake.llm import urls


def cost(words, model):
    return sum(model.get(w, -model[""] - (len(w) - 1)) for w in words)


def splits(name):
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        out, word = [], name[0]
        for c, x in zip(cuts, name[1:], strict=True):
            if c:
                out, word = [*out, word], x
            else:
                word += x
        yield [*out, word]


def test_segment_is_best_of_all_splits():
    rnd = random.Random(4)
    for _ in range(120):
        words = {"".join(rnd.choices("abc", k=rnd.randint(1, 5))): rnd.randint(1, 500) for _ in range(12)}
        total = math.log10(sum(words.values()))
        model = {w: math.log10(n) - total for w, n in words.items()} | {"": total}
        name = "".join(rnd.choices("abcd", k=rnd.randint(1, 10)))
        found = urls.segment(name, model)
        assert "".join(found) == name
        assert abs(cost(found, model) - max(cost(s, model) for s in splits(name))) < 1e-9


def test_long_words_have_no_bound():
    long = "ab" * 200
    model = {long: -1.0, "ab": -1.5, "": 3.0}
    assert urls.segment("x" * 50 + long + "ab", model) == ["x" * 50, "ab", long]
    assert urls.segment("q" * 900, model) == ["q" * 900]


def plain_verdicts(pages, texts):
    """The same by Python loops over everything."""
    words = Counter(w for t in texts for w in re.findall("[a-z]+", (t or "").lower()))
    total = math.log10(sum(words.values()) or 1)
    model = {w: math.log10(n) - total for w, n in words.items()} | {"": total}

    def parse(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")

    def rule(host, path):
        fits = [(len(h + p), h + p, act) for act, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    def tokens(host, path):
        out = []
        if host:
            *labels, last = host.split(".")
            for run in (r for label in labels for r in re.findall("[a-z]+|[0-9]+", label)):
                out += [f"h:{w}" for w in urls.segment(run, model)] if run.isalpha() else [f"h:#{len(run)}"]
            out.append(f"t:{last}")
        return out + [f"p:#{len(w)}" if w.isdigit() else f"p:{w.lower()}" for w in re.findall(r"[^\W_]+", path)]

    rows = [(i, *parse(u)) for i, u in pages]
    counts, priors = {"block": Counter(), "allow": Counter()}, Counter()
    for _, host, path in rows:
        if verdict := rule(host, path)[1]:
            priors[verdict] += 1
            counts[verdict].update(tokens(host, path))
    size = len(set(counts["block"]) | set(counts["allow"]))
    sums = {k: sum(c.values()) for k, c in counts.items()}
    out = {}
    for i, host, path in rows:
        name, verdict = rule(host, path)
        score = math.log((priors["block"] + 1) / (priors["allow"] + 1))
        for t in tokens(host, path):
            score += math.log((counts["block"][t] + 1) / (sums["block"] + size + 1)) - math.log((counts["allow"][t] + 1) / (sums["allow"] + size + 1))
        out[i] = (host, path, name, verdict or ("block" if score > 0 else "allow"), abs(score))
    return out


def test_verdicts_as_by_plain_naive_bayes(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 6))) for _ in range(60)]
    texts = [" ".join(rnd.choices(words, k=40)) for _ in range(30)] + [None, "", "Ünïcode X9y " + "z" * 40]
    hosts = ["".join(rnd.choices(words, k=rnd.randint(1, 3))) + rnd.choice(["", "7", "2024", "-x", "Q"]) + rnd.choice([".com", ".net", ".org", ".de", ".example.com", ".example.net", ""]) for _ in range(180)]
    hosts += ["example.com", "example.net", "z" * 40 + ".org", "", "..", "a.b.c.d.com"]
    paths = ["/en/7/a", "/en/" + words[0], "/de/8", "/de/x_y", "/es/1", "", "/", "/fr/" + words[3], "/en", "/ES/12/345"]
    made = [(i, f"http{'s' * (i % 2)}://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=1', '#top'])}") for i in range(600)]
    made += [(600, None), (601, "no scheme/en/"), (602, "://x.org/es/"), (603, "a://b://c.com/en/")]
    pages = spark.createDataFrame(made, "page_id long, url string").repartition(5)
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.page_id: tuple(r)[1:] for r in urls.digest(pages, corpus).collect()}
    want = plain_verdicts(made, texts)
    assert len(got) == len(made)
    near = 0
    for i, (host, path, name, verdict, score) in want.items():
        assert got[i][:3] == (host, path, name)
        near += score < 1e-6
        assert score < 1e-6 or got[i][3] == verdict
    assert near < 10 and {v[3] for v in want.values()} == {"block", "allow"}
