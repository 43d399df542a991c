"""Filter audit, conversation trie and vector join against plain models."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import compare
import numpy as np
import pytest

from arenalake.llm import audit, queries, trie, vectors

GAP = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_audit", "op12_trie", "op13_vectors"])
def test_sql(spark, sf, name):
    assert compare.differences(queries.QUERIES[name](spark, sf), compare.connect(sf), queries.ORACLES[name]) is None


# --- 11 -----------------------------------------------------------------------------------------------------------------


def plain_counts(t):
    w = [x for x in GAP.split(t) if x]
    return len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))


def texts():
    rnd = random.Random(3)
    alphabet = "abAB é漢𝄞#$%&*|  \n\t\x0b\x1c.,"
    out = ["", " ", "\n\n", "a", " a ", "aa aa aa", "A" * 700, "word " * 5000, "漢字 " * 300, "x" * 100_000 + " " + "x" * 100_000, "ab" * 33 + " " + "ab" * 33 + " " + "ab" * 32 + "ac"]
    return out + ["".join(rnd.choices(alphabet, k=rnd.randint(1, 400))) for _ in range(300)]


def test_transducer_counts():
    found = audit.count([t.encode() for t in texts()])
    assert list(zip(*(found[m].tolist() for m in audit.MEASURES), strict=True)) == [plain_counts(t) for t in texts()]
    assert [found.tolist() for found in audit.count([]).values()] == [[]] * 5


def test_hash_table_verifies_words(monkeypatch):
    """With one hash for all words, the distinct ones are still told apart."""
    monkeypatch.setattr(audit, "mix", lambda h: h * np.uint64(0))
    monkeypatch.setattr(audit.xxhash, "xxh3_64_intdigest", lambda *_: 0)
    some = [t for t in texts() if len(t) < 300] + ["ab" * 40 + " " + "ab" * 40 + " " + "ab" * 39 + "ac"]
    found = audit.count([t.encode() for t in some])
    assert found["n_distinct"].tolist() == [plain_counts(t)[1] for t in some]


def plain_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    first = {}
    for d, t, *_ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = []
    for d, t, s, *_ in docs:
        n, distinct, capitals, points, symbols = plain_counts(t or "")
        fails = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * points, "D": symbols > 0, "E": d is not None and first[t or ""] < d}
        rows.append((s or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = (len(kept), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
                left = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_odd_rows(spark):
    rnd = random.Random(5)
    some = texts() + ["many words of prose " * 60, "all different " + " ".join(f"w{i}" for i in range(300))]
    docs = [(i, rnd.choice([*some[-40:], None, ""]), rnd.choice(["a", "b", None, ""]), 1) for i in range(150)]
    docs += [docs[3], docs[3], (7, "id twice", "a", 1), (None, "no id", "b", 1), (None, "no id", "b", 1), (900, "no id", "c", 1), (901, "no id", "c", 1)]
    labels = [(i, i % 2, i % 3 == 0 and 1 or None) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (900, None, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, n_words long").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit(frame, known).collect()}
    assert got == plain_audit(docs, labels)
    assert audit.audit(frame.limit(0), known).count() == 0
    kept = {tuple(r)[:3]: r["kept"] for r in audit.audit(frame, known.limit(0), {"D": audit.filters()["D"], "E": audit.filters()["E"]}).collect()}
    assert set(k[1] for k in kept) == {"DE", "ED"} and kept["a", "DE", 2] == kept["a", "ED", 2]


# --- 12 -----------------------------------------------------------------------------------------------------------------


def plain_trie(convs):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}

    def below(p):
        leaves, saved = 0 if children[p] else 1, (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for q in children[p]:
            x, y = below(q)
            leaves, saved = leaves + x, saved + y
        ended = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves, saved, hashlib.sha256(ended.encode()).hexdigest())
        return leaves, saved

    if members:
        below(())
    return out


def rows_of(frame):
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in frame.collect()}


def conversations(seed):
    rnd = random.Random(seed)
    turns = [(rnd.choice(["user", "assistant", ""]), "x" * rnd.randint(0, 5) + rnd.choice("abé")) for _ in range(4)]
    convs = {c: [rnd.choice(turns[: 1 + (d > 1) * 3]) for d in range(rnd.choice([0, 1, 1, 2, 3, 4, 9]))] for c in range(-12, 200)}
    convs |= {c: [turns[0], turns[1]] for c in range(300, 460)}
    convs |= {c: [turns[0]] * 60 for c in (500, 505, 510)} | {511: [turns[0]] * 59 + [turns[1]]} | {c: [("user", f"only {c}")] for c in range(600, 900)}
    return convs


@pytest.mark.parametrize("part_bytes", [1 << 9, 1 << 13, 1 << 24])
def test_trie_over_parts(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(trie, "PART_BYTES", part_bytes)
    monkeypatch.setattr(trie, "RUN", 16)
    convs = {c: t for c, t in conversations(part_bytes).items() if t}
    rows = [(c, i, role, text, "extra") for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, group string").repartition(5)
    assert rows_of(trie.nodes(trie.keys(frame))) == plain_trie(convs)


def test_spliced_conversations(spark):
    convs = conversations(1)
    rows = [(c, i if i else None, role or None, text, 0) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    rows += [(17, 3, None, None, 0), (None, 1, "user", "of nobody", 0), (18, 1, "user", "tie", 0), (18, 1, "user", "tie", 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int").repartition(3)
    own = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            told = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((-1 if turn is None else turn, f"{len(text.encode()):08x}{told}"[:32], role, text))
    plain = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c in plain:
        h = zlib.crc32(str(c).encode()) % 9
        base = plain.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])
        rebuilt[c] = base[:h] + plain[c][h:]
    assert rows_of(trie.nodes(trie.spliced(frame))) == plain_trie(rebuilt)
    assert trie.nodes(trie.spliced(frame.limit(0))).count() == 0


def test_radix_nodes_grow():
    """A node with every byte below it passes through all layouts; prefixes of keys stay nodes."""
    keys = sorted([bytes([b]) * 16 for b in range(256)] + [bytes([b]) * 16 + bytes([c]) * 16 for b in (0, 255) for c in range(60)])
    tree = trie._tree(keys)
    assert isinstance(tree.branches, trie._Full) and len(tree.branches.children) == 256
    assert isinstance(tree.branches.get(255).branches, trie._Full) and tree.branches.get(255).ends >= 0
    for n, kind in ((3, trie._Sorted), (16, trie._Sorted), (40, trie._Indexed), (49, trie._Full)):
        assert isinstance(trie._tree(keys[:1] + [bytes([b]) * 16 for b in range(1, n)]).branches, kind)
    rows = trie._emit(keys, [1] * len(keys), list(range(len(keys))), None, None).to_pylist()
    assert len(rows) == 1 + len(keys) and rows[-1]["depth"] == 0 and rows[-1]["n"] == len(keys) and rows[-1]["children"] == 256


# --- 13 -----------------------------------------------------------------------------------------------------------------


def plain_links(rows, least=0.93):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not np.any(v):
            return None
        v = np.asarray(v, np.float64) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [None if i is None or lab is None else unit(v) for i, lab, v, *_ in rows]
    n, top = [0] * len(rows), {i: i for i, *_ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for p in range(len(rows)):
        for q in range(p):
            if units[p] is not None and units[q] is not None and rows[p][1] == rows[q][1] and len(units[p]) == len(units[q]) and units[p] @ units[q] >= least:
                n[p] += 1
                n[q] += 1
                a, b = sorted((find(rows[p][0]), find(rows[q][0])))
                top[b] = a
    return sorted((str(i), n[k], str(find(i)), i is not None and find(i) == i) for k, (i, *_) in enumerate(rows))


def embeddings():
    rnd = np.random.default_rng(2)
    rows, at = [], 0

    def add(v, label):
        nonlocal at
        rows.append((at * 7 % 1009, label, None if v is None else [None if x is None else float(x) for x in v], 0))
        at += 1

    for label in (0, 1):
        for _ in range(12):
            centre = rnd.standard_normal(20)
            for _ in range(rnd.integers(1, 12)):
                add(centre + rnd.standard_normal(20) * rnd.choice([0.01, 0.1, 0.3]), label)
    chain = rnd.standard_normal(20)
    for _ in range(30):  # a long chain, each close to the next
        chain = chain + rnd.standard_normal(20) * 0.25
        add(chain, 0)
    same = rnd.standard_normal(20)
    for _ in range(40):
        add(same, 1)
    add(same * 1e300, 1), add(same * 3, 0), add(-same, 1), add(same, None)
    for v in (None, [], [0.0] * 20, [None] + [1.0] * 19, [float("nan")] * 20, [float("inf")] + [1.0] * 19, [1.0, 2.0], [1.0, 2.0], [1.0], [5.0], [-1.0]):
        add(v, 1)
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize(("crowd", "chunk"), [(1 << 17, 8192), (1 << 17, 25), (40, 8192), (10, 9)])
def test_vectors(spark, crowd, chunk):
    rows = embeddings()
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, n_links int").repartition(4)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vectors.near(frame, crowd=crowd, chunk=chunk).collect())
    assert got == plain_links(rows)


def test_vectors_without_rows_or_ids(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert vectors.near(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 1, [1.0, 0.0]), (3, 1, [1.0, 0.1]), (2, 1, [1.0, 0.1])]
    assert sorted(map(str, vectors.near(spark.createDataFrame(rows, schema)).collect())) == ["Row(vec_id=2, n_links=1, component_id=2, kept=True)", "Row(vec_id=3, n_links=1, component_id=2, kept=False)", "Row(vec_id=None, n_links=0, component_id=None, kept=False)"]


def test_links_of_a_large_tight_family():
    """Tiles take the whole product where nearly all pairs are close."""
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal(64) + rnd.standard_normal((700, 64)) * 0.2
    x = np.vstack([x, rnd.standard_normal((300, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = rnd.integers(1, 4, len(x))
    close = x @ x.T >= 0.93
    np.fill_diagonal(close, False)
    every = np.arange(len(x))
    count, root = vectors.links(x, n, every, every, 0.93)
    assert (count == close @ n).all()
    total = sum(vectors.links(x, n, every, every, 0.93, b)[0] for b in range(8))
    assert (total == count).all()
    for i in every:
        assert (root[close[i]] == root[i]).all()
