"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are scaled to length 1, rotated by one seeded orthogonal matrix and cut into blocks of eight dimensions.  A cosine of
``least`` or more is a squared distance of 2 - 2 * least or less, so in one block at least the squared distance is within
the block's proportional part of it.  Only pairs that meet in such a range-join are verified, by their whole vectors in
double precision; every pair that reaches the cosine is found.

Equal vectors are one row with a count, so a much-copied vector is never compared with its copies.  The rows of a label are
compared in chunks of bounded size: a task gets two chunks and evaluates them tile by tile, counting links instead of
listing them.  Labels above CROWD rows are first dealt to the cells of a grid, once for each block, over as many of the
block's dimensions as their size asks for; there a pair counts in the first of its blocks within budget, and in the one
cell where the rows' ranges meet, so no list of pairs is needed to count each once.  Of its links a task keeps a spanning
forest, from which the components are built.

Each row is a vector.  Vectors that are null, empty, zero, or hold a null or non-finite component, and rows with a null
label or vec_id, link with nothing; vectors of different lengths link with nothing; repeated rows are vectors of their own;
rows that share a vec_id share a component.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, materialize
from .graph import components

LEAST = 0.93
BLOCK = 8  #: dimensions of a block, at most
CHUNK = 8192  #: rows of a chunk, about
CROWD = 1 << 17  #: labels with more rows are dealt to cells
TILE = 256
SEED = 7
SLACK = 1e-9  #: of budgets, above rounding errors


def _layout(dim: int, least: float) -> tuple[list[np.ndarray], np.ndarray]:
    """The blocks' dimensions and their budgets of squared distance."""
    blocks = np.array_split(np.arange(dim), -(-dim // BLOCK))
    return blocks, np.array([(2 - 2 * least) * len(b) / dim + SLACK for b in blocks])


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, embedding -> vec_id, label, dim, sig, x: rotated unit vectors and the first half of a SHA-256 of each
    (null where a vector links with nothing)."""
    turned: dict[int, np.ndarray] = {}
    for batch in batches:
        dims, sigs, xs = [], [], []
        for v in batch.column(2):
            v = np.asarray(v.values.to_numpy(zero_copy_only=False), float) if v.is_valid else np.zeros(0)  # a null component is NaN
            top = np.abs(v).max(initial=0)
            if not np.isfinite(v).all() or top == 0:
                dims.append(None), sigs.append(None), xs.append(None)
                continue
            v = v / top + 0.0
            v /= np.sqrt(v @ v)
            if len(v) not in turned:
                turned[len(v)] = _rotation(len(v))
            dims.append(len(v)), sigs.append(hashlib.sha256(v.tobytes()).digest()[:16]), xs.append((turned[len(v)] @ v).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(sigs, pa.binary()), pa.array(xs, pa.binary())], names=["vec_id", "label", "dim", "sig", "x"])


def _cells(least: float):
    """Rows of crowded labels -> the cells of each block that they touch; ``guest``: in which grid dimensions as a guest.

    A cell is twice the block's radius wide, so a row near its cell's lower side is a guest in the cell below, and two rows
    within the radius meet in the lower one of their cells, where one of them at least is at home in each dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, blocks, cells, guests = [], [], [], []
            for i, (dim, grid, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dim", "grid", "x")), strict=True)):
                layout, budgets = _layout(dim, least)
                x = np.frombuffer(x)
                for b, (block, budget) in enumerate(zip(layout, budgets, strict=True)):
                    radius = np.sqrt(budget) * (1 + SLACK)
                    at = x[block[:grid]] / (2 * radius)
                    home = np.floor(at).astype(np.int64)
                    near = np.flatnonzero(at - home <= 0.5 + SLACK)
                    for bits in range(1 << len(near)):
                        away = near[[k for k in range(len(near)) if bits >> k & 1]]
                        cell = home.copy()
                        cell[away] -= 1
                        take.append(i), blocks.append(b), cells.append(cell.tobytes()), guests.append(int(sum(1 << int(k) for k in away)))
            kept = batch.select(["label", "dim", "sig", "rid", "n", "x"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(blocks, pa.int32()), pa.array(cells, pa.binary()), pa.array(guests, pa.int32())], names=[*kept.schema.names, "block", "cell", "guest"])

    return run


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)


def _first_block(x: np.ndarray, i: np.ndarray, j: np.ndarray, blocks: list[np.ndarray], budgets: np.ndarray) -> np.ndarray:
    """The first block of each pair within its budget, summed in a fixed order: every task gets the same."""
    out = np.full(len(i), len(blocks))
    for b in range(len(blocks) - 1, -1, -1):
        total = np.zeros(len(i))
        for c in blocks[b]:
            total += (x[i, c] - x[j, c]) ** 2
        out[total <= budgets[b]] = b
    return out


class _Forest:
    """Components of the rows of a task."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        while True:
            cross = links & (self.root[rows][:, None] != self.root[columns][None])
            some = np.flatnonzero(cross.any(1))
            if not len(some):
                return
            to = np.arange(len(self.root))

            def top(k: int) -> int:
                while to[k] != k:
                    to[k] = to[to[k]]
                    k = to[k]
                return k

            for a, b in zip(self.root[rows[some]].tolist(), self.root[columns[cross[some].argmax(1)]].tolist(), strict=True):
                a, b = top(a), top(b)
                to[max(a, b)] = min(a, b)
            while (to[to] != to).any():
                to = to[to]
            self.root = to[self.root]


def links(x: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, block: int = -1, guest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each row is linked with, and its root in the spanning forest, for the pairs of two chunks (rows
    ``left`` and ``right`` of x, which are the same or disjoint); ``block``: only pairs that count in it."""
    blocks, budgets = _layout(x.shape[1], least)
    mine = range(len(blocks)) if block < 0 else [block]
    count, forest, same = np.zeros(len(x), np.int64), _Forest(len(x)), len(left) == len(right) and bool((left == right).all())
    # along one coordinate a tile meets only what is within the radius, where there is one block
    lead = blocks[mine[0]][0]
    if block >= 0:
        left, right = left[np.argsort(x[left, lead], kind="stable")], right[np.argsort(x[right, lead], kind="stable")]
    for k in range(0, len(left), TILE):
        rows, columns = left[k : k + TILE], right[k:] if same else right
        if block >= 0:
            radius = np.sqrt(budgets[block]) * (1 + SLACK)
            a, b = np.searchsorted(x[columns, lead], [x[rows[0], lead] - radius, x[rows[-1], lead] + radius + SLACK])
            columns = columns[a:b]
        if not len(columns):
            continue
        near = np.zeros((len(rows), len(columns)), bool)
        for b in mine:
            near |= _near(x[np.ix_(rows, blocks[b])], x[np.ix_(columns, blocks[b])]) <= budgets[b] + SLACK
        if same:  # each pair once
            place = np.empty(len(x), np.int64)
            place[left] = np.arange(len(left))
            near &= place[rows][:, None] < place[columns][None]
        if guest is not None:
            near &= (guest[rows][:, None] & guest[columns][None]) == 0
        if near.mean() > 0.02:
            near &= x[rows] @ x[columns].T >= least
        else:
            i, j = np.nonzero(near)
            near[i, j] = np.einsum("ij,ij->i", x[rows[i]], x[columns[j]]) >= least
        if block >= 0:
            i, j = np.nonzero(near)
            near[i, j] = _first_block(x, rows[i], columns[j], blocks, budgets) == block
        count[rows] += near @ n[columns]
        count[columns] += near.T @ n[rows]
        forest.join(near, rows, columns)
    return count, forest.root


FOUND = "sig binary, rid long, root long, links long"


def _compare(least: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, block = key[1].as_py(), key[2].as_py()
        x = np.frombuffer(b"".join(table.column("x").to_pylist())).reshape(-1, dim)
        side, rid, n, guest = (table.column(c).to_numpy() for c in ("side", "rid", "n", "guest"))
        count, root = links(x, n, np.flatnonzero(side != 1), np.flatnonzero(side != 0), least, block, guest if block >= 0 else None)
        some = np.flatnonzero(count)
        return pa.table({"label": pa.chunked_array([pa.repeat(key[0], len(some))]), "dim": pa.array(np.full(len(some), dim, np.int32)), "sig": table.column("sig").take(pa.array(some)), "rid": rid[some], "root": rid[root[some]], "links": count[some]})

    return run


def near(vectors: DataFrame, least: float = LEAST, crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id and kept (a component's smallest id) of every row of ``vectors`` (vec_id, label, embedding)."""
    spark = vectors.sparkSession
    label = vectors.schema["label"].dataType.simpleString()
    id_ = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", "label", F.transform(F.col("embedding"), lambda v: v.cast("double")).alias("embedding"))
    rows = materialize(rows.mapInArrow(_units, f"vec_id {id_}, label {label}, dim int, sig binary, x binary"), "vectors")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("sig").isNotNull()
    valid = rows.filter(sound)
    reps = materialize(valid.groupBy("label", "dim", "sig").agg(F.min("vec_id").cast("long").alias("rid"), F.count("*").alias("n"), F.first("x").alias("x")), "distinct")

    crowded = reps.groupBy("label", "dim").count().filter(F.col("count") > crowd)
    grid = F.least(F.ceil(F.log2(F.col("count") / crowd)).cast("int"), "dim", F.lit(BLOCK))
    crowded = few(materialize(crowded.select("label", "dim", grid.alias("grid")), "crowded"))
    plain = reps.join(crowded, ["label", "dim"], "left_anti").select("label", "dim", "sig", "rid", "n", "x", F.lit(-1).alias("block"), F.lit(b"").alias("cell"), F.lit(0).alias("guest"))
    celled = reps.join(crowded, ["label", "dim"]).mapInArrow(_cells(least), f"label {label}, dim int, sig binary, rid long, n long, x binary, block int, cell binary, guest int")
    placed = materialize(plain.unionByName(celled), "placed")
    where = ["label", "dim", "block", "cell"]
    large = placed.groupBy(*where).count().filter(F.col("count") > chunk).select(*where, F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    dealt = placed.join(few(materialize(large, "large"), 256), where, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select(*where, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side.alias("side"), "guest", "sig", "rid", "n", "x")
    pair = [*where, "a", "b"]
    found = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *pair).groupBy(*pair).applyInArrow(_compare(least), f"label {label}, dim int, {FOUND}")
    found = materialize(found, "links")

    links_ = found.groupBy("label", "dim", "sig").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")).filter("a <> b"))
    whole = reps.select("label", "dim", "sig", "rid", "n").join(links_, ["label", "dim", "sig"], "left").join(comps.withColumnRenamed("node", "rid"), "rid", "left")
    whole = whole.select("label", "dim", "sig", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "rid").alias("component_id"))
    out = valid.select("vec_id", "label", "dim", "sig").join(whole, ["label", "dim", "sig"]).select("vec_id", "n_links", "component_id")
    alone = F.array("vec_id")[0].cast("long")  # not the same column again, which a union's sides can't have twice
    out = out.union(rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), alone.alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: every pair of a label; ids are distinct in the tables it is run on
SQL = r"""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (WITH RECURSIVE r(node, top) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.node WHERE r.top < l.b) SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT vec_id, coalesce(d.n, 0)::BIGINT AS n_links, r.top AS component_id, vec_id = r.top AS kept FROM embeddings LEFT JOIN d ON d.a = vec_id JOIN r ON r.node = vec_id
"""
