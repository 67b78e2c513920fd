"""Operator 9: near-duplicate embeddings by an inverted multi-index.

Independent codebooks on the two halves of a direction form a product grid of cells.  Every distinct vector
lives in its nearest cell and visits cells in the order of a multi-sequence traversal (pairs of per-half
distance lists, by increasing sum).  How many it visits is fitted, not fixed: on a bounded sample, neighbours
are made at exactly the least cosine that links, and enough cells are visited that TARGET of such pairs meet
(from either side).  Meeting pairs are verified by their cosine in double precision.

Equal vectors of a label are one node with a weight.  A cell's rows are compared in blocks, so a hot cell is
many tasks of bounded memory; a task returns link counts and a spanning forest of its links, not pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, or have a null label, link
with nothing; vectors of different length don't either; equal rows count each other; a null vec_id links
and counts as others do but names no component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, prepare, shuffle_partitions, tasks
from .components import components
from .simhash import Forest
from .vectors import dimensions, kmeans, matrix, nearest, sample, squares, unit, usable

COSINE, TARGET = 0.93, 0.99
SAMPLE, SIDE = 8192, 2048


class Grid:
    """Codebooks of the two halves."""

    def __init__(self, first: np.ndarray, second: np.ndarray, half: int):
        self.first, self.second, self.half = first, second, half

    @classmethod
    def fit(cls, x: np.ndarray, k: int) -> Grid:
        half = max(1, x.shape[1] // 2)
        return cls(kmeans(x[:, :half], k, seed=1), kmeans(x[:, half:], k, seed=2) if x.shape[1] > half else np.zeros((1, 0)), half)

    def home(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.first)[0] * len(self.second) + nearest(x[:, self.half :], self.second)[0]

    def visits(self, x: np.ndarray, cells: int) -> np.ndarray:
        """(rows, cells): the nearest cells of the grid in traversal order.

        The first ``cells`` of a multi-sequence traversal lie where (i+1)(j+1) <= cells in the two sorted
        lists, so only those pairs are put in order.
        """
        a, b = squares(x[:, : self.half], self.first), squares(x[:, self.half :], self.second)
        ia, ib = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        i, j = np.divmod(np.arange(a.shape[1] * b.shape[1]), b.shape[1])
        front = (i + 1) * (j + 1) <= cells
        i, j = i[front], j[front]
        sums = np.take_along_axis(a, ia, 1)[:, i] + np.take_along_axis(b, ib, 1)[:, j]
        order = np.argsort(sums, axis=1, kind="stable")[:, :cells]
        return np.take_along_axis(ia, i[order], 1) * len(self.second) + np.take_along_axis(ib, j[order], 1)


def grid_side(n: int) -> int:
    """Centres a half: cells hold some 256 vectors of the whole table, as long as the sample has eight vectors a centre."""
    return min(SAMPLE // 8, max(4, 2 ** round(math.log2(max(math.sqrt(n / 256), 1)))))


def visits_needed(grid: Grid, x: np.ndarray, cosine: float, target: float) -> int:
    """Cells to visit so that ``target`` of pairs at the least linking cosine meet."""
    rng = np.random.default_rng(11)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine * cosine) * unit(noise)
    cells = len(grid.first) * len(grid.second)
    home_x, home_y = grid.home(x), grid.home(y)
    tried = 64
    while len(x):
        tried = min(tried, cells)
        place = np.full(len(x), cells)
        for own, other in ((x, home_y), (y, home_x)):
            for a in range(0, len(x), 512):
                seen = grid.visits(own[a : a + 512], tried) == other[a : a + 512, None]
                place[a : a + 512] = np.minimum(place[a : a + 512], np.where(seen.any(axis=1), seen.argmax(axis=1) + 1, cells))
        need = int(np.quantile(place, target, method="higher"))
        if need <= tried or tried == cells:
            return need
        tried *= 4
    return 1


def _dealt(nodes: DataFrame, grid: Grid, cells: int, dim: int) -> DataFrame:
    """Each node once at home (with the cells that it visits) and once in each other visited cell."""
    sent = nodes.sparkSession.sparkContext.broadcast((grid.first, grid.second, grid.half))

    def run(batches: Iterator[pa.RecordBatch]):
        own = Grid(*sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = unit(matrix(batch.column("embedding"), dim))
                home, seen = own.home(x), own.visits(x, cells)
                seen = np.where((seen == home[:, None]).any(axis=1)[:, None], seen, np.concatenate([home[:, None], seen[:, :-1]], axis=1))
                rows = pa.array(np.repeat(np.arange(len(x)), seen.shape[1]))
                flat = seen.ravel()
                at_home = flat == np.repeat(home, seen.shape[1])
                lists = pa.array(seen.astype(np.int32).tolist(), pa.list_(pa.int32())).take(rows)
                names = ["label", "node", "weight", "embedding"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in names], pa.array(flat.astype(np.int32)), pa.array(np.repeat(home, seen.shape[1]).astype(np.int32)), pa.array(at_home), lists], [*names, "cell", "home", "at_home", "seen"])

    kinds = dict(nodes.dtypes)
    return nodes.mapInArrow(run, f"label {kinds['label']}, node long, weight long, embedding {kinds['embedding']}, cell int, home int, at_home boolean, seen array<int>")


class _Cell:
    """Rows of one block of one cell."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int):
        t = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.node, self.weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
        self.left, self.right = (t.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        self.home = t.column("home").to_numpy()
        self.at_home = t.column("at_home").to_numpy(zero_copy_only=False)
        self.x = unit(matrix(t.column("embedding"), dim))
        self.seen = t.column("seen")

    def links(self, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node, linked weight) and the edges of a forest; left rows are compared with right ones."""
        left, right = np.flatnonzero(self.left), np.flatnonzero(self.right)
        counts = np.zeros(len(self.node), np.int64)
        forest = Forest(len(self.node))
        right_seen = np.array(self.seen.take(pa.array(right)).to_pylist(), np.int32).reshape(len(right), -1)
        for k in range(0, len(left), 512):
            some = left[k : k + 512]
            a, b = np.nonzero(self.x[some] @ self.x[right].T >= cosine)
            a, at, b = some[a], b, right[b]
            other = self.node[a] != self.node[b]
            a, at, b = a[other], at[other], b[other]
            np.add.at(counts, a, self.weight[b])
            # b is at home here; a visitor's home may not be among b's cells: then b's link is counted here
            back = ~self.at_home[a]
            back[back] = ~(right_seen[at[back]] == self.home[a[back]][:, None]).any(axis=1)
            np.add.at(counts, b[back], self.weight[a[back]])
            forest.join(a, b)
        linked = np.flatnonzero(counts)
        off = np.flatnonzero(forest.parent != np.arange(len(self.node)))
        return self.node[linked], counts[linked], self.node[off], self.node[forest.parent[off]]


def link(nodes: DataFrame, dim: int, cosine: float = COSINE, target: float = TARGET) -> DataFrame:
    """(node, links, other) of nodes(label, node, weight, embedding): partial link counts, and edges to other."""
    n = nodes.count()
    x = unit(sample(nodes, dim, SAMPLE, n, key="node"))
    grid = Grid.fit(x, grid_side(n))
    cells = visits_needed(grid, x[:2048], cosine, target)
    dealt = materialize(_dealt(nodes.repartition(shuffle_partitions(nodes.sparkSession), "node"), grid, cells, dim), "grid")
    sizes = dealt.groupBy("label", "cell").agg(F.count("*").alias("all_rows"), F.count_if("at_home").alias("homes")).where("homes > 0")
    sides = sizes.select("label", "cell", F.ceil(F.col("all_rows") / SIDE).cast("int").alias("lefts"), F.ceil(F.col("homes") / SIDE).cast("int").alias("rights"))
    rows = dealt.join(sides, ["label", "cell"])
    mine = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_left = F.transform(every("rights"), lambda r: F.struct(F.col("l").alias("l"), r.alias("r"), F.lit(True).alias("left"), (F.col("at_home") & (r == F.col("own"))).alias("right")))
    as_right = F.transform(F.filter(every("lefts"), lambda v: v != F.col("l")), lambda v: F.struct(v.alias("l"), F.col("own").alias("r"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    rows = rows.withColumn("l", mine("lefts", "l")).withColumn("own", mine("rights", "r"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("at_home"), F.concat(as_left, as_right)).otherwise(as_left)))
    keys = ["label", "cell", "pl", "pr"]
    rows = rows.select("label", "cell", F.col("part.l").alias("pl"), F.col("part.r").alias("pr"), F.col("part.left").alias("left"), F.col("part.right").alias("right"), "node", "weight", "embedding", "home", "at_home", "seen")

    def run(batches: Iterator[pa.RecordBatch]):
        held, name = [], None
        for batch in batches:
            named = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            start = 0
            for k in range(1, len(named) + 1):
                if k == len(named) or named[k] != named[start]:
                    if named[start] != name and held:
                        yield found(held)
                        held = []
                    name = named[start]
                    held.append(batch.slice(start, k - start))
                    start = k
        if held:
            yield found(held)

    def found(held):
        node, counts, a, b = _Cell(held, dim).links(cosine)
        nulls = pa.nulls(len(node), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, a])), pa.array(np.concatenate([counts, np.zeros(len(a), np.int64)])), pa.concat_arrays([nulls, pa.array(b)])], ["node", "links", "other"])

    ordered = rows.repartition(shuffle_partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "node long, links long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, target: float = TARGET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label)."""
    prepare(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding", "label").withColumn("ok", usable("embedding") & F.col("label").isNotNull())
    able = rows.where("ok")
    nodes = able.groupBy("label", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "grid-nodes")  # a number, not a hash: it is the vector's identity
    most = tasks(vectors.sparkSession, nodes.count())
    found = []
    for dim in dimensions(nodes):
        part = nodes.where(F.size("embedding") == dim).select("label", "node", "weight", "embedding")
        found.append(materialize(link(part, dim, cosine, target), "grid-links", most))
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not found:
        return alone
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(links.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))
    groups = groups.withColumnRenamed("node", "member")
    named = nodes.join(groups, F.col("node") == F.col("member"), "left").join(counts, "node", "left")
    named = named.select(nodes["node"], "label", "embedding", "weight", "least", F.coalesce("component", nodes["node"]).alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    named = materialize(named, "grid-named", most)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("label", "embedding", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = able.select("vec_id", "label", "embedding").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    discard(nodes)
    return linked.union(alone)
