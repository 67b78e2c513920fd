"""Operator 3: SimHash near-duplicates by binary trie self-joins.

Fingerprints that differ in at most ``budget`` bits agree on at least two of budget + 2 blocks of bits, so the
distinct fingerprints are dealt out once for each pair of blocks, by the two values: groups of 20 bits or more stay
small however many fingerprints there are.  Within such a group a binary trie over the fingerprints is joined with
itself: pairs of nodes are traversed together from the root, the bits in which their paths differ are accumulated,
and a pair over the budget is pruned with all below it.  Many groups are traversed at once.  A group too large for
one task is dealt out further by the next bits of the trie: each part holds the pairs of two nodes of that depth, if
their own difference leaves budget.  A part returns a forest that spans its links, never its pairs.  Components of
the forests are found on the cluster.

Defined results: null and wordless texts have fingerprint zero and link like any other; equal fingerprints are
one node; repeated rows and extra columns change nothing; a null doc_id links as others do but names no component
(component_id is null where no member has one); texts of any length are read whole; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, drop_held, materialize, prepare, tasks, text_batches, text_buffer
from .components import components
from .hashing import run_starts, spaced, words

WORDS, BUDGET, SEED = 4, 4, 42
#: Rows of a group above which it is dealt out further.
LARGE = 4096
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _normalized(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased texts with one space after each word, and each word's span there."""
    start, stop, first = words(data, offsets)
    out, begin = spaced(data, start, stop)
    return _LOWER[out], begin, begin + (stop - start), first


def fingerprints(batches: Iterator[pa.RecordBatch], size: int = WORDS) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(doc_ids, fingerprints) of batches with doc_id and text."""
    from xxhash import xxh64_intdigest

    for batch in text_batches(batches):
        data, offsets = text_buffer(batch.column("text"))
        text, begin, stop, first = _normalized(data, offsets)
        raw = text.tobytes()
        n = len(offsets) - 1
        prints = np.zeros(n, np.uint64)
        counts = np.diff(first)
        at, owner = run_starts(first, size)
        a, b = begin[at], stop[at + size - 1] if len(at) else stop[at]
        short = np.flatnonzero((counts > 0) & (counts < size))  # the whole sequence is the only shingle
        a = np.concatenate([a, begin[first[short]]])
        b = np.concatenate([b, stop[first[short + 1] - 1]])
        owner = np.concatenate([owner, short])
        h = np.array([xxh64_intdigest(raw[x:y], 42) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
        edges = np.searchsorted(owner, np.arange(n + 1))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for i in range(n):
            x, y = edges[i], edges[i + 1]
            if y > x:
                votes = bits[x:y].sum(axis=0, dtype=np.int64)
                prints[i] = np.packbits(votes * 2 > y - x).view(">u8")[0]
        yield batch.column("doc_id"), prints


def blocks(budget: int) -> list[tuple[int, int]]:
    """(bits below, width) of budget + 2 blocks that cover 64 bits, the topmost first."""
    n = budget + 2
    edges = [64 - 64 * k // n for k in range(n + 1)]
    return [(edges[k + 1], edges[k] - edges[k + 1]) for k in range(n)]


class Forest:
    """Union-find over positions; joins by arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.joined = False

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[x]
        while True:
            nxt = p[r]
            if (nxt == r).all():
                return r
            r = nxt

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.joined = True
        while len(a):
            a, b = self.roots(a), self.roots(b)
            different = a != b
            a, b = a[different], b[different]
            if not len(a):
                break
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.parent, high, low)
        self.parent = self.roots(np.arange(len(self.parent)))


def trie_join(prints: np.ndarray, budget: int, starts: np.ndarray | None = None, stops: np.ndarray | None = None, depth: int = 0, chunk: int = 1 << 20) -> Forest:
    """Forest over distinct fingerprints whose trees are the components of links within budget bits.

    The trie is implicit: a node of depth d is the range of positions that share their first d bits.  Pairs of
    nodes whose leaves are all in one tree already are pruned too.  starts, stops: ranges of positions, each sorted
    and a trie of its own; all of a range's prints share their first ``depth`` bits.
    """
    n = len(prints)
    forest = Forest(n)
    if starts is None:
        starts, stops = np.zeros(1, np.int64), np.full(1, n)
    starts, stops = starts[stops - starts > 1], stops[stops - starts > 1]
    if not len(starts):
        return forest
    # frames of node pairs: ranges [a0, a1) and [b0, b1) with a0 <= b0, bits that differ, depth; kept as a stack
    stack = [(starts, stops, starts, stops, np.zeros(len(starts), np.int64), depth)]
    while stack:
        a0, a1, b0, b1, spent, depth = stack.pop()
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            near = (x != y) & (np.bitwise_count(prints[x] ^ prints[y]) <= budget)
            if near.any():
                forest.join(x[near], y[near])
            rest = ~leaf
            a0, a1, b0, b1, spent = a0[rest], a1[rest], b0[rest], b1[rest], spent[rest]
        if not len(a0):
            continue
        if forest.joined:  # whole subtrees in one tree: nothing to add
            roots = forest.parent
            flat = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
            one = (roots[a0] == roots[b0]) & (flat[a1 - 1] == flat[a0]) & (flat[b1 - 1] == flat[b0])
            if one.any():
                rest = ~one
                a0, a1, b0, b1, spent = a0[rest], a1[rest], b0[rest], b1[rest], spent[rest]
                if not len(a0):
                    continue
        if depth == 64:
            continue
        bit = np.uint64(63 - depth)
        am, bm = _split(prints, a0, a1, bit), _split(prints, b0, b1, bit)
        same = a0 == b0
        parts = []
        for x0, x1, y0, y1, cost, twice in ((a0, am, b0, bm, 0, False), (am, a1, bm, b1, 0, False), (a0, am, bm, b1, 1, False), (am, a1, b0, bm, 1, True)):
            ok = (x1 > x0) & (y1 > y0) & (spent + cost <= budget)
            if twice:
                ok &= ~same
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], spent[ok] + cost))
        merged = [np.concatenate(z) for z in zip(*parts, strict=True)]
        for k in range(0, len(merged[0]), chunk):
            stack.append((*[z[k : k + chunk] for z in merged], depth + 1))
    return forest


def _split(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """For each node, the first position with the bit set: a binary search of all nodes at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = np.zeros(len(lo), bool)
        one[open_] = (prints[mid[open_]] >> bit) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def links(distinct: DataFrame, budget: int = BUDGET, large: int = LARGE) -> DataFrame:
    """(a, b): edges of forests that connect all of distinct(fp long) within budget bits."""
    cuts = blocks(budget)
    pairs = [(i, j) for j in range(len(cuts)) for i in range(j)]
    widths = [cuts[i][1] + cuts[j][1] for i, j in pairs]

    def moved(pair):
        """The fingerprint with the pair's blocks first, so that the trie below a group starts after them."""
        out, below = F.lit(0).cast("long"), 64
        for k in (*pair, *[k for k in range(len(cuts)) if k not in pair]):
            low, width = cuts[k]
            below -= width
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)), below))
        return out

    dealt = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), moved(p).alias("rot")) for k, p in enumerate(pairs)])).alias("x")).select("fp", "x.*")
    width = F.element_at(F.array(*map(F.lit, widths)), F.col("block") + 1)
    dealt = dealt.withColumn("w", width).withColumn("value", F.expr("shiftrightunsigned(rot, 64 - w)"))
    counts = dealt.groupBy("block", "value").count().where(F.col("count") > 1)
    # Depth at which a large group is cut into nodes: about ``large`` rows a node if bits were even.
    depth = F.when(F.col("count") <= large, F.lit(0)).otherwise(F.least(F.lit(12), F.ceil(F.log2(F.col("count") / large)).cast("int") + 1))
    rows = dealt.join(counts.select("block", "value", depth.alias("depth")), ["block", "value"])
    node = F.expr("cast(shiftrightunsigned(shiftleft(rot, w), 64 - depth) as int)")
    rows = rows.withColumn("node", F.when(F.col("depth") == 0, F.lit(0)).otherwise(node))
    # A node meets every node within budget of it; the part is named by the two, the smaller first.
    codes = F.filter(F.sequence(F.lit(0), F.expr("cast(shiftleft(1, depth) - 1 as int)")), lambda c: F.bit_count(c.bitwiseXOR(F.col("node"))) <= budget)
    parts = rows.withColumn("mate", F.explode(F.when(F.col("depth") == 0, F.array(F.lit(0))).otherwise(codes)))
    keys = ["block", "value", "p", "q"]
    parts = parts.select("block", "value", F.least("node", "mate").alias("p"), F.greatest("node", "mate").alias("q"), "rot", "fp")

    def joined(batches: Iterator[pa.RecordBatch]):
        """Rows come sorted by part; whole parts are joined together, some 65,536 rows at a time."""
        rest = np.zeros((len(keys) + 2, 0), np.int64)
        for batch in batches:
            rest = np.concatenate([rest, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*keys, "rot", "fp")])], axis=1)
            edges = _edges_of(rest)
            if rest.shape[1] > 1 << 16 and len(edges) > 2:
                yield spanned(rest[:, : edges[-2]], edges[:-1])
                rest = rest[:, edges[-2] :]
        if rest.shape[1]:
            yield spanned(rest, _edges_of(rest))

    def _edges_of(rows):
        n = rows.shape[1]
        return np.concatenate([[0], np.flatnonzero((rows[: len(keys), 1:] != rows[: len(keys), :-1]).any(axis=0)) + 1, [n]]) if n else np.zeros(1, np.int64)

    def spanned(rows, edges):
        root = trie_join(rows[-2].view(np.uint64), budget, edges[:-1], edges[1:], min(widths)).parent
        off = np.flatnonzero(root != np.arange(len(root)))
        fp = rows[-1]
        return pa.RecordBatch.from_arrays([pa.array(fp[off]), pa.array(fp[root[off]])], ["a", "b"])

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_parts = parts.repartition(n, *keys).sortWithinPartitions(*keys, "rot")
    return sorted_parts.mapInArrow(joined, "a long, b long")


def fingerprint_table(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches):
        drop_held()
        for ids, prints in fingerprints(batches, size):
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _components(table: DataFrame, budget: int, most: int) -> DataFrame:
    """(fp, least, component) of the distinct fingerprints of table(doc_id, fp); component is a fingerprint, never null."""
    distinct = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct", most)
    found = components(links(distinct.select("fp"), budget), most)
    named = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "simhash-named", most)
    discard(distinct)
    return named


def near_duplicates(docs: DataFrame, size: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text)."""
    prepare(docs.sparkSession)
    table = materialize(fingerprint_table(docs, size), "simhash")
    most = tasks(docs.sparkSession, table.count())
    named = _components(table, budget, most)
    # component of each fingerprint, then the least doc_id of each component
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = named.join(least, "component").select("fp", "component_id")
    return table.join(out, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id").coalesce(most)


def representatives(docs: DataFrame, size: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """One row of docs(doc_id, text, ...) for each component, whatever the doc_ids: the least by doc_id, null last, then by the rest.

    Rows meet their component by their own fingerprint, never by doc_id; only rows that hold their component's
    least doc_id are compared further, by a digest and then by the row itself.
    """

    columns = docs.columns

    def run(batches):
        drop_held()
        for batch in batches:
            prints = np.concatenate([np.zeros(0, np.uint64), *[p for _, p in fingerprints([batch.select(["doc_id", "text"])], size)]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], [*columns, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = materialize(docs.mapInArrow(run, f"{schema}, fp long"), "simhash-rows")
    most = tasks(docs.sparkSession, rows.count())
    named = _components(rows.select("doc_id", "fp"), budget, most)
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    wanted = named.withColumnRenamed("least", "own").join(least, "component").where(F.col("own").eqNullSafe(F.col("least"))).select(F.col("fp").alias("print"), "component", "least")
    near = rows.join(wanted, (F.col("fp") == F.col("print")) & F.col("doc_id").eqNullSafe(F.col("least")))
    order = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in ("text", *[c for c in columns if c not in ("doc_id", "text")])])
    kept = near.groupBy("component").agg(F.min(F.struct(order.alias("o"), F.struct(*columns).alias("x"))).alias("m"))
    return kept.select("m.x.*").coalesce(most)
