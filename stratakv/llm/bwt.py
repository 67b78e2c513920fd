"""Operator 8: dedup of long byte strings by a Burrows-Wheeler transform with threshold-bounded expansion.

1. Every window of SIZE bytes names an anchor, its GRAM-byte string of least hash; equal windows name equal
   anchors, so only windows whose anchor occurs twice can recur.  One shuffle of anchors finds those.
2. The windows of one recurring anchor occurrence are consecutive; the bytes they span are its context.  Equal
   contexts are counted, not compared: a context that occurs twice recurs as a whole.
3. Different contexts of an anchor meet in one task.  Over their bytes it builds a Burrows-Wheeler transform and
   expands intervals breadth first by backward extension: a boundary between two rows reached with an interval
   of length l has common prefix l.  The expansion stops at SIZE, and boundaries never reached join strings that
   share SIZE bytes.
4. An anchor whose different contexts hold more than HOT bytes (a passage that very many documents share between
   different neighbours) does not meet in one task: its windows are hashed one by one and counted by hash.
5. The windows found are joined back to their documents and covered bytes are removed.

Defined results: null texts are empty; texts shorter than a window keep all; repeated rows are occurrences of
their own (equal texts of SIZE bytes or more vanish from all rows) and have a number of their own, whatever their
doc_id, null included; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_partitions, tasks, text_batches, text_buffer
from .hashing import prefix_hash, run_starts, span_hash, window_min

SIZE, GRAM = 200, 48
#: Bytes of contexts that one transform takes; an anchor's contexts stay together.
BLOCK = 1 << 20
#: Bytes of one anchor's different contexts above which its windows are counted by hash instead.
HOT = 8 << 20


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text (uint8) in the order of the ``depth`` bytes or more that follow, by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    reach = 8
    while True:
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])]).astype(np.uint64) + np.uint64(1)
        if reach >= depth or rank.max() == n:
            return order
        key = rank << np.uint64(32)
        key[: max(n - reach, 0)] |= rank[reach:] if reach < n else np.uint64(0)
        reach *= 2


def shared_prefix_rows(order: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """For each row but the first of the order: whether it shares ``size`` bytes with the row above.

    Breadth-first backward extension over the transform: ``seen[j]`` once a boundary above row j is reached by
    the interval of a string of length l < size, whose extension by one byte to the left ends there.
    """
    n = len(text)
    last = text[order - 1]  # the transform; row of position 0 wraps around
    by_char = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)  # row of the suffix one byte longer
    step[by_char] = np.arange(n)
    seen = np.zeros(n + 1, bool)
    seen[0] = seen[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(size):
        sizes = high - low
        total = int(sizes.sum())
        rows = np.arange(total) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        group = np.repeat(np.arange(len(low)), sizes) << 8 | last[rows]
        ranked = np.argsort(group, kind="stable")
        group = group[ranked]
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if total else np.zeros(0, np.int64)
        tail = np.concatenate([edge[1:], [total]]) - 1
        new_low, new_high = step[rows[ranked[edge]]], step[rows[ranked[tail]]] + 1
        fresh = ~seen[new_high]
        seen[new_high[fresh]] = True
        low, high = new_low[fresh], new_high[fresh]
        if not len(low):
            break
    return ~seen[:n]


def recurring_starts(contexts: list[bytes], counts: list[int], size: int) -> list[np.ndarray]:
    """For each context (``counts`` times in the input) the starts of its ``size``-byte strings that occur elsewhere as well."""
    lengths = np.array([len(c) + 1 for c in contexts])
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)  # a byte that UTF-8 never has
    base = np.cumsum(lengths) - lengths
    order = suffix_order(text, size + 1)
    same = shared_prefix_rows(order, text, size)
    # rows of equal strings: an occurrence counts if the whole string lies in its context
    context = np.searchsorted(base, order, "right") - 1
    whole = order - base[context] + size < lengths[context]
    cluster = np.cumsum(~same)
    weight = np.bincount(cluster, np.asarray(counts, float)[context] * whole)
    hit = whole & (weight[cluster] >= 2)
    found_context, found_start = context[hit], (order - base[context])[hit]
    ranked = np.lexsort((found_start, found_context))
    found_context, found_start = found_context[ranked], found_start[ranked]
    edges = np.searchsorted(found_context, np.arange(len(contexts) + 1))
    return [found_start[edges[i] : edges[i + 1]] for i in range(len(contexts))]


def spans(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs of sorted window starts."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(starts[1:] - starts[:-1] > size)
    return starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + size


class _Anchors:
    """Anchor occurrences of a batch of texts: position, text, and the first and last window of each."""

    def __init__(self, batch: pa.RecordBatch, size: int, gram: int):
        self.data, self.offsets = text_buffer(batch.column("text"))
        n = len(self.data)
        self.prefix = prefix_hash(self.data)
        starts, text = run_starts(self.offsets, size)
        if not len(starts):
            self.at = self.text = self.first = self.last = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        grams = np.arange(n - gram + 1)
        hashes = span_hash(self.prefix, grams, grams + gram)
        nearest = window_min(hashes, size - gram + 1)[starts]
        change = np.flatnonzero((nearest[1:] != nearest[:-1]) | (text[1:] != text[:-1])) + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change, [len(starts)]]) - 1
        self.at, self.text = nearest[first], text[first]
        self.first, self.last = starts[first], starts[last]
        self.key = hashes[self.at]


def _contexts(docs: DataFrame, most: int, size: int, gram: int) -> DataFrame:
    """(key, context, rid, at, length, bytes): contexts of recurring anchors; bytes once a batch for equal ones."""

    def anchors(batches: Iterator[pa.RecordBatch]):
        for batch in text_batches(batches):
            a = _Anchors(batch, size, gram)
            order = np.lexsort((a.key, a.text))  # one row for each text and anchor
            key, text, place = a.key[order], a.text[order], (a.at - a.offsets[a.text])[order]
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])) if len(key) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(key)).astype(np.int32)), pa.array(place.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(key[begin].view(np.int64)), batch.column("rid").take(pa.array(text[begin])), lists], ["key", "rid", "place"])

    def contexts(batches: Iterator[pa.RecordBatch]):
        for batch in text_batches(batches):
            a = _Anchors(batch, size, gram)
            lists = batch.column("places")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(a.offsets[:-1], sizes)
            pick = np.flatnonzero(np.isin(a.at, wanted))
            begin, stop, text = a.first[pick], a.last[pick] + size, a.text[pick]
            key, context = a.key[pick], span_hash(a.prefix, begin, stop)
            one = np.zeros(len(pick), bool)
            one[np.unique(key ^ (context * np.uint64(3)), return_index=True)[1]] = True
            raw = a.data.tobytes()
            held = [raw[x:y] if o else None for x, y, o in zip(begin.tolist(), stop.tolist(), one.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), batch.column("rid").take(pa.array(text)), pa.array(begin - a.offsets[text]), pa.array((stop - begin).astype(np.int32)), pa.array(held, pa.binary())],
                ["key", "context", "rid", "at", "length", "bytes"],
            )

    found = materialize(docs.select("rid", "text").mapInArrow(anchors, "key long, rid long, place array<long>"), "bwt-anchors", most)
    # an anchor recurs if it has two occurrences, be it in one document; a table, so that a skewed join can split
    twice = materialize(found.groupBy("key").agg(F.sum(F.size("place")).alias("n")).where("n > 1").select("key"), "bwt-twice", most)
    places = materialize(found.join(twice, "key").groupBy("rid").agg(F.flatten(F.collect_list("place")).alias("places")), "bwt-places", most)
    discard(found, twice)
    out = materialize(docs.select("rid", "text").join(places, "rid").mapInArrow(contexts, "key long, context long, rid long, at long, length int, bytes binary"), "bwt-contexts", most)
    discard(places)
    return out


def _hot_runs(classes: DataFrame, size: int) -> DataFrame:
    """(key, context, starts, stops) of classes(key, context, n, bytes): every window counted by a 96-bit hash."""

    def windows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for key, context, n, data in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "n", "bytes")), strict=True):
                own = np.frombuffer(data, np.uint8)
                at = np.arange(len(own) - size + 1)
                hashes = span_hash(prefix_hash(own), at, at + size)
                other = span_hash(prefix_hash(own ^ np.uint8(0x5A)), at, at + size) >> np.uint64(32)
                same = np.full(len(at), 1, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(same * key), pa.array(same * context), pa.array(same * n), pa.array(at), pa.array(hashes.view(np.int64)), pa.array(other.astype(np.int64))], ["key", "context", "n", "start", "hash", "check"])

    every = classes.mapInArrow(windows, "key long, context long, n long, start long, hash long, check long")
    twice = every.groupBy("key", "hash", "check").agg(F.sum("n").alias("times")).where("times > 1")
    found = every.join(twice, ["key", "hash", "check"])
    return found.groupBy("key", "context").agg(F.collect_list("start").alias("starts")).select("key", "context", "starts", F.transform("starts", lambda x: x + size).alias("stops"))


def covered(docs: DataFrame, most: int, size: int = SIZE, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(rid, spans array<struct<a, b>>) of docs(rid, text): byte runs, not yet merged, that recurring strings cover."""
    contexts = _contexts(docs, most, size, gram)
    classes = contexts.groupBy("key", "context").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))

    def compare(held: list[tuple[int, int, int, bytes]]):
        """Rows of whole anchors, to their covered runs."""
        out: list[tuple[int, int, list[int], list[int]]] = []
        several: list[tuple[int, int, int, bytes]] = []
        k = 0
        while k < len(held):
            j = k
            while j < len(held) and held[j][0] == held[k][0]:
                j += 1
            if j - k > 1:
                several += held[k:j]
            elif held[k][2] > 1:
                out.append((held[k][0], held[k][1], [0], [len(held[k][3])]))
            k = j
        if several:
            for row, starts in zip(several, recurring_starts([r[3] for r in several], [r[2] for r in several], size), strict=True):
                a, b = spans(starts, size)
                if len(a):
                    out.append((row[0], row[1], a.tolist(), b.tolist()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([r[3] for r in out], pa.list_(pa.int64()))], ["key", "context", "starts", "stops"])

    def blocks(batches: Iterator[pa.RecordBatch]):
        held, bytes_ = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "n", "bytes")), strict=True):
                if bytes_ > block and row[0] != held[-1][0]:
                    yield compare(held)
                    held, bytes_ = [], 0
                held.append(row)
                bytes_ += len(row[3])
        if held:
            yield compare(held)

    n = shuffle_partitions(docs.sparkSession)
    held = contexts.groupBy("key", "context").agg(F.max("length").alias("length")).groupBy("key").agg(F.sum("length").alias("total"))
    heavy = materialize(held.where(F.col("total") > hot).select("key"), "bwt-hot", 1)
    several = heavy.count()  # each stands for more than ``hot`` bytes of the corpus
    if several:
        apart = _hot_runs(classes.join(heavy, "key"), size)
        classes = classes.join(heavy, "key", "left_anti")
    ordered = classes.repartition(n, "key").sortWithinPartitions("key", "context")
    runs = ordered.mapInArrow(blocks, "key long, context long, starts array<long>, stops array<long>")
    runs = materialize(runs.union(apart) if several else runs, "bwt-runs", most)
    joined = contexts.select("key", "context", "rid", "at").join(runs, ["key", "context"])
    pairs = F.expr("transform(arrays_zip(starts, stops), x -> struct(x.starts + at as a, x.stops + at as b))")
    out = materialize(joined.select("rid", pairs.alias("spans")).groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "bwt-spans", most)
    discard(contexts, runs, heavy)
    return out


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, keep_bytes: bool = False, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary or kept_sha256 string) for each row of docs(doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    rows = materialize(rows, "bwt-rows")  # from here on a row keeps its number
    most = tasks(docs.sparkSession, rows.count())
    found = covered(rows.select("rid", "text"), most, size, gram, block, hot)
    last, kind = ("kept", "binary") if keep_bytes else ("kept_sha256", "string")

    def clean(batches: Iterator[pa.RecordBatch]):
        for batch in text_batches(batches):
            data, offsets = text_buffer(batch.column("text"))
            n = np.diff(offsets)
            removed, pieces, values = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), []
            for i, list_ in enumerate(batch.column("spans").to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                if list_:
                    mark = np.zeros(len(own) + 1, np.int32)
                    np.add.at(mark, [x["a"] for x in list_], 1)
                    np.add.at(mark, [x["b"] for x in list_], -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    removed[i] = gone.sum()
                    pieces[i] = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    own = own[~gone]
                values.append(own.tobytes() if keep_bytes else hashlib.sha256(own.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(removed), pa.array(pieces), pa.array(values, pa.binary() if keep_bytes else pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", last])

    return rows.join(found, "rid", "left").coalesce(most).mapInArrow(clean, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {kind}")
