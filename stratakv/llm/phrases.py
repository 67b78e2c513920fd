"""Operator 7: substring dedup by repeated-phrase automata.

1. Every window of SIZE words names an anchor, its GRAM-word run of least hash; equal windows name equal anchors.
   Anchors that occur in two documents are found by an aggregate that combines before the shuffle.
2. The documents' pieces around those anchors (the words that their windows span) are dealt out by anchor; equal
   pieces are one row a batch of texts, with their least and greatest doc_id.  An anchor of more than HOT documents is dealt out
   further, one window a piece under that window's own hash, so that no anchor is a task.
3. In each shard, some BLOCK bytes of pieces, windows are confirmed by their words: passages that recur in a later
   document than their first.  They are compiled into an Aho-Corasick automaton that carries each passage's first
   document, all pieces of the shard are streamed through it, and its hits, joined back to the documents, are what
   a document with a greater doc_id loses.

Defined results: null and wordless texts have no words and keep the empty string; texts shorter than a window
keep all; of documents with equal doc_ids none is earlier than the other; a null doc_id counts as the largest;
rows are told apart by a number of their own, so rows of any doc_id may repeat; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, drop_held, materialize, shuffle_partitions, tasks, text_batches, text_buffer
from .hashing import gram_hash, item_hash, mix, run_starts, sequence_hash, spaced, window_min, words

SIZE, GRAM = 13, 6
#: Documents of an anchor above which its windows are dealt out one by one, and bytes of pieces in a shard's automaton.
HOT, BLOCK = 1000, 32 << 10
_LAST = (1 << 63) - 1


class _Words:
    """Words of a batch of texts, their hashes, and for each window the position and hash of its anchor."""

    def __init__(self, batch: pa.RecordBatch, size: int, gram: int):
        self.data, offsets = text_buffer(batch.column("text"))
        self.start, self.stop, self.first = words(self.data, offsets)
        self.hash = item_hash(self.data, self.start, self.stop)
        self.window, self.text = run_starts(self.first, size)
        grams = gram_hash(self.hash, gram)
        self.place = window_min(grams, size - gram + 1)[self.window] if len(self.window) else np.zeros(0, np.int64)
        self.anchor = grams[self.place] if len(self.window) else np.zeros(0, np.uint64)

    def among(self, lists: pa.Array) -> np.ndarray:
        """Which windows have one of their own text's values (a list column) as anchor."""
        wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.isin(_tagged(self.anchor, self.text), _tagged(wanted, np.repeat(np.arange(len(sizes)), sizes)))


def _tagged(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(values + mix(text.astype(np.uint64) + np.uint64(1)))


def _anchors(rows: DataFrame, size: int, gram: int, hot: int, most: int) -> DataFrame:
    """(rid, anchors, many): of each row of rows(rid, id, text) the anchors that occur in two documents, and which of them in more than ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]):
        drop_held()
        for batch in text_batches(batches):
            w = _Words(batch, size, gram)
            at = np.unique(_tagged(w.anchor, w.text), return_index=True)[1]
            owner = pa.array(w.text[at])
            yield pa.RecordBatch.from_arrays([pa.array(w.anchor[at].view(np.int64)), batch.column("rid").take(owner), batch.column("id").take(owner)], ["anchor", "rid", "id"])

    named = materialize(rows.mapInArrow(run, "anchor long, rid long, id long"), "phrase-anchors", most)
    found = named.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("greatest"), F.count("*").alias("n"))
    found = materialize(found.where("least < greatest").select("anchor", (F.col("n") > hot).alias("many")), "phrase-recurring", most)
    lists = named.select("anchor", "rid").join(found, "anchor").groupBy("rid").agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("many"), F.col("anchor"))).alias("many"))
    lists = materialize(lists, "phrase-lists", most)
    discard(named, found)
    return lists


def _pieces(rows: DataFrame, lists: DataFrame, size: int, gram: int) -> DataFrame:
    """(key, piece, rid, id, at, least, greatest, words): where pieces lie.

    Once a batch for equal pieces: the words, with a space after each, and the batch's least and greatest id.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        drop_held()
        for batch in text_batches(batches):
            w = _Words(batch, size, gram)
            chosen, alone = w.among(batch.column("anchors")), w.among(batch.column("many"))
            at = np.flatnonzero(chosen)
            if not len(at):
                continue
            cut = alone[at]
            cut[1:] |= (w.place[at[1:]] != w.place[at[:-1]]) | (w.text[at[1:]] != w.text[at[:-1]])
            cut[0] = True
            begin = np.flatnonzero(cut)
            end = np.append(begin[1:], len(at)) - 1
            own, text = at[begin], w.text[at[begin]]
            lo, hi = w.window[own], w.window[at[end]] + size
            piece = sequence_hash(w.hash, lo, hi)
            key = np.where(alone[own], piece, w.anchor[own])
            ids = batch.column("id").to_numpy()[text]
            _, one, group = np.unique(mix(key) + piece, return_index=True, return_inverse=True)
            least, greatest = np.full(len(one), _LAST), np.full(len(one), -_LAST - 1)
            np.minimum.at(least, group, ids)
            np.maximum.at(greatest, group, ids)
            first = np.zeros(len(lo), bool)
            first[one] = True
            raw, place = spaced(w.data, w.start, w.stop)
            raw, place = raw.tobytes(), np.append(place, len(raw))
            held = [raw[x:y] if o else None for x, y, o in zip(place[lo].tolist(), place[hi].tolist(), first.tolist(), strict=True)]
            bounds = [pa.array(x[group], mask=~first) for x in (least, greatest)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(piece.view(np.int64)), batch.column("rid").take(pa.array(text)), pa.array(ids), pa.array((lo - w.first[text]).astype(np.int32)), *bounds, pa.array(held, pa.binary())],
                ["key", "piece", "rid", "id", "at", "least", "greatest", "words"],
            )

    return rows.join(lists, "rid").mapInArrow(run, "key long, piece long, rid long, id long, at int, least long, greatest long, words binary")


def compile_automaton(passages: dict[tuple[int, ...], int]):
    """Automaton over word numbers that gives each passage's length and first document where the passage ends."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for passage, first in passages.items():
        automaton.add_word(passage, (len(passage), first))
    automaton.make_automaton()
    return automaton


def located(keys: list[int], pieces: list[bytes], least: list[int], greatest: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """For each piece, of documents from ``least`` to ``greatest``: (start, stop, first document) of its words that recur in a later document.

    Pieces come sorted by key, and equal windows have one key: the only piece of a key recurs as a whole or not at
    all, the windows of several are confirmed one by one.
    """
    number: dict[bytes, int] = defaultdict(count().__next__).__getitem__
    sequences = [tuple(map(number, p.split(b" ")[:-1])) for p in pieces]
    confirmed: dict[tuple[int, ...], int] = {}
    k = 0
    while k < len(keys):
        j = k + 1
        while j < len(keys) and keys[j] == keys[k]:
            j += 1
        if j - k == 1:
            if least[k] < greatest[k]:
                confirmed[sequences[k]] = least[k]
        else:
            first: dict[tuple[int, ...], int] = {}
            last: dict[tuple[int, ...], int] = {}
            for s, a, b in zip(sequences[k:j], least[k:j], greatest[k:j], strict=True):
                for at in range(len(s) - size + 1):
                    w = s[at : at + size]
                    if first.setdefault(w, a) > a:
                        first[w] = a
                    if last.setdefault(w, b) < b:
                        last[w] = b
            confirmed.update((w, a) for w, a in first.items() if a < last[w])
        k = j
    out: list[list[tuple[int, int, int]]] = [[] for _ in pieces]
    if not confirmed:
        return out
    automaton = compile_automaton(confirmed)
    for s, b, runs in zip(sequences, greatest, out, strict=True):
        for end, (n, a) in automaton.iter(s):
            if a < b:
                if runs and runs[-1][2] == a and runs[-1][1] == end:
                    runs[-1] = (runs[-1][0], end + 1, a)
                else:
                    runs.append((end + 1 - n, end + 1, a))
    return out


def _located(pieces: DataFrame, size: int, block: int) -> DataFrame:
    """(key, piece, runs array<struct<start, stop, first>>) of the pieces that hold a confirmed passage of an earlier document."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, size_ = [], 0
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("first", pa.int64())]))

        def flush():
            runs = located([h[0] for h in held], [h[2] for h in held], [h[3] for h in held], [h[4] for h in held], size)
            some = [(h[0], h[1], [{"start": a, "stop": b, "first": f} for a, b, f in r]) for h, r in zip(held, runs, strict=True) if r]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64()), pa.array([x[2] for x in some], kind)], ["key", "piece", "runs"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "words", "least", "greatest")), strict=True):
                if held and row[:2] == held[-1][:2]:
                    held[-1] = (*row[:3], min(row[3], held[-1][3]), max(row[4], held[-1][4]))
                    continue
                if size_ > block and row[0] != held[-1][0]:
                    yield flush()
                    held, size_ = [], 0
                held.append(row)
                size_ += len(row[2])
        if held:
            yield flush()

    classes = pieces.where("words is not null").select("key", "piece", "words", "least", "greatest")  # equal pieces of a batch are one row already
    ordered = classes.repartition(shuffle_partitions(pieces.sparkSession), "key").sortWithinPartitions("key", "piece")
    return ordered.mapInArrow(run, "key long, piece long, runs array<struct<start:int, stop:int, first:long>>")


def removable(rows: DataFrame, most: int, size: int = SIZE, gram: int = GRAM, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(rid, spans array<struct<a, b>>) of rows(rid, id, text): runs of words, not yet merged, that an earlier document has as well."""
    lists = _anchors(rows, size, gram, hot, most)
    pieces = materialize(_pieces(rows, lists, size, gram), "phrase-pieces", most)
    discard(lists)
    runs = materialize(_located(pieces, size, block), "phrase-runs", most)
    mine = pieces.select("key", "piece", "rid", "id", "at").join(runs, ["key", "piece"])
    spans = F.expr("transform(filter(runs, r -> r.first < id), r -> struct(r.start + at as a, r.stop + at as b))")
    mine = mine.select("rid", spans.alias("spans")).where("size(spans) > 0")
    out = materialize(mine.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "phrase-spans", most)
    discard(pieces, runs)
    return out


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, keep_text: bool = False, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs(doc_id, text), or kept_sha256 instead of kept.

    keep_text: kept is the text itself where nothing was removed, else the remaining words joined by one space,
    and the other columns of docs are returned too (but for those named as results).  Without it, the digest is
    that of the joined words.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed", "kept")] if keep_text else []
    extra = [f"extra_{k}" for k in range(len(others))]  # no name of theirs meets one of ours
    rows = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(x) for c, x in zip(others, extra, strict=True)])
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(_LAST))).withColumn("rid", F.monotonically_increasing_id())
    rows = materialize(rows, "phrase-rows")  # from here on a row keeps its number
    most = tasks(docs.sparkSession, rows.count())
    found = removable(rows.select("rid", "id", "text"), most, size, gram, hot, block)
    last = "kept" if keep_text else "kept_sha256"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("doc_id", *extra).schema)

    def clean(batches: Iterator[pa.RecordBatch]):
        for batch in text_batches(batches):
            data, offsets = text_buffer(batch.column("text"))
            start, stop, first = words(data, offsets)
            lists = batch.column("spans")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            base = np.repeat(first[:-1], sizes)
            mark = np.zeros(len(start) + 1, np.int32)
            for field, step in (("a", 1), ("b", -1)):
                np.add.at(mark, base + lists.flatten().field(field).to_numpy(zero_copy_only=False), step)
            covered = np.cumsum(mark[:-1]) > 0
            out, begin = spaced(data, start, stop, ~covered)
            edges = np.concatenate([[0], np.cumsum(~covered)])[first]
            bounds = np.concatenate([begin, [len(out)]])[edges]
            raw = out.tobytes()
            texts = [raw[a : b - 1] if b > a else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            n = np.diff(first)
            if keep_text:
                same = np.diff(edges) == n
                whole = batch.column("text").to_pylist()
                texts = [a if s else b for a, b, s in zip(whole, texts, same.tolist(), strict=True)]
            values = pa.array([t.decode("utf-8") for t in texts], pa.string()) if keep_text else pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in extra], pa.array(n), pa.array(n - np.diff(edges)), values], ["doc_id", *extra, "n_words", "n_removed", last])

    out = rows.drop("id").join(found, "rid", "left").mapInArrow(clean, f"{schema}, n_words long, n_removed long, {last} string")
    return out.coalesce(most).withColumnsRenamed(dict(zip(extra, others, strict=True)))
