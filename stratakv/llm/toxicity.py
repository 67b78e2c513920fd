"""Operator 6: toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has a bigram model of continuation counts: a pair of words counts once for each
different word before it, a word once for each different word before it, so copies of a document add nothing.
Counts are discounted absolutely.  A class's pairs after a word are smoothed by the discounted pairs of both
classes together, and both give the same share of that word's mass, the jointly discounted one, to their own
word distributions; the mass discounted there goes to a backoff that both share, the words' continuations over
all documents of the corpus.  Rare expressions so get nearly equal likelihoods.

An expression is a run of EXPRESSION words, each judged after the word before it; its evidence is the difference
of the two log-likelihoods over its length, and a document's is the greatest among its expressions (a shorter
text is one expression).  A logistic curve fitted on out-of-fold evidence turns it into a score.  The discount
is the one of DISCOUNTS with the least out-of-fold loss on the learning rows; Kneser and Ney's is below 1.

Words are runs of bytes between white space and ASCII punctuation, A-Z lowered.  The class counts come from a
bounded sample (SAMPLE labelled documents of each class, by a hash of doc_id, SAMPLE_BYTES in all) and all of its words; the shared
counts are of the distinct pairs of words of all documents, for every word of the corpus.

Defined results: null and empty texts have evidence 0; without a training row of each class every score is the
share of toxic training rows (0 without any); rows with equal doc_ids share a label (the largest); null labels
teach nothing; equal rows teach once and score alike; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held, materialize, prepare, shuffle_partitions, tasks, text_batches, text_buffer
from .hashing import item_hash, mix, run_starts, words

SAMPLE, SAMPLE_BYTES, EXPRESSION = 3000, 48 << 20, 3
THRESHOLD = 0.7
#: Pairs of words that a task holds before it sends them on, and buckets over which a word's pairs are spread.
PAIRS, SPREAD = 2 << 20, 8
#: Discounts of word continuations from which the folds of the learning rows choose; pairs have twice as much, so
#: that phrases which documents share by chance back off to their words.
DISCOUNTS = (0.75, 3.0, 12.0)
#: Share of the joint pairs in a class's own.
JOINT = 0.2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, hashes of the word before and of that before it, first word of each text); 0 where a text begins."""
    data = _FOLD[data]
    start, stop, first = words(data, offsets)
    h = item_hash(data, start, stop)
    one, two = np.zeros_like(h), np.zeros_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    begins = first[:-1][first[:-1] < len(h)]
    one[begins] = two[begins] = 0
    second = begins + 1
    two[second[second < len(h)]] = 0
    return h, one, two, first


class Counts:
    """Continuation counts of one class over the vocabulary; the last number is any other word."""

    def __init__(self, vocabulary: np.ndarray, h: np.ndarray, one: np.ndarray, two: np.ndarray):
        n = len(vocabulary) + 1
        w, before = numbers(vocabulary, h), numbers(vocabulary, one)
        pair = mix(h + mix(one))
        self.word = np.bincount(w[np.unique(pair, return_index=True)[1]], minlength=n).astype(float)
        different = np.unique(mix(two + mix(pair)), return_index=True)[1]
        self.pair, self.pair_count = np.unique(before[different] * n + w[different], return_counts=True)


def numbers(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = np.searchsorted(vocabulary, h)
    place[place == len(vocabulary)] = 0
    return np.where(vocabulary[place] == h, place, len(vocabulary)) if len(vocabulary) else np.zeros(len(h), np.int64)


class Model:
    """Two classes' smoothed distributions as arrays, and the curve from evidence to score."""

    def __init__(self, vocabulary: np.ndarray, classes: list[Counts], shared: np.ndarray, discount: float, mass: float | None = None):
        self.vocabulary, self.curve = vocabulary, (0.0, 0.0)
        n = len(vocabulary) + 1
        d1, d2 = discount, 2 * discount
        backoff = (shared + 1) / (mass or (shared + 1).sum())
        pairs = np.unique(np.concatenate([c.pair for c in classes]))
        counts = np.zeros((2, len(pairs)))
        for k, c in enumerate(classes):
            counts[k, np.searchsorted(pairs, c.pair)] = c.pair_count
        joint = counts.sum(axis=0)
        before = pairs // n
        seen = np.bincount(before, joint, n)
        mass = np.bincount(before, np.maximum(joint - d2, 0), n)
        self.rest = np.where(seen > 0, 1 - mass / np.maximum(seen, 1), 1.0)
        keep = joint > d2
        self.pairs, before = pairs[keep], before[keep]
        self.direct, self.words = [], []
        for k, c in enumerate(classes):
            own = np.maximum(counts[k] - d2, 0)[keep]
            whole = np.bincount(before, own, n)[before]
            common = np.maximum(joint - d2, 0)[keep] / mass[before]
            share = np.where(whole > 0, (1 - JOINT) * own / np.maximum(whole, 1e-9) + JOINT * common, common)
            self.direct.append((1 - self.rest[before]) * share)
            off = np.minimum(c.word, d1)
            total = max(c.word.sum(), 1)
            self.words.append((c.word - off) / total + (off.sum() / total if c.word.sum() else 1.0) * backoff)

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        h, one, _, first = tokens(data, offsets)
        n = len(self.vocabulary) + 1
        w, before = numbers(self.vocabulary, h), numbers(self.vocabulary, one)
        key, logs = before * n + w, []
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        known = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        for direct, p in zip(self.direct, self.words, strict=True):
            logs.append(np.log((np.where(known, direct[at], 0) if len(direct) else 0) + self.rest[before] * p[w]))
        gain = np.concatenate([[0.0], np.cumsum(logs[0] - logs[1])])
        out = np.zeros(len(first) - 1)
        start, text = run_starts(first, EXPRESSION)
        if len(start):
            means = (gain[start + EXPRESSION] - gain[start]) / EXPRESSION
            begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            out[text[begin]] = np.maximum.reduceat(means, begin)
        short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < EXPRESSION))
        out[short] = (gain[first[short + 1]] - gain[first[short]]) / np.diff(first)[short]
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * evidence, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Newton's method for score = 1 / (1 + exp(-(a + b x))), with a small penalty on b."""
    theta, design = np.zeros(2), np.stack([np.ones_like(x), x], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + [0, ridge * theta[1]]
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, ridge])
        step = np.linalg.solve(curve, slope)
        theta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def _parts(texts: list[bytes], limit: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts as (bytes, offsets), about ``limit`` bytes at a time: what is made of them stays small."""
    part: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= limit or k == len(texts) - 1:
            yield np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64)
            part, size = [], 0


def _all_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found = [tokens(*part) for part in _parts(texts)]
    sizes = np.concatenate([np.diff(f[3]) for f in found])
    return (*(np.concatenate([f[k] for f in found]) for k in range(3)), np.concatenate([[0], np.cumsum(sizes)]))


def _planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then the second ones, and so on: leading zeros meet and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(raw: bytes, at: int, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


def _packed(word: np.ndarray, before: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, pairs) of pairs of hashes: words, how many different ones come before each, and 32 bits of each of those, as differences.

    A pair's bucket is its word's, or one of the SPREAD - 1 after it by the word before, so that a frequent word is shared.
    """
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    before = before >> np.uint64(32)
    bucket = ((mix(word) % np.uint64(buckets) + before % np.uint64(SPREAD)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((before, word, bucket))
    word, before, bucket = word[order], before[order], bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own, at, n = np.unique(word[lo:hi], return_index=True, return_counts=True)
        steps = np.diff(before[lo:hi], prepend=np.uint64(0))
        steps[at] = before[lo:hi][at]
        blob = np.uint32(len(own)).tobytes() + _planes(np.diff(own, prepend=np.uint64(0))) + _planes(n.astype("<u4")) + _planes(steps.astype("<u4"))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[lo : lo + 1]), pa.array([pack(blob)], pa.binary())], ["bucket", "pairs"])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    size = int(np.frombuffer(raw, "<u4", 1)[0])
    own, n = np.cumsum(_values(raw, 4, size, "<u8")), _values(raw, 4 + 8 * size, size, "<u4").astype(np.int64)
    steps = _values(raw, 4 + 12 * size, int(n.sum()), "<u4").astype(np.uint64)
    sums = np.cumsum(steps)
    at = np.cumsum(n) - n
    return np.repeat(own, n), sums - np.repeat(sums[at] - steps[at], n)


def _distinct(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    word, before = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    at = np.unique(mix(word + mix(before)), return_index=True)[1]
    return word[at], before[at]


def continuations(docs: DataFrame) -> DataFrame:
    """(word, n) for every word of all texts, by its hash: how many different words come before it, copies and layout aside."""
    buckets = shuffle_partitions(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]):
        found, size = [], 0
        for batch in text_batches(batches):
            h, one, _, _ = tokens(*text_buffer(batch.column("text")))
            if len(h):
                found.append(_distinct([(h, mix(one))]))
                size += len(found[-1][0])
            if size > PAIRS:
                found = [_distinct(found)]
                size = len(found[0][0])
                if size > PAIRS // 2:
                    yield from _packed(*found[0], buckets)
                    found, size = [], 0
        if found:
            yield from _packed(*_distinct(found), buckets)

    def count(batches: Iterator[pa.RecordBatch]):
        found, size, merged = [], 0, 0
        for batch in batches:
            for blob in batch.column("pairs"):
                found.append(_unpacked(blob.as_py()))
                size += len(found[-1][0])
                if size > 2 * merged + PAIRS:
                    found = [_distinct(found)]
                    size = merged = len(found[0][0])
        if found:
            word, n = np.unique(_distinct(found)[0], return_counts=True)
            for k in range(0, len(word), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(word[k : k + (1 << 16)].view(np.int64)), pa.array(n[k : k + (1 << 16)])], ["word", "n"])

    pairs = docs.select("text").mapInArrow(gather, "bucket int, pairs binary").repartition(buckets, "bucket")
    return pairs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shared_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """(continuations of the vocabulary's words, 0 for any other, and mass of all words of the corpus with one more for each).

    A word that no class has seen has no number of its own: both classes give it the same backoff but for their
    own weights of it, so that it drops out of their difference.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at = numbers(sent.value, batch.column("word").to_numpy().view(np.uint64))
            inside = np.flatnonzero(at < len(sent.value))
            yield pa.RecordBatch.from_arrays([pa.array(at[inside].astype(np.int32)), batch.column("n").take(pa.array(inside))], ["at", "n"])

    counts = materialize(continuations(docs), "toxicity-words", tasks(docs.sparkSession, docs.count()))
    words_, pairs = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = counts.mapInArrow(run, "at int, n long").toArrow()
    discard(counts)
    out = np.zeros(len(vocabulary) + 1)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out, words_ + pairs + 1


def _sample(docs: DataFrame, labels: DataFrame, seed: str) -> tuple[list[bytes], np.ndarray, dict[int, int]]:
    """(texts, whether toxic, labelled documents of each class): different texts by hash, SAMPLE of each class and SAMPLE_BYTES in all at most."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}  # two rows
    texts, toxic = [], []
    for c in sorted(sizes):
        share = min(1.0, SAMPLE / sizes[c])
        near = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < F.lit(share * (1 << 20))
        chosen = labels.where((F.col("toxic") == c) & near).select("doc_id").limit(2 * SAMPLE)  # SAMPLE are expected: small enough to broadcast
        rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).distinct()
        size = 0
        for r in rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(SAMPLE).toLocalIterator():
            size += len(r.text)
            if size > SAMPLE_BYTES // 2:
                break
            texts.append(bytes(r.text))
            toxic.append(c == 1)
    return texts, np.array(toxic, bool), sizes


def train(docs: DataFrame, labels: DataFrame, seed: str = "toxicity") -> Model | float:
    """Fit on docs(doc_id, text) and labels(doc_id, toxic), rows that may be learned from; a constant score if a class is missing."""
    prepare(docs.sparkSession)
    texts, toxic, sizes = _sample(docs, labels, seed)
    if not toxic.any() or toxic.all():
        return float(len(toxic) > 0 and toxic.all())
    h, one, two, first = _all_tokens(texts)
    vocabulary = np.unique(h)
    shared, mass = shared_counts(docs, vocabulary)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    weight = np.where(toxic, sizes[1] / toxic.sum(), sizes[0] / (~toxic).sum())

    def counts(part: np.ndarray) -> list[Counts]:
        return [Counts(vocabulary, h[pick], one[pick], two[pick]) for pick in ((part & (toxic == c))[owner] for c in (True, False))]

    folds = []
    for fold in range(2):
        part = np.arange(len(texts)) % 2 == fold
        if (toxic & part).any() and (~toxic & part).any():
            folds.append((np.flatnonzero(~part), counts(part)))
    best = None
    for discount in DISCOUNTS:
        evidence = np.zeros(len(texts))
        for rest, classes in folds:
            half = Model(vocabulary, classes, shared, discount, mass)
            evidence[rest] = np.concatenate([half.evidence(*p) for p in _parts([texts[i] for i in rest])])
        curve = logistic(evidence, toxic.astype(float), weight)
        told = 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * evidence, -40, 40)))
        loss = -(weight * np.log(np.maximum(np.where(toxic, told, 1 - told), 1e-12))).sum()
        if best is None or loss < best[0]:
            best = loss, discount, curve
    model = Model(vocabulary, counts(np.ones(len(texts), bool)), shared, best[1], mass)
    model.discount, model.curve = best[1], best[2]
    return model


def score(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of docs(doc_id, text)."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]):
        own = held(key, lambda: sent.value)
        for batch in text_batches(batches):
            n = batch.num_rows
            found = np.full(n, own) if isinstance(own, float) else own.score(own.evidence(*text_buffer(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
