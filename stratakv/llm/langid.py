"""Operator 10: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (a sentencepiece file; its 256
byte pieces make every text segmentable).  A word's likelihood is the sum over all its segmentations of the
product of piece probabilities, by a forward pass over its bytes; a text's is the product over its words.
Piece probabilities come from expectation maximisation over the training words, started from longest-match
neutral weights.  The prediction is the language of greatest likelihood, its score the posterior share.

The model is fitted on a bounded sample: about SAMPLE_DOCS whole documents of each language, chosen by a hash
of doc_id and text, and the WORDS most frequent words of each (ties by bytes).  Training words longer than 64
bytes are cut there between characters.  Scoring covers every word of every text, whatever its length; sums are
rescaled by language, so that no word is out of range.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if no
training row exists.  Ties go to the language first in code point order.  Repeated rows score alike; extra
columns are ignored unless asked for; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, text_batches, text_buffer
from .hashing import prefix_hash, span_hash

SAMPLE_DOCS, WORDS, ROUNDS, LONGEST = 600, 20_000, 2, 16
KEEP = 300_000
MOST_BROADCAST = 10_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MARK = "▁".encode()


def held_out(modulus: int, remainder: int):
    """The fold by crc32 of the doc_id's text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces as bytes, the byte pieces first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = [bytes([b]) for b in range(256)]
    known = set(out)
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).encode("utf-8")
            if piece not in known and len(piece) <= LONGEST:
                known.add(piece)
                out.append(piece)
    return out


class Lattice:
    """All segmentations of words into pieces, as arrays."""

    def __init__(self, vocabulary: list[bytes]):
        data = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum([len(p) for p in vocabulary])
        starts = ends - [len(p) for p in vocabulary]
        hashes = span_hash(prefix_hash(data), starts, ends)
        # direct lookup: slots of a power of two, a second table for pieces whose slot is taken
        self.bits = np.uint64(64 - 20)
        self.tables = []
        left = np.arange(len(vocabulary))
        while len(left):
            slot = (hashes[left] << np.uint64(20 * len(self.tables) % 40)) >> self.bits
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << 20, -1, np.int32)
            table[slot[first]] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)
        self.hashes = hashes
        self.size = len(vocabulary)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        for k, table in enumerate(self.tables):
            found = table[(hashes << np.uint64(20 * k % 40)) >> self.bits]
            same = (found >= 0) & (self.hashes[found] == hashes)
            out[same] = found[same]
        return out

    def arcs(self, words: list[bytes]):
        """Words sorted by length, and for each end byte and piece length the words and pieces that meet there."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        words = [words[i] for i in order]
        lengths = lengths[order]
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        prefix = prefix_hash(data)
        arcs = []
        for stop in range(1, int(lengths[0]) + 1 if len(lengths) else 1):
            alive = int(np.searchsorted(-lengths, -stop, "right"))
            at = begin[:alive]
            step = []
            for length in range(1, min(stop, LONGEST) + 1):
                found = self.lookup(span_hash(prefix, at + stop - length, at + stop))
                rows = np.flatnonzero(found >= 0)
                if len(rows):
                    step.append((length, rows, found[rows]))
            arcs.append((alive, step))
        return order, lengths, arcs

    def forward(self, words: list[bytes], p: np.ndarray) -> np.ndarray:
        """log-likelihood of each word (rows) in each language (columns of p); summed over all segmentations."""
        out = np.zeros((len(words), p.shape[1]))
        if not words:
            return out
        order, lengths, arcs = self.arcs(words)
        n, scale = len(words), np.zeros((len(words), p.shape[1]))
        alpha = [np.ones((n, p.shape[1]))]
        for stop, (alive, step) in enumerate(arcs, 1):
            now = np.zeros((alive, p.shape[1]))
            for length, rows, found in step:
                now[rows] += alpha[stop - length][rows] * p[found]
            done = int(np.searchsorted(-lengths, -stop - 1, "right"))
            scale[done:alive] += np.log(np.maximum(now[done:alive], 1e-300))
            if stop % 8 == 0 and done:  # keep long words within range, each language by itself
                top = np.maximum(now[:done], 1e-300)
                for back in range(max(0, stop - LONGEST), stop):
                    alpha[back] = alpha[back][:done] / top
                now = now[:done] / top
                scale[:done] += np.log(top)
            alpha.append(now)
            if stop >= LONGEST:
                alpha[stop - LONGEST] = None
        out[order] = scale
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts of the words under one language's probabilities p."""
        order, lengths, arcs = self.arcs(words)
        weight = counts[order]
        alpha = [np.ones(len(words))]
        for stop, (alive, step) in enumerate(arcs, 1):
            now = np.zeros(alive)
            for length, rows, found in step:
                now[rows] += alpha[stop - length][rows] * p[found]
            alpha.append(now)
        total = np.array([alpha[length][i] for i, length in enumerate(lengths)])
        beta = [np.zeros(len(words)) for _ in range(len(arcs) + 1)]
        for i, length in enumerate(lengths):
            beta[length][i] = 1
        out = np.zeros(self.size)
        for stop in range(len(arcs), 0, -1):
            for length, rows, found in arcs[stop - 1][1]:
                through = beta[stop][rows] * p[found]
                beta[stop - length][rows] += through
                out += np.bincount(found, weight[rows] * alpha[stop - length][rows] * through / np.maximum(total[rows], 1e-300), self.size)
        return out


def cut(word: bytes, limit: int = 64) -> list[bytes]:
    """A word in parts of at most ``limit`` bytes that end between characters: scripts without spaces have long ones."""
    out = []
    while len(word) > limit:
        at = limit
        while at > limit - 4 and word[at] & 0xC0 == 0x80:
            at -= 1
        out.append(word[:at])
        word = word[at:]
    return [*out, word]


def training_words(docs: DataFrame, seed: str = "langid") -> list[tuple[str, bytes, int]]:
    """(lang, word, count) over the bounded sample of docs(doc_id, text, lang); lower-cased words."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = docs.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(SAMPLE_DOCS) / F.count("*")).alias("share"))
    few = sizes.limit(MOST_BROADCAST + 1).collect()
    if len(few) <= MOST_BROADCAST:  # so many languages at most are sent to all tasks; more are joined by a shuffle
        sizes = F.broadcast(docs.sparkSession.createDataFrame(few, sizes.schema))
    chosen = docs.join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def count(batches):
        from collections import Counter

        for batch in text_batches(batches):
            data, offsets = text_buffer(batch.column("text"))
            raw, seen = data.tobytes(), {}
            for lang, a, b in zip(batch.column("lang").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                seen.setdefault(lang, Counter()).update(x for w in raw[a:b].decode("utf-8").lower().encode("utf-8").split() for x in cut(w))
            for lang, words in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    words = chosen.select("lang", "text").mapInArrow(count, "lang string, word binary, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return [(r.lang, bytes(r.word), r.n) for r in words.collect()]


class Model:
    def __init__(self, languages: list[str], vocabulary: list[bytes], p: np.ndarray):
        self.languages, self.vocabulary, self.p = languages, vocabulary, p


def train(docs: DataFrame, path: str) -> Model:
    """Fit a model on docs(doc_id, text, lang); the caller leaves out what must not be learned from."""
    vocabulary = pieces(path)
    lattice = Lattice(vocabulary)
    by: dict[str, list[tuple[int, bytes]]] = {}
    for lang, word, n in training_words(docs):
        by.setdefault(lang, []).append((-n, word))
    languages = sorted(by, key=lambda x: x.encode())
    start = 1.0 / 256 ** np.minimum([len(x) for x in vocabulary], 4)
    columns = []
    for lang in languages:
        rows = sorted(by[lang])[:WORDS]
        words, counts = [_MARK + w for _, w in rows], np.array([-n for n, _ in rows], float)
        p = start / start.sum()
        for _ in range(ROUNDS):
            expected = lattice.expected(words, counts, p)
            expected += 0.5 / len(vocabulary) * max(1.0, expected.sum() * 1e-3)
            p = expected / expected.sum()
        columns.append(p)
    return Model(languages, vocabulary, np.stack(columns, axis=1) if columns else np.zeros((len(vocabulary), 0)))


class _Scorer:
    def __init__(self, model: Model):
        self.lattice, self.p = Lattice(model.vocabulary), model.p
        self.rows: dict[bytes, int] = {}
        self.values = np.zeros((1 << 12, self.p.shape[1]))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Sum over each text's words of their log-likelihoods."""
        words = [t.split() for t in texts]
        rows = self.rows
        unseen = list({w for ws in words for w in ws if w not in rows})
        if len(rows) + len(unseen) > KEEP:
            rows.clear()
            unseen = list({w for ws in words for w in ws})
        need = len(rows) + len(unseen)
        if need > len(self.values):
            grown = np.zeros((max(need, min(2 * len(self.values), KEEP)), self.values.shape[1]))
            grown[: len(self.values)] = self.values
            self.values = grown
        unseen.sort(key=len)
        for k in range(0, len(unseen), 8192):
            part = unseen[k : k + 8192]
            at = len(rows)
            self.values[at : at + len(part)] = self.lattice.forward([_MARK + w for w in part], self.p)
            rows.update(zip(part, range(at, at + len(part)), strict=True))
        out = np.zeros((len(texts), self.p.shape[1]))
        for i, ws in enumerate(words):
            if ws:
                out[i] = self.values[[rows[w] for w in ws]].sum(axis=0)
        return out


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, lang_pred, score) of docs(doc_id, text)."""
    import uuid

    spark = docs.sparkSession
    sent, key = spark.sparkContext.broadcast((model.languages, model.vocabulary, model.p)), uuid.uuid4().hex
    docs = docs.select(*dict.fromkeys(("doc_id", "text", *keep)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text" or "text" in keep)

    def run(batches: Iterator[pa.RecordBatch]):
        scorer, languages = held(key, lambda: _Scorer(Model(*sent.value))), [*sent.value[0], UNKNOWN]
        for batch in text_batches(batches):
            data, offsets = text_buffer(batch.column("text"))
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            known = np.array([bool(_LETTER.search(t)) for t in texts]) & (len(languages) > 1)
            best, share = np.full(len(texts), len(languages) - 1), np.zeros(len(texts))
            if known.any():
                logs = scorer.score([t.lower().encode("utf-8") if k else b"" for t, k in zip(texts, known, strict=True)])
                top = logs.argmax(axis=1)
                posterior = 1 / np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -700)).sum(axis=1)
                best, share = np.where(known, top, best), np.where(known, posterior, 0.0)
            columns = [batch.column(c) for c in batch.schema.names if c != "text" or "text" in keep]
            names = [c for c in batch.schema.names if c != "text" or "text" in keep]
            if "text" in keep:
                k = names.index("text")
                columns[k] = pa.array([t if ok else None for t, ok in zip(texts, batch.column("text").is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([languages[i] for i in best], pa.string()), pa.array(share, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")
