"""Operator 4: BPE encoding and decoding.

The merges of a word run through a priority queue of (rank, position) over a doubly linked list of symbols;
an entry whose symbols have changed meanwhile is stale and skipped.  Decoding concatenates vocabulary
strings (the tokenizer file has no decoder, so the strings are joined by one space, as its library does).

White space always separates words, so texts are cut at ASCII white space first and the ids of each chunk
are kept in a bounded per-worker store; only unseen chunks are merged.  The rules for cutting a chunk into
words (normaliser, split pattern, byte alphabet) come from the tokenizer file.

Defined results: null and empty texts give no ids; a chunk of any length is encoded whole; strings of the
added tokens in a text become their ids, as in the library; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held, text_batches, text_buffer

KEEP = 300_000
LONGEST_KEPT = 48


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges (pair -> (rank, new id)) to a word's symbols, lowest rank first, leftmost first on ties."""
    n = len(symbols)
    if n < 2:
        return symbols
    queue = []
    for i in range(n - 1):
        found = merges.get((symbols[i], symbols[i + 1]))
        if found:
            queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    if not queue:
        return symbols
    heapq.heapify(queue)
    following = list(range(1, n)) + [-1]
    preceding = list(range(-1, n - 1))
    alive = symbols[:]
    while queue:
        _, i, left, right, new = heapq.heappop(queue)
        j = following[i]
        if alive[i] != left or j < 0 or alive[j] != right:
            continue  # stale
        alive[i] = new
        alive[j] = -1
        k = following[j]
        following[i] = k
        if k >= 0:
            preceding[k] = i
            found = merges.get((new, alive[k]))
            if found:
                heapq.heappush(queue, (found[0], i, new, alive[k], found[1]))
        h = preceding[i]
        if h >= 0:
            found = merges.get((alive[h], new))
            if found:
                heapq.heappush(queue, (found[0], h, alive[h], new, found[1]))
    return [x for x in alive if x >= 0]


#: A full stop or comma between an ASCII letter or digit and a blank or line end; written so that the marks are sought first.
_MARK_AFTER_WORD = re.compile(rb"[.,](?=[ \n])(?<=[a-z0-9][.,])")


def split_chunks(data: bytes) -> list[bytes]:
    """Pieces of a text that tokenize alone as they do together, as few different ones as is cheap.

    White space parts words anyway, and the file lowers case and parts words from marks, so ASCII letters are
    lowered here and a single mark after a word comes off, unless the text may hold added tokens.
    """
    return data.split() if b"<|" in data else _MARK_AFTER_WORD.sub(rb" \g<0>", data.lower()).split()


class _Chunks(dict):
    """chunk -> (ids as decimal text, ids), computed when first asked for; what two generations didn't ask for goes."""

    def __init__(self, encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, chunk: bytes):
        value = self.older.get(chunk)
        if value is None:
            ids = self.encoder.chunk_ids(chunk)
            value = (" ".join(map(str, ids)), tuple(ids))
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= KEEP:
                self.older = dict(self)
                self.clear()
            self[chunk] = value
        return value


class Encoder:
    """Encoder and decoder of one tokenizer file of the kind word-end BPE without decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["decoder"] is not None or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: not the kind of BPE file that this encoder reads ({odd or model['type']})")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = self.vocab
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings, default=-1) + 1)]
        self._added = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._library = Tokenizer.from_file(path)
        self._inside = {c: ids[c] for c in ids if len(c) == 1}
        self._last = {c: ids[c + self.end] for c in self._inside if c + self.end in ids}
        self._words: dict[str, list[int]] = {}
        self.chunks = _Chunks(self)

    def word_ids(self, word: str) -> list[int]:
        """ids of one pre-token, written in the byte alphabet."""
        found = self._words.get(word)
        if found is None:
            inside = self._inside
            found = merge_symbols([inside[c] for c in word[:-1]] + [self._last[word[-1]]], self.merges)
            if len(word) <= LONGEST_KEPT:
                if len(self._words) >= KEEP:
                    self._words.clear()
                self._words[word] = found
        return found

    def _plain(self, text: str) -> list[int]:
        if text.isascii() and text.isalpha():  # one word by any of the file's rules
            return self.word_ids(text.lower())
        text = self._library.normalizer.normalize_str(text)
        return [i for word, _ in self._library.pre_tokenizer.pre_tokenize_str(text) for i in self.word_ids(word)]

    def chunk_ids(self, chunk: bytes) -> list[int]:
        """ids of a text without ASCII white space."""
        text = chunk.decode("utf-8")
        if self._added is None or not self._added.search(text):
            return self._plain(text)
        out: list[int] = []
        for piece in self._added.split(text):
            if piece in self.added:
                out.append(self.added[piece])
            elif piece:
                out += self._plain(piece)
        return out

    def encode(self, text: str | bytes | None) -> list[int]:
        data = text.encode("utf-8") if isinstance(text, str) else bytes(text or b"")
        return [i for chunk in split_chunks(data) for i in self.chunks[chunk][1]]

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary strings of ids, joined as the library joins them."""
        return " ".join(map(self.strings.__getitem__, ids))

    def encode_decode(self, data: bytes) -> tuple[str, str]:
        """(ids in decimal, joined by one space; the text decoded from them)."""
        found = list(map(self.chunks.__getitem__, split_chunks(data)))
        return " ".join([x[0] for x in found if x[0]]), self.decode(chain.from_iterable([x[1] for x in found]))


def encoder(path: str) -> Encoder:
    return held(("bpe", path), lambda: Encoder(path))


def _texts(batches: Iterator[pa.RecordBatch]):
    """(batch, its texts as bytes) piece by piece."""
    for batch in text_batches(batches):
        data, offsets = text_buffer(batch.column("text"))
        raw = data.tobytes()
        yield batch, [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of docs(doc_id, text)."""

    def run(batches):
        enc = encoder(path)
        for batch, texts in _texts(batches):
            ids = [enc.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of tokens(doc_id, ids); null ids give an empty text."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding of docs(doc_id, text), digested where they are made."""

    def run(batches):
        enc = encoder(path)
        for batch, texts in _texts(batches):
            n, a, b = [], [], []
            for t in texts:
                ids, decoded = enc.encode_decode(t)
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
