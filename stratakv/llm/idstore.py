"""Operator 5: token ids as binary files under one shared zstandard dictionary.

Documents are encoded with the tokenizers library (each distinct chunk between white space once per worker),
an end id is appended, ids are serialized as little-endian integers (two bytes where every id fits) and each
document is compressed alone under a dictionary trained on a bounded sample of serialized documents.  Documents
are sorted into ranges of doc_id; a range is one task and one file, or more if its documents are large:

    magic, header length, header (JSON: dictionary sha256, id width, documents, index offset),
    compressed documents, index (doc_id int64, offset uint64, ids uint64; the offsets have one more at the end)

so any document is read with one seek.  Shards are written under temporary names and renamed, hence a task
that runs again leaves the same file.

Defined results: null and empty texts give the end id alone; null doc_ids come first; equal doc_ids keep the
order of their ids' length and checksum; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import split_chunks
from .common import discard, held, materialize, prepare, scratch_path, text_batches, text_buffer

MAGIC = b"STRATAID"
#: Bounds of the sample that trains the dictionary, and its size.
SAMPLE_DOCS, SAMPLE_PART, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 16 << 10, 6 << 20, 64 << 10
#: Serialized bytes of a shard, about; zstandard level.
SHARD_BYTES, LEVEL = 32 << 20, 3
KEEP = 600_000


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _serialize(kind: str, ids: list[int]) -> bytes:
    out = array(kind, ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Kept(dict):
    """chunk -> serialized ids; what two generations didn't ask for goes.  A chunk not here is None until it is set, and noted as unseen."""

    def __init__(self):
        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.unseen: list[bytes] = []

    def __missing__(self, chunk: bytes) -> bytes | None:
        value = self.older.get(chunk)
        if value is None:
            self.unseen.append(chunk)
        self[chunk] = value
        return value

    def turn(self, most: int) -> None:
        if len(self) > most:
            self.older = dict(self)
            self.clear()


class LibraryEncoder:
    """Chunk by chunk through the tokenizers library; ids as serialized bytes.  Chunks that two generations didn't hold go.

    Unseen chunks of letters alone are words, one each, so many go in one call and part again after the ids that
    end a word; where the library sees another number of words, and for all other chunks, each is a call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for x, i in self.tokenizer.get_vocab().items() if suffix and x.endswith(suffix)]] = True
        self.kept = _Kept()

    def _each(self, chunks: list[bytes]) -> None:
        kind = "H" if self.width == 2 else "I"
        for k in range(0, len(chunks), 20_000):
            part = chunks[k : k + 20_000]
            found = self.tokenizer.encode_batch_fast([c.decode("utf-8") for c in part], add_special_tokens=False)
            self.kept.update((c, _serialize(kind, e.ids)) for c, e in zip(part, found, strict=True))

    def _together(self, chunks: list[bytes], many: int = 64) -> None:
        """Chunks of letters."""
        parts = [chunks[k : k + many] for k in range(0, len(chunks), many)]
        for k in range(0, len(parts), 512):
            some = parts[k : k + 512]
            for part, e in zip(some, self.tokenizer.encode_batch_fast([b" ".join(p).decode("utf-8") for p in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, f"<u{self.width}")
                stops = (np.flatnonzero(self.ends[ids]) + 1) * self.width
                if len(stops) == len(part) and stops[-1] == len(ids) * self.width:
                    raw, stops = ids.tobytes(), stops.tolist()
                    self.kept.update((c, raw[a:b]) for c, a, b in zip(part, [0, *stops], stops, strict=False))
                else:
                    self._each(part)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        chunks = [split_chunks(t) for t in texts]
        kept = self.kept
        kept.turn(KEEP)
        found = [list(map(kept.__getitem__, cs)) for cs in chunks]
        words, others = [], []
        for c in kept.unseen:
            (words if c.isalpha() or c.decode("utf-8").isalpha() else others).append(c)
        self._together(words)
        self._each(others)
        for cs, vs in zip(chunks, found, strict=True):
            at = -1
            for _ in range(vs.count(None)):
                at = vs.index(None, at + 1)
                vs[at] = kept[cs[at]]
        for c in kept.unseen:
            if len(c) > 64:
                del kept[c]
        kept.unseen = []
        return list(map(b"".join, found))


def library_encoder(path: str) -> LibraryEncoder:
    return held(("ids", path), lambda: LibraryEncoder(path))


def _serialized(batches: Iterator[pa.RecordBatch], path: str, end_id: int):
    enc = library_encoder(path)
    end = int(end_id).to_bytes(enc.width, "little")
    for batch in text_batches(batches):
        data, offsets = text_buffer(batch.column("text"))
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield batch.column("doc_id"), [x + end for x in enc.encode(texts)], enc.width


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary from a sample that is the same in every run: SAMPLE_DOCS documents by hash, SAMPLE_PART bytes of each at most."""
    import zstandard

    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    chance = F.xxhash64("doc_id", "text", F.lit("dictionary"))

    def run(batches):
        for batch in batches:
            for _, blobs, _ in _serialized([batch], path, end_id):
                yield pa.RecordBatch.from_arrays([pa.array([b[:SAMPLE_PART] for b in blobs], pa.binary())], ["ids"])

    chosen = docs.where(F.pmod(chance, F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("doc_id", "text")
    rows = chosen.mapInArrow(run, "ids binary").withColumn("at", F.xxhash64("ids")).limit(2 * SAMPLE_DOCS).collect()
    samples, size = [], 0
    for r in sorted(rows, key=lambda r: (r.at, r.ids)):
        if size < SAMPLE_BYTES:
            samples.append(bytes(r.ids))
            size += len(r.ids)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: plain bytes serve as a dictionary as well
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, path: str, end_id: int, folder: str) -> list[dict]:
    """Write shards of docs(doc_id, text) into folder; returns the manifest, one entry per shard in doc_id order."""
    spark = docs.sparkSession
    prepare(spark)
    dictionary = train_dictionary(docs, path, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/dictionary-{digest}.zdict") as f:
        f.write(dictionary)

    def compress(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_checksum=False)
        for ids, blobs, width in _serialized(batches, path, end_id):
            counts = pa.array([len(b) // width for b in blobs], pa.int64())
            sums = pa.array([zlib.crc32(b) for b in blobs], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, counts, sums, pa.array([packer.compress(b) for b in blobs], pa.binary())], ["doc_id", "n", "crc", "blob"])

    packed = docs.select("doc_id", "text").mapInArrow(compress, "doc_id long, n long, crc long, blob binary")
    packed = materialize(packed.withColumn("row", F.monotonically_increasing_id()), "ids-packed")  # the ranges' bounds come from a second look
    size = packed.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()[0]
    order = [F.col("doc_id").asc_nulls_first(), "n", "crc", "row"]  # one doc_id of very many rows is split as well
    ordered = packed.repartitionByRange(size // SHARD_BYTES + 1, *order).sortWithinPartitions(*order)

    def store(batches):
        from pyspark import TaskContext

        out = _Writer(folder, digest, library_encoder(path).width, TaskContext.get().partitionId())
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "blob")), strict=True):
                out.add(*row)
                if out.size > 2 * SHARD_BYTES:
                    yield out.close()
        if out.file is not None:
            yield out.close()

    manifest = ordered.mapInArrow(store, "part int, number int, path string, n_docs long, n_ids long, n_bytes long").collect()  # one row a file
    discard(packed)
    return [r.asDict() for r in sorted(manifest, key=lambda r: (r.part, r.number))]


class _Writer:
    """Writes the shards of one range of documents, one after the other."""

    def __init__(self, folder: str, digest: str, width: int, part: int):
        self.folder, self.digest, self.width, self.part = folder, digest, width, part
        self.number, self.size, self.file = 0, 0, None
        self.fs, self.at = filesystem(folder)

    def add(self, doc_id: int | None, n: int, blob: bytes) -> None:
        if self.file is None:
            self.temporary = f"{self.at}/.{self.part}-{uuid.uuid4().hex}"
            self.file = self.fs.open_output_stream(self.temporary)
            header = json.dumps({"dictionary": self.digest, "width": self.width}).encode()
            self.file.write(MAGIC + len(header).to_bytes(4, "little") + header)
            self.ids, self.counts, self.offsets, self.size = [], [], [], len(MAGIC) + 4 + len(header)
        self.ids.append(-(1 << 63) if doc_id is None else doc_id)
        self.counts.append(n)
        self.offsets.append(self.size)
        self.file.write(blob)
        self.size += len(blob)

    def close(self) -> pa.RecordBatch:
        index = np.array(self.ids, "<i8").tobytes() + np.array([*self.offsets, self.size], "<u8").tobytes() + np.array(self.counts, "<u8").tobytes()
        self.file.write(index + len(self.ids).to_bytes(8, "little") + MAGIC)
        self.file.close()
        name = f"ids-{self.part:07d}-{self.number:04d}.bin"
        self.fs.move(self.temporary, f"{self.at}/{name}")
        row = [self.part, self.number, f"{self.folder}/{name}", len(self.ids), sum(self.counts), self.size + len(index) + 16]
        self.file, self.number, self.size = None, self.number + 1, 0
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "number", "path", "n_docs", "n_ids", "n_bytes"])


class Shard:
    """Random access to one shard file."""

    def __init__(self, uri: str):
        import zstandard

        fs, at = filesystem(uri)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        head = self.file.read_at(12, 0)
        if tail[8:] != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"{uri}: not a shard of ids")
        n = int.from_bytes(tail[:8], "little")
        header = json.loads(self.file.read_at(int.from_bytes(head[8:], "little"), 12))
        index = self.file.read_at(8 * (3 * n + 1), size - 16 - 8 * (3 * n + 1))
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 8 * n).astype(np.int64)
        self.counts = np.frombuffer(index, "<u8", n, 8 * (2 * n + 1)).astype(np.int64)
        self.width = header["width"]
        folder = at.rsplit("/", 1)[0]
        with fs.open_input_stream(f"{folder}/dictionary-{header['dictionary']}.zdict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != header["dictionary"]:
            raise ValueError(f"{uri}: another dictionary")
        self._unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def at(self, k: int) -> np.ndarray:
        """ids of the k-th document."""
        blob = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        return np.frombuffer(self._unpack.decompress(blob, max_output_size=int(self.counts[k]) * self.width), f"<u{self.width}")

    def get(self, doc_id: int) -> np.ndarray | None:
        """ids of a document by its doc_id, None if it isn't here."""
        k = int(np.searchsorted(self.doc_ids, doc_id))
        return self.at(k) if k < len(self) and self.doc_ids[k] == doc_id else None


def read(spark, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a manifest, one task per shard."""
    rows, base = [], 0
    for m in manifest:
        rows.append((m["path"], base))
        base += m["n_ids"]
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    shards = spark.createDataFrame(rows, "path string, base long").repartition(len(rows))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(path)
                starts = base + np.cumsum(shard.counts) - shard.counts
                for a in range(0, len(shard), 4096):
                    b = min(a + 4096, len(shard))
                    sums = [zlib.crc32(shard.at(k).astype("<u4").tobytes()) for k in range(a, b)]
                    ids = shard.doc_ids[a:b]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == -(1 << 63)), pa.array(starts[a:b], pa.int64()), pa.array(shard.counts[a:b], pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write docs as files in the shared folder, and what reading them back gives for each document."""
    spark = docs.sparkSession
    manifest = write(docs, path, end_id, scratch_path(spark, "ids"))
    return read(spark, manifest)
