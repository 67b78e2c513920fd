"""The operators against brute force, round trips and held-out labels on small fixtures with hard cases."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"

HARD = [
    (1, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "de", "b", 0),
    (5, " \t\n\x0b\x0c\r ", None, "b", 7),
    (6, "un deux trois\x1cquatre cinq   six", "fr", None, 1),
    (7, "12345 67890 !!! ???", "es", "c", 1),
    (None, "no id but some words of text that go on and on and on for a while", "en", "c", 1),
    (8, "x" * 5000 + " " + "lorem ipsum dolor sit amet " * 400, "en", "a", 1),
    (9, "<|endoftext|> It's NAÏVE <|startoftext|>don't", "en", "b", 1),
]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names the operators use themselves."""
    extra = ["id", "anchor", "key", "windows", "score", "size", "taken", "rid", "spans", "fp", "held_out"]
    return spark.createDataFrame(HARD, DOC).select("*", *[F.lit("clash").alias(c) for c in extra])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def words(text):
    return (text or "").encode().split()


# --- 1 ----------------------------------------------------------------------------------------------------------


def test_mixing_budgets(hard, empty):
    from stratakv.llm.mixing import mix

    rows = mix(hard).collect()
    assert len(rows) == len(HARD) and mix(empty).count() == 0
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.size == len(words(dict((d, t) for d, t, *_ in HARD)[r.doc_id]))
        by.setdefault(r.source, []).append(r)
    for part in by.values():
        size = sum(r.size for r in part)
        assert {r.source_size for r in part} == {size} and part[0].target <= 3 * size + 1e-9
        assert sum(r.taken for r in part) == int(part[0].target)
    assert abs(sum(p[0].target for p in by.values()) - total) < 1e-6
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix(hard).collect()), key=str)


def test_mixing_targets_reshare(spark):
    from stratakv.llm.mixing import targets

    rows = [("a", 10), ("b", 1000), ("c", 1), ("d", 500), (None, 100)]
    got = {r.source: r.target for r in targets(spark.createDataFrame(rows, "source string, total long")).collect()}
    want, weight, open_ = {}, dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True)), dict(rows)
    left = float(sum(open_.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        capped = [s for s in open_ if level * weight[s] > 3 * open_[s]]
        if not capped:
            break
        for s in capped:
            want[s] = 3.0 * open_.pop(s)
            left -= want[s]
    want |= {s: level * weight[s] for s in open_}
    assert got == pytest.approx(want)


# --- 2, 9 -------------------------------------------------------------------------------------------------------


def vectors(spark, n=900, dim=32):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, dim))
    for k in range(60):  # copies at many angles
        for j in range(4):
            x[300 + 4 * k + j] = x[k] + rng.standard_normal(dim) * 0.12 * j
    rows = [(i, v.astype(np.float32).tolist(), int(i % 3 == 0)) for i, v in enumerate(x)]
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(30)]  # equal vectors
    rows += [(3000, None, 1), (3001, [0.0] * dim, 1), (3002, [float("nan")] + [1.0] * (dim - 1), 1), (3003, [None] + [1.0] * (dim - 1), 0), (3004, [float("inf")] * dim, 0), (3005, [1.0, 2.0], 1), (3006, rows[7][1], None), (3020, rows[8][1], 1)]
    return rows


VEC = "vec_id long, embedding array<float>, label int"


def able(v, dim=32):
    return v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_nearest_neighbours(spark):
    from stratakv.llm.additive import search

    rows = vectors(spark)
    df = spark.createDataFrame(rows, VEC).withColumn("score", F.lit("clash"))
    got = {}
    for r in search(df, df.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if able(v)]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    hit = total = 0
    asked = [(i, v) for i, v in good if i % 20 == 0]
    assert set(got) == {i for i, _ in asked} and 3000 not in got
    for i, v in asked:
        s = x @ v
        s[ids == i] = -np.inf
        best = ids[np.lexsort((ids, -s))[:10]]
        mine = [g[1] for g in got[i]]
        assert [g[0] for g in got[i]] == list(range(1, 11)) and i not in mine
        assert [g[2] for g in got[i]] == pytest.approx([float(s[ids == m][0]) for m in mine], rel=1e-9)
        assert sorted(got[i], key=lambda g: (-g[2], g[1])) == got[i]
        hit, total = hit + len(set(best) & set(mine)), total + 10
    assert hit / total >= 0.9
    none = spark.createDataFrame([], VEC)
    assert search(none, none).count() == 0
    again = df.union(df.where("vec_id = 40"))  # a query row that repeats is answered once
    assert [r.vec_id for r in search(again, again.where("vec_id = 40"), k=10).orderBy("rank").collect()] == [g[1] for g in got[40]]
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], 0)], VEC)
    assert [(r.vec_id, r.rank) for r in search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def components_of(ids, pairs):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("side", [2048, 16])
def test_embedding_near_duplicates(spark, monkeypatch, side):
    from stratakv.llm import multiindex

    monkeypatch.setattr(multiindex, "SIDE", side)
    rows = vectors(spark)
    got = {r.vec_id: r for r in multiindex.near_duplicates(spark.createDataFrame(rows, VEC).withColumn("node", F.lit(1))).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if able(v) and lab is not None]
    u = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    same = np.array([lab for *_, lab in good])
    near = (u @ u.T >= 0.93) & (same[:, None] == same[None, :])
    np.fill_diagonal(near, False)
    pairs = [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(near), strict=True)]
    want = Counter(a for a, _ in pairs)
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= want[i] for i in got) and found >= 0.9 * len(pairs)
    exact = components_of([r[0] for r in rows], pairs)
    assert sum(got[i].component_id == exact[i] for i in got) >= 0.95 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert multiindex.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


# --- 3 ----------------------------------------------------------------------------------------------------------


def fingerprint(text, size=4):
    import xxhash

    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def test_simhash(spark, hard, empty, documents):
    from stratakv.llm.simhash import near_duplicates

    for df in (hard, documents):
        rows = [(d, fingerprint(t)) for d, t in texts(df)]
        prints = sorted({p for _, p in rows})
        group = components_of(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4])
        least = {}
        for d, p in rows:
            if d is not None:
                least[group[p]] = min(least.get(group[p], d), d)
        want = sorted(((d, f"{p:016x}", least.get(group[p])) for d, p in rows), key=str)
        assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == want
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("large", [4096, 8])
def test_trie_join_finds_all_links(spark, large):
    from stratakv.llm.components import components
    from stratakv.llm.simhash import links

    rng = random.Random(large)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(15):
            x = base
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = components_of(signed, [(a, b) for a in signed for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    found = components(links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, large)).collect()
    got = {r.node: r.component for r in found}
    assert {p: got.get(p, p) for p in signed} == want


def test_components_of_a_long_chain(spark):
    from stratakv.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (501, 500)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# --- 4, 5 -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def test_bpe_matches_the_library(hard, empty, documents, library):
    from stratakv.llm import bpe

    for df in (hard, documents):
        want = []
        for d, t in texts(df):
            ids = library.encode(t or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert sorted(map(tuple, bpe.digests(df, WORD_BPE).collect()), key=str) == sorted(want, key=str)
    assert bpe.digests(empty, WORD_BPE).count() == 0
    tokens = bpe.encode(hard.where("doc_id = 9"), WORD_BPE)
    assert tokens.first().ids == library.encode(HARD[-1][1], add_special_tokens=False).ids
    assert bpe.decode(tokens, WORD_BPE).first().text == library.decode(tokens.first().ids, skip_special_tokens=False)


def test_bpe_on_odd_strings(library):
    from stratakv.llm.bpe import Encoder

    enc, rng = Encoder(WORD_BPE), random.Random(4)
    alphabet = "abAB ''sSt<|>endoftext \x1c\x85 ​́éÉΣς12٣ßİı\U0001f600\x00\t\nﬁ-_.,,..!"
    for k in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        if k % 3 == 0:
            text = text[:8] + "<|endoftext|>" + text[8:]
        assert enc.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_id_files_round_trip(hard, empty, documents, library, monkeypatch):
    from stratakv.llm import idstore

    monkeypatch.setattr(idstore, "SHARD_BYTES", 1 << 16)
    for df in (hard, documents):
        rows = []
        for d, t in texts(df):
            ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            rows.append((d is not None, d or 0, len(ids), zlib.crc32(ids.tobytes())))
        want, start = [], 0
        for some, d, n, crc in sorted(rows):
            want.append((d if some else None, start, n, crc))
            start += n
        got = idstore.round_trip(df, WORD_BPE).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert idstore.round_trip(empty, WORD_BPE).count() == 0


def test_id_files_random_access(spark, documents, library, tmp_path):
    from stratakv.llm import idstore

    manifest = idstore.write(documents, WORD_BPE, 2, f"file://{tmp_path}/ids")
    shard = idstore.Shard(manifest[0]["path"])
    rows = dict(texts(documents))
    for d in shard.doc_ids[::37].tolist():
        assert shard.get(d).tolist() == library.encode(rows[d], add_special_tokens=False).ids + [2]
    assert shard.get(10**12) is None
    assert sum(os.path.getsize(tmp_path / "ids" / f) for f in os.listdir(tmp_path / "ids")) < 2 * sum(m["n_ids"] for m in manifest)


# --- 6, 10 ------------------------------------------------------------------------------------------------------


def test_toxicity(spark, hard, empty):
    from stratakv.llm.toxicity import score, train

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = train(docs, labels.where(~fold))
    held = score(docs, model).join(labels.where(fold), "doc_id").collect()
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    above = sum((np.array(clean) < s).mean() for s in toxic) / len(toxic)
    assert above > 0.7 and all(0 <= s <= 1 for s in toxic + clean)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.01 * len(clean)
    assert sum(r.predicted for r in held if r.toxic) >= 0.7 * len(toxic)
    assert score(hard, model).count() == len(HARD) and score(empty, model).count() == 0
    nothing = train(docs, labels.limit(0))
    assert {r.score for r in score(hard, nothing).collect()} == {0.0}


def test_toxicity_judges_expressions_of_several_words():
    from stratakv.llm import toxicity as T

    def model_of(texts):
        return T.tokens(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))

    rng = random.Random(1)
    ordinary = [" ".join(rng.choice("abcdefgh") for _ in range(30)).encode() for _ in range(40)]
    toxic = [t + b" x y z" for t in ordinary]
    sides = [model_of(toxic), model_of(ordinary)]
    vocabulary = np.unique(sides[0][0])
    model = T.Model(vocabulary, [T.Counts(vocabulary, *s[:3]) for s in sides], np.ones(len(vocabulary) + 1), 1.6)
    text = b"a b x c d y z e f"
    gains = []
    for k in range(1, 10):  # a word's own evidence: what it adds to the sum over the text so far
        part = b" ".join(text.split()[:k])
        n = T.EXPRESSION
        T.EXPRESSION = 1 << 20
        try:
            gains.append(model.evidence(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0] * k)
        finally:
            T.EXPRESSION = n
    steps = np.diff([0, *gains])
    got = model.evidence(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    assert np.isclose(got, max(steps[k : k + 3].mean() for k in range(7))) and got < steps.max()


def test_kneser_ney_against_plain_python():
    from stratakv.llm import toxicity as T

    rng = random.Random(9)
    sides = [[[rng.choice("abcde") for _ in range(rng.randrange(1, 25))] for _ in range(30)] for _ in range(2)]
    sides[0][0] += ["x", "y"] * 5
    vocabulary_words = sorted({w for side in sides for t in side for w in t})
    shared_of = {w: rng.randrange(9) for w in vocabulary_words}

    def packed(texts):
        raw = [" ".join(t).encode() for t in texts]
        return T.tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))

    own = {w: int(packed([[w]])[0][0]) for w in vocabulary_words}
    vocabulary = np.array(sorted(own.values()), np.uint64)
    shared = np.zeros(len(vocabulary) + 1)
    for w, n in shared_of.items():
        shared[np.searchsorted(vocabulary, np.uint64(own[w]))] = n
    d1, d2 = 0.75, 1.5
    model = T.Model(vocabulary, [T.Counts(vocabulary, *packed(side)[:3]) for side in sides], shared, d1)

    pairs = []  # of each class: (v, w) -> different words before v
    for side in sides:
        seen = {}
        for t in side:
            for k, w in enumerate(t):
                v, u = (t[k - 1] if k else None), (t[k - 2] if k > 1 else None)
                seen.setdefault((v, w), set()).add(u)
        pairs.append({p: len(x) for p, x in seen.items()})
    joint = Counter()
    for x in pairs:
        joint.update(x)
    kept = {p: n - d2 for p, n in joint.items() if n > d2}

    def probability(c, v, w):
        words_ = Counter(b for _, b in pairs[c])  # different words before each
        total = sum(words_.values())
        off = sum(min(n, d1) for n in words_.values())
        one = max(words_[w] - d1, 0) / total + off / total * (shared_of[w] + 1) / (sum(shared_of.values()) + len(vocabulary) + 1)
        after = sum(n for (a, _), n in joint.items() if a == v)
        mass = sum(n for (a, _), n in kept.items() if a == v)
        rest = 1 - mass / after if after else 1.0
        if (v, w) not in kept:
            return rest * one
        common = kept[v, w] / mass
        mine = {p: max(pairs[c].get(p, 0) - d2, 0) for p in kept if p[0] == v}
        whole = sum(mine.values())
        share = (1 - T.JOINT) * mine[v, w] / whole + T.JOINT * common if whole else common
        return (1 - rest) * share + rest * one

    text = ["a", "x", "y", "b", "c", "x", "y"]
    gains = [np.log(probability(0, v, w) / probability(1, v, w)) for v, w in zip([None, *text], text)]
    want = max(np.mean(gains[k : k + T.EXPRESSION]) for k in range(len(text) - T.EXPRESSION + 1))
    raw = " ".join(text).encode()
    assert np.isclose(model.evidence(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], want)


def test_shared_counts_are_of_distinct_pairs_of_the_whole_corpus(spark):
    from stratakv.llm import toxicity as T

    some = ["a b c", "A b", "b b b c", "c, a", None, "", "unseen b"]
    docs = spark.createDataFrame([(t,) for t in some * 3], "text string")
    before = {}
    for t in some:
        ws = (t or "").lower().replace(",", " ").split()
        for v, w in zip([None, *ws], ws):
            before.setdefault(w, set()).add(v)
    vocabulary = np.unique(T.tokens(np.frombuffer(b"a b c", np.uint8), np.array([0, 5]))[0])
    place = {w: int(T.numbers(vocabulary, T.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, 1]))[0])[0]) for w in "abc"}
    for slices in (1, 7):
        counts, mass = T.shared_counts(docs.repartition(slices), vocabulary)
        assert {w: counts[place[w]] for w in "abc"} == {w: len(before[w]) for w in "abc"} and counts[-1] == 0
        assert mass == sum(map(len, before.values())) + len(before) + 1


def test_language(spark, hard, empty, documents):
    from stratakv.llm import langid

    path = public_tokenizers.path("piece_bpe_32k.model")
    fold = langid.held_out(4, 2)
    model = langid.train(documents.where(~fold), path)
    told = langid.predict(documents.where(fold), model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in told]) > 0.95
    got = {r.doc_id: r for r in langid.predict(hard, model).collect()}
    assert [got[d].lang_pred for d in (3, 4, 5, 7)] == ["und"] * 4 and got[3].score == 0
    assert langid.predict(empty, model).count() == 0
    none = langid.train(empty, path)
    assert {r.lang_pred for r in langid.predict(hard, none).collect()} == {"und"}


def test_languages_without_spaces_are_learned(spark):
    from stratakv.llm import langid

    clause = "今天天气很好我们一起去公园散步吧然后回家吃饭看书睡觉"
    docs = spark.createDataFrame([(k, clause[k % 5 :] * 3, "zh") for k in range(8)] + [(9 + k, "the fox ran over the hill", "en") for k in range(8)], "doc_id long, text string, lang string")
    words = {lang: b"".join(w for name, w, _ in langid.training_words(docs) if name == lang) for lang in ("zh", "en")}
    assert words["zh"].decode() and all(len(w) <= 64 and w.decode() for _, w, _ in langid.training_words(docs))
    assert b"".join(langid.cut((clause * 9).encode())).decode() == clause * 9
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert model.languages == ["en", "zh"]
    assert {r.lang_pred for r in langid.predict(docs.where("lang = 'zh'"), model).collect()} == {"zh"}


def test_segmentations_are_summed():
    from stratakv.llm.langid import Lattice

    vocabulary = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc", b"aa", b"aaa"]
    p = np.random.default_rng(0).random((len(vocabulary), 2))
    place = {v: i for i, v in enumerate(vocabulary)}

    def brute(w):
        total = 1 if not w else 0
        for k in range(1, min(3, len(w)) + 1):
            if w[:k] in place:
                total = total + p[place[w[:k]]] * brute(w[k:])
        return total

    some = [b"abc", b"aaaa", b"", b"xabcabc", b"aaabcaaabc"]
    assert np.allclose(Lattice(vocabulary).forward(some, p), np.log([np.ones(2) * brute(w) for w in some]))
    # a long word of one letter: both languages keep their own scale, however far apart they are
    q = np.full((len(vocabulary), 2), 1e-7)
    q[97] = (0.9, 1e-6)
    for n in (31, 32, 33, 4000):
        assert np.allclose(Lattice([bytes([b]) for b in range(256)]).forward([b"a" * n], q[:256]), n * np.log(q[97]))


def test_long_words_have_scores(spark, documents):
    from stratakv.llm import langid

    model = langid.train(documents, public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(1, "the" * 600 + " " + "ich" * 600), (2, "und" * 5000 + " " + "que" * 3000 + " " + "les" * 900), (3, "x" * 20_000)]
    told = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(told) == 3 and all(0 <= r.score <= 1 and r.lang_pred in model.languages for r in told)


# --- 7, 8 -------------------------------------------------------------------------------------------------------


def brute_phrases(rows, size):
    first, out = {}, []
    inf = (1 << 63) - 1
    for d, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, inf), inf if d is None else d)
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (inf if d is None else d):
                gone[k : k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_phrases(spark, hard, empty, documents):
    from stratakv.llm.phrases import dedup

    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    for df in (hard, documents):
        assert sorted(map(tuple, dedup(df).select(*cols).collect()), key=str) == brute_phrases(texts(df), 13)
    assert dedup(empty).count() == 0
    whole = dedup(hard, keep_text=True)
    assert set(whole.columns) == {*hard.columns, "n_words", "n_removed", "kept"} - {"text"} and whole.where("windows <> 'clash'").count() == 0
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["a", "b", "cc"]) for _ in range(rng.randrange(40)))) for i in range(80)] + [(200 + i, "a " * 30) for i in range(5)]
    rows += [(None, "b a cc b a a cc b") for _ in range(4)] + [(7, "a b a cc cc b"), (7, "a b a cc cc b")]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, block in ((1000, 1 << 18), (1000, 200), (3, 200), (0, 1 << 18)):
        assert sorted(map(tuple, dedup(small, 4, 2, hot=hot, block=block).select(*cols).collect()), key=str) == brute_phrases(rows, 4)


def test_phrases_compare_words_and_not_sums(spark):
    from stratakv.llm.phrases import dedup

    a = "a"
    for _ in range(10):  # sums of byte values times powers of an odd base modulo 2**64 are equal for these two
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    tail = " one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, a + tail), (2, b + tail), (3, a + tail)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup(docs).collect()} == {1: 0, 2: 0, 3: 13}


def test_item_hashes_tell_items_apart():
    from stratakv.llm.hashing import item_hash

    rng = random.Random(3)
    items = list({bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 90))) for _ in range(3000)} | {b"\0" * k for k in range(1, 80)})
    data = np.frombuffer(b"".join(items), np.uint8)
    stop = np.cumsum([len(x) for x in items])
    start = stop - [len(x) for x in items]
    assert len(np.unique(item_hash(data, start, stop))) == len(items)
    again = item_hash(data[start[7] :], start[7:] - start[7], stop[7:] - start[7])
    assert (again == item_hash(data, start, stop)[7:]).all() and (again != item_hash(data, start, stop, 1)[7:]).all()


def brute_bytes(rows, size):
    seen, out = Counter(), []
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k : k + size] for k in range(len(b) - size + 1))
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = True
        starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        out.append((d, len(b), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_byte_strings(spark, hard, empty, documents):
    from stratakv.llm.bwt import dedup

    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for df in (hard, documents):
        assert sorted(map(tuple, dedup(df).select(*cols).collect()), key=str) == brute_bytes(texts(df), 200)
    assert dedup(empty).count() == 0
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(80)))) for i in range(50)] + [(100 + i, "a" * 60) for i in range(3)]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1 << 20, 100, 0):
        assert sorted(map(tuple, dedup(small, 10, 4, block=300, hot=hot).select(*cols).collect()), key=str) == brute_bytes(rows, 10)


def test_transform_intervals():
    from stratakv.llm.bwt import recurring_starts

    rng = random.Random(1)
    for _ in range(100):
        contexts = list(dict.fromkeys(bytes(rng.choice(b"ab\0") for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 6))))
        counts = [rng.choice([1, 1, 2]) for _ in contexts]
        seen = Counter()
        for c, n in zip(contexts, counts, strict=True):
            for k in range(len(c) - 4):
                seen[c[k : k + 5]] += n
        want = [[k for k in range(len(c) - 4) if seen[c[k : k + 5]] > 1] for c in contexts]
        assert [x.tolist() for x in recurring_starts(contexts, counts, 5)] == want


# --- pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, library):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before, after = [tuple(r) for r in kept.collect()], stage(spark, kept, SF)
        if k < 4:
            assert after.columns == docs.columns
            kept = after.persist()
            now = [tuple(r) for r in kept.collect()]
        if name == "language":
            assert now and set(now) <= set(before)
        elif name == "simhash":
            prints = {d[0]: fingerprint(d[1]) for d in before}
            group = components_of(list(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
            assert sorted(now) == sorted(d for d in before if group[d[0]] == d[0])
        elif name == "phrases":
            want = {d: (n, gone, sha) for d, n, gone, sha in brute_phrases([(d[0], d[1]) for d in before], 13)}
            text = {d[0]: d[1] for d in before}
            assert {d[0] for d in now} == {d for d, (n, gone, _) in want.items() if not gone or gone < n}
            for d in now:
                n, gone, sha = want[d[0]]
                assert d[1] == text[d[0]] if not gone else hashlib.sha256(d[1].encode()).hexdigest() == sha
                assert d[4] == len(d[1])
        elif name == "mixture":
            from stratakv.llm.mixing import mix

            plan = {r.doc_id: r for r in mix(spark.createDataFrame(before, docs.schema)).collect()}
            taken = Counter()
            for d in now:
                taken[d[0]] += len(words(d[1]))
            assert dict(taken) == {d: r.taken for d, r in plan.items() if r.taken}
        else:
            want = []
            for d in before:
                ids = library.encode(d[1], add_special_tokens=False).ids
                want.append((d[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
            assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in after.collect()) == sorted(want)
    assert pipeline.run(spark, SF).count() == len(before)


def test_pipeline_tells_rows_apart_without_doc_ids(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(4)
    text = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.randrange(10**6)}" for _ in range(n))
    rows = [(None, text(40 + k), "en", "abc"[k % 3], k) for k in range(12)] + [(5, text(60 + k), "en", "abc"[k % 3], k) for k in range(6)]
    twin = (5, text(300), "en", "a", 1)  # one of the repeated doc_id 5 is a near copy of document 2, of which only 2 stays
    rows += [twin, (2, twin[1] + " ", "en", "a", 2)]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    kept = [tuple(r) for r in pipeline.near_copies(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r is not twin], key=str)

    from stratakv.llm.mixing import mix

    mixed = [tuple(r) for r in pipeline.mixture(spark, docs, SF).collect()]
    plan = Counter()
    for r in mix(docs).collect():
        plan[r.source] += r.taken
    got = Counter()
    for r in mixed:
        got[r[3]] += len(words(r[1]))
        assert any(d[0] == r[0] and d[3] == r[3] and words(d[1])[: len(words(r[1]))] == words(r[1]) for d in rows)
    assert got == plan and len(mixed) < 3 * len(rows) + 3


def test_pipeline_stages_on_hard_and_empty_tables(spark, hard, empty):
    import corpus_pipeline as pipeline

    kept, none = hard, empty
    for k, (_, stage) in enumerate(pipeline.STAGES):
        none, kept = stage(spark, none, SF), stage(spark, kept, SF)
        if k < 4:
            assert none.columns == kept.columns == pipeline.COLUMNS  # columns with clashing names go in the first stage
            none, kept = none.persist(), kept.persist()
            assert kept.count() > 0
        assert none.count() == 0
    assert kept.count() > 0


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
