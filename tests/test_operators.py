"""Properties of the operators against plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratakv.functions.hashes import murmur3
from stratakv.functions.keys import prefix_end
from stratakv.operators import bloom, cache, lsm, mapping, packing, state, textscan
from stratakv.sources import traces


def test_last_write_wins(spark):
    rng = random.Random(3)
    log = [(i, f"k{rng.randrange(20)}", rng.choice(["SET", "GET", "DELETE"]), float(i), 1) for i in range(500)]
    want, reads = {}, {}
    for seq, key, op, val, _ in log:
        if op == "SET":
            want[key] = val
        elif op == "DELETE":
            want.pop(key, None)
        else:
            reads[seq] = want.get(key)
    df = spark.createDataFrame(log, "seq long, key string, op string, val double, vlen int")
    assert {r.key: r.val for r in state.visible(df).collect()} == want
    assert {r.seq: r.val for r in state.as_of_get(df, 16).collect()} == reads


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=6), st.text(max_size=4))
def test_prefix_end_is_above_all_extensions(prefix, more):
    end = prefix_end(prefix)
    assert end is None or prefix + more < end


def test_merge_and_compact_keep_the_visible_state(spark):
    rng = random.Random(5)
    rows = [(level, key, rng.randrange(10**6)) for level in range(3) for key in rng.sample(range(300), 150)]
    want = {}
    for level, key, ppa in sorted(rows, reverse=True):
        want[key] = ppa
    df = spark.createDataFrame(rows, "level int, key long, ppa long")
    from pyspark.sql import functions as F

    assert {r.key: r.ppa for r in lsm.compact(df, F.lit(False)).collect()} == want
    top, low = (df.where(f"level = {k}").select("key", "ppa") for k in (0, 1))
    once = lsm.merge(top, low)
    assert sorted(lsm.merge(once, low).collect()) == sorted(once.collect())
    assert lsm.shadowed(df).count() + lsm.compact(df, F.lit(False)).count() == len(rows)


def test_murmur_known_values():
    # fixed values: published test vectors
    assert murmur3([b""], 0)[0] == 0
    assert murmur3([b""], 1)[0] == 0x514E28B7
    assert murmur3([b"test"], 0)[0] == 0xBA6BD213
    assert murmur3([b"Hello, world!"], 0)[0] == 0xC0363E43


def test_bloom_has_no_false_negatives(spark):
    entries = spark.range(500).selectExpr("cast(id % 3 as int) as level", "concat('k', id) as key")
    filters = bloom.build(entries, 1 << 12, 5)
    found = {(r.key, r.level) for r in bloom.may_contain(filters, entries, 1 << 12, 5).collect()}
    assert {(r.key, r.level) for r in entries.collect()} <= found


def test_lru_matches_plain_simulation(spark):
    from collections import OrderedDict

    rng = random.Random(9)
    rows = [(rng.randrange(2), i, rng.randrange(9), rng.random() < 0.3) for i in range(600)]
    want = {}
    for c in (0, 1):
        pages, hits = OrderedDict(), 0
        for cache_, _, page, _ in rows:
            if cache_ == c:
                if page in pages:
                    hits += 1
                    pages.move_to_end(page)
                else:
                    if len(pages) == 4:
                        pages.popitem(last=False)
                    pages[page] = 1
        want[c] = hits
    got = cache.lru(spark.createDataFrame(rows, "cache long, seq long, page long, dirty boolean"), 4)
    assert {r.cache: r.hits for r in got.collect()} == want


def test_packing_places_every_value(spark):
    rows = [(0, i, 1 + i * 7 % 16) for i in range(100)]
    got = packing.pack(spark.createDataFrame(rows, "batch long, seq long, size long")).collect()
    assert sum(r.n for r in got) == 100 and sum(r.used for r in got) == sum(r[2] for r in rows)
    assert max(r.used for r in got) <= 16


@pytest.mark.parametrize("pattern", ["aa", "a.b", "(x", "é", "\\"])
def test_overlapping_substrings(spark, pattern):
    texts = ["aaaa", "a.ba.b", "((x(x", "ééé", "\\\\", "", None, "axb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [sum((t or "").startswith(pattern, i) for i in range(len(t or ""))) for t in texts]
    assert [r.n_0 for r in textscan.count(df, [pattern]).orderBy("doc_id").collect()] == want


def test_binary_stream_round_trip(spark, tmp_path):
    rows = [(1, 1, 0, "user0001", 100), (2, 2, 0, "user0002", 0), (3, 3, 50, "user0003", 0)]
    assert traces.decode_stream(traces.encode_stream(rows)) == rows
    (tmp_path / "s.bin").write_bytes(traces.encode_stream(rows))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [tuple(r) for r in traces.parse_binary(files).collect()] == rows


def test_search_in_a_folder_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("banana\nana")
    (tmp_path / "y.txt").write_text("an")
    df = textscan.read_tree(spark, str(tmp_path)).withColumnRenamed("file", "doc_id")
    assert sorted(r.n_0 for r in textscan.count(df, ["ana"]).collect()) == [0, 3]


def test_probe_insertion_places_every_key(spark):
    import hashlib

    n = 5000
    rows = [(i, f"user{(i * 37 % n):012d}") for i in range(2 * n)]
    got = mapping.insert_probing(spark.createDataFrame(rows, "seq long, key string")).collect()
    assert len({r.key for r in got}) == len(got) == n and len({(r.shard, r.slot) for r in got}) == n
    shards = {}
    for r in got:
        shards.setdefault(r.shard, {})[r.key] = r
    assert len(shards) == 10 and max(map(len, shards.values())) < 700
    first = {}
    for seq, key in rows:
        first.setdefault(key, seq)
    for held in shards.values():
        size = 2 * len(held) + 1
        while any(size % k == 0 for k in range(2, size)):
            size += 1
        taken = set()
        for key in sorted(held, key=first.get):
            h = 0
            digest = hashlib.sha256(key.encode()).hexdigest()
            for k in range(8):
                h ^= int(digest[8 * k : 8 * k + 8], 16)
            c = next(c for c in range(size) if ((h + c + c * c) & 0xFFFFFFFF) % size + 1 not in taken)
            slot = ((h + c + c * c) & 0xFFFFFFFF) % size + 1
            taken.add(slot)
            assert (held[key].slot, held[key].c) == (slot, c)


def test_live_keys_with_null_values_are_found(spark):
    live = spark.createDataFrame([("a", None), ("b", 1.0)], "key string, val double")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {r.key: r.status for r in state.get(live, asked).collect()} == {"a": "OK", "b": "OK", "c": "NOTFOUND"}
    log = spark.createDataFrame([(1, "a", "SET", None), (2, "a", "GET", None), (3, "a", "DELETE", None), (4, "a", "GET", None)], "seq long, key string, op string, val double")
    assert {r.seq: r.status for r in state.as_of_get(log).collect()} == {2: "OK", 4: "NOTFOUND"}


def test_patches_of_a_key_are_a_chain(spark):
    pages = spark.createDataFrame([("a", "0123456789"), ("b", "xy")], "key string, text string")
    patches = spark.createDataFrame([("a", "BB", 2, 2), ("a", "CCCC", 1, 1), ("a", "Z", 9, 3)], "key string, patch string, off int, seq int")
    assert {r.key: r.text for r in state.read_modify_write(pages, patches).collect()} == {"a": "0CBBC5678Z", "b": "xy"}


def test_caches_against_plain_lists(spark):
    from stratakv.operators import layers

    rng = random.Random(12)
    rows = [(c, i, min(rng.randrange(60), rng.randrange(60)), rng.random() < 0.3) for c in range(3) for i in range(700)]
    df = spark.createDataFrame(rows, "cache long, seq long, page long, dirty boolean").repartition(5)
    want, fine, split = {}, {}, {}
    for c in range(3):
        order, dirty, hits, evicted = [], set(), 0, [0, 0]
        held, fine_hits, pages_out = [], 0, 0
        lists, split_hits, written = ([], []), 0, 0
        for _, _, page, d in (r for r in rows if r[0] == c):
            if page in order:
                hits += 1
                order.remove(page)
            elif len(order) == 5:
                gone = order.pop(0)
                evicted[gone in dirty] += 1
                dirty.discard(gone)
            order.append(page)
            dirty |= {page} if d else set()

            if page in held:
                fine_hits += 1
                held.remove(page)
            elif len(held) >= 8:
                first = held[0] // 4
                held = [x for x in held if x // 4 != first]
                pages_out += 1
            held.append(page)

            at = 1 if page in lists[1] else 0 if page in lists[0] else None
            to = 1 if d or at == 1 else 0
            if at is not None:
                split_hits += 1
                lists[at].remove(page)
            if len(lists[to]) == (6, 3)[to]:
                lists[to].pop(0)
                written += to
            lists[to].append(page)
        want[c], fine[c], split[c] = (700, hits, evicted[1], evicted[0]), (700, fine_hits, pages_out), (700, split_hits, written)
    assert {r.cache: tuple(r)[1:] for r in cache.lru(df, 5).collect()} == want
    assert {r.cache: tuple(r)[1:] for r in layers.walk_caches(df, lambda: layers.fine_cache(8, 4), "evicted").collect()} == fine
    assert {r.cache: tuple(r)[1:] for r in layers.walk_caches(df, lambda: layers.split_cache(6, 3), "written").collect()} == split


def test_runs_by_bytes_and_by_count(spark):
    rng = random.Random(2)
    rows = [(s, k, rng.randrange(1, 60)) for s in range(3) for k in range(200)]
    got = {(r.shard, r.run): (r.n, r.bytes) for r in lsm.flush_by_bytes(spark.createDataFrame(rows, "shard long, key long, size long"), 200, 8).collect()}
    want = {}
    for s in range(3):
        run, n, held = 0, 0, 0
        for _, _, size in (r for r in rows if r[0] == s):
            if n and (n == 8 or held + size + 4 > 200):
                run, n, held = run + 1, 0, 0
            n, held = n + 1, held + size + 4
            want[s, run] = (n, held)
    assert got == want


def test_probing_places_and_finds_every_key(spark):
    from stratakv.functions.keys import probe_slot
    from stratakv.operators import layers
    from pyspark.sql import functions as F

    keys = spark.createDataFrame([(i, f"k{i * 7 % 500}") for i in range(900)], "seq long, key string")
    placed = mapping.insert_probing(keys, per_shard=60, with_slots=True).persist()
    rows = placed.collect()
    assert len({r.key for r in rows}) == len(rows) == 500 and len({(r.shard, r.slot) for r in rows}) == 500
    import hashlib

    first = {}
    for i in range(900):
        first.setdefault(f"k{i * 7 % 500}", i)
    taken = {}
    for r in sorted(rows, key=lambda r: first[r.key]):  # plain insertion in order of arrival
        h = 0
        for k in range(8):
            h ^= int(hashlib.sha256(r.key.encode()).hexdigest()[8 * k : 8 * k + 8], 16)
        for c in range(r.slots):
            slot = ((h + c + c * c) & 0xFFFFFFFF) % (r.slots - 1) + 1
            if taken.setdefault((r.shard, slot), r.key) == r.key:
                break
        assert (r.slot, r.c) == (slot, c)
    tried = placed.select("key", "shard", "slots", F.explode(F.sequence(F.lit(0), F.lit(max(r.c for r in rows)))).alias("c"))
    from stratakv.functions.keys import fold_words

    tried = tried.withColumn("slot", ((fold_words("key") + F.col("c") + F.col("c") * F.col("c")).bitwiseAND(0xFFFFFFFF) % (F.col("slots") - 1) + 1).cast("long"))
    found = {r.key: r for r in layers.probe_lookup(placed, tried).collect()}
    assert all((found[r.key].c, found[r.key].slot, found[r.key].wrong) == (r.c, r.slot, r.c) for r in rows)


def test_pages_are_packed_largest_first(spark):
    rng = random.Random(7)
    rows = [(b, i, rng.randrange(1, 17)) for b in range(3) for i in range(60)]
    got = {(r.batch, r.page): (r.used, r.n) for r in packing.pack(spark.createDataFrame(rows, "batch long, seq long, size long")).collect()}
    want = {}
    for b in range(3):
        left, page = sorted((r[2] for r in rows if r[0] == b), reverse=True), 0
        while left:
            used, n, rest = 0, 0, []
            for size in left:
                if used + size <= 16:
                    used, n = used + size, n + 1
                else:
                    rest.append(size)
            want[b, page], left, page = (used, n), rest, page + 1
    assert got == want


@pytest.mark.parametrize(("runs", "levels"), [(100, 1), (1000, 2), (12345, 4)])
def test_size_factor_is_the_least_that_holds_all_runs(runs, levels):
    f = lsm.size_factor(runs, levels)
    assert sum(f**k for k in range(1, levels + 1)) >= runs > sum((f - 0.03) ** k for k in range(1, levels + 1))


def test_merge_gives_the_merged_list_and_the_invalidated_pages(spark):
    rng = random.Random(11)
    upper, lower = ({k: rng.randrange(10**6) for k in rng.sample(range(6000), 400)} for _ in range(2))
    entries = spark.createDataFrame([(0, k, p) for k, p in upper.items()] + [(1, k, p) for k, p in lower.items()], "level int, key long, ppa long")
    got = lsm.insert_replacing(entries.where("level = 1"), entries.where("level = 0")).collect()
    assert {r.key: r.ppa for r in got} == lower | upper
    assert {r.invalid_ppa for r in got if r.invalid_ppa is not None} == {lower[k] for k in upper.keys() & lower.keys()}
    assert {r.key: r.ppa for r in lsm.level_into(entries, 0, 1).collect()} == lower | upper
