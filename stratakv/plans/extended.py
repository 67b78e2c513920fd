"""Further registered queries: layered lookups, mapping caches, compaction, collection, devices, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashes
from ..functions import keys as K
from ..operators import cache, devices, gc, layers, lsm, mapping, metrics, state
from ..sources import adapters, generators, traces
from .catalog import IOLOG, LEVELS, LRU, MOVED, OPLOG, RANDOM, RUNS, STATS, WRITES, _all_keys, _mixed_victims, register
from .runtime import bucket_width, table, work_path

# --- requests ---------------------------------------------------------------------------------------------------


@register(f"""WITH {OPLOG}, r AS (SELECT *, seq % 17 = 0 AS retry FROM oplog)
SELECT seq // 64 AS batch, row_number() OVER (PARTITION BY seq // 64 ORDER BY CASE WHEN retry THEN 0 WHEN op = 'GET' THEN 1 ELSE 2 END, seq) AS place, seq FROM r""")
def queue_priority_retry(spark, sf_dir):
    return state.schedule_with_retries(adapters.oplog(spark, sf_dir).withColumn("retry", F.col("seq") % 17 == 0), 64)


@register("SELECT CAST(event_id % 6 AS INTEGER) AS type, CASE event_id % 6 WHEN 1 THEN 'SET' WHEN 2 THEN 'GET' WHEN 3 THEN 'DELETE' ELSE 'UNKNOWN' END AS name, count(*) AS n FROM events GROUP BY ALL")
def request_types(spark, sf_dir):
    return state.classify(table(spark, sf_dir, "events").select((F.col("event_id") % 6).cast("int").alias("type")))


@register("""SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN overlay_b ELSE overlay_a END AS text FROM (
  SELECT *, substr(p_name, 1, 1) || 'ab' || substr(p_name, 4) AS overlay_a, substr(p_name, 1, 2) || 'XYZ' || substr(p_name, 6) AS overlay_b0,
         substr(substr(p_name, 1, 1) || 'ab' || substr(p_name, 4), 1, 2) || 'XYZ' || substr(p_name, 6) AS overlay_b FROM part WHERE length(p_name) >= 5)""")
def kv_read_modify_write_chain(spark, sf_dir):
    part = table(spark, sf_dir, "part").where(F.length("p_name") >= 5)
    first = part.select(F.col("p_partkey").alias("key"), F.lit("ab").alias("patch"), F.lit(1).alias("off"), F.lit(1).alias("seq"))
    second = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("key"), F.lit("XYZ").alias("patch"), F.lit(2).alias("off"), F.lit(2).alias("seq"))
    return state.read_modify_write(part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("text")), first.union(second))


# --- lookups and caches -----------------------------------------------------------------------------------------


@register("SELECT o_orderkey AS key, o_orderkey AS ppa, o_orderkey >= 0 AND o_orderkey < 100000 AS inside FROM orders")
def identity_map(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("ppa"), ((F.col("o_orderkey") >= 0) & (F.col("o_orderkey") < 100_000)).alias("inside"))


DEMAND = """log AS (SELECT event_id AS seq, user_id AS lpa, CASE WHEN event_type IN ('purchase', 'signup') THEN 'SET' ELSE 'GET' END AS op FROM events),
mapped AS (SELECT lpa, max(seq) AS ppa FROM log WHERE op = 'SET' GROUP BY lpa),
b AS (SELECT *, coalesce(max(op = 'SET') OVER (PARTITION BY lpa, seq // 256 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS buffered FROM log),
c AS (SELECT *, lag(lpa // 16) OVER (PARTITION BY (lpa // 16) % 4 ORDER BY seq) AS before FROM b WHERE op = 'GET' AND NOT buffered),
answers AS (SELECT seq, lpa, 'BUFFER' AS answered FROM b WHERE op = 'GET' AND buffered
  UNION ALL SELECT c.seq, c.lpa, CASE WHEN m.ppa IS NULL THEN 'NOTFOUND' WHEN before = c.lpa // 16 THEN 'CACHE' ELSE 'FLASH' END FROM c LEFT JOIN mapped m USING (lpa))"""


def _demand(spark, sf_dir):
    op = F.when(F.col("event_type").isin("purchase", "signup"), "SET").otherwise("GET")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("lpa"), op.alias("op"))
    return log, layers.demand_lookup(log, mapping.current(log.where("op = 'SET'").withColumnRenamed("seq", "ppa")), 256, 16, 4)


@register(f"WITH {DEMAND} SELECT * FROM answers")
def demand_lookup(spark, sf_dir):
    return _demand(spark, sf_dir)[1]


@register(f"""WITH {DEMAND}, n AS (SELECT count(*) FILTER (WHERE op = 'GET') AS reads, count(*) FILTER (WHERE op <> 'GET') AS writes FROM log), h AS (SELECT count(*) AS hits FROM answers WHERE answered IN ('BUFFER', 'CACHE'))
SELECT reads, writes, hits, round(hits / reads, 6) AS per_read, round(hits / (reads + writes), 6) AS per_all FROM n, h""")
def cache_hit_ratio(spark, sf_dir):
    log, answers = _demand(spark, sf_dir)
    hit = answers.select("seq", F.col("answered").isin("BUFFER", "CACHE").alias("hit"))
    return layers.hit_ratio(log.join(hit, "seq", "left").select("op", F.coalesce("hit", F.lit(False)).alias("hit")))


def _accesses(spark, sf_dir, page):
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 4).alias("cache"), F.col("event_id").alias("seq"), page.cast("long").alias("page"), (F.col("event_type") == "purchase").alias("dirty"))


@register(LRU.replace("user_id // 4 AS page", "user_id // 32 AS page").replace("< 16", "< 2"))
def coarse_cache_hits(spark, sf_dir):
    return cache.lru(_accesses(spark, sf_dir, F.floor(F.col("user_id") / 32)), 2).select("cache", "n", "hits")


@register(LRU.replace("user_id // 4 AS page", "user_id // 10 AS page").replace("< 16", "< 6"))
def lsm_run_cache_hits(spark, sf_dir):
    return cache.lru(_accesses(spark, sf_dir, F.floor(F.col("user_id") / 10)), 6).select("cache", "n", "hits")


@register()
def fine_cache_evictions(spark, sf_dir):
    return layers.walk_caches(_accesses(spark, sf_dir, F.col("user_id")), lambda: layers.fine_cache(24, 16), "evicted")


@register()
def split_cache_writebacks(spark, sf_dir):
    return layers.walk_caches(_accesses(spark, sf_dir, F.floor(F.col("user_id") / 8)), lambda: layers.split_cache(4, 2), "written")


# --- hash tables ------------------------------------------------------------------------------------------------

LITTLE = "xor(xor(xor({0}, {1}), xor({2}, {3})), xor(xor({4}, {5}), xor({6}, {7})))".format(*["CAST('0x' || " + " || ".join(f"substr(sha256(key), {8 * k + 1 + 2 * b}, 2)" for b in (3, 2, 1, 0)) + " AS BIGINT)" for k in range(8)])


@register(f"WITH {OPLOG} SELECT DISTINCT key, {LITTLE} & 65535 AS fp FROM oplog")
def hash_fingerprint(spark, sf_dir):
    return adapters.oplog(spark, sf_dir).select("key").distinct().select("key", K.fingerprint("key", 16).alias("fp"))


MIX = "o_orderkey"
for _c, _how, _way, _by in ((0x7ED55D16, "+", "<<", 12), (0xC761C23C, "^", ">>", 19), (0x165667B1, "+", "<<", 5), (0xD3A2646C, "+^", "<<", 9), (0xFD7046C5, "+", "<<", 3), (0xB55A4F09, "^", ">>", 16)):
    _left = f"xor(a, {_c})" if _how == "^" else f"((a + {_c}) & 4294967295)"
    _moved = f"((a {_way} {_by}) & 4294967295)"
    MIX = f"SELECT id, {f'({_left} + {_moved}) & 4294967295' if _how == '+' else f'xor({_left}, {_moved})'} AS a FROM ({MIX if MIX.startswith('SELECT') else 'SELECT o_orderkey AS id, o_orderkey & 4294967295 AS a FROM orders'})"


@register(f"SELECT id, a AS hash FROM ({MIX})")
def hash_mix32(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), hashes.mix32(F.col("o_orderkey")).alias("hash"))


def _placed(spark, sf_dir):
    """The probed table of all set keys, written once: insertion walks it in order."""
    path = work_path(spark, "probed")
    placed = mapping.insert_probing(adapters.oplog(spark, sf_dir).where("op = 'SET'").select("seq", "key"), with_slots=True)
    placed.write.parquet(path)
    return spark.read.parquet(path)


def _probed(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    most = placed.agg(F.max("c")).first()[0] or 0
    tried = placed.select("key", "shard", "slots").withColumn("h", K.fold_words("key")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(most))))
    slot = (F.col("h") + F.col("c") + F.col("c") * F.col("c")).bitwiseAND(K.MASK32) % (F.col("slots") - 1) + 1
    return layers.probe_lookup(placed, tried.select("key", "shard", "c", slot.cast("long").alias("slot")))


@register()
def hash_probe_lookup(spark, sf_dir):
    return _probed(spark, sf_dir)


@register()
def hash_load_factor(spark, sf_dir):
    shards = _placed(spark, sf_dir).groupBy("shard", "slots").agg(F.count("slot").alias("keys"))
    return shards.agg(F.sum("keys").alias("keys"), F.sum(F.col("slots") - 1).alias("slots")).select("keys", "slots", F.round(F.col("keys") / F.col("slots"), 6).alias("load"))


@register()
def hash_match_rate(spark, sf_dir):
    """Probes that met the key or another one, and the share of the latter."""
    seen = _probed(spark, sf_dir).agg(F.count("c").alias("matches"), F.sum("wrong").alias("collisions"))
    return seen.select("matches", "collisions", F.round(100 * F.col("collisions") / (F.col("matches") + F.col("collisions")), 4).alias("rate"))


# --- merge trees ------------------------------------------------------------------------------------------------


@register(f"""WITH {LEVELS}, m AS (SELECT 1 AS level, key, arg_min(ppa, level) AS ppa FROM levels WHERE level < 2 GROUP BY key)
SELECT CAST(level AS INTEGER) AS level, key, ppa FROM m UNION ALL SELECT CAST(level AS INTEGER), key, ppa FROM levels WHERE level = 2""")
def lsm_leveling(spark, sf_dir):
    return lsm.level_into(adapters.levels(spark, sf_dir), 0, 1)


@register(f"WITH {LEVELS} SELECT CAST(2 AS INTEGER) AS level, key, arg_min(ppa, level) AS ppa FROM levels GROUP BY key")
def lsm_cascade(spark, sf_dir):
    return lsm.cascade(adapters.levels(spark, sf_dir), [10, 10])


FORCED = "SELECT CAST(level AS INTEGER) AS level, key, ppa FROM levels WHERE level < 2 AND level <> (SELECT l FROM pick) UNION ALL SELECT 2, key, arg_min(ppa, level) FROM levels WHERE level = 2 OR level = (SELECT l FROM pick) GROUP BY key"


@register(f"WITH {LEVELS}, pick AS (SELECT level AS l FROM levels WHERE level < 2 GROUP BY level ORDER BY count(*) DESC, level LIMIT 1) {FORCED}")
def lsm_force_largest(spark, sf_dir):
    return lsm.force_largest(adapters.levels(spark, sf_dir), 2)


@register(f"WITH {LEVELS}, pick AS (SELECT max(level) AS l FROM levels WHERE level < 2) {FORCED}")
def lsm_force_deepest(spark, sf_dir):
    return lsm.force_deepest(adapters.levels(spark, sf_dir), 2)


@register(f"WITH {LEVELS} SELECT CAST(CASE WHEN level = 2 THEN 3 ELSE level END AS INTEGER) AS level, key, ppa FROM levels")
def lsm_move_to_empty(spark, sf_dir):
    return lsm.level_into(adapters.levels(spark, sf_dir), 2, 3)


@register(f"""WITH {LEVELS}, m AS (SELECT key, arg_min(ppa, level) AS ppa FROM levels WHERE level < 2 GROUP BY key), p AS (SELECT key, (row_number() OVER (ORDER BY key) - 1) // 510 AS run FROM m)
SELECT CAST(1 AS INTEGER) AS level, run, min(key) AS first_key, max(key) AS last_key, count(*) AS n FROM p GROUP BY run""")
def lsm_merge_cut(spark, sf_dir):
    merged = lsm.level_into(adapters.levels(spark, sf_dir).where("level < 2"), 0, 1)
    return lsm.flush_runs(merged)


@register(f"WITH {LEVELS}, moved AS (SELECT DISTINCT key, ppa + 1000000000 AS ppa FROM levels WHERE level = 2 AND ppa % 5 = 0) SELECT CAST(level AS INTEGER) AS level, key, ppa FROM levels UNION ALL SELECT 0, key, ppa FROM moved WHERE key NOT IN (SELECT key FROM levels WHERE level = 0)")
def lsm_reinsert(spark, sf_dir):
    entries = adapters.levels(spark, sf_dir)
    return lsm.reinsert(entries, entries.where("level = 2 and ppa % 5 = 0").select("key", (F.col("ppa") + 1_000_000_000).alias("ppa")))


@register(f"""WITH {LEVELS}, o AS (SELECT key, ppa FROM levels WHERE level = 1), n AS (SELECT key, ppa FROM levels WHERE level = 0)
SELECT key, coalesce(n.ppa, o.ppa) AS ppa, CASE WHEN n.ppa IS NOT NULL THEN o.ppa END AS invalid_ppa FROM o FULL JOIN n USING (key)""")
def memtable_replace(spark, sf_dir):
    entries = adapters.levels(spark, sf_dir)
    return lsm.insert_replacing(entries.where("level = 1"), entries.where("level = 0"))


@register(f"WITH {LEVELS} SELECT key, ppa, key IN (SELECT key FROM levels WHERE level = 1) AS refused FROM levels WHERE level = 0")
def memtable_unique(spark, sf_dir):
    entries = adapters.levels(spark, sf_dir)
    return lsm.insert_unique(entries.where("level = 1"), entries.where("level = 0"))


LAYERED = """l AS (SELECT -1 AS layer, o_custkey AS key, max(o_orderkey) AS ppa FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey UNION ALL SELECT level, key, ppa FROM levels),
k AS (SELECT o_custkey AS key FROM orders UNION SELECT 3 * o_custkey + 1 FROM orders), names AS (SELECT layer, row_number() OVER (ORDER BY layer) AS at FROM (SELECT DISTINCT layer FROM l)),
h AS (SELECT key, min(layer) AS layer, arg_min(ppa, layer) AS ppa FROM l GROUP BY key)"""


@register(f"WITH {LEVELS}, {LAYERED} SELECT k.key, CAST(h.layer AS INTEGER) AS layer, h.ppa, coalesce(n.at, (SELECT count(*) FROM names)) AS probed FROM k LEFT JOIN h USING (key) LEFT JOIN names n ON n.layer = h.layer")
def lsm_layered_search(spark, sf_dir):
    memtable = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("ppa"))
    entries = adapters.levels(spark, sf_dir).select(F.col("level").alias("layer"), "key", "ppa").unionByName(memtable.withColumn("layer", F.lit(-1)))
    return lsm.layered_search(entries, _all_keys(spark, sf_dir))


@register(f"WITH {RUNS}, p AS (SELECT o_custkey AS key FROM orders UNION SELECT 3 * o_custkey + 1 FROM orders), f AS (SELECT p.key, r.level, r.run FROM p JOIN runs r ON p.key BETWEEN r.first_key AND r.last_key) SELECT f.key, f.level, r.run FROM f JOIN runs r ON r.level = f.level AND r.run IN (f.run, f.run + 1)")
def lsm_runs_from_key(spark, sf_dir):
    entries = adapters.levels(spark, sf_dir)
    runs = lsm.flush_runs(entries)
    return lsm.runs_from(runs, lsm.run_of(runs, _all_keys(spark, sf_dir), entries, bucket_width(entries, "key")), 2)


@register(f"WITH {LEVELS} SELECT level, count(*) AS n, count(*) >= 950 AS \"full\" FROM levels GROUP BY level")
def lsm_full_levels(spark, sf_dir):
    return lsm.full_levels(adapters.levels(spark, sf_dir), 1000, 10)


@register(f"WITH {LEVELS}, l AS (SELECT DISTINCT level FROM levels) SELECT level, round((1 - 4.0::DOUBLE) / (1 - 16.0::DOUBLE) * pow(4, level), 9) AS rate FROM l")
def bloom_rates_by_level(spark, sf_dir):
    return lsm.rates_by_level(adapters.levels(spark, sf_dir).select("level").distinct(), 4.0, 3)


@register(f"WITH {LEVELS}, s AS (SELECT level, count(*) AS n FROM levels GROUP BY level) SELECT level, round(pow(1 - exp(-7 / floor(10000.0::DOUBLE / n)), 7), 9) AS rate FROM s WHERE n <= 10000")
def bloom_rate_of_memory(spark, sf_dir):
    s = lsm.summary(adapters.levels(spark, sf_dir)).where("n <= 10000")
    return s.select("level", F.round(K.bloom_rate(F.lit(10_000), F.col("n"), F.lit(7)), 9).alias("rate"))


# --- collection and blocks --------------------------------------------------------------------------------------


def _valid(spark, sf_dir):
    return mapping.validity(adapters.page_writes(spark, sf_dir))


@register(f"WITH {STATS}, u AS (SELECT count(*) AS used FROM stats) SELECT 1100 - used AS free, (1100 - used) * 100 / 1100.0 <= 20 AS needed, 1100 - used <= 0 AS exhausted FROM u")
def gc_trigger(spark, sf_dir):
    return gc.trigger(gc.block_stats(_valid(spark, sf_dir)), 1100)


@register(f"WITH {STATS} SELECT unit, 5000000 + unit AS active, block AS reserve FROM victims")
def gc_reserve_swap(spark, sf_dir):
    return gc.swap_reserve(gc.greedy(gc.block_stats(_valid(spark, sf_dir)), 8), 5_000_000)


@register(f"WITH {MOVED} SELECT lpa // 256 AS tpage, count(*) AS n FROM moved GROUP BY tpage")
def gc_translation_updates(spark, sf_dir):
    valid = _valid(spark, sf_dir)
    return gc.translation_updates(gc.relocate(valid, _mixed_victims(valid), 10_000_000), 256)


MIXED_SQL = "(SELECT block FROM (SELECT block, row_number() OVER (PARTITION BY block % 8 ORDER BY invalid DESC, block) AS rn FROM stats WHERE invalid < pages) WHERE rn = 1)"


@register(f"WITH {STATS}, {RUNS}, x AS (SELECT lpa AS key FROM valid WHERE valid AND block IN {MIXED_SQL}) SELECT r.level, r.run, count(*) AS n FROM x JOIN runs r ON x.key BETWEEN r.first_key AND r.last_key GROUP BY ALL")
def gc_lsm_headers(spark, sf_dir):
    valid = _valid(spark, sf_dir)
    moves = gc.relocate(valid, _mixed_victims(valid), 10_000_000).select(F.col("lpa").alias("key"))
    entries = adapters.levels(spark, sf_dir)
    return gc.lsm_data_updates(moves, lsm.run_of(lsm.flush_runs(entries), moves.distinct(), entries, bucket_width(entries, "key")))


@register(f"WITH {STATS} SELECT v.block, v.ppa AS grain, (row_number() OVER (PARTITION BY v.block ORDER BY v.ppa) - 1) // 4 AS new_page, (row_number() OVER (PARTITION BY v.block ORDER BY v.ppa) - 1) % 4 AS slot FROM valid v WHERE v.valid")
def subpage_compaction(spark, sf_dir):
    valid = _valid(spark, sf_dir)
    return devices.pack_grains(valid, valid.select("block").distinct(), 4)


@register(f"WITH {WRITES} SELECT ppa // 4 AS page, bool_or(valid) AS live, count(*) FILTER (WHERE valid) AS n_live FROM valid GROUP BY page")
def live_grains(spark, sf_dir):
    return devices.live_pages(_valid(spark, sf_dir), 4)


@register("SELECT o_orderkey AS pga, o_orderkey // 16 AS ppa, o_orderkey % 16 AS offset_in_page FROM orders")
def grain_address(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pga"), F.expr("o_orderkey div 16").alias("ppa"), (F.col("o_orderkey") % 16).alias("offset_in_page"))


@register(f"WITH {WRITES} SELECT count(*) FILTER (WHERE valid) AS grains, CAST(ceil(count(*) FILTER (WHERE valid) / 16.0) AS BIGINT) AS pages FROM valid")
def grains_to_pages(spark, sf_dir):
    n = _valid(spark, sf_dir).agg(F.count_if("valid").alias("grains"))
    return n.select("grains", K.grains(F.col("grains"), 16).alias("pages"))


@register(f"""WITH {STATS}, b AS (SELECT unnest(range(0, (SELECT max(block) + 8 FROM stats))) AS block)
SELECT b.block, CASE WHEN s.block IS NULL THEN 'FREE' WHEN s.invalid = 0 THEN 'CLEAN' ELSE 'DIRTY' END AS state, coalesce(s.invalid, 0) AS invalid FROM b LEFT JOIN stats s USING (block)""")
def block_states(spark, sf_dir):
    valid = _valid(spark, sf_dir)
    blocks = (valid.agg(F.max("block")).first()[0] or 0) + 8
    return devices.block_states(valid, spark.range(blocks).withColumnRenamed("id", "block"))


@register("WITH w AS (SELECT o_custkey AS lpa FROM orders) SELECT lpa // 16384 AS seg, (lpa % 16384) % 64 AS blk, count(DISTINCT lpa) AS written, count(*) - count(DISTINCT lpa) AS rewritten FROM w GROUP BY ALL")
def block_page_status(spark, sf_dir):
    return devices.page_status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lpa")), 16384, 64)


@register(f"""WITH {STATS}, f AS (SELECT block, 1000000 + row_number() OVER (ORDER BY block) - 1 AS new_block FROM victims) SELECT v.lpa, v.ppa AS old_ppa, f.new_block * 64 + v.ppa % 64 AS new_ppa FROM valid v JOIN f USING (block) WHERE v.valid""")
def block_merge(spark, sf_dir):
    valid = _valid(spark, sf_dir)
    return devices.merge_blocks(valid, gc.greedy(gc.block_stats(valid), 8), 1_000_000, 64)


@register("SELECT event_id % 4 AS unit, user_id AS lpa, event_id AS seq, row_number() OVER (PARTITION BY event_id % 4, user_id ORDER BY event_id) AS turn FROM events")
def same_page_order(spark, sf_dir):
    return devices.arrival_order(table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("unit"), F.col("user_id").alias("lpa"), F.col("event_id").alias("seq")))


# --- devices and sources ----------------------------------------------------------------------------------------

OPS = "ops AS (SELECT event_id AS seq, user_id AS page, user_id // 8 AS block, CASE WHEN event_type IN ('purchase', 'signup') THEN 'WRITE' WHEN event_type = 'error' THEN 'ERASE' ELSE 'READ' END AS op FROM events)"


def _ops(spark, sf_dir):
    op = F.when(F.col("event_type").isin("purchase", "signup"), "WRITE").when(F.col("event_type") == "error", "ERASE").otherwise("READ")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("page"), F.floor(F.col("user_id") / 8).alias("block"), op.alias("op"))


@register(f"""WITH {OPS}, e AS (SELECT *, coalesce(max(CASE WHEN op = 'ERASE' THEN seq END) OVER (PARTITION BY block ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS erased FROM ops),
w AS (SELECT *, lag(seq) OVER (PARTITION BY page ORDER BY seq) AS last FROM e WHERE op = 'WRITE') SELECT seq, page FROM w WHERE last > erased""")
def device_overwrites(spark, sf_dir):
    return devices.overwritten(_ops(spark, sf_dir))


@register(f"WITH {OPS} SELECT op, count(*) AS n FROM ops GROUP BY op")
def device_counts(spark, sf_dir):
    return devices.counts(_ops(spark, sf_dir))


@register("WITH r AS (SELECT o_orderkey AS id, o_custkey AS off, o_orderkey % 5 + 1 AS len FROM orders) SELECT id, off + i AS page, i = len - 1 AS last FROM (SELECT *, unnest(range(0, len)) AS i FROM r)")
def page_range_fan_out(spark, sf_dir):
    return devices.fan_out(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("off"), (F.col("o_orderkey") % 5 + 1).alias("len")))


@register("SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS rw, l_partkey AS off, least(CAST(floor(l_quantity) AS INTEGER), 8) AS len FROM lineitem")
def trace_block_round_trip(spark, sf_dir):
    path = work_path(spark, "block-trace")
    adapters.block_trace(spark, sf_dir).select("rw", "off", "len").write.csv(path, sep=" ")
    return traces.read_block_trace(spark, path)


@register("SELECT s_suppkey AS page, 10000 + s_suppkey AS replacement FROM supplier WHERE s_suppkey % 13 = 0")
def trace_bad_blocks(spark, sf_dir):
    path = work_path(spark, "bad-blocks")
    table(spark, sf_dir, "supplier").where("s_suppkey % 13 = 0").select("s_suppkey", F.lit(10_000) + F.col("s_suppkey")).write.csv(path, sep=" ")
    return traces.read_bad_blocks(spark, path, pairs=True)


@register("SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN 3 ELSE 2 END AS type, event_id AS seq, CASE WHEN event_type = 'error' THEN 10 ELSE 0 END AS scanlength, 'user' || user_id AS key, CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(event_id % 4096 AS INTEGER) ELSE 0 END AS vlen FROM events")
def trace_binary_round_trip(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", 3).otherwise(2)
    e = table(spark, sf_dir, "events").select(kind.alias("kind"), F.col("event_id").alias("seq"), F.when(kind == 3, 10).otherwise(0).alias("scan"), F.concat(F.lit("user"), F.col("user_id")).alias("key"), F.when(kind == 1, F.col("event_id") % 4096).otherwise(0).alias("vlen"))
    streams = e.groupBy(F.floor(F.col("seq") / 4096).alias("stream")).applyInPandas(traces.pack_stream, "content binary")
    return traces.parse_binary(streams)


@register(f"WITH {RUNS} SELECT p.level, p.run, p.key, l.ppa FROM placed p JOIN levels l USING (level, key)")
def level_dump_round_trip(spark, sf_dir):
    path = work_path(spark, "levels")
    traces.write_levels(adapters.levels(spark, sf_dir), path)
    return spark.read.parquet(path).select(F.col("level").cast("int").alias("level"), "run", "key", "ppa")


@register("SELECT i AS seq, 'SET' AS op, 100 + i % 900 AS key FROM range(0, 2000) t(i) UNION ALL SELECT i + 2000, 'GET', 100 + i % 900 FROM range(0, 2000) t(i)")
def gen_sequential_rw(spark, sf_dir):
    return generators.set_then_get(generators.sequential(spark, "SET", 100, 1000, 2000), 2000)


@register(f"SELECT i AS seq, 1 + {RANDOM.format(s=5, n=15)} AS pieces FROM range(0, 4000) t(i)")
def gen_value_sizes(spark, sf_dir):
    return generators.value_sizes(spark, 4000, 16, 5)


@register("SELECT row_number() OVER (ORDER BY md5('1/' || i)) - 1 AS seq, 'SET' AS op, i AS key FROM range(0, 3000) t(i)")
def gen_permutation_positions(spark, sf_dir):
    return generators.permuted(spark, 3000)


# --- reports ----------------------------------------------------------------------------------------------------

TRAFFIC = """t AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'trans' ELSE 'data' END AS kind, CASE event_id % 4 WHEN 0 THEN 'collection' ELSE 'request' END AS cause, event_type IN ('purchase', 'signup') AS w, count(*) AS n FROM events GROUP BY ALL)"""


def _traffic(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.when(F.col("user_id") % 3 == 0, "trans").otherwise("data").alias("kind"), F.when(F.col("event_id") % 4 == 0, "collection").otherwise("request").alias("cause"), F.col("event_type").isin("purchase", "signup").alias("write"))
    return rows.groupBy("kind", "cause", "write").agg(F.count("*").alias("n"))


@register(f"WITH {TRAFFIC} SELECT round(sum(n) FILTER (WHERE w) / sum(n) FILTER (WHERE w AND kind = 'data' AND cause = 'request'), 6) AS waf, round(sum(n) FILTER (WHERE NOT w) / sum(n) FILTER (WHERE NOT w AND kind = 'data' AND cause = 'request'), 6) AS raf FROM t")
def demand_waf_raf(spark, sf_dir):
    return metrics.demand_amplification(_traffic(spark, sf_dir))


@register(f"""WITH {TRAFFIC} SELECT cause, CAST(coalesce(sum(n) FILTER (WHERE kind = 'data' AND NOT w), 0) AS BIGINT) AS data_reads, CAST(coalesce(sum(n) FILTER (WHERE kind = 'data' AND w), 0) AS BIGINT) AS data_writes,
CAST(coalesce(sum(n) FILTER (WHERE kind = 'trans' AND NOT w), 0) AS BIGINT) AS trans_reads, CAST(coalesce(sum(n) FILTER (WHERE kind = 'trans' AND w), 0) AS BIGINT) AS trans_writes FROM t GROUP BY cause""")
def traffic_by_cause(spark, sf_dir):
    return metrics.cause_breakdown(_traffic(spark, sf_dir))


@register(f"WITH {IOLOG}, x AS (SELECT latency_us * 97 AS latency_us FROM iolog) SELECT CASE WHEN latency_us >= 1000000 THEN 11 ELSE least(latency_us // 1000, 10) END AS ms, count(*) AS n FROM x GROUP BY ALL")
def lat_ms_buckets(spark, sf_dir):
    return metrics.millisecond_histogram(adapters.iolog(spark, sf_dir).withColumn("latency_us", F.col("latency_us") * 97))


@register("SELECT CAST(sum(least(CAST(floor(l_quantity) AS BIGINT), 8)) AS BIGINT) AS pages, round(sum(least(CAST(floor(l_quantity) AS BIGINT), 8)) * 8192 / 2.5::DOUBLE / 1e6, 4) AS mb_s FROM lineitem")
def trace_replay_rate(spark, sf_dir):
    pages = adapters.block_trace(spark, sf_dir).agg(F.sum("len").cast("long").alias("pages"))
    return pages.select("pages", metrics.replay_rate(F.col("pages"), 2.5).alias("mb_s"))
