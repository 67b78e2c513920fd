"""The registered queries of the engine and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import bloom, cache, gc, lsm, mapping, metrics, packing, scans, state, textscan
from ..sources import adapters, generators, traces
from .runtime import bucket_width, stored, table, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

OPLOG = """oplog AS (
  SELECT event_id AS seq, ts, 'user' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS key,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'SET' WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'DELETE' END AS op,
         value AS val, CAST(floor(value * 16) AS BIGINT) % 8192 + 1 AS vlen FROM events)"""
STATE = OPLOG + """,
last_write AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM oplog WHERE op <> 'GET'),
state AS (SELECT key, seq, val, vlen FROM last_write WHERE rn = 1 AND op = 'SET')"""
IOLOG = """iolog AS (
  SELECT event_id AS seq, event_type AS lreq, CAST(user_id % 4 AS INTEGER) AS type_ftl, CAST(event_id % 2 AS INTEGER) AS type_lower,
         CAST(floor(value * 100) AS BIGINT) AS latency_us FROM events)"""
WRITES = """writes AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS ppa, l_partkey AS lpa,
         (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) // 64 AS block FROM lineitem),
valid AS (SELECT ppa, lpa, block, ppa = max(ppa) OVER (PARTITION BY lpa) AS valid FROM writes)"""
STATS = WRITES + """,
stats AS (SELECT block, count(*) AS pages, count(*) FILTER (WHERE NOT valid) AS invalid, min(ppa) AS born FROM valid GROUP BY block),
victims AS (SELECT unit, block, invalid FROM (SELECT block % 8 AS unit, block, invalid, row_number() OVER (PARTITION BY block % 8 ORDER BY invalid DESC, block) AS rn FROM stats) WHERE rn = 1)"""
LEVELS = """levels AS (
  SELECT CASE WHEN year(o_orderdate) >= 1997 THEN 0 WHEN year(o_orderdate) >= 1995 THEN 1 ELSE 2 END AS level, o_custkey AS key, max(o_orderkey) AS ppa
  FROM orders GROUP BY ALL)"""
RUNS = LEVELS + """,
placed AS (SELECT level, key, (row_number() OVER (PARTITION BY level ORDER BY key) - 1) // 510 AS run FROM levels),
runs AS (SELECT level, run, min(key) AS first_key, max(key) AS last_key, count(*) AS n FROM placed GROUP BY ALL)"""


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def visible(spark, sf_dir):
    return state.visible(adapters.oplog(spark, sf_dir))


# --- requests ---------------------------------------------------------------------------------------------------


@register(f"WITH {STATE} SELECT key, seq, val, vlen FROM state")
def kv_latest_state(spark, sf_dir):
    return visible(spark, sf_dir)


def _probes(spark):
    return spark.range(0, 400, 3).select(K.encode_key(F.col("id")).alias("key"))


PROBES = "probes AS (SELECT 'user' || lpad(CAST(i AS VARCHAR), 12, '0') AS key FROM range(0, 400, 3) t(i))"


@register(f"WITH {STATE}, {PROBES} SELECT p.key, s.val, CASE WHEN s.seq IS NULL THEN 'NOTFOUND' ELSE 'OK' END AS status FROM probes p LEFT JOIN state s USING (key)")
def kv_point_get(spark, sf_dir):
    return state.get(visible(spark, sf_dir), _probes(spark))


@register(f"WITH {STATE}, {PROBES} SELECT p.key FROM probes p ANTI JOIN state s USING (key)")
def kv_get_notfound(spark, sf_dir):
    return state.get(visible(spark, sf_dir), _probes(spark)).where("status = 'NOTFOUND'").select("key")


@register(f"""WITH {STATE}, r AS (SELECT i // 5 AS req, 'user' || lpad(CAST(i * 3 AS VARCHAR), 12, '0') AS key FROM range(0, 100) t(i))
SELECT req, count(*) AS n_keys, count(seq) AS n_found, round(sum(val), 4) AS sum_val FROM r LEFT JOIN state USING (key) GROUP BY req""")
def kv_multi_get(spark, sf_dir):
    ids = spark.range(0, 100).groupBy(F.floor(F.col("id") / 5).alias("req")).agg(F.collect_list(K.encode_key(F.col("id") * 3)).alias("keys"))
    return state.multi_get(visible(spark, sf_dir), ids)


@register(f"WITH {OPLOG} SELECT seq // 100 AS seq, row_number() OVER (PARTITION BY seq // 100 ORDER BY seq) - 1 AS pos, key, val FROM oplog WHERE op = 'SET'")
def kv_multi_set(spark, sf_dir):
    sets = adapters.oplog(spark, sf_dir).where("op = 'SET'")
    packed = sets.groupBy(F.floor(F.col("seq") / 100).alias("seq")).agg(F.sort_array(F.collect_list(F.struct(F.col("seq").alias("s"), "key", "val"))).alias("x"))
    asked = packed.select("seq", F.col("x.key").alias("keys"), F.col("x.val").alias("vals"))
    return state.multi_set(asked).withColumn("pos", F.col("pos").cast("long"))


@register(f"WITH {STATE} SELECT key FROM last_write WHERE rn = 1 AND op = 'DELETE'")
def kv_deleted_keys(spark, sf_dir):
    return state.latest(adapters.oplog(spark, sf_dir)).where("op = 'DELETE'").select("key")


@register(f"""WITH {OPLOG}, seen AS (
  SELECT *, max(CASE WHEN op <> 'GET' THEN seq END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ws FROM oplog)
SELECT s.seq, s.key, CASE WHEN w.op = 'SET' THEN w.val END AS val, CASE WHEN w.op = 'SET' THEN 'OK' ELSE 'NOTFOUND' END AS status
FROM seen s LEFT JOIN oplog w ON w.seq = s.ws WHERE s.op = 'GET'""")
def kv_asof_get(spark, sf_dir):
    return state.as_of_get(adapters.oplog(spark, sf_dir))


@register("""SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN substr(p_name, 1, 2) || 'XYZ' || substr(p_name, 6) ELSE p_name END AS text FROM part WHERE length(p_name) >= 5""")
def kv_read_modify_write(spark, sf_dir):
    part = table(spark, sf_dir, "part").where(F.length("p_name") >= 5)
    pages = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("text"))
    patches = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("key"), F.lit("XYZ").alias("patch"), F.lit(2).alias("off"))
    return state.read_modify_write(pages, patches)


@register(f"""WITH {OPLOG}, cut AS (SELECT max(seq) - 200 AS c FROM oplog),
w AS (SELECT *, seq > (SELECT c FROM cut) AS late, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM oplog WHERE op <> 'GET')
SELECT key, val, late AS pending FROM w WHERE rn = 1 AND op = 'SET'""")
def kv_pending_overlay(spark, sf_dir):
    log = adapters.oplog(spark, sf_dir)
    cut = (log.agg(F.max("seq")).first()[0] or 0) - 200
    return state.pending_overlay(state.visible(log.where(F.col("seq") <= cut)), log.where(F.col("seq") > cut))


@register(f"WITH {OPLOG} SELECT seq // 64 AS batch, key, max(seq) AS seq, arg_max(val, seq) AS val FROM oplog WHERE op = 'SET' GROUP BY ALL")
def queue_write_coalescing(spark, sf_dir):
    return state.coalesce_writes(adapters.oplog(spark, sf_dir), 64)


@register(f"WITH {OPLOG} SELECT seq // 64 AS batch, CAST(row_number() OVER (PARTITION BY seq // 64 ORDER BY op <> 'GET', seq) AS INTEGER) AS place, seq, op FROM oplog")
def queue_priority_order(spark, sf_dir):
    return state.schedule(adapters.oplog(spark, sf_dir), 64)


# --- scans ------------------------------------------------------------------------------------------------------


@register(f"WITH {STATE} SELECT key, val FROM state WHERE key >= 'user000000000050' ORDER BY key LIMIT 10")
def kv_range_scan(spark, sf_dir):
    return scans.range_scan(visible(spark, sf_dir).select("key", "val"), "user000000000050", 10)


PARTKEYS = "k AS (SELECT p_partkey AS key FROM part WHERE p_partkey % 3 <> 0), s AS (SELECT DISTINCT p_partkey AS start FROM part WHERE p_partkey % 97 = 0)"


@register(f"""WITH {PARTKEYS}, r AS (SELECT s.start, k.key, row_number() OVER (PARTITION BY s.start ORDER BY k.key) AS place FROM s JOIN k ON k.key >= s.start)
SELECT start, CAST(place AS INTEGER) AS place, key FROM r WHERE place <= 10""")
def kv_range_batch(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    keys = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"))
    starts = part.where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("start")).distinct()
    return scans.range_batch(keys, starts, 10, bucket_width(keys, "key"))


@register(f"WITH {PARTKEYS} SELECT s.start AS probe, (SELECT max(key) FROM k WHERE key <= s.start) AS floor, (SELECT min(key) FROM k WHERE key >= s.start) AS lower FROM s")
def kv_key_bounds(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    keys = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"))
    return scans.bounds(keys, part.where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("probe")).distinct(), bucket_width(keys, "key"))


@register(f"WITH {STATE} SELECT key FROM state WHERE starts_with(key, 'user00000000001')")
def kv_prefix_keys(spark, sf_dir):
    return scans.prefix_scan(visible(spark, sf_dir), "user00000000001").select("key")


@register(f"WITH {STATE} SELECT key, val, vlen FROM state WHERE starts_with(key, 'user00000000001')")
def kv_prefix_values(spark, sf_dir):
    return scans.prefix_scan(visible(spark, sf_dir), "user00000000001").select("key", "val", "vlen")


@register(f"WITH {STATE} SELECT key, val FROM state WHERE starts_with(key, 'user0000000000') AND key > 'user000000000020' ORDER BY key LIMIT 10")
def kv_cursor_next(spark, sf_dir):
    return scans.cursor_page(visible(spark, sf_dir), "user0000000000", "user000000000020", 10).select("key", "val")


@register(f"WITH {STATE} SELECT string_agg(key, chr(10) ORDER BY key) AS keys, count(*) AS n FROM state WHERE starts_with(key, 'user00000000001')")
def kv_iterate_all(spark, sf_dir):
    found = scans.prefix_scan(visible(spark, sf_dir), "user00000000001")
    return found.agg(F.array_join(F.sort_array(F.collect_list("key")), "\n").alias("keys"), F.count("*").alias("n"))


@register(f"""WITH {OPLOG}, k AS (SELECT DISTINCT key || repeat('x', CAST(right(key, 1) AS INTEGER)) AS key FROM oplog)
SELECT key, substr(key, 1, CAST(least(length(key), ((length(key) + 15) // 16) * 16 - 4) AS INTEGER)) AS norm, octet_length(encode(key)) > 0 AND ascii(key) < 128 AS valid FROM k""")
def key_normalise(spark, sf_dir):
    keys = adapters.oplog(spark, sf_dir).select(F.expr("concat(key, repeat('x', cast(right(key, 1) as int)))").alias("key")).distinct()
    return keys.select("key", K.normalise_key("key").alias("norm"), K.valid_key(F.col("key")).alias("valid"))


# --- sources ----------------------------------------------------------------------------------------------------


@register(f"WITH {OPLOG} SELECT seq, op, key, length(key) AS keylen, vlen FROM oplog WHERE op <> 'DELETE'")
def trace_kv_round_trip(spark, sf_dir):
    path = work_path(spark, "trace")
    traces.write_kv_trace(adapters.oplog(spark, sf_dir).where("op <> 'DELETE'"), path)
    return traces.read_kv_trace(spark, path).select("seq", "op", "key", F.col("keylen").cast("long").alias("keylen"), F.col("valuelen").cast("long").alias("vlen"))


BLOCKS = "b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS rw, l_partkey AS off, least(CAST(floor(l_quantity) AS INTEGER), 8) AS len FROM lineitem)"


@register(f"WITH {BLOCKS}, x AS (SELECT rw, off, unnest(range(off, off + len)) AS page FROM b) SELECT rw, page, count(*) AS n FROM x GROUP BY ALL")
def block_trace_pages(spark, sf_dir):
    t = adapters.block_trace(spark, sf_dir).where("len > 0")
    return t.select("rw", F.explode(F.sequence(F.col("off"), F.col("off") + F.col("len") - 1)).alias("page")).groupBy("rw", "page").agg(F.count("*").alias("n"))


@register("""WITH r AS (SELECT o_orderkey AS id, o_orderkey * 1000 AS off, CAST(o_custkey % 20000 + 1 AS BIGINT) AS len FROM orders),
x AS (SELECT id, off, len, unnest(range(off // 8192, (off + len - 1) // 8192 + 1)) AS page FROM r)
SELECT id, page, greatest(off, page * 8192) - page * 8192 AS first_byte, least(off + len, (page + 1) * 8192) - page * 8192 AS end_byte,
       least(off + len, (page + 1) * 8192) - greatest(off, page * 8192) < 8192 AS partial FROM x""")
def block_split_io(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 1000).alias("off"), (F.col("o_custkey") % 20000 + 1).alias("len"))
    page = F.explode(F.sequence(F.expr("off div 8192"), F.expr("(off + len - 1) div 8192")))
    x = o.withColumn("page", page)
    lo, hi = F.greatest("off", F.col("page") * 8192), F.least(F.col("off") + F.col("len"), (F.col("page") + 1) * 8192)
    return x.select("id", "page", (lo - F.col("page") * 8192).alias("first_byte"), (hi - F.col("page") * 8192).alias("end_byte"), (hi - lo < 8192).alias("partial"))


@register("""SELECT o_orderkey AS id, CAST(ceil(o_orderkey * 1000 / 8192.0) AS BIGINT) AS first_page,
CAST(greatest(0, floor((o_orderkey * 1000 + o_custkey % 20000 + 1) / 8192.0) - ceil(o_orderkey * 1000 / 8192.0)) AS BIGINT) AS pages FROM orders""")
def trim_shrink(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    start, end = F.ceil(F.col("o_orderkey") * 1000 / 8192.0), F.floor((F.col("o_orderkey") * 1000 + F.col("o_custkey") % 20000 + 1) / 8192.0)
    return o.select(F.col("o_orderkey").alias("id"), start.cast("long").alias("first_page"), F.greatest(F.lit(0), end - start).cast("long").alias("pages"))


@register("SELECT event_id AS seq, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'SET' END AS op, 'k' || user_id AS key, CASE WHEN event_type = 'view' THEN NULL ELSE length(event_type) END AS vlen FROM events WHERE event_type IN ('view', 'click')")
def resp_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    key = F.concat(F.lit("k"), F.col("user_id"))
    bulk = lambda c: F.concat(F.lit("$"), F.length(c), F.lit("\r\n"), c, F.lit("\r\n"))
    wire = F.when(F.col("event_type") == "view", F.concat(F.lit("*2\r\n"), bulk(F.lit("GET")), bulk(key))).otherwise(F.concat(F.lit("*3\r\n"), bulk(F.lit("SET")), bulk(key), bulk(F.col("event_type"))))
    return traces.parse_resp(e.select(F.col("event_id").alias("seq"), wire.alias("message"))).select("seq", "op", "key", F.col("vlen").cast("long").alias("vlen"))


@register("SELECT i AS seq, 'SET' AS op, 100 + i % 900 AS key FROM range(0, 5000) t(i)")
def gen_sequential(spark, sf_dir):
    return generators.sequential(spark, "SET", 100, 1000, 5001)


RANDOM = "('0x' || substr(md5('{s}/' || i), 1, 8))::BIGINT % {n}"


@register(f"SELECT i AS seq, 'SET' AS op, {RANDOM.format(s=1, n=1000)} AS key FROM range(0, 5000) t(i) UNION ALL SELECT i + 5000, 'GET', {RANDOM.format(s=1, n=1000)} FROM range(0, 5000) t(i)")
def gen_random_rw(spark, sf_dir):
    return generators.set_then_get(generators.random(spark, "SET", 0, 1000, 5000), 5000)


MIXED = f"m AS (SELECT i AS seq, CASE WHEN {RANDOM.format(s=2, n=100)} < 50 THEN 'SET' ELSE 'GET' END AS op, {RANDOM.format(s=1, n=1000)} AS key FROM range(0, 5000) t(i))"


@register(f"WITH {MIXED} SELECT seq, CASE WHEN op = 'GET' AND EXISTS (SELECT 1 FROM m w WHERE w.key = m.key AND w.op = 'SET' AND w.seq < m.seq) THEN 'GET' ELSE 'SET' END AS op, key FROM m")
def gen_mixed_written(spark, sf_dir):
    return generators.written_reads(generators.mixed(spark, 0, 1000, 5000))


@register("SELECT md5('1/' || i) AS place, 'SET' AS op, i AS key FROM range(0, 3000) t(i)")
def gen_permutation(spark, sf_dir):
    return generators.permutation(spark, 3000)


@register(f"""WITH g AS (SELECT i AS seq, CASE WHEN {RANDOM.format(s=1, n=100)} < 80 THEN {RANDOM.format(s=2, n=200)} ELSE 200 + {RANDOM.format(s=3, n=800)} END AS key FROM range(0, 5000) t(i))
SELECT count(*) AS n, count(*) FILTER (WHERE key < 200) AS hot, round(count(*) FILTER (WHERE key < 200) / count(*), 6) AS share FROM g""")
def locality_share(spark, sf_dir):
    g = generators.local_keys(spark, 5000, 1000, 80, 0.2)
    return g.agg(F.count("*").alias("n"), F.count_if(F.expr("key < 200")).alias("hot"), F.round(F.count_if(F.expr("key < 200")) / F.count("*"), 6).alias("share"))


# --- measures ---------------------------------------------------------------------------------------------------


@register(f"""WITH {IOLOG} SELECT type_ftl, type_lower, max(latency_us) AS max_us, min(latency_us) AS min_us, round(avg(latency_us), 4) AS avg_us, count(*) AS n,
round(100 * count(*) / (SELECT count(*) FROM iolog), 4) AS pct FROM iolog GROUP BY ALL""")
def lat_by_type(spark, sf_dir):
    return metrics.latency_by_type(adapters.iolog(spark, sf_dir))


@register(f"WITH {IOLOG} SELECT least(latency_us // 10, 100000) AS slot, count(*) AS n FROM iolog GROUP BY ALL")
def lat_histogram(spark, sf_dir):
    return metrics.histogram(adapters.iolog(spark, sf_dir))


@register(f"WITH {IOLOG}, h AS (SELECT least(latency_us // 10, 100000) AS slot, count(*) AS n FROM iolog GROUP BY ALL) SELECT slot * 10 AS us, n, round(sum(n) OVER (ORDER BY slot) / sum(n) OVER (), 6) AS share FROM h")
def lat_cdf(spark, sf_dir):
    return metrics.cdf(adapters.iolog(spark, sf_dir))


@register(f"WITH {IOLOG} SELECT CASE WHEN latency_us >= 1000000 THEN 10 ELSE least(latency_us // 1000, 10) END AS ms, count(*) AS n FROM iolog GROUP BY ALL")
def lat_ms_histogram(spark, sf_dir):
    return metrics.histogram(adapters.iolog(spark, sf_dir), 1000, 10).withColumnRenamed("slot", "ms")


@register(f"WITH {IOLOG} SELECT lreq, count(*) AS n FROM iolog GROUP BY ALL")
def traffic_by_class(spark, sf_dir):
    return metrics.traffic(adapters.iolog(spark, sf_dir))


@register(f"WITH {IOLOG} SELECT type_ftl, count(*) FILTER (WHERE lreq = 'view') AS n_view, count(*) FILTER (WHERE lreq = 'click') AS n_click, count(*) FILTER (WHERE lreq = 'purchase') AS n_purchase FROM iolog GROUP BY ALL")
def traffic_matrix(spark, sf_dir):
    return metrics.traffic_matrix(adapters.iolog(spark, sf_dir), ["view", "click", "purchase"])


@register(f"""WITH {OPLOG} SELECT count(*) FILTER (WHERE op = 'SET') AS writes, count(*) FILTER (WHERE op = 'GET') AS reads,
round((SELECT count(*) FROM oplog WHERE vlen > 4096) / count(*) FILTER (WHERE op = 'SET'), 6) AS waf, round((SELECT count(*) FROM oplog WHERE vlen <= 4096) / count(*) FILTER (WHERE op = 'GET'), 6) AS raf FROM oplog""")
def waf_raf(spark, sf_dir):
    log = adapters.oplog(spark, sf_dir)
    return metrics.amplification(log, log.select((F.col("vlen") > 4096).alias("write")))


@register(f"""WITH {STATE}, {PROBES}, f AS (SELECT s.seq IS NULL AS miss FROM probes LEFT JOIN state s USING (key))
SELECT count(*) AS n, round(1 - count(*) FILTER (WHERE miss) / count(*), 6) AS success, round(8192 * count(*) / 1024 / 2.5::DOUBLE * (1 - count(*) FILTER (WHERE miss) / count(*)), 4) AS kb_s, round(count(*) / 2.5::DOUBLE, 4) AS iops FROM f""")
def throughput(spark, sf_dir):
    return metrics.throughput(state.get(visible(spark, sf_dir), _probes(spark)), 2.5)


@register(f"WITH {OPLOG} SELECT op, round(avg(vlen), 4) AS avg_vlen, round(avg(CAST(ceil(vlen / 512.0) AS BIGINT)), 4) AS avg_grains FROM oplog GROUP BY op")
def value_length_mean(spark, sf_dir):
    return adapters.oplog(spark, sf_dir).groupBy("op").agg(F.round(F.avg("vlen"), 4).alias("avg_vlen"), F.round(F.avg(K.grains(F.col("vlen"), 512)), 4).alias("avg_grains"))


@register("""WITH s AS (SELECT event_id * 50 AS t, 1 AS d FROM events UNION ALL SELECT event_id * 50 + CAST(floor(value * 10) AS BIGINT) + 1, -1 FROM events),
a AS (SELECT t, sum(d) AS d FROM s GROUP BY t), r AS (SELECT t // 1000 AS bucket, sum(d) OVER (ORDER BY t) AS run FROM a)
SELECT bucket, CAST(max(run) AS BIGINT) AS peak FROM r GROUP BY bucket""")
def in_flight_peak(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    spans = e.select((F.col("event_id") * 50).alias("begin"), (F.col("event_id") * 50 + F.floor(F.col("value") * 10).cast("long") + 1).alias("finish"))
    return metrics.in_flight(spans, 1000)


@register("SELECT o_orderkey AS parent, count(*) FILTER (WHERE l_linestatus IS NOT NULL) = max(x.n) AS done FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY k) x ON x.k = o_orderkey GROUP BY o_orderkey")
def gather_complete(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    want = li.groupBy(F.col("l_orderkey").alias("parent")).agg(F.count("*").alias("expected"))
    parts = li.select(F.col("l_orderkey").alias("parent"), F.col("l_linestatus").isNotNull().alias("ok")).join(want, "parent")
    return metrics.gather(parts.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent")), "parent"))


# --- mapping and space ------------------------------------------------------------------------------------------


@register(f"WITH {WRITES} SELECT lpa, max(ppa) AS ppa FROM writes GROUP BY lpa")
def page_mapping(spark, sf_dir):
    return mapping.current(adapters.page_writes(spark, sf_dir))


@register(f"WITH {WRITES}, p AS (SELECT i AS lpa FROM range(0, 4000, 7) t(i)), m AS (SELECT lpa, max(ppa) AS ppa FROM writes GROUP BY lpa) SELECT p.lpa, m.ppa, CASE WHEN m.ppa IS NULL THEN 'NOTFOUND' ELSE 'OK' END AS status FROM p LEFT JOIN m USING (lpa)")
def page_lookup(spark, sf_dir):
    return mapping.lookup(mapping.current(adapters.page_writes(spark, sf_dir)), spark.range(0, 4000, 7).withColumnRenamed("id", "lpa"))


@register(f"WITH {WRITES}, x AS (SELECT ppa, lag(ppa) OVER (PARTITION BY lpa ORDER BY ppa) AS old_ppa FROM writes) SELECT * FROM x WHERE old_ppa IS NOT NULL")
def page_invalidate(spark, sf_dir):
    return mapping.invalidated(adapters.page_writes(spark, sf_dir)).select("ppa", "old_ppa")


@register(f"WITH {WRITES} SELECT ppa, lpa FROM writes WHERE ppa % 101 = 0")
def oob_reverse(spark, sf_dir):
    w = adapters.page_writes(spark, sf_dir)
    return mapping.reverse(w, w.where("ppa % 101 = 0").select("ppa"))


@register(f"WITH {WRITES}, m AS (SELECT lpa, max(ppa) AS ppa FROM writes GROUP BY lpa) SELECT lpa // 256 AS tpage, count(*) AS n, min(lpa) AS first_lpa, max(lpa) AS last_lpa FROM m GROUP BY tpage")
def dftl_two_level(spark, sf_dir):
    return mapping.two_level(mapping.current(adapters.page_writes(spark, sf_dir)), 256)


@register(f"WITH {WRITES} SELECT ppa, ppa % 64 AS unit, ppa // 64 AS page FROM writes")
def page_allocate(spark, sf_dir):
    return mapping.allocate(adapters.page_writes(spark, sf_dir))


@register("SELECT o_orderkey AS lpa, o_orderkey // 16384 AS seg, (o_orderkey % 16384) % 64 AS blk, (o_orderkey % 16384) // 64 AS ofs FROM orders")
def block_map_split(spark, sf_dir):
    return mapping.block_address(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lpa")))


@register("SELECT o_orderkey AS ppa, o_orderkey & 63 AS unit, (o_orderkey >> 6) & 255 AS page, o_orderkey >> 14 AS block FROM orders")
def ppa_decompose(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ppa"), *K.ppa_parts("o_orderkey"))


FOLD_SQL = "xor(xor(xor({0}, {1}), xor({2}, {3})), xor(xor({4}, {5}), xor({6}, {7})))".format(*[f"CAST(concat('0x', substr(sha256(key), {8 * k + 1}, 8)) AS BIGINT)" for k in range(8)])


@register(f"WITH {OPLOG} SELECT DISTINCT key, {FOLD_SQL} AS hash FROM oplog")
def hash_fold_key(spark, sf_dir):
    return adapters.oplog(spark, sf_dir).select("key").distinct().select("key", K.fold_words("key").alias("hash"))


@register(f"WITH {OPLOG}, h AS (SELECT DISTINCT key, {FOLD_SQL} AS hash FROM oplog) SELECT key, CAST(c AS INTEGER) AS c, ((hash + c + c * c) & 4294967295) % 1023 + 1 AS slot FROM h, range(0, 4) t(c)")
def hash_probe_slots(spark, sf_dir):
    return mapping.probes(adapters.oplog(spark, sf_dir).select("key").distinct(), 1024, 4)


@register()
def hash_probe_insert(spark, sf_dir):
    return mapping.insert_probing(adapters.oplog(spark, sf_dir).where("op = 'SET'").select("seq", "key"))


@register()
def hash_collision_cdf(spark, sf_dir):
    from pyspark.sql import Window

    placed = mapping.insert_probing(adapters.oplog(spark, sf_dir).where("op = 'SET'").select("seq", "key"))
    h = placed.groupBy("c").agg(F.count("*").alias("n"))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return h.select("c", "n", F.round(F.sum("n").over(Window.orderBy("c")) / F.sum("n").over(whole), 6).alias("share"))


@register(f"WITH {STATS} SELECT block, pages, invalid, born FROM stats")
def block_invalid_count(spark, sf_dir):
    return gc.block_stats(mapping.validity(adapters.page_writes(spark, sf_dir)))


@register(f"WITH {STATS} SELECT unit, block, invalid FROM victims")
def gc_victim_greedy(spark, sf_dir):
    return gc.greedy(gc.block_stats(mapping.validity(adapters.page_writes(spark, sf_dir))), 8)


@register(f"WITH {STATS} SELECT block % 8 AS unit, arg_min(block, born) AS block FROM stats GROUP BY unit")
def gc_victim_fifo(spark, sf_dir):
    return gc.oldest(gc.block_stats(mapping.validity(adapters.page_writes(spark, sf_dir))), 8)


MOVED = STATS + """,
mixed AS (SELECT unit, block FROM (SELECT block % 8 AS unit, block, row_number() OVER (PARTITION BY block % 8 ORDER BY invalid DESC, block) AS rn FROM stats WHERE invalid < pages) WHERE rn = 1),
moved AS (SELECT v.lpa, v.ppa AS old_ppa, 10000000 + row_number() OVER (ORDER BY v.block, v.ppa) - 1 AS new_ppa FROM valid v JOIN mixed USING (block) WHERE v.valid)"""


def _mixed_victims(valid):
    """The greedy choice among blocks that still hold something."""
    return gc.greedy(gc.block_stats(valid).where("invalid < pages"), 8, live=True)


@register(f"WITH {MOVED} SELECT lpa, old_ppa, new_ppa FROM moved")
def gc_relocate(spark, sf_dir):
    valid = stored(mapping.validity(adapters.page_writes(spark, sf_dir)), "valid")
    return gc.relocate(valid, _mixed_victims(valid), 10_000_000)


@register(f"WITH {MOVED} SELECT v.lpa, coalesce(m.new_ppa, v.ppa) AS ppa FROM valid v LEFT JOIN moved m ON m.old_ppa = v.ppa WHERE v.valid")
def gc_remap(spark, sf_dir):
    valid = stored(mapping.validity(adapters.page_writes(spark, sf_dir)), "valid")
    return gc.remap(valid.where("valid").select("lpa", "ppa"), gc.relocate(valid, _mixed_victims(valid), 10_000_000))


@register(f"WITH {STATS} SELECT count(*) AS pages, count(*) FILTER (WHERE valid) AS valid FROM valid WHERE block NOT IN (SELECT block FROM victims)")
def gc_trim(spark, sf_dir):
    valid = mapping.validity(adapters.page_writes(spark, sf_dir))
    return gc.trim(valid, gc.greedy(gc.block_stats(valid), 8)).agg(F.count("*").alias("pages"), F.count_if("valid").alias("valid"))


@register(f"WITH {STATS} SELECT 100000 - count(*) AS free_pages, max(block) + 1 AS used_blocks FROM writes")
def gc_remaining_pages(spark, sf_dir):
    return adapters.page_writes(spark, sf_dir).agg((F.lit(100000) - F.count("*")).alias("free_pages"), (F.max("block") + 1).alias("used_blocks"))


@register("""WITH b AS (SELECT s_suppkey AS block, s_suppkey % 13 = 0 AS bad FROM supplier), x AS (SELECT block, row_number() OVER (ORDER BY block) AS n FROM b WHERE bad), g AS (SELECT block, row_number() OVER (ORDER BY block DESC) AS n FROM b WHERE NOT bad)
SELECT x.block AS bad_block, g.block AS replacement FROM x LEFT JOIN g USING (n)""")
def badblock_pairs(spark, sf_dir):
    return gc.pair_bad_blocks(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("block"), (F.col("s_suppkey") % 13 == 0).alias("bad")))


@register("""WITH a AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS lba FROM lineitem), i AS (SELECT file, lba, lba - row_number() OVER (PARTITION BY file ORDER BY lba) AS g FROM a),
r AS (SELECT file, min(lba) AS s, count(*) AS n FROM i GROUP BY file, g)
SELECT file, s + k * 4 AS start, least(4, n - k * 4) AS length FROM (SELECT *, unnest(range(0, (n - 1) // 4 + 1)) AS k FROM r)""")
def extent_list(spark, sf_dir):
    return gc.extents(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("lba")), 4)


# --- merge trees ------------------------------------------------------------------------------------------------


@register(f"WITH {RUNS} SELECT level, run, first_key, last_key, n FROM runs")
def lsm_flush_runs(spark, sf_dir):
    return lsm.flush_runs(adapters.levels(spark, sf_dir))


@register()
def lsm_flush_by_bytes(spark, sf_dir):
    entries = adapters.levels(spark, sf_dir).select(F.col("level").cast("long").alias("shard"), "key", (F.col("key") % 40 + 8).alias("size"))
    return lsm.flush_by_bytes(entries, 1024, 64)


@register(f"WITH {LEVELS} SELECT level, min(key) AS first_key, max(key) AS last_key, count(*) AS n FROM levels GROUP BY level")
def lsm_level_summary(spark, sf_dir):
    return lsm.summary(adapters.levels(spark, sf_dir))


@register(f"WITH {LEVELS} SELECT key, ppa FROM levels WHERE level = 0 UNION ALL SELECT key, ppa FROM levels l WHERE level = 1 AND NOT EXISTS (SELECT 1 FROM levels u WHERE u.level = 0 AND u.key = l.key)")
def lsm_merge(spark, sf_dir):
    both = adapters.levels(spark, sf_dir)
    return lsm.merge(both.where("level = 0").select("key", "ppa"), both.where("level = 1").select("key", "ppa"))


@register(f"WITH {LEVELS} SELECT level, key, ppa FROM levels QUALIFY level > min(level) OVER (PARTITION BY key)")
def lsm_shadowed(spark, sf_dir):
    return lsm.shadowed(adapters.levels(spark, sf_dir))


@register(f"WITH {LEVELS}, n AS (SELECT key, arg_min(ppa, level) AS ppa FROM levels GROUP BY key) SELECT * FROM n WHERE ppa % 7 <> 0")
def lsm_compact(spark, sf_dir):
    return lsm.compact(adapters.levels(spark, sf_dir), F.col("ppa") % 7 == 0)


@register(f"WITH {LEVELS}, n AS (SELECT key, min(level) AS level, arg_min(ppa, level) AS ppa FROM levels GROUP BY key) SELECT p.key, n.level, n.ppa FROM (SELECT i AS key FROM range(0, 2000, 3) t(i)) p LEFT JOIN n USING (key)")
def lsm_point_search(spark, sf_dir):
    return lsm.search(adapters.levels(spark, sf_dir), spark.range(0, 2000, 3).withColumnRenamed("id", "key"))


@register(f"WITH {LEVELS}, n AS (SELECT key, arg_min(ppa, level) AS ppa FROM levels GROUP BY key) SELECT * FROM n WHERE key >= 100 ORDER BY key LIMIT 20")
def lsm_range_merge(spark, sf_dir):
    return scans.range_scan(lsm.compact(adapters.levels(spark, sf_dir), F.lit(False)), 100, 20)


@register(f"WITH {RUNS} SELECT level, run FROM runs WHERE first_key <= 900 AND last_key >= 300")
def lsm_runs_overlapping(spark, sf_dir):
    return lsm.overlapping(lsm.flush_runs(adapters.levels(spark, sf_dir)), 300, 900).select("level", "run")


@register(f"WITH {RUNS} SELECT level, run FROM runs WHERE last_key < 900")
def lsm_runs_before(spark, sf_dir):
    return lsm.disjoint_before(lsm.flush_runs(adapters.levels(spark, sf_dir)), 900).select("level", "run")


@register(f"WITH {RUNS}, b AS (SELECT level, first_key <= lag(last_key) OVER (PARTITION BY level ORDER BY run) AS bad FROM runs) SELECT level, count(*) FILTER (WHERE bad) AS violations FROM b GROUP BY level")
def lsm_runs_ordered(spark, sf_dir):
    return lsm.ordered(lsm.flush_runs(adapters.levels(spark, sf_dir)))


@register(f"WITH {RUNS} SELECT k.key, r.level, r.run FROM (SELECT i AS key FROM range(0, 1500, 11) t(i)) k JOIN runs r ON k.key BETWEEN r.first_key AND r.last_key")
def lsm_run_of_key(spark, sf_dir):
    entries = adapters.levels(spark, sf_dir)
    return lsm.run_of(lsm.flush_runs(entries), spark.range(0, 1500, 11).withColumnRenamed("id", "key"), entries, bucket_width(entries, "key"))


@register(f"""WITH {LEVELS}, s AS (SELECT level, count(*) AS n FROM levels GROUP BY level), b AS (SELECT level, n, CAST(ceil(n * (ln(0.01) / ln(1 / pow(2, ln(2))))) AS BIGINT) AS bits FROM s)
SELECT level, n, bits, CAST(round(ln(2) * bits / n) AS BIGINT) AS k FROM b""")
def bloom_size(spark, sf_dir):
    s = lsm.summary(adapters.levels(spark, sf_dir)).select("level", "n", K.bloom_bits(F.col("n"), 0.01).alias("bits"))
    return s.select("level", "n", "bits", K.bloom_hashes(F.col("bits"), F.col("n")).alias("k"))


@register()
def bloom_probe(spark, sf_dir):
    entries = adapters.levels(spark, sf_dir).select("level", K.encode_key("key").alias("key"))
    probes = spark.range(0, 2000, 3).select(K.encode_key("id").alias("key"))
    return bloom.may_contain(bloom.build(entries, 1 << 14, 7), probes, 1 << 14, 7)


# --- lookups over whole tables: every key is searched, and the probes are as many again, some missing ----------

ALL_PARTS = """k AS (SELECT DISTINCT 3 * p_partkey AS key FROM part), s AS (SELECT DISTINCT 2 * p_partkey AS start FROM part),
ranked AS (SELECT key, row_number() OVER (ORDER BY key) AS p FROM k)"""
ALL_PROBES = """probes AS (SELECT 'user' || lpad(CAST(i AS VARCHAR), 12, '0') AS key, i AS id FROM (SELECT user_id AS i FROM events UNION SELECT 3 * user_id + 1 FROM events))"""
ALL_PAGES = "p AS (SELECT l_partkey AS lpa FROM lineitem UNION SELECT 3 * l_partkey + 1 FROM lineitem)"
ALL_KEYS = "p AS (SELECT o_custkey AS key FROM orders UNION SELECT 3 * o_custkey + 1 FROM orders)"


def _with_others(keys, name):
    """Distinct keys of one column and, for each, one that may not exist."""
    return keys.select(F.explode(F.array(F.col(name).cast("long"), 3 * F.col(name).cast("long") + 1)).alias(name)).distinct()


def _all_parts(spark, sf_dir, name):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("n")).distinct()
    return part.select((3 * F.col("n")).alias("key")), part.select((2 * F.col("n")).alias(name))


def _all_probes(spark, sf_dir):
    return _with_others(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")), "id")


def _all_keys(spark, sf_dir):
    return _with_others(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


@register(f"""WITH {ALL_PARTS}, f AS (SELECT s.start, r.p FROM s ASOF JOIN ranked r ON s.start <= r.key)
SELECT f.start, CAST(i + 1 AS INTEGER) AS place, r.key FROM f CROSS JOIN range(0, 10) t(i) JOIN ranked r ON r.p = f.p + i""")
def kv_range_batch_all(spark, sf_dir):
    keys, starts = _all_parts(spark, sf_dir, "start")
    return scans.range_batch(keys, starts, 10, bucket_width(keys, "key"))


@register(f"""WITH {ALL_PARTS}, a AS (SELECT s.start, r.key FROM s ASOF LEFT JOIN ranked r ON s.start >= r.key), b AS (SELECT s.start, r.key FROM s ASOF LEFT JOIN ranked r ON s.start <= r.key)
SELECT a.start AS probe, a.key AS floor, b.key AS lower FROM a JOIN b USING (start)""")
def kv_key_bounds_all(spark, sf_dir):
    keys, probes = _all_parts(spark, sf_dir, "probe")
    return scans.bounds(keys, probes, bucket_width(keys, "key"))


@register(f"WITH {STATE}, {ALL_PROBES} SELECT p.key, s.val, CASE WHEN s.seq IS NULL THEN 'NOTFOUND' ELSE 'OK' END AS status FROM probes p LEFT JOIN state s USING (key)")
def kv_point_get_all(spark, sf_dir):
    return state.get(visible(spark, sf_dir), _all_probes(spark, sf_dir).select(K.encode_key(F.col("id")).alias("key")))


@register(f"WITH {STATE}, {ALL_PROBES} SELECT p.key FROM probes p ANTI JOIN state s USING (key)")
def kv_get_notfound_all(spark, sf_dir):
    return kv_point_get_all(spark, sf_dir).where("status = 'NOTFOUND'").select("key")


@register(f"WITH {STATE}, {ALL_PROBES} SELECT id // 5 AS req, count(*) AS n_keys, count(seq) AS n_found, round(sum(val), 4) AS sum_val FROM probes LEFT JOIN state USING (key) GROUP BY req")
def kv_multi_get_all(spark, sf_dir):
    ids = _all_probes(spark, sf_dir).groupBy(F.floor(F.col("id") / 5).alias("req")).agg(F.collect_list(K.encode_key(F.col("id"))).alias("keys"))
    return state.multi_get(visible(spark, sf_dir), ids)


@register(f"""WITH {STATE}, {ALL_PROBES}, f AS (SELECT s.seq IS NULL AS miss FROM probes LEFT JOIN state s USING (key))
SELECT count(*) AS n, round(1 - count(*) FILTER (WHERE miss) / count(*), 6) AS success, round(8192 * count(*) / 1024 / 2.5::DOUBLE * (1 - count(*) FILTER (WHERE miss) / count(*)), 4) AS kb_s, round(count(*) / 2.5::DOUBLE, 4) AS iops FROM f""")
def throughput_all(spark, sf_dir):
    return metrics.throughput(kv_point_get_all(spark, sf_dir), 2.5)


@register(f"WITH {WRITES}, {ALL_PAGES}, m AS (SELECT lpa, max(ppa) AS ppa FROM writes GROUP BY lpa) SELECT p.lpa, m.ppa, CASE WHEN m.ppa IS NULL THEN 'NOTFOUND' ELSE 'OK' END AS status FROM p LEFT JOIN m USING (lpa)")
def page_lookup_all(spark, sf_dir):
    pages = _with_others(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("lpa")), "lpa")
    return mapping.lookup(mapping.current(adapters.page_writes(spark, sf_dir)), pages)


@register(f"WITH {WRITES} SELECT ppa, lpa FROM writes")
def oob_reverse_all(spark, sf_dir):
    w = adapters.page_writes(spark, sf_dir)
    return mapping.reverse(w, w.select("ppa"))


@register(f"WITH {LEVELS}, {ALL_KEYS}, n AS (SELECT key, min(level) AS level, arg_min(ppa, level) AS ppa FROM levels GROUP BY key) SELECT p.key, n.level, n.ppa FROM p LEFT JOIN n USING (key)")
def lsm_point_search_all(spark, sf_dir):
    return lsm.search(adapters.levels(spark, sf_dir), _all_keys(spark, sf_dir))


@register(f"WITH {RUNS}, {ALL_KEYS} SELECT p.key, r.level, r.run FROM p JOIN runs r ON p.key BETWEEN r.first_key AND r.last_key")
def lsm_run_of_key_all(spark, sf_dir):
    entries = adapters.levels(spark, sf_dir)
    return lsm.run_of(lsm.flush_runs(entries), _all_keys(spark, sf_dir), entries, bucket_width(entries, "key"))


@register()
def bloom_probe_all(spark, sf_dir):
    """The filters' bits follow the number of keys: about 10 bits a key, 1 << 14 at least."""
    entries = adapters.levels(spark, sf_dir).select("level", K.encode_key("key").alias("key"))
    bits = 1 << max(14, (10 * table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey")).first()[0]).bit_length())
    return bloom.may_contain(bloom.build(entries, bits, 7), _all_keys(spark, sf_dir).select(K.encode_key("key").alias("key")), bits, 7)


# --- caches and packing -----------------------------------------------------------------------------------------


@register(f"WITH {OPLOG} SELECT seq // 256 AS batch, count(*) AS n, count(DISTINCT key) AS keys FROM oplog WHERE op = 'SET' GROUP BY batch")
def write_buffer_batches(spark, sf_dir):
    return cache.write_batches(adapters.oplog(spark, sf_dir))


@register(f"""WITH {OPLOG}, h AS (SELECT op, coalesce(max(CASE WHEN op = 'SET' THEN 1 ELSE 0 END) OVER (PARTITION BY key, seq // 256 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hit FROM oplog)
SELECT op, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM h GROUP BY op""")
def write_buffer_hits(spark, sf_dir):
    return cache.buffer_hits(adapters.oplog(spark, sf_dir))


@register("""WITH r AS (SELECT event_id % 4 AS unit, event_id AS seq, user_id // 32 AS page FROM events), h AS (SELECT unit, page = lag(page) OVER (PARTITION BY unit ORDER BY seq) AS hit FROM r)
SELECT unit, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM h GROUP BY unit""")
def last_page_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return cache.last_page_hits(e.select((F.col("event_id") % 4).alias("unit"), F.col("event_id").alias("seq"), F.floor(F.col("user_id") / 32).alias("page")))


LRU = """WITH a AS (SELECT user_id % 4 AS cache, event_id AS seq, user_id // 4 AS page FROM events),
p AS (SELECT *, lag(seq) OVER (PARTITION BY cache, page ORDER BY seq) AS prev FROM a),
d AS (SELECT p.cache, p.seq, p.prev, (SELECT count(DISTINCT b.page) FROM a b WHERE b.cache = p.cache AND b.seq > p.prev AND b.seq < p.seq) AS between_pages FROM p)
SELECT cache, count(*) AS n, count(*) FILTER (WHERE prev IS NOT NULL AND between_pages < 16) AS hits FROM d GROUP BY cache"""


@register(LRU)
def lru_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.select((F.col("user_id") % 4).alias("cache"), F.col("event_id").alias("seq"), F.floor(F.col("user_id") / 4).alias("page"), (F.col("event_type") == "purchase").alias("dirty"))
    return cache.lru(a, 16).select("cache", "n", "hits")


@register()
def lru_evictions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.select((F.col("user_id") % 4).alias("cache"), F.col("event_id").alias("seq"), F.floor(F.col("user_id") / 32).alias("page"), (F.col("event_type") == "purchase").alias("dirty"))
    return cache.lru(a, 2)


@register("SELECT user_id // 32 AS page, count(*) AS waiters FROM events GROUP BY page")
def miss_sharing(spark, sf_dir):
    return cache.miss_groups(table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 32).cast("long").alias("page")))


@register()
def pack_pages(spark, sf_dir):
    log = adapters.oplog(spark, sf_dir).where("op = 'SET'")
    return packing.pack(log.select(F.floor(F.col("seq") / 256).cast("long").alias("batch"), "seq", K.grains(F.col("vlen"), 512).alias("size")))


# --- text -------------------------------------------------------------------------------------------------------

COUNT = "len(list_filter(range(1, length(text) - {n} + 2), lambda i: substr(text, i, {n}) = '{p}'))"


@register(f"SELECT doc_id, {COUNT.format(n=2, p='aa')} AS n_0, {COUNT.format(n=3, p='the')} AS n_1, {COUNT.format(n=6, p='zq(x.*')} AS n_2 FROM documents WHERE doc_id IS NOT NULL")
def substring_count(spark, sf_dir):
    return textscan.count(table(spark, sf_dir, "documents"), ["aa", "the", "zq(x.*"])


@register("""SELECT doc_id, CAST(coalesce(list_sum([len(list_filter(range(1, length(substr(text, k * 1024 + 1, 1024)) - 1), lambda i: substr(substr(text, k * 1024 + 1, 1024), i, 3) = 'the')) for k in range(0, (length(text) - 1) // 1024 + 1)]), 0) AS BIGINT) AS n FROM documents""")
def substring_count_extents(spark, sf_dir):
    return textscan.count_in_extents(table(spark, sf_dir, "documents"), "the", 1024)


# --- streaming --------------------------------------------------------------------------------------------------


@register(f"WITH {OPLOG} SELECT date_trunc('day', ts) AS day, op, count(*) AS n, round(sum(val), 2) AS total FROM oplog GROUP BY ALL")
def stream_daily_traffic(spark, sf_dir):
    from ..streaming.requests import daily_traffic

    return daily_traffic(spark, sf_dir)


@register(f"WITH {STATE} SELECT key, seq, val FROM state")
def stream_latest_state(spark, sf_dir):
    from ..streaming.requests import latest_state

    return latest_state(spark, sf_dir)


from . import extended  # noqa: E402, F401  registers its queries here
