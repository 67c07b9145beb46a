"""Queries of the keyed-state operators and of access analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slackframe.operators import access, log, update_fns
from slackframe.plans import loop
from slackframe.queries.roles import OPS, REQUESTS, UPDATES, ops, requests, updates

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("ps01", f"WITH {UPDATES} SELECT tab, rid, cid, round(sum(value), 6) AS value FROM updates GROUP BY ALL")
def ps01(spark, sf):
    return rounded(log.coalesce_updates(updates(spark, sf)), "value")


@query("ps02", f"WITH {UPDATES} SELECT client, clock, tab, rid, cid, round(sum(value), 6) AS value FROM updates GROUP BY ALL")
def ps02(spark, sf):
    return rounded(log.coalesce_updates(updates(spark, sf), "client", "clock"), "value")


@query("ps03", f"""WITH {UPDATES}, flushed AS (SELECT clock, client, thread, tab, rid, cid, sum(value) AS value FROM updates GROUP BY ALL)
  SELECT clock, client, tab, rid, cid, round(sum(value), 6) AS value FROM flushed GROUP BY ALL""")
def ps03(spark, sf):
    return rounded(log.coalesce_in_two_levels(updates(spark, sf)), "value")


_BOUND = "CASE WHEN q.clock < 1 OR q.slack >= 20000000 THEN -1 ELSE greatest(q.clock - 1 - q.slack, 0) END"
_WANTED = f"""cells AS (SELECT DISTINCT tab, rid, cid FROM updates),
 wanted AS (SELECT q.*, cid, ({_BOUND})::INT AS age FROM requests q JOIN cells USING (tab, rid)),
 s AS (SELECT clock, client, tab, rid, cid, sum(value) AS value FROM updates GROUP BY ALL)"""


@query("ps04", f"""WITH {UPDATES}, {REQUESTS}, {_WANTED}
  SELECT w.client, w.clock, w.slack, w.tab, w.rid, w.cid, w.age, round(coalesce(sum(s.value), 0), 6) AS value
  FROM wanted w LEFT JOIN s ON s.tab = w.tab AND s.rid = w.rid AND s.cid = w.cid AND s.clock <= w.age GROUP BY ALL""")
def ps04(spark, sf):
    out = log.read(updates(spark, sf), requests(spark, sf))
    return rounded(out, "value").select("client", "clock", "slack", "tab", "rid", "cid", "age", "value")


@query("ps05", f"""WITH {UPDATES}, {REQUESTS}, {_WANTED}
  SELECT w.client, w.clock, w.slack, w.tab, w.rid, w.cid, w.age,
    round(coalesce(sum(s.value) FILTER (s.clock <= w.age OR (s.client = w.client AND s.clock <= w.clock)), 0), 6) AS value
  FROM wanted w LEFT JOIN s ON s.tab = w.tab AND s.rid = w.rid AND s.cid = w.cid GROUP BY ALL""")
def ps05(spark, sf):
    out = log.read_my_writes(updates(spark, sf), requests(spark, sf))
    return rounded(out, "value").select("client", "clock", "slack", "tab", "rid", "cid", "age", "value")


@query("ps07", f"WITH {UPDATES} SELECT client, thread, tab, rid, cid, round(sum(value), 6) AS value, count(*) AS n FROM updates GROUP BY ALL")
def ps07(spark, sf):
    return rounded(loop.local_rows(updates(spark, sf)), "value")


@query("ps08", f"""WITH {UPDATES}, c AS (SELECT clock, tab, rid, cid, sum(value) AS value FROM updates GROUP BY ALL),
  k AS (SELECT DISTINCT tab, rid, cid FROM c), t AS (SELECT unnest(range(0, max(clock) + 1))::INT AS clock FROM updates)
  SELECT t.clock, k.tab, k.rid, k.cid, round(sum(c.value), 6) AS value
  FROM k, t, c WHERE c.tab = k.tab AND c.rid = k.rid AND c.cid = k.cid AND c.clock <= t.clock GROUP BY ALL""")
def ps08(spark, sf):
    u = updates(spark, sf)
    return rounded(loop.history(u, u.agg(F.max("clock")).first()[0] + 1), "value")


@query("ps09", f"""WITH {UPDATES}, l AS (SELECT client, thread, max(clock) AS clock FROM updates GROUP BY ALL)
  SELECT min(clock) AS global_clock, max(clock) AS fast_clock FROM l""")
def ps09(spark, sf):
    return log.vector_clock(updates(spark, sf).select(F.struct("client", "thread").alias("worker"), "clock"))


_STAGED = f"""{UPDATES}, f AS (SELECT client, min(clock) AS c0 FROM updates GROUP BY client),
 s AS (SELECT clock, client, tab, rid, cid, clock = c0 AS initial, sum(value) AS v FROM updates JOIN f USING (client) GROUP BY ALL)"""


@query("ps10", f"""WITH {_STAGED}, a AS (SELECT *, CASE WHEN initial THEN 0 ELSE v END AS g FROM s)
  SELECT tab, rid, cid, round(sum(CASE WHEN initial THEN v ELSE 0.25 * v END), 6) AS stepped, round(sum(v), 6) AS added FROM a GROUP BY ALL""")
def ps10(spark, sf):
    u = updates(spark, sf)
    a = update_fns.apply(u, "stepsize", 0.25).withColumnRenamed("value", "stepped")
    return rounded(a.join(update_fns.apply(u, "add").withColumnRenamed("value", "added"), log.CELL), "stepped", "added")


@query("ps11", f"WITH {UPDATES} SELECT tab, rid, cid, round(sum(value), 6) AS value FROM updates GROUP BY ALL")
def ps11(spark, sf):
    return rounded(update_fns.apply(updates(spark, sf), "add"), "value")


@query("ps12", f"WITH {_STAGED} SELECT tab, rid, cid, round(sum(CASE WHEN initial THEN v ELSE 0.5 * v END), 6) AS value FROM s GROUP BY ALL")
def ps12(spark, sf):
    return rounded(update_fns.apply(updates(spark, sf), "stepsize", 0.5), "value")


@query("ps13", f"""WITH {_STAGED}, a AS (SELECT *, CASE WHEN initial THEN 0 ELSE v END AS g FROM s),
  b AS (SELECT *, sum(g * g) OVER (PARTITION BY tab, rid, cid ORDER BY clock, client ROWS UNBOUNDED PRECEDING) AS acc FROM a)
  SELECT tab, rid, cid, round(sum(CASE WHEN initial THEN v ELSE 0.1 * g / sqrt(acc + 1) END), 6) AS value FROM b GROUP BY ALL""")
def ps13(spark, sf):
    return rounded(update_fns.apply(updates(spark, sf), "adagrad", 0.1), "value")


@query("ps14", f"""WITH {_STAGED}, a AS (SELECT *, CASE WHEN initial THEN 0 ELSE v END AS g FROM s),
  b AS (SELECT *, coalesce(sum(g) OVER (PARTITION BY tab, rid, cid, clock ORDER BY client ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bck FROM a),
  c AS (SELECT *, sum(g * g + 2 * g * bck) OVER w AS z FROM b WINDOW w AS (PARTITION BY tab, rid, cid ORDER BY clock, client ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT *, greatest(0, max(z) OVER w) AS m FROM c WINDOW w AS (PARTITION BY tab, rid, cid ORDER BY clock, client ROWS UNBOUNDED PRECEDING)),
  e AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY tab, rid, cid ORDER BY clock, client), 0) AS p FROM d)
  SELECT tab, rid, cid, round(sum(CASE WHEN initial THEN v ELSE 0.1 / sqrt(m + 1) * g + (0.1 / sqrt(m + 1) - 0.1 / sqrt(p + 1)) * bck END), 6) AS value FROM e GROUP BY ALL""")
def ps14(spark, sf):
    return rounded(update_fns.apply(updates(spark, sf), "adarevision", 0.1), "value")


_KEYS = "keys AS (SELECT 0::BIGINT AS tab, r AS rid, c::INT AS cid FROM range(40) a(r), range(4) b(c))"


def _keys(spark):
    return spark.range(160).select(F.lit(0).cast("long").alias("tab"), F.floor(F.col("id") / 4).alias("rid"), (F.col("id") % 4).cast("int").alias("cid"))


@query("ps15", f"""WITH {UPDATES}, {_KEYS}, s AS (SELECT tab, rid, cid, sum(value) AS value FROM updates GROUP BY ALL)
  SELECT tab, rid, cid, round(coalesce(value, 0), 6) AS value FROM keys LEFT JOIN s USING (tab, rid, cid)""")
def ps15(spark, sf):
    return rounded(log.get_or_create(log.coalesce_updates(updates(spark, sf)), _keys(spark)), "value")


@query("ps15_missing", f"WITH {UPDATES}, {_KEYS} SELECT * FROM keys k WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE u.tab = k.tab AND u.rid = k.rid AND u.cid = k.cid)")
def ps15_missing(spark, sf):
    return log.missing_keys(_keys(spark), updates(spark, sf).select(*log.CELL).distinct())


@query("ps16", f"""WITH {UPDATES}, subs AS (SELECT DISTINCT client, tab, rid FROM updates),
  cells AS (SELECT DISTINCT tab, rid, cid FROM updates), t AS (SELECT unnest(range(0, max(clock) + 1))::INT AS clock FROM updates)
  SELECT client, t.clock, tab, rid, cid, ((client - t.clock) % 4 + 4) % 4 AS turn,
    round(coalesce((SELECT sum(value) FROM updates u WHERE u.tab = c.tab AND u.rid = c.rid AND u.cid = c.cid AND u.clock <= t.clock), 0), 6) AS value
  FROM subs JOIN cells c USING (tab, rid), t""")
def ps16(spark, sf):
    u = updates(spark, sf)
    out = log.push_reads(u, u.select("client", "tab", "rid").distinct(), 4)
    return rounded(out, "value").select("client", "clock", "tab", "rid", "cid", "turn", "value")


@query("ps17", f"""WITH {UPDATES}, b AS (SELECT client, clock AS data_age, tab, rid, cid, sum(value) AS value FROM updates GROUP BY ALL)
  SELECT client, tab, rid, cid, max(data_age) AS data_age, round(max_by(value, data_age), 6) AS value FROM b GROUP BY ALL""")
def ps17(spark, sf):
    b = log.coalesce_updates(updates(spark, sf), "client", "clock").withColumnRenamed("clock", "data_age")
    return rounded(log.receive(b), "value")


@query("ps18", f"""WITH {UPDATES}, s AS (SELECT clock, client, tab, rid, (rid % 2)::INT AS server FROM updates GROUP BY ALL),
  k AS (SELECT client, server, count(*) AS n_keys FROM (SELECT DISTINCT client, server, tab, rid FROM s) GROUP BY ALL)
  SELECT clock, client, server, n_keys, count(*) AS n_dirty FROM s JOIN k USING (client, server) GROUP BY ALL""")
def ps18(spark, sf):
    return log.push_updates(updates(spark, sf), 2)


@query("ps19", f"""WITH {UPDATES}, g AS (SELECT min(c) AS gc FROM (SELECT max(clock) AS c FROM updates GROUP BY client))
  SELECT clock, count(*) AS n_updates, clock < any_value(gc) AS freeable FROM updates, g GROUP BY clock""")
def ps19(spark, sf):
    return log.freeable(updates(spark, sf))


@query("ps20", f"WITH {UPDATES} SELECT clock, round(sum(value * value), 6) AS loss FROM updates GROUP BY ALL")
def ps20(spark, sf):
    return rounded(log.progress(updates(spark, sf).withColumn("loss", F.col("value") * F.col("value"))), "loss")


@query("ps21", f"""WITH {UPDATES}, n AS (SELECT count(DISTINCT (client, thread)) AS workers FROM updates)
  SELECT clock, round(sum(value * value), 6) AS loss, round(epoch_us(max(ts)) / 1e6 - (SELECT epoch_us(min(ts)) / 1e6 FROM updates), 3) AS seconds,
  count(DISTINCT (client, thread)) = any_value(workers) AS complete FROM updates, n GROUP BY clock""")
def ps21(spark, sf):
    u = updates(spark, sf).withColumn("loss", F.col("value") * F.col("value"))
    return rounded(rounded(loop.clock_report(u), "loss"), "seconds", digits=3)


@query("ps23", f"""WITH {OPS}, s AS (SELECT client, thread, count(*) FILTER (op = 'READ') AS r, count(*) FILTER (op = 'WRITE') AS w,
    count(DISTINCT (tab, rid)) AS c FROM ops GROUP BY ALL),
  k AS (SELECT client, count(DISTINCT (tab, rid)) AS n FROM ops WHERE op <> 'CLOCK' GROUP BY client)
  SELECT client, format('{{{{"num_threads":{{}},"row_count":{{}},"num_thread_cache":{{}},"num_thread_cache_max":{{}},"total_read":{{}},"total_increment":{{}},"router_stats":{{{{}}}}}}}}',
    count(*), any_value(n), sum(c)::BIGINT, max(c), sum(r)::BIGINT, sum(w)::BIGINT) AS stats FROM s JOIN k USING (client) GROUP BY client""")
def ps23(spark, sf):
    return loop.stats_json(ops(spark, sf))


@query("vi01", f"WITH {OPS} SELECT client, thread, seq, op, tab, rid, slack, vclock FROM ops")
def vi01(spark, sf):
    return ops(spark, sf)


_THREAD = "SELECT client, thread, tab, rid, vclock, bool_or(op = 'READ') AS reads, bool_or(op = 'WRITE') AS writes FROM ops WHERE op <> 'CLOCK' GROUP BY ALL"
_CLIENT = f"""th AS ({_THREAD}), nt AS (SELECT client, tab, rid, count(DISTINCT thread) AS n_threads FROM th GROUP BY ALL),
 cl AS (SELECT client, tab, rid, vclock, bool_or(reads) AS reads, bool_or(writes) AS writes, any_value(n_threads) AS n_threads FROM th JOIN nt USING (client, tab, rid) GROUP BY client, tab, rid, vclock),
 n AS (SELECT client, tab, rid, sum(reads::INT)::BIGINT AS num_read, sum(writes::INT)::BIGINT AS num_write FROM cl GROUP BY ALL)"""


@query("vi02", f"WITH {OPS} {_THREAD}")
def vi02(spark, sf):
    return access.by_thread(ops(spark, sf))


@query("vi03", f"WITH {OPS}, {_CLIENT} SELECT * FROM cl")
def vi03(spark, sf):
    return access.by_client(ops(spark, sf))


@query("vi04", f"WITH {OPS}, {_CLIENT} SELECT * FROM n")
def vi04(spark, sf):
    return access.counts(ops(spark, sf))


_HOME = "(rid % 4 // 2)::INT AS machine, (rid % 2)::INT AS channel"


@query("vi05", f"WITH {OPS} SELECT rid, {_HOME}, count(*) AS n FROM ops GROUP BY ALL")
def vi05(spark, sf):
    machine, channel = access.home(F.col("rid"), 2, 2)
    return ops(spark, sf).groupBy("rid", machine.alias("machine"), channel.alias("channel")).agg(F.count("*").alias("n"))


@query("vi06", f"WITH {OPS} SELECT DISTINCT tab, rid, {_HOME} FROM ops")
def vi06(spark, sf):
    return access.hash_placement(ops(spark, sf).select("tab", "rid").distinct(), 2, 2)


@query("vi07", f"""WITH RECURSIVE {OPS}, {_CLIENT}, f AS (SELECT client, tab, rid, num_read + num_write AS freq, max(num_read + num_write) OVER (PARTITION BY tab, rid) AS top FROM n),
  k AS (SELECT tab, rid, any_value(top) AS freq, list(client ORDER BY client) AS cs, (rid % 8 // 2)::INT AS server, (rid % 2)::INT AS channel FROM f WHERE freq = top GROUP BY tab, rid),
  s AS (SELECT *, row_number() OVER (PARTITION BY server, channel ORDER BY tab, rid) AS nth FROM k),
  p AS (SELECT server, channel, 0::BIGINT AS nth, NULL::BIGINT AS tab, NULL::BIGINT AS rid, NULL::BIGINT AS freq, NULL::INT AS machine, [0, 0, 0, 0]::BIGINT[] AS loads FROM s GROUP BY server, channel UNION ALL
    SELECT server, channel, nth, tab, rid, freq, best, list_transform(loads, lambda l, i: l + CASE WHEN i = best + 1 THEN freq ELSE 0 END)
    FROM (SELECT s.server, s.channel, s.nth, s.tab, s.rid, s.freq, p.loads, (list_min(list_transform(cs, lambda c: p.loads[c + 1] * 100 + c)) % 100)::INT AS best
      FROM p JOIN s ON s.server = p.server AND s.channel = p.channel AND s.nth = p.nth + 1))
  SELECT tab, rid, channel, machine, freq FROM p WHERE nth > 0""")
def vi07(spark, sf):
    return access.locality_placement(ops(spark, sf), 4, 2)


@query("vi07_argmax", f"""WITH {OPS}, {_CLIENT} SELECT tab, rid, max(num_read + num_write) AS freq,
  min_by(client, -(num_read + num_write) * 1000 + client) AS machine FROM n GROUP BY ALL""")
def vi07_argmax(spark, sf):
    return access.most_frequent(ops(spark, sf))


@query("vi08", f"WITH {OPS} SELECT DISTINCT client, tab, rid, {_HOME} FROM ops")
def vi08(spark, sf):
    o = ops(spark, sf)
    return access.find_rows(o.select("client", "tab", "rid").distinct(), access.hash_placement(o.select("tab", "rid").distinct(), 2, 2))


@query("vi09", f"""WITH {OPS}, p AS (SELECT DISTINCT tab, rid, {_HOME} FROM ops)
  SELECT *, (row_number() OVER (PARTITION BY channel ORDER BY tab, rid) - 1)::INT AS cache_id,
  (row_number() OVER (PARTITION BY channel, machine ORDER BY tab, rid) - 1)::INT AS oplog_id FROM p""")
def vi09(spark, sf):
    return access.dense_ids(access.hash_placement(ops(spark, sf).select("tab", "rid").distinct(), 2, 2))


@query("vi10", f"WITH {OPS}, p AS (SELECT DISTINCT tab, rid, {_HOME} FROM ops) SELECT count(*) AS row_count, count(*) FILTER (machine = 1) AS row_count_local FROM p")
def vi10(spark, sf):
    return access.row_counts(access.hash_placement(ops(spark, sf).select("tab", "rid").distinct(), 2, 2), 1)


@query("vi11", f"""WITH {OPS}, a AS (SELECT * FROM ops WHERE op <> 'CLOCK'), k AS (SELECT client, thread, tab, rid, count(*) AS n FROM a GROUP BY ALL),
  t AS (SELECT client, tab, rid, count(DISTINCT thread) AS n_threads FROM a GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY client, thread) AS total FROM k)
  SELECT client, thread, tab, rid, n, n_threads, round(n / total * n_threads, 6) AS score FROM s JOIN t USING (client, tab, rid) WHERE n / total * n_threads >= 0.05""")
def vi11(spark, sf):
    return rounded(access.thread_cached(ops(spark, sf), 0.05), "score")


@query("vi13", f"WITH {OPS} SELECT count(DISTINCT vclock) AS n_vi_clocks, count(DISTINCT vclock) = 1 AS supported FROM ops")
def vi13(spark, sf):
    return access.virtual_clocks(ops(spark, sf))


@query("ds01", f"WITH {UPDATES} SELECT DISTINCT client, thread, client + thread * 4 AS worker FROM updates")
def ds01(spark, sf):
    return updates(spark, sf).select("client", "thread", access.worker_of(F.col("client"), F.col("thread"), 4).alias("worker")).distinct()


@query("ds05", """SELECT w::INT AS worker, (n // 7) * w + least(w, n % 7) AS start, n // 7 + (w < n % 7)::INT AS size FROM (SELECT count(*) AS n FROM documents), range(7) t(w)""")
def ds05(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    start, size = access.balanced_split(F.lit(n), 7, F.col("id"))
    return spark.range(7).select(F.col("id").cast("int").alias("worker"), start.alias("start"), size.alias("size"))


@query("st03", f"""WITH {UPDATES}, f AS (SELECT clock, client, thread, max(epoch_us(ts)) AS t FROM updates GROUP BY ALL)
  SELECT clock, round((max(t) - min(t)) / 1e6, 3) AS straggler FROM f GROUP BY clock""")
def st03(spark, sf):
    return rounded(loop.straggler_time(updates(spark, sf)), "straggler", digits=3)


@query("st04", f"""WITH {OPS}, r AS (SELECT *, row_number() OVER (PARTITION BY client, thread ORDER BY seq) AS nth FROM ops)
  SELECT client, thread, seq, nth::INT AS nth FROM r WHERE (nth - 1) % 100 = 0""")
def st04(spark, sf):
    return loop.sampled(ops(spark, sf), 100)


_STATS = f"""{OPS}, s AS (SELECT client, thread, count(*) FILTER (op = 'READ') AS total_read, count(*) FILTER (op = 'WRITE') AS total_increment,
  count(DISTINCT (tab, rid)) AS num_thread_cache FROM ops GROUP BY ALL)"""


@query("st01", f"""WITH {_STATS} SELECT client, count(*) AS num_threads, sum(total_read)::BIGINT AS total_read, sum(total_increment)::BIGINT AS total_increment,
  sum(num_thread_cache)::BIGINT AS num_thread_cache, max(num_thread_cache) AS num_thread_cache_max FROM s GROUP BY client""")
def st01(spark, sf):
    return loop.client_stats(ops(spark, sf))


@query("st02", f"""WITH {UPDATES}, s AS (SELECT clock, client, tab, rid, (rid % 2)::INT AS server FROM updates GROUP BY ALL),
  m AS (SELECT clock, client, server, count(*) AS n FROM s GROUP BY ALL)
  SELECT server, count(*) AS messages, sum(n)::BIGINT AS rows, (sum(n) * (SELECT count(DISTINCT cid) FROM updates) * 8)::BIGINT AS bytes FROM m GROUP BY server""")
def st02(spark, sf):
    return loop.server_stats(updates(spark, sf), 2)
