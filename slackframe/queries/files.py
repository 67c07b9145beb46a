"""Queries of sources and sinks: test tables written in a format and read back, with the SQL of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slackframe.operators.log import coalesce_updates
from slackframe.queries.roles import FEATURES, PART_EDGES, RATINGS, TOKENS, UPDATES, VECTORS, long_form, part_edges, ratings, table, tokens, updates, vectors, vocabulary_size
from slackframe.sources import binary, text
from slackframe.storage import fresh_path, written
from slackframe.streaming import clock

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


@query("sc01", f"WITH {RATINGS} SELECT (i % 3)::INT AS worker, i::INT AS i, j::INT AS j, round(x::FLOAT::DOUBLE, 6) AS val FROM ratings")
def sc01(spark, sf):
    x, folder = written(ratings(spark, sf), "rated"), fresh_path(spark, "ratings")
    n, m = x.agg(*[F.coalesce(F.max(c) + 1, F.lit(0)) for c in ("i", "j")]).first()
    binary.save_ratings(x.select((F.col("i") % 3).alias("part"), "i", "j", F.col("x").alias("val")), folder, n, m)
    return binary.ratings(spark, folder).select("worker", "i", "j", F.round(F.col("val").cast("double"), 6).alias("val"))


@query("sc02", f"WITH {TOKENS} SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY pos) - 1)::INT AS pos, word FROM tokens")
def sc02(spark, sf):
    t, folder = tokens(spark, sf), fresh_path(spark, "corpus")
    docs = table(spark, sf, "documents").count()
    binary.save_corpus(t.select(F.floor(F.col("doc") / 300).alias("part"), "doc", "pos", "word"), folder, docs, vocabulary_size(spark, sf))
    return binary.corpus(spark, folder).select("doc", "pos", "word")


@query("sc03", f"WITH {PART_EDGES} SELECT src::INT AS src, dst::INT AS dst FROM edges")
def sc03(spark, sf):
    e, folder = part_edges(spark, sf), fresh_path(spark, "graph")
    binary.save_graph(e.select((F.col("src") % 4).alias("part"), "src", "dst"), folder)
    return binary.graph(spark, folder)


@query("sc04", f"WITH {PART_EDGES} SELECT src, dst FROM edges")
def sc04(spark, sf):
    folder = fresh_path(spark, "edges")
    comment = spark.range(1).select(F.lit("# Nodes: 1 Edges: 2").alias("value"))
    comment.union(part_edges(spark, sf).select(F.concat_ws("\t", "src", "dst"))).write.text(folder)
    return text.edge_list(spark, folder)


@query("sc04_part", f"""WITH {PART_EDGES}, g AS (SELECT greatest(max(src), max(dst)) + 1 AS n FROM edges),
  w AS (SELECT w::INT AS worker, (n // 4) * w + least(w, n % 4) AS low, n // 4 + (w < n % 4)::INT AS size FROM g, range(4) t(w))
  SELECT worker, src, dst FROM edges JOIN w ON src BETWEEN low AND low + size - 1""")
def sc04_part(spark, sf):
    e = part_edges(spark, sf)
    return text.worker_parts(e, e.agg(F.greatest(F.max("src"), F.max("dst"))).first()[0] + 1, 4)


@query("sc05", f"WITH {PART_EDGES} SELECT DISTINCT src, dst FROM edges")
def sc05(spark, sf):
    folder = fresh_path(spark, "adjacency")
    lists = part_edges(spark, sf).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("to"))
    lists.select(F.concat_ws(" ", "src", F.size("to"), F.array_join("to", " "))).write.text(folder)
    return text.adjacency_list(spark, folder)


@query("sc06", f"WITH {VECTORS} SELECT label, unnest(range(0, 64))::INT AS k, unnest(list_transform(x, lambda v: round(v, 6))) AS v FROM vectors")
def sc06(spark, sf):
    folder = fresh_path(spark, "examples")
    binary.save_examples(vectors(spark, sf).select((F.col("id") % 3).alias("part"), "id", "label", "x"), folder, FEATURES)
    return long_form(binary.examples(spark, folder, FEATURES).select("label", F.col("x").cast("array<double>").alias("x")), "x")


@query("sc07", f"""WITH {VECTORS}, o AS (SELECT *, row_number() OVER (PARTITION BY id % 3 ORDER BY id) AS nth FROM vectors)
  SELECT label, unnest(range(0, 64))::INT AS k, unnest(list_transform(x, lambda v: round(v, 6))) AS v FROM o WHERE nth <= 40""")
def sc07(spark, sf):
    """A copy of the first 40 examples of each file."""
    whole, some = fresh_path(spark, "examples"), fresh_path(spark, "subset")
    binary.save_examples(vectors(spark, sf).select((F.col("id") % 3).alias("part"), "id", "label", "x"), whole, FEATURES)
    binary.copy_examples(spark, whole, some, FEATURES, 40)
    return long_form(binary.examples(spark, some, FEATURES).select("label", F.col("x").cast("array<double>").alias("x")), "x")


@query("sc11", "SELECT 'machines' AS name, '2' AS value UNION ALL SELECT 'slack', '3' UNION ALL SELECT 'update_func', 'adagrad' UNION ALL SELECT 'hosts', 'a b'")
def sc11(spark, sf):
    """Settings from a config file and the command line, and the hosts of a host file."""
    folder = fresh_path(spark, "config")
    spark.createDataFrame([("machines = 2",), ("# a comment",), ("slack=1",)], "value string").coalesce(1).write.text(folder)
    o = text.Options.read([r.value for r in spark.read.text(folder).collect()], ["--slack=3", "--update_func=adagrad"])
    rows = [("machines", str(o.machines)), ("slack", str(o.slack)), ("update_func", o.update_func), ("hosts", " ".join(text.hosts(["a", "", " b "])))]
    return spark.createDataFrame(rows, "name string, value string")


@query("sc08", f"WITH {VECTORS} SELECT label, unnest(range(0, 64))::INT AS k, unnest(list_transform(x, lambda v: CASE WHEN v > 0 THEN round(v, 6) ELSE 0 END)) AS v FROM vectors")
def sc08(spark, sf):
    folder = fresh_path(spark, "sparse")
    v = vectors(spark, sf)
    pairs = F.filter(F.transform("x", lambda v, i: F.when(v > 0, F.concat_ws(":", i + 1, F.round(v, 6).cast("decimal(12,6)")))), lambda p: p.isNotNull())
    v.select(F.concat_ws(" ", "label", F.array_join(pairs, " "))).write.text(folder)
    return long_form(text.sparse_examples(spark, folder, FEATURES, feature_one_based=True), "x")


@query("sc10", "SELECT 'feature_dim' AS name, '64' AS value UNION ALL SELECT 'num_labels', '10' UNION ALL SELECT 'format', 'bin: x'")
def sc10(spark, sf):
    folder = fresh_path(spark, "meta")
    spark.createDataFrame([("feature_dim: 64",), ("num_labels: 10",), ("format: bin: x",)], "value string").write.text(folder)
    return spark.createDataFrame(sorted(text.meta_file(spark, folder).items()), "name string, value string")


@query("sc12", f"WITH {UPDATES} SELECT rid, round(sum(value), 6) AS value FROM updates WHERE clock <= 5 GROUP BY rid")
def sc12(spark, sf):
    folder = fresh_path(spark, "snapshot")
    for c in (2, 5):
        rows = updates(spark, sf).where(F.col("clock") <= c).groupBy("tab", "rid").agg(F.array(F.sum("value")).alias("vec"))
        binary.save_snapshot(rows.withColumn("clock", F.lit(c)).withColumn("shard", (F.col("rid") % 2).cast("int")), folder)
    got = binary.load_snapshot(spark, folder, 5)
    return got.select("rid", F.round(F.col("vec")[0], 6).alias("value"))


@query("sc12_binary", f"WITH {UPDATES} SELECT (rid % 2)::INT AS shard, (rid % 3)::INT AS channel, tab, rid, round(sum(value)::FLOAT::DOUBLE, 3) AS value FROM updates GROUP BY ALL")
def sc12_binary(spark, sf):
    """A snapshot in the packed binary layout, written and read back."""
    folder = fresh_path(spark, "snapshot")
    rows = updates(spark, sf).groupBy("tab", "rid").agg(F.array(F.sum("value")).alias("vec"))
    binary.save_snapshots(rows.withColumn("part", (F.col("rid") % 2 * 1000 + F.col("rid") % 3).cast("int")), folder, 7, 1)
    got = binary.snapshots(spark, folder, 1).where("clock = 7")
    return got.select("shard", "channel", "tab", "rid", F.round(F.col("vec")[0].cast("double"), 3).alias("value"))


@query("sc13", f"WITH {UPDATES} SELECT clock AS iter, count(*)::DOUBLE AS seconds FROM updates GROUP BY clock")
def sc13(spark, sf):
    folder = fresh_path(spark, "walltime")
    updates(spark, sf).groupBy("clock").agg(F.count("*").alias("n")).select(F.concat_ws(" ", "clock", "n")).write.text(folder)
    return text.walltimes(spark, folder)


_NUMBERED = f"""{PART_EDGES}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), num AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS k FROM nodes)"""


@query("sc16", f"WITH {_NUMBERED} SELECT a.k AS src, b.k AS dst FROM edges JOIN num a ON a.node = src JOIN num b ON b.node = dst")
def sc16(spark, sf):
    return text.relabelled(part_edges(spark, sf))[0]


@query("pr07", f"WITH {_NUMBERED} SELECT node, k AS number FROM num")
def pr07(spark, sf):
    return text.relabelled(part_edges(spark, sf))[1]


@query("ds02", f"WITH {RATINGS} SELECT 'ratings/' || (i % 3) AS path, count(*) AS n FROM ratings GROUP BY ALL")
def ds02(spark, sf):
    return ratings(spark, sf).groupBy(F.concat(F.lit("ratings/"), F.col("i") % 3).alias("path")).agg(F.count("*").alias("n"))


@query("ds04", "SELECT doc_id // 300 AS worker, min(doc_id) AS doc_offset, count(*) AS n FROM documents GROUP BY ALL")
def ds04(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy(F.floor(F.col("doc_id") / 300).alias("worker")).agg(F.min("doc_id").alias("doc_offset"), F.count("*").alias("n"))


@query("sc15", f"WITH {UPDATES} SELECT clock, '{{\"clock\":' || clock || ',\"n\":' || count(*) || '}}' AS line FROM updates GROUP BY clock")
def sc15(spark, sf):
    folder = fresh_path(spark, "report")
    rows = updates(spark, sf).groupBy("clock").agg(F.count("*").alias("n"))
    rows.select(F.to_json(F.struct("clock", "n")).alias("value")).write.text(folder)
    lines = spark.read.text(folder)
    return lines.select(F.get_json_object("value", "$.clock").cast("int").alias("clock"), F.col("value").alias("line"))


@query("stream_clocks", f"WITH {UPDATES} SELECT tab, rid, cid, round(sum(value), 6) AS value FROM updates GROUP BY ALL")
def stream_clocks(spark, sf):
    """The update log through a stream, a clock for each micro-batch; the state after the last."""
    source, log, mark = (fresh_path(spark, t) for t in ("stream", "streamed", "mark"))
    u = updates(spark, sf).select("client", "thread", "tab", "rid", "cid", "value")
    u.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).parquet(source)
    clock.close_clocks(stream, log, mark).awaitTermination()
    s = clock.state_at(spark, log, 1 << 30)
    return s.withColumn("value", F.round("value", 6))


@query("ps02_weights", f"WITH {UPDATES} SELECT clock, round(sum(abs(v)), 6) AS mass FROM (SELECT clock, client, tab, rid, cid, sum(value) AS v FROM updates GROUP BY ALL) GROUP BY clock")
def ps02_weights(spark, sf):
    s = coalesce_updates(updates(spark, sf), "clock", "client")
    return s.groupBy("clock").agg(F.round(F.sum(F.abs("value")), 6).alias("mass"))
