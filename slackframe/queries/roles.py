"""The test tables in the roles that the engine's operators need, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slackframe.functions.special import unit
from slackframe.operators.order import numbered

def long_form(df: DataFrame, array: str, digits: int = 6) -> DataFrame:
    """An array of numbers as rows (..., k, v)."""
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.posexplode(array).alias("k", "v")).withColumn("v", F.round("v", digits))


DAY0 = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def updates(spark, sf_dir) -> DataFrame:
    """events as an update log: clock is the day, four clients of two threads, 25 rows of 4 columns."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.datediff("ts", F.lit(DAY0)).alias("clock"),
        (F.col("user_id") % 4).cast("int").alias("client"),
        (F.floor(F.col("user_id") / 4) % 2).cast("int").alias("thread"),
        F.lit(0).cast("long").alias("tab"),
        (F.col("user_id") % 25).alias("rid"),
        (F.col("event_id") % 4).cast("int").alias("cid"),
        (F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value")) / 10).alias("value"),
        F.col("event_id").alias("seq"),
        "ts",
    )


UPDATES = f"""updates AS (SELECT date_diff('day', DATE '{DAY0}', ts::DATE)::INT AS clock, (user_id % 4)::INT AS client,
  ((user_id // 4) % 2)::INT AS thread, 0::BIGINT AS tab, (user_id % 25)::BIGINT AS rid, (event_id % 4)::INT AS cid,
  (CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) / 10 AS value, event_id AS seq, ts FROM events)"""


def requests(spark, sf_dir) -> DataFrame:
    """Reads of the log: every client, clock and row of it, with slacks from 0 to 3 and the local one."""
    u = updates(spark, sf_dir).select("client", "clock", "tab", "rid").distinct()
    slack = F.when(F.col("rid") % 10 == 9, F.lit(20_000_000)).otherwise((F.col("rid") % 4).cast("int"))
    return u.withColumn("slack", slack)


REQUESTS = "requests AS (SELECT DISTINCT client, clock, tab, rid, CASE WHEN rid % 10 = 9 THEN 20000000 ELSE (rid % 4)::INT END AS slack FROM updates)"


def ops(spark, sf_dir) -> DataFrame:
    """events as an access log of two virtual clocks."""
    u = updates(spark, sf_dir)
    op = F.when(F.col("seq") % 7 == 6, "CLOCK").when(F.col("seq") % 3 == 0, "WRITE").otherwise("READ")
    return u.select("client", "thread", "seq", op.alias("op"), "tab", "rid", F.lit(0).alias("slack"), (F.col("clock") % 2).alias("vclock"))


OPS = f"""{UPDATES}, ops AS (SELECT client, thread, seq, CASE WHEN seq % 7 = 6 THEN 'CLOCK' WHEN seq % 3 = 0 THEN 'WRITE' ELSE 'READ' END AS op,
  tab, rid, 0 AS slack, (clock % 2)::INT AS vclock FROM updates)"""


def part_edges(spark, sf_dir) -> DataFrame:
    """Consecutive parts of an order, with repeats."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return e.where("dst is not null")


PART_EDGES = """edges AS (SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER
  (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"""


def supply_edges(spark, sf_dir) -> DataFrame:
    """Customers to suppliers, which lead nowhere."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst")).distinct()


SUPPLY_EDGES = "edges AS (SELECT DISTINCT o_custkey AS src, l_suppkey + 1000000 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def ratings(spark, sf_dir) -> DataFrame:
    """(i, j, x): customers, parts, mean quantity scaled to 1."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    j = o.select("o_orderkey", "o_custkey").join(li.select("l_orderkey", "l_partkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy(F.col("o_custkey").alias("i"), F.col("l_partkey").alias("j")).agg((F.avg("l_quantity") / 50).alias("x"))


RATINGS = "ratings AS (SELECT o_custkey AS i, l_partkey AS j, avg(l_quantity) / 50 AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


def words(spark, sf_dir) -> DataFrame:
    """(doc, pos, token): words of ASCII letters of the documents, in lower case."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("doc"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("pos", "token"))


TOPICS = 5


def vocabulary_size(spark, sf_dir) -> int:
    return words(spark, sf_dir).select("token").distinct().count()


def tokens(spark, sf_dir) -> DataFrame:
    """(doc, pos, word, z): all tokens, words by their rank in frequency, with a first topic each."""
    w = words(spark, sf_dir)
    ranked = numbered(w.groupBy("token").agg(F.count("*").alias("n")), [F.col("n").desc(), "token"], word=[]).select("token", F.col("word").cast("int").alias("word"))
    z = F.floor(unit(F.col("doc"), F.col("pos"), F.col("word")) * TOPICS).cast("int")
    return w.join(ranked, "token").select("doc", "pos", "word", z.alias("z"))


def unit_sql(*parts: str) -> str:
    mixed = "12345::BIGINT"
    for p in parts:
        mixed = f"(({mixed}) * 7919 + ({p})::BIGINT * 104729 + 17) % 1000003"
    return f"(({mixed}) / 1000003.0::DOUBLE)"


TOKENS = f"""spoken AS (SELECT doc_id AS doc, unnest(ts) AS token, unnest(range(0, len(ts))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ts FROM documents)),
ranks AS (SELECT token, (row_number() OVER (ORDER BY n DESC, token) - 1)::INT AS word FROM
  (SELECT token, count(*) AS n FROM spoken GROUP BY token)),
tokens AS (SELECT doc, pos::INT AS pos, word, floor({unit_sql('doc', 'pos', 'word')} * {TOPICS})::INT AS z FROM spoken JOIN ranks USING (token))"""

FEATURES = 64
LABELS = 10


def vectors(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


VECTORS = "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings)"


def weights(spark) -> DataFrame:
    """(label, w): a fixed weight row for each label."""
    values = F.transform(F.sequence(F.lit(0), F.lit(FEATURES - 1)), lambda k: ((F.col("id") * 13 + k * 7) % 17 - 8) / 100)
    return spark.range(LABELS).select(F.col("id").cast("int").alias("label"), values.alias("w"))


WEIGHTS = f"weights AS (SELECT l::INT AS label, [((l * 13 + k * 7) % 17 - 8) / 100 FOR k IN range(0, {FEATURES})] AS w FROM range({LABELS}) t(l))"
