"""Topic modelling by Gibbs sampling over tokens (doc, pos, word, z), one superstep at frozen counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackframe.functions.special import ln_gamma
from slackframe.storage import written


def statistics(tokens: DataFrame, topics: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by (doc, z), (word, z) and z."""
    return (
        tokens.groupBy("doc", "z").agg(F.count("*").alias("n")),
        tokens.groupBy("word", "z").agg(F.count("*").alias("n")),
        tokens.groupBy("z").agg(F.count("*").alias("n")),
    )


def statistics_in_one_pass(tokens: DataFrame) -> DataFrame:
    """The same as one table by grouping sets: level 0 (doc, z), 1 (word, z), 2 z."""
    out = tokens.groupingSets([["doc", "z"], ["word", "z"], ["z"]], "doc", "word", "z").agg(F.count("*").alias("n"), F.grouping("doc").alias("gd"), F.grouping("word").alias("gw"))
    return out.select("doc", "word", "z", F.when(F.col("gd") == 0, 0).when(F.col("gw") == 0, 1).otherwise(2).alias("level"), "n")


def dense(counts: DataFrame, key: str, topics: int) -> DataFrame:
    """(key, z, n) -> (key, c): counts of all topics as an array."""
    return counts.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("z") == k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(topics)]).select(key, F.array(*[F.col(f"c{k}") for k in range(topics)]).alias("c"))


def totals(counts: DataFrame, topics: int) -> Column:
    """Tokens of each topic as an array of literals; topics are few."""
    found = {r.z: r.n for r in counts.groupBy("z").agg(F.sum("n").alias("n")).collect()}
    return F.array(*[F.lit(float(found.get(k, 0))) for k in range(topics)])


def word_given_topic(word_counts: DataFrame, sums: Column, vocabulary: int, lam: float) -> DataFrame:
    """(word, p): (count + lambda) / (sum + vocabulary * lambda) for each topic."""
    return word_counts.select("word", F.zip_with("c", sums, lambda n, s: (n + lam) / (s + vocabulary * lam)).alias("p"))


def posteriors(tokens: DataFrame, topics: int, vocabulary: int, alpha: float, lam: float, prior_only: bool = False) -> DataFrame:
    """Every token with its unnormalised topic weights; its own topic stays in the counts."""
    tokens = written(tokens, "tokens")  # read four times below
    by_doc, by_word, by_topic = statistics(tokens, topics)
    theta = dense(by_doc, "doc", topics).withColumnRenamed("c", "theta")
    rows = tokens.join(theta, "doc")
    if prior_only:
        return rows.select(*tokens.columns, F.transform("theta", lambda n: n + alpha).alias("weights"))
    phi = word_given_topic(dense(by_word, "word", topics), totals(by_topic, topics), vocabulary, lam)
    return rows.join(phi, "word").select(*tokens.columns, F.zip_with("theta", "p", lambda n, p: (n + alpha) * p).alias("weights"))


def drawn(weights: Column, u: Column) -> Column:
    """The least index whose running sum of weights reaches u times their sum."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    walk = F.aggregate(
        weights,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"), F.lit(-1).alias("hit")),
        lambda a, w: F.struct(
            (a["sum"] + w).alias("sum"), (a["k"] + 1).alias("k"), F.when((a["hit"] < 0) & (a["sum"] + w >= u * total), a["k"]).otherwise(a["hit"]).alias("hit")
        ),
    )
    return walk["hit"]


def resample(tokens: DataFrame, u: Column, topics: int, vocabulary: int, alpha: float, lam: float) -> DataFrame:
    """Tokens with z_new, drawn at the counts that stand at the clock's start."""
    return posteriors(tokens, topics, vocabulary, alpha, lam).withColumn("z_new", drawn(F.col("weights"), u)).drop("weights")


def deltas(moved: DataFrame) -> DataFrame:
    """Changes of the counts: (kind, id, z, value), -1 and +1 for each token that changed its topic. Kind 0 doc, 1 word, 2 topic."""
    change = F.explode(F.array(F.struct(F.col("z").alias("z"), F.lit(-1).alias("v")), F.struct(F.col("z_new").alias("z"), F.lit(1).alias("v"))))
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("long").alias("id")) for k, c in enumerate((F.col("doc"), F.col("word"), F.lit(-1)))]))
    rows = moved.where("z != z_new").select("doc", "word", change.alias("c")).select(keys.alias("k"), "c")
    return rows.groupBy("k.kind", "k.id", "c.z").agg(F.sum("c.v").alias("value")).where("value != 0")


def log_likelihood(by_doc: DataFrame, by_word: DataFrame, by_topic: DataFrame, topics: int, vocabulary: int, alpha: float, lam: float) -> DataFrame:
    """Complete log-likelihood of counts (doc, z, n), (word, z, n), (z, n); counts that aren't positive are skipped."""
    g = lambda x: ln_gamma(x if isinstance(x, Column) else F.lit(float(x)))
    d = by_doc.where("n > 0").groupBy("doc").agg(F.sum("n").alias("total"), F.sum(g(F.col("n") + alpha) - g(alpha)).alias("part"))
    doc_term = d.agg(F.coalesce(F.sum(g(topics * alpha) - g(topics * alpha + F.col("total")) + F.col("part")), F.lit(0.0)).alias("v"))
    full = by_topic.agg(F.sum(g(vocabulary * lam + F.col("n"))).alias("s"), F.count("*").alias("k"))
    # a topic without tokens adds lnGamma(V * lambda) - lnGamma(V * lambda) = 0
    topic_term = full.select((F.col("k") * g(vocabulary * lam) - F.col("s")).alias("v"))
    word_term = by_word.where("n > 0").agg(F.coalesce(F.sum(g(F.col("n") + lam) - g(lam)), F.lit(0.0)).alias("v"))
    return doc_term.union(topic_term).union(word_term).agg(F.sum("v").alias("log_likelihood"))


def accesses(tokens: DataFrame, client: Column, thread: Column, vocabulary: int) -> DataFrame:
    """Three reads and three writes for each token: its document, its word, and the sums, kept as word number vocabulary."""
    keys = F.array(F.struct(F.lit(0).cast("long").alias("tab"), F.col("doc").cast("long").alias("rid")), F.struct(F.lit(1).cast("long").alias("tab"), F.col("word").cast("long").alias("rid")), F.struct(F.lit(1).cast("long").alias("tab"), F.lit(vocabulary).cast("long").alias("rid")))
    rows = tokens.select(client.alias("client"), thread.alias("thread"), F.explode(keys).alias("k"))
    return rows.select("client", "thread", F.explode(F.array(F.lit("READ"), F.lit("WRITE"))).alias("op"), "k.tab", "k.rid", F.lit(0).alias("slack"), F.lit(0).alias("vclock"))
