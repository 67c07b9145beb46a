"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies, target / source size.
The whole part is taken at once. The fractional rest is a copy probability; two documents meet,
probability mass (measured in words) moves at random from one to the other until one of them is
0 or 1, and the survivor meets the next. A move keeps both the expected copies of each document
and the expected words of the pair, so a source ends within one document of its target. Blocks of
documents are rounded in parallel; each leaves at most one fractional document per source, and
those residuals are rounded again in a reduction tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackframe.llm.common import blocks_for, map_arrow, n_words, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources in code point order (null last) get the weights in turn. Filling by weight up to a cap
    and sharing the excess again has one fixed point, target = min(cap, level * weight); with the
    sources ordered by cap / weight the level follows from running sums. One row per source.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))).cast("int")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1)
    base = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("cap"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    step = base.withColumn("level", (total - before) / rest).withColumn("open", F.col("cap") / F.col("w") >= F.col("level"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy())
    return step.withColumn("at", level).select(
        "source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at") * F.col("w"))).alias("target")
    )


def _unit(*parts) -> float:
    """A keyed uniform number in [0, 1)."""
    import xxhash

    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode()) / 2.0**64


def _meet(a: dict, b: dict, seed: int) -> tuple[list[dict], dict | None]:
    """Move mass between two fractional documents; returns those that became integral, and the other."""
    to_a = min((1 - a["p"]) * a["size"], b["p"] * b["size"])
    to_b = min((1 - b["p"]) * b["size"], a["p"] * a["size"])
    gain = to_a if _unit(seed, a["id"], b["id"], a["nth"], b["nth"]) * (to_a + to_b) < to_b else -to_b
    done, live = [], None
    for x, change in ((a, gain), (b, -gain)):
        x["p"] += change / x["size"]
        if min(x["p"], 1 - x["p"]) * x["size"] < 1e-7 * x["size"] + 1e-9:
            done.append(x | {"copies": x["whole"] + round(x["p"]), "p": 0.0})
        elif live is None:
            live = x
        else:  # a rounding error left both open: the larger share decides
            done.append(x | {"copies": x["whole"] + round(x["p"]), "p": 0.0})
    return done, live


def _rounding(seed: int, last: bool, names: list[str]):
    """Arrow batches sorted by (source, block) -> the same rows with copies, null for a residual."""

    def run(batches):
        import pyarrow as pa

        live, group = None, None
        schema = None

        def flush(rows):
            return pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema=schema)

        for batch in batches:
            schema = batch.schema
            out = []
            for r in batch.to_pylist():
                if group != (r["source"], r["block"]):
                    if live is not None:
                        out.append(_close(live, last, seed))
                    live, group = None, (r["source"], r["block"])
                if r["copies"] is not None:
                    out.append(r)
                elif r["p"] <= 0 or r["size"] <= 0:
                    out.append(r | {"copies": r["whole"]})
                elif live is None:
                    live = r
                else:
                    done, live = _meet(live, r, seed)
                    out += done
            if out:
                yield flush(out)
        if live is not None:
            yield flush([_close(live, last, seed)])

    return run


def _close(r: dict, last: bool, seed: int) -> dict:
    return r | {"copies": r["whole"] + int(_unit(seed, r["id"], r["nth"], "last") < r["p"]), "p": 0.0} if last else r


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 17,
    block_rows: int = 5_000,
    fan_in: int = 64,
) -> DataFrame:
    """Copies of every row so that each source gives about its target number of words.

    Returns id, source, key (xxhash64 of the text), size, source_size, target, copies. One row per
    input row; repeated rows and repeated ids are rounded one by one. Null or empty text has size 0
    and copies 0 or more that take no words; a null source is a source of its own. An empty table
    gives an empty table. Decisions depend on ids, sizes and seed only, not on the partitioning.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("key"), n_words(F.col(text_col)).alias("size"))
    sized = written(sized, "mix-sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = blocks_for(sized.count(), block_rows)
    whole = F.least(F.floor(F.col("ratio") + 1e-12), F.lit(int(most)))
    rows = (
        sized.alias("s")
        .join(goal.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g")))
        .withColumn("ratio", ratio)
        .select("id", "source", "key", "size", "source_size", "target", whole.cast("int").alias("whole"), F.greatest(F.lit(0.0), F.col("ratio") - whole).alias("p"))
        .withColumn("block", F.pmod(F.xxhash64(F.col("id"), F.col("key"), F.lit(seed)), F.lit(blocks)).cast("long"))
        .withColumn("nth", F.lit(0))
        .withColumn("copies", F.lit(None).cast("int"))
    )
    order = ["source", "block", F.col("size").desc(), "id", "key"]  # large first, so that the survivor is small
    same = Window.partitionBy("source", "block", "id", "key").orderBy("size")
    rows, settled = rows.withColumn("nth", F.row_number().over(same).cast("int")), []
    while True:
        last = blocks == 1
        dealt = rows.repartition("source", "block").sortWithinPartitions(*order, "nth")
        level = written(map_arrow(dealt, _rounding(seed, last, rows.columns), rows.schema), "mix-level")
        settled.append(level.where(F.col("copies").isNotNull()))
        if last:
            break
        blocks = -(-blocks // fan_in)
        rows = level.where(F.col("copies").isNull()).withColumn("block", F.pmod(F.col("block"), F.lit(blocks)))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("id", "source", "key", "size", "source_size", "target", "copies")


def taken(docs: DataFrame, **options) -> DataFrame:
    """The mix as a digest: doc_id, size, source_size, target, taken, copies."""
    mixed = mix_sources(docs, **options)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Identical rows are told apart by a running number."""
    made = mix_sources(docs, id_col=id_col, **options)
    mine = docs.withColumn("__sf_text", F.xxhash64("text"))
    mine = mine.withColumn("__sf_nth", F.row_number().over(Window.partitionBy(id_col, "__sf_text").orderBy("source")))
    nth = F.row_number().over(Window.partitionBy("id", "key").orderBy("source", F.col("copies").desc()))
    made = made.withColumn("__sf_n", nth).where(F.col("copies") > 0).select(F.col("id").alias("__sf_id"), F.col("key").alias("__sf_key"), "__sf_n", F.col("copies").alias("__sf_copies"))
    on = F.col(id_col).eqNullSafe(F.col("__sf_id")) & (F.col("__sf_text") == F.col("__sf_key")) & (F.col("__sf_nth") == F.col("__sf_n"))
    return mine.join(made.hint("merge"), on).withColumn("__sf_copy", F.explode(F.sequence(F.lit(1), F.col("__sf_copies")))).select(*docs.columns)
