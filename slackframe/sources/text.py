"""Text sources: edge lists, adjacency lists, sparse examples, meta and walltime files, program options."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackframe.operators.order import numbered

SPACES = r"\s+"


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines `src dst`; lines that begin with # and blank lines are skipped, any other line is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line != '' and not startswith(line, '#')")
    parts = F.split("line", SPACES)
    node = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)).try_cast("long"), F.raise_error(F.concat(F.lit("not an edge: "), "line")).cast("long"))
    return lines.select(node(1).alias("src"), node(2).alias("dst"))


def edge_list_header(spark: SparkSession, path: str) -> DataFrame:
    """Nodes and edges as the comment `# Nodes: N Edges: E` has them."""
    lines = spark.read.text(path).where(F.col("value").rlike("^# *Nodes:"))
    pick = lambda name: F.regexp_extract("value", name + r":\s*(\d+)", 1).try_cast("long")
    return lines.select(pick("Nodes").alias("nodes"), pick("Edges").alias("edges"))


def adjacency_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines `src degree target ...` as edges; only the first `degree` targets count, blank lines are skipped."""
    parts = F.split(F.trim("value"), SPACES)
    lines = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    targets = F.slice("p", 3, F.greatest(F.get("p", F.lit(1)).cast("int"), F.lit(0)))
    return lines.where(F.size("p") > 2).select(F.get("p", F.lit(0)).cast("long").alias("src"), F.explode(targets.cast("array<long>")).alias("dst"))


def worker_parts(edges: DataFrame, nodes: int, workers: int) -> DataFrame:
    """Edges with the worker in whose contiguous part of the node numbers (from 0) the source lies."""
    div, rest = divmod(nodes, workers)
    large = rest * (div + 1)  # nodes of the parts that have one more
    worker = F.when(F.col("src") < large, F.floor(F.col("src") / (div + 1))).otherwise(rest + F.floor((F.col("src") - large) / max(div, 1)))
    return edges.select(worker.cast("int").alias("worker"), "src", "dst")


def sparse_examples(spark: SparkSession, path: str, features: int, feature_one_based: bool = False, label_one_based: bool = False) -> DataFrame:
    """Lines `label index:value ...` -> (label, x), with absent features 0."""
    parts = F.filter(F.split(F.trim("value"), SPACES), lambda p: p != "")
    pairs = F.transform(F.slice("p", 2, F.size("p")), lambda p: F.struct((F.split(p, ":")[0].cast("int") - int(feature_one_based)).alias("k"), F.split(p, ":")[1].cast("double").alias("v")))
    lines = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    found = F.map_from_entries(pairs)
    rows = lines.select((F.get("p", F.lit(0)).cast("double").cast("int") - int(label_one_based)).alias("label"), found.alias("m"))
    return rows.select("label", F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("int")), F.lit(0.0))).alias("x"))


def meta_file(spark: SparkSession, path: str) -> dict[str, str]:
    """Lines `name: value` as a dictionary; a meta file has a few lines."""
    rows = spark.read.text(path).where(F.col("value").contains(":"))
    name, value = F.trim(F.substring_index("value", ":", 1)), F.expr("trim(substring(value, instr(value, ':') + 1))")
    return {r.name: r.value for r in rows.select(name.alias("name"), value.alias("value")).collect()}


def flag(meta: dict[str, str], name: str) -> bool:
    return meta.get(name) == "1"


def walltimes(spark: SparkSession, path: str) -> DataFrame:
    """Lines `iteration seconds`."""
    return spark.read.schema("iter int, seconds double").option("sep", " ").csv(path)


def relabelled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with dense node numbers in order of the old ones, and the numbering (node, number).

    Nodes are numbered within ranges of their order, and ranges by running counts, so that no task
    holds all nodes.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    numbers = numbered(nodes, ["node"], number=[])
    src = numbers.select(F.col("node").alias("src"), F.col("number").alias("new_src"))
    dst = numbers.select(F.col("node").alias("dst"), F.col("number").alias("new_dst"))
    return edges.join(src, "src").join(dst, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst")), numbers


@dataclass(frozen=True)
class Options:
    """Settings of a run: a config file's, with those of the command line in their place."""

    machines: int = 1
    threads: int = 1
    channels: int = 1
    iterations: int = 10
    update_func: str = "add"
    learning_rate: float = 0.01
    slack: int = 0
    read_my_writes: bool = False
    locality_sharding: bool = True
    thread_cache_threshold: float = 0.1
    random_seed: int = 12345

    @classmethod
    def read(cls, lines, arguments=()) -> Options:
        """Lines `key=value` (# begins a comment), then arguments `--key=value`; unknown keys are errors."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found = {}
        for line in [*lines, *[a.removeprefix("--") for a in arguments]]:
            line = line.split("#")[0].strip()
            if not line:
                continue
            key, _, value = (x.strip() for x in line.partition("="))
            if key not in kinds:
                raise ValueError(f"no such option: {key}")
            found[key] = value in ("1", "true", "yes") if kinds[key] is bool else kinds[key](value)
        out = cls(**found)
        if out.read_my_writes and out.update_func != "add":
            raise ValueError("a client's own writes can be read only where updates add up")
        return out


def hosts(lines) -> list[str]:
    return [x.strip() for x in lines if x.strip()]
