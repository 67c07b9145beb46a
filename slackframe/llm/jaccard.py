"""Similarity join on word n-grams: MinHash banding, then exact verification.

Texts with the same set of n-grams form a class, and one of them stands for it. Signatures are cut
into bands; classes that share a band are candidates. Bands and rows are chosen for a target recall
at the threshold. Candidates fall into groups, connected by shared bands; in each group the full
n-gram sets are compared, in blocks where a group is large, so that no list of pairs is ever made:
a block yields a number of links and a root for each class, and roots are merged as a graph.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackframe.llm.common import alone, binary_values, map_arrow, written
from slackframe.llm.components import components

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 256
#: A block of a large group: classes, and n-grams in all.
BLOCK_CLASSES = 768
BLOCK_GRAMS = 400_000


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows for which enough bands for the recall at the threshold stay within most hashes."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))), 1)
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit < 1 else 1
        if bands * rows > most:
            break
        best = bands, rows
    return best


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_WORDS = _Hashes()


def gram_set(raw: bytes, n: int = GRAM) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; a shorter text with a word is one gram, no word is none."""
    if len(_WORDS) > 400_000:
        _WORDS.clear()
    words = raw.split()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(grams: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The least value of each hash function, x -> scale * x + shift modulo 2^32 on folded hashes."""
    x = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(scale), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (scale[:, None] * x[None, at : at + 2048] + shift[:, None]).min(axis=1), out=out)
    return out


def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    return rng.integers(0, 1 << 31, k, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, np.uint32)


def _sign(n: int, bands: int, rows: int):
    """(id, key, text) -> id, key, class (a 128-bit hash of the gram set, null without words), number of grams, band hashes."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        alone(_WORDS)
        scale, shift = _family(bands * rows)
        names = ["id", "key", "cls", "n", "bands"]
        for batch in batches:
            texts = binary_values(batch.column(2))
            classes, sizes, keys = [], [], np.zeros((len(texts), bands), np.uint64)
            for i, raw in enumerate(texts):
                grams = gram_set(raw, n)
                sizes.append(len(grams))
                classes.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                if len(grams):
                    part = signature(grams, scale, shift).reshape(bands, rows).astype(np.uint64)
                    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
                    for k in range(rows):
                        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + part[:, k]
                    keys[i] = key ^ (key >> np.uint64(32))
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands)
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), lists], names)

    return run


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets are similar: a matrix of all pairs (within left if right is None), from exact counts of shared members."""
    sets = left + (right or [])
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    codes, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(df > 1) - 1
    shared = df[at] > 1
    who, at = who[shared], number[at[shared]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    a, b = len(left), len(right) if right is not None else len(left)
    both = np.zeros((a, b), np.float32)
    width = max(64, 2_000_000 // len(sets))
    for low in range(0, int((df > 1).sum()), width):
        i, j = np.searchsorted(at, [low, low + width])
        x = np.zeros((len(sets), width), np.float32)
        x[who[i:j], at[i:j] - low] = 1
        both += x[:a] @ (x if right is None else x[a:]).T
    na = np.array([len(s) for s in left], np.float64)
    nb = na if right is None else np.array([len(s) for s in right], np.float64)
    alike = both >= threshold * (na[:, None] + nb[None, :] - both) - 1e-6
    if right is None:
        np.fill_diagonal(alike, False)
    return alike


def _roots(alike: np.ndarray) -> np.ndarray:
    """The least index connected to each index, by a symmetric matrix."""
    label = np.arange(len(alike))
    while True:
        near = np.where(alike, label[None, :], len(alike)).min(axis=1, initial=len(alike))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _link(n: int, threshold: float):
    """Rows sorted by (comp, i, j) -> cls, links, root of each class in each pair of blocks."""

    def close(i, j, rows):
        found = {}
        for cls, copies, block, raw in rows:
            found.setdefault(cls, (block, copies, raw))
        first = [(c, w, gram_set(raw, n)) for c, (b, w, raw) in found.items() if b == i]
        second = [(c, w, gram_set(raw, n)) for c, (b, w, raw) in found.items() if b == j] if i != j else None
        names = [c for c, _, _ in first] + [c for c, _, _ in second or []]
        if len(names) < 2 or not first or second == []:
            return []
        alike = compare([s for _, _, s in first], None if second is None else [s for _, _, s in second], threshold)
        w = np.array([w for _, w, _ in first + (second or [])], np.int64)
        a = len(first)
        if second is None:
            links, square = alike.astype(np.int64) @ w, alike
        else:
            links = np.concatenate([alike.astype(np.int64) @ w[a:], alike.T.astype(np.int64) @ w[:a]])
            square = np.zeros((len(names), len(names)), bool)
            square[:a, a:], square[a:, :a] = alike, alike.T
        roots = _roots(square)
        return [{"cls": names[k], "links": int(links[k]), "root": names[roots[k]]} for k in np.flatnonzero(links)]

    def run(batches):
        import pyarrow as pa

        alone(_WORDS)
        schema = pa.schema([("cls", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
        group, rows = None, []
        for batch in batches:
            out = []
            comp, i, j, cls, copies, block = (batch.column(k).to_pylist() for k in range(6))
            for at, raw in enumerate(binary_values(batch.column(6))):
                if group != (comp[at], i[at], j[at]):
                    if rows:
                        out += close(group[1], group[2], rows)
                    group, rows = (comp[at], i[at], j[at]), []
                rows.append((cls[at], copies[at], block[at], raw))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if rows:
            yield pa.RecordBatch.from_pylist(close(group[1], group[2], rows), schema=schema)

    return run


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Every row with its class: id, key (xxhash64 of the text), class_id, first_key, n_links, n_grams.

    n_links is the number of other rows whose n-gram sets have a Jaccard similarity of at least
    threshold (rows of the same set included). class_id is the least id of the connected rows, and
    (class_id, first_key) is the row that stands for them. A text without words links to nothing and
    is a class of its own id; null is such a text. Null ids sort after all others. Repeated rows are
    rows of the same set. Pairs at the threshold are found with probability recall, more similar
    ones with more; every reported link is exact.
    """
    bands, rows = bands_and_rows(threshold, recall)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    signed = written(map_arrow(texts, _sign(n, bands, rows), "id long, key long, cls binary, n long, bands array<long>"), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    classes = written(signed.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), first.alias("rep"), F.any_value("n").alias("n")), "classes")

    member = signed.where("cls is not null").select("cls", F.explode("bands").alias("band"))
    lead = member.groupBy("band").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low != high").select("band", "low")
    near = member.join(lead, "band").where("cls != low").select(F.col("cls").alias("a"), F.col("low").alias("b"))
    loose = components(near).select(F.col("node").alias("cls"), F.col("root").alias("comp"))

    waiting = written(classes.join(loose, "cls"), "candidates")
    parts = waiting.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("grams"))
    parts = parts.select("comp", F.greatest(F.ceil(F.col("c") / BLOCK_CLASSES), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int").alias("g"))
    dealt = (
        waiting.join(parts, "comp")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("g")).cast("int"))
        .hint("merge")  # the candidates grow with the input, so they are never broadcast
        .join(texts, F.col("rep.id").eqNullSafe(F.col("id")) & (F.col("rep.key") == F.col("key")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cls", "copies", "block", "text")
    )
    dealt = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "cls")
    linked = written(map_arrow(dealt, _link(n, threshold), "cls binary, links long, root binary"), "links")

    links = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    tree = components(linked.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    heads = tree.join(classes.select("cls", "rep"), "cls").groupBy("root").agg(F.min("rep").alias("head"))
    known = classes.join(tree.join(heads, "root").select("cls", "head"), "cls", "left").join(links, "cls", "left")
    known = known.select("cls", F.coalesce("head", "rep").alias("head"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("id", "key", "cls", "n").join(known, "cls", "left").select(
        "id", "key",
        F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("head.key")).alias("first_key"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("n").alias("n_grams"),
    )


def report(docs: DataFrame) -> DataFrame:
    return similar(docs).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_grams")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of docs that stands for each class, with its columns; of repeated rows one stays."""
    heads = similar(docs).where(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("first_key")))
    heads = heads.select(F.col("id").alias("__sf_id"), F.col("key").alias("__sf_key")).distinct()
    mine = docs.withColumn("__sf_text", F.xxhash64("text"))
    kept = mine.join(heads.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__sf_id")) & (F.col("__sf_text") == F.col("__sf_key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__sf_text"]).select(*docs.columns)
