"""Removal of repeated multi-line chunks.

Lines with a word are hashed, and a rolling hash over the last two line hashes chooses where chunks
end: at its local minima, so a line put in or taken out moves boundaries near it only, and every
chunk has two lines with a word or more. A chunk whose bytes occur earlier in the corpus is removed;
the first occurrence, by document id and place, stays. Chunks are first matched by a 128-bit hash;
the texts of those that matched are then compared as such.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackframe.llm.common import binary_values, map_arrow, written

#: Lines in the rolling window.
WINDOW = 2
#: Lines with a word that a text needs to have chunks.
LEAST_LINES = 2
#: Parts in which the occurrences of a chunk are told whether they are the first.
SALTS = 8
_BASE = 31


def boundaries(lines: list[bytes], window: int = WINDOW) -> list[int]:
    """Indices of the lines after which a chunk ends; the last line always does. None for a text of fewer than two lines with a word.

    Among the lines with a word, a chunk ends after the line whose rolling hash is less than that of
    the line before and of the line after; never after the first or the last but one, so that every
    chunk has two of them. Lines without a word go with the line before.
    """
    full = [k for k, x in enumerate(lines) if x.split(None, 1)]
    if len(full) < LEAST_LINES:
        return []
    h = np.array([int.from_bytes(hashlib.md5(lines[k]).digest()[:4], "big") for k in full], np.int64)
    rolled = np.zeros(len(h), np.int64)
    for k in range(min(window, len(h))):
        rolled[k:] += (h[: len(h) - k] * _BASE**k) % (1 << 32)
    rolled %= 1 << 32
    low = np.flatnonzero((rolled[1:-2] < rolled[:-3]) & (rolled[1:-2] < rolled[2:-1])) + 1 if len(h) > 3 else []
    return [full[b + 1] - 1 for b in low] + [len(lines) - 1]


def _chunks(window: int):
    """(id, key, text) -> hash, id, key, chunk number, first line (from 1), lines."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        names = ["hash", "id", "key", "chunk", "first", "lines"]
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for id_, key, raw in zip(ids, keys, binary_values(batch.column(2))):
                lines, low = raw.split(b"\n"), 0
                for chunk, end in enumerate(boundaries(lines, window)):
                    for column, value in zip(out, (xxhash.xxh3_128_digest(b"\n".join(lines[low : end + 1])), id_, key, chunk, low + 1, end + 1 - low)):
                        column.append(value)
                    low = end + 1
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)

    return run


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Occurrences to remove: id, key (xxhash64 of the text), first line (from 1), lines.

    A place is (id, key, chunk), null ids last. Identical rows are one place, so repeated rows are
    treated alike and don't remove each other's chunks. The occurrences of a chunk, however many,
    meet its first one in SALTS parts; where two texts share a 128-bit hash they meet by their bytes.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).where("text is not null")
    chunks = written(map_arrow(texts, _chunks(window), "hash binary, id long, key long, chunk int, first int, lines int"), "chunks")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", "chunk")
    twice = chunks.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("hash")
    spots = chunks.join(twice, "hash", "left_semi").groupBy("id", "key").agg(F.collect_set(F.struct("chunk", "first", "lines", "hash")).alias("spots"))
    spots = spots.select(F.col("id").alias("i"), F.col("key").alias("k"), "spots")
    lines = texts.join(spots.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))).select("id", "key", F.split("text", "\n", -1).alias("all"), "spots")
    each = lines.select("id", "key", "all", F.explode("spots").alias("s"))
    seen = written(each.select("id", "key", "s.chunk", "s.first", "s.lines", "s.hash", F.array_join(F.slice("all", F.col("s.first"), F.col("s.lines")), "\n").alias("text")), "spots")
    lead = seen.groupBy("hash", "text").agg(F.min(place).alias("lead"), F.max(place).alias("last"))
    by_hash = lead.groupBy("hash").agg(F.count("*").alias("texts"), F.any_value("lead").alias("lead"), F.any_value("last").alias("last")).where("texts > 1 or lead != last")
    by_hash = written(by_hash, "leads")
    one = by_hash.where("texts = 1").select(F.col("hash").alias("h"), "lead", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    spot = seen.drop("text").withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int"))
    gone = spot.hint("merge").join(one, (F.col("hash") == F.col("h")) & (F.col("salt") == F.col("s"))).where(place != F.col("lead")).select("id", "key", "first", "lines")
    clash = by_hash.where("texts > 1").select("hash")
    if not clash.isEmpty():
        several = seen.join(clash, "hash", "left_semi")
        first = several.groupBy("hash", "text").agg(F.min(place).alias("lead"))
        gone = gone.unionByName(several.join(first, ["hash", "text"]).where(place != F.col("lead")).select("id", "key", "first", "lines"))
    return gone.distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row: id, text without repeated chunks, n_lines, n_removed_lines, n_removed_chunks.

    A null text stays null and has no lines; an empty text has one line. A text that consists of
    repeated chunks becomes empty. Texts of fewer than two lines with a word have no chunks and stay.
    A text of any length is one row of one task. Repeated rows get equal results; of equal chunks
    the one of the least place stays; an empty table gives an empty table. Only the id and the text
    are read, so a table's other columns can't clash.
    """
    gone = repeated_chunks(docs, id_col, text_col, **options)
    gone = gone.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("first", "lines"))).alias("gone"))
    gone = gone.select(F.col("id").alias("i"), F.col("key").alias("k"), "gone")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    rows = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    rows = rows.select("id", "text", "gone", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)).alias("all"))
    past = lambda x: x["first"] + x["lines"]
    kept = F.transform(
        F.sequence(F.lit(0), F.size("gone")),
        lambda i: F.slice(
            "all",
            F.when(i == 0, F.lit(1)).otherwise(past(F.get("gone", i - 1))),
            F.when(i == F.size("gone"), F.size("all") + 1).otherwise(F.get("gone", i)["first"]) - F.when(i == 0, F.lit(1)).otherwise(past(F.get("gone", i - 1))),
        ),
    )
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(kept), "\n"))
    removed = F.aggregate(F.transform("gone", lambda x: x["lines"]), F.lit(0), lambda a, x: a + x)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    return rows.select(
        "id",
        text.alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed_lines"),
        F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed_chunks"),
    )


def report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).withColumnRenamed("id", "doc_id")


#: The same over DuckDB, for distinct ids.
REPORT_SQL = r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
h AS (SELECT *, ('0x' || md5(line)[1:8])::BIGINT AS h FROM l),
f AS (SELECT doc_id, i, (h + coalesce(lag(h) OVER w, 0) * 31 % 4294967296) % 4294967296 AS r,
             row_number() OVER w AS j, count(*) OVER (PARTITION BY doc_id) AS m
      FROM h WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT doc_id, i, m, j BETWEEN 2 AND m - 2 AND r < lag(r) OVER w AND r < lead(r) OVER w AS ends
      FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, m, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
c AS (SELECT l.doc_id, l.i, line, coalesce(m, 0) AS m, coalesce(chunk, 0) AS chunk FROM l ASOF LEFT JOIN g ON l.doc_id = g.doc_id AND l.i >= g.i),
k AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n,
             count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS full_lines FROM c GROUP BY doc_id, chunk),
d AS (SELECT doc_id, chunk FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, chunk) AS nth FROM k WHERE full_lines >= 2) WHERE nth > 1),
o AS (SELECT c.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (d.doc_id IS NULL) AS text, count(*) AS n_lines,
             count(d.doc_id) AS n_removed_lines, count(DISTINCT d.chunk) AS n_removed_chunks
      FROM c LEFT JOIN d ON c.doc_id = d.doc_id AND c.chunk = d.chunk GROUP BY c.doc_id)
SELECT doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text, coalesce(n_lines, 0) AS n_lines,
       coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_removed_chunks, 0) AS n_removed_chunks
FROM documents t LEFT JOIN o USING (doc_id)
"""
