"""Quality rules judged per document and per host, with DataFrame functions only.

Each document is measured and judged by document rules. Failures are counted per host; a host's
failure rate is shrunk towards the corpus with a beta prior fitted to the hosts by the method of
moments, so a host of few documents isn't condemned by one of them. A host fails if its posterior
rate, less two standard deviations, is over a limit that follows the corpus: the rate whose odds are
three times those of all documents. Documents of a host that fails are dropped with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackframe.llm.common import SPACE, written

RUN = 8


@dataclass(frozen=True)
class Limits:
    """Rules: at least least_words words; at most repeat_percent of the words in repeated windows.

    A host fails if it is sure, by this many standard deviations of its posterior failure rate, to
    fail with odds over host_odds times those of the whole corpus.
    """

    least_words: int = 20
    repeat_percent: int = 30
    host_odds: float = 3.0
    deviations: float = 2.0


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    inside = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\u000b\f\r"))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, SPACE, -1))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for every row.

    n_repeat_words: words in windows of RUN words that occur twice or more in the text, the first
    occurrence included; windows are compared by a 64-bit hash. Windows are sorted by hash within
    their document, neighbours with equal hashes mark their places, and the places are merged.
    """
    host = F.col("source") if host is None else host
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), text.alias("t"), words_of(F.col(text_col)).alias("words"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\u000b\f\r")) != "")
    base = base.select("id", "host", "words", F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"))
    ahead = F.size("words") - RUN + 1
    windows = F.when(ahead > 1, F.transform(F.sequence(F.lit(1), F.greatest(ahead, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, RUN))))
    step = base.select(
        "id", "host", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("w"),
    )
    placed = F.when(F.size(F.array_distinct("w")) < F.size("w"), F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.select("id", "host", "n_symbols", "n_words", "word_chars", "n_dup_lines", placed.alias("s"))
    here, past = (lambda k: F.element_at("s", k)), (lambda k: F.element_at("s", k - 1))
    twice = F.transform(F.sequence(F.lit(2), F.size("s")), lambda k: F.when(here(k)["h"] == past(k)["h"], F.array(past(k)["i"], here(k)["i"])).otherwise(F.array().cast("array<int>")))
    places = F.when(F.col("s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(twice))))
    step = step.select("id", "host", "n_symbols", "n_words", "word_chars", "n_dup_lines", places.alias("p"))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("n"), F.lit(-RUN).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(RUN), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return step.select("id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))


def host_verdicts(judged: DataFrame, limits: Limits) -> DataFrame:
    """(host, base_failed) -> host, host_docs, host_failed, host_rate (shrunk), host_bad. Null hosts get no verdict.

    Where the hosts' rates spread no more than chance alone would have it, nothing tells hosts apart,
    and the prior weighs as much as all documents.
    """
    hosts = judged.where("host is not null").groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    hosts = written(hosts, "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    one = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("mean"), F.var_samp(rate).alias("spread"), F.avg(1 / F.col("host_docs")).alias("thin"), F.sum("host_docs").alias("docs")
    ).first()
    mean, strength = one.mean or 0.0, float(one.docs or 1)
    noise = mean * (1 - mean) * (one.thin or 0.0)  # what chance alone adds to the spread of the rates
    between = (one.spread or 0.0) - noise
    if between > 1e-12 and 0 < mean < 1:
        strength = max(1.0, mean * (1 - mean) / between - 1)
    weight = F.col("host_docs") + F.lit(strength)
    shrunk = (F.col("host_failed") + F.lit(mean * strength)) / weight
    least = shrunk - limits.deviations * F.sqrt(shrunk * (1 - shrunk) / (weight + 1))
    limit = limits.host_odds * mean / (1 + (limits.host_odds - 1) * mean)
    return hosts.select("host", "host_docs", "host_failed", shrunk.alias("host_rate"), ((least > limit) & F.lit(0 < mean < 1)).alias("host_bad"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, limits: Limits = Limits()) -> DataFrame:
    """Measures and verdicts of every row: those of measured(), base_failed, host_rate, host_bad, kept.

    A row is kept if it passes the document rules and its host isn't bad. Null and empty texts have
    no words and fail; a null host is judged by its documents alone (host_rate null). Repeated rows
    are judged one by one and agree; an empty table gives an empty table. A text is measured whole,
    however long, in one row. id, host, text alone are read, so other columns can't clash.
    """
    rows = written(measured(docs, id_col, text_col, host).withColumn("base_failed", failed(limits)), "measures")
    verdicts = host_verdicts(rows.select("host", "base_failed"), limits).select("host", "host_rate", "host_bad")
    out = rows.join(verdicts, "host", "left").withColumn("host_bad", F.coalesce("host_bad", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad"))


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: The same over DuckDB.
REPORT_SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, lead(i, 7) OVER o AS last,
        list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS run
        FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM win WHERE last IS NOT NULL) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, host, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
      length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, sum(base_failed::BIGINT)::DOUBLE AS bad FROM f WHERE host IS NOT NULL GROUP BY host),
s AS (SELECT sum(bad) / sum(n) AS mean, coalesce(var_samp(bad / n), 0) AS spread, avg(1.0 / n) AS thin, sum(n) AS docs FROM h),
p AS (SELECT mean, 3 * mean / (1 + 2 * mean) AS lim, CASE WHEN spread - mean * (1 - mean) * thin > 1e-12 AND mean > 0 AND mean < 1
      THEN greatest(1.0, mean * (1 - mean) / (spread - mean * (1 - mean) * thin) - 1) ELSE docs END AS strength FROM s),
r AS (SELECT host, (bad + mean * strength) / (n + strength) AS rate, n + strength AS weight, lim, mean FROM h, p),
v AS (SELECT host, rate - 2 * sqrt(rate * (1 - rate) / (weight + 1)) > lim AND mean > 0 AND mean < 1 AS host_bad FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_bad, false) AS kept
FROM f LEFT JOIN v USING (host)
"""
