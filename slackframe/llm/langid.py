"""Language identification with rank-order profiles.

A profile is the list of a language's most frequent n-grams in order of frequency. A document gets
its own list, and every language is charged, for each of the document's n-grams, the distance
between the two ranks (the profile's length where the n-gram is missing). The smallest sum wins.
N-grams are of 1 to 3 UTF-8 bytes of the lower-cased text with every run of other characters than
letters and the marks that go with them as one space.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slackframe.llm.common import alone, binary_values, crc_mod, map_arrow

LONGEST = 3
PROFILE = 400
#: What is said of a text without a letter.
UNKNOWN = "und"

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_ASCII = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
_CHUNK = 1 << 20


def normalised(raw: bytes) -> bytes:
    """Letters in lower case, everything else as single spaces, one space at either end; b"" without a letter."""
    if raw.isascii():
        parts = raw.lower().translate(_ASCII).split()
        text = b" ".join(parts)
    else:
        text = _OTHER.sub(" ", raw.decode("utf-8", "replace").lower()).strip()
        text = text.encode() if any(map(str.isalpha, text)) else b""
    return b" " + text + b" " if text else b""


def grams(text: bytes, seen: int = 0) -> np.ndarray:
    """Codes of all n-grams of 1 to LONGEST bytes that end after the first seen bytes.

    Texts are joined by zero bytes, which no text holds; n-grams with one are left out, so lengths
    don't mix.
    """
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    full = b > 0 if b"\0" in text else None
    out, code, whole = [], b, full
    for n in range(1, LONGEST + 1):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
            whole = whole[:-1] & full[n - 1 :] if full is not None else None
        new = max(0, seen - n + 1)
        out.append(code[new:] if whole is None else code[new:][whole[new:]])
    return np.concatenate(out)


def ranked(text: bytes, k: int = PROFILE) -> np.ndarray:
    """The k most frequent n-grams, most frequent first, ties by code."""
    codes, counts = np.unique(grams(text), return_counts=True)
    key = (counts.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - codes)
    if len(key) > k:
        key = np.partition(key, len(key) - k)[len(key) - k :]
    key = np.sort(key)[::-1]
    return (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def _pieces(text: bytes):
    """A text in parts that overlap by LONGEST - 1 bytes, each with the number of bytes seen before, so that every n-gram is counted once."""
    for at in range(0, len(text), _CHUNK):
        seen = min(at, LONGEST - 1)
        yield text[at - seen : at + _CHUNK], seen


def _count(batches):
    """(lang, text) batches -> (lang, code, n), summed over the task."""
    import pyarrow as pa

    alone()
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang, text):
        for part, seen in _pieces(text):
            codes, counts = np.unique(grams(part, seen), return_counts=True)
            if lang in sums:
                old, had = sums[lang]
                codes, back = np.unique(np.concatenate([old, codes]), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate([had, counts])).astype(np.int64)
            sums[lang] = codes, counts

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), binary_values(batch.column(1))
        waiting: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}
        for lang, raw in zip(langs, texts):
            text = normalised(raw)
            waiting.setdefault(lang, []).append(text)
            held[lang] = held.get(lang, 0) + len(text)
            if held[lang] > _CHUNK:
                add(lang, b"\0".join(waiting.pop(lang)))
                held.pop(lang)
        for lang, texts in waiting.items():
            add(lang, b"\0".join(texts))
    for lang, (codes, counts) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "code", "n"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", k: int = PROFILE) -> list[tuple[str, list[int]]]:
    """Profiles from all rows with a language: [(language, n-gram codes by rank)], k codes for each.

    Counts cover every row given, whole texts, and don't depend on how rows are dealt. The result has
    k numbers for each distinct language; ties between n-grams go to the lesser code. Rows without a
    language or a text teach nothing; without rows there are no languages.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = map_arrow(rows, _count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("code"))
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "code", "rank").collect():
        found.setdefault(r.lang, []).append((r.rank, r.code))
    return [(lang, [c for _, c in sorted(found[lang])]) for lang in sorted(found)]


class Judge:
    """Profiles laid out for look-up: rank[n-gram, language], k where a language lacks the n-gram."""

    def __init__(self, profiles, k: int = PROFILE):
        self.langs, self.k = [x for x, _ in profiles], k
        self.codes = np.unique(np.array([c for _, codes in profiles for c in codes] or [0], np.uint32))
        self.rank = np.full((len(self.codes) + 1, max(1, len(profiles))), k, np.int32)
        for i, (_, codes) in enumerate(profiles):
            self.rank[np.searchsorted(self.codes, np.array(codes, np.uint32)), i] = np.arange(len(codes))

    def __call__(self, raw: bytes) -> tuple[str, float]:
        text = normalised(raw)
        if not text or not self.langs:
            return UNKNOWN, 0.0
        mine = ranked(text, self.k)
        at = np.searchsorted(self.codes, mine)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == mine, at, len(self.codes))
        ranks = self.rank[at]
        far = np.where(ranks == self.k, self.k, np.abs(ranks - np.arange(len(mine), dtype=np.int32)[:, None])).sum(axis=0)
        best = int(far.argmin())  # ties: the first language by name
        return self.langs[best], 1.0 - float(far[best]) / (self.k * len(mine))


def _judge(profiles, k, at, drop, names):
    def run(batches):
        import pyarrow as pa

        alone()
        judge = Judge(profiles.value, k)
        for batch in batches:
            said = [judge(x) for x in binary_values(batch.column(at))]
            columns = [batch.column(i) for i in range(batch.num_columns - drop)] + [pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def predict(docs: DataFrame, profiles, keep: list, text_col: str = "text", k: int = PROFILE, names=("lang_pred", "score")) -> DataFrame:
    """The columns of keep with the language and the score of every row, under names.

    Null, empty and letterless texts give 'und' and score 0. score is 1 less the winner's distance
    as a share of the largest possible one. Rows are judged one by one and whole, however long, so
    repeated rows agree; ties go to the first language by name. An empty table gives an empty table.
    names are added to the columns of keep and must differ from them.
    """
    extra = [] if text_col in [x for x in keep if isinstance(x, str)] else [F.col(text_col).alias("__sf_text")]
    rows = docs.select(*keep, *extra)
    at = len(rows.columns) - 1 if extra else rows.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields[: len(rows.columns) - len(extra)], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return map_arrow(rows, _judge(shared, k, at, len(extra), schema.names), schema)


def held_out(id_col) -> F.col:
    """Whether a document stays out of training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, with profiles from the documents that aren't held out.

    A row with a null id isn't held out. Nulls, ties and repeated rows are as predict() and fit() say.
    """
    profiles = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, profiles, ["doc_id", held_out(F.col("doc_id")).alias("held_out")])


def keep_identified(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """Rows whose language is known with at least this score, with their columns as they were.

    Null, empty and letterless texts go; a null lang or id is no reason to. Repeated rows stay or go
    together, and an empty table stays one. The judgement's helper columns begin with __sf_, which no
    column of docs may.
    """
    profiles = fit(docs.where(~held_out(F.col("doc_id"))))
    judged = predict(docs, profiles, docs.columns, names=("__sf_lang", "__sf_score"))
    return judged.where((F.col("__sf_lang") != UNKNOWN) & (F.col("__sf_score") >= least)).select(*docs.columns)
