"""A corpus pipeline: language ID, near duplicates, decontamination, source mix, token files.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents;
run() writes each stage's rows as Parquet in the shared folder and reads them again. Columns of docs
may have any names that don't begin with __sf_, and texts any length.
"""

from __future__ import annotations

from slackframe.llm import decontaminate, jaccard, langid, mixing, tokenfiles
from slackframe.llm.common import written


def language_id(spark, docs, sf_dir):
    """Documents whose language is recognised stay.

    Null, blank and letterless texts go; repeated rows stay or go together; an empty table stays one.
    """
    return langid.keep_identified(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of similar ones stays, the one of the least id.

    Of repeated rows one stays; null ids sort after all others; a null or blank text is like no other
    text, and of such rows with equal ids one stays. An empty table stays one.
    """
    return jaccard.one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold an item of the benchmark go.

    Null and blank texts hold none; repeated rows stay or go together; an empty table stays one, and
    an empty benchmark drops nothing.
    """
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark, docs, sf_dir):
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is a source of its own; null and blank texts have no words. Repeated rows are taken
    one by one. An empty table stays one.
    """
    return mixing.mixed_rows(docs)


def token_files(spark, docs, sf_dir):
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone; rows of one id stand by text, null ids first. An empty
    table gives no files and no rows.
    """
    return tokenfiles.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]
#: SQL can't express the stages (crc32 folds, MinHash, a tokenizer's ids); tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
