"""The pipeline against plain Python, stage by stage."""

from __future__ import annotations

import zlib

import numpy as np

import corpus_pipeline
from slackframe.llm.common import tokenizer_file, written
from tests.llm.test_operators import awkward, empty, plain_links  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), name)
        if name != "token_files":
            assert docs.columns == columns
            seen[name] = ([(r.doc_id, r.text) for r in before.collect()], [(r.doc_id, r.text) for r in docs.collect()])
    a, b = seen["language_id"]
    assert set(b) <= set(a) and len(b) >= 0.98 * len(a)
    a, b = seen["near_duplicates"]
    links = plain_links(a)
    assert sorted(i for i, _ in b) == sorted({c for c, _ in links.values()})
    a, b = seen["decontamination"]
    assert {i for i, t in a if any(x in t for x in bench if len(x.split()) >= 5)}.isdisjoint({i for i, _ in b})
    a, b = seen["source_mix"]
    assert set(b) <= set(a) and 1.0 < sum(len(t.split()) for _, t in b) / sum(len(t.split()) for _, t in a) < 2.0
    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    start = 0
    for (doc_id, text), r in zip(sorted(b), sorted(docs.collect(), key=lambda r: r.start)):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50


def test_stages_take_empty_and_awkward_tables(spark, awkward, empty):  # noqa: F811
    """Each stage on a table without rows, and on one of nulls, repeated rows and columns of clashing names."""
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        out = stage(spark, awkward, SF)
        assert out.count() <= 2 * awkward.count() and (name == "token_files" or out.columns == awkward.columns), name


def test_run_takes_an_empty_corpus(spark, empty, tmp_path):  # noqa: F811
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
