"""The pipeline, stage by stage, against the plain versions of its stages."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlake.llm import lines, toxicity
from tests.llm import test_lines, test_minhash
from tests.llm.helpers import table

SF = "/root/testdata/sf0.001"


def test_result_is_that_of_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    rows = [r for r in rows if model is None or model.score(r[1]) < 0.5]
    without = test_lines.brute([t for _, t in rows], lines.PIPELINE_MIN_CHARS)
    rows = [(i, new) for (i, _), (exact, near, new) in zip(rows, without) if exact + near == 0 or new.strip()]
    rows = [r for k, (r, (_, root)) in enumerate(zip(rows, test_minhash.brute([t for _, t in rows]))) if root == k]
    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    tokenizer.encode_special_tokens = True
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces |= {(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces and len(got) == len(pieces)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096


def test_stages_and_result(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"]
    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r["offset"] + r["length"] <= 4096 for r in rows)
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_stages_on_odd_rows(spark):
    docs = table(spark, [None, "", "One line of some length", "One line of some length"]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()
        stage(spark, docs.limit(0), SF).collect()
