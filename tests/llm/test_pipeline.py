"""The pipeline, stage by stage, against a brute-force version on its own input."""

import hashlib
import os
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import WORD, brute_components, brute_targets, lower

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline
    from strandline.llm import bpe, quality_cnn

    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.tokenizer_path())
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(*COLUMNS)
    frames = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, frames[-1], DIR).write.parquet(path)
        frames.append(spark.read.parquet(path))
    rows = [f.collect() for f in frames]
    assert all(f.columns == COLUMNS for f in frames[:5])

    net = quality_cnn.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    score = lambda t: quality_cnn.score(net, np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0]
    assert {r["doc_id"] for r in rows[1]} == {r["doc_id"] for r in rows[0] if score(r["text"]) >= 0.3}

    least = {}
    for r in rows[1]:
        least[lower(r["text"])] = min(r["doc_id"], least.get(lower(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(least.values())

    ordered = sorted(rows[2], key=lambda r: r["doc_id"])
    roots = brute_components([r["text"] for r in ordered], 5, 80, 100)
    assert sorted(r["doc_id"] for r in rows[3]) == [r["doc_id"] for i, r in enumerate(ordered) if roots[i][1] == i]

    words, size, taken = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows[3]}, Counter(), Counter()
    for r in rows[3]:
        size[r["source"]] += words[r["doc_id"]]
    for r in rows[4]:
        taken[r["source"]] += words[r["doc_id"]]
    want = brute_targets(size)
    assert max(Counter(r["doc_id"] for r in rows[4]).values()) <= 2
    for s in size:
        assert abs(taken[s] - want[s]) <= max(max(words.values()) / 2, 0.05 * want[s])

    text = {r["doc_id"]: r["text"] or "" for r in rows[4]}
    assert sorted(r["doc_id"] for r in rows[5]) == sorted(r["doc_id"] for r in rows[4])
    for r in rows[5]:
        ids = tokenizer.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids)}I", r["ids"])) == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_take_nulls_and_no_rows(spark):
    import corpus_pipeline as pipeline

    long = "word " * 30_000
    texts = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "a b c", None, "s", 5), (2, "a b c", None, "s", 5), (3, long, "en", "s", 5), (3, long + "x", "en", "s", 5)]
    odd = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    # Names that the operators use themselves.
    for name in ("size", "copies", "kept", "score", "node", "text_sha256"):
        odd = odd.withColumn(name, F.lit(name))
    for df in (odd, odd.limit(0)):
        for _, stage in pipeline.STAGES:
            out = stage(spark, df, DIR)
            assert out.columns == df.columns or stage is pipeline.STAGES[-1][1]
            assert (len(out.collect()) > 0) == (df is odd)
