"""The registered queries' own columns, asserted on the small table."""

import zlib

import numpy as np
import pytest

from sentrella.llm import quality, simhash, token_files, toxicity

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def share(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize(("query", "n", "rest", "bound"), [(toxicity.op1_toxicity, 4, 2, 0.3), (quality.op10_quality, 3, 1, 0.5)])
def test_classifiers(spark, sf, texts, query, n, rest, bound):
    out = query(spark, sf).toPandas()
    assert {"doc_id", "held_out", "score", "predicted"} <= set(out.columns) and sorted(out.doc_id) == sorted(texts)
    for r in out.itertuples():
        assert r.held_out == (share(r.doc_id, n) == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= bound)


def test_token_files(spark, sf, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = token_files.op2_token_files(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    at = 0
    for r in out.itertuples():
        ids = np.array([*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert list(out.doc_id) == sorted(texts)


def test_simhash(spark, sf, texts):
    out = simhash.op3_simhash(spark, sf).toPandas()
    assert sorted(out.doc_id) == sorted(texts)
    for r in out.itertuples():
        assert r.fingerprint == f"{simhash.fingerprint(texts[r.doc_id]) % (1 << 64):016x}" and r.component_id <= r.doc_id
