import collections
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kinetrail.llm import ngram_join, secrets
from tests.llm.test_operators import brute_clean, jaccard_components, sentence


def make(spark, path):
    import random

    r = random.Random(12)
    passage = sentence(r, 120)
    base = sentence(r, 150)
    texts = [None, "", "123 456", base, base, base + " tail", *(sentence(r, 60) for _ in range(40))]
    texts += [sentence(r, 50) + " " + passage + " " + sentence(r, 20) for _ in range(3)]
    texts += [sentence(r, 30) + ' token = "0123456789abcdef0123" ' + sentence(r, 30)]
    rows = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return rows


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [(i, t) for i, t, *_ in rows if t and any(ch.isalpha() for ch in t)]
    step = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert step.columns == docs.columns and sorted(r["doc_id"] for r in step.collect()) == [i for i, _ in kept]
    low = {i: c for i, _, c in jaccard_components(kept, 5, 80, 100)}
    kept = [(i, t) for i, t in kept if low[i] == i]
    step = corpus_pipeline.STAGES[1][1](spark, step, str(tmp_path))
    assert sorted(r["doc_id"] for r in step.collect()) == [i for i, _ in kept]
    step = corpus_pipeline.STAGES[2][1](spark, step, str(tmp_path))
    after = {r["doc_id"]: r["text"] for r in step.collect()}
    assert after == dict(brute_clean(kept)) and sum(after[i] != t for i, t in kept) == 3
    step = corpus_pipeline.STAGES[3][1](spark, step, str(tmp_path))
    clean = {r["doc_id"]: r["text"] for r in step.collect()}
    assert clean == {i: secrets.redact(t) for i, t in after.items()}
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for i, x in clean.items()}
    got = collections.Counter()
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
        got[p["doc_id"]] += p["length"]
    assert got == {i: len(x) for i, x in ids.items()}
    assert ngram_join.BLOCK > 1


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """No rows; and repeated rows, null ids and columns that an operator might use itself."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows, more in (("empty", [], ""), ("odd", [(1, "some words here", "en", "s", 15)] * 2 + [(None, "other words there", "en", "s", 17), (3, None, None, None, None)], ", n1 long, __n1 long, __id long, __lost boolean, runs string, c0 string, lost boolean, component long")):
        extra = len(more.split(",")) - 1
        wide = [(*r, *([7, 8, 9, True, "r", "c", False, 5][:extra])) for r in rows]
        docs = spark.createDataFrame(wide, schema + more)
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, str(tmp_path))
            assert docs.columns == [c.strip().split(" ")[0] for c in (schema + more).split(",")], stage
        assert sorted(str(r["doc_id"]) for r in docs.collect()) == (["1", "None"] if rows else [])
        assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()} == ({1, None} if rows else set())
