import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casebook.llm import packing, pii
from tests.llm.test_pairs import brute_components
from tests.llm.test_text_ops import brute_line_templates, brute_spans

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_against_a_plain_version(spark):
    """Each stage by a plain loop; the spans that trees add are taken from the operator."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = {k: t for k, t in docs.items() if t is not None and re.search(r"[^\W\d_]", t)}
    ids = sorted(docs)
    docs = {k: left for k, (left, _, _) in zip(ids, brute_line_templates([docs[k] for k in ids], ids), strict=True)}
    first, _ = brute_components([docs[k] for k in ids], 5, 80, ids)
    docs = {k: docs[k] for k, c in zip(ids, first, strict=True) if k == c}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    added = {r.doc_id: [(s.kind, s.start, s.end) for s in r.added] for r in pii.detect(frame).collect()}
    for k, t in docs.items():
        out, at = [], 0
        for start, end, kind in sorted((b, e, n) for n, b, e in [*brute_spans(t), *added[k]]):
            if start >= at:
                out += [t[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        docs[k] = "".join(out) + t[at:]
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.bin_size in packing.SIZES
    assert got == {k: len(t.encode()) for k, t in docs.items()}


def test_the_language_stage_goes_by_the_model(spark, make):
    import random

    rng = random.Random(13)
    styles = {"aa": ["bade", "cafe", "dace", "fade", "bead"], "bb": ["kolm", "monk", "looß", "knol", "moln"]}
    langs = [("aa", "bb")[k % 2] for k in range(60)]
    texts = [" ".join(rng.choice(styles[g]) for _ in range(80)) for g in langs]
    junk = ["".join(rng.choice("bcdfghjkmnopqrstvwxz ") for _ in range(400)), "это неизвестный язык " * 20]
    clean = [texts[0].upper(), "bade", texts[1] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', texts[2]]
    docs = make([*texts, *junk, *clean, "12 34", None], ids=[None] * 68, langs=[*langs, *[None] * 8])
    kept = {r.text for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert kept == {*texts, *clean}
    unlabelled = make([*junk, *clean, "12 34", None])
    assert {r.text for r in corpus_pipeline.language(spark, unlabelled, SF).collect()} == {*junk, *clean}


def test_stages_keep_columns_and_stand_empty_tables(spark, make, odd_texts):
    docs = make(odd_texts, ids=[None, *range(len(odd_texts) - 1)])
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns and out.count() <= rows.count(), name
    kept = corpus_pipeline.line_dedup(spark, docs, SF)
    assert kept.where(F.col("n_chars") != F.length("text")).count() == 0
