"""The corpus pipeline and held-out accuracy on the small tables."""

import os

import pandas as pd
import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def test_stages(spark, docs):
    import corpus_pipeline
    from renown.llm.secrets import redacted
    from tests.llm import brute

    seen = docs
    for (name, stage) in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(seen), SF).toPandas()
        if name != "mixing":
            assert list(out.columns) == list(docs.columns)
        got = set(out.doc_id)
        if name == "language":
            assert len(got) >= 0.99 * len(seen)
        if name == "near_duplicates":
            comp = brute.jaccard(list(zip(seen.doc_id, seen.text, strict=True)))
            assert got == {i for i, (_, c) in comp.items() if i == c}
        if name == "decontamination":
            bench = pd.read_parquet(f"{SF}/benchmark.parquet")
            leaks = brute.leaks(list(zip(seen.doc_id, seen.text, strict=True)), list(zip(bench.item_id, bench.text, strict=True)))
            assert got == set(seen.doc_id) - {d for d, _ in leaks}
        if name == "secrets":
            assert dict(zip(out.doc_id, out.text, strict=True)) == {i: redacted(t) for i, t in zip(seen.doc_id, seen.text, strict=True)}
            assert (out.text.str.len() == out.n_chars).all() and len(out) == len(seen)
        seen = out
    assert os.path.isdir(SF)


def test_pipeline_on_empty_table(spark, docs):
    import corpus_pipeline

    df = spark.createDataFrame(docs).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    assert df.count() == 0


def test_held_out(spark, docs):
    from renown.llm.queries import QUERIES

    lang = QUERIES["op5_language"](spark, SF).toPandas().merge(docs, on="doc_id")
    assert (lang[lang.held_out].lang == lang[lang.held_out].lang_pred).mean() > 0.97
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    q = QUERIES["op6_quality"](spark, SF).toPandas().merge(labels, on="doc_id")
    q = q[q.held_out]
    assert (q.predicted == q.quality).mean() > 0.93
    t = QUERIES["op1_toxicity"](spark, SF).toPandas().merge(labels, on="doc_id", suffixes=("", "_label"))
    assert ((t.toxic == t.toxic_label).mean()) > 0.95
