"""The learned operators by held-out accuracy, and the pipeline's stages."""

from __future__ import annotations

import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import queries, quality, toxicity
from cloakframe.llm.labelled import remainder

SF = "/root/testdata/sf0.01"


def held_out(result, label):
    rows = result.toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    rows = rows[rows.held_out]
    assert ((rows.score >= 0) & (rows.score <= 1)).all() and (rows.predicted == (rows.score >= 0.3)).all()
    return rows.predicted, rows[label]


def test_quality(spark):
    p, y = held_out(queries.op4_quality(spark, SF), "quality")
    assert (p == y).mean() >= 0.95


def test_toxicity(spark):
    p, y = held_out(queries.op6_toxicity(spark, SF), "toxic")
    assert (p == y).mean() >= 0.9 and (p[y == 0] == 0).mean() >= 0.98


def test_folds(spark):
    rows = spark.range(50).withColumn("r", remainder("id", 4)).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_grammar():
    lexicon = toxicity.Lexicon({"lowei": 5.0})

    def kinds(text):
        return [k for k, _ in lexicon.matches(text)]

    assert kinds("You are an idiot.") == [toxicity.AIMED_INSULT]
    assert kinds("That idiot hates you!") == [toxicity.AIMED_INSULT]
    assert kinds("what trash") == [toxicity.INSULT]
    assert kinds("You are not an idiot.") == [toxicity.NEG_INSULT]
    assert kinds("She said he is an idiot.") == [toxicity.SAID_INSULT]
    assert kinds("I will kill you. Fine.") == [toxicity.AIMED_THREAT]
    assert kinds("so loweichen und") == [toxicity.INSULT]
    assert kinds("aloweichen, slow trashes") == [] and kinds("") == []
    said, aimed = (sum(w for _, w in lexicon.matches(t)) for t in ("She said he is an idiot.", "He is an idiot."))
    assert said < aimed


@pytest.mark.parametrize("fit", [toxicity.fit, quality.fit])
def test_odd_tables(spark, fit):
    docs = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (2, "", 2.0), (None, "You idiot", 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = fit(docs, labels, F.lit(True))
    score = toxicity.score if fit is toxicity.fit else quality.score
    got = score(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert score(docs.limit(0), model).collect() == []
    if fit is toxicity.fit:
        assert sorted(r.score for r in toxicity.accepted(docs, model).collect()) == [1.0, 2.0, 2.0]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            clean = before.join(labels.where("toxic = 0"), "doc_id", "left_semi").count()
            assert kept.join(labels.where("toxic = 0"), "doc_id", "left_semi").count() >= 0.99 * clean
            break
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
