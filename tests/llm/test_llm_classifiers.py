"""Quality and toxicity: held-out accuracy, edge rows, restoration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_CHECK
from flowlens.llm import quality, runtime, toxicity
from flowlens.sources.tables import table
from llm.edge import ROWS, frame, labels

SF_LARGER = "/root/testdata/sf0.1"


def _held(spark, key, label, sf):
    rows = E.queries()[key](spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    return rows[rows["held_out"] & rows[label].notna()]


def test_quality_held_out(spark):
    h = _held(spark, "op5_quality", "quality", SF_CHECK)
    assert (h["predicted"] == h["quality"]).mean() >= 0.97
    assert h["score"].between(0, 1).all()


def test_quality_edge_rows(spark):
    got = quality.scored_documents(frame(spark), labels(spark)).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = labels(spark).limit(0)
    assert {round(r.score, 6) for r in quality.scored_documents(frame(spark), none).collect()} == {0.5}
    assert quality.scored_documents(frame(spark).limit(0), labels(spark)).count() == 0


def test_quadratic_discriminant_equals_the_formula():
    rng, d = np.random.default_rng(2), len(quality.STATISTICS)
    x = {0: rng.normal(0, 1, (400, d)), 1: rng.normal(0.7, 2, (300, d))}
    model = quality.Discriminant({c: (len(v), v.sum(axis=0), v.T @ v) for c, v in x.items()})
    probe, density = rng.normal(0, 1.5, (50, d)), []
    pooled = sum(np.cov(v.T) * (len(v) - 1) for v in x.values()) / 698
    for c, v in x.items():
        cov = (1 - quality.POOL) * np.cov(v.T) + quality.POOL * pooled
        cov = (1 - quality.RIDGE) * cov + quality.RIDGE * (np.trace(cov) / d + 1e-6) * np.eye(d)
        dx = probe - v.mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", dx, np.linalg.inv(cov), dx) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(v)))
    assert model.score(probe) == pytest.approx(1 / (1 + np.exp(density[0] - density[1])), abs=1e-9)


def test_toxicity_held_out(spark):
    h = _held(spark, "op10_toxicity", "toxic", SF_LARGER)
    toxic, clean = h[h["toxic"] == 1], h[h["toxic"] == 0]
    # Some labelled toxic texts were replaced by junk and hold nothing toxic.
    assert (toxic["predicted"] == 1).mean() >= 0.9 and (clean["predicted"] == 0).mean() >= 0.99


def test_toxicity_edge_rows(spark):
    docs = frame(spark)
    model = toxicity.fit(docs, labels(spark))
    got = docs.select("doc_id", toxicity.score(spark, model, F.col("text")).alias("p")).collect()
    assert len(got) == len(ROWS) and all(0 <= r.p <= 1 for r in got)
    none = toxicity.fit(docs, labels(spark).limit(0))
    assert {round(r.p, 6) for r in docs.select(toxicity.score(spark, none, F.col("text")).alias("p")).collect()} == {0.5}
    out = toxicity.drop_toxic(docs, labels(spark))
    assert out.columns == docs.columns
    assert toxicity.drop_toxic(docs.limit(0), labels(spark)).count() == 0


@pytest.fixture(scope="module")
def restorer(spark):
    runtime.prepare(spark)
    return toxicity.Restorer(toxicity.character_model(runtime.documents(spark, SF_CHECK)))


@pytest.mark.parametrize("noisy,plain", [("1d10t", "idiot"), ("idiooot", "idiot"), ("st*pid", "stupid"), ("w0rthl3ss", "worthless"),
                                         ("m0r0n", "moron"), ("tr@sh", "trash"), ("cl0wn", "clown"), ("stuuupid", "stupid"),
                                         ("$tupid", "stupid"), ("p4th3t1c", "pathetic"), ("i.d.i.o.t", "idiot"), ("hello", "hello")])
def test_restored_words(restorer, noisy, plain):
    assert plain in restorer.readings(noisy)


def test_restored_text_and_spaced_letters(restorer):
    assert restorer.restore("you i d i o t and m0r0n") == "you idiot and moron"
    assert toxicity.spaced_runs("a b c done x y".split()) == ["abc"]
    assert "idiot" in restorer.spaced("aidiot")


@pytest.mark.parametrize("spaced,plain", [("b a d", "bad"), ("c 1 o w n", "clown"), ("s t * p i d", "stupid"), ("i d d d i o t", "idiot"),
                                          ("i d d i o t", "idiot"), ("y o u c 1 o w n", "clown"), ("x y z " * 50 + "m 0 r 0 n" + " x y z" * 50, "moron"),
                                          ("a " * 200 + "i d i o t", "idiot")])
def test_spaced_words_are_decoded(restorer, spaced, plain):
    run, = toxicity.spaced_runs(spaced.split())
    assert plain in restorer.spaced(run)


@pytest.mark.parametrize("noisy,plain", [("iddiot", "idiot"), ("stuppid", "stupid"), ("cllown", "clown"), ("worthleeess", "worthless")])
def test_doubled_letters_are_decoded(restorer, noisy, plain):
    assert {noisy, plain} <= set(restorer.readings(noisy))
    assert restorer.readings("hello") == ["hello"]


def test_stretches_overlap():
    text = "".join(chr(97 + k * 7 % 26) for k in range(500))
    got = list(toxicity.stretches(text))
    assert all(any(text[k: k + toxicity.STRETCH // 2] in s for s, _, _ in got) for k in range(len(text)))
    assert [f for _, f, _ in got] == [True] + [False] * (len(got) - 1) and [x for _, _, x in got] == [False] * (len(got) - 1) + [True]
    assert list(toxicity.stretches("iddddiot")) == [("idddiot", True, True)]


def test_obfuscated_documents_score_like_plain_ones(spark):
    docs = runtime.documents(runtime.prepare(spark), SF_LARGER)
    model = toxicity.fit(docs, table(spark, SF_LARGER, "labels"))
    rows = [("Than the worthless nt idiot erble thwh.",), ("Than the w0rthl3ss nt 1d10t erble thwh.",), ("Than the m o r o n nt erble",),
            ("Than the nt erble thwh.",), ("",)]
    got = [r.p for r in spark.createDataFrame(rows, "text string").coalesce(1)
           .select(toxicity.score(spark, model, F.col("text")).alias("p")).collect()]
    assert got[0] > 0.5 and got[1] > 0.5 and got[2] > 0.5 and got[3] < 0.5 and got[4] < 0.5


def test_spaced_and_doubled_documents_score_as_toxic(spark):
    docs = runtime.documents(runtime.prepare(spark), SF_LARGER)
    model = toxicity.fit(docs, table(spark, SF_LARGER, "labels"))
    rows = [("Than the c 1 o w n nt erble",), ("Than the s t * p i d nt erble",), ("Than the i d d d i o t nt erble",), ("Than the iddiot nt erble",)]
    assert all(r.p > 0.5 for r in spark.createDataFrame(rows, "text string").coalesce(1)
               .select(toxicity.score(spark, model, F.col("text")).alias("p")).collect())
