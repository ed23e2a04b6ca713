"""Oracles of the SQL-expressible operators and the pipeline's stages."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as C
from conftest import SF_CHECK
from flowlens.llm import bpe, mixing, runtime, simhash
from flowlens.llm.queries import ORACLE, QUERIES, word_tokenizer_path
from flowlens.sources.tables import table
from oracle import compare


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_sql(spark, key):
    r = compare(spark, key, SF_CHECK, E.queries(), E.oracle_sql())
    assert r["ok"] and r["spark_rows"] > 0, r


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
    assert "pipeline" in E.queries()


def test_nothing_else_imports_the_package():
    root = Path(C.__file__).parent
    for f in (root / "flowlens").rglob("*.py"):
        if "llm" not in f.relative_to(root / "flowlens").parts:
            assert "flowlens.llm" not in f.read_text(), f


def test_stages_take_effect(spark):
    runtime.prepare(spark)
    docs = runtime.documents(spark, SF_CHECK)
    scratch, cols = runtime.Scratch(spark, "stages"), docs.columns
    kept = []
    for k, (_, stage) in enumerate(C.STAGES):
        docs = scratch.keep(stage(spark, docs, SF_CHECK), f"s{k}")
        kept.append(docs)
        if k < len(C.STAGES) - 1:
            assert docs.columns == cols
    clean, exact, near, mixed, tokens = kept
    labels = table(spark, SF_CHECK, "labels")
    ids = clean.select("doc_id").distinct()
    clean_labels = labels.filter("toxic = 0")
    assert clean_labels.join(ids, "doc_id", "left_semi").count() >= 0.99 * clean_labels.join(
        runtime.documents(spark, SF_CHECK), "doc_id", "left_semi").count()
    assert exact.count() == exact.select("text").distinct().count() == clean.select("text").distinct().count()
    groups = simhash.near_groups(exact, carry=["doc_id"]).select("row.doc_id", "component_id").collect()
    assert {r.doc_id for r in near.select("doc_id").collect()} == {r.component_id for r in groups}
    assert near.join(exact, cols, "left_anti").count() == 0
    assert tokens.count() == mixed.count() > 0
    codec = bpe.codec(open(word_tokenizer_path(), encoding="utf-8").read())
    by_id = {}
    for r in mixed.collect():
        by_id.setdefault(r.doc_id, set()).add(codec.encode(r.text or ""))
    assert all(bytes(r.ids) in by_id[r.doc_id] and r.n_tokens == len(r.ids) // 4 for r in tokens.collect())


def test_run_on_edge_rows(spark, tmp_path):
    from llm.edge import frame, labels

    d = frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    few_toxic = [(i, 1, int(i == 8)) for i in (1, 4, 5, 6, 8, 9, 10)] + [(6, None, 0), (None, 1, 1), (99, 0, None)]
    labels(spark, few_toxic).write.parquet(f"{tmp_path}/labels.parquet")
    out = C.run(spark, str(tmp_path))
    assert out.count() > 0 and out.filter(F.col("ids").isNull()).count() == 0
    d.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_training_order_survives_into_the_token_rows(spark, tmp_path):
    docs = runtime.documents(runtime.prepare(spark), SF_CHECK).limit(200)
    planned = mixing.copies(mixing.plan_mix(docs))
    want = [r.doc_id for r in planned.select("row.doc_id", "position", "mix.before", "copy").orderBy("position", "before", "copy").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        C.mix_sources(spark, docs, SF_CHECK).write.option("maxRecordsPerFile", 20).parquet(f"{tmp_path}/mixed")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list(tmp_path.glob("mixed/part-*"))) > 2
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    rows = C.encode(spark, mixed, SF_CHECK).repartition(3).collect()
    assert len({r.place for r in rows}) == len(rows)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.place)] == want
    assert mixed.join(docs, ["doc_id", "text"], "left_anti").count() == 0  # no copy is cut
