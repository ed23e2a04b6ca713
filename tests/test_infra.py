"""Sessions, scratch locations and connectors."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.session import ensure_checkpoint_dir
from flowlens.sources import connectors as C
from flowlens.sources import fixtures as fx


def test_checkpoint_dir_comes_from_session(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and spark.conf.get("spark.checkpoint.dir") == d


def test_file_source_sink_roundtrip(spark, tmp_path):
    recs = fx.order_events(spark, SF_SMALL).select(F.col("order_id").alias("value"))
    C.file_sink(recs, str(tmp_path / "out"))
    back = C.file_source(spark, str(tmp_path / "out"), "order-events")
    assert sorted(r.value for r in back.collect()) == sorted(r.value for r in recs.collect())


def test_exactly_once_fanout_idempotent(spark, tmp_path):
    w = C.exactly_once_fanout(str(tmp_path / "out"), str(tmp_path / "audit"), 1)
    batch = fx.eos_input(spark, SF_SMALL)
    w(batch, 0)
    w(batch, 0)  # a replayed batch rewrites, never duplicates
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
    assert spark.read.parquet(str(tmp_path / "audit")).count() == batch.count()


def _fake_session(master):
    from types import SimpleNamespace

    seen = {}
    sc = SimpleNamespace(master=master, getConf=lambda: {}, setCheckpointDir=lambda d: seen.update(dir=d))
    conf = SimpleNamespace(get=lambda k, default=None: seen.get(k, default), set=lambda k, v: seen.update({k: v}))
    return SimpleNamespace(sparkContext=sc, conf=conf), seen


def test_no_machine_local_folder_on_a_cluster():
    import pytest

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(_fake_session(master)[0])
    for master in ("local", "local[*]", "local[8]"):
        session, seen = _fake_session(master)
        assert ensure_checkpoint_dir(session) == seen["dir"]
