"""Tables in the shared folder, and where that folder is."""

import os
from types import SimpleNamespace

import pytest

from palimpsest import storage


def session(master, base=None, own=None):
    conf = {"spark.checkpoint.dir": own} if own else {}
    put = lambda k, v: conf.__setitem__(k, v)
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _k: base))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=put), sparkContext=context), conf


def test_the_shared_folder_is_asked_for_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(ValueError, match="share"):
            storage.shared_dir(session(master)[0], "x")
        assert storage.shared_dir(session(master, "hdfs://n/shared/")[0], "x").startswith("hdfs://n/shared/palimpsest/x-")
        assert storage.shared_dir(session(master, "a", "b")[0], "x").startswith("b/palimpsest/x-")
    for master in ("local", "local[4]", "local[*]"):
        spark, conf = session(master)
        assert "palimpsest-shared" in storage.shared_dir(spark, "x") and conf["spark.checkpoint.dir"]


def test_tables_are_written_and_removed(spark):
    folder = storage.shared_dir(spark, "storage").removeprefix("file:")
    df = spark.range(10).selectExpr("id", "CAST(NULL AS string) AS t")
    again = storage.cut(df, folder, "a", 10)
    assert again.dtypes == df.dtypes and again.count() == 10 and len([f for f in os.listdir(f"{folder}/a") if f.endswith(".parquet")]) == 1
    assert storage.cut(df.limit(0), folder, "b").count() == 0 and storage.once(df, "c").count() == 10
    storage.remove(spark, f"{folder}/a", f"{folder}/never")
    assert os.listdir(folder) == ["b"]


def test_small_tables_are_spread(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert storage.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and storage.spread(one).count() == 100
    spark.range(100).repartition(9).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert "Exchange" not in storage.spread(many)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(storage, "SMALL_BYTES", 10)
    assert "Exchange" not in storage.spread(one)._jdf.queryExecution().executedPlan().toString()
    odd = f"{tmp_path}/a b%c"
    one.coalesce(1).write.parquet(odd)
    monkeypatch.setattr(storage, "SMALL_BYTES", 1 << 20)
    assert storage.spread(spark.read.parquet(odd)).count() == 100 and storage.spread(spark.range(5)).count() == 5
