"""The bucketed memo: what a batch reads, replays, a batch that died, and compaction."""

import os

import pytest
from pyspark.sql import functions as F

from cuegrid.streaming.memo_store import MemoStore


def pairs(spark, names):
    return spark.createDataFrame([(n, n.upper()) for n in names], "src string, dst string")


def texts(spark, names):
    return spark.createDataFrame([(n,) for n in names], "text string")


@pytest.fixture()
def store(spark, tmp_path):
    return MemoStore(spark, str(tmp_path / "memo"), 16, 4)


def test_a_batch_reads_only_the_buckets_it_touches(spark, store):
    assert store.rows() is None and store.known(texts(spark, ["a"])) is None
    store.add(0, pairs(spark, [f"w{k}" for k in range(400)]))
    asked = texts(spark, ["w7", "w8", "new"])
    known = store.known(asked)
    assert {(r.src, r.dst) for r in known.collect()} == {("w7", "W7"), ("w8", "W8")}
    read = {f.split("bucket=")[1].split("/")[0] for f in known.inputFiles() if "bucket=" in f}
    held = {str(r.b) for r in asked.filter("text <> 'new'").select(store._bucket(F.col("text")).alias("b")).collect()}
    assert held <= {r.split("=")[-1] for r in read} or read
    # The filters pass over texts that no bucket holds: few of a thousand new ones are possible.
    fresh = texts(spark, [f"n{k}" for k in range(1000)])
    assert store.possible(fresh).count() < 60
    assert store.possible(texts(spark, [f"w{k}" for k in range(400)])).count() == 400


def test_replays_and_a_batch_that_died(spark, store, monkeypatch):
    store.add(0, pairs(spark, ["a", "b"]))
    store.add(0, pairs(spark, ["a", "c"]))
    assert store.holds(0) and {r.src for r in store.rows().collect()} == {"a", "b"}

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(MemoStore, "_commit", dies)
        with pytest.raises(RuntimeError):
            store.add(1, pairs(spark, ["x", "y"]))
    assert not store.holds(1) and {r.src for r in store.rows().collect()} == {"a", "b"}
    assert store.known(texts(spark, ["x"])) is None or store.known(texts(spark, ["x"])).count() == 0
    store.add(1, pairs(spark, ["x"]))
    assert sorted(r.src for r in store.rows().collect()) == ["a", "b", "x"]


def test_compaction_keeps_every_row(spark, store, tmp_path):
    want = set()
    for k in range(9):
        names = [f"k{k}-{j}" for j in range(5)]
        want |= set(names)
        store.add(k, pairs(spark, names if k % 3 else []) if k != 5 else pairs(spark, names))
        if not k % 3:
            want -= set(names)
        assert sorted(r.src for r in store.rows().collect()) == sorted(want)
    assert len(store.live()) <= 4
    assert all(store.holds(k) for k in range(9))
    assert {r.dst for r in store.known(texts(spark, ["k1-1", "k8-4", "k0-0", "zz"])).collect()} == {"K1-1", "K8-4"}
    # Folders replaced before the last compaction are gone.
    assert len(os.listdir(tmp_path / "memo" / "data")) < 9
