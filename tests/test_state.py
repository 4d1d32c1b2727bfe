"""The state's versions: a writer may stop after any step, a stream's batch may come twice."""

from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from lumensift.sources.state import Store, put
from lumensift.sources.versions import VersionLog
from lumensift.streaming import learner


def counts(spark, **n):
    return spark.createDataFrame([*n.items()], "query string, n bigint")


def rows(df):
    return {r["query"]: r["n"] for r in df.collect()}


class Stopped(RuntimeError):
    pass


def test_stops_after_every_step(spark, tmp_path, monkeypatch):
    """Steps are writes of data, creation of the commit file, its bytes, and each deletion. Whatever the last step was, the store has the old counts or the new ones."""
    store = Store(spark, str(tmp_path / "s"), parts=2)
    store.save(counts(spark, a=1, b=2))
    store.save(counts(spark, a=2, b=3))
    old = rows(store.load())
    for step, left in ((("_write", Store), old), (("commit", VersionLog), old), (("pruned", VersionLog), {"c": 9}), (("_delete", VersionLog), {"c": 9})):
        (name, owner) = step
        real = getattr(owner, name)
        for before in (True, False):

            def stop(*args, **kwargs):
                if not before:
                    real(*args, **kwargs)
                raise Stopped

            with monkeypatch.context() as m, pytest.raises(Stopped):
                m.setattr(owner, name, stop)
                store.save(counts(spark, c=9))
            got = rows(store.load())
            assert got == (left if before or name != "commit" else {"c": 9}), (name, before)
            store.save(counts(spark, a=2, b=3))
    assert rows(store.load()) == old


def test_a_commit_that_was_cut_off(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save(counts(spark, a=1))
    for n, text in ((2, ""), (3, '{"of": 16, "parts": {"0": "v'), (4, '{"of": 16, "parts": {}}')):
        (tmp_path / "s" / "log" / f"{n:010d}.json").write_text(text)
        assert rows(store.load()) == {"a": 1}
    store.save(counts(spark, a=5))
    assert rows(store.load()) == {"a": 5}


def test_merge_writes_touched_parts_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), parts=8)
    many = {f"q{i}": i for i in range(40)}
    assert sorted(store.merge(counts(spark, **many), 0, "x")) == list(range(8))
    before = store.log.latest()[1]["parts"]
    (part,) = store.merge(counts(spark, q7=100), 1, "x")
    after = store.log.latest()[1]["parts"]
    assert {p for p in after if after[p] != before[p]} == {str(part)} and rows(store.load()) == {**many, "q7": 100}
    version = store.log.latest()
    assert store.merge(counts(spark, q7=999, new=1), 1, "x") == [] and store.merge(counts(spark, q7=999), 0, "x") == []
    assert store.log.latest() == version and rows(store.load()) == {**many, "q7": 100}
    assert store.merge(counts(spark, q9=3).limit(0), 2, "x") == [] and store.log.latest()[1]["batches"] == {"x": 2}
    assert store.merge(counts(spark, **{"новый": 4}), 0, "another stream") != []
    assert rows(store.load()) == {**many, "q7": 100, "новый": 4}
    store.clear()
    assert rows(store.load()) == {}
    with pytest.raises(ValueError, match="parts"):
        Store(spark, str(tmp_path / "s"), parts=3).merge(counts(spark, a=1), 9)


def test_stream_in_batches(spark, tmp_path):
    schema = "query string"
    for i, words in enumerate((["a", "b", "A "], ["b", "c"], ["d", " ", "b"])):
        spark.createDataFrame([(w,) for w in words], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    store, merged = Store(spark, str(tmp_path / "s")), []
    real = Store.merge
    object.__setattr__(store, "merge", lambda *a: merged.append(real(store, *a)) or merged[-1])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    learner.learn_stream(stream, store, str(tmp_path / "c")).awaitTermination()
    assert len(merged) >= 3 and rows(store.load()) == {"a": 2, "b": 3, "c": 1, "d": 1}
    assert real(store, store.load().withColumn("n", F.col("n") * 2), len(merged) - 1, str(tmp_path / "c")) == []


def test_snapshots_that_were_cut_off(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save(counts(spark, a=1))
    name = store.backup(store.load()).rpartition("/")[2]
    (tmp_path / "s-backups" / "s-backup-9999").mkdir()
    store.save(counts(spark, b=1))
    assert store.snapshots() == [name] and store.restore()[0] == name and rows(store.load()) == {"a": 1}
    store.backup(counts(spark, a=1).limit(0))
    assert rows(store.restore()[1]) == {}


def test_put_survives_two_stops(spark, tmp_path):
    """What stands in the old place alone is not deleted before the new one is there."""
    at = str(tmp_path / "t")
    (tmp_path / "t.old").mkdir()
    (tmp_path / "t.old" / "kept").write_text("x")
    with pytest.raises((OSError, Py4JJavaError)):
        put(spark, str(tmp_path / "missing"), at)
    assert (tmp_path / "t.old" / "kept").exists()
    (tmp_path / "t.new").mkdir()
    put(spark, str(tmp_path / "t.new"), at)
    assert (tmp_path / "t").is_dir() and not (tmp_path / "t.old").exists()
