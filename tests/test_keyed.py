"""Keyed tables: touched buckets, versions, writers that die or meet, replayed batches."""

import random

import pytest

from hedgerow.sources import keyed


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_random_writes_against_a_dictionary(spark, tmp_path):
    rng, path, held = random.Random(1), str(tmp_path / "t"), {}
    for step in range(5):
        if step % 3 < 2:
            new = {(rng.choice("abc"), rng.randrange(40) if rng.random() < 0.9 else None): rng.randrange(1000) for _ in range(rng.choice([1, 30]))}
            keyed.upsert(spark.createDataFrame([(*k, v) for k, v in new.items()], "a string, b int, v int"), path, ["a", "b"], buckets=8)
            held.update(new)
        else:
            letter = rng.choice("abc")
            counts = keyed.delete(spark, spark.createDataFrame([(letter,), ("zz",)], "a string"), path, "a")
            want = sum(k[0] == letter for k in held)
            assert [tuple(r) for r in counts.collect()] == ([(letter, want)] if want else [])
            held = {k: v for k, v in held.items() if k[0] != letter}
        assert {(r.a, r.b): r.v for r in keyed.read(spark, path).collect()} == held
    assert len(keyed.commits(spark, path)) == keyed.KEEP


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = tmp_path / "t"
    one = keyed.upsert(spark.range(300).withColumnRenamed("id", "k"), str(path), "k", buckets=16)
    before = files(path)
    two = keyed.upsert(spark.createDataFrame([(7,), (7,), (1000,)], "k long"), str(path), "k")
    changed = {b for b in two.folders if two.folders[b] != one.folders.get(b)}
    assert 1 <= len(changed) <= 2
    assert {f for f in before if f.split("bucket=")[1].split("/")[0] not in changed} <= files(path)
    assert keyed.read(spark, str(path)).count() == 301
    keyed.prune(spark, str(path), keep=1)
    assert all(f"{two.folders[f.split('bucket=')[1].split('/')[0]]}/" in f for f in files(path))
    assert keyed.read(spark, str(path)).count() == 301


def test_versions_of_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, version int, v string"
    keyed.upsert(spark.createDataFrame([("a", 5, "old"), ("b", 1, "old")], schema), path, "k", "version")
    keyed.upsert(spark.createDataFrame([("a", 4, "late"), ("a", 7, "new"), ("b", 1, "same")], schema), path, "k", "version")
    assert rows_of(keyed.read(spark, path)) == [("a", 7, "new"), ("b", 1, "same")]


def test_a_writer_that_dies_before_the_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    keyed.upsert(spark.createDataFrame([("a", 1)], "k string, v int"), path, "k")
    with monkeypatch.context() as m:
        m.setattr(keyed, "_commit", lambda *_: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            keyed.upsert(spark.createDataFrame([("a", 2), ("b", 2)], "k string, v int"), path, "k")
    assert rows_of(keyed.read(spark, path)) == [("a", 1)]
    keyed.prune(spark, path, orphans=True)
    assert len(files(tmp_path)) == 1 and rows_of(keyed.read(spark, path)) == [("a", 1)]
    keyed.upsert(spark.createDataFrame([("b", 3)], "k string, v int"), path, "k")
    assert rows_of(keyed.read(spark, path)) == [("a", 1), ("b", 3)]


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    base = keyed.upsert(spark.createDataFrame([("a", 1)], "k string, v int"), path, "k")
    keyed.upsert(spark.createDataFrame([("a", 2)], "k string, v int"), path, "k")
    with pytest.raises(keyed.Conflict):
        keyed._rewrite(path, base, spark.createDataFrame([("a", 3)], "k string, v int"), {0}, None, 2)
    assert rows_of(keyed.read(spark, path)) == [("a", 2)]


def test_replayed_batches_and_empty_ones(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    first = keyed.upsert(df, path, "k", token="s#0")
    assert keyed.upsert(df, path, "k", token="s#0").number == first.number
    assert keyed.upsert(df.filter("v > 1"), path, "k", token="s#1").number == first.number
    assert keyed.upsert(df, path, "k", token="s#2").number == first.number + 1
    with pytest.raises(ValueError):
        keyed.upsert(df, path, "v")
    empty = str(tmp_path / "e")
    assert keyed.read(spark, empty, "k string").count() == 0
    keyed.upsert(df.filter("v > 1"), empty, "k")
    assert keyed.read(spark, empty).count() == 0 and keyed.read(spark, empty).columns == ["k", "v"]
