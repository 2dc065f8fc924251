import random

import pytest
from pyspark.sql import functions as F

from skerry.sources import files, store


def contents(rows):
    return {r["k"]: r["v"] for r in rows.collect()}


def table(spark, values):
    return spark.createDataFrame(values, "k string, v long")


@pytest.fixture
def things(spark, tmp_path):
    return store.Collection(spark, str(tmp_path / "things"), None, "k", buckets=4)


def test_random_changes_against_a_dictionary(spark, things, monkeypatch):
    rng = random.Random(5)
    assert things.rows() is None and things.lookup(table(spark, [("a", 1)])) is None and things.compact() == []
    want, seen = {}, []
    for step in range(12):
        monkeypatch.setattr(store, "BROADCAST_KEYS", 200_000 if step % 2 else 0)
        kind = "write" if step in (0, 7) else rng.choice(["upsert", "upsert", "delete", "compact"])
        values = [(rng.choice("abcdefghij") * rng.randint(1, 2), step * 100 + k) for k in range(rng.randint(1, 9))]
        if kind == "write":
            things.write(table(spark, values).coalesce(1))
            want = dict(values)
        elif kind == "upsert":
            things.upsert(table(spark, values).coalesce(1))
            want.update(values)
        elif kind == "delete":
            things.delete(table(spark, values).select("k"))
            want = {k: v for k, v in want.items() if k not in dict(values)}
        else:
            things.compact(rng.choice([0.0, 0.5]))
        assert contents(things.rows()) == want
        assert contents(things.lookup(table(spark, [("aa", 0), ("b", 0), ("zz", 0)]))) == {k: v for k, v in want.items() if k in ("aa", "b")}
        seen.append((things.versions()[-1], dict(want)))
    for version, then in seen:
        assert contents(things.rows(version)) == then
    things.compact(0.0)
    things.vacuum(1)
    assert len(things.versions()) == 1 and contents(things.rows()) == want
    assert not files.names(spark, f"{things.path}/delta-*")


def test_an_upsert_writes_its_own_rows_only(spark, things):
    things.write(spark.range(5000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")))
    before = set(files.names(spark, f"{things.path}/*"))
    things.upsert(table(spark, [("7", -7), ("x", 1)]))
    (delta,) = [f for f in set(files.names(spark, f"{things.path}/*")) - before if f.startswith("delta")]
    assert spark.read.parquet(f"{things.path}/{delta}").count() == 2
    assert things.rows().count() == 5001 and contents(things.lookup(table(spark, [("7", 0)]))) == {"7": -7}
    assert things.compact(0.5) == []  # two rows are few beside their base


def test_a_reader_keeps_its_snapshot(spark, things):
    things.write(table(spark, [("a", 1), ("b", 2)]))
    snapshot = things.rows()
    things.upsert(table(spark, [("a", 3)]))
    things.delete(table(spark, [("b", 0)]))
    things.compact(0.0)
    assert contents(snapshot) == {"a": 1, "b": 2} and contents(things.rows()) == {"a": 3}


def test_unfinished_and_concurrent_versions(spark, things):
    things.write(table(spark, [("a", 1)]))
    before = things._manifest()
    things.upsert(table(spark, [("a", 2)]))
    with pytest.raises(Exception, match="exist"):
        things._delta(before, table(spark, [("a", 9)]).withColumn("_deleted", F.lit(False)))
    assert contents(things.rows()) == {"a": 2}
    files.create_text(spark, f"{things.path}/manifest-{99:012d}.json", '{"version": 99, "sch')
    assert contents(things.rows()) == {"a": 2}


def test_rows_that_are_refused(spark, tmp_path, things):
    with pytest.raises(Exception, match="no key"):
        things.write(table(spark, [(None, 1)]))
    vectors = store.Collection(spark, str(tmp_path / "v"), 2)
    one = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0])], "chunk_id string, embedding array<double>")
    vectors.write(one.coalesce(1))
    assert [r["embedding"] for r in vectors.rows().collect()] == [[3.0, 4.0]]
    for wrong in ([1.0], None):
        with pytest.raises(Exception, match="dimensions"):
            vectors.upsert(spark.createDataFrame([("a", wrong)], "chunk_id string, embedding array<double>"))
    vectors.upsert(one.limit(0))
    assert vectors.rows().count() == 1
