"""Versions of tables: what readers see, what is rewritten, and what is appended once."""

import pytest
from pyspark.sql import functions as F

from lodestar.sources import snapshots as S
from lodestar.sources.tables import Refused


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    old = spark.createDataFrame([(i, f"v{i}") for i in range(200)] + [(None, "null key")], "id long, v string")
    S.create_snapshot(old, folder, ["id"], buckets=16)
    before = S.manifest(spark, folder)
    new = spark.createDataFrame([(3, "new"), (3, "newer"), (1000, None)], "id long, v string")
    assert S.upsert_snapshot(new, folder, [F.desc("v")]) == 1
    after = S.manifest(spark, folder)
    changed = {b for b in {*before["files"], *after["files"]} if before["files"].get(b) != after["files"].get(b)}
    assert 1 <= len(changed) <= 2
    want = [(i, "newer" if i == 3 else f"v{i}") for i in range(200)] + [(None, "null key"), (1000, None)]
    assert sorted(map(str, rows2(S.read_snapshot(spark, folder)))) == sorted(map(str, want))
    assert S.read_snapshot(spark, folder, 0).count() == 201
    assert S.upsert_snapshot(new.limit(0), folder) == 1
    assert S.repair_snapshot(spark.createDataFrame([(3, "fixed"), (4, "unasked")], "id long, v string"), folder, F.col("v") == "newer") == 2
    assert rows(S.read_snapshot(spark, folder).where("id IN (3, 4)")) == [(3, "fixed"), (4, "v4")]


def rows2(df):
    return [tuple(r) for r in df.collect()]


def test_failed_and_rival_writes_leave_the_version(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    S.create_snapshot(spark.createDataFrame([(1, "a")], "id long, v string"), folder, ["id"])
    broken = spark.createDataFrame([(1, "b")], "id long, v string").withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        S.upsert_snapshot(broken, folder)
    assert rows(S.read_snapshot(spark, folder)) == [(1, "a")] and S.versions(spark, folder) == [0]
    with pytest.raises(S.Conflict):
        S._commit(spark, folder, 0, {})
    assert rows(S.read_snapshot(spark, folder)) == [(1, "a")]
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, f"file://{tmp_path}/none")


def test_batches_are_appended_once_or_not_at_all(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    batch = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string")
    assert S.append_once(batch("a", None), folder, "one", ["text"])
    assert not S.append_once(batch("a", None), folder, "one", ["text"])
    with pytest.raises(Refused, match="email: 1 rows"):
        S.append_once(batch("fine", "x jane@example.com"), folder, "two", ["text"])
    assert S.append_once(batch("b"), folder, "two", ["text"])
    assert sorted(str(r[0]) for r in S.read_snapshot(spark, folder).collect()) == ["None", "a", "b"]


def test_stream_is_appended_once_over_restarts(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    spark.range(5).selectExpr("CAST(id AS string) AS text").write.json(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema("text string").json(f"{tmp_path}/in")
    for more in (5, 7):
        run = S.append_stream(source(), folder, f"{tmp_path}/checkpoint", "log", ["text"])
        assert run.awaitTermination(120)
        assert S.read_snapshot(spark, folder).count() == more
        spark.range(2).selectExpr("concat('n', id) AS text").write.mode("append").json(f"{tmp_path}/in")
    # A batch that is replayed after its commit was lost.
    assert not S.append_once(spark.createDataFrame([("again",)], "text string"), folder, "log", number=1)
    assert S.read_snapshot(spark, folder).count() == 7
