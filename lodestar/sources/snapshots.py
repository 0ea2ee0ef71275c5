"""Tables whose versions are committed as a whole: upserts that rewrite touched buckets only, and appends that happen once.

A version is a manifest: the files of every bucket, and which batches are in. Files are written first, under names that
no manifest has; then the manifest appears in one step, under the next number, which only one writer gets. Readers go by
the last manifest, so a write that fails leaves at most files that nobody reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.redaction import LEAKS, leaks
from lodestar.sources.shared import hadoop
from lodestar.sources.tables import Refused, latest_wins


class Conflict(RuntimeError):
    """Another writer has committed this version; read again and try again."""


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the committed versions, in order; none of a folder without a table."""
    _, at, system = hadoop(spark, f"{folder}/versions")
    names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """A version's manifest, the last by default. Its size follows the number of files, never of rows."""
    known = versions(spark, folder)
    if not known:
        raise FileNotFoundError(f"no table in {folder}")
    number = known[-1] if version is None else version
    rows = spark.read.text(f"{folder}/versions/{number:010d}.json", wholetext=True)
    return json.loads(rows.first()[0])


def _commit(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Make the manifest visible in one step: a rename that fails if the version is there."""
    jvm, staged, system = hadoop(spark, f"{folder}/staged/{uuid.uuid4().hex}.json")
    _, target, _ = hadoop(spark, f"{folder}/versions/{number:010d}.json")
    system.mkdirs(target.getParent())
    out = system.create(staged, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(staged, target, kinds)
    except Exception as e:
        system.delete(staged, False)
        raise Conflict(f"version {number} of {folder} is there already") from e


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _stage(rows: DataFrame, folder: str) -> tuple[str, dict[str, list[str]]]:
    """Write rows by ``_bucket`` to files of their own: ``(their folder, paths by bucket)``."""
    spark, place = rows.sparkSession, f"{folder}/data/{uuid.uuid4().hex}"
    rows.repartition("_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(place)
    _, at, system = hadoop(spark, place)
    found: dict[str, list[str]] = {}
    for part in system.listStatus(at):
        name = part.getPath().getName()
        if name.startswith("_bucket="):
            files = [f.getPath().toString() for f in system.listStatus(part.getPath())]
            found[name.removeprefix("_bucket=")] = [f for f in files if f.endswith(".parquet")]
    return place, found


def _read(spark: SparkSession, content: dict, buckets: set[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(content["schema"])
    paths = [p for b, files in content["files"].items() if buckets is None or b in buckets for p in files]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last by default, whatever is being written meanwhile."""
    return _read(spark, manifest(spark, folder, version))


def create_snapshot(rows: DataFrame, folder: str, keys: Sequence[str] = (), buckets: int = 32) -> int:
    """Version 0 of a table keyed by ``keys``, or of a log without keys."""
    dealt = rows.withColumn("_bucket", _bucket(keys, buckets) if keys else F.lit(0))
    _, files = _stage(dealt, folder)
    _commit(rows.sparkSession, folder, 0, {"schema": json.loads(rows.schema.json()), "keys": list(keys), "buckets": buckets, "files": files, "batches": {}})
    return 0


def upsert_snapshot(new: DataFrame, folder: str, order: Sequence[Column] = ()) -> int:
    """Put the rows of ``new`` in place of those with their keys and return the new version.

    Of several new rows with one key the first by ``order`` counts; an old row never wins over a new one. Only buckets
    that a new row falls in are read and written; no new rows make no version.
    """
    spark = new.sparkSession
    held = versions(spark, folder)[-1]
    content = manifest(spark, folder, held)
    keys, count = content["keys"], content["buckets"]
    if not keys:
        raise ValueError("a log has no keys")
    fresh = latest_wins(new, keys, list(order) or [F.lit(1)]).withColumn("_bucket", _bucket(keys, count))
    touched = {str(r[0]) for r in fresh.select("_bucket").distinct().collect()}  # at most ``buckets`` numbers
    if not touched:
        return held
    kept = _read(spark, content, touched).join(fresh.select(*keys), keys, "left_anti")
    names = T.StructType.fromJson(content["schema"]).names
    both = kept.select(*names).withColumn("_bucket", _bucket(keys, count)).unionByName(fresh.select(*names, "_bucket"))
    _, files = _stage(both, folder)
    _commit(spark, folder, held + 1, content | {"files": {b: f for b, f in content["files"].items() if b not in touched} | files})
    return held + 1


def repair_snapshot(again: DataFrame, folder: str, failed: Column) -> int:
    """Rows of the table that ``failed`` get their second try from ``again``, if there is one; all others stay."""
    spark = again.sparkSession
    content = manifest(spark, folder)
    bad = _read(spark, content).where(failed).select(*content["keys"]).distinct()
    return upsert_snapshot(again.join(bad, content["keys"], "left_semi"), folder)


def append_once(rows: DataFrame, folder: str, batch: str, texts: Sequence[str] = (), kinds: Sequence[str] = LEAKS, number: int | None = None) -> bool:
    """Append a batch to a log, and say whether it was: one that is in already is not appended again.

    The rows are worked out once, into files of their own; these are checked, and only if no identifier is left in any of
    ``texts`` does a new version have them, so nothing is appended but the whole batch. ``number``: batches of this name
    come in ascending numbers, of which the last is remembered.
    """
    spark = rows.sparkSession
    known = versions(spark, folder)
    if not known:
        create_snapshot(rows.limit(0), folder)
        known = [0]
    content = manifest(spark, folder, known[-1])
    batches = content["batches"]
    if batch in batches and (number is None or number <= batches[batch]):
        return False
    place, files = _stage(rows.withColumn("_bucket", F.lit(0)), folder)
    staged = _read(spark, content | {"files": files})
    if texts:
        found = F.array_distinct(F.flatten(F.array(*[leaks(F.col(c), kinds) for c in texts])))
        bad = sorted((r["kind"], r["count"]) for r in staged.select(F.explode(found).alias("kind")).groupBy("kind").count().collect())
        if bad:
            _, at, system = hadoop(spark, place)
            system.delete(at, True)
            raise Refused("; ".join(f"{kind}: {n} rows" for kind, n in bad))
    merged = {b: [*content["files"].get(b, []), *files.get(b, [])] for b in {*content["files"], *files}}
    _commit(spark, folder, known[-1] + 1, content | {"files": merged, "batches": batches | {batch: -1 if number is None else number}})
    return True


def append_stream(stream: DataFrame, folder: str, checkpoint: str, name: str, texts: Sequence[str] = ()):
    """A started query that appends each micro-batch of ``stream`` once, over restarts too; see :func:`append_once`."""
    put = lambda rows, number: append_once(rows, folder, name, texts, number=number)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
