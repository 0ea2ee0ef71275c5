"""Copy-on-write upserts into Parquet files sorted by key: exact splitters from key-range histograms, no global sort.

A table is a folder of files that follow each other by key. Its splitters, the first key of every file, are found
exactly by counting: a histogram over key ranges, then another over those ranges alone that hold a wanted rank, until
each holds one key. The splitters deal the rows to files, which are sorted one by one, and they are the index that
gives each change its home file. Only files whose rows differ after the merge join are written again.

What is kept on the driver is the manifest, a row for each file: at most ``MOST_FILES``, which is checked. Rows, keys
and changes stay in Spark.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import cut, delete, drop_cut, open_shared

#: Files of a table: its splitters are 8 bytes each wherever they go.
MOST_FILES = 1 << 20
#: Each histogram splits a key range into at most ``2 ** BITS``.
BITS = 10
SIGN = -(1 << 63)


@dataclass(frozen=True)
class DataFile:
    """A file of a table: its smallest key, its number of rows, where it is, and whether an upsert wrote it."""

    first: int
    rows: int
    path: str
    rewritten: bool = False


def _pieces_before(rank: str) -> str:
    """How many pieces of a part begin below ``rank``: the first ``larger`` have ``size + 1`` rows, the others ``size``."""
    return f"IF({rank} <= larger * (size + 1), ({rank} + size) div (size + 1), larger + ({rank} - larger * (size + 1) + size - 1) div size)"


def piece_starts(keys: DataFrame, plan: DataFrame, low: int, high: int) -> DataFrame:
    """The exact first key of every piece: ``keys(part, key)``, ``plan(part, size, larger)`` → ``(part, piece, first)``.

    Keys are 64-bit integers between ``low`` and ``high``, each once in a part. In order of key, a part's first
    ``larger`` pieces have ``size + 1`` keys and the others ``size``. Every pass counts the keys by the next ``BITS``
    bits and goes on with the ranges in which a piece begins, so it takes as many passes as the bits in which the keys
    differ need. Counts combine before their shuffle; a range has at most ``2 ** BITS`` ranges below it, so no key range
    is a hot group, however dense.
    """
    raised = F.col("key").bitwiseXOR(F.lit(SIGN))
    shift = (low ^ high).bit_length() if (low < 0) == (high < 0) else 64
    above, state = F.lit(0).cast("long"), plan.withColumn("above", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    while True:
        shift = max(0, shift - BITS)
        below = F.shiftrightunsigned(raised, shift)
        counts = keys.groupBy("part", above.alias("above"), below.alias("below")).agg(F.count("*").alias("n"))
        here = counts.join(state, ["part", "above"]).withColumn("before", F.expr("before + coalesce(sum(n) OVER (PARTITION BY part, above ORDER BY below ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
        here = here.where(f"{_pieces_before('(before + n)')} > {_pieces_before('before')}")
        then, state = state, cut(here.select("part", "size", "larger", F.col("below").alias("above"), "before"), "key-ranges")
        drop_cut(then)
        if shift == 0:
            return state.select("part", F.expr(_pieces_before("before")).alias("piece"), F.col("above").bitwiseXOR(F.lit(SIGN)).alias("first"))
        above = F.shiftrightunsigned(raised, shift)


def _looked_up(key: Column, firsts: Sequence[int], values: Sequence[int]) -> Column:
    """The value of the last file that begins at or below the key, else of the first; null where there are no files."""
    if not len(firsts):
        return F.lit(None).cast("long")
    splitters, found = np.array(firsts, np.int64), np.array(values, np.int64)

    @F.pandas_udf("long")
    def look(keys: pd.Series) -> pd.Series:
        return pd.Series(found[np.maximum(np.searchsorted(splitters, keys.to_numpy(np.int64), side="right") - 1, 0)])

    return look(key)


def _checked(files: int) -> int:
    if files > MOST_FILES:
        raise ValueError(f"{files} files are more than {MOST_FILES}: give a file more rows")
    return files


def _write(rows: DataFrame, key: str, firsts: Sequence[int], folder: str) -> None:
    """A file for each splitter: the rows are dealt by the splitters and sorted file by file."""
    at = "_file"
    while at in rows.columns:
        at += "_"
    dealt = rows.withColumn(at, _looked_up(F.col(key), firsts, range(len(firsts))).cast("int")).repartitionById(len(firsts), F.col(at))
    dealt.sortWithinPartitions(key).drop(at).write.mode("append").option("compression", "zstd").parquet(folder)


def files_of(spark: SparkSession, folder: str, key: str) -> list[DataFile]:
    """The files of a table in order of key, as they are."""
    found = spark.read.parquet(folder).select(F.input_file_name().alias("path"), F.col(key).alias("key")).groupBy("path").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    return sorted((DataFile(r.first, r.n, r.path) for r in found.select("path", "first", "n").collect()), key=lambda f: f.first)


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` as a keyed table: rows without a key are left out, and of rows with one key the greatest by its other
    columns in order (null least) stays. Only where keys do repeat are whole rows shuffled for this."""
    rows = rows.where(F.col(key).isNotNull())
    if rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").limit(1).count() == 0:
        return rows
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns) if c != key]
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*others)).alias("_best"))
    return best.select(*[F.col("_key").alias(c) if c == key else F.col(f"_best.c{i}").alias(c) for i, c in enumerate(rows.columns)])


def write_table(rows: DataFrame, key: str, rows_per_file: int, folder: str) -> list[DataFile]:
    """Write ``rows`` in order of ``key``, a 64-bit integer, as files of ``rows_per_file`` rows; the last has the rest.

    See :func:`keyed` for null and repeated keys; nulls in other columns stay. No rows give no files.
    """
    rows = keyed(rows, key)
    n, low, high = rows.agg(F.count("*"), F.min(key), F.max(key)).first()
    if not n:
        return []
    _checked(-(-n // rows_per_file))
    plan = rows.sparkSession.createDataFrame([(0, rows_per_file, 0)], "part long, size long, larger long")
    starts = piece_starts(rows.select(F.lit(0).cast("long").alias("part"), F.col(key).cast("long").alias("key")), plan, low, high)
    firsts = sorted(r[0] for r in starts.select("first").collect())
    drop_cut(starts)
    _write(rows, key, firsts, folder)
    return files_of(rows.sparkSession, folder, key)


def joined_left(files: list[tuple[int, bool]], most: int) -> list[list[int]]:
    """Which files end up together: ``(rows, rewritten)`` in order of key → lists of their numbers.

    Ascending, a rewritten file joins what stands left of it, if that is rewritten too and both have at most ``most`` rows.
    """
    out: list[list[int]] = []
    size = 0
    for i, (rows, rewritten) in enumerate(files):
        if out and rewritten and files[out[-1][-1]][1] and size + rows <= most:
            out[-1].append(i)
            size += rows
        else:
            out.append([i])
            size = rows
    return out


def upsert(
    spark: SparkSession,
    folder: str,
    files: list[DataFile],
    schema: T.StructType,
    changes: DataFrame,
    key: str,
    order: Sequence[str],
    columns: Sequence[str],
    rows_per_file: int,
    decide: Callable[[Column], Column],
) -> list[DataFile]:
    """Apply the last change of each key to the table in ``folder`` and return its files.

    ``changes`` has ``key``, the columns ``order`` (the row with the highest values wins; among rows alike in these the
    greatest by all columns, null least) and the ``columns`` that it sets. ``decide(home's first key)`` says what the
    winning row does: ``set`` sets ``columns``, to null also, and inserts an absent key with its other columns null;
    ``delete`` removes the key; null leaves the change out. A key's home is the last file that begins at or below it, else the
    first; in a table without files all keys have one home, whose first key is null. Changes without a key are left out.

    A file whose rows are the same afterwards (nulls equal) stays as it is. The others are written again in the fewest
    files of at most ``rows_per_file`` rows, sizes at most one apart and larger first, and small neighbours join
    (:func:`joined_left`). Then the files that they replace are deleted; until that, new files are committed by Spark's
    writer as a whole. A failed run leaves the old files all there.

    Scale: a hot key's changes combine before their shuffle; the merge join is by key, so a home that gets any number of
    new keys is no group of one task; only files that are the home of a change are read.
    """
    firsts = [f.first for f in files]
    others = [c for c in changes.columns if c != key and c not in order]
    winners = changes.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg(F.max(F.struct(*order, *others)).alias("_c")).select(key, "_c.*")
    decided = winners.withColumn("_home", _looked_up(F.col(key), firsts, firsts))
    decided = decided.withColumn("_act", decide(F.col("_home"))).where("_act IS NOT NULL")
    decided = cut(decided.select(F.col(key).alias("_key"), "_act", F.struct(*columns).alias("_new")), "upsert-changes")
    home = _looked_up(F.col("_key"), firsts, firsts)
    asked = {r[0] for r in decided.select(home.alias("_home")).distinct().collect()}
    if not asked:
        drop_cut(decided)
        return files

    paths = [f.path for f in files if f.first in asked]
    old = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    old = old.select(F.col(key).cast("long").alias("_key"), F.struct(*[f"`{c}`" for c in schema.names]).alias("_old"))
    both = old.join(decided.hint("merge"), "_key", "full")
    own = lambda c: F.when(F.col("_act") == "set", F.col(f"_new.`{c}`").cast(schema[c].dataType)).otherwise(F.col(f"_old.`{c}`"))
    row = [(F.col("_key").cast(schema[c].dataType) if c == key else own(c) if c in columns else F.col(f"_old.`{c}`")).alias(c) for c in schema.names]
    same = F.col("_old").isNotNull()
    for c in columns:
        same = same & F.col(f"_old.`{c}`").eqNullSafe(own(c))
    changed = F.when(F.col("_act").isNull(), F.lit(False)).when(F.col("_act") == "delete", F.col("_old").isNotNull()).otherwise(~same)
    kept = F.coalesce(F.col("_act") != "delete", F.lit(True))
    merged = cut(both.select("_key", home.alias("_home"), kept.alias("_kept"), changed.alias("_changed"), F.struct(*row).alias("_row")), "upsert-merged")
    found = merged.groupBy("_home").agg(F.bool_or("_changed").alias("changed"), F.count_if("_kept").alias("n")).where("changed").collect()
    left = {r._home: r.n for r in found}

    pieces: list[tuple[int | None, int, int, bool]] = []  # home, number of the piece, rows, rewritten
    plan = []
    for first in firsts or [None]:
        n = left.get(first)
        if n is None and files:
            pieces.append((first, 0, 0, False))
        elif n:
            parts = -(-n // rows_per_file)
            plan.append((first, n // parts, n % parts))
            pieces += [(first, k, n // parts + (k < n % parts), True) for k in range(parts)]
    _checked(len(pieces))
    if plan:
        homes = spark.createDataFrame(plan, "part long, size long, larger long")
        rows = merged.where("_kept").join(F.broadcast(homes), F.col("_home").eqNullSafe(F.col("part")))
        # The only home of a table without files has no first key.
        keys = rows.select(F.coalesce("part", F.lit(0)).alias("part"), F.col("_key").alias("key"))
        low, high = keys.agg(F.min("key"), F.max("key")).first()
        starts = piece_starts(keys, homes.withColumn("part", F.coalesce("part", F.lit(0))), low, high)
        at = {(r.part, r.piece): r["first"] for r in starts.collect()}
        drop_cut(starts)
        groups = joined_left([(n, rewritten) for _, _, n, rewritten in pieces], rows_per_file)
        begins = [pieces[g[0]] for g in groups if pieces[g[0]][3]]
        _write(rows.select("_row.*"), key, [at[first or 0, k] for first, k, _, _ in begins], folder)
    for f in files:
        if f.first in left:
            delete(spark, f.path)
    drop_cut(decided), drop_cut(merged)
    stays = {f.path for f in files if f.first not in left}
    if not pieces:
        return []
    return [DataFile(f.first, f.rows, f.path, f.path not in stays) for f in files_of(spark, folder, key)]


DIGEST = "first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string, columns string, path string, rewritten boolean"


def file_digests(spark: SparkSession, files: list[DataFile], key: str, amount: str, texts: Sequence[str]) -> DataFrame:
    """What each file holds, read from the file itself, batch by batch: its first key, its number of rows, ``amount`` in
    cents (null and what is no number: 0), the sum of CRC-32 of ``texts`` joined by bars (null: empty), SHA-256 of its keys
    in order, and its columns' names."""

    def digest(path: str, rewritten: bool) -> dict:
        ids, first, n, cents, crc = hashlib.sha256(), None, 0, 0, 0
        with open_shared(path) as source:
            file = pq.ParquetFile(source)
            for batch in file.iter_batches(batch_size=65_536, columns=[key, amount, *texts]):
                keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
                if not keys:
                    continue
                ids.update((("," if n else "") + ",".join(map(str, keys))).encode())
                first, n = keys[0] if first is None else first, n + len(keys)
                value = batch.column(batch.schema.get_field_index(amount)).to_numpy(zero_copy_only=False).astype(float)
                cents += int(np.floor(100 * np.where(np.isfinite(value), value, 0.0) + 0.5).astype(np.int64).sum())
                parts = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in texts]
                crc += sum(zlib.crc32("|".join(x or "" for x in row).encode()) for row in zip(*parts, strict=True))
            names = ",".join(file.schema_arrow.names)
        return dict(first_id=first, n_rows=n, cents=cents, rows_crc=crc, ids_sha256=ids.hexdigest(), columns=names, path=path, rewritten=rewritten)

    def run(batches):
        for batch in batches:
            out = [digest(*x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(DIGEST))
    listed = spark.createDataFrame([(f.path, f.rewritten) for f in files], "path string, rewritten boolean")
    return listed.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, DIGEST)
