"""The upsert against a plain version over Python lists, on the shop's clients and on awkward tables."""

import hashlib
import math
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestar.llm.keyed_upsert import files_of, joined_left, keyed, piece_starts, upsert, write_table
from lodestar.llm.queries import QUERIES

COLUMNS = ["source", "segment", "city", "balance"]


def crc(x):
    return zlib.crc32(str(x).encode())


def plain_upsert(table, winners, most, act):
    """``table``: key → row; ``winners``: key → change. → ``[(keys, rows of the file, rewritten)]`` and the table."""
    keys = sorted(table)
    files = [keys[i : i + most] for i in range(0, len(keys), most)]
    homes = {}
    for key in winners:
        below = [i for i, f in enumerate(files) if f[0] <= key]
        homes.setdefault(below[-1] if below else 0, []).append(key)
    out = []
    for i, own in enumerate(files):
        after = {k: dict(table[k]) for k in own}
        for key in homes.get(i, []):
            what = act(files[i][0], winners[key])
            if what == "delete":
                after.pop(key, None)
            elif what == "set":
                after.setdefault(key, {c: None for c in table[own[0]]} | {"client_id": key}).update({c: winners[key][c] for c in COLUMNS})
        if after == {k: table[k] for k in own}:
            out.append([own, after, False])
            continue
        left = sorted(after)
        parts = -(-len(left) // most)
        at = 0
        for k in range(parts):
            n = len(left) // parts + (k < len(left) % parts)
            chunk = left[at : at + n]
            at += n
            out.append([chunk, {x: after[x] for x in chunk}, True])
    merged = []
    for keys_, rows, rewritten in out:
        if merged and rewritten and merged[-1][2] and len(merged[-1][0]) + len(keys_) <= most:
            merged[-1] = [merged[-1][0] + keys_, merged[-1][1] | rows, True]
        else:
            merged.append([keys_, rows, rewritten])
    return merged


def last_changes(rows):
    found = {}
    for r in rows:
        if r["client_id"] is not None:
            low = lambda x: (x is not None, x)
            rank = (low(r["seq"]), low(r["change_id"]))
            if r["client_id"] not in found or rank > found[r["client_id"]][0]:
                found[r["client_id"]] = (rank, r)
    return {k: v[1] for k, v in found.items()}


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query_matches_plain_version(spark, sf_dir, size):
    folder = Path(sf_dir).parent / f"sf{size}"
    if not (folder / "clients.parquet").exists():
        pytest.skip("no shop tables")
    clients = [r.asDict() for r in spark.read.parquet(f"{folder}/clients.parquet").collect()]
    winners = last_changes(r.asDict() for r in spark.read.parquet(f"{folder}/client_changes.parquet").collect())
    most = 1 + len(clients) // 700

    def act(first, change):
        h = crc(first) % 12
        if h <= 7:
            return "delete" if change["op"] == "D" or crc(change["change_id"]) % 8 < h else "set"

    table = {c["client_id"]: c for c in clients if crc(c["client_id"]) % 7 > 3}
    want = []
    for keys, rows, rewritten in plain_upsert(table, winners, most, act):
        cents = sum(math.floor(100 * r["balance"] + 0.5) for r in rows.values() if r["balance"] is not None)
        sums = sum(crc("|".join(r[c] or "" for c in ("source", "segment", "city"))) for r in rows.values())
        want.append((keys[0], len(keys), cents, sums, hashlib.sha256(",".join(map(str, keys)).encode()).hexdigest(), ",".join(clients[0]), rewritten))
    got = QUERIES["op11_keyed_upsert"](spark, str(folder)).collect()
    names = ["first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "rewritten"]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(want)
    assert {w[-1] for w in want} == {True, False}
    there = {p.as_uri() for p in Path(got[0].path.removeprefix("file://")).parent.glob("*.parquet")}
    assert there == {r.path for r in got}


def test_piece_starts_at_any_keys(spark):
    rng = random.Random(1)
    for low, high, n in ((0, 0, 1), (-5, 5, 8), (0, 10**4, 700), (-(1 << 63), (1 << 63) - 1, 900)):
        keys = {1: sorted({rng.randint(low, high) for _ in range(n)} | {low, high}), 2: [low]}
        plan = [(1, 7, 0), (2, 1, 0)] if n != 8 else [(1, len(keys[1]) // 3, len(keys[1]) % 3), (2, 1, 0)]
        df = spark.createDataFrame([(p, k) for p, ks in keys.items() for k in ks], "part long, key long").repartition(3)
        got = {(r.part, r.piece): r["first"] for r in piece_starts(df, spark.createDataFrame(plan, "part long, size long, larger long"), low, high).collect()}
        want = {}
        for part, size, larger in plan:
            at = k = 0
            while at < len(keys[part]):
                want[part, k] = keys[part][at]
                at, k = at + size + (k < larger), k + 1
        assert got == want


def test_neighbours_join_as_they_grow():
    assert joined_left([(2, True), (2, True), (2, True), (1, False), (1, True), (3, True), (1, True)], 5) == [[0, 1], [2], [3], [4, 5, 6]]
    assert joined_left([], 5) == []


def run(spark, tmp_path, name, rows, changes, most, order=("seq",)):
    """One column ``v`` set by changes ``(id, seq, v, op)``; → ``[(ids and values, rewritten)]``."""
    folder = f"file://{tmp_path}/{name}"
    table = spark.createDataFrame(rows, "id long, v string, `_file` int")
    files = write_table(table, "id", most, folder)
    act = lambda home: F.when(F.col("op") == "D", "delete").when(F.col("op") == "U", "set")
    after = upsert(spark, folder, files, table.schema, spark.createDataFrame(changes, "id long, seq long, v string, op string"), "id", list(order), ["v"], most, act)
    if after:
        assert [(f.first, f.rows, f.path) for f in files_of(spark, folder, "id")] == [(f.first, f.rows, f.path) for f in after]
    out = []
    for f in after:
        read = spark.read.parquet(f.path)
        assert read.columns == ["id", "v", "_file"]
        out.append(([(r.id, r.v) for r in read.collect()], f.rewritten))
    return out


def test_awkward_tables(spark, tmp_path):
    rows = [(i, f"v{i}", 1) for i in range(0, 20, 2)]
    same = [(2, 1, "v2", "U"), (3, 1, None, "D"), (99, 1, "x", None), (None, 1, "x", "U")]
    untouched = [([(i, f"v{i}") for i in ids], False) for ids in ([0, 2, 4, 6], [8, 10, 12, 14], [16, 18])]
    assert run(spark, tmp_path, "same", rows, same, 4) == untouched
    assert run(spark, tmp_path, "none", rows, [], 4) == untouched
    # Nulls are set, ids below the first file come home to it, the last of a key's changes wins, files split and vanish.
    changes = [(-1, 1, None, "U"), (2, 1, "old", "U"), (2, 2, None, "U"), (0, None, "never", "U"), (0, 0, "v0", "U")] + [(k, 1, None, "D") for k in (8, 10, 12, 14)]
    got = run(spark, tmp_path, "mixed", rows, changes, 4)
    assert got == [([(-1, None), (0, "v0"), (2, None)], True), ([(4, "v4"), (6, "v6")], True), untouched[2]]
    # A third of all changes and all new keys at one home.
    many = [(100 + k % 50, k, f"n{k}", "U") for k in range(300)]
    got = run(spark, tmp_path, "hot", rows, many, 4)
    assert got[:2] == untouched[:2] and sum(len(f) for f, _ in got) == 60 and {len(f) for f, _ in got[2:]} <= {3, 4}
    # Empty tables, all rows deleted, repeated and null keys.
    assert run(spark, tmp_path, "empty", [], [], 4) == []
    assert run(spark, tmp_path, "first", [], [(5, 1, "a", "U"), (7, 1, "b", "U"), (6, 1, "c", "D")], 1) == [([(5, "a")], True), ([(7, "b")], True)]
    assert run(spark, tmp_path, "gone", rows, [(i, 1, None, "D") for i in range(20)], 4) == []
    assert run(spark, tmp_path, "ties", [(1, "a", 1), (1, "b", None), (None, "c", 2), (1, "b", 0)], [], 4) == [([(1, "b")], False)]


def test_keyed_leaves_unique_rows_alone(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    assert sorted(map(tuple, keyed(rows, "id").collect())) == [(1, "a"), (2, None)]
