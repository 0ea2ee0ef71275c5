"""Which names of a roster of any size a text may hold: told by a sketch in every task, then by a join on the names.

Every name and surname is a pattern. Windows of a text as long as a pattern are looked up in a bitmap of at most 32 MB;
those that are found, nearly all of them rightly, are joined with the patterns. No task holds the roster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.redaction import _plain, redactor
from lodestar.operators.retrieval import checked_queries
from lodestar.sources.shared import written

#: Bits of the bitmap for each pattern, and the powers of two of its fewest and most bits; bits of one slice.
BITS, LEAST, MOST, SLICE = 32, 16, 28, 20
#: Bytes of text that are looked through together, about.
BYTES = 1 << 20
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
MIXES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
SEPARATOR = b"\xff"


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1), base, np.uint64)])


class Windows:
    """Hashes of the windows of some bytes: differences of running sums, so that any length takes a few operations."""

    def __init__(self, data: bytes) -> None:
        found = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        self.sums = np.r_[np.uint64(0), np.cumsum(found * _powers(BASE, len(found))[: len(found)])]
        self.back = _powers(INVERSE, len(found))

    def bits(self, starts: np.ndarray | slice, ends: np.ndarray | slice, size: np.ndarray | int, power: int) -> list[np.ndarray]:
        """The two places in a bitmap of ``2 ** power`` bits of each window."""
        found = (self.sums[ends] - self.sums[starts]) * self.back[starts] + np.atleast_1d(size).astype(np.uint64) * np.uint64(BASE)
        return [((found ^ (found >> np.uint64(29))) * np.uint64(m)) >> np.uint64(64 - power) for m in MIXES]


def patterns_of(roster: DataFrame) -> DataFrame:
    """``(pattern, name)`` of a one-column roster: each name and its surname, as in :func:`redaction.roster_automaton`."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [n.strip() for n in batch["name"] if n and n.strip()]
            yield pd.DataFrame([(_plain(p), n) for n in names for p in {n, n.split()[-1]}], columns=["pattern", "name"])

    return roster.toDF("name").where("name IS NOT NULL").mapInPandas(split, "pattern string, name string").distinct()


def _sketch(patterns: DataFrame, power: int) -> np.ndarray:
    """The bitmap of all patterns, made in slices."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            coded = [p.encode() for p in batch["pattern"]]
            sizes = np.array([len(c) for c in coded], np.int64)
            ends = np.cumsum(sizes)
            found = np.concatenate(Windows(b"".join(coded)).bits(ends - sizes, ends, sizes, power)).astype(np.int64)
            yield pd.DataFrame({"slice": found >> SLICE, "place": found & ((1 << SLICE) - 1)})

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << min(power, SLICE), np.uint8)
        bits[rows["place"].to_numpy()] = 1
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(1 << (power - 3), np.uint8)
    slices = patterns.select("pattern").mapInPandas(places, "slice long, place long").distinct().groupBy("slice").applyInPandas(packed, "slice long, bits binary")
    for r in slices.toLocalIterator():
        part = np.frombuffer(bytes(r.bits), np.uint8)
        out[r.slice * len(part) : (r.slice + 1) * len(part)] = part
    return out


def names_of_texts(texts: DataFrame, roster: DataFrame) -> DataFrame:
    """``texts(key, text)`` → ``(key, names)``: the names of which a text may hold the whole or the surname; texts that
    hold none have no row."""
    patterns = written(patterns_of(roster), "roster-patterns")
    about = patterns.agg(F.count("*").alias("n"), F.collect_set(F.octet_length("pattern")).alias("sizes")).first()
    power = min(max((about.n * BITS).bit_length(), LEAST), MOST)
    sent = texts.sparkSession.sparkContext.broadcast((_sketch(patterns, power), sorted(about.sizes)))

    def found(data: bytes) -> Iterator[tuple[int, int]]:
        bitmap, sizes = sent.value
        windows = Windows(data)
        for size in sizes:
            n = len(data) - size + 1
            if n < 1:
                break
            one, two = windows.bits(slice(0, n), slice(size, size + n), size, power)
            held = lambda b: bitmap[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1
            at = np.flatnonzero(held(one))
            yield from ((int(i), size) for i in at[held(two[at]) == 1])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, all_texts, at = batch.column("key").to_pylist(), batch.column("text").to_pylist(), 0
            while at < len(keys):
                coded, total, first = [], 0, at
                while at < len(keys) and total < BYTES:
                    coded.append(_plain(all_texts[at] or "").encode())
                    total += len(coded[-1])
                    at += 1
                starts, data = np.cumsum([0, *(len(c) + 1 for c in coded)]), SEPARATOR.join(coded)
                out = set()
                for i, size in found(data):
                    window = data[i : i + size]
                    if SEPARATOR not in window:
                        out.add((keys[first + int(np.searchsorted(starts, i, "right")) - 1], window.decode(errors="replace")))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([p for _, p in out], pa.string())], names=["key", "pattern"])

    maybe = texts.select("key", "text").mapInArrow(look, "key long, pattern string")
    return maybe.join(patterns, "pattern").groupBy("key").agg(F.collect_set("name").alias("names"))


def redact_by_roster(rows: DataFrame, text: str, roster: DataFrame, salt: bytes, out: str = "redacted") -> DataFrame:
    """``rows`` with ``out: struct<text, counts>``: :func:`redaction.redact` with every name of a one-column roster. Names
    that a text does not hold do nothing to it, so those found are enough."""
    keyed = rows.withColumn("_key", F.xxhash64(*rows.columns))
    named = written(names_of_texts(keyed.select(F.col("_key").alias("key"), F.col(text).alias("text")), roster), "names-of-texts")
    joined = keyed.join(checked_queries(named), F.col("_key") == F.col("key"), "left")
    return joined.withColumn(out, redactor(salt)(F.col(text), F.col("names"))).select(*rows.columns, out)
