"""Whether an amount is the sum of some of a claim's lines, and how many such sums there are, without listing subsets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines up to which sums meet in the middle: each half has at most 2²⁰ of them. More lines go by a bitset over amounts.
HALVED = 40
#: Lines up to which claims with as many are judged together, all their sums side by side, and so many sums at a time.
LISTED, SUMS = 16, 1 << 20
#: Below this total of absolute lines no sum leaves a long.
SAFE = 2.0**62
#: Bits of a bitset at most: 128 MB.
MOST_BITS = 1 << 30


def half_sums(lines: Sequence[int]) -> np.ndarray:
    """The distinct sums of subsets, sorted; doubled line by line."""
    sums = np.zeros(1, np.int64)
    for x in lines:
        sums = np.union1d(sums, sums + x)
    return sums


def bitset(lines: Sequence[int]) -> tuple[int, int]:
    """``(bits, offset)``: bit ``s + offset`` is set if ``s`` is a sum; a line shifts the set and joins it."""
    offset = -sum(x for x in lines if x < 0)
    if offset + sum(x for x in lines if x > 0) >= MOST_BITS:
        raise ValueError(f"{len(lines)} lines span more than {MOST_BITS} amounts")
    bits = 1 << offset
    for x in lines:
        bits |= bits << x if x >= 0 else bits >> -x
    return bits, offset


@lru_cache(maxsize=4)
def _halves(lines: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    middle = len(lines) // 2
    return half_sums(lines[:middle]), half_sums(lines[middle:])


def is_sum(lines: Sequence[int], amount: int) -> bool:
    """Whether some of ``lines``, none included, add up to ``amount``.

    The sums of both halves are sorted, and one runs up while the other runs down: every sum of the first half is looked
    for as what it lacks to the amount.
    """
    lines = tuple(sorted(int(x) for x in lines))
    if len(lines) > HALVED:
        bits, offset = bitset(lines)
        return amount + offset >= 0 and bool(bits >> (amount + offset) & 1)
    low, high = _halves(lines)
    lacking = (amount - low)[::-1]
    at = np.searchsorted(high, lacking)
    return bool((high[np.minimum(at, len(high) - 1)] == lacking).any())


def _listed(lines: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    """``lines[line, claim]``, ``amounts[claim]`` → whether an amount is among all sums of its claim's lines."""
    n, found = len(lines), np.zeros(len(amounts), bool)
    step = max(1, SUMS >> n)
    for at in range(0, len(amounts), step):
        some, amount = lines[:, at : at + step], amounts[at : at + step]
        sums = np.zeros((1 << n, len(amount)), np.int64)
        for j in range(n):
            np.add(sums[: 1 << j], some[j], out=sums[1 << j : 2 << j])
        found[at : at + step] = (sums == amount).any(axis=0)
    return found


def judged(lines: pa.Array, amounts: pa.Array) -> pa.Array:
    """:func:`is_sum` of each row of ``lines`` (lists of longs) and ``amounts``; null where either is. Null lines are none.

    Rows with up to ``LISTED`` lines are judged together with those that have as many; the others one by one, and rows
    of one claim that follow each other share their half sums, and the answer where they ask for one amount.
    """
    asked = lines.is_valid().to_numpy(zero_copy_only=False) & amounts.is_valid().to_numpy(zero_copy_only=False)
    row, values = lines.value_parent_indices().to_numpy(zero_copy_only=False), lines.flatten()
    given = values.is_valid().to_numpy(zero_copy_only=False)
    row, values = row[given], values.drop_null().to_numpy(zero_copy_only=False)
    amount = amounts.fill_null(0).to_numpy(zero_copy_only=False)
    counts = np.bincount(row, minlength=len(lines))
    begins = np.cumsum(counts) - counts
    total = np.bincount(row, weights=np.abs(values.astype(float)), minlength=len(lines))
    together = asked & (counts <= LISTED) & (total < SAFE)
    out = np.zeros(len(lines), bool)
    for n in np.unique(counts[together]).tolist():
        rows = np.flatnonzero(together & (counts == n))
        out[rows] = _listed(values[begins[rows] + np.arange(n)[:, None]], amount[rows])
    last, known = None, {}
    for i in np.flatnonzero(asked & ~together).tolist():
        own, a = values[begins[i] : begins[i] + counts[i]].tolist(), int(amount[i])
        if own != last:
            last, known = own, {}
        if a not in known:
            known[a] = is_sum(own, a)
        out[i] = known[a]
    return pa.array(out, mask=~asked)


@F.arrow_udf(T.BooleanType())
def is_subset_sum(lines: pa.Array, amount: pa.Array) -> pa.Array:
    """``(array<long>, long)`` → whether the amount is a sum of some lines; null where either is. Null lines are none."""
    return judged(lines, amount)


@F.pandas_udf(T.StructType([T.StructField("n_sums", T.LongType()), T.StructField("largest", T.LongType())]))
def subset_sum_size(lines: pd.Series) -> pd.DataFrame:
    """``array<long>`` → the number of distinct sums of some lines, and the largest of them."""

    def size(xs) -> tuple[int, int]:
        xs = [int(x) for x in xs if x is not None]
        largest = sum(x for x in xs if x > 0)
        spread = sum(map(abs, xs))
        # A set with a bit for each amount is small beside 2ⁿ sums, unless the lines are few.
        n = bitset(xs)[0].bit_count() if len(xs) > 12 and spread < MOST_BITS else len(half_sums(xs))
        return n, largest

    return pd.DataFrame([(None, None) if x is None else size(x) for x in lines], columns=["n_sums", "largest"], dtype="Int64")
