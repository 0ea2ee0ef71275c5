"""Quality rules by compression: zstandard ratios of whole texts and of fixed chunks, held against bands.

Text that repeats itself compresses to almost nothing; noise does not compress. The ratio of natural text depends on
its length, so each length has limits of its own. One pass over the texts, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lodestar.llm.common import map_rows

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """``whole``: (UTF-8 bytes from which it holds, lowest and highest ratio of compressed to raw bytes).

    A zstandard frame adds 9 bytes of its own to what it cannot compress, so ratios of short texts go above 1. Below 112
    bytes natural text reaches the ratios of noise, and only repetition is told; below 24 bytes nothing is. ``chunk``:
    the limits for each full chunk of ``chunk_bytes``; the rest after the last one is judged by the limits of a whole
    text of its length. A text is rejected when more than ``chunk_share`` of its bytes lie in chunks outside. Each upper
    limit lies between what natural text of its length reaches and what words of random letters and digits begin at.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 10.0), (24, 0.80, 1.40), (32, 0.72, 1.30), (48, 0.65, 1.20), (64, 0.55, 1.15), (80, 0.50, 1.13), (96, 0.45, 1.10), (112, 0.40, 1.045),
        (128, 0.35, 0.945), (160, 0.35, 0.925), (192, 0.35, 0.895), (224, 0.35, 0.87), (256, 0.35, 0.86), (320, 0.35, 0.83), (384, 0.35, 0.81), (448, 0.35, 0.785),
        (512, 0.27, 0.75), (768, 0.27, 0.735), (1024, 0.27, 0.70), (2048, 0.22, 0.65), (8192, 0.18, 0.60),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.20, 0.65)
    chunk_share: float = 0.25
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        found = (0.0, float("inf"))
        for start, low, high in self.whole:
            if size >= start:
                found = (low, high)
        return found


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which is found twice or more, its first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    # Equal windows have equal hashes: where no hash repeats, no window does.
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x100000001B3) + mixed[k : k + n]
    ordered = np.sort(rolled)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # Exact: name pairs of names, doubling the width, so that two windows have one name only if all words agree.
    names, width = ids, 1
    while width < window:
        _, names = np.unique(names[:-width] * (int(names.max()) + 1) + names[width:], return_inverse=True)
        width *= 2
    _, names, counts = np.unique(names, return_inverse=True, return_counts=True)
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[names] > 1)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks) > 0).sum())


def _inside(ratio: float, limits: tuple[float, float]) -> bool:
    return limits[0] <= ratio <= limits[1]


def judge(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()  # of bytes: exactly the six ASCII white-space characters
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    repeat = repeated_words(words)
    chars = len(text) - sum(map(text.count, WHITE))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    ratio = len(packer.compress(raw)) / len(raw) if raw else None
    # Chunks: (bytes, ratio, limits); a text of one chunk or less is that chunk.
    pieces = [raw[at : at + bands.chunk_bytes] for at in range(0, len(raw), bands.chunk_bytes)] if len(raw) > bands.chunk_bytes else []
    bad = [len(x) for x in pieces if not _inside(len(packer.compress(x)) / len(x), bands.chunk if len(x) == bands.chunk_bytes else bands.limits(len(x)))]
    why = None
    if raw and not _inside(ratio, bands.limits(len(raw))):
        why = "repetitive" if ratio < bands.limits(len(raw))[0] else "incompressible"
    elif sum(bad) > bands.chunk_share * len(raw):
        why = "chunks"
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, not failed and why is None, len(raw), ratio, len(pieces), len(bad), why


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bytes", "ratio", "n_chunks", "n_bad_chunks", "reason")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, n_bad_chunks long, reason string"


def compression_bands(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its base counts, ratios and verdict.

    ``kept`` is false where ``base_failed``, else where the ratio of the whole text leaves its length's band, or chunks
    with too many of its bytes leave theirs; ``reason`` names the band. ``n_chunks`` counts the rest after the last full
    chunk as well, and is 0 for texts of one chunk or less, which the whole text's band has judged. A null or empty text counts as no words, has a null ratio and
    fails the base rules. Repeated rows and rows without an id are judged each by itself; an empty table gives an empty
    result; other columns are not read, whatever their names.
    """

    def make():
        packer = zstandard.ZstdCompressor(level=bands.level)

        def step(batch: pa.RecordBatch) -> dict:
            rows = [judge(x, bands, packer) for x in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0)} | dict(zip(NAMES, map(list, zip(*rows, strict=True)), strict=True))

        return step

    return map_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), f"doc_id long, {SCHEMA}", make)
