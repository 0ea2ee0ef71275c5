"""Noise and natural text of every length class, judged with the production bands."""

import base64
import random
import string

import pytest
import zstandard
from pyspark.sql import functions as F

SIZES = [150, 180, 200, 250, 300, 400, 500, 600, 1000, 1500, 2000, 4000, 8000, 20_000]


def verdict(text):
    from lodestar.llm.compression_bands import NAMES, Bands, judge

    bands = Bands()
    return dict(zip(NAMES, judge(text, bands, zstandard.ZstdCompressor(level=bands.level)), strict=True))


@pytest.mark.parametrize("size", SIZES)
def test_noise_is_rejected(size):
    rng = random.Random(size)
    letters = string.ascii_letters + string.digits
    printable = letters + string.punctuation
    for alphabet in (letters, printable):
        words = " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(3, 6))) for _ in range(size))[:size]
        assert verdict(words)["reason"] == "incompressible" and not verdict(words)["kept"]
    lines = base64.encodebytes(rng.randbytes(size)).decode()[:size]
    short = base64.b64encode(rng.randbytes(size)).decode()
    short = " ".join(short[i : i + 8] for i in range(0, len(short), 8))[:size]
    assert verdict(lines)["reason"] == verdict(short)["reason"] == "incompressible"
    assert verdict(lines)["n_bad_chunks"] == (-(-size // 4096) if size > 4096 else 0)  # the rest is a chunk too


def test_natural_text_is_compressible(spark, sf_dir):
    from lodestar.llm.compression_bands import compression_bands

    got = compression_bands(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert got.where(F.col("reason").isin("incompressible") | ((F.col("reason") == "chunks") & (F.col("ratio") > 0.3))).count() == 0
