"""Subset sums of orders with many lines."""

from collections import defaultdict


def test_every_order_has_its_sums(spark, sf_dir):
    from lodestar.plans.registry import QUERIES

    lines = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_extendedprice").collect():
        lines[r[0]].append(round(r[1] * 100))
    assert max(map(len, lines.values())) > 7
    want = {}
    for key, cents in lines.items():
        sums = {0}
        for x in cents:
            sums |= {s + x for s in sums}
        want[key] = (len(sums), max(sums))
    assert {r[0]: (r[1], r[2]) for r in QUERIES["estimate_subset_sums"](spark, sf_dir).select("l_orderkey", "n_sums", "largest").collect()} == want
