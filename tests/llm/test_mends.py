"""Cases that once lost rows or stopped early: stray vectors, entangled pairs, odd uris, unreadable records."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("seed", range(4))
def test_grammar_goes_on_until_no_pair_pays(seed):
    from lodestar.llm import repair_grammar as R

    rng = random.Random(seed)
    alphabet = [2, 900, 40_000][: rng.randint(1, 3)] if seed % 2 else list(range(12))
    docs = [[rng.choice(alphabet) for _ in range(rng.randint(0, 60))] for _ in range(80)] + [[15] * 6] + [[0, 732]] * 4 + [[7] * 5, []]
    ids, ends = np.array(sum(docs, []), np.uint32), np.cumsum([len(d) for d in docs])
    grammar = R.compress(ids, ends, 49_408)
    table = R.expansions(grammar.base, grammar.rules, grammar.spans)
    assert (R.expand(grammar.symbols, *table) == ids).all()
    left, at = Counter(), 0
    for end in grammar.ends:
        own, at = grammar.symbols[at : max(end, at)].tolist(), max(end, at)
        k = 0
        while k + 1 < len(own):  # of a run of one symbol every second pair can be replaced
            left[own[k], own[k + 1]] += 1
            k += 2 if own[k] == own[k + 1] and k + 2 < len(own) and own[k + 2] == own[k] else 1
    assert max(left.values()) < R.LEAST and len(grammar.rules) > 0


def test_rules_begin_above_the_vocabulary(spark, tmp_path):
    from lodestar.llm import repair_grammar as R

    docs = spark.createDataFrame([(i, f"same words again {i} and again") for i in range(20)], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert R.id_bound(path, 1) == 49_408 and R.id_bound(path, 70_000) == 70_001
    with pytest.raises(ValueError, match="rules cannot begin"):
        R.write_shards(docs, path, f"file://{tmp_path}/s", base=49_407)
    high = R.grammar_round_trip(docs, path, end_id=70_000).collect()
    assert len(high) == 20 and all(np.frombuffer(r.ids, "<u4")[-1] == 70_000 for r in high)


def test_white_space_in_uris_survives(spark, tmp_path):
    from lodestar.llm import warc_derivatives as W

    uris = ["http://h.org/a b\tc", "http://h.org/ x ", "  u\r\nWARC-Type: fake", "http://h.org/%20plain"]
    pages = spark.createDataFrame([(i, u, "<p>x</p>") for i, u in enumerate(uris)], "page_id long, url string, html string")
    made = W.derive(W.responses_of_pages(pages))
    back = W.read_derived(W.write_warc(made, f"file://{tmp_path}/w"))
    assert back.where("error IS NOT NULL").count() == 0
    found = {r.source_id: r.target_uri for r in back.where("record_type = 'metadata'").collect()}
    assert found == {r.source_id: r.target_uri for r in made.where("record_type = 'metadata'").collect()}
    assert found == {0: "http://h.org/a%20b%09c", 1: "http://h.org/%C2%A0x%20", 2: "%20%20u%0D%0AWARC-Type:%20fake", 3: "http://h.org/%20plain"}


def test_unreadable_record_stops_the_query(spark, sf_dir, monkeypatch):
    from lodestar.llm import queries as Q
    from lodestar.llm import warc_derivatives as W

    monkeypatch.setattr(Q, "read_derived", lambda files: W.read_derived(files, most_bytes=100))
    with pytest.raises(Exception, match="unreadable record"):
        Q.op9_warc_derivatives(spark, sf_dir).select("block").collect()


@pytest.mark.parametrize("stray", [-7, 5, 11, 1_000_000])
def test_stray_vectors_take_nothing_from_others(spark, stray):
    """Whichever place the stray vector has by hash; both lengths are searched."""
    from lodestar.llm.additive_quantisation import nearest

    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(0, 120)]
    odd = [(stray * 20, [1.0, 2.0, 3.0]), (2_000_001, [1.0, 0.0, 1.0])]
    df = spark.createDataFrame([r for r in rows if r[0] not in (stray * 20,)] + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, top=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    all_rows = {r.vec_id: np.array(r.embedding) for r in df.collect()}
    for q, v in all_rows.items():
        if q % 20 == 0:
            near = sorted((-float(v @ w), i) for i, w in all_rows.items() if i != q and len(w) == len(v))[:5]
            assert got[q] == [i for _, i in near]
    assert got[stray * 20] == [2_000_001]
    assert df.where(F.size("embedding") == 3).count() == 2


def test_no_dealt_row_moves_where_no_cell_is_crowded(spark):
    from lodestar.llm.simhash_popcount import _crowded

    dealt = spark.range(3_000).select((F.col("id") % 1_000 + (F.col("id") < 40).cast("long") * 10_000).alias("cell"), F.col("id").alias("fp"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    none = _crowded(dealt, 60, 3)
    assert none.collect() == [] and none.columns == ["cell", "n"] and "Exchange" not in plan(none)
    some = _crowded(dealt.unionByName(dealt.where("fp < 7")), 60, 3)
    assert some.collect() == [] and "Exchange" not in plan(some)
    many = _crowded(dealt.unionByName(dealt.where("fp BETWEEN 500 AND 506")), 60, 3)
    assert {(r.cell, r.n) for r in many.collect()} == {(c, 4) for c in range(500, 507)}
