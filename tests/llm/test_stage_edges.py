"""The pipeline's stages in a row on hostile rows: null and repeated ids, null, empty and very long texts, clashing columns."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, component_id long, target double"


def hostile():
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    texts = [None, "", " ", "\n\n\n", "a", "one two three", long_text, "the same words in every copy of it\n" * 12]
    made = [(i, t, "en", ["s", None, "t"][i % 3], len(t or ""), "x", 7, 0.5) for i, t in enumerate(texts)]
    made += [(None, "a row without an id", None, None, 19, None, None, None), (None, None, None, None, None, None, None, None)]
    made += [made[5], made[5], (20, texts[7], "en", "s", len(texts[7]), "x", 7, 0.5)]
    return made


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder whose labels name none of the rows."""
    at = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(900, 0), (901, 1)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def after_each(spark, docs, sf_dir):
    import corpus_pipeline as P

    out = []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        out.append((docs.columns, rows))
        docs = spark.createDataFrame(rows, docs.schema)
        if k < 4:
            assert docs.columns == P.COLUMNS
    return out


def test_stages_on_hostile_rows(spark, labelled):
    made = hostile()
    out = after_each(spark, spark.createDataFrame(made, SCHEMA), labelled)
    ids = lambda rows: sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x))
    given = sorted((r[0] for r in made), key=lambda x: (x is None, x))
    # Without labels nothing is rejected, and line dedup drops no row.
    assert ids(out[0][1]) == given and ids(out[1][1]) == given
    # One document a group stays, of rows alike one.
    kept = ids(out[2][1])
    assert [x for x in kept if x is not None] == sorted({x for x in kept if x is not None}) and set(kept) <= set(given)
    # What is packed is what the mix holds.
    assert {r["doc_id"] for r in out[4][1]} == {r["doc_id"] for r in out[3][1]}
    fill = {}
    for r in out[4][1]:
        assert 1 <= r["length"] <= 2048
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_on_an_empty_table(spark, labelled):
    assert all(not rows for _, rows in after_each(spark, spark.createDataFrame([], SCHEMA), labelled))
