"""Repeated runs of lines between differing surroundings, whose lines are all short."""

import random


def plain_runs(texts, least):
    """Lines, by document, in a common run of ``least`` words with an earlier document."""
    gone = {}
    for b, later in enumerate(texts):
        marks = set()
        for earlier in texts[:b]:
            for shift in range(-len(earlier) + 1, len(later)):
                run = []
                for i in range(len(later) + 1):
                    if i < len(later) and 0 <= i - shift < len(earlier) and later[i] == earlier[i - shift]:
                        run.append(i)
                        continue
                    if sum(len(later[k].split()) for k in run) >= least:
                        marks.update(run)
                    run = []
        gone[b] = marks
    return gone


def planted():
    rng = random.Random(5)
    line = lambda low, high: " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randint(low, high)))
    texts = []
    for low, high in ((25, 49), (15, 34), (8, 19), (1, 3)):
        passage = []
        while sum(len(x.split()) for x in passage) <= 60:
            passage.append(line(low, high))
        if low == 8:
            passage.insert(2, "")
        texts += [[line(1, 60) for _ in range(rng.randint(1, 4))] + passage + [line(1, 60) for _ in range(rng.randint(1, 4))] for _ in range(10)]
    return texts


def test_whole_runs_go(spark):
    from lodestar.llm.line_dedup import WHOLE, dedup_lines

    texts = planted()
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in dedup_lines(docs, WHOLE).collect()}
    gone = plain_runs(texts, WHOLE.long_words)
    assert sum(map(bool, gone.values())) == 36
    for i, lines in enumerate(texts):
        assert got[i]["text"].split("\n") == [x for k, x in enumerate(lines) if k not in gone[i]]
        assert (got[i]["n_removed_lines"], got[i]["n_lines"]) == (len(gone[i]), len(lines))


def test_a_run_that_repeats_itself_stays_once(spark):
    from lodestar.llm.line_dedup import WHOLE, dedup_lines

    docs = spark.createDataFrame([(1, "\n".join(["a line that is there again and again"] * 50)), (2, None), (3, "\n\n")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in dedup_lines(docs, WHOLE).collect()}
    assert got[1]["text"] and len(got[1]["text"].split()) >= 50 and got[1]["n_removed_lines"] > 40
    assert got[2]["text"] is None and got[3]["text"] == "\n\n"


def test_query_and_pipeline_remove_runs(spark, tmp_path):
    import corpus_pipeline as P

    from lodestar.llm.queries import QUERIES

    texts = planted()
    rows = [(i, "\n".join(x), "en", "s", len("\n".join(x))) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    gone = plain_runs(texts, 50)
    want = {i: "\n".join(y for k, y in enumerate(x) if k not in gone[i]) for i, x in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()} == want
    assert {r["doc_id"]: r["text"] for r in P.line_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()} == want
