"""Scoring of runs, renderers and hooks on small fixtures."""

import difflib

import pytest
from pyspark.sql import functions as F

from lodestar.operators import evaluation as E
from lodestar.operators import rendering as W
from lodestar.operators import trajectory as T


def test_argument_checks(spark):
    claims = spark.createDataFrame([("c1", ["NG-1102"], [100, 150])], "claim_number string, forms array<string>, lines array<long>")
    columns = "run_id int, step int, claim_number string, tool string, arg_claim string, arg_form string, arg_amount long, arg_sublimit long, arg_basis string"
    made = [
        (1, 1, "c1", "get_claim", "c1", None, None, None, None), (1, 2, "c1", "search_policy", None, "NG-1102", None, None, None), (1, 3, "c1", "search_policy", None, "NG-7", None, None, None),
        (1, 4, "c1", "search_policy", None, "NG-1101", None, None, None), (1, 5, "c1", "compute_payout", "c2", None, 250, 7, "hurricane"), (1, 6, "c1", "compute_payout", None, None, None, 5000, "other"),
        (2, 1, "c9", "compute_payout", "c9", None, 0, None, "hurricane"), (2, 2, "c9", "search_policy", None, "", None, None, None),
    ]
    got = E.argument_checks(spark.createDataFrame(made, columns), claims, ["NG-1101", "NG-1102"], [5000]).collect()
    assert sorted((r["run_id"], r["step"], r["arg"], r["valid"]) for r in got) == [
        (1, 1, "claim_number", True), (1, 2, "form_number", True), (1, 3, "form_number", False), (1, 4, "form_number", False), (1, 5, "claim_number", False), (1, 5, "covered_amount", True),
        (1, 5, "deductible_basis", True), (1, 5, "sublimit", False), (1, 6, "covered_amount", False), (1, 6, "sublimit", True), (2, 1, "claim_number", True), (2, 1, "covered_amount", False), (2, 1, "deductible_basis", False),
    ]
    why = {(r["step"], r["arg"]): r["why"] for r in got if r["run_id"] == 1}
    assert why[3, "form_number"] == "no such form" and why[4, "form_number"] == "the policy lacks this form" and why[1, "claim_number"] == ""


def test_scores_of_paths(spark):
    specs = spark.createDataFrame([("c", ["A"], ["B"], "required")], "claim_number string, required_forms array<string>, optional_forms array<string>, payout string")
    assert T.accepted_paths(["A"], ["B"], "optional")[:3] == [["claim", "policy:A", "payout"], ["claim", "policy:A"], ["claim", "policy:A", "policy:B", "payout"]]
    runs = spark.createDataFrame(
        [(1, "c", ["get_claim", "search_policy", "compute_payout"], ["x"], True, "final_answer"), (2, "c", ["get_claim", "compute_payout"], None, True, "final_answer"), (3, "d", ["get_claim"], ["x"], None, None)],
        "run_id int, claim_number string, tools array<string>, matched array<string>, args_valid boolean, stop_reason string",
    )
    got = {r["run_id"]: (r["tool_choice_ok"], r["steps_taken"], r["steps_needed"], r["trajectory_pass"]) for r in E.score_runs(runs, specs).collect()}
    assert got == {1: (True, 3, 3, True), 2: (False, 2, 3, False), 3: (False, 1, None, False)}
    modes = spark.createDataFrame([(["redundant_lookup"],), (["redundant_lookup", "wrong_outcome"],), (None,)], "modes array<string>")
    assert [(r["mode"], r["n"]) for r in E.mode_counts(modes, "modes").collect()] == [(m, {"redundant_lookup": 2, "wrong_outcome": 1}.get(m, 0)) for m in T.MODES]


def test_integrity_of_joins(spark):
    texts = spark.createDataFrame([(1, "h1"), (2, "h2")], "id int, digest string")
    labels = lambda h: spark.createDataFrame([(1, "PASS", "h1"), (2, "FAIL", h)], "id int, label string, digest string")
    assert E.join_labels(texts, labels("h2"), "id", "digest").count() == 2
    with pytest.raises(Exception, match="text changed since it was labelled: 2"):
        E.join_labels(texts, labels("other"), "id", "digest").collect()
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert E.pair_runs(left, left, "k", ("one", "two")).columns == ["k", "one_v", "two_v"]
    with pytest.raises(Exception, match="run without a partner: b"):
        E.pair_runs(left, left.where("k = 'a'"), "k", ("one", "two")).collect()


def test_texts(spark):
    pairs = [("abcd", "bcde"), ("", ""), (None, "x"), ("same text", "same text"), ("a b c", "c b a")]
    got = spark.createDataFrame(pairs, "a string, b string").select(E.similarity("a", "b").alias("r")).collect()
    assert [r["r"] for r in got] == [None if a is None else round(difflib.SequenceMatcher(None, a, b).ratio(), 4) for a, b in pairs]
    assert E.expanded("x ${A}/${B_1} ${no-name} ${open", {"A": "1"}) == "x 1/ ${no-name} ${open"
    row = spark.range(1).select(
        W.claim_file({"Claim": F.lit("c1"), "Seen": F.lit(None)}, F.array(F.struct(F.lit("roof").alias("item"), F.lit(1234.5).alias("amount"))), F.lit(None).cast("array<struct<date:string,author:string,text:string>>")).alias("f"),
        W.trace_text(F.lit("why"), F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("string"), F.lit("timeout")).alias("t"),
        E.quota_hit(F.array(F.lit("429: Tokens per day"))).alias("q"), E.quota_hit(F.lit(None).cast("array<string>")).alias("n"),
    ).first()
    assert row["f"] == "Claim: c1\nEstimate:\n- roof: $1,234.50" and row["t"] == "Q: why\nRetrieved: a, b\nError: timeout" and row["q"] and not row["n"]
    hits = spark.createDataFrame([(1, 2, "y", None, "two", 0.5, 0.01, 3, None), (1, 1, "x", "S", "one", 0.75, 0.02, None, 1)], "query_id int, rank int, chunk_id string, clause_id string, text string, score double, rrf_score double, vector_rank int, bm25_rank int")
    assert W.context_block(hits).first()["context"] == "[SOURCE: x | S]\none\n\n[SOURCE: y | N/A]\ntwo"
    assert W.hit_lines(hits).first()["listing"] == "1. x  0.7500\n2. y  0.5000"
    assert W.fused_hit_lines(hits).first()["listing"].splitlines()[1] == "2. y  0.010000 (vector 3, words -)"


def test_hooks(spark):
    tools = E.Registry()
    tools.add("forms", lambda n: spark.range(n), "numbers")
    assert tools.call("forms", n=3)[0].count() == 3 and tools.listing() == [("forms", "numbers")]
    assert tools.call("none")[1].startswith("unknown tool") and "TypeError" in tools.call("forms")[1]
    chunks = spark.createDataFrame([("a", "F1", "Water damage"), ("b", "F2", "Frost")], "chunk_id string, form_number string, text string")
    questions = spark.createDataFrame([(1, "F1", "water"), (2, "F2", "fire")], "query_id int, expected_form string, fragment string")
    search = lambda q, c: q.select("query_id").crossJoin(c.select("chunk_id")).withColumn("rank", F.ascii("chunk_id") - 96)
    assert {r["query_id"]: r["hit_rank"] for r in E.evaluate_search(search, questions, chunks, 2).collect()} == {1: 1, 2: None}
    made = E.chunk_and_embed(chunks, lambda f: f.where("form_number = 'F1'"), lambda t: F.array(F.length(t).cast("float")))
    assert made.first()["embedding"] == [12.0]

    def client():
        seen = {}

        def ask(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "never" or (prompt == "later" and seen[prompt] < 3):
                raise RuntimeError("busy")
            return prompt.upper()

        return ask

    prompts = spark.createDataFrame([(1, "now"), (2, "later"), (3, "never")], "id int, prompt string")
    got = {r["id"]: (r["answer"], r["error"], r["tries"]) for r in E.call_model(prompts, client, wait=0.01).collect()}
    assert got == {1: ("NOW", None, 1), 2: ("LATER", None, 3), 3: (None, "RuntimeError: busy", 4)}


def test_pages_and_resources(spark):
    rows, found, cursor = spark.range(7), [], None
    while True:
        page, cursor = E.next_page(rows, "id", cursor, 3)
        found += [r["id"] for r in page.collect()]
        if cursor is None:
            break
    assert found == list(range(7))
    config = spark.createDataFrame([("docs", ["u2", "u1", "gone"])], "server string, attach array<string>")
    resources = spark.createDataFrame([("u1", "one"), ("u2", "two")], "uri string, text string")
    assert [(r["place"], r["text"]) for r in E.attached_resources(config, resources).orderBy("place").collect()] == [(0, "two"), (1, "one")]
    forms = spark.createDataFrame([(2, "F", "S"), (1, "F", "PREAMBLE"), (3, "F", None), (4, "G", "S")], "chunk_index int, form_number string, clause_id string")
    assert [r["chunk_index"] for r in E.whole_form(forms, "F").collect()] == [2, 3]


def test_many_lines_and_their_sums(spark):
    import random

    from lodestar.operators import sums as S

    rng = random.Random(1)
    for n in (0, 1, 5, 13):
        lines = [rng.randint(-50, 500) for _ in range(n)]
        every = {0}
        for x in lines:
            every |= {s + x for s in every}
        assert all(S.is_sum(lines, a) == (a in every) for a in range(-700, 7000, 7)) and S.is_sum(lines, max(every))
        bits, offset = S.bitset(lines)
        assert {i - offset for i in range(bits.bit_length()) if bits >> i & 1} == every
    forty = [rng.randint(1, 900_000) * 2 for _ in range(40)]
    some = sum(rng.sample(forty, 17))
    assert S.is_sum(forty, some) and not S.is_sum(forty, some + 1)
    many = [rng.randint(1, 5_000) * 2 for _ in range(200)]
    assert S.is_sum(many, sum(many[::3])) and not S.is_sum(many, 7)
    rows = spark.createDataFrame([(forty, some), (forty, some + 1), (None, 1), ([], 0), ([5], None)], "l array<long>, a long")
    assert [r[0] for r in rows.select(S.is_subset_sum("l", "a")).collect()] == [True, False, None, True, None]
    assert [tuple(r[0]) for r in rows.where("size(l) < 2").select(S.subset_sum_size("l")).collect()] == [(1, 0), (2, 5)]


def test_acceptance_without_expansion(spark):
    import random

    rng = random.Random(2)
    letters = "ABCDE"
    hits = 0
    for _ in range(4_000):
        forms = rng.sample(letters, rng.randint(0, 5))
        cut = rng.randint(0, len(forms))
        required, optional, payout = forms[:cut], rng.choice([forms[cut:], None]) or None, rng.choice(["required", "optional", "forbidden"])
        steps = [["claim"]] if rng.random() < 0.95 else [["error"]]
        steps += [[f"policy:{f}" for f in rng.sample(letters, rng.randint(1, 3))] for _ in range(rng.randint(0, 4))]
        steps += [["payout"]] * rng.randint(0, 1)
        want = next((p for p in T.accepted_paths(required, optional, payout) if len(p) == len(steps) and all(x in s for x, s in zip(p, steps))), None)
        assert T.first_accepted(required, optional, payout, steps) == want
        hits += want is not None
    assert hits > 300
    # Twelve forms have billions of orders.
    twelve = [f"F{i}" for i in range(12)]
    steps = [["claim"]] + [[f"policy:F{(i + 1) % 12}", f"policy:F{i}"] for i in range(12)] + [["payout"]]
    got = T.first_accepted(twelve[:6], twelve[6:], "required", steps)
    assert sorted(got[1:-1]) == sorted(f"policy:{f}" for f in twelve) and all(x in s for x, s in zip(got, steps))
    assert T.first_accepted(twelve, None, "required", steps[:-2] + steps[-1:]) is None
    specs = spark.createDataFrame([("c", twelve, None, "required")], "claim_number string, required_forms array<string>, optional_forms array<string>, payout string")
    runs = spark.createDataFrame([(1, "c", steps), (2, "d", steps), (3, "c", None)], "run_id int, claim_number string, tokens array<array<string>>")
    assert {r.run_id: r.matched is not None for r in T.match_runs(runs, specs).collect()} == {1: True, 2: False, 3: False}


def test_claims_of_few_lines_are_judged_together(spark, monkeypatch):
    import random

    import pyarrow as pa

    from lodestar.operators import sums as S

    rng = random.Random(3)
    lines = [None if rng.random() < 0.1 else [rng.choice([None, rng.randint(-9, 40)]) for _ in range(rng.randint(0, 18))] for _ in range(3_000)]
    amounts = [None if rng.random() < 0.1 else rng.randint(-20, 300) for _ in lines]
    lines += [[2**62, 2**62, -(2**62)], [7] * 45, [], [], [None]]
    amounts += [2**62, 7 * 44, 0, 1, 0]
    want = [None if x is None or a is None else S.is_sum([v for v in x if v is not None], a) for x, a in zip(lines, amounts, strict=True)]
    one_by_one, seen = S.is_sum, []
    monkeypatch.setattr(S, "is_sum", lambda x, a: seen.append(len(x)) or one_by_one(x, a))
    given = pa.array([[9]] * 5 + lines, pa.list_(pa.int64())).slice(5), pa.array([9] * 5 + amounts, pa.int64()).slice(5)  # as batches come: parts of longer ones
    assert S.is_subset_sum.func(*given).to_pylist() == want and {True, False, None} == set(want)
    assert len(seen) < 400 and all(n > S.LISTED or n == 3 for n in seen)
    assert S.judged(*(x.slice(0, 0) for x in given)).to_pylist() == []
    seen.clear()
    many = [list(range(50)), list(range(50)), list(range(50)), [1] * 50, [1] * 50, list(range(50))]
    assert S.judged(pa.array(many), pa.array([7, 2_000, 7, 7, 60, 7])).to_pylist() == [True, False, True, True, False, True] and len(seen) == 5


def test_one_shuffle_brings_steps_and_lines_together(spark, sf_dir):
    from lodestar.plans.registry import QUERIES

    plan = QUERIES["argument_checks"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("lineitem.parquet") == 1


def test_amounts_in_hundredths_and_repeated_claims(spark):
    claims = spark.createDataFrame([(1, None, [0.1, 0.2]), (2, ["NG-1102"], None), (2, ["NG-1102"], [5.0])], "claim_number long, forms array<string>, lines array<double>")
    columns = "run_id int, step int, claim_number long, tool string, arg_claim long, arg_form string, arg_amount double, arg_sublimit long, arg_basis string"
    made = [(1, i, c, "compute_payout", None, None, a, None, None) for i, (c, a) in enumerate([(1, 0.3), (1, 0.31), (1, 0.0), (2, 5.0), (2, 0.0), (3, 0.0), (None, 0.0)])]
    got = E.argument_checks(spark.createDataFrame(made, columns), claims, [], []).collect()
    assert sorted((r["step"], r["valid"]) for r in got) == [(0, True), (1, False), (2, True), (3, False), (3, True), (4, True), (4, True), (5, False), (6, False)]


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_only_orders_of_runs_are_checked(spark, sf_dir, monkeypatch, most):
    from lodestar.plans import evaluation as P
    from lodestar.plans.registry import ORACLES, QUERIES
    from tests.comparing import duck, rows_of_duck, rows_of_spark

    monkeypatch.setattr(P, "MOST_RUNS", most)
    got = QUERIES["path_scores"](spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert len(semi) >= 2 and all(("Broadcast" in line) for line in semi if most > 3)
    assert rows_of_spark(got) == rows_of_duck(duck(sf_dir), ORACLES["path_scores"])


def test_report_checks_only_orders_of_runs(spark, sf_dir, monkeypatch):
    from lodestar.plans import evaluation as P
    from lodestar.plans.registry import ORACLES, QUERIES
    from tests.comparing import duck, rows_of_duck, rows_of_spark

    seen, checked = [], E.checked_steps
    monkeypatch.setattr(E, "checked_steps", lambda steps, *known: seen.append(steps) or checked(steps, *known))
    monkeypatch.setattr(P, "MOST_RUNS", 3)
    got = rows_of_spark(QUERIES["trajectory_report"](spark, sf_dir))
    runs = {r.conv_id for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().collect()}
    assert {r.run_id for r in seen[0].select("run_id").collect()} <= runs
    assert got == rows_of_duck(duck(sf_dir), ORACLES["trajectory_report"])
