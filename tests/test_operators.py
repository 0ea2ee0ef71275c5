import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.functions.hashing import hmac_sha256
from lodestar.operators import chunking as C
from lodestar.operators import joins as J
from lodestar.operators import metrics as M
from lodestar.operators import redaction as R
from lodestar.operators import retrieval as Q
from lodestar.operators import roster, rules
from lodestar.operators import trajectory as T
from lodestar.operators.vector_scan import candidates

SALT = b"a test's own salt"
FORM = """HOMEOWNERS ENDORSEMENT
Form Number: NG-9001
Edition Date: 01-26
Policy Line: home
SECTION I — SCOPE
Words.
CLAUSE WD-1 — WATER
We pay for water.
EXCLUSION TABLE — NG-9001 ed. 01-26
| Code | Peril | Scope |
|---|---|---|
| E-11 | flood | rising water |
|      | of any kind | and mud |
| E-12 | frost | pipes |
END OF ENDORSEMENT"""


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_hmac_and_pseudonyms(spark):
    got = one(spark, hmac_sha256(F.lit("jane doe"), SALT).alias("h"))["h"]
    assert got == hmac.new(SALT, b"jane doe", hashlib.sha256).hexdigest()
    assert R.token_of("NAME", " Jane Doe ", SALT) == R.token_of("NAME", "jane doe", SALT) == f"[NAME:{got[:6]}]"


def test_redaction_before_writing(spark, tmp_path):
    from lodestar.sources.tables import Refused, append_checked

    text = "claimant Jane Doe, 41 Harborview Lane, jane@example.com, 555-123-4567, CLM-2026-04417, HOP-8842116; Doe called. Insured Special Form stays."
    rows = spark.createDataFrame([(text, ["Jane Doe"]), (None, None), ("", [])], "text string, names array<string>")
    out = rows.select(R.redactor(SALT)("text", "names").alias("r")).select("r.*").collect()
    clean = out[0]["text"]
    assert R.token_of("CLAIMANT", "Jane Doe", SALT) in clean and "Doe" not in clean and "Special Form" in clean
    assert out[0]["counts"] == {"CLAIM_NO": 1, "POLICY_NO": 1, "EMAIL": 1, "PHONE": 1, "ADDRESS": 1, "CLAIMANT": 2}
    assert out[1]["text"] is None and out[2]["text"] == ""
    path = str(tmp_path / "log")
    append_checked(spark.createDataFrame([(clean,)], "text string"), path, ["text"])
    with pytest.raises(Refused):
        append_checked(rows.select("text"), path, ["text"])
    assert spark.read.json(path).count() == 1
    with pytest.raises(Exception, match="refused to write"):
        R.refuse_leaks(rows.select("text"), "text").collect()
    found = one(spark, R.name_leaks(F.lit("mrs doe"), F.array(F.lit("Jane Doe"))).alias("l"))["l"]
    assert found == ["Doe"]


def test_roster_of_any_size(spark):
    import random

    rng = random.Random(1)
    syllables = ["an", "bo", "de", "ka", "li", "mo", "ſe", "İr", "ıs", "Ük"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))).capitalize()
    roster = [f"{word()} {word()}" for _ in range(150)] + ["Cher", "Ann Lee", "Lee", "  ", None, "de la Cruz"]
    texts = [" ".join(rng.choice([word(), word().upper(), rng.choice(roster) or "x", "insured"]) for _ in range(30)) for _ in range(40)]
    texts += [None, "", "CHER'S ann LEE; Annlee, LEEs, crUZ. jane@example.com", "Wet\nEarth insured Rot Earth"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", R.roster_redactor(spark.createDataFrame([(n,) for n in roster], "n string"), SALT)("text").alias("r")).collect()
    for r in got:
        text, counts = R.redact(texts[r.id], roster, SALT)
        assert (r.r.text, r.r.counts) == (text, counts)
    assert not R.names_policy("Rot\nEarth") and R.names_policy("Wet Rot") and R.names_policy("storm")


def test_a_roster_is_joined_and_held_by_no_task(spark, monkeypatch):
    """However many names there are: a list of them all was refused above ``MOST_NAMES``."""
    monkeypatch.setattr(R, "MOST_NAMES", 10)
    monkeypatch.setattr(roster, "BYTES", 300)
    rng = random.Random(2)
    syllables = ["an", "bo", "de", "ka", "ſe", "İr", "ıs", "Ük", "ß"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))).capitalize()
    names = [f"{word()} {word()}" for _ in range(200)] + ["Cher", "Ann Lee", "Lee", "  ", None, "de la Cruz", "Customer#000000012", "Customer#000000013"]
    texts = [" ".join(rng.choice([word(), word().upper(), rng.choice(names) or "x", "insured"]) for _ in range(30)) for _ in range(40)]
    texts += [None, "", "CHER'S ann LEE; Annlee, LEEs, crUZ. jane@example.com", "of cUSTOMER#000000012 and Customer#0000000131", texts[0]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = roster.redact_by_roster(rows, "text", spark.createDataFrame([(n,) for n in names], "n string"), SALT).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.redacted.text, r.redacted.counts) == R.redact(texts[r.id], names, SALT)
    few = roster.redact_by_roster(rows, "text", spark.createDataFrame([(None,)], "n string"), SALT).where("id = 42").first()
    assert few.redacted.text == R.redact(texts[42], [], SALT)[0]


def test_redacted_documents_match_plain_version(spark, sf_dir):
    from lodestar.plans.redacted import CHECK_SALT
    from lodestar.plans.registry import QUERIES

    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name").collect()]
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        low = (r.text or "").lower()
        text, counts = R.redact(r.text, [n for n in names if n.lower() in low], CHECK_SALT)
        want[r.doc_id] = (text, sum(counts.values()))
    assert {r.doc_id: (r.text, r.n_redacted) for r in QUERIES["redacted_documents"](spark, sf_dir).collect()} == want


def test_nested_redaction(spark):
    df = spark.createDataFrame([([("a@b.co", 1)], {"k": "x@y.org"})], "a array<struct<s:string,n:int>>, m map<string,string>")
    mask = lambda c: R.masked(c)
    out = df.select(*[R.redact_strings(F.col(f.name), f.dataType, mask).alias(f.name) for f in df.schema.fields]).first()
    assert out["a"][0]["s"] == "[EMAIL]" and out["m"] == {"k": "[EMAIL]"}


@pytest.mark.parametrize("n", [0, 1, 399, 400, 401, 750, 751, 1100])
def test_windows(spark, n):
    docs = spark.createDataFrame([("f", " ".join(["w"] * n))], "id string, text string")
    assert C.token_windows(docs, ["id"]).count() == (0 if n == 0 else 1 if n <= 400 else 1 + -(-(n - 400) // 350))


def test_structure_chunks_and_schedule(spark):
    forms = spark.createDataFrame([("NG-9001", "01-26", FORM)], "form_number string, edition_date string, text string")
    ids = [r["clause_id"] for r in C.structure_chunks(forms).orderBy("i", "j").collect()]
    assert ids == ["PREAMBLE", "PREAMBLE", "SECTION-I", "CLAUSE-WD-1", "EXCLUSION-TABLE", "PREAMBLE"]
    rows = C.exclusion_schedule(forms).orderBy("code").collect()
    assert [(r["code"], r["peril"], r["scope"]) for r in rows] == [("E-11", "flood of any kind", "rising water and mud"), ("E-12", "frost", "pipes")]
    got = one(spark, C.clause_id(F.lit("x\n| E-11 | a | b |\n| E-12 | c |\n| E-11 |")).alias("c"))["c"]
    assert got == "EXCLUSION-TABLE-E-11-E-12"


def test_forms_and_claims(spark, tmp_path):
    from lodestar.sources import tables as S

    (tmp_path / "a.txt").write_text(FORM)
    (tmp_path / "b.txt").write_text("Form Number: X\n")
    forms, skipped = S.read_forms(spark, str(tmp_path))
    assert forms.first()["form_number"] == "NG-9001" and skipped.first()["missing"] == ["Edition Date", "Policy Line"]
    for name, line in (("o.jsonl", '{"claim_number":"CLM-1","status":"open"}\n\n'), ("c.jsonl", '{"claim_number":"CLM-1","status":"closed"}\n')):
        (tmp_path / name).write_text(line)
    assert S.read_claims(spark, [str(tmp_path / "o.jsonl"), str(tmp_path / "c.jsonl")]).first()["status"] == "closed"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, S.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    fixed = S.replace_failed(old, spark.createDataFrame([(1, "z"), (2, "y")], "id int, v string"), "id", F.col("v") == "b")
    assert sorted(map(tuple, fixed.collect())) == [(1, "a"), (2, "y")]
    assert S.markdown(old).splitlines()[0] == "| id | v |"


def test_text_functions(spark):
    row = one(
        spark, X.tokens(F.lit("E-43 Wet-rot x-y-z É1")).alias("t"), X.citations(F.lit("a [SOURCE: A | x] [SOURCE:B] [SOURCE: A|y] [ SOURCE: C]")).alias("c"),
        X.normal_reference(F.lit("NG-1103:CLAUSE-MR‑1")).alias("r"), X.passage(F.lit("one line")).alias("p"), X.suggested_wait(F.lit("try again in 1m2.5s")).alias("w"),
        X.json_object(F.lit('x {"a": 1} y'), "a int")["a"].alias("j"), X.verdict(F.lit("PASS not FAIL")).alias("v"), X.exact_codes(F.lit("what of e-4?")).alias("e"),
        X.handoff_group(F.lit("payout (lap 3)"), F.lit(3)).alias("g"), X.is_claim_number(F.lit("CLM-2026-04417")).alias("n"), X.is_form_number(F.lit("NG-11011")).alias("f"),
    )
    assert row["t"] == ["e-43", "wet-rot", "x-y", "z", "1"] and row["c"] == ["A", "B"] and row["r"] == "MR-1" and row["p"] == "one line"
    assert row["w"] == 63.5 and row["j"] == 1 and row["v"] == "FAIL" and row["e"] == ["E-4"] and row["g"] == "payout 2+" and row["n"] and not row["f"]


PAYOUTS = [
    (True, "covered", 6300.0, "all_peril", None, 5300.0, None), (True, "covered", 500.0, "all_peril", None, 0.0, None), (True, "excluded", 500.0, "nonsense", None, 0.0, None),
    (True, "covered_subject_to_sublimit", 9000.0, "all_peril", 5000.0, 5000.0, None), (True, "covered_subject_to_sublimit", 9000.0, "all_peril", None, None, "sublimit required"),
    (True, "covered", 9000.0, "hurricane", 1.0, 3000.0, None), (True, "covered", 100.0, "none_scheduled_article", None, 100.0, None), (True, "covered", 1.0, "other", None, None, "unknown basis"),
    (True, "maybe", 1.0, "all_peril", None, None, "unknown status"), (False, "covered", 1.0, "all_peril", None, None, "unknown claim"),
]


def test_payout_table(spark):
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(PAYOUTS)], "known boolean, status string, amount double, basis string, sublimit double, payable double, error string, i int")
    got = df.withColumn("p", rules.payout(F.col("known"), F.col("status"), F.col("amount"), F.col("basis"), F.lit(1000), F.lit(300000), F.col("sublimit"))).orderBy("i").collect()
    assert [(r["p"]["payable"], r["p"]["error"]) for r in got] == [(r["payable"], r["error"]) for r in got]


def test_estimates_and_grades(spark):
    lines = spark.createDataFrame([([("a", 1.5), ("b", 2.0)],), ([],), (None,)], "l array<struct<item:string,amount:double>>")
    assert [r[0] for r in lines.select(rules.estimate(F.col("l"))).collect()] == [3.5, None, None]
    g = lambda pay, want: rules.grade(F.lit("covered"), F.lit(pay).cast("double"), F.array(F.lit("E‑17")), F.lit("covered"), F.lit(want).cast("double"), F.array(F.array(F.lit("E-17"))))
    row = one(spark, g(101.0, 100.0).alias("a"), g(101.5, 100.0).alias("b"), g(None, None).alias("c"), g(1.0, None).alias("d"))
    assert [row[k]["pass"] for k in "abcd"] == [True, False, True, False]


def test_accepted_paths_counts():
    specs = [(["a"], ["b"], "required", 3), (["a", "b"], [], "required", 2), (["a"], ["b"], "optional", 6), (["a"], [], "required", 1), (["a", "b"], None, "forbidden", 2)]
    assert all(len(T.accepted_paths(r, o, p)) == n for r, o, p, n in specs)


def test_budget_of_the_recorded_laps(spark):
    laps = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate([904, 1267, 1538, 2241, 2915, 10])], "run int, lap int, cost int")
    row = T.stop_laps(laps, "run", "lap", F.col("cost"), 6000).first()
    assert (row["stopped_at"], row["spent"]) == (6, 8865)


def test_fusion_and_rescue(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int")
    w = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, rank int")
    fused = Q.fuse(v, w)
    assert [r["chunk_id"] for r in fused.orderBy("rank").collect()] == ["b", "a", "c"]
    chunks = spark.createDataFrame([("a", "x", "PREAMBLE"), ("b", "y", "S"), ("c", "see E-41", "S")], "chunk_id string, text string, clause string")
    codes = spark.createDataFrame([(1, ["E-4"])], "query_id int, codes array<string>")
    assert [r["chunk_id"] for r in Q.rescue(fused, chunks, codes, F.col("clause") == "PREAMBLE", 3).orderBy("rank").collect()] == ["c", "b", "a"]


def test_rescue_looks_at_the_whole_fused_list(spark):
    """A chunk with the code is first, however far behind it was fused."""
    fused = spark.createDataFrame([(1, i, i) for i in range(1, 41)], "query_id int, chunk_id int, rank int")
    chunks = spark.createDataFrame([(i, "see E-4" if i == 40 else "x", "S") for i in range(1, 41)], "chunk_id int, text string, clause string")
    codes = spark.createDataFrame([(1, ["E-4"])], "query_id int, codes array<string>")
    got = Q.rescue(fused, chunks, codes, F.col("clause") == "PREAMBLE", 3).orderBy("rank").collect()
    assert [(r["chunk_id"], r["fused_rank"]) for r in got] == [(40, 40), (1, 1), (2, 2)]


def test_pairs_of_one_key_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(J, "ROWS", 50)
    left = spark.range(300).select(F.col("id").alias("a"), F.when(F.col("id") < 290, 1).otherwise(F.col("id")).cast("long").alias("k"))
    right = spark.range(400).select(F.col("id").alias("b"), F.when(F.col("id") < 390, 1).when(F.col("id") > 395, 295).cast("long").alias("k"))
    got = J.spread_join(left, right, "k")
    assert sorted(map(tuple, got.select("a", "b").collect())) == sorted(map(tuple, left.join(right, "k").select("a", "b").collect()))
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 10 and max(tasks) < 290 * 390 / 4
    assert J.spread_join(left, right.limit(0), "k").count() == 0


def test_exact_vectors_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "chunk_id long, v array<double>")
    queries = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(25)] + [(None, [1.0, 1.0, 1.0])], "query_id long, q array<double>")
    rows = lambda: sorted(map(str, Q.nearest_exact(vectors, queries, 3).collect()))
    whole = rows()
    monkeypatch.setattr(Q, "MOST_QUERIES", 10)
    assert len(whole) == 26 * 3 and rows() == whole


def test_far_pairs_get_no_exact_score(spark):
    rng = random.Random(3)
    vectors = [(i, [float(rng.randint(-9, 9)) for _ in range(4)], i % 3) for i in range(600)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0], i % 2) for i in range(900)]
    vectors = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0], n) for i, v, n in vectors] + [(3000, None, 0), (3001, [1.0, 2.0], 1), (3002, [1.0, None, 2.0, 3.0], 2), (3003, [1.0, 2.0, 3.0, 5.0], None)]
    queries = [(i, [float(rng.randint(-9, 9)) + 0.5 for _ in range(4)], i % 3) for i in range(20)] + [(50, [1.0, 2.0, 3.0, 4.0], 0), (51, [2.0, 4.0, 6.0, 8.0], None), (52, None, 1), (53, [1.0], 2)]
    v = spark.createDataFrame(vectors, "chunk_id long, v array<float>, label int").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, q array<float>, q_label int")
    rows = lambda **how: sorted(map(str, Q.nearest_exact(v, q, 5, **how).collect()))
    assert rows() == rows(where=F.lit(True))
    assert rows(equal=("label", "q_label")) == rows(where=F.col("label") == F.col("q_label"))
    regular = q.where("query_id < 52").collect()
    assert candidates(v.where("chunk_id < 3000"), regular, 5).count() < 1500 * len(regular) / 20


def test_metrics(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "id int, v double")
    at = M.percentiles(df.withColumn("g", F.lit(1)), ["g"], "v", {"a": ("nearest", 0.99), "b": ("floor", 0.9), "c": ("between", 0.5)}).first()
    assert (at["a"], at["b"], at["c"]) == (10.0, 10.0, 5.5)
    cases = spark.createDataFrame([(i, m) for i, m in enumerate("aaaaabbbc")], "pos int, mode string")
    left = sorted(r["pos"] for r in M.trim_to(cases, "mode", "pos", 5, F.lit(False)).collect())
    counts, rest = {"a": 5, "b": 3, "c": 1}, list(enumerate("aaaaabbbc"))
    while len(rest) > 5:
        big = max(counts, key=counts.get)
        rest.remove(next(c for c in reversed(rest) if c[1] == big))
        counts[big] -= 1
    assert left == sorted(p for p, _ in rest)


def test_streams(spark, tmp_path):
    from lodestar.streaming import monitors as S

    rows = [(i, f"2024-01-01 0{i % 3}:00:00", i % 2, f"k{i % 5}") for i in range(12)]
    spark.createDataFrame(rows, "id int, ts string, bad int, key string").selectExpr("id", "CAST(ts AS timestamp) AS ts", "bad", "key").write.parquet(str(tmp_path / "in"))
    stream = S.read_events(spark, str(tmp_path / "in"), "id int, ts timestamp, bad int, key string")
    for name, df, mode in (("rate", S.windowed_rate(stream, "ts", F.col("bad") == 1, "key"), "complete"), ("once", S.without_repeats(stream, "key", "ts"), "append"), ("budget", S.budget_guard(stream, "key", "id", "ts", 10), "update")):
        run = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        try:
            assert run.awaitTermination(120), name
        finally:
            run.stop()
    assert spark.table("rate").agg(F.sum("n")).first()[0] == 12
    assert spark.table("once").count() == 5
    assert {r["key"]: r["blocked"] for r in spark.table("budget").collect()}["k0"] is True
