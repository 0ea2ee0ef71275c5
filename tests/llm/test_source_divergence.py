"""The audit against a plain version over Python counters, and the sketch against exact counts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from lodestar.llm.source_divergence import DEPTH, counters, merged_sketch, source_divergence, terms_of

SCHEMA = "doc_id long, text string, lang string, source string, part string, value string, rank int"


def plain_terms(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_audit(rows, limit, top):
    docs = [(r[2] or "", r[3] or "", plain_terms(r[1])) for r in rows]
    df, n, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        n[lang, source].update(terms)
        whole[lang].update(terms)
    out = []
    share = lambda count, total, v: 1 + 10**9 * (count + 2) // (total + 2 * v)
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in n:
        kept = [t for t, k in df[lang].items() if k >= limit]
        v = len(kept)
        p = {g: {t: share(c[t], sum(c[x] for x in kept), v) for t in kept} for g, c in [*n.items(), (None, whole[lang])] if g is None or g[0] == lang}
        own = p[lang, source]
        for part, found in (
            ("pair", [(sum(apart(own[t], q[t]) for t in kept), g[1]) for g, q in p.items() if g is not None and g[1] != source]),
            ("term", [(apart(own[t], p[None][t]), t) for t in kept if n[lang, source][t] > 0 and own[t] > p[None][t]]),
        ):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def corpus(seed=2):
    rng = random.Random(seed)
    words = [rng.choice("abcdeé") + rng.choice("xyzß") + str(rng.choice(["", 1, "q"])) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(3, 60)]) for _ in range(n))
    rows = [(i, text(rng.choice([0, 3, 40])), rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s2", "s3", None, ""]), "clash", "clash", 1) for i in range(90)]
    rows += [rows[5]] * 3 + [(200, None, "en", "only null", None, None, None), (201, "rare words here", "xx", "a", None, None, None), (202, None, "xx", "b", None, None, None), (None, "É é A_b ΣΑΣ " * 5_000, "fr", "long", None, None, None)]
    return rows


def test_operator_matches_plain_version(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain_audit(rows, 4, 3)
    assert sorted(map(tuple, source_divergence(docs, limit=4, top=3).collect())) == want
    # A sketch so narrow that it lets almost all through changes nothing.
    assert sorted(map(tuple, source_divergence(docs, limit=4, top=3, width=4096).collect())) == want
    assert {w[2] for w in want} == {"pair", "term"} and ("xx", "a", "pair", "b", 0, 1) in want
    assert source_divergence(docs.limit(0)).count() == 0


def test_sketch_never_underestimates(spark):
    docs = spark.createDataFrame([(r[2] or "", r[3] or "", r[1]) for r in corpus(3)], "lang string, source string, text string").repartition(7)
    exact = defaultdict(Counter)
    for r in docs.collect():
        exact[r.lang].update(set(terms_of((r.text or "").encode())))
    for width in (4096, 1 << 16):
        sketch = merged_sketch(docs.withColumn("text", docs.text.cast("binary")), 10, width)
        assert len(sketch) == DEPTH * width
        for lang, found in exact.items():
            terms = list(found)
            if terms:
                estimate = sketch[counters(lang, terms, width)].min(axis=0)
                assert (estimate >= np.minimum(list(found.values()), 255)).all()


def test_terms_follow_the_rule():
    text = "Don't STOP été É x_y\x7fz `q` 9a [B]"
    assert [w.decode() for w in terms_of(text.encode())] == plain_terms(text)
