"""The suffix automaton against windows as strings, on random word sequences and awkward texts."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm.item_spans import Automaton, match_items, remove_items, words_of

SCHEMA = "doc_id long, text string, n_hit string, contaminated string, spans int"


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_match(text, items, window):
    """Hit words and item ids by comparing every place with every window."""
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        size = min(window, len(own))
        for k in range(len(own) - size + 1) if own else ():
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[k : k + size]:
                    hit.update(range(at, at + size))
                    names.add("" if name is None else str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=6), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 5))
def test_automaton_finds_every_window(items, text, window):
    listed = [(str(i), [w.encode() for w in item]) for i, item in enumerate(items)]
    one = Automaton(listed, window)
    import numpy as np

    numbers = np.array([one.numbers.get(w.encode(), -1) for w in text], np.int32)
    hit, names = set(), set()
    for first, stop in one.candidates(numbers):
        for n, state, place in one.occurrences(numbers[first:stop].tolist()):
            hit.update(range(first + place + 1 - n, first + place + 1))
            names.update(one.names[state])
    want = plain_match(" ".join(text), [(i, " ".join(item)) for i, item in enumerate(items)], window)
    assert (len(hit), len(names)) == want[1:3]
    assert hashlib.sha256(",".join(sorted(names)).encode()).hexdigest() == want[3]


def awkward(seed=5):
    rng = random.Random(seed)
    words = ["Été", "Straße", "x1", "the", "of", "ΣΑΣ", "A", "ﬁ", "2024", "naïve"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 25, 60]))) for i in range(12)]
    items += [(3, text(12)), (None, "only here " * 6), (50, None), (51, "--- \u0000 ..."), (52, items[4][1])]
    texts = [None, "", " \n", " ", "The\x00OF", text(2000)] + [text(40) for _ in range(20)]
    texts += ["start " + i + ", end" for _, i in items if i] + [i.upper().replace(" ", "\n--") for _, i in items if i] + ["word " * 30_000 + (items[5][1] or "")]
    docs = [(k, t, "clash", "clash", 1) for k, t in enumerate(texts)]
    return [i for i in items if i[0] != 0 or len(plain_words(i[1])) > 1], docs + docs[3:5] + [(None, items[5][1], None, None, None)]


def test_operator_matches_plain_version(spark):
    items, docs = awkward()
    items = [(i, t) for i, t in items if t is None or len(plain_words(t)) != 1]
    held, texts = spark.createDataFrame(items, "item_id long, text string").repartition(3), spark.createDataFrame(docs, SCHEMA).repartition(4)
    want = sorted(((d[0], *plain_match(d[1], items, 10)) for d in docs), key=str)
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)
    for block_words in (200_000, 40):  # one automaton, then several
        got = match_items(texts, held, block_words=block_words).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == want
    assert match_items(texts.limit(0), held).count() == 0
    assert match_items(texts, held.limit(0)).where("contaminated OR n_hit > 0").count() == 0


def test_spans_leave_the_texts(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"Before, {passage.upper()}. After it all comes much more text that is nobody's: ä ö ü and so on.", "a", "b", 1), (2, passage, None, None, 2), (3, None, "c", None, 3), (4, "clean ä", None, None, None)]
    held = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in remove_items(spark.createDataFrame(docs, SCHEMA), held).collect()}
    assert sorted(got) == [1, 3, 4] and got[1].text == "Before, . After it all comes much more text that is nobody's: ä ö ü and so on." and got[1].n_hit == "a"
    assert got[3].text is None and got[4].text == "clean ä"
    assert remove_items(spark.createDataFrame(docs, SCHEMA), held, most_share=1.0).where(F.col("doc_id") == 2).first().text == ""


def test_words_follow_the_rule():
    text = "Don't STOP été É x_y\x7fz `q` 9a"
    assert [w.decode() for w in words_of(text.encode())] == plain_words(text)
