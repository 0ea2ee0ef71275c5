"""Benchmark decontamination: texts run through a generalised suffix automaton of the normalised test items.

The automaton knows every run of words of any item once. While a text goes through it, each word has the longest run of
item words that ends there. Where that run has a window's length, the window's words are hit; so are those of a whole
shorter item.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import cut, delete_at_exit, drop_cut, fresh_path, map_rows, read_shared, write_shared

WINDOW = 10
#: Words that one automaton is made of at most, but for one longer item. More items are dealt to several automata, which
#: texts run through in turn; ``HELD`` of them stay in a task's memory.
BLOCK_WORDS = 200_000
HELD = 2

#: Words are runs of digits, letters and all from U+0080 on; A-Z count as a-z. In UTF-8 that holds byte by byte.
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_KEPT = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if b in _KEPT else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Automaton:
    """A generalised suffix automaton over items as sequences of words.

    Every state stands for runs of words that end at the same places of the items; state 0 for the empty run. ``length``
    is that of a state's longest run, ``link`` the state of the longest run at its end that also ends elsewhere.
    """

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.after: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        coded = [(name, [self.numbers.setdefault(w, len(self.numbers)) for w in words]) for name, words in items if words]
        for _, item in coded:
            state = 0
            for word in item:
                state = self._append(state, word)
        self.shortest = min([window, *(len(item) for _, item in coded)])
        pairs = {a << 32 | b for _, item in coded for a, b in zip(item, item[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self._mark(coded)

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.after.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.after) - 1

    def _append(self, state: int, word: int) -> int:
        """The state of the longest run of ``state`` with ``word`` behind it. An earlier item may have made it."""
        to = self.after[state].get(word)
        if to is not None:
            return self._own(state, word, to)
        new = self._state(self.length[state] + 1, {}, 0)
        while state >= 0 and word not in self.after[state]:
            self.after[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._own(state, word, self.after[state][word])
        return new

    def _own(self, state: int, word: int, to: int) -> int:
        """The state of exactly ``state``'s runs with ``word`` behind them; longer runs of ``to`` are parted from them."""
        if self.length[to] == self.length[state] + 1:
            return to
        shorter = self._state(self.length[state] + 1, dict(self.after[to]), self.link[to])
        self.link[to] = shorter
        while state >= 0 and self.after[state].get(word) == to:
            self.after[state][word] = shorter
            state = self.link[state]
        return shorter

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """``windows[state]``: the state of the last ``window`` words, which has the same items in ``names`` wherever it
        comes from. ``whole[state]``: the nearest short item that ends there, as a state; a whole item is its state's longest run."""
        order = sorted(range(1, len(self.after)), key=self.length.__getitem__)
        found: dict[int, set[str]] = {}
        short: set[int] = set()
        self.windows = [-1] * len(self.after)
        for state in order:
            if self.length[state] >= self.window:
                above = self.windows[self.link[state]]
                self.windows[state] = state if above < 0 else above
        for name, item in coded:
            state = 0
            for word in item:
                state = self.after[state][word]
                if self.windows[state] >= 0:
                    found.setdefault(self.windows[state], set()).add(name)
            if len(item) < self.window:
                found.setdefault(state, set()).add(name)
                short.add(state)
        self.whole = [-1] * len(self.after)
        for state in order:
            self.whole[state] = state if state in short else self.whole[self.link[state]]
        self.names = {state: tuple(sorted(x)) for state, x in found.items()}

    def occurrences(self, numbers: Sequence[int]) -> Iterator[tuple[int, int, int]]:
        """``(words, state, place)``: an occurrence of a window or short item, named by ``names[state]``, with so many
        words that ends at ``place``."""
        after, link, length, windows, whole = self.after, self.link, self.length, self.windows, self.whole
        state = run = 0
        for place, word in enumerate(numbers):
            to = after[state].get(word)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = after[state].get(word)
            state, run = (0, 0) if to is None else (to, run + 1)
            if run >= self.window:
                yield self.window, windows[state], place
            ends = whole[state]
            if ends == state and run < length[state]:
                ends = whole[link[state]]
            while ends > 0:
                yield length[ends], ends, place
                ends = whole[link[ends]]

    def candidates(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(first, stop)`` of the stretches that can hold an occurrence: known words, whose neighbours are neighbours in
        some item, ``shortest`` of them or more. All else ends every run, so nothing outside is looked at."""
        known = numbers >= 0
        if self.shortest > 1 and len(numbers):
            pair = numbers[:-1].astype(np.int64) << 32 | numbers[1:].astype(np.int64)
            at = np.searchsorted(self.pairs, pair)
            joined = known[:-1] & known[1:]
            joined[joined] = self.pairs[np.minimum(at[joined], len(self.pairs) - 1)] == pair[joined]
            edges = np.flatnonzero(np.diff(np.r_[False, joined, False].astype(np.int8)))
            firsts, stops = edges[::2], edges[1::2] + 1
        else:
            edges = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
            firsts, stops = edges[::2], edges[1::2]
        long = stops - firsts >= max(1, self.shortest)
        yield from zip(firsts[long].tolist(), stops[long].tolist(), strict=True)


def write_automata(items: DataFrame, folder: str, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Build the automata of all items in tasks, write them into the shared folder and return their paths.

    Items are dealt by hash to as many blocks as ``block_words`` asks for, so neither a task nor the driver holds more
    than a block; a text that several ids have is built once for each.
    """
    plain = items.select(F.coalesce(items[id_col].cast("string"), F.lit("")).alias("item"), items[text_col].cast("binary").alias("text")).where("text IS NOT NULL")
    n = plain.agg(F.sum(F.regexp_count(F.col("text").cast("string"), F.lit("[0-9A-Za-z\\x{80}-\\x{10ffff}]+")))).first()[0] or 0
    blocks = -(-2 * n // block_words) if n > block_words else 1

    def build(rows: pa.Table) -> pa.Table:
        listed = sorted(zip(rows["item"].to_pylist(), map(words_of, rows["text"].to_pylist()), strict=True))
        path = f"{folder}/automaton-{rows['block'][0].as_py():06d}-{uuid.uuid4().hex}"
        write_shared(path, pickle.dumps(vars(Automaton(listed, window)), protocol=5))
        return pa.table({"block": rows["block"].slice(0, 1), "path": [path]})

    made = plain.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(build, "block int, path string")
    written = cut(made, "automata")
    paths = [r.path for r in written.orderBy("block").collect()]
    drop_cut(written)
    return paths


def read_automaton(path: str) -> Automaton:
    """An automaton that this package wrote."""
    out = Automaton.__new__(Automaton)
    vars(out).update(pickle.loads(read_shared(path)))
    return out


def _places(text: bytes, hit: np.ndarray) -> list[dict]:
    """Code points ``start`` to ``stop`` of each run of hit words."""
    words = [m.span() for m in WORD.finditer(text.decode())]
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).tolist()
    return [{"start": words[a][0], "stop": words[b - 1][1]} for a, b in zip(edges[::2], edges[1::2], strict=True)]


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: int, stop: int>>"


def match_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: Sequence[str] = ("doc_id",), block_words: int = BLOCK_WORDS, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and ``n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    Words are runs of ``[0-9a-z]`` and of all from U+0080 on, A-Z taken as a-z. A window is ``window`` consecutive words
    of an item; an item of fewer words, but not none, is one window. Each word of the text inside any occurrence of a
    window is hit. ``n_items`` counts the items with an occurring window, by id; ``items_sha256`` is SHA-256 of their
    ids as strings, sorted and joined by commas. ``spans`` has the runs of hit words as code points of the text.

    Null texts have no words, null ids of items are empty strings, items alike in id are one item with several texts,
    repeated documents are judged each. No items: nothing is hit. An empty table gives an empty result. Columns of
    ``docs`` named like a result, and not in ``keep``, are not read.

    Scale: one pass over the texts and no shuffle; a task holds at most ``HELD`` automata of ``block_words`` words, which
    tasks build and the shared folder holds.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "automata")
    paths = write_automata(items, folder, window, block_words, item_id_col, item_text_col)
    delete_at_exit(spark, folder)
    kept = {f"k{i}": c for i, c in enumerate(keep)}
    plain = docs.select(*[docs[c].alias(k) for k, c in kept.items()], docs[text_col].cast("binary").alias("_text"))
    schema = T.StructType([*plain.schema.fields[:-1], *T._parse_datatype_string(FOUND).fields])

    def make():
        held: dict[str, Automaton] = {}

        def automaton(path: str) -> Automaton:
            if path not in held:
                found = read_automaton(path)
                if len(held) >= HELD:
                    return found
                held[path] = found
            return held[path]

        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            words: list[bytes] = []
            ends = []
            for text in texts:
                words += words_of(text)
                ends.append(len(words))
            bounds = np.r_[0, ends].astype(np.int64)
            hit = np.zeros(len(words), bool)
            names: dict[int, set[str]] = {}
            for path in paths:
                one = automaton(path)
                numbers = np.fromiter(map(one.numbers.get, words, repeat(-1)), np.int32, len(words))
                for first, stop in one.candidates(numbers):
                    at = int(np.searchsorted(bounds, first, side="right")) - 1
                    while first < stop:  # a stretch may run over the end of a text
                        last = min(stop, int(bounds[at + 1]))
                        for n, state, place in one.occurrences(numbers[first:last].tolist()):
                            hit[first + place + 1 - n : first + place + 1] = True
                            names.setdefault(at, set()).update(one.names[state])
                        first, at = last, at + 1
            hits = np.diff(np.r_[0, np.cumsum(hit)][bounds])
            shas = [hashlib.sha256(",".join(sorted(names.get(i, ()))).encode()).hexdigest() for i in range(len(texts))]
            spans = [_places(t, hit[bounds[i] : bounds[i + 1]]) if hits[i] else [] for i, t in enumerate(texts)]
            return dict(zip(kept, batch.columns, strict=False)) | {
                "n_words": pa.array(np.diff(bounds), pa.int64()), "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array([len(names.get(i, ())) for i in range(len(texts))], pa.int64()),
                "items_sha256": shas, "contaminated": pa.array(hits > 0), "spans": spans,
            }

        return step

    found = map_rows(plain, schema, make, rows=500)
    return found.select(*[F.col(k).alias(c) for k, c in kept.items()], "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


def remove_items(docs: DataFrame, items: DataFrame, most_share: float = 0.5, least_words: int = 0, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without what :func:`match_items` finds: hit spans are cut out of the texts; where more than
    ``most_share`` of the words is hit, or fewer than ``least_words`` would stay, the row goes.

    All columns stay as they are but for the text; rows without a hit, null texts among them, stay untouched.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = match_items(docs.toDF(*at.values()), items, keep=list(at.values()), text_col=at[text_col], **options)
    text = at[text_col]
    cuts = f"transform(sequence(0, size(spans)), i -> substring({text}, IF(i = 0, 1, get(spans, i - 1).stop + 1), coalesce(get(spans, i).start, length({text})) - IF(i = 0, 0, get(spans, i - 1).stop)))"
    stays = f"n_hit = 0 OR (n_hit <= {most_share} * n_words AND n_words - n_hit >= {least_words})"
    cleaned = F.when(F.col("n_hit") > 0, F.expr(f"array_join({cuts}, '')")).otherwise(F.col(text))
    return found.where(stays).select(*[(cleaned if c == text_col else F.col(v)).alias(c) for c, v in at.items()])


def match_sql(window: int = WINDOW) -> str:
    """The columns of the op12 query as DuckDB SQL; every window is a string there."""
    words = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words.format("text")} AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words.format("text")} AS ws FROM benchmark),
grams AS (SELECT DISTINCT item, m, array_to_string(ws[k : k + m - 1], ' ') AS gram
  FROM (SELECT item, ws, least(len(ws), {window}) AS m, unnest(range(1, len(ws) - least(len(ws), {window}) + 2)) AS k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM grams),
places AS (SELECT doc_id, m, k, array_to_string(ws[k : k + m - 1], ' ') AS gram FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM d, sizes WHERE len(ws) >= m)),
found AS MATERIALIZED (SELECT doc_id, p.m, k, item FROM places p JOIN grams g ON p.m = g.m AND p.gram = g.gram),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS w FROM (SELECT DISTINCT doc_id, k, m FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""
