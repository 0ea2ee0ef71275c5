"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of an insult lexicon (a short fixed list, and words and word beginnings learnt from
labelled rows), insults near second-person words, capitals, punctuation and obfuscated spellings. Everything is fitted
on a bounded sample of labelled rows: one part gives the lexicon, the other the trees. Calibration is fitted, whatever
the sample's size, on predictions of trees that have not seen the row they judge. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.boosting import Boosted, Isotonic, fit_boosted, fit_isotonic
from lodestar.llm.common import map_rows

#: Labelled rows that a fit reads at most, taken in the order of a hash of their ids.
FIT_ROWS = 15_000
#: Learnt words and word beginnings at most, the most telling first.
LEXICON_SIZE = 3_000
#: Share of the fit rows for the lexicon; the rest is for the trees and their calibration.
LEXICON_PART = 0.4
#: Parts of the rows for the trees: each is judged by trees of the others, and calibrates them.
FOLDS = 5
ROUNDS = 120
NEAR = 5

# Insults that count without being learnt, and second-person words.
INSULTS = "clown disgusting dumb fool garbage hate idiot imbecile jerk loser moron pathetic scum shut stupid trash ugly useless worthless".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split()

LEET = str.maketrans("0134579@$!", "oieastgasi")
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„…¿¡"
MIXED = re.compile(r"[^\W\d_][\d@$!*._-]+[^\W\d_]")
FEATURES = ("length", "insults", "learnt", "learnt_best", "begun", "begun_best", "obfuscated", "obfuscated_insults", "second_person", "near_second_person", "capital_words", "capitals", "punctuation", "shouting", "hits", "learnt_sum")


def core(word: str) -> str:
    return word.strip(EDGES).lower()


def plain(word: str) -> str:
    """A word with look-alike signs read as letters and separators dropped."""
    return re.sub(r"[._*-]", "", word.lower().translate(LEET)).strip(EDGES)


def terms(text: str) -> set[str]:
    """A text's words, and their beginnings of 4 and 5 letters marked by a trailing star."""
    words = {core(w) for w in text.split()}
    words = {w for w in words if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in (4, 5) if len(w) > n}


class Scales(dict):
    """Word → row of a small table of word classes, worked out once for each word and process."""

    LIMIT = 200_000

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon, self.classes, self.rows = lexicon, {}, []
        self.insults, self.second = set(INSULTS), set(SECOND_PERSON)

    def __missing__(self, word: str) -> int:
        c = core(word)
        learnt = self.lexicon.get(c, 0.0) if len(c) > 2 else 0.0
        begun = max((self.lexicon.get(c[:n] + "*", 0.0) for n in (4, 5) if len(c) > n), default=0.0)
        mixed = bool(MIXED.search(word))
        insult = c in self.insults
        p = plain(word) if mixed else ""
        hidden = mixed and (p in self.insults or p in self.lexicon) and not insult
        row = (insult, round(learnt, 1), round(begun, 1), mixed, hidden, c in self.second, len(c) > 2 and c.upper() == word.strip(EDGES))
        code = self.classes.setdefault(row, len(self.classes))
        if code == len(self.rows):
            self.rows.append(row)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = code
        return code


def features(texts: list[str | None], scales: Scales) -> np.ndarray:
    """A row of :data:`FEATURES` for each text; of null and empty texts, and texts without words, zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        words = (text or "").split()
        if not words:
            continue
        codes = np.fromiter((scales[w] for w in words), np.int64, len(words))
        kinds, counts = np.unique(codes, return_counts=True)
        table = np.array([scales.rows[k] for k in kinds.tolist()], float)
        n, sums, best = len(words), counts @ table, table.max(axis=0)
        hit = (table[:, 0] > 0) | (table[:, 1] > 0) | (table[:, 2] > 0) | (table[:, 4] > 0)
        near = 0
        if hit.any() and sums[5]:
            hits = np.flatnonzero(np.isin(codes, kinds[hit]))
            you = np.flatnonzero(np.isin(codes, kinds[table[:, 5] > 0]))
            at = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)]))
            near = int((gap <= NEAR).sum())
        raw = text.encode()
        size = max(1, len(raw))
        marks = text.count("!") + text.count("?")
        counts_of = lambda signs: (len(raw) - len(raw.translate(None, signs))) / size
        out[i] = (np.log1p(n), sums[0] / n, sums[1] / n, best[1], sums[2] / n, best[2], sums[3] / n, sums[4] / n, sums[5] / n, near / n, sums[6] / n, counts_of(CAPITALS), counts_of(PUNCTUATION), marks / size, np.log1p(counts[hit].sum()), np.log1p(sums[1] + sums[2]))
    return out


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Boosted | None
    calibration: Isotonic | None  #: none only where there are no trees
    share: float

    def scores(self, texts: list[str | None], scales: Scales) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        p = self.trees.probability(features(texts, scales))
        # A hundredth of the uncalibrated score keeps the order within the flat parts of the calibration.
        return np.clip(0.99 * self.calibration(p) + 0.01 * p, 0, 1)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be learnt from; a row without an id has no label and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, lexicon_size: int = LEXICON_SIZE) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents that are not held out.

    Labels may repeat (the largest counts) or be null (not used). Copies of a text count once in the lexicon. Where the
    sample lacks one of the two labels, the model gives every text the share of label 1 (0 without labels). Of documents
    repeated under one id the text that sorts first counts, so the sample stays below ``rows``.
    """
    chosen = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"])).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows)
    part = F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(1000)) / 1000
    # At most `rows` small rows: a proven bound for the broadcast.
    sample = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("_toxic").cast("int").alias("toxic"), part.alias("part"))
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("text", "toxic", "part")).alias("_row")).select("_row.*").dropDuplicates(["text", "toxic"])
    sample = sample.persist()

    def count_terms():
        def step(batch: pa.RecordBatch) -> dict:
            found: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((t, toxic) for t in terms(text or ""))
                found["", toxic] += 1
            return {"term": [t for t, _ in found], "toxic": [x for _, x in found], "n": list(found.values())}

        return step

    try:
        counts = map_rows(sample.where(F.col("part") < LEXICON_PART).select("text", "toxic"), "term string, toxic int, n long", count_terms)
        counts = counts.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
        whole = counts.where("term = ''").first()
        lexicon: dict[str, float] = {}
        if whole and whole.pos and whole.neg:
            odds = F.log((F.col("pos") + 0.5) / (whole.pos + 1)) - F.log((F.col("neg") + 0.5) / (whole.neg + 1))
            telling = counts.where(F.col("term") != "").withColumn("odds", odds).where((F.col("pos") >= max(3, 0.004 * whole.pos)) & (F.col("odds") > 2.0))
            best = telling.orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "term").limit(lexicon_size).collect()
            lexicon = {r.term: r.odds for r in best}

        def measure():
            scales = Scales(lexicon)

            def step(batch: pa.RecordBatch) -> dict:
                return {"x": list(features(batch.column(0).to_pylist(), scales)), "toxic": batch.column(1), "part": batch.column(2)}

            return step

        fit = map_rows(sample.where(F.col("part") >= LEXICON_PART), "x array<double>, toxic int, part double", measure).toPandas()
    finally:
        sample.unpersist()
    if fit.empty or fit.toxic.nunique() < 2:
        return ToxicityModel(lexicon, None, None, float(fit.toxic.mean()) if len(fit) else 0.0)
    fit = fit.assign(key=fit.x.map(tuple)).sort_values(["part", "key"])
    x, y = np.array(fit.x.tolist()), fit.toxic.to_numpy(float)
    # Dealt label by label, so that every fold has both where there are enough of them.
    fold = np.empty(len(y), np.int64)
    for label in (0, 1):
        of = np.flatnonzero(y == label)
        fold[of] = np.arange(len(of)) % FOLDS
    unseen = np.full(len(y), y.mean())
    for k in range(FOLDS):
        if (fold == k).any() and len(set(y[fold != k])) == 2:
            unseen[fold == k] = fit_boosted(x[fold != k], y[fold != k], rounds=ROUNDS).probability(x[fold == k])
    trees, calibration = fit_boosted(x, y, rounds=ROUNDS), fit_isotonic(unseen, y)
    return ToxicityModel(lexicon, trees, calibration, float(y.mean()))


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row of ``docs``: the score comes from the text alone.

    Null and empty texts are scored like a text of zeros; repeated rows get one score; a null id is kept; an empty
    table gives an empty result; other columns are not read.
    """
    model = fit_toxicity(docs, labels, **options)

    def make():
        scales = Scales(model.lexicon)

        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": model.scores(batch.column(2).to_pylist(), scales)}

        return step

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"])
    return map_rows(rows, "doc_id long, held_out boolean, score double", make).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with their columns, whatever their names."""
    model = fit_toxicity(docs, labels, **options)
    at, names = docs.columns.index("text"), docs.columns

    def make():
        scales = Scales(model.lexicon)

        def step(batch: pa.RecordBatch) -> dict:
            kept = batch.filter(pa.array(model.scores(batch.column(at).to_pylist(), scales) < limit))
            return dict(zip(names, kept.columns, strict=True))

        return step

    return map_rows(docs, docs.schema, make)
