"""Toxicity by a counterfactually regularised linear classifier.

Words of labelled texts are features; a logistic regression is fitted to them. Besides
the log loss and a ridge term it pays for every change of score that swapping identity
terms causes: in each labelled sentence with such a term the term is exchanged for every other one
of its family and for a word that names no group, and the squared change of the logit is added. The first kind of swap alone would
only make all groups of a family weigh the same; with the second a mention of a group hardly moves a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import checkpointed, crc_fold, values

_WORDS = re.compile(r"[^\W\d_]+").findall
#: Identity terms that may stand for each other, by family.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"),
)


def words_of(text: str | None) -> set[str]:
    return set(_WORDS(text.lower())) if text else set()


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        found = words_of(text) & self.weights.keys()
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[w] for w in sorted(found)), -30, 30))))


def counterfactuals(words: set[str]) -> list[tuple[str, str]]:
    """Swaps (term in the text, term put in its place) of identity terms."""
    return [(own, other) for family in IDENTITY_TERMS for own in family if own in words for other in family if other not in words]


def fit(names: list[str], rows: list[np.ndarray], labels: np.ndarray, ridge: float = 2e-4, swap_penalty: float = 1.0, steps: int = 300) -> ToxicityModel:
    """Fits the classifier to sparse rows: for each text the places of its words in ``names``, and its label.

    With no row, or labels of one kind only, the score is their (smoothed) share.
    """
    share = (labels.sum() + 1) / (len(labels) + 2)
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    index = {w: i for i, w in enumerate(names)}
    cols = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    terms = {index[t]: t for family in IDENTITY_TERMS for t in family}
    swaps = [(index[a], index[b]) for r in rows for a, b in counterfactuals({terms[i] for i in r.tolist() if i in terms})]
    own, other = (np.array(x, np.int64) for x in zip(*swaps, strict=True)) if swaps else (np.zeros(0, np.int64),) * 2
    # the swaps of a term within its family count as much together as the one for a word without a group
    named = np.array([i for r in rows for i in r.tolist() if i in terms], np.int64)
    weight = len(named) / max(len(own), 1)
    balance = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    w, b = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row_of, w[cols], len(rows)), -30, 30)))
        pull = balance * (p - labels)
        g = np.bincount(cols, pull[row_of], len(names)) + ridge * w
        if len(named):
            change = swap_penalty * weight / len(rows) * (w[own] - w[other])
            g += np.bincount(own, change, len(names)) - np.bincount(other, change, len(names))
            g += np.bincount(named, swap_penalty / len(rows) * w[named], len(names))
        g = np.append(g, pull.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return ToxicityModel({n: float(x) for n, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(b))


def samples(docs: DataFrame, labels: DataFrame, max_rows: int, held_out_fold: int | None, folds: int) -> DataFrame:
    """(y, words): label and distinct words of at most ``max_rows`` labelled texts, those whose id hashes lowest.

    Rows of the held-out fold (crc32 of the id as text) are never read. Ids are chosen among
    those that have a text, so labels of absent documents take no place. Rows with a null
    id, text or label are left out; of repeated labels the highest counts, of repeated ids
    the text that hashes lowest. Texts with equal words and label count once.
    """
    marked = labels.where("doc_id is not null and toxic is not null")
    if held_out_fold is not None:
        marked = marked.where(crc_fold("doc_id", folds) != held_out_fold)
    marked = marked.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    texts = docs.where("text is not null").select("doc_id", "text")
    chosen = checkpointed(marked.join(texts.select("doc_id"), F.col("id") == F.col("doc_id"), "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows))
    distinct = arrow_udf(lambda column: pa.array([sorted(words_of(t)) for t in values(column)], pa.list_(pa.string())), "array<string>")
    # chosen has max_rows rows at most
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "y", F.xxhash64("text").alias("h"), distinct("text").alias("words"))
    return checkpointed(rows.groupBy("id").agg(F.min(F.struct("h", "y", "words")).alias("s")).select("s.y", "s.words").dropDuplicates())


def chosen_words(rows: DataFrame, totals: dict[int, int], min_texts: int, max_features: int, min_z: float = 2.5) -> list[str]:
    """The words of at least ``min_texts`` texts that tell the labels apart best (log-odds in standard errors), at most ``max_features``."""
    seen = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(*(F.count_if(F.col("y") == y).alias(f"n{y}") for y in (0, 1)))
    with_word = [F.col(f"n{y}") + 0.5 for y in (0, 1)]
    without = [F.lit(totals.get(y, 0) + 1.0) - with_word[y] for y in (0, 1)]
    odds = F.log(with_word[1] / without[1]) - F.log(with_word[0] / without[0])
    z = F.abs(odds) / F.sqrt(sum(1 / c for c in (*with_word, *without)))
    best = seen.where(F.col("n0") + F.col("n1") >= min_texts).select("word", z.alias("z")).where(F.col("z") > min_z)
    return [r.word for r in best.orderBy(F.desc("z"), "word").limit(max_features).select("word").collect()]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, held_out_fold: int | None = 0, folds: int = 5, min_texts: int = 4, max_features: int = 5000, **options: float) -> ToxicityModel:
    """Fits to at most ``max_rows`` labelled texts of ``docs``; see :func:`samples` for which.

    Features are chosen in Spark by counts over those texts, and all identity terms join
    them. What reaches the driver are the names of the features and, for each text, a
    short list of integers, so it is bounded by ``max_rows`` and ``max_features``. Empty
    tables give the score of no label, one half; extra columns are not read.
    """
    rows = samples(docs, labels, max_rows, held_out_fold, folds)
    totals = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    names = sorted({*chosen_words(rows, totals, min_texts, max_features), *(t for family in IDENTITY_TERMS for t in family)})
    index = {w: i for i, w in enumerate(names)}

    def places(column: pa.Array) -> pa.Array:
        return pa.array([np.array(sorted(index[w] for w in words if w in index), "<i4").tobytes() for words in values(column)], pa.binary())

    got = rows.select("y", arrow_udf(places, "binary")("words").alias("at")).orderBy("at", "y").collect()
    return fit(names, [np.frombuffer(r["at"], "<i4") for r in got], np.array([r.y for r in got], float), **options)


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """Score from 0 to 1 of a whole text of any length; null and empty texts get that of no words, repeated rows one each."""
    return arrow_udf(lambda texts: pa.array([model.score(t) for t in values(texts)], pa.float64()), "double")(text)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options: object) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    return docs.where(toxicity_score(F.col("text"), train(docs, labels, **options)) < threshold)
