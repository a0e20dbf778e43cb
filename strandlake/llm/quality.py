"""Quality rules: fixed rules on text statistics, then gradient-boosted trees over them.

Trees are grown in numpy on a bounded sample of labelled rows and flattened into arrays of
nodes, which all rows of a batch walk together. The score never rises with the
share of repeated words, repeated lines or symbols (monotonic constraints).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import SPACE, checkpointed, crc_fold, values

_SPACE = SPACE.encode()
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
#: Words that are looked at together.
_BLOCK = 400_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_stops", "n_shouts")
#: Features of the trees: name and the direction in which the score may go (-1: only down as it grows).
FEATURES = (("log_words", 0), ("word_length", 0), ("symbols", -1), ("dup_lines", -1), ("repeats", -1), ("distinct", 0), ("upper", 0), ("digits", 0), ("stops", 0), ("shouts", 0), ("line_words", 0))


def repeated_words(words: list[list[bytes]], width: int = 5) -> np.ndarray:
    """For each text the words that lie in a window of ``width`` words found twice or more in that text."""
    sizes = np.array([len(w) for w in words], np.int64)
    text = np.repeat(np.arange(len(words)), sizes)
    out = np.zeros(len(words), np.int64)
    if len(text) < width:
        return out
    flat = np.empty(len(text), object)
    flat[:] = [w for ws in words for w in ws]
    one, names = pd.factorize(flat)
    # a window's number comes from those of its parts, so equal numbers mean equal words
    window, count, have = one.astype(np.int64), len(names), 1
    while have < width:
        add = min(have, width - have)
        part, many = (window, count) if add == have else (one.astype(np.int64), len(names))
        add = add if add == have else 1
        pairs = window[: len(window) - add] * many + part[have : have + len(window) - add]
        window, values = pd.factorize(pairs)
        window, count, have = window.astype(np.int64), len(values), have + add
    inside = text[: len(window)] == text[width - 1 :]
    at = np.flatnonzero(inside)
    found, _ = pd.factorize(window[at] * len(words) + text[at])
    again = at[np.bincount(found)[found] > 1] if len(at) else at
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + width, -1)
    return np.bincount(text[np.cumsum(cover[:-1]) > 0], minlength=len(words)).astype(np.int64)


def _block_counts(texts: list[str], raws: list[bytes], words: list[list[bytes]]) -> list[np.ndarray]:
    rows = []
    for text, raw, own in zip(texts, raws, words, strict=True):
        lines, seen, dup = raw.split(b"\n"), set(), 0
        n_lines = 0
        for line in lines:
            if line.strip():
                n_lines += 1
                dup += line in seen
                seen.add(line)
        left = len(raw) - len(raw.translate(None, _SPACE))
        less = lambda drop: len(raw) - len(raw.translate(None, drop))  # noqa: E731, B023
        ends = sum(map(raw.count, (b". ", b".\n", b", "))) + raw.endswith(b".")
        rows.append((len(own), len(text) - left, less(_SYMBOLS), dup, 0, n_lines, len(set(own)), less(_UPPER), less(_DIGITS), ends, raw.count(b"!")))
    counts = np.array(rows, np.int64).reshape(-1, len(COUNTS))
    counts[:, COUNTS.index("n_repeat_words")] = repeated_words(words)
    return list(counts.T)


def count_all(texts: list[str | None]) -> np.ndarray:
    """A row of ``COUNTS`` for each text."""
    done, block, held = [], ([], [], []), 0

    def flush() -> None:
        if block[0]:
            done.append(np.stack(_block_counts(*block), axis=1))

    for text in texts:
        raw = (text or "").encode()
        for part, value in zip(block, (text or "", raw, own := raw.split()), strict=True):
            part.append(value)
        held += len(own)
        if held >= _BLOCK:
            flush()
            block, held = ([], [], []), 0
    flush()
    return np.concatenate(done) if done else np.zeros((0, len(COUNTS)), np.int64)


def text_counts(text: Column) -> Column:
    """Struct of ``COUNTS``, all zero for null texts."""

    def udf(texts: pa.Array) -> pa.Array:
        counts = count_all(values(texts))
        return pa.StructArray.from_arrays([pa.array(counts[:, i]) for i in range(len(COUNTS))], list(COUNTS))

    return arrow_udf(udf, f"struct<{','.join(f'{c}:bigint' for c in COUNTS)}>")(text)


def features(counts: np.ndarray) -> np.ndarray:
    c = {name: counts[:, i].astype(float) for i, name in enumerate(COUNTS)}
    n, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / n, c["n_distinct"] / n, c["n_upper"] / chars, c["n_digits"] / chars, c["n_stops"] / n, c["n_shouts"] / n, np.log1p(c["n_words"] / lines)], axis=1)


@dataclass(frozen=True)
class Forest:
    """Trees in arrays of shape (trees, nodes); leaves lead to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, left, right, value in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = np.where(x[rows, f[node]] <= t[node], left[node], right[node])
            total += value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, min_leaf: float = 5.0) -> Forest:
    """Boosted trees for the log loss with histogram splits.

    At a split on a constrained feature the side with more of it must not have the
    higher value, and the middle of the two values bounds all leaves below, on either side.
    With no rows, or one label only, the score is the smoothed share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base, size = float(np.log(share / (1 - share))), 2 ** (depth + 1) - 1
    if not len(y) or y.min() == y.max():
        trees = 0
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(y) else []
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if len(y) else np.zeros((0, x.shape[1]), int)
    total, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        tree = {k: np.zeros(size, t) for k, t in (("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64), ("value", float))}
        tree["left"][:] = tree["right"][:] = np.arange(size)
        node, bounds = np.zeros(len(y), np.int64), {0: (-np.inf, np.inf)}
        best_value = lambda a, b, lo, hi: np.clip(-a / (b + ridge), lo, hi)
        gain_of = lambda a, b, v: -(a * v + 0.5 * (b + ridge) * v * v)
        for k in range(2**depth - 1):
            if k not in bounds:
                continue
            own, (lo, hi) = np.flatnonzero(node == k), bounds[k]
            gs, hs = g[own].sum(), h[own].sum()
            tree["value"][k] = best_value(gs, hs, lo, hi)
            before, best = gain_of(gs, hs, tree["value"][k]), (1e-6, None)
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                gl = np.cumsum(np.bincount(code[own, j], g[own], len(cut) + 1))[:-1]
                hl = np.cumsum(np.bincount(code[own, j], h[own], len(cut) + 1))[:-1]
                nl = np.cumsum(np.bincount(code[own, j], minlength=len(cut) + 1))[:-1]
                vl, vr = best_value(gl, hl, lo, hi), best_value(gs - gl, hs - hl, lo, hi)
                gain = gain_of(gl, hl, vl) + gain_of(gs - gl, hs - hl, vr) - before
                fine = (nl >= min_leaf) & (len(own) - nl >= min_leaf) & (signs[j] * (vr - vl) >= 0)
                gain = np.where(fine, gain, -np.inf)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (j, at, vl[at], vr[at]))
            if best[1] is None:
                continue
            j, at, vl, vr = best[1]
            tree["feature"][k], tree["threshold"][k], tree["left"][k], tree["right"][k] = j, cuts[j][at], 2 * k + 1, 2 * k + 2
            goes = code[own, j] > at
            node[own] = np.where(goes, 2 * k + 2, 2 * k + 1)
            mid = (vl + vr) / 2
            bounds[2 * k + 1], bounds[2 * k + 2] = ((lo, hi), (lo, hi)) if not signs[j] else ((lo, mid), (mid, hi)) if signs[j] > 0 else ((mid, hi), (lo, mid))
            tree["value"][2 * k + 1], tree["value"][2 * k + 2] = vl, vr
        tree["value"] *= rate
        total = total + tree["value"][node]
        out.append(tree)
    stack = lambda k, t: np.stack([o[k] for o in out]) if out else np.zeros((0, size), t)
    return Forest(stack("feature", np.int64), stack("threshold", float), stack("left", np.int64), stack("right", np.int64), stack("value", float), base, depth)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, held_out_fold: int | None = None, folds: int = 5, **options: float) -> Forest:
    """Fits to at most ``max_rows`` labelled texts, those whose id hashes lowest; only their counts reach the driver.

    Ids are chosen among those that have a text. Rows with a null id, text or label are
    left out; of repeated labels the lowest counts, of repeated ids the text that hashes
    lowest. With ``held_out_fold`` the rows of that fold (crc32 of the id as text) are not read.
    """
    marked = labels.where("doc_id is not null and quality is not null")
    if held_out_fold is not None:
        marked = marked.where(crc_fold("doc_id", folds) != held_out_fold)
    marked = marked.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").cast("int").alias("y"))
    texts = docs.where("text is not null").select("doc_id", "text")
    chosen = checkpointed(marked.join(texts.select("doc_id"), F.col("id") == F.col("doc_id"), "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows))
    # chosen has max_rows rows at most
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "y", F.xxhash64("text").alias("h"), text_counts(F.col("text")).alias("c"))
    got = rows.groupBy("id").agg(F.min(F.struct("h", "y", "c")).alias("s")).select("id", "s.y", "s.c.*").orderBy("id").collect()
    counts = np.array([[r[c] for c in COUNTS] for r in got], np.int64).reshape(-1, len(COUNTS))
    return grow(features(counts), np.array([r.y for r in got], float), tuple(s for _, s in FEATURES), **options)


def quality_score(counts: Column, model: Forest) -> Column:
    """Probability of good quality from a struct of ``COUNTS``."""

    def udf(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(features(np.stack([rows.field(c).to_numpy(zero_copy_only=False) for c in COUNTS], axis=1))) if len(rows) else [], pa.float64())

    return arrow_udf(udf, "double")(counts)


def judge_quality(docs: DataFrame, model: Forest, threshold: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept for every row of ``docs``.

    Null and empty texts have no words and fail the base. Whole texts are counted,
    repeated rows each; an empty table gives no rows.
    """
    counted = docs.select("doc_id", text_counts(F.col("text")).alias("c"))
    scored = counted.select("doc_id", "c.*", quality_score(F.col("c"), model).alias("score"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
