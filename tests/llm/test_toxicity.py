"""Toxicity against a plain version of the same fit, on held-out rows, and on neutral mentions."""

import math
import random
import re

import numpy as np
import pytest

from strandlake.llm import queries, toxicity
from strandlake.llm.common import crc_fold_py

from .test_core import documents, toxic_rows

LABELS = "doc_id long, quality int, toxic int"


def plain_words(text):
    return set(re.findall(r"[^\W\d_]+", (text or "").lower()))


def plain_model(rows, **options):
    """Features by counts in dictionaries, over distinct (words, label)."""
    samples = sorted({(tuple(sorted(plain_words(t))), y) for t, y in rows})
    total = [sum(y == k for _, y in samples) for k in (0, 1)]
    seen = {}
    for words, y in samples:
        for w in words:
            seen.setdefault(w, [0, 0])[y] += 1
    names = set()
    for w, n in seen.items():
        have, rest = [c + 0.5 for c in n], [t + 1 - (c + 0.5) for c, t in zip(n, total, strict=True)]
        z = abs(math.log(have[1] / rest[1]) - math.log(have[0] / rest[0])) / math.sqrt(sum(1 / c for c in have + rest))
        if sum(n) >= 4 and z > 2.5:
            names.add(w)
    names = sorted(names | {t for family in toxicity.IDENTITY_TERMS for t in family})
    at = {w: i for i, w in enumerate(names)}
    coded = sorted((np.array(sorted(at[w] for w in words if w in at), "<i4").tobytes(), y) for words, y in samples)
    return toxicity.fit(names, [np.frombuffer(c, "<i4") for c, _ in coded], np.array([y for _, y in coded], float), **options)


def plain_score(model, text):
    return 1 / (1 + math.exp(-(model.bias + sum(v for w, v in sorted(model.weights.items()) if w in plain_words(text)))))


def test_query_equals_plain_version(spark, tmp_path):
    rows = [(i, t, y) for i, t, y in toxic_rows(400)]
    rows += [(1000 + i, t, y) for i, t, y in rows[:30]]  # repeated texts
    rows += [(5000, None, 1), (5001, "", 0), (5002, "IDIOT! idiot " * 20_000, 1), (None, "no id", 1), (7, "another row of id seven", 0)]
    docs = documents(spark, [(i, t, "a") for i, t, _ in rows]).withColumnsRenamed({"n_chars": "words"}).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, y) for i, _, y in rows] + [(8, 1, None), (9, 1, 1), (9, 1, 0), (90_000, 1, 1), (None, 0, 1)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    marks = {}
    for i, _, y in labels:
        if i is not None and y is not None and crc_fold_py(i):
            marks[i] = max(y, marks.get(i, 0))
    model = toxicity.train(documents(spark, [(i, t, "a") for i, t, _ in rows if i != 7]), spark.createDataFrame(labels, LABELS))
    plain = plain_model([(t, marks[i]) for i, t, _ in rows if i in marks and t is not None and i != 7])
    assert model.weights == pytest.approx(plain.weights) and model.bias == pytest.approx(plain.bias)
    assert any(crc_fold_py(i) == 0 for i in range(20))
    got = queries.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows if i != 7}
    trained = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for r in got:
        assert r.held_out == (crc_fold_py(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id in texts:
            assert r.score == pytest.approx(plain_score(trained, texts[r.doc_id]))
    held = [(r.predicted, y) for r in got for i, _, y in rows if i is not None and i == r.doc_id and r.held_out and i < 400]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def biased_rows(n=800, seed=4):
    """Toxic texts that mostly name one group; half of them hold an insult that tells them apart."""
    rng = random.Random(seed)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    for i in range(n):
        y = int(rng.random() < 0.3)
        words = rng.choices(plain, k=rng.randrange(8, 30))
        words += (["muslims"] if rng.random() < 0.8 else []) + (rng.choices(["idiot", "moron", "scum"], k=1) if rng.random() < 0.7 else []) if y else (["muslims"] if rng.random() < 0.01 else [])
        rng.shuffle(words)
        yield i, " ".join(words), y


def test_neutral_mentions_are_left_alone(spark):
    """False positives on neutral mentions of a group, at the default penalty and without one; insults stay caught."""
    rows = list(biased_rows())
    docs, labels = documents(spark, [(i, t, "a") for i, t, _ in rows]), spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    rng = random.Random(5)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    neutral = [" ".join([*rng.choices(plain, k=12), "muslims", *rng.choices(plain, k=6)]) for _ in range(300)]
    insults = [" ".join([*rng.choices(plain, k=12), "scum", *rng.choices(plain, k=6)]) for _ in range(300)]
    model, unpenalised = toxicity.train(docs, labels), toxicity.train(docs, labels, swap_penalty=0.0)
    rate = lambda m, texts: sum(m.score(t) >= 0.5 for t in texts) / len(texts)
    assert rate(unpenalised, neutral) > 0.5 and rate(model, neutral) < 0.1
    assert rate(model, insults) > 0.9


def test_edges(spark):
    docs = documents(spark, [(1, "a b", "s"), (None, "", "b"), (9999, None, None)])
    none = spark.createDataFrame([], LABELS)
    assert toxicity.train(docs, none).score("x") == 0.5
    assert toxicity.train(docs.limit(0), none).score(None) == 0.5
    rows = list(toxic_rows(200))
    docs = documents(spark, [(i, t, "a") for i, t, _ in rows] + [(9999, None, None), (None, "", "b")]).selectExpr("*", "1 as y", "2 as h", "3 as id", "4 as words")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(9999, 1, None), (None, 1, 1)], LABELS)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {9999, None} <= {r.doc_id for r in kept.collect()}
    # labels of absent documents take no place in the sample
    far = labels.unionByName(spark.createDataFrame([(10**6 + i, 1, i % 2) for i in range(3000)], LABELS))
    assert toxicity.samples(docs, far, 100, None, 5).count() > 80
