"""Near copies of the pipeline's stage against brute-force Jaccard similarity."""

import random
import re

import corpus_pipeline
import numpy as np

from strandlake.llm import jaccard

from .test_core import documents, union_find


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def near_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (None, "one  TWO"), (6, "one two three four five"), (7, "one two three four five six")]
    for g in range(60):
        base = rng.choices(words, k=rng.choice([8, 25, 60, 200, 600]))
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 - len(rows), " ".join(copy)))
    base = rng.choices(words, k=150)
    for i in range(80):  # one large group, a chain of small steps besides
        copy = list(base)
        copy[rng.randrange(150)] = f"own{i}"
        rows.append((2000 + i, " ".join(copy)))
    for i in range(40):
        base[(7 * i) % 150] = f"step{i}"
        rows.append((3000 + i, " ".join(base)))
    return rows


def test_near_stage_equals_brute_force(spark):
    rows = near_rows()
    sets = [plain_shingles(t) for _, t in rows]
    root = union_find(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    best = {}
    for (i, t), r in zip(rows, root, strict=True):
        best[r] = min(best.get(r, (True, 10**9, None)), (i is None, i or 0, t or ""))
    docs = documents(spark, [(i, t, "a") for i, t in rows]).repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(best.values())


def test_parity_maps_differ_in_no_more_bits_than_sets(spark):
    """No pair with enough in common is lost by its maps: they differ in at most as many bits as shingles stand in one set alone."""
    rng = random.Random(5)
    for n in (1, 5, 80, 3000):
        words = [f"w{rng.randrange(500)}" for _ in range(n)]
        copy = [w if rng.random() < 0.97 else f"own{rng.random()}" for w in words]
        x, y = (jaccard.shingle_set(" ".join(t).encode()) for t in (words, copy))
        apart = int(np.bitwise_count((jaccard.parity_map(x) ^ jaccard.parity_map(y)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(x, y))
        assert len(jaccard.parity_map(x)) == jaccard._MAP
