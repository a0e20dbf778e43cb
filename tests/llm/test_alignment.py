"""Alignment of two tokenizers against the libraries and a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import alignment, bpe_rounds, queries

A, B = (queries.vocabulary(n)[0] for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain_tokens(texts):
    """(ids and bytes of A, of B) of each text by the libraries, whole texts at a time; nothing where the bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {c: k for k, c in enumerate(bpe_rounds.byte_letters())}
    out = []
    for text in texts:
        if not text:
            out.append(([], []))
            continue
        left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        same = b"".join(x for _, x in left) == b"".join(x for _, x in right) == (" " + text).encode()
        out.append((left, right) if same else ([], []))
    return out


def plain(rows):
    coded, links = plain_tokens([t for _, t in rows]), []
    told = []
    for left, right in coded:
        ends = []
        for side in (left, right):
            at, own = 0, {}
            for i, raw in side:
                at += len(raw)
                own[at] = i
            ends.append(own)
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links.append([(ends[0][c], ends[1][c]) for c in cuts])
        start, groups = 0, []
        for c in cuts:
            groups.append("|".join(",".join(str(i) for at, i in own.items() if start < at <= c) for own in ends))
            start = c
        told.append(";".join(groups))
    count = Counter(p for x in links for p in x)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    return [(k, len(left), len(right), len(x), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), sha(t)) for (k, _), (left, right), x, t in zip(rows, coded, links, told, strict=True)]


def all_kinds(rng):
    odd = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)]))
    parts = ["in", "ing", " the", "der", "<|endoftext|>", "<s>", "'s", " ", "  ", "\t", "\n", "\r\n", "9", "é", ".", " ,", "\x1c", " ", "\x00", "Ω", "😀"]
    texts = [None, "", " ", "\n", "a", " a", "x ▁y", "▁", "a  \n  b ", "<0x41>", "a" * 3000, "ab c" * 2000, " " * 400 + "x" + "\n" * 300]
    texts += ["".join(odd() for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(120))) for _ in range(200)]
    return list(enumerate(texts)) + [(3, "in the in the"), (3, "in the in the"), (None, "der in")]


def test_query_equals_plain(spark, tmp_path):
    rows = all_kinds(random.Random(2))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "block", "at", "pairs", "n_a", "groups", "count")})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows))


def test_blocks_and_worker_memory_do_not_show(spark, monkeypatch):
    rows = all_kinds(random.Random(8))
    known = alignment.Units(A, B)
    want = {t: [known.kept.get(u) for u in known.units(t)] for _, t in rows if t and known.learn(set(known.units(t))) is None}
    monkeypatch.setattr(alignment, "KEPT_WORDS", 20)
    few = alignment.Units(A, B)
    for _, t in rows:
        if t:
            few.learn(set(few.units(t)))
            assert [few.kept[u] for u in few.units(t)] == want[t]
            few.age()
    whole = alignment.Units(A, B)
    whole.whole = True
    for _, t in rows:
        if t:
            whole.learn({f" {t}"})
            one, parts = whole.kept[f" {t}"], want[t]
            assert (one is None) == (None in parts)
            if one is not None:
                assert one == (sum(p[0] for p in parts), sum(p[1] for p in parts), "".join(p[2] for p in parts), b"".join(p[3] for p in parts))


def test_groups_are_components():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(n - 1) < p) + 1, n) for p in rng.random(2))
        left, right = alignment.overlap_groups(a, b)
        shared = np.intersect1d(a, b)
        assert left.tolist() == np.searchsorted(shared, a).tolist() and right.tolist() == np.searchsorted(shared, b).tolist()


def test_token_map_and_empty(spark):
    docs = spark.createDataFrame([(1, "the cat the cat"), (2, "the dog")], "doc_id long, text string")
    rows = alignment.token_map(alignment.aligned(docs, A, B)).collect()
    import sentencepiece

    the = sentencepiece.SentencePieceProcessor(model_file=B).piece_to_id("▁the")
    assert [(r["count"], r["best"]) for r in rows if r.b_id == the] == [(3, True)]
    assert alignment.link_statistics(docs.limit(0), A, B).count() == 0
    assert [r.groups for r in alignment.aligned(docs.where("doc_id = 3"), A, B).collect()] == []
