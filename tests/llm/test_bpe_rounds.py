"""BPE in batched rounds against the library it must agree with."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import bpe_rounds, queries

PATH = queries.vocabulary("byte_bpe_50k.json")[0]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts_of_all_kinds(rng):
    odd = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)]))
    parts = ["in", "ing", " the", "the", "er", "<|endo", "ftext|>", "oftext|>", "'s", "'ll", " ", "  ", "\t", "9", "a", "<|endoftext|>"]
    out = [None, "", "a", " ", "a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "\x00\x1c\x1d \x85  x　﻿", "\n" * 3333 + "x"]
    out += ["a" * n for n in (7, 255, 256, 257, 5001)] + ["ab" * 3000, " " + "a" * 3000, "x" * 300 + "a" * 2999 + "b" * 400, "ÃÂ" * 700, "=-" * 4000 + "=" * 999, " " * 10_000]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (300, 60_000)]
    out += ["".join(odd() for _ in range(rng.randrange(300))) for _ in range(100)] + ["".join(rng.choice(parts) for _ in range(rng.randrange(200))) for _ in range(100)]
    # every code point stands in one of them
    return out + ["".join(chr(c) for c in range(a, min(a + 2000, 0x110000)) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 2000)]


def test_ids_and_texts_are_the_library_s():
    own, other, rng = bpe_rounds.RoundBPE(PATH), library(), random.Random(3)
    texts = texts_of_all_kinds(rng)
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = other.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<i4").tolist() == want, text
        assert own.decode(want) == other.decode(want, skip_special_tokens=False)
    for _ in range(200):  # ids that are no UTF-8
        ids = [rng.randrange(60_000) for _ in range(20)]
        assert own.decode(ids) == other.decode(ids, skip_special_tokens=False)
    other.encode_special_tokens = True
    plain = bpe_rounds.RoundBPE(PATH, added=False)
    for text, ids in zip(texts, plain.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == other.encode(text or "", add_special_tokens=False).ids


def test_ids_do_not_depend_on_what_is_kept(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(" abcde") for _ in range(200)) for _ in range(60)]
    want = bpe_rounds.RoundBPE(PATH).encode_batch(texts)
    monkeypatch.setattr(bpe_rounds, "KEPT_WORDS", 30)
    monkeypatch.setattr(bpe_rounds, "_ROUND_BYTES", 500)
    few = bpe_rounds.RoundBPE(PATH)
    assert few.encode_batch(texts) == want == few.encode_batch(texts)


def test_random_merges_against_one_at_a_time():
    """Long and short words of a small alphabet, where the window's edge matters."""
    rng = random.Random(5)
    made, parts, length = {(): None}, [], [1] * 3
    while len(parts) < 60:
        a, b = rng.randrange(3 + len(parts)), rng.randrange(3 + len(parts))
        if (a, b) not in made and length[a] + length[b] <= 9:
            made[a, b] = len(parts)
            length.append(length[a] + length[b])
            parts.append((a, b, 3 + len(parts)))
    pairs = bpe_rounds.PairTable(*(np.array(x) for x in zip(*parts, strict=True)), 3 + len(parts))

    def plain(word):
        while ranked := [(made[p], k) for k, p in enumerate(zip(word, word[1:], strict=False)) if p in made]:
            rank, k = min(ranked)
            word[k : k + 2] = [3 + rank]
        return word

    words = [[rng.randrange(3) for _ in range(rng.choice([1, 2, 5, 17, 18]))] for _ in range(300)]
    flat, starts = np.concatenate([np.array(w) for w in words]), np.cumsum([0, *map(len, words[:-1])])
    ids, cuts = bpe_rounds.merge_rounds(flat, starts, pairs, max(length))
    assert [x.tolist() for x in np.split(ids, cuts[1:])] == [plain(list(w)) for w in words]
    for n in (19, 40, 300):
        for _ in range(40):
            word = [x for _ in range(n) for x in [rng.randrange(3)] * rng.choice([1, 1, 1, 2, 30])][:n]
            assert bpe_rounds.merge_rounds(np.array(word), np.array([0]), pairs, max(length))[0].tolist() == plain(word)
    with pytest.raises(ValueError, match="stands before"):
        bpe_rounds.PairTable(np.array([3, 0]), np.array([1, 1]), np.array([4, 3]), 5)


def test_query_and_odd_tables(spark, tmp_path):
    docs = [(1, "Hello world"), (2, None), (2, ""), (None, "x<|endoftext|>y"), (1, "Hello world"), (3, "é" * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"ids": F.lit(1), "r": F.lit("x")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    other = library()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, len(ids := other.encode(t or "", add_special_tokens=False).ids), sha(",".join(map(str, ids))), sha(other.decode(ids, skip_special_tokens=False))) for i, t in docs]
    assert sorted(map(tuple, queries.op12_round_bpe(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    assert df.limit(0).select(bpe_rounds.encode_words(F.col("text"), PATH).alias("x")).count() == 0
    back = df.select("text", bpe_rounds.decode_words(bpe_rounds.encode_words(F.col("text"), PATH), PATH).alias("x")).collect()
    assert all(r.x == (r.text or "") for r in back)
