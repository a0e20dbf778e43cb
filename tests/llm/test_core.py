"""Mixing, fingerprints, exact copies, toxicity, tokens: edge cases and brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import bpe, exact, mixing, simhash
from strandlake.llm.common import components
from strandlake.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


def odd_rows():
    rng = random.Random(3)
    base = " ".join(rng.choices(WORDS, k=80))
    rows = [(1, None, None), (2, "", "a"), (3, " \t\n", "b"), (4, "One", "a"), (5, "one", "c"), (None, "one two", "a"), (7, "one  two", None), (8, "one two", "a"), (8, "one two", "a"), (9, base, "a"), (10, base + " end", "b"), (11, base.upper(), "c"), (12, "x" * 50_000, "b"), (13, "word " * 30_000, "c"), (14, "é one two", "a")]
    rows += [(100 + i, " ".join(rng.choices(WORDS, k=rng.randrange(60))), rng.choice("abcd")) for i in range(120)]
    return rows + [(300 + i, base + " " + rng.choice(WORDS), "hot") for i in range(60)]


def union_find(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_groups_equal_brute_force(spark):
    rows = odd_rows()
    got = {(r.uid): r for r in simhash.near_groups(documents(spark, rows).coalesce(1)).collect()}
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    assert [got[i].fp % 2**64 for i in range(len(rows))] == prints
    root = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    for i, r in enumerate(root):
        assert got[i].component_id == min((rows[j][0] for j in range(len(rows)) if root[j] == r and rows[j][0] is not None), default=None)


def test_near_links_of_dense_fingerprints(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1}
    for seed in list(fps)[:20]:
        at = seed
        for _ in range(40):
            at ^= 1 << rng.randrange(64)
            at ^= rng.choice([0, 1 << rng.randrange(64)])
            fps.add(at)
    fps = sorted(fps)
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    edges = simhash.linked_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long"))
    got = {r.node: r.root for r in components(edges).collect()}
    root = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for s, r in zip(signed, root, strict=True):
        least[r] = min(s, least.get(r, s))
    assert [got.get(s, s) for s in signed] == [least[r] for r in root]


@pytest.mark.parametrize("most", [0, 3, 64])
def test_grid_bound_and_check_reject(spark, most):
    """Pairs that meet in a cell: the tighter bound rejects some, the exact distance more, and neither a true link; dense cells give the same groups."""
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for seed in list(fps):
        for _ in range(12):
            at = seed
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                at ^= 1 << bit
            fps.add(at)
        # moved inside a segment: the same counts, other bits
        fps.add(seed ^ 0b0110 if seed & 6 in (2, 4) else seed ^ 0b1001)
    fps = sorted(fps)
    signed = {f - (1 << 64) * (f >> 63): f for f in fps}
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    pairs = {(r.a, r.b): (r.bound, r.apart) for r in simhash.cell_pairs(simhash.grid_visits(frame)).collect()}
    coarse = lambda f: [(f >> k & 15).bit_count() for k in range(0, 64, 4)]
    fine = lambda f: [(f >> k & 3).bit_count() for k in range(0, 64, 2)]
    far = lambda x, y: sum(abs(p - q) for p, q in zip(x, y, strict=True))
    want = {(a, b): (far(fine(x), fine(y)), (x ^ y).bit_count()) for a, x in signed.items() for b, y in signed.items() if a < b and far(coarse(x), coarse(y)) <= 2}
    assert pairs == want
    by_bound, by_check = sum(m > 2 for m, _ in pairs.values()), sum(m <= 2 < d for m, d in pairs.values())
    linked = {p for p, (m, d) in pairs.items() if d <= 2}
    assert by_bound > 10 and by_check > 10 and linked and all(pairs[p][0] <= 2 for p in linked)
    names = list(signed)
    root = union_find(len(names), [(names.index(a), names.index(b)) for a, b in linked])
    got = {r.node: r.root for r in components(simhash.linked_fingerprints(frame, most)).collect()}
    least = {}
    for s, r in zip(names, root, strict=True):
        least[r] = min(s, least.get(r, s))
    assert [got.get(s, s) for s in names] == [least[r] for r in root]


def test_keep_near_leaves_one_of_each_group(spark):
    docs = documents(spark, odd_rows()).coalesce(2)
    groups = {r.root for r in simhash.near_groups(docs).collect()}
    kept = simhash.keep_near(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("fan_in", "batch"), [(2, 7), (16, 10_000)])
def test_exact_groups(spark, fan_in, batch):
    """Also where a partition comes in many Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rows = odd_rows()
    got = sorted(exact.exact_groups(documents(spark, rows).repartition(5), fan_in=fan_in).collect(), key=lambda r: (r.text_sha256, r.doc_id is None, r.doc_id or 0))
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = []
    for text, members in groups.items():
        want += [(i, min(members)[2], len(members), hashlib.sha256(text.encode()).hexdigest()) for _, _, i in members]
    assert [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got] == sorted(want, key=lambda r: (r[3], r[0] is None, r[0] or 0))
    assert sum(r.kept for r in got) == len(groups)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_are_sorted_and_merge_in_rounds(spark):
    """Each round leaves a quarter of the runs, every run sorted and with a text once."""
    docs = documents(spark, [(i, f"t {i % 7}" if i % 3 else "same", "a") for i in range(400)]).repartition(9)
    rows = exact.checkpointed(exact.digests(docs))
    level = exact.sorted_runs(rows)
    for n_runs in (9, 3, 1):
        got = [(r.run, bytes(r.sha)) for r in level.collect()]
        assert len(set(got)) == len(got) and {run for run, _ in got} == set(range(n_runs))
        parts = level.select(F.spark_partition_id().alias("p"), "run", "sha").collect()
        assert all((a.run, bytes(a.sha)) < (b.run, bytes(b.sha)) for a, b in zip(parts, parts[1:], strict=False) if a.p == b.p)
        assert level.agg(F.sum("n")).first()[0] == 400
        level = exact._merged(level.withColumn("run", F.floor(F.col("run") / 3).cast("int")).repartition("run", "cut"))
    assert {(r.keep_id, r.group_size) for r in exact.tree_merge(exact.sorted_runs(rows), 9, 3).collect()} == {(r.keep_id, r.group_size) for r in exact.exact_groups(docs).collect()}


def test_keep_exact_keeps_clashing_columns(spark):
    docs = documents(spark, odd_rows()).withColumns({"uid": F.lit("x"), "kept": F.lit(1), "Best": F.lit(2)})
    kept = exact.keep_exact(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in odd_rows()})


def test_mix_meets_targets(spark):
    docs = documents(spark, odd_rows())
    labels = spark.createDataFrame([(100, 1, 0), (100, 0, 0), (101, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mix_sources(mixing.with_quality(docs, labels), rows_per_bucket=16).collect()
    again = mixing.mix_sources(mixing.with_quality(docs.repartition(7), labels), rows_per_bucket=50).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    sizes, targets, taken = {}, {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source], targets[r.source] = r.source_size, r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    total, open_ = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(open_)}
    fixed = {}
    while True:
        level = (total - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3.0 * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    assert targets == pytest.approx(fixed | {s: level * weight[s] for s in open_})
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_mix_rows_repeats_documents(spark):
    docs = documents(spark, odd_rows()).withColumns({"times": F.lit(0), "uid": F.lit("u")})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    mixed = mixing.mix_rows(docs, labels)
    assert mixed.columns == docs.columns
    plan = mixing.mix_sources(mixing.with_quality(docs, labels)).collect()
    assert mixed.count() == sum(r.epochs + (r.part > 0) for r in plan if r["size"])
    assert mixing.mix_rows(docs.limit(0), labels).count() == 0


def test_tokens_equal_the_public_library(spark):
    import tiktoken

    path, pattern = vocabulary()
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(11)
    texts = [None, "", " ", "\n\n  a", "<|endoftext|>", "naïve Ünï 漢字 \U0001f600‍", "a" * 3000, "ab" * 2000, "0123456789 don't we'll", "\x1c\x1d x\x85y z"]
    texts += ["".join(rng.choices("ab é'sß 1²³½×÷ªºµ\x0b\x1c\x85\xa0 .'ll're\n\t", k=rng.randrange(80))) for _ in range(400)]
    texts += ["".join(rng.choices("ab é'sßÿſ 1 .'ll'd\n\t\x0b,", k=rng.randrange(80))) for _ in range(400)]
    texts += ["".join(rng.choices("abcdefgh tions éñß,.'1\n　" + chr(rng.randrange(256, 2000)), k=rng.randrange(200))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    coded = docs.withColumn("ids", bpe.encode(F.col("text"), path, pattern)).withColumn("back", bpe.decode(F.col("ids"), path, pattern))
    whole = bpe.encode_corpus(docs.withColumn("ids", F.lit(0)), path, pattern, per_block=40)
    assert sorted(map(tuple, whole.select("i", "text", "ids").collect()), key=str) == sorted(map(tuple, coded.select("i", "text", "ids").collect()), key=str)
    assert bpe.encode_corpus(docs.limit(0), path, pattern).count() == 0
    both = docs.withColumn("r", bpe.round_trip(F.col("text"), path, pattern)).select(docs.columns[0], "r.ids", "r.decoded")
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, coded.select(docs.columns[0], "ids", "back").collect()), key=str)
    for r in coded.collect():
        ids = [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]
        assert ids == plain.encode_ordinary(r.text or ""), r.text
        assert bytes(r.back) == (r.text or "").encode()


def test_replay_defers_when_a_lower_rank_appears():
    """A merge may make a pair of lower rank, which then goes first within its word."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"bcb": 301, b"bc": 310, b"ab": 320, b"bcbc": 330}
    own = bpe.MergeReplay(ranks, r"\S+|\s+")
    plain = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for text in ["abcbc", "bcbcbc", *("".join(rng.choices("abc ", k=30)) for _ in range(500))]:
        assert own.encode_batch([text])[0] == b"".join(i.to_bytes(4, "little") for i in plain.encode_ordinary(text))


def toxic_rows(n=600):
    rng = random.Random(8)
    for i in range(n):
        y = int(rng.random() < 0.3)
        words = rng.choices([f"w{chr(97 + k)}{chr(97 + k // 5)}" for k in range(25)], k=rng.randrange(5, 60)) + rng.choices(["idiot", "moron"], k=2 * y)
        words += ["muslims"] * (y or rng.random() < 0.02)
        rng.shuffle(words)
        yield i, " ".join(words), y


def test_clashing_columns(spark):
    """Columns named like those that operators make are carried through or ignored."""
    docs = documents(spark, odd_rows()).withColumns({c: F.lit("x") for c in ("uid", "fp", "part", "run", "sha", "node", "root", "cell", "n")})
    assert simhash.near_groups(docs).count() == exact.exact_groups(docs).count() == len(odd_rows())
    assert simhash.keep_near(docs).columns == exact.keep_exact(docs).columns == docs.columns


def test_empty_tables(spark):
    none = documents(spark, [])
    path, pattern = vocabulary()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix_sources(mixing.with_quality(none, labels)).count() == 0
    assert simhash.near_groups(none).count() == exact.exact_groups(none).count() == none.select(bpe.encode(F.col("text"), path, pattern)).count() == 0
