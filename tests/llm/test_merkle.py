"""The Merkle manifest against a plain version, and the ranks it rests on."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fan_out):
    """Siblings of each node up to the root, as (left, right) pairs, and the root."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, at, strict=True):
            start = k // fan_out * fan_out
            path.append(("".join(nodes[start:k]), "".join(nodes[k + 1 : start + fan_out])))
        at = [k // fan_out for k in at]
        nodes = [sha("".join(nodes[k : k + fan_out])) for k in range(0, len(nodes), fan_out)]
    return paths, nodes[0]


def plain(rows, fan_out=2):
    """rows of (id, lang, leaf, offered) to (id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        subs[g] = tree([r[2] for r in groups[g]], fan_out)
    if not order:
        return []
    tops, root = tree([subs[g][1] for g in order], fan_out)
    out = []
    for g, top in zip(order, tops, strict=True):
        for r, own in zip(groups[g], subs[g][0], strict=True):
            node = r[3] or r[2]
            for left, right in own + top:
                node = sha(left + node + right)
            out.append((r[0], r[2], subs[g][1], root, sha("".join(a + b for a, b in own + top)), node, node == root))
    return out


@pytest.mark.parametrize("fan_out", [2, 16])
def test_manifest_equals_plain(spark, fan_out):
    rng = random.Random(fan_out)
    langs = ["en"] * 6 + [None, "", "-", "=", "é", "z" * 20 + "a", "z" * 20, "z" * 20 + "\x00", "a", "a\x00", "ab"]
    ids = [None, -(1 << 63), (1 << 63) - 1, 0, 0, 5, *range(-40, 700), *(rng.randrange(-(1 << 62), 1 << 62) for _ in range(60))]
    rows = []
    for k, i in enumerate(ids * 2):
        leaf = sha(f"{i}:{k % 3 and k}")
        rows.append((i, rng.choice(langs), leaf, sha(f"other {leaf}") if int(leaf, 16) % 5 == 0 else None))
    rows += [rows[3]] * 5 + [(None, None, sha("x"), None), (7, "en", "0" * 63 + "1", None), (7, "en", "0" * 63 + "2", None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string, offered string").withColumns({"leaf": F.unhex("leaf"), "offered": F.unhex("offered"), "g": F.lit(1), "rank": F.lit("x"), "uid": F.lit(2), "node": F.lit(3), "key1": F.lit(4), "n": F.lit(5)})
    out = merkle.manifest(df.repartition(5), "lang", "doc_id", fan_out=fan_out)
    got = [(r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect()]
    # which of two equal rows stands first is open: their proofs are a set
    assert Counter(got) == Counter(plain(rows, fan_out))
    for r in out.where("verified").limit(20).collect():
        assert hashlib.sha256("".join(r.proof).encode()).hexdigest() == r.proof_sha256


def test_small_tables(spark):
    schema = "doc_id long, lang string, leaf binary, offered binary"
    assert merkle.manifest(spark.createDataFrame([], schema), "lang", "doc_id").count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, None, bytes(32), None)], schema), "lang", "doc_id").collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root == "00" * 32 and one.verified and one.proof == [] and one.proof_sha256 == sha("")
    two = merkle.manifest(spark.createDataFrame([(1, "a", bytes(32), None), (1, "b", bytes(32), bytes(31) + b"x")], schema), "lang", "doc_id").collect()
    assert {r.verified for r in two} == {True, False} and {r.root for r in two} == {sha("00" * 64)}
    # groups of 256 and 257 leaves stand on either side of a prefix's size
    rows = [(k, g, bytes.fromhex(sha(f"{g}{k}")), None) for g, n in (("x", 256), ("y", 257), ("z", 513)) for k in range(n)]
    got = {(r.group, r.subroot) for r in merkle.manifest(spark.createDataFrame(rows, schema), "lang", "doc_id").collect()}
    assert got == {(g, tree([r[2].hex() for r in rows if r[1] == g], 2)[1]) for g in "xyz"}


def test_counts_by_key(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice([0, 1, 255, 256, -1, -(1 << 63), (1 << 63) - 1, rng.randrange(1 << 40)])) for _ in range(400)]
    got = {(r.g, r.k): (r.n, r.before) for r in merkle.key_counts(spark.createDataFrame(rows, "g string, k long"), ["g"], "k").collect()}
    want = Counter(rows)
    assert got == {(g, k): (n, sum(m for (h, j), m in want.items() if h == g and j < k)) for (g, k), n in want.items()}


def test_query_equals_plain(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, rng.choice(["text", "é" * 50, "", None, "a\x00b"]), rng.choice(["en", "de", None, ""]), rng.choice(["s", None]), rng.choice([None, 0, 9, 99])) for i in itertools.chain(range(150), [3, 3, None])]
    rows.append(rows[5])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    flat = []
    for i, text, lang, source, n in rows:
        changed = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        flat.append((i, lang, told(i, source, lang, n, text), told(i, source, lang, None if n is None else n + 1, text) if changed else None))
    assert Counter(map(tuple, queries.op13_manifest(spark, str(tmp_path)).collect())) == Counter(plain(flat))
