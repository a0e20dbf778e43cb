"""A Merkle manifest of a table: a hash for each row, each group and the whole, and a proof for each row.

Rows are placed in their group without a sort of the table: ids are counted by histograms of ever fewer
digits, each made from the one below; the sums of what stands before come down again the same way, a window
seeing no more than the values of one digit. Ties go on to a further key.

A row's place, written in digits of base ``fan_out``, is the key of its leaf in a trie; the
nodes that share all but the last digit become their parent. Several digits are taken at a time: the rows of one
prefix (at most 256) are one group of one shuffle, so a tree over 10 billion rows is five shuffles up and five down.
No group grows with the table.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

DIGIT = 8
#: Rows of one prefix at most.
PREFIX_ROWS = 256


def field_text(value: str | Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, ``:`` and the value; integers are decimal."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(*values: str | Column) -> Column:
    """SHA-256 of a row's fields as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field_text, values)), 256))


def key_counts(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """Rows (*group, key, n, before): for each value of the long ``key`` how many rows of the group have it, and how many a smaller one."""
    first = rows.agg(F.min(key), F.max(key)).first()
    low, high = (0, 0) if first[0] is None else first
    levels = [rows.groupBy(*group, F.col(key).alias("d0")).agg(F.count("*").alias("n0"))]
    while (high >> DIGIT * (len(levels) - 1)) - (low >> DIGIT * (len(levels) - 1)) >= 1 << DIGIT:
        k = len(levels)
        levels.append(levels[-1].groupBy(*group, F.shiftright(f"d{k - 1}", DIGIT).alias(f"d{k}")).agg(F.sum(f"n{k - 1}").alias(f"n{k}")))
    above = None
    for k in reversed(range(len(levels))):
        up = [] if above is None else [f"d{k + 1}"]
        here = levels[k] if above is None else levels[k].withColumn(up[0], F.shiftright(f"d{k}", DIGIT))
        before = Window.partitionBy(*group, *up).orderBy(f"d{k}").rowsBetween(Window.unboundedPreceding, -1)
        here = here.withColumn("before", F.coalesce(F.sum(f"n{k}").over(before), F.lit(0)))
        if above is not None:
            here = here.join(above, [*group, *up]).withColumn("before", F.col("before") + F.col("offset"))
        above = here.select(*group, f"d{k}", f"n{k}", "before") if k == 0 else here.select(*group, f"d{k}", F.col("before").alias("offset"))
    return above.withColumnsRenamed({"d0": key, "n0": "n"})


def exact_ranks(rows: DataFrame, group: list[str], keys: Iterator[Column]) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 on in their group in the order of ``keys``.

    The columns of ``group`` must not be null, nor the keys, which are longs; the last one must tell all rows apart. Later keys are asked for
    and counted only over rows that tie in the earlier ones.
    """
    key = f"key{len(group)}"
    rows = rows.withColumn(key, next(keys))
    counts = checkpointed(key_counts(rows, group, key))
    placed = rows.join(counts, [*group, key])
    alone = placed.where("n = 1").withColumn("rank", F.col("before")).drop(key, "n", "before")
    if counts.where("n > 1").isEmpty():
        return alone
    tied = exact_ranks(placed.where("n > 1").withColumnRenamed("before", f"{key}_before").drop("n"), [*group, key], keys)
    return alone.unionByName(tied.withColumn("rank", F.col("rank") + F.col(f"{key}_before")).drop(key, f"{key}_before"))


def _levels(nodes: list[str], first: bool, fan_out: int, digits: int) -> list[list[str]]:
    """The nodes of one prefix, level by level up to their one ancestor. Only the first prefix of a group can be its only one, and then stops at one node."""
    out = [nodes]
    while len(out[-1]) > 1 if first else len(out) <= digits:
        below = out[-1]
        out.append([hashlib.sha256("".join(below[k : k + fan_out]).encode()).hexdigest() for k in range(0, len(below), fan_out)])
    return out


def _siblings(levels: list[list[str]], at: int, fan_out: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node and of its ancestors in their runs, level by level."""
    lefts, rights = [], []
    for nodes in levels[:-1]:
        start = at // fan_out * fan_out
        lefts.append("".join(nodes[start:at]))
        rights.append("".join(nodes[at + 1 : start + fan_out]))
        at //= fan_out
    return lefts, rights


def _fold(node: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights, strict=True):
        node = hashlib.sha256(f"{left}{node}{right}".encode()).hexdigest()
    return node


def _nodes(table: pa.Table) -> tuple[list[str], bool, pa.Table]:
    table = table.sort_by("rank")
    return [x.hex() for x in table["node"].to_pylist()], table["prefix"][0].as_py() == 0, table


def _digits(fan_out: int) -> int:
    digits = 1
    while fan_out ** (digits + 1) <= PREFIX_ROWS:
        digits += 1
    return digits


def _climb(nodes: DataFrame, fan_out: int) -> list[DataFrame]:
    """``nodes(g, rank, node)`` and the nodes above them, tier by tier, up to one node a group; each is checkpointed."""
    digits = _digits(fan_out)
    per = fan_out**digits

    def up(table: pa.Table) -> pa.Table:
        own, first, table = _nodes(table)
        top = _levels(own, first, fan_out, digits)[-1][0]
        return pa.table({"g": table["g"].slice(0, 1), "rank": table["prefix"].slice(0, 1), "node": pa.array([bytes.fromhex(top)], pa.binary())})

    tiers = [nodes]
    while (tiers[-1].agg(F.max("rank")).first()[0] or 0) > 0:
        keyed = tiers[-1].select("g", "rank", "node", F.expr(f"rank div {per}").alias("prefix"))
        tiers.append(checkpointed(keyed.groupBy("g", "prefix").applyInArrow(up, "g string, rank bigint, node binary")))
    return tiers


_PATH = "lefts array<string>, rights array<string>, subroot string, root string"


def _descend(tiers: list[DataFrame], paths: DataFrame, fan_out: int, leaf: Callable, schema: str, carried: list[str]) -> DataFrame:
    """Hands ``paths(g, rank, lefts, rights, subroot, root)`` of the last tier down to the first, where ``leaf`` makes the rows of ``schema``."""
    digits = _digits(fan_out)
    per = fan_out**digits

    def down(last: bool, table: pa.Table, above: pa.Table) -> pa.Table:
        own, first, table = _nodes(table)
        # a prefix has one row above it
        up = above.select(["lefts", "rights", "subroot", "root"]).to_pylist()[0]
        levels = _levels(own, first, fan_out, digits)
        paths = (_siblings(levels, at, fan_out) for at in range(len(own)))
        if last:
            return leaf(table, own, paths, up)
        left, right = zip(*paths, strict=True)
        rows = {k: pa.array([up[k]] * len(own), pa.string()) for k in ("subroot", "root")}
        rows |= {"lefts": pa.array([x + up["lefts"] for x in left], pa.list_(pa.string())), "rights": pa.array([x + up["rights"] for x in right], pa.list_(pa.string()))}
        return pa.table({"g": table["g"], "rank": table["rank"]} | {k: rows[k] for k in ("lefts", "rights", "subroot", "root")})

    if len(tiers) == 1:
        # no group has more than one node: each is its own root
        tiers = [tiers[0], tiers[0].select("g", "rank", "node")]
    for k in reversed(range(len(tiers) - 1)):
        columns = ["g", "rank", "node", *(carried if k == 0 else [])]
        keyed = tiers[k].select(*columns, F.expr(f"rank div {per}").alias("prefix"))
        above = paths.select(F.col("g").alias("ag"), F.col("rank").alias("aprefix"), "lefts", "rights", "subroot", "root")
        both = keyed.groupBy("g", "prefix").cogroup(above.groupBy("ag", "aprefix"))
        kind = schema if k == 0 else f"g string, rank bigint, {_PATH}"
        paths = both.applyInArrow(functools.partial(down, k == 0), kind)
    return paths


def _byte_keys(text: str) -> Iterator[Column]:
    """Longs that order a text bytewise: six bytes and their number at a time; null first."""
    digits = F.hex(F.col(text).cast("binary"))
    at = 0
    while True:
        part = F.substring(digits, 12 * at + 1, 12)
        yield F.coalesce(F.conv(F.rpad(part, 12, "0"), 16, 10).cast("long") * 8 + F.shiftright(F.length(part), 1), F.lit(-1)).cast("long")
        at += 1


def manifest(rows: DataFrame, group_col: str, id_col: str, leaf_col: str = "leaf", offered_col: str = "offered", fan_out: int = 2) -> DataFrame:
    """Rows (id, group, rank, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of the Merkle tree over ``rows``.

    ``leaf_col`` is the hash of a row (32 bytes), ``offered_col`` one to verify in its place, null for the leaf itself. A group's
    leaves ascend by the long id, null first, then by leaf; rows that agree in both are interchangeable. While a group has
    several nodes, every ``fan_out`` consecutive ones (the last run may be shorter) become the hash of their concatenated
    hexadecimal digests; what remains is the group's root. Group roots, in the order of the group's UTF-8 bytes, null first, likewise become the root. ``proof`` has the
    siblings of each level from the leaf to the root, in order; ``folded_root`` is the root that they and the offered leaf give.
    An empty table gives no rows. Only the named columns are read, so others may be called anything.
    """
    named = {"id": id_col, "lang": group_col, "node": leaf_col, "offered": offered_col}
    flat = rows.select(*(F.col(f"`{c}`").alias(n) for n, c in named.items()))
    flat = checkpointed(flat.withColumns({"g": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "uid": F.monotonically_increasing_id()}))
    by_leaf = F.conv(F.substring(F.hex("node"), 1, 15), 16, 10).cast("long") + F.col("id").isNotNull().cast("long") * F.lit(1 << 60)
    further = (F.conv(F.substring(F.hex("node"), 15 * k + 1, 15), 16, 10).cast("long") for k in range(1, 5))
    keys = iter([F.coalesce("id", F.lit(-(1 << 63))), by_leaf, *further, F.col("uid")])
    leaves = checkpointed(exact_ranks(flat, ["g"], keys))
    tiers = _climb(leaves, fan_out)
    # the groups are the leaves of one more tree
    tops = tiers[-1].select(F.lit("").alias("g"), F.when(F.col("g") != "", F.substr("g", F.lit(2))).alias("lang"), F.col("g").alias("group"), "node")
    tops = checkpointed(exact_ranks(tops, ["g"], _byte_keys("lang")))
    over = _climb(tops.select("g", "rank", "node", "group"), fan_out)
    digest = F.lower(F.hex("node"))
    none = F.array().cast("array<string>")
    root = over[-1].select("g", "rank", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), digest.alias("root"))

    def of_group(table: pa.Table, own: list[str], paths: Iterator, up: dict) -> pa.Table:
        left, right = zip(*((x + up["lefts"], y + up["rights"]) for x, y in paths), strict=True)
        kind = pa.list_(pa.string())
        return pa.table({"g": table["group"], "rank": pa.array([0] * len(own), pa.int64()), "lefts": pa.array(left, kind), "rights": pa.array(right, kind), "subroot": pa.array(own), "root": pa.array([up["root"]] * len(own))})

    groups = checkpointed(_descend(over, root, fan_out, of_group, f"g string, rank bigint, {_PATH}", ["group"]))

    def of_row(table: pa.Table, own: list[str], paths: Iterator, up: dict) -> pa.Table:
        above = [x + y for x, y in zip(up["lefts"], up["rights"], strict=True)]
        proofs, digests, folded, offered = [], [], [], table["offered"].to_pylist()
        for node, other, (left, right) in zip(own, offered, paths, strict=True):
            proofs.append([x + y for x, y in zip(left, right, strict=True)] + above)
            digests.append(hashlib.sha256("".join(proofs[-1]).encode()).hexdigest())
            folded.append(_fold(node if other is None else other.hex(), left + up["lefts"], right + up["rights"]))
        same = lambda k: pa.array([up[k]] * len(own), pa.string())
        out = {"id": table["id"], "group": table["lang"], "rank": table["rank"], "leaf": pa.array(own), "subroot": same("subroot"), "root": same("root")}
        out |= {"proof": pa.array(proofs, pa.list_(pa.string())), "proof_sha256": pa.array(digests), "folded_root": pa.array(folded), "verified": pa.array([f == up["root"] for f in folded])}
        return pa.table(out)

    schema = "id bigint, group string, rank bigint, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean"
    return _descend(tiers, groups, fan_out, of_row, schema, ["id", "lang", "offered"])
