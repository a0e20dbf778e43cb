"""Near-duplicate detection by SimHash with a join in the space of segment bit counts.

A fingerprint of 64 bits is cut into segments and the bits set in each segment are
counted. The Manhattan distance of two count vectors is never above the Hamming distance of
the fingerprints. With 16 segments of 4 bits the vectors span a grid: fingerprints at
distance 2 or less meet in a cell that is at most one step from either vector, so each visits its own
cell and the neighbours one step away, and a range join pairs those that meet. Such a pair must then
pass the tighter bound of 32 segments of 2 bits, and last its exact distance.

In a cell with very many visitors (thousands of near copies) pairs are not made: a pair is linked
there if one flipped bit, or none, takes both to the same 64-bit point of that cell, which
is so exactly if they differ in at most two bits. At most 65 fingerprints share a point; each is tied to the least of
them, so links stay linear in the rows.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import checkpointed, components, fresh, spread_join, stored, values

SEED = 42
#: Hashes are added up when so many have gathered.
_FLUSH = 300_000
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(raw: bytes, width: int = 3) -> np.ndarray:
    """XXH64 of every run of ``width`` words, lower-cased and joined by spaces; of all words if they are fewer."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    sizes = [len(w) + 1 for w in words]
    begin = list(accumulate(sizes[: len(words) - width], initial=0))
    end = list(accumulate(sizes[width:], initial=sum(sizes[:width]) - 1))
    return np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, begin, end)), repeat(SEED)), np.uint64, len(begin))


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the word of those bits that are set in more than half of them; 0 if it is empty."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat, n = np.concatenate([hashes[i] for i in full]), sizes[full]
    # byte-wide counters hold 255, so rows are added in chunks of at most that many
    chunks = -(-n // 255)
    first = np.cumsum(n) - n
    starts = np.repeat(first, chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    by_text = np.cumsum(chunks) - chunks
    for k in range(8):
        lane = np.add.reduceat((flat >> np.uint64(k)) & _LANES, starts)
        counts = np.add.reduceat(lane.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), by_text, axis=0)
        for j in range(8):
            out[full] |= (2 * counts[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def simhash_all(texts: list[bytes | None], width: int = 3) -> np.ndarray:
    done, wait, held = [], [], 0
    for raw in texts:
        wait.append(shingle_hashes(raw or b"", width))
        held += len(wait[-1])
        if held >= _FLUSH:
            done.append(majority_bits(wait))
            wait, held = [], 0
    return np.concatenate([*done, majority_bits(wait)]) if wait or done else np.zeros(0, np.uint64)


def fingerprint(text: Column, width: int = 3) -> Column:
    """The fingerprint of a text as a signed long; 0 for texts without a word and null."""

    def udf(raw: pa.Array) -> pa.Array:
        return pa.array(simhash_all(values(raw), width).view(np.int64), pa.int64())

    return arrow_udf(udf, "bigint")(F.coalesce(text, F.lit("")).cast("binary"))


def segment_counts(fp: Column) -> Column:
    """The bits set in each of 16 segments of 4 bits, each count in its segment's own 4 bits."""
    odd, pair = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    # half adder: the sum of two one-bit fields without a carry into the sign
    two = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    return two.bitwiseAND(pair) + F.shiftrightunsigned(two, 2).bitwiseAND(pair)


def sorted_pairs(fp: Column) -> Column:
    """The bits set in each of 32 segments of 2 bits, each count n written as n ones, so that counts differ by as many bits as their distance."""
    odd, beside = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(beside).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(beside).bitwiseAND(odd), 1))


def bits_apart(left: str, right: str) -> Column:
    return F.bit_count(F.col(left).bitwiseXOR(F.col(right)))


def grid_visits(fps: DataFrame) -> DataFrame:
    """(fp, v, cell, n): the cells of the count grid that each of ``fps(fp)`` visits, those with two visitors or more, and their number."""
    counts = F.col("v")
    step = lambda i: F.lit(1 << (4 * i))
    field = lambda i: F.shiftrightunsigned(counts, 4 * i).bitwiseAND(F.lit(7))
    around = [counts, *(F.when(field(i) < 4, counts + step(i)) for i in range(16)), *(F.when(field(i) > 0, counts - step(i)) for i in range(16))]
    visits = fps.select("fp", segment_counts(F.col("fp")).alias("v")).select("fp", "v", F.explode(F.array(*around)).alias("cell")).where("cell is not null")
    busy = visits.groupBy(F.col("cell").alias("c")).agg(F.count("*").alias("n")).where("n > 1")
    return visits.join(busy, visits.cell == busy.c).drop("c")


def cell_pairs(visits: DataFrame) -> DataFrame:
    """(a, b, bound, apart): pairs a < b that meet in a cell, their Manhattan distance over 32 segments and their Hamming distance. A pair may meet in several cells."""
    own = visits.select("cell", "fp", sorted_pairs(F.col("fp")).alias("u"))
    left, right = (own.select("cell", F.col("fp").alias(c), F.col("u").alias(f"u{c}")) for c in "ab")
    return left.join(right, "cell").where("a < b").select("a", "b", bits_apart("ua", "ub").alias("bound"), bits_apart("a", "b").alias("apart"))


def point_ties(visits: DataFrame) -> DataFrame:
    """(a, b): each fingerprint of ``visits`` tied to the least of those that share a point one flipped bit away, within a cell."""
    met = visits.withColumn("d", F.col("cell") - F.col("v"))
    size = F.abs("d")

    def flip(j: int) -> Column:
        bit = F.shiftleft(size, j)
        is_set = F.col("fp").bitwiseAND(bit) != 0
        return F.when((F.col("d") != 0) & (is_set == (F.col("d") < 0)), F.col("fp").bitwiseXOR(bit))

    points = met.select("fp", F.explode(F.array(F.when(F.col("d") == 0, F.col("fp")), *map(flip, range(4)))).alias("point")).where("point is not null")
    least = F.min("fp").over(Window.partitionBy("point"))
    return points.select(F.col("fp").alias("a"), least.alias("b")).where("a <> b")


def linked_fingerprints(fps: DataFrame, most: int = 64, distance: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fps(fp)`` that make the same groups as all pairs at ``distance`` 2 (or less) apart.

    Cells with up to ``most`` visitors are joined; the others are split into points. No cell is
    capped: either way finds every link of its visitors.
    """
    visits = checkpointed(grid_visits(fps))
    near = cell_pairs(visits.where(F.col("n") <= most)).where((F.col("bound") <= distance) & (F.col("apart") <= distance)).select("a", "b")
    dense = point_ties(visits.where(F.col("n") > most)).where(bits_apart("a", "b") <= distance)
    return near.unionByName(dense).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, uid: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: uid, doc_id, fp and component_id, the smallest id reachable over links.

    Texts without words, null included, have fingerprint 0 and are linked like any
    other. Null ids are never the smallest; a group of null ids alone has component null.
    Repeated rows and equal texts share a fingerprint and so a component. Whole texts of
    any length are read. An empty table gives no rows; other columns are ignored.
    ``uid`` is a column that numbers the rows; without it they are numbered here.
    """
    rows = checkpointed(docs.select((F.monotonically_increasing_id() if uid is None else uid).alias("uid"), F.col(id_col).alias("doc_id"), F.spark_partition_id().alias("part"), fingerprint(F.col(text_col), width).alias("fp")))
    fps = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("low_id")))
    roots = components(linked_fingerprints(fps.select("fp")))
    at = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = at.groupBy(F.col("root").alias("r")).agg(F.min("low_id").alias("component_id"))
    return spread_join(rows, at.join(least, at.root == least.r).select("fp", "component_id", "root"), ["fp"], "part").select("uid", "doc_id", "fp", "component_id", "root")


def keep_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row of each group of near copies, that with the smallest id (nulls last, then the first row), with all columns."""
    uid = fresh(docs, "uid")
    rows = stored(docs, uid)
    first = near_groups(rows, id_col, text_col, width, F.col(uid)).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid")).alias("best"))
    kept = first.select(F.col("best.uid").alias(uid))
    return rows.join(kept, uid, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
