"""Exact deduplication by a tree of merges over sorted digest runs.

Every input partition makes a run: its rows are digested, sorted by digest and fused into
one entry for each text. Runs then meet in the rounds of a binomial tree: in each round
``fan_in`` neighbouring runs are brought together, cut into ranges of digests so that no
task holds a whole run, merged in order of the digest, and neighbouring entries with the same digest fuse into
the best one, which keeps the row seen first in the order of the rule. After round r a run stands for
``fan_in ** r`` input partitions; the last one has every text once. Entries fuse only if digest, a
second digest by another function and the length in bytes agree (the verification), at every level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import SPACE, checkpointed, fresh, spread_join, stored, values

_DROP = SPACE.encode()
_KEY = ("sha", "chk", "n_bytes")


def _digest(text: pa.Array) -> pa.Array:
    sha, chk, size = [], [], []
    for raw in values(text):
        raw = (raw or b"").translate(None, _DROP)
        sha.append(hashlib.sha256(raw).digest())
        chk.append(hashlib.blake2b(raw, digest_size=16).digest())
        size.append(len(raw))
    return pa.StructArray.from_arrays([pa.array(sha, pa.binary()), pa.array(chk, pa.binary()), pa.array(size, pa.int64())], ["sha", "chk", "n_bytes"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid: Column | None = None) -> DataFrame:
    """Rows (uid, doc_id, chars, run, sha, chk, n_bytes) of every row of ``docs``."""
    udf = arrow_udf(_digest, "struct<sha:binary,chk:binary,n_bytes:bigint>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select((F.monotonically_increasing_id() if uid is None else uid).alias("uid"), F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("chars"), F.spark_partition_id().alias("run"), text.cast("binary").alias("raw"))
    return rows.select("uid", "doc_id", "chars", "run", udf("raw").alias("d")).select("uid", "doc_id", "chars", "run", "d.*")


_ENTRY = "run int, cut int, sha binary, chk binary, n_bytes bigint, chars bigint, doc_id {0}, uid {1}, n bigint"


def _fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order, those with equal keys fused into the first of them; holds one batch and one entry at a time."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        if not rows.num_rows:
            continue
        other = np.zeros(rows.num_rows - 1, bool)
        for name in ("run", *_KEY):
            column = rows[name]
            other |= ~pc.equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy().astype(bool)
        first = np.concatenate([[0], np.flatnonzero(other) + 1])
        sums = np.add.reduceat(rows["n"].to_numpy(), first)
        at = rows.schema.get_field_index("n")
        fused = rows.take(pa.array(first)).set_column(at, rows.schema.field(at), pa.array(sums, pa.int64()))
        held = fused.slice(fused.num_rows - 1)
        yield from fused.slice(0, fused.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _merged(entries: DataFrame) -> DataFrame:
    """The entries of each partition sorted by run and digest and fused; the best entry of a text comes first."""
    order = [F.col("chars").desc(), F.col("doc_id").asc_nulls_last(), F.col("uid")]
    kinds = dict(entries.dtypes)
    return entries.sortWithinPartitions("run", *_KEY, *order).mapInArrow(_fuse, _ENTRY.format(kinds["doc_id"], kinds["uid"]))


def sorted_runs(rows: DataFrame) -> DataFrame:
    """The run of each partition of :func:`digests`; ``cut`` is the first two bytes of a digest."""
    cut = F.conv(F.hex(F.substring("sha", 1, 2)), 16, 10).cast("int")
    return _merged(rows.select(F.col("run").cast("int").alias("run"), cut.alias("cut"), *_KEY, "chars", "doc_id", "uid", F.lit(1).cast("long").alias("n")))


def tree_merge(runs: DataFrame, n_runs: int, fan_in: int = 4) -> DataFrame:
    """Groups of equal texts from :func:`sorted_runs`: sha, chk, n_bytes, keep_id, keep_uid, group_size.

    Rounds go on until one run is left, ceil(log(n_runs) / log(fan_in)) of them. A text has at
    most one entry in a run, so a merge meets at most ``fan_in`` entries of it however
    many copies there are. An empty table has no groups; rows that tie in length and id (repeated
    rows) are told apart by uid.
    """
    level, left = runs, max(n_runs, 2)
    while left > 1:
        left = -(-left // fan_in)
        # as many ranges of digests as there are tasks to take them
        level = _merged(level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition("run", "cut"))
    return level.select(*_KEY, F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4, uid: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: uid, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting spaces, tabs and line breaks
    (``[\\x20\\x09-\\x0D]``). Of equal texts the row with most code points stays, then the
    smallest id (a null id comes last); of rows that tie in both (repeated rows) exactly
    one stays. Null counts as the empty text, empty texts are equal to each other, an
    empty table gives no rows. Other columns are ignored, so their names cannot clash.
    ``uid`` is a column that numbers the rows; without it they are numbered here.
    """
    rows = checkpointed(digests(docs, id_col, text_col, uid))
    n_runs = (rows.agg(F.max("run").alias("n")).first().n or 0) + 1
    groups = tree_merge(sorted_runs(rows), n_runs, fan_in)
    return spread_join(rows, groups, list(_KEY), "run").select("uid", "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    uid = fresh(docs, "uid")
    rows = stored(docs, uid)
    kept = exact_groups(rows, id_col, text_col, uid=F.col(uid)).where("kept").select(F.col("uid").alias(uid))
    return rows.join(kept, uid, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
