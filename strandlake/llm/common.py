"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import uuid
import zlib
from collections.abc import Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as text and as a pattern of words.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of texts that a Python worker is sent at a time.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Bounds the Arrow batches of the session to ``rows`` rows, since a text may be long; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; from here on texts reach Python in short batches."""
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local master (tests, a laptop) uses a folder inside the warehouse; on a cluster it is an error.
    """
    context = spark.sparkContext
    if not (path := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def remove(spark: SparkSession, place: str) -> None:
    """Deletes a folder in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


@contextlib.contextmanager
def work_folder(spark: SparkSession, place: str) -> Iterator[None]:
    """While it is open, :func:`stored` writes below ``place``; at its end that folder is deleted, so what reads it must have been written elsewhere by then.

    Threads and nested uses have folders of their own, and nothing outside ``place`` is deleted.
    """
    before = _FOLDER.set(place)
    try:
        yield
    finally:
        _FOLDER.reset(before)
        remove(spark, place)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; its lineage ends there, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, uid: str) -> DataFrame:
    """``df`` with an own number for each row, written once to the shared folder and read from there.

    Row numbers depend on how a scan is split, and two scans may be split differently. A
    decision made on numbers of the written table holds for every later scan of it. The table stays, as long as results may read it:
    callers that write their results open a :func:`work_folder` around both.
    """
    place = f"{_FOLDER.get() or shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.withColumn(uid, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.parquet(place)


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], part: str) -> DataFrame:
    """``rows.join(side, keys)`` for a ``side`` with one row a key, where one key may hold a third of ``rows``.

    ``part`` names the stretch of the input that a row came from, of bounded size. The side's row
    is first given to each stretch that has its key, so a hot key is dealt out by
    stretches and no task has all of it.
    """
    places = rows.select(*keys, part).distinct().join(side, keys)
    return rows.join(places, [*keys, part])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def values(column: pa.Array, rows: int = 200) -> Iterator:
    """The values of an Arrow column, of which only some rows at a time are Python objects."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of(doc_id: str | Column) -> Column:
    """Unsigned crc32 of the id as text, null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary"))


def crc_fold(doc_id: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.coalesce(crc_of(doc_id), F.lit(0)) % folds  # the crc of the empty text is 0


def crc_fold_py(doc_id: object, folds: int = 5) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), root being the component's least node.

    Alternating large-star and small-star rounds, each one join on the node after a
    grouped minimum, until the set of edges no longer changes. Every round is
    checkpointed. Null ends and loops are ignored; nodes without an edge have no row.
    """
    live = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(low, both.a == low.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        hung = large.join(low, large.a == low.n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        live = checkpointed(hung.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        now = live.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return root.unionByName(live.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
