"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, stored, word_count

#: A key is made of this many hexadecimal digits of an MD5.
_DIGITS = 13


def exponential_key(id_col: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from an MD5 of id and seed: the same in every run."""
    digest = F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to ``sizes(source, source_size)``.

    Sources in code-point order, null last, weigh ``cycle`` in turn and share the sum of
    all sizes. A target stops at ``max_epochs`` times its source's size and the excess is
    shared again by weight, which makes it ``min(cap, level * weight)``: sources are
    passed in the order of cap / weight, and the level is that at the first one that
    need not be capped. One row for each source, so one task suffices.
    """
    everything = Window.partitionBy()
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") - 1) % len(cycle) + 1).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size").cast("double") * max_epochs).withColumn("bound", F.col("cap") / F.col("weight"))
    passed = everything.orderBy("bound", "rank").rowsBetween(Window.unboundedPreceding, -1)
    spent = lambda c: F.coalesce(F.sum(c).over(passed), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - spent("cap")) / (F.sum("weight").over(everything) - spent("weight"))
    fits = weighed.withColumn("level", level).withColumn("at", F.when(F.col("level") <= F.col("bound"), F.struct("bound", "rank")))
    return fits.withColumn("level", F.min_by("level", "at").over(everything)).select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def running_sums(sums: DataFrame, per_stretch: int) -> DataFrame:
    """Adds ``before`` to ``sums(source, bucket, sum)``: what the source's earlier buckets hold, over stretches of ``per_stretch`` buckets first."""
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda name, *keys: F.coalesce(F.sum(name).over(upto(*keys)), F.lit(0))
    sums = sums.withColumn("stretch", F.floor(F.col("bucket") / per_stretch))
    whole = sums.groupBy("source", "stretch").agg(F.sum("sum").alias("all")).select(F.col("source").alias("_s"), F.col("stretch").alias("_t"), earlier("all", "source", "stretch").alias("_before"))
    inside = sums.withColumn("_inside", earlier("sum", "source", "stretch", "bucket"))
    both = inside.join(whole, F.col("source").eqNullSafe(F.col("_s")) & (F.col("stretch") == F.col("_t")))
    return both.select("source", "bucket", (F.col("_before") + F.col("_inside")).alias("before"))


def mix_sources(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7, rows_per_bucket: int = 1024) -> DataFrame:
    """How many words of each document a mix takes.

    ``docs`` has uid, doc_id, source, size and quality; the result adds source_size,
    target, epochs (whole passes), part (words of the last, fractional pass) and
    taken = epochs * size + part. Within a source documents are ordered by their key and
    their sizes summed; the fractional pass takes them until its budget is used, so at
    most one document of a source is cut. Sums run in three levels, over stretches of
    buckets, over buckets of keys and inside a bucket, so that a source with a third of all rows is dealt out.

    Null quality weighs 1, weights are held above one millionth. Null ids and sources
    are ordinary values (null sources form one source, the last); ties of a key go by
    id and size, repeated rows count each; empty texts take nothing; an empty table
    gives no rows.
    """
    weight = F.greatest(F.coalesce(F.col("quality").cast("double"), F.lit(1.0)), F.lit(1e-6))
    rows = checkpointed(docs.select("uid", "doc_id", "source", "size", exponential_key(F.col("doc_id"), weight, seed).alias("key")))
    buckets = max(1, rows.count() // rows_per_bucket)
    rows = rows.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    sizes = source_targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), cycle, max_epochs)
    plan = running_sums(sums, rows_per_bucket).join(sizes.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.greatest(F.round("target").cast("long") - F.col("epochs") * F.col("source_size"), F.lit(0)))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    mixed = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    part = F.greatest(F.least(F.col("size"), F.col("budget") - F.col("before") - F.col("earlier")), F.lit(0)).cast("long")
    return mixed.withColumn("part", F.when(F.col("epochs") < max_epochs, part).otherwise(F.lit(0).cast("long"))).select("uid", "doc_id", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def with_quality(docs: DataFrame, labels: DataFrame, good: float = 2.0, bad: float = 0.5, uid: Column | None = None) -> DataFrame:
    """uid, doc_id, source, size and the quality weight by label; 1 where there is none, the mean of repeated labels."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.avg(F.when(F.col("quality") == 1, good).when(F.col("quality") == 0, bad).otherwise(1.0)).alias("quality"))
    rows = docs.select((F.monotonically_increasing_id() if uid is None else uid).alias("uid"), "doc_id", "source", word_count("text").alias("size"))
    return rows.join(marks, rows.doc_id == marks.id, "left").drop("id")


def mix_rows(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, whole texts, all columns.

    The document in which a fractional budget ends is taken whole, so a source exceeds
    its target by less than one document.
    """
    uid, times = fresh(docs, "uid"), fresh(docs, "times")
    rows = stored(docs, uid)
    taken = mix_sources(with_quality(rows, labels, uid=F.col(uid)), **options).withColumn("times", F.col("epochs") + (F.col("part") > 0).cast("long"))
    taken = taken.where("size > 0 and times > 0").select(F.col("uid").alias(uid), F.col("times").alias(times))
    mixed = rows.join(taken, uid)
    return mixed.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(times)).drop(times)
