"""Aggregations over alleles, carriers, doses and expectations.

Each is one grouped sum with partial aggregation on the map side; what follows a group
is arithmetic on its few alleles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed


def observed_alleles(gt: DataFrame) -> DataFrame:
    """(m, smp, a) of every allele that is not missing."""
    return gt.select("m", "smp", F.explode(F.array("a1", "a2")).alias("a")).where("a >= 0")


def allele_counts(gt: DataFrame) -> DataFrame:
    return observed_alleles(gt).groupBy("m", "a").agg(F.count("*").alias("n"))


def allele_frequencies(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("m"))
    return counts.select("m", "a", "n", (F.col("n") / total).alias("freq"))


def major_alleles(counts: DataFrame) -> DataFrame:
    """The most frequent allele; the lowest of equal ones."""
    return counts.groupBy("m").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("major"))


def minor_frequency(counts: DataFrame) -> DataFrame:
    """Second-largest count over all counts; 0 with one allele."""
    ordered = F.sort_array(F.collect_list("n"), asc=False)
    return counts.groupBy("m").agg((F.coalesce(F.get(ordered, F.lit(1)), F.lit(0)) / F.sum("n")).alias("maf"))


def missing_rates(gt: DataFrame) -> DataFrame:
    gone = F.when((F.col("a1") < 0) | (F.col("a2") < 0), 1).otherwise(0)
    return gt.groupBy("m").agg(F.count("*").alias("n_samples"), F.sum(gone).alias("n_missing"), (F.sum(gone) / F.count("*")).alias("missing_rate"))


def ibs2_markers(gt: DataFrame, min_maf: float = 0.1, max_missing: float = 0.1) -> DataFrame:
    """Markers with enough minor alleles and few missing haplotypes."""
    maf = minor_frequency(allele_counts(gt))
    gone = gt.groupBy("m").agg(F.sum((F.col("a1") < 0).cast("int") + (F.col("a2") < 0).cast("int")).alias("gone"), (2 * F.count("*")).alias("n_haps"))
    return maf.join(gone, "m").where((F.col("maf") >= min_maf) & (F.col("gone") <= F.ceil(max_missing * F.col("n_haps")))).select("m", "maf")


def carrier_lists(gt: DataFrame, n_samples: int, rare: float = 0.002) -> DataFrame:
    """Per marker and allele the class (list or high) and, for few carriers, their sorted list.

    ``gt(m, smp, a1, a2)`` has one row for each marker and sample. Carriers are counted first; only those of alleles with few carriers
    are gathered, so no list outgrows ``max(3, n_samples * rare)`` however frequent an allele is.
    """
    most = max(3, int(n_samples * rare))
    rows = gt.select("m", "smp", F.explode(F.array_distinct(F.array("a1", "a2"))).alias("a")).where("a >= 0")
    sized = rows.groupBy("m", "a").agg(F.count("*").alias("carriers"))
    few = sized.where(F.col("carriers") <= most).select("m", "a")
    lists = rows.join(few, ["m", "a"]).groupBy("m", "a").agg(F.array_join(F.sort_array(F.collect_list("smp")), ",").alias("samples"))
    kind = F.when(F.col("carriers") > most, "high").otherwise("list")
    return sized.join(lists, ["m", "a"], "left").select("m", "a", "carriers", kind.alias("kind"), "samples")


def haplotype_lists(gt: DataFrame, most: int, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(m, a, n, haps): how many haplotypes carry each allele of ``gt(m, hap, a)``, and their sorted list where there are ``most`` or fewer.

    ``again`` gives the rows of ``gt`` at given markers (m), so that only those with a list are read twice; without it all rows meet the list.
    """
    rows = gt.where("a >= 0").select("m", "hap", "a")
    sized = rows.groupBy("m", "a").agg(F.count("*").alias("n"))
    if again is not None:
        sized = checkpointed(sized)
        rows = again(sized.where(F.col("n") <= most).select("m").distinct()).where("a >= 0").select("m", "hap", "a")
    few = sized.where(F.col("n") <= most).select("m", "a")
    lists = rows.join(few, ["m", "a"]).groupBy("m", "a").agg(F.array_join(F.sort_array(F.collect_list("hap")), ",").alias("haps"))
    return sized.join(lists, ["m", "a"], "left")


def em_estimates(rows: DataFrame) -> DataFrame:
    """One row (p_mismatch, intensity) from ``rows(markers, mismatch, distance, switch)``, one for each haplotype.

    Mismatch probability is the mismatch mass over the markers, the recombination intensity the
    switch mass over the distance of the haplotypes that switch; NaN of nothing.
    """
    moved = F.col("switch") > 0
    over = lambda top, bottom: F.coalesce(F.try_divide(F.sum(top), F.sum(bottom)), F.lit(float("nan")))
    return rows.agg(over("mismatch", "markers").alias("p_mismatch"), over(F.when(moved, F.col("switch")), F.when(moved, F.col("distance"))).alias("intensity"))


def swap_rate(rows: DataFrame) -> DataFrame:
    """Swapped over unphased heterozygotes of ``rows(swaps, hets)``; NaN of nothing."""
    return rows.agg(F.coalesce(F.try_divide(F.sum("swaps").cast("double"), F.sum("hets").cast("double")), F.lit(float("nan"))).alias("swap_rate"))


def dose_r2(doses: DataFrame, keys: tuple[str, ...] = ("m",)) -> DataFrame:
    """(sum d^2 - S^2/n) / (S - S^2/n) per marker of ``doses(keys, d)``, 0 where S or the numerator is not positive; and S / n."""
    s, q, n = F.sum("d"), F.sum(F.col("d") * F.col("d")), F.count("*")
    sums = doses.groupBy(*keys).agg(s.alias("s"), q.alias("q"), n.alias("n"))
    top, bottom = F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("s") - F.col("s") * F.col("s") / F.col("n")
    r2 = F.when((F.col("s") == 0) | (top <= 0) | (bottom <= 0), 0.0).otherwise(top / bottom)
    return sums.select(*keys, r2.alias("dr2"), (F.col("s") / F.col("n")).alias("af"))


def ratio(rows: DataFrame, top: str, bottom: str) -> DataFrame:
    """sum(top) / sum(bottom); NaN of nothing."""
    return rows.agg(F.coalesce(F.try_divide(F.sum(top).cast("double"), F.sum(bottom).cast("double")), F.lit(float("nan"))).alias("ratio"))


def cumulative_counts(counts: DataFrame) -> DataFrame:
    upto = Window.partitionBy("m").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("m", "a", "n", F.sum("n").over(upto).alias("cum"))


def prefix_alleles(markers: DataFrame) -> DataFrame:
    """Number of alleles of all earlier markers of the chromosome, for ``markers(chrom, m, n_alleles)``."""
    before = Window.partitionBy("chrom").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    return markers.select("chrom", "m", F.coalesce(F.sum("n_alleles").over(before), F.lit(0)).alias("before"))


def order_faults(markers: DataFrame) -> DataFrame:
    """Markers that stand twice, and turning points of the position inside a chromosome."""
    line = Window.partitionBy("chrom").orderBy("m")
    turn = (F.col("pos") - F.lag("pos").over(line)) * (F.lead("pos").over(line) - F.col("pos")) < 0
    twice = F.count("*").over(Window.partitionBy("chrom", "pos")) > 1
    return markers.select("m", turn.alias("turn"), twice.alias("twice")).where("turn or twice").select("m", F.coalesce("turn", F.lit(False)).alias("turn"), "twice")


def merged_states(states: DataFrame) -> DataFrame:
    """Probabilities of states with the same sequence added up, per haplotype and cluster."""
    return states.groupBy("hap", "cluster", "seq").agg(F.sum("p").alias("p"), F.sum("p_next").alias("p_next"))


def array_extremes(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumns({"low": F.array_min(column), "high": F.array_max(column)})


def pruned_states(rows: DataFrame, least: Column) -> DataFrame:
    """States whose probability ``p`` here or ``p_next`` at the next cluster exceeds a bound."""
    return rows.where((F.col("p") > least) | (F.col("p_next") > least))
