"""Scalar functions on alleles, genotypes, probabilities and marker fields, as column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def genotype_index(a: Column, b: Column) -> Column:
    """Index of the unordered pair: high * (high + 1) / 2 + low."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.floor(high * (high + 1) / 2) + low


def genotype_class(a1: Column, a2: Column, phased: Column) -> Column:
    """missing, hom, het (unphased) or phased_het; one missing allele makes the genotype missing."""
    return F.when((a1 < 0) | (a2 < 0), "missing").when(a1 == a2, "hom").when(phased, "phased_het").otherwise("het")


def genotype_probabilities(p1: Column, p2: Column) -> Column:
    """Probabilities of unordered genotypes from allele probabilities of two haplotypes, by higher then lower allele."""
    at = lambda p, i: F.element_at(p, (i + 1).cast("int"))
    row = lambda b: F.transform(F.sequence(F.lit(0), b), lambda a: F.when(a == b, at(p1, a) * at(p2, b)).otherwise(at(p1, a) * at(p2, b) + at(p1, b) * at(p2, a)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(p1) - 1), row))


def dosage_rounded(x: Column) -> Column:
    """Two decimals, half to even on the 32-bit product with 100."""
    return F.rint((F.lit(100).cast("float") * x.cast("float")).cast("double")) / 100


def dosage_text(x: Column) -> Column:
    """As :func:`dosage_rounded`, without trailing zeros."""
    return F.rtrim(F.rtrim(dosage_rounded(x).cast("decimal(18,2)").cast("string"), F.lit("0")), F.lit("."))


def fixed_text(x: Column, places: int) -> Column:
    """``x`` with fixed decimals, half to even on its exact binary value, which Spark's own formats do not give."""

    def udf(rows: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{places}f}" for v in rows.to_pylist()], pa.string())

    return arrow_udf(udf, "string")(x.cast("double"))


def normalised(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.transform(p, lambda x: x / total)


def argmax(p: Column) -> Column:
    """Index from 0 of the largest element; the first of equal ones."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def mismatch_probability(n_haps: int) -> float:
    """theta / (2 (theta + n)) with theta = 1 / (ln n + 0.5)."""
    theta = 1 / (math.log(n_haps) + 0.5)
    return theta / (2 * (theta + n_haps))


def mismatch(n_haps: Column) -> Column:
    theta = 1 / (F.log(n_haps.cast("double")) + 0.5)
    return theta / (2 * (theta + n_haps))


def recombination(intensity: Column | float, distance: Column) -> Column:
    """1 - exp(-intensity * distance)."""
    return -F.expm1(-(F.lit(intensity) if isinstance(intensity, float) else intensity) * distance)


def imputation_recombination(ne: float, n_ref_haps: int, distance: Column) -> Column:
    return -F.expm1(F.lit(-0.04 * ne / n_ref_haps) * distance)


def cluster_error(error: float, size: Column) -> Column:
    return F.least(F.lit(0.5), F.lit(error) * size)


def lr_threshold(iteration: int, burnin: int, iterations: int, initial: float = 100_000.0) -> float:
    """Threshold of the likelihood ratio by iteration: infinite in burn-in, then falling geometrically, 1 at last."""
    if iteration < burnin:
        return math.inf
    k = iteration - burnin
    if k >= iterations - 1:
        return 1.0
    return 4 * (initial / 4) ** ((iterations - 1 - k) / (iterations - 1))


def info_end(info: Column) -> Column:
    """Value of END in an INFO field; empty if it has none."""
    return F.regexp_extract(info, r"(?:^|;)END=([^;]*)", 1)


def with_allele_counts(info: Column, an: Column, ac: Column) -> Column:
    """INFO with AN and AC put first and earlier ones removed."""
    rest = F.filter(F.split(info, ";"), lambda f: ~f.rlike(r"^(AN|AC)(=|$)") & (f != ".") & (f != ""))
    first = F.array(F.concat(F.lit("AN="), an.cast("string")), F.concat(F.lit("AC="), ac))
    return F.array_join(F.concat(first, rest), ";")


def n_alleles(alt: Column) -> Column:
    return 1 + F.when((alt == ".") | (alt == ""), 0).otherwise(F.size(F.split(alt, ",")))


def marker_name(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"), ref, alt)


def fields(text: Column, delimiter: str, limit: int = -1) -> Column:
    """Parts between single delimiters, empty ones kept; at most ``limit`` parts if positive."""
    return F.split(text, "\\Q" + delimiter + "\\E", limit)


def white_fields(text: Column, limit: int = -1) -> Column:
    """Parts between runs of white space after trimming; the last of ``limit`` parts keeps the rest."""
    return F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", limit)


def mean_cm_per_base(markers: DataFrame) -> DataFrame:
    """(chrom, mean): cM per base from the first to the last marker of ``markers(chrom, pos, cm)``, at least 1e-8; an error where all stand at one position."""
    span = F.max("pos") - F.min("pos")
    slope = F.when(span > 0, (F.max("cm") - F.min("cm")) / span).otherwise(F.raise_error(F.lit("one position only")).cast("double"))
    return markers.groupBy("chrom").agg(F.greatest(slope, F.lit(1e-8)).alias("mean"))


def marker_ids(ids: Column) -> Column:
    """Ids of a marker; none for ``.``."""
    return F.when(ids == ".", F.array().cast("array<string>")).otherwise(F.split(ids, ";"))


def marker_alleles(ref: Column, alt: Column) -> Column:
    return F.when((alt == ".") | (alt == ""), F.array(ref)).otherwise(F.concat(F.array(ref), F.split(alt, ",")))


def n_genotypes(alleles: Column) -> Column:
    """Unordered pairs of that many alleles: n (n + 1) / 2."""
    return F.floor(alleles * (alleles + 1) / 2)


def marker_key(chrom: Column, pos: Column, ref: Column, alt: Column, end: Column) -> Column:
    """What makes two markers the same: chromosome, position, alleles and END; not the id."""
    return F.struct(chrom.alias("chrom"), pos.alias("pos"), ref.alias("ref"), alt.alias("alt"), F.coalesce(end, F.lit("")).alias("end"))


def chromosome_order(chrom: Column) -> Column:
    """What chromosomes are sorted by: their first run of digits as a number, those without digits last, then the name."""
    name = chrom.cast("string")
    number = F.try_to_number(F.nullif(F.regexp_extract(name, r"([0-9]{1,18})", 1), F.lit("")), F.lit("9" * 18))
    return F.struct(number.isNull().alias("z"), number.alias("n"), name.alias("name"))
