"""Ordered and sequential operators against brute force, and files with odd records."""

import gzip
import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.functions import genotype as fn
from strandlake.functions.lcg import Lcg
from strandlake.operators import counts, filters, hmm, matching, segments
from strandlake.sources import bgzf, files


def test_generator_gives_the_published_sequence():
    """First draws of seed 42."""
    draws = Lcg(42)
    assert [draws.integer() for _ in range(4)] == [-1170105035, 234785527, -1360544799, 205897768]
    # fixed values: one generator, drawn from in turn
    draws = Lcg(42)
    assert [draws.integer() for _ in range(8)] == [-1170105035, 234785527, -1360544799, 205897768, 1325939940, -248792245, 1190043011, -1255373459]
    assert [draws.below(100) for _ in range(8)] == [19, 93, 82, 2, 76, 92, 76, 32]
    assert [draws.below(64) for _ in range(8)] == [29, 48, 50, 63, 58, 9, 27, 28]
    assert [draws.long() for _ in range(4)] == [-4613416830416070574, 7130900098642117381, 3272055439932147596, -7482923245497525943]
    assert [struct.unpack(">q", struct.pack(">d", draws.double()))[0] for _ in range(4)] == [4596725693450382048, 4605614858730985891, 4595372825410515644, 4603466295020716390]
    assert [draws.boolean() for _ in range(8)] == [True, True, True, False, True, False, True, True]
    assert Lcg(3).shuffled(list(range(30)), 5)[:5] == Lcg(3).shuffled(list(range(30)))[:5]
    assert sorted(Lcg(1).shuffled(list(range(30)))) == list(range(30))
    assert 0 <= Lcg(5).double() < 1 and isinstance(Lcg(5).boolean(), bool) and -(2**63) <= Lcg(5).long() < 2**63
    with pytest.raises(ValueError):
        Lcg(1).below(0)


def test_intervals():
    parse = filters.Interval.parse
    assert parse("20") == filters.Interval("20") and parse("20:5-9") == filters.Interval("20", 5, 9)
    assert parse("x:007-") == filters.Interval("x", 7) and parse("x:-9").end == 9 and parse("a:4") == filters.Interval("a", 4, 4)
    assert parse("1:1-5").overlaps(parse("1:5-9")) and not parse("1:1-5").overlaps(parse("1:6-9"))
    assert parse("1:1-5").hull(parse("1:8-9")) == filters.Interval("1", 1, 9)
    for bad in ("1:9-5", "1:-"):
        with pytest.raises(ValueError):
            parse(bad)


def test_schedules_and_scalars(spark):
    assert fn.lr_threshold(0, 3, 12) == math.inf and fn.lr_threshold(14, 3, 12) == 1.0
    rates = [fn.lr_threshold(i, 3, 12) for i in range(3, 15)]
    assert rates == sorted(rates, reverse=True)
    row = spark.createDataFrame([(0.005, 0.015, 1.0, "a;;b", "  x  y z ")], "a double, b double, c double, s string, w string")
    got = row.select(*(fn.dosage_text(F.col(c)).alias(c) for c in "abc"), fn.fields(F.col("s"), ";").alias("s"), fn.white_fields(F.col("w"), 2).alias("w")).first()
    assert (got.c, got.s, got.w) == ("1", ["a", "", "b"], ["x", "y z"])
    assert got.a in ("0", "0.01") and got.b in ("0.01", "0.02")


def test_greedy_runs_and_windows():
    assert segments.greedy_starts([0, 0.4, 1.0, 1.9, 2.0, 5], 1.0).tolist() == [0, 0, 1, 1, 2, 3]
    assert segments.greedy_starts([0, 0.4, 0.6, 1.4, 1.7], 1.0, 0.5).tolist() == [0, 0, 1, 1, 2]


def test_window_plan_prints_each_marker_once(spark):
    rng = random.Random(4)
    rows = []
    for chrom in range(3):
        cm = 0.0
        for m in range(200 if chrom else 1):
            cm += rng.choice([0.0, 0.01, 0.2])
            rows.append((chrom, chrom * 1000 + m, round(cm * 1e6), cm))
    marks = spark.createDataFrame(rows, "chrom int, m int, pos int, cm double")
    plan = segments.window_plan(marks, 4.0, 1.0)
    capped = segments.window_plan(marks, 4.0, 1.0, max_markers=20)
    assert capped.where("m_last - m_from >= 20").isEmpty()
    assert segments.printed_markers(marks, capped).where("window_id is null").count() == 0
    # twice the cM on the same bases: windows half as long
    gmap = spark.createDataFrame([(c, p, p / 5e5) for c in range(3) for p in (0, 10**8)], "chrom int, bp int, cm double")
    assert segments.window_plan(marks.withColumn("cm", F.col("cm") * 2), 4.0, 1.0, gmap).count() > plan.count()
    for chrom in range(3):
        own = sorted(plan.where(F.col("chrom") == chrom).collect(), key=lambda r: r.window_id)
        printed = [m for r in own for m in range(r.print_from, r.print_last + 1)]
        assert printed == [m for c, m, *_ in rows if c == chrom]
        assert all(a.m_last >= b.m_from - 1 for a, b in zip(own, own[1:], strict=False))
    assert segments.printed_markers(marks, plan).where("window_id is null").count() == 0


def test_clusters_and_steps(spark):
    marks = spark.createDataFrame([(0, m, m * 0.002) for m in range(40)], "chrom int, m int, cm double")
    gt = spark.createDataFrame([(m, 1, 0, int(m % 10 == 5)) for m in range(40)] + [(m, 2, -1, -1) for m in range(3)], "m int, smp int, a1 int, a2 int")
    got = {(r.smp, r.m): r.cluster for r in segments.genotype_clusters(gt, marks, 0.005).collect()}
    want, run, start, alone = {}, -1, 0.0, True
    for m in range(40):
        single = m % 10 == 5
        if run < 0 or single or alone or m * 0.002 - start > 0.005:
            run, start = run + 1, m * 0.002
        alone = single
        want[1, m] = run
    assert got == want | {(2, m): m for m in range(3)}
    steps = [tuple(r)[1:] for r in segments.ibs2_steps(marks, 2, 0.01).orderBy("step").collect()]
    keep = []
    for m in range(40):
        if not keep or m * 0.002 - keep[-1] * 0.002 >= 0.01:
            keep.append(m)
    assert steps == list(enumerate(keep[::2][:-1]))


def test_prefix_order_and_divergence(spark):
    rng = np.random.default_rng(3)
    for alleles in (rng.integers(0, 2, (12, 15)), rng.integers(0, 3, (9, 20)), np.zeros((4, 5), int)):
        orders, starts = matching.prefix_steps(alleles)
        for m in range(len(alleles)):
            order = sorted(range(alleles.shape[1]), key=lambda h: (tuple(alleles[: m + 1, h][::-1]), h))
            assert orders[m].tolist() == order
            for above, below, start in zip(order, order[1:], starts[m][1:], strict=False):
                first = m + 1
                while first > 0 and alleles[first - 1, above] == alleles[first - 1, below]:
                    first -= 1
                assert start == first
    rows = [(0, m, h, int(alleles[m, h])) for m in range(4) for h in range(5)]
    got = matching.prefix_neighbours(spark.createDataFrame(rows, "chrom int, m int, hap int, a int"), ["chrom"]).collect()
    assert {(r.hap, r.above, r.match_from) for r in got if r.m == 3} == {(0, -1, -1), *((h, h - 1, 0) for h in range(1, 5))}


def brute_posterior(hap, panel, r, eps):
    n, k = panel.shape
    e = np.where((panel == hap[:, None]) | (hap[:, None] < 0), 1 - eps, eps)
    f, b = np.zeros((n, k)), np.ones((n, k))
    f[0] = e[0] / k
    for t in range(1, n):
        f[t] = e[t] * ((1 - r[t]) * f[t - 1] + r[t] / k * f[t - 1].sum())
    for t in range(n - 2, -1, -1):
        x = e[t + 1] * b[t + 1]
        b[t] = (1 - r[t + 1]) * x + r[t + 1] / k * x.sum()
    p = f * b
    return p / p.sum(axis=1, keepdims=True)


def mosaic(rng, panel, switch):
    n, k = panel.shape
    states = np.zeros(n, int)
    states[0] = rng.integers(k)
    for t in range(1, n):
        states[t] = rng.integers(k) if rng.random() < switch else states[t - 1]
    return panel[np.arange(n), states]


def test_posteriors_equal_the_textbook():
    rng = np.random.default_rng(1)
    panel, r = rng.integers(0, 2, (30, 12)), np.append(0.0, rng.random(29) * 0.2)
    hap = mosaic(rng, panel, 0.1)
    hap[5] = -1
    assert np.allclose(hmm.posteriors(hap, panel, r, 0.01), brute_posterior(hap, panel, r, 0.01), atol=1e-4)


def test_phasing_keeps_genotypes_and_finds_the_phase():
    rng = np.random.default_rng(7)
    panel = rng.integers(0, 2, (300, 40))
    one, two = mosaic(rng, panel, 0.01), mosaic(rng, panel, 0.01)
    a1, a2 = np.maximum(one, two), np.minimum(one, two)
    h1, h2, decided = hmm.phase_hets(a1, a2, panel, np.full(300, 0.02), 0.001)
    assert (np.sort([h1, h2], axis=0) == np.sort([a1, a2], axis=0)).all()
    at = np.flatnonzero(one != two)
    side = h1[at] == one[at]
    assert (side[1:] != side[:-1]).mean() < 0.05
    gone = a1.copy()
    gone[:3] = -1
    assert (hmm.phase_hets(gone, np.where(gone < 0, -1, a2), panel, np.full(300, 0.02), 0.001)[0][:3] == -1).all()


VCF = ["##fileformat=VCFv4.2", "##source=\"x=y\"", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3", "1\t10\trs1\tA\tC,G\t.\tPASS\tEND=12;X=1\tGT:DP\t0|2:3\t./1\t1", "", "1\t20\t.\tT\t.\t.\t.\t.\tGT\t0/0\t.|.\t."]


@pytest.mark.parametrize("suffix", ["", ".gz", ".bgz"])
def test_vcf_records(spark, tmp_path, suffix):
    path = f"{tmp_path}/x.vcf{suffix}"
    raw = "\n".join(VCF).encode() + b"\n"
    with open(path, "wb") as out:
        out.write(raw if not suffix else gzip.compress(raw[:100]) + gzip.compress(raw[100:]) if suffix == ".gz" else bgzf.block(raw[:100]) + bgzf.block(raw[100:]) + bgzf.END_BLOCK)
    assert [tuple(r) for r in files.meta_lines(spark, path).collect()] == [("fileformat", "VCFv4.2"), ("source", '"x=y"')]
    assert [r.is_diploid for r in files.vcf_ploidy(spark, path).orderBy("smp").collect()] == [True, True, False]
    cells = {r.pos: r.cells for r in files.read_records(spark, path).collect()}
    assert cells[10][0] == {"GT": "0|2", "DP": "3"} and cells[10][1] == {"GT": "./1"}
    with pytest.raises(Exception, match="unphased reference genotype"):
        files.read_reference(spark, path)[1].collect()
    markers, gt = files.read_vcf(spark, path)
    assert [tuple(r) for r in markers.orderBy("pos").collect()] == [("1", 10, "rs1", "A", "C,G", "12"), ("1", 20, ".", "T", ".", "")]
    got = {(r.pos, r.smp): (r.a1, r.a2, r.phased, r.diploid) for r in gt.collect()}
    assert got == {(10, 0): (0, 2, True, True), (10, 1): (-1, -1, False, True), (10, 2): (1, 1, True, False), (20, 0): (0, 0, False, True), (20, 1): (-1, -1, True, True), (20, 2): (-1, -1, True, False)}
    assert files.vcf_samples(spark, path) == ["s1", "s2", "s3"]
    some = files.read_vcf(spark, path, exclude=("s1",))[1]
    assert {(r.pos, r.smp): r.a1 for r in some.collect()} == {(10, 0): -1, (10, 1): 1, (20, 0): -1, (20, 1): -1}
    with pytest.raises(ValueError, match="excluded"):
        files.read_vcf(spark, path, exclude=("s1", "s2", "s3"))
    odd = files.ploidy_faults(gt, files.vcf_ploidy(spark, path)).collect()
    assert [(r.pos, r.smp) for r in odd] == []
    assert files.ploidy_faults(gt.withColumn("diploid", F.lit(True)), files.vcf_ploidy(spark, path)).count() == 2


def test_imputed_records(spark):
    marks = spark.createDataFrame([(1, "1", 10, "rs1", "A", "C", "12"), (2, "1", 20, "rs2", "G", "T", ""), (3, "1", 30, "rs3", "G", "T", "")], "m int, chrom string, pos int, id string, ref string, alt string, end string")
    doses = [(1, 0, 0.5, True), (1, 1, 0.75, True), (1, 2, 0.0, True), (1, 3, 1.0, True), *((2, h, float(h == 3), False) for h in range(4))]
    rows = files.imputed_lines(marks, spark.createDataFrame(doses, "m int, hap int, dose double, imputed boolean"), ap=True, gp=True)
    got = {r.pos: r.line.split("\t") for r in rows.collect()}
    assert sorted(got) == [10, 20]  # a marker without doses has no record
    assert got[10][:7] == ["1", "10", "rs1", "A", "C", ".", "PASS"] and got[10][8] == "GT:DS:AP1:AP2:GP"
    s, q, n = 2.25, 0.25 + 0.5625 + 1, 4
    assert got[10][7] == f"DR2={(q - s * s / n) / (s - s * s / n):.2f};AF=0.5625;END=12;IMP" and got[20][7] == "DR2=1.00;AF=0.2500"
    assert got[10][9:] == ["0|1:1.25:0.5:0.75:0.12,0.5,0.38", "0|1:1:0:1:0,1,0"] and got[20][9:] == ["0|0:0:0:0:1,0,0", "0|1:1:0:1:0,1,0"]
    probs = [(1, 0, [0.2, 0.7, 0.1], True), (1, 1, [0.5, 0.0, 0.5], True)]
    more = files.imputed_lines(marks.where("m = 1").withColumn("alt", F.lit("C,G")), spark.createDataFrame(probs, "m int, hap int, probs array<double>, imputed boolean"), ap=True, gp=True)
    own = more.first().line.split("\t")
    r2 = [(q - s * s / 2) / (s - s * s / 2) for s, q in ((0.7, 0.49), (0.6, 0.26))]
    assert own[7] == f"DR2={r2[0]:.2f},{max(r2[1], 0):.2f};AF=0.3500,0.3000;END=12;IMP" and own[9] == "1|0:0.7,0.6:0.7,0.1:0,0.5:0.1,0.35,0,0.15,0.35,0.05"
    texts = spark.createDataFrame([(0.00015, None)], "a double, b double").select(fn.fixed_text(F.col("a"), 4).alias("a"), fn.fixed_text(F.col("b"), 2).alias("b")).first()
    assert tuple(texts) == (f"{0.00015:.4f}", None)


def test_small_files(spark, tmp_path):
    (tmp_path / "map").write_text("1 . 0.0 100\n1 . 1.5 200\n1 . 1.0 300\n2 . 0 5\n")
    gmap = files.read_map(spark, str(tmp_path / "map"))
    assert gmap.count() == 4 and [r.bp for r in files.map_faults(gmap).collect()] == [300]
    assert files.read_map(spark, str(tmp_path / "map"), "2").count() == 1
    with pytest.raises(ValueError, match="1:300"):
        files.read_map(spark, str(tmp_path / "map"), checked=True)
    assert files.read_map(spark, str(tmp_path / "map"), "2", checked=True).count() == 1
    (tmp_path / "ids").write_text(" a \n\nb\na\n")
    assert {r.id for r in files.read_ids(spark, str(tmp_path / "ids")).collect()} == {"a", "b"}
    (tmp_path / "bad").write_text("a b\n")
    with pytest.raises(Exception, match="more than one field"):
        files.read_ids(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "ped").write_text("f c1 p1 0\nf c2 p1 p2\n")
    assert {tuple(r) for r in files.read_pedigree(spark, str(tmp_path / "ped")).collect()} == {("c1", "p1", None), ("c2", "p1", "p2")}


def test_ratio_of_nothing(spark):
    assert math.isnan(counts.ratio(spark.createDataFrame([], "a double, b double"), "a", "b").first().ratio)
