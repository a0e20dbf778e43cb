"""the pipeline's near-copy stage links texts by SimHash, and by similarity what fingerprints cannot see."""

import random

import corpus_pipeline
from strandlake.llm import jaccard, simhash


def _texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    # a phrase that is most of each text, so that fingerprints agree, with tails of their own: as sets of shingles they are far apart
    phrase = [word() for _ in range(7)] * 200
    far = [[*phrase, *(word() for _ in range(60))] for _ in range(4)]
    other = [word() for _ in range(400)]
    return [(i, " ".join(t)) for i, t in enumerate(far)] + [(100, " ".join(other)), (101, " ".join([*other[:-3], "x"]))]


def test_stage_links_by_fingerprint_and_by_similarity(spark):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string").repartition(2)
    rows = simhash.near_groups(docs).groupBy("component_id").count().where("count > 1").collect()
    by_similarity = {r.doc_id for r in jaccard.keep_dissimilar(docs).collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert rows, "no two texts of the test are linked by fingerprint"
    assert 101 not in kept and 100 in kept
    assert kept < by_similarity


def test_further_passes_change_no_group(spark):
    rng = random.Random(5)
    base = [str(rng.random()) for _ in range(60)]
    texts = [" ".join(w if rng.random() > 0.03 else str(rng.random()) for w in base) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    docs.write.mode("overwrite").saveAsTable("crowd")
    groups = [sorted(map(tuple, jaccard.similar_groups(spark.table("crowd"), turns=0, extra=n).collect())) for n in (0, 3)]
    spark.sql("drop table crowd")
    assert groups[0] and groups[0] == groups[1]
