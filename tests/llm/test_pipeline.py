"""The pipeline over a small corpus: what stays, what is repeated, and the tokens."""

import os
import random
import re
from collections import Counter

import corpus_pipeline
from strandlake.llm import bpe, mixing, toxicity
from strandlake.llm.queries import vocabulary

from .test_core import documents, toxic_rows, union_find


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def alike(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def test_pipeline_equals_brute_force(spark, tmp_path):
    import tiktoken

    made = [(i, t, f"s{i % 3}", y) for i, t, y in toxic_rows(150)]
    made += [(1000 + i, t.replace(" ", "  "), "s0", 0) for i, t, _, y in made[:20] if not y] + [(2000, None, None, 0), (2001, "", "s1", 0)]
    # copies of long texts with one to nine words changed stand on either side of a similarity of 0.8
    rng = random.Random(5)
    for k in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(60 + 20 * k)]
        made.append((3000 + 20 * k, " ".join(words), f"s{k % 3}", 0))
        for n in range(1, 10):
            changed = list(words)
            for at in rng.sample(range(len(words)), n):
                changed[at] = f"x{rng.randrange(99)}"
            made.append((3000 + 20 * k + n, " ".join(changed), "s1", 0))
    docs = documents(spark, [r[:3] for r in made]).coalesce(1)
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in made], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = [(i, t, s) for i, t, s, _ in made if model.score(t) < 0.5]
    groups = {}
    for row in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", row[1] or ""), []).append(row)
    rows = [min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values()]
    sets = [shingles(t) for _, t, _ in rows]
    root = union_find(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])])
    assert len(set(root)) < len(rows) and max(Counter(root).values()) < 12
    near = {}
    for row, r in zip(rows, root, strict=True):
        near[r] = min(near.get(r, row), row)
    rows = list(near.values())
    plan = mixing.mix_sources(mixing.with_quality(documents(spark, rows), labels)).collect()
    times = Counter({r.doc_id: r.epochs + (r.part > 0) for r in plan if r["size"]})
    path, pattern = vocabulary()
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = Counter({(i, len(plain.encode_ordinary(t or ""))): times[i] for i, t, _ in rows if times[i]})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in got) and Counter((r.doc_id, r.n_tokens) for r in got) == want


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No rows; and columns named like those that the stages make, with null ids, repeated rows and texts without words."""
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/none/labels.parquet")
    documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rows = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (None, None, None), (None, "", "b"), (3, " \t", "a"), (4, "another text of its own words", None)]
    odd = documents(spark, rows).selectExpr("*", "1 as uid", "2 as block", "3 as mask", "4 as times", "5 as Node", "6 as root", "7 as id")
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    labels.write.parquet(f"{tmp_path}/odd/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/odd")
        assert docs.columns == odd.columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()} == {1, 4}


def test_results_of_stages_live_side_by_side(spark, tmp_path):
    """A stage deletes nothing that another result still reads, in whatever order results are asked for; a run leaves only its result."""
    rows = [(i, f"text number {i // 2} of its own", "a") for i in range(40)]
    docs = documents(spark, rows)
    first = [stage(spark, docs, str(tmp_path)) for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies)]
    second = [stage(spark, docs.where("doc_id < 10"), str(tmp_path)) for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies)]
    assert [x.count() for x in second + first] == [5, 5, 20, 20]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    runs = [corpus_pipeline.run(spark, str(tmp_path)) for _ in range(2)]
    assert [x.count() for x in runs] == [20, 20]
    for x in runs:
        place = x.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
        assert sorted(os.listdir(place)) == ["byte_bpe"]
