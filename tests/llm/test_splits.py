"""Rows stay the same where a table is split otherwise when it is read again."""

import pytest

from strandlake.llm import exact, jaccard, mixing, simhash, warc

from .test_core import documents, odd_rows


@pytest.fixture
def split(spark):
    """A setting that is changed between the decision and the rows."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    yield lambda size: [spark.conf.set(n, size) for n in names]
    for n in names:
        spark.conf.unset(n)


def table(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] is not None]
    documents(spark, rows).repartition(8, "doc_id").write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


@pytest.mark.parametrize("keep", [exact.keep_exact, simhash.keep_near, jaccard.keep_dissimilar])
def test_kept_rows_do_not_depend_on_splits(spark, tmp_path, split, keep):
    docs = table(spark, tmp_path)
    split("64m")
    want = sorted(tuple(r) for r in keep(docs).select("doc_id").collect())
    lazy = keep(docs).select("doc_id")
    split("1k")
    assert sorted(tuple(r) for r in lazy.collect()) == want


def test_mixed_rows_do_not_depend_on_splits(spark, tmp_path, split):
    docs, labels = table(spark, tmp_path), spark.createDataFrame([], "doc_id long, quality int")
    split("64m")
    want = sorted(tuple(r) for r in mixing.mix_rows(docs, labels).select("doc_id").collect())
    lazy = mixing.mix_rows(docs, labels).select("doc_id")
    split("1k")
    assert sorted(tuple(r) for r in lazy.collect()) == want


def test_archive_does_not_depend_on_splits(spark, tmp_path, split, monkeypatch):
    pages = table(spark, tmp_path).selectExpr("doc_id as page_id", "source as url", "text as html")
    plain = warc.checkpointed
    split("64m")
    monkeypatch.setattr(warc, "checkpointed", lambda df: (plain(df), split("1k"))[0])
    warc.write_archive(pages, f"{tmp_path}/archive")
    texts = {r.html or "" for r in pages.collect()}
    assert sorted(bytes(r.payload).decode() for r in spark.read.parquet(f"{tmp_path}/archive/payloads").collect()) == sorted(texts)
    assert warc.parse_records(warc.read_archive(spark, f"{tmp_path}/archive")).count() == pages.count()
