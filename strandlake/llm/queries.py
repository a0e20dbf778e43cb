"""The queries of the operators here: each over the whole of its table, and the SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, bpe_rounds, exact, licences, merkle, mixing, pii, quality, simhash, toxicity, url_rules, warc
from .common import crc_fold, crc_of, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str = VOCABULARY) -> tuple[str, str]:
    """Path and split pattern of an installed public vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), toxicity.toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.parse_records(warc.archive_round_trip(table(spark, sf_dir, "pages")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", pii.find_spans(F.col("text"), pii.train(docs)).alias("s"))
    base = F.filter("s", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base_of = lambda kind: F.filter("s", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(base_of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("s")).alias("spans"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    coded = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(F.col("text"), path, pattern).alias("r"))
    return coded.select("doc_id", bpe.id_count(F.col("r.ids")).alias("n_tokens"), F.sha2("r.ids", 256).alias("ids_sha256"), F.sha2("r.decoded", 256).alias("decoded_sha256"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.corpus_path()).drop("uid")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (vocabulary(name)[0] for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    rows = alignment.link_statistics(table(spark, sf_dir, "documents"), a, b)
    return rows.withColumnRenamed("id", "doc_id")


def op12_round_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = vocabulary("byte_bpe_50k.json")
    coded = table(spark, sf_dir, "documents").select("doc_id", bpe_rounds.word_round_trip(F.col("text"), path).alias("r"))
    decimal = F.array_join(F.col("r.ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("r.ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("r.decoded", 256).alias("decoded_sha256"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = merkle.row_hash("doc_id", "source", "lang", "n_chars", "text")
    tampered = merkle.row_hash("doc_id", "source", "lang", F.col("n_chars") + 1, "text")
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(crc_of("doc_id") % 7 == 0, tampered).alias("offered"))
    return merkle.manifest(rows, "lang", "doc_id").select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_simhash, op3_exact_dedup, op4_toxicity, op5_warc, op6_pii, op7_byte_bpe, op8_url_rules, op9_quality_rules, op10_licences, op11_alignment, op12_round_bpe, op13_manifest)
}

ORACLE_SQL = {
    "op1_mix_sources": r"""
WITH marks AS (
  SELECT doc_id AS id, avg(CASE WHEN quality = 1 THEN 2.0 WHEN quality = 0 THEN 0.5 ELSE 1.0 END::DOUBLE) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':7'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / greatest(coalesce(quality, 1.0), 1e-6) AS key
  FROM documents LEFT JOIN marks ON doc_id = id
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM rows GROUP BY source
), weighed AS (
  SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap, source_size::DOUBLE * 3 / ((rank - 1) % 3 + 1)::DOUBLE AS bound FROM sizes
), levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY bound, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source AS s, source_size, least(cap, (SELECT level FROM levels WHERE level <= bound ORDER BY bound, rank LIMIT 1) * weight) AS target FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS epochs FROM targets
), placed AS (
  SELECT doc_id, size, source_size, target, epochs, greatest(round(target)::BIGINT - epochs * source_size, 0)
    - coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM rows JOIN plan ON source IS NOT DISTINCT FROM s
)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN epochs < 3 THEN greatest(least(size, room), 0) ELSE 0 END)::BIGINT AS taken FROM placed
""",
    "op3_exact_dedup": r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), ranked AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
""",
    "op13_manifest": r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')) AS f,
    list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents
), rows AS (
  SELECT doc_id, lang, sha256(array_to_string(f, '')) AS leaf, coalesce(xor(crc, 4294967295) % 7 = 0, false) AS changed,
    CASE WHEN n_chars IS NULL THEN f[4] ELSE strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1)::VARCHAR END AS other, f FROM fields
), leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN changed THEN sha256(f[1] || f[2] || f[3] || other || f[5]) ELSE leaf END AS offered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM rows
), nodes AS (
  SELECT coalesce('=' || lang, '') AS tree, 0 AS level, rank, leaf AS node, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, rank // 2, sha256(string_agg(node, '' ORDER BY rank)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY tree, level, rank // 2
), tops AS (
  SELECT tree, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1
), over AS (
  SELECT 0 AS level, rank, subroot AS node, n FROM tops
  UNION ALL
  SELECT level + 1, rank // 2, sha256(string_agg(node, '' ORDER BY rank)), any_value((n + 1) // 2) FROM over WHERE n > 1 GROUP BY level, rank // 2
), steps AS (
  SELECT tree, level, rank, CASE WHEN rank % 2 = 0 THEN 'r' ELSE 'l' END || coalesce((SELECT o.node FROM nodes o WHERE o.tree = a.tree AND o.level = a.level AND o.rank = xor(a.rank, 1)), '') AS step FROM nodes a WHERE n > 1
), over_steps AS (
  SELECT level, rank, CASE WHEN rank % 2 = 0 THEN 'r' ELSE 'l' END || coalesce((SELECT o.node FROM over o WHERE o.level = a.level AND o.rank = xor(a.rank, 1)), '') AS step FROM over a WHERE n > 1
), top_paths AS (
  SELECT t.tree, any_value(subroot) AS subroot, coalesce(list(step ORDER BY level) FILTER (step IS NOT NULL), []) AS path FROM tops t LEFT JOIN over_steps s ON s.rank = t.rank >> s.level::BIGINT GROUP BY t.tree
), paths AS (
  SELECT doc_id, l.leaf, l.offered, l.lang, l.rank, coalesce(list(step ORDER BY level) FILTER (step IS NOT NULL), []) AS path
  FROM leaves l LEFT JOIN steps s ON s.tree = coalesce('=' || l.lang, '') AND s.rank = l.rank >> s.level::BIGINT GROUP BY ALL
), whole AS (
  SELECT doc_id, leaf, offered, subroot, (SELECT node FROM over WHERE n = 1) AS root, list_concat(p.path, t.path) AS path FROM paths p JOIN top_paths t ON t.tree = coalesce('=' || p.lang, '')
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: substr(s, 2)), '')) AS proof_sha256,
  list_reduce(list_prepend(offered, path), lambda node, s: sha256(CASE WHEN s[1] = 'r' THEN node || substr(s, 2) ELSE substr(s, 2) || node END)) AS folded_root, folded_root = root AS verified FROM whole
""",
}
