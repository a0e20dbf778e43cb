"""URL filters: explicit host and path rules, then association rules mined by FP-growth.

DataFrame and Spark ML operations only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("block", "allow")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The explicit rules.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end. Both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(tail, r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does. ``rules`` is a short list."""
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
    pick = lambda what: F.coalesce(*(F.when(fits(r), what(r)) for r in longest), F.lit(None).cast("string"))
    return pick(lambda r: F.lit(r.name)), pick(lambda r: F.lit(r.verdict))


def url_tokens(url: Column) -> Column:
    """Distinct lower-case tokens of a URL: runs of letters and digits after the scheme, without pure numbers."""
    rest = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:/?#]*://", ""))
    return F.array_distinct(F.filter(F.split(rest, r"[^\p{L}\p{N}]+"), lambda t: ~t.rlike(r"^\p{N}*$")))


def frequent_tokens(labelled: DataFrame, least: Column) -> DataFrame:
    """(token, n, item): tokens of at least ``least`` URLs and how many have them.

    Tokens that stand in exactly the same URLs are one item, named after the first: a rule
    with one of them holds just when it has all of them (closed sets), so a template of
    twelve tokens costs one item and not 4096 combinations. Sets of URLs are compared by
    size and two 64-bit sums over hashes of their numbers.
    """
    spread = labelled.select("uid", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.sum(F.xxhash64(F.lit(1), "uid").cast("decimal(38,0)")).alias("s"))
    often = spread.where(F.col("n") >= least)
    return often.select("token", "n", F.min("token").over(Window.partitionBy("n", "x", "s")).alias("item"))


def holders(urls: DataFrame, wanted: DataFrame, weight: DataFrame, salts: int = 16) -> DataFrame:
    """(uid, key) of the ``urls(uid, tokens)`` that hold all tokens of a set of ``wanted(key, wanted)``.

    The inverted index lists every set under its rarest token by ``weight(token, n)``, the
    number of URLs that have it. A URL meets a set only through that token; then the
    other tokens are checked. A token that very many URLs have is dealt out by ``salts``:
    the index, which is small, has it that many times.
    """
    rare = wanted.select("key", F.explode("wanted").alias("token")).join(weight.select("token", "n"), "token", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    index = wanted.join(rare, "key").select(F.col("least.token").alias("token"), "key", "wanted", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    asked = urls.select("uid", "tokens", F.explode("tokens").alias("token"), F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int").alias("salt"))
    return asked.join(index, ["token", "salt"]).where(F.size(F.array_except("wanted", "tokens")) == 0).select("uid", "key")


_RULES = "rule_id long, tokens array<string>, verdict string, confidence double, support double, bound double"


def lower_bound(hits: Column, n: Column, z: float) -> Column:
    """The lower end of Wilson's interval for the share of ``hits`` in ``n``: it grows with the share and, for a given share, with ``n``."""
    share = hits / n
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _sets_at_most(sizes: dict[int, int], least: int) -> int:
    """A bound on the sets that stand in ``least`` baskets or more, from how many baskets have each size.

    Without half of those baskets, the largest ones, each such set still stands in the other half; so a few very long URLs do not count.
    """
    skip, total = least // 2, 0
    for size, n in sorted(sizes.items(), reverse=True):
        off = min(skip, n)
        skip -= off
        total += (n - off) << size
    return total // (least - least // 2)


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_rows: int = 5, z: float = 1.96, max_sets: int = 20_000_000) -> DataFrame:
    """Rules (rule_id, tokens, verdict, confidence, support, bound) from ``labelled(uid, tokens, verdict)``.

    A set of tokens makes a rule if it reaches support (a share of all labelled URLs, ``min_rows`` of them at least) and
    confidence, and if the lower bound of its confidence (``z`` deviations) is above the verdict's share without tokens; few labels so need
    no threshold of their own. Rules are ranked by that bound. A rule of which a part has the same verdict and a bound as high can
    never be the best one that matches, and is left out; nothing else is.

    FP-growth runs over all items of all URLs, with the verdict as one item more, so its counts are those of the rules. Only items
    that stand under one verdict alone are rules by themselves and take no part: what holds them is left out anyway. Should URLs hold
    so many items that more than ``max_sets`` sets could reach the support, an error asks for a higher one, as no rule is dropped silently.
    The result is stored, as it is used several times.
    """
    rows = checkpointed(labelled.where("verdict is not null").select("uid", "tokens", "verdict"))
    totals = {r.verdict: r["count"] for r in rows.groupBy("verdict").count().collect()}
    if not (n := sum(totals.values())):
        return labelled.sparkSession.createDataFrame([], _RULES)
    least = max(math.ceil(min_support * n), min_rows)
    often = frequent_tokens(rows, F.lit(least))
    items = often.groupBy("item").agg(F.sort_array(F.collect_list("token")).alias("all"))
    held = rows.select("uid", "verdict", F.explode("tokens").alias("item")).join(items.select("item"), "item")
    told = held.groupBy("item").agg(F.count("*").alias("n"), *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))
    told = checkpointed(told.join(items, "item"))
    mixed = told.where(F.greatest(*VERDICTS) < F.col("n")).select("item")
    # no token has this sign
    baskets = checkpointed(held.join(mixed, "item").groupBy("uid").agg(F.concat(F.collect_list("item"), F.array(F.concat(F.lit("="), F.first("verdict")))).alias("items")))
    sizes = {r.size: r["count"] for r in baskets.groupBy(F.size("items").alias("size")).count().collect()}
    if (could := _sets_at_most(sizes, least)) > max_sets:
        raise ValueError(f"up to {could} sets of tokens reach {least} URLs; raise min_support or max_sets")
    counted = told.select(F.array("item").alias("body"), "n", *VERDICTS)
    if sizes:
        sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / sum(sizes.values())).fit(baskets).freqItemsets
        body = F.array_sort(F.filter("items", lambda t: ~t.startswith("=")))
        freq = lambda mark: F.max(F.when(mark, F.col("freq")))
        bare = F.size("body") == F.size("items")
        more = sets.withColumn("body", body).where("size(body) > 1").groupBy("body").agg(freq(bare).alias("n"), *(F.coalesce(freq(~bare & F.array_contains("items", f"={v}")), F.lit(0)).alias(v) for v in VERDICTS))
        counted = counted.unionByName(more)
    each = counted.select("body", "n", F.explode(F.array(*(F.struct(F.lit(v).alias("verdict"), F.col(v).alias("hits"), F.lit(totals.get(v, 0) / n).alias("share")) for v in VERDICTS))).alias("v")).select("body", "n", "v.*")
    each = each.withColumn("bound", lower_bound(F.col("hits"), F.col("n"), z)).where((F.col("hits") >= least) & (F.col("hits") / F.col("n") >= min_confidence) & (F.col("bound") > F.col("share")))
    good = checkpointed(each.select(F.xxhash64(F.array_join("body", " "), "verdict").alias("key"), "body", "verdict", "hits", "n", "bound"))
    # parts of a rule are found as rules are in URLs
    asked = good.select(F.col("key").alias("uid"), F.col("body").alias("tokens"))
    parts = holders(asked, good.select("key", F.col("body").alias("wanted")), asked.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")))
    of = lambda side: good.select(F.col("key").alias(side), F.col("verdict").alias(f"{side}_verdict"), F.col("bound").alias(f"{side}_bound"))
    spare = parts.where("uid <> key").join(of("whole"), F.col("uid") == F.col("whole")).join(of("part"), F.col("key") == F.col("part"))
    spare = spare.where("whole_verdict = part_verdict and part_bound >= whole_bound").select(F.col("whole").alias("key")).distinct()
    named = good.join(spare, "key", "left_anti").select("key", "verdict", "hits", "n", "bound", F.explode("body").alias("item")).join(told.select("item", "all"), "item")
    rules = named.groupBy("key", "verdict", "hits", "n", "bound").agg(F.array_sort(F.flatten(F.collect_list("all"))).alias("tokens"))
    return checkpointed(rules.select(F.col("key").alias("rule_id"), "tokens", "verdict", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / n).alias("support"), "bound"))


def matched_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(uid, verdict, rule_id) of those ``urls(uid, tokens)`` that hold all tokens of a rule, found by :func:`holders`.

    The rule with the highest bound wins, then that with more support, then block before allow.
    """
    weight = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    met = holders(urls, rules.select(F.col("rule_id").alias("key"), F.col("tokens").alias("wanted")), weight).join(rules, F.col("key") == F.col("rule_id"))
    best = F.max(F.struct("bound", "support", (F.col("verdict") == "block").alias("b"), "verdict", "rule_id")).alias("best")
    return met.groupBy("uid").agg(best).select("uid", F.col("best.verdict").alias("verdict"), F.col("best.rule_id").alias("rule_id"))


def held_out_figures(labelled: DataFrame, folds: int = 5, **options: float) -> DataFrame:
    """One row (labelled, matched, right): rules mined from all folds but the first, judged on the first. Folds go by the hash of the number."""
    fold = F.pmod(F.xxhash64("uid"), F.lit(folds))
    rules = mine_rules(labelled.where(fold != 0), **options)
    asked = labelled.where((fold == 0) & F.col("verdict").isNotNull())
    got = asked.join(matched_verdicts(asked.select("uid", "tokens"), rules).select("uid", F.col("verdict").alias("told")), "uid", "left")
    return got.agg(F.count("*").alias("labelled"), F.count("told").alias("matched"), F.count_if(F.col("told") == F.col("verdict")).alias("right"))


def parsed(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(uid, page_id, host, path, rule, own, tokens, marked) of each page: what an explicit rule or a label says of it.

    ``labels(url, verdict)`` may name further URLs; where they repeat, block counts.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), "page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("uid", "page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("own"), url_tokens(F.col("url")).alias("tokens"))
    if labels is None:
        return rows.drop("url").withColumn("marked", F.col("own"))
    marks = labels.where(F.col("verdict").isin(*VERDICTS)).groupBy(F.col("url").alias("_u")).agg(F.max("verdict").alias("_v"))
    return rows.join(marks, F.col("url") == F.col("_u"), "left").withColumn("marked", F.coalesce("own", "_v")).drop("url", "_u", "_v")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, **options: float) -> DataFrame:
    """One row per row of ``pages``: uid, page_id, host, path, rule, verdict, mined_rule.

    An explicit rule decides where one fits, else the best mined rule that matches, else
    the URL is allowed. Rules are mined from URLs whose verdict is known: those that an
    explicit rule decides, and those of ``labels(url, verdict)`` where it is given. Null URLs and those without ``://``
    have an empty host and path and are allowed unless a mined rule blocks their tokens; very long URLs are read whole;
    repeated rows are judged each; other columns are not read; empty tables give no rows.
    """
    rows = checkpointed(parsed(pages, labels, rules))
    mined_rules = mine_rules(rows.select("uid", "tokens", F.col("marked").alias("verdict")), **options)
    mined = matched_verdicts(rows.where("own is null").select("uid", "tokens"), mined_rules).select(F.col("uid").alias("u"), F.col("verdict").alias("learned"), F.col("rule_id").alias("mined_rule"))
    return rows.join(mined, rows.uid == mined.u, "left").select("uid", "page_id", "host", "path", "rule", F.coalesce("own", "learned", F.lit("allow")).alias("verdict"), "mined_rule")
