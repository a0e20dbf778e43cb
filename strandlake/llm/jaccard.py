"""Near copies by the Jaccard similarity of word shingles, found by a prefix join and without loss.

Two sets with similarity 4/5 or more have 4/9 of their summed sizes in common. If all
shingles are brought into one order, the first that both have stands among the first
``n - ceil(8n/9) + 1`` of the smaller set and the first ``n - ceil(4n/5) + 1`` of the
larger, so a join over these few finds every such pair; each is then counted exactly.
The order puts shingles that a sample of the texts has often last. It is the same for
all texts and decides only how much work there is, never the result.

Groups are made in passes, so that thousands of copies of one text do not meet each
other: in the first ones each text is compared with the four texts that lead most of its shingles, then all
pairs are compared that share a shingle and are not in one group yet. The first passes only save work.
A good leader is a text that shares many of the shingles it shows: a copy with few changes of its own is
like most other copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from . import simhash
from .common import checkpointed, components, fresh, stored, values
from .simhash import shingle_hashes

WIDTH = 5
_BITS = 20
_MASK = np.uint64((1 << _BITS) - 1)
#: Of so many texts one is counted for the order.
_SAMPLE = 16
#: Longs in a text's parity map.
_MAP = 8


def shingle_set(raw: bytes | None) -> np.ndarray:
    """The sorted hashes of a text's shingles; a text with fewer words than a shingle is one shingle."""
    return np.unique(shingle_hashes(raw or b"", WIDTH))


def parity_map(h: np.ndarray) -> np.ndarray:
    """``_MAP`` longs, each bit the parity of how many of a set's hashes fall on it.

    A shingle that both sets have changes both maps alike, so two maps differ in no more bits than there are shingles that only one set has.
    """
    bits = np.bincount((h >> np.uint64(_BITS)).astype(np.int64) % (64 * _MAP), minlength=64 * _MAP) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _parity_maps(docs: DataFrame, text_col: str, uid: str) -> DataFrame:
    """(uid, map) of each text."""

    def maps(texts: pa.Array) -> pa.Array:
        rows = [parity_map(shingle_set(raw)) for raw in values(texts)]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * _MAP, pa.int32()), pa.array(flat))

    return docs.select(F.col(uid).alias("uid"), arrow_udf(maps, "array<bigint>")(F.coalesce(text_col, F.lit("")).cast("binary")).alias("map"))


def _bucket_counts(docs: DataFrame, text_col: str, uid: str) -> np.ndarray:
    """How many of the sampled texts' shingles fall into each bucket of hashes. Tasks send what they have added up, and sums by bucket meet in Spark."""

    def tally(batches):
        total = np.zeros(1 << _BITS, np.int64)
        for batch in batches:
            for raw in values(batch.column(0)):
                np.add.at(total, (shingle_set(raw) & _MASK).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    some = docs.where(F.pmod(F.xxhash64(uid), F.lit(_SAMPLE)) == 0).select(F.coalesce(text_col, F.lit("")).cast("binary").alias("raw"))
    sums = some.mapInArrow(tally, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** 20 rows
    out = np.zeros(1 << _BITS, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def _prefixes(docs: DataFrame, text_col: str, uid: str) -> DataFrame:
    """Rows (uid, size, at, h, short): the first shingles of each text; ``short`` marks those that a smaller set shows."""
    often = _bucket_counts(docs, text_col, uid)

    def first(texts: pa.Array) -> pa.Array:
        sizes, lists = [], []
        for raw in values(texts):
            h = shingle_set(raw)
            n = len(h)
            order = np.lexsort((h, often[(h & _MASK).astype(np.int64)]))[: n - (4 * n + 4) // 5 + 1]
            sizes.append(n)
            lists.append(h[order].view(np.int64))
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["size", "h"])

    udf = arrow_udf(first, "struct<size:int,h:array<bigint>>")
    rows = docs.select(F.col(uid).alias("uid"), udf(F.coalesce(text_col, F.lit("")).cast("binary")).alias("s"))
    rows = rows.select("uid", "s.size", F.posexplode("s.h").alias("at", "h"))
    return rows.withColumn("short", F.expr("at < size - (8 * size + 8) div 9 + 1"))


def _marked(docs: DataFrame, uid: str, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` whose number is in ``ids(uid)``.

    Numbers are packed into masks of 64. If there are at most ``most`` masks (16 MB) they are broadcast
    and no text is shuffled, else they are joined.
    """
    block, mask = fresh(docs, "block"), fresh(docs, "mask")
    masks = checkpointed(ids.groupBy(F.shiftright("uid", 6).alias(block)).agg(F.expr("bit_or(shiftleft(1L, cast(uid & 63 as int)))").alias(mask)))
    masks = F.broadcast(masks) if masks.count() <= most else masks
    rows = docs.join(masks, F.shiftright(F.col(uid), 6) == F.col(block))
    return rows.where(F.expr(f"getbit(`{mask}`, cast(`{uid}` & 63 as int)) = 1")).drop(block, mask)


def _similar(pairs: DataFrame, docs: DataFrame, text_col: str, uid: str) -> DataFrame:
    """Those of ``pairs(a, b)`` that have similarity 4/5 or more. Texts travel, as they compress better than hashes."""

    def check(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last, x = [], None, None
        for a, b in zip(values(left), values(right), strict=True):
            if a != last:  # rows come in the order of a
                last, x = a, shingle_set(a)
            y = shingle_set(b)
            out.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        return pa.array(out, pa.bool_())

    pairs = checkpointed(pairs)
    texts = _marked(docs, uid, pairs.select(F.explode(F.array("a", "b")).alias("uid")))
    left, right = (texts.select(F.col(uid).alias(c), F.coalesce(text_col, F.lit("")).cast("binary").alias(f"{c}_text")) for c in "ab")
    both = pairs.join(right, "b").join(left, "a")
    return checkpointed(both.where(arrow_udf(check, "boolean")("a_text", "b_text")).select("a", "b"))


def _led(rows: DataFrame, turn: int, most: int = 4) -> DataFrame:
    """(a, b): for each text of ``rows(uid, size, at, h, short, shared, root)`` those ``most`` leaders in other groups that lead most of its shingles.

    A shingle is led by the text that shares most of its shown shingles, moved by a hash from the second ``turn`` on, and by another drawn by hash.
    Which leaders a text takes decides how much the last pass has to do, never the result.
    """
    z = lambda seed: F.xxhash64("uid", F.lit(2 * turn + seed))
    weight = F.col("shared") * (1 + (F.pmod(z(0), F.lit(1000)) / 1000 if turn else F.lit(0.0)))
    lead = lambda order: F.min(F.when(F.col("short"), F.struct(order.alias("z"), z(1).alias("y"), "uid", "size", "at", "root")))
    leaders = rows.groupBy("h").agg(F.array(lead(-weight), lead(z(1).cast("double"))).alias("both")).select("h", F.explode(F.array_distinct("both")).alias("l"))
    leaders = leaders.select("h", F.col("l.uid").alias("lead"), F.col("l.size").alias("lead_size"), F.col("l.at").alias("lead_at"), F.col("l.root").alias("lead_root"))
    near = rows.join(leaders, "h").where("uid <> lead and root <> lead_root and 4 * greatest(size, lead_size) <= 5 * least(size, lead_size) and 9 * least(size - at, lead_size - lead_at) >= 4 * (size + lead_size)")
    # a text has at most two leaders for each shingle that it shows
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("n"), F.xxhash64("uid", "lead"), "lead"))
    taken = near.groupBy("uid", "lead").agg(F.count("*").alias("n")).withColumn("place", place).where(F.col("place") <= most)
    return taken.select(F.least("uid", "lead").alias("a"), F.greatest("uid", "lead").alias("b")).distinct()


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of groups that exist, joined by new links between their members."""
    if roots is None:
        return checkpointed(components(links))
    over = components(links.join(roots, links.a == roots.node, "left").withColumn("a", F.coalesce("root", "a")).drop("node", "root").join(roots, F.col("b") == roots.node, "left").select("a", F.coalesce("root", "b").alias("b")))
    over = checkpointed(over)
    last = over.select(F.col("node").alias("was"), F.col("root").alias("now"))
    every = roots.unionByName(over.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
    return checkpointed(every.join(last, every.root == last.was, "left").select("node", F.coalesce("now", "root").alias("root")))


def similar_groups(docs: DataFrame, text_col: str = "text", uid: str = "uid", turns: int = 2, roots: DataFrame | None = None, extra: int = 6) -> DataFrame:
    """Rows (node, root) of all rows of ``docs`` that a chain of pairs with similarity 4/5 or more ties to another row.

    ``roots(node, root)``, a stored table, are groups that exist already; they are joined by the pairs and stay whole.

    ``docs`` must be a stored table, ``uid`` an own long of each of its rows. Texts without words have no row. ``turns`` passes with
    leaders go before the one over all pairs that are left; their number changes how much work there is, not the result. After one
    pass a crowd of near copies still makes half a million rows in the join over all pairs, after two it does not; up to ``extra`` further ones follow only while more than four pairs a text are left.
    """
    by_shingle = Window.partitionBy("h")
    rows = _prefixes(docs, text_col, uid)
    # only shingles that two texts show, one of them as the smaller
    rows = rows.select("*", F.min("uid").over(by_shingle).alias("lo"), F.max("uid").over(by_shingle).alias("hi"), F.max("short").over(by_shingle).alias("any"))
    met = rows.where("lo < hi and any").select("uid", "size", "at", "h", "short")
    every = met.select("*", F.count("*").over(Window.partitionBy("uid")).cast("int").alias("shared"), F.col("uid").alias("root"))

    def still_open(rows: DataFrame) -> DataFrame:
        """What still stands in two groups."""
        open_ = rows.drop("root").join(roots, rows.uid == roots.node, "left").withColumn("root", F.coalesce("root", "uid")).drop("node")
        return checkpointed(open_.select("*", F.min("root").over(by_shingle).alias("lo"), F.max("root").over(by_shingle).alias("hi")).where("lo < hi").drop("lo", "hi"))

    rest = checkpointed(every) if roots is None else still_open(every)
    for turn in range(turns):
        if (links := _similar(_led(rest, turn), docs, text_col, uid)).isEmpty():
            break
        roots = _joined(roots, links)
        rest = still_open(rest)

    def pairs_left() -> DataFrame:
        # texts that stand in two groups still, with their parity maps: the maps of a pair that has enough in common differ in at most a ninth of its sizes
        ids = checkpointed(rest.select("uid").distinct())
        mapped = rest.join(_parity_maps(_marked(docs, uid, ids), text_col, uid), "uid")
        small, large = (mapped.select(*(F.col(c).alias(f"{c}{k}") for c in mapped.columns)) for k in "xy")
        apart = " + ".join(f"bit_count(mapx[{i}] ^ mapy[{i}])" for i in range(_MAP))
        # the shingles that may still agree after this one must do for what the sizes ask
        met_again = small.where("shortx").join(large, F.expr(f"hx = hy and rootx <> rooty and struct(sizex, uidx) < struct(sizey, uidy) and 4 * sizey <= 5 * sizex and 9 * least(sizex - atx, sizey - aty) >= 4 * (sizex + sizey) and 9 * ({apart}) <= sizex + sizey"))
        return checkpointed(met_again.select(F.col("uidx").alias("a"), F.col("uidy").alias("b")).distinct())

    left, turn = pairs_left(), turns
    # a crowd of near copies: leaders take few pairs a text, and each link they find closes many of those that are left
    while turn < turns + extra and left.count() > 4 * rest.agg(F.count_distinct("uid").alias("n")).first().n:
        if (links := _similar(_led(rest, turn), docs, text_col, uid)).isEmpty():
            break
        roots = _joined(roots, links)
        rest, turn = still_open(rest), turn + 1
        left = pairs_left()
    more = _similar(left, docs, text_col, uid)
    if more.isEmpty():
        return roots if roots is not None else more.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return _joined(roots, more)


def fingerprint_groups(rows: DataFrame, id_col: str, text_col: str, uid: str) -> DataFrame:
    """(node, root): rows whose SimHash fingerprints a chain of links at two bits or fewer ties together; the root is the least number. Stored."""
    near = simhash.near_groups(rows, id_col, text_col, uid=F.col(uid)).select("uid", F.col("root").alias("fp_root"))
    near = checkpointed(near)
    least = near.groupBy("fp_root").agg(F.min("uid").alias("root"), F.max("uid").alias("hi")).where("root < hi").drop("hi")
    return checkpointed(near.join(least, "fp_root").select(F.col("uid").alias("node"), "root"))


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprints: bool = False) -> DataFrame:
    """One row of each group of near copies, that with the smallest id (nulls last, then the first row), with all columns.

    Texts without words have no shingle; they count as equal to each other. With ``fingerprints`` the groups are those of
    :func:`fingerprint_groups`, joined by all pairs with similarity 4/5 or more: no link of either kind is lost.
    """
    uid = fresh(docs, "uid")
    rows = stored(docs, uid)
    roots = similar_groups(rows, text_col, uid, roots=fingerprint_groups(rows, id_col, text_col, uid) if fingerprints else None)
    empty = F.trim(F.translate(F.coalesce(text_col, F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
    at = rows.select(F.col(uid).alias("uid"), F.col(id_col).alias("doc_id"), empty.alias("empty")).join(roots, F.col("uid") == roots.node, "left")
    root = F.when(F.col("empty"), F.lit(-1).cast("long")).otherwise(F.coalesce("root", "uid"))
    first = at.groupBy(root.alias("root")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid")).alias("best"))
    return _marked(rows, uid, first.select(F.col("best.uid").alias("uid"))).select(*(F.col(f"`{c}`") for c in docs.columns))
