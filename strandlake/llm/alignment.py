"""Alignment of two tokenizers over a corpus: minimal groups of tokens, and which ids end together how often.

The tokens that a byte-level BPE (A) and a piece vocabulary (B) make of one text are the two sides of a graph; tokens
whose bytes overlap are joined. Union-find over its edges gives the connected components: they are exactly the minimal
groups that cover the same bytes on both sides. A group's members give its links, the pairs of
tokens that end together. Pairs of ids are counted over the corpus, and every link is told how often its pair occurs.

Both tokenizers cut a text between a character that is not white space and a space. What lies between two such
places, a unit, has the same tokens wherever it stands, so each worker aligns the distinct units of its batches, many at a
time in flat arrays. Documents are stored in blocks that share a list of their distinct pairs; only these lists
are joined with the corpus's counts, and no link of a document is ever a row of its own.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_rounds import KEPT_BYTES, KEPT_WORDS, RoundBPE, rounds_of
from .common import checkpointed, shared_dir, values

#: A pair of ids is one long: that of A in the high bits, that of B in the low ones.
ID_BITS = 24
#: Documents of a block: they have so many characters or rows at most, a longer text is a block of its own.
BLOCK_CHARS, BLOCK_ROWS = 1_000_000, 256
_SPACE = "▁"
_UNITS = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*)?|\s+")


def overlap_groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of two sequences that cover the same bytes, given where their tokens end: numbers that ascend with the text.

    Every stretch between neighbouring ends is an edge from the token of A over it to that of B. Union-find for all edges
    at once: of two roots that an edge joins the larger hangs itself on the smaller, then all paths are halved, until no edge joins two roots.
    """
    stops = np.union1d(a_ends, b_ends)
    left, right = np.searchsorted(a_ends, stops), np.searchsorted(b_ends, stops)
    n = len(a_ends)
    # nodes are numbered by where they end, so that parents are smaller and groups ascend
    number = np.empty(n + len(b_ends), np.int64)
    number[np.argsort(np.concatenate([a_ends, b_ends]), kind="stable")] = np.arange(len(number))
    parent = np.arange(len(number))
    x, y = number[left], number[n + right]
    while len(x):
        x, y = parent[x], parent[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    _, group = np.unique(parent[number], return_inverse=True)
    return group[:n], group[n:]


class Units:
    """The aligned units that a Python worker keeps, each as (A ids, B ids, told groups, packed pairs); None where the sides' bytes differ."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a: RoundBPE = rounds_of(a_path, added=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.a_length = np.zeros(max(self.a.bytes_of) + 1, np.int64)
        for k, raw in self.a.bytes_of.items():
            self.a_length[k] = len(raw)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        if max(len(self.a_length), len(self.b_length)) > 1 << ID_BITS:
            raise ValueError("too many ids for a packed pair")
        # how an id is told inside a group, and at the end of its side of a group
        self.told = [f"{k}{end}" for n, ends in ((len(self.a_length), ",|"), (len(self.b_length), ",;")) for end in ends for k in range(n)]
        # a piece with a space behind another character would reach over the end of a unit
        self.whole = any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.kept: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        self.kept_bytes = 0

    def units(self, text: str) -> list[str]:
        """The units of a text with a space before it; the first one starts with that space."""
        return [f" {text}"] if self.whole else _UNITS.findall(f" {text}")

    def learn(self, units: set[str]) -> None:
        new = units - self.kept.keys()
        again = new & self.older.keys()
        self.kept.update((u, self.older[u]) for u in again)
        self.kept_bytes += sum(map(len, new))
        held: list[str] = []
        size = 0
        for unit in new - again:
            if self.whole or unit[-1].isspace() or _SPACE in unit:
                self._align([unit])  # more of the text behind it could change its tokens
                continue
            held.append(unit)
            size += len(unit)
            if size >= BLOCK_CHARS:
                self._align(held)
                held, size = [], 0
        if held:
            self._align(held)

    def age(self) -> None:
        """Lets the older generation go when the younger has grown."""
        if len(self.kept) > KEPT_WORDS // 2 or self.kept_bytes > KEPT_BYTES // 4:
            fits = len(self.kept) <= KEPT_WORDS and self.kept_bytes <= KEPT_BYTES // 2
            self.older, self.kept, self.kept_bytes = self.kept if fits else {}, {}, 0

    def _align(self, units: list[str]) -> None:
        """Aligns units as one text: their tokens are the same as in any other."""
        text = "".join(units)
        a = np.frombuffer(self.a.encode_batch([text])[0], "<i4").astype(np.int64)
        # the space that B puts before a text stands for the first one here; an empty text would get none
        b = np.array(self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.b.piece_to_id(_SPACE)], np.int64)
        if _SPACE in text or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != text.encode():
            if len(units) == 1:
                self.kept[units[0]] = None
            else:
                for unit in units:
                    self._align([unit])
            return
        a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        a_group, b_group = overlap_groups(a_ends, b_ends)
        # the last members of a group end together, and no others do
        a_last, b_last = (np.append(g[1:] != g[:-1], True) for g in (a_group, b_group))
        pairs = a[a_last] << ID_BITS | b[b_last]
        size_a, size_b = len(self.a_length), len(self.b_length)
        codes = np.concatenate([a + size_a * a_last, b + 2 * size_a + size_b * b_last])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        told = list(map(self.told.__getitem__, codes[order].tolist()))
        ends = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in units])
        # a unit ends with a token on both sides, and with a group
        n_a, n_b, n_pairs = np.searchsorted(a_ends, ends) + 1, np.searchsorted(b_ends, ends) + 1, np.searchsorted(a_ends[a_last], ends) + 1
        data = pairs.tobytes()
        cuts = zip(units, *(x.tolist() for y in (n_a, n_b, n_pairs) for x in (np.append(0, y[:-1]), y)), strict=True)
        self.kept.update((u, (a1 - a0, b1 - b0, "".join(told[a0 + b0 : a1 + b1]), data[8 * p0 : 8 * p1])) for u, a0, a1, b0, b1, p0, p1 in cuts)


@functools.lru_cache(maxsize=2)
def units_of(a_path: str, b_path: str) -> Units:
    return Units(a_path, b_path)


_STORED = "block bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, at array<int>, times array<int>, pairs array<bigint>"


def _blocks(texts: Iterable[tuple[object, str | None]]) -> Iterator[list[tuple[object, str]]]:
    held: list[tuple[object, str]] = []
    size = 0
    for key, text in texts:
        if held and (size + len(text or "") > BLOCK_CHARS or len(held) == BLOCK_ROWS):
            yield held
            held, size = [], 0
        held.append((key, text or ""))
        size += len(text or "")
    if held:
        yield held


def _aligned_block(known: Units, block: int, rows: list[tuple[object, str]], digest: bool) -> pa.RecordBatch:
    """The rows of a block's documents, and one before them with the block's distinct pairs and how often each stands there."""
    split = [known.units(text) if text else [] for _, text in rows]
    distinct = list(set().union(*split))
    known.learn(set(distinct))
    found = [known.kept[u] for u in distinct]
    unsound = {u for u, x in zip(distinct, found, strict=True) if x is None}
    if unsound:
        split = [[] if unsound.intersection(units) else units for units in split]
        found = [x or (0, 0, "", b"") for x in found]
    known.age()
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    unit = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in split])
    told = [x[2] for x in found]
    texts, at = [], 0
    for units in split:
        text = "".join(map(told.__getitem__, unit[at : at + len(units)].tolist()))[:-1]
        texts.append(hashlib.sha256(text.encode()).hexdigest() if digest and text else text)
        at += len(units)
    total = lambda k: pa.array([None, *np.bincount(doc, np.array([x[k] for x in found], np.int64)[unit], len(rows)).astype(np.int64).tolist()], pa.int64())
    pairs, place = np.unique(np.frombuffer(b"".join(x[3] for x in found), np.int64), return_inverse=True)
    n = np.array([len(x[3]) // 8 for x in found], np.int64)
    first, size = (np.cumsum(n) - n)[unit], n[unit]
    # the pairs of all units in order: runs of places, one after the other
    link = place[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    each, times = np.unique(np.repeat(doc, size) * max(len(pairs), 1) + link, return_counts=True)
    own, link = np.divmod(each, max(len(pairs), 1))
    here = np.bincount(link, times, len(pairs)).astype(np.int64)
    pairs, link = pairs[here > 0], (np.cumsum(here > 0) - 1)[link] if len(pairs) else link
    here = here[here > 0]
    ends = np.cumsum([0, len(here), *np.bincount(own, minlength=len(rows))])
    lists = lambda head, rest, ends, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([head, rest]).astype(kind)))
    only = np.append(0, np.full(len(rows) + 1, len(pairs)))
    groups = pa.array([None, *np.bincount(own, times, len(rows)).astype(np.int64).tolist()], pa.int64())
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block] * (len(rows) + 1), pa.int64()), "id": pa.array([None, *(k for k, _ in rows)], pa.int64()), "n_a": total(0), "n_b": total(1), "n_groups": groups,
        "groups": pa.array([None, *texts], pa.string()), "at": lists(np.zeros(0), link, np.append(0, ends[1:] - len(here)), np.int32), "times": lists(here, times, ends, np.int32), "pairs": lists(pairs, [], only, np.int64),
    })


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row for each document and one for each block of documents, by which the links of the documents are packed.

    A document has its ``id``, the numbers of tokens ``n_a`` and ``n_b``, ``n_groups``, ``groups`` as text (``a1,a2|b1;a3|b2``, or its SHA-256 if ``digest``) and
    its links: ``times`` how often it has the pair at place ``at`` of its block's ``pairs``. The row of a block has no counts of tokens.
    A is given a space and the text, B the text, to which it adds the space. Special tokens are plain text. Null and empty texts, and those
    whose bytes do not come back from both sides, have no tokens. Repeated rows and null ids are aligned each; an empty table gives no rows. Other columns are not read.
    """

    def udf(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units_of(a_path, b_path)
        first = TaskContext.get().partitionId() << 32
        texts = ((k, t) for batch in batches for k, t in zip(values(batch.column(0)), values(batch.column(1)), strict=True))
        for k, rows in enumerate(_blocks(texts)):
            yield _aligned_block(known, first + k, rows, digest)

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(udf, _STORED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Rows (pair, count, best) from the rows of :func:`aligned`: how many links hold the pair, and whether no other pair of its B id has more."""
    each = blocks.where("n_a is null").select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = checkpointed(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count")))
    b = F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    return counts.withColumn("b", b).join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def token_map(blocks: DataFrame) -> DataFrame:
    """Rows (a_id, b_id, count, best): the ids that end together in the corpus; the best rows of a B id say which of A's ids stand in for it."""
    ids = {"a_id": F.shiftright("pair", ID_BITS).cast("int"), "b_id": F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")}
    return pair_counts(blocks).select(*(c.alias(n) for n, c in ids.items()), "count", "best")


def link_statistics(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each document, as :func:`aligned` reads them.

    ``n_best`` links have a pair that no other of its B id outnumbers (ties included); ``count_sum`` adds up the corpus's counts of the
    pairs of all links. Texts are tokenized once: their rows are written to the shared folder and read from there.
    """
    blocks = checkpointed(aligned(docs, a_path, b_path, id_col, text_col, digest=True))
    pairs = blocks.where("n_a is null").select("block", F.posexplode("pairs").alias("at", "pair"))
    known = pairs.join(pair_counts(blocks), "pair").select(F.col("block").alias("_b"), "at", "count", "best")

    def told(rows: pa.Table, counts: pa.Table) -> pa.Table:
        n = np.zeros(len(counts), np.int64)
        best = np.zeros(len(counts), bool)
        at = counts["at"].to_numpy()
        n[at], best[at] = counts["count"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
        places, times = rows["at"].combine_chunks(), rows["times"].combine_chunks()
        ends = places.offsets.to_numpy() - places.offsets[0].as_py()
        flat, by = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        add = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
        out = {c: rows[c] for c in ("id", "n_a", "n_b", "n_groups")}
        out |= {"n_links": pa.array(add(by)), "n_best": pa.array(add(by * best[flat])), "count_sum": pa.array(add(by * n[flat])), "groups_sha256": rows["groups"]}
        return pa.table(out)

    schema = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    texts = blocks.where("n_a is not null").drop("pairs")
    return texts.groupBy("block").cogroup(known.groupBy("_b")).applyInArrow(told, schema)
