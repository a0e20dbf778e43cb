"""Byte-level BPE encoding and decoding by merge replay over a corpus of distinct words.

The texts of a batch form a corpus. Its distinct words (pieces of the split pattern) are
laid out in one array of symbols, and an inverted index leads from each pair that a merge
applies to, by the merge's rank, to the places where it stands. Merges are replayed in
rank order; each touches only its places and the pairs beside them. Every distinct word is
so encoded once, however often it occurs, and its ids are kept for later batches.

There are two forms. :func:`encode` and :func:`round_trip` take a batch for the corpus: nothing is
shuffled, and a word is replayed again by each worker. :func:`encode_corpus` takes the whole
table: its distinct words are dealt out by word, replayed once, and joined back to the texts.

Vocabularies are read from a path, never trained.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import stored, values

#: Words whose ids a Python worker keeps, in two generations of which the older goes first.
KEPT_WORDS = 200_000
#: Texts are split, and their new words replayed together, when they reach so many characters.
_BLOCK_CHARS = 4_000_000
#: Longer words are replayed one symbol at a time; arrays serve the many short ones. Both give the same ids:
#: arrays apply one place of a merge in a word at a time, so their cost grows with the square of a word's length, and they cost too much for few words.
_LONG, _FEW_BYTES = 200, 20_000

#: Fixed value: the split pattern of the byte-level vocabularies.
_KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# the same for texts of ASCII and Latin letters only, where character ranges stand for the properties
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(rf" ?[{_LETTERS}]++|'(?:s|t|re|ve|m|ll|d)| ?[0-9]++| ?[^\s{_LETTERS}0-9]++|\s+(?!\S)|\s+").findall
_NOT_PLAIN = re.compile(r"[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ſ]").search


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that gives all matches of ``pattern`` in a text."""
    general = regex.compile(pattern).findall
    return general if pattern != _KNOWN else lambda text: general(text) if _NOT_PLAIN(text) else _PLAIN(text)


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, splitter(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.joined: dict[tuple[int, int], int | None] = {}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # tokens in a dense order, as keys of pairs
        self.order = {token: k for k, token in enumerate(ranks)}
        self.place = np.zeros(max(ranks.values()) + 1, np.int64)
        self.place[list(ranks.values())] = np.arange(len(ranks))
        self.pairs: tuple[np.ndarray, np.ndarray] | None = None

    def rank_of(self, left: int, right: int) -> int | None:
        """The rank, and id, of the token that two neighbours form; None if there is none."""
        pair = left, right
        if pair not in self.joined:
            if len(self.joined) > 200_000:
                self.joined.clear()
            self.joined[pair] = self.ranks.get(self.token[left] + self.token[right])
        return self.joined[pair]

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, all merges of all words applied in rank order."""
        ends = np.cumsum([len(w) for w in words])
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)].tolist()
        total, rank_of = len(ids), self.rank_of
        after, before = list(range(1, total + 1)), list(range(-1, total - 1))
        word_end = np.repeat(ends, np.diff(ends, prepend=0)).tolist()
        start = 0
        for end in ends.tolist():
            if end > start:
                after[end - 1], before[start] = -1, -1
            start = end
        places: dict[int, list[int]] = defaultdict(list)
        for at in range(total - 1):
            if after[at] >= 0 and (rank := rank_of(ids[at], ids[at + 1])) is not None:
                places[rank].append(at)
        queue = list(places)
        heapq.heapify(queue)
        gone = bytearray(total)
        while queue:
            rank = heapq.heappop(queue)
            wait_until = 0
            waiting = []
            for at in sorted(places.pop(rank, ())):
                if at < wait_until:
                    waiting.append(at)
                    continue
                right = after[at]
                if gone[at] or right < 0 or rank_of(ids[at], ids[right]) != rank:
                    continue
                beyond, prior = after[right], before[at]
                ids[at], after[at], gone[right] = rank, beyond, 1
                if beyond >= 0:
                    before[beyond] = at
                for left, other in ((prior, at), (at, beyond)):
                    if left >= 0 and other >= 0 and (new := rank_of(ids[left], ids[other])) is not None:
                        if new not in places:
                            heapq.heappush(queue, new)
                        places[new].append(left)
                        if new < rank:  # comes first in this word; the word's other places wait
                            wait_until = word_end[at]
            if waiting:
                places[rank] += waiting
                heapq.heappush(queue, rank)
        out, start = [], 0
        for end in ends.tolist():
            out.append([ids[i] for i in range(start, end) if not gone[i]])
            start = end
        return out

    def replay_arrays(self, words: list[bytes]) -> list[bytes]:
        """As :meth:`replay` for many short words: all places of a merge are applied at once, one a word.

        Where a merge stands twice in a word the later place waits for its next turn, so that a
        pair of lower rank that the first one makes goes before it. Ids come as little-endian bytes.
        """
        ends = np.cumsum([len(w) for w in words])
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends, prepend=0))
        after, before = np.arange(1, len(ids) + 1, dtype=np.int32), np.arange(-1, len(ids) - 1, dtype=np.int32)
        after[ends - 1], before[ends - np.diff(ends, prepend=0)] = -1, -1
        rank_at = np.full(len(ids), -1, np.int32)
        at = np.flatnonzero(after >= 0).astype(np.int32)
        rank_at[at] = self.ranks_of(ids[at], ids[at + 1])
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enters places under the ranks of their pairs."""
            own = rank_at[at]
            at, own = at[own >= 0], own[own >= 0]
            if not len(at):
                return
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for rank, start, end in zip(own[np.concatenate([[0], cuts])].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if (held := places.get(rank)) is None:
                    places[rank] = [at[start:end]]
                    heapq.heappush(queue, rank)
                else:
                    held.append(at[start:end])

        note(at)
        while queue:
            rank = heapq.heappop(queue)
            held = places.pop(rank)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[rank_at[at] == rank]
            if len(at) > 1:
                at.sort()
                first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                if not first.all():
                    places[rank] = [np.unique(at[~first])]
                    heapq.heappush(queue, rank)
                    at = at[first]
            elif not len(at):
                continue
            right = after[at]
            beyond, prior = after[right], before[at]
            ids[at], ids[right], rank_at[at], rank_at[right] = rank, -1, -1, -1
            after[at] = beyond
            ahead, behind = beyond >= 0, prior >= 0
            beyond, left, prior, own = beyond[ahead], at[ahead], prior[behind], at[behind]
            before[beyond] = left
            rank_at[left] = self.ranks_of(ids[left], ids[beyond])
            rank_at[prior] = self.ranks_of(ids[prior], ids[own])
            note(np.concatenate([left, prior]))
        live = ids >= 0
        counts = np.bincount(word[live], minlength=len(words))
        flat, stops = ids[live].astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of neighbours merges at, -1 for pairs that do not."""
        if self.pairs is None:
            found = [(a * len(self.token) + b, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (a := self.order.get(token[:k])) is not None and (b := self.order.get(token[k:])) is not None]
            self.pairs = tuple(np.array(x, np.int64) for x in zip(*sorted(found), strict=True)) if found else (np.array([-1]), np.array([-1]))
        codes, ranks = self.pairs
        want = self.place[left] * len(self.token) + self.place[right]
        at = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
        return np.where(codes[at] == want, ranks[at], -1)

    def learn(self, words: list[str]) -> None:
        """Puts the ids of new words into the store: whole tokens at once, the others by replay."""
        short, raws = [], []
        for word in words:
            raw = word.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.kept[word] = whole.to_bytes(4, "little")
            elif len(raw) > _LONG:
                self.kept[word] = np.array(self.replay([raw])[0], "<u4").tobytes()
            else:
                short.append(word)
                raws.append(raw)
        if sum(map(len, raws)) < _FEW_BYTES:
            coded = [np.array(ids, "<u4").tobytes() for ids in self.replay(raws)] if raws else []
        else:
            coded = self.replay_arrays(raws)
        self.kept.update(zip(short, coded, strict=True))

    def encode_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        # a text becomes the numbers of its words in this block
        number: dict[str, int] = defaultdict(count().__next__)
        split: list[np.ndarray] = []
        held = 0
        for text in texts:
            split.append(np.array(list(map(number.__getitem__, self.pieces(text))) if text else [], np.int32))
            held += len(text or "")
            if held >= _BLOCK_CHARS:
                out += self._encode_split(number, split)
                number, split, held = defaultdict(count().__next__), [], 0
        return out + self._encode_split(number, split)

    def _encode_split(self, number: dict[str, int], split: list[np.ndarray]) -> list[bytes]:
        new = number.keys() - self.kept.keys()
        again = new & self.older.keys()
        self.kept.update((w, self.older[w]) for w in again)
        self.learn(sorted(new - again))
        coded = [self.kept[word] for word in number]
        if len(self.kept) > KEPT_WORDS // 2:
            self.older, self.kept = self.kept if len(self.kept) <= KEPT_WORDS else {}, {}
        return [b"".join(map(coded.__getitem__, words.tolist())) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def replayer(path: str, pattern: str) -> MergeReplay:
    """One encoder for each vocabulary and Python worker."""
    return MergeReplay(load_ranks(path), pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text as binary, four little-endian bytes each; empty for null and empty texts.

    Each match of ``pattern`` is encoded separately; no special token is recognised.
    ``path`` must name the same file on every machine. The function is declared as not deterministic,
    although it is, so that a text is encoded once however often its ids are used.
    """

    def udf(texts: pa.Array) -> pa.Array:
        return pa.array(replayer(path, pattern).encode_batch(values(texts)), pa.binary())

    return arrow_udf(udf, "binary").asNondeterministic()(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ids from :func:`encode` stand for; empty for null and empty ids. Unknown ids raise an error."""

    def udf(rows: pa.Array) -> pa.Array:
        known = replayer(path, pattern)
        return pa.array([known.decode(ids or b"") for ids in values(rows)], pa.binary())

    return arrow_udf(udf, "binary")(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """A struct of ``ids``, as :func:`encode` gives them, and ``decoded``, as :func:`decode` gives it from them.

    One call, and so one Python worker with one vocabulary, does both. Null and empty texts have both empty.
    """

    def udf(texts: pa.Array) -> pa.Array:
        known = replayer(path, pattern)
        ids = pa.array(known.encode_batch(values(texts)), pa.binary())
        decoded = pa.array([known.decode(x) for x in values(ids)], pa.binary())
        return pa.StructArray.from_arrays([ids, decoded], ["ids", "decoded"])

    return arrow_udf(udf, "ids binary, decoded binary").asNondeterministic()(text)


def id_count(ids: Column) -> Column:
    return (F.coalesce(F.octet_length(ids), F.lit(0)) / 4).cast("long")


def encode_corpus(docs: DataFrame, path: str, pattern: str, text_col: str = "text", per_block: int = 512) -> DataFrame:
    """``docs`` with ``ids``, as :func:`encode` gives them, each distinct word of the table being replayed once.

    Texts are taken in blocks of ``per_block`` rows of a stored copy. The distinct words of each block are dealt out by word, and a task replays the
    distinct ones it gets, as one corpus with its inverted index, in stretches of a bounded size; ids go back to every block that has
    the word, and blocks are put together there. A task holds a block's texts and words, never the dictionary of the corpus. A word that every
    block has is one row for each block. Null and empty texts have empty ids; repeated rows are encoded each; an
    empty table gives no rows; other columns are carried along unless they are called ids.
    """
    rows = stored(docs.drop("ids"), "_uid").withColumn("_block", F.floor(F.col("_uid") / per_block))

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known, at, found = replayer(path, pattern), None, set()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"_block": pa.array([at] * len(found), pa.int64()), "word": pa.array(sorted(found), pa.string())})

        for batch in batches:
            for block, text in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                if block != at:
                    if found:
                        yield done()
                    at, found = block, set()
                found.update(known.pieces(text or ""))
        if found:
            yield done()

    def replayed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known = replayer(path, pattern)
        for batch in batches:
            # rows come in the order of words, so a word is in one batch or in two that follow each other
            words = batch.column(1).to_pylist()
            new = sorted(set(words) - known.kept.keys())
            known.learn(new)
            yield pa.RecordBatch.from_pydict({"_block": batch.column(0), "word": batch.column(1), "ids": pa.array([known.kept[w] for w in words], pa.binary())})
            known.kept = {words[-1]: known.kept[words[-1]]} if words else {}

    pairs = rows.select("_block", text_col).mapInArrow(distinct, "_block bigint, word string")
    # a block that a scan has split says a word twice
    coded = pairs.repartition("word").sortWithinPartitions("word").mapInArrow(replayed, "_block bigint, word string, ids binary")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("_uid", "_block"))
    kept = [f.name for f in rows.schema.fields if f.name not in ("_uid", "_block")]

    def joined(texts: pa.Table, words: pa.Table) -> pa.Table:
        known = replayer(path, pattern)
        ids = dict(zip(words["word"].to_pylist(), words["ids"].to_pylist(), strict=True))
        coded = [b"".join(map(ids.__getitem__, known.pieces(t))) if t else b"" for t in texts[text_col].to_pylist()]
        return texts.select(kept).append_column("ids", pa.array(coded, pa.binary()))

    words = coded.select(F.col("_block").alias("_b"), "word", "ids")
    return rows.groupBy("_block").cogroup(words.groupBy("_b")).applyInArrow(joined, f"{schema}, ids binary")
