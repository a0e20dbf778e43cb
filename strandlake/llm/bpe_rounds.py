"""BPE encoding and decoding in batched numpy rounds, for vocabularies given as a list of merges.

The new words of a batch lie in one flat array of symbols. In each round every word merges
all places of its lowest-ranked pair at once; the rank and the outcome of a pair are found by
binary search over the sorted keys of all mergeable pairs. Words that have no pair left leave the array.
A word longer than twice the longest token merges in the same round every place whose rank
is the lowest within that token's length: merges further away cannot reach it before its turn,
since a merge only makes pairs of later ranks and a token never grows longer. Where one pair
stands again and again, as in a run of one letter, its first place decides for all. So the
rounds of a very long word do not grow with its length.

Vocabularies are files of the tokenizers library, read from a path and never trained.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from .bpe import _KNOWN, _NOT_PLAIN, splitter
from .common import values

#: Words and bytes of words whose ids a Python worker keeps, in two generations of which the older goes first.
KEPT_WORDS, KEPT_BYTES = 200_000, 20_000_000
#: New words are merged together when they reach so many bytes.
_ROUND_BYTES = 2_000_000
_NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, others = {b: chr(b) for b in plain}, iter(range(0x100, 0x200))
    return [letters.get(b) or chr(next(others)) for b in range(256)]


class PairTable:
    """Rank and outcome of every mergeable pair, found by binary search over sorted keys ``left * size + right``."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, size: int):
        keys = left.astype(np.int64) * size + right
        order = np.argsort(keys, kind="stable")
        self.size, self.keys = size, np.append(keys[order], _NEVER)
        self.ranks, self.made = np.append(order, _NEVER), made.astype(np.int64)
        # a merge must come after all merges that make its parts: only then do the places of one rank not disturb each other
        last = np.full(size, -1, np.int64)
        np.maximum.at(last, made, np.arange(len(made)))
        if len(made) and (np.maximum(last[left], last[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge stands before one that makes its parts")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a number beyond all ranks."""
        want = left * self.size + right
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.ranks[at], _NEVER)


def _window_least(ranks: np.ndarray, reach: int) -> np.ndarray:
    """The least of each value and its ``reach`` neighbours on either side, by running minima from the edges of blocks."""
    width = 2 * reach + 1
    padded = np.full(-(-(len(ranks) + 2 * reach) // width) * width + width, _NEVER)
    padded[reach : reach + len(ranks)] = ranks
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: len(ranks)], ahead[width - 1 : width - 1 + len(ranks)])


def merge_rounds(symbols: np.ndarray, starts: np.ndarray, pairs: PairTable, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the words of ``symbols`` that begin at ``starts`` (none is empty) to the end; ids in order and where each word starts among them.

    ``reach`` is the length of the longest token in symbols. Words over twice that long must come alone.
    """
    n_words = len(starts)
    symbols = symbols.astype(np.int64)
    word = np.repeat(np.arange(n_words), np.diff(starts, append=len(symbols)))
    alone = n_words == 1 and len(symbols) > 2 * reach
    done: list[tuple[np.ndarray, np.ndarray]] = []
    last = np.append(word[1:] != word[:-1], True)
    ranks = np.full(len(symbols), _NEVER)
    inner = np.flatnonzero(~last)
    ranks[inner] = pairs.rank(symbols[inner], symbols[inner + 1])
    while len(symbols):
        begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = _window_least(ranks, reach) if alone else np.repeat(np.minimum.reduceat(ranks, begins), np.diff(begins, append=len(symbols)))
        hit = (ranks == least) & (ranks < _NEVER)
        if not alone or not hit.any():
            over = least == _NEVER if not alone else np.ones(len(symbols), bool)
            if over.any():
                done.append((word[over], symbols[over]))
                symbols, word, ranks, hit = symbols[~over], word[~over], ranks[~over], hit[~over]
                if not len(symbols):
                    break
        # of places of one rank that touch, and so are one pair of one symbol, every second goes from the left on;
        # none goes while the first of them may still lose its symbol to a merge on its left
        first = np.maximum.accumulate(np.where(np.append(True, ranks[1:] != ranks[:-1]), np.arange(len(ranks)), 0))
        at = np.flatnonzero(hit & hit[first])
        at = at[(at - first[at]) % 2 == 0]
        symbols[at] = pairs.made[ranks[at]]
        ranks[at] = _NEVER  # places that need a new rank
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = at - np.arange(len(at))  # where the new symbols stand when the others are gone
        symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
        new = np.zeros(len(symbols) + 1, bool)  # places whose pair is another now; the last one takes what stands before the first symbol
        new[moved] = new[moved - 1] = True
        again = np.flatnonzero(new[:-1])
        beside = again[again + 1 < len(symbols)]
        ranks[again] = _NEVER
        beside = beside[word[beside] == word[beside + 1]]
        ranks[beside] = pairs.rank(symbols[beside], symbols[beside + 1])
    word, symbols = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(word, kind="stable")
    return symbols[order], np.searchsorted(word[order], np.arange(n_words))


class RoundBPE:
    """Encoder and decoder of one byte-level vocabulary. Added tokens are found in texts first, unless ``added`` is false."""

    def __init__(self, path: str, added: bool = True):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = ("continuing_subword_prefix", "end_of_word_suffix", "unk_token", "dropout", "ignore_merges", "byte_fallback")
        if model["type"] != "BPE" or any(model.get(k) for k in plain) or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or spec["normalizer"]:
            raise ValueError("only plain byte-level vocabularies can be read")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with rules of their own cannot be read")
        vocab = model["vocab"]
        parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, t)) if set(t) <= byte_of.keys() else t.encode() for t, i in vocab.items()}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.single = np.array([vocab[c] for c in letters], np.int64)
        number = lambda k: np.array([vocab[m[k]] for m in parts], np.int64)
        self.pairs = PairTable(number(0), number(1), np.array([vocab[a + b] for a, b in parts], np.int64), max(self.bytes_of) + 1)
        self.reach = max(map(len, self.bytes_of.values()))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]} if added else {}
        # leftmost, and of those that begin together the longest
        self.find_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.simple, self.general = splitter(_KNOWN), None
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept_bytes = 0

    def words(self, text: str) -> list[str]:
        """The words of a text. Characters beyond Latin letters are split by the library, whose Unicode tables the vocabulary goes with."""
        if not _NOT_PLAIN(text):
            return self.simple(text)
        if self.general is None:
            from tokenizers import pre_tokenizers

            self.general = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        return [text[a:b] for _, (a, b) in self.general(text)]

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of words, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        raws = [w.encode() for w in words]

        def rounds(chosen: list[int]) -> None:
            flat = self.single[np.frombuffer(b"".join(raws[k] for k in chosen), np.uint8)]
            ids, starts = merge_rounds(flat, np.cumsum([0, *(len(raws[k]) for k in chosen[:-1])]), self.pairs, self.reach)
            data, cuts = ids.astype("<i4").tobytes(), (4 * np.append(starts, len(ids))).tolist()
            for k, a, b in zip(chosen, cuts, cuts[1:], strict=False):
                out[k] = data[a:b]

        held, size = [], 0
        for k, raw in enumerate(raws):
            if len(raw) > 2 * self.reach:
                rounds([k])
            elif raw:
                held.append(k)
                size += len(raw)
                if size >= _ROUND_BYTES:
                    rounds(held)
                    held, size = [], 0
        if held:
            rounds(held)
        return out

    def learn(self, words: set[str]) -> None:
        """Puts the ids of words into the store."""
        new = words - self.kept.keys()
        again = new & self.older.keys()
        self.kept.update((w, self.older[w]) for w in again)
        self.kept_bytes += sum(map(len, new))
        new = sorted(new - again)
        self.kept.update(zip(new, self.merge(new), strict=True))

    def age(self) -> None:
        """Lets the older generation go when the younger has grown; to be called when no ids of the store are needed."""
        if len(self.kept) > KEPT_WORDS // 2 or self.kept_bytes > KEPT_BYTES // 2:
            fits = len(self.kept) <= KEPT_WORDS and self.kept_bytes <= KEPT_BYTES
            self.older, self.kept, self.kept_bytes = self.kept if fits else {}, {}, 0

    def encode_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        split: list[list[list[str]]] = []  # the stretches of each text between added tokens: an odd one is an added token
        new: set[str] = set()
        held = 0

        def told() -> None:
            nonlocal split, held
            self.learn(new)
            coded = self.kept.__getitem__
            for stretches in split:
                parts = [b"".join(map(coded, words)) if k % 2 == 0 else self.added[words[0]].to_bytes(4, "little") for k, words in enumerate(stretches)]
                out.append(parts[0] if len(parts) == 1 else b"".join(parts))
            self.age()
            new.clear()
            split, held = [], 0

        for text in texts:
            if not text or not self.find_added or not self.find_added.search(text):
                stretches = [self.words(text) if text else []]
            else:
                stretches = [[part] if k % 2 else self.words(part) for k, part in enumerate(self.find_added.split(text))]
            for words in stretches[::2]:
                new.update(words)
            split.append(stretches)
            held += len(text or "")
            if held >= _ROUND_BYTES:
                told()
        told()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, all bytes being joined first; what is not UTF-8 becomes U+FFFD. Unknown ids are left out, as the library does."""
        got = self.bytes_of.get
        return b"".join([got(i, b"") for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def rounds_of(path: str, added: bool = True) -> RoundBPE:
    """One encoder for each vocabulary and Python worker."""
    return RoundBPE(path, added)


def _id_lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(rows), "<i4"))).cast(pa.list_(pa.int32()))


def _by_rows(make: Callable[[list], pa.Array], column: pa.Array, rows: int = 200) -> pa.Array:
    parts = [make(column.slice(k, rows).to_pylist()) for k in range(0, max(len(column), 1), rows)]
    return pa.concat_arrays(parts)


def encode_words(text: Column, path: str, added: bool = True) -> Column:
    """Ids of a text as ``array<int>``, as the tokenizers library gives them without the tokens of a template; empty for null and empty texts.

    Added tokens (end-of-text marks) that stand in a text are one id, or plain text if ``added`` is false. ``path`` must name
    the same file on every machine. Declared as not deterministic, although it is, so that a text is encoded once.
    """

    def udf(texts: pa.Array) -> pa.Array:
        known = rounds_of(path, added)
        return _by_rows(lambda some: _id_lists(known.encode_batch(some)), texts)

    return arrow_udf(udf, "array<int>").asNondeterministic()(text)


def decode_words(ids: Column, path: str) -> Column:
    """The text that ids stand for, added tokens included; empty for null and empty lists. Ids outside the vocabulary are left out."""

    def udf(rows: pa.Array) -> pa.Array:
        known = rounds_of(path)
        return pa.array([known.decode(x or ()) for x in values(rows)], pa.string())

    return arrow_udf(udf, "string")(ids)


def word_round_trip(text: Column, path: str) -> Column:
    """A struct of ``ids``, as :func:`encode_words` gives them, and ``decoded``, their text again, by one Python worker.

    Null and empty texts have both empty; repeated rows are coded each; there are no ties, since of places of one rank the left one goes first.
    """

    def udf(texts: pa.Array) -> pa.Array:
        known = rounds_of(path)

        def both(some: list) -> pa.Array:
            rows = known.encode_batch(some)
            decoded = pa.array([known.decode(np.frombuffer(r, "<i4").tolist()) for r in rows], pa.string())
            return pa.StructArray.from_arrays([_id_lists(rows), decoded], ["ids", "decoded"])

        return _by_rows(both, texts)

    return arrow_udf(udf, "ids array<int>, decoded string").asNondeterministic()(text)
