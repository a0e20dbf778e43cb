"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy on labelled spans. It reads a text in overlapping windows
around its trigger characters (digits and ``@``; without one none of the four kinds can
stand there), each window is decoded by Viterbi, and what the windows found is reconciled
over the whole text: a span that an inner window border cuts is read again in a wider window until it
ends inside one, and of overlapping spans those are chosen that cover most together.
Spans of the patterns stay as they are; a tagged span is added if it touches none of them
and passes its kind's own check. The tagger learns forms that the patterns miss (spaced addresses,
dotted cards, national phone numbers) from invented sentences and from windows of the corpus in which such forms are planted.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import values

#: Kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


_LOOSE_EMAIL = re.compile(r"[^@\s]+\s?@\s?[^@\s]+\s?\.\s?[^@\s.]+(\s?\.\s?[^@\s.]+)*")


def valid(kind: str, text: str) -> bool:
    """The check a span of each kind must pass; separators may have spaces beside them, which the patterns do not allow."""
    digits = _digits(text)
    if kind == "ip":
        parts = re.split(r"\s?\.\s?", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return _LOOSE_EMAIL.fullmatch(text) is not None


def _emails(text: str) -> list[Span]:
    """Matches of local part, ``@`` and dotted domain, found from each ``@``: linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        # what the left scan has passed holds no other match
        free = max(free, at)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, leftmost and not overlapping within each kind; failing matches are dropped. By start, then kind."""
    if not text or not _TRIGGER.search(text):
        return []
    out = _emails(text)
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---- the tagger ----

TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, STRIDE = 64, 32
_CLASSES = {c: i for i, c in enumerate("\0@.+-() _%/:,\n\t!#\"'=&")}
_DIGIT, _UPPER, _LOWER, _OTHER = (len(_CLASSES) + i for i in range(4))
_N_CLASSES = len(_CLASSES) + 4


def classes(text: str) -> np.ndarray:
    """A small number for each character: its own for punctuation, else digit, upper, lower or other."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full(len(points), _OTHER, np.int64)
    for low, high, to in (("0", "9", _DIGIT), ("A", "Z", _UPPER), ("a", "z", _LOWER)):
        out[(points >= ord(low)) & (points <= ord(high))] = to
    for c, i in _CLASSES.items():
        out[points == ord(c)] = i
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass(frozen=True)
class Tagger:
    """Weights: for each direction input rows by character class, recurrent and bias; output; CRF transitions, start."""

    p: dict[str, np.ndarray]

    def run(self, x: np.ndarray, way: str, keep: bool = False) -> tuple[np.ndarray, list[tuple]]:
        """Hidden states (time, rows, hidden) of one direction over class numbers (rows, time); with ``keep`` also what its gradient needs."""
        wx, wh = self.p[f"x{way}"], self.p[f"h{way}"]
        n, t, size = len(x), x.shape[1], wh.shape[0]
        h, c = np.zeros((n, size)), np.zeros((n, size))
        states, kept = np.zeros((t, n, size)), []
        for k in range(t) if way == "f" else range(t - 1, -1, -1):
            z = wx[x[:, k]] + h @ wh
            i, f, o = (_sigmoid(z[:, j * size : (j + 1) * size]) for j in range(3))
            g = np.tanh(z[:, 3 * size :])
            new = f * c + i * g
            if keep:
                kept.append((k, h, c, i, f, o, g, new))
            h, c = o * np.tanh(new), new
            states[k] = h
        return states, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(x, "f")[0], self.run(x, "b")[0]], axis=2)
        return both @ self.p["o"] + self.p["ob"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (rows, time) by Viterbi."""
        e = self.emissions(x)
        score, back = self.p["start"] + e[0], []
        for k in range(1, len(e)):
            paths = score[:, :, None] + self.p["trans"]
            back.append(paths.argmax(axis=1).astype(np.int8))
            score = paths.max(axis=1) + e[k]
        tags = [score.argmax(axis=1)]
        for b in reversed(back):
            tags.append(b[np.arange(len(b)), tags[-1]])
        return np.stack(tags[::-1], axis=1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _gradients(model: Tagger, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log likelihood of tags ``y``, by back propagation through CRF and LSTM."""
    p, (n, t) = model.p, x.shape
    (hf, kf), (hb, kb) = model.run(x, "f", True), model.run(x, "b", True)
    both = np.concatenate([hf, hb], axis=2)
    e = both @ p["o"] + p["ob"]
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[0] = p["start"] + e[0]
    for k in range(1, t):
        alpha[k] = _lse(alpha[k - 1][:, :, None] + p["trans"], 1) + e[k]
    for k in range(t - 2, -1, -1):
        beta[k] = _lse(p["trans"] + (e[k + 1] + beta[k + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    de = np.exp(alpha + beta - z[:, None])
    grads = {"start": de[0].sum(axis=0), "trans": np.zeros_like(p["trans"])}
    for k in range(1, t):
        grads["trans"] += np.exp(alpha[k - 1][:, :, None] + p["trans"] + (e[k] + beta[k])[:, None, :] - z[:, None, None]).sum(axis=0)
    rows = np.arange(n)
    np.add.at(grads["start"], y[:, 0], -1)
    for k in range(t):
        de[k][rows, y[:, k]] -= 1
        if k:
            np.add.at(grads["trans"], (y[:, k - 1], y[:, k]), -1)
    grads["o"], grads["ob"] = np.einsum("tnh,tnk->hk", both, de), de.sum(axis=(0, 1))
    dh_all = de @ p["o"].T
    size = p["hf"].shape[0]
    for way, kept, part in (("f", kf, dh_all[:, :, :size]), ("b", kb, dh_all[:, :, size:])):
        gx, gh = np.zeros_like(p[f"x{way}"]), np.zeros_like(p[f"h{way}"])
        dh, dc = np.zeros((n, size)), np.zeros((n, size))
        for k, h, c, i, f, o, g, new in reversed(kept):
            d, th = part[k] + dh, np.tanh(new)
            dc = dc + d * o * (1 - th * th)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), d * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(gx, x[:, k], dz)
            gh += h.T @ dz
            dh, dc = dz @ p[f"h{way}"].T, dc * f
        grads[f"x{way}"], grads[f"h{way}"] = gx, gh
    return {k: v / n for k, v in grads.items()}


def tags_of(spans: list[Span], start: int, end: int) -> np.ndarray:
    out = np.zeros(end - start, np.int64)
    for kind, a, b in spans:
        if a >= start and b <= end:
            out[a - start : b - start] = 2 + 2 * KINDS.index(kind)
            out[a - start] -= 1
    return out


def fit(samples: list[tuple[str, list[Span]]], hidden: int = 20, epochs: int = 16, batch: int = 48, rate: float = 0.03, seed: int = 5) -> Tagger:
    """Trains on (text, spans) pairs, each cut or padded to a window."""
    rng = np.random.default_rng(seed)
    shapes = {w + d: s for d in "fb" for w, s in (("x", (_N_CLASSES, 4 * hidden)), ("h", (hidden, 4 * hidden)))} | {"o": (2 * hidden, len(TAGS))}
    p = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()} | {"ob": np.zeros(len(TAGS)), "trans": np.zeros((len(TAGS),) * 2), "start": np.zeros(len(TAGS))}
    for d in "fb":
        p[f"x{d}"][:, hidden : 2 * hidden] += 1  # forget gates start open
    x = np.stack([classes(t[:WINDOW].ljust(WINDOW, "\0")) for t, _ in samples])
    y = np.stack([tags_of(s, 0, WINDOW) for _, s in samples])
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            step += 1
            own = order[at : at + batch]
            for k, g in _gradients(Tagger(p), x[own], y[own]).items():
                g = np.clip(g, -5, 5)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                p[k] = p[k] - rate * (1 - 0.9 * step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Tagger(p)


def _made(rng: random.Random, missed: bool = False) -> tuple[str, str]:
    """Kind and text of an invented value; with ``missed`` in a form that the patterns do not match, kind "" for a look-alike."""
    word = lambda: "".join(rng.choices("aeinorstlduchmg", k=rng.randrange(2, 9)))
    number = lambda k: "".join(rng.choices("0123456789", k=k))

    def card(gaps: list[str]) -> str:
        d = number(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rng.choice(gaps).join(d[i : i + 4] for i in range(0, 16, 4))

    def email(at: list[str], dots: list[str]) -> str:
        dot = rng.choice(dots)
        local = word() + rng.choice([".", "_", "", "+"] if dot == "." else ["_", ""]) + number(rng.randrange(3))
        return f"{local}{rng.choice(at)}{word()}{rng.choice(['', number(1)])}{dot}{dot.join(rng.choice(['example.com', 'org', 'de', 'co.uk']).split('.'))}"

    def phone(forms: list[str]) -> str:
        return rng.choice(forms).format(number(3), number(3), number(4))

    ip = lambda dot: dot.join(str(rng.randrange(256)) for _ in range(4))
    kind = rng.choice([*KINDS, ""])
    if missed:
        made = {"email": lambda: email([" @ ", "@ ", " @"], [".", " . "]), "ip": lambda: ip(rng.choice([" . ", ". "])), "card": lambda: card([".", " . ", "/", "  "]), "phone": lambda: phone(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}) {} {}", "00{}/{}/{}"])}
    else:
        made = {"email": lambda: email(["@"], ["."]), "ip": lambda: ip("."), "card": lambda: card(["", "", " ", "-"]), "phone": lambda: phone(["+1 ({}) {}-{}", "+{} {} {}", "+49 {} {}{}"])}
    hexes = lambda: "".join(rng.choices("0123456789abcdef", k=rng.randrange(8, 41)))
    made[""] = lambda: rng.choice([number(rng.randrange(1, 7)), number(16), f"{number(1)}.{number(1)}", f'token = "{hexes()}"', f"{word()}@{word()}", f"@{word()}", f"{number(4)}-{number(2)}-{number(2)}", f"{number(1)}.{number(1)}.{number(1)}", f"{number(2)}:{number(2)}", f"{number(3)}, {number(3)}, {number(4)}", word()])
    return kind, made[kind]()


def made_samples(n: int = 480, seed: int = 3, missed: float = 0.5) -> list[tuple[str, list[Span]]]:
    """Invented sentences with labelled spans, a share in forms that the patterns miss, and look-alikes without a label."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeinorstlduchmg", k=rng.randrange(2, 9)))
    out = []
    for _ in range(n):
        kind, value = _made(rng, rng.random() < missed)
        left, right = " ".join(word() for _ in range(rng.randrange(4))), rng.choice(["", ".", ",", "!!", " "]) + " ".join(word() for _ in range(4))
        left += rng.choice([" ", "\n", ": "]) if left else ""
        text = (left + value + right)[:WINDOW]
        out.append((text, [(kind, len(left), len(left) + len(value))] if kind and len(left) + len(value) <= len(text) else []))
    return out


def planted(text: str, seed: int, missed: float = 1.0) -> tuple[str, list[Span]]:
    """``text`` with one invented value put between two of its words, and the value's span (none for a look-alike)."""
    rng = random.Random(seed)
    gaps = [m.start() for m in re.finditer(" ", text)] or [len(text)]
    at = rng.choice(gaps)
    kind, value = _made(rng, rng.random() < missed)
    return f"{text[:at]} {value}{text[at:]}", [(kind, at + 1, at + 1 + len(value))] if kind else []


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a trigger."""
    starts = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        starts.update(s * STRIDE for s in (k - 1, k) if s >= 0)
    return sorted(starts)


def corpus_samples(docs: DataFrame, max_windows: int = 600, held_out_fold: int | None = 0, folds: int = 5) -> list[tuple[str, list[Span]]]:
    """At most ``max_windows`` windows of the corpus, at most one of each text, those with the lowest hashes.

    Half are cut at the patterns' spans or at a trigger, with the patterns' spans as labels;
    into the others, cut in the middle of a text, an invented value is planted. Texts whose
    hash falls into the held-out fold are never read.
    """

    def cut(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        rows = []
        for text, h in zip(values(texts), hashes.to_pylist(), strict=True):
            if h % 2:
                at = max(0, len(text) // 2 - WINDOW)
                part = text[at : at + WINDOW // 2]
                text, spans = planted(part, h, 0.7)
                spans += [s for s in base_spans(text) if all(s[2] <= a or s[1] >= b for _, a, b in spans)]
                at = max(0, min((a for _, a, _ in spans), default=0) - 16)
            else:
                spans = base_spans(text)
                at = max(0, (spans[0][1] if spans else next(iter(windows(text)), 0)) - 20)
            end = at + WINDOW
            rows.append({"text": text[at:end], "spans": [{"kind": k, "a": a - at, "b": b - at} for k, a, b in spans if a >= at and b <= end]})
        return pa.array(rows, pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())])))]))

    udf = arrow_udf(cut, "struct<text:string,spans:array<struct<kind:string,a:bigint,b:bigint>>>")
    hashed = docs.select("text", F.xxhash64("text").alias("h")).where("text is not null")
    if held_out_fold is not None:
        hashed = hashed.where(F.pmod("h", F.lit(folds)) != held_out_fold)
    cuts = hashed.where((F.pmod("h", F.lit(2)) == 1) | F.col("text").rlike("[0-9@]")).select("h", udf("text", "h").alias("c"))
    return [(r.c.text, [(s.kind, s.a, s.b) for s in r.c.spans]) for r in cuts.orderBy("h", "c").limit(max_windows).collect()]


def train(docs: DataFrame, max_windows: int = 600, **options: float) -> Tagger:
    """Fits the tagger to invented sentences and to at most ``max_windows`` short windows of ``docs``. An empty table leaves the invented ones."""
    return fit(made_samples() + corpus_samples(docs, max_windows), **options)


def _tagged(tags: np.ndarray, start: int, text_end: int) -> tuple[list[Span], bool]:
    """Spans of a window's tags, without those that an inner border of the window may have cut, and whether there are any of these."""
    out, cut, k, n = [], False, 0, len(tags)
    while k < n:
        if tags[k] % 2 == 1:
            kind, end = (tags[k] - 1) // 2, k + 1
            while end < n and tags[end] == 2 * kind + 2:
                end += 1
            whole = (k > 0 or start == 0) and (end < n or start + end >= text_end)
            if whole and start + end <= text_end:
                out.append((KINDS[kind], start + k, start + end))
            cut |= not whole
            k = end
        else:
            # a tag that continues a span which began before the window
            cut |= k == 0 and start > 0 and tags[k] > 0
            k += 1
    return out, cut


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _widened(text: str, cuts: list[tuple[int, int]], model: Tagger) -> set[Span]:
    """Spans of the windows in ``cuts``, read again in windows that grow until no span is cut: each time by its own length on both sides."""
    found: set[Span] = set()
    while cuts:
        again = []
        for a, b in _joined([(max(0, a - (b - a) // 2), min(len(text), b + (b - a) // 2)) for a, b in cuts]):
            spans, cut = _tagged(model.decode(classes(text[a:b])[None])[0], a, len(text))
            found.update(spans)
            if cut and (a > 0 or b < len(text)):
                again.append((a, b))
        cuts = again
    return found


def reconcile(spans: set[Span]) -> list[Span]:
    """The spans without overlap that cover most characters together (weighted interval scheduling); ties by start and kind."""
    order = sorted(spans, key=lambda s: (s[2], s[1], KINDS.index(s[0])))
    ends, best, taken = [], [0], []
    for kind, a, b in order:
        at = bisect_right(ends, a)
        gain = best[at] + b - a
        taken.append(at if gain > best[-1] else -1)
        best.append(max(best[-1], gain))
        ends.append(b)
    out, k = [], len(order)
    while k:
        if taken[k - 1] >= 0:
            out.append(order[k - 1])
            k = taken[k - 1]
        else:
            k -= 1
    return out[::-1]


def _bounds(text: str, kind: str, a: int, b: int) -> tuple[int, int]:
    """Spaces and closing punctuation at a tagged span's ends do not belong to it."""
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def find_all(texts: Iterable[str | None], model: Tagger, rows: int = 200, chunk: int = 1024) -> list[list[tuple[str, int, int, bool]]]:
    """All spans (kind, start, end, found by a pattern) of each text, by start and kind; some rows at a time."""
    out, rest = [], iter(texts)
    while part := list(islice(rest, rows)):
        out += _find(part, model, chunk)
    return out


def _find(texts: list[str | None], model: Tagger, chunk: int) -> list[list[tuple[str, int, int, bool]]]:
    jobs = [(i, s) for i, text in enumerate(texts) if text for s in windows(text)]
    found: list[set[Span]] = [set() for _ in texts]
    cuts: list[list[tuple[int, int]]] = [[] for _ in texts]
    for at in range(0, len(jobs), chunk):
        part = jobs[at : at + chunk]
        tags = model.decode(np.stack([classes(texts[i][s : s + WINDOW].ljust(WINDOW, "\0")) for i, s in part]))
        for (i, s), row in zip(part, tags, strict=True):
            if row.any():
                spans, cut = _tagged(row, s, len(texts[i]))
                found[i].update(spans)
                if cut:
                    cuts[i].append((s, min(s + WINDOW, len(texts[i]))))
    out = []
    for text, tagged, cut in zip(texts, found, cuts, strict=True):
        if cut:
            # a window that cuts a span may be beside one that has it whole
            open_ = [(a, b) for a, b in cut if not any(x < b and y > a and (x < a or y > b) for _, x, y in tagged)]
            tagged = tagged | _widened(text, open_, model)
        spans = [(*s, True) for s in base_spans(text or "")]
        taken = sorted((a, b) for _, a, b, _ in spans)
        begins, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        for kind, a, b in reconcile(tagged):
            a, b = _bounds(text, kind, a, b)
            # free if no pattern's span that begins before its end reaches over its start
            before = bisect_left(begins, b)
            if a < b and (not before or reach[before - 1] <= a) and valid(kind, text[a:b]):
                spans.append((kind, a, b, False))
        out.append(sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
    return out


def find_spans(text: Column, model: Tagger) -> Column:
    """Array of (kind, start, end, base) of a whole text of any length, in code points; empty for null and empty texts, the same for repeated rows.

    Spans of one kind and start are ordered by their end; ``base`` marks those of the patterns.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans] for spans in find_all(values(texts), model)], pa.list_(kind))

    return arrow_udf(udf, "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")(text)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])
