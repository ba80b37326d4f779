"""Toxicity by noisy-channel deobfuscation.

A suspicious token (leetspeak, repeated letters, separators between letters) and letters or
pieces of words spaced out over tokens become a lattice: each character may stand for itself
or, at a cost, for the letters it imitates, a separator may be dropped, a run of one character
may be shorter, a space may be kept as the end of a word or be dropped. A character trigram
model trained on the labelled texts weighs the paths, and Viterbi decoding gives the restored words.
Tokens with a single path are taken as they are, which is what decoding would give. Marks at
the ends of a token may be letters or not: it is read with and without them. Restored words
and their prefixes carry weights: lower confidence bounds of their log odds in labelled toxic
against clean documents. A document is as toxic as its worst word, on a logistic scale fitted
across two halves of the labelled texts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_slices, distinct, fresh, give_back, slices, tokens

#: Words whose weight a worker remembers; letters of a token that may be a piece of a word.
MEMO, PIECE = 200_000, 4
#: Letters of the longest word looked for inside a run of spaced letters; cost (nats) of keeping a space in it.
LONGEST, KEEP_COST = 20, 2.0
#: Prefix lengths that are features beside the whole word; documents a feature needs; the confidence bound's width.
PREFIXES, MIN_DOCS, WIDTH = (4, 5, 6), 3, 1.0
#: Costs (nats) of imitation, dropped separators and shortened runs.
LEET_COST, DROP_COST, RUN_COST = 1.5, 0.7, 0.7

# What characters of leetspeak stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "[": "c", "#": "h", "*": "aeiou",
    "€": "e", "£": "l", "¥": "y", "§": "s", "µ": "u", "&": "a", "%": "o",
}
PAIRS = {"vv": "w", "\\/": "v", "|<": "k", "()": "o", "[]": "o", "|)": "d", "|3": "b", "/\\": "a", "ph": "f", "|_": "l"}
_MANY = set(LEET) | {pair[0] for pair in PAIRS}
SEPARATORS = set(".-_*~'`^/\\|+=,:;")
_QUOTES = "\"'“”„«»¿¡.,;:?"
_MARKS = _QUOTES + "()[]{}<>*_~`-!"
_SUSPECT = re.compile(r"[\d@$!|+(<{\[#*€£¥§µ&%.\-_~'`^/\\=,:;]|(.)\1\1|vv|ph", re.S)


def trimmed(word: str) -> str:
    """The word without quotes, punctuation and runs of three or more of a symbol at its ends."""
    while True:
        word, before = word.strip(_MARKS), word
        if len(word) > 3 and word[-1] == word[-2] == word[-3] and not word[-1].isalnum():
            word = word.rstrip(word[-1])
        if len(word) > 3 and word[0] == word[1] == word[2] and not word[0].isalnum():
            word = word.lstrip(word[0])
        if word == before:
            return word


@dataclass
class CharModel:
    """Interpolated character trigrams over words framed by ^^ and $."""

    tri: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.context: Counter = Counter()
        self.bi: Counter = Counter()
        self.uni: Counter = Counter()
        for t, n in self.tri.items():
            self.context[t[:2]] += n
            self.bi[t[1:]] += n
            self.uni[t[2]] += n
        self.left: Counter = Counter()
        for t, n in self.bi.items():
            self.left[t[0]] += n
        self.total = sum(self.uni.values()) or 1
        self.memo: dict[str, float] = {}

    def cost(self, gram: str) -> float:
        """-log p(third character | first two)."""
        found = self.memo.get(gram)
        if found is None:
            p1 = (self.uni[gram[2]] + 0.1) / (self.total + 0.1 * 512)
            n2, n3 = self.left[gram[1]], self.context[gram[:2]]
            p2 = (self.bi[gram[1:]] + 5 * p1) / (n2 + 5)
            p3 = (self.tri.get(gram, 0) + 5 * p2) / (n3 + 5)
            if len(self.memo) > 500_000:
                self.memo.clear()
            found = self.memo[gram] = -math.log(p3)
        return found


def arcs(text: str, i: int) -> list[tuple[int, str, float]]:
    """(characters taken, letters given, cost) of the arcs that leave position i; a space given is the end of a word."""
    c = text[i]
    if c == " ":
        return [(1, "", 0.0), (1, " ", KEEP_COST)]
    out = [(1, c, 0.0)]
    out += [(1, x, LEET_COST) for x in LEET.get(c, "")]
    if text[i : i + 2] in PAIRS:
        out.append((2, PAIRS[text[i : i + 2]], LEET_COST))
    if c in SEPARATORS:
        out.append((1, "", DROP_COST))
    if (i == 0 or text[i - 1] != c) and text[i : i + 3] == c * 3:
        run = 3
        while i + run < len(text) and text[i + run] == c:
            run += 1
        for x in {c if c.isalpha() else "", *LEET.get(c, "")} - {""}:
            base = RUN_COST + (LEET_COST if x != c else 0.0)
            out += [(run, x, base), (run, x * 2, base)]
    return out


def decode(text: str, model: CharModel) -> str:
    """The cheapest reading of text, in words: Viterbi over lattice positions with the last two letters as state.

    Time is in proportion to the length of the text.
    """
    n = len(text)
    states: list[dict[str, tuple[float, int, str, str]]] = [{} for _ in range(n + 1)]
    states[0]["^^"] = (0.0, -1, "", "")
    cost, known = model.cost, model.memo.get
    for i in range(n):
        if not states[i]:
            continue
        c = text[i]
        if c.isalpha() and c not in _MANY and text[i + 1 : i + 2] != c:  # only itself
            goal = states[i + 1]
            for state, (so_far, *_) in states[i].items():
                gram = state + c
                now, to = so_far + (known(gram) or cost(gram)), gram[1:]
                if to not in goal or now < goal[to][0]:
                    goal[to] = (now, i, state, c)
            continue
        leaving = arcs(text, i)
        for state, (so_far, *_) in states[i].items():
            for taken, letters, price in leaving:
                now, to = so_far + price, state
                if letters == " ":
                    if state == "^^":
                        continue
                    now, to = now + cost(state + "$"), "^^"
                else:
                    for x in letters:
                        gram = to + x
                        now += known(gram) or cost(gram)
                        to = gram[1:]
                goal = states[i + taken]
                if to not in goal or now < goal[to][0]:
                    goal[to] = (now, i, state, letters)
    if not states[n]:
        return text
    state = min(states[n], key=lambda s: (states[n][s][0] + (cost(s + "$") if s != "^^" else 0.0), s))
    at, parts = n, []
    while at > 0:
        _, back, before, letters = states[at][state]
        parts.append(letters)
        at, state = back, before
    return "".join(reversed(parts))


def readings(word: str, model: CharModel) -> list[str]:
    """A token in lower case, restored: without the marks at its ends and, where those may be letters, with them."""
    raw = word.strip(_QUOTES)
    if raw.isalpha() and not _SUSPECT.search(raw):
        return [raw]  # what the lines below would give
    bare = trimmed(word)
    out = [trimmed(decode(bare, model)) if len(bare) > 1 and _SUSPECT.search(bare) else bare]
    if raw != bare and len(raw) > 2 and _SUSPECT.search(raw):
        out.append(trimmed(decode(raw, model)))
    return out


def features(word: str) -> list[str]:
    """The restored word and its prefixes."""
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)] if len(word) > 1 else []


@cache
def _letters() -> np.ndarray:
    """Whether str.isalpha holds, by code point; made once a worker."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words in a row, the number of each word's)."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    text = words.buffers()[2][offsets[0] : offsets[-1]].to_pybytes().decode() if offsets[-1] > offsets[0] else ""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def shape(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each word whether str.isalpha holds, and whether besides nothing in it is suspicious: _SUSPECT, by arrays."""
    at, sizes = points(words)
    row = np.repeat(np.arange(len(sizes)), sizes)
    odd, marked = np.zeros((2, len(sizes)), bool)
    odd[row[~_letters()[at]]] = True
    alpha = ~odd & (sizes > 0)
    near = row[1:] == row[:-1]
    twice = near & (at[1:] == at[:-1])
    marked[row[2:][twice[1:] & twice[:-1]]] = True
    marked[row[1:][twice & (at[1:] == ord("v")) | near & (at[:-1] == ord("p")) & (at[1:] == ord("h"))]] = True
    marked[row[at == ord("µ")]] = True  # the one suspicious character that is a letter
    return alpha, alpha & ~marked


class Texts:
    """Lower-cased texts by their words: counts and codes by text, the distinct words, and the runs of spaced letters (text, run)."""

    def __init__(self, texts: pa.Array) -> None:
        self.counts, self.codes, self.words = tokens(pc.utf8_lower(fresh(texts)), lower=False)
        self.rows = np.repeat(np.arange(len(self.counts)), self.counts)

    @cached_property
    def raw(self) -> pa.Array:
        return pc.utf8_trim(self.words, characters=_QUOTES)

    @cached_property
    def bare(self) -> pa.Array:
        """The words without quotes, as they are where nothing else is in them."""
        return pc.if_else(pc.equal(self.raw, ""), self.words, self.raw)

    @cached_property
    def lengths(self) -> np.ndarray:
        return pc.utf8_length(self.bare).to_numpy(zero_copy_only=False)[self.codes]

    @cached_property
    def runs(self) -> list[tuple[int, str]]:
        single, out = self.lengths == 1, []
        if single.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], np.where(single, self.rows + 1, 0), [0]])))
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if single[lo] and hi - lo >= 3:
                    out.append((int(self.rows[lo]), " ".join(self.bare.take(pa.array(self.codes[lo:hi])).to_pylist())))
        return out

    def known(self, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) of the words' known features, by numbers and in no order; words may have one twice."""
        plain = shape(self.raw)[1]
        at, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        word, have = model.of_plain(self.raw.take(pa.array(at)))
        found = [(i, f) for i, w in zip(odd.tolist(), self.words.take(pa.array(odd)).to_pylist(), strict=True) for f in model.own(w)]
        more = np.array(found, np.int64).reshape(-1, 2)
        return np.concatenate([at[word], more[:, 0]]), np.concatenate([have, more[:, 1]])

    def joined(self, model: ToxicityModel, least: np.ndarray) -> Iterator[tuple[int, float, list[str]]]:
        """(text, value, parts) of two or three neighbouring short words that make a known word of more weight than the text's in least; each different sequence is looked up once."""
        head = pc.is_in(self.bare, value_set=model.heads).to_numpy(zero_copy_only=False)[self.codes]
        short = self.lengths <= PIECE
        two = short[:-1] & short[1:] & (self.rows[:-1] == self.rows[1:])
        for k, at in ((2, np.flatnonzero(two & head[:-1])), (3, np.flatnonzero(two[:-1] & two[1:] & head[:-2]))):
            if not len(at):
                continue
            key = self.codes[at]
            for j in range(1, k):
                key = key * len(self.words) + self.codes[at + j]
                key = np.unique(key, return_inverse=True)[1]  # dense again, so that a longer sequence fits a number
            first, back = np.unique(key, return_index=True, return_inverse=True)[1:]
            columns = [self.bare.take(pa.array(self.codes[at[first] + j])) for j in range(k)]
            found = _found(_glued(*columns), model.whole)
            values = np.where(found >= 0, model.values[model.whole_at[found]] if len(model.whole_at) else 0.0, 0.0)
            for i in np.flatnonzero(values[back] > least[self.rows[at]]).tolist():
                yield int(self.rows[at[i]]), float(values[back[i]]), [x[back[i]].as_py() for x in columns]


def _found(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word stands in among; -1: nowhere."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False)


def _glued(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (*parts, "")))


@dataclass
class ToxicityModel:
    chars: CharModel
    weights: dict[str, float]
    slope: float = 0.0
    bias: float = -20.0

    def __post_init__(self) -> None:
        self.memo: dict[str, tuple[int, ...]] = {}
        self.restored: dict[str, bool] = {}
        self.number = {f: i for i, f in enumerate(self.weights)}
        self.values = np.fromiter(self.weights.values(), np.float64, len(self.weights))
        strings = lambda words: pa.array(words, pa.large_string())
        whole, ahead = ({f[1:]: i for f, i in self.number.items() if f[0] == sign} for sign in "=^")
        self.whole, self.whole_at = strings(list(whole)), np.fromiter(whole.values(), np.int64, len(whole))
        self.ahead, self.ahead_at = strings(list(ahead)), np.fromiter(ahead.values(), np.int64, len(ahead))
        self.sorted = sorted(whole), sorted(ahead)
        #: What the first of several short words that make a known one can be.
        self.heads = strings(sorted({w[:k] for w in whole for k in range(1, PIECE + 1)}))
        #: How words of a feature begin: a word that begins otherwise has none.
        self.begins = strings(sorted({f[1 : 1 + PREFIXES[0]] for f in self.weights}))

    def of_plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) by numbers of words that are read as they are."""
        near = np.flatnonzero(pc.is_in(pc.utf8_slice_codeunits(words, 0, PREFIXES[0]), value_set=self.begins).to_numpy(zero_copy_only=False))
        words = words.take(pa.array(near))
        sizes, pairs = pc.utf8_length(words).to_numpy(zero_copy_only=False), []
        for k in (0, *PREFIXES):
            at = np.flatnonzero(sizes > max(k, 1))
            some = words.take(pa.array(at))
            found = _found(pc.utf8_slice_codeunits(some, 0, k), self.ahead) if k else _found(some, self.whole)
            hits = np.flatnonzero(found >= 0)
            pairs.append((near[at[hits]], (self.ahead_at if k else self.whole_at)[found[hits]]))
        return tuple(map(np.concatenate, zip(*pairs, strict=True)))

    def own(self, word: str) -> tuple[int, ...]:
        """The known features, by number, of a raw token's readings."""
        found = self.memo.get(word)
        if found is None:
            number = self.number
            found = tuple({number[f] for f in self.told(word) if f in number})
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def told(self, word: str) -> list[str]:
        """Features of a token's readings, among them all known ones.

        Every reading begins with the letters before the first suspicious character, as each of them has one path and no
        mark is a letter. Where no known feature goes on from there, these letters tell all, and nothing is decoded.
        """
        raw = word.strip(_QUOTES)
        first = _SUSPECT.search(raw)
        head = raw[: first.start()] if first else ""
        if head.isalpha() and not self.goes_on(head):
            if trimmed(word) == head:
                return features(head)
            if "=" + head not in self.number:
                return ["^" + head[:k] for k in PREFIXES if len(head) > k]
        return [f for w in readings(word, self.chars) for f in features(w)]

    def goes_on(self, head: str) -> bool:
        """Whether a longer word that begins with head can have a known feature that head itself doesn't tell."""
        whole, ahead = self.sorted
        i = bisect_right(whole, head)
        if i < len(whole) and whole[i].startswith(head):
            return True
        i = bisect_left(ahead, head) if len(head) <= PREFIXES[-1] else len(ahead)
        return i < len(ahead) and ahead[i].startswith(head)

    def spaced(self, run: str) -> float:
        """The greatest weight of the words that a run of spaced letters or pieces is read as, 0 at least."""
        words, get = decode(run, self.chars).split(" "), self.weights.get
        letters = "".join(words)  # whole known words are looked for across the restored spaces too
        inside = (get("=" + letters[i : i + k], 0.0) for i in range(len(letters)) for k in range(PIECE, min(LONGEST, len(letters) - i) + 1))
        return max(max((get(f, 0.0) for w in words for f in features(w)), default=0.0), max(inside, default=0.0))

    def makes(self, parts: list[str]) -> bool:
        """Whether the neighbouring words are read as one."""
        text = " ".join(parts)
        found = self.restored.get(text)
        if found is None:
            if len(self.restored) > MEMO:
                self.restored.clear()
            found = self.restored[text] = "".join(parts) in decode(text, self.chars).split(" ")
        return found

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """The worst word's weight of each text: 0 for null, empty and harmless ones."""
        read = Texts(texts)
        out = np.zeros(len(read.counts))
        if len(read.codes):
            own = np.zeros(len(read.words))
            word, have = read.known(self)
            np.maximum.at(own, word, self.values[have])
            starts = np.concatenate([[0], np.cumsum(read.counts)[:-1]])
            full = read.counts > 0
            out[full] = np.maximum.reduceat(own[read.codes], starts[full])
            for row, run in read.runs:
                out[row] = max(out[row], self.spaced(run))
            for row, w, parts in read.joined(self, out):
                if w > out[row] and self.makes(parts):
                    out[row] = w
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.bias, -30, 30)))


def _counts(df: DataFrame, per_slice, columns: str) -> DataFrame:
    """Sums by key of what per_slice(texts, marks) counts; marks: the column y."""
    names = columns.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for piece in slices(batch, "text"):
                for key, values in per_slice(piece.column("text"), piece.column("y").to_numpy()).items():
                    old = total.get(key)
                    total[key] = values if old is None else [a + b for a, b in zip(old, values, strict=True)]
        if total:
            arrays = [pa.array(list(total), pa.string())] + [pa.array([v[i] for v in total.values()], pa.int64()) for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        total = None
        give_back()

    return _summed(df.mapInArrow(run, _schema(names)), names)


def _schema(names: list[str]) -> str:
    return ", ".join([f"{names[0]} string", *(f"{c} bigint" for c in names[1:])])


def _summed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.groupBy(names[0]).agg(*[F.sum(c).alias(c) for c in names[1:]])


def _trigrams(texts: pa.Array, marks: np.ndarray) -> dict:
    """Documents that have a plain word, summed by the trigrams of the word."""
    read = Texts(texts)
    wide = max(1, len(read.words))
    documents = distinct(read.rows * wide + read.codes) % wide  # a word once a document
    times = np.bincount(documents, minlength=len(read.words))
    bare = pc.utf8_trim(read.words, characters=_MARKS)
    alpha, plain = shape(bare)
    rest = np.flatnonzero(~alpha)
    more = [(i, t) for i, w in zip(rest.tolist(), read.words.take(pa.array(rest)).to_pylist(), strict=True) if (t := trimmed(w)).isdigit() or t.isalpha() and not _SUSPECT.search(t)]
    kept = pa.concat_arrays([bare.filter(pa.array(plain)), pa.array([t for _, t in more], pa.large_string())])
    if not len(kept):
        return {}
    times = times[np.concatenate([np.flatnonzero(plain), np.array([i for i, _ in more], np.int64)])]
    at, sizes = points(_glued("^^", kept, "$"))
    at, last = at.astype(np.int64), np.cumsum(sizes) - 1
    start = np.ones(len(at), bool)
    start[last] = start[last - 1] = False
    start = np.flatnonzero(start)
    grams = at[start] << 42 | at[start + 1] << 21 | at[start + 2]
    order = np.argsort(grams)
    grams, n = grams[order], np.repeat(times, sizes - 2)[order]
    first = np.flatnonzero(np.diff(grams, prepend=-1))
    names = [chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in grams[first].tolist()]
    return {k: [v] for k, v in zip(names, np.add.reduceat(n, first).tolist(), strict=True)}


def _marked(tri: dict[str, int]) -> Callable[[pa.Array, np.ndarray], dict]:
    """A function that counts the documents of each of the four marks that have a feature."""
    made: list[CharModel] = []  # in the worker, once a task
    memo: dict[str, tuple[str, ...]] = {}

    def own(word: str) -> tuple[str, ...]:
        found = memo.get(word)
        if found is None:
            found = tuple(f for w in readings(word, made[0]) for f in features(w))
            if len(memo) > MEMO:
                memo.clear()
            memo[word] = found
        return found

    def per_slice(texts: pa.Array, marks: np.ndarray) -> dict:
        if not made:
            made.append(CharModel(tri))
        read, ids = Texts(texts), {}
        number = lambda f: ids.setdefault(f, len(ids))
        pairs = np.array([(i, number(f)) for i, w in enumerate(read.words.to_pylist()) for f in own(w)], np.int64).reshape(-1, 2)
        more = [(row, number(f)) for row, run in read.runs for w in decode(run, made[0]).split(" ") for f in features(w)]
        counted = _documents(read, pairs[:, 0], pairs[:, 1], more, marks, len(ids))
        return {f: v for f, v in zip(ids, counted.tolist(), strict=True) if any(v)}

    return per_slice


def _documents(read: Texts, word: np.ndarray, have: np.ndarray, more: list[tuple[int, int]], marks: np.ndarray, n: int) -> np.ndarray:
    """Documents of each of the four marks that have each of n features: by the words that have them, and more (document, feature)."""
    order = np.argsort(word, kind="stable")
    flat, sizes = have[order], np.bincount(word, minlength=len(read.words))
    starts = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes[read.codes] > 0)
    wide = max(1, len(read.words))
    pairs = distinct(read.rows[some] * wide + read.codes[some])
    rows, codes = pairs // wide, pairs % wide
    times = sizes[codes]
    features_of = flat[np.repeat(starts[codes] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    late = np.array(more, np.int64).reshape(-1, 2)
    rows, features_of = np.concatenate([np.repeat(rows, times), late[:, 0]]), np.concatenate([features_of, late[:, 1]])
    pairs = distinct(rows * max(1, n) + features_of)
    return np.bincount(pairs % max(1, n) * 4 + marks[pairs // max(1, n)], minlength=4 * n).reshape(-1, 4)


def _looked_for(df: DataFrame, tri: dict[str, int], wanted: Collection[str], columns: str) -> DataFrame:
    """Documents of each of the four marks that have each of the wanted features, where there are any."""
    names, wanted = columns.split(), sorted(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = None, np.zeros((len(wanted), 4), np.int64)
        for batch in batches:
            model = model or ToxicityModel(CharModel(tri), dict.fromkeys(wanted, 1.0))
            for piece in slices(batch, "text"):
                read = Texts(piece.column("text"))
                more = [(row, model.number[f]) for row, run in read.runs for w in decode(run, model.chars).split(" ") for f in features(w) if f in model.number]
                total += _documents(read, *read.known(model), more, piece.column("y").to_numpy(), len(wanted))
        some = np.flatnonzero(total.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.string()).take(pa.array(some)), *(pa.array(total[some, j]) for j in range(4))], names=names)
        model = batch = piece = read = None
        give_back()

    return _summed(df.mapInArrow(run, _schema(names)), names)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learns from all rows with a text and a label 0 or 1, each whole; labelled is read several times.

    Features and trigrams are counted on the executors. Features are counted in toxic documents first; those in MIN_DOCS
    of them or more, which alone can have a weight, are then looked for in the clean ones. The driver gets these and the
    trigrams. Without toxic or without clean rows every score is close to 0.
    """
    rows = bounded_batches(labelled).where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y"))
    half = F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)).cast("int")
    # y: label + 2 * half
    drawn = rows.select("text", (F.col("y") + 2 * half).alias("y"))
    tri = {r["gram"]: r["n"] for r in _counts(drawn, _trigrams, "gram n").collect()}
    names = "feature y0 y1 y2 y3"
    toxic = {r["feature"]: (r["y1"], r["y3"]) for r in _counts(drawn.where("y % 2 = 1"), _marked(tri), names).where(F.col("y1") + F.col("y3") >= MIN_DOCS).collect()}
    clean = {r["feature"]: (r["y0"], r["y2"]) for r in _looked_for(drawn.where("y % 2 = 0"), tri, toxic, names).collect()} if toxic else {}
    counts = {f: (clean.get(f, (0, 0)), v) for f, v in toxic.items()}
    sizes = {r["y"]: r["count"] for r in drawn.groupBy("y").count().collect()}

    def weights(halves: tuple[int, ...]) -> dict[str, float]:
        p_all, n_all = (sum(sizes.get(y + 2 * h, 0) for h in halves) for y in (1, 0))
        out = {}
        for f, (clean, toxic) in counts.items():
            p_own, n_own = sum(toxic[h] for h in halves), sum(clean[h] for h in halves)
            w = math.log((p_own + 0.5) / (p_all + 1)) - math.log((n_own + 0.5) / (n_all + 1)) - WIDTH * math.sqrt(1 / (p_own + 0.5) + 1 / (n_own + 0.5))
            if p_own >= 2 and w > 0:
                out[f] = w
        return out

    model = ToxicityModel(CharModel(tri), weights((0, 1)))
    if not model.weights or not sum(sizes.get(y, 0) for y in (0, 2)):
        return model
    of_half = weights((0,)), weights((1,))

    def judge() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        other = [ToxicityModel(CharModel(tri), of_half[1 - h]) for h in (0, 1)]  # each half judged by the other half's weights

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            y, e = batch.column("y").to_numpy(), np.zeros(batch.num_rows)
            for h in (0, 1):
                own = np.flatnonzero(y >> 1 == h)
                if len(own):
                    e[own] = other[h].evidence(batch.column("text").take(pa.array(own)))
            return pa.RecordBatch.from_arrays([pa.array(e), batch.column("y")], names=["e", "y"])

        return run

    judged = drawn.mapInArrow(by_slices("text", judge), "e double, y int").groupBy("e", (F.col("y") % 2).alias("y")).count()
    e, y, n = np.array(sorted(map(tuple, judged.collect())), float).T
    model.slope, model.bias = _logistic(e, y, n)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope (0 at least) and bias of a penalised logistic fit: Newton steps, halved until the loss falls; n: how often each point occurs.

    x is standardised first and the penalty keeps the slope finite where x parts the classes wholly.
    """
    n = np.ones_like(x) if n is None else n
    mean = np.average(x, weights=n)
    scale = np.sqrt(np.average((x - mean) ** 2, weights=n)) or 1.0
    design, beta, penalty = np.stack([(x - mean) / scale, np.ones_like(x)], 1), np.zeros(2), np.array([0.5, 1e-4])

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(n @ np.logaddexp(0, z) - (n * y) @ z + penalty @ (b * b) / 2)

    now = loss(beta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        grad = design.T @ (n * (p - y)) + penalty * beta
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step, by = np.linalg.solve(hess, grad), 1.0
        while by > 1e-8 and loss(beta - by * step) > now:
            by /= 2
        beta = beta - by * step
        before, now = now, loss(beta)
        if before - now < 1e-9 * max(1.0, now):
            break
    slope = max(float(beta[0]) / scale, 0.0)
    return slope, float(beta[1]) - slope * mean


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep_text: bool = False, prefix: str = "") -> DataFrame:
    """docs without text (unless keep_text), with evidence, score and predicted (1 if score >= 0.5), prefix before these names.

    Null and empty texts score as texts without any toxic word; repeated rows score alike; a very
    long text is a slice of its own. Columns of docs with the new names are replaced. Rows are
    independent; nothing is shuffled.
    """
    made = [prefix + x for x in ("evidence", "score", "predicted")]
    keep = [c for c in docs.columns if c not in made and (keep_text or c != text_col)]
    slim = bounded_batches(docs).select(*dict.fromkeys([*keep, text_col]))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keep), f"`{made[0]}` double, `{made[1]}` double, `{made[2]}` int"])
    tri, weights, slope, bias = model.chars.tri, model.weights, model.slope, model.bias

    def ready() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        local = ToxicityModel(CharModel(tri), weights, slope, bias)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            e = local.evidence(batch.column(text_col))
            s = local.score(e)
            return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(e), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, *made])

        return run

    return slim.mapInArrow(by_slices(text_col, ready), fields)
