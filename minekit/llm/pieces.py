"""SentencePiece encoding and decoding with N-best segmentations.

A text, with a space put before it, is a lattice of vocabulary pieces; characters that are
no piece stand as their UTF-8 bytes. The N best paths come from two passes: forward Viterbi
gives the best score of every prefix, and a backward A* search from the end uses those scores
as its heuristic. Scores are whole numbers (steps of 1 / STEPS), so sums are exact in any order
and the heuristic is exact; of equal partial paths the one nearest to the beginning goes first.
So the search pops nothing but parts of its N results, at most N times their arcs, ties or not.

No piece reaches across a boundary before a space, from a letter or digit to a mark that follows
none in any piece, or across a character that occurs in no piece of two or more, so every path
passes there. The lattice is searched chunk by chunk between such points, and the N best of the
whole text are the N best sums of one path per chunk. The second best path of a chunk leaves
the best one at the position where that costs least, which the forward pass tells as well; only
the N - 1 chunks where it costs least can leave their best path, and only those are searched.
Scores: a unigram model's own log probabilities; for a merge (BPE) model, whose scores are only
ranks, -ln(rank + 10).
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, by_slices

#: Bytes (about) of chunks that a worker remembers; segmentations of a text by default; steps of a score per unit.
MEMO, NBEST, STEPS = 24 << 20, 4, 1 << 24
#: More than any path loses.
WORST = 1 << 62


class Vocabulary:
    """Pieces (spaces as spaces), their scores in steps, and the ids of the 256 bytes."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], byte_score: float) -> None:
        self.pieces = {p: ((i,), round(s * STEPS)) for p, (i, s) in pieces.items()}
        self.byte_ids, self.byte_score = byte_ids, round(byte_score * STEPS)
        #: Every end of a piece, with (ids, score) where it is a piece itself.
        self.ends: dict[str, tuple[tuple[int], int] | None] = {p[k:]: None for p in pieces for k in range(1, len(p))} | self.pieces
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("a piece has a space after another character")
        self.cut = self._cut([p for p in pieces if len(p) > 1])
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        #: Pieces by id; bytes below 128 are whole characters.
        self.text_of = {i: chr(b) for i, b in self.byte_of.items() if b < 128} | {i: p for p, (i, _) in pieces.items()}

    @staticmethod
    def _cut(long: list[str]) -> re.Pattern:
        """An expression whose successive matches are the chunks of a text."""

        def one_of(chars: set[str]) -> str:
            return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"

        inside = {c for p in long for c in p} - {" "}
        letters = {c for c in inside if c.isalnum()}
        marks = inside - letters
        follow = {b for p in long for a, b in zip(p, p[1:], strict=False) if a in letters and b in marks}
        if not inside:
            return re.compile(" +|[^ ]", re.S)
        rest = f"| +|[^{one_of(inside)[1:-1]} ]"
        if not letters:
            return re.compile(f" *{one_of(marks)}+{rest}", re.S)
        after = f"(?:{one_of(follow)}{one_of(marks)}*)?" if follow else ""
        lead = f"{one_of(marks)}*" if marks else ""
        return re.compile(f" *(?={one_of(inside)}){lead}(?:{one_of(letters)}+{after})*{rest}", re.S)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a SentencePiece model file."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = [sp.get_score(i) for i in range(sp.get_piece_size())]
        ranks = all(float(s).is_integer() for s in scores)
        pieces, byte_ids = {}, [-1] * 256
        for i, s in enumerate(scores):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[name.replace("▁", " ")] = (i, -math.log(10 - s) if ranks else s)
        worst = min((s for _, s in pieces.values()), default=0.0)
        return cls(pieces, byte_ids, worst - 1.0)

    def forward(self, chunks: Iterable[str]) -> Iterator[tuple[str, list[int], list[int], list[tuple[int, ...]]]]:
        """For each chunk in turn, of each of its prefixes (Viterbi): best score, what the second best path loses (WORST: there is none), ids of the best path.

        What a chunk begins like the one before it is not computed again: sorted chunks cost least. The lists are reused.
        """
        get, none = self.ends.get, WORST
        best, loss, path, before = [0], [none], [()], ""
        for chunk in chunks:
            n, k, most = len(chunk), 0, min(len(chunk), len(before))
            while k < most and chunk[k] == before[k]:
                k += 1
            del best[k + 1 :], loss[k + 1 :], path[k + 1 :]
            while k < n:
                start, k = k, k + 1
                found = get(chunk[start:k], 0)
                arc, at = found or self._bytes(chunk[start]), start
                top, second = best[start] + arc[1], -none
                while found != 0 and start:
                    start -= 1
                    found = get(chunk[start:k], 0)
                    if found:
                        s = best[start] + found[1]
                        if s > top:
                            top, second, arc, at = s, top, found, start
                        elif s > second:
                            second = s
                second, here = top - second, loss[at]
                best.append(top)
                loss.append(here if here < second else second)
                path.append(path[at] + arc[0])
            before = chunk
            yield chunk, best, loss, path

    def _bytes(self, c: str) -> tuple[tuple[int, ...], int]:
        data = c.encode("utf-8", "surrogatepass")
        return tuple(self.byte_ids[b] for b in data), self.byte_score * len(data)

    def arcs(self, chunk: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """(start, score, ids) of the arcs into each position."""
        out: list[list[tuple[int, int, tuple[int, ...]]]] = [[]]
        for end in range(1, len(chunk) + 1):
            start = end - 1
            found = self.ends.get(chunk[start:end], 0)
            ids, score = found or self._bytes(chunk[start])
            own = [(start, score, ids)]
            while found != 0 and start:
                start -= 1
                found = self.ends.get(chunk[start:end], 0)
                if found:
                    own.append((start, found[1], found[0]))
            out.append(own)
        return out

    def nbest(self, chunk: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best (score in steps, ids) of a chunk, best first, by A* from its end; fewer if it has fewer paths."""
        best, arcs = next(self.forward([chunk]))[1], self.arcs(chunk)
        push, pop, size = heapq.heappush, heapq.heappop, len(chunk)
        out: list[tuple[int, tuple[int, ...]]] = []
        heap: list = [(-best[size], size, 0, 0, None)]
        turn = 0
        while heap:
            _, at, _, after, path = pop(heap)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((after, tuple(ids)))
                if len(out) == n:
                    break
                continue
            for start, score, own in arcs[at]:
                turn += 1
                g = after + score
                push(heap, (-(best[start] + g), start, turn, g, (own, path)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space before it is taken away again."""
        try:
            return "".join([self.text_of[i] for i in ids])[1:]
        except KeyError:  # bytes of longer characters among them
            pass
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "surrogatepass"))
                pending.clear()
            out.append(self.text_of[i])
        if pending:
            out.append(pending.decode("utf-8", "surrogatepass"))
        return "".join(out)[1:]


class Encoder:
    """Texts to their n best segmentations; remembers each chunk's best path and its gap to the second."""

    def __init__(self, vocabulary: Vocabulary, n: int = NBEST) -> None:
        self.vocabulary, self.n = vocabulary, n
        self.memo: dict[str, tuple[int, int, tuple[int, ...]]] = {}
        self.searched: dict[str, list[tuple[int, tuple[int, ...]]]] = {}
        self.weight = 0

    def learn(self, chunks: Iterable[str]) -> None:
        """Afterwards all of chunks are remembered."""
        if self.weight > MEMO:
            self.memo.clear()
            self.searched.clear()
            self.weight = 0
        memo = self.memo
        for chunk, best, loss, path in self.vocabulary.forward(sorted([c for c in set(chunks) if c not in memo])):
            memo[chunk] = best[-1], loss[-1], path[-1]
            self.weight += 250 + len(chunk) + 8 * len(path[-1])

    def _search(self, chunk: str) -> list[tuple[int, tuple[int, ...]]]:
        found = self.searched.get(chunk)
        if found is None:
            found = self.searched[chunk] = self.vocabulary.nbest(chunk, self.n)
            self.weight += 200 + len(chunk) + sum(150 + 8 * len(x) for _, x in found)
        return found

    def __call__(self, text: str | None) -> list[tuple[float, list[tuple[int, ...]]]]:
        """[(score, ids of each chunk)], best first; none for a null or empty text."""
        return self.many([text])[text]

    def many(self, texts: Iterable[str | None]) -> dict[str | None, list[tuple[float, list[tuple[int, ...]]]]]:
        """The same for each different one of texts."""
        cut = self.vocabulary.cut.findall
        chunks = {t: cut(" " + t) if t else [] for t in set(texts)}
        self.learn(chain.from_iterable(chunks.values()))
        return {t: self._best(own) for t, own in chunks.items()}

    def _best(self, chunks: list[str]) -> list[tuple[float, list[tuple[int, ...]]]]:
        if not chunks:
            return []
        memo = self.memo
        found = [memo[c] for c in chunks]
        best = [f[2] for f in found]
        score = sum([f[0] for f in found])
        if self.n == 1:
            return [(score / STEPS, best)]
        # only the n - 1 chunks with the least gaps can leave their best path; ties: the earlier chunk
        near = heapq.nsmallest(self.n - 1, [(f[1], i) for i, f in enumerate(found) if f[1] < WORST])
        sums: list[tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]] = [(0, ())]
        for _, i in near:  # the n least sums over the near chunks so far
            options = self._search(chunks[i])
            sums = heapq.nsmallest(self.n, [(d + options[0][0] - s, taken + ((i, ids),) * (r > 0)) for d, taken in sums for r, (s, ids) in enumerate(options)])
        out = []
        for d, taken in sums:
            ids = best
            if taken:
                ids = best.copy()
                for i, x in taken:
                    ids[i] = x
            out.append(((score - d) / STEPS, ids))
        return out

    @staticmethod
    def ids(found: tuple[float, list[tuple[int, ...]]]) -> list[int]:
        return list(chain.from_iterable(found[1]))


_ENCODERS: dict = {}


def encoder(path: str, n: int) -> Encoder:
    """One encoder per worker process, so that its memory serves all tasks."""
    if (path, n) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, n] = Encoder(Vocabulary.load(path), n)
    return _ENCODERS[path, n]


def encode(docs: DataFrame, model_path: str, n: int = NBEST, text_col: str = "text", all_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids (best segmentation), nbest_scores and, with all_ids, nbest_ids.

    nbest_scores are the scores of the n best segmentations, best first; a text with fewer has
    fewer. Null and empty texts have no tokens and no scores. model_path is read by the workers
    (the vocabulary file is part of the installation, like a library). Columns of docs with
    the new names are replaced. Repeated rows are searched once a slice. Rows are independent;
    nothing is shuffled.
    """
    made = ["n_tokens", "ids", "nbest_scores"] + ["nbest_ids"] * all_ids
    keep = [c for c in docs.columns if c not in made]
    slim = bounded_batches(docs).select(*keep)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema), "n_tokens bigint, ids array<int>, nbest_scores array<double>"] + ["nbest_ids array<array<int>>"] * all_ids)

    def ready() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        enc = encoder(model_path, n)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(text_col).to_pylist()
            done = enc.many(texts)  # repeated rows are searched once
            own = {t: np.array(enc.ids(f[0]) if f else [], np.int32) for t, f in done.items()}
            ids = [own[t] for t in texts]
            lengths = [len(x) for x in ids]
            columns = [batch.column(c) for c in keep]
            columns += [pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.concatenate(ids)))]
            columns.append(pa.array([[f[0] for f in done[t]] for t in texts], pa.list_(pa.float64())))
            if all_ids:
                columns.append(pa.array([[enc.ids(f) for f in done[t]] for t in texts], pa.list_(pa.list_(pa.int32()))))
            return pa.RecordBatch.from_arrays(columns, names=[*keep, *made])

        return run

    return slim.mapInArrow(by_slices(text_col, ready), fields)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids give null, no ids an empty text."""
    keep = [c for c in rows.columns if c != out_col]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), f"`{out_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(model_path, NBEST).vocabulary
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x) if x else "" for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, out_col])

    return bounded_batches(rows).select(*keep).mapInArrow(run, fields)


def digest_documents(docs: DataFrame, model_path: str, n: int = NBEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the best ids as little-endian int32), nbest_scores, alternatives (paths found) and round_trip (decoding gives the text back).

    Null and empty texts have no tokens, no scores and come back whole. A very long text is a slice
    of its own. Repeated rows are searched once a slice and each returned. No other column is read.
    The scores of a merge vocabulary are made of ranks: its segmentations are the best under
    those, not what its own merges give.
    """
    slim = bounded_batches(docs).select(id_col, text_col)
    kind = slim.schema[id_col].dataType.simpleString()

    def ready() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        enc = encoder(model_path, n)

        def one(text: str | None, found: list) -> tuple:
            ids = enc.ids(found[0]) if found else []
            return len(ids), hashlib.sha256(np.array(ids, "<i4")).hexdigest(), [f[0] for f in found], len(found), enc.vocabulary.decode(ids) == (text or "")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(text_col).to_pylist()
            done = {t: one(t, f) for t, f in enc.many(texts).items()}
            kinds = [pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int64(), pa.bool_()]
            made = [pa.array([done[t][i] for t in texts], k) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([batch.column(id_col), *made], names=[id_col, "n_tokens", "ids_sha256", "nbest_scores", "alternatives", "round_trip"])

        return run

    return slim.mapInArrow(by_slices(text_col, ready), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, nbest_scores array<double>, alternatives bigint, round_trip boolean")
