"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds the vocabulary: hashes of the training words as an Elias-Fano sequence (a word's
id is its rank) and their counts. Level n holds, in shards, contexts and their successors; what
begins with the same two words is in the same shard on every level:

- contexts: word ids (level 2) or the shard's own nodes of level n - 1, Elias-Fano;
- pointers: where each context's successors begin, rising, Elias-Fano;
- successors: word ids, made to rise over all contexts by adding (context's place * ids), Elias-Fano,
  so a successor is searched relative to its context, between its context's pointers;
- quantised log10 of the discounted probability of each successor, and of the weight that its
  context leaves to the lower level: p(w | h) = (c(hw) - D) / c(h) + D * T(h) / c(h) * p(w | h').

The lowest level is (c + 0.5) / (N + 0.5 (V + 1)), so every distribution sums to one, unknown
words included. All levels are counted in one pass, in which an n-gram is its beginning (by place
in the level below) and a word. Shards are built by Spark tasks from counts that map tasks have
summed beforehand, and are files in the shared folder that scoring tasks map into memory; their
number grows with the corpus. Successors of very frequent words are spread over shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, mix, new_path, release, shuffle_parts, slices, tokens, word_hashes
from .eliasfano import EliasFano, load, named, part, save

#: Absolute discount; steps of a quantised log10 per unit.
DISCOUNT, STEPS = 0.75, 4096
#: N-grams a counting task holds before it hands them on; tokens of the corpus for a shard.
HELD, SHARD_TOKENS = 4_000_000, 8_000_000
#: The end of a text as a token.
END = np.uint64(0x9D5C3A7F11E60B29)


def quantise(p: np.ndarray) -> np.ndarray:
    """-log10 p in steps, 16 bits."""
    return np.minimum(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEPS), 65535).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-q.astype(np.float64) / STEPS)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text with its end, the code of each, the distinct tokens' hashes by code; the end is the last)."""
    counts, codes, words = tokens(texts)
    h = np.append(word_hashes(words), END)
    return counts + 1, np.insert(codes, np.cumsum(counts), len(h) - 1), h


@dataclass
class Meta:
    """What the driver knows of a model: bounded by the number of shards (of the vocabulary) and parts (of the other levels)."""

    path: str
    order: int
    shards: int
    parts: int
    starts: list[int]
    words: int
    total: int
    documents: int
    hot: dict[int, int]
    levels: dict[int, list[tuple[int, int]]]
    spread: dict[int, int]


class Model:
    """A model's files, mapped into memory by a worker."""

    def __init__(self, meta: Meta) -> None:
        self.meta = meta
        self.vocabulary = [load(f"{meta.path}/words-{i}") if n else None for i, n in enumerate(np.diff([*meta.starts, meta.words]))]
        self.hashes = [EliasFano(part("hash", v)) if v else None for v in self.vocabulary]
        self.bound = meta.total + 0.5 * (meta.words + 1)
        self.files: dict[int, list[dict | None]] = {}
        for level, parts in meta.levels.items():
            self.files[level] = []
            for s, (n, _) in enumerate(parts):
                f = load(f"{meta.path}/level{level}-{s}") if n else None
                self.files[level].append(f and {"contexts": EliasFano(part("contexts", f)), "pointers": EliasFano(part("pointers", f)), "next": EliasFano(part("next", f)), "p": f["p"], "gamma": f["gamma"]})
        self.hot = np.array(sorted(meta.hot), np.int64)

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id of each of these different hashes or -1, its training count)."""
        out, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        place = bucket_of(h, self.meta.shards)
        for b in np.unique(place):
            if self.vocabulary[b]:
                rows = np.flatnonzero(place == b)
                found = self.hashes[b].find(h[rows])
                known = found >= 0
                out[rows[known]] = found[known] + self.meta.starts[b]
                count[rows[known]] = self.vocabulary[b]["count"][found[known]]
        return out, count

    def lookup(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of each node or -1, probability share of it, weight of its context for the level below).

        Rows with a negative context or word are left out: no node, and weight 1 without a context.
        """
        n = len(context)
        at, p, gamma = np.full(n, -1, np.int64), np.zeros(n), np.ones(n)
        rows = np.flatnonzero(context >= 0)
        if not len(rows):
            return at, p, gamma
        # a word outside of the vocabulary still has its context's weight; it gets a word id that no node has
        rows = rows[np.argsort(_pair(context[rows], word[rows], self.meta.words))]
        own, w = context[rows], word[rows]
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (w[1:] != w[:-1])])
        group, u = np.cumsum(first) - 1, np.flatnonzero(first)
        uc, uw = own[u], w[u]
        ua, up, ug = np.full(len(u), -1, np.int64), np.zeros(len(u)), np.ones(len(u))
        if level == 2:
            place = shard_of(uc, uw, self.hot, self.meta.parts)
        else:  # where the node of the level below is, by its own place there
            begins = np.array([at for _, at in self.meta.levels[level - 1]], np.int64)
            place = np.searchsorted(begins, uc, "right") - 1
            uc = uc - begins[place]
        for s in np.unique(place):
            f = self.files[level][s]
            if f:
                sel = np.flatnonzero(place == s)
                c = f["contexts"].find(uc[sel].astype(np.uint64))
                known = c >= 0
                sel, c = sel[known], c[known]
                ug[sel] = restored(f["gamma"][c])
                seen = uw[sel] >= 0
                sel, c = sel[seen], c[seen]
                if not len(sel):
                    continue
                key = c.astype(np.uint64) * np.uint64(self.meta.words) + uw[sel].astype(np.uint64)
                # rows are sorted by context: each context's range of successors is read once
                new = np.concatenate([[True], c[1:] != c[:-1]])
                nth, begin = np.cumsum(new) - 1, f["pointers"].get(c[new])
                found = f["next"].find(key, begin[nth].astype(np.int64), f["pointers"].get(c[new] + 1)[nth].astype(np.int64))
                hit = found >= 0
                ua[sel[hit]] = found[hit] + self.meta.levels[level][s][1]
                up[sel[hit]] = restored(f["p"][found[hit]])
        if level == 2 and len(self.hot):  # contexts spread over shards: their weight is known as a whole
            for h in self.hot[np.isin(self.hot, uc)]:
                ug[uc == h] = min(1.0, DISCOUNT * self.meta.spread[int(h)] / self.meta.hot[int(h)])
        at[rows], p[rows], gamma[rows] = ua[group], up[group], ug[group]
        return at, p, gamma

    def tokens(self, lengths: np.ndarray, codes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count, probability) of each token of texts of these lengths; codes are places in h."""
        own, many = self.ids(h)
        ids, count = own[codes], many[codes]
        p = (count + 0.5) / self.bound
        first = begins(lengths, len(codes))
        node = ids
        for level in range(2, self.meta.order + 1):
            context = np.roll(node, 1)
            # before a text stands its beginning: a context of level 2 with the id behind the last word
            context[first] = self.meta.words if level == 2 else -1
            node, share, gamma = self.lookup(level, context, ids)
            p = share + gamma * p
        return count, p


def begins(lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n tokens begin a text."""
    first = np.zeros(n, bool)
    first[np.cumsum(lengths) - lengths] = True
    return first


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so that the vocabulary is sorted over all buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def shard_of(context: np.ndarray, word: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """Shard by context; by context and word for hot contexts."""
    key = mix(context.astype(np.uint64))
    if len(hot):
        spread = np.isin(context, hot)
        key[spread] = mix(context[spread].astype(np.uint64), word[spread].astype(np.uint64), seed=1)
    return (key % np.uint64(shards)).astype(np.int64)


def _pair(context: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    """(context, word) as one number that sorts as the pair does; word: -1 to words."""
    return context.astype(np.uint64) * np.uint64(words + 2) + (word + 1).astype(np.uint64)


def _blobs(place: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each place with the columns' own pieces as bytes; columns are sorted by place."""
    edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else np.zeros(1, int)
    spans = list(zip(edge[:-1], edge[1:], strict=True))
    arrays = [pa.array([int(place[a]) for a, _ in spans], pa.int32())]
    arrays += [pa.array([c[a:b].tobytes() for a, b in spans], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=["place", *names])


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()] or [np.zeros(0, kind)])


def _squeezed(values: np.ndarray, kind: str, rising: bool = False) -> bytes:
    """Whole numbers (rising: their differences) byte by byte, compressed."""
    data = np.ascontiguousarray(np.diff(values, prepend=0) if rising else values).astype(kind)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(data.view(np.uint8).reshape(len(data), -1).T).tobytes())


def _opened(data: bytes, kind: str, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)
    return np.cumsum(values) if rising else values


def fit(train: DataFrame, text_col: str = "text", order: int = 2, shards: int | None = None) -> Meta:
    """Counts every text of train (null: empty) and builds the trie in the shared folder."""
    spark: SparkSession = train.sparkSession
    shards = shards or max(4, shuffle_parts(spark))
    path = new_path(spark, "ngrams")
    docs = bounded_batches(train).select(F.col(text_col).alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            unique, back = np.unique(h, return_inverse=True)
            return unique, np.bincount(back, c, len(unique)).astype(np.int64)

        for batch in batches:
            for piece in slices(batch, "text"):
                _, codes, h = hashed(piece.column(0))
                order = np.argsort(h)
                held.append((h[order], np.bincount(codes, minlength=len(h))[order]))
            if sum(len(x[0]) for x in held) > 4_000_000:
                held[:] = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield _blobs(bucket_of(held[0][0], shards), [held[0][0], held[0][1]], ["h", "c"])
                    held.clear()
        if held:
            h, c = merged()
            yield _blobs(bucket_of(h, shards), [h, c], ["h", "c"])

    def build_words(key: tuple, table: pa.Table) -> pa.Table:
        unique, back = np.unique(_joined(table, "h", "<u8"), return_inverse=True)
        count = np.bincount(back, _joined(table, "c", "<i8"), len(unique)).astype(np.int64)
        save(f"{path}/words-{key[0].as_py()}", named("hash", EliasFano.encode(unique)) | {"count": count.astype(np.uint32) if count.max() < 2**32 else count})
        top = np.argsort(-count, kind="stable")[:64]
        end = int(count[unique == END].sum())
        return pa.table({"place": pa.array([key[0].as_py()], pa.int32()), "n": [len(unique)], "total": [int(count.sum())], "documents": [end], "top": pa.array([top.tolist()], pa.list_(pa.int64())), "counts": pa.array([count[top].tolist()], pa.list_(pa.int64()))})

    rows = {r["place"]: r for r in docs.mapInArrow(count_words, "place int, h binary, c binary").groupBy("place").applyInArrow(build_words, "place int, n bigint, total bigint, documents bigint, top array<bigint>, counts array<bigint>").collect()}
    starts, at = [], 0
    for b in range(shards):
        starts.append(at)
        at += rows[b]["n"] if b in rows else 0
    total = sum(r["total"] for r in rows.values())
    parts = max(shards, -(-total // SHARD_TOKENS))
    # contexts with more than a quarter of a shard's mean: at most 4 * parts of them
    hot = {starts[b] + i: c for b, r in rows.items() for i, c in zip(r["top"], r["counts"], strict=True) if c > total / (4 * parts)}
    documents = sum(r["documents"] for r in rows.values())
    if documents > total / (4 * parts):
        hot[at] = documents
    meta = Meta(path, 1, shards, parts, starts, at, total, documents, hot, {}, {})
    release(spark)
    if order > 1 and total:
        _build_levels(docs, meta, order)
    return meta


@dataclass
class Grams:
    """Counted n-grams of one level, sorted: parent (id of the word before on level 2, else place in the level below), word and count."""

    parent: np.ndarray
    word: np.ndarray
    count: np.ndarray

    @staticmethod
    def summed(parent: np.ndarray, word: np.ndarray, count: np.ndarray | None, words: int) -> tuple[Grams, np.ndarray]:
        """(the different n-grams with their counts, the place of each given one among them)."""
        key, place = np.unique(_pair(parent, word, words), return_inverse=True)
        many = np.bincount(place, count, len(key)).astype(np.int64)
        wide = np.uint64(words + 2)
        return Grams((key // wide).astype(np.int64), (key % wide).astype(np.int64) - 1, many), place


def _merged(held: list[list[Grams]], words: int) -> list[Grams]:
    """The sums, level by level, of what slices counted."""
    out: list[Grams] = []
    places: list[np.ndarray] = []
    for level in range(len(held[0])):
        parts = [x[level] for x in held]
        parent = np.concatenate([places[i][g.parent] if level else g.parent for i, g in enumerate(parts)])
        total, at = Grams.summed(parent, np.concatenate([g.word for g in parts]), np.concatenate([g.count for g in parts]), words)
        places = np.split(at, np.cumsum([len(g.word) for g in parts])[:-1])
        out.append(total)
    return out


def _build_levels(docs: DataFrame, meta: Meta, order: int) -> None:
    """Counts n-grams of 2 to order words in one pass and writes the shards of their levels; meta then knows them."""
    hot, known = np.array(sorted(meta.hot), np.int64), meta.hot
    parts, words, path, levels = meta.parts, meta.words, meta.path, range(order - 1)
    wide = "<u8" if words >= 2**32 - 1 else "<u4"
    names = [f"{c}{i}" for i in levels for c in ("parent", "word", "few")]

    def counted(piece: pa.Array, model: Model) -> list[Grams]:
        lengths, codes, h = hashed(piece)
        ids = model.ids(h)[0][codes]
        first, out, at = begins(lengths, len(ids)), [], np.arange(len(ids))
        context = np.roll(ids, 1)
        context[first] = words
        for _ in levels:
            grams, place = Grams.summed(context, ids[at], None, words)
            out.append(grams)
            # the n-gram that ends at a token is the beginning of the one that ends at the next token of its text
            follows = np.flatnonzero(~first[(at + 1) % len(ids)])
            context, at = place[follows], at[follows] + 1
        return out

    def blobs(grams: list[Grams]) -> pa.RecordBatch:
        """A row for each part, with its n-grams of every level; parents of the upper levels are places in the row's level below."""
        part_of = shard_of(grams[0].parent, grams[0].word, hot, parts)
        made: dict[int, list[bytes]] = {int(x): [] for x in np.unique(part_of)}
        own_of, inner = list(made.values()), np.zeros(0, np.int64)
        for i, g in enumerate(grams):
            if i:
                part_of = part_of[g.parent]
            rows = np.argsort(part_of, kind="stable")
            edge = np.searchsorted(part_of[rows], np.append(list(made), parts))  # where each part's rows begin
            parent = inner[g.parent] if i else g.parent
            for at, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                own = rows[lo:hi]
                count = g.count[own]
                few = np.minimum(count, 255).astype(np.uint8).tobytes() + count[count >= 255].astype("<i8").tobytes()  # in one byte; large ones follow in 8
                own_of[at] += [_squeezed(parent[own], "<u4" if i else wide, True), _squeezed(g.word[own], wide), zstandard.ZstdCompressor(level=1).compress(few)]
            inner = np.empty(len(rows), np.int64)
            inner[rows] = np.arange(len(rows)) - np.repeat(edge[:-1], np.diff(edge))
        arrays = [pa.array(list(made), pa.int32())] + [pa.array([own[i] for own in made.values()], pa.binary()) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(arrays, names=["place", *names])

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = Model(meta), []
        for batch in batches:
            for piece in slices(batch, "text"):
                held.append(counted(piece.column(0), model))
                if sum(len(g.word) for x in held for g in x) > HELD:
                    held[:] = [_merged(held, words)]
                    if sum(len(g.word) for g in held[0]) > HELD // 2:
                        yield blobs(held[0])
                        held.clear()
        if held:
            yield blobs(_merged(held, words))
        model = held = None
        give_back()

    def build(key: tuple, table: pa.Table) -> pa.Table:
        part_no, held = key[0].as_py(), []
        for row in range(table.num_rows):
            own = []
            for i in levels:
                word = _opened(table.column(f"word{i}")[row].as_py(), wide)
                few = zstandard.ZstdDecompressor().decompress(table.column(f"few{i}")[row].as_py())
                count = np.frombuffer(few[: len(word)], np.uint8).astype(np.int64)
                count[count == 255] = np.frombuffer(few[len(word) :], "<i8")
                own.append(Grams(_opened(table.column(f"parent{i}")[row].as_py(), "<u4" if i else wide, True), word, count))
            held.append(own)
        grams = _merged(held, words)
        found: dict = {"place": pa.array([part_no], pa.int32())}
        spread_ids, spread_n = [], []
        for i, g in enumerate(grams):
            begin = np.flatnonzero(np.concatenate([[True], g.parent[1:] != g.parent[:-1]])) if len(g.parent) else np.zeros(0, np.int64)
            n = np.diff(np.append(begin, len(g.parent)))
            own, sums = g.parent[begin], np.add.reduceat(g.count, begin) if len(begin) else g.count
            if i == 0:
                for j in np.flatnonzero(np.isin(own, hot)):
                    sums[j] = known[int(own[j])]
                    spread_ids.append(int(own[j]))
                    spread_n.append(int(n[j]))
            nth = np.repeat(np.arange(len(begin), dtype=np.uint64), n)
            if len(g.word):
                save(
                    f"{path}/level{i + 2}-{part_no}",
                    named("contexts", EliasFano.encode(own.astype(np.uint64)))
                    | named("pointers", EliasFano.encode(np.append(begin, len(g.word)).astype(np.uint64)))
                    | named("next", EliasFano.encode(nth * np.uint64(words) + g.word.astype(np.uint64)))
                    | {"p": quantise((g.count - DISCOUNT) / np.repeat(sums, n)), "gamma": quantise(np.minimum(1.0, DISCOUNT * n / sums))},
                )
            found[f"n{i}"] = pa.array([len(g.word)], pa.int64())
        return pa.table(found | {"hot": pa.array([spread_ids], pa.list_(pa.int64())), "parts": pa.array([spread_n], pa.list_(pa.int64()))})

    fields = "place int, " + ", ".join(f"n{i} bigint" for i in levels) + ", hot array<bigint>, parts array<bigint>"
    rows = {r["place"]: r for r in docs.mapInArrow(count_grams, "place int, " + ", ".join(f"{c} binary" for c in names)).groupBy("place").applyInArrow(build, fields).collect()}
    for i in levels:
        own, at = [], 0
        for s in range(parts):
            n = rows[s][f"n{i}"] if s in rows else 0
            own.append((n, at))
            at += n
        meta.levels[i + 2] = own
    for r in rows.values():
        for h, n in zip(r["hot"], r["parts"], strict=True):
            meta.spread[h] = meta.spread.get(h, 0) + n
    meta.order = order
    release(docs.sparkSession)


_MODELS: dict[str, Model] = {}


def score(docs: DataFrame, meta: Meta, text_col: str = "text") -> DataFrame:
    """docs without text, with n_tokens, n_known, train_tokens, base_score and score (log10).

    The end of a text is a token, so null and empty texts have one. A very long text is a slice of
    its own; repeated rows score alike. Columns of docs with these names are replaced. Rows are
    independent; nothing is shuffled.
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in docs.columns if c not in (text_col, *made)]
    slim = bounded_batches(docs).select(*keep, text_col)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != text_col), "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if meta.path not in _MODELS:
            _MODELS.clear()
            _MODELS[meta.path] = Model(meta)
        model = _MODELS[meta.path]
        for batch in batches:
            for piece in slices(batch, text_col):
                lengths, codes, h = hashed(piece.column(text_col))
                at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                count, p = model.tokens(lengths, codes, h)
                base, full = np.log10((count + 0.5) / model.bound), np.log10(np.maximum(p, 1e-300))
                columns = [piece.column(c) for c in keep]
                columns += [pa.array(lengths.astype(np.int64)), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(np.full(len(lengths), meta.total, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(full, at))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])
        give_back()

    return slim.mapInArrow(run, fields)
