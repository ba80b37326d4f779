"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its k-word shingles. Sets whose Jaccard similarity reaches t miss at
most m = n - ceil(t n) of each other's elements, so whatever fixed order elements have, the
first of them tell: rare elements come first, frequent ones last. Rare elements are indexed
one by one. Frequent elements are dealt into groups by hash and indexed as pairs within a
group; the prefix is extended until the number of rare elements plus, for each group, the
number of its elements less one exceeds m. Two similar sets then share a rare element or a
pair (if each group had at most one shared element, more than m would be missing). Short sets,
whose groups might use them up, are indexed by single elements; sizes about the border by both.
Any choice of the frequent elements gives the same result, so they are a bounded list of the
most frequent ones.

Documents with equal sets form a class, represented by the least id. Members of a shared key are
compared by parity sketches: the bits in which two sketches differ are no more than the elements
in which the sets do, so nothing is lost. A task hands on no pairs but a spanning tree of those
that pass: so every link lies inside a component of these trees. The members of such a component
meet once, with their sets, in blocks of bounded size, and again only a spanning tree of the
pairs that do reach t is handed on; its components are the result. So a large group costs
comparisons in memory, but rows, bytes and verifications only in proportion to its members,
whether they are linked or just not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, give_back, mix, release, slices, tokens, word_hashes, written
from .components import components

#: Documents that make an element frequent, the most frequent elements kept, groups of them, set sizes from which combinations serve.
FREQUENT, MOST_FREQUENT, GROUPS, SHORT = 256, 65_536, 64, 128
#: Members of a key in a block; members, and bytes of sets, of a component in a block; ids up to which a side is broadcast.
BLOCK, SET_BLOCK, SET_BYTES, BROADCAST_IDS = 1024, 4096, 16 << 20, 1_000_000
#: Members of a group up to which plain numbers are faster than arrays.
FEW = 24
#: Bits of a sketch for each element that a linked set may miss: those that travel with the keys, those made of whole sets.
NARROW, WIDE = 5, 64


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(size of each text's set, the sets' 64-bit elements, rising within each text).

    Lower-cases A-Z; a text of fewer than k words is one element, a text without words has none.
    """
    counts, codes, words = tokens(texts)
    h = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    rows, starts = np.repeat(np.arange(len(counts)), counts), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    left = np.repeat(starts + counts, counts) - np.arange(len(h))  # words from here to the text's end
    full = np.flatnonzero(left >= k)
    elements = mix(*[h[full + j] for j in range(k)], seed=k)
    owner = rows[full]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = np.array([xxhash.xxh3_64_intdigest(h[starts[i] : starts[i] + counts[i]].tobytes(), seed=1) for i in short], np.uint64)
        elements, owner = np.concatenate([elements, own]), np.concatenate([owner, short])
    order = np.lexsort((elements, owner))
    elements, owner = elements[order], owner[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (elements[1:] != elements[:-1])
    return np.bincount(owner[keep], minlength=len(counts)), elements[keep]


def frequent_elements(docs: DataFrame, k: int, text_col: str = "text") -> np.ndarray:
    """The most frequent elements, at most MOST_FREQUENT, rising.

    A task passes on what it met in more than one document of a slice, at most 8192 elements a
    slice: an element missed here only costs time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                unique, count = np.unique(shingle_sets(piece.column(0), k)[1], return_counts=True)
                top = np.argsort(-count, kind="stable")[:8192]
                top = top[count[top] > 1]
                yield pa.RecordBatch.from_arrays([pa.array(unique[top].view(np.int64)), pa.array(count[top].astype(np.int64))], names=["h", "c"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
    return np.sort(np.array([r["h"] for r in found.orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).collect()], np.int64).view(np.uint64))


def allowed(n: int, t: tuple[int, int]) -> int:
    """Elements of a set of n that a similar set may miss: n - ceil(t n)."""
    return n - -(-n * t[0] // t[1])


def keys(elements: np.ndarray, frequent: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """The index keys of a set: single rare elements, pairs of frequent ones of a group."""
    n = len(elements)
    if not n:
        return np.zeros(0, np.uint64)
    m = allowed(n, t)
    often = np.zeros(n, bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
        often = frequent[at] == elements
    rare = elements[~often]
    if len(rare) > m:
        return rare[: m + 1]
    common = elements[often]
    out = [rare]
    if n <= SHORT:  # single elements of both classes
        out.append(common[: m + 1 - len(rare)])
    if n >= -(-SHORT * t[0] // t[1]):
        need, groups = m + 1 - len(rare), {}
        for e in common.tolist():
            own = groups.setdefault((e >> 7) % GROUPS, [])
            need -= len(own) > 0  # the first of a group proves nothing
            own.append(e)
            if not need:
                break
        for own in groups.values():
            if len(own) > 1:
                i, j = np.triu_indices(len(own), 1)
                a = np.array(own, np.uint64)
                out.append(mix(a[i], a[j], seed=2))
    return np.concatenate(out)


def sketch(elements: np.ndarray, t: tuple[int, int], bits: int = NARROW) -> bytes:
    """Parities of the number of elements in each of W classes, W the power of two from bits * (1 - t) n on, at least 64.

    With 5 bits or more that is more than twice the elements in which linked sets differ, so sets that differ in many more stand out.
    """
    size = 64
    while size * t[1] < bits * (t[1] - t[0]) * len(elements):
        size *= 2
    return np.packbits((np.bincount((elements & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _fold(x: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return x


def _most_apart(a: int, b: int, t: tuple[int, int]) -> int:
    """The most elements in which sets of sizes a and b may differ and still reach t; negative if their sizes already say no."""
    if min(a, b) * t[1] < max(a, b) * t[0]:
        return -1
    # t <= i / (a + b - i)  =>  i >= t (a + b) / (1 + t)
    return a + b - 2 * -(-(a + b) * t[0] // (t[0] + t[1]))


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> int:
        """The root of both from now on."""
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
        return a

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges that join each tree's members: a tree of degree 9 at most, so no member has many rows."""
        if not self.up:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        members = np.fromiter(self.up, np.int64, len(self.up))
        roots = np.fromiter((self.find(x) for x in self.up), np.int64, len(self.up))
        members, roots = np.concatenate([members, np.unique(roots)]), np.concatenate([roots, np.unique(roots)])
        order = np.lexsort((members, roots))
        members, roots = members[order], roots[order]
        keep = np.concatenate([[True], members[1:] != members[:-1]])
        members, roots = members[keep], roots[keep]
        first = np.flatnonzero(np.concatenate([[True], roots[1:] != roots[:-1]]))
        start = np.repeat(first, np.diff(np.append(first, len(members))))
        nth = np.arange(len(members)) - start
        own = nth > 0
        return members[(start + (nth - 1) // 8)[own]], members[own]


def _join_group(forest: _Forest, ids: list[int], sizes: list[int], sketches: list[bytes], side: list[int] | None, t: tuple[int, int], exact=None) -> None:
    """Joins members whose sketches allow a link (and for which exact(i, j) holds); with side, only members of different sides meet.

    Members that are joined already are not compared any more.
    """
    roots = [forest.find(x) for x in ids]
    if len(set(roots)) == 1:
        return
    if len(ids) <= FEW:
        bits, whole = [8 * len(x) for x in sketches], [int.from_bytes(x, "little") for x in sketches]
        for i in range(len(ids)):
            for j in range(i):
                if roots[i] != roots[j] and (side is None or side[i] != side[j]) and (most := _most_apart(sizes[i], sizes[j], t)) >= 0:
                    w = min(bits[i], bits[j])
                    if (_fold(whole[i], bits[i], w) ^ _fold(whole[j], bits[j], w)).bit_count() <= most and (exact is None or exact(i, j)):
                        low, old = forest.join(ids[i], ids[j]), (roots[i], roots[j])
                        roots = [low if r in old else r for r in roots]
        return
    root = np.array(roots, np.int64)
    size, where = np.array(sizes, np.int64), None if side is None else np.array(side)
    width = np.array([len(x) for x in sketches])
    rows_of = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    matrix = {w: np.frombuffer(b"".join([sketches[i] for i in rows]), np.uint64).reshape(len(rows), -1) for w, rows in rows_of.items()}
    for w, rows in rows_of.items():
        targets = [(rows, matrix[w])]
        other = w
        while (other := other * 2) <= max(rows_of) and other <= 4 * w:  # sizes that may link differ by less
            if other in rows_of:
                f = matrix[other]
                while f.shape[1] > matrix[w].shape[1]:
                    f = f[:, : f.shape[1] // 2] ^ f[:, f.shape[1] // 2 :]
                targets.append((rows_of[other], f))
        for at, i in enumerate(rows):
            for cols, m in targets:
                if cols is rows:
                    cols, m = cols[:at], m[:at]
                ok = root[cols] != root[i]
                if where is not None:
                    ok &= where[cols] != where[i]
                both = size[cols] + size[i]
                # t <= shared / (both - shared)  =>  shared >= t both / (1 + t)
                most = both - 2 * -(-(both * t[0]) // (t[0] + t[1]))
                ok &= np.abs(size[cols] - size[i]) <= most
                near = np.flatnonzero(ok)
                if not len(near):
                    continue
                near = near[np.bitwise_count(m[near] ^ matrix[w][at]).sum(1, dtype=np.int64) <= most[near]]
                for j in cols[near]:
                    if root[i] != root[j] and (exact is None or exact(i, j)):
                        low, old = forest.join(ids[i], ids[j]), (root[i], root[j])
                        root[(root == old[0]) | (root == old[1])] = low


def _met(rows: DataFrame, group: str, needed: list[str], close) -> DataFrame:
    """(a, b): the edges of the forests that close(forest, rows of a group and block) joins; rows have group, m (blocks of the group), rep and needed.

    A group's members are dealt into its blocks, and each two blocks meet in a task of their own.
    """
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        held: list[tuple] = []
        seen: set[tuple] = set()  # repeated rows of a document
        now = None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "block", "rep", *needed)], strict=True):
                if (row[0], row[1] >> 1) != now:
                    if len(held) > 1:
                        close(forest, held)
                    now, held, seen = (row[0], row[1] >> 1), [], set()
                if row not in seen:
                    seen.add(row)
                    held.append(row[1:])
        if len(held) > 1:
            close(forest, held)
        a, b = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        held = seen = forest = None
        give_back()

    own, other = F.col("own"), F.col("other")
    dealt = rows.withColumnRenamed(group, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("m")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    pair = F.shiftleft(F.least(own, other), 31).bitwiseOR(F.greatest(own, other))
    dealt = dealt.select("key", "rep", *needed, (pair * 2 + (own >= other).cast("bigint")).alias("block"))  # the last bit: the side
    dealt = dealt.withColumn("pair", F.shiftright("block", 1)).repartition("key", "pair").sortWithinPartitions("key", "pair").drop("pair")
    return dealt.mapInArrow(meet, "a bigint, b bigint").distinct()


def _sides(held: list[tuple]) -> list[int] | None:
    """Sides of rows whose first field is the block; none if the block meets itself."""
    block = held[0][0] >> 1
    return None if block >> 31 == (block & (2**31 - 1)) else [x[0] & 1 for x in held]


def _candidates(members: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Edges that connect all members (key, m, rep, n, sketch) that share a key and whose sketches allow a link."""

    def close(forest: _Forest, held: list[tuple]) -> None:
        _join_group(forest, [x[1] for x in held], [x[2] for x in held], [x[3] for x in held], _sides(held), t)

    return _met(members.withColumn("m", F.ceil(F.col("m") / BLOCK)), "key", ["n", "sketch"], close)


def _verified(groups: DataFrame, docs: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """Edges that connect all ids (id, component) that have a component in common and whose sets reach t. docs: id and text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                n, elements = shingle_sets(piece.column("text"), k)
                own = np.split(elements, np.cumsum(n)[:-1])
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("component"), piece.column("m"), pa.array([x.tobytes() for x in own], pa.binary())], names=["rep", "component", "m", "s"])
        give_back()

    def close(forest: _Forest, held: list[tuple]) -> None:
        own = [np.frombuffer(x[2], np.uint64) for x in held]

        def exact(i: int, j: int) -> bool:
            shared = len(np.intersect1d(own[i], own[j], assume_unique=True))
            return shared * t[1] >= (len(own[i]) + len(own[j]) - shared) * t[0]

        _join_group(forest, [x[1] for x in held], [len(x) for x in own], [sketch(x, t, WIDE) for x in own], _sides(held), t, exact)

    sizes = groups.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n") * 8 / SET_BYTES)).alias("m"))
    wanted = written(groups.join(sizes, "component").select("id", "component", "m"), "dup-groups")
    n = wanted.count()
    texts = docs.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "id")
    found = written(_met(texts.mapInArrow(sets, "rep bigint, component bigint, m bigint, s binary"), "component", ["s"], close), "dup-linked")
    discard(wanted)
    return found


def near_duplicates(docs: DataFrame, k: int = 5, t: tuple[int, int] = (8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, representative (least id with an equal set), component_id (least id reachable by links).

    Two documents link if the Jaccard similarity of their sets of k-word shingles is at least
    t[0] / t[1]. Null, empty and blank texts have no shingles and link with nothing. Rows of
    equal ids are one document in as many versions, linked with each other; rows without an id
    keep null representatives and components. A very long text is a slice of its own. An empty
    table gives an empty result. Other columns of docs are not read.
    """
    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    frequent = frequent_elements(base, k)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                n, elements = shingle_sets(piece.column("text"), k)
                own = np.split(elements, np.cumsum(n)[:-1])
                found = [keys(x, frequent, t).view(np.int64) for x in own]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id"), pa.array(n.astype(np.int32)), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found))), pa.array([sketch(x, t) for x in own], pa.binary()),
                    ],
                    names=["id", "n", "digest", "keys", "sketch"],
                )
        give_back()

    rows = written(base.mapInArrow(describe, "id bigint, n int, digest binary, keys array<bigint>, sketch binary"), "dup-docs")
    classes = written(rows.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "dup-classes")
    release(spark)
    named = rows.select("id", "n", "digest").join(classes.select("digest", "rep"), "digest", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    named = written(named, "dup-named")
    discard(rows)
    # versions of a document: ids with several representatives
    several = named.where("n > 0 and id is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("id", "a")
    versions = written(named.where("n > 0").join(several, "id").where("a < rep").select("a", F.col("rep").alias("b")).distinct(), "dup-versions")
    index = classes.select("rep", F.explode("keys").alias("key"))
    members = written(index.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1"), "dup-members")
    release(spark)
    near = written(_candidates(members.join(classes.select("rep", "n", "sketch"), "rep"), t), "dup-near")
    discard(members)
    release(spark)
    groups = components(near)
    sized = classes.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"))
    linked = _verified(groups.join(sized, "id"), base.where("id is not null"), k, t)
    discard(near, classes)
    release(spark)
    labels = components(linked.unionByName(versions))
    out = named.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("rep").alias("representative"), F.coalesce("component", "rep").alias("component_id"))
