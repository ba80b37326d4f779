"""Graphs: triangles, degrees, spectral pieces, balanced partitions."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.text import settled

#: Bytes of packed neighbours in a range of vertices; a task of common_neighbors holds two ranges.
RANGE = 4_000_000


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z): every triangle once. Edges point from the end of lower degree to the other, which bounds the pairs about a hub."""
    deg = both_ways(edges).groupBy("u").agg(F.count("*").alias("d"))
    e = edges.join(deg.withColumnRenamed("d", "du"), "u").join(deg.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    o = e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("t"))
    wedges = o.alias("a").join(o.alias("b"), F.expr("a.s = b.s AND a.t < b.t")).select(F.col("a.s").alias("x"), F.col("a.t").alias("y"), F.col("b.t").alias("z"))
    return wedges.join(edges.select(F.col("u").alias("y"), F.col("v").alias("z")), ["y", "z"], "left_semi").select("x", "y", "z")


def pack(near: np.ndarray) -> bytes:
    """Sorted longs: the width of a step, the first, then the steps."""
    steps = np.diff(near)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(steps) or int(steps.max()) < 1 << 8 * w)
    return bytes([width]) + near[:1].astype("<i8").tobytes() + steps.astype(f"<u{width}").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, f"<u{packed[0]}", offset=9)
    out = np.empty(len(steps) + 1, np.int64)
    out[0], out[1:] = np.frombuffer(packed, "<i8", 1, 1)[0], steps
    return np.cumsum(out, out=out)


def adjacency(edges: DataFrame) -> DataFrame:
    """(u, near): the sorted neighbours of every vertex, packed, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("near")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("u"), pa.array([pack(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["u", "near"])

    lists = both_ways(edges).groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("near"))
    return settled(lists.mapInArrow(run, "u long, near binary"), "adjacency")


def _common(names: np.ndarray, lists: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v and number of common neighbours of the edges whose ends have the two sides, or of all where there is one side."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    every, flat = np.unique(np.concatenate(lists), return_inverse=True)
    flat = flat.astype(np.int32)
    row_of, mark, two = np.full(len(every), -1, np.int32), np.zeros(len(every), np.uint8), len(np.unique(side)) > 1
    at = np.minimum(np.searchsorted(every, names), len(every) - 1)
    own = every[at] == names
    row_of[at[own]] = np.flatnonzero(own)
    sizes, out = np.diff(starts), []
    for r in range(len(names)):
        near = flat[starts[r] : starts[r + 1]]
        other = row_of[near]
        other = other[other >= 0]
        other = other[(sizes[other] < sizes[r]) | ((sizes[other] == sizes[r]) & (names[other] < names[r]))]
        if two:
            other = other[side[other] != side[r]]
        if not len(other):
            continue
        mark[near] = 1
        n = sizes[other]
        ends = np.cumsum(n)
        found = mark[flat[np.repeat(starts[other] - (ends - n), n) + np.arange(ends[-1])]]
        counts = np.add.reduceat(found, ends - n, dtype=np.int64)
        mark[near] = 0
        some = counts > 0
        u, v = np.full(int(some.sum()), names[r]), names[other[some]]
        out.append((np.minimum(u, v), np.maximum(u, v), counts[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def common_neighbors(edges: DataFrame) -> DataFrame:
    """(u, v, common): the edges u < v with common neighbours, by lists of neighbours; no pair of neighbours becomes a row.

    Vertices are cut into ranges of about RANGE bytes of lists, and a list goes to each range where it has neighbours.
    An edge's shorter list is looked up in the longer one, so the time is in the sum of the shorter lists.
    """
    rows = adjacency(edges)
    size = F.length("near")
    total = rows.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-total // max(min(RANGE, total // 12), RANGE // 40)))
    cuts = np.array(rows.agg(F.percentile("u", [i / parts for i in range(1, parts)], size)).first()[0] if parts > 1 else [])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], [], []
            for u, packed in zip(batch.column("u").to_pylist(), batch.column("near").to_pylist(), strict=True):
                i = int(np.searchsorted(cuts, u))
                for j in np.unique(np.searchsorted(cuts, unpack(packed))).tolist():
                    for x, y in zip(out, (min(i, j), max(i, j), u, packed), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["a", "b", "u", "near"])

    def count(group: pa.Table) -> pa.Table:
        names = group.column("u").to_numpy()
        made = _common(names, [unpack(x.as_py()) for x in group.column("near")], np.searchsorted(cuts, names))
        return pa.table([pa.array(x, pa.int64()) for x in made], names=["u", "v", "common"])

    return rows.mapInArrow(deal, "a int, b int, u long, near binary").groupBy("a", "b").applyInArrow(count, "u long, v long, common long")


def count_triangles(edges: DataFrame) -> DataFrame:
    """(triangles): a triangle is a common neighbour of each of its three edges."""
    return common_neighbors(edges).agg(F.expr("coalesce(sum(common), 0) div 3").alias("triangles"))


def local_triangles(edges: DataFrame) -> DataFrame:
    """(vertex, triangles) of vertices in triangles."""
    ends = common_neighbors(edges).select(F.explode(F.array("u", "v")).alias("vertex"), "common")
    return ends.groupBy("vertex").agg(F.expr("sum(common) div 2").alias("triangles"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("vertex")).agg(F.count("*").alias("degree"))


def affinity(edges: DataFrame) -> DataFrame:
    """(i, j, value) of the normalised affinity 1 / sqrt(d_i d_j)."""
    deg = degrees(edges)
    e = both_ways(edges).join(deg.select(F.col("vertex").alias("u"), F.col("degree").alias("a")), "u").join(deg.select(F.col("vertex").alias("v"), F.col("degree").alias("b")), "v")
    return e.select(F.col("u").alias("i"), F.col("v").alias("j"), (F.lit(1.0) / F.sqrt(F.col("a") * F.col("b") * F.lit(1.0))).alias("value"))


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices, and the least vertex that the edges join each with."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, label = at[: len(u)], at[len(u) :], np.arange(len(names))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y):
            np.minimum.at(new, label[end], least)
            np.minimum.at(new, end, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return names, names[label]
        label = new


def components(rows: DataFrame) -> DataFrame:
    """(u, component) of adjacency rows: the least vertex that paths reach. Tasks join their own lists first, one task what they leave."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [unpack(x) for x in batch.column("near").to_pylist()]
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least(np.repeat(batch.column("u").to_numpy(), [len(x) for x in lists]), np.concatenate(lists))], names=["u", "component"])

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column("u").to_numpy(), b.column("component").to_numpy()) for b in batches]
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least(*map(np.concatenate, zip(*ends, strict=True)))], names=["u", "component"])

    return rows.mapInArrow(own, "u long, component long").distinct().repartition(1).mapInArrow(all_of, "u long, component long")


def _matrix(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, 0/1 matrix and degrees of a component."""
    names = np.sort(group.column("u").to_numpy())
    a = np.zeros((len(names), len(names)))
    for u, near in zip(group.column("u").to_pylist(), group.column("near").to_pylist(), strict=True):
        a[np.searchsorted(names, u), np.searchsorted(names, unpack(near))] = 1.0
    return names, a, a.sum(1)


class _Lists:
    """Neighbours of a component's vertices as places, 4 bytes each: products with vectors, no matrix."""

    def __init__(self, group: pa.Table) -> None:
        u = group.column("u").to_numpy()
        order = np.argsort(u)
        self.names, near = u[order], group.column("near").to_pylist()
        size = np.array([(len(near[i]) - 9) // near[i][0] + 1 for i in order.tolist()])
        self.starts, self.degree = np.concatenate([[0], np.cumsum(size)]), size.astype(float)
        self.places = np.empty(self.starts[-1], np.int32)
        for i, a, b in zip(order.tolist(), self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            self.places[a:b] = np.searchsorted(self.names, unpack(near[i]))
        #: Rows of about four million neighbours, summed at once.
        self.cuts = np.unique(np.concatenate([np.searchsorted(self.starts, np.arange(0, self.starts[-1], 4_000_000)), [len(u)]])).tolist()

    def times(self, x: np.ndarray) -> np.ndarray:
        """The 0/1 matrix by a vector."""
        parts = [np.add.reduceat(x[self.places[self.starts[a] : self.starts[b]]], self.starts[a:b] - self.starts[a]) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        return np.concatenate(parts)

    def affinity(self, x: np.ndarray) -> np.ndarray:
        root = np.sqrt(self.degree)
        return self.times(x / root) / root

    def leading(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k greatest eigenvalues of the affinity and their vectors: the first is known, others follow one by one, equal ones too."""
        first = np.sqrt(self.degree / self.degree.sum())
        values, vectors = [1.0], [first]
        while len(values) < k:
            value, vector = _extreme(self.affinity, np.array(vectors))
            values.append(value)
            vectors.append(vector)
        return np.array(values), np.array(vectors).T

    def least(self) -> float:
        """The least eigenvalue of the affinity."""
        return -_extreme(lambda x: -self.affinity(x), np.sqrt(self.degree / self.degree.sum())[None], vector=False)[0]

    def fiedler(self) -> np.ndarray:
        """The eigenvector of the Laplacian's second eigenvalue."""
        n = len(self.degree)
        return _extreme(lambda x: self.times(x) - self.degree * x, np.full((1, n), 1 / math.sqrt(n)))[1]


def _extreme(product: Callable[[np.ndarray], np.ndarray], known: np.ndarray, vector: bool = True, tol: float = 1e-10) -> tuple[float, np.ndarray | None]:
    """The greatest eigenvalue of a symmetric product beside the known vectors' (rows) and, if wanted, its vector, by Lanczos steps with every vector kept orthogonal.

    Ends where the residual is tol of the spectrum's width, for a value alone its root: the error of a value is in the residual's square. 400 steps at
    most are held at once; then it begins again from the 40 best vectors.
    """
    n = known.shape[1]
    x = np.random.default_rng(0).standard_normal(n)
    hold, keep = min(400, n - len(known)), 40
    q, t, size = np.empty((hold, n)), np.zeros((hold, hold)), 0
    tol = tol if vector else math.sqrt(tol)

    def freed(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - known.T @ (known @ x)
            x = x - q[:size].T @ (q[:size] @ x)
        return x

    x = freed(x)
    for _ in range(100_000):
        q[size] = x / np.linalg.norm(x)
        y = product(q[size])
        size += 1
        t[:size, size - 1] = t[size - 1, :size] = q[:size] @ y
        x = freed(y)
        rest = float(np.linalg.norm(x))
        if size % 20 == 0 or size == hold or rest < 1e-13:
            values, vectors = np.linalg.eigh(t[:size, :size])
            width = max(values[-1] - values[0], abs(values[-1]), 1e-300)
            if rest * abs(vectors[-1, -1]) <= tol * width or size == n - len(known) or rest < 1e-13:
                return float(values[-1]), q[:size].T @ vectors[:, -1] if vector else None
            if size == hold:
                q[:keep] = vectors[:, -keep:].T @ q
                t[:] = 0
                t[range(keep), range(keep)], size = values[-keep:], keep
    raise ArithmeticError("the eigenvalues are too close to each other")


def _by_component(edges: DataFrame, most: int | None, dense: int, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray, dict[int, tuple[float, float]]]:
    """Rows (u, near, component), the eigenvalues of the normalised affinity, greatest first, the components they are of, and the open spans.

    A component of more than `dense` vertices gives its k + 1 greatest eigenvalues and the least one; those between stand as the last
    of the former, and (least, last) is its open span.
    """
    rows = adjacency(edges)
    rows = settled(rows.join(components(rows), "u"), "component")
    n = rows.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if most and n > most:
        raise ValueError(f"a connected piece of {n} vertices; power_iteration() serves those of more than {most}")

    def values(group: pa.Table) -> pa.Table:
        if group.num_rows > dense:
            g = _Lists(group)
            found, low = g.leading(k + 1)[0], g.least()
            own, span = np.concatenate([found, np.full(group.num_rows - len(found) - 1, found[-1]), [low]]), [low, float(found[-1])]
        else:
            names, a, d = _matrix(group)
            own, span = np.linalg.eigvalsh(a / np.sqrt(d[:, None] * d[None, :]))[::-1], None
        return pa.table([pa.array([int(group.column("component")[0].as_py())]), pa.array([own]), pa.array([span], pa.list_(pa.float64()))], names=["component", "own", "span"])

    found = rows.groupBy("component").applyInArrow(values, "component long, own array<double>, span array<double>").orderBy("component").toArrow()
    own = found.column("own").combine_chunks()
    every, of = own.flatten().to_numpy(), np.repeat(found.column("component").to_numpy(), own.value_lengths().to_numpy())
    order = np.lexsort((of, -np.round(every, 9)))
    spans = {c: tuple(x) for c, x in zip(found.column("component").to_pylist(), found.column("span").to_pylist(), strict=True) if x}
    return rows, every[order], of[order], spans


def _gap(values: np.ndarray) -> int:
    return int(np.argmin(np.diff(values))) + 1 if len(values) > 1 else len(values)


def _solved(edges: DataFrame, most: int | None, dense: int, k: int | None) -> tuple[DataFrame, np.ndarray, np.ndarray, int, int]:
    """Rows, eigenvalues, their components, k or the place of the largest drop, and the size from which components were not solved whole.

    A drop outside the open spans is the largest for certain if it is larger than all that are seen, since a span bounds the drops
    in it; otherwise more eigenvalues are taken, and at last all of them.
    """
    take = k or 1
    while True:
        dense = max(dense, 2 * take + 4)
        rows, values, of, spans = _by_component(edges, most, dense, take)
        own = k or _gap(values)
        inside = not k and own < len(values) and any(low <= values[own] and values[own - 1] <= high for low, high in spans.values())
        if not spans or not inside and all((of[:own] == c).sum() <= take + 1 for c in spans):
            return rows, values, of, own, dense
        take, dense = 4 * take, dense if take < 16 else max(len(values), dense)


def eigengap(edges: DataFrame, most: int | None = None, dense: int = 4000) -> DataFrame:
    """(eigengap_k): the place of the largest drop of the eigenvalues of all components together."""
    _, values, _, own, _ = _solved(edges, most, dense, None)
    return edges.sparkSession.createDataFrame([(own,)] if len(values) else [], "eigengap_k long")


def spectrum(edges: DataFrame, k: int | None = None, most: int | None = None, dense: int = 4000) -> DataFrame:
    """(vertex, cluster, fiedler, eigengap_k): the spectrum of a graph is that of its components, which are solved apart, one a task.

    Components of more than `dense` vertices are solved by Lanczos steps on lists of neighbours, the others by a dense eigensolve.
    Rows of the k leading eigenvectors are normalised and split by a seeded Lloyd iteration in one task that holds vertices, not edges; k is
    the place of the largest drop of the eigenvalues unless given. Equal eigenvalues of several components are taken by the components' least
    vertices. With several components the second eigenvector of the Laplacian is not unique: the one that parts the first component from the
    rest is given. A component of more than `most` vertices is an error where most is given.
    """
    rows, values, of, own, dense = _solved(edges, most, dense, k)
    first, several, n = (int(of.min()) if len(of) else 0), len(set(of.tolist())) > 1, len(of)
    columns: dict[int, list[int]] = {}
    for i, c in enumerate(of[:own].tolist()):
        columns.setdefault(c, []).append(i)

    def solve(group: pa.Table) -> pa.Table:
        c = int(group.column("component")[0].as_py())
        names, at = np.sort(group.column("u").to_numpy()), columns.get(c, [])
        lead = np.zeros((len(names), 0))
        large = len(names) > dense
        if at or not several:
            if large:
                lists = _Lists(group)
            else:
                names, a, d = _matrix(group)
        if at:
            lead = lists.leading(len(at))[1] if large else np.linalg.eigh(a / np.sqrt(d[:, None] * d[None, :]))[1][:, ::-1][:, : len(at)]
        if several:
            m = int((of == first).sum())
            fiedler = np.full(len(names), math.sqrt((n - m) / (n * m)) if c == first else -math.sqrt(m / (n * (n - m))))
        else:
            fiedler = lists.fiedler() if large else np.linalg.eigh(np.diag(d) - a)[1][:, 1]
        return pa.table([pa.array(names), pa.array([at] * len(names), pa.list_(pa.int32())), pa.array(list(lead), pa.list_(pa.float64())), pa.array(fiedler)], names=["vertex", "at", "x", "fiedler"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        if not got.num_rows:
            return
        x = np.zeros((n, min(own, n)))
        for i, (at, row) in enumerate(zip(got.column("at").to_pylist(), got.column("x").to_pylist(), strict=True)):
            x[i, at] = row
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(0)
        centers = x[rng.choice(len(x), x.shape[1], replace=False)]
        step = max(1, 4_000_000 // x.shape[1] ** 2)
        for _ in range(100):
            label = np.concatenate([((x[i : i + step, None] - centers[None]) ** 2).sum(2).argmin(1) for i in range(0, n, step)])
            moved = np.array([x[label == c].mean(0) if (label == c).any() else centers[c] for c in range(x.shape[1])])
            if np.allclose(moved, centers):
                break
            centers = moved
        yield pa.RecordBatch.from_arrays([got.column("vertex").combine_chunks(), pa.array(label.astype(np.int64)), got.column("fiedler").combine_chunks(), pa.array(np.full(n, own, np.int64))], names=["vertex", "cluster", "fiedler", "eigengap_k"])

    parts = rows.groupBy("component").applyInArrow(solve, "vertex long, at array<int>, x array<double>, fiedler double")
    return parts.repartition(1).sortWithinPartitions("vertex").mapInArrow(split, "vertex long, cluster long, fiedler double, eigengap_k long")


def power_iteration(edges: DataFrame, k: int) -> DataFrame:
    """(vertex, cluster) by Spark's power iteration clustering, for graphs of any size."""
    from pyspark.ml.clustering import PowerIterationClustering

    pic = PowerIterationClustering(k=k, maxIter=20, initMode="degree", srcCol="u", dstCol="v")
    return pic.assignClusters(edges.select("u", "v")).select(F.col("id").alias("vertex"), F.col("cluster").cast("long").alias("cluster"))


# Balanced partitions


def first_color(policy: str, id_col: str, k: int, n: Column | int | None = None) -> Column:
    c = F.col(id_col)
    if policy == "ROUND_ROBIN":
        return c % k
    if policy == "BATCH":  # the least i with id <= (i + 1) n / k
        return (F.ceil(c * k / (n if isinstance(n, Column) else F.lit(n))) - 1).cast("long")
    return F.pmod(F.xxhash64(c), F.lit(k)).cast("long")


def edge_cut(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """(edge_cut): undirected edges between colors. colors: (id, color)."""
    e = edges.join(colors.select(F.col("id").alias("u"), F.col("color").alias("a")), "u").join(colors.select(F.col("id").alias("v"), F.col("color").alias("b")), "v")
    return e.agg(F.coalesce(F.sum((F.col("a") != F.col("b")).cast("long")), F.lit(0)).alias("edge_cut"))


def degrees_by_color(edges: DataFrame, colors: DataFrame) -> DataFrame:
    e = both_ways(edges).join(colors.select(F.col("id").alias("v"), "color"), "v")
    return e.groupBy(F.col("u").alias("id"), "color").agg(F.count("*").alias("degree"))


class Annealer:
    """Temperature schedules and acceptance: LINEAR cools by subtraction to 1, EXP and CUSTOM by a factor from 1 or less."""

    def __init__(self, kind: str, t: float, delta: float) -> None:
        self.kind, self.start, self.delta = kind, t, delta
        self.t = t if kind == "LINEAR" else min(1.0, t)

    def cool(self) -> None:
        self.t = max(1.0, self.t - self.delta) if self.kind == "LINEAR" else self.t * self.delta

    def accepts(self, old: float, new: float, draw: float) -> bool:
        if self.kind == "LINEAR":
            return float(self.t * new > old) > draw
        x = (new - old) / max(self.t, 1e-12)
        p = math.exp(min(x, 50.0)) if self.kind == "EXP" else 1.0 / (1.0 + math.exp(-max(min(x, 50.0), -50.0)))
        return p > draw


def schedule(kind: str, t: float, delta: float, rounds: int, restart: int = -1) -> list[float]:
    a, out = Annealer(kind, t, delta), []
    for r in range(rounds):
        a.cool()
        if restart > 0 and r % restart == 0:
            a.t = t
        out.append(a.t)
    return out


def swap_partition(edges: DataFrame, k: int = 4, rounds: int = 50, policy: str = "HYBRID", init: str = "ROUND_ROBIN", annealer: str = "LINEAR", t: float = 2.0, delta: float = 0.003, alpha: float = 2.0, neighbors: int = 3, samples: int = 6, restart: int = -1, seed: int = 0) -> DataFrame:
    """(round, edge_cut, swaps, migrations): balanced k-way partition by swapping colors.

    A swap is seen by the next vertex of the round, so a graph is one sequential task by nature;
    independent graphs need a call each. Colors only change places, so the partition's sizes
    never change. The task holds 4 to 12 bytes a neighbour and the neighbours' colors counted.
    """
    if restart == 0:
        raise ValueError("restart: a positive number of rounds, or -1 for none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packed = [], []
        for batch in batches:
            ids += batch.column("u").to_pylist()
            packed += batch.column("near").to_pylist()
        if not ids:
            return
        rng, names, n = random.Random(seed), np.array(ids), len(ids)
        near = []  # places in ids
        for i in range(n):
            near.append(np.searchsorted(names, unpack(packed[i])).astype(np.int32))
            packed[i] = None
        color = [x % k if init == "ROUND_ROBIN" else -(-(i + 1) * k // n) - 1 if init == "BATCH" else rng.randrange(k) for i, x in enumerate(ids)]
        first, a, swaps, out = list(color), Annealer(annealer, t, delta), 0, []
        #: Neighbours of every color, kept up to date by the swaps; lists that fill an eighth of their span are added as rows of it.
        degree, colored = np.zeros((k, n), np.int32), np.array(color)
        for i, own in enumerate(near):
            degree[:, i] = np.bincount(colored[own], minlength=k)
        lines, dense = list(degree), [None] * n
        for i, own in enumerate(near):
            lo, hi = int(own[0]), int(own[-1]) + 1
            if hi - lo <= 8 * len(own):
                row = np.zeros(hi - lo, np.int8)
                row[own - lo] = 1
                dense[i] = lo, hi, row

        def recolor(x: int, was: int, now: int) -> None:
            if dense[x] is None:  # neighbours are distinct
                lines[was][near[x]] -= 1
                lines[now][near[x]] += 1
            else:
                lo, hi, row = dense[x]
                for line, do in ((lines[was][lo:hi], np.subtract), (lines[now][lo:hi], np.add)):
                    do(line, row, out=line)

        def partner(p: int, nodes: list[int]) -> int | None:
            best, top, mine = None, -1.0, degree[:, p].tolist()
            for q in nodes:
                other = degree[:, q].tolist()
                old = mine[color[p]] ** alpha + other[color[q]] ** alpha
                new = mine[color[q]] ** alpha + other[color[p]] ** alpha
                if a.accepts(old, new, rng.random()) and new > top:
                    best, top = q, new
            return best

        for r in range(rounds):
            for p in range(n):
                q = None
                if policy in ("HYBRID", "LOCAL"):
                    q = partner(p, [int(near[p][j]) for j in rng.sample(range(len(near[p])), min(neighbors, len(near[p])))])
                if q is None and policy in ("HYBRID", "RANDOM"):
                    q = partner(p, [x for x in rng.sample(range(n), min(samples + 1, n)) if x != p][:samples])
                if q is not None:
                    if color[p] != color[q]:
                        recolor(p, color[p], color[q])
                        recolor(q, color[q], color[p])
                        color[p], color[q] = color[q], color[p]
                    swaps += 1
            a.cool()
            if restart > 0 and r % restart == 0:
                a.t = t
            cut = int(degree.sum(dtype=np.int64) - degree[color, np.arange(n)].sum(dtype=np.int64)) // 2
            out.append((r, cut, swaps, sum(x != y for x, y in zip(color, first, strict=True))))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4, names=["round", "edge_cut", "swaps", "migrations"])

    rows = adjacency(edges).repartition(1).sortWithinPartitions("u")
    return rows.mapInArrow(run, "round long, edge_cut long, swaps long, migrations long")
