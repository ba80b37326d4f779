"""Every query that SQL can express equals its DuckDB twin; the others hold their invariants."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from minekit.operators import baskets as A
from minekit.operators import graph as G
from minekit.operators import similarity as S
from minekit.plans import registry
from minekit.streaming.triest import Triest, estimate

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def spelt(df, columns):
    out = df[columns].astype(str).replace({"None": "nan", "NaT": "nan", "<NA>": "nan", "-0.0": "0.0"})
    return sorted(map(tuple, out.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert spelt(got, columns) == spelt(want, columns)


def test_shingles_drop_the_last(spark):
    from minekit.functions.expr import shingles

    df = spark.createDataFrame([("abcdef",), ("abc",), ("abcde",)], "t string").select(shingles(F.col("t"), 5).alias("s"))
    assert [r["s"] for r in df.collect()] == [["abcde"], [], []]


def test_logit_outside_zero_and_one_equals_sql(spark, tmp_path):
    values = [0.0, 1e-6, 250.0, 499.99999, 500.0, 560.21, -1.0, None]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(registry.ORACLE["fn_logit"]).fetchall()
    assert repr(sorted(map(tuple, registry.QUERIES["fn_logit"](spark, str(tmp_path)).collect()))) == repr(sorted(want))


def test_logit_query_clips(spark, tmp_path):
    values = [0.0, 500.0, 560.21, -1.0, 250.0, None]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = [r["z"] for r in registry.QUERIES["fn_logit"](spark, str(tmp_path)).orderBy("event_id").collect()]
    assert got == [-16.118096, 16.118096, 16.118096, -16.118096, 0.0, None]


def test_exact_pairs_equal_brute_force(spark, sf):
    sets = S.shingled(spark.read.parquet(f"{sf}/documents.parquet"))
    got = {(r["a"], r["b"]) for r in S.exact_pairs(sets, 0.8).collect()}
    own = {r["id"]: set(r["items"]) for r in sets.collect()}
    ids = sorted(own)
    assert got == {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(own[a] & own[b]) > 0.8 * len(own[a] | own[b])}


def test_copies_are_counted_and_pairs_found_over_all_sizes(spark):
    """Near sets of very different sizes, across ranges, and a group of copies that makes no row a pair."""
    import random

    rng, own, at = random.Random(5), {}, 0
    for n in [1, 2, 3, 5, 6, 9, 10, 40, 60, 64, 65, 120, 129, 700, 1000, 3000] * 3:
        base = rng.sample(range(2**31 - 1), n)
        for miss in (0, 1, 2, n // 10, n // 9, n // 8, n // 5):
            own[at] = set(base[: n - miss]) or set(base)
            at += 1
    copies = {at + i: set(range(50)) for i in range(400)}
    own |= copies
    ids = sorted(own)
    sets = spark.createDataFrame([(i, sorted(x)) for i, x in own.items()], "id long, items array<long>")
    want = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(own[a] & own[b]) > 0.8 * len(own[a] | own[b])}
    want = {p: j for p, j in want.items() if j > 0.8}
    assert {(r["a"], r["b"]): r["jaccard"] for r in S.exact_pairs(sets, 0.8).collect()} == want
    assert sum(r["n"] for r in S.pair_counts(sets, 0.8).collect()) == len(want)
    got = {(r["a"], r["b"]): r["jaccard"] for r in S.representative_pairs(sets, 0.8).collect()}
    assert all(want[p] == j for p, j in got.items()) and sum(a in copies for a, _ in got) == len(copies) - 1


def test_bands_are_counted_as_their_pairs(spark, monkeypatch):
    """Buckets of few rows, copies, near copies and signatures with common bands; no pair becomes a row."""
    rng = np.random.default_rng(3)
    sigs = rng.integers(0, 6, (250, 20)) + 6 * rng.integers(0, 3, (250, 1))
    near = np.repeat(rng.integers(0, 2**31 - 1, (3, 20)), 40, 0)
    for row in near:
        at = rng.integers(0, 20, rng.integers(0, 7))
        row[at] = rng.integers(0, 50, len(at))
    sigs = np.concatenate([sigs, near, near[:30], sigs[:20]])
    same = sigs[:, None] == sigs[None]
    up = np.triu(np.ones(same.shape[:2], bool), 1)
    want = {}
    for bands in (4, 5, 6, 10):
        own = np.add.reduceat(sigs, np.arange(0, 20, -(-20 // bands)), 1)
        met = (own[:, None] == own[None]).any(2) & up
        want[bands] = int(met.sum()), int((met & (same.sum(2) / 20 >= 0.8)).sum())
    classes = spark.createDataFrame([(x.astype("<i4").tobytes(),) for x in sigs], "sig binary").groupBy("sig").agg(F.count("*").alias("w"))
    monkeypatch.setattr(S, "BUCKET", 100)
    assert S.band_counts(classes, 20, 0.8, (4, 5, 6, 10)) == want
    assert S.band_counts(classes, 20, 0.05, (4,))[4][1] > 0 and S.band_counts(classes.where("w < 0"), 20, 0.8, (4,)) == {4: (0, 0)}
    with pytest.raises(ValueError):
        S.band_counts(classes, 20, 0.0, (4,))
    monkeypatch.setattr(S, "COMPARED", 5000)  # some 60 pairs at once
    pieces = [slice(a, a + 4) for a in range(0, 20, 4)]
    equal = np.stack([same[:, :, x].all(2) for x in pieces], 2)
    for first in range(4):
        met = sorted((min(p), max(p)) for x, y in S._close(sigs, pieces, first, 2) for p in zip(x.tolist(), y.tolist(), strict=True))
        assert met == [tuple(p) for p in np.argwhere((equal.sum(2) >= 2) & (equal.argmax(2) == first) & up).tolist()]


def test_sweep_counts_what_lsh_joins_and_reads_wide_characters(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sigs = S.signatures(S.shingled(docs), 20)
    for r in registry.QUERIES["txt_sweep"](spark, sf).collect():
        pairs = [x["similarity"] for x in S.lsh(sigs, 20, 0.0, r["bands"]).collect()]
        assert (r["candidates"], r["found"]) == (len(pairs), sum(x >= 0.8 for x in pairs))
    rng = np.random.default_rng(5)
    wide = ["".join(map(chr, rng.choice([*range(97, 123), 0x1F600, 0x1F601, 0x10FFFF], n))) for n in (0, 5, 6, 40, 300)]
    many = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, n))) for n in (9000, 3000, 3000)]
    for texts in (wide + many, many + wide, [*many, "".join(wide) * 3]):
        assert all(np.array_equal(x, S._codes(y, 5)) for x, y in zip(S._Coder(5)(texts), texts, strict=True))
    spark.createDataFrame([(i, x) for i, x in enumerate([None, "", wide[4], wide[4], wide[4][:-1] + "!"])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(S, "lsh", None)  # its pairs are rows
    assert {tuple(r)[1:] for r in registry.QUERIES["txt_sweep"](spark, str(tmp_path)).collect()} == {(3, 3, 3)}


def test_pairs_of_texts_equal_pairs_of_shingles(spark):
    base = "naïve words of a text, lines\nand more; " * 3
    texts = [base + str(i) * (i % 4) for i in range(12)] + [base, "", "abcde", "abcdef", "abcdef", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, S.representative_pairs(S.shingled(docs), 0.8).collect()))
    assert want == sorted(map(tuple, S.representative_pairs(docs.withColumnRenamed("doc_id", "id"), 0.8).collect())) and (14 + 1, 16, 1.0) in want


def test_distribution_is_of_all_pairs(spark, sf, monkeypatch):
    own = [set(r["items"]) for r in S.shingled(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    want = {}
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            at = int(len(a & b) / len(a | b) * 50)
            want[at] = want.get(at, 0) + 1
    for size in (8000, 10):
        monkeypatch.setattr(S, "BLOCK", size)
        assert {r["bin"]: r["n"] for r in registry.QUERIES["txt_similarity_dist"](spark, sf).collect()} == want
    assert min(want) < 40 and sum(want.values()) == len(own) * (len(own) - 1) // 2


def test_different_texts_of_one_set_are_all_linked(spark, tmp_path):
    base = "some words that make a text of some length, "
    texts = [base + "x1", base + "x2", base + "x3", base + "x1", base[:-1] + "!yz", "other", base + "x2", "quite another text"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets = [{x[i : i + 5] for i in range(len(x) - 5)} for x in texts]
    first = {x: texts.index(x) for x in texts}
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(8) for b in range(a + 1, 8) if sets[a] and sets[b]}
    want = {(a, b): j for (a, b), j in likeness.items() if j > 0.8 and (texts[a] == texts[b] and first[texts[a]] == a or texts[a] != texts[b] and first[texts[a]] == a and first[texts[b]] == b)}
    got = registry.QUERIES["txt_exact_pairs"](spark, str(tmp_path)).collect()
    assert {(r["a"], r["b"]): r["jaccard"] for r in got} == want and len(got) == len(want) and (1, 2) in want and (1, 4) in want


def test_rules_of_any_consequent(spark):
    baskets = spark.createDataFrame([(b, i) for b in range(10) for i in "xyz"], "basket long, item string")
    sets = A.apriori(baskets, 5)
    assert sets.count() == 7
    assert A.rules(sets, 0.1).count() == 12
    assert A.apriori(baskets, 10).count() == 0  # support is strict


def test_itemsets_of_every_level_in_a_small_plan(spark):
    import random
    from itertools import combinations

    rng = random.Random(3)
    own = [sorted(rng.sample("abcdefgh", rng.randint(1, 8))) for _ in range(60)]
    sets = A.apriori(spark.createDataFrame([(b, i) for b, items in enumerate(own) for i in items], "basket long, item string"), 8)
    want = {}
    for items in own:
        for k in range(1, 9):
            for c in combinations(items, k):
                want[c] = want.get(c, 0) + 1
    assert {tuple(r["items"]): (r["k"], r["support"]) for r in sets.collect()} == {c: (len(c), n) for c, n in want.items() if n > 8}
    assert max(r["k"] for r in sets.collect()) > 4
    assert len(A.rules(sets, 0.1)._jdf.queryExecution().toString()) < 200_000


def test_common_neighbors_over_ranges_equal_sets(spark, monkeypatch):
    import random

    rng = random.Random(1)
    near, edges = {}, {tuple(sorted(rng.sample(range(-40, 40), 2))) for _ in range(600)} | {(-7, 10**12 + i) for i in range(50)} | {(10**12, 10**12 + 9)}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    want = {(u, v): len(near[u] & near[v]) for u, v in edges if near[u] & near[v]}
    df = spark.createDataFrame(sorted(edges), "u long, v long")
    for size in (G.RANGE, 400):
        monkeypatch.setattr(G, "RANGE", size)
        assert {(r["u"], r["v"]): r["common"] for r in G.common_neighbors(df).collect()} == want
    assert G.count_triangles(df).first()["triangles"] == G.triangles(df).count() == sum(want.values()) // 3
    local = {r["vertex"]: r["triangles"] for r in G.local_triangles(df).collect()}
    assert local == {x: n for x in near if (n := sum(c for e, c in want.items() if x in e) // 2)}
    assert G.count_triangles(df.limit(0)).first()["triangles"] == 0


def test_reservoir_large_enough_is_exact(spark):
    edges = spark.createDataFrame([(i, j) for i in range(12) for j in range(i + 1, 12) if (i * j) % 3], "u long, v long")
    exact = G.triangles(edges).count()
    for improved in (False, True):
        assert estimate(edges, 1000, improved).first()["estimate"] == exact
    with pytest.raises(ValueError):
        Triest(2)


def test_streams_are_read_in_batches(spark, monkeypatch):
    """A task never gets its stream as one frame, and counts without a step for every triangle."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", None)
    edges = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, 40)], "u long, v long")
    whole = Triest(100, True, 1)
    for u, v in sorted(map(tuple, edges.collect())):
        whole.add(u, v)
    got = estimate(edges, 100, True, 1).first()
    assert got["edges"] == 780 and abs(got["estimate"] - whole.estimate) < 1e-6 * whole.estimate
    assert abs(sum(whole.local.values()) / 3 - whole.tau) < 1e-6 * whole.tau
    assert Triest(100, local=False).local is None
    four = estimate(edges, 1000, streams=4).collect()
    assert len(four) == 4 and sum(r["edges"] for r in four) == 780


def test_a_full_reservoir_counts_at_once(spark):
    """No step an edge where the reservoir holds the stream; repeats, loops and both directions; draws go on behind a fill as without it."""
    import random

    rng = random.Random(6)
    edges = [(rng.randrange(-20, 60), rng.randrange(-20, 60)) for _ in range(3000)] + [(2**40, 2**40 + 1), (2**40 + 1, -3), (-3, 2**40)]
    us, vs = (np.array(x) for x in zip(*edges, strict=True))
    for improved in (False, True):
        one, full, wide = Triest(None, improved, local=False), Triest(None, improved, local=False), Triest(None, improved)
        one.extend(us.tolist(), vs.tolist())
        full.fill(us, vs, True)
        wide.fill(us, vs)
        assert one.estimate == full.estimate == wide.estimate > 0 and one.t == full.t == wide.t and not full.near
        for m in (3, 100, 700, 5000):
            step, quick = Triest(m, improved, 4, local=False), Triest(m, improved, 4, local=False)
            step.extend(us.tolist(), vs.tolist())
            quick.fill(us[:m], vs[:m])
            quick.extend(us[m:].tolist(), vs[m:].tolist())
            assert (step.t, step.tau, step.us, step.vs) == (quick.t, quick.tau, quick.us, quick.vs)
        df = spark.createDataFrame(sorted({(min(e), max(e)) for e in edges if e[0] != e[1]}), "u long, v long")
        assert tuple(estimate(df, None, improved).first()) == (0, one.t, one.tau)
        assert sum(r["edges"] for r in estimate(df, None, improved, streams=3).collect()) == one.t
    with pytest.raises(ValueError):
        Triest(3).fill(us[:4], vs[:4])


def test_swaps_keep_sizes_and_cut_edges(spark):
    edges = spark.createDataFrame([(i, j) for c in range(4) for i in range(c * 8, c * 8 + 8) for j in range(i + 1, c * 8 + 8)], "u long, v long")
    log = G.swap_partition(edges, rounds=20).toPandas()
    assert len(log) == 20 and log["edge_cut"].iloc[-1] < log["edge_cut"].iloc[0] + 1
    with pytest.raises(ValueError):
        G.swap_partition(edges, restart=0)


def test_swaps_hold_no_frame_of_edges_and_count_the_cut(spark, monkeypatch):
    """Cut and numbers of swaps of a plain run over lists in order; the edges are never one frame in a task."""
    import random
    from collections import defaultdict

    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", None)
    rng = random.Random(4)
    edges = sorted({tuple(sorted(rng.sample(range(10, 70), 2))) for _ in range(300)})
    got = [tuple(r) for r in G.swap_partition(spark.createDataFrame(edges, "u long, v long"), k=3, rounds=4, seed=9).collect()]
    near = defaultdict(list)
    for u, v in edges:
        near[u].append(v)
        near[v].append(u)
    near, rng, a, swaps, want = {x: sorted(y) for x, y in near.items()}, random.Random(9), G.Annealer("LINEAR", 2.0, 0.003), 0, []
    ids = sorted(near)
    color = {x: x % 3 for x in ids}
    first, degree = dict(color), lambda x, c: sum(color[y] == c for y in near[x])

    def partner(p, nodes):
        best, top = None, -1.0
        for q in nodes:
            new = degree(p, color[q]) ** 2.0 + degree(q, color[p]) ** 2.0
            if a.accepts(degree(p, color[p]) ** 2.0 + degree(q, color[q]) ** 2.0, new, rng.random()) and new > top:
                best, top = q, new
        return best

    for r in range(4):
        for p in ids:
            q = partner(p, rng.sample(near[p], min(3, len(near[p]))))
            if q is None:
                q = partner(p, [x for x in rng.sample(ids, 7) if x != p][:6])
            if q is not None:
                color[p], color[q] = color[q], color[p]
                swaps += 1
        a.cool()
        want.append((r, sum(color[u] != color[v] for u, v in edges), swaps, sum(color[x] != first[x] for x in ids)))
    assert got == want


def test_jb_run_makes_every_round(spark, sf):
    log = registry.QUERIES["jb_run"](spark, sf).toPandas()
    assert log["round"].tolist() == list(range(1000))


def test_spectrum_of_several_components(spark, sf):
    """More vertices than one eigensolve takes: components apart, with the eigenvalues of the whole."""
    import numpy as np

    groups = [(0, 9), (100, 7), (200, 8)]
    edges = [(a + i, a + j) for a, n in groups for i in range(n) for j in range(i + 1, n) if (i + j) % 5]
    df = spark.createDataFrame(edges, "u long, v long")
    assert G.eigengap(df, most=9).collect()[0][0] == 3
    got = G.spectrum(df, most=9).toPandas().sort_values("vertex")
    assert set(got.eigengap_k) == {3} and len(got) == 24
    assert got.groupby(got.vertex // 100).cluster.nunique().tolist() == [1, 1, 1]
    at = {x: i for i, x in enumerate(got.vertex)}
    lap = np.zeros((24, 24))
    for u, v in edges:
        lap[at[u], at[v]] = lap[at[v], at[u]] = -1
    lap -= np.diag(lap.sum(1))
    f = got.fiedler.to_numpy()
    assert abs(lap @ f).max() < 1e-12 and abs(f.sum()) < 1e-12 and abs(f @ f - 1) < 1e-12
    with pytest.raises(ValueError):
        G.spectrum(df, most=8)


def test_large_components_equal_their_dense_solution(spark):
    """A piece beyond the dense solver's size: same drops, vectors and clusters, with one component and with several."""
    import random

    rng = random.Random(2)
    joined = [(i, j) for i in range(60) for j in range(i + 1, 60) if rng.random() < (0.7 if i // 30 == j // 30 else 0.05)]
    three = [(i, j) for i in range(60) for j in range(i + 1, 60) if rng.random() < (0.8 if i // 20 == j // 20 else 0.02)]
    apart = [(u + 100, v + 100) for u, v in three] + [(i, j) for i in range(8) for j in range(i + 1, 8)]
    ring = [(i, i + 1) for i in range(39)] + [(0, 39)]  # no drop is certain, and eigenvalues are double
    for edges, gap in ((joined, 2), (three, 3), (apart, 4), (ring, None)):
        df = spark.createDataFrame(edges, "u long, v long")
        want = G.eigengap(df).first()[0]
        assert G.eigengap(df, dense=30).first()[0] == want and gap in (want, None)
        if gap:
            one, two = (G.spectrum(df, k, dense=d).toPandas().sort_values("vertex") for d in (4000, 30) for k in (2,))
            assert np.allclose(abs(one.fiedler @ two.fiedler), 1) and len(set(zip(one.cluster, two.cluster))) == 2
    lap = G.spectrum(spark.createDataFrame(joined, "u long, v long"), 2, dense=30).toPandas().sort_values("vertex")
    assert lap.groupby(lap.vertex // 30).cluster.nunique().tolist() == [1, 1]


def test_models(spark, sf):
    got = {name: [r.asDict() for r in registry.QUERIES[name](spark, sf).collect()] for name in ("ml_gbdt_residual", "ml_ranker", "ml_mlp", "ml_shap", "ml_automl_cls", "ml_automl_reg", "ml_gbdt_multi", "snk_model", "src_model", "txt_sweep", "fn_random")}
    assert got["ml_gbdt_residual"][0]["loss_after"] <= got["ml_gbdt_residual"][0]["loss_before"]
    assert 0 < got["ml_ranker"][0]["map3"] <= 1 and 0.4 < got["ml_mlp"][0]["auc"] <= 1
    assert max(r["gap"] for r in got["ml_shap"]) < 1e-6 and len(got["ml_shap"]) == 6
    scores = [r["score"] for r in got["ml_automl_cls"]]
    assert scores == sorted(scores, reverse=True) and len(got["ml_automl_reg"]) == 4 and [r["place"] for r in got["ml_automl_reg"]] == [1, 2, 3, 4]
    assert all(0 <= r["accuracy"] <= 1 for r in got["ml_gbdt_multi"])
    assert all(r["before"] == r["after"] for r in got["snk_model"]) and len(got["src_model"]) == len(got["snk_model"])
    assert all(r["found"] <= r["candidates"] for r in got["txt_sweep"]) and all(0 <= r["u"] < 1 for r in got["fn_random"])


def test_learners(spark, sf):
    for name in ("cv_oof", "ml_gbdt_bin", "ml_logreg", "sp_cluster", "jb_run", "fe_power", "ml_automl_ts"):
        assert registry.QUERIES[name](spark, sf).count() > 0, name
