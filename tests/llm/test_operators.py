"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from minekit.llm import common, eliasfano, langzip, mainarticle, mixing, mpegaudio, neardup, ngramlm, ordermin, pieces, queries, sharding, toxicity
from minekit.llm.common import tokens
from minekit.llm.components import components
from minekit.llm.queries import PIECE_MODEL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, score string"


def frame(spark, texts, sources=None, ids=None):
    """Documents with columns whose names clash with those that operators add."""
    rows = [(ids[i] if ids else i, t, "en" if i % 2 else "de", (sources or ["a", "b", None])[i % len(sources or "abc")], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 80))) for _ in range(n)]
    near = [" ".join(t.split()[:-1] + ["changed"]) for t in texts[:12]]
    return [*texts, *texts[:5], *near, None, "", "   ", "one", "Two words", "x " * 3000]


def test_tokens_of_slices():
    a = pa.array(["A b", None, "  c\td ", "é É", "e"] * 3)
    n, codes, words = tokens(a.slice(5, 4))
    assert n.tolist() == [2, 0, 2, 2]
    assert [words[c].as_py() for c in codes] == ["a", "b", "c", "d", "é", "É"]


def test_audio(spark):
    texts = [None, "", "a", "x" * 575, "y" * 576, "ÿ" * 577, "\xff\xfb\x90\x00" * 400, "a"]
    out = {r["doc_id"]: r for r in mpegaudio.digest_documents(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (out[i]["n_bytes"], out[i]["payload_bytes"], out[i]["payload_sha256"], out[i]["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert out[2]["media_sha256"] == out[7]["media_sha256"] and out[2]["feature"] == out[7]["feature"]
    assert mpegaudio.digest_documents(frame(spark, [])).count() == 0


def test_audio_parser():
    payload, _ = mpegaudio.padded("abc" * 800)
    media = mpegaudio.store(payload)
    whole = mpegaudio.parse(media)
    assert whole.crc_bad == 0 and whole.junk_bytes == 0 and whole.table["frames"] == len(whole.offsets) == len(payload) // 576
    assert whole.duration == pytest.approx(len(whole.offsets) * 1152 / 48000) and whole.tags["TIT2"]
    cut = whole.offsets[2]
    dirty = mpegaudio.parse(media[:cut] + b"\xff\xfb\x90junk\xff\xff" + media[cut:] + b"TAG" + b"title".ljust(125, b"\0"))
    assert len(dirty.offsets) == len(whole.offsets) and dirty.junk_bytes == 9 and dirty.tags["v1:title"] == "title"
    broken = bytearray(media)
    broken[whole.offsets[1] + 10] ^= 1  # side information
    assert mpegaudio.parse(bytes(broken)).crc_bad == 1
    # variable rates with a Xing table, layer III without checksum
    frames = []
    for code in (0x90, 0xA0, 0x50):
        h = mpegaudio.header(bytes([0xFF, 0xFB, code, 0]))
        frames.append(bytes([0xFF, 0xFB, code, 0]) + bytes(h.size - 4))
    xing = bytearray(frames[0])
    xing[36:48] = b"Xing" + (1).to_bytes(4, "big") + (3).to_bytes(4, "big")
    s = mpegaudio.parse(bytes(xing) + b"".join(frames))
    assert s.table["frames"] == 3 == len(s.offsets) and len({h.kbps for h in s.headers}) == 3 and s.samples == 3 * 1152
    assert mpegaudio.parse(b"").duration == 0 and mpegaudio.parse(b"\xff" * 5000).offsets == []


def test_toxicity(spark):
    rng = random.Random(0)
    plain = ["house", "tree", "river", "stone", "light", "garden", "window", "letter"]
    rows = [(" ".join(rng.choices(plain, k=20)) + (" what an idiot " if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    texts = ["the river idiot", "the river stone", "what an 1d10t", "i d i o t tree", "what an idiooooot", None, "", "an i.d.i.o.t", "tree " * 5000, "such a i d i o t", "an id iot there", "an !diot", "w" * 100_000]
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, texts), model).collect()}
    assert [got[i]["predicted"] for i in range(len(texts))] == [1, 0, 1, 1, 1, 0, 0, 1, 0, 1, 1, 1, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.decode("1d10t", model.chars) == "idiot" and toxicity.readings("house", model.chars) == ["house"]
    none = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert {r["predicted"] for r in toxicity.score(frame(spark, texts), none).collect()} == {0}


def test_toxicity_learns_from_every_labelled_row(spark, tmp_path, monkeypatch):
    """Words in three toxic documents of many are learnt, counts are those of all rows, and no label is lost on the way."""
    rows = [(f"plain words of document {i}", 0) for i in range(40_000)] + [(f"document {i} of grumblix{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}", 1) for i in range(100) for _ in range(3)]
    df = spark.createDataFrame(rows, "text string, toxic int").repartition(8)
    model = toxicity.fit(df)
    assert sum(f.startswith("=grumblix") for f in model.weights) == 100
    assert model.chars.tri["^^p"] == 40_000 and model.chars.tri["^^g"] == 300 and model.chars.tri["nt$"] == 40_300
    docs = df.withColumn("doc_id", F.monotonically_increasing_id())
    docs.select("doc_id", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    docs = labels.select("doc_id", F.col("doc_id").cast("string").alias("text"))
    want = labels.where(common.fold("doc_id", 5) != 0).count()
    for most in (1_000_000, 0):
        monkeypatch.setattr(neardup, "BROADCAST_IDS", most)
        got = queries.labelled(spark, docs, str(tmp_path))
        assert got.count() == want == got.select("text").distinct().count() and got.columns == ["text", "toxic"]


def test_toxicity_by_arrays_is_that_of_the_readings(monkeypatch):
    """Evidence, counts and trigrams are what each word's readings give, and no token is decoded whose first letters tell all."""
    words = ["idiot", "idiom", "1d10t", "idiot###", "idiomatic$$$", "idiotic%%", "(idiot)", "iiidiot", "\"idiot\"", "ph", "vvhore", "µidiot", "idio", "stupid", "stup!d", "a$$", "…idiot", "été", "étééé", "\u4e2d\u6587idiot", "\U00010428idiot", "555-1710", "\"\"", "idiot-stupid", "x", "idiot\u0301", "\u0663\u0664", "moron.--", "moron.***", "--", "Idiot,"]
    rng = random.Random(3)
    words += ["".join(rng.choices("idiotas10$#-.\"vph", k=rng.randint(1, 9))) for _ in range(600)]
    texts = [*words, None, "", *(" ".join(rng.choices(words, k=5)) for _ in range(100))]
    chars = toxicity.CharModel({"^^i": 50, "^id": 50, "idi": 50, "dio": 50, "iot": 40, "ot$": 40, "iom": 10, "^^s": 9, "^st": 9, "stu": 9, "tup": 9, "upi": 9, "pid": 9, "id$": 9})
    weights = {"=idiot": 3.0, "^idio": 1.0, "^idiot": 2.0, "=stupid": 2.5, "=id": 0.3, "^stup": 0.5, "=moron": 0.7, "=\u00e9t\u00e9": 0.2}
    model = toxicity.ToxicityModel(chars, weights)
    of = lambda w: {f for x in toxicity.readings(w.lower(), chars) for f in toxicity.features(x)}
    single = [w for w in words if len(w.strip(toxicity._QUOTES)) != 1]
    assert model.evidence(pa.array(single)).tolist() == [max((weights.get(f, 0.0) for f in of(w)), default=0.0) for w in single]
    read = toxicity.Texts(pa.array(texts))
    plain = toxicity.shape(read.raw)[1].tolist()
    assert plain == [w.isalpha() and not toxicity._SUSPECT.search(w) for w in read.raw.to_pylist()] and {True, False} == set(plain)
    got = toxicity._documents(read, *read.known(model), [], np.arange(len(texts)) % 4, len(weights))
    want = np.zeros_like(got)
    for i, t in enumerate(texts):
        for f in {f for w in (t or "").split(" ") for f in of(w)} & set(weights):
            want[model.number[f], i % 4] += 1
    assert got.tolist() == want.tolist() and want.any(1).sum() == len(weights)
    kept = [f"^^{w}$" for w in dict.fromkeys(map(str.lower, words)) for w in [w if w.isalpha() else toxicity.trimmed(w)] if w.isdigit() or w.isalpha() and not toxicity._SUSPECT.search(w)]
    want = Counter(w[i : i + 3] for w in kept for i in range(len(w) - 2))
    assert {k: v for k, (v,) in toxicity._trigrams(pa.array([" ".join(words)]), np.zeros(1, int)).items()} == want
    decoded = []
    monkeypatch.setattr(toxicity, "decode", lambda text, model, f=toxicity.decode: decoded.append(text) or f(text, model))
    model.memo.clear()
    assert model.evidence(pa.array(["idiomatic$$$ idioms### stupor%%% house$$$"])).tolist() == [1.0] and decoded == []


@pytest.mark.parametrize("n", [40, 20_000])
def test_scale_of_parted_classes(n):
    """Evidence that parts the classes wholly gives a threshold between them, however many rows there are."""
    y = (np.arange(n) % 10 == 0).astype(float)
    slope, bias = toxicity._logistic(np.where(y == 1, 7.4, 1.4) + np.linspace(-0.5, 0.5, n), y)
    assert 2.0 < -bias / slope < 6.9


def test_decode_is_the_cheapest_path():
    model = toxicity.CharModel({"^^i": 5, "^id": 5, "idi": 5, "dio": 5, "iot": 5, "ot$": 5, "^^1": 1, "^1d": 1})

    def paths(text, i=0):
        if i == len(text):
            yield "", 0.0
            return
        for taken, letters, price in toxicity.arcs(text, i):
            for rest, cost in paths(text, i + taken):
                yield letters + rest, price + cost

    def cost(words):
        framed = [f"^^{w}$" for w in words.split(" ") if w]
        return sum(model.cost(w[i : i + 3]) for w in framed for i in range(len(w) - 2))

    for text in ("1d10t", "i.d", "iddd", "0|t", "i d", "i d i"):
        best = min(p + cost(w) for w, p in paths(text))
        got = toxicity.decode(text, model)
        assert min(p + cost(w) for w, p in paths(text) if w == got) == pytest.approx(best)


def brute_components(ids, texts, k, t):
    sets = []
    for x in texts:
        w = neardup_words(x)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(ids)), 2):
        shared = len(sets[i] & sets[j])
        if sets[i] and sets[j] and shared * t[1] >= t[0] * (len(sets[i]) + len(sets[j]) - shared):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return {ids[i]: (len(sets[i]), min(ids[j] for j in range(len(ids)) if find(j) == find(i))) for i in range(len(ids))}


def neardup_words(x):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize(("k", "t"), [(3, (90, 100)), (5, (8, 10))])
def test_near_duplicates(spark, k, t):
    texts = corpus()
    ids = list(range(100, 100 + len(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, texts, ids=ids), k, t).collect()}
    assert got == brute_components(ids, texts, k, t)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_frequent_classes_lose_nothing(spark, monkeypatch):
    """A large family of near copies whose elements are all frequent, compared in blocks."""
    monkeypatch.setattr(neardup, "FREQUENT", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "GROUPS", 8)
    monkeypatch.setattr(neardup, "SHORT", 40)
    rng = random.Random(1)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(100)] = f"z{rng.randrange(20)}"
        texts.append(" ".join(own[: rng.randint(80, 100)]))
    ids = list(range(len(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, texts), 3, (90, 100)).collect()}
    assert got == brute_components(ids, texts, 3, (90, 100))


def test_family_just_under_the_threshold(spark):
    """Many texts, each a little too different from every other: no link, and rows in proportion to the members."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(70):
        w = list(base)
        for at in rng.sample(range(300), 6):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[3] + " tail", texts[3]]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, texts), 3, (90, 100)).collect()}
    assert out == brute_components(list(range(len(texts))), texts, 3, (90, 100)) and out[70][1] == out[71][1] == 3


def test_versions_of_a_document(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    out = neardup.near_duplicates(frame(spark, [a, b, b, a, None, "c d e f g"], ids=[5, 5, 7, 9, 5, None]), 3, (90, 100)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in out if r["n_shingles"]) == [(0, 0), (5, 5), (5, 5), (7, 5), (9, 5)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 9), (5, 5), (None, 1)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {k: v for k, v in got.items() if k != 5 or True} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def test_language(spark):
    en = ["the house on the hill has a red door and the garden is full of flowers " * 3, "there was nothing that they could have done with the letter from home " * 3]
    de = ["das haus auf dem berg hat eine rote tür und der garten ist voller blumen " * 3, "es gab nichts was sie mit dem brief von zu hause hätten machen können " * 3]
    train = spark.createDataFrame([(t, "en") for t in en] + [(t, "de") for t in de] + [("x", None), (None, "fr")], "text string, lang string")
    dictionaries = langzip.fit(train)
    assert list(dictionaries) == ["de", "en"]
    texts = ["the door of the house is red and full of flowers", "der berg und das haus voller blumen im garten", None, "", "123 456 !!", "THE DOOR OF THE HOUSE IS RED AND FULL OF FLOWERS"]
    got = {r["doc_id"]: r for r in langzip.classify(frame(spark, texts), dictionaries).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[2]["rejected"]
    assert langzip.fit(train.limit(0)) == {} and langzip.classify(frame(spark, []), dictionaries).count() == 0
    assert [langzip.folded(x) for x in ("²", "½ 5", "A½b", "é_1 Z")] == ["", "", "a b", "é z"]
    long = {r["doc_id"]: r for r in langzip.classify(frame(spark, [en[0] * 300, de[1] * 300, en[0], en[0]]), dictionaries).collect()}
    assert [long[i]["lang_pred"] for i in range(4)] == ["en", "de", "en", "en"] and not long[0]["rejected"] and long[2]["score"] == long[3]["score"]


def test_shards(spark):
    texts = ["same text"] * 200 + [f"text {i} " * (i % 40) for i in range(300)] + [None, ""]
    df = frame(spark, texts)
    out = sharding.shard_documents(df, 24, ranges=48).toPandas()
    assert len(out) == len(texts) and set(out["shard"]) <= set(range(24))
    size = {i: len((t or "").encode()) + 8 for i, t in enumerate(texts)}
    assert all(size[r.doc_id] == r.size and zlib.crc32((texts[r.doc_id] or "").encode()) == r.text_crc32 for r in out.itertuples())
    per = out.groupby("shard").agg(b=("size", "sum"), n=("slot", "count"), top=("slot", "max"), k=("slot", "nunique"))
    assert ((per["top"] + 1 == per["n"]) & (per["k"] == per["n"])).all()
    assert per["b"].max() - per["b"].min() <= 2 * max(size.values())
    assert out.sort_values("doc_id")[["doc_id", "shard", "slot"]].values.tolist() == sharding.shard_documents(df, 24, ranges=48).toPandas().sort_values("doc_id")[["doc_id", "shard", "slot"]].values.tolist()
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_pieces(spark):
    v = pieces.Vocabulary.load(PIECE_MODEL)
    enc = pieces.Encoder(v, 4)

    def brute(text):
        arcs, out = v.arcs(" " + text), []

        def walk(at, score):
            if at == 0:
                out.append(score)
                return
            for start, s, _ in arcs[at]:
                walk(start, score + s)

        walk(len(text) + 1, 0)
        return [x / pieces.STEPS for x in sorted(out, reverse=True)[:4]]

    for t in ("hello", "a b", "ab\ncd", "▁x  é", "日本"):
        found = enc(t)
        assert [f[0] for f in found] == pytest.approx(brute(t))
        assert all(v.decode(enc.ids(f)) == t for f in found) and len({tuple(enc.ids(f)) for f in found}) == len(found)
    for t in ("x" * 5000, "_" * 1500, "\U0001f600" * 300):  # ties everywhere
        found = enc(t)
        assert [f[0] for f in found] == sorted((f[0] for f in found), reverse=True) and v.decode(enc.ids(found[0])) == t
    own = [[] if not x else v.cut.findall(" " + x) for x in ("a(b) c.d  e\n\nf, 'g'", "x" * 50)]
    assert "".join(own[0]) == " a(b) c.d  e\n\nf, 'g'" and pieces.digest_documents(frame(spark, []), PIECE_MODEL).count() == 0
    texts = [None, "", "Hello  world\n", "word " * 5000, "\U0001f600 ok", "Hello  world\n"]
    rows = pieces.decode(pieces.encode(frame(spark, texts), PIECE_MODEL, all_ids=True), PIECE_MODEL).collect()
    for r in rows:
        assert r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) and len(r["nbest_scores"]) == len(r["nbest_ids"])


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, order, monkeypatch):
    monkeypatch.setattr(common, "SLICE", 400)  # several slices of one batch
    texts = corpus(40)
    train = frame(spark, texts[:30])
    meta = ngramlm.fit(train, order=order, shards=5)
    got = {r["doc_id"]: r for r in ngramlm.score(frame(spark, texts), meta).collect()}
    end, lists = "\n</s>", [neardup_words(t) + ["\n</s>"] for t in texts]
    counts = [dict() for _ in range(order + 1)]
    for w in lists[:30]:
        padded = ["\n<s>"] + w
        for n in range(1, order + 1):
            for i in range(1, len(padded)):
                if i - n + 1 >= 0:
                    g = tuple(padded[i - n + 1 : i + 1])
                    counts[n][g] = counts[n].get(g, 0) + 1
    total, distinct = sum(counts[1].values()), len(counts[1])

    def p(context, w):
        if not context:
            return (counts[1].get((w,), 0) + 0.5) / (total + 0.5 * (distinct + 1))
        n = len(context) + 1
        own = {g[-1]: c for g, c in counts[n].items() if g[:-1] == context}
        lower = p(context[1:], w)
        if not own:
            return lower
        s = sum(own.values())
        return max(own.get(w, 0) - 0.75, 0) / s + 0.75 * len(own) / s * lower

    for i in (0, 5, 33, 37, len(texts) - 6, len(texts) - 5, len(texts) - 2):
        w = lists[i]
        base = sum(math.log10((counts[1].get((x,), 0) + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        padded, full = ["\n<s>"] + w, 0.0
        for j in range(1, len(padded)):
            full += math.log10(p(tuple(padded[max(0, j - order + 1) : j]), padded[j]))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum((x,) in counts[1] for x in w), total)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["score"] == pytest.approx(full, abs=1e-3 * len(w))
    assert end and ngramlm.score(frame(spark, ["a"]), ngramlm.fit(train.limit(0), order=order)).count() == 1


def test_language_model_as_registered(spark, tmp_path, monkeypatch):
    """The query scores by two words of context: what follows 'a b' and 'c b' tells them apart."""
    from minekit.llm import queries

    texts = ["a b x", "c b y"] * 20 + ["a b x", "a b y"]
    frame(spark, texts, ids=list(range(len(texts)))).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "fold", lambda c, m: F.when(F.col(c) >= 40, F.lit(1)).otherwise(F.lit(0)))
    got = {r["doc_id"]: r["score"] for r in queries.op7_eliasfano_lm(spark, str(tmp_path)).collect()}
    assert got[40] > got[41] + 0.5


def test_pointers_bound_the_search():
    e = eliasfano.EliasFano(eliasfano.EliasFano.encode(np.arange(0, 900, 3, dtype=np.uint64)))
    q = np.array([30, 30, 30, 31], np.uint64)
    assert e.find(q, np.array([0, 11, 0, 0]), np.array([300, 300, 10, 300])).tolist() == [10, -1, -1, -1]


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 9), (500, 600), (3000, 2**40), (3000, 2**63)):
        v = np.unique(rng.integers(0, top, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
        e, at = eliasfano.EliasFano(eliasfano.EliasFano.encode(v)), {int(x): i for i, x in enumerate(v)}
        q = np.concatenate([v, rng.integers(0, top, 200, dtype=np.uint64)])
        assert e.find(q).tolist() == [at.get(int(x), -1) for x in q]
        assert not len(v) or (e.get(np.arange(len(v))) == v).all()


def test_order_minhash(spark):
    texts = ["a b c d e f g h", "a b c d e f g h", "h g f e d c b a", None, "", "x", "a a a a a a b a a a", "é " * 50]
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in ordermin.fingerprint_documents(df).collect()}
    n = len(texts)
    for i, t in enumerate(texts):
        nxt, own = texts[i - 1 if i else n - 1] or "", t or ""
        edited = own[: len(own) - len(own) // 2] + nxt[: len(own) // 2]
        assert got[i]["n_chars"] == len(own) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[1]["near_next"] == 1.0 and got[2]["near_next"] < 0.2
    assert got[3]["fingerprint"] == got[4]["fingerprint"] == "." * 512
    assert ordermin.fingerprint_documents(frame(spark, ["only one"])).collect()[0]["near_next"] == 1.0
    assert ordermin.fingerprint_documents(frame(spark, [])).count() == 0


def test_order_minhash_of_short_texts(spark):
    """Every slot of a short text holds two k-mers in their order: swapped halves are less alike than under plain MinHash."""
    rng = random.Random(5)
    both = []
    for _ in range(30):
        w = [f"v{rng.randrange(10**6)}" for _ in range(60)]
        both.append((" ".join(w), " ".join(w[30:] + w[:30])))
    df = ordermin.with_fingerprint(ordermin.with_fingerprint(spark.createDataFrame(both, "a string, b string"), "a", "fa"), "b", "fb")
    likes = [r[0] for r in df.select(ordermin.likeness(F.col("fa"), F.col("fb"))).collect()]
    # 56 of 60 k-mers shared by both; half of the pairs keep their order
    assert 0.37 < sum(likes) / len(likes) < 0.52
    assert all(x is not None for r in df.select("fa").collect() for x in r[0])


def test_order_minhash_by_brute_force(spark):
    import struct

    import xxhash

    def chained(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed)
        return seed - 2**64 if seed >= 2**63 else seed

    def long(x):
        return struct.pack("<q", x)

    def slots(text, k=3, take=2):
        w = text.split()
        hashes = [chained(*w[i : i + k]) >> 24 for i in range(len(w) - k + 1)] if len(w) >= k else [chained(" ".join(w)) >> 24] * bool(w)
        if not hashes:
            return [None] * 64
        seen, numbered = {}, []
        for pos, h in enumerate(hashes):
            r = seen[h] = seen.get(h, -1) + 1
            numbered.append((chained(long(h), struct.pack("<i", r)) >> 24 if r else h, pos))
        out = []
        for g in range(2):
            order = sorted((chained(long(h), struct.pack("<i", g)) >> 24 if g else h, pos) for h, pos in numbered)
            for start in range(-16, 16):
                first = next((i for i, (h, _) in enumerate(order) if h >> 35 >= start), 0)
                least = sorted((order[(first + d) % len(order)] for d in range(min(take, len(order)))), key=lambda x: x[1])
                out.append(chained(*(long(((h << 24 | pos) >> 25) & 2**39 - 1) for h, pos in least)) >> 32)
        return out

    rng = random.Random(8)
    texts = ["", "a", "a b", "a b c", "x " * 200, "a b " * 30, *(" ".join(rng.choices("abcdefgh", k=n)) for n in (5, 30, 300)), *(" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (20, 400))]
    df = ordermin.with_fingerprint(frame(spark, texts), "text", "f")
    got = {r["doc_id"]: r["f"] for r in df.select("doc_id", "f").collect()}
    assert [got[i] for i in range(len(texts))] == [slots(t) for t in texts]


def test_mixing(spark):
    texts = [f"w{i} " * (i % 9) for i in range(200)] + [None, ""]
    df = frame(spark, texts, sources=["a", "b", "c", None, "a"])
    got = mixing.mix_sources(df).toPandas()
    sizes = {i: len(neardup_words(t)) for i, t in enumerate(texts)}
    assert all(sizes[r.doc_id] == r.size and 0 <= r.taken <= 2 * r.size for r in got.itertuples())
    by = got.fillna({"source": "~"}).groupby("source").agg(s=("source_size", "first"), t=("target", "first"), k=("taken", "sum"))
    assert by["t"].sum() == pytest.approx(1.5 * sum(sizes.values())) and (by["t"] <= 2 * by["s"] + 1e-9).all()
    assert (abs(by["k"] - by["t"]) <= 9).all()
    times = {r.doc_id: r.repeats for r in got.itertuples()}
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in times.items() if v}
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_pages(spark):
    para = "A sentence of the article that is long enough to be a paragraph of main text, with words. " * 2
    page = f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy now, it is cheap and good for you and all</div><article><h1>Head</h1><p>{para}</p><div class='comments'>no</div><p>Tom &amp; Ann\n  &lt;3 <b>x</b>y</article><footer>&copy; me</footer>"
    plain = f"<body><div id='menu'><a href=1>one</a> <a href=2>two</a></div><p>{para}</p><p>{para}</p><div id='comments'>{para}</div><script>var a = '</p>';</script><p>"
    rows = [(1, "u", page, "old"), (2, "u", plain, "old"), (3, "u", None, "old"), (4, "u", "", "old"), (5, "u", "<p>short", "old"), (6, "u", "a < b &amp c", "old")]
    got = {r["page_id"]: r for r in mainarticle.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1]["text"] == f"Head\n{para.strip()}\nTom & Ann <3 xy"
    assert got[2]["text"] == f"{para.strip()}\n{para.strip()}"
    assert got[3]["text"] == got[4]["text"] == "" and got[5]["text"] == "short" and got[1]["n_chars"] == len(got[1]["text"])


def test_quotes_in_markup():
    assert mainarticle.main_text("<article><p title=don't>First long text it's here and more</p><p class='a>b'>Second</p><p data-x=\"a>b\">Third</p></article>") == "First long text it's here and more\nSecond\nThird"


def test_empty_and_long_pages(spark):
    pages = spark.createDataFrame([(1, "", "<main><p>" + "long text " * 200_000 + "</p></main>"), (2, None, "x"), (2, None, "x")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["n_chars"]) for r in mainarticle.extract(pages).collect())
    assert got == [(1, 1_999_999), (2, 1), (2, 1)] and mainarticle.extract(pages.limit(0)).count() == 0


def test_curve_decides_beside_articles():
    """Main text in blocks beside articles stays, comments that are articles go, and neither negated names nor containers lose it."""
    para = "A sentence of the main text that is long enough to be a paragraph of its own, with words. " * 2
    cards = "<article><a href=1>One</a></article><article><a href=2>Two</a></article>"
    got = mainarticle.main_text(f"<body><div><p>{para}</p><p>{para}</p></div><div><p><a href=3>x</a></p><p><a href=4>y</a></p><p><a href=5>z</a></p></div>{cards}")
    assert got.startswith(f"{para.strip()}\n{para.strip()}") and "Two" not in got
    assert mainarticle.main_text(f"<body><article><p>{para}</p></article><article class='comment'><p>Reader: {para}</p></article>") == para.strip()
    for names in ("content no-sidebar", "post-body share-wide"):
        assert mainarticle.main_text(f"<body><div class='{names}'><p>{para}</p></div>") == para.strip()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    texts = corpus(40) + ["totally idiot text with enough words to be judged as such"] * 2
    docs = frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.coalesce(F.col("text").contains("idiot").cast("int"), F.lit(0)).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    clashing = docs.withColumn("score", F.lit("own")).withColumn("predicted", F.lit(7)).withColumn("rejected", F.lit("r")).withColumn("margin", F.lit(1))
    for stage in (cp.drop_toxic, cp.keep_languages):
        assert {tuple(r) for r in stage(spark, clashing, str(tmp_path)).select("score", "predicted", "rejected", "margin").collect()} <= {("own", 7, "r", 1)}
    again = docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3"))
    assert cp.drop_near_duplicates(spark, again, "").count() == len({t for t in texts[:3]})
    kept = {r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, "").collect()}
    parts = brute_components(list(range(len(texts))), texts, 5, (8, 10))
    assert kept == {c for _, c in parts.values()}
    assert {"ids", "n_tokens"} <= set(cp.run(spark, str(tmp_path)).columns)
