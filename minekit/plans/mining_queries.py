"""Itemsets and rules, similar texts, graphs and edge streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import baskets as A
from ..operators import graph as G
from ..operators import similarity as S
from ..session import table
from ..sources import text as T
from ..streaming import triest
from .registry import query
from .source_queries import baskets, edges
from .sqlbits import BASKETS, EDGES

SUPPORT = 300
_ITEMS = f"""{BASKETS}, f1 AS (SELECT item, count(*) AS n FROM baskets GROUP BY item HAVING count(*) > {{s}}),
f2 AS (SELECT a.item AS x, b.item AS y, count(*) AS n FROM baskets a JOIN baskets b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2 HAVING count(*) > {{s}}),
f3 AS (SELECT a.item AS x, b.item AS y, c.item AS z, count(*) AS n FROM baskets a JOIN baskets b ON a.basket = b.basket AND a.item < b.item JOIN baskets c ON a.basket = c.basket AND b.item < c.item GROUP BY 1, 2, 3 HAVING count(*) > {{s}}),
f4 AS (SELECT x, y, z, d.item AS u, count(*) AS n FROM f3 JOIN baskets a ON a.item = x JOIN baskets b ON b.item = y AND a.basket = b.basket JOIN baskets c ON c.item = z AND a.basket = c.basket JOIN baskets d ON d.item > z AND a.basket = d.basket GROUP BY 1, 2, 3, 4 HAVING count(*) > {{s}}),
f AS (SELECT item AS items, 1::BIGINT AS k, n AS support FROM f1 UNION ALL SELECT x || '|' || y, 2, n FROM f2 UNION ALL SELECT x || '|' || y || '|' || z, 3, n FROM f3 UNION ALL SELECT x || '|' || y || '|' || z || '|' || u, 4, n FROM f4)"""


def joined(c: str):
    return F.array_join(c, "|").alias(c)


@query("mb_singletons", f"WITH {_ITEMS.format(s=SUPPORT)} SELECT item, n AS support FROM f1")
def mb_singletons(spark, d):
    return A.singletons(baskets(spark, d), SUPPORT).select(F.col("items")[0].alias("item"), "support")


@query("mb_candidates", f"WITH {_ITEMS.format(s=SUPPORT)} SELECT a.item || '|' || b.item AS items FROM f1 a JOIN f1 b ON a.item < b.item")
def mb_candidates(spark, d):
    return A.candidates(A.singletons(baskets(spark, d), SUPPORT), 2).select(joined("items"))


query("jn_self_union", f"WITH {_ITEMS.format(s=SUPPORT)} SELECT DISTINCT a.x || '|' || a.y || '|' || b.y AS items FROM f2 a JOIN f2 b ON a.x = b.x AND a.y < b.y")(
    lambda spark, d: A.candidates(A.apriori(baskets(spark, d), SUPPORT, 2).where("k = 2").select("items", "support"), 3).select(joined("items"))
)


@query("mb_filter", f"WITH {_ITEMS.format(s=SUPPORT)} SELECT x || '|' || y AS items, n AS support FROM f2")
def mb_filter(spark, d):
    b = baskets(spark, d)
    return A.counted(b, A.candidates(A.singletons(b, SUPPORT), 2), 2, SUPPORT).select(joined("items"), "support")


@query("agg_support", f"WITH {_ITEMS.format(s=15)} SELECT x || '|' || y || '|' || z AS items, n AS support FROM f3")
def agg_support(spark, d):
    return A.apriori(baskets(spark, d), 15, 3).where("k = 3").select(joined("items"), "support")


@query("mb_apriori", f"WITH {_ITEMS.format(s=SUPPORT)} SELECT items, k, support FROM f")
def mb_apriori(spark, d):
    return A.apriori(baskets(spark, d), SUPPORT).select(joined("items"), "k", "support")


@query("agg_itemset_stats", f"WITH {_ITEMS.format(s=SUPPORT)} SELECT k, count(*) AS n, round(avg(support), 6) AS mean FROM f GROUP BY k")
def agg_itemset_stats(spark, d):
    return A.apriori(baskets(spark, d), SUPPORT).groupBy("k").agg(F.count("*").alias("n"), X.r6(F.avg("support")).alias("mean"))


_RULES = f"""{_ITEMS.format(s=SUPPORT)}, w AS (SELECT string_split(items, '|') AS l, k, support FROM f WHERE k > 1), e AS (SELECT l, support, unnest(range(1, CAST(pow(2, k) AS BIGINT) - 1)) AS mask FROM w),
s AS (SELECT support, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i : (mask >> (i - 1)) & 1 = 1), lambda i : l[i]), '|') AS a, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i : (mask >> (i - 1)) & 1 = 0), lambda i : l[i]), '|') AS c FROM e),
r AS (SELECT a, c, s.support / f.support::DOUBLE AS conf FROM s JOIN f ON f.items = s.a)"""


@query("mb_rules", f"WITH {_RULES} SELECT a AS antecedent, c AS consequent, round(conf, 6) AS confidence FROM r WHERE conf >= 0.18")
def mb_rules(spark, d):
    return A.rules(A.apriori(baskets(spark, d), SUPPORT), 0.18).select(joined("antecedent"), joined("consequent"), X.r6(F.col("confidence")).alias("confidence"))


@query("set_rule_diff", f"WITH {_RULES} SELECT c AS consequent, count(*) AS n FROM r WHERE conf >= 0.1 GROUP BY c")
def set_rule_diff(spark, d):
    return A.rules(A.apriori(baskets(spark, d), SUPPORT), 0.1).groupBy(F.array_join("consequent", "|").alias("consequent")).agg(F.count("*").alias("n"))


# Similar texts

N, BANDS, T_LSH = 20, 5, 0.8
ROWS = N // BANDS
_SHINGLES = "t AS (SELECT doc_id AS id, list_distinct(list_transform(range(1, length(text) - 4), lambda i : substr(text, i, 5))) AS s FROM documents WHERE length(text) > 5)"
_CODES = _SHINGLES + ", c AS (SELECT id, list_distinct(list_transform(s, lambda x : ('0x' || substr(md5(x), 1, 8))::BIGINT % 2147483647)) AS items FROM t)"
_SIG = _CODES + ", u AS (SELECT id, unnest(items) AS x FROM c), g AS (SELECT id, [" + ", ".join(f"min(((x * ({a}) + ({b})) % 2147483647 + 2147483647) % 2147483647)" for a, b in S.hash_params(N)) + "] AS sig FROM u GROUP BY id)"


@query("txt_shingle", f"WITH {_SHINGLES} SELECT id, CAST(len(s) AS BIGINT) AS n FROM t")
def txt_shingle(spark, d):
    return table(spark, d, "documents").where("length(text) > 5").select(F.col("doc_id").alias("id"), F.size(X.shingles(F.col("text"), 5)).cast("long").alias("n"))


def _sigs(spark, d):
    return S.signatures(S.shingled(table(spark, d, "documents")), N)


@query("txt_minhash", f"WITH {_SIG} SELECT id, array_to_string(sig, ',') AS sig FROM g")
def txt_minhash(spark, d):
    return _sigs(spark, d).select("id", F.array_join("sig", ",").alias("sig"))


@query("agg_setmin", f"WITH {_SIG} SELECT id, sig[1] AS first FROM g")
def agg_setmin(spark, d):
    return S.signatures(S.shingled(table(spark, d, "documents")), N).select("id", F.col("sig")[0].alias("first"))


_BANDS = _SIG + f", b AS (SELECT id, sig, unnest([{', '.join(str(i) for i in range(BANDS))}]) AS band, unnest([{', '.join('+'.join(f'sig[{i * ROWS + j + 1}]' for j in range(ROWS)) for i in range(BANDS))}]) AS key FROM g)"


@query("agg_bandsum", f"WITH {_BANDS} SELECT id, CAST(band AS INTEGER) AS band, CAST(key AS BIGINT) AS key FROM b")
def agg_bandsum(spark, d):
    return _sigs(spark, d).select("id", F.posexplode(X.band_sums(F.col("sig"), N, ROWS)).alias("band", "key"))


_LSH = _BANDS + f""", p AS (SELECT DISTINCT l.id AS a, r.id AS b, l.sig AS x, r.sig AS y FROM b l JOIN b r ON l.band = r.band AND l.key = r.key AND l.id < r.id),
 q AS (SELECT a, b, list_sum(list_transform(range(1, {N + 1}), lambda i : CAST(x[i] = y[i] AS INTEGER))) / {N}.0::DOUBLE AS similarity FROM p)"""  # fmt: skip


@query("txt_lsh", f"WITH {_LSH} SELECT a, b, round(similarity, 6) AS similarity FROM q WHERE similarity >= {T_LSH}::DOUBLE")
def txt_lsh(spark, d):
    return S.lsh(_sigs(spark, d), N, T_LSH, BANDS).withColumn("similarity", X.r6(F.col("similarity")))


@query("jn_lsh_bucket", f"WITH {_LSH} SELECT count(*) AS pairs FROM p")
def jn_lsh_bucket(spark, d):
    return S.lsh(_sigs(spark, d), N, 0.0, BANDS).agg(F.count("*").alias("pairs"))


@query("agg_sig_sim", f"WITH {_LSH} SELECT round(similarity, 6) AS similarity, count(*) AS n FROM q GROUP BY 1")
def agg_sig_sim(spark, d):
    return S.lsh(_sigs(spark, d), N, 0.0, BANDS).groupBy(X.r6(F.col("similarity")).alias("similarity")).agg(F.count("*").alias("n"))


@query("txt_exact_pairs")
def txt_exact_pairs(spark, d):
    """Pairs of different texts, by their least ids, with a Jaccard similarity over 0.8, and those with their copies (jaccard 1); SQL has no way but all pairs, so tests compare with brute force."""
    return S.text_pairs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 0.8)


@query("txt_similarity_dist")
def txt_similarity_dist(spark, d):
    """All pairs, without a threshold."""
    return S.similarity_histogram(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 50)


# Graphs and streams

_TRI = f"{EDGES}, tri AS (SELECT a.u AS x, a.v AS y, b.v AS z FROM edges a JOIN edges b ON a.v = b.u JOIN edges c ON c.u = a.u AND c.v = b.v)"


@query("gr_triangles", f"WITH {_TRI} SELECT count(*) AS triangles FROM tri")
def gr_triangles(spark, d):
    return G.count_triangles(edges(spark, d))


@query("gs_local", f"WITH {_TRI} SELECT vertex, count(*) AS triangles FROM (SELECT unnest([x, y, z]) AS vertex FROM tri) GROUP BY vertex")
def gs_local(spark, d):
    return G.local_triangles(edges(spark, d))


@query("jn_common_neighbors", f"WITH {EDGES}, b AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges) SELECT e.u, e.v, count(*) AS common FROM edges e JOIN b p ON p.u = e.u JOIN b q ON q.u = e.v AND q.v = p.v GROUP BY e.u, e.v")
def jn_common_neighbors(spark, d):
    return G.common_neighbors(edges(spark, d))


@query("gs_triest_base", f"WITH {_TRI} SELECT 0::BIGINT AS stream, (SELECT count(*) FROM edges) AS edges, count(*)::DOUBLE AS estimate FROM tri")
def gs_triest_base(spark, d):
    """A reservoir that holds every edge gives the exact count; smaller ones are tested for their error."""
    return triest.estimate(edges(spark, d), None)


@query("gs_triest_impr", f"WITH {_TRI} SELECT 0::BIGINT AS stream, (SELECT count(*) FROM edges) AS edges, count(*)::DOUBLE AS estimate FROM tri")
def gs_triest_impr(spark, d):
    return triest.estimate(edges(spark, d), None, improved=True)


@query("gs_triest_sampled")
def gs_triest_sampled(spark, d):
    return triest.estimate(edges(spark, d), 1000, improved=True, seed=1)


@query("gs_triest_stream")
def gs_triest_stream(spark, d):
    """The same over a file stream of edge lines, one micro-batch."""
    path, checkpoint, name = T.scratch(spark, "stream"), T.scratch(spark, "state"), f"triest_{abs(hash(T.scratch(spark, 'q')))}"
    edges(spark, d).select(F.concat_ws(" ", "u", "v").alias("value")).write.text(path)
    lines = spark.readStream.text(path)
    q = triest.streaming_estimate(T.parse_edge_lines(lines), 1000).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("agg_degree", f"WITH {EDGES} SELECT vertex, count(*) AS degree FROM (SELECT unnest([u, v]) AS vertex FROM edges) GROUP BY vertex")
def agg_degree(spark, d):
    return G.degrees(edges(spark, d))


@query("sp_affinity", f"WITH {EDGES}, b AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges), g AS (SELECT u, count(*) AS n FROM b GROUP BY u) SELECT b.u AS i, b.v AS j, round(1 / sqrt(x.n * y.n), 9) AS value FROM b JOIN g x ON b.u = x.u JOIN g y ON b.v = y.u")
def sp_affinity(spark, d):
    return G.affinity(edges(spark, d)).withColumn("value", F.round("value", 9))


@query("sp_cluster")
def sp_cluster(spark, d):
    return G.spectrum(edges(spark, d), k=2).select("vertex", "cluster")


@query("sp_eigengap")
def sp_eigengap(spark, d):
    return G.eigengap(edges(spark, d))


@query("sp_fiedler")
def sp_fiedler(spark, d):
    return G.spectrum(edges(spark, d), k=2).select("vertex", F.abs("fiedler").alias("fiedler"))


def colors(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), G.first_color("ROUND_ROBIN", "s_suppkey", 4).alias("color"))


@query("jb_init_color", "SELECT s_suppkey AS id, s_suppkey % 4 AS round_robin, CAST(ceil((s_suppkey + 1) * 4 / (SELECT count(*) FROM supplier)::DOUBLE) - 1 AS BIGINT) AS batch FROM supplier")
def jb_init_color(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") + 1).alias("one"))
    n = s.agg(F.count("*").alias("n"))
    return s.crossJoin(F.broadcast(n)).select("id", G.first_color("ROUND_ROBIN", "id", 4).alias("round_robin"), G.first_color("BATCH", "one", 4, F.col("n")).alias("batch"))


@query("agg_edge_cut", f"WITH {EDGES} SELECT CAST(sum(CAST(u % 4 <> v % 4 AS INTEGER)) AS BIGINT) AS edge_cut FROM edges")
def agg_edge_cut(spark, d):
    return G.edge_cut(edges(spark, d), colors(spark, d))


@query("agg_degree_by_color", f"WITH {EDGES}, b AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges) SELECT u AS id, v % 4 AS color, count(*) AS degree FROM b GROUP BY u, v % 4")
def agg_degree_by_color(spark, d):
    return G.degrees_by_color(edges(spark, d), colors(spark, d))


@query("agg_color_dist", "SELECT s_suppkey % 4 AS color, count(*) AS n FROM supplier GROUP BY 1")
def agg_color_dist(spark, d):
    return colors(spark, d).groupBy("color").agg(F.count("*").alias("n"))


@query("jb_anneal", "SELECT range + 1 AS round, greatest(1, round(2 - 0.003::DOUBLE * (range + 1), 6)) AS t FROM range(400)")
def jb_anneal(spark, d):
    return spark.createDataFrame([(i + 1, round(t, 6)) for i, t in enumerate(G.schedule("LINEAR", 2.0, 0.003, 400))], "round long, t double")


@query("jb_run")
def jb_run(spark, d):
    return G.swap_partition(edges(spark, d), rounds=1000)


@query("jb_report")
def jb_report(spark, d):
    return G.swap_partition(edges(spark, d), rounds=3, annealer="EXP", t=1.0, delta=0.9).orderBy(F.desc("round")).limit(1)
