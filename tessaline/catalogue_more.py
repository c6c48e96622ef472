"""More registered queries of the core library: projections, changes in batches, graph analytics, fusion, statistics of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaline.catalogue import COS, E, IP, L2, TRADE, TREE, by_id, ids, query, trade, tree, vectors
from tessaline.functions import vectors as V
from tessaline.operators import analytics, collections, filters, graph, scoring, search
from tessaline.plans.planner import search_by_strategy
from tessaline.session import table, written

# -- projections, collections ---------------------------------------------------------------------------------------


@query("f1_projection", "SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings")
def _(spark, d):
    out = collections.projected(vectors(spark, d), ["label"], "vec_id", with_payload=False, with_vector=True)
    return out.select("vec_id", F.col("embedding")[0].cast("double").alias("x"))


@query("f2_include", "SELECT doc_id, lang, source FROM documents")
def _(spark, d):
    return collections.projected(table(spark, d, "documents"), ["lang", "source"], "doc_id", include=["metadatas"])


@query("s9_set_payload", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' ELSE p_type END AS p_type, CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS p_brand FROM part")
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    return collections.set_payload(part, part.where("p_size > 40"), {"p_type": F.lit("large"), "p_brand": F.lit(None).cast("string")}, "p_partkey").drop("p_size")


@query("s10_batch_status", "SELECT CASE WHEN label % 3 = 0 THEN 'wrong dimension' WHEN label % 3 = 1 THEN 'no id' ELSE 'completed' END AS status, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, d):
    e = vectors(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    kind = F.col("label") % 3
    changes = vectors(spark, d).select(F.when(kind != 1, F.col("vec_id")).alias("id"), F.when(kind == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("embedding"), F.col("vec_id").alias("operation"))
    return collections.batch_upsert(collections.Collection("e", e, dim=64), changes)[1].groupBy("status").agg(F.count("*").alias("n"))


@query("s10_batch_upsert", "SELECT vec_id AS id, CASE WHEN label > 4 THEN 'new' ELSE 'old' END AS state FROM embeddings")
def _(spark, d):
    e = vectors(spark, d).select(F.col("vec_id").alias("id"), "embedding", F.lit("old").alias("state"))
    changes = vectors(spark, d).where("label > 4").select(F.col("vec_id").alias("id"), "embedding", F.explode(F.array(F.lit("first"), F.lit("new"))).alias("state"))
    changes = changes.withColumn("operation", F.when(F.col("state") == "new", 2).otherwise(1))
    return collections.batch_upsert(collections.Collection("e", e, dim=64), changes)[0].rows.select("id", "state")


@query("g26_collection_metadata", f"""WITH {E}, n AS (SELECT label, count(*) AS n, round(avg(len(list_filter(v, lambda x: abs(x) < 0.05)) / len(v)), 6) AS sparsity FROM e GROUP BY label),
  f AS (SELECT * FROM (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS p FROM e) JOIN n USING (label) WHERE p <= least(100, greatest(10, floor(n / 10)))),
  s AS (SELECT a.label, round(avg(greatest(0, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))))), 6) AS similarity FROM f a JOIN f b ON a.label = b.label AND a.p < b.p GROUP BY 1)
  SELECT label, n, sparsity, similarity FROM n LEFT JOIN s USING (label)""")
def _(spark, d):
    return collections.similarity_within(vectors(spark, d), "label")


# -- filters --------------------------------------------------------------------------------------------------------


@query("f7_where_map", "SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src1'")
def _(spark, d):
    return table(spark, d, "documents").where(filters.where({"lang": "de", "source": "src1"})).select("doc_id")


@query("f8_fixed_filter", f"SELECT vec_id FROM (SELECT *, {COS} AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)) WHERE vec_id * 5000 BETWEEN 100000 AND 900000 AND distance <= 0.95")
def _(spark, d):
    rows = search.measured(vectors(spark, d), by_id(spark, d)).select("vec_id", "distance", (F.col("vec_id") * 5000).alias("size"), F.size("embedding").alias("dims"), F.lit("float32").alias("kind"))
    return rows.where(filters.metadata(size=(100_000, 900_000), dims=64, kind="float32", max_distance=0.95)).select("vec_id")


@query("f9_unset_bounds", "SELECT page_id FROM pages WHERE length(html) >= 2000 AND regexp_extract(lower(url), '\\.([^./]*)$', 1) <> 'pdf'")
def _(spark, d):
    long = filters.unless_zero(F.length("html"), 2000, 0) & filters.unless_zero(F.length("html"), 2000, 1000)
    return table(spark, d, "pages").where(long & (filters.extension(F.col("url")) != "pdf")).select("page_id")


@query("f22_sane_results", "SELECT event_id FROM events WHERE value / 490 > 0.1 AND value <> 0")
def _(spark, d):
    e = table(spark, d, "events")
    bad = F.when(F.col("value") == 0, float("nan")).otherwise(F.col("value"))
    return e.where(filters.sane(F.col("value") / 490, F.col("value"), bad)).select("event_id")


@query("f26_path_constraints", f"WITH {TREE} SELECT a.src AS start, c.dst AS id FROM edges a JOIN edges c ON c.src = a.dst WHERE c.type = 'customer' AND c.dst % 2 = 0")
def _(spark, d):
    e = tree(spark, d)
    a, c = e.select(F.col("src").alias("start"), F.col("dst").alias("m"), F.col("type").alias("t1")), e.select(F.col("src").alias("m"), F.col("dst").alias("id"), F.col("type").alias("t2"))
    paths = a.join(c, "m").select("start", "id", F.array("start", "m", "id").alias("path"), F.array("t1", "t2").alias("types"))
    good = filters.path_constraints(F.col("path"), F.col("types"), 2, 2, ["region", "customer"], ["supplier"], True)
    return paths.where(good & (F.col("id") % 2 == 0)).select("start", "id")


# -- vectors --------------------------------------------------------------------------------------------------------


@query("v14_clamped_cosine", f"WITH {E} SELECT vec_id, round(greatest(0, {IP}(v, q) / (sqrt({IP}(v, v)) * sqrt({IP}(q, q)))), 6) AS similarity FROM e, q")
def _(spark, d):
    q = F.array(*[F.lit(x) for x in by_id(spark, d)])
    return vectors(spark, d).select("vec_id", F.round(V.clamped_cosine(V.vec("embedding"), q), 6).alias("similarity"))


@query("v14_equal_codes", "WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 4)) AS c FROM embeddings), q AS (SELECT c AS q FROM c WHERE vec_id = 0) SELECT vec_id, round(len(list_filter(list_zip(c, q), lambda x: x[1] = x[2])) / 64, 6) AS share FROM c, q")
def _(spark, d):
    codes = lambda v: F.transform(v, lambda x: F.floor(x * 4))
    q = F.array(*[F.lit(x) for x in by_id(spark, d)])
    return vectors(spark, d).select("vec_id", F.round(V.equal_share(codes(V.vec("embedding")), codes(q)), 6).alias("share"))


@query("v18_byte_entropy", "WITH b AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS b, length(p_name) AS n FROM part), p AS (SELECT p_partkey, count(*) / n::DOUBLE AS p FROM b GROUP BY p_partkey, b, n) SELECT p_partkey, round(sum(-p * log2(p)) / 8, 6) AS entropy FROM p GROUP BY 1")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(V.byte_entropy(F.col("p_name")), 6).alias("entropy"))


@query("v31_named_vectors", f"WITH {E}, r AS (SELECT vec_id, v[1:32] AS a, v[33:64] AS b, q[1:32] AS p, q[33:64] AS r FROM e, q) SELECT vec_id, round(0.7 * list_inner_product(a, p) + 0.3 * list_inner_product(b, r), 6) AS score FROM r")
def _(spark, d):
    x, v = by_id(spark, d), V.vec("embedding")
    part = lambda a, n: V.dot(F.slice(v, a, 32), F.array(*[F.lit(y) for y in x[n : n + 32]]))
    return vectors(spark, d).select("vec_id", F.round(0.7 * part(1, 0) + 0.3 * part(33, 32), 6).alias("score"))


# -- search, scoring ------------------------------------------------------------------------------------------------

LISTS = f"""{E}, p AS (SELECT b.vec_id AS list, a.vec_id AS id, round(list_distance(a.v, b.v), 6) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id AND b.vec_id IN (0, 20)),
  k AS (SELECT list, id, round(1 - distance, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY distance, id) AS rank FROM p) WHERE rank <= 50)"""


def _two_lists(spark, d):
    r = search.batch_knn(vectors(spark, d), vectors(spark, d).where("vec_id in (0, 20)"), 50, "l2")
    return r.select(F.col("query_id").alias("list"), "id", "rank", F.round(1 - F.col("distance"), 6).alias("score"))


@query("k9_index_search", f"""WITH {E}, p AS (SELECT b.vec_id AS query_id, a.vec_id AS id, round(list_distance(a.v, b.v), 6) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id AND b.vec_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS n FROM p) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INTEGER AS rank, id, distance FROM r WHERE n <= 20 AND id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 5""")
def _(spark, d):
    """With every cell probed, an index search is exact, and holds expansion, re-ranking and filter."""
    e = vectors(spark, d)
    return search.index_search(e, e.where("vec_id % 20 = 0"), 10, "l2", condition=F.col("vec_id") % 2 == 0, cells=4, probes=4).where("rank <= 5")


@query("k27_strategy", f"WITH {E} SELECT vec_id, {L2} AS distance FROM e, q ORDER BY distance, vec_id LIMIT 10")
def _(spark, d):
    return search_by_strategy(vectors(spark, d), 0, 10)


@query("k20_weighted_sum", f"WITH {LISTS}, s AS (SELECT id, round(sum(CASE list WHEN 0 THEN 0.7 ELSE 0.3 END * score), 6) AS score FROM k GROUP BY id) SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM s")
def _(spark, d):
    return scoring.fuse(_two_lists(spark, d), "weighted_sum", weights={0: 0.7, 20: 0.3})


@query("k20_max_score", f"WITH {LISTS}, s AS (SELECT id, max(score) AS score FROM k GROUP BY id) SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM s")
def _(spark, d):
    return scoring.fuse(_two_lists(spark, d), "max_score")


@query("k21_vector_and_text", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿß]+')) AS w FROM documents), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1), a AS (SELECT count(*) AS docs, avg(n) AS mean FROM n),
  t AS (SELECT doc_id, w, count(*) AS f FROM w WHERE w IN ('the', 'der', 'tion') GROUP BY 1, 2), df AS (SELECT w, count(*) AS df FROM t GROUP BY 1),
  b AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS bm25 FROM t JOIN df USING (w) JOIN n USING (doc_id), a GROUP BY 1)
  SELECT doc_id, round(bm25, 6) AS bm25 FROM b""")
def _(spark, d):
    docs = table(spark, d, "documents")
    return search.bm25(docs.select(F.col("doc_id").alias("id"), "text"), ["the", "der", "tion"]).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("bm25"))


@query("k24_similar_in_neighbourhood", f"WITH RECURSIVE {E}, kp AS (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 6), b.vec_id) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id IN (SELECT vec_id FROM e WHERE label < 3)), edges AS (SELECT src, dst FROM kp WHERE n <= 3 UNION SELECT dst, src FROM kp WHERE n <= 3), b AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT x.dst, b.depth + 1 FROM b JOIN edges x ON x.src = b.id WHERE b.depth < 3) SELECT vec_id, round(1 - {COS}, 6) AS similarity FROM e, q WHERE vec_id IN (SELECT id FROM b) AND round(1 - {COS}, 6) >= 0.1")
def _(spark, d):
    e = vectors(spark, d)
    edges = search.batch_knn(e, e.where("label < 3"), 3, "l2").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"), F.lit("near").alias("type"))
    around = graph.k_hop(written(edges, "nearest"), ids(spark, 0), 3).select(F.col("id").alias("vec_id"))
    return search.similar(e.join(around, "vec_id", "left_semi"), by_id(spark, d), 0.1).select("vec_id", "similarity")


@query("r13_query_classes", "SELECT CASE WHEN p <= 1 THEN 'simple' WHEN p = 2 THEN 'moderate' WHEN p = 3 THEN 'complex' ELSE 'heavy' END AS class, count(*) AS n FROM (SELECT (p_size * 40 > 512)::INT + (p_size * 40 > 1024)::INT + (p_partkey % 200 > 100)::INT + (p_type = 'LARGE')::INT + (NOT p_brand = 'Brand#1')::INT AS p FROM part) GROUP BY 1")
def _(spark, d):
    c = V.query_class(F.col("p_size") * 40, F.col("p_partkey") % 200, F.col("p_type") == "LARGE", F.col("p_brand") == "Brand#1")
    return table(spark, d, "part").select(c.alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("r14_cache_value", "SELECT p_partkey, round(p_size / sqrt(p_retailprice) * 0.5 * (1 + p_partkey % 3), 6) AS value FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(V.cache_value(F.col("p_size"), F.col("p_retailprice"), F.lit(0.5), F.col("p_partkey") % 3), 6).alias("value"))


# -- graphs ---------------------------------------------------------------------------------------------------------

BOTH = f"{TRADE}, both_ AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


def _property_graph(spark, d) -> graph.Graph:
    e = tree(spark, d)
    nodes = e.select(F.col("src").alias("id")).unionAll(e.select("dst")).distinct().withColumn("type", F.when(F.col("id") < 100, "region").when(F.col("id") < 1000, "nation").otherwise("account"))
    return graph.Graph(nodes, e)


@query("g1_remove_cascades", f"WITH {TREE} SELECT type, count(*) AS n FROM edges WHERE src NOT IN (1, 103) AND dst NOT IN (1, 103) GROUP BY type")
def _(spark, d):
    return _property_graph(spark, d).remove_nodes(ids(spark, 1, 103)).edges.groupBy("type").agg(F.count("*").alias("n"))


@query("g1_checked_edges", f"WITH {TREE} SELECT src, dst FROM edges WHERE type = 'region' UNION ALL SELECT 101, 102")
def _(spark, d):
    g = _property_graph(spark, d)
    new = spark.createDataFrame([(101, 102, 1, "extra"), (101, 77, 1, "extra")], "src long, dst long, weight int, type string")
    return g.add_edges(new).edges.where("type in ('region', 'extra')").select("src", "dst")


@query("g22_neighbours", f"WITH {TREE} SELECT id, min(depth) AS depth FROM (SELECT src AS id, 1 AS depth FROM edges WHERE dst = 103 UNION ALL SELECT dst, 2 FROM edges WHERE type = 'region' AND src IN (SELECT src FROM edges WHERE dst = 103) AND dst <> 103) GROUP BY id")
def _(spark, d):
    return _property_graph(spark, d).neighbours(ids(spark, 103), "both", ["region"], 2)


@query("g3_in_edges", f"WITH {TREE} SELECT src AS id, 1 AS depth FROM edges WHERE dst = 1010")
def _(spark, d):
    return _property_graph(spark, d).neighbours(ids(spark, 1010), "in")


@query("g10_constraints", f"WITH {TREE} SELECT dst AS id FROM edges WHERE src = 103 AND dst % 2 = 0")
def _(spark, d):
    g = _property_graph(spark, d)
    return g.constrained(g.nodes.select("id"), g.nodes.where("id % 2 = 0"), ids(spark, 103), 1, ["account"])


@query("g5_depth_first")
def _(spark, d):
    """Ids in depth-first order from a region; a test holds the order."""
    order = graph.dfs(tree(spark, d).where("type = 'region'"), 1)
    return spark.createDataFrame(list(enumerate(order)), "place long, id long")


@query("g19_statistics", f"WITH RECURSIVE {BOTH}, n AS (SELECT count(DISTINCT src) AS n FROM both_), m AS (SELECT count(*) AS m FROM both_ WHERE src < dst) SELECT n AS nodes, m AS edges, round(2 * m / n, 6) AS average_degree, round(2 * m / (n * (n - 1)), 6) AS density, 1::BIGINT AS components, n AS largest, CASE WHEN 2 * m = n * (n - 1) THEN 1 ELSE 2 END::INTEGER AS diameter FROM n, m")
def _(spark, d):
    return graph.statistics(trade(spark, d))


REACH = f"WITH RECURSIVE {TREE}, up AS (SELECT src, dst FROM edges WHERE type = 'region' UNION ALL SELECT dst, src FROM edges WHERE type = 'region')"


@query("g20_closeness", f"""{REACH}, n AS (SELECT src AS id, count(*) AS d FROM up GROUP BY 1), r AS (SELECT u.src AS hub, n.d FROM up u JOIN n ON n.id = u.src WHERE u.src < 100 GROUP BY ALL),
  x AS (SELECT id, d AS reached, d AS total, d::DOUBLE AS harmonic FROM n WHERE id < 100 UNION ALL SELECT u.src, r.d, 1 + 2 * (r.d - 1), 1 + (r.d - 1) / 2 FROM up u JOIN r ON r.hub = u.dst WHERE u.src >= 100)
  SELECT id, round(reached / total, 6) AS closeness, round(harmonic, 6) AS harmonic FROM x""")
def _(spark, d):
    return graph.closeness(graph.all_distances(graph.undirected(tree(spark, d).where("type = 'region'"))))


@query("g20_betweenness", f"""{REACH} SELECT src AS id, CASE WHEN src < 100 THEN count(*) * (count(*) - 1) ELSE 0 END::DOUBLE AS betweenness FROM up GROUP BY src""")
def _(spark, d):
    e = graph.undirected(tree(spark, d).where("type = 'region'"))
    return graph.betweenness(e, graph.all_distances(e))


def _eigen_sql(rounds: int) -> str:
    steps = "".join(
        f""", g{i + 1} AS MATERIALIZED (SELECT x.id, x.x + coalesce((SELECT sum(e.weight * y.x) FROM edges e JOIN x{i} y ON y.id = e.src WHERE e.dst = x.id), 0) AS x FROM x{i} x),
  x{i + 1} AS MATERIALIZED (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM g{i + 1}) AS x FROM g{i + 1})"""
        for i in range(rounds)
    )
    return f"WITH {TRADE}, x0 AS (SELECT id, 1::DOUBLE AS x FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)){steps} SELECT id, round(x, 6) AS centrality FROM x{rounds}"


@query("g20_eigenvector", _eigen_sql(12))
def _(spark, d):
    return graph.eigenvector(trade(spark, d), 12)


@query("g16_louvain")
def _(spark, d):
    """A test holds that moves raise modularity and find planted groups."""
    return graph.louvain_moves(trade(spark, d))


# -- series, events -------------------------------------------------------------------------------------------------


@query("a3_histogram", "SELECT (floor(value / 50) * 50)::DOUBLE AS low, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return analytics.histogram(table(spark, d, "events"), "value", 50)


@query("a7_report", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS low, round(median(value), 6) AS median, max(value) AS high FROM events GROUP BY 1")
def _(spark, d):
    return analytics.summary(table(spark, d, "events"), "event_type", "value")


@query("w4_trailing", "SELECT event_type, event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS 999 PRECEDING), 6) AS mean, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS 999 PRECEDING) AS high, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id), 6) AS running FROM events")
def _(spark, d):
    return analytics.rolling(table(spark, d, "events"), "event_type", "event_id", "value")


@query("a11_hit_rate", "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'click') / count(*) FILTER (WHERE event_type IN ('click', 'view')), 6) AS rate FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type IN ('click', 'view')) > 0")
def _(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "click", 1)).alias("h"), F.count(F.when(F.col("event_type") == "view", 1)).alias("m"))
    return g.where("h + m > 0").select("user_id", F.round(analytics.hit_rate(F.col("h"), F.col("m")), 6).alias("rate"))


@query("ts9_quartiles", "WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id FROM events JOIN q USING (user_id) WHERE value < a - 0.8 * (b - a) OR value > b + 0.8 * (b - a)")
def _(spark, d):
    return analytics.outliers_iqr(table(spark, d, "events"), "user_id", "value", 0.8).select("event_id")


@query("ts9_moving_average", "SELECT event_id, round(before, 6) AS before FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE value > 2 * before")
def _(spark, d):
    return analytics.off_moving_average(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "before")


@query("ts8_pattern", "SELECT user_id, ts AS start, e AS \"end\" FROM (SELECT user_id, ts, event_type AS a, lead(event_type) OVER w AS b, lead(ts) OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE a = 'view' AND b = 'purchase' AND e <= ts + INTERVAL 2 DAY")
def _(spark, d):
    return analytics.followed_by(table(spark, d, "events"), "user_id", "ts", ["ts", "event_id"], "event_type", ["view", "purchase"], "2 days")


@query("g31_priorities", "SELECT CASE event_type WHEN 'error' THEN 100 WHEN 'purchase' THEN 80 WHEN 'signup' THEN 60 WHEN 'click' THEN 40 ELSE 20 END AS priority, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(analytics.priority(F.col("event_type")).alias("priority")).agg(F.count("*").alias("n"))


@query("ts11_valid_facts", "SELECT event_type AS predicate, count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15' AND ts + CASE event_type WHEN 'signup' THEN INTERVAL 24 HOUR WHEN 'error' THEN INTERVAL 6 HOUR ELSE INTERVAL 1 HOUR END > TIMESTAMP '2024-01-15' GROUP BY 1")
def _(spark, d):
    f = analytics.facts_of_events(table(spark, d, "events"), "user_id", "event_type", "ts", {"signup": 24, "error": 6})
    at = F.expr("timestamp_ntz '2024-01-15'")
    return f.where((F.col("valid_from") <= at) & (F.col("valid_to") > at)).groupBy("predicate").agg(F.count("*").alias("n"))


@query("g34_overall", "SELECT event_type, round(100 * (avg((value > 10)::INT) + avg((value > 50)::INT) + 0.5) / 3, 6) AS overall FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.avg((F.col("value") > 10).cast("int")).alias("a"), F.avg((F.col("value") > 50).cast("int")).alias("b"))
    return e.select("event_type", F.round(analytics.overall(F.col("a"), F.col("b"), F.lit(0.5)), 6).alias("overall"))


@query("r15_sorted", f"SELECT id, row_number() OVER (ORDER BY n DESC, id)::INTEGER AS rank FROM (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1)")
def _(spark, d):
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    return scoring.ranked_overall(g, F.col("n").desc(), F.col("id")).select("id", "rank")
