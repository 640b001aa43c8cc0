"""Queries of keyword, BM25 and vector retrieval, fusion, reranking and text shaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators import incremental, retrieval, services
from lodegraph.operators.retrieval import cosine, rrf, tokens, top_k
from lodegraph.registry import query
from lodegraph.session import settle
from lodegraph.sources.tables import SYMBOLS_SQL, load, symbols

QUERY, WORDS = "the erst license", ("the", "erst", "license")
#: Tokens as retrieval.tokens() reads them, of a column.
TOKENS_SQL = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"

_BM25 = (
    "d AS (SELECT doc_id AS id, " + TOKENS_SQL.format(c="coalesce(text, '')") + " AS ts FROM documents), t AS (SELECT id, len(ts) AS dl, " + ", ".join(f"len(list_filter(ts, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(sorted(WORDS))) + " FROM d), "
    "st AS (SELECT count(*) AS n, avg(dl) AS avgdl, " + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(3)) + " FROM t), "
    "sc AS (SELECT id, " + " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(3)) + " AS score FROM t, st WHERE " + " OR ".join(f"tf{i} > 0" for i in range(3)) + ")"
)


def docs(spark, sf):
    return load(spark, sf, "documents")


@query("r5_bm25", f"WITH {_BM25}, b AS (SELECT id, round(score, 6) AS score, round(score / max(score) OVER (), 6) AS normalised FROM sc) SELECT * FROM b ORDER BY score DESC, id LIMIT 20")
def bm25(spark, sf):
    s = retrieval.bm25(docs(spark, sf), QUERY, "doc_id", "text")
    return s.select("id", F.round("score", 6).alias("score"), F.round("normalised", 6).alias("normalised")).orderBy(F.desc("score"), "id").limit(20)


@query("r6_bm25_docs_min_score", f"WITH {_BM25} SELECT id, round(score / (SELECT max(score) FROM sc), 6) AS normalised FROM sc JOIN documents ON doc_id = id WHERE lang = 'en' AND score / (SELECT max(score) FROM sc) >= 0.6")
def bm25_min_score(spark, sf):
    s = retrieval.bm25(docs(spark, sf), QUERY, "doc_id", "text").where("normalised >= 0.6")
    return s.join(docs(spark, sf).where("lang = 'en'").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", F.round("normalised", 6).alias("normalised"))


@query("r8_postings_stats", "WITH d AS (SELECT doc_id, unnest(" + TOKENS_SQL.format(c="coalesce(text, '')") + ") AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM d GROUP BY 1, 2) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM p GROUP BY 1 HAVING count(*) >= 20")
def postings_stats(spark, sf):
    p = retrieval.postings(docs(spark, sf), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf")).where("df >= 20")


@query("r5_index_search", f"WITH {_BM25}, b AS (SELECT id, round(score, 6) AS score, round(score / max(score) OVER (), 6) AS normalised FROM sc) SELECT * FROM b")
def index_search(spark, sf):
    """The same scores from an inverted index: the texts are read when it is built, and not again."""
    s = retrieval.search_index(retrieval.build_index(docs(spark, sf), "doc_id", "text"), QUERY)
    return s.select("id", F.round("score", 6).alias("score"), F.round("normalised", 6).alias("normalised"))


@query("r2_index_prefixes", "WITH d AS (SELECT doc_id AS id, " + TOKENS_SQL.format(c="coalesce(text, '')") + " AS ts FROM documents), h AS (SELECT id, len(list_filter(ts, lambda x: starts_with(x, 'licen'))) AS a, len(list_filter(ts, lambda x: starts_with(x, 'gen'))) AS b FROM d) SELECT id, (a + b)::BIGINT AS hits FROM h WHERE a > 0 AND b > 0")
def index_prefixes(spark, sf):
    return retrieval.search_prefixes(retrieval.build_index(docs(spark, sf), "doc_id", "text"), ["licen", "gen"])


@query("r7_snippets", f"WITH {_BM25}, k AS (SELECT id FROM sc ORDER BY round(score, 6) DESC, id LIMIT 20) SELECT id, regexp_replace(substr(text, greatest(instr(lower(text), 'license') - 30, 1), 60), '(license)', '<mark>\\1</mark>', 'gi') AS snippet FROM k JOIN documents ON doc_id = id WHERE instr(lower(text), 'license') > 0")
def snippets(spark, sf):
    k = top_k(retrieval.bm25(docs(spark, sf), QUERY, "doc_id", "text").withColumn("score", F.round("score", 6)), 20, F.desc("score"), F.col("id"))
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), "text").join(F.broadcast(k.select("id")), "id")  # twenty rows
    return d.where(F.instr(F.lower("text"), "license") > 0).select("id", retrieval.snippet(F.col("text"), ["license"]).alias("snippet"))


_FIELDS = {"name": 1.0, "project": 0.8, "node_type": 0.5}


def _field_sql(q: str) -> str:
    parts = []
    for w in dict.fromkeys(q.split()):
        for f, weight in _FIELDS.items():
            parts.append(f"SELECT id, '{f}' AS field, {weight} * (1 - (row_number() OVER (ORDER BY id) - 1) / count(*) OVER ()) AS s FROM symbols WHERE len(list_filter({TOKENS_SQL.format(c=f)}, lambda x: starts_with(x, '{w}'))) > 0")
    return f"WITH {SYMBOLS_SQL}, h AS (" + " UNION ALL ".join(parts) + ")"


@query("r9_field_scores", _field_sql("red bolt small") + " SELECT id, round(sum(s), 6) AS score, count(DISTINCT field) AS fields FROM h GROUP BY 1")
def field_scores(spark, sf):
    return retrieval.field_scores(symbols(spark, sf), "red bolt small", _FIELDS).select("id", F.round("score", 6).alias("score"), "fields")


@query("r10_symbol_boosts", f"WITH {SYMBOLS_SQL}, m AS (SELECT *, (CASE WHEN contains(lower(name), 'red') OR contains(lower(project), 'red') OR contains(lower(node_type), 'red') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(name), 'bolt') OR contains(lower(project), 'bolt') OR contains(lower(node_type), 'bolt') THEN 1 ELSE 0 END) AS met FROM symbols) SELECT id, (CASE WHEN lower(name) = 'red bolt' THEN 15.0 WHEN starts_with(lower(name), 'red bolt') THEN 8.0 WHEN contains(lower(name), 'red bolt') THEN 4.0 ELSE 0.0 END + met * 2 + CASE WHEN met = 2 THEN 5.0 ELSE 0.0 END)::DOUBLE AS boost FROM m")
def boosts(spark, sf):
    return symbols(spark, sf).select("id", retrieval.symbol_boosts(F.col("name"), F.col("project"), F.col("node_type"), "red bolt").alias("boost"))


@query("r11_keyword_and", f"WITH {SYMBOLS_SQL} SELECT id FROM symbols WHERE contains(lower(name), 'red') AND contains(lower(name), 'bolt') ORDER BY id LIMIT 60")
def keyword_and(spark, sf):
    n = F.lower("name")
    return symbols(spark, sf).where(n.contains("red") & n.contains("bolt")).orderBy("id").limit(60).select("id")


@query("r13_retry_without_ending", f"WITH {SYMBOLS_SQL}, a AS (SELECT id, 0 AS retry FROM symbols WHERE contains(name, 'bolt.js')), b AS (SELECT id, 1 AS retry FROM symbols WHERE contains(name, 'bolt')) SELECT 'bolt.js' AS query, * FROM a UNION ALL SELECT 'bolt.js', * FROM b WHERE NOT EXISTS (SELECT 1 FROM a) UNION ALL SELECT 'ring', id, 0 FROM symbols WHERE contains(name, 'ring')")
def retry(spark, sf):
    """Two queries: one that is only found without its ending, one that is found as it is."""
    s = symbols(spark, sf).select("id", "name")
    found = (services.with_retry(s, "name", q).select(F.lit(q).alias("query"), "id", "retry") for q in ("bolt.js", "ring"))
    return next(found).union(next(found))


@query("r15_query_variants", "SELECT * FROM (VALUES ('retejs', 0, 'retejs'), ('retejs', 1, 'rete'), ('vue-router', 0, 'vue-router'), ('vue-router', 1, 'vue router'), ('vue-router', 2, 'vue-rout'), ('vue-router', 3, 'vue-rou'), ('vue-router', 4, 'vue-ro'), ('vue-router', 5, 'vue-r'), ('SedonaStateService', 0, 'SedonaStateService'), ('SedonaStateService', 1, 'Sedona State Service'), ('SedonaStateService', 2, 'SedonaSt'), ('SedonaStateService', 3, 'SedonaS'), ('SedonaStateService', 4, 'Sedona'), ('SedonaStateService', 5, 'Sedon'), ('load from sax', 0, 'load from sax'), ('bolt.ts', 0, 'bolt.ts'), ('bolt.ts', 1, 'bolt'), ('bolt.ts', 2, 'bolt ts')) AS v(query, place, variant)")
def variants(spark, sf):
    rows = [(q, i, v) for q in ("retejs", "vue-router", "SedonaStateService", "load from sax", "bolt.ts") for i, v in enumerate(retrieval.query_variants(q))]
    return spark.createDataFrame(rows, "query string, place int, variant string")


@query("r16_dedupe_by_name", f"WITH {SYMBOLS_SQL} SELECT name, id, weight FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY weight DESC, id) AS r FROM symbols) WHERE r = 1")
def dedupe_by_name(spark, sf):
    s = symbols(spark, sf).groupBy("name").agg(F.min_by(F.struct("id", "weight"), F.struct(-F.col("weight"), "id")).alias("b"))
    return s.select("name", "b.id", "b.weight")


_DOC_SCORE = "least(CASE WHEN lower(name) = 'blue gear' THEN 2.0 WHEN starts_with(lower(name), 'blue') THEN 1.5 WHEN contains(lower(name), 'gear') THEN 1.0 ELSE 0.5 END + CASE WHEN contains(lower(qualified_name), 'brand#1') THEN 0.8 ELSE 0 END, 3.0)"


@query("r17_docs_relevance", f"WITH {SYMBOLS_SQL}, s AS (SELECT id, {_DOC_SCORE}::DOUBLE AS score FROM symbols) SELECT id, score, CASE WHEN score >= 2 THEN 'exact' WHEN score >= 1.5 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS relevance FROM s")
def docs_relevance(spark, sf):
    score, label = services.doc_relevance(F.col("name"), F.col("qualified_name"), "blue gear", "Brand#1")
    return symbols(spark, sf).select("id", score.alias("score"), label.alias("relevance"))


@query("r18_docs_by_type", f"WITH {SYMBOLS_SQL} SELECT node_type, project, count(*) AS n FROM symbols GROUP BY GROUPING SETS ((node_type), (project), ())")
def docs_by_type(spark, sf):
    return symbols(spark, sf).groupingSets([[F.col("node_type")], [F.col("project")], []], "node_type", "project").agg(F.count("*").alias("n"))


#: The row whose vector stands for the query's.
ASKED = 0
_LEGS_SQL = (
    f"WITH {_BM25}, b AS (SELECT id AS key, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM sc ORDER BY rank LIMIT 50), kw AS (SELECT id, len(list_filter(ts, lambda x: starts_with(x, 'licens'))) AS hits FROM d), k AS (SELECT id AS key, row_number() OVER (ORDER BY hits DESC, id) AS rank FROM kw WHERE hits > 0 ORDER BY rank LIMIT 50), "
    f"g AS (SELECT user_id AS id, count(*) AS c FROM events GROUP BY 1), near AS (SELECT e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS sim FROM embeddings q, embeddings e WHERE q.vec_id = {ASKED} AND e.vec_id <> {ASKED} ORDER BY 2 DESC, 1 LIMIT 50), "
    "vs AS (SELECT id, round(0.7 * round(sim, 6) + 0.3 * CASE WHEN coalesce(c, 0) <= 0 THEN 0.1 ELSE least(1.0, 0.3 + 0.3 * log10(c + 1)) END, 9) AS score FROM near LEFT JOIN g USING (id)), v AS (SELECT id AS key, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vs), "
    "every AS (SELECT key, rank, 1.0 AS w FROM v UNION ALL SELECT key, rank, 0.8 FROM b UNION ALL SELECT key, rank, 0.7 FROM k), f AS (SELECT key, sum(w / (60 + rank)) AS score, min(rank) AS best_rank FROM every GROUP BY 1), most AS (SELECT sum(w / 61) AS most FROM (SELECT DISTINCT w FROM every))"
)


def _ranked(df, *order):
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(F.col("id").alias("key"), "rank")  # fifty rows


def _legs(spark, sf):
    """Vector, BM25 and keyword legs of fifty rows each. The texts are read once for both of theirs; the vector leg goes by similarity and importance together."""
    terms = retrieval.query_terms(QUERY)
    t = settle(retrieval.text_counts(docs(spark, sf), "doc_id", "text", terms, ("licens",)))
    b = top_k(retrieval.bm25_scores(t, len(terms)).withColumn("score", F.round("score", 6)), 50, F.desc("score"), F.col("id"))
    k = top_k(t.where("hits > 0").select("id", "hits"), 50, F.desc("hits"), F.col("id"))
    v = vectors(spark, sf)
    near = retrieval.exact_nearest(v, v.where(F.col("id") == ASKED), 50).select("id", F.round("score", 6).alias("sim"))
    calls = load(spark, sf, "events").select(F.col("user_id").alias("id")).join(F.broadcast(near.select("id")), "id", "left_semi").groupBy("id").agg(F.count("*").alias("c"))  # fifty ids
    combined = near.join(calls, "id", "left").select("id", retrieval.combined_score(F.col("sim"), retrieval.callable_importance(F.coalesce("c", F.lit(0)))).alias("score"))
    return {"vector": settle(_ranked(combined, F.desc("score"), "id")), "bm25": settle(_ranked(b, F.desc("score"), "id")), "keyword": settle(_ranked(k, F.desc("hits"), "id"))}


_SEARCH_SQL = _LEGS_SQL + """, h AS (SELECT key, round(score, 9) AS score, round(score / (SELECT most FROM most), 6) AS normalised, best_rank, source AS project, lang, md5(text) AS name, n_chars AS line FROM f JOIN documents ON doc_id = key),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, line ORDER BY score DESC, best_rank, key) AS r FROM h) WHERE r = 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, best_rank, key) AS rank FROM l),
x AS (SELECT *, first_value(project) OVER (PARTITION BY name ORDER BY rank) AS lead, row_number() OVER (PARTITION BY name ORDER BY rank) AS place, row_number() OVER (PARTITION BY name, project ORDER BY rank) AS nth FROM r),
o AS (SELECT name, string_agg(project, ',' ORDER BY rank) AS also FROM x WHERE project <> lead AND nth = 1 GROUP BY 1),
best AS (SELECT key, score, normalised, best_rank, project, lang, CASE WHEN place = 1 THEN also END AS also_in FROM x LEFT JOIN o USING (name) WHERE NOT (project <> lead AND nth = 1) ORDER BY rank LIMIT 30),
e AS (SELECT DISTINCT o_custkey AS key, l_partkey AS other FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT key FROM best)), er AS (SELECT key, other, row_number() OVER (PARTITION BY key ORDER BY other) AS rank FROM e), rel AS (SELECT key, string_agg(other::VARCHAR, ',' ORDER BY rank) AS related FROM er WHERE rank <= 3 GROUP BY 1)
SELECT key AS doc_id, lang, project, score, normalised, best_rank::INTEGER AS best_rank, also_in, related FROM best LEFT JOIN rel USING (key)"""


@query("hybrid_search_rrf", _SEARCH_SQL)
def hybrid(spark, sf):
    """Vector, BM25 and keyword legs fused by reciprocal ranks; one hit of a place (source and length), copies of a text in other sources folded, the first thirty with their related ids."""
    rows = docs(spark, sf).select(F.col("doc_id").alias("key"), "lang", F.col("source").alias("project"), F.md5("text").alias("name"), F.col("n_chars").alias("line"))
    legs = _legs(spark, sf)
    keys = F.broadcast(legs["vector"].union(legs["bm25"]).union(legs["keyword"]).select("key").distinct())  # 150 rows at most
    rows = settle(rows.join(keys, "key", "left_semi"))
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("l_orderkey")).join(keys, "key", "left_semi")
    other = orders.join(load(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("other")), "l_orderkey").select("key", "other").distinct()
    related = other.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("other")))
    found = retrieval.semantic_search(legs, rows, related, location=("project", "line"))
    return found.select(F.col("key").alias("doc_id"), "lang", "project", "score", "normalised", "best_rank", "also_in", "related")


@query("r30_weighted_rrf", _LEGS_SQL + " SELECT key, round(score, 9) AS score, best_rank::INTEGER AS best_rank FROM f")
def weighted_rrf(spark, sf):
    return rrf(_legs(spark, sf), retrieval.WEIGHTS).select("key", F.round("score", 9).alias("score"), "best_rank")


@query("r20_unweighted_rrf", _LEGS_SQL + ", z AS (SELECT key, sum(1 / (60 + rank)) AS score FROM every GROUP BY 1) SELECT key, round(score, 9) AS score FROM z")
def unweighted_rrf(spark, sf):
    return rrf(_legs(spark, sf)).select("key", F.round("score", 9).alias("score"))


@query("r34_changed_positions", _LEGS_SQL + " SELECT count(*) FILTER (x.key IS DISTINCT FROM y.key) AS changed FROM (SELECT * FROM b WHERE rank <= 20) x FULL JOIN (SELECT * FROM k WHERE rank <= 20) y USING (rank)")
def changed_positions(spark, sf):
    legs = _legs(spark, sf)
    a, b = (legs[n].where("rank <= 20").select("rank", F.col("key").alias(n)) for n in ("bm25", "keyword"))
    return a.join(b, "rank", "full_outer").agg(F.count_if(~F.col("bm25").eqNullSafe(F.col("keyword"))).alias("changed"))


@query("r40_hybrid_merge", _LEGS_SQL + " SELECT coalesce(b.key, k.key) AS key, round(greatest(0.6 / coalesce(b.rank, 1000), 0.4 / coalesce(k.rank, 1000)), 9) AS score, CASE WHEN b.key IS NOT NULL AND k.key IS NOT NULL THEN 'both' WHEN b.key IS NOT NULL THEN 'fts' ELSE 'memory' END AS source FROM b FULL JOIN k USING (key)")
def hybrid_merge(spark, sf):
    legs = _legs(spark, sf)
    return services.merged_backends(legs["bm25"], legs["keyword"])


# --- vectors ------------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"
_NEAR = f"n AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)"


def vectors(spark, sf):
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query("r22_exact_nearest", f"WITH {_NEAR} SELECT query_id, id, score, rank::INTEGER AS rank FROM n WHERE rank <= 10")
def exact_nearest(spark, sf):
    v = vectors(spark, sf)
    return retrieval.exact_nearest(v, v.where("id % 20 = 0"), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("r22_best_chunk_per_node", f"WITH {_NEAR}, c AS (SELECT query_id, id // 4 AS node, arg_max(id, (round(score, 6), -id)) AS chunk, max(score) AS score FROM n GROUP BY 1, 2) SELECT query_id, node, chunk, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS r FROM c) WHERE r <= 5")
def best_chunk(spark, sf):
    """Vectors are chunks of nodes, four to a node; each node counts at its best chunk."""
    v = vectors(spark, sf)
    q = v.where("id % 20 = 0")
    # 20 candidates hold the five best nodes, since no node has more than four chunks
    n = retrieval.exact_nearest(v, q, 20).withColumn("score", F.round("score", 6)).withColumn("node", F.floor(F.col("id") / 4))
    c = n.groupBy("query_id", "node").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("chunk"), F.max("score").alias("score"))
    return top_k(c, 5, F.desc("score"), F.col("node"), by=("query_id",)).select("query_id", "node", "chunk", "score")


@query("r21_filtered_nearest", f"SELECT id, score FROM (SELECT e.vec_id AS id, {_COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id = 0 AND e.vec_id <> 0 AND e.label IN (1, 3)) WHERE score >= 0.05 ORDER BY score DESC, id LIMIT 20")
def filtered_nearest(spark, sf):
    """One query among rows of two labels, over a floor: filters come before the distance."""
    v = vectors(spark, sf)
    q = v.where("id = 0").select(F.col("v").alias("q"))
    hit = v.where("label in (1, 3) and id <> 0").crossJoin(F.broadcast(q)).select("id", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score"))  # one query row
    return hit.where("score >= 0.05").orderBy(F.desc("score"), "id").limit(20)


@query("r24_point_get", "SELECT vec_id AS id, len(embedding)::INTEGER AS dims, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id = 42")
def point_get(spark, sf):
    return vectors(spark, sf).where("id = 42").select("id", F.size("v").alias("dims"), F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("first"))


@query("r25_similar_items", f"WITH {_NEAR} SELECT n.id, score, label FROM n JOIN embeddings e ON e.vec_id = n.id WHERE query_id = 40 AND rank <= 10")
def similar_items(spark, sf):
    v = vectors(spark, sf)
    near = retrieval.exact_nearest(v, v.where("id = 40"), 10)
    return near.join(v.select("id", "label"), "id").select("id", F.round("score", 6).alias("score"), "label")


@query("r27_combined_score", f"WITH {_NEAR}, g AS (SELECT user_id AS id, count(*) AS c FROM events GROUP BY 1) SELECT query_id, n.id, round(0.7 * score + 0.3 * CASE WHEN coalesce(c, 0) <= 0 THEN 0.1 ELSE least(1.0, 0.3 + 0.3 * log10(c + 1)) END, 9) AS score FROM n LEFT JOIN g ON g.id = n.id WHERE rank <= 5")
def combined_score(spark, sf):
    v = vectors(spark, sf)
    n = retrieval.exact_nearest(v, v.where("id % 20 = 0"), 5)
    c = load(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("c"))
    return n.join(c, "id", "left").select("query_id", "id", retrieval.combined_score(F.round("score", 6), retrieval.callable_importance(F.coalesce("c", F.lit(0)))).alias("score"))


@query("r29_type_importance", "SELECT s_suppkey AS id, round(CASE WHEN w <= 0 THEN 0.1 ELSE least(1.0, 0.2 + 0.3 * log10(w + 1)) END, 6) AS importance FROM (SELECT s_suppkey, 2 * count(l_orderkey) + count(DISTINCT l_partkey) + 3 * count(*) FILTER (l_returnflag = 'R') + 3 * count(*) FILTER (l_linestatus = 'F') AS w FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1)")
def type_importance(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("u"), F.countDistinct("l_partkey").alias("c"), F.count_if(F.col("l_returnflag") == "R").alias("e"), F.count_if(F.col("l_linestatus") == "F").alias("i"))
    j = load(spark, sf, "supplier").join(li, F.col("l_suppkey") == F.col("s_suppkey"), "left").na.fill(0, ["u", "c", "e", "i"])
    return j.select(F.col("s_suppkey").alias("id"), F.round(retrieval.type_importance(F.col("u"), F.col("c"), F.col("e"), F.col("i")), 6).alias("importance"))


@query("r32_location_dedupe", "SELECT file, line, id, score FROM (SELECT user_id % 20 AS file, event_id % 50 AS line, event_id AS id, value AS score, row_number() OVER (PARTITION BY user_id % 20, event_id % 50 ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def location_dedupe(spark, sf):
    e = load(spark, sf, "events").select((F.col("user_id") % 20).alias("file"), (F.col("event_id") % 50).alias("line"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    return e.groupBy("file", "line").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), "id")).alias("b")).select("file", "line", "b.id", "b.score")


@query("r33_version_fold", f"""WITH {SYMBOLS_SQL}, h AS (SELECT id, name, CASE WHEN id % 11 <> 0 THEN project END AS project, row_number() OVER (ORDER BY weight DESC, id) AS rank FROM symbols ORDER BY rank LIMIT 200), x AS (SELECT *, first_value(project) OVER (PARTITION BY name ORDER BY rank) AS lead, row_number() OVER (PARTITION BY name ORDER BY rank) AS place, row_number() OVER (PARTITION BY name, project ORDER BY rank) AS nth FROM h WHERE project IS NOT NULL),
o AS (SELECT name, string_agg(project, ',' ORDER BY rank) AS also FROM x WHERE project <> lead AND nth = 1 GROUP BY 1) SELECT x.id, x.name, x.project, rank::INTEGER AS rank, CASE WHEN place = 1 THEN also END AS also_in FROM x LEFT JOIN o USING (name) WHERE NOT (project <> lead AND nth = 1) UNION ALL SELECT id, name, project, rank::INTEGER, NULL FROM h WHERE project IS NULL""")
def version_fold(spark, sf):
    top = symbols(spark, sf).orderBy(F.desc("weight"), "id").limit(200)
    hits = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), "id"))).select("id", "name", F.when(F.col("id") % 11 != 0, F.col("project")).alias("project"), "rank")  # two hundred rows
    return retrieval.fold(hits, ["name"], "project").select("id", "name", "project", "rank", "also_in")


_BLEND = "row_number() OVER (ORDER BY weight DESC, id) AS place, (length(name) % 7) / 7.0 AS judged"


@query("r35_rerank_blend", f"WITH {SYMBOLS_SQL}, h AS (SELECT id, {_BLEND} FROM symbols ORDER BY place LIMIT 80) SELECT id, place::INTEGER AS place, round(CASE WHEN place <= 50 THEN 0.7 * judged + 0.3 / place ELSE -place END, 6) AS score FROM h")
def rerank_blend(spark, sf):
    """The first fifty by a cross score (a stand-in: the name's length) and their fused score; the rest keep their order below."""
    top = symbols(spark, sf).orderBy(F.desc("weight"), "id").limit(80)
    h = top.select("id", F.row_number().over(Window.orderBy(F.desc("weight"), "id")).alias("place"), ((F.length("name") % 7) / 7.0).alias("judged"))
    return h.select("id", "place", F.round(F.when(F.col("place") <= 50, 0.7 * F.col("judged") + 0.3 / F.col("place")).otherwise(-F.col("place")), 6).alias("score"))


@query("r36_rerank_text", f"WITH {SYMBOLS_SQL} SELECT id, qualified_name || chr(10) || node_type || chr(10) || substr(name, 1, 5) AS text FROM symbols")
def rerank_text(spark, sf):
    return symbols(spark, sf).select("id", F.concat_ws("\n", "qualified_name", "node_type", F.substring("name", 1, 5)).alias("text"))


@query("r37_rerank_replies", "SELECT event_id AS id, (json_extract_string(props, '$.k')::BIGINT / 100)::DOUBLE AS score FROM events")
def rerank_replies(spark, sf):
    e = load(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), (F.from_json("props", "k bigint")["k"] / 100).alias("score"))


@query("r39_unified_search", f"WITH {_BM25}, t AS (SELECT id, score / (SELECT max(score) FROM sc) AS text_score FROM sc), g AS (SELECT user_id AS id, least(1.0, count(*) / 100.0) AS graph_score FROM events GROUP BY 1), u AS (SELECT coalesce(t.id, g.id) AS id, round(0.4 * coalesce(text_score, 0) + 0.2 * coalesce(graph_score, 0), 6) AS score FROM t0 t FULL JOIN g ON g.id = t.id) SELECT * FROM u WHERE score >= 0.3".replace("t AS (SELECT id, score / ", "t0 AS (SELECT id, score / "))
def unified_search(spark, sf):
    t = retrieval.bm25(docs(spark, sf), QUERY, "doc_id", "text").select("id", F.col("normalised").alias("text_score"))
    g = load(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.least(F.lit(1.0), F.count("*") / 100.0).alias("graph_score"))
    return services.unified(t, g)


def _words_sql(q: str) -> str:
    t, m = [], []
    for w in q.split():
        t.append(f"CASE WHEN lower(name) = '{w}' THEN 0.65 WHEN starts_with(lower(name), '{w}') THEN 0.55 WHEN contains(lower(name), '{w}') THEN 0.45 ELSE 0 END + CASE WHEN contains(lower(qualified_name), '{w}') THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(node_type), '{w}') THEN 0.1 ELSE 0 END")
        m.append(f"CASE WHEN contains(lower(name), '{w}') OR contains(lower(qualified_name), '{w}') OR contains(lower(node_type), '{w}') THEN 1 ELSE 0 END")
    return f"({' + '.join(t)} + ({' + '.join(m)}) / {len(m)} * 0.5 + CASE WHEN {' + '.join(m)} = {len(m)} THEN 0.3 ELSE 0 END)"


@query("r44_text_score_words", f"WITH {SYMBOLS_SQL} SELECT id, round({_words_sql('red ring')}, 6)::DOUBLE AS score FROM symbols")
def text_score_words(spark, sf):
    return symbols(spark, sf).select("id", F.round(retrieval.keyword_score(F.col("name"), F.col("qualified_name"), F.col("node_type"), "red ring"), 6).alias("score"))


@query("r44_text_score_word", f"WITH {SYMBOLS_SQL} SELECT id, (CASE WHEN lower(name) = 'ring' THEN 1.0 WHEN lower(qualified_name) = 'ring' THEN 0.9 WHEN starts_with(lower(name), 'ring') THEN 0.7 WHEN contains(lower(name), 'ring') THEN 0.5 WHEN contains(lower(node_type), 'ring') THEN 0.3 ELSE 0.0 END)::DOUBLE AS score FROM symbols")
def text_score_word(spark, sf):
    return symbols(spark, sf).select("id", retrieval.keyword_score(F.col("name"), F.col("qualified_name"), F.col("node_type"), "ring").alias("score"))


@query("r43_versioned_ranking", f"""WITH {SYMBOLS_SQL}, s AS (SELECT id, qualified_name, round({_words_sql('red ring')}, 6) AS t, CASE WHEN size = 20 THEN 1.0 WHEN size < 20 THEN 0.7 ELSE 0.0 END AS v, CASE node_type WHEN 'SMALL' THEN 1.0 WHEN 'LARGE' THEN 0.9 WHEN 'ECONOMY' THEN 0.7 ELSE 0.5 END AS src, CASE WHEN name <> '' THEN 0.3 ELSE 0 END + CASE WHEN weight > 1000 THEN 0.2 ELSE 0 END AS full_ FROM symbols),
r AS (SELECT id, qualified_name, round(0.4 * t + 0.25 * v + 0.2 * src + 0.15 * full_, 2)::DOUBLE AS score FROM s) SELECT qualified_name, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qualified_name ORDER BY score DESC, id) AS n FROM r) WHERE n = 1 ORDER BY score DESC, qualified_name LIMIT 50""")
def versioned_ranking(spark, sf):
    t = F.round(retrieval.keyword_score(F.col("name"), F.col("qualified_name"), F.col("node_type"), "red ring"), 6)
    source = services.source_score(F.col("node_type"), {"SMALL": 1.0, "LARGE": 0.9, "ECONOMY": 0.7})
    full = services.completeness((F.col("name") != "", 0.3), (F.col("weight") > 1000, 0.2))
    r = symbols(spark, sf).select("id", "qualified_name", services.ranked_score(t, services.version_score(F.col("size"), F.lit(20)), source, full).alias("score"))
    return services.best_of(r, "qualified_name", 50).select("qualified_name", "id", "score")


@query("r46_graph_leg", "WITH e AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem), c AS (SELECT a AS id, count(*) AS callees FROM e GROUP BY 1), k AS (SELECT b AS id, count(DISTINCT a) AS callers FROM e GROUP BY 1) SELECT c.id, round(0.7 * least(1.0, coalesce(callers, 0) / 20.0) + 0.3 * least(1.0, callees / 30.0), 6)::DOUBLE AS score FROM c LEFT JOIN k USING (id)")
def graph_leg(spark, sf):
    e = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    c, k = e.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("callees")), e.groupBy(F.col("b").alias("id")).agg(F.countDistinct("a").alias("callers"))
    return c.join(k, "id", "left").select("id", F.round(services.graph_leg_score(F.col("callers"), F.col("callees")), 6).alias("score"))


@query("r48_minmax_rerank", f"WITH {SYMBOLS_SQL}, h AS (SELECT id, project, weight AS s FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY weight DESC, id) AS r FROM symbols) WHERE r <= 50) SELECT id, project, round(CASE WHEN max(s) OVER w = min(s) OVER w THEN 1.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END, 6)::DOUBLE AS score FROM h WINDOW w AS (PARTITION BY project)")
def minmax_rerank(spark, sf):
    h = top_k(symbols(spark, sf), 50, F.desc("weight"), F.col("id"), by=("project",))
    return services.min_max(h.select("id", "project", "weight"), "weight", ["project"]).select("id", "project", F.round("score", 6).alias("score"))


@query("r51_card_hybrid", f"WITH {_NEAR}, c AS (SELECT id, score FROM n WHERE query_id = 0 AND rank <= 20), f AS (SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'license')) SELECT coalesce(c.id, f.id) AS id, coalesce(score, 0)::DOUBLE AS score, c.id IS NOT NULL AND f.id IS NOT NULL AS both FROM c FULL JOIN f ON f.id = c.id")
def card_hybrid(spark, sf):
    v = vectors(spark, sf)
    c = retrieval.exact_nearest(v, v.where("id = 0"), 20).select("id", F.round("score", 6).alias("score"))
    return services.vector_and_text(c, docs(spark, sf).where(F.lower("text").contains("license")).select(F.col("doc_id").alias("id")))


@query("r52_project_search", "WITH s AS (SELECT s_suppkey AS id, lower(s_name) AS name, 'nation' || s_nationkey AS path, 'pod' || s_suppkey % 13 AS pod, 'owned by ' || CASE WHEN s_acctbal > 0 THEN 'us' ELSE 'them' END AS description FROM supplier), x AS (SELECT q AS query, id, CASE WHEN trim(q) = '' THEN 0.5 ELSE greatest(CASE WHEN name = lower(q) THEN 1.0 WHEN starts_with(name, lower(q)) THEN 0.9 WHEN contains(name, lower(q)) THEN 0.7 ELSE 0 END, CASE WHEN contains(pod, lower(q)) THEN 0.6 ELSE 0 END, CASE WHEN contains(path, lower(q)) THEN 0.5 ELSE 0 END, CASE WHEN contains(description, lower(q)) THEN 0.3 ELSE 0 END) END::DOUBLE AS score, CASE WHEN trim(q) = '' THEN '' ELSE concat_ws(',', CASE WHEN contains(name, lower(q)) THEN 'name' END, CASE WHEN contains(pod, lower(q)) THEN 'podName' END, CASE WHEN contains(path, lower(q)) THEN 'path' END, CASE WHEN contains(description, lower(q)) THEN 'description' END) END AS matched_on FROM s, (VALUES ('Supplier#000000007'), ('7'), ('them'), (' ')) AS v(q)) SELECT query, id, score, matched_on FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM x WHERE score > 0) WHERE r <= 100")
def project_search(spark, sf):
    """A whole name, a part that names, pods and paths share, and the empty query."""
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("name"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("path"), F.concat(F.lit("pod"), (F.col("s_suppkey") % 13).cast("string")).alias("pod"), F.concat(F.lit("owned by "), F.when(F.col("s_acctbal") > 0, "us").otherwise("them")).alias("description"))

    def found(q: str):
        score, on = services.project_score(q, F.col("name"), F.col("path"), F.col("pod"), F.col("description"))
        return s.select(F.lit(q).alias("query"), "id", score.alias("score"), on.alias("matched_on")).where("score > 0").orderBy(F.desc("score"), "id").limit(100)

    return found("Supplier#000000007").union(found("7")).union(found("them")).union(found(" "))


@query("r53_code_samples", "SELECT doc_id AS id, (CASE WHEN contains(lower(text), 'license') THEN 2 ELSE 0 END + CASE WHEN contains(lower(source), 'license') THEN 1 ELSE 0 END + CASE WHEN lang IN ('en', 'de') THEN 0.5 ELSE 0 END + CASE WHEN length(text) - length(replace(text, chr(10), '')) + 1 <= 10 THEN 0.3 ELSE 0 END)::DOUBLE AS score FROM documents")
def code_samples(spark, sf):
    return docs(spark, sf).select(F.col("doc_id").alias("id"), services.sample_score("License", F.col("text"), F.col("source"), F.col("lang"), ("en", "de")).alias("score"))


@query("r54_complexity", "WITH s AS (SELECT p_partkey AS id, p_size % 6 AS n, p_type AS type FROM part) SELECT id, CASE WHEN n = 0 OR n = 1 AND type <> 'ECONOMY' THEN 'simple' WHEN n >= 4 OR type IN ('ECONOMY', 'PROMO') THEN 'complex' ELSE 'medium' END AS complexity FROM s")
def complexity(spark, sf):
    """Functions of none to five parameters; one kind of part has a type of alternatives, another one of a list, as its last."""
    n = F.col("p_size") % 6
    last = F.when(F.col("p_type") == "ECONOMY", "Int|Str").when(F.col("p_type") == "PROMO", "Str[]").otherwise("Int")
    types = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array_repeat(F.lit("Int"), n - 1), F.array(last)))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), services.complexity_class(types).alias("complexity"))


@query("r56_evidence_budget", "SELECT conv_id, turn, running::BIGINT AS running FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT conv_id, min(turn) AS turn, text FROM conversations GROUP BY conv_id, text)) WHERE running <= 2000")
def evidence_budget(spark, sf):
    """Turns of a conversation as evidence, repeated texts once, up to 2,000 characters."""
    c = load(spark, sf, "conversations").groupBy("conv_id", "text").agg(F.min("turn").alias("turn")).withColumn("size", F.length("text"))
    return incremental.within_budget(c, ["conv_id"], [F.col("turn")], "size", 2000).select("conv_id", "turn", "running")


@query("r57_identifier_gates", "WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 12)) AS want FROM benchmark), h AS (SELECT list_distinct(flatten(list(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 12)))) AS have FROM conversations) SELECT item_id, len(want)::BIGINT AS wanted, len(list_intersect(want, have))::BIGINT AS found FROM q, h")
def identifier_gates(spark, sf):
    """Long words of each question, and how many of them the evidence has."""
    b = load(spark, sf, "benchmark")
    have = services.identifiers(load(spark, sf, "conversations"), "conv_id", tokens(F.col("text")))
    return services.identifier_gates(b, "item_id", services.identifiers(b, "item_id", tokens(F.col("text"))), have)


@query("r58_coverage", f"WITH {_NEAR} SELECT query_id, id, round(CASE WHEN rank <= 1 THEN 1.0 ELSE 1 - least(greatest((1 - score) / (10 - 1), 0), 1) END, 6)::DOUBLE AS coverage FROM n WHERE rank <= 10")
def coverage(spark, sf):
    v = vectors(spark, sf)
    n = retrieval.exact_nearest(v, v.where("id % 20 = 0"), 10).withColumn("score", F.round("score", 6))
    return n.select("query_id", "id", F.round(services.coverage(F.col("rank"), F.col("score"), 10), 6).alias("coverage"))


@query("a20_recall_metrics", f"WITH {_NEAR}, a AS (SELECT * FROM n WHERE rank <= 10), b AS (SELECT query_id, id FROM n WHERE rank <= 8 OR rank = 12), r AS (SELECT a.query_id, count(b.id) / 10.0 AS recall FROM a LEFT JOIN b USING (query_id, id) GROUP BY 1) SELECT round(avg(recall), 6)::DOUBLE AS mean, quantile_disc(recall, 0.5)::DOUBLE AS median, quantile_disc(recall, 0.95)::DOUBLE AS p95 FROM r")
def recall_metrics(spark, sf):
    """Recall of a degraded list against the exact ten, its mean, median and 95th percentile by nearest rank."""
    v = vectors(spark, sf)
    n = retrieval.exact_nearest(v, v.where("id % 20 = 0"), 12)
    a, b = n.where("rank <= 10").select("query_id", "id"), n.where("rank <= 8 or rank = 12").select("query_id", "id", F.lit(1).alias("hit"))
    r = a.join(b, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / 10.0).alias("recall"))
    return r.agg(F.round(F.avg("recall"), 6).alias("mean"), F.expr("percentile_disc(0.5) within group (order by recall)").alias("median"), F.expr("percentile_disc(0.95) within group (order by recall)").alias("p95"))


@query("x1_vector_compatibility", "SELECT a.label, count(*) AS n, round(min(list_cosine_similarity(a.embedding::DOUBLE[], list_transform(b.embedding, lambda x: round(x::DOUBLE, 3)))), 6) AS least FROM embeddings a JOIN embeddings b USING (vec_id) GROUP BY 1")
def vector_compatibility(spark, sf):
    """Two encodings of the same texts (the second coarser): the least cosine of a text with itself."""
    v = vectors(spark, sf)
    coarse = v.select("id", F.transform("v", lambda x: F.round(x.cast("double"), 3)).alias("c"))
    return v.join(coarse, "id").groupBy("label").agg(F.count("*").alias("n"), F.round(F.min(cosine(F.col("v"), F.col("c"))), 6).alias("least"))


# --- text ---------------------------------------------------------------------------------------


@query("t1_chunk_windows", "WITH d AS (SELECT doc_id, string_split(text, ' ') AS ls FROM documents), w AS (SELECT doc_id, ls, unnest(CASE WHEN len(ls) <= 40 THEN [0] ELSE list_transform(range(0, ceil((len(ls) - 40) / 30.0)::BIGINT + 1), lambda i: i * 30) END) AS s FROM d) SELECT doc_id, (s / 30)::INTEGER AS chunk, (s + 1)::INTEGER AS first_line, least(s + 40, len(ls))::INTEGER AS last_line, md5(substr(array_to_string(ls[s + 1 : s + 40], chr(10)), 1, 4000)) AS digest FROM w")
def chunk_windows(spark, sf):
    """Windows over a document's words, laid out one to a line."""
    d = docs(spark, sf).select("doc_id", F.inline(T.chunks(F.replace(F.replace("text", F.lit("\n"), F.lit("\u0001")), F.lit(" "), F.lit("\n")))))
    return d.select("doc_id", "chunk", "first_line", "last_line", F.md5(F.replace("text", F.lit("\u0001"), F.lit("\n"))).alias("digest"))


def _clean_sql(t: str) -> str:
    for pattern in T.COMMENT_MARKS:
        t = f"regexp_replace({t}, '{pattern}', '', 'g')"
    return f"substr(regexp_replace(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), 1, 800)"


@query("t4_clean_text", "SELECT doc_id, md5(" + _clean_sql("(CASE doc_id % 3 WHEN 0 THEN '/** ' || text || chr(10) || ' */' WHEN 1 THEN '// ' || replace(text, chr(10), chr(10) || '// ') ELSE text END)") + ") AS digest FROM documents")
def clean_text(spark, sf):
    """All documents: as block comments, as line comments, and as they are."""
    k = F.col("doc_id") % 3
    source = F.when(k == 0, F.concat(F.lit("/** "), "text", F.lit("\n */"))).when(k == 1, F.concat(F.lit("// "), F.replace("text", F.lit("\n"), F.lit("\n// ")))).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", F.md5(T.clean_documentation(source)).alias("digest"))


@query("t5_kind_labels", "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'method' WHEN 1 THEN 'field' WHEN 2 THEN 'type' WHEN 3 THEN 'mixin' ELSE 'symbol' END AS label FROM part")
def kind_labels(spark, sf):
    kind = F.element_at(F.array(*(F.lit(x) for x in ("constructor", "property", "Enum", "interface", ""))), F.col("p_size") % 5 + 1)
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.kind_label(kind).alias("label"))


@query("t6_path_tokens", "SELECT page_id, array_to_string(list_distinct_ordered, ' ') AS tokens FROM (SELECT page_id, list_filter(string_split(lower(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[-_.]+', ' ', 'g')), ' '), lambda t: length(t) > 1) AS list_distinct_ordered FROM (SELECT page_id, 'pageLoader' || (page_id % 10 + 10) || ' main_view' AS x FROM pages))")
def path_tokens(spark, sf):
    path = F.concat(F.lit("src/"), F.lit("pageLoader"), (F.col("page_id") % 10 + 10).cast("string"), F.lit("/main_view.ts"))
    return load(spark, sf, "pages").select("page_id", T.path_tokens(path, 2).alias("tokens"))


@query("t14_cache_keys", "SELECT doc_id, sha256('m1' || '␟' || '3' || '␟' || sha256(text)) AS key FROM documents")
def cache_keys(spark, sf):
    return docs(spark, sf).select("doc_id", T.joined_hash(F.lit("m1"), F.lit("3"), F.sha2("text", 256)).alias("key"))


@query("t15_conversation_hash", "SELECT conv_id, sha256(string_agg(text, chr(30) ORDER BY turn)) AS hash FROM conversations GROUP BY 1")
def conversation_hash(spark, sf):
    c = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", F.sha2(F.array_join(F.transform("t", lambda x: x["text"]), T.RECORD), 256).alias("hash"))


@query("t16_body_hash", "SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS hash FROM documents")
def body_hash(spark, sf):
    return docs(spark, sf).select("doc_id", T.body_hash(F.col("text")).alias("hash"))


@query("t17_symbol_keys", f"WITH {SYMBOLS_SQL} SELECT id, substr(sha1(project || '␟' || qualified_name || '␟' || node_type), 1, 16) AS key FROM symbols")
def symbol_keys(spark, sf):
    return symbols(spark, sf).select("id", T.symbol_key("project", "qualified_name", "node_type").alias("key"))


@query("t18_legacy_ids", f"WITH {SYMBOLS_SQL} SELECT id, substr(md5(project || ':' || qualified_name || ':' || size), 1, 16) AS key FROM symbols")
def legacy_ids(spark, sf):
    return symbols(spark, sf).select("id", T.legacy_id(F.col("project"), F.col("qualified_name"), F.col("size")).alias("key"))


@query("t19_overloads", f"WITH {SYMBOLS_SQL} SELECT id, qualified_name, (row_number() OVER (PARTITION BY qualified_name, node_type ORDER BY size, id) - 1)::INTEGER AS ordinal FROM symbols")
def overloads(spark, sf):
    w = Window.partitionBy("qualified_name", "node_type").orderBy("size", "id")
    return symbols(spark, sf).select("id", "qualified_name", (F.row_number().over(w) - 1).alias("ordinal"))


@query("t21_qualified_parts", f"WITH {SYMBOLS_SQL} SELECT id, split_part(qualified_name, '::', 1) AS pod, split_part(qualified_name, '::', 2) AS member, string_split(qualified_name, ' ')[-1] AS tail FROM symbols")
def qualified_parts(spark, sf):
    p = F.split("qualified_name", "::")
    return symbols(spark, sf).select("id", p[0].alias("pod"), p[1].alias("member"), F.element_at(F.split(T.target_tail(F.col("qualified_name")), " "), -1).alias("tail"))


@query("t22_signatures", f"WITH {SYMBOLS_SQL}, s AS (SELECT id, node_type || ' ' || replace(name, ' ', '_') || '(' || array_to_string(list_transform(range(0, size % 4), lambda i: 'Int a' || i), ', ') || ')' AS signature FROM symbols) SELECT id, signature, (SELECT x.size % 4 FROM symbols x WHERE x.id = s.id)::INTEGER AS params FROM s")
def signatures(spark, sf):
    n = F.col("size") % 4
    params = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.lit("Int a"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    s = symbols(spark, sf).select("id", F.concat(F.col("node_type"), F.lit(" "), F.replace("name", F.lit(" "), F.lit("_")), F.lit("("), F.array_join(params, ", "), F.lit(")")).alias("signature"))
    return s.withColumn("params", T.parameter_count(F.col("signature")))


@query("t23_categories", f"WITH {SYMBOLS_SQL} SELECT CASE WHEN contains(lower(project), '#1') THEN 'one' WHEN starts_with(name, 'red') THEN 'red' WHEN contains(name, 'gear') OR contains(lower(node_type), 'promo') THEN 'gear' ELSE 'other' END AS category, count(*) AS n FROM symbols GROUP BY 1")
def categories(spark, sf):
    """An ordered ladder of rules; the first that holds names the category."""
    c = F.when(F.lower("project").contains("#1"), "one").when(F.col("name").startswith("red"), "red").when(F.col("name").contains("gear") | F.lower("node_type").contains("promo"), "gear").otherwise("other")
    return symbols(spark, sf).groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query("t26_languages", "SELECT CASE event_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'ts' WHEN 2 THEN 'fan' ELSE 'unknown' END AS language, count(*) AS n FROM events GROUP BY 1")
def languages(spark, sf):
    path = F.concat(F.lit("src/f"), F.element_at(F.array(*(F.lit(x) for x in (".py", ".tsx", ".fan", ".bin"))), (F.col("event_id") % 4 + 1).cast("int")))
    return load(spark, sf, "events").groupBy(T.language(path).alias("language")).agg(F.count("*").alias("n"))


@query("t27_first_sentences", r"SELECT doc_id, CASE WHEN h <> '' THEN h ELSE substr(text, 1, 240) END AS sentence FROM (SELECT doc_id, text, regexp_extract(text, '(?s)^(.{19,239}?[.!?])(?:\s|$)', 1) AS h FROM documents)")
def first_sentences(spark, sf):
    return docs(spark, sf).select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@query("t29_hues", "SELECT page_id, abs(list_reduce(list_transform(string_split(url, ''), lambda c: ascii(c)::BIGINT), lambda a, x: (a * 31 + x + 68719476736 * 64 + 2147483648) % 4294967296 - 2147483648, 0::BIGINT)) % 360 AS hue FROM pages")
def hues(spark, sf):
    return load(spark, sf, "pages").select("page_id", T.hue(F.col("url")).alias("hue"))


@query("t10_file_rows", f"WITH {SYMBOLS_SQL} SELECT project, count(*) AS symbols, string_agg(name, ', ' ORDER BY id) FILTER (r <= 10) AS names FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY id) AS r FROM symbols) GROUP BY 1")
def file_rows(spark, sf):
    """A row for each project with its first ten symbols. Lists are cut before they are gathered."""
    w = Window.partitionBy("project").orderBy("id")
    s = symbols(spark, sf).withColumn("r", F.row_number().over(w))
    g = s.groupBy("project").agg(F.count("*").alias("symbols"), F.array_sort(F.collect_list(F.when(F.col("r") <= 10, F.struct("id", "name")))).alias("t"))
    return g.select("project", "symbols", F.array_join(F.transform("t", lambda x: x["name"]), ", ").alias("names"))
