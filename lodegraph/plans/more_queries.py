"""Queries of the smaller operators: query analysis, service legs, scoping, ids, status and exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph.functions import code, headers as H
from lodegraph.functions import text as T
from lodegraph.operators import catalog, incremental, retrieval, services
from lodegraph.plans.relational_queries import _NUM, _V, versions
from lodegraph.plans.retrieval_queries import _NEAR, vectors
from lodegraph.registry import query
from lodegraph.sources import parsers
from lodegraph.sources.tables import SYMBOLS_SQL, load, symbols

S = f"WITH {SYMBOLS_SQL}"


@query("r1_query_analysis", "SELECT item_id, len(list_filter(string_split(lower(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> ''))::INTEGER AS tokens, contains(text, '\"') AS phrase, regexp_matches(text, '\\b(AND|OR|NOT)\\b') AS operators, contains(text, '*') AS wildcard, CASE WHEN contains(text, '\"') OR contains(text, '*') OR regexp_matches(text, '\\b(AND|OR|NOT)\\b') THEN 'fts' WHEN len(list_filter(string_split(lower(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) <= 2 THEN 'memory' ELSE 'both' END AS backend FROM benchmark")
def query_analysis(spark, sf):
    """What a query holds and which backend answers it."""
    return load(spark, sf, "benchmark").select("item_id", services.query_shape(F.col("text")).alias("x")).select("item_id", "x.*")


@query("r2_prefix_query", "SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: starts_with(x, 'licen'))) > 0 AND len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: starts_with(x, 'apach'))) > 0")
def prefix_query(spark, sf):
    """A fuzzy query: each word is a prefix, all must be met."""
    return load(spark, sf, "documents").where(services.begin_all(retrieval.tokens(F.col("text")), ["licen", "apach"])).select("doc_id")


@query("r14_path_words", "SELECT page_id, list_filter(string_split(regexp_replace(regexp_extract(url, '://[^/]+/([^?#]*)', 1), '[/._-]+', ' ', 'g'), ' '), lambda x: x <> '')[1] AS first_word FROM pages")
def path_words(spark, sf):
    path = F.regexp_extract("url", "://[^/]+/([^?#]*)", 1)
    words = F.filter(F.split(F.regexp_replace(path, "[/._-]+", " "), " "), lambda x: x != "")
    return load(spark, sf, "pages").select("page_id", F.get(words, F.lit(0)).alias("first_word"))


@query("r19_docs_keyword_leg", f"{S}, x AS (SELECT id, (CASE WHEN lower(name) = 'red' THEN 2.0 WHEN starts_with(lower(name), 'red') THEN 1.5 WHEN contains(lower(name), 'red') THEN 1.0 WHEN contains(lower(qualified_name), 'red') THEN 0.8 WHEN contains(lower(node_type), 'red') THEN 0.5 ELSE 0 END) AS a, (CASE WHEN lower(name) = 'gear' THEN 2.0 WHEN starts_with(lower(name), 'gear') THEN 1.5 WHEN contains(lower(name), 'gear') THEN 1.0 WHEN contains(lower(qualified_name), 'gear') THEN 0.8 WHEN contains(lower(node_type), 'gear') THEN 0.5 ELSE 0 END) AS b, (CASE WHEN lower(name) = 'ring' THEN 2.0 WHEN starts_with(lower(name), 'ring') THEN 1.5 WHEN contains(lower(name), 'ring') THEN 1.0 WHEN contains(lower(qualified_name), 'ring') THEN 0.8 WHEN contains(lower(node_type), 'ring') THEN 0.5 ELSE 0 END) AS c FROM symbols) SELECT 'red gear' AS query, id, (a + b + CASE WHEN a > 0 AND b > 0 THEN 1 ELSE 0 END)::DOUBLE AS score FROM x WHERE a + b > 0 UNION ALL SELECT 'ring', id, c::DOUBLE FROM x WHERE c > 0")
def docs_leg(spark, sf):
    """Two queries: two words, which gain where both are met, and one."""
    q = symbols(spark, sf)
    score = lambda text: services.doc_keyword_score(F.col("name"), F.col("qualified_name"), F.col("node_type"), text)
    return q.select(F.inline(F.array(*(F.struct(F.lit(t).alias("query"), F.col("id").alias("id"), score(t).alias("score")) for t in ("red gear", "ring"))))).where("score > 0")


@query("r23_text_leg_per_node", "WITH c AS (SELECT doc_id // 5 AS node, doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x = 'the')) AS hits FROM documents) SELECT node, max(hits) AS hits, arg_max(doc_id, (hits, -doc_id)) AS chunk FROM c GROUP BY 1 HAVING max(hits) > 0")
def text_leg(spark, sf):
    hits = F.size(F.filter(retrieval.tokens(F.col("text")), lambda x: x == "the")).cast("long")
    c = load(spark, sf, "documents").select(F.floor(F.col("doc_id") / 5).alias("node"), "doc_id", hits.alias("hits")).where("hits > 0")
    return c.groupBy("node").agg(F.max("hits").alias("hits"), F.max_by("doc_id", F.struct("hits", -F.col("doc_id"))).alias("chunk"))


@query("r41_search_statistics", "SELECT event_type AS backend, count(*) AS searches, round(avg(value), 6) AS mean_ms, count(*) FILTER (value < 10) > 0.3 * count(*) AS hot FROM events GROUP BY 1")
def search_statistics(spark, sf):
    return services.search_statistics(load(spark, sf, "events").select(F.col("event_type").alias("backend"), F.col("value").alias("ms")))


@query("r42_versioned_legs", f"{S} SELECT 'api' AS leg, id, name AS title, NULL AS lang FROM symbols WHERE starts_with(name, 'red') UNION ALL SELECT 'samples', doc_id, source, lang FROM documents WHERE contains(text, 'License') UNION ALL SELECT 'graph', c_custkey, c_name, NULL FROM customer WHERE c_acctbal > 9900")
def versioned_legs(spark, sf):
    """Legs of different columns, side by side."""
    a = symbols(spark, sf).where("startswith(name, 'red')").select("id", F.col("name").alias("title"))
    b = load(spark, sf, "documents").where(F.col("text").contains("License")).select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "lang")
    c = load(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return services.side_by_side({"api": a, "samples": b, "graph": c}).select("leg", "id", "title", "lang")


@query("r45_rank_parts", f"{S} SELECT id, (CASE node_type WHEN 'SMALL' THEN 1.0 WHEN 'LARGE' THEN 0.9 WHEN 'PROMO' THEN 0.7 ELSE 0.5 END)::DOUBLE AS source, (CASE WHEN size = 7 THEN 1.0 WHEN size < 7 THEN 0.7 ELSE 0.0 END)::DOUBLE AS version, round(0.3 + CASE WHEN size > 10 THEN 0.2 ELSE 0 END + CASE WHEN weight > 950 THEN 0.3 ELSE 0 END, 6)::DOUBLE AS completeness FROM symbols")
def rank_parts(spark, sf):
    size = F.col("size")
    source = services.source_score(F.col("node_type"), {"SMALL": 1.0, "LARGE": 0.9, "PROMO": 0.7})
    full = services.completeness((F.lit(True), 0.3), (size > 10, 0.2), (F.col("weight") > 950, 0.3))
    return symbols(spark, sf).select("id", source.alias("source"), services.version_score(size, F.lit(7)).alias("version"), F.round(full, 6).alias("completeness"))


@query("r47_floored_vectors", "SELECT id, score FROM (SELECT e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id = 7 AND e.vec_id <> 7) WHERE score >= 0.25")
def floored(spark, sf):
    v = load(spark, sf, "embeddings")
    q = v.where("vec_id = 7").select(F.col("embedding").alias("q"))
    hit = v.where("vec_id <> 7").crossJoin(F.broadcast(q))  # one query row
    return hit.select(F.col("vec_id").alias("id"), F.round(retrieval.cosine(F.col("q"), F.col("embedding")), 6).alias("score")).where("score >= 0.25")


@query("r55_result_cache", "SELECT sha256(lower(text)) AS key, min(conv_id) AS first_asked, count(*) AS hits FROM conversations WHERE role = 'user' GROUP BY 1")
def result_cache(spark, sf):
    return services.cached_results(load(spark, sf, "conversations").where("role = 'user'"), F.col("text"), "conv_id")


@query("r59_evidence_headers", f"{S} SELECT id, project AS symbol, node_type AS kind, replace(name, ' ', '/') || '.fan' AS file FROM symbols")
def evidence_headers(spark, sf):
    header = services.evidence_header(F.col("project"), F.col("node_type"), F.concat(F.replace("name", F.lit(" "), F.lit("/")), F.lit(".fan")))
    return symbols(spark, sf).select("id", services.parsed_header(header).alias("h")).select("id", "h.symbol", "h.kind", "h.file")


#: Five ways that a file can begin.
_HEADS = ("", "/* plain note */\n", "/* Copyright me\n * all rights reserved */\n", "// Licensed under X\n// by me\n", "# SPDX-License-Identifier: EPL-2.0\n")
_HEADED_SQL = "(CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {' || chr(10) || '.join(repr(x) for x in h.split(chr(10)))}" for i, h in enumerate(_HEADS)) + " END || text)"


@query("t2_without_license", f"WITH s AS (SELECT doc_id, {_HEADED_SQL} AS t FROM documents), h AS (SELECT *, regexp_extract(t, '{code.LEADING_COMMENT}', 0) AS head FROM s), p AS (SELECT *, regexp_replace(lower(head), '\\s+', ' ', 'g') AS plain FROM h) SELECT doc_id, md5(CASE WHEN head <> '' AND (regexp_matches(plain, '\\(c\\) ?[0-9]{{4}}') OR " + " OR ".join(f"contains(plain, '{x}')" for x in T.LICENSE_PHRASES) + ") THEN substr(t, length(head) + 1) ELSE t END) AS digest FROM p")
def without_license(spark, sf):
    """All documents under five heads, of which three speak of a license."""
    head = F.element_at(F.array(*(F.lit(h) for h in _HEADS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return load(spark, sf, "documents").select("doc_id", F.md5(code.without_license(F.concat(head, "text"))).alias("digest"))


@query("t3_clean_body", "SELECT p_partkey AS id, 'x = ' || p_size || chr(10) || chr(10) || 'y' AS body FROM part")
def clean_body(spark, sf):
    raw = F.concat(F.lit("\n\nimport a from 'b'\nx = "), F.col("p_size").cast("string"), F.lit("   \n\n\n\nconst q = require('z')\ny\n\n"))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), code.clean_body(raw).alias("body"))


@query("t7_imports", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'lib' || p_size || ', types, os' WHEN 1 THEN 'haystack, b, os, z' WHEN 2 THEN 'fs, style, brand' || p_size ELSE repeat('x', 100) END AS imports FROM part")
def imports(spark, sf):
    """Four files: modules, another language with a common library among them, calls of require, and a list that is cut where it grows too long."""
    size = F.col("p_size").cast("string")
    long = "import '" + "x" * 100 + "'\nimport '" + "y" * 30 + "'\nimport 'z'\n"
    raw = F.array(
        F.concat(F.lit("import {a} from 'lib"), size, F.lit("'\nimport b from './x/types.ts'\nfrom os.path import join\nimport os\n")),
        F.lit("using haystack::Foo\nusing sys\nimport c from './b'\nimport os.path\nfrom z import y\n"),
        F.concat(F.lit("const f = require('fs')\nimport './style.css'\nexport { q } from \"brand"), size, F.lit("\"\nexport const n = 'none'\n")),
        F.lit(long),
    )
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), code.imports(F.element_at(raw, F.col("p_size") % 4 + 1)).alias("imports"))


@query("t8_headers", "SELECT p_partkey AS id, 'src page loader | imports: lib' || p_size AS header FROM part")
def headers(spark, sf):
    raw = F.concat(F.lit("import 'lib"), F.col("p_size").cast("string"), F.lit("'\n"))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), code.header(F.lit("src/pageLoader.ts"), raw).alias("header"))


@query("t9_items_per_node", "WITH d AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents) SELECT doc_id AS node, (CASE WHEN n <= 40 THEN 1 ELSE 1 + ceil((n - 40) / 30.0) END)::INTEGER AS chunks FROM d")
def items_per_node(spark, sf):
    return load(spark, sf, "documents").select(F.col("doc_id").alias("node"), F.size(T.chunk_starts(F.size(F.split("text", " ", -1)))).alias("chunks"))


@query("t11_statement_chunks", "SELECT p_partkey AS id, 1 AS first_line, (p_size % 5 + 2)::INTEGER AS last_line FROM part")
def statement_chunks(spark, sf):
    body = F.concat(F.lit("a: 1\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 5), lambda i: F.concat(F.lit("  line "), i.cast("string"))), "\n"))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.inline(code.statement_chunks(body)))


@query("t28_query_prefix", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'query: ' WHEN 1 THEN 'search_query: ' ELSE '' END || text AS query FROM benchmark")
def query_prefix(spark, sf):
    model = F.element_at(F.array(F.lit("e5-base"), F.lit("Nomic-v1"), F.lit("other")), (F.col("item_id") % 3 + 1).cast("int"))
    return load(spark, sf, "benchmark").select("item_id", code.query_prefix(model, F.col("text")).alias("query"))


@query("io5_declarations", "SELECT 'f' || p_partkey || '.fan' AS path, line, kind, name, owner FROM part, (VALUES (1, 'class', 'Foo', NULL), (2, 'field', 'count', 'Foo'), (3, 'constructor', 'make', 'Foo'), (4, 'method', 'go', 'Foo')) AS v(line, kind, name, owner)")
def declarations(spark, sf):
    text = "const class Foo : Bar {\n  const Int count := 0\n  new make() { x = 1 }\n  override Str go(Int a) {\n    return a.toStr\n  }\n}"
    f = load(spark, sf, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".fan")).alias("path"), F.lit("fan").alias("language"), F.lit(text).alias("text"))
    return code.declarations(f)


@query("io28_usage_export", """SELECT '"' || event_id || '","' || event_type || '","' || replace(props, '"', '""') || '"' AS line FROM events""")
def usage_export(spark, sf):
    """Lines of CSV, quotes doubled."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    e = load(spark, sf, "events")
    return e.select(F.concat_ws(",", quoted(F.col("event_id")), quoted(F.col("event_type")), quoted(F.col("props"))).alias("line"))


@query("a5_usage_summary", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def usage_summary(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("a6_event_counts", "SELECT count(*) AS events, count(*) FILTER (ts < TIMESTAMP '2024-01-08') AS old, sum(strlen(props))::BIGINT AS bytes FROM events")
def event_counts(spark, sf):
    return load(spark, sf, "events").agg(F.count("*").alias("events"), F.count_if(F.expr("ts < timestamp_ntz '2024-01-08'")).alias("old"), F.sum(F.octet_length("props").cast("long")).alias("bytes"))


@query("a10_nodes_by_language", "SELECT lang AS language, count(*) AS n, count(DISTINCT source) AS projects FROM documents GROUP BY 1")
def nodes_by_language(spark, sf):
    return load(spark, sf, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("projects"))


@query("a19_doc_pod_stats", "SELECT source AS pod, lang, count(*) AS n FROM documents GROUP BY CUBE (source, lang)")
def doc_pod_stats(spark, sf):
    return load(spark, sf, "documents").withColumnRenamed("source", "pod").cube("pod", "lang").agg(F.count("*").alias("n"))


@query("p5_like", f"{S} SELECT id, starts_with(name, 'blue') AS a, ends_with(name, 'ring') AS b, contains(name, 'd') AS c FROM symbols")
def like(spark, sf):
    from lodegraph.operators.dsl import predicate

    return symbols(spark, sf).select("id", predicate(("name", "like", "blue*")).alias("a"), predicate(("name", "like", "*ring")).alias("b"), predicate(("name", "like", "*d*")).alias("c"))


@query("p11_projections", f"{S} SELECT id, name, project, CASE WHEN id % 2 = 0 THEN qualified_name END AS qualified_name FROM symbols")
def projections(spark, sf):
    """Compact rows lack what full rows have."""
    return symbols(spark, sf).select("id", "name", "project", F.when(F.col("id") % 2 == 0, F.col("qualified_name")).alias("qualified_name"))


@query("p14_types_by_project", f"{S} SELECT id, name FROM symbols WHERE project = 'Brand#9' AND node_type IN ('SMALL', 'LARGE', 'PROMO', 'ECONOMY') ORDER BY name, id")
def types_by_project(spark, sf):
    return symbols(spark, sf).where("project = 'Brand#9'").where(F.col("node_type").isin("SMALL", "LARGE", "PROMO", "ECONOMY")).select("id", "name")


@query("p18_symbol_lookup", f"{S}, x AS (SELECT id, project, 1 AS tier FROM symbols WHERE qualified_name = 'Brand#2::red ring' UNION ALL SELECT id, project, 2 FROM symbols WHERE ends_with(qualified_name, '::red ring') UNION ALL SELECT id, project, 3 FROM symbols WHERE name = 'red ring') SELECT min(tier) AS tier, count(DISTINCT project) AS projects FROM x WHERE tier = (SELECT min(tier) FROM x)")
def symbol_lookup(spark, sf):
    """The first of three readings that finds something, and in how many projects: more than one is an error to the caller."""
    tier = F.when(F.col("qualified_name") == "Brand#2::red ring", 1).when(F.col("qualified_name").endswith("::red ring"), 2).when(F.col("name") == "red ring", 3)
    x = symbols(spark, sf).select("project", tier.alias("tier")).where("tier is not null").groupBy("tier").agg(F.countDistinct("project").alias("n"))
    best = x.agg(F.min(F.struct("tier", "n")).alias("b"))
    return best.select("b.tier", F.col("b.n").alias("projects"))


@query("p19_name_search", f"{S} SELECT id FROM symbols WHERE contains(lower(name), 'ing') OR contains(lower(qualified_name), '#4') ORDER BY id LIMIT 40")
def name_search(spark, sf):
    return symbols(spark, sf).where(F.lower("name").contains("ing") | F.lower("qualified_name").contains("#4")).orderBy("id").limit(40).select("id")


@query("p20_post_filters", f"{S} SELECT id FROM symbols WHERE contains(name, 'bolt') AND node_type = 'SMALL' AND size > 5 AND project <> 'Brand#1'")
def post_filters(spark, sf):
    return symbols(spark, sf).where(F.col("name").contains("bolt") & (F.col("node_type") == "SMALL") & (F.col("size") > 5) & (F.col("project") != "Brand#1")).select("id")


@query("s3_collated_sort", "SELECT n_name FROM nation ORDER BY n_name")
def collated(spark, sf):
    return load(spark, sf, "nation").select("n_name").orderBy(F.collate("n_name", "UNICODE"))


@query("u1_union_bag", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_bag(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).unionByName(load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("w8_max_normalised", "SELECT event_id, round(value / max(value) OVER (PARTITION BY user_id), 6) AS share FROM events")
def max_normalised(spark, sf):
    return load(spark, sf, "events").select("event_id", F.round(F.col("value") / F.max("value").over(Window.partitionBy("user_id")), 6).alias("share"))


@query("v1_parsed_versions", "SELECT s_suppkey AS id, (s_suppkey % 4)::INTEGER AS major, (s_suppkey % 11)::INTEGER AS minor, 0 AS patch FROM supplier")
def parsed_versions(spark, sf):
    v = T.version(F.concat(F.lit("v"), (F.col("s_suppkey") % 4).cast("string"), F.lit("."), (F.col("s_suppkey") % 11).cast("string")))
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), v[0].alias("major"), v[1].alias("minor"), v[2].alias("patch"))


@query("v5_resolved_version", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'explicit' WHEN s_suppkey % 3 = 0 THEN 'instance' WHEN s_suppkey % 2 = 0 THEN 'active' ELSE 'none' END AS origin FROM supplier")
def resolved_version(spark, sf):
    k = F.col("s_suppkey")
    return load(spark, sf, "supplier").select(k.alias("id"), services.origin(explicit=F.when(k % 5 == 0, "1.0"), instance=F.when(k % 3 == 0, "2.0"), active=F.when(k % 2 == 0, "3.0")).alias("origin"))


@query("d2_manifest_edges", f"{S} SELECT DISTINCT project AS src, 'pod' || (size % 7) AS dst FROM symbols")
def manifest_edges(spark, sf):
    from lodegraph.sources.parsers import manifest

    text = F.concat(F.lit('depends = ["pod'), (F.col("size") % 7).cast("string"), F.lit(' 1.0"]'))
    return symbols(spark, sf).select(F.col("project").alias("src"), F.explode(manifest(text)["depends"]).alias("dst")).distinct()


@query("k5_match_symbol", f"{S}, x AS (SELECT c_custkey AS card, CASE WHEN c_custkey % 2 = 0 THEN 'RED RING' ELSE 'none' END AS asked FROM customer) SELECT card, (SELECT min(id) FROM symbols WHERE ends_with(lower(qualified_name), '::' || lower(asked))) AS id FROM x")
def match_symbol(spark, sf):
    x = load(spark, sf, "customer").select(F.col("c_custkey").alias("card"), F.lower(F.when(F.col("c_custkey") % 2 == 0, "RED RING").otherwise("none")).alias("tail"))
    s = symbols(spark, sf).groupBy(F.lower(F.split("qualified_name", "::")[1]).alias("tail")).agg(F.min("id").alias("id"))
    return x.join(s, "tail", "left").select("card", "id")


@query("k7_card_list", "SELECT quality, toxic, count(*) AS n, min(doc_id) AS first FROM labels GROUP BY 1, 2")
def card_list(spark, sf):
    return load(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("x3_text_versions", "SELECT source AS project, CASE WHEN min(doc_id % 3) < 1 THEN 'older' ELSE 'current' END AS layout, count(*) FILTER (doc_id % 3 < 1) AS stale FROM documents GROUP BY 1")
def text_versions(spark, sf):
    return services.layout_status(load(spark, sf, "documents").withColumnRenamed("source", "project"), "project", F.col("doc_id") % 3, 1)


@query("x5_session_context", "SELECT c_nationkey AS project, max(o_orderdate) AS last_run, count(*) AS files, sum(o_custkey)::BIGINT AS symbols FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def session_context(spark, sf):
    j = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("project")).agg(F.max("o_orderdate").alias("last_run"), F.count("*").alias("files"), F.sum("o_custkey").alias("symbols"))


@query("x6_client_path_match", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'srv/app' ELSE 'srv' END AS root FROM nation")
def client_path_match(spark, sf):
    k = F.col("n_nationkey")
    p = load(spark, sf, "nation").select(k.alias("id"), F.when(k % 2 == 0, F.lit("srv/app/x/y")).otherwise(F.lit("srv/other/z")).alias("path"))
    r = spark.range(1).select(F.explode(F.array(F.lit("srv"), F.lit("srv/app"))).alias("root"))
    return catalog.longest_prefix(p, r).select("id", "root")


@query("x8_card_page", "SELECT doc_id, quality FROM labels WHERE toxic = 0 ORDER BY quality, doc_id DESC LIMIT 25 OFFSET 25")
def card_page(spark, sf):
    return load(spark, sf, "labels").where("toxic = 0").orderBy("quality", F.desc("doc_id")).offset(25).limit(25).select("doc_id", "quality")


@query("x11_pods_with_counts", "SELECT s_suppkey AS pod, count(l_orderkey) AS logs, count(DISTINCT l_orderkey) AS projects FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' GROUP BY 1")
def pods_with_counts(spark, sf):
    li = load(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("pod")).agg(F.count("*").alias("logs"), F.countDistinct("l_orderkey").alias("projects"))
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("pod")).join(li, "pod", "left").na.fill(0, ["logs", "projects"])


@query("x13_reply_merge", "SELECT event_id AS id, json_extract_string(props, '$.k') AS text FROM events WHERE event_id IN (SELECT doc_id FROM labels)")
def reply_merge(spark, sf):
    wanted = load(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return services.merged_replies(load(spark, sf, "events").select(F.col("event_id").alias("id"), "props"), wanted, "id", F.from_json("props", "k string")["k"])


@query("i10_content_changed", f"{S}, o AS (SELECT id, name AS sig, CASE WHEN id % 6 = 0 THEN NULL ELSE node_type END AS doc FROM symbols), n AS (SELECT id, CASE WHEN id % 4 = 0 THEN name || '!' ELSE name END AS sig, CASE WHEN id % 12 = 0 THEN NULL ELSE node_type END AS doc FROM symbols) SELECT id, o.sig IS DISTINCT FROM n.sig OR o.doc IS DISTINCT FROM n.doc AS changed FROM o JOIN n USING (id)")
def content_changed(spark, sf):
    s = symbols(spark, sf)
    o = s.select("id", F.col("name").alias("a"), F.when(F.col("id") % 6 != 0, F.col("node_type")).alias("b"))
    n = s.select("id", F.when(F.col("id") % 4 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("c"), F.when(F.col("id") % 12 != 0, F.col("node_type")).alias("d"))
    return o.join(n, "id").select("id", (~F.col("a").eqNullSafe(F.col("c")) | ~F.col("b").eqNullSafe(F.col("d"))).alias("changed"))


@query("i14_function_plan", "SELECT coalesce(a.doc_id, b.vec_id) AS id, CASE WHEN a.doc_id IS NULL THEN 'drop' WHEN b.vec_id IS NULL THEN 'encode' WHEN label % 2 = 0 THEN 'keep' ELSE 'encode' END AS action FROM (SELECT doc_id FROM documents WHERE lang <> 'en') a FULL JOIN embeddings b ON b.vec_id = a.doc_id")
def function_plan(spark, sf):
    a = load(spark, sf, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("id"))
    return services.vector_plan(a, load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"), F.col("label") % 2 == 0)


@query("i16_pending_refs", "WITH refs AS (SELECT p_partkey AS ref, p_name AS tail FROM part), known AS (SELECT DISTINCT p_name AS tail FROM part WHERE p_brand = 'Brand#1'), later AS (SELECT p_name AS tail, min(p_partkey) AS id FROM part WHERE p_brand = 'Brand#2' GROUP BY 1) SELECT ref, id FROM refs LEFT JOIN later USING (tail) WHERE tail NOT IN (SELECT tail FROM known)")
def pending_refs(spark, sf):
    """References that resolved to nothing wait, and meet the symbols of a later patch by their tail."""
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("tail"), F.col("p_brand").alias("brand"))
    refs, known = p.select(F.col("id").alias("ref"), "tail"), p.where("brand = 'Brand#1'").select("tail").distinct()
    waiting = incremental.pending(refs, known)
    later = p.where("brand = 'Brand#2'").groupBy("tail").agg(F.min("id").alias("id"))
    return waiting.join(later, "tail", "left").select("ref", "id")


@query("i17_grouped_batches", "SELECT label AS key, count(*) AS n, (sum(count(*)) OVER (ORDER BY label) - count(*))::BIGINT // 120 AS batch FROM embeddings GROUP BY 1")
def grouped_batches(spark, sf):
    """Keys in batches of about 120 rows; a key is never split. The running sum is over keys, not rows."""
    g = load(spark, sf, "embeddings").groupBy(F.col("label").alias("key")).agg(F.count("*").alias("n"))
    return incremental.grouped_batches(g, 120)


@query("x7_focus_related", "SELECT src, other, kind FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY kind, other) AS r FROM (SELECT DISTINCT l_partkey AS src, l_suppkey AS other, CASE WHEN l_returnflag = 'R' THEN 'caller' ELSE 'callee' END AS kind FROM lineitem)) WHERE r <= 5")
def focus_related(spark, sf):
    e = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("other"), F.when(F.col("l_returnflag") == "R", "caller").otherwise("callee").alias("kind"))
    return services.first_related(e, "src", ["kind", "other"], 5)


@query("i13_cache_lookup", "SELECT d.doc_id, c.first AS cached_from FROM documents d JOIN (SELECT md5(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1) c ON md5(d.text) = c.h WHERE d.doc_id <> c.first")
def cache_lookup(spark, sf):
    """Texts that were encoded before, and where; hashes are joined, not texts."""
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    c = d.groupBy("h").agg(F.min("doc_id").alias("cached_from"), F.count("*").alias("n")).where("n > 1")
    return d.join(c, "h").where("doc_id <> cached_from").select("doc_id", "cached_from")




@query("v4_version_texts", "WITH v AS (SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'v1.' || s_suppkey % 7 WHEN 1 THEN '2' WHEN 2 THEN 'x' WHEN 3 THEN ' 3.' || s_suppkey % 4 || '.1 ' ELSE '0.0' END AS t FROM supplier) SELECT id, regexp_full_match(trim(t), '[vV]?[0-9]+([.][0-9]+){0,2}') AS valid, CASE id % 5 WHEN 0 THEN '1.' || id % 7 || '.0' WHEN 1 THEN '2.0.0' WHEN 2 THEN '' WHEN 3 THEN '3.' || id % 4 || '.1' ELSE '0.0.0' END AS normal FROM v")
def version_texts(spark, sf):
    k = F.col("s_suppkey")
    t = F.when(k % 5 == 0, F.concat(F.lit("v1."), (k % 7).cast("string"))).when(k % 5 == 1, "2").when(k % 5 == 2, "x").when(k % 5 == 3, F.concat(F.lit(" 3."), (k % 4).cast("string"), F.lit(".1 "))).otherwise("0.0")
    return load(spark, sf, "supplier").select(k.alias("id"), T.valid_version(t).alias("valid"), T.normal_version(t).alias("normal"))


@query("v4_range_texts", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 = 5 THEN '1.0, 2.0' WHEN s_suppkey % 6 = 0 THEN 'any version' WHEN s_suppkey % 6 = 1 THEN '>= 1.' || s_suppkey % 3 WHEN s_suppkey % 6 = 2 THEN '<= 2.0' WHEN s_suppkey % 6 = 3 THEN '1.0' ELSE '1.' || s_suppkey % 3 || ' - 2.0' END AS shown FROM supplier")
def range_texts(spark, sf):
    k = F.col("s_suppkey") % 6
    low = F.when(k.isin(1, 4), F.concat(F.lit("1."), (F.col("s_suppkey") % 3).cast("string"))).when(k == 3, "1.0").otherwise("")
    high = F.when(k.isin(2, 4), "2.0").when(k == 3, "1.0.0")
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), T.range_text(low, high, F.when(k == 5, F.array(F.lit("1.0"), F.lit("2.0")))).alias("shown"))


@query("t20_plain_names", f"{S} SELECT id, CASE WHEN id % 2 = 0 THEN name ELSE qualified_name END AS name FROM symbols")
def plain_names(spark, sf):
    """Names under an absolute path lose it, others stay."""
    path = F.concat(F.lit("/srv/"), F.col("project"), F.lit("/x.ts"))
    q = F.when(F.col("id") % 2 == 0, F.concat(path, F.lit("::"), "name")).otherwise(F.col("qualified_name"))
    return symbols(spark, sf).select("id", T.without_root(q, path).alias("name"))


# --- signatures, bodies, documentation pages ----------------------------------------------------

_CLASS_SQL = "SELECT 'f' || p_partkey AS path, p_size::INTEGER AS n FROM part"


@query("io13_declared_spans", f"WITH f AS ({_CLASS_SQL}) SELECT path, 1 AS line, 'class' AS kind, 'P' AS name, n + 5 AS last_line FROM f UNION ALL SELECT path, i::INTEGER, 'field', 'f' || i, i::INTEGER FROM f, unnest(range(2, n + 2)) AS t(i) UNION ALL SELECT path, n + 2, 'method', 'go', n + 4 FROM f")
def declared_spans(spark, sf):
    """A class of p_size fields and a method, whose braces tell where each ends."""
    field = F.array_join(F.transform(F.sequence(F.lit(2), F.col("p_size") + 1), lambda i: F.concat(F.lit("  Int f"), i.cast("string"), F.lit("\n"))), "")
    text = F.concat(F.lit("class P {\n"), field, F.lit("  Int go(Int x) {\n    return 1\n  }\n}\n"))
    f = load(spark, sf, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.lit("fan").alias("language"), text.alias("text"))
    return code.declared_spans(f).select("path", "line", "kind", "name", "last_line")


@query("io13_braced_bodies", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '{ ' || repeat('{a}', p_size) || ' }' WHEN 1 THEN '' ELSE '{ ' || repeat('{b', p_size) END AS body FROM part")
def braced_bodies(spark, sf):
    """Bodies that close, have no brace on their first line, or never close."""
    k, n = F.col("p_partkey") % 3, F.col("p_size")
    text = F.when(k == 0, F.concat(F.lit("Int go() { "), F.repeat(F.lit("{a}"), n), F.lit(" } } rest"))).when(k == 1, "Int go()\n{ }").otherwise(F.concat(F.lit("x { "), F.repeat(F.lit("{b"), n)))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), code.braced(text).alias("body"))


@query("io16_function_pages", "SELECT p_partkey AS id, 'fn' || p_size AS name, 'fn' || p_size || '(val)' AS signature, CASE WHEN p_partkey % 2 = 0 THEN 'About ' || p_name ELSE 'Axon function: fn' || p_size END AS description, p_type AS of_type FROM part")
def function_pages(spark, sf):
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<p>About <b>"), F.col("p_name"), F.lit("</b></p>"))).otherwise("")
    html = F.concat(
        F.lit("<h2 class='defc-main-heading'>func</h2><div class='defc-main-section'><div><h2>fn"), F.col("p_size").cast("string"), F.lit("(val)</h2></div>"), said,
        F.lit("</div><h2 class='defc-main-heading'>Meta</h2><div class='defc-main-section'><table class='defc-props'><tr><th>type</th><td><a>"), F.col("p_type"), F.lit("</a></td></tr><tr><th></th><td>x</td></tr></table></div>"),
    )
    f = parsers.html_function(F.concat(F.lit("doc/func~fn"), F.col("p_size").cast("string"), F.lit(".html")), html)
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), f.alias("f")).select("id", "f.name", "f.signature", "f.description", F.col("f.metadata")["type"].alias("of_type"))


@query("io16_chapters", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE 'ch' || p_size END AS name, CASE WHEN p_partkey % 2 = 0 THEN left(repeat('word ', p_size * 4) || p_type, 500) ELSE 'Documentation chapter: ' || CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE 'ch' || p_size END END AS description FROM part")
def chapters(spark, sf):
    k = F.col("p_partkey") % 3
    head = F.when(k == 0, F.concat(F.lit("<title>t</title><h1 id='a'>"), F.col("p_name"), F.lit("</h1>"))).when(k == 1, F.concat(F.lit("<title>"), F.col("p_brand"), F.lit(" – docs</title>"))).otherwise("")
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<p></p><p>"), F.repeat(F.lit("word\n"), F.col("p_size") * 4), F.col("p_type"), F.lit("</p>"))).otherwise("")
    c = parsers.html_chapter(F.concat(F.lit("a/ch"), F.col("p_size").cast("string"), F.lit(".html")), F.concat(head, said))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), c.alias("c")).select("id", "c.name", "c.description")


@query("io16_entries", "WITH p AS (SELECT p_partkey AS id, 'T' || p_size AS t, p_name AS d, p_partkey % 4 = 0 AS f FROM part) SELECT id, 0 AS place, 'type' AS kind, CASE WHEN f THEN 'sys::Funcs' ELSE 'sys::' || t END AS qualified_name, 'class ' || t AS signature, d AS description FROM p UNION ALL SELECT id, 1, CASE WHEN f THEN 'function' ELSE 'slot' END, CASE WHEN f THEN 'func:compare' ELSE 'sys::' || t || '.compare' END, CASE WHEN f THEN 'compare(a, b)' ELSE '(a, b) => Int' END, CASE WHEN f THEN 'Axon function: compare' ELSE '' END FROM p")
def entries(spark, sf):
    f, t = F.col("p_partkey") % 4 == 0, F.concat(F.lit("T"), F.col("p_size").cast("string"))
    html = F.concat(
        F.lit("<xetodoc-tab id='doc-header'>"), F.when(f, "mixin").otherwise("class"), F.lit("</xetodoc-tab><xetodoc-section><h1>"), F.when(f, "Funcs").otherwise(t), F.lit("</h1><xetodoc-slot><code>class "), t, F.lit("</code></xetodoc-slot><p>"), F.col("p_name"),
        F.lit("</p></xetodoc-section><xetodoc-tab id='doc-methods'>methods</xetodoc-tab><table></table><xetodoc-tab id='compare'>compare</xetodoc-tab><xetodoc-section><xetodoc-slot><code>(a, b) =&gt;\n Int</code></xetodoc-slot></xetodoc-section><xetodoc-tab id='x'>two words</xetodoc-tab>"),
    )
    pages = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("x.html").alias("path"), F.lit("sys").alias("pod"), html.alias("html"))
    return parsers.html_entries(pages, "id").select("id", "place", "kind", "qualified_name", "signature", "description")


@query("t12_function_headers", "WITH p AS (SELECT p_partkey AS id, p_size AS n, p_brand AS b FROM part) SELECT id, 'project: ' || b || ' | instance: main | file: his rules ' || CASE WHEN n % 2 = 0 THEN 'find gaps' ELSE 'gaps' || n END || CASE WHEN n % 3 = 0 THEN '' ELSE ' | tags: ' || array_to_string(['t' || i for i in range(least(n % 10 + 1, 8))], ', ') END AS header, CASE WHEN n % 4 = 0 THEN '' WHEN n % 4 = 1 THEN 'context: calls: a, b' WHEN n % 4 = 2 THEN 'context: called by: c1, c2, c3, c4, c5' ELSE 'context: calls: a, b; called by: c1, c2, c3, c4, c5' END AS context, CASE WHEN n % 5 = 0 THEN '' ELSE 'uses: ' || array_to_string(['u' || i for i in range(least(n, 8))], ', ') END AS uses FROM p")
def function_headers(spark, sf):
    n = F.col("p_size")
    names = lambda mark, count: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(F.lit(mark), i.cast("string")))
    none = F.array().cast("array<string>")
    path = F.concat(F.lit("proj/his/rules/"), F.when(n % 2 == 0, "findGaps").otherwise(F.concat(F.lit("gaps"), n.cast("string"))), F.lit(".axon"))
    header = H.header_line(F.col("p_brand"), F.lit("main"), path, F.when(n % 3 == 0, none).otherwise(names("t", n % 10 + 1)))
    context = H.context_line(F.when(n % 4 % 2 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(none), F.when(n % 4 >= 2, F.array(*(F.lit(f"c{i}") for i in range(1, 8)))).otherwise(none))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), header.alias("header"), context.alias("context"), H.uses_line(F.when(n % 5 == 0, none).otherwise(names("u", n))).alias("uses"))


_BODIES = (
    "// of a plant\n\n(ahu, dates: thisMonth, limit: [1, 2])\n  => do\nend",
    "/* why (a) => b */ (x, y: \"a, b\") => x",
    "hisRead(@a) + 1",
    "defcomp\n  target: {}\n  out: {readonly}\n  occ: {bind: \"occupied\"}\n  do\n    in: {x}\n  end\nend",
)
_SIGNED = ("(ahu: Ref, dates = thisMonth, limit = [1, 2]) => Grid", '(x, y = "a, b") => Grid', "(ahu: Ref, z: Str) => Grid", "[target, out: readonly, occ: bind]")


@query("t13_signatures", "SELECT p_partkey AS id, 'f' || p_size || CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_SIGNED)) + " END AS signature, CASE p_partkey % 4 WHEN 0 THEN 3 ELSE 1 END AS line, CASE p_partkey % 4 WHEN 3 THEN 'cells: target, out {readonly}, occ {bind}' ELSE '' END AS cells FROM part")
def signatures(spark, sf):
    """Lambdas with defaults, comments before them and types known from elsewhere; a body without one; a component."""
    body = F.element_at(F.array(*(F.lit(b) for b in _BODIES)), (F.col("p_partkey") % 4 + 1).cast("int"))
    known = F.array(F.struct(F.lit("ahu").alias("name"), F.lit("Ref").alias("type")), F.struct(F.lit("z").alias("name"), F.lit("Str").alias("type")))
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("name"), H.signature(body).alias("s"), H.cells(body).alias("c"))
    return p.select("id", H.signature_text(F.col("name"), H.typed(F.col("s"), known), F.col("c"), F.lit("Grid")).alias("signature"), F.col("s.line").alias("line"), H.cells_line(F.col("c")).alias("cells"))


# --- scopes, leases, search modes ---------------------------------------------------------------


@query("v9_scoped_projects", f"WITH {_V} SELECT id, true AS grp FROM v WHERE product = 'prod0' AND {_NUM} BETWEEN 10000 AND 20599 OR product = 'prod1' UNION ALL SELECT id, false FROM v")
def scoped_projects(spark, sf):
    v = versions(spark, sf)
    return catalog.scoped(v, "prod0@1.0-2.5, prod1").select("id", F.lit(True).alias("grp")).union(catalog.scoped(v).select("id", F.lit(False)))


_NOW = dt.datetime(2024, 1, 15, 12)
_TASKS_SQL = "t AS (SELECT event_id AS id, event_type AS kind, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'yielded' ELSE 'done' END AS state, event_id % 7 AS priority, ts AS due, event_id % 5 AS attempts, CASE event_id % 3 WHEN 0 THEN 'me' WHEN 1 THEN 'you' END AS owner, ts + INTERVAL 1 HOUR AS lease_until FROM events)"


def _tasks(spark, sf):
    k = F.col("event_id")
    state = F.when(k % 4 == 0, "pending").when(k % 4 == 1, "running").when(k % 4 == 2, "yielded").otherwise("done")
    return load(spark, sf, "events").select(
        k.alias("id"), F.col("event_type").alias("kind"), state.alias("state"), (k % 7).alias("priority"), F.col("ts").alias("due"), (k % 5).alias("attempts"), F.lit(4).alias("max_attempts"),
        F.when(k % 3 == 0, "me").when(k % 3 == 1, "you").alias("owner"), (F.col("ts") + F.make_dt_interval(hours=F.lit(1))).alias("lease_until"),
    )


@query("i7_recovered_leases", f"WITH {_TASKS_SQL}, x AS (SELECT *, state = 'running' AND (owner IS DISTINCT FROM 'me' OR lease_until < TIMESTAMP '2024-01-15 12:00:00') AS lost FROM t) SELECT id, CASE WHEN lost AND attempts >= 3 THEN 'failed' WHEN lost THEN 'pending' ELSE state END AS state, CASE WHEN lost THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN lost AND attempts < 3 THEN TIMESTAMP '2024-01-15 12:00:00' + to_seconds((5 * pow(2, attempts))::BIGINT) ELSE due END AS due, CASE WHEN NOT lost THEN owner END AS owner, CASE WHEN NOT lost THEN lease_until END AS lease_until FROM x")
def recovered_leases(spark, sf):
    return incremental.recovered(_tasks(spark, sf), "me", _NOW, 5, 600).select("id", "state", "attempts", "due", "owner", "lease_until")


@query("i7_claimed_task", f"WITH {_TASKS_SQL}, c AS (SELECT id AS first FROM t WHERE state IN ('pending', 'yielded') AND kind IN ('click', 'view') AND due <= TIMESTAMP '2024-01-15 12:00:00' ORDER BY priority, due, id LIMIT 1), y AS (SELECT t.*, id IS NOT DISTINCT FROM first AS mine FROM t LEFT JOIN c ON id = first) SELECT id, CASE WHEN mine THEN 'running' WHEN state = 'yielded' THEN 'yielded' ELSE state END AS state, CASE WHEN NOT mine AND state = 'yielded' THEN greatest(1, priority - 1) ELSE priority END AS priority, CASE WHEN mine THEN 'me' WHEN state <> 'yielded' THEN owner END AS owner, CASE WHEN NOT mine AND state = 'yielded' THEN TIMESTAMP '2024-01-15 12:00:30' ELSE due END AS due FROM y")
def claimed_task(spark, sf):
    """One task is claimed, those yielded before are given back once more."""
    t = incremental.claimed(_tasks(spark, sf), ("click", "view"), "me", _NOW, 60)
    return incremental.yielded(t, F.col("state") == "yielded", _NOW, 30).select("id", "state", "priority", "owner", "due")


@query("r50_document_vectors", "SELECT query_id, id, score, rank::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id AND e.label IN (1, 3, 5)) WHERE rank <= 10 AND score >= 0.2")
def document_vectors(spark, sf):
    v = vectors(spark, sf)
    found = retrieval.document_search(v, v.where("id % 20 = 0"), 10, 0.2, F.col("label").isin(1, 3, 5))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("r49_search_modes", f"WITH {_NEAR}, p AS (SELECT *, ((id * 37 + query_id) % 101)::DOUBLE AS r FROM n WHERE rank <= 50 AND score >= 0.1), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, rank) AS place, min(r) OVER (PARTITION BY query_id) AS lo, greatest(max(r) OVER (PARTITION BY query_id), 1e-6) AS hi FROM p) SELECT 'vector' AS mode, query_id, id, score, rank::INTEGER AS rank, NULL::VARCHAR AS degraded FROM n WHERE rank <= 5 AND score >= 0.15 UNION ALL SELECT 'none', query_id, id, score, rank::INTEGER, 'no-reranker' FROM p WHERE rank <= 5 UNION ALL SELECT 'rlm', query_id, id, round(CASE WHEN hi = lo THEN score ELSE (r - lo) / (hi - lo) END, 6), place::INTEGER, 'no-rlm' FROM s WHERE place <= 5")
def search_modes(spark, sf):
    """Neighbours by vectors alone, with a reranker that is missing, and with a stand-in for one."""
    v = vectors(spark, sf)
    hits = retrieval.exact_nearest(v, v.where("id % 20 = 0"), 50).withColumn("score", F.round("score", 6))
    stand_in = (F.col("id") * 37 + F.col("query_id")) % 101
    legs = {"vector": services.by_mode(hits, "vector", 5, 0.15), "none": services.by_mode(hits, "rerank", 5), "rlm": services.by_mode(hits, "rlm", 5, rerank=stand_in).withColumn("score", F.round("score", 6))}
    out = None
    for mode, leg in legs.items():
        leg = leg.select(F.lit(mode).alias("mode"), "*")
        out = leg if out is None else out.union(leg)
    return out
