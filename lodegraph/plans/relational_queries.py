"""Queries of filters, paging, joins, set operations, versions, dependencies, cards and text sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators import catalog, incremental, services
from lodegraph.registry import query
from lodegraph.sources import files, parsers
from lodegraph.sources.tables import CHANGES_SQL, SYMBOLS_SQL, changes, load, symbols

S = f"WITH {SYMBOLS_SQL}"


@query("p1_equals", f"{S} SELECT id FROM symbols WHERE node_type = 'SMALL' AND project <> 'Brand#3'")
def equals(spark, sf):
    return symbols(spark, sf).where("node_type = 'SMALL' and project <> 'Brand#3'").select("id")


@query("p2_text_predicates", f"{S} SELECT id, contains(name, 'bolt') AS has, starts_with(name, 'red') AS begins, ends_with(name, 'ring') AS ends_ FROM symbols")
def text_predicates(spark, sf):
    n = F.col("name")
    return symbols(spark, sf).select("id", n.contains("bolt").alias("has"), n.startswith("red").alias("begins"), n.endswith("ring").alias("ends_"))


@query("p3_membership", f"{S} SELECT id FROM symbols WHERE node_type IN ('SMALL', 'PROMO') AND size NOT IN (1, 2, 3)")
def membership(spark, sf):
    return symbols(spark, sf).where(F.col("node_type").isin("SMALL", "PROMO") & ~F.col("size").isin(1, 2, 3)).select("id")


@query("p4_regex", f"{S} SELECT id FROM symbols WHERE regexp_matches(name, '^(red|blue) [a-g]')")
def regex(spark, sf):
    return symbols(spark, sf).where(F.col("name").rlike("^(red|blue) [a-g]")).select("id")


@query("p8_page", f"{S} SELECT id, name FROM symbols ORDER BY name, id LIMIT 50 OFFSET 100")
def page(spark, sf):
    return symbols(spark, sf).orderBy("name", "id").offset(100).limit(50).select("id", "name")


@query("p9_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 7000 ORDER BY o_orderkey LIMIT 501")
def keyset(spark, sf):
    return load(spark, sf, "orders").where("o_orderkey > 7000").orderBy("o_orderkey").limit(501).select("o_orderkey", "o_totalprice")


@query("p10_page_with_total", "SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS total FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20 OFFSET 40")
def page_with_total(spark, sf):
    c = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return c.orderBy("c_custkey").offset(40).limit(20).select("c_custkey").crossJoin(F.broadcast(c.agg(F.count("*").alias("total"))))  # one row


@query("p12_project_filters", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 4, 7) AND contains(lower(s_name), '1') AND coalesce(nullif(s_nationkey, 4) > 0, true)")
def project_filters(spark, sf):
    ok = F.coalesce(F.nullif(F.col("s_nationkey"), F.lit(4)) > 0, F.lit(True))
    return load(spark, sf, "supplier").where(F.col("s_nationkey").isin(1, 4, 7) & F.lower("s_name").contains("1") & ok).select("s_suppkey")


@query("p13_nodes_by_types", f"{S} SELECT id, name, node_type FROM symbols WHERE project = 'Brand#7' AND node_type IN ('SMALL', 'LARGE') ORDER BY node_type, name, id")
def nodes_by_types(spark, sf):
    return symbols(spark, sf).where("project = 'Brand#7'").where(F.col("node_type").isin("SMALL", "LARGE")).select("id", "name", "node_type")


@query("p15_by_ids", f"{S} SELECT id, name FROM symbols WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def by_ids(spark, sf):
    ids = load(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return symbols(spark, sf).join(ids, "id", "left_semi").select("id", "name")


@query("p16_find_by_pattern", f"{S} SELECT id, qualified_name FROM symbols WHERE contains(qualified_name, '#1') ORDER BY name, id LIMIT 20")
def find_by_pattern(spark, sf):
    return symbols(spark, sf).where(F.col("qualified_name").contains("#1")).orderBy("name", "id").limit(20).select("id", "qualified_name")


_REFS = """refs AS (SELECT p_partkey AS ref, CASE p_partkey % 4 WHEN 0 THEN p_brand || '::' || p_name WHEN 1 THEN p_name WHEN 2 THEN 'none::' || p_name ELSE 'nothing' || p_partkey END AS name FROM part),
s AS (SELECT c_custkey AS id, 'pod' || c_nationkey || '::' || c_name AS qualified_name, c_name AS name FROM customer UNION ALL SELECT p_partkey + 10000000, p_brand || '::' || p_name, p_name FROM part),
t AS (SELECT ref, s.id, 1 AS tier FROM refs r JOIN s ON s.qualified_name = r.name UNION ALL SELECT ref, s.id, 2 FROM refs r JOIN s ON split_part(s.qualified_name, '::', 2) = r.name UNION ALL SELECT ref, s.id, 3 FROM refs r JOIN s ON s.name = regexp_extract(r.name, '([^:.]*)$', 1)),
u AS (SELECT ref, tier, count(DISTINCT id) AS n, min(id) AS id FROM t GROUP BY 1, 2)"""


def _refs(spark, sf):
    p = load(spark, sf, "part")
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat_ws("::", "p_brand", "p_name")).when(k == 1, F.col("p_name")).when(k == 2, F.concat(F.lit("none::"), "p_name")).otherwise(F.concat(F.lit("nothing"), F.col("p_partkey").cast("string")))
    refs = p.select(F.col("p_partkey").alias("ref"), name.alias("name"))
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("pod"), F.col("c_nationkey").cast("string"), F.lit("::"), "c_name").alias("qualified_name"), F.col("c_name").alias("name"))
    s = c.union(p.select(F.col("p_partkey") + 10000000, F.concat_ws("::", "p_brand", "p_name"), "p_name"))
    return refs, s


@query("p17_resolve_names", f"WITH {_REFS} SELECT ref, arg_min(id, tier) AS id, min(tier) AS tier FROM u WHERE n = 1 GROUP BY 1")
def resolve_names(spark, sf):
    return incremental.resolve(*_refs(spark, sf))


@query("j6_tiered_resolution", f"WITH {_REFS} SELECT ref, arg_min(id, tier) AS id, min(tier) AS tier FROM u GROUP BY 1")
def tiered(spark, sf):
    return incremental.resolve(*_refs(spark, sf), ambiguous=True)


@query("j5_unresolved", f"WITH {_REFS} SELECT ref, name FROM refs WHERE ref NOT IN (SELECT ref FROM u WHERE n = 1)")
def unresolved(spark, sf):
    refs, s = _refs(spark, sf)
    return refs.join(incremental.resolve(refs, s), "ref", "left_anti")


@query("j7_name_tails", f"{S} SELECT tail, count(*) AS n FROM (SELECT qualified_name AS tail FROM symbols UNION ALL SELECT split_part(qualified_name, '::', 2) FROM symbols) GROUP BY 1")
def name_tails(spark, sf):
    parts = F.split("qualified_name", "::")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))
    return symbols(spark, sf).select(F.explode(tails).alias("tail")).groupBy("tail").agg(F.count("*").alias("n"))


@query("j8_ambiguous_tiebreak", f"{S}, c AS (SELECT a.id AS ref, b.id, b.project = a.project AS same, b.node_type = a.node_type AS kind FROM symbols a JOIN symbols b ON a.name = b.name AND a.id <> b.id) SELECT ref, id FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY kind DESC, same DESC, id) AS r FROM c) WHERE r = 1")
def tiebreak(spark, sf):
    """Of the symbols of a name, the best other one. Two of each kind and project are enough, so a popular name is not joined with itself."""
    s = symbols(spark, sf)
    few = s.groupBy("name", "node_type", "project").agg(F.min("id").alias("i"), F.max("id").alias("j"), F.count("*").alias("n"))
    second = s.join(few, ["name", "node_type", "project"]).where("id > i").groupBy("name", "node_type", "project").agg(F.min("id").alias("id"))
    few = few.select("name", "node_type", "project", F.col("i").alias("id")).unionByName(second)
    a = s.select(F.col("id").alias("ref"), "name", F.col("project").alias("ap"), F.col("node_type").alias("at"))
    c = a.join(few, "name").where("ref <> id")
    key = F.struct((F.col("at") != F.col("node_type")).cast("int"), (F.col("ap") != F.col("project")).cast("int"), F.col("id"))
    return c.groupBy("ref").agg(F.min_by("id", key).alias("id"))


@query("j2_index_to_base", "WITH h AS (SELECT doc_id FROM documents WHERE contains(text, 'License')) SELECT d.doc_id, d.lang, d.source FROM h JOIN documents d USING (doc_id)")
def index_to_base(spark, sf):
    d = load(spark, sf, "documents")
    return d.where(F.col("text").contains("License")).select("doc_id").join(d.select("doc_id", "lang", "source"), "doc_id")


@query("j3_enrich_hits", "SELECT e.vec_id, e.label, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS known FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id")
def enrich(spark, sf):
    j = load(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), "quality", F.lit(True).alias("k"))
    return load(spark, sf, "embeddings").select("vec_id", "label").join(j, "vec_id", "left").select("vec_id", "label", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("k", F.lit(False)).alias("known"))


@query("j4_stale_id_rescue", f"{S}, h AS (SELECT id + 5000000 AS stale, qualified_name, size FROM symbols) SELECT stale, id FROM (SELECT h.stale, s.id, row_number() OVER (PARTITION BY h.stale ORDER BY abs(s.size - h.size), s.id) AS r FROM h JOIN symbols s USING (qualified_name)) WHERE r = 1")
def rescue(spark, sf):
    """Hits whose id is gone find the symbol of their name that lies nearest."""
    s = symbols(spark, sf)
    h = s.select((F.col("id") + 5000000).alias("stale"), "qualified_name", F.col("size").alias("at"))
    return incremental.rescue(h, s)


@query("j11_cross_project_links", f"""{S}, w AS (SELECT DISTINCT project, unnest(string_split(name, ' ')) AS word FROM symbols), n AS (SELECT word FROM w GROUP BY 1 HAVING count(*) <= 26)
SELECT a.project AS src, b.project AS dst, count(*) AS words FROM w a JOIN w b USING (word) JOIN n USING (word) WHERE a.project < b.project GROUP BY 1, 2""")
def cross_project(spark, sf):
    """Projects linked by identifiers they share; names that are in too many projects link nothing, and are left out before the join, so a word makes at most 26 x 25 / 2 pairs."""
    w = symbols(spark, sf).select("project", F.explode(F.split("name", " ")).alias("word")).distinct()
    rare = w.join(w.groupBy("word").agg(F.count("*").alias("spread")).where("spread <= 26").select("word"), "word", "left_semi")
    a, b = rare.select(F.col("project").alias("src"), "word"), rare.select(F.col("project").alias("dst"), "word")
    return a.join(b, "word").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("words"))


@query("j12_lines_to_symbols", "WITH s AS (SELECT l_orderkey AS file, l_linenumber AS first_line, l_linenumber + 1 AS last_line, l_partkey AS symbol FROM lineitem), h AS (SELECT o_orderkey AS file, (o_custkey % 6)::INTEGER AS a, (o_custkey % 6 + 2)::INTEGER AS b FROM orders) SELECT h.file, s.symbol, s.first_line FROM h JOIN s ON s.file = h.file AND s.first_line <= h.b AND s.last_line >= h.a")
def lines_to_symbols(spark, sf):
    """Changed line ranges meet the symbols that overlap them: an equality on the file, and the range on what is left."""
    s = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("first_line"), (F.col("l_linenumber") + 1).alias("last_line"), F.col("l_partkey").alias("symbol"))
    h = load(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 6).alias("a"))
    return h.join(s, "file").where("first_line <= a + 2 and last_line >= a").select("file", "symbol", "first_line")


@query("j13_longest_prefix", "WITH p AS (SELECT DISTINCT 'r/n' || n_regionkey || '/k' || n_nationkey || '/f' AS path FROM nation), r AS (SELECT 'r' AS root UNION ALL SELECT 'r/n' || r_regionkey FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'r/n' || n_regionkey || '/k' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0) SELECT path, (SELECT arg_max(root, length(root)) FROM r WHERE path = root OR starts_with(path, root || '/')) AS root FROM p")
def longest_prefix(spark, sf):
    n = load(spark, sf, "nation")
    key = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in c))
    p = n.select(key("r/n", F.col("n_regionkey"), "/k", F.col("n_nationkey"), "/f").alias("path")).distinct()
    r = spark.range(1).select(F.lit("r").alias("root")).union(load(spark, sf, "region").where("r_regionkey <> 2").select(key("r/n", F.col("r_regionkey")))).union(n.where("n_nationkey % 3 = 0").select(key("r/n", F.col("n_regionkey"), "/k", F.col("n_nationkey"))))
    return catalog.longest_prefix(p, r)


@query("j15_self_join", "SELECT a.n_name AS name, b.n_name AS source FROM nation a LEFT JOIN nation b ON b.n_nationkey = CASE WHEN a.n_nationkey % 4 = 0 THEN NULL ELSE a.n_nationkey - 1 END")
def self_join(spark, sf):
    n = load(spark, sf, "nation")
    a = n.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") - 1).alias("k"))
    return a.join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("source")), "k", "left").select("name", "source")


@query("j16_set_diff", "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' ELSE 'kept' END AS state FROM a FULL JOIN b USING (k)")
def set_diff(spark, sf):
    a = load(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("a")).distinct()
    b = load(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("b")).distinct()
    return a.join(b, "k", "full_outer").select("k", F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("kept").alias("state"))


@query("j17_orphans", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def orphans(spark, sf):
    return load(spark, sf, "labels").select("doc_id").join(load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("j18_missing_counts", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing")
def missing(spark, sf):
    d, lab = load(spark, sf, "documents").select("doc_id"), load(spark, sf, "labels").select("doc_id").distinct()
    j = d.join(lab.withColumn("l", F.lit(1)), "doc_id", "left")
    return j.agg(F.count("*").alias("documents"), F.count_if(F.col("l").isNull()).alias("missing")).crossJoin(load(spark, sf, "labels").agg(F.count("*").alias("labels")))


@query("j19_projects_with_pods", "SELECT n_nationkey AS instance, s_name AS pod, count(s_suppkey) OVER (PARTITION BY n_nationkey) AS pods FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def projects_with_pods(spark, sf):
    """A row for each pod of an instance, and one for an instance without: no list grows with the table."""
    s = load(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("instance"), F.col("s_name").alias("pod"))
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("instance")).join(s.groupBy("instance").agg(F.count("*").alias("pods")), "instance", "left").na.fill(0, ["pods"])
    return n.join(s, "instance", "left").select("instance", "pod", "pods")


@query("j20_card_neighbours", "SELECT a.doc_id AS card, a.doc_id + 1 AS linked, l.quality FROM labels a LEFT JOIN labels l ON l.doc_id = a.doc_id + 1")
def card_neighbours(spark, sf):
    lab = load(spark, sf, "labels")
    return lab.select(F.col("doc_id").alias("card"), (F.col("doc_id") + 1).alias("linked")).join(lab.select(F.col("doc_id").alias("linked"), "quality"), "linked", "left").select("card", "linked", "quality")


# --- windows, sorts, sets -----------------------------------------------------------------------


@query("w4_previous_value", "SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change FROM events")
def previous(spark, sf):
    return load(spark, sf, "events").select("event_id", (F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("change"))


@query("w5_first_last", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1")
def first_last(spark, sf):
    at = F.struct("ts", "event_id")
    return load(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first"), F.max_by("event_type", at).alias("last"))


@query("w9_moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS mean FROM events")
def moving_average(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return load(spark, sf, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


@query("s2_multi_key_sort", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey LIMIT 100")
def multi_key(spark, sf):
    return load(spark, sf, "orders").orderBy(F.desc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("s4_global_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def global_top(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50)


@query("u2_union_distinct", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def union_distinct(spark, sf):
    return load(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).union(load(spark, sf, "supplier").where("s_acctbal < 0").select("s_nationkey")).distinct()


@query("u3_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def difference(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("k")).subtract(load(spark, sf, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("u4_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 48 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
def intersection(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.where("l_quantity > 48").select(F.col("l_partkey").alias("k")).intersect(li.where("l_discount > 0.08").select("l_partkey"))


# --- versions, dependencies, cards --------------------------------------------------------------

_V = "v AS (SELECT s_suppkey AS id, 'prod' || s_nationkey % 3 AS product, (s_suppkey % 4) || '.' || (s_suppkey % 11) || '.' || (s_suppkey % 7) AS version FROM supplier)"


def versions(spark, sf):
    part = lambda n: (F.col("s_suppkey") % n).cast("string")
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("prod"), (F.col("s_nationkey") % 3).cast("string")).alias("product"), F.concat_ws(".", part(4), part(11), part(7)).alias("version"))


_NUM = "(split_part(version, '.', 1)::INTEGER * 10000 + split_part(version, '.', 2)::INTEGER * 100 + split_part(version, '.', 3)::INTEGER)"


@query("v2_version_range", f"WITH {_V} SELECT id, version FROM v WHERE {_NUM} BETWEEN 10203 AND 21000")
def version_ranges(spark, sf):
    return versions(spark, sf).where(T.version_range(F.col("version"), "1.2.3", "v2.10.0")).select("id", "version")


@query("v3_latest_version", f"WITH {_V} SELECT product, arg_max(version, {_NUM}) AS latest FROM v GROUP BY 1")
def latest(spark, sf):
    return versions(spark, sf).groupBy("product").agg(F.max_by("version", T.version(F.col("version"))).alias("latest"))


@query("v6_compatible", f"WITH {_V} SELECT id, CASE WHEN id % 5 = 0 THEN version = '1.1.1' WHEN id % 3 = 0 THEN true ELSE {_NUM} <= 20000 END AS ok FROM v")
def compatible(spark, sf):
    listed = F.when(F.col("id") % 5 == 0, F.array("version"))
    low = F.when(F.col("id") % 3 != 0, F.col("version"))
    target = "2.0.0"
    c = versions(spark, sf)
    return c.select("id", F.when(F.col("id") % 5 == 0, catalog.compatible("1.1.1", F.lit(None).cast("string"), F.lit(None).cast("string"), listed)).otherwise(catalog.compatible(target, low, F.lit(None).cast("string"), F.lit(None).cast("array<string>"))).alias("ok"))


@query("v7_project_groups", "WITH p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'inst-1.0' END AS instance, CASE WHEN s_suppkey % 4 = 1 THEN 'app-2.' || s_suppkey % 3 ELSE 'app' END AS name, CASE WHEN s_suppkey % 4 = 2 THEN '/srv/site-3.1/x' ELSE '/srv' END AS path FROM supplier) SELECT CASE WHEN instance IS NOT NULL THEN instance WHEN contains(name, '-') THEN name WHEN contains(path, 'site') THEN 'site-3.1' ELSE 'other' END AS grp, count(*) AS n FROM p GROUP BY 1")
def project_groups(spark, sf):
    k = F.col("s_suppkey") % 4
    name = F.when(k == 1, F.concat(F.lit("app-2."), (F.col("s_suppkey") % 3).cast("string"))).otherwise("app")
    g = catalog.group_for_project(F.when(k == 0, "inst-1.0"), name, F.when(k == 2, "/srv/site-3.1/x").otherwise("/srv"))
    return load(spark, sf, "supplier").groupBy(g.alias("grp")).agg(F.count("*").alias("n"))


@query("v8_selector", f"WITH {_V} SELECT id FROM v WHERE product = 'prod0' AND {_NUM} BETWEEN 10000 AND 20599 OR product = 'prod1' AND {_NUM} BETWEEN 30200 AND 30299 OR product = 'prod2'")
def selector(spark, sf):
    return versions(spark, sf).where(catalog.selected(F.col("product"), F.col("version"), "prod0@1.0-2.5, prod1@3.2, prod2")).select("id")


@query("a14_version_groups", f"WITH {_V} SELECT product, split_part(version, '.', 1)::INTEGER AS major, count(*) AS projects, count(DISTINCT version) AS versions, arg_max(version, {_NUM}) AS latest, min(id) AS first FROM v GROUP BY 1, 2")
def version_groups(spark, sf):
    v = versions(spark, sf)
    return v.groupBy("product", F.get(T.version(F.col("version")), F.lit(0)).alias("major")).agg(
        F.count("*").alias("projects"), F.countDistinct("version").alias("versions"), F.max_by("version", T.version(F.col("version"))).alias("latest"), F.min("id").alias("first")
    )


@query("d1_pod_resolution", f"WITH {_V} SELECT product, id FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY CASE WHEN id % 7 = 0 THEN 0 WHEN id % 5 = 0 THEN 1 ELSE 2 END, {_NUM} DESC, id DESC) AS r FROM v) WHERE r = 1")
def pod_resolution(spark, sf):
    rank = F.when(F.col("id") % 7 == 0, 0).when(F.col("id") % 5 == 0, 1).otherwise(2)
    best = F.struct(-rank, T.version(F.col("version")), F.col("id"))
    return versions(spark, sf).groupBy("product").agg(F.max_by("id", best).alias("id"))


_DEP = "dep AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) / 100.0 AS confidence, any_value(CASE WHEN (c_nationkey + s_nationkey) % 2 = 0 THEN 'manifest' ELSE 'calls' END) AS kind FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"


def deps(spark, sf):
    j = load(spark, sf, "orders").join(load(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(load(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    g = j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg((F.count("*") / 100.0).alias("confidence"))
    return g.withColumn("kind", F.when((F.col("src") + F.col("dst")) % 2 == 0, "manifest").otherwise("calls"))


@query("d3_dependency_diff", f"WITH {_DEP}, o AS (SELECT src, dst, CASE WHEN src % 3 = 0 THEN 9.0::DOUBLE ELSE confidence END AS confidence FROM dep WHERE (src + dst) % 5 <> 0), n AS (SELECT * FROM dep WHERE (src * dst) % 4 <> 1) SELECT coalesce(o.src, n.src) AS src, coalesce(o.dst, n.dst) AS dst, CASE WHEN o.src IS NULL THEN 'create' WHEN n.src IS NULL THEN 'delete' WHEN o.confidence <> n.confidence THEN 'update' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.src = n.src AND o.dst = n.dst")
def dependency_diff(spark, sf):
    d = deps(spark, sf)
    old = d.where("(src + dst) % 5 <> 0").withColumn("confidence", F.when(F.col("src") % 3 == 0, 9.0).otherwise(F.col("confidence")))
    return catalog.dependency_diff(old, d.where("(src * dst) % 4 <> 1"))


@query("d4_project_scope", f"WITH {_DEP}, b AS (SELECT src AS project, dst AS other, confidence, kind FROM dep UNION ALL SELECT dst, src, confidence, kind FROM dep), g AS (SELECT project, other, max(confidence)::DOUBLE AS confidence, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(DISTINCT kind) AS n FROM b WHERE project <> other GROUP BY 1, 2) SELECT project, other, confidence, kinds, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY confidence DESC, n DESC, other) AS place FROM g) WHERE place <= 4")
def scope(spark, sf):
    return catalog.project_scope(deps(spark, sf))


@query("d5_dependencies_both_ways", f"WITH {_DEP} SELECT src AS project, 'out' AS way, dst AS other, kind FROM dep UNION ALL SELECT dst, 'in', src, kind FROM dep")
def both_ways(spark, sf):
    return deps(spark, sf).select(F.inline(F.array(F.struct(F.col("src").alias("project"), F.lit("out").alias("way"), F.col("dst").alias("other"), "kind"), F.struct(F.col("dst").alias("project"), F.lit("in").alias("way"), F.col("src").alias("other"), "kind"))))


@query("k1_card_targets", f"{S}, f AS (SELECT l_partkey AS id, count(*) AS fan_in FROM lineitem GROUP BY 1) SELECT s.id, fan_in FROM symbols s JOIN f USING (id) WHERE size >= 10 AND NOT starts_with(name, 'test') ORDER BY fan_in DESC, s.id LIMIT 40")
def card_targets(spark, sf):
    calls = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return services.card_targets(symbols(spark, sf), calls, (F.col("size") >= 10) & ~F.col("name").startswith("test"), 40)


@query("k2_card_facts", "SELECT part, supplier FROM (SELECT l_partkey AS part, l_suppkey AS supplier, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS r FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) WHERE r <= 12")
def card_facts(spark, sf):
    e = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    return services.first_related(e, "part", ["supplier"], 12)


@query("k3_card_status", "SELECT CASE WHEN doc_id % 17 = 0 THEN 'flagged' WHEN doc_id % 7 = 0 THEN 'stale' WHEN quality = 0 THEN 'outdated' WHEN doc_id % 10 < 2 THEN 'low' ELSE 'ok' END AS status, count(*) AS n FROM labels GROUP BY 1")
def card_status(spark, sf):
    s = catalog.card_status(F.col("doc_id") % 17 == 0, F.col("doc_id") % 7 == 0, F.col("quality") == 0, (F.col("doc_id") % 10) / 4.0)
    return load(spark, sf, "labels").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("k4_one_card_per_node", "SELECT node, card FROM (SELECT user_id AS node, event_id AS card, row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'view')::INTEGER, ts DESC, event_id) AS r FROM events) WHERE r = 1")
def one_card(spark, sf):
    c = load(spark, sf, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("card"), F.col("event_type").alias("writer"), F.col("ts").alias("built_at"))
    return catalog.one_card(c, "view").select("node", "card")


@query("k6_staleness", "WITH st AS (SELECT DISTINCT user_id AS node FROM events WHERE event_type = 'error' AND value > 90), l AS (SELECT DISTINCT user_id AS node, (user_id + 3) % 150 AS other FROM events) SELECT n.node, CASE WHEN n.node IN (SELECT node FROM st) THEN 'stale' WHEN EXISTS (SELECT 1 FROM l JOIN st ON st.node = l.other WHERE l.node = n.node) THEN 'check' ELSE 'fresh' END AS state FROM (SELECT DISTINCT user_id AS node FROM events) n")
def staleness(spark, sf):
    e = load(spark, sf, "events")
    nodes = e.select(F.col("user_id").alias("node")).distinct()
    return catalog.propagate_staleness(nodes, nodes.select("node", ((F.col("node") + 3) % 150).alias("other")), e.where("event_type = 'error' and value > 90").select(F.col("user_id").alias("node")))


@query("k8_claim_ranges", "WITH c AS (SELECT o_orderkey AS file, (o_custkey % 9)::INTEGER AS line FROM orders), r AS (SELECT l_orderkey AS file, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY 1) SELECT c.file, c.line, coalesce(c.line BETWEEN r.a - 2 AND r.b + 2, false) AS ok FROM c LEFT JOIN r USING (file)")
def claim_ranges(spark, sf):
    c = load(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 9).cast("int").alias("line"))
    r = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    return services.within_ranges(c, r)


@query("x2_fleet_split", "SELECT label % 3 AS provider, count(*) AS texts, count(DISTINCT label) AS projects FROM embeddings GROUP BY 1 ORDER BY 2 DESC, 1")
def fleet(spark, sf):
    return load(spark, sf, "embeddings").groupBy((F.col("label") % 3).alias("provider")).agg(F.count("*").alias("texts"), F.countDistinct("label").alias("projects"))


@query("x4_coverage_change", "WITH a AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), b AS (SELECT label, count(*) AS n FROM embeddings WHERE label % 3 <> 0 OR vec_id % 2 = 0 GROUP BY 1) SELECT label, CASE WHEN b.n < a.n THEN 'row-loss' ELSE 'unchanged' END AS change FROM a JOIN b USING (label)")
def coverage_change(spark, sf):
    g = load(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("a"), F.count_if((F.col("label") % 3 != 0) | (F.col("vec_id") % 2 == 0)).alias("b"))
    return g.where("b > 0").select("label", F.when(F.col("b") < F.col("a"), "row-loss").otherwise("unchanged").alias("change"))


@query("x12_project_cascade", "SELECT 'customer' AS tbl, count(*) AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'orders', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey = 3")
def cascade(spark, sf):
    c = load(spark, sf, "customer").where("c_nationkey = 3")
    orders = load(spark, sf, "orders").join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return services.cascade({"customer": c, "orders": orders, "supplier": load(spark, sf, "supplier").where("s_nationkey = 3")})


@query("x10_text_sections", "SELECT doc_id, len(string_split(text, chr(10))) AS sections, length(string_split(text, chr(10))[1]) AS first_length FROM documents")
def sections(spark, sf):
    s = T.lines(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("sections"), F.length(F.get(s, F.lit(0))).cast("long").alias("first_length"))


# --- text sources -------------------------------------------------------------------------------


@query("io3_file_router", "SELECT CASE page_id % 6 WHEN 0 THEN 'source' WHEN 1 THEN 'trio' WHEN 2 THEN 'build' WHEN 3 THEN 'html' WHEN 4 THEN 'markdown' ELSE 'none' END AS reader, count(*) AS n FROM pages GROUP BY 1")
def router(spark, sf):
    path = F.concat(F.lit("a/b/"), F.element_at(F.array(*(F.lit(x) for x in ("x.fan", "y.trio", "build.fan", "i.html", "r.md", "z.bin"))), (F.col("page_id") % 6 + 1).cast("int")))
    return load(spark, sf, "pages").groupBy(files.route(path).alias("reader")).agg(F.count("*").alias("n"))


@query("io4_excluded_segments", "SELECT count(*) FILTER (page_id % 3 <> 0) AS kept FROM pages")
def excluded(spark, sf):
    path = F.when(F.col("page_id") % 3 == 0, "a/node_modules/x.js").otherwise("a/my_node_modules/x.js")
    return load(spark, sf, "pages").agg(F.count_if(files.outside(path)).alias("kept"))


@query("io10_call_extraction", "SELECT p_partkey AS id, 2 AS line, CASE p_partkey % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'direct' ELSE 'dynamic' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'Foo.make' WHEN 1 THEN 'run' ELSE 'obj->go' END AS target FROM part")
def call_extraction(spark, sf):
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, 'if (x) Foo.make("y(z)")').when(k == 1, "return run(1) // skip(2)").otherwise("obj->go(3)")
    code = load(spark, sf, "part").select("p_partkey", F.concat(F.lit("/* old(1) */\n  "), line).alias("code"))
    return parsers.calls(code, "p_partkey", "code")


@query("io14_page_titles", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, sf):
    return load(spark, sf, "pages").select("page_id", parsers.html_title(F.col("html")).alias("title"))


@query("io15_page_links", "WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href=\"([^\"]*)\"', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS n FROM a GROUP BY 1, 2")
def page_links(spark, sf):
    return parsers.html_links(load(spark, sf, "pages"), "page_id").groupBy(F.col("id").alias("page_id"), "target").agg(F.count("*").alias("n"))


@query("io19_line_numbers", "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, unnest(ls) AS content, unnest(range(1, len(ls) + 1)) AS line FROM d) SELECT doc_id, line::INTEGER AS line, length(content)::INTEGER AS size FROM x WHERE contains(content, 'License')")
def line_numbers(spark, sf):
    d = parsers.numbered_lines(load(spark, sf, "documents").select("doc_id", "text"))
    return d.where(F.col("content").contains("License")).select("doc_id", "line", F.length("content").alias("size"))


@query("j12_change_counts_by_file", f"WITH {CHANGES_SQL} SELECT file, change, count(DISTINCT symbol) AS symbols FROM changes GROUP BY 1, 2")
def change_counts(spark, sf):
    return changes(spark, sf).groupBy("file", "change").agg(F.countDistinct("symbol").alias("symbols"))


# --- the warehouse tables -----------------------------------------------------------------------


@query("q1_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing(spark, sf):
    li = load(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


@query("q5_regional_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def regional(spark, sf):
    j = load(spark, sf, "lineitem").join(load(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey = s_nationkey").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("q_symbols_sized", f"{S} SELECT project, max(size) - min(size) AS spread FROM symbols GROUP BY 1")
def sized(spark, sf):
    return symbols(spark, sf).groupBy("project").agg((F.max("size") - F.min("size")).alias("spread"))
