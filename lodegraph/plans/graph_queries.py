"""Queries over the graph that is bound to events, customers and the containment tree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph.operators import dsl, graph
from lodegraph.operators.flows import Flows
from lodegraph.registry import query
from lodegraph.sources.sinks import export_lines
from lodegraph.sources.tables import CHANGES_SQL, CONTAINMENT_SQL, NODES_SQL, SYMBOLS_SQL, changes, containment, edges, edges_sql, load, nodes, sure_edges, symbols

#: The node that searches start from, and one they look for.
START, TARGET = 5, 17
E_ALL = edges_sql()
TYPES = ("click", "error", "purchase", "signup", "view")


@query("g9_most_called", f"WITH {E_ALL} SELECT dst AS id, count(*) AS calls FROM edges WHERE edge_type = 'click' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def most_called(spark, sf):
    return graph.of_types(edges(spark, sf), ("click",)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "id").limit(20)


@query("g10_most_complex", f"WITH {E_ALL} SELECT src AS id, count(*) AS calls FROM edges WHERE edge_type = 'click' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def most_complex(spark, sf):
    return graph.of_types(edges(spark, sf), ("click",)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "id").limit(20)


_CALLERS = f"""WITH RECURSIVE {E_ALL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type IN ('click', 'view')),
r(node, depth) AS (SELECT DISTINCT src, 1 FROM e WHERE dst = {START} UNION SELECT e.src, depth + 1 FROM r JOIN e ON e.dst = r.node WHERE depth < 5),
m AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1)"""


@query("g1_callers", _CALLERS + ", f AS (SELECT src, arg_min(edge_type, edge_id) AS edge_type, arg_min(confidence, edge_id) AS confidence FROM edges WHERE edge_type IN ('click', 'view') GROUP BY 1) SELECT node AS id, depth, edge_type, confidence FROM m JOIN f ON f.src = m.node")
def callers(spark, sf):
    e = graph.of_types(edges(spark, sf), ("click", "view"))
    found = graph.reach(graph.reversed_edges(e), spark.range(START, START + 1), 5)
    return found.select(F.col("node").alias("id"), "depth").join(graph.first_edges(e, "src"), "id")


_REACH = f"""WITH RECURSIVE {E_ALL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'click'),
r(node, depth) AS (SELECT DISTINCT dst, 1 FROM e WHERE src = {START} UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 5)"""


@query("g2_callees", _REACH + f", f AS (SELECT arg_min(edge_type, edge_id) AS edge_type, arg_min(confidence, edge_id) AS confidence FROM edges WHERE src = {START} AND edge_type = 'click') SELECT node AS id, min(depth) AS depth, any_value(edge_type) AS edge_type, any_value(confidence) AS confidence FROM r, f GROUP BY 1")
def callees(spark, sf):
    e = graph.of_types(edges(spark, sf), ("click",))
    found = graph.reach(e, spark.range(START, START + 1), 5).select("source", F.col("node").alias("id"), "depth")
    return found.join(graph.first_edges(e, "src").withColumnRenamed("id", "source"), "source").select("id", "depth", "edge_type", "confidence")


_IMPACT = f"""WITH RECURSIVE {E_ALL}, e AS (SELECT DISTINCT src, dst, edge_type FROM edges),
r(node, depth, edge_type) AS (SELECT DISTINCT src, 1, edge_type FROM e WHERE dst = {START} UNION SELECT e.src, depth + 1, unnest([r.edge_type, e.edge_type]) FROM r JOIN e ON e.dst = r.node WHERE depth < 4)"""


@query("g3_impact", _IMPACT + " SELECT node AS id, min(depth) AS depth, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS types FROM r GROUP BY 1")
def impact(spark, sf):
    found = graph.impact(edges(spark, sf), START, 4)
    return found.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"), F.array_join(F.array_sort(F.collect_set("edge_type")), ",").alias("types"))


@query("g3_impact_breakdown", _IMPACT + " SELECT edge_type, depth, count(*) AS n FROM r GROUP BY 1, 2")
def impact_breakdown(spark, sf):
    return graph.impact(edges(spark, sf), START, 4).groupBy("edge_type", "depth").agg(F.count("*").alias("n"))


_PATHS = f"""WITH RECURSIVE {E_ALL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type IN ('click', 'error')),
r(node, depth) AS (SELECT DISTINCT dst, 1 FROM e WHERE src = {START} AND dst <> {START} UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 10 AND e.dst <> {START}),
d AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1),
p(node, depth, path) AS (SELECT node, 1, lpad('{START}', 12, '0') || '>' || lpad(node::VARCHAR, 12, '0') FROM d WHERE depth = 1
 UNION ALL SELECT e.dst, p.depth + 1, min(p.path) || '>' || lpad(e.dst::VARCHAR, 12, '0') FROM p JOIN e ON e.src = p.node JOIN d ON d.node = e.dst AND d.depth = p.depth + 1 GROUP BY e.dst, p.depth)"""


@query("g4_shortest_path", _PATHS + f" SELECT node, depth, path FROM p WHERE node = {TARGET}")
def shortest_path(spark, sf):
    e = graph.of_types(edges(spark, sf), ("click", "error"))
    return graph.shortest_paths(e, START, 10).where(F.col("node") == TARGET)


@query("g4_shortest_paths_all", _PATHS + " SELECT node, depth, path FROM p")
def shortest_paths(spark, sf):
    return graph.shortest_paths(graph.of_types(edges(spark, sf), ("click", "error")), START, 10)


_SCC = f"""WITH RECURSIVE {E_ALL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'view'),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
c AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"""


def views(spark, sf):
    return graph.of_types(edges(spark, sf), ("view",))


@query("g11_strong_components", _SCC + " SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM c")
def strong_components(spark, sf):
    return graph.strong_components(views(spark, sf))


_CYCLES = f"""WITH RECURSIVE {E_ALL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'view'),
r(s, node, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT r.s, e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 10)"""


@query("g5_cycles", _CYCLES + " SELECT s AS id, min(depth) AS cycle_length FROM r WHERE s = node GROUP BY 1 ORDER BY 1 LIMIT 10")
def cycles(spark, sf):
    """The first ten nodes on a cycle of at most ten steps, with their shortest cycle. Only nodes of strong components (or with a loop) are searched."""
    e = views(spark, sf)
    inside = graph.strong_components(e).select("id").union(e.where("src = dst").select(F.col("src"))).distinct()
    return graph.first_cycles(e, inside, 10, 10)


_RELATED = f"""WITH {E_ALL}, {NODES_SQL}, ids AS (SELECT DISTINCT user_id AS id FROM events),
b AS (SELECT src AS id, 'callee' AS side, dst AS other FROM edges WHERE edge_type = 'click' UNION SELECT dst, 'caller', src FROM edges WHERE edge_type IN ('click', 'view')),
x AS (SELECT b.id, side, other, n.name, row_number() OVER (PARTITION BY b.id, side ORDER BY n.name, other) AS rank FROM b JOIN ids USING (id) JOIN nodes n ON n.id = b.other)"""


@query("g6_related_batch", _RELATED + " SELECT id, side, rank::INTEGER AS rank, other, name FROM x WHERE rank <= 3")
def related(spark, sf):
    ids = load(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    return graph.related(edges(spark, sf), nodes(spark, sf), ids, 3, ("click",), ("click", "view"))


_METRICS = ", ".join(f"coalesce(sum(CASE WHEN m = '{d}_{t}' THEN 1 END), 0)::BIGINT AS {d}_{t}" for t in TYPES for d in ("in", "out"))


@query("g7_metrics_batch", f"WITH {E_ALL}, {NODES_SQL}, x AS (SELECT src AS id, 'out_' || edge_type AS m FROM edges UNION ALL SELECT dst, 'in_' || edge_type FROM edges) SELECT nodes.id, {_METRICS} FROM nodes LEFT JOIN x ON x.id = nodes.id GROUP BY 1")
def metrics(spark, sf):
    return graph.metrics(nodes(spark, sf), edges(spark, sf), TYPES)


@query("g8_containment_depth", f"WITH RECURSIVE {CONTAINMENT_SQL}, r(child, depth) AS (SELECT child, 1 FROM tree WHERE parent NOT IN (SELECT child FROM tree) UNION ALL SELECT t.child, depth + 1 FROM r JOIN tree t ON t.parent = r.child WHERE depth < 10) SELECT split_part(child, ':', 1) AS kind, depth, count(*) AS n FROM r GROUP BY 1, 2")
def containment_depth(spark, sf):
    d = graph.containment_depth(containment(spark, sf))
    return d.groupBy(F.split("child", ":")[0].alias("kind"), "depth").agg(F.count("*").alias("n"))


def _pagerank_sql(iterations: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)"]
    for i in range(iterations):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT n.id, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce(sum(r.rank * l.share), 0) AS rank FROM n LEFT JOIN l ON l.dst = n.id LEFT JOIN r{i} r ON r.id = l.src GROUP BY n.id)")
    return f"WITH {E_ALL}, n AS (SELECT DISTINCT user_id AS id FROM events), c AS (SELECT src, dst, count(*) AS c FROM edges GROUP BY 1, 2), l AS MATERIALIZED (SELECT src, dst, c / sum(c) OVER (PARTITION BY src) AS share FROM c), " + ", ".join(steps) + f" SELECT id, round(rank, 9) AS rank FROM r{iterations} ORDER BY rank DESC, id LIMIT 20"


@query("g12_pagerank", _pagerank_sql(20))
def pagerank(spark, sf):
    n = load(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    return graph.pagerank(n, edges(spark, sf)).select("id", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "id").limit(20)


def _betweenness_sql(depth: int = 8) -> str:
    s = [f"WITH {E_ALL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND edge_type = 'click'), n AS (SELECT DISTINCT src AS id FROM e UNION SELECT dst FROM e), s AS (SELECT id FROM n ORDER BY id LIMIT 10), l0 AS (SELECT id AS s, id AS v, 1.0::DOUBLE AS sigma FROM s)"]
    for d in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT s, v FROM l{i}" for i in range(d))
        s.append(f"l{d} AS MATERIALIZED (SELECT l.s, e.dst AS v, sum(l.sigma) AS sigma FROM l{d - 1} l JOIN e ON e.src = l.v WHERE (l.s, e.dst) NOT IN ({before}) GROUP BY 1, 2)")
    s.append(f"d{depth} AS (SELECT s, v, sigma, 0.0::DOUBLE AS delta FROM l{depth})")
    for d in range(depth - 1, 0, -1):
        s.append(f"d{d} AS MATERIALIZED (SELECT u.s, u.v, any_value(u.sigma) AS sigma, coalesce(sum(u.sigma / x.sigma * (1 + x.delta)), 0) AS delta FROM l{d} u LEFT JOIN e ON e.src = u.v LEFT JOIN d{d + 1} x ON x.s = u.s AND x.v = e.dst GROUP BY 1, 2)")
    every = " UNION ALL ".join(f"SELECT v, delta FROM d{d}" for d in range(1, depth + 1))
    return ", ".join(s) + f" SELECT v AS id, round(sum(delta) * (SELECT count(*) FROM n) / (SELECT count(*) FROM s), 6) AS score FROM ({every}) GROUP BY 1"


@query("g13_betweenness", _betweenness_sql())
def betweenness(spark, sf):
    """From ten sources: a stated sample, the least ids."""
    e = graph.of_types(edges(spark, sf), ("click",)).where("src <> dst")
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    found = graph.betweenness(e, ids.orderBy("id").limit(10), ids.count(), 8)
    return found.select("id", F.round("score", 6).alias("score"))


@query("g14_type_relationships", f"WITH {E_ALL}, {NODES_SQL} SELECT a.node_type AS from_type, e.edge_type, b.node_type AS to_type, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.edge_type IN ('view', 'purchase') GROUP BY 1, 2, 3")
def type_relationships(spark, sf):
    n = nodes(spark, sf)
    a, b = n.select(F.col("id").alias("src"), F.col("node_type").alias("from_type")), n.select(F.col("id").alias("dst"), F.col("node_type").alias("to_type"))
    return graph.of_types(edges(spark, sf), ("view", "purchase")).join(a, "src").join(b, "dst").groupBy("from_type", "edge_type", "to_type").agg(F.count("*").alias("n"))


def _communities_sql(rounds: int, levels: int, last: str) -> str:
    s = [f"WITH {E_ALL}, u0 AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*)::DOUBLE AS w FROM edges WHERE src <> dst AND edge_type = 'purchase' GROUP BY 1, 2)"]
    for v in range(levels):
        s.append(f"""bo{v} AS MATERIALIZED (SELECT a AS u, b AS v, w FROM u{v} WHERE a <> b UNION ALL SELECT b, a, w FROM u{v} WHERE a <> b), k{v} AS MATERIALIZED (SELECT id, sum(w) AS k FROM (SELECT u AS id, w FROM bo{v} UNION ALL SELECT a, 2 * w FROM u{v} WHERE a = b) GROUP BY 1), m{v} AS (SELECT sum(k) AS m2 FROM k{v}), c{v}_0 AS (SELECT id, id AS c FROM k{v})""")
        for r in range(rounds):
            x = f"{v}_{r}"
            s.append(f"""t{x} AS (SELECT c, sum(k) AS tot FROM c{x} JOIN k{v} USING (id) GROUP BY 1),
 o{x} AS (SELECT l.id AS u, l.c AS own, k.k FROM c{x} l JOIN k{v} k USING (id) WHERE l.id % 2 = {r % 2}),
 p{x} AS (SELECT u, c, own, k, sum(w) AS w_in FROM (SELECT b.u, l.c, o.own, o.k, b.w FROM bo{v} b JOIN c{x} l ON l.id = b.v JOIN o{x} o ON o.u = b.u UNION ALL SELECT u, own, own, k, 0.0 FROM o{x}) GROUP BY 1, 2, 3, 4),
 g{x} AS (SELECT u, p.c, own, round(w_in - k * (tot - CASE WHEN p.c = own THEN k ELSE 0 END) / (SELECT m2 FROM m{v}), 9) AS gain FROM p{x} p JOIN t{x} t ON t.c = p.c),
 b{x} AS (SELECT u, c AS dest FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY gain DESC, (c <> own)::INTEGER, c) AS rn FROM g{x}) WHERE rn = 1),
 c{v}_{r + 1} AS MATERIALIZED (SELECT l.id, coalesce(b.dest, l.c) AS c FROM c{x} l LEFT JOIN b{x} b ON b.u = l.id)""")
        f = f"c{v}_{rounds}"
        s.append(f"l{v} AS (SELECT id, c FROM {f})" if not v else f"l{v} AS (SELECT l.id, f.c FROM l{v - 1} l JOIN {f} f ON f.id = l.c)")
        s.append(f"u{v + 1} AS MATERIALIZED (SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, sum(w) AS w FROM u{v} JOIN {f} x ON x.id = a JOIN {f} y ON y.id = b GROUP BY 1, 2)")
    return ", ".join(s) + last.format(label=f"l{levels - 1}")


def bought(spark, sf):
    return graph.of_types(edges(spark, sf), ("purchase",))


@query("g15_communities", _communities_sql(6, 2, ", z AS (SELECT c, size, (row_number() OVER (ORDER BY size DESC, least) - 1)::INTEGER AS place FROM (SELECT c, count(*) AS size, min(id) AS least FROM {label} GROUP BY 1 HAVING count(*) >= 2)) SELECT id, place AS community, size FROM {label} JOIN z USING (c)"))
def communities(spark, sf):
    return graph.sized_communities(graph.communities(bought(spark, sf)))


@query("g15_modularity", _communities_sql(6, 2, ", per AS (SELECT c, sum(w) AS tot, sum(CASE WHEN same THEN w ELSE 0 END) AS inside FROM (SELECT x.c, b.w, x.c = y.c AS same FROM bo0 b JOIN {label} x ON x.id = b.u JOIN {label} y ON y.id = b.v) GROUP BY 1) SELECT round(sum(inside) / sum(tot) - sum(tot * tot) / (sum(tot) * sum(tot)), 9) AS modularity FROM per"))
def modularity(spark, sf):
    e = bought(spark, sf)
    return graph.modularity(e, graph.communities(e)).select(F.round("modularity", 9).alias("modularity"))


_ENTRY = f"""WITH {E_ALL}, {SYMBOLS_SQL}, d AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY 1)
SELECT s.id, (CASE WHEN regexp_matches(name, '^(red|blue)') THEN 3 ELSE 0 END) + (CASE WHEN node_type = 'SMALL' THEN 2 ELSE 0 END) + (CASE WHEN size > 25 THEN 2 ELSE 0 END)
 + (CASE WHEN out_degree > 0 AND in_degree = 0 THEN 3 WHEN in_degree <= 2 AND out_degree >= 3 THEN 2 WHEN out_degree > in_degree THEN 1 ELSE 0 END) AS score FROM symbols s JOIN d ON d.id = s.id"""


@query("g16_entry_points", _ENTRY)
def entry_points(spark, sf):
    """Names that begin with a colour stand for entries', one type for constructors, large ones for public ones."""
    s = symbols(spark, sf).join(graph.degrees(edges(spark, sf)), "id")
    return graph.entry_scores(s, F.col("name").rlike("^(red|blue)"), F.col("node_type") == "SMALL", F.col("size") > 25)


_FLOWS = f"""WITH RECURSIVE {E_ALL}, sure AS (SELECT src, dst, max(confidence) AS confidence FROM edges WHERE confidence >= 0.5 AND edge_type = 'click' GROUP BY 1, 2),
step AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS r FROM sure WHERE src <> dst) WHERE r <= 4),
d AS (SELECT entry, node, min(depth) AS depth FROM (WITH RECURSIVE q(entry, node, depth) AS (SELECT x, x, 1 FROM (SELECT DISTINCT src AS x FROM step WHERE src NOT IN (SELECT dst FROM step)) UNION SELECT q.entry, s.dst, q.depth + 1 FROM q JOIN step s ON s.src = q.node WHERE q.depth < 11) SELECT * FROM q) GROUP BY 1, 2),
p(entry, node, depth, path) AS (SELECT entry, node, 1, lpad(node::VARCHAR, 12, '0') FROM d WHERE depth = 1
 UNION ALL SELECT p.entry, s.dst, p.depth + 1, min(p.path) || '>' || lpad(s.dst::VARCHAR, 12, '0') FROM p JOIN step s ON s.src = p.node JOIN d ON d.entry = p.entry AND d.node = s.dst AND d.depth = p.depth + 1 GROUP BY p.entry, s.dst, p.depth),
flows AS (SELECT entry, path FROM p WHERE depth >= 3 AND (depth = 11 OR node NOT IN (SELECT src FROM step)))"""


def flows(spark, sf):
    """From every node that calls and is not called."""
    return Flows(sure_edges(spark, sf, "click", 0.5))


@query("g17_traced_flows", _FLOWS + " SELECT * FROM flows")
def traced_flows(spark, sf):
    return flows(spark, sf).paths()


@query("g18_maximal_flows", _FLOWS + " SELECT * FROM flows f WHERE NOT EXISTS (SELECT 1 FROM flows g WHERE length(g.path) > length(f.path) AND contains(g.path, f.path))")
def maximal_flows(spark, sf):
    return flows(spark, sf).maximal()


@query("g19_flow_steps", _FLOWS + f", {NODES_SQL} SELECT entry, path, i AS step, n.id AS node, n.name, n.project_id FROM (SELECT entry, path, unnest(range(0, len(string_split(path, '>')))) AS i FROM flows) x JOIN nodes n ON n.id = string_split(path, '>')[i + 1]::BIGINT")
def flow_steps(spark, sf):
    return flows(spark, sf).steps(nodes(spark, sf).select("id", "name", "project_id"))


@query("g19_flow_types", _FLOWS + f", {NODES_SQL}, s AS (SELECT entry, path, unnest(string_split(path, '>'))::BIGINT AS node FROM flows) SELECT entry, path, count(*) AS steps, CASE WHEN count(DISTINCT project_id) > 1 THEN 'cross' ELSE 'intra' END AS flow_type FROM s JOIN nodes n ON n.id = s.node GROUP BY 1, 2")
def flow_types(spark, sf):
    return flows(spark, sf).assembled(nodes(spark, sf).select("id", F.col("project_id").alias("label")))


@query("g20_flows_of_node", _FLOWS + " SELECT entry, path FROM flows WHERE list_contains(string_split(path, '>'), (SELECT min(string_split(path, '>')[2]) FROM flows))")
def flows_of_node(spark, sf):
    """Of the least node that stands second in a flow."""
    f = flows(spark, sf)
    return f.through(f.least_second())


@query("g21_change_risk", _FLOWS + f""", {CHANGES_SQL}, c AS (SELECT DISTINCT symbol, file FROM changes WHERE run = (SELECT max(run) FROM changes)), e AS (SELECT DISTINCT src, dst FROM edges),
r AS (SELECT DISTINCT node FROM (WITH RECURSIVE q(node, depth) AS (SELECT DISTINCT e.src, 1 FROM c JOIN e ON e.dst = c.symbol UNION SELECT e.src, depth + 1 FROM q JOIN e ON e.dst = q.node WHERE depth < 5) SELECT * FROM q)),
m AS (SELECT DISTINCT entry, path FROM (SELECT entry, path, unnest(string_split(path, '>'))::BIGINT AS id FROM flows) WHERE id IN (SELECT symbol FROM c)),
t AS (SELECT (SELECT count(DISTINCT file) FROM c) AS files, (SELECT count(DISTINCT symbol) FROM c) AS symbols, (SELECT count(*) FROM r) AS dependents, (SELECT count(*) FROM m) AS flows),
u AS (SELECT *, (least(4 * files, 20) + least(5 * symbols, 25) + least(2 * dependents, 35) + least(5 * flows, 20))::BIGINT AS risk FROM t)
SELECT *, CASE WHEN risk >= 75 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS level FROM u""")
def change_risk(spark, sf):
    """Files, symbols, dependents and flows that the newest run's changes touch, capped and added up."""
    c = changes(spark, sf)
    last = c.agg(F.max("run").alias("run"))  # one row
    return graph.change_risk(c.join(F.broadcast(last), "run").select("symbol", "file").distinct(), edges(spark, sf), flows(spark, sf))


_SIMPLE = f"""WITH RECURSIVE {E_ALL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'signup' AND src NOT IN (3, 4) AND dst NOT IN (3, 4)),
r(node, ids) AS (SELECT dst, [src, dst] FROM e WHERE src = {START} AND dst <> {START} UNION ALL SELECT e.dst, list_append(r.ids, e.dst) FROM r JOIN e ON e.src = r.node WHERE len(r.ids) < 5 AND NOT list_contains(r.ids, e.dst))"""


@query("g22_constrained_paths", _SIMPLE + f" SELECT array_to_string(ids, '>') AS path, len(ids) - 1 AS depth FROM r WHERE list_contains(ids, {TARGET}) ORDER BY 2, 1 LIMIT 100")
def constrained_paths(spark, sf):
    e = graph.of_types(edges(spark, sf), ("signup",))
    p = graph.simple_paths(e, START, 4, must_pass=(TARGET,), must_avoid=(3, 4))
    return p.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("depth")).orderBy("depth", "path").limit(100)


@query("g23_recursive_paths", _SIMPLE + " SELECT array_to_string(ids, '>') AS path FROM r WHERE len(ids) <= 4")
def recursive_paths(spark, sf):
    """The same search as one recursive query, run by the engine itself."""
    graph.of_types(edges(spark, sf), ("signup",)).where("src not in (3, 4) and dst not in (3, 4)").select("src", "dst").distinct().createOrReplaceTempView("g23_edges")
    return spark.sql(f"""WITH RECURSIVE r(node, ids) AS (SELECT dst, array(src, dst) FROM g23_edges WHERE src = {START} AND dst <> {START}
        UNION ALL SELECT e.dst, array_append(r.ids, e.dst) FROM r JOIN g23_edges e ON e.src = r.node WHERE size(r.ids) < 4 AND NOT array_contains(r.ids, e.dst))
        SELECT array_join(ids, '>') AS path FROM r""")


_SUB = f"""WITH RECURSIVE {E_ALL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'view'), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r(node, depth) AS (SELECT {START}::BIGINT, 0 UNION SELECT b.dst, depth + 1 FROM r JOIN b ON b.src = r.node WHERE depth < 2), k AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1 ORDER BY 2, 1 LIMIT 25)"""


def subgraph_nodes(spark, sf):
    e = graph.of_types(edges(spark, sf), ("view",)).select("src", "dst")
    found = graph.reach(e.union(e.select("dst", "src")), spark.range(START, START + 1), 2).where(F.col("node") != START).select("node", "depth")
    return found.union(spark.range(START, START + 1).select("id", F.lit(0))).orderBy("depth", "node").limit(25)


@query("g24_subgraph_nodes", _SUB + " SELECT node, depth FROM k")
def subgraph(spark, sf):
    return subgraph_nodes(spark, sf)


@query("g24_subgraph_edges", _SUB + " SELECT e.src, e.dst FROM e JOIN k a ON a.node = e.src JOIN k b ON b.node = e.dst")
def subgraph_edges(spark, sf):
    k = subgraph_nodes(spark, sf).select("node")
    e = graph.of_types(edges(spark, sf), ("view",)).select("src", "dst").distinct()
    return e.join(k.withColumnRenamed("node", "src"), "src", "left_semi").join(k.withColumnRenamed("node", "dst"), "dst", "left_semi")


@query("g25_caller_subgraph", _CALLERS + f", k AS (SELECT node FROM m WHERE depth <= 2 UNION SELECT {START}) SELECT x.src, x.dst, count(*) AS n FROM edges x JOIN k a ON a.node = x.src JOIN k b ON b.node = x.dst WHERE edge_type IN ('click', 'view') GROUP BY 1, 2")
def caller_subgraph(spark, sf):
    e = graph.of_types(edges(spark, sf), ("click", "view"))
    k = graph.reach(graph.reversed_edges(e), spark.range(START, START + 1), 2).select("node").union(spark.range(START, START + 1)).distinct()
    inside = e.join(k.withColumnRenamed("node", "src"), "src", "left_semi").join(k.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return inside.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("g26_project_sample", f"WITH {E_ALL}, {NODES_SQL}, k AS (SELECT id FROM nodes WHERE project_id = 7 ORDER BY id LIMIT 30) SELECT src, dst, edge_type, count(*) AS n FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY 1, 2, 3")
def project_sample(spark, sf):
    k = nodes(spark, sf).where("project_id = 7").orderBy("id").limit(30).select("id")
    e = edges(spark, sf).join(k.withColumnRenamed("id", "src"), "src", "left_semi").join(k.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.groupBy("src", "dst", "edge_type").agg(F.count("*").alias("n"))


@query("g27_export_edges", f"WITH {E_ALL} SELECT DISTINCT src || '→' || dst || ':' || edge_type AS key FROM edges")
def export_edges(spark, sf):
    return edges(spark, sf).select(F.concat(F.col("src").cast("string"), F.lit("→"), F.col("dst").cast("string"), F.lit(":"), "edge_type").alias("key")).distinct()


@query("io27_export_dot", f"""WITH {E_ALL}, {NODES_SQL} SELECT '  "' || id || '" [label="' || name || '"];' AS line FROM nodes WHERE id IN (SELECT src FROM edges UNION SELECT dst FROM edges) UNION ALL SELECT DISTINCT '  "' || src || '" -> "' || dst || '" [label="' || edge_type || '"];' FROM edges""")
def export_dot(spark, sf):
    e = edges(spark, sf)
    n = nodes(spark, sf).join(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), "id", "left_semi")
    return export_lines(n, e, "dot").select("line")


@query("io27_export_d3", f"""WITH {E_ALL}, {NODES_SQL} SELECT 0 AS part, lpad(id::VARCHAR, 20, '0') AS ord, '{{"id":' || id || ',"name":"' || name || '","group":"' || node_type || '"}}' AS line FROM nodes UNION ALL SELECT DISTINCT 1, lpad(src::VARCHAR, 20, '0') || ':' || lpad(dst::VARCHAR, 20, '0') || ':' || edge_type, '{{"source":' || src || ',"target":' || dst || ',"type":"' || edge_type || '"}}' FROM edges""")
def export_d3(spark, sf):
    return export_lines(nodes(spark, sf), edges(spark, sf), "d3")


def _walks():
    return {"CALLERS": (("click",), True), "CALLEES": (("click",), False), "ANCESTORS": (("view",), False), "DESCENDANTS": (("view",), True)}


@query("g28_dsl_match", f"WITH {NODES_SQL} SELECT id, name, node_type, project_id, importance FROM nodes WHERE node_type = 'building' AND ((project_id IN (3, 4) AND importance > 1000) OR ends_with(name, '77')) ORDER BY importance DESC, id LIMIT 25 OFFSET 5")
def dsl_match(spark, sf):
    return dsl.execute("MATCH building WHERE projectId IN (3, 4) AND importance > 1000 OR name ENDS WITH '77' ORDER BY importance DESC LIMIT 25 OFFSET 5", nodes(spark, sf), edges(spark, sf))


@query("g28_dsl_count", f"WITH {NODES_SQL} SELECT count(*) AS n FROM nodes WHERE starts_with(name, 'Customer#0000000') AND NOT project_id IN (1, 2)")
def dsl_count(spark, sf):
    return dsl.execute("COUNT * WHERE name LIKE 'Customer#0000000*' AND projectId NOT IN (1, 2)", nodes(spark, sf), edges(spark, sf))


@query("g29_dsl_group", f"WITH {NODES_SQL} SELECT node_type AS value, count(*) AS n FROM nodes WHERE regexp_matches(name, '[0-4]$') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def dsl_group(spark, sf):
    return dsl.execute("MATCH * WHERE name MATCHES '[0-4]$' GROUP BY nodeType", nodes(spark, sf), edges(spark, sf))


@query("g29_aggregates", f"WITH {NODES_SQL} SELECT node_type, count(*) AS n, round(sum(importance), 2) AS total, round(avg(importance), 4) AS mean FROM nodes GROUP BY 1")
def aggregates(spark, sf):
    return nodes(spark, sf).groupBy("node_type").agg(F.count("*").alias("n"), F.round(F.sum("importance"), 2).alias("total"), F.round(F.avg("importance"), 4).alias("mean"))


@query("g30_dsl_walk", f"""WITH RECURSIVE {E_ALL}, {NODES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'click'), r(node, depth) AS (SELECT e.dst, 1 FROM e JOIN nodes n ON n.id = e.src WHERE n.project_id = 3 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 2)
SELECT id, name, node_type, project_id, importance FROM nodes WHERE id IN (SELECT node FROM r) ORDER BY id LIMIT 500""")
def dsl_walk(spark, sf):
    return dsl.execute("MATCH * WHERE projectId = 3 CALLEES 2 LIMIT 500", nodes(spark, sf), edges(spark, sf), _walks())


@query("g31_graph_stats", f"WITH {E_ALL}, {NODES_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT node_type) FROM nodes) AS node_types, (SELECT count(DISTINCT edge_type) FROM edges) AS edge_types")
def graph_stats(spark, sf):
    n = nodes(spark, sf).agg(F.count("*").alias("nodes"), F.countDistinct("node_type").alias("node_types"))
    return n.crossJoin(edges(spark, sf).agg(F.count("*").alias("edges"), F.countDistinct("edge_type").alias("edge_types")))


@query("g32_project_node_counts", f"WITH {NODES_SQL} SELECT project_id, count(*) AS n FROM nodes GROUP BY 1")
def project_node_counts(spark, sf):
    return nodes(spark, sf).groupBy("project_id").agg(F.count("*").alias("n"))


@query("g33_context_lines", f"""WITH {E_ALL}, {NODES_SQL}, b AS (SELECT src AS id, 'calls' AS side, dst AS other FROM edges UNION SELECT dst, 'called by', src FROM edges), x AS (SELECT b.id, side, n.name, row_number() OVER (PARTITION BY b.id, side ORDER BY n.name, other) AS r FROM b JOIN nodes n ON n.id = b.other),
s AS (SELECT id, side, string_agg(name, ', ' ORDER BY name) AS names FROM x WHERE r <= 5 GROUP BY 1, 2) SELECT id, string_agg(side || ': ' || names, '; ' ORDER BY side) AS context FROM s GROUP BY 1""")
def context_lines(spark, sf):
    e = edges(spark, sf).withColumn("edge_type", F.lit("any"))
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    r = graph.related(e, nodes(spark, sf), ids, 5, ("any",), ("any",))
    side = F.when(F.col("side") == "callee", "calls").otherwise("called by")
    per = r.groupBy("id", side.alias("side")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    return per.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "names"))), lambda x: F.concat_ws(": ", x["side"], x["names"])), "; ").alias("context"))


@query("g34_staleness", "WITH s AS (SELECT c_nationkey AS project_id, max(o_orderdate) AS indexed FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1), h AS (SELECT n_nationkey AS project_id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE TIMESTAMP '1999-01-01' - to_days(n_nationkey::INTEGER * 20) END AS head FROM nation) SELECT h.project_id, CASE WHEN head IS NULL OR indexed IS NULL THEN 'unknown' WHEN head > indexed THEN 'stale' ELSE 'fresh' END AS state FROM h LEFT JOIN s USING (project_id)")
def staleness(spark, sf):
    """A project is stale when its head moved after it was indexed."""
    s = load(spark, sf, "customer").join(load(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("project_id")).agg(F.max("o_orderdate").alias("indexed"))
    head = F.when(F.col("n_nationkey") % 5 != 0, F.expr("timestamp_ntz '1999-01-01' - make_dt_interval(n_nationkey * 20)"))
    h = load(spark, sf, "nation").select(F.col("n_nationkey").alias("project_id"), head.alias("head"))
    j = h.join(s, "project_id", "left")
    return j.select("project_id", graph.staleness(j).alias("state"))


@query("g35_edge_rules", f"""WITH {SYMBOLS_SQL}, r AS (SELECT project AS src, qualified_name AS dst, 'contains' AS edge_type, 1.0::DOUBLE AS confidence FROM symbols UNION ALL SELECT qualified_name, node_type, 'returns', 1.0 FROM symbols UNION ALL SELECT qualified_name, string_split(name, ' ')[2], 'uses', 0.9 FROM symbols
 UNION ALL SELECT qualified_name, string_split(name, ' ')[1], 'calls', CASE WHEN size >= 40 THEN 1.0 WHEN size >= 30 THEN 0.9 WHEN size >= 20 THEN 0.8 WHEN size >= 10 THEN 0.7 ELSE 0.5 END FROM symbols) SELECT src, dst, edge_type, max(confidence) AS confidence, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def edge_rules(spark, sf):
    """Edges from one pass over symbols: what a symbol belongs to, returns, uses and calls, each with its confidence."""
    size = F.col("size")
    ladder = F.lit(graph.CALL_CONFIDENCE[-1])
    for least, confidence in zip((10, 20, 30, 40), reversed(graph.CALL_CONFIDENCE[:-1]), strict=True):
        ladder = F.when(size >= least, confidence).otherwise(ladder)
    word, q = F.split("name", " "), F.col("qualified_name")
    rules = {"contains": (F.col("project"), q, F.lit(1.0)), "returns": (q, F.col("node_type"), F.lit(1.0)), "uses": (q, F.get(word, F.lit(1)), F.lit(0.9)), "calls": (q, F.get(word, F.lit(0)), ladder)}
    return graph.made_edges(symbols(spark, sf), rules)


@query("j1_node_edge_node", f"WITH {E_ALL}, {NODES_SQL} SELECT a.name AS from_name, e.edge_type, b.name AS to_name FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst")
def node_edge_node(spark, sf):
    n = nodes(spark, sf)
    e = edges(spark, sf).join(n.select(F.col("id").alias("src"), F.col("name").alias("from_name")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("to_name")), "dst")
    return e.select("from_name", "edge_type", "to_name")


@query("j9_edge_dedupe", f"WITH {E_ALL} SELECT src, dst, edge_type, min(edge_id) AS edge_id FROM edges GROUP BY 1, 2, 3")
def edge_dedupe(spark, sf):
    return edges(spark, sf).groupBy("src", "dst", "edge_type").agg(F.min("edge_id").alias("edge_id"))


@query("j10_cross_language", f"WITH {E_ALL}, {NODES_SQL} SELECT e.edge_id, a.node_type AS from_language, b.node_type AS to_language FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.node_type <> b.node_type AND a.node_type = 'machinery' ORDER BY 1 LIMIT 5000")
def cross_language(spark, sf):
    n = nodes(spark, sf)
    e = edges(spark, sf).join(n.where("node_type = 'machinery'").select(F.col("id").alias("src"), F.col("node_type").alias("from_language")), "src").join(n.select(F.col("id").alias("dst"), F.col("node_type").alias("to_language")), "dst")
    return e.where("from_language <> to_language").select("edge_id", "from_language", "to_language").orderBy("edge_id").limit(5000)


@query("w3_top_edges_per_node", f"WITH {E_ALL} SELECT src, dst, edge_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, edge_id) AS rank FROM edges) WHERE rank <= 3")
def top_edges(spark, sf):
    w = Window.partitionBy("src").orderBy(F.desc("confidence"), "edge_id")
    return edges(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("src", "dst", "edge_id", "rank")
