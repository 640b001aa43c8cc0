"""Queries of the change log, usage statistics and incremental state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph.operators import history, incremental, services
from lodegraph.registry import query
from lodegraph.sources.tables import CHANGES_SQL, SYMBOLS_SQL, changes, load, symbols

START, END = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)
W_SQL = "occurred >= TIMESTAMP '2024-01-10' AND occurred <= TIMESTAMP '2024-01-20'"
C = f"WITH {CHANGES_SQL}"


def window(spark, sf):
    return history.between(changes(spark, sf), START, END)


for _unit in ("hour", "day", "week"):

    @query(f"a8_histogram_{_unit}", f"{C} SELECT date_trunc('{_unit}', occurred)::TIMESTAMP AS bucket, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'removed') AS removed, count(*) AS total FROM changes GROUP BY 1")
    def _histogram(spark, sf, unit=_unit):
        return history.histogram(changes(spark, sf), unit).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("a7_activity_summary", f"{C} SELECT 'change' AS dimension, change AS value, count(*) AS n FROM changes GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM changes GROUP BY 2 UNION ALL SELECT 'all', '', count(*) FROM changes")
def activity(spark, sf):
    return history.activity(changes(spark, sf))


@query("a7_top_files", f"{C} SELECT file, count(*) AS n FROM changes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_files(spark, sf):
    return changes(spark, sf).groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(10)


@query("h2_project_diff", f"{C} SELECT file, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'removed') AS removed, count(DISTINCT symbol) AS symbols FROM changes WHERE {W_SQL} GROUP BY 1")
def project_diff(spark, sf):
    c = {k: F.count_if(F.col("change") == k).alias(k) for k in ("added", "modified", "removed")}
    return window(spark, sf).groupBy("file").agg(*c.values(), F.countDistinct("symbol").alias("symbols"))


@query("h3_recent_by_file", f"{C}, w AS (SELECT * FROM changes WHERE {W_SQL}), t AS (SELECT file, count(*) AS total FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) SELECT file, total, place::INTEGER AS place, id, symbol, change FROM (SELECT w.*, total, row_number() OVER (PARTITION BY file ORDER BY occurred DESC, id DESC) AS place FROM w JOIN t USING (file)) WHERE place <= 10")
def recent(spark, sf):
    return history.recent_by_file(window(spark, sf), 10, 8)


@query("h4_symbol_history", f"{C}, x AS (SELECT *, lag(signature) OVER (PARTITION BY symbol ORDER BY occurred, id) AS before FROM changes) SELECT symbol, min(occurred) AS first_seen, max(occurred) AS last_modified, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (before IS NOT NULL AND before <> signature) AS churn, arg_max(change, occurred) = 'removed' AS gone FROM x GROUP BY 1")
def symbol_history(spark, sf):
    return history.symbol_history(changes(spark, sf))


@query("h5_diff_samples", f"{C} SELECT kind, id, symbol FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY occurred, id) AS r FROM changes WHERE {W_SQL}) WHERE r <= 10")
def diff_samples(spark, sf):
    w = Window.partitionBy("kind").orderBy("at", "id")
    return window(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 10").select("kind", "id", "symbol")


@query("h6_snapshot_page", f"{C}, p AS (SELECT id, symbol, change FROM changes WHERE {W_SQL} AND change = 'removed' AND id > 4000 ORDER BY id LIMIT 51) SELECT id, symbol, change, (SELECT count(*) FROM p) > 50 AS has_more FROM p ORDER BY id LIMIT 50")
def snapshot_page(spark, sf):
    """A page after a cursor: one row more than the page says whether there are more."""
    p = window(spark, sf).where("change = 'removed' and id > 4000").orderBy("id").limit(51)
    n = p.agg((F.count("*") > 50).alias("has_more"))
    return p.orderBy("id").limit(50).select("id", "symbol", "change").crossJoin(F.broadcast(n))  # one row


@query("h7_explain_changes", f"{C}, x AS (SELECT *, lag(signature) OVER (PARTITION BY symbol ORDER BY occurred, id) AS before FROM changes WHERE {W_SQL}) SELECT id, CASE WHEN change <> 'modified' THEN change WHEN before IS NOT DISTINCT FROM signature THEN 'body changed' ELSE 'signature changed' END AS label, count(*) OVER (PARTITION BY run, file) - 1 AS siblings FROM x")
def explain(spark, sf):
    x = window(spark, sf).withColumn("before", F.lag("signature").over(Window.partitionBy("symbol").orderBy("at", "id")))
    return x.select("id", history.explain_change(F.col("change"), F.col("before"), F.col("signature")).alias("label"), (F.count("*").over(Window.partitionBy("run", "file")) - 1).alias("siblings"))


@query("h8_runs", f"{C} SELECT run, count(*) AS changes, count(DISTINCT file) AS files, min(id) AS first_id FROM changes GROUP BY 1 ORDER BY 1 DESC LIMIT 500")
def runs(spark, sf):
    r = changes(spark, sf).groupBy("run").agg(F.count("*").alias("changes"), F.countDistinct("file").alias("files"), F.min("id").alias("first_id"))
    return r.orderBy(F.desc("run")).limit(500).withColumn("run", F.col("run").cast("timestamp_ntz"))


@query("h9_change_history", f"{C} SELECT id, occurred, symbol, change FROM changes WHERE file = 'src/file3.fan' ORDER BY occurred DESC, id DESC LIMIT 1000")
def change_history(spark, sf):
    return changes(spark, sf).where("file = 'src/file3.fan'").orderBy(F.desc("at"), F.desc("id")).limit(1000).select("id", F.col("at").alias("occurred"), "symbol", "change")


@query("h10_net_changes", f"{C} SELECT symbol, count(*) AS n, CASE WHEN arg_max(change, occurred) = 'removed' THEN 'removed' WHEN arg_min(change, occurred) = 'added' THEN 'added' ELSE 'modified' END AS net FROM changes WHERE {W_SQL} GROUP BY 1")
def net_changes(spark, sf):
    return history.net_changes(window(spark, sf))


_REPLAY = f"""{C}, now_ AS (SELECT symbol, arg_max(signature, occurred) AS signature FROM changes GROUP BY 1 HAVING arg_max(change, occurred) <> 'removed'), l AS (SELECT * FROM changes WHERE occurred > TIMESTAMP '2024-01-20'),
d AS (SELECT symbol, arg_min(change, occurred) AS d_change, arg_min(signature, occurred) AS d_sig, min(occurred) AS d_at FROM l WHERE change IN ('added', 'removed') GROUP BY 1), m AS (SELECT symbol, arg_min(signature, occurred) AS m_sig, min(occurred) AS m_at FROM l WHERE change = 'modified' GROUP BY 1),
j AS (SELECT coalesce(n.symbol, l.symbol) AS symbol, n.signature AS now_sig, n.symbol IS NOT NULL AS is_now FROM now_ n FULL JOIN (SELECT DISTINCT symbol FROM l) l USING (symbol))
SELECT j.symbol, CASE WHEN m_at IS NOT NULL AND (d_at IS NULL OR m_at < d_at) THEN m_sig WHEN d_at IS NOT NULL THEN d_sig ELSE now_sig END AS signature FROM j LEFT JOIN d USING (symbol) LEFT JOIN m USING (symbol) WHERE CASE WHEN d_at IS NOT NULL THEN d_change = 'removed' ELSE is_now END"""


def current(spark, sf):
    c = changes(spark, sf).groupBy("symbol").agg(F.max_by("signature", history.ordered()).alias("signature"), F.max_by("change", history.ordered()).alias("c"))
    return c.where("c <> 'removed'").select("symbol", "signature")


@query("h11_symbols_at_time", _REPLAY)
def symbols_at(spark, sf):
    return history.replay(changes(spark, sf), current(spark, sf), dt.datetime(2024, 1, 20))


@query("h12_file_listing", f"WITH {SYMBOLS_SQL} SELECT id, name, CASE WHEN size % 7 = 0 THEN NULL ELSE size END AS line FROM symbols WHERE project = 'Brand#12' ORDER BY line NULLS LAST, name, id LIMIT 20 OFFSET 10")
def file_listing(spark, sf):
    s = symbols(spark, sf).where("project = 'Brand#12'").select("id", "name", F.when(F.col("size") % 7 != 0, F.col("size")).alias("line"))
    return s.orderBy(F.asc_nulls_last("line"), "name", "id").offset(10).limit(20)


@query("h13_code_neighbours", f"WITH {SYMBOLS_SQL}, p AS (SELECT id, project, row_number() OVER (PARTITION BY project ORDER BY size, id) AS place FROM symbols), c AS (SELECT project, min(place) AS centre FROM p JOIN symbols USING (id, project) WHERE id % 401 = 0 GROUP BY project HAVING count(*) = 1) SELECT id, project, (place - centre)::INTEGER AS offset_ FROM p JOIN c USING (project) WHERE abs(place - centre) <= 3")
def code_neighbours(spark, sf):
    """Symbols up to three places about the one looked for, in files that hold one."""
    s = symbols(spark, sf)
    one = s.where("id % 401 = 0").groupBy("project").count().where("count = 1").select("project")
    n = history.neighbours(s.join(one, "project", "left_semi"), "project", [F.col("size"), F.col("id")], 3, F.col("id") % 401 == 0)
    return n.select("id", "project", F.col("offset").alias("offset_"))


@query("h14_symbol_diff", f"{C}, a AS (SELECT symbol, arg_max(signature, occurred) AS signature FROM changes WHERE occurred <= TIMESTAMP '2024-01-10' GROUP BY 1 HAVING arg_max(change, occurred) <> 'removed'), b AS (SELECT symbol, arg_max(signature, occurred) AS signature FROM changes WHERE occurred <= TIMESTAMP '2024-01-20' GROUP BY 1 HAVING arg_max(change, occurred) <> 'removed') SELECT symbol, CASE WHEN a.symbol IS NULL THEN 'added' WHEN b.symbol IS NULL THEN 'removed' ELSE 'modified' END AS change, a.signature AS old, b.signature AS new FROM a FULL JOIN b USING (symbol) WHERE a.symbol IS NULL OR b.symbol IS NULL OR a.signature <> b.signature")
def symbol_diff(spark, sf):
    def at(t):
        c = changes(spark, sf).where(F.col("at") <= F.lit(t)).groupBy("symbol").agg(F.max_by("signature", history.ordered()).alias("signature"), F.max_by("change", history.ordered()).alias("c"))
        return c.where("c <> 'removed'").select("symbol", "signature")

    return history.symbol_diff(at(START), at(END))


@query("h15_edge_diff", "WITH a AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01') SELECT 'removed' AS change, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'added', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'kept', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def edge_diff(spark, sf):
    """Both sides in one aggregate: which of them has an edge tells what became of it."""
    e = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_shipdate") >= F.lit(dt.datetime(1996, 1, 1)).cast("timestamp_ntz")).alias("late"))
    per = e.groupBy("src", "dst").agg(F.bool_or("late").alias("b"), F.bool_or(~F.col("late")).alias("a"))
    kinds = F.when(F.col("a") & F.col("b"), "kept").when(F.col("a"), "removed").otherwise("added")
    found = per.groupBy(kinds.alias("change")).agg(F.count("*").alias("n"))
    every = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in ("removed", "added", "kept")))).alias("change"))
    return every.join(found, "change", "left").na.fill(0)


@query("h16_run_delete_plan", f"{C}, r AS (SELECT DISTINCT symbol FROM changes WHERE run = TIMESTAMP '2024-01-28') SELECT r.symbol, EXISTS (SELECT 1 FROM changes c WHERE c.symbol = r.symbol AND c.run > TIMESTAMP '2024-01-28') AS changed_later FROM r")
def run_delete_plan(spark, sf):
    c = changes(spark, sf)
    day = F.lit(dt.datetime(2024, 1, 28))
    later = c.where(F.col("run") > day).select("symbol").distinct().withColumn("l", F.lit(True))
    return c.where(F.col("run") == day).select("symbol").distinct().join(later, "symbol", "left").select("symbol", F.coalesce("l", F.lit(False)).alias("changed_later"))


@query("j14_as_of_run", f"{C}, r AS (SELECT DISTINCT run FROM changes WHERE day(run) % 3 = 0) SELECT c.id, (SELECT max(run) FROM r WHERE r.run <= c.occurred) AS run FROM changes c")
def as_of_run(spark, sf):
    """Each change with the latest run that began before it."""
    c = changes(spark, sf)
    left = c.select("id", "at", F.to_date("at").alias("d"))
    r = c.where(F.day("run") % 3 == 0).select("run").distinct()
    # runs are few for a day; every run serves the days up to the next one, so days meet runs in an equality join
    nxt = F.lead("run").over(Window.partitionBy(F.trunc("run", "year")).orderBy("run"))
    spans = r.withColumn("till", F.coalesce(nxt, F.col("run") + F.expr("interval 366 days"))).select("run", F.explode(F.sequence(F.to_date("run"), F.to_date(F.col("till") - F.expr("interval 1 day")))).alias("d"))
    best = left.join(spans, "d", "left").select("id", F.when(F.col("run") <= F.col("at"), F.col("run")).alias("run"))
    return best.withColumn("run", F.col("run").cast("timestamp_ntz"))


@query("j14_as_of_price", "SELECT e.event_id, e.user_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderdate + INTERVAL 9000 DAY AS occurred FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1) o ON o.o_custkey = e.user_id AND o.occurred <= e.ts")
def as_of_price(spark, sf):
    """Events as of the user's latest order (moved on to the events' time)."""
    o = load(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("o_orderkey"))
    o = o.select(F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("interval 9000 days")).alias("at"), "o_orderkey")
    e = load(spark, sf, "events").select("event_id", "user_id", "ts")
    return history.as_of(e, o, "user_id", "ts", "at", ["o_orderkey"]).select("event_id", "user_id", "o_orderkey")


# --- usage --------------------------------------------------------------------------------------


@query("a1_usage_stats", "SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS recent FROM events GROUP BY 1")
def usage_stats(spark, sf):
    return load(spark, sf, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.count_if(F.col("ts") >= F.lit(dt.datetime(2024, 1, 24)).cast("timestamp_ntz")).alias("recent"))


@query("a1_top_queries", "SELECT json_extract_string(props, '$.k') AS query, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_queries(spark, sf):
    return load(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").alias("query")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(20)


@query("a2_tool_metrics", "SELECT event_type AS tool, count(*) AS calls, round(avg((event_id % 9 <> 0)::INTEGER), 4) AS success_rate, round(1 - avg((event_id % 9 <> 0)::INTEGER), 4) AS error_rate, round(avg(value)) AS mean_duration FROM events GROUP BY 1")
def tool_metrics(spark, sf):
    ok = (F.col("event_id") % 9 != 0).cast("int")
    return load(spark, sf, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.round(F.avg(ok), 4).alias("success_rate"), F.round(1 - F.avg(ok), 4).alias("error_rate"), F.round(F.avg("value")).alias("mean_duration"))


@query("a3_session_stats", "SELECT count(DISTINCT user_id) AS sessions, round(count(*) / count(DISTINCT user_id), 4) AS events_per_session FROM events")
def session_stats(spark, sf):
    per = load(spark, sf, "events").groupBy("user_id").count()
    return per.agg(F.count("*").alias("sessions"), F.round(F.sum("count") / F.count("*"), 4).alias("events_per_session"))


@query("a4_searches_by_source", "SELECT source, count(*) AS n, count(DISTINCT text) AS unique_texts FROM documents GROUP BY 1")
def searches_by_source(spark, sf):
    """Texts are told apart by a hash of 128 bits, so no text is shuffled."""
    return load(spark, sf, "documents").select("source", F.md5("text").alias("h")).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("h").alias("unique_texts"))


@query("a9_index_stats", f"WITH {SYMBOLS_SQL} SELECT project, node_type, count(*) AS n, round(avg(size), 4) AS mean_size FROM symbols GROUP BY ROLLUP (project, node_type)")
def index_stats(spark, sf):
    return symbols(spark, sf).rollup("project", "node_type").agg(F.count("*").alias("n"), F.round(F.avg("size"), 4).alias("mean_size"))


@query("a11_index_health", "SELECT source, count(*) AS documents, count(l.doc_id) AS labelled, round(100.0 * count(l.doc_id) / count(*), 2)::DOUBLE AS coverage, CASE WHEN count(l.doc_id) = 0 THEN 'empty' WHEN count(l.doc_id) * 100 < 35 * count(*) THEN 'thin' ELSE 'healthy' END AS state FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def index_health(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source").join(load(spark, sf, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    return services.health(d, "source", F.col("l"))


@query("a12_project_calls", "SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS calls, least(1.0, count(*) / 20.0)::DOUBLE AS confidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2 HAVING count(*) >= 5")
def project_calls(spark, sf):
    li = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(load(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    g = li.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("calls"))
    return g.where("calls >= 5").withColumn("confidence", F.least(F.lit(1.0), F.col("calls") / 20.0))


@query("a13_dependency_badges", "WITH e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer, supplier WHERE c_custkey % 50 = s_suppkey % 50) SELECT n_nationkey AS project, (SELECT count(*) FROM e WHERE src = n_nationkey) AS outgoing, (SELECT count(*) FROM e WHERE dst = n_nationkey) AS incoming FROM nation")
def badges(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 50).alias("k")).distinct()
    e = c.join(load(spark, sf, "supplier").select(F.col("s_nationkey").alias("dst"), (F.col("s_suppkey") % 50).alias("k")).distinct(), "k").select("src", "dst")
    return services.badges(load(spark, sf, "nation").select(F.col("n_nationkey").alias("project")), e)


@query("a15_coverage_totals", "SELECT source, count(*) AS functions, count(l.doc_id) AS vectors, round(100.0 * count(l.doc_id) / count(*), 1)::DOUBLE AS percent FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (source)")
def coverage_totals(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source").join(load(spark, sf, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    g = d.rollup("source").agg(F.count("*").alias("functions"), F.count("l").alias("vectors"))
    return g.withColumn("percent", F.round(100.0 * F.col("vectors") / F.col("functions"), 1))


@query("a16_vectors_per_project", "SELECT label AS project, count(*) AS chunks, count(*) FILTER (vec_id % 4 = 0) AS functions FROM embeddings GROUP BY 1")
def vectors_per_project(spark, sf):
    return load(spark, sf, "embeddings").groupBy(F.col("label").alias("project")).agg(F.count("*").alias("chunks"), F.count_if(F.col("vec_id") % 4 == 0).alias("functions"))


@query("a18_cache_size", "SELECT lang AS model, count(*) AS entries, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def cache_size(spark, sf):
    return load(spark, sf, "documents").groupBy(F.col("lang").alias("model")).agg(F.count("*").alias("entries"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


@query("x9_spend_per_role_day", "SELECT event_type AS role, date_trunc('day', ts)::TIMESTAMP AS day, round(sum(value), 4) AS spend, sum(value) > 1500 AS over_cap FROM events GROUP BY 1, 2")
def spend(spark, sf):
    g = load(spark, sf, "events").groupBy(F.col("event_type").alias("role"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.sum("value").alias("s"))
    return g.select("role", "day", F.round("s", 4).alias("spend"), (F.col("s") > 1500).alias("over_cap"))


# --- incremental state --------------------------------------------------------------------------

_OLD = "SELECT doc_id AS path, doc_id % 13 AS mtime, n_chars AS size, md5(text) AS sha, CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 2 END AS version FROM documents WHERE doc_id % 10 <> 1"
_NEW = "SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 99 ELSE doc_id % 13 END AS mtime, n_chars AS size, md5(CASE WHEN doc_id % 14 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 10 <> 2"


@query("i1_change_gate", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.version <> 2 THEN 'modified' WHEN o.mtime = n.mtime AND o.size = n.size THEN 'unchanged' WHEN o.sha = n.sha THEN 'unchanged' ELSE 'modified' END AS state FROM o FULL JOIN n USING (path)")
def change_gate(spark, sf):
    d = load(spark, sf, "documents")
    old = d.where("doc_id % 10 <> 1").select(F.col("doc_id").alias("path"), (F.col("doc_id") % 13).alias("mtime"), F.col("n_chars").alias("size"), F.md5("text").alias("sha"), F.when(F.col("doc_id") % 50 == 0, 1).otherwise(2).alias("version"))
    changed = F.when(F.col("doc_id") % 14 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where("doc_id % 10 <> 2").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 7 == 0, 99).otherwise(F.col("doc_id") % 13).alias("mtime"), F.col("n_chars").alias("size"), F.md5(changed).alias("sha"))
    return incremental.change_gate(old, new, 2)


@query("i2_change_set", f"WITH o AS ({_OLD}), n AS ({_NEW}), s AS (SELECT CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.version <> 2 THEN 'modified' WHEN o.mtime = n.mtime AND o.size = n.size THEN 'unchanged' WHEN o.sha = n.sha THEN 'unchanged' ELSE 'modified' END AS state FROM o FULL JOIN n USING (path)) SELECT state, count(*) AS n FROM s GROUP BY 1")
def change_set(spark, sf):
    return change_gate(spark, sf).groupBy("state").agg(F.count("*").alias("n"))


@query("i3_status_letters", "SELECT CASE event_id % 7 WHEN 0 THEN 'added' WHEN 1 THEN 'added' WHEN 2 THEN 'modified' WHEN 3 THEN 'modified' WHEN 4 THEN 'removed' WHEN 5 THEN 'renamed' ELSE 'unmerged' END AS change, count(*) AS n FROM events GROUP BY 1")
def status_letters(spark, sf):
    letter = F.element_at(F.array(*(F.lit(x) for x in ("A", "C75", "M", "T", "D", "R100", "U"))), (F.col("event_id") % 7 + 1).cast("int"))
    return load(spark, sf, "events").groupBy(incremental.status_change(letter).alias("change")).agg(F.count("*").alias("n"))


MESSAGES = ("commit: fix", "commit (amend): x", "merge topic: Fast-forward", "rebase (pick): a", "rebase (finish): b", "checkout: moving from a to b", "pull: ok", "gc")


@query("i4_head_moves", "SELECT CASE event_id % 8 WHEN 0 THEN 'edit' WHEN 1 THEN 'rewrite' WHEN 2 THEN 'integrate' WHEN 3 THEN 'inner' WHEN 4 THEN 'rewrite' WHEN 5 THEN 'switch' WHEN 6 THEN 'integrate' ELSE 'unknown' END AS kind, count(*) AS n FROM events GROUP BY 1")
def head_moves(spark, sf):
    message = F.element_at(F.array(*(F.lit(m) for m in MESSAGES)), (F.col("event_id") % 8 + 1).cast("int"))
    return load(spark, sf, "events").groupBy(F.coalesce(incremental.head_move(message), F.lit("inner")).alias("kind")).agg(F.count("*").alias("n"))


@query("i5_task_plans", f"{C}, p AS (SELECT run, file, count(DISTINCT symbol) AS n FROM changes GROUP BY 1, 2) SELECT run, file, CASE WHEN n > 12 OR n / 40.0 > 0.25 THEN 'full-reindex' ELSE 'parse' END AS kind, CASE WHEN n > 12 OR n / 40.0 > 0.25 OR n % 5 = 0 THEN 90 WHEN n % 2 = 0 THEN 10 ELSE 50 END AS priority FROM p")
def task_plans(spark, sf):
    p = changes(spark, sf).groupBy("run", "file").agg(F.countDistinct("symbol").alias("n"))
    kind, priority = incremental.task_plan(F.col("n"), F.lit(40.0), F.col("n") % 5 == 0, F.col("n") % 2 == 0, 12, 0.25)
    return p.select(F.col("run").cast("timestamp_ntz").alias("run"), "file", kind.alias("kind"), priority.alias("priority"))


@query("i6_merged_queue", """WITH t AS (SELECT event_id AS id, user_id % 30 AS project, event_type AS kind, CASE WHEN event_id % 11 = 0 THEN 'git' ELSE 'scan' END AS source, event_id % 90 AS priority, 'p' || event_id % 17 AS p, 'p' || event_id % 5 AS r FROM events),
g AS (SELECT project, kind, max(id) FILTER (source = 'git') AS git_id, min(priority) AS priority, max(id) AS id, count(*) AS merged FROM t GROUP BY 1, 2), l AS (SELECT t.*, git_id FROM t JOIN g USING (project, kind) WHERE git_id IS NULL OR t.id >= git_id),
x AS (SELECT project, kind, path, min(gone) AS gone FROM (SELECT project, kind, p AS path, 0 AS gone FROM l UNION ALL SELECT project, kind, r, 1 FROM l) GROUP BY 1, 2, 3), c AS (SELECT project, kind, count(*) FILTER (gone = 0) AS paths, count(*) FILTER (gone = 1) AS removed FROM x GROUP BY 1, 2)
SELECT project, kind, id, priority, merged, CASE WHEN paths + removed > 15 THEN 0 ELSE paths END AS paths, CASE WHEN paths + removed > 15 THEN 0 ELSE removed END AS removed, paths + removed > 15 AS "full" FROM g JOIN c USING (project, kind)""")
def merged_queue(spark, sf):
    e = load(spark, sf, "events")
    word = lambda n: F.array(F.concat(F.lit("p"), (F.col("event_id") % n).cast("string")))
    t = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 30).alias("project"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 11 == 0, "git").otherwise("scan").alias("source"), (F.col("event_id") % 90).alias("priority"), word(17).alias("paths"), word(5).alias("removed"))
    return incremental.merged_queue(t, 15)


@query("i7_claim_order", "SELECT event_id AS id, event_type AS lane, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 3, ts, event_id)::INTEGER AS turn, least(600.0, 5 * pow(2, greatest(event_id % 9 - 1, 0))) AS retry_after FROM events WHERE event_id % 4 = 0 AND ts <= TIMESTAMP '2024-01-15'")
def claim_order(spark, sf):
    t = load(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("lane"), F.when(F.col("event_id") % 4 == 0, "pending").otherwise("done").alias("state"), (F.col("event_id") % 3).alias("priority"), F.col("ts").alias("due"))
    return incremental.claim_order(t, dt.datetime(2024, 1, 15)).select("id", "lane", "turn", incremental.backoff(F.col("id") % 9, 5, 600).alias("retry_after"))


_FOCUS = """e AS (SELECT user_id AS project, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e),
g AS (SELECT project, n, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS touches, max(ts) AS last FROM s GROUP BY 1, 2)"""


@query("i8_focus_sessions", f"WITH {_FOCUS} SELECT project, session_start, session_end, touches, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY last::DATE ORDER BY last DESC, project) AS place FROM g) WHERE place <= 12")
def focus_sessions(spark, sf):
    e = load(spark, sf, "events").select(F.col("ts").alias("at"), F.col("user_id").alias("project"))
    return incremental.focus(e, "6 hours", 12)


@query("i9_graph_patch", f"""WITH {SYMBOLS_SQL}, o AS (SELECT id AS key, md5(id::VARCHAR) AS body FROM symbols WHERE id % 10 <> 3), n AS (SELECT CASE WHEN id % 20 = 7 THEN id + 1000000 ELSE id END AS key, md5((CASE WHEN id % 9 = 0 THEN -id ELSE id END)::VARCHAR) AS body FROM symbols WHERE id % 10 <> 4),
j AS (SELECT coalesce(o.key, n.key) AS key, o.key IS NOT NULL AS o_is, n.key IS NOT NULL AS n_is, o.body AS ob, n.body AS nb FROM o FULL JOIN n USING (key)), ren AS (SELECT a.key AS from_key, b.key AS to_key FROM j a JOIN j b ON a.ob = b.nb WHERE NOT a.n_is AND NOT b.o_is)
SELECT CASE WHEN r.from_key IS NOT NULL THEN 'renamed' WHEN NOT o_is THEN 'added' WHEN NOT n_is THEN 'removed' WHEN ob = nb THEN 'kept' ELSE 'updated' END AS action, key, r.from_key FROM j LEFT JOIN ren r ON r.to_key = key WHERE key NOT IN (SELECT from_key FROM ren)""")
def graph_patch(spark, sf):
    s = symbols(spark, sf).select("id")
    body = lambda c: F.md5(c.cast("string"))
    old = s.where("id % 10 <> 3").select(F.col("id").alias("key"), body(F.col("id")).alias("body"))
    new = s.where("id % 10 <> 4").select(F.when(F.col("id") % 20 == 7, F.col("id") + 1000000).otherwise(F.col("id")).alias("key"), body(F.when(F.col("id") % 9 == 0, -F.col("id")).otherwise(F.col("id"))).alias("body"))
    return incremental.graph_patch(old, new)


@query("i11_embed_patch", "WITH i AS (SELECT doc_id AS node, md5(text) AS hash FROM documents WHERE doc_id % 6 <> 0), s AS (SELECT doc_id AS node, md5(CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE text END) AS hash, CASE WHEN doc_id % 8 = 0 THEN 2 ELSE 3 END AS version, 'm' AS model FROM documents WHERE doc_id % 4 <> 1), c AS (SELECT DISTINCT md5(text) AS hash FROM documents WHERE doc_id % 3 = 0) SELECT coalesce(i.node, s.node) AS node, CASE WHEN i.node IS NULL THEN 'orphan' WHEN i.hash = s.hash AND s.version = 3 AND s.model = 'm' THEN 'skip' WHEN c.hash IS NOT NULL THEN 'cached' ELSE 'encode' END AS action FROM i FULL JOIN s USING (node) LEFT JOIN c ON c.hash = i.hash")
def embed_patch(spark, sf):
    d = load(spark, sf, "documents")
    items = d.where("doc_id % 6 <> 0").select(F.col("doc_id").alias("node"), F.md5("text").alias("hash"))
    state = d.where("doc_id % 4 <> 1").select(F.col("doc_id").alias("node"), F.md5(F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.col("text"))).alias("hash"), F.when(F.col("doc_id") % 8 == 0, 2).otherwise(3).alias("version"), F.lit("m").alias("model"))
    return incremental.embed_patch(items, state, d.where("doc_id % 3 = 0").select(F.md5("text").alias("hash")), 3, "m")


@query("i12_vector_gc", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) AND EXISTS (SELECT 1 FROM labels)")
def vector_gc(spark, sf):
    """Vectors whose node is gone; none while there are no nodes at all."""
    n = load(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"))
    gone = load(spark, sf, "embeddings").select("vec_id").join(n, "vec_id", "left_anti")
    return gone.join(F.broadcast(n.limit(1).select(F.lit(1).alias("some"))), F.lit(True), "left_semi")


@query("i13_lru_prune", "SELECT lang, doc_id FROM (SELECT lang, doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 50000")
def lru_prune(spark, sf):
    d = load(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    return incremental.within_budget(d, ["lang"], [F.desc("doc_id")], "n_chars", 50000).select("lang", "doc_id")


@query("i15_rekey", f"WITH {SYMBOLS_SQL}, m AS (SELECT substr(md5(id::VARCHAR), 1, 16) AS old_id, substr(sha1(qualified_name || id), 1, 16) AS new_id FROM symbols WHERE id % 3 = 0) SELECT s.id, coalesce(m.new_id, substr(md5(s.id::VARCHAR), 1, 16)) AS key FROM symbols s LEFT JOIN m ON m.old_id = substr(md5(s.id::VARCHAR), 1, 16)")
def rekey(spark, sf):
    s = symbols(spark, sf).withColumn("old_id", F.substring(F.md5(F.col("id").cast("string")), 1, 16))
    m = s.where("id % 3 = 0").select("old_id", F.substring(F.sha1(F.concat("qualified_name", F.col("id").cast("string"))), 1, 16).alias("new_id"))
    return s.select("id", "old_id").join(m, "old_id", "left").select("id", F.coalesce("new_id", "old_id").alias("key"))


@query("io26_vector_upsert", "SELECT vec_id, label, 'new' AS origin FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, label, 'old' FROM embeddings WHERE vec_id % 3 <> 0")
def vector_upsert(spark, sf):
    v = load(spark, sf, "embeddings").select("vec_id", "label")
    return incremental.upsert(v.withColumn("origin", F.lit("old")), v.where("vec_id % 3 = 0").withColumn("origin", F.lit("new")), ["vec_id"])
