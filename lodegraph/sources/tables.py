"""The driver's tables, and the shapes of a code graph that are bound to them.

events    -> typed edges between users (consecutive events of a type within an hour), the change log, usage events
customer  -> graph nodes; part -> symbols; documents -> code and document texts; embeddings -> vectors
region, nation, customer, orders, supplier -> the containment tree
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, src, dst, edge_type, confidence, hour: each event leads to the next one of its type in its hour. Dealt by (type, hour), so no sort grows with the log's length."""
    e = load(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    w = Window.partitionBy("event_type", "hour").orderBy("ts", "event_id")
    e = e.withColumn("dst", F.lead("user_id").over(w)).where(F.col("dst").isNotNull())
    return e.select(F.col("event_id").alias("edge_id"), F.col("user_id").alias("src"), "dst", F.col("event_type").alias("edge_type"), (F.col("value") / 100).alias("confidence"), "hour")


def sure_edges(spark: SparkSession, sf_dir: str, edge_type: str, least: float) -> DataFrame:
    """src, dst, confidence of the edges of one type and of at least that confidence. Less is shuffled for them than for edges(): no type, no hour, and no value below least, since such an event is only needed as the one that another leads to."""
    confidence, hour = F.col("value") / 100, F.date_trunc("hour", "ts")
    e = load(spark, sf_dir, "events").where(F.col("event_type") == edge_type).select(F.when(confidence >= least, confidence).alias("confidence"), "user_id", "event_id", "ts").repartition(hour)
    e = e.withColumn("dst", F.lead("user_id").over(Window.partitionBy(hour).orderBy("ts", "event_id"))).where(F.col("dst").isNotNull())
    return e.select(F.col("user_id").alias("src"), "dst", "confidence").where(F.col("confidence") >= least)


#: The same edges for the SQL side.
EDGES_SQL = """edges AS (SELECT event_id AS edge_id, user_id AS src, dst, event_type AS edge_type, value / 100 AS confidence, hour FROM
 (SELECT *, lead(user_id) OVER (PARTITION BY event_type, hour ORDER BY ts, event_id) AS dst FROM (SELECT *, date_trunc('hour', ts) AS hour FROM events)) WHERE dst IS NOT NULL)"""


def edges_sql() -> str:
    return EDGES_SQL


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, node_type, project_id, importance."""
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("node_type"), F.col("c_nationkey").alias("project_id"), F.col("c_acctbal").alias("importance"))


NODES_SQL = "nodes AS (SELECT c_custkey AS id, c_name AS name, lower(c_mktsegment) AS node_type, c_nationkey AS project_id, c_acctbal AS importance FROM customer)"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, qualified_name, node_type, project, size, weight."""
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("::", "p_brand", "p_name").alias("qualified_name"), F.col("p_type").alias("node_type"), F.col("p_brand").alias("project"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("weight")
    )


SYMBOLS_SQL = "symbols AS (SELECT p_partkey AS id, p_name AS name, p_brand || '::' || p_name AS qualified_name, p_type AS node_type, p_brand AS project, p_size AS size, p_retailprice AS weight FROM part)"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, at, symbol, change (added, modified, removed), signature, file, run. File f holds the symbols equal to f modulo 20; a run is a day."""
    e = load(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("modified")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("symbol"), kind.alias("change"), F.get_json_object("props", "$.k").alias("signature"),
        F.concat(F.lit("src/file"), (F.col("user_id") % 20).cast("string"), F.lit(".fan")).alias("file"), F.date_trunc("day", "ts").alias("run"), F.col("event_type").alias("kind"),
    )


CHANGES_SQL = """changes AS (SELECT event_id AS id, ts AS occurred, user_id AS symbol, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'modified' END AS change,
 json_extract_string(props, '$.k') AS signature, 'src/file' || (user_id % 20)::VARCHAR || '.fan' AS file, date_trunc('day', ts) AS run, event_type AS kind FROM events)"""


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child of the tree region > nation > customer > order, nation > supplier. Ids are kind:key."""
    n, c, s, o = (load(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "orders"))
    key = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    return (
        n.select(key("region", "n_regionkey").alias("parent"), key("nation", "n_nationkey").alias("child"))
        .union(c.select(key("nation", "c_nationkey"), key("customer", "c_custkey")))
        .union(s.select(key("nation", "s_nationkey"), key("supplier", "s_suppkey")))
        .union(o.select(key("customer", "o_custkey"), key("order", "o_orderkey")))
    )


CONTAINMENT_SQL = """tree AS (SELECT 'region:' || n_regionkey AS parent, 'nation:' || n_nationkey AS child FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
 UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders)"""
