"""Sinks: graph tables, vector upserts, export formats, builds beside the live table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, partition: str = "project_id") -> None:
    """Nodes and edges once each, a folder for each project, so that a project's queries read its folder alone."""
    nodes.dropDuplicates(["id"]).repartition(partition).write.mode("overwrite").partitionBy(partition).parquet(f"{path}/nodes")
    edges.dropDuplicates(["src", "dst", "edge_type", "line"]).repartition(partition).write.mode("overwrite").partitionBy(partition).parquet(f"{path}/edges")


def upsert_vectors(spark: SparkSession, path: str, new: DataFrame, key: str = "node_id", partition: str = "project_id") -> None:
    """Rows of new replace those of equal key; only the partitions that new touches are written again. All rows of a node are replaced together."""
    touched = new.select(partition).distinct()
    old = spark.read.parquet(path).join(F.broadcast(touched) if touched.count() < 10_000 else touched, partition, "left_semi")
    merged = old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
    side = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    merged.write.partitionBy(partition).parquet(side)  # a table can't be read and overwritten in one plan
    spark.read.parquet(side).repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def build_beside(df: DataFrame, path: str) -> str:
    """Writes df to a new slot below path and returns the slot; promote() makes it the live one."""
    slot = f"{path.rstrip('/')}/slot={uuid.uuid4().hex}"
    df.write.parquet(slot)
    return slot


def promote(spark: SparkSession, path: str, slot: str) -> None:
    spark.createDataFrame([(slot,)], "slot string").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/live")


def live(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(spark.read.schema("slot string").json(f"{path.rstrip('/')}/live").first()["slot"])


def export_lines(nodes: DataFrame, edges: DataFrame, form: str) -> DataFrame:
    """part (0 nodes, 1 edges), ord, line: the lines of an export in form dot, json, d3 or cytoscape; a file is their text in order. Edges count once by (src, dst, edge_type)."""
    e = edges.select("src", "dst", "edge_type").distinct()
    text = lambda c: F.col(c).cast("string")
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(text(c), r'(["\\])', r"\\$1"), F.lit('"'))
    if form == "dot":
        n_line = F.concat(F.lit("  "), quote("id"), F.lit(" [label="), quote("name"), F.lit("];"))
        e_line = F.concat(F.lit("  "), quote("src"), F.lit(" -> "), quote("dst"), F.lit(" [label="), quote("edge_type"), F.lit("];"))
    elif form in ("json", "d3"):
        n_line = F.to_json(F.struct("id", "name", F.col("node_type").alias("group" if form == "d3" else "type")))
        e_line = F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_type").alias("type")))
    elif form == "cytoscape":
        n_line = F.to_json(F.struct(F.struct("id", F.col("name").alias("label"), F.col("node_type").alias("type")).alias("data")))
        e_line = F.to_json(F.struct(F.struct(F.concat_ws("-", text("src"), text("dst"), "edge_type").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_type").alias("label")).alias("data")))
    else:
        raise ValueError(f"not an export form: {form}")
    n = nodes.select(F.lit(0).alias("part"), F.lpad(text("id"), 20, "0").alias("ord"), n_line.alias("line"))
    return n.union(e.select(F.lit(1), F.concat_ws(":", F.lpad(text("src"), 20, "0"), F.lpad(text("dst"), 20, "0"), "edge_type"), e_line))
