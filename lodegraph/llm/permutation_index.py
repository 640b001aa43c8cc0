"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots. Vectors of one nearest pivot are a cell;
a shard holds some small cells or a part of a large one, and posts its vectors in one inverted file per
pivot, each posting with the pivot's place in the vector's order. A query goes to the shards of the cells
whose pivots are near enough to it, walks the files of its own pivots there, ranks the vectors of those cells
by footrule distance and reranks the best of them by true cosine.

Footrule with absent pivots at place L + 1 is a constant minus twice the sum over shared pivots of
L + 1 - max(place in the query, place in the vector), so postings hold L + 1 - place and a query adds up minima.

Pivots are fitted on a bounded sample; every valid row is indexed. Queries and rows meet in blocks of
bounded size, so memory per task does not grow with the table. How much of the index a query reads depends
on the data: where vectors crowd, few cells; among directions drawn at random, which no index tells apart,
about three quarters. What is reranked is a few percent of each shard either way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import durable, table

#: Pivots, length of the kept order, rows in the sample that pivots are chosen from.
PIVOTS, PREFIX, SAMPLE = 256, 96, 4096
#: Rows of a shard, queries of a block; the share of a shard's different vectors that is reranked and its least number.
SHARD_ROWS, BLOCK_QUERIES, RERANK_SHARE, RERANK_LEAST = 8192, 16384, 0.04, 192
#: How far below the cosine of a query's second nearest pivot that of a cell's pivot may lie for the cell to be read.
PROBE_MARGIN = 0.42


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, v: array<double>) whose vector has a direction: not null, no null or non-finite component, not zero."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def cosines(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Cosines of rows to pivots of unit length."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T


def orders(cos: np.ndarray, prefix: int) -> np.ndarray:
    """For each row the ids of its nearest pivots, nearest first."""
    return np.argsort(-cos, axis=1, kind="stable")[:, :prefix].astype(np.uint8)


def probed(cos: np.ndarray, margin: float) -> np.ndarray:
    """For each row which cells it reads."""
    if cos.shape[1] < 2:
        return np.ones(cos.shape, dtype=bool)
    return cos >= np.partition(cos, -2, axis=1)[:, -2:-1] - margin


def bundle(cells: dict[int, int], pivots: int, shard_rows: int) -> list[tuple[int, int]]:
    """(first shard, shards) of each cell: small cells share a shard of about shard_rows, in their order; a larger one is dealt to several."""
    out, shard, held = [], 0, 0
    for c in range(pivots):
        n = cells.get(c, 0)
        parts = max(1, -(-n // shard_rows))
        if held and (parts > 1 or held + n > shard_rows):
            shard, held = shard + 1, 0
        out.append((shard, parts))
        held += n
        if parts > 1:
            shard, held = shard + parts, 0
    return out


def choose_pivots(sample: np.ndarray, n: int, apart: float = 0.6) -> np.ndarray:
    """n rows of a sample of unit vectors, in a fixed random order, passing over rows whose cosine to a chosen one exceeds apart as long as others are left: a crowd of like vectors gives one pivot, not many."""
    order = sample[np.random.default_rng(20).permutation(len(sample))]
    nearest_, chosen = np.full(len(order), -1.0), []
    for limit in (apart, 0.9, 2.0):
        for i in range(len(order)):
            if len(chosen) == n:
                break
            if nearest_[i] <= limit:
                chosen.append(i)
                nearest_ = np.maximum(nearest_, order @ order[i])
                nearest_[i] = 3.0
    return order[chosen]


class Shard:
    """The inverted files of some rows. Equal vectors are one entry with all their ids, so copies take no place from others."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, perm: np.ndarray, pivots: int):
        self.prefix = perm.shape[1]
        raw = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
        _, first, group = np.unique(raw, return_index=True, return_inverse=True)
        by = np.lexsort((ids, group.ravel()))
        self.ids, self.begin = ids[by], np.searchsorted(group.ravel()[by], np.arange(len(first) + 1))
        self.rows = x[first] / np.abs(x[first]).max(axis=1, keepdims=True)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.rows, self.rows))
        self.cell = perm[first, 0]
        flat = perm[first].ravel()
        order = np.argsort(flat, kind="stable")
        row, weight = (order // self.prefix).astype(np.int32), (self.prefix - order % self.prefix).astype(np.uint16)
        cut = np.searchsorted(flat[order], np.arange(pivots + 1))
        self.files = [(row[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """prefix * (prefix + 1) / 2 less half the footrule distance to each entry, added up from the postings of a query's pivots."""
        near = np.zeros(len(self.rows), dtype=np.uint16)
        for place, p in enumerate(order):
            rows, weight = self.files[p]
            near[rows] += np.minimum(weight, self.prefix - place)
        return near

    def search(self, qid: int, q: np.ndarray, order: np.ndarray, cells: np.ndarray, k: int, share: float, least: int) -> list[tuple]:
        """(query, id, cosine) of the k best reranked entries' ids, of the cells given. Sums run in the same order for equal vectors, so they tie."""
        rows = np.flatnonzero(cells[self.cell])
        near = self.nearness(order)[rows]
        n = max(least, int(np.ceil(share * len(self.rows))))
        best = rows[np.argpartition(near, len(near) - n)[len(near) - n :]] if n < len(near) else rows
        a = q / np.abs(q).max()
        score = np.clip(np.einsum("ij,j->i", self.rows[best], a) / (self.norms[best] * np.sqrt(a @ a)), -1.0, 1.0)
        # one entry may hold nothing but the query itself, hence one more
        floor = np.partition(score, len(score) - k - 1)[len(score) - k - 1] if len(score) > k + 1 else -2.0
        found = []
        for j in np.flatnonzero(score >= floor):
            mine, taken = self.ids[self.begin[best[j]] : self.begin[best[j] + 1]], 0
            last = None
            for i in mine.tolist():
                if i != qid and i != last:
                    found.append((qid, i, float(score[j])))
                    last, taken = i, taken + 1
                    if taken == k:
                        break
        found.sort(key=lambda r: (-r[2], r[1]))
        return found[:k]


def nearest(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
    share: float = RERANK_SHARE, least: int = RERANK_LEAST, margin: float = PROBE_MARGIN,
) -> DataFrame:
    """query_id, rank, id, score: the k nearest found for every row whose id meets is_query (a function of the id column).

    Ids are whole numbers. Vectors that are null, zero or hold null or non-finite components take no part,
    nor do vectors whose length differs from the table's commonest (the larger, if tied). Equal scores go
    to the smaller id; rows that repeat an id count once, at their best score; a query never returns its
    own id. Fewer than k candidates give fewer rows; an empty table gives none. Other columns are not read.
    """
    pivots = min(pivots, 256)
    all_rows = valid_vectors(vectors, id_col, vec_col)
    dims = all_rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id bigint, id bigint, score double"
    if dims is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double").withColumnRenamed("id", id_col)
    rows = all_rows.where(F.size("v") == dims["d"]).select(F.col("id").cast("long").alias("id"), "v")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
    s = np.array(sample["v"].tolist())
    s /= np.abs(s).max(axis=1, keepdims=True)
    s = np.unique(s / np.linalg.norm(s, axis=1, keepdims=True), axis=0)
    chosen = choose_pivots(s, pivots)
    n_pivots, prefix = len(chosen), min(prefix, len(chosen))

    def place(batches):
        for b in batches:
            if len(b):
                perm = orders(cosines(np.array(b["v"].tolist()), chosen), prefix)
                yield b.assign(perm=[p.tobytes() for p in perm], cell=perm[:, 0].astype(np.int32))

    placed = durable(rows.mapInPandas(place, "id bigint, v array<double>, perm binary, cell int"), "placed")
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row for each pivot
    homes = bundle(counts, n_pivots, shard_rows)
    n_queries = placed.where(is_query(F.col("id"))).count()
    n_blocks = max(1, -(-n_queries // block_queries))
    home = F.element_at(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in homes)), F.col("cell") + 1)
    index = placed.withColumn("shard", (home["a"] + F.pmod(F.xxhash64("id"), home["n"].cast("long"))).cast("int")).drop("cell")

    def route(batches):
        for b in batches:
            if len(b):
                reads = probed(cosines(np.array(b["v"].tolist()), chosen), margin)
                yield b.drop(columns="cell").assign(cells=[np.packbits(r).tobytes() for r in reads], shard=[sorted({x for c in np.flatnonzero(r) for x in range(homes[c][0], homes[c][0] + homes[c][1])}) for r in reads])

    routed = placed.where(is_query(F.col("id"))).mapInPandas(route, "id bigint, v array<double>, perm binary, cells binary, shard array<int>")
    asked = routed.withColumn("shard", F.explode("shard")).withColumn("block", F.pmod(F.xxhash64("id", F.lit("q")), F.lit(n_blocks)).cast("int"))

    def search(index_rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(index_rows) and len(queries):
            unpack = lambda d: np.frombuffer(b"".join(d["perm"]), dtype=np.uint8).reshape(len(d), prefix)
            shard = Shard(index_rows["id"].to_numpy(), np.array(index_rows["v"].tolist()), unpack(index_rows), n_pivots)
            for qid, v, order, cells in zip(queries["id"], queries["v"], unpack(queries), queries["cells"], strict=True):
                mine = np.unpackbits(np.frombuffer(cells, dtype=np.uint8))[:n_pivots].astype(bool)
                found += shard.search(int(qid), np.asarray(v, dtype=np.float64), order, mine, k, share, least)
        return pd.DataFrame(found, columns=["query_id", "id", "score"])

    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, schema)
    best = pairs.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    # a window that stops at k rows: each task keeps the k best of a query before they meet
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


QUERIES = {"op1_permutation_index": op1_permutation_index}
ORACLES: dict[str, str] = {}
