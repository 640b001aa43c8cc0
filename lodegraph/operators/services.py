"""What search services put together from the legs: routing, scores, merges, samples, evidence and cards.

Query words are parameters; scores are column expressions over the columns given, so callers pick the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values. Tiers of a documentation hit: whole name, prefix, part, qualified name, description; both words met.
DOC_TIERS, DOC_BOTH = (2.0, 1.5, 1.0, 0.8, 0.5), 1.0
#: Merge of two backends; unified search's text and graph weights and floor.
MERGE_WEIGHTS, UNIFIED_WEIGHTS, UNIFIED_FLOOR = (0.6, 0.4), (0.4, 0.2), 0.3
#: Versioned ranking: text, version, source, completeness. Project search: whole name, prefix, part, pod, path, description.
RANK_WEIGHTS, PROJECT_TIERS = (0.4, 0.25, 0.2, 0.15), (1.0, 0.9, 0.7, 0.6, 0.5, 0.3)

#: Candidates that are reranked, and the floor of their pool.
RERANKED, POOL_FLOOR = 50, 0.1


def flag(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


# --- queries ------------------------------------------------------------------------------------


def query_shape(text: Column) -> Column:
    """(tokens, phrase, operators, wildcard, backend) of a query: full text where it has quotes, stars or capital operators, memory for one or two words, else both."""
    n = F.size(F.filter(F.split(F.lower(F.regexp_replace(text, r"\s+", " ")), " "), lambda x: x != ""))
    phrase, operators, wildcard = text.contains('"'), text.rlike(r"\b(AND|OR|NOT)\b"), text.contains("*")
    backend = F.when(phrase | wildcard | operators, "fts").when(n <= 2, "memory").otherwise("both")
    return F.struct(n.alias("tokens"), phrase.alias("phrase"), operators.alias("operators"), wildcard.alias("wildcard"), backend.alias("backend"))


def begin_all(tokens: Column, words: list[str]) -> Column:
    """Whether for every word some token begins with it."""
    return reduce(lambda a, b: a & b, (F.exists(tokens, (lambda w: lambda t: t.startswith(w))(w)) for w in words))


def with_retry(rows: DataFrame, column: str, text: str, ending: str = r"[-_.]?(jsx?|tsx?|mjs)$") -> DataFrame:
    """rows that contain text, retry 0; where there is none, those that contain it without a library's file ending, retry 1."""
    import re

    first = rows.where(F.col(column).contains(text)).withColumn("retry", F.lit(0))
    bare = re.sub(ending, "", text)
    if bare == text:
        return first
    again = rows.where(F.col(column).contains(bare)).withColumn("retry", F.lit(1))
    return first.union(again.join(F.broadcast(first.limit(1).select(F.lit(1).alias("__some"))), F.lit(True), "left_anti"))  # one row at most


# --- scores -------------------------------------------------------------------------------------


def doc_relevance(name: Column, qualified: Column, query: str, pod: str) -> tuple[Column, Column]:
    """(score, label) of a documentation entry: whole name, its first word, its last word; more in the pod asked for."""
    words = query.lower().split()
    n = F.lower(name)
    base = F.when(n == query.lower(), 2.0).when(n.startswith(words[0]), 1.5).when(n.contains(words[-1]), 1.0).otherwise(0.5)
    score = F.least(base + flag(F.lower(qualified).contains(pod.lower()), 0.8), F.lit(3.0))
    return score, F.when(score >= 2, "exact").when(score >= 1.5, "high").when(score >= 1, "medium").otherwise("low")


def doc_keyword_score(name: Column, qualified: Column, description: Column, query: str) -> Column:
    """The sum of each word's best tier, and a bonus where several words are all met."""
    n, q, d = F.lower(name), F.lower(qualified), F.lower(description)
    tiers = [F.when(n == w, DOC_TIERS[0]).when(n.startswith(w), DOC_TIERS[1]).when(n.contains(w), DOC_TIERS[2]).when(q.contains(w), DOC_TIERS[3]).when(d.contains(w), DOC_TIERS[4]).otherwise(0.0) for w in query.lower().split()]
    met = reduce(lambda a, b: a & b, (t > 0 for t in tiers))
    return reduce(lambda a, b: a + b, tiers) + (flag(met, DOC_BOTH) if len(tiers) > 1 else F.lit(0.0))


def source_score(source: Column, scores: dict[str, float], other: float = 0.5) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in scores.items() for x in kv)), source), F.lit(other))


def version_score(version: Column, asked: Column) -> Column:
    """The version asked for, an older one, a newer one. Both compare as they are: numbers, or arrays of parts."""
    return F.when(version == asked, 1.0).when(version < asked, 0.7).otherwise(0.0)


def completeness(*parts: tuple[Column, float]) -> Column:
    """The sum of what each part that is there counts."""
    return reduce(lambda a, b: a + b, (flag(c, x) for c, x in parts))


def ranked_score(text: Column, version: Column, source: Column, complete: Column) -> Column:
    return F.round(sum((w * c for w, c in zip(RANK_WEIGHTS, (text, version, source, complete), strict=True)), F.lit(0.0)), 2)


def best_of(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The limit best of rows (id, key, score), one of each key."""
    best = rows.groupBy(key).agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), "id")).alias("b")).select(key, "b.id", "b.score")
    return best.orderBy(F.desc("score"), key).limit(limit)


def graph_leg_score(callers: Column, callees: Column) -> Column:
    return 0.7 * F.least(F.lit(1.0), F.coalesce(callers, F.lit(0)) / 20.0) + 0.3 * F.least(F.lit(1.0), F.coalesce(callees, F.lit(0)) / 30.0)


def min_max(rows: DataFrame, value: str, by: list[str], into: str = "score") -> DataFrame:
    """value between the least and largest of its group, as 0 to 1; 1 in a group of equal values."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return rows.join(ends, by).withColumn(into, F.when(F.col("__hi") == F.col("__lo"), 1.0).otherwise((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))).drop("__lo", "__hi")


def by_mode(hits: DataFrame, mode: str = "vector", limit: int = 20, floor: float = 0.0, rerank: Column | None = None, gathered: bool = False) -> DataFrame:
    """query_id, id, score, rank, degraded: what a search gives in its mode. hits: query_id, id, score, rank by vectors.

    vector: the first ones over the floor. rerank, rlm: of the first 50 (or limit, if that is more) over 0.1,
    the best by rerank, scored from 0 to 1 within their query, or by their vectors where all are equal. What
    a mode lacks it does without, and degraded names it: no-reranker, else no-rlm.
    """
    if mode not in ("vector", "rerank", "rlm"):
        raise ValueError(f"no search mode: {mode!r}")
    plain = mode == "vector"
    pool = hits.where((F.col("rank") <= (limit if plain else max(limit, RERANKED))) & (F.col("score") >= (floor if plain else POOL_FLOOR)))
    lacks = None if plain else "no-reranker" if rerank is None else "no-rlm" if mode == "rlm" and not gathered else None
    if not plain and rerank is not None:
        w = Window.partitionBy("query_id")  # at most limit or 50 rows
        low, high = F.min("__r").over(w), F.greatest(F.max("__r").over(w), F.lit(1e-6))
        score = F.when(high == low, F.col("score")).otherwise((F.col("__r") - low) / (high - low))
        pool = pool.withColumn("__r", rerank.cast("double")).withColumns({"score": score, "rank": F.row_number().over(w.orderBy(F.desc("__r"), "rank"))})
    else:
        pool = pool.withColumn("rank", F.col("rank").cast("int"))
    return pool.where(F.col("rank") <= limit).select("query_id", "id", "score", "rank", F.lit(lacks).cast("string").alias("degraded"))


def project_score(query: str, name: Column, path: Column, pod: Column, description: Column) -> tuple[Column, Column]:
    """(score, matched_on) of a project; an empty query gives every project one half and nothing it matched on."""
    q = query.strip().lower()
    if not q:
        return F.lit(0.5), F.lit("")
    n, p, o, d = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, path, pod, description))
    by_name = F.when(n == q, PROJECT_TIERS[0]).when(n.startswith(q), PROJECT_TIERS[1]).when(n.contains(q), PROJECT_TIERS[2]).otherwise(0.0)
    score = F.greatest(by_name, flag(o.contains(q), PROJECT_TIERS[3]), flag(p.contains(q), PROJECT_TIERS[4]), flag(d.contains(q), PROJECT_TIERS[5]))
    return score, F.concat_ws(",", F.when(n.contains(q), "name"), F.when(o.contains(q), "podName"), F.when(p.contains(q), "path"), F.when(d.contains(q), "description"))


def sample_score(query: str, code: Column, context: Column, language: Column, preferred: tuple[str, ...]) -> Column:
    """The query in the code 2, in its context 1, a preferred language 0.5, ten lines or fewer 0.3."""
    q = query.lower()
    lines = F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))) + 1
    return F.round(flag(F.lower(code).contains(q), 2.0) + flag(F.lower(context).contains(q), 1.0) + flag(language.isin(*preferred), 0.5) + flag(lines <= 10, 0.3), 6)


def complexity_class(types: Column) -> Column:
    """simple, medium or complex by the types (array) of a function's parameters."""
    n = F.size(types)
    one = F.get(types, F.lit(0))
    hard = F.exists(types, lambda t: t.rlike(r"[|\[:{]"))
    return F.when((n == 0) | ((n == 1) & ~one.contains("|")), "simple").when((n >= 4) | hard, "complex").otherwise("medium")


# --- merges -------------------------------------------------------------------------------------


def merged_backends(fts: DataFrame, memory: DataFrame, weights: tuple[float, float] = MERGE_WEIGHTS, absent: int = 1000) -> DataFrame:
    """key, score, source of two ranked lists (key, rank): the larger of weight / rank, an absent rank counting absent."""
    j = fts.select("key", F.col("rank").alias("a")).join(memory.select("key", F.col("rank").alias("b")), "key", "full_outer")
    score = F.greatest(weights[0] / F.coalesce("a", F.lit(absent)), weights[1] / F.coalesce("b", F.lit(absent)))
    return j.select("key", F.round(score, 9).alias("score"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "fts").otherwise("memory").alias("source"))


def unified(text: DataFrame, graph: DataFrame, weights: tuple[float, float] = UNIFIED_WEIGHTS, floor: float = UNIFIED_FLOOR) -> DataFrame:
    """id, score of text (id, text_score) and graph (id, graph_score) together, from floor on."""
    score = F.round(weights[0] * F.coalesce("text_score", F.lit(0.0)) + weights[1] * F.coalesce("graph_score", F.lit(0.0)), 6)
    return text.join(graph, "id", "full_outer").select("id", score.alias("score")).where(F.col("score") >= floor)


def side_by_side(legs: dict[str, DataFrame]) -> DataFrame:
    """leg and the columns of all legs; what a leg lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("leg", F.lit(n)) for n, df in legs.items()))


def vector_and_text(vector: DataFrame, text: DataFrame) -> DataFrame:
    """id, score, both: hits by vector (id, score) and by text (id)."""
    j = vector.join(text.select("id", F.lit(True).alias("__t")), "id", "full_outer")
    return j.select("id", F.coalesce("score", F.lit(0.0)).alias("score"), (F.col("score").isNotNull() & F.col("__t").isNotNull()).alias("both"))


def search_statistics(log: DataFrame, hot_ms: float = 10.0, hot_share: float = 0.3) -> DataFrame:
    """backend, searches, mean_ms, hot: whether more than hot_share of its searches took less than hot_ms. log: backend, ms."""
    return log.groupBy("backend").agg(F.count("*").alias("searches"), F.round(F.avg("ms"), 6).alias("mean_ms"), (F.count_if(F.col("ms") < hot_ms) > hot_share * F.count("*")).alias("hot"))


# --- evidence -----------------------------------------------------------------------------------


def identifiers(rows: DataFrame, key: str, tokens: Column, least: int = 12) -> DataFrame:
    """key, w: the distinct tokens of at least so many characters."""
    return rows.select(key, F.explode(F.array_distinct(F.filter(tokens, lambda x: F.length(x) >= least))).alias("w"))


def identifier_gates(questions: DataFrame, key: str, asked: DataFrame, have: DataFrame) -> DataFrame:
    """key, wanted, found: how many identifiers of a question (asked: key, w) the evidence (have: w) holds; every question has a row."""
    j = asked.join(have.select("w").distinct().withColumn("hit", F.lit(1)), "w", "left").groupBy(key).agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return questions.select(key).join(j, key, "left").na.fill(0, ["wanted", "found"])


def coverage(rank: Column, score: Column, n: int) -> Column:
    """1 for the first of n, else 1 less the share of the way that its score lies from 1, clamped."""
    return F.when(rank <= 1, 1.0).otherwise(1 - F.least(F.greatest((1 - score) / (n - 1), F.lit(0.0)), F.lit(1.0)))


def evidence_header(symbol: Column, kind: Column, file: Column) -> Column:
    return F.concat(F.lit("### "), symbol, F.lit(" ("), kind, F.lit(") — "), file)


def parsed_header(header: Column) -> Column:
    """(symbol, kind, file) of an evidence block's header."""
    p = r"^### (.*?) \(([^)]*)\) — (.*)$"
    return F.struct(*(F.regexp_extract(header, p, i + 1).alias(n) for i, n in enumerate(("symbol", "kind", "file"))))


def cached_results(log: DataFrame, text: Column, id_col: str) -> DataFrame:
    """key, first_asked, hits: queries that read the same but for case, by their hash."""
    return log.select(F.sha2(F.lower(text), 256).alias("key"), F.col(id_col).alias("at")).groupBy("key").agg(F.min("at").alias("first_asked"), F.count("*").alias("hits"))


# --- cards and state ----------------------------------------------------------------------------


def card_targets(symbols: DataFrame, calls: DataFrame, wanted: Column, cap: int) -> DataFrame:
    """id, fan_in of the cap symbols that are called most, of those wanted. calls: id, a row for each call."""
    fan_in = calls.groupBy("id").agg(F.count("*").alias("fan_in"))
    return symbols.where(wanted).join(fan_in, "id").orderBy(F.desc("fan_in"), "id").limit(cap).select("id", "fan_in")


def first_related(edges: DataFrame, by: str, order: list[str], cap: int) -> DataFrame:
    """Distinct edges, the first cap of each node."""
    w = Window.partitionBy(by).orderBy(*order)
    return edges.distinct().withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


def within_ranges(claims: DataFrame, ranges: DataFrame, slack: int = 2) -> DataFrame:
    """file, line, ok: whether a claim (file, line) lies in its file's range (file, a, b) or slack lines beside it; false without a range."""
    near = F.col("line").between(F.col("a") - slack, F.col("b") + slack)
    return claims.join(ranges, "file", "left").select("file", "line", F.coalesce(near, F.lit(False)).alias("ok"))


def origin(**sources: Column) -> Column:
    """The name of the first source, in the order given, that holds a value; none without."""
    return F.coalesce(*(F.when(c.isNotNull(), n) for n, c in sources.items()), F.lit("none"))


def vector_plan(functions: DataFrame, stored: DataFrame, current: Column) -> DataFrame:
    """id, action (encode, keep, drop) of functions (id) against stored vectors (id and what current asks for)."""
    j = functions.select("id", F.lit(1).alias("__f")).join(stored.withColumn("__s", current), "id", "full_outer")
    return j.select("id", F.when(F.col("__f").isNull(), "drop").when(F.coalesce("__s", F.lit(False)), "keep").otherwise("encode").alias("action"))


def layout_status(rows: DataFrame, by: str, version: Column, current: int) -> DataFrame:
    """by, layout (older where any row's text version is below current), stale (such rows)."""
    g = rows.groupBy(by).agg(F.min(version).alias("__m"), F.count_if(version < current).alias("stale"))
    return g.select(by, F.when(F.col("__m") < current, "older").otherwise("current").alias("layout"), "stale")


def health(rows: DataFrame, by: str, labelled: Column, thin: float = 35.0) -> DataFrame:
    """by, documents, labelled, coverage (percent), state (empty, thin below so many percent, healthy)."""
    g = rows.groupBy(by).agg(F.count("*").alias("documents"), F.count(labelled).alias("labelled"))
    percent = 100.0 * F.col("labelled") / F.col("documents")
    return g.select(by, "documents", "labelled", F.round(percent, 2).alias("coverage"), F.when(F.col("labelled") == 0, "empty").when(F.col("labelled") * 100 < thin * F.col("documents"), "thin").otherwise("healthy").alias("state"))


def badges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, outgoing, incoming: distinct dependencies (src, dst) of every project (project)."""
    e = edges.select("src", "dst").distinct()
    out, into = e.groupBy(F.col("src").alias("project")).agg(F.count("*").alias("outgoing")), e.groupBy(F.col("dst").alias("project")).agg(F.count("*").alias("incoming"))
    return nodes.select("project").join(out, "project", "left").join(into, "project", "left").na.fill(0, ["outgoing", "incoming"])


def cascade(owned: dict[str, DataFrame]) -> DataFrame:
    """tbl, n: how many rows of each table go with what owns them."""
    return reduce(lambda a, b: a.union(b), (df.agg(F.lit(name).alias("tbl"), F.count("*").alias("n")) for name, df in owned.items()))


def merged_replies(replies: DataFrame, wanted: DataFrame, key: str, text: Column) -> DataFrame:
    """key, text: what a reply says of the ids asked for; what was not asked is dropped."""
    return replies.select(key, text.alias("text")).join(wanted.select(key).distinct(), key, "left_semi")
