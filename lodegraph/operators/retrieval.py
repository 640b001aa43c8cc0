"""Keyword, BM25 and vector retrieval, rank fusion and folding."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import settle

#: Rank fusion's constant, the weights of the legs, candidates from each leg, and BM25's parameters.
RRF_K, WEIGHTS, CANDIDATES, K1, B = 60, {"vector": 1.0, "keyword": 0.7, "bm25": 0.8}, 50, 1.2, 0.75

#: Fixed values. Text score of one word: whole name, whole qualified name, prefix, part, description.
ONE_WORD = (1.0, 0.9, 0.7, 0.5, 0.3)
#: Of each of many words: whole name, prefix, part (each with what a name hit adds), qualified name, description; share of words met; all met.
MANY_WORDS, SHARE_MET, ALL_MET = (0.65, 0.55, 0.45, 0.2, 0.1), 0.5, 0.3
#: Boosts of a symbol hit: whole name, prefix, part; each word met; all met.
NAME_BOOSTS, WORD_BOOST, ALL_WORDS_BOOST = (15.0, 8.0, 4.0), 2, 5.0
#: File endings that a query may carry; prefixes tried of a single word.
ENDINGS, PREFIXES = r"(?i)[-_.]?(jsx?|tsx?|vue|css|scss|mjs|cjs)$", (8, 4)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def top_k(df: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The first k rows in a total order, with rank; of each group where by names one."""
    if not by:
        df = df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf, dl. Term counts are taken within the row, so nothing is shuffled."""
    t = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("ts")).withColumn("dl", F.size("ts"))
    return t.select("id", "dl", F.explode("ts").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str, k1: float = K1, b: float = B) -> DataFrame:
    """id, score, normalised (by the best). Only the query's terms are counted in a document; idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    terms = query_terms(query)
    return bm25_scores(settle(text_counts(docs, id_col, text_col, terms)), len(terms), k1, b)


def query_terms(query: str) -> list[str]:
    return sorted({t.lower() for t in query.split()})


def text_counts(docs: DataFrame, id_col: str, text_col: str, terms: list[str], prefixes: tuple[str, ...] = (), keep: dict[str, Column] | None = None) -> DataFrame:
    """id, dl, tf0 .. (a term's count each), hits (tokens that begin with one of prefixes) and the columns of keep: a few numbers for each document, from one reading of its text."""
    ts = tokens(F.coalesce(F.col(text_col), F.lit("")))
    t = docs.select(F.col(id_col).alias("id"), ts.alias("ts"), *(c.alias(n) for n, c in (keep or {}).items()))
    begins = reduce(lambda x, y: lambda w: x(w) | y(w), ((lambda p: lambda w: w.startswith(p))(p) for p in prefixes), lambda w: F.lit(False))
    counts = [F.size(F.filter("ts", (lambda term: lambda x: x == F.lit(term))(term))).alias(f"tf{i}") for i, term in enumerate(terms)]
    hits = [F.size(F.filter("ts", begins)).alias("hits")] if prefixes else []
    return t.select("id", F.size("ts").alias("dl"), *counts, *hits, *(keep or {}))


def bm25_scores(t: DataFrame, terms: int, k1: float = K1, b: float = B) -> DataFrame:
    """id, score, normalised of the documents with a term. t: text_counts() of all documents, settled."""
    stats = t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(terms)))
    hit = t.where(reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in range(terms)))).crossJoin(F.broadcast(stats))  # one row of statistics
    part = lambda i: F.when(F.col(f"tf{i}") > 0, _weight(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("n"), F.col("dl"), F.col("avgdl"), k1, b)).otherwise(0.0)
    scored = hit.select("id", reduce(lambda x, y: x + y, (part(i) for i in range(terms))).alias("score"))
    best = scored.agg(F.max("score").alias("best"))  # one row
    return scored.crossJoin(F.broadcast(best)).select("id", "score", (F.col("score") / F.col("best")).alias("normalised"))


def _weight(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


@dataclass(frozen=True)
class Index:
    """An inverted index: postings (term, id, tf, dl) in files by ranges of terms, sorted by term, so that a search reads the parts that hold its terms; documents, and their mean length."""

    postings: DataFrame
    documents: int
    mean_length: float


def build_index(docs: DataFrame, id_col: str, text_col: str, path: str | None = None) -> Index:
    """Writes the index of docs, to path if given, else to the shared folder."""
    t = postings(docs, id_col, text_col).select("term", "id", "tf", "dl")
    # ids are part of the range, so that the postings of one very common term are dealt to several files
    dealt = t.repartitionByRange(F.col("term"), F.col("id")).sortWithinPartitions("term", "id")
    if path:
        dealt.write.mode("overwrite").parquet(path)
        kept = t.sparkSession.read.parquet(path)
    else:
        kept = settle(dealt)
    # every posting of a document holds its length; documents without a token count too
    n = docs.count()
    total = kept.groupBy("id").agg(F.first("dl").alias("dl")).agg(F.sum("dl")).first()[0] or 0
    return Index(kept, n, total / n if n else 0.0)


def search_index(index: Index, query: str) -> DataFrame:
    """id, score, normalised: BM25 of a query's terms from the postings alone."""
    hits = index.postings.where(F.col("term").isin(query_terms(query)))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
    scored = hits.join(F.broadcast(df), "term").select("id", _weight(F.col("tf"), F.col("df"), F.lit(index.documents), F.col("dl"), F.lit(index.mean_length)).alias("w")).groupBy("id").agg(F.sum("w").alias("score"))
    best = scored.agg(F.max("score").alias("best"))  # one row
    return scored.crossJoin(F.broadcast(best)).select("id", "score", (F.col("score") / F.col("best")).alias("normalised"))


def search_prefixes(index: Index, words: list[str]) -> DataFrame:
    """id, hits: documents that have, for every word, a term that begins with it; hits counts such tokens."""
    met = [index.postings.where(F.col("term").startswith(w)).groupBy("id").agg(F.sum("tf").alias(f"h{i}")) for i, w in enumerate(words)]
    every = reduce(lambda a, b: a.join(b, "id"), met)
    return every.select("id", reduce(lambda a, b: a + b, (F.col(f"h{i}") for i in range(len(words)))).alias("hits"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def exact_nearest(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """query_id, id, score, rank: the k rows of largest cosine for each query (id, v), itself left out. vectors: id, v.

    Rows and queries meet in blocks of bounded size, and each block keeps its k best, so what is shuffled
    grows with the number of blocks, not of pairs.
    """
    import numpy as np
    import pandas as pd

    n_rows, n_queries = vectors.count(), queries.count()
    nb, qb = max(1, -(-n_rows // block_rows)), max(1, -(-n_queries // block_rows))
    rows = vectors.select(F.col("id").alias("id"), F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("rb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    asked = queries.select(F.col("id").alias("query_id"), F.col("v").cast("array<double>").alias("qv"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(qb)).cast("int").alias("qb")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))

    def block(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(q):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        unit = lambda c: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(np.array(c.tolist()))
        ids, s = r["id"].to_numpy(), unit(q["qv"]) @ unit(r["v"]).T
        out = []
        for i, qid in enumerate(q["query_id"].to_numpy()):
            s[i, ids == qid] = -np.inf
            best = np.lexsort((ids, -np.round(s[i], 9)))[:k]
            out += [(qid, ids[j], s[i, j]) for j in best if s[i, j] > -np.inf]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    found = rows.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInPandas(block, "query_id bigint, id bigint, score double")
    return top_k(found, k, F.desc(F.round("score", 9)), F.col("id"), by=("query_id",))


def document_search(vectors: DataFrame, queries: DataFrame, limit: int = 10, floor: float = 0.5, where: Column | None = None) -> DataFrame:
    """query_id, id, score, rank: the nearest rows of each query at or over a floor, among those that a filter (on pod, type, instance, language...) lets through before any distance is taken."""
    among = vectors if where is None else vectors.where(where)
    return exact_nearest(among, queries, limit).where(F.col("score") >= floor)


def rrf(lists: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """key, score, best_rank, first_list, normalised. lists: name -> (key, rank), settled if they cost much: each is read twice.

    score = sum of weight / (k + rank); a key counts once in a list, at its first rank; normalised by what a
    key first in every list that has rows would score; ties by best rank, then key.
    """
    weights = weights or {}
    every = reduce(lambda a, b: a.union(b), (df.groupBy("key").agg(F.min("rank").alias("rank")).select("key", "rank", F.lit(i).alias("list"), F.lit(float(weights.get(n, 1.0))).alias("weight")) for i, (n, df) in enumerate(lists.items())))
    attainable = every.select("list", "weight").distinct().agg(F.sum(F.col("weight") / (k + 1)).alias("most"))
    fused = every.groupBy("key").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"), F.min("list").alias("first_list"))
    return fused.crossJoin(F.broadcast(attainable)).withColumn("normalised", F.col("score") / F.col("most")).drop("most")


def fold(hits: DataFrame, key: list[str], project: str, rank: str = "rank") -> DataFrame:
    """hits without the copies of other versions, with also_in: the projects, in rank order, whose copies a hit stands for.

    The first hit of a key leads; the first hit of each other project with that key is folded under it. Hits
    of the leading project, further ones of a folded project, and hits without a project or a key stay.
    """
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*key, project)))
    w = Window.partitionBy(*key).orderBy(rank)
    own = Window.partitionBy(*key, project).orderBy(rank)
    h = hits.where(known).withColumns({"lead": F.first(project).over(w), "place": F.row_number().over(w), "nth": F.row_number().over(own)})
    folded = (F.col(project) != F.col("lead")) & (F.col("nth") == 1)
    rest = h.where(folded).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(rank, project))).alias("r"))  # a row for each project of a key
    also = rest.select(*key, F.array_join(F.transform("r", lambda x: x[project].cast("string")), ",").alias("also"))
    heads = h.where(~folded).join(also, key, "left").withColumn("also_in", F.when(F.col("place") == 1, F.col("also")))
    return heads.select(*hits.columns, "also_in").unionByName(hits.where(~known).withColumn("also_in", F.lit(None).cast("string")))


def semantic_search(
    legs: dict[str, DataFrame], rows: DataFrame, related_to: DataFrame | None = None, weights: dict[str, float] | None = None, limit: int = 30, location: tuple[str, ...] = ("file", "line"), key: tuple[str, ...] = ("name",), project: str = "project", k_related: int = 3
) -> DataFrame:
    """key, score, normalised, best_rank, also_in, related and the columns of rows, for the limit best.

    legs: name -> (key, rank), each of a few dozen rows, fused by weighted reciprocal ranks. The hits get
    their rows (key and more), the best of each location stays, copies in other projects are folded, and the
    first limit get the first k_related ids that related_to (key, other, rank) has for them.
    """
    fused = rrf(legs, weights or WEIGHTS)
    hits = fused.withColumns({"score": F.round("score", 9), "normalised": F.round("normalised", 6)}).drop("first_list").join(rows, "key")
    order = F.struct(-F.col("score"), F.col("best_rank"), F.col("key"))
    placed = hits.groupBy(*location).agg(F.min_by(F.struct(*(c for c in hits.columns if c not in location)), order).alias("b")).select(*location, "b.*")
    ranked = placed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "best_rank", "key")))  # at most the legs' rows
    best = fold(ranked, list(key), project).orderBy("rank").limit(limit).drop("rank")
    if related_to is None:
        return best
    near = related_to.join(F.broadcast(best.select("key")), "key", "left_semi").where(F.col("rank") <= k_related)  # limit rows
    lists = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("r")).select("key", F.array_join(F.transform("r", lambda x: x["other"].cast("string")), ",").alias("related"))
    return best.join(lists, "key", "left")


def keyword_score(name: Column, qualified: Column, description: Column, query: str) -> Column:
    """The single- or many-word text score of an API element."""
    q, words = query.lower().strip(), query.lower().split()
    n, f, d = F.lower(name), F.lower(F.coalesce(qualified, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    if len(words) == 1:
        return F.when(n == q, ONE_WORD[0]).when(f == q, ONE_WORD[1]).when(n.startswith(q), ONE_WORD[2]).when(n.contains(q), ONE_WORD[3]).when(d.contains(q), ONE_WORD[4]).otherwise(0.0)
    flag = lambda c, x: F.when(c, x).otherwise(0.0)
    total, matched = F.lit(0.0), F.lit(0)
    for w in words:
        total = total + F.when(n == w, MANY_WORDS[0]).when(n.startswith(w), MANY_WORDS[1]).when(n.contains(w), MANY_WORDS[2]).otherwise(0.0) + flag(f.contains(w), MANY_WORDS[3]) + flag(d.contains(w), MANY_WORDS[4])
        matched = matched + F.when(n.contains(w) | f.contains(w) | d.contains(w), 1).otherwise(0)
    return total + matched / len(words) * SHARE_MET + flag(matched == len(words), ALL_MET)


def symbol_boosts(name: Column, class_name: Column, description: Column, query: str) -> Column:
    """What a symbol hit gains over its field scores: whole name, prefix, part; words met, all words met."""
    q, words = query.lower(), query.lower().split()
    n, c, d = F.lower(name), F.lower(F.coalesce(class_name, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    score = F.when(n == q, NAME_BOOSTS[0]).when(n.startswith(q), NAME_BOOSTS[1]).when(n.contains(q), NAME_BOOSTS[2]).otherwise(0.0)
    if len(words) > 1:
        met = reduce(lambda a, b: a + b, (F.when(n.contains(w) | c.contains(w) | d.contains(w), 1).otherwise(0) for w in words))
        score = score + met * WORD_BOOST + F.when(met == len(words), ALL_WORDS_BOOST).otherwise(0.0)
    return score


def field_scores(symbols: DataFrame, query: str, fields: dict[str, float]) -> DataFrame:
    """id, score, fields: for each query word and field, weight * (1 - i / n) for the i-th of n symbols by id that have a word with that prefix there."""
    words = list(dict.fromkeys(query.lower().split()))
    long = symbols.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), tokens(F.col(f)).alias("ts")) for f, w in fields.items()))).alias("x")).select("id", "x.field", "x.weight", "x.ts")

    def met(word: str) -> Column:
        return F.exists("ts", lambda t: t.startswith(word))

    hits = long.select("id", "field", "weight", F.explode(F.filter(F.array(*(F.when(met(w), F.lit(w)) for w in words)), lambda x: x.isNotNull())).alias("word"))
    # places by id: each range of ids is counted, and a row's place is the ranges before plus its place in its own
    hits = settle(hits.repartitionByRange(F.col("id")).withColumn("part", F.spark_partition_id()))
    per = hits.groupBy("word", "field", "part").agg(F.count("*").alias("c"))
    by = Window.partitionBy("word", "field")
    start = per.withColumns({"before": F.sum("c").over(by.orderBy("part")) - F.col("c"), "n": F.sum("c").over(by)}).drop("c")
    within = Window.partitionBy("word", "field", "part").orderBy("id")
    ranked = hits.withColumn("j", F.row_number().over(within) - 1).join(start, ["word", "field", "part"]).withColumn("i", F.col("before") + F.col("j"))
    return ranked.groupBy("id").agg(F.sum(F.col("weight") * (1 - F.col("i") / F.col("n"))).alias("score"), F.countDistinct("field").alias("fields"))


def query_variants(query: str) -> list[str]:
    """A query, then without file endings, then with identifiers split, then prefixes of a single word; six at most."""
    import re

    q = query.strip()
    words = q.split()
    bare = [re.sub(ENDINGS, "", w) for w in words]
    parts = [p for p in re.split(r"[-_./:]+|(?<=[a-z0-9])(?=[A-Z])", q) if len(p) >= 2]
    options = [q, " ".join(w for w in bare if len(w) >= 2) if bare != words else "", " ".join(parts) if len(parts) > len(words) else ""]
    if len(words) == 1:
        stem = bare[0] or words[0]
        options += [stem[:n] for n in range(min(len(stem) - 1, PREFIXES[0]), PREFIXES[1] - 1, -1)]
    return list(dict.fromkeys(o.strip() for o in options if o.strip()))[:6]


def callable_importance(callers: Column) -> Column:
    return F.when(callers <= 0, 0.1).otherwise(F.least(F.lit(1.0), 0.3 + 0.3 * F.log10(callers + 1)))


def combined_score(similarity: Column, importance: Column) -> Column:
    """What a hit of the vector leg is ranked by, to nine places, so that similarities of six never fall on a half."""
    return F.round(0.7 * similarity + 0.3 * importance, 9)


def type_importance(used_by: Column, contains: Column, extends: Column, implements: Column) -> Column:
    weight = 2 * used_by + contains + 3 * extends + 3 * implements
    return F.when(weight <= 0, 0.1).otherwise(F.least(F.lit(1.0), 0.2 + 0.3 * F.log10(weight + 1)))


def snippet(text: Column, terms: list[str], span: int = 60) -> Column:
    """The text about its first hit, with every hit marked."""
    import re

    pattern = "(?i)(" + "|".join(re.escape(t) for t in terms) + ")"
    at = F.least(*(F.when(F.instr(F.lower(text), F.lit(t.lower())) > 0, F.instr(F.lower(text), F.lit(t.lower()))).otherwise(2**31 - 1) for t in terms)) if len(terms) > 1 else F.instr(F.lower(text), F.lit(terms[0].lower()))
    return F.regexp_replace(F.substr(text, F.greatest(at - span // 2, F.lit(1)), F.lit(span)), pattern, "<mark>$1</mark>")
