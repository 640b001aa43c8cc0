"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Every window of consecutive item words is a pattern, in which a word stands as a short code from the items'
own vocabulary; each document is normalised, read off in the same codes and scanned once, and matches are
mapped back to offsets of the original text.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.common import WORD, by_bytes, char_offsets, durable, release, table, word_bounds, words_of

#: Words in a window, and the item words that one automaton may hold; more items make further automata, each of which
#: scans the texts in a pass of its own. A word of an item costs about 2 KB: up to three nodes for each word of a window.
WINDOW = 10
AUTOMATON_WORDS = 250_000
#: Characters that one place of a word's code can have.
DIGITS = 64
_built: dict = {}


def windows_of(raw: bytes, window: int) -> list[list[bytes]]:
    """The windows of an item: its runs of window words, or all its words where it has fewer."""
    w = words_of(raw)
    return [w[i : i + window] for i in range(max(1, len(w) - window + 1))] if w else []


def build(items: list[tuple[int, bytes]], window: int):
    """(code by word, characters of a code, automaton with values (words in the pattern, item ids)); None without patterns.

    Every word of the items has a code of a few characters, each place of it with DIGITS characters of its own:
    nodes have few children, and no match begins or ends inside a code.
    """
    vocabulary = dict.fromkeys(x for _, raw in items for x in words_of(raw))
    width = 1
    while DIGITS**width < len(vocabulary):
        width += 1
    codes = {w: "".join(chr(1 + p * DIGITS + i // DIGITS**p % DIGITS) for p in range(width)) for i, w in enumerate(vocabulary)}
    found: dict[str, set] = {}
    for item, raw in items:
        for w in windows_of(raw, window):
            found.setdefault("".join([codes[x] for x in w]), set()).add(item)
    if not found:
        return None
    a = ahocorasick.Automaton()
    for key, ids in found.items():
        a.add_word(key, (len(key) // width, tuple(ids)))
    a.make_automaton()
    return codes, width, a


def scan(raw: bytes, built) -> tuple[int, set, list[tuple[int, int, int, int]]]:
    """Words of a text, items met, and the hit passages: first and last word, start and end code point of the text as it was (ends exclusive)."""
    words = words_of(raw)
    if not words or built is None:
        return len(words), set(), []
    codes, width, automaton = built
    get, unknown = codes.get, "\0" * width
    items: set = set()
    step = None
    for at, (n, ids) in automaton.iter("".join([get(w, unknown) for w in words])):
        if step is None:
            step = np.zeros(len(words) + 1, dtype=np.int64)
        end = (at + 1) // width
        step[end - n] += 1
        step[end] -= 1
        items.update(ids)
    if step is None:
        return len(words), items, []
    edge = np.diff(np.concatenate(([0], (np.cumsum(step[:-1]) > 0).view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    starts, ends = word_bounds(raw)
    return len(words), items, list(zip(first.tolist(), last.tolist(), char_offsets(raw, starts[first]).tolist(), char_offsets(raw, ends[last - 1]).tolist(), strict=True))


def merged(passages: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Passages of several scans as one list: those that overlap or touch are one."""
    out: list[tuple[int, int, int, int]] = []
    for w0, w1, c0, c1 in sorted(passages):
        if out and w0 <= out[-1][1]:
            if w1 > out[-1][1]:
                out[-1] = (out[-1][0], w1, out[-1][2], c1)
        else:
            out.append((w0, w1, c0, c1))
    return out


_PASSAGE = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("w0", "w1", "c0", "c1")]))
_PASSAGE_ARROW = pa.list_(pa.struct([(k, pa.int64()) for k in ("w0", "w1", "c0", "c1")]))
_ITEMS = T.ArrayType(T.StringType())


def _scanned(rows: DataFrame, block: list[tuple], window: int, hits_only: bool) -> DataFrame:
    """rows (its last column is the text as bytes) with n_words, items and passages instead of the text; the rows with hits alone, if asked."""
    key, shared = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(block)
    fields = list(rows.schema)[:-1]
    at = len(fields)

    def run(batches):
        if key not in _built:  # a worker keeps the automaton of one pass
            _built.clear()
            _built[key] = build(shared.value, window)
        for batch in by_bytes(batches, at):
            found = [scan(x or b"", _built[key]) for x in batch.column(at).to_pylist()]
            items = [[*sorted(str(x) for x in f[1] if x is not None), *([None] if None in f[1] else [])] for f in found]
            passages = [[{"w0": p[0], "w1": p[1], "c0": p[2], "c1": p[3]} for p in f[2]] for f in found]
            out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), pa.array([f[0] for f in found], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(passages, _PASSAGE_ARROW)], names=[*(f.name for f in fields), "__n", "__items", "__passages"])
            yield out.filter(pa.array([bool(f[2]) for f in found], pa.bool_())) if hits_only else out

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("__n", T.LongType()), T.StructField("__items", _ITEMS), T.StructField("__passages", _PASSAGE)]))


def _together(rows: DataFrame) -> DataFrame:
    """rows with the lists of passages and items in __all merged into __items and __passages."""
    fields = [f for f in rows.schema if f.name not in ("__all",)]
    names, at = [f.name for f in fields], rows.columns.index("__all")
    kept = [rows.columns.index(n) for n in names]

    def run(batches):
        for b in batches:
            items, passages = [], []
            for scans in b.column(at).to_pylist():
                met = {x for s in scans for x in s["items"]}
                items.append([*sorted(x for x in met if x is not None), *([None] if None in met else [])])
                passages.append([dict(zip(("w0", "w1", "c0", "c1"), p, strict=True)) for p in merged([tuple(p.values()) for s in scans for p in s["passages"]])])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(items, pa.list_(pa.string())), pa.array(passages, _PASSAGE_ARROW)], names=[*names, "__items", "__passages"])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("__items", _ITEMS), T.StructField("__passages", _PASSAGE)]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None, automaton_words: int = AUTOMATON_WORDS, unnamed: bool = True) -> DataFrame:
    """One row per row of docs: the columns of keep (the id by default), n_words, n_hit, items, hit_spans.

    items: ids, as sorted strings, of items of which a window occurs. hit_spans: the hit passages as
    [start, end) code points of the original text. A text or item that is null or without words has no
    window. Windows of items whose id is null hit as any other, and all of these items together are one
    null at the end of items; without unnamed they are left out. Repeated rows each get their row; items
    sharing an id count once; an empty benchmark hits nothing; columns outside keep are not read, whatever
    their names.

    The words of the test set are counted first and decide the number of automata. Each takes one pass over
    the texts and is the only one that the driver and a worker hold meanwhile; what the passes after the
    first one find, a few rows, is written, and joined by the text's digest at the end. An item of more than
    automaton_words has an automaton of its own.
    """
    keep = keep or [id_col]
    names = [c for c in keep if c not in ("n_words", "n_hit", "items", "hit_spans")]
    rows = docs.select(*names, F.col(text_col).cast("binary").alias("__raw"))
    items = benchmark.where(F.col(item_text_col).isNotNull() & (F.col(item_col).isNotNull() | F.lit(unnamed))).select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.regexp_count(F.lower("text"), F.lit(WORD)).cast("long"))).first()[0] or 0
    n = -(-total // automaton_words) or 1
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))

    def block(i: int) -> list[tuple]:
        return [(r[0], r[1].encode()) for r in items.where(part == i).toLocalIterator()]

    if n == 1:
        found = _scanned(rows, block(0), window, False)
    else:
        marked = docs.select(*names, F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("__mark"), F.col(text_col).cast("binary").alias("__raw"))
        base = durable(_scanned(marked, block(0), window, False), "scanned")
        texts = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("__mark"), F.col(text_col).cast("binary").alias("__raw"))
        hits = [base.select("__mark", "__items", "__passages").where(F.size("__passages") > 0)]
        hits += [durable(_scanned(texts, block(i), window, True).drop("__n").dropDuplicates(["__mark"]), "hits") for i in range(1, n)]
        every = hits[0].dropDuplicates(["__mark"])
        for h in hits[1:]:
            every = every.unionByName(h)
        # a row for each different text with hits, of as many scans as there are automata
        every = every.groupBy("__mark").agg(F.collect_list(F.struct(F.col("__items").alias("items"), F.col("__passages").alias("passages"))).alias("__all"))
        once = durable(_together(every), "hits")
        release(*hits[1:])
        found = base.drop("__items", "__passages").join(once, "__mark", "left")
        found = found.withColumns({"__items": F.coalesce("__items", F.array().cast(_ITEMS)), "__passages": F.coalesce("__passages", F.array().cast(_PASSAGE))})
    span = F.transform("__passages", lambda p: F.struct(p["c0"].alias("start"), p["c1"].alias("end")))
    hit = F.aggregate("__passages", F.lit(0).cast("long"), lambda acc, p: acc + p["w1"] - p["w0"])
    return found.select(*names, F.col("__n").alias("n_words"), hit.alias("n_hit"), F.col("__items").alias("items"), span.alias("hit_spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT g.r, g.i, g.n, p.item_id FROM g JOIN p ON g.n = p.n AND g.g = p.g),
hw AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""

QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES = {"op2_decontaminate": ORACLE}
