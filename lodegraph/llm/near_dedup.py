"""Near-duplicate classes by BagMinHash signatures of word-shingle multisets.

Every (shingle, weight level) is a Poisson process of points on the line, and the processes of levels
above one are drawn by dyadic blocks (1, 2], (2, 4], (4, 8] ... whose points fall to a level of the block.
A text takes the points at levels up to the shingle's count; each point belongs to one component of the
signature, and a component's least point is its value. Two texts agree in a component with probability
sum(min counts) / sum(max counts), their weighted Jaccard similarity.

Signatures are banded; texts that share a band are candidates; candidates are verified by the overlap of
their multisets. Equal texts are folded before anything is paired. In a bucket all are verified against
one leader. Texts of a bucket that are then still in different classes are compared by their signatures, in
blocks of bounded size, and those that may reach the similarity are verified: first the likeliest partner
of each, then, for what is left apart, every one, in place, where two texts share their first band. So the
pairs of a large group are not written out, and a link between different texts is lost only by the chance of
the signatures: if two texts share no band, or agree in SLACK less of their components than their similarity.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import by_bytes, durable, release, table
from lodegraph.llm.word_hashes import chunks, mix, multisets, shingles

#: Words in a shingle, least similarity, bands and rows in a band.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 26, 5
#: Texts in a block, shingles in a block of texts with their multisets; how far below the similarity a share of equal components
#: still asks for verification (over four standard deviations of its error at 130 components).
BLOCK, BLOCK_ITEMS, SLACK = 4096, 1_000_000, 0.15
#: Rows of a group of buckets, and pairs looked at together, about.
GROUP_ROWS, PAIRS_AT_ONCE = 16384, 400_000


def _exponential(bits: np.ndarray) -> np.ndarray:
    return -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def bag_minhash(text: np.ndarray, item: np.ndarray, count: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Signatures (n_texts x m, float64; inf for texts without items) of the multisets (text, item, count)."""
    low = np.full((n_texts, m), np.inf)
    flat = low.ravel()
    owner, state, begin, width, weight = [text], [item], [np.zeros(len(item), dtype=np.int64)], [np.ones(len(item), dtype=np.int64)], [count]
    lo = 1
    while True:  # the blocks (lo, 2 lo] that a count reaches into
        reach = np.flatnonzero(count > lo)
        if not len(reach):
            break
        owner.append(text[reach])
        state.append(mix(item[reach] + np.uint64(lo)))
        begin.append(np.full(len(reach), lo))
        width.append(np.full(len(reach), lo))
        weight.append(count[reach])
        lo *= 2
    owner, state, begin, width, weight = (np.concatenate(a) for a in (owner, state, begin, width, weight))
    at = np.zeros(len(owner))
    k = 0
    while len(owner):
        draw = mix(state + np.uint64((2 * k + 1) * 0xD1342543DE82EF95 % 2**64))
        at = at + _exponential(draw) / width
        high = np.full(n_texts, np.inf)
        alive = np.unique(owner) if k else slice(None)
        high[alive] = low[alive].max(axis=1)
        keep = at < high[owner]
        owner, state, begin, width, weight, at, draw = (a[keep] for a in (owner, state, begin, width, weight, at, draw))
        if not len(owner):
            break
        other = mix(draw)
        level = begin + 1 + (other >> np.uint64(40)).astype(np.int64) % width  # the halving of a dyadic block, by its bits
        own = level <= weight
        np.minimum.at(flat, owner[own] * m + (other[own] & np.uint64(0xFFFFFFFF)).astype(np.int64) % m, at[own])
        k += 1
    return low


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band."""
    bits = mix(low.view(np.uint64))
    keys = np.zeros((len(low), bands), dtype=np.uint64)
    for b in range(bands):
        k = np.full(len(low), b + 1, dtype=np.uint64)
        for r in range(rows):
            k = mix(k ^ bits[:, b * rows + r])
        keys[:, b] = k
    return keys


def _digests(raws: list[bytes], s: np.ndarray, t: np.ndarray, count: np.ndarray) -> list[bytes]:
    """128 bits for each text: of its shingles in order, or of the text itself where it has no word."""
    bounds = np.searchsorted(t, np.arange(len(raws) + 1))
    return [hashlib.blake2b(s[a:b].tobytes() if c else raw, digest_size=16, person=b"words" if c else b"bytes").digest() for raw, a, b, c in zip(raws, bounds[:-1], bounds[1:], count, strict=True)]


def text_mark(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, n: int) -> DataFrame:
    """id, mark (a hash of the text as it is), digest, size (of the multiset), bands (keys; empty for texts without words), sig (16 bits of each component), a row for each row of docs."""

    def run(batches):
        for batch in by_bytes(batches, 2):
            raws = [x or b"" for x in batch.column(2).to_pylist()]
            digests, sizes, keys, sigs = [], [], [], []
            for part in chunks(raws):
                some = raws[part]
                s, t, count = shingles(some, n)
                digests += _digests(some, s, t, count)
                size = np.bincount(t, minlength=len(some)) if len(t) else np.zeros(len(some), dtype=np.int64)
                sizes += size.tolist()
                low = bag_minhash(*multisets(s, t, len(some)), len(some), bands * rows)
                k = band_keys(low, bands, rows).view(np.int64)
                sigs += [row.tobytes() for row in (mix(low.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)]
                keys += [row if c else [] for row, c in zip(k, count, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["id", "mark", "digest", "size", "bands", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_mark(text_col).alias("mark"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, f"id {kind}, mark bigint, digest binary, size bigint, bands array<bigint>, sig binary")


def expanded(needed: DataFrame, n: int) -> DataFrame:
    """digest and its multiset as a set: a shingle that occurs c times stands for c numbers. needed: digest, raw; rows whose text has another digest are passed over."""

    def run(batches):
        for batch in by_bytes(batches, 1):
            raws, asked = [x or b"" for x in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            digests, sets = [], []
            for part in chunks(raws):
                some = raws[part]
                s, t, count = shingles(some, n)
                found = _digests(some, s, t, count)
                text, item, c = multisets(s, t, len(some))
                nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) if len(c) else np.zeros(0, dtype=np.int64)
                values = mix(np.repeat(item, c) + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64)
                bounds = np.searchsorted(np.repeat(text, c), np.arange(len(some) + 1))
                for i, d in enumerate(found):
                    if d == asked[part.start + i]:
                        digests.append(d)
                        sets.append(values[bounds[i] : bounds[i + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "items"])

    return needed.mapInArrow(run, "digest binary, items array<bigint>").dropDuplicates(["digest"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""
    left = sets.select(F.col("digest").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("digest").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(right, "b").join(left, "a").where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges (a, b) but the roots. Alternates large and small stars till nothing but stars is left; hubs are joined, never gathered."""
    stars = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    files = max(1, stars.count() // 500_000)
    while True:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        old, stars = stars, durable(small, "stars", files)
        release(old)
        # done when no node hangs on two others or has another hang on it
        again = stars.select(F.col("a").alias("n")).union(stars.select(F.col("b").alias("n")).distinct()).groupBy("n").count().where("count > 1")
        if again.isEmpty():
            found = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
            found._lodegraph_path = stars._lodegraph_path
            return found


def _candidates(pdf, similarity: float, components_: int, rows: int):
    """Arrays (i, j, components that agree) of the pairs of rows of pdf that may be links: of one bucket, of different classes, of like sizes, signatures near enough, and not due in an earlier band. pdf is sorted by key; of two blocks, only pairs across are taken."""
    sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint16).reshape(len(pdf), components_)
    key, root, size, band, blk = (pdf[c].to_numpy() for c in ("key", "root", "size", "band", "blk"))
    across = pdf["ba"].iloc[0] != pdf["bb"].iloc[0]
    ends = np.searchsorted(key, key, side="right")
    partners_ = ends - np.arange(len(key)) - 1
    total = np.concatenate(([0], np.cumsum(partners_)))
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, side="right")) - 1)
        n = partners_[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
        at = to
        good = (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
        if across:
            good &= blk[i] != blk[j]
        i, j = i[good], j[good]
        for c in range(0, len(i), 50_000):
            ic, jc = i[c : c + 50_000], j[c : c + 50_000]
            equal = sig[ic] == sig[jc]
            same = equal.sum(axis=1)
            due = same >= (similarity - SLACK) * components_
            ic, jc, same, equal = ic[due], jc[due], same[due], equal[due]
            shared = equal.reshape(len(ic), components_ // rows, rows).all(axis=2)
            first = ~(shared & (np.arange(shared.shape[1])[None, :] < band[ic][:, None])).any(axis=1)
            if first.any():
                yield ic[first], jc[first], same[first]


def _sorted(pdf):
    import pandas as pd

    return pdf.assign(root=pd.factorize(pdf["root"])[0]).sort_values(["key", "digest"], kind="stable").drop_duplicates(["key", "digest"]).reset_index(drop=True)


def _pairs(digest: np.ndarray, pairs):
    import pandas as pd

    return pd.DataFrame([(min(digest[i], digest[j]), max(digest[i], digest[j])) for i, j in pairs], columns=["a", "b"])


def in_groups(split: DataFrame, blocks, groups: int) -> DataFrame:
    """split dealt to groups (grp, ba, bb) of whole buckets, large buckets in pairs of blocks, so that every two texts of a bucket meet once."""
    dealt = split.withColumn("blocks", blocks).withColumn("blk", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"ba": F.least("blk", "other"), "bb": F.greatest("blk", "other"), "grp": F.pmod(F.xxhash64("key"), F.lit(groups))}).drop("blocks", "other")


def partners(split: DataFrame, groups: int, similarity: float, components_: int, rows: int, block_texts: int = BLOCK) -> DataFrame:
    """a, b: the likeliest partner, by signatures, of each text of a bucket among those in other classes. split: key, band, digest, size, root, sig, n (texts in the bucket)."""

    def screen(pdf):
        pdf = _sorted(pdf)
        best, top = np.full(len(pdf), -1), np.full(len(pdf), -1)
        for i, j, same in _candidates(pdf, similarity, components_, rows):
            for x, y in ((i, j), (j, i)):
                by = np.lexsort((-y, same, x))  # the last of each x is its best
                last = by[np.concatenate((x[by][1:] != x[by][:-1], [True]))]
                over = last[same[last] > top[x[last]]]
                best[x[over]], top[x[over]] = y[over], same[over]
        return _pairs(pdf["digest"].to_numpy(), ((i, j) for i, j in enumerate(best) if j >= 0))

    dealt = in_groups(split.select("key", "band", "digest", "size", "root", "sig", "n"), F.ceil(F.col("n") / block_texts).cast("int"), groups).drop("n")
    return dealt.groupBy("grp", "ba", "bb").applyInPandas(screen, "a binary, b binary").distinct()


def remaining_links(split: DataFrame, sets: DataFrame, groups: int, similarity: float, components_: int, rows: int, block_texts: int, block_items: int, scratch: list[DataFrame]) -> DataFrame:
    """a, b: verified links that join all classes which links between texts of one bucket join. Texts with a possible partner in another class are flagged by signatures; then groups of flagged texts, with their multisets, are verified pair by pair in place, and pairs that other links have joined are passed over. What is written meanwhile is added to scratch."""

    def flag(pdf):
        import pandas as pd

        pdf = _sorted(pdf)
        hit = np.zeros(len(pdf), dtype=bool)
        for i, j, _ in _candidates(pdf, similarity, components_, rows):
            hit[i] = hit[j] = True
        return pd.DataFrame({"key": pdf["key"][hit], "digest": pdf["digest"][hit]})

    def verify(pdf):
        pdf = _sorted(pdf)
        items = pdf["items"].to_list()
        n = np.array([len(x) for x in items])
        begin = np.cumsum(n) - n
        ids = np.unique(np.concatenate(items), return_inverse=True)[1]
        has = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.int32)
        label, out = pdf["root"].to_numpy().copy(), []
        for ic, jc, _ in _candidates(pdf, similarity, components_, rows):
            for i in np.unique(ic):
                js = jc[ic == i] if len(ic) < 64 else jc[np.searchsorted(ic, i) : np.searchsorted(ic, i, side="right")]
                js = js[label[js] != label[i]]
                if not len(js):
                    continue
                mine = ids[begin[i] : begin[i] + n[i]]
                has[mine] = 1
                where = np.repeat(begin[js] - (np.cumsum(n[js]) - n[js]), n[js]) + np.arange(int(n[js].sum()))
                both = np.add.reduceat(has[ids[where]], np.cumsum(n[js]) - n[js])
                has[mine] = 0
                for j in js[both >= similarity * (n[i] + n[js] - both)]:
                    if label[i] != label[j]:
                        label[label == label[j]] = label[i]
                        out.append((i, j))
        return _pairs(pdf["digest"].to_numpy(), out)

    whole = split.select("key", "band", "digest", "size", "root", "sig", "n")
    flagged = in_groups(whole, F.ceil(F.col("n") / block_texts).cast("int"), groups).drop("n").groupBy("grp", "ba", "bb").applyInPandas(flag, "key bigint, digest binary").distinct()
    left = durable(whole.drop("n").join(flagged, ["key", "digest"]), "flagged")
    scratch.append(left)
    total = left.agg(F.sum("size")).first()[0] or 0
    sums = left.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("items_"))
    blocks = F.greatest(F.ceil(F.col("n") / block_texts), F.ceil(F.col("items_") / block_items)).cast("int")
    dealt = in_groups(left.join(sums, "key").join(sets, "digest"), blocks, max(1, -(-total // block_items))).drop("n", "items_")
    return dealt.groupBy("grp", "ba", "bb").applyInPandas(verify, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE, block_texts: int = BLOCK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per row of docs: id, mark (text_mark of its text), class_id (least id of its class), class_size
    (rows of the class), first (whether the row, or one equal to it in id and mark, stands for its class).

    A class is a connected component of links between texts of weighted Jaccard similarity of at least
    similarity over their multisets of n-word shingles (a text of fewer words is one shingle). Texts
    without words, null ones among them as empty ones, are linked to equal texts only. Rows that repeat
    an id with other texts are told apart by their texts, and so are rows whose id is null; a null id comes
    after all others, so a class has a null class_id only if all its ids are null. An empty table gives an empty result; other
    columns are not read.
    """
    sign = durable(signed(docs, id_col, text_col, bands, rows, n).withColumn("at", F.monotonically_increasing_id()), "signed")
    folded = sign.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark", "at")).alias("first"), F.count("*").alias("copies"))
    # the signature of the one row that stands for a text; the fold itself moves no signatures
    texts = durable(folded.join(sign.select("at", "size", "bands", "sig"), F.col("first.at") == F.col("at")).drop("at"), "texts")
    spread = texts.select("digest", "first.id", "first.mark", "size", F.posexplode("bands").alias("band", "key"))
    crowded = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("leader")).where("n > 1")
    buckets = durable(spread.join(crowded.select("key", "leader"), "key").select("key", "band", "leader", "digest", "id", "mark", "size"), "buckets")
    # one text of each digest, by id and mark: an id can be null, and texts can share one
    needed = buckets.select("digest", "id", "mark").distinct()
    raw = docs.select(F.col(id_col).alias("__id"), text_mark(text_col).alias("__mark"), F.col(text_col).cast("binary").alias("raw"))
    sets = durable(expanded(raw.join(needed, raw["__id"].eqNullSafe(needed["id"]) & (raw["__mark"] == needed["mark"])).select("digest", "raw"), n), "sets")
    sized = buckets.select("digest", "size").distinct()

    def alike(a: str, b: str):
        return F.least(a, b) >= similarity * F.greatest(a, b)

    # every text of a bucket against its leader
    lead = buckets.select("leader", "digest", "size").where("leader <> digest").distinct()
    lead = lead.join(sized.select(F.col("digest").alias("leader"), F.col("size").alias("lead_size")), "leader").where(alike("size", "lead_size"))
    edges = durable(verified(lead.select(F.col("leader").alias("a"), F.col("digest").alias("b")), sets, similarity), "edges")
    roots = components(edges)
    kept: list[DataFrame] = []
    groups = max(1, -(-buckets.count() // GROUP_ROWS))
    for last in (False, True):
        members = buckets.select("key", "band", "digest", "size").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
        apart = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key", "n")
        split = members.join(apart, "key").join(texts.select("digest", "sig"), "digest")
        how = groups, similarity, bands * rows, rows
        found = remaining_links(split, sets, *how, block_texts, block_items, kept) if last else verified(partners(split, *how, block_texts), sets, similarity)
        more = durable(found, "edges")
        if not more.isEmpty():
            kept.append(roots)
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        release(more)
    release(buckets, sets, edges)
    rooted = texts.select("digest", "first", "copies").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    classes = rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    by_digest = rooted.select("digest", "root").join(classes, "root").select("digest", F.col("first.id").alias("class_id"), F.col("first.mark").alias("class_mark"), "class_size")
    is_first = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))
    found = sign.select("id", "mark", "digest").join(by_digest, "digest").select(F.col("id").alias(id_col), "mark", "class_id", "class_size", is_first.alias("first"))
    found = durable(found, "classes")
    release(sign, texts, roots, *kept)
    return found


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


QUERIES = {"op10_near_duplicates": op10_near_duplicates}
ORACLES: dict[str, str] = {}
