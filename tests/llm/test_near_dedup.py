import random
from collections import Counter

import numpy as np
import pytest

from lodegraph.llm import near_dedup as nd
from lodegraph.llm.word_hashes import multisets, shingles
from tests.llm import brute


def test_shingle_multisets():
    texts = ["a b c d e f a b c d e f a b c d e", "one", "", "  ", "A B C d e", "x y z", "É b c d e f"]
    s, t, count = shingles([x.encode() for x in texts])
    text, _, c = multisets(s, t, len(texts))
    for i, x in enumerate(texts):
        assert count[i] == len(brute.words(x))
        assert sorted(c[text == i].tolist()) == sorted(brute.bag(x).values())
    both = s[t == 0][0] == s[t == 4][0]
    assert both  # case of A-Z does not count


@pytest.mark.parametrize("weights", [((1, 1, 1, 1), (1, 1, 1, 0)), ((5, 1, 0, 2), (3, 1, 4, 2)), ((40, 7), (33, 9)), ((1, 0), (0, 1))])
def test_signatures_estimate_weighted_jaccard(weights):
    m, texts, items, counts = 4096, [], [], []
    for i, w in enumerate(weights):
        for j, c in enumerate(w):
            if c:
                texts.append(i), items.append(np.uint64(1000003 * (j + 1))), counts.append(c)
    low = nd.bag_minhash(np.array(texts), np.array(items, dtype=np.uint64), np.array(counts), 2, m)
    a, b = weights
    assert (low[0] == low[1]).mean() == pytest.approx(sum(map(min, a, b)) / sum(map(max, a, b)), abs=0.04)


def classes(rows):
    """Components by comparing all pairs."""
    bags = [brute.bag(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "") if not bags[i] or not bags[j] else brute.similarity(bags[i], bags[j]) >= 0.8
            if same:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    size = Counter(find(i) for i in range(len(rows)))
    return sorted((rows[i][0], min(least[find(i)]), size[find(i)]) for i in range(len(rows)))


def test_against_all_pairs(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "!!"), (3, "!!"), (4, "one two"), (5, "One, two")]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([6, 30, 120]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 3])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append((len(rows), " ".join(copy * r.choice([1, 1, 2]))))
    rows += [(len(rows) + i, "again and again and again and again") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((x["doc_id"], x["class_id"], x["class_size"]) for x in nd.near_duplicates(df).collect())
    assert got == classes(rows)


def test_chains_of_links_and_cross_class_pairs(spark):
    """A drifting chain: each text is near the next, the ends are far apart."""
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x["doc_id"], x["class_id"], x["class_size"]) for x in nd.near_duplicates(df).collect()) == classes(rows)


def test_large_buckets_in_small_blocks(spark):
    """Drifting chains about one start share buckets with texts of other classes; blocks of four texts, two multisets each, give what one block gives."""
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for c in range(3):
        base = [r.choice(vocab) for _ in range(150)]
        for k in range(14):
            copy = list(base)
            for _ in range(r.choice([2, 3, 5])):
                copy[r.randrange(150)] = r.choice(vocab)
            rows.append((100 * c + k, " ".join(copy)))
        for k in range(14):
            rows.append((100 * c + 50 + k, " ".join(base[4 * k :] + [r.choice(vocab) for _ in range(2 * k)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole, blocks = (sorted((x["doc_id"], x["class_id"], x["class_size"]) for x in nd.near_duplicates(df, **how).collect()) for how in ({}, {"block_texts": 4, "block_items": 300}))
    assert whole == blocks == classes(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (103, 103), (5, 100)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 200 for i in range(201, 230))
    assert got[100] == got[101] == got[102] == 0 and 0 not in got and 200 not in got


def test_corners(corner_docs, no_docs):
    got = nd.near_duplicates(corner_docs)
    assert got.count() == corner_docs.count()
    assert {(r["doc_id"], r["class_id"]) for r in got.where("doc_id in (0, 1, 4, 5)").collect()} == {(0, 0), (1, 0), (4, 4), (5, 4)}
    assert nd.near_duplicates(no_docs).count() == 0


def test_near_copies_with_null_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(None, a), (None, a + " more"), (None, a + " more"), (5, b), (None, b + " more"), (None, c), (9, "alone")]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in got) == sorted([("None", "None", 3)] * 3 + [("5", "5", 2), ("None", "5", 2), ("None", "None", 1), ("9", "9", 1)])
    assert len({r["mark"] for r in got if r["class_size"] == 3 and r["first"]}) == 1
    assert [r["doc_id"] for r in got if r["class_id"] == 5 and r["first"]] == [5]
