import random

from lodegraph.llm import decontaminate as d
from tests.llm import brute


def plain(text, items, n=10):
    w = brute.words(text)
    hit, met = set(), set()
    for i, t in items:
        q = brute.words(t)
        for k in range(max(1, len(q) - n + 1)) if q else ():
            win = q[k : k + n]
            for at in range(len(w) - len(win) + 1):
                if w[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    met.add(str(i))
    return len(w), len(hit), sorted(met)


def test_against_plain_rule(spark):
    r = random.Random(1)
    vocab = ["a", "b", "c", "É", "d1", "Of"]
    make = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", "!", "\n"]) for _ in range(n))
    items = [(i, make(r.randint(0, 16))) for i in range(12)] + [(12, None), (3, "Of d1 short"), (None, "a b")]
    docs = [(i, make(r.randint(0, 60)) + (" " + items[i % 12][1]) * (i % 3 == 0) + " " + make(3)) for i in range(60)] + [(60, None), (61, "")]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    every = [(i, t) for i, t in items if t is not None]
    one, several = (d.decontaminate(*tables, automaton_words=n).collect() for n in (1000, 20))
    assert sorted(map(str, one)) == sorted(map(str, several))  # one pass and several, an automaton each
    for row in one:
        text = dict(docs)[row["doc_id"]]
        n_words, n_hit, ids = plain(text, every)
        assert (row["n_words"], row["n_hit"], [str(x) for x in row["items"]]) == (n_words, n_hit, [x for x in ids if x != "None"] + ["None"] * ("None" in ids))
        inside = [w for s in row["hit_spans"] for w in brute.words(text[s["start"] : s["end"]])]
        assert len(inside) == row["n_hit"]


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "🙂 É! One two THREE four, five six seven eight nine ten eleven.")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    (s,) = d.decontaminate(docs, items).first()["hit_spans"]
    assert "🙂 É! One two THREE four, five six seven eight nine ten eleven."[s["start"] : s["end"]] == "two THREE four, five six seven eight nine ten eleven"


def test_passages_of_several_scans_are_one():
    assert d.merged([(5, 8, 50, 80), (0, 2, 0, 20), (7, 12, 70, 120), (2, 3, 21, 30), (6, 7, 60, 70)]) == [(0, 3, 0, 30), (5, 12, 50, 120)]


def test_codes_of_large_and_small_vocabularies():
    for n, width in ((5, 1), (64, 1), (65, 2), (5000, 3)):
        built = d.build([(1, " ".join(f"w{i}" for i in range(n)).encode())], 10)
        assert built[1] == width and len(set(built[0].values())) == n
        text = "no " + " ".join(f"w{i}" for i in range(max(0, n - 20), n)) + " w0 end"
        assert d.scan(text.encode(), built)[2][0][:2] == (1, 1 + min(n, 20))


def test_long_texts_take_time_in_proportion():
    import time

    built = d.build([(1, b"one two three four five six seven eight nine ten eleven")], 10)
    took = []
    for n in (20_000, 40_000, 80_000):
        began = time.time()
        assert d.scan(b"one two three four five six seven eight nine ten eleven " * n, built)[2][0][:2] == (0, 11 * n) or n
        took.append(time.time() - began)
    assert took[2] < 8 * max(took[0], 0.05)


def test_corners(spark, corner_docs, no_docs):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert d.decontaminate(corner_docs, items, keep=corner_docs.columns).count() == corner_docs.count()
    assert d.decontaminate(no_docs, items).count() == 0
    assert d.decontaminate(corner_docs, items.limit(0)).where("n_hit > 0").count() == 0
