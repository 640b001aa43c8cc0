import random
from collections import defaultdict

import numpy as np
import pytest

from lodegraph.llm import packing, permutation_index as pi, token_counts


def brute_nearest(rows, k=5):
    x = {i: np.array(v) for i, v in rows}
    out = {}
    for q in (i for i in x if i % 50 == 0):
        s = sorted((-(x[q] @ x[j]) / np.linalg.norm(x[q]) / np.linalg.norm(x[j]), j) for j in x if j != q)
        out[q] = [j for _, j in s[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in pi.nearest(df, lambda i: i % 50 == 0, shard_rows=1000, block_queries=20, least=40).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    truth, x = brute_nearest(rows), dict(rows)
    hits = sum(len({j for _, j, _ in got[q]} & set(t)) for q, t in truth.items())
    assert hits / (5 * len(truth)) >= 0.9
    for q, found in got.items():
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        for _, j, s in found:
            a, b = np.array(x[q]), np.array(x[j])
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_index_corners(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(0, v), (1, [2.0, 0.0, 4.0]), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 1.0]), (None, v), (50, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, x, "z") for i, x in rows], "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in pi.nearest(df, lambda i: i % 50 == 0).select("query_id", "rank", "vec_id").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert pi.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert pi.nearest(df.where("vec_id = 0"), lambda i: i % 50 == 0).count() == 0


def test_footrule_is_what_postings_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    pivots = rng.normal(size=(12, 8))
    perm = pi.orders(pi.cosines(x, pivots / np.linalg.norm(pivots, axis=1, keepdims=True)), 5)
    place = lambda p, o: (list(o).index(p) if p in o else 5) + 1
    foot = [sum(abs(place(p, perm[0]) - place(p, o)) for p in range(12)) for o in perm]
    shard = pi.Shard(np.arange(50), x, perm, 12)
    near = shard.nearness(perm[0])
    assert sorted(foot) == sorted((5 * 6 - 2 * near.astype(int)).tolist())
    assert near.max() == 15 and foot[0] == 0


def test_copies_take_no_place_from_others():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 900, axis=0), rng.normal(size=(100, 8))])
    ids = rng.permutation(1000)
    perm = pi.orders(pi.cosines(x, x[895:907] / np.linalg.norm(x[895:907], axis=1, keepdims=True)), 6)
    got = pi.Shard(ids, x, perm, 12).search(int(ids[3]), x[3], perm[3], np.ones(12, dtype=bool), 5, 0.25, 50)
    assert [i for _, i, _ in got] == sorted(set(ids[:900].tolist()) - {int(ids[3])})[:5]


def test_packing_fits_and_wastes_little():
    r = random.Random(5)
    lengths = np.array([r.choice([r.randint(1, 300), r.randint(1, 3000), 16384]) for _ in range(3000)])
    which, offset, capacity, used = packing.pack(lengths)
    filled = defaultdict(list)
    for b, o, n in zip(which, offset, lengths, strict=True):
        filled[b].append((o, n))
    for b, parts in filled.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == used[b] <= capacity[b]
        assert all(c < at for c in packing.CAPACITIES if c < capacity[b])  # no smaller size would do
    assert used.sum() == lengths.sum() and used.sum() / capacity.sum() > 0.99


def test_cells_are_bundled_and_split():
    homes = pi.bundle({0: 10, 1: 25, 2: 3, 3: 4, 5: 9}, 6, 10)
    assert homes == [(0, 1), (1, 3), (4, 1), (4, 1), (4, 1), (5, 1)]
    cos = np.array([[0.9, 0.8, 0.3, -0.2], [0.1, 0.0, -0.1, -0.5]])
    assert pi.probed(cos, 0.42).tolist() == [[True, True, False, False], [True, True, True, False]]


def test_crowds_are_found_by_few_cells(spark):
    """Forty crowds: queries find their neighbours though they read a small part of the cells."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    x = np.repeat(centres, 100, axis=0) + 0.25 * rng.normal(size=(4000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = defaultdict(set)
    for r in pi.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0, shard_rows=500, least=40).collect():
        got[r["query_id"]].add(r["vec_id"])
    truth = brute_nearest(rows)
    assert sum(len(got[q] & set(t)) for q, t in truth.items()) / (5 * len(truth)) >= 0.9
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pivots = pi.choose_pivots(unit, 64)
    cells = pi.orders(pi.cosines(x, pivots), 1)[:, 0]
    assert np.mean([pi.probed(pi.cosines(x[i : i + 1], pivots), pi.PROBE_MARGIN)[0][cells].mean() for i in range(0, 4000, 50)]) < 0.4


def least_space(lengths, capacities):
    """The least total capacity of bins that hold all lengths, by trying every grouping."""
    best = None

    def go(i, bins):
        nonlocal best
        if i == len(lengths):
            if all(b <= max(capacities) for b in bins):
                total = sum(min(c for c in capacities if c >= b) for b in bins)
                best = total if best is None else min(best, total)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= max(capacities):
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        bins.append(lengths[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def test_packing_is_near_the_least_space():
    r = random.Random(4)
    ours = least = 0
    for _ in range(60):
        lengths = [r.randint(1, 16) for _ in range(r.randint(1, 7))]
        _, _, capacity, _ = packing.pack(np.array(lengths), (4, 8, 16), 0)
        ours, least = ours + int(capacity.sum()), least + least_space(lengths, (4, 8, 16))
    assert least <= ours <= 1.1 * least


def one_by_one(lengths, capacities, bin_cost):
    """Best fit written plainly: longest first, the fullest open bin with room, else the opening that costs least a unit; then downsized."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins = []  # [capacity, contents, [(piece, offset)]]
    for place, i in enumerate(order):
        fits = [b for b in bins if b[0] - b[1] >= lengths[i]]
        if fits:
            room = min(b[0] - b[1] for b in fits)
            b = [b for b in fits if b[0] - b[1] == room]
            b = max(b, key=lambda x: x[3])  # the one that came to this room last
        else:
            rest = [lengths[j] for j in order[place + 1 :]]

            def price(c):
                return (c + bin_cost) / max(1, min(c, lengths[i] + sum(x for x in rest if x <= c - lengths[i])))

            c = min((c for c in sorted(capacities) if c >= lengths[i]), key=price)
            b = [c, 0, [], 0]
            bins.append(b)
        b[2].append((i, b[1]))
        b[1] += lengths[i]
        b[3] = place + 1
    return sorted((i, at, min(c for c in capacities if c >= b[1]), b[1]) for b in bins for i, at in b[2])


def test_packing_against_the_plain_rule():
    r = random.Random(9)
    for _ in range(100):
        lengths = [r.choice([r.randint(1, 40), r.randint(1, 400), 400]) for _ in range(r.randint(0, 60))]
        which, offset, capacity, used = packing.pack(np.array(lengths, dtype=np.int64), (50, 100, 200, 400), 7)
        got = sorted((i, int(offset[i]), int(capacity[which[i]]), int(used[which[i]])) for i in range(len(lengths)))
        assert got == one_by_one(lengths, (50, 100, 200, 400), 7)


BYTES = packing.ByteTokens()


def test_packing_corners(spark, corner_docs, no_docs):
    got = packing.pack_documents(corner_docs, BYTES, capacities=(64, 1000), block_rows=7)
    n = corner_docs.selectExpr("sum(case when octet_length(text) > 0 then octet_length(text) + 1 else 0 end)").first()[0]
    assert got.agg({"length": "sum"}).first()[0] == n
    assert got.where("length = 0 and bin is not null or length > 0 and bin is null").count() == 0
    assert got.where("length = 0").count() == 2
    per = got.where("bin is not null").groupBy("bin").agg({"length": "sum", "bin_used": "max", "bin_capacity": "max"}).collect()
    assert all(r["sum(length)"] == r["max(bin_used)"] <= r["max(bin_capacity)"] for r in per)
    whole = {}
    for r in got.orderBy("doc_id", "piece").collect():
        whole.setdefault((r["doc_id"], r["piece"], r["start"]), (r["end"], r["text"]))
    texts = {r["doc_id"]: r["text"] for r in corner_docs.collect()}
    for i, t in texts.items():
        assert "".join(v[1] or "" for k, v in whole.items() if k[0] == i) == (t or "")
    shown = packing.sequences(got).collect()
    assert all(sum(len(t.encode()) for t in r["texts"]) <= r["bin_used"] <= r["bin_capacity"] for r in shown)
    assert packing.pack_documents(no_docs, BYTES).count() == 0


def test_ids_stay_as_they_are(spark):
    ids = [9007199254740993, 9007199254740995, None, -1, None]
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = packing.pack_documents(df, BYTES).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, ids))
    named = spark.createDataFrame([("a", "x"), (None, "y")], "doc_id string, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in packing.pack_documents(named, BYTES).collect()) == [("None", "y"), ("a", "x")]


def test_equal_rows_are_dealt_to_many_blocks(spark):
    df = spark.range(50_000).selectExpr("cast(7 as long) as doc_id", "'the same text' as text")
    got = packing.pack_documents(df, BYTES, block_rows=1000)
    sizes = [r["count"] for r in got.groupBy(got["bin"].substr(1, 3)).count().collect()]
    per = [r["count"] for r in got.selectExpr("split(bin, '-')[0] as b").groupBy("b").count().collect()]
    assert len(per) == 50 and max(per) < 1300 and sizes


def test_one_long_document_is_cut_in_order(spark):
    df = spark.createDataFrame([(1, "x" * 2500)], "doc_id long, text string")
    got = packing.pack_documents(df, BYTES, capacities=(100, 1000)).orderBy("piece").collect()
    assert [(r["start"], r["end"], r["length"], r["bin_capacity"]) for r in got] == [(0, 1000, 1000, 1000), (1000, 2000, 1000, 1000), (2000, 2500, 501, 1000)]


def test_cuts_lie_between_characters():
    r = random.Random(1)
    tokens = packing.public_tokens()
    for k in range(200):
        text = "".join(r.choice(["word", " ", "日本語", "🙂", "é", "\n", "ab", " the"]) for _ in range(r.randint(0, 80)))
        for t, top in ((BYTES, 16), (tokens, 9)):
            found = packing.pieces_of(text, t, top)
            assert "".join(text[s:e] for s, e, _ in found) == text
            assert sum(n for _, _, n in found) == (len(t.ids(text)) + 1 if text else 0)
            assert all(0 < n <= top for _, _, n in found), (k, found)


def test_public_tokens_are_the_librarys():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain, t = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), packing.public_tokens()
    r = random.Random(3)
    for _ in range(3):
        text = "".join(r.choice(["word ", "two  blanks", "\n\n", " it's ", "1234 ", "é🙂 ", "    "]) for _ in range(30_000))
        assert t.ids(text) == plain.encode_ordinary(text)


def test_texts_of_megabytes_are_packed(spark):
    df = spark.createDataFrame([(1, "a b " * 700_000), (2, " " * 300_000)], "doc_id long, text string")
    got = packing.pack_documents(df, packing.public_tokens())
    assert {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg({"end": "max"}).withColumnRenamed("max(end)", "n").collect()} == {1: 2_800_000, 2: 300_000}


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_split_counts_add_up(model):
    r = random.Random(6)
    bits = ["hello", "world", " ", " ", "  ", "\n", "\t", "é", "🙂", "▁", " ▁", "<s>", "</s>", "　", "日本", "a", "ing", ".", "\xa0", "é"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 400))) for _ in range(200)] + [" " * 500, "▁" * 50, "x" * 3000, "a b " * 500]
    whole = [len(ids) for ids in model.encode(texts, num_threads=1)]
    for limit in (7, 64, 1000):
        assert token_counts.count_batches(texts, model, 500, limit) == whole


def test_no_piece_holds_a_mark_inside(model):
    assert not [p for p in (model.id_to_piece(i) for i in range(model.get_piece_size())) if "▁" in p.lstrip("▁")]


def test_token_corners(corner_docs, no_docs, model):
    import public_tokenizers

    got = token_counts.count_tokens(corner_docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in corner_docs.collect()}
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(model.encode(t)) if t else 0)
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert token_counts.count_tokens(no_docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
