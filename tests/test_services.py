import datetime as dt
import random

from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators import history, incremental, retrieval, services


def fold(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], "id string, qn string, file string, project int, rank int")
    return [(r["id"], r["also_in"]) for r in retrieval.fold(df, ["qn", "file"], "project").orderBy("rank").collect()]


def test_versions_fold_under_the_first_hit(spark):
    assert fold(spark, [("a1", "sys::Unit", "Unit.fan", 1), ("b", "sys::Other", "Other.fan", 1), ("a2", "sys::Unit", "Unit.fan", 2), ("a3", "sys::Unit", "Unit.fan", 3)]) == [("a1", "2,3"), ("b", None)]
    assert fold(spark, [("a1", "p::F", "F.fan", 1), ("a2", "p::F", "F.fan", 1), ("c", "p::F", "G.fan", 2), ("d", "p::F", "F.fan", None)]) == [("a1", None), ("a2", None), ("c", None), ("d", None)]
    assert fold(spark, [("a", "q", "F", 1), ("b", "q", "F", 2), ("c", "q", "F", 2)]) == [("a", "2"), ("c", None)]


def test_index_scores_as_the_texts_do(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(r.choice("red green blue gear bolt ring".split()) for _ in range(r.randint(0, 30)))) for i in range(200)] + [(200, None)], "doc_id long, text string")
    index = retrieval.build_index(docs, "doc_id", "text")
    a = {x["id"]: round(x["score"], 9) for x in retrieval.bm25(docs, "red bolt", "doc_id", "text").collect()}
    b = {x["id"]: round(x["score"], 9) for x in retrieval.search_index(index, "red bolt").collect()}
    plain = {i for i, t in docs.collect() if t and any(w in t.split() for w in ("red", "bolt"))}
    assert set(a) == set(b) == plain
    got = {x["id"]: x["hits"] for x in retrieval.search_prefixes(index, ["re", "bl"]).collect()}
    want = {i: sum(w.startswith(("re", "bl")) for w in t.split()) for i, t in docs.collect() if t and "red" in t.split() and "blue" in t.split()}
    assert got == want


def test_as_of_carries_over_buckets(spark):
    r = random.Random(2)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    right = [(r.randint(0, 3), day(r.randint(0, 400)), i) for i in range(60)]
    right = list({(k, t): (k, t, v) for k, t, v in right}.values())
    left = [(i, r.randint(0, 4), day(r.randint(0, 400))) for i in range(200)]
    got = history.as_of(spark.createDataFrame(left, "id int, k int, at timestamp"), spark.createDataFrame(right, "k int, t timestamp, v int"), "k", "at", "t", ["v"])
    for x in got.collect():
        before = [(t, v) for k, t, v in right if k == x["k"] and t <= x["at"]]
        assert x["v"] == (max(before)[1] if before else None)
    assert got.count() == 200


def test_running_totals_and_batches(spark):
    rows = [(i, i % 7 + 1) for i in range(500)]
    got = {x["key"]: (x["n"], x["batch"]) for x in incremental.grouped_batches(spark.createDataFrame(rows, "key int, n long").repartition(5), 20).collect()}
    before = 0
    for k, n in rows:
        assert got[k] == (n, before // 20)
        before += n


def test_head_moves(spark):
    cases = {"commit: fix": "edit", "commit (initial): x": "edit", "commit (amend): x": "rewrite", "commit (merge): y": "integrate", "merge topic: Fast-forward": "integrate", "pull: ok": "integrate", "pull --rebase (start): checkout": None, "pull --rebase (finish): z": "rewrite", "rebase (pick): a": None, "rebase -i (squash): a": None, "rebase -i (finish): returning": "rewrite", "checkout: moving from a to b": "switch", "reset: moving to HEAD~1": "switch", "cherry-pick: c": "edit", "clone: from x": "switch", "Branch: renamed a to b": "switch", "gc": "unknown"}
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    assert {r["m"]: r["k"] for r in df.select("m", incremental.head_move(F.col("m")).alias("k")).collect()} == cases


def test_version_texts(spark):
    df = spark.createDataFrame([("v1.2",), ("1",), ("x",), ("0.0",), ("1.2.3.4",), (None,)], "t string")
    got = [tuple(r) for r in df.select("t", T.valid_version(F.col("t")), T.normal_version(F.col("t"))).collect()]
    assert got[:4] == [("v1.2", True, "1.2.0"), ("1", True, "1.0.0"), ("x", False, ""), ("0.0", True, "0.0.0")] and got[4][1] is False and got[5][1] is False


def test_query_shapes_and_headers(spark):
    df = spark.createDataFrame([('say "hi"',), ("one two",), ("a OR b c",), ("wild*",), ("three little words",)], "q string")
    assert [r[0] for r in df.select(services.query_shape(F.col("q"))["backend"]).collect()] == ["fts", "memory", "fts", "fts", "both"]
    h = services.parsed_header(services.evidence_header(F.lit("a::b"), F.lit("method"), F.lit("x/y.fan")))
    assert tuple(df.select(h.alias("h")).first()["h"]) == ("a::b", "method", "x/y.fan")
