import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators import catalog, history, incremental

NOW = dt.datetime(2024, 5, 1, 12)


@pytest.mark.parametrize(("text", "want"), [("-7d", NOW - dt.timedelta(days=7)), ("-24h", NOW - dt.timedelta(days=1)), ("-30m", NOW - dt.timedelta(minutes=30)), ("-10s", NOW - dt.timedelta(seconds=10)), ("now", NOW), (None, NOW), ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5))])
def test_times(text, want):
    assert history.time_argument(text, NOW) == want


def test_no_time():
    with pytest.raises(ValueError):
        history.time_argument("soon", NOW)


def log(spark, rows):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, day + dt.timedelta(days=d), s, c, sig, "f", day, "k") for i, (d, s, c, sig) in enumerate(rows)], "id long, at timestamp, symbol string, change string, signature string, file string, run timestamp, kind string")


def test_replay(spark):
    c = log(spark, [(5, "a", "added", "a1"), (5, "b", "removed", "b1"), (5, "c", "modified", "c1"), (6, "c", "modified", "c2"), (5, "d", "modified", "d0"), (6, "d", "removed", "d1"), (1, "e", "removed", "e0")])
    current = spark.createDataFrame([("a", "a9"), ("c", "c9"), ("f", "f9")], "symbol string, signature string")
    got = {r["symbol"]: r["signature"] for r in history.replay(c, current, dt.datetime(2024, 1, 3)).collect()}
    assert got == {"b": "b1", "c": "c1", "d": "d0", "f": "f9"}


def test_net_effect(spark):
    c = log(spark, [(1, "a", "added", ""), (2, "a", "removed", ""), (1, "b", "added", ""), (2, "b", "modified", ""), (1, "c", "modified", ""), (1, "d", "removed", "")])
    assert {r["symbol"]: r["net"] for r in history.net_changes(c).collect()} == {"a": "removed", "b": "added", "c": "modified", "d": "removed"}


def test_as_of(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "z", 9), (4, "k", 3)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 3, "x"), ("k", 4, "y"), ("z", 10, "w")], "k string, t int, v string")
    assert {r["id"]: r["v"] for r in history.as_of(left, right, "k", "t", "t", ["v"]).collect()} == {1: "y", 2: None, 3: None, 4: "x"}


def test_graph_patch(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "4")], "key string, body string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("x", "3"), ("y", "4")], "key string, body string")
    got = {(r["key"], r["action"], r["from_key"]) for r in incremental.graph_patch(old, new).collect()}
    assert got == {("a", "kept", None), ("b", "updated", None), ("x", "renamed", "c"), ("y", "added", None), ("d", "removed", None), ("e", "removed", None)}


def test_an_empty_graph_deletes_nothing(spark):
    items = spark.createDataFrame([], "node string, hash string")
    state = spark.createDataFrame([("a", "h", 1, "m")], "node string, hash string, version int, model string")
    cache = spark.createDataFrame([("h",)], "hash string")
    assert incremental.embed_patch(items, state, cache, 1, "m").count() == 0
    some = spark.createDataFrame([("b", "h"), ("c", "q")], "node string, hash string")
    assert {(r["node"], r["action"]) for r in incremental.embed_patch(some, state, cache, 1, "m").collect()} == {("a", "orphan"), ("b", "cached"), ("c", "encode")}


def test_resolution(spark):
    s = spark.createDataFrame([(1, "p::A.run", "run"), (2, "q::B", "B"), (3, "r::B", "B"), (4, "p::C", "C")], "id int, qualified_name string, name string")
    refs = spark.createDataFrame([(1, "p::A.run"), (2, "C"), (3, "B"), (4, "z::run"), (5, "none")], "ref int, name string")
    got = {(r["ref"], r["id"], r["tier"]) for r in incremental.resolve(refs, s).collect()}
    assert got == {(1, 1, 1), (2, 4, 2), (4, 1, 3)}  # B is ambiguous


def test_merged_queue_keeps_the_newest_git_set(spark):
    t = spark.createDataFrame([(1, 7, "parse", "scan", 50, ["a"], ["b"]), (2, 7, "parse", "git", 90, ["c"], ["d", "c"]), (3, 7, "parse", "scan", 10, ["d"], None)], "id long, project long, kind string, source string, priority int, paths array<string>, removed array<string>")
    (r,) = incremental.merged_queue(t).collect()
    assert (r["id"], r["priority"], r["merged"], r["paths"], r["removed"], r["full"]) == (3, 10, 3, 2, 0, False)


def test_versions(spark):
    df = spark.createDataFrame([("1.10.0",), ("v1.9",), ("junk",), ("3.1.12",)], "v string")
    assert [list(r[0]) for r in df.select(T.version(F.col("v"))).collect()] == [[1, 10, 0], [1, 9, 0], [0, 0, 0], [3, 1, 12]]
    assert not df.where("v = '3.1.12'").where(T.version_range(F.col("v"), "3.1.1", "3.1.9")).count()


def test_selectors():
    assert catalog.parse_selector("prod@1.2") == [("prod", "1.2.0", "1.2.2147483647")]
    assert catalog.parse_selector("prod") == [("prod", None, None)]
    assert catalog.parse_selector("3.1.1-3.1.9") == [(None, "3.1.1", "3.1.9")]
    for bad in ("", "prod@2.0-1.0", "@@", "a b"):
        with pytest.raises(ValueError):
            catalog.parse_selector(bad)


def test_longest_prefix(spark):
    p = spark.createDataFrame([("a/b/c",), ("a/bc",), ("x",)], "path string")
    r = spark.createDataFrame([("a",), ("a/b",)], "root string")
    assert {(x["path"], x["root"]) for x in catalog.longest_prefix(p, r).collect()} == {("a/b/c", "a/b"), ("a/bc", "a"), ("x", None)}


def test_chunks(spark):
    text = "\n".join(f"l{i}" for i in range(95))
    (c,) = spark.createDataFrame([(text,)], "t string").select(T.chunks(F.col("t"))).first()
    assert [(x["first_line"], x["last_line"]) for x in c] == [(1, 40), (31, 70), (61, 95)]
    assert c[1]["text"].startswith("l30\n") and len(spark.createDataFrame([("a",)], "t string").select(T.chunks(F.col("t"))).first()[0]) == 1


def test_documentation(spark):
    t = "/** First line.\n * second\n *\n\n\n * third  \n */"
    assert spark.createDataFrame([(t,)], "t string").select(T.clean_documentation(F.col("t"))).first()[0].split("\n")[0] == "First line."


def test_body_hash_ignores_indentation(spark):
    a, b = (r[0] for r in spark.createDataFrame([("x\n  y\n\nz",), ("  x\ny\nz  ",)], "t string").select(T.body_hash(F.col("t"))).collect())
    assert a == b


def test_hue(spark):
    def plain(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
        return abs(h) % 360

    words = ["", "a", "src/Main.fan", "x" * 100]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.hue(F.col("w"))).collect()][1:] == [plain(w) for w in words][1:]


def test_stale_hits_find_the_nearest_of_their_name(spark, tmp_path):
    """The query against its SQL on symbols without a size, of which it took those as the nearest, and on a popular name."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lodegraph import registry
    from tests.oracle import compare, connect

    rows = [(i, f"n{i % 7}", "B", "T", None if i % 4 == 0 or i % 7 == 3 else i % 11, 1.0) for i in range(300)]
    types = {"p_partkey": pa.int64(), "p_name": pa.string(), "p_brand": pa.string(), "p_type": pa.string(), "p_size": pa.int32(), "p_retailprice": pa.float64()}
    pq.write_table(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(types.items())}), tmp_path / "part.parquet")
    assert compare(registry.queries()["j4_stale_id_rescue"](spark, str(tmp_path)), registry.oracles()["j4_stale_id_rescue"], connect(str(tmp_path))) == ""


def test_rescue_takes_the_nearest_size(spark):
    s = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "a", 20), (4, "b", 5), (5, "a", None), (6, "c", None)], "id long, qualified_name string, size int")
    h = spark.createDataFrame([(1, "a", 14), (2, "a", 15), (3, "a", 99), (4, "a", None), (5, "b", 0), (6, "c", 7), (7, "d", 1), (8, "a", 20), (9, None, 1), (10, "a", 0), (10, "a", 20)], "stale long, qualified_name string, at int")
    assert sorted(tuple(r) for r in incremental.rescue(h, s).collect()) == [(1, 1), (2, 1), (3, 2), (4, 1), (5, 4), (6, 6), (8, 2), (10, 2)]
