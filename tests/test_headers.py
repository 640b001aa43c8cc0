import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import code
from lodegraph.functions import headers as H
from lodegraph.operators import catalog, incremental, services
from lodegraph.sources import parsers


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_read_signature():
    names = lambda s: [(p["name"], p["default"], p["required"]) for p in H.read_signature(s)["params"]]
    assert names('(a, b: null, c: "x, (y") => a') == [("a", None, True), ("b", "null", False), ("c", '"x, (y"', False)]
    assert names("(f: (x, y) => x + y, g: {a: [1, 2]}) => f") == [("f", "(x, y) => x + y", False), ("g", "{a: [1, 2]}", False)]
    assert H.read_signature("() => 1") == {"found": True, "line": 1, "params": []}
    assert H.read_signature("// (a) => b\n/* c\n*/\n (z)\n=> z")["line"] == 4
    for text in (None, "", "x + 1", "(a, b", "(a) + 1", "// only", "/* open (a) => b"):
        assert H.read_signature(text) == {"found": False, "line": 1, "params": []}


def test_lines(spark):
    assert one(spark, "defcomp\n  a: {bind}\n  b: {}\n  do\n  c: {}\n end", lambda c: H.cells_line(H.cells(c))) == "cells: a {bind}, b"
    assert one(spark, None, lambda c: H.cells_line(H.cells(c))) == one(spark, "x => y", lambda c: H.cells_line(H.cells(c))) == ""
    many = "defcomp\n" + "".join(f"  c{i}: {{}}\n" for i in range(20))
    assert one(spark, many, lambda c: H.cells_line(H.cells(c))) == "cells: " + ", ".join(f"c{i}" for i in range(12))
    names = spark.createDataFrame([(["a"] * 7, [])], "c array<string>, d array<string>")
    assert names.select(H.context_line(F.col("c"), F.col("d"))).first()[0] == "context: calls: a, a, a, a, a"
    assert names.select(H.header_line(F.lit("p"), F.lit("i"), F.lit("func/aB.trio"), F.col("d"))).first()[0] == "project: p | instance: i"


def test_braces(spark):
    assert one(spark, "class A { f { } } more", code.braced) == "{ f { } }"
    assert one(spark, "abstract f()\n{ }", code.braced) == ""
    assert one(spark, "f { {", code.braced) == "{ {"
    got = lambda t: [tuple(r) for r in one(spark, t, code.brace_lines)]
    assert got("a {\n b { } {\n }\n}\n} {") == [(1, 4), (2, 2), (5, 5)]
    assert got("a { {\n}\n") == [(1, 3)]
    assert got(None) == got("") == []
    rows = [("a.ts", "ts", "export class C {\n  x = 1\n}\nfunction g() {\n  if (a) {\n  }\n}"), ("b.py", "python", "def f():\n    pass")]
    spans = code.declared_spans(spark.createDataFrame(rows, "path string, language string, text string"))
    assert {(r["path"], r["name"], r["line"], r["last_line"]) for r in spans.collect()} == {("a.ts", "C", 1, 3), ("a.ts", "g", 4, 7), ("b.py", "f", 1, 1)}


def test_pages(spark):
    df = spark.createDataFrame([(1, "a/func~abs.html", "sys", "<p>out</p>"), (2, "a/Q.html", "sys", "")], "id int, path string, pod string, html string")
    f = df.select(parsers.html_function(F.col("path"), F.col("html")).alias("f")).select("f.*").collect()
    assert [(r["name"], r["signature"], r["description"], r["metadata"]) for r in f] == [("abs", None, "Axon function: abs", {}), ("Q", None, "Axon function: Q", {})]
    c = df.select(parsers.html_chapter(F.col("path"), F.col("html")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in c] == [("func~abs", "out"), ("Q", "Documentation chapter: Q")]
    e = parsers.html_entries(df, "id").orderBy("id").collect()
    assert [(r["place"], r["kind"], r["qualified_name"], r["description"]) for r in e] == [(0, "type", "sys::func~abs", "func~abs from sys"), (0, "type", "sys::Q", "Q from sys")]


def test_scope_is_guarded(spark):
    p = spark.createDataFrame([(1, "a", "1.0.0"), (2, "b", "2.0.0")], "id int, product string, version string")
    ids = lambda *a: [r["id"] for r in catalog.scoped(p, *a).orderBy("id").collect()]
    assert ids() == [1, 2] and ids("a@1.0") == [1] and ids("a, b", 2) == [2] and ids("", 1) == [1] and ids("", 9) == []
    with pytest.raises(ValueError, match="not in"):
        catalog.scoped(p, "a", 2)


def test_leases(spark):
    now = dt.datetime(2024, 1, 1)
    rows = [(1, "k", "pending", 5, now, 0, 3, None, None), (2, "k", "yielded", 5, now, 0, 3, None, None), (3, "k", "pending", 1, now + dt.timedelta(1), 0, 3, None, None), (4, "other", "pending", 0, now, 0, 3, None, None)]
    tasks = spark.createDataFrame(rows, "id int, kind string, state string, priority int, due timestamp_ntz, attempts int, max_attempts int, owner string, lease_until timestamp_ntz")
    state = lambda t: {r["id"]: (r["state"], r["owner"], r["attempts"], r["due"]) for r in t.collect()}
    t = incremental.claimed(tasks, ("k",), "me", now, 60)
    assert state(t)[1] == ("running", "me", 0, now) and state(t)[2][0] == "yielded" and state(t)[4][0] == "pending"
    assert state(incremental.claimed(tasks, ("none",), "me", now, 60)) == state(tasks)
    late = now + dt.timedelta(seconds=61)
    assert state(incremental.recovered(t, "me", now, 10, 15)) == state(t)
    back = incremental.recovered(t, "me", late, 10, 15)
    assert state(back)[1] == ("pending", None, 1, late + dt.timedelta(seconds=10))
    assert state(incremental.recovered(incremental.renewed(t, "me", late, 60), "me", late, 10, 15))[1][0] == "running"
    assert state(incremental.recovered(t, "you", now, 10, 15))[1][0] == "pending"
    gone = incremental.failed(incremental.failed(back, F.col("id") == 1, late, 10, 15), F.col("id") == 1, late, 10, 15)
    assert state(gone)[1][:3] == ("failed", None, 3)
    given = incremental.yielded(t, F.col("id") == 1, now, 5)
    assert state(given)[1] == ("yielded", None, 0, now + dt.timedelta(seconds=5))
    assert state(incremental.completed(t, F.col("id") == 1))[1][:2] == ("done", None)


def test_modes(spark):
    hits = spark.createDataFrame([(0, i, 1 - i / 10, i) for i in range(1, 6)], "query_id int, id int, score double, rank int")
    ids = lambda *a, **k: [r["id"] for r in services.by_mode(hits, *a, **k).orderBy("rank").collect()]
    assert ids("vector", 3, 0.85) == [1] and ids("rerank", 2) == [1, 2] and ids("rerank", 2, rerank=F.col("id")) == [5, 4]
    assert [r["score"] for r in services.by_mode(hits, "rerank", 5, rerank=F.lit(3)).orderBy("rank").collect()] == [0.9, 0.8, 0.7, 0.6, 0.5]
    assert {r["degraded"] for r in services.by_mode(hits, "rlm", 2, rerank=F.col("id")).collect()} == {"no-rlm"}
    with pytest.raises(ValueError):
        services.by_mode(hits, "other")
