import io
import zipfile

from pyspark.sql import functions as F

from lodegraph.sources import files, parsers, sinks


def one(spark, text):
    return spark.createDataFrame([(1, text)], "id int, text string")


def test_scan_and_zip(spark, tmp_path):
    for p in ("a/x.py", "node_modules/y.py", "b/z.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("hello")
    with zipfile.ZipFile(tmp_path / "b/d.zip", "w") as z:
        z.writestr("in/page.html", "<h1>Ä</h1>")
    assert [r["path"].rsplit("/", 2)[-1] for r in files.scan(spark, str(tmp_path), "*.py").collect()] == ["x.py"]
    (r,) = files.unzipped(files.scan(spark, str(tmp_path), "*.zip")).collect()
    assert (r["entry"], r["text"]) == ("in/page.html", "<h1>Ä</h1>")
    assert io.BytesIO


def test_routes(spark):
    paths = ["a/build.fan", "b.TRIO", "c/Main.ts", "d.htm", "README.md", "x.zip", "y.bin"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(files.route(F.col("p"))).collect()]
    assert got == ["build", "trio", "source", "html", "markdown", "zip", "none"]


def test_calls(spark):
    code = 'foo(1) // bar(2)\nx.run(baz())\nTime.now() + pod::Type.make("no(t)")\nif (a) obj->trap(1); List(3)\n/* skip(1)\nskip2() */'
    got = {(r["line"], r["kind"], r["target"]) for r in parsers.calls(one(spark, code), "id", "text").collect()}
    assert got == {(1, "direct", "foo"), (2, "method", "x.run"), (2, "direct", "baz"), (3, "static", "Time.now"), (3, "qualified", "pod::Type.make"), (4, "dynamic", "obj->trap"), (4, "constructor", "List")}


def test_parameters(spark):
    got = one(spark, "// doc\n(a, b: 3, c: null) => do\n").select(parsers.parameters(F.col("text"))).first()[0]
    assert [(p["name"], p["default"]) for p in got] == [("a", None), ("b", "3"), ("c", "null")]


def test_trio(spark):
    t = 'name: hello\nfunc\nsrc:\n  (a) => do\n    a + 1\n  end\n---\nview\ndis: "My view"\n-----\n\n'
    rows = parsers.trio_records(one(spark, t), "id").orderBy("record").collect()
    assert rows[0]["tags"]["name"] == "hello" and rows[0]["tags"]["func"] == "✓" and rows[0]["tags"]["src"].startswith("\n(a) => do")
    assert [r[0] for r in parsers.trio_records(one(spark, t), "id").select(parsers.trio_kind(F.col("tags"))).collect()] == ["function", "view"]


def test_markdown(spark):
    t = "intro\n\n```fan\nclass A {}\n```\ntext\n```\nplain\nlines\n```\n"
    got = [(r["block"], r["language"], r["line"], r["code"]) for r in parsers.markdown_blocks(one(spark, t), "id").orderBy("block").collect()]
    assert got == [(0, "fan", 3, "class A {}"), (1, "", 7, "plain\nlines")]


def test_diff(spark):
    t = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@ def\n+a\n@@ -9 +12 @@\n--- a/y\n+++ b/y\n@@ -1,3 +0,0 @@\n"
    got = [(r["file"], r["first_line"], r["last_line"]) for r in parsers.diff_hunks(one(spark, t), "id").orderBy("file", "first_line").collect()]
    assert got == [("x.py", 3, 6), ("x.py", 12, 12), ("y", 0, 0)]


def test_version_control(spark):
    t = "A\0new.py\0R096\0old.py\0moved.py\0D\0gone.py\0"
    got = [(r["status"], r["path"], r["new_path"], r["similarity"]) for r in parsers.name_status(one(spark, t)).collect()]
    assert got == [("A", "new.py", None, None), ("R", "old.py", "moved.py", 96), ("D", "gone.py", None, None)]
    log = "\x1eabc\x1fann\x1f2024-01-02 03:04:05\x1fFix it\x1f\na.py\nb.py\n\x1edef\x1fbob\x1f2024-01-03 00:00:00\x1fEmpty\x1f\n"
    assert [(r["commit"], r["author"], r["file"]) for r in parsers.commit_log(one(spark, log)).collect()] == [("abc", "ann", "a.py"), ("abc", "ann", "b.py"), ("def", "bob", None)]
    line = "0" * 40 + " " + "1" * 40 + " Ann <a@b.c> 1700000000 +0100\tcommit: fix"
    (r,) = parsers.reflog(spark.createDataFrame([(line,), ("junk",)], "value string")).collect()
    assert (r["epoch"], r["message"]) == (1700000000, "commit: fix")


def test_manifests(spark):
    fan = 'class Build {\n summary = "My pod"\n depends = ["sys 1.0", "web 1.0+"]\n}'
    js = '{"description": "d", "dependencies": {"react": "1", "vue": "2"}}'
    got = [(r[0]["summary"], sorted(r[0]["depends"])) for r in spark.createDataFrame([(fan,), (js,)], "t string").select(parsers.manifest(F.col("t"))).collect()]
    assert got == [("My pod", ["sys", "web"]), ("d", ["react", "vue"])]


def test_html(spark):
    t = "<h1>A &amp; <b>B</b></h1><table><tr><th>name</th><td>a <i>thing</i></td></tr><tr><th>two words</th><td>x</td></tr></table><a href=\"/u\">Go <b>on</b></a>"
    d = one(spark, t)
    assert d.select(parsers.html_title(F.col("text"))).first()[0] == "A & B"
    assert [(r["name"], r["description"]) for r in parsers.html_slots(d, "id", "text").collect()] == [("name", "a thing")]
    assert [(r["target"], r["label"]) for r in parsers.html_links(d, "id", "text").collect()] == [("/u", "Go on")]


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([("n1", 1, 0.5), ("n1", 1, 0.6), ("n2", 1, 0.7), ("n3", 2, 0.8)], "node_id string, project_id int, x double")
    path = str(tmp_path / "vectors")
    v.write.partitionBy("project_id").parquet(path)
    sinks.upsert_vectors(spark, path, spark.createDataFrame([("n1", 1, 9.0), ("n4", 1, 1.0)], "node_id string, project_id int, x double"))
    assert sorted((r["node_id"], r["x"]) for r in spark.read.parquet(path).collect()) == [("n1", 9.0), ("n2", 0.7), ("n3", 0.8), ("n4", 1.0)]
    slot = sinks.build_beside(v, str(tmp_path / "slots"))
    sinks.promote(spark, str(tmp_path / "slots"), slot)
    assert sinks.live(spark, str(tmp_path / "slots")).count() == 4


def test_exports(spark):
    n = spark.createDataFrame([(1, 'a"b', "t"), (2, "c", "t")], "id long, name string, node_type string")
    e = spark.createDataFrame([(1, 2, "calls"), (1, 2, "calls")], "src long, dst long, edge_type string")
    assert [r["line"] for r in sinks.export_lines(n, e, "dot").orderBy("part", "ord").collect()] == ['  "1" [label="a\\"b"];', '  "2" [label="c"];', '  "1" -> "2" [label="calls"];']
    for form in ("json", "d3", "cytoscape"):
        assert sinks.export_lines(n, e, form).count() == 3


def test_streams(spark, tmp_path):
    import datetime as dt

    from lodegraph.streaming import streams

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=20 * i), i % 3, "click" if i % 2 else "view", float(i)) for i in range(60)] + [(5, t0 + dt.timedelta(minutes=100), 2, "click", 5.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    src = str(tmp_path / "events")
    df.repartition(3).write.parquet(src)
    read = lambda: streams.read_events(spark, src, df.schema)
    for k, (make, batch) in enumerate(((lambda e: streams.tumbling(e, "1 hour"), streams.tumbling(df, "1 hour")), (lambda e: streams.sessions(e, "30 minutes"), streams.sessions(df, "30 minutes")))):
        out = str(tmp_path / f"out{k}")
        streams.start(make(read()), str(tmp_path / f"cp{k}"), streams.batch_folder(out)).awaitTermination(120)
        got, whole = spark.read.parquet(out).drop("batch"), batch
        assert got.count() > 0 and got.exceptAll(whole).count() == 0  # windows still open are held back
    out = str(tmp_path / "dedup")
    streams.start(streams.deduplicated(read()), str(tmp_path / "cpd"), streams.batch_folder(out)).awaitTermination(120)
    assert spark.read.parquet(out).count() == 60
    tasks = lambda e: e.select(F.col("user_id").alias("project"), F.col("event_type").alias("kind"), F.col("event_id").alias("priority"))
    out = str(tmp_path / "queue")
    streams.start(streams.merged_tasks(tasks(read())), str(tmp_path / "cpq"), streams.batch_folder(out), "update").awaitTermination(120)
    got = {(r["project"], r["kind"]): (r["merged"], r["priority"]) for r in spark.read.parquet(out).collect()}
    assert sum(m for m, _ in got.values()) == 61 and got[0, "view"][1] == 0
