import datetime as dt
import pickle
import random
import time
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodegraph import registry, session
from lodegraph.operators import flows, graph
from lodegraph.sources import tables
from tests.oracle import compare, connect


def calls(spark, pairs):
    return spark.createDataFrame([(i, a, b, "click", 0.5 + i % 7 / 10) for i, (a, b) in enumerate(pairs)], "edge_id long, src long, dst long, edge_type string, confidence double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def drawn(seed, nodes=60, edges=170):
    r = random.Random(seed)
    return [(r.randrange(nodes), r.randrange(nodes)) for _ in range(edges)]


@pytest.fixture(scope="module")
def layered(tmp_path_factory):
    """Tables whose 60 entries each reach all 12 layers of 20 nodes: 1,000 calls, over 12,000 pairs of entry and node. Each call is an hour of its own."""
    d = tmp_path_factory.mktemp("layered")
    pairs = [(i, 100 + (i + j) % 20) for i in range(60) for j in range(4)] + [(100 + 20 * layer + i, 120 + 20 * layer + (i + j) % 20) for layer in range(12) for i in range(20) for j in range(3)]
    at = lambda i, s: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i, seconds=s)
    e = [(2 * i + s, at(i, s), pair[s], "click", 60.0 + i % 9, '{"k": 1}') for i, pair in enumerate(pairs) for s in (0, 1)]
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    pq.write_table(pa.table({n: pa.array([x[i] for x in e], pa.timestamp("us") if n == "ts" else None) for i, n in enumerate(names)}), d / "events.parquet")
    ids = [i for i in range(400) if i % 10 != 3]
    pq.write_table(pa.table({"c_custkey": ids, "c_name": [f"c{i}" for i in ids], "c_nationkey": pa.array([i // 200 for i in ids], pa.int32()), "c_acctbal": [0.0] * len(ids), "c_mktsegment": ["X"] * len(ids)}), d / "customer.parquet")
    return str(d), len(pairs)


def written(spark, name, d):
    """The query's rows against its SQL, and the most rows of a table that it wrote meanwhile."""
    since = len(session._written)
    said = compare(registry.queries()[name](spark, d), registry.oracles()[name], connect(d))
    return said, max(sum(pq.read_metadata(p).num_rows for p in Path(t.removeprefix("file://")).glob("*.parquet")) for t in session._written[since:])


def test_change_risk_writes_no_walk(spark, layered):
    said, most = written(spark, "g21_change_risk", layered[0])
    assert said == "" and most <= layered[1]


def test_flows_walked_as_by_joins(spark):
    """From entries that are called and that are not. What the joins find is read from their flows by plain Python."""
    e = calls(spark, drawn(1))
    chosen = spark.createDataFrame([(i,) for i in [*range(0, 60, 4), 999]], "id long")
    label = {i: None if i % 5 == 0 else i % 3 for i in range(50)}
    labels = spark.createDataFrame(list(label.items()), "id long, label int")
    a = flows.Flows(e, chosen)
    found = rows(flows.Flows(e, chosen, max_edges=0, max_pairs=400).paths())
    nodes = {p: [int(x) for x in p.split(">")] for _, p in found}
    assert found and rows(a.paths()) == found
    assert rows(a.through(spark.range(3, 9))) == [(i, p) for i, p in found if set(nodes[p]) & set(range(3, 9))]
    assert rows(a.seconds()) == sorted({(n[1],) for n in nodes.values()})
    known = {p: [label[i] for i in n if i in label] for p, n in nodes.items()}
    assert rows(a.assembled(labels)) == [(i, p, len(known[p]), "cross" if len({x for x in known[p] if x is not None}) > 1 else "intra") for i, p in found if known[p]]
    assert a.steps(labels).count() == sum(map(len, known.values()))
    assert rows(a.maximal()) == rows(graph.maximal_paths(a.paths())) != found


def test_no_flows(spark):
    for f in (flows.Flows(calls(spark, [(1, 1)])), flows.Flows(calls(spark, [(1, 2)]))):
        assert rows(f.paths()) == rows(f.seconds()) == rows(f.maximal()) == rows(f.through(spark.range(3))) == []
        assert rows(f.assembled(spark.createDataFrame([(1, 1)], "id long, label int"))) == []


def test_a_long_flow_ends_at_ten_calls(spark):
    f = flows.Flows(calls(spark, [(i, i + 1) for i in range(20)]))
    assert rows(f.paths()) == [(0, ">".join(f"{i:012d}" for i in range(11)))]


def test_cycles_are_searched_until_enough_are_found(spark):
    """200 nodes that all call ten others; one turn of ten visits at most 2,000 pairs, all nodes' walks 40,000."""
    e = calls(spark, [(i, (i * 7 + j * 13 + 1) % 200) for i in range(200) for j in range(10)])
    since = len(session._written)
    got = rows(graph.first_cycles(e, spark.range(200), 10, 10))
    left = sum(pq.read_metadata(p).num_rows for t in session._written[since:] for p in Path(t.removeprefix("file://")).glob("*.parquet"))
    assert left == 2200  # calls and ids; what turns wrote is gone
    assert got == rows(graph.reach(e, spark.range(10), 10).where("source = node").select("source", "depth"))


def test_later_turns_find_what_is_left(spark):
    """A ring too long to count, with a loop and a pair at its end; turns of two pairs."""
    e = calls(spark, [*((i, (i + 1) % 15) for i in range(15)), (12, 12), (13, 14), (14, 13)])
    assert rows(graph.first_cycles(e, spark.range(15), 10, 5, max_pairs=60)) == [(12, 1), (13, 2), (14, 2)]


@pytest.mark.parametrize("name", ["g18_maximal_flows", "g19_flow_types", "g19_flow_steps", "g17_traced_flows", "g20_flows_of_node"])
def test_flow_queries_write_no_walk(spark, layered, name):
    said, most = written(spark, name, layered[0])
    assert said == "" and most <= layered[1]


def test_maximal_flows_of_called_entries_are_not_written(spark):
    """All 60 entries and 20 called ones; their flows outnumber what is written: calls and ids."""
    e = calls(spark, [(i, 100 + (i + j) % 20) for i in range(60) for j in range(4)] + [(100 + 20 * layer + i, 120 + 20 * layer + (i + j) % 20) for layer in range(6) for i in range(20) for j in range(3)])
    f = flows.Flows(e, spark.createDataFrame([(i,) for i in [*range(60), *range(100, 120)]], "id long"))
    joined = flows.Flows(e, f.entries, max_edges=0)
    paths = rows(f.paths())
    since = len(session._written)
    found = rows(f.maximal())
    most = max(sum(pq.read_metadata(p).num_rows for p in Path(t.removeprefix("file://")).glob("*.parquet")) for t in session._written[since:])
    assert found == [(i, p) for i, p in paths if not any(len(q) > len(p) and p in q for _, q in paths)] == rows(joined.maximal())
    assert len(found) < len(paths) and most <= 80 < len(paths)


@pytest.mark.parametrize("name", ["g17_traced_flows", "g18_maximal_flows", "g19_flow_types", "g19_flow_steps", "g20_flows_of_node"])
def test_flow_queries_shuffle_no_flow(spark, layered, name):
    """No exchange but broadcasts of names stands above the walk, so flows stay off the disk when they are read."""
    df = registry.queries()[name](spark, layered[0])
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in above.replace("BroadcastExchange", "") and "Sort" not in above


def test_flow_steps_come_numbered_from_the_walk(spark, layered):
    """Above the walk no path is taken apart again; a flow's nodes are explode's only input."""
    df = registry.queries()["g19_flow_steps"](spark, layered[0])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan[: plan.index("MapInArrow")]
    e = calls(spark, drawn(2))
    names = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id long, name string")
    walked, joined = flows.Flows(e), flows.Flows(e, max_edges=0)
    expected = sorted((i, p, s, int(n), f"n{int(n)}") for i, p in rows(joined.paths()) for s, n in enumerate(p.split(">")) if int(n) < 50)
    assert expected and rows(walked.steps(names).select("entry", "path", "step", "node", "name")) == expected == rows(joined.steps(names).select("entry", "path", "step", "node", "name"))


def test_little_of_a_graph_is_sent(spark):
    """Ids, calls and their counts; what a worker makes of them is the graph, also with ids below 0 and of over 12 digits."""
    pairs = drawn(3, 2000, 6000)
    g = flows._Graph(spark.createDataFrame(pairs, "src long, dst long"))
    assert len(pickle.dumps(g)) < 4 * (len(g.adj) + g.n) + 1000
    for p in ([], pairs, [(-5, 10**12 + 7), (10**12 + 7, 3), (10**15, -5), (3, 10**15)]):
        g = flows._Graph(spark.createDataFrame(p, "src long, dst long"))
        h = pickle.loads(pickle.dumps(g))
        assert g.n == h.n and all((getattr(g, x) == getattr(h, x)).all() for x in ("sorted", "place", "ids", "names", "adj", "at"))
        assert sorted((int(g.ids[s]), int(g.ids[d])) for s in range(g.n) for d in g.adj[g.at[s] : g.at[s + 1]]) == sorted(p)


@pytest.mark.parametrize("turn", [1, 64])
def test_least_second_node(spark, monkeypatch, turn):
    """Whatever the turns; on graphs where first callees often call nothing, and where no flow is."""
    monkeypatch.setattr(flows, "_TURN", turn)
    for seed in range(3):
        r = random.Random(seed)
        f = flows.Flows(calls(spark, [(100 + r.randrange(40), r.randrange(40)) for _ in range(60)] + [(r.randrange(20, 40), 200 + r.randrange(9)) for _ in range(12)]))
        seconds = [s for (s,) in rows(f.seconds())]
        assert seconds and rows(f.least_second()) == [(min(seconds),)]
    assert rows(flows.Flows(calls(spark, [(1, 2), (3, 2)])).least_second()) == [(None,)]


def test_flows_of_a_node_walk_what_comes_to_it(spark, monkeypatch):
    """200 entries of chains of their own: the graph is sent once, and not all are walked for the least second node, nor more than one for its flows."""
    e = calls(spark, [(1000 * i + j, 1000 * i + j + 1) for i in range(200) for j in range(4)])
    sent, walked = [], []
    broadcast, repartition = type(spark.sparkContext).broadcast, type(e).repartition
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, x: sent.append(type(x)) or broadcast(sc, x))
    monkeypatch.setattr(type(e), "repartition", lambda df, n, *by: walked.append(df.count()) or repartition(df, n, *by))
    f = flows.Flows(e)
    assert rows(f.through(f.least_second())) == [(0, ">".join(f"{i:012d}" for i in range(5)))]
    assert sent == [flows._Graph] and walked == [64, 1]


def test_names_are_not_shuffled(spark, monkeypatch):
    """Those of nodes with a call are told where they are read, also where ids are null or of another width, and entries come from the graph."""
    monkeypatch.setattr(flows, "uncalled", lambda step: step.selectExpr("src AS id").limit(0))
    f, settled = flows.Flows(calls(spark, [(1, 2), (2, 3), (4, 2)])), []
    settle = flows.settle
    monkeypatch.setattr(flows, "settle", lambda df, **how: settled.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df, **how))
    names = spark.createDataFrame([(1, "a"), (3, "c"), (None, "x"), (0, "o"), (9, "z")], "id int, name string")
    at = lambda *x: ">".join(f"{i:012d}" for i in x)
    assert rows(f.steps(names).select("entry", "path", "step", "node", "name")) == [(1, at(1, 2, 3), 0, 1, "a"), (1, at(1, 2, 3), 2, 3, "c"), (4, at(4, 2, 3), 2, 3, "c")]
    assert settled and not any("Exchange" in plan for plan in settled)


def test_sure_edges_are_the_edges(spark, layered):
    """With fewer fields in the shuffle; values below least still end what comes before."""
    for kind, least in (("click", 0.65), ("click", 0.0), ("none", 0.5)):
        expected = rows(tables.edges(spark, layered[0]).where((tables.F.col("edge_type") == kind) & (tables.F.col("confidence") >= least)).select("src", "dst", "confidence"))
        assert rows(tables.sure_edges(spark, layered[0], kind, least)) == expected and bool(expected) == (kind == "click")
    plan = tables.sure_edges(spark, layered[0], "click", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_what_is_shuffled_for_calls_is_deleted(spark):
    """Flows of a graph leave no shuffle but the counts'; the session's setting is as before, also after a failure."""
    folder = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    held = lambda: sum(p.stat().st_size for p in folder.rglob("shuffle_*.data") if p.exists())
    e = calls(spark, drawn(4, 20000, 60000))
    before = held()
    f = flows.Flows(e)
    until = time.time() + 20
    while (left := held() - before) > 50_000 and time.time() < until:
        time.sleep(0.2)
    assert f.small and left <= 50_000
    assert spark.conf.get(session._CLEANUP, None) is None
    with pytest.raises(Exception, match="no such thing"):
        session.settle(spark.range(1).selectExpr("raise_error('no such thing') AS x"), tidy=True)
    assert spark.conf.get(session._CLEANUP, None) is None
