import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodegraph.llm import packing
from lodegraph.llm.queries import ORACLES, QUERIES
from tests.llm import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    good = [" ".join(f"{w}{i}" for w in ("alpha", "beta", "gamma", "delta", "words", "stand", "here", "in", "rows", "and", "lines")) + ". Ordinary sentences follow, one after another." for i in range(40)]
    bad = [" | ".join(f"x{i}{j}" for j in range(30)) for i in range(20)]
    item = "seven quiet rivers met beside the ninth green mill before the evening rain fell"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good + bad)]
    rows += [(100, good[3], "en", "s", 1), (101, good[4] + " " + item, "en", "s", 1), (102, good[5].replace("5", "77") + " Write to ann@example.org please.", "en", "s", 1), (7, good[7], "en", "s", 1), (None, "A sentence that has no number of its own, but is fine.", "en", "s", 1), (103, None, None, None, None), (104, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(40, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, item


def test_stages(spark, folder):
    d, rows, item = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, d)
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    ids = lambda k: [r["doc_id"] for r in seen[k]]
    assert set(range(40)) <= set(ids("quality classifier")) and not set(range(40, 60)) & set(ids("quality classifier"))
    dedup = ids("MinHash near-dedup")
    assert 100 not in dedup and 3 in dedup and dedup.count(7) == 1
    clean = seen["benchmark decontamination"]
    assert 101 not in [r["doc_id"] for r in clean] and not [r for r in clean if item in (r["text"] or "")]
    masked = {r["doc_id"]: r["text"] for r in seen["PII"]}
    assert masked[102].endswith("Write to [EMAIL] please.") and not [t for t in masked.values() if t and brute.personal(t)]
    tokens = packing.public_tokens()
    packed = seen["best-fit packing"]
    assert sum(r["length"] for r in packed) == sum(len(tokens.ids(t)) + 1 for t in masked.values() if t)
    assert sorted(r["text"] or "" for r in packed) == sorted(t or "" for t in masked.values())


def test_corners_of_every_stage(spark, folder):
    """Nulls in any column, an empty table, texts of megabytes, repeated rows, columns by the operators' own names."""
    d, rows, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    long = "\n".join(f"Line {i} of a long and ordinary text, which says something about number {7 * i}." for i in range(30_000))
    extra = spark.createDataFrame([(900, long, "en", "s", 1), (900, long, "en", "s", 1), (901, " " * 1_000_000, None, None, None), (902, "x" * 1_000_000, "en", None, 2)], docs.schema)
    clash = {"row": F.lit("r"), "spans": F.lit("s"), "score": F.lit(1.5), "n_hit": F.lit(7), "key": F.lit("k"), "id": F.lit("i"), "mark": F.lit("m"), "candidates": F.lit("c"), "predicted": F.lit("p")}
    every = docs.union(extra).withColumns(clash)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, every, d)
        n = out.count()
        assert stage(spark, every.limit(0), d).count() == 0
        if name == corpus_pipeline.STAGES[-1][0]:
            got = {r["doc_id"]: r["chars"] for r in out.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars")).collect()}
            assert got[900] == 2 * len(long) and got[901] == got[902] == 1_000_000
        else:
            assert out.columns == every.columns
            assert out.where("row <> 'r' or spans <> 's' or score <> 1.5 or n_hit <> 7 or key <> 'k' or id <> 'i' or mark <> 'm' or candidates <> 'c' or predicted <> 'p'").count() == 0
            assert out.where("doc_id = 900").count() == {"MinHash near-dedup": 1}.get(name, 2), name
            assert n <= every.count()


def test_run_is_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.count() == out.select("doc_id", "piece").distinct().count()


def test_registered():
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(ORACLES) <= set(QUERIES)


def test_one_of_near_copies_with_null_ids_stays(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    docs = spark.createDataFrame([(None, a), (None, a + " more"), (5, b), (None, b + " more")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r["text"][0] for r in kept) == ["a", "b"] and (5, b) in [tuple(r) for r in kept]


def test_items_without_id_contaminate(spark, tmp_path):
    spark.createDataFrame([(None, "seven quiet rivers met")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "where seven quiet rivers met."), (2, "where six rivers met")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()] == [2]
