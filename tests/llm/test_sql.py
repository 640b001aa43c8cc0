from pathlib import Path

import pytest

from lodegraph.llm.queries import ORACLES, QUERIES
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, SF), ORACLES[name], oracle.connect(SF)) == ""


@pytest.mark.parametrize("name", ["op3_secrets", "op6_licenses"])
def test_sql_on_corner_texts(spark, name, tmp_path):
    from tests.llm.conftest import TEXTS
    from tests.llm.test_spans import random_texts

    from lodegraph.llm.licenses import NOTICES

    texts = TEXTS + random_texts(120, 9) + [f"intro {t} and more. {t[:60]}" for _, t in NOTICES] + [NOTICES[0][1].replace(" the ", " ") + " " + NOTICES[0][1]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "x"))
    next((tmp_path / "x").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    assert oracle.compare(QUERIES[name](spark, str(tmp_path)), ORACLES[name], oracle.connect(str(tmp_path))) == ""


def test_decontamination_sql_with_items_without_id(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(12))
    items = [(None, long), (None, "two words"), (3, "Two words"), (4, None), (None, None), (5, "plain item")]
    docs = [(0, f"before {long} after"), (1, "these two words here"), (2, "a plain item"), (3, "nothing at all"), (4, None), (None, f"{long} plain item two words"), (5, "w1 w2 w3")]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    got = QUERIES["op2_decontaminate"](spark, str(tmp_path))
    assert oracle.compare(got, ORACLES["op2_decontaminate"], oracle.connect(str(tmp_path))) == ""
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in got.collect()} == {0: (12, 1), 1: (2, 2), 2: (2, 1), 3: (0, 0), 4: (0, 0), None: (16, 3), 5: (0, 0)}
