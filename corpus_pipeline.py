"""The corpus pipeline: documents through the operators of lodegraph.llm, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import durable, table
from lodegraph.llm.decontaminate import decontaminate
from lodegraph.llm.native_spans import masked
from lodegraph.llm.near_dedup import near_duplicates, text_mark
from lodegraph.llm.packing import pack_documents, public_tokens
from lodegraph.llm.pii import find_personal
from lodegraph.llm.quality import score_quality, train_quality


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good.

    Null texts are judged as empty ones, and both by the score of a text without lines; texts are judged whole,
    however long; repeated rows stay or go together; an empty table stays empty; other columns, whatever their
    names, are carried in one and given back.
    """
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    kept = score_quality(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("__text")), model, text_col="__text", keep=["row"])
    return kept.where(F.col("predicted") == 1).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the first by id, and one row where that row is repeated.

    Null and empty texts are one class and texts of any length another each, as near_duplicates has it; a null
    id comes after all others; an empty table stays empty. doc_id and text are read; all columns are given
    back but __id and __mark, which must not be among them.
    """
    classes = durable(near_duplicates(docs), "classes")
    marked = docs.withColumns({"__id": F.col("doc_id"), "__mark": text_mark("text")})

    def of(rows: DataFrame):
        return marked["__id"].eqNullSafe(rows["doc_id"]) & (marked["__mark"] == rows["mark"])

    gone = classes.where(~F.col("first")).select("doc_id", "mark").distinct()
    repeated = classes.where("first").groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark")
    if repeated.isEmpty():
        return marked.join(gone, of(gone), "left_anti").select(*docs.columns)
    repeated = durable(repeated, "repeated")
    more = gone.union(repeated)
    single = marked.join(more, of(more), "left_anti")
    several = marked.join(repeated, of(repeated), "left_semi")
    return single.unionByName(several.dropDuplicates(["__id", "__mark"])).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts have none and stay; texts are scanned whole; repeated rows stay or go together; an
    empty table stays empty, and an empty benchmark drops nothing; other columns are carried in one and given
    back.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("__text"))
    found = decontaminate(rows, table(spark, sf_dir, "benchmark"), text_col="__text", keep=["row"])
    return found.where(F.col("n_hit") == 0).select("row.*")


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; n_chars follows the text.

    Null texts stay null, empty ones empty; texts are masked whole; repeated rows each get their row; an empty
    table stays empty; other columns are carried in one and given back as they were.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("__text"))
    found = find_personal(rows, text_col="__text").select("row", F.when(F.col("__text").isNotNull(), masked(F.col("__text"), F.col("spans"))).alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its text, and its place in a bin.

    Null and empty texts get a row without a bin; long ones are cut into pieces, which lose nothing; repeated
    rows are packed each on their own; an empty table gives no row; other columns than doc_id and text are not
    read.
    """
    return pack_documents(docs, public_tokens())


STAGES = [
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal),
    ("best-fit packing", pack),
]

#: The classifier's, the signatures' and the packing's arithmetic is not SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
