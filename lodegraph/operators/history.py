"""The change log: histograms, histories, net effects and point-in-time replay.

changes: id, at, symbol, change (added, modified, removed), signature, file, run, kind. Events are ordered
by (at, id). Windows hold both ends, replay takes what is strictly later.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lodegraph.functions.text import parameter_count


def time_argument(text: str | None, now: dt.datetime, fallback: dt.datetime | None = None) -> dt.datetime:
    """-7d, -24h, -30m, -10s from now; now or current; an ISO time; nothing is the fallback."""
    if text is None or text.strip() == "":
        return fallback or now
    t = text.strip().lower()
    if t in ("now", "current"):
        return now
    if m := re.fullmatch(r"-(\d+)([dhms])", t):
        return now - dt.timedelta(**{{"d": "days", "h": "hours", "m": "minutes", "s": "seconds"}[m[2]]: int(m[1])})
    try:
        return dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00")).replace(tzinfo=None)
    except ValueError:
        raise ValueError(f"not a time: {text!r}") from None


def between(changes: DataFrame, start, end) -> DataFrame:
    return changes.where((F.col("at") >= F.lit(start)) & (F.col("at") <= F.lit(end)))


def histogram(changes: DataFrame, unit: str) -> DataFrame:
    """bucket, added, modified, removed, total; only buckets with changes; weeks begin on Monday."""
    counts = {k: F.count_if(F.col("change") == k) for k in ("added", "modified", "removed")}
    return changes.groupBy(F.date_trunc(unit, "at").alias("bucket")).agg(*(c.alias(k) for k, c in counts.items()), F.count("*").alias("total"))


def activity(changes: DataFrame) -> DataFrame:
    """dimension, value, n: counts by change, by kind and in all, from one pass."""
    one = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    every = changes.select(F.inline(F.array(one("change", F.col("change")), one("kind", F.col("kind")), one("all", F.lit("")))))
    return every.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def ordered() -> Column:
    return F.struct("at", "id")


def net_changes(changes: DataFrame) -> DataFrame:
    """symbol, net: the effect of a window by its first and last change of each symbol."""
    ends = changes.groupBy("symbol").agg(F.min_by("change", ordered()).alias("first"), F.max_by("change", ordered()).alias("last"), F.count("*").alias("n"))
    return ends.select("symbol", "n", F.when(F.col("last") == "removed", "removed").when(F.col("first") == "added", "added").otherwise("modified").alias("net"))


def symbol_history(changes: DataFrame) -> DataFrame:
    """symbol, first_seen, last_modified, modified, churn (signatures that differ from the one before), gone."""
    w = Window.partitionBy("symbol").orderBy("at", "id")
    before = F.lag("signature").over(w)
    moved = changes.withColumn("moved", F.when(before.isNotNull() & (before != F.col("signature")), 1).otherwise(0))
    return moved.groupBy("symbol").agg(
        F.min("at").alias("first_seen"), F.max("at").alias("last_modified"), F.count_if(F.col("change") == "modified").alias("modified"), F.sum("moved").alias("churn"), (F.max_by("change", ordered()) == "removed").alias("gone")
    )


def recent_by_file(changes: DataFrame, per_file: int, files: int) -> DataFrame:
    """file, total, place, id, symbol, change: the newest per_file changes of the files changed most."""
    top = changes.groupBy("file").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "file").limit(files)
    w = Window.partitionBy("file").orderBy(F.desc("at"), F.desc("id"))
    kept = changes.join(F.broadcast(top), "file").withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_file)
    return kept.select("file", "total", "place", "id", "symbol", "change")


def replay(changes: DataFrame, current: DataFrame, at) -> DataFrame:
    """symbol, signature as of a time, from the current symbols and the changes after it.

    The earliest addition or removal after the time decides presence (added: absent; removed: present with
    that signature); the earliest modification before it, or of all where there is none, then gives the
    signature of a symbol that is present.
    """
    later = changes.where(F.col("at") > F.lit(at))
    decides = F.col("change").isin("added", "removed")
    d = later.groupBy("symbol").agg(F.min(F.when(decides, ordered())).alias("d_at"), F.min_by(F.when(decides, F.struct("change", "signature")), F.when(decides, ordered())).alias("d"), F.min_by(F.when(~decides, F.col("signature")), F.when(~decides, ordered())).alias("m_sig"), F.min(F.when(~decides, ordered())).alias("m_at"))
    j = current.select("symbol", F.col("signature").alias("now"), F.lit(True).alias("is_now")).join(d, "symbol", "full_outer")
    present = F.when(F.col("d").isNotNull(), F.col("d.change") == "removed").otherwise(F.coalesce("is_now", F.lit(False)))
    base = F.when(F.col("d").isNotNull(), F.col("d.signature")).otherwise(F.col("now"))
    use_m = F.col("m_at").isNotNull() & (F.col("d_at").isNull() | (F.col("m_at") < F.col("d_at")))
    return j.where(present).select("symbol", F.when(use_m, F.col("m_sig")).otherwise(base).alias("signature"))


def symbol_diff(before: DataFrame, after: DataFrame, key: str = "symbol", value: str = "signature") -> DataFrame:
    """key, change: what makes before into after; unchanged rows are left out."""
    a, b = before.select(key, F.col(value).alias("old"), F.lit(1).alias("was")), after.select(key, F.col(value).alias("new"), F.lit(1).alias("is_"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is_").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return j.select(key, change.alias("change"), "old", "new").where(F.col("change").isNotNull())


def explain_change(change: Column, before: Column, after: Column) -> Column:
    """A label of a symbol change, from the signatures before and after."""
    type_of = lambda s: F.regexp_extract(s, r"^(\S+)\s", 1)
    return (
        F.when(change != "modified", change)
        .when(before.eqNullSafe(after), "body changed")
        .when(parameter_count(before) != parameter_count(after), "parameters changed")
        .when(type_of(before) != type_of(after), "return type changed")
        .otherwise("signature changed")
    )


def run_at(runs: DataFrame, at) -> DataFrame:
    """The latest run (run, ...) that began at or before a time."""
    return runs.where(F.col("run") <= F.lit(at)).agg(F.max_by(F.struct(*runs.columns), "run").alias("r")).select("r.*").where(F.col("run").isNotNull())


def as_of(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, values: list[str], bucket: str = "month", width: int = 4096) -> DataFrame:
    """left with values of the latest right row of the same key at or before left_at.

    Rows are sorted by time within a key's bucket only; what held when a bucket began comes from the last rows
    of the key's earlier buckets, one each. So a key of any length is dealt to many tasks. Times are
    timestamps, in buckets by the calendar, or numbers, in buckets of width.
    """
    number = isinstance(right.schema[right_at].dataType, NumericType)
    at = lambda c: F.floor(F.col(c) / width) if number else F.date_trunc(bucket, F.col(c))
    marks = right.where(F.col(right_at).isNotNull()).select(by, F.col(right_at).alias("__t"), at(right_at).alias("__b"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c != by))
    rows = left.select(by, F.col(left_at).alias("__t"), at(left_at).alias("__b"), F.lit(1).alias("__side"), F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"), *(c for c in left.columns if c != by))
    w = Window.partitionBy(by, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.union(rows).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    ends = marks.groupBy(by, "__b").agg(F.max_by("__v", "__t").alias("__v"))
    buckets = ends.unionByName(rows.select(by, "__b").distinct().withColumn("__v", F.lit(None).cast(ends.schema["__v"].dataType))).groupBy(by, "__b").agg(F.max("__v").alias("__v"))
    carried = buckets.withColumn("__c", F.last("__v", ignorenulls=True).over(Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).where("__c is not null").select(F.col(by).alias("__k"), F.col("__b").alias("__kb"), "__c")
    joined = found.join(carried, (found[by] == carried["__k"]) & (found["__b"] == carried["__kb"]), "left").withColumn("__v", F.coalesce("__v", "__c"))
    return joined.select(*left.columns, *(F.col("__v")[v].alias(v) for v in values))


def neighbours(symbols: DataFrame, by: str, order: list[Column], k: int, is_centre: Column) -> DataFrame:
    """Rows within k places of a centre in their group's order, with their offset to the nearest centre (the earlier, if tied)."""
    w = Window.partitionBy(by).orderBy(*order)
    s = symbols.withColumn("place", F.row_number().over(w)).withColumn("centre", F.when(is_centre, F.col("place")))
    before = F.last("centre", ignorenulls=True).over(w.rowsBetween(-k, 0))
    after = F.first("centre", ignorenulls=True).over(w.rowsBetween(0, k))
    near = s.withColumns({"b": F.col("place") - before, "a": F.col("place") - after})
    return near.where(F.col("a").isNotNull() | F.col("b").isNotNull()).withColumn("offset", F.when(F.col("a").isNull() | (F.col("b") <= -F.col("a")), F.col("b")).otherwise(F.col("a"))).drop("a", "b", "centre")
