"""Incremental maintenance: change gates, patches, queues and caches, as keyed joins and folds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import settle


def change_gate(stored: DataFrame, scanned: DataFrame, index_version: int) -> DataFrame:
    """path, state (added, modified, removed, unchanged). stored: path, mtime, size, sha, version; scanned: path, mtime, size, sha.

    A file of another index version is modified; one of equal time and size is not read again; else its hash decides.
    """
    s, n = (df.select("path", *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "path"), F.lit(1).alias(f"{p}_is")) for df, p in ((stored, "o"), (scanned, "n")))
    state = (
        F.when(F.col("o_is").isNull(), "added")
        .when(F.col("n_is").isNull(), "removed")
        .when(F.col("o_version") != index_version, "modified")
        .when((F.col("o_mtime") == F.col("n_mtime")) & (F.col("o_size") == F.col("n_size")), "unchanged")
        .when(F.col("o_sha") == F.col("n_sha"), "unchanged")
        .otherwise("modified")
    )
    return s.join(n, "path", "full_outer").select("path", state.alias("state"))


def status_change(letter: Column) -> Column:
    first = F.upper(F.substring(letter, 1, 1))
    return F.when(first.isin("A", "C"), "added").when(first.isin("M", "T"), "modified").when(first == "D", "removed").when(first == "R", "renamed").when(first == "U", "unmerged")


#: What git's reflog actions, with the step that may stand in brackets after them, do to the head; inner: a step of a rebase that its end will report.
HEAD_MOVES = {
    "edit": ("commit", "commit initial", "cherry-pick", "revert", "am"),
    "rewrite": ("commit amend", "rebase finish", "rebase abort", "pull finish"),
    "integrate": ("commit merge", "merge", "pull"),
    "switch": ("checkout", "reset", "clone", "branch", "initial"),
    "inner": (*(f"rebase {step}" for step in ("start", "pick", "reword", "edit", "squash", "fixup", "continue", "skip")), "pull start", "pull pick"),
}


def head_move(message: Column) -> Column:
    """The kind of a reflog message by HEAD_MOVES: its first word, and the word in brackets before the colon; null for inner steps, unknown for others."""
    action = F.lower(F.trim(F.get(F.split(message, ":"), F.lit(0))))
    verb, step = F.get(F.split(action, " "), F.lit(0)), F.regexp_extract(action, r"\((\w+)\)", 1)
    table = F.create_map(*(F.lit(x) for kind, actions in HEAD_MOVES.items() for a in actions for x in (a, kind)))
    kind = F.coalesce(F.element_at(table, F.trim(F.concat_ws(" ", verb, step))), F.lit("unknown"))
    return F.nullif(kind, F.lit("inner"))


def task_plan(changed: Column, project_files: Column, switch_like: Column, primary: Column, max_files: int = 500, max_share: float = 0.3) -> tuple[Column, Column]:
    """(kind, priority) of the task for a change set: full-reindex over a share or number of files, else parse; null without changes."""
    over = (changed > max_files) | ((project_files > 0) & (changed / project_files > max_share))
    kind = F.when(changed == 0, F.lit(None).cast("string")).when(over, "full-reindex").otherwise("parse")
    return kind, F.when(changed == 0, F.lit(None).cast("int")).when(over | switch_like, 90).when(primary, 10).otherwise(50)


def merged_queue(tasks: DataFrame, max_paths: int = 5000) -> DataFrame:
    """One pending task for each (project, kind). tasks: id, project, kind, source, priority, paths, removed.

    Paths and removals since the newest git set (or of all tasks, without one) unite; a path that is both is
    no removal; over max_paths the lists are dropped and the task is full; the best priority stays.
    """
    key = ["project", "kind"]
    base = tasks.groupBy(*key).agg(F.max(F.when(F.col("source") == "git", F.col("id"))).alias("git_id"), F.min("priority").alias("priority"), F.max("id").alias("id"), F.count("*").alias("merged"))
    live = tasks.drop("priority").withColumnRenamed("id", "tid").join(base, key).where(F.col("git_id").isNull() | (F.col("tid") >= F.col("git_id")))
    lists = live.select(*key, F.explode(F.concat(F.transform(F.coalesce("paths", F.array()), lambda p: F.struct(p.alias("path"), F.lit(0).alias("gone"))), F.transform(F.coalesce("removed", F.array()), lambda p: F.struct(p.alias("path"), F.lit(1).alias("gone"))))).alias("x"))
    paths = lists.groupBy(*key, "x.path").agg(F.min("x.gone").alias("gone"))
    counted = paths.groupBy(*key).agg(F.count_if(F.col("gone") == 0).alias("paths"), F.count_if(F.col("gone") == 1).alias("removed"))
    out = base.join(counted, key, "left").na.fill(0, ["paths", "removed"])
    full = F.col("paths") + F.col("removed") > max_paths
    return out.select(*key, "id", "priority", "merged", F.when(full, 0).otherwise(F.col("paths")).alias("paths"), F.when(full, 0).otherwise(F.col("removed")).alias("removed"), full.alias("full"))


#: States of tasks that a worker may take.
CLAIMABLE = ("pending", "yielded")


def claim_order(tasks: DataFrame, now) -> DataFrame:
    """Tasks that are due and may be taken, with their turn: by priority, due time, id."""
    due = tasks.where(F.col("state").isin(*CLAIMABLE) & (F.col("due") <= F.lit(now)))
    return due.withColumn("turn", F.row_number().over(Window.partitionBy("lane").orderBy("priority", "due", "id")))


def backoff(attempts: Column, base: int, cap: int) -> Column:
    return F.least(F.lit(cap).cast("double"), base * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))))


def _after(tasks: DataFrame, now: dt.datetime, seconds: Column | float) -> Column:
    """A time so many seconds after now, of the type that due has; the text of now keeps it free of time zones."""
    wait = (F.lit(seconds) if isinstance(seconds, int | float) else seconds).cast("decimal(18,6)")
    return F.lit(now.isoformat(sep=" ")).cast(tasks.schema["due"].dataType) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait)


def _changed(tasks: DataFrame, which: Column, **new: Column) -> DataFrame:
    return tasks.select(*(F.when(which, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tasks.columns))


def _none(tasks: DataFrame, *columns: str) -> dict[str, Column]:
    return {c: F.lit(None).cast(tasks.schema[c].dataType) for c in columns}


def claimed(tasks: DataFrame, kinds: tuple[str, ...], owner: str, now: dt.datetime, lease: float) -> DataFrame:
    """tasks after a worker took the first due one of its kinds: it runs, is the worker's, and its lease ends after lease seconds.

    tasks here and below: id, kind, state, priority, due, attempts, max_attempts, owner, lease_until.
    """
    due = tasks.where(F.col("state").isin(*CLAIMABLE) & F.col("kind").isin(*kinds) & (F.col("due") <= _after(tasks, now, 0)))
    first = due.orderBy("priority", "due", "id").limit(1).select(F.col("id").alias("__first"))  # one row
    j = tasks.join(F.broadcast(first), F.col("id") == F.col("__first"), "left")
    return _changed(j, F.col("__first").isNotNull(), state=F.lit("running"), owner=F.lit(owner), lease_until=_after(tasks, now, lease)).drop("__first")


def renewed(tasks: DataFrame, owner: str, now: dt.datetime, lease: float) -> DataFrame:
    """tasks after a worker prolonged the leases of all that it runs."""
    return _changed(tasks, (F.col("state") == "running") & (F.col("owner") == owner), lease_until=_after(tasks, now, lease))


def completed(tasks: DataFrame, which: Column) -> DataFrame:
    return _changed(tasks, which, state=F.lit("done"), **_none(tasks, "owner", "lease_until"))


def failed(tasks: DataFrame, which: Column, now: dt.datetime, base: int, cap: int) -> DataFrame:
    """tasks after some failed: they wait for their next attempt, the longer the more they had, or have failed for good with their last."""
    tries = F.col("attempts") + 1
    last = tries >= F.col("max_attempts")
    state = F.when(last, "failed").otherwise("pending")
    due = F.when(last, F.col("due")).otherwise(_after(tasks, now, backoff(tries, base, cap)))
    return _changed(tasks, which, state=state, attempts=tries, due=due, **_none(tasks, "owner", "lease_until"))


def yielded(tasks: DataFrame, which: Column, now: dt.datetime, delay: float) -> DataFrame:
    """tasks after some were given back unfinished: no attempt is spent, and they come one place sooner."""
    return _changed(tasks, which, state=F.lit("yielded"), priority=F.greatest(F.lit(1), F.col("priority") - 1), due=_after(tasks, now, delay), **_none(tasks, "owner", "lease_until"))


def recovered(tasks: DataFrame, owner: str, now: dt.datetime, base: int, cap: int) -> DataFrame:
    """tasks after running ones that are another's, or whose lease ran out, failed."""
    lost = (F.col("state") == "running") & (~F.col("owner").eqNullSafe(F.lit(owner)) | (F.col("lease_until") < _after(tasks, now, 0)))
    return failed(tasks, lost, now, base, cap)


def embed_patch(items: DataFrame, state: DataFrame, cache: DataFrame, text_version: int, model: str) -> DataFrame:
    """node, action: skip (same hash, version and model), cached (its text was encoded for another node), encode, or orphan (state without a node; none while there are no nodes at all). items: node, hash; state: node, hash, version, model; cache: hash."""
    some = items.limit(1).select(F.lit(1).alias("__some"))
    s = state.select("node", F.col("hash").alias("s_hash"), "version", "model", F.lit(1).alias("s_is"))
    c = cache.select("hash").distinct().withColumn("c_is", F.lit(1))
    j = items.select("node", "hash", F.lit(1).alias("i_is")).join(s, "node", "full_outer").join(c, "hash", "left")
    same = (F.col("hash") == F.col("s_hash")) & (F.col("version") == text_version) & (F.col("model") == model)
    action = F.when(F.col("i_is").isNull(), "orphan").when(same, "skip").when(F.col("c_is").isNotNull(), "cached").otherwise("encode")
    out = j.select("node", action.alias("action"))
    return out.join(F.broadcast(some), on=F.lit(True), how="left").where((F.col("action") != "orphan") | F.col("__some").isNotNull()).drop("__some")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def graph_patch(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, action, from_key. old, new: key, body, line. Equal keys are kept or updated by body; a removed and an added symbol that alone share a body are a rename."""
    o, n = old.select("key", F.col("body").alias("ob"), F.lit(1).alias("o_is")), new.select("key", F.col("body").alias("nb"), F.lit(1).alias("n_is"))
    j = o.join(n, "key", "full_outer")
    gone = j.where("n_is is null").groupBy(F.col("ob").alias("b")).agg(F.count("*").alias("c"), F.min("key").alias("from_key")).where("c = 1").select("b", "from_key")
    come = j.where("o_is is null").groupBy(F.col("nb").alias("b")).agg(F.count("*").alias("c"), F.min("key").alias("to_key")).where("c = 1").select("b", "to_key")
    renamed = gone.join(come, "b").select("from_key", "to_key")
    j = j.join(renamed.select(F.col("to_key").alias("key"), "from_key"), "key", "left").join(renamed.select(F.col("from_key").alias("key"), "to_key"), "key", "left")
    action = F.when(F.col("from_key").isNotNull(), "renamed").when(F.col("o_is").isNull(), "added").when(F.col("to_key").isNotNull(), None).when(F.col("n_is").isNull(), "removed").when(F.col("ob").eqNullSafe(F.col("nb")), "kept").otherwise("updated")
    return j.select("key", action.alias("action"), "from_key").where("action is not null")


def within_budget(rows: DataFrame, by: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows of each group whose running size, in order, is within budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def focus(touches: DataFrame, ttl: str, cap: int) -> DataFrame:
    """session_start, session_end, project, touches, place: sessions of touches (at, project) no further apart than ttl; of each day the cap last touched."""
    s = touches.groupBy("project", F.session_window("at", ttl).alias("w")).agg(F.count("*").alias("touches"), F.max("at").alias("last"))
    w = Window.partitionBy(F.to_date("last")).orderBy(F.desc("last"), "project")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap).select("project", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "touches", "place")


def resolve(refs: DataFrame, symbols: DataFrame, ambiguous: bool = False) -> DataFrame:
    """ref, id, tier. refs: ref, name; symbols: id, qualified_name, name. Whole qualified name, else a name's end, else a bare name; a tier counts if it finds one symbol (or, with ambiguous, at its least id)."""
    tail = F.element_at(F.split(F.col("name"), r"::|\."), -1)
    r = refs.withColumn("tail", tail)
    # each name is one row with its number of symbols and the least, so no reference meets every symbol of a popular name
    counted = lambda keys: keys.groupBy("name").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    # every suffix after a separator is a key, so the ends meet in an equality join
    parts = F.split(F.col("qualified_name"), "::")
    ends = symbols.select("id", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))).alias("name")).where("name <> ''")
    exact = r.join(counted(symbols.select("id", F.col("qualified_name").alias("name"))), "name").select("ref", F.lit(1).alias("tier"), "n", "id")
    suffix = r.join(counted(ends), "name").select("ref", F.lit(2).alias("tier"), "n", "id")
    bare = r.join(counted(symbols.select("id", "name")).withColumnRenamed("name", "tail"), "tail").select("ref", F.lit(3).alias("tier"), "n", "id")
    tiers = exact.union(suffix).union(bare)
    good = tiers if ambiguous else tiers.where("n = 1")
    return good.groupBy("ref").agg(F.min(F.struct("tier", "id")).alias("t")).select("ref", F.col("t.id").alias("id"), F.col("t.tier").alias("tier"))


def pending(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References (ref, tail) whose tail is no known symbol's; they wait for a later patch."""
    return refs.join(known.select("tail").distinct(), "tail", "left_anti")


def running_total(rows: DataFrame, order: str, value: str) -> DataFrame:
    """rows with before: the sum of value over all rows of lesser order (a key). Each range of keys is summed, and a row adds the ranges before to what stands before it in its own."""
    dealt = settle(rows.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id()))
    per = dealt.groupBy("__part").agg(F.sum(value).alias("__s"))  # a row for each partition
    start = per.withColumn("__before", F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).drop("__s")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__in", inside).join(F.broadcast(start), "__part").withColumn("before", F.col("__before") + F.col("__in")).drop("__part", "__before", "__in")


def grouped_batches(keys: DataFrame, rows: int) -> DataFrame:
    """key, n, batch: keys (with n rows each) in batches of about so many rows; a key is never split."""
    return running_total(keys, "key", "n").select("key", "n", F.floor(F.col("before") / rows).alias("batch"))


def rescue(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """stale, id: for hits (stale, qualified_name, at) the symbol (id, qualified_name, size) of their name whose size is nearest to at, the least id among equals; a missing size is farthest.

    One row stands for all symbols of a name and size, and one for all hits of a name and place. The nearest lies next
    to them in the order of sizes, so a popular name makes no pairs.
    """
    least = symbols.where("qualified_name is not null").groupBy("qualified_name", "size").agg(F.min("id").alias("id"))
    asked = hits.where("qualified_name is not null").groupBy("qualified_name", F.col("at").alias("size")).agg(F.lit(True).alias("asked"))
    points = least.where("size is not null").withColumn("c", F.struct("size", "id")).select("qualified_name", "size", "c").join(asked.where("size is not null"), ["qualified_name", "size"], "full")
    near = lambda order: F.last("c", True).over(Window.partitionBy("qualified_name").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    far = lambda c: F.struct(F.abs(c["size"] - F.col("size")).alias("d"), c["id"].alias("id"))
    both = points.withColumns({"below": near(F.asc("size")), "above": near(F.desc("size"))}).where("asked")
    best = both.withColumn("best", F.least(F.when(F.col("below").isNotNull(), far(F.col("below"))), F.when(F.col("above").isNotNull(), far(F.col("above"))))).select("qualified_name", F.col("size").alias("at"), "best")
    # where one of both sizes is missing, all distances are: the least id of the name
    names = least.groupBy("qualified_name").agg(F.min("id").alias("any"))
    found = hits.join(names, "qualified_name").join(best, ["qualified_name", "at"], "left")
    key = F.struct(F.col("best").isNull().alias("missing"), F.col("best.d").alias("d"), F.coalesce("best.id", "any").alias("id"))
    return found.groupBy("stale").agg(F.min(key).alias("k")).select("stale", "k.id")
