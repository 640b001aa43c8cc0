"""Projects, versions, dependencies and knowledge cards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import version, version_range


def compatible(target: str, low: Column, high: Column, listed: Column) -> Column:
    """Whether a target version suits: a list overrides a range; neither lets all through."""
    t = version(F.lit(target))
    in_list = F.exists(listed, lambda v: version(v) == t)
    above = low.isNull() | (version(low) <= t)
    below = high.isNull() | (t <= version(high))
    return F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, in_list).otherwise(above & below)


def parse_selector(text: str) -> list[tuple[str | None, str | None, str | None]]:
    """(product, low, high) of a comma-separated selector: product, product@1.2.3, product@1.2 (a line), product@1.0-1.4, or a version alone."""
    out = []
    for part in (p.strip() for p in text.split(",")):
        m = re.fullmatch(r"(?:([A-Za-z][\w.-]*?)(?:@|$))?(?:(\d+(?:\.\d+){0,2})(?:-(\d+(?:\.\d+){0,2}))?)?", part)
        if not part or not m:
            raise ValueError(f"not a version selector: {part!r}")
        product, a, b = m.groups()
        numbers = lambda v, fill: tuple((*map(int, v.split(".")), *(fill,) * (3 - len(v.split(".")))))
        if a is None:
            out.append((product, None, None))
            continue
        low, high = numbers(a, 0), numbers(b or a, 2**31 - 1)
        if low > high:
            raise ValueError(f"backwards range: {part!r}")
        out.append((product, ".".join(map(str, low)), ".".join(map(str, high))))
    return out


def selected(product: Column, version_text: Column, selector: str) -> Column:
    met = F.lit(False)
    for name, low, high in parse_selector(selector):
        one = (product == name) if name else F.lit(True)
        met = met | (one & version_range(version_text, low, high))
    return met


def scoped(projects: DataFrame, selector: str = "", project: int | None = None) -> DataFrame:
    """The projects (id, product, version) a request is about: all, those selected, or the one asked for. That one outside the selection is an error, not an empty result."""
    inside = projects.where(selected(F.col("product"), F.col("version"), selector)) if selector.strip() else projects
    if project is None:
        return inside
    one = inside.where(F.col("id") == project)
    if selector.strip() and one.isEmpty():
        raise ValueError(f"project {project} is not in {selector!r}")
    return one


def group_for_project(instance: Column, name: Column, path: Column) -> Column:
    """The version group of a project: its instance's, else one named in its name, else in its path, else other."""
    from_text = lambda c: F.nullif(F.regexp_extract(c, r"([a-zA-Z]+-\d+(?:\.\d+)*)", 1), F.lit(""))
    return F.coalesce(instance, from_text(name), from_text(path), F.lit("other"))


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """paths with the longest root that is a prefix of them by whole segments. Every prefix of a path is a key, so no pair is compared."""
    segments = F.split(F.col(path), "/")
    prefixes = paths.withColumn("__p", F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))))
    hits = prefixes.join(roots.select(F.col(root).alias("__p")).distinct(), "__p")
    best = hits.groupBy(*paths.columns).agg(F.max_by("__p", F.length("__p")).alias(root))
    return paths.join(best, paths.columns, "left")


def dependency_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """src, dst, action (create, update, delete, keep) that turns old dependencies into new ones. Both: src, dst, confidence."""
    o, n = old.select("src", "dst", F.col("confidence").alias("o")), new.select("src", "dst", F.col("confidence").alias("n"))
    action = F.when(F.col("o").isNull(), "create").when(F.col("n").isNull(), "delete").when(F.col("o") != F.col("n"), "update").otherwise("keep")
    return o.join(n, ["src", "dst"], "full_outer").select("src", "dst", action.alias("action"))


def project_scope(dependencies: DataFrame, top: int = 4) -> DataFrame:
    """project, other, confidence, kinds, place: a project's neighbours either way, at their best confidence, the surest first."""
    both = dependencies.select(F.col("src").alias("project"), F.col("dst").alias("other"), "confidence", "kind").union(dependencies.select("dst", "src", "confidence", "kind"))
    g = both.where("project <> other").groupBy("project", "other").agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.countDistinct("kind").alias("n"))
    w = Window.partitionBy("project").orderBy(F.desc("confidence"), F.desc("n"), "other")
    return g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).drop("n")


def card_status(flagged: Column, stale: Column, changed: Column, confidence: Column, least: float = 0.5) -> Column:
    return F.when(flagged, "flagged").when(stale, "stale").when(changed, "outdated").when(confidence < least, "low").otherwise("ok")


def one_card(cards: DataFrame, writer: str) -> DataFrame:
    """One card of each node: the preferred writer's, else the newest."""
    best = F.struct((F.col("writer") != writer).cast("int"), -F.unix_micros(F.col("built_at").cast("timestamp")), F.col("card"))
    return cards.groupBy("node").agg(F.min_by(F.struct("card", "writer", "built_at"), best).alias("b")).select("node", "b.card", "b.writer", "b.built_at")


def propagate_staleness(cards: DataFrame, links: DataFrame, changed: DataFrame) -> DataFrame:
    """node, state: stale where a source changed; check where a fresh card is linked to a stale node; else fresh. links: node, other."""
    stale = cards.join(changed.select("node").distinct(), "node", "left_semi").select("node", F.lit("stale").alias("s"))
    near = links.join(stale.select(F.col("node").alias("other")), "other", "left_semi").select("node").distinct().withColumn("n", F.lit("check"))
    return cards.select("node").join(stale, "node", "left").join(near, "node", "left").select("node", F.coalesce("s", "n", F.lit("fresh")).alias("state"))
