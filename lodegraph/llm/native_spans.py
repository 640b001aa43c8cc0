"""Spans of regular expressions with their offsets, from built-in functions alone.

split() gives the text between the matches of a pattern and regexp_extract_all() the matches themselves;
both find leftmost non-overlapping matches, so running sums of their lengths are offsets in code points.

Arrays are gone through in groups of GROUP entries, and cuts of a text in groups of groups, since adding an
entry to an array copies it and finding a place in a text passes over all before it: running totals and cuts
cost about a constant for each entry and character, up to millions of spans in a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: s, e: start and end (exclusive); m: the match; g: the group asked for; b, a: what stands shortly before and after.
MATCH = "array<struct<s:int,e:int,m:string,g:string,b:string,a:string>>"
CONTEXT = 40
#: Entries of a group; levels of groups in running totals and in cuts.
GROUP, LEVELS, CUT_LEVELS = 128, 1, 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once; lambdas would evaluate an expression of their surroundings at every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grouped(xs: Column, group: int = GROUP) -> Column:
    """xs in arrays of group entries; the last may be shorter; none for an empty one."""
    n = F.size(xs)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / group).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(xs, i * group + 1, F.lit(group)))


def _before(xs: Column, kind: str, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each entry of a short array the total of those before it, and the total of all as one entry more."""
    start = F.array(zero.cast(kind))
    return F.aggregate(xs, start, lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x).cast(kind))))


def totals_before(xs: Column, kind: str, zero: Column, join: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """For each entry of xs the total (by join, an associative function) of the entries before it; zero for the first."""
    if not levels:
        return let(_before(xs, kind, zero, join), lambda t: F.slice(t, F.lit(1), F.size(t) - 1))

    def put_together(local: Column) -> Column:
        sums = F.transform(local, lambda t: F.element_at(t, -1))
        return let(
            totals_before(sums, kind, zero, join, levels - 1),
            lambda base: F.flatten(F.transform(local, lambda t, i: F.transform(F.slice(t, F.lit(1), F.size(t) - 1), lambda x: join(F.get(base, i), x)))),
        )

    many = lambda ys: let(F.transform(grouped(ys), lambda g: _before(g, kind, zero, join)), put_together)
    return let(xs, lambda ys: F.when(F.size(ys) <= GROUP, totals_before(ys, kind, zero, join, 0)).otherwise(many(ys)))


def find_all(text: Column, pattern: str, where: Column, group: int = 0) -> Column:
    """All matches of pattern as MATCH, in order. where says cheaply whether a text can have any; the pattern never matches nothing."""
    size = F.length
    none = F.array().cast(MATCH)

    def located(xs: Column, sizes: Column) -> Column:
        # sizes: of the text before each match and of the match itself
        at = totals_before(F.transform(sizes, lambda z: z["p"] + z["m"]), "int", F.lit(0), lambda a, b: a + b)
        return let(
            at,
            lambda starts: F.transform(
                xs,
                lambda x, i: let(
                    F.get(starts, i) + F.get(sizes, i)["p"],
                    lambda s: F.struct(s.alias("s"), (s + F.get(sizes, i)["m"]).alias("e"), x["m"].alias("m"), x["g"].alias("g"), F.right(x["p"], F.lit(CONTEXT)).alias("b"), F.left(x["n"], F.lit(CONTEXT)).alias("a")),
                ),
            ),
        )

    def zipped(between: Column) -> Column:
        ms = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gs = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.transform(between, lambda p: F.lit(""))
        return F.arrays_zip(F.slice(between, 1, F.size(between) - 1).alias("p"), ms.alias("m"), F.slice(gs, 1, F.size(between) - 1).alias("g"), F.slice(between, 2, F.size(between)).alias("n"))

    spans = let(
        let(F.split(text, pattern, -1), lambda between: F.when(F.size(between) > 1, zipped(between))),
        lambda xs: F.when(xs.isNull(), none).otherwise(let(F.transform(xs, lambda x: F.struct(size(x["p"]).alias("p"), size(x["m"]).alias("m"))), lambda sizes: located(xs, sizes).cast(MATCH))),
    )
    return F.when(where, spans).otherwise(none)


#: s, k (the kind's place in the order of kinds), e, kind.
SPAN = "array<struct<s:int,k:int,e:int,kind:string>>"


def as_spans(found: Column, k: int, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of others, in order: in the order of starts, the others before one must end by its start, and those after it begin at its end or later."""
    tagged = lambda xs, own: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x.alias("x")))
    top = 2**31 - 1

    def kept(every: Column) -> Column:
        ends = F.transform(every, lambda y: F.when(y["own"] == 0, y["x"]["e"]).otherwise(0))
        starts = F.reverse(F.transform(every, lambda y: F.when(y["own"] == 0, y["s"]).otherwise(top)))
        before = totals_before(ends, "int", F.lit(0), lambda a, b: F.greatest(a, b))
        after = totals_before(starts, "int", F.lit(top), lambda a, b: F.least(a, b))
        return let(
            F.struct(before.alias("b"), F.reverse(after).alias("a")),
            lambda t: F.transform(F.filter(every, lambda y, i: (y["own"] == 1) & (F.get(t["b"], i) <= y["s"]) & (F.get(t["a"], i) >= y["x"]["e"])), lambda y: y["x"]),
        )

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(F.array_sort(F.concat(tagged(spans, 1), tagged(others, 0))), kept))


def cut(text: Column, starts: Column, levels: int = CUT_LEVELS) -> Column:
    """The parts of text from each of the ascending starts (from 0) to the next one, the last to the end."""
    flat = lambda xs: F.transform(xs, lambda s, i: F.substr(text, s + 1, F.coalesce(F.get(xs, i + 1), F.lit(2**31 - 1)) - s))
    if not levels:
        return let(starts, flat)

    def deeper(groups: Column) -> Column:
        first = F.transform(groups, lambda g: F.get(g, F.lit(0)))
        return F.flatten(F.transform(F.arrays_zip(groups.alias("g"), cut(text, first, levels - 1).alias("t")), lambda z: let(F.transform(z["g"], lambda s: s - F.get(z["g"], F.lit(0))), lambda s: cut(z["t"], s, 0))))

    return let(starts, lambda xs: F.when(F.size(xs) <= GROUP, flat(xs)).otherwise(let(grouped(xs), deeper)))


def masked(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; of overlapping spans the first stands for all."""

    def put_together(by: Column) -> Column:
        # a span begins a mask if all before it end by its start; the text shown begins where all so far have ended
        reached = totals_before(F.transform(by, lambda x: x["e"]), "int", F.lit(0), lambda a, b: F.greatest(a, b))
        runs = let(reached, lambda r: F.transform(by, lambda x, i: F.struct((F.get(r, i) <= x["s"]).alias("new"), F.get(r, i).alias("r"), x["s"].alias("s"), x["kind"].alias("kind"))))
        return let(F.filter(runs, lambda y: y["new"]), lambda heads: shown(heads, F.array_max(F.transform(by, lambda x: x["e"]))))

    def shown(heads: Column, end: Column) -> Column:
        # the text between masks runs from where the run before ended to where the next begins
        bounds = F.concat(F.flatten(F.transform(heads, lambda h: F.array(h["r"], h["s"]))), F.array(end))
        return let(
            cut(text, bounds),
            lambda parts: F.concat(
                F.array_join(F.transform(heads, lambda h, i: F.concat(F.get(parts, 2 * i), F.lit("["), F.upper(h["kind"]), F.lit("]"))), ""), F.element_at(parts, -1)
            ),
        )

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), put_together)).otherwise(text)
