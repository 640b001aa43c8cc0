"""Signatures and embedding headers of functions whose source is a lambda, (a, b: null) => body, or a component with cells."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegraph.functions.text import lines, split_identifier

#: How many names each line lists, and words of paths that say nothing.
TAGS_MAX, NAMES_MAX, CELLS_MAX, USES_MAX = 8, 5, 12, 8
GENERIC_WORDS = ("func", "proj", "axon", "trio")

SIGNATURE = "found boolean, line int, params array<struct<name:string,default:string,required:boolean>>"


def _code_start(s: str) -> int:
    """Where the code begins: after blanks and comments."""
    i = 0
    while i < len(s):
        if s[i].isspace():
            i += 1
        elif s.startswith(("//", "/*"), i):
            mark = "\n" if s[i + 1] == "/" else "*/"
            end = s.find(mark, i + 2)
            i = len(s) if end < 0 else end + len(mark)
        else:
            break
    return i


def _arguments(s: str, start: int) -> tuple[list[str], int]:
    """What stands between the commas of the bracket opened at start, and the place after its close; -1 if it has none."""
    out, depth, quote, begin, i = [], 0, "", start + 1, start
    while i < len(s):
        c = s[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in '"`':
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return [*out, s[begin:i]], i + 1
        elif c == "," and depth == 1:
            out.append(s[begin:i])
            begin = i + 1
        i += 1
    return [], -1


def read_signature(body: str | None) -> dict:
    """found, line, params (name, default, required) of a body whose code begins with a lambda; line 1 and none without."""
    none = {"found": False, "line": 1, "params": []}
    s = body or ""
    start = _code_start(s)
    if s[start : start + 1] != "(":
        return none
    parts, end = _arguments(s, start)
    if end < 0 or not s[end:].lstrip().startswith("=>"):
        return none
    params = []
    for p in parts:
        name, colon, default = p.partition(":")
        if colon and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name.strip()):
            params.append({"name": name.strip(), "default": default.strip(), "required": False})
        elif bare := re.sub(r"[^A-Za-z0-9_]", "", p):
            params.append({"name": bare, "default": None, "required": True})
    return {"found": True, "line": s.count("\n", 0, start) + 1, "params": params}


def signature(body: Column) -> Column:
    """read_signature of each body, in batches."""

    def run(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_signature(b) for b in bodies], columns=["found", "line", "params"])

    return F.pandas_udf(run, SIGNATURE)(body)


def cells(body: Column) -> Column:
    """array of (name, key, line) of a component's cells, name: {key...}, from its head to its first block; empty for other bodies."""
    ls = F.coalesce(lines(body), F.array().cast("array<string>"))
    at = F.array_position(F.transform(ls, lambda x: x.rlike(r"^\s*defcomp\b")), True).cast("int")
    rest = F.slice(ls, at + 1, F.size(ls))
    stop = F.array_position(F.transform(rest, lambda x: x.rlike(r"^\s*(do|end)\b")), True).cast("int")
    n = F.when(at == 0, 0).when(stop > 0, stop - 1).otherwise(F.size(rest))
    pattern = r"^\s*([A-Za-z_]\w*)\s*:\s*\{\s*([A-Za-z_]\w*)?"
    one = lambda x, i: F.struct(F.regexp_extract(x, pattern, 1).alias("name"), F.nullif(F.regexp_extract(x, pattern, 2), F.lit("")).alias("key"), (at + i + 1).alias("line"))
    return F.filter(F.transform(F.slice(rest, F.lit(1), n), one), lambda c: c["name"] != "")


def typed(sig: Column, known: Column) -> Column:
    """array of (name, type, default): the parameters of a signature with the types known of them, or the known ones where the body has no lambda. known: array of (name, type)."""
    of = lambda p: F.get(F.filter(known, lambda k: k["name"] == p["name"]), F.lit(0))["type"]
    read = F.transform(sig["params"], lambda p: F.struct(p["name"].alias("name"), of(p).alias("type"), p["default"].alias("default")))
    told = F.transform(known, lambda k: F.struct(k["name"].alias("name"), k["type"].alias("type"), F.lit(None).cast("string").alias("default")))
    return F.when(sig["found"] | known.isNull(), read).otherwise(told)


def signature_text(name: Column, params: Column, cell: Column, returns: Column) -> Column:
    """name(a: Type = default, b) => Result, or name[a: key, b] for a component. params: as typed gives them; a result that is no plain name is left out."""
    maybe = lambda mark, c: F.coalesce(F.concat(F.lit(mark), c), F.lit(""))
    inside = F.array_join(F.transform(params, lambda p: F.concat(p["name"], maybe(": ", p["type"]), maybe(" = ", p["default"]))), ", ")
    parts = F.array_join(F.transform(cell, lambda c: F.concat(c["name"], maybe(": ", c["key"]))), ", ")
    result = F.when(returns.rlike(r"^[A-Za-z][A-Za-z0-9_]*$"), F.concat(F.lit(" => "), returns)).otherwise("")
    return F.when(F.size(cell) > 0, F.concat(name, F.lit("["), parts, F.lit("]"))).otherwise(F.concat(name, F.lit("("), inside, F.lit(")"), result))


def _listed(label: str, names: Column, cap: int) -> Column:
    """label and the first names; null without any."""
    return F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(F.slice(names, 1, cap), ", ")))


def header_line(project: Column, instance: Column, path: Column, tags: Column) -> Column:
    """project, instance, words of the path and first tags of a function."""
    segments = F.split(F.regexp_replace(path, r"\.(axon|trio)$", ""), r"[\\/]")
    words = F.array_join(F.filter(F.flatten(F.transform(segments, split_identifier)), lambda w: ~w.isin(*GENERIC_WORDS)), " ")
    return F.concat_ws(" | ", F.concat(F.lit("project: "), project), F.concat(F.lit("instance: "), instance), F.when(words != "", F.concat(F.lit("file: "), words)), _listed("tags: ", tags, TAGS_MAX))


def context_line(calls: Column, called_by: Column) -> Column:
    """What a function calls and who calls it; "" where neither is known."""
    both = F.concat_ws("; ", _listed("calls: ", calls, NAMES_MAX), _listed("called by: ", called_by, NAMES_MAX))
    return F.when(both != "", F.concat(F.lit("context: "), both)).otherwise("")


def cells_line(cell: Column) -> Column:
    """A component's cells with the key of their braces; "" without any."""
    names = F.transform(cell, lambda c: F.when(c["key"].isNull(), c["name"]).otherwise(F.concat(c["name"], F.lit(" {"), c["key"], F.lit("}"))))
    return F.coalesce(_listed("cells: ", names, CELLS_MAX), F.lit(""))


def uses_line(uses: Column) -> Column:
    """The built-in functions that a body calls; "" without any."""
    return F.coalesce(_listed("uses: ", uses, USES_MAX), F.lit(""))
