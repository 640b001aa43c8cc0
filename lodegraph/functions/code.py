"""Source code as columns: declarations, imports, license headers, statement chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import LICENSE_PHRASES, lines, path_tokens

#: Declarations by language: (kind, pattern with the name in group 1), read line by line.
DECLARATIONS = {
    "fan": (("class", r"^\s*(?:\w+\s+)*class\s+(\w+)"), ("mixin", r"^\s*(?:\w+\s+)*mixin\s+(\w+)"), ("enum", r"^\s*(?:\w+\s+)*enum\s+class\s+(\w+)"), ("constructor", r"^\s*(?:\w+\s+)*new\s+(\w+)\s*\("), ("method", r"^\s*(?!return\b|new\b|if\b|while\b|for\b|throw\b)(?:\w+\s+)*[A-Z][\w:?\[\]]*\s+(\w+)\s*\([^)]*\)\s*\{?"), ("field", r"^\s*(?!return\b)(?:\w+\s+)*[A-Z][\w:?\[\]]*\s+(\w+)\s*(?::=.*)?$")),
    "python": (("class", r"^\s*class\s+(\w+)"), ("method", r"^\s+(?:async\s+)?def\s+(\w+)\s*\("), ("function", r"^(?:async\s+)?def\s+(\w+)\s*\(")),
    "ts": (("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("type", r"^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)[^=]*=>")),
    "go": (("type", r"^type\s+(\w+)\s+(?:struct|interface)"), ("method", r"^func\s+\([^)]*\)\s+(\w+)\s*\("), ("function", r"^func\s+(\w+)\s*\(")),
    "rust": (("type", r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)")),
    "java": (("class", r"^\s*(?:public|private|protected|abstract|final|static|\s)*(?:class|interface|enum|record)\s+(\w+)"), ("method", r"^\s+(?:public|private|protected|static|final|abstract|synchronized|\s)*[A-Z\w<>\[\]]+\s+(\w+)\s*\([^;]*\)\s*(?:throws\s[\w, ]+)?\{")),
}
DECLARATIONS["js"] = DECLARATIONS["vue"] = DECLARATIONS["ts"]
#: Libraries so common in one language that a file's list of imports leaves them out.
COMMON_LIBRARIES = ("sys", "concurrent", "util", "inet", "web", "wisp", "xml")


def declarations(files: DataFrame, path: str = "path", language: str = "language", text: str = "text") -> DataFrame:
    """path, line, kind, name, owner: declarations of every file, the first pattern of its language that reads a line; owner is the last type above."""
    read = None
    for lang, patterns in DECLARATIONS.items():
        for kind, p in patterns:
            hit = (F.col("lang") == lang) & F.col("l").rlike(p)
            found = F.struct(F.lit(kind).alias("kind"), F.regexp_extract("l", p, 1).alias("name"))
            read = F.when(hit, found) if read is None else read.when(hit, found)
    rows = files.select(F.col(path).alias("path"), F.col(language).alias("lang"), F.posexplode(lines(F.col(text))).alias("n", "l"))
    rows = rows.where("trim(l) <> '' and not startswith(ltrim(l), '//') and not startswith(ltrim(l), '*') and not startswith(ltrim(l), '#')")
    found = rows.select("path", (F.col("n") + 1).alias("line"), read.alias("d")).where("d is not null").select("path", "line", "d.kind", "d.name")
    types = F.when(F.col("kind").isin("class", "mixin", "enum", "type"), F.col("name"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.when(F.col("kind").isin("method", "constructor", "field"), F.last(types, ignorenulls=True).over(w))
    return found.withColumn("owner", owner)


def braced(text: Column) -> Column:
    """From the first { of a text's first line to the brace that closes it, or to the end where none does; "" where that line has none."""
    at = F.instr(F.substring_index(text, "\n", 1), "{")
    rest = F.substr(text, at, F.length(text))
    pieces = F.regexp_extract_all(rest, F.lit(r"[{}]|[^{}]+"), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        return F.when(acc["closed"], acc).otherwise(F.struct(depth.alias("depth"), (acc["size"] + F.length(x)).alias("size"), (depth == 0).alias("closed")))

    size = F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed")), step, lambda acc: acc["size"])
    return F.when(at > 0, F.substr(rest, F.lit(1), size)).otherwise("")


def brace_lines(text: Column) -> Column:
    """array of (line, last_line): for every line that opens braces, where the first of them is closed; the last line of the text if nowhere."""

    def of(t: str | None) -> list[dict]:
        out, open_, line, seen = {}, [], 1, 0
        for m in re.finditer(r"[{}\n]", t or ""):
            if m[0] == "\n":
                line += 1
            elif m[0] == "{":
                open_.append(line if seen != line else 0)  # only the first of a line is told
                seen = line
            elif open_ and (first := open_.pop()):
                out[first] = line
        out |= {first: line for first in open_ if first}
        return [{"line": a, "last_line": b} for a, b in sorted(out.items())]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(of, na_action=None)

    return F.pandas_udf(run, "array<struct<line:int,last_line:int>>")(text)


def declared_spans(files: DataFrame, path: str = "path", language: str = "language", text: str = "text") -> DataFrame:
    """declarations with last_line: where the brace is closed that a declaration's line opens; the line itself without one."""
    closed = files.select(F.col(path).alias("path"), F.explode(brace_lines(F.col(text))).alias("b")).select("path", "b.line", "b.last_line")
    found = declarations(files, path, language, text).join(closed, ["path", "line"], "left")
    return found.withColumn("last_line", F.coalesce("last_line", "line"))


#: The comment block that a text begins with: a bracketed one with the rest of its last line, or lines that begin with a mark.
LEADING_COMMENT = r"^\s*(/\*(?s:.*?)\*/[^\n]*\n?|(?:[^\S\n]*(?://|\*\*|#)[^\n]*(?:\n|$))+)"


def speaks_of_license(text: Column) -> Column:
    """Whether a text holds one of LICENSE_PHRASES, however its words are spaced, or a (c) before a year."""
    plain = F.regexp_replace(F.lower(text), r"\s+", " ")
    found = plain.rlike(r"\(c\) ?[0-9]{4}")
    for phrase in LICENSE_PHRASES:
        found = found | plain.contains(phrase)
    return found


def without_license(text: Column) -> Column:
    """A text without its first comment block, if that speaks of a license."""
    head = F.regexp_extract(text, LEADING_COMMENT, 0)
    return F.when((head != "") & speaks_of_license(head), F.substr(text, F.length(head) + 1, F.length(text))).otherwise(text)


def _read_line(line: Column) -> Column:
    """(drop, name) of a line of code: whether it only imports, and what. The line is told by its first word."""
    words = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    first, second = F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    quoted = lambda t: F.regexp_extract(t, "[\"']([^\"']+)[\"']", 1)
    has = lambda w: F.array_contains(words, w)
    module = first.isin("import", "export")
    # the specifier of a module may touch its "from"; a call of require stands anywhere
    sourced = module & line.rlike("\\bfrom\\b *[\"']")
    required = line.rlike("require\\( *[\"']")
    quoted_at_once = (first == "import") & second.rlike("^[\"']")
    name = (
        F.when(sourced, quoted(F.element_at(F.split(line, "\\bfrom\\b"), -1)))
        .when(quoted_at_once | first.rlike("^import[\"']"), quoted(line))
        .when(required, quoted(F.element_at(F.split(line, "require\\("), 2)))
        .when((first == "using") & second.rlike("^[A-Za-z0-9_.]"), F.regexp_extract(second, "^[A-Za-z0-9_.]+", 0))
        .when((first == "from") & has("import") | (first == "import") & second.rlike("^[A-Za-z0-9_.]"), F.element_at(F.split(F.regexp_extract(second, "^[A-Za-z0-9_.]+", 0), r"\."), 1))
        .otherwise("")
    )
    binding = first.isin("const", "let", "var") & required & line.rlike("= *require")
    drop = (first == "import") | first.rlike("^import[^\\w]") | (first == "export") & has("from") | (first == "using") & (F.size(words) == 2) & second.rlike("^[A-Za-z0-9_.:]+$") | binding
    return F.struct(drop.alias("drop"), name.alias("name"))


def clean_body(text: Column) -> Column:
    """Import lines dropped, line ends trimmed, runs of blank lines made one, blank ends cut."""
    kept = F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: ~_read_line(x)["drop"])
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def imports(text: Column, scan: int = 120, cap: int = 120) -> Column:
    """What the first lines import, in their order and each once, up to the first that would make the list longer than cap; relative ones by their last name, COMMON_LIBRARIES left out."""
    every = F.transform(F.slice(lines(text), 1, scan), lambda x: _read_line(x)["name"])
    bare = F.transform(every, lambda s: F.when(s.startswith("."), F.regexp_replace(F.element_at(F.split(s, "/"), -1), r"\.[^.]+$", "")).otherwise(s))
    wanted = F.array_distinct(F.filter(bare, lambda s: (s != "") & ~s.isin(*COMMON_LIBRARIES)))
    longer = lambda acc, s: F.when(acc["list"] == "", s).otherwise(F.concat(acc["list"], F.lit(", "), s))

    def step(acc: Column, s: Column) -> Column:
        full = acc["full"] | (F.length(longer(acc, s)) > cap)
        return F.struct(F.when(full, acc["list"]).otherwise(longer(acc, s)).alias("list"), full.alias("full"))

    return F.aggregate(wanted, F.struct(F.lit("").alias("list"), F.lit(False).alias("full")), step, lambda acc: acc["list"])


def header(path: Column, text: Column) -> Column:
    """The first line of a file's embedding text: words of its path, and its imports."""
    i = imports(text)
    return F.concat_ws(" | ", path_tokens(path), F.when(i != "", F.concat(F.lit("imports: "), i)))


def statement_chunks(text: Column, max_lines: int = 40, max_chars: int = 4000) -> Column:
    """array of (first line, last line): runs of statements (an unindented line and the indented ones below it) packed greedily, covering the text without a gap. A statement over max_lines or max_chars stands alone."""
    numbered = F.transform(lines(text), lambda x, i: F.struct((i + 1).alias("n"), F.length(x).alias("size"), (~x.rlike(r"^(\s|$)")).alias("head")))
    none = F.array().cast("array<struct<a:int,b:int,size:int>>")
    grow = lambda acc, x: F.when(
        x["head"] | (F.size(acc) == 0), F.concat(acc, F.array(F.struct(x["n"].alias("a"), x["n"].alias("b"), x["size"].alias("size"))))
    ).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), x["n"].alias("b"), (F.element_at(acc, -1)["size"] + x["size"] + 1).alias("size")))))
    fits = lambda last, s: (s["b"] - last["a"] < max_lines) & (last["size"] + s["size"] + 1 <= max_chars)
    pack = lambda acc, s: F.when((F.size(acc) == 0) | ~fits(F.element_at(acc, -1), s), F.concat(acc, F.array(s))).otherwise(
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), s["b"].alias("b"), (F.element_at(acc, -1)["size"] + s["size"] + 1).alias("size"))))
    )
    packed = F.aggregate(F.aggregate(numbered, none, grow), none, pack)
    return F.transform(packed, lambda x: F.struct(x["a"].alias("first_line"), x["b"].alias("last_line")))


def query_prefix(model: Column, query: Column) -> Column:
    """A query with the instruction its embedding model asks for."""
    m = F.lower(model)
    return F.when(m.contains("qwen"), F.concat(F.lit("Instruct: Given a search query, retrieve the code that answers it\nQuery: "), query)).when(m.contains("e5"), F.concat(F.lit("query: "), query)).when(m.contains("nomic"), F.concat(F.lit("search_query: "), query)).otherwise(query)
