"""Text formats as rows: records, diffs, logs, code blocks, calls, documentation pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import lines

#: Words that look like calls and are none.
KEYWORDS = (
    "if", "else", "for", "while", "switch", "case", "try", "catch", "finally", "throw", "return", "break", "continue", "default", "class", "mixin", "enum", "facet", "using", "abstract", "virtual", "override",
    "static", "const", "final", "private", "protected", "public", "internal", "native", "once", "new", "readonly", "true", "false", "null", "this", "super", "it", "typeof", "is", "as", "isnot", "do", "def", "function",
)


def numbered_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """files with line (from 1) and content instead of the text."""
    return files.select(*(c for c in files.columns if c != text), F.posexplode(lines(F.col(text))).alias("line", "content")).withColumn("line", F.col("line") + 1)


def without_literals(code: Column) -> Column:
    """Code with comments taken out and string literals emptied."""
    c = F.regexp_replace(code, r"(?s)/\*.*?\*/", " ")
    c = F.regexp_replace(c, r"(?m)(^|[^:])//.*$", "$1")
    return F.regexp_replace(F.regexp_replace(c, r'"(?:[^"\\\n]|\\.)*"', '""'), r"'(?:[^'\\\n]|\\.)*'", "''")


def calls(files: DataFrame, id_col: str, code: str) -> DataFrame:
    """id, line, kind (qualified, static, method, dynamic, constructor, direct), target; each once on a line, the first kind that reads it."""
    families = [
        ("qualified", r"\b([a-z]\w*::[A-Z]\w*\s*\.\s*[A-Za-z_]\w*)\s*\("), ("static", r"(?<![:\w])([A-Z]\w*\s*\.\s*[A-Za-z_]\w*)\s*\("), ("method", r"\b([a-z_]\w*\s*\.\s*[A-Za-z_]\w*)\s*\("),
        ("dynamic", r"\b([A-Za-z_]\w*\s*->\s*[A-Za-z_]\w*)\s*\("), ("constructor", r"(?<![.:>\w])([A-Z]\w*)\s*\("), ("direct", r"(?<![.:>\w])([a-z_]\w*)\s*\("),
    ]
    rows = files.select(F.col(id_col).alias("id"), F.posexplode(lines(without_literals(F.col(code)))).alias("line", "c"))
    found = F.concat(*(_family(i, k, p) for i, (k, p) in enumerate(families)))
    hits = rows.select("id", (F.col("line") + 1).alias("line"), F.explode(found).alias("x")).select("id", "line", "x.*").where(~F.col("target").isin(*KEYWORDS))
    return hits.groupBy("id", "line", "target").agg(F.min(F.struct("tier", "kind")).alias("k")).select("id", "line", F.col("k.kind").alias("kind"), "target")


def _family(tier: int, kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("c", F.lit(pattern), F.lit(1)), lambda m: F.struct(F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), F.regexp_replace(m, r"\s+", "").alias("target")))


def parameters(source: Column) -> Column:
    """array of (name, default) of the first code line (a: x, b) => ..."""
    inside = F.regexp_extract(source, r"(?m)^\s*\(([^)]*)\)\s*=>", 1)
    one = lambda p: F.struct(F.trim(F.regexp_extract(p, r"^([^:]+)", 1)).alias("name"), F.nullif(F.trim(F.regexp_extract(p, r":(.*)$", 1)), F.lit("")).alias("default"))
    return F.when(F.trim(inside) == "", F.array().cast("array<struct<name:string,default:string>>")).otherwise(F.transform(F.split(inside, ","), one))


def trio_records(files: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """id, record (from 0), tags (map). Records end at a line of dashes; name:value is a tag, a bare name a marker, an indented block the value of the tag before it."""
    blocks = files.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text), r"(?m)^-{2,}[^\S\n]*$")).alias("record", "body"))
    # an indented line joins the one it belongs to
    folded = F.regexp_replace(F.col("body"), r"\n[ \t]+", "\u001f")
    entries = F.filter(F.transform(F.split(folded, "\n"), lambda x: F.rtrim(x)), lambda x: x.rlike(r"^[a-z]\w*\s*(:.*)?"))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("k"), F.when(~x.rlike(r"^\w+\s*:"), "✓").otherwise(F.regexp_replace(F.regexp_replace(x, r"^\w+\s*:\s*", ""), "\u001f", "\n")).alias("v"))
    rows = blocks.select("id", "record", F.transform(entries, pair).alias("p")).where(F.size("p") > 0)
    names = F.transform("p", lambda q: q["k"])
    first = F.filter("p", lambda q, i: F.array_position(names, q["k"]) == i + 1)
    return rows.select("id", "record", F.map_from_entries(first).alias("tags"))


def trio_kind(tags: Column) -> Column:
    has = lambda k: F.map_contains_key(tags, k)
    return F.when(has("func") | has("src"), "function").when(has("view"), "view").when(has("app"), "app").otherwise("record")


def markdown_blocks(files: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """id, block, language, line (of the fence), code."""
    parts = files.select(F.col(id_col).alias("id"), F.split(F.col(text), r"(?m)^```", -1).alias("p"))
    one = parts.select("id", "p", F.posexplode("p").alias("i", "part")).where("i % 2 = 1")
    before = F.array_join(F.slice("p", F.lit(1), F.col("i")), "```")
    return one.select(
        "id", ((F.col("i") - 1) / 2).cast("int").alias("block"), F.lower(F.trim(F.regexp_extract("part", r"^([^\n]*)", 1))).alias("language"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), F.regexp_replace("part", r"^[^\n]*\n?|\n$", "").alias("code")
    )


def diff_hunks(diffs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """id, file, first_line, last_line of the new side of every hunk."""
    rows = diffs.select(F.col(id_col).alias("id"), F.posexplode(lines(F.col(text))).alias("n", "l")).where(F.col("l").rlike(r"^(\+\+\+ |@@ )"))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("file", F.last(F.when(F.col("l").startswith("+++ "), F.regexp_extract("l", r"^\+\+\+ (?:b/)?(.*)$", 1)), ignorenulls=True).over(w)).where(F.col("l").startswith("@@"))
    first = F.regexp_extract("l", r"^@@ [^+]*\+(\d+)(?:,(\d+))?", 1).cast("int")
    size = F.coalesce(F.regexp_extract("l", r"^@@ [^+]*\+(\d+)(?:,(\d+))?", 2).try_cast("int"), F.lit(1))
    return rows.select("id", "file", first.alias("first_line"), (first + F.greatest(size, F.lit(1)) - 1).alias("last_line"))


def name_status(rows: DataFrame, text: str = "text") -> DataFrame:
    """status, path, new_path, similarity from the NUL-separated status listing of version control."""
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for t in b[text]:
                parts = [p for p in (t or "").split("\0") if p]
                i = 0
                while i < len(parts):
                    s, two = parts[i], parts[i][0] in "RC"
                    out.append((s[0], parts[i + 1] if i + 1 < len(parts) else None, parts[i + 2] if two and i + 2 < len(parts) else None, int(s[1:]) if s[1:].isdigit() else None))
                    i += 3 if two else 2
            yield pd.DataFrame(out, columns=["status", "path", "new_path", "similarity"]).astype({"similarity": "Int32"})

    return rows.select(text).mapInPandas(run, "status string, path string, new_path string, similarity int")


def commit_log(logs: DataFrame, text: str = "text") -> DataFrame:
    """commit, author, at, subject, file from records split by \\x1e and fields by \\x1f, the last of which lists files by line."""
    f = logs.select(F.explode(F.split(F.col(text), "\x1e")).alias("r")).where(F.trim("r") != "").select(F.split(F.col("r"), "\x1f").alias("f"))
    files = F.filter(F.split(F.get("f", F.lit(4)), "\n"), lambda x: F.trim(x) != "")
    return f.select(F.trim(F.get("f", F.lit(0))).alias("commit"), F.get("f", F.lit(1)).alias("author"), F.to_timestamp(F.get("f", F.lit(2))).alias("at"), F.get("f", F.lit(3)).alias("subject"), F.explode_outer(files).alias("file"))


def reflog(rows: DataFrame, text: str = "value") -> DataFrame:
    """old, new, who, epoch, message of reflog lines."""
    p = r"^([0-9a-f]+) ([0-9a-f]+) (.*) (\d+) [+-]\d{4}\t(.*)$"
    part = lambda i: F.regexp_extract(text, p, i)
    return rows.where(F.col(text).rlike(p)).select(part(1).alias("old"), part(2).alias("new"), part(3).alias("who"), part(4).cast("long").alias("epoch"), part(5).alias("message"))


def manifest(text: Column) -> Column:
    """(summary, depends) of a build file or a package description."""
    fan = F.transform(F.regexp_extract_all(F.regexp_extract(text, r"(?s)depends\s*=\s*\[(.*?)\]", 1), F.lit(r'"(\w+)[^"]*"'), F.lit(1)), lambda x: x)
    js = F.map_keys(F.coalesce(F.from_json(F.get_json_object(text, "$.dependencies"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    summary = F.coalesce(F.get_json_object(text, "$.description"), F.nullif(F.regexp_extract(text, r'summary\s*=\s*"([^"]*)"', 1), F.lit("")))
    return F.struct(summary.alias("summary"), F.when(F.size(js) > 0, js).otherwise(fan).alias("depends"))


def html_title(html: Column, tag: str = "h1") -> Column:
    """The text of the first tag of a page: markup out, the usual character references decoded, white space made one blank."""
    t = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return html_text(t)


def html_text(html: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for ref, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(ref), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_slots(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """id, row, name, description: a row for each <tr><th>..<td>.. of a page whose name is one word."""
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "r"))
    named = rows.select("id", "row", html_text(F.regexp_extract("r", r"(?is)<th\b[^>]*>(.*?)</th>", 1)).alias("name"), html_text(F.regexp_extract("r", r"(?is)<td\b[^>]*>(.*?)</td>", 1)).alias("description"))
    return named.where((F.col("name") != "") & ~F.col("name").contains(" "))


def html_links(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """id, place, target, label of links."""
    tags = pages.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*href=\"([^\"]*\"[^>]*>.*?)</a>"), F.lit(1))).alias("place", "t"))
    return tags.select("id", "place", F.regexp_extract("t", r'(?s)^([^"]*)"', 1).alias("target"), html_text(F.regexp_replace("t", r'(?s)^[^"]*"[^>]*>', "")).alias("label"))


def _first_tag(html: Column, tag: str) -> Column:
    """The text of the first tag that is not empty of it; null without one."""
    found = F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), html_text)
    return F.get(F.filter(found, lambda t: t != ""), F.lit(0))


def _base(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, r"[\\/]"), -1), r"(?i)\.html?$", "")


def _sections(html: Column) -> Column:
    """array of (heading, body): the main sections of a documentation page, each to the next heading or section, with the heading before it."""
    marked = F.regexp_replace(F.regexp_replace(html, r"(?i)<h2\b[^>]*\bdefc-main-heading\b[^>]*>", "\u001eH"), r"(?i)<div\b[^>]*\bdefc-main-section\b[^>]*>", "\u001eS")
    parts = F.split(marked, "\u001e")
    heading = lambda i: F.when((i > 0) & F.get(parts, i - 1).startswith("H"), html_text(F.substr(F.get(parts, i - 1), F.lit(2)))).otherwise("")
    every = F.transform(parts, lambda p, i: F.struct(heading(i).alias("heading"), F.substr(p, F.lit(2)).alias("body"), p.startswith("S").alias("main")))
    return F.filter(every, lambda s: s["main"])


def html_function(path: Column, html: Column) -> Column:
    """(name, qualified_name, signature, description, metadata) of a function's page; its name is its file's, metadata are the rows of tables under a heading that speaks of meta."""
    name = F.regexp_replace(_base(path), "^func~", "")
    sections = _sections(html)
    first = lambda tag: F.get(F.filter(F.transform(sections, lambda s: _first_tag(s["body"], tag)), lambda t: t.isNotNull()), F.lit(0))
    tables = F.flatten(F.transform(F.filter(sections, lambda s: F.lower(s["heading"]).contains("meta")), lambda s: F.regexp_extract_all(s["body"], F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))))
    cell = lambda r, tag: html_text(F.regexp_extract(r, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    rows = F.filter(F.transform(tables, lambda r: F.struct(cell(r, "th").alias("k"), cell(r, "td").alias("v"))), lambda x: (x["k"] != "") & (x["v"] != ""))
    names = F.transform(rows, lambda x: x["k"])
    last = F.filter(rows, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), x["k"]))
    description = F.coalesce(first("p"), F.concat(F.lit("Axon function: "), name))
    return F.struct(name.alias("name"), F.concat(F.lit("func:"), name).alias("qualified_name"), first("h2").alias("signature"), description.alias("description"), F.map_from_entries(last).alias("metadata"))


def html_chapter(path: Column, html: Column, cap: int = 500) -> Column:
    """(name, description) of a chapter: its first heading, else its title up to a dash, else its file's name; the first paragraph of a main section, else of the page."""
    titled = F.trim(F.regexp_replace(F.coalesce(_first_tag(html, "title"), F.lit("")), r" *–.*$", ""))
    name = F.coalesce(_first_tag(html, "h1"), F.nullif(titled, F.lit("")), _base(path))
    main = F.get(F.filter(F.transform(_sections(html), lambda s: _first_tag(s["body"], "p")), lambda t: t.isNotNull()), F.lit(0))
    description = F.coalesce(main, _first_tag(html, "p"), F.concat(F.lit("Documentation chapter: "), name))
    return F.struct(name.alias("name"), F.substring(description, 1, cap).alias("description"))


def html_entries(pages: DataFrame, id_col: str, path: str = "path", pod: str = "pod", html: str = "html") -> DataFrame:
    """id, place, kind, name, qualified_name, signature, description: the type of a page in tabs and sections (place 0) and its slots.

    A tab names a slot unless its id begins with doc- or its text has a blank. The slots of a mixin called
    Funcs are functions: their names stand alone and their signatures end before the result.
    """
    tabs = F.split(F.col(html), r"(?i)<xetodoc-tab\b")
    code = lambda t: F.nullif(html_text(F.regexp_extract(t, r"(?is)<xetodoc-slot\b[^>]*>.*?<code\b[^>]*>(.*?)</code>", 1)), F.lit(""))
    said = lambda t: F.trim(F.array_join(F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), html_text), lambda x: x != ""), " "))
    key = lambda t: F.regexp_extract(t, "(?is)^[^>]*\\bid=[\"']([^\"']*)[\"']", 1)
    label = lambda t: html_text(F.regexp_extract(t, r"(?is)^[^>]*>(.*?)</xetodoc-tab>", 1))
    one = lambda t: F.struct(key(t).alias("key"), label(t).alias("label"), code(t).alias("signature"), said(t).alias("description"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(pod).alias("pod"), F.coalesce(_first_tag(F.col(html), "h1"), _base(F.col(path))).alias("type"), F.transform(F.slice(tabs, F.lit(2), F.size(tabs)), one).alias("tabs"))
    head = F.get(F.filter("tabs", lambda t: t["key"] == "doc-header"), F.lit(0))
    slots = F.filter(F.transform("tabs", lambda t: t.withField("label", F.when(t["label"] == "", t["key"]).otherwise(t["label"]))), lambda t: (t["key"] != "") & ~t["key"].startswith("doc-") & ~t["label"].contains(" "))
    top = F.struct(F.lit("").alias("key"), F.col("type").alias("label"), head["signature"].alias("signature"), F.coalesce(F.nullif(head["description"], F.lit("")), F.concat_ws(" from ", "type", "pod")).alias("description"))
    funcs = (F.col("type") == "Funcs") & F.coalesce(head["label"] == "mixin", F.lit(False))
    entries = rows.select("id", "pod", "type", funcs.alias("funcs"), F.posexplode(F.concat(F.array(top), slots)).alias("place", "e"))
    kind = F.when(F.col("place") == 0, "type").when(F.col("funcs"), "function").otherwise("slot")
    q = F.when(F.col("place") == 0, F.concat_ws("::", "pod", "type")).when(F.col("funcs"), F.concat(F.lit("func:"), F.col("e.label"))).otherwise(F.concat(F.col("pod"), F.lit("::"), F.col("type"), F.lit("."), F.col("e.label")))
    signature = F.when((F.col("place") > 0) & F.col("funcs"), F.concat(F.col("e.label"), F.regexp_replace("e.signature", r"\s*=>.*$", ""))).otherwise(F.col("e.signature"))
    empty = F.when((F.col("place") > 0) & F.col("funcs") & (F.col("e.description") == ""), F.concat(F.lit("Axon function: "), F.col("e.label")))
    description = F.coalesce(empty, F.when(F.col("place") > 0, F.substring("e.description", 1, 1000)).otherwise(F.col("e.description")))
    return entries.select("id", "place", kind.alias("kind"), F.col("e.label").alias("name"), q.alias("qualified_name"), signature.alias("signature"), description.alias("description"))
