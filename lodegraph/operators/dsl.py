"""A small graph query language, parsed to a query record and run as a DataFrame plan.

    MATCH <type|*> [WHERE <cond> ((AND|OR) <cond>)*] [CALLERS|CALLEES|ANCESTORS|DESCENDANTS <depth>]
          [GROUP BY <field>] [ORDER BY <field> [DESC]] [LIMIT n] [OFFSET n]
    COUNT <type|*> [WHERE ...]
    PATH FROM <id> TO <id> [MAX n]          (also FIND PATH FROM ...)
    <cond>: <field> (=|!=|CONTAINS|STARTS WITH|ENDS WITH|LIKE|MATCHES|IN|NOT IN|>|>=|<|<=) <value or (list)>

AND binds tighter than OR. With compat=True OR joins like AND.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import graph

_TOKEN = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(>=|<=|!=|[=<>(),*])|([^\s'\"=<>!(),]+))")
#: Walks: edge types followed, and whether against their direction.
WALKS = {"CALLERS": (("calls",), True), "CALLEES": (("calls",), False), "ANCESTORS": (("extends", "implements"), False), "DESCENDANTS": (("extends", "implements"), True)}


@dataclass
class GraphQuery:
    kind: str
    node_type: str | None = None
    any_of: list[list[tuple[str, str, object]]] = field(default_factory=list)
    walk: tuple[str, int] | None = None
    group_by: str | None = None
    order_by: tuple[str, bool] | None = None
    limit: int = 50
    offset: int = 0
    ends: tuple[str, str] | None = None
    max_depth: int = 10


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        quoted = m[1] if m[1] is not None else m[2]
        out.append(("text", re.sub(r"\\(.)", r"\1", quoted)) if quoted is not None else ("sign", m[3]) if m[3] else ("word", m[4]))
        at = m.end()
    return out


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self, *words: str) -> bool:
        got = self.tokens[self.at : self.at + len(words)]
        return len(got) == len(words) and all(k != "text" and v.upper() == w for (k, v), w in zip(got, words, strict=True))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("the query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def number(self) -> int:
        v = self.next()[1]
        if not v.isdigit():
            raise ValueError(f"not a number: {v}")
        return int(v)

    def value(self):
        kind, v = self.next()
        if kind == "word" and re.fullmatch(r"-?\d+(\.\d+)?", v):
            return float(v) if "." in v else int(v)
        if kind == "word" and v.lower() in ("true", "false"):
            return v.lower() == "true"
        return v

    def condition(self) -> tuple[str, str, object]:
        name = snake(self.next()[1])
        for words, op in ((("STARTS", "WITH"), "starts"), (("ENDS", "WITH"), "ends"), (("NOT", "IN"), "not in"), (("CONTAINS",), "contains"), (("LIKE",), "like"), (("MATCHES",), "matches"), (("IN",), "in")):
            if self.take(*words):
                break
        else:
            kind, op = self.next()
            if kind != "sign" or op not in ("=", "!=", ">", ">=", "<", "<="):
                raise ValueError(f"not an operator: {op}")
        if op in ("in", "not in"):
            if not self.take("("):
                raise ValueError("a list begins with (")
            values = [self.value()]
            while self.take(","):
                values.append(self.value())
            if not self.take(")"):
                raise ValueError("a list ends with )")
            return name, op, values
        return name, op, self.value()

    def where(self, compat: bool) -> list[list[tuple[str, str, object]]]:
        groups = [[self.condition()]]
        while True:
            if self.take("AND") or (compat and self.take("OR")):
                groups[-1].append(self.condition())
            elif self.take("OR"):
                groups.append([self.condition()])
            else:
                return groups


def parse(text: str, compat: bool = False) -> GraphQuery:
    p = _Parser(text)
    p.take("FIND")
    if p.take("PATH"):
        if not p.take("FROM"):
            raise ValueError("PATH is followed by FROM")
        a = p.next()[1]
        if not p.take("TO"):
            raise ValueError("PATH FROM x is followed by TO")
        q = GraphQuery("path", ends=(a, p.next()[1]))
        if p.take("MAX"):
            q.max_depth = p.number()
    else:
        kind = "match" if p.take("MATCH") else "count" if p.take("COUNT") else None
        if not kind:
            raise ValueError("a query begins with MATCH, COUNT or PATH")
        t = p.next()[1]
        q = GraphQuery(kind, node_type=None if t == "*" else t.lower())
        if p.take("WHERE"):
            q.any_of = p.where(compat)
        for w in WALKS:
            if p.take(w):
                q.walk = (w, p.number())
        if p.take("GROUP", "BY"):
            q.group_by = snake(p.next()[1])
        if p.take("ORDER", "BY"):
            q.order_by = (snake(p.next()[1]), p.take("DESC"))
        if p.take("LIMIT"):
            q.limit = p.number()
        if p.take("OFFSET"):
            q.offset = p.number()
    if p.at < len(p.tokens):
        raise ValueError(f"not understood: {p.tokens[p.at][1]}")
    return q


def predicate(cond: tuple[str, str, object]) -> Column:
    name, op, v = cond
    c = F.col(name)
    if op == "like":
        s = str(v)
        return c.startswith(s.rstrip("*")) if s.endswith("*") and not s.startswith("*") else c.endswith(s.lstrip("*")) if s.startswith("*") and not s.endswith("*") else c.contains(s.strip("*"))
    return {"=": lambda: c == v, "!=": lambda: c != v, ">": lambda: c > v, ">=": lambda: c >= v, "<": lambda: c < v, "<=": lambda: c <= v, "contains": lambda: c.contains(v), "starts": lambda: c.startswith(v), "ends": lambda: c.endswith(v), "matches": lambda: c.rlike(v), "in": lambda: c.isin(*v), "not in": lambda: ~c.isin(*v)}[op]()


def matched(q: GraphQuery, nodes: DataFrame) -> DataFrame:
    m = nodes.where(F.col("node_type") == q.node_type) if q.node_type else nodes
    if q.any_of:
        m = m.where(reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, map(predicate, group)) for group in q.any_of)))
    return m


def execute(q: GraphQuery | str, nodes: DataFrame, edges: DataFrame, walks: dict | None = None) -> DataFrame:
    """Rows of nodes for MATCH (ordered by the field asked for, then id), n for COUNT, node/depth/path for PATH, group and n for GROUP BY. A walk starts from every matched node."""
    q = parse(q) if isinstance(q, str) else q
    if q.kind == "path":
        return graph.shortest_paths(edges, int(q.ends[0]), q.max_depth).where(F.col("node") == int(q.ends[1]))
    m = matched(q, nodes)
    if q.walk:
        types, against = (walks or WALKS)[q.walk[0]]
        e = graph.of_types(edges, types)
        hit = graph.reach(graph.reversed_edges(e) if against else e, m.select("id"), q.walk[1]).select(F.col("node").alias("id")).distinct()
        m = nodes.join(hit, "id", "left_semi")
    if q.kind == "count":
        return m.agg(F.count("*").alias("n"))
    if q.group_by:
        return m.groupBy(F.col(q.group_by).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(q.limit)
    order = [F.desc(q.order_by[0]) if q.order_by[1] else F.asc(q.order_by[0])] if q.order_by else []
    return m.orderBy(*order, "id").offset(q.offset).limit(q.limit)
