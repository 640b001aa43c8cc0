"""Secret scans: known forms, and strings whose sliding-window Shannon entropy is too high for writing.

Built-in functions only. Candidate strings are runs of key-like characters. Each goes by its character
class (hex, lower-case alphanumeric, mixed); a window slides over it, and the counts of its characters and
the sum of n * log2(n) over them change by the one character that enters and the one that leaves. A
candidate whose best window passes the threshold of its class is a secret unless an allow-listed form
explains it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import table
from lodegraph.llm.native_spans import SPAN, apart, as_spans, find_all, let, listed

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so the least length can stand in the pattern: a run too short has no long enough rest.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
#: Characters of candidate strings; the window, and the least entropy in bits for each class.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW, THRESHOLDS = 20, {"hex": 3.05, "alnum": 3.55, "mixed": 3.8}
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Forms that explain a candidate, in any case: placeholders, runs of the alphabet, UUIDs, digests under a name.
ALLOWED = (
    r"example|sample|dummy|placeholder|changeme|your[_-]?|xxxx|abcdefgh|01234567|12345678|"
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^sha(1|256|384|512)-"
)
KINDS = ("assign", "access", "hex", "entropy")


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of any window of a string over ALPHABET that is at least as long."""
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    weigh = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    entropy = lambda s: F.log2(F.lit(float(window))) - s / window
    count = lambda acc, c: F.get(acc["n"], c)
    none = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def step(acc, x):
        come, go = x["come"], x["go"]
        gain = weigh(count(acc, come) + 1) - weigh(count(acc, come))
        loss = F.when(go >= 0, weigh(count(acc, go) - 1) - weigh(count(acc, go))).otherwise(F.lit(0.0))
        counts = F.transform(acc["n"], lambda n, i: n + F.when(i == come, 1).otherwise(0) - F.when(i == go, 1).otherwise(0))
        return F.struct(
            F.when(come == go, acc["n"]).otherwise(counts).alias("n"), F.when(come == go, acc["s"]).otherwise(acc["s"] + gain + loss).alias("s"),
            F.when(go >= 0, F.greatest(acc["best"], entropy(acc["s"]))).otherwise(acc["best"]).alias("best"),
        )

    slide = lambda cs: F.transform(cs, lambda c, i: F.struct(c.alias("come"), F.when(i >= window, F.get(cs, i - window)).otherwise(F.lit(-1)).alias("go")))
    return F.aggregate(let(codes, slide), none, step, lambda acc: F.greatest(acc["best"], entropy(acc["s"])))


def is_high_entropy(m: Column) -> Column:
    """Whether a candidate is no allow-listed form and passes the threshold of its class; strings of letters alone are words."""
    digit, lower, upper = m.rlike("[0-9]"), m.rlike("[a-z]"), m.rlike("[A-Z]")
    form = (
        F.when(~digit | ~(lower | upper), F.lit(None).cast("double"))
        .when(m.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(THRESHOLDS["hex"]))
        .when(lower & upper, F.lit(THRESHOLDS["mixed"]))
        .otherwise(F.lit(THRESHOLDS["alnum"]))
    )
    return F.when(form.isNull() | F.lower(m).rlike(ALLOWED), F.lit(False)).otherwise(window_entropy(m) >= form)


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_spans and spans (arrays of s, k, e, kind; code points, end exclusive).

    Null texts count as empty and have no spans. Spans of one kind never overlap; those of different base
    kinds can; entropy spans are only given apart from base spans. Repeated rows each get their row; an empty
    table gives an empty result; columns of docs by the names of the new ones give way to them.
    """
    docs = docs.drop(*({"n_assign", "n_access", "n_hex", "base_spans", "spans"} & set(docs.columns) - {text_col}))
    t = F.coalesce(F.col(text_col), F.lit(""))
    long_value = lambda x: F.length(x["g"]) >= 8
    assign = F.filter(find_all(t, ASSIGN, t.rlike("(?i:passw|secret|token|api_?key)"), 2), long_value)
    access = find_all(t, ACCESS, F.contains(t, F.lit("AKIA")))
    hexes = find_all(t, HEX, t.rlike(HEX))
    # a candidate needs a digit to pass, so texts without a long run that holds one are done
    high = F.filter(find_all(t, CANDIDATE, t.rlike(CANDIDATE)), lambda x: is_high_entropy(x["m"]))
    found = docs.withColumns({"__assign": as_spans(assign, 0, "assign"), "__access": as_spans(access, 1, "access"), "__hex": as_spans(hexes, 2, "hex"), "__high": as_spans(high, 3, "entropy")})
    found = found.withColumns({"n_assign": F.size("__assign").cast("long"), "n_access": F.size("__access").cast("long"), "n_hex": F.size("__hex").cast("long"), "base_spans": F.concat("__assign", "__access", "__hex").cast(SPAN)})
    return found.withColumn("spans", F.concat("base_spans", apart(F.col("__high"), F.col("base_spans")))).drop("__assign", "__access", "__hex", "__high")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches_sql(kind: str, k: int, pattern: str, group: int) -> str:
    p = _sql(pattern)
    return f"SELECT r, '{kind}' AS kind, {k} AS k, string_split_regex(t, {p}) AS ps, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS gs FROM d WHERE regexp_matches(t, {p})"


#: The same form without the case flag, which elsewhere also folds letters beyond ASCII.
_PLAIN_ASSIGN = ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))

_SIZES = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_matches_sql(kind, k, p, g) for k, (kind, p, g) in enumerate((("assign", _PLAIN_ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("entropy", CANDIDATE, 0))))}),
j AS (SELECT *, unnest(range(1, len(ms) + 1)) AS j FROM f),
s AS (SELECT r, kind, k, ({_SIZES.format("ps[1:j]")} + {_SIZES.format("ms[1:j-1]")})::BIGINT AS s, ms[j] AS m, gs[j] AS g FROM j),
e AS (SELECT *, s + length(m) AS e, CASE WHEN NOT regexp_matches(m, '[0-9]') OR NOT regexp_matches(m, '[A-Za-z]') OR regexp_matches(lower(m), {_sql(ALLOWED)}) THEN 99 WHEN regexp_full_match(m, '[0-9a-f]+|[0-9A-F]+') THEN {THRESHOLDS["hex"]} WHEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') THEN {THRESHOLDS["mixed"]} ELSE {THRESHOLDS["alnum"]} END AS least_ FROM s),
b AS (SELECT * FROM e WHERE k IN (1, 2) OR k = 0 AND length(g) >= 8),
h AS (SELECT * FROM e WHERE k = 3 AND list_max(list_transform(range(0, length(m) - {WINDOW - 1}), lambda i: list_aggregate(string_split(substr(m, i + 1, {WINDOW}), ''), 'entropy'))) >= least_ AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = e.r AND b.s < e.e AND e.s < b.e)),
x AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM (SELECT r, kind, k, s, e FROM b UNION ALL SELECT r, kind, k, s, e FROM h) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (r)
"""

QUERIES = {"op3_secrets": op3_secrets}
ORACLES = {"op3_secrets": ORACLE}
