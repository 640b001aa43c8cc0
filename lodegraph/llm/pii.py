"""Personal data by weak supervision.

Patterns give candidate spans. Regex, gazetteer and context labelers each vote yes, no or nothing on a
candidate; expectation-maximisation over the counts of vote patterns estimates every labeler's
reliability and each pattern's posterior; a logistic span classifier is trained on those posteriors over
span features and decides. Spans of the four base forms are always kept; the classifier adds further ones.

Built-in functions only. The corpus enters the fit through counts of (kind, votes, features) patterns:
their number is bounded by the labelers' and features' arities, not by the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import durable, table
from lodegraph.llm.native_spans import SPAN, apart, find_all, listed

#: The base forms. A run of the first class is only entered at its start or where the last match ended, so
#: long runs cost no more than their length; possessive groups need no stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
BASE_KINDS = ("email", "ip", "card", "phone")
#: Further candidates by kind: (pattern, cheap test).
FURTHER = {
    "email_text": (r"(?i)\b[a-z0-9][a-z0-9._-]{1,30} ?[\[(] ?at ?[\])] ?[a-z0-9-]{2,30}(?: ?[\[(] ?dot ?[\])] ?[a-z]{2,12}){1,3}\b", r"(?i)[\[(] ?at ?[\])]"),
    "phone_local": (r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", r"[0-9]{3}[ .-][0-9]{4}"),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "name": (r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? \p{Lu}[\p{L}'-]{1,30}(?: \p{Lu}[\p{L}'-]{1,30})?", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? \p{Lu}"),
}
KINDS = BASE_KINDS + tuple(FURTHER)
#: Fixed word lists of the context and gazetteer labelers.
CUES = r"(?i)(phone|tel|call|fax|mobile|contact|e-?mail|write to|reach|card|visa|payment|iban|account|ssn|social security|name|dear|from|address|login|kontakt|telefon|anruf|appel|courriel|llam|correo)[^\n]{0,24}$"
COUNTER_CUES = r"(?i)(version|order|invoice|isbn|issn|part no|serial|build|ticket|page|figure|table|rfc)[^\n]{0,12}$"
GIVEN_NAMES = ("anna", "anne", "carlos", "daniel", "david", "elena", "emma", "hans", "james", "jan", "jean", "john", "jose", "juan", "julia", "klaus", "laura", "luis", "maria", "marie", "mark", "martin", "mary", "michael", "paul", "peter", "pierre", "robert", "sarah", "sofia", "thomas", "william")
MAIL_DOMAINS = r"(?i)(gmail|yahoo|hotmail|outlook|icloud|proton|gmx|web)\b|\.(com|org|net|edu|gov|de|fr|es|uk|io)\b|\b(dot|com|org|net)\b"
COUNTRIES = r"^(AD|AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
LABELERS = ("shape", "checksum", "context", "counter_context", "gazetteer", "plausible")
THRESHOLD = 0.5


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return total % 10 == 0


def base_matches(t: Column) -> dict[str, Column]:
    """The base forms of a text that is not null: MATCH arrays by kind."""
    email = find_all(t, EMAIL, F.contains(t, F.lit("@")))
    ip = F.filter(find_all(t, IP, t.rlike(r"[0-9]\.[0-9]")), lambda x: x["m"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    card = F.filter(find_all(t, CARD, t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")), lambda x: luhn(digits(x["m"])))
    phone = F.filter(find_all(t, PHONE, F.contains(t, F.lit("+"))), lambda x: F.length(digits(x["m"])).between(9, 15))
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def votes(kind: str, x: Column) -> list[Column]:
    """Each labeler's vote on a candidate of a kind: 1 yes, 0 no, -1 nothing."""
    m, d = x["m"], digits(x["m"])
    never, always = F.lit(False), F.lit(True)
    same = d.rlike(r"^([0-9])\1*$") | d.rlike("01234567|12345678|87654321")
    shape = {"email": vote(m.rlike(r"\.[A-Za-z]{2,}$"), always), "ip": vote(always, never), "card": vote(F.length(d).between(13, 19), always), "phone": vote(F.length(d).between(10, 13), never)}.get(kind)
    if shape is None:
        shape = {"national_id": vote(~m.rlike("^(000|666|9)|-00-|-0000$"), always), "iban": vote(m.rlike(r"^[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[0-9 ]+$"), never), "phone_local": vote(m.rlike(r"^\(?[2-9]"), always)}.get(kind, vote(always, never))
    checksum = vote(luhn(d), always) if kind == "card" else vote(never, never)
    gazetteer = {"email": vote(m.rlike(MAIL_DOMAINS), never), "email_text": vote(m.rlike(MAIL_DOMAINS), never), "iban": vote(m.rlike(COUNTRIES), always)}.get(kind)
    if gazetteer is None:
        gazetteer = vote(F.exists(F.split(F.lower(m), r"[^\p{L}]+"), lambda w: w.isin(*GIVEN_NAMES)), never) if kind == "name" else vote(never, never)
    plausible = vote(never, same) if kind in ("card", "phone", "phone_local", "national_id", "iban") else vote(never, m.rlike(r"^(0|127|255)\.|(?i:example\.(com|org|net))$")) if kind in ("email", "ip") else vote(never, never)
    return [shape, checksum, vote(x["b"].rlike(CUES), never), vote(never, x["b"].rlike(COUNTER_CUES)), gazetteer, plausible]


#: Span features: name, value.
def features(kind: str, x: Column) -> list[Column]:
    n, d = F.length(x["m"]), F.length(digits(x["m"]))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return [
        flag(x["b"].rlike(CUES)), flag(x["b"].rlike(COUNTER_CUES)), flag(x["b"].rlike(r"[:=]\s*$")), flag(x["b"].rlike(r"(^|[\s(\[<])$")), flag(x["a"].rlike(r"^($|[\s.,;:)\]>])")),
        flag(n >= 12), flag(n >= 20), flag(d >= 9), flag(d >= 13), flag(x["m"].rlike("[A-Z]")), flag(digits(x["m"]).rlike(r"^([0-9])\1*$")),
    ]


FEATURES = ("cue", "counter_cue", "after_colon", "opens", "closes", "long", "very_long", "digits9", "digits13", "upper", "one_digit")


@dataclass(frozen=True)
class Model:
    """kinds: intercept by kind; weights by feature; reliability: labeler -> (yes given personal, yes given not)."""

    kinds: dict[str, float]
    weights: tuple[float, ...]
    reliability: dict[str, tuple[float, float]]


def further_matches(t: Column) -> dict[str, Column]:
    return {k: find_all(t, pattern, t.rlike(test)) for k, (pattern, test) in FURTHER.items()}


def candidates(t: Column) -> dict[str, Column]:
    return base_matches(t) | further_matches(t)


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def estimate(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 40) -> tuple[dict, dict[str, tuple[float, float]]]:
    """Expectation-maximisation over (kind, votes, count): posterior by (kind, votes), reliability by labeler.

    Votes are taken as independent given the truth; nothing is learnt from silence. Counts are smoothed by
    one pseudo-vote that trusts each labeler, so a labeler that never votes keeps its prior.
    """
    reliable = {name: (0.8, 0.2) for name in LABELERS}
    prior = {k: 0.6 for k, _, _ in counts}
    posterior: dict = {}
    for _ in range(rounds):
        for kind, v, _n in counts:
            z = math.log(prior[kind] / (1 - prior[kind]))
            for name, x in zip(LABELERS, v, strict=True):
                if x >= 0:
                    p, q = reliable[name]
                    z += math.log((p if x else 1 - p) / (q if x else 1 - q))
            posterior[kind, v] = sigmoid(z)
        for j, name in enumerate(LABELERS):
            yes, no, yes_all, no_all = 8.0, 2.0, 10.0, 10.0
            for kind, v, n in counts:
                if v[j] >= 0:
                    p = posterior[kind, v]
                    yes, yes_all, no, no_all = yes + n * p * v[j], yes_all + n * p, no + n * (1 - p) * v[j], no_all + n * (1 - p)
            # a labeler may be weak but not reversed
            p, q = yes / yes_all, no / no_all
            reliable[name] = (min(0.99, max(p, q, 0.5)), max(0.01, min(p, q, 0.5)))
        for k in prior:
            total = sum(n for kind, _, n in counts if kind == k)
            prior[k] = (3 + sum(n * posterior[kind, v] for kind, v, n in counts if kind == k)) / (5 + total)
    return posterior, reliable


def train(rows: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> Model:
    """The span classifier for (kind, votes, features, count) rows: logistic regression on the posteriors of estimate()."""
    by_votes: dict = {}
    for kind, v, _, n in rows:
        by_votes[kind, v] = by_votes.get((kind, v), 0) + n
    posterior, reliable = estimate([(k, v, n) for (k, v), n in sorted(by_votes.items())])
    bias, w = {k: 0.0 for k in KINDS}, [0.0] * len(FEATURES)
    # a pattern weighs as the logarithm of its count, so frequent kinds don't drown rare ones
    data = [(k, f, posterior[k, v], math.log1p(n)) for k, v, f, n in sorted(rows)]
    total = sum(r[3] for r in data) or 1.0
    for _ in range(rounds):
        db, dw = dict.fromkeys(bias, 0.0), [ridge * x for x in w]
        for k, f, p, n in data:
            e = n / total * (sigmoid(bias[k] + sum(a for a, x in zip(w, f, strict=True) if x)) - p)
            db[k] += e
            for j, x in enumerate(f):
                if x:
                    dw[j] += e
        bias = {k: b - rate * 8 * db[k] for k, b in bias.items()}
        w = [a - rate * 8 * d for a, d in zip(w, dw, strict=True)]
    return Model(bias, tuple(w), reliable)


#: s, k, e, kind as in SPAN; v: votes; f: features.
CANDIDATE = "array<struct<s:int,k:int,e:int,kind:string,v:array<int>,f:array<int>>>"


def candidates_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with candidates (CANDIDATE): every candidate span of its text with its votes and features. The one reading of the texts that the fit and the spans rest on."""
    t = F.col("__t")

    def noted(kind: str):
        return lambda x: F.struct(
            x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), F.array(*votes(kind, x)).alias("v"), F.array(*features(kind, x)).alias("f")
        )

    found = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit(""))).withColumns({f"__{k}": F.transform(c, noted(k)).cast(CANDIDATE) for k, c in candidates(t).items()})
    return found.withColumn("candidates", F.concat(*(F.col(f"__{k}") for k in KINDS))).drop("__t", *(f"__{k}" for k in KINDS))


def fit_candidates(found: DataFrame) -> Model:
    """The model of the candidates of all rows, counted by pattern; the fit itself is over those counts."""
    every = found.where(F.size("candidates") > 0).select(F.explode("candidates").alias("c"))
    counts = every.groupBy("c.kind", "c.v", "c.f").count()
    return train([(r["kind"], tuple(r["v"]), tuple(r["f"]), r["count"]) for r in counts.collect()])


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    return fit_candidates(candidates_of(docs.select(F.col(text_col).alias("text"))))


def confidence(x: Column, model: Model) -> Column:
    """The classifier's probability that a candidate is personal data."""
    z = F.get(F.array(*(F.lit(model.kinds[k]) for k in KINDS)), x["k"])
    for i, weight in enumerate(model.weights):
        z = z + F.get(x["f"], F.lit(i)) * weight
    return 1 / (1 + F.exp(-z))


def spans_of(found: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """found with base_spans and spans instead of candidates."""
    plain = lambda c: F.transform(c, lambda x: F.struct(*(x[n].alias(n) for n in ("s", "k", "e", "kind")))).cast(SPAN)
    n = len(BASE_KINDS)
    base, sure = plain(F.filter("candidates", lambda x: x["k"] < n)), plain(F.filter("candidates", lambda x: (x["k"] >= n) & (confidence(x, model) >= threshold)))
    found = found.withColumns({"base_spans": base, "__more": sure})
    return found.withColumn("spans", F.concat("base_spans", apart(F.col("__more"), F.col("base_spans")))).drop("__more", "candidates")


def find_personal(docs: DataFrame, model: Model | None = None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with base_spans and spans (arrays of s, k, e, kind; code points, end exclusive).

    Without a model, one is fitted on docs: docs and candidates are then written, once, and both the fit and
    the spans read them again. Null texts count as empty and have no spans. Spans of one kind never overlap;
    those of different kinds can, but further spans are only given apart from base spans. Repeated rows each
    get their row; an empty table gives an empty result; columns of docs named base_spans, spans or
    candidates give way to the new ones.
    """
    found = candidates_of(docs.drop(*({"base_spans", "spans", "candidates"} & set(docs.columns) - {text_col})), text_col)
    if model is None:
        found = durable(found, "candidates")
        model = fit_candidates(found)
    return spans_of(found, model, threshold)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = durable(candidates_of(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "candidates")
    spans = spans_of(found, fit_candidates(found))
    n = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *(n(k) for k in BASE_KINDS), F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
