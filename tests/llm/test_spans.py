"""Secrets, personal data and licenses against their plain rules."""

import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from lodegraph.llm import licenses, pii, secrets
from lodegraph.llm.native_spans import SPAN, apart, listed, masked
from tests.llm import brute
from tests.llm.conftest import TEXTS


def random_texts(n=300, seed=3):
    r = random.Random(seed)
    bits = ["password", "Token", "secret", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef", "@", ".", "a.b", "example.com", "192.168", "255", "256", "1", "23", "4111 1111", "4111111111111111", "+", "+49 ", "(0)", "-", "\n", "é", "🙂", "ſ", "K", "gnu", "general", "public", "license", "apache", "mit", "cc", "by", ",", "GNU General Public License"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(TEXTS + random_texts()))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def spans_of(rows):
    return {r["doc_id"]: [(x["kind"], x["s"], x["e"]) for x in r["base_spans"]] for r in rows}


def test_secrets_base(texts):
    rows, df = texts
    got = spans_of(secrets.find_secrets(df).collect())
    for i, t in rows:
        assert sorted(got[i]) == sorted(brute.secrets(t)), t


def test_personal_base(texts):
    rows, df = texts
    got = spans_of(pii.find_personal(df, pii.fit(df)).collect())
    for i, t in rows:
        assert sorted(got[i]) == sorted(brute.personal(t)), t


def test_licenses_base(texts):
    rows, df = texts
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in licenses.find_licenses(df).collect()}
    for i, t in rows:
        assert got[i] == brute.licenses(t), t


def test_entropy_adds_spans_and_allows_placeholders(spark):
    df = spark.createDataFrame([(1, "key Zx9Qw3Er7Ty1Ui5Op2As8Df4 done"), (2, "EXAMPLEZx9Qw3Er7Ty1Ui5Op2As8Df4"), (3, "donaudampfschifffahrtsgesellschaft and internationalization"), (4, "aaaaaaaaaaaaaaaaaaaa1A"), (5, "id 123e4567-e89b-12d3-a456-426614174000")], "doc_id long, text string")
    got = {r[0]: r[1] for r in secrets.find_secrets(df).select("doc_id", listed("spans")).collect()}
    assert got == {1: "entropy:4:28", 2: "", 3: "", 4: "", 5: ""}


def test_window_entropy_is_the_best_windows(spark):
    import math

    words = ["abcdefghij0123456789", "aaaaabbbbbcccccddddd", "zzzzzzzzzzzzzzzzzzzzabcdefghij0123456789zzzz", "Ab1+/_=-Ab1+/_=-Ab1+/_=-"]

    def entropy(s):
        return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))

    df = spark.createDataFrame([(w,) for w in words], "w string")
    for w, h in df.select("w", secrets.window_entropy(df["w"])).collect():
        assert h == pytest.approx(max(entropy(w[i : i + 20]) for i in range(len(w) - 19)))


def test_masking(spark):
    df = spark.createDataFrame([("🙂 write a@b.cd now 10.0.0.1",), ("",), ("nothing",)], "text string")
    found = pii.find_personal(df, pii.fit(df))
    assert [r[0] for r in found.select(masked(found["text"], found["spans"])).collect()] == ["🙂 write [EMAIL] now [IP]", "", "nothing"]


def test_further_kinds(spark):
    df = spark.createDataFrame([(1, "contact Dr. Anna Schmidt, phone (202) 555-0143, write to joe (at) mail (dot) com"), (2, "version 111-11-1111")], "doc_id long, text string")
    got = {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in pii.find_personal(df, pii.fit(df)).collect()}
    assert {"phone_local", "email_text", "name"} <= set(got[1])


def planted(n=240):
    """(text, spans of personal data by kind), and look-alikes that are none."""
    r = random.Random(12)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    name = lambda: word().capitalize()
    fill = lambda: " ".join(word() for _ in range(r.randint(3, 12)))
    real = {
        "phone_local": lambda: (r.choice(["call ", "phone: ", "Tel. ", "my mobile is "]), f"({r.choice('23456789')}{d(2)}) {d(3)}-{d(4)}"),
        "national_id": lambda: (r.choice(["SSN ", "social security number: ", "SSN: "]), f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
        "iban": lambda: (r.choice(["IBAN ", "account: ", "pay to account "]), f"{r.choice(['DE', 'FR', 'ES', 'NL', 'AT'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}"),
        "email_text": lambda: (r.choice(["write to ", "mail ", "contact: "]), f"{word()} [at] {word()} [dot] {r.choice(['com', 'org', 'net'])}"),
        "name": lambda: (r.choice(["dear ", "from ", "regards, "]), f"{r.choice(['Dr.', 'Mr', 'Mrs.', 'Herr', 'Frau', 'Madame'])} {name()} {name()}"),
    }
    fake = [lambda: f"order {d(3)}-{d(2)}-{d(4)}", lambda: f"part no 000-00-{d(4)}", lambda: f"serial {d(3)}-{d(3)}-{d(4)}", lambda: f"ticket {d(3)} {d(3)} {d(4)}", lambda: f"build {d(3)}-{d(2)}-0000", lambda: f"version {d(3)}.{d(3)}.{d(4)}"]
    rows = []
    for i in range(n):
        if i % 2:
            kind = list(real)[i // 2 % len(real)]
            cue, m = real[kind]()
            before = fill() + " " + cue
            rows.append((before + m + " " + fill(), kind, len(before), len(before) + len(m)))
        else:
            rows.append((fill() + " " + r.choice(fake)() + " " + fill(), None, 0, 0))
    return rows


def test_planted_further_kinds(spark):
    """Precision and recall of the kinds beyond the base forms, on planted spans and look-alikes under counter-cues."""
    rows = planted()
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: {(x["kind"], x["s"], x["e"]) for x in r["spans"]} for r in pii.find_personal(df).collect()}
    found = {k: [0, 0] for k in pii.FURTHER}
    false = 0
    for i, (_, kind, s, e) in enumerate(rows):
        if kind:
            found[kind][0] += 1
            found[kind][1] += (kind, s, e) in got[i]
        false += len(got[i] - {(kind, s, e)})
    assert all(hit >= 0.9 * n for n, hit in found.values()), found
    assert false <= 0.1 * sum(n for n, _ in found.values()), (false, [(rows[i][0], got[i]) for i in got if not rows[i][1] and got[i]][:5])


def addresses(n):
    return " ".join(f"u{i}@b{i}.com" for i in range(n))


@pytest.mark.parametrize("find", [pii.find_personal, secrets.find_secrets])
def test_texts_of_megabytes_full_of_spans(spark, find):
    """Twice the spans take about twice the time; every span is found, and masked."""
    import time

    took = []
    for n in (40_000, 80_000):
        text = addresses(n) if find is pii.find_personal else " ".join(f"token=abcdefgh{i} AKIAABCDEFGHIJKL{i}" for i in range(n // 2))
        began = time.time()
        r = find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("spans", masked(F.col("text"), F.col("spans")).alias("m")).first()
        took.append(time.time() - began)
        assert len(r["spans"]) == n and r["m"].count("[") == n and not any(c.islower() for c in r["m"])
        assert all(text[x["s"] : x["e"]].startswith(("u", "token", "AKIA")) for x in r["spans"][:: n // 50])
    assert took[1] < 3 * took[0] + 5


def test_spans_apart_and_masks_against_plain_rules(spark):
    r = random.Random(2)
    rows = []
    for i in range(40):
        n = r.choice([0, 1, 5, 300])
        make = lambda n: sorted({(s, r.randint(0, 3), s + r.randint(1, 6), "kind") for s in (r.randint(0, 2000) for _ in range(n))})  # noqa: E731, B023
        rows.append((i, "".join(r.choice("ab🙂é") for _ in range(2010)), make(n), make(r.choice([0, 2, 200]))))
    df = spark.createDataFrame(rows, f"i int, t string, xs {SPAN}, os {SPAN}")
    for i, a, m in df.select("i", apart(F.col("xs"), F.col("os")), masked(F.col("t"), F.col("xs"))).collect():
        _, t, xs, os = rows[i]
        assert sorted(map(tuple, a)) == [x for x in xs if not any(o[0] < x[2] and x[0] < o[2] for o in os)]
        out, at = "", 0
        for s, _, e, _ in xs:
            if s >= at:
                out += t[at:s] + "[KIND]"
            at = max(at, e)
        assert m == (out + t[at:] if xs else t)


def test_estimation_trusts_labelers_that_agree():
    yes, no = (1, 1, 1, -1, -1, -1), (0, 0, -1, 0, -1, -1)
    posterior, reliable = pii.estimate([("card", yes, 50), ("card", no, 50)])
    assert posterior["card", yes] > 0.9 > 0.1 > posterior["card", no]
    assert reliable["checksum"][0] > 0.8


@pytest.mark.parametrize("find", [secrets.find_secrets, licenses.find_licenses, lambda d: pii.find_personal(d, pii.fit(d))])
def test_corners(find, corner_docs, no_docs):
    assert find(corner_docs.select("doc_id", "text")).count() == corner_docs.count()
    assert find(no_docs.select("doc_id", "text")).count() == 0


def test_clashing_names(corner_docs):
    assert licenses.find_licenses(corner_docs).count() == corner_docs.count()
    assert secrets.find_secrets(corner_docs).count() == corner_docs.count()
    named = corner_docs.withColumnsRenamed({"score": "candidates", "n_words": "n_assign"})
    assert pii.find_personal(named).count() == secrets.find_secrets(named).count() == corner_docs.count()


def test_notice_is_found_with_words_missing(spark):
    notice = licenses.NOTICES[2][1].replace("any person", "anybody at all")
    df = spark.createDataFrame([(1, "x y z " + notice + " tail"), (2, notice[:40])], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.find_licenses(df).collect()}
    assert got[1][0] == "mit" and 0.5 <= got[1][1] < 1
    assert got[2] == ("", 0.0)


def test_digest_of_no_spans(spark):
    assert brute.digest([], ["a"]) == hashlib.sha256(b"").hexdigest()
    assert string.ascii_letters  # the alphabet of candidates holds them all
    assert set(string.ascii_letters + string.digits) <= set(secrets.ALPHABET)
