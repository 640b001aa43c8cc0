import itertools
import math
import random

import numpy as np
import pytest

from lodegraph.llm import html_extract as h, quality as q
from lodegraph.llm.crf import CRF, forward_backward
from tests.llm import brute


def by_enumeration(emit, trans, start):
    """Marginals of label 1, and the likeliest labels, over all labellings of one chain."""
    scores = {}
    for y in itertools.product((0, 1), repeat=len(emit)):
        scores[y] = start[y[0]] + sum(emit[i][y[i]] for i in range(len(y))) + sum(trans[a][b] for a, b in zip(y, y[1:], strict=False))
    z = sum(map(math.exp, scores.values()))
    return [sum(math.exp(s) for y, s in scores.items() if y[i]) / z for i in range(len(emit))], max(scores, key=scores.get), math.log(z)


def test_marginals_and_viterbi():
    rng = np.random.default_rng(1)
    field = CRF(rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
    xs = [rng.normal(size=(n, 3)) for n in (1, 5, 3, 8)]
    sizes = np.array([len(x) for x in xs])
    full = np.concatenate(xs)
    got = np.split(field.marginals(full, sizes), np.cumsum(sizes)[:-1])
    z = 0.0
    for x, m in zip(xs, got, strict=True):
        want, path, log_z = by_enumeration(field.emit(x), field.trans, field.start)
        z += log_z
        assert m == pytest.approx(want) and tuple(field.viterbi(x)) == path
    assert forward_backward(field.emit(full), field.trans, field.start, sizes)[2] == pytest.approx(z)


def pages():
    body = "<p>" + "A long enough sentence about things, with words. " * 4 + "</p>"
    return [
        "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>Head &amp; tail</h1>" + body + "<p><b>Bold<br>line</p></article><section class=comments><p>Nice post!</p></section><footer>&copy; me</footer></body></html>",
        "<body><header><h2>Site</h2></header><main><h1>Title</h1>" + body * 2 + "</main><aside class=sidebar><p>Other stories</p></aside><script>var a='</p><p>x';</script><form><label>Name</label></form>",
    ]


def test_extracts_the_article():
    field = h.trained()
    body = ("A long enough sentence about things, with words. " * 4).strip()
    assert h.extract(pages()[0], field) == f"Head & tail\n\n{body}\n\nBold line"
    assert h.extract(pages()[1], field) == f"Title\n\n{body}\n\n{body}"


def test_held_out_pages():
    field, r, right, total = h.trained(), random.Random(99), 0, 0
    for _ in range(150):
        parts = h.labelled_page(r)
        page = "".join(m + h.html.escape(t) for m, t, _ in parts)
        want = "\n\n".join(h._SPACE.sub(" ", t).strip() for _, t, main in parts if main and t.strip())
        right, total = right + (h.extract(page, field) == want), total + 1
    assert right / total > 0.95


def test_html_corners(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<"), (4, "u", "<article><p>cut off he"), (5, "u", "no markup at all"), (5, "u", "no markup at all"), (6, "u", "<p>" * 3000 + "deep"), (7, "u", "<!-- only --><script>x"), (8, "u", "</p></div>stray")]
    df = spark.createDataFrame([(*r, "text") for r in rows], "page_id long, url string, html string, text string")
    got = h.extract_text(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[1] == ""
    assert h.extract_text(df.limit(0)).count() == 0


def test_foreign_and_fallback_parts_of_an_article():
    long = "A long enough sentence about things, with words. " * 3
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{long}<svg class=i/></p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds. {long}</p><math/><p>{long}<svg><text>axis</text></svg></p>"
    page += f"<noscript><p>Without scripts: {long}</p></noscript><object data=x><p>Without a viewer: {long}</p></object><canvas><p>Without a canvas: {long}</p></canvas></article><footer>&copy; me</footer></body>"
    body = long.strip()
    assert h.extract(page, h.trained()).split("\n\n") == ["Title", body, f"So x=2 holds. {body}", body, f"Without scripts: {body}", f"Without a viewer: {body}", f"Without a canvas: {body}"]
    assert h.extract(f"<body><noscript>Please enable scripts.</noscript><h1>Title</h1><p>{long}</p></body>", h.trained()) == f"Title\n\n{body}"


def test_other_makes_of_pages():
    """Layouts that the training generator doesn't know: deep wrappers, layout tables, definition lists, lists without ends, no main part at all."""
    p = ["The first paragraph says enough about its subject to be read. It goes on a little.", "A second one follows it, just as long as the first, and ends here."]
    field = h.trained()
    deep = "<div class=wrap>" * 40 + "<div class=post>" + f"<h1>Head</h1><p>{p[0]}</p><p>{p[1]}</p>" + "</div>" * 41
    page = f"<html><body><div class='topbar menu'><a href=a>One</a><a href=b>Two</a></div>{deep}<div class=footer>Copyright us</div></body></html>"
    assert h.extract(page, field) == f"Head\n\n{p[0]}\n\n{p[1]}"
    cells = f"<table><tr><td class=nav><ul><li><a href=a>One<li><a href=b>Two</ul></td><td><div id=content><h2>Head</h2><p>{p[0]}<p>{p[1]}</div></td></tr></table>"
    assert h.extract(cells, field) == f"Head\n\n{p[0]}\n\n{p[1]}"
    terms = f"<nav><a href=a>One</a></nav><article><h1>Head</h1><dl><dt>Term<dd>{p[0]}<dt>Other<dd>{p[1]}</dl></article><aside class=widget><p>Read next</p></aside>"
    assert h.extract(terms, field) == f"Head\n\nTerm\n\n{p[0]}\n\nOther\n\n{p[1]}"
    bare = f"<h1>Head</h1><p>{p[0]}</p><p>{p[1]}</p><div class=share><a href=x>Share this</a></div>"
    assert h.extract(bare, field) == f"Head\n\n{p[0]}\n\n{p[1]}"


def test_nesting_takes_time_in_proportion():
    import time

    field = h.trained()
    for piece in ("<div>x", "<ul><li>x", "<span class='a b'>x ", "<p>x", '<a href="', "<script>x", "<!-- "):
        took = []
        for n in (20_000, 40_000):
            began = time.time()
            h.extract(piece * n, field)
            took.append(time.time() - began)
        assert took[1] < 4 * max(took[0], 0.1), piece


def plain_line(lines, i):
    """The features of a line, written character by character and word by word."""
    raw, w = lines[i], brute.words(lines[i].decode("utf-8", "replace"))
    n = len(raw)
    count = lambda chars: sum(b in chars.encode() for b in raw)
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    some = max(1, len(w))
    marks = 0
    low = raw.decode().translate(brute.UPPER)
    at = 0
    for x in w:
        at = low.index(x, at) + len(x)
        marks += at < len(low) and low[at] in "*#$%&@^~=+_<>{}[]\\/`!?|"
    same = float(i > 0 and w == brute.words(lines[i - 1].decode()) and bool(w))
    return [upper / max(1, upper + lower), count("0123456789") / n, count("*#$%&@^~=+_<>{}[]\\/`") / n, count("!?") / n, count("|") / n, count(".,;:") / n, count(" \t\r\x0b\x0c") / n,
            math.log(n) / 6, math.log1p(len(w)) / 4, min(40, n / some) / 8, sum(a == b for a, b in zip(w, w[1:], strict=False)) / some, len(set(w)) / some if w else 1, same, marks / some]


def test_line_features_against_plain_rules():
    texts = ["One line, two words!\nsame words here\nsame words here\n\nX X X x | y", "é🙂 ABC 12*3 a#b\n   \n!!!\nword", "tail\ttab a/ b", "a"]
    for t in texts:
        lines = [x.encode() for x in t.split("\n") if x.strip()]
        x, n, size = q.line_features([t.encode()])
        assert n.tolist() == [len(lines)] and size.tolist() == [len(a) for a in lines]
        for i in range(len(lines)):
            assert x[i].tolist() == pytest.approx(plain_line(lines, i)), (t, i, dict(zip(q.LINE_FEATURES, zip(x[i].tolist(), plain_line(lines, i), strict=True), strict=True)))


def test_the_sample_does_not_depend_on_where_rows_lie(spark):
    rows = [(i % 40, f"text {i} of many, with words and {'!' * (i % 5)}") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (q.train_quality(docs.repartition(n), labels, sample_docs=20) for n in (1, 7))
    assert (a.field.weights == b.field.weights).all() and (a.slope, a.bias) == (b.slope, b.bias)


def corpus(n=240):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeinorst") for _ in range(r.randint(2, 8)))
    good = lambda: "\n".join(" ".join(word() for _ in range(r.randint(5, 20))).capitalize() + "." for _ in range(r.randint(2, 6)))
    bad = [lambda: "\n".join(" | ".join(word() for _ in range(9)) for _ in range(3)), lambda: " ".join(word().upper() + "!!" for _ in range(40)), lambda: "\n".join([word()] * 12), lambda: (word() + " ") * 50]
    return [(i, good(), 1) if i % 3 else (i, r.choice(bad)(), 0) for i in range(n)]


def test_quality_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None)], "doc_id long, quality int")
    model = q.train_quality(docs, labels)
    got = q.score_quality(docs, model, keep=["doc_id"]).withColumn("held_out", q.held_out()).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"]]
    assert len(held) > 30 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_a_score_is_the_texts_alone(spark):
    texts = [t for _, t, _ in corpus(60)]
    model = q.fit_quality([t.encode() for t in texts], np.array([1.0 if i % 3 else 0.0 for i in range(60)]), rounds=30)
    together = q.scores([t.encode() for t in texts], model)
    alone = np.array([q.scores([t.encode()], model)[0] for t in texts])
    assert together == pytest.approx(alone, abs=1e-9)


def test_quality_corners(spark, corner_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (17, 0), (5, 1), (16, 0)], "doc_id long, quality int")
    model = q.train_quality(corner_docs, labels)
    assert q.score_quality(corner_docs, model).count() == corner_docs.count()
    assert q.score_quality(no_docs, model).count() == 0
    untrained = q.train_quality(no_docs, labels)
    assert {r["score"] for r in q.score_quality(corner_docs, untrained).collect()} == {0.5}
