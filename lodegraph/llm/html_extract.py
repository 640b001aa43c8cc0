"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes a run of leaf blocks: text between block-level tags, with the tags and class words of its
ancestors. Features of ancestors and text score each block as main text or not, neighbours couple, and
Viterbi decodes the page. The field is trained on labelled pages that a seeded generator lays out from the
usual parts of a page (menus, notices, adverts, articles, comments and so on).
"""

from __future__ import annotations

import html
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.common import by_bytes, table
from lodegraph.llm.crf import CRF, train_crf

#: Tags that bound a block, tags whose contents are no text, tags without an end, foreign tags, which "/>" ends, and
#: tags whose text stands in for what can't be shown: a notice, but in a main part, where it is read as any other.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul option select".split())
RAW = frozenset("script style template textarea iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN = frozenset(("svg", "math"))
FALLBACK = frozenset(("noscript", "object", "canvas"))
#: What starting one of these ends, if open.
ENDS = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)

#: Words of ancestors' tags, classes and ids that say what a block is for.
ROLES = {
    "menu": "nav menu navbar breadcrumb breadcrumbs pagination pager tabs toc navigation sitemap topbar",
    "head": "head header masthead banner title topnav branding logo",
    "foot": "footer foot copyright colophon legal bottom",
    "side": "aside sidebar side rail widget related recommended trending popular complementary",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion teaser",
    "notice": "notice cookie cookies consent gdpr alert modal popup overlay newsletter subscribe paywall announcement dialog",
    "form": "form search login signup fieldset button label select option input",
    "comment": "comment comments reply replies discussion disqus responses feedback reader",
    "share": "share social follow tweet sharing tags meta byline",
    "main": "article main content post entry story body-text articlebody post-content entry-content article-body maincontent",
}
_ROLE = {w: k for k, ws in ROLES.items() for w in ws.split()}
FEATURES = ("bias", *(f"role:{k}" for k in ROLES), "nearest_main", "nearest_other", "p", "heading", "li", "cell", "linked", "short", "long", "stops", "copyright", "first", "last", "digits", "bare")


#: What features ask of ancestors' tags, and tags that a tag to be ended may not lie under.
_FLAG = {"p": 1, "li": 2, "td": 4, "th": 4} | {f"h{i}": 8 for i in range(1, 7)}
_WALLS = ("td", "th", "ul", "ol", "table", "article", "section", "div")


class Block:
    """Text under one list of open tags: the roles of them all, those of the nearest that has any, and flags (_FLAG) of their names."""

    __slots__ = ("flags", "link", "nearest", "parts", "roles")

    def __init__(self, roles, nearest, flags):
        self.roles, self.nearest, self.flags, self.parts, self.link = roles, nearest, flags, [], 0


class Open:
    """The open tags. Every one knows what it and those above it come to, and the places of a name are kept, so that nothing walks the list."""

    def __init__(self):
        self.tags: list[str] = []
        self.sums: list[tuple[frozenset, frozenset, int]] = []  # roles, nearest, flags
        self.places: dict[str, list[int]] = {}
        self.unions: dict[tuple[frozenset, frozenset], frozenset] = {}

    def state(self) -> tuple[frozenset, frozenset, int]:
        return self.sums[-1] if self.sums else (frozenset(), frozenset(), 0)

    def push(self, tag: str, roles: frozenset) -> None:
        above, nearest, flags = self.state()
        both = (above, roles)
        if both not in self.unions:
            self.unions[both] = above | roles
        self.sums.append((self.unions[both], roles or nearest, flags | _FLAG.get(tag, 0)))
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)

    def last(self, *tags: str) -> int:
        """The place of the last open tag of a name; -1 without one."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def close(self, at: int) -> None:
        """Ends the tag at a place and all that are open below it."""
        while len(self.tags) > at:
            self.places[self.tags.pop()].pop()
            self.sums.pop()


@cache
def _close(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I)


def roles_of(tag: str, attrs: str) -> frozenset:
    found = {_ROLE[tag]} if tag in _ROLE else set()
    for m in _ATTR.finditer(attrs or ""):
        for w in (m[1] or m[2] or m[3] or "").lower().split():
            found.update(_ROLE[x] for x in {w, *re.split(r"[-_]", w)} if x in _ROLE)
    if tag == "article" or tag == "main":
        found = {"main"}
    return frozenset(found)


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks that hold text, in page order. Unclosed tags end with the page; an end tag that nothing opened is passed over."""
    opened = Open()
    out: list[Block] = []
    current: Block | None = None
    at = 0

    def text(s: str) -> None:
        nonlocal current
        if not s:
            return
        if current is None:
            if not s.strip():
                return
            current = Block(*opened.state())
            out.append(current)
        current.parts.append(s)
        if opened.last("a") >= 0:
            current.link += len(s)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            text(html.unescape(page[at:]))
            break
        if m.start() > at:
            text(html.unescape(page[at : m.start()]))
        at = m.end()
        end, tag = m[1], m[2]
        if end:
            end = end.lower()
            if end in BLOCK:
                current = None
            if (place := opened.last(end)) >= 0:
                opened.close(place)
        elif tag:
            tag = tag.lower()
            if tag in FOREIGN and m[0].endswith("/>"):
                continue
            if tag in RAW:
                close = _close(tag).search(page, at)
                at = close.end() if close else len(page)
                continue
            if tag == "br":
                text(" ")
                continue
            if tag in BLOCK:
                current = None
                # an inline element can't hold a block it did not close; what a new paragraph ends is closed
                for t in ENDS.get(tag, ("p",)):
                    place = opened.last(t)
                    if place >= 0 and opened.last(*_WALLS) <= place:
                        opened.close(place)
            if tag not in VOID and not m[0].endswith("/>"):
                attrs = m[3] or ""
                notice = "hidden" in attrs.lower() and _HIDDEN.search(attrs) or tag in FALLBACK and "main" not in opened.state()[0]
                opened.push(tag, roles_of(tag, attrs) | ({"notice"} if notice else frozenset()))
    return [b for b in out if "".join(b.parts).strip()]


def block_text(b: Block) -> str:
    return _SPACE.sub(" ", "".join(b.parts)).strip()


def block_features(blocks: list[Block], texts: list[str]) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)))
    roles = list(ROLES)
    main = any("main" in b.roles for b in blocks)
    for i, (b, s) in enumerate(zip(blocks, texts, strict=True)):
        x[i, 0] = 1
        for r in b.roles:
            x[i, 1 + roles.index(r)] = 1
        k = 1 + len(roles)
        x[i, k : k + 15] = (
            "main" in b.nearest, bool(b.nearest) and "main" not in b.nearest, bool(b.flags & 1), bool(b.flags & 8), bool(b.flags & 2), bool(b.flags & 4),
            b.link / max(1, sum(map(len, b.parts))), len(s) < 40, len(s) >= 120, min(3, len(re.findall(r"[.!?](?:\s|$)", s))) / 3, "©" in s or "copyright" in s.lower(), i == 0, i == len(blocks) - 1,
            sum(c.isdigit() for c in s) > 0.3 * len(s), not main and not b.roles,
        )
    return x


# --- labelled pages -----------------------------------------------------------------------------


def labelled_page(rng: random.Random) -> list[tuple[str, str, bool]]:
    """Parts of a page as (opening markup, text, is main); joined they are the page."""
    syllables = "an be co da el fi go ha in jo ka le mi no or pa qu ri so te un ve wi".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    sentence = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice([".", ".", ".", "!", "?"])
    para = lambda: " ".join(sentence(3, 14) for _ in range(rng.randint(1, 6)))
    wild = lambda: rng.choice([para(), para(), para().upper(), " ".join(f"{word()}{rng.choice(['***', '&&&', '###', '!!'])}" for _ in range(rng.randint(2, 60))), word(), " | ".join(word() for _ in range(rng.randint(2, 20)))])
    parts: list[tuple[str, str, bool]] = [("<title>", para()[:60], False), ("</title>", "", False)]

    def menu(open_: str, close: str) -> None:
        for i in range(rng.randint(2, 8)):
            parts.append(((open_ if not i else "") + "<li><a href=x>", word() + " " * rng.randint(0, 1) + rng.choice(["", word()]), False))
        parts.append((close, "", False))

    def boxed(name: str, tag: str = "div") -> None:
        inner = rng.choice(["", "<p>", "<h3>", "<span>", "<ul><li>"])
        for _ in range(rng.randint(1, 3)):
            parts.append((f'<{tag} class="{name}">{inner}', wild(), False))
            parts.append((f"</{tag}>", "", False))

    if rng.random() < 0.7:
        menu(*(("<nav><ul>", "</ul></nav>") if rng.random() < 0.6 else ('<div class="menu"><ul>', "</ul></div>")))
    if rng.random() < 0.5:
        parts.append(("<header><h2>", sentence(1, 4), False))
        parts.append(("</h2></header>", "", False))
    for name in ("notice", "cookie-banner", "ad", "newsletter", "sponsored", "advert", "alert", "breadcrumbs"):
        if rng.random() < 0.25:
            boxed(name)
    if rng.random() < 0.25:
        parts.append((f'<form class="{rng.choice(["search", "login", "f"])}"><label>', wild(), False))
        parts.append(("</label></form>", "", False))
    if rng.random() < 0.3:
        boxed(rng.choice(["sidebar", "widget"]), "aside")
    holder = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ('<div class="post entry-content">', "</div>"), ("<main><article>", "</article></main>"), ("", "")])
    plain = not holder[0]
    parts.append((holder[0] + f"<h{rng.randint(1, 2)}>", para()[:60] if rng.random() < 0.7 else wild()[:60], True))
    parts.append(("</h1></h2>", "", False))
    for _ in range(rng.randint(1, 10)):
        kind = rng.random()
        if kind < 0.75 or plain:
            parts.append(("<p>", para() if plain else wild(), True))
        elif kind < 0.82:
            parts.append(("<blockquote>", para(), True)), parts.append(("</blockquote>", "", False))
        elif kind < 0.88:
            parts.append(("<h3>", sentence(1, 6), True)), parts.append(("</h3>", "", False))
        elif kind < 0.94:
            for i in range(rng.randint(1, 4)):
                parts.append(("<ul><li>" if not i else "<li>", wild(), True))
            parts.append(("</ul>", "", False))
        else:
            boxed(rng.choice(["ad", "promo", "related", "share", "newsletter"]), rng.choice(["div", "aside"]))
    if rng.random() < 0.3:
        boxed("comments", "section")
        closed = ""
    else:
        closed = holder[1]
    parts.append((holder[1], "", False))
    if rng.random() < 0.4 and closed:
        boxed(rng.choice(["comments", "comment", "replies", "reader-comments"]), rng.choice(["div", "section"]))
    if rng.random() < 0.3:
        boxed(rng.choice(["sidebar", "related", "widget"]), rng.choice(["aside", "div"]))
    if rng.random() < 0.85:
        parts.append(("<footer>" if rng.random() < 0.7 else '<div class="footer"><p>', "© " * (rng.random() < 0.6) + wild(), False))
    return parts


def trained(pages: int = 400, seed: int = 7) -> CRF:
    """The field, from pages labelled pages."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, marks = "", []
        for k, (markup, text, main) in enumerate(labelled_page(rng)):
            if text:
                page += f"{markup}\x01{k}\x02{html.escape(text)}"
                marks.append(main)
            else:
                page += markup
        labels = {}
        n = -1
        for m in re.finditer("\x01(\\d+)\x02", page):
            n += 1
            labels[m[1]] = marks[n]
        blocks = blocks_of(page)
        x_texts, y = [], []
        for b in blocks:
            s = block_text(b)
            found = re.findall("\x01(\\d+)\x02", s)
            b.parts = [re.sub("\x01\\d+\x02", "", p) for p in b.parts]
            x_texts.append(block_text(b))
            y.append(int(bool(found) and labels[found[0]]))
        if blocks:
            xs.append(block_features(blocks, x_texts))
            ys.append(np.array(y))
    return train_crf(xs, ys, rounds=150)


def extract(page: str, field: CRF) -> str:
    """The main blocks of a page, joined by blank lines; empty if none."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    texts = [block_text(b) for b in blocks]
    kept = field.viterbi(block_features(blocks, texts))
    return "\n\n".join(s for s, k in zip(texts, kept, strict=True) if k and s)


def extract_text(pages: DataFrame, field: CRF | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per row of pages: the columns of keep, text, n_chars (code points).

    Null or empty html gives empty text. Pages that break off keep what came before. Repeated rows each
    get their row; an empty table gives an empty result; columns outside keep are not read.
    """
    field = field or trained()
    names = [c for c in keep if c not in ("text", "n_chars")]
    out = T.StructType([*(pages.schema[c] for c in names), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in by_bytes(batches, len(names)):
            texts = [extract(x or "", field) for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array([len(s) for s in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*names, F.col(html_col).alias("__html")).mapInArrow(run, out)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_extract": op9_html_extract}
ORACLES: dict[str, str] = {}
