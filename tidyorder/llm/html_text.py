"""Main text of web pages: the best contiguous stretch of words and tags.

A page is a row of tokens. A word scores positive, a tag negative; how much is learned from
labelled pages, those whose markup names the article (`article`, `main`, `role=main`): words
are told apart by the block they stand in, by links and by elements that are page furniture
after their name, role, class or id; tags by name. The log odds of standing inside the labelled
article, smoothed by a weak prior, are the weights, bounded so that a word can outweigh two
tags. The labels themselves are not scored: on every page, labelled or not, one linear scan
finds the stretch of greatest sum (ties: the earliest). Dense markup (menus, link lists) thus
parts the article from what surrounds it, and furniture within the stretch is left out.

Rows are independent, nothing is shuffled: pages are read whole, one slice of an Arrow batch
at a time. Weights are counted on about `sample` labelled pages (chosen by a hash of the page)
and number at most a few hundred. Character references are decoded; white space becomes one
space; blocks are joined by one space. A tag left open at the end of a page ends it. Null and
empty pages, and pages without words, have an empty text; repeated rows are treated one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyorder.llm.common import slices

#: Pages that the weights are counted on.
SAMPLE = 5_000
SLICE_BYTES = 8 << 20
WORD_MOST, TAG_MOST, LEAST = 3.5, 1.5, 0.05
PRIOR_TOKENS = 20

# How elements lay out, and words that name page furniture.
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
ENDS_PARAGRAPH = BLOCKS - set("br body html head td th tr tbody thead tfoot caption option optgroup legend summary".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}, "body": {"head"}}
FURNITURE_TAGS = set("nav aside footer form menu dialog button select datalist noscript template svg canvas object audio video head search".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status toolbar".split())
FURNITURE_WORDS = set(
    "ad ads adsense advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright "
    "disclaimer discussion disqus footer footnav gdpr legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager "
    "pagination paywall popup promo promos promotion promoted recommended recommendations related replies reply respond share sharing shares sidebar sidebars signin signup skip social "
    "sponsor sponsored sponsors subscribe subscription toolbar topbar trending widget widgets".split()
)
SITE_HEADER_WORDS = {"header", "head", "topnav", "brand", "logo"}
STATES = {"has", "with", "no", "without", "is", "not"}
ARTICLE_TAGS = {"article", "main"}

# Share of the tokens of a kind that the prior expects inside an article.
PRIOR_WORDS = {"p": 0.95, "blockquote": 0.95, "pre": 0.9, "figcaption": 0.75, "li": 0.8, "dd": 0.8, "td": 0.6, "div": 0.6, "section": 0.6, **{f"h{k}": 0.8 for k in range(1, 7)}}
PRIOR_TAGS = {"p": 0.48, "br": 0.48, "li": 0.3, "ul": 0.25, "ol": 0.3, "div": 0.35, "section": 0.4, "a": 0.15, "table": 0.4, **{t: 0.48 for t in "b i em strong span sub sup code q cite u small".split()}}
OTHER_WORDS, OTHER_TAGS, LINKED, FURNISHED = 0.55, 0.4, 0.3, 0.05
KNOWN = BLOCKS | VOID | RAW | FURNITURE_TAGS | set(PRIOR_TAGS) | {"abbr", "font", "img", "label", "time", "mark", "del", "ins", "s", "strike", "var", "kbd", "samp", "data", "picture"}

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)|</?[!?].*?(?:>|\Z)|</(?![a-zA-Z]).*?(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


def _named_furniture(value: str, in_article: bool) -> bool:
    """Does a word of a class or id name page furniture? `has-sidebar` and the like do not."""
    for token in value.split():
        words = [w.lower() for w in _NAMES.findall(token)]
        if words and words[0] not in STATES:
            if any(w in FURNITURE_WORDS or (not in_article and w in SITE_HEADER_WORDS) for w in words):
                return True
    return False


def _kinds(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(is the element page furniture, is it an article)."""
    found = _attributes(attributes) if attributes and not attributes.isspace() else {}
    article = name in ARTICLE_TAGS or found.get("role") == "main"
    furniture = name in FURNITURE_TAGS or (name == "header" and not in_article)
    if found and name not in ("html", "body", "main"):
        furniture = furniture or found.get("role", "").lower() in FURNITURE_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
        furniture = furniture or "display:none" in found.get("style", "").replace(" ", "").lower()
        furniture = furniture or any(_named_furniture(found[a], in_article) for a in ("class", "id") if a in found)
    return furniture, article and not furniture


class Page:
    """Tokens of a page: texts with their number of words, and tags.

    `keys` has a kind per token (`w…` for texts, `t…` for tags), `words` the number of words (0
    for tags), `texts` the raw text (for tags a space, where they break the line, or nothing),
    `inside` whether the labels of the page hold the token for article."""

    def __init__(self, html: str):
        self.keys: list[str] = []
        self.words: list[int] = []
        self.texts: list[str] = []
        self.inside: list[bool] = []
        self.labelled = False
        self._read(html)

    def _read(self, html: str) -> None:
        # an open block: name, what held outside it, its open inline elements
        blocks: list[tuple[str, bool, bool, bool, list, Counter]] = []
        open_blocks: Counter = Counter()
        furniture = article = linked = False
        inlines: list[tuple[str, bool, bool]] = []
        open_inlines: Counter = Counter()
        block, at = "body", 0

        def tag(name: str, closing: bool, marked: bool) -> None:
            known = name if name in KNOWN else "other"
            self.keys.append(f"t{'/' if closing else ''}{known}{'!' if marked else ''}")
            self.words.append(0)
            self.texts.append(" " if name in BLOCKS else "")
            self.inside.append(article and not marked)

        def text(piece: str) -> None:
            if piece:
                n = len(piece.split())
                self.keys.append(f"w{block if block in KNOWN else 'other'}{'@' if linked else ''}{'!' if furniture else ''}")
                self.words.append(n)
                self.texts.append(piece)
                self.inside.append(article and not furniture)

        def leave() -> None:
            nonlocal furniture, article, linked, inlines, open_inlines, block
            name, furniture, article, linked, inlines, open_inlines = blocks.pop()
            open_blocks[name] -= 1
            block = blocks[-1][0] if blocks else "body"

        while True:
            start = html.find("<", at)
            found = _TOKEN.match(html, start) if start >= 0 else None
            while start >= 0 and found is None:  # a bare <
                start = html.find("<", start + 1)
                found = _TOKEN.match(html, start) if start >= 0 else None
            text(html[at : start if found else len(html)])
            if found is None:
                return
            at = found.end()
            if found[2] is None:  # a comment
                continue
            name, closing = found[2].lower(), found[1] == "/"
            if closing:
                marked = furniture
                if name in BLOCKS or name in FURNITURE_TAGS:
                    if open_blocks[name]:
                        while blocks[-1][0] != name:
                            leave()
                        tag(name, True, marked)
                        leave()
                    elif name in ("p", "br"):  # others that close nothing are no tags
                        tag(name, True, marked)
                elif open_inlines[name]:
                    while inlines[-1][0] != name:
                        open_inlines[inlines.pop()[0]] -= 1
                    _, furniture, linked = inlines.pop()
                    open_inlines[name] -= 1
                    tag(name, True, marked)
                continue
            while blocks and (blocks[-1][0] in SIBLINGS.get(name, ()) or (blocks[-1][0] == "p" and name in ENDS_PARAGRAPH)):
                leave()
            if name in RAW:
                tag(name, False, True)
                end = _RAW_END[name].search(html, at)
                at = end.start() if end else len(html)
                continue
            marks, is_article = _kinds(name, found[3], article)
            self.labelled = self.labelled or (is_article and not furniture)
            tag(name, False, furniture or marks)
            if name in VOID or (found[3].endswith("/") and name not in BLOCKS):
                continue
            if name in BLOCKS or name in FURNITURE_TAGS:
                blocks.append((name, furniture, article, linked, inlines, open_inlines))
                open_blocks[name] += 1
                block, inlines, open_inlines = name, [], Counter()
                article = article or (is_article and not furniture)
                furniture = furniture or marks
            else:
                inlines.append((name, furniture, linked))
                open_inlines[name] += 1
                furniture, linked = furniture or marks, linked or name == "a"


def prior(key: str) -> float:
    """Share of tokens of a kind that are expected inside an article before any is counted."""
    name = key.lstrip("wt/").rstrip("!@")
    if key.endswith("!"):
        return FURNISHED
    if key[0] == "w":
        return LINKED if key.endswith("@") else PRIOR_WORDS.get(name, OTHER_WORDS)
    return PRIOR_TAGS.get(name, OTHER_TAGS)


def weight(key: str, inside: int = 0, outside: int = 0) -> float:
    """Positive for words, negative for tags: bounded log odds of standing inside the article."""
    p = (inside + PRIOR_TOKENS * prior(key)) / (inside + outside + PRIOR_TOKENS)
    odds = math.log(max(p, 1e-9) / max(1 - p, 1e-9))
    return min(max(odds, LEAST), WORD_MOST) if key[0] == "w" else -min(max(-odds, LEAST), TAG_MOST)


def token_counts(html: str | None) -> Counter:
    """(kind of token, inside) of a labelled page with its number; nothing of other pages."""
    page, counts = Page(html or ""), Counter()
    if page.labelled:
        for key, n, inside in zip(page.keys, page.words, page.inside):
            counts[key, inside] += n if key[0] == "w" else 1
    return counts


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the stretch of greatest positive sum, the earliest of several; (0, 0) if
    there is none."""
    best, found, total, first = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += s
        if total > best:
            best, found = total, (first, i + 1)
    return found


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The article of a page."""
    if not html:
        return ""
    page = Page(html)
    scores = [(weights[k] if k in weights else weights.setdefault(k, weight(k))) * (n if k[0] == "w" else 1) for k, n in zip(page.keys, page.words)]
    first, end = best_stretch(scores)
    # furniture is left out, but it still parts what stands before and after it
    pieces = [t if k[-1] != "!" else " " * (k[0] == "t") * (t == " ") for k, t in zip(page.keys[first:end], page.texts[first:end])]
    return " ".join(" ".join(unescape("".join(p)).split()) for p in _blocks(pieces)).strip()


def _blocks(pieces: list[str]) -> Iterator[list[str]]:
    """Texts between line breaks; references are decoded within one block."""
    held: list[str] = []
    for p in pieces:
        if p == " ":
            if any(x.strip() for x in held):
                yield held
            held = []
        else:
            held.append(p)
    if any(x.strip() for x in held):
        yield held


def learn_weights(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights of the kinds of tokens, counted on about `sample` labelled pages. There are at
    most a few hundred kinds, whatever the pages."""
    rows = pages.select(F.col(html_col).alias("html")).filter("html is not null")
    share = min(1.0, sample / max(1, rows.count()))
    chosen = rows.filter(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for piece in slices(iter([batch]), "html"):
                for html in piece.column(0).to_pylist():
                    total.update(token_counts(html))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["key", "inside", "n"]
        )

    counted = chosen.mapInArrow(count, "key string, inside boolean, n long").groupBy("key").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outside")
    )
    return {r.key: weight(r.key, r.inside, r.outside) for r in counted.collect()}


def extract_text(
    pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """(page_id, url, text): the main text of every page, under `weights` or those learned from
    the labelled pages among them."""
    weights = learn_weights(pages, html_col) if weights is None else dict(weights)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(weights)
        for batch in slices(batches, "html", slice_bytes):
            texts = [main_text(h, known) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    return rows.mapInArrow(read, f"{schema}, text string")
