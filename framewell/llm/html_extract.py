"""Main text of web pages by a tree-structured graphical model.

A page is parsed to a tree of its block-level elements.  Each is content or boilerplate, a binary
variable with a potential from its own features (tag, words in class, id and role, text length, link
density, punctuation, place); each parent and child share a potential that depends on the kind of
the child.  Sum-product messages, upward and then downward, give every element's exact marginal; an
element whose marginal of being content is above one half yields its own text.

The weights are fitted by exact gradients of the conditional likelihood, by the same messages, on
labelled pages that generate_pages() writes from a seed in many layouts: none of the corpus is used.

All pages of a batch are worked level by level at once, so the model costs little beyond parsing.

Defined results: null and empty html, and pages in which nothing is content, give the empty text;
scripts, styles, templates, form controls, comments and the head never give text; a `<` that begins
no tag is text; unclosed and misnested tags are closed as browsers do for block elements; a line
break is white space; character references are decoded as HTML5 has it; rows of any length are worked
whole, in time that grows with their length however they nest; repeated rows and ids give a row each,
a null id or url as any other; an empty table gives an empty result; only id, url and html are read,
so further columns may have any name.
"""

import functools
import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from framewell.llm.common import as_text

#: HTML's block-level elements and those that never give text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("head noscript template button select option optgroup datalist object svg math canvas audio video label".split())
#: Elements of other languages, in which a start tag that ends in a slash is a whole element, and those in them that hold HTML again.
FOREIGN = frozenset(("svg", "math"))
FOREIGN_ENDS = frozenset("foreignobject desc mi mo mn ms mtext".split())
#: What a start tag closes, up to the nearest element that bounds it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
CLOSES |= {x: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for x in ("thead", "tbody", "tfoot")}
P_ENDS = BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"} | {"hr"}
P_BOUNDS = frozenset("td th caption button object table html body".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: Tags that never close a quote may be looked for so often in a page, each time up to its end.
_OPEN_QUOTES = 8
#: Elements nested deeper hang on their ancestor at this depth, as browsers' parsers have it; their text counts as ever.
DEEPEST = 512
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[a-z]+")
#: Attributes that end in an unquoted value, which the slash belongs to.
_BARE = re.compile(r"""=\s*[^\s"']*/$""")

TAGS = "article main section div p h li ul table quote pre nav header footer aside form figure body other".split()
_KIND = {x: x for x in TAGS} | dict.fromkeys("h1 h2 h3 h4 h5 h6 hgroup".split(), "h") | dict.fromkeys("li dt dd".split(), "li") | dict.fromkeys("ul ol dl".split(), "ul") | dict.fromkeys("table tbody thead tfoot tr td th caption".split(), "table") | {"blockquote": "quote", "fieldset": "form", "legend": "form", "search": "form", "menu": "nav", "dir": "nav", "dialog": "aside", "figcaption": "figure", "html": "body"}
#: Words of class, id and role, by what they tell of.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs tabs toc pagination pager skip topbar toolbar",
    "head": "header masthead branding logo banner",
    "foot": "footer foot contentinfo copyright legal colophon bottom",
    "side": "sidebar side aside rail complementary related recommended widget trending popular more links blogroll archive tags",
    "note": "cookie cookies consent gdpr notice alert popup modal overlay toast dialog disclaimer subscribe paywall newsletter signup",
    "ad": "ad ads adv advert advertisement advertisements adbox sponsor sponsored promo promotion promoted adsense dfp",
    "form": "form login search searchbox searchform contact feedback rating share sharing social print",
    "reply": "comment comments commentlist discussion disqus reply replies respond responses reviews thread",
    "main": "article content main post story entry body text maincontent articlebody hentry prose copy",
}
_HINT = {w: i for i, words in enumerate(HINTS.values()) for w in words.split()}
N_TAGS, N_HINTS = len(TAGS), len(HINTS)
N_FEATURES = N_TAGS + N_HINTS + 11
KINDS = N_TAGS + N_HINTS  # of a child, for the potential that it shares with its parent


class Page:
    """The tree of one page: of each element its parent, tag and hints; its text blocks in order."""

    __slots__ = ("parent", "tag", "hint", "hidden", "own", "links", "blocks", "runs")

    def __init__(self):
        self.parent, self.tag, self.hint, self.hidden = [-1], ["html"], [()], [False]
        self.runs: list[tuple[int, list[str]]] = []  # (element, pieces of one block)
        self.links: list[int] = [0]  # characters in links


def parse(source: str | None) -> Page:
    page = Page()
    if not source:
        return page
    stack: list[tuple[str, int]] = [("html", 0)]  # (tag, element that owns text here)
    quiet = 0  # open elements that give no text
    in_link = 0
    run: list[str] = []
    at, end = 0, len(source)
    open_at: dict[str, list[int]] = {"html": [0]}  # where on the stack each tag is open
    depth = [0]  # of each tree element
    odd_quotes = 0

    def flush() -> None:
        nonlocal run
        if run:
            page.runs.append((stack[-1][1], run))
            run = []

    def pop() -> None:
        nonlocal quiet, in_link
        tag, _ = stack[-1]
        if tag in BLOCK:
            flush()
        elif tag in SILENT:
            quiet -= 1
        elif tag == "a":
            in_link -= 1
        open_at[tag].pop()
        stack.pop()

    def push(tag: str, element: int) -> None:
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, element))

    def last(tags) -> int:
        """The place of the innermost open element of these tags; 0 if there is none, as the root's."""
        return max((at[-1] for x in tags if (at := open_at.get(x))), default=0)

    def close(tags, bounds) -> None:
        to = last(tags)
        if to and to >= last(bounds):
            while len(stack) > to:
                pop()

    def foreign() -> bool:
        return last(FOREIGN) > last(FOREIGN_ENDS)

    def element(tag: str, attrs: str) -> None:
        flush()
        above = stack[-1][1]
        if depth[above] >= DEEPEST:
            above = page.parent[above]
        hints, hidden = _read(attrs)
        page.parent.append(above)
        page.tag.append(_KIND.get(tag, "other"))
        page.hint.append(hints)
        page.hidden.append(hidden)
        page.links.append(0)
        depth.append(depth[above] + 1)
        push(tag, len(depth) - 1)

    def say(text: str) -> None:
        if quiet or not text:
            return
        if "&" in text:
            text = html_lib.unescape(text)
        run.append(text)
        if in_link:
            page.links[stack[-1][1]] += len(text)

    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            say(source[at:])
            break
        m = None
        nxt = source[lt + 1 : lt + 2]
        if nxt.isalpha() and nxt.isascii() or nxt == "/":
            m = _TAG.match(source, lt) if odd_quotes < _OPEN_QUOTES else None
            if m is None:
                odd_quotes += 1
                m = _LOOSE.match(source, lt)
            if m is None and nxt != "/" and source.find(">", lt) < 0:
                say(source[at:lt])  # the page ends within a tag
                break
        elif nxt in ("!", "?"):
            say(source[at:lt])
            if source.startswith("<!--", lt):
                stop = source.find("-->", lt + 2)
                at = stop + 3 if stop >= 0 else end
            else:
                stop = source.find(">", lt)
                at = stop + 1 if stop >= 0 else end
            continue
        if m is None:
            if nxt == "/":  # a bogus end tag is a comment
                say(source[at:lt])
                stop = source.find(">", lt)
                at = stop + 1 if stop >= 0 else end
            else:
                say(source[at : lt + 1])
                at = lt + 1
            continue
        if lt > at:
            say(source[at:lt])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in RAW or tag in VOID:
                if tag == "br" and not quiet:
                    run.append(" ")
            else:
                close((tag,), ())
            continue
        # An svg or math that ends in a slash after an unquoted value is taken for a whole element too.
        if m[3].endswith("/") and (tag in FOREIGN or quiet and foreign() and not _BARE.search(m[3])):
            continue
        if tag in RAW:
            stop = re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>])").search(source, at)
            if stop is None:
                break
            stop = source.find(">", stop.end())
            at = stop + 1 if stop >= 0 else end
            continue
        if tag in ("html", "body", "head"):
            if tag == "head":
                push("head", 0)
                quiet += 1
            else:
                close({"head"}, ())
                if tag == "body" and len(stack) == 1:
                    element("body", m[3])
            continue
        if tag in VOID:
            if tag == "hr":
                close({"p"}, P_BOUNDS)
                flush()
            elif tag == "br" and not quiet:
                run.append(" ")
            continue
        if tag in P_ENDS:
            close({"head"}, ())
            close({"p"}, P_BOUNDS)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCK:
            element(tag, m[3])
        else:
            push(tag, stack[-1][1])
            quiet += tag in SILENT
            in_link += tag == "a"
    flush()
    return page


def _read(attrs: str) -> tuple[tuple, bool]:
    """The hints of class, id and role, and whether the element is hidden."""
    found, hidden = set(), False
    if attrs and len(attrs) > 3:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                found.update(_HINT[w] for w in _WORD.findall(value) if w in _HINT)
            else:
                hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
    return tuple(found), hidden


class Forest:
    """The trees of many pages as arrays: parents, depths, features and kinds."""

    def __init__(self, pages: list[Page]):
        size = np.array([len(p.parent) for p in pages])
        start = np.r_[0, np.cumsum(size)].astype(np.int64)
        self.start = start
        n = int(start[-1])
        self.parent = np.full(n, -1, np.int64)
        x = np.zeros((n, N_FEATURES), np.float32)
        own, sub_links, stops, run_count, hidden = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, bool)
        self.texts: list[list[tuple[int, str]]] = []
        tag_at = {t: i for i, t in enumerate(TAGS)}
        for s, p in zip(start, pages):
            k = len(p.parent)
            par = np.array(p.parent)
            self.parent[s : s + k] = np.where(par < 0, -1, par + s)
            x[np.arange(s, s + k), [tag_at.get(t, tag_at["other"]) if t != "html" else tag_at["body"] for t in p.tag]] = 1
            for i, hints in enumerate(p.hint):
                for h in hints:
                    x[s + i, N_TAGS + h] = 1
            hidden[s : s + k] = p.hidden
            sub_links[s : s + k] = p.links
            texts = []
            for i, run in p.runs:
                text = " ".join("".join(run).split())
                if text:
                    texts.append((int(s) + i, text))
                    own[s + i] += len(text)
                    run_count[s + i] += 1
                    stops[s + i] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            self.texts.append(texts)
        self.depth = np.zeros(n, np.int64)
        self.levels = []
        level = np.flatnonzero(self.parent < 0)
        order = np.argsort(self.parent, kind="stable")
        sorted_parent = self.parent[order]
        while len(level):
            self.levels.append(level)
            lo, hi = np.searchsorted(sorted_parent, level), np.searchsorted(sorted_parent, level, side="right")
            level = order[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi) if b > a])] if (hi > lo).any() else level[:0]
        total, links, points = own.copy(), sub_links, stops.copy()
        for level in self.levels[:0:-1]:
            for v in (total, links, points):
                np.add.at(v, self.parent[level], v[level])
        top = total[np.repeat(start[:-1], size)] + 1
        base = N_TAGS + N_HINTS
        x[:, base] = 1
        x[:, base + 1] = np.log1p(own) / 5
        x[:, base + 2] = np.log1p(total) / 8
        x[:, base + 3] = np.minimum(links / (total + 1), 1)
        x[:, base + 4] = np.minimum(10 * points / (total + 1), 1)
        x[:, base + 5] = total / top
        x[:, base + 6] = hidden
        x[:, base + 7] = own > 80
        x[:, base + 8] = total == 0
        x[:, base + 9] = (np.arange(n) - np.repeat(start[:-1], size)) / np.repeat(size, size)
        x[:, base + 10] = self.parent < 0
        self.x = x
        self.kind = x[:, :KINDS]


def messages(f: Forest, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of content, joint marginals (parent, child) of each edge, and the sum of log Z.

    unary[i, y] and edge[i, y_parent, y_child] are log-potentials; edge of a root is not used.
    """
    up = unary.copy()  # an element's potential with all messages from below
    sent = np.zeros_like(unary)
    for level in f.levels[:0:-1]:
        m = np.logaddexp(edge[level, :, 0] + up[level, None, 0], edge[level, :, 1] + up[level, None, 1])
        sent[level] = m
        np.add.at(up, f.parent[level], m)
    belief = up.copy()
    log_z = np.logaddexp(up[f.levels[0], 0], up[f.levels[0], 1]).sum() if f.levels else 0.0
    joint = np.zeros((len(unary), 2, 2))
    for level in f.levels[1:]:
        from_parent = belief[f.parent[level]] - sent[level]  # all that the parent knows but from this child
        j = from_parent[:, :, None] + edge[level] + up[level][:, None, :]
        belief[level] = np.logaddexp(j[:, 0], j[:, 1])
        j -= j.max(axis=(1, 2), keepdims=True)
        j = np.exp(j)
        joint[level] = j / j.sum(axis=(1, 2), keepdims=True)
    d = belief[:, 1] - belief[:, 0]
    return 1 / (1 + np.exp(-np.clip(d, -500, 500))), joint, float(log_z)


class Model:
    def __init__(self, w: np.ndarray | None = None, e: np.ndarray | None = None):
        self.w = np.zeros(N_FEATURES) if w is None else w
        self.e = np.zeros((KINDS + 1, 2, 2)) if e is None else e  # by the child's kinds; the last holds for all

    def potentials(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        score = f.x @ self.w
        return np.stack([np.zeros_like(score), score], axis=1), (f.kind @ self.e[:-1].reshape(KINDS, 4).astype(np.float32)).reshape(-1, 2, 2).astype(np.float64) + self.e[-1]

    def marginals(self, f: Forest) -> np.ndarray:
        return messages(f, *self.potentials(f))[0]

    def fit(self, f: Forest, y: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-4) -> "Model":
        """Adam on the conditional log-likelihood, whose gradient the marginals give exactly."""
        n, has = len(y), f.parent >= 0
        seen = np.zeros((n, 2, 2))
        seen[np.flatnonzero(has), y[f.parent[has]], y[has]] = 1
        flat = np.concatenate([self.w, self.e.ravel()])
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        for t in range(1, rounds + 1):
            p, joint, _ = messages(f, *self.potentials(f))
            d = (seen - joint) * has[:, None, None]
            g = np.concatenate([f.x.T @ (y - p), (f.kind.T @ d.reshape(n, 4)).ravel(), d.sum(0).ravel()]) / n - decay * flat
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            flat = flat + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w, self.e = flat[:N_FEATURES], flat[N_FEATURES:].reshape(self.e.shape)
        return self


def generate_pages(n: int, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Labelled pages (html, content blocks): every content block bears a mark that no other text has."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    chance = lambda p: rng.random() < p
    syllables = "an er in on ti es re at en or th st nd al la de le me ra to".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    sentence = lambda: words(3, 14).capitalize() + pick(".", ".", "!", "?", ",")
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(rng.integers(a, b)))
    cls = lambda *x: f' {pick("class", "id", "class")}="{pick(*x)}"'
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(rng.integers(a, b)))
    out = []
    for _ in range(n):
        marks: list[str] = []

        def good(text: str) -> str:
            marks.append(f"\x02{len(marks)}\x03")
            return marks[-1] + text

        plain = chance(0.2)  # layouts that give no hints
        hint = lambda *x: "" if plain and chance(0.6) else cls(*x)
        ad = lambda: f"<div{cls('ad', 'ads', 'advert', 'ad banner', 'sponsored', 'promo', 'ad-box')}>{pick(prose(1, 3), words(2, 8), '<a href=x>' + words(2, 5) + '</a>')}</div>"
        note = lambda: f"<{(t := pick('div', 'section', 'aside', 'dialog'))}{cls('cookie-notice', 'notice', 'cookie consent', 'alert', 'gdpr', 'popup modal', 'newsletter')}><p>{prose(1, 4)}</p>{pick('', '<button>OK</button>')}</{t}>"
        form = lambda: f"<form{pick('', ' action=/s')}>{pick('', '<p>' + prose(1, 2) + '</p>')}<label>{words(1, 3)}</label><input name=q><button>{word()}</button></form>"
        menu = lambda: pick(f"<nav><ul>{links(2, 9)}</ul></nav>", f"<div{cls('menu', 'nav', 'navbar', 'breadcrumbs')}><ul>{links(2, 9)}</ul></div>", f"<ul{hint('menu', 'nav')}>{links(3, 9)}</ul>")
        header = lambda: pick(f"<header><h1>{words(1, 4)}</h1>{pick('', menu())}<p>{words(2, 8)}</p></header>", f"<header>{pick('', prose(1, 2))}{menu()}</header>", f"<div{cls('header', 'masthead', 'site-header', 'branding')}><a href=/>{words(1, 3)}</a><p>{prose(1, 2)}</p></div>", f"<header>{prose(1, 2)}</header>")
        footer = lambda: pick(f"<footer>&copy; {words(1, 3)} &middot; {prose(1, 2)}</footer>", f"<footer><p>{prose(1, 3)}</p><ul>{links(2, 6)}</ul></footer>", f"<div{cls('footer', 'site-footer', 'copyright', 'bottom')}><p>{prose(1, 3)}</p></div>")
        side = lambda: f"<{(t := pick('aside', 'div', 'aside'))}{cls('sidebar', 'related', 'side widget', 'recommended') if t == 'div' else hint('sidebar', 'related')}><h3>{words(1, 4)}</h3>{pick(f'<ul>{links(2, 7)}</ul>', f'<p>{prose(1, 4)}</p>', f'<p>{prose(1, 2)}</p><ul>{links(2, 5)}</ul>')}</{t}>"
        one = lambda: pick(f"<div{cls('comment', 'reply', 'comment-body')}><p>{prose(1, 5)}</p></div>", f"<li{hint('comment')}><b>{word()}</b><p>{prose(1, 4)}</p></li>", f"<article{cls('comment', 'reply')}><p>{prose(1, 4)}</p></article>", f"<p>{prose(1, 4)}</p>")
        replies = lambda: f"<{(t := pick('section', 'div', 'ol'))}{cls('comments', 'comment-list', 'discussion', 'responses', 'reviews')}>{pick('', '<h2>' + words(1, 3) + '</h2>')}{''.join(one() for _ in range(rng.integers(1, 6)))}{pick('', form())}</{t}>"

        def body(k: int) -> str:
            parts = []
            for _ in range(k):
                text = pick(prose(1, 8), prose(2, 12), word().capitalize() + ".", words(1, 4))
                if chance(0.2):
                    text += f' <a href="/{word()}">{words(1, 4)}</a> {prose(0, 2)}'
                kind = rng.integers(14)
                if kind < 8:
                    parts.append(f"<p>{good(text)}</p>")
                elif kind == 8:
                    parts.append(f"<p><b>{good(text)}<br>")
                elif kind == 9:
                    parts.append(f"<h{(h := rng.integers(2, 5))}>{good(words(2, 7))}</h{h}>")
                elif kind == 10:
                    parts.append("<ul>" + "".join(f"<li>{good(words(2, 12))}</li>" for _ in range(rng.integers(2, 5))) + "</ul>")
                elif kind == 11:
                    parts.append(f"<blockquote><p>{good(prose())}</p></blockquote>")
                elif kind == 12:
                    parts.append(f"<div>{good(prose())}</div>")
                else:
                    parts.append(pick(ad, side, ad, note, form)() if chance(0.4) else f"<table><tr><td>{good(words(1, 5))}</td><td>{good(words(1, 5))}</td></tr></table>")
            return "".join(parts)

        k = pick(0, 1, 2, 3, 5, 8, 12, 20)
        inner = pick(f"<h1>{good(words(2, 9))}</h1>", f"<h1>{good(words(2, 9))}</h1>", "") + body(max(k, 1))
        style = rng.integers(8)
        inside = replies() if chance(0.15) else ""
        if style < 4:
            main = f"<article{pick('', hint('post', 'story', 'hentry'))}>{inner}{inside}</article>"
        elif style == 4:
            main = f"<main><article>{inner}</article>{inside}</main>"
        elif style == 5:
            main = f"<div{cls('content', 'post', 'entry-content', 'article-body', 'story', 'main-content')}>{inner}{inside}</div>"
        elif style == 6:
            main = f"<main>{inner}{inside}</main>"
        else:
            main = f"<div id=wrap><section{hint('content', 'article')}>{inner}</section></div>"
        before = [f() for f, p in ((header, 0.5), (menu, 0.8), (note, 0.3), (ad, 0.5), (side, 0.15), (form, 0.15)) if chance(p)]
        after = [f() for f, p in ((ad, 0.2), (side, 0.35), (replies, 0.3), (form, 0.25), (note, 0.2), (footer, 0.85)) if chance(p)]
        page = "".join(before) + pick("", "<!-- ad 1 -->") + main + "".join(after)
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{page}" + pick("</body></html>", "")
        out.append((page, marks))
    return out


def labels(pages: list[tuple[str, list[str]]]) -> tuple[Forest, np.ndarray]:
    """The trees of labelled pages and each element's label; the marks are removed.

    Elements with marked text are content, and so are those that hold them, up to the body.
    """
    trees = [parse(h) for h, _ in pages]
    marked = []
    for t in trees:
        own = {i for i, run in t.runs if any("\x02" in x for x in run)}
        t.runs = [(i, [re.sub("\x02\\d+\x03", "", x) for x in run]) for i, run in t.runs]
        below = np.zeros(len(t.parent), np.int64)
        for i in own:
            below[i] += 1
        for i in range(len(t.parent) - 1, 0, -1):
            below[t.parent[i]] += below[i]
        y = np.array([n > 0 and tag not in ("html", "body") for n, tag in zip(below, t.tag)], np.int64)
        marked.append(y)
    return Forest(trees), np.concatenate(marked)


@functools.lru_cache(maxsize=1)
def trained(n: int = 300, seed: int = 5) -> Model:
    f, y = labels(generate_pages(n, seed))
    return Model().fit(f, y)


def texts(model: Model, pages: list[str | None], threshold: float = 0.5) -> list[str]:
    f = Forest([parse(x if isinstance(x, str) else None) for x in pages])
    content = model.marginals(f) > threshold
    return ["\n".join(text for i, text in blocks if content[i]) for blocks in f.texts]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """pages -> id, url, text, n_chars."""
    model = model or trained()
    w, e = model.w, model.e
    sent, back = as_text(pages.select(id_col, url_col, html_col), id_col)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(w, e)
        for b in batches:
            found: list[str] = []
            for i in range(0, len(b), 256):
                found += texts(m, b[html_col].iloc[i : i + 256].tolist())
            yield pd.DataFrame({id_col: b[id_col].array, url_col: b[url_col].array, "text": found, "n_chars": [len(x) for x in found]})

    return back(sent.mapInPandas(work, f"`{id_col}` string, `{url_col}` string, text string, n_chars bigint"))
