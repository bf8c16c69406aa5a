"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut into *leaf blocks*: runs of text between block-level tags.  Each block
carries features of its ancestors (element names, words in ``class``, ``id`` and
``role``) and of its text (length, share of link text, closing mark, signs such as a
copyright mark).  A two-state chain (main text or not) with weights for features and for
transitions labels all blocks of a page together; Viterbi finds the best labelling.

The weights are learned here, by full-batch gradient steps on the conditional
likelihood (forward-backward), from labelled pages.  ``labelled_pages`` makes them: a
bounded, seeded set of pages in many layouts whose blocks are marked as they are
written.  Other labelled pages can be passed to ``train``.

Scripts, styles, templates, form controls and markup never become blocks.  Character
references are decoded, white space in a block becomes one space, blocks are joined in
page order by line feeds.  Nothing else is dropped or cut.

Null and empty pages, and pages without main text, give an empty text.  Unclosed and
stray tags are tolerated as browsers do: a block tag ends an open paragraph, an end tag
closes what it can find and is ignored otherwise, and an unclosed button, select, svg,
object or template takes nothing of the page with it.  Formulas (math) are text.  Extra columns pass through; ``text``
and ``n_chars`` replace columns of those names.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm.workspace import tidy
from barloom.session import ship_package

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/][^>]*+>|<[!?][^>]*+(?:>|\Z)", re.S
)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "textarea", "select", "button", "iframe", "object", "head", "title")}
#: Content that is markup to a browser: without an end tag, what follows is part of the page.
_PARSED = frozenset(("svg", "select", "button", "object", "template"))
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("hr br img input meta link wbr area base col embed source track".split())
_NOT_IN_P = _BLOCK - {"body", "html"}
_CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

#: Words in class, id and role that hint at a part of the page.
_HINTS = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs topnav subnav pagination pager toc skip",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner",
    "comment": "comment comments reply replies respond disqus discussion responses commentlist feedback",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe subscription signup paywall warning toast dialog complementary",
    "foot": "footer foot copyright colophon contentinfo legal",
    "head": "header head masthead topbar site-header branding logo",
    "side": "sidebar side aside widget related recommended recommendations trending popular more",
    "share": "share sharing social follow tags taglist",
    "form": "form search login register",
    "main": "content article post entry story main maincontent articlebody postbody text body single page-content hentry",
}
_HINT_OF = {w: k for k, words in _HINTS.items() for w in words.split()}
_ELEMENTS = "article main section aside nav header footer form div ul ol table blockquote figure details dialog fieldset address menu".split()
_OWN = "p h1 h2 h3 h4 h5 h6 li td th div dt dd pre blockquote label figcaption body article section other".split()
_SIZES = (2, 5, 10, 20, 40)
_FEATURES: dict[str, int] = {
    n: i
    for i, n in enumerate(
        [f"in:{e}" for e in _ELEMENTS] + [f"hint:{h}" for h in _HINTS] + [f"own:{e}" for e in _OWN] + [f"size:{k}" for k in range(len(_SIZES) + 1)]
        + [f"link:{k}" for k in range(4)] + ["stop", "copyright", "one", "header-in-article", "hint-in-article", "first", "bias"]
    )
}
N = len(_FEATURES)


def _hints(attributes: str) -> frozenset[str]:
    out = set()
    for m in _NAMES.finditer(attributes):
        value = (m[1] or m[2] or m[3] or "").lower()
        for w in value.split():
            if w in _HINT_OF:
                out.add(_HINT_OF[w])
            else:
                out |= {_HINT_OF[p] for p in re.split(r"[-_]+", w) if p in _HINT_OF}
    return frozenset(out)


def blocks(page: str) -> list[tuple[str, tuple[int, ...]]]:
    """The leaf blocks of a page: text and the numbers of the features that hold."""
    stack: list[tuple[str, frozenset[str]]] = []
    found: list[tuple[str, tuple[int, ...]]] = []
    parts: list[str] = []
    linked = [0, False]

    def flush() -> None:
        if not parts:
            return
        raw = "".join(parts)
        parts.clear()
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        share, linked[0] = linked[0] / max(1, len(raw)), 0
        if text:
            found.append((text, _describe(text, min(share, 1.0), stack, not found)))

    def close(names: Sequence[str], upto: Sequence[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in upto:
                return
            if stack[i][0] in names:
                del stack[i:]
                return

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else size]
        if piece:
            parts.append(piece)
            if linked[1]:
                linked[0] += len(piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, ending = m[2].lower(), bool(m[1])
        if tag == "a":
            linked[1] = not ending
        elif tag == "br":
            parts.append(" ")
        elif tag in _RAW and not ending:
            if tag == "head":
                continue
            if not m[3].endswith("/"):
                end = _RAW[tag].search(page, at)
                at = end.end() if end else at if tag in _PARSED else size
        elif tag in _BLOCK:
            flush()
            if ending:
                close((tag,), ())
            elif tag not in _VOID:
                if tag in _NOT_IN_P:
                    close(("p",), ("td", "th", "li", "div", "section", "article", "blockquote", "body"))
                if tag in _CLOSES:
                    names, upto = _CLOSES[tag]
                    close(names.split(), upto)
                stack.append((tag, _hints(m[3]) if m[3] else frozenset()))
                linked[1] = False
    flush()
    return found


def _describe(text: str, link_share: float, stack: Sequence[tuple[str, frozenset[str]]], first: bool) -> tuple[int, ...]:
    f = _FEATURES
    out = {f["bias"]}
    main = False
    for tag, hints in stack:
        if (i := f.get(f"in:{tag}")) is not None:
            out.add(i)
        if tag == "header" and main:
            out.add(f["header-in-article"])
        for h in hints:
            out.add(f[f"hint:{h}"])
            if main and h != "main":
                out.add(f["hint-in-article"])
        main = main or tag in ("article", "main") or "main" in hints
    own = stack[-1][0] if stack else "other"
    out.add(f.get(f"own:{own}", f["own:other"]))
    words = text.count(" ") + 1
    out.add(f[f"size:{sum(words > s for s in _SIZES)}"])
    out.add(f[f"link:{0 if link_share == 0 else 1 if link_share < 0.3 else 2 if link_share < 0.8 else 3}"])
    if text[-1] in ".!?\"”»…:":
        out.add(f["stop"])
    if "©" in text:
        out.add(f["copyright"])
    if words == 1:
        out.add(f["one"])
    if first:
        out.add(f["first"])
    return tuple(sorted(out))


class Chain:
    """Weights of the two-state chain: ``emit[feature, state]`` and ``move[from, to]``."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        self.rows = [tuple(r) for r in emit.tolist()]
        self.steps = [tuple(r) for r in move.tolist()]

    def viterbi(self, features: Sequence[tuple[int, ...]]) -> list[int]:
        (s00, s01), (s10, s11) = self.steps
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for k, fs in enumerate(features):
            e0 = e1 = 0.0
            for i in fs:
                r = self.rows[i]
                e0 += r[0]
                e1 += r[1]
            if k:
                x, y = (a + s00, b + s10), (a + s01, b + s11)
                back.append((int(x[1] > x[0]), int(y[1] > y[0])))
                a, b = max(x), max(y)
            a, b = a + e0, b + e1
        if not features:
            return []
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def train(pages: Sequence[tuple[Sequence[tuple[int, ...]], Sequence[int]]], epochs: int = 150, rate: float = 0.1, decay: float = 2e-4) -> Chain:
    """Maximise the conditional likelihood of labelled pages (feature lists, labels)."""
    pages = [p for p in pages if p[0]]
    n, longest = len(pages), max(len(p[0]) for p in pages)
    x = np.zeros((longest, n, N))
    y = np.zeros((longest, n), int)
    live = np.zeros((longest, n), bool)
    for j, (fs, labels) in enumerate(pages):
        for t, (f, label) in enumerate(zip(fs, labels, strict=True)):
            x[t, j, list(f)], y[t, j], live[t, j] = 1, label, True
    emit, move = np.zeros((N, 2)), np.zeros((2, 2))
    state = [np.zeros_like(a) for a in (emit, emit, move, move)]
    count = live.sum()
    for epoch in range(1, epochs + 1):
        e = x @ emit
        alpha, beta = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        alpha[0] = e[0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(alpha[t - 1][:, :, None] + move[None], axis=1) + e[t]
            alpha[t] = np.where(live[t][:, None], step, alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(move[None] + (e[t + 1] + beta[t + 1])[:, None, :], axis=2)
            beta[t] = np.where(live[t + 1][:, None], step, 0)
        z = np.logaddexp.reduce(alpha[-1], axis=1)
        p = np.exp(alpha + beta - z[None, :, None]) * live[:, :, None]
        gold = np.eye(2)[y] * live[:, :, None]
        g_emit = np.einsum("tnf,tns->fs", x, gold - p) / count - decay * emit
        pair = np.exp(alpha[:-1, :, :, None] + move[None, None] + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]) * live[1:, :, None, None]
        g_move = (np.einsum("tna,tnb->ab", gold[:-1] * live[1:, :, None], gold[1:]) - pair.sum((0, 1))) / count - decay * move
        for w, g, m, v in ((emit, g_emit, state[0], state[1]), (move, g_move, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-9)
    return Chain(emit, move)


def labelled_pages(count: int = 240, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages in many layouts, with the label of each leaf block in page order."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice("aeiounrstlmdhcéü") for _ in range(r.randint(1, 9)))

    def words(low: int, high: int, stop: float = 0.8) -> str:
        text = " ".join(word() for _ in range(r.randint(low, high))).capitalize()
        return text + (r.choice(".?!") if r.random() < stop else "")

    def one() -> tuple[str, list[int]]:
        out: list[str] = []
        labels: list[int] = []

        def put(markup: str, *own: int) -> None:
            out.append(markup)
            labels.extend(own)

        def wrapped(tag: str, names: Sequence[str], inside: Sequence[str], close: bool = True) -> None:
            name = r.choice(names)
            put(f"<{tag}{f' {r.choice(("class", "id"))}="{name}"' if name else ''}>" + "".join(inside) + (f"</{tag}>" if close else ""), *[0] * len(inside))

        def menu() -> None:
            items = [f'<li><a href="/{k}">{words(1, 2, 0)}</a></li>' for k in range(r.randint(2, 9))]
            r.choice([
                lambda: put("<nav><ul>" + "".join(items) + "</ul></nav>", *[0] * len(items)),
                lambda: put(f'<div class="{r.choice(("menu", "navbar", "main-nav", "breadcrumbs"))}"><ul>' + "".join(items) + "</ul></div>", *[0] * len(items)),
            ])()

        def advert() -> None:
            wrapped(r.choice(("div", "aside", "section")), ("ad", "ads", "advert", "sponsored", "promo-box", "ad-banner"), [f"<p>{words(2, 20)}</p>" if r.random() < 0.4 else words(2, 20)])

        def notice() -> None:
            wrapped(r.choice(("div", "section", "aside")), ("cookie-notice", "notice", "consent", "newsletter", "alert", "popup"), [f"<p>{words(4, 25)}</p>" for _ in range(r.randint(1, 2))])

        def form() -> None:
            put(f'<form action="/s"><label>{words(1, 3, 0)}</label><input name="q"><p>{words(2, 9)}</p><button>{word()}</button></form>', 0, 0)

        def side() -> None:
            wrapped(r.choice(("aside", "div")), ("sidebar", "related", "widget", "popular"), [f"<h3>{words(1, 3, 0)}</h3>"] + [f'<li><a href="/{k}">{words(3, 9, 0.2)}</a></li>' if r.random() < 0.6 else f"<p>{words(5, 30)}</p>" for k in range(r.randint(1, 5))])

        def comments() -> None:
            wrapped(r.choice(("section", "div", "ol")), ("comments", "comment-list", "replies", "discussion"), [f"<p>{words(3, 50)}</p>" for _ in range(r.randint(1, 6))])

        def share() -> None:
            wrapped("div", ("share", "social-links", "tags"), [f'<a href="/f">{words(1, 3, 0)}</a>'])

        def header() -> None:
            inside = [f"<p>{words(1, 8, 0.3)}</p>"] + [f"<h2>{words(1, 4, 0)}</h2>"] * r.randint(0, 1)
            put(f"<header{r.choice(('', ' class="site-header"', ' id="masthead"'))}>" + "".join(inside) + "</header>", *[0] * len(inside))

        def footer() -> None:
            text = ("&copy; " if r.random() < 0.7 else "") + words(2, 25)
            tag = r.choice(("footer", "footer", 'div class="footer"'))
            put(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if r.random() < 0.9 else ""), 0)

        def story() -> None:
            kind = r.random()
            tag, name = r.choice((("article", ""), ("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "entry-content"), ("section", "article-body"), ("div", "story"), ("div", "")))
            put(f"<{tag}{f' class="{name}"' if name else ''}>")
            if kind < 0.8:
                head = f"<h1>{words(1, 12, 0.3)}</h1>"
                put(f"<header>{head}</header>" if r.random() < 0.15 else head, 1)
            for k in range(r.choice((1, 2, 3, 5, 8, 13))):
                what = r.random()
                size = r.choice(((1, 4), (4, 12), (10, 50), (40, 160)))
                if what < 0.7:
                    put(f"<p>{words(*size)}" + ("</p>" if r.random() < 0.9 else ""), 1)
                elif what < 0.76:
                    put(f"<h{r.randint(2, 4)}>{words(1, 6, 0.2)}</h2>", 1)
                elif what < 0.83:
                    own = [f"<li>{words(2, 15, 0.5)}</li>" for _ in range(r.randint(1, 4))]
                    put("<ul>" + "".join(own) + "</ul>", *[1] * len(own))
                elif what < 0.88:
                    put(f"<blockquote><p>{words(*size)}</p></blockquote>", 1)
                elif what < 0.91:
                    put(f"<pre>{words(2, 20)}</pre>", 1)
                elif what < 0.94:
                    own = [f"<td>{words(1, 4, 0.2)}</td>" for _ in range(r.randint(1, 4))]
                    put("<table><tr>" + "".join(own) + "</tr></table>", *[1] * len(own))
                elif k:
                    r.choice((advert, share, notice, side))()
                if what < 0.7 and r.random() < 0.1:
                    put(f'<p><a href="/x">{words(2, 6)}</a> {words(5, 30)}</p>', 1)
            if r.random() < 0.15:
                r.choice((comments, share, form, advert))()
            put(f"</{tag}>" if r.random() < 0.95 else "")

        put("<!DOCTYPE html><html><head><title>x</title><script>var a='<p>';</script><style>p{}</style></head><body>")
        for part in r.sample((menu, header, advert, notice, form), r.randint(0, 4)):
            part()
        story()
        for part in r.sample((comments, side, advert, share, notice, form, menu), r.randint(0, 4)):
            part()
        if r.random() < 0.9:
            footer()
        put("</body></html>")
        return "".join(out), labels

    return [one() for _ in range(count)]


@lru_cache(1)
def default_chain() -> Chain:
    """The chain learned from :func:`labelled_pages`; the same at every call."""
    examples = []
    for page, labels in labelled_pages():
        found = blocks(page)
        if len(found) == len(labels):
            examples.append(([f for _, f in found], labels))
    return train(examples)


def extract(page: str, chain: Chain) -> str:
    found = blocks(page)
    return "\n".join(t for (t, _), keep in zip(found, chain.viterbi([f for _, f in found]), strict=True) if keep)


def extract_text(pages: DataFrame, chain: Chain | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text`` and ``n_chars``."""
    chain = chain or default_chain()
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    weights = (chain.emit, chain.move)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(*weights)
        for b in batches:
            texts = [extract(h.as_py() or "", own) for h in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    ship_package(pages.sparkSession)
    return pages.select(*keep, html_col).mapInArrow(tidy("html_extract", run), schema)
