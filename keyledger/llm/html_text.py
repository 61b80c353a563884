"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A page is parsed into blocks (runs of text between block-level tags), each with its ancestors' tags and names. The field has two
labels, article and rest; a block's features are of its ancestors and its text, neighbouring labels have weights of their own. It is trained on
labelled pages made here from templates, and decoded by Viterbi.
"""

from __future__ import annotations

import bisect
import html as html_lib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyledger.llm.common import arrow_map, texts_of

#: HTML's own names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe".split())
SKIP = frozenset("svg object select".split())  # their text is none of the page's, but they nest and may be empty
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?i:({"|".join(sorted(RAW))}))(?=[\s/>])[^>]*>(?:.*?</(?i:\1)(?=[\s/>])[^>]*(?:>|\Z)|.*\Z)""" + r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+|<)""", re.S)
#: A tag that closes itself: its slash is no part of a value without quotes.
_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*\Z""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DEEPEST = 512  # ancestors that a block's path names; what lies deeper is read all the same
NO_NEST = frozenset("p li dt dd td th tr option".split())


@dataclass(slots=True)
class Block:
    """A leaf's text (white space single, trimmed), its ancestors as `(tag, names)` from the root, and how much of it is links."""

    text: str
    path: tuple
    linked: int


def parse(page: str | None) -> list[Block]:
    """Blocks of a page in order; of null or empty none. Malformed markup is read as far as it goes; a tag that the page's end cuts off is none."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple, int]] = []  # tag, path down to it, links that it opened
    path: tuple = ()
    buffer: list[str] = []
    linked = anchor = hidden = 0

    open_: dict[str, int] = {}
    within: list[str] = []

    def close(tag: str) -> bool:
        """Ends the innermost element; whether it is a `tag`."""
        nonlocal path, anchor, hidden
        ended, _, link = stack.pop()
        open_[ended] -= 1
        if ended not in INLINE:
            within.pop()
        anchor -= link
        hidden -= ended in SKIP
        path = stack[-1][1] if stack else ()
        return ended == tag

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            out.append(Block(text, path, linked))
        buffer.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        _, end1, tag1, attrs1, end2, tag2, attrs2, text = m.groups()
        if text is not None:
            if hidden:
                continue
            text = html_lib.unescape(text) if "&" in text else text
            buffer.append(text)
            if anchor:
                linked += len(text.strip())
            continue
        tag = tag1 or tag2
        if tag is None:  # a comment, a declaration, or an element without text of its own
            if m[1] and buffer:
                flush()
            continue
        tag, attrs = tag.lower(), attrs1 or attrs2
        inline = tag in INLINE
        if not inline:
            if buffer:
                flush()
        elif tag == "br":
            buffer.append(" ")
        if end1 or end2:
            if open_.get(tag):  # else nothing ends
                while not close(tag):
                    pass
            continue
        if tag in VOID or attrs and attrs.rstrip()[-1:] == "/" and _CLOSED.search(attrs):
            continue
        if not inline:
            over = within[-1] if within else ""  # the innermost open block
            if over == "p" or over == tag and tag in NO_NEST:  # ends where this one begins
                while not close(over):
                    pass
            names = tuple(p.lower() for a in _NAMES.findall(attrs) for p in _PARTS.findall(a[0] or a[1] or a[2])) if attrs else ()
            if len(path) < DEEPEST:
                path += ((tag, names),)
            within.append(tag)
        stack.append((tag, path, tag == "a"))
        open_[tag] = open_.get(tag, 0) + 1
        anchor += tag == "a"
        hidden += tag in SKIP
    flush()
    return out


_STEMS = {"advertisement": "ad", "advert": "ad", "ads": "ad", "sponsor": "ad", "sponsored": "ad", "promo": "ad", "promoted": "ad", "promotion": "ad", "comments": "comment", "replies": "comment", "reply": "comment", "discussion": "comment", "disqus": "comment", "navigation": "nav", "navbar": "nav", "menu": "nav", "breadcrumb": "nav", "breadcrumbs": "nav", "cookies": "cookie", "consent": "cookie", "gdpr": "cookie", "notification": "notice", "alert": "notice", "banner": "notice", "popup": "notice", "modal": "notice", "sidebar": "side", "aside": "side", "related": "side", "recommended": "side", "widget": "side", "contentinfo": "footer", "foot": "footer", "copyright": "footer", "masthead": "header", "form": "form", "newsletter": "form", "subscribe": "form", "signup": "form", "login": "form", "search": "form", "social": "share", "sharing": "share", "complementary": "side"}


def _path_features(path: tuple) -> list[str]:
    found = {f"in:{tag}" for tag, _ in path}
    found |= {f"name:{_STEMS.get(x, x)}" for _, names in path for x in names}
    tail = [tag for tag, _ in path][-2:]
    found.add("leaf:" + (tail[-1] if tail else "-"))
    found.add("pair:" + ">".join(tail))
    return sorted(found)


def _bin(x: float, edges: tuple) -> int:
    return bisect.bisect_right(edges, x)


def _text_bins(b: Block, at: int, n: int) -> tuple:
    t = b.text
    marks = t.count(".") + t.count(",") + t.count(";")
    return _bin(t.count(" ") + 1, (2, 4, 8, 15, 30, 60)), _bin(b.linked / len(t), (0.01, 0.3, 0.7)), t[-1] in ".!?…。:;", _bin(marks, (1, 3, 8)), _bin(at / n, (0.1, 0.25, 0.5, 0.75, 0.9)), "©" in t[:40] or "All rights" in t


_BINS = ("words", "links", "ends", "marks", "place", "copyright")


def _text_features(bins: tuple) -> list[str]:
    return [f"{name}:{x}" for name, x in zip(_BINS, bins, strict=True)]


def features(blocks: list[Block]) -> list[list[str]]:
    return [_path_features(b.path) + _text_features(_text_bins(b, i, len(blocks))) for i, b in enumerate(blocks)]


# --- labelled pages ---

_SYLLABLES = "an en on er in ti es or th at ed he ou re nt ha st is la de le un que aux ment der die ein ich ver keit los por ción ar mi ta ro so ka to mo".split()


def labelled_page(rnd: random.Random) -> list[tuple[str, int]]:
    """Pieces of a page's HTML with labels: 1 of the article, 0 of the rest. Their join is a page."""
    word = lambda: "".join(rnd.choice(_SYLLABLES) for _ in range(rnd.randint(1, 3)))

    def text(lo: int, hi: int, end: str = ".") -> str:
        words = [word() for _ in range(rnd.randint(lo, hi))]
        marks = [w + ("," if rnd.random() < 0.08 else ". " + word().capitalize() if rnd.random() < 0.08 else "") for w in words]
        return " ".join(marks).capitalize() + end

    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(rnd.randint(1, 3)))}</a>'
    named = lambda names: rnd.choice((f'<div class="{n}">' if rnd.random() < 0.6 else f'<div id="{n}">' for n in [rnd.choice(names)]).__next__().split("\0"))
    out: list[tuple[str, int]] = []
    add = lambda s, y=0: out.append((s, y))
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 9))) + "</ul>"

    def rest(kind: str) -> None:
        body = {
            "nav": lambda: rnd.choice(("<nav>", named(("menu", "nav", "navbar", "breadcrumb", "main-menu")))) + links(),
            "header": lambda: rnd.choice(("<header>", named(("header", "site-header", "masthead", "top-bar")))) + f"<p>{text(1, 6, '')}</p><span>{link()}</span>",
            "footer": lambda: rnd.choice(("<footer>", named(("footer", "site-footer", "copyright")))) + rnd.choice((f"&copy; {word()} &middot; {text(3, 20)}", f"<p>{text(3, 25)}</p>" + links())),
            "aside": lambda: rnd.choice(("<aside>", named(("sidebar", "related", "widget", "side-column", "recommended")))) + f"<h3>{text(1, 4, '')}</h3>" + rnd.choice((links(), f"<p>{text(8, 60)}</p>", f"<p>{text(5, 20)}</p><p>{text(5, 30)}</p>")),
            "ad": lambda: named(("ad", "ads", "advert", "promo", "sponsored", "ad-box", "banner-ad")) + rnd.choice((text(4, 40), f"<p>{text(5, 30)}</p>")),
            "notice": lambda: named(("cookie-notice", "cookie", "consent-banner", "notice", "alert", "gdpr", "popup")) + f"<p>{text(6, 40)}</p>" + rnd.choice(("", "<button>OK</button>")),
            "form": lambda: rnd.choice(("<form>", '<form class="newsletter">', '<form id="search">')) + f"<p>{text(2, 20)}</p><label>{word()}</label><input><button>{word()}</button>",
            "comment": lambda: rnd.choice((named(("comments", "comment-list", "discussion", "replies")), '<section class="comments">', '<section id="comments">')) + rnd.choice(("", f"<h2>{text(1, 3, '')}</h2>")) + "".join(f'<{c} class="comment"><p>{text(3, 60)}</p></{c}>' for c in [rnd.choice(("div", "article", "li"))] for _ in range(rnd.randint(1, 5))),
            "share": lambda: named(("share", "social", "tags", "author-bio")) + links(),
        }[kind]()
        tag = re.match(r"<(\w+)", body)[1]
        add(f"{body}</{tag}>" if rnd.random() < 0.97 or kind in ("footer",) else f"{body}</{tag}>")

    def article() -> None:
        opening = rnd.choice(("<article>", "<article>", '<article class="post">', "<main><article>", "<main>", named(("content", "post", "entry-content", "article-body", "main", "story")), named((f"{word()}-{word()}", f"story-{word()}", f"{word()}-text"))))
        add(opening, 1)
        if rnd.random() < 0.8:
            add(rnd.choice(("<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h1><b>{}</b></h1>")).format(text(2, 12, rnd.choice(("", ".")))), 1)
        inner = [k for k in ("ad", "share", "form", "aside", "notice", "comment") if rnd.random() < 0.25]
        for _ in range(rnd.randint(1, 12)):
            kind = rnd.random()
            if kind < 0.1:
                add(f"<h2>{text(1, 8, '')}</h2>", 1)
            elif kind < 0.16:
                add("<ul>" + "".join(f"<li>{text(1, 15, rnd.choice(('', '.')))}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>", 1)
            elif kind < 0.2:
                add(f"<blockquote><p>{text(5, 40)}</p></blockquote>", 1)
            elif kind < 0.24:
                add("<table>" + "".join(f"<tr><td>{word()}</td><td>{text(1, 4, '')}</td></tr>" for _ in range(rnd.randint(1, 4))) + "</table>", 1)
            elif kind < 0.28:
                add(f"<pre><code>{text(3, 20, '')}</code></pre>", 1)
            elif kind < 0.34:
                add(f"<p>{' | '.join(word() for _ in range(rnd.randint(5, 60)))} |</p>", 1)
            else:
                add(rnd.choice(("<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<p>{} <a href='/x'>w</a> and.</p>", "<div>{}</div>")).format(text(*rnd.choice(((1, 5), (5, 30), (20, 120))))), 1)
            if inner and rnd.random() < 0.5:
                rest(inner.pop())
        add("".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening))), 1)

    before = [k for k in ("header", "nav", "notice", "ad", "form", "aside") if rnd.random() < (0.75 if k == "nav" else 0.4)]
    after = [k for k in ("share", "comment", "aside", "ad", "form", "notice", "nav", "footer") if rnd.random() < (0.75 if k == "footer" else 0.35)]
    wrap = rnd.choice(("", "", '<div class="page">', '<div id="wrapper"><div class="container">'))
    add(wrap)
    for k in before:
        rest(k)
    article()
    for k in after:
        rest(k)
    return out


def labelled_blocks(rnd: random.Random) -> tuple[str, list[Block], list[int]]:
    """A page, its blocks and their labels: every piece is marked by a word that the parse takes out again."""
    pieces = labelled_page(rnd)
    marked, mark = [], re.compile("[]")
    for s, y in pieces:
        marked.append(re.sub(r">([^<]*[^\s<][^<]*)", lambda m, y=y: f">{chr(0xE000 + y)}{m[1]}", s))
    page = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>" + "".join(marked) + "</body></html>"
    blocks, labels = parse(page), []
    for b in blocks:
        labels.append(int("" in b.text))
        b.text = " ".join(mark.sub("", b.text).split())
    keep = [i for i, b in enumerate(blocks) if b.text]
    return mark.sub("", page), [blocks[i] for i in keep], [labels[i] for i in keep]


# --- the field ---


class Field:
    """Weights of the chain: per feature and label, from label to label, and of the first label."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.names, self.emit, self.move, self.first = names, emit, move, first
        self.paths: dict[tuple, float] = {}
        self.texts: dict[tuple, float] = {}

    def _more(self, known: dict[tuple, float], key: tuple, found: list[str]) -> float:
        """What features speak for label 1 against label 0."""
        if len(known) > 50_000:
            known.clear()
        known[key] = x = float(sum(self.emit[self.names[f], 1] - self.emit[self.names[f], 0] for f in found if f in self.names))
        return x

    def scores(self, blocks: list[Block]) -> list[float]:
        out, n = [], len(blocks)
        for i, b in enumerate(blocks):
            x = self.paths.get(b.path)
            if x is None:
                x = self._more(self.paths, b.path, _path_features(b.path))
            bins = _text_bins(b, i, n)
            y = self.texts.get(bins)
            out.append(x + (self._more(self.texts, bins, _text_features(bins)) if y is None else y))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """Best labels, by Viterbi."""
        if not blocks:
            return []
        s = self.scores(blocks)
        (aa, ab), (ba, bb) = self.move.tolist()
        x, y = float(self.first[0]), s[0] + float(self.first[1])
        back = []
        for e in s[1:]:
            back.append((x + aa < y + ba, x + ab < y + bb))
            x, y = max(x + aa, y + ba), max(x + ab, y + bb) + e
        now = int(y > x)
        out = [now]
        for b in reversed(back):
            now = int(b[now])
            out.append(now)
        return out[::-1]


def train(pages: int = 400, seed: int = 11, steps: int = 80, decay: float = 3e-4) -> Field:
    """Maximum likelihood on labelled pages, all chains side by side: forward-backward, then a step of Adam."""
    rnd = random.Random(seed)
    found = [(features(b), y) for _, b, y in (labelled_blocks(rnd) for _ in range(pages)) if b]
    counts: dict[str, int] = {}
    for rows, _ in found:
        for row in rows:
            for x in row:
                counts[x] = counts.get(x, 0) + 1
    names = {x: i for i, x in enumerate(sorted(x for x, n in counts.items() if n >= 5))}
    longest, n = max(len(y) for _, y in found), len(found)
    labels, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest))
    where, what = [], []
    for i, (rows, y) in enumerate(found):
        labels[i, : len(y)], mask[i, : len(y)] = y, 1
        for j, row in enumerate(rows):
            at = [names[x] for x in row if x in names]
            where += [i * longest + j] * len(at)
            what += at
    where, what = np.array(where), np.array(what)
    truth = np.eye(2)[labels] * mask[..., None]
    w = np.zeros(2 * len(names) + 6)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    lse = lambda x, axis: (top := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))
    total = mask.sum()
    for step in range(1, steps + 1):
        emit, move, first = w[: 2 * len(names)].reshape(-1, 2), w[-6:-2].reshape(2, 2), w[-2:]
        s = np.stack([np.bincount(where, emit[what, k], minlength=n * longest) for k in (0, 1)], axis=1).reshape(n, longest, 2)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = s[:, 0] + first
        for t in range(1, longest):
            here = lse(ahead[:, t - 1, :, None] + move, 1) + s[:, t]
            ahead[:, t] = np.where(mask[:, t, None] > 0, here, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            here = lse(move + (s[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1, None] > 0, here, 0)
        z = lse(ahead[:, -1], 1)
        one = np.exp(ahead + behind - z[:, None, None]) * mask[..., None]
        two = np.exp(ahead[:, :-1, :, None] + move + (s + behind)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        gap = one - truth
        g_emit = np.stack([np.bincount(what, gap.reshape(-1, 2)[where, k], minlength=len(names)) for k in (0, 1)], axis=1)
        g_move = two.sum(axis=(0, 1)) - np.einsum("nti,ntj->ij", truth[:, :-1] * mask[:, 1:, None], truth[:, 1:])
        g = np.concatenate([g_emit.reshape(-1), g_move.reshape(-1), gap[:, 0].sum(axis=0)]) / total + decay * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w = w - 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Field(names, w[: 2 * len(names)].reshape(-1, 2).copy(), w[-6:-2].reshape(2, 2).copy(), w[-2:].copy())


_default: Field | None = None


def default_field() -> Field:
    """The field of the registered query, trained once a process."""
    global _default
    if _default is None:
        _default = train()
    return _default


def main_text(page: str | None, field: Field) -> str:
    """The article's blocks in page order, joined by two line feeds; empty if there are none."""
    blocks = parse(page)
    return "\n\n".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, text, n_chars (code points).

    Null and empty pages, and pages without an article, have an empty text. Whole pages are read, whatever their length; repeated rows and null
    ids are kept each; an empty table gives none.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())  # some hundred weights

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(t, shared.value) for t in texts_of(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return arrow_map(slim, run, f"{id_col} long, {url_col} string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of `pages`."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op7_html_text": op7_html_text}
ORACLE: dict[str, str] = {}
