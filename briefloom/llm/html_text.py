"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (text between block-level tags) with their ancestors.  Tag,
class and text features of each block and the transition between neighbours are weighted by a
two-state chain; Viterbi decoding marks the blocks of the article.  The weights are trained
here, by gradient ascent on the likelihood of labelled pages, which a generator lays out in
many templates with known labels.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from briefloom.llm.common import table
from briefloom.llm.texts import map_texts

#: Labelled pages of the training set, pages a feature must stand on, steps of the ascent.
TRAINING_PAGES, LEAST_PAGES, STEPS = 600, 3, 150
#: Elements whose content is never text: those that run to the page's end without an end tag, and those that need one.
RAW, DROPPED = "script|style|template|textarea|title|iframe", "svg|select|button|video|audio|canvas"
DROPPED_TAGS, SELF_CLOSED = frozenset(DROPPED.split("|")), frozenset({"svg"})
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("hr".split())
#: A start tag of the second kind ends an open element of the first.
SELF_NESTED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SECTIONS = frozenset("article aside body footer form header main nav section table".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""",
    re.S | re.I,
)
#: Tags of the dropped elements, outside comments and raw elements.
DROPPED_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    rf"""|<(/?)({DROPPED})(?=[\s/>])((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)({DROPPED})(?=[\s/>])([^>]*)>""",
    re.S | re.I,
)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    """A leaf block: its own tag, the nearest section, the different ancestors and class words, text, share of it in links."""

    __slots__ = ("own", "near", "tags", "marks", "text", "linked")

    def __init__(self, own, near, tags, marks, text, linked):
        self.own, self.near, self.tags, self.marks, self.text, self.linked = own, near, tags, marks, text, linked


class Path:
    """The open elements: how many of each tag and class word, so that depth costs nothing."""

    def __init__(self, known: frozenset[str] | None):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.sections: list[str] = []
        self.tags: dict[str, int] = {}
        self.marks: dict[str, int] = {}
        self.known = known

    def open(self, tag: str, words: list[str]) -> None:
        own = tuple({w for w in words if self.known is None or w in self.known})
        self.stack.append((tag, own))
        if tag in SECTIONS:
            self.sections.append(tag)
        self.tags[tag] = self.tags.get(tag, 0) + 1
        for w in own:
            self.marks[w] = self.marks.get(w, 0) + 1

    def leave(self) -> str:
        tag, own = self.stack.pop()
        if tag in SECTIONS:
            self.sections.pop()
        for held, key in ((self.tags, tag), *((self.marks, w) for w in own)):
            held[key] -= 1
            if not held[key]:
                del held[key]
        return tag

    def close(self, tag: str) -> None:
        if tag in self.tags:
            while self.leave() != tag:
                pass

    def top(self) -> str | None:
        return self.stack[-1][0] if self.stack else None


def dropped_ends(page: str) -> dict[int, int]:
    """Where the dropped elements with an end tag start: where they end."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in DROPPED_TAG.finditer(page):
        if name := m[3] or m[6]:
            name = name.lower()
            if not (m[2] or m[5]):
                if not (name in SELF_CLOSED and page[m.end() - 2] == "/"):
                    opened.setdefault(name, []).append(m.start())
            elif opened.get(name):
                ends[opened[name].pop()] = m.end()
    return ends


def leaf_blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks in page order.  Class words that aren't ``known`` (None: all are) are left out of account."""
    blocks: list[Block] = []
    if not page:
        return blocks
    path = Path(known)
    parts: list[str] = []
    linked, in_link = 0, False

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                near = path.sections[-1] if path.sections else "none"
                blocks.append(Block(path.top() or "none", near, tuple(path.tags), tuple(path.marks), text, min(1.0, linked / max(1, len(text)))))
        parts, linked = [], 0

    def add(raw: str):
        nonlocal linked
        if raw:
            parts.append(raw)
            if in_link:
                linked += len(raw.strip())

    at, ends = 0, None
    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, closing = name.lower(), bool(m[2] or m[5])
        if name in DROPPED_TAGS:
            if not closing:
                ends = dropped_ends(page) if ends is None else ends
                at = ends.get(m.start(), at)
        elif name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK_TAGS:
            flush()
            if closing:
                path.close(name)
                continue
            if path.top() == "p":
                path.leave()
            if path.top() in SELF_NESTED.get(name, ()):
                path.leave()
            if name not in VOID_TAGS:
                path.open(name, [w.lower() for x in MARKS.findall(m[4] or m[7] or "") for v in x if v for w in PART.findall(v)])
    add(page[at:])
    flush()
    return blocks


def block_features(b: Block) -> list[str]:
    words = b.text.count(" ") + 1
    size = next(k for k, most in enumerate((2, 5, 10, 20, 50, 1 << 60)) if words <= most)
    link = 0 if b.linked == 0 else 1 if b.linked < 0.3 else 2 if b.linked < 0.8 else 3
    out = [f"t:{b.own}", f"n:{b.near}", f"n:{b.near}/t:{b.own}", f"l:{size}", f"k:{link}", f"e:{b.text[-1] in '.!?…'}", "bias"]
    out += [f"a:{t}" for t in b.tags] + [f"c:{w}" for w in b.marks]
    if "©" in b.text:
        out.append("copyright")
    return out


class Crf:
    """Two states (0 other, 1 article) with emission weights by feature and transition weights."""

    def __init__(self, emit: dict[str, tuple[float, float]], move: list[list[float]], start: list[float]):
        self.emit, self.move, self.start = emit, move, start
        self.words = frozenset(f[2:] for f in emit if f.startswith("c:"))

    def decode(self, pages_features: list[list[str]]) -> list[int]:
        """Viterbi: the most likely states of a page's blocks."""
        if not pages_features:
            return []
        (m00, m01), (m10, m11) = self.move
        back, s0, s1 = [], *self.start
        get, none = self.emit.get, (0.0, 0.0)
        for k, fs in enumerate(pages_features):
            e0 = e1 = 0.0
            for f in fs:
                a, b = get(f, none)
                e0 += a
                e1 += b
            if k:
                a0, a1, b0, b1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
                back.append((int(a1 > a0), int(b1 > b0)))
                s0, s1 = max(a0, a1) + e0, max(b0, b1) + e1
            else:
                s0, s1 = s0 + e0, s1 + e1
        state = int(s1 > s0)
        states = [state]
        for choice in reversed(back):
            state = choice[state]
            states.append(state)
        return states[::-1]


def train_crf(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, ridge: float = 0.02) -> Crf:
    """Maximum likelihood with an L2 penalty by Adam; forward and backward run over all pages at once."""
    pages = [p for p in pages if p[0]]
    seen = Counter(f for fs, _ in pages for f in {f for b in fs for f in b})
    names = sorted(f for f, n in seen.items() if n >= LEAST_PAGES or len(pages) < 2 * LEAST_PAGES)
    number = {f: k for k, f in enumerate(names)}
    n, longest = len(pages), max(len(y) for _, y in pages)
    x = np.zeros((n, longest, len(names)), np.float32)
    y, on = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (fs, labels) in enumerate(pages):
        for t, b in enumerate(fs):
            x[i, t, [number[f] for f in b if f in number]] = 1
        y[i, : len(labels)], on[i, : len(labels)] = labels, True
    flat, where = x[on], np.full((n, longest), -1)
    where[on] = np.arange(len(flat))
    w, move, start = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    hot = np.eye(2)[y] * on[..., None]
    pairs = (on[:, 1:] & on[:, :-1])[..., None, None]
    moved = (hot[:, :-1, :, None] * hot[:, 1:, None, :] * pairs).sum((0, 1))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, move, start)]
    for step in range(1, steps + 1):
        e = np.zeros((n, longest, 2))
        e[on] = flat @ w
        alpha = np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0] + start
        for t in range(1, longest):
            nxt = np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1]) + e[:, t]
            alpha[:, t] = np.where(on[:, t, None], nxt, alpha[:, t - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        beta = np.zeros((n, longest, 2))
        for t in range(longest - 2, -1, -1):
            to = beta[:, t + 1] + e[:, t + 1]
            prev = np.logaddexp(move[:, 0] + to[:, :1], move[:, 1] + to[:, 1:])
            beta[:, t] = np.where(on[:, t + 1, None], prev, 0)
        p = np.exp(alpha + beta - z[:, None, None]) * on[..., None]
        both = np.exp(alpha[:, :-1, :, None] + move + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * pairs
        grads = (flat.T @ (hot - p)[on] - ridge * w, moved - both.sum((0, 1)) - ridge * move, (hot - p)[:, 0].sum(0) - ridge * start)
        for (m, v), value, g in zip(state, (w, move, start), grads):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf({f: (float(w[k, 0]), float(w[k, 1])) for f, k in number.items()}, move.tolist(), start.tolist())


#: Words that class names of page parts use.
OTHER_PARTS = {
    "nav": ("nav", "menu", "navbar", "breadcrumb", "toc", "navigation", "links"),
    "header": ("header", "masthead", "banner", "topbar", "logo", "site-header"),
    "footer": ("footer", "copyright", "legal", "site-footer", "bottom"),
    "aside": ("sidebar", "aside", "related", "widget", "popular", "recommended", "teaser"),
    "notice": ("cookie", "consent", "notice", "gdpr", "alert", "popup", "modal", "subscribe", "newsletter", "paywall"),
    "ad": ("ad", "ads", "advert", "sponsor", "promo", "banner-ad", "advertisement", "sponsored"),
    "form": ("form", "search", "login", "signup", "contact-form"),
    "comments": ("comments", "comment", "comment-list", "replies", "discussion", "disqus", "responses", "reader-comments"),
    "share": ("share", "social", "tags", "byline", "meta", "author"),
}
ARTICLE_PARTS = (
    "content", "post", "entry", "story", "article", "article-body", "main", "text", "post-content", "entry-content", "body", "page", "news", "news_end", "article_view", "detail",
)


def labelled_page(r: random.Random) -> tuple[str, list[int]]:
    """A page laid out at random, and the label of each of its leaf blocks."""
    out: list[str] = []
    labels: list[int] = []
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwyzéäñ") for _ in range(r.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    closed = lambda tag: f"</{tag}>" if r.random() < 0.97 else ""

    def block(tag: str, text: str, label: int, attrs: str = ""):
        out.append(f"<{tag}{attrs}>{text}</{tag}>")
        labels.append(label)

    def sentence_like(most: int = 60) -> str:
        return words(r.randint(1, most)).capitalize() + r.choice((".", ".", ".", "", "!", "?"))

    def attrs(kind: str) -> str:
        return f' {r.choice(("class", "id"))}="{r.choice(OTHER_PARTS[kind])}{r.choice(("", "", f" {word()}", "-box"))}"' if r.random() < 0.85 else ""

    def part(kind: str):
        tag = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"),
               "form": ("form", "form", "div")}.get(kind, ("div", "section", "div"))
        tag = r.choice(tag)
        out.append(f"<{tag}{attrs(kind) if tag in ('div', 'section', 'ul') else r.choice(('', attrs(kind)))}>")
        if tag in ("div", "section", "ul") and "=" not in out[-1]:
            out[-1] = f'<{tag} class="{r.choice(OTHER_PARTS[kind])}">'
        if kind == "nav":
            if tag != "ul":
                out.append("<ul>")
            for _ in range(r.randint(2, 8)):
                block("li", f'<a href="/{word()}">{words(r.randint(1, 3))}</a>', 0)
            if tag != "ul":
                out.append("</ul>")
        elif kind == "comments":
            if r.random() < 0.3:
                block(r.choice(("h2", "h3", "p")), words(r.randint(1, 3)), 0)
            for _ in range(r.randint(1, 5)):
                wrapped = r.random() < 0.4
                if wrapped:
                    out.append(r.choice(('<div class="comment">', '<div class="comment-body">', "<li>", "<div>", "<blockquote>")))
                block(r.choice(("p", "div", "p") if wrapped else ("p", "div", "li", "p")), sentence_like(60), 0, r.choice(("", "", ' class="comment"', ' class="reply"')))
                if wrapped:
                    out.append("</li>" if out[-2] == "<li>" else "</blockquote>" if out[-2] == "<blockquote>" else "</div>")
        elif kind == "form":
            block(r.choice(("label", "p", "div")) if r.random() < 0.7 else "p", words(r.randint(1, 4)) + '<input type="text">', 0)
            if out[-1].startswith("<label"):  # inline: its own block all the same, with a break before the next
                out[-1] = out[-1].replace("label", "div")
        elif kind == "footer":
            block(r.choice(("p", "div", "span")) if r.random() < 0.5 else "p", f"&copy; {words(r.randint(1, 8))}", 0)
            if out[-1].startswith("<span"):
                out[-1] = out[-1].replace("span", "div")
        elif r.random() < 0.5:
            out.append(sentence_like(30))
            labels.append(0)
        else:
            for _ in range(r.randint(1, 3)):
                block(r.choice(("p", "div", "li", "h3")), sentence_like(30), 0)
        out.append(f"</{tag}>")

    def article():
        marked = (("article", ""), ("article", ""), ("main", ""), ("div", f' class="{r.choice(ARTICLE_PARTS)}"'), ("section", f' id="{r.choice(ARTICLE_PARTS)}"'))
        tag, mark = r.choice(marked) if r.random() < 0.75 else r.choice((("", ""), ("", ""), ("div", ""), ("div", f' class="{word()}"'), ("td", "")))
        out.append(f"<{tag}{mark}>" if tag else "")
        if r.random() < 0.65:
            block("h1", words(r.randint(1, 10)), 1)
        if r.random() < 0.15:
            part("share")
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.08:
                block("h2", words(r.randint(1, 6)), 1)
            elif kind < 0.14:
                block("li", sentence_like(20), 1)
            elif kind < 0.18:
                block("blockquote", sentence_like(30), 1)
            elif kind < 0.24:
                part(r.choice(("ad", "share", "aside", "notice", "comments")))
            elif kind < 0.3:
                out.append(f"<p><b>{sentence_like(20)}<br>")
                labels.append(1)
            else:
                block("p", sentence_like(80).replace(" ", f' <a href="/{word()}">x</a> ', 1) if r.random() < 0.15 else sentence_like(80), 1)
        if r.random() < 0.3:
            part("comments")
        out.append(closed(tag) if tag == "article" else f"</{tag}>" if tag else "")

    out.append(f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body>" if r.random() < 0.8 else "")
    bare = r.random() < 0.12  # nothing but the article
    before = [k for k in ("notice", "header", "nav", "ad", "form", "aside") if r.random() < 0.4 and not bare]
    r.shuffle(before)
    for k in before:
        part(k)
    article()
    if out[-1] == "" and "<article>" in out:
        out.append("</article>")
    after = [k for k in ("comments", "aside", "ad", "form", "notice") if r.random() < 0.35 and not bare] + ["footer"] * (r.random() < 0.8 and not bare)
    for k in after:
        part(k)
    out.append("</body></html>")
    return "".join(out), labels


@functools.lru_cache(1)
def trained_crf(pages: int = TRAINING_PAGES, seed: int = 11) -> Crf:
    """The chain trained on ``pages`` generated labelled pages; the same every time."""
    r, rows = random.Random(seed), []
    while len(rows) < pages:
        page, labels = labelled_page(r)
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            rows.append(([block_features(b) for b in blocks], labels))
    return train_crf(rows)


def main_text(page: str | None, crf: Crf) -> str:
    blocks = leaf_blocks(page, crf.words)
    states = crf.decode([block_features(b) for b in blocks])
    return "\n".join(b.text for b, s in zip(blocks, states) if s)


def extract(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url"), crf: Crf | None = None) -> DataFrame:
    """The main text of every whole page: ``keep``, ``text`` and ``n_chars`` (its code points).

    White space inside a block is one space, blocks are joined by a line feed.

    Defined cases: null, empty and textless pages give an empty text; unclosed and stray tags
    are put up with; null and repeated ids are carried; an empty table gives no rows; further
    columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(crf or trained_crf())

    def make():
        model = shared.value

        def use(texts):
            found = [main_text(t, model) for t in texts]
            return {"text": found, "n_chars": [len(t) for t in found]}

        return use

    return map_texts(pages, make, {"text": "string", "n_chars": "long"}, keep, column)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
