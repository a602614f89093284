"""Main text of web pages by a maximum-scoring run of tokens.

A page is a sequence of tags and words. Every word gets a score from the kind of element it stands in and every tag one from its
name (an element that is apparatus counts as one tag), and the contiguous run of tokens with the largest sum (one linear scan) is the content region. The scores are log odds
of lying in the content, counted over labelled pages: pages whose author marked the content with ``article``, ``main`` or
``articleBody``. Tokens of such pages inside the mark, and not inside an element that is apparatus, count as content. An element is apparatus by its
kind (``nav``, ``aside``, ``form`` ...), or by the words of its class, id and role: each has log odds of its own, counted over the same pages from
counts that stand for what such words usually mean, and they are weighed against what the element's kind and place say. Words in running text come out positive, tags and
words of menus, footers and notices negative. The marks themselves are scored like other tags and take no part in the scan otherwise.

From the region the text blocks are read off: apparatus inside it is left out, character references are decoded, white
space in a block becomes one blank, and blocks are joined by a newline.

Bounds: weights are counted over at most ``LABELLED`` marked pages (the least hashes of their ids) besides the counts in ``PRIOR``,
which stand in where a table has none. Every page is read whole. Defined results: null or empty html gives an empty text; a page without a
positive run gives an empty text; of equally good runs the first and longest is taken; unclosed tags end where their parent
does, and a tag that the page breaks off in is dropped.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .sampling import first_by_hash

#: Marked pages from which weights are counted, at most.
LABELLED = 400

# Elements by their part in a page.
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "map", "datalist", "select", "option", "textarea"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
APPARATUS = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "label", "input"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "head", "title", "button", "dialog", "legend",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Words in a class, id or role, by what they say about an element before any page is seen.
SURELY_APART = (
    "ad ads adsense advert advertisement advertisements advertising adverts banner banners breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer footers gdpr login masthead menu menus modal modals"
    " nav navbar navigation newsletter newsletters overlay pager pagination popup popups promo promos promotion promotions replies respond sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription toolbar topbar"
    " widget widgets"
).split()
MAYBE_APART = "alert aside copyright disclaimer form forms header headers legal notice notices recommend recommendations recommended related search share sharing skip tag tags".split()
MAYBE_CONTENT = "article body content entry headline main post story text title".split()
NAME = re.compile(r"[a-z]+")
MARKS = {"article", "main"}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)|<(?=[a-zA-Z/])[^<]*\Z", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
#: Content and other tokens seen beforehand, in the order (content, other), by feature.
PRIOR = {"w:p": (400, 8), "w:list": (20, 8), "w:head": (60, 4), "w:link": (8, 16), "w:text": (6, 6), "w:quote": (20, 2), "w:cell": (10, 6), "off": (2, 40)} | {f"{end}h{i}": (6, 8) for end in ("", "/") for i in range(1, 7)}
TAG_PRIOR = (1, 3)
NAME_PRIOR = {f"c:{n}": c for names, c in ((SURELY_APART, (0.5, 200.0)), (MAYBE_APART, (0.5, 8.5)), (MAYBE_CONTENT, (8.5, 0.5))) for n in names}
#: Log odds that an element is content for being a paragraph, a heading and the like, and for standing inside a mark.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "li", "td", "th", "dd", "dt"}
IS_TEXT, IN_MARK = 3.5, 3.0


class Token:
    """A tag or a run of text: where it stands, what it counts as, and the words that name it."""

    __slots__ = ("block", "feature", "marked", "names", "off", "text", "words")

    def __init__(self, feature: str, off: bool, marked: bool, block: bool, text: str = "", words: int = 1, names: tuple[str, ...] = ()):
        self.feature, self.off, self.marked, self.block, self.text, self.words, self.names = feature, off, marked, block, text, words, names


def named(name: str, attributes: str) -> tuple[tuple[str, ...], bool]:
    """(the distinct words of class, id and role as features, whether the element is hidden)."""
    found: dict[str, None] = {}
    hidden = False
    for m in ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "style":
            hidden = hidden or "display:none" in value.replace(" ", "")
        elif key in ("class", "id", "role"):
            found |= dict.fromkeys(f"c:{n}" for n in NAME.findall(value))
    return tuple(found), hidden


def is_off(name: str, names: tuple[str, ...], hidden: bool, inside_mark: bool, weight: dict[str, float]) -> bool:
    """Whether an element is apparatus: by its kind, or because the words that name it speak against content more than its kind and place speak for it."""
    if hidden or (name in APPARATUS and not (name == "header" and inside_mark)):
        return True
    if not names or name in ("html", "body", "article", "main"):
        return False
    return sum(weight.get(n, 0.0) for n in names) + IS_TEXT * (name in TEXTUAL) + IN_MARK * inside_mark < 0


def tokens(page: str, weight: dict[str, float]) -> list[Token]:
    """The page's tags and text runs in order; ``weight`` has the log odds of the words that name elements."""
    out: list[Token] = []
    stack: list[tuple[str, bool, bool]] = []  # name, opens apparatus, opens a mark
    off = marked = 0
    kind = {"li": "list", "dd": "list", "dt": "list", "a": "link", "blockquote": "quote", "td": "cell", "th": "cell", "p": "p", "pre": "p"} | {f"h{i}": "head" for i in range(1, 7)}

    def pop() -> None:
        nonlocal off, marked
        _, was_off, was_mark = stack.pop()
        off -= was_off
        marked -= was_mark

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            text = page[at:stop]
            if not text.isspace():
                where = next((kind[n] for n, _, _ in reversed(stack) if n in kind), "text")
                out.append(Token("" if off else f"w:{where}", off > 0, marked > 0, False, text, len(text.split())))
            else:
                out.append(Token("", off > 0, marked > 0, False, " ", 0))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        block = name in BLOCKS
        if m[1]:  # closing: what is open inside ends too
            if any(n == name for n, _, _ in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            out.append(Token("" if off else f"/{name}", off > 0, marked > 0, block))
            continue
        if name == "p" or name == "li" or name in ("td", "tr", "dd", "dt"):  # these end an open one of their kind
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in ("ul", "ol", "table", "div", "article", "main", "section", "body", "dl"):
                    break
        mark = name in MARKS or "articlebody" in (m[3] or "").lower()
        silent = name in SILENT
        names, hidden = named(name, m[3] or "")
        apart = silent or is_off(name, names, hidden, marked > 0, weight)
        # Apparatus is one token, whatever it holds: it is left out of the text anyway, and must not tear the content apart.
        out.append(Token("" if off else "off" if apart else name, off > 0 or apart, marked > 0, block, names=() if silent else names))
        if name in RAW and not (m[3] or "").endswith("/"):
            end = re.compile(rf"</{name}\b", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
        if name not in VOID and not (m[3] or "").rstrip().endswith("/"):
            stack.append((name, apart, mark))
            off += apart
            marked += mark
        elif name == "br":
            out[-1].text = " "
    return out


def count(pages: list[str]) -> dict[str, tuple[int, int]]:
    """Content and other tokens by feature, over the marked pages among these. A word that names elements counts by the mark alone."""
    seen: dict[str, list[int]] = {}
    before = weights({})
    for page in pages:
        own = tokens(page, before)
        if any(t.marked for t in own):
            for t in own:
                if t.feature:
                    seen.setdefault(t.feature, [0, 0])[0 if t.marked and not t.off else 1] += t.words
                for n in t.names:
                    seen.setdefault(n, [0, 0])[0 if t.marked else 1] += 1
    return {k: (a, b) for k, (a, b) in seen.items()}


def weights(seen: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log odds by feature, against the prior counts; words of running text stay positive, tags and apparatus negative."""
    out = {}
    for k in {*seen, *PRIOR, *NAME_PRIOR}:
        a, b = seen.get(k, (0, 0))
        if k.startswith("c:"):
            x, y = NAME_PRIOR.get(k, (4.0, 4.0))
            out[k] = math.log((a + x) / (b + y))
            continue
        x, y = PRIOR.get(k, TAG_PRIOR)
        odds = math.log((a + x) / (b + y))
        if k == "off":
            odds = min(odds, -1.0)
        elif k.startswith("w:"):
            odds = max(odds, 0.25) if k in ("w:p", "w:quote", "w:head") else odds
        else:
            odds = min(odds, -0.5)
        out[k] = max(-4.0, min(4.0, odds))
    return out


def region(own: list[Token], weight: dict[str, float]) -> tuple[int, int]:
    """First and last-plus-one token of the best run."""
    best, total, start, span = 0.0, 0.0, 0, (0, 0)
    unseen = math.log(TAG_PRIOR[0] / TAG_PRIOR[1])
    for i, t in enumerate(own):
        score = weight.get(t.feature, unseen if t.feature else 0.0) * (t.words if t.feature.startswith("w:") else 1)
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract(page: str | None, weight: dict[str, float]) -> str:
    if not page:
        return ""
    own = tokens(page, weight)
    a, b = region(own, weight)
    blocks: list[list[str]] = [[]]
    for t in own[a:b]:
        if t.block:
            blocks.append([])
        if t.text and not t.off:
            blocks[-1].append(t.text)
    lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks)
    return "\n".join(line for line in lines if line)


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weights from at most LABELLED marked pages."""
    low = F.lower(pages[html_col])
    marked = pages.filter(low.contains("<article") | low.contains("<main") | low.contains("articlebody"))
    chosen = first_by_hash(marked, id_col, LABELLED).distinct()
    sample = pages.join(F.broadcast(chosen), id_col).select(F.col(html_col).alias("h"))  # at most LABELLED ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = count([h for h in batch.column(0).to_pylist() if h])
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(seen), pa.string()), "a": pa.array([a for a, _ in seen.values()], pa.int64()), "b": pa.array([b for _, b in seen.values()], pa.int64())})

    got = arrow_map(sample, run, "k string, a bigint, b bigint").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()  # a row a tag name of the sample
    return weights({r["k"]: (r["a"], r["b"]) for r in got})


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", weight: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(id, text) of every page, and the columns of ``keep`` between them."""
    weight = learn(pages, id_col, html_col) if weight is None else weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([extract(h.as_py(), weight) for h in part.column(part.num_columns - 1)], pa.string())], names=[*part.schema.names[:-1], "text"])

    kept = [(c, pages.schema[c].dataType.simpleString()) for c in keep or []]
    schema = ", ".join([f"id {pages.schema[id_col].dataType.simpleString()}", *[f"`{c}` {t}" for c, t in kept], "text string"])
    rows = pages.select(pages[id_col].alias("id"), *[pages[c] for c, _ in kept], pages[html_col].alias("\x00html"))
    return arrow_map(rows, run, schema)


def share_of_words(found: str, wanted: str) -> float:
    """F-measure of the words of two texts, repeats counted; 1 for two empty texts."""
    a, b = np.unique(found.split(), return_counts=True), np.unique(wanted.split(), return_counts=True)
    n, m = int(a[1].sum()), int(b[1].sum())
    if not n or not m:
        return float(n == m)
    other = dict(zip(b[0].tolist(), b[1].tolist(), strict=True))
    both = sum(min(c, other.get(w, 0)) for w, c in zip(a[0].tolist(), a[1].tolist(), strict=True))
    return 2 * both / (n + m)
