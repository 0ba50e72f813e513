"""HTML extraction: a page as flat text blocks, each kept or dropped by a decision tree over its words and links, those of its neighbours, and the share of the page's words around it."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .html_examples import PAGES
from .simhash_dedup import _slices

_TAG = re.compile(r"<(?:!--(?P<comment>)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(?P<other>[!?][^>]*|/)>)")
_LOOSE = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>")
_ATTR = re.compile(r"([a-zA-Z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template title textarea select button svg iframe object canvas audio video".split())
#: Those of them whose content is no markup: nothing but their own end tag ends them. The others also end with the block they are in.
RAW = frozenset("script style noscript title textarea iframe".split())
#: Elements that end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose purpose is passed on to what they hold.
HOLDER = frozenset("article aside body details dialog div dl fieldset figure footer form head header html main menu nav ol section span table ul".split())
MAIN, SIDE = frozenset("article main".split()), frozenset("aside dialog footer form head menu nav fieldset".split())
#: Parts of class names, ids and roles that tell of what stands beside an article, whole sentences too ...
MARKS = frozenset(
    "ad ads advert advertisement adverts banner banners breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus footer gdpr modal "
    "newsletter notice notices popup promo promoted promotion related replies reply respond sidebar sidenav sponsor sponsored widget widgets".split()
)
#: ... and those of what is there to click or to fill in, which prose does not belong to.
TOOLS = frozenset("dialog form login menu nav navbar navigation pager pagination search share sharing signup social subscribe subscription tags toolbar topbar".split())
TOP = frozenset("header masthead heading".split())
#: Parts that say nothing of a purpose.
NEUTRAL = frozenset("a area article bar big block body bottom box button buttons col column container content entry group inner item items left link links list main outer page panel post right row section small the top wrap wrapper".split())
#: Blocks from which on what holds them is a group.
GROUP = 3
#: own_share, group_share, article_share: how much of the page's unlinked words, but those of aside, the nearest element, the nearest one of GROUP blocks, and the article element around a block hold. aside: 1 in a hidden element or
#: one for menus, forms, footers and the like; such blocks go in any case, and the tree decides of the others. marks, tools: how much of a class name around the block is among MARKS and TOOLS, from 0 to 1: hints that words and links can outweigh.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "own_share", "group_share", "article_share", "aside", "marks", "tools", "heading")

ASIDE = FEATURES.index("aside")


class _Holder:
    __slots__ = ("name", "above", "article", "aside", "marks", "tools", "plain", "count", "group")

    def __init__(self, name: str, attrs: str, above: _Holder | None):
        values = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if "=" in attrs else {}
        self.name, self.above, self.plain, self.count, self.group = name, above, 0, 0, self
        inside = above.article if above else None
        is_main = name in MAIN or values.get("role") == "main" or "articlebody" in values.get("itemprop", "").lower()
        self.article = inside or (self if is_main else None)
        words = MARKS if inside else MARKS | TOP
        tokens = [t for k in ("class", "id", "role") for t in values.get(k, "").split()]
        marks = max((_share(t, words) for t in tokens), default=0.0)
        tools = max((_share(t, TOOLS) for t in tokens), default=0.0)
        hidden = "display:none" in values.get("style", "").replace(" ", "").lower() or values.get("aria-hidden") == "true" or re.search(r"(^|\s)hidden(\s|$|/)", attrs) is not None
        # a page or an article is not a part beside itself, whatever its class says, unless it is a comment and no more
        if name in ("html", "body") or (name in MAIN and marks < 1):
            marks = tools = 0.0
        self.aside = (above.aside if above else False) or hidden or name in SIDE or (name == "header" and not inside)
        self.marks, self.tools = max(above.marks if above else 0.0, marks), max(above.tools if above else 0.0, tools)


def _share(token: str, words: frozenset[str]) -> float:
    """How many parts of a class name are among the words, of those that say anything."""
    parts = [p for x in _PART.findall(token) if (p := x.lower()) not in NEUTRAL]
    return sum(p in words for p in parts) / len(parts) if parts else 0.0


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """The text blocks of a page in order, and FEATURES of each.

    White space of a block becomes one space; character references are decoded; comments, scripts and the like are no text. Markup that is cut off at the end is dropped,
    and so is what follows a raw-text element without an end tag.
    """
    stack = [_Holder("html", "", None)]
    holders = stack[:]
    texts: list[str] = []
    rows: list[list[float]] = []
    where: list[_Holder] = []
    held: list[str] = []
    linked = words_linked = 0
    heading = False
    at, end = 0, len(page)
    opened: Counter = Counter()
    ends: dict[str, int] = {}
    quiet, depth, inside = "", 0, Counter()  # the silent element around this place, how often it is open, and blocks opened in it

    def flush() -> None:
        nonlocal held, words_linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                n = text.count(" ") + 1
                texts.append(text)
                rows.append([n, min(1.0, words_linked / n), heading])
                where.append(stack[-1])
                stack[-1].plain += 0 if stack[-1].aside else max(0, n - words_linked)
                stack[-1].count += 1
            held, words_linked = [], 0

    def say(raw: str) -> None:
        nonlocal words_linked
        if raw and not quiet:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if linked:
                words_linked += len(text.split())

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        nxt = page[lt + 1 : lt + 2]
        if not (nxt.isascii() and nxt.isalpha()) and nxt not in ("/", "!", "?"):
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m and nxt == "/" and not (page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha()):
            say("<")  # no tag begins or ends here
            at = lt + 1
            continue
        if not m:
            break
        at = m.end()
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            if stop < 0:
                break
            at = stop + 3
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        closed = m["attrs"].endswith("/")
        if quiet and m["close"]:
            if name == quiet:
                depth -= 1
                quiet = quiet if depth else ""
                continue
            if name not in BLOCK or inside[name] or not opened[name]:
                inside[name] -= inside[name] > 0
                continue
            quiet = ""
        elif quiet and name in BLOCK and name != "option" and not any(inside.values()) and not _closes(page, quiet, at, ends):
            quiet = ""  # it never ends: a block does not belong to it
        if quiet and not m["close"] and name not in RAW:
            if not closed:
                depth += name == quiet and name not in ("button", "select")  # these two end where the next one begins
                inside[name] += name in BLOCK and name != "option"
            continue
        if m["close"]:
            opened[name] -= opened[name] > 0
            if name == "a":
                linked = max(0, linked - 1)
            if name in BLOCK:
                flush()
            if name[:1] == "h" and name[1:].isdigit():
                heading = False
            if name in HOLDER and (i := next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)):
                if name == "span" and (stack[i].marks, stack[i].tools) != (stack[i - 1].marks, stack[i - 1].tools):
                    flush()
                del stack[i:]
            continue
        if name in SILENT:
            if not closed and name not in RAW:
                quiet, depth, inside = name, 1, Counter()
            elif not closed:
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                if not stop:
                    break
                at = stop.end()
            if name not in ("script", "style"):
                held.append(" ")
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCK:
            flush()
            linked = 0
            opened[name] += not closed
        if name == "a":
            linked += 1
        if name[:1] == "h" and name[1:].isdigit():
            heading = True
        if name in HOLDER and not closed:
            if name == "body":
                del stack[1:]  # an open head ends here
            holder = _Holder(name, m["attrs"], stack[-1])
            if name != "span" or holder.marks != stack[-1].marks or holder.tools != stack[-1].tools:
                flush()
            stack.append(holder)
            holders.append(holder)
    flush()
    if not rows:
        return [], np.zeros((0, len(FEATURES)))
    # elements come after those that hold them: sums go up in reverse, groups down
    for h in reversed(holders[1:]):
        h.above.plain += h.plain
        h.above.count += h.count
    for h in holders[1:]:
        if h.count < GROUP or h.name in ("body", "span"):
            h.group = h.above.group
    whole = max(1, holders[0].plain)
    own = np.array(rows, np.float64)
    beside = np.concatenate([np.zeros((1, 2)), own[:, :2], np.zeros((1, 2))])
    around = [(h.plain / whole, h.group.plain / whole, h.article.plain / whole if h.article else 0.0, h.aside, h.marks, h.tools) for h in where]
    return texts, np.column_stack([own[:, :2], beside[:-2], beside[2:], np.array(around, np.float64), own[:, 2]])


def _closes(page: str, name: str, at: int, ends: dict[str, int]) -> bool:
    """Whether an end tag of the name follows; ends keeps where the next one is."""
    if ends.get(name, -1) < at:
        m = re.compile(rf"</{re.escape(name)}[\s>]", re.IGNORECASE).search(page, at)
        ends[name] = m.start() if m else len(page)
    return ends[name] < len(page)


class Tree:
    """A binary decision tree grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 18):
        self.share = float(y.mean()) if len(y) else 0.0
        self.feature = -1
        best = len(y) * self.share * (1 - self.share) - 1e-9
        if depth and best > 0:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, f] <= cut
                    a, b = y[low], y[~low]
                    impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                    if impurity < best:
                        best, self.feature, self.cut = impurity, f, float(cut)
        if self.feature >= 0:
            low = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def used(self) -> set[int]:
        """The features that decide anywhere."""
        return set() if self.feature < 0 else {self.feature} | self.low.used() | self.high.used()

    def accepts(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.share > 0.5)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x), bool)
        out[low], out[~low] = self.low.accepts(x[low]), self.high.accepts(x[~low])
        return out


def trained(pages: list[tuple[str, list[str]]] = PAGES, without: tuple[str, ...] = ()) -> Tree:
    """The tree for labelled pages: each with the texts of its blocks that belong to the article. Features named in `without` are not asked."""
    xs, ys = [], []
    for page, wanted in pages:
        texts, x = blocks(page)
        missing = set(wanted) - set(texts)
        if missing:
            raise ValueError(f"labelled blocks that are not in their page: {missing}")
        xs.append(x[x[:, ASIDE] == 0])
        ys.append(np.array([t in wanted for t in texts], np.float64)[x[:, ASIDE] == 0])
    x = np.concatenate(xs)
    x[:, [FEATURES.index(f) for f in without]] = 0
    return Tree(x, np.concatenate(ys))


def main_text(page: str, tree: Tree) -> str:
    texts, x = blocks(page)
    keep = tree.accepts(x) & (x[:, ASIDE] == 0) if texts else []
    return " ".join(t for t, k in zip(texts, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """pages without html_col, with text (the blocks of the article joined by one space, empty if there are none) and n_chars (its code points).

    A null or empty page has an empty text. Columns named text or n_chars are replaced; all others, and repeated rows, stay. A long page is read in whole; no rows give none.
    """
    ship(pages.sparkSession)
    tree = tree or trained()
    kept = [f for f in pages.schema if f.name not in (html_col, "text", "n_chars")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, column=len(kept)):
                texts = [main_text(p or "", tree) for p in b.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in kept), "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string, n_chars bigint"])
    return pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{html_col}`").cast("string").alias("_html")).mapInArrow(of, schema)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
