"""Main-text extraction from HTML by a decision tree over flat text blocks.

A page is read as a flat run of blocks, cut at block-level tags. Each block is described by its number of words and
link density, those of its two neighbours, and one number for its standing (see Block.standing): what the elements around
it say. A decision tree trained on a small labelled table (see labelled_pages) says which blocks are article text. Nothing
but scripts, styles and the like is cut before the tree.

The names of elements (class, id, role) count only where every word of a name is known to belong to menus, notices, adverts
and so on: "cookie-notice" speaks against a block, "share-price" and "top-story" say nothing.

Defined results: a null or empty page, and one without article text, give an empty string; unclosed and cut-off tags,
comments, scripts and character references are read as far as they go, and a tag cut off by the end is dropped; pages of any length are
read whole; rows are independent, so repeated rows give equal results; columns of the input stay, whatever their
names, except ones named like the outputs, which are replaced.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinlink.llm.workdir import bound_batches

# HTML's elements by role.
BLOCK_TAGS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = "script style noscript template iframe canvas title head".split()
NEVER_MAIN_TAGS = set("nav footer aside form dialog menu button select textarea svg".split())
MAIN_TAGS = set("article main".split())
CUT_TAGS = BLOCK_TAGS | NEVER_MAIN_TAGS

#: Words of names that speak against article text or for it, and ones that say nothing beside them.
AGAINST = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay sidebar widget widgets share sharing social comment comments disqus nav navbar navigation menu breadcrumb breadcrumbs "
    "toolbar footer copyright newsletter subscribe subscription signup login pagination pager complementary contentinfo related recommended".split()
)
HEADER = set("header masthead topbar".split())  # against, but in an article
FOR = set("article content main body post story entry text prose".split())
NEUTRAL = set(
    "area articles bar block bottom box button buttons container global inner item items left link links list more outer page panel posts reader "
    "right row section site slot stories thread title top user wrap wrapper".split()
)

_RAW = "|".join(SKIPPED_TAGS[:-1])
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HINT = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


@dataclass
class Block:
    """standing: 1 in an article or main element or a container named so, -1 in one that never is (menus, forms, ...) or is
    named so, or hidden, else 0; -0.5 for 0 on a page that has an element of standing 1."""

    words: int = 0
    linked: int = 0
    text: str = ""
    standing: float = 0
    label: bool | None = None


@dataclass
class _Element:
    tag: str
    standing: int = 0
    label: bool | None = None


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


@lru_cache(maxsize=4096)
def _named(names: str) -> float:
    """What names, split at white space, say: -1 against, -0.5 a header, 1 for article text. A name counts if all its words are known."""
    found = [0.0]
    for name in names.split():
        words = {w.lower() for w in _HINT.findall(name)}
        for value, known in ((-1.0, AGAINST), (-0.5, HEADER), (1.0, FOR)):
            if words & known and words <= known | NEUTRAL:
                found.append(value)
    return min(found) or max(found)


def _open(tag: str, raw: str, parent: _Element) -> _Element:
    """An element's standing: what it inherits, and what its tag and attributes add."""
    a = _attributes(raw)
    standing = parent.standing
    if standing >= 0 and tag not in ("body", "html"):
        named = _named(" ".join(a.get(k, "") for k in ("class", "id", "role")))
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        heads = not standing and (tag == "header" or named == -0.5)
        if tag in NEVER_MAIN_TAGS or hidden or heads or named == -1:
            standing = -1
        elif tag in MAIN_TAGS or named > 0:
            standing = 1
    return _Element(tag, standing, a["data-main"] == "1" if "data-main" in a else parent.label)


@dataclass
class _Reader:
    """Turns tokens into blocks; unclosed elements end with their closest closed ancestor."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Element] = field(default_factory=lambda: [_Element("")])
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0

    def text(self, piece: str) -> None:
        piece = html_lib.unescape(piece)
        self.parts.append(piece)
        if self.links:
            self.linked += len(piece.split())

    def flush(self) -> None:
        words = "".join(self.parts).split()
        self.parts.clear()
        if words:
            e = self.stack[-1]
            self.blocks.append(Block(len(words), min(self.linked, len(words)), " ".join(words), e.standing, e.label))
        self.linked = 0

    def start(self, tag: str, raw: str) -> None:
        if tag in CUT_TAGS:
            self.flush()
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
                self._close_open(tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS or raw.rstrip().endswith("/"):
            return
        if tag == "a":
            self.links += 1
        elif tag in CUT_TAGS or raw.strip():
            if tag not in ("body", "html"):
                self.stack.append(_open(tag, raw, self.stack[-1]))

    def _close_open(self, tag: str) -> None:
        """A paragraph or item that was left open ends where the next begins."""
        for k in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[k].tag
            if open_tag == tag:
                del self.stack[k:]
                return
            if open_tag in CUT_TAGS:
                return

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
            return
        if tag in CUT_TAGS:
            self.flush()
            self.links = 0
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if tag not in CUT_TAGS and self.stack[k].tag in CUT_TAGS:
                return


def read_blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    reader, at = _Reader(), 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            reader.text(page[at : m.start()])
        at = m.end()
        if m[3]:
            tag = m[3].lower()
            reader.end(tag) if m[2] else reader.start(tag, m[4])
        elif m[1]:
            reader.parts.append(" ")
    reader.text(page[at:])
    reader.flush()
    if any(b.standing > 0 for b in reader.blocks):
        for b in reader.blocks:
            b.standing = b.standing or -0.5
    return reader.blocks


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block: words and link density of itself, the block before and the block behind, and its standing."""
    words = np.array([0, *(b.words for b in blocks), 0], dtype=float)
    density = np.array([1, *(b.linked / b.words for b in blocks), 1], dtype=float)
    standing = np.array([b.standing for b in blocks], dtype=float)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], standing])


@dataclass
class DecisionTree:
    """A binary tree of thresholds; leaves carry the share of article blocks."""

    feature: int = -1
    threshold: float = 0.0
    value: float = 0.0
    low: DecisionTree | None = None
    high: DecisionTree | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> DecisionTree:
        """Greedy splits by Gini impurity; ties go to the first feature and the lowest threshold."""
        share = float(y.mean())
        if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
            return cls(value=share)
        best = (2 * share * (1 - share) * len(y) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            k = k[(k >= least) & (k <= len(y) - least)]
            if not len(k):
                continue
            left, right = c[k - 1] / k, (c[-1] - c[k - 1]) / (len(y) - k)
            cost = 2 * (k * left * (1 - left) + (len(y) - k) * right * (1 - right))
            if cost.min() < best[0]:
                i = int(k[cost.argmin()])
                best = (float(cost.min()), f, float((v[i - 1] + v[i]) / 2))
        _, f, t = best
        if f < 0:
            return cls(value=share)
        low = x[:, f] <= t
        return cls(f, t, share, cls.fit(x[low], y[low], depth - 1, least), cls.fit(x[~low], y[~low], depth - 1, least))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        out, low = np.empty(len(x)), x[:, self.feature] <= self.threshold
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def labelled_pages(pages: int = 400, seed: int = 7) -> list[str]:
    """Small pages whose parts say in data-main whether they are article text.

    A third each has article elements, containers named so, and containers that tell nothing, where only words and links tell.
    """
    rng = random.Random(seed)
    prose = lambda lo, hi: " ".join(rng.choice(("ala", "bor", "cint", "dwel", "erm", "fost")) for _ in range(rng.randint(lo, hi)))
    link = lambda lo, hi: f'<a href="/x">{prose(lo, hi)}</a>'
    part = lambda tag, main, inner: f'<{tag} data-main="{main}">{inner}</{tag}>'
    maybe = lambda share, make: make() if rng.random() < share else ""
    menu = lambda n: "<ul>" + "".join(part("li", 0, link(1, 3)) for _ in range(n)) + "</ul>"

    def body(bare: bool) -> list[str]:
        """The blocks of an article; where nothing around it tells, its short ones stand between long ones."""
        long_ = lambda: part("p", 1, prose(25, 120))
        made = [long_() if bare else part("p", 1, prose(*rng.choice(((1, 4), (8, 30), (30, 120))))) for _ in range(rng.randint(2, 6))]
        for share, make in (
            (0.4, lambda: part("p", 1, f"{prose(15, 40)} {link(1, 4)} {prose(15, 40)}")),
            (0.3, lambda: part("p", 1, f"{prose(0, 4)} {link(6, 14)} {prose(0, 6)}")),
            (0.25, lambda: "<ol>" + "".join(part("li", 1, f"{link(6, 16)} {prose(0, 8)}") for _ in range(rng.randint(2, 5))) + "</ol>"),
            (0.25, lambda: "<ul>" + "".join(part("li", 1, prose(2, 15)) for _ in range(rng.randint(2, 5))) + "</ul>"),
            (0.2, lambda: part("h2", 1, prose(2, 7))),
            (0.2, lambda: part("blockquote", 1, link(10, 40))),
        ):
            if not bare and rng.random() < share or bare and share == 0.4 and rng.random() < share:
                made.insert(rng.randint(1, len(made)), make())
        return made

    made = []
    for k in range(pages):
        layout = k % 3
        say = lambda name, layout=layout: f' class="{name}"' if layout == 1 or layout == 0 and rng.random() < 0.5 else ""
        box = lambda tag, name, inner, layout=layout: (f"<{tag}>{inner}</{tag}>" if layout == 0 else f"<div{say(name)}>{inner}</div>")
        off = lambda lo, hi: part("p", 0, prose(lo, hi))
        inner = body(layout == 2)
        if layout != 2:  # foreign matter within the article
            for share, make in (
                (0.4, lambda: f'<div class="{rng.choice(("ad", "share-bar", "newsletter"))}">{off(3, 60)}</div>'),
                (0.3, lambda: menu(rng.randint(3, 7))),
                (0.3, lambda: box("aside", "sidebar", off(3, 80))),
            ):
                if rng.random() < share:
                    inner.insert(rng.randint(1, len(inner)), make())
            inner.append(maybe(0.3, lambda: f'<div class="comments">{off(3, 80)}{off(3, 60)}</div>'))
        title = f'<h1 data-main="1">{prose(3, 12)}</h1>' if layout == 2 or rng.random() < 0.6 else ""
        sidebar = box("aside", "sidebar", off(4, 80) + menu(3)) if layout != 2 and rng.random() < 0.6 else ""
        before = [
            maybe(0.8, lambda: box("nav", "menu", menu(rng.randint(3, 8)))),
            maybe(0.5, lambda: box("header", "header", off(1, 8))) if layout != 2 else "",
            maybe(0.7, lambda: f'<div class="{rng.choice(("cookie-notice", "ad", "alert"))}">{off(3, 80)}</div>' if layout != 2 else off(3, 10)),
            sidebar if rng.random() < 0.5 else "",
            maybe(0.4, lambda: off(2, 60)) if layout == 0 else "",
        ]
        rng.shuffle(before)
        before = before if rng.random() < 0.8 else []
        made.append(
            "".join(before)
            + (f"<article>{title}{''.join(inner)}</article>" if layout == 0 else f"<div{say('content')}>{title}{''.join(inner)}</div>")
            + (f'<section class="comments">{off(3, 80)}{off(3, 60)}</section>' if layout != 2 and rng.random() < 0.6 else "")
            + ("" if sidebar in before else sidebar)
            + (box("form", "newsletter", off(1, 6)) if layout != 2 and rng.random() < 0.4 else "")
            + maybe(0.8, lambda: box("footer", "footer", off(3, 40) if layout != 2 else off(3, 10)))
        )
    # Some pages are cut off on their way.
    return [p[: rng.randrange(len(p) // 3, len(p))] if rng.random() < 0.25 else p for p in made]


def train_tree() -> DecisionTree:
    """The tree for the labelled table; the same every time."""
    read = [read_blocks(p) for p in labelled_pages()]
    x = np.vstack([features(b) for b in read])
    y = np.array([float(bool(b.label)) for blocks in read for b in blocks])
    return DecisionTree.fit(x, y)


def main_text(page: str | None, tree: DecisionTree) -> str:
    blocks = read_blocks(page)
    if not blocks:
        return ""
    main = tree.predict(features(blocks)) >= 0.5
    return " ".join(b.text for b, m in zip(blocks, main, strict=True) if m)


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (None: all) with text and n_chars (code points) of each page."""
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    tree = train_tree()
    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = [main_text(p, tree) for p in batch.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*kept, "text", "n_chars"],
                )

    # The last column is the page; in Python columns go by place.
    inner = [*(pages[c].alias(f"c{k}") for k, c in enumerate(kept)), pages[html_col].cast("string").alias("page")]
    return bound_batches(pages).select(*inner).mapInArrow(run, schema)


def html_extract_digest(pages: DataFrame) -> DataFrame:
    return extract_text(pages, keep=("page_id", "url"))


#: For pages whose article is an article element of plain paragraphs, as those of the given tables; others are held by tests.
ORACLE = r"""
WITH found AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)(</article>|<footer|$)', 1, 's') AS t FROM pages
), bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(t, '<!--.*?-->', '', 'gs'),
    '</?(a|b|em|i|span|strong)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM found
), decoded AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
    '&nbsp;', ' '), '&amp;?', '&', 'g') AS t FROM bare
), flat AS (
  SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM flat
"""
