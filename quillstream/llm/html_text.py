"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path and the kind of region they stand in: the outermost article or main element
around them, or else the nearest container such as a div or section. Per path, text length per node and punctuation per
100 characters are taken, smoothed over neighbouring paths of like regions in page order and multiplied; to that comes the mean text length of its regions, so that titles, short
paragraphs and lists share the weight of the text they belong to. Paths outside article and main elements count a quarter where
a page has such elements. Paths whose score reaches a fifth of the page's greatest are content. The factor for punctuation lies between 1
and 3, so all text of the region that holds the greatest score passes, however short its parts are.

What a page marks as no main text is heeded before: text under menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
reader comments (by element, role, id or class) never counts (``marks=False`` leaves all but scripts, styles and the like to the ratios).
Ties: paths of equal scores pass or fail together.

Blocks are runs of text between block-level tags; character references are decoded, white space inside a block becomes one space,
empty blocks go, and blocks are joined in page order by one line end.

Nulls and damage: null or empty html gives the empty text, unclosed or cut tags are tolerated (text in a tag cut off at the end is markup),
unclosed script, style or comment hides the rest. Null ids and urls stay. Repeated rows get equal texts. An empty table gives an
empty table. The whole page is read. Further columns of the input pass through untouched; ``text`` is replaced if the input has it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？¿¡]")
#: Elements by role in a page: fixed lists of HTML names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
HIDDEN = frozenset("head script style noscript template title textarea iframe object svg math canvas audio video select option button input form nav aside header footer menu dialog".split())
SILENT = HIDDEN - frozenset("form nav aside header footer menu dialog".split())
CONTENT = frozenset("article main".split())
#: Elements that hold a region's text without being a region of their own, besides the inline ones.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre figure figcaption table caption colgroup thead tbody tfoot tr td th details summary address center hr".split())
#: Factor of paths outside article and main elements, greatest factor for punctuation less 1, share of the greatest score that a content path reaches.
OUTSIDE, PUNCTUATED, LEAST = 0.25, 2.0, 0.2
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Words in class, id or role that mark boilerplate.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promoted sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead "
    "comment comments disqus reply replies respond notice notices alert cookie cookies consent gdpr popup modal subscribe newsletter signup share sharing social related recommended toolbar pagination pager widget "
    "contentinfo complementary search login copyright".split()
)
#: Those of them that mark what readers wrote, and first words of class names that say only how a page is laid out.
READERS = frozenset("comment comments disqus reply replies respond".split())
LAYOUT = frozenset("has with no without is hide show js".split())
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")


def marked(attributes: str) -> int:
    """2 if class, id or role name readers' comments, 1 if other boilerplate, else 0."""
    out = 0
    for m in ATTRIBUTE.finditer(attributes):
        for name in html.unescape(m[2] or m[3] or m[4] or "").split():
            words = WORDS.findall(CAMEL.sub(r"\1 \2", name).lower())
            if words and words[0] not in LAYOUT and not BOILERPLATE.isdisjoint(words):
                out = max(out, 1 if READERS.isdisjoint(words) else 2)
    return out


Node = tuple[tuple[tuple[str, ...], bool, int], bool, int, int, str]


def nodes(page: str, marks: bool = True) -> Iterator[Node]:
    """key (path, whether an article or main element holds it, depth of its region), whether it is hidden, region number, block number and decoded
    text, in page order."""
    stack: list[tuple[str, int, bool, tuple[int, int]]] = []  # element, hidden, inside content, region (depth, number)
    block, at, size, number = 0, 0, len(page), 0

    def emit(raw: str):
        _, hidden, inside, region = stack[-1] if stack else ("", 0, False, (0, 0))
        if raw:
            text = " " if raw.isspace() else html.unescape(raw)
            yield (tuple(s[0] for s in stack), inside, region[0]), hidden > 0, region[1], block, text

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            yield from emit(rest)
            return
        yield from emit(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:
            return  # a tag cut off at the end
        name = m[2].lower()
        if name == "br":
            yield from emit(" ")
        if name not in INLINE:
            block += 1
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in VOID or m[3].rstrip().endswith("/") and name not in RAW and name not in CONTENT and name not in CLOSES_P:
            continue
        if name in CLOSES_P:  # an open paragraph ends here, with all in it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        elif name in ("li", "dt", "dd", "td", "th", "tr", "option"):
            ends = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}[name]
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    break
                if stack[k][0] in same:
                    del stack[k:]
                    break
        if name == "body" and stack and stack[-1][0] == "head":
            stack.pop()
        # 3: by its element, 2: by a name that marks comments, 1: by another name; a main element or an article within the last is content again.
        above = stack[-1][1] if stack else 0
        own = marked(m[3]) if marks and m[3] and name not in ("html", "body") else 0
        if name in (HIDDEN if marks else SILENT) and not (name == "header" and any(s[0] in CONTENT for s in stack)):
            own = 3
        if name in CONTENT:
            own = own if own == 2 else 0
            above = 0 if above == 1 or name == "main" and above == 2 else above
        inside, region = (stack[-1][2], stack[-1][3]) if stack else (False, (0, 0))
        if name in CONTENT and not inside or not inside and name not in INLINE and name not in FLOW:
            number += 1
            region = (len(stack) + 1, number)
        stack.append((name, max(above, own), inside or name in CONTENT, region))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                return
            at = end.start()


def smooth(x: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Each value with half the weight on its two neighbours; where one is missing or of another kind, the value stands for it."""
    same = np.concatenate([[False], kind[1:] == kind[:-1], [False]])
    before = np.where(same[:-1], np.roll(x, 1), x)
    after = np.where(same[1:], np.roll(x, -1), x)
    return 0.25 * before + 0.5 * x + 0.25 * after


def content_paths(found: list[Node], least: float = LEAST) -> set[tuple[tuple[str, ...], bool, int]]:
    """The keys of the paths that hold content."""
    stats: dict[tuple, list[float]] = {}
    regions: dict[tuple, set[int]] = {}
    sizes: dict[int, int] = {}
    for key, hidden, region, _, text in found:
        n = 0 if hidden else len(text.strip())
        if n:
            s = stats.setdefault(key, [0, 0, 0])
            s[0] += n
            s[1] += len(PUNCTUATION.findall(text))
            s[2] += 1
            regions.setdefault(key, set()).add(region)
            sizes[region] = sizes.get(region, 0) + n
    if not stats:
        return set()
    keys = list(stats)
    a = np.array([stats[k] for k in keys], dtype=float)
    marks = np.minimum(PUNCTUATED, 100 * a[:, 1] / a[:, 0])
    around = np.array([sum(sizes[r] for r in regions[k]) / len(regions[k]) for k in keys])
    kind = np.array([2 * k[2] + k[1] for k in keys])
    score = smooth(a[:, 0] / a[:, 2], kind) * (1 + smooth(marks, kind)) + around
    inside = np.array([k[1] for k in keys])
    if inside.any():
        score = np.where(inside, score, OUTSIDE * score)
    return {k for k, x in zip(keys, score) if x >= least * score.max()}


def main_text(page: str | None, marks: bool = True) -> str:
    found = list(nodes(page or "", marks))
    keep = content_paths(found)
    # A node of white space alone has no path of its own; it parts the words around it.
    blocks: dict[int, list[str]] = {}
    for key, hidden, _, block, text in found:
        if not hidden and (key in keep or text == " "):
            blocks.setdefault(block, []).append(text)
    out = (SPACE.sub(" ", "".join(parts)).strip() for _, parts in sorted(blocks.items()))
    return "\n".join(b for b in out if b)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without ``column``, with ``text``."""
    rest = [c for c in pages.columns if c not in (column, "text")]
    source = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`"))
    schema = source.drop(column).withColumn("text", F.lit("")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([main_text(x.as_py()) for x in batch.column(len(rest))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], made], names=[*rest, "text"])

    return source.mapInArrow(work, schema)
