"""Main-text extraction by tag-path ratios.

A page's text blocks carry the path of tags from the root. Per path the length of text, of linked text and the punctuation
are summed; the ratios are smoothed with the paths of neighbouring blocks and fused into one weight. The weights
decide on every page: they give the region, the deepest container path that holds REGION of the page's weight, and the
threshold over which a path counts as content wherever it stands; within the region short unlinked paths (headings, list
items) are content as well. An article or main element is one feature: where a page has one, paths outside of it count
OUTSIDE of their weight. Elements that hold navigation, notices, adverts, forms or comments by their tag, role or class are
left out beforehand.

Null html counts as empty; a page without content gives an empty text; every page gives one row, repeated rows and null ids
too; an empty table gives none; other columns are not read. Whole pages are read, in time in proportion to their length,
however deep their elements nest.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template head title nav footer aside form iframe svg canvas button select option textarea dialog menu object audio video".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu|breadcrumbs?|sidebar|side|footer|foot|masthead|comments?|commentlist|disqus|replies|respond|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|share|social|related|widget|login|signup|skip|pagination|pager|toolbar|copyright|legal|disclaimer)(?:$|[\s_-])")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES_P = BLOCK
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?:$|[\s_-])")
REGION, OUTSIDE, SHARE = 0.75, 0.25, 0.15
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
SPACE = re.compile(r"\s+")
PUNCT = re.compile(r"[.,;:!?]")


class Blocks(HTMLParser):
    """Collects (path, text, linked characters) for each block of a page; paths are numbers in a tree of tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, whether it is left out, path
        self.open: Counter[str] = Counter()
        self.out, self.buf, self.linked = [], [], 0
        self.tags, self.parents, self.inside, self.children = [""], [0], [False], {}

    def skipping(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def path(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def below(self, path: int, tag: str) -> int:
        got = self.children.get((path, tag))
        if got is None:
            got = self.children[path, tag] = len(self.tags)
            self.tags.append(tag)
            self.parents.append(path)
            self.inside.append(self.inside[path] or tag in ("article", "main"))
        return got

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.buf)).strip()
        if text:
            self.out.append((self.path(), text, self.linked))
        self.buf, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "wbr", "hr", "img", "input"):
                self.flush() if tag == "hr" else self.buf.append("" if tag == "wbr" else " ")
            return
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P:
                self.pop("p", {"article", "section", "div", "body", "main", "li", "td", "blockquote"})
            if tag in ("li", "dd", "dt", "td", "th", "tr"):
                self.pop(tag, {"ul", "ol", "dl", "table"})
        a = {k: (v or "") for k, v in attrs}
        named = f"{a.get('class', '')} {a.get('id', '')}".lower()
        skip = tag in SKIP or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES
        skip = skip or bool((READERS if tag in ("article", "main") else NOISE).search(named)) and tag not in ("body", "html")
        skip = skip or tag == "header" and not self.inside[self.path()]
        skip = skip or "display:none" in a.get("style", "").replace(" ", "").lower()
        path = self.path()
        self.stack.append((tag, skip or self.skipping(), self.below(path, tag) if tag in BLOCK else path))
        self.open[tag] += 1

    def cut(self, i: int) -> None:
        self.open.subtract(t for t, _, _ in self.stack[i:])
        del self.stack[i:]

    def pop(self, tag, until) -> None:
        if self.open[tag] > 0:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self.flush()
                    return self.cut(i)
                if self.stack[i][0] in until:
                    return None
        return None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        if self.open[tag] > 0:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    return self.cut(i)
        return None

    def handle_data(self, data):
        if not self.skipping():
            self.buf.append(data)
            if self.open["a"] > 0:
                self.linked += len(data.strip())


def content_paths(page: Blocks, window: int = 1) -> set[int]:
    """The paths that hold the page's content."""
    blocks = page.out
    size, linked, marks, count = (defaultdict(float) for _ in range(4))
    for path, text, link in blocks:
        size[path] += len(text)
        linked[path] += min(link, len(text))
        marks[path] += len(PUNCT.findall(text))
        count[path] += 1
    fused = {x: (size[x] - linked[x]) / count[x] * (1 + marks[x] / count[x]) for x in size}
    raw = [fused[b[0]] for b in blocks]
    near: dict[int, list[float]] = defaultdict(list)
    for i, b in enumerate(blocks):
        own = raw[max(0, i - window) : i + window + 1]
        near[b[0]].append(sum(own) / len(own))
    parted = any(page.inside[x] for x in size)
    level = {x: max(fused[x], sum(v) / len(v)) * (OUTSIDE if parted and not page.inside[x] else 1.0) for x, v in near.items()}
    mass = [0.0] * len(page.tags)
    for x in size:
        mass[x] = level[x] * (size[x] - linked[x])
    under: dict[int, list[int]] = defaultdict(list)
    for x in range(len(page.tags) - 1, 0, -1):  # a path comes after its parent
        mass[page.parents[x]] += mass[x]
        under[page.parents[x]].append(x)
    region = 0
    while heavy := [x for x in under[region] if page.tags[x] in CONTAINERS and mass[x] >= REGION * mass[0] > 0]:
        region = heavy[0]
    within = [False] * len(page.tags)
    for x in range(len(page.tags)):
        within[x] = x == region or x > 0 and within[page.parents[x]]
    top = max(level.values(), default=0.0)
    plain = {x: linked[x] <= 0.5 * size[x] for x in size}
    return {x for x in level if level[x] >= SHARE * top > 0 and (plain[x] or page.inside[x]) or within[x] and plain[x]}


def extract(html: str | None) -> str:
    """The content blocks of one page, joined by two line feeds."""
    p = Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    keep = content_paths(p)
    return "\n\n".join(text for path, text, _ in p.out if path in keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The id, url, text and its length of each page."""

    def each(batches):
        for b in batches:
            text = pa.array([extract(h) for h in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], names=[id_col, "url", "text"])

    kind = dict(pages.dtypes)[id_col]
    out = pages.select(id_col, "url", "html").mapInArrow(each, f"`{id_col}` {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
