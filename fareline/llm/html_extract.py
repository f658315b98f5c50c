"""Main text of web pages by consensus host paths.

Every page is read into containers (the elements that hold blocks of text). A container's score
grows with the words in its blocks and falls with links and with names that mark boilerplate. The
best container of each page votes, with the root of its score, for its generalised path: the tags
from the body down with their class names, digits cut off. The votes are summed per host in Spark, and each
page is extracted again from the containers with the host's winning path; a page that has none
uses its own best container.

Defined results: null or empty html, and pages without any text outside of boilerplate, give the
empty text; pages with a null or odd url form a host of their own; repeated rows give repeated
results; other columns are not looked at.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareline.session import localised, written

#: Elements whose content is no markup and no text of the page. Fixed values of HTML.
RAW = frozenset("script style iframe textarea title".split())
RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Elements that begin and end a block of text. Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold others; the rest are text themselves.
HOLDERS = BLOCKS - frozenset("p html h1 h2 h3 h4 h5 h6 hr".split())
#: Elements that end an open paragraph. A cell, item or paragraph also ends one of its own kind.
ENDS_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"},
               "th": {"tr"}, "option": {"select"}}
#: Elements that are boilerplate by their kind, and those whose content is not shown as text.
ASIDE = frozenset(
    "nav footer aside form menu dialog button select input label fieldset header "
    "svg canvas object template noscript".split()
)
#: Drawings and formulas that a block ends, wherever their own end is.
FOREIGN = ("svg", "math")
#: Words of class names and ids that mark boilerplate: menus, notices, adverts, comments and such.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus "
    "dropdown footer gdpr header hidden login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup popover promo promoted promotion "
    "recommended related reply replies respond responses search share sharing shoutbox sidebar side "
    "signup skip social sponsor sponsored subscribe subscription tags toc toolbar tracking "
    "trending widget widgets".split()
)
#: Marks that name a part of a page. On a paragraph, a heading or words in a line they are no more
#: than a style.
PARTS = frozenset(
    "breadcrumb breadcrumbs comment comments discussion footer header masthead menu nav navigation "
    "notice notices pager related reply replies respond responses search side sidebar tags toc".split()
)
#: Words that go with a mark and leave it one ("site-header", "related-posts").
COMPANIONS = frozenset(
    "above area article articles bar bottom box block button buttons container content entry first "
    "form global group head holder inner item items left link links list main message module page "
    "panel policy post posts reader right row section secondary site story stories top unit user "
    "wrap wrapper zone".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split()
)
#: A comment, a tag with its attributes, or a declaration. A quote begins a value only after "=".
TOKENS = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)"
    r"((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>][^\s<>]*+)?+)*+)(>|(?=<)|$)"
    r"|<[!?][^>]*(?:>|$)",
    re.S,
)
ATTRIBUTES = re.compile(
    r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?"
)
WORDS = re.compile(r"[a-z]+")


def attributes(text: str) -> dict[str, str]:
    # Only these say anything about the content.
    if not any(name in text for name in ("class", "id", "role", "hidden", "style")):
        return {}
    found = ATTRIBUTES.finditer(text)
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in found}


def is_boilerplate(tag: str, given: dict[str, str]) -> bool:
    if tag in ASIDE:
        return True
    if not given:
        return False
    if "hidden" in given or given.get("aria-hidden") == "true":
        return True
    if given.get("role", "").lower() in ROLES:
        return True
    if "display:none" in given.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    named = f"{given.get('class', '')} {given.get('id', '')}"
    return any(marks(tag, name) for name in named.split())


def marks(tag: str, name: str) -> bool:
    """Whether a class name or id marks boilerplate: a mark by itself, or with companions only, as
    other words ("related-work") make it the name of something else."""
    # Names are split at signs and at changes from small to capital letters.
    words = WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
    marked = [word for word in words if word in MARKS]
    if tag not in HOLDERS:
        marked = [word for word in marked if word not in PARTS]
    return bool(marked) and all(word in MARKS or word in COMPANIONS for word in words)


def step(tag: str, given: dict[str, str]) -> str:
    """One step of a generalised path: the tag and its class names without digits."""
    if "class" not in given:
        return tag
    names = sorted({re.sub(r"[^a-z]+", "", c) for c in given.get("class", "").lower().split()} - {""})
    return ".".join([tag, *names])


ROOT_KEY = 0


def key_of(above: int, name: str) -> int:
    """Key of a path from the key of the path above it and its last step."""
    return xxhash.xxh64_intdigest(f"{above}/{name}")


@dataclass
class Container:
    tag: str
    #: Last step of the generalised path, and a key of the whole path.
    step: str
    key: int
    parent: int


@dataclass
class Page:
    containers: list[Container]
    #: Text, container, characters within links and whether it is boilerplate, in page order.
    blocks: list[tuple[str, int, int, bool]]

    def path(self, container: int) -> str:
        steps = []
        while container > 0:
            steps.append(self.containers[container].step)
            container = self.containers[container].parent
        return "/".join(reversed(steps))


class Reader:
    """Open elements while a page is read. For each tag the places of its open elements are known, so
    no tag searches the stack, however deep it is."""

    def __init__(self):
        self.page = Page([Container("", "", ROOT_KEY, -1)], [])
        #: Tag, container, boilerplate.
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]
        self.places: dict[str, list[int]] = {}
        self.open_blocks: list[int] = []
        self.parts: list[str] = []
        self.linked = self.links = self.aside = self.hidden = 0

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag; 0 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def text(self, text: str) -> None:
        """Text of the open block; that of boilerplate within a line goes."""
        if self.hidden:
            return
        self.parts.append(text)
        if self.links:
            self.linked += len(text)

    def flush(self) -> None:
        if self.parts:
            text = "".join(self.parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            self.parts.clear()
            if text:
                self.page.blocks.append((text, self.stack[-1][1], self.linked, self.aside > 0))
        self.linked = 0

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, _, marked = self.stack[-1]
            if tag in BLOCKS:
                self.flush()
                self.open_blocks.pop()
            self.stack.pop()
            self.places[tag].pop()
            self.aside -= marked
            self.hidden -= marked and tag not in BLOCKS
            self.links -= tag == "a"

    def end(self, tag: str) -> None:
        depth = self.last(tag)
        if depth:
            self.close(depth)
        elif tag == "p":
            self.flush()

    def start(self, tag: str, raw: str) -> None:
        given = attributes(raw)
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCKS:
            foreign = min((p for p in map(self.last, FOREIGN) if p), default=0)
            if foreign:
                self.close(foreign)
            self.flush()
            # A block ends an open paragraph; inline elements left open in it end with it.
            opened = self.open_blocks[-1] if self.open_blocks else 0
            if opened and self.stack[opened][0] == "p":
                self.close(opened)
            if tag in ENDS_ITSELF:
                own = self.last(tag)
                if own and own > max(self.last(scope) for scope in ENDS_ITSELF[tag]):
                    self.close(own)
        if raw.rstrip().endswith("/") and tag not in BLOCKS:
            return
        in_article = self.last("article") or self.last("main")
        marked = is_boilerplate(tag, given) and not (tag == "header" and in_article)
        self.aside += marked
        self.hidden += marked and tag not in BLOCKS
        self.links += tag == "a"
        container = self.stack[-1][1]
        if tag in HOLDERS:
            name = step(tag, given)
            key = key_of(self.page.containers[container].key, name)
            self.page.containers.append(Container(tag, name, key, container))
            container = len(self.page.containers) - 1
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.open_blocks.append(len(self.stack))
        self.stack.append((tag, container, marked))


def read_page(source: str) -> Page:
    """Containers and blocks of a page. Open elements may lack their end, ends may lack a start."""
    reader = Reader()
    at, size = 0, len(source)
    while at < size:
        found = TOKENS.search(source, at)
        text = source[at : found.start() if found else size]
        if text:
            reader.text(text)
        if not found:
            break
        at = max(found.end(), found.start() + 1)
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            reader.end(tag)
        elif tag in RAW:
            end = RAW_ENDS[tag].search(source, at)
            at = end.end() if end else size
        else:
            reader.start(tag, found[3])
    reader.close(1)
    reader.flush()
    return reader.page


def scores(page: Page) -> list[float]:
    """A container's score: words of its own blocks, half of what its children score, less what
    stands in links; an article or main element counts twice."""
    own = [0.0] * len(page.containers)
    for text, container, linked, aside in page.blocks:
        if not aside:
            words = text.count(" ") + 1
            own[container] += words * (1 - 2 * min(1.0, linked / len(text)))
    for k in range(len(own) - 1, 0, -1):
        tag = page.containers[k].tag
        if tag in ("article", "main"):
            own[k] = 2 * own[k] + 1
        parent = page.containers[k].parent
        # Lists, tables and quotations are parts of what they stand in.
        inner = tag in ("ul", "ol", "li", "blockquote", "table", "tbody", "thead", "tr", "td", "th",
                        "dl", "dd", "dt", "figure", "figcaption", "pre", "details")
        own[parent] += own[k] * (1.0 if inner else 0.5)
    return own


def best_path(page: Page) -> tuple[str, float]:
    found = scores(page)
    best = max(range(len(found)), key=lambda k: (found[k], -k))
    return (page.path(best), found[best]) if found[best] > 0 else ("", 0.0)


def extracted(page: Page, path: str | None) -> str:
    """Blocks within the containers with the path, without boilerplate; else of the best path."""
    for wanted in (path, best_path(page)[0]):
        if wanted is None:
            continue
        key = ROOT_KEY
        for name in wanted.split("/") if wanted else []:
            key = key_of(key, name)
        inside = [False] * len(page.containers)
        for k, container in enumerate(page.containers):
            inside[k] = container.key == key or (
                container.parent >= 0 and inside[container.parent]
            )
        found = [t for t, container, _, aside in page.blocks if inside[container] and not aside]
        if found:
            return "\n\n".join(found)
    return ""


def host_of(url: str) -> F.Column:
    host = F.regexp_extract(F.col(url), r"^[^:/?#]*://([^/?#]*)", 1)
    return F.lower(F.coalesce(host, F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """``host`` and ``path``: the path with the largest sum of scores over the host's pages."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], list[float]] = {}
            for host, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
            ):
                path, score = best_path(read_page(text or ""))
                if score > 0:
                    # The root of the score, so that one long page can't outvote the others.
                    total = votes.setdefault((host, path), [0.0, 0.0])
                    total[0] += 1.0
                    total[1] += math.sqrt(score)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in votes], pa.string()),
                    pa.array([p for _, p in votes], pa.string()),
                    pa.array([n for n, _ in votes.values()], pa.float64()),
                    pa.array([s for _, s in votes.values()], pa.float64()),
                ],
                ["host", "path", "pages", "score"],
            )

    votes = pages.select(host_of(url).alias("host"), F.col(source).alias("html"))
    votes = votes.mapInArrow(vote, "host string, path string, pages double, score double")
    votes = votes.groupBy("host", "path").agg(
        F.round(F.sum("score"), 3).alias("score"), F.sum("pages").alias("pages")
    )
    best = F.max(F.struct("score", "pages", "path"))
    return votes.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("path"))


def extract(
    pages: DataFrame, id_column: str = "page_id", url: str = "url", source: str = "html"
) -> DataFrame:
    """Per page: id, url, ``text`` and ``n_chars``, and the ``path`` of its host."""
    winners = localised(written(host_paths(pages, url, source), "paths"))
    rows = pages.select(
        F.col(id_column).alias("id"),
        F.col(url).alias("url"),
        F.col(source).alias("html"),
        host_of(url).alias("host"),
    )
    rows = rows.join(winners, "host", "left")

    def extract_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = [
                    extracted(read_page(text or ""), path)
                    for text, path in zip(
                        part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True
                    )
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), part.column(3)],
                    ["id", "url", "text", "path"],
                )

    rows = rows.select("id", "url", "html", "path")
    fields = [rows.schema["id"], rows.schema["url"]]
    fields += [T.StructField("text", T.StringType()), T.StructField("path", T.StringType())]
    found = rows.mapInArrow(extract_batch, T.StructType(fields))
    return found.select(
        F.col("id").alias(id_column),
        F.col("url").alias(url),
        "text",
        F.length("text").cast("long").alias("n_chars"),
        "path",
    )
