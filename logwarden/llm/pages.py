"""HTML extraction with a site style tree (operator 3)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from logwarden.llm.common import text_slices
from logwarden.session import cut_lineage

# Elements of HTML by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
NEVER_TEXT = frozenset("applet audio button canvas datalist dialog embed form frame frameset head iframe input map menu noframes noscript object "
                       "optgroup option script select style svg template textarea title video".split())
BOILERPLATE = frozenset("aside footer nav".split())
MAIN = frozenset("article main".split())
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hgroup hr main menu nav ol p pre section table ul".split())
#: What a new element ends if it is still open, up to the nearest of the second set.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
        "th": ("td th", "tr table"), "option": ("option", "select"), "body": ("head", "html"),
        "tbody": ("thead tbody tfoot tr td th", "table"), "thead": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}

# Words of class names and ids, and roles, that mark menus, adverts, notices, sidebars and comments.
NOISE_WORDS = frozenset("ad ads adsense advert advertisement advertisements adverts aside banner breadcrumb breadcrumbs byline-share comment commentlist comments "
                        "consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination popup "
                        "promo promoted promotion recommended related replies reply respond search share sharebar sharing sidebar signup skip social sponsor "
                        "sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
HEADER_WORDS = frozenset("header masthead".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())

#: Elements that hold text itself; the style tree decides on the containers around them.
TEXTUAL = "blockquote|caption|code|dd|dt|figcaption|h[1-6]|li|p|pre|q|td|th|tr"

NAME = re.compile(r"[a-z]+")
SEPARATOR = ">"
MOST_BROADCAST = 16_000_000  # characters
IN_MAIN = re.compile("(^|>)(article|main|[^>]*\\[main\\])(\\.[^>]*)?>")


@dataclass(frozen=True)
class StyleTree:
    """A branch of a site's tree goes if its importance is below ``least`` and at least ``pages`` pages of the host have it.
    ``gamma`` weighs the content below a node against the variety of its presentation."""

    least: float = 0.35
    pages: int = 4
    gamma: float = 0.9


class Page(HTMLParser):
    """Blocks of text with the style path they lie in: the labels of the block elements around them.

    A label is the element's name with the words of its classes, id and role.  Unclosed elements
    are closed as HTML prescribes for paragraphs, list items and table parts, or with their parent.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, int]] = []  # element, style path, what it is to text
        self.blocks: list[tuple[str, int, str]] = []
        self.children: dict[str, list[str]] = {}
        self.paths: set[str] = set()
        self.text: list[str] = []

    KEPT, MAIN, NOISE, HIDDEN = 0, 1, 2, 3

    def flush(self) -> None:
        words = "".join(self.text).split()
        self.text = []
        if words:
            path, kind = self.open[-1][1:] if self.open else ("", self.KEPT)
            self.blocks.append((path, kind, " ".join(words)))

    def close_to(self, n: int) -> None:
        self.flush()
        del self.open[n:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag not in ("wbr", "img"):
                self.flush()
            return
        if tag in INLINE and not any(k in ("class", "id", "role", "hidden", "style") for k, _ in attrs):
            return
        self.flush()
        names = [t for t, *_ in self.open]
        if tag in P_ENDS and "p" in names:
            self.close_to(len(names) - 1 - names[::-1].index("p"))
        elif tag in ENDS:
            ends, stops = ENDS[tag]
            for i in range(len(names) - 1, -1, -1):
                if names[i] in stops:
                    break
                if names[i] in ends:
                    self.close_to(i)
                    break
        self.push(tag, dict(attrs))

    def push(self, tag: str, attrs: dict[str, str | None]) -> None:
        parent, kind = self.open[-1][1:] if self.open else ("", self.KEPT)
        words = sorted(set(NAME.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower())))
        role = (attrs.get("role") or "").lower()
        label = ".".join([tag, *words, *([f"[{role}]"] if role else [])])
        path = f"{parent}{SEPARATOR}{label}" if parent else label
        inside = kind == self.MAIN
        if kind != self.HIDDEN:
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
            noise = (tag in BOILERPLATE or role in NOISE_ROLES or not NOISE_WORDS.isdisjoint(words) and tag not in ("html", "body")
                     or not inside and (tag == "header" or not HEADER_WORDS.isdisjoint(words) and tag not in ("html", "body")))
            if tag in NEVER_TEXT or hidden and tag not in ("html", "body"):
                kind = self.HIDDEN
            elif noise:
                kind = self.NOISE
            elif kind == self.KEPT and (tag in MAIN or role == "main"):
                kind = self.MAIN
        below = self.children.setdefault(parent, [])
        if label not in below:
            below.append(label)
        self.paths.add(path)
        self.open.append((tag, path, kind))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            self.flush()
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.close_to(i)
                return
            if self.open[i][0] in ("article", "main", "body") and tag in ("p", "div", "span", "li", "section"):
                return  # a stray end inside

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def read(html: str) -> Page:
    page = Page()
    page.feed(html)
    page.close()
    page.close_to(0)
    return page


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def tree_rows(pages: DataFrame, html: str, url: str) -> DataFrame:
    """(host, page, path, kind, value): per page its style nodes, what each presents (its kinds of children) and the texts it contains.

    ``page`` is a hash of the page's texts and their paths, which its copies share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in text_slices(b, 1)):
            rows, prints, paths, kinds, values = [], [], [], [], []
            for n, page in enumerate(batch.column(1).to_pylist()):
                seen = read(page or "")
                found = {(path, "children", ",".join(labels)) for path, labels in seen.children.items()}
                found |= {(path, "text", text) for path, kind, text in seen.blocks if kind != Page.HIDDEN}
                found |= {(path, "node", "") for path in seen.paths | {path for path, *_ in seen.blocks}}
                own = "\0".join(f"{path}\1{text}" for path, kind, text in seen.blocks if kind != Page.HIDDEN)
                own = xxhash.xxh3_64_intdigest(own.encode("utf-8", "surrogatepass")) - 2**63
                for path, kind, value in sorted(found):
                    rows.append(n)
                    prints.append(own)
                    paths.append(path)
                    kinds.append(kind)
                    values.append(xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - 2**63)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(prints, pa.int64()), pa.array(paths, pa.string()), pa.array(kinds, pa.string()),
                                              pa.array(values, pa.int64())], names=["host", "page", "path", "kind", "value"])

    return pages.select(host(F.col(url)).alias("host"), F.col(html).cast("string").alias("html")).mapInArrow(run, "host string, page long, path string, kind string, value long")


def importance(pages: DataFrame, p: StyleTree = StyleTree(), html: str = "html", url: str = "url") -> DataFrame:
    """(host, path, m, score): importance of every node of every host's style tree, from 0 (the same on all pages) to 1.

    With m pages having a node, a text that c of them have there has entropy log c / log m. The
    content of a branch counts 1 less the mean entropy of the different texts in it, its
    presentation the entropy of its kinds of children over the pages.  Pages with the same texts count once.
    """
    counts = tree_rows(pages, html, url).distinct().groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts, "page-counts")
    nodes = counts.where("kind = 'node'").select("host", "path", F.col("n").alias("m"))
    shape = counts.where("kind = 'children'").groupBy("host", "path").agg(F.sum("n").alias("seen"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    presented = F.when(F.col("seen") > 1, (F.log("seen") - F.col("nlogn") / F.col("seen")) / F.log("seen")).otherwise(1.0)
    leaf = counts.where("kind = 'text'").groupBy("host", "path").agg(F.sum(F.log("n")).alias("logs"), F.count("*").alias("texts"))
    parts = F.split("path", SEPARATOR)
    above = leaf.select("host", "logs", "texts", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(
        F.slice(parts, F.lit(1), i), SEPARATOR))).alias("path"))
    content = above.groupBy("host", "path").agg(F.sum("logs").alias("logs"), F.sum("texts").alias("texts"))
    both = (content.join(nodes, ["host", "path"]).join(shape.select("host", "path", presented.alias("presented")), ["host", "path"], "left"))
    meaning = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - F.col("logs") / F.col("texts") / F.log("m"))).otherwise(1.0)
    # A leaf presents nothing but its texts.
    score = F.when(F.col("presented").isNull(), meaning).otherwise((1 - p.gamma) * F.col("presented") + p.gamma * meaning)
    return both.select("host", "path", "m", score.alias("score"))


@F.arrow_udf(StringType())
def main_text(htmls: pa.Array, cut: pa.Array) -> pa.Array:
    """Text of each page without noise elements and without the branches under the given paths; of its main element if it has one."""
    out = []
    for html, noise in zip(htmls.to_pylist(), cut.to_pylist()):
        page = read(html or "")
        fine = [b for b in page.blocks if b[1] in (Page.KEPT, Page.MAIN)]
        if any(kind == Page.MAIN for _, kind, _ in fine):
            fine = [b for b in fine if b[1] == Page.MAIN]
            noise = [n for n in noise or () if IN_MAIN.search(n)]
        under = tuple(n + SEPARATOR for n in noise or ())
        fine = [b for b in fine if not (b[0] + SEPARATOR).startswith(under)] or fine
        out.append(" ".join(text for *_, text in fine))
    return pa.array(out, pa.string())


def extract(pages: DataFrame, p: StyleTree = StyleTree(), html: str = "html", url: str = "url", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader comments that bear such names
    go, and of a page with a main element what is outside it.  Then the branches go that are of low
    importance in the style tree of the page's host, unless nothing would be left; paragraphs and the like go
    with their containers only.  References are decoded, white space in a block is one space, and blocks are joined by one
    space.  Null and empty pages give the empty text; pages without a readable url form one site.  Every
    row stays with its other columns.
    """
    low = importance(pages, p, html, url).where((F.col("score") < p.least) & (F.col("m") >= p.pages))
    low = low.where(~F.col("path").rlike(f"(^|{SEPARATOR})({TEXTUAL}|article|body|html|main)(\\.[^{SEPARATOR}]*)?$"))
    noise = cut_lineage(low.groupBy(F.col("host").alias("__host")).agg(F.collect_set("path").alias("__noise")), "page-noise")
    # The list of all sites is broadcast if its text was measured to be small.
    size = noise.agg(F.sum(F.length(F.array_join("__noise", "")) + F.length("__host") + 100)).first()[0] or 0
    named = pages.withColumn("__of", host(F.col(url))).join(F.broadcast(noise) if size <= MOST_BROADCAST else noise, F.col("__of") == F.col("__host"), "left")
    return named.withColumn(into, main_text(F.col(html).cast("string"), F.col("__noise"))).drop("__of", "__host", "__noise")
