"""Main text of web pages by site style trees.

All pages of a host are merged into one tree whose nodes are style paths: an element's tag and class
below those of its parents, to any depth. A presentation node's importance is the entropy of the
layouts (sequences of children) that its pages show there; a content node's is one less the
concentration of its texts over the pages, so a text that stands on every page counts nothing and
one of a single page counts fully. A branch's importance is the mean of its texts' nodes, combined
with the mean of its layouts. Branches of low importance are cut from each page of the host, if
enough pages show them. An article or main element, where a page has one, is the page's main branch:
it is not cut itself, and branches within it are cut only if they count next to nothing while the
main branch as a whole differs from page to page. What is boilerplate by its tag goes on any page. A
word of a class, id or role that tells boilerplate, and a form or page header, is a reason to leave
a block element out, but no more: not if all of the page's main branch is in it, and if it holds most
of the page's text only if the word tells what readers or advertisers added.

Only counts leave the pages: they are summed for each host, path and text before and after they are
shuffled, so a host with very many pages costs no more than its distinct texts. The cut paths of a
host come back to its pages by broadcast if they were counted to be few, else by a join that Spark
splits for large hosts. Each page is read once for its counts and once for its text.

Defined results: a null html gives an empty text; a null or unreadable url is a host of its own;
character references are decoded, white space in a block is one space, blocks are joined by one
line feed; repeated rows each count as a page and keep their row; input columns stay, except those
named as the output; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, durable, in_batches, slices

#: Pages of a host that have to show a branch before it can be cut, and the importance below which
#: it is; what the layouts of a branch weigh against its texts.
MIN_PAGES, LEAST_IMPORTANCE, LAYOUT_WEIGHT = 5, 0.3, 0.1
#: Within a main branch: the importance below which a branch is cut, if the main branch's is above the other.
LEAST_WITHIN, MAIN_IMPORTANCE = 0.1, 0.5
#: Rows, and bytes of html, that are read before they go back to Spark.
SLICE, SLICE_BYTES = 512, 2 << 20

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/><]*)([^>]*)(?:>|\Z)|[^<]+|<", re.DOTALL
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)

# Tags of HTML by what they mean for the text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
DROPPED = set(
    "script style noscript template head title nav footer aside button select textarea input iframe svg math canvas object menu dialog audio video map search option optgroup".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "title", "option", "optgroup", "legend"}
#: Parts of class, id and role names that mark boilerplate.
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist consent contentinfo cookie cookies copyright disqus "
    "footer masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
    "related respond reply replies share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Of these, parts that tell what readers or advertisers added, whatever its length.
ADDED = set(
    "ad ads advert adverts advertisement advertising adsense captcha comment comments commentlist consent cookie cookies disqus menu nav navbar navigation newsletter "
    "pagination popup reply replies respond sponsor sponsored subscribe subscription".split()
)
#: Parts of names that say something of the page around an element, or of what it is filed under, and not what it is.
ASIDE_WORDS = set("no not non with without has have open closed enabled disabled layout".split())
FILED = set("tag category cat topic term author type format status".split())
#: Tags that hold a page or its main branch, whatever they are named.
PLAIN = set("html body main article".split())
SOFT = {"form"}
#: Tags whose attributes are read.
JUDGED = BLOCKS | {"span", "ins"}
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
SPACES = re.compile(r"\s+")


class Element:
    """An open element: its style path, whether it is dropped by tag or cut by the tree, the path of the
    main branch it is in (0 for none), how far its name tells boilerplate (0 to 2), the nearest such
    element from itself upwards, and the paths of its children."""

    __slots__ = ("children", "dropped", "main", "named", "parent", "path", "soft", "tag")

    def __init__(self, tag: str, parent: Element | None, path: int, dropped: bool, main: int, soft: int = 0) -> None:
        self.tag, self.parent, self.path, self.dropped, self.main, self.soft = tag, parent, path, dropped, main, soft
        self.named: Element | None = self if soft else parent.named if parent else None
        self.children: list[int] = []

    def reasons(self) -> Iterator[Element]:
        """The elements from this one upwards whose names tell boilerplate."""
        e = self.named
        while e is not None:
            yield e
            e = e.parent.named if e.parent else None


def parts(value: str) -> set[str]:
    return {x.lower() for x in NAME.findall(value)}


class Reader:
    """Reads pages into blocks. Elements of equal parent, tag and attributes share what is known of them."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[int, bool, int, int]] = {}

    def child(self, parent: Element, tag: str, attributes: str) -> Element:
        told = attributes if tag in JUDGED else ""
        key = (parent.path, parent.dropped, parent.main, tag, told if len(told) < 200 else xxhash.xxh128_digest(told))
        got = self.known.get(key)
        if got is None:
            got = self.judged(parent, tag, told)
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = got
        return Element(tag, parent, *got)

    @staticmethod
    def judged(parent: Element, tag: str, attributes: str) -> tuple[int, bool, int, int]:
        dropped, article, style, soft = parent.dropped or tag in DROPPED, parent.main != 0, "", int(tag in SOFT)
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "class":
                style = " ".join(sorted(value.split()))
            if name in ("class", "id", "role"):
                for token in value.split():
                    names = parts(token)
                    if names & ASIDE_WORDS or NAME.match(token) and NAME.match(token)[0].lower() in FILED:
                        continue
                    if names & BOILERPLATE or ("header" in names and not article and tag not in ("h1", "h2", "h3")):
                        soft = max(soft, 1 + bool(names & ADDED))
                article |= name == "role" and value == "main"
            dropped |= (name == "hidden") or (name == "aria-hidden" and value == "true")
            article |= name == "itemprop" and value == "articleBody"
        if tag == "header" and not article:
            soft = 2
        article |= tag in ("article", "main")
        if tag in PLAIN:
            soft = 0
        elif tag not in BLOCKS:  # holds no other block
            dropped, soft = dropped or soft > 0, 0
        path = xxhash.xxh64_intdigest(f"{parent.path} {tag} {style}") >> 1
        return path, dropped, parent.main or (path if article else 0), soft

    @staticmethod
    def settle(found: list[tuple[Element, str]], nodes: list[Element]) -> None:
        """Drop what is boilerplate by its name, now that the whole page has been read: an element so named that
        doesn't hold all of the main branch, nor, named in the weaker way, most of the text (within the main
        branch, three quarters, and no form). If then nothing is left of the main branch, what stands below the fewest of such elements is."""
        live = [(e, len(t)) for e, t in found if not e.dropped]
        live = [x for x in live if x[0].main] or live
        total, blocks, size, count = sum(n for _, n in live), len(live), {}, {}
        for e, n in live:
            for r in e.reasons():
                size[r], count[r] = size.get(r, 0) + n, count.get(r, 0) + 1
        mains = any(e.main for e, _ in live)

        def holds_most(r: Element) -> bool:
            return r.soft == 1 and (4 * size[r] > 3 * total and r.tag not in SOFT if r.main else 2 * size[r] > total)

        fine = {r for r in size if (mains and count[r] == blocks) or holds_most(r)}
        against: dict[Element, int] = {}

        def number(e: Element) -> int:
            if e not in against:
                against[e] = sum(r not in fine for r in e.reasons())
            return against[e]

        least = min((number(e) for e, _ in live), default=0) if mains else 0
        for e in {*(e for e, _ in found), *nodes}:
            if number(e) > least:
                e.dropped = True

    def blocks(self, page: str, cut: set[int] | None = None) -> tuple[list[tuple[Element, str]], list[Element]]:
        """The page's blocks in order, each with the element that holds it, and all its block elements.
        Elements of a path in `cut`, with all below them, are dropped."""
        root = Element("", None, 0, False, 0)
        stack, out, nodes, words = [root], [], [], []
        holder = root

        def flush() -> None:
            if words:
                text = SPACES.sub(" ", entities.unescape("".join(words))).strip()
                words.clear()
                if text:
                    out.append((holder, text))

        at, n = 0, len(page)
        while at < n:
            m = TOKEN.match(page, at)
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                token = m.group()
                if token[:2] not in ("<!", "<?"):
                    if not words:
                        holder = next((e for e in reversed(stack) if e.tag in BLOCKS), root)
                    if not stack[-1].dropped or holder.dropped:  # a dropped inline element's text goes, the rest of the block stays
                        words.append(token)
                continue
            tag, closing = tag.lower(), m[1] or m[4]
            attributes = m[3] or m[6] or ""
            block = tag in BLOCKS
            if block:
                flush()
            elif tag == "br":
                words.append(" ")
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if not block and stack[i].tag in BLOCKS:
                        break  # an inline end tag does not end blocks
                continue
            if block:
                if tag in CLOSES_P:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == "p":
                            del stack[i:]
                            break
                        if stack[i].tag in BLOCKS:
                            break
                if tag in CLOSES:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in CLOSES[tag]:
                            del stack[i:]
                            break
                        if stack[i].tag in ("ul", "ol", "dl", "table", "select", "menu"):
                            break
                if tag == "body":
                    stack[1:] = [e for e in stack[1:] if e.tag == "html"]
            if tag in VOID:
                continue
            # inline elements stand for no node of the tree, but may be dropped
            element = self.child(stack[-1], tag, attributes)
            if block:
                if cut and element.path in cut:
                    element.dropped = True
                above = next(e for e in reversed(stack) if e.tag in BLOCKS or e is root)
                if above.children[-1:] != [element.path]:
                    above.children.append(element.path)
                nodes.append(element)
            if tag in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
                continue
            stack.append(element)
        flush()
        self.settle(out, nodes)
        return out, nodes

    def text(self, page: str | None, cut: set[int]) -> str:
        if not page:
            return ""
        kept = [(e, t) for e, t in self.blocks(page, cut)[0] if not e.dropped]
        return "\n".join(t for _, t in ([x for x in kept if x[0].main] or kept))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


COUNTS = "host string, path long, kind string, feature long"


def page_features(reader: Reader, page: str) -> set[tuple[int, str, int]]:
    """(path, kind, feature) of the nodes of one page that hold texts or have children, each once: that
    the node is shown (N), its layouts (L), its texts (T), the nodes that it is part of (A), itself
    included, and the main branch that it is in (M). What tag or class drops is left out."""
    found, nodes = reader.blocks(page)
    one: set[tuple[int, str, int]] = set()
    for e in nodes:
        if e.dropped:
            continue
        if e.children:
            one.add((e.path, "L", xxhash.xxh64_intdigest(repr(e.children)) >> 1))
        if (e.path, "N", 0) not in one:
            one.add((e.path, "N", 0))
            one.add((e.path, "M", e.main))
            up: Element | None = e
            while up is not None and up.parent is not None:
                if up.tag in BLOCKS:
                    one.add((e.path, "A", up.path))
                up = up.parent
    one |= {(e.path, "T", xxhash.xxh64_intdigest(text) >> 1) for e, text in found if e.parent is not None and not e.dropped}
    return one


def features(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in (x for batch in batches for x in slices(batch, 1, SLICE, SLICE_BYTES)):
            rows = [(h, *x) for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in page_features(reader, page or "")]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["host", "path", "kind", "feature"])

    return in_batches(pages.select("host", "html"), run, COUNTS)


def importances(pages: DataFrame) -> DataFrame:
    """(host, path, m, main, importance) of all branches of the style tree: m pages show it, main is
    the main branch it is in, 0 for none. Branches without a text have none."""
    counted = durable(features(pages).groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("k")))

    def of(kind: str, x: Column) -> Column:
        return F.when(F.col("kind") == kind, x)

    k, klog = F.col("k"), F.col("k") * F.ln("k")
    logm = lambda m: F.ln(F.greatest(F.col(m), F.lit(2)).cast("double"))
    nodes = counted.where("kind <> 'A'").groupBy("host", "path").agg(
        F.max(of("N", k)).alias("m"), F.max(of("M", F.col("feature"))).alias("main"), F.sum(of("T", k)).alias("t"), F.sum(of("T", klog)).alias("tl"), F.sum(of("L", k)).alias("l"), F.sum(of("L", klog)).alias("ll")
    )
    nodes = nodes.select(
        "host", "path", "m", "main", "t", "l",
        (1 - F.least(F.lit(1.0), F.col("tl") / F.col("t") / logm("m"))).alias("content"),
        ((F.ln("l") - F.col("ll") / F.col("l")) / logm("l")).alias("layout"),
    )
    nodes = durable(nodes)
    within = counted.where("kind = 'A'").select("host", "path", F.col("feature").alias("branch"))
    branches = within.join(nodes, ["host", "path"]).groupBy("host", F.col("branch").alias("path")).agg(
        (F.sum(F.col("content") * F.col("t")) / F.sum("t")).alias("texts"), F.coalesce(F.sum(F.col("layout") * F.col("l")) / F.sum("l"), F.lit(0.0)).alias("layouts")
    )
    importance = LAYOUT_WEIGHT * F.col("layouts") + (1 - LAYOUT_WEIGHT) * F.col("texts")
    return branches.where("texts is not null").join(nodes.select("host", "path", "m", "main"), ["host", "path"]).select("host", "path", "m", "main", importance.alias("importance"))


def cut_branches(branches: DataFrame) -> DataFrame:
    """(host, path) of the branches that go."""
    branches = durable(branches)
    mains = branches.where(F.col("main") == F.col("path")).select("host", F.col("path").alias("main"), F.col("importance").alias("whole"))
    some = branches.where((F.col("m") >= MIN_PAGES) & (F.col("main") != F.col("path")) & (F.col("importance") < LEAST_IMPORTANCE))
    inside = (F.col("importance") < LEAST_WITHIN) & (F.col("whole") >= MAIN_IMPORTANCE)
    return some.join(mains, ["host", "main"], "left").where((F.col("main") == 0) | inside).select("host", "path")


def extract(pages: DataFrame, url: str = "url", html: str = "html", into: str = "text") -> DataFrame:
    """pages, its html left out, with the main text of each."""
    kept = [c for c in pages.columns if c not in (into, html)]
    schema = T.StructType([pages.schema[c] for c in kept]).add(into, T.StringType(), False)
    source = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), host(F.col(url)).alias("host"), F.col(f"`{html}`").alias("html"))
    cuts = durable(cut_branches(importances(source)).groupBy(F.col("host").alias("cut_host")).agg(F.collect_set("path").alias("cut")))
    few = cuts.agg(F.sum(F.size("cut"))).first()[0] or 0
    joined = source.join(F.broadcast(cuts) if few <= BROADCAST_ROWS else cuts, F.col("host") == F.col("cut_host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in (x for batch in batches for x in slices(batch, 1, SLICE, SLICE_BYTES)):
            texts = [reader.text(page, set(cut or ())) for page, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), pa.array(texts, pa.string())], names=[*kept, into])

    return in_batches(joined.select("row", "html", "cut"), run, schema)
