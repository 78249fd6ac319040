"""Main-text extraction with a site style tree per host."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, table

#: A comment or declaration, a tag, or text. A quote opens a value only right after "=", and only if it is closed.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|=|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)|([^<]++|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Opening one of these closes an open element of the named kinds, up to the nearest fence.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "thead": {"tbody", "tr"}, "tbody": {"thead", "tr"},
}
FENCES = {"ul", "ol", "table", "dl", "div", "article", "section", "main", "body", "aside", "nav", "header", "footer", "blockquote", "select"}
#: Elements that are never main text, by tag or role.
DROPPED_TAGS = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "input", "menu", "dialog", "audio", "video", "map"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Words in class or id that make an element less likely to be main text, and words beside them that say nothing.
TEMPLATE_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie",
    "cookies", "consent", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "popup", "promo", "promoted", "related", "share", "sharing", "sidebar", "social", "sponsor",
    "sponsored", "subscribe", "widget",
}
NEUTRAL_WORDS = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content",
    "group", "icons", "inner", "item", "items", "left", "links", "list", "main", "media", "outer", "page", "panel", "posts",
    "right", "row", "section", "site", "slot", "small", "stories", "text", "thread", "top", "wrap", "wrapper",
}
WORDS = re.compile(r"[a-z0-9]+")
DEEPEST = 256


@dataclass(frozen=True)
class StyleTreeConfig:
    """Branches whose importance, times the prior of their class words, is below ``importance`` go.

    The prior is ``named`` if a name in class or id has template words alone, ``partly`` if it has others beside them,
    else 1. A host with fewer pages than ``min_pages`` has no style tree: all its importances are 1. ``damping``
    weighs an element's presentation against its words, and what lies a level deeper.
    """

    importance: float = 0.2
    min_pages: int = 4
    damping: float = 0.9
    named: float = 0.1
    partly: float = 0.5

    def __post_init__(self):
        if not self.named < self.importance:
            raise ValueError("an element named by template words alone must fall below the least importance")


@dataclass
class Node:
    tag: str
    label: str
    dropped: bool = False
    named: int = 0  # 1 if a name has template words beside others, 2 if it has them alone
    children: list = field(default_factory=list)  # Node or str


def parse(page: str) -> Node:
    """A lenient DOM of the whole page; unclosed and misnested tags are accepted.

    As in browsers the depth is bounded: what is nested deeper than ``DEEPEST`` lies side by side at that depth.
    """
    root = Node("#root", "#root")
    stack = [root]
    flat: Counter = Counter()  # open elements that were too deep
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        close, tag, attributes, text = m.groups()
        if text is not None:
            stack[-1].children.append(text)
        elif tag is None:
            continue
        elif close:
            tag = tag.lower()
            if flat[tag]:
                flat[tag] -= 1
            elif any(n.tag == tag for n in stack[1:]):
                while stack.pop().tag != tag:
                    pass
        else:
            tag = tag.lower()
            node = _element(tag, attributes)
            for k in range(len(stack) - 1, 0, -1):
                if tag in CLOSES and stack[k].tag in CLOSES[tag] or tag in BLOCKS and tag != "br" and stack[k].tag == "p":
                    del stack[k:]
                elif stack[k].tag in FENCES:
                    break
            stack[-1].children.append(node)
            if tag in RAW and not attributes.endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = found.end() if found else end
            elif tag not in VOID and not attributes.endswith("/"):
                if len(stack) < DEEPEST:
                    stack.append(node)
                else:
                    flat[tag] += 1
    return root


def _element(tag: str, attributes: str) -> Node:
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    dropped = tag in DROPPED_TAGS or found.get("role", "").lower() in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    named = 0
    if tag not in ("html", "body", "article", "main"):
        for words in (set(WORDS.findall(name)) for name in names):
            if words & TEMPLATE_WORDS:
                named = max(named, 1 if words - TEMPLATE_WORDS - NEUTRAL_WORDS else 2)
    return Node(tag, f"{tag}.{'.'.join(sorted(set(found.get('class', '').lower().split())))}", dropped, named)


def blocks_of(node: Node, mute_ids: frozenset[int] = frozenset(), cut: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks below a node in page order; white space runs become one space.

    Of an element in ``mute_ids`` its own words go, the blocks in it stay; one in ``cut`` goes whole.
    """
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(run)).split()):
            out.append(text)
        run.clear()

    todo: list = [(node, False)]
    while todo:
        item, mute = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if not mute:
                run.append(item)
        elif item.dropped or id(item) in cut:
            if item.tag in BLOCKS:
                flush()
        else:
            if item.tag in BLOCKS:
                flush()
                todo.append((None, False))
                mute = False
            mute = mute or id(item) in mute_ids
            todo.extend((c, mute) for c in reversed(item.children))
    flush()
    return out


def own_words(node: Node) -> str:
    """Words below an element and outside of the blocks in it: those of its inline elements count."""
    parts: list[str] = []
    todo = list(reversed(node.children))
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            parts.append(item)
        elif item.tag in BLOCKS:
            parts.append(" ")
        elif not item.dropped:
            todo.extend(reversed(item.children))
    return " ".join("".join(parts).split())


def _path(above: int, label: str) -> int:
    """A signed 64-bit number for the labels from the root to an element."""
    return xxhash.xxh64_intdigest(f"{above}/{label}") - (1 << 63)


def style_rows(root: Node) -> list[tuple[int, tuple[int, ...], int, int, int]]:
    """(path, paths above it from the nearest, style, content, words) of each element.

    The path stands for its labels from the root, the style for the sequence of its
    children's labels with repeats joined, the content for its own words (``own_words``; 0 if none).
    """
    rows = []
    todo: list[tuple[Node, int, tuple[int, ...]]] = [(root, 0, ())]
    while todo:
        node, above, line = todo.pop()
        path = _path(above, node.label)
        kids = [c for c in node.children if isinstance(c, Node)]
        style = ",".join(k.label for i, k in enumerate(kids) if i == 0 or kids[i - 1].label != k.label)
        words = own_words(node)
        rows.append((path, line, _path(1, style), _path(2, words) if words else 0, words.count(" ") + 1 if words else 0))
        if not node.dropped:
            todo.extend((k, path, (path, *line)) for k in kids)
    return rows


def host() -> F.Column:
    """The lower-cased host in ``url``; "" if there is none."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), pattern, 1)), F.lit(""))


def site_style_tree(pages: DataFrame, config: StyleTreeConfig = StyleTreeConfig()) -> DataFrame:
    """``host, path, pages, own, importance`` for each element of each host's merged tree.

    Presentation importance is the entropy of the child sequences seen at an element, content
    importance that of its own words, both in units of the log of the pages that have it: 0 where
    all pages agree, 1 where all differ or one page has it alone. ``own`` weighs the two, and is null without words.
    ``importance`` is the element's composite importance: its presentation's, and the mean of what it and the elements
    below it say, weighted by their words and damped by their depth. Equal rows of a host are counted before the
    shuffle, so a host with a third of all pages costs its distinct elements, and each (host, path, value)
    is a key of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for site, page in zip(batch["host"].to_pylist(), batch["html"]):
                for row in set(style_rows(parse(page.as_py() or ""))):
                    counts[site, row] += 1
            columns = list(zip(*((site, *row, n) for (site, row), n in counts.items()))) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "path", "above", "style", "content", "words", "n"])

    seen = pages.select(host().alias("host"), "html").mapInArrow(run, "host string, path long, above array<long>, style long, content long, words long, n long")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(("style", "content"))))
    both = seen.select("host", "path", "above", "n", (F.col("words") * F.col("n")).alias("words"), F.explode(kinds).alias("v")).select("host", "path", "above", "n", "words", "v.*")
    values = both.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.first("above").alias("above"))
    entropy = values.groupBy("host", "path", "kind").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum("words").alias("words"), F.first("above").alias("above")
    )
    share = F.when(F.col("m") > 1, 1 - F.col("nlogn") / (F.col("m") * F.log("m"))).otherwise(1.0)
    by_kind = entropy.select("host", "path", "kind", "m", "words", "above", share.alias("importance"))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("importance")))
    elements = by_kind.groupBy("host", "path").agg(
        F.max("m").alias("pages"), of(0).alias("presentation"), of(1).alias("content"), F.max("words").alias("words"), F.first("above").alias("above")
    )
    mixed = (1 - config.damping) * F.col("presentation") + config.damping * F.col("content")
    rated = elements.withColumn("own", F.when(F.col("words") > 0, mixed))
    # each element counts for itself and for all above it
    line = F.concat(F.array("path"), F.coalesce("above", F.array().cast("array<long>")))
    spread = rated.select("host", "own", "words", "pages", "presentation", F.posexplode(line).alias("depth", "at"))
    weight = F.col("words") * F.pow(F.lit(config.damping), F.col("depth"))
    itself = F.col("depth") == 0
    merged = spread.groupBy("host", F.col("at").alias("path")).agg(
        F.max(F.when(itself, F.col("pages"))).alias("pages"),
        F.max(F.when(itself, F.col("own"))).alias("own"),
        F.max(F.when(itself, F.col("presentation"))).alias("presentation"),
        F.sum(F.when(F.col("own").isNotNull(), weight * F.col("own"))).alias("said"),
        F.sum(F.when(F.col("own").isNotNull(), weight)).alias("weight"),
    )
    said = F.coalesce(F.col("said") / F.col("weight"), F.col("presentation"))
    return merged.select("host", "path", "pages", "own", ((1 - config.damping) * F.col("presentation") + config.damping * said).alias("importance"))


def main_text(page: str | None, mute: frozenset[int] = frozenset(), low: frozenset[int] = frozenset(), doubtful: frozenset[int] = frozenset()) -> str:
    """The main text of a page, as the host's style tree has it.

    Scope is the articles that lie in no other article, else ``main``, else the page. In it branches
    of low importance go: those whose path is in ``low``, those named like templates, and those partly named so
    whose path is in ``doubtful``. The own words of elements in ``mute`` go, the blocks in them stay. In an article only
    blocks are judged by the tree, and its verdict holds only for the lesser part of the text: pages that share most of
    their article keep it.
    """
    root = parse(page or "")
    muted, cut, named = set(), set(), set()
    articles, mains = [], []
    todo: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while todo:
        node, above, inside = todo.pop()
        if node.dropped:
            continue
        path, scope = _path(above, node.label), node.tag in ("article", "main", "body", "html", "#root")
        if node.named == 2 or (node.named == 1 and path in doubtful):
            named.add(id(node))
        if node.tag in BLOCKS or not inside:
            if path in mute:
                muted.add(id(node))
            if path in low and not scope:
                cut.add(id(node))
        if node.tag == "article" and not inside:
            articles.append(node)
        elif node.tag == "main":
            mains.append(node)
        here = inside or node.tag == "article"
        todo.extend((k, path, here) for k in reversed(node.children) if isinstance(k, Node))
    scope = articles or mains[:1] or [root]
    pruned = " ".join(b for a in scope for b in blocks_of(a, frozenset(muted), frozenset(cut | named)))
    if articles and (muted or cut):
        whole = " ".join(b for a in scope for b in blocks_of(a, frozenset(), frozenset(named)))
        return pruned if 2 * len(pruned) >= len(whole) else whole
    return pruned


def extract(pages: DataFrame, config: StyleTreeConfig = StyleTreeConfig()) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html, ...)``.

    Null html counts as empty and gives an empty text; pages without a host share the host
    "". Repeated rows each return; an empty table gives an empty result; other columns are not read. What
    the tree says of a host joins its pages as one array of paths: it holds paths of low importance that at
    least ``min_pages`` pages share, so it grows with templates, not with pages, and the join is an ordinary one that AQE
    splits when one host has most pages.
    """
    judged = site_style_tree(pages, config).where(F.col("pages") >= config.min_pages).select(
        "host",
        "path",
        (F.coalesce(F.col("own") < config.importance, F.lit(False)).cast("int") + 2 * (F.col("importance") < config.importance).cast("int") + 4 * (F.col("importance") * config.partly < config.importance).cast("int")).alias("verdict"),
    )
    low = materialize(judged.where("verdict > 0").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "verdict"))).alias("judged")), "style-tree")
    joined = pages.select("page_id", "url", "html", host().alias("host")).join(low, "host", "left").select("page_id", "url", "html", "judged.path", "judged.verdict")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        sets: list[frozenset[int]] = []
        for batch in batches:
            texts = []
            for page, paths, verdicts in zip(batch["html"], batch["path"], batch["verdict"]):
                own = (paths.as_py() or [], verdicts.as_py() or [])
                if own != held:
                    held = own
                    sets = [frozenset(p for p, v in zip(*own) if v & bit) for bit in (1, 2, 4)]
                texts.append(main_text(page.as_py(), *sets))
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.select(F.col("page_id").cast("long"), "url", "html", "path", "verdict").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
