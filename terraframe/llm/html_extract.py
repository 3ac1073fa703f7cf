"""HTML extraction with a site style tree.

All pages of a host are merged into one style tree: its nodes are the paths of elements (tag, classes and id, digits
folded) on which the pages agree. For each node the tree counts which contents stand there on how many different pages;
pages that are copies of each other count once. A node's importance is the entropy of its contents, relative to that of
all contents being different: boilerplate repeats a few contents (near 0), articles don't (near 1). A node seen less than
``SUPPORT`` times has importance 1, so lone pages are judged by presentation alone.

Presentation adds to that: what stands in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
comments, by element or by class and id, goes in any case; inside ``article`` or ``main`` a node gains ``MAIN_BONUS``.
Branches whose sum is under ``LEAST`` are removed from each page. If a page has an article or main element with text left,
only the text in these counts.

The tree is built by grouping (node, content, page) hashes; a large host spreads over its contents. Only removable nodes
go back to the pages: broadcast up to ``BROADCAST_NODES``, beyond that joined by host.

Defined results: null and empty html have an empty text. A null url, or one without a host, belongs to the host "".
Unclosed and misnested elements are closed as browsers do; text after a cut-off tag is dropped with the tag.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm._session import table

SUPPORT, LEAST, MAIN_BONUS = 8, 0.4, 0.35
BROADCAST_NODES = 1_000_000
SCHEMA_STATS = "node long, content long, page long, host string, main boolean"

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))""", re.S)
CLASS = re.compile(r"""(?:^|[\s"'])(class|id|role|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose contents aren't text of the page; unclosed, the first ones run to the end of the page, others are ignored.
TO_END = {"script", "style", "textarea", "title", "xmp", "noframes", "iframe"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "select", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CHROME_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "search", "head", "header"}
#: Words of a class, id or role that mark what isn't the article.
CHROME = re.compile(r"^(?:ads?|adverts?|advertisements?|advertising|adsense|adslot|banners?|breadcrumbs?|comments?|commentlist|disqus|cookies?|consent|gdpr|footers?|header|masthead|menus?|nav|navbar|navigation|navigationbar|newsletter|notices?|notification|alert|popup|modal|overlay|paywall|pager|pagination|promos?|promoted|related|recommended|recommendations|replies|reply|respond|search|searchbox|share|sharing|social|sidebars?|sponsor|sponsored|subscribe|subscription|signup|login|toolbar|topbar|widgets?|skip|contentinfo|complementary|dialog|taboola|outbrain|teaser)$")
#: Words that tell nothing of what an element holds. A name marks chrome if it has a word of CHROME and else only these.
NEUTRAL = re.compile(r"^(?:[0-9]*|[a-z]|area|articles?|bars?|block|body|bottom|box|bulletin|button|buttons|card|cell|center|col|column|container|content|field|fixed|float|form|global|grid|group|header|holder|icons?|inner|input|items?|js|layout|left|links?|lists?|local|main|medium|mobile|module|nav|outer|page|pages|panel|policy|posts?|primary|right|row|secondary|section|sections|shell|side|site|slot|small|sticky|stories|strip|sub|tab|tertiary|text|thread|title|tools|top|unit|user|wide|wrap|wrapper|zone)$")
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: An opening tag closes open ones of these, up to a boundary.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"})}
IN_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "li", "dd", "dt"}
ROOTS = {"article", "main", "body", "html"}
P_SCOPE = {"td", "th", "table", "body", "html", "button", "caption"}

_NODES: dict[tuple[int, str, str], tuple[int, bool]] = {}
_CHROME: dict[str, bool] = {}

Piece = tuple[str, int, bool]  # text, node, in an article or main element


def _is_chrome(tag: str, marks: str, in_main: bool) -> bool:
    if tag in CHROME_TAGS and not (tag == "header" and in_main):
        return True
    if not marks:
        return False
    got = _CHROME.get(marks)
    if got is None:
        names = [SPLIT.split(CAMEL.sub("-", name).lower()) for name in marks.split()]
        got = _CHROME[marks] = any(any(map(CHROME.match, w)) and all(CHROME.match(x) or NEUTRAL.match(x) for x in w) for w in names) or "aria-hidden=true" in marks
        if len(_CHROME) > 100_000:
            _CHROME.clear()
    return got and tag not in ("body", "html")


def _marks(attributes: str) -> str:
    found = []
    for m in CLASS.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            found += value.split()
        elif name == "hidden" or value.lower() == "true":
            found.append("aria-hidden=true")
    return " ".join(sorted(found))


def _node(parent: int, tag: str, marks: str) -> int:
    """Hash of a style node's path."""
    key = (parent, tag, marks)
    got = _NODES.get(key)
    if got is None:
        if len(_NODES) > 200_000:
            _NODES.clear()
        got = _NODES[key] = xxhash.xxh64_intdigest(f"{parent}>{tag} {re.sub('[0-9]+', '#', marks)}") >> 1
    return got


def pieces(page: str) -> list[Piece]:
    """The page's blocks of text that aren't chrome, in page order."""
    out: list[Piece] = []
    #: tag, node, chrome, in main, in comments
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    text: list[str] = []

    def flush():
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            if t:
                out.append((t, stack[-1][1] if stack[-1][0] in BLOCK else stack[last(BLOCK)][1], stack[-1][3]))
            text.clear()

    #: where each tag's open elements stand in the stack
    places: dict[str, list[int]] = {}
    last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(to: int):
        for s in stack[to:]:
            if s[0] in BLOCK:
                flush()
                break
        for s in stack[to:]:
            places[s[0]].pop()
        del stack[to:]

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if end > at and not stack[-1][2]:
            text.append(page[at:end])
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end tag
            i = last((tag,))
            if i and (tag in ROOTS or last(("article", "main", "body")) <= i):
                close(i)
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in RAW:
            stop = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
            if not attributes.endswith("/"):
                at = stop.end() if stop else n if tag in TO_END else at
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in IN_P and places.get("p") and (i := places["p"][-1]) > last(P_SCOPE):
            close(i)
        if tag in IMPLIED:
            ends, scope = IMPLIED[tag]
            if (i := last(ends)) > last(scope):
                close(i)
        if tag == "body":
            close(1)
        if tag in BLOCK:
            flush()
        _, parent, chrome, in_main, in_comments = stack[-1]
        marks = _marks(attributes) if attributes and not attributes.isspace() else ""
        own = _is_chrome(tag, marks, in_main)
        if tag in ("article", "main") or "main" == marks.lower():
            if chrome and not in_comments and not own:
                chrome = False  # what was left open before it doesn't swallow the article
            in_main = in_main or not chrome and not own
        in_comments = in_comments or own and "comment" in marks.lower()
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, _node(parent, tag, marks), chrome or own, in_main, in_comments))
    flush()
    return out


def extract(page: str, low: frozenset[int] | set[int], host_key: int) -> str:
    """The page's text without the nodes in low (hashes of host and node)."""
    kept = [(t, main) for t, node, main in pieces(page) if (host_key ^ node) not in low]
    if any(main for _, main in kept):
        kept = [x for x in kept if x[1]]
    return "\n".join(t for t, _ in kept)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def host_hash(host: str) -> int:
    return xxhash.xxh64_intdigest(host) >> 1


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(node, host, main, importance) of every style node of every host; node is a hash of host and path."""

    def run(batches):
        for b in batches:
            node, content, page, hosts, main = [], [], [], [], []
            for url, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                host = host_of(url)
                key, whole = host_hash(host), xxhash.xxh64_intdigest(text) >> 1
                for t, n, m in pieces(text):
                    node.append(key ^ n)
                    content.append(xxhash.xxh64_intdigest(t) >> 1)
                    page.append(whole)
                    hosts.append(host)
                    main.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(content, pa.int64()), pa.array(page, pa.int64()), pa.array(hosts, pa.string()), pa.array(main, pa.bool_())], names=["node", "content", "page", "host", "main"])

    found = pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, SCHEMA_STATS)
    each = found.groupBy("node", "content", "page").agg(F.min("host").alias("host"), F.min("main").alias("main"))
    counts = each.groupBy("node", "content").agg(F.count("*").alias("c"), F.min("host").alias("host"), F.min("main").alias("main"))
    tree = counts.groupBy("node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), F.min("host").alias("host"), F.min("main").alias("main"))
    entropy = (F.log("n") - F.col("s") / F.col("n")) / F.log("n")
    return tree.select("node", "host", "main", F.when(F.col("n") < SUPPORT, 1.0).otherwise(entropy).alias("importance"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text for each row of pages."""
    sc = pages.sparkSession.sparkContext
    low = style_tree(pages, url_col, html_col).where(F.col("importance") + F.when(F.col("main"), MAIN_BONUS).otherwise(0.0) < LEAST).select("host", "node")
    schema = "page_id long, url string, text string"
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    few = low.limit(BROADCAST_NODES + 1).select("node").collect()
    if len(few) <= BROADCAST_NODES:
        shared = sc.broadcast(frozenset(r["node"] for r in few))
    else:
        shared = None
        hosts = low.groupBy("host").agg(F.collect_list("node").alias("low")).withColumnRenamed("host", "_host")
        host = F.coalesce(F.lower(F.regexp_replace(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), "^.*@", "")), F.lit(""))
        rows = rows.withColumn("_host", host).join(hosts, "_host", "left").drop("_host")

    def run(batches):
        for b in batches:
            out = []
            lows = b.column(3).to_pylist() if shared is None else [None] * b.num_rows
            for url, page, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), lows):
                out.append(extract(page, shared.value if shared else set(own or ()), host_hash(host_of(url))) if page else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, schema)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
