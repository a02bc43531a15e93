"""Main text of web pages by site style trees. The pages of a host are merged into one tree whose nodes are element paths (tag, class and id, without their digits). How important a node is follows from two entropies over the host's pages: of its presentation (the row of child elements, and how often the element stands there) and of its content (the text). Menus, notices, headers and footers look alike on all pages and often say the same; articles differ in both.

The importance of a node is a sum of log odds. The entropies, the node's share of the host's text and its share of links count with the evidence that there is, (m - 1) / (m - 1 + PRESUMED) for m pages. What the element says of itself (tag, role, class, id) is a prior, of weight NAMED. It fades as evidence comes, to FADED of itself: on a host with up to three pages it decides, from the fourth on it is too little to remove a branch or to keep one, so that the entropies have to agree or overrule it. A plain div that never changes its look is dropped, an article in an element called "widget" stays. Parts of an article (paragraphs, headings, and elements within a node of high presentation entropy) are kept with it unless they repeat from page to page. Branches with a sum below 0 are removed from each page.

Pages of a host with the same text count once. The tree is a table: a row for each host and path, from counts by group, so that no host meets in one task. Pages are read once; what was read is written to the shared folder. The tree is sent to all executors where it has at most MOST_BROADCAST rows, else each page gets the rows of its own paths by a join.

Null and empty pages, and pages without text in an article, have an empty text. Truncated and malformed pages are read as far as they go, and very long ones as a whole. Pages without a host count as one site. Repeated rows get equal results, a sum of exactly 0 keeps a branch, and an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import cut, written

#: Pages that weigh as much as the prior.
PRESUMED = 4
#: Log odds of an element that says nothing of itself, of the words and tags of an article or of something else, and of lying within an article.
PLAIN, NAMED, WITHIN = 1.5, 2.5, 2.0
#: What is left of the prior where there is evidence enough: less than PLAIN.
FADED = 0.5
#: Weights of the entropy of presentation (against 0.5) and of content (below 0.5), of the share of text (against 0.3) and of links (above 0.5).
LOOK, SAY, SHARE, LINKS = 3.0, 8.0, 3.0, 4.0
#: Looks in equal shares that count as the most varied presentation; a node has no more of them on a larger host.
LOOKS = 32
#: Rows of a tree that are sent to all executors, a few dozen bytes each.
MOST_BROADCAST = 200_000

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is not markup and never text of the page.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes", "svg", "math", "canvas", "object", "audio", "video", "select", "button", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: What an opening tag closes, up to the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
#: Elements that are no part of an article by what they are, and by role.
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "search", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "status", "tablist"}
#: Words in class and id that say the same.
NOISE = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted promotion "
    "nav navbar navigation menu topbar breadcrumb breadcrumbs sidebar sidenav rail footer masthead colophon copyright legal "
    "cookie cookies consent gdpr notice notices banner alert popup modal overlay newsletter subscribe subscription paywall signup signin login register "
    "comment comments commentlist disqus reply replies respond discussion share sharing social follow related recommended recommendations "
    "widget widgets pagination pager toolbar search skip form".split()
)
HEADER = {"header", "head", "topper"}
MAIN = {"article", "main"}
#: Elements that share the fate of what they lie in, unless they repeat.
PARTS = set("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd pre blockquote figure figcaption caption address tr tbody thead tfoot summary".split())
HIDDEN, NOISE_KIND, PLAIN_KIND, MAIN_KIND = -2, -1, 0, 1


class Node:
    __slots__ = ("tag", "path", "kind", "inside", "children")

    def __init__(self, tag: str, path: int, kind: int, inside: bool) -> None:
        self.tag, self.path, self.kind, self.inside, self.children = tag, path, kind, inside, []


def read_page(page: str | None) -> tuple[list[tuple[tuple[int, ...], str]], dict[int, list]]:
    """The blocks of a page in order, each with the paths of its ancestors, and for each path its kind, whether it is one of PARTS, its characters, characters in links, and hashes of its content and presentation."""
    blocks: list[tuple[tuple[int, ...], str]] = []
    nodes: dict[int, list] = {}
    stack = [Node("", 0, PLAIN_KIND, False)]
    text: list[str] = []
    links = in_link = 0
    page = page or ""

    def flush() -> None:
        nonlocal links
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                paths = tuple(n.path for n in stack[1:])
                blocks.append((paths, block))
                h = xxhash.xxh64_intdigest(block)
                for p in dict.fromkeys(paths):
                    node = nodes[p]
                    node[2] += len(block)
                    node[3] += min(links, len(block))
                    node[4] = (node[4] * 1_000_003 + h) & (2**64 - 1)
        links = 0

    def close(n: int) -> None:
        nonlocal in_link
        flush()
        in_link = 0
        for node in stack[n:]:
            nodes[node.path][5] = xxhash.xxh64_intdigest("%x %s" % (nodes[node.path][5], " ".join(node.children)))
        del stack[n:]

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                links += len(piece.strip())

    last = page.rfind(">") + 1
    at = 0
    while at < last:
        m = TAG.search(page, at, last) if page.find("<", at, last) >= 0 else None
        if m is None:
            add(page[at:last])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page) + 1
            continue
        closing = m[1] or m[4]
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            text.append(" ")
        elif tag == "hr":
            flush()
        elif tag in RAW and not closing:
            if not (m[3] or m[6] or "").rstrip().endswith("/"):
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            text.append(" ")
        elif tag not in BLOCK or tag in VOID:
            continue
        elif closing:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    if tag not in ("body", "html"):
                        close(n)
                    break
            else:
                flush()
        else:
            shut, until = CLOSES.get(tag, (set(), set()))
            shut = shut | {"p"}
            n = len(stack)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shut:
                    n = i
                elif stack[i].tag in until or not CLOSES.get(tag):
                    break
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and len(stack) > 1 and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                n = min(n, len(stack) - 1)
            if n < len(stack):
                close(n)
            else:
                flush()
                in_link = 0
            if tag in ("html", "body") and any(x.tag == tag for x in stack):
                continue
            attributes = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(m[3] or m[6] or "")} if (m[3] or m[6]) else {}
            key, kind = describe(tag, attributes, stack[-1].inside)
            stack[-1].children.append(key)
            path = xxhash.xxh64_intdigest(f"{stack[-1].path:x}/{key}")
            inside = stack[-1].inside or tag in MAIN or attributes.get("role") == "main"
            if inside and not stack[-1].inside:  # what holds an article is no noise, whatever its class
                for x in stack[1:]:
                    nodes[x.path][0] = max(nodes[x.path][0], PLAIN_KIND)
            stack.append(Node(tag, path, kind, inside))
            nodes.setdefault(path, [kind, tag in PARTS, 0, 0, 0, 0])
    if at <= last:
        add(re.split(r"<[a-zA-Z/!?]", page[max(at, last) :], maxsplit=1)[0])
    close(1)
    return blocks, nodes


def describe(tag: str, attributes: dict[str, str], inside: bool) -> tuple[str, int]:
    """An element's name in a path, and what it says of itself."""
    names = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower()) if attributes else []
    key = f"{tag}.{'.'.join(names)}" if names else tag
    if tag in ("html", "body"):
        return key, PLAIN_KIND
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return key, HIDDEN
    if tag in MAIN:
        return key, MAIN_KIND
    noise = tag in ASIDE or attributes.get("role", "").lower() in ROLES or not NOISE.isdisjoint(names)
    noise = noise or not inside and (tag == "header" or not HEADER.isdisjoint(names))
    return key, NOISE_KIND if noise else PLAIN_KIND


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(df: DataFrame, key: str, url: str, page: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(df[url], F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return df.select(F.coalesce(df[key].cast("string"), F.lit("")).alias("k"), F.xxhash64(df[url], df[page]).alias("h"), host.alias("host"), df[key].alias("key"), df[url].alias("url"), df[page].alias("page"))


NODE = "path long, chars long, links long, content long, style long"


def parsed(rows: DataFrame) -> DataFrame:
    """For each page of keyed(): k, h, host, key, url, root (hash of all of its text), total (its characters), blocks (packed: the kinds of paths, rows of ancestors, and blocks) and nodes, for each path with text on it."""
    node = T.ArrayType(T.StructType([T.StructField(c.split()[0], T.LongType()) for c in NODE.split(", ")]))
    schema = T.StructType([*[rows.schema[c] for c in ("k", "h", "host", "key", "url")], T.StructField("root", T.LongType()), T.StructField("total", T.LongType()), T.StructField("blocks", T.BinaryType()), T.StructField("nodes", node)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, totals, packed, ends, columns = [], [], [], [0], [[] for _ in NODE.split(", ")]
            for page in batch.column(5).to_pylist():
                blocks, found = read_page(page)
                roots.append(signed(xxhash.xxh64_intdigest(" ".join(b for _, b in blocks))))
                totals.append(sum(len(b) for _, b in blocks))
                for p, (_, _, chars, links, content, style) in found.items():
                    if chars:
                        for column, x in zip(columns, (signed(p), chars, links, signed(content), signed(style)), strict=True):
                            column.append(x)
                ends.append(len(columns[0]))
                numbers: dict[tuple[int, ...], int] = {}
                told = [(numbers.setdefault(paths, len(numbers)), b) for paths, b in blocks]
                ancestors = [[(signed(p), *found[p][:2]) for p in paths] for paths in numbers]
                packed.append(json.dumps([ancestors, told], ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"))
            items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in NODE.split(", ")])
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(roots, pa.int64()), pa.array(totals, pa.int64()), pa.array(packed, pa.binary()), nodes], names=schema.names)

    return rows.select("k", "h", "host", "key", "url", "page").mapInArrow(read, schema)


def style_tree(pages: DataFrame, presumed: int = PRESUMED, shown: float = 1.0) -> DataFrame:
    """The merged trees: host, path, pages, look and say (the entropies, 0 to 1), and log odds: branch, part (of an element that shares the fate of another), and main, whether what lies within is part of an article, and prior, what is left of the weight of names. pages: parsed(). shown: weight of the evidence; 0 leaves out what the trees show."""
    found = pages.select("host", "root", "total", F.inline("nodes"))
    once = found.groupBy("host", "path", "root").agg(*[F.first(c).alias(c) for c in ("total", "chars", "links", "content", "style")])
    values = F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("value")) for c in ("content", "style")])
    features = once.select("host", "path", "total", "chars", "links", F.explode(values).alias("f"))
    counts = features.groupBy("host", "path", "f").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("total", "chars", "links")])
    ordered = lambda of: F.sum(F.when(F.col("f.of") == of, F.col("n") * F.log("n")).otherwise(0.0))
    tree = counts.groupBy("host", "path").agg((F.sum("n") / 2).alias("pages"), ordered("content").alias("say"), ordered("style").alias("look"), *[F.sum(c).alias(c) for c in ("total", "chars", "links")])
    m = F.col("pages")
    entropy = lambda c, most: F.when(m > 1, F.least((F.log(m) - F.col(c) / m) / F.log(most), F.lit(1.0))).otherwise(1.0)
    tree = tree.withColumns({"say": entropy("say", m), "look": entropy("look", F.least(m, F.lit(LOOKS))), "evidence": (m - 1) / (m - 1 + presumed)})
    share, linked = F.col("chars") / F.greatest(F.col("total"), F.lit(1)), F.col("links") / F.greatest(F.col("chars"), F.lit(1))
    look, share = LOOK * (F.col("look") - 0.5), SHARE * (share - 0.3)
    repeats, in_links = SAY * F.least(F.col("say") - 0.5, F.lit(0.0)), -LINKS * F.greatest(linked - 0.5, F.lit(0.0))
    above = lambda c: F.greatest(c, F.lit(0.0))
    return tree.select(
        "host", "path", "pages", "look", "say",
        (shown * F.col("evidence") * (look + share + repeats + in_links)).alias("branch"),
        (shown * F.col("evidence") * (above(look) + above(share) + repeats)).alias("part"),
        (shown * F.col("evidence") * (F.col("look") - 0.5) > 0.1).alias("main"),
        F.greatest(1 - F.col("evidence"), F.lit(FADED)).alias("prior"),
    )


def kept_text(packed: bytes, odds: dict[int, tuple[float, float, bool, float]], named: float = NAMED) -> str:
    """The blocks of a page, packed by parsed(), without those in branches of low importance. odds: branch, part, main and prior by path."""
    ancestors, blocks = json.loads(packed.decode("utf-8", "surrogatepass"))
    keep = []
    for paths in ancestors:
        within, stays = 0.0, True
        for path, kind, part in paths:
            branch, as_part, main, prior = odds.get(path, (0.0, 0.0, False, 1.0))
            total = PLAIN + named * prior * kind + (max(within, WITHIN) + as_part if part else within + branch)
            if kind == HIDDEN or total < 0:
                stays = False
                break
            if kind == MAIN_KIND and named or main and not part:
                within = WITHIN
        keep.append(stays)
    return " ".join(b for i, b in blocks if keep[i])


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", presumed: int = PRESUMED, named: float = NAMED, most_broadcast: int = MOST_BROADCAST, shown: float = 1.0) -> DataFrame:
    """key, url, text and n_chars for each row of df. named: weight of what elements say of themselves; 0 leaves it to the entropies. shown: weight of the entropies; 0 leaves it to what is left of the names."""
    # Text is most of what is written, and shrinks by more than half.
    pages = written(parsed(keyed(df, key, url, page)), "zstd")
    tree = cut(style_tree(pages, presumed, shown))
    odds = F.collect_list(F.struct("path", "branch", "part", "main", "prior")).alias("odds")
    if tree.count() <= most_broadcast:
        joined = pages.drop("nodes").join(F.broadcast(tree.groupBy("host").agg(odds)), "host", "left")
    else:
        # Both sides of the join are written tables, so that a common path of a large host can be split. A page has few paths, so its list is small.
        own = pages.select("k", "h", "host", F.explode("nodes.path").alias("path")).join(tree, ["host", "path"]).groupBy("k", "h").agg(odds)
        joined = pages.drop("nodes").join(own.withColumnRenamed("k", "k_").withColumnRenamed("h", "h_"), (F.col("k") == F.col("k_")) & (F.col("h") == F.col("h_")), "left")
    joined = joined.select("key", "url", "host", "blocks", "odds.path", "odds.branch", "odds.part", "odds.main", "odds.prior")

    @F.pandas_udf("string")
    def text(blocks: pd.Series, path: pd.Series, branch: pd.Series, part: pd.Series, main: pd.Series, prior: pd.Series) -> pd.Series:
        return pd.Series([kept_text(b, {} if p is None else dict(zip(p.tolist(), zip(*row, strict=True), strict=True)), named) for b, p, *row in zip(blocks, path, branch, part, main, prior, strict=True)], dtype=object)

    done = joined.select("key", "url", text("blocks", "path", "branch", "part", "main", "prior").alias("text"))
    return done.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
