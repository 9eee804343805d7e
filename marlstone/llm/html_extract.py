"""Main text of web pages by site template removal.

Every element outside the article, and link lists and boxes inside it, is hashed with all
that it holds. Spark counts each host's different pages that hold a subtree, for a box its
different articles; those on many are the site's template and are deleted. What marks
itself as a menu, header, footer, sidebar, notice, advert, form or reader comment is
deleted on single pages too. The rest of the article (of the body, where a page names no
article) is the main text.

A page is parsed once, into its text, the bounds of its blocks and the spans of its
subtrees; counting and deleting work on those.
"""

from __future__ import annotations

import html
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources import scratch

#: A subtree on so many different pages of its host, or a box in so many of its articles, is template,
MIN_PAGES = 4
#: if those are also this share of the host's different pages.
MIN_SHARE = 0.05
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may be a box in an article; its own headings and paragraphs are not.
BOX = frozenset("address aside center dd details div dl dt fieldset figure footer header hgroup ol section summary table ul".split())
DROPPED = frozenset("head nav footer aside form button select option menu dialog svg canvas object audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: An element closes these when they are open next to it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Open elements that such a search does not look beyond.
FENCE = frozenset("ul ol dl table select article main body section div".split())
#: End tags that close over any open element; others do not close over INNER_FENCE.
CLOSE_ANY = frozenset("html body article main div section".split())
INNER_FENCE = frozenset("article main body".split())
#: Words that classes and ids are made of. A name counts if all its words are here and one is not PLAIN.
CLEAR = frozenset("ad ads adbox adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsored sponsors sidebar nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices newsletter subscribe popup modal comment comments commentlist disqus pagination pager skip skiplink masthead".split())
#: Of those, words that an article's own section may be about: alone they say as little as VAGUE ones there.
TOPICS = frozenset("cookie cookies consent gdpr notice notices newsletter subscribe popup modal pagination navigation sponsor sponsors advertising".split())
#: Alone inside an article, a list of comments or one of several.
TALK = frozenset("comment comments".split())
#: Inside an article these say something in company of a PLAIN word, alone only of an element that is mostly links.
VAGUE = frozenset("promo promos promotion promotions banner menu alert overlay share sharing social related recommended respond footer widget copyright subscription".split())
LINKS_ONLY = frozenset("header hidden".split())
PLAIN = frozenset("site page main top bottom left right inner outer global primary secondary box bar block container wrapper wrap row col column list item items link links button buttons icon icons section area region slot unit panel form group holder fixed sticky post posts article articles story stories news topic topics content the my signup sign up message messages text title label inline dialog backdrop body thread reply replies count policy settings preferences accept close next prev previous trail toggle mobile desktop".split())
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|disqus|replies|reply)(?:$|[\s_-])", re.I)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|</?[A-Za-z][^>]*\Z|</[^A-Za-z][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


class Node:
    __slots__ = ("tag", "up", "own", "vague", "talk", "talks", "main", "holds_main", "in_main", "inner", "parts", "size", "linked", "headed", "key", "link", "depth", "first", "last", "gone")

    def __init__(self, tag: str, up: Node | None, bad: bool, main: bool, vague: bool = False, talk: bool = False):
        self.tag, self.up, self.own, self.vague, self.talk = tag, up, bad, vague, talk
        self.talks: Node | None = None  # an element inside that is named as a comment, if it is not next to another
        self.main, self.holds_main = main, main
        self.in_main = main or (up is not None and up.in_main)
        self.inner = self if main else up.inner if up is not None else None
        self.link = tag == "a" or (up is not None and up.link)
        self.parts: list[str] = []
        self.size = self.linked = self.headed = self.key = self.first = self.last = 0
        self.depth = 0 if up is None else up.depth + 1
        self.gone = False


@lru_cache(maxsize=1 << 14)
def named(names: str, in_main: bool) -> tuple[bool, bool, bool]:
    """Whether class and id name boilerplate, whether they do if the element is mostly links, and if it is one of several comments or holds some."""
    clear = vague = talk = False
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower().split():
        words = re.findall(r"[^\W\d_]+", name)
        if "".join(words) in CLEAR:
            words = ["".join(words)]
        if not words or not all(w in CLEAR or w in VAGUE or w in LINKS_ONLY or w in PLAIN for w in words):
            continue
        telling = [w for w in words if w not in PLAIN]
        if in_main and len(words) == 1 and words[0] in TOPICS | TALK:
            vague, talk = True, talk or words[0] in TALK
        elif any(w in CLEAR for w in telling) or (telling and not in_main):
            clear = True
        elif any(w in VAGUE for w in telling) and len(words) > 1:
            clear = True
        elif telling:
            vague = True
    return clear, vague, talk


def marks(tag: str, raw: str, up: Node) -> tuple[bool, bool, bool, bool]:
    """Whether an element marks itself as boilerplate, as the main part, and as boilerplate if it is mostly links, or if it is or holds comments."""
    main, vague, talk = tag in ("article", "main"), False, False
    bad = tag in DROPPED or (tag == "header" and not up.in_main)
    if raw and not raw.isspace():
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}
        role = found.get("role", "").lower()
        main = main or role == "main"
        names = f"{found.get('class', '')} {found.get('id', '')}"
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        if main or tag in ("html", "body"):
            bad = bool(main and tag == "article" and COMMENTS.search(names))
        elif tag not in HEADINGS:
            clear, vague, talk = named(names, up.in_main)
            bad = bad or hidden or role in ROLES or clear
    return bad, main and not bad, vague, talk


def parse(page: str) -> tuple[Node, list[Node], list[tuple[Node, str | None]]]:
    """The root, the elements, and the page in order: (element, text), text None where a block begins or ends."""
    root = Node("", None, False, False)
    node, nodes, stream = root, [], []
    open_: dict[str, list[Node]] = {}  # the open elements of each name

    def close(to: Node) -> Node:
        nonlocal node
        while True:
            x, up = node, node.up
            open_[x.tag].pop()
            x.last = len(stream)
            x.own = x.own or (x.vague and 2 * x.linked >= x.size) or (x.talk and x.talks is not None)
            if x.talk and up.talks is not None and up.talks.up is up:
                x.own = up.talks.own = True  # comments side by side
            if x.talk or x.talks is not None:
                up.talks = x if x.talk else up.talks or x.talks
            digest = xxhash.xxh64_intdigest("\x01".join([x.tag, *x.parts]))
            x.key = digest - (1 << 63)
            up.parts.append(f"\x02{digest:x}")
            up.size += x.size
            up.linked += x.linked
            up.headed += x.size if x.tag in HEADINGS else x.headed
            up.holds_main = up.holds_main or x.holds_main
            if x.tag in BLOCK:
                stream.append((up, None))
            node = up
            if x is to:
                return up

    def text(raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            stream.append((node, raw))
            if plain := " ".join(raw.split()):
                node.parts.append(plain)
                node.size += len(plain)
                if node.link:
                    node.linked += len(plain)

    def innermost(names) -> Node:
        return max((open_[t][-1] for t in names if open_.get(t)), key=lambda x: x.depth, default=root)

    def open_one(names, fence) -> Node | None:
        """The innermost open element of these names, unless one of the fence stands further in."""
        x = innermost(names)
        return None if x is root or x.depth < innermost(fence).depth else x

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            found = open_one((tag,), () if tag in CLOSE_ANY else INNER_FENCE)
            if found is not None:
                close(found)
            elif tag == "p":
                stream.append((node, None))
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag in ENDS_P and (p := open_one(("p",), FENCE)) is not None:
            close(p)
        if tag in HEADINGS and node.tag in HEADINGS:
            close(node)
        if tag in CLOSES and (same := open_one(CLOSES[tag], FENCE)) is not None:
            close(same)
        if tag in VOID:
            stream.append((node, None if tag == "hr" else " "))
            continue
        if tag == "body" and (head := open_one(("head",), ())) is not None:
            close(head)
        raw = m[3] or m[6] or ""
        bad, main, vague, talk = marks(tag, raw, node)
        if tag in BLOCK:
            stream.append((node, None))
        node = Node(tag, node, bad, main, vague, talk)
        node.first = len(stream)
        nodes.append(node)
        open_.setdefault(tag, []).append(node)
        if raw.rstrip().endswith("/") and tag in ("svg", "path"):
            close(node)
    while node is not root:
        close(node)
    return root, nodes, stream


def may_go(x: Node) -> bool | None:
    """Whether a subtree may be template: True by its pages, None by its different articles.

    By pages: outside the article, or a link list in it. By articles, so that an article
    that a site repeats keeps its boxes: any other box in it, unless only headings would be
    left of the article.
    """
    if not x.size or x.holds_main or x.tag in ("html", "body", "head"):
        return False
    if not x.in_main or (x.tag in BLOCK and 2 * x.linked >= x.size):
        return True
    left = x.inner.size - x.inner.headed - (x.size - x.headed)
    return None if x.tag in BOX and left > 0 else False


class Outline:
    """A page's text in order, where its blocks end, and its subtrees that may be template.

    ``content`` is a hash of what the page shows. Subtrees are (hash, hash of the article or
    None, start, end): the span of text that goes with them, empty where that is gone anyway.
    """

    def __init__(self, page: str):
        root, nodes, stream = parse(page)
        found = any(x.main and not x.own for x in nodes)
        for x in nodes:  # elements come after those that hold them
            x.gone = x.up.gone or (x.own and not (x.holds_main and x.tag not in ("article", "main")))
        kept = ["" if t is None or x.gone or not (x.in_main or not found) else t for x, t in stream]
        at = [0, *accumulate(map(len, kept))]
        self.body = "".join(kept)
        self.cuts = sorted({at[k] for k, (_, t) in enumerate(stream) if t is None} - {0, at[-1]})
        self.content = xxhash.xxh64_intdigest("\x01".join(root.parts)) - (1 << 63)
        self.subtrees = [(x.key, None if way else x.inner.key, at[x.first], at[x.last]) for x in nodes if (way := may_go(x)) is not False]


def rest(body: str, cuts: list[int], gone: list[tuple[int, int]]) -> str:
    """The blocks of a page's text, without the spans ``gone``."""
    blocks, gone, k = [], sorted(gone), 0
    for at, end in zip([0, *cuts], [*cuts, len(body)], strict=True):
        while k < len(gone) and gone[k][1] <= at:
            k += 1
        block, j = [], k
        while j < len(gone) and gone[j][0] < end:
            block.append(body[at : max(at, gone[j][0])])
            at = max(at, gone[j][1])
            j += 1
        block.append(body[at : max(at, end)])
        if plain := " ".join("".join(block).split()):
            blocks.append(plain)
    return "\n".join(blocks)


def main_text(page: str | None, gone: set[int]) -> str:
    """What stays of the page when subtrees with the hashes ``gone`` are deleted; the whole if nothing would."""
    x = Outline(page or "")
    spans = [(a, b) for key, _, a, b in x.subtrees if key in gone]
    return (rest(x.body, x.cuts, spans) if spans else "") or rest(x.body, x.cuts, [])


OUTLINE = pa.schema(
    [("page", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("content", pa.int64()), ("body", pa.string()), ("cuts", pa.list_(pa.int32()))]
    + [("subtrees", pa.list_(pa.struct([("node", pa.int64()), ("article", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])))]
)


def outline_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (page_id, url, host, html): outlines, each under a name of its own."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            own = [Outline(page or "") for page in part.column(3).to_pylist()]
            trees = [x.subtrees for x in own]
            flat = [t for x in trees for t in x]
            fields = [pa.array([t[k] for t in flat], type=OUTLINE.field("subtrees").type.value_type.field(k).type) for k in range(4)]
            bounds = pa.array([0, *accumulate(map(len, trees))], type=pa.int32())
            held = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(fields, ["node", "article", "a", "b"]))
            names = pa.array([uuid.uuid4().int >> 65 for _ in own], type=pa.int64())
            yield pa.RecordBatch.from_arrays([names, *part.columns[:3], pa.array([x.content for x in own], pa.int64()), pa.array([x.body for x in own], pa.string()), pa.array([x.cuts for x in own], pa.list_(pa.int32())), held], schema=OUTLINE)


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (page_id, url, body, cuts, spans): texts; a page that would lose all keeps all."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = []
            for body, cuts, spans in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                text = rest(body, cuts, [(s["a"], s["b"]) for s in spans]) if spans else ""
                texts.append(text or rest(body, cuts, []))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, type=pa.string())], names=["page_id", "url", "text"])


def site_templates(outlines: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(host, node, by_article): subtrees on enough different pages, or in enough different articles, of their host."""
    sited = outlines.where("host <> ''")
    pages = sited.groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = sited.select("host", "content", F.explode("subtrees").alias("t"))
    by_article = F.col("t.article").isNotNull()
    # one row for each subtree and page content first: a host of any size is dealt out by its subtrees
    seen = seen.groupBy("host", F.col("t.node").alias("node"), by_article.alias("by_article"), F.coalesce("t.article", "content").alias("on")).agg(F.lit(1).alias("one"))
    counted = seen.groupBy("host", "node", "by_article").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    return counted.join(pages, "host").where(F.col("n") >= min_share * F.col("pages")).select("host", "node", "by_article")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text) for every row of ``pages``; text is empty where nothing is left.

    Null html is empty. Pages whose url names no host (null, malformed) are compared with
    no others: only marked elements go. Pages that show the same count once, however often
    they stand in the table; so no number of copies makes a page a template of itself, and
    a page that would lose all its text by the counts loses nothing by them. Rows with null
    or repeated ids are pages like others. A block is the text between the bounds of block
    elements; its white space becomes single spaces. Other columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), HOST, 1)), F.lit(""))
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(page).alias("html"))
    kind = "page long, page_id long, url string, host string, content long, body string, cuts array<int>, subtrees array<struct<node: long, article: long, a: int, b: int>>"
    outlines = scratch.table(own.mapInArrow(outline_rows, kind), "outlines")
    # subtrees whose text is gone anyway are counted, but nothing is left to delete
    able = F.col("host") != ""
    live = outlines.where(able).select("page", "host", F.explode(F.filter("subtrees", lambda t: t["b"] > t["a"])).alias("t"))
    live = live.select("page", "host", F.col("t.node").alias("node"), F.col("t.article").isNotNull().alias("by_article"), F.struct("t.a", "t.b").alias("span"))
    template = site_templates(outlines, min_pages, min_share)
    # a table, so that the join with the pages is planned by its size; pages without such a subtree stay out of it
    spans = scratch.table(live.join(template, ["host", "node", "by_article"]).groupBy("page").agg(F.collect_list("span").alias("spans")), "template-spans")
    open_ = able & F.exists("subtrees", lambda t: t["b"] > t["a"])
    whole = outlines.where(~open_).withColumn("spans", F.array().cast(spans.schema["spans"].dataType))
    both = outlines.where(open_).join(spans, "page", "left").unionByName(whole)
    return both.select("page_id", "url", "body", "cuts", "spans").mapInArrow(text_rows, "page_id long, url string, text string")
