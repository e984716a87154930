"""HTML extraction by site style trees.

All pages of a host are merged into one tree: an element is known by the path of its ancestors' styles, and a style is
the sequence of child elements that a page has there (Yi, Liu and Li, 2003). An element's presentation importance is the
entropy of its styles over the pages that have it; a leaf's content importance falls with the entropy of its texts,
links and images over pages. The composite of both rises from the leaves; branches in which no element reaches a
threshold are template, and are removed from every page of the host.

Elements whose role HTML itself states are not left to statistics: navigation, headers, footers, asides, forms, scripts,
and elements whose class, id or role names a notice, advert, menu or comments are removed even on hosts with few
pages; text blocks inside an article or main element stay even where many pages repeat them.

1. A pass parses pages and counts styles and contents by element, added up within each batch before they are shuffled.
2. Importances are computed level by level from the deepest, by joins of the counted elements.
3. A second pass removes low branches. Their keys are sent to all executors if they are few; otherwise each page's
   elements are joined with them.

Defined results: null html is an empty page with an empty text; pages with a null or odd url share the host ''; cut tags are
dropped, unknown or incomplete character references stay as they are; elements deeper than ``depth`` count as
content of their ancestor; rows that repeat are each answered; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, map_arrow

GAMMA, THRESHOLD, MIN_PAGES, DEPTH = 0.9, 0.4, 3, 24
#: Keys of low branches that are sent to all executors at most.
BROADCAST_KEYS = 500_000

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section summary table ul".split())
NOISE = frozenset("head nav footer aside form script style noscript template iframe object embed button select option textarea input menu dialog svg canvas audio video map title xmp noembed noframes fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption ul ol dl table tbody tr figure".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side aside footer foot masthead "
    "topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist respond "
    "disqus reply replies widget pagination pager skip skiplink copyright disclaimer".split()
)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|href|src|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("children", "links", "noise", "parent", "sign", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.children, self.links = tag, parent, [], ""
        self.noise = tag in NOISE
        self.sign = tag
        if "=" in attributes or "hidden" in attributes:
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        names = []
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                words = _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())
                names += words
                if not NOISE_WORDS.isdisjoint(words) and self.tag not in ("html", "body", "article", "main"):
                    self.noise = True
                elif self.tag == "article" and not {"comment", "comments", "reply", "ad", "advert", "sponsored", "related", "promo"}.isdisjoint(words):
                    self.noise = True
            elif key == "role":
                names.append(value.lower())
                self.noise |= value.lower() in NOISE_ROLES
            elif key in ("href", "src"):
                self.links = value
            elif key == "hidden" and self.tag not in ("html", "body"):
                self.noise = True
        if names:
            self.sign = self.tag + "." + ".".join(sorted(set(names)))


class _Path:
    """The open elements, and by tag where in them each stands, so that no lookup climbs the tree."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def leave(self, tag: str, scope: tuple[str, ...] = ()) -> None:
        """Closes the nearest open ``tag`` and what is open in it, unless an element of the scope is nearer."""
        found = self.at.get(tag)
        if found and all(found[-1] > self.at[s][-1] for s in scope if self.at.get(s)):
            keep = found[-1]
            while len(self.nodes) > keep:
                self.at[self.nodes.pop().tag].pop()


def parse(page: str) -> Node:
    """The page's tree; children are nodes and, as strings, undecoded texts. Time grows with the page, however deep it nests."""
    root = Node("", None)
    path = _Path(root)
    end, n = 0, len(page)
    while end < n:
        m = _TOKEN.search(page, end)
        at = path.nodes[-1]
        if m is None:
            at.children.append(page[end:])
            break
        if m.start() > end:
            at.children.append(page[end : m.start()])
        end = m.end()
        tag = m[2] or m[5]
        if tag is None or (m[5] and not m[7]):
            continue  # a comment, a declaration, or a tag that the page's end cuts
        tag = tag.lower()
        if m[1] or m[4]:
            path.leave(tag)
            continue
        if tag in CLOSES_P:
            path.leave("p", ("button", "td", "th", "caption"))
        if tag == "li":
            path.leave("li", ("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            path.leave("dt", ("dl",))
            path.leave("dd", ("dl",))
        elif tag in ("td", "th"):
            path.leave("td", ("tr", "table"))
            path.leave("th", ("tr", "table"))
        elif tag == "tr":
            path.leave("tr", ("table",))
        elif tag == "option":
            path.leave("option", ("select",))
        elif tag == "body" and path.nodes[-1].tag == "head":
            path.leave("head")
        at = path.nodes[-1]
        node = Node(tag, at, m[3] or m[6] or "")
        at.children.append(node)
        if tag in RAW:
            close = re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.IGNORECASE).search(page, end)
            end = close.end() if close else n
        elif tag not in VOID:
            path.push(node)
    return root


def _hash(*parts: object) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def _landmark(node: Node) -> bool:
    return node.tag in ("article", "main")


def walk(root: Node, host: str, depth: int = DEPTH) -> Iterator[tuple[Node, int, int, int, int, list[Node], bool]]:
    """Elements of the style tree as ``node, key, parent key, level, siblings, block children, protected``.

    Inline elements are content of the block that they are in. Text blocks inside a landmark, which stay in any case, are
    not counted themselves.
    """
    todo = [(root, _hash(host), 0, 0, 1, False)]
    while todo:
        node, key, parent, level, siblings, inside = todo.pop()
        kids = _blocks(node) if level < depth else []
        yield node, key, parent, level, siblings, kids, inside
        inside = inside or _landmark(node)
        style = "|".join(k.sign for k in kids)
        for i, k in enumerate(kids):
            if not (inside and k.tag in TEXT_BLOCKS) and k.tag != "head":
                todo.append((k, _hash(key, style, i), key, level + 1, len(kids), inside))


def _blocks(node: Node) -> list[Node]:
    """Nearest elements below that are not inline."""
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            if x.tag not in INLINE:
                out.append(x)
            elif x.children:
                todo += reversed(x.children)
    return out


def _contents(node: Node, whole: bool = False) -> list[str]:
    """What a block itself shows: its own text, and the targets of its links and images; of the ``whole`` branch where the
    depth ends, without what HTML itself states to be no content."""
    text, out, todo = [], [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            text.append(x)
        elif x.tag in INLINE or (whole and not x.noise):
            if x.links:
                out.append(x.tag + " " + x.links)
            if whole and x.tag not in INLINE:
                text.append(" ")
                todo.append(" ")
            todo += reversed(x.children)
    shown = " ".join("".join(text).split())
    return [shown, *out] if shown else out


def _stays(node: Node, inside: bool) -> bool:
    """Whether a text block of an article or main element is in the branch; such blocks are of full importance."""
    todo = [(node, inside)]
    while todo:
        x, inside = todo.pop()
        if inside and x.tag in TEXT_BLOCKS:
            return True
        inside = inside or _landmark(x)
        todo += [(k, inside) for k in x.children if isinstance(k, Node) and not k.noise]
    return False


COUNTS = "host string, key long, parent long, level int, siblings int, style long, empty boolean, feature long, n long"
TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]


def _count(depth: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COUNTS.split(", ")]
        for batch in batches:
            seen: Counter[tuple] = Counter()
            for host, page in zip(batch.column("host"), batch.column("html"), strict=True):
                host = host.as_py()
                for node, key, parent, level, siblings, kids, inside in walk(parse(page.as_py() or ""), host, depth):
                    style = "|".join(k.sign for k in kids)
                    seen[host, key, parent, level, siblings, _hash(style), not kids and not (level >= depth and _stays(node, inside)), None] += 1
                    for c in set(_contents(node, level >= depth)):
                        seen[host, key, parent, level, siblings, None, None, _hash(c)] += 1
            rows = list(seen.items())
            for i in range(0, len(rows), 50_000):
                cols = zip(*[(*k, n) for k, n in rows[i : i + 50_000]], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES, strict=True)], names)

    return run


def importances(pages: DataFrame, scratch: Scratch, *, gamma: float = GAMMA, depth: int = DEPTH) -> DataFrame:
    """``host, key, parent, level, pages, importance, peak`` of the merged trees; ``peak`` is the highest importance in the
    branch. ``pages`` has ``host, html``."""
    counts = map_arrow(pages.select("host", "html"), _count(depth), COUNTS).groupBy("host", "key", "parent", "level", "siblings", "style", "empty", "feature").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "counts")
    nlogn = F.sum(F.col("n") * F.log("n"))
    own = counts.where("feature is null").groupBy("host", "key", "parent", "level", "siblings").agg(
        F.sum("n").alias("pages"), nlogn.alias("nlogn"), F.count("*").alias("styles"), F.sum(F.when(F.col("empty"), F.col("n")).otherwise(0)).alias("bare")
    )
    shown = counts.where("feature is not null").groupBy("host", "key").agg(F.sum(F.log("n")).alias("logs"), F.count("*").alias("features"))
    m = F.log("pages")
    presentation = F.when(F.col("pages") <= 1, 1.0).otherwise((m - F.col("nlogn") / F.col("pages")) / m)
    # a feature that n pages share evenly has the entropy log n over log m
    content = F.when(F.col("pages") <= 1, 1.0).when(F.col("features").isNull(), 0.0).otherwise(1 - F.col("logs") / F.col("features") / m)
    own = own.join(shown, ["host", "key"], "left").select(
        "host", "key", "parent", "level", "siblings", "pages", "styles", (F.col("bare") / F.col("pages")).alias("bare"), presentation.alias("presentation"), content.alias("content")
    )
    own = scratch.save(own, "elements")
    deepest = own.agg(F.max("level")).first()[0]
    below, done = None, []
    for level in range(deepest if deepest is not None else -1, -1, -1):
        at = own.where(F.col("level") == level)
        if below is None:
            at = at.withColumns({"sum": F.lit(0.0), "share": F.lit(0.0), "peak": F.lit(0.0)})
        else:
            up = below.groupBy("host", F.col("parent").alias("key")).agg(F.sum(F.col("importance") * F.col("pages") / F.col("siblings")).alias("sum"), F.sum(F.col("pages") / F.col("siblings")).alias("share"), F.max("peak").alias("peak"))
            zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
            at = at.join(up, ["host", "key"], "left").withColumns({"sum": zero("sum") / F.col("pages"), "share": zero("share") / F.col("pages"), "peak": zero("peak")})
        # children that were not counted are text of an article: of full importance
        rest = F.greatest(F.lit(0.0), 1 - F.col("share") - F.col("bare"))
        inner = F.col("sum") + F.col("bare") * F.col("content") + rest
        fade = F.pow(F.lit(gamma), F.col("styles"))
        whole = F.when(F.col("bare") >= 1, F.col("content")).otherwise((1 - fade) * F.col("presentation") + fade * inner)
        peak = F.when(rest > 1e-9, 1.0).otherwise(F.greatest("peak", "importance"))
        at = at.withColumn("importance", F.round(whole, 9)).withColumn("peak", peak)
        below = scratch.save(at.select("host", "key", "parent", "level", "siblings", "pages", "importance", "peak"), f"level{level}")
        done.append(below)
    if not done:
        return own.select("host", "key", "parent", "level", "pages", F.lit(1.0).alias("importance"), F.lit(1.0).alias("peak"))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("host", "key", "parent", "level", "pages", "importance", "peak")


def extract(page: str, host: str, low: set[int] | frozenset[int], depth: int = DEPTH) -> str:
    """The page's main text: a line for each block that is neither noise nor in a low branch."""
    root = parse(page)
    if low:
        for node, key, _, level, _, _, inside in walk(root, host, depth):
            if level > 1 and key in low and not _landmark(node) and not (inside and node.tag in TEXT_BLOCKS):
                node.noise = True
    content = _content(root)
    lines: list[str] = []
    for top in content:
        part: list[str] = []
        _lines(top, lines, part, bool(top.parent) and _within(top))
        _flush(lines, part)
    return "\n".join(lines)


def _within(node: Node | None) -> bool:
    while node is not None:
        if _landmark(node):
            return True
        node = node.parent
    return False


def _content(root: Node) -> list[Node]:
    """The outermost articles and main elements, else the whole page."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.noise:
            continue
        if _landmark(x):
            found.append(x)
            continue
        todo += [k for k in reversed(x.children) if isinstance(k, Node)]
    return found or [root]


def _flush(lines: list[str], part: list[str]) -> None:
    if part:
        text = " ".join(html.unescape("".join(part)).split())
        if text:
            lines.append(text)
        part.clear()


def _lines(top: Node, lines: list[str], part: list[str], inside: bool) -> None:
    """Appends the blocks of a branch; without recursion, as pages may nest deeply."""
    todo: list[object] = list(reversed(top.children))
    while todo:
        x = todo.pop()
        if x is None:
            _flush(lines, part)
        elif isinstance(x, str):
            part.append(x)
        elif x.noise or (x.tag == "header" and not inside):
            if x.tag not in INLINE:
                _flush(lines, part)
        elif x.tag == "br":
            part.append(" ")
        elif x.tag in INLINE:
            todo += reversed(x.children)
        else:
            _flush(lines, part)
            todo.append(None)
            todo += reversed(x.children)


def _texts(low: frozenset[int] | None, depth: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("low") if low is None else [None] * len(batch)
            made = [extract(p.as_py() or "", h.as_py(), low if low is not None else frozenset(k.as_py() or ()), depth) for p, h, k in zip(batch.column("html"), batch.column("host"), own, strict=True)]
            keep = [batch.column(c) for c in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def _keys(depth: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, keys = [], []
            for digest, host, page in zip(batch.column("digest"), batch.column("host"), batch.column("html"), strict=True):
                own = [key for _, key, *_ in walk(parse(page.as_py() or ""), host.as_py(), depth)]
                pages += [digest.as_py()] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.binary()), pa.array(keys, pa.int64())], ["digest", "key"])

    return run


def main_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", gamma: float = GAMMA, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES, depth: int = DEPTH,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """``page_id, url, text, n_chars``, one row per row of ``pages``."""
    scratch = Scratch(pages.sparkSession, "html")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    tree = importances(rows, scratch, gamma=gamma, depth=depth)
    low = scratch.save(tree.where((F.col("peak") < threshold) & (F.col("pages") >= min_pages)).select("key").distinct(), "low")
    out = "page_id long, url string, text string, n_chars long"
    rows = rows.withColumn("page_id", F.col("page_id").cast("long"))
    if low.count() <= broadcast_keys:
        return map_arrow(rows, _texts(frozenset(r[0] for r in low.collect()), depth), out)
    # the other way: each distinct page's elements meet the low ones, and its own few come back to it
    digest = F.unhex(F.sha2(F.concat_ws("\x1f", "host", F.coalesce("html", F.lit(""))), 256))
    rows = rows.withColumn("digest", digest)
    found = map_arrow(rows.select("digest", "host", "html"), _keys(depth), "digest binary, key long").join(low, "key").groupBy("digest").agg(F.collect_set("key").alias("low"))
    return map_arrow(rows.join(found, "digest", "left"), _texts(None, depth), out)
