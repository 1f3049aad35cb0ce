"""Main text of web pages by wrapper induction.

Pages of one host come from one template.  A few reference pages of a host are
aligned by simple tree matching (the largest order-preserving match of two
trees whose matched nodes have equal labels and matched parents).  Nodes that
match in all references with the same text are template; matched nodes whose
text differs, and children that only some references have, are slots.  The
content region is the article element that holds most slot text, or else the
lowest node above all slots that are neither navigation nor links.  Every page
of the host is matched against this template, and the text blocks of its
content region are its main text, without boilerplate elements inside.  Outside
article elements nodes that are constant in the references are dropped.

Pages of a host whose content lies at the same label path (numbers left out)
are of one type.  Each type has a template of its own; a page of a type without
one takes the host's.  Over all distinct pages of a type the digest of every
subtree is counted with its label path: what more than ``REFERENCES`` pages and
``COMMON`` of the type hold at one path is dropped anywhere, inside article
elements too, so a paragraph that a few pages share stays; a page that holds
nothing else keeps its text.

On Spark: one Arrow pass makes types and digests, pages that repeat go by an
aggregate on their hash, digests are counted with map-side combine.  References
are chosen by a window that keeps one page for each of ``REFERENCES`` hash
classes of a host and of a type (limited before the shuffle, so a host with a
third of all pages moves a bounded number of pages); one small group makes a
template; templates and common digests are broadcast up to ``BROADCAST_BYTES``
(measured), beyond that joined by a shuffle that AQE can split; the pages pass
through an Arrow map for the type and one for the text.  Nothing of a page is cut.

Defined results: null html is an empty page with empty text; a page without a
host, or of a host with one distinct page, is its own reference; repeated rows
alike; markup may be broken anywhere (unclosed elements, cut tags) and nested to
any depth; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from bisect import bisect_right
from collections.abc import Generator, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftsmith.session import checkpoint_dir

REFERENCES = 8
COMMON = 0.9
BROADCAST_BYTES = 16 << 20

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPE = frozenset("ul ol dl table select article section main nav aside header footer div body html".split())
DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe object svg math canvas button select option input textarea dialog menu head title audio video xmp noembed noframes".split()
)
ARTICLE = frozenset(("article", "main"))
# Fixed value: words in class, id or role that name boilerplate.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|breadcrumb|breadcrumbs|pagination|pager|sidebar|side|widget|footer|masthead|topbar|toolbar|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|signup|login|search|comment|comments|respond|disqus|reply|replies|complementary|contentinfo|skip|hidden)(?:$|[\s_-])",
    re.I,
)
_STATE = re.compile(r"\b(?:has|with|without|no|is|js)[-_][\w-]+", re.I)  # says something of the page, not what the element is
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+(?:>|\Z)|<(?=/?[a-zA-Z])[^>]*+\Z""", re.S)
_NAME = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


_DIGITS = re.compile(r"\d+")
# Fixed value: those of them that also name boilerplate on an article element.
NAMED_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|sponsored|promo|comment|comments|reply|replies|related|recommended)(?:$|[\s_-])", re.I)


class Node:
    """``items`` are texts and nodes in page order."""

    __slots__ = ("items", "label", "named", "parent", "tag")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag, self.parent, self.items = tag, parent, []
        self.label = f"{tag} {names}" if names else tag
        self.named = names

    @property
    def dropped(self) -> bool:
        if self.tag in DROPPED:
            return True
        if self.named and self.tag not in ("body", "html") and (NAMED_ARTICLE if self.tag in ARTICLE else NAMED).search(_STATE.sub("", self.named)):
            return True
        return self.tag == "header" and not self.inside_article()

    def inside_article(self) -> bool:
        at = self.parent
        while at is not None:
            if at.tag in ARTICLE:
                return True
            at = at.parent
        return False

    @property
    def blocks(self) -> list[Node]:
        return [x for x in self.items if not isinstance(x, str) and x.tag not in INLINE]


def parse(page: str) -> Node:
    """Tree of a page; never fails."""
    root = Node("#page", "", None)
    at, pos, raw = root, 0, None
    path, where, scopes = [root], {}, []  # open nodes, their depths by tag, depths of scopes

    def close(depth: int) -> Node:
        while len(path) > depth:
            tag = path.pop().tag
            where[tag].pop()
            if tag in SCOPE:
                scopes.pop()
        return path[-1]

    for m in _TOKEN.finditer(page):
        if m.start() < pos:
            continue  # inside a raw element
        if m.start() > pos:
            at.items.append(page[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        scope = scopes[-1] if scopes else 0
        if m[1]:
            if where.get(tag) and (tag in SCOPE or where[tag][-1] > scope):
                at = close(where[tag][-1])
            continue
        if tag not in INLINE:
            ends = [d[k] for t in ("p", *CLOSES.get(tag, ())) if (d := where.get(t)) and (k := bisect_right(d, scope)) < len(d)]
            if ends:
                at = close(min(ends))
        names = " ".join((a or b or c) for _, a, b, c in _NAME.findall(m[3])) if "=" in m[3] else ""
        node = Node(tag, names, at)
        if tag == "br":
            at.items.append("\n")
        at.items.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in SCOPE:
            continue
        if tag in RAW:
            raw = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
            node.items.append(page[pos : raw.start() if raw else len(page)])
            pos = raw.end() if raw else len(page)
            continue
        where.setdefault(tag, []).append(len(path))
        if tag in SCOPE:
            scopes.append(len(path))
        path.append(node)
        at = node
    if pos < len(page):
        at.items.append(page[pos:])
    return root


def block_texts(node: Node, skip=lambda n: False) -> Iterator[str]:
    """Texts of the blocks below ``node`` in page order, boilerplate left out."""
    run: list[str] = []

    def flush() -> Iterator[str]:
        if run:
            t = " ".join("".join(run).split())
            run.clear()
            if t:
                yield t

    stack: list[str | Node | None] = list(reversed(node.items))  # None: the end of a block
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(html_lib.unescape(x) if "&" in x else x)
        elif x is None:
            yield from flush()
        elif x.dropped or skip(x):
            continue
        else:
            if x.tag not in INLINE:
                yield from flush()
                stack.append(None)
            stack.extend(reversed(x.items))
    yield from flush()


def own_text(node: Node) -> tuple[str, int]:
    """Text of a node outside its blocks, and how much of it is in links."""
    parts: list[str] = []
    linked = 0
    stack = [(x, False) for x in reversed(node.items)]
    while stack:
        x, link = stack.pop()
        if isinstance(x, str):
            t = x.strip()
            if t:
                parts.append(t)
                linked += len(t) * link
        elif x.tag in INLINE and not x.dropped:
            stack.extend((y, link or x.tag == "a") for y in reversed(x.items))
    return " ".join(" ".join(parts).split()), linked


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching over block elements: size and matched pairs."""
    if a.label != b.label:
        return 0, []
    stack, found = [_aligned(a, b)], None
    while True:
        try:
            pair = stack[-1].send(found)
        except StopIteration as done:
            stack.pop()
            found = done.value
            if not stack:
                return found
        else:
            stack.append(_aligned(*pair))
            found = None


def _aligned(a: Node, b: Node) -> Generator[tuple[Node, Node], tuple | None, tuple]:
    """``match`` of two nodes of one label; asks for those of their children."""
    xs, ys = a.blocks, b.blocks
    leaf = [not y.blocks for y in ys]
    best = [[(0, None, None)] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs, 1):
        row, up = best[i], best[i - 1]
        x_leaf = not x.blocks
        for j, y in enumerate(ys, 1):
            top = up[j] if up[j][0] >= row[j - 1][0] else row[j - 1]
            if x.label == y.label:
                w, pairs = (1, [(x, y)]) if x_leaf or leaf[j - 1] else (yield x, y)
                if up[j - 1][0] + w > top[0]:
                    top = (up[j - 1][0] + w, up[j - 1], pairs)
            row[j] = top
    total, pairs, cell = best[-1][-1][0], [(a, b)], best[-1][-1]
    while cell[2] is not None:
        pairs.extend(cell[2])
        cell = cell[1]
    return total + 1, pairs


class Template:
    """Node of a host's template: label, digest of its constant text (or None),
    content flag, children."""

    __slots__ = ("constant", "content", "items", "label", "tag")

    def __init__(self, label: str, constant: str | None, content: bool, items: list[Template]):
        self.label, self.constant, self.content, self.items = label, constant, content, items
        self.tag = label.split(" ", 1)[0]

    @property
    def blocks(self) -> list[Template]:
        return self.items

    def dump(self) -> list:
        """Nodes in preorder, each with its number of children."""
        out, stack = [], [self]
        while stack:
            t = stack.pop()
            out.append([t.label, t.constant, t.content, len(t.items)])
            stack.extend(reversed(t.items))
        return out

    @staticmethod
    def load(x: list) -> Template:
        stack: list[Template] = []
        for label, constant, content, n in reversed(x):
            items = [stack.pop() for _ in range(n)]
            stack.append(Template(label, constant, content, items))
        return stack[0]


def _content_root(root: Node, constant: set[int]) -> Node:
    """The node above the content slots of a tree (``constant``: ids of nodes
    whose text the references share)."""
    weight: dict[int, int] = {}  # slot text below each node
    leaves: list[tuple[Node, int]] = []
    articles: list[Node] = []
    stack, seen = [root], []
    while stack:
        n = stack.pop()
        if n.dropped:
            continue
        seen.append(n)
        if n.tag in ARTICLE:
            articles.append(n)
        text, linked = own_text(n)
        if len(text) > 2 * linked and id(n) not in constant:
            leaves.append((n, len(text) - linked))
            weight[id(n)] = len(text) - linked
        stack.extend(n.blocks)
    for n in reversed(seen):  # children come after their parents
        if n is not root and id(n) in weight:
            weight[id(n.parent)] = weight.get(id(n.parent), 0) + weight[id(n)]
    full = [n for n in articles if weight.get(id(n))]
    if full:
        # nested: the innermost element that still has (nearly) all of the outer one's text
        top = max(full, key=lambda n: weight[id(n)])
        for n in full:
            if n is not top and weight[id(n)] >= 0.9 * weight[id(top)] and _below(n, top):
                top = n
        return top
    if not leaves:
        return root
    at = leaves[0][0]
    while weight[id(at)] < weight[id(root)]:
        at = at.parent
    return at


def _digest(n: Node) -> str:
    return hashlib.md5(own_text(n)[0].encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _below(n: Node, top: Node) -> bool:
    while n is not None and n is not top:
        n = n.parent
    return n is not None


def _labels(root: Node) -> frozenset[str]:
    out, stack = set(), [root]
    while stack:
        n = stack.pop()
        out.add(n.label)
        stack.extend(n.blocks)
    return frozenset(out)


def alike(trees: list[Node]) -> list[Node]:
    """The largest set of trees that share most of their labels with one of
    them (error pages and other page types drop out), fewest blocks first."""
    sets = [_labels(t) for t in trees]
    near = [[j for j, y in enumerate(sets) if 2 * len(x & y) >= len(x | y)] for x in sets]
    group = max(near, key=len, default=[])
    return sorted((trees[j] for j in group), key=lambda t: len(list(block_texts(t))))


def induce(pages: list[str]) -> Template | None:
    """Template of distinct pages of one host (None for fewer than two alike)."""
    trees = alike([parse(p) for p in dict.fromkeys(pages) if p.strip()])
    if len(trees) < 2:
        return None
    base = trees[0]
    matched: dict[int, int] = {}
    varies: set[int] = set()
    nodes: dict[int, Node] = {}
    for other in trees[1:]:
        for a, b in match(base, other)[1]:
            nodes[id(a)] = a
            matched[id(a)] = matched.get(id(a), 0) + 1
            if own_text(a)[0] != own_text(b)[0]:
                varies.add(id(a))
    shared = {k for k, n in matched.items() if n == len(trees) - 1}
    constant = {k for k in shared if k not in varies and own_text(nodes[k])[0]}
    top = _content_root(base, constant)
    while id(top) not in shared and top.parent is not None:
        top = top.parent

    def made(n: Node) -> Template:
        return Template(n.label, _digest(n) if id(n) in constant else None, n is top, [])

    out = made(base)
    stack = [(base, out)]
    while stack:
        n, t = stack.pop()
        for x in n.blocks:
            if id(x) in shared:
                t.items.append(made(x))
                stack.append((x, t.items[-1]))
    return out


def _number(h: bytes) -> int:
    return int.from_bytes(h[:8], "little", signed=True)


def page_type(root: Node) -> int:
    """Hash of the label path of the content, numbers left out."""
    at, steps = _content_root(root, set()), []
    while at is not None:
        steps.append(_DIGITS.sub("0", at.label))
        at = at.parent
    return _number(hashlib.md5("\x00".join(steps).encode("utf-8", "surrogatepass")).digest())


def subtree_keys(root: Node) -> dict[int, int]:
    """Per node (its id) a hash of its label path and of all text below it, for
    the blocks that hold text and are no boilerplate by name."""
    seen: list[tuple[Node, bytes]] = []
    stack = [(root, b"")]
    while stack:
        n, above = stack.pop()
        if not n.dropped:
            path = hashlib.md5(above + _DIGITS.sub("0", n.label).encode("utf-8", "surrogatepass")).digest()
            seen.append((n, path))
            stack.extend((x, path) for x in n.items if not isinstance(x, str))
    digest: dict[int, bytes] = {}  # of the nodes that hold text
    keys: dict[int, int] = {}
    for n, path in reversed(seen):  # children come after their parents
        parts = [" ".join(x.split()).encode("utf-8", "surrogatepass") if isinstance(x, str) else digest.get(id(x), b"") for x in n.items]
        parts = [x for x in parts if x]
        if parts:
            digest[id(n)] = hashlib.md5(b"\x00".join(parts)).digest()
            if n.tag not in INLINE:
                keys[id(n)] = _number(hashlib.md5(path + digest[id(n)]).digest())
    return keys


def main_text(page: str | None, template: Template | None, common: frozenset[int] = frozenset()) -> str:
    """``common``: subtree keys that nearly all pages of this type hold."""
    if not page:
        return ""
    root = parse(page)
    constant: set[int] = set()
    top = None
    if template is not None:
        for a, t in match(root, template)[1]:
            if t.constant is not None and t.constant == _digest(a):
                constant.add(id(a))
            if t.content:
                top = a
    if top is None or top.tag not in ARTICLE:
        own = _content_root(root, constant)  # no article: the node above this page's slots
        top = own if top is None or own.tag in ARTICLE or _below(own, top) else top
    inside = top.tag in ARTICLE or top.inside_article()
    same = constant if not inside else set()
    if common:
        shared = {k for k, key in subtree_keys(root).items() if key in common}
        text = " ".join(block_texts(top, lambda n: id(n) in same or id(n) in shared))
        if text:
            return text
    text = " ".join(block_texts(top, lambda n: id(n) in same))
    if not text and not inside and (own := _content_root(root, set())).tag in ARTICLE:
        return " ".join(block_texts(own))  # pages that only differ outside one article
    return text


def host_of(url):
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


@F.pandas_udf(T.LongType())
def _type_of(html: pd.Series) -> pd.Series:
    return pd.Series([None if not p else page_type(parse(p)) for p in html], dtype="Int64")


@F.pandas_udf(T.StructType([T.StructField("type", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]))
def _survey(html: pd.Series) -> pd.DataFrame:
    types, keys = [], []
    for p in html:
        root = parse(p)
        types.append(page_type(root))
        keys.append(sorted(set(subtree_keys(root).values())))
    return pd.DataFrame({"type": pd.Series(types, dtype="int64"), "keys": pd.Series(keys, dtype=object)})


def common_subtrees(pages: DataFrame, *, references: int = REFERENCES) -> DataFrame:
    """``(host, type, common)``: keys on nearly all distinct pages of a type,
    from ``pages(host, html)``."""
    x = pages.where(F.col("host").isNotNull() & (F.col("html") != "")).select("host", F.xxhash64("html").alias("h"), _survey("html").alias("s"))
    x = x.select("host", "h", "s.type", "s.keys").dropDuplicates(["host", "h"])
    # a null key counts the pages
    held = x.select("host", "type", F.explode(F.array_append("keys", F.lit(None).cast("long"))).alias("key")).groupBy("host", "type", "key").agg(F.count(F.lit(1)).alias("n"))
    held = held.where(F.col("n") > references).checkpoint()
    all_pages = held.where("key IS NULL").select("host", "type", F.col("n").alias("pages"))
    held = held.where("key IS NOT NULL").join(all_pages, ["host", "type"]).where(F.col("n") >= F.lit(COMMON) * F.col("pages"))
    return held.groupBy("host", "type").agg(F.collect_list("key").alias("common"))  # at most the blocks of a page / COMMON


def host_templates(pages: DataFrame, *, references: int = REFERENCES) -> DataFrame:
    """``(host, type, template)`` (JSON) from ``pages(host, type, html)``; a
    host's own template has a null type."""
    h = F.xxhash64("html")
    x = pages.where(F.col("host").isNotNull() & F.col("html").isNotNull()).withColumn("h", h).withColumn("part", F.pmod("h", F.lit(references)))
    x = x.select("host", "html", "h", "part", F.explode(F.array_distinct(F.array(F.lit(None).cast("long"), F.col("type")))).alias("type"))
    first = F.row_number().over(Window.partitionBy("host", "type", "part").orderBy("h"))
    few = x.withColumn("nth", first).where("nth = 1").select("host", "type", "html", "h")

    def learn(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        t = induce(g.sort_values("h")["html"].tolist())
        kind = pd.Series([None if key[1] is None or pd.isna(key[1]) else int(key[1])], dtype="Int64")
        return pd.DataFrame({"host": [key[0]], "type": kind, "template": [None if t is None else json.dumps(t.dump())]})

    return few.groupBy("host", "type").applyInPandas(learn, "host string, type long, template string").where("template IS NOT NULL")


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", references: int = REFERENCES) -> DataFrame:
    """``id_col, url_col, text, host, has_template`` of every row."""
    checkpoint_dir(pages.sparkSession)
    x = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    common = common_subtrees(x, references=references).checkpoint()
    x = x.withColumn("type", _type_of("html"))
    made = host_templates(x, references=references).checkpoint()
    size = made.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0
    size += common.agg(F.sum(8 * F.size("common") + F.length("host"))).first()[0] or 0
    small = F.broadcast if size <= BROADCAST_BYTES else (lambda side: side)
    whole = made.where("type IS NULL").select(F.col("host").alias("w_host"), F.col("template").alias("w_template"))
    typed = made.where("type IS NOT NULL").select(F.col("host").alias("t_host"), F.col("type").alias("t_type"), F.col("template").alias("t_template"))
    common = common.select(F.col("host").alias("c_host"), F.col("type").alias("c_type"), "common")
    joined = x.join(small(typed), (F.col("host") == F.col("t_host")) & (F.col("type") == F.col("t_type")), "left")
    joined = joined.join(small(whole), F.col("host") == F.col("w_host"), "left")
    joined = joined.join(small(common), (F.col("host") == F.col("c_host")) & (F.col("type") == F.col("c_type")), "left")
    joined = joined.withColumn("template", F.coalesce("t_template", "w_template"))

    @F.pandas_udf("string")
    def text_of(html: pd.Series, template: pd.Series, common: pd.Series) -> pd.Series:
        loaded: dict[str, Template] = {}
        out = []
        for page, t, c in zip(html, template, common):
            if t is not None and t not in loaded:
                loaded[t] = Template.load(json.loads(t))
            out.append(main_text(page, loaded.get(t), frozenset() if c is None else frozenset(c.tolist())))
        return pd.Series(out, dtype=object)

    done = joined.withColumn("text", text_of("html", "template", "common"))
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "host", F.col("template").isNotNull().alias("has_template"))
