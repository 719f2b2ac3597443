"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import text_bytes

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "script style noscript template iframe object embed svg canvas audio video math head title textarea select option "
    "button input form fieldset nav aside footer dialog menu noembed noframes xmp".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
FRAMES = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = BLOCKS - {"html", "body"}
# An opening tag of the key closes an open element of the value, up to the scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words in class, id or role that mark what is not the article, and what may be.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|adslot|banner|sponsor|sponsored|sponsors|promo|"
    r"promos|promoted|promotion|sidebar|side|widget|menu|nav|navbar|navigation|navmenu|breadcrumbs?|"
    r"header|masthead|footer|foot|cookies?|consent|gdpr|notices?|disclaimer|popup|modal|newsletter|subscribe|signup|login|"
    r"comments?|disqus|replies|reply|respond|discussion|share|sharing|social|related|recommended|recommendations?|more-links|pagination|pager|"
    r"toolbar|tags|legal|copyright|skip|search)(?:$|[\s_-])",
    re.I,
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article\w*|main\w*|content|story|entry|post|body|text)(?:$|[\s_-])", re.I)
# Of these, the only ones that cut a paragraph of an article; and what readers wrote.
ADVERT = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsored|promo|promoted)(?:$|[\s_-])", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|reply|respond|discussion)(?:$|[\s_-])", re.I)
# Says what an element has beside it, not what it is.
BESIDE = re.compile(r"(?<![^\s_-])(?:with|without|has|no)[_-]\w+", re.I)
UNLIKELY_ROLES = frozenset(
    "navigation banner complementary contentinfo search form menu menubar toolbar alert alertdialog dialog".split()
)
TAG = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "likely", "names", "named", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, likely: bool = False, names: str = ""):
        self.tag, self.parent, self.cut, self.likely, self.names = tag, parent, cut, likely, names
        self.named = False  # cut for its names alone
        self.children: list[Node | str] = []
        self.score, self.chars, self.linked = 0.0, 0, 0


def _flags(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether the element is hidden or never text, whether its names suggest the article, and its names."""
    if tag in NEVER:
        return True, False, ""
    if not attributes or attributes.isspace():
        return False, tag in FRAMES, ""
    names, cut = "", False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            names += f" {value}"
        elif name == "role":
            cut |= value.strip().lower() in UNLIKELY_ROLES
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            cut = True
        elif name == "style" and HIDDEN.search(value):
            cut = True
    likely = tag in FRAMES or bool(names and LIKELY.search(names))
    return cut, likely, names


def _cut_by_name(node: Node) -> bool:
    """Whether class or id say that the element is not the article; of an article's paragraphs only adverts are."""
    if not node.names or node.tag in ("html", "body", *FRAMES):
        return False
    names = BESIDE.sub(" ", node.names)
    if not UNLIKELY.search(names):
        return False
    if node.tag in PARAGRAPHS and node.tag != "li" and not ADVERT.search(names):
        up = node.parent
        while up is not None and up.tag not in FRAMES:
            up = up.parent
        return up is None
    return True


def parse(page: str) -> Node:
    """A tree of elements and texts; unclosed and misnested tags are repaired."""
    root = Node("#root", None)
    here, at, size = root, 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            here.children.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            node = here
            while node is not root and node.tag != tag:
                if tag not in BLOCKS and node.tag in BLOCKS:
                    node = root  # an inline end tag does not close a block
                    break
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        attributes = m[3] or ""
        if tag in ENDS_PARAGRAPH:
            node = here
            while node is not root and node.tag != "p":
                if node.tag in BLOCKS:
                    node = root
                    break
                node = node.parent
            if node is not root:
                here = node.parent
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            node = here
            while node is not root and node.tag not in scope:
                if node.tag in ends:
                    here = node.parent
                node = node.parent
        cut, likely, names = _flags(tag, attributes)
        if tag == "header":  # the page's header, not the article's
            node = here
            while node is not root and node.tag not in ("article", "main"):
                node = node.parent
            cut = cut or node is root
        child = Node(tag, here, cut, likely, names)
        if not cut and _cut_by_name(child):
            child.cut = child.named = True
        here.children.append(child)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        here = child
    return root


def _order(root: Node) -> list[Node]:
    """Elements in page order, without those that are cut."""
    out, left = [], [root]
    while left:
        node = left.pop()
        out.append(node)
        left.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.cut)
    return out


def _score(nodes: list[Node]) -> None:
    """Length, linked length and score of every element, bottom up."""
    for node in reversed(nodes):
        own = [c for c in node.children if isinstance(c, str)]
        node.chars += sum(len(SPACE.sub(" ", html.unescape(c)).strip()) for c in own)
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for node in nodes:
        direct = node.tag in PARAGRAPHS
        if not direct and node.tag in BLOCKS:
            direct = any(isinstance(c, str) and not c.isspace() for c in node.children)
        if not direct or node.chars < 1 or node.tag in HEADINGS:
            continue
        text = _plain(node)
        points = 1.0 + text.count(",") + min(3.0, node.chars / 100.0)
        up, share = node.parent if node.tag in PARAGRAPHS else node, 1.0
        for depth in range(5):
            if up is None or up.tag == "#root":
                break
            up.score += points * share
            up, share = up.parent, (0.5 if depth == 0 else 1.0 / (3.0 * (depth + 1)))
    for node in nodes:
        if node.score:
            node.score *= (1.0 - _link_density(node)) * (1.25 if node.likely else 1.0)


def _link_density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _plain(node: Node) -> str:
    out, left = [], [node]
    while left:
        item = left.pop()
        if isinstance(item, str):
            out.append(item)
        elif not item.cut:
            left.extend(reversed(item.children))
    return "".join(out)


def _lines(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below ``nodes`` in page order, white space made single."""
    lines: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            lines.append(text)

    left: list = list(reversed(nodes))
    while left:
        item = left.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            held.append(html.unescape(item))
        elif item.cut:
            continue
        elif item.tag == "br":
            held.append(" ")
        elif item.tag in BLOCKS:
            flush()
            left.append(None)
            left.extend(reversed(item.children))
        else:
            left.extend(reversed(item.children))
    flush()
    return lines


def _unlinked(node: Node) -> int:
    """Characters outside links, in elements cut by name too."""
    total, left = 0, [node]
    while left:
        item = left.pop()
        if isinstance(item, str):
            total += len(item.strip())
        elif item.tag != "a" and (item.named or not item.cut):
            left.extend(item.children)
    return total


def _restore(root: Node, found: str) -> bool:
    """Take back the cut of elements around the article; whether there were any.

    Such an element holds most of the page's unlinked text and, if its names do not
    speak for it, an article or main element, or four times what was ``found``
    without it. What readers wrote comes back only if nothing else was found.
    """
    named, left = [], [root]
    while left:
        node = left.pop()
        if node.named:
            named.append(node)
        left.extend(c for c in node.children if isinstance(c, Node) and (c.named or not c.cut))
    if not named:
        return False
    total, restored = _unlinked(root), False
    for node in named:
        size = _unlinked(node)
        if 2 * size <= total or not size:
            continue
        if COMMENTS.search(node.names):
            around = not found
        else:
            around = node.likely or 4 * len(found) < size or _holds_frame(node)
        if around:
            node.cut = node.named = False
            restored = True
    return restored


def _holds_frame(node: Node) -> bool:
    left = [node]
    while left:
        item = left.pop()
        if item.tag in FRAMES and not COMMENTS.search(item.names):
            return True
        left.extend(c for c in item.children if isinstance(c, Node) and (c.named or not c.cut))
    return False


def main_text(page: str) -> str:
    """The article of a page: the best container and those of its siblings that read like it."""
    root = parse(page)
    found = _article(root)
    if _restore(root, found):
        found = _article(root)
    return found


def _article(root: Node) -> str:
    nodes = _order(root)
    for node in nodes:
        node.score, node.chars, node.linked = 0.0, 0, 0
    _score(nodes)
    best = max(nodes, key=lambda n: n.score, default=root)
    if best.score <= 0:
        # No paragraph earned a point: what is left after cutting is short, or is one heading.
        kept = [n for n in nodes if n.likely and n.tag in FRAMES][:1]
        return "\n".join(_lines(kept or [root]))
    # An element that holds little besides the best one is the better frame of the article.
    while best.parent is not None and best.parent.likely and best.parent.tag in FRAMES:
        best = best.parent
    if best.parent is None or best.tag in ("body", "html"):
        return "\n".join(_lines([best]))
    kept = []
    for item in best.parent.children:
        if item is best:
            kept.append(item)
        elif isinstance(item, Node) and not item.cut and item.tag in BLOCKS:
            density = _link_density(item)
            alike = item.tag == best.tag and item.names == best.names and (item.names or item.tag == "section")
            if item.score >= 0.2 * best.score or (alike and item.score > 0 and density < 0.25):
                kept.append(item)
            elif item.tag in PARAGRAPHS and item.chars and (
                (item.tag in HEADINGS and density < 0.5)
                or (item.chars > 80 and density < 0.25)
                or (density == 0 and re.search(r"[.!?](?:\s|$)", _plain(item)))
            ):
                kept.append(item)
    return "\n".join(_lines(kept))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` of every page, from the whole html.

    A null or empty page, and one without any text, gives an empty text. Bytes
    that are no UTF-8 become the replacement character. Each page is handled on
    its own, so there is no shuffle; repeated rows give repeated results and
    other columns are not read. Very deep nesting needs no recursion.
    """
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts = [main_text(p.as_py().decode("utf-8", "replace")) for p in column]
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*keep, "text", "n_chars"],
            )

    narrow = pages.select(*keep, text_bytes(html_col).alias("_html"))
    schema = narrow.drop("_html").withColumns(
        {"text": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("bigint")}
    ).schema
    return narrow.mapInArrow(run, schema)
