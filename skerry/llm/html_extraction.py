"""Main text of web pages by tree scoring.

A tolerant parser makes a tree and leaves out scripts, forms, navigation and other parts that are no article. Readers' comments
are known by structure: neighbours of one kind, each with an author or a time and an offer to answer; so are blocks that are
paid links as a whole. Names of classes are evidence beside that. Paragraphs
pass points for their length and commas to the containers above, which are discounted by their link density; the article or
main around the best container, or else that container and what lies beside it without being mostly links, is kept, block by
block.

Character references are decoded run by run, as browsers do, so markup inside of one leaves it as it stands. A form is left
out unless it holds the article. The work grows with the page's length, however deep its elements nest.

Defined results: null html is empty and gives an empty text. Cut tags, unclosed elements and stray ends are allowed. Null
or repeated page_id: every row is extracted. Of containers with equal scores the first in page order leads. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from skerry.llm.exchange import batches, small_batches, tidy

#: Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object noembed noframes xmp".split())
LEFT_OUT = frozenset("nav footer aside button select option fieldset label dialog menu head canvas audio video".split())
BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure form h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK | LEFT_OUT
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
SCOPES = frozenset("ul ol dl table article section main div body html td th blockquote".split())

_NOISE = re.compile(
    r"ad|ads|adv|advert|advertisement|banner|sponsor(?:ed)?|promo|sidebar|side|widget|nav|navbar|navigation|menu|breadcrumbs?|toolbar|"
    r"footer|foot|copyright|cookies?|consent|notice|alert|popup|modal|overlay|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|"
    r"comments?|commentlist|discussions?|disqus|replies|reply|respond|pagination|pager|hidden|skip"
)
#: Names that only advert slots and their suppliers have; has-, no- and with- before them speak of something else.
_SLOT = re.compile(r"ads(?!or)[a-z]+|ad(?:slot|unit|box|banner|frame|space|zone|choices|container|label|tag)s?|dfp|gpt|taboola|outbrain|teads|doubleclick|criteo|revcontent|mgid")
_WITHOUT = frozenset("has no with without is not".split())
_HEADER = re.compile(r"header|masthead")
#: Words that may stand beside a noise word in a class or id; others (has-sidebar, social-issues) make it something else.
_BESIDE = re.compile(
    r"\d*|the|js|wp|site|page|main|global|web|app|top|bottom|left|right|upper|lower|center|middle|primary|secondary|tertiary|post|posts|entry|article|articles|blog|story|stories|"
    r"content|text|body|inner|outer|container|wrapper|wrap|holder|box|block|blocks|area|section|region|panel|column|col|row|bar|strip|slot|unit|zone|list|lists|links?|"
    r"item|items|icons?|buttons?|btns?|btn|media|network|follow|form|forms|thread|title|heading|label|header|head|group|module|component|template|mobile|desktop|sticky|fixed|"
    r"google|facebook|twitter|visually|user|desk|tools?|more|most|popular|reader|readers|leaderboard|skyscraper|mpu|dfp|gpt|policy|message|dialog|window|to|a|it|us|tags?|cat|categories|iframe|frame|div|ins|lazy|async|responsive"
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|rel|itemprop|datetime|href|hidden|aria-hidden|data-ad[\w-]*|data-google[\w-]*)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)


#: An element left out for its class or id may turn out to hold the article; others may not.
BY_NAME, SURELY = 1, 2


#: What tells a reader's contribution: who and when, and an offer to answer. Evidence only beside a repeated structure.
_SIGNED = re.compile(r"authors?|avatar|byline|user(?:name)?|commenter|nickname|timestamp|time|date(?:time)?|posted|published")
_ANSWER = re.compile(r"reply|respond|answer|quote|report|upvote|downvote|votes?|likes?|karma|permalink")
_ANSWER_TEXTS = frozenset("reply respond answer quote report antworten zitieren melden répondre signaler responder citar denunciar rispondi".split())


class Node:
    __slots__ = ("answer", "guest", "inside", "kind", "linked", "links", "name", "noise", "parent", "parts", "score", "signed", "size", "sold")

    def __init__(self, name: str, parent: Node | None, noise: int = 0):
        self.name, self.parent, self.noise = name, parent, noise  # noise: 0, BY_NAME or SURELY
        self.parts: list[Node | str] = []
        self.score, self.size, self.linked, self.links = 0.0, 0, 0, 0
        self.kind = ""  # its classes without numbers
        self.signed = self.answer = self.sold = False  # evidence of a contribution; a link that is paid for
        self.guest = False  # an article that is a comment or teaser by name
        self.inside = name in ("article", "main") or parent is not None and parent.inside


def _named(value: str, words: re.Pattern) -> bool:
    """Whether a class or an id is one of the words, alone or beside words that don't change what it is."""
    for token in value.lower().split():
        parts = re.split("[_-]+", token)
        if any(map(words.fullmatch, parts)) and all(words.fullmatch(x) or _NOISE.fullmatch(x) or _BESIDE.fullmatch(x) for x in parts):
            return True
    return False


def _is_slot(value: str) -> bool:
    """Whether a class or an id is that of an advert slot."""
    for token in value.lower().split():
        parts = re.split("[_-]+", token)
        if any(map(_SLOT.fullmatch, parts)) and not _WITHOUT.intersection(parts):
            return True
    return False


def _note(node: Node, attributes: str) -> None:
    """What the node's attributes say about its structure."""
    node.signed = node.name == "time"
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        words = re.split(r"[\s_-]+", value)
        if key == "class":
            node.kind = re.sub(r"\d+", "", value)
        if key in ("class", "id", "itemprop", "rel"):
            node.signed |= any(map(_SIGNED.fullmatch, words))
            node.answer |= any(map(_ANSWER.fullmatch, words))
            node.sold |= key == "rel" and "sponsored" in words
        node.signed |= key == "datetime"
        node.answer |= key == "href" and bool(re.search(r"#(?:reply|respond|comment)|replytocom", value))


def _mark_threads(root: Node) -> None:
    """Repeated neighbours of one kind that each are signed and can be answered are readers' contributions; blocks whose text
    all lies in links that are paid for are adverts."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [p for p in x.parts if isinstance(p, Node)]
    if not any(x.answer or x.sold or x.name in ("a", "button") for x in order):
        return
    signed, answer, size, sold = {}, {}, {}, {}
    for x in reversed(order):
        below = [p for p in x.parts if isinstance(p, Node)]
        text = "".join(p for p in x.parts if isinstance(p, str)).strip()
        size[x] = len(text) + sum(size[p] for p in below)
        sold[x] = size[x] if x.sold else sum(sold[p] for p in below)
        signed[x] = x.signed or any(signed[p] for p in below)
        answer[x] = x.answer or x.name in ("a", "button") and text.lower() in _ANSWER_TEXTS or any(answer[p] for p in below)
        kinds: dict[tuple[str, str], list[Node]] = {}
        for p in below:
            if p.name in BLOCK and size[p]:
                kinds.setdefault((p.name, p.kind), []).append(p)
        for alike in kinds.values():
            if len(alike) > 1 and all(signed[p] and answer[p] for p in alike):
                for p in alike:
                    p.noise = p.noise or BY_NAME
                    p.guest = True
        if x.name in BLOCK and x.name not in ("html", "body") and size[x] and sold[x] == size[x]:
            x.noise = x.noise or BY_NAME


def _is_noise(name: str, attributes: str, at: Node) -> int:
    """Whether an element is no part of an article, and how sure that is; an article's own header is a part."""
    if name in LEFT_OUT or name == "header" and not at.inside:
        return SURELY
    noise = BY_NAME if name == "form" else 0  # some pages lie in a form as a whole
    if not attributes or name in ("body", "html", "article", "main"):
        return noise
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in _ROLES:
            return SURELY
        if key in ("class", "id") and (_named(value, _NOISE) or _is_slot(value) or _named(value, _HEADER) and not at.inside) or key.startswith("data-"):
            noise = BY_NAME
    return noise


def _spare(root: Node) -> None:
    """Takes the mark off elements left out by name that hold the article: the article or main with more points than any other,
    or, on pages that have none, most of the points of the page's long paragraphs."""
    order, stack, marked = [], [root], False
    while stack:
        x = stack.pop()
        order.append(x)
        marked |= x.noise == BY_NAME
        stack += [p for p in x.parts if isinstance(p, Node) and p.noise != SURELY]
    if not marked:
        return
    size, linked, seen, long, within = ({} for _ in range(5))  # seen: points outside marked parts; within: of the best article
    for x in reversed(order):
        below = [p for p in x.parts if isinstance(p, Node) and p.noise != SURELY]
        size[x] = sum(len(p.strip()) for p in x.parts if isinstance(p, str)) + sum(size[p] for p in below)
        linked[x] = size[x] if x.name == "a" else sum(linked[p] for p in below)
        seen[x], long[x] = sum(seen[p] for p in below if not p.noise), sum(long[p] for p in below)
        within[x] = max((within[p] for p in below), default=0.0)
        if x.name in BLOCK and size[x] and (text := _own_text(x).strip()):
            points = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - linked[x] / size[x])
            seen[x] += points
            long[x] += points if len(text) > 80 else 0.0
        if x.name in ("article", "main") and not x.guest:
            within[x] = max(within[x], seen[x])
    open_, stack = 0.0, [root]
    while stack:
        x = stack.pop()
        if x.name in ("article", "main") and not x.guest:
            open_ = max(open_, seen[x])
        stack += [p for p in x.parts if isinstance(p, Node) and not p.noise]
    stack = [root]
    while stack:
        x = stack.pop()
        if x.noise and (within[x] == within[root] > open_ or not within[root] and long[x] > 0.5 * long[root]):
            x.noise = 0
        if not x.noise:
            stack += [p for p in x.parts if isinstance(p, Node) and p.noise != SURELY]


class _Open:
    """The open elements from the page down, and how deep those of each name lie."""

    def __init__(self, root: Node):
        self.line = [root]
        self.depths: dict[str, list[int]] = {}

    def add(self, node: Node) -> None:
        self.depths.setdefault(node.name, []).append(len(self.line))
        self.line.append(node)

    def deepest(self, names: Iterable[str]) -> int:
        """The depth of the innermost open element of these names; 0 if there is none."""
        return max((found[-1] for name in names if (found := self.depths.get(name))), default=0)

    def leave(self, depth: int) -> None:
        while len(self.line) > depth:
            self.depths[self.line.pop().name].pop()

    def close(self, name: str) -> None:
        """Leave the innermost element of the name; an inline end stays within its block."""
        depth = self.deepest((name,))
        if depth and (name in CLOSES_P or depth >= self.deepest(SCOPES)):
            self.leave(depth)

    def close_in_scope(self, names: Iterable[str], scope: frozenset[str]) -> None:
        depth = self.deepest(names)
        if depth and depth >= self.deepest(scope):
            self.leave(depth)


#: Where an open paragraph, and an open cell or row, end to be seen from inside.
_P_SCOPE = frozenset({"table", "td", "th"}) | LEFT_OUT | {"form"}
_ROW_SCOPE = (SCOPES - {"td", "th"}) | LEFT_OUT | {"form"}
_ITEM_SCOPE = SCOPES | LEFT_OUT | {"form"}


def parse(html: str) -> Node:
    """The page's tree. Text of raw elements is left out; character references are decoded, each text run by itself."""
    root = Node("#page", None)
    line = _Open(root)
    i, n = 0, len(html)
    while i < n:
        at = line.line[-1]
        j = html.find("<", i)
        if j < 0:
            at.parts.append(unescape(html[i:]))
            break
        if j > i:
            at.parts.append(unescape(html[i:j]))
        if html.startswith("<!--", j):
            end = html.find("-->", j + 4)
            i = n if end < 0 else end + 3
            continue
        if html[j + 1 : j + 2] in ("!", "?"):
            end = html.find(">", j)
            i = n if end < 0 else end + 1
            continue
        tag = _TAG.match(html, j) or _LOOSE.match(html, j)
        if tag is None:
            if html[j + 1 : j + 2].isalpha() or html[j + 1 : j + 2] == "/" and html[j + 2 : j + 3].isalpha():
                break  # the page ends inside a tag
            end = html.find(">", j) if html.startswith("</", j) else -1
            if end < 0:
                at.parts.append("<")
            i = j + 1 if end < 0 else end + 1
            continue
        i = tag.end()
        name = tag[2].lower()
        if tag[1]:
            line.close(name)
            continue
        if name in CLOSES_P:
            line.close_in_scope(("p",), _P_SCOPE)
        if name in CLOSES_ITSELF and name != "p":
            line.close_in_scope(CLOSES_ITSELF[name], _ROW_SCOPE if name in ("td", "th", "tr") else _ITEM_SCOPE)
        at = line.line[-1]
        if name in RAW:
            if not tag[3].endswith("/") or name in ("script", "style"):
                end = re.compile(f"</{re.escape(name)}[\\s/>]", re.IGNORECASE).search(html, i)
                close = html.find(">", end.start()) if end else -1
                i = n if close < 0 else close + 1
            continue
        node = Node(name, at, _is_noise(name, tag[3], at))
        if tag[3]:
            _note(node, tag[3])
        elif name == "time":
            node.signed = True
        node.guest = name in ("article", "main") and any(key.lower() in ("class", "id") and _named("".join(v), _NOISE) for key, *v in _ATTRIBUTE.findall(tag[3]))
        at.parts.append(node)
        if name not in VOID and not (tag[3].endswith("/") and name not in BLOCK):
            line.add(node)
    _mark_threads(root)
    _spare(root)
    return root


def _measure(root: Node) -> list[Node]:
    """Sizes and link text below each node, noise left out; the nodes in page order."""
    order: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [p for p in reversed(x.parts) if isinstance(p, Node) and not p.noise]
    for x in reversed(order):
        x.size = sum(p.size if isinstance(p, Node) else len(p.strip()) for p in x.parts if isinstance(p, str) or not p.noise)
        x.linked = x.size if x.name == "a" else sum(p.linked for p in x.parts if isinstance(p, Node) and not p.noise)
        x.links = (1 if x.size else 0) if x.name == "a" else sum(p.links for p in x.parts if isinstance(p, Node) and not p.noise)
    return order


def _own_text(x: Node) -> str:
    """Text of a node outside blocks below it."""
    out, stack = [], list(reversed(x.parts))
    while stack:
        p = stack.pop()
        if isinstance(p, str):
            out.append(p)
        elif not p.noise and p.name not in BLOCK:
            stack += reversed(p.parts)
    return "".join(out)


def _density(x: Node) -> float:
    return x.linked / x.size if x.size else 0.0


def best_containers(root: Node) -> list[Node]:
    """The nodes whose blocks are the article, in page order; what lies in them and doesn't belong is marked as noise.

    Inside an article or main all blocks belong, but link lists beside the innermost one that has the best container; around
    the outermost one, other articles and parts with text like its own. Elsewhere the best container and all beside it that
    isn't mostly links.
    """
    order = _measure(root)
    for x in order:
        if x.name in BLOCK and x.name not in ("html", "body", "ul", "ol", "table", "tr") and x.parent is not None:
            text = _own_text(x).strip()
            if not text:
                continue
            points = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - _density(x))
            up, share = (x if x.name in ("div", "section", "article", "main", "td") else x.parent), 1.0
            depth = 1
            while up is not None and depth <= 5:
                up.score += points * share
                up, depth = up.parent, depth + 1
                share = 1 / (2 * depth - 2)
    for x in order:
        x.score *= 1 - _density(x)
        if x.name in ("article", "main"):
            x.score *= 1.25
    best = max(order, key=lambda x: x.score)
    while best.parent is not None and best.parent.name not in ("#page", "html", "body") and best.parent.score >= 0.75 * best.score:
        best = best.parent
    best = next((x for x in _line(best) if x.name in ("article", "main")), best)
    while best.parent is not None and best.name not in ("html", "body"):
        outer = best.parent.inside
        for x in best.parent.parts:
            if isinstance(x, str) or x.noise or x is best or not x.size:
                continue
            long_text = x.name in ("p", "pre", "blockquote") and x.size > 80 and _density(x) < 0.25
            beside = outer or best.name not in ("article", "main") or x.name in BLOCK and (x.score >= max(2.0, 0.2 * best.score) or long_text or x.name == best.name == "article")
            x.noise = _density(x) >= 0.5 and (x.links > 1 or x.name in ("ul", "ol")) or not beside  # a list of links; a paragraph may be one
        if not outer and best.name in ("article", "main"):
            return [x for x in best.parent.parts if isinstance(x, Node) and (x is best or x.name in BLOCK and x.size and not x.noise)]
        best = best.parent
        if not outer:
            break
    return [best]


def _line(x: Node | None) -> Iterator[Node]:
    """The node and those above it."""
    while x is not None:
        yield x
        x = x.parent


def blocks(node: Node) -> Iterator[str]:
    """The texts of the node's blocks in page order: white space as one space, no empty ones."""
    held: list[str] = []
    stack: list[Node | str | None] = [node]
    while stack:
        p = stack.pop()
        if isinstance(p, str):
            held.append(p)
        elif p is None or p.name in BLOCK:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                yield text
            if p is not None:
                stack.append(None)
                stack += reversed([x for x in p.parts if isinstance(x, str) or not x.noise])
        elif p.name == "br":
            held.append(" ")
        else:
            stack += reversed([x for x in p.parts if isinstance(x, str) or not x.noise])
    text = " ".join("".join(held).split())
    if text:
        yield text


def main_text(html: str) -> str:
    """The blocks of the page's article, joined by line ends."""
    return "\n".join(text for node in best_containers(parse(html)) for text in blocks(node))


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages(page_id, url, html)."""

    small_batches(pages.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for b in it:
                for page, url, html in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    text = main_text(html or "")
                    yield page, url, text, len(text)

        yield from batches(_TEXT, out())

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(tidy(run), "page_id bigint, url string, text string, n_chars bigint")


def main_texts(pages: DataFrame) -> DataFrame:
    """pages with its last column, html, replaced by text, the page's main text."""

    small_batches(pages.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [main_text(html or "") for html in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields[:-1])
    return pages.mapInArrow(tidy(run), f"{schema}, text string")
