"""A forgiving HTML reader: block texts and their containers of one page."""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'<>/]+)", re.S)
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")

#: HTML element groups.
RAW = frozenset("script style noscript template textarea title xmp iframe svg noframes select option "
                "annotation annotation-xml".split())
CONTAINERS = frozenset("html body main article section div nav aside header footer form dialog figure fieldset "
                       "details table tbody thead tfoot tr td th ul ol dl menu center address blockquote".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre caption figcaption summary hr legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and name parts of what is not the article.
BOILER_TAGS = frozenset("nav aside header footer form dialog menu button label fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu "
                         "menubar toolbar".split())
BOILER_NAMES = frozenset("nav navbar navigation menu submenu sidebar side aside header masthead topbar footer foot "
                         "bottom ad ads adv advert adverts advertisement advertising banner promo promotion sponsor "
                         "sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay "
                         "newsletter subscribe subscription signup share sharing social follow comment comments "
                         "commentlist disqus reply replies respond related recommended recommendations breadcrumb "
                         "breadcrumbs pagination pager widget toolbar login search copyright legal form skip "
                         "hidden paywall teaser tags toc".split())
#: Words that turn a name into a remark on the layout: ``no-sidebar``, ``has-banner``.
REMARKS = frozenset("no not non has have with without hide show is".split())
#: Words that only say where or what a part is; a name ends in one by chance: ``article-bottom``.
PLACES = frozenset("side bottom foot form tags hidden share search follow legal related reply respond".split())
#: Neutral words beside the ones above: ``ad-slot``, ``post-footer``, ``related-articles``.
NEUTRAL = frozenset("box bar block wrapper wrap container section area inner outer main left right top center site page "
                    "global post posts entry unit slot panel list item items link links button buttons group row col "
                    "column text title content article articles story stories news message form module region div "
                    "id js c u l m s x".split())
DISCUSSION = frozenset("comment comments commentlist disqus reply replies respond".split())
#: What a container named like boilerplate keeps of its score: below half of the
#: page's text, above it, and when it is named like a discussion.
NAMED, NAMED_MOST, NAMED_DISCUSSION = 0.1, 0.5, 0.05
WALLS = frozenset("article main body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """A container.  ``path`` names its generalised tag-class path: the depth and a digest
    of the parent's path and the own step, of one length however deep it lies."""

    __slots__ = ("tag", "path", "parent", "depth", "boiler", "named", "sure", "soft", "chars", "links", "free",
                 "holds_article", "in_article", "out", "weight")

    def __init__(self, tag: str, step: str, parent: "Node | None", boiler: bool, soft: bool,
                 named: float = 1.0, sure: bool = False):
        self.tag, self.parent, self.boiler, self.soft = tag, parent, boiler, soft
        self.named, self.sure = named, sure  # named below 1: the class or id sounds like boilerplate
        self.depth = 0 if parent is None or tag in ("html", "body") else parent.depth + 1
        above = "" if self.depth == 0 or parent is None else parent.path
        self.path = f"{self.depth:06d}" + blake2b(f"{above}>{step}".encode(errors="replace"), digest_size=12).hexdigest() \
            if parent is not None else ""
        self.chars = self.links = 0
        self.free = 0.0
        self.holds_article = False
        self.in_article = parent is not None and (parent.in_article or parent.tag == "article")
        self.out, self.weight = False, 1.0


def attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def name_parts(value: str) -> list[str]:
    return [p for p in re.split(r"[^a-z]+", DIGITS.sub("", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value)).lower()) if p]


def label(tag: str, attrs: dict[str, str]) -> str:
    """Generalised step of a path: tag and classes, digits left out."""
    classes = sorted({DIGITS.sub("", c) for c in attrs.get("class", "").split()} - {""})
    return ".".join([tag, *classes])


def not_article(tag: str, attrs: dict[str, str]) -> bool:
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return "hidden" in attrs and tag in HEADINGS
    if tag in BOILER_TAGS or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if tag not in CONTAINERS and "hidden" in attrs.get("class", "").lower().split():
        return True
    if attrs.get("role", "").lower() in BOILER_ROLES:
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))


def name_weight(tag: str, attrs: dict[str, str]) -> float:
    """What a container keeps of its score for the words of its class and id."""
    if tag in ("html", "body", "main"):
        return 1.0
    names: set[str] = set()
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        parts = name_parts(name)
        if parts and parts[0] not in REMARKS:
            names.update(parts)
    if names & DISCUSSION:
        return NAMED_DISCUSSION
    return NAMED if names & BOILER_NAMES else 1.0


def surely_named(attrs: dict[str, str]) -> bool:
    """Whether a whole name says boilerplate: all its words do or are neutral, or its last
    word, the one that the others qualify, does and is no word for a place."""
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        parts = name_parts(name)
        if not parts or parts[0] in REMARKS:
            continue
        words = set(parts)
        if words & BOILER_NAMES and (words <= BOILER_NAMES | NEUTRAL and "article" not in words
                                     or parts[-1] in BOILER_NAMES - PLACES):
            return True
    return False


def read_page(html: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """(container, text) of every block in page order, and all containers.

    Unclosed and misnested tags end where a browser would end them, roughly; a
    container that is never closed runs to the end of the page, but an article or
    main element inside an unclosed menu is not part of that menu.  The work and the memory
    grow with the length of the page, however deep it is nested.
    """
    root = Node("", "", None, False, False)
    stack, nodes, blocks, pieces = [root], [root], [], []
    open_at: dict[str, list[int]] = {}  # places of the open containers of a tag in the stack
    walls: list[int] = []  # and those of articles, main elements and the body

    def close(k: int) -> None:
        for node in reversed(stack[k:]):
            open_at[node.tag].pop()
            if node.tag in WALLS:
                walls.pop()
        del stack[k:]

    link = quiet = 0  # open links; open non-container elements that are not article text
    quiet_tag = ""

    def end_block() -> None:
        if pieces:
            text = SPACE.sub(" ", unescape("".join(p for p, _ in pieces))).strip()
            if text:
                node = stack[-1]
                blocks.append((node, text))
                linked = sum(len(p) for p, in_link in pieces if in_link)
                n = sum(len(p) for p, _ in pieces)
                node.chars += len(text)
                node.links += min(len(text), len(text) * linked // max(1, n))
            pieces.clear()

    at = 0
    while True:
        m = MARKUP.search(html, at)
        if m is None:
            if not quiet and at < len(html):
                pieces.append((html[at:], link > 0))
            break
        if m.start() > at and not quiet:
            pieces.append((html[at:m.start()], link > 0))
        at = m.end()
        if m[2] is None:  # comment, declaration
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                if end is not None:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(html)
            continue
        if tag == "br":
            pieces.append((" ", False))
            continue
        if tag == "a":
            link = 0 if closing else 1
            continue
        if tag not in BLOCKS:
            if not quiet and not closing and tag not in VOID and m[3] and (
                    not_article(tag, attributes(m[3])) or surely_named(attributes(m[3]))):
                quiet, quiet_tag = 1, tag
            elif not quiet and tag in BOILER_TAGS and not closing:
                quiet, quiet_tag = 1, tag
            elif quiet and tag == quiet_tag:
                quiet += -1 if closing else 1
            continue
        end_block()
        link = 0
        if tag in CONTAINERS:
            quiet = 0
        if tag not in CONTAINERS:
            if quiet and tag == quiet_tag:
                quiet += -1 if closing else 1
            elif not closing and m[3] and not quiet and not_article(tag, attributes(m[3])):
                quiet, quiet_tag = 1, tag
            continue
        if closing:
            last = open_at.get(tag)
            # a stray end tag does not close the article
            if last and (tag in WALLS or tag == "html" or not walls or last[-1] > walls[-1]):
                close(last[-1])
            continue
        if tag in ("html", "body") and open_at.get(tag):
            continue  # one more start tag of what is open
        attrs = attributes(m[3]) if m[3] else {}
        boiler = not_article(tag, attrs)
        if tag in ("article", "main") and not boiler:
            while len(stack) > 1 and stack[-1].boiler and stack[-1].tag in ("nav", "ul", "aside", "menu"):
                close(len(stack) - 1)
        parent = stack[-1]
        named = name_weight(tag, attrs)
        if tag == "article" and not (parent.in_article or parent.tag == "article") and not (
                DISCUSSION & set(attrs.get("class", "").lower().split())):
            named = 1.0  # an article that is not a reader's comment
        node = Node(tag, label(tag, attrs) if tag not in ("html", "body") else tag, parent, boiler,
                    tag in ("form", "header"), named, named < 1 and surely_named(attrs))
        nodes.append(node)
        if not m[3].endswith("/"):
            open_at.setdefault(tag, []).append(len(stack))
            if tag in WALLS:
                walls.append(len(stack))
            stack.append(node)
    end_block()
    judge(blocks, nodes)
    return blocks, nodes


def judge(blocks: list[tuple[Node, str]], nodes: list[Node]) -> None:
    """What each container holds and lies in; ``nodes`` has parents before children, so a
    pass from the end sums up and a pass from the start hands down."""
    root = nodes[0]
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.links += node.links
        node.parent.holds_article |= node.holds_article or node.tag in ("article", "main") and not node.boiler
    for node in nodes:  # a wrapper of the article is no boilerplate, whatever it is called
        if node.boiler and (node.holds_article or node.soft and node.chars >= max(1, root.chars) * 0.6
                            and node.tag == "form"):
            node.boiler = False
    article = {root: False}  # inside an article or main element
    for node in nodes[1:]:
        up = node.parent
        article[node] = article[up] or up.tag in ("article", "main") and not up.boiler
        # a header inside an article is its title
        node.out = up.out or node.boiler and not (node.tag == "header" and article[node])
    for node, text in blocks:
        if not node.out:
            node.free += len(text) * (1 - min(1.0, node.links / max(1, node.chars)))
    for node in reversed(nodes[1:]):
        node.parent.free += node.free
    for node in nodes:
        if node.named > NAMED_DISCUSSION and node.holds_article:
            node.named, node.sure = 1.0, False
        elif node.named == NAMED and node.free > root.free / 2:
            node.named = NAMED_MOST
    for node in nodes:
        node.weight = node.named * (node.parent.weight if node.parent is not None else 1.0)


def left_out(node: Node) -> bool:
    """Whether a part of the article is none of it: by its whole name, or by a word of the name
    and, as a second sign, links that make up half of its text."""
    return node.named < 1 and (node.sure or node.named == NAMED_DISCUSSION or 2 * node.links >= max(1, node.chars))


def text_gain(node: Node, text: str) -> float | None:
    """Score of one block: its text that is no link; None in boilerplate."""
    if node.out:
        return None
    free = 1 - min(1.0, node.links / max(1, node.chars))
    return (len(text) + 25 * text.count(",")) * free


def score_containers(blocks: list[tuple[Node, str]]) -> dict[Node, float]:
    """Text in each container that is not link text: its own blocks count in full,
    those one level down by half; a name like boilerplate's takes most of it away."""
    scores: dict[Node, float] = {}
    for node, text in blocks:
        gain = text_gain(node, text)
        if gain is None:
            continue
        gain *= node.weight
        scores[node] = scores.get(node, 0) + gain
        if node.parent is not None:
            scores[node.parent] = scores.get(node.parent, 0) + gain / 2
    return scores


def best_path(blocks: list[tuple[Node, str]]) -> tuple[str, float]:
    """Path of the best container (of the article or main element around it, if
    there is one), and its share of the page's score."""
    scores = score_containers(blocks)
    if not scores:
        return "", 0.0
    total = sum(scores.values()) or 1.0
    best = max(scores, key=lambda n: scores[n])
    share, up = scores[best] / total, best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    return best.path, share


def texts_in(page: tuple[list[tuple[Node, str]], list[Node]], path: str, names: bool = True) -> list[str]:
    """Blocks in the containers of a path, without boilerplate and (``names``) what
    is named like it inside of them."""
    blocks, nodes = page
    state = {}  # of a container: None outside the path, else whether a part around it is left out
    for node in nodes:
        above = state.get(node.parent)
        state[node] = False if node.path == path else None if above is None else above or left_out(node)
    return [text for node, text in blocks
            if state[node] is not None and not node.out and not (names and state[node])]


def path_scores(page: tuple[list[tuple[Node, str]], list[Node]], paths: set[str]) -> dict[str, float]:
    """Score of the text in the containers of each path that is on the page; what lies
    in another of the paths inside of it counts by half."""
    blocks, nodes = page
    own: dict[str, float] = dict.fromkeys(paths, 0.0)
    arriving: dict[Node, float] = {}
    for node, text in blocks:
        arriving[node] = arriving.get(node, 0.0) + (text_gain(node, text) or 0.0)
    for node in reversed(nodes):
        gain = arriving.get(node, 0.0)
        if node.path in own:
            own[node.path] += gain
            gain /= 2
        if gain and node.parent is not None:  # a penalty for what is named like boilerplate inside
            arriving[node.parent] = arriving.get(node.parent, 0.0) + gain * node.named
    return {p: g for p, g in own.items() if g > 0}


def main_text(html: str, paths: str | dict[str, float] | None) -> str:
    """Text of the containers with one of the given paths, boilerplate left out;
    blocks joined by an empty line.

    ``paths``: the paths of the host and the share of its votes that each has (a
    single path has all of them).  Of those on the page the one is taken whose text
    scores most, weighted by the square root of its votes; with none on the page,
    the page's own best path.
    """
    page = read_page(html)
    given = {paths: 1.0} if isinstance(paths, str) else dict(paths or {})
    here, own = path_scores(page, set(given)) if given else {}, None
    if here:
        # ties go to the path that is less deep, then the smaller one
        path = min(here, key=lambda p: (-here[p] * given[p] ** 0.5, p))
    else:
        path = own = best_path(page[0])[0]
    out = texts_in(page, path)
    if not out and own is None:
        path = best_path(page[0])[0]
        out = texts_in(page, path)
    return "\n\n".join(out or texts_in(page, path, names=False))
