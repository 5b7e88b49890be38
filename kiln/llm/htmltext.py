"""Main text of web pages by consensus host paths.

1. *Score.*  Each page's containers are scored by the text of the blocks
   below them; a block counts less for containers further up, more in
   elements that are made for main text, and nothing inside boilerplate.
   The best one (of equal ones the outermost, then the first) is widened to
   those further out that add text, so that the fade chooses between
   containers but drops no lead or closing paragraph.
2. *Vote.*  A container's path is generalised: tags with their class words,
   digits replaced by ``#``, no ids that number things.  Each page votes for
   its best container's path with that container's share of the page's
   text, and names its hinted boxes (below) by a hash of their text.  Spark
   adds the votes of a host and keeps the winning path, of equal ones the
   last in order of text, and the boxes that most of its pages have.
3. *Extract again.*  Every page is read again with its host's winning path:
   the containers on that path give the text.  A page without such a
   container, or without a host, uses its own best container.

What is boilerplate: elements made for it, roles, hidden elements; and boxes
whose class or id says so in full, that is in words of ``SKIPPED_WORDS`` and
``STRUCTURE`` alone.  Any other box with such a word, and any list or table,
is only hinted at: it goes if most of its text is in links or if most pages of
the host have the same.  In an article or main element a box of prose stays
too, unless it is named for adverts, notices or comments.  Headings,
paragraphs, cells, list items and inline elements go only if a class names
them an advert; ids of headings and sections say nothing.

Only votes (host, path or box, weight) are shuffled, combined on the map side.
The winners, one row per host, are joined as the adaptive planner sees fit;
pages without a host meet nothing and are spread by their own hash.

A page whose html is null, empty or without text has an empty text.  Null
and repeated ids keep their rows; a null or odd url has no host.  Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.components import saved
from kiln.llm.textcodes import slices

REPEATS = 3  # a hinted box counts as a host's from so many pages on

# Element names of HTML by their part in a page.
RAW = ["script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var",
          "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "mfenced", "menclose",
          "maction", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mlabeledtr", "mtd", "semantics",
          "annotation", "annotation-xml"}
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "figcaption", "caption", "td", "th", "tr",
        "thead", "tbody", "tfoot", "table", "ul", "ol", "dl", "address", "hr", "summary", "figure", "center"}
LISTS = {"ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "center", "address"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SKIPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "input", "fieldset", "video", "audio", "object", "canvas"}
MAIN = {"article", "main"}
SKIPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form"}
# Words in class and id attributes that mark what is not main text.
SKIPPED_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "banner", "sponsor", "sponsored", "promo", "promotion",
                 "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
                 "signup", "signin", "login", "paywall", "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "popular", "sidebar",
                 "sidenav", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "header", "masthead",
                 "topbar", "comment", "comments", "commentlist", "reply", "replies", "respond", "responses", "discussion", "disqus", "widget", "widgets", "toolbar",
                 "copyright", "search", "skip", "teaser", "outbrain", "taboola", "print", "hidden", "form"}
# Words that say where a box stands or what it holds, not that it is main text.
STRUCTURE = {"area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "cards", "col", "column", "container", "content", "entry", "grid", "group",
             "holder", "icon", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "article", "articles",
             "primary", "region", "right", "row", "secondary", "section", "site", "slot", "stories", "story", "text", "title", "top", "unit", "wrap", "wrapper", "zone",
             "app", "css", "js", "mw", "td", "vc", "wp"}
# A name with one of these speaks of what is not there.
DENIALS = {"no", "not", "non", "has", "have", "with", "without"}
# Classes that name any element an advert.
AD_CLASSES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "sponsored"}
PROSE = 140  # characters outside of links that make a box in an article prose
# Of these, the ones that page builders also give to boxes of main text.
WEAK_WORDS = {"widget", "widgets", "print", "form", "skip"}
# Those that mark readers' comments, and those of boxes that can be longer than a short article.
TALK_WORDS = {"comment", "comments", "commentlist", "reply", "replies", "respond", "responses", "discussion", "disqus"}
# Of these, the ones that an article's own section may have as its name.
TOPIC_WORDS = {"reply", "replies", "respond", "responses", "discussion"}
BOX_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "banner", "sponsor", "sponsored", "promo", "promotion",
             "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
             "subscription", "signup", "signin", "login", "paywall", "outbrain", "taboola"}
# Elements whose end is implied by the start of one of these.
CLOSES = {"p": LEAF | MAIN | SKIPPED | {"div", "section", "details", "p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
          "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
          **{h: HEADINGS for h in HEADINGS}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<svg>svg)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<!/)>.*?</svg\s*>"  # without an end tag, an empty inline element
    # a quote that is never closed is a character; if no > follows then, all quotes are: each way is tried once
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+'|\"(?![^\"]*+\")|'(?![^']*+'))*+(?=/?>)|(?:[^>/]++|/(?!>))*+)(?P<void>/?)>"
    r"|(?P<cut></?[a-zA-Z][^<>]*\Z)|(?P<text>[^<]+|<)", re.S | re.I)
ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BLANKS = re.compile(r"\s+")
FADE = 0.95


class Node:
    __slots__ = ("tag", "parent", "depth", "step", "mark", "score", "holds_main", "path_length")

    def __init__(self, tag, parent, step, mark):
        self.tag, self.parent, self.step, self.mark = tag, parent, step, mark
        self.depth = parent.depth + 1 if parent else 0
        self.path_length = parent.path_length + (len(step) + 1 if self.on_path() else 0) if parent else 0
        self.score, self.holds_main = 0.0, False

    def on_path(self) -> bool:
        return self.tag not in LEAF and self.tag not in INLINE

    def path(self) -> str:
        """The generalised path: all elements around it that can hold blocks."""
        steps, n = [], self
        while n.parent is not None:
            if n.on_path():
                steps.append(n.step)
            n = n.parent
        return ">".join(reversed(steps))


def _name_mark(name: str) -> str:
    """How a class or an id marks a box: "talk", "box", "word" or "weak" if all its words say so, "hint" if some do, or ""."""
    words = {w.lower() for w in WORDS.findall(name)}
    found = words & SKIPPED_WORDS
    if not found or words & DENIALS:
        return ""
    if words - found - STRUCTURE:
        return "hint"
    for mark, those in (("talk", TALK_WORDS), ("box", BOX_WORDS), ("word", SKIPPED_WORDS - WEAK_WORDS)):
        if found & those:
            return "topic" if mark == "talk" and found <= TOPIC_WORDS else mark
    return "weak"


_ORDER = ("talk", "box", "word", "topic", "weak", "hint")


def _described(tag: str, attrs: str) -> tuple[str, str]:
    """(the element's step in a generalised path, how its attributes mark boilerplate: "shut" by a role or as hidden, or
    by its names, see _name_mark)."""
    if "=" not in attrs and "hidden" not in attrs:
        return tag, ""
    got = {}
    for k, *v in ATTR.findall(attrs):
        got.setdefault(k.lower(), unescape(v[0] or v[1] or v[2]))
    names = got.get("class", "").split()
    kept = sorted({re.sub(r"\d+", "#", n.lower()) for n in names})
    if not kept and "id" in got and not any(ch.isdigit() for ch in got["id"]):
        kept = ["@" + got["id"].lower()]
    step = ".".join([tag, *kept])
    if tag in ("html", "body") or tag in MAIN and not any("comment" in n.lower() for n in names):
        return step, ""
    style = got.get("style", "").replace(" ", "").lower()
    if got.get("role", "").lower() in SKIPPED_ROLES or "hidden" in got or "display:none" in style:
        return step, "shut"
    if tag in LEAF and tag not in LISTS or tag in INLINE:
        return step, "box" if {n.lower() for n in names} & AD_CLASSES else ""
    if tag != "section" and "id" in got:
        names = [*names, got["id"]]
    marks = {_name_mark(n) for n in names}
    mark = next((m for m in _ORDER if m in marks), "")
    return step, "hint" if mark and tag in LISTS and mark not in ("talk", "box") else mark


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """(containers, blocks): a block is (its innermost element that is no inline one, text, characters in links)."""
    root = Node("#root", None, "", "")
    stack, nodes, blocks = [root], [root], []
    pieces, links, owner = [], 0, root

    def flush():
        nonlocal pieces, links
        if pieces:
            text = BLANKS.sub(" ", "".join(pieces)).strip()
            if text:
                blocks.append((owner, text, links))
            pieces, links = [], 0

    depth_a = 0
    for m in TOKEN.finditer(html):
        text = m["text"] or m["cdata"]
        if text is not None:
            if "&" in text and m["text"]:
                text = unescape(text)
            if not pieces:
                owner = stack[-1]
            pieces.append(text)
            if depth_a:
                links += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            if m["raw"] or m["svg"]:
                pieces and pieces.append(" ")
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                depth_a = 0 if m["end"] else 1
            elif tag == "svg":
                pieces and pieces.append(" ")
            step, marked = _described(tag, m["attrs"]) if m["attrs"] and not m["end"] else (tag, "")
            if marked and not m["void"]:  # a hidden or advert span is a box of its own
                flush()
                node = Node(tag, stack[-1], step, marked)
                stack.append(node)
                nodes.append(node)
            elif m["end"] and stack[-1].tag == tag:
                flush()
                stack.pop()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                pieces and pieces.append(" ")
            continue
        flush()
        depth_a = 0
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in MAIN and tag in ("p", "li", "td", "tr"):
                    break
            continue
        while len(stack) > 1 and (stack[-1].tag in INLINE or tag in CLOSES.get(stack[-1].tag, ())):
            stack.pop()
        if tag == "tr":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ("table", "tbody", "thead", "tfoot"):
                    del stack[i + 1 :]
                    break
        if tag == "body" and any(n.tag == "body" for n in stack):
            continue
        if tag == "body":  # an unclosed head ends here
            stack = [n for n in stack if n.tag in ("#root", "html")]
        up = stack[-1]
        step, marked = _described(tag, m["attrs"])
        mark = "tag" if tag in SKIPPED else marked
        node = Node(tag, up, step, mark)
        if tag in MAIN:
            n = up
            while n is not None and not n.holds_main:
                n.holds_main = True
                n = n.parent
        if not m["void"]:
            stack.append(node)
            nodes.append(node)
    flush()
    return nodes, blocks


def _titled(nodes, blocks) -> set[int]:
    """Elements that hold the page's h1, ones marked by words that hold most of its text, and forms that do so on a page
    without an h1 or main element: wrappers, not boilerplate."""
    out: set[int] = set()
    for node, _, _ in blocks:
        if node.tag == "h1":
            while node is not None and id(node) not in out:
                out.add(id(node))
                node = node.parent
    forms = not out and not any(n.tag in MAIN for n in nodes)
    if forms or any(n.mark == "weak" for n in nodes):
        size: dict[int, int] = {}
        for node, text, _ in blocks:
            while node is not None:
                if node.mark == "weak" or forms and node.tag == "form":
                    size[id(node)] = size.get(id(node), 0) + len(text)
                node = node.parent
        out |= {k for k, v in size.items() if 2 * v > sum(len(t) for _, t, _ in blocks)}
    if any(n.mark in ("word", "box") and not n.holds_main and id(n) not in out for n in nodes):
        out |= _wrappers(blocks, out)
    return out


def _wrappers(blocks, titled: set[int]) -> set[int]:
    """Elements marked by a word that hold over half (nine tenths if it is one of ``BOX_WORDS``) of the text that is in no
    link, boilerplate element, comment or hidden box.  None if the page has its main text in a main element, an article
    with an h1 or its only article."""
    total, size, mains = 0, {}, {}
    for node, text, links in blocks:
        chain, n = [], node
        while n is not None:
            chain.append(n)
            n = n.parent
        titled_or_main = lambda n: id(n) in titled or n.holds_main
        if any(n.mark in ("tag", "talk", "shut") and not (titled_or_main(n) and (n.mark != "tag" or n.tag == "form")) for n in chain):
            continue
        gain = max(0, len(text) - links)
        total += gain
        for n in chain:
            if n.tag in MAIN:
                mains[id(n)] = mains.get(id(n), False) or n.tag == "main" or node.tag == "h1"
            elif n.mark in ("word", "box"):
                size[id(n)] = (size[id(n)][0] + gain if id(n) in size else gain, n.mark)
    if len(mains) == 1 or any(mains.values()):
        return set()
    return {k for k, (v, mark) in size.items() if (10 * v > 9 * total if mark == "box" else 2 * v > total)}


class _Boxes:
    """Text and links below every marked element, for those that a name alone does not settle."""

    def __init__(self, blocks):
        self.size: dict[int, int] = {}
        self.links: dict[int, int] = {}
        self.texts: dict[int, list[str]] = {}
        self.talk: set[int] = set()
        for node, text, links in blocks:
            n, talk = node, False
            while n is not None:
                if n.mark:
                    self.size[id(n)] = self.size.get(id(n), 0) + len(text)
                    self.links[id(n)] = self.links.get(id(n), 0) + links
                    if n.mark == "hint":
                        self.texts.setdefault(id(n), []).append(text)
                    if talk:
                        self.talk.add(id(n))
                    talk |= n.mark in ("talk", "topic") or n.tag == "form"
                n = n.parent

    def linked(self, n: Node) -> bool:
        return 2 * self.links.get(id(n), 0) > self.size.get(id(n), 0)

    def prose(self, n: Node) -> bool:
        size, links = self.size.get(id(n), 0), self.links.get(id(n), 0)
        return size - links >= PROSE and 10 * links < 3 * size

    def name(self, n: Node) -> str:
        """A hash of a hinted box's text."""
        return hashlib.blake2b("\n".join(self.texts.get(id(n), [])).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _in_main(n: Node) -> bool:
    while n is not None:
        if n.tag in MAIN:
            return True
        n = n.parent
    return False


def _shuts(n: Node, wrapper: bool, boxes: _Boxes, repeated) -> bool:
    """True if the marked element is boilerplate."""
    if n.mark == "tag":
        return not wrapper if n.tag == "form" else True
    if n.mark == "hint":
        return boxes.linked(n) or bool(repeated) and boxes.name(n) in repeated
    if n.mark == "topic" and not wrapper and id(n) not in boxes.talk and not boxes.linked(n) and _in_main(n.parent):
        return False
    if n.mark in ("word", "weak") and not wrapper and _in_main(n.parent) and boxes.prose(n):
        return False
    return not wrapper


def _skipped(node: Node, titled: set[int], seen: dict[int, bool], boxes: _Boxes, repeated=()) -> bool:
    """True inside boilerplate."""
    chain = []
    n = node
    while n is not None and id(n) not in seen:
        chain.append(n)
        n = n.parent
    out = seen[id(n)] if n is not None else False
    for n in reversed(chain):
        if not out and n.mark:
            out = _shuts(n, n.holds_main or id(n) in titled, boxes, repeated)
        seen[id(n)] = out
    return out


def _heading_of_article(node: Node) -> bool:
    """A heading whose header stands in an article or main element and not in other boilerplate."""
    n, header = node, False
    heading = False
    while n is not None:
        heading |= n.tag in HEADINGS
        if n.tag in MAIN:
            return heading and header
        if n.mark and n.mark != "hint":
            if n.tag == "header" or n.mark != "tag" and n.tag == "div":
                header = n.tag == "header"
                if not header:
                    return False
            else:
                return False
        n = n.parent
    return False


class Page:
    """A parsed page: its clean blocks in order and the scores of their containers."""

    def __init__(self, html: str, repeated=()):
        nodes, blocks = parse(html)
        titled, seen, boxes = _titled(nodes, blocks), {}, _Boxes(blocks)
        self.blocks = [(n, t, k) for n, t, k in blocks if not _skipped(n, titled, seen, boxes, repeated) or _heading_of_article(n)]
        self.hinted = sorted({boxes.name(n) for n in nodes if n.mark == "hint" and id(n) in boxes.texts and not seen.get(id(n), True)})
        self.scored: dict[int, Node] = {}
        self.total = 0
        for node, text, links in self.blocks:
            gain = max(0, len(text) - links)
            self.total += gain
            n, w = node, 1.0
            while n is not None and w > 1e-6:
                if n.tag not in LEAF and n.tag not in INLINE and n.parent is not None:
                    n.score += gain * w * (1.25 if n.tag in MAIN else 1.0)
                    self.scored[id(n)] = n
                    w *= FADE
                n = n.parent

    def top(self) -> Node | None:
        """The container of the highest score."""
        return max(self.scored.values(), key=lambda n: (n.score, -n.depth), default=None)

    def best(self) -> Node | None:
        """The container of the highest score, widened."""
        top = self.top()
        return self.widened(top) if top is not None else None

    def widened(self, best: Node) -> Node:
        """The container or one further out, so that the fade drops no part of the text: out to the furthest that adds
        nothing but headings, or text of which most is in no link.  For text, not out of the outermost article or main
        element, and to the body (or a page without one) only for text that stands in it without a container."""
        chain: list[Node] = []
        n = best
        while n is not None:
            chain.append(n)
            n = n.parent
        level = {id(n): i for i, n in enumerate(chain)}
        outer = max((i for i, n in enumerate(chain) if n.tag in MAIN), default=len(chain))
        added: dict[int, list[tuple[bool, int, int, bool]]] = {}
        for node, text, links in self.blocks:
            n, direct = node, True
            while id(n) not in level:
                direct &= n.tag in LEAF or n.tag in INLINE
                n = n.parent
            if level[id(n)]:
                added.setdefault(level[id(n)], []).append((node.tag in HEADINGS, len(text), links, direct))
        heads, size, in_links = True, 0, 0
        for i in sorted(added):
            up = chain[i]
            heads &= all(h for h, _, _, _ in added[i])
            size += sum(n for _, n, _, _ in added[i])
            in_links += sum(k for _, _, k, _ in added[i])
            region = up.tag in ("body", "html", "#root")
            prose = 2 * in_links < size and (i <= outer) and (not region or any(d and not h and 2 * k < n for h, n, k, d in added[i]))
            if (heads or prose) and (id(up) in self.scored or up.parent is None and not heads):
                best, heads, size, in_links = up, True, 0, 0
        return best

    def text(self, path: str | None) -> str:
        """Text of the containers on ``path``, widened if they hold the page's top one; of the page's best container if there is none."""
        chosen = {id(n) for n in self.scored.values() if n.path_length == len(path) + 1 and n.path() == path} if path else set()
        n = self.top()
        if n is None:
            return "\n".join(t for _, t, _ in self.blocks)
        while chosen and n is not None and id(n) not in chosen:
            n = n.parent
        if n is not None:
            chosen.add(id(self.widened(n)))
        return "\n".join(t for n, t, _ in self.blocks if self._under(n, chosen))

    @staticmethod
    def _under(n: Node | None, chosen: set[int]) -> bool:
        while n is not None:
            if id(n) in chosen:
                return True
            n = n.parent
        return False


def host_of(url: str):
    """Lower-case host of a url column; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)", 1))
    return F.when(host != "", host)


def _votes(batches):
    """Each page's vote for a path, and its hinted boxes (kind 1)."""
    for b in slices(batches):
        out = []
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            page = Page(html)
            best = page.best()
            if best is not None and page.total:
                out.append((host, 0, best.path(), round(1000 * min(1.0, best.score / page.total))))
                out += [(host, 1, name, 1) for name in page.hinted]
        hosts, kinds, paths, weights = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kinds, pa.int32()), pa.array(paths, pa.string()), pa.array(weights, pa.int64())], ["host", "kind", "path", "weight"])


def _texts(batches):
    for b in slices(batches):
        out = [Page(h, frozenset(r or ())).text(p) if h else "" for h, p, r in zip(*[b.column(i).to_pylist() for i in (2, 3, 4)])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), b.column(3)], ["page_id", "url", "text", "path"])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path, repeated``: the container path that a host's pages agree on, and the hinted boxes that most of them have."""
    rows = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).where("host is not null and html is not null")
    votes = saved(rows.mapInArrow(_votes, "host string, kind int, path string, weight long")
                  .groupBy("host", "kind", "path").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")))
    top = votes.where("kind = 0").groupBy("host").agg(F.max(F.struct("weight", "path")).alias("top"), F.sum("n").alias("pages"))
    common = (votes.where(f"kind = 1 and weight >= {REPEATS}").join(top, "host").where(F.col("weight") * 2 > F.col("pages"))
              .groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("repeated")))  # most pages have each: no more than twice a page's boxes
    return top.join(common, "host", "left").select("host", F.col("top.path").alias("path"), "repeated")


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: id, url, main text (empty if none), its code points, and the host's path."""
    paths = saved(host_paths(pages, url, html))
    host = host_of(url)
    key = F.coalesce(host, F.concat(F.lit("?"), F.xxhash64(id_col, html).cast("string")))  # pages without a host are no group
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), key.alias("host"))
    joined = rows.join(paths, "host", "left")
    id_type, url_type = pages.schema[id_col].dataType.simpleString(), pages.schema[url].dataType.simpleString()
    return (joined.select("page_id", "url", "html", "path", "repeated")
            .mapInArrow(_texts, f"page_id {id_type}, url {url_type}, text string, path string")
            .select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path"))
