"""Main text of web pages by consensus of a host's pages.

Every page scores its containers by the text they hold. The generalised tag-class path of the
best one is the page's vote; Spark counts votes by host and path; then each page is read
again and its text comes from the containers on its host's winning path.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Winning paths go to every task as a broadcast up to so many bytes, else by a salted join.
BROADCAST_BYTES = 16 << 20
SALTS = 16
#: A page keeps its own best container if the winning path holds less than this share of its text.
AGREE = 0.3
#: Parts of a path that count, from the container upwards.
PATH_PARTS = 4
#: A list is a menu if it has so many links and this share of link text.
MENU_LINKS, MENU_SHARE = 3, 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article body center div main section td blockquote".split())
#: Elements without text of the article.
CHROME = frozenset("aside button canvas datalist dialog footer form head iframe input map menu nav noscript object option select svg template textarea title".split())
#: Words of class and id that mark what is not the article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus donate footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager paging pagination paywall popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
#: In an article or main element a class or id marks such a part only as a whole: one of the words above, and beside it none but these.
PLAIN_WORDS = frozenset("area articles bar block box button buttons container form inner item items link links list module panel post posts section slot stories thread unit wrap wrapper".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words that mark the article.
MAIN_WORDS = frozenset("article body content entry main page post story text".split())
#: Before one of the words above these say that the element only stands beside it.
BESIDE = frozenset("has with no without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold running text.
PROSE = HEADINGS | {"p", "pre", "blockquote"}
#: The best container gives way to one above it that is not the body, if so little of its text outside is links; to the body only if
#: the text outside is so large a share of its own besides.
OUTSIDE, OUTSIDE_LINKS = 0.25, 0.3
#: What an opening tag closes: open elements of these names, up to the first of the stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "xmp", "noframes")}
NAME = re.compile(r"/?([a-z][^\s/>]*)", re.I)
RAW_NAME = re.compile(r"(script|style|xmp|noframes)\b", re.I)
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")


class Markup:
    """The tags of a page, each place looked at a bounded number of times whatever is left open: what was searched for in vain is remembered."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in ">\"'"}
        self.open_ended: set[int] = set()  # quotes outside quotes from which no end of a tag is reached

    def _end(self, at: int) -> int:
        """The first > from ``at`` on that no quotes hold; if there is none, the first of all."""
        seen, place = [], at
        while (m := SPECIAL.search(self.html, place)) and m.start() not in self.open_ended:
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            if m.start() == self.last[m[0]]:
                break
            place = self.html.index(m[0], m.end()) + 1
        self.open_ended.update(seen)
        return self.html.index(">", at)

    def tags(self):
        """(start, end, name or None, whether it closes, attributes) of tags, comments, declarations and raw elements."""
        html, at, last = self.html, 0, self.last[">"]
        while 0 <= (start := html.find("<", at)) < last:
            at = start + 1
            first = html[at]
            if first in "!?":
                comment = html.find("-->", start + 4) if html.startswith("!--", at) else html.index(">", at) - 2
                at = len(html) if comment < 0 else comment + 3
                yield start, at, None, False, ""
            elif first in "sSxXnN" and (m := RAW_NAME.match(html, at)):
                end = RAW[m[1].lower()].search(html, html.index(">", at) + 1)
                at = end.end() if end else len(html)
                yield start, at, None, False, ""
            elif m := NAME.match(html, at):
                name = m.end()
                at = name + 1 if html[name] == ">" else self._end(name) + 1
                yield start, at, m[1].lower(), first == "/", html[name : at - 1]


class Node:
    __slots__ = ("tag", "parent", "part", "chrome", "main", "within", "holder", "score", "text", "links", "link_text", "total", "kept", "mark", "prose")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.score = self.text = self.links = self.link_text = self.total = self.kept = self.prose = 0
        self.part, self.chrome, self.main, self.mark = tag, tag in CHROME, False, False
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))
        #: The innermost container from here upwards.
        self.holder = self if tag in CONTAINER else parent.holder if parent else None
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        if found.get("class"):
            self.part = ".".join([tag, *sorted({DIGITS.sub("#", c) for c in found["class"].split()})])
        if tag in ("html", "body"):
            return
        for name in (found.get("class", "") + " " + found.get("id", "")).split():
            words = {w.lower() for w in WORD.findall(name)}
            self.main |= bool(MAIN_WORDS & words)
            if tag not in ("article", "main") and not BESIDE & words and CHROME_WORDS & words:
                self.chrome |= not self.within or words <= CHROME_WORDS | PLAIN_WORDS
        self.chrome |= found.get("role", "").lower() in CHROME_ROLES or found.get("aria-hidden") == "true" or "hidden" in found
        if tag == "header":
            self.chrome = not self.within

    def path(self) -> str:
        parts, node = [], self
        while node is not None and len(parts) < PATH_PARTS:
            parts.append(node.part)
            node = node.parent
        return ">".join(reversed(parts))


class Page:
    """Blocks of a page in its order, and the tree of elements above them."""

    def __init__(self, html: str):
        self.blocks: list[tuple[Node, str]] = []
        self.node = self.root = Node("html", None, "")
        self.nodes: list[Node] = [self.root]  # parents before their children
        self.live = Counter()  # open elements by tag
        self.waiting: list[str] = []
        self.linked: list[str] = []
        self.anchors = 0
        at = 0
        for start, end, tag, closes, attributes in Markup(html).tags():
            if start > at:
                self._text(html[at:start])
            at = end
            if tag:
                (self._close if closes else self._open)(tag, attributes)
        if at < len(html):
            self._text(html[at:])
        self._flush()
        self._score()

    def _text(self, text: str) -> None:
        self.waiting.append(text)
        if self.anchors:
            self.linked.append(text)

    def _flush(self) -> None:
        if self.waiting:
            text = " ".join(entities.unescape("".join(self.waiting)).split())
            if text:
                node, self.node.text = self.node, self.node.text + len(text)
                linked = sum(map(len, self.linked))
                self.blocks.append((node, text))
                if linked:
                    node.links += 1
                    node.link_text += min(linked, len(text))
            self.waiting, self.linked = [], []

    def _pop_to(self, node: Node | None) -> None:
        node = node or self.root
        while self.node is not node:
            self.live[self.node.tag] -= 1
            self.node = self.node.parent

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.anchors += 1
        if tag not in BLOCK and tag not in CHROME:
            if tag == "br":
                self.waiting.append(" ")
            return
        self._flush()
        if tag in ("html", "body") and (tag == "html" or self.node is not self.root):
            return
        if tag in VOID:
            return
        if self.node.tag == "p" or self.node.tag in HEADINGS and tag in HEADINGS:
            self._pop_to(self.node.parent)
        names, stops = CLOSES.get(tag, ((), ()))
        up = self.node
        while any(self.live[name] for name in names) and up is not None and up.tag not in stops:
            if up.tag in names:
                self._pop_to(up.parent)
                break
            up = up.parent
        self.node = Node(tag, self.node, attributes)
        self.nodes.append(self.node)
        self.live[tag] += 1

    def _close(self, tag: str, _: str) -> None:
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        if tag not in BLOCK and tag not in CHROME:
            return
        self._flush()
        up = self.node if self.live[tag] else None
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up is not self.root:
            self._pop_to(up.parent)
            self.anchors = 0

    def _score(self) -> None:
        """All passes go over the nodes in their order or against it, so that a page costs its size whatever its depth."""
        for node in self.nodes:
            node.total = node.text
        for node in reversed(self.nodes):
            if node.parent is not None:
                node.parent.total += node.total
                node.parent.links += node.links
                node.parent.link_text += node.link_text
                if node.tag in PROSE:
                    node.parent.prose += node.total - node.link_text
        for node in self.nodes:
            if node.tag in ("ul", "ol") and not node.within and node.links >= MENU_LINKS and node.link_text >= MENU_SHARE * node.total:
                node.chrome |= node.parent.prose < node.total  # mostly links, outside an article, and not among paragraphs that say more
        for node in self.nodes:
            node.chrome |= node.parent is not None and node.parent.chrome
        self.kept = [(node, text) for node, text in self.blocks if not node.chrome]
        for node, text in self.kept:
            node.kept += len(text)
            worth, share, up = len(text) - 2 * (node.link_text if node.links else 0), 1.0, node.holder
            while up is not None and share > 0.2:
                up.score += share * worth * (1.5 if up.tag in ("article", "main") else 1.25 if up.main else 1)
                share /= 2
                up = up.parent.holder if up.parent else None
        for node in reversed(self.nodes):
            if node.parent is not None:
                node.parent.kept += node.kept
        self.containers = [node for node in self.nodes if node.holder is node]

    def best(self) -> Node | None:
        """The container with the highest score, the first of equals, or one above it that holds more of the article; None without text."""
        live = [c for c in self.containers if c.score > 0]
        if not live:
            return None
        top = up = max(live, key=lambda c: c.score)
        while up.parent is not None and (up := up.parent.holder) is not None and not (up.tag == "body" and (top.within or top.tag in ("article", "main"))):
            outside, links = up.kept - top.kept, up.link_text - top.link_text
            if outside > 0 and (up.tag in ("article", "main") or links <= OUTSIDE_LINKS * outside and (up.tag != "body" or outside >= OUTSIDE * top.kept)):
                top = up
        return top

    def under(self, nodes: list[Node]) -> str:
        wanted = {id(n) for n in nodes}
        for node in self.nodes:
            node.mark = id(node) in wanted or node.parent is not None and node.parent.mark
        return "\n\n".join(text for node, text in self.kept if node.mark)

    def extract(self, path: str | None) -> str:
        """Text under the winning path, or under the page's own best container where the path holds too little."""
        own = self.best()
        if own is None:
            return "\n\n".join(text for _, text in self.kept)
        voted = [c for c in self.containers if c.kept > 0 and c.path() == path]
        if max((c.kept for c in voted), default=0) < AGREE * own.kept:
            voted = [c for c in self.containers if c.path() == own.path() and c.kept > 0]
        return self.under(voted)


def host_of(url_col: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes, share: the path that most pages of a host vote for (ties: more text, then the smaller path)."""

    def make():
        def apply(batch):
            rows = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist()):
                best = Page(html).best()
                if best is not None:
                    rows.append((host, best.path(), best.score))
            return dict(zip(("host", "path", "weight"), zip(*rows))) if rows else {"host": [], "path": [], "weight": []}

        return apply

    slim = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("text"))
    votes = map_batches(slim, make, "host string, path string, weight double")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.log1p("weight")).alias("weight"))
    won = counted.groupBy("host").agg(F.max(F.struct("votes", F.round("weight", 6).alias("weight"), F.col("path"))).alias("won"), F.sum("votes").alias("pages"))
    return won.select("host", "won.path", "won.votes", (F.col("won.votes") / F.col("pages")).alias("share"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the article of every page.

    Blocks are joined by an empty line; inside a block white space is one space. Null, empty
    and text-free pages give an empty text; a null url has the host ''. Repeated pages vote
    and appear as often as they are given. Ties between containers fall to the first.

    Votes are combined before they move, so a host with a third of all pages sends a row of each task
    and path. The winners, one row a host, are sized first: broadcast up to BROADCAST_BYTES,
    else joined with the host salted, so that no host's pages meet in one task.
    """
    from ..session import materialize

    winners = materialize(host_paths(pages, id_col, url_col, html_col).select("host", "path"), "host-paths")
    size = winners.agg(F.sum(F.length("host") + F.length("path") + 32)).first()[0] or 0
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("text"), host_of(url_col).alias("host"))
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def make():
        def apply(batch):
            texts = [Page(html).extract(path) for html, path in zip(batch.column("text").to_pylist(), batch.column("path").to_pylist())]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": list(map(len, texts))}

        return apply

    return map_batches(joined.select("page_id", "url", "text", "path"), make, "page_id long, url string, text string, n_chars long")
