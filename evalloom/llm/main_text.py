"""Main text of web pages by tree scoring.

A page becomes a tree. What is never article text (scripts, menus, forms, what
its name calls a sidebar, an advert, comments ...) is set aside with all below
it. Each remaining paragraph earns points for its length and its commas,
discounted by the share of its text that is links, and passes them up: all to
its parent, half to the parent's parent, and so on. The container with the most
points, discounted by its own share of links, is the article; siblings that
read like text stay with it.

A page is one pass over its tags and a few over its nodes, without recursion,
so depth and length are bounded by memory alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from evalloom.llm.common import python_ready

#: A tag, a comment or a declaration. A quote opens a value only after "=".
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NAME = re.compile(r"[^a-z0-9]+")
_COMMA = re.compile("[,،、，﹐︐；;]")
_SENTENCE = re.compile("[.!?。！？…]['\"”»)]*$")


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


# The elements of HTML by what they do.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style xmp iframe noembed noframes textarea title")
HEAD = _set("title meta link script style base noscript template")
INLINE = _set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr label output picture nobr")
CLOSES_P = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt tr td th tbody thead tfoot")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
PARAGRAPHS = _set("p pre li dd dt td th blockquote figcaption caption summary address") | HEADINGS
#: What an end tag, or an implied one, does not reach beyond.
SCOPES = _set("table td th caption html template object marquee applet")
#: Start tags that end an open element of the first set, looked for up to one of the second.
IMPLIED = {
    "li": (_set("li"), _set("ul ol menu dir")), "dd": (_set("dd dt"), _set("dl")), "dt": (_set("dd dt"), _set("dl")), "option": (_set("option"), _set("select")),
    "tr": (_set("tr"), _set("table")), "td": (_set("td th"), _set("tr table")), "th": (_set("td th"), _set("tr table")),
    "tbody": (_set("tbody thead tfoot"), _set("table")), "thead": (_set("tbody thead tfoot"), _set("table")), "tfoot": (_set("tbody thead tfoot"), _set("table")),
}
NEVER = _set("head script style noscript noframes noembed template title xmp iframe object embed applet svg math canvas audio video map nav footer aside button select datalist textarea input dialog menu progress meter")
ROLES = _set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist status")
#: Names in class and id of what stands beside an article.
BESIDE = _set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot adunit banner breadcrumb breadcrumbs colophon combx comment comments commentlist consent cookie cookies cookiebar copyright disqus "
    "dropdown footer footnav gdpr hidden legal login masthead menu menus modal nav navbar navigation navi newsletter noprint notice notices notification notifications outbrain overlay pager pagination paywall popover popup print privacy promo promos promoted promotion "
    "recommended recommendations related replies reply respond rss search share shares sharing shoutbox sidebar sidebars sidenav signin signup skip skyscraper social sponsor sponsored sponsors subscribe subscription supplemental taboola tagcloud tags toast toolbar topbar topnav trending widget widgets"
)
#: Words before a name that say it is not there, or of what the element is beside it.
WITHOUT = _set("has with no without hide show is can enable disable")
#: Names of what holds an article.
HOLDS = _set("article articlebody post entry content main story body page wrapper container")
#: Names that stay beside an article's own, as "post-comments"; the others are overruled by it, as "content-header" is.
COMMENTS = _set("comment comments commentlist disqus respond replies reply sidebar sidebars related share sharing social newsletter footer nav navigation navbar menu ad ads advert adverts advertisement promo widget widgets tags pagination pager subscribe cookie notice")
#: Least share of the best score, and least length of a sibling's text, for it to stay; most links it may have.
SIBLING_SHARE, SIBLING_CHARS, SIBLING_LINKS = 0.2, 80, 0.25
#: A list with this share of links is a menu wherever it stands.
MENU_LINKS = 0.9


class _Page:
    """A page's nodes in page order, parents before children, and its text runs."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes = ["html"], [-1], [""]
        self.runs: list[tuple[int, int, str]] = []  # (block, node, text)
        self.owner: list[int] = [0]  # of each block: the innermost node that is not inline
        self._build(source)

    def _build(self, source: str) -> None:
        stack, depth = [0], {"html": 1}
        at, end = 0, len(source)

        def cut() -> None:
            node = stack[-1]
            k = len(stack) - 1
            while k and self.tag[stack[k]] in INLINE:
                k -= 1
            node = stack[k]
            if self.runs and self.runs[-1][0] == len(self.owner) - 1:
                self.owner.append(node)
            else:
                self.owner[-1] = node

        def pop_to(k: int) -> None:
            block = False
            for node in stack[k:]:
                depth[self.tag[node]] -= 1
                block |= self.tag[node] not in INLINE
            del stack[k:]
            if block:
                cut()

        def close(names: frozenset[str], until: frozenset[str]) -> None:
            if not any(depth.get(n) for n in names):
                return
            for k in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[k]]
                if name in names:
                    return pop_to(k)
                if name in until:
                    return

        def text(data: str) -> None:
            if self.tag[stack[-1]] == "head":
                if not data.strip():
                    return
                pop_to(len(stack) - 1)
            self.runs.append((len(self.owner) - 1, stack[-1], html.unescape(data) if "&" in data else data))

        while at < end:
            spot = source.find("<", at)
            if spot < 0:
                text(source[at:])
                break
            m = _TAG.match(source, spot)
            if not m:  # a sign like any other
                text(source[at : spot + 1])
                at = spot + 1
                continue
            if spot > at:
                text(source[at:spot])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                if name == "br":
                    self.runs.append((len(self.owner) - 1, stack[-1], " "))
                elif name in ("body", "html") or not depth.get(name):
                    pass
                elif name in INLINE:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == name:
                            pop_to(k)
                            break
                        if self.tag[stack[k]] not in INLINE:
                            break
                else:
                    wide = SCOPES if name not in SCOPES and name not in ("tr", "tbody", "thead", "tfoot") else frozenset({"table"}) - {name}
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == name or (name in HEADINGS and self.tag[stack[k]] in HEADINGS):
                            pop_to(k)
                            break
                        if self.tag[stack[k]] in wide:
                            break
                continue
            if name == "html" or (name == "body" and depth.get("body")):
                continue
            if self.tag[stack[-1]] == "head" and name not in HEAD:
                pop_to(len(stack) - 1)
            if name == "br":
                self.runs.append((len(self.owner) - 1, stack[-1], " "))
                continue
            if name in CLOSES_P:
                close(frozenset({"p"}), SCOPES)
            if name in IMPLIED:
                close(*IMPLIED[name])
            if name in HEADINGS and self.tag[stack[-1]] in HEADINGS:
                pop_to(len(stack) - 1)
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.attributes.append(m[3])
            if name in VOID:
                if name == "hr":
                    cut()
                continue
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = stop.start() if stop else end
                if stop:
                    closing = source.find(">", at)
                    at = closing + 1 if closing >= 0 else end
                continue
            if name == "a" and depth.get("a"):  # links do not stand in links
                close(frozenset({"a"}), SCOPES)
                self.parent[node] = stack[-1]
            stack.append(node)
            depth[name] = depth.get(name, 0) + 1
            if name not in INLINE:
                cut()

    def _beside(self, node: int, named: bool) -> bool:
        """Whether a node and all below it are set aside by what they are, or, if ``named``, are called."""
        tag = self.tag[node]
        if tag in NEVER:
            return True
        if not self.attributes[node].strip():
            return False
        own = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(self.attributes[node])}
        if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
            return True
        if own.get("role", "").lower() in ROLES:
            return True
        if not named or tag in ("html", "body", "main"):
            return False
        for value in (own.get("class", ""), own.get("id", "")):
            for name in value.split():
                words = [w for w in _NAME.split(_CAMEL.sub("-", name).lower()) if w]
                if words and words[0] in WITHOUT:
                    continue
                holds = any(w in HOLDS for w in words)
                for k, w in enumerate(words):
                    if w in BESIDE and not (k and words[k - 1] in WITHOUT) and (not holds or w in COMMENTS):
                        return tag != "article" or w in ("comment", "comments", "reply", "ad", "advert", "advertisement", "promo", "sponsored")
        return False

    def text(self) -> str:
        for named in (True, False):
            out = self._text(named)
            if out:
                break
        return out

    def _text(self, named: bool) -> str:
        n, parent, tag = len(self.tag), self.parent, self.tag
        gone, article, link = [False] * n, [False] * n, [False] * n
        children: list[list[int]] = [[] for _ in range(n)]
        holds = [False] * n
        for k in range(n - 1, 0, -1):
            holds[k] |= tag[k] in ("article", "main") and not self._beside(k, named) or (tag[k] == "p" and not named)
            holds[parent[k]] |= holds[k]
        for k in range(n):
            up = parent[k]
            if k:
                children[up].append(k)
                gone[k], article[k], link[k] = gone[up], article[up], link[up]
            article[k] |= tag[k] in ("article", "main")
            link[k] |= tag[k] == "a"
            if not gone[k]:
                # what holds the article (in the second turn: paragraphs) is no form, header or sidebar beside it
                if self._beside(k, named) or tag[k] in ("form", "fieldset"):
                    gone[k] = not holds[k] or tag[k] in NEVER
                elif tag[k] == "header" and not holds[k]:
                    gone[k] = not article[k]
        # an article's own header keeps its headings
        inner = [False] * n
        for k in range(1, n):
            inner[k] = (inner[parent[k]] or tag[k] in ("header", "hgroup")) and article[k] and tag[k] not in HEADINGS
        blocks: dict[int, list] = {}
        for block, node, data in self.runs:
            if gone[node]:
                continue
            parts = blocks.setdefault(block, [[], 0])
            parts[0].append(data)
            if link[node]:
                parts[1] += len(data)
        found = []  # (owner, text, link characters)
        for block, (parts, links) in sorted(blocks.items()):
            data = _SPACE.sub(" ", "".join(parts)).strip()
            if data and not inner[self.owner[block]]:
                found.append((self.owner[block], data, min(links, len(data))))
        if not found:
            return ""
        chars, links, points = [0] * n, [0] * n, [0.0] * n
        for owner, data, linked in found:
            chars[owner] += len(data)
            links[owner] += linked
            if tag[owner] in HEADINGS:
                continue
            worth = (1 + len(_COMMA.findall(data)) + len(data) / 100) * (1 - linked / len(data))
            points[parent[owner] if tag[owner] in PARAGRAPHS and owner else owner] += worth
        passed = [0.0] * n
        for k in range(n - 1, 0, -1):
            chars[parent[k]] += chars[k]
            links[parent[k]] += links[k]
            passed[parent[k]] += (points[k] + passed[k]) / 2
        score = [(points[k] + passed[k]) * (1 - links[k] / chars[k]) if chars[k] else 0.0 for k in range(n)]
        best = max(range(n), key=lambda k: (score[k], -k))
        if score[best] <= 0:
            best = 0
        # an article is whole; so is what alone fills its parent
        k = up = best
        while up > 0:
            if tag[up] == "article" or (tag[up] == "main" and tag[k] != "article"):
                k = up
            up = parent[up]
        best = k
        while parent[best] > 0 and tag[best] not in ("article", "main", "body") and chars[parent[best]] == chars[best]:
            best = parent[best]
        keep = [False] * n
        keep[best] = True
        if tag[best] == "article":
            for k in children[parent[best]]:  # a title before the article
                keep[k] |= k < best and tag[k] == "h1" and chars[k] > 0
        if best and tag[best] not in ("article", "main", "body"):
            for k in children[parent[best]]:
                same = tag[k] == tag[best] and self.attributes[k] == self.attributes[best]
                if chars[k] and links[k] / chars[k] <= SIBLING_LINKS and tag[k] not in INLINE:
                    keep[k] |= same or tag[k] in HEADINGS or score[k] >= SIBLING_SHARE * score[best] or chars[k] >= SIBLING_CHARS or (tag[k] in PARAGRAPHS and links[k] == 0)
            loose = parent[best]  # text that stands between the siblings
        else:
            loose = -1
        menu = [False] * n
        for k in range(1, n):
            keep[k] |= keep[parent[k]]
            menu[k] = menu[parent[k]] or (tag[k] in ("ul", "ol", "menu", "dir") and chars[k] > 0 and links[k] >= MENU_LINKS * chars[k])
        return "\n\n".join(data for owner, data, linked in found if (keep[owner] or (owner == loose and linked <= SIBLING_LINKS * len(data))) and not menu[owner])


def main_text(source: str | None) -> str:
    return _Page(source).text() if source else ""


def extracted(pages: DataFrame) -> DataFrame:
    """The rows of ``pages`` with text in place of html: the article's blocks in page order, joined by an empty line.

    Character references are decoded, white space inside a block becomes one
    space and goes at its ends; a line break is white space. Null and empty
    pages, and pages of menus and forms alone, have the empty text. Where names
    and forms would set everything aside, names are ignored and forms that hold
    paragraphs stay. Rows are neither merged nor
    reordered; other columns stay, but for one called text; an empty table
    gives no rows.
    """
    python_ready(pages.sparkSession, 512)
    rest = [f for f in pages.schema.fields if f.name not in ("html", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), texts], names=[*(f.name for f in rest), "text"])

    slim = pages.select(*[f.name for f in rest], "html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return slim.mapInArrow(run, f"{schema}, text string" if rest else "text string")
