"""Main text of web pages by consensus host paths.

1. Per page, every container's paragraphs are scored (text outside links; a
   container gets all of its own paragraphs' score and half of its children's),
   and containers are named by their generalised tag-class path: ids, digits and
   positions are dropped.
2. Each page votes for its best container (or the article or main element around
   it), long pages as much as short ones; Spark counts the votes per (host, path)
   and the path with the most wins.
3. Pages are read again and the blocks under their host's winning path are
   extracted, in page order; a page without that path uses its own best one.

Votes combine on the map side, so a host with most of the pages is a few rows
per task.  The winners (one row per host) are broadcast only if there are at
most ``BROADCAST_HOSTS``; beyond that pages are joined by shuffle, where a hot
host is split by adaptive skew handling, as nothing above needs a host's rows
together.

Menus, headers, footers, scripts, styles and hidden parts are left out by tag or
role wherever they stand; headings of an article's own header stay.  Forms and
containers whose class or id has a boilerplate word (sidebars, notices, adverts,
reader comments) are only doubted: their text scores ``DOUBT`` of other text and
is left out where they stand inside the winning container, not where they hold
it.  A doubted container that holds the page's first article or main element, or
(unless one class or id is just such a word, or names comments or related
articles) most of the page's other unlinked text, is an ordinary one.  Null, empty and tagless pages give
their bare text or the empty string; a null url is a host of its own; repeated
rows give repeated rows.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import written

BROADCAST_HOSTS = 200_000
DOUBT = 0.2     # weight of text in containers named like boilerplate

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# content that is never text
RAW = frozenset("script style noscript template iframe object svg math canvas audio video title textarea".split())
CONTAINERS = frozenset("html body main article section div td th table tbody tr ul ol dl li dd dt blockquote center "
                       "figure details fieldset form nav header footer aside menu dialog".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre address figcaption caption summary thead tfoot hr option "
                                "select legend hgroup".split())
BOILERPLATE_TAGS = frozenset("nav footer aside button select option menu dialog input label head".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu "
                              "menubar".split())
# words of class and id attributes that name a part which is not the article
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar comment comments disqus reply replies "
    "respond discussion notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations widget widgets pagination "
    "pager copyright skip hidden search".split())
# a p ends where one of these begins
CLOSES_P = BLOCKS - frozenset(("html", "body"))
SAME_LEVEL = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"),
              "td": ("tr",), "th": ("tr",), "option": ("select",)}

ALIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
                   r"|([^<]+)|(<)", re.S)
NAME = re.compile(r"</?[a-zA-Z][a-zA-Z0-9:-]*")
LONE = re.compile(r"()()()()(<)")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
END_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
WORD = re.compile(r"[A-Za-z]+")
# of readers and of other articles, often long: not told by their share of a page
REMARK = re.compile(r"\b(?:comment|reply|replies|related|recommended)", re.I)


class TagEnds:
    """Where tags end on a page with tags that never do: one backward pass over quotes and brackets.

    A tag ends at the first > outside quotes; from each place that has one answer, so it is kept per
    place and no tag is scanned to the end of the page again.
    """

    def __init__(self, page: str):
        self.at = [m.start() for m in re.finditer("['\">]", page)]
        self.ends = [False] * (len(self.at) + 1)
        later = {'"': None, "'": None}
        for k in range(len(self.at) - 1, -1, -1):
            c = page[self.at[k]]
            if c == ">":
                self.ends[k] = True
            else:
                self.ends[k] = later[c] is not None and self.ends[later[c] + 1]
                later[c] = k

    def __call__(self, place: int) -> bool:
        """Whether a tag whose attributes begin at ``place`` ends."""
        return self.ends[bisect_left(self.at, place)]


class Path:
    """A container path as a chain of steps; the text is made where a block or a doubt asks for it."""
    __slots__ = ("parent", "step", "text")

    def __init__(self, parent, step):
        self.parent, self.step, self.text = parent, step, None

    def __str__(self) -> str:
        if self.text is None:
            steps, at = [], self
            while at is not None and at.text is None:
                steps.append(at.step)
                at = at.parent
            self.text = (at.text if at is not None else "") + "".join(reversed(steps))
        return self.text


class Node:
    __slots__ = ("tag", "path", "skip", "link", "article", "header", "doubts")

    def __init__(self, tag, path, skip, link, article, header, doubts):
        self.tag, self.path, self.skip, self.link, self.article, self.header = tag, path, skip, link, article, header
        self.doubts = doubts


class Doubt:
    """A container named like boilerplate.  ``key``: the same for all that look alike on the page;
    ``whole``: see ``_doubted``; ``cleared``: it holds the page's first article or main."""
    __slots__ = ("path", "key", "whole", "cleared")

    def __init__(self, path, key, whole):
        self.path, self.key, self.whole, self.cleared = path, key, whole, False


class Stack(list):
    """Open elements; ``open`` counts them by tag."""

    def __init__(self, nodes):
        super().__init__(nodes)
        self.open: dict[str, int] = {}

    def append(self, node: Node) -> None:
        super().append(node)
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def pop(self) -> Node:
        node = super().pop()
        self.open[node.tag] -= 1
        return node

    def cut(self, k: int) -> None:
        while len(self) > k:
            self.pop()


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


Block = tuple[str, str, int, tuple[str, ...]]


def blocks(page: str) -> list[Block]:
    """(container path, text, code points inside links, paths of the doubted containers around it) of
    each block outside sure boilerplate, in page order."""
    out: list[tuple[str, str, int, tuple[Doubt, ...]]] = []
    root = Node("", Path(None, ""), False, False, False, False, ())
    first = False
    stack, buf, linked = Stack([root]), [], 0
    heading = False

    def flush():
        nonlocal buf, linked
        if buf:
            text = " ".join(_html.unescape("".join(buf)).split())
            if text:
                holder = next(n for n in reversed(stack) if n.tag in CONTAINERS or not n.tag)
                out.append((str(holder.path), text, linked, holder.doubts))
            buf, linked = [], 0

    pos, end = 0, len(page)
    last, ends = page.rfind(">"), None
    while pos < end:
        if page[pos] == "<" and (pos > last and not page.startswith("<!--", pos)
                                 or ends is not None and (name := NAME.match(page, pos)) and not ends(name.end())):
            m = LONE.match(page, pos)       # no tag begins here
        else:
            m = TOKEN.match(page, pos)
        if m is None:                       # an unfinished tag at the end of the page
            break
        if m[5] and ends is None and NAME.match(page, pos):
            ends = TagEnds(page)
        pos = m.end()
        text = m[4] or m[5]
        if text is not None:
            top = stack[-1]
            if not top.skip and (not top.header or heading):
                buf.append(text)
                if top.link:
                    linked += len(text)
            continue
        if m[2] is None:
            continue
        tag, closing, rest = m[2].lower(), bool(m[1]), m[3]
        if not closing and tag in RAW:
            if not rest.endswith("/"):
                e = END_RAW[tag].search(page, pos)
                pos = e.end() if e else end
            continue
        if tag in VOID:
            if tag == "br":
                buf.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag not in BLOCKS and tag != "a":
            if not closing and tag in BOILERPLATE_TAGS and not rest.endswith("/"):
                t = stack[-1]
                stack.append(Node(tag, t.path, True, t.link, t.article, t.header, t.doubts))
            elif closing and tag in BOILERPLATE_TAGS:
                _close(stack, tag)
            continue
        if closing:
            if tag in BLOCKS:
                flush()
                heading = heading and not (len(tag) == 2 and tag[0] == "h")
            _close(stack, tag)
            continue
        if tag in BLOCKS:
            flush()
            if stack[-1].tag == "a":
                pass
            if tag in CLOSES_P:
                while stack[-1].tag == "p" or (len(stack[-1].tag) == 2 and stack[-1].tag[0] == "h" and stack[-1].tag != "hr"):
                    stack.pop()
            if tag in SAME_LEVEL and any(stack.open.get(t) for t in ALIKE.get(tag, (tag,))):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in SAME_LEVEL[tag]:
                        break
                    if stack[k].tag == tag or (tag in ("dt", "dd") and stack[k].tag in ("dt", "dd")) or (
                            tag in ("td", "th") and stack[k].tag in ("td", "th")):
                        stack.cut(k)
                        break
        top, at = stack[-1], _attributes(rest)
        article = top.article or tag == "article" or tag == "main" or at.get("role") == "main" or \
            at.get("itemprop", "").lower() == "articlebody"
        skip = top.skip or (tag not in ("html", "body") and _boilerplate(tag, at)) or (
            tag not in CONTAINERS and _doubted(tag, at)[0])
        header = top.header or tag == "header"
        if tag == "header" and not top.article:
            skip = True
        heading = (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()) or (heading and tag == "a")
        path = top.path
        if tag in CONTAINERS:
            names = sorted({w.lower() for w in WORD.findall(at.get("class", ""))})
            path = Path(path, f"/{tag}" + ("." + ".".join(names) if names else ""))
        doubts = top.doubts
        doubted, whole = _doubted(tag, at)
        if article and not top.article and not first and not skip and not whole:
            first = True
            for d in doubts:
                d.cleared = True
        if doubted and tag in CONTAINERS and tag not in ("html", "body", "article", "main"):
            doubts = (*doubts, Doubt(str(path), f"{path}#{at.get('id', '')}", whole))
        stack.append(Node(tag, path, skip, top.link or tag == "a", article, header, doubts))
    flush()
    return _settled(out)


def _settled(found: list[tuple[str, str, int, tuple[Doubt, ...]]]) -> list[Block]:
    """The blocks with the paths of the containers that stay in doubt."""
    total, held = 0, {}
    for _, text, linked, doubts in found:
        own = max(0, len(text) - linked)
        if any(d.whole and not d.cleared for d in doubts):
            continue
        total += own
        for key in {d.key for d in doubts}:
            held[key] = held.get(key, 0) + own
    return [(path, text, linked, tuple(
        d.path for d in doubts if not d.cleared and (d.whole or 2 * held.get(d.key, 0) <= total)))
        for path, text, linked, doubts in found]


def _close(stack: Stack, tag: str) -> None:
    if not stack.open.get(tag):
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            stack.cut(k)
            return
        # an inline end tag does not reach over a container
        if tag == "a" and stack[k].tag in CONTAINERS:
            return


def _boilerplate(tag: str, at: dict[str, str]) -> bool:
    if tag in BOILERPLATE_TAGS or at.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in at.get("style", "").replace(" ", ""):
        return True
    return False


def _doubted(tag: str, at: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is named like boilerplate, and whether a class or id is just such a word or a ``REMARK``."""
    names = f"{at.get('class', '')} {at.get('id', '')}".lower()
    whole = any(n in BOILERPLATE_WORDS for n in names.split()) or REMARK.search(names) is not None
    form = tag in ("form", "fieldset") or at.get("role", "").lower() == "form"
    return form or whole or any(w in BOILERPLATE_WORDS for w in WORD.findall(names)), whole


def scores(found: list[Block]) -> dict[str, float]:
    """Share of a page's score of each container path; the shares sum to at most 1."""
    score: dict[str, float] = {}
    for path, text, linked, doubts in found:
        own = max(0, len(text) - linked) * (DOUBT if doubts else 1.0)
        share = 1.0
        while path and share > 0.2:
            score[path] = score.get(path, 0.0) + own * share
            path, share = path.rpartition("/")[0], share / 2
    total = sum(score.values())
    return {p: s / total for p, s in score.items()} if total else {}


def widened(path: str) -> str:
    """The nearest article or main element above a path, if there is one; else the path."""
    parts = path.split("/")
    for k in range(len(parts), 1, -1):
        if parts[k - 1].split(".")[0] in ("article", "main"):
            return "/".join(parts[:k])
    return path


def best(score: dict[str, float]) -> str:
    return max(score.items(), key=lambda x: (x[1], x[0]))[0] if score else ""


def main_text(page: str | None, path: str | None) -> str:
    """Blocks under ``path``, or under the page's own best path where it has no such blocks."""
    found = blocks(page or "")
    own = best(scores(found))
    for p, inner in ((path, False), (own, False), ("", False), (own, True)):
        if p is not None:
            got = _under(found, widened(p), inner)
            if got:
                return "\n\n".join(got)
    return ""


def _under(found: list[Block], path: str, inner: bool) -> list[str]:
    """Texts under a path, those in doubted containers inside it only with ``inner``."""
    got = [(t, not doubts) for q, t, _, doubts in found if (not path or q == path or q.startswith(path + "/"))
           and (inner or not any(d != path and d.startswith(path + "/") for d in doubts))]
    # paths have no ids: the same path may name a doubted container and the article's
    sure = sum(len(t) for t, ok in got if ok)
    if sure >= DOUBT * sum(len(t) for t, ok in got if not ok) > 0:
        return [t for t, ok in got if ok]
    return [t for t, _ in got]


def _votes(batches):
    """(host, path) of each page's best container."""
    for batch in batches:
        path = [widened(best(scores(blocks(page or "")))) or None for page in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("host"), pa.array(path, pa.string())], names=["host", "path"])


def _extract(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            text = [main_text(h, p) for h, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist())]
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(text, pa.string()),
                                   pa.array([len(t) for t in text], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the winning path of each host."""
    votes = _hosted(pages).select("host", "html").mapInArrow(_votes, "host string, path string")
    return votes.where(F.col("path").isNotNull()).groupBy("host", "path").agg(F.count("*").alias("votes")) \
        .groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def extract(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, main text and its length of every page."""
    winners = written(host_paths(pages), "host-paths")
    if winners.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        winners = F.broadcast(winners)
    types = dict(pages.dtypes)
    return _hosted(pages).join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(
        _extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
