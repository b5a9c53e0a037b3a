"""Main text of web pages by consensus paths of their hosts."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table, within
from .registry import query

#: Winning paths go to every task if there are at most so many hosts; beyond, they meet the pages in a salted join.
MOST_SENT = 100_000
_SALTS = 16

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# fixed values: element names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset("script style noscript template nav aside footer form button select textarea option svg math canvas iframe object dialog menu head title".split())
CONTAINERS = frozenset("body main article section div td center".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
# end of fixed values
_NAMES = (r"(?:ads?|advert\w*|adsense|adbox|adslot|banner\w*|sponsor\w*|promo\w*|popup\w*|modal|overlay|cookies?\w*|consent|gdpr|notice\w*|notification\w*|alert\w*|disclaimer|newsletter|"
          r"subscribe\w*|signup|login|nav|navbar|navigation|menu\w*|breadcrumbs?|pagination|pager|sidebar\w*|side|widget\w*|footer\w*|header|masthead|topbar|toolbar|comments?|commentlist|respond|replies|"
          r"reply|disqus|discussion|share|sharing|social\w*|related\w*|recommend\w*|tags?|skip|search\w*|copyright|legal)")
#: Words of layout that may stand beside them in a name: site-footer, widget-area.
_BESIDE = r"(?:site|page|main|primary|secondary|left|right|top|bottom|inner|outer|box|bar|block|area|section|wrap|wrapper|container|body|list|links?|buttons?|icons?|posts?|items?|form|text|\d+)"
#: A name says boilerplate as a whole: has-sidebar and tag-news do not.
_BOILERPLATE = re.compile(rf"(?:^|\s)[_-]*(?:{_BESIDE}[_-]+)*{_NAMES}(?:[_-]+(?:{_NAMES}|{_BESIDE}))*[_-]*(?=$|\s)".replace(r"\w*", "[^\\W_]*"), re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|entry|post|story|text|main|body|blog|page)(?=$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())


class Element:
    __slots__ = ("tag", "path", "drop", "named", "link", "good", "depth", "text", "parent")

    def __init__(self, tag: str, attributes: str, parent: Element | None, spared: bool = False) -> None:
        found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        kind = ".".join([tag, *sorted({re.sub(r"\d+", "", c) for c in found.get("class", "").lower().split()} - {""})])
        self.tag, self.parent, self.depth, self.text = tag, parent, parent.depth + 1 if parent else 0, 0
        self.path = f"{parent.path}>{kind}" if parent and parent.path else kind
        holds = tag in ("html", "body", "article", "main")
        inside = parent is not None and parent.within("article", "main")
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        self.named = (bool(names) and bool(_BOILERPLATE.search(names))) or found.get("role", "").lower() in _ROLES
        self.drop = bool(parent and parent.drop) or tag in DROPPED or (tag == "header" and not inside) or hidden or (self.named and not holds and not spared)
        self.link = tag == "a" or bool(parent and parent.link)
        self.good = tag in ("article", "main") or found.get("role", "").lower() in ("main", "article") or (bool(names) and bool(_GOOD.search(names)))

    def within(self, *tags: str) -> bool:
        at = self
        while at is not None:
            if at.tag in tags:
                return True
            at = at.parent
        return False


@lru_cache(4)
def spared(page: str) -> frozenset[int]:
    """Numbers (in page order) of the elements that stay whatever their names say: those around the page's longest
    article or main element; on a page without one, those around more than half of its text."""
    number: dict[int, tuple[int, Element]] = {}
    text, whole = defaultdict(int), 0
    for e, piece in walk(page, None, number):
        n, up = 0 if piece is None or e.drop else len("".join(piece.split())), e
        whole += n
        while n and up is not None:
            text[id(up)] += n
            up = up.parent
    if not any(e.named for _, e in number.values()):
        return frozenset()
    around = [k for k, (_, e) in number.items() if e.tag in ("article", "main") and not e.named and not e.drop and text[k]]
    if around:
        up, out = number[max(around, key=lambda k: (text[k], number[k][1].depth))][1], set()
        while up is not None and id(up) in number:
            out.add(number[id(up)][0])
            up = up.parent
        return frozenset(out)
    return frozenset(i for k, (i, _) in number.items() if 2 * text[k] > whole)


def walk(page: str, stay: frozenset[int] | None = frozenset(), number: dict[int, tuple[int, Element]] | None = None) -> Iterator[tuple[Element, str | None]]:
    """(element, text) for each piece of text and (element, None) where a block begins or ends, in page order.

    Elements whose number is in ``stay`` (None: all) are not dropped for their names; ``number`` takes all elements.
    """
    root = at = Element("", "", None)
    made = 0
    pos, end = 0, len(page)
    while pos < end:
        m = _TAG.search(page, pos)
        if m is None:
            yield at, page[pos:]
            return
        if m.start() > pos:
            yield at, page[pos:m.start()]
        pos, name = m.end(), m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            up = at
            while up is not root and up.tag != tag and not (tag in INLINE and up.tag in CONTAINERS):
                up = up.parent
            if up is not root and up.tag == tag:
                at = up.parent
            if tag not in INLINE:
                yield at, None
            continue
        if tag in CLOSES_P or tag in CLOSED_BY:
            ends = CLOSED_BY.get(tag, frozenset(["p"]))
            up = at
            while up is not root and up.tag not in ends and up.tag not in CONTAINERS and up.tag not in ("ul", "ol", "dl", "table", "tbody"):
                up = up.parent
            if up is not root and up.tag in ends:
                at = up.parent
        if tag not in INLINE:
            yield at, None
        if tag in VOID or m[3].endswith("/"):
            continue
        at = Element(tag, m[3], at, stay is None or made in stay)
        if number is not None:
            number[id(at)] = (made, at)
        made += 1
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            stop = close.start() if close else end
            yield at, page[pos:stop]
            at, pos = at.parent, close.end() if close else end
            yield at, None


def votes(page: str) -> dict[str, float]:
    """Scores of the page's container paths.

    A container scores the square of its share of the page's text (boilerplate and links apart), more if its tag or
    class says content, more if it is deeper, less if it is the body.
    """
    held: dict[int, Element] = {}
    for e, text in walk(page, spared(page)):
        if text is None or e.drop or e.link or text.isspace():
            continue
        n, up = len(text), e
        while up is not None:
            if up.tag in CONTAINERS:
                up.text += n
                held[id(up)] = up
            up = up.parent
    most = max((e.text for e in held.values()), default=0)
    out: dict[str, float] = defaultdict(float)
    for e in held.values():
        share = e.text / most
        if share >= 0.2:
            score = share * share * (1.5 if e.good else 1.0) * (0.5 if e.tag == "body" else 1.0) * (1 + 0.02 * min(e.depth, 20))
            out[e.path] = max(out[e.path], score)
    return out


def main_text(page: str, path: str | None) -> str:
    """Text of the containers with this path, in page order; without any, of the page's own best container."""
    text = _collect(page, path) if path is not None else ""
    if not text:
        own = votes(page)
        text = _collect(page, min(own, key=lambda p: (-own[p], p))) if own else _collect(page, None)
    return text


def _collect(page: str, path: str | None) -> str:
    parts, inside = [], {}
    for e, text in walk(page, spared(page)):
        key = id(e)
        if key not in inside:
            up, hit = e, False
            while up is not None and not hit:
                hit = path is None or (up.path == path and up.tag != "")
                up = up.parent
            inside[key] = (e, hit and not e.drop)            # holds e, so that its id stays its own
        if text is None:
            parts.append(" ")
        elif inside[key][1]:
            parts.append(html.unescape(text) if "&" in text else text)
    return " ".join("".join(parts).split())


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, scores = [], [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            for path, score in votes(page or "").items():
                hosts.append(host)
                paths.append(path)
                scores.append(score)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])


@F.arrow_udf(T.StringType())
def extracted(pages: pa.Array, paths: pa.Array) -> pa.Array:
    return pa.array([main_text(p or "", w) for p, w in zip(pages.to_pylist(), paths.to_pylist(), strict=True)], pa.string())


def winners(pages: DataFrame) -> DataFrame:
    """(host, path): for each host the container path with the largest sum of scores over its pages (ties: by name)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    voted = pages.select(host.alias("host"), "html").mapInArrow(_vote, "host string, path string, score double")
    total = voted.groupBy("host", "path").agg(F.sum(F.round("score", 6).cast("decimal(20,6)")).alias("score"))
    return total.groupBy("host").agg(F.max_by("path", F.struct("score", "path")).alias("path"))


def main_texts(pages: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """Per row of ``pages``: page_id, url, text.

    Pages vote for their hosts' path in one distributed aggregate, whatever share of the pages a host has. A page
    without the winning path falls back to its own best container. Blocks are joined by one space, white space inside
    a block is one space. A null or empty html gives an empty text, pages without a host (null url, say) vote together,
    broken markup is read as far as it goes. Rows that repeat are read alike; an empty table gives no rows.
    """
    best = cut(winners(pages))
    rows = pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"))
    if within(best, most_sent):
        both = rows.join(F.broadcast(best), "host", "left")
    else:
        salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        both = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return both.select("page_id", "url", extracted("html", "path").alias("text"))


@query("op8_host_consensus_text")
def op8(spark: SparkSession, path: str) -> DataFrame:
    return main_texts(table(spark, path, "pages")).withColumn("n_chars", F.length("text").cast("long"))
