"""Main text of HTML pages by composite text density.

Each page becomes a light DOM (numpy-free Python inside tasks). A node's density is its
characters per tag, lowered by the share of its characters that stand in links; the
density sum of a node adds up its children, text that stands directly in the node counting
with its characters. The subtree with the largest sum, widened to
an enclosing article or main element, is content; the least density on its path to the body
is the threshold, and every other node at or above it counts as content as well. Short
pieces fall below any density, so siblings of content go with it: headings, paragraphs and
other text elements, and elements of the same tag and class, each with less than a quarter
of its characters in links. All content comes in page order.

Boilerplate elements (navigation, forms and the like, and hidden ones) are cut first. A class,
id or role counts as a boilerplate name only if all its parts do. An element so named as
an advert, comments or the like is cut; other names (menu, related, notice) cut
where a third of the characters stand in links, and halve the density elsewhere. No name
cuts what holds every article and main element or, on pages without any, at least half of
the characters with less than a third in links.

Null or empty html gives an empty text, an empty table an empty result. Unclosed, stray and
truncated tags are tolerated: an svg, iframe, button or the like that closes itself or is
never closed ends at its own tag, only script and style run to the end. The text of
noscript counts as markup for other readers and is left out. Every page is read by itself,
so repeated rows agree. Pages may be of any length (one stays in the task that reads it).
Columns of ``pages`` are carried untouched, whatever their names (but for ``text``, which
the result replaces).
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propel.llm.common import with_fields

# fixed values: HTML element classes
FLOW = set("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "button")
CODE = ("script", "style")
CUT = set("head nav footer aside form header menu dialog".split()) | set(RAW)
BLOCK = set("address article blockquote body br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
STRONG = set("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion newsletter popup disqus comment comments responses replies sidebar".split())
WEAK = set("banner notice side menu nav navbar navigation footer header breadcrumb breadcrumbs share sharing social related modal login widget widgets contentinfo search".split())
TOPIC = set("cookie cookies consent subscribe".split())
FILL = set("site page top bottom left right box bar list item items link links post posts slot area section container wrapper wrap block buttons icons main".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kids", "up", "cut", "cls", "name", "arts", "chars", "links", "tags", "ltags", "density", "sum")

    def __init__(self, tag, up, cut=False, cls="", name=0):
        self.tag, self.up, self.kids, self.cut, self.cls, self.name = tag, up, [], cut, cls, name


def name_level(value: str, anchor: bool = False) -> int:
    """2: names an advert, comments or the like, 1: another boilerplate name, 0: none. As an
    ``anchor`` (an id), one word of TOPIC may be what a section is about."""
    level = 0
    for word in value.lower().split():
        parts = [w for w in re.split(r"[_-]+|\d+", word) if w and w not in FILL]
        if parts and all(w in STRONG or w in WEAK or w in TOPIC for w in parts):
            sure = len(parts) > 1 or parts[0] in STRONG or parts[0] in TOPIC and not anchor
            level = max(level, 2 if sure else 1)
    return level


def parse(page: str) -> Node:
    """DOM with text as plain strings among the children."""
    top = at = Node("#", None)
    pos, n = 0, len(page)
    for m in iter(lambda: TOKEN.search(page, pos) if pos < n else None, None):
        if m.start() > pos:
            at.kids.append(page[pos:m.start()])
        pos = m.end()
        if m[1] is not None:
            at.kids.append(m[1])
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            x = at
            while x is not top and x.tag != tag:
                x = x.up
            if x is not top:
                at = x.up
            continue
        if tag in RAW:
            # a self-closed one is empty; one that is never closed ends at its own tag, but for code
            end = None if m[4].endswith("/") and tag not in CODE else re.compile(r"</" + re.escape(tag) + r"\s*>", re.I).search(page, pos)
            pos = end.end() if end else n if tag in CODE else pos
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6") or tag in BLOCK:
            x = at  # an open paragraph ends where a block begins; so does an item where its like begins
            while x is not top and x.tag not in ("p", tag) and (x.tag not in BLOCK or x.tag == "p"):
                x = x.up
            if x is not top and (x.tag == "p" or x.tag == tag and tag in ("li", "td", "th", "tr", "dt", "dd")):
                at = x.up
        bad, cls, name = tag in CUT, "", 0
        if not bad and m[4].strip():
            for a in ATTR.finditer(m[4]):
                k, v = a[1].lower(), a[2] or a[3] or a[4] or ""
                if k == "class":
                    cls = v
                if k in ("class", "id", "role"):
                    name = max(name, name_level(v, k == "id"))
                bad |= k == "hidden" or k == "aria-hidden" and v.lower() == "true"
        if tag in ("body", "html", "main", "article"):
            bad, name = False, 0
        if tag == "header" and any(a.tag in ("article", "main") for a in _path(at)):
            bad = False
        x = Node(tag, at, bad, cls, name)
        at.kids.append(x)
        if tag not in VOID and not m[4].endswith("/"):
            at = x
    if pos < n:
        at.kids.append(page[pos:])
    return top


def _path(x):
    while x is not None:
        yield x
        x = x.up


def _order(top):
    todo, out = [top], []
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [k for k in x.kids if isinstance(k, Node) and not k.cut]
    return out


def _named(top, nodes):
    """The nodes left when elements are cut by their names; a name that does not hold is taken away."""
    if not any(x.name for x in nodes):
        return nodes
    for x in reversed(nodes):
        sub = [k for k in x.kids if isinstance(k, Node) and not k.cut]
        x.chars = sum(len(k.strip()) for k in x.kids if isinstance(k, str)) + sum(k.chars for k in sub)
        x.links = x.chars if x.tag == "a" else sum(k.links for k in sub)
        x.arts = (x.tag in ("article", "main")) + sum(k.arts for k in sub)
    for x in nodes:
        if x.name:
            dense = 0 < x.chars <= 3 * x.links
            if x.arts == top.arts if top.arts else 2 * x.chars >= top.chars and not dense:
                x.name = 0
            elif x.name == 2 or dense:
                x.cut = True
    return _order(top)


def _content(best, holder):
    """``holder`` and all other nodes that count as content: at or above the least density
    between ``best`` and the body, or siblings of content."""
    path = []
    for x in _path(best):
        if x.tag in ("#", "html"):
            break
        path.append(x)
        if x.tag == "body":
            break
    if not path:
        return {holder}
    least = min(x.density for x in path)
    above = set(_path(holder))
    found, todo = {holder}, [path[-1]]
    while todo:
        x = todo.pop()
        if x is holder or x.cut:
            continue
        if x not in above and x.chars and x.density >= least > 0:
            found.add(x)
        else:
            todo += [k for k in x.kids if isinstance(k, Node)]
    for up in {x.up for x in found if x.up is not None and x is not path[-1]}:
        kids = [k for k in up.kids if isinstance(k, Node) and not k.cut]
        like = {(k.tag, k.cls) for k in kids if k in found}
        found.update(k for k in kids if k not in above and 4 * k.links < k.chars and (k.tag in FLOW or (k.tag, k.cls) in like))
    return found


def main_text(page: str) -> str:
    """The content of one page, its blocks joined by one space."""
    if not page:
        return ""
    top = parse(page)
    nodes = _named(top, _order(top))
    for x in reversed(nodes):
        own = sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        sub = [k for k in x.kids if isinstance(k, Node) and not k.cut]
        x.chars = own + sum(k.chars for k in sub)
        x.tags = sum(k.tags + 1 for k in sub)
        x.links = x.chars if x.tag == "a" else sum(k.links for k in sub)
        x.ltags = sum(k.ltags + (k.tag == "a") for k in sub)
    body = next((x for x in nodes if x.tag == "body"), top)
    ratio = body.links / body.chars if body.chars else 0.0
    for x in reversed(nodes):
        free, tags = max(x.chars - x.links, 1), max(x.tags, 1)
        base = math.log(x.chars / free * x.links + ratio * x.chars + math.e)
        x.density = 0.0 if not x.chars else x.chars / tags * math.log(max(x.chars / max(x.links, 1) * tags / max(x.ltags, 1), 1.0), max(base, 1.01))
        x.sum = sum(k.density for k in x.kids if isinstance(k, Node) and not k.cut) + sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        if x.name:
            x.density, x.sum = x.density / 2, x.sum / 2
    best = max((x for x in nodes if x.tag not in ("#", "html")), key=lambda x: x.sum, default=top)
    if best.tag in ("p", "h1", "h2", "h3", "b", "i", "em", "strong", "span", "a", "li", "td", "tr", "blockquote"):
        best = next((a for a in _path(best) if a.tag in ("article", "main", "section", "div", "body", "td")), best)
    holder = next((a for a in _path(best) if a.tag in ("article", "main")), best)
    out, line = [], []

    def close():
        t = SPACE.sub(" ", html.unescape("".join(line))).strip()
        if t:
            out.append(t)
        line.clear()

    found = _content(best, holder)
    todo, start = [], [holder if holder.tag in ("#", "html") else top]
    while start or todo:
        if not todo:
            x = start.pop()
            if x in found:
                close()
                todo.append(x)
            elif not x.cut:
                start += [k for k in reversed(x.kids) if isinstance(k, Node)]
            continue
        x = todo.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            close()
        elif not x.cut:
            block = x.tag in BLOCK
            if block:
                close()
                todo.append(None)
            todo += reversed(x.kids)
    close()
    return " ".join(out)


def _batches(batches):
    for b in batches:
        t = [main_text(x.as_py() or "") for x in b.column(0)]
        yield pa.RecordBatch.from_arrays(b.columns[1:] + [pa.array(t, pa.string())], b.schema.names[1:] + ["text"])


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` columns of every page plus ``text``."""
    keep = [c for c in keep if c != "text"]
    src = pages.select(F.col(f"`{html_col}`").cast("string").alias("h"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("page"))
    out = src.mapInArrow(_batches, with_fields(src.select("page").schema, "text string"))
    return out.select("page.*", "text")
