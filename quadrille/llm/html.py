"""Main text of web pages by tag-path ratios (operator 9).

A page is a sequence of text blocks, each with its root-to-leaf path of block elements (inline markup is
part of its block). Per path, text length, punctuation and link text are summed and divided by the number
of blocks, and the ratios are fused to one score. The container that has most of the score is the article, as is an
element that says so, and all its blocks are kept but for lists of links; elsewhere a path's score, smoothed over
neighbouring blocks of the same container, is compared with a fraction of the page's mean. Elements that say by name or
role that they are not content (nav, footer, aside, form ...) never reach the ratios, nor do those that say so by class
or id (adverts, comments ...), unless they hold the page's only article or most of its text.

Everything is per page: no shuffle, and memory for one page. Time is linear in the page's length, whatever its markup.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.npx import pieces
from quadrille.llm.remote import remote

RAW = "script|style|noscript|template|svg|iframe|object|canvas|video|audio|math|textarea|select|title|button|datalist|map"
RAWS = frozenset(RAW.split("|"))
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
# attributes to the end of the tag; a quote counts only after an equals sign
ATTRS = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>")
DEPTH = 512  # elements nested deeper are taken as siblings, as browsers do
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split("|")}
SELF_CLOSED = re.compile(r"^/$|[\s\"']/$")
ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
LABEL = re.compile(r"\b(?:class|id)\s*=\s*[\"']?\s*([\w-]+)", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img br input".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REFUSED = frozenset("nav footer aside form dialog menu fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion comment comments disqus "
    "sidebar side nav navbar navigation navi menu breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations widget pagination pager toolbar search skip copyright legal disclaimer respond reply replies".split()
)
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
QUALIFIED = frozenset("has no with without".split())  # has-sidebar names a page, not a sidebar
CLOSED_BY = {  # an open element (first) ends where one of these starts
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"},
}
LISTS = frozenset("ul ol dl table".split())
CONTAINERS = frozenset("html body div section center".split())
SCOPES = frozenset("ul ol dl table body article section main div nav aside footer header form".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¡¿]")


def _hint(value: str) -> str:
    """"comment" or "hint" if one of the names in a class or id says that the element is no content."""
    for name in value.split():
        words = set(re.split(r"[^a-z]+", name))
        if words & QUALIFIED or words & {"work", "works"} and "related" in words:
            continue
        if not HINTS.isdisjoint(words):
            return "hint" if COMMENTS.isdisjoint(words) else "comment"
    return ""


def _refused(tag: str, attrs: str, inside_article: bool) -> str:
    """"element" if it is no content for sure, "hint" or "comment" if its class or id suggests so, else empty."""
    if tag in REFUSED or (tag == "header" and not inside_article):
        return "element"
    if not attrs.strip():
        return ""
    found = ""
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            found = found or _hint(value)
        elif name == "role" and value in ROLES or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "element"
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "element"
    return found


def _released(found: list[tuple], articles: list[tuple[int, ...]], comments: set[int]) -> set[int]:
    """Hinted elements that hold the content all the same: the page's only articles, or else most of its text.

    Outermost ones first, until an article or most of the text is free.
    """
    if articles:
        least = min(map(len, articles))
        return {k for inside in articles for k in inside[:least]}
    size = sum(len(x[1]) for x in found)
    total: dict[int, int] = {}
    above: dict[int, int] = {}
    for x in found:
        for k, parent in zip(x[5], (0, *x[5])):
            total[k] = total.get(k, 0) + len(x[1])
            above[k] = parent
    out: set[int] = set()
    for k in sorted(total):  # outer ones have lower numbers
        if 2 * total[k] > size and k not in comments and (not above[k] or above[k] in out):
            out.add(k)
    return out


class Paths:
    """The tag paths of a page as a tree: numbers for paths, with their parents. 0 is the empty path."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str], int] = {}
        self.parent, self.marks, self.box, self.depth = [0], [frozenset()], [True], [0]

    def child(self, path: int, tag: str, label: str) -> int:
        found = self.numbers.get((path, label))
        if found is None:
            found = self.numbers[path, label] = len(self.parent)
            self.parent.append(path)
            self.marks.append(self.marks[path] | {tag} if tag in ("article", "main") else self.marks[path])
            self.box.append(self.box[path] and tag in CONTAINERS)
            self.depth.append(self.depth[path] + 1)
        return found


def tokens(html: str):
    """(text before, tag or "", closing, attributes, end) of each tag, comment or declaration; text alone at the end.

    One pass: what has no end (comments, tags) is looked for once, and quotes that never close don't count from then on.
    The consumer sends the place to go on from where it is not ``end`` (raw elements).
    """
    at, n = 0, len(html)
    begin = 0  # of the text before
    last_gt = html.rfind(">")
    quoted = True
    while True:
        at = html.find("<", at)
        if at < 0:
            break
        if at > last_gt and not html.startswith("<!--", at):
            at += 1
            continue
        name, closing, attrs = "", False, ""
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = n if end < 0 else end + 3
        else:
            closing = html.startswith("/", at + 1)
            m = NAME.match(html, at + 1 + closing)
            if m:
                name = m[0].lower()
                end = html.find(">", m.end()) + 1
                plain = html[m.end() : end - 1]
                if quoted and ("\"" in plain or "'" in plain):
                    whole = ATTRS.match(html, m.end())
                    if whole:
                        end = whole.end()
                    else:
                        quoted = False
                attrs = html[m.end() : end - 1]
            elif closing or html.startswith(("!", "?"), at + 1):
                end = html.find(">", at) + 1
            else:
                at += 1
                continue
        jump = yield html[begin:at], name, closing, attrs, end
        at = begin = end if jump is None else jump
        if jump is not None:
            yield None
    yield html[begin:], "", False, "", n


def blocks(html: str) -> tuple[list[tuple], Paths]:
    """(path, text, link characters, links, list, hints) of each block of a page, in order; refused elements are left out.

    ``path`` is a number of the paths that come along; class or id tell containers apart in it. ``list`` is a number of
    the innermost list or table (0: none).
    """
    stack: list[str] = []  # block elements and links
    paths, path = Paths(), [0]  # path[k]: of the k outermost elements
    refused = 0  # height of the stack at the outermost refused element; 0: none
    serials: list[int] = []  # a number for each of the stack's elements
    hinted: list[tuple[int, int]] = []  # height and number of open elements that are refused unless they hold the content
    comments: set[int] = set()
    articles: list[tuple[int, ...]] = []  # the hinted elements around each article or main
    endless: set[str] = set()  # raw elements without a further end
    parts: list[str] = []
    links = anchors = last = 0
    found = []

    def enter(name: str, label: str) -> None:
        nonlocal last
        last += 1
        stack.append(name)
        path.append(path[-1] if name == "a" else paths.child(path[-1], name, label))
        serials.append(last)

    def flush() -> None:
        nonlocal links, anchors
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            within = next((serials[k] for k in range(len(stack) - 1, -1, -1) if stack[k] in LISTS), 0)
            found.append((path[-1], text, min(links, len(text)), anchors, within, tuple(k for _, k in hinted)))
        links = anchors = 0

    def leave(height: int) -> None:
        nonlocal refused
        del stack[height:], path[height + 1 :], serials[height:]
        while hinted and hinted[-1][0] > height:
            hinted.pop()
        if refused > height:
            refused = 0

    deeper = 0  # elements open beyond the depth
    stream = tokens(html)
    for piece, tag, closing, attrs, end in stream:
        if piece and not refused:
            text = unescape(piece)
            parts.append(text)
            if "a" in stack:
                links += len(text)
        if not tag:
            continue
        if tag in RAWS and not closing:
            if tag not in ("script", "style") and SELF_CLOSED.search(attrs):
                continue
            shut = ENDS[tag].search(html, end) if tag not in endless else None
            if shut:
                stream.send(shut.end())
            elif tag in ("script", "style"):
                stream.send(len(html))
            else:  # not closed: empty
                endless.add(tag)
            continue
        if tag == "head":  # holds raw and void elements only, and its end may be missing
            continue
        if tag in INLINE:
            if tag == "br" and not refused:
                parts.append(" ")
            elif tag == "a":
                if closing:
                    if "a" in stack:
                        leave(len(stack) - 1 - stack[::-1].index("a"))
                elif not refused:
                    while stack and stack[-1] == "a":
                        leave(len(stack) - 1)
                    enter("a", "a")
                    anchors += 1
            elif not closing and attrs.strip() and not refused and tag not in VOID and _refused(tag, attrs, True):
                enter(tag, tag)
                refused = len(stack)
            elif closing and refused and stack and stack[-1] == tag:
                leave(len(stack) - 1)
            continue
        if not refused:
            flush()
        if closing:
            if deeper and tag not in ("body", "html"):
                deeper -= 1
            elif tag in stack:
                leave(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag in VOID:
            continue
        if len(stack) >= DEPTH:
            deeper += not attrs.rstrip().endswith("/")
            continue
        while stack and stack[-1] == "a":
            leave(len(stack) - 1)
        if "p" in stack and not SCOPES.intersection(stack[len(stack) - stack[::-1].index("p") :]):
            leave(len(stack) - 1 - stack[::-1].index("p"))
        for k in range(len(stack) - 1, -1, -1):
            if tag in CLOSED_BY.get(stack[k], ()):
                leave(k)
                break
            if stack[k] in SCOPES:
                break
        inside_article = "article" in stack or "main" in stack
        label = LABEL.search(attrs) if attrs else None
        enter(tag, f"{tag}.{label[1].lower()}" if label and tag not in ("article", "main", "p") else tag)
        if not refused:
            why = _refused(tag, attrs, inside_article)
            if why == "element":
                refused = len(stack)
            elif why:
                hinted.append((len(stack), last))
                if why == "comment":
                    comments.add(last)
            elif tag in ("article", "main") and not any(_hint((a or b or c).lower()) for name, a, b, c in ATTR.findall(attrs) if name.lower() in ("class", "id")):
                articles.append(tuple(k for _, k in hinted))
        if attrs.rstrip().endswith("/"):
            leave(len(stack) - 1)
    if not refused:
        flush()
    free = _released(found, articles, comments)
    return [x for x in found if free.issuperset(x[5])], paths


def _link_lists(found: list[tuple]) -> list[bool]:
    """For each block, whether it is of a list or table, or a block beside those, of two links or more and little else."""
    sums: dict = {}
    keys = [x[4] or -k for k, x in enumerate(found, 1)]
    for key, (_, text, linked, anchors, *_) in zip(keys, found):
        x = sums.setdefault(key, [0, 0, 0])
        x[0] += len(text)
        x[1] += linked
        x[2] += anchors
    return [sums[key][2] > 1 and 10 * sums[key][1] >= 8 * sums[key][0] for key in keys]


def main_blocks(html: str, share: float = 0.15, blur: float = 0.25, most: float = 0.8) -> list[str]:
    """The texts of the blocks of the article, but for lists of links.

    The article is what the page marks as article or main, or else the innermost container that has ``most`` of the
    page's score, and beside it the paths that pass.
    """
    found, paths = blocks(html)
    for mark in ("article", "main"):
        if any(mark in paths.marks[x[0]] for x in found):
            found = [x for x in found if mark in paths.marks[x[0]]]
            return [x[1] for x, listed in zip(found, _link_lists(found)) if not listed]
    if not found:
        return []
    total: dict[int, list[float]] = {}
    for path, text, links, *_ in found:
        x = total.setdefault(path, [0, 0, 0, 0])
        x[0] += len(text)
        x[1] += len(PUNCTUATION.findall(text))
        x[2] += links
        x[3] += 1
    score = {p: chars / n * (1 + marks / n) * (1 - linked / chars) for p, (chars, marks, linked, n) in total.items()}
    values = [score[x[0]] for x in found]
    # a path passes as a whole, by the best of its blocks
    best: dict[int, float] = {}
    for k, (path, *_) in enumerate(found):
        near = [values[j] for j in (k - 1, k + 1) if 0 <= j < len(found) and paths.parent[found[j][0]] == paths.parent[path]]
        best[path] = max(best.get(path, 0), values[k] + blur * sum(near))
    size = sum(len(x[1]) for x in found)
    mean = sum(v * len(x[1]) for v, x in zip(values, found)) / size
    # the innermost container with most of the score; children come after their parents
    n = len(paths.parent)
    held = [0.0] * n
    for path, (*_, count) in total.items():
        held[path] = score[path] * count
    for path in range(n - 1, 0, -1):
        held[paths.parent[path]] += held[path]
    inner = max((p for p in range(n) if paths.box[p] and held[p] >= most * held[0]), key=paths.depth.__getitem__)
    inside = [False] * n
    for path in range(n):
        inside[path] = path == inner or path > 0 and inside[paths.parent[path]]
    listed = _link_lists(found)
    return [
        x[1] for x, links in zip(found, listed)
        if inside[x[0]] and not links or best[x[0]] >= share * mean and score[x[0]] > 0
    ]


def _extract(batches, html: str):
    for batch in pieces(batches, html):
        arrays = dict(zip(batch.schema.names, batch.columns))
        texts = ["\n\n".join(main_blocks(page)) if page else "" for page in arrays.pop(html).to_pylist()]
        arrays["text"] = pa.array(texts, pa.string())
        arrays["n_chars"] = pa.array(list(map(len, texts)), pa.int64())
        yield pa.RecordBatch.from_pydict(arrays)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text (blocks joined by two line feeds; empty if none) and n_chars in place of the html column.

    A null html is empty. Other columns stay as they are, but for ones named text and n_chars, which are replaced.
    Rows are independent: repeated rows and empty tables need no care.
    """
    rows = pages.drop(*({"text", "n_chars"} - {html_col}))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != html_col]
    return rows.mapInArrow(remote(__name__, "_extract", html=html_col), ", ".join([*kept, "text string", "n_chars long"]))
