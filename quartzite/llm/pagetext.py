"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element; scripts, styles, menus, page headers, footers,
sidebars, notices, adverts, forms and reader comments are dropped with their elements. The lengths of what is
left, links and buttons not counted, are summed over sliding windows of lines. The first line that lies in a
window whose sum surges over the threshold starts the text, the last one before the sums dive for good ends
it, and everything between them stays; a list that begins or ends there stays whole.

A form goes with what it holds, unless it holds half of the page's text: then it is a wrapper around the page.

Marks (article and main elements, and what is classed as one) are weights in those sums. Of the marked elements
the innermost that holds most of the marked text counts; its lines weigh a threshold more than their length and
lines elsewhere nothing, so the sums surge and dive around it, however short its paragraphs are. A heading
before it, in the same outer mark, counts as its own, and what has no weight next to the surge or the dive (a heading that is a link, a closing
paragraph of links) stays if it is in that element and in no list. Where marked text is less than a fifth of a page, marks
weigh nothing and the lengths alone decide: of all elements the innermost that holds most of the page's text is the
densest, its own lines weigh a threshold more, and windows end at its border, so what stands around it stays only if
it reaches the threshold by itself or is marked. A copyright line has no weight; a heading right before it counts as its own.

Classes, ids and roles are compared by whole names, or where every part of a compound is known.

Nulls: a null page has no text. Unclosed elements, cut-off tags and stray brackets are taken as browsers
do. Repeated rows each come out, an empty table gives no rows, other columns do not matter. Very long and deeply nested pages are
taken whole, in time that grows with their length.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

# Elements of HTML.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg canvas audio video select".split())
DROPPED = frozenset("nav footer aside menu dialog".split())
GAP = frozenset("br td th".split())
#: Elements that can be the densest.
BOXES = frozenset("article body center div fieldset form main section table".split())
#: Elements that hold other blocks, and lists, which stay whole.
HOLDS = frozenset("div section aside ul ol dl table details fieldset figure".split())
GROUPS = frozenset("ul ol dl".split())
#: Names in class, id or role of what is not the article, wherever they stand.
MARKS = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification notifications pager pagination paywall popup promo promoted side-bar sidebar sponsor sponsored subscribe toolbar".split())
#: Names that mean it only on elements that hold other blocks, since they can also describe a paragraph.
HOLDER_MARKS = frozenset("alert announcement dialog disclaimer login privacy promotion related replies reply search share sharing signup skip social subscription toast toc widget".split())
#: Parts that say nothing in a compound with one of these.
NEUTRAL = frozenset("area article articles bar block body bottom box btn button buttons container content count form global group header holder icons inner item items latest left legal link links list main message new outer overlay page panel post posts primary reader readers right row secondary section site slot stories text this thread title top unit user users visitor warning widgets wrap wrapper".split())
HEADER_MARKS = frozenset("header topbar".split())
#: Names that mark the article.
ARTICLE_MARKS = frozenset("article articlebody content entry main post story".split())
TITLE_PARTS = frozenset("article body content entry main page post primary single story text".split())
#: An article's mark is trusted over these.
NOT_ARTICLES = frozenset("ad advert comment comments promo related replies reply".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z0-9]+|[^\x00-\x7f]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

#: Lines of a window; share of the largest sum, and the number of characters, that a surge takes at most.
WINDOW, SHARE, SURGE = 3, 0.25, 86
#: Share of the page's text from which marks weigh.
TRUST = 0.2
#: How a line of rights begins.
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


def names_of(attrs: str) -> list:
    """The parts of each name in class, id, role and itemprop."""
    names = []
    for m in ATTR.finditer(attrs):
        for name in (m[2] or m[3] or m[4] or "").split():
            names.append(frozenset([name.lower()]))
            parts = frozenset(PART.findall(CAMEL.sub(" ", name).lower()))
            if len(parts) > 1:
                names.append(parts)
    return names


def among(names: list, marks: frozenset, neutral: frozenset = NEUTRAL) -> bool:
    """Whether a name is one of the marks, or a compound of marks and neutral parts only."""
    return any(parts & marks and parts <= marks | neutral for parts in names)


def dropped(name: str, attrs: str, names: list, in_article: bool) -> bool:
    """Whether an element goes with all it holds."""
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if name in ("html", "body") or not attrs:
        return False
    if HIDDEN.search(attrs):
        return True
    if name == "main" or (name == "article" and not among(names, NOT_ARTICLES)):
        return False
    if among(names, MARKS, NEUTRAL | HOLDER_MARKS) or (name in HOLDS and among(names, HOLDER_MARKS)):
        return True
    return name in HOLDS and not in_article and among(names, HEADER_MARKS, frozenset("bar container global main page site top wrap wrapper".split()))


def marks_article(name: str, names: list) -> bool:
    return name in ("article", "main") or (name in BLOCK and name not in ("html", "body", "head") and among(names, ARTICLE_MARKS, TITLE_PARTS))


class Box:
    """An element that holds blocks: the one around it, and its place among all."""

    __slots__ = ("up", "number")

    def __init__(self, up, number):
        self.up, self.number = up, number


class Line:
    """text; plain: characters in it that are not in links or buttons; marks: numbers of the marked elements around it,
    outermost first; heading: whether it is one; group: the outermost list around it, 0 for none; form: likewise;
    box: the innermost box around it, or None."""

    __slots__ = ("text", "plain", "marks", "heading", "group", "form", "box")

    def __init__(self, text, plain, marks=(), heading=False, group=0, form=0, box=None):
        self.text, self.plain, self.marks, self.heading, self.group, self.form, self.box = text, plain, marks, heading, group, form, box


def without_forms(lines: list) -> list:
    """Lines of forms go, but for a form that holds half of a page's text or more: it is a wrapper around the page."""
    mass: dict = {}
    for x in lines:
        mass[x.form] = mass.get(x.form, 0) + x.plain
    return [x for x in lines if not x.form or 2 * mass[x.form] >= sum(mass.values())]


def lines_of(page: str) -> list:
    """The page's lines that have text."""
    lines, parts, linked, pressed = [], [], 0, 0
    open_, marks, group, form, box, number = [], (), 0, 0, None, 0  # block elements around this place, and what they say
    anchor = button = 0
    heading = False
    skip, depth = "", 0
    at, n = 0, len(page)

    def flush():
        nonlocal parts, linked, pressed
        text = " ".join("".join(parts).split())
        if text and pressed < len(text):  # a line of buttons only is none
            lines.append(Line(text, max(0, len(text) - linked - pressed), marks, heading, group, form, box))
        parts, linked, pressed = [], 0, 0

    def leave(name: str):
        """Close the innermost element of that name and all in it; without one nothing is closed."""
        nonlocal marks, group, form, box
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] == name:
                marks, group, form, box = open_[i][1:]
                del open_[i:]
                return

    while at < n:
        lt = page.find("<", at)
        upto = n if lt < 0 else lt
        if upto > at and not skip:
            text = html.unescape(page[at:upto])
            parts.append(text)
            if button:
                pressed += len(" ".join(text.split()))
            elif anchor:
                linked += len(" ".join(text.split()))
        if lt < 0:
            break
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        if not (after.isascii() and after.isalpha()) and not (after == "/" and page[lt + 2 : lt + 3].isalpha()):
            if not skip:
                parts.append("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt) or LOOSE.match(page, lt)
        if not m:  # cut off
            break
        at, close, name = m.end(), bool(m[1]), m[2].lower()
        if skip:
            if name == skip:
                depth += -1 if close else 0 if name in ("p", "li") else 1
                if depth <= 0:
                    skip = ""
                elif name in ("p", "li"):  # the next one closes it
                    skip, at = "", lt
            elif skip == "p" and name in BLOCK:
                skip, at = "", lt
            continue
        if name in BLOCK:
            flush()
            heading = not close and len(name) == 2 and name[0] == "h" and name[1].isdigit()
            if not close and open_ and open_[-1][0] == "p":
                leave("p")
        elif name in GAP:
            parts.append(" ")
        if name == "a":
            anchor = 0 if close else 1
        elif name == "button":
            button = 0 if close else 1
        if close:
            if name in BLOCK:
                leave(name)
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = END[name].search(page, at)
            at = n if not end else (page.find(">", end.start()) + 1 or n)
            continue
        names = names_of(m[3]) if "=" in m[3] else []
        if dropped(name, m[3], names, bool(marks)):
            skip, depth = name, 1
        elif name in BLOCK:
            open_.append((name, marks, group, form, box))
            number += 1
            if name in BOXES:
                box = Box(box, number)
            if marks_article(name, names):
                marks += (number,)
            if name in GROUPS and not group:
                group = number
            if name == "form" and not form:
                form = number
    if not skip:
        flush()
    return without_forms(lines)


def counted_mark(lines: list, size: list) -> int:
    """The innermost marked element that holds most of the marked text, 0 where marks hold too little to weigh."""
    mass: dict = {}
    depth: dict = {}
    for x, s in zip(lines, size):
        for i, m in enumerate(x.marks):
            mass[m], depth[m] = mass.get(m, 0) + s, i
    most = max(mass.values(), default=0)
    if not most or most < TRUST * sum(size):
        return 0
    return max((m for m, s in mass.items() if s >= (1 - SHARE) * most), key=lambda m: (depth[m], mass[m]))


def densest(lines: list, size: list) -> Box | None:
    """The innermost box that holds most of the page's text. Boxes that do lie in each other, so it is the last opened."""
    mass: dict = {}
    for x, s in zip(lines, size):
        b = x.box
        while b and b not in mass:
            mass[b] = 0
            b = b.up
        if x.box:
            mass[x.box] += s
    for b in sorted(mass, key=lambda b: -b.number):
        if b.up:
            mass[b.up] += mass[b]
    return max((b for b, m in mass.items() if m >= (1 - SHARE) * sum(size)), key=lambda b: b.number, default=None)


def within(lines: list, box: Box) -> list:
    """Whether each line is in the box."""
    known = {box: True, None: False}
    for x in lines:
        path, b = [], x.box
        while b not in known:
            path.append(b)
            b = b.up
        known.update(dict.fromkeys(path, known[b]))
    return [known[x.box] for x in lines]


def weights_of(lines: list) -> tuple[list, list, list]:
    """What each line adds to the sums: its plain characters, if they are more than half of it; where marks
    weigh, a threshold more inside the marked element that counts, and nothing elsewhere; where they do not, a threshold
    more for the densest box's own lines. Then the side of a border on which each line is, and whether it stays without weight."""
    size = [x.plain if 2 * x.plain > len(x.text) else 0 for x in lines]
    own = counted_mark(lines, size)
    if own:
        inside = [own in x.marks for x in lines]
        first = inside.index(True)
        root = lines[first].marks[0]
        out = []
        for i, (x, s) in enumerate(zip(lines, size)):
            title = i < first and x.heading and root in x.marks
            out.append(s + SURGE if s and (inside[i] or title) else 0)
        return out, [True] * len(lines), [y and not x.group for x, y in zip(lines, inside)]
    box = densest(lines, size)
    if not box:
        return size, [True] * len(lines), [False] * len(lines)
    inside = [y or bool(x.marks) for x, y in zip(lines, within(lines, box))]  # no border before what is marked
    first = start = inside.index(True)
    while start and size[start - 1] and not lines[start].heading:  # back to a heading, past lines of text only
        start -= 1
    if lines[start].heading and not inside[start]:
        inside[start:first] = [True] * (first - start)
    out = []
    for i, (x, s) in enumerate(zip(lines, size)):
        own = inside[i] and (x.box is box or (i < first and x.heading))
        out.append(0 if RIGHTS.match(x.text) else s + SURGE if s and own else s)
    return out, inside, [False] * len(lines)


def window_sums(size: list, side: list) -> list:
    """The sum of the window that starts at each line; windows end at borders."""
    sums = []
    for i in range(len(size)):
        j = i
        while j < min(i + WINDOW, len(size)) and side[j] == side[i]:
            j += 1
        sums.append(sum(size[i:j]))
    return sums


def surge_and_dive(size: list, side: list) -> tuple[int, int]:
    """The first and the last line that lie in a window over the threshold, have weight, and are on its side of a border."""
    sums = window_sums(size, side)
    bar = min(SURGE, max(sums) * SHARE)

    def high(i: int) -> bool:
        starts = range(max(0, i - WINDOW + 1), i + 1)
        return any(sums[j] >= bar and all(side[k] == side[i] for k in range(j, i)) for j in starts)

    found = [i for i, s in enumerate(size) if s and high(i)]
    return found[0], found[-1]


def main_lines(lines: list) -> list:
    """The lines between surge and dive."""
    size, side, stays = weights_of(lines)
    if not any(size):
        return []
    surge, dive = surge_and_dive(size, side)
    while dive + 1 < len(lines) and lines[dive + 1].group and lines[dive + 1].group == lines[dive].group and 2 * lines[dive + 1].plain > len(lines[dive + 1].text):
        dive += 1
    while surge and lines[surge - 1].group and lines[surge - 1].group == lines[surge].group and 2 * lines[surge - 1].plain > len(lines[surge - 1].text):
        surge -= 1
    # A heading that is a link, or a last paragraph that is mostly one, has no weight of its own, but in the element that counts it stays.
    while dive + 1 < len(lines) and stays[dive + 1]:
        dive += 1
    while surge and stays[surge - 1]:
        surge -= 1
    return [x.text for x in lines[surge : dive + 1]]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_lines(lines_of(page))) if page else ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches):
        for b in pieces(batches):
            texts = [main_text(t.as_py()) for t in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
