"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into text blocks with their ancestors. A linear classifier gives each block a cost
for either label; these are the capacities of its edges to the terminals. Blocks that follow each
other, and blocks near each other in the document tree, are joined by smoothness edges. A minimum
cut between the terminals is the labelling of least total cost.
"""

import html
import math
import re

import pyarrow as pa
from pyspark.sql import functions as F

from itemscope.llm.common import arrow, bounded_batches, slices

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template iframe object svg math canvas head title "
                   "select textarea button".split())
HEAD = frozenset("title script style meta link base noscript template".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr "
    "ul".split())
#: A start tag of the key closes an open element of the value, if no other block lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# The classifier: log-odds for content of an ancestor element, of a word in its class or id, and
# of the block itself. The nearest ancestors weigh as much as all others.
ELEMENT = {"nav": -8, "footer": -8, "aside": -8, "form": -8, "menu": -8, "dialog": -8,
           "fieldset": -6, "header": -3, "address": -2, "article": 5, "main": 4}
NAMES = {
    -8: "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb "
        "breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login "
        "masthead menu modal nav navbar navigation newsletter notice notices pagination pager "
        "feedback popup promo promotion related recommended recommendations respond responses replies "
        "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
        "teaser toolbar topbar widget widgets alert disclaimer copyright privacy",
    -3: "header tags tag meta byline outbrain taboola rail reply",
    3: "article post entry content main story body text prose",
}
HINTS = {word: weight for weight, line in NAMES.items() for word in line.split()}
#: Length weighs by the logarithm of the words (of WORD characters on average, so that scripts
#: without spaces count) outside links: 1 at SOME words, LONGEST at most. It outgrows what elements
#: that are not made for text lose by PLAIN, and by UNENDED if no sentence ends in them, but not
#: what navigation loses.
LINK_WEIGHT, PLAIN, UNENDED, WORD, SOME, LONGEST = -4.0, -1.0, -0.5, 6, 10, 3.0
#: Where the elements around come to this or less, those inside of them tell nothing good.
OUTSIDE = -5.0
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*(?:\s|$)|[。！？]")
#: Smoothness between blocks that follow each other: alike and with one parent, and else.
SIBLINGS, NEIGHBOURS = 1.0, 0.3


class _Block:
    __slots__ = ("text", "linked", "tag", "mark", "parent", "score")

    def __init__(self, text, linked, tag, mark, parent):
        self.text, self.linked, self.tag, self.mark, self.parent = text, linked, tag, mark, parent
        self.score = 0

    def words(self):
        return len(self.text) * (1 - self.linked) / WORD


def _markup(page):
    """(start, end, closing, tag, attributes) of the markup of a page; comments have no tag.

    A quote that nothing ends, or that ends in front of more of a value, does not hide the end of
    its tag. A tag without an end is text. Every sign is looked for once, so long pages of any kind
    are read in linear time.
    """
    ahead = dict.fromkeys(">\"'", -1)    # the next one of each; none at the length of the page
    n = len(page)

    def after(sign, at):
        if ahead[sign] < at:
            ahead[sign] = page.find(sign, at)
            if ahead[sign] < 0:
                ahead[sign] = n
        return ahead[sign]

    at = 0
    while (at := page.find("<", at)) >= 0:
        start, name = at, None
        for opens, ends in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if page.startswith(opens, at):
                end = page.find(ends, at + len(opens))
                at = n if end < 0 else end + len(ends)
                break
        else:
            name = _NAME.match(page, at + 1)
            end = after(">", at)
            if not (name or page[at + 1:at + 2] in ("!", "?")) or end == n:
                at += 1
                continue
            if name:
                stop = name.end()
                while (found := _STOP.search(page, stop)) and found.group() != ">":
                    close = after(found.group(), found.end())
                    if close >= n - 1 or page[close + 1] not in " \t\r\n\f/>":
                        stop = after(">", found.end())
                        break
                    stop = close + 1
                else:
                    stop = found.start() if found else n
                if stop == n:
                    at += 1
                    continue
                end = stop
            at = end + 1
        if not name:
            yield start, at, False, "", ""
            continue
        tag = name.group().lower()
        closing = tag[0] == "/"
        tag = tag.lstrip("/")
        yield start, at, closing, tag, page[name.end():end]
        if not closing and tag in RAW:
            ended = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = ended.start() if ended else n


def _hint(tag, attributes):
    """Log-odds of an element, and the part of them that does not hold for a wrapper of the page."""
    score, loose = ELEMENT.get(tag, 0), ELEMENT["form"] if tag == "form" else 0
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        for word in _WORD.findall(value.lower()):
            if tag not in ("body", "html"):
                hint = HINTS.get(word, 0)
                score, loose = score + hint, loose + min(hint, 0)
    return score, loose


def _weigh(found, marks):
    """Sets the scores of blocks from the marks (parent, log-odds, loose part) of their ancestors.

    Names like "no-sidebar" on an element around most of the page's text tell of its layout. Such
    an element keeps its penalty only if the page's text begins outside of it, as that of comments
    does. Marks come after their parents, so all is added up along the tree.
    """
    free, held = [True], [0.0] * len(marks)
    for parent, hint, loose in marks[1:]:
        free.append(free[parent] and hint >= loose)
    for block in found:
        if free[block.mark]:
            held[block.mark] += block.words()
    for i in range(len(marks) - 1, 0, -1):
        held[marks[i][0]] += held[i]
    wide = {i for i, (_, _, loose) in enumerate(marks) if loose and 2 * held[i] > held[0]}
    wrappers = set()
    if wide:
        clear, good = [True], [False]
        for i, (parent, hint, loose) in enumerate(marks[1:], 1):
            clear.append(clear[parent] and (not loose or i in wide))
            good.append(good[parent] or hint - loose >= ELEMENT["main"])
        open_ = [b for b in found if free[b.mark] and clear[b.mark]]
        first = next((b for b in open_ if b.words() >= SOME), None) or \
            next((b for b in open_ if good[b.mark]), None)
        at = first.mark if first else 0
        while at:
            wrappers.add(at)
            at = marks[at][0]
        wrappers &= wide
    scores = [0]
    for i, (parent, hint, loose) in enumerate(marks[1:], 1):
        hint -= loose if i in wrappers else 0
        # An article inside of comments is a comment.
        scores.append(scores[parent] + (hint if hint < 0 or scores[parent] > OUTSIDE else 0))
    for block in found:
        block.score = scores[block.mark]


def blocks(page):
    """Text blocks of an HTML page in page order."""
    out, parts = [], []
    open_, holders, count = [], [], {}     # open_: (tag, mark); holders: (tag, number, place in open_)
    marks = [(0, 0, 0)]                    # the first stands for the page
    state = {"linked": 0, "unread": 0, "links": 0, "number": 0}

    def close():
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            parent = holders[-2][1] if len(holders) > 1 else 0
            out.append(_Block(text, min(1.0, state["linked"] / len(text)), holders[-1][0] if holders else "",
                              open_[-1][1] if open_ else 0, parent))
        state["linked"] = 0

    def read(piece):
        if piece and not state["unread"]:
            parts.append(piece)
            if state["links"]:
                state["linked"] += len(piece.strip())

    def end(index):
        if holders and holders[-1][2] >= index:
            close()
        while holders and holders[-1][2] >= index:
            holders.pop()
        for t, _ in open_[index:]:
            count[t] -= 1
            state["unread"] -= t in UNREAD
            state["links"] -= t == "a"
        del open_[index:]

    def end_tag(tag):
        index = len(open_) - 1
        while open_[index][0] != tag:
            index -= 1
        end(index)

    at = 0
    for start, after, closing, tag, attributes in _markup(page):
        read(page[at:start])
        at = after
        if not tag:
            continue
        if closing:
            if count.get(tag):
                end_tag(tag)
            elif tag == "br":
                read(" ")
            continue
        if count.get("head") and tag not in HEAD and not count.get("noscript") and not count.get("template"):
            end_tag("head")     # its end tag may be left out
        if tag in VOID:
            if tag == "hr":
                close()
            read(" ")
            continue
        if tag in BLOCKS:
            close()
            if holders and (holders[-1][0] == "p" or holders[-1][0] in CLOSES.get(tag, ())):
                end(holders[-1][2])
        if attributes.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        state["number"] += 1
        mark, hint = open_[-1][1] if open_ else 0, _hint(tag, attributes)
        if any(hint):
            marks.append((mark, *hint))
            mark = len(marks) - 1
        if tag in BLOCKS:
            holders.append((tag, state["number"], len(open_)))
        open_.append((tag, mark))
        count[tag] = count.get(tag, 0) + 1
        state["unread"] += tag in UNREAD
        state["links"] += tag == "a"
    read(page[at:])
    close()
    _weigh(out, marks)
    return out


def _cost(block):
    """Log-odds that a block is content."""
    length = min(LONGEST, math.log2(1 + block.words() / SOME))
    if block.tag in ("p", "h1", "h2", "h3", "h4", "blockquote", "pre", "li", "td", "dd", "figcaption"):
        plain = 0.5
    else:
        plain = PLAIN if _SENTENCE.search(block.text) else PLAIN + UNENDED
    return block.score + length + LINK_WEIGHT * block.linked + plain


def minimum_cut(costs, edges):
    """Labels of least cost: True pays 0 or -cost, False pays 0 or cost, an edge cut its weight.

    A node whose own cost outweighs all its edges keeps its label in a minimum cut, and is folded
    into its neighbours first; a maximum flow settles the rest.
    """
    near = [{} for _ in costs]
    for i, j, weight in edges:
        near[i][j] = near[i].get(j, 0) + weight
        near[j][i] = near[j].get(i, 0) + weight
    costs, labels = list(costs), [None] * len(costs)
    todo = list(range(len(costs)))
    while todo:
        i = todo.pop()
        if labels[i] is None and abs(costs[i]) >= sum(near[i].values()):
            labels[i] = costs[i] > 0
            for j, weight in near[i].items():
                del near[j][i]
                costs[j] += weight if labels[i] else -weight
                todo.append(j)
            near[i] = {}
    left = [i for i, label in enumerate(labels) if label is None]
    if not left:
        return labels
    number = {i: k for k, i in enumerate(left)}
    source, sink = len(left), len(left) + 1
    edges = [[] for _ in range(sink + 1)]      # numbers into heads and room; the pair of e is e ^ 1
    heads, room = [], []

    def join(i, j, there, back):
        for a, b, capacity in ((i, j, there), (j, i, back)):
            edges[a].append(len(heads))
            heads.append(b)
            room.append(capacity)
    for i in left:
        if costs[i] > 0:
            join(source, number[i], costs[i], 0.0)
        else:
            join(number[i], sink, -costs[i], 0.0)
        for j, weight in near[i].items():
            if i < j:
                join(number[i], number[j], weight, weight)
    # Dinic: paths of one length are filled together, along levels that are found anew each time.
    while True:
        level, queue = [-1] * (sink + 1), [source]
        level[source] = 0
        for i in queue:
            for e in edges[i]:
                if room[e] > 1e-12 and level[heads[e]] < 0:
                    level[heads[e]] = level[i] + 1
                    queue.append(heads[e])
        if level[sink] < 0:
            break
        tried, path, at = [0] * (sink + 1), [], source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                keep = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                at = heads[path[keep] ^ 1]
                del path[keep:]
            while tried[at] < len(edges[at]):
                e = edges[at][tried[at]]
                if room[e] > 1e-12 and level[heads[e]] == level[at] + 1:
                    path.append(e)
                    at = heads[e]
                    break
                tried[at] += 1
            else:
                if not path:
                    break
                level[at] = -1
                at = heads[path.pop() ^ 1]
                tried[at] += 1
    for i in left:
        labels[i] = level[number[i]] >= 0
    return labels


def main_text(page):
    """The blocks of a page that a minimum cut labels content, joined by line ends."""
    found = blocks(page)
    edges, last = [], {}
    for i, block in enumerate(found):
        before = last.get(block.parent)
        if before is not None:
            alike = found[before].score == block.score and \
                (found[before].linked > 0.5) == (block.linked > 0.5)
            edges.append((before, i, SIBLINGS if alike else NEIGHBOURS))
        if i and before != i - 1:
            edges.append((i - 1, i, NEIGHBOURS))
        last[block.parent] = i
    labels = minimum_cut([_cost(b) for b in found], edges)
    return "\n".join(b.text for b, label in zip(found, labels) if label)


def main_texts(pages):
    """page_id, url, text and n_chars (code points) of every page.

    NULL and empty pages, and pages without a content block, have the empty text. Rows that repeat
    a page_id have results of their own; NULL ids and urls stay NULL; an empty table gives no
    rows; further columns are dropped. A page of any length is read whole. One narrow pass.
    """
    def run(batches):
        for part in slices(batches, "html"):
            found = [main_text(h) for h in part.column("html").to_pylist()]
            yield arrow(page_id=part.column("page_id"), url=part.column("url"),
                        text=(found, pa.string()), n_chars=([len(t) for t in found], pa.int64()))

    return bounded_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")) \
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")
