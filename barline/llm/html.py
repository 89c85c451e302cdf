"""Main text of web pages: flat blocks, described by word count and link density of themselves and their neighbours.

A page is cut into flat text blocks at block-level tags. A small decision tree, grown here from ``EXAMPLES``, sorts
them by the words and the share of words inside links of the block and of its two neighbours, by the part of the page
that they stand in, and by the longest block of the page. As in a browser, ``a<b and c>d`` is read as a tag.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Tags that end a block. Others (b, a, span, ...) are part of the running text; br is white space.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: Block tags that open a part of the page and are closed by their end tag.
PART = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header head main menu nav ol section table td ul".split())
#: Tags whose content is no text of the page.
OPAQUE = frozenset("script style noscript template svg math iframe object canvas textarea select button title".split())
ASIDE = frozenset("nav header footer aside menu dialog head".split())
#: Words in class, id or role that mark parts beside the article.
BESIDE = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert "
    "popup modal overlay menu nav navbar navigation navigator breadcrumb breadcrumbs sidebar sidebars masthead topbar toolbar header footer "
    "comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup "
    "login widget widgets pagination pager copyright contentinfo complementary search".split()
)
#: Words of short names that mark the comments of readers and adverts, which stay beside the text however long they are.
NEVER_TEXT = frozenset("ad ads advert advertisement advertising adsense sponsor sponsored promo promotion comment comments disqus respond reply replies".split())
#: A word of BESIDE after one of these tells how a wrapper is laid out, not what it holds: has-sidebar, no-header.
LAYOUT = frozenset("has have no not with without hide".split())
#: Words that end the name of a state.
STATES = frozenset("open closed on off free enabled disabled allowed".split())
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TAG_REST = re.compile(r""">|=\s*(["'])""")
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
SPACE = re.compile(r"\s+")

#: Features of a block, in order.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "longest")
#: The place: parts beside the text, outside a marked article, a page that marks none, inside a marked article.
BESIDE_TEXT, OUTSIDE, UNMARKED, INSIDE = range(4)
#: The labelled table of pages whose longest unlinked block is long: the features up to the place, then whether the block
#: belongs to the main text.
LONG_PAGES = (
    # Paragraphs, long and short, and headings of an article.
    (120, 0.0, 80, 0.0, 95, 0.0, 3, 1), (2, 0.0, 200, 0.0, 3, 0.0, 3, 1), (1, 0.0, 90, 0.0, 6, 0.1, 3, 1),
    (12, 0.0, 7, 0.0, 150, 0.0, 3, 1), (45, 0.2, 60, 0.0, 70, 0.1, 3, 1), (8, 0.0, 0, 0.0, 40, 0.0, 3, 1),
    (5, 1.0, 50, 0.0, 60, 0.0, 3, 1), (30, 0.0, 1, 1.0, 9, 0.0, 3, 1),
    # Beside the article on pages that mark it: menus, notices, footers, adverts.
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (9, 0.0, 1, 1.0, 12, 0.0, 0, 0), (10, 0.0, 4, 0.0, 0, 0.0, 0, 0),
    (60, 0.0, 9, 0.3, 0, 0.0, 1, 0), (25, 0.0, 1, 1.0, 30, 0.0, 1, 0), (3, 0.6, 2, 1.0, 20, 0.0, 1, 0),
    (80, 0.0, 120, 0.0, 40, 0.0, 0, 0), (2, 0.0, 150, 0.0, 1, 0.0, 1, 0),
    # Inside the marked article but beside its text: adverts, comments, shares.
    (14, 0.0, 90, 0.0, 110, 0.0, 0, 0), (70, 0.0, 90, 0.0, 20, 0.0, 0, 0), (2, 1.0, 60, 0.0, 2, 1.0, 0, 0),
    (1, 0.0, 3, 1.0, 0, 0.0, 0, 0),
    # Pages without a marked article: running text and its headings, which stand before or between long blocks.
    (90, 0.0, 40, 0.0, 60, 0.0, 2, 1), (35, 0.1, 1, 1.0, 80, 0.0, 2, 1), (12, 0.0, 60, 0.0, 55, 0.0, 2, 1),
    (6, 0.0, 70, 0.0, 45, 0.0, 2, 1), (7, 0.0, 1, 1.0, 90, 0.0, 2, 1), (4, 0.0, 90, 0.0, 30, 0.0, 2, 1),
    (3, 0.0, 12, 0.0, 40, 0.0, 2, 1), (20, 0.0, 0, 0.0, 0, 0.0, 2, 1), (2, 0.0, 0, 0.0, 15, 0.0, 2, 1),
    (40, 0.0, 1, 1.0, 2, 0.0, 2, 1), (60, 0.0, 5, 0.0, 6, 1.0, 2, 1), (8, 0.0, 45, 0.0, 30, 0.1, 2, 1),
    (50, 0.0, 2, 1.0, 1, 1.0, 2, 1), (18, 0.0, 35, 0.0, 20, 0.0, 2, 1), (14, 0.0, 20, 0.0, 70, 0.0, 2, 1),
    (70, 0.0, 6, 0.0, 1, 1.0, 2, 1), (16, 0.0, 40, 0.0, 1, 1.0, 2, 1),
    # Short paragraphs after long ones: at the end, before a heading, before another short one.
    (10, 0.0, 60, 0.0, 0, 0.0, 2, 1), (12, 0.0, 45, 0.0, 0, 0.0, 2, 1), (13, 0.0, 70, 0.0, 6, 0.0, 2, 1), (9, 0.0, 50, 0.0, 4, 0.0, 2, 1),
    (11, 0.0, 38, 0.0, 9, 0.0, 2, 1), (6, 0.0, 42, 0.0, 12, 0.0, 2, 1),
    # There, linked blocks, and unlinked ones beside the text: notices between links, copyright lines after them, adverts
    # before their link, comments between the lines that name their readers.
    (1, 1.0, 1, 1.0, 1, 1.0, 2, 0), (6, 0.9, 2, 1.0, 40, 0.0, 2, 0), (15, 0.7, 50, 0.0, 3, 1.0, 2, 0),
    (3, 1.0, 80, 0.0, 4, 1.0, 2, 0), (8, 0.0, 2, 1.0, 1, 1.0, 2, 0), (15, 0.0, 1, 1.0, 2, 1.0, 2, 0),
    (3, 0.0, 1, 1.0, 2, 1.0, 2, 0), (6, 0.0, 3, 1.0, 0, 0.0, 2, 0), (5, 0.0, 2, 1.0, 0, 0.0, 2, 0),
    (9, 0.0, 1, 1.0, 0, 0.0, 2, 0), (9, 0.0, 80, 0.0, 2, 1.0, 2, 0), (7, 0.0, 60, 0.0, 3, 1.0, 2, 0), (11, 0.0, 48, 0.0, 1, 1.0, 2, 0), (13, 0.0, 55, 0.0, 4, 1.0, 2, 0),
    (12, 0.0, 3, 0.0, 3, 0.0, 2, 0), (9, 0.0, 2, 0.0, 4, 0.0, 2, 0), (3, 0.0, 12, 0.0, 9, 0.0, 2, 0),
    (2, 0.0, 9, 0.0, 14, 0.0, 2, 0), (14, 0.0, 4, 0.0, 2, 1.0, 2, 0), (3, 0.0, 14, 0.0, 11, 0.0, 2, 0),
    (4, 0.0, 2, 1.0, 12, 0.0, 2, 0), (10, 0.0, 3, 0.0, 0, 0.0, 2, 0),
    (12, 0.0, 60, 0.0, 3, 0.5, 0, 0), (50, 0.0, 20, 0.0, 30, 0.0, 0, 0),
    (1, 0.0, 5, 0.0, 0, 0.0, 0, 0), (4, 0.5, 30, 0.0, 0, 0.0, 0, 0),
    # In a marked article: lists of links, and comments and adverts between links; titles stand there too, but are shorter.
    (4, 1.0, 3, 1.0, 5, 1.0, 3, 0), (2, 1.0, 2, 1.0, 3, 1.0, 3, 0), (12, 0.0, 2, 1.0, 3, 1.0, 3, 0), (15, 0.0, 3, 1.0, 1, 1.0, 3, 0),
    (6, 0.0, 0, 0.0, 2, 1.0, 3, 1), (8, 0.0, 1, 1.0, 2, 1.0, 3, 1), (3, 0.0, 1, 1.0, 3, 1.0, 3, 1), (10, 0.0, 2, 1.0, 1, 1.0, 3, 1),
    (13, 0.0, 9, 0.0, 8, 0.0, 3, 1), (14, 0.0, 30, 0.0, 5, 0.0, 3, 1), (12, 0.0, 4, 0.0, 13, 0.0, 3, 1), (15, 0.0, 12, 0.0, 2, 0.0, 3, 1),
    (13, 0.0, 3, 0.0, 0, 0.0, 3, 1), (14, 0.0, 2, 1.0, 11, 0.0, 3, 1), (15, 0.0, 20, 0.0, 2, 1.0, 3, 1), (12, 0.0, 9, 0.0, 3, 1.0, 3, 1),
    (80, 0.0, 4, 1.0, 60, 0.0, 3, 1), (40, 0.0, 5, 1.0, 30, 0.0, 3, 1), (25, 0.0, 3, 1.0, 20, 0.0, 3, 1), (9, 0.0, 4, 1.0, 60, 0.0, 3, 1),
    (30, 0.0, 6, 1.0, 0, 0.0, 3, 1), (6, 0.0, 5, 1.0, 40, 0.0, 3, 1), (20, 0.0, 3, 1.0, 2, 1.0, 3, 1), (18, 0.0, 4, 1.0, 5, 1.0, 3, 1),
    (14, 0.0, 4, 1.0, 40, 0.0, 3, 1), (8, 0.0, 5, 1.0, 12, 0.0, 3, 1), (8, 0.0, 4, 1.0, 3, 1.0, 3, 1), (13, 0.0, 5, 1.0, 0, 0.0, 3, 1),
    (13, 0.0, 4, 1.0, 2, 1.0, 3, 0), (14, 0.0, 2, 1.0, 2, 1.0, 3, 0), (3, 1.0, 5, 1.0, 4, 1.0, 3, 0),
    (3, 1.0, 4, 1.0, 60, 0.0, 3, 1), (30, 0.2, 3, 1.0, 4, 1.0, 3, 1), (12, 0.0, 5, 1.0, 9, 0.0, 3, 1),
    (4, 1.0, 20, 0.0, 9, 0.0, 3, 1), (12, 0.3, 9, 0.0, 11, 0.2, 3, 1), (3, 1.0, 6, 0.0, 10, 0.0, 3, 1),
    (60, 0.0, 2, 1.0, 3, 1.0, 3, 1), (35, 0.0, 1, 1.0, 1, 1.0, 3, 1), (14, 0.0, 2, 1.0, 40, 0.0, 3, 1), (10, 0.0, 50, 0.0, 2, 1.0, 3, 1),
    # The last and the first blocks of an article, and blocks that stand alone between linked ones.
    (1, 0.0, 5, 0.0, 0, 0.0, 3, 1), (3, 0.0, 2, 1.0, 0, 0.0, 3, 1), (1, 0.5, 1, 1.0, 1, 1.0, 3, 1), (9, 0.8, 0, 0.0, 7, 0.0, 3, 1),
)
#: Blocks of unmarked pages without long blocks (news in brief, dialogues) and of lists of short lines; all features.
SHORT_LINES = (
    (1, 0.0, 0, 0.0, 3, 0.0, 2, 5, 1), (3, 0.0, 1, 0.0, 5, 0.0, 2, 5, 1), (5, 0.0, 3, 0.0, 0, 0.0, 2, 5, 1),
    (6, 0.0, 5, 0.0, 8, 0.0, 2, 9, 1), (9, 0.0, 6, 0.0, 4, 0.0, 2, 9, 1), (4, 0.0, 9, 0.0, 7, 0.0, 2, 9, 1),
    (3, 0.0, 2, 0.0, 3, 0.0, 2, 6, 1), (12, 0.0, 3, 0.0, 3, 0.0, 2, 14, 1), (14, 0.0, 4, 0.0, 2, 0.0, 2, 14, 1),
    (12, 0.0, 9, 0.0, 0, 0.0, 2, 12, 1), (2, 0.0, 9, 0.0, 12, 0.0, 2, 13, 1), (10, 0.0, 3, 0.0, 0, 0.0, 2, 10, 1),
    (9, 0.0, 2, 0.0, 4, 0.0, 2, 9, 1), (3, 0.0, 14, 0.0, 11, 0.0, 2, 14, 1), (2, 0.0, 9, 0.0, 14, 0.0, 2, 14, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 2, 3, 0), (2, 1.0, 0, 0.0, 1, 1.0, 2, 4, 0), (6, 0.9, 2, 1.0, 5, 0.0, 2, 8, 0), (1, 1.0, 0, 0.0, 1, 1.0, 2, 0, 0),
    (1, 1.0, 1, 1.0, 0, 0.0, 2, 0, 0), (3, 0.0, 1, 1.0, 2, 1.0, 2, 4, 0), (9, 0.0, 1, 1.0, 0, 0.0, 2, 9, 0), (6, 0.0, 2, 1.0, 1, 1.0, 2, 8, 0),
    (1, 0.0, 1, 0.0, 1, 0.0, 2, 30, 1), (1, 0.0, 0, 0.0, 1, 0.0, 2, 30, 1), (1, 0.0, 1, 0.0, 30, 0.0, 2, 30, 1), (2, 0.0, 1, 0.0, 2, 0.0, 2, 40, 1),
    (1, 0.0, 2, 0.0, 1, 0.0, 2, 25, 1), (2, 0.0, 2, 0.0, 3, 0.0, 2, 60, 1), (2, 0.0, 2, 0.0, 2, 0.0, 2, 90, 1), (1, 0.0, 1, 0.0, 12, 0.0, 2, 12, 1), (1, 0.0, 1, 0.0, 14, 0.0, 2, 14, 1), (14, 0.0, 1, 0.0, 0, 0.0, 2, 14, 1),
    # What the lists of short lines must not be mistaken for: links above a heading, names above comments.
    (1, 1.0, 1, 1.0, 7, 0.0, 2, 80, 0), (1, 1.0, 1, 1.0, 2, 0.0, 2, 80, 0), (3, 1.0, 9, 0.0, 2, 0.0, 2, 80, 0), (2, 0.0, 3, 1.0, 10, 0.0, 2, 80, 0), (2, 0.0, 10, 0.0, 8, 0.0, 2, 80, 0),
)
EXAMPLES = tuple((*r[:-1], 80, r[-1]) for r in LONG_PAGES) + SHORT_LINES
#: Words of a long block.
LONG = 20


def grow(rows):
    """A decision tree: (feature, limit, tree up to it, tree above) or a label.

    The first splits ask whether the page is one of short lines, without a long block or a marked article: neighbours tell
    less there.
    """
    place, longest = FEATURES.index("place"), FEATURES.index("longest")
    short, other = split([r for r in rows if r[longest] < LONG]), split([r for r in rows if r[longest] >= LONG])
    return longest, LONG - 0.5, (place, UNMARKED - 0.5, other, (place, UNMARKED + 0.5, short, other)), other


def split(rows, depth: int = 9):
    """A tree over the features of a block by the least Gini impurity."""
    labels = [r[-1] for r in rows]
    ones = sum(labels)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones > len(rows))
    best = None
    for f in range(len(FEATURES) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            limit = (a + b) / 2
            parts = [[r[-1] for r in rows if (r[f] <= limit) is side] for side in (True, False)]
            impurity = sum(sum(p) * (len(p) - sum(p)) / len(p) for p in parts)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, limit)
    if best is None:
        return int(2 * ones > len(rows))
    _, f, limit = best
    return f, limit, split([r for r in rows if r[f] <= limit], depth - 1), split([r for r in rows if r[f] > limit], depth - 1)


def classify(tree, row) -> int:
    while isinstance(tree, tuple):
        f, limit, low, high = tree
        tree = low if row[f] <= limit else high
    return tree


def marking(names: str) -> tuple[set[str], bool]:
    """The words of BESIDE in class, id or role names, without those that only tell of a layout; and whether a name of
    one or two words says comments or adverts. A longer name (how-to-reply) and one that ends in a state (ad-free,
    comments-open) tell of the text instead.
    """
    found, sure = set(), False
    for name in names.split():
        said = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        for i, w in enumerate(said):
            if w in LAYOUT:
                break
            if w in BESIDE:
                found.add(w)
                sure = sure or (w in NEVER_TEXT and len(said) <= 2 and said[-1] not in STATES)
    return found, sure


def unwrapped(found: list[list], holders: set[int], doubtful: set[int]) -> tuple[list[list], bool]:
    """Settles the marks that names and forms give: blocks as ``blocks`` returns them, and whether the page marks its article.

    Where no article or main part lies clear of marks, a marked wrapper is no mark if it holds the page's article, or
    most of the page's words and those mostly outside links. An article that is itself named after comments or adverts
    (doubtful) has to hold most of the words.
    """
    has_main = any(main and not sure and not named for _, _, _, main, sure, named in found)
    void: set[int] = set()
    if not has_main:
        total, held = sum(b[1] for b in found if not b[4]), {}
        for _, words, linked, _, sure, named in found:
            for k in named if not sure else ():
                w, n = held.get(k, (0, 0))
                held[k] = (w + words, n + linked)
        void = {k for k, (w, n) in held.items() if (k in holders and k not in doubtful) or (2 * w > total and 2 * n < w)}
    out = [[text, words, linked, main, sure or not void.issuperset(named)] for text, words, linked, main, sure, named in found]
    return out, any(main and not beside for *_, main, beside in out)


def blocks(page: str) -> tuple[list[list], bool]:
    """Blocks in page order as [text, words, linked words, in_main, beside], and whether the page marks its article."""
    out: list[list] = []
    holders: set[int] = set()  # marked wrappers that hold an article or main part
    doubtful: set[int] = set()  # articles named after comments or adverts
    text: list[str] = []
    linked = 0
    # Open parts: tag, in_main, surely beside, wrappers whose names mark them as beside.
    parts: list[tuple[str, bool, bool, tuple[int, ...]]] = []
    in_link = False
    at, n = 0, len(page)
    low = page.lower() if len(page.lower()) == n else page

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if in_link:
                linked += len(html.unescape(piece).split())

    def end() -> None:
        nonlocal linked
        joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            out.append([joined, len(joined.split()), linked, *(parts[-1][1:] if parts else (False, False, ()))])
        text.clear()
        linked = 0

    last_quotes = {q: page.rfind(q) for q in "\"'"}
    comments_end = True  # False once the rest of the page is known to hold no further end
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4) if comments_end else -1
            comments_end = close >= 0
            at = close + 3 if close >= 0 else n
            continue
        name = NAME.match(page, lt + 1)
        if not name:
            if page[lt + 1 : lt + 2] in ("!", "?"):
                close = page.find(">", lt)
                at = close + 1 if close >= 0 else n
            else:
                add("&lt;")
                at = lt + 1
            continue
        close = tag_end(page, name.end(), last_quotes)
        if close < 0:
            at = n
            continue
        tag, closing = name[1].lower(), page[lt + 1] == "/"
        inside = page[name.end() : close]
        at = close + 1
        if tag in OPAQUE and not closing:
            if tag == "title" or tag in BLOCK:
                end()
            if not inside.endswith("/"):
                stop = low.find(f"</{tag}", at)
                close = page.find(">", stop) if stop >= 0 else -1
                at = close + 1 if close >= 0 else n
            continue
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            add(" ")
        if tag not in BLOCK:
            continue
        end()
        if tag not in PART:
            continue
        if closing:
            for k in range(len(parts) - 1, -1, -1):
                if parts[k][0] == tag:
                    del parts[k:]
                    break
        else:
            _, main, sure, named = parts[-1] if parts else ("", False, False, ())
            marks = {k.lower(): (a or b or c or "").lower() for k, a, b, c in ATTRIBUTE.findall(inside)}
            said, never = marking(" ".join(marks.get(k, "") for k in ("class", "id", "role")))
            hidden = "hidden" in marks or "display:none" in marks.get("style", "").replace(" ", "")
            opens = tag in ("article", "main") or marks.get("role") in ("main", "article")
            sure = sure or tag in ASIDE or hidden or (never and not opens)
            if said or tag == "form":
                named = (*named, lt)
            if never:
                doubtful.add(lt)
            if opens and not sure:
                holders.update(named)
            parts.append((tag, main or opens, sure, named))
    end()
    return unwrapped(out, holders, doubtful)


def tag_end(page: str, at: int, last_quotes: dict[str, int]) -> int:
    """The place of the > that ends a tag. One inside a quoted value does not, however long the value is.

    A quote opens a value only after an equals sign, and only if it is closed somewhere; the scan never goes back.
    """
    while m := TAG_REST.search(page, at):
        at = m.end()
        if m[1] is None:
            return m.start()
        if at <= last_quotes[m[1]]:
            at = page.find(m[1], at) + 1
    return -1


def main_text(page: str | None, tree) -> str:
    if not page:
        return ""
    found, has_main = blocks(page)
    shape = [(w, k / w if w else 0.0) for _, w, k, _, _ in found]
    longest = max((w for (w, share), b in zip(shape, found) if share < 0.5 and not b[4]), default=0)
    kept = []
    for i, (text, w, _, main, beside) in enumerate(found):
        before = shape[i - 1] if i else (0, 0.0)
        after = shape[i + 1] if i + 1 < len(shape) else (0, 0.0)
        place = BESIDE_TEXT if beside else INSIDE if main else OUTSIDE if has_main else UNMARKED
        if classify(tree, (w, shape[i][1], *before, *after, place, longest)):
            kept.append(text)
    return "\n".join(kept)


def extract(page: Column) -> Column:
    """The main text of a column of html: character references decoded, one line for a block, empty if there is none."""
    tree = grow(EXAMPLES)

    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), tree).encode("utf-8", "replace").decode() for p in pages], pa.string())

    return texts(page)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; a null page is an empty one. Repeated rows give repeated rows."""
    rows = pages.select("page_id", "url", extract(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
