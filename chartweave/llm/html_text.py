"""Main text of web pages: flat blocks with shallow features, classified by a decision tree.

A page is cut into text blocks at block-level tags. A block has its number of words, its
link density and the kind of element around it, and the same of the block before and after.
A small tree trained on the labelled pages below tells article text from the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chartweave.llm.common import slices, spread_rows

# Elements by their part in HTML.
#: Elements whose content is no text of the page: raw ones go on to their closing tag whatever stands there, or to the page's end.
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("template noscript svg math canvas iframe object audio video select option datalist button".split())
BREAKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that stay open until they are closed; the others (p, li, td) end where the next block starts.
HOLDS = frozenset("article aside blockquote center details dialog div dl fieldset figure footer form header main menu nav ol search section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ARTICLE = frozenset("article main".split())
FRAME = frozenset("nav header footer aside form menu dialog search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class, id or label that mark what is not article text.
HINTS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adv|banner|sponsor\w*|promo\w*|comments?|comment\w*|reply|replies|respond|disqus|sidebar|side|widget\w*|menu\w*|nav\w*|breadcrumbs?|footer|header|masthead|cookie\w*|consent|notice|notices|alert|gdpr|popup|modal|newsletter|subscribe\w*|signup|share|sharing|social|related|recommend\w*|pagination|pager|tags|toolbar|login|search|copyright|legal|disclaimer|skip)(?:$|[\s_-])", re.I)
BODY = re.compile(r"(?:^|[\s_-])(?:article\w*|post|post-?body|entry|content|main|story|text|body)(?:$|[\s_-])", re.I)
NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
STOP = re.compile(r"[\"'<>]")
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
FEATURES = ("frame", "hint", "article", "links", "words", "heading", "prev_words", "prev_links", "next_words", "next_links", "has_article")

#: The labelled table by hand: pages whose elements marked ``data-y`` are article text.
BY_HAND = (
    "<body><header><h1>Daily Paper</h1><p>News from the town since long ago</p></header><nav><ul><li><a href=/>Home</a></li><li><a href=/a>Sport</a></li></ul></nav><article><h1 data-y>Rain fills the lake</h1><p data-y>After three dry months the lake is full again, and the boats are back on the water.</p><p data-y>Good.</p><p data-y>The town will open the beach next week if the weather stays as warm as it is.</p></article><aside><p>Most read stories of this week in our paper</p></aside><footer><p>Copyright Daily Paper, all rights reserved</p></footer></body>",
    "<body><div class=menu><a href=/>Start</a> <a href=/b>About us</a></div><div id=content><h2 data-y>Baking bread</h2><p data-y>Mix flour, water and salt, and leave the dough to rest until it has grown to twice its size.</p><p data-y>Bake it for forty minutes in a hot oven.</p><ul><li data-y>500 g of flour</li><li data-y>Salt</li></ul></div><div class=comments><p>I have tried this twice and it was very good, thank you for it.</p><p>Mine was flat.</p></div><div class=footer>Contact and imprint of this site</div></body>",
    "<body><nav><ul><li><a href=/1>one</a></li><li><a href=/2>two</a></li></ul></nav><div class=ad>Buy two and get one more for free today only.</div><article><h1 data-y>Short note</h1><p data-y>Yes.</p><p data-y>We have moved to a new house near the old mill by the river.</p></article><footer>&copy; example &middot; All rights reserved by us.</footer></body>",
    "<body><form><label>Your name</label><p>Please fill in all of the fields below before you send this to us</p></form><main><h1 data-y>Opening hours</h1><p data-y>The library is open from nine to five on weekdays. On holidays it stays closed for the whole day.</p></main><div class='cookie-notice'>We use cookies to make this site better for you, accept all of them or read more.</div></body>",
    "<body><div class='header-top'>Welcome to the site of the club</div><div class=post><p data-y>The match ended with three goals for us and one for the guests, who played well until the last minutes.</p><p data-y>Read the <a href=/r>full report</a> of the match for the names of all players who scored.</p><p data-y>Next game on Sunday.</p></div><div class='sidebar'><h3>Latest</h3><p>Table of the league after this week</p><p><a href=/x>Older news</a></p></div></body>",
    "<body><p><a href=/a>First</a> | <a href=/b>Second</a> | <a href=/c>Third</a></p><h1 data-y>A walk in the hills</h1><p data-y>We left early in the morning and walked along the small path up to the first of the three huts on the way.</p><p data-y>It was cold.</p><p data-y>From the top you could see the whole valley and the villages in it, far away in the sun.</p><p><a href=/t>Back to the top</a></p><p><a href=/i>Imprint</a> <a href=/p>Privacy</a></p></body>",
    "<body><header><nav><a href=/>Home</a></nav><p>Breaking: nothing has happened so far today</p></header><article><header><h1 data-y>On bees</h1></header><section><h2 data-y>Summer</h2><p data-y>Bees fly out when it is warm enough, and they return before the evening falls.</p></section><section><h2 data-y>Winter</h2><p data-y>They sit close together.</p></section><section class=comments><h2>Comments</h2><p>What a good text about the bees, I have learnt a lot from it.</p><p>Thanks!</p></section><div class=share><a href=/s>Share this</a></div></article></body>",
    "<body><div role=navigation>Shop Cart Account Help</div><article><p data-y>One word only texts are rare but they are to be found in many older pages of the web.</p><aside class=ad>Only today at half the price in all of our shops near you.</aside><p data-y>And so it goes on after the advert, as if there had been nothing at all between the two parts.</p><blockquote data-y>What is said is said.</blockquote></article><div role=contentinfo>Made with care in the north</div></body>",
    "<body><article><h1 data-y>List of things</h1><ol><li data-y><a href=/1>First thing</a> with a few words on what it is and why it is here</li><li data-y>Second thing</li></ol><p data-y>Nothing more.</p></article><div class=related><h3>More like this</h3><p>Another list of things that you may like to read as well</p></div><form><p>Write to us if you know of more things to add here</p></form></body>",
    "<body><table><tr><td><a href=/>Home</a></td><td><a href=/n>News</a></td></tr></table><div><p data-y>Tables were used for the layout of pages for many years, and some of those pages are still around today.</p><p data-y>They work in every browser that there is, old or new, on any screen.</p></div><div class=newsletter><p>Get our letter each week, free of any charge</p></div></body>",
    "<body><header class=masthead><p>The voice of the coast since the year of the great flood</p></header><article><p data-y>Herring.</p><p data-y>Cod.</p><p data-y>Both are sold at the harbour from six in the morning on every day but Sunday.</p><p data-y>Ask for Ann.</p></article><aside><h2>Tides</h2><p>High water at four in the afternoon today</p></aside><footer><p>Ann</p></footer></body>",
    "<body><article><h1 data-y>Code</h1><pre data-y>print one line</pre><p data-y>This prints a line of text, and then it stops.</p><table><tr><td data-y>one</td><td data-y>two</td></tr></table><nav><a href=/p>Previous</a> <a href=/n>Next</a></nav></article><div id=disqus>Two readers said that this was of great help to them.</div></body>",
)


def by_rule() -> list[str]:
    """Labelled pages of all usual parts with short and long texts in each, so that length alone decides nothing."""
    say = lambda n: " ".join(["word"] * n)
    lengths = (1, 4, 9, 16, 30, 70)
    around = ("<nav>{}</nav>", "<header><p>{}</p></header>", "<footer>{}</footer>", "<aside><p>{}</p></aside>", "<form><p>{}</p></form>", '<div class="ad">{}</div>', '<div class="comments"><p>{}</p></div>', '<div id="sidebar"><p>{}</p></div>', '<div class="cookie-notice"><p>{}</p></div>', '<div role="banner">{}</div>', '<p class="newsletter">{}</p>')
    inside = ("<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>', "<main><article>{}</article></main>", "<article><section>{}</section></article>")
    out = []
    for i, part in enumerate(around):
        for j, n in enumerate(lengths):
            m, k = lengths[(i + j) % 6], lengths[(i + 2 * j + 1) % 6]
            text = f"<h1 data-y>{say(k % 9 + 1)}</h1><p data-y>{say(m)}<p data-y>{say(k)} <a href=x>{say(k // 2)}</a></p><ul><li data-y>{say(n)}</li></ul>"
            noise = part.format(say(n))
            body = inside[(i + j) % len(inside)].format(text + (noise if j % 3 == 2 else ""))
            out.append(f"<body>{noise if j % 2 else ''}{body}{noise}</body>")
    for i, part in enumerate(around):  # pages without any container: text stays, lists of links and marked parts go
        n = lengths[2 + i % 4]
        out.append(f"<body>{part.format(say(n))}<p><a href=a>{say(2)}</a> <a href=b>{say(3)}</a></p><h1 data-y>{say(5)}</h1><p data-y>{say(n)}</p><p data-y>{say(4)}</p><p data-y>{say(n)}</p><p><a href=c>{say(n // 4)}</a></p>{part.format(say(lengths[i % 6]))}</body>")
    return out


class Tags:
    """The tags of a page, one after the other, each part of the page looked at a few times at most.

    A tag ends at the first ``>`` outside quotes, or, where quotes or another ``<`` leave none,
    at the first one there is. A ``<`` that no ``>`` follows is text.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.none: set[str] = set()  # what doesn't occur behind the place reached
        self.ends: dict[str, dict[int, int]] = {}

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def next(self, at: int) -> tuple | None:
        """``(start, end, closing, name, attributes)`` of the next tag; comments and declarations have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            m = NAME.match(page, start)
            if m:
                end = self.end(m.end())
            elif page.startswith("<!--", start):
                end = self.find("-->", start + 4) + 3
                end = len(page) if end < 3 else end
            elif page.startswith(("<!", "<?"), start):
                end = self.find(">", start) + 1
            else:
                at = start + 1
                continue
            if end > 0:
                return (start, end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]) if m else (start, end, False, "", "")
            at = start + 1
        return None

    def end(self, at: int) -> int:
        """Just behind the ``>`` of a tag whose name ends at ``at``; 0 if there is none."""
        place = at
        while m := STOP.search(self.page, place):
            if m[0] == ">":
                return m.end()
            close = self.find(m[0], m.end()) if m[0] != "<" else -1
            if close < 0:
                break
            place = close + 1
        return self.find(">", at) + 1

    def past_raw(self, name: str, at: int) -> int:
        """End of a raw element's content and closing tag."""
        m = None if name in self.none else re.compile(rf"</{name}\s*>", re.I).search(self.page, at)
        if m is None:
            self.none.add(name)
        return m.end() if m else len(self.page)

    def past(self, name: str, start: int) -> int | None:
        """End of the element that opens at ``start``, or None if it is never closed."""
        if name not in self.ends:
            opened, ends = [], {}
            for m in re.compile(rf"<(/?){name}(?=[\s/>])([^<>]*)>", re.I).finditer(self.page):
                if m[1]:
                    if opened:
                        ends[opened.pop()] = m.end()
                elif not m[2].rstrip().endswith("/"):
                    opened.append(m.start())
            self.ends[name] = ends
        return self.ends[name].get(start)


def blocks(page: str | None, marked: bool = False) -> list[dict]:
    """Text blocks of a page in order, with their features; ``marked`` adds the label ``y``.

    Markup that is never closed or opened does no harm: a closing tag ends the nearest open
    element of its name, what is left open ends with the page, and an element that hides its
    content hides nothing if it is never closed. Only scripts, styles and fields of raw text
    go on to the page's end. Time grows with the length of the page, however deep it nests.
    """
    from collections import Counter

    out: list[dict] = []
    text: list[str] = []
    words = linked = 0
    held: list[tuple] = []  # name, and whether it or one around it is frame, article, hint, y
    names: Counter = Counter()
    link = False
    own = ("", False)
    page = page or ""
    tags = Tags(page)
    around = lambda: held[-1] if held else ("", False, False, False, False)

    def close():
        nonlocal text, words, linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            _, frame, article, hint, y = around()
            out.append({"text": joined, "words": len(joined.split()), "links": linked / max(words, 1), "frame": frame, "article": article, "hint": hint or own[1] is None, "heading": own[0] in ("h1", "h2", "h3", "h4", "h5", "h6"), "y": y or own[1] is True})
        text, words, linked = [], 0, 0

    def add(part: str):
        nonlocal words, linked
        if part:
            text.append(part)
            n = len(part.split())
            words += n
            linked += n if link else 0

    at = 0
    while True:
        tag = tags.next(at)
        add(page[at : tag[0] if tag else len(page)])
        if tag is None:
            break
        start, at, closing, name, inside_tag = tag
        if name in RAW or name in HIDDEN:
            if not closing and not inside_tag.rstrip().endswith("/"):
                at = tags.past_raw(name, at) if name in RAW else tags.past(name, start) or at
                text.append(" ")
            continue
        if name == "a":
            link = not closing
        elif name == "br":
            text.append(" ")
        elif name in BREAKS:
            close()
            if closing:
                own = ("", False)
                if names[name]:
                    while True:
                        last = held.pop()[0]
                        names[last] -= 1
                        if last == name:
                            break
                    link = False
                continue
            attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(inside_tag)}
            label = " ".join(attributes.get(k, "") for k in ("class", "id"))
            _, frame, inside, hinted, marked_above = around()
            hint = bool(HINTS.search(label)) or attributes.get("role", "") in ROLES
            y = marked and "data-y" in attributes
            if name in HOLDS:
                # The header of an article holds its title.
                is_article = name in ARTICLE or bool(BODY.search(label)) and not hint
                held.append((name, frame or name in FRAME and not (name == "header" and inside), inside or is_article, hinted or hint, marked_above or y))
                names[name] += 1
                own = ("", False)
            else:
                own = (name, None if hint else y)
    close()
    return out


def features(found: list[dict]) -> list[list[float]]:
    """A row of ``FEATURES`` for each block; beyond the page's ends a neighbour has no words."""
    whole = float(any(b["article"] for b in found))
    none = {"words": 0, "links": 0.0}
    rows = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        rows.append([float(b["frame"]), float(b["hint"]), float(b["article"]), b["links"], float(b["words"]), float(b["heading"]), float(before["words"]), before["links"], float(after["words"]), after["links"], whole])
    return rows


def train(rows, y, depth: int = 6, least: int = 2):
    """A decision tree by Gini impurity: ``(feature, limit, low, high)``, or the share of article text in a leaf.

    The first feature with the best gain wins a tie, so the tree is the same on every run.
    """
    import numpy as np

    x, y = np.asarray(rows, float), np.asarray(y, float)
    share = float(y.mean())
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v) if len(v) else 0.0
    best = None
    if depth and 0 < share < 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for limit in (values[:-1] + values[1:]) / 2:
                low = x[:, f] <= limit
                if min(low.sum(), (~low).sum()) >= least:
                    cost = gini(y[low]) + gini(y[~low])
                    if best is None or cost < best[0] - 1e-12:
                        best = (cost, f, float(limit))
    if best is None or best[0] >= gini(y) - 1e-12:
        return share
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], train(x[low], y[low], depth - 1, least), train(x[~low], y[~low], depth - 1, least))


def trained(pages=None):
    """The tree of labelled pages, those of this module if none are given."""
    rows, y = [], []
    for page in pages or (*BY_HAND, *by_rule()):
        found = blocks(page, marked=True)
        rows += features(found)
        y += [b["y"] for b in found]
    return train(rows, y)


def share_of(tree, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree) -> str:
    """Article blocks of a page in order, joined by two line ends."""
    found = blocks(page)
    return "\n\n".join(b["text"] for b, row in zip(found, features(found), strict=True) if share_of(tree, row) >= 0.5)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", labelled=None) -> DataFrame:
    """Columns ``keep`` with ``text`` and ``n_chars`` of every page.

    A null, empty or tagless-and-blank page has text ``""``; pages are read whole, rows that
    repeat give the same text. The tree travels with the task; it has a few nodes.
    """
    tree = trained(labelled)

    def run(batches: Iterator):
        import pyarrow as pa

        for b in slices(batches):
            texts = [main_text(t, tree) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    schema = StructType([pages.schema[c] for c in keep]).add("text", "string").add("n_chars", "long")
    return spread_rows(pages.select(*keep, F.col(html_col).alias("_html"))).mapInArrow(run, schema)
