"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. Each has its word count and link density, those of the blocks before and
after it, and one mark: whether it stands in an article (1), in a part that pages use for other things (menus, headers, adverts,
forms, comments: -1), or in neither. A decision tree, grown in numpy from the small labelled table below, says which blocks are
main text. It asks for link density and words, and for the mark only where no question about these removes much doubt.
"""

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import read

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose content is text that no reader sees; it ends at their own end tag, and without one with the page.
RAW = {"script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes"}
#: The same, but without an end tag only the tag itself goes.
HIDDEN = {"noscript", "template", "svg", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "head"}
#: Words of classes, ids and roles that name such parts.
OTHER = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus dialog footer form header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related replies reply respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_PART = re.compile(r"[A-Za-z]+")
#: Which open element a start tag ends, and the elements that keep it from looking further out.
_CELLS = {"td", "th", "caption", "table"}
ENDS = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split(), ({"p"}, _CELLS | {"button"})),
    "li": ({"li"}, _CELLS | {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, _CELLS | {"dl"}),
    "dd": ({"dt", "dd"}, _CELLS | {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot"}, {"table"})),
}
#: End tags of other elements don't end a table around them.
_TABLES = {"table", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "body", "html"}

#: words, link density, words before, density before, words after, density after, in an article, in another part
MAIN = [
    (40, 0, 30, 0, 50, 0, 1, 0), (3, 0, 40, 0, 60, 0, 1, 0), (1, 0, 0, 0, 20, 0, 1, 0), (8, 0, 4, 0, 90, 0, 1, 0), (120, 0.1, 10, 0, 0, 0, 1, 0), (2, 1, 30, 0, 30, 0, 1, 0),
    (12, 0.5, 20, 0, 4, 1, 1, 0), (2, 0, 1, 1, 1, 1, 1, 0), (4, 0, 60, 0, 0, 0, 1, 0), (3, 0, 0, 0, 5, 1, 1, 0), (20, 0.8, 40, 0, 30, 0, 1, 0),
    (2, 0, 3, 0, 2, 0, 1, 0), (25, 0, 1, 1, 1, 1, 1, 0), (7, 0, 7, 0, 6, 0, 1, 0), (12, 0, 1, 1, 1, 1, 1, 0), (6, 0, 1, 1, 3, 1, 1, 0), (5, 0.2, 30, 0, 2, 1, 1, 0),
    (60, 0, 2, 1, 80, 0, 0, 0), (45, 0.05, 60, 0, 3, 1, 0, 0), (30, 0, 5, 1, 25, 0, 0, 0), (18, 0, 70, 0, 40, 0, 0, 0), (6, 0, 55, 0, 48, 0, 0, 0), (4, 0, 30, 0.1, 90, 0, 0, 0), (2, 0, 2, 1, 21, 0, 0, 0),
    (3, 0, 1, 1, 35, 0, 0, 0), (2, 0, 40, 0, 21, 0, 0, 0), (1, 0, 21, 0, 30, 0, 0, 0), (50, 0, 1, 1, 1, 1, 0, 0), (80, 0, 0, 0, 0, 0, 0, 0), (21, 0, 2, 0, 1, 1, 0, 0), (21, 0, 2, 0, 12, 0, 0, 0), (25, 0.2, 21, 0, 2, 1, 0, 0),
    (70, 0.3, 40, 0, 60, 0, 0, 0), (22, 0, 1, 0, 4, 0, 0, 0), (5, 0, 2, 1, 60, 0, 0, 0), (35, 0, 35, 0, 4, 0, 0, 0), (100, 0, 4, 1, 2, 1, 0, 0), (28, 0, 5, 1, 0, 0, 0, 0),
]
NOT_MAIN = [
    (1, 1, 0, 0, 1, 1, 0, 0), (1, 1, 1, 1, 1, 1, 0, 0), (2, 1, 1, 1, 1, 1, 0, 0), (2, 1, 2, 1, 3, 1, 0, 0), (1, 1, 1, 1, 7, 0, 0, 0), (1, 1, 2, 1, 40, 0, 0, 0), (3, 1, 2, 1, 60, 0, 0, 0), (12, 0.9, 30, 0, 10, 0.9, 0, 0),
    (4, 1, 50, 0, 4, 1, 0, 0), (4, 1, 4, 1, 0, 0, 0, 0), (20, 0.8, 40, 0, 30, 0, 0, 0), (2, 1, 60, 0, 0, 0, 0, 0), (7, 0.6, 8, 0.7, 3, 1, 0, 0), (5, 1, 5, 1, 5, 1, 0, 0), (1, 1, 1, 1, 3, 0, 0, 0), (2, 1, 80, 0, 2, 1, 0, 0),
    (3, 0.7, 2, 1, 3, 0, 0, 0), (6, 1, 1, 1, 6, 1, 0, 0), (15, 1, 0, 0, 0, 0, 0, 0), (9, 0.9, 9, 0.9, 9, 0.9, 0, 0), (30, 0.7, 10, 1, 2, 0, 0, 0), (8, 0.5, 3, 1, 3, 1, 0, 0), (2, 1, 3, 0, 2, 1, 0, 0), (1, 1, 0, 0, 60, 0, 0, 0),
    (2, 0, 1, 1, 1, 1, 0, 0), (4, 0, 60, 0, 0, 0, 0, 0), (3, 0, 0, 0, 5, 1, 0, 0), (8, 0, 40, 0, 0, 0, 0, 0), (7, 0, 1, 1, 3, 0, 0, 0), (6, 0, 55, 0, 2, 1, 0, 0), (12, 0, 1, 1, 1, 1, 0, 0), (3, 0, 2, 1, 0, 0, 0, 0), (5, 0.2, 30, 0, 2, 1, 0, 0), (9, 0, 0, 0, 2, 0, 0, 0),
    (40, 0, 30, 0, 50, 0, 1, 1), (40, 0, 30, 0, 50, 0, 0, 1), (5, 0, 1, 1, 12, 0, 0, 1), (30, 0, 2, 1, 40, 0, 0, 1), (90, 0, 10, 0, 20, 0, 0, 1), (3, 0, 12, 0, 40, 0, 1, 1), (2, 1, 8, 0, 0, 0, 1, 1), (25, 0, 20, 0, 30, 0, 1, 1),
    (60, 0.1, 5, 0, 70, 0, 1, 1), (2, 0, 30, 0, 50, 0, 0, 1), (1, 1, 3, 0, 40, 0, 1, 1), (6, 0, 5, 0, 2, 0, 1, 1), (50, 0, 1, 1, 1, 1, 0, 1), (4, 0, 4, 0, 4, 0, 0, 1),
]
#: The two last columns as one mark; then the label.
TABLE = [(*x[:6], -1 if x[7] else x[6], label) for rows, label in ((MAIN, 1), (NOT_MAIN, 0)) for x in rows]
#: The mark's column, and the share of the doubt that a question about the others has to remove, if the mark isn't to be asked for.
MARK, WORTH = 6, 0.15


def _doubt(y: np.ndarray) -> float:
    return len(y) * y.mean() * (1 - y.mean()) if len(y) else 0.0


def _question(x: np.ndarray, y: np.ndarray, columns):
    """(doubt left, column, threshold) of the question that leaves the least Gini impurity; of equal ones the first column, then the lowest threshold."""
    best = None
    for j in columns:
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            left = _doubt(y[x[:, j] <= cut]) + _doubt(y[x[:, j] > cut])
            if best is None or left < best[0] - 1e-12:
                best = left, j, cut
    return best


def grow(x: np.ndarray, y: np.ndarray):
    """A decision tree: (column, threshold, tree up to it, tree above) or the label."""
    if len(set(y.tolist())) == 1:
        return int(y[0])
    best = _question(x, y, range(MARK))
    if best is None or best[0] > (1 - WORTH) * _doubt(y):
        best = _question(x, y, [MARK]) or best
    if best is None:
        return int(y.mean() >= 0.5)
    _, j, cut = best
    low = x[:, j] <= cut
    return j, float(cut), grow(x[low], y[low]), grow(x[~low], y[~low])


def tree():
    rows = np.array(TABLE, float)
    return grow(rows[:, :-1], rows[:, -1])


def marks(attributes: str) -> set[str]:
    """The words of an element's class, id and role."""
    return {w.lower() for x in _NAMES.findall(attributes) for w in _PART.findall("".join(x))}


class _Page:
    """The open elements of a page that is read tag by tag, and the block that is being gathered."""

    def __init__(self):
        self.out, self.text, self.linked = [], [], []
        self.stack: list[tuple[str, bool, bool]] = []  # open elements that aren't inline, and whether each is an article or another part
        self.places: dict[str, list[int]] = {}  # where the open elements of each name stand in it
        self.article = self.other = 0
        self.link = None  # how many elements were open where the open link began
        self.unseen: list[str] = []  # open inline elements that a class marks as another part, and those of their names inside

    def flush(self):
        words = "".join(self.text).split()
        if words:
            self.out.append((" ".join(words), len(words), len("".join(self.linked).split()), self.article > 0, self.other > 0))
        self.text, self.linked = [], []

    def say(self, said: str):
        if not self.unseen:
            self.text.append(said)
            if self.link is not None:
                self.linked.append(said)

    def close(self, names: set[str], stops: set[str]):
        """Ends the innermost open element of these names and all in it, unless a stop stands further in."""
        innermost = lambda some: max((self.places[n][-1] for n in some if self.places.get(n)), default=-1)
        at = innermost(names)
        if at < 0 or innermost(stops - names) > at:
            return
        for name, a, o in self.stack[at:]:
            self.article, self.other = self.article - a, self.other - o
            self.places[name].pop()
        del self.stack[at:]
        self.unseen = []
        if self.link is not None and self.link > at:
            self.link = None

    def inline(self, name: str, ends: bool, attributes: str):
        if name == "br":
            self.say(" ")
        elif name == "a":
            self.link = None if ends else len(self.stack)
            self.linked.append(" ")
        if name in VOID:
            return
        if not ends and (name in self.unseen or marks(attributes) & OTHER):
            self.unseen.append(name)
        elif ends and name in self.unseen:
            del self.unseen[len(self.unseen) - 1 - self.unseen[::-1].index(name) :]

    def open(self, name: str, attributes: str):
        self.flush()
        self.close(*ENDS.get(name, (set(), set())))
        if name in VOID:
            return
        names = marks(attributes)
        a = name in ("article", "main") or "main" in names and not names & OTHER
        o = name in ASIDE or bool(names & OTHER) and name not in ("html", "body", "article", "main")
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, a, o))
        self.article, self.other = self.article + a, self.other + o


def blocks_of(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words in links, in an article, in another part) of each block with text, in page order.

    A start tag ends what it can't stand in (a paragraph, list item or cell before it), with all its marks. A link ends with
    its end tag, the next link or the element it began in. Inline elements with a class of another part have no text.
    """
    state, at, endless = _Page(), 0, set()
    while m := _TOKEN.match(page, at):
        at = m.end()
        if m[2] is None:
            if m[0][0] != "<" or m[0] == "<":
                state.say(html.unescape(m[0]))
            continue
        name, ends, attributes = m[2].lower(), bool(m[1]), m[3]
        if name in INLINE:
            state.inline(name, ends, attributes)
        elif name in RAW or name in HIDDEN:
            if not ends and not attributes.rstrip().endswith("/"):
                end = None if name in endless else re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                endless |= {name} if end is None else set()  # there is none further on either
                at = end.end() if end else len(page) if name in RAW else at
        elif ends:
            state.flush()
            state.close({name}, set() if name in _TABLES else _CELLS)
        else:
            state.open(name, attributes)
    state.flush()
    return state.out


def main_text(page: str, rules) -> str:
    """The blocks that the tree takes for main text, joined by newlines."""
    parts = blocks_of(page)
    dense = [(n, k / n) for _, n, k, _, _ in parts]
    out = []
    for i, (text, n, _, article, other) in enumerate(parts):
        x = (n, dense[i][1], *(dense[i - 1] if i else (0, 0)), *(dense[i + 1] if i + 1 < len(dense) else (0, 0)), -1 if other else int(article))
        node = rules
        while not isinstance(node, int):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        if node:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (html; other columns stay) with text and n_chars, its code points; columns of its own of these two names are replaced.

    Each row has its result, repeated rows the same; a page is one row, however long. An empty table gives an empty result.

    White space inside a block becomes one space, and blocks are joined by one newline. A null or empty page, or one
    without main text, has an empty text. Broken markup is read as far as it goes: what is not closed ends with the page.
    """
    rules = tree()

    @F.arrow_udf("string")
    def text(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py() or "", rules) for p in pages], pa.string())

    out = pages.withColumn("text", text("html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
