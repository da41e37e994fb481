"""The main text of web pages, by scores that run up the tree.

Every block of text passes points for its length and its commas to its ancestors: all of them to the nearest, half to
the next, less beyond. A container's points are discounted by the share of its text that stands in links. The container
with most points is kept, with those of its siblings that look like its text. Menus, sidebars, notices, adverts, forms,
headers, footers and comments are taken out beforehand, by element, role and class."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_CHARS = 1 << 22  # pages of so many characters, or one larger page, are worked on before rows go out

# --- fixed values: elements of HTML, and words that pages use in class, id and role ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
CLOSE_P = BLOCKS - {"body", "caption", "html", "legend", "tbody", "tfoot", "thead", "tr"}
#: What an element that opens closes first, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
          "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
NEVER = frozenset("script style noscript template head title nav footer aside form button select input textarea iframe object embed applet svg math canvas audio video map dialog menu search datalist fieldset legend option optgroup noembed noframes frameset".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar tablist".split())
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promos promoted promotion banner banners nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs crumbs pagination pager toolbar topbar sidebar sidebars side sidenav rail widget widgets header masthead footer foot colophon copyright legal cookie cookies consent gdpr notice notices notification notifications alert alerts announcement disclaimer popup modal overlay lightbox toast newsletter subscribe subscription signup signin login register search searchbox share sharing social related recommended recommendations recirc outbrain taboola hidden skip".split()
)
TALK = frozenset("disqus respond reply replies responses discussion feedback".split())
UNWANTED_STARTS = ("advert", "breadcrumb", "cookie", "newsletter", "sponsor")
UNWANTED_ENDS = ("nav", "menu", "sidebar", "footer", "header")
WANTED = frozenset("article articlebody body content entry hentry main maincontent page post story text blog prose".split())
MODIFIERS = frozenset("has with no without is not".split())
# --- end of fixed values ---

TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>=]++|=)*+)(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: What becomes of an unwanted element: it goes; it goes unless it holds a title of the first rank; or unless an article.
OUT, UNLESS_TITLE, UNLESS_ARTICLE = 3, 2, 1
LEAST_CHARS = 25  # a block of fewer passes no points
NEAR = 5  # ancestors that get points
WANTED_POINTS = 25  # of a container whose name says that it holds the text
COMMAS = ",\u3001\u060c\uff0c"
CONTAINERS = frozenset("#root html body div section article main td".split())
TEXTUAL = HEADINGS | frozenset("p blockquote pre figure table ul ol dl".split())
LINKED = frozenset("ul ol dl div section table".split())


def attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def labels(names: str) -> tuple[bool, bool, bool]:
    """Whether a class or id among names says unwanted, whether one says comments, and whether one says wanted."""
    bad = talk = good = False
    for name in names.split():
        tokens = [t.lower() for t in TOKEN.findall(name)]
        if tokens and tokens[0] not in MODIFIERS:
            talk |= any(t in TALK or t.startswith("comment") for t in tokens)
            bad |= any(t in UNWANTED or t.startswith(UNWANTED_STARTS) or t.endswith(UNWANTED_ENDS) for t in tokens)
            good |= any(t in WANTED for t in tokens)
    return bad or talk, talk, good


class Page:
    """The elements of a page in order (a parent before its children) and its pieces of text."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.unwanted, self.wanted, self.article = ["#root"], [-1], [0], [False], [False]
        self.pieces: list[tuple[int, str | None]] = []  # (element, text), None where a block starts or ends
        self._stack, self._open = [0], Counter(["#root"])
        self._read(html)

    def _push(self, name: str, rest: str) -> None:
        attrs = attributes(rest) if rest and rest != "/" else {}
        above = self._stack[-1]
        bad, talk, good = labels(f"{attrs.get('class', '')} {attrs.get('id', '')}") if attrs else (False, False, False)
        hide = name in NEVER or attrs.get("role", "").lower() in NEVER_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(HIDDEN.search(attrs.get("style", "")))
        core = name in ("article", "main", "body", "html") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
        if name in ("body", "html") or good and (name == "p" or name in INLINE):
            bad = False
        self.unwanted.append(OUT if hide else UNLESS_TITLE if bad and talk else UNLESS_ARTICLE if bad or name == "header" else 0)
        self.wanted.append(good and not bad or core)
        self.article.append(self.article[above] or name in ("article", "main"))
        self.tag.append(name)
        self.parent.append(above)
        self._stack.append(len(self.tag) - 1)
        self._open[name] += 1
        self._part(self._stack[-1])

    def _part(self, node: int) -> None:
        """A block parts the text where it starts and where it ends, a cell of a table by a space."""
        if self.tag[node] in BLOCKS:
            self.pieces.append((node, None))
        elif self.tag[node] in ("td", "th"):
            self.pieces.append((node, " "))

    def _pop(self) -> None:
        node = self._stack.pop()
        self._open[self.tag[node]] -= 1
        self._part(node)

    def _close(self, names: set[str], until: set[str]) -> None:
        """Ends the innermost open element of names, unless one of until is further in."""
        if any(self._open[n] for n in names):
            for k in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[k]]
                if tag in names:
                    while len(self._stack) > k:
                        self._pop()
                    return
                if tag in until:
                    return

    def _start(self, name: str, rest: str) -> None:
        if name in CLOSES:
            self._close(*CLOSES[name])
        if name in CLOSE_P and self._open["p"]:
            self._close({"p"}, {"td", "th", "button", "object", "table"})
        if name in HEADINGS and self.tag[self._stack[-1]] in HEADINGS:
            self._pop()
        if name == "a" and self._open["a"]:
            self._close({"a"}, BLOCKS | {"td", "th"})
        if name in ("html", "body") and self._open[name]:
            return
        if self._open["head"] and name not in IN_HEAD:
            self._close({"head"}, set())
        self._push(name, rest)
        if name in VOID:
            self._pop()
            if name == "br":
                self.pieces.append((self._stack[-1], " "))

    def _end(self, name: str) -> None:
        if name in HEADINGS:
            self._close(set(HEADINGS), {"td", "th", "table"})
        elif self._open[name]:
            self._close({name}, BLOCKS | {"td", "th"} if name in INLINE else {"td", "th", "table"} - {name} if name not in ("table", "body", "html", "tr", "tbody", "thead", "tfoot") else set())

    def _read(self, html: str) -> None:
        at = 0
        while True:
            m = TAG.search(html, at)
            if at < (stop := m.start() if m else len(html)):
                text = html[at:stop]
                if self.tag[self._stack[-1]] == "head" and text.strip():
                    self._pop()
                self.pieces.append((self._stack[-1], text))
            if not m:
                return
            at = m.end()
            if not (name := m["name"]) or html[at - 1] != ">":
                continue  # a comment, a declaration, or a tag that the page's end cuts off
            name = name.lower()
            if m["end"]:
                self._end(name)
                continue
            self._start(name, m["rest"])
            if name in RAW:
                over = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = over.start() if over else len(html)


def main_text(html: str | None) -> str:
    """The text of the page's main part: its blocks in order, one line each. White space within a block, line breaks
    and no-break spaces included, is one space."""
    if not html:
        return ""
    page = Page(html)
    tag, parent, n = page.tag, page.parent, len(page.tag)
    pieces = [(node, text and unescape(text)) for node, text in page.pieces]
    out = _taken_out(page)
    own, commas, chars, linked, links = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    block, in_link = [0] * n, [False] * n
    for i in range(1, n):
        block[i] = i if tag[i] in BLOCKS or tag[i] in ("td", "th") else block[parent[i]]
        in_link[i] = in_link[parent[i]] or tag[i] == "a"
        links[i] = int(tag[i] == "a" and not out[i])
    for node, text in pieces:
        if text and not out[node] and (size := len(text.strip())):
            own[block[node]] += size
            commas[block[node]] += sum(map(text.count, COMMAS))
            chars[node] += size
            linked[node] += size * in_link[node]
    for i in range(n - 1, 0, -1):
        for sums in (chars, linked, links):
            sums[parent[i]] += sums[i]
    density = [linked[i] / max(1, chars[i]) for i in range(n)]
    points = _points(page, own, commas)
    most, best = -1.0, 0
    for i in range(1, n):
        core = tag[i] in ("article", "main") and chars[i] > 0
        if out[i] or tag[i] in INLINE or not (points[i] or core):
            points[i] = 0.0
            continue
        if page.wanted[i] and tag[i] not in ("body", "html"):
            points[i] += WANTED_POINTS * (1 + (tag[i] == "article"))
        points[i] *= 1 - density[i]
        if points[i] > most:
            most, best = points[i], i
    at = best
    while at > 0 and not (tag[at] == "article" and not out[at]):
        at = parent[at]
    best = at or best  # all of an article, where the best container is a part of it
    kept = [False] * n
    for i in range(n):
        beside = 0 < best and i > 0 and i != best and parent[i] == parent[best] and tag[best] not in ("html", "body")
        if beside and tag[best] == "article":
            chosen = tag[i] == "article" and points[i] > most / 5
        else:
            chosen = i == best or beside and (points[i] > most / 5 or tag[i] in TEXTUAL and density[i] < 0.25)
        kept[i] = chosen or i > 0 and kept[parent[i]]
        # lists of links outside an article are menus
        if kept[i] and i != best and not page.article[i] and tag[i] in LINKED and links[i] > 1 and density[i] > 0.5:
            kept[i] = False
    return "\n".join(_lines((text for node, text in pieces if text is None or kept[node] and not out[node])))


def _taken_out(page: Page) -> list[bool]:
    """The elements that cannot be part of the text. Of an article's own header, the headings stay."""
    tag, parent, unwanted, n = page.tag, page.parent, page.unwanted, len(page.tag)
    article, title = [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        up = parent[i]
        article[up] |= article[i] or tag[i] in ("article", "main") and not unwanted[i]
        title[up] |= title[i] or tag[i] == "h1"
    out, headings = [False] * n, [False] * n
    for i in range(1, n):
        up = parent[i]
        own = unwanted[i] == OUT or unwanted[i] == UNLESS_TITLE and not title[i] or unwanted[i] == UNLESS_ARTICLE and not article[i]
        headings[i] = not own and headings[up] or tag[i] == "header" and page.article[up] and not out[up]
        out[i] = own or out[up] and not (headings[up] and tag[i] in HEADINGS)
    return out


def _points(page: Page, own: list[int], commas: list[int]) -> list[float]:
    """What the blocks pass to their ancestors; text that stands in a container itself counts for it."""
    points = [0.0] * len(own)
    for i, size in enumerate(own):
        if size >= LEAST_CHARS:
            at = i if page.tag[i] in CONTAINERS else page.parent[i]
            for level in range(NEAR):
                if at < 0:
                    break
                points[at] += (1 + commas[i] + min(size // 100, 3)) / (1, 2, 6, 9, 12)[level]
                at = page.parent[at]
    return points


def _lines(pieces: Iterator[str | None]) -> Iterator[str]:
    held: list[str] = []
    for text in pieces:
        if text is not None:
            held.append(text)
        elif held:
            if line := " ".join("".join(held).split()):
                yield line
            held = []
    if line := " ".join("".join(held).split()):
        yield line


def main_texts(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """df with the main text of html_col as text_col, empty if there is none, and its code points as n_chars.

    Null and empty pages have no text; a page without markup is text itself. Pages of any size are read whole, and a
    page that breaks off gives what stands before the break. Rows pass through one for one, repeated ones and null ids
    too; an empty table gives an empty result. Columns of df with the names of the new ones are replaced."""
    keep = [c for c in df.columns if c not in (text_col, "n_chars")]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{html_col}`").alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, texts, size = 0, [], 0
            for i, page in enumerate(batch["html"]):
                page = page.as_py()
                texts.append(main_text(page))
                size += len(page or "")
                if size >= BATCH_CHARS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch["row"].slice(start, i + 1 - start), pa.array(texts, pa.string())], names=["row", "text"])
                    start, texts, size = i + 1, [], 0

    kind = packed.schema["row"].dataType.simpleString()
    done = packed.mapInArrow(work, f"row {kind}, text string")
    return done.select("row.*", F.col("text").alias(text_col), F.char_length("text").cast("long").alias("n_chars"))
