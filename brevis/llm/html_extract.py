"""HTML extraction: two-pass block rules for the main text of a page.

Markup is cut into blocks at block-level tags.  Containers of boilerplate (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments) are told by
tag, role and whole parts of class names and ids; if the page marks its article,
all outside of it is boilerplate too.  The other blocks are judged by their text.

Pass one looks at each block alone.  A block that is mostly links is bad.  Blocks
under ``SHORT`` characters stay open, headings near good.  Of the others, those
rich in stop words are good, those with some are good if long and near good if
not, and those with few stay open; where no known language's stop words are
frequent in the page, long blocks are good and others near good, but those without
a letter stay open.  Blocks in containers whose name only hints at boilerplate
(share, related, ...) must be long and rich in stop words.

Pass two gives each open and near good block the label of the nearest decided block
before or after it; where the two differ, the nearer one's, on a tie text for near
good blocks.  A heading goes with what follows it.  Inside a marked article the
blocks judged by their text are asked, not the containers, and a tie, or nobody to
ask, means text; elsewhere all are asked, and nobody to ask means boilerplate.

Inside a block character references are decoded and white space (Unicode's)
becomes one space; kept blocks are joined by a blank line in page order.

Defined results: a null or empty html, or one without main text, gives an empty
text of 0 characters; unclosed tags, comments and attributes end with their
parent or the page; repeated rows stay repeated; an empty table gives an empty
result; other input columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent words of each language.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its just like more most no not of on one only or other our out over said she so some such than that the their them then there these they this to up us was we were what when which who will with would you your",
    "fr": "a au aux avec ce ces cette comme dans de des du elle elles en entre est et eux il ils je la le les leur leurs lui ma mais me même mes moi mon ne nos notre nous on ont ou où par pas pour plus qu que qui sa sans se ses si son sont sur ta te tes toi ton tu un une vos votre vous y à été être",
    "de": "aber als am an auch auf aus bei bin bis da das dass daß dem den der des die durch ein eine einem einen einer eines er es für hat haben hatte ich ihm ihn ihr im in ist ja kann man mit nach nicht noch nur ob oder ohne sein sich sie sind so über um und uns unter vom von vor war was wenn wie wir wird zu zum zur",
    "es": "a al algo ante como con contra cual cuando de del desde donde e el ella ellas ellos en entre era es esa ese eso esta estas este esto fue ha hasta hay la las le les lo los me mi muy más ni no nos o os otra otro para pero por porque que quien se ser si sin sobre son su sus también te tiene todo tu un una uno y ya yo",
}
STOPS = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}

SHORT, LONG = 70, 200  # characters
STOP_LOW, STOP_HIGH = 0.2, 0.3  # share of stop words, in a block and in the page
LINKED = 0.33  # share of characters in links; in the article, of LINKED_INSIDE
LINKED_INSIDE = 0.75

BLOCK = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text never is page text: those of raw text end with the page if
#: unclosed; of the others, a self-closed or unclosed one has nothing in it.
RAW = "script|style|textarea|title"
HIDDEN = "noscript|template|svg|annotation|annotation-xml|iframe|object|select|button|canvas|audio|video"
BOILER_TAGS = frozenset("nav aside footer form menu dialog".split())
HIDDEN_NAMES = frozenset(HIDDEN.split("|"))
#: Parts of class names and ids, fixed values: of boilerplate; of what may be either;
#: and of names that speak of a layout or of the text itself.
BOILER_PARTS = re.compile(r"ads?|advert\w*|breadcrumbs?|comments?|cookies?|consent|disqus|disclaimer|footer|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|paywall|popup|promo\w*|sidebar|sponsor\w*|subscribe")
HINT_PARTS = frozenset("banner header related share sharing social toolbar widget".split())
OTHER_PARTS = frozenset("article body content entry has hide main no page post show story text with without wrapper".split())
BOILER_ROLE = re.compile(r"banner|navigation|complementary|contentinfo|search|dialog|alert|form", re.I)

SKIPPED = rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
HIDDEN_TAG = re.compile(rf"""{SKIPPED}|<(?P<end>/?)(?P<tag>{HIDDEN})(?=[\s/>])(?P<attrs>(?:(?>[^>"']++|"[^"]*"|'[^']*')*+|[^>]*+))>""", re.S | re.I)
TOKEN = re.compile(
    SKIPPED
    + r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Names and values one after the other, so no name is looked for inside a value.
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
LETTERS = re.compile(r"[^\W\d_]+")


YES, HINT, NO = 2, 1, 0


def _named(value: str) -> int:
    """What a class or id says: whole parts of names count, and a name that also speaks
    of a layout or of the text itself at most hints."""
    found = NO
    for name in value.lower().split():
        parts = [p.rstrip("0123456789") for p in re.split(r"[-_]+", name)]
        if any(map(BOILER_PARTS.fullmatch, parts)):
            found = max(found, YES if OTHER_PARTS.isdisjoint(parts) or parts[0] in ("page", "main", "post", "article") and parts[-1] not in OTHER_PARTS else NO)
        elif not HINT_PARTS.isdisjoint(parts) and OTHER_PARTS.isdisjoint(parts):
            found = max(found, HINT)
    return found


def _boilerplate(tag: str, attrs: str, in_article: bool) -> int:
    if tag in BOILER_TAGS or (tag == "header" and not in_article):
        return YES
    found = NO
    if attrs and tag not in ("html", "body", "article", "main"):
        for m in ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                if BOILER_ROLE.fullmatch(value):
                    return YES
            elif name in ("class", "id"):
                found = max(found, _named(value))
            elif name == "hidden" and value in ("", "hidden") or name == "aria-hidden" and value == "true":
                return YES
    return found


def hidden_spans(source: str) -> dict[int, int]:
    """Start and end of the closed HIDDEN elements; equal names may nest."""
    spans, open_at = {}, {}
    for m in HIDDEN_TAG.finditer(source):
        if tag := m["tag"]:
            begun = open_at.setdefault(tag.lower(), [])
            if not m["end"]:
                if not m["attrs"].endswith("/"):
                    begun.append(m.start())
            elif begun:
                spans[begun.pop()] = m.end()
    return spans


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters in links
    heading: bool
    boiler: bool  # in a container of boilerplate
    hint: bool  # in one that may be
    inside: bool  # in the article


class Page:
    """One page's blocks."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.marked = False
        self.parts: list[str] = []
        self.linked = 0
        self.stack: list[str] = []
        self.open: Counter[str] = Counter()
        self.boiler: list[int] = []  # stack depths at which boilerplate began
        self.hints: list[int] = []  # and what may be boilerplate
        self.article = self.heading = self.link = 0
        at, spans = 0, hidden_spans(source)
        while m := TOKEN.search(source, at):
            if m.start() > at:
                self.text(source[at : m.start()])
            at = spans.get(m.start(), m.end())
            if at == m.end() and (tag := m["tag"]):
                tag = tag.lower()
                if tag in HIDDEN_NAMES:
                    continue
                if m["end"]:
                    self.close(tag)
                else:
                    self.start(tag, m["attrs"])
        if at < len(source):
            self.text(source[at:])
        self.flush()

    def text(self, s: str) -> None:
        s = html.unescape(s) if "&" in s else s
        self.parts.append(s)
        if self.link:
            self.linked += len(s) - s.count(" ")

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.linked, self.heading > 0, bool(self.boiler), bool(self.hints), self.article > 0))
            self.parts.clear()
        self.linked = 0

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            return
        if tag in ("article", "main"):
            if not self.article and self.boiler and not any(self.stack[d] in BOILER_TAGS for d in self.boiler):
                self.boiler.clear()  # an unclosed notice or advert ends where the article begins
            if not self.boiler:
                self.article += 1
                self.marked = True
        if named := _boilerplate(tag, attrs, self.article > 0):
            self.flush()
            (self.boiler if named == YES else self.hints).append(len(self.stack))
        self.heading += tag in HEADING
        self.link += tag == "a"
        self.stack.append(tag)
        self.open[tag] += 1

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if not self.open[tag]:
            return
        while True:
            top = self.stack.pop()
            self.open[top] -= 1
            for begun in (self.boiler, self.hints):
                if begun and begun[-1] >= len(self.stack):
                    self.flush()
                    begun.pop()
            self.heading -= top in HEADING
            self.link -= top == "a"
            if top in ("article", "main") and self.article and not self.boiler:
                self.article -= 1
            if top == tag:
                return


def stop_counts(text: str) -> tuple[dict[str, int], int]:
    """The number of stop words of each language, and of all words."""
    found = LETTERS.findall(text.lower())
    return {k: sum(map(stops.__contains__, found)) for k, stops in STOPS.items()}, len(found)


GOOD, BAD, NEAR, OPEN = 1, -1, 2, 0


def first_pass(page: Page) -> list[int]:
    """The label of each block, from its own text and the page's language."""
    labels, counts = [], []
    for b in page.blocks:
        n, size = len(b.text), len(b.text) - b.text.count(" ")
        out = b.boiler or (page.marked and not b.inside)
        bad = out or b.linked > (LINKED_INSIDE if b.inside and not b.hint else LINKED) * size
        labels.append(BAD if bad else NEAR if b.heading else OPEN)
        counts.append(None if bad or n < SHORT else stop_counts(b.text))
    words = sum(c[1] for c in counts if c)
    known = words and max(sum(c[0][k] for c in counts if c) for k in STOPS) >= STOP_LOW * words
    for i, (b, c) in enumerate(zip(page.blocks, counts)):
        if labels[i] != OPEN or not c or not c[1]:
            continue
        n = len(b.text)
        density = max(c[0].values()) / max(1, c[1])
        if b.hint:
            labels[i] = GOOD if n >= LONG and density >= STOP_HIGH else BAD
        elif density >= STOP_HIGH or n >= LONG and (density >= STOP_LOW or not known):
            labels[i] = GOOD
        elif density >= STOP_LOW or not known:
            labels[i] = NEAR
    return labels


def second_pass(page: Page, labels: list[int]) -> list[bool]:
    """Whether each block is text."""
    n = len(labels)
    nobody = (0, n, n)
    before, after = [nobody] * n, [nobody] * n  # (label, distance, block)
    for order, into in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = {True: nobody, False: nobody}  # by side of the article's border
        for i in order:
            b = page.blocks[i]
            label, _, at = last[b.inside]
            into[i] = label, abs(i - at), at
            if labels[i] in (GOOD, BAD) and not (b.inside and b.boiler):
                last[b.inside] = labels[i], 0, i
    keep = []
    for b, label, x, y in zip(page.blocks, labels, before, after):
        if label in (NEAR, OPEN):
            near = [v for v in ((y,) if b.heading and y[0] else (x, y)) if v[0]]
            tie = GOOD if label == NEAR or b.inside else BAD
            if not near:
                label = GOOD if b.inside else BAD
            elif len(near) == 1 or near[0][0] == near[1][0]:
                label = near[0][0]
            elif near[0][1] != near[1][1]:
                label = min(near, key=lambda v: v[1])[0]
            else:
                label = tie
        keep.append(label == GOOD)
    return keep


def main_text(source: str | None) -> str:
    page = Page(source or "")
    return "\n\n".join(b.text for b, kept in zip(page.blocks, second_pass(page, first_pass(page))) if kept)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars for every row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = dict(df.dtypes)
    return df.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
