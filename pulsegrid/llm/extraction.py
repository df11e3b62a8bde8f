"""HTML extraction by tag-path ratios.

A page is read as a sequence of text blocks, each in an element; a root-to-leaf path names the element by its tag and
class and those above it (inline elements don't count, so an unclosed <b> changes no path). Elements and paths are trees
of nodes that know their parent, so that time and memory are linear in the page, however deep it is. What can never be
text of a page is skipped: scripts, styles, form controls, embedded objects, hidden elements. All else is judged by its
path and its place:

1. Sums. For each path the text length outside links and the punctuation are summed over its blocks; divided by their
   number they are the path's two ratios.
2. Smoothing. Along the page each block's ratios are averaged with its neighbours', so that a heading between paragraphs
   takes part of their weight.
3. Fusion. Length times (1 + punctuation) is a block's weight; a path's weight is the sum over its blocks. Elements and
   class names that usually hold something else (menus, footers, adverts, comments) lower it to ``WEAK``; they don't
   decide by themselves.
4. The weights, summed up the tree of elements, give the content's container: the only <article> or <main> if there is
   one, else the deepest element that holds ``SHARE`` of the page's weight (or the outermost <article> or <main> around
   it). Support is smoothed along the tree: an element in the container takes it in full, others lose a part of it for
   each step from it.
5. Threshold. The score of a path's blocks in one element is the mean of that support and the path's share of the
   heaviest path's weight (beside an <article>, half the support alone), lowered by a majority of linked text in the
   element (or among the siblings of one list, table row or run of paragraphs) and by a weak name; elements at
   ``THRESHOLD`` or more are content. Their blocks are the text.

Pages are read one by one: no shuffle; a task holds one Arrow batch, dealt into slices.

Defined cases: a null page counts as empty and gives an empty text; a page without candidates too; broken markup is
read as far as it goes (an unclosed tag is text, an unknown end tag is nothing); very long and very deep pages are read
whole; equal rows each keep their row; an empty table gives an empty result; extra columns pass through unless they carry
the name of a column made here.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import table

#: Least score of a content path.
THRESHOLD = 0.3
#: Share of the page's weight that the content's container holds.
SHARE = 0.8
#: Factor of weight and score for elements that usually hold something else than the article.
WEAK = 0.05
#: What is left of the container's support after a step away from it: for headings, for elements of running text, for others.
STEP_HEADING, STEP_TEXT, STEP_OTHER = 0.75, 0.7, 0.4

# Element names of HTML.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("head title button select option textarea noscript template iframe object svg script style".split())
_WEAK = frozenset("nav header footer aside form menu dialog fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXT = frozenset("p li blockquote pre td th dd dt figcaption caption".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
_STOP = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
_CONTENT = frozenset(("article", "main"))
#: Words in class and id attributes that usually name something else than the article.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adbox|adsense|banner|sponsor(?:ed)?|promo(?:tion)?s?|sidebar|side|aside|widget|menu|nav|navbar|navigation|breadcrumbs?"
    r"|header|masthead|topbar|footer|foot|colophon|copyright|legal|comments?|commentlist|replies|respond|disqus|discussion|cookies?|consent|gdpr|notices?|alert|warning|popup|modal"
    r"|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|more-links|pagination|pager|skip|search|form|toolbar"
    r"|hidden|outbrain|taboola)(?:$|[\s_-])",
    re.IGNORECASE,
)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = {x: re.compile(rf"</{x}\s*+>", re.IGNORECASE) for x in ("script", "style", "noscript", "template", "textarea", "iframe", "svg")}
_OPEN = re.compile(rf"<!--|<!\[CDATA\[|<(?P<end>/?)(?P<tag>(?=[a-zA-Z])(?:(?P<raw>{'|'.join(_RAW)})\b)?[a-zA-Z0-9:-]*)|<[!?]", re.IGNORECASE)
_EDGE = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.IGNORECASE)
_READ = frozenset(("class", "id", "role", "hidden", "style"))
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_PUNCTUATION = re.compile(r"[.,;:!?。，、！？；]")


def _named(rest: str) -> tuple[str, bool, bool]:
    """(class, id and role as part of a path, whether they name something else than the article, whether it is hidden)."""
    parts, weak, hidden = [], False, False
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        value, name = a or b or c, name.lower()
        if name not in _READ:
            continue
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
        else:
            parts.append(value)
            weak |= value.lower() in _ROLES if name == "role" else bool(_NAMES.search(_CAMEL.sub("-", value)))
    return " ".join(parts), weak, hidden


def _tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag, whether it ends an element, attributes) of each piece of markup; tag is None where nothing opens or ends.

    Quoted values have any length. The time is linear in the page: edges (quotes and ends of tags) that lead to no end of
    a tag are remembered, so that no part is searched twice for tags that never end.
    """
    size, last, last_data = len(page), page.rfind(">"), page.rfind("]]>")
    dead: set[int] = set()
    run = (0, -1)  # from where to which edge nothing lies between

    def close(k: int) -> int:
        nonlocal run
        seen = []
        while True:
            if not run[0] <= k <= run[1]:
                edge = _EDGE.search(page, k)
                run = (k, edge.start() if edge else size)
            q = run[1]
            if q == size or q in dead:
                break
            if page[q] == ">":
                return q + 1
            seen.append(q)
            k = page.find(page[q], q + 1) + 1
            if not k:
                break
        dead.update(seen)
        return -1

    at = 0
    while m := _OPEN.search(page, at):
        start, k = m.span()
        if m["tag"] is None:
            if m[0] == "<!--":
                end = page.find("-->", k)
                end = size if end < 0 else end + 3
            elif len(m[0]) > 2 and k <= last_data:
                end = page.find("]]>", k) + 3
            else:
                end = page.find(">", start + 2) + 1 if start + 2 <= last else -1
            if end > 0:
                yield start, end, None, False, ""
        else:
            end = close(k)
            if end > 0 and m["raw"] and not m["end"]:
                over = _RAW[m["raw"].lower()].search(page, end)
                end = over.end() if over else size
                yield start, end, None, False, ""
            elif end > 0:
                yield start, end, m["tag"].lower(), bool(m["end"]), page[k : end - 1]
        at = end if end > 0 else start + 1


class Path:
    """The elements from the root to one kind of element: its tag and name, and the path above."""

    __slots__ = ("below", "name", "parent", "tag")

    def __init__(self, parent: Path | None = None, tag: str = "", name: str = ""):
        self.parent, self.tag, self.name = parent, tag, name
        self.below: dict[tuple[str, str], Path] = {}

    def step(self, tag: str, name: str) -> Path:
        found = self.below.get((tag, name))
        if found is None:
            found = self.below[tag, name] = Path(self, tag, name)
        return found


class Element:
    """An element of the page. weak: how many elements from the root to it have a weak name; number: its place in the page."""

    __slots__ = ("content", "depth", "number", "parent", "path", "skipped", "weak")

    def __init__(self, number: int, path: Path, parent: Element | None = None, skipped: bool = False, weak: int = 0, content: Element | None = None):
        self.number, self.path, self.parent, self.skipped, self.weak = number, path, parent, skipped, weak
        self.depth = parent.depth + 1 if parent else 0
        self.content = content  # the outermost article or main around it, or itself


class _Block:
    """Text in one element."""

    __slots__ = ("element", "linked", "parts")

    def __init__(self, element: Element):
        self.element = element
        self.parts: list[str] = []
        self.linked = 0

    @property
    def path(self) -> Path:
        return self.element.path

    @property
    def weak(self) -> int:
        return self.element.weak


def blocks(page: str) -> list[_Block]:
    """Text blocks in page order."""
    stack = [Element(0, Path())]
    is_open: dict[str, int] = defaultdict(int)
    out: list[_Block] = []
    block: _Block | None = None
    links, at, number = 0, 0, 0

    def text(piece: str) -> None:
        nonlocal block
        if not piece or stack[-1].skipped:
            return
        if block is None:
            if piece.isspace():
                return
            block = _Block(stack[-1])
            out.append(block)
        block.parts.append(piece)
        if links:
            block.linked += len(piece)

    def leave(k: int) -> None:
        for x in stack[k:]:
            is_open[x.path.tag] -= 1
        del stack[k:]

    for start, end, tag, ends, rest in _tokens(page):
        text(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if ends else 1
            elif tag == "br":
                text(" ")
            continue
        block, links = None, 0
        if ends:
            if is_open[tag]:
                k = len(stack) - 1
                while stack[k].path.tag != tag:
                    k -= 1
                leave(k)
            continue
        if tag in _VOID:
            continue
        if stack[-1].path.tag == "p":  # a block element ends an open paragraph
            leave(len(stack) - 1)
        closes = _CLOSES.get(tag, ())
        if any(is_open[x] for x in closes):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].path.tag in _STOP.get(tag, ("table",)):
                    break
                if stack[k].path.tag in closes:
                    leave(k)
                    break
        name, weak, hidden = _named(rest) if "=" in rest or "hidden" in rest else ("", False, False)
        above = stack[-1]
        # html and body say nothing of their kind; an article's own header is part of it
        weak = (weak and tag not in ("html", "body", "main")) or (tag in _WEAK and not (tag == "header" and above.content is not None))
        if not rest.endswith("/") or tag not in ("svg", "path"):
            number += 1
            inner = Element(number, above.path.step(tag, name), above, above.skipped or hidden or tag in _NEVER, above.weak + weak, above.content)
            if inner.content is None and tag in _CONTENT:
                inner.content = inner
            stack.append(inner)
            is_open[tag] += 1
    text(page[at:])
    return out


def fused(found: list[tuple[_Block, str]]) -> list[float]:
    """The weight of each block: its path's two ratios, smoothed along the page, and fused."""
    sums: dict[Path, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for b, said in found:
        own = sums[b.path]
        own[0] += max(0, len(said) - b.linked)
        own[1] += len(_PUNCTUATION.findall(said))
        own[2] += 1
    ratio = [(s[0] / s[2], s[1] / s[2]) for s in (sums[b.path] for b, _ in found)]
    out = []
    for k, (b, _) in enumerate(found):
        near = ratio[max(0, k - 1) : k + 2]
        length, marks = ((ratio[k][i] + sum(x[i] for x in near)) / (len(near) + 1) for i in (0, 1))
        out.append(length * (1 + marks) * WEAK**b.weak)
    return out


def _above(found: list[tuple[_Block, str]]) -> list[Element]:
    """The elements of blocks and all above them, in page order: each after its parent."""
    seen: dict[int, Element] = {}
    for b, _ in found:
        e: Element | None = b.element
        while e is not None and e.number not in seen:
            seen[e.number] = e
            e = e.parent
    return [seen[n] for n in sorted(seen)]


def container(found: list[tuple[_Block, str]], weight: list[float]) -> tuple[Element, bool]:
    """The content's element, and whether it is the page's only <article> or <main> with text outside links."""
    articles = {b.element.content for b, said in found if b.element.content is not None and b.element.content.weak == 0 and len(said) > b.linked}
    if len(articles) == 1:
        return articles.pop(), True
    order = _above(found)
    held = dict.fromkeys((e.number for e in order), 0.0)
    own = dict(held)
    for (b, _), w in zip(found, weight, strict=True):
        own[b.element.number] += w
    inner: dict[int, Element] = {}  # the heaviest element inside each
    for e in reversed(order):
        if e.parent is not None:
            held[e.parent.number] += held[e.number] + own[e.number]
            best = inner.get(e.parent.number)
            if held[e.number] and (best is None or held[e.number] > held[best.number]):
                inner[e.parent.number] = e
    here, total = order[0], held[order[0].number]
    while here.number in inner and held[inner[here.number].number] >= SHARE * total:
        here = inner[here.number]
    return here.content or here, False


def scores(found: list[tuple[_Block, str]]) -> dict[Element, float]:
    """The score of each element with text, from 0 to 1."""
    weight = fused(found)
    home, certain = container(found, weight)
    of_path: dict[Path, float] = defaultdict(float)
    linked: dict[tuple[Element, Path], list[int]] = defaultdict(lambda: [0, 0])
    group = lambda e: (e.parent if e.path.tag in _TEXT and e.parent else e, e.path)
    for (b, _), w in zip(found, weight, strict=True):
        of_path[b.path] += w
        own = linked[group(b.element)]
        own[0] += b.linked
        own[1] += sum(map(len, b.parts))
    heaviest = max(of_path.values()) or 1.0
    on_way, e = set(), home
    while e is not None:
        on_way.add(e.number)
        e = e.parent
    common: dict[int, int] = {}  # how deep an element and the container have all above in common
    inside: dict[int, bool] = {}
    for e in _above(found):
        inside[e.number] = e is home or (e.parent is not None and inside[e.parent.number])
        common[e.number] = e.depth if e.number in on_way else common[e.parent.number]
    # weak names that the whole container carries tell nothing
    usual = min((b.weak for b, _ in found if inside[b.element.number]), default=0)
    out: dict[Element, float] = {}
    for b, _ in found:
        e = b.element
        if e in out:
            continue
        tag, share = e.path.tag, of_path[e.path] / heaviest
        free = min(1.0, 2 - 2 * linked[group(e)][0] / max(1, linked[group(e)][1]))
        if inside[e.number]:
            support = 1.0
        else:
            steps = home.depth - common[e.number] + max(0, e.depth - 1 - common[e.number])
            support = (STEP_HEADING if tag in _HEADINGS else STEP_TEXT if tag in _TEXT and not certain else STEP_OTHER) ** steps
            share *= not certain
        out[e] = WEAK ** max(0, b.weak - usual) * free * (support + share) / 2
    return out


def extract(page: str | None) -> str:
    """The main text of a page: the blocks of content elements, joined by newlines."""
    found = []
    for b in blocks(page or ""):
        said = " ".join(html.unescape("".join(b.parts)).split())
        if said:
            found.append((b, said))
    if not found:
        return ""
    score = scores(found)
    return "\n".join(said for b, said in found if score[b.element] >= THRESHOLD)


def main_text(pages: DataFrame) -> DataFrame:
    """pages without html, with text and n_chars."""
    made = ("text", "n_chars")
    kept = [c for c in pages.columns if c not in made and c != "html"]
    rows = pages.select(*kept, "html")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [extract(x.as_py()) for x in part.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), "text string", "n_chars long"])
    return rows.mapInArrow(read, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with their main text."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
