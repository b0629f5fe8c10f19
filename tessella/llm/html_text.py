"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
GAP = re.compile(r"[\s/]*")
KEY = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
RAW = {"script", "style", "textarea", "noscript", "template", "title", "iframe", "svg", "object", "canvas", "select", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINER = {"article", "body", "center", "div", "html", "main", "section", "table", "td"}
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An open tag on the left ends at a new tag of the right, unless one of the stops stands between.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th", "tr"}, {"table"}), "th": ({"td", "th", "tr"}, {"table"}), "option": ({"option"}, {"select"})}
NOT_CONTENT = {"nav", "header", "footer", "aside", "button", "menu", "dialog", "head"}
#: Elements that frame controls, and controls. Whether a frame is content is left to the ratios: whole pages can stand in one.
FORMS, CONTROLS = {"form", "fieldset", "label"}, {"input", "select", "textarea", "button"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Elements whose names can tell that they are no content.
NAMED = (CONTAINER - {"article", "body", "html", "main"}) | {"ul", "ol", "dl"}
#: A name counts if each of its words is one of these or of BESIDE. Elements with only a DOUBTFUL word can be content as well.
NOISE = r"ads?|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri[a-z]*|side-?bar|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|share|sharing|social|related|recommend[a-z]*|login|signup|toolbar|pagination|pager"
TALK = r"comments?|commentlist|disqus|respond|replies"
DOUBTFUL = r"notices?|alert|masthead|header|banner|reply|copyright|legal"
BESIDE = r"bar|box|wrap|wrapper|container|list|links?|buttons?|icons?|area|block|top|bottom|left|right|site|page|global|primary|secondary|posts|articles|stories|items|\d+"
NAMES = {kind: re.compile(rf"(?:(?:{BESIDE}|{DOUBTFUL})[_-]+)*({words})(?:[_-]+(?:{NOISE}|{TALK}|{DOUBTFUL}|{BESIDE}))*", re.I) for kind, words in (("noise", NOISE), ("talk", TALK), ("doubtful", DOUBTFUL))}
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…、。，？！；：]")
MASS = 0.9
#: Characters of a text node that is running text.
LONG = 80
#: What the fused ratio of nodes inside elements with a name of no content is multiplied by.
PENALTY = {"noise": 0.05, "talk": 0.05, "form": 0.05, "doubtful": 0.25}


def _noise(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """By structure: never content."""
    if tag in NOT_CONTENT:
        return not (tag == "header" and in_article)
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or NO_DISPLAY.search(attributes.get("style", ""))
    return bool(hidden) or any(r in ROLES for r in attributes.get("role", "").lower().split()[:1])


def _named(tag: str, attributes: dict[str, str]) -> tuple[str, str] | None:
    """(noise, talk or doubtful; the word that says so) by a whole class or id."""
    if tag not in NAMED:
        return None
    names = [n for n in (*attributes.get("class", "").split(), *attributes.get("id", "").split()) if len(n) <= 64]
    return next(((kind, m[1].lower()[:12]) for kind, form in NAMES.items() for n in names if (m := form.fullmatch(n))), None)


class Page:
    """Text nodes of a page, outside of what structure marks as no content, with the element that holds each; and elements whose names are of no content.

    One pass over the source, in time proportional to its length: open elements are found by the
    places of their tags on the stack, and tag paths are numbers.
    """

    def __init__(self, source: str):
        self.source = source
        self.tags, self.parent, self.path = ["#"], [0], [0]
        self.nodes: list[tuple[int, int, str]] = []  # element, block number, raw text
        self.named: dict[int, tuple[str, str]] = {}
        self.controls: list[int] = []  # the element around each control
        self._paths: dict[tuple[int, str], int] = {}
        self._stack, self._places, self._muted = [0], {}, 0
        self._unclosed: set[str] = set()  # quotes that do not occur in the rest of the source
        block, held, at, n = 0, [], 0, len(source)
        while at < n:
            lt = source.find("<", at)
            lt = n if lt < 0 else lt
            held.append(source[at:lt])
            if lt == n:
                break
            end, closing, tag, attributes, alone = self._markup(lt)
            if not end:  # a bare character
                held.append("<")
                at = lt + 1
                continue
            at = end
            if not tag:
                continue
            self._flush(held, block)
            if tag in CONTROLS and not closing and attributes.get("type", "").strip().lower() != "hidden":
                self.controls.append(self._stack[-1])
            if closing:
                if self._places.get(tag):
                    self._close(self._places[tag][-1])
                block += tag in BLOCK
            elif tag in RAW and not alone:
                m = _raw_end(tag).search(source, at)
                at = m.end() if m else n
            elif tag in VOID:
                block += tag == "hr"
                held += [" "] * (tag == "br")
            else:
                ends, stops = ({"p"}, CONTAINER | {"td", "th", "li"}) if tag in CLOSES_P else IMPLIED.get(tag, (set(), set()))
                open_end, open_stop = (max((self._places[t][-1] for t in tags if self._places.get(t)), default=0) for tags in (ends, stops))
                if open_end > open_stop:
                    self._close(open_end)
                block += tag in BLOCK
                if not alone or tag in BLOCK:
                    self._open(tag, attributes)
        self._flush(held, block)

    def _markup(self, lt: int) -> tuple[int, bool, str, dict[str, str], bool]:
        """(end, closing, tag, attributes, self-closing) of the markup at ``lt``; no tag for comments and the like, no end for a bare character."""
        source, n = self.source, len(self.source)
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            return (end + 3 if end >= 0 else n), False, "", {}, False
        closing = source.startswith("</", lt)
        m = NAME.match(source, lt + 1 + closing)
        if not m:
            if not closing and source[lt + 1 : lt + 2] not in ("!", "?"):
                return 0, False, "", {}, False
            end = source.find(">", lt)
            return (end + 1 if end >= 0 else n), False, "", {}, False
        at, attributes = m.end(), {}
        while True:
            gap = GAP.match(source, at)
            at = gap.end()
            if at >= n:
                return n, False, "", {}, False
            if source[at] == ">":
                return at + 1, closing, m[0].lower(), attributes, gap[0].endswith("/")
            key = KEY.match(source, at)
            at = key.end()
            value = ""
            if equals := EQUALS.match(source, at):
                at = equals.end()
                quote = source[at : at + 1]
                end = source.find(quote, at + 1) if quote in ('"', "'") and quote not in self._unclosed else -1
                if end >= 0:
                    value, at = source[at + 1 : end], end + 1
                else:
                    if quote in ('"', "'"):
                        self._unclosed.add(quote)
                    bare = BARE.match(source, at)
                    value, at = bare[0], bare.end()
            attributes.setdefault(key[0].lower(), value)

    def _flush(self, held: list[str], block: int) -> None:
        if held and not self._muted and (text := "".join(held)):
            self.nodes.append((self._stack[-1], block, text))
        held.clear()

    def _open(self, tag: str, attributes: dict[str, str]) -> None:
        element, up = len(self.tags), self._stack[-1]
        self.tags.append(tag)
        self.parent.append(up)
        self.path.append(self._paths.setdefault((self.path[up], tag), len(self._paths) + 1))
        if not self._muted:
            if _noise(tag, attributes, bool(self._places.get("article") or self._places.get("main"))):
                self._muted = element
            elif tag in FORMS:
                self.named[element] = ("form", tag)
            elif attributes and (name := _named(tag, attributes)):
                self.named[element] = name
        self._places.setdefault(tag, []).append(len(self._stack))
        self._stack.append(element)

    def _close(self, place: int) -> None:
        """End the element at this place of the stack and all inside it."""
        while len(self._stack) > place:
            element = self._stack.pop()
            self._places[self.tags[element]].pop()
            self._muted = 0 if self._muted == element else self._muted

    def blocks(self) -> list[tuple[int, int, str]]:
        """(element, block, text) of each text node, references decoded; text still with its white space."""
        return [(e, b, html.unescape(t)) for e, b, t in self.nodes]

    def inside(self, roots: set[int]) -> list[bool]:
        """For each element, whether it is one of the roots or below one."""
        out = [0 in roots]
        for e in range(1, len(self.tags)):
            out.append(e in roots or out[self.parent[e]])
        return out

    def above(self, own: list[float]) -> list[float]:
        """For each element, the sum over itself and all below it."""
        out = list(own)
        for e in range(len(self.tags) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def _penalties(page: Page, nodes: list[tuple[int, int, str]]) -> dict[int, float]:
    """What the ratios inside an element are multiplied by because of its name; 1 for elements that have none.

    A name says nothing about an element that holds an article or main, or if the elements of its name
    hold more than half of the page's long text; for talk, only if there is no other long text, and
    outside of an article or main only if none has other text. A doubtful name also says nothing about
    an element that holds a first heading. Forms and fieldsets go by their tag in the same way, if they hold a control.
    """
    if not page.named:
        return {}
    marked = page.inside({e for e, tag in enumerate(page.tags) if tag in ("article", "main")})
    links = page.inside({e for e, tag in enumerate(page.tags) if tag == "a"})
    names: list[frozenset] = [frozenset()]
    for e in range(1, len(page.tags)):
        up = names[page.parent[e]]
        names.append(up | {page.named[e]} if e in page.named and page.named[e] not in up else up)
    total, by_name, prose, article = 0, {}, False, False
    for e, _, t in nodes:
        n = len(t.strip())
        article = article or n > 0 and marked[e] and not names[e]
        if n >= LONG and not links[e]:
            total += n
            prose = prose or not any(kind == "talk" for kind, _ in names[e])
            for name in names[e]:
                by_name[name] = by_name.get(name, 0) + n
    holds = {kind: page.above([tag in tags for tag in page.tags]) for kind, tags in (("article", ("article", "main")), ("h1", ("h1",)))}
    controls = [0.0] * len(page.tags)
    for e in page.controls:
        controls[e] += 1
    controls = page.above(controls)
    out = {}
    for e, name in page.named.items():
        if name[0] == "form" and name[1] != "label" and not controls[e]:
            continue
        most = 2 * by_name.get(name, 0) > total and not (name[0] == "talk" and prose) and (marked[e] or not article)
        if not (holds["article"][e] or most or name[0] in ("doubtful", "form") and holds["h1"][e]):
            out[e] = PENALTY[name[0]]
    return out


def _smoothed(x: np.ndarray) -> np.ndarray:
    w = np.exp(-(np.arange(-2, 3) ** 2) / 2.0)
    return np.convolve(np.pad(x, 2, mode="edge"), w / w.sum(), mode="valid")


def selected(path: list, size: np.ndarray, marks: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which text nodes their tag path's ratios select; ``weight`` lowers a node's fused ratio and its part in the mean."""
    _, of = np.unique(np.array([hash(x) for x in path]), return_inverse=True)
    n = np.bincount(of)
    text_ratio = (np.bincount(of, size) / n)[of]
    mark_ratio = ((np.bincount(of, marks) + 0.1) / n)[of]
    fused = _smoothed(text_ratio) * _smoothed(mark_ratio) * weight
    seeds = fused >= np.average(fused, weights=size * weight) / 2
    return seeds | ((np.bincount(of, size * seeds) / np.bincount(of, size))[of] >= 0.5)


def _article(page: Page, nodes: list[tuple[int, int, str]], seeds: dict[int, float]) -> list[bool]:
    """Which nodes are returned, from the places of the seeds and their characters.

    All of the core; around each seed outside of it the outermost article or main, or else the nearest
    container that does not hold the core too, or else the seed's block; all between these if no article
    or main marks the core; the headings and unlinked list items that follow each other up to a part that
    is returned, the unlinked list items that follow it, and an earlier first heading.
    """
    mass = [0.0] * len(page.tags)
    for k, n in seeds.items():
        mass[nodes[k][0]] += n
    mass, total = page.above(mass), sum(seeds.values())
    outermost, nearest = [0], [0]  # article or main, and container, at or above each element
    for e, tag in enumerate(page.tags[1:], 1):
        up = page.parent[e]
        outermost.append(outermost[up] or (e if tag in ("article", "main") else 0))
        nearest.append(e if tag in CONTAINER else nearest[up])

    def innermost(least: float) -> int:  # elements are numbered in page order, so the innermost is last
        return next((e for e in range(len(mass) - 1, 0, -1) if mass[e] >= least * (1 - 1e-9) and page.tags[e] in CONTAINER), 0)

    core, wide = innermost(MASS * total), innermost(total)
    marked, above, e = outermost[core], set(), core
    while e:
        above.add(e)
        e = page.parent[e]
    core = marked or core
    inside = page.inside({core})
    take = [inside[e] for e, _, _ in nodes]
    if all(take[k] for k in seeds):
        return take
    roots, blocks = {core}, set()
    for k in seeds:
        if not take[k]:
            best = outermost[nodes[k][0]] or nearest[nodes[k][0]]
            if best and best not in above and best != wide:
                roots.add(best)
            else:
                blocks.add(nodes[k][1])
    inside, within = page.inside(roots), page.inside({wide})
    take = [inside[e] or b in blocks for e, b, _ in nodes]
    if not marked:
        places = [k for k, x in enumerate(take) if x]
        take = [x or places[0] <= k <= places[-1] for k, x in enumerate(take)]
    by_tag = {name: page.inside({e for e, tag in enumerate(page.tags) if tag in tags}) for name, tags in (("heading", {"h1", "h2", "h3", "h4", "h5", "h6"}), ("h1", {"h1"}), ("item", {"li", "dd", "dt"}), ("link", {"a"}))}
    item = [by_tag["item"][e] and not by_tag["link"][e] for e, _, _ in nodes]
    heading = [by_tag["heading"][e] for e, _, _ in nodes]
    blank = [not t.strip() for _, _, t in nodes]
    for k in range(len(nodes) - 2, -1, -1):
        take[k] = take[k] or take[k + 1] and (heading[k] or item[k] or blank[k]) and within[nodes[k][0]]
    for k in range(1, len(nodes)):
        take[k] = take[k] or take[k - 1] and (item[k] or blank[k]) and within[nodes[k][0]]
    first = take.index(True)
    return [x or k < first and by_tag["h1"][nodes[k][0]] and within[nodes[k][0]] for k, x in enumerate(take)]


def content(source: str | None) -> str:
    """The main text of one page.

    Every text node's tag path gets two ratios, characters and punctuation marks for each node of the
    path; both are smoothed along the page, multiplied, and lowered by the names around the node as
    `_penalties` says. Nodes at or above the threshold (half the mean of the fused ratio, each node with
    the weight of its characters) are seeds, as are the others of a path with half of its characters
    in seeds. The innermost container with MASS of the seeds' characters, or the outermost article or main
    around it, is the core; its blocks and those of every other seed are returned, as `_article` says.
    Of these the ratios drop what they don't select: elements that have a name of no content and no seed,
    and two or more blocks in a row of which all text is links and none a seed.
    """
    if not source:
        return ""
    page = Page(source)
    nodes = page.blocks()
    full = [k for k, (_, _, t) in enumerate(nodes) if t.strip()]
    if not full:
        return ""
    penalty, held = _penalties(page, nodes), [1.0]
    for e in range(1, len(page.tags)):
        held.append(min(held[page.parent[e]], penalty.get(e, 1.0)))
    weight = np.array([held[nodes[k][0]] for k in full])
    path = [(page.path[nodes[k][0]], w) for k, w in zip(full, weight, strict=True)]
    size = np.array([len(nodes[k][2].strip()) for k in full], float)
    seeds = selected(path, size, np.array([len(PUNCTUATION.findall(nodes[k][2])) for k in full], float), weight)
    seed_at = {full[k]: size[k] * weight[k] for k in np.flatnonzero(seeds)}
    take = _article(page, nodes, seed_at)

    seeded = [0.0] * len(page.tags)
    for k in seed_at:
        seeded[nodes[k][0]] = 1.0
    seeded = page.above(seeded)
    out_of = page.inside({e for e, p in penalty.items() if p < PENALTY["doubtful"] and not seeded[e]})
    if any(take[k] and not out_of[nodes[k][0]] for k in full):
        take = [x and not out_of[e] for x, (e, _, _) in zip(take, nodes, strict=True)]
    links = page.inside({e for e, tag in enumerate(page.tags) if tag == "a"})
    plain = {nodes[k][1] for k in full if take[k] and (not links[nodes[k][0]] or k in seed_at)}
    blocks = list(dict.fromkeys(nodes[k][1] for k in full if take[k]))
    linked = [b not in plain for b in blocks]
    menu = {b for k, b in enumerate(blocks) if linked[k] and (k and linked[k - 1] or k + 1 < len(blocks) and linked[k + 1])}
    take = [x and b not in menu for x, (_, b, _) in zip(take, nodes, strict=True)]
    out: dict[int, list[str]] = {}
    for k, (_, b, t) in enumerate(nodes):
        if take[k]:
            out.setdefault(b, []).append(t)
    return "\n".join(x for x in (" ".join("".join(t).split()) for t in out.values()) if x)


def extract(pages: DataFrame) -> DataFrame:
    """``pages(html, ...)`` with text and n_chars, the main text of the whole page and its code points.

    A null or empty page, and one without content, gives an empty text. Broken markup is read as far
    as it goes. Rows are independent, so repeated ones get equal texts. Other columns pass through;
    a text or n_chars column is replaced.
    """
    pages = pages.drop("text", "n_chars")
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [content(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields) + ", text string, n_chars long")
