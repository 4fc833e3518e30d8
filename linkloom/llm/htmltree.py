"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of block nodes.  Each node has a hidden state, ``outer`` (holds content and other
things), ``content`` or ``boilerplate``.  A parent-child potential says how likely a child of some kind
has a state given its parent's; a node potential is the product of the likelihoods of its features (tag,
words of class, id and role, link density, length, sentences).  Sum-product messages go up and then down
the tree and give each node's exact marginals; the text of nodes whose likeliest state is content is kept.

The potentials are counts, smoothed, over labelled pages.  No table has labels for nodes, so ``PAGES``
labelled pages are generated (seeded) from common layouts, with and without telling tags and names, and
parsed as any other page; ``train`` takes any labelled pages.

Edge cases: null and empty html give an empty text; unclosed, misnested and cut-off markup is closed
where a browser would; what never shows (script, style, title, comments; a template that is closed) and
closed controls have no nodes, an unclosed one hides nothing after it; deep trees are handled without
recursion, and very long pages are read whole in one pass; a node whose content and boilerplate are equally
likely is kept; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from linkloom.llm.common import mapped

STATES = ("outer", "content", "boilerplate")
PAGES, SEED = 500, 7
#: Weight of length and sentences: they depend on each other, so each counts for less than a whole feature.
MEASURED = 0.4

# Fixed values of HTML: void elements, elements whose text never shows, blocks, and what closes an open <p>.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
# Left out with their end tag, if there is one; of the second kind only where no block comes before it.
HIDDEN, CONTROLS = frozenset(["template"]), frozenset("svg select button".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",)}
SCOPES = frozenset("ul ol dl table body html article section div main".split())

#: Words in class, id, role and the like, by what they speak for.
HINTS = {
    "content": "article articlebody content post entry story main body text blog page hentry",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc pagination pager tabs links toolbar skip",
    "head": "header masthead banner topbar logo branding hero",
    "foot": "footer copyright legal colophon credits bottom contentinfo",
    "side": "sidebar aside related recommended widget rail complementary teaser trending popular",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion outbrain taboola dfp commercial",
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe subscription overlay paywall warning disclaimer message",
    "comment": "comment comments commentlist reply replies respond disqus discussion responses reader",
    "form": "form search login signup register contact feedback captcha",
    "social": "share sharing social tags tag meta byline author print",
}
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)""", re.S)
NEXT = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW | HIDDEN} | {t: re.compile(rf"(</{t}\s*>)|</?(?:{'|'.join(BLOCKS)})(?=[\s/>])", re.I) for t in CONTROLS}
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("attributes", "children", "label", "letters", "linked", "parent", "runs", "sentences", "tag", "text")

    def __init__(self, tag: str, parent: int, attributes: str = ""):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.runs: list[str] = []
        self.children = self.letters = self.linked = self.sentences = 0
        self.text, self.label = "", ""


def parse(page: str) -> list[Node]:
    """Block nodes in page order, parents first; a text beside blocks is a node of its own (#text)."""
    nodes = [Node("#root", -1)]
    stack = [0]  # open block nodes
    opened: Counter[str] = Counter()  # their tags
    run: list[tuple[str, bool]] = []
    links = 0

    def flush(closing: bool) -> None:
        """The text so far belongs to the innermost block, or to a node of its own beside blocks."""
        nonlocal run
        text = " ".join(html.unescape("".join(t for t, _ in run)).split())
        if text:
            top = nodes[stack[-1]]
            linked = sum(len(t) for t, in_link in run if in_link)
            if closing and not top.children and top.tag not in ("#root", "html", "body"):
                node = top
            else:
                top.children += 1
                node = Node("#text", stack[-1])
                nodes.append(node)
            node.text, node.letters, node.linked = text, len(text), linked
            node.sentences = len(re.findall(r"[.!?](?:\s|$)", text))
        run = []

    def close_one() -> None:
        flush(True)
        opened[nodes[stack.pop()].tag] -= 1

    unclosed: set[str] = set()  # no end tag of these follows
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            run.append((page[at:], links > 0))
            break
        if m.start() > at:
            run.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or ""
        if tag in NEXT:
            if not closing and not attributes.endswith("/"):
                stop = None if tag in unclosed else NEXT[tag].search(page, at)
                if tag in RAW:
                    at = stop.end() if stop else end
                elif stop is None:
                    unclosed.add(tag)
                elif tag in HIDDEN or stop[1]:
                    at = stop.end()
            run.append((" ", links > 0))
        elif tag in BLOCKS:
            if closing:
                if not opened[tag]:
                    run.append((" ", links > 0))
                    continue
                while nodes[stack[-1]].tag != tag:
                    close_one()
                close_one()
                continue
            for own in (x for x in CLOSES_ITSELF.get(tag, ()) if tag != "p" and opened[x]):
                for i in range(len(stack) - 1, 0, -1):
                    if nodes[stack[i]].tag == own:
                        while len(stack) > i:
                            close_one()
                        break
                    if nodes[stack[i]].tag in SCOPES:
                        break
            if nodes[stack[-1]].tag == "p" or (nodes[stack[-1]].tag in ("h1", "h2", "h3", "h4", "h5", "h6") and tag[0] == "h" and tag[1:].isdigit()):
                close_one()
            else:
                flush(False)
            if tag == "hr":
                continue
            nodes[stack[-1]].children += 1
            nodes.append(Node(tag, stack[-1], attributes))
            if not attributes.endswith("/"):
                stack.append(len(nodes) - 1)
                opened[tag] += 1
        elif tag == "br" or tag == "img":
            run.append((" ", links > 0))
        elif tag == "a":
            links = max(0, links - 1) if closing else 1
    while len(stack) > 1:
        close_one()
    flush(True)
    return nodes


def bucket(x: float, *bounds: float) -> int:
    return sum(x >= b for b in bounds)


def kind(node: Node) -> str:
    """Selects the parent-child potential."""
    return node.tag if node.tag in ("nav", "header", "footer", "aside", "form", "article", "main", "p", "li", "ul", "ol", "#text") else "h" if node.tag[0] == "h" and node.tag[1:].isdigit() else "block"


def features(nodes: list[Node]) -> list[list[str]]:
    """Features of each node; letters, links and sentences count with what lies below."""
    letters, linked, sentences = ([getattr(n, a) for n in nodes] for a in ("letters", "linked", "sentences"))
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        letters[p] += letters[i]
        linked[p] += linked[i]
        sentences[p] += sentences[i]
    out = []
    for i, n in enumerate(nodes):
        names = []
        hidden = False
        if n.attributes:
            for name, value in ATTRIBUTE.findall(n.attributes):
                if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                    names += [HINT_OF[w] for w in (x.lower() for x in WORD.findall(value)) if w in HINT_OF]
                elif name.lower() == "style" and re.search(r"display:\s*none|visibility:\s*hidden", value):
                    hidden = True
            hidden |= bool(re.search(r"\bhidden\b(?!=)|aria-hidden=.?true", n.attributes))
        other = [x for x in names if x != "content"]
        found = [f"tag={n.tag}", f"hint={other[0] if other else 'content' if names else '-'}", f"length={bucket(letters[i], 1, 25, 80, 200, 1000)}",
                 f"links={bucket(linked[i] / max(1, letters[i]), 0.05, 0.3, 0.6)}", f"sentences={bucket(sentences[i], 1, 2, 5)}", f"hidden={int(hidden)}"]
        out.append(found)
    return out


class Model:
    """Log potentials: node features given the state, and the state given the parent's and the kind."""

    def __init__(self, pages: list[tuple[list[Node], list[int]]], smooth: float = 0.02):
        seen: dict[str, list[float]] = defaultdict(lambda: [smooth] * 3)
        totals: dict[str, list[float]] = defaultdict(lambda: [0.0] * 3)
        edge: dict[str, list[list[float]]] = defaultdict(lambda: [[smooth] * 3 for _ in range(3)])
        for nodes, states in pages:
            for node, state, found in zip(nodes, states, features(nodes)):
                for f in found:
                    seen[f][state] += 1
                    totals[f.split("=")[0]][state] += 1
                if node.parent >= 0:
                    edge[kind(node)][states[node.parent]][state] += 1
                    edge["*"][states[node.parent]][state] += 1
        width = {g: 1 + sum(f.split("=")[0] == g for f in seen) for g in totals}
        self.unseen = {g: [math.log(smooth / (t + smooth * width[g])) for t in totals[g]] for g in totals}
        self.node = {f: [math.log(c / (totals[g][s] + smooth * width[g])) for s, c in enumerate(v)] for f, v in seen.items() for g in [f.split("=")[0]]}
        self.edge = {k: [[c / sum(row) for c in row] for row in rows] for k, rows in edge.items()}

    def potentials(self, found: list[str]) -> list[float]:
        logs = [0.0] * 3
        for f in found:
            row = self.node.get(f) or self.unseen[f.split("=")[0]]
            w = MEASURED if f[0] in "ls" and f[:3] != "lin" else 1.0
            logs = [a + w * b for a, b in zip(logs, row)]
        top = max(logs)
        return [math.exp(x - top) for x in logs]

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """Exact marginals: messages from the leaves to the root, then back."""
        below = [self.potentials(f) for f in features(nodes)]
        below[0] = [1.0, 1e-9, 1e-9]  # the page itself holds both
        message: list[list[float]] = [[]] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            edge, b = self.edge.get(kind(nodes[i])) or self.edge["*"], below[i]
            m = [r[0] * b[0] + r[1] * b[1] + r[2] * b[2] for r in edge]
            total = m[0] + m[1] + m[2]
            message[i] = m = [x / total for x in m]
            p = below[nodes[i].parent]
            p[0], p[1], p[2] = p[0] * m[0], p[1] * m[1], p[2] * m[2]
            total = p[0] + p[1] + p[2]
            p[0], p[1], p[2] = p[0] / total, p[1] / total, p[2] / total
        out = [below[0]]
        for i in range(1, len(nodes)):
            edge, up, m, b = self.edge.get(kind(nodes[i])) or self.edge["*"], out[nodes[i].parent], message[i], below[i]
            rest = [u / max(x, 1e-300) for u, x in zip(up, m)]  # the parent without this child
            x = [b[t] * (rest[0] * edge[0][t] + rest[1] * edge[1][t] + rest[2] * edge[2][t]) for t in range(3)]
            total = sum(x) or 1.0
            out.append([v / total for v in x])
        return out

    def text(self, page: str) -> str:
        nodes = parse(page)
        return " ".join(n.text for n, m in zip(nodes, self.marginals(nodes)) if n.text and m[1] >= m[2] and (m[1] >= m[0] or n.tag == "#text"))


def labelled_page(rng: random.Random) -> str:
    """A page whose blocks name their state in data-y."""

    def words(n: int) -> str:
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))

    def sentence(a: int = 5, b: int = 20) -> str:
        return words(rng.randint(a, b)).capitalize() + rng.choice("....!?")

    def prose(a: int = 1, b: int = 6) -> str:
        parts = [sentence() for _ in range(rng.randint(a, b))]
        if rng.random() < 0.25:
            parts.insert(0, f'<a href="/{words(1)}">{words(2)}</a>')
        if rng.random() < 0.2:
            parts.insert(0, f"<b>{words(3)}</b>")
        return " ".join(parts)

    def element(tag: str, y: str, body: str, name: str = "") -> str:
        attribute = "" if not name or bare else f' {rng.choice(["class", "class", "id"])}="{name}"'
        if y == "boilerplate" and shade.random() < 0.04:  # what a page holds but does not show
            attribute += shade.choice([" hidden", ' style="display:none"', ' aria-hidden="true"'])
        return f'<{tag}{attribute} data-y="{y}">{body}</{tag}>'

    shade = random.Random(rng.getstate()[1][0])  # draws of its own
    bare = rng.random() < 0.3  # no telling names
    plain = rng.random() < 0.3  # no telling tags
    tag = lambda t: "div" if plain and not bare else t
    B, C, O = "boilerplate", "content", "outer"  # noqa: E741

    def link_list() -> str:
        return element(rng.choice(["ul", "ol"]), B, "".join(element("li", B, f'<a href="/{words(1)}">{words(rng.randint(1, 4))}</a>') for _ in range(rng.randint(2, 9))))

    def paragraphs(y: str, a: int, b: int) -> str:
        return "".join(element("p", y, prose()) for _ in range(rng.randint(a, b)))

    def content_block() -> str:
        return rng.choices(
            [
                lambda: element("p", C, prose()),
                lambda: element(rng.choice(["h2", "h3"]), C, words(rng.randint(1, 7))),
                lambda: element(rng.choice(["ul", "ol"]), C, "".join(element("li", C, sentence(3, 14)) for _ in range(rng.randint(2, 5)))),
                lambda: element("blockquote", C, paragraphs(C, 1, 2)),
                lambda: element("table", C, element("tr", C, "".join(element("td", C, words(rng.randint(1, 5))) for _ in range(3)))),
                lambda: element("pre", C, words(12)),
                lambda: element("div", C, prose()),
                lambda: element("figure", C, element("figcaption", C, sentence())),
            ],
            [12, 2, 1, 1, 0.5, 0.4, 1.5, 0.5],
        )[0]()

    def inner_noise() -> str:
        return rng.choice(
            [
                lambda: element("div", B, rng.choice([sentence(), prose(1, 2)]), rng.choice(["ad", "advert", "ad-slot", "sponsored", "promo"])),
                lambda: element(tag("aside"), B, rng.choice([link_list(), paragraphs(B, 1, 2)]), rng.choice(["related", "sidebar", "widget"])),
                lambda: element("div", B, f'<a href="/s">{words(1)}</a> <a href="/t">{words(1)}</a>', rng.choice(["share", "social-links"])),
                lambda: element("form", B, f"{sentence(3, 8)} <input> {words(1)}", rng.choice(["newsletter", "subscribe"])),
            ]
        )()

    def article() -> str:
        parts = [element(rng.choice(["h1", "h1", "h2"]), C, words(rng.randint(2, 14)))] if rng.random() < 0.9 else []
        if parts and rng.random() < 0.2:
            parts = [element("header", C, parts[0])]
        for _ in range(rng.randint(1, 12)):
            parts.append(content_block())
            if rng.random() < 0.07 and not bare:
                parts.append(inner_noise())
        return element(rng.choice(["article", "main", "div", "section"]) if not plain else "div", C, "".join(parts), rng.choice(["content", "post", "article-body", "entry-content", "story", "main-text"]))

    head = [
        lambda: element(tag("header"), B, rng.choice([element("h1", B, words(2)), f'<a href="/">{words(2)}</a>', element("p", B, sentence(2, 6))]) + rng.choice(["", link_list()]), rng.choice(["header", "masthead", "topbar"])),
        lambda: element(tag("nav"), B, link_list(), rng.choice(["nav", "menu", "breadcrumbs"])),
        lambda: element("div", B, rng.choice([sentence(), prose(1, 2), paragraphs(B, 1, 2)]), rng.choice(["ad", "ads", "advertisement", "sponsor"])),
        lambda: element("div", B, rng.choice([prose(1, 2), paragraphs(B, 1, 1)]), rng.choice(["cookie-notice", "notice", "alert", "consent-banner", "popup"])),
        lambda: element("form", B, f"{words(1)} <input> {words(1)}", rng.choice(["search", "login"])),
    ]
    foot = [
        lambda: element(tag("footer"), B, rng.choice([f"&copy; {words(3)} &middot; {sentence()}", link_list(), paragraphs(B, 1, 2)]), rng.choice(["footer", "copyright", "site-footer"])),
        lambda: element(tag("aside"), B, rng.choice([link_list(), element("h3", B, words(2)) + link_list(), paragraphs(B, 1, 3)]), rng.choice(["sidebar", "related", "widget", "recommended"])),
        lambda: element(rng.choice(["section", "div", "ol"]), B, "".join(element(rng.choice(["div", "p", "article", "li"]), B, rng.choice([prose(1, 3), paragraphs(B, 1, 2)]), rng.choice(["comment", "reply", ""])) for _ in range(rng.randint(1, 5))), rng.choice(["comments", "commentlist", "reader-comments", "discussion"])),
        lambda: element("form", B, element("p", B, sentence(3, 8)) + "<input>" + words(1), rng.choice(["contact", "newsletter", "comment-form"])),
        lambda: element("div", B, link_list(), rng.choice(["tags", "related-links", "pagination"])),
    ]
    usable = lambda options: options[:2] if bare else options  # noqa: E731  without names, only what its tags tell
    body = [f() for f in rng.sample(usable(head), rng.randint(0, 2 if bare else 4))]
    core = article() if rng.random() < 0.85 else "".join(rng.choice([content_block, content_block, lambda: prose(1, 3) + "<hr>"])() for _ in range(rng.randint(1, 8)))
    tail = [f() for f in rng.sample(usable(foot), rng.randint(0, 2 if bare else 4))]
    if rng.random() < 0.4:
        body = [element("div", O, "".join([*body, core, *tail]), rng.choice(["wrapper", "container", "site", "page-wrap"]))]
    else:
        body += [core, *tail]
    return f'<html><head><title>{words(3)}</title></head><body data-y="outer">{"".join(body)}</body></html>'


def labelled(page: str) -> tuple[list[Node], list[int]]:
    """Nodes of a labelled page and their states; a node without a label has its parent's."""
    nodes, states = parse(page), []
    for n in nodes:
        m = re.search(r'data-y="(\w+)"', n.attributes)
        # a text of its own beside the blocks of a page or a wrapper is content
        states.append(STATES.index(m[1]) if m else 0 if n.parent < 0 else 1 if n.text and not states[n.parent] else states[n.parent])
        n.attributes = re.sub(r'\s*data-y="\w+"', "", n.attributes)
    return nodes, states


def train(pages: list[str]) -> Model:
    return Model([labelled(p) for p in pages])


@cache
def default_model() -> Model:
    rng = random.Random(SEED)
    return train([labelled_page(rng) for _ in range(PAGES)])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kept = pages.select("page_id", "url", "html")
    schema = f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return mapped(kept, run, schema)
