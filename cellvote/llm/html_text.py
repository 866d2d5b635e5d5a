"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements and the runs of text in them are the nodes, each content or not.
A node's own potential comes from its tag, the words of its class, id and role,
and, for text, its length, the share of it in links and its punctuation; an edge's
from how often a child of a content or other parent is content.  Both are
estimated from labelled pages.  Messages pass from the leaves to the root and
back (sum-product, exact on a tree), which gives each node's marginal; texts whose
marginal is above one half are the result, in page order.

A page is one row of work: pages are spread over tasks by Spark, and a page with
its tree is all that a task holds besides one Arrow slice.

Defined results: a null or empty page has an empty text; unclosed elements end
with their parent or the page, an unfinished tag or comment at the end is dropped;
scripts, styles and other raw text are never text; rows are independent, so
repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellvote.llm.common import over_chunks
from cellvote.llm.labelled_pages import labelled_pages

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
MARKS = re.compile(r"""(?:^|\s)(class|id|role|data-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "html head body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav ol optgroup option "
    "p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
# A start tag ends an open element of these kinds, unless one of the second kinds lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
ENDS_P = BLOCK - {"html", "head", "body", "button", "label", "option", "td", "th", "tr"}
P_SCOPE = {"button", "td", "th", "table", "caption"}


@dataclass
class Tree:
    """Nodes in page order; a parent stands before its children.  `text` is None for elements."""

    parent: list[int] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    label: list[int] = field(default_factory=list)

    def add(self, parent: int, features: list[str], text: str | None, label: int) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.label.append(label)
        return len(self.parent) - 1


def text_features(text: str, linked: int, tag: str) -> list[str]:
    n = len(text)
    size = "xs" if n < 20 else "s" if n < 60 else "m" if n < 150 else "l"
    share = "none" if linked == 0 else "some" if 2 * linked < n else "most"
    return [f"in:{tag}", f"size:{size}", f"links:{share}", f"stop:{text[-1:] in '.!?'}"]


def parse(page: str) -> Tree:
    """The tree of block elements and texts of a page."""
    tree = Tree()
    root = tree.add(-1, ["tag:root"], None, 0)
    # open elements: tag, node of the nearest block and its tag
    stack: list[tuple[str, int, str]] = [("", root, "")]
    opened: dict[str, list[int]] = {}  # depths of the open elements of a tag, so that no walk up the stack is needed
    held: list[str] = []
    links = linked = 0
    at, n = 0, len(page)

    def node() -> int:
        return stack[-1][1]

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            _, above, tag = stack[-1]
            tree.add(above, text_features(text, linked, tag), text, tree.label[above])
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links
        ended = [tag for tag, _, _ in stack[depth:]]
        if not BLOCK.isdisjoint(ended):
            flush()
        links -= ended.count("a")
        for tag in ended:
            opened[tag].pop()
        del stack[depth:]

    def close(kinds: set[str], scope: set[str]) -> None:
        """Ends the outermost open element of these kinds inside the innermost open one of the scope."""
        inside = max((opened[tag][-1] for tag in scope - kinds if opened.get(tag)), default=0)
        found = [depths[bisect_right(depths, inside)] for tag in kinds if (depths := opened.get(tag)) and depths[-1] > inside]
        if found:
            pop_to(min(found))

    while at < n:
        mark = page.find("<", at)
        match = TAG.match(page, mark) if mark >= 0 else None
        while mark >= 0 and match is None:  # a lone < is text
            mark = page.find("<", mark + 1)
            match = TAG.match(page, mark) if mark >= 0 else None
        upto = mark if match else n
        if upto > at:
            piece = page[at:upto]
            if "&" in piece:
                piece = unescape(piece)
            held.append(piece)
            if links:
                linked += len(piece)
        if match is None:
            break
        at = match.end()
        end, name, rest = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if not name or (at == n and not match.group().endswith(">")):
            continue
        tag = name.lower()
        if end:
            if opened.get(tag):
                pop_to(opened[tag][-1])
            continue
        if tag in RAW:
            if not rest.endswith("/") or tag != "svg":
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else n
            held.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            held.append(" ")
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ENDS_P:
            close({"p"}, P_SCOPE)
        if tag in BLOCK:
            flush()
            above = node()
            features, label = [f"tag:{tag}"], tree.label[above]
            for key, value in MARKS.findall(rest) if rest else ():
                value = value.strip("\"'")
                if key.lower() == "data-label":
                    # the training pages say 0 or 1; any other page may use the name for what it likes
                    label = int(value) if value in ("0", "1") else label
                else:
                    features += [f"word:{w}" for w in WORD.findall(value.lower())]
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, tree.add(above, features, None, label), tag))
        else:
            links += tag == "a"
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, *stack[-1][1:]))
    flush()
    return tree


@dataclass(frozen=True)
class Model:
    """weight: log odds of content by feature; step: P(child label | parent label); prior: P(content) of a node."""

    weight: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of every node, by one upward and one downward pass."""
        n = len(tree.parent)
        get = self.weight.get
        (t00, t01), (t10, t11) = self.step
        own0, own1 = [1.0] * n, [1.0] * n
        for i, features in enumerate(tree.features):
            odds = sum(get(f, 0.0) for f in features)
            own1[i] = p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, odds))))
            own0[i] = 1.0 - p if p < 1.0 else 1e-13
        up0, up1 = [1.0] * n, [1.0] * n
        parent = tree.parent
        # own0 and own1 gather the children's messages on the way up
        for i in range(n - 1, 0, -1):
            b0, b1 = own0[i], own1[i]
            m0, m1 = b0 * t00 + b1 * t01, b0 * t10 + b1 * t11
            s = m0 + m1
            up0[i], up1[i] = m0, m1 = m0 / s, m1 / s
            p = parent[i]
            a0, a1 = own0[p] * m0, own1[p] * m1
            s = a0 + a1
            own0[p], own1[p] = max(a0 / s, 1e-300), max(a1 / s, 1e-300)
        out = [0.0] * n
        full0, full1 = own0[:], own1[:]  # belief with the message from above
        for i in range(n):
            if i:
                p = parent[i]
                q0, q1 = full0[p] / up0[i], full1[p] / up1[i]
                full0[i] *= q0 * t00 + q1 * t10
                full1[i] *= q0 * t01 + q1 * t11
            s = full0[i] + full1[i]
            full0[i], full1[i] = max(full0[i] / s, 1e-300), max(full1[i] / s, 1e-300)
            out[i] = full1[i]
        return out

    def texts(self, page: str) -> list[str]:
        """The content blocks of a page, in order."""
        tree = parse(page)
        return [t for t, p in zip(tree.text, self.marginals(tree)) if t is not None and p > 0.5]


def train(pages: list[str], smooth: float = 0.5) -> Model:
    """Potentials from labelled pages: smoothed log ratios of features, and of labels along edges."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    nodes = [0, 0]
    steps = [[1.0, 0.05], [0.05, 1.0]]
    for page in pages:
        tree = parse(page)
        for i, features in enumerate(tree.features):
            label = tree.label[i]
            nodes[label] += 1
            seen[label].update(set(features))
            if i:
                steps[tree.label[tree.parent[i]]][label] += 1
    weight = {
        f: math.log((seen[1][f] + smooth) / (nodes[1] + 2 * smooth))
        - math.log((seen[0][f] + smooth) / (nodes[0] + 2 * smooth))
        for f in {*seen[0], *seen[1]}
    }
    step = tuple(tuple(x / sum(row) for x in row) for row in steps)
    return Model(weight, step)


def extract(
    pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    model = model or train(labelled_pages())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = ["\n\n".join(model.texts(page)) if page else "" for page in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(over_chunks("html", work), f"page_id {kind}, url STRING, text STRING, n_chars BIGINT")
