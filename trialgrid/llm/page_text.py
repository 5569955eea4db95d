"""Main text of HTML pages by a tree-structured graphical model.

A page's elements form a tree. Each element has a hidden label, content or not, with evidence (tag, words of class, id and
role, link share, length and punctuation of its own text) and a potential with its parent's label that depends on its
tag. Sum-product messages go from the leaves to the root and back, and the marginals decide. Evidence and potentials are
smoothed counts over labelled pages: a few written ones (`seed_pages`) and those of the table that mark their text with one
`article` element, up to `max_labelled` in hash order (a documented bound); all pages are then extracted whole.

Scripts, styles, templates, frames, titles, comments and form fields carry no text; drawings, formulas, embedded objects and
what stands in for scripts are parsed like the rest. Null and empty pages give the empty text. Repeated
rows give the same text. Unclosed elements, stray end tags and pages cut anywhere are read as browsers do: an unfinished
tag is dropped, and an open element ends with its parent. Only the id, url and html columns are read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.seed_pages import SEEDS

#: Fixed lists of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN = frozenset("svg math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mover munder munderover mspace mstyle mpadded mphantom mprescripts semantics".split())  # a closing slash ends them
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split()) | FOREIGN
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
        "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
#: A quote opens a value only after an equals sign; a raw element's name ends where the name ends.
ATTRIBUTES = r"""(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+"""
PART = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|template|iframe|textarea|title(?![^>]*/>))(?=[\s/>])" + ATTRIBUTES + r">.*?(?:</\1\s*>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)(" + ATTRIBUTES + r")>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/!?][^>]*\Z", re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
MARK = re.compile(r"""\by\s*=\s*"([01])\"""")


@dataclass
class Node:
    tag: str
    names: tuple[str, ...] = ()
    mark: int | None = None
    parent: int = -1
    own: list[int] = field(default_factory=list)  # places of its runs of text
    size: int = 0
    linked: int = 0
    stops: int = 0


def parse(page: str) -> tuple[list[Node], list[list]]:
    """Block elements in page order (parents first), and the runs of text between block ends as [node, text]."""
    nodes, runs = [Node("#root")], []
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with the block they belong to
    opened: Counter = Counter()  # open elements by name: no scan of the stack for one that isn't there
    fresh, links, at = True, 0, 0

    def text(raw: str) -> None:
        nonlocal fresh
        if opened["select"]:
            return
        raw = references.unescape(raw)
        if not raw:
            return
        k = stack[-1][1]
        if fresh or not runs or runs[-1][0] != k:
            if not raw.strip():
                return
            runs.append([k, raw])
            nodes[k].own.append(len(runs) - 1)
            fresh = False
        else:
            runs[-1][1] += raw
        n = len(raw.strip())
        nodes[k].size += n
        nodes[k].linked += n if links else 0
        nodes[k].stops += raw.count(".") + raw.count(",")

    def pop_to(i: int) -> None:
        nonlocal fresh, links
        for tag, _ in stack[i:]:
            fresh = fresh or tag not in INLINE
            links -= tag == "a"
            opened[tag] -= 1
        del stack[i:]

    for m in PART.finditer(page):
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag in INLINE and tag not in FOREIGN and stack[i][0] not in INLINE:
                    break
            continue
        if opened["select"] and (tag in CLOSES_P or tag in ("input", "select")):  # an open choice ends where something else begins
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "select":
                    pop_to(i)
                    break
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in SAME and any(opened[t] for t in SAME[tag][0]):
            ends, within = SAME[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    pop_to(i)
                    break
                if stack[i][0] in within:
                    break
        if tag in VOID or m[4].endswith("/") and (tag in FOREIGN or tag not in INLINE and tag not in CLOSES_P):
            fresh = fresh or tag in ("br", "hr")
            continue
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
            opened[tag] += 1
            links += tag == "a"
            continue
        fresh = True
        names = tuple(f"{k.lower()}:{w}" for k, v in NAMED.findall(m[4]) for w in re.findall(r"[a-z]+", v.lower())) if m[4] else ()
        mark = MARK.search(m[4]) if m[4] else None
        nodes.append(Node(tag, names, int(mark[1]) if mark else None, stack[-1][1]))
        stack.append((tag, len(nodes) - 1))
        opened[tag] += 1
    if at < len(page):
        text(page[at:])
    return nodes, runs


def evidence(node: Node) -> list[str]:
    out = ["tag:" + node.tag, *{"name:" + n.split(":", 1)[1] for n in node.names}, *{n for n in node.names if n.startswith("role:")}]
    if node.size:
        out += [f"size:{min(9, int(math.log2(node.size + 1)))}", f"links:{int(4 * node.linked / node.size)}", f"stops:{min(3, node.stops)}"]
    return out


def marked(nodes: list[Node]) -> list[int]:
    """Labels from marks, else from the one article element: inside, but not in what articles hold besides text."""
    out: list[int] = []
    for n in nodes:
        above = out[n.parent] if n.parent >= 0 else 0
        if n.mark is not None:
            out.append(n.mark)
        elif n.tag == "article":
            out.append(1)
        elif n.tag in ("nav", "aside", "form", "footer"):
            out.append(0)
        else:
            out.append(above)
    return out


def counts(nodes: list[Node], labels: list[int]) -> Counter:
    found: Counter = Counter()
    for n, y in zip(nodes, labels):
        found.update((f"n {e}", y) for e in evidence(n))
        found["n", y] += 1
        if n.parent >= 0:
            found[f"e {n.tag} {labels[n.parent]}", y] += 1
            found[f"e {labels[n.parent]}", y] += 1
    return found


class Model:
    """Log potentials from counts; an element name seen nowhere has the average of all."""

    def __init__(self, found: dict[tuple[str, int], float]):
        self.total = [found.get(("n", y), 0) + 1.0 for y in (0, 1)]
        self.weight: dict[str, float] = {}
        for key in {k for k, _ in found if k.startswith("n ")}:
            a, b = (((found.get((key, y), 0) + 0.5) / (self.total[y] + 1)) for y in (1, 0))
            self.weight[key[2:]] = max(-6.0, min(6.0, math.log(a / b)))
        self.edges = {k[2:]: None for k, _ in found if k.startswith("e ")}
        for key in self.edges:
            n = [found.get((f"e {key}", y), 0) + 0.5 for y in (0, 1)]
            self.edges[key] = [x / sum(n) for x in n]

    def edge(self, tag: str, above: int) -> list[float]:
        return self.edges.get(f"{tag} {above}") or self.edges.get(str(above)) or [0.5, 0.5]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each element by one pass of messages up the tree and one down."""
        # potential of an element: evidence odds, tempered as the pieces of evidence aren't independent
        up = []
        for n in nodes:
            odds = max(-30.0, min(30.0, 0.7 * sum(self.weight.get(e, 0.0) for e in evidence(n))))
            up.append([1.0, math.exp(odds)])
        pair = [None if n.parent < 0 else (self.edge(n.tag, 0), self.edge(n.tag, 1)) for n in nodes]
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
            e, u = pair[i], up[i]
            m = [e[p][0] * u[0] + e[p][1] * u[1] for p in (0, 1)]
            s = m[0] + m[1]
            sent[i] = (m[0] / s, m[1] / s)
            above = up[nodes[i].parent]
            above[0] *= sent[i][0]
            above[1] *= sent[i][1]
            s = above[0] + above[1]
            above[0] /= s
            above[1] /= s
        belief = [[0.0, 0.0]] * len(nodes)
        for i, n in enumerate(nodes):
            u = up[i]
            if i:
                b = belief[n.parent]
                down = [b[p] / max(sent[i][p], 1e-300) for p in (0, 1)]
                e = pair[i]
                u = [u[y] * (down[0] * e[0][y] + down[1] * e[1][y]) for y in (0, 1)]
            s = u[0] + u[1]
            belief[i] = [u[0] / s, u[1] / s] if s > 0 else [0.5, 0.5]
        return [b[1] for b in belief]

    def text(self, page: str) -> str:
        nodes, runs = parse(page)
        content = self.marginals(nodes)
        return " ".join(t for t in (" ".join(raw.split()) for k, raw in runs if content[k] > 0.5) if t)


SEED_WEIGHT = 20.0


def fit(pages: DataFrame, max_labelled: int = 2000, id_col: str = "page_id", html_col: str = "html") -> Model:
    """Counts over seeds and over the table's pages with one article element, at most `max_labelled` of them."""
    found: Counter = Counter()
    for seed in SEEDS:
        nodes, _ = parse(seed)
        for k, n in counts(nodes, marked(nodes)).items():
            found[k] += SEED_WEIGHT * n
    one = F.size(F.regexp_extract_all(F.lower(html_col), F.lit(r"<article[\s>]"), F.lit(0))) == 1
    ids = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    sample = pages.join(F.broadcast(ids), F.col(id_col).eqNullSafe(F.col("__id")), "left_semi").where(one)  # at most max_labelled ids are broadcast

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for f in frames:
            for page in f["html"]:
                nodes, _ = parse(page)
                total.update(counts(nodes, marked(nodes)))
        yield pd.DataFrame([(k, y, n) for (k, y), n in total.items()], columns=["key", "y", "n"])

    rows = sample.select(F.col(html_col).alias("html")).mapInPandas(run, "key string, y int, n bigint").groupBy("key", "y").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # distinct features of a bounded sample
        found[r["key"], r["y"]] += r["n"]
    return Model(found)


def extract(pages: DataFrame, max_labelled: int = 2000, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = fit(pages, max_labelled, id_col, html_col)
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model)  # the features of at most max_labelled pages

    @F.pandas_udf("string")
    def text(page: pd.Series) -> pd.Series:
        return page.map(shared.value.text)

    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))


ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<(?:/?p|br|/?h1)>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(t, '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;', '>'), '\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, url, regexp_replace(t, '&amp;?', '&', 'g') AS text, length(regexp_replace(t, '&amp;?', '&', 'g'))::BIGINT AS n_chars FROM c
"""
