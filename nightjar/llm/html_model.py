"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and every text is a node with two states, content or not. Unary potentials come from tag, class, id and
role words, link density and text length; pair potentials couple each node to its parent. Sum-product messages run once
from the leaves to the root and once back, which gives the exact marginal of each node; texts with a content marginal
of one half or more make up the main text.

The weights are log-likelihood ratios of features counted on labelled pages, smoothed by a small prior lexicon. Without
given labels, pages whose markup names their only article label themselves.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from nightjar.llm.common import without

TRAINING_PAGES = 2_000  # bound of the labelled sample
STRONG, WEAK = 12.0, 1.0  # largest weight of a naming feature, of any other
PRIOR = 1_000.0  # pseudo-observations of a lexicon word

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[a-z]+")

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style textarea title xmp iframe noembed noframes noscript template select option svg math object audio video canvas button datalist".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ROOTS = frozenset(("html", "body", "#page"))
NAMING_TAGS = frozenset("article main nav aside footer header form menu dialog search".split())
# Prior lexicon: words of tags, classes, ids and roles that name content, and words that name something else.
CONTENT_WORDS = frozenset("article main".split())
OTHER_WORDS = frozenset(
    "nav navigation navbar menu header masthead footer aside sidebar complementary contentinfo ad ads advert advertisement adverts banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices alert popup modal dialog overlay newsletter subscribe subscription signup form login search comment comments reply replies "
    "respond disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar widget copyright legal skip".split())


# Largest log-odds of a pair potential by kind of edge.
COUPLING = {"root": 1.5, "inner": 9.0, "named": 0.5}
# Weights of features that no labelled page shows.
PLAIN = {"tag:p": 1.0, "tag:h1": 0.5, "tag:blockquote": 0.5, "links:0": 0.5, "links:3": -0.5, "links:4": -1.0, "size:7": 0.5, "size:8": 1.0, "size:9": 1.0, "size:10": 1.0}


@dataclass
class Tree:
    """Nodes in page order; a parent comes before its children. A text is a leaf with the tag ``#text``."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    words: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    text: list[str | None] = field(default_factory=lambda: [None])
    block: list[int] = field(default_factory=lambda: [0])


def parse(page: str) -> Tree:
    """The DOM of a page, with the end tags that HTML lets authors leave out; texts that browsers don't show are left out."""
    tree = Tree()
    stack, at, block, hidden = [0], 0, 0, 0

    def leaf(raw: str) -> None:
        if raw and not hidden:
            tree.parent.append(stack[-1])
            tree.tag.append("#text")
            tree.words.append(())
            tree.text.append(html.unescape(raw))
            tree.block.append(block)

    def close(place: int) -> None:
        nonlocal block, hidden
        for node in reversed(stack[place:]):
            hidden -= tree.tag[node] in UNSEEN
            block += tree.tag[node] in BLOCKS
        del stack[place:]

    while True:
        m = TOKEN.search(page, at)
        leaf(page[at:m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for place in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[place]] == tag:
                    close(place)
                    break
            continue
        if tag in CLOSES_P or tag in IMPLIED:
            ends = IMPLIED.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
            fence = FENCES.get(tag, frozenset()) | {"article", "section", "div", "aside", "body"}
            for place in range(len(stack) - 1, 0, -1):
                name = tree.tag[stack[place]]
                if name in ends:
                    close(place)
                elif name in fence:
                    break
        if tag == "br":
            leaf(" ")
        block += tag in BLOCKS
        if tag in VOID:
            continue
        named = [w for a in ATTRIBUTE.finditer(m[3]) for w in NAME_PART.findall((a[2] or a[3] or a[4] or "").lower())] if "=" in m[3] else []
        tree.parent.append(stack[-1])
        tree.tag.append(tag)
        tree.words.append(tuple(dict.fromkeys(named)))
        tree.text.append(None)
        tree.block.append(block)
        stack.append(len(tree.tag) - 1)
        hidden += tag in UNSEEN
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    return tree


def features(tree: Tree) -> tuple[list[list[str]], list[list[str]], list[int]]:
    """Naming and other features of each node, and how many siblings of its tag it has (itself included)."""
    n = len(tree.tag)
    length, linked, inside = [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        inside[i] = inside[tree.parent[i]] or tree.tag[i] == "a"
        if tree.text[i] is not None:
            length[i] = len(tree.text[i].strip())
            linked[i] = length[i] if inside[i] else 0
    for i in range(n - 1, 0, -1):
        length[tree.parent[i]] += length[i]
        linked[tree.parent[i]] += linked[i]
    kin = Counter((tree.parent[i], tree.tag[i]) for i in range(1, n))
    naming, other = [], []
    for i in range(n):
        tag = tree.tag[i]
        naming.append([f"name:{w}" for w in tree.words[i]] + ([f"name:{tag}"] if tag in NAMING_TAGS else []))
        own = [f"links:{4 * linked[i] // length[i] if length[i] else 0}", f"size:{min(10, length[i].bit_length())}"]
        other.append([] if tag in ROOTS else [*own, f"tag:{tag}"] if tag not in NAMING_TAGS else own)
    return naming, other, [kin[tree.parent[i], tree.tag[i]] if i else 1 for i in range(n)]


def self_labels(tree: Tree) -> list[int] | None:
    """Labels of a page whose markup names its only article: 1 for what lies in it, outside of named other parts."""
    articles = [i for i, tag in enumerate(tree.tag) if tag == "article"]
    if len(articles) != 1:
        return None
    labels = [0] * len(tree.tag)
    for i in range(1, len(tree.tag)):
        other = tree.tag[i] in OTHER_WORDS or any(w in OTHER_WORDS for w in tree.words[i])
        labels[i] = int(not other and (tree.tag[i] == "article" or labels[tree.parent[i]] == 1))
    return labels


def observe(page: str, labels: list[int] | None = None) -> Counter:
    """Counts of (feature, label) and of (kind of parent, label of parent, label of child) on one labelled page."""
    tree = parse(page)
    labels = labels or self_labels(tree)
    seen: Counter = Counter()
    if labels is None:
        return seen
    naming, other, _ = features(tree)
    for i in range(1, len(tree.tag)):
        seen["node", labels[i]] += 1
        for f in (*naming[i], *other[i]):
            seen[f, labels[i]] += 1
        kind = edge_kind(tree, i, naming[i])
        seen[f"edge:{kind}:{labels[tree.parent[i]]}", labels[i]] += 1
    return seen


def edge_kind(tree: Tree, node: int, naming: list[str]) -> str:
    """Which pair potential couples a node to its parent: a named part stands for itself, the page holds all sorts."""
    if any(f.removeprefix("name:") in OTHER_WORDS or f.removeprefix("name:") in CONTENT_WORDS for f in naming):
        return "named"
    return "root" if tree.parent[node] < 0 or tree.tag[tree.parent[node]] in ROOTS else "inner"


def fit(counts: Counter) -> dict[str, float]:
    """Weights of features (log-likelihood ratios) and log-odds of the pair potentials."""
    total = [counts["node", 0] + 2.0, counts["node", 1] + 2.0]
    weights = dict(PLAIN)
    for f in {k for k, _ in counts if k != "node"} | {f"name:{w}" for w in CONTENT_WORDS | OTHER_WORDS}:
        got = [counts[f, 0] + 0.5, counts[f, 1] + 0.5]
        if f.startswith("edge:"):
            weights[f] = math.log(got[1] / got[0])
            continue
        word = f.removeprefix("name:")
        if word != f and (word in OTHER_WORDS or word in CONTENT_WORDS):
            got[word in CONTENT_WORDS] += PRIOR * (sum(total) / 100 + 1)
        ratio = math.log(got[1] / total[1]) - math.log(got[0] / total[0])
        most = STRONG if word in OTHER_WORDS else STRONG / 2 if word != f else WEAK
        if word != f and word not in OTHER_WORDS and word not in CONTENT_WORDS:
            most = STRONG / 4  # a word that only the sample speaks for
        weights[f] = max(-most, min(most, ratio))
    return weights


def log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(tree: Tree, weights: dict[str, float]) -> list[float]:
    """Log-odds of content for each node, by one upward and one downward pass of sum-product messages."""
    naming, other, kin = features(tree)
    n = len(tree.tag)
    pair = {}
    for kind, most in COUPLING.items():
        for state in (0, 1):
            odds = weights.get(f"edge:{kind}:{state}", most if state else -most)
            odds = max(-most, min(most, odds))
            low = log_add(0.0, odds)
            pair[kind, state] = (-low, odds - low)  # log P(child = 0 or 1 | parent = state)
    # equal siblings, and all below them, share one weak vote, so that a long list can't outvote what its parent is named
    vote = [1.0] * n
    for i in range(1, n):
        vote[i] = vote[tree.parent[i]] / kin[i]
    unary = [sum(weights.get(f, 0.0) for f in naming[i]) + sum(weights.get(f, 0.0) for f in other[i]) * vote[i] for i in range(n)]
    kinds = [edge_kind(tree, i, naming[i]) for i in range(n)]
    below, message = unary[:], [0.0] * n
    for i in range(n - 1, 0, -1):
        no, yes = pair[kinds[i], 0], pair[kinds[i], 1]
        message[i] = log_add(yes[0], yes[1] + below[i]) - log_add(no[0], no[1] + below[i])
        below[tree.parent[i]] += message[i]
    whole = below[:]
    for i in range(1, n):
        rest = whole[tree.parent[i]] - message[i]  # what the parent believes without this child
        no, yes = pair[kinds[i], 0], pair[kinds[i], 1]
        whole[i] = below[i] + log_add(no[1], yes[1] + rest) - log_add(no[0], yes[0] + rest)
    return whole


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of content in page order, white space inside a block as one space, joined by an empty line."""
    if not page:
        return ""
    tree = parse(page)
    belief = marginals(tree, weights)
    blocks: dict[int, list[str]] = {}
    for i, text in enumerate(tree.text):
        if text is not None and belief[i] >= 0:
            blocks.setdefault(tree.block[i], []).append(text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(b for b in joined if b)


def train(pages: DataFrame, text: str = "html", key: str = "page_id", sample: int = TRAINING_PAGES) -> dict[str, float]:
    """Weights from at most ``sample`` labelled pages, those with the smallest hashes.

    Counts are added up by Spark; the features of a bounded sample are all that reaches the driver. Null pages and pages
    that don't label themselves teach nothing; with no labelled page the prior lexicon decides alone.
    """
    drawn = F.xxhash64(F.lit(7), F.col(key))
    near = int(2**63 * min(1.0, 2 * sample / max(1, pages.count()))) - 1  # about twice the sample passes, whatever the table's size
    chosen = pages.where(F.col(text).isNotNull() & (F.shiftrightunsigned(drawn, 1) <= near)).select(drawn.alias("h"), F.col(text).alias("page")).orderBy("h", F.md5("page")).limit(sample)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: Counter = Counter()
            for page in frame["page"]:
                seen.update(observe(page))
            yield pd.DataFrame([(f, s, c) for (f, s), c in seen.items()], columns=["feature", "state", "n"])

    rows = chosen.select("page").mapInPandas(count, "feature string, state int, n long").groupBy("feature", "state").agg(F.sum("n").alias("n")).collect()
    return fit(Counter({(r["feature"], r["state"]): r["n"] for r in rows}))


def extract(pages: DataFrame, text: str = "html", weights: dict[str, float] | None = None, key: str = "page_id") -> DataFrame:
    """``pages`` with ``text`` (empty if there is none) and ``n_chars`` in place of the html.

    A null or empty page gives an empty text. Rows are independent; repeated rows get equal results. Broken markup is read
    as far as it goes. Input columns named like a result column are replaced. An empty table gives an empty result.
    """
    weights = weights if weights is not None else train(pages, text, key)
    others = [c for c in without(pages, "text", "n_chars").columns if c != text]
    rows = pages.select(*others, F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[main_text(p, weights) for p in frame["text"]])

    return rows.mapInPandas(run, rows.schema).withColumn("n_chars", F.length("text").cast("long"))
