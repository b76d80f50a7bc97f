"""Main text of web pages by a tree-structured graphical model over their DOM.

Each block element is a binary variable: content or not. A parent-child potential ties it to the block that holds it,
and a unary potential weighs its tag, class, id and role words, link density and text length. Sum-product messages go
up from the leaves and down from the root; a block's text is kept where its marginal of being content is at least one
half. The potentials are counts, with a prior, over labelled pages: built ones (`labelled_pages`), and a bounded sample
of the given pages whose own markup says what is content (`<article>` or `<main>` against `<nav>`, `<footer>` and the like).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("template svg object canvas audio video head".split())
#: Elements whose content is raw text, none of it shown as the page's text: it ends at their own end tag only.
RAW = frozenset("script style title textarea noscript iframe noembed noframes".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = RAW - {"textarea", "iframe", "noembed"} | frozenset("base basefont bgsound link meta template head".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot option optgroup label button legend".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("html body table ul ol dl div article section aside nav main header footer form td th".split())

#: What may stand beside a body.
ROOT = IN_HEAD | frozenset(("html", "body"))

#: The block that a browser puts around text that stands in a holder of blocks itself.
LOOSE = "#text"

#: Blocks that hold others; their tie to the block above differs from that of paragraphs, headings and the like.
HOLDERS = frozenset("html body div section article main header footer nav aside form center table tbody tr td ul ol dl".split())

#: What the features of a block that holds no others begin with, and what they weigh: such blocks come in numbers, and say the same again.
LEAF, LEAF_WEIGHT = "leaf ", 0.3
#: Names are given on purpose.
NAME_WEIGHT = 2.0
TAGS = ("tag ", f"{LEAF}tag ")

CONTENT_MARKS = ("article", "main")
OTHER_MARKS = ("nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "select", "textarea", "search")

#: Open elements up to which new ones are opened inside each other, as in browsers; deeper ones count with the last of these.
DEEPEST = 512

# The states of the HTML tokenizer inside a tag, without a way back: name, attributes with quoted or bare values, end.
_SPACE = r"[\t\n\f\r ]"
_ATTRIBUTE = rf"""([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:{_SPACE}*+={_SPACE}*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|(?=>)|([^\t\n\f\r >"'][^\t\n\f\r >]*+)))?+"""
_NAMED = re.compile(_ATTRIBUTE)
_TAG = re.compile(rf"""</?([a-zA-Z][^\t\n\f\r />]*+)((?:[\t\n\f\r /]++|{_ATTRIBUTE.replace("([^", "(?:[^")})*+)>""")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in RAW}
_WORDS = re.compile(r"[a-z]+|[0-9]+")


class Node:
    """A block element: its parent's number, tag, naming words, and how much text and link text stands right in it."""

    __slots__ = ("chars", "link_chars", "names", "parent", "tag")

    def __init__(self, parent: int, tag: str, names: tuple[str, ...]):
        self.parent, self.tag, self.names, self.chars, self.link_chars = parent, tag, names, 0, 0


def tokens(page: str):  # noqa: ANN201
    """The page as (tag, attributes, end tag or not), and texts as (None, text, False), in one pass.

    Comments, declarations and the content of RAW elements are left out; what stands in a tag, comment or RAW element
    that is never closed goes with it, as in a browser.
    """
    at, n = 0, len(page)
    while at < n:
        less = page.find("<", at)
        if less < 0:
            less = n
        if less > at:
            yield None, page[at:less], False
        at = less
        after = page[at + 1 : at + 3]
        end = after[:1] == "/"
        letter = after[1:] if end else after[:1]
        if "a" <= letter.lower() <= "z" and letter.isascii():
            m = _TAG.match(page, at)
            if m is None:
                return
            at, tag = m.end(), m[1].lower()
            yield tag, m[2], end
            if not end and tag in RAW:
                close = _RAW_END[tag].search(page, at)
                if close is None:
                    return
                m = _TAG.match(page, close.start())
                at = m.end() if m else n
        elif page.startswith("<!--", at):
            m = None if page.startswith((">", "->"), at + 4) else _COMMENT_END.search(page, at + 4)
            at = page.find(">", at) + 1 if page.startswith((">", "->"), at + 4) else m.end() if m else n
        elif after[:1] in ("!", "?") or (end and after[1:]):  # the like of a comment; an end tag without a name
            at = page.find(">", at) + 1 or n
        elif at < n:
            yield None, "<", False
            at += 1


def _names(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role."""
    found: dict[str, str] = {}
    for m in _NAMED.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return tuple(w for k in ("class", "id", "role") for w in _WORDS.findall(html.unescape(found.get(k, "")).lower()))


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements (parents first) and the texts of the blocks in page order as (node, text). Text right in a holder of blocks gets a block of its own.

    End tags that a browser implies are implied; those that match nothing are left out. A head ends at the first thing
    that cannot stand in it. Inline elements belong to their block; a line break is white space. Text in scripts,
    styles, titles, comments and the head is none. The time is in proportion to the page.
    """
    nodes, blocks = [Node(-1, "html", ())], []
    linked = 0  # characters of the text at hand that stand in links
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block that they belong to
    opened = Counter(["html"])  # how many of a tag are open
    hidden = links = 0
    text: list[str] = []

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                node = stack[-1][1]
                if nodes[node].tag in HOLDERS:
                    nodes.append(Node(node, LOOSE, ()))
                    node = len(nodes) - 1
                blocks.append((node, joined))
                nodes[node].chars += len(joined)
                nodes[node].link_chars += linked
            linked = 0

    def pop(depth: int) -> None:
        nonlocal hidden, links
        while len(stack) > depth:
            tag, _ = stack[-1]
            if tag in BLOCK:
                flush()
            stack.pop()
            opened[tag] -= 1
            hidden -= tag in HIDDEN
            links -= tag == "a"

    def push(tag: str, node: int) -> None:
        nonlocal hidden, links
        if len(stack) < DEEPEST:
            stack.append((tag, node))
            opened[tag] += 1
            hidden += tag in HIDDEN
            links += tag == "a"

    for tag, rest, end in tokens(page):
        if stack[-1][0] == "head" and not end and (tag not in IN_HEAD if tag is not None else rest.strip()):
            pop(len(stack) - 1)
        if len(stack) == 1 and not end and (tag not in ROOT if tag is not None else rest.strip()):  # a body that is not written
            nodes.append(Node(0, "body", ()))
            push("body", len(nodes) - 1)
        if tag is None:
            if not hidden:
                piece = html.unescape(rest)
                text.append(piece)
                if links:
                    linked += len(piece.strip())
            continue
        if end:
            if not opened[tag] or tag in ("html", "body"):  # what follows a body belongs to it
                continue
            at = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
            if tag in BLOCK or tag in HIDDEN or not any(stack[k][0] in SCOPE for k in range(at + 1, len(stack))):
                pop(at)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if (tag in ("html", "body") and opened[tag]) or (tag == "head" and (len(nodes) > 1 or len(stack) > 1 or blocks)):
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    pop(k)
                    break
                if stack[k][0] in SCOPE and stack[k][0] not in ends:
                    break
        if tag in BLOCK:
            flush()
            if tag == "textarea":
                continue
            if tag != "hr":
                nodes.append(Node(stack[-1][1], tag, _names(rest) if rest else ()))
                push(tag, len(nodes) - 1)
        elif tag in RAW:
            continue
        elif tag not in VOID and not rest.endswith("/"):
            push(tag, stack[-1][1])
        else:
            text.append(" " if tag == "img" else "")
    pop(1)
    flush()
    return nodes, blocks


def features(nodes: list[Node]) -> list[list[str]]:
    """What the unary potentials see of each node: tag, names, share of links and length of all its text; of a holder, how much of the page's text stands right in it; whether a block has all of the page's text, and whether a body has no holder with text in it."""
    chars, link_chars, held = [n.chars for n in nodes], [n.link_chars for n in nodes], []
    for k in range(len(nodes) - 1, 0, -1):
        chars[nodes[k].parent] += chars[k]
        link_chars[nodes[k].parent] += link_chars[k]
    own = [0] * len(nodes)  # characters of the blocks right in a holder
    for k, n in enumerate(nodes):
        if k and n.tag not in HOLDERS:
            own[n.parent] += chars[k]
    flat = not any(n.tag in HOLDERS and n.tag != "body" and chars[k] for k, n in enumerate(nodes) if n.parent >= 0)
    for k, n in enumerate(nodes):
        whole = n.tag not in HOLDERS and chars[k] == chars[0]
        share = min(3, int(4 * link_chars[k] / chars[k])) if chars[k] else 4
        kind = "" if n.tag in HOLDERS else LEAF
        held.append([f"{kind}tag {n.tag}", f"{kind}links {share}", f"{kind}length {min(6, chars[k].bit_length() // 2)}", *([] if kind or n.tag == "body" else [f"own {4 * own[k] // (chars[0] + 1)}"]), *(["whole"] if whole else ["flat"] if flat and n.tag == "body" else []), *{f"name {w}" for w in n.names}])
    return held


class TreeModel:
    """Counts of features and of parent-child pairs by label, and the marginals that they give."""

    def __init__(self, counts: dict[tuple[str, int], float], prior: float = 0.05):
        labels = [sum(v for (k, y), v in counts.items() if k.startswith(TAGS) and y == c) + 2 * prior for c in (0, 1)]
        self.seen = {k for k, _ in counts if not k.startswith("pair ")}
        weight = {k: NAME_WEIGHT if k.startswith("name ") else LEAF_WEIGHT if k.startswith(LEAF) else 1.0 for k in self.seen}
        self.unary = {k: tuple(weight[k] * math.log((counts.get((k, y), 0) + prior) / (labels[y] + 2 * prior)) for y in (0, 1)) for k in self.seen}
        self.pair = {}
        for holder in (False, True):
            rows = [[counts.get((f"pair {holder} {above}", y), 0) + 1 for y in (0, 1)] for above in (0, 1)]
            self.pair[holder] = [[x / sum(row) for x in row] for row in rows]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each node: messages from the leaves to the root, then back."""
        unary, pairs = self.unary, [self.pair[n.tag in HOLDERS] for n in nodes]
        up = []
        for found in features(nodes):
            a = b = 0.0
            for f in found:
                if f in unary:
                    x, y = unary[f]
                    a += x
                    b += y
            m = max(a, b)
            up.append([math.exp(max(a - m, -60.0)), math.exp(max(b - m, -60.0))])
        sent = [(1.0, 1.0)] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            (a, b), pair = up[k], pairs[k]
            to = pair[0][0] * a + pair[0][1] * b, pair[1][0] * a + pair[1][1] * b
            s = to[0] + to[1]
            sent[k] = to = to[0] / s, to[1] / s
            above = up[nodes[k].parent]
            above[0] *= to[0]
            above[1] *= to[1]
            s = above[0] + above[1]
            above[0] /= s
            above[1] /= s
        belief = [(0.0, 0.0)] * len(nodes)
        a, b = up[0][0] * 0.95, up[0][1] * 0.05
        belief[0] = a / (a + b), b / (a + b)
        for k in range(1, len(nodes)):
            (p0, p1), pair = belief[nodes[k].parent], pairs[k]
            c0, c1 = p0 / max(sent[k][0], 1e-300), p1 / max(sent[k][1], 1e-300)
            a, b = up[k][0] * (c0 * pair[0][0] + c1 * pair[1][0]), up[k][1] * (c0 * pair[0][1] + c1 * pair[1][1])
            s = a + b
            belief[k] = (a / s, b / s) if s > 0 else (0.5, 0.5)
        return [b for _, b in belief]

    def text(self, page: str | None) -> str:
        """The main text: content blocks joined by line feeds; empty for null or none."""
        if not page:
            return ""
        nodes, blocks = parse(page)
        p = self.marginals(nodes)
        return "\n".join(t for k, t in blocks if p[k] >= 0.5)


def own_labels(nodes: list[Node]) -> list[int] | None:
    """Labels by the page's own markup: content in <article> or <main> but for menus, forms and the like in it. None if it has neither."""
    if not any(n.tag in CONTENT_MARKS for n in nodes):
        return None
    labels = []
    for n in nodes:
        above = labels[n.parent] if n.parent >= 0 else 0
        named = {"comment", "comments", "ad", "ads", "advert", "sidebar", "share", "related", "reply"} & set(n.names)
        labels.append(0 if n.tag in OTHER_MARKS or named else 1 if n.tag in CONTENT_MARKS else above)
    return labels


def count_labels(nodes: list[Node], labels: list[int]) -> Counter:
    """(feature, label) counts of a labelled page, with its parent-child pairs."""
    out: Counter = Counter()
    for k, found in enumerate(features(nodes)):
        out.update((f, labels[k]) for f in found)
        if k:
            out[(f"pair {nodes[k].tag in HOLDERS} {labels[nodes[k].parent]}", labels[k])] += 1
    return out


#: Naming words of the built labelled pages.
CONTENT_NAMES = "article content post entry story body text main news blog page single".split()
OTHER_NAMES = (
    "ad ads advert advertisement banner sponsor promo nav navigation navbar menu breadcrumb breadcrumbs header masthead topbar footer copyright legal sidebar side widget "
    "aside related recommended more popular trending tags share social follow comment comments reply respond disqus discussion cookie cookies consent notice gdpr popup modal overlay "
    "newsletter subscribe signup login form search pagination pager skip toolbar disclaimer alert"
).split()


def labelled_pages() -> list[tuple[list[Node], list[int]]]:
    """Built pages with a label for each block.

    For each naming word there are pages in which a block of that name stands before, in or after the content, as links,
    short lines, or prose that is as long as the content's, in paragraphs or loose; content has a name, an element of its
    own (article, main), or neither."""
    prose = "Some longer sentences of running text, as articles have them, stand in this block. " * 3
    tags, others = ("div", "section", "article", "main"), ("div", "section", "aside", "div", "article", "ol")
    kinds = (
        lambda word: "<ul>" + f"<li><a href='#'>{word} item</a></li>" * 5 + "</ul>",
        lambda word: f"<h3>{word}</h3><p>{prose[:60]}</p>",
        lambda word: f"<h2>{word}</h2>" + f"<p>{prose}</p>" * 3,
        lambda word: f"{prose}<br>{prose}",
        lambda word: f"<div class='{word}'><p>{prose}</p></div>" * 4,
        lambda word: f"<ol class='{word}-list'>" + f"<li><p>{prose}</p></li>" * 6 + "</ol>",
    )
    bodies = (
        lambda k, inside: f"<h1>A title of the page</h1>{f'<p>{prose}</p>' * (2 + k % 3)}{inside}<h2>Part</h2><p>{prose}</p><ul><li>{prose[:60]}</li></ul><blockquote><p>{prose[:80]}</p></blockquote>",
        lambda k, inside: f"<h1>A title</h1>{prose}<br>{prose * (k % 3)}{inside}<p>{prose[: 80 + 40 * (k % 4)]}</p>",
        lambda k, inside: f"<h1>A title</h1>{f'<p>{prose[: 50 + 50 * (k % 3)]}</p>' * 2}{inside}",
    )
    out = []
    for k, word in enumerate(OTHER_NAMES * 4):
        turn = k // len(OTHER_NAMES)
        name, tag, other = CONTENT_NAMES[(k + turn) % len(CONTENT_NAMES)], tags[(k + turn) % 4], others[(k + turn) % 6]
        inner = kinds[(k + turn) % 6](word)
        block = f"<{other} {('class', 'id')[k % 2]}='{word}'>{inner}</{other}>"
        before, inside, after = (block if turn in places else "" for places in ((0, 3), (1, 3), (0, 2)))
        named = f" class='{name} content-{k % 2}'" if (k + turn) % 3 else ""
        page = (
            f"<body><header><a href='/'>Site</a><h1>Site</h1></header><nav><ul>{'<li><a>Go there</a></li>' * 4}</ul></nav><div>{before}<{tag}{named}>{bodies[k % 3](k, inside)}</{tag}>"
            f"{after}</div><form><label>Name</label><p>{prose[: 100 * (k % 3)]}</p><button>Send</button></form><footer><p>Rights reserved.</p></footer></body>"
        )
        nodes, blocks = parse(page)
        content = nodes[next(node for node, text in blocks if text.startswith("A title"))].parent
        labels = []
        for at, n in enumerate(nodes):
            above = labels[n.parent] if n.parent >= 0 else 0
            labels.append(1 if at == content else 0 if word in n.names or n.tag in OTHER_MARKS else above)
        out.append((nodes, labels))
    plain = [f"<h1>A title</h1>{f'<p>{prose[: 60 * k]}</p>' * k}" for k in range(1, 5)] + [f"<h1>A title</h1>{prose}<p>{prose}</p>{prose[:70]}", f"<p>{prose[:20]}</p>"]
    plain += [prose[:n] for n in (1, 3, 8, 20, 60, 150, 240)] + [f"<div>{prose[:n]}</div>" for n in (9, 70, 240)] + [f"<div>{prose}<p>{prose}</p>{prose}</div>"]
    for page in plain:  # pages without any naming: all of the body is content
        nodes, _ = parse(f"<body>{page}</body>")
        out.append((nodes, [0] + [1] * (len(nodes) - 1)))
    return out


def train_model(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample_rows: int = 2000) -> TreeModel:
    """Fits the potentials to the built pages and to about sample_rows of the given ones, chosen by a 63-bit hash of the id and the page; the driver reads the counts of their features. The pages to extract from are never limited."""
    total = pages.count()
    limit = min(2**63 - 1, 2**63 * sample_rows // max(1, total))

    def count(batches):
        import pandas as pd

        for rows in batches:
            found: Counter = Counter()
            for page in rows["html"]:
                nodes, _ = parse(page or "")
                labels = own_labels(nodes)
                if labels:
                    found.update(count_labels(nodes, labels))
            if found:
                yield pd.DataFrame([(k, y, float(v)) for (k, y), v in found.items()], columns=["feature", "label", "n"]).astype({"label": "int32", "n": "float64"})

    sample = pages.where(F.xxhash64(id_col, html_col).bitwiseAND(2**63 - 1) < F.lit(limit)).select(F.col(html_col).cast("string").alias("html"))
    counted = sample.mapInPandas(count, "feature string, label int, n double").groupBy("feature", "label").agg(F.sum("n").alias("n"))
    counts: Counter = Counter({(r["feature"], r["label"]): r["n"] for r in counted.collect()})
    whole = sum(v for (k, _), v in counts.items() if k.startswith(TAGS))
    built: Counter = Counter()
    for nodes, labels in labelled_pages():
        built.update(count_labels(nodes, labels))
    own = sum(v for (k, _), v in built.items() if k.startswith(TAGS))
    weight = min(1.0, own / whole) if whole else 1.0  # the sample weighs as much as the built pages at most
    return TreeModel({k: built.get(k, 0) + weight * counts.get(k, 0) for k in built.keys() | counts.keys()})


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", model: TreeModel | None = None) -> DataFrame:
    """One row per page: id, url, text, n_chars. Null html is empty and gives an empty text; repeated rows stay; an empty table gives an empty result."""
    model = model or train_model(pages, html_col, id_col)

    def extract(batches):
        for rows in batches:
            rows["text"] = [model.text(page) for page in rows["html"]]
            yield rows[["id", "url", "text"]]

    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = dict(base.dtypes)["id"]
    out = base.mapInPandas(extract, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
