"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with two states: it holds main text, or it is boilerplate.  A
node's own features (tag, class and id words, text, links, place) give its potential, and a
potential for each parent and child connects them, by kind of child.  Sum-product messages go
up the tree and down again, which yields every node's exact marginal; the text of a node whose
marginal is a half or more is kept.  The weights are learned by gradient ascent on the
likelihood of labelled pages, with expectations from the same messages; ``training_pages``
writes those pages with their labels from templates, a bounded and documented number.  The log
potential of a parent and a child is divided by the square root of the parent's number of
children, in learning and in use: like children are no independent witnesses.

A text belongs to its nearest block element; inline elements are part of their block, and a
line break ends a block.  Scripts, styles, controls and the head have no text, nor have elements
with the attribute ``hidden``, ``aria-hidden`` true or a style of ``display: none``; they end where
any element of their kind ends, and are no nodes.

Defined results: null or empty html, and pages without kept text, give ''.  Unclosed, crossed
or cut off tags are repaired or ignored, a cut off tag has no text.  Repeated rows are handled
each.  Very deep and very long pages are handled without recursion.  Only the id, url and html
columns are read.
"""
from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 400
EPOCHS = 12

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg select button datalist object canvas audio video".split())
#: Of these the ones that end a block; controls, graphics and scripts may stand inside a sentence.
ENDS = frozenset("title xmp noembed noframes".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                    "strong sub sup time tt u var wbr img picture map area center ruby rt rp nobr").split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl body html article section div nav aside footer header main form td th blockquote".split())

#: A tag's end is the first > outside quotes.  A < outside quotes before that means that the tag
#: was cut off: it has no text, and reading goes on at that <, so no character is passed twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
                    r"|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*+(?=<|\Z)|</?[a-zA-Z][^<>]*(?:(?=<)|>|\Z)|<[/!?]?\Z", re.S)
_ATTR = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PAIR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_DECLARATION = re.compile(r"(?:[^;\"'(]|\"[^\"]*\"|'[^']*'|\([^)]*\)|[\"'(])+")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
SECTIONS = frozenset("article main section nav aside header footer form body".split())

#: Class, id and role words by what they tell; a word counts as its group, so unseen names of a
#: known kind carry weight.
GROUPS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs tabs toc skip pager pagination paging toolbar",
    "head": "header masthead banner topbar branding logo hero",
    "foot": "footer foot copyright colophon legal imprint bottom",
    "side": "sidebar side aside rail widget widgets complementary related recommended recommendations trending popular more teaser teasers",
    "advert": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner commercial outbrain taboola dfp",
    "notice": "cookie cookies consent gdpr notice notices alert alerts warning popup modal overlay dialog paywall privacy disclaimer toast flash message",
    "form": "form login signup signin register subscribe subscription newsletter search searchbox contact field input",
    "social": "share sharing social follow tweet facebook twitter like likes buttons tools tags tag",
    "comment": "comment comments disqus reply replies respond responses discussion reader readers feedback reviews review thread",
    "main": "article content main post entry story body text copy maincontent articlebody postbody hentry prose",
}
_GROUP_OF: dict[str, list[str]] = {}
for _group, _names in GROUPS.items():
    for _name in _names.split():
        _GROUP_OF.setdefault(_name, []).append(_group)


@dataclass
class Node:
    tag: str
    parent: int
    attrs: str = ""
    texts: list[int] = field(default_factory=list)
    own: int = 0
    links: int = 0
    all: int = 0
    all_links: int = 0
    children: int = 0

    @property
    def bond(self) -> float:
        """What the log potentials between this node and each child are multiplied by."""
        return 1 / math.sqrt(self.children) if self.children else 1.0


@dataclass
class Page:
    """Block elements, parents first, and the blocks of text in page order as (node, text)."""
    nodes: list[Node]
    blocks: list[tuple[int, str]]


def hides(attrs: str) -> bool:
    """Whether a tag's attributes hide its element."""
    if not _MAY_HIDE.search(attrs):
        return False
    values: dict[str, str] = {}
    for m in _PAIR.finditer(attrs):
        values.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    if "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true":
        return True
    shown: dict[bool, str] = {}
    for d in _DECLARATION.findall(_COMMENT.sub("", values.get("style", ""))):
        name, _, value = d.partition(":")
        if name.strip().lower() == "display":
            value, mark, _ = value.lower().partition("!")
            shown[bool(mark)] = value.strip()
    return shown.get(True, shown.get(False)) == "none"


def parse(html: str) -> Page:
    nodes, blocks = [Node("#page", -1)], []
    stack: list[tuple[str, int]] = [("#page", 0)]
    run: list[str] = []
    linked = in_link = 0
    # Where the stack holds a hidden element; what stands in it leaves no trace.
    unseen = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                node = nodes[stack[-1][1]]
                node.texts.append(len(blocks))
                node.own += len(text)
                node.links += min(linked, len(text))
                blocks.append((stack[-1][1], text))
            linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if unseen:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        run.append(text)
        if in_link:
            linked += len(text)

    def close(down_to: int) -> None:
        nonlocal in_link, unseen
        if any(t not in INLINE for t, _ in (stack[down_to:unseen + 1] if unseen else stack[down_to:])):
            flush()
        for t, _ in stack[down_to:]:
            in_link -= t == "a"
        del stack[down_to:]
        if unseen >= down_to:
            unseen = 0

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag, attrs = m.group(2).lower(), m.group(3)
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            else:
                if tag in ("p", "br") and not unseen:
                    flush()
            continue
        if tag in RAW:
            if not attrs.endswith("/") and tag not in VOID:
                at = _past(html, at, tag)
            if tag in ENDS and not unseen:
                flush()
            continue
        if tag in VOID:
            if tag in ("br", "hr") and not unseen and not hides(attrs):
                flush()
            continue
        hidden = not unseen and hides(attrs)
        if hidden and attrs.endswith("/") and not re.search(r"=\s*[^\s\"'][^\s]*/\Z", attrs):
            if tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
            in_link += tag == "a"
            if hidden:
                unseen = len(stack) - 1
            continue
        shut = CLOSES.get(tag, set())
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i][0]
            if t == "p" or t in shut:
                close(i)
                if t == "p" and not shut:
                    break
            elif t in SCOPE and t not in shut:
                break
        if unseen:
            stack.append((tag, stack[-1][1]))
            continue
        flush()
        # Its start may have ended a hidden element, so it is looked at again.
        if hidden or hides(attrs):
            stack.append((tag, stack[-1][1]))
            unseen = len(stack) - 1
            continue
        nodes.append(Node(tag, stack[-1][1], attrs))
        nodes[stack[-1][1]].children += 1
        stack.append((tag, len(nodes) - 1))
    flush()
    for n in nodes:
        n.all += n.own
        n.all_links += n.links
    for n in reversed(nodes):
        if n.parent >= 0:
            nodes[n.parent].all += n.all
            nodes[n.parent].all_links += n.all_links
    return Page(nodes, blocks)


def _past(html: str, at: int, tag: str) -> int:
    """The end of an element whose content is skipped; nested ones of the same tag are counted."""
    depth, mark = 1, re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)
    while depth:
        m = mark.search(html, at)
        if m is None:
            return len(html)
        at = m.end()
        depth += -1 if m.group(1) else 0 if tag in ("script", "style", "textarea", "title") or m.group().endswith("/>") else 1
    return at


def features(page: Page) -> list[list[str]]:
    """The binary features of every node."""
    out: list[list[str]] = []
    total = max(1, page.nodes[0].all)
    seen = 0
    within: list[str] = []
    under: list[frozenset[str]] = []
    for n in page.nodes:
        above = page.nodes[n.parent].tag if n.parent >= 0 else "none"
        within.append(above if above in SECTIONS else within[n.parent] if n.parent >= 0 else "none")
        f = ["bias", f"tag={n.tag}", f"within={within[-1]}", f"tag={n.tag} within={within[-1]}"]
        words = set()
        for m in _ATTR.finditer(n.attrs):
            for w in _WORD.findall((m.group(2) or m.group(3) or m.group(4) or "")):
                words.add(w.lower())
        groups = {g for w in words for g in _GROUP_OF.get(w, ())}
        above = under[n.parent] if n.parent >= 0 else frozenset()
        f += [f"group={g}" for g in sorted(groups)] + [f"under={g}" for g in sorted(above)]
        under.append(above if groups <= above else above | groups)
        f += [f"word={w}" for w in sorted(words)]
        if n.all:
            f.append(f"links={min(4, int(5 * n.all_links / n.all))}")
            f.append(f"share={min(4, int(5 * n.all / total))}")
        else:
            f.append("empty")
        f.append(f"length={min(6, int(math.log2(n.own + 1) / 1.5))}")
        if n.texts:
            last = page.blocks[n.texts[-1]][1]
            f.append("sentence" if last[-1] in ".!?…\"'»”" else "phrase")
            f.append("early" if seen * 10 < total else "late" if seen * 10 > 9 * total else "middle")
        seen += n.own
        out.append(f)
    return out


#: Children are tied to their parents by kind.
def kind(tag: str) -> str:
    return tag if tag in ("p", "li", "ul", "ol", "div", "section", "article", "main", "td", "tr", "table", "form", "nav", "aside",
                          "header", "footer", "blockquote", "body") else "h" if re.fullmatch(r"h[1-6]", tag) else "other"


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    pairs: dict[str, list[float]] = field(default_factory=dict)

    def pair(self, tag: str) -> list[float]:
        """Log potentials of (parent, child) states 00, 01, 10, 11."""
        return self.pairs.setdefault(kind(tag), [0.5, -1.0, 0.0, 0.5])

    def marginals(self, page: Page, found: list[list[str]]) -> tuple[list[float], list[tuple[float, ...]]]:
        """Each node's chance of being main text, and the joint chances with its parent."""
        w, nodes = self.weights, page.nodes
        n = len(nodes)
        unary = [max(-30.0, min(30.0, sum(w.get(f, 0.0) for f in fs))) for fs in found]
        in0, in1 = [1.0] * n, [math.exp(u) for u in unary]
        for i in range(n):
            s = in0[i] + in1[i]
            in0[i], in1[i] = in0[i] / s, in1[i] / s
        psi = [(1.0,) * 4] + [tuple(math.exp(v * nodes[x.parent].bond) for v in self.pair(x.tag)) for x in nodes[1:]]
        up0, up1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            a, b, c, d = psi[i]
            m0, m1 = a * in0[i] + b * in1[i], c * in0[i] + d * in1[i]
            s = m0 + m1
            p = nodes[i].parent
            up0[i], up1[i] = m0 / s, m1 / s
            q0, q1 = in0[p] * up0[i], in1[p] * up1[i]
            s = q0 + q1
            in0[p], in1[p] = (q0 / s, q1 / s) if s > 0 else (0.5, 0.5)
        out, joint = [in1[0]], [()]
        out0 = [in0[0]]
        for i in range(1, n):
            p = nodes[i].parent
            # The parent's belief without what this child told it.
            r0, r1 = out0[p] / max(up0[i], 1e-300), out[p] / max(up1[i], 1e-300)
            a, b, c, d = psi[i]
            j = (r0 * a * in0[i], r0 * b * in1[i], r1 * c * in0[i], r1 * d * in1[i])
            s = sum(j) or 1.0
            j = tuple(x / s for x in j)
            joint.append(j)
            out.append(j[1] + j[3])
            out0.append(j[0] + j[2])
        return out, joint


def fit(pages: list[tuple[str, str]], epochs: int = EPOCHS, rate: float = 0.3, seed: int = 42) -> Model:
    """Learn from pages and their main texts.

    A block is main text if it stands in that text; a node if a block below it does.
    """
    model, rng, data = Model(), random.Random(seed), []
    for html, main in pages:
        page, lines = parse(html), set(main.split("\n"))
        state = [0] * len(page.nodes)
        for node, text in page.blocks:
            if text in lines:
                i = node
                while i >= 0 and not state[i]:
                    state[i] = 1
                    i = page.nodes[i].parent
        data.append((page, features(page), state))
    size: dict[str, float] = {}
    pair_size: dict[tuple[str, int], float] = {}
    for _ in range(epochs):
        rng.shuffle(data)
        for page, found, state in data:
            chance, joint = model.marginals(page, found)
            grad: dict[str, float] = {}
            for i, fs in enumerate(found):
                if abs(g := state[i] - chance[i]) > 1e-4:
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + g
            pair_grad: dict[tuple[str, int], float] = {}
            for i in range(1, len(state)):
                k, true = kind(page.nodes[i].tag), 2 * state[page.nodes[i].parent] + state[i]
                bond = page.nodes[page.nodes[i].parent].bond
                for s in range(4):
                    pair_grad[k, s] = pair_grad.get((k, s), 0.0) + bond * ((s == true) - joint[i][s])
            for f, g in grad.items():
                g -= 0.01 * model.weights.get(f, 0.0)
                size[f] = size.get(f, 1e-6) + g * g
                model.weights[f] = model.weights.get(f, 0.0) + rate * g / math.sqrt(size[f])
            for (k, s), g in pair_grad.items():
                row = model.pairs[k]
                g -= 0.01 * row[s]
                pair_size[k, s] = pair_size.get((k, s), 1e-6) + g * g
                row[s] += rate * g / math.sqrt(pair_size[k, s])
    return model


def main_text(html: str | None, model: Model, least: float = 0.5) -> str:
    if not html:
        return ""
    page = parse(html)
    if not page.blocks:
        return ""
    chance, _ = model.marginals(page, features(page))
    return "\n".join(text for node, text in page.blocks if chance[node] >= least)


def training_pages(n: int = TRAIN_PAGES, seed: int = 42) -> list[tuple[str, str]]:
    """Pages from templates with their main texts: the labels are known as the pages are made."""
    rng = random.Random(seed)
    syllables = "an ber che de en fi ga hu in jo ka lo mi nu or pa que ri su ta ung ver wo zu".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a: int = 3, b: int = 16) -> str:
        s = words(a, b).capitalize()
        odd = rng.random()
        if odd < 0.1:
            s = " ".join(x + rng.choice(["###", "&&&", "$$$", "!!", " |"]) for x in s.split())
        elif odd < 0.16:
            s = " ".join([word() + rng.choice(["", ",", "."])] * rng.randint(2, 40))
        elif odd < 0.2:
            s = s.upper()
        return s + rng.choice([".", ".", ".", "!", "?", ""])

    def prose(a: int = 1, b: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randint(a, b)))

    def esc(t: str) -> str:
        return entities.escape(t)

    def named(tag: str, names: str, inner: str) -> str:
        name = rng.choice(names.split())
        how = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {word()}"', f' class="site-{name}"'])
        return f"<{tag}{how}>{inner}</{tag}>"

    def menu() -> str:
        items = "".join(f'<li><a href="/{word()}">{esc(words(1, 3))}</a></li>' for _ in range(rng.randint(2, 9)))
        return rng.choice([lambda: f"<nav><ul>{items}</ul></nav>", lambda: named("div", GROUPS["menu"], f"<ul>{items}</ul>"),
                           lambda: named("ul", GROUPS["menu"], items), lambda: f'<div role="navigation"><ul>{items}</ul></div>'])()

    def aside(group: str, tag: str = "div") -> str:
        inner = rng.choice([lambda: esc(prose(1, 3)), lambda: f"<p>{esc(prose(1, 3))}</p>",
                            lambda: f"<h3>{esc(words(1, 4))}</h3><p>{esc(prose(1, 2))}</p><a href='#'>{esc(words(1, 2))}</a>"])()
        return named(tag, GROUPS[group], inner)

    def comments() -> str:
        each = "".join(rng.choice([lambda: f"<div class='comment'><b>{esc(word())}</b><p>{esc(prose(1, 4))}</p></div>",
                                   lambda: f"<li class='comment'><p>{esc(prose(1, 3))}</p></li>",
                                   lambda: f"<p>{esc(prose(1, 3))}</p>"])() for _ in range(rng.choice([rng.randint(1, 5), rng.randint(6, 40)])))
        return named(rng.choice(["section", "div", "ol", "aside"]), GROUPS["comment"], f"<h3>{esc(words(1, 2))}</h3>{each}")

    def form() -> str:
        return f"<form action='/{word()}'><p>{esc(sentence(2, 6))}</p><label>{esc(words(1, 2))}</label><input name=q><button>{word()}</button></form>"

    def other_block() -> tuple[str, list[str]]:
        """Blocks of a text besides paragraphs and lists, each with its lines."""
        a, b, c = prose(1, 4), sentence(2, 9), words(1, 3)
        return rng.choice([
            lambda: (f"<pre>{esc(a)}</pre>", [a]), lambda: (f"<pre><code>{esc(a)}</code></pre>", [a]),
            lambda: (f"<dl><dt>{esc(c)}</dt><dd>{esc(a)}</dd><dt>{esc(c)}</dt><dd>{esc(b)}</dd></dl>", [c, a, c, b]),
            lambda: (f"<figure><img src=x><figcaption>{esc(b)}</figcaption></figure>", [b]),
            lambda: (f"<address>{esc(b)}</address>", [b]), lambda: (f"<div>{esc(a)}</div>", [a]),
            lambda: (f"<div class='{word()}'><p>{esc(a)}</p><div>{esc(b)}</div></div>", [a, b]),
            lambda: (f"<section><h3>{esc(c)}</h3><p>{esc(a)}</p></section>", [c, a]),
            lambda: (f"<details><summary>{esc(c)}</summary><p>{esc(a)}</p></details>", [c, a]),
            lambda: (f"<table><caption>{esc(b)}</caption><tr><th>{esc(c)}</th><th>{esc(c)}</th></tr><tr><td>{esc(a)}</td><td>{esc(b)}</td></tr></table>",
                     [b, c, c, a, b]),
            lambda: (f"<h4>{esc(b)}</h4><p>{esc(a)}</p>", [b, a]), lambda: (f"<p>{esc(a)} <button>{word()}</button> {esc(b)}</p>", [a + " " + b]),
        ])()

    def article() -> tuple[str, list[str]]:
        parts, main = [], []
        title = sentence(2, 9)
        if rng.random() < 0.85:
            tag = rng.choice(["h1", "h1", "h2"])
            parts.append(f"<{tag}>{esc(title)}</{tag}>")
            main.append(title)
        if rng.random() < 0.25:
            by = words(2, 4)
            line = rng.choice([f"<p>{esc(by)}</p>", f"<p class='byline'>{esc(by)}</p>", f"<address>{esc(by)}</address>", f"<div class='author'>{esc(by)}</div>"])
            parts = [f"<header>{''.join(parts)}{line}</header>"]
            main.append(by)
        for i in range(rng.randint(1, 9)):
            if rng.random() < 0.22:
                part, lines = other_block()
                parts.append(part)
                main += lines
                continue
            t = prose(1, 7) if rng.random() < 0.8 else sentence(1, 3)
            style = rng.random()
            if style < 0.6:
                parts.append(f"<p>{esc(t)}</p>")
            elif style < 0.7:
                parts.append(f"<p><b>{esc(t)}<br>")
            elif style < 0.78:
                first, _, rest = t.partition(" ")
                parts.append(f"<p><a href='/x'>{esc(first)}</a> {esc(rest)}</p>")
            elif style < 0.84:
                parts.append(f"<h2>{esc(t)}</h2>")
            elif style < 0.9:
                items = [t, sentence(), sentence()]
                parts.append("<ul>" + "".join(f"<li>{esc(x)}</li>" for x in items) + "</ul>")
                main += items
                continue
            elif style < 0.95:
                parts.append(f"<blockquote><p>{esc(t)}</p></blockquote>")
            else:
                cells = [t, sentence(), words(1, 2)]
                parts.append("<table><tr>" + "".join(f"<td>{esc(x)}</td>" for x in cells) + "</tr></table>")
                main += cells
                continue
            main.append(t)
        if rng.random() < 0.1:
            # Long runs of short lines: lists, verse, junk.
            lines = [sentence(1, 3) for _ in range(rng.randint(20, 120))]
            if rng.random() < 0.4:
                lines = [lines[0]] * len(lines)
            parts += [f"<p>{esc(x)}</p>" for x in lines]
            main += lines
        for group in ("advert", "social", "side", "notice", "form", "comment"):
            if rng.random() < 0.12:
                parts.insert(rng.randint(0, len(parts)), aside(group))
        return "".join(parts), [" ".join(m.split()) for m in main]

    out = []
    for _ in range(n):
        body, main = article()
        shell = rng.choice([lambda x: f"<article>{x}</article>", lambda x: f"<article>{x}</article>", lambda x: f"<main>{x}</main>",
                            lambda x: f'<div id="{word()}">{x}</div>', lambda x: f'<div class="{word()}">{x}</div>',
                            lambda x: f"<main><article>{x}</article></main>", lambda x: named("div", GROUPS["main"], x),
                            lambda x: f'<div id="{word()}"><div class="{word()}">{x}</div></div>', lambda x: f'<div id="{word()}">{x}</div>',
                            lambda x: f"<section>{x}</section>", lambda x: f"<article><div class='{rng.choice(['review', 'story', 'post', word()])}-body'>{x}</div></article>"])
        before = [f() for f, p in ((menu, 0.8), (lambda: f"<header><a href='/'>{esc(words(1, 3))}</a><p>{esc(sentence())}</p></header>", 0.4),
                                   (lambda: aside("head"), 0.2), (lambda: aside("notice"), 0.3), (lambda: aside("advert"), 0.4),
                                   (form, 0.2), (menu, 0.2)) if rng.random() < p]
        after = [f() for f, p in ((comments, 0.4), (lambda: aside("side", "aside"), 0.35), (lambda: f"<aside>{esc(prose(1, 3))}</aside>", 0.25),
                                  (lambda: aside("side"), 0.25), (lambda: aside("advert"), 0.3), (lambda: aside("social"), 0.2), (form, 0.2),
                                  (lambda: aside("form"), 0.15), (lambda: f"<footer>&copy; {word()}.example &middot; {esc(prose(1, 2))}</footer>", 0.75),
                                  (lambda: aside("foot"), 0.2)) if rng.random() < p]
        end = "" if rng.random() < 0.1 else "</body></html>"
        out.append((f"<!DOCTYPE html><html><head><title>{esc(words(2, 5))}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
                    f"<body>{''.join(before)}{shell(body)}{''.join(after)}{end}", "\n".join(main)))
    return out


def _extractor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([main_text(h, model) for h in b.column(2).to_pylist()], pa.string())],
                ["page_id", "url", "text"])
    return run


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every page."""
    model = model or fit(training_pages())
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extractor(model), "page_id long, url string, text string")
