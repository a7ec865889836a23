"""Main text of web pages: boosted trees over DOM nodes, then hierarchical decoding.

Each block element gets features (subtree density, attribute tokens of its own and of its
ancestors, depth, sibling statistics) and a probability of belonging to the article. A
bottom-up pass then picks the most likely labelling in which nothing below a rejected node
is kept, so an ancestor and its descendants never contradict each other. Text directly in a
kept block is output; inline elements belong to their block; scripts, styles and controls
never count as text.

Training: at most ``sample`` pages (chosen by a hash of the id). Semantic elements label
their nodes, and each page's own text is set again in templates drawn from common HTML
conventions (other containers, menus, sidebars, notices, adverts, forms, comments), so that
the trees learn to go by attributes where semantic elements are missing.

Edge cases: null or empty html gives an empty text and 0; text outside any element is a
block of its own; tags that are never closed end with their parents; a page without a kept
block gives an empty text; nulls in other columns stay; repeated rows give repeated
results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import arrays, probability

# Element kinds and attribute tokens of common HTML practice.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template head title button select textarea iframe svg object canvas option datalist audio video".split())
IN_HEAD = set("base basefont bgsound link meta title noscript noframes style script template head".split())
BLOCK = set("html body div section article main nav header footer aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption fieldset legend address details summary hgroup center menu dialog search".split())
TOKENS = {
    "main": "article main content post entry story body text prose read single blog news page paragraph markdown",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc tabs topnav sitemap links skip",
    "head": "header masthead banner topbar logo brand hero toolbar",
    "foot": "footer foot copyright legal colophon credits bottom",
    "side": "sidebar side aside rail widget widgets secondary complementary column teaser archive",
    "ads": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted commercial banner-ad dfp affiliate",
    "note": "notice cookie cookies consent gdpr alert warning popup modal overlay banner message announcement disclaimer toast privacy paywall",
    "talk": "comment comments discussion disqus reply replies respond reviews review feedback thread guestbook responses",
    "form": "form newsletter subscribe subscription signup login search contact register optin input survey",
    "more": "related recommended recommendations share sharing social author byline tags tag meta bio popular trending next prev similar",
}
GROUPS = list(TOKENS)
_group = {}
for _name, _words in TOKENS.items():
    for _w in _words.split():
        _group.setdefault(_w, []).append(GROUPS.index(_name))
KINDS = [("article", "main"), ("nav", "menu"), ("header", "hgroup"), ("footer", "address"), ("aside", "dialog"), ("form", "fieldset", "search"), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "ul", "ol", "dl", "dt", "dd"), ("div", "section"), ("table", "tr", "td", "th")]
ASIDES = {1, 2, 3, 4, 5}
_kind = {t: i for i, ts in enumerate(KINDS) for t in ts}
_start = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_stop = re.compile(r"[>\"']")
_attr = re.compile(r"\b(class|id|role|aria-label|itemprop|data-component)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_raw = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_closes = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_scope = {"ul", "ol", "dl", "table", "html", "body", "div", "article", "section", "main"}


class Node:
    """A block element. own, above: groups of its attributes' tokens and of its ancestors'; kinds: its ancestors' element kinds; all as sets of bits."""

    __slots__ = ("tag", "up", "kind", "kinds", "parts", "depth", "own", "above", "chars", "linked", "tags", "commas", "inputs", "words")

    def __init__(self, tag: str, up: int, parent: Node | None, own: int):
        self.tag, self.up, self.parts, self.own = tag, up, [], own
        self.kind = 1 << _kind[tag] if tag in _kind else 0
        self.depth, self.above, self.kinds = (parent.depth + 1, parent.own | parent.above, parent.kind | parent.kinds) if parent else (0, 0, 0)
        self.chars = self.linked = self.tags = self.commas = self.inputs = self.words = 0


def groups_of(attributes: str) -> int:
    """Token groups that the naming attributes of an element speak of, as bits."""
    found = 0
    for m in _attr.finditer(attributes):
        for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()):
            for k in _group.get(w, ()):
                found |= 1 << k
    return found


def tokens(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, tag, attributes) of each piece of markup; tag is empty for comments and declarations.

    The reader of the tokens may send a place to go on from. Each character is looked at a
    bounded number of times: a quote that never closes is remembered and is a character like
    any other, and once quotes have hidden the end of a tag up to the end of the page, tags
    end at their first ``>``.
    """
    at, n, quoted, unclosed = 0, len(html), True, set()
    while m := _start.search(html, at):
        start, tag = m.start(), (m[2] or "").lower()
        if not tag:
            comment = html.startswith("<!--", start)
            end = html.find("-->" if comment else ">", m.end())
            if end < 0 and not comment:
                return
            at = n if end < 0 else end + (3 if comment else 1)
        else:
            spot, end = m.end(), -1
            while quoted and (hit := _stop.search(html, spot)):
                spot = hit.end()
                if hit[0] == ">":
                    end = hit.start()
                    break
                if hit[0] not in unclosed and html[max(m.end(), spot - 9) : spot - 1].rstrip().endswith("="):
                    close = html.find(hit[0], spot)
                    if close < 0:
                        unclosed.add(hit[0])
                    else:
                        spot = close + 1
            if end < 0:
                quoted, end = False, html.find(">", m.end())
                if end < 0:
                    return
            at = end + 1
        to = yield start, at, bool(m[1]), tag, html[m.end() : at - 1] if tag else ""
        if to is not None:
            at = to


def parse(html: str | None) -> list[Node]:
    """Block elements in page order, so that a subtree is a run of them. A node's ``parts`` are (position, raw text) directly in it; inline elements are transparent.

    Time is linear in the page: what is open is also kept by name, and every element is
    opened and closed once.
    """
    html = html or ""
    root = Node("#page", -1, None, 0)
    nodes, block, silent, links, at = [root], 0, 0, 0, 0
    open_tags: list[tuple[str, int]] = []  # (tag, the block that it opened or -1)
    places: dict[str, list[int]] = {}  # where each tag stands in open_tags
    blocks: list[int] = []  # where blocks stand in open_tags
    loose = -1  # block of the text outside any block, up to the next block

    def push(tag: str, opened: int) -> None:
        nonlocal silent, links
        places.setdefault(tag, []).append(len(open_tags))
        if opened >= 0:
            blocks.append(len(open_tags))
        silent, links = silent + (tag in SILENT), links + (tag == "a")
        open_tags.append((tag, opened))

    def close_from(k: int) -> None:
        """Everything from place k on ends."""
        nonlocal silent, links, block
        while len(open_tags) > k:
            tag, opened = open_tags.pop()
            places[tag].pop()
            silent, links = silent - (tag in SILENT), links - (tag == "a")
            if opened >= 0:
                blocks.pop()
                block = nodes[opened].up

    def end_head() -> None:
        """What cannot stand in an open head ends it."""
        if places.get("head"):
            close_from(places["head"][0])

    def here() -> Node:
        return nodes[loose if block == 0 and loose >= 0 else block]

    def text(upto: int) -> None:
        nonlocal loose
        if upto <= at:
            return
        piece = html[at:upto]
        if silent and open_tags[-1][0] == "head" and not piece.isspace():
            end_head()
        if not silent:
            if block == 0 and loose < 0 and not piece.isspace():
                loose = len(nodes)
                nodes.append(Node("#text", 0, root, 0))
            own = here()
            own.parts.append((at, piece))
            n = len(piece.strip())
            own.chars += n
            own.linked += n if links else 0
            own.commas += piece.count(",") + piece.count(".")
            own.words += piece.count(" ")

    def ended_by(tag: str) -> bool:
        return bool(open_tags) and (open_tags[-1][0] == "p" or tag in _closes and any(t in _closes[tag] for t, _ in open_tags[-4:]) and open_tags[-1][0] not in _scope)

    found, to = tokens(html), None
    while True:
        try:
            start, end, closing, tag, attributes = found.send(to)
        except StopIteration:
            break
        to = None
        text(start)
        at = end
        if not tag:
            continue
        if closing:
            k = places[tag][-1] if places.get(tag) else -1
            if k >= 0 and (tag in BLOCK or not blocks or blocks[-1] <= k):
                close_from(k)
            continue
        if silent and tag not in IN_HEAD:
            end_head()
        if tag in VOID:
            nodes[block].inputs += tag == "input"
            if tag in ("br", "hr") and not silent:
                here().parts.append((start, " "))
        elif tag in _raw and tag in SILENT:  # its content is not markup
            last = _raw[tag].search(html, at)
            close = html.find(">", last.end()) if last else -1
            at = to = len(html) if close < 0 else close + 1
        elif attributes.endswith("/") and tag not in BLOCK:
            pass
        elif tag in BLOCK:
            while ended_by(tag):
                last = open_tags[-1][0]
                close_from(len(open_tags) - 1)
                if last in _closes.get(tag, ()):
                    break
            if tag == "p" and places.get("p") and blocks[-1] == places["p"][-1]:  # inline elements left open in a paragraph end with it
                close_from(places["p"][-1])
            nodes.append(Node(tag, block, nodes[block], groups_of(attributes)))
            block, loose = len(nodes) - 1, -1
            push(tag, block)
        else:
            nodes[block].inputs += tag in ("button", "select")
            nodes[block].tags += 1
            push(tag, -1)
    text(len(html))
    return nodes


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row a node. A subtree is a run of nodes, so its sums are differences of running totals."""
    n = len(nodes)
    up = np.array([x.up for x in nodes])
    size = [1] * n
    for i in range(n - 1, 0, -1):
        size[nodes[i].up] += size[i]
    base = np.array([(x.chars, x.linked, x.tags + 1, x.commas, x.tag == "p", x.inputs, x.words) for x in nodes], float)
    running = np.concatenate([np.zeros((1, 7)), np.cumsum(base, axis=0)])
    total = running[np.arange(n) + size] - running[:n]
    kids, alike = [0] * n, {}  # children of a node, and those of one name
    spot, before, after = [0] * n, [-1] * n, [-1] * n
    latest = [-1] * n
    for i in range(1, n):
        p = nodes[i].up
        spot[i], before[i] = kids[p], latest[p]
        if latest[p] >= 0:
            after[latest[p]] = i
        latest[p] = i
        kids[p] += 1
        alike[p, nodes[i].tag] = alike.get((p, nodes[i].tag), 0) + 1
    family = np.array([1] + [kids[x.up] for x in nodes[1:]])
    same = np.array([1] + [alike[x.up, x.tag] for x in nodes[1:]])
    spot, before, after = np.array(spot), np.array(before), np.array(after)
    bits = lambda name, k: np.array([getattr(x, name) for x in nodes])[:, None] >> np.arange(k) & 1
    kind, kinds, own, above = bits("kind", len(KINDS)), bits("kinds", len(KINDS)), bits("own", len(GROUPS)), bits("above", len(GROUPS))
    aside = sorted(ASIDES)
    against = own[:, 1:].any(axis=1) | kind[:, aside].any(axis=1)  # attribute or element names that speak against a node
    against_above = above[:, 1:].any(axis=1) | kinds[:, aside].any(axis=1)
    for_it = (own[:, 0] | above[:, 0] | kind[:, 0] | kinds[:, 0]) > 0
    chars, linked, tags, commas, paras, inputs, words = total.T
    beside = lambda place: np.where(place >= 0, np.log1p(chars[place]), -1)
    single = np.stack([
        against, against_above, for_it, [x.depth for x in nodes], spot, family, np.where(family < 200, same, family), spot / family, np.log1p(chars), np.log1p(base[:, 0]), linked / (chars + 1), chars / tags, commas / (words + 1), np.log1p(paras), inputs, chars / (chars[0] + 1), kids, beside(before), beside(after),
    ], axis=1)
    return np.concatenate([kind, kinds, own, above, single], axis=1).astype(np.float32)


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """The likeliest labels under which a node is kept only if its parent is. The page itself is kept."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p).tolist(), np.log(1 - p).tolist()
    kept = [False] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        kept[i] = keep[i] > drop[i]
        if i:
            keep[nodes[i].up] += max(keep[i], drop[i])
            drop[nodes[i].up] += drop[i]
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[i] and kept[nodes[i].up]
    return kept


def joined(nodes: list[Node], kept: list[bool]) -> str:
    """Kept text: runs of one block become one piece; pieces in page order with one space between."""
    parts = sorted((spot, i, raw) for i, n in enumerate(nodes) if i and kept[i] for spot, raw in n.parts)
    pieces, last = [], None
    for _, i, raw in parts:
        if i == last:
            pieces[-1].append(raw)
        else:
            pieces.append([raw])
            last = i
    return " ".join(x for x in (" ".join(entities.unescape("".join(raw)).split()) for raw in pieces) if x)


def gold(nodes: list[Node]) -> list[bool] | None:
    """Labels by semantic elements: inside <article> or <main> and in nothing marked as something else; None without one."""
    if not any(n.tag in ("article", "main") for n in nodes):
        return None
    barred = sum(1 << GROUPS.index(g) for g in ("menu", "side", "ads", "note", "talk", "form", "more", "foot"))
    inside, out = [], []
    for n in nodes:
        bad = n.tag in ("nav", "header", "footer", "aside", "form", "dialog") or bool(n.own & barred) and n.tag not in ("article", "main")
        up = inside[n.up] if n.up >= 0 else (False, False)
        inside.append((up[0] or n.tag in ("article", "main"), up[1] or bad))
        out.append(inside[-1][0] and not inside[-1][1] or n.tag in ("#page", "html", "body"))
    # wrappers of an article are kept too: dropping one would drop the article
    for i in range(len(nodes) - 1, 0, -1):
        out[nodes[i].up] |= out[i]
    return out


def templates(pieces: list[str], heads: str, rng: random.Random, copies: int) -> Iterator[tuple[np.ndarray, list[bool]]]:
    """(features, labels) of a page's own text set in drawn templates; labels come from markers in the template."""
    esc = entities.escape

    def prose(k: int) -> list[str]:
        return [esc(rng.choice(pieces))[: rng.randint(40, 900)] for _ in range(k)] if pieces else ["text"] * k

    def named(group: str, tag: str) -> str:
        words = TOKENS[group].split()
        style = rng.random()
        noise = rng.choice(["", " wide", " clearfix", " col-8", " x1", " inner", " dark"])
        return f'<{tag} class="{rng.choice(words)}{noise}">' if style < 0.6 else f'<{tag} id="{rng.choice(words)}{rng.choice(["", "-1", "-box", "_wrap"])}">' if style < 0.85 else f'<{tag} class="{rng.choice(words)}-{rng.choice(["list", "area", "inner", "block", "container"])}">'

    def junk() -> str:
        kind = rng.choice(["menu", "head", "foot", "side", "ads", "note", "talk", "form", "more"])
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "talk": "section"}.get(kind, "div")
        start = f"<{tag}>" if kind not in ("talk", "ads", "note", "more") and rng.random() < 0.3 else named(kind, tag if rng.random() < 0.5 else rng.choice(["div", "section", "div", "ul" if kind == "menu" else "div"]))
        tag = re.match(r"<(\w+)", start)[1]
        if kind == "menu" or tag == "ul" or kind in ("more", "foot") and rng.random() < 0.5:
            inner = "".join(f'<li><a href="/{i}">{esc(w)}</a></li>' for i, w in enumerate(prose(1)[0].split()[: rng.randint(2, 9)]))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f'<p>{prose(1)[0][:80]}</p><label>{prose(1)[0][:20]}</label><input name="q"><button>ok</button>'
        elif kind == "talk":
            inner = rng.choice(["<h3>Comments</h3>", ""]) + "".join(f'<div class="comment"><p>{x}</p></div>' if rng.random() < 0.6 else f"<p>{x}</p>" for x in prose(rng.randint(1, 5)))
        elif kind == "side":
            inner = "".join(f"{heading(x)}<p>{x[: rng.choice([40, 200, 900])]}</p>" for x in prose(rng.randint(1, 3)))
        else:
            inner = rng.choice(["<p>{}</p>", "{}", "<span>{}</span>"]).format(prose(1)[0][: rng.choice([60, 150, 400])])
        return f"{start}{inner}</{tag}>"

    def heading(text: str) -> str:
        tag = rng.choice(["h2", "h2", "h3", "h4"])
        return f"<{tag}>{text[: rng.randint(3, 60)]}</{tag}>"

    for _ in range(copies):
        body = [f"<h1>{heads[: rng.randint(3, 60)]}</h1>"] if rng.random() < 0.8 else []
        for x in prose(rng.randint(1, 8)):
            r = rng.random()
            body.append(f"<p>{x[: rng.choice([15, 90, 900])]}</p>" if r < 0.75 else heading(x) if r < 0.85 else f"<blockquote>{x}</blockquote>" if r < 0.9 else f"<ul><li>{x}</li><li>{x[:60]}</li></ul>" if r < 0.96 else f"<div>{x}</div>")
        for _ in range(rng.choice([0, 0, 1, 2])):
            body.insert(rng.randint(0, len(body)), f"<junk>{junk()}</junk>")
        tag = rng.choice(["article", "main", "div", "div", "section"])
        start = f"<{tag}>" if tag in ("article", "main") and rng.random() < 0.6 else named("main", tag)
        core = f"{start}{''.join(body)}</{tag}>"
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            inside = core + "".join(f"<junk>{junk()}</junk>" for _ in range(rng.choice([0, 0, 1])))
            core = rng.choice(["<div>{}</div>", '<div class="wrapper">{}</div>', '<div id="page">{}</div>', "<main>{}</main>"]).format(inside)
        page = "".join(f"<junk>{junk()}</junk>" for _ in range(rng.randint(1, 4))) + core + "".join(f"<junk>{junk()}</junk>" for _ in range(rng.randint(1, 4)))
        nodes = parse(f"<html><body>{page.replace('<junk>', '<!--j-->').replace('</junk>', '<!--/j-->')}</body></html>")
        spans, low = [], f"<html><body>{page.replace('<junk>', '<!--j-->').replace('</junk>', '<!--/j-->')}</body></html>"
        opened = []
        for m in re.finditer(r"<!--(/?)j-->", low):
            if m[1]:
                spans.append((opened.pop(), m.start()))
            else:
                opened.append(m.start())
        core_at = low.find(core.replace("<junk>", "<!--j-->").replace("</junk>", "<!--/j-->"))
        core_end = core_at + len(core.replace("<junk>", "<!--j-->").replace("</junk>", "<!--/j-->"))
        first = first_spots(nodes)
        labels = [n.tag in ("#page", "html", "body") or core_at <= s < core_end and not any(a <= s < b for a, b in spans) for n, s in zip(nodes, first)]
        yield node_features(nodes), labels
    for page in (prose(1)[0], f"<b>{prose(1)[0][:40]}</b> {prose(1)[0]}"):  # text without blocks
        nodes = parse(page)
        yield node_features(nodes), [True] * len(nodes)


def first_spots(nodes: list[Node]) -> list[int]:
    """Where the first text at or below each node stands."""
    spots = [min((s for s, _ in n.parts), default=1 << 60) for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        spots[nodes[i].up] = min(spots[nodes[i].up], spots[i])
    return spots


def training_rows(pages: Iterator[pd.DataFrame], copies: int) -> Iterator[pd.DataFrame]:
    for batch in pages:
        x, y = [], []
        for key, html in zip(batch["page_id"], batch["html"]):
            nodes = parse(html)
            labels = gold(nodes)
            if labels is not None:
                x.append(node_features(nodes))
                y += labels
            pieces = [" ".join(entities.unescape("".join(r for _, r in n.parts)).split()) for n in nodes]
            pieces = [p for p in pieces if len(p) > 20]
            rng = random.Random(f"{key}")
            for f, own in templates(pieces, entities.escape(pieces[0][:60]) if pieces else "", rng, copies):
                x.append(f)
                y += own
        if x:
            flat = np.concatenate(x)
            yield pd.DataFrame({"x": list(flat.astype(float)), "label": np.array(y, float)})


def fit(pages: DataFrame, sample: int = 240, copies: int = 6, rounds: int = 20, depth: int = 5) -> list[tuple[np.ndarray, ...]]:
    """Trees over nodes of at most ``sample`` pages (page_id, html); without nodes of both kinds, no trees."""
    chosen = pages.where("html IS NOT NULL AND page_id IS NOT NULL").select("page_id", F.xxhash64("page_id").alias("h")).orderBy("h").limit(sample)
    held = pages.select("page_id", "html").join(F.broadcast(chosen.select("page_id").distinct()), "page_id")
    held = held.groupBy("page_id").agg(F.min_by("html", F.xxhash64("html")).alias("html"))  # one row an id
    rows = held.repartition(6, "page_id").mapInPandas(lambda b: training_rows(b, copies), "x array<double>, label double").select("label", array_to_vector("x").alias("features")).cache()
    try:
        if rows.select("label").distinct().count() < 2:
            return []
        return arrays(GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=5, checkpointInterval=-1).fit(rows))
    finally:
        rows.unpersist()


def extract(html: Column, trees: list[tuple[np.ndarray, ...]]) -> Column:
    """The main text of each page."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), 256):
                parsed = [parse(h) for h in batch.iloc[at : at + 256]]
                p = probability(trees, np.concatenate([node_features(n) for n in parsed])) if trees else np.ones(sum(map(len, parsed)))
                for nodes, own in zip(parsed, np.split(p, np.cumsum([len(n) for n in parsed])[:-1])):
                    out.append(joined(nodes, decode(nodes, own)))
            yield pd.Series(out, dtype=object)

    return texts(html)


def main_text(pages: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages`` (page_id, url, html)."""
    trees = fit(training if training is not None else pages)
    return pages.select("page_id", "url", extract(F.col("html"), trees).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
