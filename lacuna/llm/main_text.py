"""Main text of web pages: a minimum cut between content and boilerplate.

A classifier's odds for each block of text are capacities of the edges to the two terminals; blocks that follow each other, or
follow each other within one element, are joined by edges that weigh more the nearer the blocks are in the document's tree.
The minimum cut, by maximum flow, labels the blocks. The classifier is a logistic regression fitted here, on a
fixed number of pages that html_samples writes with known labels.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lacuna.llm.common import ship, text_slices
from lacuna.llm.html_blocks import Page, parse

#: How many written pages the classifier is fitted on.
SAMPLE_PAGES = 800
#: Weight of an edge between blocks of one element, and what each step up the tree leaves of it.
SMOOTH, STEP = 1.0, 0.6
#: Odds are held between these, so that no block is out of its neighbours' reach.
MOST = 6.0

# Words in classes, ids and roles, and tags, that tell what an element is for.
KINDS = {
    "nav": "nav navbar navigation navigations menu menus breadcrumb breadcrumbs pagination pager paging toc skip skiplink tabs",
    "header": "header masthead banner topbar top branding logo",
    "footer": "footer foot bottom colophon copyright legal imprint contentinfo credits",
    "side": "sidebar side aside rail widget widgets complementary column2",
    "ad": "ad ads adv advert adverts advertisement advertising adbox adsbox adslot sponsor sponsored sponsors promo promos promotion promotions promoted teaser teasers partner partners marketing dfp",
    "notice": "notice notices cookie cookies consent gdpr privacy alert alerts dialog modal popup overlay toast warning subscribe subscription newsletter paywall disclaimer announcement",
    "comment": "comment comments commentlist commentary discussion discussions disqus reply replies respond responses reaction reactions guestbook",
    "share": "share sharing social follow related recommended recommendations recommend more popular trending latest tags tagcloud meta authorbox bio tools toolbar print rating",
    "form": "form search searchbox searchform login signin signup register contact subscribeform poll survey",
    "body": "article content entry post story body text main prose maintext articlebody articletext",
}
TAGS = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice", "search": "form", "article": "article", "main": "article", "address": "footer"}
NOTICE_WORDS = ("©", "cookie", "copyright", "all rights reserved", "privacy", "newsletter", "subscribe", "advertisement", "sponsored", "log in", "sign in", "sign up", "javascript", "terms of use")

_FLAGS = [*KINDS, "article", "tag_header", "hidden"]
_BIT = {x: 1 << i for i, x in enumerate(_FLAGS)}
_OF_WORD = {w: _BIT[kind] for kind, words in KINDS.items() for w in words.split()}
_AGAINST = sum(_BIT[x] for x in ("nav", "side", "ad", "notice", "comment", "share", "form"))
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+", re.A)
_PIECES = frozenset("p li h1 h2 h3 h4 h5 h6 td th dd dt blockquote pre".split())
_ENDS = tuple(".!?…。！？:;\"'”»)")


@lru_cache(65536)
def _named(names: str) -> int:
    found = 0
    for word in _WORD.findall(names):
        found |= _OF_WORD.get(word.lower(), 0)
    whole = names.lower()
    for part in whole.split():
        found |= _OF_WORD.get(part.replace("-", "").replace("_", ""), 0)
    if found & _BIT["body"]:
        # entry-header, post-footer: parts of an article; comment-body, sidebar-content: none
        found &= ~(_BIT["body"] if found & _AGAINST else _BIT["header"] | _BIT["footer"])
    return found


def flags(page: Page) -> list[int]:
    """For each element what it and those that hold it are for."""
    own = []
    for tag, names in zip(page.tags, page.names):
        found = _named(names) if names else 0
        kind = TAGS.get(tag)
        if kind:
            found |= _BIT[kind]
            if kind == "header":
                found |= _BIT["tag_header"]
        own.append(found)
    # an element that holds the article is not the menu or the advert that its name may speak of
    sizes = [0] * len(own)
    for text, owner in zip(page.texts, page.owners):
        sizes[owner] += len(text)
    for k in range(len(own) - 1, 0, -1):
        sizes[page.parents[k]] += sizes[k]
    total = max(1, sizes[0])
    # what an element holds: 1 an article of much of the page, 2 one with a title, or the main element
    holds, titled = [0] * len(own), [False] * len(own)
    for k in range(len(own) - 1, 0, -1):
        up, inside = page.parents[k], holds[k]
        if own[k] & _BIT["article"] and not own[k] & _AGAINST:
            inside = 2 if titled[k] or page.tags[k] == "main" else max(inside, int(5 * sizes[k] > 2 * total))
        holds[up] = max(holds[up], inside)
        titled[up] = titled[up] or titled[k] or page.tags[k] == "h1"
    out = [0] * len(own)
    for k in range(1, len(own)):
        mine, above = own[k], out[page.parents[k]]
        if holds[k] or page.tags[k] == "form" and 2 * sizes[k] > total:
            # comments, too, may be articles
            mine &= _BIT["body"] | _BIT["article"] | (_BIT["comment"] if holds[k] < 2 else 0)
        if above & _BIT["article"] and page.tags[k] == "header":
            mine &= ~(_BIT["header"] | _BIT["tag_header"])
        if page.hidden[k]:
            mine |= _BIT["hidden"]
        out[k] = above | mine
    return out


def features(page: Page) -> np.ndarray:
    """A row for each block."""
    n = len(page.texts)
    if not n:
        return np.zeros((0, len(FEATURES)))
    kinds = flags(page)
    bits = np.array([kinds[k] for k in page.owners], np.int64)
    flag = {x: (bits & b > 0).astype(float) for x, b in _BIT.items()}
    chars = np.array([len(t) for t in page.texts], float)
    words = np.array([t.count(" ") + 1 for t in page.texts], float)
    share = np.array(page.linked, float) / chars
    tags = [page.tags[k] for k in page.owners]
    is_ = lambda *names: np.array([t in names for t in tags], float)
    up = np.array([page.parents[k] if page.tags[k] in _PIECES or page.tags[k] == "div" and not page.names[k] else k for k in page.owners])
    around = np.bincount(up, chars, len(page.tags))[up]
    around_linked = np.bincount(up, np.array(page.linked, float), len(page.tags))[up] / around
    paragraphs = np.bincount(up, is_("p") * (words > 12), len(page.tags))[up]
    place = np.arange(n) / max(1, n - 1)
    size, big = np.log1p(words), np.log1p(around)
    before, after = np.concatenate([[0], size[:-1]]), np.concatenate([size[1:], [0]])
    against = np.minimum(1, flag["nav"] + flag["side"] + flag["ad"] + flag["notice"] + flag["comment"] + flag["share"] + flag["form"])
    inside = flag["article"] * (1 - against)
    apart = float(inside.any()) * (1 - flag["article"])
    body = flag["body"] * (1 - against)
    outside = float(body.any()) * (1 - flag["body"]) * (1 - inside)
    # pieces of an article stand in the element that is the article; what is put among them mostly has one of its own
    named = np.array([bool((_named(x) if x else 0) & _BIT["body"]) or t in ("article", "main") for x, t in zip(page.names, page.tags)])
    direct = named[up] * np.maximum(inside, body)
    short = words < 40
    told = np.array([float(s and any(w in t.lower() for w in NOTICE_WORDS)) for s, t in zip(short, page.texts)])
    ends = np.array([t.endswith(_ENDS) for t in page.texts], float)
    columns = [np.ones(n), flag["nav"], flag["header"], flag["footer"], flag["side"], flag["ad"], flag["notice"], flag["comment"], flag["share"], flag["form"], body, inside, apart, outside, direct, flag["tag_header"]]
    columns += [is_("p"), is_("h1"), is_("h2", "h3", "h4", "h5", "h6"), is_("li"), is_("td", "th"), is_("div", "section"), is_("blockquote", "pre", "figcaption")]
    columns += [size / 3, share, (share > 0.9).astype(float), share * is_("li"), ends, told, place * (1 - direct), (place == 0) * (1 - direct), before / 3, after / 3, big * (1 - direct) / 5, around_linked, np.minimum(paragraphs, 5) / 5, (up == 0).astype(float)]
    return np.stack(columns, 1)


FEATURES = "one nav header footer side ad notice comment share form body inside apart outside direct tag_header p h1 h2 li td div quote words linked all_linked linked_item ends told place first before after around around_linked paragraphs bare".split()


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


@lru_cache
def classifier(pages: int = SAMPLE_PAGES) -> tuple[float, ...]:
    """The weights of FEATURES, fitted on so many pages of html_samples. Seconds, once in a process."""
    from lacuna.llm.html_samples import labelled_pages

    xs, ys = [], []
    for html, labels in labelled_pages(pages, seed=1):
        page = parse(html)
        xs.append(features(page))
        ys.append(np.array([labels.get(t, False) for t in page.texts], float))
    return tuple(fit(np.concatenate(xs), np.concatenate(ys)).tolist())


def edges(page: Page) -> list[tuple[int, int, float]]:
    """(block, later block, weight): each block and the next one, and the last one before it in the same element's children."""
    out, last, depth = [], {}, [0] * len(page.tags)
    for k in range(1, len(page.tags)):
        depth[k] = depth[page.parents[k]] + 1
    for i, owner in enumerate(page.owners):
        if i:
            a, b, steps = page.owners[i - 1], owner, 0
            # further steps weigh nothing that could turn a label
            while a != b and steps < 12:
                if depth[a] >= depth[b]:
                    a = page.parents[a]
                else:
                    b = page.parents[b]
                steps += 1
            if a == b:
                out.append((i - 1, i, SMOOTH * STEP ** max(0, steps - 2)))
        up = page.parents[owner] if owner else 0
        j = last.get(up)
        if j is not None and j < i - 1:
            out.append((j, i, SMOOTH * STEP))
        last[up] = i
    return out


def minimum_cut(odds: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut: odds above 0 are capacities from the source, below 0 to the
    sink; joined: edges of both directions.

    A node whose odds outweigh all its edges has its label whatever the others have; it is taken out and its edges become its
    neighbours' odds. What remains is cut by maximum flow, in blocking flows along shortest paths.
    """
    n = len(odds)
    u, near = list(odds), [{} for _ in range(n)]
    for a, b, w in joined:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    total = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(u[i]) < total[i]:
            continue
        label[i] = u[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                u[j] += w if label[i] else -w
                total[j] -= w
                todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    number = {i: k for k, i in enumerate(rest)}
    m = len(rest)
    source, sink = m, m + 1
    graph: list[list[list]] = [[] for _ in range(m + 2)]  # [to, capacity, place of the edge back]

    def join(a: int, b: int, there: float, back: float) -> None:
        graph[a].append([b, there, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for i in rest:
        k = number[i]
        if u[i] > 0:
            join(source, k, u[i], 0.0)
        elif u[i] < 0:
            join(k, sink, -u[i], 0.0)
        for j, w in near[i].items():
            if j > i and j in number:
                join(k, number[j], w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (m + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, capacity, _ in graph[a]:
                if capacity > tiny and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[sink] < 0:
            break
        at, path = [0] * (m + 2), []
        here = source
        while True:
            if here == sink:
                pushed = min(graph[a][k][1] for a, k in path)
                cut = None
                for place, (a, k) in enumerate(path):
                    edge = graph[a][k]
                    edge[1] -= pushed
                    graph[edge[0]][edge[2]][1] += pushed
                    if cut is None and edge[1] <= tiny:
                        cut = place
                here = path[cut][0]
                del path[cut:]
                continue
            out = graph[here]
            while at[here] < len(out):
                b, capacity, _ = out[at[here]]
                if capacity > tiny and level[b] == level[here] + 1:
                    break
                at[here] += 1
            if at[here] < len(out):
                path.append((here, at[here]))
                here = out[at[here]][0]
            elif path:
                here, _ = path.pop()
                at[here] += 1
            else:
                break
    for i in rest:
        label[i] = level[number[i]] >= 0
    return label


def labelled(html: str | None, weights: np.ndarray) -> list[tuple[str, bool]]:
    """The page's blocks, and whether each is content. What is hidden is none."""
    page = parse(html or "")
    if not page.texts:
        return []
    kinds = flags(page)
    odds = np.clip(features(page) @ weights, -MOST, MOST).tolist()
    unseen = [bool(kinds[k] & _BIT["hidden"]) for k in page.owners]
    # hidden blocks are the sink's, whatever stands around them
    kept = minimum_cut([-1e9 if x else o for o, x in zip(odds, unseen)], edges(page))
    return list(zip(page.texts, kept))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Per row of pages: id_col, url_col, text (the content's blocks, joined by an empty line), n_chars (code points).

    A null or empty page, and one of boilerplate alone, has an empty text. Repeated rows and null ids are rows like others.
    Other columns are not read. Pages are read whole, where they lie: no shuffle. Empty tables give none.
    """
    ship(pages.sparkSession)
    weights = np.array(classifier(sample_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, htmls in text_slices(batch, 2):
                texts = ["\n\n".join(t for t, kept in labelled(x, weights) if kept) for x in htmls]
                rows = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    found = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
    return found.toDF(id_col, url_col, "text", "n_chars")
