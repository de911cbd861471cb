"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags.  A logistic classifier over what
stands around a block (elements, roles, class and id words, container, links, length)
gives its log-odds of being content, which are its capacity to one of the two terminals.
Neighbouring blocks, and blocks under the same parent, are tied by smoothness edges.  The
cheapest cut (maximum flow) labels all blocks of the page.

The classifier's weights are fitted on the corpus itself, on at most ``FIT_PAGES`` pages,
around a prior.  Nobody labels blocks; seeds are those that show what they are without
their markup: text that stands on pages with different main text is boilerplate, long
unlinked sentences that stand on one are content.  Readers' comments look like content
that way and are no seeds, so their weight is the prior's.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textbytes import hash_bytes

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: what stands in a tag after its name: quotes count where a value begins; possessive, so that
#: a tag that never ends is read once
_INSIDE = r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^<>])*+"
#: what holds no markup and so goes on to its end, or to the body or the end of the page
RAW = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(script|style)\b" + _INSIDE + r">.*?(?:</\1\s*>|(?=<body\b)|$)", re.I | re.S)
#: elements whose content is never text of the page
DROPPED = frozenset("noscript template svg iframe object select textarea button canvas audio video title".split())
#: elements that don't end the page's head, or a title in it that isn't closed
HEAD = frozenset("html head base link meta title style script noscript template".split())
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(" + _INSIDE + r")>|<[!?][^>]*>")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden|itemprop|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
#: an element that starts closes these open ones
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"form"}}

#: what surrounds a block, as bits
NAVIGATION, ADVERT, NOTICE, COMMENT, HEADER, INSIDE = (1 << i for i in range(6))
TAGS = dict.fromkeys("nav footer aside menu".split(), NAVIGATION) | dict.fromkeys("form dialog fieldset legend".split(), NOTICE)
ROLES = dict.fromkeys("navigation banner contentinfo complementary menu menubar toolbar".split(), NAVIGATION) | dict.fromkeys("search form dialog alertdialog alert status note".split(), NOTICE)
WORDS = (
    dict.fromkeys("nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer footers foot masthead topbar toolbar pagination pager tagcloud skip share sharing social follow related recommended recommendations trending popular banner".split(), NAVIGATION)
    | dict.fromkeys("ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos promoted promotion".split(), ADVERT)
    | dict.fromkeys("cookie cookies consent gdpr notice notices alert alerts disclaimer popup modal overlay newsletter subscribe subscription signup login signin register search searchbox copyright legal hidden form".split(), NOTICE)
    | dict.fromkeys("comment comments commentlist disqus reply replies respond discussion feedback rating".split(), COMMENT)
)
GOOD_TAGS = frozenset(("article", "main"))
GOOD_WORDS = frozenset("article content main post entry story body text prose".split())

#: ties of neighbours and of blocks under one parent, for blocks in like surroundings; others have a quarter
ADJACENT, SIBLING = 0.8, 1.6
#: what the classifier weighs, and the prior of the weights; the last four count on pages without a container
PRIOR = {"bias": -0.6, "navigation": -6.0, "advert": -6.0, "notice": -6.0, "comment": -6.0, "header": -6.0, "inside": 3.6, "outside": -2.4, "linked": -3.0, "length": 1.0, "sentence": 0.5, "paragraph": 1.2, "cell": -0.8}
#: how many seeds the prior weighs, pages that are fitted on, and pages that boilerplate stands on
PRIOR_SEEDS, FIT_PAGES, REPEATED = 20.0, 5_000, 3
#: words of a block: of repeated ones at most, of content seeds at least
SEED_AT_MOST, SEED_AT_LEAST = 30, 20


def _context(tag: str, attributes: str, outer: int) -> int:
    """The surroundings of what stands in an element."""
    out = outer | TAGS.get(tag, 0)
    inside = outer & INSIDE
    if tag == "header" and not inside:
        out |= HEADER
    if tag in GOOD_TAGS:
        out |= INSIDE
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = a or b or c
            name = name.lower()
            if name in ("class", "id"):
                found = {w.lower() for w in WORD.findall(value)}
                bad = 0
                if tag not in ("body", "html", "article", "main"):
                    for w in found:
                        bad |= WORDS.get(w, 0)
                fine = found & GOOD_WORDS
                if bad:
                    out |= bad
                elif "header" in found and not fine and not inside and tag not in ("body", "html"):
                    out |= HEADER
                elif fine and tag not in ("body", "html"):
                    out |= INSIDE
            elif name == "role":
                out |= ROLES.get(value.lower(), 0)
                if value.lower() in ("main", "article"):
                    out |= INSIDE
            elif name == "itemprop" and value.lower() == "articlebody":
                out |= INSIDE
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out |= NOTICE
    return out


def _closed(tags: list[re.Match]) -> dict[int, int]:
    """Where dropped elements that have an end tag begin and end."""
    opened: dict[str, list[int]] = {}
    out = {}
    for m in tags:
        tag = (m[2] or "").lower()
        if tag in DROPPED:
            if not m[1]:
                if tag == "svg" and m[0].endswith("/>"):
                    out[m.start()] = m.end()
                else:
                    opened.setdefault(tag, []).append(m.start())
            elif opened.get(tag):
                out[opened[tag].pop()] = m.end()
    return out


def blocks(page: str) -> list[tuple[str, int, str, float, int]]:
    """(text, surroundings, element, share of it in links, parent) of the blocks in page order."""
    page = RAW.sub(" ", page)
    out = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    opened: Counter[str] = Counter()
    count, links = 0, 0
    text: list[str] = []
    linked = 0
    hidden = False
    tags = list(TAG.finditer(page))
    closed = _closed(tags)

    def flush() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            plain = " ".join(html.unescape(raw).split())
            if plain:
                k = len(stack) - 1
                while k and stack[k][0] not in BLOCKS:
                    k -= 1
                tag, around, _ = stack[k]
                parent = stack[k - 1][2] if k else 0
                out.append((plain, around, tag, min(1.0, linked / max(1, len(raw))), parent))
            text.clear()
        linked = 0

    def end(k: int) -> None:
        nonlocal links, hidden
        for x in stack[k:]:
            opened[x[0]] -= 1
            links -= x[0] == "a"
        del stack[k:]
        hidden = hidden and any(x[0] in DROPPED or x[0] == "head" for x in stack)

    def end_head() -> None:
        for k in range(1, len(stack)):
            if stack[k][0] in ("head", "title"):
                return end(k)

    def add(part: str) -> None:
        nonlocal linked
        if hidden and stack[-1][0] == "head" and not head_closed and part.strip():
            end_head()
        if not hidden:
            text.append(part)
            if links:
                linked += len(part)

    head_closed = any(m[1] and m[2].lower() == "head" for m in tags if m[2])
    at = 0
    for m in tags:
        if m.start() < at:  # in an element that is dropped whole
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if hidden and not m[1] and tag not in HEAD:
            end_head()
        if tag in DROPPED and not m[1]:
            if m.start() in closed:
                at = closed[m.start()]
                text.append(" ")
            else:  # ends with what holds it
                stack.append((tag, stack[-1][1], stack[-1][2]))
                opened[tag] += 1
                hidden = True
            continue
        if tag == "head" and not m[1]:
            stack.append((tag, stack[-1][1], stack[-1][2]))
            opened[tag] += 1
            hidden = True
            continue
        if tag == "br":
            text.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k][0] == tag:
                    end(k)
                    break
            continue
        if tag in VOID:
            continue
        if block and (opened["p"] > 0 or any(opened[x] > 0 for x in CLOSES.get(tag, ()))):
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0]
                if name == "p" or name in CLOSES.get(tag, ()):
                    end(k)
                    if name != "p":
                        break
                elif name in HOLDS.get(tag, ()) or name in BLOCKS and tag not in CLOSES:
                    break
        count += 1
        stack.append((tag, _context(tag, m[3], stack[-1][1]), count))
        opened[tag] += 1
        links += tag == "a"
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _features(found: list[tuple]) -> list[tuple[float, ...]]:
    """What the classifier weighs, for each block of a page; few different values each."""
    container = any(around & INSIDE and not around & ~INSIDE for _, around, *_ in found)
    out = []
    for text, around, tag, linked, _ in found:
        words = text.count(" ") + 1
        free = 0.0 if container else 1.0
        inside = bool(around & INSIDE)
        out.append((
            1.0, *(float(bool(around & bit)) for bit in (NAVIGATION, ADVERT, NOTICE, COMMENT, HEADER)), float(container and inside), float(container and not inside), round(linked * 8) / 8,
            free * min(30, words) // 2 / 6, free * (text[-1] in ".!?:\"'”»…"), free * (tag in ("p", "pre", "blockquote", "h1", "h2", "h3")), free * (tag in ("li", "td", "th", "option", "dd", "dt") and words < 6),
        ))
    return out


def minimum_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the content side of the cheapest cut; a node that it leaves
    open is content."""
    n = len(lean)
    source, sink = n, n + 1
    room: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, x in enumerate(lean):
        if x >= 0:
            room[source][i], room[i][source] = x, 0.0
        else:
            room[i][sink], room[sink][i] = -x, 0.0
    for a, b, w in edges:
        room[a][b] = room[a].get(b, 0.0) + w
        room[b][a] = room[b].get(a, 0.0) + w
    reached = _saturate(room, source, sink)
    back = _reaches(room, sink)
    return [i in reached or i not in back for i in range(n)]


def _saturate(room: list[dict[int, float]], source: int, sink: int) -> set[int]:
    """Maximum flow by blocking flows of shortest paths; what the source still reaches."""
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, r in room[u].items():
                if r > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return set(level)
        ahead = {u: iter([v for v in room[u] if level.get(v) == at + 1]) for u, at in level.items()}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                # go on from before the first edge that is full
                path = path[: next(i for i, (a, b) in enumerate(zip(path, path[1:])) if room[a][b] <= 1e-12) + 1]
                continue
            v = next((v for v in ahead[u] if room[u][v] > 1e-12), None)
            if v is None:
                path.pop()
            else:
                path.append(v)


def _reaches(room: list[dict[int, float]], sink: int) -> set[int]:
    """Nodes from which the sink can still be reached."""
    into: list[list[int]] = [[] for _ in room]
    for u, out in enumerate(room):
        for v, r in out.items():
            if r > 1e-12:
                into[v].append(u)
    seen, queue = {sink}, deque([sink])
    while queue:
        for u in into[queue.popleft()]:
            if u not in seen:
                seen.add(u)
                queue.append(u)
    return seen


def edges(found: list[tuple]) -> list[tuple[int, int, float]]:
    """The ties of a page's blocks."""
    out, last = [], {}
    for i, (_, around, _, _, parent) in enumerate(found):
        like = lambda j, tie: tie if found[j][1] == around else tie / 4  # noqa: E731, B023
        if i:
            out.append((i - 1, i, like(i - 1, ADJACENT)))
        if parent in last:
            out.append((last[parent], i, like(last[parent], SIBLING)))
        last[parent] = i
    return out


def main_text(page: str | None, weights: tuple[float, ...] | None = None) -> str:
    """The content blocks of a page, joined by line feeds; the prior's weights if none are given."""
    found = blocks(page or "")
    if not found:
        return ""
    weights = weights or tuple(PRIOR.values())
    lean = [sum(w * x for w, x in zip(weights, f, strict=True) if x) for f in _features(found)]
    keep = minimum_cut(lean, edges(found))
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def _seen_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: hash of its text and of the longest text beside it, features,
    and whether it may be a seed of boilerplate or of content."""
    for batch in batches:
        rows: list[tuple] = []
        for page in batch.column(0).to_pylist():
            found = blocks(page or "")
            if found:
                longest = hash_bytes(max((b[0] for b in found), key=len).encode())
                for (text, around, _, linked, _), x in zip(found, _features(found), strict=True):
                    words = text.count(" ") + 1
                    seed = 1 if words >= SEED_AT_LEAST and linked < 0.3 and text[-1] in ".!?" else 0 if words <= SEED_AT_MOST else -1
                    if seed >= 0 and not around & COMMENT:
                        rows.append((hash_bytes(text.encode()), longest, list(x), seed))
        if rows:
            long = lambda k: pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64))  # noqa: E731, B023
            yield pa.RecordBatch.from_pydict({"h": long(0), "longest": long(1), "x": pa.array([r[2] for r in rows], pa.list_(pa.float64())), "seed": pa.array([r[3] for r in rows], pa.int32())})


def fit(pages: DataFrame, most: int = FIT_PAGES) -> tuple[float, ...]:
    """The classifier's weights, from at most ``most`` pages (those whose page_id and url
    have the smallest hashes; pages that repeat in both count as one choice)."""
    small_batches(pages.sparkSession)
    key = F.xxhash64("page_id", "url")
    chosen = pages.select(key.alias("key")).distinct().orderBy("key").limit(most)
    sample = pages.select(key.alias("key"), "html").join(F.broadcast(chosen), "key").select("html")
    seen = sample.mapInArrow(_seen_blocks, "h long, longest long, x array<double>, seed int")
    texts = seen.groupBy("h").agg(F.count_distinct("longest").alias("pages"), F.max("seed").alias("seed"), F.min("x").alias("x"))
    label = F.when(F.col("pages") >= REPEATED, F.when(F.col("seed") == 0, 0)).when((F.col("pages") == 1) & (F.col("seed") == 1), 1)
    # features have few values, so there are few different rows however many blocks
    told = texts.select("x", label.alias("label")).where("label is not null").groupBy("x", "label").count().toArrow()
    prior = np.array(list(PRIOR.values()))
    if not told.num_rows:
        return tuple(prior)
    x, y, n = np.array(told["x"].to_pylist()), told["label"].to_numpy().astype(float), told["count"].to_numpy().astype(float)
    # seeds of both kinds weigh alike, since how many there are says nothing on blocks
    n /= np.where(y == 1, max(1.0, n[y == 1].sum()), max(1.0, n[y == 0].sum())) / min(1000.0, n.sum())
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = PRIOR_SEEDS * np.eye(len(w))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge, x.T @ (n * (y - p)) - ridge @ (w - prior))
        w += np.clip(step, -2, 2)
    return tuple(w.tolist())


def _extract(weights: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    A null or empty page, and one without content, gives an empty text.  Markup that
    isn't closed ends with what holds it, a script or comment that isn't closed with the
    page.  Rows that repeat give rows that repeat; other columns aren't read; an empty
    table gives no rows.  Each page is parsed whole in the task that reads it."""
    weights = fit(pages)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(_extract(weights), "page_id long, url string, text string, n_chars long")
