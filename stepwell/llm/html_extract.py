"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks. A classifier gives each block a cost of being called content and one of being called
boilerplate: its capacities to the two terminals. Neighbours in page order and in the tree share smoothness edges. The
minimum cut, found by maximum flow, is the cheapest labelling.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import ship

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^"'<>]++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Elements whose contents are no text of the page.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select".split())
#: Of these, the ones that run to the end of the page where they are never closed.
OPEN_RAW = frozenset("script style title textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul label".split()
)
#: Elements that never hold an article's own text.
CHROME = frozenset("head nav footer aside form menu dialog button fieldset label option search dir".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login social share "
    "sharing related recommended recommendations comment comments commentlist reply replies respond disqus widget pagination pager toolbar search copyright legal "
    "paywall teaser topbar skip".split()
)
#: Words that tell what a container has or is beside, and so excuse the ones above.
EXCUSES = frozenset("has with no without content main article post entry story page wrapper layout".split())
NOTICE = re.compile(r"©|\ball rights reserved\b|\bcookies?\b|\bsubscribe\b|\bsign (?:up|in)\b|\badvertisement\b|\bsponsored\b|\bterms of (?:use|service)\b|\bprivacy policy\b", re.I)
#: Elements that a start tag closes when they stand open above the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"datalist"})}
FIXED = 50.0


@dataclass(slots=True)
class Block:
    text: str
    links: int
    tag: str
    chrome: bool
    article: bool
    parent: int
    depth: int


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _is_chrome(tag: str, raw: str, article: bool) -> bool:
    if tag in ("html", "body", "main", "article"):
        return False
    if tag in CHROME or tag == "header" and not article:
        return True
    if not raw or raw.isspace():
        return False
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & CHROME_WORDS and not words & EXCUSES:
            return True
    return False


def blocks(page: str | None) -> list[Block]:
    """The page's blocks of text in order, white space squeezed and character references decoded."""
    page = page or ""
    out: list[Block] = []
    # (tag, chrome, article, number)
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
    held: dict[str, int] = {}
    parts: list[str] = []
    links = number = at = in_link = 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            tag, chrome, article, _ = stack[-1]
            out.append(Block(text, min(links, len(text)), tag, chrome, article, stack[-2][3] if len(stack) > 1 else 0, len(stack)))
        parts.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw:
            text = _html.unescape(raw)
            parts.append(text)
            if in_link:
                links += len(text)

    def pop_to(k: int) -> None:
        for tag, *_ in stack[k:]:
            held[tag] -= 1
        del stack[k:]

    def close(tags, until) -> None:
        """Closes the outermost of tags that is open above the nearest of until."""
        found = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                found = k
            elif stack[k][0] in until:
                break
        if found is not None:
            pop_to(found)

    m = _MARKUP.search(page)
    while m:
        say(page[at : m.start()])
        at = m.end()
        if m[2]:
            tag, ends = m[2].lower(), bool(m[1])
            if tag in RAW and not ends:
                if tag not in ("svg", "math") or not m[3].rstrip().endswith("/"):
                    stop = None if tag in unclosed else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    if stop:
                        at = stop.end()
                    else:
                        unclosed.add(tag)
                        at = len(page) if tag in OPEN_RAW else at
                    parts.append(" ")
            elif tag == "br" or tag == "wbr":
                parts.append(" " if tag == "br" else "")
            elif tag == "a":
                in_link = 0 if ends else 1
            elif tag in BLOCK:
                flush()
                if ends:
                    if held.get(tag):
                        k = len(stack) - 1
                        while stack[k][0] != tag:
                            k -= 1
                        pop_to(k)
                        in_link = 0
                elif tag not in VOID:
                    if held.get("p"):
                        close({"p"}, {"td", "th", "li", "div", "section", "article", "table", "button", "blockquote"})
                    if tag == "body" and held.get("head"):
                        close({"head"}, {"html"})
                    if tag in CLOSES:
                        close(*CLOSES[tag])
                    _, chrome, article, _ = stack[-1]
                    article = article or tag in ("article", "main")
                    number += 1
                    stack.append((tag, chrome or _is_chrome(tag, m[3], article), article, number))
                    held[tag] = held.get(tag, 0) + 1
        m = _MARKUP.search(page, at)
    tail = page[at:]
    cut = re.search(r"<[a-zA-Z/!?]", tail)
    say(tail[: cut.start()] if cut else tail)
    flush()
    return out


def costs(b: Block) -> tuple[float, float]:
    """(cost of calling it content, cost of calling it boilerplate)."""
    if b.chrome:
        return FIXED, 0.0
    words = b.text.count(" ") + 1
    density = b.links / len(b.text)
    content = 5.0 * density
    boiler = min(words, 60) / 12 * (1 - density)
    if b.article:
        boiler += 8.0
    if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "figcaption"):
        boiler += 1.5
    if not b.article:
        content += 1.0
        if words < 6 and b.text[-1] not in ".!?…:\"'”»":
            content += 1.5
        if words < 40 and NOTICE.search(b.text):
            content += 3.0
    return content, boiler


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: page neighbours, more if close in the tree; and each block with the last one under its parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            apart = 0 if a.parent == b.parent else 1 + abs(a.depth - b.depth)
            out.append((i - 1, i, 1.5 / (1 + apart)))
        k = last.get(b.parent)
        if k is not None and k != i - 1:
            out.append((k, i, 0.5))
        last[b.parent] = i
    return out


def min_cut(terminals: list[tuple[float, float]], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes the cheapest labelling calls content.

    A node pays terminals[i][0] as content and [1] as boilerplate, and a link its weight where its ends differ. Nodes
    whose own costs outweigh all their links are settled first, and what they settle next, which changes no minimum;
    blocking flows (Dinic) decide the rest. Ties go to boilerplate.
    """
    n = len(terminals)
    pull = [b - c for c, b in terminals]  # above zero: content
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    free = [0.0] * n
    for i, j, w in links:
        near[i].append((j, w))
        near[j].append((i, w))
        free[i] += w
        free[j] += w
    label: list[bool | None] = [None] * n
    work = deque(range(n))
    while work:
        i = work.popleft()
        if label[i] is not None or abs(pull[i]) < free[i] or pull[i] == free[i]:
            continue
        label[i] = pull[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                free[j] -= w
                pull[j] += w if label[i] else -w
                work.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _flow(rest, pull, near, label)):
            label[i] = side
    return [bool(x) for x in label]


def _flow(rest: list[int], pull: list[float], near: list[list[tuple[int, float]]], label: list[bool | None]) -> list[bool]:
    at = {x: k for k, x in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def edge(u: int, v: int, there: float, back: float) -> None:
        out[u].append(len(to))
        out[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((there, back))

    for x, k in at.items():
        edge(source, k, max(pull[x], 0.0), 0.0)
        edge(k, sink, max(-pull[x], 0.0), 0.0)
        for y, w in near[x]:
            if label[y] is None and x < y:
                edge(k, at[y], w, w)
    tiny = 1e-9
    while True:
        level = [-1] * len(out)
        level[source] = 0
        work = deque([source])
        while work:
            u = work.popleft()
            for e in out[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    work.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[: len(rest)]]
        turn = [0] * len(out)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            else:
                if not path:
                    break
                e = path.pop()
                u = to[e ^ 1]
                turn[u] += 1
                continue
            path.append(e)
            u = to[e]


def main_text(page: str | None) -> str:
    """The blocks that the minimum cut calls content, joined by newlines; empty if there are none."""
    found = blocks(page)
    keep = min_cut([costs(b) for b in found], edges(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages.

    Null or empty html, and pages of boilerplate alone, give empty text. Null or repeated ids and urls pass through.
    An empty table gives no rows. Other columns are ignored.
    """
    ship(pages.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            counts = pa.array(list(map(len, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    ids, urls = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(each, f"page_id {ids}, url {urls}, text string, n_chars long")


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
