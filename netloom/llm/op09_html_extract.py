"""HTML main-text extraction by minimum-cut labelling.

A page is read in one forward pass into text blocks (the runs of text between the borders of block elements), each with
the hints of its ancestors. A linear classifier gives each block the log-odds of being content; these become capacities
to the source (content) or sink (boilerplate). Neighbouring blocks, and neighbours within one DOM parent, are joined by
smoothness edges. The minimum cut, found by max-flow, labels the blocks together. Blocks whose own cost outweighs all
their edges can be fixed beforehand without changing the minimum; flow runs on what remains.

The classifier's weights start from `PRIOR` and are fitted, with a Gaussian prior around them, to blocks of at most
`TRAIN_PAGES` pages whose semantic elements tell their label: at most `TRAIN_BLOCKS` of a page, drawn from all over it by a
hash of their place, and one page of an identifier. Extraction itself reads every block of every page.

Elements and the words of class, id and role values hint at a part of the page. Within an article, words that may as well
name its own parts (`SOFT_WORDS`) are one feature among others; elsewhere, and for all other words, they tell plainly.

Character references are decoded, white space within a block (line breaks of markup too) becomes one space, blocks are
joined by one newline in page order. Scripts, styles, forms' controls and markup never become blocks.

Defined cases: a null or empty page, and one without content, gives the empty string; unclosed and stray tags, raw "<",
unclosed comments and stray quotes are read as browsers do, roughly (a quote opens a value only right after "="; one that
is never closed belongs to its word); repeated rows give repeated results; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import html as htmllib
import math
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Stages, col, slices, table

TRAIN_PAGES = 300
TRAIN_BLOCKS = 60
SAME_PARENT, ADJACENT = 1.0, 0.4

# Element names and the words of class, id and role values that hint at a block's part in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
SKIP = frozenset("head template svg math select button datalist object canvas audio video map".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs colophon comment comments consent cookie cookies copyright "
    "disclaimer discussion disqus footer footnav gdpr legal login masthead menu menubar modal nav navbar navigation navlinks newsletter notice notices "
    "notification overlay pager pagination popup privacy promo promoted promotion recommended related reply replies respond search share sharing "
    "sidebar side sidenav signup skip social sponsor sponsored sponsors subscribe tagcloud teaser toc toolbar topbar trending widget widgets contentinfo complementary alert".split())  # fmt: skip
SOFT_WORDS = frozenset("alert copyright disclaimer discussion legal login notification overlay privacy promoted promotion recommended related reply replies respond search side signup skip social teaser toc trending widget widgets".split())
GOOD_TAGS = frozenset(["article", "main"])
GOOD_WORDS = frozenset("article articlebody content entry main maincontent post story".split())
HEAD_WORDS = frozenset(["header", "head", "heading", "title"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("address caption dd div dt figcaption legend li p pre summary td th".split())

NAMES = ("bias", "inner_good", "inner_bad", "any_bad", "links", "length", "short", "stop", "heading", "paragraph", "item", "rights", "soft")
PRIOR = np.array([-1.0, 4.0, -5.0, -5.0, -3.0, 0.5, -0.6, 1.0, 1.0, 0.8, -0.5, -2.5, -3.0])

#: An attribute: a name, and after "=" a value that is quoted, or runs to white space or ">".
_ATTR = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)?+)?+"""
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTR})*+)>")
_ATTRS = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^\s>]++))?+)?+""")
_TELLING = re.compile(r"class|id|role|style", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RIGHTS = re.compile(r"©|all rights reserved|tous droits|alle rechte|todos los derechos", re.I)


def _hint(tag: str, attrs: str, within_good: bool) -> int:
    """1 content, -1 boilerplate, -2 not shown, 2 perhaps boilerplate of an article, 0 nothing said."""
    good, bad, head, soft = tag in GOOD_TAGS, tag in BAD_TAGS, tag == "header", False
    if _TELLING.search(attrs):
        for m in _ATTRS.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return -2
            if name in ("class", "id", "role"):
                words = {w.lower() for w in _WORD.findall(value)}
                told = words & BAD_WORDS
                soft |= within_good and bool(told & SOFT_WORDS)
                bad |= bool(told - SOFT_WORDS if within_good else told)
                head |= bool(words & HEAD_WORDS)
                good |= bool(words & GOOD_WORDS)
    if bad:
        return -1
    if head:
        return 0 if within_good or good else -1
    return 1 if good else 2 if soft else 0


class Block:
    __slots__ = ("parent", "parts", "linked", "tag", "inner", "bad", "soft", "text")

    def __init__(self, parent: int, tag: str, inner: int, bad: bool, soft: bool):
        self.parent, self.tag, self.inner, self.bad, self.soft = parent, tag, inner, bad, soft
        self.parts: list[str] = []
        self.linked = 0


def parse(page: str) -> list[Block]:
    """The page's text blocks in order."""
    blocks: list[Block] = []
    # an open element: name, number, innermost plain hint, whether any hint is bad, good, soft
    stack: list[tuple[str, int, int, bool, bool, bool]] = [("", 0, 0, False, False, False)]
    made, link, skip, now = 0, 0, 0, None
    at, end, n = 0, 0, len(page)

    def text(s: str) -> None:
        nonlocal now
        if skip or not s or (now is None and s.isspace()):
            return
        if now is None:
            around = [e for e in stack if e[0] in BLOCKS or e[0] == ""]
            # text of a paragraph or the like belongs with its siblings, other text with the element it is in
            parent = around[-2] if around[-1][0] in LEAVES else around[-1]
            now = Block(parent[1], around[-1][0], stack[-1][2], stack[-1][3], stack[-1][5])
            blocks.append(now)
        s = htmllib.unescape(s) if "&" in s else s
        now.parts.append(s)
        if link:
            now.linked += len(s)

    while True:
        at = page.find("<", end)
        if at < 0:
            text(page[end:])
            break
        text(page[end:at])
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, at)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[at : at + 3]):  # an open quote: the tag ends at the next ">"
                end = page.find(">", at)
                end = n if end < 0 else end + 1
            else:
                text("<")
                end = at + 1
            continue
        end = m.end()
        close, tag = m[1], m[2].lower()
        if tag in BLOCKS:
            now = None
        if tag == "br":
            text(" ") if now is not None else None
        elif close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    while len(stack) > k:
                        e = stack.pop()
                        link -= e[0] == "a"
                        skip -= e[0] in SKIP or e[2] == -2
                    break
                if tag not in BLOCKS and stack[k][0] in BLOCKS:
                    break
        elif tag in RAW:
            low = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, end)
            end = n if not low else page.find(">", low.start()) + 1 or n
        elif tag not in VOID:
            if tag in BLOCKS or tag == "a":  # what a new element closes: an open paragraph, item, cell or link
                ends = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "a": ("a",)}.get(tag, ("p",))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        while len(stack) > k:
                            e = stack.pop()
                            link -= e[0] == "a"
                            skip -= e[0] in SKIP or e[2] == -2
                        break
                    if stack[k][0] in BLOCKS:
                        break
            if tag not in ("html", "body"):
                hint = _hint(tag, m[3], stack[-1][4])
            else:
                hint = 0
            if not m[3].endswith("/"):
                made += 1
                _, _, inner, bad, good, soft = stack[-1]
                stack.append((tag, made, hint if hint in (1, -1, -2) else inner, bad or hint < 0, good or hint == 1, soft or hint == 2))
                link += tag == "a"
                skip += tag in SKIP or stack[-1][2] == -2
    out = []
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            out.append(b)
    return out


def block_features(b: Block) -> list[float]:
    words = b.text.count(" ") + 1
    return [1, b.inner > 0, b.inner < 0, b.bad, min(1.0, b.linked / max(1, len(b.text))), min(4.0, math.log2(1 + words)) - 2, words < 4, b.text[-1] in ".!?…:;\"”»", b.tag in HEADINGS, b.tag == "p", b.tag in ("li", "dd", "option"), bool(_RIGHTS.search(b.text)), b.soft]


def min_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least total cost: |score| for a label against its sign, an edge's weight where its ends
    differ."""
    n, s = len(score), list(score)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # fix what its neighbours cannot turn
        i = todo.popleft()
        if label[i] is None and abs(s[i]) >= sum(near[i].values()):
            label[i] = s[i] > 0
            for j, w in near[i].items():
                s[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    free = [i for i in range(n) if label[i] is None]
    if free:
        source, sink = n, n + 1
        cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in free} | {source: {}, sink: {}}
        for i in free:
            if s[i] > 0:
                cap[source][i], cap[i][source] = s[i], 0.0
            else:
                cap[i][sink], cap[sink][i] = -s[i], 0.0
        while True:
            level, queue = {source: 0}, deque([source])
            while queue:
                u = queue.popleft()
                for v, c in cap[u].items():
                    if c > 1e-12 and v not in level:
                        level[v] = level[u] + 1
                        queue.append(v)
            if sink not in level:
                break
            arcs, path, u = {v: iter([*cap[v]]) for v in level}, [], source
            while True:  # blocking flow, without recursion
                if u == sink:
                    f = min(cap[a][b] for a, b in path)
                    for a, b in path:
                        cap[a][b] -= f
                        cap[b][a] += f
                    k = next(k for k, (a, b) in enumerate(path) if cap[a][b] <= 1e-12)
                    u, path = path[k][0], path[:k]
                    continue
                v = next((v for v in arcs[u] if cap[u][v] > 1e-12 and level.get(v) == level[u] + 1), None)
                if v is not None:
                    path.append((u, v))
                    u = v
                elif path:
                    u = path.pop()[0]
                else:
                    break
        for i in free:
            label[i] = i in level
    return [bool(x) for x in label]


def extract(page: str, weights: np.ndarray) -> str:
    blocks = parse(page)
    if not blocks:
        return ""
    scores = (np.array([block_features(b) for b in blocks], float) @ weights).tolist()
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if b.parent in last:
            edges.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    return "\n".join(b.text for b, keep in zip(blocks, min_cut(scores, edges), strict=True) if keep)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a Gaussian prior around PRIOR, by Newton steps."""
    w = PRIOR.copy()
    if len(y):
        share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * min(len(y), 200)
        for _ in range(8):
            p = 1 / (1 + np.exp(-np.clip((x * w).sum(1), -30, 30)))
            g = (x * (share * (y - p))[:, None]).sum(0) - 4 * (w - PRIOR)
            h = (x[:, :, None] * x[:, None, :] * (share * p * (1 - p))[:, None, None]).sum(0)
            w = w + np.linalg.solve(h + 4 * np.eye(len(w)), g)
    return w


def _told(batches):
    """Features and labels of blocks that semantic elements label plainly; of a page those with the least hash of their
    place."""
    for b in slices(batches, 64):
        xs, ys = [], []
        for t in b.column(0).to_pylist():
            plain = [k for k in parse(t or "") if k.bad or k.inner > 0 and not k.soft]
            for i in sorted(range(len(plain)), key=lambda i: zlib.crc32(i.to_bytes(8, "little")))[:TRAIN_BLOCKS]:
                k = plain[i]
                xs.append([float(v) for v in block_features(k)])
                ys.append(int(not k.bad))
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32())], ["x", "y"])


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = TRAIN_PAGES) -> np.ndarray:
    ids = pages.select(col(id_col).alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    rows = pages.select(col(id_col).alias("p"), col(html_col).cast("string").alias("t")).join(F.broadcast(ids), F.col("p") == F.col("id"))
    rows = rows.groupBy("id").agg(F.min("t").alias("t"))
    got = sorted((tuple(r.x), r.y) for r in rows.select("t").mapInArrow(_told, "x array<double>, y int").collect())
    return fit(np.array([g[0] for g in got]).reshape(-1, len(PRIOR)), np.array([g[1] for g in got], float))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    Stages(pages.sparkSession, "html")
    weights = train(pages, id_col, html_col) if weights is None else weights

    def run(batches):
        for b in slices(batches, 64):
            out = [extract(t or "", weights) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), col(html_col).cast("string"))
    kinds = [rows.schema[i].dataType.simpleString() for i in range(2)]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op9_html_extract(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
