"""Main text of web pages by consensus host paths.

Every page is cut into blocks of text, each with the generalised tag-class paths of its containers. A page
scores its containers by the text outside links that they hold directly or in paragraphs, and votes for the
best; Spark sums the votes by host and path. The blocks are kept meanwhile, and the winning path of the host that a
page contains is taken whole, with boilerplate inside it left out. A page without any winning path takes its
own best container. Text that stands directly in a container around the chosen one goes with it. A page of links
takes the winning path of its host, else all its blocks but boilerplate.

Null and empty pages, and pages without blocks, give an empty text. The host of a null url is the empty string.
Repeated rows vote as often as they occur. Nothing is capped: a page of any length is read to its end, in time that
grows with the length alone, however deep its elements nest and however broken its tags are. Of containers with
equal scores the one opened last is taken; of paths with equal votes and scores the first. An empty table
gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, materialise

BLOCK_TAGS = set(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
#: Elements whose content is not text of the page, read to their end tag.
RAW_TAGS = {"script", "style", "template", "svg", "iframe", "object", "textarea", "title", "canvas", "noembed", "noframes"}
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "head", "dialog", "search"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Parts of class and id values that name boilerplate, those of adverts, and parts that name nothing of their own.
CHROME = regex.compile(
    r"ads?|adverts?|advertis\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|footer|foot|header|masthead|sidebar|side|widget\w*|comments?|commentlist|discussion|disqus|replies|respond|"
    r"related|recommend\w*|share|sharing|social|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|search\w*|pagination|pager|toolbar|tags?|toc|skip|hidden|copyright|legal|disclaimer"
)
ADVERT = regex.compile(r"ads?|adverts?|advertis\w*|sponsor\w*|promo\w*")
NEUTRAL = regex.compile(
    r"|[0-9]+(?:x[0-9]+)?|[a-z]|site|page|global|main|primary|secondary|top|bottom|left|right|upper|lower|sticky|fixed|container|wrapper|wrap|inner|outer|box|bar|block|panel|section|area|region|slot|unit|zone|row|col|column|"
    r"list|items?|links?|buttons?|icons?|form|input|field|group|thread|posts?|articles?|stories|story|entry|content|text|body|title|head|us|me|to|up|for|of|the|js|web|app|mobile|desktop"
)
CONTENT = regex.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|text|body|page)(?:$|[\s_-])")
COMMENT = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
#: A tag, its attributes, or where a quote in them is never closed (or no end of the tag follows), all up to the next >.
TOKEN = regex.compile(COMMENT + r"|<(/?)([A-Za-z][^\s/>]*+)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^>]*+(?:>|\Z)))", regex.S)
#: What is read after the first such tag: quotes mean nothing from there on, so that no page is read twice.
PLAIN = regex.compile(COMMENT + r"|<(/?)([A-Za-z][^\s/>]*+)(?:(?!)()|([^>]*+(?:>|\Z)))", regex.S)
ATTR = regex.compile(r"([A-Za-z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?", regex.S)
DIGITS = regex.compile(r"\d+")
WHITE = regex.compile(r"\s+")
CLOSES_P = BLOCK_TAGS - {"br", "button", "label", "select", "option"}
#: Start tags that end an open element of the listed tags, unless one of BOUNDS stands between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = ("ul", "ol", "dl", "table", "tr", "menu", "select", "div", "article", "section")
#: Blocks that are no containers.
PLAIN_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li pre blockquote td th tr dt dd figcaption caption label tbody thead tfoot".split())


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}


def step_of(tag: str, attrs: dict[str, str]) -> str:
    """A container's part of a path: its tag and classes, digits made one."""
    classes = ".".join(sorted(set(DIGITS.sub("0", attrs.get("class", "")).split())))
    mark = WHITE.sub("_", DIGITS.sub("0", attrs.get("id", "")))
    return tag + ("." + classes if classes else "") + ("#" + mark if mark else "")


def is_chrome(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in CHROME_TAGS:
        # the header of an article is part of it
        return not (tag == "header" and in_article)
    if attrs.get("role", "").lower() in CHROME_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if regex.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "").lower()):
        return True
    if tag == "noscript" and not in_article:  # asks for scripts
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return any(names_chrome(name, in_article and tag in PLAIN_BLOCKS) for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split())


def names_chrome(name: str, in_text: bool) -> bool:
    """Whether a whole class or id names boilerplate: each of its parts does, or names nothing. Of a text only adverts."""
    parts = regex.split("[-_:]+", name)
    known = ADVERT if in_text else CHROME
    if not any(known.fullmatch(x) for x in parts) or not all(CHROME.fullmatch(x) or NEUTRAL.fullmatch(x) for x in parts):
        return False
    return not CONTENT.search(name) or bool(regex.search(r"comment|\bads?\b|advert|sidebar|footer|nav", name))


class Tree:
    """The containers of a page as a tree whose node 0 stands for none; equal paths are one node."""

    def __init__(self) -> None:
        self.parent, self.step, self.children = [0], [""], [{}]

    def child(self, node: int, step: str) -> int:
        found = self.children[node].get(step)
        if found is None:
            found = self.children[node][step] = len(self.parent)
            self.parent.append(node), self.step.append(step), self.children.append({})
        return found

    def find(self, path: str) -> int | None:
        node = 0
        for step in path.split(" "):
            node = self.children[node].get(step)
            if node is None:
                return None
        return node

    def path(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.step[node])
            node = self.parent[node]
        return " ".join(reversed(steps))


def blocks(page: str) -> tuple[Tree, list[tuple[int, str, int, bool]]]:
    """The container tree and (container, text, characters in links, boilerplate) of every block in page order.

    Where each open tag stands is kept by tag, so that no part of the stack is searched and the time is linear.
    """
    tree, out = Tree(), []
    stack: list[tuple[str, int, bool]] = []  # tag, container, whether it or one around it is boilerplate
    at_tag: dict[str, list[int]] = {}  # places of the open elements of each tag
    block_places: list[int] = []
    parts: list[str] = []
    linked, links, at = 0, 0, 0
    token = TOKEN
    last = lambda tag: at_tag[tag][-1] if at_tag.get(tag) else -1

    def close() -> None:
        nonlocal linked
        # decoding comes before white space is turned, so that a non-breaking space counts as white space
        text = WHITE.sub(" ", "".join(parts)).strip()
        if text:
            _, node, chrome = stack[-1] if stack else ("", 0, False)
            out.append((node, text, min(linked, len(text)), chrome))
        parts.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw)
            parts.append(text)
            if links:
                linked += len(text)

    def pop_to(k: int) -> None:
        for tag, _, _ in stack[k:]:
            at_tag[tag].pop()
        del stack[k:]
        while block_places and block_places[-1] >= k:
            block_places.pop()

    while True:
        m = token.search(page, at)
        take(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        raw = m[3]
        if raw is None:
            token, raw = PLAIN, m[4]
            if not raw.endswith(">"):  # no tag ends any more: the rest is text
                take(page[m.start() :])
                break
            raw = raw[:-1]
        if m[1]:  # an end tag
            if tag == "a":
                links = max(0, links - 1)
            if tag == "br" or tag in BLOCK_TAGS:
                close()
            k = last(tag)
            if k >= 0 and (tag in BLOCK_TAGS or not block_places or block_places[-1] < k):  # an inline end tag doesn't close the blocks around it
                if stack[-1][2] or tag in BLOCK_TAGS:
                    close()
                pop_to(k)
            continue
        if tag in RAW_TAGS and not raw.endswith("/"):
            end = regex.compile(rf"</{regex.escape(tag)}\s*+>", regex.I).search(page, at)
            at = end.end() if end else len(page)
            if tag in BLOCK_TAGS:
                close()
            continue
        if tag in BLOCK_TAGS:
            close()
            if tag != "br" and not at_tag.get("a"):
                links = 0
            if tag in CLOSES_P and block_places and stack[block_places[-1]][0] == "p":
                pop_to(block_places[-1])
            if tag in ENDS:
                k = max(last(t) for t in ENDS[tag])
                if k >= 0 and k >= max(last(t) for t in BOUNDS):
                    pop_to(k)
        if tag in VOID_TAGS or raw.endswith("/"):
            continue
        if tag == "a":
            links += 1
        attrs = attributes(raw)
        _, node, inside = stack[-1] if stack else ("", 0, False)
        chrome = is_chrome(tag, attrs, bool(at_tag.get("article") or at_tag.get("main")))
        if chrome and tag not in BLOCK_TAGS:
            close()
        if tag in BLOCK_TAGS and tag not in PLAIN_BLOCKS:
            node = tree.child(node, step_of(tag, attrs))
        at_tag.setdefault(tag, []).append(len(stack))
        if tag in BLOCK_TAGS:
            block_places.append(len(stack))
        stack.append((tag, node, inside or chrome))
    close()
    return tree, out


def container_scores(tree: Tree, found: list[tuple]) -> list[float | None]:
    """Score of each container: text outside links of its own blocks, and of those inside it by 0.8 a level.

    None where only boilerplate, or nothing, stands.
    """
    worth: list[float | None] = [None] * len(tree.parent)
    for node, text, linked, chrome in found:
        if not chrome and node:
            worth[node] = (worth[node] or 0.0) + len(text) - 2 * linked
    for node in range(len(worth) - 1, 0, -1):  # children come after their parents
        up = tree.parent[node]
        if worth[node] is not None and up:
            worth[up] = (worth[up] or 0.0) + 0.8 * worth[node]
    return [None if w is None else w * prior(name) for w, name in zip(worth, tree.step, strict=True)]


def prior(step: str) -> float:
    tag = step.split(".")[0].split("#")[0]
    if tag in ("body", "html"):
        return 0.9
    return 1.5 if tag in ("article", "main") else 1.2 if CONTENT.search(step.replace(".", " ").replace("#", " ")) else 1.0


def best_of(tree: Tree, scores: list[float | None]) -> int | None:
    """The container of the greatest score above 0; of equals the one opened last."""
    top = max((s for s in scores if s is not None), default=0.0)
    return len(scores) - 1 - scores[::-1].index(top) if top > 0 else None


def text_under(tree: Tree, found: list[tuple], chosen: int) -> str:
    """The blocks in a container, and those of worth that stand directly in the containers around it."""
    inside = [False] * len(tree.parent)
    for node in range(1, len(inside)):
        inside[node] = node == chosen or inside[tree.parent[node]]
    around, node = {0}, chosen
    while node:
        node = tree.parent[node]
        around.add(node)
    return " ".join(text for node, text, linked, chrome in found if not chrome and (inside[node] or (node in around and len(text) > 2 * linked)))


def host_of(url: str) -> Column:
    """Column of a url's host in lower case, without user and port."""
    authority = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")


#: Bytes of pages whose blocks are handed over at once.
HANDED = 4 << 20
#: A page cut into blocks: its tree by parent and step, each block's container, text, characters in links and whether it is boilerplate, and its vote.
PARSED = "parents array<int>, steps array<string>, nodes array<int>, texts array<string>, linked array<int>, chrome array<boolean>, path string, score double"
PARSED_KINDS = [pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.string(), pa.float64()]


def cut_pages(pages: DataFrame, keep: list[str], html: str) -> DataFrame:
    """keep... and PARSED of every page; path and score: its best container, null if there is none."""
    names = [*keep, *[x.split()[0] for x in PARSED.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, size = [], 0, 0
            for i, value in enumerate(batch.column(len(keep))):
                page = value.as_py() or ""
                tree, found = blocks(page)
                scores = container_scores(tree, found)
                best = best_of(tree, scores)
                vote = (None, None) if best is None else (tree.path(best), scores[best])
                rows.append((tree.parent, tree.step, *([b[k] for b in found] for k in range(4)), *vote))
                size += len(page)
                if size >= HANDED or i == batch.num_rows - 1:
                    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(PARSED_KINDS)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, i + 1 - start).columns[: len(keep)], *columns], names=names)
                    rows, start, size = [], i + 1, 0

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html).mapInArrow(run, f"{kinds}, {PARSED}")


def tree_of(parents: list[int], steps: list[str]) -> Tree:
    """The tree that cut_pages wrote."""
    tree = Tree()
    for parent, step in zip(parents[1:], steps[1:], strict=True):
        tree.child(parent, step)
    return tree


def consensus(cast: DataFrame, share: float = 0.1) -> DataFrame:
    """host, paths: those with a share of the host's votes, best first. Sums combine before they are shuffled.

    A share of a tenth leaves ten paths a host at most; a page that none of them fits takes its own best container.
    """
    # read twice below, so the pages are not parsed again
    by_path = materialise(cast.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score")), "votes")
    total = by_path.groupBy("host").agg(F.sum("n").alias("all"))
    ranked = by_path.join(total, "host").where(F.col("n") >= share * F.col("all"))
    order = F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("score"), "path")
    return ranked.groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("ranked")).select("host", F.transform("ranked", lambda r: r["path"]).alias("paths"))


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    # cutting a page is nearly all the work, so its blocks are kept for the second look
    cut = materialise(cut_pages(named, ["page_id", "url", "host"], "html"), "blocks")
    winners = materialise(consensus(cut.where("path is not null").select("host", "path", "score")), "paths")
    joined = looked_up(cut.drop("path", "score"), winners, ["host"], "left").select("page_id", "url", "parents", "steps", "nodes", "texts", "linked", "chrome", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for parents, steps, nodes, words, linked, chrome, paths in zip(*batch.columns[2:], strict=True):
                tree = tree_of(parents.as_py(), steps.as_py())
                found = list(zip(nodes.as_py(), words.as_py(), linked.as_py(), chrome.as_py(), strict=True))
                scores = container_scores(tree, found)
                known = [k for k in map(tree.find, paths.as_py() or []) if k is not None and scores[k] is not None]
                chosen = next((k for k in known if scores[k] > 0), None) or best_of(tree, scores) or next(iter(known), None)
                texts.append(text_under(tree, found, chosen) if chosen else " ".join(t for _, t, _, chrome in found if not chrome))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {c: named.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
