"""Main text of pages by composite text density.

A page becomes a tree of elements. Menus, headers, footers, sidebars, adverts, forms and
the like, known by tag, role or class, are left out. Every other node has a density, its
characters for each tag, adjusted by how much of them is link text; the sum of the
densities of a node's children is greatest where text is gathered. The least density on
the path from that node to the body is the threshold: from the body down, each node at
or above it contributes its own subtree of the greatest sum, so an article in several
parts is found whole. The texts of the chosen subtrees are joined block by block.
"""

import html as entities
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import by_position

# ---- fixed values: what elements are in HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = set("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split())
#: A start tag of the key closes an open element of the value, unless one of BARRIERS stands between.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"},
    "body": {"head"}, "a": {"a"}, "p": {"p"},
}
CLOSE_P = BLOCKS - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
BARRIERS = {"table", "button", "object", "html", "ul", "ol", "dl"}
# ---- fixed values: elements and names of what is no main text
NOISE_TAGS = set(
    "head script style noscript template nav aside footer form button select textarea dialog menu search iframe object embed svg canvas "
    "audio video noembed noframes datalist title".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status toolbar".split())
NOISE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup share sharing social related recommended recommendations comment comments disqus reply replies respond "
    "pagination pager login search toolbar copyright skip widget widgets".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A part named header is none if it is the header of one of these.
OF_ARTICLES = set("article entry post content story section".split())
KEEP = {"html", "body", "main", "article"}

_TOKEN = re.compile(
    r"<!--(?:-?>|(?P<comment>.*?)(?:--!?>|\Z))|<[!?](?P<other>[^>]*+)>|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Tree:
    """The elements of a page in order of their start tags, each with its parent and contents.

    Node 0 is the page. Contents are texts and numbers of nodes. Elements left open are
    closed where HTML says so; end tags without start are passed over.
    """

    def __init__(self, page: str):
        self.name, self.parent, self.inside, self.attrs = ["#page"], [-1], [[]], [""]
        self._open = [0]  # nodes from the page down
        self._since_block = [{}]  # open inline elements above the last block, by name
        self._since_barrier = [{}]  # open elements above the last barrier, by name
        self._barriers: dict[str, int] = {}  # open barriers by name
        self._parse(page)

    def _parse(self, page: str) -> None:
        at, last = 0, page.rfind(">") + 1
        match = _TOKEN.search
        while found := match(page, at, last):
            self._text(page[at:found.start()])
            at = found.end()
            if found["start"]:
                name = found["start"].lower()
                self._start(name, found["attrs"])
                if name in RAW_TEXT:
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(page, at)
                    if name not in NOISE_TAGS:
                        self._text(page[at:end.start() if end else len(page)])
                    at = end.end() if end else len(page)
                    self._end(name)
                    if not end:
                        return
            elif found["end"]:
                self._end(found["end"].lower())
        tail = page[at:]
        cut = re.search(r"<[a-zA-Z/!?]", tail)  # a tag that never ends takes the rest with it
        self._text(tail[:cut.start()] if cut else tail)

    def _text(self, text: str) -> None:
        if text:
            self.inside[self._open[-1]].append(entities.unescape(text))

    def _start(self, name: str, attrs: str) -> None:
        if name in CLOSE_P:
            self._close({"p"})
        if name in CLOSES:
            self._close(CLOSES[name])
        if name in ("html", "body") and name in self.name[:8]:
            return
        node = len(self.name)
        self.name.append(name)
        self.parent.append(self._open[-1])
        self.attrs.append(attrs)
        self.inside.append([])
        self.inside[self._open[-1]].append(node)
        if name in VOID or (attrs.endswith("/") and name not in BLOCKS):
            return
        self._open.append(node)
        scope = self._since_barrier[-1]
        scope[name] = scope.get(name, 0) + 1
        if name in BLOCKS:
            self._since_block.append({})
        else:
            inline = self._since_block[-1]
            inline[name] = inline.get(name, 0) + 1
        if name in BARRIERS:
            self._since_barrier.append({})
            self._barriers[name] = self._barriers.get(name, 0) + 1

    def _pop(self) -> str:
        name = self.name[self._open.pop()]
        if name in BARRIERS:
            self._since_barrier.pop()
            self._barriers[name] -= 1
        self._since_barrier[-1][name] -= 1
        if name in BLOCKS:
            self._since_block.pop()
        else:
            self._since_block[-1][name] -= 1
        return name

    def _close(self, names: set[str]) -> None:
        """Closes the open elements of these names and all in them, down to the last barrier."""
        scope = self._since_barrier[-1]
        while any(scope.get(n) for n in names):
            self._pop()

    def _end(self, name: str) -> None:
        if name in BARRIERS:  # it is the barrier itself that ends
            if self._barriers.get(name) and name != "html":
                while self._pop() != name:
                    pass
        elif name in BLOCKS:
            if name not in ("body", "html") and self._since_barrier[-1].get(name):
                while self._pop() != name:
                    pass
        elif self._since_block[-1].get(name):
            while self._pop() != name:
                pass


def _names(text: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(text)}


def is_noise(name: str, attrs: str, in_article: bool, holds: set[str]) -> bool:
    """Whether an element is no main text by its tag, role, class or id.

    ``holds`` names the marked-up contents: an element with an article or a main heading
    in it is noise by no class, and a form or header with an article by no tag.
    """
    if name in KEEP:
        return False
    if name in NOISE_TAGS:
        return not (name == "form" and holds & {"article", "main", "h1"})
    if name == "header" and not in_article and not holds & {"article", "main"}:
        return True
    if not attrs.strip():
        return False
    given = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attrs)}
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(given.get("style", "")):
        return True
    if holds & {"article", "main", "h1"}:
        return False
    if given.get("role", "").lower() in NOISE_ROLES:
        return True
    for label in [*given.get("class", "").split(), given.get("id", "")]:
        words = _names(label)
        if words & NOISE_NAMES or ("header" in words and not in_article and not words & OF_ARTICLES):
            return True
    return False


def left_out(tree: Tree) -> list[bool]:
    """For each node whether it is noise or inside of it."""
    n, name, parent = len(tree.name), tree.name, tree.parent
    holds = [0] * n  # bits of article, main and h1 below
    bit = {"article": 1, "main": 2, "h1": 4}
    for k in range(n - 1, 0, -1):
        holds[parent[k]] |= holds[k] | bit.get(name[k], 0)
    out, inner = [False] * n, [False] * n
    for k in range(1, n):
        inner[k] = inner[parent[k]] or name[parent[k]] in ("article", "main")
        out[k] = out[parent[k]] or is_noise(name[k], tree.attrs[k], inner[k], {x for x, b in bit.items() if holds[k] & b})
    return out


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Characters for each tag times a logarithm that falls with the share of link text.

    ``body_share`` is the share of link characters of the whole body. Zero divisors are
    taken as one. The base of the logarithm is two at least: near one, which pages without links
    reach, the smallest nodes would have the greatest densities.
    """
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_share * chars + math.e)
    return chars / tags * math.log(max(chars * tags / (links * link_tags), 1.0)) / math.log(max(base, 2.0))


def densities(tree: Tree, out: list[bool]) -> tuple[list[float], list[float]]:
    """Density and density sum of each node; a node's own text is one child of it."""
    n, name, parent = len(tree.name), tree.name, tree.parent
    linked = [False] * n
    own = [0] * n
    for k in range(n):
        linked[k] = k > 0 and (linked[parent[k]] or name[k] == "a")
        if not out[k]:
            own[k] = sum(len("".join(x.split())) for x in tree.inside[k] if isinstance(x, str))
    chars, tags = own[:], [0] * n
    link_chars, link_tags = [own[k] if linked[k] else 0 for k in range(n)], [int(name[k] == "a") for k in range(n)]
    for k in range(n - 1, 0, -1):
        if not out[k]:
            at = parent[k]
            chars[at] += chars[k]
            tags[at] += tags[k] + 1
            link_chars[at] += link_chars[k]
            link_tags[at] += link_tags[k]
    share = link_chars[0] / max(chars[0], 1)
    density = [0.0 if out[k] else composite_density(chars[k], tags[k], link_chars[k], link_tags[k], share) for k in range(n)]
    sums = [0.0 if out[k] or linked[k] else composite_density(own[k], 1, 0, 0, share) for k in range(n)]
    for k in range(1, n):
        sums[parent[k]] += density[k]
    return density, sums


def chosen(tree: Tree, out: list[bool]) -> list[int]:
    """The roots of the subtrees that are main text, in page order, none inside another."""
    n, parent, name = len(tree.name), tree.parent, tree.name
    density, sums = densities(tree, out)
    best = list(range(n))  # the node of the greatest sum in each subtree, the first of equals
    for k in range(n - 1, 0, -1):
        if not out[k] and sums[best[k]] >= sums[best[parent[k]]] and (sums[best[k]] > sums[best[parent[k]]] or best[parent[k]] != parent[k]):
            best[parent[k]] = best[k]
    body = next((k for k in range(n) if name[k] == "body"), 0)
    top = best[body]
    if not sums[top]:
        return [body]
    threshold, k = density[top], top
    while k != body:
        k = parent[k]
        threshold = min(threshold, density[k])
    article = [0] * n  # the article that a node stands in, else the node itself
    for k in range(n):
        article[k] = k if name[k] == "article" or not k or name[article[parent[k]]] != "article" else article[parent[k]]
    marked = [False] * n
    for k in range(body, n):  # parents come before their children
        if k != body and (marked[parent[k]] or out[k]):
            marked[k] = marked[parent[k]]
        elif not marked[k] and density[k] >= threshold and sums[best[k]]:
            marked[article[best[k]]] = True
    return _outermost(tree, marked)


def _outermost(tree: Tree, marked: list[bool]) -> list[int]:
    """Marked nodes with no marked node above, and headings that stand right before one of them."""
    n, parent = len(tree.name), tree.parent
    above, roots = [False] * n, []
    for k in range(n):
        if k:
            above[k] = above[parent[k]] or marked[parent[k]]
        if marked[k] and not above[k]:
            roots.append(k)
    found = set(roots)
    for k in {parent[k] for k in roots if k}:
        run = []
        for x in tree.inside[k]:
            if isinstance(x, str):
                run = [] if x.strip() else run
            elif x in found:
                found.update(run)
                run = []
            else:
                run = [*run, x] if tree.name[x] in HEADINGS else []
    return sorted(found)


def text_of(tree: Tree, roots: list[int], out: list[bool]) -> str:
    """The blocks of the subtrees: white space made single, joined by an empty line."""
    blocks, line = [], []

    def ended():
        words = "".join(line).split()
        if words:
            blocks.append(" ".join(words))
        line.clear()

    for root in roots:
        todo = [(root, 0)]
        ended()
        while todo:
            k, at = todo.pop()
            content = tree.inside[k]
            while at < len(content):
                x = content[at]
                at += 1
                if isinstance(x, str):
                    line.append(x)
                elif tree.name[x] == "br":
                    line.append(" ")
                elif not out[x]:
                    if tree.name[x] in BLOCKS:
                        ended()
                    todo += [(k, at), (x, 0)]
                    break
            else:
                if tree.name[k] in BLOCKS:
                    ended()
    ended()
    return "\n\n".join(blocks)


def main_text(page: str | None) -> str:
    tree = Tree(page or "")
    out = left_out(tree)
    return text_of(tree, chosen(tree, out), out)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text and n_chars of each row; one row in, one row out, no shuffle.

    A null or empty page, and one without text outside of what is left out, has an empty
    text. Repeated rows are extracted each; other columns are not read; a table without
    urls gives null ones. A tag that never ends takes the rest of the page with it, as in
    browsers. An empty table gives an empty result.
    """
    df, at = by_position(pages)
    url = F.col(at[url_col]).cast("string") if url_col in at else F.lit(None).cast("string")
    df = df.select(F.col(at[id_col]).alias("page_id"), url.alias("url"), F.coalesce(F.col(at[html_col]).cast("string"), F.lit("")).alias("html"))
    kind = df.schema["page_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return df.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
