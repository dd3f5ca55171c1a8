"""HTML as Markdown from a tree of elements: several renderings of a page, of which the best is taken. Pages are rendered in tasks, batch by batch."""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.functions import markup

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "head", "noscript", "title", "template", "iframe", "svg"}
#: Elements that an element of the same list closes when it opens; the second list bounds the search.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "p": ({"p"}, {"div", "td", "li", "blockquote", "body"})}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "body", "html", "form", "fieldset", "figure", "figcaption", "address", "center", "dl", "dt", "dd", "tbody", "thead", "tfoot", "caption", "details", "summary"}
#: Renderings by name, in the order that decides ties.
NAMES = ("tree", "links", "main")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict
    children: list = field(default_factory=list)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends, within = CLOSES.get(tag, ((), ()))
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in within:
                break
            if self.open[i].tag in ends:
                del self.open[i:]
                break
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree_of(page: str) -> Node:
    parser = _Tree()
    parser.feed(page or "")
    parser.close()
    return parser.root


def _upwards(root: Node) -> Iterator[Node]:
    """All elements, children before parents, without recursion: pages nest as deeply as they like."""
    stack, out = [root], []
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and c.tag not in DROPPED]
    return reversed(out)


_MARKS = re.compile("\x04(\\d+)\x05|[\x04\x05]")
_SAFE_URL = re.compile(r"[!-_a-{}~]+")
_SPACES = re.compile(r"\s+")
_ODD_SPACE = re.compile(r"[^\S ]|  ")
_HEADING = {f"h{i}": "#" * i for i in range(1, 7)}
_MARK = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~"}


def _hidden(node: Node) -> bool:
    if not node.attrs:
        return False
    style = (node.attrs.get("style") or "").replace(" ", "").lower()
    return "display:none" in style or "hidden" in node.attrs or (node.tag == "img" and bool({node.attrs.get("width"), node.attrs.get("height")} & {"0", "1"}))


def _lines(text: str, first: str, others: str) -> str:
    return "\n".join((first if i == 0 else others if line else "") + line for i, line in enumerate(text.split("\n")))


def _squeezed(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*(?![ \t]*(?:[-\d>|]|    ))", "\n", text)).strip("\n")


def _urls(root: Node) -> dict[str, int]:
    """Links numbered in the order of the page, which is not that of the rendering."""
    urls: dict[str, int] = {}
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "a" and node.attrs.get("href"):
            urls.setdefault(node.attrs["href"], len(urls) + 1)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in DROPPED]
    return urls


def _rendered(root: Node, urls: dict[str, str], part: Node | None = None) -> tuple[str, str]:
    """Markdown of a tree and of one element in it, which is rendered on the way; with ``urls`` these stand for the targets of links."""
    done: dict[int, str] = {}
    keep = id(part or root)
    for node in _upwards(root):
        pieces = []
        for c in node.children:
            if isinstance(c, Node):
                if c.tag not in DROPPED:
                    pieces.append(done[id(c)] if id(c) == keep else done.pop(id(c)))
            else:
                pieces.append(c if node.tag in ("pre", "code") or not _ODD_SPACE.search(c) else _SPACES.sub(" ", c))
        inner = "".join(pieces)
        tag, flat = node.tag, " ".join(inner.split())
        if _hidden(node):
            text = ""
        elif tag in _HEADING:
            text = f"\n\n{_HEADING[tag]} {flat}\n\n" if flat else ""
        elif tag in _MARK:
            mark = _MARK[tag]
            text = f"{' ' * inner[:1].isspace()}{mark}{flat}{mark}{' ' * inner[-1:].isspace()}" if flat else inner
        elif tag == "code":
            text = inner if "\n" in inner else f"`{inner}`" if inner else ""
        elif tag == "pre":
            text = f"\n\n```\n{inner.strip('`').strip(chr(10))}\n```\n\n"
        elif tag == "a":
            href = node.attrs.get("href")
            text = flat if not href else f"[{flat or href}]{urls[href]}" if urls else f"[{flat or href}]({href})"
        elif tag == "img":
            text = f"![{node.attrs.get('alt') or 'Image'}]({node.attrs['src']})" if node.attrs.get("src") else ""
        elif tag == "br":
            text = "\n"
        elif tag == "hr":
            text = "\n\n---\n\n"
        elif tag == "blockquote":
            text = "\n\n" + "\n".join(f"> {line}" if line.strip() else ">" for line in _squeezed(inner).strip().split("\n")) + "\n\n" if flat else ""
        elif tag == "li":
            text = "\x00" + _squeezed(inner).strip() + "\x01"
        elif tag in ("ul", "ol"):
            start = int(node.attrs["start"]) if (node.attrs.get("start") or "").isdigit() else 1
            items = [x for x in re.findall("\x00(.*?)\x01", inner, re.S) if x.strip()]
            marks = [f"{start + i}. " if tag == "ol" else "- " for i in range(len(items))]
            text = "\n\n" + "\n".join(_lines(re.sub(r"\n+", "\n", x), m, "  " * (2 if tag == "ol" else 1)) for m, x in zip(marks, items, strict=True)) + "\n\n" if items else inner
        elif tag in ("td", "th"):
            text = "\x02" + flat.replace("|", "\\|")
        elif tag == "tr":
            text = "\x03" + inner.strip() if "\x02" in inner else inner
        elif tag == "table":
            rows = [[c.strip() for c in r.split("\x02")[1:]] for r in inner.split("\x03")[1:]]
            wide = max(map(len, rows), default=0)
            if wide > 1 and len(rows) > 1:
                cells = [f"| {' | '.join([*r, *[''] * (wide - len(r))])} |" for r in rows]
                text = "\n\n" + "\n".join([cells[0], "|" + " --- |" * wide, *cells[1:]]) + "\n\n"
            else:
                # A table of one row or column only lays out the page.
                text = "\n\n" + re.sub("[\x02\x03]", "\n\n", inner) + "\n\n"
        elif tag in BLOCKS:
            text = f"\n\n{inner}\n\n"
        else:
            text = inner
        done[id(node)] = text
    return _finished(done[id(root)]), _finished(done[keep]) if part else ""


def _finished(text: str) -> str:
    out = re.sub("[\x00-\x03]", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n", "\n", re.sub(r"\n (?=\S)", "\n", out))).strip()


def _with_list(text: str, urls: dict[str, int]) -> str:
    return text + ("\n\n" + "\n".join(f"[{n}]: {u}" for u, n in urls.items()) if urls else "")


def render(root: Node, references: bool = False) -> str:
    """Markdown of a tree: headings, nested lists, tables, quotes, code, links inline or, with ``references``, numbered with a list at the end."""
    urls = _urls(root) if references else {}
    return _with_list(_rendered(root, {u: f"[{n}]" for u, n in urls.items()})[0], urls)


def main_part(root: Node) -> Node:
    """The element with most text in paragraphs of its own, not counting text of links: the article of a page with menus around."""
    text: dict[int, int] = {}
    links: dict[int, int] = {}
    best, most = root, 0.0
    for node in _upwards(root):
        kids = [c for c in node.children if isinstance(c, Node) and c.tag not in DROPPED]
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        text[id(node)] = own + sum(text[id(c)] for c in kids)
        links[id(node)] = text[id(node)] if node.tag == "a" else sum(links[id(c)] for c in kids)
        if node.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "li", "a", "td", "tr"):
            continue
        direct = sum(text[id(c)] - links[id(c)] for c in kids if c.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "ul", "ol", "table")) + own
        score = direct * (1 - links[id(node)] / max(1, text[id(node)]))
        if score > most:
            best, most = node, score
    return best


def renderings(page: str | None, names: tuple[str, ...] = NAMES) -> tuple[str, ...]:
    """The page by each of ``names``: whole, whole with numbered links, main part. One pass gives the whole page and its main part."""
    root = tree_of(page or "")
    main = main_part(root) if "main" in names else None
    made = {}
    urls = _urls(root) if "links" in names else {}
    if urls and "tree" in names and not main and all(_SAFE_URL.fullmatch(u) for u in urls) and not _MARKS.search(page) and "&" not in page:
        # Both renderings differ in the targets of links alone, so one pass leaves marks for them.
        text = _rendered(root, {u: f"\x04{n}\x05" for u, n in urls.items()})[0]
        targets = [f"({u})" for u in urls]
        made["tree"] = _MARKS.sub(lambda m: targets[int(m[1]) - 1], text)
        made["links"] = _with_list(_MARKS.sub(r"[\1]", text), urls)
        return tuple(made[n] for n in names)
    if "tree" in names or main:
        made["tree"], made["main"] = _rendered(root, {}, main)
    if "links" in names:
        made["links"] = _with_list(_rendered(root, {u: f"[{n}]" for u, n in urls.items()})[0], urls) if urls or "tree" not in made else made["tree"]
    return tuple(made[n] for n in names)


def with_renderings(pages: DataFrame, html: str = "body_html", names: tuple[str, ...] = NAMES) -> DataFrame:
    """``pages`` with a column for each of ``names``, others are not made; null pages give empty ones."""

    def work(batches):
        for batch in batches:
            made = [renderings(p, names) for p in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([m[i] for m in made], pa.string()) for i in range(len(names))]], names=[*batch.schema.names, *names])

    own = pages.drop(*[n for n in NAMES if n != html])
    return own.mapInArrow(work, T.StructType([*own.schema.fields, *[T.StructField(n, T.StringType()) for n in names]]))


def best_markdown(pages: DataFrame, html: str = "body_html", plain: str | None = None) -> DataFrame:
    """``pages`` with ``rendering, quality, markdown``: the best of the renderings, and of the plain part (fixed at 0.8) if there is one."""
    r = with_renderings(pages, html)
    page_text = markup.html_text(F.coalesce(F.col(html), F.lit("")))
    rivals = {n: (markup.tidy_markdown(F.col(n)), markup.markdown_quality(markup.tidy_markdown(F.col(n)), page_text)) for n in NAMES}
    if plain:
        rivals["plain"] = (F.col(plain), F.when(F.length(F.trim(F.coalesce(F.col(plain), F.lit("")))) > 0, 0.8).otherwise(0.0).cast("double"))
    best = markup.best_rendering(rivals)
    return r.withColumn("__best", best).withColumns({"rendering": F.col("__best.name"), "quality": F.col("__best.quality"), "markdown": F.col("__best.text")}).drop("__best", *NAMES)
