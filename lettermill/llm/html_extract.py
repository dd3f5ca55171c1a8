"""HTML extraction by equivalence-class template deduction.

Tokens are block tags in their place (under the open elements around them, with their classes) and blocks of
text in theirs; each is 64 bits made of the token around it, so that depth costs nothing. Over the pages of a host, tokens with the same occurrence vector (so often on each page) form an
equivalence class. A class is valid if enough pages share it, if its tokens stand in the same order on all of
them, and if it nests: every token lies in an element of another valid class, or at the top. The valid classes
are the host's template. Its text is dropped wherever it stands; its innermost once-a-page element that holds
most text is the main node, and what the slots below that node hold is the text.

Menus, adverts, comments and the like whose text differs from page to page are no template text; they are
known by tag, role, or a class all of whose words name such a thing. Within an article or main element only
words count that cannot name a part of the text: a notice, menu or header there may be the author's.

Pages of a host with equal titles and headings are versions of one text and count as one page, each for its
part, so that a text does not become template by its own copies. Text on half of a host's texts is template,
also within the main node.
"""

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.scratch import Scratch, small_batches
from lettermill.llm.url_filter import split_url

#: A class of tags may be valid if this share of the pages of its host (and at least 2, if there are 2) has it.
SUPPORT = 0.05
#: A class of texts may be valid if this share of the pages, and at least so many, has it.
TEXT_SUPPORT = 0.5
TEXT_PAGES = 3
#: A tag frames a slot if this share of the pages that have it has it exactly once.
FRAME = 0.5
#: Share of a host's slot text that the main node must hold where no article element says so.
MAIN_SHARE = 0.6
#: Most bytes of templates (or of what is known of versions) that may be broadcast; beyond it, pages are joined to them by shuffle.
BROADCAST_BYTES = 32 << 20
#: Elements and hosts that a task remembers.
REMEMBERED = 200_000

# Names with a meaning for the text.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "select", "object", "canvas", "audio", "video", "title")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
DROPPED = {"nav", "footer", "aside", "form", "button", "head", "menu", "dialog", "fieldset"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
DROPPED_WORDS = {
    "ad", "ads", "adbox", "adsense", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments", "respond",
    "replies", "disqus", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "footer", "masthead", "related", "recommended", "widget", "toolbar", "pagination",
}
#: Of these, words that within an article may name a part of its text.
ARTICLE_WORDS = {
    "promotion", "banner", "notice", "notices", "alert", "overlay", "subscription", "share", "sharing", "social", "respond", "replies", "menu", "nav", "navigation",
    "header", "footer", "masthead", "related", "recommended", "widget", "toolbar",
}
#: Words of a class that say where or how a thing stands, not what it is.
PLACE_WORDS = {"box", "wrap", "wrapper", "list", "area", "bar", "slot", "container", "block", "unit", "top", "bottom", "left", "right", "inner", "outer", "section", "site", "page", "global", "item", "thread", "form", "count", "reader", "user"}
#: Start tags that end an open paragraph or item of the same kind.
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</(?P=raw)\s*[^>]*(?:>|\Z)|\Z))"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


def _names_boilerplate(name: str, inner: bool) -> bool:
    """Whether a class or id says nothing but that it holds a menu, an advert, comments or the like; ``inner``: within an article."""
    words = set(_WORD.findall(name))
    named = words & DROPPED_WORDS
    return bool(named - ARTICLE_WORDS if inner else named) and words <= DROPPED_WORDS | PLACE_WORDS


def _step_of(name: str, attrs: str, inner: bool) -> str:
    """An element's name with its classes, ``[main]`` for one that holds the text by its role, ``!`` for one that is boilerplate by its tag, role, id or a class."""
    said = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTR.findall(attrs)} if "=" in attrs else {}
    step = name
    if said.get("class"):
        step += "." + ".".join(sorted(said["class"].split()))
    # A header is the site's, but for that of an article.
    drop = name in DROPPED or said.get("role") in DROPPED_ROLES or name == "header" and not inner
    if name not in ("html", "body", "article", "main"):
        drop = drop or any(_names_boilerplate(n, inner) for k in ("class", "id") for n in said.get(k, "").split())
    if said.get("role") in ("main", "article") or said.get("itemprop") == "articlebody":
        step += "[main]"
    return step + "!" if drop else step


def token(around: int, said: str) -> int:
    """64 bits that stand for a tag (``/`` and its step) or a block of text (a null character and the text) in the element whose token is ``around``."""
    return int.from_bytes(hashlib.blake2b(f"{around}{said}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_steps: dict[tuple[str, str, bool], str] = {}
_tokens: dict[tuple[int, str], int] = {}


def _known(cache: dict, make, *key):
    got = cache.get(key)
    if got is None:
        if len(cache) >= REMEMBERED:
            cache.clear()
        got = cache[key] = make(*key)
    return got


def walk(page: str) -> Iterator[tuple[str, int, int, str, bool, bool, str]]:
    """(kind, token, parent, step, dropped, block, text) in page order; kind is open, void, close or text.

    Tokens are those of block elements, 0 at the top; inline elements lie within their block. ``dropped``: under a
    boilerplate element. ``text`` is the name of an opened element. What is kept of an open element does not grow with depth.
    """
    stack: list[tuple[str, int, bool, bool]] = []  # element, token, dropped, within an article
    n_open: Counter[str] = Counter()
    at, dropped, inner = 0, False, False

    def cut(n: int) -> tuple[int, bool, bool]:
        for e, *_ in stack[n:]:
            n_open[e] -= 1
        del stack[n:]
        return stack[-1][1:] if stack else (0, False, False)

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            yield "text", at, 0, "", dropped, False, text
            continue
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        block = name not in INLINE
        if m["close"]:
            for n in range(len(stack) - 1, -1, -1) if n_open[name] else ():
                if stack[n][0] == name:
                    at, dropped, inner = cut(n)
                    break
                if not block and stack[n][0] not in INLINE:
                    break
            yield "close", at, 0, "", dropped, block, ""
            continue
        if block and name not in VOID:
            ends, scope = ENDS_SAME.get(name, set()), SCOPE.get(name, set())
            for n in range(len(stack) - 1, -1, -1) if n_open["p"] or any(n_open[e] for e in ends) else ():
                open_name = stack[n][0]
                if open_name == "p" or open_name in ends:
                    at, dropped, inner = cut(n)
                elif open_name in scope or open_name not in INLINE and not ends:
                    break
        step = _known(_steps, _step_of, name, m["attrs"], inner)
        drop = dropped or step.endswith("!")
        if name in VOID or m["attrs"].endswith("/"):
            yield "void", at, 0, "", drop, block, name
            continue
        parent = at
        if block:
            at = _known(_tokens, token, parent, f"/{step}")
        dropped, inner = drop, inner or name in ("article", "main")
        stack.append((name, at, dropped, inner))
        n_open[name] += 1
        yield "open", at, parent, step, dropped, block, name


def read(page: str) -> Iterator[tuple[int, int, str | None, str | None]]:
    """(token, parent, step, text) in page order: block elements as they open (text is None), and the blocks of text outside boilerplate (step is None, the token is the element's)."""
    inside: list[str] = []
    place = 0
    for kind, at, parent, step, dropped, block, text in walk(page):
        if kind == "text":
            if not dropped:
                inside.append(text)
                place = at
        elif block:
            said = " ".join(html.unescape("".join(inside)).split()) if inside else ""
            inside.clear()
            if said:
                yield place, 0, None, said
            if kind == "open":
                yield at, parent, step, None
        elif text == "br":
            inside.append(" ")
    said = " ".join(html.unescape("".join(inside)).split())
    if said:
        yield place, 0, None, said


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few pages, since each page makes many rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            yield batch.slice(a, 200)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        host, page, copies, ids, parent, step, n, chars = [], [], [], [], [], [], [], []
        for h, i, c, text in zip(*(part.column(c).to_pylist() for c in ("host", "page", "copies", "html")), strict=True):
            opened: Counter[int] = Counter()
            element: dict[int, tuple[int, str]] = {}
            size: Counter[int] = Counter()
            texts: Counter[int] = Counter()
            around: dict[int, int] = {}
            for t, p, s, said in read(text):
                if said is None:
                    opened[t] += 1
                    element[t] = p, s
                else:
                    size[t] += len(said)
                    own = token(t, f"\0{said}")
                    texts[own] += 1
                    around[own] = t
            rows = len(opened) + len(texts)
            host += [h] * rows
            page += [i] * rows
            copies += [c] * rows
            ids += [*opened, *texts]
            parent += [element[t][0] for t in opened] + [around[t] for t in texts]
            step += [element[t][1] for t in opened] + [None] * len(texts)
            n += [*opened.values(), *texts.values()]
            chars += [size[t] for t in opened] + [0] * len(texts)
        columns = (pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(copies, pa.int64()), pa.array(ids, pa.int64()), pa.array(parent, pa.int64()), pa.array(step, pa.string()), pa.array(n, pa.int64()), pa.array(chars, pa.int64()))
        yield pa.RecordBatch.from_arrays([*columns], names=["host", "page", "copies", "token", "parent", "step", "n", "chars"])


def token_classes(pages: DataFrame) -> DataFrame:
    """(host, pages, tokens): per host its tokens' classes, as an array of (token, parent, step, vector, pages, once, chars).

    ``parent`` is the token of the element around it, 0 at the top; ``step`` is null for texts.
    ``pages`` has (host, page, copies, html), where each of ``copies`` versions of one text counts for its part of one. ``vector`` is a sum over pages of hash(page, count): equal for equal
    occurrence vectors. Everything is summed up before the shuffle, so a host with a third of all
    pages costs no more than its distinct tokens a task. The array of a host is bounded: a tag that less than ``SUPPORT``, or a
    text that less than ``TEXT_SUPPORT`` of the pages have is left out.
    """
    counts = pages.mapInArrow(_count, "host string, page long, copies long, token long, parent long, step string, n long, chars long")
    vector = F.shiftright(F.xxhash64("page", "n"), 24)
    one = F.round(F.sum(1 / F.col("copies"))).cast("long")
    tokens = counts.groupBy("host", "token").agg(F.first("step").alias("step"), F.sum(vector).alias("vector"), F.first("parent").alias("parent"), one.alias("pages"), F.round(F.sum(F.when(F.col("n") == 1, 1 / F.col("copies")).otherwise(0.0))).cast("long").alias("once"), F.sum("chars").alias("chars"))
    totals = pages.groupBy("host").agg(one.alias("all"))
    tag = (F.col("pages") >= F.least(F.lit(2), F.col("all"))) & (F.col("pages") >= F.lit(SUPPORT) * F.col("all"))
    text = (F.col("pages") >= TEXT_PAGES) & (F.col("pages") >= F.lit(TEXT_SUPPORT) * F.col("all"))
    kept = tokens.join(totals, "host").where(F.when(F.col("step").isNotNull(), tag).otherwise(text))
    return kept.groupBy("host").agg(F.first("all").alias("pages"), F.collect_list(F.struct("token", "parent", "step", "vector", "pages", "once", "chars")).alias("tokens"))


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, vector, least, most): in what order each page has the tokens of each class, 0 if it is not the same in each of its rounds."""
    known: dict[str, tuple[dict[int, int], Counter[int]]] = {}
    held = 0
    for part in _parts(batches):
        out: dict[tuple[str, int], list[int]] = {}
        for h, text, ids, vectors in zip(*(part.column(c).to_pylist() for c in ("host", "html", "ids", "vectors")), strict=True):
            if h not in known:
                if held + len(ids) > REMEMBERED:
                    known.clear()
                    held = 0
                held += len(ids)
                known[h] = dict(zip(ids, vectors, strict=True)), Counter(vectors)
            vector_of, sizes = known[h]
            order: dict[int, list[int]] = {}
            for at, _, _, said in read(text):
                t = at if said is None else token(at, f"\0{said}")
                if t in vector_of:
                    order.setdefault(vector_of[t], []).append(t)
            for v, seen in order.items():
                size = sizes[v]
                same = len(seen) % size == 0 and all(seen[i] == seen[i % size] for i in range(size, len(seen))) and len(set(seen[:size])) == size
                got = hash(tuple(seen[:size])) | 1 if same else 0
                both = out.setdefault((h, v), [got, got])
                both[:] = min(both[0], got), max(both[1], got)
        columns = (pa.array([h for h, _ in out], pa.string()), pa.array([v for _, v in out], pa.int64()), pa.array([a for a, _ in out.values()], pa.int64()), pa.array([b for _, b in out.values()], pa.int64()))
        yield pa.RecordBatch.from_arrays([*columns], names=["host", "vector", "least", "most"])


def template(tokens: list[dict], ordered: set[int]) -> list[dict]:
    """The tokens of a host's valid classes that nest; ``ordered``: the vectors of the classes in order.

    A class out of order is split: its tags, told apart by their place, are classes of their own; its texts are no template.
    A class nests if the element around each of its tokens is a tag of a valid class, or the token stands at the top.
    """
    part = {t["token"]: t["vector"] if t["vector"] in ordered else ("own", t["token"]) for t in tokens if t["step"] is not None or t["vector"] in ordered}
    of = [t for t in tokens if t["token"] in part]
    while True:
        held = {t["token"] for t in of if t["step"] is not None} | {0}
        lost = {part[t["token"]] for t in of if t["parent"] not in held}
        if not lost:
            return of
        of = [t for t in of if part[t["token"]] not in lost]


def main_nodes(tokens: list[dict]) -> list[int]:
    """The main nodes of a template (tokens), none within another: the innermost elements, once on a page, that hold most of its text.

    Of several such elements within each other an article is the main node. Where layouts differ, each article that is once on
    its pages is one. Without either the host has no main node.
    """
    tags = {t["token"]: t for t in tokens if t["step"] is not None}
    inner: dict[int, list[int]] = {}
    for t in tags.values():
        inner.setdefault(t["parent"] if t["parent"] in tags else 0, []).append(t["token"])
    # From the top down: each element behind the one around it.
    order = list(inner.get(0, ()))
    depth, gone = {}, set()
    for t in order:
        parent = tags[t]["parent"]
        depth[t] = depth.get(parent, 0) + 1
        if parent in gone or tags[t]["step"].endswith("!"):
            gone.add(t)
        order += inner.get(t, ())
    below = {t: tags[t]["chars"] for t in order}
    for t in reversed(order):
        if tags[t]["parent"] in below:
            below[tags[t]["parent"]] += below[t]
    frames = [t for t in order if tags[t]["once"] >= FRAME * tags[t]["pages"] and t not in gone and not _TEXTUAL.match(tags[t]["step"])]
    whole = max((below[t] for t in frames), default=0)
    most = [t for t in frames if whole and below[t] >= MAIN_SHARE * whole]
    on = {t: tags[t]["pages"] for t in order}
    articles = [t for t in frames if _ARTICLE.match(tags[t]["step"])]
    # Those that hold most; then those of other layouts, on pages that the former leave free.
    chosen = [t for t in articles if t in set(most)]
    taken = sum(map(on.get, chosen))
    for t in sorted(set(articles) - set(chosen), key=lambda t: (-below[t], depth[t], t)):
        if taken + on[t] <= max(on.values()):
            chosen.append(t)
            taken += on[t]
    if chosen:
        outer, within = set(chosen), set()
        for t in order:
            if tags[t]["parent"] in outer or tags[t]["parent"] in within:
                within.add(t)
        return [t for t in chosen if t not in within]
    mains = [t for t in most if _MAIN.search(tags[t]["step"])]
    return [max(mains or most, key=lambda t: (depth[t], t))] if most else []


_TEXTUAL = re.compile(r"(?:p|h[1-6]|li|td|th|tr|ul|ol|dl|dt|dd|table|tbody|thead|blockquote|pre|figure)(?![a-z0-9])")
_ARTICLE = re.compile(r"article(?![a-z0-9-])")
_MAIN = re.compile(r"(?:^main(?![a-z0-9-])|\[main\])")


def _deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [template(t, set(v or ())) for t, v in zip(*(batch.column(c).to_pylist() for c in ("tokens", "ordered")), strict=True)]
        fixed = [[t["token"] for t in tokens if t["step"] is None] for tokens in made]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([main_nodes(t) for t in made], pa.list_(pa.int64())), pa.array(fixed, pa.list_(pa.int64()))], names=["host", "mains", "fixed"])


def main_text(page: str, mains: set[int], fixed: set[int]) -> str:
    """What the slots below the page's main node hold (all slots if it has none), without the template's text."""
    within: dict[int, bool] = {}
    blocks = []
    for at, parent, _, said in read(page):
        if said is None:
            within[at] = at in mains or within.get(parent, False)
        else:
            blocks.append((at, said))
    if any(within.values()):
        blocks = [(at, said) for at, said in blocks if within.get(at)]
    return "\n".join(said for at, said in blocks if not fixed or token(at, f"\0{said}") not in fixed)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        names = [n for n in part.schema.names if n not in ("__html", "__mains", "__fixed")]
        rows = zip(*(part.column(c).to_pylist() for c in ("__html", "__mains", "__fixed")), strict=True)
        got = [main_text(p or "", set(mains or ()), set(fixed or ())) for p, mains, fixed in rows]
        yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(got, pa.string())], names=[*names, "text"])


def _small(rows: DataFrame, size) -> DataFrame:
    """``rows``, to be broadcast if they have at most ``BROADCAST_BYTES``; ``size``: bytes of one."""
    return F.broadcast(rows) if (rows.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else rows


def _text_key(page) -> Column:
    """What versions of one text have in common: title and headings, or all of a page without them."""
    said = F.regexp_extract_all(page, F.lit(r"(?is)<(title|h[1-3])\b[^>]*>(.*?)</\1\s*>"), F.lit(2))
    return F.when(F.size(said) > 0, F.xxhash64(said)).otherwise(F.xxhash64(page))


def templates(df: DataFrame, scratch: Scratch, url: str = "url", page: str = "html") -> DataFrame:
    """(host, mains, fixed): the main nodes and the text tokens of the template of every host, deduced from all its pages."""
    host, _ = split_url(F.col(url))
    pages = df.where(F.col(page).isNotNull()).select(host.alias("host"), F.xxhash64(page).alias("page"), _text_key(F.col(page)).alias("key"), F.col(page).alias("html"))
    # Versions count as one page: they say nothing about what is template.
    repeated = pages.groupBy("host", "key").agg(F.count("*").alias("copies")).where("copies > 1")
    repeated = scratch.save(repeated.select(F.col("host").alias("__h"), F.col("key").alias("__k"), "copies"), "repeated")
    repeated = _small(repeated, F.octet_length("__h") + F.lit(16))
    pages = pages.join(repeated, (F.col("host") == F.col("__h")) & (F.col("key") == F.col("__k")), "left").select("host", "page", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "html")
    found = scratch.save(token_classes(pages), "classes")
    classes = found.select("host", F.transform("tokens", lambda t: t["token"]).alias("ids"), F.transform("tokens", lambda t: t["vector"]).alias("vectors"))
    classes = _small(classes, F.octet_length("host") + F.lit(16) * F.size("ids"))
    orders = pages.join(classes, "host").mapInArrow(_orders, "host string, vector long, least long, most long")
    orders = orders.groupBy("host", "vector").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least = most and least <> 0")
    ordered = scratch.save(orders.groupBy("host").agg(F.collect_list("vector").alias("ordered")), "ordered")
    return found.join(ordered, "host", "left").select("host", "tokens", "ordered").mapInArrow(_deduce, "host string, mains array<long>, fixed array<long>")


def extract_main_text(df: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    r"""``df`` without ``html`` and with ``text`` (main text) and ``n_chars`` (its code points).

    - Blocks are runs of text between block tags; character references are decoded, white space becomes one space,
      blocks are trimmed, empty ones left out, the rest joined by \n in page order.
    - Null and empty html give an empty text. Null urls, and those without a host, form one host.
    - Nesting may be of any depth. Versions of one text (equal titles and headings) count as one page of the host.
    - A host with few pages takes its main node from those; text is template only on ``TEXT_PAGES`` pages or more. A page
      without a main node gives all its slots outside boilerplate. Markup that is cut off at the end is no text.
    - Columns named ``text`` and ``n_chars`` are replaced, others kept; repeated rows come
      out repeated; an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "html")
    small_batches(df.sparkSession)
    made = scratch.save(templates(df, scratch, url, page), "templates").select(F.col("host").alias("__host"), F.col("mains").alias("__mains"), F.col("fixed").alias("__fixed"))
    scratch.drop("repeated", "classes", "ordered")
    host, _ = split_url(F.col(url))
    own = df.select(*[c for c in df.columns if c not in ("text", "n_chars", page)], F.col(page).alias("__html"))
    rows = own.withColumn("__host", host).join(_small(made, F.octet_length("__host") + F.lit(8) * (F.size("__mains") + F.size("__fixed"))), "__host", "left").drop("__host")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("__html", "__mains", "__fixed")) + ", text string"
    out = rows.mapInArrow(_extract, schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op10_template_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
