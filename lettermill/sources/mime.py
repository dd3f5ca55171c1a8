"""Small per-message helpers: MIME parsing and HTML to text. They run inside Spark tasks, a message at a time."""

import email
import re
from datetime import datetime
from email import policy
from functools import lru_cache
from html.parser import HTMLParser

BLOCK = {"p", "div", "br", "li", "tr", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "hr", "section", "article"}
SKIP = {"script", "style", "head", "noscript", "title"}


class _Markdown(HTMLParser):
    """HTML as Markdown: headings, emphasis, links, items; scripts and styles dropped, hidden and 1x1 images too."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in SKIP:
            self.skip += 1
        elif tag in BLOCK:
            self.out.append("\n")
            self.out.append({"li": "- ", "h1": "# ", "h2": "## ", "h3": "### ", "hr": "---\n", "blockquote": "> "}.get(tag, ""))
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "img" and not ({a.get("width"), a.get("height")} & {"0", "1"}) and "display:none" not in (a.get("style") or "").replace(" ", ""):
            self.out.append(f"![{a.get('alt') or 'Image'}]({a.get('src') or ''})")

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCK:
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(page: str) -> str:
    p = _Markdown()
    p.feed(page or "")
    p.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(p.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


#: Headers that a damaged file may hold further down. Fixed values.
KNOWN_HEADERS = ("Message-ID", "Subject", "From", "To", "Cc", "Bcc", "Date", "X-Gmail-ID", "X-Thread-ID", "X-Gmail-Labels", "Content-Type", "Content-Transfer-Encoding", "MIME-Version")
_HEADER = re.compile(rb"^(" + b"|".join(re.escape(h.encode()) for h in KNOWN_HEADERS) + rb"):[ \t]*([^\r\n]*(?:\r?\n[ \t]+[^\r\n]+)*)", re.M | re.I)
_BLOCK = re.compile(rb"(?:^[!-9;-~]+:[^\r\n]*(?:\r?\n[ \t]+[^\r\n]*)*(?:\r?\n|\Z))+", re.M)
_NAMED = re.compile(rb"^(?:From|Subject):", re.M | re.I)
_MIME_NAME = re.compile(rb"(?:Content-[A-Za-z-]+|MIME-Version):", re.I)


def repair_message(raw: bytes) -> bytes:
    """A message whose headers lie behind other lines, with its headers in front and its body behind one blank line.

    The headers are the first block of adjacent header lines that has From or Subject, with known ones that stand before it; of
    repeated ones the last counts. A block of MIME headers alone that follows belongs to them. The body is all behind: mail
    that it quotes, headers and all, is body. If no block has From or Subject, known headers are taken up to the last one.
    """
    block = next((m for m in _BLOCK.finditer(raw) if _NAMED.search(m[0])), None)
    if block:
        end = block.end()
        while more := _BLOCK.match(raw, re.compile(rb"[\r\n]*").match(raw, end).end()):
            lines = [line for line in more[0].splitlines() if line[:1] not in b" \t"]
            if not all(_MIME_NAME.match(line) for line in lines):
                break
            end = more.end()
    else:
        end = max((m.end() for m in _HEADER.finditer(raw)), default=0)
    found = {m[1].lower(): m for m in _HEADER.finditer(raw, 0, end)}
    head = b"\r\n".join(m[1] + b": " + re.sub(rb"\r?\n[ \t]+", b" ", m[2]) for m in found.values())
    return head + b"\r\n\r\n" + raw[end:].lstrip(b"\r\n")


HEADS = ("Message-ID", "Subject", "From", "To", "Cc", "Bcc", "Date", "X-Gmail-ID", "X-Thread-ID", "X-Gmail-Labels")
_FIELD = re.compile(rb"([!-9;-~]+):([^\r\n]*(?:\r?\n[ \t][^\r\n]*)*)(?:\r?\n|\Z)")
_FIELDS = re.compile(rb"(?:[!-9;-~]+:[^\r\n]*(?:\r?\n[ \t][^\r\n]*)*(?:\r?\n|\Z))*")
_LONE_RETURN = re.compile(rb"\r(?!\n)")
_TEXT_TYPE = re.compile(rb'text/(plain|html)(?:; ?charset=("?)(utf-8|us-ascii|iso-8859-1)\2)?', re.I)
_PARTS_TYPE = re.compile(rb'multipart/(?:alternative|mixed|related); ?boundary="([0-9A-Za-z+_.=-]{1,70})"', re.I)
_ADDRESS = re.compile(r"[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_DATE = re.compile(r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?(\d{1,2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) ([12]\d{3}) (\d\d):(\d\d):(\d\d) ([+-](?:0\d|1[0-4])[0-5]\d)")
_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
_MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}


def _split(raw: bytes) -> tuple[dict[bytes, bytes], bytes] | None:
    """Header fields by lower-case name, of repeated ones the first, and the body; None where line ends or lines are not plain."""
    if _LONE_RETURN.search(raw):
        return None
    end = _FIELDS.match(raw).end()
    rest = raw[end : end + 5]
    if rest == b"From " or rest[:1] in (b":", b" ", b"\t"):
        return None
    fields: dict[bytes, bytes] = {}
    for name, value in _FIELD.findall(raw, 0, end):
        value = value.lstrip(b" \t")
        fields.setdefault(name.lower(), value.replace(b"\r\n", b"").replace(b"\n", b"") if b"\n" in value else value)
    return fields, raw[end + (2 if rest[:2] == b"\r\n" else rest[:1] == b"\n") :]


def _texts(fields: dict[bytes, bytes], body: bytes, inner: bool = False) -> list[tuple[str, str]] | None:
    """(plain or html, text) of each part, where all are texts that lie in the message as they are; else None."""
    if b"content-disposition" in fields or fields.get(b"content-transfer-encoding", b"8bit").lower() not in (b"7bit", b"8bit", b"binary"):
        return None
    kind = fields.get(b"content-type", b"text/plain")
    if text := _TEXT_TYPE.fullmatch(kind):
        return [(text[1].decode().lower(), body.decode((text[3] or b"utf-8").decode(), "replace"))]
    parts = None if inner else _PARTS_TYPE.fullmatch(kind)
    if not parts:
        return None
    mark = b"--" + parts[1]
    end = next((e for e in (b"\r\n", b"\n") if body.startswith(mark + e)), None)
    if end is None:
        return None
    pieces = (end + body).split(end + mark)
    # Each mark must stand alone on its line, and the last must close.
    if body.count(mark) != len(pieces) - 1 or len(pieces) < 3 or pieces[-1] not in (b"--", b"--" + end):
        return None
    out: list[tuple[str, str]] = []
    for piece in pieces[1:-1]:
        if not piece.startswith(end) or piece.endswith(b"\r"):
            return None
        part = _split(piece[len(end) :])
        texts = part and _texts(*part, inner=True)
        if texts is None:
            return None
        out += texts
    return out


@lru_cache(4096)
def _parsed_header(name: str, value: str) -> str:
    return str(policy.default.header_fetch_parse(name, value))


def _header(name: str, raw: bytes | None) -> str | None:
    """A header as the email package decodes it, which is asked where the value is not plain."""
    if raw is None:
        return None
    if name == "Subject" or name[:2] == "X-":
        if b"=?" not in raw:
            return raw.decode("utf-8", "replace")
    elif raw.isascii():
        value = raw.decode()
        if name == "Date":
            if m := _DATE.fullmatch(value):
                day, month, year, hour, minute, second, zone = m.groups()
                try:
                    week = datetime(int(year), _MONTHS[month], int(day), int(hour), int(minute), int(second)).weekday()
                    return f"{_DAYS[week]}, {int(day):02} {month} {year} {hour}:{minute}:{second} {zone}"
                except ValueError:
                    pass
        elif _ADDRESS.fullmatch(value[1:-1] if name == "Message-ID" and value[:1] + value[-1:] == "<>" else "" if name == "Message-ID" else value):
            return value
    value = raw.decode("ascii", "surrogateescape")
    return (_parsed_header if len(value) < 200 else _parsed_header.__wrapped__)(name, value)


def _parse(raw: bytes, repair: bool = True) -> dict:
    split = _split(raw)
    if split:
        fields, body = split
        if repair and raw and b"from" not in fields and b"subject" not in fields and _HEADER.search(raw):
            return _parse(repair_message(raw), repair=False)
        texts = _texts(fields, body)
        if texts is not None:
            plain, pages = ([t for k, t in texts if k == kind] for kind in ("plain", "html"))
            head = {k: _header(k, fields.get(k.lower().encode())) for k in HEADS}
            return {"headers": head, "plain": "\n".join(plain) or None, "html": "\n".join(pages) or None, "attachments": False, "error": None}
    return _parse_any(raw, repair)


def _parse_any(raw: bytes, repair: bool = True) -> dict:
    """Any message, by the email package."""
    m = email.message_from_bytes(raw, policy=policy.default)
    if repair and raw and m["From"] is None and m["Subject"] is None and _HEADER.search(raw):
        return _parse(repair_message(raw), repair=False)
    plain, pages, files = [], [], False
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_content_disposition() == "attachment":
            files = True
        elif part.get_content_type() in ("text/plain", "text/html"):
            body = part.get_payload(decode=True) or b""
            text = body.decode(part.get_content_charset() or "utf-8", "replace")
            (plain if part.get_content_type() == "text/plain" else pages).append(text)
    head = {k: (str(m[k]) if m[k] is not None else None) for k in HEADS}
    return {"headers": head, "plain": "\n".join(plain) or None, "html": "\n".join(pages) or None, "attachments": files, "error": None}


def parse_message(raw: bytes) -> dict:
    """Headers, plain text, HTML, and attachment flag of one message. A message that cannot be parsed gives ``error``.

    Messages of plain headers and unencoded texts are taken apart here, all others by the email package, which gives the same at many times the cost.
    """
    try:
        return _parse(raw or b"")
    except Exception as e:  # one bad message must not stop a scan of millions; it becomes a row with its error
        return {"headers": {}, "plain": None, "html": None, "attachments": False, "error": f"{type(e).__name__}: {e}"[:500]}


def best_body(plain: str | None, page: str | None) -> str | None:
    """The plain part, unless it is much shorter than the HTML part without its white space."""
    if plain and (not page or len(plain) >= 0.4 * len(re.sub(r"\s|<[^>]*>", "", page))):
        return plain
    return html_to_markdown(page) if page else plain
