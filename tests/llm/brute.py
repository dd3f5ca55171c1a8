"""Plain Python versions of operators that SQL cannot express, row by row and pair by pair."""

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    return WORD.findall(text.translate(UPPER) if lower else text)


def shingles(text, k):
    w = words(text or "", lower=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def near_duplicates(rows, k, percent):
    """{doc_id: (n_shingles, component)} by an inverted index and exact counts."""
    sets = {d: shingles(t, k) for d, t in rows}
    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    links = []
    for d, s in sets.items():
        common = Counter(e for x in s for e in index[x] if e > d)
        links += [(d, e) for e, n in common.items() if 100 * n >= percent * (len(s) + len(sets[e]) - n)]
    found = components(sets, links)
    return {d: (len(s), found[d]) for d, s in sets.items()}, links


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


class Blocks(HTMLParser):
    """(path, text) of the text blocks of a page, and the paths of its block elements."""

    def __init__(self, page, without):
        super().__init__()
        self.stack, self.blocks, self.opened, self.without = [], [], Counter(), without
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag != "b":
            if tag == "li" and self.stack[-1] == "li":
                self.stack.pop()
            self.stack.append(tag + "".join(f".{v}" for _, v in attrs))
            self.opened["/".join(self.stack)] += 1
            self.blocks.append(["/".join(self.stack), ""])

    def handle_endtag(self, tag):
        if tag != "b":
            while self.stack.pop().partition(".")[0] != tag:
                pass
            self.blocks.append(["/".join(self.stack), ""])

    def handle_data(self, data):
        if self.blocks and not any(s.partition(".")[2] in self.without for s in self.stack):
            self.blocks[-1][1] += data


def host_texts(pages, without):
    """The main texts of a host's pages: what differs between them, in the deepest element that each has once and that holds most."""
    read = [Blocks(p, without) for p in pages]
    blocks = [[(path, " ".join(text.split())) for path, text in r.blocks if text.strip()] for r in read]
    on = Counter(b for page in blocks for b in set(page))
    size = lambda path: sum(len(t) for page in blocks for p, t in page if f"{p}/".startswith(f"{path}/"))
    once = [p for p in read[0].opened if all(r.opened[p] == 1 for r in read) and not re.search("/(p|h1|ul|li)$", p)]
    main = max((p for p in once if size(p) >= 0.6 * size("html")), key=lambda p: p.count("/"))
    return ["\n".join(t for p, t in page if f"{p}/".startswith(f"{main}/") and on[p, t] < max(3, len(pages) / 2)) for page in blocks]
