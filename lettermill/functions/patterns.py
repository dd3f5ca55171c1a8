"""A check of rule patterns before they run: the JVM's matcher has no timeout, so a pattern that may backtrack without end is refused."""

import re
from collections.abc import Iterator
from functools import lru_cache

#: Characters by which two parts of a pattern are compared: all of ASCII, and some letters and signs beyond.
_SAMPLE = [chr(i) for i in range(128)] + list("äßéЖ中…€\u00a0")
_MANY = re._constants.MAXREPEAT


class UnsafePattern(ValueError):
    """A pattern whose time may grow with a power of the text that is over the square, or without bound."""


def _first(items) -> tuple[set[str], bool]:
    """(characters that a match may begin with, whether it may be empty)."""
    out: set[str] = set()
    for op, arg in items:
        chars, empty = _one(op, arg)
        out |= chars
        if not empty:
            return out, False
    return out, True


def _one(op, arg) -> tuple[set[str], bool]:
    name = str(op)
    if name in ("LITERAL", "NOT_LITERAL", "ANY", "IN"):
        source = {"LITERAL": lambda: re.escape(chr(arg)), "NOT_LITERAL": lambda: f"[^{re.escape(chr(arg))}]", "ANY": lambda: "(?s:.)", "IN": lambda: None}[name]()
        if source is None:
            return {c for c in _SAMPLE if _in(arg, c)}, False
        own = {chr(arg)} if name == "LITERAL" else set()
        return {c for c in _SAMPLE if re.fullmatch(source, c, re.I)} | own, False
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        chars, empty = _first(arg[2])
        return chars, empty or arg[0] == 0
    if name == "SUBPATTERN":
        return _first(arg[3])
    if name == "ATOMIC_GROUP":
        return _first(arg)
    if name == "BRANCH":
        each = [_first(b) for b in arg[1]]
        return set().union(*[c for c, _ in each]), any(e for _, e in each)
    return set(), True  # positions and look-around take no character


def _in(items, c: str) -> bool:
    """Whether a character class holds ``c``, letter case ignored."""
    negated, found = False, False
    for op, arg in items:
        name = str(op)
        if name == "NEGATE":
            negated = True
        elif name == "LITERAL":
            found |= chr(arg).lower() == c.lower()
        elif name == "RANGE":
            found |= any(arg[0] <= ord(x) <= arg[1] for x in (c.lower(), c.upper()) if len(x) == 1)
        elif name == "CATEGORY":
            kind = str(arg).removeprefix("CATEGORY_")
            hit = {"DIGIT": c.isdigit(), "SPACE": c.isspace(), "WORD": c.isalnum() or c == "_"}[kind.removeprefix("NOT_")]
            found |= hit != kind.startswith("NOT_")
    return found != negated


def _children(op, arg) -> Iterator[list]:
    name = str(op)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        yield list(arg[2])
    elif name == "SUBPATTERN":
        yield list(arg[3])
    elif name == "ATOMIC_GROUP":
        yield list(arg)
    elif name == "BRANCH":
        yield from map(list, arg[1])
    elif name in ("ASSERT", "ASSERT_NOT"):
        yield list(arg[1])


def _endless(op, arg) -> bool:
    return str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == _MANY


def _faults(items: list, repeated: bool) -> Iterator[str]:
    for i, (op, arg) in enumerate(items):
        inner = repeated or _endless(op, arg)
        if repeated and str(op) == "BRANCH":
            starts = [_first(b) for b in arg[1]]
            if any(a & b or x or y for k, (a, x) in enumerate(starts) for b, y in starts[k + 1 :]):
                yield "alternatives that begin alike are repeated"
        if repeated and _endless(op, arg):
            # What is repeated inside may go on with what stands beside it: then a text can be cut in many ways.
            chars, _ = _first(arg[2])
            beside = items[:i] + items[i + 1 :]
            if all(empty or own & chars for own, empty in (_one(*x) for x in beside)):
                yield "a repetition is repeated"
        for body in _children(op, arg):
            yield from _faults(body, inner if str(op) not in ("ASSERT", "ASSERT_NOT") else False)


@lru_cache(maxsize=4096)
def check_pattern(pattern: str) -> str:
    r"""``pattern`` if it is safe, else UnsafePattern: ``(a+)+``, ``(a|aa)*``, ``(\w+\s*)*``.

    A repetition inside a repetition is allowed where something between its rounds cannot belong to it, as in ``(\w+,)*``. At the very
    end of a pattern any repetition is: nothing behind it can fail, so nothing is tried again.
    Unicode classes count as word characters here. Patterns that Python cannot read are refused too.
    """
    readable = re.sub(r"\\[pP]\{[^}]*\}", r"\\w", pattern)
    try:
        tree = re._parser.parse(readable)
    except (re.error, OverflowError) as e:
        raise UnsafePattern(f"{pattern}: {e}") from None
    items = list(tree)
    if items and str(items[-1][0]) in ("MAX_REPEAT", "MIN_REPEAT"):
        items.pop()
    for fault in _faults(items, False):
        raise UnsafePattern(f"{pattern}: {fault}")
    return pattern
